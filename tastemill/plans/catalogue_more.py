"""More registered queries: neighbour predictors by target, evaluations, rating clusters, fixed rounds of iterative operators, and the store's listings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tastemill.functions import scalars as S
from tastemill.operators import clusters as C
from tastemill.operators import factorize as M
from tastemill.operators import neighbours as N
from tastemill.operators import predict as P
from tastemill.operators import prepare as R
from tastemill.operators import ratings_clusters as RC
from tastemill.plans import assignments as A
from tastemill.plans import reports as RP
from tastemill.plans.catalogue import ASG, BEST, DIMS, ERR, GUARD, PAIR, RAT, RES, SPLIT, VEC, BUY, mod_assignment, query, r6, shown, split
from tastemill.sources import fixtures as X
from tastemill.sources import store as ST

CLIP = "greatest(1.0, least(5.0, {}))"
SUMS = "count(*) AS n, sum(x.rating) AS sx, sum(y.rating) AS sy, sum(x.rating * y.rating) AS sxy, sum(x.rating * x.rating) AS sxx, sum(y.rating * y.rating) AS syy"


def sim_sql(low: float) -> str:
    r = f"(n * sxy - sx * sy) / sqrt({GUARD})"
    r = f"greatest(-1.0, least(1.0, {r}))" if low == 0 else r
    return f"CASE WHEN n >= 2 AND {GUARD} > 0 THEN {r} ELSE {low} END"


def knn_sql(p: str, targets: str, low: float = -1, white: bool = False, clipped: bool = True, rating: bool = True) -> str:
    """CTEs that end in ``{p}scored``: the targets of a table with their prediction."""
    pred = "coalesce(mean, 0) + CASE WHEN down > 1e-10 THEN up / down ELSE 0 END"
    return f""", {p}cand AS (SELECT t.user_id, t.item_id, c.user_id AS v, c.rating AS r_v FROM {targets} t JOIN asg a ON a.user_id = t.user_id
    JOIN (SELECT train.*, cluster_id, is_gray FROM train JOIN asg USING (user_id)) c ON c.cluster_id = a.cluster_id AND c.item_id = t.item_id AND c.user_id <> t.user_id {'AND NOT c.is_gray' if white else ''}),
  {p}pr AS (SELECT DISTINCT user_id AS u, v FROM {p}cand), {p}s AS (SELECT u, v, {SUMS} FROM {p}pr JOIN train x ON x.user_id = u JOIN train y ON y.user_id = v AND y.item_id = x.item_id GROUP BY 1, 2),
  {p}sm AS (SELECT pr.u, pr.v, coalesce({sim_sql(low)}, {low}) AS sim FROM {p}pr pr LEFT JOIN {p}s s ON s.u = pr.u AND s.v = pr.v),
  {p}nb AS (SELECT * FROM (SELECT c.*, sim, row_number() OVER (PARTITION BY c.user_id, c.item_id ORDER BY abs({r6('sim')}) DESC, c.v) AS k FROM {p}cand c JOIN {p}sm m ON m.u = c.user_id AND m.v = c.v) WHERE k <= 30),
  {p}mv AS (SELECT nb.user_id, nb.item_id, sum(sim * (r_v - m.mean)) AS up, sum(abs(sim)) AS down FROM {p}nb nb JOIN means m ON m.user_id = nb.v GROUP BY 1, 2),
  {p}scored AS (SELECT t.user_id, t.item_id, {'t.rating,' if rating else ''} {CLIP.format(pred) if clipped else pred} AS pred FROM {targets} t LEFT JOIN {p}mv mv ON mv.user_id = t.user_id AND mv.item_id = t.item_id LEFT JOIN means ON means.user_id = t.user_id)"""


def fall_sql(p: str, targets: str, clipped: bool, rating: bool = True) -> str:
    pred = "coalesce(m, mean, 0)"
    return f", {p}im AS (SELECT item_id, avg(rating) AS m FROM train GROUP BY 1), {p}scored AS (SELECT t.user_id, t.item_id, {'t.rating,' if rating else ''} {CLIP.format(pred) if clipped else pred} AS pred FROM {targets} t LEFT JOIN {p}im im ON im.item_id = t.item_id LEFT JOIN means ON means.user_id = t.user_id)"


SHOW = f"SELECT user_id, item_id, rating, {r6('pred')} AS pred FROM "
PALE, DARK = "pale AS (SELECT * FROM test WHERE user_id IN (SELECT user_id FROM asg WHERE NOT is_gray))", "dark AS (SELECT * FROM test WHERE user_id IN (SELECT user_id FROM asg WHERE is_gray))"


@query("predict_knn_by_target", f"WITH {SPLIT}{knn_sql('', 'test')} {SHOW} scored")
def predict_knn_by_target(spark, sf):
    train, test, a = split(spark, sf)
    return shown(N.knn(train, test, a))


@query("predict_knn_zero_kernel", f"WITH {SPLIT}{knn_sql('', 'test', 0)} {SHOW} scored")
def predict_knn_zero_kernel(spark, sf):
    train, test, a = split(spark, sf)
    return shown(N.knn(train, test, a, "pearson_zero"))


@query("predict_white", f"WITH {SPLIT}{knn_sql('', 'test', white=True, clipped=False)} {SHOW} scored")
def predict_white(spark, sf):
    train, test, a = split(spark, sf)
    return shown(N.white(train, test, a))


@query("predict_gray_same", f"WITH {SPLIT}, {DARK}{knn_sql('', 'dark', clipped=False)} {SHOW} scored")
def predict_gray_same(spark, sf):
    train, test, a = split(spark, sf)
    return shown(N.gray_same(train, test.join(a.where("is_gray"), "user_id", "left_semi"), a))


@query("predict_routed_same", f"WITH {SPLIT}, {PALE}, {DARK}{knn_sql('p', 'pale', white=True, clipped=False)}{knn_sql('d', 'dark', clipped=False)} {SHOW} pscored UNION ALL {SHOW} dscored")
def predict_routed_same(spark, sf):
    train, test, a = split(spark, sf)
    return shown(N.routed(train, test, a))


@query("predict_routed_fallback", f"WITH {SPLIT}, {PALE}, {DARK}{knn_sql('p', 'pale', white=True, clipped=False)}{fall_sql('d', 'dark', False)} {SHOW} pscored UNION ALL {SHOW} dscored")
def predict_routed_fallback(spark, sf):
    train, test, a = split(spark, sf)
    return shown(N.routed(train, test, a, "fallback"))


def unseen_sql(name: str, users: str) -> str:
    return f", {name} AS (SELECT u.user_id, i.item_id FROM ({users}) u, (SELECT DISTINCT item_id FROM ratings) i LEFT JOIN train t ON t.user_id = u.user_id AND t.item_id = i.item_id WHERE t.item_id IS NULL)"


def lists_sql(name: str, scored: str, n: int = 10) -> str:
    return f", {name} AS (SELECT * FROM (SELECT user_id, item_id, pred, row_number() OVER (PARTITION BY user_id ORDER BY {r6('pred')} DESC, item_id) AS rank FROM {scored}) WHERE rank <= {n})"


REL35 = ", rel AS (SELECT user_id, item_id FROM test WHERE rating >= 3.5), size AS (SELECT user_id, count(*) AS rel FROM rel GROUP BY 1)"
ASKED = "SELECT DISTINCT user_id FROM test WHERE rating >= 3.5"


@query("unseen_counts", f"WITH {SPLIT}{unseen_sql('un', 'SELECT DISTINCT user_id FROM train')} SELECT user_id, count(*) AS n, min(item_id) AS first FROM un GROUP BY 1")
def unseen_counts(spark, sf):
    train, test, _ = split(spark, sf)
    return N.unseen(train, train, train.unionByName(test)).groupBy("user_id").agg(F.count("*").alias("n"), F.min("item_id").alias("first"))


@query("topn_by_predictor", f"WITH {SPLIT}{unseen_sql('un', ASKED)}{knn_sql('', 'un', rating=False)}{lists_sql('recs', 'scored')} SELECT user_id, rank, item_id, {r6('pred')} AS pred FROM recs")
def topn_by_predictor(spark, sf):
    train, test, a = split(spark, sf)
    return N.recommend(train, test.where("rating >= 3.5"), train.unionByName(test), N.Knn(train, a))


@query(
    "evaluate_cf",
    f"""WITH {SPLIT}{unseen_sql('un', ASKED)}{knn_sql('l', 'un', rating=False)}{knn_sql('', 'test')}{lists_sql('recs', 'lscored')}{REL35}, hit AS (SELECT user_id, count(*) AS h FROM recs JOIN rel USING (user_id, item_id) GROUP BY 1),
  pu AS (SELECT user_id, coalesce(h, 0) / 10.0::DOUBLE AS p, coalesce(h, 0) / rel::DOUBLE AS r FROM size LEFT JOIN hit USING (user_id)) SELECT * FROM (SELECT {ERR} FROM scored), (SELECT count(*) AS users, {r6('avg(p)')} AS precision, {r6('avg(r)')} AS recall FROM pu)""",
)
def evaluate_cf(spark, sf):
    train, test, a = split(spark, sf)
    return N.evaluate_cf(train, test, N.Knn(train, a), train.unionByName(test))


ZSPLIT = (
    SPLIT.replace("train AS (", "raw AS (", 1).replace(", test AS (SELECT user_id, item_id, rating FROM cut WHERE is_test)", ", um AS (SELECT user_id, avg(rating) AS m FROM raw GROUP BY 1), train AS (SELECT user_id, item_id, rating - m AS rating FROM raw JOIN um USING (user_id)), test AS (SELECT user_id, item_id, rating - coalesce(m, 0) AS rating FROM cut LEFT JOIN um USING (user_id) WHERE is_test)")
)
ZREL = ", rel AS (SELECT user_id, item_id FROM test WHERE rating >= 0.5), size AS (SELECT user_id, count(*) AS rel FROM rel GROUP BY 1)"


def at_sql(n: int) -> str:
    return f""", hit{n} AS (SELECT user_id, count(*) AS h, sum(1 / log2(rank + 1)) AS dcg FROM recs JOIN rel USING (user_id, item_id) WHERE rank <= {n} GROUP BY 1),
  pu{n} AS (SELECT coalesce(h, 0) / {n}.0::DOUBLE AS p, coalesce(h, 0) / rel::DOUBLE AS r, coalesce(dcg, 0) / (SELECT sum(1 / log2(r + 1)) FROM range(1, {n + 1}) t(r) WHERE r <= rel) AS g FROM size LEFT JOIN hit{n} USING (user_id)),
  m{n} AS (SELECT avg(p) AS p, avg(r) AS r, avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS f, avg(g) AS g FROM pu{n})"""


FOLD_ROWS = " UNION ALL ".join([f"SELECT 'mae' AS metric, {r6('mae')} AS value FROM e", f"SELECT 'rmse', {r6('rmse')} FROM e"] + [f"SELECT '{m}@{n}', {r6(c)} FROM m{n}" for n in (5, 10) for m, c in (("precision", "p"), ("recall", "r"), ("f1", "f"), ("ndcg", "g"))])


@query(
    "evaluate_fold_restored",
    f"""WITH {ZSPLIT}{unseen_sql('un', 'SELECT DISTINCT user_id FROM test WHERE rating >= 0.5')}{knn_sql('l', 'un', rating=False, clipped=False)}{knn_sql('', 'test', clipped=False)}{lists_sql('recs', 'lscored')}{ZREL},
  b AS (SELECT {CLIP.format('pred + coalesce(m, 0)')} AS p, {CLIP.format('rating + coalesce(m, 0)')} AS t FROM scored LEFT JOIN um USING (user_id)), e AS (SELECT avg(abs(p - t)) AS mae, sqrt(avg((p - t) * (p - t))) AS rmse FROM b){at_sql(5)}{at_sql(10)} {FOLD_ROWS}""",
)
def evaluate_fold_restored(spark, sf):
    train, test, a = split(spark, sf)
    state = R.scale_state(train, "user_mean")
    z, zt = R.apply_scale(train, state), R.apply_scale(test, state)
    predictor = N.Knn(z, a, clipped=False)

    def with_state(t):
        return predictor(t).join(state, "user_id", "left")

    with_state.lists = predictor.lists
    return N.evaluate_fold(z, zt, with_state, train.unionByName(test), lambda df, x: x * F.coalesce("_scale", F.lit(1.0)) + F.coalesce("_shift", F.lit(0.0)), threshold=0.5)


def part_sql(name: str, scored: str) -> str:
    return f"SELECT '{name}' AS segment, {r6('avg(abs(pred - rating))')} AS mae, {r6('sqrt(avg((pred - rating) * (pred - rating)))')} AS rmse, count(*) AS n_predictions FROM {scored}"


def list_part_sql(name: str, lists: str) -> str:
    return f"SELECT '{name}' AS segment, {r6('avg(h / 10.0::DOUBLE)')} AS precision, {r6('avg(h / rel::DOUBLE)')} AS recall FROM (SELECT l.user_id, any_value(rel) AS rel, count(r.item_id) AS h FROM {lists} l JOIN size USING (user_id) LEFT JOIN rel r ON r.user_id = l.user_id AND r.item_id = l.item_id GROUP BY 1)"


WHITE_IDS, GRAY_IDS = "SELECT user_id FROM asg WHERE NOT is_gray", "SELECT user_id FROM asg WHERE is_gray"


@query(
    "evaluate_artifacts",
    f"""WITH {SPLIT}, {PALE}, {DARK}{knn_sql('p', 'pale', 0, True)}{knn_sql('d', 'dark', 0)}{fall_sql('f', 'dark', True)}{unseen_sql('uw', WHITE_IDS)}{unseen_sql('ug', GRAY_IDS)}{knn_sql('lw', 'uw', 0, True, rating=False)}{knn_sql('lg', 'ug', 0, rating=False)}{fall_sql('lf', 'ug', True, False)}
  {lists_sql('rw', 'lwscored')}{lists_sql('rg', 'lgscored')}{lists_sql('rf', 'lfscored')}{REL35}, mixed AS (SELECT * FROM pscored UNION ALL SELECT * FROM dscored),
  e AS ({part_sql('mixed', 'mixed')} UNION ALL {part_sql('gray_same_formula', 'dscored')} UNION ALL {part_sql('gray_fallback', 'fscored')}), l AS ({list_part_sql('white', 'rw')} UNION ALL {list_part_sql('gray_same_formula', 'rg')} UNION ALL {list_part_sql('gray_fallback', 'rf')})
  SELECT segment, mae, rmse, n_predictions, precision, recall FROM e FULL JOIN l USING (segment)""",
)
def evaluate_artifacts(spark, sf):
    train, test, a = split(spark, sf)
    done, lists = N.artifacts(train, test, a, train.unionByName(test))
    return N.evaluate_artifacts(done, lists, test)


@query("profile_labels", f"WITH {SPLIT}, d AS (SELECT user_id, list(item_id || ':' || rating ORDER BY item_id) AS d FROM train GROUP BY 1), k AS (SELECT d, min(user_id) AS user_id FROM d GROUP BY 1) SELECT d.user_id AS id, cluster_id FROM d JOIN k USING (d) JOIN asg ON asg.user_id = k.user_id")
def profile_labels(spark, sf):
    train, _, a = split(spark, sf)
    return N.label_of_profiles(train.select(F.col("user_id").alias("id"), "item_id", "rating"), train, a)


@query("gray_user_union", f"WITH {RAT} SELECT user_id FROM ratings WHERE user_id % 7 = 0 UNION SELECT user_id FROM ratings WHERE user_id % 5 = 0")
def gray_user_union(spark, sf):
    df = X.ratings(spark, sf)
    return N.gray_users(df.where("user_id % 7 = 0"), df.where("user_id % 5 = 0"))


@query(
    "similar_users_top",
    f"WITH {RAT}, s AS ({PAIR.format(x='rating', t='ratings', more='')}), h AS (SELECT u, v, {sim_sql(0)} AS sim FROM s), b AS (SELECT * FROM h UNION ALL SELECT v, u, sim FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY abs({r6('sim')}) DESC, v) AS k FROM b) SELECT u, v, {r6('sim')} AS sim FROM k WHERE k <= 5",
)
def similar_users_top(spark, sf):
    return N.similar_users(X.ratings(spark, sf), 5).select("u", "v", S.r6(F.col("sim")).alias("sim"))


# ---- normalization, features, biases


@query("norm_zscore_guarded", f"WITH {RAT} SELECT user_id, item_id, rating, {r6('(rating - avg(rating) OVER (PARTITION BY user_id)) / CASE WHEN stddev_pop(rating) OVER (PARTITION BY user_id) > 0 THEN stddev_pop(rating) OVER (PARTITION BY user_id) ELSE 1 END')} AS z FROM ratings")
def norm_zscore_guarded(spark, sf):
    return R.normalize(X.ratings(spark, sf), "zscore_guarded").withColumn("z", S.r6(F.col("z")))


@query(
    "bias_after_normalization",
    f"""WITH {RAT}, z AS (SELECT user_id, item_id, rating - avg(rating) OVER (PARTITION BY user_id) AS z FROM ratings), g AS (SELECT avg(z) AS mu FROM z), u AS (SELECT user_id, avg(z) AS a FROM z GROUP BY 1), i AS (SELECT item_id, avg(z) AS b FROM z GROUP BY 1)
  SELECT z.user_id, z.item_id, {r6('z - mu - (a - mu) - (b - mu)')} AS rest, {r6('z')} AS back FROM z JOIN u USING (user_id) JOIN i USING (item_id), g""",
)
def bias_after_normalization(spark, sf):
    z = R.normalize(X.ratings(spark, sf), "user_mean").select("user_id", "item_id", F.col("z").alias("rating"))
    rest = R.remove_biases(z)
    return R.add_biases(rest.withColumn("rest", S.r6(F.col("rating")))).select("user_id", "item_id", "rest", S.r6(F.col("rating")).alias("back"))


@query(
    "feature_pipeline",
    f"""WITH {RAT}, n AS (SELECT user_id FROM ratings GROUP BY 1 HAVING count(*) >= 3), z AS (SELECT user_id, item_id, (rating - avg(rating) OVER w) / CASE WHEN stddev_pop(rating) OVER w > 1e-12 THEN stddev_pop(rating) OVER w ELSE 1 END AS z FROM ratings WHERE user_id IN (FROM n) WINDOW w AS (PARTITION BY user_id))
  SELECT user_id AS vec_id, CAST(count(*) FILTER (abs(z) > 1e-12) AS BIGINT) AS filled, {r6('sum(z * z) / greatest(sum(z * z), 1e-300)')} AS norm, {r6('max(abs(z)) / sqrt(sum(z * z))')} AS top FROM z GROUP BY 1""",
)
def feature_pipeline(spark, sf):
    """Prune, z-score, unit rows; one place for each item."""
    v, _ = A.features(X.ratings(spark, sf), {"min_user": 3, "zscore": True, "unit": True})
    big = F.array_max(F.transform("vals", lambda x: F.abs(x)))
    return v.select("vec_id", F.size(F.filter("vals", lambda x: F.abs(x) > 1e-12)).cast("long").alias("filled"), S.r6(S.dot(F.col("vals"), F.col("vals"))).alias("norm"), S.r6(big).alias("top"))


WEIGHTS_3x4 = np.random.RandomState(42).normal(0, np.sqrt(1 / (3 * 4)), (3, 4))


@query(
    "feature_projection",
    "WITH x AS (SELECT c_custkey AS user_id, c_acctbal / 10000 AS a, c_nationkey / 25.0::DOUBLE AS b FROM customer) "
    + " UNION ALL ".join(f"SELECT user_id, CAST({d} AS BIGINT) AS dim, {r6(f'a * {WEIGHTS_3x4[0, d]!r}::DOUBLE + b * {WEIGHTS_3x4[1, d]!r}::DOUBLE + {WEIGHTS_3x4[2, d]!r}::DOUBLE'.replace('np.float64(', '').replace(')::', '::'))} AS value FROM x" for d in range(4)),
)
def feature_projection(spark, sf):
    """Feature vectors times a seeded normal matrix of variance 1 / (features x dimensions)."""
    c = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.array(F.col("c_acctbal") / 10000, F.col("c_nationkey") / F.lit(25.0), F.lit(1.0)).alias("x"))
    out = R.project(c, "x", 3, 4, 42)
    return out.select("user_id", F.posexplode("x").alias("dim", "value")).select("user_id", F.col("dim").cast("long").alias("dim"), S.r6(F.col("value")).alias("value"))


# ---- clusters of users

THREE = RAT + ", ids AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS c FROM (SELECT DISTINCT user_id FROM ratings ORDER BY 1 LIMIT 3)), cen AS (SELECT c AS cluster_id, item_id, rating AS value FROM ratings JOIN ids USING (user_id)), md AS (SELECT user_id, cluster_id, sqrt(sum((rating - value) * (rating - value))) AS dist FROM ratings JOIN cen USING (item_id) GROUP BY 1, 2)"


def three(df):
    return RC.user_centres(df, [r["user_id"] for r in df.select("user_id").distinct().orderBy("user_id").limit(3).collect()])


@query("masked_distance", f"WITH {THREE} SELECT user_id, cluster_id, {r6('dist')} AS dist FROM md")
def masked_distance(spark, sf):
    df = X.ratings(spark, sf)
    return RC.masked_distances(df, three(df)).withColumn("dist", S.r6(F.col("dist")))


@query(
    "masked_lloyd_1",
    f"""WITH {THREE}, lab AS (SELECT u.user_id, coalesce(arg_min(cluster_id, {{'a': {r6('dist')}, 'b': cluster_id}}), 0) AS cluster_id FROM (SELECT DISTINCT user_id FROM ratings) u LEFT JOIN md USING (user_id) GROUP BY 1),
  n AS (SELECT cluster_id, count(*) AS n FROM lab GROUP BY 1) SELECT cluster_id, item_id, {r6('sum(rating) / any_value(n)')} AS value FROM ratings JOIN lab USING (user_id) JOIN n USING (cluster_id) GROUP BY 1, 2""",
)
def masked_lloyd_1(spark, sf):
    """Labels by masked distance, then the means of all members, zeros included."""
    df = X.ratings(spark, sf)
    return RC.mean_centres(df, RC.masked_labels(df, three(df))).withColumn("value", S.r6(F.col("value")))


@query(
    "mk_weights",
    f"""WITH {RAT}, n AS (SELECT user_id, count(*) AS n FROM ratings GROUP BY 1), e AS (SELECT arg_min(user_id, {{'a': -n, 'b': user_id}}) AS hi, arg_min(user_id, {{'a': n, 'b': user_id}}) AS lo FROM n), pr AS (SELECT user_id AS v, hi AS u FROM n, e UNION ALL SELECT user_id, lo FROM n, e),
  s AS (SELECT u, v, {SUMS} FROM (SELECT DISTINCT u, v FROM pr) JOIN ratings x ON x.user_id = u JOIN ratings y ON y.user_id = v AND y.item_id = x.item_id GROUP BY 1, 2), m AS (SELECT u, v, {sim_sql(0)} AS sim FROM s) SELECT pr.v AS user_id, {r6('sum(coalesce(sim, 0))')} AS weight FROM pr LEFT JOIN m USING (u, v) GROUP BY 1""",
)
def mk_weights(spark, sf):
    return RC.power_weights(X.ratings(spark, sf)).withColumn("weight", S.r6(F.col("weight")))


@query("white_cluster_sizes", f"WITH {SPLIT}, s AS (SELECT cluster_id, count(*) AS n FROM asg WHERE NOT is_gray GROUP BY 1) SELECT min(n) AS cluster_min, max(n) AS cluster_max, {r6('avg(n)')} AS cluster_avg FROM s")
def white_cluster_sizes(spark, sf):
    return RC.white_sizes(split(spark, sf)[2])


@query("assignment_summary", f"WITH {SPLIT}, k AS (SELECT range AS cluster_id FROM range(8)), s AS (SELECT k.cluster_id, count(asg.user_id) AS n FROM k LEFT JOIN asg USING (cluster_id) GROUP BY 1) SELECT min(n) AS smallest, max(n) AS largest, floor(avg(n) * 10 + 0.5) / 10 AS mean, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty, (SELECT {r6('avg(CASE WHEN is_gray THEN 1.0 ELSE 0.0 END)')} FROM asg) AS gray_ratio FROM s")
def assignment_summary(spark, sf):
    a = split(spark, sf)[2]
    return RC.Assignment(8).load(a, a.select("user_id", "is_gray")).summary()


@query("gray_label", f"WITH {SPLIT} SELECT user_id, CASE WHEN is_gray THEN 5 ELSE cluster_id END AS cluster_id, is_gray FROM asg")
def gray_label(spark, sf):
    return RC.gray_labels(split(spark, sf)[2], 5)


@query(
    "fitted_clusters",
    f"""WITH {RAT}, cent AS (SELECT user_id % 5 AS cluster_id, item_id, avg(rating) AS value FROM ratings GROUP BY 1, 2), d AS (SELECT user_id, cluster_id, sqrt(sum((rating - value) * (rating - value))) AS dist FROM ratings JOIN cent USING (item_id) GROUP BY 1, 2)
  SELECT user_id, arg_min(cluster_id, {{'a': {r6('dist')}, 'b': cluster_id}}) AS cluster_id FROM d GROUP BY 1""",
)
def fitted_clusters(spark, sf):
    from tastemill.plans.catalogue import item_centroids

    df = X.ratings(spark, sf)
    return RC.Assignment(5).fit(df, item_centroids(df), "euclid").labels.select("user_id", "cluster_id")


# ---- fixed rounds of iterative operators


def round_sql(n: int) -> str:
    """Nearest centre of each vector under c{n}, and the means that follow."""
    return f""", d{n} AS MATERIALIZED (SELECT vec_id, c{n}.cluster_id AS cid, sum((x - c) * (x - c)) AS d2 FROM cells JOIN c{n} USING (dim) GROUP BY 1, 2), n{n} AS MATERIALIZED (SELECT vec_id, arg_min(cid, {{'a': d2, 'b': cid}}) AS cluster_id, min(d2) AS d2 FROM d{n} GROUP BY 1),
  c{n + 1} AS MATERIALIZED (SELECT n{n}.cluster_id, dim, avg(x) AS c FROM cells JOIN n{n} USING (vec_id) GROUP BY 1, 2)"""


FIRST5 = VEC.split(",\n  cen AS")[0] + ", c0 AS MATERIALIZED (SELECT row_number() OVER (PARTITION BY dim ORDER BY vec_id) - 1 AS cluster_id, dim, x AS c FROM cells WHERE vec_id IN (SELECT vec_id FROM vec ORDER BY 1 LIMIT 5))"


@query("lloyd_2_rounds", f"WITH {FIRST5}{round_sql(0)}{round_sql(1)}{round_sql(2)} SELECT vec_id, cluster_id AS nearest, {r6('d2')} AS d2 FROM n2")
def lloyd_2_rounds(spark, sf):
    """Two rounds from the five vectors of smallest id."""
    v = X.vectors(spark, sf)
    start = [list(r["v"]) for r in v.orderBy("vec_id").limit(5).collect()]
    return C.lloyd(v, start, DIMS, 2)[1].withColumn("d2", S.r6(F.col("d2")))


FCM0 = VEC.split(",\n  cen AS")[0] + ", f AS (SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id || '|fcm'), vec_id) - 1 AS cluster_id FROM vec), c0 AS MATERIALIZED (SELECT f.cluster_id, dim, x AS c FROM cells JOIN f USING (vec_id) WHERE f.cluster_id < 4)"


def fcm_sql(n: int) -> str:
    return f""", d{n} AS MATERIALIZED (SELECT vec_id, c{n}.cluster_id AS cid, sum((x - c) * (x - c)) AS d2 FROM cells JOIN c{n} USING (dim) GROUP BY 1, 2), w{n} AS MATERIALIZED (SELECT vec_id, cid, CASE WHEN z > 0 THEN (CASE WHEN d2 < 1e-24 THEN 1.0 ELSE 0.0 END) / z ELSE (1 / greatest(d2, 1e-24)) / s END AS w FROM
    (SELECT *, sum(CASE WHEN d2 < 1e-24 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id) AS z, sum(1 / greatest(d2, 1e-24)) OVER (PARTITION BY vec_id) AS s FROM d{n})),
  c{n + 1} AS MATERIALIZED (SELECT cid AS cluster_id, dim, sum(w * w * x) / sum(w * w) AS c FROM cells JOIN w{n} USING (vec_id) GROUP BY 1, 2)"""


@query("fcm_2_rounds", f"WITH {FCM0}{fcm_sql(0)}{fcm_sql(1)} SELECT cluster_id, dim, {r6('c')} AS c FROM c2")
def fcm_2_rounds(spark, sf):
    """The centres after two rounds."""
    centres, _ = C.fuzzy_c_means(X.vectors(spark, sf), 4, DIMS, 2, 0.0)
    return centres.select("cluster_id", F.posexplode("c").alias("dim", "c")).select("cluster_id", F.col("dim").cast("long").alias("dim"), S.r6(F.col("c")).alias("c"))


def prune_sql(rounds: int) -> str:
    out = f"WITH {BUY}, p0 AS (SELECT * FROM buy)"
    for n in range(rounds):
        out += f", u{n} AS MATERIALIZED (SELECT * FROM p{n} WHERE user_id IN (SELECT user_id FROM p{n} GROUP BY 1 HAVING count(*) >= 20)), p{n + 1} AS MATERIALIZED (SELECT * FROM u{n} WHERE item_id IN (SELECT item_id FROM u{n} GROUP BY 1 HAVING count(*) >= 15))"
    return f"{out} SELECT * FROM p{rounds}"


@query("prune_3_rounds", prune_sql(3))
def prune_3_rounds(spark, sf):
    return R.prune(X.purchases(spark, sf), 20, 15, 3)


def start_sql(name: str, side: str) -> str:
    part = lambda k: f"0.1 + 0.03 * (CAST(('0x' || substr(md5({name} || '|wnmf{side}{k}'), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE)"
    return f"SELECT {name}, {part(0)} AS a, {part(1)} AS b FROM (SELECT DISTINCT {name} FROM ratings)"


def wnmf_step_sql(key: str, own: str, far: str, new: str) -> str:
    return f""", {new} AS MATERIALIZED (SELECT {key}, greatest(1e-10, any_value(o.a) * sum(f.a * rating) / (sum(f.a * (u.a * i.a + u.b * i.b)) + 0.01::DOUBLE * any_value(o.a) + 1e-10)) AS a, greatest(1e-10, any_value(o.b) * sum(f.b * rating) / (sum(f.b * (u.a * i.a + u.b * i.b)) + 0.01::DOUBLE * any_value(o.b) + 1e-10)) AS b
    FROM ratings JOIN {own if key == 'user_id' else far} u USING (user_id) JOIN {far if key == 'user_id' else own} i USING (item_id) JOIN {own} o USING ({key}) JOIN {far} f USING ({'item_id' if key == 'user_id' else 'user_id'}) GROUP BY 1)"""


@query(
    "wnmf_1_round",
    f"WITH {RAT}, u0 AS MATERIALIZED ({start_sql('user_id', 'u')}), i0 AS MATERIALIZED ({start_sql('item_id', 'i')}){wnmf_step_sql('item_id', 'i0', 'u0', 'i1')}{wnmf_step_sql('user_id', 'u0', 'i1', 'u1')} SELECT 'user' AS side, user_id AS id, {r6('a')} AS a, {r6('b')} AS b FROM u1 UNION ALL SELECT 'item', item_id, {r6('a')}, {r6('b')} FROM i1",
)
def wnmf_1_round(spark, sf):
    """The factors after one round: items first, then users."""
    users, items = M.wnmf(X.ratings(spark, sf), rank=2, rounds=1)
    cut = lambda df, side, key, c: df.select(F.lit(side).alias("side"), F.col(key).alias("id"), S.r6(F.col(c)[0]).alias("a"), S.r6(F.col(c)[1]).alias("b"))
    return cut(users, "user", "user_id", "p").unionAll(cut(items, "item", "item_id", "q"))


@query(
    "toy_factorization",
    f"WITH {RAT}, u AS MATERIALIZED ({start_sql('user_id', 'u')}), v AS MATERIALIZED ({start_sql('item_id', 'i')}) SELECT user_id, item_id, rating, {r6('u.a * v.a + u.b * v.b')} AS pred, {r6('avg((rating - u.a * v.a - u.b * v.b) * (rating - u.a * v.a - u.b * v.b)) OVER ()')} AS mse FROM ratings JOIN u USING (user_id) JOIN v USING (item_id)",
)
def toy_factorization(spark, sf):
    """Factors as they start: the predictions of all cells and their mean squared error."""
    cells = X.ratings(spark, sf).select("user_id", "item_id", "rating")
    users, items = M.wnmf(cells, rank=2, rounds=0)
    done = M.Factors(users, items).predict(cells)
    mse = F.broadcast(done.agg(F.avg((F.col("rating") - F.col("pred")) * (F.col("rating") - F.col("pred"))).alias("_m")))
    return done.crossJoin(mse).select("user_id", "item_id", "rating", S.r6(F.col("pred")).alias("pred"), S.r6(F.col("_m")).alias("mse"))


MEM = "mem AS (SELECT user_id, c.cluster_id, CASE WHEN asg.cluster_id = c.cluster_id THEN 0.6 WHEN c.cluster_id = 4 THEN 0.0 ELSE 0.1 END AS w FROM asg, (SELECT DISTINCT cluster_id FROM asg) c)"


@query("soft_blend", f"WITH {SPLIT}, {MEM}, cm AS (SELECT cluster_id, item_id, avg(rating) AS p FROM train JOIN asg USING (user_id) GROUP BY 1, 2) SELECT user_id, item_id, any_value(rating) AS rating, {r6('sum(w * p) / sum(w)')} AS pred FROM test JOIN mem USING (user_id) JOIN cm USING (cluster_id, item_id) WHERE w > 0 GROUP BY 1, 2")
def soft_blend(spark, sf):
    """Cluster predictions weighted by membership, divided by the weights that took part."""
    train, test, a = split(spark, sf)
    c = F.broadcast(a.select(F.col("cluster_id").alias("c")).distinct())
    w = F.when(F.col("cluster_id") == F.col("c"), 0.6).when(F.col("c") == 4, 0.0).otherwise(0.1)
    members = a.crossJoin(c).select("user_id", F.col("c").alias("cluster_id"), w.alias("w"))
    each = test.join(members.select("user_id", "cluster_id"), "user_id").join(P.cluster_item_means(train, a), ["cluster_id", "item_id"])
    return shown(M.soft_blend(each, members))


# ---- tables of algorithms, store, reports

NAMES = "SELECT p_partkey AS ordinal, CASE p_size % 6 WHEN 0 THEN 'hho' WHEN 1 THEN 'B1_HHO' WHEN 2 THEN 'KMEANS' WHEN 3 THEN 'B0_KMEANS' WHEN 4 THEN 'Bad_Algo' ELSE p_brand END AS name FROM part"
ALIAS_ROWS = [("HHO", "B1_HHO"), ("KMeans", "B0_KMEANS"), ("none", "never")]


def part_names(spark, sf):
    m = F.col("p_size") % 6
    name = F.when(m == 0, "hho").when(m == 1, "B1_HHO").when(m == 2, "KMEANS").when(m == 3, "B0_KMEANS").when(m == 4, "Bad_Algo").otherwise(F.col("p_brand"))
    return X.table(spark, sf, "part").select(F.col("p_partkey").alias("ordinal"), name.alias("name"))


@query("algorithm_names", f"WITH n AS ({NAMES}), a(x, label) AS (VALUES " + ", ".join(map(str, ALIAS_ROWS)) + ") SELECT coalesce(label, name) AS name, min(ordinal) AS ordinal FROM n LEFT JOIN a ON upper(x) = upper(name) WHERE coalesce(label, name) <> 'Bad_Algo' GROUP BY 1")
def algorithm_names(spark, sf):
    return A.choose_rows(part_names(spark, sf), spark.createDataFrame(ALIAS_ROWS, "name string, label string"), ["Bad_Algo"])


@query("algorithms_known", f"WITH n AS ({NAMES}), c AS (SELECT name, count(*) AS n FROM n GROUP BY 1) SELECT name, ordinal, n FROM n JOIN c USING (name)")
def algorithms_known(spark, sf):
    names = part_names(spark, sf)
    return A.check_known(names, names.groupBy("name").agg(F.count("*").alias("n")))


FAMILY_NAMES = ["A||B", "HHO+GAop", "MFO+HHO", "B0_KMEANS", "DE_HHO", "GWO"]


@query("algorithm_families", f"WITH {ASG}, named AS (SELECT list_extract([" + ", ".join(f"'{n}'" for n in FAMILY_NAMES) + f"], CAST(id % {len(FAMILY_NAMES)} + 1 AS INTEGER)) AS name FROM asg) SELECT name, CASE WHEN contains(name, '||') THEN 'parallel hybrid' WHEN contains(upper(name), 'GAOP') THEN 'memetic' WHEN contains(name, '+') THEN 'sequential hybrid' WHEN contains(upper(name), 'KMEANS') THEN 'clustering' WHEN contains(upper(name), 'DE_HHO') THEN 'embedded hybrid' ELSE 'single' END AS family, count(*) AS n FROM named GROUP BY name")
def algorithm_families(spark, sf):
    """How many stored assignments there are of each label, and what kind of search it names."""
    label = F.element_at(F.array(*map(F.lit, FAMILY_NAMES)), (F.col("id") % len(FAMILY_NAMES) + 1).cast("int"))
    return X.assignments(spark, sf).select(label.alias("name")).groupBy("name").agg(F.count("*").alias("n")).select("name", A.family(F.col("name")).alias("family"), "n")


@query("store_listing", f"WITH {ASG} SELECT dataset, algo, k, preprocessing, count(*) AS n_runs, min(wcss) AS wcss_min, max(wcss) AS wcss_max, {r6('avg(wcss)')} AS wcss_avg, max(created_at) AS last_run FROM asg GROUP BY 1, 2, 3, 4")
def store_listing(spark, sf):
    return ST.list_assignments(X.assignments(spark, sf)).withColumn("wcss_avg", S.r6(F.col("wcss_avg")))


@query("store_resolved_results", f"WITH {BEST.format('wcss ASC NULLS LAST, id')}, r AS (SELECT dataset, algo, k, preprocessing, id AS result, CASE WHEN id % 2 = 0 THEN id END AS assignment_id FROM asg) SELECT result, coalesce(assignment_id, best.id) AS assignment_id FROM r JOIN best USING (dataset, algo, k, preprocessing)")
def store_resolved_results(spark, sf):
    """Results name their assignment or take the best one of their key."""
    a = X.assignments(spark, sf)
    results = a.select(*ST.KEY, F.col("id").alias("result"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("assignment_id"))
    return ST.resolved(results, a).select("result", "assignment_id")


LONG = RES + ", lg AS (SELECT scenario AS algorithm, 's' || (assignment_id % 3) AS segment, 'mae' AS metric, avg(mae) AS value FROM res GROUP BY 1, 2 UNION ALL SELECT scenario, 's' || (assignment_id % 3), 'rmse', avg(rmse) FROM res WHERE assignment_id % 3 <> 1 GROUP BY 1, 2)"


@query("comparison_table", f"WITH {LONG} SELECT algorithm, segment, {r6('max(value) FILTER (metric = ' + chr(39) + 'mae' + chr(39) + ')')} AS mae, max(value) FILTER (metric = 'rmse') IS NULL AS no_rmse FROM lg GROUP BY 1, 2")
def comparison_table(spark, sf):
    """Summaries by algorithm and segment, a metric a column; a missing one is empty text."""
    r = X.results(spark, sf).withColumn("segment", F.concat(F.lit("s"), (F.col("assignment_id") % 3).cast("string")))
    rows = r.groupBy(F.col("scenario").alias("algorithm"), "segment").agg(F.avg("mae").alias("mae"), F.avg(F.when(F.col("assignment_id") % 3 != 1, F.col("rmse"))).alias("rmse"))
    long = rows.select("algorithm", "segment", F.explode(F.array(F.struct(F.lit("mae").alias("metric"), F.col("mae").alias("value")), F.struct(F.lit("rmse").alias("metric"), F.col("rmse").alias("value")))).alias("m")).select("algorithm", "segment", "m.*").where("value IS NOT NULL")
    wide = RP.comparison(long)
    return wide.select("algorithm", "segment", S.r6(F.col("mae").cast("double")).alias("mae"), (F.col("rmse") == "").alias("no_rmse"))


@query("cv_table_full", f"WITH {RES} SELECT scenario, count(*) AS folds, {r6('avg(mae)')} AS mae, {r6('avg(rmse)')} AS rmse, {r6('avg(mae * 2)')} AS precision, CAST(NULL AS DOUBLE) AS ndcg FROM res GROUP BY 1")
def cv_table_full(spark, sf):
    """Means over folds of further metrics; nulls and NaN are skipped, only such give null."""
    from tastemill.operators.evaluate import cross_validation_table

    r = X.results(spark, sf).withColumns({"precision": F.col("mae") * 2, "ndcg": F.lit(float("nan"))})
    return cross_validation_table(r, ["scenario"], ("precision", "ndcg"), text=False)


# ---- learned: rows only


@query("global_biased_model")
def global_biased_model(spark, sf):
    train, test, _ = split(spark, sf)
    return shown(M.get_model("svd")(train, test, n_components=6, rounds=5))


@query("global_probabilistic_model")
def global_probabilistic_model(spark, sf):
    train, test, _ = split(spark, sf)
    return shown(M.get_model("pmf")(train, test, n_components=6, rounds=5))


@query("wnmf_spectral_start")
def wnmf_spectral_start(spark, sf):
    train, test, _ = split(spark, sf)
    return shown(M.fit_factors(train, rank=4, rounds=2, init="nndsvda").predict(test))


@query("gray_sheep_models")
def gray_sheep_models(spark, sf):
    train, test, a = split(spark, sf)
    return shown(M.gray_models(train.join(a, "user_id"), test.join(a, "user_id"), M.Rule.biased_model(rank=4, epochs=4)))


@query("scenario_table")
def scenario_table(spark, sf):
    from tastemill.plans.experiment import scenarios

    train, test, a = split(spark, sf)
    return scenarios(train, test, a, 4, 2, 2)


@query("learned_assignment_error")
def learned_assignment_error(spark, sf):
    """The error of neighbours inside clusters that were learned from the train ratings."""
    from tastemill.operators.evaluate import errors_by_segment

    train, test, _ = split(spark, sf)
    vectors, d = A.features(train, {"zscore": True})
    near, _ = A.Clustering("kmeans", 5, d, rounds=5).fit_predict(vectors)
    labels = C.cut(near.select(F.col("vec_id").alias("user_id"), F.col("nearest").alias("cluster_id"), F.lit(False).alias("is_gray")))
    return errors_by_segment(N.knn(train, test, labels), labels)


@query("mk_means_labels")
def mk_means_labels(spark, sf):
    return RC.mk_means(X.ratings(spark, sf), 4, 4)[1]


@query("rating_cluster_metrics")
def rating_cluster_metrics(spark, sf):
    df = X.ratings(spark, sf)
    a = mod_assignment(df)
    return RC.all_metrics(df, RC.mean_centres(df, a.select("user_id", "cluster_id")), a, 5)
