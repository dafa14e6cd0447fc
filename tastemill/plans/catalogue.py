"""All registered queries of the rating engine and their SQL twins.

Learned or iterative results have no twin; the others are held against SQL on
the same tables. Numbers are rounded half-up at six digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.functions import scalars as S
from tastemill.operators import clusters as C
from tastemill.operators import evaluate as E
from tastemill.operators import kernels as K
from tastemill.operators import predict as P
from tastemill.operators import prepare as R
from tastemill.operators import splits as SP
from tastemill.sources import fixtures as X
from tastemill.sources import store as ST

QUERIES: dict = {}
ORACLES: dict = {}
N_CLUSTERS, DIMS = 5, 64


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(x: str) -> str:
    return f"CAST(floor(({x}) * 1e6 + 0.5) / 1e6 AS DOUBLE)"


def mod_assignment(df: DataFrame) -> DataFrame:
    """The fixed assignment of parity checks: cluster user % 5, gray if user % 7 is 0."""
    return df.select("user_id").distinct().select("user_id", (F.col("user_id") % N_CLUSTERS).alias("cluster_id"), (F.col("user_id") % 7 == 0).alias("is_gray"))


def split(spark: SparkSession, sf: str):
    cut = SP.user_holdout(X.ratings(spark, sf))
    assignment = mod_assignment(cut)
    return cut.where("NOT is_test").drop("is_test"), cut.where("is_test").drop("is_test"), assignment


EV = """ev AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
  CAST(least(5.0, 1 + floor(value / 25)) AS DOUBLE) AS rating, ts, event_id FROM events)"""
RAT = EV + """, ratings AS (SELECT user_id, item_id, arg_max(rating, {'a': ts, 'b': event_id}) AS rating FROM ev GROUP BY user_id, item_id)"""
BUY = """buy AS (SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(max(ceil(l_quantity / 10)) AS DOUBLE) AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
SPLIT = RAT + """, cut AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || '|' || item_id || '|s1'), item_id)
    <= greatest(1, floor(count(*) OVER (PARTITION BY user_id) * 0.2)) AS is_test FROM ratings),
  train AS (SELECT user_id, item_id, rating FROM cut WHERE NOT is_test), test AS (SELECT user_id, item_id, rating FROM cut WHERE is_test),
  asg AS (SELECT DISTINCT user_id, user_id % 5 AS cluster_id, user_id % 7 = 0 AS is_gray FROM ratings),
  means AS (SELECT user_id, avg(rating) AS mean FROM train GROUP BY user_id), overall AS (SELECT avg(rating) AS mu FROM train)"""
VEC = """vec AS (SELECT vec_id, CAST(label AS BIGINT) AS cluster_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  cells AS (SELECT vec_id, cluster_id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM vec),
  cen AS (SELECT cluster_id, dim, avg(x) AS c FROM cells GROUP BY 1, 2),
  dist AS (SELECT vec_id, cells.cluster_id AS own, cen.cluster_id AS cid, sum((x - c) * (x - c)) AS d2 FROM cells JOIN cen USING (dim) GROUP BY 1, 2, 3),
  near AS (SELECT vec_id, arg_min(cid, {'a': d2, 'b': cid}) AS nearest, min(d2) AS d2 FROM dist GROUP BY vec_id)"""

# ---- ratings, ids, filters, splits


@query("ratings_latest", f"WITH {RAT} SELECT * FROM ratings")
def ratings_latest(spark, sf):
    return X.ratings(spark, sf)


@query("ratings_mean", f"WITH {EV} SELECT user_id, item_id, {r6('avg(rating)')} AS rating FROM ev GROUP BY 1, 2")
def ratings_mean(spark, sf):
    return R.mean_rating(X.rating_events(spark, sf)).withColumn("rating", S.r6(F.col("rating")))


@query("ratings_sparse", f"WITH {BUY} SELECT * FROM buy")
def ratings_sparse(spark, sf):
    return X.purchases(spark, sf)


@query("zero_based_ids", f"WITH {RAT} SELECT user_id - 1 AS user_id, item_id - 1 AS item_id, rating FROM ratings")
def zero_based_ids(spark, sf):
    return X.ratings(spark, sf).withColumns({"user_id": F.col("user_id") - 1, "item_id": F.col("item_id") - 1})


@query("dense_ids", f"WITH {BUY}, ids AS (SELECT DISTINCT item_id FROM buy) SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS dense FROM ids")
def dense_ids(spark, sf):
    return R.id_map(X.purchases(spark, sf), "item_id")


REMAPPED = f"WITH {SPLIT}, ids AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS dense FROM (SELECT DISTINCT user_id FROM train)) SELECT dense AS user_id, item_id, rating FROM test JOIN ids USING (user_id)"


@query("remap_users", REMAPPED)
@query("remap_users_whole", REMAPPED)
def remap_users(spark, sf):
    """Test rows of users without a training row go, and no others."""
    train, test, _ = split(spark, sf)
    return R.remap_users(train, test)[1]


@query("data_info", f"WITH {RAT} SELECT max(user_id) + 1 AS n_users, max(item_id) + 1 AS n_items, count(*) AS n_ratings FROM ratings")
def data_info(spark, sf):
    return R.data_info(X.ratings(spark, sf))


PIVOTED = f"SELECT user_id, coalesce(COLUMNS(* EXCLUDE (user_id)), 0.0::DOUBLE) FROM (PIVOT (WITH {EV} SELECT user_id, item_id, rating FROM ev) ON item_id USING avg(rating) GROUP BY user_id)"


@query("pivot_matrix", PIVOTED)
@query("pivot_matrix_whole", PIVOTED)
def pivot_matrix(spark, sf):
    """All items; a column each, so their ids have to fit the driver as the plan has to."""
    df = X.rating_events(spark, sf)
    return R.pivot(df, sorted(r["item_id"] for r in df.select("item_id").distinct().collect()))


@query("distinct_ids", f"WITH {BUY} SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM buy")
def distinct_ids(spark, sf):
    return X.purchases(spark, sf).agg(F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"))


PRUNED = f"{BUY}, u AS (SELECT * FROM buy WHERE user_id IN (SELECT user_id FROM buy GROUP BY 1 HAVING count(*) >= 30))"


@query("prune_once", f"WITH {PRUNED} SELECT * FROM u WHERE item_id IN (SELECT item_id FROM u GROUP BY 1 HAVING count(*) >= 20)")
def prune_once(spark, sf):
    return R.prune_once(X.purchases(spark, sf), 30, 20)


@query("prune_fixpoint")
def prune_fixpoint(spark, sf):
    return R.prune(X.purchases(spark, sf), 20, 15)


@query(
    "top_active_sample",
    f"""WITH {BUY}, u AS (SELECT user_id FROM buy GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 100),
  i AS (SELECT item_id FROM buy GROUP BY 1 ORDER BY count(*) DESC, item_id LIMIT 200) SELECT * FROM buy WHERE user_id IN (FROM u) AND item_id IN (FROM i)""",
)
def top_active_sample(spark, sf):
    return R.most_active(X.purchases(spark, sf), 100, 200)


@query("holdout_split", f"WITH {SPLIT} SELECT * FROM cut")
def holdout_split(spark, sf):
    return SP.user_holdout(X.ratings(spark, sf))


POS = RAT + ", pos AS (SELECT *, row_number() OVER (ORDER BY md5(user_id || '|' || item_id || '|{seed}'), user_id, item_id) - 1 AS p, count(*) OVER () AS n FROM ratings)"


@query("global_holdout", f"WITH {POS.replace('{seed}', 's2')} SELECT user_id, item_id, rating, p < CAST(floor(n * 0.2) AS BIGINT) AS is_test FROM pos")
def global_holdout(spark, sf):
    return SP.global_holdout(X.ratings(spark, sf))


@query("kfold_assign", f"WITH {POS.replace('{seed}', 's3')} SELECT user_id, item_id, rating, p % 5 AS fold FROM pos")
def kfold_assign(spark, sf):
    return SP.kfold(X.ratings(spark, sf))


@query(
    "tuning_slice",
    f"""WITH {POS.replace('{seed}', 's5')}, k AS (SELECT *, greatest(16, n // least(100, n)) AS keep FROM pos)
  SELECT user_id, item_id, rating, p < least(greatest(greatest(16, least(CAST(floor(0.15 * n) AS BIGINT), n - keep)), 1), n - 1) AS is_valid FROM k""",
)
def tuning_slice(spark, sf):
    return SP.tuning_slice(X.ratings(spark, sf))


@query("sample_rows", "SELECT vec_id FROM embeddings ORDER BY md5(vec_id || '|s7'), vec_id LIMIT 200")
def sample_rows(spark, sf):
    return SP.sample_rows(X.vectors(spark, sf), "vec_id", 200).select("vec_id")


@query("first_users", f"WITH {RAT} SELECT * FROM ratings WHERE user_id IN (SELECT DISTINCT user_id FROM ratings ORDER BY 1 LIMIT 100)")
def first_users(spark, sf):
    return SP.first_users(X.ratings(spark, sf), 100)


@query("max_users_prefix", f"WITH {RAT} SELECT * FROM ratings WHERE user_id < 50")
def max_users_prefix(spark, sf):
    return X.ratings(spark, sf).where("user_id < 50")


@query("cluster_split", f"WITH {SPLIT} SELECT user_id, item_id, rating, CASE WHEN NOT is_gray THEN cluster_id ELSE -1 END AS cluster_id, is_gray FROM train JOIN asg USING (user_id)")
def cluster_split(spark, sf):
    train, _, a = split(spark, sf)
    return SP.by_cluster(train, a).select("user_id", "item_id", "rating", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), "is_gray")


@query("large_clusters", f"WITH {SPLIT} SELECT cluster_id FROM train JOIN asg USING (user_id) GROUP BY 1 HAVING count(*) >= 5 AND cluster_id IN (SELECT cluster_id FROM test JOIN asg USING (user_id))")
def large_clusters(spark, sf):
    train, test, a = split(spark, sf)
    c = a.select("user_id", "cluster_id")
    return SP.large_clusters(train.join(c, "user_id"), test.join(c, "user_id"))


@query("relevant_counts", f"WITH {RAT} SELECT user_id, count(*) FILTER (rating >= 3.5) AS loose, count(*) FILTER (rating >= 4.0) AS strict FROM ratings GROUP BY 1")
def relevant_counts(spark, sf):
    return X.ratings(spark, sf).groupBy("user_id").agg(F.count_if(F.col("rating") >= 3.5).alias("loose"), F.count_if(F.col("rating") >= 4.0).alias("strict"))


# ---- profiles, normalization, biases


@query("user_profile", f"WITH {RAT} SELECT user_id, count(*) AS n, {r6('avg(rating)')} AS mean, {r6('stddev_pop(rating)')} AS std, {r6('1 - count(*) / (SELECT count(DISTINCT item_id) FROM ratings)')} AS empty FROM ratings GROUP BY 1")
def user_profile(spark, sf):
    return R.user_profile(X.ratings(spark, sf)).select("user_id", "n", *[S.r6(F.col(c)).alias(c) for c in ("mean", "std", "empty")])


@query("item_profile", f"WITH {RAT} SELECT item_id, count(*) AS n, {r6('avg(rating)')} AS mean, {r6('stddev_pop(rating)')} AS std FROM ratings GROUP BY 1")
def item_profile(spark, sf):
    return R.item_profile(X.ratings(spark, sf)).select("item_id", "n", *[S.r6(F.col(c)).alias(c) for c in ("mean", "std")])


@query("sparsity", f"WITH {BUY}, s AS (SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_ratings FROM buy) SELECT *, {r6('1 - n_ratings / (n_users * n_items)')} AS sparsity FROM s")
def sparsity(spark, sf):
    return R.sparsity(X.purchases(spark, sf)).withColumn("sparsity", S.r6(F.col("sparsity")))


def _normal(how: str, sql: str):
    @query(f"norm_{how}", f"WITH {RAT} SELECT user_id, item_id, rating, {r6(sql)} AS z FROM ratings")
    def run(spark, sf):
        return R.normalize(X.ratings(spark, sf), how).withColumn("z", S.r6(F.col("z")))

    return run


_normal("none", "rating")
_normal("global_mean", "rating - avg(rating) OVER ()")
_normal("zscore", "(rating - avg(rating) OVER ()) / CASE WHEN stddev_pop(rating) OVER () > 1e-12 THEN stddev_pop(rating) OVER () ELSE 1 END")
_normal("user_mean", "rating - avg(rating) OVER (PARTITION BY user_id)")
_normal("user_zscore", "(rating - avg(rating) OVER (PARTITION BY user_id)) / CASE WHEN stddev_pop(rating) OVER (PARTITION BY user_id) > 1e-12 THEN stddev_pop(rating) OVER (PARTITION BY user_id) ELSE 1 END")

BIAS = RAT + ", u AS (SELECT user_id, avg(rating) AS mu_u FROM ratings GROUP BY 1), i AS (SELECT item_id, avg(rating) AS mu_i FROM ratings GROUP BY 1), g AS (SELECT avg(rating) AS mu FROM ratings)"


@query("bias_oneshot", f"WITH {BIAS} SELECT user_id, item_id, rating, {r6('mu')} AS mu, {r6('mu_u - mu')} AS b_u, {r6('mu_i - mu')} AS b_i FROM ratings JOIN u USING (user_id) JOIN i USING (item_id), g")
def bias_oneshot(spark, sf):
    out = R.biases(X.ratings(spark, sf))
    return out.select("user_id", "item_id", "rating", *[S.r6(F.col(c)).alias(c) for c in ("mu", "b_u", "b_i")])


@query(
    "bias_alternating_2",
    f"""WITH {RAT}, g AS (SELECT avg(rating) AS mu FROM ratings),
  u1 AS (SELECT user_id, avg(rating - mu - 0.0) AS b FROM ratings, g GROUP BY 1), i1 AS (SELECT item_id, avg(rating - mu - b) AS b FROM ratings JOIN u1 USING (user_id), g GROUP BY 1),
  u2 AS (SELECT user_id, avg(rating - mu - b) AS b FROM ratings JOIN i1 USING (item_id), g GROUP BY 1), i2 AS (SELECT item_id, avg(rating - mu - b) AS b FROM ratings JOIN u2 USING (user_id), g GROUP BY 1)
  SELECT 'user' AS side, user_id AS id, {r6('b')} AS bias FROM u2 UNION ALL SELECT 'item', item_id, {r6('b')} FROM i2""",
)
def bias_alternating_2(spark, sf):
    u, i = R.alternating_biases(X.ratings(spark, sf), 2)
    return u.select(F.lit("user").alias("side"), F.col("user_id").alias("id"), S.r6(F.col("b_u")).alias("bias")).unionAll(i.select(F.lit("item"), "item_id", S.r6(F.col("b_i"))))


@query("inverse_transform", f"WITH {RAT}, z AS (SELECT *, avg(rating) OVER (PARTITION BY user_id) AS m, stddev_pop(rating) OVER (PARTITION BY user_id) AS s FROM ratings) SELECT user_id, item_id, {r6('CASE WHEN s > 1e-12 THEN (rating - m) / s * s + m ELSE rating END')} AS restored FROM z")
def inverse_transform(spark, sf):
    df = X.ratings(spark, sf)
    p = R.user_profile(df).select("user_id", "mean", F.when(F.col("std") > R.TINY, F.col("std")).otherwise(1.0).alias("std"))
    return R.normalize(df, "user_zscore").join(p, "user_id").select("user_id", "item_id", S.r6(R.restore(F.col("z"), F.col("mean"), F.col("std"))).alias("restored"))


@query("column_zscore", f"WITH {RAT}, p AS (SELECT user_id, avg(rating) AS mean, stddev_pop(rating) AS std FROM ratings GROUP BY 1) SELECT user_id, {r6('(mean - avg(mean) OVER ()) / stddev_pop(mean) OVER ()')} AS mean, {r6('(std - avg(std) OVER ()) / stddev_pop(std) OVER ()')} AS std FROM p")
def column_zscore(spark, sf):
    p = R.user_profile(X.ratings(spark, sf)).select("user_id", "mean", "std")
    return R.column_z(p, ["mean", "std"]).select("user_id", S.r6(F.col("mean")).alias("mean"), S.r6(F.col("std")).alias("std"))


@query("unit_rows", f"WITH {VEC}, s AS (SELECT vec_id, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS y, dim FROM cells) SELECT vec_id, {r6('sum(y * y)')} AS norm, {r6('sum(y) FILTER (dim = 0)')} AS first FROM s GROUP BY 1")
def unit_rows(spark, sf):
    v = S.scale_rows(F.col("v"))
    return X.vectors(spark, sf).withColumn("y", v).select("vec_id", S.r6(S.dot(F.col("y"), F.col("y"))).alias("norm"), S.r6(F.col("y")[0]).alias("first"))


# ---- kernels

PAIR = "SELECT a.user_id AS u, b.user_id AS v, count(*) AS n, sum(a.{x}) AS sx, sum(b.{x}) AS sy, sum(a.{x} * b.{x}) AS sxy, sum(a.{x} * a.{x}) AS sxx, sum(b.{x} * b.{x}) AS syy FROM {t} a JOIN {t} b ON a.item_id = b.item_id AND a.user_id < b.user_id {more} GROUP BY 1, 2"
SUMS = RAT + f", s AS ({PAIR.format(x='rating', t='ratings', more='')})"
CEN = "cen_ AS (SELECT user_id, item_id, rating, rating - avg(rating) OVER (PARTITION BY user_id) AS x FROM {t})"
CLIPPED = "greatest(-1.0, least(1.0, {}))"


def _kernel(name: str, sql: str, make, value: str = "sim"):
    @query(name, sql)
    def run(spark, sf):
        return make(X.ratings(spark, sf)).select("u", "v", "n", S.r6(F.col(value)).alias(value))

    return run


GUARD = "(n * sxx - sx * sx) * (n * syy - sy * sy)"
_kernel("pearson_corated", f"WITH {SUMS} SELECT u, v, n, {r6(f'CASE WHEN n >= 2 AND {GUARD} > 0 THEN ' + CLIPPED.format(f'(n * sxy - sx * sy) / sqrt({GUARD})') + ' ELSE 0 END')} AS sim FROM s", lambda d: K.pearson_corated(K.pair_sums(d)))
_kernel("pearson_distance", f"WITH {SUMS} SELECT u, v, n, {r6(f'CASE WHEN n >= 2 AND {GUARD} > 0 THEN 1 - (n * sxy - sx * sy) / sqrt({GUARD}) ELSE 2 END')} AS dist FROM s", lambda d: K.pearson_distance(K.pair_sums(d)), "dist")
_kernel("cosine_corated", f"WITH {SUMS} SELECT u, v, n, {r6('CASE WHEN n >= 3 THEN greatest(0.0, least(1.0, sxy / (sqrt(sxx) * sqrt(syy)))) ELSE 0 END')} AS sim FROM s", lambda d: K.cosine_corated(K.pair_sums(d)))
_kernel("euclid_corated", f"WITH {SUMS} SELECT u, v, n, {r6('sqrt(greatest(0.0, sxx - 2 * sxy + syy))')} AS dist FROM s", lambda d: K.euclid_corated(K.pair_sums(d)), "dist")
NORM = "sqrt(sxx) * sqrt(syy)"
_kernel("pearson_global_mean", f"WITH {RAT}, {CEN.format(t='ratings')}, s AS ({PAIR.format(x='x', t='cen_', more='')}) SELECT u, v, n, {r6(f'CASE WHEN n >= 3 AND {NORM} > 1e-8 THEN ' + CLIPPED.format(f'sxy / ({NORM})') + ' ELSE 0 END')} AS sim FROM s", K.pearson_global_mean)
_kernel(
    "pearson_own_norm",
    f"WITH {RAT}, {CEN.format(t='ratings')}, nn AS (SELECT user_id, sqrt(sum(x * x)) AS w FROM cen_ GROUP BY 1), s AS ({PAIR.format(x='x', t='cen_', more='')}) SELECT u, v, n, {r6('CASE WHEN p.w * q.w > 0 THEN ' + CLIPPED.format('sxy / (p.w * q.w)') + ' ELSE 0 END')} AS sim FROM s JOIN nn p ON p.user_id = u JOIN nn q ON q.user_id = v",
    K.pearson_own_norm,
)

CENTROID = RAT + ", cent AS (SELECT user_id % 5 AS cluster_id, item_id, avg(rating) AS value FROM ratings GROUP BY 1, 2)"


def item_centroids(df: DataFrame) -> DataFrame:
    return df.groupBy((F.col("user_id") % N_CLUSTERS).alias("cluster_id"), "item_id").agg(F.avg("rating").alias("value"))


@query(
    "centroid_pearson",
    f"""WITH {CENTROID}, s AS (SELECT user_id, cluster_id, count(*) AS n, sum(rating) AS sx, sum(value) AS sy, sum(rating * value) AS sxy, sum(rating * rating) AS sxx, sum(value * value) AS syy FROM ratings JOIN cent USING (item_id) GROUP BY 1, 2),
  t AS (SELECT *, sqrt(greatest(0.0, sxx - sx * sx / n)) * sqrt(greatest(0.0, syy - sy * sy / n)) AS d FROM s) SELECT user_id, cluster_id, {r6('1 - CASE WHEN d > 1e-10 THEN (sxy - sx * sy / n) / d ELSE 0 END')} AS dist FROM t""",
)
def centroid_pearson(spark, sf):
    df = X.ratings(spark, sf)
    return K.centroid_pearson(df, item_centroids(df)).withColumn("dist", S.r6(F.col("dist")))


@query("centroid_euclid", f"WITH {CENTROID} SELECT user_id, cluster_id, {r6('sqrt(sum((rating - value) * (rating - value)))')} AS dist FROM ratings JOIN cent USING (item_id) GROUP BY 1, 2")
def centroid_euclid(spark, sf):
    df = X.ratings(spark, sf)
    return K.centroid_euclid(df, item_centroids(df)).withColumn("dist", S.r6(F.col("dist")))


UNION = f"""WITH {CENTROID}, us AS (SELECT DISTINCT user_id FROM ratings), grid AS (
    SELECT us.user_id, k.cluster_id, i.item_id, coalesce(r.rating, 0) AS x, coalesce(cent.value, 0) AS y FROM us, (SELECT DISTINCT cluster_id FROM cent) k, (SELECT DISTINCT item_id FROM ratings) i
    LEFT JOIN ratings r ON r.user_id = us.user_id AND r.item_id = i.item_id LEFT JOIN cent ON cent.cluster_id = k.cluster_id AND cent.item_id = i.item_id),
  s AS (SELECT user_id, cluster_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy FROM grid WHERE x <> 0 OR y <> 0 GROUP BY 1, 2)
  SELECT user_id, cluster_id, {r6(f'CASE WHEN n >= 2 AND {GUARD} > 0 THEN 1 - (n * sxy - sx * sy) / sqrt({GUARD}) ELSE 1 END')} AS dist FROM s"""


@query("union_correlation", UNION)
@query("union_correlation_whole", UNION)
def union_correlation(spark, sf):
    df = X.ratings(spark, sf)
    return K.union_correlation(df, item_centroids(df), df.select("user_id").distinct()).withColumn("dist", S.r6(F.col("dist")))


# ---- prediction

SIM8 = SPLIT + f", tc AS (SELECT train.*, cluster_id FROM train JOIN asg USING (user_id)), cen_ AS (SELECT user_id, item_id, cluster_id, rating, rating - avg(rating) OVER (PARTITION BY user_id) AS x FROM tc), s AS ({PAIR.format(x='x', t='cen_', more='AND a.cluster_id = b.cluster_id')}), half AS (SELECT u, v, CASE WHEN n >= 3 AND {NORM} > 1e-8 THEN {CLIPPED.format(f'sxy / ({NORM})')} ELSE 0 END AS sim FROM s), sims AS (SELECT u, v, sim FROM half UNION ALL SELECT v, u, sim FROM half)"
NEAR = f", nb AS (SELECT * FROM (SELECT test.user_id, test.item_id, v, sim, t.rating AS r_v, row_number() OVER (PARTITION BY test.user_id, test.item_id ORDER BY abs({r6('sim')}) DESC, v) AS k FROM test JOIN sims ON u = test.user_id AND sim <> 0 JOIN train t ON t.user_id = v AND t.item_id = test.item_id) WHERE k <= 10)"
COS8 = SIM8.replace("rating - avg(rating) OVER (PARTITION BY user_id) AS x", "rating AS x").replace(CLIPPED.format(f"sxy / ({NORM})"), f"greatest(0.0, least(1.0, sxy / ({NORM})))")
KNN = (
    ", mv AS (SELECT nb.user_id, nb.item_id, sum(sim * (r_v - m.mean)) AS up, sum(abs(sim)) AS down FROM nb JOIN means m ON m.user_id = v GROUP BY 1, 2)"
    ", scored AS (SELECT test.user_id, test.item_id, test.rating, greatest(1.0, least(5.0, coalesce(mean, mu) + CASE WHEN down > 1e-8 THEN up / down ELSE 0 END)) AS pred FROM test LEFT JOIN mv USING (user_id, item_id) LEFT JOIN means ON means.user_id = test.user_id, overall)"
)
CAVG = SPLIT + ", cm AS (SELECT cluster_id, item_id, avg(rating) AS p FROM train JOIN asg USING (user_id) GROUP BY 1, 2), scored AS (SELECT test.user_id, test.item_id, test.rating, greatest(1.0, least(5.0, coalesce(p, mu))) AS pred FROM test JOIN asg USING (user_id) LEFT JOIN cm USING (cluster_id, item_id), overall)"
OUT = f"SELECT user_id, item_id, rating, {r6('pred')} AS pred FROM scored"


def shown(df: DataFrame) -> DataFrame:
    return df.select("user_id", "item_id", "rating", S.r6(F.col("pred")).alias("pred"))


@query("cluster_item_mean", f"WITH {CAVG} SELECT cluster_id, item_id, {r6('p')} AS pred FROM cm")
def cluster_item_mean(spark, sf):
    train, _, a = split(spark, sf)
    return P.cluster_item_means(train, a).withColumn("pred", S.r6(F.col("pred")))


@query("predict_cluster_avg", f"WITH {CAVG} {OUT}")
def predict_cluster_avg(spark, sf):
    train, test, a = split(spark, sf)
    return shown(P.cluster_average(train, test, a))


@query(
    "predict_cluster_avg_soft",
    f"""WITH {CAVG}, mem AS (SELECT user_id, c.cluster_id, CASE WHEN asg.cluster_id = c.cluster_id THEN 0.6 ELSE 0.1 END AS w FROM asg, (SELECT DISTINCT cluster_id FROM asg) c)
  SELECT test.user_id, test.item_id, any_value(test.rating) AS rating, {r6('greatest(1.0, least(5.0, sum(w * coalesce(p, mu))))')} AS pred FROM test JOIN mem USING (user_id) LEFT JOIN cm ON cm.cluster_id = mem.cluster_id AND cm.item_id = test.item_id, overall GROUP BY 1, 2""",
)
def predict_cluster_avg_soft(spark, sf):
    train, test, a = split(spark, sf)
    clusters = F.broadcast(a.select(F.col("cluster_id").alias("c")).distinct())
    members = a.crossJoin(clusters).select("user_id", F.col("c").alias("cluster_id"), F.when(F.col("cluster_id") == F.col("c"), 0.6).otherwise(0.1).alias("w"))
    return shown(P.soft_cluster_average(train, test, a, members))


@query("predict_knn_centered", f"WITH {SIM8}{NEAR}{KNN} {OUT}")
def predict_knn_centered(spark, sf):
    train, test, a = split(spark, sf)
    return shown(P.within_clusters(train, test, a))


@query("predict_cluster_knn_cosine", f"WITH {COS8}{NEAR}{KNN} {OUT}")
def predict_cluster_knn_cosine(spark, sf):
    train, test, a = split(spark, sf)
    return shown(P.within_clusters(train, test, a, "cosine"))


@query(
    "predict_cluster_knn_pearson",
    f"""WITH {SIM8}{NEAR}, mv AS (SELECT user_id, item_id, sum(greatest(0.0, sim) * r_v) AS up, sum(greatest(0.0, sim)) AS down FROM nb GROUP BY 1, 2),
  scored AS (SELECT test.user_id, test.item_id, test.rating, CASE WHEN down >= 1e-8 THEN greatest(1.0, least(5.0, up / down)) ELSE coalesce(mean, mu) END AS pred FROM test LEFT JOIN mv USING (user_id, item_id) LEFT JOIN means ON means.user_id = test.user_id, overall) {OUT}""",
)
def predict_cluster_knn_pearson(spark, sf):
    train, test, a = split(spark, sf)
    return shown(P.within_clusters(train, test, a, positive=True))


FALL = ", im AS (SELECT item_id, avg(rating) AS m FROM train GROUP BY 1), fall AS (SELECT test.user_id, test.item_id, test.rating, greatest(1.0, least(5.0, coalesce(m, mean, mu))) AS pred FROM test LEFT JOIN im USING (item_id) LEFT JOIN means ON means.user_id = test.user_id, overall)"


@query("predict_gray_fallback", f"WITH {SPLIT}{FALL} {OUT.replace('scored', 'fall')}")
def predict_gray_fallback(spark, sf):
    train, test, _ = split(spark, sf)
    return shown(P.item_fallback(train, test))


@query("predict_routed", f"WITH {CAVG}{FALL}, both_ AS (SELECT scored.user_id, scored.item_id, scored.rating, CASE WHEN is_gray THEN fall.pred ELSE scored.pred END AS pred FROM scored JOIN fall USING (user_id, item_id) JOIN asg ON asg.user_id = scored.user_id) {OUT.replace('scored', 'both_')}")
def predict_routed(spark, sf):
    train, test, a = split(spark, sf)
    return shown(P.routed(P.cluster_average(train, test, a), P.item_fallback(train, test), a))


TOPN = CAVG + f", cand AS (SELECT us.user_id, cm.item_id, p FROM (SELECT DISTINCT user_id FROM train) us JOIN asg USING (user_id) JOIN cm USING (cluster_id) LEFT JOIN train t ON t.user_id = us.user_id AND t.item_id = cm.item_id WHERE t.item_id IS NULL), recs AS (SELECT * FROM (SELECT user_id, item_id, p, row_number() OVER (PARTITION BY user_id ORDER BY {r6('p')} DESC, item_id) AS rank FROM cand) WHERE rank <= 10)"


@query("topn_unseen", f"WITH {TOPN} SELECT user_id, rank, item_id, {r6('p')} AS pred FROM recs")
def topn_unseen(spark, sf):
    train, _, a = split(spark, sf)
    return P.top_n_unseen_by_cluster(train, a)


# ---- evaluation

ERR = f"count(*) AS n, {r6('avg(abs(pred - rating))')} AS mae, {r6('sqrt(avg((pred - rating) * (pred - rating)))')} AS rmse"


def scored(spark, sf):
    train, test, a = split(spark, sf)
    return P.cluster_average(train, test, a), a


@query("mae_rmse", f"WITH {CAVG} SELECT {ERR} FROM scored")
def mae_rmse(spark, sf):
    return E.errors(scored(spark, sf)[0])


@query("mae_rmse_segments", f"WITH {CAVG}, m AS (SELECT scored.*, is_gray FROM scored JOIN asg USING (user_id)) SELECT 'total' AS segment, {ERR} FROM m UNION ALL SELECT CASE WHEN is_gray THEN 'gray' ELSE 'white' END, {ERR} FROM m GROUP BY is_gray")
def mae_rmse_segments(spark, sf):
    return E.errors_by_segment(*scored(spark, sf))


@query("flagship", f"WITH {SIM8}{NEAR}{KNN}, m AS (SELECT scored.*, is_gray FROM scored JOIN asg USING (user_id)) SELECT 'total' AS segment, {ERR} FROM m UNION ALL SELECT CASE WHEN is_gray THEN 'gray' ELSE 'white' END, {ERR} FROM m GROUP BY is_gray")
def flagship(spark, sf):
    """Split, similarities within clusters, neighbour prediction, error by segment: one job."""
    train, test, a = split(spark, sf)
    return E.errors_by_segment(P.within_clusters(train, test, a), a)


@query("binary_accuracy", f"WITH {CAVG} SELECT count(*) AS n, {r6('avg(CASE WHEN (rating >= 4.0) = (pred >= 4.0) THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM scored")
def binary_accuracy(spark, sf):
    return E.binary_accuracy(scored(spark, sf)[0])


@query(
    "cluster_mae_spread",
    f"WITH {CAVG}, m AS (SELECT cluster_id, {ERR} FROM scored JOIN asg USING (user_id) GROUP BY 1) SELECT count(*) AS clusters, " + ", ".join(f"{r6(f'avg({x})')} AS {x}_mean, {r6(f'stddev_pop({x})')} AS {x}_std, min({x}) AS {x}_min, max({x}) AS {x}_max" for x in ("mae", "rmse")) + " FROM m",
)
def cluster_mae_spread(spark, sf):
    return E.cluster_spread(*scored(spark, sf))


def ranking_sql(lists: str, n: int) -> str:
    return f""", rel AS (SELECT user_id, item_id FROM test WHERE rating >= 4.0), size AS (SELECT user_id, count(*) AS rel FROM rel WHERE user_id IN (SELECT user_id FROM {lists}) GROUP BY 1),
  hit AS (SELECT user_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg FROM {lists} JOIN rel USING (user_id, item_id) WHERE rank <= {n} GROUP BY 1),
  pu AS (SELECT user_id, rel, coalesce(hits, 0) AS hits, coalesce(dcg, 0) AS dcg, (SELECT sum(1 / log2(r + 1)) FROM range(1, {n + 1}) t(r) WHERE r <= rel) AS ideal FROM size LEFT JOIN hit USING (user_id)),
  pr AS (SELECT *, hits / {n}.0::DOUBLE AS p, hits / rel::DOUBLE AS r FROM pu)"""


@query("ranking_unseen", f"WITH {TOPN}{ranking_sql('recs', 10)} SELECT user_id, hits, rel, {r6('p')} AS precision, {r6('r')} AS recall, {r6('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END')} AS f1, {r6('dcg / ideal')} AS ndcg FROM pr")
def ranking_unseen(spark, sf):
    train, test, a = split(spark, sf)
    per = E.ranking(P.top_n_unseen_by_cluster(train, a), E.relevant_items(test), 10)
    return per.select("user_id", "hits", "rel", *[S.r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "ndcg")])


TL = f", tl AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {r6('pred')} DESC, item_id) AS rank FROM scored)"


@query("ranking_test_items", f"WITH {CAVG}{TL}{ranking_sql('tl', 5)} SELECT count(*) AS users, {r6('avg(p)')} AS precision, {r6('avg(r)')} AS recall, {r6('avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END)')} AS f1, {r6('avg(dcg / ideal)')} AS ndcg FROM pr")
def ranking_test_items(spark, sf):
    done, _ = scored(spark, sf)
    _, test, _ = split(spark, sf)
    return E.ranking_mean(E.ranking(E.test_lists(done), E.relevant_items(test), 5))


FOLD = POS.replace("{seed}", "s3") + ", f AS (SELECT user_id, item_id, rating, p % 5 AS fold FROM pos), fm AS (SELECT a.fold, b.item_id, avg(b.rating) AS m FROM (SELECT DISTINCT fold FROM f) a JOIN f b ON a.fold <> b.fold GROUP BY 1, 2), sc AS (SELECT fold, user_id, item_id, rating, m AS pred FROM f JOIN fm USING (fold, item_id))"


def fold_scores(spark, sf):
    """Item means of the other folds: whole sums less the fold's own, so no fold is joined with another."""
    f = SP.kfold(X.ratings(spark, sf))
    own = f.groupBy("fold", "item_id").agg(F.sum("rating").alias("s"), F.count("*").alias("n"))
    whole = own.groupBy("item_id").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    rest = (F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))
    means = own.join(whole, "item_id").where("all_n > n").select("fold", "item_id", rest.alias("pred"))
    return f.join(means, ["fold", "item_id"])


@query("cv_fold_errors", f"WITH {FOLD} SELECT fold, {ERR} FROM sc GROUP BY 1")
def cv_fold_errors(spark, sf):
    return E.fold_errors(fold_scores(spark, sf))


@query("cv_fold_summary", f"WITH {FOLD}, e AS (SELECT fold, {ERR} FROM sc GROUP BY 1) SELECT 'mae' AS metric, {r6('avg(mae)')} AS mean, {r6('stddev_pop(mae)')} AS std FROM e UNION ALL SELECT 'rmse', {r6('avg(rmse)')}, {r6('stddev_pop(rmse)')} FROM e")
def cv_fold_summary(spark, sf):
    return E.fold_summary(E.fold_errors(fold_scores(spark, sf)))


RES = "res AS (SELECT l_orderkey AS assignment_id, CAST(l_linenumber AS BIGINT) AS cv_fold, l_suppkey AS run_id, l_returnflag AS scenario, l_discount AS mae, CASE WHEN l_linenumber <> 2 THEN l_tax END AS rmse FROM lineitem)"


@query("cv_aggregate_table", f"WITH {RES} SELECT assignment_id, scenario, count(*) AS folds, {r6('avg(mae)')} AS mae, {r6('avg(rmse)')} AS rmse, string_agg(printf('%.2f', mae), ';' ORDER BY cv_fold, mae) AS fold_mae FROM res GROUP BY 1, 2")
def cv_aggregate_table(spark, sf):
    return E.cross_validation_table(X.results(spark, sf), ["assignment_id", "scenario"])


RUNS = "runs AS (SELECT c_mktsegment AS algorithm, c_custkey AS run_num, c_custkey % 97 <> 0 OR c_mktsegment <> 'BUILDING' AS success, c_acctbal AS wcss, CASE WHEN c_custkey % 97 = 0 THEN 'e' || (c_custkey % 3) END AS error FROM customer)"


@query("run_aggregate", f"WITH {RUNS} SELECT algorithm, bool_and(success) AS success, CASE WHEN bool_and(success) THEN {r6('avg(wcss)')} END AS wcss, CASE WHEN NOT bool_and(success) THEN (SELECT string_agg(DISTINCT error, '; ' ORDER BY error) FROM runs r WHERE r.algorithm = runs.algorithm) END AS error FROM runs GROUP BY 1")
def run_aggregate(spark, sf):
    c = X.table(spark, sf, "customer")
    runs = c.select(
        F.col("c_mktsegment").alias("algorithm"), ((F.col("c_custkey") % 97 != 0) | (F.col("c_mktsegment") != "BUILDING")).alias("success"), F.col("c_acctbal").alias("wcss"), F.when(F.col("c_custkey") % 97 == 0, F.concat(F.lit("e"), (F.col("c_custkey") % 3).cast("string"))).alias("error")
    )
    return E.run_summary(runs, ["algorithm"], ["wcss"])


W = {"wcss": 0.35, "db": 0.15, "time": 0.3, "silhouette": 0.15, "gray": 0.05}


@query(
    "composite_rank",
    f"""WITH a AS (SELECT p_brand AS algorithm, avg(p_retailprice) AS wcss, avg(p_size) AS db, CAST(count(*) AS DOUBLE) AS time, stddev_pop(p_size) AS silhouette, 1.0::DOUBLE AS gray FROM part GROUP BY 1),
  b AS (SELECT min(wcss) wl, max(wcss) wh, min(db) dl, max(db) dh, min(time) tl, max(time) th, min(silhouette) sl, max(silhouette) sh FROM a)
  SELECT algorithm, {r6('0.35 * (wh - wcss) / (wh - wl) + 0.15 * (dh - db) / (dh - dl) + 0.3 * (th - time) / (th - tl) + 0.15 * (silhouette - sl) / (sh - sl) + 0.05 * 0.5')} AS score FROM a, b""",
)
def composite_rank(spark, sf):
    p = X.table(spark, sf, "part")
    a = p.groupBy(F.col("p_brand").alias("algorithm")).agg(F.avg("p_retailprice").alias("wcss"), F.avg("p_size").alias("db"), F.count("*").cast("double").alias("time"), F.stddev_pop("p_size").alias("silhouette"), F.lit(1.0).alias("gray"))
    return E.composite_rank(a, W).select("algorithm", "score")


@query(
    "elbow_k",
    """WITH s AS (SELECT CAST(p_size AS BIGINT) AS k, avg(p_retailprice) AS wcss, stddev_pop(p_retailprice) AS silhouette, min(p_retailprice) AS mae FROM part GROUP BY 1),
  d AS (SELECT *, lag(wcss) OVER (ORDER BY k) - wcss AS drop_ FROM s), b AS (SELECT (SELECT k FROM d WHERE drop_ IS NOT NULL ORDER BY drop_ DESC, k LIMIT 1) AS elbow_k, (SELECT k FROM d ORDER BY silhouette DESC, k LIMIT 1) AS silhouette_k, (SELECT k FROM d ORDER BY mae, k LIMIT 1) AS mae_k)
  SELECT *, CAST(round_even((elbow_k + silhouette_k + mae_k) / 3, 0) AS BIGINT) AS suggested_k FROM b""",
)
def elbow_k(spark, sf):
    p = X.table(spark, sf, "part")
    return E.elbow(p.groupBy(F.col("p_size").cast("long").alias("k")).agg(F.avg("p_retailprice").alias("wcss"), F.stddev_pop("p_retailprice").alias("silhouette"), F.min("p_retailprice").alias("mae")))


@query(
    "convergence",
    f"""WITH h AS (SELECT l_suppkey % 10 AS algorithm, l_orderkey % 40 AS epoch, min(l_extendedprice) AS f FROM lineitem GROUP BY 1, 2), h2 AS (SELECT algorithm, epoch, min(f) OVER (PARTITION BY algorithm ORDER BY epoch) AS fitness FROM h),
  h3 AS (SELECT algorithm, row_number() OVER (PARTITION BY algorithm ORDER BY epoch) - 1 AS epoch, fitness FROM h2), e AS (SELECT algorithm, arg_min(fitness, epoch) AS f0, arg_max(fitness, epoch) AS ft, count(*) AS t FROM h3 GROUP BY 1),
  m AS (SELECT algorithm, f0, ft, t, min(epoch) FILTER (fitness <= f0 - 0.8 * (f0 - ft)) AS sp, max(fitness) FILTER (epoch = floor(t * 0.7)) AS f70 FROM h3 JOIN e USING (algorithm) GROUP BY ALL),
  s AS (SELECT algorithm, t, CASE WHEN t < 2 THEN 0 WHEN f0 - ft <= 0 THEN t ELSE sp END AS speed, CASE WHEN t < 10 OR f0 - ft <= 0 THEN 0 ELSE (f70 - ft) / (f0 - ft) END AS share FROM m)
  SELECT algorithm, CAST(speed AS BIGINT) AS convergence_speed, {r6('share')} AS exploration_ratio, CASE WHEN speed <= 0.3 * t AND share < 0.1 THEN 'LOCAL' WHEN speed >= 0.6 * t AND share >= 0.2 THEN 'GLOBAL' ELSE 'BALANCED' END AS category FROM s""",
)
def convergence(spark, sf):
    from pyspark.sql import Window

    h = X.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("algorithm"), (F.col("l_orderkey") % 40).alias("e")).agg(F.min("l_extendedprice").alias("f"))
    w = Window.partitionBy("algorithm").orderBy("e")
    return E.convergence(h.select("algorithm", (F.row_number().over(w) - 1).cast("long").alias("epoch"), F.min("f").over(w).alias("fitness")))


# ---- clusters and outliers over vectors


def clustered(spark, sf):
    v = X.vectors(spark, sf)
    return v, C.centroids(v, DIMS)


@query("cluster_sizes", f"WITH {SPLIT}, k AS (SELECT range AS cluster_id FROM range(8)) SELECT k.cluster_id, count(asg.user_id) AS n FROM k LEFT JOIN asg ON asg.cluster_id = k.cluster_id GROUP BY 1")
def cluster_sizes(spark, sf):
    return C.sizes(split(spark, sf)[2], 8)


@query("cluster_size_summary", f"WITH {SPLIT}, k AS (SELECT range AS cluster_id FROM range(8)), s AS (SELECT k.cluster_id, count(asg.user_id) AS n FROM k LEFT JOIN asg ON asg.cluster_id = k.cluster_id AND NOT is_gray GROUP BY 1) SELECT min(n) AS smallest, max(n) AS largest, floor(avg(n) * 10 + 0.5) / 10 AS mean, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty, (SELECT {r6('avg(CASE WHEN is_gray THEN 1.0 ELSE 0.0 END)')} FROM asg) AS gray_ratio FROM s")
def cluster_size_summary(spark, sf):
    return C.size_summary(split(spark, sf)[2], 8)


@query("nearest_centroid", f"WITH {VEC} SELECT vec_id, nearest, {r6('d2')} AS d2 FROM near")
def nearest_centroid(spark, sf):
    return C.nearest(*clustered(spark, sf)).withColumn("d2", S.r6(F.col("d2")))


@query("wcss", f"WITH {VEC} SELECT {r6('sum(d2)')} AS wcss FROM near")
def wcss(spark, sf):
    return C.wcss(*clustered(spark, sf))


@query("penalized_fitness", f"WITH {VEC} SELECT {r6('sum(d2) + 1000 * ((SELECT count(DISTINCT cluster_id) FROM vec) - count(DISTINCT nearest))')} AS fitness, (SELECT count(DISTINCT cluster_id) FROM vec) - count(DISTINCT nearest) AS empty FROM near")
def penalized_fitness(spark, sf):
    return C.penalized(*clustered(spark, sf))


DBI = VEC + ", s AS (SELECT own AS cluster_id, avg(sqrt(d2)) AS s FROM dist WHERE own = cid GROUP BY 1), m AS (SELECT a.cluster_id AS i, b.cluster_id AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m FROM cen a JOIN cen b ON a.dim = b.dim AND a.cluster_id <> b.cluster_id GROUP BY 1, 2)"


@query("davies_bouldin", f"WITH {DBI}, w AS (SELECT i, max((p.s + q.s) / m) AS w FROM m JOIN s p ON p.cluster_id = i JOIN s q ON q.cluster_id = j WHERE m >= 1e-10 GROUP BY 1) SELECT {r6('sum(w) / (SELECT count(*) FROM s)')} AS davies_bouldin FROM w")
def davies_bouldin(spark, sf):
    return C.davies_bouldin(*clustered(spark, sf))


@query(
    "calinski_harabasz",
    f"""WITH {VEC}, g AS (SELECT dim, avg(x) AS g FROM cells GROUP BY 1), sz AS (SELECT cluster_id, count(*) AS n FROM vec GROUP BY 1), b AS (SELECT sum(n * (c - g) * (c - g)) AS b FROM cen JOIN g USING (dim) JOIN sz USING (cluster_id)),
  w AS (SELECT sum(d2) AS w FROM dist WHERE own = cid), c AS (SELECT count(*) AS k, sum(n) AS n FROM sz) SELECT {r6('(b / (k - 1)) / (w / (n - k))')} AS calinski_harabasz FROM b, w, c""",
)
def calinski_harabasz(spark, sf):
    v, c = clustered(spark, sf)
    return C.calinski_harabasz(v, c, DIMS)


@query(
    "silhouette",
    f"""WITH {VEC}, smp AS (SELECT vec_id AS id, cluster_id AS own, v AS x FROM vec ORDER BY md5(vec_id || '|sil'), vec_id LIMIT 200),
  d AS (SELECT id, own, cluster_id, avg(sqrt(list_sum(list_transform(list_zip(x, v), lambda e: (e[1] - e[2]) * (e[1] - e[2]))))) AS m FROM smp, vec WHERE id <> vec_id GROUP BY 1, 2, 3),
  ab AS (SELECT id, max(m) FILTER (own = cluster_id) AS a, min(m) FILTER (own <> cluster_id) AS b FROM d GROUP BY 1)
  SELECT {r6('avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 1e-10 THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette, count(*) AS sampled FROM ab""",
)
def silhouette(spark, sf):
    return C.silhouette(X.vectors(spark, sf))


@query("fcm_membership", f"WITH {VEC} SELECT vec_id, cid, {r6('(1 / greatest(d2, 1e-24)) / sum(1 / greatest(d2, 1e-24)) OVER (PARTITION BY vec_id)')} AS w FROM dist")
def fcm_membership(spark, sf):
    return C.memberships(*clustered(spark, sf)).select("vec_id", "cid", S.r6(F.col("w")).alias("w"))


@query("fcm_objective", f"WITH {VEC}, w AS (SELECT d2, (1 / greatest(d2, 1e-24)) / sum(1 / greatest(d2, 1e-24)) OVER (PARTITION BY vec_id) AS w FROM dist) SELECT {r6('sum(w * w * d2)')} AS objective FROM w")
def fcm_objective(spark, sf):
    return C.fuzzy_objective(C.memberships(*clustered(spark, sf)))


@query("gray_distance", f"WITH {VEC} SELECT vec_id, {r6('sqrt(d2)')} AS dist, sqrt(d2) > 0.8 AS is_gray FROM near")
def gray_distance(spark, sf):
    return C.gray_by_distance(*clustered(spark, sf), 0.8)


@query("gray_percentile", f"WITH {VEC}, d AS (SELECT vec_id, {r6('sqrt(d2)')} AS dist FROM near) SELECT vec_id, dist, dist > (SELECT quantile_cont(dist, 0.8) FROM d) AS is_gray FROM d")
def gray_percentile(spark, sf):
    return C.gray_by_percentile(*clustered(spark, sf))


PROF = RAT + ", p AS (SELECT user_id, avg(rating) AS mean, stddev_pop(rating) AS std, 1 - count(*) / (SELECT count(DISTINCT item_id) FROM ratings) AS empty FROM ratings GROUP BY 1), z AS (SELECT user_id, " + " + ".join(f"CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN abs(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()) ELSE 0 END" for c in ("mean", "std", "empty")) + " AS score FROM p)"


@query("gray_zscore", f"WITH {PROF} SELECT user_id, {r6('score')} AS score, {r6('score')} >= 3.0 AS is_gray FROM z")
def gray_zscore(spark, sf):
    return C.gray_by_profile(R.user_profile(X.ratings(spark, sf)))


@query(
    "lof_features",
    f"""WITH {RAT}, a AS (SELECT DISTINCT user_id, user_id % 5 AS cluster_id FROM ratings), sz AS (SELECT cluster_id, count(*) AS m FROM a GROUP BY 1), r AS (SELECT ratings.*, cluster_id, m FROM ratings JOIN a USING (user_id) JOIN sz USING (cluster_id)),
  im AS (SELECT cluster_id, item_id, sum(rating) / any_value(m) AS c FROM r GROUP BY 1, 2) SELECT user_id, {r6('avg(rating)')} AS f0, {r6('count(*) / (SELECT count(DISTINCT item_id) FROM ratings)')} AS f1, {r6('stddev_pop(rating)')} AS f2, {r6('avg(CASE WHEN m > 1 THEN abs(rating - c) ELSE 1 END)')} AS f3 FROM r JOIN im USING (cluster_id, item_id) GROUP BY 1""",
)
def lof_features(spark, sf):
    df = X.ratings(spark, sf)
    return C.outlier_features(df, mod_assignment(df)).select("user_id", *[S.r6(F.col("v")[i]).alias(f"f{i}") for i in range(4)])


@query(
    "local_outlier_factor",
    f"""WITH {VEC}, d AS (SELECT a.vec_id AS id, b.vec_id AS other, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda e: (e[1] - e[2]) * (e[1] - e[2])))) AS dist FROM vec a JOIN vec b ON a.vec_id <> b.vec_id),
  knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS k FROM d) WHERE k <= 20), kd AS (SELECT id, max(dist) AS kdist FROM knn GROUP BY 1),
  lrd AS (SELECT knn.id, 1 / (avg(greatest(kdist, dist)) + 1e-10) AS lrd FROM knn JOIN kd ON kd.id = other GROUP BY 1), lof AS (SELECT knn.id, avg(o.lrd) / any_value(m.lrd) AS lof FROM knn JOIN lrd o ON o.id = other JOIN lrd m ON m.id = knn.id GROUP BY 1)
  SELECT id AS vec_id, {r6('lof')} AS lof, lof > 1.5 AS is_gray FROM lof""",
)
def local_outlier_factor(spark, sf):
    return C.local_outlier_factor(X.vectors(spark, sf)).select("vec_id", S.r6(F.col("lof")).alias("lof"), (F.col("lof") > 1.5).alias("is_gray"))


# ---- store

ASG = "asg AS (SELECT o_orderkey AS id, o_orderpriority AS dataset, o_orderstatus AS algo, o_custkey % 5 AS k, 'none' AS preprocessing, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS wcss, o_custkey AS run_id, o_orderdate AS created_at FROM orders)"
BEST = ASG + ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, algo, k, preprocessing ORDER BY {}) AS rn FROM asg) WHERE rn = 1)"
SHORT = "SELECT dataset, algo, k, id, wcss FROM best"


@query("store_best_assignment", f"WITH {BEST.format('wcss ASC NULLS LAST, id')} {SHORT}")
def store_best_assignment(spark, sf):
    return ST.load_assignment(X.assignments(spark, sf), "best_wcss").select("dataset", "algo", "k", "id", "wcss")


@query("store_latest_assignment", f"WITH {BEST.format('created_at DESC, id DESC')} {SHORT}")
def store_latest_assignment(spark, sf):
    return ST.load_assignment(X.assignments(spark, sf), "latest").select("dataset", "algo", "k", "id", "wcss")


@query("store_assignment_of_run", f"WITH {BEST.format('id DESC').replace('FROM asg)', 'FROM asg WHERE run_id = 7)')} {SHORT}")
def store_assignment_of_run(spark, sf):
    return ST.load_assignment(X.assignments(spark, sf), "by_run", 7).select("dataset", "algo", "k", "id", "wcss")


@query("store_assignment_stats", f"WITH {ASG} SELECT dataset, algo, k, preprocessing, count(*) AS n, min(wcss) AS min_wcss, max(wcss) AS max_wcss, {r6('avg(wcss)')} AS avg_wcss, min(run_id) AS first_run, max(run_id) AS last_run FROM asg GROUP BY 1, 2, 3, 4")
def store_assignment_stats(spark, sf):
    return ST.assignment_stats(X.assignments(spark, sf)).withColumn("avg_wcss", S.r6(F.col("avg_wcss")))


@query("store_run_detail", f"WITH {ASG}, {RES} SELECT assignment_id, cv_fold, scenario, mae, rmse, dataset, algo, k, wcss FROM res JOIN asg ON id = assignment_id WHERE res.run_id = 3")
def store_run_detail(spark, sf):
    return ST.run_detail(X.results(spark, sf), X.assignments(spark, sf), 3).select("assignment_id", "cv_fold", "scenario", "mae", "rmse", "dataset", "algo", "k", "wcss")


@query("store_last_runs", f"WITH {ASG} SELECT id, dataset, algo FROM asg ORDER BY id DESC LIMIT 20")
def store_last_runs(spark, sf):
    return ST.last_runs(X.assignments(spark, sf)).select("id", "dataset", "algo")


@query("store_last_id", f"WITH {ASG} SELECT max(id) AS id FROM asg")
def store_last_id(spark, sf):
    return X.assignments(spark, sf).agg(F.max("id").alias("id"))


@query("store_prioritized", f"WITH {BEST.format('wcss ASC NULLS LAST, id')}, c(preprocessing, ordinal) AS (VALUES ('zscore', 1), ('none', 2)) SELECT dataset, algo, k, id, wcss, ordinal FROM best JOIN c USING (preprocessing)")
def store_prioritized(spark, sf):
    c = spark.createDataFrame([("zscore", 1), ("none", 2)], "preprocessing string, ordinal int")
    return ST.prioritized(X.assignments(spark, sf), c).select("dataset", "algo", "k", "id", "wcss", "ordinal")


@query("store_missing_jobs", f"WITH {ASG}, {RES} SELECT id AS assignment_id FROM asg WHERE id NOT IN (SELECT assignment_id FROM res WHERE scenario = 'R')")
def store_missing_jobs(spark, sf):
    jobs = X.assignments(spark, sf).select(F.col("id").alias("assignment_id"))
    return ST.missing_only(jobs, X.results(spark, sf).where("scenario = 'R'"), ["assignment_id"])


@query("phase_with_behaviour", f"WITH {ASG}, m AS (SELECT algo, count(*) AS n FROM asg GROUP BY 1), b AS (SELECT l_linestatus AS algo, {r6('avg(l_discount)')} AS speed FROM lineitem GROUP BY 1) SELECT algo, n, speed FROM m LEFT JOIN b USING (algo)")
def phase_with_behaviour(spark, sf):
    m = X.assignments(spark, sf).groupBy("algo").agg(F.count("*").alias("n"))
    b = X.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("algo")).agg(S.r6(F.avg("l_discount")).alias("speed"))
    return m.join(b, "algo", "left")


@query("family_counts", "WITH f AS (SELECT CASE WHEN contains(p_type, 'STANDARD') THEN 'single' WHEN contains(p_type, 'SMALL') THEN 'hybrid' ELSE 'other' END AS family FROM part), n(family) AS (VALUES ('single'), ('hybrid'), ('other'), ('none')) SELECT n.family, count(f.family) AS n FROM n LEFT JOIN f ON f.family = n.family GROUP BY 1")
def family_counts(spark, sf):
    t = F.col("p_type")
    f = X.table(spark, sf, "part").select(F.when(t.contains("STANDARD"), "single").when(t.contains("SMALL"), "hybrid").otherwise("other").alias("family")).groupBy("family").agg(F.count("*").alias("c"))
    every = spark.createDataFrame([("single",), ("hybrid",), ("other",), ("none",)], "family string")
    return every.join(f, "family", "left").select("family", F.coalesce("c", F.lit(0)).alias("n"))


@query("run_tags", "SELECT p_partkey, 'k' || p_size || '_ld20_eg100_ec100_lr' || CASE WHEN p_size % 2 = 0 THEN '0.01' ELSE '0.005' END || '_r0.1' AS tag, CASE WHEN p_size % 2 = 0 THEN 'a_wnmf16_x_wnmf20' ELSE p_brand END AS suffix FROM part")
def run_tags(spark, sf):
    even = F.col("p_size") % 2 == 0
    tag = S.run_tag(F.col("p_size"), F.lit(20), F.lit(100), F.lit(100), F.when(even, 0.01).otherwise(0.005), F.lit(0.1))
    return X.table(spark, sf, "part").select("p_partkey", tag.alias("tag"), S.sync_latent(F.when(even, F.lit("a_wnmf20_x_wnmf20")).otherwise(F.col("p_brand")), F.lit(16)).alias("suffix"))


@query("feature_embedding", f"WITH w AS (SELECT f, d, ((f * 7 + d * 3) % 11 - 5) / 7.0::DOUBLE AS w FROM range(3) a(f), range(4) b(d)), x AS (SELECT c_custkey AS user_id, 0 AS f, c_acctbal / 10000 AS x FROM customer UNION ALL SELECT c_custkey, 1, c_nationkey / 25.0::DOUBLE FROM customer UNION ALL SELECT c_custkey, 2, 1.0 FROM customer) SELECT user_id, d AS dim, {r6('sum(x * w)')} AS value FROM x JOIN w USING (f) GROUP BY 1, 2")
def feature_embedding(spark, sf):
    """Features times a small fixed matrix: columns, not a join."""
    c = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.array(F.col("c_acctbal") / 10000, F.col("c_nationkey") / F.lit(25.0), F.lit(1.0)).alias("x"))
    rows = [[((f * 7 + d * 3) % 11 - 5) / 7.0 for f in range(3)] for d in range(4)]
    value = F.array(*[S.dot(F.col("x"), F.array(*map(F.lit, r))) for r in rows])
    return c.select("user_id", F.posexplode(value).alias("dim", "value")).select("user_id", F.col("dim").cast("long").alias("dim"), S.r6(F.col("value")).alias("value"))


@query("list_overlap", f"WITH {TOPN}, rel AS (SELECT user_id, list(item_id) AS r FROM test WHERE rating >= 4.0 GROUP BY 1), l AS (SELECT user_id, list(item_id) AS l FROM recs GROUP BY 1) SELECT user_id, CAST(len(list_intersect(l, r)) AS BIGINT) AS hits FROM l JOIN rel USING (user_id)")
def list_overlap(spark, sf):
    train, test, a = split(spark, sf)
    lists = P.top_n_unseen_by_cluster(train, a).groupBy("user_id").agg(F.collect_list("item_id").alias("l"))
    rel = E.relevant_items(test).groupBy("user_id").agg(F.collect_list("item_id").alias("r"))
    return lists.join(rel, "user_id").select("user_id", F.size(F.array_intersect("l", "r")).cast("long").alias("hits"))


# ---- learned and iterative: no SQL twin


@query("als_predict")
def als_predict(spark, sf):
    from tastemill.operators.factorize import als

    train, test, _ = split(spark, sf)
    return als(train, test, rank=10, rounds=5)


@query("wnmf_factors")
def wnmf_factors(spark, sf):
    from tastemill.operators.factorize import wnmf

    train, test, _ = split(spark, sf)
    users, items = wnmf(train, rank=6, rounds=6, every=3)
    return shown(P.factor_prediction(test, users, items))


@query("cluster_models_full")
def cluster_models_full(spark, sf):
    from tastemill.operators.factorize import Rule, cluster_models

    train, test, a = split(spark, sf)
    c = a.select("user_id", "cluster_id")
    return cluster_models(train.join(c, "user_id"), test.join(c, "user_id"), Rule.biased_model(rank=6, epochs=5))


@query("cluster_models_shared_v")
def cluster_models_shared_v(spark, sf):
    from tastemill.operators.factorize import shared_items, wnmf

    train, test, a = split(spark, sf)
    _, items = wnmf(train, rank=6, rounds=4, every=2)
    return shared_items(train.join(a, "user_id"), test.join(a.select("user_id", "cluster_id"), "user_id"), items, 6)


@query("kmeans_assign")
def kmeans_assign(spark, sf):
    return C.k_means(X.vectors(spark, sf), 10, unit=True)


@query("lloyd_seeded")
def lloyd_seeded(spark, sf):
    v = X.vectors(spark, sf)
    return C.lloyd(v, C.seed_by_distance(v, 5), DIMS, 4)[1]


@query("fcm_fit")
def fcm_fit(spark, sf):
    return C.fuzzy_c_means(X.vectors(spark, sf), 5, DIMS, 4)[1]


@query("pca_features")
def pca_features(spark, sf):
    from tastemill.operators.factorize import pca

    return pca(X.vectors(spark, sf), variance=0.9)[0]


def _search(name: str):
    @query(f"{name.lower().replace('-', '_').replace('+', '_then_').replace('||', '_or_')}_search")
    def run(spark, sf):
        import numpy as np

        from tastemill.operators.search import clustering_objective, get_optimizer

        low, high = -np.ones(4 * DIMS) * 0.5, np.ones(4 * DIMS) * 0.5
        r = get_optimizer(name)(clustering_objective(X.vectors(spark, sf), 4, DIMS), low, high, 8, 4)
        return spark.createDataFrame([(i, float(f)) for i, f in enumerate(r.history)], "epoch long, fitness double")

    return run


for _name in ("PSO", "DOA", "DE-HHO", "GWO+PSO", "GWO||PSO"):
    _search(_name)


from tastemill.plans import catalogue_more, catalogue_runs  # noqa: E402, F401  (they register their queries here)
