"""Registered queries of block SGD, sparse vectors, composite scores and lists without a grid, with SQL twins of fixed rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tastemill.functions import scalars as S
from tastemill.operators import search as O
from tastemill.operators import sparse as SV
from tastemill.operators import stratified as SG
from tastemill.plans import assignments as A
from tastemill.plans.catalogue import DIMS, SPLIT, query, r6, shown, split
from tastemill.sources import fixtures as X

# ---- stratified SGD


def variate(k: int, side: int, key: str) -> str:
    u = [f"((CAST('0x' || substr(md5(grp || '|' || {key} || '|t{side}.{k}{t}'), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)" for t in "ab"]
    return f"0.1::DOUBLE * (sqrt(-2 * ln({u[0]})) * cos(2 * pi() * {u[1]}))"


def block_sql(key: str, name: str) -> str:
    return f"CAST('0x' || substr(md5({key} || '|{name}'), 1, 8) AS BIGINT) % 2 AS {name}"


LR, REG = "0.01::DOUBLE", "0.02::DOUBLE"


@query(
    "sgd_sub_epoch",
    f"""WITH RECURSIVE {SPLIT}, dealt AS (SELECT cluster_id AS grp, user_id, item_id, rating, {block_sql('user_id', 'ub')}, {block_sql('item_id', 'ib')} FROM train JOIN asg USING (user_id)),
  grp_mean AS (SELECT grp, avg(rating) AS mu FROM dealt GROUP BY grp),
  steps AS MATERIALIZED (SELECT grp, user_id, item_id, rating, mu, row_number() OVER (PARTITION BY grp, ub ORDER BY md5(user_id || '|' || item_id || '|t'), user_id, item_id) AS n FROM dealt JOIN grp_mean USING (grp) WHERE ub = ib),
  start AS MATERIALIZED (SELECT grp, 0 AS side, user_id AS id, {variate(0, 0, 'user_id')} AS a, {variate(1, 0, 'user_id')} AS b FROM (SELECT DISTINCT grp, user_id FROM dealt)
    UNION ALL SELECT grp, 1, item_id, {variate(0, 1, 'item_id')}, {variate(1, 1, 'item_id')} FROM (SELECT DISTINCT grp, item_id FROM dealt)),
  state(grp, side, id, bias, a, b, n) USING KEY (grp, side, id) AS (
    SELECT grp, side, id, 0.0::DOUBLE, a, b, 0::BIGINT FROM start
    UNION
    SELECT grp, side, CASE WHEN side = 0 THEN user_id ELSE item_id END,
      CASE WHEN side = 0 THEN ubias + {LR} * (e - {REG} * ubias) ELSE ibias + {LR} * (e - {REG} * ibias) END,
      CASE WHEN side = 0 THEN ua + {LR} * (e * ia - {REG} * ua) ELSE ia + {LR} * (e * ua - {REG} * ia) END,
      CASE WHEN side = 0 THEN ub + {LR} * (e * ib - {REG} * ub) ELSE ib + {LR} * (e * ub - {REG} * ib) END, n
    FROM (SELECT s.grp, s.user_id, s.item_id, s.n, u.bias AS ubias, u.a AS ua, u.b AS ub, i.bias AS ibias, i.a AS ia, i.b AS ib,
            s.rating - s.mu - (u.a * i.a + u.b * i.b) - u.bias - i.bias AS e
          FROM steps s JOIN recurring.state u ON u.grp = s.grp AND u.side = 0 AND u.id = s.user_id JOIN recurring.state i ON i.grp = s.grp AND i.side = 1 AND i.id = s.item_id
          WHERE s.n = (SELECT max(n) + 1 FROM state)), (VALUES (0), (1)) sides(side))
  SELECT grp, side, id, {r6('bias')} AS bias, {r6('a')} AS a, {r6('b')} AS b FROM state""",
)
def sgd_sub_epoch(spark, sf):
    """Factors of five clusters, each cut in 2 x 2 blocks, after the first diagonal was walked."""
    train, _, a = split(spark, sf)
    strata = SG.Strata(train.join(a, "user_id"), SG.Rule(rank=2, seed="t"), "cluster_id", blocks=2)
    rows = strata.sub_epoch(0, 0).select("grp", "side", F.posexplode("ids").alias("at", "id"), "bias", "vec")
    return rows.select("grp", "side", "id", S.r6(F.get("bias", F.col("at"))).alias("bias"), S.r6(F.get("vec", 2 * F.col("at"))).alias("a"), S.r6(F.get("vec", 2 * F.col("at") + 1)).alias("b"))


@query("sgd_blocks")
def sgd_blocks(spark, sf):
    """The global biased model with users and items in 3 x 3 blocks."""
    train, test, _ = split(spark, sf)
    return shown(SG.fit(train, SG.Rule.biased_model(rank=6, epochs=3), blocks=3).predict(test))


# ---- scores of candidates

SQUARES = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
PRODUCT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"


@query(
    "composite_scores",
    f"""WITH vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  cand AS (SELECT vec_id // 4 AS cand, vec_id % 4 AS j, v AS c FROM vec WHERE vec_id < 12),
  near AS (SELECT cand, vec_id, min(d2) AS d2, arg_min(j, {{'a': d2, 'b': j}}) AS own FROM (SELECT cand, vec_id, j, {SQUARES.format('v', 'c')} AS d2 FROM vec, cand) GROUP BY cand, vec_id),
  total AS (SELECT cand, sum(d2) AS wcss FROM near GROUP BY cand),
  picked AS MATERIALIZED (SELECT vec_id, v, sqrt({PRODUCT.format('v', 'v')}) AS norm FROM vec ORDER BY md5(vec_id || '|sil'), vec_id LIMIT 300),
  mine AS (SELECT cand, vec_id, own FROM near JOIN picked USING (vec_id)),
  size AS (SELECT cand, own, count(*) AS n FROM mine GROUP BY cand, own),
  pair AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, greatest(0.0, least(2.0, 1 - {PRODUCT.format('a.v', 'b.v')} / (a.norm * b.norm))) AS far FROM picked a, picked b WHERE a.vec_id <> b.vec_id),
  sums AS (SELECT x.cand, x.vec_id, x.own, y.own AS other, sum(far) AS s FROM mine x JOIN pair ON pair.a = x.vec_id JOIN mine y ON y.vec_id = pair.b AND y.cand = x.cand GROUP BY ALL),
  inner_ AS (SELECT sums.cand, vec_id, s / (n - 1) AS a FROM sums JOIN size ON size.cand = sums.cand AND size.own = sums.own WHERE sums.own = other),
  outer_ AS (SELECT sums.cand, vec_id, min(s / n) AS b FROM sums JOIN size ON size.cand = sums.cand AND size.own = other WHERE sums.own <> other GROUP BY ALL),
  sil AS (SELECT cand, avg(CASE WHEN a IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS sil FROM outer_ LEFT JOIN inner_ USING (cand, vec_id) GROUP BY cand),
  cell AS (SELECT cand, own, vec_id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM mine JOIN picked USING (vec_id)),
  mean AS (SELECT cand, own, dim, avg(x) AS m, count(*) AS n FROM cell GROUP BY cand, own, dim),
  whole AS (SELECT cand, dim, avg(x) AS g FROM cell GROUP BY cand, dim),
  within_ AS (SELECT cand, sum((x - m) * (x - m)) AS w FROM cell JOIN mean USING (cand, own, dim) GROUP BY cand),
  between_ AS (SELECT cand, sum(n * (m - g) * (m - g)) AS b, count(DISTINCT own) AS k FROM mean JOIN whole USING (cand, dim) GROUP BY cand),
  parts AS (SELECT cand, wcss, sil, b * ((SELECT count(*) FROM picked) - k) / (w * (k - 1)) AS ch FROM total JOIN sil USING (cand) JOIN within_ USING (cand) JOIN between_ USING (cand))
  SELECT p.cand, {r6('p.wcss')} AS wcss, {r6('p.sil')} AS silhouette, {r6('p.ch')} AS ch, {r6('0.5 * p.wcss / z.wcss + 0.25 * (1 - p.sil) / (1 - z.sil) + 0.25 * z.ch / p.ch')} AS score FROM parts p, (SELECT * FROM parts WHERE cand = 0) z""",
)
def composite_scores(spark, sf):
    """A generation of three candidates (the vectors 0-3, 4-7 and 8-11 as centres), relative to the first."""
    df = X.vectors(spark, sf).select("vec_id", "v")
    rows = df.where("vec_id < 12").orderBy("vec_id").collect()
    score = O.Composite(df, 4, DIMS)
    population = np.array([r["v"] for r in rows]).reshape(3, -1)
    out = zip(score.parts(population).tolist(), score(population).tolist(), strict=True)
    done = spark.createDataFrame([(i, *p, s) for i, (p, s) in enumerate(out)], "cand long, wcss double, silhouette double, ch double, score double")
    return done.select("cand", *[S.r6(F.col(c)).alias(c) for c in ("wcss", "silhouette", "ch", "score")])


# ---- vectors with a place for each item


def lloyd_step_sql(k: int) -> str:
    """Labels by the centroids cen{k}, and the means that follow."""
    return f""", dot{k} AS (SELECT vec_id, cluster_id, sum(x * c) AS d FROM z JOIN cen{k} USING (item_id) GROUP BY 1, 2),
  all{k} AS (SELECT own.vec_id, q.cluster_id, greatest(0.0, own.xx - 2 * coalesce(d, 0) + q.cc) AS d2 FROM own, (SELECT cluster_id, sum(c * c) AS cc FROM cen{k} GROUP BY 1) q LEFT JOIN dot{k} ON dot{k}.vec_id = own.vec_id AND dot{k}.cluster_id = q.cluster_id),
  lab{k} AS MATERIALIZED (SELECT vec_id, arg_min(cluster_id, {{'a': d2, 'b': cluster_id}}) AS cluster_id, min(d2) AS d2 FROM all{k} GROUP BY 1),
  cen{k + 1} AS MATERIALIZED (SELECT cluster_id, item_id, sum(x) / any_value(n) AS c FROM z JOIN lab{k} USING (vec_id) JOIN (SELECT cluster_id, count(*) AS n FROM lab{k} GROUP BY 1) USING (cluster_id) GROUP BY 1, 2)"""


@query(
    "sparse_lloyd_2",
    f"""WITH {SPLIT}, z0 AS (SELECT user_id AS vec_id, item_id, (rating - avg(rating) OVER w) / CASE WHEN stddev_pop(rating) OVER w > 1e-12 THEN stddev_pop(rating) OVER w ELSE 1 END AS x FROM train WINDOW w AS (PARTITION BY user_id)),
  z AS MATERIALIZED (SELECT vec_id, item_id, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM z0 WHERE vec_id IN (SELECT vec_id FROM z0 GROUP BY 1 HAVING sum(x * x) > 0)),
  own AS (SELECT vec_id, sum(x * x) AS xx FROM z GROUP BY 1),
  cen0 AS MATERIALIZED (SELECT r AS cluster_id, item_id, x AS c FROM z JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM own QUALIFY r < 4) USING (vec_id)){lloyd_step_sql(0)}{lloyd_step_sql(1)}{lloyd_step_sql(2)}
  SELECT vec_id, cluster_id, {r6('d2')} AS d2 FROM lab2""",
)
def sparse_lloyd_2(spark, sf):
    """Two rounds in the z-score space of all items, from the first four users."""
    train, _, _ = split(spark, sf)
    df, d = A.features(train, {"zscore": True, "unit": True})
    df = A.cut(df.where("exists(vals, x -> x <> 0)"))
    first = [r["vec_id"] for r in df.orderBy("vec_id").limit(4).select("vec_id").collect()]
    _, near = SV.lloyd(df, SV.members_as_centres(df, first), 4, d, 2)
    return near.select("vec_id", F.col("nearest").alias("cluster_id"), S.r6(F.col("d2")).alias("d2"))
