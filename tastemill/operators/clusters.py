"""Assignment, quality and outliers of clusters over vectors (vec_id, v, cluster_id), and iterative clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.scalars import order_hash, r6, ratio, scale_rows, squared_distance
from tastemill.operators.iterate import cut


def centroids(df: DataFrame, d: int) -> DataFrame:
    """cluster_id, c (mean vector), n: one average per dimension, combined before the shuffle; nothing is exploded."""
    return df.groupBy("cluster_id").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(d)]).alias("c"), F.count("*").alias("n"))


def with_distance(df: DataFrame, centres: DataFrame) -> DataFrame:
    """Each vector and each centre. Centres are K rows and are broadcast."""
    far = F.broadcast(centres.select(F.col("cluster_id").alias("cid"), "c"))
    return df.crossJoin(far).withColumn("d2", squared_distance(F.col("v"), F.col("c")))


def nearest(df: DataFrame, centres: DataFrame) -> DataFrame:
    """vec_id, cluster of the nearest centre, d2; ties go to the first. The centres travel as one array, so no row is multiplied or shuffled."""
    all_ = centres.agg(F.array_sort(F.collect_list(F.struct(F.col("cluster_id").alias("cid"), "c"))).alias("_all"))  # K rows
    best = F.array_min(F.transform("_all", lambda s: F.struct(squared_distance(F.col("v"), s["c"]).alias("d2"), s["cid"].alias("cid"))))
    met = df.crossJoin(F.broadcast(all_)).withColumn("_b", best)
    return met.select("vec_id", F.col("_b.cid").alias("nearest"), F.col("_b.d2").alias("d2"))


def wcss(df: DataFrame, centres: DataFrame) -> DataFrame:
    return nearest(df, centres).agg(r6(F.sum("d2")).alias("wcss"))


def penalized(df: DataFrame, centres: DataFrame, penalty: float = 1000.0) -> DataFrame:
    """WCSS and ``penalty`` for each centre that nothing is nearest to."""
    near = nearest(df, centres)
    k = F.broadcast(centres.agg(F.count("*").alias("k")))
    used = near.agg(F.sum("d2").alias("s"), F.count_distinct("nearest").alias("used")).crossJoin(k)
    return used.select(r6(F.col("s") + penalty * (F.col("k") - F.col("used"))).alias("fitness"), (F.col("k") - F.col("used")).alias("empty"))


def sizes(assignment: DataFrame, k: int) -> DataFrame:
    """n of every label 0..k-1, empty ones too."""
    every = assignment.sparkSession.range(k).select(F.col("id").alias("cluster_id"))
    return every.join(assignment.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id", "left").na.fill(0, ["n"])


def size_summary(assignment: DataFrame, k: int) -> DataFrame:
    s = sizes(assignment.where("NOT is_gray"), k)
    gray = assignment.agg(r6(F.avg(F.col("is_gray").cast("double"))).alias("gray_ratio"))
    out = s.agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), (F.floor(F.avg("n") * 10 + 0.5) / 10).cast("double").alias("mean"), F.sum((F.col("n") == 0).cast("long")).alias("empty"))
    return out.crossJoin(gray)


def davies_bouldin(df: DataFrame, centres: DataFrame) -> DataFrame:
    """S is the mean distance of members; pairs with coincident centres are skipped."""
    own = df.join(F.broadcast(centres.select("cluster_id", "c")), "cluster_id")
    s = own.groupBy("cluster_id").agg(F.avg(F.sqrt(squared_distance(F.col("v"), F.col("c")))).alias("s"))
    a = centres.select("cluster_id", "c").join(s, "cluster_id")
    b = a.toDF("other", "c2", "s2")
    m = F.sqrt(squared_distance(F.col("c"), F.col("c2")))
    worst = a.join(b, F.col("cluster_id") != F.col("other")).withColumn("m", m).where("m >= 1e-10").groupBy("cluster_id").agg(F.max((F.col("s") + F.col("s2")) / F.col("m")).alias("w"))
    k = F.broadcast(centres.agg(F.count("*").alias("k")))
    return worst.agg(F.sum("w").alias("t")).crossJoin(k).select(r6(F.coalesce(F.col("t"), F.lit(0.0)) / F.col("k")).alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, centres: DataFrame, d: int) -> DataFrame:
    whole = F.broadcast(df.agg(F.array(*[F.avg(F.col("v")[i]) for i in range(d)]).alias("g"), F.count("*").alias("n_all")))
    within = df.join(F.broadcast(centres.select("cluster_id", "c")), "cluster_id").agg(F.sum(squared_distance(F.col("v"), F.col("c"))).alias("w"))
    between = centres.crossJoin(whole).agg(F.sum(F.col("n") * squared_distance(F.col("c"), F.col("g"))).alias("b"), F.count("*").alias("k"), F.first("n_all").alias("n_all"))
    return between.crossJoin(within).select(r6((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n_all") - F.col("k")))).alias("calinski_harabasz"))


def silhouette(df: DataFrame, n_sample: int = 200) -> DataFrame:
    """Mean over a sample of at most ``n_sample`` vectors against all: (b - a) / max(a, b); alone in a cluster: 0."""
    sample = F.broadcast(df.orderBy(order_hash("vec_id", seed="sil"), "vec_id").limit(n_sample).select(F.col("vec_id").alias("id"), F.col("v").alias("x"), F.col("cluster_id").alias("own")))
    dist = df.crossJoin(sample).where("vec_id <> id").groupBy("id", "own", "cluster_id").agg(F.avg(F.sqrt(squared_distance(F.col("v"), F.col("x")))).alias("m"))
    per = dist.groupBy("id").agg(F.max(F.when(F.col("own") == F.col("cluster_id"), F.col("m"))).alias("a"), F.min(F.when(F.col("own") != F.col("cluster_id"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(ratio(F.col("b") - F.col("a"), F.greatest("a", "b"), 0.0, 1e-10))
    return per.agg(r6(F.avg(s)).alias("silhouette"), F.count("*").alias("sampled"))


#: What a score is worth where it has no meaning.
FAILED = {"silhouette": -1.0, "davies_bouldin": 999.0, "calinski_harabasz": 1.0}


def quality(df: DataFrame, d: int) -> dict[str, float]:
    """silhouette, davies_bouldin and calinski_harabasz of (vec_id, v, cluster_id); with one cluster, or every vector alone, the values of failures."""
    own = cut(centroids(df, d))
    k, n = own.agg(F.count("*"), F.sum("n")).first()
    if not 2 <= k < (n or 0):
        return dict(FAILED)
    found = {"silhouette": silhouette(df).first()[0], "davies_bouldin": davies_bouldin(df, own).first()[0], "calinski_harabasz": calinski_harabasz(df, own, d).first()[0]}
    return {c: FAILED[c] if x is None else float(x) for c, x in found.items()}


def memberships(df: DataFrame, centres: DataFrame, m: float = 2.0) -> DataFrame:
    """vec_id, cid, w, d2: w = 1 / sum_k (d / d_k)^(2 / (m - 1)); centres at distance 0 share all equally."""
    power = 1.0 / (m - 1.0)
    far = with_distance(df, centres)
    one = Window.partitionBy("vec_id")
    zero = F.sum((F.col("d2") < 1e-24).cast("int")).over(one)
    inverse = F.pow(1 / F.greatest(F.col("d2"), F.lit(1e-24)), power)
    w = F.when(zero > 0, (F.col("d2") < 1e-24).cast("double") / F.greatest(zero, F.lit(1))).otherwise(inverse / F.sum(inverse).over(one))
    return far.select("vec_id", "v", "cid", "d2", w.alias("w"))


def fuzzy_objective(members: DataFrame, m: float = 2.0) -> DataFrame:
    return members.agg(r6(F.sum(F.pow("w", F.lit(m)) * F.col("d2"))).alias("objective"))


def fuzzy_c_means(df: DataFrame, k: int, d: int, rounds: int = 20, tolerance: float = 1e-4, m: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(centres, labels by nearest centre). Each round is one job over the vectors; only K centres come to the driver."""
    session = df.sparkSession
    start = df.orderBy(order_hash("vec_id", seed="fcm"), "vec_id").limit(k).select("v").collect()
    now = [list(r["v"]) for r in start]
    for _ in range(rounds):
        centres = session.createDataFrame([(i, c) for i, c in enumerate(now)], "cluster_id long, c array<double>")
        w = F.pow("w", F.lit(m))
        rows = memberships(df, centres, m).groupBy("cid").agg(F.array(*[F.sum(w * F.col("v")[i]) / F.sum(w) for i in range(d)]).alias("c")).collect()
        new = list(now)
        for r in rows:
            new[r["cid"]] = list(r["c"])
        moved = max(abs(a - b) for x, y in zip(now, new, strict=True) for a, b in zip(x, y, strict=True))
        now = new
        if moved < tolerance:
            break
    centres = session.createDataFrame([(i, c) for i, c in enumerate(now)], "cluster_id long, c array<double>")
    return centres, nearest(df, centres)


def k_means(df: DataFrame, k: int, seed: int = 42, rounds: int = 20, unit: bool = False) -> DataFrame:
    """vec_id and cluster by MLlib k-means, on L2-normalised rows if ``unit``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = scale_rows(F.col("v")) if unit else F.col("v")
    ready = df.select("vec_id", array_to_vector(v).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=rounds).fit(ready).transform(ready).select("vec_id", F.col("prediction").cast("long").alias("cluster_id"))


def lloyd(df: DataFrame, start: list[list[float]], d: int, rounds: int = 20) -> tuple[list[list[float]], DataFrame]:
    """Lloyd's rounds from given centres; an empty one is set to the vector of smallest hash among those farthest from their centre."""
    session, now, before = df.sparkSession, [list(c) for c in start], None
    for _ in range(rounds):
        centres = session.createDataFrame(list(enumerate(now)), "cluster_id long, c array<double>")
        near = cut(nearest(df, centres))
        mark = near.agg(F.bit_xor(F.xxhash64("vec_id", "nearest"))).first()[0]
        if mark == before:
            break
        before = mark
        rows = df.drop("cluster_id").join(near.select("vec_id", F.col("nearest").alias("cluster_id")), "vec_id")
        found = {r["cluster_id"]: list(r["c"]) for r in centroids(rows, d).collect()}  # K rows
        missing = [i for i in range(len(now)) if i not in found]
        if missing:
            far = df.join(near.orderBy(F.desc("d2"), order_hash("vec_id")).limit(len(missing)), "vec_id").select("v").collect()
            found |= {i: list(r["v"]) for i, r in zip(missing, far, strict=False)}
        now = [found.get(i, now[i]) for i in range(len(now))]
    centres = session.createDataFrame(list(enumerate(now)), "cluster_id long, c array<double>")
    return now, nearest(df, centres)


def seed_by_distance(df: DataFrame, k: int, seed: str = "pp", weight: DataFrame | None = None) -> list[list[float]]:
    """Centres drawn in proportion to squared distance (times ``weight``), by exponential races on a hash."""
    return seeds_by_distance(df, k, [seed], weight)[0]


def seeds_by_distance(df: DataFrame, k: int, seeds: list[str], weight: DataFrame | None = None) -> list[list[list[float]]]:
    """The same for many seeds at once: a job draws the next centre of every start. Only the winners of a task leave it; chosen centres are broadcast."""
    import numpy as np
    import pandas as pd

    rows = df.select("vec_id", "v", F.lit(1.0).alias("weight")) if weight is None else df.select("vec_id", "v").join(weight.select("vec_id", "weight"), "vec_id")
    chosen: list[list[list[float]]] = [[] for _ in seeds]
    kind = df.schema["vec_id"].dataType.simpleString()
    for i in range(k):
        u = [(F.conv(F.substring(order_hash("vec_id", seed=f"{seed}{i}"), 1, 12), 16, 10).cast("double") + 1) / float((1 << 48) + 2) for seed in seeds]
        sent = df.sparkSession.sparkContext.broadcast([np.array(c) for c in chosen])

        def race(batches, sent=sent):
            best: dict[int, tuple] = {}
            for pdf in batches:
                if pdf.empty:
                    continue
                x, draws, base, ids = np.array(pdf.v.tolist(), float), np.array(pdf.u.tolist()), pdf.weight.to_numpy(float), pdf.vec_id.to_numpy()
                for s, centres in enumerate(sent.value):
                    w = base.copy()
                    if len(centres):
                        d2 = np.full(len(x), np.inf)
                        for c in centres:
                            d2 = np.minimum(d2, ((x - c) ** 2).sum(1))
                        w = w * d2
                    time = np.where(w > 0, -np.log(draws[:, s]) / np.where(w > 0, w, 1.0), np.inf)
                    n = np.lexsort((ids, time))[0]
                    one = (time[n], ids[n], pdf.v.iloc[n])
                    if s not in best or one[:2] < best[s][:2]:
                        best[s] = one
            if best:  # a task without rows has no winner, and an empty column of vectors no type
                yield pd.DataFrame({"s": list(best), "time": [b[0] for b in best.values()], "vec_id": [b[1] for b in best.values()], "v": [b[2] for b in best.values()]})

        won = rows.select("vec_id", "v", "weight", F.array(*u).alias("u")).mapInPandas(race, f"s int, time double, vec_id {kind}, v array<double>")
        for r in won.groupBy("s").agg(F.min_by("v", F.struct("time", "vec_id")).alias("v")).collect():  # one row a start
            chosen[r["s"]].append(list(r["v"]))
    return chosen


def gray_by_distance(df: DataFrame, centres: DataFrame, threshold: float) -> DataFrame:
    d = F.sqrt("d2")
    return nearest(df, centres).select("vec_id", r6(d).alias("dist"), (d > threshold).alias("is_gray"))


def gray_by_percentile(df: DataFrame, centres: DataFrame, q: float = 0.8) -> DataFrame:
    """Strictly above the exact percentile, interpolated linearly."""
    near = nearest(df, centres).withColumn("dist", r6(F.sqrt("d2")))
    limit = F.broadcast(near.agg(F.percentile("dist", F.lit(q)).alias("limit")))
    return near.crossJoin(limit).select("vec_id", "dist", (F.col("dist") > F.col("limit")).alias("is_gray"))


def gray_by_factor(features: DataFrame, k: int = 20, contamination: float | None = None) -> tuple[DataFrame, float]:
    """(vec_id, dist, is_gray) by local outlier factor, and the threshold: factors above 1.5, or above the exact quantile that leaves the share ``contamination``.

    The threshold lies half way between the smallest gray and the largest other factor (all or none gray: the mean).
    """
    n = features.count()
    factors = cut(local_outlier_factor(features, min(k, max(1, n - 1))))
    limit = 1.5 if contamination is None else factors.agg(F.percentile("lof", F.lit(1 - contamination))).first()[0]
    out = factors.select("vec_id", F.col("lof").alias("dist"), (F.col("lof") > F.lit(limit)).alias("is_gray"))
    low, high, mean = out.agg(F.min(F.when(F.col("is_gray"), F.col("dist"))), F.max(F.when(~F.col("is_gray"), F.col("dist"))), F.avg("dist")).first()
    return out, mean if low is None or high is None else (low + high) / 2


def gray_by_profile(profile: DataFrame, threshold: float = 3.0) -> DataFrame:
    """|z(mean)| + |z(std)| + |z(share of empty items)| of (user_id, mean, std, empty) at ``threshold`` or more."""
    from tastemill.operators.prepare import TINY

    names = ("mean", "std", "empty")
    stats = F.broadcast(profile.agg(*[F.avg(c).alias(f"{c}_m") for c in names], *[F.stddev_pop(c).alias(f"{c}_s") for c in names]))
    score = sum((F.abs(ratio(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s"), 0.0, TINY)) for c in names), F.lit(0.0))
    met = profile.crossJoin(stats).withColumn("score", r6(score))
    return met.select("user_id", "score", (F.col("score") >= threshold).alias("is_gray"))


def outlier_features(ratings: DataFrame, assignment: DataFrame) -> DataFrame:
    """user_id, v = (mean, share rated, std, mean absolute deviation from the cluster's item mean over all its members, zeros included)."""
    n = F.broadcast(ratings.select("item_id").distinct().agg(F.count("*").alias("_items")))
    members = assignment.groupBy("cluster_id").agg(F.count("*").alias("_members"))
    rows = ratings.join(assignment.select("user_id", "cluster_id"), "user_id")
    means = rows.groupBy("cluster_id", "item_id").agg(F.sum("rating").alias("_s")).join(F.broadcast(members), "cluster_id")
    met = rows.join(means, ["cluster_id", "item_id"]).withColumn("_dev", F.when(F.col("_members") > 1, F.abs(F.col("rating") - F.col("_s") / F.col("_members"))).otherwise(1.0))
    per = met.groupBy("user_id").agg(F.avg("rating").alias("a"), F.count("*").alias("b"), F.stddev_pop("rating").alias("c"), F.avg("_dev").alias("e"))
    full = assignment.select("user_id").join(per.crossJoin(n), "user_id", "left")
    v = F.array(F.coalesce("a", F.lit(0.0)), F.coalesce(F.col("b") / F.col("_items"), F.lit(0.0)), F.coalesce("c", F.lit(0.0)), F.coalesce("e", F.lit(1.0)))
    return full.select("user_id", v.alias("v"))


def k_nearest(df: DataFrame, k: int, block: int = 2048, most_pivots: int = 256, stretch: int = 1 << 20) -> DataFrame:
    """id, other, dist: the exact k nearest other vectors of each (ties at the k-th distance: smaller id).

    Vectors lie in cells around pivots, about one for ``block`` rows, and in blocks of that size inside a cell; a block
    is one row. The k-th distance inside a vector's own block bounds its k-th distance, and by the triangle inequality
    only cells that come nearer than that are asked. Blocks are shuffled once; then a task holds a block of queries and
    streams the checkpointed blocks past it, so comparisons may grow with the square but what is shuffled does not: k rows
    of a query for each ``stretch`` vectors, which are split over tasks only beyond that number.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    n = df.count()
    wanted = int(min(most_pivots, max(1, -(-n // block))))
    pivots = np.array([r["v"] for r in df.orderBy(order_hash("vec_id", seed="pivot"), "vec_id").limit(wanted).select("v").collect()], float).reshape(-1, len(df.first()["v"]) if n else 1)
    if not n:
        return df.sparkSession.createDataFrame([], "id long, other long, dist double")

    def far(x: np.ndarray) -> np.ndarray:
        return np.sqrt(((x[:, None, :] - pivots[None]) ** 2).sum(2)) if len(pivots) * x.size < 1 << 24 else np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)

    def place(batches):
        for pdf in batches:
            if len(pdf):
                d = far(np.array(pdf.v.tolist()))
                at = d.argmin(1)
                yield pd.DataFrame({"vec_id": pdf.vec_id, "v": pdf.v, "cell": at, "r": d[np.arange(len(d)), at]})

    placed = cut(df.select("vec_id", "v").mapInPandas(place, "vec_id long, v array<double>, cell int, r double"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("m"), F.max("r").alias("radius")).orderBy("cell").collect()  # at most ``most_pivots`` rows
    parts = {r["cell"]: max(1, -(-r["m"] // block)) for r in cells}
    radius = np.full(len(pivots), np.inf)
    radius[[r["cell"] for r in cells]] = [r["radius"] for r in cells]
    count = F.create_map(*[F.lit(x) for c, m in parts.items() for x in (c, m)])
    rows = placed.withColumn("b", F.pmod(F.xxhash64("vec_id"), count[F.col("cell")]).cast("int"))

    def meet(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, up: np.ndarray, near: np.ndarray, dist: np.ndarray) -> None:
        """``near`` and ``dist``, the k nearest so far of each row of ``x`` (infinite: none), once ``y`` is seen too; nothing beyond ``up`` is looked for."""
        q = (y * y).sum(1)
        step = max(1, (1 << 19) // len(y))
        for lo in range(0, len(x), step):
            part, own = x[lo : lo + step], ids[lo : lo + step]
            size = (part * part).sum(1)
            rough = np.maximum(size[:, None] - 2 * part @ y.T + q, 0)
            rough[own[:, None] == others[None, :]] = np.inf
            limit = np.minimum(up[lo : lo + step], dist[lo : lo + step, -1]) ** 2
            unbound = np.flatnonzero(~np.isfinite(limit))
            if len(unbound) and len(y) > k:
                limit[unbound] = np.partition(rough[unbound], k - 1, axis=1)[:, k - 1]
            # the expanded square is blurred by rounding, so the nearest are measured again
            limit = np.fmin(limit + 1e-9 * (1 + q.max() + size), np.finfo(float).max)
            i, j = np.nonzero(rough <= limit[:, None])
            if not len(i):
                continue
            d = np.concatenate([np.sqrt(((y[j[s : s + 65536]] - part[i[s : s + 65536]]) ** 2).sum(1)) for s in range(0, len(i), 65536)])
            hit = np.unique(i)
            at, d, o = np.concatenate([np.repeat(hit, k), i]), np.concatenate([dist[lo + hit].ravel(), d]), np.concatenate([near[lo + hit].ravel(), others[j]])
            order = np.lexsort((o, d, at))
            first = order[np.searchsorted(at[order], hit)[:, None] + np.arange(k)]
            dist[lo + hit], near[lo + hit] = d[first], o[first]

    def none_yet(m: int) -> tuple[np.ndarray, np.ndarray]:
        return np.full((m, k), np.iinfo(np.int64).max), np.full((m, k), np.inf)

    def reach(x: np.ndarray) -> np.ndarray:
        return far(x) - radius

    def in_reach(gap: np.ndarray, up: np.ndarray) -> np.ndarray:
        return gap <= up * (1 + 1e-9) + 1e-12

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.array(pdf.v.tolist(), float), pdf.vec_id.to_numpy(np.int64)
        near, dist = none_yet(len(x))
        meet(ids, x, ids, x, np.full(len(x), np.inf), near, dist)
        up = dist[:, -1].copy()
        asked = [c for c in np.flatnonzero(in_reach(reach(x), up[:, None]).any(0)).tolist() if c in parts]
        return pd.DataFrame({"cell": [int(pdf.cell.iloc[0])], "b": [int(pdf.b.iloc[0])], "ids": [ids.tobytes()], "x": [x.tobytes()], "up": [up.tobytes()], "asked": [asked]})

    n_blocks = sum(parts.values())
    blocks = cut(rows.select("vec_id", "v", "cell", "b").repartition(n_blocks, "cell", "b").groupBy("cell", "b").applyInPandas(pack, "cell int, b int, ids binary, x binary, up binary, asked array<int>"))
    queries = blocks.select(F.col("cell").alias("q_cell"), F.col("b").alias("q_b"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), "up", "asked")
    streamed = blocks.select("cell", "ids", "x").coalesce(-(-n // stretch))

    def scan(batches):
        held: dict[tuple, tuple] = {}  # the few blocks of queries of this task
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                key = row["q_cell"].as_py(), row["q_b"].as_py()
                if key not in held:
                    ids, up = (np.frombuffer(row[c].as_buffer(), t).copy() for c, t in (("q_ids", np.int64), ("up", float)))
                    x = np.frombuffer(row["q_x"].as_buffer(), float).reshape(len(ids), -1).copy()
                    held[key] = (ids, x, up, reach(x), *none_yet(len(ids)))
                ids, x, up, gap, near, dist = held[key]
                up = np.minimum(up, dist[:, -1])
                ask = np.flatnonzero(in_reach(gap[:, row["cell"].as_py()], up))
                if len(ask):
                    others = np.frombuffer(row["ids"].as_buffer(), np.int64)
                    y = np.frombuffer(row["x"].as_buffer(), float).reshape(len(others), -1)
                    some, at = near[ask], dist[ask]
                    meet(ids[ask], x[ask], others, y, up[ask], some, at)
                    near[ask], dist[ask] = some, at
        for ids, _, _, _, near, dist in held.values():
            i, j = np.nonzero(np.isfinite(dist))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(near[i, j]), pa.array(dist[i, j])], ["id", "other", "dist"])

    # every task has one partition of queries and reads the streamed side past it; neither is shuffled or broadcast
    met = streamed.hint("shuffle_replicate_nl").join(queries, F.array_contains("asked", F.col("cell"))).drop("asked")
    found = met.mapInArrow(scan, "id long, other long, dist double")
    top = Window.partitionBy("id").orderBy("dist", "other")
    return found.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k).drop("_n")


def local_outlier_factor(df: DataFrame, k: int = 20, block: int = 2048) -> DataFrame:
    """vec_id, lof by exact k nearest neighbours (ties at the k-th distance: smaller id)."""
    knn = cut(k_nearest(df, k, block))
    reach = knn.groupBy("id").agg(F.max("dist").alias("kdist"))
    density = knn.join(reach.toDF("other", "kd"), "other").groupBy("id").agg((1 / (F.avg(F.greatest("kd", "dist")) + 1e-10)).alias("lrd"))
    out = knn.join(density.toDF("other", "lrd_o"), "other").join(density, "id").groupBy("id").agg((F.avg("lrd_o") / F.first("lrd")).alias("lof"))
    return out.withColumnRenamed("id", "vec_id")
