"""Vectors with a place for each item, held as what they have: (vec_id, ids, vals), places rising, all others 0.

No dense row is made for a user. Against centroids that fit a broadcast, batches are scored
as compressed rows: the values of a batch times the centroids' columns, summed per row.
Centroids too large for that stay a table (cluster_id, dim, value) and meet the cells by
place; sums per vector and centroid follow from the cells alone, since a squared distance is
|x|^2 - 2 x c + |c|^2. Both give the same labels (ties: the first centroid).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions.scalars import order_hash
from tastemill.operators.iterate import cut

#: Numbers of all centroids together up to which they are broadcast, and products that a task holds at a time.
SMALL, STEP = 4_000_000, 4_000_000


def is_sparse(df: DataFrame) -> bool:
    return "ids" in df.columns


def from_cells(cells: DataFrame) -> DataFrame:
    """cells: vec_id, dim, value (each place once). A vector's cells meet in one row; there are no more than places."""
    both = F.array_sort(F.collect_list(F.struct(F.col("dim").cast("int").alias("i"), F.col("value").cast("double").alias("x"))))
    return cells.groupBy("vec_id").agg(both.alias("_c")).select("vec_id", F.transform("_c", lambda s: s["i"]).alias("ids"), F.transform("_c", lambda s: s["x"]).alias("vals"))


def cells_of(df: DataFrame) -> DataFrame:
    """vec_id, dim, value, and what else the frame has."""
    rest = [c for c in df.columns if c not in ("ids", "vals")]
    return df.select(*rest, F.posexplode("ids").alias("_p", "dim"), "vals").select(*rest, "dim", F.get("vals", F.col("_p")).alias("value"))


def unit(df: DataFrame) -> DataFrame:
    norm = F.sqrt(F.aggregate("vals", F.lit(0.0), lambda s, x: s + x * x))
    return df.withColumn("vals", F.when(norm > 0, F.transform("vals", lambda x: x / F.when(norm > 0, norm))).otherwise(F.col("vals")))


def long_form(centres: DataFrame) -> DataFrame:
    """(cluster_id, dim, value) of (cluster_id, c): what is not 0."""
    return centres.select("cluster_id", F.posexplode("c").alias("dim", "value")).where("value <> 0")


def centroids(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster_id, dim, value: means over all members, zeros included."""
    n = labels.groupBy("cluster_id").agg(F.count("*").alias("_n"))
    sums = cells.join(labels, "vec_id").groupBy("cluster_id", "dim").agg(F.sum("value").alias("_s"))
    return sums.join(F.broadcast(n), "cluster_id").select("cluster_id", "dim", (F.col("_s") / F.col("_n")).alias("value"))


def times(ids: np.ndarray, vals: np.ndarray, sizes: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Compressed rows times a (places x k) table."""
    out, ends = np.zeros((len(sizes), across.shape[1])), np.cumsum(sizes)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(vals[:, None] * across[ids], (ends - sizes)[full], axis=0)
    return out


def distances(df: DataFrame, centres: DataFrame, k: int, d: int) -> DataFrame:
    """vec_id, d2: squared distances to centroids 0..k-1 as an array. ``centres``: cluster_id, dim, value."""
    if k * d > SMALL:
        return distances_by_join(df, centres, k)
    table = np.zeros((d, k))
    for r in centres.collect():  # at most k d numbers, and SMALL
        table[r["dim"], r["cluster_id"]] = r["value"]
    sent = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = (sent.value**2).sum(0)
        for batch in batches:
            sizes = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(sizes) - 1) * k // STEP
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                rows = batch.slice(lo, hi - lo)
                ids, vals = (rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "vals"))
                own = times(ids, vals, sizes[lo:hi], sent.value)
                square = times(ids, vals * vals, sizes[lo:hi], np.ones((d, 1)))
                d2 = np.maximum(square - 2 * own + norm, 0.0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d2.size + 1, k), pa.int32()), pa.array(d2.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), lists], names=["vec_id", "d2"])

    kind = df.schema["vec_id"].dataType.simpleString()
    return df.select("vec_id", "ids", "vals").mapInArrow(run, f"vec_id {kind}, d2 array<double>")


def distances_by_join(df: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """The same where centroids are a table: cells meet them by place; only centroids that share a place make rows."""
    norms = centres.groupBy("cluster_id").agg(F.sum(F.col("value") * F.col("value")).alias("_q"))
    every = F.broadcast(norms.agg(F.map_from_entries(F.collect_list(F.struct("cluster_id", "_q"))).alias("_norms")))  # k rows
    own = df.select("vec_id", F.aggregate("vals", F.lit(0.0), lambda s, x: s + x * x).alias("_x"))
    met = cells_of(df.select("vec_id", "ids", "vals")).join(centres.select("cluster_id", "dim", F.col("value").alias("_c")), "dim")
    dots = met.groupBy("vec_id", "cluster_id").agg(F.sum(F.col("value") * F.col("_c")).alias("_d"))
    dots = dots.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("cluster_id", "_d"))).alias("_dots"))
    zero = F.lit(0.0)

    def at(name: str, i: Column) -> Column:
        return F.coalesce(F.try_element_at(name, i), zero)

    d2 = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.greatest(F.col("_x") - 2 * at("_dots", i.cast("long")) + at("_norms", i.cast("long")), zero))
    return own.join(dots, "vec_id", "left").crossJoin(every).select("vec_id", d2.alias("d2"))


def nearest(df: DataFrame, centres: DataFrame, k: int, d: int) -> DataFrame:
    """vec_id, nearest, d2 (ties: the first)."""
    least = F.array_min("d2")
    return distances(df, centres, k, d).select("vec_id", (F.array_position("d2", least) - 1).cast("long").alias("nearest"), least.alias("d2"))


def members_as_centres(df: DataFrame, chosen: list) -> DataFrame:
    """The vectors of these ids as centroids 0, 1, ..."""
    order = df.sparkSession.createDataFrame(list(enumerate(chosen)), f"cluster_id long, vec_id {df.schema['vec_id'].dataType.simpleString()}")
    return cells_of(df.select("vec_id", "ids", "vals").join(F.broadcast(order), "vec_id")).select("cluster_id", "dim", "value").where("value <> 0")


def seed_by_distance(df: DataFrame, k: int, d: int, seed: str = "pp") -> DataFrame:
    """Centroids drawn in proportion to squared distance by races on a hash, the same races as for dense vectors; only ids come to the driver."""
    chosen: list = []
    for i in range(k):
        u = (F.conv(F.substring(order_hash("vec_id", seed=f"{seed}{i}"), 1, 12), 16, 10).cast("double") + 1) / float((1 << 48) + 2)
        rows = df.select("vec_id", F.lit(1.0).alias("w")) if not chosen else distances(df, members_as_centres(df, chosen), len(chosen), d).select("vec_id", F.array_min("d2").alias("w"))
        race = F.when(F.col("w") > 0, -F.log(u) / F.when(F.col("w") > 0, F.col("w")))
        chosen.append(rows.orderBy(F.asc_nulls_last(race), "vec_id").first()["vec_id"])
    return cut(members_as_centres(df, chosen))


def lloyd(df: DataFrame, start: DataFrame, k: int, d: int, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(centroids (cluster_id, dim, value), labels (vec_id, nearest, d2)) by Lloyd's rounds; an empty one takes a vector of those farthest from their centroid."""
    now, before, cells = start, None, cells_of(df.select("vec_id", "ids", "vals"))
    for _ in range(rounds):
        near = cut(nearest(df, now, k, d))
        mark = near.agg(F.bit_xor(F.xxhash64("vec_id", "nearest"))).first()[0]
        if mark == before:
            break
        before = mark
        used = {r["nearest"] for r in near.select("nearest").distinct().collect()}  # k rows
        missing = [i for i in range(k) if i not in used]
        new = centroids(cells, near.select("vec_id", F.col("nearest").alias("cluster_id"))).where("value <> 0")
        if missing:
            far = [r["vec_id"] for r in near.orderBy(F.desc("d2"), order_hash("vec_id")).limit(len(missing)).select("vec_id").collect()]
            names = F.array(*[F.lit(x) for x in missing])
            new = new.unionByName(members_as_centres(df, far).withColumn("cluster_id", F.get(names, F.col("cluster_id")).cast("long")))
        now = cut(new)
    return now, nearest(df, now, k, d)


def fuzzy_c_means(df: DataFrame, k: int, d: int, rounds: int = 20, tolerance: float = 1e-4, m: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(centroids (cluster_id, dim, value), memberships (vec_id, cluster_id, w)), as for dense vectors."""
    first = [r["vec_id"] for r in df.orderBy(order_hash("vec_id", seed="fcm"), "vec_id").limit(k).select("vec_id").collect()]
    now, cells = cut(members_as_centres(df, first)), cells_of(df.select("vec_id", "ids", "vals"))
    for _ in range(rounds):
        w = memberships(df, now, k, d, m).withColumn("_w", F.pow("w", F.lit(m)))
        total = w.groupBy("cluster_id").agg(F.sum("_w").alias("_t"))
        sums = cells.join(w, "vec_id").groupBy("cluster_id", "dim").agg(F.sum(F.col("_w") * F.col("value")).alias("_s"))
        new = cut(sums.join(F.broadcast(total), "cluster_id").select("cluster_id", "dim", (F.col("_s") / F.col("_t")).alias("value")))
        both = new.join(now.withColumnRenamed("value", "_old"), ["cluster_id", "dim"], "full")
        moved = both.agg(F.max(F.abs(F.coalesce("value", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0))))).first()[0] or 0.0
        now = new
        if moved < tolerance:
            break
    return now, memberships(df, now, k, d, m)


def memberships(df: DataFrame, centres: DataFrame, k: int, d: int, m: float = 2.0) -> DataFrame:
    """vec_id, cluster_id, w: each vector's shares, from its own distances alone."""
    power = 1.0 / (m - 1.0)
    zero = F.transform("d2", lambda x: (x < 1e-24).cast("double"))
    inverse = F.transform("d2", lambda x: F.pow(1 / F.greatest(x, F.lit(1e-24)), power))
    raw = F.when(F.array_max(zero) > 0, zero).otherwise(inverse)
    one = distances(df, centres, k, d).select("vec_id", raw.alias("_r")).withColumn("_t", F.aggregate("_r", F.lit(0.0), lambda s, x: s + x))
    return one.select("vec_id", "_t", F.posexplode("_r").alias("_c", "_x")).select("vec_id", F.col("_c").cast("long").alias("cluster_id"), (F.col("_x") / F.col("_t")).alias("w"))
