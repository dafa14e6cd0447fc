"""What the operators share: reading, cutting lineage, and walking Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one step of a Python worker holds in memory at a time (one longer text is a step of its own).
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(session: SparkSession) -> str:
    """The folder that all executors share: what the context has, else ``spark.checkpoint.dir``; on a local master, as in tests, one of our own."""
    context = session.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = session.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a folder that driver and executors share is needed")
        folder = tempfile.mkdtemp(prefix="tastemill-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each (a longer text comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (public splitmix64 constants), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[str]) -> np.ndarray:
    """A stable 64-bit hash of each word; each distinct word is hashed once."""
    if not words:
        return np.empty(0, np.uint64)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(distinct, categorize=False)[codes]


#: Odd multiplier of the rolling combination of word hashes.
ROLL = 0x9E3779B97F4A7C15


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words; of all words together if there are fewer (none: empty)."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(width, n)
    out = hashes[: n - width + 1].copy()
    for k in range(1, width):
        out = out * np.uint64(ROLL) + hashes[k : n - width + 1 + k]
    return mix64(out + np.uint64(width))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that arrive sorted by integer keys, dealt out so that no group is torn; a group is all that is held beyond a batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        same = np.ones(rows.num_rows, bool)
        for key in keys:
            values = rows.column(key).to_numpy()
            same &= values == values[-1]
        start = int(np.argmax(same))  # the last group starts here
        held = rows.slice(start)
        if start:
            yield rows.slice(0, start)
    if held is not None:
        yield held


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(rows.num_rows, bool)
    change[:1] = True
    for key in keys:
        values = rows.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def spread(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Connected components of 0..n-1 under the pairs (a, b): each one's smallest member."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


#: A key is hot if it has more than one of this many parts of all rows; so there are fewer hot keys than this.
HOT_PARTS = 1000


def join_hot(rows: DataFrame, known: DataFrame, key: str, values: list[str], spare: Column, total: int | None = None) -> DataFrame:
    """``rows`` with the ``values`` of ``known`` (one row for each key, and ``n``, its rows in ``rows``); rows of other keys go.

    Hot keys, fewer than HOT_PARTS by definition, are broadcast. Their rows then
    travel under ``spare``, a hash of the whole row, which spreads them and
    matches no key; all other keys meet in an ordinary join.
    """
    total = total if total is not None else known.agg(F.sum("n")).first()[0] or 0
    hot = known.where(F.col("n") * HOT_PARTS > total).select(F.col(key).alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values])
    cold = known.where(F.col("n") * HOT_PARTS <= total).select(F.col(key).alias("_cold"), *[F.col(v).alias(f"_cold_{v}") for v in values])
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_at", F.when(F.col("_hot").isNotNull(), spare).otherwise(F.col(key)))
    met = met.join(cold, F.col("_at") == F.col("_cold"), "left").where("_hot IS NOT NULL OR _cold IS NOT NULL")
    return met.select(*rows.columns, *[F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), by alternating large-star and small-star rounds.

    Each round is joins and partial aggregates over edges; no neighbourhood is
    collected. Rounds grow with the logarithm of a component's size.
    """
    one, two = F.greatest("a", "b"), F.least("a", "b")
    now = cut(edges.where("a <> b").select(one.alias("u"), two.alias("v")).distinct())
    spare = F.unhex(F.md5(F.concat("u", "v"))) if now.schema["u"].dataType.typeName() == "binary" else F.xxhash64("u", "v")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # the root of a large component is a hot key
        large = join_hot(both, least, "u", ["m"], spare, 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()  # a node that meets one root through many others; equal rows would also share their spare key
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # so is a node that many others point to
        small = join_hot(large, low, "u", ["m"], spare, 2 * mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
