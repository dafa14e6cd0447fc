"""N-gram Jaccard join: MinHash banding for candidates, Bayesian pruning, exact verification.

Texts are sets of hashed runs of ``WIDTH`` words (lower case, cut at white
space). Texts with equal sets are one class, so exact copies are never compared.
Each class has ``HASHES`` MinHash values of 16 bits; four of them are a band, and
classes that share a band are candidates (a pair at similarity 0.8 shares none of
the 20 bands once in 38,000; at 0.9 once in 10^9).

Candidates are compared a few values at a time. With m of n values equal and a
uniform prior, the similarity s has a Beta(m + 1, n - m + 1) posterior; the pair
is dropped as soon as P(s >= threshold) falls below ``TOLERANCE``. The pairs that
survive join classes into candidate components, inside which every pair is
pruned the same way and the rest is verified exactly on the whole sets.

Pairs exist only inside a task, as array indices. Buckets and components are
dealt out as pairs of chunks of ``GROUP`` members, those of up to ``FEW * FEW_GROUP``
members in smaller chunks (at most ``FEW``), so a task holds two chunks at
most; what leaves a task is a spanning forest and link counts, both linear in
the members. A component of m different texts still costs m^2 comparisons in
all: that is what counting its links exactly takes, spread over its chunk pairs.
Components are found by large-star / small-star rounds; nothing is collected.
Joins by bucket, root and class treat hot keys apart (``join_hot``).

Result: one row per document: doc_id, class_id (smallest id among all documents
it is linked to, directly or through others, and itself) and n_links (documents
at ``threshold`` or more, copies included).

Defined results
* null, empty or blank text: no shingles, no links, a class of its own;
* fewer words than ``WIDTH``: all of them are one shingle;
* repeated rows count as copies of each other, under one id;
* rows without an id: linked by text like any other; class_id is the smallest id
  there is in their class, or null;
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, column, components, cut, gram_hashes, group_starts, join_hot, spread, table, whole_groups

WIDTH, THRESHOLD = 5, 0.8
HASHES, BAND = 80, 4
BANDS = HASHES // BAND
TOLERANCE = 1e-5
STEP = 16
#: Classes of a chunk, and shingles of one.
GROUP, GROUP_SHINGLES = 1024, 2_000_000
#: Members of a chunk of a smaller group, and the most such chunks; they spread the work and change no result.
FEW_GROUP, FEW = 128, 16
#: Pairs compared at a time.
SLAB = 400_000
#: Cells of the matrix that counts common shingles.
CELLS = 4_000_000


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.RandomState(80)
    return (draw.randint(0, 1 << 31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)), draw.randint(0, 1 << 31, HASHES).astype(np.uint32)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [t.lower().split() if t else [] for t in texts]
    codes, distinct = pd.factorize(np.array([w for ws in words for w in ws] or [""], dtype=object))
    hashes = pd.util.hash_array(distinct, categorize=False)[codes]
    out, at = [], 0
    for ws in words:
        out.append(np.unique(gram_hashes(hashes[at : at + len(ws)], width)))
        at += len(ws)
    return out


def min_hashes(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """HASHES values of 16 bits."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    half = (grams >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(half), 4096):
        low = np.minimum(low, (a[:, None] * half[None, k : k + 4096] + b[:, None]).min(1))
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, m): fewer than m equal values among n mean P(similarity >= threshold) < tolerance."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        # P(s >= t | m, n) under a uniform prior is a binomial tail
        tails = np.cumsum([comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(n + 1)])
        out.append((n, int(np.searchsorted(tails, tolerance))))
    return out


def prune(sigs: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that the posterior does not rule out, value block by value block."""
    out_a, out_b = [], []
    for k in range(0, len(a), SLAB):
        x, y = a[k : k + SLAB], b[k : k + SLAB]
        equal, done = np.zeros(len(x), np.int64), 0
        for n, m in least:
            equal = equal + (sigs[x, done:n] == sigs[y, done:n]).sum(1)
            live = equal >= m
            x, y, equal, done = x[live], y[live], equal[live], n
        out_a.append(x)
        out_b.append(y)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (a[:0], b[:0])


def pair_slabs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs inside the groups, some SLAB of them at a time (one group alone may have more)."""
    upto = np.cumsum(sizes * (sizes - 1) // 2)
    slab = upto // SLAB
    for s in np.unique(slab).tolist():
        own = slab == s
        a, b = [], []
        for size in np.unique(sizes[own]).tolist():
            i, j = np.triu_indices(size, 1)
            base = starts[own & (sizes == size)][:, None]
            a.append((base + i).ravel())
            b.append((base + j).ravel())
        yield np.concatenate(a), np.concatenate(b)


def common_counts(grams: list[np.ndarray]) -> np.ndarray:
    """Common shingles of all pairs of sets, by products of 0/1 slices over the shingles that any two share."""
    n = len(grams)
    owner = np.repeat(np.arange(n), [len(g) for g in grams])
    _, place, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = count > 1
    cols = np.cumsum(shared) - 1
    live = shared[place]
    owner, col = owner[live], cols[place[live]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    out = np.zeros((n, n), np.float32)
    width = max(64, CELLS // n)
    for lo in range(0, int(shared.sum()), width):
        first, last = np.searchsorted(col, [lo, lo + width])
        slice_ = np.zeros((n, int(col[last - 1]) - lo + 1), np.float32)
        slice_[owner[first:last], col[first:last] - lo] = 1
        out += slice_ @ slice_.T
    return out


def sign(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, th (hash of the text), c (128 bits of the shingle set; null: no shingles), n, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients()
        for batch in chunks(batches):
            sets = shingle_sets(column(batch, "text"), width)
            keys = [np.array([np.bitwise_xor.reduce(g), (g * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(7)).sum(dtype=np.uint64)]).tobytes() if len(g) else None for g in sets]
            sigs = [min_hashes(g, a, b).view(np.int64) if len(g) else np.empty(0, np.int64) for g in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(keys, pa.binary()), pa.array([len(g) for g in sets], pa.int32()), pa.array(sigs, pa.list_(pa.int64()))],
                names=["doc_id", "th", "c", "n", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, c binary, n int, sig array<long>")


def chunk_pairs(df: DataFrame, chunk_count) -> DataFrame:
    """Each member with its chunk k, once for each pair of chunks (i, j) that its chunk is in."""
    k = F.pmod(F.xxhash64("c"), F.col("_chunks")).cast("int")
    df = df.withColumn("_chunks", chunk_count.cast("int")).withColumn("k", k)
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    return df.withColumns({"i": F.least("k", "_other"), "j": F.greatest("k", "_other")}).drop("_other")


def chunks_of(members):
    return F.greatest(F.ceil(members / F.lit(GROUP)), F.least(F.ceil(members / F.lit(FEW_GROUP)), F.lit(FEW)))


def candidate_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """A spanning forest of the pairs that share a band and survive pruning."""
    least = least_matches(threshold)
    bands = classes.select("c", F.posexplode("sig").alias("band", "v")).select("c", "band", F.xxhash64("band", "v").alias("bucket"))
    full = bands.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    met = join_hot(bands, full.withColumn("n", F.col("m")), "bucket", ["m"], F.xxhash64("c", "band", "bucket"))
    members = met.join(classes.select("c", "sig"), "c")
    dealt = chunk_pairs(members, chunks_of(F.col("m"))).select("bucket", "i", "j", "k", "band", "c", "sig")
    keys = ["bucket", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, keys):
            starts = group_starts(rows, keys)
            sizes = np.diff(np.append(starts, rows.num_rows))
            packed = rows.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            sigs = packed.view(np.uint16)
            cross = rows.column("i").to_numpy() != rows.column("j").to_numpy()
            k, band = rows.column("k").to_numpy(), rows.column("band").to_numpy()
            label = np.arange(rows.num_rows)
            for a, b in pair_slabs(starts, sizes):
                live = ~cross[a] | (k[a] != k[b])  # pairs inside a chunk belong to (i, i)
                a, b = a[live], b[live]
                for s in range(0, len(a), SLAB):
                    x, y = a[s : s + SLAB], b[s : s + SLAB]
                    first = (packed[x] == packed[y]).argmax(1) == band[x]  # each pair once: in the first band it shares
                    x, y = prune(sigs, x[first], y[first], least)
                    own, flat = np.unique(np.concatenate([label[x], label[y]]), return_inverse=True)
                    if len(own):
                        merged = own[spread(len(own), flat[: len(x)], flat[len(x) :])]
                        new = np.arange(rows.num_rows)
                        new[own] = merged
                        label = new[label]
            at = np.flatnonzero(label != np.arange(rows.num_rows))
            c = rows.column("c")
            yield pa.RecordBatch.from_arrays([c.take(pa.array(at)).combine_chunks(), c.take(pa.array(label[at])).combine_chunks()], names=["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary")


def verified_links(docs: DataFrame, members: DataFrame, threshold: float, width: int) -> DataFrame:
    """c, other (of its linked part), links, multi. ``members``: c, root, copies, n, sig, and doc_id and th of one of its rows."""
    least = least_matches(threshold)
    sums = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("s")).withColumn("n", F.col("m"))
    chunk_count = F.greatest(chunks_of(F.col("m")), F.ceil(F.col("s") / GROUP_SHINGLES))
    dealt = join_hot(members, sums, "root", ["m", "s"], F.unhex(F.md5(F.concat("root", "c")))).select("root", "c", "copies", "sig", F.col("doc_id").alias("_id"), F.col("th").alias("_th"), chunk_count.cast("int").alias("chunks"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    met = texts.join(dealt.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("root", "c", "copies", "sig", "chunks", "text")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = pa.array([g.tobytes() for g in shingle_sets(column(batch, "text"), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("root", "c", "copies", "sig", "chunks")), sets], names=["root", "c", "copies", "sig", "chunks", "grams"])

    sets = met.mapInArrow(shingles, "root binary, c binary, copies long, sig array<long>, chunks int, grams binary")
    keys = ["g", "i", "j"]
    paired = chunk_pairs(sets, F.col("chunks")).select(F.xxhash64("root").alias("g"), "i", "j", "k", "root", "c", "copies", "sig", "chunks", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, keys):
            starts = group_starts(rows, keys)
            ends = np.append(starts[1:], rows.num_rows)
            out = []
            for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
                part = rows.slice(lo, hi - lo)
                names = part.column("c").to_pylist()
                once = [at for name, at in {n: i for i, n in enumerate(names)}.items()]  # repeated rows of a document
                part = part.take(pa.array(once))
                names = [names[i] for i in once]
                grams = [np.frombuffer(g, np.uint64) for g in part.column("grams").to_pylist()]
                sigs = part.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, BANDS).view(np.uint16)
                k, copies = part.column("k").to_numpy(), part.column("copies").to_numpy()
                a, b = np.triu_indices(len(once), 1)
                if part.column("i")[0] != part.column("j")[0]:
                    live = k[a] != k[b]
                    a, b = a[live], b[live]
                a, b = prune(sigs, a, b, least)
                if not len(a):
                    continue
                same = common_counts(grams)[a, b].astype(np.int64)
                n = np.array([len(g) for g in grams])
                linked = same >= threshold * (n[a] + n[b] - same) - 1e-9
                a, b = a[linked], b[linked]
                label = spread(len(once), a, b)
                links = np.bincount(a, copies[b], len(once)) + np.bincount(b, copies[a], len(once))
                multi = part.column("chunks")[0].as_py() > 1
                out += [(names[x], names[label[x]], int(links[x]), multi) for x in np.flatnonzero(links).tolist()]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["c", "other", "links", "multi"])

    return paired.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "c binary, other binary, links long, multi boolean")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """doc_id, th (hash of the text), class_id, class_th (hash of a text that stands for the class under that id), part, n_links of every row.

    ``part`` tells classes apart, also those of one class_id; it is null for texts without shingles.
    """
    signed = cut(sign(docs, width))
    full = signed.where("c IS NOT NULL")
    # of the rows of a class, the one with the largest (id, hash of text) lends its text; nulls sort first
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    classes = cut(full.groupBy("c").agg(first.alias("rep"), F.count("*").alias("copies"), F.max(F.struct("doc_id", "th")).alias("row"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    parts = components(candidate_edges(classes, threshold))
    members = parts.withColumnRenamed("node", "c").join(classes, "c").select("c", "root", "copies", "n", "sig", F.col("row.doc_id").alias("doc_id"), F.col("row.th").alias("th"))
    linked = cut(verified_links(docs, members, threshold, width))
    labels = linked.where("NOT multi").select("c", F.col("other").alias("root"), "links")
    large = linked.where("multi")
    if not large.isEmpty():
        roots = components(large.select(F.col("c").alias("a"), F.col("other").alias("b")))
        labels = labels.unionAll(large.groupBy("c").agg(F.sum("links").alias("links")).join(roots, F.col("c") == F.col("node")).select("c", "root", "links"))
    labels = cut(labels.join(classes.select("c", "rep"), "c"))
    heads = labels.groupBy("root").agg(F.min("rep").alias("head"), F.count("*").alias("n"))
    labels = join_hot(labels, heads, "root", ["head"], F.unhex(F.md5(F.concat("root", "c")))).select(F.col("c").alias("_c"), "head", "root", "links")
    known = classes.select("c", "rep", "copies").join(labels, F.col("c") == F.col("_c"), "left")
    known = cut(known.select("c", F.coalesce("head", "rep").alias("head"), F.coalesce("root", "c").alias("part"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("copies").alias("n")))
    spare = F.unhex(F.md5(F.concat_ws("|", F.hex("c"), "doc_id", "th")))
    found = join_hot(full.select("doc_id", "th", "c"), known, "c", ["head", "part", "n_links"], spare)
    found = found.select("doc_id", "th", F.col("head.doc_id").alias("class_id"), F.col("head.th").alias("class_th"), "part", "n_links")
    alone = signed.where("c IS NULL").select("doc_id", "th", F.col("doc_id").alias("class_id"), F.col("th").alias("class_th"), F.lit(None).cast("binary").alias("part"), F.lit(0).cast("long").alias("n_links"))
    return found.unionAll(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each class: of the smallest id, then the smallest hash of the text; rows without an id come last.

    Rows that share an id but not a class are judged apart. Of rows alike in id and text one
    stays (they are one class). Texts without words are no copies of each other: all stay.
    """
    found = cut(near_duplicates(docs, threshold, width).where("part IS NOT NULL").select("doc_id", "th", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th"))).alias("head")))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"))
    at = F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_th") == F.col("_gone_th"))
    # a pair of id and hash of the text has one class, so its rows are all heads or all copies
    gone = found.where("NOT head").select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct()
    kept = rows.join(gone.hint("shuffle_hash"), at, "left_anti")
    again = found.where("head").groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th"))
    again = cut(again)
    if not again.isEmpty():
        once = kept.join(again, at, "left_semi").groupBy("_id", "_th").agg(F.first("_row").alias("_row")).select("_row", "_id", "_th")
        kept = kept.join(again, at, "left_anti").unionAll(once)
    return kept.select("_row.*")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
