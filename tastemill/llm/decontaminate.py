"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A benchmark item of n words is looked for in windows of n words. A window gets a
128-bit SimHash of its weighted 5-word shingles; the fingerprints of the items
stand in an index of 8 blocks of 16 bits. Two fingerprints within ``RADIUS`` = 39
bits differ by at most 4 bits in some block, so probing every block for values
within 4 bits finds all of them. Each candidate is verified by the exact weighted
Jaccard similarity of the shingle counts (sum of minima over sum of maxima).

An item of g shingles and a window that match share at least ``SIMILARITY`` g of them,
so the window holds one of any g - SIMILARITY g + 1 of the item's shingles. Texts are
looked through for the rarest ones of each item only, which shingles that many items
share are not; so a frequent shingle does not multiply with the items that have it.
Where one is found, all windows of the text are looked at with running counts of the
shingles that are the item's: a window with fewer than the similarity asks for cannot
match, and all others are fingerprinted (windows of equal shingles once), whatever the
order of their words. So this loses nothing.

Benchmarks are taken in parts of at most ``PART_CHARS`` characters, so what is
broadcast is bounded; documents are only read, never shuffled.

Words are runs of letters and digits in lower case. An item of fewer than five
words is one shingle and must occur as it is.

Defined results
* null or empty text, item without words: no match;
* a text shorter than the item is compared as a whole;
* several windows of a text that match an item: one row, the most similar (then first) window;
* repeated rows of either table give repeated rows; empty tables give no rows;
  further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, column, gram_hashes, mix64, table, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS = 128, 8
RADIUS, BLOCK_RADIUS = 39, 4
#: Characters of benchmark text in a broadcast part.
PART_CHARS = 8_000_000
FILTER_BITS = 22
#: Places in texts that are expanded at a time.
SLAB = 4096
WORD = re.compile(r"[^\W_]+")

OUT = "doc_id long, item_id long, first_word long, n_words long, similarity double"


def fingerprint(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128 bits as 8 blocks of 16: the sign of the weighted sum of the shingles' bits."""
    both = np.stack([mix64(grams + np.uint64(0x5151)), mix64(grams + np.uint64(0xA7A7))], 1)
    bits = np.unpackbits(both.view(np.uint8).reshape(len(grams), 16), axis=1).astype(np.int32)
    total = ((2 * bits - 1) * counts[:, None].astype(np.int32)).sum(0)
    return np.packbits(total > 0).view(np.uint16)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sorted (shingle, count)."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][ia], b[1][ib]).sum())
    return low / (int(a[1].sum()) + int(b[1].sum()) - low)


def build(items: list[tuple[int, str | None]], limit: float = SIMILARITY) -> dict:
    """The index of a part of the benchmark; plain parts only."""
    kept = [(i, word_hashes(WORD.findall((t or "").lower()))) for i, t in items]
    kept = [(i, h) for i, h in kept if len(h)]
    sizes = np.array([len(h) for _, h in kept], np.int64)
    bags = [np.unique(gram_hashes(h, SHINGLE), return_counts=True) for _, h in kept]
    prints = np.array([fingerprint(*b) for b in bags], np.uint16).reshape(len(kept), BLOCKS)
    blocks = []
    for b in range(BLOCKS):
        values, where = np.unique(prints[:, b], return_inverse=True)
        order = np.argsort(where, kind="stable")
        heads = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(values)))])
        blocks.append((values, order, heads))
    widths = {}
    for width in sorted({min(SHINGLE, int(n)) for n in sizes}):
        own = [k for k, n in enumerate(sizes) if min(SHINGLE, n) == width]
        grams = {k: gram_hashes(kept[k][1], SHINGLE) for k in own}
        every, often = np.unique(np.concatenate(list(grams.values())), return_counts=True)
        flat, item = [], []
        for k, g in grams.items():
            need = len(g) - int(np.ceil(limit * len(g) - 1e-9)) + 1
            rare = g[np.argsort(often[np.searchsorted(every, g)], kind="stable")[:need]]
            flat.append(np.unique(rare))
            item.append(np.full(len(flat[-1]), k))
        flat, item = np.concatenate(flat), np.concatenate(item)
        order = np.argsort(flat, kind="stable")
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[(flat & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        widths[width] = (flat[order], item[order], {k: np.unique(g) for k, g in grams.items()}, np.flatnonzero(seen))
    return {"ids": [i for i, _ in kept], "sizes": sizes, "bags": bags, "prints": prints, "blocks": blocks, "widths": widths}


POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def differ(a: np.ndarray, b: np.ndarray | np.uint16) -> np.ndarray:
    """Bits in which 16-bit values differ."""
    x = np.bitwise_xor(a, b)
    return POP[x & 0xFF] + POP[x >> 8]


def near(found: np.ndarray, index: dict) -> np.ndarray:
    """All items whose fingerprint is within RADIUS."""
    hit = []
    for b, (values, order, heads) in enumerate(index["blocks"]):
        for v in np.flatnonzero(differ(values, found[b]) <= BLOCK_RADIUS).tolist():
            hit.append(order[heads[v] : heads[v + 1]])
    some = np.unique(np.concatenate(hit)) if hit else np.empty(0, np.int64)
    return some[differ(index["prints"][some], found[None, :]).sum(1) <= RADIUS]


def matches(texts: list[str | None], index: dict, filters: dict[int, np.ndarray], limit: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """(text, item, first word, words, similarity), one for each text and item that match."""
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    length = np.array([len(w) for w in words], np.int64)
    if not length.sum():
        return []
    ends = np.cumsum(length)
    starts = ends - length
    codes, distinct = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    hashes = pd.util.hash_array(distinct, categorize=False)[codes]
    text_of = np.repeat(np.arange(len(texts)), length)
    windows: set[tuple[int, int, int, int]] = set()
    for width, (flat, item, items, _) in index["widths"].items():
        if len(hashes) < width:
            continue
        grams = gram_hashes(hashes, width)
        inside = np.arange(len(grams)) + width <= ends[text_of[: len(grams)]]
        at = np.flatnonzero(filters[width][(grams & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] & inside)
        lo, hi = np.searchsorted(flat, grams[at], "left"), np.searchsorted(flat, grams[at], "right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(at):
            continue
        pairs: set[tuple[int, int]] = set()
        for s in range(0, len(at), SLAB):  # some places at a time, so that what is held stays bounded
            some = n[s : s + SLAB]
            post = np.repeat(lo[s : s + SLAB] - np.concatenate([[0], np.cumsum(some)[:-1]]), some) + np.arange(some.sum())
            pairs.update(zip(np.repeat(text_of[at[s : s + SLAB]], some).tolist(), item[post].tolist(), strict=True))
        for t, k in sorted(pairs):
            own, size = items[k], int(index["sizes"][k])
            mine = grams[starts[t] : max(starts[t], ends[t] - width + 1)]
            at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            held = min(len(mine), size - width + 1)  # shingles of a window; a shorter text is one
            found, bags = np.append(0, np.cumsum(own[at] == mine)), np.append(np.uint64(0), np.cumsum(mix64(mine)))
            # a share of s needs s / (1 + s) of all shingles of both to be in common
            least = limit * (held + size - width + 1) / (1 + limit) - 1e-9
            first = np.flatnonzero(found[held:] - found[: len(found) - held] >= least)
            _, once = np.unique((bags[held:] - bags[: len(bags) - held])[first], return_index=True)
            for f in (first[once] + starts[t]).tolist():
                windows.add((t, size, f, min(f + size, int(ends[t]))))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for t, size, first, last in sorted(windows):
        bag = np.unique(gram_hashes(hashes[first:last], SHINGLE), return_counts=True)
        for k in near(fingerprint(*bag), index).tolist():
            if index["sizes"][k] == size and (s := similarity(bag, index["bags"][k])) >= limit:
                if (t, k) not in best or s > best[t, k][0]:
                    best[t, k] = s, int(first - starts[t]), last - first
    return [(t, k, first, n, s) for (t, k), (s, first, n) in sorted(best.items())]


def parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark in parts of a bounded size, by hash of the item."""
    total = benchmark.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = 1 + total // (PART_CHARS // 2)
    for k in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select(F.col("item_id").cast("long"), "text").collect()
        yield sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def filters_of(index: dict) -> dict[int, np.ndarray]:
    out = {}
    for width, (*_, seen) in index["widths"].items():
        out[width] = np.zeros(1 << FILTER_BITS, bool)
        out[width][seen] = True
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, limit: float = SIMILARITY) -> DataFrame:
    """One row for each document and benchmark item that match: doc_id, item_id, first_word, n_words, similarity."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for part in parts(benchmark):
        sent = context.broadcast(build(part, limit))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            filters = filters_of(index)
            for batch in chunks(batches):
                ids = column(batch, "doc_id")
                found = [(ids[t], index["ids"][k], a, n, s) for t, k, a, n, s in matches(column(batch, "text"), index, filters, limit)]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

        one = rows.mapInArrow(run, OUT)
        out = one if out is None else out.unionAll(one)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, limit: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that match no item, unchanged."""
    context = docs.sparkSession.sparkContext
    for part in parts(benchmark):
        sent = context.broadcast(build(part, limit))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            filters = filters_of(index)
            for batch in chunks(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in matches(column(batch, "text"), index, filters, limit)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
