"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A text is the vector of all its words. A word weighs (1 + log of its count) times its
inverse document frequency times its relevance, the absolute phi coefficient of word
and label among the labelled texts. Relevance only stretches the axes: no word is
left out, and so every text that shares a word with an example has neighbours. (By
plain TF-IDF the neighbours of a text are those of its topic, whatever their label.)
Document frequencies are counted over all documents. Words are known by a stable
64-bit hash.

Examples lie in blocks of ``BLOCK``, those with the same weightiest word together. The
``FREQUENT`` most frequent words of the index lie block by block, with the largest
weight of each in each block; all others have postings. Postings are read first. With
them, the largest weights bound the cosine of any example in a block, so only blocks
that can reach the k-th best so far are read, and the neighbours are exact.
Their votes, weighted by cosine, are mapped to rates seen on the labelled texts themselves (each scored without its own
vote), rising with the vote.

The labelled rows that are learned from are at most ``SAMPLE_DOCS`` (smallest
hash of the id first; of verified copies one stays and counts for all in rates), and
of these as many, in the same order, as have ``SAMPLE_WORDS`` different words in all, each text's
counted. Both bound what the driver holds and the model that is broadcast; statistics and scores cover every whole text.

Defined results
* null or empty text, or a text without a word that an example has: the rate of
  toxic among labelled texts of that kind, and no evidence;
* nothing to learn from: score 0;
* equal cosines: the example with the smaller id first;
* a label other than 0 counts as 1; of several labels of one id the largest counts;
* very long texts are read whole, one at a time;
* repeated rows give repeated results, an empty table an empty one; further
  columns are ignored by the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, column, cut, gram_hashes, group_starts, mix64, table, whole_groups, word_hashes
from .language_id import held_out

SAMPLE_DOCS = 6_000
#: Different words of all learned texts together, each text's counted: 12 bytes each on the driver.
SAMPLE_WORDS = 8_000_000
NEIGHBOURS = 15
#: Shingle Jaccard from which on texts are copies, bytes of the sketch that finds them, and how many times the sample is read to make up for them.
COPY, SKETCH, REFILL = 0.8, 64, 2
BLOCK = 64
#: Words whose weights lie block by block, the most frequent ones; blocks read before the bounds of others are looked at; texts at a time.
FREQUENT, FIRST, TEXTS = 1_024, 4, 256
#: What single precision may blur.
BLUR = 5e-5
#: Least weight factor: a word that says nothing of the label, or that all documents have, still counts for nearness.
LEAST = 1e-4
CUT = 0.5
FOLD, HELD = 5, 0
TERM = re.compile(r"\w+")
#: Bytes of text that a worker splits at a time.
STEP_CHARS = 1_000_000
#: Words of a slice of the frequencies.
SLICE = 4_096


@dataclass
class Model:
    """The examples' vectors and the map from votes to scores; the block-max inverted index follows when it is first asked for, so the driver that only fits and sends a model never builds it."""

    terms: np.ndarray  # hashes of words, sorted; a word's column is its place
    weights: np.ndarray  # of the columns
    ids: np.ndarray  # of the examples, in the order in which they fill blocks
    toxic: np.ndarray
    whole: np.ndarray  # vector of example e: whole[e] up to whole[e + 1]
    column: np.ndarray
    carried: np.ndarray  # weights of the vectors
    steps: np.ndarray  # votes, rising
    rates: np.ndarray  # score from that vote on
    none: float  # score of a text without words of the index

    def __getattr__(self, name: str):
        """What the index adds.

        slot: place of each column among the frequent ones; -1: it is not
        rows: blocks x frequent words x examples of the block: weights
        top: frequent words x blocks: largest weight
        start: postings of column c: start[c] up to start[c + 1]; frequent ones have none
        posted, weight: their examples and weights
        query: a zero for each column, to write a text's weights into
        """
        if name not in INDEX:
            raise AttributeError(name)
        self.__dict__.update({k: v for k, v in opened({x: self.__dict__[x] for x in SENT}).items() if k in INDEX})
        return self.__dict__[name]


def text_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of every different word of every text, by text."""
    words = [TERM.findall(t.lower()) if t else [] for t in texts]
    flat = [w for ws in words for w in ws]
    if not flat:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    hashes = pd.util.hash_array(distinct, categorize=False)
    text = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
    pairs, counts = np.unique(text * len(distinct) + codes, return_counts=True)
    return pairs // len(distinct), hashes[pairs % len(distinct)], counts


def vectors(texts: list[str | None], terms: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Columns and unit weights of each text; words that no example has have no column."""
    text, hashes, counts = text_terms(texts)
    cols = np.searchsorted(terms, hashes)
    known = cols < len(terms)
    known[known] = terms[cols[known]] == hashes[known]
    text, cols, w = text[known], cols[known], (1.0 + np.log(counts[known])) * weights[cols[known]]
    order = np.lexsort((cols, text))
    text, cols, w = text[order], cols[order], w[order]
    size = np.sqrt(np.bincount(text, w * w, len(texts)))
    w = w / size[text]
    at = np.searchsorted(text, np.arange(len(texts) + 1))
    return [(cols[a:b], w[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    size = end - start
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def nearest_many(found: list[tuple[np.ndarray, np.ndarray]], model: Model, k: int = NEIGHBOURS, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(cosine, example) of the k nearest examples of each text, exactly; ``but`` leaves the example of that id out.

    Rare words are read from their postings. With the largest weights of frequent words in each block these bound
    every example; the blocks of the highest bounds are read first, then those that can still reach the k-th best.
    What single precision can't tell apart is scored again on whole vectors.
    """
    n, blocks = len(model.ids), len(model.rows)
    if not n:
        return [(np.empty(0), np.empty(0, np.int64))] * len(found)
    out = []
    for lo in range(0, len(found), TEXTS):
        part = found[lo : lo + TEXTS]
        asked, score = np.zeros((len(part), model.top.shape[0]), np.float32), np.zeros((len(part), blocks * BLOCK), np.float32)
        for i, (cols, w) in enumerate(part):
            slot = model.slot[cols]
            asked[i, slot[slot >= 0]] = w[slot >= 0]
            start, end = model.start[cols], model.start[cols + 1]  # of frequent words nothing is posted
            at = ranges(start, end)
            if len(at):
                score[i] = np.bincount(model.posted[at], np.repeat(w, end - start) * model.weight[at], blocks * BLOCK)
        by_block = score.reshape(len(part), blocks, BLOCK)
        bound, done = asked @ model.top + by_block.max(2), np.zeros((len(part), blocks), bool)

        def read(wanted: np.ndarray, asked=asked, by_block=by_block, done=done) -> None:
            for b in np.flatnonzero(wanted.any(0)).tolist():
                who = np.flatnonzero(wanted[:, b])
                by_block[who, b] += asked[who] @ model.rows[b]
            done |= wanted

        def limits(score=score) -> np.ndarray:
            if n <= k + 1:
                return np.zeros(len(score), np.float32)
            return np.partition(score, score.shape[1] - k - 1, axis=1)[:, -k - 1]  # one more than k, as one may be left out

        first = np.zeros_like(done)
        np.put_along_axis(first, np.argpartition(-bound, min(FIRST, blocks - 1), axis=1)[:, :FIRST], True, axis=1)
        read(first)
        read(~done & (bound >= limits()[:, None] - BLUR))
        limit = limits()
        for i, (cols, w) in enumerate(part):
            near = np.flatnonzero((score[i] >= limit[i] - BLUR) & (score[i] > 0))
            near = near[done[i, near // BLOCK]]
            if but is not None:
                near = near[model.ids[near] != but[lo + i]]
            # word by word in one order, so that equal examples have equal cosines
            start, end = model.whole[near], model.whole[near + 1]
            at = ranges(start, end)
            model.query[cols] = w
            exact = np.bincount(np.repeat(np.arange(len(near)), end - start), model.query[model.column[at]] * model.carried[at], len(near))
            model.query[cols] = 0.0
            order = np.lexsort((model.ids[near], -exact))[:k]
            out.append((exact[order], near[order]))
    return out


def nearest(cols: np.ndarray, w: np.ndarray, model: Model, k: int = NEIGHBOURS, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    return nearest_many([(cols, w)], model, k, None if but is None else [but])[0]


def vote(sims: np.ndarray, examples: np.ndarray, model: Model) -> float:
    return float((sims * model.toxic[examples]).sum() / sims.sum()) if len(sims) else -1.0


def calibrate(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: the rates that never fall with the vote and fit best."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # lowest vote, toxic, texts
    for v, t, n in zip(votes[order].tolist(), toxic[order].tolist(), weight[order].tolist(), strict=True):
        if pools and pools[-1][0] == v:
            pools[-1][1] += t * n
            pools[-1][2] += n
        else:
            pools.append([v, t * n, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, t2, n2 = pools.pop()
            pools[-1][1] += t2
            pools[-1][2] += n2
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1.0) for p in pools])


def index(ids: np.ndarray, toxic: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray, weights: np.ndarray) -> Model:
    """From the vectors of the labelled texts; not yet calibrated. Texts without a column are left out."""
    start = np.concatenate([[0], np.cumsum([len(cols) for cols, _ in found])]).astype(np.int64)
    return placed(ids, toxic, start, np.concatenate([np.empty(0, np.int32), *(cols for cols, _ in found)]).astype(np.int32), np.concatenate([np.empty(0), *(w for _, w in found)]), terms, weights)


def placed(ids: np.ndarray, toxic: np.ndarray, start: np.ndarray, cols: np.ndarray, w: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> Model:
    """The same from all vectors in one array each (text i: start[i] up to start[i + 1])."""
    size = np.diff(start)
    full = np.flatnonzero(size)
    main = [int(cols[a + w[a:b].argmax()]) for a, b in zip(start[full].tolist(), start[full + 1].tolist(), strict=True)]
    full = full[np.lexsort((ids[full], main))]
    at = ranges(start[full], start[full + 1])
    whole = np.concatenate([[0], np.cumsum(size[full])]).astype(np.int64)
    return Model(terms=terms, weights=weights, ids=ids[full], toxic=toxic[full].astype(float), whole=whole, column=cols[at], carried=w[at], steps=np.zeros(1), rates=np.zeros(1), none=0.0)


SENT = ("terms", "weights", "ids", "toxic", "whole", "column", "carried", "steps", "rates", "none")
INDEX = ("slot", "rows", "top", "start", "posted", "weight", "query")


def packed(model: Model) -> dict:
    """What is broadcast of a model: the vectors, weights in single precision; the index follows from them."""
    return {x: getattr(model, x) for x in SENT} | {"carried": model.carried.astype(np.float32)}


def opened(parts: dict) -> dict:
    """All of a model, from its vectors."""
    column, whole, carried = parts["column"], parts["whole"], parts["carried"]
    n, terms = len(whole) - 1, len(parts["terms"])
    example = np.repeat(np.arange(n, dtype=np.int32), np.diff(whole))
    count = np.bincount(column, minlength=terms)
    chosen = np.sort(np.argsort(-count, kind="stable")[:FREQUENT])
    slot = np.full(terms, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    often, blocks = slot[column] >= 0, -(-n // BLOCK)
    rows = np.zeros((blocks, len(chosen), BLOCK), np.float32)
    rows[example[often] // BLOCK, slot[column[often]], example[often] % BLOCK] = carried[often]
    rare = np.flatnonzero(~often)
    rare = rare[np.argsort(column[rare], kind="stable")]  # vectors stand by example, so postings do too
    start = np.append(0, np.cumsum(np.where(slot >= 0, 0, count)))
    return parts | {"slot": slot, "rows": rows, "top": np.ascontiguousarray(rows.max(2).T) if blocks else np.zeros((len(chosen), 0), np.float32), "start": start, "posted": example[rare], "weight": carried[rare], "query": np.zeros(terms)}


def leaders(grams: list[np.ndarray]) -> list[int]:
    """For each set of shingle hashes (sorted), the first earlier set that starts a group and shares ``COPY`` of the union with it, or its own number.

    Sketches of one byte for each of ``SKETCH`` hash functions single out what to compare; the shingles decide.
    """
    out: list[int] = []
    sketches, heads = np.empty((16, SKETCH), np.uint8), []
    seeds = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64))
    for i, g in enumerate(grams):
        mine = np.full(SKETCH, 0, np.uint8)
        if len(g):
            mine = np.array([mix64(g ^ x).min() for x in seeds]).view(np.uint64).astype(np.uint8)
        near = np.flatnonzero((sketches[: len(heads)] == mine).mean(1) >= COPY - 0.25) if heads else ()
        found = i
        for h in (heads[j] for j in near):
            both = len(np.intersect1d(g, grams[h], assume_unique=True))
            if both >= COPY * (len(g) + len(grams[h]) - both):
                found = h
                break
        if found == i:
            if len(heads) == len(sketches):
                sketches = np.concatenate([sketches, np.empty_like(sketches)])
            sketches[len(heads)] = mine
            heads.append(i)
        out.append(found)
    return out


def first_ids() -> list[Column]:
    """The order in which labelled rows are taken: by a hash of the id."""
    return [F.md5(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.col("doc_id")]


def one_of_copies(texts: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """Of labelled texts of one label that are copies (shingle Jaccard of ``COPY`` or more), one, and ``n``, how many it stands for.

    Else the words of a copied text pass for signs of its label. Texts are compared if they share their smallest 3-word
    shingle hash, as copies mostly do; a bucket has no more rows than the sample. No more than ``sample`` are returned.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            every = [np.unique(gram_hashes(word_hashes(TERM.findall((t or "").lower())), 3)).view(np.int64) for t in column(batch, "text")]
            least = [int(g.view(np.uint64).min().view(np.int64)) if len(g) else None for g in every]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("row", "doc_id", "toxic")), pa.array(least, pa.int64()), pa.array(every, pa.list_(pa.int64()))], names=["row", "doc_id", "toxic", "least", "grams"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["least", "toxic"]):
            starts = group_starts(rows, ["least", "toxic"]).tolist()
            ids, kept = list(zip(rows.column("row").to_pylist(), rows.column("doc_id").to_pylist(), strict=True)), {}
            for start, end in zip(starts, [*starts[1:], rows.num_rows], strict=True):
                grams = [np.array(g, np.int64).view(np.uint64) for g in rows.column("grams").slice(start, end - start).to_pylist()]
                for leader in leaders(grams):
                    kept[ids[start + leader]] = kept.get(ids[start + leader], 0) + 1
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)), pa.array(list(kept.values()), pa.int64())], names=["row", "doc_id", "n"])

    named = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    marked = cut(named.mapInArrow(sketch, "row long, doc_id long, toxic int, least long, grams array<long>"))
    first = F.min(F.struct("doc_id", "row")).alias("first")
    # texts without words say the same, nothing: one of each label stands for all
    alone = marked.where("least IS NULL").groupBy("toxic").agg(first, F.count("*").alias("n")).select("first.row", "first.doc_id", "n")
    # only buckets of several rows need a look
    buckets = marked.where("least IS NOT NULL").groupBy("least", "toxic").agg(first, F.count("*").alias("n"))
    single = buckets.where("n = 1").select("first.row", "first.doc_id", "n")
    met = marked.join(F.broadcast(buckets.where("n > 1").select("least", "toxic")), ["least", "toxic"], "left_semi").select("row", "doc_id", "toxic", "least", "grams")
    many = met.repartition("least", "toxic").sortWithinPartitions("least", "toxic", "doc_id", "row").mapInArrow(group, "row long, doc_id long, n long")
    kept = cut(alone.unionAll(single).unionAll(many).orderBy(*first_ids(), "row").limit(sample))
    return named.join(F.broadcast(kept.select("row", "n")), "row").drop("row")


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How many of all documents have each of the terms (sorted hashes).

    A task counts into one vector over the terms, which the sample bounds, and hands
    it on in packed slices, which are added up slice by slice: what is shuffled grows
    with the tasks and not with the words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    tight = lambda x: zlib.compress(x.tobytes(), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        counts = np.zeros(len(known), np.int64)
        for batch in chunks(batches, limit=STEP_CHARS):
            _, hashes, _ = text_terms(column(batch, "text"))
            at = np.searchsorted(known, hashes)
            at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == hashes)]
            counts += np.bincount(at, minlength=len(known))
        some = [s for s in range(0, len(known), SLICE) if counts[s : s + SLICE].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([tight(counts[s : s + SLICE]) for s in some], pa.binary())], names=["at", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            done = []
            for at, raw in zip(column(batch, "at"), column(batch, "counts"), strict=True):
                mine = np.frombuffer(zlib.decompress(raw), np.int64)
                if at == now:
                    total += mine
                else:
                    if now is not None:
                        done.append((now, tight(total)))
                    now, total = at, mine.copy()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done], pa.binary())], names=["at", "counts"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([tight(total)], pa.binary())], names=["at", "counts"])

    parts = docs.select("text").mapInArrow(count, "at long, counts binary").repartition("at").sortWithinPartitions("at")
    out = np.zeros(len(terms))
    for r in parts.mapInArrow(add, "at long, counts binary").collect():  # one row for each slice
        mine = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
        out[r["at"] : r["at"] + len(mine)] = mine
    sent.destroy()
    return out


def flat(rows: pa.Table, name: str, kind: type) -> np.ndarray:
    """The binary values of a column one after another, as numbers."""
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_buffer(), kind) for part in rows.column(name).chunks for x in part if x.is_valid)])


def within(coded: DataFrame, words: int) -> DataFrame:
    """doc_id of the labelled texts that are learned from: in the order of ``first_ids``, as long as they have no more than ``words`` in all."""
    sizes = coded.groupBy("doc_id").agg(F.sum(F.octet_length("counts") / 4).alias("_n"))  # no more rows than the sample
    upto = sizes.withColumn("_upto", F.sum("_n").over(Window.orderBy(*first_ids())))
    return upto.where(F.col("_upto") <= words).select("doc_id")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> Model:
    """``labels`` (doc_id, toxic) may hold only what is to be learned from; ``docs`` gives texts and document frequencies."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    known = known.orderBy(*first_ids()).limit(REFILL * sample)
    held = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id").distinct()
    texts = cut(one_of_copies(cut(held), sample))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            text, hashes, counts = text_terms(column(batch, "text"))
            at = np.searchsorted(text, np.arange(batch.num_rows + 1))
            parts = [[x[a:b].astype(kind).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] for x, kind in ((hashes, np.uint64), (counts, np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "toxic", "n")), *(pa.array(x, pa.binary()) for x in parts)], names=["doc_id", "toxic", "n", "hashes", "counts"])

    coded = cut(texts.mapInArrow(encode, "doc_id long, toxic int, n long, hashes binary, counts binary"))
    chosen = F.broadcast(cut(within(coded, words)))
    coded, texts = coded.join(chosen, "doc_id", "left_semi"), texts.join(chosen, "doc_id", "left_semi")
    # at most ``sample`` rows, each of a text's different words, and ``words`` of these in all
    rows = coded.orderBy("doc_id", "hashes").select("doc_id", "toxic", "n", "hashes", "counts").toArrow()
    ids, toxic, copies = (rows.column(x).to_numpy().astype(np.int64) for x in ("doc_id", "toxic", "n"))
    hashes, counts = flat(rows, "hashes", np.uint64), flat(rows, "counts", np.int32)
    size = np.array([n // 8 for n in pc.binary_length(rows.column("hashes")).to_pylist()], np.int64)
    del rows
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    terms, weights, where = np.empty(0, np.uint64), np.empty(0), np.empty(0, np.int32)
    if len(hashes):
        terms = np.unique(hashes)
        where = np.searchsorted(terms, hashes).astype(np.int32)
        del hashes
        bad, all_ = np.bincount(where[np.repeat(toxic != 0, size)], minlength=len(terms)), np.bincount(where, minlength=len(terms)).astype(float)
        n, n1 = len(ids), toxic.sum()
        spread_ = np.sqrt(np.maximum(all_ * (n - all_) * n1 * (n - n1), 0.0))
        phi = np.where(spread_ > 0, np.abs(bad * n - all_ * n1) / np.maximum(spread_, 1e-300), 0.0)
        n_docs, df = docs.count(), document_frequencies(docs, terms)
        weights = (np.log((1.0 + n_docs) / (1.0 + df)) + LEAST) * (phi + LEAST)
    # text by text, so that no array of all words but the vectors is made
    carried = np.empty(len(where))
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        order = np.argsort(where[a:b])
        w = ((1.0 + np.log(counts[a:b])) * weights[where[a:b]])[order]
        where[a:b], carried[a:b] = where[a:b][order], w / np.sqrt((w * w).sum()) if a < b else w
    del counts
    model = placed(ids, toxic, start, where, carried, terms, weights)
    del where, carried
    empty = size == 0
    model.none = float((toxic * copies)[empty].sum() / copies[empty].sum()) if empty.any() else 0.0
    if not len(model.ids):
        return model
    sent = docs.sparkSession.sparkContext.broadcast(packed(model))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = SimpleNamespace(**opened(sent.value))
        for batch in chunks(batches, limit=STEP_CHARS):
            made = vectors(column(batch, "text"), held.terms, held.weights)
            got = [vote(*x, held) for x in nearest_many(made, held, but=column(batch, "doc_id"))]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.float64()), batch.column("toxic"), batch.column("n")], names=["vote", "toxic", "n"])

    tried = texts.select("doc_id", "text", "toxic", "n").mapInArrow(votes, "vote double, toxic int, n long").where("vote >= 0").groupBy("vote", "toxic").agg(F.sum("n").alias("n")).orderBy("vote", "toxic").toPandas()
    sent.destroy()
    if len(tried):
        model.steps, model.rates = calibrate(tried["vote"].to_numpy(), tried["toxic"].to_numpy(), tried["n"].to_numpy())
    return model


def score_texts(texts: list[str | None], model: Model) -> list[tuple[float, list[int]]]:
    """(score, ids of the neighbours, nearest first) of each text."""
    out = []
    for sims, found in nearest_many(vectors(texts, model.terms, model.weights), model):
        if not len(found):
            out.append((model.none, []))
            continue
        at = np.searchsorted(model.steps, vote(sims, found, model), side="right") - 1
        out.append((float(model.rates[max(at, 0)]), model.ids[found].tolist()))
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and evidence (ids of the nearest examples) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(packed(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SimpleNamespace(**opened(sent.value))
        for batch in chunks(batches, limit=STEP_CHARS):
            found = score_texts(column(batch, "text"), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, evidence array<long>")


def drop_toxic(docs: DataFrame, model: Model, limit: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(packed(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SimpleNamespace(**opened(sent.value))
        for batch in chunks(batches, limit=STEP_CHARS):
            yield batch.filter(pa.array([x < limit for x, _ in score_texts(column(batch, "text"), model)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out(FOLD, HELD)))
    found = score(docs, model)
    return found.select("doc_id", held_out(FOLD, HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")
