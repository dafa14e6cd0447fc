"""Approximate nearest neighbours by inner product: inverted file of coarse centroids, product-quantised residuals, exact reranking.

Fitted on a bounded sample (``SAMPLE`` vectors, or 32 times the root of the table's
rows, at most ``SAMPLE_MOST``; smallest hash of the id first): coarse centroids by
k-means in two levels, so that near cells form a group, and 256 codes for each of 16
parts of the residuals. There are four times as many cells as the root of the rows
(at most an eighth of the sample), so cells stay small as tables grow. How many cells
a query probes is fitted too: as many as held ``AIM`` of the exact neighbours inside
the sample. Every vector is indexed (its cell, its 16 codes).

A query goes once to each group that has cells it probes. A group is searched in
blocks of about ``BLOCK`` vectors against ``QUERIES`` queries, each pair of blocks a
group of its own, so a cell that holds a third of all vectors is spread over many
tasks. There, asymmetric distance tables score the vectors of probed cells; the best
``SHORTLIST`` of them, and all others within ``SLACK`` standard errors of quantisation
of the last of these, are scored exactly in double precision on the original vectors,
and the best k leave the task. (Vectors too close together for the codes to tell
apart are so all scored.) A query probes further cells until it has met ``LEAST``
vectors, so a small table is searched whole.

Defined results
* vectors that are null, zero, of another length than most, or hold null or
  non-finite components take no part, nor do rows without an id;
* rows that repeat an id count once (the smallest vector);
* ties go to the smaller id; with fewer than k candidates all are returned;
* an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, group_starts, table, whole_groups

SAMPLE, SAMPLE_MOST = 20_000, 131_072
#: Cells by the root of the rows, vectors of the sample for a cell, and cells of a group.
CELLS, TAUGHT, GROUP_CELLS = 4.0, 8, 32
PARTS, CODES = 16, 256
AIM = 0.94
TRIALS = 400
BLOCK, QUERIES = 4096, 2048
#: Queries answered at a time.
SLAB = 64
SHORTLIST, SLACK = 128, 2.0
LEAST = 400
K = 20
EVERY = 20


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    draw = np.random.RandomState(seed)
    centre = x[np.sort(draw.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        near = closest(x, centre)
        count = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], k)
            centre[:, d] = np.where(count > 0, total / np.maximum(count, 1), centre[:, d])
    return centre


def closest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    bias = (centre * centre).sum(1) / 2
    out = np.empty(len(x), np.int64)
    for k in range(0, len(x), 8192):
        out[k : k + 8192] = (x[k : k + 8192] @ centre.T - bias).argmax(1)
    return out


def split_parts(d: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, d, min(PARTS, d) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def encode(x: np.ndarray, cell: np.ndarray, model: dict) -> np.ndarray:
    rest = x - model["centre"][cell]
    return np.stack([closest(rest[:, a:b], book) for (a, b), book in zip(model["parts"], model["books"], strict=True)], 1).astype(np.uint8)


def decode(codes: np.ndarray, centre: np.ndarray, model: dict) -> np.ndarray:
    """The vectors that the codes stand for, around the centroids of their cells."""
    return centre + np.concatenate([book[codes[:, i]] for i, book in enumerate(model["books"])], 1)


def coarse(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """About k centroids, and the group of each: groups first, then the cells of each from its own vectors."""
    groups = max(1, round(k / GROUP_CELLS))
    at = closest(x, k_means(x, groups, 8, 7))
    centre, group = [], []
    for g in np.unique(at).tolist():
        own = x[at == g]
        centre.append(k_means(own, int(np.clip(round(k * len(own) / len(x)), 1, len(own))), 8, 19 + g))
        group += [g] * len(centre[-1])
    return np.concatenate(centre), np.array(group)


def fit(vectors: DataFrame, n_rows: int) -> dict:
    """centre, group, parts, books, probes. ``vectors``: vec_id, v."""
    sample = int(min(SAMPLE_MOST, max(SAMPLE, TAUGHT * CELLS * n_rows**0.5)))
    rows = vectors.orderBy(F.md5(F.encode(F.col("vec_id").cast("string"), "UTF-8")), "vec_id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    whole = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(np.float64)
    x = np.unique(whole, axis=0)  # copies would only crowd the centroids
    x = x[np.random.RandomState(3).permutation(len(x))]
    centre, group = coarse(x, int(np.clip(CELLS * np.sqrt(n_rows), 1, max(1, len(x) // TAUGHT))))
    k = len(centre)
    few = x[:SAMPLE]
    rest = few - centre[closest(few, centre)]
    parts = split_parts(x.shape[1])
    books = [k_means(rest[:, a:b], min(CODES, len(few)), 8, 11 + i) for i, (a, b) in enumerate(parts)]
    # copies count here, as they do in the table: a vector with many fills all places of a query it is near to
    trial, lies_in = whole[:TRIALS], closest(whole, centre)
    true = np.argsort(-(trial @ whole.T), axis=1)[:, 1 : K + 1]
    rank = np.argsort(np.argsort(-(trial @ centre.T), axis=1), axis=1)
    needed = np.take_along_axis(rank, lies_in[true], 1)
    probes = 1 + int(np.quantile(needed, AIM)) if needed.size else k
    return {"centre": centre, "group": group, "parts": parts, "books": books, "probes": min(k, probes)}


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: one row of doubles for each id that takes part."""
    vectors = vectors.select("vec_id", "embedding")
    good = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    # floats are moved as they are and become doubles where they are scored
    return good.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.col("embedding").cast("array<float>" if kind == "float" else "array<double>")).alias("v"))


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query among all other rows."""
    session = vectors.sparkSession
    good = cut(usable(vectors))
    lengths = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return session.createDataFrame([], empty)
    d, n_rows = lengths[0]["d"], lengths[0]["count"]
    good = good.where(F.size("v") == d)
    model = fit(good, n_rows)
    sent = session.sparkContext.broadcast(model)

    kind = good.schema["v"].dataType.elementType.typeName()

    def matrix(rows, name: str = "v") -> np.ndarray:
        values = rows.column(name)
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                cell = closest(x, sent.value["centre"])
                codes = encode(x, cell, sent.value)
                arrays = [batch.column("vec_id"), batch.column("v"), pa.array(sent.value["group"][cell], pa.int32()), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "v", "grp", "cell", "codes"])

    indexed = cut(good.mapInArrow(index, f"vec_id long, v array<{kind}>, grp int, cell int, codes binary"))
    n_cells, n_groups = len(model["centre"]), int(model["group"].max()) + 1
    sizes = np.zeros(n_cells, np.int64)
    for r in indexed.groupBy("cell").count().collect():  # one row for each cell
        sizes[r["cell"]] = r["count"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                order = np.argsort(-(matrix(part) @ m["centre"].T), axis=1, kind="stable")
                met = np.cumsum(sizes[order], axis=1)
                wanted = np.minimum(n_cells, np.maximum(m["probes"], 1 + (met < LEAST).sum(1)))
                row = np.repeat(np.arange(part.num_rows), wanted)
                cells = np.concatenate([o[:w] for o, w in zip(order, wanted, strict=True)])
                cells, row = cells[sizes[cells] > 0], row[sizes[cells] > 0]
                by = np.lexsort((cells, m["group"][cells], row))
                cells, row = cells[by], row[by]
                new = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(m["group"][cells]) != 0)))
                take = pa.array(row[new])
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(cells)), pa.int32()), pa.array(cells, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(take), part.column("v").take(take), pa.array(m["group"][cells[new]], pa.int32()), lists], names=["vec_id", "v", "grp", "cells"])

    asked = cut(indexed.where(is_query).select("vec_id", "v").mapInArrow(probe, f"vec_id long, v array<{kind}>, grp int, cells array<int>"))
    calls, held = np.zeros(n_groups, np.int64), np.bincount(model["group"], sizes, n_groups).astype(np.int64)
    for r in asked.groupBy("grp").count().collect():
        calls[r["grp"]] = r["count"]
    per_group = session.createDataFrame([(i, max(1, -(-int(s) // BLOCK)), max(1, -(-int(c) // QUERIES))) for i, (s, c) in enumerate(zip(held, calls, strict=True)) if c], "grp int, nb int, nq int")
    spot = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))

    def deal(df: DataFrame, own: str, other: str, side: int, *more) -> DataFrame:
        df = df.join(F.broadcast(per_group), "grp").withColumn("own", (spot % F.col(own)).cast("int"))
        df = df.withColumn("far", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        b, q = ("own", "far") if side == 0 else ("far", "own")
        return df.select("grp", F.col(b).alias("b"), F.col(q).alias("q"), F.lit(side).alias("side"), "vec_id", "v", *more)

    none = [F.lit(None).cast("int").alias("cell"), F.lit(None).cast("binary").alias("codes"), "cells"]
    rows = deal(indexed, "nb", "nq", 0, "cell", "codes", F.lit(None).cast("array<int>").alias("cells")).unionAll(deal(asked, "nq", "nb", 1, *none))
    keys = ["grp", "b", "q"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in whole_groups(batches, keys):
            starts = group_starts(part, keys)
            for lo, hi in zip(starts.tolist(), np.append(starts[1:], part.num_rows).tolist(), strict=True):
                group = part.slice(lo, hi - lo).combine_chunks()
                cut_at = int((group.column("side").to_numpy() == 0).sum())
                if not cut_at or cut_at == group.num_rows:
                    continue
                ids, values = group.column("vec_id").to_numpy(), matrix(group)
                x, own, q, asks = values[:cut_at], ids[:cut_at], values[cut_at:], ids[cut_at:]
                codes = np.frombuffer(b"".join(group.column("codes").slice(0, cut_at).to_pylist()), np.uint8).reshape(cut_at, -1)
                cell = group.column("cell").slice(0, cut_at).to_numpy()
                cells = group.column("cells").slice(cut_at).to_pylist()
                for s in range(0, len(q), SLAB):
                    yield answer(q[s : s + SLAB], asks[s : s + SLAB], cells[s : s + SLAB], x, own, cell, codes, m, k)

    near = rows.repartition(*keys).sortWithinPartitions(*keys, "side", "vec_id").mapInArrow(scan, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def rough_scores(q: np.ndarray, cells: list[list[int]], cell: np.ndarray, codes: np.ndarray, model: dict) -> np.ndarray:
    """Scores by asymmetric tables of the vectors in the cells that each query probes; all others -inf."""
    out = np.full((len(q), len(cell)), -np.inf)
    tables = [q[:, a:b] @ book.T for (a, b), book in zip(model["parts"], model["books"], strict=True)]
    asking: dict[int, list[int]] = {}
    for i, own in enumerate(cells):
        for c in own:
            asking.setdefault(c, []).append(i)
    order = np.argsort(cell, kind="stable")
    found, heads = np.unique(cell[order], return_index=True)
    for c, lo, hi in zip(found.tolist(), heads.tolist(), np.append(heads[1:], len(cell)).tolist(), strict=True):
        if (who := asking.get(c)) is not None:
            at = order[lo:hi]
            score = np.repeat((q[who] @ model["centre"][c])[:, None], len(at), 1)
            for i, t in enumerate(tables):
                score += t[who][:, codes[at, i]]
            out[np.ix_(who, at)] = score
    return out


def answer(q: np.ndarray, asks: np.ndarray, cells: list[list[int]], x: np.ndarray, own: np.ndarray, cell: np.ndarray, codes: np.ndarray, model: dict, k: int) -> pa.RecordBatch:
    """The best k of a block for each query. ``own`` rises, so a stable sort leaves ties to the smaller id."""
    rough = rough_scores(q, cells, cell, codes, model)
    if len(x) > SHORTLIST:
        # equal codes of equal vectors give equal sums, so ties here also go to the smaller id
        order = np.argsort(-rough, axis=1, kind="stable")
        error = np.sqrt(((x - decode(codes, model["centre"][cell], model)) ** 2).mean())
        last = np.take_along_axis(rough, order[:, SHORTLIST - 1 : SHORTLIST], 1)
        near = (rough >= last - SLACK * error * np.sqrt((q * q).sum(1, keepdims=True))) & (rough > -np.inf)
        some = np.sort(order[:, : max(1, near.sum(1).max())], axis=1)
    else:
        some = np.repeat(np.arange(len(x))[None, :], len(q), 0)
    exact = np.stack([(x[s] * v).sum(1) for s, v in zip(some, q, strict=True)])
    exact = np.where((own[some] == asks[:, None]) | (np.take_along_axis(rough, some, 1) == -np.inf), -np.inf, exact)
    order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
    score, found = np.take_along_axis(exact, order, 1), own[np.take_along_axis(some, order, 1)]
    live = score > -np.inf
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(asks, live.sum(1)), pa.int64()), pa.array(found[live], pa.int64()), pa.array(score[live], pa.float64())], names=["query_id", "vec_id", "score"])


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
