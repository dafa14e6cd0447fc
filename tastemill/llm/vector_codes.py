"""Vector code compression: product codes by Lloyd's rounds, filtered through kd-trees.

Vectors become whole numbers and are cut into parts; every part position has a codebook of
its own. Every partition builds, once, a kd-tree over each part position of its vectors
(in blocks of bounded size) and stores it: an order of the vectors, and for each node a
bounding box, the sum and the count of what lies in it. A round then walks the trees with
the codebook. At a node, the entry nearest to the middle of the box eliminates every
entry that no point of the box can be nearer to (or, tied, has the smaller index for); where
one entry is left, the whole subtree is its own and adds its cached sum. Points are looked
at one by one in leaves with several entries left only. All is exact integer
arithmetic, so the result doesn't depend on blocks or partitions.

A round shuffles one row for each part position, entry and task, and the driver gets as many
rows as the codebooks have entries. Trees are a reliable checkpoint: a lost executor costs
the blocks of its tasks.

Defined results
* vectors that are null, or hold null or non-finite components, are dropped, and so are
  empty ones and those of another length than most (ties: the longer);
* a length that the number of parts doesn't divide: parts whose sizes differ by one;
* fewer rows than entries: as many entries as rows; rows of equal ids are in the order of
  their vectors; rows without an id are coded but never start an entry;
* no row with an id, or an empty table: no entry to code with, so no rows;
* components beyond what sums of squares can hold in 64 bits (``bound``: 2^24 for 64 dimensions
  and entries, so 65,536 before scaling) count as that bound;
* repeated rows are coded alike; further columns are ignored; rows without a label share one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of a block, and the most points of a leaf.
BLOCK, LEAF = 2_000_000, 16
#: (node, entry, component) triples, or (leaf, entry, point) ones, that are looked at in one step.
SLAB = 2_000_000


def edges_of(dims: int, parts: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dims, min(parts, dims) + 1).astype(int).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def bound(dims: int, entries: int) -> int:
    """The largest component with which (sum of all squared differences) * entries fits 63 bits."""
    return int(2 ** ((62 - np.ceil(np.log2(max(1, entries) * dims))) // 2 - 1))


# ---- trees. A tree of n points has levels 0..depth; node k of a level holds the points from cuts[k] to cuts[k + 1].


def cuts_of(n: int) -> list[np.ndarray]:
    """The borders of the nodes of each level: halves, until a node has at most LEAF points."""
    out = [np.array([0, n], np.int64)]
    while np.diff(out[-1]).max() > LEAF:
        last = out[-1]
        both = np.empty(2 * len(last) - 1, np.int64)
        both[0::2], both[1::2] = last, (last[:-1] + last[1:]) // 2
        out.append(both)
    return out


def grow(points: np.ndarray) -> dict:
    """order of the points, and per level (root first) boxes, sums: nodes x components. Nodes are cut across their widest side."""
    n, cuts = len(points), cuts_of(len(points))
    order = np.arange(n)
    for level in cuts[:-1]:
        own = points[order]
        wide = np.maximum.reduceat(own, level[:-1]) - np.minimum.reduceat(own, level[:-1])
        node = np.repeat(np.arange(len(level) - 1), np.diff(level))
        side = wide.argmax(1)[node]
        order = order[np.lexsort((own[np.arange(n), side], node))]
    own, low, high, total = points[order], [], [], []
    heads = cuts[-1][:-1]
    low.append(np.minimum.reduceat(own, heads))
    high.append(np.maximum.reduceat(own, heads))
    total.append(np.add.reduceat(own, heads))
    for _ in cuts[:-1]:  # a node is the sum of its two
        low.append(np.minimum(low[-1][0::2], low[-1][1::2]))
        high.append(np.maximum(high[-1][0::2], high[-1][1::2]))
        total.append(total[-1][0::2] + total[-1][1::2])
    return {"order": order, "low": low[::-1], "high": high[::-1], "total": total[::-1]}


def sides_left(low: np.ndarray, high: np.ndarray, book: np.ndarray, may: np.ndarray) -> np.ndarray:
    """Which of the entries that ``may`` own a point of each box still can."""
    norm = (book * book).sum(1)
    middle = low + high
    gap = np.where(may, 4 * norm[None, :] - 4 * (middle @ book.T), np.iinfo(np.int64).max)
    best = gap.argmin(1)  # nearest to the middle
    step = book[None, :, :] - book[best][:, None, :]
    # least of |p - z|^2 - |p - best|^2 over the box: at the corner that lies furthest towards z
    corner = np.where(step > 0, high[:, None, :], low[:, None, :])
    least = norm[None, :] - norm[best][:, None] - 2 * (corner * step).sum(2)
    wins = (least < 0) | ((least == 0) & (np.arange(len(book))[None, :] <= best[:, None]))
    return may & wins


def nearest(points: np.ndarray, sizes: np.ndarray, book: np.ndarray, may: np.ndarray) -> np.ndarray:
    """Entry of each point of the leaves (points leaf by leaf), among those that the leaf may have."""
    heads, n_entries = np.cumsum(sizes) - sizes, len(book)
    best = np.empty(len(points), np.int64)
    leaf, entry = np.nonzero(may)
    many = np.bincount(leaf, minlength=len(sizes))
    first = np.cumsum(many) - many
    place = np.arange(LEAF)
    inside = place[None, :] < sizes[:, None]
    at = np.minimum(heads[:, None] + place[None, :], len(points) - 1)
    step = max(1, SLAB // (LEAF * n_entries * book.shape[1]))
    for lo in range(0, len(sizes), step):
        hi = min(len(sizes), lo + step)
        some = slice(first[lo], first[hi - 1] + many[hi - 1])
        far = points[at[leaf[some]]] - book[entry[some]][:, None, :]
        key = (far * far).sum(2) * n_entries + entry[some][:, None]  # ties to the smaller index
        low = np.minimum.reduceat(key, first[lo:hi] - first[lo])
        best[at[lo:hi][inside[lo:hi]]] = (low % n_entries)[inside[lo:hi]]
    return best


def walk(points: np.ndarray, tree: dict, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts) of what each entry owns, and the entry of each point in the tree's order."""
    cuts = cuts_of(len(points))
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    code = np.empty(len(points), np.int64)
    nodes, may = np.array([0]), np.ones((1, len(book)), bool)
    step = max(1, SLAB // book.size)
    for depth, level in enumerate(cuts):
        low, high = tree["low"][depth], tree["high"][depth]
        may = np.concatenate([sides_left(low[nodes[k : k + step]], high[nodes[k : k + step]], book, may[k : k + step]) for k in range(0, len(nodes), step)])
        alone = may.sum(1) == 1
        whole, owner = nodes[alone], may[alone].argmax(1)
        np.add.at(sums, owner, tree["total"][depth][whole])
        size = level[whole + 1] - level[whole]
        np.add.at(counts, owner, size)
        code[np.repeat(level[whole] - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(owner, size)
        nodes, may = nodes[~alone], may[~alone]
        if not len(nodes):
            return sums, counts, code
        if depth < len(cuts) - 1:
            nodes, may = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(may, 2, 0)
    level = cuts[-1]
    size = level[nodes + 1] - level[nodes]
    at = np.repeat(level[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
    own = points[tree["order"][at]]
    best = nearest(own, size, book, may)
    np.add.at(sums, best, own)
    counts += np.bincount(best, minlength=len(book))
    code[at] = best
    return sums, counts, code


# ---- Spark


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """vec_id, label, v: components floor(scale * x) as doubles, of the vectors that take part."""
    good = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    good = good.where("v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    return good.select("vec_id", "label", F.transform("v", lambda x: floored(x * scale)).alias("v"))


def floored(x: Column) -> Column:
    """A double, rounded down; from 2^52 on doubles are whole already."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def plant(good: DataFrame, dims: int, spans: list[tuple[int, int]], most: int, label_type) -> DataFrame:
    """A row for each block of a partition: its ids, labels, points, and the trees over all part positions."""
    rows = max(1, BLOCK // dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            values = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            points = np.clip(values, -most, most).astype(np.int32)
            trees = [grow(points[:, a:b].astype(np.int64)) for a, b in spans]
            lists = {c: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c).combine_chunks()) for c in ("vec_id", "label")}
            order = np.stack([t["order"] for t in trees]).astype(np.int32).tobytes()
            boxes = b"".join(np.concatenate(t[k]).astype(np.int32).tobytes() for t in trees for k in ("low", "high"))
            total = b"".join(np.concatenate(t["total"]).astype(np.int64).tobytes() for t in trees)
            binary = [pa.array([x], pa.binary()) for x in (points.tobytes(), order, boxes, total)]
            return pa.RecordBatch.from_arrays([lists["vec_id"], lists["label"], *binary], names=["ids", "labels", "points", "orders", "boxes", "totals"])

        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(rows - n, batch.num_rows - at)
                held.append(batch.slice(at, take))
                n, at = n + take, at + take
                if n == rows:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    kind = good.schema["vec_id"].dataType.simpleString()
    return good.mapInArrow(run, f"ids array<{kind}>, labels array<{label_type}>, points binary, orders binary, boxes binary, totals binary")


def trees_of(batch: pa.RecordBatch, row: int, dims: int, spans: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, dict]]:
    """(points, tree) of each part position of a block."""
    read = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)
    points = read("points", np.int32).reshape(-1, dims).astype(np.int64)
    orders, boxes, totals = read("orders", np.int32).reshape(len(spans), -1), read("boxes", np.int32), read("totals", np.int64)
    levels = np.array([len(c) - 1 for c in cuts_of(len(points))])
    borders, nodes, at = np.cumsum(levels)[:-1], int(levels.sum()), 0
    for k, (a, b) in enumerate(spans):
        n = nodes * (b - a)
        low, high = boxes[2 * at : 2 * at + n], boxes[2 * at + n : 2 * at + 2 * n]
        both = [np.split(x.reshape(nodes, b - a).astype(np.int64), borders) for x in (low, high, totals[at : at + n])]
        yield points[:, a:b], dict(zip(("low", "high", "total"), both, strict=True), order=orders[k].astype(np.int64))
        at += n


def tally(forest: DataFrame, books: list[np.ndarray], dims: int, spans: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per part position the (sums, counts) of each entry: one walk over all trees."""
    sent = forest.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, np.int64) for b in sent.value], [np.zeros(len(b), np.int64) for b in sent.value]
        for batch in batches:
            for row in range(batch.num_rows):
                for k, (points, tree) in enumerate(trees_of(batch, row, dims, spans)):
                    more, n, _ = walk(points, tree, sent.value[k])
                    sums[k] += more
                    counts[k] += n
        part, entry = (np.concatenate(x) for x in zip(*[(np.full(len(b), k), np.arange(len(b))) for k, b in enumerate(sent.value)], strict=True))
        flat = [list(v) for s in sums for v in s.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(np.concatenate(counts), pa.int64()), pa.array(flat, pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    widest = max(b - a for a, b in spans)
    found = forest.mapInArrow(run, "part int, entry int, n long, total array<long>").where("n > 0")
    found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(widest)]).alias("total"))
    out = [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in books]
    for r in found.collect():  # one row for each entry
        k = r["part"]
        out[k][0][r["entry"]] = r["total"][: books[k].shape[1]]
        out[k][1][r["entry"]] = r["n"]
    return out


def assign(forest: DataFrame, books: list[np.ndarray], dims: int, spans: list[tuple[int, int]], id_type: str, label_type: str) -> DataFrame:
    """vec_id, label, code, error of every row: the last walk."""
    sent = forest.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = batch.column("ids").slice(row, 1).flatten(), batch.column("labels").slice(row, 1).flatten()
                codes, error = np.empty((len(ids), len(spans)), np.uint8), np.zeros(len(ids), np.int64)
                for k, (points, tree) in enumerate(trees_of(batch, row, dims, spans)):
                    book = sent.value[k]
                    _, _, code = walk(points, tree, book)
                    own = np.empty(len(ids), np.int64)
                    own[tree["order"]] = code
                    codes[:, k] = own
                    far = points - book[own]
                    error += (far * far).sum(1)
                text = [c.tobytes().hex() for c in codes]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return forest.mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every row that takes part, and the codebooks (at most 256 entries each)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    session = vectors.sparkSession
    good = whole_numbers(vectors, vec_id, vector, label, scale)
    id_type, label_type = (good.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    length = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = length["d"] if length else 0
    good = good.where(F.size("v") == dims)
    first = good.where("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(entries).select("v").collect() if dims else []
    if not first:
        return session.createDataFrame([], f"vec_id {id_type}, label {label_type}, code string, error long"), []
    spans, most = edges_of(dims, parts), bound(dims, entries)
    start = np.clip(np.array([r["v"] for r in first]), -most, most).astype(np.int64)
    books = [start[:, a:b].copy() for a, b in spans]
    forest = cut(plant(good, dims, spans, most, label_type))
    for _ in range(rounds):
        for book, (sums, counts) in zip(books, tally(forest, books, dims, spans), strict=True):
            used = counts > 0
            book[used] = sums[used] // counts[used][:, None]
    return assign(forest, books, dims, spans, id_type, label_type), books


def books_text(books: list[np.ndarray]) -> str:
    return ",".join(str(x) for book in books for x in book.ravel().tolist())


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over equal labels, nulls together; labels that very many rows share are hot keys."""
    keyed = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = cut(keyed.groupBy("_label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")))
    spare = F.concat(F.lit("-"), F.hex(F.xxhash64("vec_id", "code", "error")))
    return join_hot(keyed, sums, "_label", ["label_error"], spare).drop("_label")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return with_label_error(cut(coded)).select(F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def round_sql(k: int) -> str:
    """Assignment to the entries of round k, and the entries that follow from it."""
    return f"""
, near{k} AS (
  SELECT r, p, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d FROM (
    SELECT x.r, x.p, b.e, list_sum(list_transform(range(1, len(x.c) + 1), lambda i: (x.c[i] - b.c[i]) * (x.c[i] - b.c[i]))) AS d
    FROM parts x JOIN book{k} b USING (p)) GROUP BY r, p
), mean{k} AS (
  SELECT p, e, list(v ORDER BY i) AS c FROM (
    SELECT p, e, i, CAST(floor(CAST(sum(c[i]) AS DOUBLE) / count(*)) AS BIGINT) AS v
    FROM near{k} JOIN parts USING (r, p), (SELECT unnest(range(1, (SELECT max(len(c)) FROM parts) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e
), book{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e))"""


OP13_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
         row_number() OVER (ORDER BY vec_id) AS r
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS (
  SELECT r, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS c FROM kept, (SELECT unnest(range(16)) AS p)
), book0 AS (SELECT p, r - 1 AS e, c FROM parts WHERE r <= 64)
{"".join(round_sql(k) for k in range(ROUNDS + 1))}
, coded AS (
  SELECT vec_id, label, string_agg(lpad(lower(to_hex(CAST(e AS BIGINT))), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM kept JOIN near{ROUNDS} USING (r) GROUP BY r, vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded
"""
