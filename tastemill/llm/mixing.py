"""Mixing sources to target weights by weighted fair queueing.

Every source is one flow. Its documents are shuffled (a seeded hash of the id),
and each copy of a document gets a virtual finish time: the words of its source
up to and with it, divided by the target of the source. Serving the copies of
all sources in the order of these times gives every source its share at any
moment; the order is cut where the budget of words is used up. A source whose
target exceeds its size starts over, at most ``MAX_REPEATS`` times in all.

Nothing is collected and no window holds a whole source: prefix sums run inside
(source, hash bucket), over sums of buckets, and the global order is searched by
range buckets of the finish time, narrowed until one bucket is small enough to
sort exactly. Texts are read once, only to count their words.

Defined results
* null text: size 0; nothing is taken of documents of size 0;
* null source: a source of its own, after the others;
* null id: shuffled by a hash of the text instead, so many such rows do not share a place;
* rows equal in id, source and size stand one after another; the cut may fall between them, so that of equal rows some are taken, and reruns take as many;
* very long texts are counted where they are read and moved nowhere; one id's repeated rows share a hash bucket;
* an empty table, or one without words: no row, or all targets 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = "mix-1"
#: Rows that a bucket should hold; it decides the number of buckets, never the result.
BUCKET_ROWS = 20_000
#: Range buckets of one step of the search.
STEPS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: its rank by code point, weight and target. One row per source, so single-task windows are fine.

    Sources in the order of size / weight fill up first; a source is full if it
    would reach ``repeats`` times its size at the level of those not yet full.
    """
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("_weight", weight).withColumn("_ratio", F.col("source_size") / F.col("_weight"))
    full = float(repeats) * F.col("source_size")
    rest = F.sum("source_size").over(every) - float(repeats) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    left = F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    tried = ranked.withColumn("_level", rest / left).withColumn("_full", full <= F.col("_weight") * F.col("_level"))
    level = F.min(F.when(~F.col("_full"), F.struct("_ratio", "_rank", "_level"))).over(every)["_level"]
    return tried.select("source", "source_size", "_rank", F.when(F.col("_full"), full).otherwise(F.col("_weight") * level).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    nameless = F.concat(F.lit("|"), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    shuffled = F.md5(F.encode(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), nameless)), "UTF-8"))
    rows = cut(docs.select("doc_id", "source", size.alias("size"), shuffled.alias("_k")))
    n_rows = rows.count()
    known = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    digits = 1
    while 16**digits * BUCKET_ROWS < n_rows:
        digits += 1
    # running words of a source: inside its hash buckets, on top of the sum of the buckets before
    bucket = F.substring("_k", 1, digits)
    inside = Window.partitionBy("source", "_bucket").orderBy("_k", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    running = rows.withColumn("_bucket", bucket).withColumn("_run", F.sum("size").over(inside))
    running = running.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    known = known.withColumnRenamed("source", "_s")
    queue = running.join(known, F.col("source").eqNullSafe(F.col("_s")))
    queue = cut(queue.select("doc_id", "size", "_k", "_rank", (F.col("_ahead") + F.col("_run")).alias("_upto"), "source_size", "target"))

    def finish(turn: Column) -> Column:
        return (turn * F.col("source_size") + F.col("_upto")).cast("double") / F.col("target")

    copies = queue.where("size > 0").select("size", "_rank", "_k", "doc_id", F.explode(F.array(*map(F.lit, range(repeats)))).alias("_turn"), "source_size", "_upto", "target")
    copies = copies.select(finish(F.col("_turn")).alias("v"), F.col("_rank").alias("r"), F.col("_k").alias("k"), F.col("doc_id").alias("d"), F.col("_turn").alias("t"), "size")
    last = last_served(copies, n_rows)

    def served(turn: int) -> Column:
        if last is None:
            return F.lit(0)
        key = F.struct(finish(F.lit(turn)).alias("v"), F.col("_rank").alias("r"), F.col("_k").alias("k"), F.col("doc_id").alias("d"), F.lit(turn).alias("t"))
        limit = F.struct(F.lit(last.v).alias("v"), F.lit(last.r).alias("r"), F.lit(last.k).alias("k"), F.lit(last.d).cast("long").alias("d"), F.lit(last.t).alias("t"))
        return (key <= limit).cast("long")

    taken = F.when(F.col("size") > 0, F.col("size") * sum((served(t) for t in range(1, repeats)), served(0))).otherwise(0)
    return queue.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def last_served(copies: DataFrame, n_rows: int):
    """The last copy in order of (v, r, k, d, t) with which the budget, all sizes once, is not exceeded; None if there is none."""
    whole = copies.agg(F.sum("size").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("rows")).first()
    if not whole["rows"]:
        return None
    budget = copies.where("t = 0").agg(F.sum("size").alias("n")).first()["n"]
    lo, hi, base, held, best = whole["lo"], whole["hi"], 0, whole["rows"], None
    part = copies
    while held > BUCKET_ROWS and hi > lo:
        width = (hi - lo) / STEPS
        if lo + width == lo:
            break
        step = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(STEPS - 1))
        sums = part.groupBy(step.alias("g")).agg(F.sum("size").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("rows"), F.max(F.struct("v", "r", "k", "d", "t")).alias("end"))
        upto = sums.withColumn("upto", F.sum("n").over(Window.orderBy("g"))).orderBy("g")
        inside = upto.where(F.col("upto") <= budget - base).orderBy(F.desc("g")).select("upto", "end").first()
        over = upto.where(F.col("upto") > budget - base).first()
        if inside is not None:
            best = inside["end"]
        if over is None:
            return best
        base += inside["upto"] if inside is not None else 0
        part = part.where(F.col("v").between(over["lo"], over["hi"]))
        lo, hi, held = over["lo"], over["hi"], over["rows"]
    # peers of equal keys share one sum (a range frame), so they stand or fall together
    upto = part.withColumn("_upto", F.sum("size").over(Window.orderBy("v", "r", "k", "d", "t")))
    found = upto.where(F.col("_upto") <= budget - base).orderBy(*map(F.desc, ("v", "r", "k", "d", "t"))).first()
    return found if found is not None else best


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def mix_sql(documents: str = "documents") -> str:
    return rf"""
WITH rows_ AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '|' || md5(coalesce(text, '')))) AS k
  FROM {documents}
), sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM rows_ GROUP BY source
), ranked AS (SELECT source, s, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM sizes
), weighed AS (SELECT *, CAST((r - 1) % 3 + 1 AS DOUBLE) AS w FROM ranked
), tried AS (
  SELECT *, (CAST(sum(s) OVER () AS DOUBLE) - 3.0::DOUBLE * CAST(coalesce(sum(s) OVER b, 0) AS DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lvl
  FROM weighed WINDOW b AS (ORDER BY s / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (SELECT *, 3.0::DOUBLE * s <= w * lvl AS sat FROM tried
), known AS (
  SELECT source, s, r, CASE WHEN sat THEN 3.0::DOUBLE * s ELSE w * (SELECT arg_min(lvl, {{'a': s / w, 'b': r}}) FROM filled WHERE NOT sat) END AS target FROM filled
), queue AS (
  SELECT doc_id, size, k, r, s, target,
         CAST(sum(size) OVER (PARTITION BY r ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c
  FROM rows_ JOIN known ON rows_.source IS NOT DISTINCT FROM known.source
), copies AS (
  SELECT *, CAST(t * s + c AS DOUBLE) / target AS v FROM queue, (VALUES (0), (1), (2)) turns(t) WHERE size > 0
), served AS (
  SELECT doc_id, k, r, c, size, sum(size) OVER (ORDER BY v, r, k, doc_id, t) <= (SELECT sum(size) FROM rows_) AS yes FROM copies
), counted AS (SELECT doc_id, k, r, c, count(*) FILTER (yes) AS n FROM served GROUP BY ALL
)
SELECT queue.doc_id AS doc_id, size, s AS source_size, target, CAST(size * coalesce(n, 0) AS BIGINT) AS taken
FROM queue LEFT JOIN counted ON queue.doc_id IS NOT DISTINCT FROM counted.doc_id AND queue.k = counted.k AND queue.r = counted.r AND queue.c = counted.c AND size > 0
"""


OP2_SQL = mix_sql()
