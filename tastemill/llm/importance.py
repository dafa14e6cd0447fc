"""Target-distribution importance resampling: documents are drawn by how much their n-grams are a target's rather than the corpus's.

A position table holds the words of every document with their places (``posexplode``);
over it, ``lead()`` in the order of places puts the following words behind each word, one
step for each order. N-grams are hashed into buckets; the buckets of corpus and target are
counted, a bucket's gain is the logarithm of its smoothed odds, and a document's weight is
the mean gain of its n-grams. Weight plus Gumbel noise, seeded by the id, is its score; the
highest scores are a draw without replacement in proportion to exp(weight).

DataFrame functions only. With orders of one word no step has anything to put behind it,
so there is no window, and texts and words stay where they are read: counts and sums are
combined on the map side, and a row for each bucket or document is shuffled. With longer
n-grams texts are shuffled once, by document; the windows then run where these arrived.
What is broadcast has a row for each bucket (``buckets``, a parameter), or for each
different score: scores are whole numbers between the logarithms of counts, times 1000, so
there are fewer than 200,000 whatever the number of documents. Ranks are places inside one
score, on top of the sum of the scores above.

Defined results
* null or empty text, or one without words: no features, weight 0, not drawn;
* rows without an id share the noise of an empty id and come last of equal scores;
* repeated rows count as often as they stand there and get ranks one after another; of equal
  scores and ids, the smaller hash of the text comes first;
* an empty table gives no rows, an empty target gains against no counts at all;
* texts of any length are read whole; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .line_dedup import LOWER, UPPER

#: All that is not a word of the contract, before A-Z become a-z.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"


def low(word: Column) -> Column:
    """A-Z in lower case; of words of one byte a letter the quick function does the same."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def position_table(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """A row for each word (_pos, _word); for a text without words one row of nulls."""
    found = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), GAPS, -1), "")
    return texts.select(*keys, F.posexplode_outer(found).alias("_pos", "_raw")).withColumn("_word", low(F.col("_raw"))).drop("_raw")


def n_grams(docs: DataFrame, orders: int, doc_id: str, text: str) -> DataFrame:
    """_id, _th, _n (rows that are equal), _head (1 at a document's first row, else 0), _order, _gram."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(whole).alias("_th"), whole.alias("_text"))
    if orders == 1:
        places = position_table(rows, "_text", "_id", "_th")
        return places.select("_id", "_th", F.lit(1).cast("long").alias("_n"), F.when(F.coalesce("_pos", F.lit(0)) == 0, 1).otherwise(0).alias("_head"), F.lit(1).alias("_order"), F.col("_word").alias("_gram"))
    # equal rows become one, else their places would mix; it also spreads them
    rows = rows.groupBy("_id", "_th").agg(F.any_value("_text").alias("_text"), F.count("*").alias("_n"))
    places = position_table(rows, "_text", "_id", "_th", "_n")
    along = Window.partitionBy("_id", "_th").orderBy("_pos")
    following = [F.lead("_word", k).over(along).alias(f"_word{k}") for k in range(1, orders)]
    places = places.select("*", *following)
    runs, names = [], ["_word"]
    for k in range(1, orders + 1):
        runs.append(F.when(F.col(names[-1]).isNotNull(), F.struct(F.lit(k).alias("_order"), F.concat_ws(" ", *names).alias("_gram"))))
        names.append(f"_word{k}")
    one = F.explode_outer(F.array_compact(F.array(*runs)))
    grams = places.select("_id", "_th", "_n", "_pos", one.alias("_run"))
    head = F.when((F.coalesce("_pos", F.lit(0)) == 0) & (F.coalesce("_run._order", F.lit(1)) == 1), 1).otherwise(0)
    return grams.select("_id", "_th", "_n", head.alias("_head"), "_run._order", "_run._gram")


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.crc32(F.col("_gram").cast("binary")), F.lit(buckets))


def bucket_counts(grams: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): at most ``buckets`` rows."""
    return cut(grams.where("_gram IS NOT NULL").groupBy(bucket_of(buckets).alias("bucket")).agg(F.sum("_n").alias("n")))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of the buckets that the corpus has, from two tables of counts."""
    s_all = corpus.agg(F.sum("n")).first()[0] or 0
    t_all = target.agg(F.sum("n")).first()[0] or 0
    both = corpus.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    t = F.coalesce("t", F.lit(0)).cast("double")
    odds = (t + 1) * F.lit(float(s_all + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(t_all + buckets)))
    return both.select(F.col("bucket"), F.floor(1000 * F.log(odds)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: str) -> Column:
    """1000 times a Gumbel variate, floored, from the first 32 bits of a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """One row per document: its id, n_features, weight, score, rank (null if it is not drawn).

    Of the documents with at least ``min_words`` words, floor(``percent`` * N / 100) are drawn.
    """
    grams = n_grams(docs, orders, doc_id, text)
    # of the target only counts are needed, so its texts are their own ids
    wanted = n_grams(target.select(F.xxhash64(target_text).alias("_i"), F.col(target_text).alias("_t")), orders, "_i", "_t")
    gain = gains(bucket_counts(grams, buckets), bucket_counts(wanted, buckets), buckets)
    met = grams.withColumn("bucket", bucket_of(buckets)).join(F.broadcast(gain), "bucket", "left")
    n = F.col("_n")
    scored = met.groupBy("_id", "_th").agg(
        F.sum(n * F.col("_head")).alias("_rows"),
        F.sum(F.when(F.col("_gram").isNotNull(), n).otherwise(0)).alias("_features"),
        F.sum(F.when(F.col("_gram").isNotNull() & (F.col("_order") == 1), n).otherwise(0)).alias("_words"),
        F.sum(n * F.coalesce("gain", F.lit(0))).alias("_gain"),
    )
    weight = F.when(F.col("_features") > 0, F.floor(F.col("_gain") / F.col("_features"))).otherwise(0).cast("long")
    scored = scored.select("_id", "_th", "_rows", (F.col("_features") / F.col("_rows")).cast("long").alias("n_features"), (F.col("_words") >= min_words * F.col("_rows")).alias("_fit"), weight.alias("weight"))
    scored = cut(scored.withColumn("score", F.col("weight") + noise(F.col("_id"), seed)))
    return ranked(scored, percent).select(F.col("_id").alias(doc_id), "n_features", "weight", "score", "rank")


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """``scored`` with a row for each equal row, and rank: places by score (falling), id and hash, of the highest ``percent`` of those that fit."""
    levels = cut(scored.where("_fit").groupBy("score").agg(F.sum("_rows").alias("_held")))  # one row for each whole number
    drawn = percent * (levels.agg(F.sum("_held")).first()[0] or 0) // 100
    above = F.coalesce(F.sum("_held").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.select("score", above.alias("_above")).where(F.col("_above") < drawn)
    met = scored.join(F.broadcast(levels), "score", "left").withColumn("_in", F.col("_fit") & F.col("_above").isNotNull())
    inside = Window.partitionBy("score").orderBy(F.asc_nulls_last("_id"), "_th").rowsBetween(Window.unboundedPreceding, -1)
    chosen = met.where("_in").withColumn("_first", F.col("_above") + F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
    every = chosen.unionByName(met.where("NOT _in").withColumn("_first", F.lit(drawn).cast("long")))
    every = every.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    place = F.col("_first") + F.col("_copy")
    return every.withColumn("rank", F.when(F.col("_in") & (place <= drawn), place))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text"))


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, 0 AS kind, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark
), worded AS (
  SELECT doc_id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts
), features AS (SELECT doc_id, kind, unnest(words) AS word FROM worded
), hexed AS (SELECT DISTINCT word, hex(word) AS h FROM features
), bits AS (
  SELECT word, list_transform(range(4 * len(h)), lambda j: CASE WHEN j % 8 = 0 THEN
         16 * (instr('0123456789ABCDEF', substr(h, CAST(j // 4 + 1 AS INTEGER), 1)) - 1) + instr('0123456789ABCDEF', substr(h, CAST(j // 4 + 2 AS INTEGER), 1)) - 1
         ELSE 0 END) AS steps
  FROM hexed
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(steps, lambda s: CAST(s AS BIGINT))),
         lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * CAST(3988292384 AS BIGINT))), CAST(4294967295 AS BIGINT)) % 10000 AS bucket
  FROM bits
), counted AS (
  SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM features JOIN hashed USING (word) GROUP BY bucket
), totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counted
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS g
  FROM counted, totals
), weighed AS (
  SELECT doc_id, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM features JOIN hashed USING (word) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY doc_id
), noisy AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         CAST(('0x' || substr(sha256('2024:' || w.doc_id), 1, 8)) AS BIGINT) AS h
  FROM worded w LEFT JOIN weighed USING (doc_id) WHERE kind = 0
), scored AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM noisy
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
