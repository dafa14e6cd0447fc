"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

DataFrame functions only. The text itself is shuffled once, to meet the list of
positions it loses; all else moves 16-byte hashes. A line that very many
documents share is combined on the map side while it is counted; on its way back
it is one of the few hot keys that are broadcast (``join_hot``), so its rows stay
spread over all tasks.

Defined results
* a null text counts as empty: one empty line, which stays;
* lines are cut at ``\\n`` alone; empty and short lines stay;
* a row without a document id keeps all its lines and counts for none;
* repeated rows (same id, same text) lose the same lines; two texts under one id
  count as one document and are each judged by that id;
* an empty table gives an empty result; other columns pass through untouched, but
  n_lines and n_dropped of the caller are replaced by ours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, table

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 10, 2


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text that stays, and n_lines and n_dropped behind its columns.

    A key of at least ``min_chars`` code points that at least ``min_docs``
    documents hold loses its lines everywhere but in the smallest document id.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    # the columns of the caller travel as one struct, so that none of ours can clash with them
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.xxhash64(whole).alias("_th"), F.split(whole, "\n", -1).alias("_lines"))
    lines = (
        docs.where(F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("_id"), F.xxhash64(whole).alias("_th"), F.posexplode(F.split(whole, "\n", -1)).alias("_pos", "_line"))
        .select("_id", "_th", "_pos", F.translate(F.btrim("_line", F.lit(SPACE)), UPPER, LOWER).alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select("_id", "_th", "_pos", F.unhex(F.md5(F.encode("_key", "UTF-8"))).alias("_h"))
    )
    if min_docs == 2:  # two documents hold a key just when its smallest and largest id differ
        held = lines.groupBy("_h").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.count("*").alias("n")).where("_first < _last")
    else:
        held = lines.groupBy("_h").agg(F.min("_id").alias("_first"), F.count_distinct("_id").alias("_docs"), F.count("*").alias("n")).where(F.col("_docs") >= min_docs)
    spare = F.unhex(F.md5(F.concat("_h", F.encode(F.concat_ws("|", "_id", "_th", "_pos"), "UTF-8"))))
    lost = (
        join_hot(lines, cut(held.select("_h", "_first", "n")), "_h", ["_first"], spare)
        .where("_id <> _first")
        .groupBy("_id", "_th")
        .agg(F.collect_set("_pos").alias("_lost"))
        .select(F.col("_id").alias("_lost_id"), F.col("_th").alias("_lost_th"), "_lost")
    )
    met = rows.join(lost.hint("shuffle_hash"), (F.col("_id") == F.col("_lost_id")) & (F.col("_th") == F.col("_lost_th")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_lost")
    kept = F.when(F.col("_lost").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(left, lambda p: F.get("_lines", p)), "\n"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return met.select(
        *[kept.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in names],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), held AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT keyed.doc_id AS doc_id, count(*) AS n_lines,
       count(*) FILTER (held.k IS NOT NULL AND keyed.doc_id <> held.first_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
              FILTER (held.k IS NULL OR keyed.doc_id = held.first_id), '')) AS kept_sha256
FROM keyed LEFT JOIN held ON keyed.k = held.k
GROUP BY keyed.doc_id
"""
