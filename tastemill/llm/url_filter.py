"""URL filters: a trie over reversed host labels and path segments, longest match first.

A rule is a host and a path. It fits its host and every subdomain if the path of
the URL starts with the rule's path. The longest match wins: most host labels
first, then the longest path, and at the same place block before allow. Rules are a
list or a table (verdict, rule_host, rule_path). The trie is broadcast while there are
at most ``TRIE_RULES`` rules (each of at most ``RULE_CHARS`` characters, which bounds its
size); a longer table never comes to the driver: it is joined by host suffix instead,
with the same result.

Defined results
* columns host, path, rule and verdict of the caller are replaced by ours;
* null url, or none with ``://``: empty host and path, no rule, the default verdict;
* user info and port belong to the host, as the contract has it;
* repeated rows give repeated results, an empty table an empty one; further
  columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, cut, join_hot, table

TRIE_RULES, RULE_CHARS = 100_000, 2_000
DEFAULT_VERDICT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def new_node() -> dict:
    """A place of the trie: children by host label or path segment, and the rules that end here.

    The last piece of a rule's path may end inside a segment, so the rules of a
    place are kept by piece, with the lengths that pieces have, longest first. Plain parts
    only: workers need no copy of this package to read the broadcast.
    """
    return {"labels": {}, "paths": {}, "ends": {}, "lengths": []}


def build(rules: Iterable[tuple[str, str, str]]) -> dict:
    root = new_node()
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node["labels"].setdefault(label, new_node())
        *whole, last = path.split("/")
        for segment in whole:
            node = node["paths"].setdefault(segment, new_node())
        if node["ends"].get(last, ("", ""))[1] != "block":
            node["ends"][last] = host + path, verdict
        if len(last) not in node["lengths"]:
            node["lengths"] = sorted([*node["lengths"], len(last)], reverse=True)
    return root


def find(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest match."""
    if not host:
        return None
    on_way, node = [], root
    for label in reversed(host.split(".")):
        node = node["labels"].get(label)
        if node is None:
            break
        on_way.append(node)
    segments = path.split("/")
    for node in reversed(on_way):
        best = None
        for depth, segment in enumerate(segments):
            for n in node["lengths"]:
                if n <= len(segment) and (found := node["ends"].get(segment[:n])) is not None:
                    best = found
                    break
            if depth + 1 == len(segments) or (node := node["paths"].get(segment)) is None:
                break
        if best:
            return best
    return None


def split_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with its host and path columns, by JVM string functions."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"), "#", 1))
    rest = F.substring_index(rest, "?", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.when(F.instr(rest, "/") > 0, rest.substr(F.instr(rest, "/"), F.length(rest))).otherwise("")
    return df.withColumns({"host": F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), "path": F.coalesce(path, F.lit(""))})


def judge(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """``df`` (with host and path) and its columns rule and verdict."""
    if isinstance(rules, DataFrame):
        size = rules.agg(F.count("*").alias("n"), F.max(F.length("rule_host") + F.length("rule_path")).alias("chars")).first()
        if size["n"] > TRIE_RULES or (size["chars"] or 0) > RULE_CHARS:
            return judge_by_join(df, rules, default)
        rules = [tuple(r) for r in rules.select("verdict", "rule_host", "rule_path").collect()]
    elif len(rules) > TRIE_RULES or any(len(h) + len(p) > RULE_CHARS for _, h, p in rules):
        return judge_by_join(df, df.sparkSession.createDataFrame(rules, "verdict string, rule_host string, rule_path string"), default)
    trie = df.sparkSession.sparkContext.broadcast(build(rules))
    names = [c for c in df.columns if c not in ("rule", "verdict")]
    kept = df.select(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie.value
        for batch in batches:
            found = [find(root, h or "", p or "") or (None, default) for h, p in zip(column(batch, "host"), column(batch, "path"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=[*batch.schema.names, "rule", "verdict"]
            )

    return kept.mapInArrow(walk, schema)


def judge_by_join(df: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """The same for a rule table of any size, by joins.

    A host suffix meets the lengths that the paths of its rules have, and then the rule of each such piece of the path,
    so a suffix with many rules does not meet each of them. Suffixes and pieces that many URLs share are hot keys in both joins.
    """
    names = [c for c in df.columns if c not in ("rule", "verdict")]
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    # one row for each different (host, path), so that repeated rows cost nothing and need no key
    places = cut(df.select("host", "path").where("host IS NOT NULL AND path IS NOT NULL").distinct()).withColumn("rule_host", F.explode(suffixes))
    spare = F.concat(F.lit("\0"), F.hex(F.xxhash64("host", "path", "rule_host")))
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    known = cut(places.groupBy("rule_host").agg(F.count("*").alias("n")).join(lengths, "rule_host"))
    pieces = join_hot(places, known, "rule_host", ["lengths"], spare).withColumn("size", F.explode("lengths")).where(F.length("path") >= F.col("size"))
    pieces = cut(pieces.select("host", "path", "rule_host", "size", F.concat("rule_host", F.lit("\0"), F.expr("left(path, size)")).alias("piece")))
    ends = rules.groupBy(F.concat("rule_host", F.lit("\0"), "rule_path").alias("piece")).agg(F.max_by("verdict", F.col("verdict") == "block").alias("_verdict"))
    known = cut(pieces.groupBy("piece").agg(F.count("*").alias("n")).join(ends, "piece"))
    met = join_hot(pieces, known, "piece", ["_verdict"], F.concat(F.lit("\0"), F.hex(F.xxhash64("host", "path", "piece"))))
    rule = F.struct(F.concat("rule_host", F.expr("left(path, size)")).alias("rule"), F.col("_verdict").alias("verdict"))
    best = met.groupBy("host", "path").agg(F.max_by(rule, F.struct(F.size(F.split("rule_host", "[.]")), "size")).alias("_best"))
    out = df.select(*names).join(best, ["host", "path"], "left")
    return out.select(*names, F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(split_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url"), RULES)


OP9_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM parts
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN rest LIKE '%/%' THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM cut
), rules(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), urls AS (SELECT DISTINCT host, path FROM split
), best AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (host, path)
"""
