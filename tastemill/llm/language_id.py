"""Language ID: script ranges narrow the candidates, Viterbi with a switching penalty labels spans.

A word is a run of letters. Every letter of a word brings the log likelihood of
the three characters around it and of it with its predecessor, under each
learned language; a word's score is their sum. The script of its first letter
leaves only the languages that write in it. Viterbi over the words of a text,
paying ``SWITCH`` for each change of language, labels the spans. The predicted
language is the one that labels most letters; the score is its share of them.

The model is fitted on at most ``SAMPLE_DOCS`` labelled documents (smallest hash
of the id first); everything else reads every whole text. Texts are cut into
segments only to run Viterbi on many of them at once; the combination of
segments is exact: a first pass gives each segment's best way from every label to
every label, some segments at a time, a second one, once the label at its start is
known, k back pointers a word. The model has a row of numbers for each language and
is broadcast, so more than ``MODEL_BYTES`` of it (1,000 languages) are refused.

Defined results
* null text, or no letter: ``und`` with score 0;
* nothing to learn from: every text is ``und`` with score 0;
* equal shares: the language that sorts first;
* repeated rows give repeated results; an empty table gives an empty one;
  further columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, column, mix64, table

SAMPLE_DOCS = 6_000
SWITCH = 6.0
#: Buckets of hashed character groups.
BUCKETS = 1 << 16
#: Bytes of the largest model that is broadcast.
MODEL_BYTES = 1 << 29
#: Words of a segment, and numbers of the first pass held at a time.
SEGMENT, SLAB = 128, 4_000_000
#: Least share of a language's letters for a script to be one of its own.
SCRIPT_SHARE = 0.005
FOLD, HELD = 4, 2

#: Ranges of code points by script (Unicode blocks).
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
    ("han", 0x20000, 0x3FFFF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


def letter(point: int) -> int:
    """The lower-case letter of a code point; 0: it is none."""
    c = chr(point)
    if 0xD800 <= point < 0xE000 or not c.isalpha():
        return 0
    low = c.lower()
    return ord(low) if len(low) == 1 else point


def script_of(point: int) -> int:
    return next((SCRIPT_NAMES.index(name) for name, first, last in SCRIPTS if first <= point <= last), 0)


class Letters:
    """Letter and script of code points: a table of the usual ones, made once in each task; all others as they come."""

    SIZE = 0x20000

    def __init__(self):
        self.lower = np.array([letter(i) for i in range(self.SIZE)], np.uint32)
        self.script = np.zeros(self.SIZE, np.uint8)
        for name, first, last in SCRIPTS:
            self.script[first : last + 1] = SCRIPT_NAMES.index(name)

    def look_up(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        usual = points < self.SIZE
        if usual.all():
            return self.lower[points], self.script[points]
        at = np.where(usual, points, 32)
        low, script = self.lower[at], self.script[at]
        rare, where = np.unique(points[~usual], return_inverse=True)
        low[~usual] = np.array([letter(p) for p in rare.tolist()], np.uint32)[where]
        script[~usual] = np.array([script_of(p) for p in rare.tolist()], np.uint8)[where]
        return low, script


def words_of(texts: list[str], tables: Letters):
    """Of all letters of the texts, one after another: hashed groups, script, word starts; and the text of each word."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    low, script = tables.look_up(points)
    inside = low > 0
    padded = np.concatenate([np.zeros(1, np.uint32), low, np.zeros(1, np.uint32)]).astype(np.uint64)
    at = np.flatnonzero(inside)
    before, here, after = padded[at], padded[at + 1], padded[at + 2]
    two = (mix64(before * np.uint64(0x110000) + here + np.uint64(1 << 50)) % np.uint64(BUCKETS)).astype(np.int32)
    three = (mix64((before * np.uint64(0x110000) + here) * np.uint64(0x110000) + after) % np.uint64(BUCKETS)).astype(np.int32)
    first = before == 0
    starts = np.flatnonzero(first)  # of words, among the letters
    ends = np.cumsum([len(t) + 1 for t in texts])
    text_of = np.searchsorted(ends, at[starts], side="right")
    return two, three, script[at], starts, text_of, at


@dataclass
class Model:
    langs: list[str]
    two: np.ndarray  # buckets x languages
    three: np.ndarray
    allowed: np.ndarray  # scripts x languages


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """From text and lang of at most ``sample`` labelled documents."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    ids = known.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.md5(F.encode(F.col("doc_id").cast("string"), "UTF-8")), "doc_id").limit(sample).distinct()
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = Letters(), {}
        for batch in chunks(batches):
            langs, texts = column(batch, "lang"), column(batch, "text")
            for lang in set(langs):
                two, three, script, _, _, _ = words_of([t for t, x in zip(texts, langs, strict=True) if x == lang], tables)
                sums = held.setdefault(lang, np.zeros(2 * BUCKETS + len(SCRIPT_NAMES), np.int64))
                sums[:BUCKETS] += np.bincount(two, minlength=BUCKETS)
                sums[BUCKETS : 2 * BUCKETS] += np.bincount(three, minlength=BUCKETS)
                sums[2 * BUCKETS :] += np.bincount(script, minlength=len(SCRIPT_NAMES))
        for lang, sums in held.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["lang", "at", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counted["lang"]))
    if len(langs) * 2 * BUCKETS * 4 > MODEL_BYTES:
        raise ValueError(f"{len(langs)} languages: a model of them is too large to broadcast")
    sums = np.zeros((2 * BUCKETS + len(SCRIPT_NAMES), len(langs)))
    sums[counted["at"].to_numpy(), [langs.index(x) for x in counted["lang"]]] = counted["n"].to_numpy()

    def logs(part: np.ndarray) -> np.ndarray:
        part = part + 0.5
        return np.log(part / part.sum(0)).astype(np.float32) / 2  # the two groups of a letter overlap, so each counts half

    script = sums[2 * BUCKETS :]
    share = script / np.maximum(script.sum(0), 1)
    return Model(langs, logs(sums[:BUCKETS]), logs(sums[BUCKETS : 2 * BUCKETS]), share >= SCRIPT_SHARE)


def viterbi(scores: np.ndarray, text_of: np.ndarray, n_texts: int, penalty: float = SWITCH) -> np.ndarray:
    """The best label of each word; words of a text stand together, in order of texts."""
    n, k = scores.shape
    per_text = np.bincount(text_of, minlength=n_texts)
    segments = -(-per_text // SEGMENT)
    first_segment = np.cumsum(segments) - segments
    m = int(segments.sum())
    of = np.repeat(np.arange(n_texts), segments)
    nth = np.arange(m) - first_segment[of]
    start = (np.cumsum(per_text) - per_text)[of] + nth * SEGMENT
    length = np.minimum(SEGMENT, per_text[of] - nth * SEGMENT)
    order = np.argsort(-length, kind="stable")  # so the segments that still run stand in front

    def running(part: np.ndarray) -> np.ndarray:
        return np.searchsorted(-length[part], -np.arange(int(length[part].max(initial=0))), side="left")

    way = np.empty((m, k, k), np.float32)  # from the label before the segment to its last one
    for lo in range(0, m, max(1, SLAB // (k * k))):
        part = order[lo : lo + max(1, SLAB // (k * k))]
        state = np.full((len(part), k, k), -np.inf, np.float32)
        state[:, np.arange(k), np.arange(k)] = 0
        for t, live in enumerate(running(part).tolist()):
            now = state[:live]
            np.maximum(now, now.max(2, keepdims=True) - np.float32(penalty), out=now)
            now += scores[start[part[:live]] + t][:, None, :]
        way[part] = state
    by_size = np.argsort(-segments, kind="stable")
    entry, leave = np.empty((m, k), np.int64), np.zeros(m, np.int64)
    value = np.zeros((n_texts, k), np.float32)
    for j in range(int(segments.max(initial=0))):
        live = by_size[: np.searchsorted(-segments[by_size], -j, side="left")]
        at = first_segment[live] + j
        total = value[live][:, :, None] + way[at]
        entry[at], value[live] = total.argmax(1), total.max(1)
        value[live] -= value[live].max(1, keepdims=True)
    enter, now = np.zeros(m, np.int64), value.argmax(1)
    for j in range(int(segments.max(initial=0)) - 1, -1, -1):
        live = by_size[: np.searchsorted(-segments[by_size], -j, side="left")]
        at = first_segment[live] + j
        leave[at] = now[live]
        enter[at] = entry[at, now[live]]
        now[live] = enter[at]
    # the labels at both ends are known now
    state = np.full((m, k), -np.inf, np.float32)
    state[np.arange(m), enter[order]] = 0
    stay, switch, label = np.empty((n, k), bool), np.empty(n, np.int32), np.empty(n, np.int64)
    live_at = running(order).tolist()
    for t, live in enumerate(live_at):
        held, at = state[:live], start[order[:live]] + t
        best = held.argmax(1)
        moved = held[np.arange(live), best][:, None] - np.float32(penalty)
        stay[at], switch[at] = held >= moved, best
        state[:live] = np.maximum(held, moved) + scores[at]
    now = leave[order]
    for t in range(len(live_at) - 1, -1, -1):
        live = live_at[t]
        at = start[order[:live]] + t
        label[at] = now[:live]
        now[:live] = np.where(stay[at, now[:live]], now[:live], switch[at])
    return label


def label_texts(texts: list[str], model: Model, tables: Letters):
    """Per text its language, score, and spans as (start, end, language) in characters."""
    n, k = len(texts), len(model.langs)
    two, three, script, starts, text_of, at = words_of(texts, tables)
    none = [("und", 0.0, [])] * n
    if not len(starts) or not k:
        return none
    scores = np.add.reduceat(model.two[two] + model.three[three], starts, axis=0)
    fits = model.allowed[script[starts]]
    fits[~fits.any(1)] = True
    scores = np.where(fits, scores, scores.min() - 100).astype(np.float32)
    labels = viterbi(scores - scores.max(1, keepdims=True), text_of, n)
    size = np.diff(np.append(starts, len(at)))
    held = np.bincount(text_of * k + labels, weights=size, minlength=n * k).reshape(n, k)
    total = held.sum(1)
    pick = held.argmax(1)
    change = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]) | (text_of[1:] != text_of[:-1])))
    offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    last_letter = at[np.append(starts[1:], len(at)) - 1]
    spans: list[list] = [[] for _ in range(n)]
    for a, b in zip(change.tolist(), np.append(change[1:], len(labels)).tolist(), strict=True):
        t = int(text_of[a])
        spans[t].append((int(at[starts[a]] - offset[t]), int(last_letter[b - 1] - offset[t] + 1), model.langs[labels[a]]))
    return [(model.langs[pick[i]], float(held[i, pick[i]] / total[i]), spans[i]) if total[i] else none[0] for i in range(n)]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, spans of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain parts: workers need no copy of this package
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, model = Letters(), SimpleNamespace(**sent.value)
        for batch in chunks(batches):
            found = label_texts([t or "" for t in column(batch, "text")], model, tables)
            spans = pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in f[2]] for f in found], span)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def held_out(fold: int, rest: int, doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % fold == rest, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(FOLD, HELD)))
    found = identify(docs, model)
    return found.select("doc_id", held_out(FOLD, HELD).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
