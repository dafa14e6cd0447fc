"""SentencePiece encoding and decoding (byte-pair merges with byte fallback), by vectorised merge rounds.

The vocabulary file is read once on the driver; what is broadcast are its tables
(one entry for each way to cut a piece in two pieces). Texts are cut into words,
each different word of a step is encoded once. The symbols of all words stand in
one flat array. A round finds the smallest rank of a pair in every word, merges
all its places at once, leftmost first where they overlap, and looks up only the
pairs that are new; words without a pair leave the arrays.

Why this equals merging one best (then leftmost) pair at a time:
* words are cut where no piece of the vocabulary holds the two characters that
  meet there, so no merge can cross a cut;
* several places are merged at once only if the piece made is *calm*: every piece
  that it could take part in has a larger rank, so the next best pair is again one
  of the places. Where it is not, the leftmost place alone is merged in that round
  (in runs of blanks, say, whose pieces all have one rank);
* words that still have pairs after ``ROUNDS`` rounds, such as very long runs, are
  carried on from where they are by the same order of merges from a heap.

Decoding looks up the bytes of all ids at once; only texts that are not valid
UTF-8 afterwards (ids that did not come from a text) are read run by run.

Defined results
* null text: as the empty one, which has no piece but the end id;
* null list of ids: the empty text; ids beyond the vocabulary raise;
* bytes that are not UTF-8 count as U+FFFD;
* texts of any length are encoded whole, one at a time beyond the step's size; what
  is held is proportional to the step;
* repeated rows give repeated results, empty tables empty ones; other columns pass
  through, but a column with the name of ours is replaced;
* vocabularies that normalise, strip blanks, have symbols of the user's own, or no
  byte fallback are refused when they are loaded.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, table

VOCABULARY = "piece_bpe_32k.model"
BLANK = "▁"
#: Kinds of pieces in the file.
NORMAL, UNKNOWN, CONTROL, OWN, BYTE = 1, 2, 3, 4, 6
NEVER = np.int64(1) << 40
#: Symbols of characters without a piece start here; the character's number is added.
FOREIGN = np.int64(1) << 24
ROUNDS = 256
#: Bytes of text that one step of encoding holds (more text, fewer different words to a byte), and ids that one of decoding does.
STEP_BYTES, STEP_IDS = 6_000_000, 1_000_000


def messages(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        n = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, raw[at : at + n]
        at += n


def load(path: str) -> dict:
    """The tables of a vocabulary file."""
    pieces, trained, normal = [], {}, {}
    for field, value in messages(Path(path).read_bytes()):
        if field == 1:
            one = dict(messages(value))
            pieces.append((one[1].decode(), struct.unpack("<f", one[2])[0] if 2 in one else 0.0, one.get(3, NORMAL)))
        elif field == 2:
            trained = dict(messages(value))
        elif field == 3:
            normal = dict(messages(value))
    unsupported = {
        "not byte pairs": trained.get(3, 1) != 2,
        "no byte fallback": not trained.get(35, 0),
        "blanks as suffix": bool(trained.get(24, 0)),
        "a normalisation": bool(normal.get(2, b"")),
        "blanks stripped": bool(normal.get(4, 1)),
        "blanks not escaped": not normal.get(5, 1),
        "own symbols": any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for *_, kind in pieces),
    }
    if any(unsupported.values()):
        raise ValueError("vocabulary with " + ", ".join(k for k, bad in unsupported.items() if bad))
    _, level = np.unique([-score for _, score, _ in pieces], return_inverse=True)
    ids = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind == NORMAL}
    pairs = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    left, right, made = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
    keys = (left << 32) | right
    order = np.argsort(keys)
    calm = np.ones(len(pieces), bool)
    for part in (left, right):
        calm[part[level[made] <= level[part]]] = False
    letters = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
    meet = sorted({(ord(p[k]) << 32) | ord(p[k + 1]) for p in ids for k in range(len(p) - 1)})
    unknown = bytes(trained.get(44, " ⁇ ".encode()))
    surface = [unknown if kind == UNKNOWN else b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(BLANK, " ").encode() for p, _, kind in pieces]
    return {
        "keys": keys[order],
        "made": made[order],
        "level": level.astype(np.int64),
        "calm": calm,
        "letters": np.array([c for c, _ in letters], np.int64),
        "letter_ids": np.array([i for _, i in letters], np.int64),
        "meet": np.array(meet, np.int64),
        "bytes": np.array([i for _, i in sorted((int(p[3:5], 16), i) for i, (p, _, kind) in enumerate(pieces) if kind == BYTE)], np.int64),
        "surface": np.frombuffer(b"".join(surface), np.uint8),
        "widths": np.array([len(s) for s in surface], np.int64),
        "kinds": np.array([kind for *_, kind in pieces], np.int8),
        "opens": np.array([kind == NORMAL and p.startswith(BLANK) for p, _, kind in pieces]),
        "start": int(trained.get(41, 1)),
        "end": int(trained.get(42, 2)),
        "prefix": bool(normal.get(3, 1)),
        "inside": any(a != BLANK and b == BLANK for p in ids for a, b in zip(p, p[1:])),
    }


def look_up(left: np.ndarray, right: np.ndarray, model: dict) -> np.ndarray:
    """The piece that each pair makes, or -1."""
    keys = (left << 32) | right
    at = np.minimum(np.searchsorted(model["keys"], keys), len(model["keys"]) - 1)
    return np.where(model["keys"][at] == keys, model["made"][at], -1)


def heads_of(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices values[start : start + length], one after another."""
    return values[np.repeat(start - heads_of(length), length) + np.arange(length.sum())]


def by_heap(symbols: list[int], model: dict) -> list[int]:
    """One best pair at a time, the leftmost of equals."""
    if "pairs" not in model:
        model["pairs"] = dict(zip(model["keys"].tolist(), model["made"].tolist(), strict=True))
    pairs, level = model["pairs"], model["level"]
    n = len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    waiting: list[tuple[int, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (made := pairs.get((symbols[i] << 32) | symbols[j])) is not None:
            heapq.heappush(waiting, (int(level[made]), i, symbols[i], symbols[j], made))

    for i in range(n - 1):
        offer(i, i + 1)
    while waiting:
        _, i, a, b, made = heapq.heappop(waiting)
        j = after[i]
        if symbols[i] != a or j < 0 or symbols[j] != b:
            continue
        symbols[i], symbols[j], after[i] = made, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [s for s in symbols if s >= 0]


def merge(symbols: np.ndarray, lengths: np.ndarray, model: dict, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that are left of each word, flat, and their numbers. Words have a symbol at least."""
    names = np.arange(len(lengths))
    finished: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their lengths, their symbols
    level, calm = model["level"], model["calm"]
    word = np.repeat(names, lengths)  # positions in ``names``, which shrinks
    made = np.full(len(symbols), -1, np.int64)
    inner = np.flatnonzero(word[1:] == word[:-1])
    made[inner] = look_up(symbols[inner], symbols[inner + 1], model)
    rank = np.where(made >= 0, level[made], NEVER)
    for turn in range(rounds + 1):
        if not len(symbols):
            break
        low = np.minimum.reduceat(rank, heads_of(lengths))
        live = low < NEVER
        if not live.all():  # compaction: finished words go
            stay = live[word]
            finished.append((names[~live], lengths[~live], symbols[~stay]))
            symbols, made, rank = symbols[stay], made[stay], rank[stay]
            names, lengths, low = names[live], lengths[live], low[live]
            word = np.repeat(np.arange(len(names)), lengths)
            if not len(names):
                break
        if turn == rounds:
            for name, own in zip(names.tolist(), np.split(symbols, heads_of(lengths)[1:]), strict=True):
                own = np.array(by_heap(own.tolist(), model), np.int64)
                finished.append((np.array([name]), np.array([len(own)]), own))
            break
        at = np.flatnonzero(rank == low[word])
        fresh = np.append(True, at[1:] != at[:-1] + 1)
        run = np.flatnonzero(fresh)
        at = at[(at - np.repeat(at[run], np.diff(np.append(run, len(at))))) % 2 == 0]  # leftmost of overlapping places
        first = np.append(True, word[at[1:]] != word[at[:-1]])
        wild = np.zeros(len(names), bool)
        wild[word[at[~calm[made[at]]]]] = True
        at = at[first | ~wild[word[at]]]
        symbols[at] = made[at]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        lengths = lengths - np.bincount(word[at], minlength=len(names))
        moved = np.cumsum(stay) - 1
        symbols, made, rank, word, at = symbols[stay], made[stay], rank[stay], word[stay], moved[at]
        near = np.zeros(len(symbols), bool)
        near[at] = True
        near[at[at > 0] - 1] = True
        changed = np.flatnonzero(near)
        made[changed] = -1
        changed_in = changed[changed + 1 < len(word)]
        changed_in = changed_in[word[changed_in] == word[changed_in + 1]]
        made[changed_in] = look_up(symbols[changed_in], symbols[changed_in + 1], model)
        rank[changed] = np.where(made[changed] >= 0, level[made[changed]], NEVER)
    if not finished:
        return symbols, lengths
    names, lengths, symbols = (np.concatenate(c) for c in zip(*finished, strict=True))
    order = np.argsort(names)
    return gather(symbols, heads_of(lengths)[order], lengths[order]), lengths[order]


def spelled(symbols: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each symbol, flat, and their numbers: itself, or the bytes of a character without a piece."""
    code = symbols - FOREIGN
    number = np.where(code < 0, 1, 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000))
    out = np.repeat(symbols, number)
    for n in range(1, 5):
        own = np.flatnonzero((code >= 0) & (number == n))
        if len(own):
            head = heads_of(number)[own]
            out[head] = model["bytes"][code[own] if n == 1 else ((0xF00 >> n) & 0xFF) | (code[own] >> (6 * (n - 1)))]
            for k in range(1, n):
                out[head + k] = model["bytes"][0x80 | ((code[own] >> (6 * (n - 1 - k))) & 0x3F)]
    return out, number


def encode_words(words: list[str], model: dict, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each word (not empty), flat, and their numbers."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    at = np.minimum(np.searchsorted(model["letters"], codes), len(model["letters"]) - 1)
    symbols = np.where(model["letters"][at] == codes, model["letter_ids"][at], FOREIGN + codes)
    # parts of words: cut where no piece holds the two characters that meet
    head = np.zeros(len(codes), bool)
    head[heads_of(sizes)] = True
    meet = (codes[:-1] << 32) | codes[1:]
    at = np.minimum(np.searchsorted(model["meet"], meet), len(model["meet"]) - 1)
    head[1:] |= model["meet"][at] != meet
    parts = np.diff(np.append(np.flatnonzero(head), len(codes)))
    whole = np.repeat(np.arange(len(words)), sizes)[head]
    symbols, left = merge(symbols, parts, model, rounds)
    ids, number = spelled(symbols, model)
    return ids, np.bincount(np.repeat(np.repeat(whole, left), number), minlength=len(words))


def encode_texts(texts: list[str | None], model: dict, start: bool = False, end: bool = True, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, flat, and their numbers."""
    found, counts = [], []
    cut = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if not model["inside"] else "(?s:.+)")
    for text in texts:
        own = cut.findall((BLANK if model["prefix"] else "") + text.replace(" ", BLANK)) if text else []
        found += own
        counts.append(len(own))
    number = np.array(counts, np.int64)
    distinct: dict[str, int] = {}
    codes = np.array([distinct.setdefault(w, len(distinct)) for w in found], np.int64)
    ids, length = encode_words(list(distinct), model, rounds) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
    # the start and the end are two more words
    ids, length = np.concatenate([ids, [model["start"], model["end"]]]), np.concatenate([length, [1, 1]])
    last = np.cumsum(number)
    where = np.concatenate([last - number if start else [], last if end else []]).astype(np.int64)
    what = np.concatenate([np.full(len(texts) * start, len(distinct)), np.full(len(texts) * end, len(distinct) + 1)]).astype(np.int64)
    text_of = np.concatenate([np.repeat(np.arange(len(texts)), number), *[np.arange(len(texts))] * (start + end)])
    order = np.argsort(np.concatenate([np.arange(len(codes)) + 0.5, where - (0.25 * (what == len(distinct)))]) + text_of, kind="stable")
    words = np.concatenate([codes, what])[order]
    return gather(ids, heads_of(length)[words], length[words]), np.bincount(text_of, np.concatenate([length[codes], length[what]]), len(texts)).astype(np.int64)


def read_bytes(run: bytes) -> str:
    """UTF-8 with a U+FFFD for each byte that belongs to no character."""
    out = []
    while run:
        try:
            out.append(run.decode())
            break
        except UnicodeDecodeError as bad:
            out.append(run[: bad.start].decode() + "�")
            run = run[bad.start + 1 :]
    return "".join(out)


def decode_ids(ids: np.ndarray, number: np.ndarray, model: dict) -> list[str]:
    """The texts of flat ids."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(model["widths"])):
        raise ValueError("ids beyond the vocabulary")
    text_of = np.repeat(np.arange(len(number)), number)
    width = model["widths"][ids]
    flat = gather(model["surface"], heads_of(model["widths"])[ids], width)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text_of, width, len(number)).astype(np.int64))])
    strip = np.zeros(len(number), bool)
    if model["prefix"]:
        loud = np.flatnonzero(model["kinds"][ids] != CONTROL)
        head = loud[np.append(True, text_of[loud[1:]] != text_of[loud[:-1]])] if len(loud) else loud
        strip[text_of[head]] = model["opens"][ids[head]]
    raw, out = flat.tobytes(), []
    heads = heads_of(number)
    for t, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        lo += int(strip[t])
        try:
            out.append(raw[lo:hi].decode())
        except UnicodeDecodeError:
            own = ids[heads[t] : heads[t] + number[t]]
            wide, is_byte = model["widths"][own], model["kinds"][own] == BYTE
            turns = np.flatnonzero(np.append(True, is_byte[1:] != is_byte[:-1]))
            ends = np.cumsum(wide)[np.append(turns[1:], len(own)) - 1].tolist()
            whole, text = raw[bounds[t] : hi], []
            for a, b, k in zip([0, *ends[:-1]], ends, turns.tolist(), strict=True):
                text.append(read_bytes(whole[a:b]) if is_byte[k] else whole[a:b].decode())
            out.append("".join(text)[int(strip[t]) :])
    return out


def columns_with(df: DataFrame, drop: str, name: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    """The columns that pass through, and the schema with ours behind them."""
    kept = [c for c in df.columns if c not in (drop, name)]
    return kept, T.StructType([*[df.schema[c] for c in kept], T.StructField(name, kind)])


def with_column(batch: pa.RecordBatch, kept: list[str], name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], values], names=[*kept, name])


def encode(docs: DataFrame, model: dict, text: str = "text", out: str = "ids", start: bool = False, end: bool = True, back: str | None = None) -> DataFrame:
    """The other columns of ``docs``, and the ids of each whole text; with ``back``, also the text that these ids decode to, in the same pass."""
    kept, schema = columns_with(docs, text, out, T.ArrayType(T.IntegerType()))
    if back is not None:
        kept = [c for c in kept if c != back]
        schema = T.StructType([*[docs.schema[c] for c in kept], schema[out], T.StructField(back, T.StringType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text, STEP_BYTES):
            texts = [None if x is None else x.decode("utf-8", "replace") for x in batch.column(text).cast(pa.binary()).to_pylist()]
            ids, number = encode_texts(texts, sent.value, start, end)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(number)), pa.int32()), pa.array(ids, pa.int32()))
            done = with_column(batch, kept, out, lists)
            yield done if back is None else with_column(done, [*kept, out], back, pa.array(decode_ids(ids, number, sent.value), pa.string()))

    return docs.select(*kept, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: dict, ids: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with the text of each list of ids."""
    kept, schema = columns_with(encoded, out, out, T.StringType())
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            step = (np.cumsum(number) - 1) // STEP_IDS  # slices of about so many ids
            edges = [0, *(np.flatnonzero(np.diff(step) != 0) + 1).tolist(), len(number)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                flat = part.column(ids).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield with_column(part, kept, out, pa.array(decode_ids(flat, number[lo:hi], sent.value), pa.string()))

    return encoded.select(*kept).mapInArrow(run, schema)


def op11_sentence_pieces(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    model = load(vocabulary)
    both = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, back="decoded")
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
