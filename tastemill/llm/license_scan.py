"""License scans: Aho-Corasick for tags and notice phrases, a shunting-yard parser for licence expressions.

One automaton holds all phrases as runs of whole words and reads each whole
text once. Where it meets an identifier tag, the expression behind the tag is
parsed by precedence (with, and, or) and evaluated: its identifiers become
labels, and ``permissive`` says if the expression can be met by permissive
licences alone (or: any side, and: all sides). A name counts as an identifier if it
starts with a known licence family, or has a version behind a hyphen; other words
end the expression. Of notices that lie in one another the longest counts. Places
are counted along the text, so the time is linear in its length.

Defined results
* null text: empty, so no words, no places, empty labels, score 0;
* an expression that breaks off is taken as far as it is well formed; marks behind
  an identifier (a full stop, a hyphen) are not part of it;
* of a text with several tags, all expressions must be permissive;
* texts of any length are read whole, one at a time beyond the step's size; so are expressions, to the end of their line;
* repeated rows give repeated results, an empty table an empty one; further
  columns of the table are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, column, table

#: The phrases of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices that this operator adds, as words in lower case.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "2 clause bsd license": "bsd-2-clause",
    "3 clause bsd license": "bsd-3-clause",
    "isc license": "isc",
    "boost software license": "bsl-1.0",
    "under cc by": "cc-by",
    "under cc by sa": "cc-by-sa",
    "under cc by nc": "cc-by-nc",
    "under cc by nd": "cc-by-nd",
    "under cc by nc sa": "cc-by-nc-sa",
    "under cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
PERMISSIVE = ("mit", "apache", "bsd", "isc", "0bsd", "bsl", "zlib", "unlicense", "cc0", "cc-by-4", "cc-by-3", "python", "postgresql", "x11")
#: Bytes of the words of the contract: all but ASCII controls, blanks and marks; A-Z become a-z.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: What an identifier of a licence looks like: a known family, or a name with a version; or one that the text defines itself.
IDENTIFIER = re.compile(
    r"(?:mit|apache|a?gpl|lgpl|bsd|0bsd|isc|mpl|epl|cddl|cc0|cc|bsl|zlib|unlicense|wtfpl|artistic|postgresql|x11|ncsa|ofl|openssl|osl|eupl|afl|ms-pl|ms-rl|json|vim|w3c|libpng|curl|icu)(?:[-+.][a-z0-9.+-]*)?|"
    r"[a-z][a-z0-9.+]*(?:-[a-z0-9.+]+)*-\d[a-z0-9.+-]*|licenseref-[a-z0-9.-]+|documentref-[a-z0-9.-]+:licenseref-[a-z0-9.-]+"
)
#: Exceptions, which stand behind "with".
EXCEPTION = re.compile(r"[a-z0-9.+-]*exception[a-z0-9.+-]*|[a-z0-9.+]+(?:-[a-z0-9.+]+)+")
PIECE = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+-]+(?::[A-Za-z0-9.+-]+)?)")
RANK = {"or": 1, "and": 2, "with": 3}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in BASE:
        found.add_word(f" {phrase} ", ("base", phrase, len(phrase) + 2))
    for phrase in NOTICES:
        found.add_word(f" {phrase} ", ("notice", phrase, len(phrase) + 2))
    found.add_word(f" {TAG} ", ("tag", "", len(TAG) + 2))
    found.make_automaton()
    return found


def pieces(text: str, strict: bool = False) -> list[str]:
    """The longest well-formed start of a licence expression; ``strict``: names must look like identifiers."""
    out, depth, best, name_next, at = [], 0, 0, True, 0
    while (m := PIECE.match(text, at)) is not None:
        piece, at = m[1], m.end()
        if piece == "(":
            if not name_next or (out and out[-1].lower() == "with"):
                break
            depth += 1
        elif piece == ")":
            if name_next or not depth:
                break
            depth -= 1
        elif piece.lower() in RANK:
            if name_next or (piece.lower() == "with" and out[-1] == ")"):
                break
            name_next = True
        else:
            piece = piece.rstrip(".-:")
            wanted = EXCEPTION if out and out[-1].lower() == "with" else IDENTIFIER
            if not name_next or not piece or (strict and not wanted.fullmatch(piece.lower())):
                break
            name_next = False
        out.append(piece)
        if not name_next and not depth:
            best = len(out)
    return out[:best]


def evaluate(text: str, strict: bool = False) -> tuple[frozenset[str], bool] | None:
    """(identifiers, permissive) of the expression at the start of ``text``, by shunting-yard; None if there is none."""
    values: list[tuple[frozenset[str], bool]] = []
    waiting: list[str] = []

    def apply(op: str) -> None:
        right, left = values.pop(), values.pop()
        if op == "with":  # an exception grants more, so it never takes permission away
            values.append((left[0] | {f"{min(left[0])}-with-{min(right[0])}"}, left[1]))
        else:
            values.append((left[0] | right[0], (left[1] or right[1]) if op == "or" else (left[1] and right[1])))

    for piece in pieces(text, strict):
        low = piece.lower()
        if piece == "(":
            waiting.append(piece)
        elif piece == ")":
            while waiting[-1] != "(":
                apply(waiting.pop())
            waiting.pop()
        elif low in RANK:
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[low]:
                apply(waiting.pop())
            waiting.append(low)
        else:
            values.append((frozenset([low]), low.startswith(PERMISSIVE)))
    while waiting:
        apply(waiting.pop())
    return values[0] if values else None


def family(identifier: str) -> str:
    """mit, apache and gpl as in the base labels; other identifiers stand for themselves."""
    for name in ("mit", "apache", "gpl"):
        if identifier == name or (identifier.startswith(name + "-") and "-with-" not in identifier):
            return name
    return identifier


def behind(raw: bytes, normal: bytes, words: list[int]) -> list[str]:
    """What follows each of the words with these numbers (rising) on its line, without marks before it.

    It ends with the second tag behind at the latest: no expression goes on behind one, so a long line of many tags is read twice, not once for each.
    """
    ends, wanted = [], iter(words)
    want = next(wanted, None)
    for n, m in enumerate(re.finditer(rb"[^ ]+", normal)):
        if n == want:
            ends.append(m.end())
            if (want := next(wanted, None)) is None:
                break
    out = []
    for k, start in enumerate(ends):
        stop = raw.find(b"\n", start)
        stop = min(len(raw) if stop < 0 else stop, ends[k + 2] if k + 2 < len(ends) else len(raw))
        out.append(raw[start:stop].decode("utf-8", "replace").lstrip(" \t:=\"'`*"))
    return out


def scan(raw: bytes, machine) -> tuple:
    plain = raw.translate(NORMAL)
    normal = plain.split()
    text = (b" " + b" ".join(normal) + b" ").decode("latin-1")  # one character for each byte
    starts, base, labels, tags, free = [], set(), set(), [], None
    notices: list[tuple[int, int, str]] = []
    blanks, seen = 0, 0  # blanks before ``seen``; ends of matches never fall, so the text is counted through once
    for end, (kind, label, length) in machine.iter(text):
        blanks += text.count(" ", seen, end + 1)
        seen = end + 1
        if kind == "base":
            starts.append(blanks - label.count(" ") - 2)
            base.add(BASE[label])
        elif kind == "notice":
            while notices and notices[-1][0] >= end - length:  # it lies in this one
                notices.pop()
            if not notices or notices[-1][1] < end:
                notices.append((end - length, end, label))
        else:
            tags.append(blanks - 2)  # the last word of the tag
    labels |= {NOTICES[label] for _, _, label in notices}
    for line in behind(raw, plain, tags) if tags else ():
        if (found := evaluate(line, strict=True)) is not None:
            labels |= {family(x) for x in found[0]}
            free = found[1] if free is None else free and found[1]
    # each notice halves the doubt that is left, each tag takes three quarters of it
    score = 1.0 - 0.5 ** min(60, len(starts) + len(notices) + 2 * len(tags))
    return len(normal), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score, free


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def scan_licenses(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in chunks(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            rows = [scan(x or b"", machine) for x in texts]
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive"]
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "doc_id"), pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
