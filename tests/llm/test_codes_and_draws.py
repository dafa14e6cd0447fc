"""Sentence pieces against the library, importance resampling and vector codes against brute force; nulls, empty and long input, ties, repeats, extra columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from oracle import connect, same

from tastemill.llm import catalogue, importance, sentence_pieces, vector_codes


@pytest.mark.parametrize("name", ["op12_importance_resampling", "op13_vector_codes"])
def test_sql(spark, sf, name):
    same(catalogue.QUERIES[name](spark, sf), connect(sf), catalogue.ORACLES[name])


# ---- 11


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(sentence_pieces.VOCABULARY)
    return sentence_pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)


def compare(texts, pieces, rounds=sentence_pieces.ROUNDS):
    model, library = pieces
    ids, number = sentence_pieces.encode_texts(texts, model, rounds=rounds)
    wanted = [library.encode(t or "", add_eos=True) for t in texts]
    assert [a.tolist() for a in np.split(ids, np.cumsum(number)[:-1])] == wanted
    assert sentence_pieces.decode_ids(ids, number, model) == [library.decode(w) for w in wanted]


HOSTILE = ["", None, " ", "  ", "a", "▁", "a ▁▁ b", "\x00\n\t", "a\x00b", "a\x00c", " " * 100, "aaaa" * 30, "😀é́ x", "</s> <s> <unk> <0x0A>", "-" * 1000, " the  thing   ", " " * 3000 + "x", "﻿​漢字かな", "x" * 20_000, "thethe" * 500]


@pytest.mark.parametrize("rounds", [0, 1, 3, sentence_pieces.ROUNDS])
def test_pieces_hostile(pieces, rounds):
    compare(HOSTILE, pieces, rounds)


def test_pieces_random(pieces):
    draw = random.Random(5)
    letters = list("abcdefgthein ▁  \n\t\x00éü漢字ですใ😀.,-_=()0123456789")
    known = [pieces[1].id_to_piece(i) for i in range(259, 32000)]
    compare(["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(3000)], pieces)
    compare(["".join(draw.choice(known).replace("▁", draw.choice([" ", "", "▁"])) for _ in range(draw.randrange(1, 30))) for _ in range(3000)], pieces)


def test_pieces_decode_any_ids(pieces):
    draw = np.random.RandomState(2)
    for _ in range(1500):
        ids = np.where(draw.rand(12) < 0.5, draw.randint(0, 260, 12), draw.randint(259, 32000, 12))
        assert sentence_pieces.decode_ids(ids, np.array([12]), pieces[0])[0] == pieces[1].decode(ids.tolist())
    with pytest.raises(ValueError):
        sentence_pieces.decode_ids(np.array([32000]), np.array([1]), pieces[0])


def test_pieces_query(spark, sf, pieces):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentence_pieces.op11_sentence_pieces(spark, sf).collect()}
    assert len(got) == len(rows)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows:
        ids = pieces[1].encode(r.text or "", add_eos=True)
        assert got[r.doc_id] == (len(ids), sha(" ".join(map(str, ids))), sha(pieces[1].decode(ids)))


def test_pieces_columns(spark, pieces):
    rows = [(1, "the thing", "x", 5), (1, "the thing", "x", 5), (None, None, None, None), (2, "", "y", 1), (3, "word " * 40_000, "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n long")
    out = sentence_pieces.encode(df, pieces[0], start=True)
    assert out.columns == ["doc_id", "n", "ids"]
    got = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert got[0].ids == got[1].ids == pieces[1].encode("the thing", add_bos=True, add_eos=True)
    assert got[4].ids == got[2].ids == [1, 2]
    back = {r.n: r.text for r in sentence_pieces.decode(out, pieces[0]).collect()}
    assert back == {5: "the thing", None: "", 1: "", 2: "word " * 40_000}
    at_once = sentence_pieces.encode(df, pieces[0], start=True, back="n")
    assert at_once.columns == ["doc_id", "ids", "n"] and {r.n for r in at_once.collect()} == {"the thing", "", "word " * 40_000}
    lists = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text for r in sentence_pieces.decode(lists, pieces[0]).collect()] == ["", ""]
    assert sentence_pieces.encode(df.limit(0), pieces[0]).count() == 0


# ---- 12


def brute_draw(docs, target, orders, buckets, percent, least, seed):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    grams = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, orders + 1) for i in range(len(w) - k + 1)]
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in grams(split(text)):
            s[b] += 1
    for text in target:
        for b in grams(split(text)):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        g = [gain[b] for b in grams(split(text))]
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(g) // len(g) if g else 0
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(split(text)) >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_importance(spark, orders):
    draw = random.Random(orders)
    word = lambda: draw.choice(["Alpha", "beta", "Ünder", "ünder", "漢字", "x1", "GAMMA", "delta9"])
    docs = [(i, "".join(word() + draw.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(draw.randrange(40)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "... --"), (203, "word " * 30_000), (204, "one")]
    docs += [(205, "Alpha beta " * 20)] * 7 + [(None, "Alpha beta " * 12)] * 5 + [(None, None)] * 3
    target = ["alpha beta ünder", None, "x1 " * 9, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for name in ("_id", "_pos", "score", "bucket", "rank"):
        df = df.selectExpr("*", f"'x' AS {name}")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resample(df, wanted, orders=orders, buckets=64, percent=30, min_words=5, seed="s")
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_draw(docs, target, orders, 64, 30, 5, "s")
    assert importance.resample(df.limit(0), wanted).count() == 0
    assert importance.resample(df, wanted.limit(0), buckets=64).count() == len(docs)


def test_importance_ties(spark):
    """Equal texts differ by noise alone, and equal scores are drawn by id."""
    df = spark.createDataFrame([(i, "a b c d e f") for i in range(3000)], "doc_id long, text string")
    rows = importance.resample(df, df.limit(3), min_words=1).collect()
    order = sorted(rows, key=lambda r: (-r.score, r.doc_id))
    assert [r.rank for r in order] == [k + 1 if k < 300 else None for k in range(3000)]
    assert len({r.score for r in rows}) < len(rows)


# ---- 13


def brute_codes(rows, parts, entries, rounds, scale):
    """rows: (id, vector) that take part, vectors of floats."""
    whole = [[math.floor(scale * x) for x in v] for _, v in rows]
    spans = vector_codes.edges_of(len(whole[0]), parts)
    first = sorted((i, w) for (i, _), w in zip(rows, whole) if i is not None)[:entries]
    books = [[list(w[a:b]) for _, w in first] for a, b in spans]
    far = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for k, (a, b) in enumerate(spans):
            own = {}
            for w in whole:
                own.setdefault(near(w[a:b], books[k]), []).append(w[a:b])
            for e, members in own.items():
                books[k][e] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for (i, _), w in zip(rows, whole):
        codes = [near(w[a:b], books[k]) for k, (a, b) in enumerate(spans)]
        out.append((i, "".join(f"{c:02x}" for c in codes), sum(far(w[a:b], books[k][c]) for k, ((a, b), c) in enumerate(zip(spans, codes)))))
    return sorted(out, key=repr), books


@pytest.mark.parametrize(("dims", "entries", "kind"), [(8, 6, "blobs"), (10, 5, "ties"), (3, 4, "copies"), (4, 64, "few")])
def test_vector_codes(spark, dims, entries, kind):
    draw = random.Random(dims)
    n = 9 if kind == "few" else 400
    centre = [[draw.uniform(-4, 4) for _ in range(dims)] for _ in range(5)]
    make = {
        "blobs": lambda i: [c + draw.gauss(0, 0.2) for c in centre[i % 5]],
        "ties": lambda i: [float(draw.randrange(-2, 3)) / 4 for _ in range(dims)],
        "copies": lambda i: centre[0] if i % 3 else [draw.uniform(-9, 9) for _ in range(dims)],
        "few": lambda i: [draw.uniform(-1, 1) for _ in range(dims)],
    }[kind]
    rows = [(i, make(i)) for i in range(n)] + [(None, make(1)), (7, make(2)), (7, make(2))]
    bad = [(1000, None), (1001, []), (1002, [float("nan")] * dims), (1003, [float("inf")] * dims), (1004, [None] * dims), (1005, [1.0] * (dims + 1))]
    df = spark.createDataFrame([(i, v, None if (i or 1) % 3 == 0 else (i or 1) % 3, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, label int, v string")
    coded, books = vector_codes.compress(df.repartition(3), parts=4, entries=entries, rounds=3, scale=8)
    wanted, wanted_books = brute_codes(rows, 4, entries, 3, 8)
    assert [b.tolist() for b in books] == wanted_books
    assert sorted(((r.vec_id, r.code, r.error) for r in coded.collect()), key=repr) == wanted
    total = {}
    for r in vector_codes.with_label_error(coded).collect():
        total.setdefault((r.label, r.label_error), []).append(r.error)
    assert len(total) == len({k[0] for k in total}) and all(sum(v) == k[1] for k, v in total.items())


def test_vector_codes_blocks(spark, monkeypatch):
    """Small blocks, leaves and steps give the same as one tree."""
    draw = np.random.RandomState(4)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(draw.randn(900, 8).round(2))], "vec_id long, embedding array<double>, label int").repartition(2)
    one, books = vector_codes.compress(df, parts=4, entries=20)
    wanted = sorted(one.collect())
    monkeypatch.setattr(vector_codes, "BLOCK", 800)
    again, more = vector_codes.compress(df, parts=4, entries=20)
    assert sorted(again.collect()) == wanted and all((a == b).all() for a, b in zip(books, more))
    points = draw.randint(-50, 50, (3000, 3))
    book = draw.randint(-50, 50, (30, 3))
    tree = vector_codes.grow(points)
    for slab in (1, vector_codes.SLAB):
        monkeypatch.setattr(vector_codes, "SLAB", slab)
        sums, counts, code = vector_codes.walk(points, tree, book)
        own = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
        assert (own[tree["order"]] == code).all() and (counts == np.bincount(own, minlength=30)).all()
        assert all((sums[e] == points[own == e].sum(0)).all() for e in range(30))


def test_vector_codes_empty_and_huge(spark):
    kind = "vec_id long, embedding array<double>, label int"
    out, books = vector_codes.compress(spark.createDataFrame([], kind))
    assert out.count() == 0 and books == []
    assert vector_codes.compress(spark.createDataFrame([(None, [1.0], 1)], kind))[0].count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0], 1), (2, [-1e300, 5.0], 1)], kind)
    assert [r.code for r in sorted(vector_codes.compress(huge)[0].collect())] == ["0000", "0101"]


# ---- what earlier operators must not lose


def brute_leaks(texts, items, limit=0.8):
    from collections import Counter

    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    out = set()
    for n, t in texts:
        w = t.lower().split()
        for i, x in items:
            it = x.split()
            b = bag(it)
            for s in range(max(1, len(w) - len(it) + 1)):
                a = bag(w[s : s + len(it)])
                if sum((a & b).values()) >= limit * sum((a | b).values()) - 1e-12:
                    out.add((n, i))
                    break
    return out


def test_decontaminate_moved_blocks(spark):
    """Swapped halves, moved and repeated paragraphs, and words that repeat: all windows count, not the aligned ones alone."""
    from tastemill.llm import decontaminate

    draw = random.Random(9)
    word = lambda n, v=5000: [f"w{draw.randrange(v)}" for _ in range(n)]
    items = [(1, word(100)), (2, word(90)), (3, word(150)), (4, ["la"] * 30), (5, (["da", "du", "di"] * 20)[:50])]
    a, b, c = items[0][1], items[1][1], items[2][1]
    thirds = [c[k : k + 50] for k in (0, 50, 100)]
    texts = [(1, word(40) + a[50:] + a[:50] + word(40)), (2, word(60) + b[30:] + b[:30]), (3, thirds[2] + thirds[0] + thirds[1]), (4, word(10) + ["la"] * 400), (5, ["du", "di", "da"] * 60), (6, word(300)), (7, a[50:] + word(9) + a[:50]), (8, a[20:40] * 5), (9, thirds[0] + word(30) + thirds[1])]
    texts, items = [(i, " ".join(w)) for i, w in texts], [(i, " ".join(w)) for i, w in items]
    wanted = brute_leaks(texts, items)
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)} <= wanted
    df = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    found = decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == wanted
    long = spark.createDataFrame([(1, "la " * 200_000)], "doc_id long, text string")
    assert [r.item_id for r in decontaminate.find_leaks(long, spark.createDataFrame(items, "item_id long, text string")).collect()] == [4]


def test_license_expression_of_any_length(spark):
    from tastemill.llm import license_scan

    names = [f"LicenseRef-part-{n}" for n in range(400)]
    tagged = "// SPDX-License-Identifier: " + " AND ".join([*names, "GPL-3.0-only"]) + "\nrest"
    many = "SPDX-License-Identifier: MIT " * 2000 + "SPDX-License-Identifier: (ISC OR Zlib)"
    df = spark.createDataFrame([(1, tagged), (2, many)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert len(tagged) > 8000 and set(got[1].labels.split(",")) == {n.lower() for n in names} | {"gpl"} and not got[1].permissive
    assert set(got[2].labels.split(",")) == {"mit", "isc", "zlib"} and got[2].permissive


@pytest.mark.parametrize("tag", ["button", "select", "canvas", "svg", "video", "audio", "template", "object", "math", "noscript"])
def test_html_unclosed_element_loses_nothing_behind(spark, tag):
    from tastemill.llm import html_extract

    html = f"<html><body><article><p>First paragraph of the text.</p><{tag}><p>Second paragraph of the text.</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://a.example/x", html)], "page_id long, url string, html string")
    assert html_extract.extract(pages).first().text == "First paragraph of the text.\n\nSecond paragraph of the text."
