"""Whitening, product codes and line deduplication against plain versions, and their defined results."""

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import SMALL

from partwise.llm import line_dedup, vector_codes, whitening

VEC = "vec_id long, embedding array<double>, label int, slot int, at int, i int, code string, error long, _vector int, component int, text string"


def vec(key, values, label=0):
    return (key, values, label, *[None] * 8)


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SMALL}/embeddings.parquet")


def plain_x(rows, scale, offset=0):
    return [[math.floor(scale * float(c)) + offset for c in v] for v in rows]


# Whitening.

def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(1)
    for low, high, rows, wide in ((-3, 4, 1, 3), (999_900, 1_000_090, 500, 7), (-2**39, 2**39, 130, 4), (5, 6, 70, 2)):
        x = rng.integers(low, high, (rows, wide))
        sums, product = whitening.cross_products(x)
        big = x.astype(object)
        assert (sums == big.sum(axis=0)).all() and (product == big.T @ big).all()


def test_whitening_equals_a_plain_version(embeddings):
    got = whitening.report(embeddings).collect()
    rows = embeddings.collect()
    x = plain_x([r["embedding"] for r in rows], 64, 1_000_000)
    n, width = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(width)]
    exact = {r["vec_id"]: sum((n * a - b) ** 2 for a, b in zip(v, s)) for r, v in zip(rows, x)}
    off = np.array(x) - np.array(s) / n
    e, u = np.linalg.eigh(off.T @ off / n)
    e, u = e[::-1], u[:, ::-1]
    plain = off @ u[:, :32] / np.sqrt(e[:32])
    w = np.full((n, 32), np.nan)
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    for r in got:
        w[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == exact[r["vec_id"]] and r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-9)
    assert len(got) == 32 * n
    flip = np.sign((w * plain).sum(axis=0))
    assert np.abs(w - plain * flip).max() < 1e-6


def test_whitening_defined_results(spark):
    rows = [vec(1, [1.0, 2.0, 0.5]), vec(2, [2.0, 1.0, 0.5]), vec(2, [2.0, 1.0, 0.5]), vec(3, None), vec(4, [1.0, None, 2.0]), vec(None, [0.0, 0.0]),
            vec(5, [float("nan"), 1.0, 1.0]), vec(6, [float("inf"), 1.0, 1.0]), vec(7, [4.0, 0.25, -1.0])]
    got = whitening.report(spark.createDataFrame(rows, VEC).repartition(3)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((k, c) for k in ("1", "2", "2", "7", "None") for c in (1, 2, 3))
    x = [[64, 128, 32], [128, 64, 32], [128, 64, 32], [0, 0, 0], [256, 16, -64]]
    s = [sum(c) for c in zip(*x)]
    assert {r["vec_id"]: r["deviation"] for r in got} == {
        k: sum((5 * a - b) ** 2 for a, b in zip(v, s)) for k, v in zip((1, 2, 2, None, 7), x)}
    one = whitening.report(spark.createDataFrame([vec(1, [1.0, 2.0])] * 2, VEC)).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in one)
    flat = whitening.report(spark.createDataFrame([vec(1, [1.0, 2.0]), vec(2, [2.0, 2.0])], VEC)).collect()
    assert sorted((r["component"], r["whitened"]) for r in flat if r["component"] == 1) in ([(1, -1.0), (1, 1.0)],)
    assert all(r["whitened"] is None and r["explained"] == 0 for r in flat if r["component"] == 2)
    for none in ([], [vec(1, None)], [vec(1, [])]):
        empty = whitening.report(spark.createDataFrame(none, VEC))
        assert empty.collect() == [] and len(empty.columns) == 7


# Product codes.

def plain_nearest(q, book):
    return min((sum((a - b) ** 2 for a, b in zip(q, c)), i) for i, c in enumerate(book))


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (key, vector, label) in the order of the table's ids."""
    x = plain_x([v for _, v, _ in rows], 256)
    d = len(x[0]) // parts
    cut = [[r[p * d:(p + 1) * d] for r in x] for p in range(parts)]
    books = [c[:entries] for c in cut]
    for _ in range(rounds):
        for p in range(parts):
            near = [plain_nearest(q, books[p])[1] for q in cut[p]]
            books[p] = [[sum(cs) // len(cs) for cs in zip(*[q for q, e in zip(cut[p], near) if e == i])] if i in near else books[p][i]
                        for i in range(len(books[p]))]
    final = [[plain_nearest(cut[p][i], books[p]) for p in range(parts)] for i in range(len(x))]
    errors = [sum(f[0] for f in r) for r in final]
    by_label = {}
    for (_, _, label), e in zip(rows, errors):
        by_label[label] = by_label.get(label, 0) + e
    text = ",".join(str(v) for b in books for c in b for v in c)
    return [(k, "".join(f"{f[1]:02x}" for f in r), e, by_label[label], hashlib.sha256(text.encode()).hexdigest())
            for (k, _, label), r, e in zip(rows, final, errors)]


@pytest.mark.parametrize("spread", [2, 6, 400])
def test_orchard_finds_the_nearest_with_ties(spread):
    rng = np.random.default_rng(spread)
    books = rng.integers(-spread, spread, (3, 64, 4))
    q = rng.integers(-spread, spread, (300, 12))
    entry, error = vector_codes.Orchard(books).nearest(q)
    for i in range(300):
        for p in range(3):
            assert plain_nearest(q[i, 4 * p:4 * p + 4].tolist(), books[p].tolist()) == (error[i, p], entry[i, p])


def test_orchard_skips_entries():
    """The search measures few entries of a well spread codebook."""
    books = np.stack([np.array([[i * 100, j * 100] for i in range(8) for j in range(8)])])
    search = vector_codes.Orchard(books)
    q = books[0] + 3
    entry, _ = search.nearest(q)
    assert (entry[:, 0] == np.arange(64)).all()
    assert (search.gaps[0][:, 1] == 10_000).all() and 10_000 > 4 * 18


def test_codes_equal_a_plain_version(embeddings):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in embeddings.orderBy("vec_id").collect()]
    got = [tuple(r) for r in vector_codes.compress(embeddings).orderBy("vec_id").collect()]
    assert got == plain_codes(rows)


def test_codes_defined_results(spark):
    rng = random.Random(5)
    rows = [vec(i, [rng.uniform(-2, 2) for _ in range(32)], i % 3 or None) for i in range(100)]
    rows += [vec(5, rows[5][1], rows[5][2]), vec(200, None), vec(201, [None] * 32), vec(202, [float("nan")] * 32), vec(203, [-float("inf")] * 32)]
    frame = spark.createDataFrame(rows, VEC).repartition(4)
    usable = sorted([(r[0], r[1], r[2]) for r in rows if r[0] < 200], key=lambda r: r[:2])
    assert sorted(tuple(r) for r in vector_codes.compress(frame).collect()) == sorted(plain_codes(usable))
    few = vector_codes.compress(spark.createDataFrame([vec(2, [1.0] * 20), vec(None, [2.0] * 5), vec(2, [1.0] * 20)], VEC)).collect()
    assert sorted((str(r["vec_id"]), r["code"][:2], r["error"]) for r in few) == [("2", "00", 0), ("2", "00", 0), ("None", "02", 0)]
    assert vector_codes.compress(spark.createDataFrame([], VEC)).collect() == []
    assert [r["error"] for r in vector_codes.compress(spark.createDataFrame([vec(1, [])], VEC)).collect()] == [0]


# Lines.

def plain_line_dedup(rows, least=10):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    order = lambda i: (i is None, i or 0)
    home, holders = {}, {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= least:
                holders.setdefault(k, set()).add(i)
    for k, ids in holders.items():
        if len(ids) > 1:
            home[k] = min(ids, key=order)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in home or home[key(x)] == i]
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


LINES = [
    (1, "Shared line one\nown text of one\nSHARED line one \n"), (2, "\tshared LINE one\nshared line one\nshort\nshort"), (3, None), (4, ""),
    (5, "short\nÄpfel und Birnen\nshared line one"), (6, "äpfel und birnen\nÄPFEL und Birnen"), (None, "shared line one\nonly without id"),
    (None, "only without id\nonly without id\ntenlettersx\nninelette"), (7, "tenlettersx\nninelette\n\r\x0b"), (8, "\n" * 50_000 + "tenlettersx"),
    (9, "漢字漢字漢字漢字漢\n漢字漢字漢字漢字漢字"), (10, "漢字漢字漢字漢字漢\n漢字漢字漢字漢字漢字"), (2, "\tshared LINE one\nshared line one\nshort\nshort"),
    (11, "x" * 300_000 + "\nown text of one"), (12, "same id a\nline of twelve"), (12, "line of twelve\nanother text"), (13, "line of twelve"),
]
LINE_SCHEMA = "doc_id long, text string, id long, tag string, key string, at int, lost int, home long, n long, once string, _row int, _part int"


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(*r, *[None] * 10) for r in LINES], LINE_SCHEMA).repartition(5)


@pytest.mark.parametrize("filter_bytes", [1 << 26, 1 << 13])
def test_lines_equal_a_plain_version(spark, lines, filter_bytes):
    got = sorted((str(a), b, c, d) for a, b, c, d in line_dedup.digests(lines, filter_bytes=filter_bytes).collect())
    assert got == plain_line_dedup(LINES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(7)
    want = plain_line_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((str(a), b, c, d) for a, b, c, d in line_dedup.digests(docs, filter_bytes=filter_bytes).collect()) == want


def test_texts_of_lines(lines, spark):
    got = line_dedup.dedup(lines)
    assert got.columns == lines.columns and got.schema["id"].dataType == lines.schema["id"].dataType
    texts = {}
    for r in got.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert texts[1] == ["Shared line one\nown text of one\nSHARED line one \n"] and texts[2] == ["short\nshort"] * 2
    assert texts[5] == ["short\nÄpfel und Birnen"] and texts[3] == [""] and texts[13] == [""]
    assert sorted(texts[12]) == ["line of twelve\nanother text", "same id a\nline of twelve"]
    assert texts[10] == ["漢字漢字漢字漢字漢"]
    none = spark.createDataFrame([], LINE_SCHEMA)
    assert line_dedup.digests(none).collect() == [] == line_dedup.dedup(none).collect()


def test_a_line_in_most_documents(spark):
    rows = [(i, f"the common line of all\nown line number {i}") for i in range(3000)]
    got = line_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()
    assert sorted((r["doc_id"], r["n_dropped"]) for r in got) == [(i, int(i > 0)) for i in range(3000)]


def test_twice_filter_has_no_false_negatives(spark):
    rng = random.Random(3)
    words = [f"line number {rng.randrange(4000)} of many" for _ in range(6000)]
    frame = spark.createDataFrame([("\n".join(words[i:i + 3]),) for i in range(0, 6000, 3)], "text string").repartition(6)
    shape = line_dedup.Shape(6000, 1 << 26)
    bits = line_dedup.seen_twice(frame, shape, 10)
    seen, twice = set(), set()
    for i in range(0, 6000, 3):
        for w in set(words[i:i + 3]):
            (twice if w in seen else seen).add(w)
    held = {w for w in set(words) if line_dedup.holds(bits, shape.spots(line_dedup._hashes([w.encode()])))[0]}
    assert twice <= held and len(held - twice) < 0.1 * len(set(words))
