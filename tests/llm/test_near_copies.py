"""Near copies against all pairs by exact Jaccard similarity."""

import random

from conftest import SMALL

import corpus_pipeline
from partwise.llm import near_copies


def plain_first(texts, share=0.8):
    """Keys that are the least of their group."""
    sets = {}
    for k, t in texts.items():
        w = t.lower().split()
        sets[k] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    top = {k: k for k in texts}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {k for k in keys if root(k) == k}


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return words


def test_keeps_first_of_all_similar_pairs(spark):
    """Copies on both sides of 0.8, chains of copies of copies, and one large group."""
    rng = random.Random(5)
    texts, key = {}, 0
    for _ in range(40):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(50, 300))]
        for _ in range(6):
            texts[key] = " ".join(words)
            key += 1
            words = edited(rng, words, max(1, len(words) * rng.randint(1, 5) // 100))
    base = [f"b{i}" for i in range(200)]
    for _ in range(80):
        texts[key] = " ".join(edited(rng, base, 2))
        key += 1
    frame = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    want = plain_first(texts)
    assert 40 < len(want) < key - 100
    assert {r["doc_id"] for r in near_copies.keep_first(frame).collect()} == want


def test_stage_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect())
    assert got == sorted(plain_first({r["doc_id"]: r["text"] or "" for r in docs.collect()}))


def test_linked_fingerprints_propose_pairs(spark, monkeypatch):
    """Without a band in common, near copies meet in the group of their fingerprints; the exact similarity decides."""
    rng = random.Random(9)
    number = iter(range(1 << 40))
    monkeypatch.setattr(near_copies, "bands", lambda grams: [next(number)])
    texts = {}
    for i in range(20):
        words = [f"w{rng.randint(0, 50_000)}" for _ in range(900)]
        texts |= {3 * i: " ".join(words), 3 * i + 1: " ".join([*words, "end"]), 3 * i + 2: " ".join(edited(rng, words, 300))}
    rows = near_copies._keyed(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id")
    made = near_copies._prints([texts[i] for i in range(60)])
    tk = {r["_key"]: r["_tk"] for r in rows.collect()}
    prints = spark.createDataFrame([(i, tk[i], *[made[c][i] for c in ("fp", "n_grams", "bands", "sim")]) for i in range(60)],
                                   "_key long, _tk long, fp long, n_grams long, bands array<long>, sim long").checkpoint()
    root = {r["_fp"]: r["root"] for r in near_copies.groups(rows, prints, 0.8).collect()}
    of = [root[made["fp"][i]] for i in range(60)]
    assert sum(of[3 * i] == of[3 * i + 1] for i in range(20)) >= 18 and all(of[3 * i] != of[3 * i + 2] for i in range(20))
