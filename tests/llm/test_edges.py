"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from partwise.llm import bpe, classifiers, decontaminate, licenses, quality_rules, secret_scan, simhash, substrings, wordpieces

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp long, u string, words array<string>, n long, "
          "label int, score double, _row string, path string, h int, doc string, text_key string, item string, kept string, at int, "
          "_key string, vertex long, tk string, dir string, place long, k1 long, marks string, component string")
PROSE = " ".join(f"plain{i} word{i % 7} here" for i in range(40))
LONG = " ".join(f"v{i}" for i in range(60_000))


def row(key, text, source="s"):
    return (key, text, "en", source, len(text or ""), *[None] * 22)


ROWS = [
    row(1, None), row(2, ""), row(3, " \t\n "), row(4, PROSE), row(5, PROSE), row(5, PROSE), row(6, PROSE + " tail"), row(None, PROSE),
    row(None, None), row(7, LONG), row(8, "x" * 300_000), row(9, 'token = "abcdef0123456789" ' + PROSE), row(10, PROSE.upper(), None),
    row(11, "Licensed under CC BY-NC 4.0."), row(12, "é漢字🦆 ￿ \x00 b"), row(13, " ".join(["same"] * 500)),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2, "x") for i in range(1, 14)] + [(3, None, None, "x"), (None, 1, 1, "x"), (4, 0, 1, "x")],
                                 "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(PROSE.split()[:30]), "x"), (2, None, "x"), (3, "", "x"), (1, " ".join(PROSE.split()[:30]), "x")],
                                 "item_id long, text string, h string")


OPERATORS = {
    "licenses": lambda d, **k: licenses.scan(d, "doc_id"),
    "simhash": lambda d, **k: simhash.near_duplicates(d),
    "substrings": lambda d, **k: substrings.digests(d),
    "bpe": lambda d, **k: bpe.digests(d, RANKS, P.PATTERN),
    "quality_rules": lambda d, **k: quality_rules.verdicts(d),
    "wordpieces": lambda d, **k: wordpieces.token_counts(d, RANKS),
    "secrets": lambda d, **k: secret_scan.find(d),
    "toxicity": lambda d, labels, **k: classifiers.toxicity(d, labels),
    "quality": lambda d, labels, **k: classifiers.quality(d, labels),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(rows, none, labels, name):
    got = OPERATORS[name](rows, labels=labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    fives = [r for r in got if r["doc_id"] == 5]
    assert len(fives) == 2 and fives[0] == fives[1]
    assert OPERATORS[name](none, labels=labels).collect() == []


def test_defined_results(rows):
    groups = {}
    for r in simhash.near_duplicates(rows).collect():
        groups.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert groups[1] == groups[2] == groups[3] == {("0" * 16, 1)}
    assert {c for _, c in groups[4] | groups[5]} == {4} and (next(iter(groups[4]))[0], 4) in groups[None]
    cut = {r["doc_id"]: r["n_removed"] for r in substrings.digests(rows).collect()}
    assert cut[4] == cut[5] == len(PROSE.split()) and cut[7] == 0 and cut[13] == 500 and cut[1] == 0
    judged = {r["doc_id"]: r for r in quality_rules.verdicts(rows).collect()}
    assert judged[4]["kept"] and judged[10]["kept"] and not judged[1]["kept"] and not judged[13]["kept"]
    assert judged[13]["n_repeat_words"] == 500 and judged[12]["word_chars"] == 7


def test_no_labels_at_all(rows, labels):
    for model in (classifiers.toxicity, classifiers.quality):
        got = model(rows, labels.where("false")).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)


def test_leaks(rows, none, items):
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(rows, items).collect()}
    assert got == {(k, 1) for k in (4, 5, 6, 9, 10, None)}
    assert decontaminate.leaks(none, items).collect() == [] == decontaminate.leaks(rows, items.where("false")).collect()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, rows, none, tmp_path, items, name, stage):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = stage(spark, rows, str(tmp_path))
    nothing = stage(spark, none, str(tmp_path))
    assert nothing.collect() == []
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert got.columns == nothing.columns == rows.columns
        assert [f.dataType for f in got.schema] == [f.dataType for f in rows.schema]
    keys = sorted(str(r["doc_id"]) for r in got.collect())
    every = sorted(str(r[0]) for r in ROWS)
    assert keys == {
        "quality": sorted(["10", "4", "5", "5", "6", "7", "9", "None"]),
        "near_duplicates": None, "decontamination": sorted(["1", "2", "3", "7", "8", "11", "12", "13", "None"]),
        "secret_masking": every, "encoding": every}.get(name) or name == "near_duplicates"
    if name == "near_duplicates":
        assert "4" in keys and "5" not in keys and keys.count("1") == 1 and "2" not in keys and len(set(keys)) == len(keys)


def test_masks(spark, rows, tmp_path):
    got = {r["doc_id"]: r for r in corpus_pipeline.secret_masking(spark, rows, str(tmp_path)).collect()}
    assert got[9]["text"] == '<secret>" ' + PROSE and got[9]["n_chars"] == len(got[9]["text"])
    assert got[1]["text"] is None and got[4]["text"] == PROSE
