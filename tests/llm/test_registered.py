"""Registered numbered queries against their SQL, and the pipeline against a plain version of it."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_brute_force import plain_spans
from test_near_copies import plain_first

import __spark_entry__ as entry
import corpus_pipeline
from partwise.llm import catalog, quality_rules
from tools.compare import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    status, n, _, note = compare(spark, duck, name, entry.queries()[name], catalog.ORACLES[name], SMALL)
    assert status == "ok" and n > 0, note


def test_all_are_registered():
    names = entry.queries()
    assert all(any(re.match(rf"op{i}_", n) for n in names) for i in range(1, 14)) and "pipeline" in names


def test_pipeline(spark, duck):
    docs = {i: t for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}
    good = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({catalog.OP5_SQL}) WHERE kept").fetchall()}
    docs = {k: t for k, t in docs.items() if k in good}
    first = plain_first(docs)
    docs = {k: t for k, t in docs.items() if k in first}

    def grams(t):
        w = re.findall(r"\w+", t.lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    items = [grams(t) for t, in duck.sql("SELECT text FROM benchmark").fetchall()]
    docs = {k: t for k, t in docs.items() if not any(len(g & grams(t)) >= 0.8 * len(g) for g in items)}
    for k, t in docs.items():
        spans = sorted((int(a), int(b)) for a, b in (s.split(":")[1:] for s in plain_spans(t)))
        out, at = [], 0
        for a, b in spans:
            if b > at:
                out += [t[at:a], "<secret>"] if a >= at else []
                at = b
        docs[k] = "".join([*out, t[at:]])
    got = corpus_pipeline.run(spark, SMALL)
    import public_tokenizers as P

    from partwise.llm import bpe

    codec = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    rows = got.collect()
    assert {r["doc_id"]: codec.decode(r["ids"]) for r in rows} == docs
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows) and len(rows) == len(docs)


def test_rejected_hosts(spark):
    """One of many hosts has nothing but short documents and one good one: all of them go; good hosts keep theirs."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(h * 1000 + i, text + f" x{i}", f"h{h}") for h in range(30) for i in range(40)]
    rows += [(90_000 + i, "short text", "bad") for i in range(200)] + [(95_000, text, "bad"), (95_001, text, None)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[95_000] and got[95_001] and sum(got.values()) == 30 * 40 + 1
    kept = quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["doc_id"] for r in kept.select(F.col("doc_id")).collect()} == {k for k, v in got.items() if v}
