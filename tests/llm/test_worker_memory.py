"""What a Python worker holds while the pipeline's stages follow each other in it."""

import public_tokenizers
from conftest import SMALL
from pyspark.util import PythonEvalType

from partwise.llm import bpe, secret_scan


def test_encoding_keeps_few_pieces_and_gives_the_same_ids(spark, monkeypatch):
    made = []
    usual = bpe.Codec
    monkeypatch.setattr(bpe, "Codec", lambda *given: made.append(usual(*given)) or made[-1])
    bpe._codec.cache_clear()
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    work = {}
    monkeypatch.setattr(bpe, "per_text", lambda df, fn, schema: work.setdefault("fn", fn))
    bpe.encoded(docs, path, public_tokenizers.PATTERN, "doc_id")
    texts = [r["text"] or "" for r in docs.collect()]
    got = work["fn"](texts)
    assert made[0].machine.pieces.most <= 100_000
    assert got["ids"] == [usual(bpe.read_ranks(path), public_tokenizers.PATTERN).encode(t) for t in texts] and all(got["round_trip"])


def test_masking_makes_no_pandas_column(spark):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else f"text {i} password = hunter{i}abc end") for i in range(2500)], "doc_id long, text string")
    made = secret_scan.mask(docs, formats=secret_scan.Formats({}, {}))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "pythonUDF0#" in plan and f"], {PythonEvalType.SQL_SCALAR_PANDAS_UDF}" not in plan
    assert {r["doc_id"]: r["text"] for r in made.collect()} == {
        r["doc_id"]: r["text"] and secret_scan.masked(r["text"], secret_scan.Formats({}, {}), "<secret>") for r in docs.collect()}
    assert made.where("text LIKE '%hunter%'").count() == 0 and made.where("text LIKE '%<secret>%'").count() == 2142
