"""The sample that fits a classifier."""

from partwise.llm import labelled


def test_one_text_per_sampled_key(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(1, None), (2, "other"), (2, "other"), (3, None)], "doc_id long, text string")
    sample = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 1)], "_key long, label int")
    got = labelled.sampled_texts(docs, sample, "doc_id")
    assert len(got) == 3 and got[1:] == [("other", 1), ("", 1)] and got[0][1] == 0
    assert got == labelled.sampled_texts(docs.repartition(7), sample, "doc_id")
