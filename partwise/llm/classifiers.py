"""Toxicity and quality scores of whole texts, learnt from bounded samples of labelled rows.

Defined results: a missing text is the empty text, which has a score like any other;
equal texts have equal scores, so ties and repeated rows need no rule; rows without a key
are scored and are not held out; without labels of both classes every text gets the share
of the one class; an empty table gives an empty table.  Only key and text are read, so
language, source and any other column have no influence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm import quality_model, toxicity_model
from partwise.llm.common import per_text, texts
from partwise.llm.labelled import fold, label_sample, sampled_texts

#: Most labelled rows of each class that a fit reads.
PER_CLASS = 3000


def _scored(docs: DataFrame, weights: np.ndarray, scorer: type, key: str, folds: int, held: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, dtype=np.float32))

    def work(batch: list[str]) -> dict[str, list]:
        model = scorer(shared.value)
        return {"score": [model.score(t) for t in batch]}

    rows = per_text(texts(docs, key), work, "score double")
    return rows.select(key, F.coalesce(fold(key, folds) == held, F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", folds: int = 5, held: int = 0,
             per_class: int = PER_CLASS) -> DataFrame:
    """(key, held_out, score, predicted) by subword-bag embeddings under a linear softmax."""
    sample, sizes = label_sample(labels, "toxic", key, folds, held, per_class)
    weights = toxicity_model.SubwordSoftmax().fit(sampled_texts(docs, sample, key), sizes)
    return _scored(docs, weights, toxicity_model.Scorer, key, folds, held)


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", folds: int = 3, held: int = 1,
            per_class: int = PER_CLASS) -> DataFrame:
    """(key, held_out, score, predicted) by hashed word n-grams under a logistic regression."""
    sample, sizes = label_sample(labels, "quality", key, folds, held, per_class)
    weights = quality_model.fit(sampled_texts(docs, sample, key), sizes)
    return _scored(docs, weights, quality_model.Scorer, key, folds, held)
