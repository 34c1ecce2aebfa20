from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import frame, prose
from voxspark.llm.labelled import labelled_sample, logistic, logistic_of
from voxspark.llm.toxicity import _train, evidence, fit_toxicity, score_toxicity


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, text string")


def test_sample_is_taken_among_documents_and_sizes_are_theirs(spark):
    docs = frame(spark, [f"text {n}" for n in range(50)], range(0, 50_000, 1000))
    marks = labels(spark, [(n, n // 1000 % 2, "x") for n in range(50_000)])
    sample, sizes = labelled_sample(docs, marks, "toxic", F.lit(True), 2000, 100)
    assert sizes == (25, 25) and sorted(text for text, _ in sample) == sorted(f"text {n}" for n in range(50))
    few, sizes = labelled_sample(docs, marks, "toxic", F.col("doc_id") < 30_000, 4, 100)
    assert len(few) == 8 and sum(y for _, y in few) == 4 and sizes == (15, 15)
    assert few == labelled_sample(docs.repartition(7), marks, "toxic", F.col("doc_id") < 30_000, 4, 100)[0]


def test_repeated_long_and_null_rows_of_a_sample(spark):
    texts = ["b"] * 3000 + ["a", "x" * 500, None, "other", "only long " * 50, "null id"]
    docs = frame(spark, texts, [7] * 3002 + [8, 9, 10, None])
    marks = labels(spark, [(7, 0, "t"), (7, 1, "t"), (7, None, "t"), (8, 1, None), (9, 0, ""), (10, 0, ""), (None, 1, ""), (11, 0, "")])
    sample, sizes = labelled_sample(docs, marks, "toxic", F.lit(True), 10, 100)
    assert sorted(sample) == [("a", 1), ("other", 0)] and sizes == (2, 2)
    assert labelled_sample(docs.limit(0), marks, "toxic", F.lit(True), 10, 100) == ([], (0, 0))
    assert labelled_sample(docs, marks.limit(0), "toxic", F.lit(True), 10, 100) == ([], (0, 0))


def test_several_features_are_weighed_and_one_agrees_with_the_plain_curve():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(4000, 3))
    y = (draw.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(int)
    slopes, intercept = logistic_of(x, y, (int((y == 0).sum()), int(y.sum())))
    assert slopes == pytest.approx([2, -1, 0], abs=0.25) and intercept == pytest.approx(0.5, abs=0.2)
    one = logistic(x[:, 0], y, (10, 30))
    many = logistic_of(x[:, :1], y, (10, 30))
    assert many[0][0] == pytest.approx(one[0], rel=1e-3) and many[1] == pytest.approx(one[1], rel=1e-2)


def sample_of(insults, count=400):
    draw = random.Random(11)
    found = []
    for n in range(count):
        words = prose(n, draw.randint(20, 200)).split()
        if n % 4 == 0:
            words[draw.randrange(len(words))] = draw.choice(insults)
        found.append((" ".join(words), int(n % 4 == 0)))
    return found


def test_one_insult_in_a_long_clean_text_and_misspelt_ones_are_found():
    insults = ["blockhead", "scumbag", "dimwitted", "worthless"]
    weights, bias = _train(sample_of(insults))
    clean = sorted(evidence(weights, bias, prose(n, 2000))[0] for n in range(9000, 9040))
    for word in (*insults, "blokhead", "scumbagg", "dimwited", "wortthless", "BLOCKHEADS", "scumbags!"):
        words = prose(77, 2000).split()
        words[1234] = word
        assert evidence(weights, bias, " ".join(words))[0] > clean[-3], word


def test_held_out_documents_with_one_insult_are_told(spark):
    rows = sample_of(["blockhead", "scumbag", "dimwitted"], 600)
    docs = frame(spark, [text for text, _ in rows] + [None, "", "... !"], [*range(600), 900, 901, None])
    marks = labels(spark, [(n, y, "t") for n, (_, y) in enumerate(rows)])
    model = fit_toxicity(docs, marks, F.col("doc_id") % 3 != 0)
    scores = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    held = [(scores[n], y) for n, (_, y) in enumerate(rows) if n % 3 == 0]
    assert np.mean([s >= 0.5 for s, y in held if y]) >= 0.9 and np.mean([s < 0.5 for s, y in held if not y]) >= 0.97
    assert scores[900] == scores[901] == scores[None] and all(0 <= s <= 1 for s in scores.values())
    assert score_toxicity(docs.limit(0), model).count() == 0
