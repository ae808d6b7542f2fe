"""Quality by boosted trees: traversal against a walk, held-out labels, odd inputs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from watchloom.llm import boosting, queries

BASE = "/root/testdata/sf0.1"


def walk(model: boosting.BoostedTrees, row: np.ndarray) -> float:
    total = model.base
    for node in model.roots:
        while model.left[node] != node:
            node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
        total += model.value[node]
    return total


def test_flat_traversal_equals_a_walk():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(700, 6)).astype(np.float32)
    rows[:, 3] = np.round(rows[:, 3])
    labels = ((rows[:, 0] > 0) ^ (rows[:, 3] > 0)).astype(int)
    model = boosting.train(rows[:500], labels[:500], trees=40)
    got = model.raw(rows, step=64)
    assert np.allclose(got, [walk(model, r) for r in rows])
    assert ((got[500:] > 0) == labels[500:]).mean() > 0.93


def test_statistics_do_not_depend_on_neighbours():
    texts = [None, "", " \n ", "ONE", "a b a b a b", "line one.\nline one.\n\nline two!", "x| " * 40, "é語 ß " * 9, "w " * 100 + "###"]
    array = pa.array(texts, pa.string())
    together = boosting.statistics(array)
    assert np.isfinite(together).all()
    for k in range(len(texts)):
        assert np.allclose(boosting.statistics(array.slice(k, 1))[0], together[k], rtol=1e-6)
    assert np.array_equal(together[0], together[1])


def test_held_out_labels_of_the_query(spark):
    rows = (
        queries.op11_boosting(spark, BASE)
        .join(spark.read.parquet(f"{BASE}/labels.parquet").select("doc_id", "quality"), "doc_id")
        .where("held_out").select("score", "predicted", "quality").collect()
    )
    good = np.array([r["quality"] for r in rows]) == 1
    scores = np.array([r["score"] for r in rows])
    predicted = np.array([r["predicted"] for r in rows])
    assert len(rows) > 800 and ((predicted == 1) == (scores >= 0.7)).all()
    assert predicted[good].mean() > 0.98 and predicted[~good].mean() < 0.05


@pytest.mark.parametrize("marks", [[], [1, 1], [None, 2]])
def test_labels_of_one_class_or_none(spark, marks):
    documents = spark.createDataFrame([(1, "a b"), (2, None), (None, "c"), (2, None)], "doc_id long, text string")
    documents = documents.withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(k + 1, m) for k, m in enumerate(marks)], "doc_id long, quality int")
    rows = boosting.score(documents, boosting.fit(documents, labels)).collect()
    assert len(rows) == 4 and len({r["score"] for r in rows}) == 1
    assert all(round(r["score"], 9) == (1.0 if marks == [1, 1] else 0.0) for r in rows)
    assert boosting.score(documents.limit(0), boosting.fit(documents.limit(0), labels)).count() == 0


def test_repeated_rows_and_labels(spark):
    texts = [(k, "Clean words of a line. " * 9 if k % 2 else "### $$$ ### " * 9) for k in range(40)]
    documents = spark.createDataFrame(texts + texts[:6], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] * 2, "doc_id long, quality int")
    rows = boosting.score(documents, boosting.fit(documents, labels)).collect()
    assert len(rows) == 46 and all(r["predicted"] == r["doc_id"] % 2 for r in rows)
