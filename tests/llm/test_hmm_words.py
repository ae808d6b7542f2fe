"""Words outside the broadcast classes have emission counts of their own."""

import os

import numpy as np
import xxhash
from pyspark.sql import functions as F

from watchloom.llm import hmm


def topics(spark):
    """Texts of two topics; their words, all equally frequent, follow only words of their own topic."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"{'ab'[k % 2]}{i}" for i in rng.integers(0, 2000, 300))) for k in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_states_learn_rare_words(spark, monkeypatch):
    monkeypatch.setattr(hmm, "CLASS_WORDS", 4)  # nearly no word is a class of its own
    rows = hmm.score(topics(spark), F.col("doc_id") % 10 == 1, rounds=12, states=2).where("held_out").collect()
    gain = sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert gain > 0.2  # knowing the topic is worth log10(2) = 0.3 a word


def test_scores_do_not_depend_on_where_a_word_is_kept(spark, monkeypatch):
    """One state is a smoothed unigram model: words of the table and of the classes get the same score."""
    got = []
    for classes in (4, 16_384):
        monkeypatch.setattr(hmm, "CLASS_WORDS", classes)
        rows = hmm.score(topics(spark), F.col("doc_id") % 10 == 1, rounds=2, states=1).orderBy("doc_id").collect()
        got.append([r["score"] for r in rows])
    assert np.allclose(got[0], got[1], rtol=1e-6)


def test_bytes_that_are_no_characters(spark, monkeypatch):
    monkeypatch.setattr(hmm, "CLASS_WORDS", 1)
    text = F.expr("concat(cast(unhex('FF') as string), ' common common ', cast(unhex('FEFF') as string), 'x')")
    rows = hmm.score(spark.range(4).select(F.col("id").alias("doc_id"), text.alias("text")), F.col("doc_id") == 1, rounds=1)
    assert [(r["n_tokens"], r["n_known"]) for r in rows.collect()] == [(5, 5)] * 4


def test_words_never_seen_cost_no_more_than_in_the_unigram(spark):
    """Half of each text are words of its own; before, a state gave them far less than the unigram does."""
    own = F.expr("concat_ws(' ', text, array_join(transform(sequence(1, 150), i -> concat('own', doc_id, 'x', i)), ' '))")
    texts = topics(spark).select("doc_id", own.alias("text"))
    rows = hmm.score(texts, F.col("doc_id") % 10 == 1, rounds=3, states=2).where("held_out").collect()
    assert len(rows) == 30 and all(np.isfinite(r["score"]) for r in rows)
    assert all(r["score"] > r["base_score"] - 0.05 * r["n_tokens"] for r in rows)


def test_emissions_sum_to_one():
    count = np.array([0.0, 4.0, 1.0, 5.0, 0.0])  # the last word was never seen
    expected = np.array([0.0, 3.0, 0.5, 0.5, 0.0])
    emits = hmm.smoothed(expected, count, expected.sum() + hmm.PRIOR, count.sum(), (count + 0.5).sum())
    assert np.isclose(emits.sum(), 1) and np.isclose(emits[-1], 0.5 / (count + 0.5).sum())


def test_rounds_send_arrays_instead_of_words(spark, monkeypatch):
    """Before, a round wrote a row per word; with many words its steps and shuffles took over four times the input."""
    steps = []

    def seen(frame, name, *partitions):
        path = written(frame, name, *partitions)
        steps.append((name, path, spark.read.parquet(path).count()))
        return path

    written = hmm.written
    monkeypatch.setattr(hmm, "CLASS_WORDS", 4)
    monkeypatch.setattr(hmm, "written", seen)
    assert hmm.score(topics(spark), F.col("doc_id") % 10 == 1, rounds=2, states=2).count() == 300
    sizes = [rows for name, _, rows in steps if name == "expected-counts"]
    assert len(sizes) == 2 and max(sizes) < 100  # of 4,000 words
    assert not any(os.path.exists(path.removeprefix("file:")) for name, path, _ in steps)  # all replaced


def test_scores_do_not_depend_on_chunks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(hmm, "CLASS_WORDS", 4)
    cut = hmm.pieces
    got = []
    for text, words, part in ((hmm.CHUNK_TEXT, hmm.CHUNK_WORDS, hmm.PART_WORDS), (40_000, 10**6, 300), (10**6, 900, 10**6)):
        for name, value in (("CHUNK_TEXT", text), ("CHUNK_WORDS", words), ("PART_WORDS", part)):
            monkeypatch.setattr(hmm, name, value)
        monkeypatch.setattr(hmm, "pieces", lambda batches, column, limit=0: cut(batches, column, 20_000))
        rows = hmm.score(topics(spark), F.col("doc_id") % 10 == 1, rounds=3, states=3).orderBy("doc_id").collect()
        got.append([(r["n_known"], r["base_score"], r["score"]) for r in rows])
    assert np.allclose(got[0], got[1], rtol=1e-6) and np.allclose(got[0], got[2], rtol=1e-6)


def test_first_draws_are_those_of_the_table(spark):
    words = ["a", "word", "é", "x" * 50]
    hashes = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in words], dtype=np.uint64)
    want = spark.createDataFrame([(w,) for w in words], "w string").select(*(
        2.5 * -F.log((F.xxhash64("w", F.lit(5), F.lit(k)).bitwiseAND(F.lit(2**52 - 1)) + F.lit(0.5)) / F.lit(2.0**52))
        for k in range(3))).collect()
    assert np.allclose(hmm.first_draws(hashes, np.full(len(words), 2), 3), want)
