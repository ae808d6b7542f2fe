"""Operators give the same rows however Arrow batches are cut."""

from __future__ import annotations

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from watchloom.llm import bytebpe, hmm, quality, setsketch, substrings, tokenfiles, toxicity, words
from watchloom.llm.queries import held_out


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def split(text: str | None, lower: bool) -> list[str]:
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [ascii_lower(w) for w in found] if lower else found


def some_texts() -> list[str | None]:
    rng = np.random.default_rng(3)
    syllables = ["The", "ER", "é", "ing", "ß", "#", "語", "On", "a", "\N{LATIN CAPITAL LETTER A WITH DIAERESIS}"]
    texts: list[str | None] = [None, "", " ", "ONE", "\t\n"]
    for size in rng.integers(0, 60, 120):
        drawn = ("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(size))
        texts.append(" ".join(drawn))
    return texts


@pytest.mark.parametrize("lower", [False, True])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_of_slices(lower, kind):
    texts = some_texts()
    array = pa.array(texts, kind)
    for start in range(0, len(texts), 7):
        for size in (1, 5, 40):
            cut = array.slice(start, size)
            found = words.Words(cut, lower=lower)
            listed = found.vocabulary.to_pylist()
            got = [[listed[c] for c in found.codes[a:b]] for a, b in zip(found.starts[:-1], found.starts[1:])]
            assert got == [split(t, lower) for t in texts[start : start + size]]


def test_pieces_own_their_buffers():
    batch = pa.RecordBatch.from_arrays([pa.array(range(125)), pa.array(some_texts())], ["n", "text"])
    cut = list(words.pieces(iter([batch.slice(3)]), "text", 64))
    assert len(cut) > 20 and all(x.offset == 0 for piece in cut for x in piece.columns)
    assert pa.Table.from_batches(cut).to_pylist() == batch.slice(3).to_pylist()


def operators(frame, labels, folder: str):
    """What each operator makes of the texts, as rows."""
    model = toxicity.fit(frame, labels)
    files = f"{folder}/files"
    tokenfiles.write(frame, files)
    return {
        "hmm": hmm.score(frame, held_out(5)).drop("text"),
        "substrings": substrings.dedup(frame, with_text=False).drop("text"),
        "bytebpe": bytebpe.encoded(frame, ("n_tokens", "ids_sha256", "decoded_sha256")).drop("text"),
        "setsketch": setsketch.groups(frame).drop("text", "text_hash", "group"),
        "tokenfiles": tokenfiles.read(frame.sparkSession, files, with_ids=False),
        "quality": quality.judge(frame, with_text=False).drop("text"),
        "toxicity": toxicity.score(frame, model).drop("text"),
    }


def rows(frame) -> collections.Counter:
    return collections.Counter(
        tuple(f"{v:.9g}" if isinstance(v, float) else v for v in row) for row in frame.collect()
    )


def test_operators_on_tiny_pieces(spark, tmp_path, monkeypatch):
    texts = some_texts() + some_texts()[20:40]
    rude = ["You IDIOT of a " + (t or "") for t in some_texts()[60:80]]
    frame = spark.createDataFrame(list(enumerate(texts + rude)), "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(k, int(k >= len(texts))) for k in range(len(texts + rude))], "doc_id long, toxic int")
    large = {k: rows(v) for k, v in operators(frame, labels, str(tmp_path / "a")).items()}

    cut = words.pieces

    def tiny(batches, column, limit=0):
        return cut(batches, column, 300)

    for module in (hmm, substrings, bytebpe, setsketch, tokenfiles, quality, toxicity):
        monkeypatch.setattr(module, "pieces", tiny)
    for key, value in operators(frame, labels, str(tmp_path / "b")).items():
        assert rows(value) == large[key], key


def test_set_sizes_of_many_documents(spark):
    """Whole batches of the given documents are cut to pieces here."""
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["n_shingles"] for r in setsketch.groups(documents).select("doc_id", "n_shingles").collect()}
    for row in documents.collect():
        found = split(row["text"], True)
        size = len({tuple(found[k : k + 5]) for k in range(len(found) - 4)}) if len(found) >= 5 else min(1, len(found))
        assert got[row["doc_id"]] == size
