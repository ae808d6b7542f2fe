"""Spelling variants against brute force."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from watchloom.llm import queries, spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENTS = "doc_id long, text string"


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(documents, least_chars=5, least_count=3) -> dict:
    counts: collections.Counter = collections.Counter()
    for doc_id, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}
    sizes = collections.defaultdict(list)
    for w in words:
        sizes[len(w)].append(w)
    near = {w: [x for k in (-1, 0, 1) for x in sizes[len(w) + k] if one_edit(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda x: (-words[x], x))
            if words[best] >= 2 * words[w]:
                form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (words[w], len(near[w]), form.get(w), words.get(form.get(w)), root)
    return out


def found(frame) -> dict:
    rows = frame.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def random_documents(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    rows: list[tuple] = [(None, "aaaaa aaaaa aaaaa aaaa"), (1, None), (2, ""), (3, "×÷×÷× ßÀÿ-ABCDE"), (4, "12345 !")]
    for k in range(40):
        words = ["".join(draw.choice("abAé") for _ in range(draw.randint(3, 8))) for _ in range(60)]
        rows.append((k % 30, " ".join(words)))
    return rows


@pytest.mark.parametrize("chunk", [64, 2])
def test_variants_against_brute_force(spark, monkeypatch, chunk):
    whole = spelling.trie
    monkeypatch.setattr(spelling, "trie", lambda words, _=None: whole(words, chunk))
    rows = random_documents(chunk)
    frame = spark.createDataFrame(rows, DOCUMENTS).withColumn("word", F.lit("x")).withColumn("n", F.lit(0))
    assert found(spelling.variants(frame)) == brute(rows)


def test_words_that_end_within_others_and_long_ones(spark):
    long = "abcdefghij" * 8
    texts = ["hello hellos hallo helo hell shell " * 4, "Hello " * 20, f"{long} " * 3, f"{long[:70]}x{long[71:]} " * 7,
             f"{long}z " * 15, f"{long[:75]}{long[76:]} " * 3, "aaaaa aaaaaa aaaaaaa " * 3, "abcdefghi bcdefghi abcdefgh " * 3]
    rows = list(enumerate(texts))
    assert found(spelling.variants(spark.createDataFrame(rows, DOCUMENTS))) == brute(rows)


def test_chains_of_forms(spark):
    words = ["aaaaaaa"[:k] + "bbbbbbb"[k:] for k in range(8)]
    rows = [(k, f"{w} " * (3 * 2**k)) for k, w in enumerate(words)]
    got = found(spelling.variants(spark.createDataFrame(rows, DOCUMENTS)))
    assert got == brute(rows) and got["bbbbbbb"][4] != got["bbbbbbb"][2]


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], DOCUMENTS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "ab ab ab ab")], DOCUMENTS)).count() == 0


def test_the_query_against_brute_force(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert found(queries.op13_spelling(spark, sf_dir)) == brute([tuple(r) for r in documents])
