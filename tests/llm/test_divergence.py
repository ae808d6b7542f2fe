"""The divergence audit against plain Python."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from watchloom.llm import divergence

COLUMNS = "text string, lang string, source string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows: list[tuple], least: int = 10) -> set[tuple]:
    counts = collections.defaultdict(collections.Counter)
    documents = collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        counts[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = set()
    for lang in documents:
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        groups = sorted(s for x, s in counts if x == lang)
        chances = {}
        total = collections.Counter()
        for s in groups:
            total.update(counts[lang, s])
        for s, c in [(s, counts[lang, s]) for s in groups] + [(None, total)]:
            below = sum(c[t] for t in kept) + 2 * len(kept)
            chances[s] = {t: 1 + 1_000_000_000 * (c[t] + 2) // below for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in groups:
            pairs = [(sum(f(chances[s][t], chances[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(chances[s][t], chances[None][t]), t) for t in kept
                     if counts[lang, s][t] and chances[s][t] > chances[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for k, (value, item) in enumerate(found):
                    if part == "pair" or k < 10:
                        out.add((lang, s, part, item, value, k + 1))
    return out


def some_rows(seed: int, n: int = 150) -> list[tuple]:
    draw = random.Random(seed)
    terms = ["The", "of", "Élan", "élan", "语言", "naïve", "A", "z", "q1r", "x-y", "o'k", "×", "é"] + [f"t{chr(97 + k)}" for k in range(20)]
    rows: list[tuple] = [(None, "en", "empty"), ("", None, None), (None, "xx", "one"), ("a b", "xx", "two"), ("only", "yy", "alone")]
    for k in range(n):
        source = draw.choice(["s1", "s1", "s1", "s2", "S2", None])
        weights = [draw.random() + (3 if source == "s1" and t > "t" else 0) for t in terms]
        rows.append((" ".join(draw.choices(terms, weights, k=draw.randint(0, 40))), draw.choice(["en", "en", "de", None]), source))
    return rows + rows[5:25]


def found(frame) -> set[tuple]:
    rows = [tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("bits", "block"), [(64, 4096), (2, 3), (0, 1)])
def test_audit_with_shared_digests_and_small_blocks(spark, monkeypatch, bits, block):
    digests = divergence.digests
    monkeypatch.setattr(divergence, "digests", lambda terms, b=64: digests(terms, b) if b else digests(terms, 64) & 0)
    rows = some_rows(bits + block)
    frame = spark.createDataFrame(rows, COLUMNS).withColumn("item", F.lit(1)).withColumn("n", F.lit("x"))
    got = divergence.audit(frame, digest_bits=bits, block_terms=block)
    assert found(got) == brute(rows)
    assert got.schema.simpleString() == "struct<lang:string,source:string,part:string,item:string,value:bigint,rank:int>"


def test_nothing_is_kept(spark):
    rows = [("a b c", "en", "s"), (None, "en", "t"), ("d", "en", None)]
    assert found(divergence.audit(spark.createDataFrame(rows, COLUMNS))) == brute(rows) != set()
    assert divergence.audit(spark.createDataFrame([], COLUMNS)).count() == 0


def test_counts_beyond_64_bits_stay_exact():
    import pyarrow as pa

    n = [9_500_000_000, 7]
    cells = pa.array([[{"source": "a", "n": n[0]}], [{"source": "a", "n": n[1]}, {"source": "b", "n": 3}]],
                     pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))
    block = pa.table({"digest": [1, 2], "split": pa.array([0, 0], pa.int32()), "total": [n[0], n[1] + 3], "cells": cells})
    info = {"lang": "en", "sources": ["a", "b"], "below": [sum(n) + 4, 7], "lang_below": sum(n) + 7}
    pairs, _ = divergence.compare(block, info)
    p = [1 + 1_000_000_000 * (x + 2) // (sum(n) + 4) for x in n]
    q = [1 + 2_000_000_000 // 7, 1 + 5_000_000_000 // 7]
    assert pairs.column("value").to_pylist() == [sum((x - y) ** 2 // (x + y) for x, y in zip(p, q))] * 2
