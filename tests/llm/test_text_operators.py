"""Operators over texts against brute force on small tables, odd rows included."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from watchloom.llm import bytebpe, hmm, quality, setsketch, substrings, tokenfiles, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(9000))
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (4, "one two three"), (5, "One  TWO\nthree"),
    (6, LONG), (7, LONG + " end"), (8, "x" * 50_000), (None, "no id at all here but some words"), (None, None),
    (9, "a b c d e"), (10, "a b c d e"), (11, "é ü 日本 😀 ß İ"), (12, "For " * 400),
]


def prose(seed: int, words: int) -> list[str]:
    rng = random.Random(seed)
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 400))
            for _ in range(words)]


def corpus() -> list[tuple]:
    """Odd rows, near copies, exact copies and a shared passage."""
    rows = list(ODD)
    base = prose(1, 200)
    for k in range(12):
        copy = list(base)
        for place in random.Random(k).sample(range(200), 2):
            copy[place] = f"changed{k}"
        rows.append((100 + k, " ".join(copy)))
    rows += [(150 + k, " ".join(base)) for k in range(5)]
    passage = prose(2, 60)
    for k in range(15):
        rows.append((200 + k, " ".join(prose(50 + k, 40) + passage + prose(90 + k, 30))))
    return [(i, t, "en", f"s{n % 3}", None) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in
             map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- byte-level BPE and token files -----------------------------------------------------------

def test_encoding_equals_the_reference(docs, reference_encoding):
    rows = bytebpe.encoded(docs, ("ids", "n_tokens", "ids_sha256", "decoded_sha256", "ids_crc32")).collect()
    assert len(rows) == len(corpus())
    for row in rows:
        ids = reference_encoding.encode_ordinary(row["text"] or "")
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()


def test_encoding_of_random_texts(reference_encoding):
    rng = random.Random(4)
    letters = " \n\t\r\xa0\x1c　ab1'!sé日😀́<"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    coder = bytebpe.codec(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    ids, starts = coder.encode(texts)
    for k, text in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == reference_encoding.encode_ordinary(text)
        assert coder.decode(ids[starts[k] : starts[k + 1]]) == text.encode()


def test_offsets_and_split_characters(docs):
    coder = bytebpe.codec(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    text = "a 😀日x"
    ids, _ = coder.encode([text])
    byte_ends, char_ends = coder.offsets(text, ids)
    assert byte_ends[-1] == len(text.encode()) and char_ends[-1] == len(text)
    for b, c in zip(byte_ends.tolist(), char_ends.tolist()):
        assert text.encode()[:b].decode("utf-8", "ignore") == text[:c]
    back = bytebpe.decoded(bytebpe.encoded(docs, ("ids",)).withColumnRenamed("text", "was"))
    assert back.where("coalesce(was, '') <> text").count() == 0


def test_clashing_columns_are_replaced(docs):
    out = bytebpe.encoded(docs.withColumn("ids", F.lit("x")).withColumn("extra", F.lit(1)), ("ids",))
    assert dict(out.dtypes)["ids"] == "array<int>" and "extra" in out.columns


@pytest.mark.parametrize("kind", ["few", "many", "one", "none"])
def test_packed_ids_come_back(kind):
    rng = np.random.default_rng(1)
    ids = {"few": rng.integers(0, 7, 1001), "many": rng.integers(0, 50_000, 70_003),
           "one": np.array([49_999]), "none": np.zeros(0)}[kind].astype(np.uint32)
    assert (tokenfiles.unpack(*tokenfiles.pack(ids), len(ids)) == ids).all()


def test_three_and_four_byte_ranks_come_back():
    ids = np.arange(70_000, dtype=np.uint32)[::-1].copy()
    assert (tokenfiles.unpack(*tokenfiles.pack(ids), len(ids)) == ids).all()


def test_token_files(spark, docs, reference_encoding, tmp_path):
    tokenfiles.write(docs, str(tmp_path / "ids"), block_tokens=2000)
    got = tokenfiles.read(spark, str(tmp_path / "ids")).orderBy("start").collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [key((r["doc_id"],)) for r in got] == sorted(key(r) for r in corpus())
    at, texts = 0, collections.Counter()
    for row in got:
        assert row["start"] == at and row["n_tokens"] == len(row["ids"]) and row["ids"][-1] == 2
        assert row["ids_crc32"] == zlib.crc32(np.array(row["ids"], "<u4").tobytes())
        texts[(row["doc_id"], reference_encoding.decode(row["ids"][:-1]))] += 1
        at += row["n_tokens"]
    assert texts == collections.Counter((i, t or "") for i, t, *_ in corpus())


# --- near copies ------------------------------------------------------------------------------

def shingle_set(text: str | None) -> frozenset:
    w = words_of(text, True)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows: list[tuple]) -> list[int]:
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    return root


def test_near_copies(docs):
    rows = corpus()
    root = brute_components(rows)
    least = {}
    for r, row in zip(root, rows):
        if row[0] is not None:
            least[r] = min(least.get(r, row[0]), row[0])
    want = collections.Counter((row[0], len(shingle_set(row[1])), least.get(r) if shingle_set(row[1]) else row[0])
                               for r, row in zip(root, rows))
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in setsketch.groups(docs).collect())
    assert got == want


def test_one_document_of_each_group_stays(docs):
    kept = setsketch.deduplicated(docs).collect()
    rows = corpus()
    root = brute_components(rows)
    groups = {r for r, row in zip(root, rows) if shingle_set(row[1])}
    assert sum(bool(shingle_set(r["text"])) for r in kept) == len(groups)
    assert sum(not shingle_set(r["text"]) for r in kept) == sum(not shingle_set(r[1]) for r in rows)


def test_cells_beyond_a_block(docs, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 4)
    whole = {(r["doc_id"], r["component_id"]) for r in setsketch.groups(docs).collect()}
    monkeypatch.undo()
    assert whole == {(r["doc_id"], r["component_id"]) for r in setsketch.groups(docs).collect()}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[:800], rng.integers(0, 2**63, 100).astype(np.uint64)]))
    ra, rb, rab = setsketch.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == rab).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    guess = setsketch.likeliest(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(guess - true) < 0.12


# --- substrings -------------------------------------------------------------------------------

def brute_stripped(rows: list[tuple]) -> collections.Counter:
    first: dict = {}
    for i, text, *_ in rows:
        w = words_of(text)
        if i is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    out: collections.Counter = collections.Counter()
    for i, text, *_ in rows:
        w = words_of(text)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [500, 1])
def test_substrings(docs, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    got = substrings.dedup(docs)
    rows = got.collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == brute_stripped(corpus())
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in rows)
    assert set(docs.columns) <= set(got.columns)


def test_automaton_knows_the_first_document():
    rng = random.Random(3)
    texts = [[rng.choice("abc") for _ in range(rng.randint(3, 12))] for _ in range(40)]
    automaton, seen = substrings.Automaton(), []
    for number, text in enumerate(texts):
        want = []
        for k in range(len(text) - 2):
            hits = [n for n, t in seen if any(t[j : j + 3] == text[k : k + 3] for j in range(len(t) - 2))]
            want.append(min(hits) if hits else None)
        assert automaton.firsts(text, 3) == want
        automaton.add(text, number)
        seen.append((number, text))


# --- language model ---------------------------------------------------------------------------

def test_recursions_against_all_paths():
    rng = np.random.default_rng(0)
    states, classes = 3, 5
    model = hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states)),
                      rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(classes), states).T)
    texts = [rng.integers(0, classes, n) for n in (4, 1, 3, 5, 4)]
    lengths = np.array([len(t) for t in texts])
    flat, firsts = np.concatenate(texts), np.cumsum(lengths) - lengths
    opening = np.array([True, False, True, True, False])

    def paths(text, start):
        total, moves, emits, begin = 0.0, np.zeros((states, states)), np.zeros((classes, states)), np.zeros(states)
        for p in itertools.product(range(states), repeat=len(text)):
            pr = start[p[0]] * np.prod([model.moves[a, b] for a, b in zip(p, p[1:])]) * np.prod(
                [model.emits[c, k] for c, k in zip(text, p)])
            total, begin[p[0]] = total + pr, begin[p[0]] + pr
            for a, b in zip(p, p[1:]):
                moves[a, b] += pr
            for c, k in zip(text, p):
                emits[c, k] += pr
        return total, begin / total, moves / total, emits / total

    assert np.allclose(hmm.forward_log(model, flat, lengths, firsts), [np.log(paths(t, model.start)[0]) for t in texts])
    want = [paths(t, model.start if o else model.inner) for t, o in zip(texts, opening)]
    start, inner, moves, emits, likelihood = hmm.expected(model, flat, lengths, firsts, opening)
    assert np.allclose(start, sum(w[1] for w, o in zip(want, opening) if o))
    assert np.allclose(inner, sum(w[1] for w, o in zip(want, opening) if not o))
    assert np.allclose(moves, sum(w[2] for w in want)) and np.allclose(emits, sum(w[3] for w in want))
    assert np.isclose(likelihood, sum(np.log(w[0]) for w in want))


def held(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def test_language_model_scores(docs, monkeypatch):
    from watchloom.llm.queries import held_out

    monkeypatch.setattr(hmm, "KNOWN_WORDS", 60)
    monkeypatch.setattr(hmm, "CLASS_WORDS", 20)
    rows = hmm.score(docs, held_out(5), rounds=2, states=3).collect()
    counts = collections.Counter()
    for i, text, *_ in corpus():
        if not held(i):
            counts.update([*words_of(text, True), b""])
    total, kinds = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, text, *_ in corpus():
        tokens = [*words_of(text, True), b""]
        base = sum(np.log10((counts[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens)
        want[(i, held(i), len(tokens), sum(counts[t] > 0 for t in tokens), round(base, 4))] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4))
                               for r in rows) == want
    assert {r["train_tokens"] for r in rows} == {total}
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_training_raises_the_likelihood(docs):
    from watchloom.session import ship_package

    ship_package(docs.sparkSession)
    counts = hmm.word_counts(docs)
    known = hmm.lexicon(counts)
    given = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.lit(False).alias("held_out"), "text")
    rows = hmm.sequences(given, known).cache()
    model = hmm.first_model(known.class_counts, 3)
    seen = []
    for _ in range(4):
        model, likelihood = hmm.improved(rows, model, known.class_counts)
        seen.append(likelihood)
    assert seen[1] > seen[0] and seen[3] > seen[0]


# --- quality ----------------------------------------------------------------------------------

def test_base_counts(docs):
    for row in quality.judge(docs).collect():
        text = row["text"] or ""
        w = words_of(text)
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = set()
        for k in range(len(w) - 2):
            if grams[tuple(w[k : k + 3])] >= 2:
                cover |= {k, k + 1, k + 2}
        lines = [x for x in text.split("\n") if x.encode().split()]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        assert row["n_words"] == len(w) and row["word_chars"] == sum(len(x.decode()) for x in w)
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_repeat_words"] == len(cover) and row["base_failed"] == failed
        assert not (failed and row["kept"])


def test_line_rules():
    assert quality.line_fault("Home | About | Contact | Shop") == "navigation"
    assert quality.line_fault("*** ### $$$ a") == "symbols"
    assert quality.line_fault("We use cookies to improve your visit.") == "boilerplate"
    assert quality.line_fault("It was a fine day, and they went out to sea.") is None
    text, lost, repeats = quality.cleaned("a fine line of text\na fine line of text\nHome | About | Contact\nthe end")
    assert text == "a fine line of text\nthe end" and repeats == 1 and lost == 10


def test_a_clean_document_is_kept_and_a_page_of_menus_not(spark):
    clean = ". ".join(" ".join(prose(k, 12)) for k in range(9))
    menus = "\n".join(f"Home{k} | About{k} | Shop{k} | News{k} | Help{k} | More{k}" for k in range(20))
    rows = quality.judge(spark.createDataFrame([(1, clean), (2, menus)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["base_failed"], r["kept"]) for r in rows] == [(False, True), (False, False)]


# --- toxicity ---------------------------------------------------------------------------------

def test_toxicity_learns_and_spots_misspellings(spark):
    rng = random.Random(2)
    mean = ["loser", "stupid", "pathetic", "worthless"]
    texts, labels = [], []
    for k in range(400):
        w = prose(1000 + k, rng.randint(10, 120))
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(mean))
        texts.append(" ".join(w))
        labels.append(int(toxic))
    model = toxicity.train(pa.array(texts[:300]), np.array(labels[:300]))
    scores = model.scores(pa.array(texts[300:]))
    said = scores >= toxicity.THRESHOLD
    assert (said == np.array(labels[300:]).astype(bool)).mean() > 0.95
    odd = model.scores(pa.array(["you worthles looser", "", None, " ".join(prose(5, 4000)) + " stupid stupid loser"]))
    assert odd[0] > 0.7 and odd[1] == odd[2] < 0.7 and odd[3] > 0.7


def test_toxicity_without_labels(spark, docs):
    model = toxicity.fit(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    rows = toxicity.score(docs.withColumn("score", F.lit("x")), model).collect()
    assert {r["score"] for r in rows} == {0.0} and {r["predicted"] for r in rows} == {0}


# --- empty tables -----------------------------------------------------------------------------

def test_empty_tables(spark, tmp_path):
    from watchloom.llm.queries import held_out

    none = spark.createDataFrame([], SCHEMA)
    assert bytebpe.encoded(none).count() == 0
    tokenfiles.write(none, str(tmp_path / "none"))
    assert tokenfiles.read(spark, str(tmp_path / "none")).count() == 0
    assert quality.judge(none).count() == 0
    assert setsketch.groups(none).count() == 0 and setsketch.deduplicated(none).count() == 0
    assert substrings.dedup(none).count() == 0
    assert hmm.score(none, held_out(5), rounds=1).count() == 0
    model = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(none, model).count() == 0
    assert isinstance(pd.DataFrame(), pd.DataFrame)
