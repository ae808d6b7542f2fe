"""Spelling variants: near words found on a trie, level by level, as joins with its edge table.

Words are counted over all texts. The trie's edge table (parent, character,
child) is distributed; a node is the hash of its prefix, and a node below which
only one word is left carries that word (``tail``) and has no edges. A state of the
frontier is a word's prefix, the position in it, a node of the trie and the
edits so far; words of the same prefix share their states, so the prefix is a
node too (``a``) and the state says where a second word may be (``b``). States without
an edit are the nodes themselves. At each level they take one edit (another
character, or a further one in the second word), and states with an edit
follow the edges that both sides have, joined with the edge table. States whose
words both end have found neighbours. Only replaced characters in ascending
order and insertions into the longer word are followed, since the relation is
symmetric; every pair found is checked on its strings, so a hash that two
prefixes share adds nothing.

A node has at most as many edges as there are letters, so sibling pairs are
bounded, and no key is hot: words are distinct before the trie is built. There are as many levels
as the longest prefix that two words share.

Given rows: a null text has no run, a null id counts as empty text before the
colon; repeated rows count each time; a run's deletion may leave a word that
is too short, which is dropped; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.stored import removed, stored, written
from watchloom.llm.words import Words, pieces, whole
from watchloom.session import ship_package

LEAST_CHARS = 5
LEAST_COUNT = 3
MISSPELT = 97  # a run loses a character where this divides the hash of document and run
RATIO = 2  # a form is this many times as frequent as its variant
CHUNK = 64  # levels of the trie that are built at once

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LATIN = 0xC3  # first byte of U+00C0 to U+00FF, and of nothing else


def run_words(texts: pa.Array) -> Words:
    """Runs of A-Z, a-z and U+00C0 to U+00FF of each text, A-Z lower-cased."""
    texts = whole(pc.fill_null(whole(texts), "").cast(pa.large_string()))
    _, offsets, data = texts.buffers()
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    latin = raw == _LATIN
    latin[1:] |= raw[:-1] == _LATIN
    folded = np.where(latin, raw, _FOLD[raw])
    return Words(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(folded)]))


def run_counts(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(word, n): runs after their deletions, counted within each piece."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = run_words(piece.column("text"))
            chars = np.asarray(pc.utf8_length(words.vocabulary), dtype=np.int64)
            able = chars[words.codes] >= least_chars if len(chars) else np.zeros(0, bool)
            if not able.any():
                continue
            size = len(chars)
            key, n = np.unique(words.owners[able] * size + words.codes[able], return_counts=True)
            owner, code = key // size, key % size
            heads = [zlib.crc32(f"{'' if k is None else k}:".encode()) for k in piece.column("doc_id").to_pylist()]
            listed = words.word_bytes()
            crc = zlib.crc32
            h = np.fromiter((crc(listed[c], heads[o]) for o, c in zip(owner.tolist(), code.tolist())), np.int64, len(key))
            hit = np.flatnonzero(h % MISSPELT == 0)
            cut = []
            for k in hit.tolist():
                run = listed[code[k]].decode()
                at = int(h[k]) % len(run)
                cut.append(run[:at] + run[at + 1 :])
            n_whole = np.bincount(code, np.where(h % MISSPELT == 0, 0, n), minlength=size).astype(np.int64)
            used = np.flatnonzero(n_whole)
            kept = words.vocabulary.take(pa.array(used)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([kept, pa.array(cut, pa.string())]), pa.array(np.concatenate([n_whole[used], n[hit]]))],
                ["word", "n"],
            )

    ship_package(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(count, "word string, n long")


def vocabulary(documents: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    return (
        run_counts(documents, least_chars).groupBy("word").agg(F.sum("n").alias("n"))
        .where((F.col("n") >= least_count) & (F.length("word") >= least_chars))
    )


def _node(word: str, depth) -> F.Column:
    return F.xxhash64(F.substring(word, F.lit(1), depth))


def trie(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (depth of the child, parent, ch, child, tail, ends, parent_ends) below nodes that several words share.

    ``tail`` is the only word below the child; ``ends`` is the word that ends at a
    shared child, ``parent_ends`` the one that ends at the parent.
    """
    spark = words.sparkSession
    active = words.select("word", F.xxhash64("word").alias("id"))
    top = spark.range(1).select(F.lit(0).alias("depth"), F.xxhash64(F.lit("")).alias("child"), F.lit(None).cast("long").alias("end_id"))
    parts, first = [], 0
    while True:
        steps = (
            active.select("word", "id", F.explode(F.sequence(F.lit(first + 1), F.least(F.length("word"), F.lit(first + chunk)))).alias("depth"))
            .select("depth", _node("word", F.col("depth") - 1).alias("parent"), F.substring("word", F.col("depth"), F.lit(1)).alias("ch"),
                    _node("word", F.col("depth")).alias("child"), "id", F.when(F.length("word") == F.col("depth"), F.col("id")).alias("end_id"))
        )
        nodes = stored(
            steps.groupBy("depth", "parent", "ch", "child")
            .agg(F.count("*").alias("n"), F.max("id").alias("id"), F.max("end_id").alias("end_id")), "trie-nodes")
        above = top.unionByName(nodes.where("n > 1").select("depth", "child", "end_id"))
        above = above.select((F.col("depth") + 1).alias("depth"), F.col("child").alias("parent"), F.col("end_id").alias("parent_end_id"))
        parts.append(nodes.join(above, ["depth", "parent"]).select(
            "depth", "parent", "ch", "child", "parent_end_id",
            F.when(F.col("n") == 1, F.col("id")).alias("tail_id"), F.when(F.col("n") > 1, F.col("end_id")).alias("end_id")))
        top = nodes.where((F.col("n") > 1) & (F.col("depth") == first + chunk)).select("depth", "child", "end_id")
        if top.isEmpty():
            break
        first += chunk
        active = active.where(F.length("word") > first).withColumn("child", _node("word", F.lit(first))).join(
            top.select("child"), "child", "left_semi").drop("child")
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    for name in ("tail", "end", "parent_end"):
        side = words.select(F.xxhash64("word").alias(f"{name}_id"), F.col("word").alias(name))
        edges = edges.join(side, f"{name}_id", "left").drop(f"{name}_id")
    return stored(
        edges.withColumnsRenamed({"end": "ends", "parent_end": "parent_ends"}).repartitionByRange("depth", "parent"), "trie")


STATE = ["gap", "a", "a_tail", "a_ends", "b", "b_tail", "b_ends", "last"]


def _side(edges: DataFrame, side: str) -> DataFrame:
    """Edges under the names of one side of a state."""
    return edges.select(
        F.col("parent").alias(f"{side}_parent"), F.col("ch").alias(f"{side}_ch"), F.col("child").alias(f"{side}_to"),
        F.col("tail").alias(f"{side}_to_tail"), F.col("ends").alias(f"{side}_to_ends"), F.col("depth").alias(f"{side}_depth"))


def _arrived(side: str) -> list[F.Column]:
    return [F.col(f"{side}_to").alias(side), F.col(f"{side}_to_tail").alias(f"{side}_tail"), F.col(f"{side}_to_ends").alias(f"{side}_ends")]


def _followed(states: DataFrame, edges: DataFrame, level: int) -> DataFrame:
    """States one character further on both sides; ``level`` characters of the first word are behind."""
    none = F.lit(None).cast("string")
    on = F.col("a") == F.col("a_parent")
    moved = states.join(_side(edges.where(F.col("depth") == level + 1), "a"), on, "left")
    moved = moved.withColumns({
        "ch": F.coalesce("a_ch", F.substring("a_tail", level + 1, 1)),
        "a_to": F.coalesce("a_to", "a"), "a_to_tail": F.coalesce("a_to_tail", "a_tail"), "a_to_ends": F.coalesce("a_to_ends", none)})
    moved = moved.where((F.col("ch") != "") & (F.col("last").isNull() | (F.col("last") != F.col("ch"))))
    other = _side(edges.where(F.col("depth").isin(level + 1, level + 2)), "b")
    on = (F.col("b") == F.col("b_parent")) & (F.col("ch") == F.col("b_ch")) & (F.col("b_depth") == F.col("gap") + level + 1)
    moved = moved.join(other, on, "left").where(
        F.col("b_to").isNotNull() | (F.substring("b_tail", F.col("gap") + level + 1, F.lit(1)) == F.col("ch")))
    moved = moved.withColumns({"b_to": F.coalesce("b_to", "b"), "b_to_tail": F.coalesce("b_to_tail", "b_tail")})
    return moved.select("gap", *_arrived("a"), *_arrived("b"), none.alias("last"))


def _judged(states: DataFrame, level: int) -> DataFrame:
    """Adds the pair of words that end here, and whether the state can go on; others are left out."""
    one, two = F.coalesce("a_tail", "a_ends"), F.coalesce("b_tail", "b_ends")
    near = (F.length(two) == F.length(one) + F.col("gap")) & (F.levenshtein(one, two, 1) == 1)
    open_ = (
        ~(F.col("a_tail").isNotNull() & F.col("b_tail").isNotNull())
        & F.coalesce(F.length("a_tail") > level, F.lit(True))
        & F.coalesce(F.length("b_tail") > F.col("gap") + level, F.lit(True))
    )
    return (
        states.withColumns({"found": F.coalesce(near, F.lit(False)), "goes_on": open_})
        .where("found or goes_on")
        .withColumns({"word": F.when(F.col("found"), one), "near": F.when(F.col("found"), two)})
    )


def neighbours(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(word, near) in both directions, for distinct ``words``."""
    spark = words.sparkSession
    edges = trie(words, chunk)
    none = F.lit(None).cast("string")
    last = edges.agg(F.max("depth")).first()[0] or 0
    states, paths, old = None, [], None
    for level in range(last):
        here = edges.where(F.col("depth") == level + 1)
        replaced = (
            _side(here, "a").join(_side(here, "b"), F.col("a_parent") == F.col("b_parent")).where("a_ch < b_ch")
            .select(F.lit(0).alias("gap"), *_arrived("a"), *_arrived("b"), none.alias("last")))
        inserted = here.select(
            F.lit(1).alias("gap"), F.col("parent").alias("a"), none.alias("a_tail"), F.col("parent_ends").alias("a_ends"),
            F.col("child").alias("b"), F.col("tail").alias("b_tail"), F.col("ends").alias("b_ends"), F.col("ch").alias("last"))
        inserted = _judged(inserted, level)
        before = inserted.where("goes_on").select(*STATE)
        if states is not None:
            before = before.unionByName(states)
        created = _judged(_followed(before, edges, level).unionByName(replaced), level + 1)
        found = created.unionByName(inserted.where("found").withColumn("goes_on", F.lit(False)))
        path = written(found.select(*STATE, "word", "near", "found", "goes_on"), "frontier", "goes_on", "found")
        schema = found.select(*STATE, "word", "near").schema
        paths.append(path)
        if old:
            removed(spark, *(f"{old}/goes_on=true/found=false",))
        states = spark.read.schema(found.select(*STATE, "word", "near", "goes_on", "found").schema).parquet(path).where("goes_on").select(*STATE)
        old = path
    if not paths:
        return spark.createDataFrame([], "word string, near string")
    schema = "word string, near string, goes_on boolean, found boolean"
    found = None
    for path in paths:
        part = spark.read.schema(schema).parquet(path).where("found").select("word", "near")
        found = part if found is None else found.unionByName(part)
    both = found.unionByName(found.select(F.col("near").alias("word"), F.col("word").alias("near")))
    return both.distinct()


def variants(documents: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """One row per word: its count, near words, the form it is a variant of, and the last of its forms."""
    words = stored(vocabulary(documents, least_chars, least_count), "words")
    near = neighbours(words)
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("m"))
    best = near.join(counts, "near").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    formed = F.col("best.m") * -1 >= RATIO * F.col("n")
    rows = stored(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n")), "forms")
    # A form is at least twice as frequent, so a chain has fewer than 63 links: six doublings.
    jumps = rows.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(6):
        after = jumps.select(F.col("word").alias("root"), F.col("root").alias("after"))
        jumps = stored(
            jumps.select("word", "root").join(after, "root", "left")
            .select("word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")), "roots")
        if jumps.where("moved").isEmpty():
            break
    return rows.join(jumps.select("word", "root"), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
