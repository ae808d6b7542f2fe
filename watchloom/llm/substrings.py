"""Substring dedup by suffix automata of reference shards.

Every window of ``WINDOW`` words that also starts in a document with a smaller
id is removed, word by word. The corpus is its own reference, so reference
shards cannot be broadcast whole: their number grows with the corpus. Instead,
a shard is what may match at all, and documents are sent to the shards they can
match in:

1. In each window, the run of ``ANCHOR`` words of least hash is its anchor. Equal
   windows have equal anchors at equal places. Consecutive windows with one
   anchor form a fragment of at most ``2 * WINDOW - ANCHOR`` words.
2. Anchors that only one text holds are dropped; they match nothing.
3. The others' fragments are cut out of the texts. Equal fragments are one,
   with their least document. An anchor is a shard: its fragments, by rising
   document id, are streamed through a suffix automaton of those before them.
   The matching statistics tell where ``WINDOW`` words or more match, and the
   state of such a match knows the first document that holds it.
4. What matches an earlier document is removed from the texts.

An anchor in over ``HOT`` texts (a passage that a third of all documents share)
would be a hot shard: its fragments are cut into single windows, and each
different window is a shard of its own. Equal fragments are merged before the
shuffle. Copies of a whole text need no automaton: all but the ones with the
least id lose every word that a window covers.

Given rows: a null, empty or short text loses nothing; a document never counts
as earlier than another row of the same id; a row without an id loses nothing
and removes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.llm.stored import stored
from watchloom.llm.words import Words, pieces, run_hashes
from watchloom.session import ship_package

WINDOW = 13
ANCHOR = 5
HOT = 500


class Automaton:
    """Suffix automaton over words; ``first`` is the least document at each state.

    Texts must come by rising document.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [0]

    def _state(self, length: int, link: int, moves: dict, first: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def add(self, words: list, document: int) -> None:
        """Adds a text, from the root on."""
        last = 0
        for w in words:
            last = self._extend(last, w, document)

    def _extend(self, last: int, w: object, document: int) -> int:
        nxt, length, link = self.next, self.length, self.link
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, w)
        new = self._state(length[last] + 1, 0, {}, document)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return new

    def _clone(self, p: int, q: int, w: object) -> int:
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        self.link[q] = twin
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def firsts(self, words: list, window: int) -> list[int | None]:
        """For each window of a text the first document that holds it, by matching statistics."""
        nxt, length, link = self.next, self.length, self.link
        state, matched, out = 0, 0, []
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state, matched = nxt[state][w], matched + 1
            if i + 1 < window:
                continue
            if matched < window:
                out.append(None)
                continue
            while length[link[state]] >= window:  # the state of the last ``window`` words alone
                state = link[state]
                matched = length[state]
            out.append(self.first[state])
        return out


def fragments(words: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, text, first window, windows) of each fragment."""
    hashes = words.hashes()
    size = len(hashes) - window + 1
    if size <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    # The place, modulo 16, in the low bits: a minimum over a window tells where it is.
    runs = run_hashes(hashes, anchor)
    places = np.arange(len(runs), dtype=np.uint64)
    least = (runs & ~np.uint64(15)) | (places & np.uint64(15))
    width, span = 1, window - anchor + 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[:size], least[span - width : span - width + size])
    places = places[:size]
    place = places + ((least - places) & np.uint64(15))
    least >>= np.uint64(4)
    ends = np.repeat(words.starts[1:], words.counts)[:size]
    at = np.flatnonzero(np.arange(size) + window <= ends)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    owner = words.owners[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[at][1:] != place[at][:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(at)))
    return least[at[heads]], owner[heads], at[heads] - words.starts[:-1][owner[heads]], count


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def anchors(texts: DataFrame) -> DataFrame:
    """(anchor, key, start, windows) of the fragments of each text; a task does a text it saw before only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in pieces(batches, "text"):
            keys = piece.column("key").to_pylist()
            fresh = []
            for k, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    fresh.append(k)
            piece = piece.take(pa.array(fresh, pa.int64()))
            anchor, owner, start, count = fragments(Words(piece.column("text")))
            yield pa.RecordBatch.from_arrays(
                [signed(anchor), piece.column("key").take(pa.array(owner)), pa.array(start.astype(np.int32)),
                 pa.array(count.astype(np.int32))], ["anchor", "key", "start", "windows"])

    return texts.select("key", "text").mapInArrow(run, "anchor long, key long, start int, windows int")


def cut_out(texts: DataFrame) -> DataFrame:
    """Fragments (shard, fragment, key, doc_id, start, words) at ``spots`` of each text; hot ones by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            words = Words(piece.column("text"))
            names = words.word_bytes()
            flat = [names[c] for c in words.codes.tolist()]
            out: list[list] = [[], [], [], [], [], []]
            rows = zip(piece.column("key").to_pylist(), piece.column("doc_id").to_pylist(),
                       piece.column("spots").to_pylist(), words.starts[:-1].tolist())
            for key, doc_id, spots, begin in rows:
                for spot in spots:
                    units = [(spot["start"], spot["windows"])]
                    if spot["hot"]:
                        units = [(spot["start"] + i, 1) for i in range(spot["windows"])]
                    for start, windows in units:
                        text = b" ".join(flat[begin + start : begin + start + windows + WINDOW - 1])
                        number = xxhash.xxh3_64_intdigest(text) - 2**63
                        shard = number if spot["hot"] else spot["anchor"]
                        for column, value in zip(out, (shard, number, key, doc_id, start, text)):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], ["shard", "fragment", "key", "doc_id", "start", "words"])

    return texts.select("key", "doc_id", "spots", "text").mapInArrow(
        run, "shard long, fragment long, key long, doc_id long, start int, words binary")


def matched(distinct: DataFrame) -> DataFrame:
    """(shard, fragment, firsts): for each window of a fragment the first document that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton, pending = None, None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "fragment", "doc_id", "words")]
            answers = []
            for here, _, document, text in zip(*columns):
                words = text.split()
                windows = len(words) - WINDOW + 1
                if here != shard:
                    shard, automaton, pending = here, None, (words, document)
                    answers.append([document] * windows)
                    continue
                if automaton is None:  # the second fragment of this shard: now an automaton pays
                    automaton = Automaton()
                    automaton.add(*pending)
                found = [document if f is None else f for f in automaton.firsts(words, WINDOW)]
                if any(f == document for f in found):
                    automaton.add(words, document)
                answers.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("fragment"), pa.array(answers, pa.list_(pa.int64()))],
                ["shard", "fragment", "firsts"])

    ordered = distinct.repartition("shard").sortWithinPartitions("shard", "doc_id", "fragment")
    return ordered.select("shard", "fragment", "doc_id", "words").mapInArrow(
        run, "shard long, fragment long, firsts array<long>")


def stripped(texts: DataFrame, with_text: bool) -> DataFrame:
    """Removes what ``masks`` (window starts and bit masks) and ``copy`` (all windows) cover."""
    kept = [f for f in texts.schema.fields if f.name not in ("masks", "copy", "key")]
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
             T.StructField("kept_sha256", T.StringType())]
    if with_text:
        added.append(T.StructField("kept_text", T.StringType()))
    schema = T.StructType([*kept, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = Words(piece.column("text"))
            names = words.word_bytes()
            covered = np.zeros(len(words.codes) + 1, dtype=np.int64)
            rows = zip(piece.column("copy").to_pylist(), piece.column("masks").to_pylist(),
                       words.starts[:-1].tolist(), words.starts[1:].tolist())
            for copy, masks, begin, end in rows:
                if copy and end - begin >= WINDOW:
                    covered[begin] += 1
                    covered[end] -= 1
                elif not copy:
                    for mask in masks or ():
                        start, bits = begin + mask["start"], mask["mask"]
                        while bits:
                            low = (bits & -bits).bit_length() - 1
                            covered[start + low] += 1
                            covered[start + low + WINDOW] -= 1
                            bits &= bits - 1
            gone = np.cumsum(covered)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[words.starts[1:]] - total[words.starts[:-1]]
            keep = np.flatnonzero(~gone)
            cut = np.searchsorted(keep, words.starts)
            left = [names[c] for c in words.codes[keep].tolist()]
            joined = [b" ".join(left[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            columns = [pa.array(words.counts), pa.array(removed),
                       pa.array([hashlib.sha256(j).hexdigest() for j in joined], pa.string())]
            if with_text:
                columns.append(pa.array(joined, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*(piece.column(f.name) for f in kept), *columns], schema.names)

    return texts.mapInArrow(run, schema)


def dedup(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """Adds n_words, n_removed, kept_sha256 and, if wanted, kept_text (kept words, one space between).

    ``documents`` has ``doc_id`` and ``text``; other columns are handed through.
    Columns of the names added are replaced.
    """
    ship_package(documents.sparkSession)
    given = documents.drop("n_words", "n_removed", "kept_sha256", "kept_text", "masks", "copy", "key")
    keyed = given.withColumn("key", F.xxhash64("text"))
    known = keyed.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    copies = stored(known.groupBy("key").agg(F.min("doc_id").cast("long").alias("least")), "texts")
    shared = stored(
        anchors(known).groupBy("anchor").agg(F.min("key").alias("k"), F.max("key").alias("l"), F.count("*").alias("n"))
        .where("k <> l").select("anchor", (F.col("n") > HOT).alias("hot")),
        "anchors")
    spots = anchors(known).join(shared, "anchor").groupBy("key").agg(
        F.collect_set(F.struct("start", "windows", "anchor", "hot")).alias("spots"))
    speakers = known.select("key", F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        copies.join(spots, "key"), "key").where("doc_id = least")
    pieces_of = stored(cut_out(speakers), "fragments")
    distinct = pieces_of.groupBy("shard", "fragment").agg(F.min("doc_id").alias("doc_id"), F.first("words").alias("words"))
    firsts = stored(matched(distinct), "matches")
    bits = F.expr("""aggregate(transform(firsts, (f, i) -> if(f < doc_id, shiftleft(1, i), 0)), 0, (a, b) -> a | b)""")
    masks = (
        pieces_of.select("shard", "fragment", "key", "doc_id", "start").join(firsts, ["shard", "fragment"])
        .select("key", "start", bits.alias("mask")).where("mask <> 0")
        .groupBy("key").agg(F.collect_set(F.struct("start", "mask")).alias("masks"))
    )
    verdicts = stored(copies.join(masks, "key", "left"), "verdicts")
    joined = keyed.join(verdicts, "key", "left").withColumn(
        "copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    masks_here = F.when(F.col("doc_id") == F.col("least"), F.col("masks")).alias("masks")
    return stripped(joined.select(*given.columns, "key", "copy", masks_here), with_text)
