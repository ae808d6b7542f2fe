"""LM scoring with a hidden Markov language model.

Tokens are lower-cased words and one end per text. Every training word has
emission counts of its own per state. Those of the ``CLASS_WORDS`` most frequent
words and of the end, and one row for all words never seen, are the model that is
broadcast; those of all other words are a distributed table, which grows with the
corpus. Texts are dealt into chunks of about ``CHUNK_TEXT`` bytes and kept as
numbers of words; the table is dealt into parts by hash. Both know from the start
which of their words meet, so in each round arrays of single precision travel
between parts and chunks, and no words. So every text has an exact probability, up
to the single precision of these arrays.

Training is Baum-Welch over all training texts: each chunk runs the scaled
forward-backward recursion over its texts and sends expected counts, which are
summed per word. In training only, texts are cut into segments of ``SEGMENT``
tokens, which keeps the memory of the backward pass bounded; inner segments start
from a distribution of their own. Scoring runs the scaled forward recursion over
the whole text, and sums the unigram score out of the same numbers.

Given rows: a null or empty text is one end token; a null id counts as empty
text in the hold-out rule; rows that repeat are scored alike and learned from as
often as they come; without any training text all words are unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.stored import removed, stored, written
from watchloom.llm.words import Words, pieces
from watchloom.session import ship_package

STATES = 8
ROUNDS = 5
CLASS_WORDS = 16_384
KNOWN_WORDS = 200_000  # bound of the words whose counts are broadcast
LONGEST_KNOWN = 64  # bytes of a word that may be broadcast
SEGMENT = 256
CHUNK_TOKENS = 200_000  # taken at once in training
SCORED_TOKENS = 500_000  # taken at once in scoring: a step costs less the more texts it moves on
CHUNK_TEXT = 32 << 20  # bytes of text whose words share one list of words outside the classes
CHUNK_WORDS = 1_000_000  # a chunk ends at so many words of its list, too
PART_WORDS = 500_000  # words of chunks' lists that one part of the other words holds
PRIOR = 50.0  # tokens that the unigram shares count for in a state
UNIGRAM = 0.1  # share of the unigram in every state
END = ""  # no word is empty


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over a column ``text``; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = Words(piece.column("text"), lower=True)
            n = np.bincount(words.codes, minlength=len(words.vocabulary))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([words.vocabulary.cast(pa.string()), pa.array([END])]),
                 pa.array(np.append(n, piece.num_rows))], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What tasks know of the training words; its size is bounded by the constants above."""

    classes: dict[bytes, int]
    class_counts: np.ndarray  # the end, the class words, words never seen
    tokens: int
    words: int

    @property
    def base_log(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.words + 1)))


def lexicon(counts: DataFrame) -> Lexicon:
    """Totals and the most frequent words of a table of counts."""
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    top = (
        counts.where((F.octet_length("word") <= LONGEST_KNOWN) & (F.col("word") != END))
        .orderBy(F.desc("n"), "word").limit(min(CLASS_WORDS, KNOWN_WORDS)).toArrow()
    )
    names = top.column("word").cast(pa.binary()).to_pylist()
    n = np.asarray(top.column("n").combine_chunks(), dtype=np.int64) if names else np.zeros(0, np.int64)
    ends = counts.where(F.col("word") == END).agg(F.sum("n")).first()[0] or 0
    return Lexicon({w: i + 1 for i, w in enumerate(names)}, np.concatenate([[ends], n, [0]]), totals[0] or 0, totals[1])


SEQUENCES = "chunk long, row long, doc_id long, held_out boolean, n_tokens long, tokens binary, words array<binary>, n binary"


def sequences(documents: DataFrame, known: Lexicon) -> DataFrame:
    """Each text as numbers of words.

    Numbers from the number of classes on are places in the chunk's list of words,
    which stands in a row without ``row``: ``words`` and their counts ``n`` in the
    chunk's training texts.
    """
    shared = documents.sparkSession.sparkContext.broadcast(known)
    names = ["chunk", "row", "doc_id", "held_out", "n_tokens", "tokens", "words", "n"]

    def listed(chunk: int, places: dict[bytes, int], tally: np.ndarray) -> pa.RecordBatch:
        words = pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), pa.array(list(places), pa.binary()))
        nothing = (pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()))
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), *nothing, words, pa.array([tally[: len(places)].tobytes()], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        size = len(lex.class_counts)
        chunk, filled = TaskContext.get().partitionId() << 32, 0
        places: dict[bytes, int] = {}
        tally = np.zeros(0, dtype="<i8")
        zero = np.zeros(1, dtype="<u4")  # the end
        for piece in pieces(batches, "text"):
            if filled >= CHUNK_TEXT or len(places) >= CHUNK_WORDS:
                yield listed(chunk, places, tally)
                chunk, filled, places, tally = chunk + 1, 0, {}, np.zeros(0, dtype="<i8")
            filled += piece.column("text").nbytes
            words = Words(piece.column("text"), lower=True)
            number = np.fromiter(
                (lex.classes.get(w) or size + places.setdefault(w, len(places)) for w in words.word_bytes()),
                dtype="<u4", count=len(words.vocabulary))
            learned = ~np.asarray(piece.column("held_out").fill_null(True), dtype=bool)
            n = np.bincount(words.codes[np.repeat(learned, words.counts)], minlength=len(number))
            if len(places) > len(tally):
                tally = np.concatenate([tally, np.zeros(2 * len(places) - len(tally), dtype="<i8")])
            own = number >= size
            tally[number[own] - size] += n[own]
            tokens = number[words.codes]
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk] * piece.num_rows, pa.int64()),
                piece.column("row"), piece.column("doc_id"), piece.column("held_out"), pa.array(words.counts + 1),
                pa.array([packed(np.append(tokens[a:b], zero)) for a, b in zip(words.starts[:-1], words.starts[1:])], pa.binary()),
                pa.nulls(piece.num_rows, pa.list_(pa.binary())), pa.nulls(piece.num_rows, pa.binary()),
            ], names)
        if places:
            yield listed(chunk, places, tally)

    return documents.mapInArrow(run, SEQUENCES)


def merged(documents: DataFrame) -> DataFrame:
    """Partitions put together to about ``CHUNK_TEXT`` bytes of text: the fewer chunks hold a word, the less is sent of it."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return documents.coalesce(max(1, -(-size // CHUNK_TEXT)))


@dataclass
class Model:
    start: np.ndarray  # of texts
    inner: np.ndarray  # of segments inside a text, in training
    moves: np.ndarray
    emits: np.ndarray  # a row per class, the last one for words never seen
    total: np.ndarray | float = 1.0  # what scales the counts of words outside the classes, see ``own_emissions``
    seen: float = 0.0  # 0: their counts are first draws
    mass: float = 1.0


def first_shares(class_counts: np.ndarray, states: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return (class_counts + 0.5)[:, None] * rng.gamma(1.0, size=(len(class_counts), states))


def first_model(class_counts: np.ndarray, states: int = STATES, seed: int = 5, others: np.ndarray | float = 0.0) -> Model:
    """States that stay put and prefer words at random: what tells them apart grows in training.

    ``others`` is what the words outside the classes add to each state.
    """
    share = first_shares(class_counts, states, seed)
    moves = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(moves, 0.9)
    even = np.full(states, 1.0 / states)
    return Model(even, even, moves / moves.sum(axis=1, keepdims=True), share / (share.sum(axis=0) + others))


@dataclass
class Others:
    """The words outside the classes, dealt to parts by hash.

    Their counts per state travel as arrays: a part holds each of its words once
    and sends a chunk the rows of its words, a chunk sends back what it gathered.
    """

    routes: DataFrame  # see ROUTES
    path: str  # of the step that holds them
    parts: int
    mass: float  # sum of count + 0.5
    seen: float  # sum of count


def int_hash(value: int, seed: np.ndarray) -> np.ndarray:
    """xxhash64 of a 4-byte integer."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (seed + p5 + np.uint64(4)) ^ (np.uint64(value) * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def first_draws(hashes: np.ndarray, n: np.ndarray, states: int, seed: int = 5) -> np.ndarray:
    """Random first counts per state of words with these hashes and counts."""
    with np.errstate(over="ignore"):
        drawn = [int_hash(k, int_hash(seed, hashes)) & np.uint64(2**52 - 1) for k in range(states)]
    return (n + 0.5)[:, None] * -np.log((np.stack(drawn, axis=1) + 0.5) / 2.0**52)


# A row per part and chunk: places in the chunk's list (steps from one to the next) and in the part of the words seen
# in training, both packed, and how many they are. A row per part
# without chunk: their counts and hashes, and the sums over them of 1, counts and first draws.
ROUTES = "part int, chunk long, at binary, place binary, size long, n binary, hashes binary, sums array<double>"


def routed(rows: DataFrame, states: int) -> tuple[Others, np.ndarray]:
    """The words outside the classes, and the sums of their first draws."""
    listed = rows.select("chunk", "words", "n")
    total = listed.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = -(-total // PART_WORDS)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, n in zip(batch.column("chunk"), batch.column("words"), batch.column("n").to_pylist()):
                hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words.values.to_pylist()), dtype="<u8", count=len(words))
                part = (hashes >> np.uint64(32)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                used, first = np.unique(part[order], return_index=True)
                bounds = np.append(first, len(order))
                packed = [[x[order[a:b]].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                          for x in (np.arange(len(words), dtype="<u4"), np.frombuffer(n, dtype="<i8"), hashes)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(used.astype(np.int32)), pa.array([chunk.as_py()] * len(used), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.values.take(pa.array(order))),
                    *(pa.array(x, pa.binary()) for x in packed)], ["part", "chunk", "words", "at", "n", "hashes"])

    def numbered(table: pa.Table) -> pa.Table:
        """Sums the counts of each word of a part and drops words never seen."""
        words = pa.chunked_array(table.column("words").combine_chunks().flatten()).dictionary_encode().combine_chunks()
        code = np.asarray(words.indices, dtype=np.int64)
        n = np.zeros(len(words.dictionary), dtype="<i8")
        np.add.at(n, code, joined(table.column("n"), "<i8"))
        hashes = np.zeros(len(n), dtype="<u8")
        hashes[code] = joined(table.column("hashes"), "<u8")
        kept = n > 0
        place = np.cumsum(kept) - 1
        at, place, kept_here = joined(table.column("at"), "<u4"), place[code].astype("<u4"), kept[code]
        bounds = np.cumsum([0, *(len(x) // 4 for x in table.column("at").to_pylist())])
        spans = list(zip(bounds[:-1], bounds[1:]))
        n, hashes = n[kept], hashes[kept]
        sums = [float(len(n)), float(n.sum()), *first_draws(hashes, n, states).sum(axis=0).tolist()]
        size, part = len(spans), table.column("part")[0].as_py()
        none = [None] * size
        return pa.table([
            pa.array([part] * (size + 1), pa.int32()), pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
            pa.array([*(packed(np.diff(at[a:b][kept_here[a:b]], prepend=np.uint32(0))) for a, b in spans), None], pa.binary()),
            pa.array([*(packed(place[a:b][kept_here[a:b]]) for a, b in spans), None], pa.binary()),
            pa.array([*(int(kept_here[a:b].sum()) for a, b in spans), None], pa.int64()),
            *(pa.array([*none, x.tobytes()], pa.binary()) for x in (n, hashes)),
            pa.array([*none, sums], pa.list_(pa.float64()))], ["part", "chunk", "at", "place", "size", "n", "hashes", "sums"])

    dealt = listed.mapInArrow(split, "part int, chunk long, words array<binary>, at binary, n binary, hashes binary")
    path = written(dealt.groupBy("part").applyInArrow(numbered, ROUTES), "routes")
    routes = rows.sparkSession.read.schema(ROUTES).parquet(path)
    sums = routes.where("chunk is null").select(*(F.sum(F.col("sums")[k]) for k in range(states + 2))).first()
    kinds, seen, *drawn = (x or 0.0 for x in sums)
    return Others(routes, path, parts, seen + 0.5 * kinds, seen), np.array(drawn)


def joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Numbers of all cells of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


# The rows that a chunk gets of the words of a part.
SENT = "chunk long, part int, at binary, counts binary, n binary"


def sent_to_chunks(others: Others, gathered: str | None, states: int, with_n: bool) -> str:
    """Sums what chunks gathered (at first: draws) per word, sends chunks the rows of their words and returns the step's path."""
    spark = others.routes.sparkSession
    routes = others.routes.drop("sums").withColumn("counts", F.lit(None).cast("binary"))
    if gathered:
        back = spark.read.parquet(gathered).where("key is null")
        routes = routes.drop("hashes").unionByName(back.select("part", "chunk", "counts"), allowMissingColumns=True)

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = table.drop_columns("part").to_pylist()
        n, counts = (np.frombuffer(next(r["n"] for r in rows if r["n"] is not None), dtype="<i8"), {})
        if gathered:
            counts = {r["chunk"]: r["counts"] for r in rows if r["counts"] is not None}
            total = np.zeros((len(n), states))
        else:
            total = first_draws(np.frombuffer(next(r["hashes"] for r in rows if r["n"] is not None), dtype="<u8"), n, states)
        routes = {r["chunk"]: (r["at"], unpacked([r["place"]], np.array([r["size"]]))) for r in rows if r["place"] is not None}
        for chunk in sorted(counts):  # a chunk has a word once
            total[routes[chunk][1]] += np.frombuffer(counts[chunk], dtype="<f4").reshape(-1, states)
        total = total.astype("<f4")
        return pa.table([
            pa.array(list(routes), pa.int64()), pa.array([part] * len(routes), pa.int32()),
            pa.array([at for at, _ in routes.values()], pa.binary()),
            pa.array([total[place].tobytes() for _, place in routes.values()], pa.binary()),
            pa.array([n[place].tobytes() if with_n else None for _, place in routes.values()], pa.binary()),
        ], ["chunk", "part", "at", "counts", "n"])

    return written(routes.groupBy("part").applyInArrow(run, SENT), "sent-counts")


def by_chunk(rows: DataFrame, sent: str | None, run, schema) -> DataFrame:
    """``run(texts, words)`` per chunk: its texts and, per part, the counts of its words outside the classes."""
    both = rows.where("row is not null")
    if sent:
        both = both.unionByName(rows.sparkSession.read.schema(SENT).parquet(sent), allowMissingColumns=True)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        parted = ([], [])  # copies, so that no batch stays
        for batch in batches:
            texts = pc.is_valid(batch.column("row"))
            parted[0].append(batch.filter(texts).drop_columns(["at", "counts", "n"]))
            parted[1].append(batch.filter(pc.invert(texts)).select(["part", "chunk", "at", "counts", "n"]))
        yield from run(*(pa.Table.from_batches(x) for x in parted)).to_batches()

    return both.groupBy("chunk").applyInArrow(split, schema)


def own_emissions(model: Model, counts: np.ndarray) -> np.ndarray:
    """Emissions of words outside the classes out of their counts per state; a word's counts sum to its own count."""
    if not model.seen:
        return counts / model.total
    return smoothed(counts, counts.sum(axis=1, keepdims=True), model.total, model.seen, model.mass)


def chunk_model(model: Model, words: pa.Table) -> tuple[Model, list[np.ndarray]]:
    """The model with a row per listed word, and their places by part; other words emit as never seen."""
    if not words.num_rows:
        return model, []
    states = len(model.start)
    counted = [len(x.as_buffer()) // (4 * states) for x in words.column("counts")]
    places = [np.cumsum(unpacked([x], np.array([n]))) for x, n in zip(words.column("at").to_pylist(), counted)]
    size = len(model.emits)
    listed = max((int(x.max()) + 1 for x in places if len(x)), default=0)
    emits = np.empty((size + listed, states))
    emits[:size], emits[size:] = model.emits, model.emits[-1]
    for at, counts in zip(places, words.column("counts")):
        emits[size + at] = own_emissions(model, np.frombuffer(counts.as_buffer(), dtype="<f4").reshape(-1, states).astype(float))
    return replace(model, emits=emits), places


def chunk_tokens(texts: pa.Table, model: Model, unseen: int,
                 limit: int = CHUNK_TOKENS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, numbers of their words, lengths) of pieces of a chunk."""
    for batch in texts.to_batches():
        total = np.cumsum(batch.column("n_tokens").to_numpy())
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            piece = batch.slice(start, stop - start)
            lengths = piece.column("n_tokens").to_numpy()
            tokens = unpacked(piece.column("tokens").to_pylist(), lengths)
            yield piece, np.where(tokens < len(model.emits), tokens, unseen), lengths
            start = stop


class Layout:
    """Sequences side by side, longest first: ``step(t)`` is the slice of their t-th tokens."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, firsts: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        n = lengths[self.order]
        self.longest = int(n[0])
        self.active = np.searchsorted(-n, -np.arange(self.longest), side="left")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        rank = np.repeat(np.arange(len(n)), n)
        time = np.arange(len(rank)) - np.repeat(np.cumsum(n) - n, n)
        place = self.at[time] + rank
        self.classes = np.empty(len(rank), dtype=np.int64)
        self.classes[place] = tokens[np.repeat(firsts[self.order], n) + time]

    def step(self, t: int) -> slice:
        return slice(self.at[t], self.at[t + 1])


def forward_log(model: Model, tokens: np.ndarray, lengths: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each whole sequence."""
    lay = Layout(tokens, lengths, firsts)
    total = np.zeros(len(lengths))
    ones = np.ones(len(model.start))
    state = np.broadcast_to(model.start, (len(lengths), len(model.start)))
    for t in range(lay.longest):
        n = lay.active[t]
        state = (state[:n] @ model.moves if t else state) * model.emits[lay.classes[lay.step(t)]]
        scale = state @ ones
        state *= (1.0 / scale)[:, None]
        total[:n] += np.log(scale)
    out = np.empty(len(lengths))
    out[lay.order] = total
    return out


def expected(model: Model, tokens: np.ndarray, lengths: np.ndarray, firsts: np.ndarray,
             opening: np.ndarray, emits: np.ndarray | None = None,
             size: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of some segments: starts, inner starts, moves, emissions, log likelihood.

    Emissions are added to ``emits`` if given, whose first ``size`` rows are those of frequent words.
    """
    lay = Layout(tokens, lengths, firsts)
    emit = model.emits[lay.classes]
    states = emit.shape[1]
    alpha = np.empty_like(emit)
    scale, ones = np.empty(len(emit)), np.ones(states)
    state = np.where(opening[lay.order][:, None], model.start, model.inner)
    for t in range(lay.longest):
        s = lay.step(t)
        state = (state[: lay.active[t]] @ model.moves if t else state) * emit[s]
        scale[s] = state @ ones
        shrunk = (1.0 / scale[s])[:, None]
        state = np.multiply(state, shrunk, out=alpha[s])
        emit[s] *= shrunk
    moves = np.zeros((states, states))
    beta, back = np.ones((0, states)), np.ascontiguousarray(model.moves.T)
    for t in range(lay.longest - 1, -1, -1):
        s, n = lay.step(t), lay.active[t]
        full = beta
        if n > len(beta):
            full = np.ones((n, states))
            full[: len(beta)] = beta
        alpha[s] *= full  # the state's probability from here on: the step after has used alpha
        if t:
            onward = emit[s] * full
            moves += alpha[lay.step(t - 1)][:n].T @ onward
            beta = onward @ back
    if emits is None:
        emits = np.zeros_like(model.emits)
    add_counts(emits, lay.classes, alpha, size or len(emits))
    begin, is_open = alpha[: lay.active[0]], opening[lay.order]
    return (begin[is_open].sum(axis=0), begin[~is_open].sum(axis=0), model.moves * moves, emits, float(np.log(scale).sum()))


def add_counts(emits: np.ndarray, words: np.ndarray, gamma: np.ndarray, size: int) -> None:
    """Adds each row of ``gamma`` to its word's; rows from ``size`` on, which may be many, are touched only where needed."""
    states = gamma.shape[1]
    own = words >= size
    rare, some = words[own], gamma[own]
    if len(rare):
        words, gamma = words[~own], gamma[~own]
        np.add.at(emits.reshape(-1), (rare[:, None] * states + np.arange(states)).reshape(-1), some.reshape(-1))
    for k in range(states):
        emits[:size, k] += np.bincount(words, gamma[:, k], minlength=size)


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, most of them small, in about half of their bytes: all lowest bytes first, compressed."""
    return pa.Codec("zstd", 1).compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def unpacked(cells: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """The numbers of all cells."""
    codec = pa.Codec("zstd")
    planes = np.concatenate([np.zeros((4, 0), np.uint8), *(
        np.frombuffer(codec.decompress(x, 4 * n), dtype=np.uint8).reshape(4, -1) for x, n in zip(cells, lengths.tolist()) if n)], axis=1)
    return sum(plane.astype(np.int64) << (8 * k) for k, plane in enumerate(planes))


def segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, length, opens a text) of segments of at most ``SEGMENT`` tokens."""
    parts = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(len(lengths)), parts)
    within = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    firsts = (np.cumsum(lengths) - lengths)[text] + within * SEGMENT
    return firsts, np.minimum(SEGMENT, lengths[text] - within * SEGMENT), within == 0


def smoothed(expected, count, total, seen: float, mass: float):
    """Emissions out of expected counts of a state (arrays or columns); they sum to 1 over all words and one never seen.

    ``count`` is the word's own count, ``total`` the state's tokens and ``PRIOR``, ``seen`` all tokens, ``mass`` all
    counts with 0.5 each. A state's share is mixed with the unigram's, and each word counts 0.5 more at the scale of
    the whole corpus, as in the unigram score: a word never seen is as likely in every state as there.
    """
    share = (expected + count * (PRIOR / seen)) / total * (1 - UNIGRAM) + count * (UNIGRAM / seen)
    return (share * seen + 0.5) / mass


def improved(rows: DataFrame, model: Model, class_counts: np.ndarray) -> tuple[Model, float]:
    """A round in which all words outside the classes are taken as never seen."""
    model, path, likelihood = trained(rows, model, class_counts, None, None)
    removed(rows.sparkSession, path)
    return model, likelihood


def trained(rows: DataFrame, model: Model, class_counts: np.ndarray, others: Others | None,
            sent: str | None) -> tuple[Model, str, float]:
    """One round of Baum-Welch: (new model, step with the counts of other words, log likelihood under the old model).

    A chunk sends a row per class it met, some for the states, and an array per part for its other words.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    states = len(model.start)
    names = [f"s{k}" for k in range(states)]

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        base = shared.value
        size = len(base.emits)
        current, places = chunk_model(base, words)
        emitted = np.zeros_like(current.emits)
        sums = np.zeros((states + 4, states))
        for _, tokens, lengths in chunk_tokens(texts, current, size - 1):
            firsts, parts, opening = segments(lengths)
            # A long text has many segments: they too are taken in groups of bounded size.
            group = np.cumsum(parts) // CHUNK_TOKENS
            for g in np.unique(group):
                m = group == g
                start, inner, moves, _, likelihood = expected(current, tokens, parts[m], firsts[m], opening[m], emitted, size)
                sums[:states] += moves
                sums[states] += start
                sums[states + 1] += inner
                sums[states + 2, 0] += likelihood
        other = [emitted[size + at] for at in places]
        sums[states + 3] = sum((x.sum(axis=0) for x in other), np.zeros(states))
        # Listed words without a row of their own are words never seen.
        emitted[size - 1] += emitted[size:].sum(axis=0) - sums[states + 3]
        sums = np.concatenate([emitted[:size], sums])
        used = np.flatnonzero(sums.any(axis=1))
        return pa.table(
            [pa.array(np.append(used, np.zeros(len(other))).astype(np.int32), mask=np.arange(len(used) + len(other)) >= len(used)),
             *(pa.concat_arrays([pa.array(sums[used, k]), pa.nulls(len(other), pa.float64())]) for k in range(states)),
             pa.concat_arrays([pa.nulls(len(used), pa.int32()), words.column("part").combine_chunks().cast(pa.int32())]),
             pa.concat_arrays([pa.nulls(len(used), pa.int64()), words.column("chunk").combine_chunks().cast(pa.int64())]),
             pa.array([None] * len(used) + [x.astype("<f4").tobytes() for x in other], pa.binary())],
            ["key", *names, "part", "chunk", "counts"])

    schema = "key int, " + ", ".join(f"{n} double" for n in names) + ", part int, chunk long, counts binary"
    texts = rows.where(~F.col("held_out")).select("chunk", "row", "n_tokens", "tokens")
    path = written(by_chunk(with_columns(texts), sent, run, schema), "expected-counts")
    got = (rows.sparkSession.read.schema(schema).parquet(path).where("key is not null")
           .groupBy("key").agg(*(F.sum(n).alias(n) for n in names)).toArrow())
    size = len(model.emits)
    sums = np.zeros((size + states + 4, states))
    if got.num_rows:
        sums[got.column("key").to_numpy()] = np.stack([got.column(n).to_numpy() for n in names], axis=1)
    shared.unpersist()
    mass = float((class_counts + 0.5).sum()) + (others.mass if others else 0.0)
    seen = max(float(class_counts.sum()) + (others.seen if others else 0.0), 1.0)
    total = sums[:size].sum(axis=0) + sums[size + states + 3] + PRIOR
    emits = smoothed(sums[:size], class_counts[:, None], total, seen, mass)
    moves = sums[size : size + states] + 0.1
    start, inner = sums[size + states] + 0.1, sums[size + states + 1] + 0.1
    better = Model(start / start.sum(), inner / inner.sum(), moves / moves.sum(axis=1, keepdims=True), emits, total, seen, mass)
    return better, path, float(sums[size + states + 2, 0])


def with_columns(texts: DataFrame) -> DataFrame:
    """Texts with the columns of ``SENT``, which ``by_chunk`` may add rows of."""
    return texts.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (
        ("part", "int"), ("at", "binary"), ("counts", "binary"), ("n", "binary"))))


def scores(rows: DataFrame, model: Model, known: Lexicon, sent: str | None) -> DataFrame:
    """Each text's known tokens, unigram score and log10 of its probability."""
    shared = rows.sparkSession.sparkContext.broadcast((model, known.class_counts))
    kept = ["doc_id", "held_out", "n_tokens"]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, log_words double, score double"

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        base, class_counts = shared.value
        current, places = chunk_model(base, words)
        size = len(base.emits)
        counts = np.zeros(len(current.emits))
        counts[:size] = class_counts
        for at, n in zip(places, words.column("n").to_pylist()):
            counts[size + at] = np.frombuffer(n, dtype="<i8")
        logs = np.log10(counts + 0.5)
        got = [[np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
        for _, tokens, lengths in chunk_tokens(texts, current, size - 1, SCORED_TOKENS):
            firsts = np.cumsum(lengths) - lengths
            got[0].append(np.add.reduceat(counts[tokens] > 0, firsts, dtype=np.int64))
            got[1].append(np.add.reduceat(logs[tokens], firsts))
            got[2].append(forward_log(current, tokens, lengths, firsts) / np.log(10))
        return pa.table([*(texts.column(c) for c in kept), *(pa.array(np.concatenate(x)) for x in got)],
                        [*kept, "n_known", "log_words", "score"])

    texts = with_columns(rows.select("chunk", "row", *kept, "tokens"))
    return by_chunk(texts, sent, run, schema)


def score(documents: DataFrame, held_out: Column, rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """Trains on rows of ``documents`` (doc_id, text) that are not held out and scores all of them."""
    ship_package(documents.sparkSession)
    spark = documents.sparkSession
    given = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                             held_out.alias("held_out"), "text")
    counted = written(word_counts(given.where(~F.col("held_out"))), "word-counts")
    known = lexicon(spark.read.parquet(counted))
    removed(spark, counted)
    path = written(sequences(merged(given), known).withColumn("listed", F.col("row").isNull()), "sequences", "listed")
    rows = spark.read.schema(SEQUENCES + ", listed boolean").parquet(path)
    texts = rows.where(~F.col("listed")).drop("words", "n", "listed")
    others, drawn = routed(rows.where("listed"), states)
    removed(spark, f"{path}/listed=true")
    model = first_model(known.class_counts, states, others=drawn)
    model.total = first_shares(known.class_counts, states, 5).sum(axis=0) + drawn
    gathered = sent = None
    for k in range(rounds + 1):
        sent = sent_to_chunks(others, gathered, states, with_n=k == rounds) if others.parts else None
        if gathered:
            removed(spark, gathered)
        if k < rounds:
            model, gathered, _ = trained(texts, model, known.class_counts, others, sent)
            if sent:
                removed(spark, sent)
    scored = stored(scores(texts, model, known, sent), "scores")
    removed(spark, path, others.path, *([sent] if sent else []))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("log_words") - F.col("n_tokens") * known.base_log).alias("base_score"),
        "score",
    )
