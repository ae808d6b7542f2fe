"""Quality: histogram gradient-boosted trees over document statistics, traversed as flat arrays.

Each document becomes a row of statistics of its whole text: counts of words,
lines and kinds of characters as shares, repetition of words, word pairs and lines,
the spread of word lengths, and the worst block of 32 consecutive words for the
shares that junk raises, since junk may fill only a part of a text. Trees are grown on
binned statistics by the logistic loss's gradients; a node's best split is read from
cumulative histograms. The grown trees are flattened: node k of a tree has its
feature, threshold and children in arrays, and all rows walk all trees together,
level by level, by array lookups.

Given rows: a null or empty text has zero statistics and gets the score these
have; repeated rows are scored alike; null or missing labels teach nothing;
without labelled rows of both classes every score is the share of label 1, 0
without any; an empty table gives no row. Scores use the text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.llm.words import Words, mix, pieces, run_hashes, whole
from watchloom.session import ship_package

MAX_LABELLED = 20_000  # labelled rows that the trees are fitted on, half of them of each class
THRESHOLD = 0.7
BINS = 64
BLOCK_WORDS = 32

# Kinds of bytes: their shares of a text, of its words and of its worst block are statistics.
KINDS = {
    "letter": [*range(ord("a"), ord("z") + 1)],
    "upper": [*range(ord("A"), ord("Z") + 1)],
    "digit": [*range(ord("0"), ord("9") + 1)],
    "beyond": [*range(0x80, 0x100)],
    "end": [*b".!?"],
    "exclaim": [*b"!"],
    "comma": [*b",;:"],
    "bar": [*b"|"],
    "symbol": [*b"#*$%&<>=+~^@_/\\{}[]"],
    "quote": [*b"\"'()-`"],
}
NAMES = list(KINDS)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def _longest_run(same: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Longest run of true values within each slice."""
    at = np.arange(len(same))
    since = np.maximum.accumulate(np.where(same, -1, at)) if len(same) else at
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    run = np.where(same, at - np.maximum(since, starts[owner] - 1), 0)
    return _slice_max(run, starts)


def _slice_max(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts) - 1)
    some = np.flatnonzero(np.diff(starts) > 0)
    if len(some):
        out[some] = np.maximum.reduceat(values, starts[some])
    return out


def _distinct(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each owner, and how often its commonest one comes."""
    _, codes = np.unique(keys, return_inverse=True)
    pair, counts = np.unique(owner * (codes.max() + 1 if len(codes) else 1) + codes, return_counts=True)
    whose = pair // (codes.max() + 1 if len(codes) else 1)
    most = np.zeros(n)
    np.maximum.at(most, whose, counts)
    return np.bincount(whose, minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    texts = whole(pc.fill_null(whole(texts), "").cast(pa.large_string()))
    n = len(texts)
    offsets = np.asarray(pa.Array.from_buffers(pa.int64(), n + 1, [None, texts.buffers()[1]]), dtype=np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    chars = np.maximum(np.diff(offsets), 1)
    words = Words(texts)
    size, count = np.maximum(words.counts, 1), words.counts
    space = np.isin(np.arange(256), [*b" \t\n\v\f\r"])[raw]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]) if len(raw) else np.zeros(0, bool))
    first = np.unique(np.concatenate([first, offsets[:-1][(np.diff(offsets) > 0)]]))
    first = first[~space[first]] if len(first) else first  # where words begin, text after text
    last = np.append(first[1:], len(raw)) if len(first) else first
    columns = [np.log1p(count), np.log1p(chars), count / chars]

    # Blocks of words, the last one of a text shorter; words of a text follow each other in ``first``.
    blocks = -(-count // BLOCK_WORDS)
    block_starts = _starts(blocks)
    owner = words.owners
    place = np.arange(len(words.codes)) - words.starts[owner]
    block = block_starts[owner] + place // BLOCK_WORDS
    block_size = np.maximum(np.bincount(block, minlength=block_starts[-1]), 1)

    def of_words(flag: np.ndarray) -> None:
        """Share of a text's words, and of the words of its worst block."""
        columns.append(_sums(flag, words.starts) / size)
        columns.append(_slice_max(np.bincount(block, flag, minlength=block_starts[-1]) / block_size, block_starts))

    kind_of = np.zeros(256, np.uint8)
    for k, name in enumerate(NAMES):
        kind_of[KINDS[name]] = k + 1
    kinds = kind_of[raw]
    held = {}
    for k, name in enumerate(NAMES):
        mask = kinds == k + 1
        total = np.concatenate([[0], np.cumsum(mask)])
        columns.append((total[offsets[1:]] - total[offsets[:-1]]) / chars)
        held[name] = total[last] - total[first] if len(first) else np.zeros(0, np.int64)
    for name in ("upper", "digit", "end", "exclaim", "comma", "bar", "symbol"):
        of_words(held[name] > 0)
    of_words((held["upper"] > 1) & (held["letter"] == 0))
    of_words((held["letter"] == 0) & (held["upper"] == 0) & (held["beyond"] == 0))
    table = np.asarray(pc.utf8_length(words.vocabulary), dtype=np.int64) if len(words.vocabulary) else np.zeros(1, np.int64)
    lengths = table[words.codes]
    mean = _sums(lengths, words.starts) / size
    columns += [mean, np.sqrt(np.maximum(_sums(lengths**2, words.starts) / size - mean**2, 0)), _slice_max(lengths, words.starts)]
    of_words(lengths == 1)
    of_words(lengths > 14)

    same = np.zeros(len(words.codes), bool)
    same[1:] = (words.codes[1:] == words.codes[:-1]) & (owner[1:] == owner[:-1])
    of_words(same)
    columns.append(_longest_run(same, words.starts))
    different, most = _distinct(owner, words.codes, n)
    columns += [different / size, most / size, different / np.sqrt(size)]
    hashes = mix(words.codes.astype(np.uint64))
    for width in (2, 4):
        keys = run_hashes(hashes, width)
        inside = owner[: len(keys)] == owner[width - 1 :] if len(keys) else np.zeros(0, bool)
        kept = owner[: len(keys)][inside]
        different, most = _distinct(kept, keys[inside], n)
        total = np.maximum(np.bincount(kept, minlength=n), 1)
        columns += [1 - different / total * (count >= width), most / total]
    pair_seen = np.zeros(len(words.codes), bool)  # words of a pair that its block holds already
    if len(words.codes) > 1:
        order = np.lexsort((np.arange(len(words.codes) - 1), run_hashes(hashes, 2), block[:-1]))
        again = (run_hashes(hashes, 2)[order][1:] == run_hashes(hashes, 2)[order][:-1]) & (block[order][1:] == block[order][:-1])
        pair_seen[order[1:][again]] = True
    of_words(pair_seen)

    lists = pc.split_pattern(texts, "\n")
    line_starts = np.asarray(lists.offsets, dtype=np.int64)
    lines = lists.flatten()
    line_owner = np.repeat(np.arange(n), np.diff(line_starts))
    full = np.asarray(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0), dtype=bool)
    code = np.asarray(pc.dictionary_encode(lines).indices, dtype=np.int64)
    n_lines = np.maximum(np.bincount(line_owner[full], minlength=n), 1)
    different, _ = _distinct(line_owner[full], code[full], n)
    long = np.asarray(pc.binary_length(lines), dtype=np.int64)
    columns += [np.log1p(n_lines), 1 - different / n_lines * (count > 0), _slice_max(long, line_starts) / chars, count / n_lines]
    ended = np.asarray(pc.match_substring_regex(lines, r"[.!?]\s*$"), dtype=bool)
    columns.append(np.bincount(line_owner[full & ended], minlength=n) / n_lines)
    return np.column_stack(columns).astype(np.float32)


@dataclass
class BoostedTrees:
    """Trees one after the other: ``left`` and ``right`` are places in the same arrays, a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def raw(self, rows: np.ndarray, step: int = 4_096) -> np.ndarray:
        """Sum of the leaves that each row reaches."""
        out = np.full(len(rows), self.base)
        if not len(self.roots):
            return out
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            line = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                at = np.where(part[line, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[k : k + step] += self.value[at].sum(axis=1)
        return out

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(rows), -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Upper bounds of the bins but the last, between values that occur."""
    found = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    return found[found < column.max()] if len(column) else found


def train(
    rows: np.ndarray, labels: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, least: int = 8,
    ridge: float = 2.0, bins: int = BINS, weights: np.ndarray | None = None,
) -> BoostedTrees:
    """Grows trees on histograms of binned statistics; each level of a tree is one pass over the rows."""
    weights = np.ones(len(labels)) if weights is None else weights
    share = float(np.clip((labels * weights).sum() / max(weights.sum(), 1e-12), 0, 1)) if len(labels) else 0.0
    empty = np.zeros(0, np.int32)
    if len(set(labels.tolist())) < 2:
        base = float(np.clip(np.log(max(share, 1e-17) / max(1 - share, 1e-17)), -40, 40))
        return BoostedTrees(empty, empty, np.zeros(0, np.float32), empty, empty, np.zeros(0), 0, base)
    base = float(np.log(share / (1 - share)))
    bounds = [_edges(rows[:, f], bins) for f in range(rows.shape[1])]
    binned = np.column_stack([np.searchsorted(b, rows[:, f], side="left") for f, b in enumerate(bounds)]).astype(np.int64)
    width = binned.shape[1] * bins
    flat = binned + np.arange(binned.shape[1]) * bins
    out = np.full(len(labels), base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-out))
        g, h = (p - labels) * weights, p * (1 - p) * weights
        roots.append(len(nodes))
        at = np.full(len(labels), len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        frontier = [len(nodes) - 1]
        for level in range(depth + 1):
            local = np.searchsorted(frontier, at)  # places of a level ascend
            inside = np.isin(at, frontier)
            mine, whose = np.flatnonzero(inside), local[inside]
            for k, node in enumerate(frontier):
                own = mine[whose == k]
                nodes[node][4] = -rate * g[own].sum() / (h[own].sum() + ridge)
            if level == depth:
                break
            key = (flat[mine] + whose[:, None] * width).ravel()
            shape = (len(frontier), binned.shape[1], bins)
            total = len(frontier) * width
            hist = [np.bincount(key, np.repeat(x[mine], binned.shape[1]), minlength=total).reshape(shape).cumsum(axis=2)
                    for x in (g, h, np.ones(len(labels)))]
            sums = [x[:, :1, -1:] for x in hist]
            sides = [(hist[0][..., :-1], hist[1][..., :-1]), (sums[0] - hist[0][..., :-1], sums[1] - hist[1][..., :-1])]
            gain = sum(a**2 / (b + ridge) for a, b in sides) - sums[0] ** 2 / (sums[1] + ridge)
            small = np.minimum(hist[2][..., :-1], sums[2] - hist[2][..., :-1]) < least
            gain = np.where(small, -1.0, gain).reshape(len(frontier), -1)
            best = gain.argmax(axis=1)
            after = []
            for k, node in enumerate(frontier):
                if gain[k, best[k]] <= 1e-9:
                    continue
                f, cut = divmod(int(best[k]), bins - 1)
                left, right = len(nodes), len(nodes) + 1
                nodes[node][:4] = [f, float(bounds[f][cut]), left, right]
                nodes += [[0, np.inf, left, left, 0.0], [0, np.inf, right, right, 0.0]]
                own = mine[whose == k]
                at[own] = np.where(binned[own, f] <= cut, left, right)
                after += [left, right]
            frontier = after
            if not frontier:
                break
        value = np.array([x[4] for x in nodes[roots[-1] :]])
        out += value[at - roots[-1]]
    feature, threshold, left, right, value = map(np.array, zip(*nodes))
    return BoostedTrees(
        np.array(roots, np.int32), feature.astype(np.int32), threshold.astype(np.float32), left.astype(np.int32),
        right.astype(np.int32), value.astype(float), depth, base)


def _array(kind: str) -> str:
    return f"array<{kind}>"


MODEL = ("roots array<int>, feature array<int>, threshold array<float>, left_ array<int>, right_ array<int>, "
         "value array<double>, depth int, base double")


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> BoostedTrees:
    """Fits on at most ``max_labelled`` labelled rows, the same ones in every run.

    ``labels`` has ``doc_id`` and ``quality``. Rows are chosen by the hash of
    their id, half of the bound from each class. Statistics are made where the
    texts are; one task learns from them, and only the trees reach the driver.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .withColumn("order", F.xxhash64("doc_id"))
    )
    half = max_labelled // 2
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("quality") == value).orderBy("order", "doc_id").limit(half)
        chosen = part if chosen is None else chosen.unionAll(part)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "quality")), "doc_id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 2 << 20):
            found = statistics(piece.column("text"))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel(), pa.float32()), found.shape[1])
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("quality"), flat.cast(pa.list_(pa.float32()))], ["doc_id", "quality", "row"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, marks = [], []
        for batch in batches:
            marks += batch.column("quality").to_pylist()
            cells += batch.column("row").to_pylist()
        if not marks:
            return
        model = train(np.array(cells, np.float32), np.array(marks))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.tolist()]) for x in (model.roots, model.feature, model.threshold, model.left, model.right, model.value)]
            + [pa.array([model.depth], pa.int32()), pa.array([model.base])],
            schema=pa.schema([(k, pa.list_(t)) for k, t in (
                ("roots", pa.int32()), ("feature", pa.int32()), ("threshold", pa.float32()), ("left_", pa.int32()),
                ("right_", pa.int32()), ("value", pa.float64()))] + [("depth", pa.int32()), ("base", pa.float64())]))

    ship_package(documents.sparkSession)
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, quality int, row {_array('float')}"
    described = rows.mapInArrow(describe, kind)
    described = described.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("row")).limit(max_labelled).select("quality", "row")
    found = described.mapInArrow(learn, MODEL).orderBy(F.size("roots").desc()).first()
    if found is None:
        return train(np.zeros((0, 1), np.float32), np.zeros(0, int))
    return BoostedTrees(
        *(np.array(found[k], t) for k, t in (
            ("roots", np.int32), ("feature", np.int32), ("threshold", np.float32), ("left_", np.int32), ("right_", np.int32),
            ("value", float))), found["depth"], found["base"])


def score(documents: DataFrame, model: BoostedTrees, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), row by row, without a shuffle.

    A column of the input that has one of the two names is replaced.
    """
    spark = documents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # a few thousand nodes
    given = documents.drop("score", "predicted")
    schema = T.StructType([*given.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 2 << 20):
            values = shared.value.scores(statistics(piece.column("text")))
            hit = (values >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(values), pa.array(hit)], [*piece.schema.names, "score", "predicted"])

    return given.mapInArrow(run, schema)
