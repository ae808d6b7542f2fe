"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (hashed to
a fixed table), so a misspelling that was never seen shares most of it. A window
of words is the mean of its word vectors; its class logits are linear in that
mean. A document is as toxic as its most toxic window, because a few insults in
a long text must not be diluted by the rest. Every window of the whole text is
looked at.

Given rows: a null or empty text has no window and gets the model's bias alone;
repeated rows are scored alike; null or missing labels teach nothing; without
any labelled row of either class the score is 0. Scores use the text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.llm.words import Words, mix, pieces
from watchloom.session import ship_package

WINDOW = 5  # words
NGRAMS = (3, 4, 5, 6)  # bytes of "<word>"
TABLE_BITS = 18
MAX_LABELLED = 5_000  # labelled rows that the classifier is fitted on, half of them of each class
THRESHOLD = 0.7


def subwords(words: list[bytes], bits: int = TABLE_BITS, chunk: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of the n-grams of each word: (slots, starts)."""
    parts = [_subwords(words[k : k + chunk], bits) for k in range(0, len(words), chunk)]
    counts = np.concatenate([np.diff(starts) for _, starts in parts])
    return np.concatenate([slots for slots, _ in parts]), np.concatenate([[0], np.cumsum(counts)])


def _subwords(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    texts = [b"<" + w + b">" for w in words]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    chars = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))  # bytes up to the word's end
    slots, owners = [], []
    for n in NGRAMS:
        size = max(0, len(chars) - n + 1)
        h = np.full(size, n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(1_099_511_628_211) + chars[j : j + size] + np.uint64(1)
        ok = left[:size] >= n
        slots.append((mix(h[ok]) >> np.uint64(64 - bits)).astype(np.int32))
        owners.append(owner[:size][ok])
    slots, owners = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(texts)))])
    return slots[order], starts


def means(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean of each slice; an empty slice gives 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    sizes = np.maximum(np.diff(starts), 1)
    sums = total[starts[1:]] - total[starts[:-1]]
    return sums / sizes.reshape(-1, *([1] * (values.ndim - 1)))


def windows(values: np.ndarray, starts: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Largest mean over ``width`` consecutive words of each text, and where it starts.

    A text of fewer words is one window. An empty text gives 0 and -1.
    """
    n = np.diff(starts)
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    best, at = np.zeros(len(n)), np.full(len(n), -1, dtype=np.int64)
    short = (n > 0) & (n < width)
    best[short] = (total[starts[1:][short]] - total[starts[:-1][short]]) / n[short]
    at[short] = starts[:-1][short]
    whole = np.flatnonzero(n >= width)
    if len(whole):
        mean = (total[width:] - total[:-width]) / width
        counts = n[whole] - width + 1
        ends = np.cumsum(counts)
        where = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(starts[:-1][whole], counts)
        picked = mean[where]
        best[whole] = np.maximum.reduceat(picked, ends - counts)
        hit = np.flatnonzero(picked == np.repeat(best[whole], counts))
        rows = np.searchsorted(ends, hit, side="right")
        first = np.unique(rows, return_index=True)
        at[whole[first[0]]] = where[hit[first[1]]]
    return best, at


@dataclass
class ToxicityModel:
    """``logit[s]``: what table slot s adds to the logit of "toxic" (embedding times class weights)."""

    logit: np.ndarray
    bias: float
    trained: bool

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        words = Words(texts, lower=True)
        if len(words.codes) == 0:
            best = np.zeros(len(texts))
        else:
            slots, starts = subwords(words.word_bytes())
            best, _ = windows(means(self.logit[slots], starts)[words.codes], words.starts)
        return 1.0 / (1.0 + np.exp(-np.clip(best + self.bias, -40, 40)))


def train(
    texts: pa.Array, labels: np.ndarray, dim: int = 12, epochs: int = 6, least_steps: int = 600, rate: float = 0.3,
    batch: int = 64, seed: int = 7,
) -> ToxicityModel:
    """Fits embeddings and softmax weights together by sparse Adagrad on cross-entropy.

    Few rows are gone through more often, until there were ``least_steps`` steps.
    """
    size = 1 << TABLE_BITS
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(np.zeros(size, np.float32), 0.0, False)
    rng = np.random.default_rng(seed)
    words = Words(texts, lower=True)
    slots, slot_starts = subwords(words.word_bytes())
    table = rng.uniform(-1.0 / dim, 1.0 / dim, (size, dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2)
    table_sq, out_sq, bias_sq = np.full(size, 1e-6, np.float32), np.full((dim, 2), 1e-6), np.full(2, 1e-6)
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    per_epoch = -(-len(labels) // batch)
    epochs = max(epochs, -(-least_steps // per_epoch))
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), batch):
            docs = order[k : k + batch]
            n = words.counts[docs]
            starts = np.concatenate([[0], np.cumsum(n)])
            at = np.arange(starts[-1]) - np.repeat(starts[:-1], n) + np.repeat(words.starts[docs], n)
            used, local = np.unique(words.codes[at], return_inverse=True)
            m = slot_starts[used + 1] - slot_starts[used]
            s0 = np.concatenate([[0], np.cumsum(m)])
            ids = slots[np.arange(s0[-1]) - np.repeat(s0[:-1], m) + np.repeat(slot_starts[used], m)]
            gap = out[:, 1] - out[:, 0]
            per_word = means((table @ gap)[ids], s0)[local]
            if epoch <= epochs // 8:  # the whole text first, the most toxic window once words have a tendency
                value, first, wide = means(per_word, starts), starts[:-1].copy(), n
            else:
                value, first = windows(per_word, starts)
                wide = np.minimum(n, WINDOW)
            p = 1.0 / (1.0 + np.exp(-np.clip(value + bias[1] - bias[0], -40, 40)))
            pull = (p - labels[docs]) * weight[docs] / len(docs)
            chosen = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(first, wide)
            coef = np.bincount(local[chosen], np.repeat(pull / np.maximum(wide, 1), wide), minlength=len(used))
            pulled = coef != 0
            active = np.repeat(pulled, m)
            g_gap = coef[pulled] @ means(table[ids[active]], np.concatenate([[0], np.cumsum(m[pulled])]))
            g_slot = np.repeat(coef / np.maximum(m, 1), m)[active]
            uniq, inv = np.unique(ids[active], return_inverse=True)
            g_slot = np.bincount(inv, g_slot, minlength=len(uniq))
            g_table = np.outer(g_slot, gap)
            table_sq[uniq] += (g_table**2).mean(axis=1)
            table[uniq] -= (rate * g_table / np.sqrt(table_sq[uniq])[:, None]).astype(np.float32)
            for column, sign in ((1, 1.0), (0, -1.0)):
                out_sq[:, column] += g_gap**2
                out[:, column] -= rate * 0.3 * sign * g_gap / np.sqrt(out_sq[:, column])
                bias_sq[column] += pull.sum() ** 2
                bias[column] -= rate * 0.3 * sign * pull.sum() / np.sqrt(bias_sq[column])
    return ToxicityModel((table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), True)


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Fits on at most ``max_labelled`` labelled rows, the same ones in every run.

    ``labels`` has ``doc_id`` and ``toxic``. Rows are chosen by the hash of their
    id, half of the bound from each class; one task learns from them, and only
    the model, whose size is fixed, reaches the driver.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("order", F.xxhash64("doc_id"))
    )
    half = max_labelled // 2
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("toxic") == value).orderBy("order", "doc_id").limit(half)
        chosen = part if chosen is None else chosen.unionAll(part)
    rows = (
        documents.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")
        .withColumn("order", F.xxhash64("doc_id", "text"))
        .orderBy("order", "doc_id").limit(max_labelled)
        .select("text", F.col("toxic").cast("long").alias("toxic"))
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("toxic", pa.int64())]))
        texts = table.column("text").cast(pa.large_string()).combine_chunks()
        model = train(texts, np.asarray(table.column("toxic").combine_chunks(), dtype=np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.logit.tobytes()]), pa.array([model.bias]), pa.array([model.trained])],
            ["logit", "bias", "trained"])

    ship_package(documents.sparkSession)
    found = rows.mapInArrow(learn, "logit binary, bias double, trained boolean").orderBy(F.desc("trained")).first()
    if found is None:
        return ToxicityModel(np.zeros(1 << TABLE_BITS, np.float32), 0.0, False)
    return ToxicityModel(np.frombuffer(found["logit"], dtype=np.float32), found["bias"], found["trained"])


def score(documents: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), row by row, without a shuffle.

    A column of the input that has one of the two names is replaced.
    """
    spark = documents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # 1 MB, fixed by TABLE_BITS
    given = documents.drop("score", "predicted")
    schema = T.StructType([*given.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 2 << 20):
            values = shared.value.scores(piece.column("text"))
            hit = (values >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(values), pa.array(hit)], [*piece.schema.names, "score", "predicted"]
            )

    return given.mapInArrow(run, schema)
