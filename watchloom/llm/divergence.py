"""Source divergence audit: term counts by digest, strings brought back only for what is kept.

Terms are maximal runs of letters and of characters beyond ASCII, A-Z lower-cased.
Each task combines its texts to (lang, source, digest, count, documents) and
writes them beside the terms. Only the fixed-width columns are shuffled to be
summed. Strings are read again for digests that some language keeps, sieved by a
bitmap of fixed size: the least and the largest string of each digest. Where the
two differ, several terms share the digest; those digests alone are counted again
by term, and each of their terms gets a number (``split``). Strings are joined to
the final rows by (digest, split).

Kept terms of a language are compared in blocks by the hash of their digest: a
block is a matrix of terms and sources, from which each task sends one sum per
pair of sources and its highest-ranked terms. A hot language has as many blocks as
its terms fill, so no task grows with it.

Given rows: null text, lang and source count as empty strings; an empty text
has no term but its (lang, source) occurs; repeated rows are documents of
their own; an empty table gives no row; further columns are ignored. Ties of
values are ordered by the item's UTF-8 bytes. All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchloom.llm.stored import stored
from watchloom.llm.words import Words, pieces, whole
from watchloom.session import ship_package

LEAST_DOCUMENTS = 10  # of a language that hold a term which the language keeps
SCALE = 1_000_000_000
TOP = 10  # ranks of part "term"
DIGEST_BITS = 64
SIEVE_BITS = 25  # the bitmap of kept digests has 4 MB, whatever their number
BLOCK_TERMS = 4_096
PIECE_BYTES = 16 << 20

_FOLD = np.full(256, 0x20, np.uint8)  # what is in no term becomes a space
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def term_words(texts: pa.Array) -> Words:
    """Terms of each text. Every byte of a character beyond ASCII is 0x80 or more, so bytes decide."""
    texts = whole(pc.fill_null(whole(texts), "").cast(pa.large_string()))
    _, offsets, data = texts.buffers()
    folded = _FOLD[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    return Words(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(folded)]))


def digests(terms: list[bytes], bits: int = DIGEST_BITS) -> np.ndarray:
    """The first ``bits`` bits of each term's hash, as signed numbers."""
    found = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), dtype=np.uint64, count=len(terms))
    return (found >> np.uint64(64 - bits)).view(np.int64)


def partial_counts(documents: DataFrame, bits: int = DIGEST_BITS) -> DataFrame:
    """(lang, source, digest, term, n, docs), combined within each piece of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE_BYTES):
            words = term_words(piece.column("text"))
            size = len(words.vocabulary)
            if not size:
                continue
            names = [piece.column(k).dictionary_encode() for k in ("lang", "source")]
            lang, source = (np.asarray(x.indices, dtype=np.int64) for x in names)
            pair, group = np.unique(lang * len(names[1].dictionary) + source, return_inverse=True)
            key, n = np.unique(words.owners * size + words.codes, return_counts=True)  # a term of a document
            key, at = np.unique(group[key // size] * size + key % size, return_inverse=True)  # a term of a group
            at_pair, term = pair[key // size], key % size
            yield pa.RecordBatch.from_arrays(
                [
                    names[0].dictionary.take(pa.array(at_pair // len(names[1].dictionary))),
                    names[1].dictionary.take(pa.array(at_pair % len(names[1].dictionary))),
                    pa.array(digests(words.word_bytes(), bits)[term]),
                    words.vocabulary.take(pa.array(term)).cast(pa.string()),
                    pa.array(np.bincount(at, n).astype(np.int64)),
                    pa.array(np.bincount(at)),
                ],
                ["lang", "source", "digest", "term", "n", "docs"],
            )

    ship_package(documents.sparkSession)
    texts = documents.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in ("lang", "source", "text")))
    return texts.mapInArrow(count, "lang string, source string, digest long, term string, n long, docs long")


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy("lang", "source", *keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _by_term(rows: DataFrame, least: int) -> DataFrame:
    """Kept terms of each language, one row each, with the counts of its sources."""
    return (
        rows.groupBy("lang", "digest", "split")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
        .where(F.col("docs") >= least).drop("docs")
    )


def _sieve(digests_: DataFrame) -> np.ndarray:
    """Bits of the digests modulo 2 ** SIEVE_BITS, joined in the tasks; the driver gets at most 4 MB."""
    place = F.pmod(F.col("digest"), F.lit(1 << SIEVE_BITS)) + 1
    rows = digests_.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    sieve = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
    for row in rows.toLocalIterator():
        bits = np.frombuffer(bytes(row["bits"]), np.uint8)
        start = (row["bucket"] - 1) * 4096
        sieve[start : start + len(bits)] = bits[: len(sieve) - start]
    return sieve


def _strings(partial: DataFrame, digests_: DataFrame) -> DataFrame:
    """(digest, low, high): least and largest term of each of the digests."""
    shared = partial.sparkSession.sparkContext.broadcast(_sieve(digests_))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.asarray(batch.column(0), dtype=np.int64) & ((1 << SIEVE_BITS) - 1)
            found = batch.filter(pa.array((shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))
            yield from pa.Table.from_batches([found]).group_by(["digest", "term"]).aggregate([]).to_batches()

    found = partial.select("digest", "term").mapInArrow(sift, "digest long, term string")
    return (
        found.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))
        .join(digests_, "digest", "left_semi")
    )


def compare(batch: pa.Table, info: dict) -> Iterator[pa.RecordBatch]:
    """Sums of f for each pair of sources over a block of terms, and the highest f against the language.

    ``info``: the language's sources with their denominators, and its own denominator.
    """
    sources = pa.array(info["sources"], pa.string())
    below = np.array(info["below"], dtype=np.int64)
    cells = batch.column("cells").combine_chunks()
    flat = cells.flatten()
    row = np.asarray(pc.list_parent_indices(cells), dtype=np.int64)
    column = np.asarray(pc.index_in(flat.field("source"), sources), dtype=np.int64)
    n, total = (np.asarray(x, dtype=np.int64) for x in (flat.field("n"), batch.column("total").combine_chunks()))
    if len(total) and total.max() > 9_000_000_000:  # beyond 64 bits once multiplied
        n, total = n.astype(object), total.astype(object)
    p = np.tile(1 + 2 * SCALE // below, (len(batch), 1))
    p[row, column] = (1 + SCALE * (n + 2) // below[column]).astype(np.int64)
    q = (1 + SCALE * (total + 2) // info["lang_below"]).astype(np.int64)
    names, others, values = [], [], []
    for k in range(len(sources)):
        mine = p[:, k : k + 1]
        values.append(((p - mine) ** 2 // (p + mine)).sum(axis=0))
        names.append(np.full(len(sources), k))
        others.append(np.arange(len(sources)))
    names, others, values = map(np.concatenate, (names, others, values))
    keep = names != others
    lang = info["lang"]

    def rows(name, other, digest, split, value):
        size = len(value)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * size, pa.string()), sources.take(pa.array(name)), other, digest, split, pa.array(value, pa.int64())],
            ["lang", "source", "other", "digest", "split", "value"],
        )

    empty = pa.nulls(int(keep.sum()), pa.int64()), pa.nulls(int(keep.sum()), pa.int32())
    yield rows(names[keep], sources.take(pa.array(others[keep])), *empty, values[keep])
    mine, its = p[row, column], q[row]
    value = (mine - its) ** 2 // (mine + its)
    able = np.flatnonzero(mine > its)
    able = able[np.lexsort((-value[able], column[able]))]
    first = np.searchsorted(column[able], np.arange(len(sources)))
    tenth = np.minimum(first + TOP - 1, np.append(first[1:], len(able)) - 1)  # ties of the tenth stay
    bound = np.array([value[able[t]] if len(able) and f <= t < len(able) else 0 for f, t in zip(first, tenth)], np.int64)
    able = able[value[able] >= bound[column[able]]]
    yield rows(
        column[able], pa.nulls(len(able), pa.string()), batch.column("digest").combine_chunks().take(pa.array(row[able])),
        batch.column("split").combine_chunks().take(pa.array(row[able])), value[able],
    )


def audit(
    documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, digest_bits: int = DIGEST_BITS,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of each source from the other ones and from its language.

    Part ``pair`` has every other source of the language, part ``term`` the ten
    kept terms that speak most for the source against the language.
    """
    partial = stored(partial_counts(documents, digest_bits), "terms")
    numbers = stored(_summed(partial, "digest").withColumn("split", F.lit(0)), "term-counts")
    kept = stored(_by_term(numbers, least_documents), "kept-terms")
    strings = stored(_strings(partial, kept.select("digest").distinct()), "term-strings")
    shared = strings.where("low < high")
    names = strings.where("low = high").select("digest", F.lit(0).alias("split"), F.col("low").alias("term"))
    if not shared.isEmpty():  # several terms of one digest: these are counted by term
        apart = stored(_summed(partial.join(shared.select("digest"), "digest"), "digest", "term"), "shared-digests")
        order = F.row_number().over(Window.partitionBy("digest").orderBy("term"))
        split = stored(apart.select("digest", "term").distinct().withColumn("split", order), "split-terms")
        again = _by_term(apart.join(split, ["digest", "term"]).drop("term"), least_documents)
        kept = stored(kept.join(shared.select("digest"), "digest", "left_anti").unionByName(again), "kept-terms")
        names = names.unionByName(split.select("digest", "split", "term"))

    by_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    by_source = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    groups = documents.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in ("lang", "source"))).distinct()
    groups = stored(
        groups.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
        .select("lang", "source", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("n", "v", "lang_n"))), "groups")
    blocks = F.floor((F.col("v") - 1) / block_terms) + 1
    info = (
        groups.where("v > 0").groupBy("lang", "v", "lang_n")
        .agg(F.sort_array(F.collect_list(F.struct("source", (F.col("n") + 2 * F.col("v")).alias("below")))).alias("s"))
        .select("lang", blocks.alias("blocks"), F.col("s.source").alias("sources"), F.col("s.below").alias("below"),
                (F.col("lang_n") + 2 * F.col("v")).alias("lang_below"))
    )
    dealt = kept.join(info.select("lang", "blocks"), "lang").withColumn(
        "block", F.pmod(F.xxhash64("digest", "split"), F.col("blocks"))).drop("blocks")
    sides = info.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()),
                            ("digest", pa.int64()), ("split", pa.int32()), ("value", pa.int64())])
        if not left.num_rows:  # the hash left this block empty
            return schema.empty_table()
        return pa.Table.from_batches(list(compare(left, right.to_pylist()[0]))).cast(schema)

    ship_package(documents.sparkSession)
    found = stored(
        dealt.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block"))
        .applyInArrow(block, "lang string, source string, other string, digest long, split int, value long"),
        "term-blocks")

    here = groups.where("v = 0").select("lang", "source")
    pairs = (
        found.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
        .unionByName(here.join(here.withColumnRenamed("source", "other"), "lang").where("source <> other")
                     .withColumn("value", F.lit(0).cast("long")))
    )
    group = Window.partitionBy("lang", "source")
    best = found.where("other is null").withColumn("r", F.rank().over(group.orderBy(F.desc("value")))).where(F.col("r") <= TOP)
    terms = best.join(names, ["digest", "split"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = F.row_number().over(group.orderBy(F.desc("value"), "item")).alias("rank")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    return pairs.select("*", order).unionByName(terms.select("*", order).where(F.col("rank") <= TOP))
