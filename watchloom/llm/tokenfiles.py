"""Token ids as files: frequency-ranked numbers in byte-aligned variable-length coding.

A file covers a range of documents in ascending order and is a row of blocks.
A block holds about ``BLOCK_TOKENS`` ids (one longer document is a block of its
own). Its header lists the block's ids by falling frequency; ids are written as
their rank there. A rank takes one to four bytes. The number of bytes of each
rank stands apart from the ranks, as two bits in a control stream, four ranks to
a control byte, so that a decoder can look up the layout of four ranks at once.

The blocks are rows of Parquet files, so any store that Spark can write to takes
them, and a task that is run again replaces its file. ``part`` counts the files
and ``block`` the blocks of a file; together they give the order.

Given rows: documents are in order of ``doc_id`` with null first; rows of the
same id are in order of their text's hash. Null and empty texts have the end id
alone. An added token of the vocabulary that occurs in a text is encoded as its id, as
the tokenizers library does. An empty table gives an empty file set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.llm.bytebpe import VOCABULARY, codec
from watchloom.llm.words import pieces
from watchloom.session import ship_package

BLOCK_TOKENS = 1 << 19
END_ID = 2

# Layout of the four ranks of each control byte: their lengths, and their sum.
LENGTHS = np.stack([(np.arange(256) >> shift & 3) + 1 for shift in (0, 2, 4, 6)], axis=1)

BLOCKS = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("block", T.IntegerType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("n_tokens", T.ArrayType(T.LongType())),
    T.StructField("ranked_ids", T.BinaryType()),
    T.StructField("control", T.BinaryType()),
    T.StructField("data", T.BinaryType()),
])


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranked ids, control stream, rank bytes) of a block of ids."""
    count = np.bincount(ids)
    distinct = np.flatnonzero(count)
    order = distinct[np.lexsort((distinct, -count[distinct]))]
    place = np.zeros(len(count), dtype=np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    ranks = place[ids]
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    pad = -len(ranks) % 4
    bits = np.concatenate([size - 1, np.zeros(pad, np.uint8)]).astype(np.uint8).reshape(-1, 4)
    control = bits[:, 0] | bits[:, 1] << 2 | bits[:, 2] << 4 | bits[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < size[:, None]]
    return order.astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(ranked_ids: bytes, control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ids of a block; lengths come from a table with a row per control byte."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:count]
    at = np.cumsum(size) - size
    stream = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(3, np.uint8)])
    ranks = stream[at].astype(np.int64)
    for byte in range(1, int(size.max(initial=1))):
        more = size > byte
        ranks[more] |= stream[at[more] + byte].astype(np.int64) << (8 * byte)
    return np.frombuffer(ranked_ids, dtype="<u4")[ranks]


def write(documents: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID,
          block_tokens: int = BLOCK_TOKENS) -> None:
    """Encodes ``doc_id`` and ``text`` and writes the ids, each document followed by ``end_id``.

    One shuffle deals the documents to files by ranges of their id. Rows without
    an id, or with the same one, are told apart by the hash of their text, so
    that a third of all rows may share an id.
    """
    ship_package(documents.sparkSession)
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    pattern = public_tokenizers.PATTERN
    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    ordered = given.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, pattern, added=True)
        part, block = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            packed = pack(np.concatenate(ids))
            return pa.RecordBatch.from_pylist(
                [dict(zip(BLOCKS.names, (part, block, doc_ids, np.concatenate(sizes), *packed)))], schema=ARROW
            )

        for piece in pieces(batches, "text", 2 << 20):
            tokens, starts = coder.encode(piece.column("text"))
            n = np.diff(starts)
            with_end = np.full(len(tokens) + len(n), end_id, dtype=np.uint32)
            with_end[np.arange(len(tokens)) + np.repeat(np.arange(len(n)), n)] = tokens
            doc_ids += piece.column("doc_id").to_pylist()
            sizes.append(n + 1)
            ids.append(with_end)
            held += len(with_end)
            if held >= block_tokens:
                yield flush()
                block, held = block + 1, 0
                doc_ids, sizes, ids = [], [], []
        if held:
            yield flush()

    ordered.mapInArrow(run, BLOCKS).write.mode("overwrite").parquet(path)


ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
    ("ranked_ids", pa.binary()), ("control", pa.binary()), ("data", pa.binary()),
])

READ = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("ids", T.ArrayType(T.LongType())),
])


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document from the files: ``start`` counts the ids of all documents before it.

    Only a total per file comes together to place the files one after the other;
    within a file, blocks follow each other by a window over their totals.
    """
    from pyspark.sql import Window

    ship_package(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    total = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)
    sizes = blocks.select("part", "block", total.alias("total"))
    files = sizes.groupBy("part").agg(F.sum("total").alias("total"))
    before_file = files.select(
        "part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("file_start")
    )
    placed = sizes.join(before_file, "part").select(
        "part", "block",
        (F.col("file_start") + F.sum("total").over(Window.partitionBy("part").orderBy("block")) - F.col("total"))
        .alias("block_start"),
    )
    schema = T.StructType(READ.fields[: 5 if with_ids else 4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                n = np.array(row["n_tokens"], dtype=np.int64)
                ends = np.cumsum(n)
                ids = unpack(row["ranked_ids"], row["control"], row["data"], int(n.sum()))
                crc = [zlib.crc32(ids[e - m : e].tobytes()) for e, m in zip(ends.tolist(), n.tolist())]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["block_start"] + ends - n),
                           pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    starts = pa.array(np.concatenate([[0], ends]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(starts, pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return blocks.join(placed, ["part", "block"]).mapInArrow(run, schema)
