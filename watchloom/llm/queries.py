"""Named queries of the operators for training data, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm import (
    boosting,
    bytebpe,
    divergence,
    hmm,
    mixing,
    quality,
    setsketch,
    spelling,
    substrings,
    tokenfiles,
    toxicity,
    vectordup,
    wrappers,
)
from watchloom.llm.oracles import ORACLES  # noqa: F401
from watchloom.session import scratch_path

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(parts: int, remainder: int = 1) -> F.Column:
    """True where crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == remainder


@query
def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(5))


@query
def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup(documents, with_text=False).drop("text")


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    digests = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bytebpe.encoded(documents, digests).select("doc_id", *digests)


@query
def op4_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return setsketch.groups(documents).drop("text_hash", "group")


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    tokenfiles.write(table(spark, sf_dir, "documents"), path)
    return tokenfiles.read(spark, path, with_ids=False)


@query
def op6_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op7_vector_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.links(table(spark, sf_dir, "embeddings"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.taken(documents).select("doc_id", "size", "source_size", "target", "taken", "shards")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(documents, with_text=False).drop("text")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").where(~held_out(3)))
    return toxicity.score(documents, model).select(
        "doc_id", held_out(3).alias("held_out"), "score", "predicted"
    )


@query
def op11_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = boosting.fit(documents, table(spark, sf_dir, "labels").where(~held_out(4, 2)))
    return boosting.score(documents, model).select(
        "doc_id", held_out(4, 2).alias("held_out"), "score", "predicted"
    )


@query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
