"""Context research: the record of an analysis out of its searches of past incidents."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.functions import values as V
from watchloom.operators.detections import pattern_summary
from watchloom.operators.vectors import context_search, embed_documents
from watchloom.operators.views import document_metadata

METADATA = ("document_id", "source", "timestamp", "category", "tags", "additional_info")


def context_records(
    searches: DataFrame,
    collection: DataFrame,
    max_results: int = V.MAX_RESULTS_PER_SEARCH,
    metric: str = "l2",
    max_documents: int = V.MAX_DOCUMENTS,
    model: Callable[[pd.Series], pd.Series] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(records, effectiveness) of the searches ``search_id``, ``analysis_id`` and ``query`` (text).

    ``collection`` holds ``id``, ``document``, ``embedding`` and, if it has them, ``metadata`` (a map of
    texts or null) and ``tags_list``. A record is one row per analysis: counts before and
    after the cap of ``max_documents``, the patterns of the documents kept with a
    confidence by their distances, and ``documents``, an array of at most
    ``max_documents`` in the order found, each with its text, distance and metadata. An analysis
    whose searches find nothing has the record of a novel threat. Searches, which have no
    bound per analysis, are rows of ``effectiveness``. Searches without an analysis belong to no record.
    """
    vectors = embed_documents(
        searches.select(F.col("search_id").alias("id"), "analysis_id", "query"), "query", "embedding", model=model
    )
    kept, effectiveness = context_search(
        vectors, collection, max_results, metric, max_documents=max_documents, id_col="id", vec_col="embedding"
    )
    stored = collection.drop("embedding").withColumnRenamed("id", "match_id")
    asked = searches.select(F.col("search_id").alias("query_id"), "query")
    found = kept.join(stored, "match_id").join(asked, "query_id")
    if "metadata" not in collection.columns:
        found = found.withColumn("metadata", F.lit(None).cast("map<string, string>"))
    described = document_metadata(found.withColumn("position", F.col("rank") - 1), F.col("query"))
    of_analysis = searches.select("analysis_id").distinct().join(
        described.select(
            "analysis_id", "match_id", "distance", "document",
            F.struct(
                "query_id", "rank", "match_id", "document", "distance", F.struct(*METADATA).alias("metadata")
            ).alias("entry"),
        ),
        "analysis_id", "left",
    )
    listed = of_analysis.groupBy("analysis_id").agg(F.array_sort(F.collect_list("entry")).alias("documents"))
    counts = effectiveness.groupBy("analysis_id").agg(
        F.sum("results_count").alias("original_document_count"), F.count(F.lit(1)).alias("successful_searches")
    )
    patterns = pattern_summary(of_analysis, "distance", by=["analysis_id"], present="match_id")
    original = F.coalesce("original_document_count", F.lit(0).cast("bigint"))
    records = patterns.withColumnRenamed("documents", "total_documents_found").join(listed, "analysis_id").join(
        counts, "analysis_id", "left"
    ).select(
        "analysis_id",
        "total_documents_found",
        original.alias("original_document_count"),
        (original > max_documents).alias("performance_limited"),
        F.coalesce("successful_searches", F.lit(0).cast("bigint")).alias("successful_searches"),
        F.col("pattern_summary").alias("pattern_analysis"),
        F.col("correlations").alias("threat_correlations"),
        F.col("attack_patterns").alias("attack_progression_insights"),
        F.col("recommendations").alias("recommended_actions"),
        F.col("confidence").alias("confidence_assessment"),
        F.col("timeline_insights").alias("historical_timeline"),
        "documents",
    )
    return records, effectiveness
