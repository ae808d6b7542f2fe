"""Vector search and collections (named queries)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from watchloom.functions import values as V
from watchloom.operators import context as C
from watchloom.operators import vectors as VX
from watchloom.plans.registry import query
from watchloom.session import scratch_path
from watchloom.sinks import tables as K
from watchloom.sources import files
from watchloom.sources import given as G

# Squared distance of every query (a fifth of the vectors) to every vector.
PAIRS = """
p as (select q.vec_id as query_id, q.vec_id % 20 as analysis_id, e.vec_id as match_id,
    list_sum(list_transform(list_zip(q.embedding, e.embedding),
    lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) as d
  from embeddings q, embeddings e where q.vec_id % 5 = 3),
r as (select *, row_number() over (partition by query_id order by d, match_id) as k from p)"""


def _queries(vectors):
    return vectors.filter(F.col("vec_id") % 5 == 3).withColumn("analysis_id", F.col("vec_id") % 20)


@query("knn_join", f"""
with {PAIRS} select query_id, match_id, round(d, 6) as distance, k::int as rank from r where k <= 5""")
def _(spark, sf_dir):
    vectors = G.vectors(spark, sf_dir)
    found = VX.knn_join(_queries(vectors), vectors, k=5)
    return found.withColumn("distance", F.round("distance", 6))


@query("threat_similarity", """
with q as (select vec_id as query_id, embedding as v from embeddings where vec_id % 50 = 7),
p as (select query_id, vec_id as match_id, 1 - list_sum(list_transform(list_zip(v, embedding), lambda z: z[1]::double * z[2]::double))
    / sqrt(list_sum(list_transform(v, lambda x: x::double * x::double)))
    / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as d from embeddings, q)
select query_id, match_id, round(d, 6) + 0.0 as distance
from (select *, row_number() over (partition by query_id order by d, match_id) as k from p) where k <= 5""")
def _(spark, sf_dir):
    vectors = G.vectors(spark, sf_dir)
    found = VX.threat_similarity(vectors, vectors.filter(F.col("vec_id") % 50 == 7), metric="cosine")
    # Adding 0.0 turns a negative zero into zero.
    return found.select("query_id", "match_id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query("context_search", f"""
with {PAIRS}, g as (
  select analysis_id, query_id, count(*) as results_count, round(avg(d), 6) as avg_relevance from r where k <= 2 group by 1, 2)
select *, sum(results_count) over (partition by analysis_id) > 5 as performance_limited from g""")
def _(spark, sf_dir):
    vectors = G.vectors(spark, sf_dir)
    _, effectiveness = VX.context_search(_queries(vectors), vectors, max_results=10)
    return effectiveness.withColumn("avg_relevance", F.round("avg_relevance", 6))


@query("context_documents", f"""
with {PAIRS}, c as (
  select *, row_number() over (partition by analysis_id order by query_id, k) as place from r where k <= 2)
select analysis_id, query_id, match_id, round(d, 6) as distance from c where place <= 5""")
def _(spark, sf_dir):
    vectors = G.vectors(spark, sf_dir)
    documents, _ = VX.context_search(_queries(vectors), vectors, max_results=10)
    return documents.select("analysis_id", "query_id", "match_id", F.round("distance", 6).alias("distance"))


# A model that SQL can repeat: how often each of these characters is in the text.
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _character_counts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: [float(text.count(c)) for c in CHARACTERS])


_COUNTS = ", ".join(f"length(document) - length(replace(document, '{c}', '')) as n_{c}" for c in CHARACTERS)
_SQUARES = " + ".join(f"(q.n_{c} - d.n_{c}) * (q.n_{c} - d.n_{c})" for c in CHARACTERS)


@query("search_text", f"""
with n as (select doc_id, document, {_COUNTS} from incident_docs),
p as (select q.doc_id as query_id, d.doc_id as match_id, d.document, {_SQUARES} as d from n q, n d where q.doc_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by d, match_id) as rank from p)
select query_id, rank::int as rank, d::double as distance, match_id, document from r where rank <= 5""")
def _(spark, sf_dir):
    """The five stored documents nearest to the text of every fiftieth one."""
    docs = G.incident_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "document")
    stored = VX.embed_documents(docs, model=_character_counts)
    found = VX.search_text(docs.filter(F.col("id") % 50 == 0), stored, model=_character_counts)
    return found.select("query_id", "rank", "distance", "match_id", "document")


@query("context_records", f"""
with n as (select doc_id, document, {_COUNTS} from incident_docs),
p as (select q.doc_id as query_id, q.document as query, d.doc_id as match_id, d.document, {_SQUARES} as d
  from n q, n d where q.doc_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by d, match_id) as rank from p),
a as (select *, query_id // 50 % 40 as analysis_id from r where rank <= 2),
b as (select *, row_number() over (partition by analysis_id order by query_id, rank) as place,
  count(*) over (partition by analysis_id) as original, max(query_id) over (partition by analysis_id) as last_query from a),
s as (select analysis_id, count(distinct query_id) as successful_searches from a group by 1),
k as (select *, lower(document) as t from b where place <= 5),
g as (select analysis_id, max(original) as original, count(*) as n,
  count(*) filter (contains(t, 'brute force') or contains(t, 'password attack')) as brute,
  count(*) filter (contains(t, 'data exfiltration')) as exfil,
  count(*) filter (contains(t, 'ssh')) as ssh, count(*) filter (contains(t, 'rdp')) as rdp, avg(d) as mean_distance,
  string_agg(match_id::varchar, ' ' order by place) as matches, string_agg(document, ' | ' order by place) as texts,
  string_agg(d::bigint::varchar, ' ' order by place) as distances,
  string_agg(replace(query, ' ', '_'), ' ' order by place) as tags, string_agg('doc_' || (rank - 1), ' ' order by place) as document_ids
  from k group by 1)
select g.analysis_id, n as total_documents_found, original as original_document_count, original > 5 as performance_limited,
  successful_searches,
  case when brute > 0 and brute >= exfil then 'Historical incidents show pattern of credential attacks with ' || brute || ' similar cases'
    when exfil > 0 then 'Historical incidents show pattern of data exfiltration with ' || exfil || ' similar cases'
    else '{V.MIXED_SUMMARY}' end as pattern_analysis,
  if(ssh > 0 and rdp > 0, '{V.VECTORS_CORRELATION}RDP attacks, SSH exploitation', '') as threat_correlations,
  '' as attack_progression_insights, if(brute > 0, '{V.CREDENTIAL_ACTION}', '{V.FALLBACK_ACTION}') as recommended_actions,
  case when mean_distance < 0.3 then 'high' when mean_distance < 0.7 then 'medium' else 'low' end as confidence_assessment,
  'Based on ' || n || ' historical incidents spanning multiple timeframes' as historical_timeline,
  matches, texts, distances, tags, document_ids
from g join s on g.analysis_id = s.analysis_id""")
def _(spark, sf_dir):
    """Forty analyses, whose searches are the texts of every fiftieth document."""
    docs = G.incident_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "document")
    stored = VX.embed_documents(docs, model=_character_counts)
    searches = docs.filter(F.col("id") % 50 == 0).select(
        F.col("id").alias("search_id"), F.expr("id div 50 % 40").alias("analysis_id"), F.col("document").alias("query")
    )
    records, _ = C.context_records(searches, stored, max_results=10, model=_character_counts)

    def joined(column, separator=" "):
        return F.array_join(column.cast("array<string>"), separator)

    several = ("threat_correlations", "attack_progression_insights", "recommended_actions")
    return records.withColumns({c: F.array_join(c, " | ") for c in several}).select(
        "*",
        joined(F.col("documents.match_id")).alias("matches"), joined(F.col("documents.document"), " | ").alias("texts"),
        joined(F.transform("documents.distance", lambda d: d.cast("bigint"))).alias("distances"),
        joined(F.flatten("documents.metadata.tags")).alias("tags"),
        joined(F.col("documents.metadata.document_id")).alias("document_ids"),
    ).drop("documents")


@query("collection_count", "select count(*) as records from embeddings")
def _(spark, sf_dir):
    return VX.collection_count(G.vectors(spark, sf_dir))


@query("scan_vectors", "select vec_id, label, len(embedding) as dimensions, round(embedding[1]::double, 6) as first from embeddings")
def _(spark, sf_dir):
    vectors = files.vector_collection(spark, f"{sf_dir}/embeddings.parquet")
    return vectors.select(
        "vec_id", "label", F.size("embedding").cast("bigint").alias("dimensions"),
        F.round(F.col("embedding")[0].cast("double"), 6).alias("first"),
    )


@query("embed_documents", """
select doc_id, 384::bigint as dimensions, 1.0::double as squared_length from incident_docs""")
def _(spark, sf_dir):
    embedded = VX.embed_documents(G.incident_docs(spark, sf_dir))
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return embedded.select(
        "doc_id", F.size("embedding").cast("bigint").alias("dimensions"),
        F.round(length, 4).alias("squared_length"),
    )


@query("sink_vectors", "select sha256(document) as id, document, 384::bigint as dimensions from incident_docs")
def _(spark, sf_dir):
    """Documents stored with their vectors and read back."""
    path = scratch_path(spark, "vectors")
    K.vector_rows(G.incident_docs(spark, sf_dir), "document").write.parquet(path)
    stored = files.vector_collection(spark, path)
    return stored.select("id", "document", F.size("embedding").cast("bigint").alias("dimensions"))
