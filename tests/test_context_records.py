"""Records of the context research: caps, distances, metadata, analyses without results."""

import pytest

from watchloom.operators import context as C
from watchloom.operators import detections as D


def _places(texts):
    return texts.map(lambda t: [float(len(t)), 0.0])


SEARCHES = "search_id long, analysis_id long, query string"
COLLECTION = "id long, document string, embedding array<double>, metadata map<string, string>, tags_list array<string>"


@pytest.fixture
def collection(spark):
    rows = [
        (1, "brute force over ssh", [5.0, 0.0], {"id": "INC-1", "source": "archive"}, ["old"]),
        (2, "Brute Force over RDP", [5.5, 0.0], None, None),
        (3, "lateral movement", [9.0, 0.0], {}, ["unused"]),
        (4, None, [12.0, 0.0], {"id": "INC-4"}, None),
        (5, "never found", None, None, None),
    ]
    return spark.createDataFrame(rows, COLLECTION)


def test_records(spark, collection):
    searches = [(10, 1, "five5"), (11, 1, "five5"), (12, 1, "five5"), (20, 2, "nine nine"), (30, 3, "twelve chars")]
    records, effectiveness = C.context_records(
        spark.createDataFrame(searches, SEARCHES), collection, max_results=9, model=_places
    )
    found = {r["analysis_id"]: r for r in records.collect()}
    one = found[1]
    assert (one["total_documents_found"], one["original_document_count"], one["performance_limited"]) == (5, 6, True)
    assert [(d["query_id"], d["match_id"], d["distance"]) for d in one["documents"]] == [
        (10, 1, 0.0), (10, 2, 0.25), (11, 1, 0.0), (11, 2, 0.25), (12, 1, 0.0)]
    assert one["pattern_analysis"].endswith("credential attacks with 5 similar cases")
    assert one["confidence_assessment"] == "high" and one["successful_searches"] == 3
    assert one["threat_correlations"] == ["Multiple attack vectors observed: RDP attacks, SSH exploitation"]
    first, second = (d["metadata"] for d in one["documents"][:2])
    assert (first["document_id"], first["source"], first["tags"]) == ("INC-1", "archive", ["old"])
    assert first["additional_info"].endswith("five5")
    assert (second["document_id"], second["source"], second["tags"]) == ("doc_1", "vector_database", ["five5"])
    two = found[2]
    assert two["original_document_count"] == 2 and not two["performance_limited"]
    assert {d["match_id"] for d in two["documents"]} == {3, 4} and two["confidence_assessment"] == "low"
    assert two["documents"][0]["metadata"]["tags"] == ["nine_nine"]
    assert found[3]["documents"][0]["document"] is None
    assert {r["query_id"]: r["results_count"] for r in effectiveness.collect()} == dict.fromkeys((10, 11, 12, 20, 30), 2)


def test_nothing_found_is_a_novel_threat(spark, collection):
    searches = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, None, "c")], SEARCHES)
    records, effectiveness = C.context_records(searches, collection.limit(0), model=_places)
    row = records.filter("analysis_id = 7").first()
    assert (row["total_documents_found"], row["original_document_count"], row["successful_searches"]) == (0, 0, 0)
    assert row["pattern_analysis"].startswith("No historical incidents") and row["documents"] == []
    assert row["confidence_assessment"] == "low" and effectiveness.count() == 0
    assert C.context_records(searches.limit(0), collection, model=_places)[0].count() == 0


def test_patterns_of_groups(spark):
    docs = spark.createDataFrame(
        [(1, "password attack", 0.1), (1, "privilege escalation", 0.2), (1, "PRIVILEGE escalation", 0.3), (2, "x", 0.5), (3, None, None)],
        "team long, document string, d double",
    )
    rows = {r["team"]: r for r in D.pattern_summary(docs, "d", by=["team"], present="d").collect()}
    assert rows[1]["pattern_summary"].endswith("privilege escalation with 2 similar cases")
    assert [rows[n]["confidence"] for n in (1, 2, 3)] == ["high", "medium", "low"]
    assert rows[2]["pattern_summary"].startswith("Mixed") and rows[3]["documents"] == 0
    assert rows[3]["recommendations"] == ["Treat as novel threat - implement enhanced monitoring"]
