"""Sliced operators against brute force, with one key holding most of the rows."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchloom.operators import basics as B
from watchloom.operators import detections as D
from watchloom.operators import reports as R
from watchloom.operators import skew as S
from watchloom.operators import vectors as VX

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(600):
        key = "hot" if rng.random() < 0.5 else (None if rng.random() < 0.1 else f"k{rng.integers(5)}")
        # Whole minutes, so that times repeat.
        when = START + timedelta(minutes=int(rng.integers(0, 900)))
        out.append((i, key, when, bool(rng.random() < 0.6)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    df = spark.createDataFrame(rows, "id int, k string, t timestamp_ntz, hit boolean")
    return df.repartition(5)


def in_order(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[2], r[0])):
        groups.setdefault(row[1], []).append(row)
    return groups


def test_neighbours(frame, rows):
    got = {
        r["id"]: (r["p"], r["n"])
        for r in S.with_neighbours(frame, ["k"], "t", ["id"], "p", "n", slice_seconds=1800).collect()
    }
    want = {}
    for group in in_order(rows).values():
        for i, row in enumerate(group):
            want[row[0]] = (
                group[i - 1][2] if i else None, group[i + 1][2] if i + 1 < len(group) else None
            )
    assert got == want


@pytest.mark.parametrize("window", [0, 60, 1800, 7200])
def test_sliding_count(frame, rows, window):
    counted = S.with_sliding_count(frame, ["k"], "t", F.col("hit"), window, "n", slice_seconds=3600)
    got = {r["id"]: r["n"] for r in counted.collect()}
    want = {
        i: sum(1 for _, k2, t2, h in rows if h and k2 == k and t - timedelta(seconds=window) <= t2 <= t)
        for i, k, t, _ in rows
    }
    assert got == want


def test_a_hot_group_has_one_row_and_no_list(spark, sf_dir):
    from watchloom.sources import given as G

    rows = [("hot", f"f{i % 300:03d}") for i in range(3000)] + [("cold", "a"), ("cold", "b"), ("cold", "a")]
    ftp = spark.createDataFrame(rows, "id_orig_h string, arg string").selectExpr(
        "*", "timestamp_ntz'2024-01-01 05:10:00' as ts", "'s' as id_resp_h", "'STOR' as command")
    busy = {r["source_ip"]: (r["transfer_count"], r["file_count"])
            for r in R.ftp_activity(ftp, "2024-01-01 06:00:00", more_than=2).collect()}
    assert busy == {"hot": (3000, 300), "cold": (3, 2)}
    files = R.ftp_files(ftp, "2024-01-01 06:00:00", more_than=2)
    assert files.filter("source_ip = 'hot'").count() == 300 and files.filter("source_ip = 'cold'").count() == 2
    events = G.security_events(spark, sf_dir)
    steps = R.attack_steps(events, G.LAST_INSTANT, hours=720)
    for frame in (files, steps, D.triage_targets(events)):
        plan = frame._jdf.queryExecution().toString()
        assert "collect_list" not in plan and "collect_set" not in plan


def test_steps_are_in_order(spark, sf_dir):
    from watchloom.sources import given as G

    events = G.security_events(spark, sf_dir)
    sessions = {tuple(r[:3]): r["events_in_session"] for r in R.attack_timeline(events, G.LAST_INSTANT, hours=720).collect()}
    steps = {}
    for r in R.attack_steps(events, G.LAST_INSTANT, hours=720).collect():
        steps.setdefault(tuple(r[:3]), []).append((r["position"], r["time_dt"]))
    assert {k: len(v) for k, v in steps.items()} == sessions
    for rows in steps.values():
        rows.sort()
        assert [p for p, _ in rows] == list(range(1, len(rows) + 1))
        assert [t for _, t in rows] == sorted(t for _, t in rows)


@pytest.mark.parametrize("n", [0, 1, 37, 5000, 9999, 20000])
def test_keep_newest(spark, n):
    df = spark.range(0, 50000, 5).select((F.col("id") * 7 - 1000).alias("id"))
    kept = [r[0] for r in B.keep_newest(df, "id", n, ranges=16).collect()]
    assert sorted(kept, reverse=True) == sorted((7 * i - 1000 for i in range(0, 50000, 5)), reverse=True)[:n]


def test_keep_newest_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(5,), (5,), (5,), (1,), (None,), (None,)], "id bigint")
    for n, want in [(2, [5, 5]), (4, [1, 5, 5, 5]), (5, [1, 5, 5, 5, None]), (9, [1, 5, 5, 5, None, None])]:
        got = [r[0] for r in B.keep_newest(df, "id", n).collect()]
        assert sorted(got, key=lambda v: (v is None, v)) == want
    assert B.keep_newest(df.limit(0), "id", 3).collect() == []


def test_full_outer_with_repeats_and_nulls(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "x int, l string")
    right = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r"), (None, "s")], "y int, r string")
    got = B.full_outer(left, right, [("x", "y")]).select("x", "l", "y", "r").collect()
    want = left.join(right, F.col("x") == F.col("y"), "full_outer").select("x", "l", "y", "r").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("rows", [3, 1024])
def test_knn(spark, metric, rows):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(200, 4)).astype("float32")
    data[50] = data[10]  # equal distances
    df = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<float>"
    ).repartition(7)
    found = VX.knn_join(df.filter("vec_id < 9"), df, 6, metric, query_rows=rows, block_rows=rows)
    got = {(r["query_id"], r["rank"]): r["match_id"] for r in found.collect()}
    exact = data.astype("float64")
    want = {}
    for q in range(9):
        if metric == "l2":
            d = ((exact - exact[q]) ** 2).sum(axis=1)
        else:
            d = 1 - exact @ exact[q] / (np.linalg.norm(exact, axis=1) * np.linalg.norm(exact[q]))
        for rank, i in enumerate(sorted(range(200), key=lambda i: (d[i], i))[:6], 1):
            want[(q, rank)] = i
    same = sum(got[k] == want[k] for k in want)
    assert len(got) == len(want) and same >= len(want) - (0 if metric == "l2" else 6)


def test_knn_without_queries(spark):
    df = spark.createDataFrame([(1, [0.0])], "vec_id bigint, embedding array<float>")
    assert VX.knn_join(df.limit(0), df).collect() == []


def test_detections(spark):
    urls = ["/login?user=admin&pass=' UNION SELECT * FROM users--", "/search?q=' DROP TABLE users--",
            "/api?id=1' INSERT INTO admin VALUES('h')--", "/admin?cmd=cat /etc/passwd",
            "/upload?file=../../../etc/shadow", "/debug?eval=system('whoami')",
            "/app?q=SELECT password FROM users", "/s?term=%3Cscript%3E", "/description", "/plain", "/bad%zz?cmd"]
    http = spark.createDataFrame([(u, u) for u in urls], "uid string, uri string").selectExpr(
        "uid", "uri", "timestamp_ntz'2024-01-01' as ts", "'h' as id_orig_h")
    hits = {r["uid"] for r in D.detect_injection(http).collect()}
    assert set(urls) - hits == {"/upload?file=../../../etc/shadow", "/plain"}
    names = ["malware-c2.evil", "phishing.bad", "botnet.cmd", "data-exfil.evil", "c2.evil.example"]
    dns = spark.createDataFrame([(n, n) for n in names], "uid string, query string").selectExpr(
        "uid", "query", "timestamp_ntz'2024-01-01' as ts", "'h' as id_orig_h")
    assert [r["uid"] for r in D.detect_dns(dns).collect()] == ["c2.evil.example"]


@pytest.mark.parametrize(
    ("distance", "confidence"), [(0.29, "high"), (0.3, "medium"), (0.69, "medium"), (0.7, "low")]
)
def test_pattern_confidence(spark, distance, confidence):
    docs = spark.createDataFrame([("Brute force over SSH on a Linux server", distance)], "document string, d double")
    row = D.pattern_summary(docs, "d").first()
    assert row["confidence"] == confidence
    assert row["pattern_summary"].endswith("pattern of credential attacks with 1 similar cases")
    assert row["correlations"] == ["Cross-platform targeting: Linux systems, Server infrastructure"]


def test_pattern_without_documents(spark):
    row = D.pattern_summary(spark.createDataFrame([], "document string")).first()
    assert row["confidence"] == "low" and row["pattern_summary"].startswith("No historical incidents")
    assert row["recommendations"] == ["Treat as novel threat - implement enhanced monitoring"]
    assert row["correlations"] == [] and row["attack_patterns"] == []


def test_embedding(spark):
    docs = spark.createDataFrame([("a b c",), ("a b c",), ("",), (None,)], "document string")
    vectors = [r["embedding"] for r in VX.embed_documents(docs).collect()]
    assert {len(v) for v in vectors} == {384} and vectors[0] == vectors[1]
    plugged = VX.embed_documents(docs, model=_lengths)
    assert plugged.first()["embedding"] == [5.0]


def _lengths(texts):
    return texts.fillna("").map(lambda t: [float(len(t))])


def test_keep_newest_splits_rows_of_one_order_value(spark):
    df = spark.range(20_000).selectExpr("id", "7L as at", "map('k', id) as extra")
    kept = B.keep_newest(df, "at", 6_000)
    ids = [r["id"] for r in kept.select("id").collect()]
    assert len(ids) == len(set(ids)) == 6_000
    assert sorted(ids) == sorted(r["id"] for r in B.keep_newest(df.repartition(7), "at", 6_000).select("id").collect())
    # What is ranked in one task is one share of the hash, not the 20,000 rows.
    shares = df.groupBy(F.shiftrightunsigned(F.xxhash64("id", "at"), 64 - B.TIE_BITS)).count()
    assert shares.agg(F.max("count")).first()[0] < 50
    same = spark.range(50).selectExpr("1 as a", "2L as at")
    assert B.keep_newest(same, "at", 20).count() == 20 and B.keep_newest(same, "at", 60).count() == 50
    mixed = spark.range(100).selectExpr("id", "if(id < 90, null, id div 5) as at")
    assert sorted(r["id"] for r in B.keep_newest(mixed, "at", 5).collect()) == [95, 96, 97, 98, 99]
    assert B.keep_newest(mixed, "at", 12).filter("at is null").count() == 2
