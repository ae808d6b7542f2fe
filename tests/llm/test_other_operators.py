"""Vectors, pages, mixing, components and the pipeline."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchloom.llm import mixing, vectordup, wrappers
from watchloom.llm.components import components

# --- components -------------------------------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(60)] + [(500, 100 + k) for k in range(40)] + [(7, 7), (900, 901), (901, 900), (900, 901)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(61)} | {100 + k: 100 for k in range(40)} | {500: 100, 900: 900, 901: 900}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- vectors ----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors() -> list[tuple]:
    rng = np.random.default_rng(5)
    rows = [(1, None, 1), (2, [], 1), (3, [0.0] * 8, 1), (4, [1.0] + [float("nan")] * 7, 1), (5, [None] + [1.0] * 7, 1),
            (6, [float("inf")] * 8, 1), (7, [1.0] * 8, None), (8, [1.0] * 8, 1), (9, [2.0] * 8, 1), (9, [2.0] * 8, 1),
            (10, [1.0] * 6, 1), (None, [1.0] * 8, 1), (11, [-1.0] * 8, 1)]
    centre = rng.normal(size=16)
    for k in range(60):
        rows.append((100 + k, (centre + rng.normal(size=16) * 0.12).tolist(), k % 2))
    for k in range(40):
        rows.append((200 + k, rng.normal(size=16).tolist(), 0))
    return rows


def brute_links(rows: list[tuple], threshold: float) -> collections.Counter:
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, np.float32).astype(float)
        return a / np.linalg.norm(a)

    units = [unit(v) if label is not None else None for _, v, label in rows]
    near = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            x, y = units[a], units[b]
            if x is not None and y is not None and len(x) == len(y) and rows[a][2] == rows[b][2] and x @ y >= threshold:
                near[a].append(b)
                near[b].append(a)
    out = collections.Counter()
    for k, row in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for other in near[todo.pop()]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        ids = [rows[s][0] for s in seen if rows[s][0] is not None]
        out[(row[0], len(near[k]), min(ids) if ids else None)] += 1
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_vector_links(spark, monkeypatch, block):
    monkeypatch.setattr(vectordup, "BLOCK", block)
    frame = spark.createDataFrame(vectors(), VECTORS).withColumn("n_links", F.lit("x"))
    got = collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in vectordup.links(frame).collect())
    assert got == brute_links(vectors(), 0.98)


def test_no_vectors(spark):
    assert vectordup.links(spark.createDataFrame([], VECTORS)).count() == 0


def test_estimates_are_centred_and_bounded():
    rng = np.random.default_rng(2)
    units = rng.normal(size=(300, 64))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    upper = vectordup.bounds(units, vectordup.rotations(64), units[:40])
    assert (upper >= units[:40] @ units.T).mean() > 0.999


# --- pages ------------------------------------------------------------------------------------


def page(title: str, paragraphs: list[str], extra: str = "", tail: str = "") -> str:
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='<p>no</p>';</script></head><body>"
            f"<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy <b>now</b></div>{extra}"
            f"<article><h1>{title}</h1>{body}</article>{tail}<footer>&copy; us</footer></body></html>")


def test_main_text_of_articles(spark):
    rows = [
        (1, "https://A.example.com/x", page("T &amp; one", ["first  <b>bold</b>\n text", "second"])),
        (2, "http://a.example.com:80/y", page("Two", ["p1", "p2", "p3"], extra="<div id='cookie-notice'>Cookies!</div>")),
        (3, "http://a.example.com/z", page("Three", ["only"], tail="<section class='comments'><p>Nice!</p></section>")),
        (4, None, None), (5, "", ""), (6, "not a url", "just text"),
        (7, "http://b.example.com/", "<article><h1>H<p>open <i>tags<br>here<p>next<ul><li>a<li>b</ul>"),
        (7, "http://b.example.com/", "<article><h1>H<p>open <i>tags<br>here<p>next<ul><li>a<li>b</ul>"),
        (8, "http://c.example.com/", "<div class='top'><a href=x>l</a></div><div class='story'><p>" + "long text " * 30
         + "</p><p>more text here</p><form>Name <input></form></div><div class='sidebar'>side</div>"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x"))
    got = collections.defaultdict(list)
    for r in wrappers.extract(frame).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[1] == ["T & one\n\nfirst bold text\n\nsecond"]
    assert got[2] == ["Two\n\np1\n\np2\n\np3"]
    assert got[3] == ["Three\n\nonly"]
    assert got[4] == [""] and got[5] == [""] and got[6] == ["just text"]
    assert got[7] == ["H\n\nopen tags here\n\nnext\n\na\n\nb"] * 2
    assert got[8] == [("long text " * 30).strip() + "\n\nmore text here"]


def test_no_pages(spark):
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_get_optional_and_repeated_groups():
    a = wrappers.skeleton(wrappers.parse("<div><h2>x</h2><p>1</p><p>2</p></div>"))
    b = wrappers.skeleton(wrappers.parse("<div><h2>x</h2><table><tr><td>c</table><p>1</p></div>"))
    both = wrappers.merged(a, b)[wrappers.KIDS][0][wrappers.KIDS]
    assert [(n[0], n[1], n[2]) for n in both] == [("h2", False, False), ("table", True, False), ("p", False, True)]
    pairs = wrappers.skeleton(wrappers.parse("<dl>" + "<dt>t</dt><dd>d</dd>" * 5 + "</dl>"))[wrappers.KIDS][0]
    assert [(n[0], n[2]) for n in pairs[wrappers.KIDS]] == [("dt", True), ("dd", True)]


def test_very_deep_and_very_wide_pages():
    deep = wrappers.main_text("<div>" * 5000 + "deep" + "</div>" * 5000, None)
    assert deep == "deep"
    wide = "<article>" + "".join(f"<p>{k}</p><h3>{k}</h3><div class='c{k}'>{k}</div>" for k in range(2000)) + "</article>"
    assert len(wrappers.main_text(wide, None).split("\n\n")) == 6000


# --- mixing -----------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def mixing_rows() -> list[tuple]:
    rng = random.Random(1)
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", None), (3, "w " * 700, "en", None, None), (3, "w " * 700, "en", None, None),
            (None, "x y z", "en", "b", None), (4, "only", "en", "tiny", None), (5, "big " * 9000, "en", "a", None)]
    for k in range(300):
        source = "hot" if k % 3 else rng.choice(["a", "b", "c", "é"])
        rows.append((10 + k, " ".join(f"w{k}_{j}" for j in range(rng.randint(1, 900))), "en", source, None))
    return rows


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, goal, target = set(order), 1.5 * sum(sizes.values()), {}
    while left:
        over = [s for s in left if goal * weight[s] / sum(weight[x] for x in left) > 2 * sizes[s]]
        if not over:
            total = sum(weight[x] for x in left)
            return target | {s: goal * weight[s] / total for s in left}
        for s in over:
            target[s] = 2.0 * sizes[s]
            goal -= target[s]
            left.remove(s)
    return target


def test_mixing(spark):
    rows = mixing_rows()
    frame = spark.createDataFrame(rows, DOCS)
    got = mixing.taken(frame.repartition(3)).collect()
    assert len(got) == len(rows)
    sizes: dict = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len((text or "").encode().split())
    want, drawn = brute_targets(sizes), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        drawn[r["source"]] += r["taken"]
    for source, target in want.items():
        assert abs(drawn[source] - target) <= mixing.BLOCK_WORDS
    again = mixing.taken(frame.repartition(7)).collect()
    key = lambda r: (r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_shards_are_even_and_disjoint(spark):
    sizes = mixing.sized(spark.createDataFrame(mixing_rows(), DOCS), 11)
    sources = mixing.targets(sizes)
    mixed = mixing.mix(sizes, sources, 11)
    per = [r["count"] for r in mixed.groupBy("shard").count().collect()]
    assert max(per) - min(per) <= mixing.LEVELS
    assert mixed.groupBy("row", "block", "use").count().where("count > 1").count() == 0


def test_mixed_texts_hold_what_was_taken(spark):
    frame = spark.createDataFrame(mixing_rows(), DOCS)
    want = collections.Counter()
    for r in mixing.taken(frame).collect():
        want[(r["doc_id"], r["source"])] += r["taken"]
    got = collections.Counter()
    out = mixing.mixed_texts(frame)
    for r in out.collect():
        got[(r["doc_id"], r["source"])] += len(r["text"].encode().split())
    assert out.columns == frame.columns and got == collections.Counter({k: v for k, v in want.items() if v})


def test_mixing_nothing(spark):
    assert mixing.taken(spark.createDataFrame([], DOCS)).count() == 0


def test_hypergeometric_draws(spark):
    """Mean and variance of draws by inversion, and bounds in narrow cases."""
    draws = spark.range(4000).select(F.expr(mixing.hypergeometric(
        "1000L", "300L", "200L", "(xxhash64(7, id) / 18446744073709551616D + 0.5D)")).alias("x"))
    row = draws.agg(F.avg("x"), F.variance("x")).first()
    n, k, d = 1000, 300, 200
    var = d * k / n * (1 - k / n) * (n - d) / (n - 1)
    assert abs(row[0] - d * k / n) < 4 * (var / 4000) ** 0.5 and abs(row[1] / var - 1) < 0.15
    for total, marked, drawn in [(5, 5, 3), (5, 0, 3), (5, 3, 5), (5, 2, 0), (1, 1, 1)]:
        text = mixing.hypergeometric(f"{total}L", f"{marked}L", f"{drawn}L", "0.999D")
        got = spark.range(1).select(F.expr(text).alias("x")).first()[0]
        assert max(0, drawn + marked - total) <= got <= min(marked, drawn)


# --- pipeline ---------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeated_passages", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, sf_dir)
        assert after.columns == docs.columns
        seen = after.cache()
        assert 0 < seen.count()
    rows = corpus_pipeline.STAGES[-1][1](spark, seen, sf_dir)
    assert rows.count() == seen.count()
    assert rows.join(seen.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
