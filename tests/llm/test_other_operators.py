"""Mixing, url filters, embeddings, components and the pipeline."""

import numpy as np
import pytest

from metaspan.llm import embedding_dedup, pfair_mix, url_filter
from metaspan.llm.components import components
from metaspan.llm.hnsw import Graph


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)]
    least = {x: x for e in edges for x in e}
    for _ in range(len(least)):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in least.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_period_keeps_every_prefix_within_a_block():
    rng = np.random.default_rng(6)
    for _ in range(80):
        parts = pfair_mix.whole_weights({str(i): float(rng.random() ** 3 + 1e-6) for i in range(int(rng.integers(1, 30)))}, int(rng.choice([10, 97, 1000])))
        slots, units = pfair_mix.period(parts), sum(parts.values())
        at = {t: k for k, v in slots.items() for t in v}
        had = dict.fromkeys(parts, 0)
        for t in range(units):
            had[at[t]] += 1
            assert all(abs(had[k] * units - parts[k] * (t + 1)) < units for k in parts)


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(pfair_mix.mix(docs, block=2).collect(), key=lambda r: (r.mix_slot, r.mix_place))
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    counts = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    parts = pfair_mix.whole_weights({k: n**pfair_mix.ALPHA for k, n in counts.items()}, pfair_mix.UNITS)
    total = sum(parts.values())
    blocks: dict = {}
    for r in rows:
        blocks.setdefault(r.mix_slot, []).append(r)
    had = dict.fromkeys(parts, 0)
    for slot in range(max(blocks) + 1):
        if slot in blocks:
            assert len({x.source for x in blocks[slot]}) == 1 and [x.mix_place for x in blocks[slot]] == list(range(len(blocks[slot])))
            had[blocks[slot][0].source] += 1
        if slot in blocks and blocks[slot][0].balanced:
            assert all(abs(had[k] * total - parts[k] * (slot + 1)) < total for k in parts)
    odd = spark.createDataFrame([(None, None, None), (1, "a", "x"), (1, "a", "x"), (2, None, "y")], "doc_id long, text string, source string")
    assert pfair_mix.mix(odd.withColumn("mix_slot", pfair_mix.F.lit("s"))).count() == 4
    assert pfair_mix.mix(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pfair_mix.mix(odd, {"x": 1.0}).count()


def test_mix_of_many_equal_rows_and_clashing_names(spark, monkeypatch):
    """Equal rows are spread over parts; the schedule is that of a plain numbering, and other columns pass untouched."""
    monkeypatch.setattr(pfair_mix, "PART_ROWS", 16)
    rows = [(None, None, "x", i) for i in range(150)] + [(1, "a", "y", i) for i in range(70)] + [(i, f"t{i}", "x", i) for i in range(60)]
    names = ["_h", "_bucket", "_rank", "buckets", "parts", "slots", "row", "h", "part", "rank", "n"]
    frame = spark.createDataFrame([(*r, *[f"{c}{r[3]}" for c in names]) for r in rows], "doc_id long, text string, source string, k long, " + ", ".join(f"{c} string" for c in names)).repartition(5)
    out = sorted(pfair_mix.mix(frame, block=4).collect(), key=lambda r: (r.mix_slot, r.mix_place))
    assert sorted((r.doc_id or -1, r.text or "", r.source, r.k) for r in out) == sorted((a or -1, b or "", c, k) for a, b, c, k in rows)
    assert all(r[c] == f"{c}{r.k}" for r in out for c in names)
    parts = pfair_mix.whole_weights({"x": 210**pfair_mix.ALPHA, "y": 70**pfair_mix.ALPHA}, pfair_mix.UNITS)
    slots, total = pfair_mix.period(parts), sum(parts.values())
    for source, n in (("x", 210), ("y", 70)):
        got = [(r.mix_block, r.mix_slot, r.mix_place) for r in out if r.source == source]
        want = [(i // 4, i // 4 // parts[source] * total + slots[source][i // 4 % parts[source]], i % 4) for i in range(n)]
        assert got == want


def test_mix_refuses_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(pfair_mix, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        pfair_mix.mix(spark.createDataFrame([(1, "a", s) for s in "xyz"], "doc_id long, text string, source string"))


def test_mix_order_is_kept_by_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = pfair_mix.mix(docs, block=4)
    pfair_mix.in_order(mixed, ["doc_id", "mix_slot", "mix_place"]).write.parquet(str(tmp_path / "m"))
    import pyarrow.parquet as pq

    rows = [x for p in sorted((tmp_path / "m").glob("part-*")) for x in pq.read_table(p).to_pylist()]
    assert [(r["mix_slot"], r["mix_place"]) for r in rows] == sorted((r["mix_slot"], r["mix_place"]) for r in rows)


def test_url_rules_and_ranks(spark):
    page = lambda *links: "".join(f'<a href="{u}">x</a>' for u in links)
    rows = [
        (1, "http://www.example.com/en/7?x", None), (2, "HTTP://B.EXAMPLE.com/en/8#y", ""), (3, "https://example.net/de/81", "x"), (4, "no scheme", None), (5, None, None),
        (6, "http://farm.test/", page("http://x.example.net/de/8", "http://x.example.net/de/9")), (7, "http://good.test/a", page("http://www.example.com/en/7")), (8, "http://farm.test/", None), (9, "http://x.example.net/de/8", None),
    ]
    pages = spark.createDataFrame([(*r, "z", "r") for r in rows], "page_id long, url string, html string, host string, rule string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark, url_filter.RULES)).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1, 6)] == [
        ("www.example.com", "/en/7", "example.com/en/7", "allow"), ("b.example.com", "/en/8", "com/en/", "block"),
        ("example.net", "/de/81", "example.net/de/8", "block"), ("", "", None, "allow"), ("", "", None, "allow"),
    ]
    assert got[6].verdict == "block" and got[8].verdict == "block" and got[7].verdict == "allow"
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_frame(spark, url_filter.RULES)).count() == 0


def test_ranks_against_dense_iteration(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 2.0), ("d", "a", 1.0)]
    seeds = spark.createDataFrame([("a", 0.5), ("d", 0.5)], "host string, mass double")
    got = {r.host: r["rank"] for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, w double"), seeds).collect()}
    out = {}
    for s, _, w in edges:
        out[s] = out.get(s, 0) + w
    first = {"a": 0.5 * (1 - url_filter.DAMPING), "d": 0.5 * (1 - url_filter.DAMPING)}
    rank = dict(first)
    for _ in range(400):  # far beyond the fixed point
        new = dict(first)
        for s, d, w in edges:
            new[d] = new.get(d, 0) + url_filter.DAMPING * rank.get(s, 0) * w / out[s]
        rank = new
    assert got == pytest.approx(rank, abs=1e-5)


def vectors(rng, n, groups):
    x = rng.normal(size=(n, 24))
    for g in range(groups):
        i = rng.integers(0, n, 12)
        x[i] = x[i[0]] + rng.normal(size=(12, 24)) * 0.12
    return x


def test_graph_finds_neighbours():
    rng = np.random.default_rng(8)
    x = vectors(rng, 1500, 40)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x.astype(np.float32), np.arange(len(x)))
    ids, _ = graph.search(x, 48)
    truth = np.argsort(-(x @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(t) & set(i)) for t, i in zip(truth, ids)]) / 5 > 0.9


@pytest.mark.parametrize("cap", [8192, 90])
def test_near_duplicates(spark, cap):
    rng = np.random.default_rng(7)
    x = vectors(rng, 400, 14).round(6)
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist(), 0) for i in range(5)] + [(1000, x[0].tolist(), 0)]
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [1.0, None], 1), (2004, x[1].tolist(), None), (None, x[1].tolist(), 1), (2005, [], 2), (2006, [float("inf")] * 24, 0), (2007, [1.0, 2.0], 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = {}
    for r in embedding_dedup.near_duplicates(frame, cap=cap).collect():
        assert got.setdefault(r.vec_id, r) == r
    usable = {i: (v, k) for i, v, k in rows if i is not None and k is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(usable)
    links = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            (u, k), (v, m) = usable[a], usable[b]
            if a != b and k == m and len(u) == len(v) and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= embedding_dedup.COSINE:
                links[a].add(b)
    least = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in links[a]:
                least[a] = least[b] = min(least[a], least[b])
    for i in ids:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), least[i], least[i] == i), i
    for i in (2000, 2001, 2002, 2003, 2004, 2005, 2006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 0 and got[None].kept is False
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_of_extreme_size(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, ((base + rng.normal(size=16) * 0.01) * size).tolist(), 1) for i, size in enumerate([1e-200, 1e-200, 1e200, 1e200, 1.0, 1e-290, 1e300])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (6, 0) for i in range(7)}


def test_pipeline(spark, sf):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = docs.columns
    now, counts = docs, [docs.count()]
    for name, stage in pipe.STAGES[:-1]:
        now = pipe.written(stage(spark, now, sf), "test")
        assert now.columns == want, name
        counts.append(now.count())
    assert counts[0] >= counts[1] > counts[2] and counts[2] == counts[3] == counts[4]
    out = pipe.run(spark, sf)
    assert out.count() == counts[-1] and out.filter("n_tokens <> size(ids)").count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3)], docs.schema)
    for frame in (odd, odd.limit(0)):
        for _, stage in pipe.STAGES:
            frame = pipe.written(stage(spark, frame, sf), "test")


def test_pipeline_keeps_unlike_texts_that_share_an_id(spark, sf):
    import corpus_pipeline as pipe

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b), (None, b + " x"), (None, "quite another text of its own, with words"), (4, ""), (4, None), (5, "short one")]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipe.near_copies(spark, docs, sf)
    assert out.columns == docs.columns
    got = sorted((repr(r.doc_id), r.text) for r in out.collect() if r.text)
    assert got == sorted([("1", a), ("1", b), ("None", rows[5][1]), ("5", "short one")])
    assert out.filter("doc_id = 4").count() == 2
