"""Operators over documents against brute force, on a small table and on awkward rows."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaspan.llm import bpe, collinear, iblt_fingerprint, jaccard_join, license_scan, pu_quality, suffix_dedup
from metaspan.llm import suffix_array as sx

LONG = " ".join(f"wort{i % 977}x{i}" for i in range(6000))
ODD = [
    (1, None, "de"), (2, "", "de"), (3, " \t\n", None), (4, "one", "de"), (5, "one", "de"), (5, "one", "de"), (6, "One two Three", "en"),
    (7, "é 中文 😀 <|endoftext|> 's  x\n\n\ty", "xx"), (8, LONG, "en"), (9, LONG + " more", "en"), (None, "lone text of some words here", "en"),
    (10, "A" * 700, "en"), (11, LONG[:3000], None), (-4, "first line\n\nfirst line\nlast line", "en"),
]
SCHEMA = "doc_id long, text string, lang string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    # the extra columns clash with names the operators use themselves
    return spark.createDataFrame([(*r, 1, 2.0, "k") for r in ODD], SCHEMA + ", score int, n_bytes double, key string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for n, kinds in ((1, 1), (2, 1), (400, 2), (900, 4), (600, 256)):
        t = rng.integers(0, kinds, n).astype(np.uint8)
        t = np.concatenate((t, t[: n // 2]))
        raw = t.tobytes()
        sa = sx.suffix_array(t, 200)
        assert sorted(sa) == list(range(len(t)))
        keys = [raw[i : i + 200] for i in sa]
        assert keys == sorted(keys)
        lcp = sx.common_prefixes(t, sa, 200)
        for k in range(1, len(sa)):
            a, b = raw[sa[k - 1] :][:200], raw[sa[k] :][:200]
            m = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == m


def cut_by_hand(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 2])
def test_suffix_dedup(small, odd, none, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    for frame in (small, odd):
        rows = frame.select("doc_id", "text").collect()
        want = sorted((repr(r.doc_id), *w) for r, w in zip(rows, cut_by_hand([r.text for r in rows])))
        got = suffix_dedup.remove_repeats(frame).collect()
        got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
        assert got == want
    assert suffix_dedup.remove_repeats(none).count() == 0


def groups_by_hand(rows, width, percent):
    sets = {}
    for r in rows:
        w = WORD.findall((r.text or "").encode().translate(LOWER))
        s = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        sets.setdefault(r.doc_id, []).append(s)
    least = {k: k for k in sets}
    ids = [k for k in sets if k is not None]

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = root(a), root(b)
                least[max(p, q)] = min(p, q)
    return sorted((repr(k), len(s), repr(root(k) if k is not None else None)) for k, v in sets.items() for s in v)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard_components(small, odd, none, width, percent):
    for frame in (small, odd):
        rows = frame.select("doc_id", "text").collect()
        got = jaccard_join.jaccard_components(frame, width, percent).collect()
        got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got)
        assert [g for g in got if g[1]] == [w for w in groups_by_hand(rows, width, percent) if w[1]]
        assert all(a == c for a, n, c in got if not n)
    assert jaccard_join.jaccard_components(none, width, percent).count() == 0


def test_jaccard_rest_round(spark, monkeypatch):
    """Chains of near copies that no star joins: the rest round must find every link."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        words = list(base)
        for k in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            words[k] = f"x{rng.integers(0, 4)}{k}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "STARS", ())
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard_join.jaccard_components(frame, 4, 70).collect())
    assert got == groups_by_hand(frame.collect(), 4, 70)


def test_jaccard_of_unlike_texts_under_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(300))
    rows = [(1, a), (1, b), (5, a + " word"), (6, b + " word"), (7, "other words " * 9), (7, b + " last"), (8, "c " + a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard_join.jaccard_components(frame, 4, 85).collect())
    assert got == groups_by_hand(frame.collect(), 4, 85) and {g[2] for g in got} == {"1"}


def test_jaccard_order_is_rare_first(spark, monkeypatch):
    """Frequent shingles come last even where shingles are many times the counters."""
    monkeypatch.setattr(jaccard_join, "MIN_BITS", 12)
    monkeypatch.setattr(jaccard_join, "MAX_BITS", 12)
    rng = np.random.default_rng(3)
    texts = [(" ".join(f"w{x}" for x in rng.integers(0, 10**9, 100)) + (" the very common line" if i % 2 else ""),) for i in range(1500)]
    place = jaccard_join.frequency_classes(spark.createDataFrame(texts, "text string"), 4)
    _, h = jaccard_join.bo.shingles(*jaccard_join.bo.text_buffer(jaccard_join.pa.array([texts[1][0]])), 4)
    first, second = jaccard_join._counters(h, 12)
    classes = np.minimum(place[0][first], place[1][second])
    assert classes[-1] > classes[:-1].max()


@pytest.mark.parametrize("hot", [256, 1])
def test_jaccard_long_lists_by_size(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "STARS", ())
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        words = [f"w{k}" for k in range(int(rng.integers(8, 60)))]
        if i % 3 == 0:
            words[int(rng.integers(0, len(words)))] = f"x{i}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard_join.jaccard_components(frame, 3, 80).collect())
    assert got == groups_by_hand(frame.collect(), 3, 80)


def test_fingerprints(small, odd, none):
    pieces = lambda t: {p for p in t.split("\n") if p}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    rows = sorted(small.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in iblt_fingerprint.fingerprints(small).collect()}
    assert len(got) == len(rows)
    prints = {}
    for i, r in enumerate(rows):
        text, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert g.near_edited == pytest.approx(like(pieces(text), pieces(edited)))
        assert g.near_next == pytest.approx(like(pieces(text), pieces(after)))
        assert prints.setdefault(text, g.fingerprint) == g.fingerprint
    out = iblt_fingerprint.fingerprints(odd).collect()
    assert len(out) == len(ODD) and all(0 <= r.near_next <= 1 for r in out)
    assert iblt_fingerprint.fingerprints(none).count() == 0


def test_bpe_equals_the_library(spark, small, odd, none):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    for frame in (small, odd):
        rows = frame.select("doc_id", "text").collect()
        got = bpe.decode_ids(bpe.encode_texts(frame, path), path).collect()
        want = collections.Counter((repr(r.doc_id), tuple(lib.encode(r.text or "", add_special_tokens=False).ids), r.text or "") for r in rows)
        assert collections.Counter((repr(r.doc_id), tuple(r.ids), r.decoded) for r in got) == want
    assert bpe.encode_texts(none, path).count() == 0
    encoder = bpe.loaded(path)
    rng = np.random.default_rng(9)
    parts = [" ", "  ", "\n", "\t", " ", "　", " ", "a", "Q", "qJ", "'s", "'", "'re", "!", "é", "中", "😀", "23", "<|endoftext|>", "\x00", "\x1c", "\x85", "--", "\r\n"]
    for _ in range(1500):
        text = "".join(rng.choice(parts, int(rng.integers(1, 50))))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)
    for text in ("b" * 3000, "!?" * 900, " " * 500 + "x", "Zürich " * 300):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_quality_classifier(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = pu_quality.fit(docs, labels)
    rows = pu_quality.score(docs, model).join(labels, "doc_id").filter(pu_quality.held_out(F.col("doc_id"))).select("quality", "predicted", "score").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.35 * len(bad)
    out = pu_quality.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.text in (None, "")}) == 1
    assert pu_quality.score(none, model).count() == 0
    empty = pu_quality.fit(none, labels.limit(0))
    assert {r.score for r in pu_quality.score(odd, empty).collect()} == {0.5}


def test_pu_risk_and_gradient_against_plain_sums():
    rng = np.random.default_rng(4)
    loss = lambda z, y: np.log(1 + np.exp(-y * z))
    seen = set()
    for prior in (0.2, 0.5, 0.9):
        for shift in (-1.0, 0.0, 2.0):
            zp, zu = rng.normal(shift, 1, 7), rng.normal(shift / 2 - 1, 1, 11)
            up = prior * sum(loss(z, 1) for z in zp) / 7
            down = sum(loss(z, -1) for z in zu) / 11 - prior * sum(loss(z, -1) for z in zp) / 7
            assert pu_quality.pu_risk(zp, zu, prior) == pytest.approx((up, down))
            way = 1 if down >= 0 else -1
            seen.add(way)
            value = lambda a, b: pu_quality.pu_risk(a, b, prior)[0] + way * pu_quality.pu_risk(a, b, prior)[1]
            dp, du = pu_quality.pu_gradient(zp, zu, prior)
            for k in range(7):
                e = np.eye(7)[k] * 1e-5
                assert dp[k] == pytest.approx((value(zp + e, zu) - value(zp - e, zu)) / 2e-5, abs=1e-6)
            for k in range(11):
                e = np.eye(11)[k] * 1e-5
                assert du[k] == pytest.approx((value(zp, zu + e) - value(zp, zu - e)) / 2e-5, abs=1e-6)
    assert seen == {1, -1}


def test_class_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(6)
    for share in (0.3, 0.6, 0.85):
        good, bad = rng.normal(1.5, 1, (6000, 6)).astype(np.float32), rng.normal(-1.5, 1, (4000, 6)).astype(np.float32)
        n = 4000
        k = int(share * n)
        mixed = np.concatenate((good[2000 : 2000 + k], bad[: n - k]))
        rng.shuffle(mixed)
        assert abs(pu_quality.class_prior(good[:2000], mixed) - share) < 0.06
    assert pu_quality.class_prior(good[:1], mixed) == 0.5


def test_quality_with_clashing_names_and_text_ids(spark):
    model = pu_quality.fit_nnpu(np.ones((4, pu_quality.WIDTH), np.float32), np.zeros((4, pu_quality.WIDTH), np.float32), 0.5, steps=5)
    frame = spark.createDataFrame([("x", "a text", "t", "r", 7)], "doc_id string, text string, _text string, row string, score int")
    (got,) = pu_quality.score(frame, model).collect()
    assert (got.doc_id, got._text, got.row) == ("x", "t", "r") and 0 <= got.score <= 1
    labels = spark.createDataFrame([("x", 1), ("2", 1)], "doc_id string, quality int")
    assert pu_quality.fit(frame, labels).prior == 0.5


def test_nnpu_separates_with_few_positives():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (300, 5)), rng.normal(-2, 1, (200, 5))
    model = pu_quality.fit_nnpu(good[:60], np.concatenate((good[60:], bad)), 240 / 440)
    assert (model.score(good) >= 0.5).mean() > 0.9 and (model.score(bad) < 0.5).mean() > 0.9


def chained(points, gap, max_gap, slack):
    """The best score that ends in each run, by trying all predecessors."""
    best: dict = {}
    for x, y, n in points:
        before = [0.0]
        for (a, b, m), v in best.items():
            dx, dy = x - (a + m - slack), y - (b + m - slack)
            if 0 <= dx <= max_gap + slack and 0 <= dy <= max_gap + slack:
                before.append(v - gap * (dx + dy) / 2)
        best[x, y, n] = n + max(before)
    return best


def test_chain_against_all_paths():
    rng = np.random.default_rng(2)
    for width, gap in ((40, 0.5), (400, 0.15), (900, 0.02), (300, 0.0)):
        for _ in range(40):
            xy = sorted({(int(x), int(y)) for x, y in rng.integers(0, width, (25, 2))} | {(int(x), int(x) + int(k)) for x, k in rng.integers(0, (width, 9), (25, 2))})
            points = sorted((x, y, int(n)) for (x, y), n in zip(xy, rng.integers(6, 20, len(xy))))
            best = chained(points, gap, 40, collinear.SEED - 1)
            paths = collinear.chain(points, gap)
            assert sorted(p for path in paths for p in path) == points
            value = float(paths[0][0][2])
            for p, q in zip(paths[0], paths[0][1:]):
                slack = collinear.SEED - 1
                dx, dy = q[0] - (p[0] + p[2] - slack), q[1] - (p[1] + p[2] - slack)
                assert 0 <= dx <= 40 + slack and 0 <= dy <= 40 + slack
                value += q[2] - gap * (dx + dy) / 2
            assert value == pytest.approx(max(best.values()))
    # a long chain far back does not keep nearer runs from chaining
    far, near = [(6 * i, 6 * i, 6) for i in range(30)], [(236 + 6 * i + i, 236 + 6 * i, 6) for i in range(3)]
    assert [len(p) for p in collinear.chain(far + near)] == [30, 3]


def test_fuzzy_recall_and_shared_ids(spark):
    """Planted passages with random changes, against the alignment of every planted pair."""
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"z{x}" for x in rng.integers(0, 10**9, n)]
    rows, planted = [], {}
    for k in range(240):
        size, identity = int(rng.choice([40, 60, 120])), float(rng.choice([0.8, 0.85, 0.9, 0.95]))
        passage = fresh(size)
        changed = list(passage)
        for p in rng.choice(size, int(round(size * (1 - identity))), replace=False):
            changed[p] = f"c{k}x{p}"
        before = fresh(30)
        rows += [(2 * k, " ".join(fresh(20) + passage + fresh(30))), (2 * k + 1, " ".join(before + changed + fresh(10)))]
        planted[2 * k + 1] = (identity, size)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    covered = {r.doc_id: r for r in collinear.covered(collinear.fuzzy_passages(frame, collinear.PIECE)).collect()}
    assert set(covered) <= set(planted) and all(covered[d].holders == [d - 1] for d in covered)
    for least, identity in ((0.8, 0.8), (0.9, 0.85), (0.95, 0.9), (0.97, 0.95)):
        some = [d for d, (i, _) in planted.items() if i == identity]
        assert sum(d in covered for d in some) >= least * len(some), identity
    assert sum(d in covered for d in planted) >= 0.9 * len(planted)
    # two texts under one id are both searched, and both can hold
    a, b = fresh(60), fresh(60)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(b)), (2, " ".join(a[:50])), (3, " ".join(b[5:])), (4, " ".join(a[:40] + fresh(40) + b[:40]))]
    got = {(r.doc_id, r.holder) for r in collinear.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 1), (3, 1), (4, 1)}
    # exact passages on either side of 40 other words both count
    gap = spark.createDataFrame([(1, " ".join(a + fresh(40) + b)), (2, " ".join(a + fresh(40) + b))], "doc_id long, text string")
    assert sorted((r.start_word, r.end_word) for r in collinear.fuzzy_passages(gap).collect()) == [(0, 60), (100, 160)]


def test_fuzzy_passages(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = collinear.fuzzy_passages(docs).collect()
    texts = {r.doc_id: (r.text or "").lower().split() for r in docs.collect()}
    inside = collections.defaultdict(set)
    for r in found:
        inside[r.doc_id].update(range(r.start_word, r.end_word))
        assert 0 <= r.start_word < r.end_word <= len(texts[r.doc_id]) and r.identity >= collinear.MIN_IDENTITY
    seen = set()
    for i in sorted(texts):  # runs of 50 words that occur before must lie in passages
        w = texts[i]
        for k in range(len(w) - 49):
            run = tuple(w[k : k + 50])
            if run in seen:
                assert len(set(range(k, k + 50)) - inside[i]) <= 5, (i, k)
            seen.add(run)
    words = [f"t{i}" for i in range(80)]
    edited = [w if i % 15 else "changed" for i, w in enumerate(words)]
    fuzzy = spark.createDataFrame([(1, "a b c " + " ".join(words)), (2, "q r " + " ".join(edited) + " z")], "doc_id long, text string")
    (row,) = collinear.fuzzy_passages(fuzzy).collect()
    assert (row.doc_id, row.holder) == (2, 1) and row.end_word - row.start_word >= 70
    assert {r.doc_id for r in collinear.fuzzy_passages(odd).collect()} == {9, 11}
    assert collinear.fuzzy_passages(none).count() == 0


def test_license_scan(spark, odd, none):
    rows = [
        (1, "Some text.\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
        (3, "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\nLicensed under the Apache License, Version 2.0."), (4, "not licensed under the MIT license at all"), (5, None),
    ]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].license == "MIT" and got[1].sentence_ids == ["mit-released"]
    assert got[2].licenses == ["Apache-2.0 with notice", "Apache-2.0"]
    assert got[3].licenses == ["Apache-2.0"] and got[3].n_known == 2
    assert got[4].license is None and got[5].sentence_ids == []
    assert license_scan.scan(odd).count() == len(ODD) and license_scan.scan(none).count() == 0
    own = license_scan.scan(spark.createDataFrame([(1, "Proprietary.\nAsk first."), (2, "ask first")], "doc_id long, text string"), {"own": "proprietary", "ask": "ask first"}, [("Own", ["own", "ask"])])
    assert {r.doc_id: (r.sentence_ids, r.license) for r in own.collect()} == {1: (["own", "ask"], "Own"), 2: (["ask"], None)}
