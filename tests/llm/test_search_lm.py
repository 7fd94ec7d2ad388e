import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm import balltree, eliasfano, ngrams

from .helpers import ODD, documents, twins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 1 << 62)), max_size=300), st.lists(st.integers(0, 1 << 62), max_size=30))
def test_elias_fano(values, others):
    v = np.array(sorted(values), np.int64)
    ef = eliasfano.EliasFano(eliasfano.EliasFano.arrays(v))
    assert ef.get(np.arange(len(v))).tolist() == v.tolist()
    keys = np.array([*values, *others, *(x + 1 for x in values), 0], np.int64)
    assert ef.find(keys).tolist() == np.searchsorted(v, keys).tolist()
    assert (ef.index(keys) >= 0).tolist() == np.isin(keys, v).tolist()


def test_elias_fano_is_compact():
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 100_000))
    assert sum(a.nbytes for a in eliasfano.EliasFano.arrays(v)) * 8 / len(v) < 40 - np.log2(100_000) + 6


def test_bundles_survive_attempts(tmp_path):
    name, bits = str(tmp_path / "level2"), 8
    want = {s: [np.arange(s, dtype=np.int64), np.array([s], np.uint16)] for s in range(0, 256, 3)}
    for s, a in want.items():
        eliasfano.write_arrays(f"{name}-{s:06d}", a)
    for b in range(eliasfano.bundle_count(bits)):
        eliasfano.bundle_files(name, bits, b)
        eliasfano.bundle_files(name, bits, b)
    assert len(list(tmp_path.iterdir())) == 64
    bundles = eliasfano.Bundles(name, bits)
    for s in range(256):
        got = bundles.arrays(s)
        assert (got is None) == (s not in want)
        assert got is None or all((g == w).all() and len(g) == len(w) for g, w in zip(got, want[s], strict=True))


def brute_lm(docs, order=3, min_count=1):
    """Dictionaries, no quantisation."""
    text = {}
    for i, t in docs:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        text.setdefault(i, []).append(re.findall(r"[^\x20\x09-\x0D]+", low))
    train = [w for i, ts in text.items() for w in ts if i is None or zlib.crc32(str(i).encode()) % 10]
    uni = Counter(x for w in train for x in [*w, 0])
    n, v = sum(uni.values()), len(uni)
    kept = {1: {(x,) for x in uni} | {("<",)}}
    share, left = {}, {}
    for k in range(2, order + 1):
        c = Counter(tuple(s[i - k + 1 : i + 1]) for w in train for s in [["<", *w, 0]] for i in range(k - 1, len(s)))
        c = {g: m for g, m in c.items() if g[:-1] in kept[k - 1]}
        total = Counter()
        for g, m in c.items():
            total[g[:-1]] += m
        kept[k] = {g for g, m in c.items() if m >= min_count}
        for ctx in total:
            left[ctx] = 1.0
        for g in kept[k]:
            share[g] = (c[g] - 0.75) / total[g[:-1]]
            left[g[:-1]] -= share[g]
    out = []
    for i, ts in text.items():
        for w in ts:
            s = ["<", *w, 0]
            base = score = 0.0
            for j in range(1, len(s)):
                p = (uni[s[j]] + 0.1) / (n + 0.1 * (v + 1))
                base += log10(p)
                for k in range(2, order + 1):
                    ctx = tuple(s[j - k + 1 : j])
                    if j >= k - 1 and len(ctx) == k - 1 and ctx in left:
                        p = share.get((*ctx, s[j]), 0.0) + left[ctx] * p
                score += log10(p)
            out.append((i, len(s) - 1, sum(x in uni for x in s[1:]), n, base, score))
    return out


def check(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4]
        assert abs(g[4] - w[4]) <= 1e-9 * max(1, abs(w[4]))
        assert abs(g[5] - w[5]) <= 0.02 * g[1] + 1e-9


def lm(df, **how):
    return ngrams.score_documents(df, **how).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()


def test_lm_table(spark, sf, monkeypatch):
    monkeypatch.setattr(ngrams, "GATHER", 20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = lm(docs)
    check(got, brute_lm([(r.doc_id, r.text) for r in docs.collect()]))
    check(lm(docs, min_count=2), brute_lm([(r.doc_id, r.text) for r in docs.collect()], min_count=2))
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 10 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_odd(spark):
    check(lm(documents(spark, [*ODD, (11, "The the THE É é x")])), brute_lm([*ODD, (11, "The the THE É é x")]))
    assert lm(documents(spark, [])) == []
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = lm(documents(spark, [(only_held, "a b")]))[0]
    assert row.train_tokens == 0 and row.n_known == 0 and row.base_score == pytest.approx(0.0)


def test_lm_structured_words(spark):
    x, y = twins()
    ids = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 10][:2] + [next(i for i in range(1, 200) if not zlib.crc32(str(i).encode()) % 10)]
    docs = [(ids[0], f"a {x}"), (ids[1], "b"), (ids[2], f"a {y}")]
    got = lm(documents(spark, docs))
    check(got, brute_lm(docs))
    assert {r.doc_id: r.n_known for r in got}[ids[2]] == 2  # a and the end


def test_lm_query_keeps_ngrams_seen_once(spark, sf):
    rows = ngrams.QUERY["op6_lm_score"](spark, sf).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, brute_lm(docs, min_count=1))


def test_lm_shares_of_the_most_frequent_contexts():
    count = np.array([1, 10**10])
    arrays = ngrams.Level.arrays(1, np.zeros(2, np.int64), np.arange(2), count, np.arange(2), 0.75)
    assert np.log10(ngrams._VALUES[arrays[10]]) == pytest.approx(np.log10((count - 0.75) / count.sum()), abs=0.001)
    assert np.log10(ngrams._VALUES[arrays[11]]) == pytest.approx(np.log10([1.5 / count.sum()]), abs=0.001)


def brute_topk(rows, every=50, k=5):
    v = [(i, np.floor(256 * np.array(x, np.float64)).astype(object)) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for q, a in {i: a for i, a in sorted(v, key=lambda r: r[0]) if i % every == 0}.items():
        n = lambda b: min(len(a), len(b))  # noqa: B023, E731
        s = sorted((-int((a[: n(b)] * b[: n(b)]).sum()), i) for i, b in v if i != q)[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("shard", [64, 16384])
def test_topk(spark, monkeypatch, shard):
    monkeypatch.setattr(balltree, "QUERY_ROWS", 4)
    monkeypatch.setattr(balltree, "NEAR", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(700)]
    rows += [(700 + i, rows[i % 9][1]) for i in range(60)]
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1050, [float("nan")] * 8), (1100, [float("inf")] * 8), (None, [1.0] * 8), (1150, []), (1200, [0.5] * 3), (1250, [1e30] * 8), (1251, [-1e30] * 8), (3, rows[3][1])]
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(map(tuple, balltree.top_products(df, balltree.F.col("vec_id") % 50 == 0, shard_rows=shard).collect()))
    plain = [r for r in got if r[0] not in (1250,) and abs(r[3]) < 2**62]
    want = brute_topk([(i, x) for i, x in rows])
    assert [r[:3] for r in got if r[0] != 1250 and r[0] != 1251] and {r[0] for r in got} == {r[0] for r in want}
    assert plain == [r for r in want if r[0] != 1250 and abs(r[3]) < 2**62]
    assert balltree.top_products(df.where("false"), balltree.F.col("vec_id") % 50 == 0).count() == 0
    assert len(balltree.top_products(df.where("vec_id < 3"), balltree.F.col("vec_id") % 50 == 0).collect()) == 2


def test_ball_tree_holds_its_points():
    x = np.random.default_rng(0).normal(size=(1000, 5))
    order, root = balltree.build(x, 16)
    stack = [root]
    while stack:
        n = stack.pop()
        rows = x[order[n.lo : n.hi]]
        assert np.sqrt(((rows - n.centre) ** 2).sum(1)).max() <= n.radius + 1e-9
        stack += n.children
    assert sorted(order.tolist()) == list(range(1000))


def clustered(n, groups, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    return np.floor(256 * (middle[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, dim)))).astype(np.int64)


def test_branch_and_bound_evaluates_few_products_of_clustered_vectors():
    x = clustered(3000, 40)
    ids = np.arange(len(x))
    top = balltree.search(x, ids, x[::50], ids[::50], 5, np.full(60, balltree._LOW))
    assert top.products < 0.5 * 60 * len(x)
    s = x[::50] @ x.T
    s[np.arange(60), ids[::50]] = balltree._LOW + 1
    best = np.argsort(-s, 1, kind="stable")[:, :5]
    assert (top.id == best).all() and (top.score == np.take_along_axis(s, best, 1)).all()


def test_few_shards_are_asked_of_clustered_vectors(spark):
    """The third stage sends queries only to balls whose bound reaches their floors; results stay exact."""
    x = clustered(3000, 12)
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, balltree.top_products(df, balltree.F.col("vec_id") % 50 == 0, shard_rows=100).collect()))
    assert got == brute_topk([(i, (v / 256).tolist()) for i, v in enumerate(x)])
    centres = balltree.centres_of(x.astype(float), 30)
    own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    far = np.sqrt(((x - centres[own]) ** 2).sum(1))
    balls = balltree.Balls(centres, np.array([far[own == c].max(initial=0) for c in range(30)]), np.array([-(-(own == c).sum() // 100) for c in range(30)]))
    q = x[::50].astype(float)
    floor = np.sort(q @ x.T, 1)[:, -6].astype(np.int64)
    sent = [set(zip(*(a.tolist() for a in balls.targets(q, np.arange(60), floor, stage)), strict=True)) for stage in range(3)]
    assert not sent[0] & sent[1] and not sent[1] & sent[2]
    assert sum(map(len, sent)) < 0.4 * 60 * balls.shards.sum()
    every = [balls.targets(q, np.arange(60), np.full(60, balltree._LOW), stage) for stage in range(3)]
    assert sum(len(e[0]) for e in every) == 60 * balls.shards.sum()
