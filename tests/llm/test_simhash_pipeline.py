import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm import simhash

from .helpers import ODD, documents
from .test_pack_mix_urls import brute_targets, check_packing, whole_ids
from .test_repeats import brute_bytes


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(p) for p in zip(words, words[1:], strict=False)] or words
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_near(docs):
    fp = np.array([brute_fingerprint(t) for _, t in docs], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 6
    label = np.arange(len(docs))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(docs))])
        if (new == label).all():
            break
        label = new
    out = []
    for i, (d, _) in enumerate(docs):
        names = [docs[j][0] for j in np.flatnonzero(label == label[i]) if docs[j][0] is not None]
        out.append((d, f"{int(fp[i]):016x}", int(near[i].sum()) - 1, min(names, default=None)))
    return out


def check(spark, docs):
    got = [(r.doc_id, r.fingerprint, r.n_near, r.component_id) for r in simhash.near_duplicates(documents(spark, docs)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_near(docs)))


def test_table(spark, sf):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_odd(spark):
    check(spark, [*ODD, (40, "A b"), (41, "a\tB"), (42, "one"), (43, "ONE"), (44, "É è"), (45, "x" * 40 + " " + "y" * 60)])
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_chains_and_copies(spark):
    rng = np.random.default_rng(8)
    base = [f"w{rng.integers(50)}" for _ in range(400)]
    docs = []
    for i in range(150):
        if i % 3 == 0:
            base = [*base]
            for _ in range(3):
                base[int(rng.integers(400))] = f"v{rng.integers(1000)}"
        docs.append((int(1000 - i * 3), " ".join(base if i % 5 else ["other", *map(str, rng.integers(0, 99, 9))])))
    check(spark, docs)


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c"), (5, "a b c"), (3, "A  b c"), (None, "a b c"), (7, "other words here"), (7, "quite different again now"), (None, None), (9, "")]
    df = documents(spark, rows)
    kept = simhash.keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, [(3, "A  b c"), (7, "other words here"), (7, "quite different again now"), (9, "")]))


@pytest.mark.parametrize(("blocks", "shard"), [(1, 10**6), (1, 50), (7, 20), (8, 10**6), (10, 10**6)])
def test_layouts_find_every_pair_once(spark, blocks, shard):
    rng = np.random.default_rng(blocks)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for i in range(0, 300, 2):
        flips = rng.choice(64, int(rng.integers(1, 9)), replace=False)
        x[i + 1] = x[i] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
    x = np.unique(np.concatenate([x, x[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    n = np.arange(1, len(x) + 1)
    frames = spark.createDataFrame([(int(v), int(k)) for v, k in zip(x.view(np.int64), n, strict=True)], "fp long, n long")
    got, edges = defaultdict(int), []
    for r in simhash.near_points(frames, len(x), blocks, blocks - 6 if blocks > 1 else 0, shard).collect():
        got[r.fp] += r.near
        edges += [(r.fp, r.peer)] if r.peer is not None else []
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 6
    want = {int(v): int(n[near[i]].sum() - n[i]) for i, v in enumerate(x.view(np.int64))}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    label = {int(v): int(v) for v in x.view(np.int64)}
    while any(label[u] != label[v] for u, v in edges):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    parts = defaultdict(set)
    for u in label:
        parts[label[u]].add(u)
    reach = near.copy()
    while not np.array_equal(reach, more := reach @ reach):
        reach = more
    assert {frozenset(p) for p in parts.values()} == {frozenset(x.view(np.int64)[row].tolist()) for row in reach}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(2, 24), st.integers(1, 900))
def test_vantage_point_tree(seed, bits, n):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64) * np.uint64(0x0001_0010_0100_1001))
    links = simhash.Links(x, np.ones(len(x), np.int64))
    simhash.search_tree(links, np.arange(len(x)))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 6
    assert links.near.tolist() == (near.sum(1) - 1).tolist()
    reach = near.copy()
    while not np.array_equal(reach, more := reach @ reach):
        reach = more
    assert links.label.tolist() == reach.argmax(1).tolist()
    half = rng.random(len(x)) < 0.5
    cross = simhash.Links(x, np.ones(len(x), np.int64))
    simhash.search_tree(cross, np.flatnonzero(half), np.flatnonzero(~half))
    assert cross.near.tolist() == (near & (half[:, None] != half[None, :])).sum(1).tolist()


def test_tree_prunes_and_dense_sets_fit():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    links = simhash.Links(x, np.ones(len(x), np.int64))
    simhash.search_tree(links, np.arange(len(x)))
    assert links.compared < 0.75 * len(x) ** 2 / 2
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    dense = np.unique(np.concatenate([np.bitwise_or.reduce(bits[np.argsort(rng.random((6000, 64)), 1)[:, :3]], 1)]))
    links = simhash.Links(dense, np.ones(len(dense), np.int64))
    simhash.search_tree(links, np.arange(len(dense)))
    assert (links.near == len(dense) - 1).all() and (links.label == 0).all()


def test_components_of_a_path(spark):
    order = np.random.default_rng(1).permutation(60)
    edges = [(int(a), int(b)) for a, b in zip(order[:-1], order[1:], strict=True)] + [(100, 101), (103, 102), (101, 100), (7, 7)]
    got = {r.u: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 60), 0), 101: 100, 103: 102}


def jobs(spark, work):
    """What work() gives, and how many jobs it starts."""
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.nextJobId()
    return work(), scheduler.nextJobId() - before


@pytest.mark.parametrize("whole", [simhash.EDGES, 0])
def test_components_in_one_task_and_by_stars(spark, whole):
    rng = np.random.default_rng(5)
    edges = [(int(a) - 40, int(b) - 40) for a, b in rng.integers(0, 80, (45, 2))] + [(-(1 << 63), (1 << 63) - 1), (3, 3)] * 2
    label = {v: v for e in edges for v in e}
    while any(label[u] != label[v] for u, v in edges):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    found = simhash.components(spark.createDataFrame(edges, "u long, v long"), whole).collect()
    assert sorted((r.u, r.root) for r in found) == sorted((u, r) for u, r in label.items() if u != r)
    assert simhash.components(spark.createDataFrame([], "u long, v long"), whole).count() == 0


def test_few_links_take_few_jobs(spark):
    path = [(k, k + 1) for k in range(200)]
    found, n = jobs(spark, lambda: {r.u: r.root for r in simhash.components(spark.createDataFrame(path, "u long, v long")).collect()})
    assert found == dict.fromkeys(range(1, 201), 0) and n <= 6
    base = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join([*base[: k // 4], "x", *base[k // 4 :]])) for k in range(200)] + [(900 + k, f"other {k} words {k * k} here {k * 7}") for k in range(40)]
    kept, n = jobs(spark, lambda: {r.doc_id for r in simhash.keep_representatives(documents(spark, docs)).collect()})
    assert kept == {c for _, _, _, c in brute_near(docs)} and n <= 30


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    docs = docs.unionByName(spark.createDataFrame([(90001, None, "en", "src0", None), (90002, "1 2 3", None, "src0", 5), (90003, docs.first().text, None, "src1", 9)], docs.schema)).persist()
    first = cp.identify_language(spark, docs, sf)
    assert first.columns == docs.columns
    ids = {r.doc_id for r in first.collect()}
    assert {90001, 90002} & ids == set() and len(ids) >= docs.count() - 4
    second = cp.drop_near_copies(spark, first, sf).persist()
    rows = [(r.doc_id, r.text) for r in first.collect()]
    assert {r.doc_id for r in second.collect()} == {c for _, _, _, c in brute_near(rows)}
    third = cp.drop_repeats(spark, second, sf).persist()
    assert third.columns == docs.columns
    want = {i: n - gone for i, n, gone, *_ in brute_bytes([(r.doc_id, r.text) for r in second.collect()])}
    for r in third.collect():
        assert want[r.doc_id] - 6 <= len(r.text.encode()) <= want[r.doc_id] and r.n_chars == len(r.text)
    assert {r.doc_id for r in third.collect()} == {i for i, n in want.items() if n}
    fourth = cp.mix(spark, third, sf).persist()
    assert fourth.columns == docs.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken, each, own = Counter(), Counter(), Counter(), {}
    for r in third.collect():
        sizes[r.source] += words(r.text)
        own[r.doc_id] = words(r.text)
    for r in fourth.collect():
        taken[r.source] += words(r.text)
        each[r.doc_id] += words(r.text)
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 32
    assert all(each[i] <= 3 * own[i] for i in each)
    last = cp.pack(spark, fourth, sf).collect()
    total = sum(map(len, whole_ids([r.text for r in fourth.collect()])))
    assert sum(r.length for r in last) == total
    assert check_packing(last) <= -(-total // 2048) * 1.02 + 2


def test_pipeline_runs_whole(spark, sf):
    import corpus_pipeline as cp

    assert len(cp.STAGES) == 5 and cp.run(spark, sf).count() > 0
