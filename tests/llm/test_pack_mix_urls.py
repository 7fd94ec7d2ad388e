import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm import mixing, packing, urls

from .helpers import ODD, documents


def check_packing(rows, length=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    return [np.array([*e.ids, 0], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def check_pieces(docs, rows):
    want = defaultdict(int)
    for (i, _), ids in zip(docs, whole_ids([t or "" for _, t in docs]), strict=True):
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert got == want


def test_pack_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    check_pieces([(r.doc_id, r.text) for r in docs.collect()], rows)
    n, total = check_packing(rows), sum(r.length for r in rows)
    assert n <= -(-total // 2048) * 1.02 + 2


def test_pack_odd(spark):
    odd = [*ODD, (20, "a<|endoftext|>b <|startoftext|> ΑΣ ΟΔΟΣ. e\u0301 \u0301x it's I'LL ﬁ 12"), (21, "x" * 20000)]
    rows = packing.pack_documents(documents(spark, odd)).collect()
    check_pieces(odd, rows)
    check_packing(rows)
    assert packing.pack_documents(documents(spark, [])).count() == 0


def one_at_a_time(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return sorted(gaps)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.booleans()), max_size=120), st.integers(1, 5))
def test_sweeps_are_successors_by_rank(items, parts):
    items = sorted(items, key=lambda x: (-x[0], not x[1]))
    free, want, alone = [], [], []
    for k, (_, gap) in enumerate(items):
        if gap:
            free.append(k)
        elif free:
            want.append((k, free.pop()))
        else:
            alone.append(k)
    edges = [len(items) * k // parts for k in range(parts + 1)]
    got, rest = [], {}
    for part, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        p, g, left, spare = packing.nest(np.array([gap for _, gap in items[a:b]], bool))
        got += zip((a + p).tolist(), (a + g).tolist(), strict=True)
        rest[part] = (a + left).tolist(), (a + spare).tolist()[::-1]
    for part, rank, n, at, first in packing.nest_rest([(k, len(p), len(g)) for k, (p, g) in rest.items()]):
        got += zip(rest[part][0][rank : rank + n], rest[at][1][first : first + n], strict=True)
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("task_rows", [400, 100_000])
def test_pack_in_ranges(spark, task_rows):
    pieces = spark.range(5000).selectExpr("id doc_id", "0 piece", "0L start", "1L + id % 7 * (id % 3) length", "id ids_crc32")
    rows = packing.pack(pieces, 16, task_rows).collect()
    assert len(rows) == 5000 and check_packing(rows, 16) <= -(-sum(r.length for r in rows) // 16) + 2


def test_pack_tight(spark):
    """Against best fit decreasing, one piece at a time: few sizes, none that fill up a sequence."""
    rng = np.random.default_rng(3)
    for sizes in ([700] * 300, rng.integers(300, 1300, 400).tolist(), [2048] * 5 + [1] * 50 + rng.geometric(0.01, 300).clip(1, 2048).tolist()):
        pieces = spark.createDataFrame([(k, 0, 0, int(s), 1) for k, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
        rows = packing.pack(pieces, 2048).collect()
        assert len(rows) == len(sizes) and check_packing(rows) <= len(one_at_a_time(sizes, 2048)) * 1.03 + 2


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / w for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("hot", [False, True])
def test_mix(spark, hot):
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(["w"] * int(rng.integers(0, 90))), "en", "b" if hot and i % 2 else [None, "a", "b", "é", "z"][i % 5]) for i in range(400)] + [(1000, None, "en", "q"), (1001, "one", "en", "r")]
    df = documents(spark, docs)
    got = mixing.mix_sources(df, block=4, shard_words=500, least_shard=100).collect()
    size = {d[0]: len(re.findall(mixing.WORD, d[1] or "")) for d in docs}
    source = {d[0]: d[3] for d in docs}
    sizes, taken = defaultdict(int), defaultdict(int)
    for d in docs:
        sizes[d[3]] += size[d[0]]
    want = brute_targets(sizes)
    assert len(got) == len(docs)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * 4, (s, taken[s], want[s])
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(df.repartition(7), block=4, shard_words=500, least_shard=100).collect()))
    mixed = mixing.mix_texts(df, block=4, shard_words=500, least_shard=100).collect()
    words = defaultdict(int)
    for r in mixed:
        words[r.doc_id] += len(re.findall(mixing.WORD, r.text))
    assert {k: v for k, v in words.items() if v} == {r.doc_id: r.taken for r in got if r.taken}


def test_mixed_blocks_are_spread(spark):
    """Of a source that is taken in part, blocks of many documents are drawn, not a front of them."""
    docs = [(i, " ".join([f"w{i}"] * 160), "en", "a" if i < 40 else "b") for i in range(80)]
    got = {r.doc_id: r.taken for r in mixing.mix_sources(documents(spark, docs)).collect()}
    assert sum(got.values()) == 80 * 160
    part = [got[i] % 160 for i in range(40)]
    assert sum(0 < t < 160 for t in part) >= 10 and all(t % 16 == 0 for t in part)


def test_sainte_lague_is_highest_quotients(spark):
    rng = np.random.default_rng(2)
    for seats in (0, 1, 7, 100, 1003):
        votes = [int(v) for v in rng.integers(0, 500, 23)] + [100_000, 300, 300]
        df = spark.createDataFrame(list(enumerate(votes)), "p long, v long")
        got = {r.p: r.seats for r in mixing.sainte_lague(df, ["p"], "v", mixing.F.lit(seats), order=["p"]).collect()}
        best = sorted(((-v / (2 * k + 1), p, k) for p, v in enumerate(votes) if v for k in range(seats + 1)))[:seats]
        assert got == {p: sum(1 for b in best if b[1] == p) for p in range(len(votes))}


def test_mixed_texts_of_odd_rows(spark):
    df = documents(spark, [*ODD, (1, "again one two three")])
    words = sum(len(re.findall(mixing.WORD, r.text)) for r in mixing.mix_texts(df).collect())
    assert words == sum(r.taken for r in mixing.mix_sources(df).collect()) > 0
    assert mixing.mix_texts(df.where("false")).count() == 0


def test_mix_odd(spark):
    got = mixing.mix_sources(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix_sources(documents(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h + p), h + p) for _, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


def test_urls(spark):
    found = ["http://A.Example.ORG/es/x?y", "http://example.org", "http://example.org/", "https://x.com/de/1#t", "com/de/", None, "", "://", "://org/", "a://b://c/d", "http://notexample.org/en/12", "http://example.org/en/12", "http://x.com?/de/", "http://x.com:80/de/", "http://u@x.com/fr/\n?z", "HTTP://ÀB.com/fr/", "http://com/de/#"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(found)] + [(None, "http://x.com/", "c"), (0, found[0], "c")], "page_id long, url string, host string")
    got = urls.filter_urls(df).collect()
    assert len(got) == len(found) + 2
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule) == brute_url(found[r.page_id])
        if r.rule:
            assert r.verdict == ("allow" if r.rule in ("org/", "com/fr/") else "block")
    assert urls.filter_urls(df.where("false")).count() == 0


def test_reputation_shrinks_to_domain(spark):
    pages = [(f"http://bad{i % 3}.evil.com/{i}", 1) for i in range(60)] + [(f"http://ok{i % 5}.good.com/{i}", 0) for i in range(100)] + [("http://bad0.evil.com/new", None), ("http://ok1.good.com/new", None), ("http://unseen.net/", None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, is_bad int")
    got = {r.page_id: r.verdict for r in urls.filter_urls(df, rules=(), bad=urls.F.col("is_bad")).collect()}
    assert (got[160], got[161], got[162]) == ("block", "allow", "allow")
    rep = {r.host: r for r in urls.host_reputation(spark.createDataFrame([("a.x.com", 1)] + [("b.x.com", 1)] * 30 + [("c.y.com", 0)] * 30, "host string, bad int")).collect()}
    assert rep["a.x.com"]["mean"] > 0.6 and rep["a.x.com"].sd > rep["b.x.com"].sd


def test_reputation_of_hosts_without_labels(spark):
    bad, good = [(f"http://bad{i % 3}.evil.com/{i}", 1) for i in range(60)], [(f"http://ok{i % 5}.good.com/{i}", 0) for i in range(100)]
    worse = [(f"http://h{i % 4}.d{i % 20}.bad/{i}", 1) for i in range(200)]
    new = [("http://bad9.evil.com/", None), ("http://ok9.good.com/", None), ("http://x.unseen.bad/", None), ("http://x.unseen.net/", None)]

    def verdicts(pages):
        df = spark.createDataFrame([(i, *p) for i, p in enumerate([*pages, *new])], "page_id long, url string, is_bad int")
        rows = urls.filter_urls(df, rules=(), bad=urls.F.col("is_bad")).collect()
        assert len(rows) == len(pages) + len(new)
        return [r.verdict for r in sorted(rows, key=lambda r: r.page_id)[len(pages) :]]

    assert verdicts(bad + good)[:2] == ["block", "allow"]
    assert verdicts(bad + good + worse + good * 3) == ["block", "allow", "block", "allow"]
    assert verdicts([]) == ["allow"] * 4


def test_levels_of_names(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "a.b.com", "com", "", "a.b.com:8080", "x.y.gov.au:1"]
    domain, suffix = urls.name_levels(urls.F.col("h"))
    got = [tuple(r) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(domain, suffix).collect()]
    assert got == [("b.co.uk", "co.uk")] * 2 + [("co.uk", "co.uk"), ("b.com", "com"), ("com", "com"), ("", ""), ("b.com", "com"), ("y.gov.au", "gov.au")]


def test_sql_judges_hosts_without_labels(spark, tmp_path):
    """The SQL of the query blocks what the query blocks where rules label nearly all of a suffix as bad."""
    import duckdb

    pages = [f"http://h{i % 7}.d{i % 3}.com/de/{i}" for i in range(300)] + [f"http://ok{i % 9}.fine.org/{i}" for i in range(200)] + ["http://new.d1.com/x", "http://other.com/x", "http://a.b.net/", "http://h1.d1.com:80/x", None, "http://a.co.uk/"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted((tuple(r[c] for c in columns) for r in urls.QUERY["op9_filter_urls"](spark, str(tmp_path)).collect()), key=lambda r: r[0])
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({urls.ORACLE['op9_filter_urls']}) ORDER BY page_id").fetchall()
    assert got == want
    assert [r[4] for r in got[-6:]] == ["block", "block", "allow", "block", "allow", "allow"]
