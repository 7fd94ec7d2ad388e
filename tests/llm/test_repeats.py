import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm import anchors, substrings, suffixes

from .helpers import ODD, documents, twins


def brute_bytes(docs, width=100):
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] is not None, (d[1] or "").encode())):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - width + 1):
            s = raw[p : p + width]
            if s in seen:
                gone[p : p + width] = True
            seen.add(s)
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(docs, width=50):
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] is not None, (d[1] or "").encode())):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = np.zeros(len(words), bool)
        own = []
        for p in range(len(words) - width + 1):
            s = tuple(words[p : p + width])
            gone[p : p + width] |= s in seen
            own.append(s)
        seen.update(own)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def key(rows):
    return sorted(map(repr, rows))


def both(spark, docs):
    df = documents(spark, docs)
    got = suffixes.dedup_bytes(df).collect()
    assert key((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == key(brute_bytes(docs))
    got = substrings.dedup_words(df).collect()
    assert key((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == key(brute_words(docs))


def test_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    both(spark, docs)


@pytest.mark.parametrize(("hot", "crowd"), [(512, 4096), (1, 4096), (1, 1), (0, 0)])
def test_near_copies_and_shared_passages(spark, hot, crowd, monkeypatch):
    monkeypatch.setattr(anchors, "HOT", hot)
    monkeypatch.setattr(anchors, "CROWD", crowd)
    monkeypatch.setattr(anchors, "FLUSH", 1 << 16)
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 5, rng.integers(1, 7)))
    base = [word() for _ in range(600)]
    passage = [word() for _ in range(80)]
    docs = []
    for i in range(120):
        t = list(base) if i % 3 else [word() for _ in range(int(rng.integers(1, 300)))]
        for _ in range(int(rng.integers(0, 6))):
            t[int(rng.integers(len(t)))] = word()
        if i % 4 == 0:
            at = int(rng.integers(len(t)))
            t[at:at] = passage[int(rng.integers(0, 20)) :] * int(rng.integers(1, 3))
        docs.append((i * 7 % 120, (" ", "\n", "  ", "\t")[i % 4].join(t)))
    both(spark, docs)


def test_odd(spark):
    both(spark, [*ODD, (30, "x y " * 5000), (31, "é字" * 300 + "q" + "字é" * 300), (32, " ".join(str(i) for i in range(500))), (33, " ".join(str(i) for i in range(250, 700)) + "é" * 90)])
    both(spark, [(1, "a" * 99), (2, "a" * 100), (3, "a" * 101), (4, "a" * 250)])
    assert suffixes.dedup_bytes(documents(spark, [])).count() == substrings.dedup_words(documents(spark, [])).count() == 0


@pytest.mark.parametrize("footer", [97, 150])
def test_footer_of_many_documents(spark, footer, monkeypatch):
    """A passage that all documents share between texts of their own doesn't bring them to one task."""
    monkeypatch.setattr(anchors, "CROWD", 50)
    rng = np.random.default_rng(2)
    letters = lambda k: "".join(chr(97 + c) for c in rng.integers(0, 26, k))
    shared = letters(footer)
    docs = [(i, letters(90) + shared + letters(90)) for i in range(1500)]
    got = suffixes.dedup_bytes(documents(spark, docs)).collect()
    assert key((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == key(brute_bytes(docs))
    w = suffixes.byte_windows(100)
    rows = anchors.ordered(documents(spark, docs))
    counted = anchors.candidates(rows, w)[0].where("units IS NOT NULL").groupBy("anchor").count()
    assert counted.agg({"count": "max"}).first()[0] <= 50


@pytest.mark.parametrize("hot", [512, 0])
def test_structured_words(spark, hot, monkeypatch):
    monkeypatch.setattr(anchors, "HOT", hot)
    x, y = twins()
    words = [f"w{i}" for i in range(60)]
    docs = [(k, " ".join([*words[:30], t, *words[30:]])) for k, t in enumerate((x, y, x + "c", y + "c"))]
    both(spark, docs)
    short, other = twins(6)
    both(spark, [(1, " ".join(short)), (2, " ".join(other)), (3, " ".join(short + other)), (4, short * 3), (5, other * 3)])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.integers(1, 3), max_size=80), st.lists(st.integers(1, 2), max_size=200), st.lists(st.integers(1, 3000), max_size=60)))
def test_suffix_array(values):
    t = np.array([*values, 0], np.int64)
    sa = suffixes.suffix_array(t)
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert sa.tolist() == want
    plcp = suffixes.permuted_lcp(t, sa)
    for k in range(1, len(t)):
        a, b = t[want[k - 1] :], t[want[k] :]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert plcp[want[k]] == n
    s = suffixes._types(t)
    lms = np.flatnonzero(np.r_[False, s[1:] & ~s[:-1]])
    if len(lms):
        order = np.array(sorted(lms, key=lambda i: t[i:].tolist()))
        assert suffixes._induce_many(t, s, order, np.bincount(t)).tolist() == want == suffixes._induce_few(t, s, order, np.bincount(t)).tolist()


def test_texts_keep_columns_and_characters(spark):
    passage = "é" * 49 + "0123456789"
    docs = documents(spark, [(1, "a " + passage), (2, "字" + passage[1:] + "字"), (3, "x"), (4, None), (5, ""), (6, "b" * 200), (7, "b" * 200)])
    got = {r.doc_id: r for r in suffixes.dedup_texts(docs).collect()}
    assert suffixes.dedup_texts(docs).columns == docs.columns
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[4].text is None and got[5].text == ""
    assert got[6].text == "b" and got[6].n_chars == 1 and got[6].size == "x"
    assert "�" not in got[2].text and got[2].text.startswith("字")
