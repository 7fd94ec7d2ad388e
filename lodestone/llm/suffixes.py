"""Operator 1: suffix-array dedup. Removes bytes covered by a long enough string that also starts earlier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .anchors import Windows, digests, ordered, repeats, texts

WINDOW = 100


def byte_windows(length: int) -> Windows:
    return Windows(length=length, gram=max(1, length * 8 // 25), words=False, within=True)


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (S), the last one included."""
    n = len(t)
    s = np.ones(n, bool)
    if n > 1:
        differs = np.flatnonzero(t[1:] != t[:-1])
        nxt = np.searchsorted(differs, np.arange(n - 1))
        at = differs[np.minimum(nxt, len(differs) - 1)]
        s[:-1] = t[at] < t[at + 1]
    return s


def _induce_few(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix order from that of the leftmost S suffixes; a bucket at a time, for small alphabets.

    A bucket's suffixes stand in order when the scan reaches it, but for those whose predecessor in it is induced
    from within, by runs of its own symbol; these come in rounds. What it induces into later buckets keeps its
    order, so it can be appended all at once.
    """
    k = len(sizes)
    parts_l: list[list[np.ndarray]] = [[] for _ in range(k)]
    lms_by = np.split(lms, np.searchsorted(t[lms], np.arange(1, k)))
    whole_l: list[np.ndarray] = [np.zeros(0, np.int64)] * k

    def spread(pred: np.ndarray, into: list[list[np.ndarray]]) -> None:
        symbol = t[pred]
        order = np.argsort(symbol, kind="stable")
        pred, symbol = pred[order], symbol[order]
        edges = np.flatnonzero(np.diff(symbol, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            into[symbol[a]].append(pred[a:b])

    for c in range(k):
        if not sizes[c]:
            continue
        mine = np.concatenate(parts_l[c]) if parts_l[c] else np.zeros(0, np.int64)
        out, later = [], []
        while len(mine):
            out.append(mine)
            pred = mine[mine > 0] - 1
            pred = pred[~s[pred]]
            own = t[pred] == c
            later.append(pred[~own])
            mine = pred[own]
        whole_l[c] = np.concatenate(out) if out else np.zeros(0, np.int64)
        pred = lms_by[c][lms_by[c] > 0] - 1
        later.append(pred[~s[pred]])
        spread(np.concatenate(later), parts_l)
    parts_s: list[list[np.ndarray]] = [[] for _ in range(k)]  # from the largest down
    result: list[np.ndarray] = []
    for c in range(k - 1, -1, -1):
        if not sizes[c]:
            continue
        mine = np.concatenate(parts_s[c]) if parts_s[c] else np.zeros(0, np.int64)
        out, later = [], []
        while len(mine):
            out.append(mine)
            pred = mine[mine > 0] - 1
            pred = pred[s[pred]]
            own = t[pred] == c
            later.append(pred[~own])
            mine = pred[own]
        down = np.concatenate(out) if out else np.zeros(0, np.int64)
        if c == t[-1]:
            down = np.array([len(t) - 1])  # the sentinel is induced by nothing
            pred = down[down > 0] - 1
            later.append(pred[s[pred]])
        whole = whole_l[c][::-1]
        pred = whole[whole > 0] - 1
        later.append(pred[s[pred]])
        result += [down, whole]
        spread(np.concatenate(later), parts_s)
    return np.concatenate(result)[::-1]


def _induce_many(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same by two scans over the array, for the large alphabets of reduced strings."""
    n = len(t)
    tl, sl = t.tolist(), s.tolist()
    tail = np.cumsum(sizes)
    head = (tail - sizes).tolist()
    sa = [-1] * n
    end = tail.tolist()
    for i in lms[::-1].tolist():
        c = tl[i]
        end[c] -= 1
        sa[end[c]] = i
    for k in range(n):
        j = sa[k] - 1
        if j >= 0 and not sl[j]:
            c = tl[j]
            sa[head[c]] = j
            head[c] += 1
    end = tail.tolist()
    for k in range(n - 1, -1, -1):
        j = sa[k] - 1
        if j >= 0 and sl[j]:
            c = tl[j]
            end[c] -= 1
            sa[end[c]] = j
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array by induced sorting of integers >= 0 that end with a unique least one.

    Suffixes are classified, the substrings between leftmost S suffixes sorted by one induction and named, the
    string of names sorted by recursion where names repeat, and all suffixes induced from that.
    """
    n = len(t)
    if n <= 2:
        return np.arange(n, dtype=np.int64)[::-1].copy()
    s = _types(t)
    start = np.zeros(n, bool)
    start[1:] = s[1:] & ~s[:-1]
    lms = np.flatnonzero(start)
    sizes = np.bincount(t)
    induce = _induce_few if len(sizes) <= 1024 else _induce_many
    rough = induce(t, s, lms[np.argsort(t[lms], kind="stable")], sizes)
    rough = rough[start[rough]]
    length = np.zeros(n, np.int64)
    length[lms] = np.append(np.diff(lms), 0) + 1
    a, b = rough[:-1], rough[1:]
    differ = length[a] != length[b]
    alive, d = np.flatnonzero(~differ), 0
    while len(alive):
        ne = t[a[alive] + d] != t[b[alive] + d]
        differ[alive[ne]] = True
        d += 1
        alive = alive[~ne & (length[a[alive]] > d)]
    name = np.zeros(n, np.int64)
    name[rough] = np.concatenate([[0], np.cumsum(differ)])
    reduced = name[lms]
    if int(reduced.max()) + 1 == len(lms):
        order = np.empty(len(lms), np.int64)
        order[reduced] = np.arange(len(lms))
    else:
        order = suffix_array(reduced)
    sorted_lms = lms[order]
    return induce(t, s, sorted_lms[np.argsort(t[sorted_lms], kind="stable")], sizes)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix, by place in the text, with the one before it in suffix order.

    Where the symbols before both agree, it is one less than that of the suffix before; only the others are compared.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    fresh = np.ones(n, bool)
    ok = (phi > 0) & (at > 0)
    fresh[ok] = t[at[ok] - 1] != t[phi[ok] - 1]
    todo = np.flatnonzero(fresh)
    lcp = np.zeros(n, np.int64)
    live = todo[phi[todo] >= 0]
    d = 0
    while len(live):
        x, y = live + d, phi[live] + d
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[t[x] == t[y]]
        d += 1
        lcp[live] = d
    last = np.maximum.accumulate(np.where(fresh, at, 0))
    return np.maximum(lcp[last] - (at - last), 0)


def equal_windows(w: Windows, anchor: np.ndarray, uid: np.ndarray, at: np.ndarray, n: np.ndarray, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the windows of these segments that also start earlier, from their generalised suffix array."""
    sizes = np.array([len(u) + 1 for u in units], np.int64)
    text = np.frombuffer(b"\0".join(units) + b"\0", np.uint8)
    t = text.astype(np.int64) + 2
    first = np.cumsum(sizes) - sizes
    t[first + sizes - 1] = 1  # between segments; in no window
    t = np.append(t, 0)
    sa = suffix_array(t)
    plcp = permuted_lcp(t, sa)
    owner = np.full(len(t), -1, np.int64)
    windows = np.repeat(first, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    owner[windows] = np.repeat(np.arange(len(units)), n)
    group = np.cumsum(plcp[sa] < w.length)
    pick = owner[sa] >= 0
    place, group = sa[pick], group[pick]
    seg = owner[place]
    doc, start = uid[seg], at[seg] + place - first[seg]
    order = np.lexsort((start, doc, group))
    new = np.ones(len(order), bool)
    new[1:] = group[order[1:]] != group[order[:-1]]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = order[(doc[order] != doc[head]) | (start[order] != start[head])]
    return doc[later], start[later], start[later] + w.length


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    A byte goes if a string of `window` bytes that covers it also starts earlier: in a document with a smaller id,
    or earlier in its own. Strings are judged on the input. Null text is empty; texts shorter than a window keep
    all. Rows with null or repeated ids are documents of their own in order of (id, text), null ids last, so of
    two equal long rows the second loses everything; of equal strings the earliest start stays. A text of any length is
    judged whole, a long one hashed in overlapping parts. Only the id and the text are read: other columns may have any
    names. No rows: none.
    """
    w = byte_windows(window)
    return digests(w, repeats(ordered(docs, id_col, text_col), w, equal_windows)).withColumnRenamed("n_units", "n_bytes")


def dedup_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the repeated bytes, and without the documents that nothing is left of; columns as before."""
    w = byte_windows(window)
    rows = repeats(ordered(docs, keep=[c for c in docs.columns if c not in ("doc_id", "text")]), w, equal_windows)
    return texts(w, rows, docs)


QUERY = {"op1_suffix_dedup": lambda spark, sf_dir: dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
ORACLE = {
    "op1_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
byte AS (SELECT doc_id, i, substr(x, 2 * i - 1, 2) AS b, CASE WHEN 2 * i + 198 <= length(x) THEN md5(substr(x, 2 * i - 1, 200)) END AS h FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 + 1)) AS i FROM d)),
again AS (SELECT *, h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS s FROM byte),
near AS (SELECT doc_id, i, b, bool_or(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM again),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM near),
sums AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id)
"""
}
