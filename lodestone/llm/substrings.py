"""Operator 8: substring dedup by seed and extend. Removes words covered by long word sequences of earlier documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .anchors import Windows, digests, ordered, repeats, segments
from .common import word_hashes, word_spans

WORDS = 50


def extend(w: Windows, anchor: np.ndarray, uid: np.ndarray, at: np.ndarray, n: np.ndarray, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the windows of these segments that are also in a document with a smaller uid.

    The seed is the anchor that segments share. Its occurrences are extended a word at a time, to the right and to
    the left; a step splits those that agreed so far by their next word. Two windows with as many words left of the
    seed are equal if both their extensions agree, so each is known by the classes at its two ends. Every
    occurrence takes part once a step: no pairs are formed. Neighbouring windows make up the maximal repeats.
    """
    buf = np.frombuffer(b"".join(units), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(u) for u in units])])
    starts, ends, first = word_spans(buf, bounds)
    words = word_hashes(buf, starts, ends)
    seed_at = np.empty(len(units), np.int64)
    _, word = np.unique(words, return_inverse=True)
    seg, _, place, *_ = segments(words, first, w)
    owner = np.searchsorted(first, seg, "right") - 1
    seen, row = np.unique(owner, return_index=True)
    seed_at[seen] = place[row]
    _, seed = np.unique(anchor, return_inverse=True)
    # classes of the seeds' own words first: anchors are hashes, and may be of more than one n-gram
    for k in range(w.gram):
        _, seed = np.unique(seed * (len(words) + 1) + word[seed_at + k], return_inverse=True)
    reach = w.places - 1
    sides = []
    for step, base in ((1, seed_at + w.gram - 1), (-1, seed_at)):
        classes, cls = [seed], seed
        for k in range(1, reach + 1):
            p = base + step * k
            inside = (p >= first[:-1]) & (p < first[1:])
            nxt = np.where(inside, word[np.clip(p, 0, max(len(word) - 1, 0))], len(words))
            _, cls = np.unique(cls * (len(words) + 1) + nxt, return_inverse=True)
            classes.append(cls)
        sides.append(classes)
    right, left = sides
    found = []
    for k in range(reach + 1):  # words left of the seed
        start = seed_at - first[:-1] - k
        i = np.flatnonzero((start >= 0) & (start < n))
        if not len(i):
            continue
        _, key = np.unique(left[k][i] * (len(units) + 1) + right[reach - k][i], return_inverse=True)
        least = np.full(int(key.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, key, uid[i])
        later = i[uid[i] > least[key]]
        found.append((uid[later], at[later] + start[later]))
    doc, start = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return doc, start, start + w.length


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    A word goes if a window of `window` words of its document that covers it is also in a document with a smaller
    id. Windows are judged on the input; repeats within one document stay. Null text has no words and, like empty
    text, the hash of nothing. Rows with null or repeated ids are documents of their own in order of (id, text),
    null ids last; of equal windows those of the first document stay. A text of any length is judged whole, a long one
    hashed in overlapping parts. Only the id and the text are read: other columns may have any names. No rows: none.
    """
    w = Windows(window, max(1, window * 2 // 5), True, False)
    rows = digests(w, repeats(ordered(docs, id_col, text_col), w, extend))
    return rows.select("doc_id", rows.n_units.alias("n_words"), "n_removed", "kept_sha256", "n_spans")


QUERY = {"op8_substring_dedup": lambda spark, sf_dir: dedup_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
ORACLE = {
    "op8_substring_dedup": r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
again AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS first FROM win GROUP BY h) f USING (h) WHERE doc_id > first),
near AS (SELECT *, max(s) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM (SELECT word.*, again.i AS s FROM word LEFT JOIN again ON word.doc_id = again.doc_id AND word.j = again.i)),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS opens FROM near),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans FROM w LEFT JOIN sums USING (doc_id)
"""
}
