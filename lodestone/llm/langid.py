"""Operator 5: language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, as_bytes, blocks, prepare

BUCKETS, ORDERS = 4096, (1, 2, 3, 4)
#: Labelled texts that a model is fitted on: the bound of its sample.
SAMPLE = 2000
UNKNOWN = "und"


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of each text's hashed byte n-grams, one row a text (all 0 for an empty one)."""
    n = len(offsets) - 1
    counts = np.zeros((n, BUCKETS), np.float32)
    for lo, hi in blocks(offsets, 1 << 18):
        part = ASCII_LOWER[buf[offsets[lo] : offsets[hi]]].astype(np.uint32)
        off = offsets[lo : hi + 1] - offsets[lo]
        of = np.repeat(np.arange(hi - lo, dtype=np.int64) * BUCKETS, np.diff(off))
        total = np.zeros((hi - lo + 1) * BUCKETS, np.int64)
        for k in ORDERS:
            if len(part) < k:
                break
            code = part[: len(part) - k + 1] + np.uint32(k * 977)
            for j in range(1, k):
                code = code * np.uint32(0x01000193) + part[j : len(part) - k + 1 + j]
            at = of[: len(code)] + ((code * np.uint32(0x9E3779B1)) >> np.uint32(20))
            if k > 1:
                across = (off[1:-1, None] - np.arange(1, k)).ravel()
                at[across[(across >= 0) & (across < len(at))]] = (hi - lo) * BUCKETS
            total += np.bincount(at, minlength=len(total))
        counts[lo:hi] = total[: (hi - lo) * BUCKETS].reshape(-1, BUCKETS)
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


@dataclass
class LanguageModel:
    """weights: embedding table times output layer, so that a text's logits are its shares times weights."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    accuracy: float

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (x @ self.weights + self.bias) / self.temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, np.minimum(p[np.arange(len(p)), best], 1.0)


def fit(x: np.ndarray, labels: list[str], dim: int = 16, steps: int = 1000, batch: int = 32, rate: float = 1.0, seed: int = 7) -> LanguageModel:
    """Minibatch SGD on the embeddings and the output layer; a quarter of the sample calibrates.

    The temperature minimises the log loss of that quarter; the threshold rejects at most one in a thousand of the
    texts there that are identified rightly, and nothing scored above 0.5.
    """
    langs = sorted(set(labels))
    y = np.array([langs.index(v) for v in labels])
    if len(langs) < 2:
        return LanguageModel(langs, np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs), np.float32), 1.0, 0.0, 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[: len(y) // 4] if len(y) >= 40 else order
    train = order[len(y) // 4 :] if len(y) >= 40 else order
    squares = np.concatenate([(x[train, k : k + 256] ** 2).mean(0) for k in range(0, BUCKETS, 256)])
    scale = 1 / np.sqrt(np.maximum(squares, 1e-9))
    scale = np.minimum(scale, 1 / np.sqrt(1e-6)).astype(np.float32)
    e = (rng.normal(0, 0.1, (BUCKETS, dim))).astype(np.float32)
    w, b = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    epochs = max(1, steps * batch // max(1, len(train)))
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs) + 0.01)
        rng.shuffle(train)
        for i in range(0, len(train), batch):
            rows = train[i : i + batch]
            xs = x[rows] * scale / np.sqrt(BUCKETS)
            h = xs @ e
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            down = p @ w.T
            w -= step * (h.T @ p)
            b -= step * p.sum(0)
            e -= step * (xs.T @ down)
    weights = (scale / np.float32(np.sqrt(BUCKETS)))[:, None] * (e @ w)
    z = x[held] @ weights + b

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(held)), y[held]]))

    temperature = min(np.geomspace(0.5, 8, 33), key=loss)
    model = LanguageModel(langs, weights.astype(np.float32), b, float(temperature), 0.0, 0.0)
    best, score = model.scores(x[held])
    right = score[best == y[held]]
    model.threshold = float(min(0.5, np.quantile(right, 0.001) * 0.9)) if len(right) else 0.0
    model.accuracy = float((best == y[held]).mean())
    return model


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Fit on at most `sample` usable labelled texts, as many a language as that allows, chosen by hash of the id, or of
    the text where the id is null."""
    prepare(docs.sparkSession)
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = labelled.withColumn("twin", F.when(F.col("id").isNull(), F.xxhash64("text")))
    ids = labelled.select("id", "twin", "lang", F.coalesce("twin", F.xxhash64("id")).alias("h"))
    each = max(1, sample // max(1, ids.select("lang").distinct().count()))
    chosen = ids.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("n") <= each).orderBy("n", "h").limit(sample).select("id", "twin").distinct().collect()
    if not chosen:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0, 0.0)
    picked = docs.sparkSession.createDataFrame(chosen, "__id long, __twin long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*as_bytes(batch.column("text")))
            where = [np.flatnonzero(r).astype(np.int16) for r in x]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("twin"), batch.column("lang"), pa.array([w.tobytes() for w in where], pa.binary()), pa.array([r[w].tobytes() for r, w in zip(x, where, strict=True)], pa.binary())], ["id", "twin", "lang", "at", "share"])

    same = F.col("id").eqNullSafe(F.col("__id")) & F.col("twin").eqNullSafe(F.col("__twin"))
    rows = labelled.join(F.broadcast(picked), same).select("id", "twin", "lang", "text").mapInArrow(run, "id long, twin long, lang string, at binary, share binary").orderBy("id", "lang", "twin").limit(2 * sample).collect()
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["share"], np.float32)
    labels = [r["lang"] for r in rows]
    del rows
    return fit(x, labels)


def _judge(model: LanguageModel, text: pa.Array, lettered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, rejected) of texts."""
    if not model.langs:
        lettered = np.zeros(len(lettered), bool)
    lang, score = np.full(len(lettered), UNKNOWN, object), np.zeros(len(lettered))
    buf, off = as_bytes(text)
    for lo in range(0, len(lettered), 512):
        hi = min(lo + 512, len(lettered))
        if lettered[lo:hi].any():
            best, p = model.scores(features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
            lang[lo:hi] = np.where(lettered[lo:hi], np.array(model.langs, object)[best], UNKNOWN)
            score[lo:hi] = np.where(lettered[lo:hi], p, 0.0)
    return lang, score, ~lettered | (score < model.threshold)


def _lettered(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected of every text.

    A text that is null or has no letter is `und`, scored 0 and rejected, and so is any if the model knows no
    language. Another is rejected if its calibrated score is below the model's threshold. Equal scores go to the language
    that sorts first. Null and repeated ids are kept, a row each; texts of any length are read whole. No rows: none.
    """
    prepare(docs.sparkSession)
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = _judge(handle.value, batch.column("text"), np.array(batch.column("lettered").to_pylist(), bool))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _lettered(F.col(text_col)).alias("lettered"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the model doesn't reject; a null language becomes the predicted one. No shuffle.

    A model that knows no language can't reject: all rows whose text has a letter stay.
    """
    prepare(docs.sparkSession)
    handle, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            text = row.field(names.index(text_col))
            lettered = np.array(batch.column("lettered").to_pylist(), bool)
            lang, _, rejected = _judge(handle.value, text, lettered)
            if not handle.value.langs:
                rejected = ~lettered
            columns = [row.field(i) for i in range(len(names))]
            if lang_col in names:
                columns[names.index(lang_col)] = pc.coalesce(row.field(names.index(lang_col)), pa.array(lang, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(~rejected))

    return docs.select(F.struct(*docs.columns).alias("row"), _lettered(F.col(text_col)).alias("lettered")).mapInArrow(run, docs.schema)


def fold(id_col: str = "doc_id", folds: int = 3) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents outside the held-out third and predict every document: what predict() gives, and
    held_out.

    Texts of any length are read whole. A document without an id is neither held out nor learned from; repeated rows
    count each. Equal scores go to the language that sorts first. Other columns may have any names. No rows: none.
    """
    held = F.coalesce(fold() == 1, F.lit(False))
    model = train(docs, F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3)) != 1)
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


QUERY = {"op5_language_id": lambda spark, sf_dir: identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
ORACLE: dict[str, str] = {}
