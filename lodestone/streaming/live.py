"""Scoring a stream of documents, and keeping an index fresh from one (survey §2.13)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.analysis import analyze

#: Terms that are scored by one map in the plan; more are looked up in a broadcast dictionary.
MAP_TERMS = 10_000


def score_stream(stream: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, overlap) of each document of a stream by weighted terms (term, boost): a stream-static join.

    The weights become one map, or beyond MAP_TERMS a dictionary that the driver and workers hold whole; a document is
    scored within its row, and so there is no state to keep.
    """
    few = terms.limit(MAP_TERMS + 1).collect()
    if len(few) > MAP_TERMS:
        return _score_by_dictionary(stream, {r["term"]: float(r["boost"]) for r in terms.select("term", "boost").collect()}, key, text)
    weights = {r["term"]: float(r["boost"]) for r in few}
    table = F.create_map(*[x for t, b in weights.items() for x in (F.lit(t), F.lit(b))]) if weights else F.create_map().cast("map<string,double>")
    found = F.filter(F.transform(F.array_distinct(analyze(F.col(text))), lambda t: F.try_element_at(table, t)), lambda w: w.isNotNull())
    return stream.select(key, F.aggregate(found, F.lit(0.0), lambda s, w: s + w).alias("score"), F.size(found).alias("overlap")).where("overlap > 0")


def _score_by_dictionary(stream: DataFrame, weights: dict[str, float], key: str, text: str) -> DataFrame:
    handle = stream.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = handle.value
        for batch in batches:
            found = [[weights[t] for t in ts or () if t in weights] for ts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sum(x) for x in found], pa.float64()), pa.array([len(x) for x in found], pa.int32())], [key, "score", "overlap"])

    schema = T.StructType([stream.select(key).schema[0], T.StructField("score", T.DoubleType()), T.StructField("overlap", T.IntegerType())])
    return stream.select(key, F.array_distinct(analyze(F.col(text)))).mapInArrow(run, schema).where("overlap > 0")


def term_counts(stream: DataFrame, time: str, text: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, term, count) with a watermark; times without a zone are taken in the session's."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).select(F.col(time), F.explode(analyze(F.col(text))).alias("term"))
    return rows.groupBy(F.window(time, width).alias("window"), "term").agg(F.count(F.lit(1)).alias("count"))


def rebuild_on_commit(stream: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Calls rebuild(batch, number) for every micro-batch: indexes that follow their source."""
    writer = stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
