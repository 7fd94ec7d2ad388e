"""A collection with a written inverted index (SRC2, AGG1, AGG2): a request reads its terms' postings, not the documents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collection import Collection
from .shared import shared_path, source_state

#: Bytes of a source for each bucket of terms, and the bounds of the number of buckets.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 32 << 20, 16, 4096


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("field", "term"), F.lit(buckets)).cast("int")


@dataclass
class IndexedCollection(Collection):
    """Postings in folders by bucket of (field, term), a table of terms with their frequencies, and the number of
    documents, all under `path`. Analysis with limits or noise words still reads the documents."""

    path: str = ""
    buckets: int = LEAST_BUCKETS

    @staticmethod
    def build(collection: Collection, path: str) -> IndexedCollection:
        """Documents are counted term by term within their partition; postings then go to their buckets. A bucket's
        postings are split by key among tasks, so that no frequent term is one task's."""
        spark, size = collection.df.sparkSession, collection.source_bytes()
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, size // BUCKET_BYTES))
        salts = max(1, 4 * size // (buckets * BUCKET_BYTES))
        rows = collection.tf(collection.fields).withColumn("bucket", bucket_of(buckets))
        salted = rows.repartition("bucket", F.pmod(F.xxhash64(collection.key), F.lit(salts)))
        salted.sortWithinPartitions("bucket", "field", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        made = IndexedCollection(collection.df, collection.key, collection.text, collection.keyword, collection.payload, path=path, buckets=buckets)
        terms = made._postings().groupBy("bucket", "field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("freq").alias("total"))
        terms.repartition("bucket").sortWithinPartitions("bucket", "field", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
        collection.df.agg(F.count(F.lit(1)).alias("n_docs")).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/stats")
        return IndexedCollection.open(collection, path)

    @staticmethod
    def open(collection: Collection, path: str) -> IndexedCollection:
        one = collection.df.sparkSession.read.parquet(f"{path}/stats").first()
        return IndexedCollection(collection.df, collection.key, collection.text, collection.keyword, collection.payload, one.n_docs, path=path, buckets=one.buckets)

    def _postings(self) -> DataFrame:
        kinds = dict(self.df.dtypes)
        schema = f"`{self.key}` {kinds[self.key]}, field string, len int, term string, freq long, payload double, bucket int"
        return self.df.sparkSession.read.schema(schema).parquet(f"{self.path}/postings")

    def _terms(self) -> DataFrame:
        return self.df.sparkSession.read.schema("field string, term string, df long, total long, bucket int").parquet(f"{self.path}/terms")

    def _pick(self, table: DataFrame, fields: Sequence[str], only: DataFrame | None) -> DataFrame:
        """Rows of these fields, and of the terms in `only`: of their buckets alone, if they are few."""
        table = table.where(F.col("field").isin(list(fields)))
        if only is None:
            return table
        few = self.local_pairs(only, bucket_of(self.buckets))
        if few is None:
            return table.join(only.select("field", "term").distinct(), ["field", "term"], "left_semi")
        if not few:
            return table.limit(0)
        by: dict[str, list[str]] = {}
        for field, term, _ in few:
            by.setdefault(field, []).append(term)
        wanted = F.lit(False)
        for field, terms in by.items():
            wanted = wanted | ((F.col("field") == field) & F.col("term").isin(terms))
        return table.where(F.col("bucket").isin(sorted({b for *_, b in few})) & wanted)

    def tf(self, fields: Sequence[str], only: DataFrame | None = None, **how: object) -> DataFrame:
        if how:
            return Collection.tf(self, fields, only, **how)
        return self._pick(self._postings(), fields, only).select(self.key, "field", "len", "term", "freq", "payload")

    def df_table(self, fields: Sequence[str], only: DataFrame | None = None) -> DataFrame:
        return self._pick(self._terms(), fields, only).select("field", "term", "df", "total")


#: (session, source, its state) -> (path, documents, buckets) of an index.
_kept: dict[tuple, tuple[str, int, int]] = {}


def _state(collection: Collection, source: str) -> tuple[tuple, tuple]:
    """(name of an index in _kept, the same with the source's state now)."""
    spark = collection.df.sparkSession
    name = (spark.sparkContext.applicationId, source, collection.key, collection.text, collection.keyword, collection.payload)
    return name, (*name, *source_state(spark, source))


def held(collection: Collection, source: str) -> Collection:
    """The collection with the index that kept() built of the source as it is now; without one, as it stands: a request
    or two are read from the documents in less time than an index of them takes."""
    return kept(collection, source) if _state(collection, source)[1] in _kept else collection


def kept(collection: Collection, source: str) -> IndexedCollection:
    """The collection with an index in the shared folder, built when a session first asks for it and again when the
    source at this path has changed."""
    spark = collection.df.sparkSession
    name, now = _state(collection, source)
    if now not in _kept:
        for old in [k for k in _kept if k[: len(name)] == name or k[0] != name[0]]:
            del _kept[old]
        made = IndexedCollection.build(collection, shared_path(spark, "index"))
        _kept[now] = made.path, made.n_docs, made.buckets
    path, n, buckets = _kept[now]
    return IndexedCollection(collection.df, collection.key, collection.text, collection.keyword, collection.payload, n, path=path, buckets=buckets)
