"""A collection of documents and its inverted index as lazy DataFrames (survey §1, SRC1-SRC4, SRC12, AGG1, AGG2)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.analysis import analyze, drop_noise
from lodestone.plans.syntax import Scope

#: Terms up to which a request's terms are made literal.
MAX_LOCAL = 10_000
#: Tables between these sizes (the larger times the cores) are spread over the cores before they are analysed.
MIN_BYTES, SPLIT_BYTES = 1 << 20, 64 << 20
#: Bytes of a source for each partition in which terms are counted, so that what a task holds doesn't grow with the
#: table; the most partitions, and the size from which Catalyst's estimate means that it has none.
COUNT_BYTES, MOST_PARTS, UNKNOWN_BYTES = 4 << 20, 8192, 1 << 50


@dataclass
class Collection:
    """df with a key, analysed text fields, exact keyword fields and payload fields.

    A keyword field's token is its value. A payload field is an array of weights whose tokens are their indices, or
    of structs (term, payload).
    """

    df: DataFrame
    key: str = "doc_id"
    text: tuple[str, ...] = ("text",)
    keyword: tuple[str, ...] = ()
    payload: tuple[str, ...] = ()
    _size: int | None = field(default=None, repr=False)
    _spread: DataFrame | None = field(default=None, repr=False)

    @property
    def fields(self) -> tuple[str, ...]:
        """SRC12: all fields that are indexed."""
        return (*self.text, *self.keyword, *self.payload)

    @property
    def scope(self) -> Scope:
        return Scope(self.text, self.keyword, self.text)

    def source_bytes(self) -> int:
        """Catalyst's estimate of the bytes that df is made from."""
        leaves = self.df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))

    def spread(self) -> DataFrame:
        """df, over all cores where its files are too small to be split among them; a large table is read as it lies."""
        if self._spread is None:
            cores = self.df.sparkSession.sparkContext.defaultParallelism
            small = cores > 1 and not self.df.isStreaming and MIN_BYTES < self.source_bytes() < cores * SPLIT_BYTES
            self._spread = self.df.repartition(cores) if small else self.df
        return self._spread

    def parts(self) -> int | None:
        """Partitions for a table that grows with df; None where its size is not known."""
        size = self.source_bytes()
        least = self.df.sparkSession.sparkContext.defaultParallelism if size > MIN_BYTES else 1
        return None if size >= UNKNOWN_BYTES else min(MOST_PARTS, max(least, -(-size // COUNT_BYTES)))

    def by_key(self, source: DataFrame, *columns: str) -> DataFrame:
        """These columns of source, rows of one key together."""
        n, rows = self.parts(), source.select(*dict.fromkeys([self.key, *columns]))
        return rows.repartition(self.key) if n is None else rows.repartition(n, self.key)

    @property
    def n_docs(self) -> int:
        if self._size is None:
            self._size = self.df.count()
        return self._size

    def field_tokens(self, name: str, limit: int | None = None) -> Column:
        """Structs (term, payload) of one field."""
        c = F.col(name)
        if name in self.payload:
            kind = dict(self.df.dtypes)[name]
            if kind.startswith("array<struct"):
                return F.transform(c, lambda x: F.struct(x["term"].cast("string").alias("term"), x["payload"].cast("double").alias("payload")))
            return F.transform(c, lambda x, i: F.struct(i.cast("string").alias("term"), x.cast("double").alias("payload")))
        return F.transform(self.field_terms(name, limit), lambda t: F.struct(t.alias("term"), F.lit(None).cast("double").alias("payload")))

    def field_terms(self, name: str, limit: int | None = None) -> Column:
        """The terms of a field without payloads."""
        return F.array_compact(F.array(F.col(name).cast("string"))) if name in self.keyword else analyze(F.col(name), limit)

    def tokens(self, fields: Sequence[str], rows: Column | None = None, limit: int | None = None, min_length: int = 0, max_length: int = 0, stop_words: Sequence[str] = (), terms: Mapping[str, Sequence[str]] | None = None, source: DataFrame | None = None, also: Sequence[str] = ()) -> DataFrame:
        """(key, also, field, len, term, payload), a row a token; only the key, the fields named and the columns `also`
        are read. With `terms`, only those of each field."""
        source = source if source is not None else self.df.where(rows) if rows is not None else self.spread()
        parts = []
        for name in fields:
            pays = name in self.payload
            t = self.field_tokens(name, limit) if pays else self.field_terms(name, limit)
            # analysed below the explode: what stands beside it is evaluated for every token
            one = source.select(self.key, *also, t.alias("ts"))
            wanted = F.col("ts") if terms is None else F.filter("ts", lambda x: (x["term"] if pays else x).isin(list(terms.get(name, ()))))  # noqa: B023
            one = one.select(self.key, *also, F.lit(name).alias("field"), F.size("ts").alias("len"), F.explode(wanted).alias("t"))
            term, payload = (F.col("t.term"), F.col("t.payload")) if pays else (F.col("t"), F.lit(None).cast("double"))
            parts.append(one.select(self.key, *also, "field", "len", term.alias("term"), payload.alias("payload")))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        noise = drop_noise(F.array("term"), min_length, max_length, stop_words)
        return out.where(F.size(noise) > 0) if min_length or max_length or stop_words else out

    def local_pairs(self, only: DataFrame, *more: Column) -> list | None:
        """The (field, term, more...) of `only`, repeats included; None if they are over MAX_LOCAL. A literal table, as
        local_terms() gives, is read without a job."""
        rows = only.select("field", "term", *more).limit(MAX_LOCAL + 1).collect()
        return rows if len(rows) <= MAX_LOCAL else None

    def tf(self, fields: Sequence[str], only: DataFrame | None = None, also: Sequence[str] = (), rows: Column | None = None, **how: object) -> DataFrame:
        """AGG1: (key, also, field, len, term, freq, payload): token counts and mean payloads; of the (field, term) in `only`.

        Terms are counted where their documents are, which are sent by key for that: one exchange of texts and none of
        tokens. A few terms are picked out of each document's tokens before those become rows.
        """
        pairs = None if only is None else self.local_pairs(only)
        by: dict[str, list[str]] | None = None if pairs is None else {}
        for r in pairs or ():
            by.setdefault(r["field"], []).append(r["term"])
        source, out = self.df if rows is None else self.df.where(rows), None
        for name in fields:
            tokens = self.tokens([name], source=self.by_key(source, *also, name), also=also, terms=by, **how)
            mean = [F.avg("payload").alias("payload")] if name in self.payload else []
            counted = tokens.groupBy(self.key, *also, "len", "term").agg(F.count(F.lit(1)).alias("freq"), *mean)
            payload = F.col("payload") if mean else F.lit(None).cast("double")
            counted = counted.select(self.key, *also, F.lit(name).alias("field"), "len", "term", "freq", payload.alias("payload"))
            out = counted if out is None else out.union(counted)
        if only is not None and pairs is None:
            out = out.join(only.select("field", "term").distinct(), ["field", "term"], "left_semi").select(out.columns)
        return out

    def df_table(self, fields: Sequence[str], only: DataFrame | None = None) -> DataFrame:
        """AGG2: (field, term, df, total): documents and tokens of every term, or of those in `only`."""
        return self.tf(fields, only).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("freq").alias("total"))

    def match(self, predicate: Column) -> DataFrame:
        return self.df.where(predicate)
