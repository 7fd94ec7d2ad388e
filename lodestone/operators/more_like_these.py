"""Recommendation from seed documents or text, and blind feedback (survey MLT1-MLT13, UF1, UF2)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.parser import parse
from lodestone.sources.collection import Collection
from lodestone.sources.shared import written

from .facets import facet_counts
from .search import DECIMALS, local_terms, must_match, per_field_rank, query_terms, require_matches, score_terms, terms_frame, top
from .similarity import CLASSIC, Similarity


@dataclass(frozen=True)
class TermParams:
    """How a profile's terms are chosen (MLT12, UF2). 0 sets no bound on a word's length."""

    fields: tuple[str, ...] = ()
    min_tf: int = 1
    min_df: int = 5
    max_df: int | None = None
    max_df_percent: float | None = None
    min_word_length: int = 0
    max_word_length: int = 0
    stop_words: tuple[str, ...] = ()
    max_terms: int = 100
    max_tokens: int | None = 5000
    boost: bool = True
    log_tf: bool = False
    normalize: bool = True
    qf: Mapping[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class RecommendParams(TermParams):
    mm: int | str = 1
    same: tuple[str, ...] = ()
    different: tuple[str, ...] = ()
    boost_fn: Column | None = None
    fq: tuple[Column | str, ...] = ()
    rows: int | None = 10
    start: int = 0
    include_seeds: bool = False
    max_seeds: int = 10_000
    match_offset: int = 0
    similarity: Similarity = CLASSIC
    head_fields: tuple[str, ...] = ()
    stream_qf: Mapping[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class FeedbackParams(TermParams):
    max_docs: int = 5
    boost_fn: Column | None = None
    fq: tuple[Column | str, ...] = ()
    rows: int | None = 10
    similarity: Similarity = CLASSIC


@dataclass(frozen=True)
class Answer:
    """SNK1: what a request gives, lazily: the response, the seeds it matched, its terms."""

    response: DataFrame
    match: DataFrame | None = None
    terms: DataFrame | None = None

    def facets(self, collection: Collection, fields: Sequence[str], min_count: int = 1, limit: int = -1) -> dict[str, DataFrame]:
        """AGG16."""
        docs = collection.df.join(self.response, collection.key, "left_semi")
        return {f: facet_counts(docs, f, min_count, limit) for f in fields}


def profile_terms(collection: Collection, own: DataFrame, p: TermParams, boosts: Mapping[str, float]) -> DataFrame:
    """MLT1-MLT4: (field, term, tf, df, idf, weight, boost, score) of a profile's tokens (field, term, payload).

    Document frequencies are counted for the profile's terms alone.
    """
    fields = p.fields or collection.text
    tf = own.groupBy("field", "term").agg(F.sum(F.coalesce("payload", F.lit(1.0))).alias("tf")).where(F.trim("term") != "")
    if p.min_tf > 0:
        tf = tf.where(F.col("tf") >= p.min_tf)
    tf, _ = local_terms(tf)
    dfs = collection.df_table(fields, tf).select("field", "term", "df")
    terms = tf.join(dfs, ["field", "term"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    n = collection.n_docs
    if p.min_df > 0:
        terms = terms.where(F.col("df") >= p.min_df)
    most = min([m for m in (p.max_df, None if p.max_df_percent is None else int(p.max_df_percent * n / 100)) if m is not None], default=None)
    if most is not None:
        terms = terms.where(F.col("df") <= most)
    idf = CLASSIC.idf(F.col("df"), n)
    is_payload = F.col("field").isin(list(collection.payload)) if collection.payload else F.lit(False)
    amount = F.log(F.col("tf") + 1.0) if p.log_tf else F.col("tf")
    weight = F.when(is_payload, F.col("tf")).otherwise(amount * F.col("idf") if p.boost else F.lit(1.0))
    boost = F.coalesce(F.create_map(*[x for f, b in boosts.items() for x in (F.lit(f), F.lit(float(b)))])[F.col("field")], F.lit(1.0)) if boosts else F.lit(1.0)
    terms = terms.withColumn("idf", idf).withColumn("weight", weight).withColumn("boost", boost).withColumn("rank_by", F.round(F.col("boost") * F.col("weight"), DECIMALS))
    terms = per_field_rank(terms, p.max_terms)
    if p.normalize:
        norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("field")))
        terms = terms.withColumn("norm", norm).where(F.col("norm") > 0).withColumn("score", F.col("boost") * F.col("weight") / F.col("norm"))
    else:
        terms = terms.withColumn("score", F.col("boost") * F.col("weight"))
    return terms.select("field", "term", "tf", "df", "idf", "weight", "boost", "score")


class MoreLikeThese:
    """Documents like the seeds (all pooled into one profile), or like a text."""

    def __init__(self, collection: Collection, params: RecommendParams | None = None):
        self.collection, self.params = collection, params or RecommendParams()

    def seeds(self, which: str | Column | Sequence[int]) -> DataFrame:
        """MLT9: the matches of a query, a predicate or ids, from match_offset on, at most max_seeds, by key."""
        c, p = self.collection, self.params
        predicate = parse(which).tree.predicate(c.scope) if isinstance(which, str) else which if isinstance(which, Column) else F.col(c.key).isin(list(which))
        found = c.df.where(predicate).orderBy(c.key)
        return (found.offset(p.match_offset) if p.match_offset else found).limit(p.max_seeds)

    def _tokens(self, rows: DataFrame, fields: Sequence[str]) -> DataFrame:
        c, p = self.collection, self.params
        own = Collection(rows, c.key, c.text, c.keyword, c.payload)
        return own.tokens(fields, limit=p.max_tokens, min_length=p.min_word_length, max_length=p.max_word_length, stop_words=p.stop_words)

    def interesting_terms(self, seeds: DataFrame) -> DataFrame:
        return profile_terms(self.collection, self._tokens(seeds, self.params.fields or self.collection.text), self.params, self.params.qf)

    def text_terms(self, body: str, head: str = "") -> DataFrame:
        """MLT6: the body analysed for each field and the head for each head field, merged."""
        c, p = self.collection, self.params
        spark, fields = c.df.sparkSession, p.fields or c.text
        parts = [(t, f) for t, fs in ((body, fields), (head, p.head_fields or fields)) if t for f in fs]
        own = None
        for text, f in parts:
            one = spark.createDataFrame([(0, text)], f"{c.key} long, {f} string")
            tokens = Collection(one, c.key, (f,)).tokens([f], limit=p.max_tokens, min_length=p.min_word_length, max_length=p.max_word_length, stop_words=p.stop_words)
            own = tokens if own is None else own.union(tokens)
        if own is None:
            raise ValueError("a text is needed")
        return profile_terms(c, own, p, {**p.qf, **p.stream_qf})

    def _retrieve(self, terms: DataFrame, docs: DataFrame, seeds: DataFrame | None) -> DataFrame:
        c, p = self.collection, self.params
        scored = score_terms(c, terms.select("field", "term", "df", F.col("score").alias("boost")), p.similarity, p.mm).drop("overlap")
        for f in p.fq:
            docs = docs.where(parse(f).tree.predicate(c.scope) if isinstance(f, str) else f)
        keys = docs.select(c.key, *([p.boost_fn.alias("__boost")] if p.boost_fn is not None else []))
        scored = scored.join(keys, c.key)
        if seeds is not None and not p.include_seeds:
            scored = scored.join(seeds.select(c.key), c.key, "left_anti")
        if p.boost_fn is not None:
            scored = scored.withColumn("score", F.col("score") * F.coalesce("__boost", F.lit(1.0))).drop("__boost")
        return top(scored, c.key, p.rows, p.start)

    def from_docs(self, which: str | Column | Sequence[int], required: bool = False) -> Answer:
        """MLT5, MLT7."""
        seeds = self.seeds(which)
        if required:
            require_matches(seeds, str(which))
        terms, _ = local_terms(self.interesting_terms(seeds))
        docs = must_match(self.collection, seeds, self.params.same, self.params.different)
        return Answer(self._retrieve(terms, docs, seeds), seeds, terms)

    def from_text(self, body: str, head: str = "") -> Answer:
        """MLT8: no seed is left out, and no field must match."""
        terms, _ = local_terms(self.text_terms(body, head))
        return Answer(self._retrieve(terms, self.collection.df, None), None, terms)


def list_terms(terms: DataFrame, style: str = "details") -> DataFrame:
    """MLT10, MLT11: none, the words by score (list), `field:word` with its score (details), or every figure (debug)."""
    order = terms.withColumn("score", F.round("score", DECIMALS)).orderBy(F.col("score").desc(), "field", "term")
    if style == "none":
        return order.select("term").limit(0)
    if style == "list":
        return order.select("term")
    if style == "details":
        return order.select(F.concat_ws(":", "field", "term").alias("term"), "score")
    return order


class BlindFeedback:
    """UF1: expand a query by the terms of its best documents and run it again."""

    def __init__(self, collection: Collection, params: FeedbackParams | None = None):
        self.collection, self.params = collection, params or FeedbackParams()

    def run(self, query: str) -> Answer:
        c, p = self.collection, self.params
        # what the query admits and its scores are found once, for the seeds and for the answer
        matched = written(c.df.where(parse(query).tree.predicate(c.scope)).select(c.key))
        must = written(score_terms(c, terms_frame(c, query_terms(c, query, p.qf or None)), p.similarity, 1).drop("overlap"))
        best = top(must.join(matched, c.key), c.key, p.max_docs)
        seeds = c.df.where(F.col(c.key).isin([r[0] for r in best.select(c.key).collect()]))
        picked = MoreLikeThese(c, RecommendParams(**{k: getattr(p, k) for k in TermParams.__dataclass_fields__}))
        terms, _ = local_terms(picked.interesting_terms(seeds))
        should = score_terms(c, terms.select("field", "term", "df", F.col("score").alias("boost")), p.similarity, 1).select(c.key, F.col("score").alias("more"))
        docs = c.df
        for f in p.fq:
            docs = docs.where(parse(f).tree.predicate(c.scope) if isinstance(f, str) else f)
        keys = docs.select(c.key, (p.boost_fn if p.boost_fn is not None else F.lit(1.0)).alias("__boost")).join(matched, c.key, "left_semi")
        both = keys.join(must, c.key).join(should, c.key, "left")
        scored = both.select(c.key, ((F.col("score") + F.coalesce("more", F.lit(0.0))) * F.coalesce("__boost", F.lit(1.0))).alias("score"))
        return Answer(top(scored, c.key, p.rows), seeds, terms)
