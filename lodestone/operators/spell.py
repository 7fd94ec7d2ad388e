"""Spelling suggestions from a vocabulary and a typo dictionary, and whole-query collation (survey SPL1-SPL11)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.collection import MAX_LOCAL

from .search import search


@dataclass(frozen=True)
class SpellParams:
    count: int = 5
    alternative_count: int = 0
    max_edits: int = 2
    min_prefix: int = 1
    min_query_length: int = 4
    max_query_frequency: float = 0.01
    accuracy: float = 0.5
    threshold: float = 0.0
    transpositions: bool = False
    #: A name in DISTANCES, or (token, word) -> Column of edits; None: by `transpositions`.
    distance: str | Callable[[Column, Column], Column] | None = None
    #: "score", "freq", or columns to sort by (of token, word, freq, score).
    by: str | Sequence[Column] = "score"
    mode: str = "not_in_index"
    max_results: int = 0
    collations: int = 1
    collation_tries: int = 0
    collation_evaluations: int = 10_000


def osa_distance(a: Column, b: Column) -> Column:
    """Edit distance in which swapping neighbours is one edit, in Arrow batches; the plain one stays in the JVM."""

    @F.pandas_udf("int")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> int:
            rows = [list(range(len(y) + 1))]
            for i, cx in enumerate(x, 1):
                row = [i]
                for j, cy in enumerate(y, 1):
                    best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (cx != cy))
                    if i > 1 and j > 1 and cx == y[j - 2] and x[i - 2] == cy:
                        best = min(best, rows[-2][j - 2] + 1)
                    row.append(best)
                rows.append(row)
            return rows[-1][-1]

        return pd.Series([one(p, q) for p, q in zip(left, right, strict=True)], dtype="int32")

    return run(a, b)


#: Edit distances by name: (token, word, most edits) -> Column, negative where it is beyond.
DISTANCES: dict[str, Callable[[Column, Column, int], Column]] = {
    "levenshtein": lambda a, b, most: F.levenshtein(a, b, most),
    "transpositions": lambda a, b, most: osa_distance(a, b),
}


def query_tokens(query: str) -> list[tuple[str, int, int]]:
    """TOK9 for one query: (token, start, end)."""
    return [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", query)]


@dataclass(frozen=True)
class SpellChecker:
    """vocabulary: (phrase, weight): a term and its document frequency, as frequent_terms() gives."""

    vocabulary: DataFrame
    n_docs: int
    typos: DataFrame | None = None
    params: SpellParams = field(default_factory=SpellParams)

    def candidates(self, tokens: DataFrame) -> DataFrame:
        """SPL1: (token, word, freq, score) within max_edits, from an equi-join on the shared prefix and the length.

        Tokens too short, or more frequent than max_query_frequency, get none.
        """
        p = self.params
        band = F.explode(F.sequence(F.length("token") - p.max_edits, F.length("token") + p.max_edits))
        asked = self.frequencies(tokens, few := self._few(tokens)).where((F.length("token") >= p.min_query_length) & (F.col("orig_freq") <= p.max_query_frequency * self.n_docs if p.max_query_frequency < 1 else F.lit(True)))
        asked = asked.select("token", "orig_freq", F.substring("token", 1, max(1, p.min_prefix)).alias("head") if p.min_prefix else F.lit("").alias("head"), band.alias("n"))
        words = self.vocabulary.where(F.col("weight") >= p.threshold * (self.n_docs if p.threshold < 1 else 1))
        words = words.select(F.col("phrase").alias("word"), F.col("weight").alias("freq"), F.length("phrase").alias("n"), F.substring("phrase", 1, max(1, p.min_prefix)).alias("head") if p.min_prefix else F.lit("").alias("head"))
        near = (F.broadcast(asked) if few else asked).join(words, ["n", "head"]).where(F.col("word") != F.col("token"))
        kind = p.distance or ("transpositions" if p.transpositions else "levenshtein")
        a, b = F.col("token"), F.col("word")
        distance = kind(a, b) if callable(kind) else DISTANCES[kind](a, b, p.max_edits)
        near = near.withColumn("d", distance).where((F.col("d") >= 0) & (F.col("d") <= p.max_edits))
        score = F.round(1.0 - F.col("d") / F.least(F.length("token"), F.length("word")), 6)
        return near.withColumn("score", score).where((F.col("score") >= p.accuracy) & (F.col("freq") > (F.col("orig_freq") if p.mode == "more_popular" else F.lit(0)))).select("token", "orig_freq", "word", "freq", "score")

    @staticmethod
    def _few(tokens: DataFrame) -> bool:
        """Whether the tokens can go to every executor, so that no vocabulary is sorted for them."""
        return tokens.limit(MAX_LOCAL + 1).count() <= MAX_LOCAL

    def frequencies(self, tokens: DataFrame, few: bool | None = None) -> DataFrame:
        words = self.vocabulary.select(F.col("phrase").alias("token"), F.col("weight").alias("orig_freq"))
        if self._few(tokens) if few is None else few:
            words = F.broadcast(words.join(F.broadcast(tokens.select("token").distinct()), "token", "left_semi"))
        return tokens.select("token").distinct().join(words, "token", "left").withColumn("orig_freq", F.coalesce("orig_freq", F.lit(0)))

    def suggestions(self, tokens: DataFrame) -> DataFrame:
        """SPL2-SPL4: (token, orig_freq, suggestions): structs (word, freq), best first; empty where there is none.

        A typo's correction comes first if it is in the vocabulary and more frequent than the token. Words of the
        vocabulary get alternative_count suggestions, unless the mode suggests for unknown words only.
        """
        p = self.params
        own = self.frequencies(tokens, few := self._few(tokens))
        ranked = self.candidates(tokens).select("token", "orig_freq", "word", "freq", F.lit(1).alias("tier"), "score")
        if self.typos is not None:
            known = self.vocabulary.select(F.col("phrase").alias("correction"), F.col("weight").alias("freq"))
            own_few = F.broadcast(own) if few else own
            fixes = own_few.join(self.typos, F.col("token") == F.col("typo")).join(known, "correction").where((F.col("freq") > F.col("orig_freq")) & (F.col("correction") != F.col("token")))
            ranked = fixes.select("token", "orig_freq", F.col("correction").alias("word"), "freq", F.lit(0).alias("tier"), F.lit(1.0).alias("score")).union(ranked)
        ranked = ranked.groupBy("token", "orig_freq", "word").agg(F.max("freq").alias("freq"), F.min("tier").alias("tier"), F.max("score").alias("score"))
        if p.mode == "not_in_index" and not p.alternative_count:
            ranked = ranked.where("orig_freq = 0 OR tier = 0")
        order = {"score": [F.col("score").desc(), F.col("freq").desc()], "freq": [F.col("freq").desc(), F.col("score").desc()]}[p.by] if isinstance(p.by, str) else list(p.by)
        rank = F.row_number().over(Window.partitionBy("token").orderBy("tier", *order, "word"))
        most = F.when(F.col("orig_freq") > 0, F.lit(p.alternative_count or p.count)).otherwise(F.lit(p.count))
        best = ranked.withColumn("rank", rank).where(F.col("rank") <= most)
        listed = best.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "freq"))).alias("s"))
        listed = listed.select("token", F.transform("s", lambda x: F.struct(x["word"].alias("word"), x["freq"].alias("freq"))).alias("suggestions"))
        return own.join(F.broadcast(listed) if few else listed, "token", "left").select("token", "orig_freq", F.coalesce("suggestions", F.array().cast("array<struct<word:string,freq:bigint>>")).alias("suggestions"))

    def check(self, query: str, collection=None) -> tuple[DataFrame, bool, list[tuple[str, int]]]:  # noqa: ANN001
        """SPL5-SPL7: (token, start, end, orig_freq, suggestions), whether it is spelled right, and collations.

        With a collection, a query with more than max_results hits counts as right and gets no suggestions.
        """
        spark = self.vocabulary.sparkSession
        spans = query_tokens(query)
        tokens = spark.createDataFrame(spans, "token string, start int, end int")
        hits = search(collection, query, mm=1, rows=None).count() if collection is not None else 0
        right = collection is not None and hits > max(0, self.params.max_results)
        if right and self.params.mode != "always":
            return tokens.join(self.frequencies(tokens), "token").withColumn("suggestions", F.array().cast("array<struct<word:string,freq:bigint>>")), True, []
        found = tokens.join(self.suggestions(tokens), "token").orderBy("start")
        return found, right, self.collate(query, found, collection)

    def collate(self, query: str, found: DataFrame, collection=None) -> list[tuple[str, int]]:  # noqa: ANN001
        """SPL7: (rewritten query, hits or -1), by the sum of the suggestions' ranks; tried against the collection if
        collation_tries is set, and those without hits left out. A query's suggestions are few: this is the driver's."""
        p = self.params
        rows = [(r.start, r.end, [s.word for s in r.suggestions]) for r in found.collect() if r.suggestions]
        if not rows:
            return []
        out: list[tuple[str, int]] = []
        for tried, picks in enumerate(best_first([len(words) for *_, words in rows], p.collation_evaluations)):
            if len(out) >= p.collations or (p.collation_tries and tried >= p.collation_tries):
                break
            text = query
            for (start, end, words), k in sorted(zip(rows, picks, strict=True), key=lambda x: -x[0][0]):
                text = text[:start] + words[k] + text[end:]
            hits = search(collection, text, mm=1, rows=None).count() if collection is not None and p.collation_tries else -1
            if hits:
                out.append((text, hits))
        return out


def best_first(sizes: Sequence[int], most: int) -> Iterator[tuple[int, ...]]:
    """Choices of one index for each size, by their sum and then in order; the first `most` of them."""
    heap, seen = [(0, (0,) * len(sizes))], {(0,) * len(sizes)}
    for _ in range(most):
        if not heap:
            return
        total, pick = heappop(heap)
        yield pick
        for i, k in enumerate(pick):
            if k + 1 < sizes[i] and (more := (*pick[:i], k + 1, *pick[i + 1 :])) not in seen:
                seen.add(more)
                heappush(heap, (total + 1, more))


def merge_collations(parts: Sequence[DataFrame], count: int = 1) -> DataFrame:
    """SPL10: collations (collation, rank, hits) of several indexes as one: hits added, the greatest rank kept; those
    of the least rank come first, then those with most hits."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    summed = every.groupBy("collation").agg(F.max("rank").alias("rank"), F.sum("hits").alias("hits"))
    return summed.orderBy("rank", F.col("hits").desc(), "collation").limit(count)


def merge_shards(parts: Sequence[DataFrame], count: int = 5) -> DataFrame:
    """SPL10: suggestions (token, word, freq) of several indexes as one: frequencies added, the most frequent kept."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    summed = every.groupBy("token", "word").agg(F.sum("freq").alias("freq"))
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.col("freq").desc(), "word"))
    return summed.withColumn("rank", rank).where(F.col("rank") <= count)


@dataclass
class SpellRegistry:
    """SPL8, SPL9, SPL11: named checkers, their own parameters as `name.param`, and an explicit refresh."""

    checkers: dict[str, SpellChecker] = field(default_factory=dict)

    def select(self, names: Sequence[str]) -> list[SpellChecker]:
        unknown = [n for n in names if n not in self.checkers]
        if unknown:
            raise KeyError(f"no dictionary {', '.join(unknown)}")
        return [self.checkers[n] for n in names]

    def suggest(self, names: Sequence[str], tokens: DataFrame, count: int = 5) -> DataFrame:
        parts = [c.suggestions(tokens).select("token", F.explode("suggestions").alias("s")).select("token", "s.word", "s.freq") for c in self.select(names)]
        return merge_shards(parts, count)

    @staticmethod
    def own_params(params: dict[str, str], name: str) -> dict[str, str]:
        head = f"{name}."
        return {k[len(head) :]: v for k, v in params.items() if k.startswith(head)}

    def refresh(self, name: str, vocabulary: DataFrame, n_docs: int) -> None:
        old = self.checkers.get(name)
        self.checkers[name] = SpellChecker(vocabulary, n_docs, old.typos if old else None, old.params if old else SpellParams())
