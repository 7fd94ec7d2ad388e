"""Autocomplete over phrase dictionaries (survey SRC11, SUG1-SUG4, J7)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.analysis import first_token


@dataclass(frozen=True)
class SuggestIndex:
    """Phrases with weights. SUG4: build, save and load; SUG3: any phrase -> Column normaliser may be given."""

    phrases: DataFrame

    @staticmethod
    def build(dictionary: DataFrame, threshold: float = 0.0) -> SuggestIndex:
        return SuggestIndex(dictionary.where((F.col("weight") >= threshold) & (F.col("phrase") != "")).groupBy("phrase").agg(F.max("weight").alias("weight")))

    def save(self, path: str) -> None:
        """SRC11. In phrase order, so that a prefix reads few row groups."""
        self.phrases.sort("phrase").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SuggestIndex:
        return SuggestIndex(spark.read.parquet(path))

    def lookup(self, prefix: str, count: int) -> DataFrame:
        """The heaviest phrases that start with the prefix."""
        return self.phrases.where(F.col("phrase").startswith(prefix)).orderBy(F.col("weight").desc(), "phrase").limit(count)

    def suggest(self, prefix: str, count: int = 5, more_popular: bool = False, normalise: Callable[[Column], Column] = first_token) -> DataFrame:
        """SUG1: (suggestion, weight) of ten times as many phrases, equal normal forms merged and weights added."""
        hits = self.lookup(prefix, count * 10).select(normalise(F.col("phrase")).alias("suggestion"), "weight").where("suggestion IS NOT NULL AND suggestion <> ''")
        merged = hits.groupBy("suggestion").agg(F.sum("weight").alias("weight"))
        return merged.orderBy(*([F.col("weight").desc()] if more_popular else []), "suggestion").limit(count)

    def suggest_cases(self, prefix: str, count: int = 5, more_popular: bool = False, max_len: int = 2) -> DataFrame:
        """SUG2: (suggestion, weight): lookups of all case variants of the first words, merged without regard to case.

        The most frequent form stands for its group with its own weight; popularity is the group's sum.
        """
        found = None
        for v in case_variants(prefix, max_len):
            one = self.lookup(v, count * 10)
            found = one if found is None else found.union(one)
        found = found.distinct()
        best = found.groupBy(F.lower("phrase").alias("low")).agg(F.max(F.struct("weight", "phrase")).alias("best"), F.sum("weight").alias("sum"))
        order = [F.col("sum").desc()] if more_popular else []
        return best.orderBy(*order, "low").limit(count).select(F.col("best.phrase").alias("suggestion"), F.col("best.weight").alias("weight"))

    def suggest_many(self, prefixes: DataFrame, count: int = 5) -> DataFrame:
        """J7 in bulk: (prefix, phrase, weight, rank) by an equi-join of each phrase's own prefixes, of the lengths that
        are asked for. A phrase is sent once a length; a prefix's phrases are cut to `count` before they are."""
        asked = prefixes.select("prefix").distinct().where("prefix <> ''")
        lengths = sorted(r["n"] for r in asked.select(F.length("prefix").alias("n")).distinct().collect())
        heads = self.phrases.withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"))).where(F.length("phrase") >= F.col("n"))
        hits = asked.join(heads.select(F.expr("substring(phrase, 1, n)").alias("prefix"), "phrase", "weight"), "prefix")
        rank = F.row_number().over(Window.partitionBy("prefix").orderBy(F.col("weight").desc(), "phrase"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= count).select("prefix", "phrase", "weight", "rank")


def case_variants(text: str, max_len: int = 2) -> list[str]:
    """Every lower, upper and title form of the first max_len words, and the text as typed."""
    words = text.split(" ")
    forms = [dict.fromkeys((w.lower(), w.upper(), w[:1].upper() + w[1:].lower())) for w in words[:max_len]]
    return list(dict.fromkeys([*(" ".join([*head, *words[max_len:]]) for head in product(*forms)), text]))
