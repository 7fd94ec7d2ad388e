"""Filters that tell two document sets apart (survey AGG11-AGG14, K4, K7, J10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.collection import Collection
from lodestone.sources.shared import written

Objective = Callable[[Column, Column], Column]


def entropy(positive: Column, negative: Column) -> Column:
    """AGG12: of the two labels' shares, in nats; an absent label adds nothing."""
    total = (positive + negative).cast("double")
    part = lambda n: F.when(n > 0, -(n / total) * F.log(n / total)).otherwise(F.lit(0.0))
    return part(positive) + part(negative)


def label_features(collection: Collection, positive: DataFrame, negative: DataFrame, fields: tuple[str, ...], min_df: int = 5) -> DataFrame:
    """AGG11, F9: (field, term, feature, pos, neg) of terms in at least min_df of all documents."""
    key = collection.key
    labels = positive.select(key, F.lit(1).alias("y")).union(negative.select(key, F.lit(0).alias("y")))
    sets = collection.df.join(labels, key)
    own = Collection(sets.select(*collection.df.columns), key, collection.text, collection.keyword, collection.payload)
    pairs = own.tokens(fields).select(key, "field", "term").distinct().join(labels, key)
    counts = pairs.groupBy("field", "term").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    counts = written(counts)
    dfs = collection.df_table(fields, counts).select("field", "term", "df").where(F.col("df") >= min_df)
    feature = F.concat(F.col("field"), F.lit(':"'), F.col("term"), F.lit('"'))
    return counts.join(dfs, ["field", "term"]).select("field", "term", feature.alias("feature"), "pos", "neg")


def decision_stumps(features: DataFrame, objective: Objective = entropy) -> DataFrame:
    """AGG13, K4: each feature's majority label, score and size, best first: low score, then large, then by name."""
    size = F.col("pos") + F.col("neg")
    label = F.when(F.col("pos") >= F.col("neg"), F.lit("POSITIVE")).otherwise(F.lit("NEGATIVE"))
    stumps = features.select("feature", label.alias("label"), F.round(objective(F.col("pos"), F.col("neg")), 6).alias("score"), size.alias("partition_size"))
    return stumps.orderBy("score", F.col("partition_size").desc(), "feature")


def suggest_filters(collection: Collection, positive: Column | None = None, negative: Column | None = None, fields: tuple[str, ...] | None = None, max_docs: int = 100, min_df: int = 5, suggestions: int = 5) -> DataFrame:
    """AGG14: (rank, filter, label, score, partition_size): `+(f)` keeps positives, `-(f)` drops negatives.

    Each side is at most max_docs documents, by key. A side without a predicate, or whose predicate matches
    nothing, is taken from all documents. Positives are taken out of the negatives, or the other way round where
    only negatives are given.
    """
    key = collection.key

    def side(predicate: Column | None) -> tuple[DataFrame, bool]:
        if predicate is not None:
            found = collection.df.where(predicate).select(key).orderBy(key).limit(max_docs)
            if not found.isEmpty():
                return found, True
        return collection.df.select(key).orderBy(key).limit(max_docs), False

    (pos, given), (neg, _) = side(positive), side(negative)
    if given:
        neg = neg.join(pos, key, "left_anti")
    else:
        pos = pos.join(neg, key, "left_anti")
    best = decision_stumps(label_features(collection, pos, neg, fields or collection.text, min_df)).limit(suggestions)
    rows = best.collect()  # as many as are suggested
    named = [(k + 1, ("+" if r["label"] == "POSITIVE" else "-") + f"({r['feature']})", r["label"], r["score"], r["partition_size"]) for k, r in enumerate(rows)]
    return collection.df.sparkSession.createDataFrame(named, "rank int, filter string, label string, score double, partition_size long")
