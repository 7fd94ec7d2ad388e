"""Scalar functions of a document's terms (survey FN1-FN6)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .analysis import analyze

OVERLAPS = ("doc", "param", "sorensen", "jaccard")


def term_intersect(field: Column, text: str | Column, similarity: str = "doc") -> Column:
    """FN1: shared distinct terms over those of the field (doc), the text (param), half of both (sorensen) or all
    (jaccard); an unknown name is doc. 0 where either has none."""
    a = F.array_distinct(analyze(field))
    b = F.array_distinct(analyze(F.lit(text) if isinstance(text, str) else text))
    both = F.size(F.array_intersect(a, b)).cast("double")
    na, nb = F.size(a), F.size(b)
    ratio = {"param": both / nb, "sorensen": 2 * both / (na + nb), "jaccard": both / (na + nb - both)}.get(similarity.lower(), both / na)
    return F.when((na > 0) & (nb > 0) & (both > 0), ratio).otherwise(F.lit(0.0))


def term_exists(field: Column, term: str) -> Column:
    """FN3: 1 or 0."""
    return F.coalesce(F.array_contains(analyze(field), term), F.lit(False)).cast("int")


def field_len(field: Column, mode: str = "distinct") -> Column:
    """FN4: distinct terms, or all tokens with mode total; -1 for a missing field."""
    tokens = analyze(field)
    return F.when(field.isNull(), F.lit(-1)).otherwise(F.size(tokens if mode == "total" else F.array_distinct(tokens)))


def term_overlap(field: Column, text: str, use_doc_len: bool = True) -> Column:
    """FN2: how many distinct terms of the text the field has, over its length or over their number; 0 for none."""
    terms = F.array_distinct(analyze(F.lit(text)))
    tokens = analyze(field)
    found = F.size(F.array_intersect(F.array_distinct(tokens), terms)).cast("double")
    length = F.size(F.array_distinct(tokens)) if use_doc_len else F.size(terms)
    return F.when(field.isNotNull() & (length > 0), found / length).otherwise(F.lit(0.0))


def field_values(field: Column, delimiter: str = "||") -> Column:
    """FN5: the distinct terms in order; empty when there is none."""
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(analyze(field))), delimiter), F.lit(""))


def add(*values: Column | float) -> Column:
    """FN6."""
    total = F.lit(0.0)
    for v in values:
        total = total + (F.lit(float(v)) if isinstance(v, int | float) else v.cast("double"))
    return total


def divide(a: Column, b: Column | float) -> Column:
    """FN6: null over zero."""
    b = F.lit(float(b)) if isinstance(b, int | float) else b.cast("double")
    return a.cast("double") / F.when(b != 0, b)


def register(spark: SparkSession) -> None:
    """The functions of one column for SQL text, as SQL functions that Catalyst inlines."""
    tokens = r"filter(split(lower(t), '[^\\p{L}\\p{N}]+'), x -> x <> '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION field_tokens(t STRING) RETURNS ARRAY<STRING> RETURN {tokens}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION field_len(t STRING) RETURNS INT RETURN CASE WHEN t IS NULL THEN -1 ELSE size(array_distinct(field_tokens(t))) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION field_values(t STRING) RETURNS STRING RETURN coalesce(array_join(array_sort(array_distinct(field_tokens(t))), '||'), '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION term_exists(t STRING, w STRING) RETURNS INT RETURN coalesce(cast(array_contains(field_tokens(t), w) AS INT), 0)")
