"""Dictionary and typo files, and dictionaries from an index (survey SRC7-SRC10), and field lists (SRC13, SRC14)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection import Collection


def read_dictionary(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """SRC7, SRC8: (phrase, weight) of lines `phrase<TAB>weight`, 1 where there is none; fractions are cut off."""
    parts = F.split("value", "\t")
    lines = spark.read.text([paths] if isinstance(paths, str) else list(paths)).where(F.trim("value") != "")
    weight = F.try_element_at(parts, F.lit(2))
    return lines.select(parts[0].alias("phrase"), F.coalesce(F.trim(weight).try_cast("double").cast("long"), F.lit(1)).alias("weight"))


def frequent_terms(collection: Collection, field: str, threshold: float = 0.0) -> DataFrame:
    """SRC9: (phrase, weight) of terms in at least `threshold` of the documents."""
    table = collection.df_table([field]).where(F.col("df") >= F.lit(threshold * collection.n_docs))
    return table.select(F.col("term").alias("phrase"), F.col("df").alias("weight"))


def read_typos(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """SRC10: (typo, correction) of lines `a, b => c`; typos trimmed and in lower case. The last line for a typo wins."""
    rows = spark.read.option("charset", charset).option("encoding", charset).text(path) if charset.upper() == "UTF-8" else spark.read.csv(path, sep="\x01", encoding=charset, schema="value string")
    sides = F.split("value", "=>")
    rows = rows.where(F.size(sides) == 2).select(F.monotonically_increasing_id().alias("n"), F.explode(F.split(sides[0], ",")).alias("typo"), F.trim(sides[1]).alias("correction"))
    rows = rows.select("n", F.lower(F.trim("typo")).alias("typo"), "correction").where("typo <> ''")
    return rows.groupBy("typo").agg(F.max_by("correction", "n").alias("correction"))


def parse_fields(text: str | None) -> list[str]:
    """SRC13: separated by blanks if there is any, else by commas."""
    text = (text or "").strip()
    return [p.strip() for p in text.split(" " if " " in text else ",") if p.strip()]


def split_list(text: str | None) -> list[str]:
    """SRC14: separated by commas and blanks alike."""
    return [p for p in re.split(r"[,\s]+", text or "") if p]


def parse_boosts(text: str | None) -> dict[str, float]:
    """P5: `f^2 g` as {f: 2, g: 1}."""
    return {name: float(boost or 1) for name, _, boost in (p.partition("^") for p in split_list(text))}
