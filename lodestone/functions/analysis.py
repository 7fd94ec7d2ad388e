"""Text analysis and token operators as array columns (survey TOK0-TOK9, SRC3, SRC4). All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BREAKS = r"[^\p{L}\p{N}]+"


def analyze(text: Column, limit: int | None = None) -> Column:
    """TOK0, TOK7: lower-case runs of letters and digits; null for null. limit caps the tokens taken."""
    tokens = F.filter(F.split(F.lower(text), BREAKS), lambda t: t != "")
    return F.slice(tokens, 1, limit) if limit and limit > 0 else tokens


def drop_noise(tokens: Column, min_length: int = 0, max_length: int = 0, stop_words: Sequence[str] = ()) -> Column:
    """TOK6: 0 sets no bound."""
    keep = lambda t: (
        (F.length(t) >= min_length if min_length else F.lit(True)) & (F.length(t) <= max_length if max_length else F.lit(True)) & (~t.isin(list(stop_words)) if stop_words else F.lit(True))
    )
    return F.filter(tokens, keep)


def has_letters(text: Column, phrase: str) -> Column:
    """Whether the text has every token of the phrase somewhere in its letters: what can't hold it is not analysed."""
    return F.forall(analyze(F.lit(phrase)), lambda t: F.contains(F.lower(text), t))


def contains_phrase(tokens: Column, phrase: Column) -> Column:
    """Whether the phrase's tokens stand in a row. The tokens have no blank, so a padded search will do."""
    return (F.size(phrase) > 0) & F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(phrase, " "), F.lit(" ")))


def mean_payload(tokens: DataFrame, key: str = "doc_id", term: str = "term", payload: str = "payload") -> DataFrame:
    """TOK1: (key, term, payload): mean payload of each term over the length of a document's vector of means.

    Tokens without a payload are left out; a vector of length 0 gives null.
    """
    means = tokens.where(F.col(payload).isNotNull()).groupBy(key, term).agg(F.avg(F.col(payload).cast("double")).alias("mean"))
    length = F.sqrt(F.sum(F.col("mean") * F.col("mean")).over(Window.partitionBy(key)))
    return means.select(key, term, (F.col("mean") / F.when(length > 0, length)).alias("payload"))


def payload_boost(term: Column, payload: Column) -> Column:
    """TOK2: term^weight; empty where the payload is null, zero or prints with a negative exponent."""
    printed = payload.cast("float").cast("string")
    return F.when(payload.isNull() | (payload == 0) | printed.contains("E-"), F.lit("")).otherwise(F.concat(term, F.lit("^"), printed))


def constant_tokens(tokens: Column, token: str) -> Column:
    """TOK3."""
    return F.transform(tokens, lambda _: F.lit(token))


def concatenate(positions: Column, separator: str = " ") -> Column:
    """TOK4: every phrase that takes one alternative at each position of an array of arrays; none for no position."""
    step = lambda done, group: F.flatten(F.transform(done, lambda p: F.transform(group, lambda w: F.when(p == "", w).otherwise(F.concat(p, F.lit(separator), w)))))
    return F.when(F.size(positions) > 0, F.aggregate(positions, F.array(F.lit("")), step)).otherwise(F.array().cast("array<string>"))


def erase_types(tokens: Column) -> Column:
    """TOK5: token structs with a null type."""
    return F.transform(tokens, lambda t: t.withField("type", F.lit(None).cast("string")))


def first_token(text: Column) -> Column:
    """TOK8: null if there is none."""
    return F.try_element_at(analyze(text), F.lit(1))


def tokens_with_offsets(text: Column) -> Column:
    """TOK9: structs (term, start, end, position, type, payload) of lower-case letter and digit runs.

    Lengths are in characters; the text is walked once, run by run.
    """
    parts = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<struct<term:string,start:int,end:int,position:int,type:string,payload:float>>").alias("out"))

    def step(done: Column, part: Column) -> Column:
        end = done.at + F.length(part)
        word = part.rlike(r"^[\p{L}\p{N}]")
        token = F.struct(F.lower(part).alias("term"), done.at.alias("start"), end.alias("end"), done.n.alias("position"), F.lit("word").alias("type"), F.lit(None).cast("float").alias("payload"))
        return F.struct(end.alias("at"), F.when(word, done.n + 1).otherwise(done.n).alias("n"), F.when(word, F.array_append(done.out, token)).otherwise(done.out).alias("out"))

    return F.aggregate(parts, start, step, lambda done: done.out)
