from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("component_id", T.StringType()), T.StructField("length", T.StringType())])


def documents(spark, rows):
    """(doc_id, text[, lang[, source]]) rows, with extra columns whose names clash with results'."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]), "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = ("alpha beta gamma " * 4000) + "".join(chr(97 + i * 7 % 26) for i in range(5000))
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "x"), (5, LONG), (6, LONG), (6, LONG), (7, "ärger 字 naïve 𝄞 \u00a0 x"), (None, "null id"), (None, None), (8, "x"), (9, "a" * 3000), (10, "0 1 2 3 4 !!")]


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()] if columns else df.collect()


def twins(rounds=11):
    """Two Thue-Morse words of 2**rounds characters: hashes that are polynomials modulo 2**64 can't tell them apart."""
    x, y = "a", "b"
    for _ in range(rounds):
        x, y = x + y, y + x
    return x, y
