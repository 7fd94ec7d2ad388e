"""Scored retrieval (survey F1-F12, P1-P6, K1, J1-J4)."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.analysis import analyze
from lodestone.plans.parser import QueryParseError, parse
from lodestone.plans.syntax import Binary, InField, Node, Not, Phrase, Term, is_prefix
from lodestone.sources.collection import MAX_LOCAL, Collection

from .similarity import CLASSIC, Similarity

#: Decimals that scores are rounded to, so that equal documents tie and ties go by key.
DECIMALS = 6


def terms_frame(collection: Collection, terms: Sequence[tuple[str, str, float]]) -> DataFrame:
    """(field, term, boost), boosts of a repeated term added."""
    merged: dict[tuple[str, str], float] = {}
    for f, t, b in terms:
        merged[f, t] = merged.get((f, t), 0.0) + float(b)
    return collection.df.sparkSession.createDataFrame([(f, t, b) for (f, t), b in merged.items()], "field string, term string, boost double")


def leaves(tree: Node | None, name: str | None = None) -> list[tuple[str | None, str]]:
    """(field or none, value) of the terms that are not negated."""
    match tree:
        case Term(v) | Phrase(v):
            return [(name, v)]
        case Binary(_, a, b):
            return leaves(a, name) + leaves(b, name)
        case InField(f, inner):
            return leaves(inner, f)
    return []


def query_terms(collection: Collection, query: str, qf: Mapping[str, float] | None = None, analyzed: bool = True) -> list[tuple[str, str, float]]:
    """The query's terms in every field of qf (default: the text fields), or in the field each names."""
    qf = dict(qf or dict.fromkeys(collection.text, 1.0))
    found: list[tuple[str, str, float]] = []
    for name, value in leaves(parse(query).tree):
        if value == "*:*" or name == "*" or is_prefix(value):  # they select, but don't score
            continue
        value, _, boost = value.partition("^") if name is None else (value, "", "")
        for f in [name] if name else qf:
            words = [value] if f in collection.keyword or f in collection.payload or not analyzed else _words(value)
            found += [(f, w, qf.get(f, 1.0) * float(boost or 1)) for w in words]
    return found


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def local_terms(terms: DataFrame) -> tuple[DataFrame, set[str] | None]:
    """The terms as a literal table, and their fields, if there are few; else as they are. A query's terms are few, and
    so everything that chose them runs once, not again in each plan that uses them."""
    rows = terms.limit(MAX_LOCAL + 1).collect()
    if len(rows) > MAX_LOCAL:
        return terms, None
    return terms.sparkSession.createDataFrame(rows, terms.schema), {r["field"] for r in rows}


def required(spec: int | str, n: int) -> int:
    """how many of n optional terms a document needs: `3`, `-1` (all but one), `75%`, `-25%`, or conditions like
    `2<75% 5<-1`, of which the last whose number is below n holds; with none all are needed."""
    text = str(spec).strip()
    if "<" in text:
        need = n
        for bound, rest in sorted((int(c.split("<", 1)[0]), c.split("<", 1)[1]) for c in re.sub(r"\s*<\s*", "<", text).split()):
            if n > bound:
                need = required(rest, n)
        return need
    if text.endswith("%"):
        share = float(text[:-1])
        need = int(n * share / 100) if share >= 0 else n - int(n * -share / 100)
    else:
        need = int(text) if int(text) >= 0 else n + int(text)
    return max(0, min(n, need))


def weigh(collection: Collection, terms: DataFrame, similarity: Similarity) -> tuple[DataFrame, DataFrame]:
    """(postings with each term's weight, one row of query statistics): one pass over the collection or its postings, cut
    down to the terms. Document frequencies come with the terms (column df) or from the table of terms."""
    terms, fields = local_terms(terms)
    few = fields is not None
    fields = sorted(fields) if few else [r["field"] for r in terms.select("field").distinct().collect()]
    tf = collection.tf(fields or list(collection.fields)[:1], terms)
    if similarity.idf_kind != "none" and "df" not in terms.columns:
        terms, _ = local_terms(terms.join(collection.df_table(fields or list(collection.fields)[:1], terms).select("field", "term", "df"), ["field", "term"], "left"))
    idf = F.lit(1.0) if similarity.idf_kind == "none" else similarity.idf(F.coalesce("df", F.lit(0)), collection.n_docs)
    weighted = terms.select("field", "term", "boost", idf.alias("idf"))
    stats = weighted.agg(F.coalesce(F.sum(F.pow(F.col("idf") * F.col("boost"), 2)), F.lit(0.0)).alias("squares"), F.count(F.lit(1)).alias("n_terms"), F.count_distinct("term").alias("n_words"))
    part = similarity.tf(F.col("freq")) * F.col("idf") * F.col("idf") * F.col("boost") * similarity.norm(F.col("len")) * similarity.payload(F.col("payload"))
    literal = F.broadcast(weighted) if few else weighted  # else all postings of a frequent term go to one task
    return tf.join(literal, ["field", "term"]).select(collection.key, "field", "term", part.alias("part")), stats


def score_terms(collection: Collection, terms: DataFrame, similarity: Similarity = CLASSIC, mm: int | str = 1, dismax: bool = False, tie: float = 0.0) -> DataFrame:
    """F2: (key, score, overlap) of documents with at least mm of the terms; a text is a specification as of required().

    With dismax (P4) a term counts once: its best field, and `tie` times the others. The statistics are one row.
    """
    if isinstance(mm, str):
        mm = required(mm, terms.select(*(["term"] if dismax else ["field", "term"])).distinct().count())
    postings, stats = weigh(collection, terms, similarity)
    if dismax:
        best = F.max("part") + F.lit(float(tie)) * (F.sum("part") - F.max("part"))
        postings = postings.groupBy(collection.key, "term").agg(best.alias("part"))
    summed = postings.groupBy(collection.key).agg(F.sum("part").alias("sum"), F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= max(1, mm))
    n = F.greatest(F.lit(1.0), F.col("n_words" if dismax else "n_terms").cast("double"))
    score = F.col("sum") * similarity.coord(F.col("overlap"), n) * similarity.query_norm(F.col("squares"))
    return summed.crossJoin(F.broadcast(stats)).select(collection.key, score.alias("score"), "overlap")


def top(scored: DataFrame, key: str, rows: int | None = 10, start: int = 0, sort: Sequence[Column] | None = None) -> DataFrame:
    """K1: rounded scores, best first, ties by key."""
    scored = scored.withColumn("score", F.round("score", DECIMALS)) if "score" in scored.columns else scored
    out = scored.orderBy(*(sort or [F.col("score").desc()]), key)
    return (out.offset(start) if start else out).limit(rows) if rows is not None else out


def search(collection: Collection, query: str, qf: Mapping[str, float] | None = None, fq: Sequence[str | Column] = (), similarity: Similarity = CLASSIC, mm: int | str = 0, boost: Column | None = None, rows: int | None = 10, start: int = 0, sort: Sequence[Column] | None = None, dismax: bool = False, tie: float = 0.0) -> DataFrame:
    """Documents that the query's boolean structure admits, scored by its terms.

    fq filters without scoring (F5); boost multiplies the score (P6). A query of match-all alone scores 1 (F11).
    """
    tree = parse(query).tree
    predicate = tree.predicate(collection.scope) if tree is not None else F.lit(True)
    for f in fq:
        if isinstance(f, str):
            if not f.strip():
                continue
            f = parse(f).tree.predicate(collection.scope)
        predicate = predicate & f
    found = Collection(collection.df.where(predicate), collection.key, collection.text, collection.keyword, collection.payload)
    terms = query_terms(collection, query, qf)
    keyed = found.df if boost is None else found.df.withColumn("__boost", boost)
    if not terms:
        scored = keyed.select(*keyed.columns, F.lit(1.0).alias("score"))
    else:
        marks = score_terms(collection, terms_frame(collection, terms), similarity, mm, dismax, tie).drop("overlap")
        scored = keyed.join(marks, collection.key, "left" if mm == 0 else "inner").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if boost is not None:
        scored = scored.withColumn("score", F.col("score") * F.coalesce(F.col("__boost"), F.lit(1.0)))
    wanted = [collection.key, "score"]
    return top(scored, collection.key, rows, start, sort).select(*wanted)


def require_matches(found: DataFrame, query: str) -> DataFrame:
    """found, or LookupError if it is empty."""
    if found.isEmpty():
        raise LookupError(f"nothing matches {query!r}")
    return found


def must_match(collection: Collection, seeds: DataFrame, same: Sequence[str], different: Sequence[str]) -> DataFrame:
    """documents with every term that the seeds have in the fields `same`, and none of theirs in `different`."""
    docs = collection.df
    for fields, wanted in ((same, True), (different, False)):
        if not fields:
            continue
        own = Collection(seeds, collection.key, collection.text, collection.keyword, collection.payload).tokens(fields).select("field", "term").distinct()
        hits = collection.tf(fields, own).select(collection.key, "field", "term").distinct()
        if wanted:
            n = own.count()
            if n:
                docs = docs.join(hits.groupBy(collection.key).count().where(F.col("count") == n), collection.key, "left_semi")
        else:
            docs = docs.join(hits, collection.key, "left_anti")
    return docs


def average_payload(collection: Collection, terms: Sequence[tuple[str, str, float]], rows: int | None = 10) -> DataFrame:
    """P1: the sum of boost times the mean payload of each exact term; other fields' parts are their plain scores."""
    frame = terms_frame(collection, terms)
    tf = collection.tf(sorted({f for f, _, _ in terms}), frame)
    scored = tf.join(F.broadcast(frame), ["field", "term"]).groupBy(collection.key).agg(F.sum(F.col("boost") * F.coalesce("payload", F.lit(1.0))).alias("score"))
    return top(scored, collection.key, rows)


def vector_search(collection: Collection, field: str, query: str | Mapping[str, float], rows: int | None = 10) -> DataFrame:
    """P2: `t^w` pairs, separated by blanks or commas, against a payload field: the sparse inner product."""
    if isinstance(query, str):
        pairs: dict[str, float] = {}
        for part in query.replace(" ", ",").split(","):
            if part:
                term, _, weight = part.partition("^")
                try:
                    pairs[term] = pairs.get(term, 0.0) + float(weight or 1)
                except ValueError as e:
                    raise QueryParseError(f"no weight in {part!r}") from e
        query = pairs
    if not query:
        raise QueryParseError("an empty vector")
    return average_payload(collection, [(field, t, w) for t, w in query.items()], rows)


def dense_dot(a: Column, b: Column | Sequence[float]) -> Column:
    """P2 for arrays of weights."""
    b = b if isinstance(b, Column) else F.array(*[F.lit(float(x)) for x in b])
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def boosted_terms(collection: Collection, query: str, synonyms: DataFrame, field: str, similarity: Similarity = CLASSIC, rows: int | None = 10) -> DataFrame:
    """P3: the query's words and their synonyms (term, synonym, boost) as raw weighted terms; `|` alone is nothing."""
    words = [w for w in query.lower().split() if w != "|"]
    if not words:
        raise QueryParseError("an empty query")
    own = terms_frame(collection, [(field, w, 1.0) for w in words])
    more = own.select("term").join(synonyms, "term").select(F.lit(field).alias("field"), F.col("synonym").alias("term"), F.col("boost").cast("double").alias("boost"))
    terms = own.union(more).groupBy("field", "term").agg(F.sum("boost").alias("boost"))
    return top(score_terms(collection, terms, similarity).drop("overlap"), collection.key, rows)


def phrase_matches(collection: Collection, field: str, phrase: str) -> DataFrame:
    """documents that hold the phrase's tokens in a row."""
    from lodestone.functions.analysis import contains_phrase

    return collection.df.where(contains_phrase(analyze(F.col(field)), analyze(F.lit(phrase))))


def per_field_rank(terms: DataFrame, n: int) -> DataFrame:
    """K2: the n best terms of each field; all for n <= 0."""
    if n <= 0:
        return terms
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.col("rank_by").desc(), "term"))
    return terms.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


#: P1-P4 by name: parsers of (collection, query, ...) to scored documents.
PARSERS: dict[str, Callable[..., DataFrame]] = {}


def register_parser(name: str, parser: Callable[..., DataFrame]) -> None:
    """Makes a parser known to run_query(); a name that is taken is replaced."""
    PARSERS[name] = parser


def run_query(collection: Collection, query: str, parser: str = "edismax", **how: object) -> DataFrame:
    """Q17: the query by the parser of that name; unknown names are QueryParseErrors."""
    if parser not in PARSERS:
        raise QueryParseError(f"no parser {parser!r}; there are {', '.join(sorted(PARSERS))}")
    return PARSERS[parser](collection, query, **how)


def _payload_query(collection: Collection, query: str, qf: Mapping[str, float] | None = None, rows: int | None = 10) -> DataFrame:
    return average_payload(collection, query_terms(collection, query, qf, analyzed=False), rows)


for _name, _parser in (("edismax", search), ("payloadEdismax", _payload_query), ("vector", lambda c, q, field, **how: vector_search(c, field, q, **how)), ("queryboost", lambda c, q, **how: boosted_terms(c, q, **how))):
    register_parser(_name, _parser)
