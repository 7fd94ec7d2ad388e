"""What requests send and hold as tables grow."""

import pytest
from lodestone import catalog
from lodestone.operators import facets, search, spell
from lodestone.operators.similarity import SIMILARITIES
from lodestone.plans.parser import parse
from lodestone.sources import index
from lodestone.sources.collection import Collection
from pyspark.sql import functions as F

ROWS = [(1, "Java and SQL java", "en"), (2, "java hadoop", "en"), (3, "ruby on rails", "fr"), (4, "SQL server admin java", None), (5, None, "fr"), (6, "", "de"), (7, "ruby java sql and on", "fr")]


@pytest.fixture
def docs(spark):
    return Collection(spark.createDataFrame(ROWS, "doc_id long, text string, lang string"), "doc_id", ("text",), ("lang",))


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["score_cosine", "bool_phrase", "mlt_noboost", "mlt_boostfn"])
def test_one_request_builds_no_index(spark, sf, monkeypatch, name):
    monkeypatch.setattr(index, "_kept", {})
    monkeypatch.setattr(index.IndexedCollection, "build", None)
    assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_an_index_that_was_built_is_used(spark, docs, tmp_path):
    path = f"{tmp_path}/t.parquet"
    docs.df.write.parquet(path)
    own = Collection(spark.read.parquet(path), "doc_id", ("text",), ("lang",))
    assert index.held(own, path) is own
    made = index.kept(own, path)
    assert index.held(own, path).path == made.path
    docs.df.limit(1).write.mode("overwrite").parquet(path)
    assert index.held(own, path) is own


def test_partitions_of_counted_texts_follow_the_table(spark, docs, monkeypatch):
    for size, least, most in ((6 << 30, 1000, 8192), (600 << 20, 100, 200), (1000, 1, 1)):
        monkeypatch.setattr(Collection, "source_bytes", lambda self, size=size: size)
        assert least <= docs.parts() <= most
        assert docs.parts() == 1 or f", {docs.parts()}), REPARTITION_BY_NUM" in plan(docs.tf(["text"]))
    monkeypatch.setattr(Collection, "source_bytes", lambda self: (1 << 63) - 1)
    assert docs.parts() is None


def test_postings_of_a_term_are_not_sent_to_one_task(docs):
    scored = search.score_terms(docs, search.terms_frame(docs, [("text", "java", 1.0), ("text", "sql", 2.0)]), SIMILARITIES["cosine"])
    text = plan(scored)
    assert "hashpartitioning(field" not in text and "SortMergeJoin" not in text and text.count("hashpartitioning(doc_id") == 1
    assert {r.doc_id for r in scored.collect()} == {1, 2, 4, 7}


def test_texts_without_the_letters_are_not_analysed(docs):
    where = docs.df.where(parse('"ruby java" or SQL').tree.predicate(docs.scope))
    assert "Contains(lower(text" in where._jdf.queryExecution().optimizedPlan().toString().replace("contains", "Contains")
    assert sorted(r.doc_id for r in where.collect()) == [1, 4, 7]
    assert sorted(r.doc_id for r in docs.df.where(parse("NOT rub").tree.predicate(docs.scope)).collect()) == [1, 2, 3, 4, 5, 6, 7]


@pytest.mark.parametrize("how", [{}, {"binary": True}, {"log_tf": True}, {"multinomial": True}, {"include_existing": False}])
@pytest.mark.parametrize("pairs", [1, 9])
def test_frequent_terms_meet_their_pairs_where_they_are(spark, docs, monkeypatch, how, pairs):
    model = facets.NaiveBayes(top_n=3, **how).fit(docs, "lang")
    want = rows(model.transform(docs, "lang"))
    monkeypatch.setattr(facets, "BROADCAST_PAIRS", pairs)
    bare = Collection(docs.df.drop("lang"), "doc_id", ("text",))
    assert rows(model.transform(bare, "lang", docs.df.select("doc_id", "lang"))) == want
    counts = bare.tf(["text"]).select("doc_id", "field", "term", F.lit(1.0).alias("times"))
    met = model._met(counts, 4, pairs // 3)
    assert "LeftAnti" in plan(met)
    assert rows(met.select("doc_id", "term", "class")) == rows(counts.join(model.joints, ["field", "term"]).select("doc_id", "term", "class"))


def test_no_vocabulary_is_sorted_for_a_few_tokens(spark):
    words = spark.createDataFrame([("form", 5), ("from", 90), ("frog", 7)], "phrase string, weight long")
    found = spell.SpellChecker(words, 10_000, spark.createDataFrame([("frmo", "frog")], "typo string, correction string")).suggestions(spark.createDataFrame([("frmo",), ("from",)], "token string"))
    got = {r.token: [s.word for s in r.suggestions] for r in found.collect()}
    assert got == {"frmo": ["frog", "from", "form"], "from": []}
    asked = spell.SpellChecker(words, 10_000).suggestions(spark.createDataFrame([("frmo",)], "token string"))
    assert "SortMergeJoin" not in plan(asked)


def test_vocabularies_are_counted_once(spark, sf):
    checker = catalog._checker(spark, catalog._halves(spark, sf)[0])
    assert "lower(text" not in plan(checker.suggestions(spark.createDataFrame([("licnese",)], "token string")))
