"""The written index, and requests that read it."""

import pytest
from lodestone import __version__
from lodestone.operators import facets, search, spell
from lodestone.operators import more_like_these as M
from lodestone.plans.parser import QueryParseError, parse
from lodestone.sources import index
from lodestone.sources.collection import Collection
from lodestone.sources.index import IndexedCollection
from pyspark.sql import functions as F

ROWS = [(1, "Java and SQL java", "en"), (2, "java hadoop", "en"), (3, "ruby on rails", "fr"), (4, "SQL server admin", None), (5, None, "fr"), (6, "", "de")]


@pytest.fixture(scope="module")
def docs(spark):
    return Collection(spark.createDataFrame(ROWS, "doc_id long, text string, lang string"), "doc_id", ("text",), ("lang",))


@pytest.fixture(scope="module")
def indexed(docs, tmp_path_factory):
    return IndexedCollection.build(docs, str(tmp_path_factory.mktemp("index") / "i"))


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_same_tables_as_without(spark, docs, indexed):
    assert indexed.n_docs == docs.n_docs == 6
    assert rows(indexed.tf(["text", "lang"])) == rows(docs.tf(["text", "lang"]))
    assert rows(indexed.df_table(["text"])) == rows(docs.df_table(["text"]))
    only = spark.createDataFrame([("text", "java"), ("lang", "fr"), ("text", "none"), ("text", "java")], "field string, term string")
    assert rows(indexed.tf(["text", "lang"], only)) == rows(docs.tf(["text", "lang"], only)) != []
    assert rows(indexed.df_table(["text"], only)) == rows(docs.df_table(["text"], only))
    assert indexed.tf(["text"], only.limit(0)).count() == docs.tf(["text"], only.limit(0)).count() == 0
    assert rows(indexed.tf(["text"], limit=1)) == rows(docs.tf(["text"], limit=1))


def test_many_terms_go_by_join(spark, docs, indexed, monkeypatch):
    only = spark.createDataFrame([("text", "java"), ("lang", "fr"), ("text", "sql")], "field string, term string")
    want = rows(docs.tf(["text", "lang"], only))
    monkeypatch.setattr("lodestone.sources.collection.MAX_LOCAL", 1)
    assert rows(indexed.tf(["text", "lang"], only)) == rows(docs.tf(["text", "lang"], only)) == want


def test_terms_read_their_buckets_alone(spark, indexed):
    plan = indexed.tf(["text"], spark.createDataFrame([("text", "java")], "field string, term string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "Generate explode" not in plan


def test_tokens_are_counted_without_an_exchange_of_their_own(docs):
    plan = docs.tf(["text"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_odd_collections(spark, tmp_path):
    for k, some in enumerate(([], [(1, None, None)], [(1, "a a", "x"), (1, "a b b", "x"), (None, "a", None), (2, "w " * 30_000, "y")])):
        c = Collection(spark.createDataFrame(some, "doc_id long, text string, lang string"), "doc_id", ("text",), ("lang",))
        i = IndexedCollection.build(c, f"{tmp_path}/{k}")
        assert rows(i.tf(["text", "lang"])) == rows(c.tf(["text", "lang"])) and i.n_docs == len(some)


def test_kept_until_the_source_changes(spark, docs, tmp_path):
    path = f"{tmp_path}/t.parquet"
    docs.df.write.parquet(path)
    own = lambda: index.kept(Collection(spark.read.parquet(path), "doc_id", ("text",), ("lang",)), path)
    first = own()
    assert own().path == first.path
    docs.df.union(docs.df.limit(1)).write.mode("overwrite").parquet(path)
    again = own()
    assert again.path != first.path and again.n_docs == 7


def test_requests_agree(docs, indexed):
    p = M.RecommendParams(min_df=1)
    assert rows(M.MoreLikeThese(docs, p).from_docs([1]).response) == rows(M.MoreLikeThese(indexed, p).from_docs([1]).response)
    f = M.FeedbackParams(min_df=1)
    assert rows(M.BlindFeedback(docs, f).run("java").response) == rows(M.BlindFeedback(indexed, f).run("java").response)
    nb = facets.NaiveBayes().fit(docs, "lang")
    assert rows(nb.transform(docs)) == rows(nb.transform(indexed))


@pytest.mark.parametrize(("spec", "n", "need"), [("3", 10, 3), (3, 2, 2), ("-1", 10, 9), ("75%", 10, 7), ("-25%", 10, 8), ("2<75%", 2, 2), ("2<75%", 8, 6), ("2<-25% 9<-3", 9, 7), ("2 < -25% 9 < -3", 10, 7), ("0", 5, 0), ("-20", 5, 0), ("3<2", 3, 3)])
def test_minimum_of_terms(spec, n, need):
    assert search.required(spec, n) == need


def test_minimum_by_specification(spark, docs):
    terms = search.terms_frame(docs, [("text", t, 1.0) for t in ("java", "sql", "and", "hadoop")])
    assert [r.doc_id for r in search.score_terms(docs, terms, mm="75%").collect()] == [1]
    assert sorted(r.doc_id for r in search.score_terms(docs, terms, mm="50%").collect()) == [1, 2]


def test_prefixes(docs):
    ids = lambda q: sorted(r.doc_id for r in docs.match(parse(q).tree.predicate(docs.scope)).collect())
    assert ids("ja*") == [1, 2] and ids("lang:f*") == [3, 5] and ids("JAV* AND had*") == [2] and ids("zz*") == []
    assert search.search(docs, "rub*").count() == 1


def test_parsers_by_name(spark, docs):
    assert {r.doc_id for r in search.run_query(docs, "ruby").collect()} == {3}
    vectors = Collection(spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, 0.0])], "id long, v array<double>"), "id", (), (), ("v",))
    assert [(r.id, r.score) for r in search.run_query(vectors, "0^2 1^1", "vector", field="v").collect()] == [(1, 4.0), (2, 1.0)]
    assert [(r.id, r.score) for r in search.run_query(vectors, "v:0", "payloadEdismax").collect()] == [(1, 1.0), (2, 0.5)]
    search.register_parser("all", lambda c, q: c.df)
    assert search.run_query(docs, "x", "all").count() == 6
    with pytest.raises(QueryParseError):
        search.run_query(docs, "x", "none")


def test_models_load_and_age(spark, docs, tmp_path):
    model = facets.NaiveBayes().fit(docs, "lang")
    model.save(str(tmp_path))
    assert rows(facets.NaiveBayesModel.load(spark, str(tmp_path)).transform(docs)) == rows(model.transform(docs))
    now, made = [0.0], []
    cache = facets.ModelCache(10.0, lambda: now[0])
    make = lambda: made.append(1) or len(made)
    assert cache.get("a", make) == cache.get("a", make) == 1
    now[0] = 11.0
    assert cache.get("a", make) == 2 and cache.get("a", make, refresh=True) == 3 and cache.get("b", make) == 4


def test_spelling_extensions(spark):
    words = spark.createDataFrame([("form", 5), ("from", 90), ("frog", 7)], "phrase string, weight long")
    tokens = spark.createDataFrame([("frmo",)], "token string")
    best = lambda **how: [s.word for s in spell.SpellChecker(words, 10_000, None, spell.SpellParams(**how)).suggestions(tokens).first().suggestions]
    assert best(distance="transpositions")[0] == "from" and best(by="freq")[0] == "from"
    assert best(by=[F.col("freq")]) == ["form", "frog", "from"]
    assert best(distance=lambda a, b: F.when(b == "frog", 1).otherwise(9)) == ["frog"]
    spell.DISTANCES["length"] = lambda a, b, most: F.abs(F.length(a) - F.length(b))
    assert len(best(distance="length")) == 3
    picks = list(spell.best_first([3, 1, 2], 100))
    assert len(picks) == len(set(picks)) == 6 and [sum(p) for p in picks] == sorted(sum(p) for p in picks) and len(list(spell.best_first([50, 50], 7))) == 7
    one, two = (spark.createDataFrame(r, "collation string, rank int, hits long") for r in ([("a b", 1, 5), ("a c", 2, 1)], [("a b", 3, 2), ("a d", 1, 1)]))
    assert [tuple(r) for r in spell.merge_collations([one, two], 2).collect()] == [("a d", 1, 1), ("a c", 2, 1)]


def test_refresh_require_and_styles(spark, docs):
    words = spark.createDataFrame([("java", 9)], "phrase string, weight long")
    registry = spell.SpellRegistry({"a": spell.SpellChecker(words, 10, None, spell.SpellParams(count=1))})
    registry.refresh("a", words.withColumn("weight", F.lit(3).cast("long")), 20)
    assert registry.checkers["a"].n_docs == 20 and registry.checkers["a"].params.count == 1 and registry.checkers["a"].vocabulary.first().weight == 3
    with pytest.raises(LookupError):
        search.require_matches(docs.df.where("false"), "x")
    m = M.MoreLikeThese(docs, M.RecommendParams(min_df=1))
    with pytest.raises(LookupError):
        m.from_docs([99], required=True)
    terms = m.interesting_terms(m.seeds([1]))
    assert M.list_terms(terms, "none").count() == 0 and M.list_terms(terms, "list").columns == ["term"]
    assert set(M.list_terms(terms, "debug").columns) >= {"field", "term", "tf", "df", "idf", "weight", "boost", "score"}
    head = M.MoreLikeThese(docs, M.RecommendParams(min_df=1, head_fields=("text",))).text_terms("sql", "java java")
    assert {r.term: r.tf for r in head.collect()} == {"sql": 1.0, "java": 2.0}
    assert __version__.count(".") == 2


def test_windowed_counts(spark, tmp_path):
    from lodestone.streaming import live

    rows_ = [(f"2024-01-01 00:{m:02d}:00", t) for m, t in ((1, "a b"), (20, "a"), (59, "b"))] + [("2024-01-01 05:00:00", "a")]
    spark.createDataFrame(rows_, "at string, text string").selectExpr("cast(at as timestamp) at", "text").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("at timestamp, text string").parquet(f"{tmp_path}/in")
    live.term_counts(stream, "at", "text").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {(str(r.window.start), r.term): r["count"] for r in spark.table("counted").collect()}
    assert got == {("2024-01-01 00:00:00", "a"): 2, ("2024-01-01 00:00:00", "b"): 2, ("2024-01-01 05:00:00", "a"): 1}
