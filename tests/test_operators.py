import math

import pytest
from lodestone.functions import analysis as A
from lodestone.functions import scalar as S
from lodestone.operators import facets, filters, search, spell, suggest
from lodestone.operators import more_like_these as M
from lodestone.operators.similarity import SIMILARITIES, quantise_norm
from lodestone.sources import dictionaries
from lodestone.sources.collection import Collection
from pyspark.sql import functions as F


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first().v


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Java and SQL java", "en"), (2, "java hadoop", "en"), (3, "ruby on rails", "fr"), (4, "SQL server admin", None), (5, None, "fr"), (6, "", "de")]
    return Collection(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", ("text",), ("lang",))


def test_token_operators(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (1, "b", 2.0), (1, "c", None)], "doc_id long, term string, payload float")
    assert {r.term: round(r.payload, 6) for r in A.mean_payload(t).collect()} == {"a": 0.707107, "b": 0.707107}
    weights = [0.5, 0.0, None, 0.0001, 1e7]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "i int, w float")
    assert [r.v for r in df.select(A.payload_boost(F.lit("java"), F.col("w")).alias("v")).collect()] == ["java^0.5", "", "", "", "java^1.0E7"]
    assert one(spark, A.constant_tokens(F.array(F.lit("a"), F.lit("b"), F.lit("c")), "x")) == ["x"] * 3
    positions = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")), F.array(F.lit("d"), F.lit("e")))
    assert sorted(one(spark, A.concatenate(positions))) == ["a c d", "a c e", "b c d", "b c e"]
    assert one(spark, A.concatenate(F.array().cast("array<array<string>>"))) == []
    assert one(spark, A.analyze(F.lit("Ab, c-D! É9"))) == ["ab", "c", "d", "é9"]
    assert one(spark, A.analyze(F.lit("a b c"), 2)) == ["a", "b"]
    assert one(spark, A.drop_noise(A.analyze(F.lit("a bb ccc dddd the")), 2, 3, ["the"])) == ["bb", "ccc"]
    assert one(spark, A.first_token(F.lit(" -Big Apple"))) == "big" and one(spark, A.first_token(F.lit("--"))) is None
    spans = one(spark, A.tokens_with_offsets(F.lit("  Ab c")))
    assert [(t.term, t.start, t.end, t.position) for t in spans] == [("ab", 2, 4, 0), ("c", 5, 6, 1)]
    assert all(t.type is None for t in one(spark, A.erase_types(A.tokens_with_offsets(F.lit("a b")))))


@pytest.mark.parametrize(("kind", "value"), [("doc", 1 / 3), ("param", 1 / 2), ("sorensen", 2 / 5), ("jaccard", 1 / 4), ("other", 1 / 3)])
def test_term_intersect(spark, kind, value):
    text = F.lit("java sql hadoop java")
    assert one(spark, S.term_intersect(text, "java python", kind)) == pytest.approx(value)
    assert one(spark, S.term_intersect(text, "", kind)) == 0 == one(spark, S.term_intersect(F.lit(None).cast("string"), "java", kind))


def test_scalar_functions(spark):
    text, none = F.lit("a a b"), F.lit(None).cast("string")
    assert one(spark, S.term_overlap(F.lit("java sql hadoop"), "java python")) == pytest.approx(1 / 3)
    assert one(spark, S.term_overlap(F.lit("java sql hadoop"), "java python", False)) == 0.5
    assert one(spark, S.term_overlap(none, "java")) == 0 == one(spark, S.term_overlap(text, ""))
    assert (one(spark, S.field_len(text)), one(spark, S.field_len(text, "total")), one(spark, S.field_len(none))) == (2, 3, -1)
    assert (one(spark, S.field_values(text)), one(spark, S.field_values(none))) == ("a||b", "")
    assert (one(spark, S.term_exists(text, "a")), one(spark, S.term_exists(none, "a"))) == (1, 0)
    assert one(spark, S.divide(S.add(F.lit(1), 2), 0)) is None and one(spark, S.divide(S.add(F.lit(1), 2), 2)) == 1.5


def test_similarities(spark):
    s = SIMILARITIES["default"]
    assert one(spark, s.tf(F.lit(4))) == 2
    assert one(spark, s.idf(F.lit(5), 10)) == pytest.approx(1.510826, abs=1e-6)
    assert one(spark, s.norm(F.lit(10))) == 0.3125
    assert one(spark, SIMILARITIES["payload_aware"].norm(F.lit(10))) == pytest.approx(0.316228, abs=1e-6)
    for n in (1, 4, 16, 64, 256, 3, 5, 1000):
        f = 1 / math.sqrt(n)
        e = math.floor(round(math.log2(f), 9))
        assert one(spark, quantise_norm(F.lit(f))) == pytest.approx(2.0**e * math.floor(f / 2.0**e * 8 + 1e-9) / 8)
    assert one(spark, SIMILARITIES["payload_only"].payload(F.lit(None).cast("double"))) == 1
    assert one(spark, SIMILARITIES["no_length_norm_no_tf"].tf(F.lit(7))) == 1


def test_profile_weights(spark):
    rows = [(i, " ".join([*(["java"] * 3 if i == 0 else ["java"] if i < 5 else []), *(["sql"] if i < 9 else []), *(["rare"] * 2 if i == 0 else ["rare"] if i == 1 else [])]) or "x") for i in range(10)]
    c = Collection(spark.createDataFrame(rows, "doc_id long, text string"))
    for params, weights, scores in (
        (M.RecommendParams(), (4.818407, 1.095310), (0.975123, 0.221663)),
        (M.RecommendParams(qf={"text": 2.0}), (4.818407, 1.095310), (1.950247, 0.443326)),
        (M.RecommendParams(log_tf=True), (2.226577, 0.759211), (0.946491, 0.322731)),
    ):
        m = M.MoreLikeThese(c, params)
        got = {r.term: r for r in m.interesting_terms(m.seeds([0])).collect()}
        assert set(got) == {"java", "sql"}
        for t, w, s in zip(("java", "sql"), weights, scores, strict=True):
            assert got[t].weight == pytest.approx(w, abs=1e-5) and got[t].score == pytest.approx(s, abs=1e-5)
    assert [r.term for r in M.list_terms(m.interesting_terms(m.seeds([0])), "list").collect()] == ["java", "sql"]
    assert M.list_terms(m.interesting_terms(m.seeds([0])), "none").count() == 0


def test_recommendation_and_feedback(docs):
    low = {"min_df": 1}
    answer = M.MoreLikeThese(docs, M.RecommendParams(**low)).from_docs([1])
    assert [r.doc_id for r in answer.response.collect()] == [2, 4]
    assert 1 in {r.doc_id for r in M.MoreLikeThese(docs, M.RecommendParams(include_seeds=True, **low)).from_docs([1]).response.collect()}
    assert [r.doc_id for r in M.MoreLikeThese(docs, M.RecommendParams(same=("lang",), **low)).from_docs([1]).response.collect()] == [2]
    assert [r.doc_id for r in M.MoreLikeThese(docs, M.RecommendParams(different=("lang",), **low)).from_docs([1]).response.collect()] == [4]
    assert [r.doc_id for r in M.MoreLikeThese(docs, M.RecommendParams(**low)).from_text("ruby", "rails").response.collect()] == [3]
    with pytest.raises(LookupError):
        M.MoreLikeThese(docs).from_docs("nosuch", required=True)
    assert {r.doc_id for r in M.BlindFeedback(docs, M.FeedbackParams(**low)).run("java").response.collect()} == {1, 2}
    assert {r["value"]: r["count"] for r in answer.facets(docs, ["lang"])["lang"].collect()} == {"en": 1}


def test_search(docs):
    assert [r.doc_id for r in search.search(docs, "sql AND NOT server").collect()] == [1]
    assert {r.doc_id for r in search.search(docs, "java", fq=["", "lang:en"]).collect()} == {1, 2}
    assert {r.doc_id for r in search.search(docs, "*:*", rows=None).collect()} == {1, 2, 3, 4, 5, 6}
    assert [r.doc_id for r in search.search(docs, '"sql server"').collect()] == [4]
    assert [r.doc_id for r in search.phrase_matches(docs, "text", "on rails").collect()] == [3]
    with pytest.raises(search.QueryParseError):
        search.vector_search(docs, "text", "a^x")
    with pytest.raises(ValueError, match="unknown field"):
        search.search(docs, "nofield:x")


def test_joint_model(spark):
    df = spark.createDataFrame([("A", "x"), ("A", "x"), ("A", "y"), ("B", "x"), ("B", "y")], "c string, t string")
    model = facets.JointProbabilityModel.fit(facets.pivot_counts(df, ["c", "t"]), "c", "t")
    assert {r.value: round(r.p, 6) for r in model.prior().collect()} == {"A": 0.599602, "B": 0.400398}
    got = {(r.value, r.sub_value): r for r in model.conditional().collect()}
    assert got["A", "x"].joint == pytest.approx(0.398810, abs=1e-6) and got["A", "x"].conditional == pytest.approx(0.665124, abs=1e-6)
    assert model.unseen() == pytest.approx(0.001984, abs=1e-6)


@pytest.mark.parametrize(("how", "a", "b"), [({}, -1.322090, -1.606469), ({"binary": True}, -2.015237, -2.299616), ({"log_tf": True}, -2.287702, -2.572081)])
def test_naive_bayes(spark, how, a, b):
    rows = [(1, "x", "A"), (2, "x y", "A"), (3, "", "A"), (4, "x", "B"), (5, "y", "B"), (9, "x x y", None)]
    c = Collection(spark.createDataFrame(rows, "doc_id long, text string, c string"))
    got = {r["class"]: r for r in facets.NaiveBayes(top_n=2, **how).fit(c, "c").transform(c, "c").where("doc_id = 9").collect()}
    assert got["A"]["score"] == pytest.approx(a, abs=1e-5) and got["B"]["score"] == pytest.approx(b, abs=1e-5)
    assert got["A"]["rank"] == 1


def test_pivots_limit_and_nest(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "z")], "p string, q string")
    got = {(r.level, r.p, r.q): r["count"] for r in facets.pivot_counts(df, ["p", "q"], 1, 1).collect()}
    assert got == {(1, "a", None): 3, (2, "a", "x"): 2}
    nested = {r.p: [(x["count"], x.value) for x in r.children] for r in facets.nest(facets.pivot_counts(df, ["p", "q"]), "p", "q").collect()}
    assert nested == {"a": [(2, "x"), (1, "y")], "b": [(1, "z")]}


def test_entropy_and_stumps(spark):
    for p, n, want in ((3, 0, 0), (2, 2, 0.693147), (3, 1, 0.562335)):
        assert one(spark, filters.entropy(F.lit(p), F.lit(n))) == pytest.approx(want, abs=1e-6)
    df = spark.createDataFrame([("s2", 2, 0), ("s5", 5, 0), ("mix", 6, 3)], "feature string, pos long, neg long")
    assert [r.feature for r in filters.decision_stumps(df).collect()] == ["s5", "s2", "mix"]


def test_suggest_filters(docs):
    got = filters.suggest_filters(docs, F.col("doc_id") < 3, F.col("doc_id") > 2, min_df=1, suggestions=2).collect()
    assert got[0]["filter"] == '+(text:"java")' and [r["rank"] for r in got] == [1, 2]
    assert filters.suggest_filters(docs, F.lit(False), F.col("doc_id") == 3, min_df=1).count() > 0


def test_dictionaries_and_suggest(spark, tmp_path, docs):
    (tmp_path / "d.txt").write_text("apache hadoop\t12\njava\nsql\t3.7\nJava\t4\nJAVA dev\t2\n")
    d = dictionaries.read_dictionary(spark, str(tmp_path / "d.txt"))
    assert {(r.phrase, r.weight) for r in d.collect()} == {("apache hadoop", 12), ("java", 1), ("sql", 3), ("Java", 4), ("JAVA dev", 2)}
    index = suggest.SuggestIndex.build(d)
    index.save(str(tmp_path / "i"))
    index = suggest.SuggestIndex.load(spark, str(tmp_path / "i"))
    assert [(r.suggestion, r.weight) for r in index.suggest("j", 5).collect()] == [("java", 1)]
    assert [(r.suggestion, r.weight) for r in index.suggest_cases("ja", 5).collect()] == [("Java", 4), ("JAVA dev", 2)]
    assert len(suggest.case_variants("java dev")) == 9
    assert [r.phrase for r in index.suggest_many(spark.createDataFrame([("ap",), ("",)], "prefix string")).collect()] == ["apache hadoop"]
    assert dictionaries.parse_fields("a b,c") == ["a", "b,c"] and dictionaries.parse_fields("a,,b") == ["a", "b"]
    assert dictionaries.split_list("a, b c") == ["a", "b", "c"] and dictionaries.parse_boosts("f^2 g") == {"f": 2.0, "g": 1.0}
    assert {r.phrase for r in dictionaries.frequent_terms(docs, "text", 0.3).collect()} == {"java", "sql"}


def test_spelling(spark, docs):
    words = spark.createDataFrame([("license", 9), ("licence", 3), ("the", 90), ("form", 5)], "phrase string, weight long")
    tokens = spark.createDataFrame([("licnse",), ("the",), ("from",), ("qqqqq",)], "token string")
    typos = spark.createDataFrame([("from", "form")], "typo string, correction string")
    got = {r.token: [s.word for s in r.suggestions] for r in spell.SpellChecker(words, 10_000, typos).suggestions(tokens).collect()}
    assert got == {"licnse": ["license", "licence"], "the": [], "from": ["form"], "qqqqq": []}
    swap = spell.SpellChecker(words, 10_000, params=spell.SpellParams(transpositions=True, max_edits=1, accuracy=0.1))
    assert [s.word for s in next(r for r in swap.suggestions(tokens).collect() if r.token == "from").suggestions] == ["form"]
    found, right, texts = spell.SpellChecker(words, 10_000).check("Licnse (the)")
    assert [(r.token, r.start, r.end) for r in found.collect()] == [("licnse", 0, 6), ("the", 8, 11)] and not right and texts == [("license (the)", -1)]
    assert spell.SpellChecker(words, 10_000).check("java sql", docs)[1]
    registry = spell.SpellRegistry({"a": spell.SpellChecker(words, 10_000)})
    assert [r.word for r in registry.suggest(["a"], tokens).where("token = 'licnse'").orderBy("rank").collect()] == ["license", "licence"]
    with pytest.raises(KeyError):
        registry.select(["b"])
    assert registry.own_params({"a.x": "1", "b.x": "2"}, "a") == {"x": "1"}


def test_streaming(spark, sf, tmp_path):
    from lodestone.streaming import live

    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    table.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    terms = spark.createDataFrame([("the", 1.5), ("license", 2.0)], "term string, boost double")
    q = live.score_stream(stream, terms).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination()
    static = live.score_stream(table, terms)
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, static.collect()))
    seen = []
    live.rebuild_on_commit(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(seen) == table.count()


def test_score_stream_by_many_terms(spark):
    from lodestone.streaming import live

    docs = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(0, 12_000, 2)] + [(-1, None), (-2, "other")], "doc_id long, text string")
    terms = spark.range(12_000).selectExpr("concat('w', id) AS term", "id + 0.5D AS boost")
    got = {r.doc_id: (r.score, r.overlap) for r in live.score_stream(docs, terms).collect()}
    assert got == {i: (2.0 * i + 2, 2) for i in range(0, 12_000, 2)}
