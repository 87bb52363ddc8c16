import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")]).select(column.alias("x")).first().x


GOLDEN = {
    "OpenAIServer": "open aiserver",
    "getHTTPResponse": "get httpresponse",
    "openai_compatible_server": "openai_compatible_server openai compatible server",
    "__init__": "init",
    "a_b": "a_b",
    "snake_caseWord": "snake_case snake case word",
    "été_x": "",
    "v2Model x": "v2 model",
    "": "",
}


@pytest.mark.parametrize("text", GOLDEN)
def test_tokens(spark, text):
    assert one(spark, T.tokens(F.lit(text))) == GOLDEN[text].split()


def test_tokens_of_null(spark):
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(
    "a,b,want",
    [(("p", 10, 30), ("p", 10, 30), 1.0), (("p", 0, 10), ("p", 10, 20), 0.0), (("p", 0, 100), ("p", 95, 195), 5 / 195), (("p", 0, 100), ("p", 90, 190), 10 / 190), (("p", 0, 9), ("q", 0, 9), 0.0), (("p", 5, 5), ("p", 5, 5), 0.0)],
)
def test_span_iou(spark, a, b, want):
    assert one(spark, T.span_iou(*map(F.lit, (*a, *b)))) == pytest.approx(want)


@pytest.mark.parametrize(
    "raw,want",
    [("<think>internal reasoning</think>The answer.", "The answer."), ("a</think>b</think> c", "b c"), ("x <think>y\nz</think> w", "w"), (" plain ", "plain"), ("<think>open", "open"), ("k</think> <think>a</think>b<think>", "b")],
)
def test_clean_answer(spark, raw, want):
    assert one(spark, T.clean_answer(F.lit(raw))) == want


def test_strip_and_blank_are_unicode(spark):
    for t in (" 　x\x1c", "\x1f", "", " a "):
        assert one(spark, T.strip(F.lit(t))) == t.strip()
        assert one(spark, T.not_blank(F.lit(t))) == bool(t.strip())


def test_spans_are_code_points(spark):
    assert one(spark, T.span(F.lit("é😀abc"), F.lit(1), F.lit(3))) == "😀a"
    assert one(spark, T.span(F.lit("AAAA BBBB CCCC"), F.lit(5), F.lit(9))) == "BBBB"


def test_vectors(spark):
    assert one(spark, T.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])
    assert one(spark, T.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0]
    assert one(spark, T.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(5.0)))) == 13


def test_cache_key_tells_apart(spark):
    import hashlib

    key = one(spark, T.cache_key("search", F.lit("q"), {"k": 5, "index_dir": "d"}))
    assert key == hashlib.sha256(b"search:q:[('index_dir', 'd'), ('k', 5)]").hexdigest()
    others = {one(spark, T.cache_key(n, F.lit(q), {"k": k}, s)) for n, q, k, s in (("a", "q", 1, ""), ("b", "q", 1, ""), ("a", "r", 1, ""), ("a", "q", 2, ""), ("a", "q", 1, "s"))}
    assert len(others) == 5


def test_chat_messages(spark):
    m = one(spark, T.chat_messages(F.lit("why?"), F.lit("ctx"), "sys"))
    assert [(x.role, x.content) for x in m] == [("system", "sys"), ("user", "Context:\nctx\n\nQuestion: why?\n\nDirect Answer:")]


def test_texts_for_indexes(spark):
    assert one(spark, T.lexical_text(F.lit("p"), F.lit("c"))) == "p p c"
    assert one(spark, T.embedding_text(F.lit("p"), F.lit("c"))) == "p: c"
    assert one(spark, T.citation(F.lit("p"), F.lit(1), F.lit(2))) == "p [1:2]"


def test_workers_see_the_same_tokens(spark):
    import random

    rng = random.Random(3)
    texts = [None, "", "a", "_", "__a__", "_ab_", "snake_case_x", "camelCase HTTPServer", "a_b", "x__yy", "é K İstanbul ab", "a1 B2_ _c3__d"]
    texts += ["".join(rng.choice("abAB_1 .é\n") for _ in range(rng.randrange(40))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokens(F.col("t")).alias("a")).collect()
    assert [r for r in rows if r.a != T.token_list(r.t or "")] == []
