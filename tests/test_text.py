"""Golden cases of the column functions."""

import re

import pytest
from pyspark.sql import functions as F

from weft.functions import text as T


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col.alias("x")).first()[0]


def test_terms(spark):
    assert one(spark, T.split_terms(F.lit("How do-I, a_b?"))) == ["How", "do", "I", "a", "b"]
    assert one(spark, T.shortlist_tokens(F.lit("billing/InvoiceDisputes"))) == ["billing", "invoice", "disputes"]
    assert one(spark, T.distinct_terms(F.lit("graph graph Graph"))) == ["graph", "Graph"]
    assert len(one(spark, T.distinct_terms(F.lit(" ".join(f"t{i}" for i in range(32)))))) == 32
    with pytest.raises(Exception, match="distinct terms"):
        one(spark, T.distinct_terms(F.lit(" ".join(f"t{i}" for i in range(33)))))
    assert one(spark, T.term_overlap(F.lit("graph database extra"), F.lit("graph-database/y"))) == pytest.approx(2 / 3)
    assert one(spark, T.term_overlap(F.lit("?"), F.lit("x"))) == 0.0


def fnv(b):
    h = 0xCBF29CE484222325
    for x in b:
        h = (h ^ x) * 0x100000001B3 % 2**64
    return h - 2**64 if h >= 2**63 else h


@pytest.mark.parametrize("text", ["", "a", "billing/invoice", "é日本"])
def test_path_hash(spark, text):
    assert one(spark, T.path_hash(F.lit(text))) == fnv(text.encode())


def test_paths_and_bytes(spark):
    assert one(spark, T.normalize_topic_path(F.lit("./a//b\\c/"))) == "a/b/c"
    assert one(spark, T.normalize_topic_path(F.lit("/"))) == "/"
    h = one(spark, T.header_offsets(F.lit("é\n# A \n#no\n####### x\n## B")))
    assert [(x.header, x.offset) for x in h] == [("# A", 3), ("## B", 22)]
    ranges = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end")), F.struct(F.lit(3).alias("start"), F.lit(4).alias("end")))
    assert bytes(one(spark, T.slice_bytes(F.lit("éab"), ranges))) == "éb".encode()
    assert one(spark, T.redirect_stub(F.array(F.lit(3), F.lit(9))), ).endswith("\n3\n9\n")


def test_crossing(spark):
    got = [one(spark, T.crossing(F.lit(a), F.lit(b), 100)) for a, b in ((99, 101), (150, 200), (100, 101), (90, 100), (120, 80))]
    assert got == [True, False, True, False, False]


def test_mail_keys(spark):
    assert one(spark, T.normalize_subject(F.lit(" Re: FWD:  re : Hello   World "))) == "hello world"
    assert one(spark, T.thread_key(F.lit(" <a> "), F.lit("<b> <c>"), F.lit("x"))) == "<a>"
    assert one(spark, T.thread_key(F.lit(" "), F.lit("<b> <c>"), F.lit("x"))) == "<b>"
    assert one(spark, T.thread_key(F.lit(None), F.lit(None), F.lit("Re: X"))) == "subject:x"


@pytest.mark.parametrize("text,want", [("3, 1, 2", [3, 1, 2]), ("2, 2, 1, 3", [2, 1, 3]), ("5, 2, 1, 0", [2, 1, 3]), ("3, 1", [3, 1, 2]), ("none", [1, 2, 3]), ("10000000001, 3", [3, 1, 2])])
def test_rerank(spark, text, want):
    assert one(spark, T.rerank_order(F.lit(text), F.lit(3))) == want


@pytest.mark.parametrize("ids,rel,k,recall,precision", [("abc", "ab", 3, 1, 2 / 3), ("axy", "ab", 3, 0.5, 1 / 3), ("axbc", "abc", 2, 1 / 3, 0.5), ("ab", "", 2, 1, 0), ("ab", "a", 0, 0, 1), ("", "a", 1, 0, 0)])
def test_metrics(spark, ids, rel, k, recall, precision):
    arr = lambda s: F.array(*[F.lit(c) for c in s]) if s else F.array().cast("array<string>")
    assert one(spark, T.recall_at_k(arr(ids), arr(rel), k)) == pytest.approx(recall)
    assert one(spark, T.precision_at_k(arr(ids), arr(rel), k)) == pytest.approx(precision)


@pytest.mark.parametrize("n,size,overlap,want", [(10, 4, 1, [(0, 4), (3, 7), (6, 10)]), (8, 4, 0, [(0, 4), (4, 8)]), (0, 4, 0, []), (3, 4, 0, [(0, 3)])])
def test_chunks(spark, n, size, overlap, want):
    got = one(spark, T.chunk_words(F.lit(" ".join(f"w{i}" for i in range(n)) or "  "), size, overlap))
    assert [(c.start_word, c.end_word) for c in got] == want


def test_json_and_entities(spark):
    assert one(spark, T.strip_code_fence(F.lit("```json\n{}\n```"))) == "{}"
    assert one(spark, T.strip_code_fence(F.lit("{}"))) == "{}"
    assert one(spark, T.is_json(F.lit(' {"a": 1} '))) and not one(spark, T.is_json(F.lit("so: {}")))
    assert one(spark, T.heuristic_entities(F.lit("The Security Team met The. Then Bob Ray left"))) == ["Security Team", "The", "Then Bob Ray"]
    assert one(spark, T.resolve_cost(F.lit(None).cast("double"), F.lit("Ollama"))) == 0.0
    with pytest.raises(Exception, match="no cost"):
        one(spark, T.resolve_cost(F.lit(None).cast("double"), F.lit("paid")))


def test_an_accent_keeps_out_its_own_word_only(spark):
    s = "Élan Vital met Café Noir. École, naïve Bob Ray; The Zürich Team “Quoted Name” X_y Zoë2 End"
    want = ["Vital", "Noir", "Bob Ray", "The", "Team", "Quoted Name", "End"]
    assert one(spark, T.heuristic_entities(F.lit(s))) == want == re.findall(r"\b[A-Z][a-zA-Z0-9]*(?:\s+[A-Z][a-zA-Z0-9]*)*\b", s)


def test_term_counts_are_those_of_the_terms(spark):
    """One split gives the four numbers, with letters whose lower case is ASCII though they are not."""
    from pyspark.sql import functions as F

    from weft.functions import text as T

    x = spark.createDataFrame([(s,) for s in ("", "fooBar BAZ foo Foo 9A x", "10K K k K", "aBİc İI i", "éAb aÉb AbC", None)], "text string")
    c = F.col("text")
    want = x.select(F.size(T.split_terms(c)), F.size(F.array_distinct(T.split_terms(c))), F.size(F.array_distinct(T.tokenize_terms(c))), F.size(T.shortlist_tokens(c)))
    assert x.select(*T.term_counts(c)).collect() == want.collect()
