"""Text expressions against Python's own string methods."""

import pytest
from pyspark.sql import functions as F

from energraph.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_casefold(spark):
    samples = ["Straße STRASSE", "ὈΔΥΣΣΕΎΣ ς Σ", "ﬁﬂ ﬆ", "ŉ ǰ ΐ ΰ ẞ", "İstanbul ıI", "Ꭰꭰ", "µ ſ ϐ", "", "ᾳ ᾼ ῷ", "և"]
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select("s", tx.casefold(F.col("s")).alias("f")).collect()
    assert {r.s: r.f for r in rows} == {s: s.casefold() for s in samples}


def test_listing_lines(spark):
    reply = "- one\r\n\t* two\r\n3. three + four\x85　- five\n\n12.x\n٣. six\n-seven"
    assert value(spark, tx.parse_listing(F.lit(reply))) == ["one", "two", "three", "four", "five", "12.x", "six", "-seven"]


def test_subqueries_answers_and_sentences(spark):
    reply = "Queries:\r\n\t1) Who? \r\n • When?\x0bHere are more\n-Where?\n"
    assert value(spark, tx.parse_subqueries(F.lit(reply), F.lit("q"))) == ["Who?", "When?", "Where?"]
    assert value(spark, tx.parse_subqueries(F.lit("\r\n\t"), F.lit("q"))) == ["q"]
    assert value(spark, tx.parse_answer(F.lit("　\r\n Lake Baikal now\rmore"), 2)) == "Lake Baikal"
    assert [value(spark, tx.parse_answer(F.lit(x))) for x in (None, " \t", "none given", "Nothing")] == ["", "", "", "Nothing"]
    assert value(spark, tx.first_sentence(F.lit("\r\n\t One here! Two. Three"))) == "One here!"
    assert value(spark, tx.first_sentence(F.lit("no end"))) == "no end" and value(spark, tx.first_sentence(F.lit(" "))) == ""


@pytest.mark.parametrize("text,n,want", [("a  b　c", 10, "a b c"), ("abcd efgh", 6, "abcd…"), ("", 3, "")])
def test_snippet(spark, text, n, want):
    assert value(spark, tx.snippet(F.lit(text), n)) == want
