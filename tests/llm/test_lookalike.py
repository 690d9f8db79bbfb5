"""The consistent form against brute force, and pairs of texts that look the same."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamworks.llm import lookalike as L

LOOK = {x: latin for latin, others in L.LOOKALIKES.items() for x in others} | {x: latin for pair in L.LOOKALIKES_MORE.values() for x, latin in zip(*pair)}
ALPHABET = "aAé ȩ̣́̈̊ \t  ​‍﻿­ｋＫﬁⅼѕоОΗн\n\r.12½²가각가한"


def brute(text):
    out = re.sub("\r+\n", "\n", "".join(L._expansion(ord(c), LOOK) for c in text))
    return unicodedata.normalize("NFC", out)


@given(st.lists(st.text(ALPHABET, max_size=25), max_size=8))
@settings(max_examples=300, deadline=None)
def test_form_is_that_of_brute_force(texts):
    assert L.canonical_batch(texts)[0] == [brute(t) for t in texts]


@given(st.text(ALPHABET.replace("ᄀ", "").replace("ᅡ", ""), max_size=25))
@settings(max_examples=200, deadline=None)
def test_form_is_stable_and_places_point_back(text):
    form, where = L.canonical_batch([text], places=True)
    assert L.canonical_text(form[0]) == form[0]
    if where[0] is not None:
        assert len(where[0]) == len(form[0]) and all(a <= b for a, b in zip(where[0], where[0][1:])) or "́" in text or "̧" in text or "̈" in text or "̊" in text or "̣" in text


def test_what_is_visible():
    same = [("Ｋｗａｍｅ", "Kwame"), ("A b", "A b"), ("M‍ark", "Mark"), ("Мark", "Mark"), ("rye ﬂour", "rye flour"), ("é", "é"), ("Wilⅼ", "Will"), ("a\r\nb", "a\nb"), ("Ёлка", "Ёлка")]
    other = [("Mark", "MARK"), ("Jose", "José"), ("A  b", "A b"), ("Mark", "Marc"), ("x²", "x2"), ("a\nb", "a b")]
    assert all(L.canonical_text(a) == L.canonical_text(b) for a, b in same)
    assert all(L.canonical_text(a) != L.canonical_text(b) for a, b in other)
    assert L.canonical_batch([None, "", "x"])[0] == [None, "", "x"]


def test_letters_of_other_scripts():
    same = [("ρ", "p"), ("α", "a"), ("ν", "v"), ("ᎠᎡᏴ", "DRB"), ("ꓐꓮꓡꓡ", "BALL"), ("Ⲟⲣ", "Op"), ("ѡ", "w"), ("ա", "w"), ("ά", "á")]
    other = [("σ", "o"), ("г", "r"), ("Ь", "b"), ("η", "n"), ("β", "b"), ("ж", "x"), ("ı", "i"), ("ß", "B"), ("0", "O"), ("1", "l"), ("I", "l"), ("rn", "m"), ("Ⲁ", "A")]
    assert all(L.canonical_text(a) == L.canonical_text(b) for a, b in same)
    assert all(L.canonical_text(a) != L.canonical_text(b) for a, b in other)


def test_look_alikes_are_those_of_the_public_table(spark):
    """Every entry beyond case is confusable by Unicode's own table, as the library that Spark brings along holds it."""
    jvm = spark._jvm
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    builder = jvm.java.lang.Class.forName("com.ibm.icu.text.SpoofChecker$Builder", True, loader)
    plain = next(c for c in builder.getDeclaredConstructors() if c.getParameterCount() == 0)
    checker = plain.newInstance(spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0)).build()
    skeletons = lambda texts: checker.getSkeleton("\n".join(texts)).split("\n")
    odd = [(a, b) for a, b, x, y in zip(LOOK, LOOK.values(), skeletons(list(LOOK)), skeletons(list(LOOK.values()))) if x != y]
    assert set(odd) <= {("Ԛ", "Q"), ("ӏ", "l")}, odd  # drawn alike in common faces, though the table has them otherwise


def test_classes(spark):
    rows = [row(i, "Mark X" if i % 50 else "Ｍark X") for i in range(400)] + [row(900, "Ann"), row(901, "Ann"), row(902, None), row(903, "Mаrk X", "g"), row(904, "Mark X", "g")]
    df = spark.createDataFrame(rows, "row_id long, name string, feed string, load_no int, look string, stored string, id string")
    got = L.look_classes(df, "name", "row_id", [F.col("feed"), F.col("load_no")], "name").collect()
    assert {(r["class_id"], r["forms"], r["rows"]) for r in got} == {(0, 2, 400), (903, 2, 2)} and len(got) == 402
    assert L.look_classes(df.limit(0), "name", "row_id", [F.col("feed")], "name").count() == 0


def test_long_text():
    text = "é​" * 3_000_000
    assert L.canonical_text(text) == "é" * 3_000_000


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, name string, feed string, load_no int, look string, stored string, id string")
    return {tuple(r) for r in L.same_looking_pairs(df, "name", "row_id", [F.col("feed"), F.col("load_no")], "name").collect()}


def row(i, name, feed="f", load=1):
    return (i, name, feed, load, "clash", "clash", "clash")


def test_pairs(spark):
    rows = [row(1, "Mark X"), row(2, "Mark X"), row(3, "Mark X"), row(4, "mark X"), row(5, "Ｍark X"), row(6, "Mark X", "g"), row(7, None), row(8, "​"), row(9, " "), row(10, "Mark X", None)]
    assert pairs(spark, rows) == {("name", 1, 2), ("name", 2, 3), ("name", 1, 5), ("name", 2, 5), ("name", 3, 5)}
    assert pairs(spark, []) == set()


def test_pairs_of_a_hot_group(spark):
    got = pairs(spark, [row(i, "Mark X" if i % 50 else "Mark X") for i in range(400)])
    assert len(got) == 8 * 392


@pytest.mark.parametrize(("url", "site", "page"), [("HTTPS://WWW.A.Example:443/x/Y/?q=1#z", "a.example", "a.example/x/Y"), ("http://a.example", "a.example", "a.example"), ("a.example/p/", "a.example", "a.example/p"), ("https://u@b.test/?q", "b.test", "b.test")])
def test_site_and_page(spark, url, site, page):
    df = spark.createDataFrame([(url,)], "url string").select(*L.site_and_page(F.col("url")))
    assert tuple(df.first()) == (site, page)


def test_found_on_the_tables(spark, small):
    from loamworks.llm.queries import p4_found

    got = {tuple(r) for r in p4_found(spark, small).collect()}
    names = spark.read.parquet(f"{small}/test_data.parquet").select("row_id", "name", "feed", "load_no").collect()
    by = {}
    for r in names:
        if r["name"] and brute(r["name"]).strip():
            by.setdefault((r["feed"], r["load_no"], brute(r["name"])), []).append((r["row_id"], r["name"]))
    want = {("name", a, b) for g in by.values() for a, x in g for b, y in g if a < b and x != y}
    assert {x for x in got if x[0] == "name"} == want


def test_blank_page_texts_that_look_alike_are_pairs(spark, tmp_path):
    from loamworks.llm import queries

    spark.createDataFrame([(1, "x", "f", 1)], "row_id long, name string, feed string, load_no int").write.parquet(f"{tmp_path}/test_data.parquet")
    rows = [(1, "http://a.example/p", "  "), (2, "http://a.example/p", " \u00a0"), (3, "http://a.example/p", None), (4, "http://a.example/q", "  ")]
    spark.createDataFrame(rows, "result_id long, url string, raw_text string").write.parquet(f"{tmp_path}/scraping_result.parquet")
    assert [tuple(r) for r in queries.p4_found(spark, str(tmp_path)).collect()] == [("raw_text", 1, 2)]
