"""Personal data: held-out accuracy, positions, redaction, edges."""

import re

import pytest
from pyspark.sql import functions as F

from loamworks.llm import pii
from loamworks.llm.pii_labels import KINDS, ROWS, labelled_table

from held_out_pii import PLAIN, SENTENCES

CARDS = "card_id long, content array<string>, field string, rec_id string, item_no string, text string"


@pytest.fixture(scope="module")
def names(spark, small):
    return spark.read.parquet(f"{small}/name_token.parquet")


@pytest.fixture(scope="module")
def tagger(spark, names):
    return pii.Tagger(pii._tagger_for(spark, names).value)


def test_table_is_small_and_the_same_each_time():
    rows = labelled_table(["Anna", "Mark"], ["Kelmont"])
    assert len(rows) <= ROWS and rows == labelled_table(["Mark", "Anna"], ["Kelmont"])
    assert {k for _, spans in rows for _, _, k in spans} == set(KINDS)


def test_held_out_accuracy(names, tagger):
    rows = names.collect()
    held = labelled_table([r["token"] for r in rows if r["kind"] == "given"], [r["token"] for r in rows if r["kind"] == "family"], 1500, seed=77)
    got = pii.find_batch([t for t, _ in held], tagger)
    want = [{(a, k) for a, _, k in s} for _, s in held]
    have = [{(a, k) for a, _, k in g} for g in got]
    hits = sum(len(a & b) for a, b in zip(want, have))
    assert hits / sum(map(len, have)) > 0.98 and hits / sum(map(len, want)) > 0.97


def parse(marked):
    """A text and its spans from a text with marks <kind:personal data>."""
    text, spans = "", []
    for piece in re.split(r"(<\w+:[^>]*>)", marked):
        if m := re.fullmatch(r"<(\w+):([^>]*)>", piece):
            spans.append((len(text), len(text) + len(m.group(2)), m.group(1)))
            piece = m.group(2)
        text += piece
    return text, spans


def test_sentences_of_other_texts(tagger):
    """Recall and precision on sentences whose frames and names are in no training sentence or table."""
    rows = [parse(s) for s in SENTENCES] + [(t, []) for t in PLAIN]
    got = pii.find_batch([t for t, _ in rows], tagger)
    want = [{(a, k) for a, _, k in s} for _, s in rows]
    have = [{(a, k) for a, _, k in g} for g in got]
    hits = sum(len(a & b) for a, b in zip(want, have))
    assert hits >= 0.9 * sum(map(len, want)) and hits >= 0.9 * sum(map(len, have)), (hits, sum(map(len, want)), sum(map(len, have)))


def test_the_gate_lets_all_marked_sentences_through():
    assert all(pii.gate(pii._masked(parse(s)[0])) for s in SENTENCES)
    short = ["Passport 12345", "ID card 123456", "his passport no. 654321 was lost", "her insurance number is QQ123456C.", "Bo Li", "a@b.de", "J.Smith", "SMITH,John", "Maria dos Santos"]
    assert all(pii.gate(pii._masked(s)) for s in short)


def test_short_lines(tagger):
    texts = ["Passport 12345", "his passport no. 654321 was lost", "a@b.de", "Maria dos Santos"]
    found = {t: [k for *_, k in s] for t, s in zip(texts, pii.find_batch(texts, tagger))}
    assert found == {"Passport 12345": ["id_number"], "his passport no. 654321 was lost": ["id_number"], "a@b.de": ["email"], "Maria dos Santos": ["name"]}


def test_a_stored_model_is_the_same(spark, names, tagger):
    again = pii.model_from(pii.model_bytes(tagger.model))
    assert again.ids == tagger.model.ids and (again.move == tagger.model.move).all() and abs(again.weights - tagger.model.weights).max() == 0
    texts = [parse(s)[0] for s in SENTENCES]
    assert pii.find_batch(texts, pii.Tagger(again)) == pii.find_batch(texts, tagger)


def test_positions_are_of_the_stored_text(tagger):
    text = "x​\r\nAsk for Ｊürgen P. Tordrivic at the desk, or call 030 23125 079 before noon.\nPassport X7992‍5468 belongs to Nina Kelmont, who visits Oldbrook in April."
    spans = pii.find_batch([text], tagger)[0]
    assert [(text[a:b], k) for a, b, k in spans] == [("Ｊürgen P. Tordrivic", "name"), ("030 23125 079", "phone"), ("X7992‍5468", "id_number"), ("Nina Kelmont", "name")]


def test_what_is_no_personal_data(tagger):
    texts = ["Ticket 0929666546 at Badanodofa was closed after 48 days.", "Part no. 812-45-4525 of the Rapogigope pump replaces the older seal.", "Saint Kelmont Hall, the old Marmont Mill and Badanodofa open in May.", "Kelmont & Sons supplied rye flour to Tamderck Ceramics.", "", None, "\n\n"]
    assert pii.find_batch(texts, tagger) == [[]] * len(texts)


def test_redaction():
    assert pii.redact_text("a Anna Kel b", [(2, 10, "name")]) == "a [NAME] b"


def test_found_and_redacted(spark, names):
    fetches = spark.createDataFrame([(1, "Tel. 020 7946 0815 / ana@firm.example", "c"), (2, None, "c"), (3, "", "c"), (4, "nothing here at all", "c")], "result_id long, raw_text string, kind string")
    cards = spark.createDataFrame([(9, ["", "By Anna Kelmont", None], "c", "c", "c", "c"), (10, None, "c", "c", "c", "c"), (11, [], "c", "c", "c", "c")], CARDS)
    got = {tuple(r) for r in pii.found(fetches, cards, names).collect()}
    assert got == {("raw_text", 1, 0, "phone", 5), ("raw_text", 1, 0, "email", 21), ("content", 9, 1, "name", 3)}
    assert pii.found(fetches.limit(0), cards.limit(0), names).count() == 0
    out = {r["result_id"]: r["raw_text"] for r in pii.redacted(fetches, "raw_text", names).collect()}
    assert out == {1: "Tel. [PHONE] / [EMAIL]", 2: None, 3: "", 4: "nothing here at all"}
    items = {r["card_id"]: r["content"] for r in pii.redacted(cards, "content", names).select("card_id", F.col("content")).collect()}
    assert items == {9: ["", "By [NAME]", None], 10: None, 11: []}


def test_long_text(tagger):
    text = "w " * 200_000 + "\nCall Anna Kelmont at 020 7946 0815 about it.\n" + "Anna Kelmont, " * 3000
    spans = pii.find_batch([text], tagger)[0]
    assert (400_006, 400_018, "name") in spans
