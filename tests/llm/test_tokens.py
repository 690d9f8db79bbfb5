"""Token ids, mixing, residue."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamworks.llm import mixing as M
from loamworks.llm import residue as Z
from loamworks.llm import tokenize as T

pytestmark = pytest.mark.skipif(not os.path.isdir(T.TOKENIZERS), reason="no tokenizers")


@given(st.text(" \n\t\x1c\x85'sdAé1中 <|endoftext|>ll.", max_size=80), st.integers(1, 9))
@settings(max_examples=400, deadline=None)
def test_tree_gives_the_whole_texts_ids(text, leaf):
    encode = T.encoder().encode_ordinary
    assert T.encode_tree(text, encode, leaf) == encode(text)


@pytest.mark.parametrize("text", ["x" * 50_000, "word " * 50_000, "中" * 20_000, " " * 30_000, "a\n" * 30_000, "…é " * 9_000])
def test_long_texts(text):
    encode = T.encoder().encode_ordinary
    assert T.encode_tree(text, encode) == encode(text)


def test_ids(spark):
    df = spark.createDataFrame([(1, "Hello  <|endoftext|> wörld", "c"), (2, "", "c"), (3, None, "c"), (4, "\n", "c"), (4, "\n", "c")], "doc_id long, text string, ids string")
    got = T.encode_documents(df)
    assert got.columns == ["doc_id", "ids"] and got.count() == 5
    rows = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert rows[2] == rows[3] == [] and 50256 not in rows[1]
    back = got.select("doc_id", T.decoded(F.col("ids")).alias("t"))
    assert {r["doc_id"]: r["t"] for r in back.collect()}[1] == "Hello  <|endoftext|> wörld"
    assert T.encode_documents(df.limit(0)).count() == 0


def test_round_trip_on_the_tables(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    j = T.encode_documents(d).join(d, "doc_id").filter(T.decoded(F.col("ids")) != F.coalesce("text", F.lit("")))
    assert j.count() == 0


def test_same_as_the_other_library(spark, small):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rows = spark.read.parquet(f"{small}/documents.parquet").filter("text <> ''").select("text").collect()
    for r in rows:
        assert T.encode_tree(r[0], T.encoder().encode_ordinary) == t.encode(r[0], add_special_tokens=False).ids


# ---- mixing
def mix(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string, place string, bucket string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return M.mixed(d, t), d, t


def doc(i, source, words):
    return (i, None if words is None else " ".join(["word"] * words), source, "clash", "clash", "clash")


def test_shares(spark):
    docs = [doc(i, "a", 10) for i in range(600)] + [doc(1000 + i, "b", 7) for i in range(50)] + [doc(2000 + i, "c", 5) for i in range(20)] + [doc(3000, None, 9), doc(3001, "other", 9), doc(3002, "a", None), doc(3003, "a", 0)]
    out, _, _ = mix(spark, docs, [("a", 0.5, 1), ("b", 0.3, 9), ("c", 0.2, 2), ("none", 0.0, 3)])
    rows = out.collect()
    total = 6000 + 350 + 100
    used = {}
    for r in rows:
        used[r["source"]] = used.get(r["source"], 0) + r["tokens"] * r["uses"]
        assert r["uses"] <= {"a": 1, "b": 9, "c": 2}[r["source"]]
    assert abs(used["a"] - 0.5 * total) <= 5 and abs(used["b"] - 0.3 * total) <= 4 and used["c"] == 200
    assert len({r["doc_id"] for r in rows}) == len(rows)
    share = {r["source"]: r["actual_share"] for r in rows}
    assert share["a"] == pytest.approx(used["a"] / total)


def test_mix_edges(spark):
    assert mix(spark, [], [("a", 1.0, 1)])[0].count() == 0
    assert mix(spark, [doc(1, "x", 3)], [("a", 1.0, 1)])[0].count() == 0
    assert mix(spark, [doc(1, "a", 3)], [("a", None, 1)])[0].count() == 0
    assert [r["uses"] for r in mix(spark, [doc(1, "a", 3)], [("a", 1.0, 1)])[0].collect()] == [1]


def test_permutation_and_draws():
    for n in (1, 2, 5, 1000, 4097):
        assert sorted(M.feistel(np.arange(n), n, 3)) == list(range(n))
    totals = np.array([700, 300, 5])
    draws = [M.shard_draw(k, 11, totals, 100, 7) for k in range(11)]
    before = np.zeros(3, np.int64)
    for given, own in draws:  # every task draws the same tree
        assert (given == before).all()
        before = before + own
    assert (before == totals).all() and [int(own.sum()) for _, own in draws] == [100] * 10 + [5]
    # far more blocks than numpy draws from: split in proportion, then drawn
    huge = np.array([4_000_000_000, 1_000_000_001])
    shards = -(-int(huge.sum()) // 256)
    given, own = M.shard_draw(shards - 1, shards, huge, 256, 7)
    assert (given + own == huge).all() and own.sum() == int(huge.sum()) - 256 * (shards - 1)


def test_blocks_cover_each_source_once(spark):
    docs = [doc(i, "a" if i % 3 else "b", 30 + i % 50) for i in range(300)] + [doc(299, "b", 44), doc(900, "a", 0)]
    m = M.mix(*(spark.createDataFrame(x, y) for x, y in ((docs, "doc_id long, text string, source string, tokens string, place string, bucket string"), ([("a", 0.3, 1), ("b", 0.7, 5)], "source string, target_share double, max_repeats int"))))
    picked = m.documents.collect()
    plan = M.block_plan(m, 64, 10).collect()
    assert len({(r["source"], r["block_no"]) for r in plan}) == len(plan) == len({(r["slot"], r["source"]) for r in plan})
    used = {s: sum(r["tokens"] * r["uses"] for r in picked if r["source"] == s) for s in "ab"}
    assert {s: sum(r["source"] == s for r in plan) for s in "ab"} == {s: -(-t // 64) for s, t in used.items()}
    # each block is filled without gaps or overlaps, and each use of a document comes out whole
    blocks, uses = {}, {}
    for r in M.sharded(m, 64, 10).collect():
        n = r["token_to"] - r["token_from"]
        blocks.setdefault((r["source"], r["block_no"]), []).append((r["block_from"], n))
        uses.setdefault((r["source"], r["doc_id"], r["use_no"]), []).append((r["token_from"], n))
    last = {s: -(-t // 64) - 1 for s, t in used.items()}
    for (s, b), parts in blocks.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == (64 if b != last[s] else used[s] - 64 * b)
    assert sum(n for parts in uses.values() for _, n in parts) == sum(used.values())
    total = sum(t for t in (r["tokens"] for r in M.sized(spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string, place string, bucket string"), ["a", "b"]).collect()))
    assert all(abs(used[s] - share * total) <= 64 for s, share in (("a", 0.3), ("b", 0.7)))  # within a block


def test_rows_of_one_id_are_documents_of_their_own(spark):
    out, _, _ = mix(spark, [doc(1, "a", 10)] * 7 + [doc(2, "b", 30)], [("a", 0.43, 3), ("b", 0.0, 1)])
    rows = out.collect()
    assert len(rows) == 4 and {r["uses"] for r in rows} == {1}  # 43 of 100 tokens: four rows of ten, none counted for the others


def test_too_many_targets(spark, monkeypatch):
    monkeypatch.setattr(M, "TARGETS_MOST", 1)
    with pytest.raises(ValueError, match="more than 1"):
        mix(spark, [], [("a", 0.5, 1), ("b", 0.5, 1)])


# ---- residue
FOUND = ["Dear *|ColumnName|*,\nThe team in Oldbrook prefers outlier capping.", "Regards, {{ order_id }}", "Run {{{City}}} ended with status <insert date here>.", "Our office in [COMPANY] opens at 8.", "Rapport pour #{company} : 71 lignes.", "Bonjour %LAST_NAME%, votre commande est partie.", "Dear $CUSTOMER_NAME$,", "Lorem ipsum dolor sit amet elit velit", "asdf asdf asdf asdf asdf", "Products\nContact\n503 - The service is taking a break. Try again in a few minutes. - Reference baa27466", "Marrow Tools\nTo view this page switch on scripts in the settings of your browser.\nSitemap", "Your headline goes here ipsum porta\nText to follow", "Traceback (most recent call last):\n  File \"/srv/x1/run.py\", line 64, in load\n    read_table(\"email\")\nKeyError: 'age'", "PLEASE TURN ON JAVASCRIPT TO USE THIS PAGE."]
KEPT = ["Write ${amount} in the pattern and the import of Marrow Tools puts the number there.", "In the letter template the field {{ first_name }} is filled before sending; a test in Oldbrook makes sure that none is left over.", "Internal server error was shown to 53 visitors.", "Each night a job reads the list and writes a summary.\nPlease turn on JavaScript to see the comments.", "A set such as {age, email, status} is written with braces in the notes of Marrow Tools.", "The rule [age between 3 and 90] and the list [col_7] come from the manual of Marrow Tools.", "Access denied was the most common remark in the visit register of Marrow Tools, and it meant the door, not the server.", "Following Marrow Tools", "Write to anna [at] firm [dot] example", "The module of Marrow Tools keeps its start in __main__ and its names in __all__, which the manual lists on page 4.", "The printer of Marrow Tools still sets lorem ipsum when a draft has no copy, a habit older than the call list."]


def test_residue(spark):
    rows = [(i, t) for i, t in enumerate([*FOUND, *KEPT, None, "", "  \n", "The sea is wide and the sky is blue here. " * 20_000])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, id string")
    assert {r[0] for r in Z.residue(df).collect()} == set(range(len(FOUND)))
    assert Z.without_residue(df).count() == len(rows) - len(FOUND)
    assert Z.residue(df.limit(0)).count() == 0


# Forms that are in no test table.
LOREM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."
MORE_FOUND = [LOREM, "503 Service Unavailable", "HTTP/1.1 410 Gone\nnginx/1.24.0", "429 Too Many Requests", "Hello {{ user.first_name }}, welcome.", "Bonjour {{ prénom }}, merci.", "Price: {{ price | round(2) }}", "Dear {Ansprechpartner},\nwe have moved.", "Hi [Vorname], your parcel is on its way.", "Your order for {größe} left.", "We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue."]
MORE_KEPT = ["The gate was locked.", "Gone", "Le prix est dans la liste, qui est ici.", "See [note 9] and [sic] for more.", "The value of $alpha$ is small.", "A __very__ large thing of __great__ worth.", "We found 404 not found pages in the log of the shop and mended them all."]


def test_residue_of_forms_in_no_table(spark):
    df = spark.createDataFrame(list(enumerate([*MORE_FOUND, *MORE_KEPT])), "doc_id long, text string")
    assert {r[0] for r in Z.residue(df).collect()} == set(range(len(MORE_FOUND)))
