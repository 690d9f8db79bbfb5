"""Invariants and edges of the core operators."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loamworks.operators import gates, metrics, models, prepare, profile, quality, ranges
from loamworks.plans import cli, pipeline, policy, report
from loamworks.session import cut, nan_to_null
from loamworks.sources import fetch, html, io
from loamworks.streaming import clean as streaming


def numbers(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")


def test_iqr_cap(spark):
    df = numbers(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, None])
    fitted = prepare.IqrOutliers("cap").fit(df, ["x"])
    assert fitted.bounds["x"] == (-1.5, 8.5)
    once = fitted.transform(df)
    assert [r["x"] for r in once.orderBy("i").collect()] == [1.0, 2.0, 3.0, 4.0, 5.0, 8.5, None]
    assert fitted.transform(once).collect() == once.collect()


def test_impute_leaves_no_nulls(spark):
    df = numbers(spark, [1.0, None, 3.0])
    for strategy, want in (("mean", 2.0), ("median", 2.0), ("zero", 0.0)):
        assert prepare.NumericImputer(strategy).fit(df, ["x"]).transform(df).filter("i = 1").first()["x"] == want
    empty = numbers(spark, [])
    assert prepare.NumericImputer().fit(empty, ["x"]).transform(empty).count() == 0


def test_encode_then_decode(spark):
    df = spark.createDataFrame([("b",), ("A",), ("é",), ("a",), (None,)], "v string")
    m = prepare.label_mapping(df, "v")
    assert {r["original_value"]: r["code"] for r in m.collect()} == {"A": 0, "a": 1, "b": 2, "é": 3}
    back = prepare.label_decode(prepare.label_encode(df, "v", m, "c"), "c", m, "w")
    assert all(r["v"] == r["w"] for r in back.collect())


def test_mode_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    assert prepare.mode_of(df, "v").first()[0] == "a"


@pytest.mark.parametrize("parts", [1, 8])
def test_fill_is_the_same_for_any_partitions(spark, parts):
    df = spark.createDataFrame([(i, None if i % 7 else f"v{i}") for i in range(1, 60)], "i int, v string").repartition(parts)
    got = [r["v"] for r in ranges.fill(df, "v", ["i"]).orderBy("i").collect()]
    assert got == [None if i < 7 else f"v{i // 7 * 7}" for i in range(1, 60)]
    both = [r["v"] for r in ranges.fill(df, "v", ["i"], backward=True).orderBy("i").collect()]
    assert both == ["v7" if i < 7 else f"v{i // 7 * 7}" for i in range(1, 60)]


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b int")
    assert profile.column_profile(df).count() == 0
    assert profile.duplicate_rows(df).first()[0] == 0
    assert profile.histogram(df, "b").count() == 0


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert df.filter("x IS NULL").count() == 1


def test_split_keeps_every_row(spark):
    df = spark.createDataFrame([(1, 200, "male"), (2, 30, "invalid"), (3, 40, "female"), (4, None, None)], "id int, age int, gender string")
    rules = [gates.in_range("age", 0, 150, clip=True), gates.in_set("gender", ["male", "female", "other"], other="other"), gates.not_null("id"), gates.unique("id")]
    clean, bad = gates.split(df, rules)
    assert clean.count() == 1 and bad.count() == 3
    assert {r["age"] for r in gates.fixed(df, rules).collect()} == {150.0, 30.0, 40.0, None}
    assert gates.score(df, rules).first()["quality_score"] == pytest.approx(7 / 9)
    assert gates.score(df.limit(0), rules).first()["quality_score"] == 1.0


def test_policy_clean(spark):
    rows = [(i, f"  Name {i}", "a@b.org" if i % 3 else "broken", "delivered" if i % 2 else "Shipped", float(i)) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "rid int, note string, email string, status string, measure double")
    done = policy.clean(df, "rid")
    assert done.cleaned.count() == 40 and {r["status"] for r in done.cleaned.select("status").distinct().collect()} == {"delivered"}
    assert done.quarantined.count() == 13 and done.audit.rows_in == 40


def test_file_clean_round_trip(spark, tmp_path):
    path = f"{tmp_path}/in.csv"
    with open(path, "w") as f:
        f.write("rid,Email,age\n1,a@b.org,30\n2,broken,200\n3,c@d.org,40\n")
    done = pipeline.clean_file(spark, path, f"{tmp_path}/out", [gates.in_range("age", 0, 150)], row_id="rid")
    assert done.success and done.rows == 3
    assert spark.read.parquet(done.paths["parquet"]).count() == 2
    assert json.load(open(done.paths["audit"]))["rows_in"] == 3 and "# Data quality" in open(done.paths["report"]).read()
    bad = pipeline.clean_file(spark, f"{tmp_path}/x.txt", f"{tmp_path}/o2")
    assert not bad.success and "Unsupported file format" in bad.error
    assert cli.parser().parse_args(["clean-data", "a", "b"]).command == "clean-data"
    # the model-ready table, the profile and the log are written too
    assert spark.read.parquet(done.paths["ml_ready_parquet"]).count() == 3
    overview = json.load(open(done.paths["profile"]))
    assert overview["rows"] == 3 and {r["column_name"] for r in overview["profile"]} == {"rid", "Email", "age"}
    assert json.load(open(done.paths["log"])) and "clean Email" in open(done.paths["log_text"]).read()
    quality = json.load(open(done.paths["quality"]))
    assert quality["rules_violated"] == 1 and quality["by_severity"] == {"high": 1} and quality["violations"][0]["samples"] == ["200.0"]


def test_rules_by_domain(spark, tmp_path):
    path = f"{tmp_path}/rules.json"
    spec = {"clinic": [{"range": ["age", 0, 150], "clip": True}, {"set": ["kind", ["a", "b"]], "severity": "low"}, {"not_null": "rid"}, {"unique": "rid"}, {"pattern": ["kind", "^.$"]}]}
    with open(path, "w") as f:
        json.dump(spec, f)
    rules = cli.rules_of(spark, path, "clinic")
    df = spark.createDataFrame([(1, 200, "a"), (1, 5, "cc"), (None, -1, None)] + [(k, 300 + k, "b") for k in range(2, 9)], "rid int, age int, kind string")
    got = {r["rule"]: r for r in gates.report(df, rules).collect()}
    assert got["age_range"]["violations"] == 9 and got["age_range"]["samples"] == ["-1", "200", "302", "303", "304"]
    assert got["kind_values"]["samples"] == ["cc"] and got["rid_not_null"]["samples"] == [] and got["rid_unique"]["violations"] == 2
    assert cli.rules_of(spark, None, "general") == [] and cli.rules_of(spark, path, "general") == []
    with pytest.raises(ValueError, match="no rules of domain"):
        cli.rules_of(spark, path, "none")
    with pytest.raises(ValueError, match="not a rule"):
        gates.from_spec([{"range": ["a", 0, 1], "set": ["a", []]}])
    assert cli.main(["clean-data", f"{tmp_path}/none.txt", f"{tmp_path}/o", "--disable-quality-gates"]) == 1


def test_domains_count_words_not_columns():
    # three columns of one word weigh no more than one
    assert profile.domain_of(["amount_a", "amount_b", "amount_c", "product", "review"]) == "retail"
    assert profile.domain_of(["Treatment", "debit", "payment"]) == "finance" and profile.domain_of(["inventory"]) == "retail"
    assert profile.domain_of(["patient_id", "account"]) == "healthcare" and profile.domain_of(["xyz"]) == "general" and profile.domain_of([]) == "general"
    for domain, words in profile.DOMAIN_WORDS.items():
        assert all(profile.domain_of([w.upper()]) == domain for w in words)


def test_policy_clean_against_plain_python(spark, small):
    """Every column of a table by a second path: cleaners cell by cell (held against SQL elsewhere), fills and caps in plain Python."""
    import statistics

    import numpy as np

    from loamworks.functions import columns as C

    visits = spark.read.parquet(f"{small}/patient_visit.parquet").withColumn("score2", F.col("score"))
    types = {r["column_name"]: r["column_type"] for r in profile.column_types(visits, ["visit_no"], [c for c in visits.columns if c != "visit_no"]).collect()}
    got = {r["visit_no"]: r for r in policy.clean(visits, "visit_no").cleaned.collect()}
    cells = visits.orderBy("visit_no").select("*", C.date(F.col("visit_date")).alias("_date"), *[C.categorical(F.col(c), k, "policy").alias(f"_{c}") for c, k in (("gender", "gender"), ("status", "status"))]).collect()
    assert len(got) == len(cells) and types["visit_date"] == "date_datetime" and types["age"] == "numeric_measure" and types["gender"] == "categorical_low"
    ages = [r["age"] for r in cells if r["age"] is not None]
    middle = statistics.median(ages)
    full = [middle if r["age"] is None else r["age"] for r in cells]
    q1, q3 = np.quantile(full, [0.25, 0.75])
    genders = [r["_gender"] for r in cells if r["_gender"] is not None]
    mode = min(set(genders), key=lambda g: (-genders.count(g), g))
    day = None
    for r, age in zip(cells, full):
        day = r["_date"] or day
        mine = got[r["visit_no"]]
        assert mine["visit_date"] == day
        assert mine["age"] == pytest.approx(min(max(age, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)))
        assert mine["gender"] == (r["_gender"] if r["_gender"] is not None else mode)


def test_compatibility_form_and_case(spark):
    import unicodedata

    from loamworks.functions import text

    words = ["ＡＢＣ", "ﬁn", "Straße", "İstanbul", "é", "①²", "ΣΊΣΥΦΟΣ", None, "", "a\u00a0b"]
    got = [r[0] for r in spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, t string").orderBy("k").select(text.nfkc_casefold(F.col("t"))).collect()]
    assert got == [None if w is None else unicodedata.normalize("NFKC", w).casefold().strip() for w in words]


def test_words_for_gaps(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, "a", None), (3, None, None), (4, "b", 1.0)], "rid int, c string, x double")
    got = prepare.fill_forward(df, ["c"], "rid", ["rid"], "start").orderBy("rid").collect()
    assert [r["c"] for r in got] == ["start", "a", "a", "b"] and got[0]["x"] == 2.0
    assert [r["c"] for r in prepare.fill_forward(df, ["c", "x"], "rid", ["rid"], backward=True).orderBy("rid").collect()] == ["a", "a", "a", "b"]
    assert prepare.fill_forward(df.limit(0), ["c"], "rid", ["rid"]).count() == 0
    assert prepare.CategoryImputer("default", "w").fit(df, ["c"]).values == {"c": "w"} and prepare.CategoryImputer("unknown", "w").fit(df, ["c"]).values == {"c": "unknown"}
    with pytest.raises(ValueError, match="unknown strategy"):
        prepare.CategoryImputer("guess").fit(df, ["c"])


def test_dates_filled_on_narrow_rows(spark):
    rows = [(k, None if k % 3 else f"2020-01-{k % 28 + 1:02d}", None if k < 50 or k % 7 else float(k), "wide") for k in range(200)]
    df = spark.createDataFrame(rows, "rid int, day string, x double, other string").repartition(7)
    for backward in (False, True):
        got = {r["rid"]: (r["day"], r["x"]) for r in ranges.filled(df, ["day", "x"], "rid", ["rid"], backward).collect()}
        day, x = None, None
        for rid, d, v, _ in rows:
            day, x = d or day, v if v is not None else x
            if d is None or v is None:
                assert got[rid] == (day, x if x is not None or not backward else 56.0)
            else:
                assert rid not in got


def test_headers(spark):
    assert io.normalise_headers(spark.createDataFrame([(1, 2)], "` A b ` int, c int")).columns == ["a_b", "c"]
    with pytest.raises(ValueError, match="collide"):
        io.normalise_headers(spark.createDataFrame([(1, 2)], "`a b` int, `A_b` int"))


def test_mappings_export(spark, tmp_path):
    m = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b")], "column_name string, code int, original_value string")
    io.write_mappings(m, f"{tmp_path}/m.json", "json")
    assert json.load(open(f"{tmp_path}/m.json")) == {"s": {"0": "a", "1": "b"}}
    io.write_mappings(m, f"{tmp_path}/m.md", "markdown")
    io.write_mappings(m, f"{tmp_path}/m", "csv")
    assert "| 1 | b |" in open(f"{tmp_path}/m.md").read() and os.path.isdir(f"{tmp_path}/m")


PAGE = """<html><head><title>A page</title><script>var x</script></head><body><nav>menu</nav><h1>Top</h1><h2>About us</h2><p>We have made things since 1990.</p><p>no</p>
<div>Second paragraph here</div><h2>Contact</h2><p>Write to a@b.org or 15551234567</p><table><tr><th>k</th><td>v</td></tr></table></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([("u", PAGE), ("e", ""), ("n", None)], "url string, html string")
    rows = {r["url"]: r for r in html.extract(df).collect()}
    assert rows["u"]["title"] == "A page" and "menu" not in rows["u"]["raw_text"] and "var x" not in rows["u"]["raw_text"]
    cards = {c["card_type"]: c for c in rows["u"]["cards"]}
    assert cards["about"]["content"] == ["We have made things since 1990.", "Second paragraph here"]
    assert cards["contact"]["entities"]["EMAIL"] == ["a@b.org"] and cards["contact"]["entities"]["PHONE"] == ["15551234567"]
    assert rows["n"]["summary"] == html.NO_CARDS and rows["e"]["title"] == ""
    assert df.select(html.section_by_keyword(F.col("html"), "about")).first()[0].startswith("We have made")
    assert list(html.tables_of(html.tree(PAGE))) == [(0, 0, ["k", "v"])]


def test_deep_page():
    assert html.readable(html.tree("<div>" * 5000 + "x")) == "x"


def test_fetch(spark):
    def source(url):
        if "bad" in url:
            raise OSError("no route")
        return f"<p>{url}</p>"

    urls = spark.createDataFrame([("http://a",), ("http://bad",), (None,)], "url string")
    got = {r["url"]: r for r in fetch.fetch_pages(urls, attempts=2, backoff=0.0, fetch=source).collect()}
    # a host's robots text is asked for first
    asked = []

    def guarded(url):
        asked.append(url)
        return "User-agent: *\nDisallow: /private" if url.endswith("robots.txt") else "page"

    known = {}
    assert fetch.robots_rules("http://h", guarded, known) == fetch.robots_rules("http://h", guarded, known) and asked == ["http://h/robots.txt"]
    assert fetch.blocked(known["http://h"], "http://h/open") and not fetch.blocked(known["http://h"], "http://h/open", "loamworks") and fetch.blocked(known["http://h"], "http://h/private/x", "loamworks")
    assert not fetch.blocked(None, "http://h/x") and not fetch.blocked("User-agent: *\nAllow: /", "http://h/x")
    pages = spark.createDataFrame([("http://h/a",)], "url string")
    shut = lambda u: "Disallow: /" if u.endswith("robots.txt") else "page"
    row = fetch.fetch_pages(pages, fetch=shut).first()
    assert not row["success"] and row["error_message"] == "blocked by robots.txt"
    assert fetch.fetch_pages(pages, fetch=shut, robots=False).first()["success"]
    assert got["http://a"]["success"] and not got["http://bad"]["success"] and "no route" in got["http://bad"]["error_message"] and not got[None]["success"]


def test_reports(spark, tmp_path):
    text = report.quality_markdown(0.5, [{"rule": "r", "severity": "high", "column_name": "c", "violations": 2, "samples": ["x", "y"], "fixable": True}])
    assert "high: 1" in text and "can be fixed" in text
    assert report.log_summary([{"step": "a", "n": 1}]) == "1. a: n=1"
    cards = spark.createDataFrame([("u", "about", "T", ["x", "y"])], "url string, card_type string, title string, content array<string>")
    assert "- y" in report.cards_markdown(cards)
    paths = report.write_cards(cards, str(tmp_path))
    assert spark.read.text(paths["text"]).count() == 2 and "- y" in [r[0] for r in spark.read.text(paths["markdown"]).collect()]
    assert spark.read.option("header", True).option("escape", '"').csv(paths["csv"]).first()["content"] == '["x","y"]'
    with pytest.raises(ValueError, match="more than"):
        report.cards_markdown(cards.unionAll(cards), 1)
    sums, decisions = report.merged_audits(spark.createDataFrame([(3, 1, [("a", "t")]), (4, 0, [("b", "t"), ("c", "u")])], "rows_in int, quarantined_cells int, decisions array<struct<column: string, column_type: string>>"))
    assert tuple(sums.first()) == (7, 1, 3) and {r["column"] for r in decisions.collect()} == {"a", "b", "c"}


def test_models(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 2), float(i % 2) * 2 + (i % 5) / 10, float(i)) for i in range(100)], "label double, a double, b double")
    fitted = models.train_classifier(df, "label", ["a", "b"])
    assert metrics.multiclass(fitted.transform(df), "label", "prediction").first()["accuracy"] > 0.95
    best = models.search(df, "b", ["a", "label"], "ridge", {"regParam": [0.1, 1.0]}, folds=2)
    assert len(best.avgMetrics) == 2
    few = models.search(df, "b", ["a", "label"], "ridge", {"regParam": [0.1, 0.5, 1.0], "elasticNetParam": [0.0, 0.5]}, folds=2, sampled=2)
    assert len(few.avgMetrics) == 2
    again = models.load(models.save(fitted, f"{tmp_path}/model"))
    assert [r["prediction"] for r in again.transform(df).collect()] == [r["prediction"] for r in fitted.transform(df).collect()]
    split = models.stratified_split(df, "label", ["b"])
    assert split.filter("is_test").groupBy("label").count().filter("count <> 10").count() == 0


def test_stream(spark, tmp_path):
    history = numbers(spark, [1.0, 3.0, None])
    fill = prepare.NumericImputer("mean").fit(history, ["x"])
    history.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(history.schema).parquet(f"{tmp_path}/in")
    q = streaming.write_clean(streaming.clean_stream(stream, [fill.transform]), f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination(60)
    assert sorted(r["x"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1.0, 2.0, 3.0]


def test_windows(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS k, 1.0D AS v UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'a', 2.0D UNION ALL SELECT timestamp'2024-01-01 02:00:00', 'a', 4.0D")
    assert {(r["n"], r["total"]) for r in streaming.windowed(df, "ts", ["k"], "v").collect()} == {(2, 3.0), (1, 4.0)}
    assert streaming.sessions(df, "ts", ["k"]).count() == 2


# ---- the column-level profile
SCHEMA = pa.schema([("row_id", pa.int64()), ("age", pa.string()), ("email", pa.string()), ("status", pa.string()), ("feed", pa.string()), ("load_no", pa.int32()), ("extra", pa.string())])


def load(n, feed, load_no, age="30", email="u{i}@a.org", status="ok"):
    return [(i, age, email.format(i=i) if email else None, status, feed, load_no, "x") for i in range(n)]


def issues(spark, tmp_path, rows, groups=None):
    path = f"{tmp_path}/t{len(os.listdir(tmp_path))}.parquet"
    table = pa.table({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(SCHEMA)}, SCHEMA)
    pq.write_table(table, path, row_group_size=groups or 1000)
    return {tuple(r) for r in quality.load_issues(spark, path).collect()}


def test_issues(spark, tmp_path):
    base = load(100, "f", 1)
    assert issues(spark, tmp_path, base + load(100, "f", 3)) == set()
    assert issues(spark, tmp_path, base + load(15, "f", 3, age=" n/a ") + load(85, "f", 3)) == {("f", 3, "age", "missing")}
    assert issues(spark, tmp_path, base + load(100, "f", 2, age="38")) == {("f", 2, "age", "shift")}
    assert issues(spark, tmp_path, base + load(90, "f", 2) + load(10, "f", 2, age="thirty")) == {("f", 2, "age", "pattern")}
    assert issues(spark, tmp_path, load(95, "f", 1) + load(5, "f", 1, age="121")) == {("f", 1, "age", "range")}
    assert issues(spark, tmp_path, base + load(100, "f", 2, email="u@a.org")) == {("f", 2, "email", "distinct")}
    assert issues(spark, tmp_path, base + load(70, "f", 2) + load(30, "f", 2, status="NEW ")) == {("f", 2, "status", "shift")}
    assert issues(spark, tmp_path, []) == set()


def test_issues_with_nulls_and_settled_files(spark, tmp_path):
    assert issues(spark, tmp_path, load(20, None, 1) + load(20, "f", None)) == set()
    # a file that holds one load and no value is settled by its footer
    rows = [(i, None, None, None, "f", 2, None) for i in range(50)]
    d = tmp_path / "many.parquet"
    d.mkdir()
    for k, part in enumerate((load(50, "f", 1), rows)):
        pq.write_table(pa.table({f.name: pa.array([r[j] for r in part], f.type) for j, f in enumerate(SCHEMA)}, SCHEMA), d / f"{k}.parquet")
    got = {tuple(r) for r in quality.load_issues(spark, str(d)).collect()}
    assert got == {("f", 2, c, "missing") for c in ("age", "email", "status")}


def test_table_profile_reads_footers(spark, tmp_path):
    path = f"{tmp_path}/p.parquet"
    pq.write_table(pa.table({"a": [1, None, 3, 3], "b": ["x", "y" * 500, None, None], "c": pa.array([None] * 4, pa.string())}), path, row_group_size=2)
    rows = {r["column_name"]: r for r in quality.table_profile(spark, path, ["a", "b", "c"]).collect()}
    assert (rows["a"]["nulls"], rows["a"]["distinct_values"], rows["a"]["lo"], rows["a"]["hi"]) == (1, 2, "1", "3")
    assert (rows["b"]["nulls"], rows["b"]["hi"]) == (2, "y" * 500)
    assert (rows["c"]["nulls"], rows["c"]["distinct_values"], rows["c"]["lo"]) == (4, 0, None)


CHUNKS = {"n": [None if i % 7 == 0 else i % 50 for i in range(4000)], "t": [None if i % 5 == 0 else f"wörd {i % 300} " + "x" * (i % 90) for i in range(4000)], "u": [f"only {i}" for i in range(4000)], "e": [None] * 4000}


@pytest.mark.parametrize("options", [
    {"compression": "none"}, {"compression": "snappy", "data_page_version": "2.0"}, {"compression": "gzip", "data_page_size": 500}, {"compression": "zstd", "row_group_size": 777}, {"compression": "lz4"}, {"compression": "brotli", "data_page_size": 200, "data_page_version": "2.0"},
    {"use_dictionary": False}, {"dictionary_pagesize_limit": 300, "data_page_size": 300}, {"write_statistics": False, "row_group_size": 900}, {"use_dictionary": ["t"], "write_statistics": ["n", "e"]},
])
def test_profile_of_chunks_in_every_form(spark, tmp_path, options):
    """Dictionary pages give what footers leave open; plain chunks, half plain ones and those without statistics are scanned."""
    path = f"{tmp_path}/p.parquet"
    pq.write_table(pa.table({"n": pa.array(CHUNKS["n"], pa.int32()), "t": CHUNKS["t"], "u": CHUNKS["u"], "e": pa.array(CHUNKS["e"], pa.string())}), path, **options)
    rows = {r["column_name"]: r for r in quality.table_profile(spark, path, list(CHUNKS)).collect()}
    costs = {r["column_name"]: r for r in quality.profile_costs(spark, path, list(CHUNKS)).collect()}
    for c, values in CHUNKS.items():
        there = [v for v in values if v is not None]
        assert (rows[c]["rows"], rows[c]["nulls"], rows[c]["distinct_values"]) == (4000, 4000 - len(there), len(set(there)))
        assert (rows[c]["lo"], rows[c]["hi"]) == ((str(min(there)), str(max(there))) if there else (None, None))
    if options.get("use_dictionary") is False or options.get("write_statistics") is False:
        assert costs["t"]["by_dictionary"] == 0 < costs["t"]["by_scan"]
    elif "dictionary_pagesize_limit" in options:
        assert costs["u"]["by_scan"] == 1  # some of its pages are plain
    elif "use_dictionary" not in options:
        size = sum(pq.ParquetFile(path).metadata.row_group(g).column(1).total_compressed_size for g in range(pq.ParquetFile(path).num_row_groups))
        assert costs["t"]["by_scan"] == 0 < costs["t"]["by_dictionary"] and costs["e"]["bytes_read"] == 0
        assert "data_page_size" in options or costs["t"]["bytes_read"] <= size * 1.2 + 8192 * 6


def test_cut_statistics_are_not_trusted(spark, tmp_path):
    """Extrema of text in a footer may be cut short, so they count only if a dictionary or a scan gives them."""
    path = f"{tmp_path}/p.parquet"
    pq.write_table(pa.table({"t": ["y" * 500, "a" * 500]}), path)
    row = quality.footer_chunks(spark, path, ["t"]).first()
    assert not row["exact"] and row["lo"] is None
    row = quality.footer_chunks(spark, path, ["t"], ["t"]).first()
    assert row["exact"] and row["lo"] == "a" * 500 and row["hi"] == "y" * 500


def test_cut_survives_and_keeps_types(spark):
    df = spark.createDataFrame([(1, [1, 2], {"a": "b"})], "a int, b array<int>, c map<string,string>")
    assert cut(df).schema == df.schema and cut(df).collect() == df.collect()
