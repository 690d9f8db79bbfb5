"""Cleaners against tables of expected values."""

import pytest
from pyspark.sql import functions as F

from loamworks.functions import columns as C
from loamworks.functions import synonyms
from loamworks.functions import text as X

CASES = [
    (C.price, [("$25.99", 25.99), ("1,234.50", 1234.5), ("Freezer 20", 0.0), ("approx. 20", 20.0), ("Rs. 500", 0.5), ("-5.5", 5.5), ("1.2.3", None), ("N/A", None), ("", None), (None, None)]),
    (C.rating, [("Excellent", 5.0), (" OK ", 3.0), ("4", 4.0), ("N/A", None), ("meh", None), ("nan", None), (None, None)]),
    (C.status, [("DELIVERED", "delivered"), ("Shipped", "delivered"), ("canceled", "cancelled"), ("refunded", "returned"), ("mystery", "mystery"), (None, None)]),
    (C.date, [("2024-01-15", "2024-01-15"), ("2024/01/15", "2024-01-15"), ("15.01.2024", "2024-01-15"), ("Jan 15, 2024", "2024-01-15"), ("15/01/2024", "2024-01-15"), ("01/02/2024", "2024-01-02"), ("15 March 2024", "2024-03-15"), ("2024-02-30", None), ("not a date", None), ("", None), (None, None)]),
    (C.age, [("25", 25), ("47.9", 47), ("150", 150), ("200", None), ("-3", None), ("invalid", None), ("4d", None), (None, None)]),
    (C.email, [(" A@B.Com ", "a@b.com"), ("invalid-email", None), ("diana@invalid", None), (None, None)]),
    (C.phone, [("+1-555-123-4567", "+15551234567"), ("(555) 987-6543", "+15559876543"), ("44 20 7946 0958", "+442079460958"), ("12345", None), (None, None)]),
    (C.score, [("85%", 85.0), ("A", 95.0), ("3.2", 3.2), ("78/100", 78.0), ("b+", 88.0), ("F", 0.0), ("250", None), ("junk", None), ("1/0", None), (None, None)]),
    (C.boolean, [("Yes", True), ("0", False), ("maybe", None), (None, None)]),
]


@pytest.mark.parametrize(("f", "rows"), CASES, ids=[f.__name__ for f, _ in CASES])
def test_values(spark, f, rows):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)], "i int, v string")
    got = [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]
    assert got == [pytest.approx(w) if isinstance(w, float) else w for _, w in rows]


def test_synonyms(spark):
    df = spark.createDataFrame([("M",), ("Done",), (None,)], "v string")
    assert [r[0] for r in df.select(C.categorical(F.col("v"), "gender")).collect()] == ["male", "Done", None]
    table = spark.createDataFrame([("m", "male"), ("m", "zzz")], "spelling string, canonical string")
    assert [r[0] for r in synonyms.lookup_table(df, "v", table).collect()] == ["male", "Done", None]
    assert synonyms.kind_of("order_status") == "status" and synonyms.kind_of("x") is None


def test_text(spark):
    df = spark.createDataFrame([("ＡＢＣ ﬁn ",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(X.nfkc_casefold(F.col("v"))).collect()] == ["abc fin", None, ""]
    many = " ".join(f"w{i}" for i in range(30))
    one = spark.createDataFrame([(many,)], "v string")
    assert one.select(X.summary(F.col("v"))).first()[0] == " ".join(f"w{i}" for i in range(25)) + "..."
    robots = spark.createDataFrame([("User-agent: *\nDisallow: /private",), ("User-agent: *\n Disallow: /",), (None,)], "v string")
    assert [r[0] for r in robots.select(X.robots_allows(F.col("v"))).collect()] == [False, False, True]
    urls = robots.select(X.robots_parser(F.col("v"), F.lit("http://a.example/open")))
    assert [r[0] for r in urls.collect()] == [True, False, True]
    assert one.select(X.similarity(F.lit("kitten"), F.lit("sitting"))).first()[0] == pytest.approx(1 - 3 / 7)
