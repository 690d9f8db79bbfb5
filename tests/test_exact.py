"""Exact quantiles against numpy: ties, nulls, narrowing, brackets that miss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamworks.operators import exact


def table(spark, columns):
    n = max((len(c) for c in columns.values()), default=0)
    rows = [tuple(float(c[i]) if i < len(c) and c[i] is not None else None for c in columns.values()) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3)


@pytest.mark.parametrize("accuracy,few", [(10_000, 100_000), (100, 50), (20, 5)])
def test_quantiles(spark, accuracy, few):
    r = np.random.default_rng(accuracy)
    data = {
        "a": r.normal(size=3000).tolist(), "b": r.integers(0, 4, 3000).tolist(), "c": [7.0] * 3000, "d": [None if i % 3 else float(i) for i in range(3000)],
        "e": [None] * 3000, "f": [5.0], "g": [1.0, 2.0], "h": np.exp(r.normal(size=2999) * 20).tolist(), "i": [-0.0, 0.0, 1e308, -1e308, 3.5],
    }
    df = table(spark, data)
    got = exact.summaries(df, {c: F.col(c) for c in data}, filled=True, accuracy=accuracy, few=few)
    for c, values in data.items():
        have = np.array([v for v in values if v is not None], float)
        s = got[c]
        assert s.n == have.size and s.nulls == 3000 - have.size
        for q in (0.25, 0.5, 0.75):
            if not have.size:
                assert s.quantile(q) is None
                continue
            assert s.quantile(q) == pytest.approx(np.quantile(have, q), rel=1e-12, abs=1e-12)
            fill = s.quantile(0.5)
            assert s.filled_quantile(q, fill) == pytest.approx(np.quantile(np.concatenate([have, np.full(s.nulls, fill)]), q), rel=1e-12, abs=1e-12)


def test_a_bracket_that_misses_is_widened(spark):
    t = table(spark, {"c0": list(range(1000))})
    for lo, hi in ((900.0, 950.0), (10.0, 20.0), (-5.0, -1.0)):
        b = exact.Bracket("c", (499, 500), lo, hi)
        assert exact._counted(t, {"c": F.col("c0")}, [b]) == [False] and b.lo <= 499 and b.hi >= 500
        again = exact._narrowed(t, {"c": F.col("c0")}, [b], 100)
        while exact._counted(t, {"c": F.col("c0")}, again) != [True]:
            again = exact._narrowed(t, {"c": F.col("c0")}, again, 100)
        assert again[0].values == {499: 499.0, 500: 500.0}


def test_empty(spark):
    df = spark.createDataFrame([], "a double")
    assert exact.summaries(df, {"a": F.col("a")})["a"].quantile(0.5) is None and exact.summaries(df, {}) == {}
