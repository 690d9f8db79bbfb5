"""Whole runs: preprocessing with a tidy and a model-ready result, and the cleaning of a file."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamworks.functions import columns as C
from loamworks.functions import synonyms
from loamworks.operators import gates, profile
from loamworks.operators.prepare import CategoryImputer, IqrOutliers, NumericImputer, ZScoreRows, label_encode, label_mapping
from loamworks.plans import policy, report
from loamworks.session import with_row_id
from loamworks.sources import io


@dataclass
class Settings:
    outliers: str = "cap"  # cap, remove or ignore
    numeric: str = "median"  # mean, median or zero
    category: str = "unknown"  # unknown or mode
    z_limit: float = 3.0
    encode: Sequence[str] | None = None  # columns to encode; None: text columns of few values


@dataclass
class Prepared:
    tidy: DataFrame
    ml_ready: DataFrame
    mappings: dict[str, DataFrame]
    stats: dict = field(default_factory=dict)
    steps: list[dict] = field(default_factory=list)


def preprocess(df: DataFrame, settings: Settings | None = None) -> Prepared:
    """Headers, special cleaners, synonyms and case, imputation, outliers; then codes and a flag for the model-ready table.

    Only columns that are numeric before encoding are capped and filled. The tidy table keeps text as text.
    """
    s, steps = settings or Settings(), []
    log = lambda step, **details: steps.append({"step": step, **details})
    df = io.normalise_headers(df)
    exprs = {c: cleaner(F.col(c)) for c in df.columns if (cleaner := C.special_cleaner(c)) and isinstance(df.schema[c].dataType, T.StringType)}
    log("special_cleaners", columns=sorted(exprs))
    for c in profile.columns_of(df, T.StringType):
        if c not in exprs:
            kind = synonyms.kind_of(c)
            x = C.standard_case(F.col(c))
            exprs[c] = F.coalesce(synonyms.lookup(x, synonyms.flat(kind)), x) if kind else x
    first = df.withColumns(exprs)
    numbers = profile.columns_of(first, T.NumericType)
    text = profile.columns_of(first, T.StringType)
    second = CategoryImputer(s.category).fit(first, text).transform(first) if text else first
    if numbers:
        caps = IqrOutliers(s.outliers).fit(second, numbers)
        second = caps.transform(second)
        fills = NumericImputer(s.numeric).fit(second, numbers)
        second = fills.transform(second)
        log("numbers", bounds=caps.bounds, fills=fills.values)
    ml = ZScoreRows(s.z_limit).fit(second, numbers).transform(second) if numbers else second.withColumn("is_outlier", F.lit(False))
    wanted = list(s.encode) if s.encode is not None else [c for c in text if C.special_cleaner(c) in (None, C.status)]
    mappings = {c: label_mapping(second, c) for c in wanted}
    for c, m in mappings.items():
        ml = label_encode(ml, c, m)
    ml = ml.drop(*text)
    stats = {"columns": len(df.columns), "dtypes": dict(df.dtypes), "domain": profile.domain_of(df.columns), "numeric": numbers, "text": text}
    log("done", **{k: stats[k] for k in ("columns", "domain")})
    return Prepared(second, ml, mappings, stats, steps)


@dataclass
class FileResult:
    success: bool
    paths: dict[str, str] = field(default_factory=dict)
    quality_score: float | None = None
    rows: int = 0
    quarantined: int = 0
    seconds: float = 0.0
    error: str | None = None


def clean_file(spark: SparkSession, path: str, out: str, rules: Sequence[gates.Rule] = (), row_id: str | None = None, kind: str = "parquet", quarantine: bool = True) -> FileResult:
    """Read, clean by column types, hold against rules, and write: data, model-ready data with its mappings, quarantine,
    audit, profile, log, metrics, report.

    One plan for every size. Violating rows are left out of the data if `quarantine` is on, else kept; they are
    written apart in both cases. Errors of the input give success=False.
    """
    began = time.monotonic()
    try:
        df = io.read(spark, path)
    except ValueError as problem:
        return FileResult(False, error=str(problem))
    key = row_id or "_row_id"
    df = df if row_id else with_row_id(df)
    done = policy.clean(df, key)
    clean, bad = gates.split(done.cleaned, rules)
    drop = [] if row_id else [key]
    paths = io.write((clean if quarantine else done.cleaned).drop(*drop), f"{out}/cleaned", kind)
    rows = bad.withColumn("violated", F.array_join("violated", ", ")).unionByName(done.quarantined.select(F.col("row_id").alias(key), "column_name", "original_value", "reason"), allowMissingColumns=True)
    io.write(rows, f"{out}/quarantine")
    shown = done.cleaned.drop(*drop)
    ready = preprocess(shown)
    paths |= {f"ml_ready_{k}": v for k, v in io.write(ready.ml_ready, f"{out}/ml_ready", kind).items()}
    for c, mapping in ready.mappings.items():
        paths[f"mapping_{c}"] = io.write(mapping, f"{out}/mappings/{c}", "csv")["csv"]
    overview = {"rows": done.audit.rows_in, "columns": len(shown.columns), "dtypes": dict(shown.dtypes), "domain": profile.domain_of(shown.columns), "profile": [r.asDict() for r in profile.column_profile(shown).collect()]}  # a row for each column
    io.write_json(overview, f"{out}/data_profile.json")
    log = [{"step": f"clean {d.column}", "type": d.column_type, "rules": d.rules} for d in done.audit.decisions] + ready.steps
    io.write_json(log, f"{out}/cleaning_log.json")
    io.write_text(report.log_summary(log), f"{out}/cleaning_log.txt")
    score = gates.score(done.cleaned, rules).first()
    violated = [r.asDict() for r in gates.report(done.cleaned, rules).collect()] if rules else []
    io.write_json(done.audit.as_dict(), f"{out}/audit.json")
    by = Counter(v["severity"] for v in violated if v["violations"])
    io.write_json({"quality_score": score["quality_score"], "rows": score["rows"], "rules": len(rules), "rules_violated": score["rules_violated"], "violating_cells": sum(v["violations"] for v in violated), "by_severity": by, "fixable": sum(v["fixable"] for v in violated), "violations": violated}, f"{out}/quality.json")
    report.write_markdown(f"{out}/quality.md", score["quality_score"], violated)
    paths |= {"profile": f"{out}/data_profile.json", "log": f"{out}/cleaning_log.json", "log_text": f"{out}/cleaning_log.txt", "quarantine": f"{out}/quarantine", "audit": f"{out}/audit.json", "quality": f"{out}/quality.json", "report": f"{out}/quality.md"}
    return FileResult(True, paths, score["quality_score"], score["rows"], rows.count(), time.monotonic() - began)
