"""Reports for people: quality, cleaning log, extraction."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamworks.sources import io


def quality_markdown(score: float, violations: list[dict]) -> str:
    """Score, counts by severity, violations with a sample, fixes and advice."""
    broken = [v for v in violations if v["violations"]]
    by = Counter(v["severity"] for v in broken)
    lines = ["# Data quality report", "", f"Score: {score:.3f}", "", "## By severity", *(f"- {s}: {n}" for s, n in sorted(by.items())), "", "## Violations"]
    for v in broken:
        lines.append(f"- {v['rule']} ({v['severity']}) on {v['column_name']}: {v['violations']} rows, for example " + ", ".join(map(repr, v["samples"])) + (", can be fixed" if v.get("fixable") else ""))
    lines += ["", "## Advice", "Look into the violations before using the data." if score < 0.8 else "The data can be used."]
    return "\n".join(lines) + "\n"


def write_markdown(path: str, score: float, violations: list[dict]) -> str:
    return io.write_text(quality_markdown(score, violations), path)


def log_summary(steps: list[dict]) -> str:
    """A cleaning log as text, a line for each step."""
    return "\n".join(f"{k + 1}. {s['step']}: " + ", ".join(f"{n}={v}" for n, v in s.items() if n != "step") for k, s in enumerate(steps))


def cards_markdown(cards: DataFrame, most: int = 1000) -> str:
    """Cards (url, card_type, title, content) as a page; more than `most` are an error: write them with `write_cards`."""
    rows = cards.orderBy("url", "card_type").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} cards: write them to files")
    return "\n".join(x for r in rows for x in (f"## {r['title']} ({r['card_type']})", r["url"] or "", *(f"- {c}" for c in r["content"] or []), ""))


def write_cards(cards: DataFrame, out: str) -> dict[str, str]:
    """All cards as JSON lines, as a table in CSV (lists and entities as JSON), as markdown, and their content as plain text."""
    cards.write.mode("overwrite").json(f"{out}/cards")
    io.write(cards, f"{out}/cards_csv", "csv")
    page = F.concat(F.format_string("## %s (%s)\n", F.coalesce("title", F.lit("")), "card_type"), F.coalesce("url", F.lit("")), F.array_join(F.transform(F.coalesce("content", F.array().cast("array<string>")), lambda c: F.concat(F.lit("\n- "), c)), ""), F.lit("\n"))
    cards.sortWithinPartitions("url", "card_type").select(page.alias("value")).write.mode("overwrite").text(f"{out}/markdown")
    cards.select(F.array_join("content", "\n").alias("value")).filter("value IS NOT NULL").write.mode("overwrite").text(f"{out}/text")
    return {"cards": f"{out}/cards", "csv": f"{out}/cards_csv", "markdown": f"{out}/markdown", "text": f"{out}/text"}


def export_log(steps: list[dict], kind: str = "json") -> str:
    """A cleaning log as `json`, as a `summary` of lines, or as `str`."""
    if kind == "json":
        return json.dumps(steps, ensure_ascii=False, default=str)
    return log_summary(steps) if kind == "summary" else str(steps)


def write_entities(cards: DataFrame, out: str, labels: list[str]) -> dict[str, str]:
    """For each label, a CSV of the values found in cards' entities, with their url."""
    paths = {}
    for label in labels:
        values = cards.select("url", F.explode(F.try_element_at("entities", F.lit(label))).alias("value")).distinct()
        values.write.mode("overwrite").option("header", True).csv(f"{out}/{label.lower()}")
        paths[label] = f"{out}/{label.lower()}"
    return paths


def merged_audits(audits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits (rows_in, quarantined_cells, decisions) of parts as one: a row of sums, and all decisions, a row for each."""
    sums = audits.agg(F.sum("rows_in").alias("rows_in"), F.sum("quarantined_cells").alias("quarantined_cells"), F.coalesce(F.sum(F.size("decisions")), F.lit(0)).alias("decisions"))
    return sums, audits.select(F.explode("decisions").alias("d")).select("d.*")


def progress(spark: SparkSession) -> dict[int, tuple[int, int]]:
    """Tasks done and tasks in all of each stage that is running."""
    tracker = spark.sparkContext.statusTracker()
    stages = (tracker.getStageInfo(i) for i in tracker.getActiveStageIds())
    return {s.stageId: (s.numCompletedTasks, s.numTasks) for s in stages if s}
