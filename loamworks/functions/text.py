"""Text functions: forms, extraction, summaries, urls."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMAILS = r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+"
PHONES = r"[+]?[0-9][0-9\s-]{7,}[0-9]"
LONG_DIGITS = r"[+]?[1-9]?[0-9]{7,15}"


def nfkc_casefold(c: Column) -> Column:
    """Compatibility form, case folded, without blanks at the ends. Spark has no built-in for it, so Arrow batches go to Python."""

    @F.pandas_udf(T.StringType())
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else (t if t.isascii() else unicodedata.normalize("NFKC", t)).casefold().strip() for t in s.tolist()], index=s.index, dtype=object)

    return form(c)


def emails(c: Column) -> Column:
    """All address-like parts, once each, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({EMAILS})"), F.lit(1))))


def phones(c: Column, pattern: str = PHONES) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def summary(c: Column, most: int = 25) -> Column:
    """The first words of a text, with dots if there are more; the text itself if not."""
    w = words(c)
    return F.when(F.size(w) <= most, c).otherwise(F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("...")))


def first_two_sentences(c: Column) -> Column:
    return F.array_join(F.slice(F.split(c, r"\. "), 1, 2), " ")


def clean_text(c: Column, most: int = 300) -> Column:
    """White space as single blanks, cut after `most` characters."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.substring(flat, 1, most)


def long_lines(c: Column, least: int = 30) -> Column:
    """Lines of more than `least` characters."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > least)


def url_valid(c: Column) -> Column:
    """Whether a url has a scheme and a host."""
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+"), F.lit(False))


def url_part(c: Column, part: str) -> Column:
    """`scheme`, `host`, `path`, `query` or `fragment` of a url as written (scheme and host in lower case); empty if it has none."""
    whole = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    place = {"scheme": 1, "host": 2, "path": 3, "query": 4, "fragment": 5}[part]
    found = F.regexp_extract(c, whole, place)
    return F.lower(found) if place < 3 else found


def robots_allows(robots: Column) -> Column:
    """Whether no line of a robots text begins with "disallow: /", for whatever agent; a null text allows."""
    return ~F.coalesce(F.exists(F.split(robots, "\n"), lambda x: F.startswith(F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")), F.lit("disallow: /"))), F.lit(False))


def robots_parser(robots: Column, url: Column, agent: str = "*") -> Column:
    """Whether a robots text lets an agent fetch a url, by the full rules."""

    @F.pandas_udf(T.BooleanType())
    def allowed(texts: pd.Series, urls: pd.Series) -> pd.Series:
        from urllib.robotparser import RobotFileParser

        out = []
        for text, u in zip(texts, urls):
            rules = RobotFileParser()
            rules.parse((text or "").splitlines())
            out.append(bool(u) and rules.can_fetch(agent, u))
        return pd.Series(out)

    return allowed(robots, url)


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, less by the share of characters to be edited."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def first_sentences(c: Column, most: int = 3) -> Column:
    """The first sentences of a text, each ending at a full stop, exclamation or question mark followed by white space."""
    return F.array_join(F.slice(F.split(F.trim(c), r"(?<=[.!?])\s+"), 1, most), " ")
