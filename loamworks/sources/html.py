"""Pages to titles, readable text, cards, entities, tables and summaries.

The tree of a page is built and used inside one Arrow function for each row; it never becomes a column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIPPED = frozenset({"script", "style", "nav", "footer", "header", "noscript", "template"})
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
BLOCKS = frozenset("address article aside blockquote br div dd dl dt figure form h1 h2 h3 h4 h5 h6 li main ol p pre section table td th tr ul".split()) | SKIPPED
# What headings of the ten kinds of cards say.
CARDS = {
    "about": r"about\s+us|our\s+story|company\s+overview|who\s+we\s+are|our\s+mission|our\s+vision",
    "products_services": r"products?|services?|solutions?|offerings?|what\s+we\s+do",
    "team_people": r"team|staff|employees?|people|leadership",
    "locations": r"locations?|offices?|contact\s+us|where\s+we\s+are|address|headquarters?|branches?",
    "contact": r"contact|get\s+in\s+touch|reach\s+us|phone|email|address",
    "social": r"follow\s+us|social\s+media|connect\s+with\s+us|facebook|twitter|linkedin|instagram",
    "pricing": r"pricing|plans?|cost|rates?|fees?",
    "faq": r"faq|questions?|help|support",
    "jobs": r"jobs?|careers?|employment|work\s+with\s+us|join\s+us|open\s+positions?|vacancies?",
    "policies": r"privacy\s+policy|terms\s+of\s+service|terms\s+and\s+conditions|legal|disclaimer|cookie\s+policy",
}
_CARDS = {k: re.compile(p, re.I) for k, p in CARDS.items()}
NO_CARDS = "No structured information found."
MAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"[+]?[1-9]?[0-9]{7,15}"

CARD_TYPE = T.StructType([T.StructField("card_type", T.StringType()), T.StructField("title", T.StringType()), T.StructField("content", T.ArrayType(T.StringType()))])
PAGE_TYPE = T.StructType([T.StructField("title", T.StringType()), T.StructField("raw_text", T.StringType()), T.StructField("cards", T.ArrayType(CARD_TYPE))])


class Node:
    __slots__ = ("tag", "parent", "children", "words")

    def __init__(self, tag: str, parent: Node | None, words: str = "") -> None:
        self.tag, self.parent, self.words = tag, parent, words
        self.children: list[Node] = []

    def text(self, skip: frozenset = frozenset()) -> str:
        """Text under the node, with breaks between blocks. A stack, not recursion: trees may be deep."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if n.tag == "#":
                out.append(n.words)
            elif n.tag not in skip:
                if n.tag in BLOCKS:
                    out.append("\n")
                stack += n.children[::-1]
        return "".join(out)

    def all(self, tags: frozenset | set) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            if n.tag in tags:
                yield n
            stack += n.children[::-1]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("document", None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "li", "td", "th", "tr", "option") and self.at.tag == tag and self.at.parent:
            self.at = self.at.parent  # an end tag left out
        node = Node(tag, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent and n.tag != tag:
            n = n.parent
        if n.parent:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(Node("#", self.at, data))


def tree(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def flat(text: str) -> str:
    return " ".join(text.split())


def title_of(root: Node) -> str:
    for tag in ("title", "h1"):
        node = next(root.all({tag}), None)
        if node is not None:
            return flat(node.text())
    return ""


def readable(root: Node) -> str:
    return flat(root.text(SKIPPED | {"title"}))


def section(heading: Node, least: int = 10, most: int = 5) -> list[str]:
    """Texts of the siblings after a heading up to the next one: those of more than `least` characters, `most` of them at most."""
    out: list[str] = []
    siblings = heading.parent.children if heading.parent else []
    for n in siblings[siblings.index(heading) + 1 :]:
        if n.tag in HEADINGS:
            break
        text = flat(n.text(frozenset({"script", "style"}))) if n.tag != "#" else ""
        if len(text) > least:
            out.append(text)
    return out[:most]


def cards_of(root: Node) -> list[dict]:
    """For each kind, the first heading that says so and has content."""
    headings = [(flat(h.text()), h) for h in root.all(HEADINGS)]
    out = []
    for kind, pattern in _CARDS.items():
        for title, h in headings:
            if pattern.search(title) and (content := section(h)):
                out.append({"card_type": kind, "title": title, "content": content})
                break
    return out


def tables_of(root: Node) -> Iterator[tuple[int, int, list[str]]]:
    """(table, row, cells) of all tables, tables inside tables as tables of their own."""
    for t, table in enumerate(root.all({"table"})):
        rows = [r for r in table.all({"tr"}) if _owner(r) is table]
        for k, r in enumerate(rows):
            yield t, k, [flat(c.text()) for c in r.children if c.tag in ("td", "th")]


def _owner(n: Node) -> Node | None:
    while n.parent and n.tag != "table":
        n = n.parent
    return n if n.tag == "table" else None


@F.pandas_udf(PAGE_TYPE)
def _parse(html: pd.Series) -> pd.DataFrame:
    rows = []
    for page in html.tolist():
        root = tree(page)
        rows.append((title_of(root), readable(root), cards_of(root)))
    return pd.DataFrame(rows, columns=["title", "raw_text", "cards"])


def page(html: Column) -> Column:
    """struct(title, raw_text, cards) of a page; empty texts and no cards for null or empty pages."""
    return _parse(html)


@F.udtf(returnType="table_no int, row_no int, cells array<string>")
class HtmlTables:
    """Rows of all tables of a page."""

    def eval(self, html: str):  # noqa: ANN201
        for t, r, cells in tables_of(tree(html)):
            yield t, r, cells


def entities(content: Column) -> Column:
    """Map of labels to sorted, distinct values found in an array of texts: addresses and phone numbers by pattern, other labels empty."""
    whole = F.array_join(content, " ")
    found = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(whole, F.lit(f"({p})"), F.lit(1))))
    none = F.array().cast("array<string>")
    labels = ["ORG", "PERSON", "GPE", "LOC", "ADDRESS", "FAC", "NORP", "PRODUCT", "EVENT", "LAW", "LANGUAGE"]
    parts = [x for label in labels for x in (F.lit(label), none)]
    return F.create_map(*parts, F.lit("EMAIL"), F.coalesce(found(MAIL), none), F.lit("PHONE"), F.coalesce(found(PHONE), none))


def card_summary(contents: Column, most: int = 25) -> Column:
    """The first words of all cards' contents; a fixed sentence when there is none."""
    from loamworks.functions.text import summary

    whole = F.array_join(F.flatten(contents), " ")
    return F.when(F.coalesce(F.size(F.flatten(contents)), F.lit(0)) <= 0, F.lit(NO_CARDS)).otherwise(summary(whole, most))


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """url, title, raw_text, summary and cards (with entities and confidence 0.8) of each page."""
    p = pages.withColumn("_p", page(F.col(html)))
    with_entities = F.transform("_p.cards", lambda c: F.struct(c["card_type"].alias("card_type"), c["title"].alias("title"), c["content"].alias("content"), entities(c["content"]).alias("entities"), F.lit(0.8).alias("confidence")))
    return p.select(F.col(url).alias("url"), F.col("_p.title").alias("title"), F.col("_p.raw_text").alias("raw_text"), card_summary(F.transform("_p.cards", lambda c: c["content"])).alias("summary"), with_entities.alias("cards"))


def explode_cards(extracted: DataFrame) -> DataFrame:
    return extracted.select("url", F.inline("cards"))


def by_label(entity_map: Column, label: str) -> Column:
    """Values of one label as one text."""
    return F.array_join(F.coalesce(F.try_element_at(entity_map, F.lit(label)), F.array().cast("array<string>")), ", ")


def section_by_keyword(html: Column, keyword: str) -> Column:
    """Content of the first section whose heading has the word, as one text; null without one."""

    @F.pandas_udf(T.StringType())
    def find(pages: pd.Series) -> pd.Series:
        out = []
        for p in pages.tolist():
            root = tree(p)
            hit = next((h for h in root.all(HEADINGS) if keyword.lower() in flat(h.text()).lower()), None)
            out.append(" ".join(section(hit)) if hit is not None else None)
        return pd.Series(out, dtype=object)

    return find(html)
