"""One consistent form for texts that look the same (problem 4).

A batch of texts is exploded to positioned code points held in flat arrays. A
decomposition and look-alike table (a fixed function of Unicode, so its size is
bounded by the code space) is looked up for all of them at once, combining marks
are ordered by class and recomposed, and the strings are rebuilt.

What stays visible: case, accents, spelling, number of blanks. What does not:
the kind of blank, invisible signs, the width of letters, the script a letter is
taken from, a carriage return before a line feed.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamworks.session import cut

# Letters of other scripts that are drawn like a Latin letter, by that letter.
LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν",
    "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "УҮΥ", "Z": "Ζ",
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ",
    "p": "рⲣ", "q": "ԛզ", "s": "ѕ", "u": "ս", "v": "ѵ", "w": "ԝ", "x": "х", "y": "уү",
}

# Further letters to which Unicode's table of confusables gives one Latin letter, by script: small Greek letters,
# whose capitals are drawn like another letter, and rare letters and scripts. Left out are those drawn plainly apart
# (Greek sigma, Cyrillic ghe and soft sign).
LOOKALIKES_MORE = {
    "Greek": ("αγινρυϜͿϺ", "ayivpuFJM"),
    "Cyrillic": ("ѡѴҽꙇ", "wVei"),
    "Armenian": ("Սագռք", "Uwqnf"),
    "Cherokee": ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴꭵꮁꮃꮓꮩꮪꮯ", "DRTiYAJEWMHYGhZbRWSVSLCPKdGBirwzvsc"),
    "Coptic": ("ⲅⲎⲒⲔⲘⲚⲞⲟⲢⲤⲥⲦⲨⲬⳐ", "rHIKMNOoPCcTYXL"),
    "Lisu": ("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU"),
}

_SPACE = 0x110000
_KINDS = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>"}
_KEEP = set("ſ")  # the long s is drawn unlike any other letter


def _expansion(cp: int, look: dict[str, str]) -> str:
    """What one code point becomes before marks are ordered and recomposed."""
    ch = chr(cp)
    category = unicodedata.category(ch)
    if ch in "\n\r":
        return ch
    if ch == "\t" or category == "Zs":
        return " "
    if category in ("Cf", "Cc") or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D):
        return ""
    if 0xAC00 <= cp <= 0xD7A3 or ch in _KEEP:
        return ch
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0].startswith("<"):
        if parts[0] not in _KINDS or parts[1] == "0020":
            return ch
        parts = parts[1:]
    if not parts:
        return look.get(ch, ch)
    return "".join(_expansion(int(p, 16), look) for p in parts)


class _Tables:
    """Arrays over the code space: length and place of each expansion, combining class, and the pairs that compose."""

    def __init__(self, more: bool) -> None:
        look = {x: latin for latin, others in LOOKALIKES.items() for x in others}
        for letters, latin in LOOKALIKES_MORE.values() if more else ():
            look |= dict(zip(letters, latin, strict=True))
        self.length = np.ones(_SPACE, np.uint8)
        self.start = np.arange(_SPACE, dtype=np.int32)
        self.mark = np.zeros(_SPACE, np.uint8)
        extra: list[int] = []
        pairs: list[tuple[int, int]] = []
        for cp in [*range(0x80), *range(0x80, 0x32000), *range(0xE0000, 0xE0200)]:
            ch = chr(cp)
            if 0xD800 <= cp <= 0xDFFF:
                continue
            self.mark[cp] = unicodedata.combining(ch)
            out = _expansion(cp, look)
            if out != ch:
                self.length[cp] = len(out)
                self.start[cp] = _SPACE + len(extra)
                extra += map(ord, out)
            split = unicodedata.decomposition(ch).split()
            if len(split) == 2 and split[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch and not 0xAC00 <= cp <= 0xD7A3:
                pairs.append((int(split[0], 16) << 21 | int(split[1], 16), cp))
        pairs.sort()
        self.flat = np.concatenate([np.arange(_SPACE, dtype=np.uint32), np.array(extra, np.uint32)])
        self.pair = np.array([p for p, _ in pairs], np.int64)
        self.composed = np.array([c for _, c in pairs], np.uint32)


@functools.lru_cache(maxsize=2)
def _tables(more: bool) -> _Tables:
    return _Tables(more)


#: A text without these needs no work: only printable ASCII and line feeds.
_SPECIAL = re.compile(r"[^\n\x20-\x7e]")
_JAMO = re.compile("[ᄀ-ᇿ]")


def _order_and_compose(codes: np.ndarray, source: np.ndarray, tables: _Tables) -> tuple[np.ndarray, np.ndarray]:
    mark = tables.mark[codes]
    at = np.flatnonzero(mark)
    if not at.size:
        return codes, source
    run = np.cumsum(mark == 0)  # all marks after one starter share its number
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]) | (at == 0))
    order = at[np.lexsort((at, mark[at], run[at]))]
    codes = codes.copy()
    codes[at], source = codes[order], source.copy()
    source[at] = source[order]
    mark = tables.mark[codes]
    rank = np.arange(at.size) - np.repeat(first, np.diff(np.append(first, at.size)))
    base = at - rank - 1  # the starter's place; -1 or a foreign text's end is excluded below
    keep = np.ones(codes.size, bool)
    last = np.zeros(codes.size, np.uint8)  # class of the last mark left beside each starter
    by_rank = np.argsort(rank, kind="stable")
    cuts = np.searchsorted(rank[by_rank], np.arange(rank.max() + 2))
    for k in range(len(cuts) - 1):
        which = by_rank[cuts[k] : cuts[k + 1]]
        which = which[base[which] >= 0]
        b, m = base[which], at[which]
        key = codes[b].astype(np.int64) << 21 | codes[m].astype(np.int64)
        found = np.minimum(np.searchsorted(tables.pair, key), tables.pair.size - 1)
        good = (tables.pair[found] == key) & (last[b] < mark[m])
        codes[b[good]] = tables.composed[found[good]]
        keep[m[good]] = False
        last[b[~good]] = mark[m[~good]]
    return codes[keep], source[keep]


def canonical_batch(texts: Sequence[str | None], places: bool = False, more: bool = True) -> tuple[list[str | None], list[np.ndarray | None]]:
    """Consistent form of each text; with `places`, also the stored position of each of its characters (None: the same).

    Without `more`, only letters whose capitals and small letters are drawn like those of one Latin letter are taken
    as Latin ones, so that the form goes together with ignoring case.
    """
    out: list[str | None] = list(texts)
    where: list[np.ndarray | None] = [None] * len(out)
    slow = [i for i, t in enumerate(out) if t and (not t.isascii() or _SPECIAL.search(t))]
    tables = _tables(more) if slow else None
    step = 1_000_000  # code points worked on at once
    begin = 0
    while begin < len(slow):
        end, total = begin, 0
        while end < len(slow) and (end == begin or total + len(out[slow[end]]) + 1 <= step):
            total += len(out[slow[end]]) + 1
            end += 1
        chunk, begin = slow[begin:end], end
        # a line feed ends each text, so that no mark joins the text before
        codes = np.frombuffer("".join(out[i] + "\n" for i in chunk).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.cumsum([len(out[i]) + 1 for i in chunk])
        lengths = tables.length[codes].astype(np.int64)
        source = np.repeat(np.arange(codes.size), lengths)
        inside = np.arange(source.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        new = tables.flat[tables.start[codes[source]] + inside]
        if (returns := new == 13).any():  # carriage returns before a line feed go, but for a text's own last ones
            others = np.flatnonzero(~returns)
            after = others[np.searchsorted(others, np.flatnonzero(returns))]
            ends_text = np.isin(source[after], bounds - 1)
            keep = np.ones(new.size, bool)
            keep[np.flatnonzero(returns)] = (new[after] != 10) | ends_text
            new, source = new[keep], source[keep]
        new, source = _order_and_compose(new, source, tables)
        ends = np.searchsorted(source, bounds - 1)  # place of each text's closing line feed
        text = new.tobytes().decode("utf-32-le", "surrogatepass")
        left = 0
        for k, i in enumerate(chunk):
            piece = text[left : ends[k]]
            if _JAMO.search(piece) and not places:
                piece = unicodedata.normalize("NFC", piece)
            if places:
                where[i] = source[left : ends[k]] - (bounds[k] - len(out[i]) - 1)
            out[i], left = piece, int(ends[k]) + 1
    return out, where


def canonical_text(text: str | None) -> str | None:
    """Consistent form of one text; null stays null."""
    return canonical_batch([text])[0][0]


def canonical(column: Column | str) -> Column:
    """Consistent form of a text column."""

    @F.pandas_udf(T.StringType())
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(canonical_batch(s.tolist())[0], dtype=object)

    return form(column)


def site_and_page(url: Column) -> tuple[Column, Column]:
    """Site (host in lower case without port and leading www.) and page (site and path without closing slash) of a url."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":[0-9]*$", "")
    site = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?#]*([^?#]*)", 1), r"/+$", "")
    return site, F.concat(site, path)


_DIGESTS = T.StructType([T.StructField("form", T.BinaryType()), T.StructField("stored", T.BinaryType())])


def slices(frame: pd.DataFrame, column: str, most: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """A batch in slices of at most `most` characters of a text column (a longer text is a slice of its own)."""
    sizes = np.cumsum([len(t) if t else 0 for t in frame[column]])
    begin = 0
    while begin < len(frame):
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield frame.iloc[begin:end]
        begin = end


def _digests(column: Column, blank_is_null: bool) -> Column:
    """128-bit digests of a text's consistent form and of its stored form; null for a null (or blank) text."""

    @F.pandas_udf(_DIGESTS)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        short = functools.partial(hashlib.blake2b, digest_size=16)
        for s in batches:
            stored = s.tolist()
            form = canonical_batch(stored)[0]
            skip = [t is None or (blank_is_null and not t.strip()) for t in form]
            yield pd.DataFrame({
                "form": [None if no else short(t.encode("utf-8", "surrogatepass")).digest() for t, no in zip(form, skip)],
                "stored": [None if no else short(t.encode("utf-8", "surrogatepass")).digest() for t, no in zip(stored, skip)],
            })

    return digest(column)


def _looks(df: DataFrame, text: str, key: str, group: list[Column], blank_is_null: bool) -> DataFrame:
    """look (digest of group and consistent form), stored (digest of the stored text) and id of each row that takes part."""
    whole = F.concat_ws("\x1f", *[c.cast("string") for c in group])
    base = df.filter(F.array_min(F.array(*[c.isNotNull().cast("int") for c in group])) == 1).select(whole.alias("group"), F.col(key).cast("long").alias("id"), _digests(F.col(text), blank_is_null).alias("d")).filter("d.form IS NOT NULL")
    return base.select(F.unhex(F.md5(F.concat(F.col("group").cast("binary"), F.lit(b"\x1e"), "d.form"))).alias("look"), F.col("d.stored").alias("stored"), "id")


def look_classes(df: DataFrame, text: str, key: str, group: list[Column], field: str, blank_is_null: bool = True) -> DataFrame:
    """field, id, class_id (the least id of the rows of its group that look the same), forms (stored forms in the class), rows.

    Only classes of several stored forms; a row of a class for each of its members, so that its size is that of the
    classes, whatever the number of pairs. Counts are made distinct by key with sums before the shuffle.
    """
    base = cut(_looks(df, text, key, group, blank_is_null))
    forms = base.groupBy("look", "stored").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = forms.groupBy("look").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("rows"), F.min("least").alias("class_id")).filter("forms > 1")
    return base.join(classes, "look").select(F.lit(field).alias("field"), "id", "class_id", "forms", "rows")


def same_looking_pairs(df: DataFrame, text: str, key: str, group: list[Column], field: str, blank_is_null: bool = True) -> DataFrame:
    """Pairs of rows of one group whose texts are stored differently yet look the same.

    Null texts take part in no pair; nor do blank ones with `blank_is_null`. Rows with a
    null in `group` form no group. Rows stored alike are joined as one class first, so equal
    copies never meet each other; a pair of classes is expanded to its members last.
    Result: field, id_a < id_b, every pair once. An empty table gives an empty result.
    """
    # the texts are read once; digests and numbers of rows are kept for the joins
    base = cut(_looks(df, text, key, group, blank_is_null))
    # groups in which at least two stored forms occur; partial min/max run before the shuffle
    mixed = base.groupBy("look").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).filter("lo <> hi").select("look")
    rows = base.join(mixed, "look", "left_semi")
    classes = rows.select("look", "stored").distinct()
    a, b = classes.alias("a"), classes.alias("b")
    pairs = a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.stored") < F.col("b.stored"))).select(F.col("a.look").alias("look"), F.col("a.stored").alias("sa"), F.col("b.stored").alias("sb"))
    left = rows.select("look", F.col("stored").alias("sa"), F.col("id").alias("ia"))
    right = rows.select("look", F.col("stored").alias("sb"), F.col("id").alias("ib"))
    both = pairs.join(left, ["look", "sa"]).join(right, ["look", "sb"])
    return both.select(F.lit(field).alias("field"), F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
