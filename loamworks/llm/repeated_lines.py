"""Lines repeated across the pages of one site (problem 5).

The letters of a whole page, in the consistent form of `lookalike`, are cut into content-defined
chunks by a rolling hash; newlines play no part in it. Distinct pages are counted for each site and
run of chunks, a run being the fewest chunks that cover a line, and the counts are mapped back to lines:
runs on enough pages give all lines they cover, wherever else these stand. A chunk both of whose cuts
stand in one line, with their windows, depends on that line's letters alone, so a line that holds such
a chunk on too few pages is ruled out by it. What is left stands in surroundings that differ from page
to page; it is counted exactly, as whole lines, over the pages of its runs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamworks.llm.lookalike import LOOKALIKES, canonical_batch, site_and_page, slices
from loamworks.session import cut

PAGES = 8  # distinct pages of a site from which on a line counts as repeated
WINDOW = 16  # letters in the rolling hash
MEAN_CHUNK = 64  # letters between cuts, on average

_NOT_LETTERS = bytes(i for i in range(256) if not chr(i).isalpha() or i > 127)
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
# Case ties a capital drawn like a Latin one to its own small letter; so these small letters join the Latin ones.
# Small letters of other scripts by the Latin small letter of their capital.
_SMALL = {"b": "вβ", "e": "ε", "h": "нη", "i": "ιӏ", "k": "кκ", "m": "мμ", "n": "ν", "t": "тτ", "z": "ζ", "a": "α", "p": "ρ", "x": "χ", "y": "υ", "s": "ս"}
_FOLD = str.maketrans({x: a for a, xs in _SMALL.items() for x in xs} | {x: a.lower() for a, xs in LOOKALIKES.items() for x in xs if x.lower() == x})


def letter_streams(lines: list[str]) -> list[bytes]:
    """The letters of each line in the consistent form, case folded, as UTF-8; empty for lines without letters."""
    out = [b""] * len(lines)
    odd = []
    for i, line in enumerate(lines):
        if line.isascii():
            out[i] = line.lower().encode().translate(None, _NOT_LETTERS)
        else:
            odd.append(i)
    for i, form in zip(odd, canonical_batch([lines[i] for i in odd], more=False)[0]):
        out[i] = "".join(_LETTERS.findall(form.casefold())).translate(_FOLD).encode()
    return out


def chunk_cuts(streams: list[bytes], mean: int = MEAN_CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Places of all cuts in the streams laid end to end whose window lies in one stream, and that stream's number.

    A cut follows each place where the hash of the last WINDOW letters is 0 modulo `mean`: the same letters
    are cut the same way wherever they stand. Windows that reach over a stream's start depend on what stands before.
    """
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(streams), np.uint8)
    if data.size < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = np.repeat(np.arange(sizes.size), sizes)
    with np.errstate(over="ignore"):
        rolled = np.zeros(data.size - WINDOW + 1, np.uint64)
        for k in range(WINDOW):  # Horner's rule over all windows at once
            rolled = rolled * _BASE + data[k : data.size - WINDOW + 1 + k]
        rolled ^= rolled >> np.uint64(31)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
    hit = np.flatnonzero((rolled >> np.uint64(32)) % np.uint64(mean) == 0) + WINDOW  # the cut stands after the window
    hit = hit[hit - starts[line[hit - 1]] >= WINDOW]
    return hit, line[hit - 1]


def _hash(data: bytes) -> tuple[int, int]:
    """96 bits of a digest, as a long and an int."""
    digest = hashlib.blake2b(data, digest_size=12).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def line_hashes(lines: list[str], mean: int = MEAN_CHUNK) -> list[tuple[tuple[int, int], list[tuple[int, int]]] | None]:
    """Hash of each line's letters and of the chunks inside it; None for lines without letters."""
    return _stream_hashes(letter_streams(lines), mean)


def _stream_hashes(streams: list[bytes], mean: int) -> list[tuple[tuple[int, int], list[tuple[int, int]]] | None]:
    out = [(_hash(s), []) if s else None for s in streams]
    cuts, of = chunk_cuts(streams, mean)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    same = np.flatnonzero(of[1:] == of[:-1])  # between two cuts of one line lies a chunk
    for i, a, b in zip(of[same].tolist(), (cuts[same] - begins[of[same]]).tolist(), (cuts[same + 1] - begins[of[same]]).tolist()):
        out[i][1].append(_hash(streams[i][a:b]))
    return out


def split_lines(text: str) -> list[str]:
    """Lines of a text: a line feed ends a line, a carriage return before it belongs to the line's end."""
    lines = text.split("\n")
    return [x[:-1] if x.endswith("\r") and k < len(lines) - 1 else x for k, x in enumerate(lines)] if "\r" in text else lines


def page_runs(pages: list[list[bytes]], mean: int = MEAN_CHUNK) -> list[tuple[int, int, int, tuple[int, int]]]:
    """Page, first and last line (past it) and hash of each run of chunks that covers lines; lines are given by their letters.

    Pages are cut as wholes, and begin and end with a cut. A run reaches from the last cut before a line to the first one
    after it; lines with the same run come together. The hash is that of the run's letters and of the places of these
    lines in it, so that it stands for the same lines on every page. Lines without letters must be left out.
    """
    sizes = np.fromiter((len(s) for lines in pages for s in lines), np.int64)
    if not sizes.size:
        return []
    edges = np.concatenate([[0], np.cumsum(sizes)])  # each line ends where the next begins
    starts, ends = edges[:-1], edges[1:]
    streams = [b"".join(lines) for lines in pages]
    counts = np.fromiter(map(len, pages), np.int64, len(pages))
    page_ends = np.cumsum(np.fromiter(map(len, streams), np.int64, len(streams)))
    bounds = np.unique(np.concatenate([chunk_cuts(streams, mean)[0], [0], page_ends]))
    left, right = bounds[np.searchsorted(bounds, starts, "right") - 1], bounds[np.searchsorted(bounds, ends)]
    first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    last = np.append(first[1:], sizes.size)
    page = np.repeat(np.arange(len(pages)), counts)[first]
    line = (np.cumsum(counts) - counts).tolist()  # number of each page's first line
    data, out = b"".join(streams), []
    for p, i, j, a, b in zip(page.tolist(), first.tolist(), last.tolist(), left[first].tolist(), right[first].tolist()):
        out.append((p, i - line[p], j - line[p], _hash(data[a:b] + b"\0" + (edges[i : j + 1] - a).tobytes())))
    return out


_RUN, _LONG, _INNER = 0, 1, 2  # a run of lines without inner chunks, the run of a line with them, a chunk inside a line
_ROWS = "rec long, page long, kind int, chunk long, chunk_b int, line_no array<int>, line array<long>, line_b array<int>"


def _exploder(mean: int):
    """From (rec, site, page, text) to a row for each run of chunks, with the lines it covers, and for each chunk inside a line."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch.to_pandas(), "text")):
            texts = [split_lines(t) for t in b["text"]]
            distinct = list(dict.fromkeys(x for lines in texts for x in lines))
            streams = letter_streams(distinct)
            known = dict(zip(distinct, zip(streams, _stream_hashes(streams, mean))))
            lettered = [[(k, *known[x]) for k, x in enumerate(lines) if known[x][0]] for lines in texts]
            rows, held = [], []  # (text, kind, hash, number of lines); (line's number, its hash)
            for i, first, last, run in page_runs([[s for _, s, _ in lines] for lines in lettered], mean):
                own = lettered[i][first:last]
                inner = own[0][2][1]  # a line with inner chunks has a run of its own
                rows.append((i, _LONG if inner else _RUN, *run, len(own)))
                held += [(k, *h[0]) for k, _, h in own]
                for chunk in dict.fromkeys(inner):
                    rows.append((i, _INNER, *chunk, 1))
                    held.append((own[0][0], *own[0][2][0]))
            at, of = np.array(rows, np.int64).reshape(-1, 5), np.array(held, np.int64).reshape(-1, 3)
            site = b["site"].to_numpy(np.int64)[at[:, 0]]
            offsets = pa.array(np.concatenate([[0], np.cumsum(at[:, 4])]).astype(np.int32))
            many = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(b["rec"].to_numpy(np.int64)[at[:, 0]]), pa.array(b["page"].to_numpy(np.int64)[at[:, 0]]), pa.array(at[:, 1].astype(np.int32)),
                    pa.array(at[:, 2] ^ site), pa.array(at[:, 3].astype(np.int32)),
                    many(of[:, 0].astype(np.int32)), many(of[:, 1] ^ np.repeat(site, at[:, 4])), many(of[:, 2].astype(np.int32)),
                ],
                ["rec", "page", "kind", "chunk", "chunk_b", "line_no", "line", "line_b"],
            )

    return explode


def _counted(rows: DataFrame, pages: int) -> DataFrame:
    """Rows of at most `pages` pages of each chunk, with `often`: whether there are as many. Limited to these pages before the shuffle."""
    same = Window.partitionBy("chunk", "chunk_b")
    first = rows.select("page", "chunk", "chunk_b", "line", "line_b").withColumn("n", F.dense_rank().over(same.orderBy("page"))).filter(F.col("n") <= pages)
    return first.withColumn("often", F.max("n").over(same) >= pages)


def _each(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each line of a row's arrays."""
    arrays = [c for c in ("line_no", "line", "line_b") if c in rows.columns]
    return rows.select(*columns, F.explode(F.arrays_zip(*arrays)).alias("_l")).select(*columns, "_l.*")


def line_runs(fetches: DataFrame, key: str, url: str, text: str, mean: int = MEAN_CHUNK) -> DataFrame:
    """Runs of chunks with the lines they cover, and chunks inside lines: `_ROWS`, hashes mixed with the site's."""
    site, page = site_and_page(F.col(url))
    base = fetches.select(F.col(key).cast("long").alias("rec"), F.xxhash64(site).alias("site"), F.xxhash64(page).alias("page"), F.col(text).alias("text")).filter(F.col(url).isNotNull() & (F.length("text") > 0))
    return base.mapInArrow(_exploder(mean), _ROWS)


def ruled_out(rows: DataFrame, pages: int = PAGES) -> DataFrame:
    """line, line_b of the lines that hold a chunk on fewer than `pages` pages of the site."""
    return _each(_counted(rows.filter(F.col("kind") == _INNER), pages).filter(~F.col("often"))).distinct()


def found_lines(rows: DataFrame, pages: int = PAGES) -> DataFrame:
    """line, line_b of the lines on `pages` or more pages of their site, by_run: whether a run of chunks on as many gave them.

    Lines that are ruled out leave first. The lines of runs on fewer pages are counted on the pages of these runs.
    """
    out = ruled_out(rows, pages).select(F.col("line").alias("_a"), F.col("line_b").alias("_b"))
    long = rows.filter(F.col("kind") == _LONG).withColumn("_a", F.col("line")[0]).withColumn("_b", F.col("line_b")[0])
    runs = _counted(rows.filter(F.col("kind") == _RUN).unionByName(long.join(out, ["_a", "_b"], "left_anti").select(rows.columns)), pages)
    seen = _each(runs.withColumn("page", F.when(~F.col("often"), F.col("page"))), "page").distinct()  # no page: given by a run
    counts = seen.groupBy("line", "line_b").agg(F.count("page").alias("n"), (F.count(F.lit(1)) > F.count("page")).alias("by_run"))
    return counts.filter(F.col("by_run") | (F.col("n") >= pages)).select("line", "line_b", "by_run")


def repeated_lines(fetches: DataFrame, key: str = "result_id", url: str = "url", text: str = "raw_text", pages: int = PAGES, mean: int = MEAN_CHUNK) -> DataFrame:
    """key and line_no of each line that stands on `pages` or more distinct pages of its site.

    Lines are the same if their letters are. Lines without letters, null and empty texts and rows with a
    null url give no line. Several fetches of a page count as one page. A line that stands twice on a page
    is found twice. Sites may be of any size: chunks are counted by (site, chunk), of which each task hands on
    `pages` pages at most, and lines left by (site, line), made distinct with sums before each shuffle. Only
    the fetches of these few pages that share a chunk meet in one task.
    Keys have 96 bits, of which 64 are mixed with the site's.
    """
    rows = cut(line_runs(fetches, key, url, text, mean))  # the texts are read once: hashes are kept and used again
    lines = _each(rows.filter(F.col("kind") != _INNER), "rec")
    return lines.join(found_lines(rows, pages), ["line", "line_b"], "left_semi").select(F.col("rec").alias(key), "line_no")


def without_lines(fetches: DataFrame, lines: DataFrame, key: str = "result_id", text: str = "raw_text", out: str = "kept_text") -> DataFrame:
    """Each text without the given lines (key, line_no), all else as stored; null texts stay null."""
    gone = lines.groupBy(F.col(key).alias("_k")).agg(F.collect_set("line_no").alias("_gone"))  # at most a text's own lines
    rows = fetches.select(F.struct(*[F.col(f"`{c}`") for c in fetches.columns]).alias("_r"))  # so that no column's name can clash
    parts = F.split(F.col(f"_r.`{text}`"), "\n")
    # the numbers of lines that stay, by one pass over a set, whatever the number of lines
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.coalesce("_gone", F.array().cast("array<int>")))
    keep = F.when(F.col(f"_r.`{text}`").isNotNull(), F.array_join(F.transform(left, lambda i: F.element_at(parts, i + 1)), "\n"))
    joined = rows.join(gone, F.col(f"_r.`{key}`") == F.col("_k"), "left")
    return joined.select(*[F.col(f"_r.`{c}`").alias(c) for c in fetches.columns if c != out], keep.alias(out))
