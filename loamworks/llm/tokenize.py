"""Token ids of whole texts by a public byte-level BPE tokenizer (problem 6).

Encoding is a monoid tree reduction. A text is halved until its pieces are short,
the pieces are encoded, and neighbours are joined by re-encoding a window around
their border. The window grows on either side until it ends at a cut that provably
separates tokens: the tokenizer's splitting pattern has no branch that reads a
non-blank followed by a blank, and looks back at nothing, so no token spans a
place where a blank follows a non-blank and both sides are encoded independently
of each other. Tokens outside the window therefore stand.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
LEAF = 1024  # code points encoded at once
# Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def shipped(folder: str, name: str) -> str:
    """Where workers find a vocabulary: a file that the driver sent them, or the folder if the driver has none of it."""
    spark = SparkSession.getActiveSession()
    path = os.path.join(folder, f"{name}.tiktoken")
    if spark is None or not os.path.isfile(path):
        return folder
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_loamworks_vocabularies", {})
    if sent.setdefault(name, folder) != folder:  # another vocabulary of that name is on its way
        return folder
    if (name, "sent") not in sent:
        context.addFile(path)
        sent[name, "sent"] = folder
    return ""


@functools.lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """The tokenizer without special tokens, loaded once in each Python worker from the vocabulary file.

    An empty `folder` stands for the file that the driver sent.
    """
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken") if folder else SparkFiles.get(f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Piece:
    """Ids of text[lo:hi], in parts that are linked, not copied, when pieces are joined."""

    __slots__ = ("lo", "hi", "ids")

    def __init__(self, lo: int, hi: int, ids: list[int]) -> None:
        self.lo, self.hi, self.ids = lo, hi, ids


def _safe(text: str, p: int) -> bool:
    """Whether a blank follows a non-blank at p, under any reading of what is blank."""
    return text[p] in " \n\t\r" and not text[p - 1].isspace()


def _cut_before(text: str, lo: int, hi: int) -> int:
    """The last place p in (lo, hi) where a blank follows a non-blank; lo if there is none."""
    p = hi - 1
    while p > lo and not _safe(text, p):
        p -= 1
    return p


def _cut_after(text: str, lo: int, hi: int) -> int:
    """The first place p in (lo, hi) where a blank follows a non-blank; hi if there is none."""
    p = lo + 1
    while p < hi and not _safe(text, p):
        p += 1
    return p


def _join(text: str, a: _Piece, b: _Piece, encode) -> _Piece:
    """Ids of both pieces: what lies outside the window between the nearest safe cuts stays."""
    left, right = _cut_before(text, a.lo, a.hi), _cut_after(text, b.lo, b.hi)
    # Tokens of a before `left` and of b from `right` on are those of their own encodings, as a cut separates them there too.
    dropped = len(encode(text[left : a.hi]))
    used = len(encode(text[b.lo : right]))
    a.ids[len(a.ids) - dropped :] = encode(text[left:right])
    if used < len(b.ids):
        a.ids += b.ids[used:] if used else b.ids
    return _Piece(a.lo, b.hi, a.ids)


def encode_tree(text: str | None, encode, leaf: int = LEAF) -> list[int]:
    """Ids of a text, by halving, encoding and joining. A null or empty text gives an empty list."""
    if not text:
        return []
    if len(text) <= leaf:
        return encode(text)

    def of(lo: int, hi: int) -> _Piece:
        if hi - lo <= leaf:
            return _Piece(lo, hi, encode(text[lo:hi]))
        mid = (lo + hi) // 2
        return _join(text, of(lo, mid), of(mid, hi), encode)

    return of(0, len(text)).ids


def token_ids(column: Column | str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", leaf: int = LEAF) -> Column:
    """Array of token ids of a text column; empty for null and empty texts. Text that spells a special token is ordinary text."""

    folder = shipped(folder, name)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(folder, name).encode_ordinary
        for s in batches:
            yield pd.Series([np.array(encode_tree(t, encode, leaf), np.int32) for t in s.tolist()], index=s.index, dtype=object)

    return ids(column)


def token_count(column: Column | str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", leaf: int = LEAF) -> Column:
    """Number of tokens of a text column; 0 for null and empty texts."""

    folder = shipped(folder, name)

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(folder, name).encode_ordinary
        for s in batches:
            yield pd.Series([len(encode_tree(t, encode, leaf)) for t in s.tolist()], index=s.index, dtype="int64")

    return count(column)


def decoded(column: Column | str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Column:
    """Text of an array of token ids: the bytes of the tokens laid end to end; null for null."""

    folder = shipped(folder, name)

    @F.pandas_udf(T.StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = encoder(folder, name).decode_bytes
        for s in batches:
            yield pd.Series([None if x is None else decode([int(i) for i in x]).decode("utf-8", "replace") for x in s.tolist()], index=s.index, dtype=object)

    return text(column)


def encode_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`key` and `ids`, one row for each row of `documents`; rows aren't shuffled."""
    return documents.select(F.col(key), token_ids(F.col(text), **options).alias("ids"))
