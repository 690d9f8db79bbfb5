"""What a Parquet column chunk says about its values without being scanned: page headers and the dictionary page.

The headers of a chunk's pages are read one by one, each with a few bytes; they tell
whether every data page refers to the dictionary. If so, the dictionary's page alone gives
the chunk's values, and so its distinct ones and its extrema, whatever the footer's
statistics leave out. Page headers are Thrift structs in the compact protocol.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

DICTIONARY_PAGE, DATA_PAGE, DATA_PAGE_V2, INDEX_PAGE = 2, 0, 3, 1
BY_DICTIONARY = (2, 8)  # encodings of data pages that refer to the dictionary
HEADER = 1024  # bytes read at first for a page's header; one with long statistics is read again, longer


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _value(data: bytes, at: int, kind: int) -> tuple[object, int]:
    """A value of the compact protocol; structs become dicts by field number."""
    if kind in (1, 2):
        return kind == 1, at
    if kind == 3:
        return data[at], at + 1
    if kind in (4, 5, 6):
        n, at = _varint(data, at)
        return n >> 1 ^ -(n & 1), at
    if kind == 7:
        return struct.unpack_from("<d", data, at)[0], at + 8
    if kind == 8:
        n, at = _varint(data, at)
        if at + n > len(data):
            raise IndexError
        return data[at : at + n], at + n
    if kind in (9, 10):
        head = data[at]
        n, at = head >> 4, at + 1
        if n == 15:
            n, at = _varint(data, at)
        out = []
        for _ in range(n):
            x, at = _value(data, at, head & 15)
            out.append(x)
        return out, at
    if kind == 12:
        return thrift(data, at)
    raise ValueError(f"unknown kind {kind}")


def thrift(data: bytes, at: int = 0) -> tuple[dict[int, object], int]:
    """A struct of the compact protocol by field number, and where it ends. Data that end too early raise IndexError."""
    out: dict[int, object] = {}
    number = 0
    while True:
        head = data[at]
        at += 1
        if head == 0:
            return out, at
        if head >> 4:
            number += head >> 4
        else:
            n, at = _varint(data, at)
            number = n >> 1 ^ -(n & 1)
        out[number], at = _value(data, at, head & 15)


@dataclass
class ChunkDictionary:
    complete: bool  # whether every data page refers to the dictionary, so that its values are all there are
    values: list  # of the dictionary page; none if it is not complete
    bytes_read: int


def _header(file, at: int, end: int) -> tuple[dict[int, object], int, int]:
    size = HEADER
    while True:
        file.seek(at)
        data = file.read(min(size, end - at))
        try:
            fields, used = thrift(data)
            return fields, used, len(data)
        except (IndexError, struct.error):
            if size >= end - at:
                raise ValueError("a page's header does not end in its chunk") from None
            size *= 8


def _plain(data: bytes, kind: str, n: int) -> list | None:
    """Values of a dictionary page, which are stored plainly; none for kinds that are not read here."""
    if kind == "BYTE_ARRAY":
        out, at = [], 0
        for _ in range(n):
            (size,) = struct.unpack_from("<I", data, at)
            out.append(data[at + 4 : at + 4 + size])
            at += 4 + size
        return out
    form = {"INT32": "i", "INT64": "q", "FLOAT": "f", "DOUBLE": "d"}.get(kind)
    return list(struct.unpack_from(f"<{n}{form}", data)) if form else None


def chunk_dictionary(file, column) -> ChunkDictionary:
    """The dictionary of a column chunk (its metadata by pyarrow), read from an open file by page headers and one page."""
    import pyarrow as pa

    if not column.has_dictionary_page or column.dictionary_page_offset is None:
        return ChunkDictionary(False, [], 0)
    at = column.dictionary_page_offset
    end = at + column.total_compressed_size
    read, left, dictionary = 0, column.num_values, None
    while left > 0 and at < end:
        fields, used, n = _header(file, at, end)
        read += n
        kind, size, packed = fields[1], fields[2], fields[3]
        if kind == DICTIONARY_PAGE:
            file.seek(at + used)
            page = file.read(packed)
            read += packed
            if column.compression != "UNCOMPRESSED":
                page = pa.Codec({"LZ4": "lz4_raw", "LZ4_RAW": "lz4_raw"}.get(column.compression, column.compression.lower())).decompress(page, decompressed_size=size).to_pybytes()
            dictionary = _plain(page, column.physical_type, fields[7][1])
            if dictionary is None:
                return ChunkDictionary(False, [], read)
        elif kind in (DATA_PAGE, DATA_PAGE_V2):
            inner = fields[5] if kind == DATA_PAGE else fields[8]
            if inner[2 if kind == DATA_PAGE else 4] not in BY_DICTIONARY:
                return ChunkDictionary(False, [], read)  # the writer fell back to plain values
            left -= inner[1]
        at += used + packed
    return ChunkDictionary(left <= 0 and dictionary is not None, dictionary or [], read)
