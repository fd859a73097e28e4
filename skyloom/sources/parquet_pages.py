"""What a parquet file's footer, page headers and dictionary pages say of its chunks.

Written from the public format description: page headers are Thrift compact
structs; a dictionary page holds the distinct values of a column chunk, which are all
of its values only if every data page of the chunk is dictionary-encoded.
"""

from __future__ import annotations

import math
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq

# Fixed values of the parquet format.
_DICTIONARY_PAGE, _DATA_PAGES = 2, (0, 3)
_DICTIONARY_ENCODINGS = (2, 8)
_PLAIN = {"INT32": "<i4", "INT64": "<i8", "FLOAT": "<f4", "DOUBLE": "<f8"}
_CODECS = {"SNAPPY": "snappy", "ZSTD": "zstd", "GZIP": "gzip", "BROTLI": "brotli", "LZ4_RAW": "lz4_raw"}


class _Thrift:
    """A reader of Thrift compact structs into {field number: value}."""

    def __init__(self, buf: bytes):
        self.buf, self.at = buf, 0

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.buf[self.at]
            self.at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            self.at += 1
            return self.buf[self.at - 1]
        if kind in (4, 5, 6):
            return self.zigzag()
        if kind == 7:
            self.at += 8
            return None
        if kind == 8:
            n = self.varint()
            self.at += n
            if self.at > len(self.buf):
                raise IndexError
            return None
        if kind in (9, 10):
            head = self.buf[self.at]
            self.at += 1
            n = head >> 4 if head >> 4 != 15 else self.varint()
            if head & 15 in (1, 2):  # booleans of a list take a byte each
                self.at += n
                return None
            return [self.value(head & 15) for _ in range(n)]
        if kind == 12:
            return self.struct()
        raise ValueError(f"thrift type {kind}")

    def struct(self) -> dict:
        out, number = {}, 0
        while True:
            head = self.buf[self.at]
            self.at += 1
            if head == 0:
                return out
            number = number + (head >> 4) if head >> 4 else self.zigzag()
            out[number] = self.value(head & 15)


def _header(f, at: int, end: int) -> tuple[dict, int]:
    """The page header at an offset and its length."""
    size = 256
    while True:
        f.seek(at)
        buf = f.read(min(size, end - at))
        try:
            t = _Thrift(buf)
            return t.struct(), t.at
        except IndexError:
            if size >= end - at:
                raise
            size *= 8


def complete_dictionary(f, chunk) -> np.ndarray | None:
    """Distinct non-null values of a numeric column chunk, if its dictionary has all."""
    kind = _PLAIN.get(chunk.physical_type)
    if kind is None or chunk.dictionary_page_offset is None or chunk.compression not in ("UNCOMPRESSED", *_CODECS):
        return None
    at = min(chunk.dictionary_page_offset, chunk.data_page_offset)
    end, values = at + chunk.total_compressed_size, None
    while at < end:
        h, n = _header(f, at, end)
        size = h[3]
        if h[1] == _DICTIONARY_PAGE:
            f.seek(at + n)
            raw = f.read(size)
            if chunk.compression != "UNCOMPRESSED":
                raw = pa.Codec(_CODECS[chunk.compression]).decompress(raw, h[2]).to_pybytes()
            values = np.frombuffer(raw, kind, count=h[7][1])
        elif h[1] in _DATA_PAGES and (h.get(5) or {}).get(2, (h.get(8) or {}).get(4)) not in _DICTIONARY_ENCODINGS:
            return None
        at += n + size
    return values


def _open(uri: str):
    if uri.startswith("file:"):
        return pa.OSFile("/" + unquote(uri[5:]).lstrip("/"), "rb")
    if uri.startswith("/"):
        return pa.OSFile(uri, "rb")
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def chunk_facts(uri: str, columns: list[str], load: str, dictionaries: str = "all") -> list[tuple]:
    """Rows of ``operators.profile.CHUNK`` for one file.

    dictionaries: ``all`` decodes every complete dictionary; ``constant`` only those
    of chunks whose footer extrema are equal, which is enough to tell constant chunks.
    """
    out = []
    with _open(uri) as f:
        meta = pq.ParquetFile(f).metadata
        place = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            rg = meta.row_group(g)
            key = (None, None, None)
            if load in place:
                s = rg.column(place[load]).statistics
                if s is not None and s.has_min_max and s.has_null_count:
                    key = (int(s.min), int(s.max), int(s.null_count))
            for c in columns:
                if c not in place:
                    continue
                chunk = rg.column(place[c])
                s = chunk.statistics
                nulls = int(s.null_count) if s is not None and s.has_null_count else None
                lo = hi = None
                exact, values = False, None
                if s is not None and s.has_min_max and chunk.physical_type in _PLAIN:
                    lo, hi = _number(s.min), _number(s.max)
                if dictionaries == "all" or lo is not None and lo == hi:
                    values = complete_dictionary(f, chunk)
                if nulls is not None:
                    if nulls == rg.num_rows:
                        exact = True
                    elif lo is not None and hi is not None:
                        floating = chunk.physical_type in ("FLOAT", "DOUBLE")
                        exact = not floating or values is not None and not np.isnan(values).any()
                seen = None
                if values is not None:
                    v = np.unique(values.astype("f8"))
                    seen = v[~np.isnan(v)].tolist()
                out.append((uri, g, *key, c, rg.num_rows, nulls, lo, hi, exact, seen))
    return out


def _number(x) -> float | None:
    try:
        v = float(x)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(v) else v
