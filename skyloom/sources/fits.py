"""Reading and writing FITS files with numpy, from the public standard.

Images of all integer and floating types with BSCALE, BZERO and BLANK, and binary tables
of fixed-size numeric columns; compressed images are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BLOCK, CARD = 2880, 80
# Fixed values of the standard: BITPIX and table column codes as big-endian types.
_IMAGE = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
_COLUMN = {"B": ">u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}


@dataclass
class Hdu:
    """One header-data unit: header values by keyword, and an array or table (or None)."""

    header: dict = field(default_factory=dict)
    data: object = None

    @property
    def name(self) -> str:
        return str(self.header.get("EXTNAME", "")).strip().upper()


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        out, i = [], 1
        while i < len(text):
            if text[i] == "'":
                if text[i + 1 : i + 2] == "'":
                    out.append("'")
                    i += 2
                    continue
                break
            out.append(text[i])
            i += 1
        return "".join(out).rstrip()
    text = text.split("/", 1)[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text or None


def _header(raw: bytes, at: int) -> tuple[dict, int]:
    header: dict = {}
    while True:
        block = raw[at : at + BLOCK]
        if len(block) < BLOCK:
            raise ValueError("a FITS header breaks off")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return header, at
            if card[8:10] == "= ":
                header.setdefault(key, _value(card[10:]))


def read(raw: bytes, names: set[str] | None = None) -> list[Hdu]:
    """All units of a file; data only of extensions in ``names`` where those are given."""
    out, at = [], 0
    while at + BLOCK <= len(raw):
        h, at = _header(raw, at)
        shape = [int(h[f"NAXIS{i}"]) for i in range(int(h.get("NAXIS", 0)), 0, -1)]
        width = abs(int(h.get("BITPIX", 8))) // 8
        n = int(np.prod(shape)) if shape else 0
        size = width * int(h.get("GCOUNT", 1)) * (int(h.get("PCOUNT", 0)) + n) if shape else 0
        if at + size > len(raw):
            raise ValueError("FITS data break off")
        hdu = Hdu(h)
        if size and (names is None or hdu.name in names):
            body = raw[at : at + size]
            hdu.data = _table(h, body) if str(h.get("XTENSION", "")).strip() == "BINTABLE" else _image(h, body, shape)
        out.append(hdu)
        at += -(-size // BLOCK) * BLOCK
    return out


def _image(h: dict, body: bytes, shape: list[int]) -> np.ndarray:
    v = np.frombuffer(body, _IMAGE[int(h["BITPIX"])], int(np.prod(shape))).reshape(shape)
    scale, zero = float(h.get("BSCALE", 1)), float(h.get("BZERO", 0))
    blank = h.get("BLANK")
    if scale == 1 and zero == 0 and blank is None:
        return v.astype(v.dtype.newbyteorder("="))
    out = v.astype("f8") * scale + zero
    if blank is not None and int(h["BITPIX"]) > 0:
        out[v == blank] = np.nan
    elif scale == 1 and zero.is_integer() and int(h["BITPIX"]) > 0:
        out = out.astype("i8")
    return out


def _table(h: dict, body: bytes) -> dict[str, np.ndarray]:
    fields = []
    for i in range(1, int(h["TFIELDS"]) + 1):
        form = str(h[f"TFORM{i}"]).strip()
        code = form.lstrip("0123456789")[:1]
        repeat = int(form[: len(form) - len(form.lstrip("0123456789"))] or 1)
        if code not in _COLUMN:
            raise ValueError(f"column format {form} is not supported")
        kind = f"S{repeat}" if code == "A" else (_COLUMN[code], (repeat,) if repeat != 1 else ())
        fields.append((f"c{i}", kind) if code == "A" else (f"c{i}", *kind))
    rows = np.frombuffer(body, np.dtype(fields), int(h["NAXIS2"]))
    out = {}
    for i in range(1, int(h["TFIELDS"]) + 1):
        v = rows[f"c{i}"]
        dim = h.get(f"TDIM{i}")
        if dim:
            v = v.reshape(len(rows), *[int(x) for x in str(dim).strip("() ").split(",")][::-1])
        out[str(h.get(f"TTYPE{i}", f"col{i}")).strip()] = v if v.dtype.kind == "S" else v.astype(v.dtype.newbyteorder("="))
    return out


def _card(key: str, value) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, str):
        text = "'" + value.replace("'", "''").ljust(8) + "'"
    elif isinstance(value, (float, np.floating)):
        text = f"{float(value)!r:>20}".upper()
    else:
        text = f"{int(value):>20}"
    return f"{key:<8}= {text}".ljust(CARD)[:CARD].encode()


def write(hdus: list[Hdu]) -> bytes:
    """The bytes of a file; the first unit is the primary one. Tables are dicts of arrays."""
    out = []
    for k, hdu in enumerate(hdus):
        d = hdu.data
        first = [("SIMPLE", True)] if k == 0 else [("XTENSION", "BINTABLE" if isinstance(d, dict) else "IMAGE")]
        body, tail = b"", []
        if isinstance(d, dict):
            codes = {v: c for c, v in _COLUMN.items()}
            arrays = {n: np.asarray(v) for n, v in d.items()}
            n = len(next(iter(arrays.values())))
            fields = [(name, codes_type(v), v.shape[1:]) for name, v in arrays.items()]
            rows = np.zeros(n, np.dtype(fields))
            for i, (name, v) in enumerate(arrays.items(), 1):
                rows[name] = v
                repeat = int(np.prod(v.shape[1:])) if v.ndim > 1 else 1
                tail += [(f"TTYPE{i}", name), (f"TFORM{i}", f"{repeat}{codes[codes_type(v)]}")]
                if v.ndim > 2:
                    tail.append((f"TDIM{i}", "(" + ",".join(map(str, v.shape[:0:-1])) + ")"))
            body = rows.tobytes()
            head = [("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.dtype.itemsize), ("NAXIS2", n), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(fields)), *tail]
        elif d is None:
            head = [("BITPIX", 8), ("NAXIS", 0)]
        else:
            v = np.asarray(d)
            kind = codes_type(v)
            head = [("BITPIX", {t: b for b, t in _IMAGE.items()}[kind]), ("NAXIS", v.ndim), *[(f"NAXIS{i}", s) for i, s in enumerate(v.shape[::-1], 1)]]
            head += [] if k == 0 else [("PCOUNT", 0), ("GCOUNT", 1)]
            body = v.astype(kind).tobytes()
        used = {x for x, _ in first + head}
        cards = b"".join(_card(x, v) for x, v in first + head + [(x, v) for x, v in hdu.header.items() if x not in used]) + b"END".ljust(CARD)
        out.append(cards.ljust(-(-len(cards) // BLOCK) * BLOCK) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0"))
    return b"".join(out)


def codes_type(v: np.ndarray) -> str:
    return ">" + v.dtype.str[1:]
