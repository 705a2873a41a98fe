"""Byte-level codecs: TIFF (strips and tiles), ENVI, PNG (8 and 16 bits), BMP, NetCDF classic. NumPy and zlib only."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

from pairloom.errors import DependencyMissingError, ImageReadError, ImageWriteError


@dataclass
class Layout:
    """What a reader needs to fetch a window without the rest."""

    width: int
    height: int
    bands: int
    dtype: str
    kind: str
    nodata: float | None = None
    crs: str | None = None
    transform: tuple[float, ...] | None = None
    names: list[str] = field(default_factory=list)
    extra: dict = field(default_factory=dict)


# --- TIFF ---------------------------------------------------------------------------------------------------------

# Field types (bytes, struct code) and tags of the format.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q")}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _STRIP_AT, _SAMPLES, _ROWS, _STRIP_N, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
_TILE_W, _TILE_H, _TILE_AT, _TILE_N, _FORMAT, _SCALE, _TIE, _MATRIX, _GEO, _NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113


def tiff_tags(f: BinaryIO) -> tuple[str, dict[int, tuple]]:
    """(byte order, tags of the first directory); classic and big."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ImageReadError("not a TIFF file")
    magic = struct.unpack(order + "H", head[2:4])[0]
    big = magic == 43
    if magic not in (42, 43):
        raise ImageReadError("not a TIFF file")
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    f.seek(at)
    n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
    step, inline = (20, 8) if big else (12, 4)
    raw, tags = f.read(step * n), {}
    for k in range(n):
        e = raw[step * k : step * (k + 1)]
        tag, kind = struct.unpack(order + "HH", e[:4])
        count = struct.unpack(order + ("Q" if big else "I"), e[4 : 12 if big else 8])[0]
        if kind not in _TYPES:
            continue
        size, code = _TYPES[kind]
        data = e[-inline:]
        if size * count > inline:
            f.seek(struct.unpack(order + ("Q" if big else "I"), data)[0])
            data = f.read(size * count)
        data = data[: size * count]
        tags[tag] = (data.rstrip(b"\0").decode("utf-8", "replace"),) if kind == 2 else struct.unpack(order + code * count, data) if kind != 5 else struct.unpack(order + "II" * count, data)
    return order, tags


def tiff_layout(f: BinaryIO) -> Layout:
    order, t = tiff_tags(f)
    one = lambda k, d=None: t[k][0] if k in t else d
    bits, kind = one(_BITS, 1), {1: "u", 2: "i", 3: "f"}.get(one(_FORMAT, 1))
    if kind is None or bits not in (8, 16, 32, 64):
        raise ImageReadError(f"{bits}-bit samples of format {one(_FORMAT)} are not supported")
    transform = None
    if _SCALE in t and _TIE in t:
        (sx, sy, *_), tie = t[_SCALE], t[_TIE]
        transform = (sx, 0.0, tie[3] - tie[0] * sx, 0.0, -sy, tie[4] + tie[1] * sy)
    elif _MATRIX in t:
        m = t[_MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    if transform == (1.0, 0.0, 0.0, 0.0, 1.0, 0.0):
        transform = None
    crs = None
    if _GEO in t:
        keys = t[_GEO]
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        code = codes.get(3072) or codes.get(2048)
        crs = f"EPSG:{code}" if code and code != 32767 else None
    nodata = None
    if _NODATA in t:
        try:
            nodata = float(t[_NODATA][0])
        except ValueError:
            pass
    tags = {k: t[k] for k in (_COMPRESSION, _STRIP_AT, _STRIP_N, _ROWS, _PLANAR, _PREDICTOR, _TILE_W, _TILE_H, _TILE_AT, _TILE_N) if k in t}
    return Layout(one(_WIDTH), one(_HEIGHT), one(_SAMPLES, 1), np.dtype(f"{kind}{bits // 8}").name, "tiff", nodata, crs, transform, extra={"order": order, "tags": tags})


def _unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first."""
    table, out, bits, n, width, prev = [bytes([i]) for i in range(256)] + [b"", b""], [], 0, 0, 9, None
    for byte in data:
        bits, n = bits << 8 | byte, n + 8
        while n >= width:
            code = bits >> (n - width) & ((1 << width) - 1)
            n -= width
            bits &= (1 << n) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, prev = table[:258], 9, None
                continue
            if prev is None:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else prev + prev[:1]
                table.append(prev + entry[:1])
            out.append(entry)
            prev = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _unpackbits(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k]
        k += 1
        if n < 128:
            out += data[k : k + n + 1]
            k += n + 1
        elif n > 128:
            out += data[k : k + 1] * (257 - n)
            k += 1
    return bytes(out)


def tiff_window(f: BinaryIO, lay: Layout, bands: list[int], window: tuple[int, int, int, int]) -> np.ndarray:
    """(bands, height, width) of a window (row, col, height, width): only the blocks it meets are read."""
    t, order = lay.extra["tags"], lay.extra["order"]
    one = lambda k, d=None: t[k][0] if k in t else d
    r0, c0, h, w = window
    dt, planar = np.dtype(lay.dtype).newbyteorder(order), one(_PLANAR, 1)
    if _TILE_W in t:
        bw, bh, at, size = one(_TILE_W), one(_TILE_H), t[_TILE_AT], t[_TILE_N]
    else:
        bw, bh, at, size = lay.width, min(one(_ROWS, lay.height), lay.height), t[_STRIP_AT], t[_STRIP_N]
    across, down = -(-lay.width // bw), -(-lay.height // bh)
    per = lay.bands if planar == 1 else 1
    out = np.zeros((len(bands), h, w), np.dtype(lay.dtype))
    method = one(_COMPRESSION, 1)
    unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 5: _unlzw, 32773: _unpackbits}.get(method)
    if unpack is None:
        raise ImageReadError(f"TIFF compression {method} is not supported")
    for plane in [0] if planar == 1 else [b - 1 for b in bands]:
        for i in range(r0 // bh, min((r0 + h - 1) // bh + 1, down)):
            for j in range(c0 // bw, min((c0 + w - 1) // bw + 1, across)):
                k = plane * across * down + i * across + j
                f.seek(at[k])
                raw = unpack(f.read(size[k]))
                rows = bh if _TILE_W in t else min(bh, lay.height - i * bh)
                block = np.frombuffer(raw[: rows * bw * per * dt.itemsize], dt).reshape(rows, bw, per).astype(dt.newbyteorder("="))
                if one(_PREDICTOR, 1) == 2:
                    block = np.cumsum(block, axis=1, dtype=block.dtype)
                a0, a1, b0, b1 = max(r0, i * bh), min(r0 + h, i * bh + rows), max(c0, j * bw), min(c0 + w, (j + 1) * bw)
                part = block[a0 - i * bh : a1 - i * bh, b0 - j * bw : b1 - j * bw]
                for n, b in enumerate(bands):
                    if planar == 1 or b - 1 == plane:
                        out[n, a0 - r0 : a1 - r0, b0 - c0 : b1 - c0] = part[:, :, b - 1 if planar == 1 else 0]
    return out


def tiff_bytes(array: np.ndarray, crs: str | None = None, transform: tuple[float, ...] | None = None, nodata: float | None = None, compress: str | None = "deflate") -> bytes:
    """A GeoTIFF of (bands, height, width) in strips, band by band; big once it needs to be."""
    array = _cube(array)
    bands, h, w = array.shape
    kind = {"u": 1, "i": 2, "f": 3}.get(array.dtype.kind)
    if kind is None or compress not in (None, "none", "deflate"):
        raise ImageWriteError(f"{array.dtype} with {compress} can't be written")
    deflate = compress == "deflate"
    rows = max(1, min(h, (1 << 18) // max(1, w * array.dtype.itemsize)))
    data = array.astype(array.dtype.newbyteorder("<"))
    strips = [x if not deflate else zlib.compress(x, 6) for b in range(bands) for r in range(0, h, rows) for x in [data[b, r : r + rows].tobytes()]]
    big = sum(map(len, strips)) > 0xF0000000
    tags: list[tuple[int, int, tuple]] = [
        (_WIDTH, 4, (w,)), (_HEIGHT, 4, (h,)), (_BITS, 3, (array.dtype.itemsize * 8,) * bands), (_COMPRESSION, 3, (8 if deflate else 1,)), (_PHOTOMETRIC, 3, (1,)), (_SAMPLES, 3, (bands,)),
        (_ROWS, 4, (rows,)), (_PLANAR, 3, (2 if bands > 1 else 1,)), (_FORMAT, 3, (kind,) * bands),
    ]
    if transform:
        a, b, c, d, e, f = transform
        tags += [(_SCALE, 12, (a, -e, 0.0)), (_TIE, 12, (0.0, 0.0, 0.0, c, f, 0.0))] if b == d == 0 and e < 0 else [(_MATRIX, 12, (a, b, 0.0, c, d, e, 0.0, f, *(0.0,) * 4, 0.0, 0.0, 0.0, 1.0))]
    code = int(crs.split(":")[1]) if crs and crs.upper().startswith("EPSG:") else None
    if code:
        flat = 4000 <= code < 5000
        tags.append((_GEO, 3, (1, 1, 0, 3, 1024, 0, 1, 2 if flat else 1, 1025, 0, 1, 1, 2048 if flat else 3072, 0, 1, code)))
    if nodata is not None:
        text = (repr(float(nodata)) if not float(nodata).is_integer() else str(int(nodata))).encode() + b"\0"
        tags.append((_NODATA, 2, (text,)))
    word, head = ("Q", 16) if big else ("I", 8)
    at, where = head, []
    for s in strips:
        where.append(at)
        at += len(s) + len(s) % 2
    tags += [(_STRIP_AT, 16 if big else 4, tuple(where)), (_STRIP_N, 16 if big else 4, tuple(map(len, strips)))]
    tags.sort()
    inline, step = (8, 20) if big else (4, 12)
    pool_at, pool, entries = at + (8 if big else 2) + step * len(tags) + (8 if big else 4), b"", b""
    for tag, kind_, values in tags:
        size, code_ = _TYPES[kind_]
        raw = values[0] if kind_ == 2 else struct.pack("<" + code_ * len(values), *values)
        count = len(raw) if kind_ == 2 else len(values)
        entries += struct.pack("<HH" + word, tag, kind_, count)
        if len(raw) <= inline:
            entries += raw.ljust(inline, b"\0")
        else:
            entries += struct.pack("<" + word, pool_at + len(pool))
            pool += raw + b"\0" * (len(raw) % 2)
    header = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)
    body = b"".join(s + b"\0" * (len(s) % 2) for s in strips)
    return header + body + struct.pack("<Q" if big else "<H", len(tags)) + entries + struct.pack("<" + word, 0) + pool


def _cube(array: np.ndarray) -> np.ndarray:
    array = np.asarray(array)
    array = array[None] if array.ndim == 2 else array
    if array.ndim != 3 or not array.size:
        raise ImageWriteError(f"an image has two or three dimensions and pixels; got {array.shape}")
    return array


# --- PNG and BMP --------------------------------------------------------------------------------------------------

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_array(data: bytes) -> np.ndarray:
    """(bands, height, width); palettes become RGB. Not interlaced, 8 or 16 bits."""
    if data[:8] != _SIGNATURE:
        raise ImageReadError("not a PNG file")
    at, packed, palette, head = 8, [], None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    w, h, bits, color, _, _, interlace = head
    if bits not in (8, 16) or interlace or color not in _CHANNELS:
        raise ImageReadError(f"PNG with {bits} bits, interlace {interlace}, colour {color} is not supported")
    bpp = _CHANNELS[color] * bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * bpp)
    out, above = np.zeros((h, w * bpp), np.uint8), np.zeros(w * bpp, np.int64)
    for r in range(h):
        line, f = raw[r, 1:].astype(np.int64), raw[r, 0]
        if f == 1:
            line = np.cumsum(line.reshape(w, bpp), axis=0).ravel() & 255
        elif f == 2:
            line = (line + above) & 255
        elif f in (3, 4):
            for k in range(w * bpp):
                a, c = (line[k - bpp], above[k - bpp]) if k >= bpp else (0, 0)
                b = above[k]
                if f == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                line[k] = (line[k] + guess) & 255
        out[r], above = line, line
    image = out.reshape(h, w, bpp) if bits == 8 else out.view(">u2").reshape(h, w, bpp // 2).astype(np.uint16)
    if color == 3:
        image = palette[image[:, :, 0]]
    return np.ascontiguousarray(image.transpose(2, 0, 1))


def png_bytes(array: np.ndarray) -> bytes:
    array = _cube(array)
    bands, h, w = array.shape
    if bands not in (1, 3, 4) or array.dtype not in (np.uint8, np.uint16):
        raise ImageWriteError(f"{bands} bands of {array.dtype} are no PNG")
    rows = array.transpose(1, 2, 0).astype(array.dtype.newbyteorder(">")).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.frombuffer(np.ascontiguousarray(rows).tobytes(), np.uint8).reshape(h, -1)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8 * array.dtype.itemsize, {1: 0, 3: 2, 4: 6}[bands], 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def bmp_array(data: bytes) -> np.ndarray:
    """Uncompressed, 24 or 32 bits."""
    if data[:2] != b"BM":
        raise ImageReadError("not a BMP file")
    at, = struct.unpack("<I", data[10:14])
    w, h, _, bits, packed = struct.unpack("<iiHHI", data[18:34])
    if bits not in (24, 32) or packed not in (0, 3):
        raise ImageReadError(f"{bits}-bit BMP is not supported")
    line = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data[at : at + line * abs(h)], np.uint8).reshape(abs(h), line)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    rows = rows[::-1] if h > 0 else rows
    return np.ascontiguousarray(rows[:, :, [2, 1, 0]].transpose(2, 0, 1))


# --- ENVI ---------------------------------------------------------------------------------------------------------

# Data type numbers of the format.
_ENVI = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}


def envi_layout(header: str) -> Layout:
    items, text = {}, header.split("\n", 1)[1] if header.startswith("ENVI") else header
    for line in text.replace("{\n", "{").split("\n"):
        if "=" in line:
            k, v = line.split("=", 1)
            items[k.strip().lower()] = v.strip()
    try:
        w, h, n, code = (int(items[k]) for k in ("samples", "lines", "bands", "data type"))
    except KeyError as e:
        raise ImageReadError(f"ENVI header lacks {e}") from e
    if code not in _ENVI:
        raise ImageReadError(f"ENVI data type {code} is not supported")
    transform, crs, info = None, None, items.get("map info", "").strip("{} ").split(",")
    if len(info) >= 7:
        px, py, e, n_, sx, sy = (float(x) for x in info[1:7])
        transform = (sx, 0.0, e - (px - 1) * sx, 0.0, -sy, n_ + (py - 1) * sy)
        if info[0].strip().upper() == "UTM" and len(info) >= 9:
            crs = f"EPSG:{(32700 if info[8].strip().lower().startswith('s') else 32600) + int(float(info[7]))}"
    names = [x.strip() for x in items.get("band names", "").strip("{} ").split(",") if x.strip()]
    nodata = float(items["data ignore value"]) if "data ignore value" in items else None
    order = ">" if items.get("byte order", "0") == "1" else "<"
    extra = {"interleave": items.get("interleave", "bsq").lower(), "offset": int(items.get("header offset", 0)), "order": order}
    return Layout(w, h, n, np.dtype(_ENVI[code]).name, "envi", nodata, crs, transform, names if len(names) == n else [], extra)


def envi_window(path: str, lay: Layout, bands: list[int], window: tuple[int, int, int, int]) -> np.ndarray:
    shape, axes = {"bsq": ((lay.bands, lay.height, lay.width), (0, 1, 2)), "bil": ((lay.height, lay.bands, lay.width), (1, 0, 2)), "bip": ((lay.height, lay.width, lay.bands), (2, 0, 1))}[lay.extra["interleave"]]
    cube = np.memmap(path, np.dtype(lay.dtype).newbyteorder(lay.extra["order"]), "r", lay.extra["offset"], shape).transpose(axes)
    r, c, h, w = window
    return np.stack([np.asarray(cube[b - 1, r : r + h, c : c + w]) for b in bands]).astype(lay.dtype)


# --- NetCDF classic -----------------------------------------------------------------------------------------------

_NC = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def netcdf_header(data: bytes) -> dict[str, dict]:
    """Variables of a classic file: shape, dtype, where their data begin, attributes."""
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise DependencyMissingError("netCDF4", "NetCDF-4 files")
    wide, at = data[3] == 2, 4

    def number(code: str = ">I") -> int:
        nonlocal at
        v = struct.unpack_from(code, data, at)[0]
        at += struct.calcsize(code)
        return v

    def name() -> str:
        nonlocal at
        n = number()
        s = data[at : at + n].decode()
        at += (n + 3) // 4 * 4
        return s

    def attributes() -> dict:
        nonlocal at
        number()
        out = {}
        for _ in range(number()):
            key, kind, n = name(), number(), number()
            dt = np.dtype(_NC[kind])
            raw = data[at : at + n * dt.itemsize]
            at += (n * dt.itemsize + 3) // 4 * 4
            out[key] = raw.decode("utf-8", "replace") if kind == 2 else np.frombuffer(raw, dt).tolist()
        return out

    records = number()
    number()
    dims = [(name(), number()) for _ in range(number())]
    attributes()
    number()
    out = {}
    for _ in range(number()):
        key = name()
        ids = [number() for _ in range(number())]
        attrs, kind, _, begin = attributes(), number(), number(), number(">Q" if wide else ">I")
        shape = [dims[i][1] or records for i in ids]
        out[key] = {"shape": shape, "dtype": _NC[kind], "begin": begin, "attrs": attrs, "record": bool(ids) and dims[ids[0]][1] == 0}
    size = sum((int(np.prod(v["shape"][1:])) * np.dtype(v["dtype"]).itemsize + 3) // 4 * 4 for v in out.values() if v["record"])
    for v in out.values():
        v["stride"] = size
    return out


def netcdf_array(data: bytes, var: dict) -> np.ndarray:
    dt, shape = np.dtype(var["dtype"]), var["shape"]
    if not var["record"]:
        out = np.frombuffer(data, dt, int(np.prod(shape)), var["begin"]).reshape(shape)
    else:
        n = int(np.prod(shape[1:]))
        out = np.stack([np.frombuffer(data, dt, n, var["begin"] + k * var["stride"]).reshape(shape[1:]) for k in range(shape[0])])
    return out.astype(dt.newbyteorder("="))
