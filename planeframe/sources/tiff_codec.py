"""BigTIFF pages: writing in one pass, and reading of classic and big files, one sample, 8 or 16 bits, stripped."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..model import PlaneFrameError, Settings

#: Field types (bytes each) and tags of the TIFF 6 and BigTIFF formats.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION = 256, 257, 258, 259, 262, 270
STRIP_OFFSETS, ORIENTATION, SAMPLES, ROWS_PER_STRIP, STRIP_BYTE_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, SAMPLE_FORMAT = 273, 274, 277, 278, 279, 284, 317, 322, 339
NONE, LZW, ADOBE_DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
ASCII, SHORT, LONG, LONG8 = 2, 3, 4, 16
HEADER = 16


def encode_strips(plane: np.ndarray, s: Settings) -> list[bytes]:
    """Strips of about 64 KiB, deflated after horizontal differencing where compression is on."""
    out = []
    for y in range(0, s.height, s.rows_per_strip):
        rows = plane[y : y + s.rows_per_strip]
        if s.compression:
            delta = rows.copy()
            delta[:, 1:] -= rows[:, :-1]
            out.append(zlib.compress(delta.tobytes(), s.compression_level))
        else:
            out.append(rows.tobytes())
    return out


def decode_strip(raw: bytes, rows: int, width: int, kind: np.dtype, compression: int, predictor: int) -> np.ndarray:
    if compression in (ADOBE_DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif compression == PACKBITS:
        raw = _unpacked(raw)
    elif compression == LZW:
        raw = _lzw(raw, rows * width * kind.itemsize)
    elif compression != NONE:
        raise PlaneFrameError(f"TIFF compression {compression} is not supported")
    if len(raw) < rows * width * kind.itemsize:
        raise PlaneFrameError("TIFF strip is too short")
    out = np.frombuffer(raw, kind, rows * width).reshape(rows, width)
    if predictor == 2:
        out = np.cumsum(out, axis=1, dtype=kind.newbyteorder("="))
    return out.astype(kind.newbyteorder("<"))


def _unpacked(raw: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(raw):
        n = raw[k]
        if n < 128:
            out += raw[k + 1 : k + 2 + n]
            k += 2 + n
        else:
            if n > 128:
                out += raw[k + 1 : k + 2] * (257 - n)
            k += 2
    return bytes(out)


def _lzw(raw: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 empties the table, 257 ends. A code grows one bit earlier than the table needs it, as the format has it."""
    table: list[bytes] = []
    out, width, bits, held, last = bytearray(), 9, 0, 0, None
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        if not table or code > len(table) or (code == len(table) and last is None):
            raise PlaneFrameError("TIFF strip holds an invalid LZW code")
        now = table[code] if code < len(table) else last + last[:1]
        out += now
        if last is not None:
            table.append(last + now[:1])
        last = now
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


class PageWriter:
    """Writes pages to a stream from front to back. A page is held until the next one comes, since it names the next page's place."""

    def __init__(self, out, s: Settings):
        self.out, self.s, self.at, self.held, self.pages = out, s, HEADER, None, 0
        out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, HEADER))

    def add(self, plane: np.ndarray, description: bytes | None) -> None:
        """``description`` None leaves the tag out."""
        strips = encode_strips(plane, self.s)
        if self.held:
            self._put(last=False)
        self.held = (strips, description)
        self.pages += 1

    def _put(self, last: bool) -> None:
        s, (strips, text) = self.s, self.held
        fields = {WIDTH: (LONG, [s.width]), HEIGHT: (LONG, [s.height]), BITS: (SHORT, [s.storage_bits]), COMPRESSION: (SHORT, [ADOBE_DEFLATE if s.compression else NONE]), PHOTOMETRIC: (SHORT, [1])}
        fields |= {ORIENTATION: (SHORT, [1]), SAMPLES: (SHORT, [1]), ROWS_PER_STRIP: (LONG, [s.rows_per_strip]), PLANAR: (SHORT, [1]), SAMPLE_FORMAT: (SHORT, [1])}
        if s.compression:
            fields[PREDICTOR] = (SHORT, [2])
        if text is not None:
            fields[DESCRIPTION] = (ASCII, text + b"\0")
        fields |= {STRIP_OFFSETS: (LONG8, [0] * len(strips)), STRIP_BYTE_COUNTS: (LONG8, [len(x) for x in strips])}
        after = self.at + 8 + 20 * len(fields) + 8
        extra = sum(n for kind, v in fields.values() if (n := len(v) * SIZES[kind]) > 8)
        first = after + extra
        fields[STRIP_OFFSETS] = (LONG8, [first + sum(map(len, strips[:k])) for k in range(len(strips))]) if len(strips) < 64 else (LONG8, (first + np.cumsum([0, *map(len, strips[:-1])])).tolist())
        head, tail = struct.pack("<Q", len(fields)), b""
        for tag in sorted(fields):
            kind, v = fields[tag]
            raw = bytes(v) if kind == ASCII else struct.pack(f"<{len(v)}{CODES[kind]}", *v)
            head += struct.pack("<HHQ", tag, kind, len(v))
            if len(raw) <= 8:
                head += raw.ljust(8, b"\0")
            else:
                head += struct.pack("<Q", after + len(tail))
                tail += raw
        body = b"".join(strips)
        end = first + len(body)
        self.out.write(head + struct.pack("<Q", 0 if last else end) + tail + body)
        self.at, self.held = end, None

    def finish(self) -> None:
        if self.held:
            self._put(last=True)


class PageReader:
    """Directories and pixels of a TIFF file, classic or big, of either byte order."""

    def __init__(self, file):
        self.file = file
        head = self._at(0, 16)
        if head[:2] not in (b"II", b"MM"):
            raise PlaneFrameError("not a TIFF file")
        self.order = "<" if head[:2] == b"II" else ">"
        (version,) = struct.unpack(self.order + "H", head[2:4])
        if version not in (42, 43):
            raise PlaneFrameError("not a TIFF file")
        self.big, self.at = version == 43, 0
        self.first = struct.unpack(self.order + "Q", head[8:16])[0] if self.big else struct.unpack(self.order + "I", head[4:8])[0]

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def directories(self, start: int | None = None):
        """Yields the fields of each page from the directory at ``start`` on: {tag: (type, count, place of the value)}; ``self.at`` is where it begins."""
        at, seen = start or self.first, set()
        count, entry, pointer = ("Q", 20, "Q") if self.big else ("H", 12, "I")
        while at:
            if at in seen:
                raise PlaneFrameError("TIFF directories form a loop")
            seen.add(at)
            self.at = at
            size = struct.calcsize(count)
            raw = self._at(at, size)
            if len(raw) < size:
                raise PlaneFrameError("TIFF directory is cut off")
            (n,) = struct.unpack(self.order + count, raw)
            raw = self._at(at + size, n * entry + struct.calcsize(pointer))
            fields = {}
            for k in range(n):
                tag, kind, items = struct.unpack_from(self.order + ("HHQ" if self.big else "HHI"), raw, k * entry)
                fields[tag] = (kind, items, at + size + k * entry + (12 if self.big else 8))
            yield fields
            (at,) = struct.unpack_from(self.order + pointer, raw, n * entry)

    def values(self, fields: dict, tag: int, default=None):
        """All values of a field, or ``default``."""
        if tag not in fields:
            return default
        kind, n, place = fields[tag]
        size = SIZES.get(kind, 1) * n
        if size > (8 if self.big else 4):
            (place,) = struct.unpack(self.order + ("Q" if self.big else "I"), self._at(place, 8 if self.big else 4))
        raw = self._at(place, size)
        return raw.split(b"\0")[0] if kind == ASCII else list(struct.unpack(f"{self.order}{n}{CODES[kind]}", raw))

    def geometry(self, fields: dict) -> tuple[int, int, int]:
        """(width, height, bits) of a page that a plane can be read from; raises otherwise."""
        one = lambda tag, default: (self.values(fields, tag) or [default])[0]
        width, height, bits = one(WIDTH, 0), one(HEIGHT, 0), one(BITS, 1)
        if one(SAMPLES, 1) != 1 or one(PLANAR, 1) != 1 or one(SAMPLE_FORMAT, 1) != 1 or bits not in (8, 16) or width <= 0 or height <= 0 or TILE_WIDTH in fields:
            raise PlaneFrameError("TIFF page is not a one-sample 8- or 16-bit unsigned image in strips")
        return width, height, bits

    def plane(self, fields: dict) -> np.ndarray:
        width, height, bits = self.geometry(fields)
        kind = np.dtype(f"{self.order}u{bits // 8}")
        per = min((self.values(fields, ROWS_PER_STRIP) or [height])[0], height)
        offsets, sizes = self.values(fields, STRIP_OFFSETS), self.values(fields, STRIP_BYTE_COUNTS)
        code, predictor = (self.values(fields, COMPRESSION) or [NONE])[0], (self.values(fields, PREDICTOR) or [1])[0]
        parts = [decode_strip(self._at(o, n), min(per, height - k * per), width, kind, code, predictor) for k, (o, n) in enumerate(zip(offsets, sizes))]
        return np.concatenate(parts)


def patch_description(path: str, text: bytes) -> None:
    """Puts ``text`` at the end of a local BigTIFF file and makes the first page's description point to it."""
    with open(path, "r+b") as f:
        reader = PageReader(f)
        fields = next(reader.directories())
        place = fields[DESCRIPTION][2]
        f.seek(0, 2)
        at = f.tell()
        f.write(text + b"\0")
        f.seek(place - 8)
        f.write(struct.pack("<QQ", len(text) + 1, at))
        f.flush()
