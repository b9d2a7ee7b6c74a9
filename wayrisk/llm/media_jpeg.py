"""Media columns: progressive JPEG (operator 6).

decode() reads a progressive (or one-scan-each) Huffman JPEG: it gathers the
spectral-selection and successive-approximation scans into one coefficient
array for each component, inverse-transforms all blocks at once in numpy,
upsamples chroma and returns the full-resolution RGB tensor. Scans whose codes
all have one length (as encode() writes them) are read as arrays; any other
scan is read bit by bit.

encode() stores a payload losslessly in the format's own unit, the quantised
coefficient: a byte b is the size-8 coefficient whose magnitude bits are b, in
the 63 AC places of each 8x8 block of a 4:2:0 picture. Bits 7..1 go out in two
spectral bands (1-5, 6-63), bit 0 in a refinement scan. A comment segment holds
the payload's length.

Defined results: a null text is an empty one; a payload is the UTF-8 text
followed by blanks up to a positive multiple of 192; equal texts give equal
bytes and features. Repeated rows are stored each, also without an id. Other
columns are left out, whatever they are named.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
AC = 63
SAMPLING = ((1, 2, 2), (2, 1, 1), (3, 1, 1))  # component id, horizontal, vertical
MCU = sum(h * v for _, h, v in SAMPLING)
MOST_ROWS = 4095  # of 16 pixels, as the height has 16 bits
BANDS = ((1, 5), (6, 63))
SOI, EOI, SOF2, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE


@lru_cache(1)
def zigzag() -> np.ndarray:
    """Natural place (8 * row + column) of each coefficient in scan order: along anti-diagonals, in turns."""
    return np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i // 8 if s % 2 else i % 8)))


@lru_cache(1)
def dct_basis() -> np.ndarray:
    """(64, 64): samples = coefficients @ basis, both in natural order."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return np.kron(c, c).astype(np.float32)


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + struct.pack(">H", len(body) + 2) + body


def _table(kind: int, number: int, symbol: int) -> bytes:
    """A Huffman table whose one code is a single 0 bit."""
    return _segment(DHT, bytes((kind << 4 | number, 1, *[0] * 15, symbol)))


def _scan(components, first: int, last: int, high: int, low: int, bits: bytes) -> bytes:
    head = bytes((len(components), *(x for c in components for x in (c, 0)), first, last, high << 4 | low))
    return _segment(SOS, head) + bits.replace(b"\xff", b"\xff\x00")


@lru_cache(64)
def _layout(mcus: int) -> tuple[int, int, tuple[np.ndarray, ...]]:
    """MCU columns and rows, and for each component the payload order of its blocks in raster order."""
    across = -(-mcus // MOST_ROWS)
    down = -(-mcus // across)
    blocks, at = np.arange(across * down * MCU).reshape(down, across, MCU), 0
    orders = []
    for _, h, v in SAMPLING:
        part = blocks[:, :, at : at + h * v].reshape(down, across, v, h)
        orders.append(part.transpose(0, 2, 1, 3).reshape(-1))
        at += h * v
    return across, down, tuple(orders)


def encode(data: bytes) -> bytes:
    """A progressive JPEG that holds data in its AC coefficients."""
    mcus = max(1, -(-len(data) // (AC * MCU)))
    across, down, orders = _layout(mcus)
    places = np.zeros(across * down * MCU * AC, np.uint8)
    places[: len(data)] = np.frombuffer(data, np.uint8)
    places = places.reshape(-1, AC)
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, len(SAMPLING)) + b"".join(bytes((c, h << 4 | v, 0)) for c, h, v in SAMPLING)
    out = [bytes((0xFF, SOI)), _segment(COM, struct.pack(">Q", len(data))), _segment(DQT, bytes((0, *[1] * 64))), _segment(SOF2, frame)]
    # DC is 0 throughout: one 0 bit a block (its difference, and then its last bit).
    blank = b"\x00" * (-(-len(places) // 8) - 1) + bytes(((1 << (-len(places) % 8)) - 1,))
    ids = [c for c, _, _ in SAMPLING]
    out += [_table(0, 0, 0), _scan(ids, 0, 0, 0, 1, blank), _table(1, 0, 0x07)]
    own = [places[o] for o in orders]
    for first, last in BANDS:
        # Code 0 and seven magnitude bits: the byte's upper seven.
        out += [_scan([c], first, last, 0, 1, (b[:, first - 1 : last] >> 1).tobytes()) for c, b in zip(ids, own, strict=True)]
    out += [_scan(ids, 0, 0, 1, 0, blank), _table(1, 0, 0x00)]
    for c, b in zip(ids, own, strict=True):
        # End of band (code 0), then one correction bit for each coefficient: the magnitude's last.
        bits = np.zeros((len(b), 64), np.uint8)
        bits[:, 1:] = (b & 1) ^ (b < 128)
        out.append(_scan([c], 1, 63, 1, 0, np.packbits(bits).tobytes()))
    return b"".join(out) + bytes((0xFF, EOI))


class Bits:
    """Reads an entropy-coded scan bit by bit."""

    def __init__(self, data: bytes):
        self.data, self.at, self.have, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            b = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
            self.have, self.n = (self.have << 8 | b) & 0xFFFFFFFF, self.n + 8
        self.n -= n
        return self.have >> self.n & ((1 << n) - 1)

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        """Signed value of `size` magnitude bits."""
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


class Component:
    def __init__(self, number: int, h: int, v: int, table: int):
        self.number, self.h, self.v, self.table = number, h, v, table


class Picture:
    """Coefficients (in scan order) of a JPEG, gathered scan by scan."""

    def __init__(self, data: bytes):
        self.quant, self.huff, self.restart, self.comment = {}, {}, 0, b""
        self.parts: dict[int, Component] = {}
        at = 2
        while at < len(data):
            marker = data[at + 1]
            if marker == EOI:
                break
            n = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == DQT:
                self._tables(body)
            elif marker == DHT:
                self._codes(body)
            elif marker == COM:
                self.comment = body
            elif marker == DRI:
                self.restart = struct.unpack(">H", body)[0]
            elif marker in (0xC0, 0xC1, SOF2):
                self._frame(body)
            elif marker in (0xC3, *range(0xC5, 0xD0)) and marker not in (DHT, 0xC8, 0xCC):
                raise ValueError("only Huffman-coded sequential and progressive DCT pictures")
            elif marker == SOS:
                end = self._end(data, at)
                self._scan(body, data[at:end])
                at = end

    @staticmethod
    def _end(data: bytes, at: int) -> int:
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                return len(data)
            if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
                return at
            at += 2

    def _tables(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, number = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            self.quant[number] = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
            at += 1 + n

    def _codes(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts, codes, code, k = body[at + 1 : at + 17], {}, 0, at + 17
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    codes[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            self.huff[body[at] >> 4, body[at] & 15] = codes
            at = k

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        for i in range(n):
            c, hv, q = body[6 + 3 * i : 9 + 3 * i]
            self.parts[c] = Component(c, hv >> 4, hv & 15, q)
        self.hmax, self.vmax = max(p.h for p in self.parts.values()), max(p.v for p in self.parts.values())
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for p in self.parts.values():
            p.cols, p.rows = self.across * p.h, self.down * p.v
            # Blocks that a scan of this component alone has.
            p.own_cols, p.own_rows = -(-(-(-self.width * p.h // self.hmax)) // 8), -(-(-(-self.height * p.v // self.vmax)) // 8)
            p.coef = np.zeros((p.rows * p.cols, 64), np.int32)

    def _scan(self, head: bytes, raw: bytes) -> None:
        n = head[0]
        chosen = [(self.parts[head[1 + 2 * i]], head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15) for i in range(n)]
        first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        if not self.restart and self._scan_of_one_length(chosen, first, last, high, low, raw):
            return
        units = self._units([c for c, _, _ in chosen])
        step = self.restart or len(units)
        pieces, at = [], 0
        for k in range(0, len(units), step):
            end = at
            while True:
                end = raw.find(b"\xff", end)
                if end < 0 or 0xD0 <= raw[end + 1 : end + 2][0] <= 0xD7:
                    break
                end += 2
            pieces.append((raw[at : end if end >= 0 else len(raw)], units[k : k + step]))
            at = end + 2 if end >= 0 else len(raw)
        for data, todo in pieces:
            bits, dc, run = Bits(data.replace(b"\xff\x00", b"\xff")), dict.fromkeys(self.parts, 0), 0
            tables = {c.number: (d, a) for c, d, a in chosen}
            for c, k in (x for unit in todo for x in unit):
                block, (d, a) = c.coef[k], tables[c.number]
                if first == 0:
                    if high:
                        block[0] |= bits.take(1) << low
                    else:
                        dc[c.number] += bits.value(bits.symbol(self.huff[0, d]))
                        block[0] = dc[c.number] << low
                    if last == 0:
                        continue
                codes = self.huff[1, a]
                if high:
                    run = self._refine(bits, codes, block, max(first, 1), last, low, run)
                else:
                    run = self._first(bits, codes, block, max(first, 1), last, low, run)

    def _units(self, chosen: list[Component]) -> list[list[tuple[Component, int]]]:
        """The blocks of each unit of a scan, in order."""
        if len(chosen) == 1:
            c = chosen[0]
            return [[(c, r * c.cols + k)] for r in range(c.own_rows) for k in range(c.own_cols)]
        return [[(c, (r * c.v + y) * c.cols + k * c.h + x) for c in chosen for y in range(c.v) for x in range(c.h)] for r in range(self.down) for k in range(self.across)]

    @staticmethod
    def _first(bits: Bits, codes, block, first: int, last: int, low: int, run: int) -> int:
        if run:
            return run - 1
        k = first
        while k <= last:
            rs = bits.symbol(codes)
            zeros, size = rs >> 4, rs & 15
            if size:
                k += zeros
                block[k] = bits.value(size) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                return (1 << zeros) - 1 + (bits.take(zeros) if zeros else 0)
        return 0

    @staticmethod
    def _refine(bits: Bits, codes, block, first: int, last: int, low: int, run: int) -> int:
        one, k = 1 << low, first

        def correct(k: int) -> None:
            if bits.take(1) and not abs(int(block[k])) & one:
                block[k] += one if block[k] > 0 else -one

        if not run:
            while k <= last:
                rs = bits.symbol(codes)
                zeros, size, new = rs >> 4, rs & 15, 0
                if size:
                    new = one if bits.take(1) else -one
                elif zeros < 15:
                    run = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                    break
                while k <= last:
                    if block[k]:
                        correct(k)
                    elif zeros:
                        zeros -= 1
                    else:
                        block[k] = new
                        k += 1
                        break
                    k += 1
        if run:
            for k in range(k, last + 1):
                if block[k]:
                    correct(k)
            run -= 1
        return run

    def _scan_of_one_length(self, chosen, first: int, last: int, high: int, low: int, raw: bytes) -> bool:
        """Read a scan whose table has the one code 0, where that gives all its units one length; else False."""
        kind = 0 if first == 0 else 1
        tables = [self.huff.get((kind, d if kind == 0 else a), {}) for _, d, a in chosen]
        refines_dc = first == 0 and high
        if first == 0 and last or any(list(t) != [(1, 0)] for t in tables) and not refines_dc:
            return False
        if first == 0:
            symbols = {0} if refines_dc else {t[1, 0] for t in tables}
            n = sum(c.h * c.v for c, _, _ in chosen) * self.across * self.down if len(chosen) > 1 else chosen[0].own_rows * chosen[0].own_cols
            bits = np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8)
            # All blocks' bits are 0 (differences of size 0, or corrections that change nothing).
            return symbols == {0} and len(bits) == -(-n // 8) and not bits[:-1].any() and bits[-1] < 1 << (-n % 8)
        c, symbol = chosen[0][0], tables[0][1, 0]
        data = np.frombuffer(raw.replace(b"\xff\x00", b"\xff") if b"\xff" in raw else raw, np.uint8)
        n, width = c.own_rows * c.own_cols, last - first + 1
        if c.own_cols != c.cols or c.own_rows != c.rows:
            return False
        if high == 0 and symbol == 0x07 and len(data) == n * width:
            v = data.reshape(n, width).astype(np.int32)
            c.coef[:, first : last + 1] = np.where(v >= 64, v, v - 127) << low
            return True
        band = c.coef[:, first : last + 1]
        if high and symbol == 0x00 and width == 63 and len(data) == 8 * n and band.all():
            bits = np.unpackbits(data.reshape(n, 8), axis=1)[:, 1:].astype(np.int32) << low
            bits &= ~np.abs(band)
            c.coef[:, first : last + 1] = band + np.where(band > 0, bits, -bits)
            return True
        return False

    def rgb(self) -> np.ndarray:
        """(height, width, 3) of uint8: inverse transform, chroma repeated to full size, colours."""
        basis, planes = dct_basis()[zigzag()], []
        for c in self.parts.values():
            samples = (c.coef * self.quant[c.table]).astype(np.float32) @ basis + 128
            plane = samples.reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.cols)
            planes.append(np.clip(np.rint(plane), 0, 255).repeat(self.vmax // c.v, 0).repeat(self.hmax // c.h, 1)[: self.height, : self.width])
        if len(planes) == 1:
            planes *= 3
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            planes = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
        return np.clip(np.rint(np.stack(planes, -1)), 0, 255).astype(np.uint8)


def decode(media: bytes) -> np.ndarray:
    """The full-resolution RGB tensor of a JPEG."""
    return Picture(media).rgb()


def read_back(media: bytes) -> tuple[bytes, np.ndarray]:
    """The payload that encode() stored, and the picture's RGB tensor."""
    p = Picture(media)
    _, _, orders = _layout(p.across * p.down)
    places = np.empty((p.across * p.down * MCU, AC), np.uint8)
    for c, o in zip(p.parts.values(), orders, strict=True):
        v = c.coef[:, 1:]
        places[o] = np.where(v > 0, v, v + 255)
    return places.tobytes()[: struct.unpack(">Q", p.comment)[0]], p.rgb()


def feature(rgb: np.ndarray) -> str:
    """Shape, mean colour and checksum of a tensor."""
    mean = rgb.reshape(-1, 3).mean(0)
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{mean[0]:.2f},{mean[1]:.2f},{mean[2]:.2f}:{zlib.crc32(rgb):08x}"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes and media: each text's payload as a progressive JPEG."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A few at a time, so that pictures do not pile up beside the batch.
            for i in range(0, b.num_rows, 64):
                texts = b.column(1).slice(i, 64).to_pylist()
                yield pa.record_batch([b.column(0).slice(i, 64), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([encode(payload(t)) for t in texts], pa.binary())], ["id", "n_bytes", "media"])

    return given.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_media(stored: DataFrame, id_col: str = "doc_id", tensors: bool = True) -> DataFrame:
    """stored's rows with payload, feature and (if asked for) the RGB tensor with its height and width."""
    given = stored.select(F.col(id_col).alias("id"), "n_bytes", "media")
    more = ", height int, width int, rgb binary" if tensors else ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                rows = []
                for m in part.column(2).to_pylist():
                    data, rgb = read_back(m)
                    if tensors:
                        rows.append((feature(rgb), rgb.shape[0], rgb.shape[1], rgb.tobytes()))
                    else:
                        rows.append((feature(rgb), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest()))
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary()] if tensors else [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                names = ["feature", "height", "width", "rgb"] if tensors else ["feature", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
                yield pa.record_batch([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["id", "n_bytes", *names])

    return given.mapInArrow(run, f"id {stored.schema[id_col].dataType.simpleString()}, n_bytes long, feature string{more}").withColumnRenamed("id", id_col)
