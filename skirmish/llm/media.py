"""Media columns: baseline JPEG.

`store_text` keeps any byte payload without loss in a grey baseline JPEG: the
64 quantised coefficients of a block, in zigzag order, carry 64 payload bytes.
A byte becomes one of the non-zero values -128..-1, 1..128, so no run lengths
arise, and the Huffman tables give size s a code of (constant - s) bits: every
coefficient takes 9 bits, every DC difference 10.  The file is an ordinary
baseline JPEG that any decoder reads, and its scan can be coded and decoded by
whole arrays.  `decode` also reads other baseline files, symbol by symbol.

Cases: a null text counts as empty; the empty text is one block of zeros; a
null or broken media value gives null features; row order and repeated rows
don't matter; other columns of the input are left out of the result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

BLOCK = 64
DC_BITS, AC_BITS = 10, 9
BLOCK_BITS = DC_BITS + 63 * AC_BITS
_GROUP = 8192  # blocks coded at a time; a multiple of 8 ends on a whole byte


def _field(value: int, total: int, least: int) -> int:
    """Huffman code and magnitude bits of a value as one field of total bits;
    size s has the code of (total - s) bits that is ones and a final zero."""
    size = abs(value).bit_length()
    code = (1 << (total - size)) - 2
    return (code << size) | (value if value >= 0 else value + (1 << size) - 1)


def _bit_rows(fields: list[int], bits: int) -> np.ndarray:
    return np.array([[(f >> (bits - 1 - i)) & 1 for i in range(bits)] for f in fields], np.uint8)


_COEF = np.array([b - 128 if b < 128 else b - 127 for b in range(256)], np.int16)
_AC_FIELDS = [_field(int(c), AC_BITS, 1) for c in _COEF]
_DC_FIELDS = [_field(d, DC_BITS, 0) for d in range(-256, 257)]
_AC_ROWS, _DC_ROWS = _bit_rows(_AC_FIELDS, AC_BITS), _bit_rows(_DC_FIELDS, DC_BITS)
_AC_BACK = np.full(1 << AC_BITS, -1, np.int16)
_AC_BACK[_AC_FIELDS] = np.arange(256)
_DC_BACK = np.full(1 << DC_BITS, -999, np.int16)
_DC_BACK[_DC_FIELDS] = np.arange(-256, 257)
_BYTE = np.full(257, -1, np.int16)  # of a coefficient + 128
_BYTE[_COEF + 128] = np.arange(256)

_DC_TABLE = ([1] * 10, list(range(9, -1, -1)))
_AC_TABLE = ([1] * 9, [8, 7, 6, 5, 4, 3, 2, 1, 0])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, table: tuple[list[int], list[int]]) -> bytes:
    counts, symbols = table
    return _segment(0xC4, bytes([kind]) + bytes(counts + [0] * (16 - len(counts))) + bytes(symbols))


def pad(data: bytes) -> bytes:
    """Zeros up to a positive multiple of a block."""
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def encode(payload: bytes) -> bytes:
    """A grey baseline JPEG that holds payload, whose length divides by 64."""
    n = len(payload) // BLOCK
    wide = int(np.ceil(np.sqrt(n)))
    high = -(-n // wide)
    data = np.frombuffer(payload, np.uint8).reshape(n, BLOCK)
    if wide * high > n:
        data = np.concatenate([data, np.zeros((wide * high - n, BLOCK), np.uint8)])
    parts, before = [], 0
    for at in range(0, len(data), _GROUP):
        part = data[at : at + _GROUP]
        dc = _COEF[part[:, 0]]
        bits = np.empty((len(part), BLOCK_BITS), np.uint8)
        bits[:, :DC_BITS] = _DC_ROWS[np.diff(dc, prepend=np.int16(before)) + 256]
        bits[:, DC_BITS:] = _AC_ROWS[part[:, 1:]].reshape(len(part), -1)
        before = dc[-1]
        flat = bits.ravel()
        if len(flat) % 8:  # the last byte is filled up with ones
            flat = np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)])
        parts.append(np.packbits(flat).tobytes())
    scan = b"".join(parts).replace(b"\xff", b"\xff\x00")
    return b"".join([
        b"\xff\xd8",
        _segment(0xFE, b"payload=%d" % len(payload)),
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\1\x11\0"),
        _dht(0x00, _DC_TABLE),
        _dht(0x10, _AC_TABLE),
        _segment(0xDA, b"\1\1\0\0\x3f\0"),
        scan,
        b"\xff\xd9",
    ])


@dataclass
class Image:
    width: int
    height: int
    luma: np.ndarray  # DC-only thumbnail, a pixel for each block of the first component
    coefficients: np.ndarray  # of the first component: blocks in raster order x 64 in zigzag order
    comment: bytes


class _Bits:
    """Most significant bit first, over a scan without stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, k: int) -> int:
        while self.n < k:
            self.held = (self.held << 8) | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.n += 8
            if self.at > len(self.data) + 8:
                raise ValueError("the scan ends early")
        self.n -= k
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = (code << 1) | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _codes(counts: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _by_array(scan: bytes, n: int) -> np.ndarray | None:
    """Coefficients of n blocks coded with the constant-length tables."""
    out = np.empty((n, BLOCK), np.int16)
    before = 0
    for at in range(0, n, _GROUP):
        k = min(_GROUP, n - at)
        first = at * BLOCK_BITS // 8
        raw = np.frombuffer(scan, np.uint8, count=-(-k * BLOCK_BITS // 8), offset=first)
        bits = np.unpackbits(raw)[: k * BLOCK_BITS].reshape(k, BLOCK_BITS)
        head = np.packbits(bits[:, :DC_BITS], axis=1).astype(np.int16)  # 8 bits, then 2 at the top of the next byte
        diff = _DC_BACK[(head[:, 0] << 2) | (head[:, 1] >> 6)]
        ac = bits[:, DC_BITS:].reshape(-1, AC_BITS)
        value = _AC_BACK[(np.packbits(ac[:, :8], axis=1)[:, 0].astype(np.int16) << 1) | ac[:, 8]]
        if value.min(initial=0) < 0 or diff.min(initial=0) < -256:
            return None
        out[at : at + k, 1:] = _COEF[value].reshape(k, 63)
        out[at : at + k, 0] = before + np.cumsum(diff)
        before = int(out[at + k - 1, 0])
    return out


def decode(data: bytes) -> Image:
    """Parse the markers of a baseline JPEG and decode its scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, huff, frame, comment, restart = 2, {}, {}, None, b"", 0
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = data[at + 1]
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, which, body = body[0] >> 4, body[0] & 15, body[1:]
                quant[which] = np.frombuffer(body[: 64 << wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[64 << wide :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                huff[body[0]] = (counts, list(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xC0:
            _, high, wide, n = struct.unpack(">BHHB", body[:6])
            frame = (high, wide, [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(n)])
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only baseline files are read")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            break
    if frame is None:
        raise ValueError("no frame before the scan")
    high, wide, comps = frame
    uses = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if set(uses) != {c[0] for c in comps}:
        raise ValueError("one interleaved scan is expected")
    end = data.rfind(b"\xff\xd9")
    scan = data[at : end if end >= at else len(data)]
    hs, vs = [c[1] >> 4 for c in comps], [c[1] & 15 for c in comps]
    if len(comps) == 1:
        hs = vs = [1]
    mcu_w, mcu_h = -(-wide // (8 * max(hs))), -(-high // (8 * max(vs)))
    coef = None
    own = len(comps) == 1 and not restart and huff.get(uses[comps[0][0]] >> 4) == (_DC_TABLE[0] + [0] * 6, _DC_TABLE[1]) and huff.get(0x10 | uses[comps[0][0]] & 15) == (_AC_TABLE[0] + [0] * 7, _AC_TABLE[1])
    if own:
        coef = _by_array(scan.replace(b"\xff\x00", b"\xff"), mcu_w * mcu_h)
    if coef is None:
        coef = _by_symbol(scan, comps, uses, huff, hs, vs, mcu_w, mcu_h, restart)
    rows, cols = mcu_h * vs[0], mcu_w * hs[0]
    luma = np.clip(np.rint(coef[:, 0].astype(np.float64) * quant[comps[0][2]][0] / 8) + 128, 0, 255).astype(np.uint8)
    used_h = min(rows, -(-high * vs[0] // (8 * max(vs))))
    used_w = min(cols, -(-wide * hs[0] // (8 * max(hs))))
    return Image(wide, high, luma.reshape(rows, cols)[:used_h, :used_w], coef, comment)


def _by_symbol(scan, comps, uses, huff, hs, vs, mcu_w, mcu_h, restart) -> np.ndarray:
    """Coefficients of the first component, for any Huffman tables, sampling
    factors and restart interval."""
    parts, last, i = [], 0, 0
    while (i := scan.find(b"\xff", i)) >= 0 and i + 1 < len(scan):
        if 0xD0 <= scan[i + 1] <= 0xD7:
            parts.append(scan[last:i])
            last = i + 2
        i += 2
    parts = [p.replace(b"\xff\x00", b"\xff") for p in [*parts, scan[last:]]]
    tables = [(_codes(*huff[uses[c[0]] >> 4]), _codes(*huff[0x10 | uses[c[0]] & 15])) for c in comps]
    out = np.zeros((mcu_h * vs[0], mcu_w * hs[0], BLOCK), np.int16)
    bits, dc = _Bits(parts[0]), [0] * len(comps)
    for m in range(mcu_w * mcu_h):
        if restart and m and m % restart == 0:
            bits, dc = _Bits(parts[m // restart]), [0] * len(comps)
        for c, (dc_codes, ac_codes) in enumerate(tables):
            for y in range(vs[c]):
                for x in range(hs[c]):
                    block = [0] * BLOCK
                    dc[c] += bits.signed(bits.symbol(dc_codes))
                    block[0], k = dc[c], 1
                    while k < BLOCK:
                        s = bits.symbol(ac_codes)
                        if s == 0:
                            break
                        k += s >> 4
                        if s != 0xF0:
                            if k >= BLOCK:
                                raise ValueError("a run leaves its block")
                            block[k] = bits.signed(s & 15)
                        k += 1
                    if c == 0:
                        out[m // mcu_w * vs[0] + y, m % mcu_w * hs[0] + x] = block
    return out.reshape(-1, BLOCK)


def payload_of(image: Image) -> bytes:
    """The bytes that `encode` stored."""
    n = int(image.comment.removeprefix(b"payload="))
    back = _BYTE[image.coefficients[: n // BLOCK] + 128]
    if back.min(initial=0) < 0:
        raise ValueError("a coefficient holds no byte")
    return back.astype(np.uint8).tobytes()


def average_hash(luma: np.ndarray) -> str:
    """64 bits: cells of an 8 x 8 grid over the thumbnail brighter than its mean."""
    h, w = luma.shape
    rows, cols = np.arange(8) * h // 8, np.arange(8) * w // 8
    at = np.ix_(rows, cols)
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = luma.cumsum(0, dtype=np.float64).cumsum(1)
    r1, c1 = np.maximum(rows + 1, (np.arange(8) + 1) * h // 8), np.maximum(cols + 1, (np.arange(8) + 1) * w // 8)
    area = (r1 - rows)[:, None] * (c1 - cols)[None, :]
    grid = (total[np.ix_(r1, c1)] - total[np.ix_(rows, c1)] - total[np.ix_(r1, cols)] + total[at]) / area
    return np.packbits(grid > grid.mean()).tobytes().hex()


def feature(image: Image) -> str:
    """Dimensions, average hash and digest of the thumbnail."""
    digest = hashlib.sha256(struct.pack(">II", *image.luma.shape) + image.luma.tobytes()).hexdigest()
    return f"{image.width}x{image.height}:{average_hash(image.luma)}:{digest[:16]}"


FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("feature", T.StringType()),
])


def jpeg_features(df: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """Dimensions and thumbnail hashes of a binary column of baseline JPEGs;
    null where the value is null or not a readable baseline file."""
    small_batches(df.sparkSession, 200)

    def read(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                try:
                    image = decode(value.as_py())
                    rows.append((image.width, image.height, feature(image)))
                except (ValueError, KeyError, IndexError, TypeError, struct.error):
                    rows.append((None, None, None))
            w, h, f = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(f, pa.string())], names=FEATURES.names)

    return df.selectExpr(f"cast(`{id_column}` as bigint) as doc_id", f"cast(`{media_column}` as binary) as media").mapInArrow(read, FEATURES)


STORED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("media", T.BinaryType()),
])


def store_text(df: DataFrame) -> DataFrame:
    """Every text, padded with zeros, in a JPEG of its own."""
    small_batches(df.sparkSession, 500)

    def write(batches):
        for batch in batches:
            texts = [(v or "").encode() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(pad(t)) for t in texts], pa.binary())], names=STORED.names)

    return df.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(write, STORED)


DIGEST = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
])


def digest_stored(df: DataFrame) -> DataFrame:
    """Read the media column of `store_text` back; digests of the payload, of
    the stored form and of the thumbnail."""

    def read(batches):
        for batch in batches:
            rows = []
            for media in batch.column(2).to_pylist():
                image = decode(media)
                back = payload_of(image)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(image)))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=DIGEST.names)

    return df.select("doc_id", "n_bytes", "media").mapInArrow(read, DIGEST)
