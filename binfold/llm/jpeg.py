"""Media columns: baseline JPEG whose DC coefficients are the payload.

A grayscale image has one 8x8 block for each payload byte. The quantiser's DC step is 8, so
the block is flat and its 64 samples all have the byte's value: the image decodes to the
payload in any baseline decoder, and the quantised luminance DC coefficients (the format's
unit) hold it without loss. All AC coefficients are 0. A row of blocks is 192 bytes and a
restart interval, which resets the DC prediction and starts on a whole byte; so the scan's
rows are decoded side by side in numpy, a Huffman symbol of every row at a time.

An image has at most 8191 rows of blocks (65,528 pixels); a longer payload is a run of images.

The reader parses the markers (SOI, APPn, COM, DQT, SOF0, DHT, DRI, SOS, RSTn, EOI), builds
the Huffman tables that it finds there and decodes baseline images of one component, or the
first of three (luminance) with any sampling, with restart intervals or without; AC
coefficients are skipped over, as the DC-only thumbnail doesn't need them. Images of the same
tables and layout are decoded together, whatever else a block holds.

A null or empty text is 192 blanks; a text of any length is stored whole. Null media have null
features; of bytes that are no such image, or end early, only media_bytes and media_sha256 are
known. Identifiers may be null or repeat; other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binfold.llm import common
from binfold.llm.common import ragged

WIDE = 192
MOST_ROWS = 65535 // 8
#: Fixed values of the format: the luminance DC table that its standard gives as typical (codes by length 1 to 16, symbols).
DC_LENGTHS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = list(range(12))
#: The one AC symbol in use is the end of a block.
AC_LENGTHS = [1] + [0] * 15
AC_SYMBOLS = [0]


def codes(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol to (code, length)."""
    out, code, at = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[symbols[at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    steps = bytes([8] + [1] * 63)
    return (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + _segment(0xDB, b"\0" + steps)
        + _segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, WIDE * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\0" + bytes(DC_LENGTHS) + bytes(DC_SYMBOLS))
        + _segment(0xC4, b"\x10" + bytes(AC_LENGTHS) + bytes(AC_SYMBOLS))
        + _segment(0xDD, struct.pack(">H", WIDE))
        + _segment(0xDA, b"\1\1\0\0\x3f\0")
    )


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 to 255: the bits of its block and how many."""
    dc, (end, end_n) = codes(DC_LENGTHS, DC_SYMBOLS), codes(AC_LENGTHS, AC_SYMBOLS)[0]
    bits, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, length = dc[n]
        extra = d if d >= 0 else d + (1 << n) - 1
        bits[d + 255] = (code << n | extra) << end_n | end
        sizes[d + 255] = length + n + end_n
    return bits, sizes


_BITS, _SIZES = _tables()


def encode_rows(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entropy-coded bytes of each row of blocks, stuffed, one after another, and their ends."""
    rows = payload.reshape(-1, WIDE).astype(np.int16)
    diff = np.empty_like(rows)
    diff[:, 0] = rows[:, 0] - 128
    np.subtract(rows[:, 1:], rows[:, :-1], out=diff[:, 1:])
    diff += 255
    sizes = _SIZES[diff]
    bits = _BITS[diff].astype(np.uint64)
    total = sizes.sum(axis=1)
    wide = (total + 7) // 8
    begin = (np.cumsum(wide) - wide) * 8
    at = (np.cumsum(sizes, axis=1) - sizes + begin[:, None]).ravel()
    sizes, bits = sizes.ravel(), bits.ravel()
    # a block has at most 20 bits, so it lies in 4 bytes from the one where it begins
    word = bits << (32 - sizes - (at & 7)).astype(np.uint64)
    byte = at >> 3
    out = np.zeros(int(wide.sum()) + 4, np.uint8)
    for k in range(4):
        part = ((word >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64)
        # bits of different blocks never overlap, so sums are unions
        out += np.bincount(byte + k, part, minlength=len(out)).astype(np.uint8)[: len(out)]
    out = out[:-4]
    ends = np.cumsum(wide)
    # the last byte of a row is filled with ones
    fill = (wide * 8 - total).astype(np.int64)
    out[ends - 1] |= ((1 << fill) - 1).astype(np.uint8)
    stuffed = np.flatnonzero(out == 255)
    if len(stuffed):
        ends = ends + np.searchsorted(stuffed, ends)
        out = np.insert(out, stuffed + 1, 0)
    return out, ends


def encode_payloads(payload: bytes, sizes: list[int]) -> list[bytes]:
    """The images of several payloads, whose sizes are multiples of 192, in one go."""
    data, ends = encode_rows(np.frombuffer(payload, np.uint8))
    starts = np.concatenate([[0], ends[:-1]])
    out, row = [], 0
    raw = data.tobytes()
    for size in sizes:
        parts, last = [], row + size // WIDE
        while row < last:
            n = min(MOST_ROWS, last - row)
            parts.append(_head(n))
            for k in range(n):
                parts.append(raw[starts[row + k] : ends[row + k]])
                parts.append(b"\xff" + bytes([0xD0 + k % 8]) if k < n - 1 else b"\xff\xd9")
            row += n
        out.append(b"".join(parts))
    return out


class Image:
    """The markers of one image that begins at `at`."""

    def __init__(self, data: bytes, at: int) -> None:
        try:
            self._parse(data, at)
        except (struct.error, IndexError, KeyError) as error:
            raise ValueError("the image ends early or lacks a table") from error

    def _parse(self, data: bytes, at: int) -> None:
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no image begins here")
        tables: dict[int, tuple] = {}
        steps: dict[int, int] = {}
        frame: list[tuple[int, int, int, int]] = []  # each component's name, samplings across and down, quantiser
        self.interval, at = 0, at + 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    steps[body[0] & 15] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                    body = body[129 if wide else 65 :]
            elif marker == 0xC0:
                precision, self.height, self.width, parts = struct.unpack_from(">BHHB", body)
                if precision != 8 or parts not in (1, 3) or not self.height or not self.width:
                    raise ValueError("not 8-bit grayscale or of three components")
                frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)]
                if not all(1 <= x <= 4 for part in frame for x in part[1:3]):
                    raise ValueError("a sampling that can't be")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif marker == 0xC4:
                while body:
                    lengths = list(body[1:17])
                    symbols = list(body[17 : 17 + sum(lengths)])
                    tables[body[0]] = (*lengths, *symbols)
                    body = body[17 + sum(lengths) :]
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                break
        scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
        luminance = frame[0]
        if luminance[0] not in scan or len(scan) not in (1, len(frame)):
            raise ValueError("the first scan lacks luminance")
        self.step = steps[luminance[3]]
        across, down = (max(p[i] for p in frame) for i in (1, 2))
        own = [-(-(-(-size * sampling // most)) // 8) for size, sampling, most in ((self.width, luminance[1], across), (self.height, luminance[2], down))]
        self.blocks_wide, self.blocks_high = own
        together = len(scan) > 1
        #: Blocks of luminance in a unit, across and down; units in the image.
        self.unit = (luminance[1], luminance[2]) if together else (1, 1)
        self.units_wide = -(-self.width // (8 * across)) if together else own[0]
        self.units = self.units_wide * (-(-self.height // (8 * down)) if together else own[1])
        #: What decoding goes by: of each component of a unit its blocks and tables.
        self.layout = tuple(((h * v if together else 1), tables[scan[c] >> 4], tables[0x10 | scan[c] & 15]) for c, h, v, _ in frame if c in scan)
        # restart markers and the end bound the intervals; stuffed bytes are FF 00
        self.end = data.find(b"\xff\xd9", at) + 2
        if self.end < 2:
            raise ValueError("the image has no end")
        raw = np.frombuffer(data, np.uint8)[at : self.end]
        marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0) & (raw[1:] != 0xFF))
        last = int(np.flatnonzero((raw[marks + 1] & 0xF8) != 0xD0)[0])
        self.ends = marks[: last + 1] + at
        self.starts = np.concatenate([[at], self.ends[:-1] + 2])
        per = self.interval or self.units
        self.lane_units = np.minimum(per, self.units - np.arange(len(self.starts)) * per)
        if len(self.starts) != -(-self.units // per):
            raise ValueError("intervals are missing")


_lookups: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _lookup(table: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: the symbol and its code's length; 0 for bits that begin no code."""
    if table not in _lookups:
        if len(_lookups) > 100:
            _lookups.clear()
        symbol, size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for s, (code, n) in codes(list(table[:16]), list(table[16:])).items():
            symbol[code << 16 - n : code + 1 << 16 - n], size[code << 16 - n : code + 1 << 16 - n] = s, n
        _lookups[table] = symbol, size
    return _lookups[table]


def thumbnails(data: bytes, images: list[Image]) -> list[np.ndarray | None]:
    """The DC-only luminance samples, row by row of blocks, of images with one layout; None for one that breaks off or has bits of no code."""
    raw = np.frombuffer(data, np.uint8)
    starts = np.concatenate([i.starts for i in images])
    ends = np.concatenate([i.ends for i in images])
    units = np.concatenate([i.lane_units for i in images])
    layout, blocks_of_unit = images[0].layout, images[0].layout[0][0]
    # all intervals one after another without stuffing, and some spare bytes
    scan = raw[ragged(starts, ends - starts)]
    edges = np.concatenate([[0], np.cumsum(ends - starts)])
    stuffed = np.flatnonzero((scan[:-1] == 0xFF) & (scan[1:] == 0)) + 1 if len(scan) > 1 else np.zeros(0, np.int64)
    edges = edges - np.searchsorted(stuffed, edges)
    scan = np.concatenate([np.delete(scan, stuffed), np.zeros(8, np.uint8)]).astype(np.uint32)
    # the 32 bits that begin at each byte
    window = scan[:-3] << 24 | scan[1:-2] << 16 | scan[2:-1] << 8 | scan[3:]
    at, lanes, most = edges[:-1] * 8, len(starts), int(units.max())
    bound = 8 * (len(window) - 1)
    blocks = np.zeros((most * blocks_of_unit, lanes), np.int16)
    last, broken = np.zeros((len(layout), lanes), np.int64), np.zeros(lanes, bool)
    even = bool((units == most).all())
    for k in range(most):
        on = slice(None) if even else np.flatnonzero(units > k)
        for c, (n_blocks, dc_table, ac_table) in enumerate(layout):
            (dc, dc_size), (ac, ac_size) = _lookup(dc_table), _lookup(ac_table)
            for j in range(n_blocks):
                a = np.minimum(at[on], bound)
                bits = (window[a >> 3] << (a & 7).astype(np.uint32)) >> 16  # at least 16 bits are good: 32 less 7, a code of at most 16
                n, size = np.minimum(dc[bits], 15), dc_size[bits]
                wrong = (size == 0) | (dc[bits] > 11)
                a = np.minimum(a + size, bound)
                value = (window[a >> 3].astype(np.int64) >> (32 - n - (a & 7))) & (1 << n) - 1
                a = a + n
                last[c][on] += np.where(value < (1 << n) >> 1, value - (1 << n) + 1, value)
                if c == 0:
                    blocks[k * blocks_of_unit + j][on] = last[0][on]
                # AC coefficients, until each block's end
                todo, place = np.arange(len(a)), np.ones(len(a), np.int64)
                while len(todo):
                    b = np.minimum(a[todo], bound)
                    bits = (window[b >> 3] << (b & 7).astype(np.uint32)) >> 16
                    symbol, size = ac[bits], ac_size[bits]
                    wrong[todo] |= size == 0
                    a[todo] = b + size + (symbol & 15)
                    place = np.where((symbol == 0) | (size == 0), 64, place + (symbol >> 4) + 1)
                    more = place < 64
                    todo, place = todo[more], place[more]
                at[on] = a
                broken[on] |= wrong
    broken |= at > edges[1:] * 8
    out, lane = [], 0
    for i in images:
        n = len(i.starts)
        mine = slice(lane, lane + n)
        lane += n
        if broken[mine].any():
            out.append(None)
            continue
        own = blocks[:, mine].T.reshape(n, most, blocks_of_unit)
        own = own.reshape(-1, blocks_of_unit) if even else own[np.arange(most) < i.lane_units[:, None]]
        level = np.clip((own.astype(np.int32) * i.step + 4 >> 3) + 128, 0, 255).astype(np.uint8)
        across, down = i.unit
        if blocks_of_unit > 1:  # units to rows of blocks
            level = level.reshape(-1, i.units_wide, down, across).transpose(0, 2, 1, 3).reshape(-1, i.units_wide * across)[: i.blocks_high, : i.blocks_wide]
        out.append(level.ravel())
    return out


def read_media(media: list[bytes]) -> list[tuple[bytes, list[Image]] | None]:
    """Each stored form's DC-only samples and images, images of one layout decoded side by side; None for what is no run of images."""
    data = b"".join(media)
    runs: list[list[Image] | None] = []
    at = 0
    for m in media:
        end, run = at + len(m), []
        try:
            while at < end:
                run.append(Image(data, at))
                at = run[-1].end
            runs.append(run if run and at == end else None)
        except ValueError:
            runs.append(None)
        at = end
    alike: dict[tuple, list[Image]] = {}
    for run in runs:
        for i in run or ():
            alike.setdefault(i.layout, []).append(i)
    samples = {id(i): s for group in alike.values() for i, s in zip(group, thumbnails(data, group))}
    out: list[tuple[bytes, list[Image]] | None] = []
    for run in runs:
        parts = [samples[id(i)] for i in run or ()]
        out.append(None if run is None or any(p is None for p in parts) else (b"".join(p.tobytes() for p in parts), run))
    return out


def thumbnail_hash(samples: bytes, wide: int = WIDE) -> str:
    """An 8x8 average hash of the DC-only thumbnail, with its dimensions in blocks: WxH:16 hex digits."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, wide).astype(np.int64)
    n = 1
    for axis in (0, 1):
        size = x.shape[axis]
        edges = np.arange(8) * size // 8
        x = np.add.reduceat(x, np.minimum(edges, size - 1), axis=axis)
        n = n * np.expand_dims(np.maximum(np.diff(np.append(edges, size)), 1), 1 - axis)
    means = x / n
    bits = (means > means.mean()).ravel()
    return f"{wide}x{len(samples) // wide}:{np.packbits(bits).tobytes().hex()}"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a media column: doc_id, n_bytes, media."""

    def work():
        def step(block: pa.RecordBatch) -> pa.RecordBatch:
            raw = [x.encode() for x in common.texts(block, "text")]
            padded = [x + b" " * (-len(x) % WIDE if x else WIDE) for x in raw]
            media = encode_payloads(b"".join(padded), list(map(len, padded)))
            return pa.RecordBatch.from_arrays([block.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

        return step

    return common.map_blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", work, "doc_id long, n_bytes long, media binary", 1 << 20)


def features(media: DataFrame) -> DataFrame:
    """Of each stored form, what its bytes give back: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]

    def work():
        def step(block: pa.RecordBatch) -> pa.RecordBatch:
            stored = block.column(2).to_pylist()
            columns: list[list] = [[] for _ in names[2:]]
            found = iter(read_media([x for x in stored if x is not None]))
            for m in stored:
                values: tuple = (None,) * 8
                if m is not None:
                    read = next(found)
                    values = (None, None, None, len(m), hashlib.sha256(m).hexdigest(), None, None, None)
                    if read is not None:
                        payload, images = read
                        wide = images[0].blocks_wide if len({i.blocks_wide for i in images}) == 1 else len(payload)
                        values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *values[3:5], thumbnail_hash(payload, wide), max(i.width for i in images), sum(i.height for i in images))
                for c, v in zip(columns, values):
                    c.append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([block.column(0), block.column(1), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

        return step

    return common.map_blocks(media, "media", work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long", 1 << 20)
