"""Media columns: baseline JPEG (operator 10).

A text is stored losslessly as a baseline JPEG whose quantised coefficients are its bytes: 64 bytes a block, in
zigzag order, quantiser 1, one component, a restart marker after every block.  The reader parses the markers,
Huffman-decodes the scan and rebuilds a DC-only luminance thumbnail (one pixel a block), of which it keeps hashes.

Decoding is sequential in a restart segment only, so all segments of a batch of images are decoded in step, one symbol
of each at a time, in numpy.  The reader takes any baseline JPEG (8 bits, Huffman, interleaved components with
subsampling, with or without restart markers); what it can't read raises ``ValueError``.

Null text is empty: one block of zeros.  Equal texts give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netspark.llm.common import slices, stored, table, whole_texts

BLOCK, BATCH_BYTES = 64, 2 << 20


# ---- Huffman tables


class Huffman:
    """Codes of a table given as symbols by code length (1 to 16)."""

    def __init__(self, by_length: list[list[int]]):
        self.by_length = by_length
        self.code, self.bits = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        self.peek = np.zeros(1 << 16, np.int32)  # of 16 bits: length << 8 | symbol, 0: no code
        code = 0
        for size, symbols in enumerate(by_length, 1):
            for s in symbols:
                self.code[s], self.bits[s] = code, size
                self.peek[code << 16 - size : code + 1 << 16 - size] = size << 8 | s
                code += 1
            code <<= 1

    @classmethod
    def parse(cls, counts: bytes, symbols: bytes) -> Huffman:
        at, out = 0, []
        for n in counts:
            out.append(list(symbols[at : at + n]))
            at += n
        return cls(out)

    def segment(self, kind: int) -> bytes:
        body = bytes([kind]) + bytes(len(x) for x in self.by_length) + bytes(s for x in self.by_length for s in x)
        return struct.pack(">BBH", 0xFF, 0xC4, len(body) + 2) + body

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of 16 bits: bits of code and value together (0: no code), zeros before the value, the value if they hold it."""
        size, symbol = self.peek >> 8, self.peek & 255
        extra = symbol & 15
        total = np.where(size > 0, size + extra, 0)
        here = np.arange(1 << 16)
        raw = (here >> np.maximum(0, 16 - total)) & ((1 << extra) - 1)
        value = np.where(extra == 0, 0, np.where(raw >> np.maximum(0, extra - 1), raw, raw - (1 << extra) + 1))
        return total.astype(np.int64), (symbol >> 4).astype(np.int64), value.astype(np.int16)


def _text_tables() -> tuple[Huffman, Huffman]:
    """DC and AC tables under which a letter, a digit or a space takes eight bits."""
    dc = [[], [7, 6], [8], [5], [0, 4], [3, 2, 1]] + [[] for _ in range(10)]
    short = {1: [0x07], 2: [0x06], 3: [0x08], 5: [0x00, 0x05], 6: [0x04, 0x03]}
    used = {s for x in short.values() for s in x}
    rest = [s for s in [r << 4 | n for r in range(16) for n in range(1, 11)] + [0xF0] if s not in used]
    return Huffman(dc), Huffman([short.get(n, rest if n == 13 else []) for n in range(1, 17)])


DC, AC = _text_tables()


# ---- writing


def _head(n_bytes: int, wide: int, high: int) -> bytes:
    seg = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    return b"".join(
        [
            b"\xff\xd8",
            seg(0xFE, b"bytes" + struct.pack(">Q", n_bytes)),
            seg(0xDB, b"\0" + b"\1" * 64),
            seg(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + bytes([1, 0x11, 0])),
            DC.segment(0x00),
            AC.segment(0x10),
            seg(0xDD, struct.pack(">H", 1)),
            seg(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def _entropy(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each block's code (rows, padded) and how many, before stuffing."""
    n = len(blocks)
    size = np.array([int(v).bit_length() for v in range(256)])
    plain_code = (AC.code[size] << size.astype(np.uint64)) | np.arange(256, dtype=np.uint64)
    plain_bits = (AC.bits[size] + size).astype(np.uint64)
    out, at = np.zeros((n, 228), np.uint8), np.zeros(n, np.int64)
    acc, held = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    rows = np.arange(n)

    def flush() -> None:
        full = np.flatnonzero(held >= 32)
        if len(full):
            held[full] -= np.uint64(32)
            word = (acc[full] >> held[full]).astype(">u4")
            out[rows[full][:, None], at[full][:, None] + np.arange(4)] = word.view(np.uint8).reshape(-1, 4)
            at[full] += 4

    first = blocks[:, 0]
    acc |= (DC.code[size[first]] << size[first].astype(np.uint64)) | first.astype(np.uint64)
    held += (DC.bits[size[first]] + size[first]).astype(np.uint64)
    hollow = np.flatnonzero((blocks[:, 1:] == 0).any(1))
    some = blocks[hollow]
    last = np.where((some[:, 1:] > 0).any(1), 63 - np.argmax(some[:, :0:-1] > 0, axis=1), 0)
    run = np.zeros(len(hollow), np.int64)
    for k in range(1, 64):
        v = blocks[:, k]
        code, bits = plain_code[v], plain_bits[v]
        if len(hollow):
            u = some[:, k].astype(np.int64)
            symbol = np.where(u > 0, run << 4 | size[u], 0xF0)
            send = (u > 0) | ((run == 15) & (k < last))
            code[hollow] = np.where(send, (AC.code[symbol] << size[u].astype(np.uint64)) | u.astype(np.uint64), 0)
            bits[hollow] = np.where(send, AC.bits[symbol] + size[u], 0)
            run = np.where(send, 0, run + 1)
        acc = acc << bits | code
        held += bits
        flush()
    short = hollow[last < 63]
    acc[short] = acc[short] << np.uint64(AC.bits[0]) | AC.code[0]
    held[short] += np.uint64(AC.bits[0])
    flush()
    pad = (np.uint64(8) - held % np.uint64(8)) % np.uint64(8)
    acc = acc << pad | (np.uint64(1) << pad) - np.uint64(1)
    held += pad
    while (left := np.flatnonzero(held > 0)).size:
        held[left] -= np.uint64(8)
        out[left, at[left]] = (acc[left] >> held[left]).astype(np.uint8)
        at[left] += 1
    return out, at


def encode_many(texts: list[bytes]) -> list[bytes]:
    """A JPEG of each byte string."""
    n_blocks = [max(1, -(-len(t) // BLOCK)) for t in texts]
    wide = [min(8191, int(np.ceil(np.sqrt(n)))) for n in n_blocks]
    high = [-(-n // w) for n, w in zip(n_blocks, wide)]
    if any(h > 8191 for h in high):
        raise ValueError("more than 4 GB in one image")
    cells = np.array([w * h for w, h in zip(wide, high)])
    raw = np.frombuffer(b"".join(t + bytes(BLOCK * int(c) - len(t)) for t, c in zip(texts, cells)), np.uint8).reshape(-1, BLOCK)
    code, size = _entropy(raw)
    # stuffing: a zero after every 255; then a restart marker after every block but an image's last
    valid = np.arange(code.shape[1]) < size[:, None]
    flat = code[valid]
    full = flat == 255
    ends = np.cumsum(size)
    stuffed = np.cumsum(np.concatenate([[0], full]))
    place = np.arange(len(flat)) + stuffed[:-1] + 2 * np.repeat(np.arange(len(size)), size)
    out = np.zeros(len(flat) + int(stuffed[-1]) + 2 * len(size), np.uint8)
    out[place] = flat
    block_ends = ends + stuffed[ends] + 2 * np.arange(len(size))
    first = np.cumsum(cells) - cells
    number = np.arange(len(size)) - np.repeat(first, cells)
    out[block_ends], out[block_ends + 1] = 0xFF, 0xD0 + number % 8
    files, at = [], 0
    for t, w, h, end in zip(texts, wide, high, (first + cells - 1).tolist()):
        stop = int(block_ends[end])
        files.append(_head(len(t), w, h) + out[at:stop].tobytes() + b"\xff\xd9")
        at = stop + 2
    return files


# ---- reading


class Frame(NamedTuple):
    wide: int
    high: int
    parts: tuple  # of each component: id, horizontal and vertical sampling, quantiser, DC table, AC table
    quant: dict
    tables: dict
    key: bytes  # equal for images that decode alike
    interval: int
    comment: bytes
    scan: tuple[int, int]


def parse(data: bytes) -> Frame:
    """Markers of a baseline JPEG up to its one scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, quant, tables, comment, interval, shape, parts = 2, {}, {}, b"", 0, None, []
    key = hashlib.blake2b(digest_size=16)
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        if data[at + 1] == 0xFF:
            at += 1
            continue
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            key.update(body)
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("not 8 bits")
            shape = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            if shape is None or body[0] != len(parts):
                raise ValueError("not one interleaved scan")
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            full = tuple((*p, chosen[p[0]] >> 4, chosen[p[0]] & 15) for p in parts)
            key.update(repr(full).encode())
            end = data.rfind(b"\xff\xd9")
            if end < at:
                raise ValueError("no end")
            return Frame(shape[1], shape[0], full, quant, tables, key.digest(), interval, comment, (at + 2 + size, end))
        at += 2 + size
    raise ValueError("no scan")


def _grid(f: Frame) -> tuple[int, int, int, int]:
    """Most sampling across and down; MCUs across and down."""
    sh, sv = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
    if len(f.parts) == 1:
        sh = sv = 1
    return sh, sv, -(-f.wide // (8 * sh)), -(-f.high // (8 * sv))


def _decode_alike(files: list[bytes], frames: list[Frame]) -> list[np.ndarray]:
    """Coefficients (MCU, block of the MCU, zigzag place) of images with equal tables and components."""
    f = frames[0]
    one = len(f.parts) == 1
    layout = [(i, p[4], p[5]) for i, p in enumerate(f.parts) for _ in range(1 if one else p[1] * p[2])]
    mcus = [g[2] * g[3] for g in map(_grid, frames)]
    # entropy bytes of all images without stuffing and markers; where each restart segment starts
    raw = np.concatenate([np.frombuffer(d, np.uint8, x.scan[1] - x.scan[0], x.scan[0]) for d, x in zip(files, frames)])
    sizes = np.array([x.scan[1] - x.scan[0] for x in frames])
    begins = np.cumsum(sizes) - sizes
    full = np.flatnonzero(raw[:-1] == 255)
    after = raw[full + 1]
    marks = full[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[full[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    starts = np.sort(np.concatenate([begins, marks + 2]))
    image = np.searchsorted(begins, starts, "right") - 1
    clean = np.concatenate([raw[keep], np.full(16, 255, np.uint8)])
    offset = np.cumsum(keep) - keep
    pos = np.where(starts < len(raw), offset[np.minimum(starts, len(raw) - 1)], len(clean) - 16).astype(np.int64) * 8
    order = np.arange(len(starts)) - np.searchsorted(image, image)  # segment's number in its image
    step = np.array([x.interval or m for x, m in zip(frames, mcus)])[image]
    todo = np.minimum(step, np.array(mcus)[image] - order * step)
    if (todo <= 0).any() or (np.bincount(image, weights=todo, minlength=len(frames)) != mcus).any():
        raise ValueError("restart markers don't match the size")
    base = np.cumsum(mcus) - mcus
    target = base[image] + order * step
    word = np.ndarray((len(clean) - 8,), ">u8", clean.tobytes(), 0, (1,)).astype(np.uint64)
    tables = {k: Huffman.parse(*v).steps() for k, v in f.tables.items()}
    out = np.zeros((int(sum(mcus)), len(layout), 64), np.int16)
    flat = out.reshape(-1)
    pred = np.zeros((len(f.parts), len(starts)), np.int64)

    def take(lane_pos: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total, zeros, value = table
        w = word[lane_pos >> 3] << (lane_pos & 7).astype(np.uint64)
        top = (w >> np.uint64(48)).astype(np.int64)
        n, v, z = total[top], value[top], zeros[top]
        if (n == 0).any():
            raise ValueError("no such code")
        if (n > 16).any():  # the value goes on beyond the 16 bits
            long = np.flatnonzero(n > 16)
            symbol_bits = long_bits[id(table)][top[long]]
            extra = (n[long] - symbol_bits).astype(np.uint64)
            got = (w[long] << symbol_bits.astype(np.uint64) >> (np.uint64(64) - extra)).astype(np.int64)
            v = v.astype(np.int64)
            v[long] = np.where(got >> (extra.astype(np.int64) - 1), got, got - (1 << extra.astype(np.int64)) + 1)
        return n, v, z

    peeks = {k: Huffman.parse(*v).peek >> 8 for k, v in f.tables.items()}
    long_bits = {id(tables[k]): peeks[k] for k in tables}
    for m in range(int(todo.max())):
        live = np.flatnonzero(todo > m)
        for b, (part, dc, ac) in enumerate(layout):
            n, v, _ = take(pos[live], tables[dc])
            pos[live] += n
            pred[part, live] += v
            cell = ((target[live] + m) * len(layout) + b) * 64
            flat[cell] = pred[part, live]
            p, k, lanes = pos[live], np.ones(len(live), np.int64), live
            table = tables[16 | ac]
            while len(lanes):
                n, v, z = take(p, table)
                p = p + n
                end = (v == 0) & (z == 0)
                if end.any():
                    pos[lanes[end]] = p[end]
                    go = ~end
                    p, k, lanes, cell, v, z = p[go], k[go], lanes[go], cell[go], v[go], z[go]
                k = k + z
                if (k > 63).any():
                    raise ValueError("too many coefficients")
                flat[cell + k] = v
                k += 1
                done = k > 63
                if done.any():
                    pos[lanes[done]] = p[done]
                    go = ~done
                    p, k, lanes, cell = p[go], k[go], lanes[go], cell[go]
    return [out[a : a + n] for a, n in zip(base.tolist(), mcus)]


def decode_many(files: list[bytes]) -> list[tuple[Frame, np.ndarray]]:
    """Frame and coefficients of each image; images that decode alike go in step."""
    frames = list(map(parse, files))
    alike = defaultdict(list)
    for i, f in enumerate(frames):
        alike[f.key].append(i)
    out: list = [None] * len(files)
    for members in alike.values():
        for i, c in zip(members, _decode_alike([files[i] for i in members], [frames[i] for i in members])):
            out[i] = (frames[i], c)
    return out


def thumbnail(f: Frame, coefficients: np.ndarray) -> np.ndarray:
    """Luminance of each 8 x 8 block from its DC coefficient (mean of the block), as 8-bit grey."""
    _, _, across, down = _grid(f)
    h, v = (1, 1) if len(f.parts) == 1 else f.parts[0][1:3]
    dc = coefficients[:, : h * v, 0].astype(np.int32) * int(f.quant[f.parts[0][3]][0])
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    return np.clip((grid + 4) // 8 + 128, 0, 255).astype(np.uint8)


def feature(f: Frame, coefficients: np.ndarray) -> str:
    """Dimensions, mean hash and gradient hash of the thumbnail, and its checksum."""
    t = thumbnail(f, coefficients)
    rows, cols = np.arange(8) * t.shape[0] // 8, np.arange(9) * t.shape[1] // 9
    small = t[rows][:, cols].astype(np.int32)
    mean = small[:, :8] * 64 > small[:, :8].sum()
    steps = small[:, 1:] > small[:, :-1]
    a, d = (np.packbits(x).tobytes().hex() for x in (mean, steps))
    return f"{f.wide}x{f.high}:{a}:{d}:{zlib.crc32(t.tobytes()):08x}"


def payload(f: Frame, coefficients: np.ndarray) -> tuple[bytes, int]:
    """The stored bytes, padded to a positive multiple of 64, and how many there are without padding."""
    if f.comment[:5] != b"bytes":
        raise ValueError("no stored text")
    n = struct.unpack(">Q", f.comment[5:13])[0]
    return coefficients.astype(np.uint8).tobytes()[: BLOCK * max(1, -(-n // BLOCK))], n


# ---- operators


def _packs(rows: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of rows of bounded size (one longer row is a run of its own)."""
    start = size = 0
    for i, r in enumerate(rows):
        if size and size + len(r) > BATCH_BYTES:
            yield start, i
            start, size = i, 0
        size += len(r) + BLOCK
    if start < len(rows):
        yield start, len(rows)


_MEDIA = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])
_READ = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def to_media(docs: DataFrame) -> DataFrame:
    """``(doc_id, media)``: every whole text as a JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            ids, texts = b.column(0), [t.encode() for t in b.column(1).to_pylist()]
            for i, j in _packs(texts):
                yield table(_MEDIA, ids.slice(i, j - i), encode_many(texts[i:j]))

    return whole_texts(docs).mapInArrow(run, "doc_id long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Per stored image: sizes and digests of the payload read back, and its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            ids, files = b.column(0), b.column(1).to_pylist()
            for i, j in _packs(files):
                rows = []
                for file, (f, c) in zip(files[i:j], decode_many(files[i:j])):
                    raw, n = payload(f, c)
                    rows.append((n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-BLOCK:]), len(file), hashlib.sha256(file).hexdigest(), feature(f, c)))
                yield table(_READ, ids.slice(i, j - i), *zip(*rows))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, schema)


def media_features(docs: DataFrame) -> DataFrame:
    """Stores every text and reads the stored files back."""
    return read_media(stored(to_media(docs), "media"))
