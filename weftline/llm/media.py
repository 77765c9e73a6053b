"""Operator 7: media columns as AVI motion JPEG.

Writing: the payload's bytes are the quantised coefficients of 8x8 luma blocks, 64 a block, in zigzag order. Both
Huffman tables hold the one symbol "no zeros before it, 8 more bits", coded by one bit, and each block is a restart
interval, so a byte b takes 9 bits and is the coefficient b (b >= 128) or b - 255. The quantisation table is all ones:
nothing is lost. A comment segment tells how many blocks of a frame carry payload; the rest are zeros.

Reading: RIFF chunks and the idx1 index give the frames (without an index the movi list is walked), each JPEG is
decoded to coefficients and pixels, and shots start where the histogram difference of neighbouring frames rises above
an adaptive threshold: mean plus three deviations of the last differences within the shot, and at least a tenth.

Defined cases: null text is the empty text, whose payload is 64 zero bytes; no text makes no frame less than one.
Very long texts are worked on 64 frames at a time. Repeated rows give repeated results; extra columns are ignored.
Null or damaged media give a row whose error column is set and no clips.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, slices

#: Blocks in a row and at most in a column of a frame.
ACROSS, DOWN = 8, 8
RATE = 25
#: Frames that are held at once.
GROUP = 64
#: The order of a block's coefficients in a JPEG scan.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_COSINES = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)


class MediaError(ValueError):
    """Bytes that are no AVI file or JPEG frame of the kind that this module reads."""


def payload(text: str | None) -> tuple[bytes, int]:
    """The text as UTF-8, followed by zeros up to a positive multiple of 64, and the length without them."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % 64 if data else 64), len(data)


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def _head(rows: int, used: int) -> bytes:
    one = bytes([1]) + bytes(15) + bytes([8])
    return b"".join([
        b"\xff\xd8", _segment(0xFE, b"blocks=%d" % used), _segment(0xDB, bytes([0]) + bytes([1]) * 64),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, ACROSS * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, bytes([0x00]) + one), _segment(0xC4, bytes([0x10]) + one),
        _segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def _scans(blocks: np.ndarray, each: int) -> Iterator[bytes]:
    """Entropy-coded data of frames of each blocks, with stuffing and restart marks."""
    n = len(blocks)
    bits = np.zeros((n * 64, 9), np.uint8)
    bits[:, 1:] = np.unpackbits(blocks.reshape(-1, 1), axis=1)
    coded = np.packbits(bits.reshape(n, 576), axis=1)
    rows, keep = np.zeros((n, 146), np.uint8), np.zeros((n, 146), bool)
    rows[:, 0:144:2], keep[:, 0:144:2], keep[:, 1:144:2] = coded, True, coded == 0xFF
    place = np.arange(n) % each
    rows[:, 144], rows[:, 145] = 0xFF, 0xD0 + place % 8
    keep[:, 144:] = (place < each - 1)[:, None]
    for f in range(0, n, each):
        yield rows[f : f + each][keep[f : f + each]].tobytes()


def write_avi(data: bytes) -> bytes:
    """An AVI file of motion-JPEG frames that hold data, whose length is a multiple of 64."""
    total = len(data) // 64
    rows = max(1, min(DOWN, -(-total // ACROSS)))
    each = rows * ACROSS
    frames: list[bytes] = []
    for g in range(0, max(total, 1), GROUP * each):
        blocks = np.frombuffer(data, np.uint8, count=min(GROUP * each, total - g) * 64, offset=g * 64).reshape(-1, 64)
        full = np.zeros((-(-len(blocks) // each) * each, 64), np.uint8)
        full[: len(blocks)] = blocks
        for k, scan in enumerate(_scans(full, each)):
            frames.append(_head(rows, min(each, len(blocks) - k * each)) + scan + b"\xff\xd9")
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, ACROSS * 8, rows * 8, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, ACROSS * 8, rows * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, ACROSS * 8, rows * 8, 1, 8, b"MJPG", ACROSS * rows * 64, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    body, index, at = [b"movi"], [], 4
    for x in frames:
        body.append(made := chunk(b"00dc", x))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        at += len(made)
    inner = b"AVI " + header + chunk(b"LIST", b"".join(body)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", inner)


def _chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks between start and end."""
    while start + 8 <= end:
        name, size = data[start : start + 4], int.from_bytes(data[start + 4 : start + 8], "little")
        if start + 8 + size > end:
            raise MediaError("a chunk passes the end of what holds it")
        yield name, start + 8, start + 8 + size
        start += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """(frames a second, JPEG frames) by the index, else by walking the movi list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise MediaError("no RIFF file of the kind AVI")
    rate, movi, index = float(RATE), None, None
    todo = [(12, 8 + int.from_bytes(data[4:8], "little"))]
    if todo[0][1] > len(data):
        raise MediaError("the file is shorter than it says")
    while todo:
        for name, a, b in _chunks(data, *todo.pop()):
            if name == b"LIST" and data[a : a + 4] == b"movi":
                movi = (a, b)
            elif name == b"LIST":
                todo.append((a + 4, b))
            elif name == b"strh" and data[a : a + 4] == b"vids":
                scale, per = struct.unpack_from("<II", data, a + 20)
                rate = per / scale if scale else rate
            elif name == b"idx1":
                index = (a, b)
    if movi is None:
        raise MediaError("no movi list")
    if index:
        found = []
        for name, _, at, size in struct.iter_unpack("<4sIII", data[slice(*index)]):
            if name[2:] in (b"dc", b"db"):
                a = movi[0] + at + 8
                if a + size > movi[1]:
                    raise MediaError("the index points outside the movi list")
                found.append(data[a : a + size])
        return rate, found
    return rate, [data[a:b] for name, a, b in _chunks(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]


def _codes(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol of a Huffman table."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _any_scan(parts: list[bytes], tables: dict, units: list[tuple[int, int, int]], total: int) -> np.ndarray:
    """Zigzag coefficients of the first component's blocks, by any Huffman tables. units: component, DC and AC table of an MCU's blocks."""
    out: list[list[int]] = []
    want = 0
    for part in parts:
        bits, at, last = np.unpackbits(np.frombuffer(part, np.uint8)).tolist(), 0, {}

        def symbol(table):
            nonlocal at
            code = 0
            for length in range(1, 17):
                if at >= len(bits):
                    return None
                code = code << 1 | bits[at]
                at += 1
                if (length, code) in table:
                    return table[length, code]
            raise MediaError("no such Huffman code")

        def more(size):
            nonlocal at
            v = int("".join(map(str, bits[at : at + size])) or "0", 2)
            at += size
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        done = False
        while not done and want < total:
            for c, dc, ac in units:
                size = symbol(tables[0, dc])
                if size is None or (at + size > len(bits)):
                    done = True
                    break
                block = [0] * 64
                last[c] = block[0] = last.get(c, 0) + more(size)
                k = 1
                while k < 64:
                    s = symbol(tables[1, ac])
                    if s is None:
                        raise MediaError("the scan ends within a block")
                    if not s & 15:
                        if s >> 4 < 15:
                            break
                        k += 16
                        continue
                    k += s >> 4
                    if k > 63:
                        raise MediaError("a block of more than 64 coefficients")
                    block[k] = more(s & 15)
                    k += 1
                if c == units[0][0]:
                    out.append(block)
            else:
                want += 1
    return np.array(out, np.int32).reshape(-1, 64)


def read_jpeg(data: bytes) -> tuple[np.ndarray, np.ndarray, int, int, int | None]:
    """(zigzag coefficients of the first component's blocks, its quantisation table in that order, height, width, payload blocks if told) of a baseline frame."""
    if data[:2] != b"\xff\xd8":
        raise MediaError("no JPEG image")
    at, quant, tables, used, size, parts, one_bit = 2, {}, {}, None, None, [], True
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise MediaError("a JPEG marker is missing")
        mark, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if mark == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                one_bit &= body[1:17] == b"\x01" + bytes(15) and body[17] == 8
                tables[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xC0 or mark == 0xC1:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            size, parts = (height, width), [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise MediaError("no baseline JPEG")
        elif mark == 0xFE and body.startswith(b"blocks="):
            used = int(body[7:])
        elif mark == 0xDA:
            break
    if size is None or not parts:
        raise MediaError("no frame header")
    chosen = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
    scan = np.frombuffer(data, np.uint8, offset=at)
    marks = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[marks + 1]
    ends = marks[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    stop = int(ends[0]) if len(ends) else len(scan)
    inside = marks < stop
    marks, after = marks[inside], after[inside]
    restarts = marks[after != 0]
    keep = np.ones(stop, bool)
    keep[marks[after == 0] + 1] = False
    if one_bit and len(parts) == 1:
        keep[restarts] = keep[restarts + 1] = False
        bits = np.unpackbits(scan[:stop][keep])
        if len(bits) % 576 or bits.reshape(-1, 9)[:, 0].any():
            raise MediaError("the scan ends within a block")
        value = np.packbits(bits.reshape(-1, 9)[:, 1:], axis=1).reshape(-1, 64).astype(np.int32)
        value -= (value < 128) * 255
        return value, quant[parts[0][3]], *size, used
    edges = [0, *(restarts + 2).tolist(), stop + 2]
    runs = [scan[a : b - 2][keep[a : b - 2]].tobytes() for a, b in zip(edges, edges[1:])]
    alone = len(parts) == 1
    most = (max(p[1] for p in parts), max(p[2] for p in parts))
    units = [(p[0], *chosen[p[0]]) for p in parts for _ in range(1 if alone else p[1] * p[2])]
    reach = (8, 8) if alone else (8 * most[1], 8 * most[0])
    return _any_scan(runs, tables, units, -(-size[0] // reach[0]) * -(-size[1] // reach[1])), quant[parts[0][3]], *size, used


def stored(frames: list[np.ndarray], used: list[int | None]) -> bytes:
    """The payload that write_avi() stored in these frames' coefficients."""
    return b"".join((x + (x < 0) * 255).astype(np.uint8)[:n].tobytes() for x, n in zip(frames, used))


def pixels(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(n, 8, 8) luma samples, each block by itself."""
    square = np.zeros((len(blocks), 64), np.float32)
    square[:, ZIGZAG] = blocks * quant
    return np.clip(np.rint(_COSINES.T @ square.reshape(-1, 8, 8) @ _COSINES) + 128, 0, 255).astype(np.uint8)


def shots(histograms: np.ndarray, past: int = 8) -> list[tuple[int, int]]:
    """(first frame, end) of shots; a histogram is a row of shares."""
    n = len(histograms)
    gaps = (np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2).tolist() if n > 1 else []
    starts, seen = [0], []
    for i, gap in enumerate(gaps, 1):
        recent = seen[-past:]
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if recent and gap > max(0.1, mean + 3 * spread):
            starts.append(i)
            seen = []
        else:
            seen.append(gap)
    return list(zip(starts, [*starts[1:], n])) if n else []


def examine(data: bytes) -> tuple[bytes, list[tuple[int, int, float, float]], np.ndarray]:
    """(stored payload, clips as (first frame, end frame, start and end in seconds), counts of 16 luma bins over all frames)."""
    rate, frames = read_avi(data)
    kept, rows, total = [], [], np.zeros(16, np.int64)
    for g in range(0, len(frames), GROUP):
        read = [read_jpeg(x) for x in frames[g : g + GROUP]]
        blocks = [x[0] for x in read]
        kept.append(stored(blocks, [x[4] for x in read]))
        if len({(x[0].shape, x[1].tobytes()) for x in read}) == 1:
            bins = (pixels(np.concatenate(blocks), read[0][1]) >> 4).reshape(len(read), -1)
        else:
            bins = [(pixels(x[0], x[1]) >> 4).ravel() for x in read]
        for x in bins:
            total += (count := np.bincount(x, minlength=16))
            rows.append(count / max(1, len(x)))
    return b"".join(kept), [(a, b, a / rate, b / rate) for a, b in shots(np.array(rows))], total


def to_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media binary): each text stored as an AVI file."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 1 << 22):
                made = [payload(x) for x in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([n for _, n in made], pa.int64()), pa.array([write_avi(x) for x, _ in made], pa.binary())], names=[key, "n_bytes", "media"])

    return arrow_map(df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")), run, f"`{key}` {kind}, n_bytes long, media binary")


def clips(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, clip, first_frame, end_frame, start_s, end_s, error): one row for each shot, or one with the error."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    data = x.as_py()
                    if data is None:
                        raise MediaError("no media")
                    rows += [(k, i, *clip, None) for i, clip in enumerate(examine(data)[1])]
                except (MediaError, struct.error, KeyError, IndexError, ValueError) as e:
                    rows.append((k, None, None, None, None, None, str(e) or type(e).__name__))
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[key, "clip", "first_frame", "end_frame", "start_s", "end_s", "error"])

    return arrow_map(df.select(F.col(key), F.col(media)), run, f"`{key}` {kind.simpleString()}, clip int, first_frame int, end_frame int, start_s double, end_s double, error string")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a text: its length, the payload as read back from its AVI file, that file's digest, and shots and luma as feature."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def row(text: str) -> tuple:
        data, n = payload(text)
        media = write_avi(data)
        back, found, bins = examine(media)
        feature = f"frames={found[-1][1]};shots={len(found)};clips={','.join(f'{a}-{b}' for a, b, _, _ in found)};luma={','.join(map(str, bins.tolist()))}"
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = [row(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=names)

    return arrow_map(df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")), run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
