"""Media columns: AVI motion-JPEG written, read back by its index, decoded, and cut into timed clips.

The writer stores bytes losslessly as 8-bit samples: each byte is the grey level of one 8 x 8
block, 24 x 24 of them a frame, so a block is its DC coefficient alone at quantiser 8. The reader
takes any baseline JPEG frame (Huffman tables, subsampling and restart intervals as in the file) and decodes the
luma of many frames side by side, one symbol of each at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

SIDE = 24
UNIT = SIDE * SIDE
FPS = 25
#: Payload bytes that are coded side by side.
TOGETHER = 1 << 21

# The zigzag order of JPEG coefficients.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])

#: The writer's codes for DC categories 0 to 8 (value, length); a block ends with the one-bit code 0.
_DC_COUNTS = [0, 0, 7, 1, 1] + [0] * 11
_DC_SYMBOLS = [2, 3, 4, 5, 6, 7, 8, 1, 0]


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a Huffman table as JPEG gives it."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0, 8] + [1] * 63))
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE * 8, SIDE * 8, 1, 1, 0x11, 0))
    + _segment(0xC4, bytes([0x00, *_DC_COUNTS, *_DC_SYMBOLS]))
    + _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0]))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def encode_frames(blocks: np.ndarray) -> list[bytes]:
    """A JPEG image for each row of UNIT grey levels."""
    frames = len(blocks)
    dc = blocks.astype(np.int32) - 128
    diff = np.diff(dc, axis=1, prepend=0)
    size = np.array([int(x).bit_length() for x in range(256)])[np.abs(diff)]
    codes = _codes(_DC_COUNTS, _DC_SYMBOLS)
    code, length = (np.array([codes[s][k] for s in range(9)]) for k in (0, 1))
    value = (code[size] << size | np.where(diff > 0, diff, diff + (1 << size) - 1)) << 1
    bits = length[size] + size + 1
    fill = -bits.sum(axis=1) % 8
    value = np.concatenate([value, ((1 << fill) - 1)[:, None]], axis=1).ravel().astype(np.uint64)
    bits = np.concatenate([bits, fill[:, None]], axis=1)
    ends = np.cumsum(bits.ravel())
    at = ends - bits.ravel()
    wide = value << (64 - (at & 31) - bits.ravel()).clip(0, 63).astype(np.uint64)
    words = (ends[-1] >> 5) + 2
    packed = np.bincount(at >> 5, (wide >> np.uint64(32)).astype(float), words)
    packed += np.bincount((at >> 5) + 1, (wide & np.uint64(0xFFFFFFFF)).astype(float), words)
    data = packed.astype(np.uint32).astype(">u4").tobytes()
    cuts = np.r_[0, ends.reshape(frames, -1)[:, -1] >> 3].tolist()
    return [HEAD + data[a:b].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, b in zip(cuts, cuts[1:])]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = SIDE * 8, height: int = SIDE * 8, fps: int = FPS) -> bytes:
    """One video stream of motion-JPEG with an idx1 index."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    at = np.cumsum([4, *map(len, chunks)]).tolist()
    idx1 = b"".join(struct.pack("<4sIII", b"00dc", 0x10, a, len(f)) for a, f in zip(at, frames))
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", idx1))


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


def _video(data: bytes, at: int, end: int) -> tuple[bytes, float | None]:
    """From a hdrl list: the two digits that begin the chunk names of the first video stream, and its seconds a frame if they are given."""
    stream = 0
    for name, a, b in _walk(data, at, end):
        if name == b"LIST" and data[a : a + 4] == b"strl":
            for inner, c, _ in _walk(data, a + 4, b):
                if inner == b"strh" and data[c : c + 4] == b"vids":
                    scale, rate = struct.unpack_from("<II", data, c + 20)
                    return b"%02d" % stream, scale / rate if scale and rate else None
            stream += 1
    return b"00", None


def _frames(data: bytes, at: int, end: int, video: bytes) -> Iterator[bytes]:
    """The stream's frames in a movi list, also those inside rec lists."""
    for name, a, b in _walk(data, at, end):
        if name == b"LIST" and data[a : a + 4] == b"rec ":
            yield from _frames(data, a + 4, b, video)
        elif name[:2] == video and name[2:] in (b"dc", b"db"):
            yield data[a:b]


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """(seconds a frame, frames of the first video stream).

    Frames are located by idx1; where there is no index, or the file goes on in further RIFF chunks, which idx1 doesn't
    cover, by walking the movi lists. Empty frames (dropped ones) repeat the frame before.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    step, video, movi, index = 1 / FPS, b"00", [], None
    for riff, start, stop in _walk(data, 0, len(data)):
        for name, a, b in _walk(data, start + 4, stop) if riff == b"RIFF" else ():
            if name == b"LIST" and data[a : a + 4] == b"hdrl":
                for inner, c, _ in _walk(data, a + 4, b):
                    if inner == b"avih":
                        step = struct.unpack_from("<I", data, c)[0] / 1e6 or step
                video, exact = _video(data, a + 4, b)
                step = exact or step
            elif name == b"LIST" and data[a : a + 4] == b"movi":
                movi.append((a, b))
            elif name == b"idx1":
                index = (a, b)
    if len(movi) == 1 and index:
        rows = list(struct.iter_unpack("<4sIII", data[index[0] : index[0] + (index[1] - index[0]) // 16 * 16]))
        rows = [r for r in rows if r[0][:2] == video and r[0][2:] in (b"dc", b"db")]
        at = movi[0][0]
        base = at if rows and data[at + rows[0][2] : at + rows[0][2] + 4] == rows[0][0] else 0
        found = [data[base + o + 8 : base + o + 8 + n] for _, _, o, n in rows]
    else:
        found = [f for a, b in movi for f in _frames(data, a + 4, b, video)]
    frames: list[bytes] = []
    for f in found:
        if f or frames:
            frames.append(f or frames[-1])
    return step, frames


class _Header:
    """What a baseline JPEG says before its scan."""

    def __init__(self, data: bytes):
        self.quant, self.huff, self.restart, at = {}, {}, 0, 2
        while True:
            mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if mark == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 128 if wide else 64
                    q = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                    self.quant[body[0] & 15], body = q, body[1 + n :]
            elif mark == 0xC4:
                while body:
                    counts = list(body[1:17])
                    n = sum(counts)
                    self.huff[body[0]], body = self._table(counts, list(body[17 : 17 + n])), body[17 + n :]
            elif mark in (0xC0, 0xC1):
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= mark <= 0xCF and mark != 0xC8:
                raise ValueError("only baseline JPEG frames are decoded")
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif mark == 0xDA:
                self.tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                self.scan = at
                return

    @staticmethod
    def _table(counts, symbols):
        symbol, length = np.zeros(1 << 16, np.int64), np.full(1 << 16, 16, np.int64)
        for s, (code, n) in _codes(counts, symbols).items():
            symbol[code << 16 - n : code + 1 << 16 - n] = s
            length[code << 16 - n : code + 1 << 16 - n] = n
        return symbol, length


_COS = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8) * np.pi / 16) * np.where(np.arange(8), 0.5, np.sqrt(0.125))


def decode_luma(frames: list[bytes]) -> np.ndarray:
    """(frame, row, column): luma of baseline JPEG frames that all have the header of the first, as 8-bit samples; where no
    block has detail the array has one sample a block."""
    head = _Header(frames[0])
    sole = len(head.parts) == 1
    h_max, v_max = (1, 1) if sole else (max(p[1] for p in head.parts), max(p[2] for p in head.parts))
    across, down = -(-head.width // (8 * h_max)), -(-head.height // (8 * v_max))
    layout = [(k, y, x) for k, (_, h, v, _) in enumerate(head.parts) for y in range(1 if sole else v) for x in range(1 if sole else h)]
    tables = [(head.huff[head.tables[p[0]] >> 4], head.huff[16 | head.tables[p[0]] & 15]) for p in head.parts]
    mcus = across * down
    every = head.restart or mcus
    streams, frame, first = [], [], []
    for f, data in enumerate(frames):
        scan = data[head.scan :]
        end = scan.rfind(b"\xff\xd9")
        scan = scan[: end if end >= 0 else len(scan)]
        pieces = [scan]
        if head.restart:
            for k in range(8):
                scan = scan.replace(bytes([0xFF, 0xD0 + k]), b"\xff\xd0")
            pieces = scan.split(b"\xff\xd0")
        for k, piece in enumerate(pieces):
            streams.append(piece.replace(b"\xff\x00", b"\xff") + b"\xff" * 8)
            frame.append(f)
            first.append(k * every)
    frame, first = np.array(frame), np.array(first)
    buffer = np.frombuffer(b"".join(streams), np.uint8).astype(np.uint64)
    peek5 = np.zeros(len(buffer), np.uint64)
    for k in range(5):
        peek5[: len(buffer) - 4] |= buffer[k : len(buffer) - 4 + k] << np.uint64(8 * (4 - k))
    limit = (len(buffer) - 5) * 8
    pos = np.r_[0, np.cumsum([len(s) for s in streams])[:-1]] * 8

    def peek(at):
        at = np.minimum(at, limit)
        return ((peek5[at >> 3] >> (24 - (at & 7)).astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.int64)

    def extended(at, size):
        raw = peek(at) >> (16 - size)
        return np.where((size > 0) & (raw < 1 << np.maximum(size - 1, 0)), raw - (1 << size) + 1, raw)

    luma = head.parts[0]
    rows, columns = down * (1 if sole else luma[2]), across * (1 if sole else luma[1])
    dc = np.zeros((len(frames), rows, columns), np.int64)
    detail = []
    before = np.zeros((len(head.parts), len(streams)), np.int64)
    for m in range(every):
        live = np.flatnonzero(first + m < mcus)
        if not len(live):
            break
        y0, x0 = np.divmod(first[live] + m, across)
        for k, y, x in layout:
            (dc_symbol, dc_length), (ac_symbol, ac_length) = tables[k]
            window, at = peek(pos[live]), pos[live]
            size = dc_symbol[window]
            at = at + dc_length[window]
            before[k, live] += extended(at, size)
            pos[live] = at + size
            by, bx = (y0, x0) if sole else (y0 * luma[2] + y, x0 * luma[1] + x)
            if k == 0:
                dc[frame[live], by, bx] = before[k, live]
            open_, c = live, np.zeros(len(live), np.int64)
            where = np.arange(len(live))
            while len(open_):
                window, at = peek(pos[open_]), pos[open_]
                s = ac_symbol[window]
                at = at + ac_length[window]
                run, size = s >> 4, s & 15
                c = c + run + 1
                if k == 0 and size.any():
                    some = np.flatnonzero((size > 0) & (c < 64))
                    value = extended(at[some], size[some])
                    detail.append((frame[open_[some]], by[where[some]], bx[where[some]], c[some], value))
                pos[open_] = at + size
                going = np.flatnonzero(((size > 0) | (run == 15)) & (c < 63))
                open_, c, where = open_[going], c[going], where[going]
    q = head.quant[luma[3]]
    if not detail:
        return np.clip(np.rint(dc * q[0] / 8 + 128), 0, 255).astype(np.uint8)
    f, y, x, c, value = (np.concatenate(p) for p in zip(*detail))
    out = np.zeros((len(frames), head.height, head.width), np.uint8)
    for i in range(len(frames)):
        block = np.zeros((rows, columns, 64))
        block[:, :, 0] = dc[i] * q[0]
        own = f == i
        block[y[own], x[own], ZIGZAG[c[own]]] = value[own] * q[c[own]]
        pixels = np.einsum("yu,rcuv,xv->rycx", _COS, block.reshape(rows, columns, 8, 8), _COS).reshape(rows * 8, columns * 8)
        out[i] = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)[: head.height, : head.width]
    return out


def decode_all(videos: list[list[bytes]]) -> list[list[np.ndarray]]:
    """Luma of every frame; frames of one header are decoded side by side, over videos too."""
    groups: dict[bytes, list[tuple[int, int]]] = {}
    for v, frames in enumerate(videos):
        for k, data in enumerate(frames):
            groups.setdefault(data[: _Header(data).scan] if not data.startswith(HEAD) else HEAD, []).append((v, k))
    out = [[None] * len(frames) for frames in videos]
    for members in groups.values():
        for at in range(0, len(members), 1 << 13):
            part = members[at : at + (1 << 13)]
            for (v, k), plane in zip(part, decode_luma([videos[v][k] for v, k in part])):
                out[v][k] = plane
    return out


def shots(planes: list[np.ndarray], bins: int = 32, window: int = 8, factor: float = 3.0, least: float = 0.1) -> tuple[list[int], np.ndarray]:
    """First frames of shots, and each frame's histogram difference to the one before (0 to 1).

    A shot begins where the difference is at least `least` and above mean + factor x deviation of up to `window`
    differences before it in the shot.
    """
    if not planes:
        return [], np.zeros(0)
    hist = np.stack([np.bincount((p.ravel() // (256 // bins)).astype(np.int64), minlength=bins) / p.size for p in planes])
    diff = np.r_[0.0, 0.5 * np.abs(np.diff(hist, axis=0)).sum(axis=1)]
    starts = [0]
    for i in range(1, len(planes)):
        past = diff[max(starts[-1] + 1, i - window) : i]
        if diff[i] >= least and (not len(past) or diff[i] > past.mean() + factor * past.std()):
            starts.append(i)
    return starts, diff


def clips(media: DataFrame, key: str = "media_id", column: str = "media") -> DataFrame:
    """(key, clip, start_frame, end_frame, start_s, end_s, peak) rows of AVI motion-JPEG files in a binary column.

    Frames are end-exclusive; peak is the largest difference inside the clip. Null, empty or unreadable
    media and media without frames yield no row; repeated rows yield their clips again; other columns are
    not carried. An empty table gives no rows.
    """
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    step, frames = read_avi(data or b"")
                    planes = decode_all([frames])[0]
                except (ValueError, KeyError, IndexError, struct.error):
                    continue
                starts, diff = shots(planes)
                for i, (s, e) in enumerate(zip(starts, [*starts[1:], len(planes)])):
                    rows.append((name, i, s, e, s * step, e * step, float(diff[s + 1 : e].max(initial=0))))
            names = [key, "clip", "start_frame", "end_frame", "start_s", "end_s", "peak"]
            kinds = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return media.select(key, column).mapInArrow(
        run, f"`{key}` {kind}, clip int, start_frame int, end_frame int, start_s double, end_s double, peak double"
    )


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * ((-len(raw)) % UNIT or (0 if raw else UNIT))


def store_texts(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): its text stored as an AVI, read back and described.

    doc_id, n_bytes, media (binary), payload (binary, as read back from media) and feature: the
    numbers of frames and shots, the shots' first frames, and each shot's mean level. A null text counts as
    empty and is stored as one frame of padding. Equal texts give equal values; rows that repeat are each stored; other columns are
    not carried; an empty table gives no rows. A text whose file passes 4 GB, more than a RIFF chunk can hold, is an error.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    return docs.select("doc_id", "text").mapInArrow(_stream, f"doc_id {kind}, n_bytes long, media binary, payload binary, feature string")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held, many = [], 0
        for doc, text in zip(b.column(0), b.column(1)):
            held.append((doc.as_py(), *payload_of(text.as_py())))
            many += len(held[-1][2])
            if many >= TOGETHER:
                yield _stored(held, b.schema.field(0).type)
                held, many = [], 0
        yield _stored(held, b.schema.field(0).type)


def _stored(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    blocks = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, UNIT)
    images = [x for at in range(0, len(blocks), 1 << 12) for x in encode_frames(blocks[at : at + (1 << 12)])]
    media, at = [], 0
    for r in rows:
        n = len(r[2]) // UNIT
        media.append(write_avi(images[at : at + n]))
        at += n
    planes = decode_all([read_avi(m)[1] for m in media])
    features = []
    for own in planes:
        starts, _ = shots(own)
        levels = [int(np.mean(own[s:e])) for s, e in zip(starts, [*starts[1:], len(own)])]
        features.append(f"frames={len(own)};shots={len(starts)};at={','.join(map(str, starts))};level={','.join(map(str, levels))}")
    columns = [
        pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), pa.array(media, pa.binary()),
        pa.array([b"".join(p.tobytes() for p in own) for own in planes], pa.binary()), pa.array(features, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media", "payload", "feature"])


def op1(spark, sf_dir):
    """What store_texts gives, as digests: the bytes themselves stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _stream(batches):
            payload, media = b.column(3).to_pylist(), b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array([len(p) for p in payload], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payload], pa.string()), pa.array([zlib.crc32(p[-32:]) for p in payload], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), b.column(4),
                ],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
