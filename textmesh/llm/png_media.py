"""Texts as 8-bit greyscale PNG images in binary columns.

The payload is the UTF-8 text and zero bytes up to a positive multiple of 64;
an image is 64 samples wide.  Images are written as IHDR, IDAT and IEND chunks
with CRC-32 checksums around a zlib stream of filtered scan lines; each line has
the filter whose differences, as signed bytes, have the least absolute sum.  The
reader tests the signature, every chunk's checksum and the size of the stream,
and undoes all five line filters with numpy: a sample needs its left, upper and
upper-left neighbours, so the samples of an anti-diagonal are worked out
together, for many images at once.  The feature is a 64-bit perceptual
hash: the image is averaged down to 32 x 32, transformed by a two-dimensional
cosine transform, and its 8 x 8 lowest frequencies are compared with their
median.

Defined results: null counts as the empty text (64 zero bytes); equal texts
give equal values, repeated rows repeated ones; of filters with equal sums the
first counts; a damaged image raises ValueError in `decode_png` and gives null
columns and its error text in `read_images`; an empty table gives an empty one;
other columns don't matter.  A text goes alone if it is longer than a step, and
memory is a small multiple of it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmesh.llm.common import batches, small_batches

WIDTH = 64
LEVEL = 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filtered(rows: np.ndarray, first: np.ndarray, line_filter: int | None = None) -> np.ndarray:
    """Lines (filter byte, differences) of the samples of images below each
    other; first: whether a row is an image's first.  line_filter None: for
    each line the filter with the least absolute sum."""
    left = np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    up[first] = 0
    corner = np.zeros_like(rows)
    corner[:, 1:] = up[:, :-1]
    lines = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    best = None
    for kind in range(5) if line_filter is None else (line_filter,):
        guess = 0 if kind == NONE else left if kind == SUB else up if kind == UP else ((left.astype(np.uint16) + up) // 2).astype(np.uint8) if kind == AVERAGE else _paeth(left, up, corner)
        differences = rows - guess
        sums = np.minimum(differences, -differences).sum(axis=1, dtype=np.int64)  # of the signed bytes' sizes
        better = np.ones(len(rows), bool) if best is None else sums < best
        best = sums if best is None else np.minimum(best, sums)
        lines[better, 0], lines[better, 1:] = kind, differences[better]
    return lines


def _image(lines: np.ndarray, level: int) -> bytes:
    head = struct.pack(">IIBBBBB", lines.shape[1] - 1, len(lines), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def encode_all(payloads: list[bytes], width: int = WIDTH, level: int = LEVEL, line_filter: int | None = None) -> list[bytes]:
    """Greyscale PNGs of payloads, whose lengths are multiples of width."""
    height = [len(p) // width for p in payloads]
    at = np.concatenate(([0], np.cumsum(height)))
    first = np.zeros(at[-1], bool)
    first[at[:-1]] = True
    lines = filtered(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, width), first, line_filter)
    return [_image(lines[a:b], level) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL, line_filter: int | None = None) -> bytes:
    """A greyscale PNG of the payload, whose length is a multiple of width."""
    return encode_all([payload], width, level, line_filter)[0]


def _paeth(a, b, c):
    """The neighbour nearest to left + up - corner; ties go in that order."""
    x, y, z = (v.astype(np.int16) for v in (a, b, c))
    pa_, pb, pc = abs(y - z), abs(x - z), abs(x + y - 2 * z)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


#: What a first line's filter comes to, as the line above it is zero; 5: half the left sample.
_HALF = 5
_FIRST = np.array([NONE, SUB, NONE, _HALF, SUB], np.uint8)
#: Rows of the strips that images are dealt over, unless one has more.
STRIP = 256


def unfilter_all(kinds: list[np.ndarray], lines: list[np.ndarray]) -> list[np.ndarray]:
    """The samples of images of one width, from their lines' filters and
    differences.

    Images are laid below each other in strips of about the same height, and
    all strips advance by anti-diagonals: the sample in column c of diagonal d
    is in row d - c, its left neighbour is column c - 1 of diagonal d - 1, the
    upper one column c of d - 1, the corner column c - 1 of d - 2."""
    if not lines:
        return []
    if max(int(k.max(initial=0)) for k in kinds) > PAETH:
        raise ValueError("unknown line filter")
    height = np.array([len(x) for x in lines])
    if not any(k.any() for k in kinds):
        return list(lines)
    width = lines[0].shape[1]
    most = max(STRIP, int(height.max()))
    # images in order of height fill strip after strip
    strip, row, used, at = np.zeros(len(lines), int), np.zeros(len(lines), int), 0, 0
    for i in np.argsort(-height, kind="stable"):
        if used + height[i] > most:
            at, used = at + 1, 0
        strip[i], row[i] = at, used
        used += height[i]
    pad = width - 1
    rows = most + 2 * pad
    data, kind = np.zeros((at + 1, rows, width), np.uint8), np.zeros((at + 1, rows), np.uint8)
    for i, (k, x) in enumerate(zip(kinds, lines, strict=True)):
        a = row[i] + pad
        data[strip[i], a : a + len(x)], kind[strip[i], a : a + len(x)] = x, k
        kind[strip[i], a] = _FIRST[k[0]]
    # views in which [d] is a diagonal: (strip, column)
    steps = most + pad
    slanted = lambda a, cell: np.lib.stride_tricks.as_strided(a[:, pad:], (steps, len(a), width), (a.strides[1], a.strides[0], cell))
    cells, filters = slanted(data, 1 - width), slanted(kind, -1)
    one, two = (np.zeros((len(data), width + 1), np.int16) for _ in range(2))  # a zero, then the last two diagonals
    for d in range(steps):
        left, up, corner, k = one[:, :-1], one[:, 1:], two[:, :-1], filters[d]
        x, y = abs(up - corner), abs(left - corner)
        z = abs(left + up - 2 * corner)
        guess = np.where((x <= y) & (x <= z), left, np.where(y <= z, up, corner))
        guess = np.where(k == PAETH, guess, np.where(k == SUB, left, np.where(k == UP, up, np.where(k == AVERAGE, (left + up) >> 1, np.where(k == _HALF, left >> 1, 0)))))
        sample = (cells[d] + guess) & 255
        cells[d] = sample
        two, one = one, two
        one[:, 1:] = sample
    return [data[strip[i], row[i] + pad : row[i] + pad + h] for i, h in enumerate(height.tolist())]


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The samples of filtered lines of one byte a sample."""
    return unfilter_all([kinds], [lines])[0]


def read_chunks(blob: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Width, filters and differences of the lines of an 8-bit greyscale PNG."""
    if blob[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, data, ended = 8, None, [], False
    while at < len(blob):
        if at + 12 > len(blob):
            raise ValueError("cut chunk")
        size, kind = struct.unpack_from(">I4s", blob, at)
        if at + 12 + size > len(blob):
            raise ValueError("cut chunk")
        body = blob[at + 8 : at + 8 + size]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", blob, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind!r} is wrong")
        if (kind == b"IHDR") != (head is None):
            raise ValueError("IHDR isn't first, or is repeated")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("IHDR has another size")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 0x20:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0) or not head[0] or not head[1]:
        raise ValueError("not an 8-bit greyscale image without interlacing, or no end")
    width, height = head[:2]
    try:
        stream = zlib.decompressobj()
        raw = stream.decompress(b"".join(data), min(height * (width + 1) + 1, 1 << 40))
    except zlib.error as e:
        raise ValueError(f"damaged stream: {e}") from None
    if len(raw) != height * (width + 1) or not stream.eof:
        raise ValueError("the stream has another size than the image")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    if lines[:, 0].max() > PAETH:
        raise ValueError("unknown line filter")
    return width, lines[:, 0], lines[:, 1:]


def decode_png(blob: bytes) -> np.ndarray:
    """The samples (rows, columns) of an 8-bit greyscale PNG."""
    _, kinds, lines = read_chunks(blob)
    return unfilter(kinds, lines)


def decode_all(blobs: list) -> list:
    """The samples of each image, or the ValueError that it raises."""
    out, by_width = [], {}
    for i, blob in enumerate(blobs):
        try:
            if blob is None:
                raise ValueError("no image")
            width, kinds, lines = read_chunks(blob)
            out.append(None)
            by_width.setdefault(width, []).append((i, kinds, lines))
        except ValueError as e:
            out.append(e)
    for got in by_width.values():
        for (i, *_), samples in zip(got, unfilter_all([k for _, k, _ in got], [x for *_, x in got]), strict=True):
            out[i] = samples
    return out


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(k), np.arange(n) + 0.5))


_LOW = _cosines(32, 8)


def dct_hash(samples: np.ndarray) -> str:
    """64 bits of the low frequencies, as 16 hex digits."""
    h, w = samples.shape
    if h >= 32:
        at = np.arange(32) * h // 32
        rows = np.add.reduceat(samples, at, axis=0, dtype=np.int64) / np.diff(np.append(at, h))[:, None]
    else:
        rows = samples[np.arange(32) * h // 32].astype(float)
    at = np.arange(32) * w // 32
    small = np.add.reduceat(rows, at, axis=1) / np.diff(np.append(at, w)) if w >= 32 else rows[:, np.arange(32) * w // 32]
    low = np.round(_LOW @ small @ _LOW.T, 6)
    flat = low.ravel()
    bits = flat > np.median(flat[1:])
    return np.packbits(bits).tobytes().hex()


def to_payload(text: bytes) -> bytes:
    size = max(WIDTH, -(-len(text) // WIDTH) * WIDTH)
    return text.ljust(size, b"\0")


_IMAGES = "doc_id long, n_bytes long, media binary"
_READ = "doc_id long, n_bytes long, media binary, payload binary, feature string, error string"


def write_images(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a PNG in a binary column."""

    def run(it):
        for batch, buf, off in batches(it):
            data = buf.tobytes()
            media = encode_all([to_payload(data[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _IMAGES)


def read_images(images: DataFrame) -> DataFrame:
    """Adds the samples that the reader gets back, the feature and the error."""

    def run(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got = decode_all([x.as_py() for x in part.column(2)])
                bad = [isinstance(x, ValueError) for x in got]
                payload = [None if b else x.tobytes() for x, b in zip(got, bad, strict=True)]
                feature = [None if b else dct_hash(x) for x, b in zip(got, bad, strict=True)]
                error = [str(x) if b else None for x, b in zip(got, bad, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payload, pa.binary()), pa.array(feature, pa.string()), pa.array(error, pa.string())], names=["doc_id", "n_bytes", "media", "payload", "feature", "error"])

    return small_batches(images).select("doc_id", "n_bytes", "media").mapInArrow(run, _READ)


def op7_media(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = read_images(write_images(docs))
    return back.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def verify_images(images: DataFrame) -> DataFrame:
    """Rows whose image can't be read, with the error."""
    return read_images(images).where("error is not null").select("doc_id", "error")


