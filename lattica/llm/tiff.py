"""Media columns: TIFF files in a binary column, one row per page.

`pages` walks a file's image directories, decodes PackBits, LZW or deflate strips and tiles, undoes
the horizontal and the floating-point predictor and gives one row per page. Samples of 1, 2, 4, 8,
16 or 32 bits are read, side by side or in planes, in either byte order and order of bits; less than
eight bits take a byte each, others come in the machine's byte order. `encode` writes such files.

Text is kept as media, too: `text_image` pads its UTF-8 bytes to a multiple of the row width, cuts
them into pages of `PAGE_ROWS` rows of 8-bit samples and writes these in turn by the kinds of `KINDS`,
so that all codecs, predictors, strips and tiles store text. A page's description says how many bytes
of text it holds, so texts that end in zeros come back whole.

A null file gives no page. A damaged page, or one of a kind that isn't read, gives a row whose `error`
says what is wrong and whose other fields are null; the other pages stay, and a damaged chain of
directories ends in such a row without a number. Sizes that the file's data could not unpack to are
refused before anything is allocated, as is a page of more than `LARGEST` bytes. An empty text is one
row of zeros. Repeated rows are decoded each; extra columns pass through, except those whose names
clash with a result, which are replaced.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from lattica.llm.common import raw, ship

# Fixed values of the TIFF 6.0 format: tags, field types with their sizes, compression numbers.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
FILL_ORDER, DESCRIPTION, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 266, 270, 322, 323, 324, 325
FIELD_TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NO_COMPRESSION, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

#: Bytes that one byte of a codec's data can unpack to, at most.
EXPANDS = {NO_COMPRESSION: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1100, OLD_DEFLATE: 1100}
#: Most bytes of a page's pixels.
LARGEST = 1 << 30

#: Samples in a row of a text's image, and the payload's unit; rows of a page.
ROW, PAGE_ROWS = 64, 256
#: How a text's pages are written, in turn: compression, predictor, tile (or strips).
KINDS = [(DEFLATE, 2, None), (LZW, 1, (32, 64)), (PACKBITS, 1, None), (NO_COMPRESSION, 2, (64, 32)), (DEFLATE, 1, (128, 64)), (LZW, 2, None)]


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    data: bytes
    predictor: int = 1
    description: str | None = None


_RUNS = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    """Runs of three and more as a count and a byte, what is between them as it is."""
    out, at = bytearray(), 0
    for m in (*_RUNS.finditer(data), None):
        end = m.start() if m else len(data)
        while at < end:
            part = data[at : min(end, at + 128)]
            out.append(len(part) - 1)
            out += part
            at += len(part)
        if m:
            out += bytes((257 - (m.end() - m.start()), data[m.start()]))
            at = m.end()
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size:
        if i >= len(data):
            raise ValueError("PackBits data end early")
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the table cleared when it is full."""
    codes, widths = [256], [9]
    known: dict[int, int] = {}
    n, width, word = 258, 9, -1
    for b in data:
        if word < 0:
            word = b
            continue
        longer = known.get(word << 8 | b)
        if longer is not None:
            word = longer
            continue
        codes.append(word)
        widths.append(width)
        known[word << 8 | b] = n
        n += 1
        if n == 4094:
            codes.append(256)
            widths.append(width)
            known, n, width = {}, 258, 9
        elif n in (512, 1024, 2048):  # the reader's table is one entry behind
            width += 1
        word = b
    if word >= 0:
        codes.append(word)
        widths.append(width)
        if n + 1 in (512, 1024, 2048):
            width += 1
    codes.append(257)
    widths.append(width)
    bits = "".join([f"{c:0{w}b}" for c, w in zip(codes, widths, strict=True)])
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    table: list[bytes] = []
    last = b""
    for b in data:
        held, bits = held << 8 | b, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table = [bytes((i,)) for i in range(256)] + [b"", b""]
            width, last = 9, b""
            continue
        if not table or code > len(table) or code == len(table) and not last:
            raise ValueError("LZW code out of range")
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        n = len(table)
        width = 9 + (n >= 511) + (n >= 1023) + (n >= 2047)
        if len(out) >= size:
            break
    if len(out) < size:
        raise ValueError("LZW data end early")
    return bytes(out[:size])


def inflate(data: bytes, size: int) -> bytes:
    out = zlib.decompressobj().decompress(data, size)
    if len(out) < size:
        raise ValueError("deflate data end early")
    return out


def _packed(block: np.ndarray, compression: int, level: int) -> bytes:
    data = block.tobytes()
    return {NO_COMPRESSION: lambda: data, PACKBITS: lambda: pack_bits(data), LZW: lambda: lzw_encode(data), DEFLATE: lambda: zlib.compress(data, level)}[compression]()


def _differences(block: np.ndarray, samples: int) -> np.ndarray:
    """Horizontal predictor; block has rows of width * samples values."""
    out = block.copy()
    out[:, samples:] -= block[:, :-samples]
    return out


def _byte_planes(block: np.ndarray, samples: int) -> np.ndarray:
    """Floating-point predictor: a row's bytes by significance, highest first, and their differences."""
    wide = block.dtype.itemsize
    planes = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(len(block), -1, wide).transpose(0, 2, 1).reshape(len(block), -1)
    return _differences(np.ascontiguousarray(planes), samples)


def encode(pages: list[np.ndarray], compression: int | list[int] = DEFLATE, predictor: int | list[int] = 1, rows_per_strip: int = 128, tile: tuple[int, int] | list | None = None, order: str = "<", level: int = 1, descriptions: list[str] | None = None, planes: bool = False) -> bytes:
    """A TIFF file of 8-, 16- or 32-bit images of shape (height, width) or (height, width, samples).

    Lists of compressions, predictors and tiles have an entry for each page.
    """
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    patch = 4
    of = lambda option, k: option[k] if isinstance(option, list) else option
    for number, image in enumerate(pages):
        packing, predicted, cut = of(compression, number), of(predictor, number), of(tile, number)
        image = image[:, :, None] if image.ndim == 2 else image
        h, w, s = image.shape
        kind = np.dtype(image.dtype).newbyteorder(order)
        blocks = []
        for plane in np.split(image, s, axis=2) if planes else [image]:
            together = plane.shape[2]
            flat = np.ascontiguousarray(plane).reshape(h, w * together)
            if cut:
                th, tw = cut
                padded = np.zeros((-(-h // th) * th, -(-w // tw) * tw * together), image.dtype)
                padded[:h, : w * together] = flat
                blocks += [padded[y : y + th, x * together : (x + tw) * together] for y in range(0, padded.shape[0], th) for x in range(0, padded.shape[1] // together, tw)]
            else:
                blocks += [flat[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        at, sizes = [], []
        for b in blocks:
            stored = _differences(b, together).astype(kind) if predicted == 2 else _byte_planes(b, together) if predicted == 3 else b.astype(kind)
            data = _packed(stored, packing, level)
            at.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [image.dtype.itemsize * 8] * s), (COMPRESSION, 3, [packing]), (PHOTOMETRIC, 3, [2 if s == 3 else 1]), (SAMPLES, 3, [s]), (PLANAR, 3, [2 if planes else 1]), (PREDICTOR, 3, [predicted])]
        fields += [(TILE_WIDTH, 4, [cut[1]]), (TILE_HEIGHT, 4, [cut[0]]), (TILE_AT, 4, at), (TILE_BYTES, 4, sizes)] if cut else [(STRIP_AT, 4, at), (ROWS, 4, [rows_per_strip]), (STRIP_BYTES, 4, sizes)]
        if descriptions:
            fields.append((DESCRIPTION, 2, list(descriptions[number].encode() + b"\0")))
        entries = []
        for tag, t, values in sorted(fields):
            data = struct.pack(f"{order}{len(values)}{FIELD_TYPES[t]}", *values)
            if len(data) > 4:
                place = len(out)
                out += data + b"\0" * (len(data) % 2)
                data = struct.pack(order + "I", place)
            entries.append(struct.pack(order + "HHI", tag, t, len(values)) + data.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, patch, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        patch = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _fields(data: bytes, at: int, order: str) -> dict[int, list[int]]:
    (n,) = struct.unpack_from(order + "H", data, at)
    found = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        place = at + 10 + 12 * k
        if kind in FIELD_TYPES:
            if FIELD_SIZES[kind] * count > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            found[tag] = list(struct.unpack_from(f"{order}{count}{FIELD_TYPES[kind]}", data, place))
    return found


def _directories(data: bytes) -> Iterator[tuple[int, int, str]]:
    """Number, place and byte order of each image directory."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("no TIFF header")
    order = "<" if data[:1] == b"I" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    number, seen = 0, set()
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        yield number, at, order
        (n,) = struct.unpack_from(order + "H", data, at)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        number += 1


_TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def _unpacked(part: bytes, packing: int, need: int) -> bytes:
    if packing == NO_COMPRESSION:
        return part[:need]
    return {PACKBITS: unpack_bits, LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate}[packing](part, need)


def _samples(part: bytes, rows: int, wide: int, together: int, bits: int, order: str, predictor: int) -> np.ndarray:
    """Rows of wide * together values of a block's unpacked bytes."""
    n = wide * together
    if bits < 8:  # rows begin at a byte
        cells = np.unpackbits(np.frombuffer(part, np.uint8).reshape(rows, -1), axis=1)[:, : n * bits].reshape(rows, n, bits)
        return (cells * (1 << np.arange(bits - 1, -1, -1, dtype=np.uint8))).sum(axis=2, dtype=np.uint8)
    size = bits // 8
    if predictor == 3:
        planes = np.cumsum(np.frombuffer(part, np.uint8).reshape(rows, n * size // together, together), axis=1, dtype=np.uint8).reshape(rows, size, n)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{size}").reshape(rows, n).astype(f"=u{size}")
    block = np.frombuffer(part, f"{order}u{size}").astype(f"=u{size}").reshape(rows, n)
    if predictor == 2:
        block = np.cumsum(block.reshape(rows, wide, together), axis=1, dtype=block.dtype).reshape(rows, n)
    return block


def _page(data: bytes, number: int, at: int, order: str) -> Page:
    f = _fields(data, at, order)
    one = lambda tag, default: f.get(tag, [default])[0]
    w, h, s, bits, packing, predictor = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if min(w, h, s) < 1:
        raise ValueError(f"{w} by {h} pixels of {s} samples")
    if bits not in (1, 2, 4, 8, 16, 32) or any(b != bits for b in f.get(BITS, [])):
        raise ValueError(f"samples of {f.get(BITS, [1])} bits aren't read")
    if packing not in EXPANDS:
        raise ValueError(f"compression {packing} isn't read")
    if predictor not in (1, 2, 3) or predictor > 1 and bits < 8 or predictor == 3 and bits < 16:
        raise ValueError(f"predictor {predictor} of {bits}-bit samples isn't read")
    tiled, planes = TILE_AT in f, s if one(PLANAR, 1) == 2 else 1
    together = s // planes
    bw, bh = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (w, min(one(ROWS, h), h))
    if min(bw, bh) < 1:
        raise ValueError(f"blocks of {bw} by {bh} pixels")
    places = f[TILE_AT if tiled else STRIP_AT]
    sizes = f.get(TILE_BYTES if tiled else STRIP_BYTES) or [len(data) - place for place in places]
    across, down = -(-w // bw), -(-h // bh)
    if len(places) != across * down * planes or len(sizes) != len(places):
        raise ValueError(f"{len(places)} blocks of {len(sizes)} sizes where {across * down * planes} make the image")
    held = sum(max(0, min(size, len(data) - place)) for place, size in zip(places, sizes, strict=True))
    line = -(-bw * together * bits // 8)
    if h * w * s * max(1, bits // 8) > LARGEST or bh * line > LARGEST or h * (-(-w * s * bits // 8)) > held * EXPANDS[packing] + 64:
        raise ValueError(f"{w} by {h} pixels are more than {held} bytes hold")
    image = np.zeros((h, w, s), f"=u{max(1, bits // 8)}")
    for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
        plane, k = divmod(k, across * down)
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, h - y)
        part = data[place : place + size]
        part = _unpacked(part.translate(_TURNED) if one(FILL_ORDER, 1) == 2 else part, packing, rows * line)
        block = _samples(part, rows, bw, together, bits, order, predictor).reshape(rows, bw, together)
        high, wide = min(rows, h - y), min(bw, w - x)
        image[y : y + high, x : x + wide, plane * together : (plane + 1) * together] = block[:high, :wide]
    said = bytes(f[DESCRIPTION]).split(b"\0")[0].decode("utf-8", "replace") if DESCRIPTION in f else None
    return Page(number, w, h, s, bits, packing, image.tobytes(), predictor, said)


def decode_pages(data: bytes) -> Iterator[Page]:
    """The pages of a file; samples of less than a byte take a byte each."""
    for place in _directories(data):
        yield _page(data, *place)


#: What a damaged file or one of a kind that isn't read raises.
UNREAD = (ValueError, ArithmeticError, LookupError, MemoryError, struct.error, zlib.error)


def _rows(data: bytes) -> Iterator[tuple]:
    """A row per page; an error row for each page that isn't read, and one without number where the directories end badly."""
    try:
        for place in _directories(data):
            try:
                p = _page(data, *place)
                row = (p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.data, p.description, None)
            except UNREAD as e:
                row = (place[0], *(None,) * 8, f"{type(e).__name__}: {e}")
            yield row
    except UNREAD as e:
        yield (None,) * 9 + (f"{type(e).__name__}: {e}",)


PAGE = [StructField("page", IntegerType()), StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("samples", IntegerType()), StructField("bits", IntegerType()), StructField("compression", IntegerType()), StructField("predictor", IntegerType()), StructField("pixels", BinaryType()), StructField("description", StringType()), StructField("error", StringType())]


def pages(files: DataFrame, media: str = "media") -> DataFrame:
    """One row per page of the files in column `media`, which isn't returned."""
    ship(files.sparkSession)
    names = {f.name for f in PAGE}
    keep = [c for c in files.columns if c != media and c.lower() not in names]
    schema = StructType([files.schema[c] for c in keep] + PAGE)
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, data in enumerate(b.column(media).to_pylist()):
                if data is None:
                    continue
                for row in _rows(data):
                    own = [b.column(c).slice(k, 1) for c in keep]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array([x], t.type) for x, t in zip(row, list(arrow)[len(keep) :], strict=True))], schema=arrow)

    return files.select(*(files[f"`{c}`"] for c in [*keep, media])).mapInArrow(read, schema)


TEXT_BYTES = "bytes of text: "


def text_payload(data: bytes) -> bytes:
    """The bytes, and zeros up to a positive multiple of ROW."""
    return data + b"\0" * (ROW - len(data) if not data else -len(data) % ROW)


def text_image(data: bytes) -> bytes:
    payload = text_payload(data)
    rows, size = np.frombuffer(payload, np.uint8).reshape(-1, ROW), PAGE_ROWS * ROW
    images = [rows[y : y + PAGE_ROWS] for y in range(0, len(rows), PAGE_ROWS)]
    first = zlib.crc32(payload)
    kinds = [KINDS[(first + k) % len(KINDS)] for k in range(len(images))]
    said = [f"{TEXT_BYTES}{max(0, min(size, len(data) - k * size))}" for k in range(len(images))]
    return encode(images, [k[0] for k in kinds], [k[1] for k in kinds], tile=[k[2] for k in kinds], descriptions=said)


def image_text(media: bytes) -> bytes:
    """The text that text_image() stored."""
    out = []
    for p in decode_pages(media):
        if not (p.description or "").startswith(TEXT_BYTES):
            raise ValueError("not a text's image")
        out.append(p.data[: int(p.description[len(TEXT_BYTES) :])])
    return b"".join(out)


def features(pixels: bytes, width: int, height: int) -> str:
    """Mean, spread and a 64-bit difference hash over eight bands of eight columns, as text."""
    image = np.frombuffer(pixels, np.uint8).reshape(height, width)
    rows = np.add.reduceat(image.reshape(height, 8, width // 8).sum(axis=2, dtype=np.int64), np.unique(np.arange(8) * height // 8), axis=0)
    totals = np.concatenate([rows.ravel(), rows.ravel()[:1]])
    bits = np.packbits(totals[1:] > totals[:-1]).tobytes().hex()
    total, squares, n = int(image.sum(dtype=np.int64)), int((image.astype(np.int64) ** 2).sum()), image.size
    return f"{height}x{width};{total // n};{(squares * n - total * total) // (n * n)};{bits}"


STORED = [StructField("n_bytes", LongType()), StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType()), StructField("page_compressions", ArrayType(IntegerType()))]


def texts_as_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stores each text as an image, reads the stored bytes back and describes what was read.

    Null is the empty text. The text isn't returned; columns with a result's name are replaced.
    """
    ship(docs.sparkSession)
    names = {f.name for f in STORED}
    keep = [c for c in docs.columns if c != text and c.lower() not in names]
    schema = StructType([docs.schema[c] for c in keep] + STORED)
    arrow = to_arrow_schema(schema)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in raw(b.column(text)):
                media = text_image(data)
                found = list(decode_pages(media))
                read = b"".join(p.data for p in found)
                rows.append((len(data), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), features(read, ROW, len(read) // ROW), [p.compression for p in found]))
            columns = list(zip(*rows, strict=True)) or [()] * len(STORED)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x, t.type) for x, t in zip(columns, list(arrow)[len(keep) :], strict=True))], schema=arrow)

    return docs.select(*(docs[f"`{c}`"] for c in [*keep, text])).mapInArrow(stored, schema)


def text_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds each text's image as a binary column; null is the empty text."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != media]
    schema = StructType([docs.schema[c] for c in keep] + [StructField(media, BinaryType())])
    arrow = to_arrow_schema(schema)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([text_image(x) for x in raw(b.column(text))], arrow.field(media).type)], schema=arrow)

    return docs.select(*(docs[f"`{c}`"] for c in keep)).mapInArrow(made, schema)


def media_text(files: DataFrame, media: str = "media", text: str = "text") -> DataFrame:
    """The texts of column `media` back in column `text`; null stays null. The media aren't returned."""
    ship(files.sparkSession)
    keep = [c for c in files.columns if c not in (media, text)]
    schema = StructType([files.schema[c] for c in keep] + [StructField(text, StringType())])
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([None if x is None else image_text(x).decode() for x in b.column(media).to_pylist()], arrow.field(text).type)], schema=arrow)

    return files.select(*(files[f"`{c}`"] for c in [*keep, media])).mapInArrow(read, schema)


def text_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per page of the images of the texts, with the digest of its pixels in place of these."""
    out = pages(text_media(docs, text, "media").drop(text), "media")
    return out.withColumn("pixels_sha256", F.sha2("pixels", 256)).drop("pixels")
