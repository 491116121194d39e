"""TIFF media columns: a lossless writer and a reader with one row per page.

The reader walks the image file directories of either byte order, decodes PackBits, LZW and
deflate strips and tiles, undoes the horizontal predictor and checks sizes throughout; a page
that can't be decoded gives a row with an error, and a chain of directories that loops ends.
"""

from __future__ import annotations

import dataclasses
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Fixed values of the TIFF 6.0 format: tags, compression schemes and field sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

#: How documents are stored: samples a row, rows a strip and a page, rows and columns of a tile at most.
ROW, STRIP_ROWS, PAGE_ROWS, TILE = 192, 256, 512, (128, 96)

PAGES = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 2 < n and data[i] == data[i + 1] == data[i + 2]):
            i += 1
        out += bytes([i - start - 1]) + data[start:i]
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 if n == 128 else 2
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first, wider one code early."""
    out, held, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    def code(word: bytes) -> int:
        return word[0] if len(word) == 1 else table[word]

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(code(word))
        table[longer] = 258 + len(table)
        if 258 + len(table) == 4095:
            put(256)
            table.clear()
            width = 9
        elif 258 + len(table) in (512, 1024, 2048):
            width += 1
        word = data[i : i + 1]
    if word:
        put(code(word))
        if 258 + len(table) in (511, 1023, 2047):
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    out, held, bits, at, width = bytearray(), 0, 0, 0, 9
    table: list[bytes] = []
    last = b""
    while len(out) < size:
        while bits < width:
            if at >= len(data):
                return bytes(out)
            held, bits, at = (held << 8) | data[at], bits + 8, at + 1
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = [], b"", 9
            continue
        if code < 256:
            word = bytes([code])
        elif code - 258 < len(table):
            word = table[code - 258]
        elif code - 258 == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("bad LZW code")
        out += word
        if last:
            table.append(last + word[:1])
            if 258 + len(table) in (511, 1023, 2047):
                width += 1
        last = word
    return bytes(out)


PACK = {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda data: zlib.compress(data, 6)}


def _inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size) if size else b""


UNPACK = {NONE: lambda data, size: data[:size], PACKBITS: unpack_bits, LZW: unpack_lzw, DEFLATE: _inflate, OLD_DEFLATE: _inflate}


def _forward(block: np.ndarray) -> np.ndarray:
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF file of pages of shape (rows, columns) or (rows, columns, samples), 8 or 16 bits, in strips or tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        height, width, samples = page.shape
        kind = page.dtype.newbyteorder(order)
        blocks = []
        if tile:
            tall, wide = tile
            for y in range(0, height, tall):
                for x in range(0, width, wide):
                    block = np.zeros((tall, wide, samples), page.dtype)
                    part = page[y : y + tall, x : x + wide]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        places, sizes = [], []
        for block in blocks:
            block = _forward(block) if predictor == 2 else block
            packed = PACK[compression](block.astype(kind).tobytes())
            places.append(len(out))
            sizes.append(len(packed))
            out += packed + b"\0" * (len(packed) & 1)
        bits = page.dtype.itemsize * 8
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILES, 4, places), (TILE_BYTES, 4, sizes)] if tile else [(STRIPS, 4, places), (ROWS, 4, [strip_rows]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind_of, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{'H' if kind_of == 3 else 'I'}", *values)
            if len(raw) > 4:
                place = len(out)
                out += raw + b"\0" * (len(raw) & 1)
                raw = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, kind_of, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclasses.dataclass
class Page:
    number: int
    width: int = 0
    height: int = 0
    samples: int = 0
    bits: int = 0
    compression: int = 0
    predictor: int = 0
    pixels: bytes | None = None
    error: str | None = None


def _fields(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for k in range(n):
        place = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, place)
        size = FIELD_BYTES.get(kind, 0) * count
        where = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
        if kind in (1, 3, 4) and where + size <= len(data):
            fields[tag] = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, where)
    (follow,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return fields, follow


def _decode(data: bytes, fields: dict[int, tuple[int, ...]], order: str, page: Page) -> None:
    one = lambda tag, default=None: fields[tag][0] if tag in fields else default
    page.width, page.height, page.samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    page.bits, page.compression, page.predictor = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    planes = page.samples if one(PLANAR, 1) == 2 else 1
    deep = page.samples // planes
    if not page.width or not page.height or page.bits not in (8, 16) or page.predictor not in (1, 2) or page.compression not in UNPACK:
        raise ValueError("unsupported or missing fields")
    kind = np.dtype(np.uint8 if page.bits == 8 else np.uint16)
    tiled = TILES in fields
    wide = one(TILE_WIDTH, 0) if tiled else page.width
    tall = one(TILE_HEIGHT, 0) if tiled else min(one(ROWS, page.height), page.height)
    places, sizes = (fields.get(TILES, ()), fields.get(TILE_BYTES, ())) if tiled else (fields.get(STRIPS, ()), fields.get(STRIP_BYTES, ()))
    if not wide or not tall or len(places) != len(sizes) or len(places) != planes * -(-page.height // tall) * -(-page.width // wide):
        raise ValueError("strips or tiles don't cover the page")
    out = np.zeros((planes, page.height, page.width, deep), kind)
    k = 0
    for plane in range(planes):
        for y in range(0, page.height, tall):
            for x in range(0, page.width, wide):
                rows = tall if tiled else min(tall, page.height - y)
                size = rows * wide * deep * kind.itemsize
                raw = UNPACK[page.compression](data[places[k] : places[k] + sizes[k]], size)
                if len(raw) != size:
                    raise ValueError(f"a strip or tile holds {len(raw)} of {size} bytes")
                block = np.frombuffer(raw, kind.newbyteorder(order)).astype(kind).reshape(rows, wide, deep)
                if page.predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=kind)
                part = out[plane, y : y + rows, x : x + wide]
                part[:] = block[: part.shape[0], : part.shape[1]]
                k += 1
    page.pixels = (out[0] if planes == 1 else np.moveaxis(out[:, :, :, 0], 0, 2)).tobytes()


def read(data: bytes) -> Iterator[Page]:
    """Pages in the order of the directories; samples of a pixel follow each other, 16-bit ones little-endian."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        yield Page(0, error="not a TIFF file")
        return
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        page = Page(len(seen) - 1)
        try:
            fields, at = _fields(data, at, order)
        except struct.error:
            page.error = "directory beyond the end of the file"
            yield page
            return
        try:
            _decode(data, fields, order, page)
        except (ValueError, zlib.error, struct.error, MemoryError) as e:
            page.error = str(e) or type(e).__name__
        yield page


def pages(media: DataFrame, key: str, column: str, *carried: str) -> DataFrame:
    """One row per page of the TIFF files in binary `column`: key, `carried` columns, page fields, pixels or an error.

    Rows of a file follow each other in the order of its directories.  A null file has no pages;
    an empty one, or one that is no TIFF, has a row with an error, as has a page that can't be
    decoded, however long it is; a null key stays null; equal rows give equal rows; an empty table
    gives none.  Other columns are ignored, whatever their names.
    """
    names = [key, *carried]
    kinds = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in names)
    fields = ["page", "width", "height", "samples", "bits", "compression", "predictor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            held: list[Page] = []
            size = 0

            def rows(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                numbers = [pa.array(x, pa.int32()) for x in zip(*((p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor) for p in held), strict=True)]
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in range(len(names))), *numbers, pa.array([p.pixels for p in held], pa.binary()), pa.array([p.error for p in held], pa.string())], [*names, *fields, "pixels", "error"])

            for k in range(batch.num_rows):
                data = batch.column(len(names))[k].as_py()
                for p in read(data) if data is not None else ():
                    at.append(k)
                    held.append(p)
                    size += len(p.pixels or b"")
                    if size >= 1 << 22 or len(held) == 500:
                        yield rows()
                        at, held, size = [], [], 0
            if held:
                yield rows()

    return media.select(*names, column).mapInArrow(run, f"{kinds}, {PAGES}")


def as_pages(text: bytes) -> tuple[list[np.ndarray], int]:
    """The text, padded with spaces to a positive multiple of ROW, as pages of 8-bit rows."""
    size = max(1, -(-len(text) // ROW)) * ROW
    rows = np.frombuffer(text.ljust(size, b" "), np.uint8).reshape(-1, ROW)
    return [rows[y : y + PAGE_ROWS] for y in range(0, len(rows), PAGE_ROWS)], size


def store(text: bytes) -> bytes:
    """The text as a TIFF.  A checksum of the text picks its form, so equal texts have equal media.

    One text in 16 is packed by LZW and one by PackBits, the others are deflated; half have tiles
    instead of strips, and all but those of PackBits the predictor.
    """
    kept, _ = as_pages(text)
    pick = zlib.crc32(text)
    scheme = {0: LZW, 1: PACKBITS}.get(pick & 15, DEFLATE)
    tile = (min(TILE[0], -(-len(kept[0]) // 16) * 16), TILE[1]) if pick & 16 else None
    return write(kept, scheme, 1 if scheme == PACKBITS else 2, tile=tile)


def store_texts(docs: DataFrame) -> DataFrame:
    """no, doc_id, n_bytes and media, each whole text as a TIFF; written to the shared folder and read back.

    `no` numbers the rows, so that equal ones are told apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = [t.as_py() or b"" for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(len, texts), pa.int64()), pa.array([store(t) for t in texts], pa.binary())], ["no", "doc_id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("no"), "doc_id", "text")
    return stored(rows.mapInArrow(run, "no long, doc_id long, n_bytes long, media binary"), "tiff", "uncompressed")


def feature(counts: np.ndarray, n_pages: int) -> str:
    """Pages, rows, mean and deviation of the samples, and their shares in eight ranges, in ten-thousandths; from a count of each sample."""
    n, values = counts.sum(), np.arange(256)
    mean = (counts * values).sum() / n
    deviation = np.sqrt((counts * (values - mean) ** 2).sum() / n)
    shares = counts.reshape(8, 32).sum(axis=1) * 10_000 // n
    return f"{n_pages}:{n // ROW}:{mean:.3f}:{deviation:.3f}:" + ",".join(map(str, shares.tolist()))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each file from those of its pages, which follow each other."""
    names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    now, head, digest, size, tail, counts, n = None, (), hashlib.sha256(), 0, b"", np.zeros(256, np.int64), 0
    out: list[tuple] = []

    def end() -> None:
        doc_id, n_bytes, media_bytes, media_sha = head
        out.append((doc_id, n_bytes, size, digest.hexdigest(), zlib.crc32(tail), media_bytes, media_sha, feature(counts, n)))

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("no", "doc_id", "n_bytes", "media_bytes", "media_sha256", "error")), strict=True)
        for (no, *about, error), pixels in zip(keys, batch.column("pixels"), strict=True):
            if error:
                raise ValueError(f"stored media can't be read: {error}")
            if no != now:
                if now is not None:
                    end()
                now, head, digest, size, tail, counts, n = no, about, hashlib.sha256(), 0, b"", np.zeros(256, np.int64), 0
            data = pixels.as_py()
            digest.update(data)
            size, tail, n = size + len(data), (tail + data[-16:])[-16:], n + 1
            counts = counts + np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []
    if now is not None:
        end()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def text_round_trip(docs: DataFrame) -> DataFrame:
    """Store every whole text as TIFF, read its pages back and return sizes, digests and a feature of what was read.

    doc_id, n_bytes (unpadded), payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes),
    media_bytes, media_sha256 and feature.  Needs doc_id and text; other columns are ignored.  A
    null text counts as empty, and an empty one is a row of spaces.  A null doc_id stays null;
    equal texts give equal values, and each of several equal rows its own; an empty table gives no rows.
    """
    media = store_texts(docs)
    media = media.select("no", "doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    read_back = pages(media, "no", "media", "doc_id", "n_bytes", "media_bytes", "media_sha256")
    return read_back.mapInArrow(_folded, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
