"""Media columns: texts as baseline JPEG images that are read back by their markers and Huffman codes.

Each payload byte is one 8x8 block of even grey: its DC coefficient is the byte less 128 at quantiser step 8, and the block has no AC coefficient, so the
DC-only thumbnail is the payload itself but for two bytes changed for each other: the space stands among the letters (SWAP), which keeps differences small.
The table of DC codes is fitted to differences of text bytes. A text beyond one image (66 million bytes) is several, one after another. A restart interval of 64 blocks lets numpy code and decode all intervals of a group of texts at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import new_path

UNIT, LONGEST_SIDE = 64, 65535 // 8
#: DC codes: how many there are of each length, and their categories.
DC_COUNTS, DC_SYMBOLS = [0, 3, 0, 3, 1, 1, 1, 1, 0, 2, 0, 0, 0, 0, 0, 0], [3, 4, 5, 1, 2, 6, 7, 0, 8, 11, 9, 10]
#: The grey of each byte, which is also the byte of each grey.
SWAP = np.arange(256, dtype=np.uint8)
SWAP[[0x20, 0x60]] = 0x60, 0x20
#: Bytes of one image at most.
MOST = UNIT * (LONGEST_SIDE // UNIT) * LONGEST_SIDE
#: The only AC symbol is end of block, of one bit.
AC_COUNTS, AC_SYMBOLS = [1] + [0] * 15, [0]
#: Payload bytes that are coded together.
GROUP = 1 << 19


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length) of a Huffman table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at, code = at + n, code << 1
    return out


def side_lengths(n: int) -> tuple[int, int]:
    """Blocks across (a multiple of 64) and down that hold n bytes."""
    across = UNIT * max(1, -(-n // (UNIT * LONGEST_SIDE)))
    return across, -(-n // across)


def header(n_bytes: int, payload: int, across: int, down: int, scan: int) -> bytes:
    return b"".join([
        b"\xff\xd8",
        segment(0xFE, struct.pack(">QQQ", n_bytes, payload, scan)),
        segment(0xDB, bytes([0] + [8] * 64)),
        segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * down, 8 * across, 1, 1, 0x11, 0)),
        segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])),
        segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])),
        segment(0xDD, struct.pack(">H", UNIT)),
        segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def encode(texts: list[bytes]) -> list[bytes]:
    """The image or images of each text, zero bytes appended up to a positive multiple of 64."""
    cuts = [[t[a : a + MOST] for a in range(0, max(1, len(t)), MOST)] for t in texts]
    images = iter(_images([x for c in cuts for x in c]))
    return [b"".join(next(images) for _ in c) for c in cuts]


def _images(texts: list[bytes]) -> list[bytes]:
    table = codes(DC_COUNTS, DC_SYMBOLS)
    code, size = np.array([table[c][0] for c in range(9)]), np.array([table[c][1] for c in range(9)])
    payloads = [max(UNIT, -(-len(t) // UNIT) * UNIT) for t in texts]
    sides = [side_lengths(n) for n in payloads]
    ends = np.cumsum([a * d for a, d in sides])
    flat = np.zeros(int(ends[-1]) if len(texts) else 0, np.uint8)
    for t, e, (a, d) in zip(texts, ends, sides):
        flat[e - a * d : e - a * d + len(t)] = np.frombuffer(t, np.uint8)
    value = SWAP[flat].reshape(-1, UNIT).astype(np.int32) - 128
    diff = np.diff(value, axis=1, prepend=np.zeros((len(value), 1), np.int32))
    category = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int32)
    extra = np.where(diff > 0, diff, diff + (1 << category) - 1)
    word = ((code[category] << category) | extra) << 1
    length = size[category] + category + 1
    rows = np.arange(len(value))
    room = int(length.sum(axis=1).max(initial=0)) // 8 + 4
    out = np.zeros(len(value) * room, np.uint8)
    at, base = np.zeros(len(value), np.int64), rows * room
    for k in range(UNIT):
        put = word[:, k].astype(np.int64) << (24 - length[:, k] - (at & 7))
        place = base + (at >> 3)
        for b in range(3):
            out[place + b] |= ((put >> (16 - 8 * b)) & 255).astype(np.uint8)
        at += length[:, k]
    fill = np.where(at & 7, (1 << (8 - (at & 7))) - 1, 0).astype(np.uint8)
    out[base + (at >> 3)] |= fill
    n = (at + 7) >> 3
    data = out.reshape(-1, room)[np.arange(room) < n[:, None]]
    interval = np.repeat(rows, n)
    step = 1 + (data == 255)
    place = np.cumsum(step) - step + 2 * interval
    stop = np.cumsum(np.bincount(interval, step, len(rows)).astype(np.int64) + 2)
    scan = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint8)
    scan[place] = data
    last = ends // UNIT - 1
    first = np.repeat(np.concatenate([[0], last[:-1] + 1]) if len(last) else last, [a * d // UNIT for a, d in sides])
    scan[stop - 2] = 255
    scan[stop - 1] = 0xD0 + (rows - first) % 8
    scan[stop[last] - 1] = 0xD9
    cuts = np.concatenate([[0], stop[last]]) if len(last) else [0]
    return [header(len(t), p, *s, int(b - a)) + scan[a:b].tobytes() for t, p, s, a, b in zip(texts, payloads, sides, cuts[:-1], cuts[1:])]


@lru_cache(maxsize=8)
def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every 16 next bits; length 0: no code."""
    symbol, size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (c, n) in codes(list(table[:16]), list(table[16:])).items():
        symbol[c << (16 - n) : (c + 1) << (16 - n)] = s
        size[c << (16 - n) : (c + 1) << (16 - n)] = n
    return symbol, size


def parse(media: bytes) -> dict:
    """What the markers say, and where the scan starts."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, out = 2, {"tables": {}, "steps": {}, "restart": 0}
    while True:
        marker, size = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            if len(body) == 24:
                out["n_bytes"], out["payload"], out["length"] = struct.unpack(">QQQ", body)
        elif marker == 0xDB:
            for k in range(0, len(body), 65):
                out["steps"][body[k] & 15] = body[k + 1]
        elif marker == 0xC0:
            _, out["height"], out["width"], parts = struct.unpack_from(">BHHB", body)
            out["step_table"] = body[8]
            if parts != 1:
                raise ValueError("only luminance is read")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                out["tables"][body[0]], body = body[1:n], body[n:]
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            return out | {"scan": at, "codes": (body[2] >> 4, 0x10 | (body[2] & 15)), "step": out["steps"][out["step_table"]]}


def images_of(media: bytes) -> list[bytes]:
    """The images that stand one after another in a value of a media table."""
    out, at = [], 0
    while at < len(media):
        head = parse(media[at : at + 1024])
        out.append(media[at : at + head["scan"] + head["length"]])
        at += len(out[-1])
    return out


def decode_any(media: bytes) -> tuple[dict, np.ndarray]:
    """(markers' values, DC-only thumbnail) of any baseline image of luminance alone, with AC codes (which are skipped) and any restart interval or tables."""
    head = parse(media)
    (dc_symbol, dc_size), (ac_symbol, ac_size) = (lookup(head["tables"][k]) for k in head["codes"])
    across, down = -(-head["width"] // 8), -(-head["height"] // 8)
    raw = media[head["scan"] :]
    intervals, begin, k = [], 0, 0
    while k < len(raw) - 1:
        if raw[k] == 0xFF and raw[k + 1] != 0:
            intervals.append(raw[begin:k].replace(b"\xff\x00", b"\xff"))
            if not 0xD0 <= raw[k + 1] <= 0xD7:
                break
            begin = k = k + 2
        else:
            k += 1 + (raw[k] == 0xFF)
    out: list[int] = []
    for data in intervals:
        bits, left, total = int.from_bytes(data + b"\xff\xff\xff\xff"), 8 * len(data) + 32, 8 * len(data)

        def take(n: int) -> int:
            nonlocal left
            left -= n
            return (bits >> left) & ((1 << n) - 1)

        def symbol(symbols, sizes) -> int:
            nonlocal left
            head16 = (bits >> (left - 16)) & 0xFFFF
            if not sizes[head16]:
                raise ValueError("no such code")
            left -= int(sizes[head16])
            return int(symbols[head16])

        dc, blocks = 0, 0
        while len(out) < across * down and (not head["restart"] or blocks < head["restart"]) and left > 32:
            n = symbol(dc_symbol, dc_size)
            extra = take(n)
            dc += extra if n == 0 or extra >> (n - 1) else extra - (1 << n) + 1
            place = 1
            while place < 64:
                s = symbol(ac_symbol, ac_size)
                if s == 0:
                    break
                place += 1 + (s >> 4)
                take(s & 15)
            out.append(dc)
            blocks += 1
    grey = np.clip(np.array(out) * head["step"] // 8 + 128, 0, 255).astype(np.uint8)
    return head, grey.reshape(down, across)


def decode(media: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """(markers' values, DC-only thumbnail of luminance, one value for each block) of each image.

    Images like those of encode() are read together; one with AC codes, another restart interval or other tables lets each be read alone.
    """
    heads = [parse(m) for m in media]
    for h in heads:
        if h["restart"] != UNIT or h["tables"] != heads[0]["tables"] or h["step"] != heads[0]["step"] or h["tables"].get(0x10) != bytes([*AC_COUNTS, *AC_SYMBOLS]) or h["width"] % (8 * UNIT):
            return [decode_any(m) for m in media]
    data = np.frombuffer(b"".join(m[h["scan"] :] for m, h in zip(media, heads)), np.uint8)
    if not len(data):
        return []
    after = np.append(data[1:], 0)
    ff = data == 255
    marker = ff & (after != 0)
    drop = marker.copy()
    drop[1:] |= ff[:-1]
    interval = np.cumsum(marker)[~drop]
    data = data[~drop]
    n = np.bincount(interval, minlength=int(marker.sum()))
    room = int(n.max()) + 4
    rows = np.arange(len(n))
    buf = np.zeros(len(n) * room, np.int64)
    buf[interval * room + np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)] = data
    symbol, size = lookup(heads[0]["tables"][0x00])
    at, dc, base = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), rows * room
    out = np.empty((len(n), UNIT), np.int64)
    for k in range(UNIT):
        p = base + (at >> 3)
        bits = ((buf[p] << 24) | (buf[p + 1] << 16) | (buf[p + 2] << 8) | buf[p + 3]) << (at & 7)
        head = (bits >> 16) & 0xFFFF
        category, used = symbol[head], size[head]
        extra = (bits >> (32 - used - category)) & ((1 << category) - 1)
        dc += np.where(extra >> np.maximum(category - 1, 0) > 0, extra, extra - (1 << category) + 1)
        out[:, k] = dc
        at += used + category + 1
    step = heads[0]["step"]
    grey = np.clip(out * step // 8 + 128, 0, 255).astype(np.uint8).ravel()
    sizes = np.cumsum([0] + [h["width"] // 8 * (h["height"] // 8) for h in heads])
    return [(h, grey[a:b].reshape(h["height"] // 8, h["width"] // 8)) for h, a, b in zip(heads, sizes[:-1], sizes[1:])]


def thumbnail_hash(grey: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 grid are lighter than the whole."""
    down, across = grey.shape
    strips = grey.reshape(down, 8, across // 8).sum(axis=2, dtype=np.int64)
    sums = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(strips, axis=0)])
    low = np.arange(8) * down // 8
    high = np.maximum(low + 1, np.arange(1, 9) * down // 8)
    cells = (sums[high] - sums[low]) * down
    return np.packbits(cells * 8 > sums[-1].sum() * (high - low)[:, None]).tobytes().hex()


def _grouped(column):
    group, size = [], 0
    for x in column:
        group.append(x.as_py() or b"")
        size += len(group[-1])
        if size >= GROUP or len(group) >= 2000:
            yield group
            group, size = [], 0
    if group:
        yield group


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes (id, media) of all rows as a table in the shared folder and returns it as read again.

    Null and empty texts are one interval of zero bytes; equal texts have equal media; repeated rows and null ids stay; other columns are ignored; an
    empty table gives no rows. A text of any length is held whole.
    """

    def draw(batches):
        for batch in batches:
            images = [m for g in _grouped(batch.column(1)) for m in encode(g)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.large_binary()).cast(pa.binary())], names=["id", "media"])

    spark = docs.sparkSession
    path = new_path(spark, "media")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("bytes"))
    rows.mapInArrow(draw, "id long, media binary").write.option("compression", "zstd").parquet(path)
    return spark.read.schema("id long, media binary").parquet(path)


FIELDS = [("n_bytes", "int64"), ("payload_bytes", "int64"), ("payload_sha256", "string"), ("tail_crc32", "int64"), ("media_bytes", "int64"), ("media_sha256", "string"), ("feature", "string"), ("width", "int64"), ("height", "int64")]
SCHEMA = pa.schema([(n, pa.type_for_alias(t)) for n, t in FIELDS])


def media_features(media: DataFrame) -> DataFrame:
    """Reads images back: the payload's size and digests, the image's, its dimensions, and its thumbnail hash."""

    def look(batches):
        for batch in batches:
            rows = []
            for g in _grouped(batch.column(1)):
                cuts = [images_of(m) for m in g]
                seen = iter(decode([x for c in cuts for x in c]))
                for m, c in zip(g, cuts):
                    own = [next(seen) for _ in c]
                    payload = b"".join(SWAP[grey].ravel()[: h["payload"]].tobytes() for h, grey in own)
                    digest = [hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest()]
                    feature = "+".join(f"{h['width']}x{h['height']}:{thumbnail_hash(grey)}" for h, grey in own)
                    rows.append((sum(h["n_bytes"] for h, _ in own), len(payload), *digest, feature, own[0][0]["width"], sum(h["height"] for h, _ in own)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)] if rows else [pa.array([], t) for t in SCHEMA.types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *SCHEMA.names])

    kinds = ", ".join(f"{n} {'string' if t == 'string' else 'long'}" for n, t in FIELDS)
    return media.mapInArrow(look, f"id long, {kinds}")


def op2_media(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, read back from the stored images of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media_features(media_table(docs)).withColumnRenamed("id", "doc_id")
