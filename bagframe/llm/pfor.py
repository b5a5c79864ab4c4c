"""Token-id files in patched frame-of-reference blocks.

A file holds whole documents. Blocks of 256 ids are reduced by their minimum and packed at the width that holds PERCENTILE of them; the higher bits
of larger values stand in a list of exceptions after the block. The head has the documents (id, number of ids) and where each block starts.
All numbers are little-endian; after the document table everything is 32-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import new_path
from .tokens import encoder, groups, vocabulary

MAGIC, BLOCK, LANES, PERCENTILE = b"BFPFOR01", 256, 8, 90
#: Ids after which a file ends (with the document they belong to).
FILE_IDS = 1 << 18


def pack_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of these documents; ids are theirs, one after another."""
    n_blocks = -(-len(ids) // BLOCK)
    grid = np.full(n_blocks * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(n_blocks, BLOCK)
    low = grid.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    grid = grid - low[:, None]
    kth = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    usual = np.partition(grid, kth, axis=1)[:, kth] if n_blocks else low
    width = np.maximum(8, np.ceil(np.log2(usual.astype(np.float64) + 1))).astype(np.uint32)
    over = (grid.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    n_over = (over > 0).sum(axis=1, dtype=np.int64)
    starts = np.zeros(n_blocks + 1, np.int64)
    np.cumsum(width * LANES + n_over, out=starts[1:])
    body = np.zeros(starts[-1], np.uint32)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        lanes = (grid[at] & np.uint32((1 << int(w)) - 1)).reshape(len(at), BLOCK // LANES, LANES).transpose(1, 0, 2)
        words = np.zeros((int(w), len(at), LANES), np.uint32)
        for i in range(BLOCK // LANES):
            k, shift = divmod(i * int(w), 32)
            words[k] |= lanes[i] << np.uint32(shift)
            if shift + w > 32:
                words[k + 1] |= lanes[i] >> np.uint32(32 - shift)
        body[(starts[at][:, None] + np.arange(w * LANES)).ravel()] = words.transpose(1, 0, 2).ravel()
    block, place = np.nonzero(over)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        body[starts[block] + width[block] * LANES + nth] = place.astype(np.uint32) | (over[block, place] << np.uint32(8))
    known = np.array([x is not None for x in doc_ids], np.uint8)
    head = struct.pack("<8sQII", MAGIC, len(ids), len(doc_ids), n_blocks)
    table = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + counts.astype("<u4").tobytes() + known.tobytes()
    index = starts.astype("<u4").tobytes() + low.astype("<u4").tobytes() + width.astype(np.uint8).tobytes()
    return b"".join((head, table, index, body.astype("<u4").tobytes()))


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, their counts and all ids of a file."""
    magic, n, n_docs, n_blocks = struct.unpack_from("<8sQII", data)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    at = 24

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, counts, known = take("<i8", n_docs), take("<u4", n_docs), take("u1", n_docs)
    starts, low, width = take("<u4", n_blocks + 1).astype(np.int64), take("<u4", n_blocks), take("u1", n_blocks)
    body = take("<u4", int(starts[-1]))
    grid = np.empty((n_blocks, BLOCK), np.uint32)
    for w in map(int, np.unique(width)):
        b = np.flatnonzero(width == w)
        words = body[(starts[b][:, None] + np.arange(w * LANES)).ravel()].reshape(len(b), w, LANES).transpose(1, 0, 2)
        lanes = np.empty((BLOCK // LANES, len(b), LANES), np.uint32)
        for i in range(BLOCK // LANES):
            k, shift = divmod(i * w, 32)
            v = words[k] >> np.uint32(shift)
            if shift + w > 32:
                v = v | (words[k + 1] << np.uint32(32 - shift))
            lanes[i] = v & np.uint32((1 << w) - 1)
        grid[b] = lanes.transpose(1, 0, 2).reshape(len(b), BLOCK)
    packed = width.astype(np.int64) * LANES
    n_over = starts[1:] - starts[:-1] - packed
    block = np.repeat(np.arange(n_blocks), n_over)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        extra = body[starts[block] + packed[block] + nth]
        grid[block, extra & np.uint32(255)] |= (extra >> np.uint32(8)) << width[block].astype(np.uint32)
    grid += low[:, None]
    return [int(x) if k else None for x, k in zip(doc_ids, known)], counts, grid.ravel()[:n]


FILES = "part int, file_no int, before long, n_docs int, n_ids long, data binary"


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Encodes whole texts in ascending id order and writes them as token-id files; returns the table of the written files.

    The files are the cells `data` of a Parquet table in the shared folder, so any store that Spark reaches can hold them. Ids are ordered by a range
    shuffle, so part (and file_no within) is their order; `before` counts the ids of the part's files before this one. Null text: only the end id.
    Null ids come first; rows of one id are ordered by text. Other columns are ignored. An empty table gives no files.
    """

    def write(batches):
        path = vocabulary_path or vocabulary()
        part, no, before = TaskContext.get().partitionId(), 0, 0
        ids, blobs, size = [], [], 0

        def file():
            nonlocal no, before, ids, blobs, size
            counts = np.array([len(b) // 4 for b in blobs], np.int64)
            data = pack_file(ids, counts, np.frombuffer(b"".join(blobs), "<u4"))
            out = pa.RecordBatch.from_pylist([{"part": part, "file_no": no, "before": before, "n_docs": len(ids), "n_ids": size, "data": data}], WRITTEN)
            no, before, ids, blobs, size = no + 1, before + size, [], [], 0
            return out

        end = struct.pack("<I", end_id)
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in groups(texts):
                for key, blob in zip(keys[a:b], encoder(path).encode(texts[a:b])):
                    ids.append(key)
                    blobs.append(blob + end)
                    size += len(blob) // 4 + 1
                    if size >= FILE_IDS:
                        yield file()
        if ids:
            yield file()

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    path = new_path(spark, "token-files")
    ordered.mapInArrow(write, FILES).write.parquet(path)
    return spark.read.schema(FILES).parquet(path)


WRITTEN = pa.schema([("part", pa.int32()), ("file_no", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("data", pa.binary())])
READ = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def token_rows(files: DataFrame) -> DataFrame:
    """Reads token-id files: id, start (ids of all documents before it), n_tokens, ids_crc32 of each document.

    Only the parts' totals, one row for each task that wrote, are summed in order; they are broadcast.
    """
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))

    def read(batches):
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts, ids = unpack_file(data.as_py())
                ends = np.cumsum(counts.astype(np.int64))
                blob, at = ids.astype("<u4").tobytes(), np.concatenate([[0], ends]).tolist()
                crc = [zlib.crc32(memoryview(blob)[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.array(at[:-1], np.int64) + start), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], schema=READ)

    placed = files.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("start"), "data")
    return placed.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, read back from the files of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_rows(token_files(docs)).withColumnRenamed("id", "doc_id")
