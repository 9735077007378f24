"""Concatenate and cut: all documents in one stream of ids, cut every `length` ids.

First pass: ids of each document in doc_id order, a running sum inside each partition and the total of each
partition. Second pass: sums of the totals before a partition shift its running sums to global offsets, and a
document becomes one boundary record per window that it touches. Only the last window can be short, so at most
`length` - 1 places of the whole output are padding. Null text is the empty text: its end id alone. Rows that
share a doc_id are packed one after the other. An empty table has no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import starts_of, stored
from .elias_fano import encode_documents, unpacked
from .tokens import slices

PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, width int, ids binary"
)


def placed_documents(docs: DataFrame, vocabulary: str, keep_spaces: bool, end_id: int) -> DataFrame:
    """(doc_id, shard, inside, n_ids, width, ids): `inside` counts the ids before the document in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ends - n, pa.int64()), *(batch.column(i) for i in (2, 3, 4))],
                names=["doc_id", "shard", "inside", "n_ids", "width", "ids"],
            )
            before = int(ends[-1]) if len(ends) else before

    coded = encode_documents(docs, vocabulary, keep_spaces, end_id)
    return stored(coded.mapInArrow(run, "doc_id long, shard int, inside long, n_ids long, width int, ids binary"), "placed")


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, keep_spaces: bool = True, end_id: int = 1) -> DataFrame:
    """One `PIECE` row per part of a document in a sequence, with its ids."""
    placed = placed_documents(docs, vocabulary, keep_spaces, end_id)
    bases = starts_of(placed.groupBy("shard").agg(F.sum("n_ids").alias("total")), "shard", "total")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.num_rows, 256):
                yield cut(batch.slice(a, b - a), length)

    whole = placed.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("inside")).alias("at"), "n_ids", "width", "ids")
    return whole.mapInArrow(run, PIECE)


def cut(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Boundary records of some documents."""
    at, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    first, last = at // length, (at + n - 1) // length
    counts = last - first + 1
    doc = np.repeat(np.arange(len(n)), counts)
    sequence = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + first[doc]
    begin = np.maximum(sequence * length, at[doc])
    end = np.minimum((sequence + 1) * length, at[doc] + n[doc])
    start = begin - at[doc]
    widths, data = batch.column(3).to_pylist(), batch.column(4)
    crc, parts, held, ids = [], [], -1, b""
    for d, s, e in zip(doc.tolist(), start.tolist(), (start + end - begin).tolist()):
        if d != held:
            held, raw = d, data[d].as_py()
            ids = memoryview(unpacked(raw, widths[d]).tobytes())
        crc.append(zlib.crc32(ids[4 * s : 4 * e]))
        parts.append(raw[widths[d] * s : widths[d] * e])
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(end - begin), pa.array(crc, pa.int64()), pa.array(n[doc]),
         pa.array(sequence), pa.array(begin - sequence * length), pa.array([widths[d] for d in doc], pa.int32()), pa.array(parts, pa.binary())],
        names=[c.split()[0] for c in PIECE.split(", ")],
    )
