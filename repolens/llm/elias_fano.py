"""Token ids on disk: one concatenated id array per block, document boundaries in Elias-Fano code.

A block holds the ids of many documents without gaps and the n + 1 boundaries between them. Of each boundary
the `low_bits` lowest bits stand packed side by side; the rest is written in unary into a bit vector, so a
boundary costs about 2 + log2(ids / documents) bits instead of 64. `select(i)` finds the i-th set bit from a
sample of every 64th one. Documents lie in ascending doc_id order over all blocks (null first); documents with
the same doc_id stand in the order of their ids, so repeated rows give the same file again.

A file is a Parquet table with one row per block (shard, block, doc_ids, n_ids, width, ids, low_bits, low, high,
samples): Spark's own writer commits it on any store. Blocks end after `BLOCK_IDS` ids, between documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import deal_by_shard, new_path, shard_bounds, shard_of, starts_of
from .tokens import encoder, slices

BLOCK_IDS = 1 << 20
SAMPLE = 64
ENCODED = "doc_id long, shard int, n_ids long, width int, ids binary"
BLOCK = (
    "shard int, block int, doc_ids array<long>, n_ids long, width int, ids binary, "
    "low_bits int, low binary, high binary, samples array<int>"
)


class EliasFano:
    """A non-decreasing sequence of numbers from 0 to `top`."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, int(top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.int32))

    def select(self, i: int) -> int:
        """The i-th value, from one sample and the bits behind it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little").copy()
        bits[: at % 8] = 0
        while (found := int(bits.sum())) <= left:
            left -= found
            byte += 1
            bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        one = byte * 8 + int(np.flatnonzero(bits)[left])
        a = i * self.low_bits
        piece = np.unpackbits(self.low[a // 8 : (a + self.low_bits + 7) // 8], bitorder="little")[a % 8 :][: self.low_bits]
        return ((one - i) << self.low_bits) | int((piece.astype(np.int64) << np.arange(len(piece))).sum())

    def selected(self, a: int, b: int) -> np.ndarray:
        """`select` of a to b - 1 at once: from the sample before a, over the bits up to the sample behind b."""
        first = int(self.samples[a // SAMPLE])
        after = (b - 1) // SAMPLE + 1
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[first // 8 : end // 8 + 1], bitorder="little").copy()
        bits[: first % 8] = 0
        i = np.arange(a, b)
        ones = np.flatnonzero(bits)[a % SAMPLE :][: b - a] + first // 8 * 8
        if not self.low_bits:
            return ones - i
        at = a * self.low_bits
        packed = np.unpackbits(self.low[at // 8 : (b * self.low_bits + 7) // 8], bitorder="little")[at % 8 :][: (b - a) * self.low_bits]
        low = (packed.reshape(b - a, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return ((ones - i) << self.low_bits) | low

    def values(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else np.zeros(self.n, np.int64)
        return ((ones - np.arange(self.n)) << self.low_bits) | low


def packed(ids: np.ndarray) -> tuple[int, bytes]:
    """Bytes per id and the ids, little-endian."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return width, ids.astype(f"<u{width}").tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{width}").astype("<u4")


def encode_documents(docs: DataFrame, path: str, keep_spaces: bool, end_id: int) -> DataFrame:
    """`ENCODED` row per document, each shard sorted by (doc_id, ids); `docs` needs doc_id and text, null text is empty.

    The text is read once and never shuffled: ids are, at two bytes each.
    """
    bounds = shard_bounds(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, keep_spaces)
        for batch in batches:
            keys, shards, texts = batch.column(0), batch.column(1), batch.column(2)
            for a, b in slices(batch.num_rows, 256):
                found = [np.append(x, np.uint32(end_id)) for x in tool.encode(texts.slice(a, b - a).to_pylist())]
                data = [packed(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), shards.slice(a, b - a), pa.array([len(x) for x in found], pa.int64()),
                     pa.array([w for w, _ in data], pa.int32()), pa.array([d for _, d in data], pa.binary())],
                    names=["doc_id", "shard", "n_ids", "width", "ids"],
                )

    coded = docs.select(F.col("doc_id").cast("long"), shard_of(F.col("doc_id"), bounds).alias("shard"), "text").mapInArrow(run, ENCODED)
    return deal_by_shard(coded, bounds).sortWithinPartitions("doc_id", "ids")


def write_ids(docs: DataFrame, path: str, vocabulary: str, keep_spaces: bool, end_id: int) -> None:
    """Encode `docs` (doc_id, text) and write the block table to `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"shard": None, "block": 0}
        keys: list = []
        parts: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            code = EliasFano.of(np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
            width, data = packed(ids)
            row = [state["shard"], state["block"], list(keys), len(ids), width, data, code.low_bits, code.low.tobytes(), code.high.tobytes(), code.samples.tolist()]
            state["block"] += 1
            keys.clear()
            parts.clear()
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
            names = [c.split()[0] for c in BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            for key, shard, width, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if keys and (held >= BLOCK_IDS or shard != state["shard"]):
                    yield block()
                    held = 0
                if shard != state["shard"]:
                    state.update(shard=shard, block=0)
                ids = unpacked(data, width)
                keys.append(key)
                parts.append(ids)
                held += len(ids)
        if keys:
            yield block()

    encode_documents(docs, vocabulary, keep_spaces, end_id).mapInArrow(run, BLOCK).write.option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document and, if asked for, (width, ids), from the files alone.

    The boundaries of a run of documents are selected from the code; the boundaries of a block are never a table.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    totals = blocks.groupBy("shard", "block").agg(F.sum("n_ids").alias("n"))
    # one row per block of BLOCK_IDS ids; the running sum inside a shard is a window over its few blocks
    from pyspark.sql import Window

    inside = totals.withColumn(
        "inside", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    bases = starts_of(totals.groupBy("shard").agg(F.sum("n").alias("total")), "shard", "total")
    placed = inside.join(F.broadcast(bases), "shard").select("shard", "block", (F.col("base") + F.col("inside")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(i)[row].as_py() for i, name in enumerate(batch.schema.names)}
                ids = unpacked(r["ids"], r["width"])
                code = EliasFano(
                    len(r["doc_ids"]) + 1, r["low_bits"], np.frombuffer(r["low"], np.uint8), np.frombuffer(r["high"], np.uint8),
                    np.asarray(r["samples"], np.int32),
                )
                view, raw = memoryview(ids.tobytes()), memoryview(r["ids"])
                w = r["width"]
                for a, b in slices(len(r["doc_ids"]), 1024):
                    at = code.selected(a, b + 1).tolist()
                    spans = list(zip(at, at[1:]))
                    columns = [
                        pa.array(r["doc_ids"][a:b], pa.int64()), pa.array([r["base"] + s for s, _ in spans], pa.int64()),
                        pa.array([e - s for s, e in spans], pa.int64()), pa.array([zlib.crc32(view[4 * s : 4 * e]) for s, e in spans], pa.int64())]
                    if with_ids:
                        columns += [pa.array([w] * (b - a), pa.int32()), pa.array([bytes(raw[w * s : w * e]) for s, e in spans], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", width int, ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return blocks.join(placed, ["shard", "block"]).mapInArrow(run, schema)


def token_id_files(
    docs: DataFrame, vocabulary: str, keep_spaces: bool = False, end_id: int = 2, path: str | None = None, with_ids: bool = True
) -> DataFrame:
    """Write the files of `docs` and read them back; an empty table gives files without blocks and no row."""
    path = path or new_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, vocabulary, keep_spaces, end_id)
    return read_documents(docs.sparkSession, path, with_ids)
