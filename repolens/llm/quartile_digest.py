"""Document fingerprints: quartiles of hashed byte triplets.

Every three adjacent bytes of the UTF-8 text are hashed into one of 256 buckets; a bucket's count is coded by the
quartile of all bucket counts that it lies in (two bits), and the length by its logarithm (one byte). A fingerprint
is these 65 bytes in hex. Two fingerprints differ by the sum of their quartile steps plus twice the difference of the
length codes, bounded by `FARTHEST`, about what unrelated texts reach; likeness is 1 - difference / bound. Texts
under three bytes have no triplet and only their length. Equal texts have equal fingerprints.

Each document is compared with its edited text (its last third replaced by the start of the next document in
descending doc_id order) and with that next document. Order: doc_id descending, null last, equal ids by text; after
the last comes the first. Documents are dealt by ranges of doc_id; the first document of the range below each range
is dealt to both, so neighbours meet without a global sort task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deal_by_shard, shard_bounds, shard_of

BUCKETS = 256
FARTHEST = 320
EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def codes(text: str) -> np.ndarray:
    """Quartile code of each bucket and, last, the length code."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.zeros(BUCKETS + 1, np.int16)
    out[-1] = min(255, int(round(np.log1p(len(data)) * 12)))
    if len(data) >= 3:
        b = data.astype(np.uint32)
        mixed = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)
        counts = np.bincount(mixed >> np.uint32(24), minlength=BUCKETS)
        at = np.sort(counts)
        for q in (64, 128, 192):
            out[:-1] += counts > at[q - 1]
    return out


def printed(code: np.ndarray) -> str:
    quarters = code[:-1].astype(np.uint8).reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    return bytes([int(code[-1])]).hex() + np.bitwise_or.reduce(quarters, axis=1).tobytes().hex()


def parsed(digest: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    quarters = (raw[1:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return np.append(quarters.ravel(), raw[0]).astype(np.int16)


def near(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two codes, 0 to 1."""
    steps = np.abs(a - b)
    return 1.0 - min(FARTHEST, int(steps[:-1].sum()) + 2 * int(steps[-1])) / FARTHEST


def likeness(a: str, b: str) -> float:
    """Likeness of two printed fingerprints, 0 to 1."""
    return near(parsed(a), parsed(b))


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compared(key: int | None, text: str, code: np.ndarray, following: str, next_code: np.ndarray) -> tuple:
    other = edited(text, following)
    changed = codes(other)
    return (
        key, len(text), hashlib.sha256(other.encode("utf-8", "replace")).hexdigest(), printed(code), printed(changed),
        near(code, changed), near(code, next_code),
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """`EDITED` row per document; an empty table gives none."""
    bounds = shard_bounds(docs, "doc_id")
    last = docs.agg(F.max("doc_id")).first()[0]
    own = shard_of(F.col("doc_id"), bounds)
    places = [F.struct(own.alias("shard"), F.lit(False).alias("again"))]
    if bounds:
        edge = F.get(F.array(*[F.lit(b).cast("long") for b in bounds]), own)
        places.append(F.when(F.col("doc_id") == edge, F.struct((own + 1).alias("shard"), F.lit(True).alias("again"))))
    if last is not None:  # the first document also follows the last one
        places.append(F.when(F.col("doc_id") == last, F.struct(F.lit(0).alias("shard"), F.lit(True).alias("again"))))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "place", F.explode(F.array_compact(F.array(*places)))
    ).select("doc_id", "text", "place.shard", "place.again")
    # a document that also follows its own range stands at the end
    sorted_rows = deal_by_shard(dealt, bounds).sortWithinPartitions(F.col("again"), F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in EDITED.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = first = None
        for batch in batches:
            out = []
            for key, text, again in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                code = codes(text)
                first = first or (key, text, code)
                if held is not None:
                    out.append(compared(*held, text, code))
                held = None if again else (key, text, code)
                if len(out) == 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        if held is not None:  # only null ids: the first row follows the last
            row = compared(*held, first[1], first[2])
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types)], names=names)

    return sorted_rows.mapInArrow(run, EDITED)
