"""Duplicates hidden by formatting: one record per set of copies, with the number of copies.

Records are equal if their canonical keys are. A first pass over 64-bit hashes of the keys builds two Bloom filters in
each partition, of hashes seen once and of hashes seen repeatedly, and merges them: a bit is *repeated* if it was set
twice anywhere. Rows with a bit that is not repeated are singletons for certain and never move; only the possible
repeats are shuffled, grouped by their full canonical key, so false positives of the filter cost time, not exactness.

The filter is cut into segments, whose number grows with the rows; all bits of a hash lie in one. Partitions send the
positions of a segment, or its bits where those are fewer bytes, and the segments are merged in two rounds, so that no
task reads more than a root of the partitions. The filter has eight bits a row up to max_filter_bytes, which bounds what
the driver gathers and broadcasts: at the default that is 2^26 (67 million) rows. Beyond, it fills up and passes more
singletons on (at one bit a row, 2^29 rows, about a third of them); the result stays exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.operators.skew import join_groups
from lattiq.plans.lineage import written

BITS_A_ROW = 8
PROBES = 2
MAX_FILTER_BYTES = 64 << 20
#: The filter is merged in segments of this many bits.
SEGMENT_BITS = 1 << 20
#: Partitions that are merged in one round; more take two.
ONE_ROUND = 256

_NO_LETTER = r"[^\p{L}\p{N}]+"


def canonical_word(column: Column) -> Column:
    """column without letter case, white space and punctuation."""
    return F.regexp_replace(F.lower(column.cast("string")), _NO_LETTER, "")


def canonical_id(column: Column, member: int = 7) -> Column:
    """As canonical_word; the members (of so many digits) of a grouped id in ascending order."""
    word = canonical_word(column)
    grouped = word.rlike(rf"^(?:\d{{{member}}}){{2,}}$")
    return F.when(grouped, F.array_join(F.array_sort(F.regexp_extract_all(word, F.lit(rf"(\d{{{member}}})"), F.lit(1))), "")).otherwise(word)


def _positions(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each hash, and PROBES bit positions in it, as columns."""
    h = hashes.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    within = np.stack([(low + np.uint64(i) * high) % np.uint64(SEGMENT_BITS) for i in range(PROBES)], axis=1)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(segments)).astype(np.int64), within.astype(np.uint32)


def _packed(positions: np.ndarray) -> tuple[bool, bytes]:
    """Positions in a segment as bytes, or as bits where those are fewer bytes (dense)."""
    if 4 * len(positions) <= SEGMENT_BITS // 8:
        return False, positions.astype(np.uint32).tobytes()
    bits = np.zeros(SEGMENT_BITS, bool)
    bits[positions] = True
    return True, np.packbits(bits).tobytes()


def _unpacked(dense: bool, data: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))) if dense else np.frombuffer(data, np.uint32)


_PARTS = "segment bigint, grp int, once_dense boolean, once binary, more_dense boolean, more binary"
_PART_NAMES = ["segment", "grp", "once_dense", "once", "more_dense", "more"]


def _builder(segments: int, groups: int):
    """Partition of hashes -> for each segment the positions that were hit once and more often."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, parts = TaskContext.get().partitionId() % groups, []
        for batch in batches:
            hashes = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            segment, places = _positions(hashes, segments)
            # one record sets each of its bits once, also where two of its probes agree
            places = np.sort(places, axis=1)
            keep = np.ones(places.shape, bool)
            keep[:, 1:] = places[:, 1:] != places[:, :-1]
            parts.append((segment[:, None] * SEGMENT_BITS + places)[keep])
        if not parts:
            return
        at, n = np.unique(np.concatenate(parts), return_counts=True)
        segment, within = at // SEGMENT_BITS, at % SEGMENT_BITS
        bounds = np.searchsorted(segment, np.append(np.unique(segment), segments))
        for s, low, high in zip(np.unique(segment), bounds[:-1], bounds[1:]):
            once, more = within[low:high][n[low:high] == 1], within[low:high][n[low:high] > 1]
            row = (int(s), grp, *_packed(once), *_packed(more))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _KINDS)], names=_PART_NAMES)

    return build


_KINDS = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.bool_(), pa.binary()]


def _merge(key: tuple, parts: pa.Table) -> pa.Table:
    """The bits of one segment that were set once, and more often, in all parts together."""
    seen, repeated = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
    for row in zip(*(parts.column(c) for c in _PART_NAMES[2:])):
        once_dense, once, more_dense, more = (x.as_py() for x in row)
        o, m = _unpacked(once_dense, once), _unpacked(more_dense, more)
        repeated[m] = True
        repeated[o[seen[o]]] = True
        seen[o] = True
        seen[m] = True
    row = (key[0].as_py(), 0, *_packed(np.flatnonzero(seen & ~repeated)), *_packed(np.flatnonzero(repeated)))
    return pa.table([pa.array([v], t) for v, t in zip(row, _KINDS)], names=_PART_NAMES)


def repeat_filter(hashes: DataFrame, rows: int, max_filter_bytes: int = MAX_FILTER_BYTES) -> Column:
    """A condition on a column "hash" that holds for every hash that occurs twice in hashes, and for few others."""
    segments = max(1, -(-min(rows * BITS_A_ROW, max_filter_bytes * 8) // SEGMENT_BITS))
    partitions = hashes.rdd.getNumPartitions()
    groups = 1 if partitions <= ONE_ROUND else math.isqrt(partitions)
    parts = hashes.mapInArrow(_builder(segments, groups), _PARTS)
    if groups > 1:
        parts = parts.groupBy("segment", "grp").applyInArrow(_merge, _PARTS)
    merged = parts.groupBy("segment").applyInArrow(_merge, _PARTS).select("segment", "more_dense", "more").collect()  # at most max_filter_bytes
    packed = np.zeros((segments, SEGMENT_BITS), bool)
    for row in merged:
        packed[row.segment, _unpacked(row.more_dense, bytes(row.more))] = True
    shared = hashes.sparkSession.sparkContext.broadcast(np.packbits(packed, axis=1))

    def probe(column: pd.Series) -> pd.Series:
        segment, places = _positions(column.to_numpy(np.int64), segments)
        byte, bit = (places >> 3).astype(np.int64), (7 - (places & 7)).astype(np.uint8)
        return pd.Series(((shared.value[segment[:, None], byte] >> bit) & 1).all(axis=1))

    return F.pandas_udf(probe, T.BooleanType())(F.col("hash"))


def copy_groups(rows: DataFrame, row_id: str, keys: list[Column], max_filter_bytes: int = MAX_FILTER_BYTES) -> tuple[DataFrame, DataFrame]:
    """(records, copies) of rows, equal where all canonical keys are.

    records: (first_id, n_copies), one row for each distinct record, named by its smallest id; n_copies counts the
    record itself. copies: (first_id, copy_id), one row for each further copy. A row with a null in any key is a record
    of its own; empty keys are values like any other. Empty input gives none. Rows that repeat an id count as one copy
    each, but are no copy of themselves in copies. Other columns of rows play no part.
    """
    names = [f"k{i}" for i in range(len(keys))]
    keyed = rows.select(F.col(f"`{row_id}`").alias("id"), *[k.alias(n) for k, n in zip(keys, names)])
    complete = keyed.dropna(subset=names)
    hashed = complete.withColumn("hash", F.xxhash64(*names))
    total = rows.count()
    maybe = repeat_filter(hashed.select("hash"), total, max_filter_bytes)
    flagged = written(hashed.withColumn("maybe", maybe).select("id", *[F.when(F.col("maybe"), F.col(n)).alias(n) for n in names], "maybe"))
    possible = flagged.filter("maybe").drop("maybe")
    groups = possible.groupBy(*names).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    singles = flagged.filter(~F.col("maybe")).select(F.col("id").alias("first_id")).unionByName(keyed.filter(" OR ".join(f"{n} IS NULL" for n in names)).select(F.col("id").alias("first_id")))
    records = groups.select("first_id", "n_copies").unionByName(singles.withColumn("n_copies", F.lit(1).cast("bigint")))
    several = groups.filter("n_copies > 1")
    copies = join_groups(possible, several, names, "n_copies", max(total, 1)).filter("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
    return records, copies
