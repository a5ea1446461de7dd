"""Per-key results and joins where a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_PARTIAL = "field_name string, key_value string, part int, seq int, n_rows bigint, n_neighbours bigint, first_neighbour string, last_neighbour string"


def _partial_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of a key in a sorted partition: rows, distinct neighbours, and the neighbours at both ends.

    The last run of a batch stays open until the next batch shows whether it goes on."""
    part, names = TaskContext.get().partitionId(), ["field_name", "key_value", "part", "seq", "n_rows", "n_neighbours", "first_neighbour", "last_neighbour"]
    open_, seq = None, 0

    def rows_of(runs: list[list]) -> pa.RecordBatch:
        nonlocal seq
        columns = list(zip(*runs))
        order = range(seq, seq + len(runs))
        seq += len(runs)
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        values = [columns[0], columns[1], [part] * len(runs), order, *columns[2:]]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(i) for i in range(3)]
        same_key = pc.and_(*(pc.equal(c.slice(1), c.slice(0, n - 1)) for c in columns[:2]))
        neighbour = columns[2]
        same_neighbour = pc.fill_null(pc.equal(neighbour.slice(1), neighbour.slice(0, n - 1)), False)
        new_key = pa.concat_arrays([pa.array([True]), pc.invert(same_key)])
        new_neighbour = pc.and_(pc.or_(new_key, pa.concat_arrays([pa.array([True]), pc.invert(same_neighbour)])), pc.is_valid(neighbour))
        starts = pc.indices_nonzero(new_key).to_numpy()
        ends = [*starts[1:].tolist(), n]
        counted = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(new_neighbour.cast(pa.int64()))]).to_numpy()
        at = pa.array(starts)
        last = neighbour.take(pa.array([e - 1 for e in ends])).to_pylist()
        runs = [
            [f, k, e - s, int(counted[e] - counted[s]), first, end]
            for f, k, s, e, first, end in zip(columns[0].take(at).to_pylist(), columns[1].take(at).to_pylist(), starts.tolist(), ends, neighbour.take(at).to_pylist(), last)
        ]
        if open_ is not None:
            if runs[0][:2] == open_[:2]:
                goes_on = open_[5] is not None and open_[5] == runs[0][4]
                runs[0] = [*open_[:2], open_[2] + runs[0][2], open_[3] + runs[0][3] - goes_on, open_[4], runs[0][5]]
            else:
                runs.insert(0, open_)
        open_ = runs.pop()
        if runs:
            yield rows_of(runs)
    if open_ is not None:
        yield rows_of([open_])


def per_key_states(rows: DataFrame, keys: dict[str, str], order: str, partitions: int | None = None) -> DataFrame:
    """(field_name, key_value, n_rows, n_neighbours) for every value of every key column, with evenly spread work.

    keys: key column -> neighbour column; order: a column of unique ids. The rows are range-partitioned by (field, key,
    neighbour, order) with sampled quantiles, so a heavy key, and even a heavy (key, neighbour) pair, is cut across as
    many partitions as its rows need. Each sorted partition gives one partial state for each run of a key; stitching
    adds them up and takes one neighbour off where a run of one neighbour crosses a boundary.

    A null key has no result; a null neighbour counts as a row, not as a neighbour. Keys are compared as stored. Empty
    input gives no rows. Columns of rows beside those named play no part, whatever their names.
    """
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    entry = lambda k, v: F.struct(F.lit(k).alias("field_name"), F.col(f"`{k}`").cast("string").alias("key_value"), F.col(f"`{v}`").cast("string").alias("neighbour"))
    long = (
        rows.select(F.col(f"`{order}`").alias("__order"), F.explode(F.array(*[entry(k, v) for k, v in keys.items()])).alias("e"))
        .select("e.field_name", "e.key_value", "e.neighbour", "__order")
        .filter(F.col("key_value").isNotNull())
    )
    at = ["field_name", "key_value", "neighbour", "__order"]
    ranged = long.repartitionByRange(partitions, *at).sortWithinPartitions(*at).select(*at[:3])
    partial = ranged.mapInArrow(_partial_states, _PARTIAL)
    before = Window.partitionBy("field_name", "key_value").orderBy("part", "seq")
    crossing = F.coalesce((F.lag("last_neighbour").over(before) == F.col("first_neighbour")).cast("bigint"), F.lit(0))
    return partial.withColumn("crossing", crossing).groupBy("field_name", "key_value").agg(F.sum("n_rows").alias("n_rows"), (F.sum("n_neighbours") - F.sum("crossing")).alias("n_neighbours"))


def heavy_keys(states: DataFrame, total: int, share: float) -> DataFrame:
    """The (field_name, key_value) that hold more than share of all total rows."""
    return states.filter(F.col("n_rows") > F.lit(float(share)) * F.lit(int(total))).select("field_name", "key_value")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, most_hot: int = 1000) -> DataFrame:
    """Inner join of rows with groups (one row per key, size = its number of rows), also where one key holds a third of rows.

    Keys with more than total / most_hot rows, which cannot be more than most_hot, are broadcast: their rows stay where
    they are. All others are shuffled; no partition of those gets more than its share plus total / most_hot rows.
    """
    limit = total / most_hot
    hot, cold = groups.filter(F.col(size) > limit), groups.filter(F.col(size) <= limit)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], rows_a_task: int = 100_000) -> DataFrame:
    """Inner join of left and right, both of which may hold many rows of one key.

    A key with more than rows_a_task left rows is cut into so many salts; its left rows are spread over them by hash and
    its right rows repeated for each. The table of such keys has at most the number of left rows / rows_a_task rows, one
    in rows_a_task, and is broadcast. The result is that of left.join(right, keys); null keys match nothing."""
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > rows_a_task).select(*keys, F.ceil(F.col("__n") / rows_a_task).cast("int").alias("__salts"))
    salts = F.coalesce("__salts", F.lit(1))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), salts).cast("int")
    a = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", spread).drop("__salts")
    b = right.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return a.join(b, [*keys, "__salt"]).drop("__salt")
