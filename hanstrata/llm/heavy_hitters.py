"""Most frequent values in bounded memory: a heavy-light sketch with an exact finish.

Hot values sit in exact buckets of a few cells. A value that finds its bucket full votes against
it; once the votes outweigh the bucket's weakest cell by EVICT_VOTES to one, that cell is evicted
and the newcomer moves in. Evicted and refused counts fall into a compact array of counters.
Sketches of input splits are cut by bucket range, and ranges are merged in parallel: cells of the
same value add up, the largest stay, the rest fall into the counters of the merged range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hanstrata.runtime import checkpoint, require_columns

BUCKETS = 1 << 12
CELLS = 8
COUNTERS = 1 << 16
EVICT_VOTES = 8
#: Rows that are pre-aggregated before they enter the sketch.
ROWS_PER_STEP = 1 << 17
RANGES = 32
#: Sketches are built by at most so many tasks for each core, whatever the number of splits.
SKETCHES_PER_CORE = 16


class Sketch:
    """Buckets [first, first + n) of one column and the counters of the same share of hashes.

    Bucket and counter of a value both follow from its hash, and a counter belongs to one bucket
    only, so any range of buckets can be merged on its own.
    """

    def __init__(self, first: int = 0, n: int = BUCKETS):
        self.first, self.n = first, n
        self.hash = np.zeros(0, np.int64)
        self.value = np.zeros(0, object)
        self.votes = np.zeros(0, np.int64)
        self.against = np.zeros(n, np.int64)
        self.light = np.zeros(n * (COUNTERS // BUCKETS), np.int64)

    def counter(self, hashes: np.ndarray) -> np.ndarray:
        return hashes % COUNTERS - self.first * (COUNTERS // BUCKETS)

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return hashes % COUNTERS // (COUNTERS // BUCKETS) - self.first

    def add(self, hashes: np.ndarray, values: np.ndarray, votes: np.ndarray) -> None:
        """Puts counted values in: recombines every bucket they touch. Hashes are not negative."""
        if not len(hashes):
            return
        resident = len(self.hash)
        h = np.concatenate([self.hash, hashes])
        v = np.concatenate([self.value, values])
        c = np.concatenate([self.votes, votes])
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        total, first = np.add.reduceat(c, start), order[start]
        h, v, stays = h[start], v[first], first < resident
        bucket = self.bucket(h)
        # residents first, then newcomers by votes: a newcomer gets a free cell, or votes against
        order = np.lexsort((-total, ~stays, bucket))
        h, v, total, stays, bucket = h[order], v[order], total[order], stays[order], bucket[order]
        begin = np.searchsorted(bucket, bucket)
        place = np.arange(len(bucket)) - begin
        kept, refused = place < CELLS, place >= CELLS
        if refused.any():
            np.add.at(self.against, bucket[refused], total[refused])
            # the strongest newcomer of a bucket challenges its weakest cell
            ends = np.flatnonzero(place == CELLS)
            cells = begin[ends][:, None] + np.arange(CELLS)
            weakest = begin[ends] + np.argmin(total[cells], axis=1)
            wins = self.against[bucket[ends]] >= EVICT_VOTES * total[weakest]
            wins |= total[ends] > total[weakest]
            kept[weakest[wins]], kept[ends[wins]] = False, True
            self.against[bucket[ends[wins]]] = 0
            lost = ~kept
            np.add.at(self.light, self.counter(h[lost]), total[lost])
        self.hash, self.value, self.votes = h[kept], v[kept], total[kept]

    def merge_light(self, light_at: np.ndarray, counts: np.ndarray) -> None:
        np.add.at(self.light, light_at, counts)


def _build(n_fields: int):
    per_range, per_bucket = BUCKETS // RANGES, COUNTERS // BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = [Sketch() for _ in range(n_fields)]
        held: list[pa.RecordBatch] = []
        rows = 0

        def step() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            for k, sketch in enumerate(sketches):
                mine = t.select([f"h{k}", f"v{k}"]).filter(pc.is_valid(t[f"h{k}"])).combine_chunks()
                if not mine.num_rows:
                    continue
                encoded = mine[f"h{k}"].chunk(0).dictionary_encode()
                code = encoded.indices.to_numpy()
                example = np.zeros(len(encoded.dictionary), np.int64)
                example[code] = np.arange(len(code))
                values = mine[f"v{k}"].take(pa.array(example)).to_numpy()
                sketch.add(encoded.dictionary.to_numpy(), values.astype(object), np.bincount(code).astype(np.int64))

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS_PER_STEP:
                step()
                held, rows = [], 0
        if rows:
            step()
        for k, s in enumerate(sketches):
            part = s.bucket(s.hash) // per_range
            for r in range(RANGES):
                mine = part == r
                light = s.light[r * per_range * per_bucket : (r + 1) * per_range * per_bucket]
                at = np.flatnonzero(light)
                if mine.any() or len(at):
                    yield pa.RecordBatch.from_pydict({
                        "field": pa.array([k], pa.int32()), "part": pa.array([r], pa.int32()),
                        "hashes": pa.array([s.hash[mine]]), "vals": pa.array([list(s.value[mine])], pa.list_(pa.string())), "votes": pa.array([s.votes[mine]]),
                        "light_at": pa.array([at.astype(np.int32)]), "light": pa.array([light[at]]),
                    })

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket recombination of the ranges in one partition, one sketch of a range at a time."""
    per_range = BUCKETS // RANGES
    ranges: dict[tuple[int, int], Sketch] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            key = batch["field"][row].as_py(), batch["part"][row].as_py()
            s = ranges.setdefault(key, Sketch(key[1] * per_range, per_range))
            column = lambda c: batch[c][row].values  # noqa: E731, B023
            s.add(column("hashes").to_numpy(), column("vals").to_numpy(zero_copy_only=False).astype(object), column("votes").to_numpy())
            s.merge_light(column("light_at").to_numpy(), column("light").to_numpy())
    for (field, _), s in ranges.items():
        used = np.flatnonzero(s.light)
        at = used + s.first * (COUNTERS // BUCKETS)
        n, m = len(s.hash), len(used)
        yield pa.RecordBatch.from_pydict({
            "field": pa.array(np.full(n + m, field, np.int32)),
            "counter": pa.array(np.concatenate([s.hash % COUNTERS, at]).astype(np.int32)),
            "item": pa.array([*s.value, *[None] * m], pa.string()),
            "hash": pa.array(np.concatenate([s.hash, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
            "votes": pa.array(np.concatenate([s.votes, s.light[used]])),
        })


def _hash(c: str):
    return F.xxhash64(F.col(c)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def sketch(df: DataFrame, columns: list[str]) -> DataFrame:
    """The merged sketch of string columns, of a size that does not depend on the data.

    Rows (field, counter, item, hash, votes): with an item, a cell and its exact-bucket votes;
    without, a counter and all that fell into it. A value's count lies between its votes and its
    votes plus its counter; a value without a cell has at most its counter. Null and empty values
    are left out, repeats count, other columns are not read.
    """
    require_columns(df, *columns)
    value = lambda c: F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`").cast("string"))
    values = df.select(*(value(c).alias(f"v{k}") for k, c in enumerate(columns)))
    values = values.select(*(F.when(F.col(f"v{k}").isNotNull(), _hash(f"v{k}")).alias(f"h{k}") for k in range(len(columns))), "*")
    values = values.coalesce(SKETCHES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    parts = values.mapInArrow(_build(len(columns)), "field int, part int, hashes array<bigint>, vals array<string>, votes array<bigint>, light_at array<int>, light array<bigint>")
    merged = parts.repartition("field", "part").mapInArrow(_merge, "field int, counter int, item string, hash bigint, votes bigint")
    return checkpoint(merged)


def top_values(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The n most frequent values of each column: (field_name, item_value, estimate, n_rows, place).

    `estimate` is the sketch's count, `n_rows` the exact one. Ties go by the value's code points,
    so that the result is the same in every run. Null and empty values are left out; a column with
    fewer than n values gives all of them; an empty table gives no row. Extra columns are not read.

    The sketch names the cells that can be among the first n: those whose upper bound reaches the
    n-th largest lower bound. Only a counter that reaches that bound could hide another such value;
    all values of these counters are counted, too, so the result is exact. Both lists have a fixed
    largest size (the sketch's), and the second pass counts nothing else.
    """
    cells = sketch(df, columns)
    counters = cells.where(F.col("item").isNull()).select("field", "counter", F.col("votes").alias("light"))
    bounds = cells.where(F.col("item").isNotNull()).join(F.broadcast(counters), ["field", "counter"], "left").withColumn("upper", F.col("votes") + F.coalesce("light", F.lit(0)))
    by_votes = W.partitionBy("field").orderBy(F.desc("votes"))
    least = bounds.withColumn("r", F.row_number().over(by_votes)).where(F.col("r") == n).select("field", F.col("votes").alias("least"))
    suspects = counters.join(F.broadcast(least), "field", "left").where(F.col("light") >= F.coalesce("least", F.lit(0))).select("field", "counter", F.lit(True).alias("suspect"))
    named = bounds.join(F.broadcast(least), "field", "left").where(F.col("upper") >= F.coalesce("least", F.lit(0)))
    named = named.select("field", "hash", F.col("upper").alias("estimate"))
    counts = []
    for k, c in enumerate(columns):
        value = F.col(f"`{c}`").cast("string")
        rows = df.select(value.alias("item_value")).where(F.col("item_value") != "").withColumn("hash", _hash("item_value")).withColumn("counter", (F.col("hash") % COUNTERS).cast("int"))
        mine = named.where(F.col("field") == k).select("hash", "estimate")
        hidden = suspects.where(F.col("field") == k).select("counter", "suspect")
        rows = rows.join(F.broadcast(mine), "hash", "left").join(F.broadcast(hidden), "counter", "left").where(F.col("estimate").isNotNull() | F.col("suspect"))
        counts.append(rows.groupBy("item_value").agg(F.max("estimate").alias("estimate"), F.count("*").alias("n_rows")).select(F.lit(c).alias("field_name"), "*"))
    both = counts[0]
    for more in counts[1:]:
        both = both.unionByName(more)
    place = W.partitionBy("field_name").orderBy(F.desc("n_rows"), "item_value")
    return both.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n).select("field_name", "item_value", "estimate", "n_rows", "place")
