"""Two-pass external shuffle into shards.

Pass one scatters rows by seeded hashes into buckets that fit in memory, as many per shard as its own
size asks for. Pass two does a Fisher-Yates shuffle of each bucket (the built-in ``shuffle`` of an
array) and numbers its rows behind those of the shard's earlier buckets. How many tasks there are
follows from the data alone, so slots do not depend on the session's settings.

Law ``key``: id and number of shards decide. Each shard's seeded hash of the id competes and the
highest wins, so that one more shard takes rows only into itself. Rows without an id take the
place that a null has. A null text has no bytes; a text of any length is one row of a bucket. An empty
table gives an empty result.

Within a shard, rows are spread over the buckets by id and text. Rows that agree in both are counted
first; where they are very many, equal rows are counted into one before they are
moved, and each copy goes to a bucket of its own drawing, so that no bucket fills with copies.

The struct that is added is the last column, under the next free name with underscores in front if a
column has its name in any case.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homeward.llm.common import fresh, repeats_merged

BUCKET_BYTES = 32 << 20
TASK_BYTES = 64 << 20
# The first slots of buckets are sent to all tasks up to this many; more are joined by a shuffle.
SHIPPED_BUCKETS = 1_000_000


def shard_of(key: Column, n_shards: int, seed: int) -> Column:
    bids = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("bid"), s.alias("shard")),
    )
    return F.array_max(bids)["shard"]


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shuffled(
    docs: DataFrame,
    n_shards: int,
    seed: int = 5,
    bucket_bytes: int = BUCKET_BYTES,
    out: str = "place",
) -> DataFrame:
    """Add struct ``out`` (shard, slot, grown_shard, law); slots of a shard run from 0, gapless."""
    out, shard, bucket, order, rows, copy, task = fresh(
        docs, out, "shard", "bucket", "order", "rows", "copy", "task"
    )
    crc = F.coalesce(F.crc32("text"), F.lit(0))
    own = shard_of(F.col("doc_id"), n_shards, seed)
    found = docs.select(own.alias(shard), n_bytes(F.col("text")).alias(rows))
    sizes = {r[0]: r[1] for r in found.groupBy(shard).agg(F.sum(rows)).collect()}  # one per shard
    total = sum(sizes.values())
    n_buckets = [max(1, math.ceil(sizes.get(s, 0) / bucket_bytes)) for s in range(n_shards)]
    first = [0, *itertools.accumulate(n_buckets)][:-1]
    parts = max(1, min(sum(n_buckets), max(n_shards, math.ceil(total / TASK_BYTES))))

    def of_shard(numbers: list[int]) -> Column:
        return F.get(F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>"), F.col(shard))

    many = of_shard(n_buckets)
    # Merged rows become many again, each copy with a number of its own.
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(copy) - 1))
    scattered = repeats_merged(docs, copy).withColumn(copy, each).withColumn(shard, own).withColumns({
        bucket: F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", crc, copy), many).cast("int"),
        order: F.xxhash64(F.lit(seed + 2), "doc_id", crc, copy),
    })
    counts = scattered.groupBy(shard, bucket).agg(F.count("*").alias(rows))
    offset = F.coalesce(
        F.sum(rows).over(
            Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    offsets = counts.select(shard, bucket, offset.alias(order))
    if sum(n_buckets) <= SHIPPED_BUCKETS:
        offsets = F.broadcast(offsets)
    # Whether rows agree in order and id is told by the rest of the row, as far as it can be sorted.
    told = F.xxhash64(*[c for c, t in docs.dtypes if "map" not in t and "variant" not in t])
    buckets = (
        # Buckets are dealt to the tasks in turn; a hash of so few keys would leave some with several.
        scattered.withColumn(task, F.pmod(of_shard(first) + F.col(bucket), F.lit(parts)).cast("int"))
        .repartitionById(parts, F.col(task))
        .sortWithinPartitions(task, shard, bucket, order, "doc_id", told)
        .groupBy(task, shard, bucket)
        .agg(F.collect_list(F.struct(*docs.columns)).alias(rows))
        # Before the join: the seed goes with the partition, which must not depend on its plan.
        .withColumn(rows, F.shuffle(rows, seed))
        .join(offsets, [shard, bucket])
    )
    dealt = buckets.select(shard, order, F.posexplode(rows).alias(bucket, rows))
    return dealt.select(
        *[F.col(rows)[c].alias(c) for c in docs.columns],
        F.struct(
            F.col(shard).alias("shard"),
            (F.col(order) + F.col(bucket)).alias("slot"),
            shard_of(F.col(rows)["doc_id"], n_shards + 1, seed).alias("grown_shard"),
            F.lit("key").alias("law"),
        ).alias(out),
    )


def write_shards(placed: DataFrame, path: str, out: str | None = None) -> None:
    """Write one folder per shard, rows with their slot; ``out`` is the last column if not given."""
    out = out or placed.columns[-1]
    shard, slot = f"{out}.shard", f"{out}.slot"
    placed.select(
        *[c for c in placed.columns if c not in (out, "shard", "slot")],
        F.col(shard).alias("shard"), F.col(slot).alias("slot"),
    ).write.partitionBy("shard").parquet(path)
