"""Sharding by a hypergeometric communication matrix (law ``rows``), in DataFrame operations only.

A uniform shuffle into shards of exact sizes, in the order: count the rows of each logical partition;
draw how many rows each partition sends to each shard (rows and columns of that matrix have fixed
sums, so every row of it is a multivariate hypergeometric draw from what is left of the shards);
permute each partition by a keyed hash and cut the permutation at the drawn counts; exchange; permute
each shard again by another keyed hash.

Every random choice is a hash of the row and a seed, never ``rand()``, so a task that runs again
after an executor was lost makes the same choice.
Shards are dense ranges of ``slot``; their sizes differ by one row at most.

Nulls: a null key hashes like any other value.  Rows that agree in every key column are
interchangeable and get different slots; so many of them that they would crowd a partition are numbered first.  An empty
table gives an empty table, and texts of any length go through.  Input columns named like the outputs (``law``, ``shard``, ``slot``,
``grown_shard``) are replaced, all others kept.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, literal_table, table, without

OUT = ("law", "shard", "slot", "grown_shard")


def draw_hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """Good items among ``n`` drawn without replacement, by inverting the law outward from its mode.

    Ratios of neighbouring probabilities need no factorials; steps grow as the standard deviation.
    """
    low, high = max(0, n - bad), min(n, good)
    if low >= high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    up = lambda k: (good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))  # noqa: E731  P(k+1)/P(k)
    total, w, k = 1.0, 1.0, mode
    while k < high and w > 1e-18:
        w *= up(k)
        k += 1
        total += w
    w, k = 1.0, mode
    while k > low and w > 1e-18:
        w /= up(k - 1)
        k -= 1
        total += w
    left = rng.random() * total - 1.0
    if left < 0:
        return mode
    a = b = mode
    wa = wb = 1.0
    while left >= 0 and (b < high or a > low):
        if b < high:
            wb *= up(b)
            b += 1
            left -= wb
            if left < 0:
                return b
        if a > low:
            wa /= up(a - 1)
            a -= 1
            left -= wa
            if left < 0:
                return a
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows sent by each partition to each shard: row sums ``counts``, column sums ``sizes``."""
    rng, left = random.Random(seed), list(sizes)
    out = []
    for n in counts:
        rest, row = sum(left), []
        for m in left:
            k = draw_hypergeometric(rng, m, rest - m, n)
            row.append(k)
            rest -= m
            n -= k
        left = [m - k for m, k in zip(left, row, strict=True)]
        out.append(row)
    return out


def shard_rows(df: DataFrame, keys: list[str], shards: int = 8, seed: int = 17, rows_per_partition: int = 1_000_000, least_partitions: int = 64) -> DataFrame:
    """``df`` with ``law`` ('rows'), ``shard`` (int), ``slot`` (long, gapless from 0 in a shard) and a null ``grown_shard``.

    keys: columns that identify a row.  The driver holds partitions x shards integers, and the
    number of partitions is rows / rows_per_partition (at least ``least_partitions``).
    """
    spark = df.sparkSession
    columns = without(df, *OUT).columns
    named = dict(zip(columns, (f"c{i}" for i in range(len(columns))), strict=True))  # no column of the caller's clashes with one of the operator's
    df = df.select(*[F.col(f"`{c}`").alias(named[c]) for c in columns])
    keys = [named[k] for k in keys]
    hashed = lambda s: F.xxhash64(F.lit(seed + s), *[F.col(k) for k in keys])
    total = df.count()
    parts = max(least_partitions, math.ceil(total / rows_per_partition))

    def dealt(rows: DataFrame) -> tuple[DataFrame, dict]:
        placed = rows.withColumn("_part", F.pmod(hashed(0), F.lit(parts)).cast("int")).withColumn("_key", hashed(1))
        return placed, dict(placed.groupBy("_part").count().collect())  # at most one row for each partition

    placed, counts = dealt(df)
    hot = [p for p, n in counts.items() if n > 4 * rows_per_partition]
    if hot:
        # Equal rows are interchangeable: where they crowd a partition, each gets a number of its own, kept in a written table, as a further key.
        heavy = placed.where(F.col("_part").isin(hot)).groupBy("_key").count().where(F.col("count") > rows_per_partition).select("_key", F.lit(True).alias("_many"))
        numbered = placed.join(F.broadcast(heavy), "_key", "left")  # fewer rows than partitions
        df = cut(numbered.withColumn("_copy", F.when(F.col("_many"), F.monotonically_increasing_id()).otherwise(0)).select(*df.columns, "_copy"), "copies")
        keys = [*keys, "_copy"]
        placed, counts = dealt(df)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    order = sorted(counts)
    matrix = communication_matrix([counts[p] for p in order], sizes, seed)
    cuts = literal_table(spark, [{"_part": p, "_cuts": [sum(row[: s + 1]) for s in range(shards)]} for p, row in zip(order, matrix, strict=True)], "_part: int, _cuts: array<bigint>")
    local = Window.partitionBy("_part").orderBy("_key", *keys)
    sent = (
        placed.withColumn("_rank", F.row_number().over(local))
        .join(F.broadcast(cuts), "_part")  # one row for each partition
        .withColumn("shard", F.size(F.filter("_cuts", lambda c: c < F.col("_rank"))).cast("int"))
        .drop("_part", "_key", "_rank", "_cuts")
        .withColumn("_key", hashed(2))
        .withColumn("_sub", F.shiftrightunsigned(F.col("_key"), 44) % F.lit(max(1, parts // shards)))
    )
    sent = cut(sent, "shards")
    before = sent.groupBy("shard", "_sub").count()
    running = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("shard", "_sub", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("_before"))
    again = Window.partitionBy("shard", "_sub").orderBy("_key", *keys)
    slot: Column = (F.col("_before") + F.row_number().over(again) - 1).cast("long")
    return (
        sent.join(F.broadcast(before), ["shard", "_sub"])  # at most one row for each partition
        .withColumn("slot", slot)
        .select(*[F.col(x).alias(c) for c, x in named.items()], F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    )


def op9_sharding(spark, sf_dir):
    """Every document in one of eight shards; the digest columns are made before the rows move."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(slim, ["doc_id", "text_crc32", "size"])


QUERIES = {"op9_sharding": op9_sharding}
ORACLES: dict[str, str] = {}
