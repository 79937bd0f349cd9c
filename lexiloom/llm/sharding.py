"""Operator 10: sharding by a two-pass external shuffle.

First pass: a seeded hash scatters the records evenly into buckets of a bounded size, and the buckets' counts are summed
up, in Spark, to the first place of each bucket. Second pass: each bucket, sorted into a fixed order, is Fisher-Yates
shuffled with a seed of its own, so that a task that runs again gives the same result. As a bucket's count is known
before its records come, they stream through: only the permutation is held, 8 bytes a record, no texts. The records'
places in the whole order deal them to the shards in turn: counts are at most one apart.
Null texts have no bytes; rows that repeat, or have no id, are records like others. Rows equal in id and text share a
bucket; which of them gets which of their places is open. Columns named shard and slot are replaced. An empty table has no
buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Buckets whose counts are summed up together.
GROUP = 4096


def _buckets(docs: DataFrame, n: int, seed: int, key: str, text: str) -> DataFrame:
    return docs.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), F.lit(n)).cast("int"))


def plan(docs: DataFrame, n: int, seed: int, key: str, text: str) -> DataFrame:
    """For each bucket that has records, __bucket, __n (their number) and __first (the place of its first one)."""
    counts = _buckets(docs.select(key, text), n, seed, key, text).groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("g", F.floor(F.col("__bucket") / GROUP))
    # one row for GROUP buckets meets in the last window: a row for 128 GB of text
    before = counts.groupBy("g").agg(F.sum("__n").alias("m")).select("g", (F.sum("m").over(Window.orderBy("g")) - F.col("m")).alias("before"))
    inside = F.sum("__n").over(Window.partitionBy("g").orderBy("__bucket")) - F.col("__n")
    return counts.withColumn("inside", inside).join(before, "g").select("__bucket", "__n", (F.col("inside") + F.col("before")).alias("__first"))


def places(seed: int, bucket: int, n: int) -> np.ndarray:
    """Fisher-Yates: the place, after the shuffle, of each of a bucket's n records."""
    order = np.arange(n)
    picks = np.random.default_rng([seed, bucket]).integers(0, np.arange(n, 0, -1))  # for i from n - 1 down to 0: one of i + 1
    for i, j in zip(range(n - 1, 0, -1), picks.tolist(), strict=False):
        order[i], order[j] = order[j], order[i]
    return np.argsort(order)


def shuffle(docs: DataFrame, n_shards: int = 8, seed: int = 17, bucket_bytes: int = 32 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    bucket_bytes: about so many bytes of text are in a bucket, one of which a task shuffles at a time.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be greater than 0")
    docs = docs.drop("shard", "slot")
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long")), F.count(F.lit(1))).first()
    n = max(1, -(-((total[0] or 0) + total[1]) // bucket_bytes))

    def deal(batches):
        at, where = 0, np.zeros(0, np.int64)  # of the current bucket: records met so far; the places of all of them
        for batch in batches:
            ids, sizes, firsts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__bucket", "__n", "__first"))
            own = batch.select(names)
            heads = np.flatnonzero(~np.isnan(sizes.astype(float))).tolist()
            for i, j in zip([-1, *heads], [*heads, len(ids)], strict=True):
                if i >= 0:  # a row of the plan begins a bucket
                    at, where = 0, int(firsts[i]) + places(seed, int(ids[i]), int(sizes[i]))
                part = own.slice(i + 1, j - i - 1)
                place = where[at : at + part.num_rows]
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array((place % n_shards).astype(np.int32)), pa.array(place // n_shards)], names=[*names, "shard", "slot"])

    names = docs.columns
    schema = T.StructType([*docs.schema, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    tasks = min(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    # the plan comes with the records, as the first row of each bucket: one shuffle, and no join that could split a bucket
    dealt = _buckets(docs, n, seed, key, text).unionByName(plan(docs, n, seed, key, text), allowMissingColumns=True)
    return dealt.repartition(tasks, "__bucket").sortWithinPartitions("__bucket", F.col("__n").isNull(), key, text).mapInArrow(deal, schema)


def write(docs: DataFrame, path: str, n_shards: int = 8, seed: int = 17, bucket_bytes: int = 32 << 20) -> None:
    """Write docs in shards: folders shard=0 .. of Parquet, each record with its slot."""
    shuffle(docs, n_shards, seed, bucket_bytes).write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, n_shards: int = 8, seed: int = 17, bucket_bytes: int = 32 << 20) -> DataFrame:
    """One row for each row of docs, as the contract has it; the law is `rows`."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return shuffle(docs.select("doc_id", "text"), n_shards, seed, bucket_bytes).select(
        "doc_id", (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
