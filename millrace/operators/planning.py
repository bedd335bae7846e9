"""Chunk plans for parallel copies.

Equi-depth key ranges come from approximate quantiles and a range count, which
stay distributed; the exact NTILE is offered for small keys and comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import ordered
from millrace.sources.checkpoints import cut


def batch_count(rows: Column, has_lobs: Column, per_batch: int = 200_000, per_lob_batch: int = 25_000, most: int = 2_000, unknown: int = 16) -> Column:
    size = F.when(has_lobs, per_lob_batch).otherwise(per_batch)
    return F.when(rows.isNull(), unknown).otherwise(F.least(F.greatest(F.ceil(rows / size), F.lit(1)), F.lit(most))).cast("int")


def ntile_bounds(df: DataFrame, key: str, n: int) -> DataFrame:
    """Greatest key of each of ``n`` buckets of equal rows.

    A global NTILE needs one ordered list. Only positions are needed, so keys
    are numbered by a distributed range sort: each partition numbers its own
    rows and adds the counts of the partitions before it.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.select(F.col(key).alias("k")).repartitionByRange(parts, "k").sortWithinPartitions("k").withColumn("part", F.spark_partition_id())
    local = ranged.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("k")))
    sizes = local.groupBy("part").agg(F.count("*").alias("rows"))  # a row for each partition
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    total = F.sum("rows").over(Window.partitionBy())
    base = before.join(F.broadcast(sizes), "part").select("part", "before", total.alias("total"))
    rank = F.col("before") + F.col("place") - 1
    # NTILE gives the first total % n buckets one row more
    small, extra = F.floor(F.col("total") / n), F.col("total") % n
    wide = extra * (small + 1)
    bucket = F.when(rank < wide, F.floor(rank / (small + 1))).otherwise(extra + F.floor((rank - wide) / F.greatest(small, F.lit(1)))) + 1
    return local.join(F.broadcast(base), "part").groupBy(bucket.cast("int").alias("bucket")).agg(F.max("k").alias("bound"))


def key_ranges(bounds: DataFrame) -> DataFrame:
    """Half-open ranges (low, high] of consecutive bounds; the first is open below and the last above."""
    w = Window.orderBy("bucket")  # a row for each chunk
    last = F.max("bucket").over(Window.partitionBy())
    return bounds.select(
        (F.col("bucket") - 1).alias("chunk"), F.lag("bound").over(w).alias("low"), F.when(F.col("bucket") == last, F.lit(None)).otherwise(F.col("bound")).alias("high")
    )


def in_range(key: Column, low: Column, high: Column) -> Column:
    return (low.isNull() | (key > low)) & (high.isNull() | (key <= high))


def hash_bucket(key: Column, n: int, portable: bool = False) -> Column:
    """Bucket of a key: xxhash64 in production; ``portable`` gives what other engines compute from md5 as well."""
    if portable:
        return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % n).cast("int")
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def coalesce_extents(extents: DataFrame, keys: list[str], n: int, shared: list[str] | None = None) -> DataFrame:
    """Joins neighbouring extents until a chunk has the target size, then starts the next: ``keys``, ``chunk``, ``first``, ``last``, ``blocks``.

    ``extents``: keys, ``position``, ``blocks``. The target is a share of 1 in ``n`` of
    the blocks of an object, or of all objects with the same ``shared`` keys (the
    partitions of one table): then a large partition gets more chunks than a small one.
    """
    over = keys if shared is None else shared
    # one row an object
    totals = extents.groupBy(*over).agg(F.greatest(F.ceil(F.sum("blocks") / n), F.lit(1)).cast("long").alias("target"))
    joined = extents.join(totals, F.lit(True)) if not over else extents.alias("e").join(totals.alias("t"), [F.col(f"e.{k}").eqNullSafe(F.col(f"t.{k}")) for k in over]).select("e.*", "t.target")
    return ordered.full_groups(joined, keys, "position", "blocks", "target").withColumn("chunk", F.col("chunk").cast("int"))


def partition_chunks(partitions: DataFrame, extents: DataFrame, table: str, part: str, n: int) -> DataFrame:
    """Chunks of partitioned tables: each partition's extents under the table's shared target, a partition without extents as one chunk.

    ``partitions``: ``table``, ``part``; ``extents``: both, ``position``, ``blocks``. ``first``, ``last`` and ``blocks`` are null where a partition is read whole.
    """
    cut_up = coalesce_extents(extents.join(partitions.select(table, part).distinct(), [table, part], "left_semi"), [table, part], n, [table])
    whole = partitions.select(table, part).distinct().join(extents.select(table, part).distinct(), [table, part], "left_anti")
    none = F.lit(None).cast("long")
    return cut_up.unionByName(whole.select(table, part, F.lit(0).alias("chunk"), none.alias("first"), none.alias("last"), none.alias("blocks")))


def parents_first(children: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """``node``, ``level``: ordering by level puts parents first.

    A node's level is its longest distance from a node without parents. Nodes
    of a cycle, and all below them, share the level behind the last, where their
    given order holds. A reference to the node itself counts for nothing; a null
    parent makes its child a node without that parent. Each round takes the nodes
    whose parents are all placed, as one pre-aggregated join, so rows never grow
    with the number of paths and no graph is gathered on the driver.
    """
    edges = children.select(F.col(child).alias("child"), F.col(parent).alias("parent"))
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("node")).where("node is not null").distinct()
    edges = cut(edges.where("child <> parent").distinct())
    left, level, placed = cut(nodes), 0, []
    while not left.isEmpty():
        waiting = edges.join(left.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        state = cut(left.join(waiting.withColumn("waits", F.lit(True)), "node", "left"))
        ready = state.where("waits is null").select("node", F.lit(level).alias("level"))
        left = state.where("waits").select("node")
        if ready.isEmpty():  # a cycle and what hangs on it
            placed.append(left.select("node", F.lit(level).alias("level")))
            break
        placed.append(ready)
        level += 1
    out = placed[0] if placed else left.select("node", F.lit(0).alias("level"))
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def partition_plan(df: DataFrame, part: str, n: int) -> DataFrame:
    """``part``, ``rows``, ``position``, ``chunks``: as many chunks as a partition fills with 1 in ``n`` of all rows (rounded up) each, the rest counting as one."""
    sizes = df.groupBy(part).agg(F.count("*").alias("rows"))
    target = sizes.agg(F.greatest(F.ceil(F.sum("rows") / n), F.lit(1))).scalar()
    w = Window.orderBy(part)  # a row for each partition
    return sizes.select(part, "rows", (F.row_number().over(w) - 1).alias("position"), F.ceil(F.col("rows") / target).cast("int").alias("chunks"))


def chunk_strategy(index_only: Column, partitioned: Column, has_partitions: Column, has_extents: Column, numeric_key: Column) -> Column:
    """How a table is cut: by its key where only an index holds it, by partition where partitions are visible, else by range of the files.

    Only a plain table falls back to its key and then to a hash; the others are one chunk if nothing fits.
    """
    by_key = F.when(numeric_key, "key range")
    by_range = F.when(has_extents, "range")
    return (
        F.when(index_only, F.coalesce(by_key, F.lit("single"))).when(partitioned, F.when(has_partitions, "partition").otherwise(F.coalesce(by_range, F.lit("single"))))
        .otherwise(F.coalesce(by_range, by_key, F.lit("hash")))
    )
