"""Tables that take changes without being rewritten: a base, keyed delta files, and compaction.

A batch writes the rows that it really changes, and one commit row; a reader puts the
newest delta row of each key over the base. Compaction writes what a reader sees as
the next base; older bases and deltas stay for reads of earlier batches until
``vacuum``. A folder counts only once its marker row is there, and a batch that is run
again replaces its own folders, so a lost executor or driver leaves nothing half done.

The base lies in folders by hash of the key, so that the rows a batch may change are
looked for in these folders only. A key may stand in the base several times (a load
that copied rows twice): a delta row stands for all of them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.operators import ordered
from millrace.sources.checkpoints import cut, remove

BUCKETS = 64
MARKER = "position long, written long, deleted long"


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def rows_at(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def mark(spark: SparkSession, path: str, position: int, written: int = 0, deleted: int = 0) -> None:
    spark.createDataFrame([(position, written, deleted)], MARKER).coalesce(1).write.mode("overwrite").parquet(path)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``batch``, ``position``, ``written``, ``deleted`` of each batch; batch -1 is the first load."""
    return spark.read.option("basePath", f"{path}/commits").parquet(f"{path}/commits").select("batch", "position", "written", "deleted")


def create(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], position: int = 0) -> None:
    """Writes the first load, batch -1."""
    write_base(rows, path, keys, -1)
    mark(spark, f"{path}/bases/version=-1", position)
    mark(spark, f"{path}/commits/batch=-1", position)


def write_base(rows: DataFrame, path: str, keys: list[str], version: int) -> None:
    bucketed = rows.withColumn("bucket", bucket_of(keys))
    # a bucket may be large: its rows stay in several tasks, each of which writes a file for it
    bucketed.sortWithinPartitions("bucket", *keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/version={version}")


class View:
    """What a reader of batch ``as_of`` (default: the last) sees: one base and the deltas after it."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], as_of: int | None = None) -> None:
        # a row a batch and a row a base
        done = {r.batch for r in commits(spark, path).select("batch").collect()}
        self.batch = max(b for b in done if as_of is None or b <= as_of)
        bases = {r.version for r in spark.read.option("basePath", f"{path}/bases").parquet(f"{path}/bases").select("version").collect()}
        if not (older := [v for v in bases if v <= self.batch]):
            raise ValueError(f"batch {self.batch} of {path} is gone")
        self.version, self.keys, self.path, self.spark = max(older), keys, path, spark
        self.batches = sorted(b for b in done if self.version < b <= self.batch)

    def base(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/base/version={self.version}")

    def deltas(self) -> DataFrame | None:
        if not self.batches:
            return None
        return self.spark.read.option("basePath", f"{self.path}/delta").parquet(*[f"{self.path}/delta/batch={b}" for b in self.batches])

    def newest(self) -> DataFrame | None:
        """The newest delta row of each key."""
        deltas = self.deltas()
        if deltas is None:
            return None
        values = [c for c in deltas.columns if c not in self.keys and c != "batch"]
        return deltas.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*self.keys, "v.*")

    def over(self, base: DataFrame, newest: DataFrame | None) -> DataFrame:
        columns = [c for c in base.columns if c != "bucket"]
        if newest is None:
            return base.select(*columns)
        on = [F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
        left = base.alias("b").join(newest.select(*self.keys).alias("n"), on, "left_anti")
        return left.select(*columns).unionByName(newest.where("op = 'put'").select(*columns))

    def rows(self) -> DataFrame:
        return self.over(self.base(), self.newest())

    def rows_of(self, changed: DataFrame) -> DataFrame:
        """The rows with one of the keys in ``changed``; only the folders that can hold them are read."""
        buckets = [r.bucket for r in changed.select(bucket_of(self.keys).alias("bucket")).distinct().collect()]  # BUCKETS at most
        base = self.base().where(F.col("bucket").isin(buckets) if buckets else F.lit(False)).join(changed, self.keys, "left_semi")
        newest = self.newest()
        return self.over(base, None if newest is None else newest.join(changed, self.keys, "left_semi"))


def read(spark: SparkSession, path: str, keys: list[str], as_of: int | None = None) -> DataFrame:
    """The table after batch ``as_of``, or after the last."""
    return View(spark, path, keys, as_of).rows()


def batch_at(spark: SparkSession, path: str, position: int) -> int:
    """The last batch whose position is not behind ``position``."""
    return commits(spark, path).where(F.col("position") <= position).agg(F.max("batch")).first()[0]


def apply(spark: SparkSession, path: str, batch: int, changed: DataFrame, rows: DataFrame, keys: list[str], position: int, settable: list[str] | None = None, settle: bool = False) -> tuple[int, int]:
    """Applies current rows of changed keys and returns how many rows were written and deleted.

    ``changed``: the keys; ``rows``: those of them that exist now. A row that is there
    takes the ``settable`` columns (default: all); if none of them differs nothing is
    written. ``settle``: keys are not unique yet, so every current row is put once for
    all its copies. A key with a null part names no row.
    """
    changed = cut(changed.select(*keys).dropna().distinct())
    view = View(spark, path, keys, batch - 1)
    old = view.rows_of(changed)
    columns = old.columns
    values = [c for c in columns if c not in keys]
    take = values if settable is None else [c for c in settable if c in values]
    before = old.groupBy(*keys).agg(F.count("*").alias("copies"), F.first(F.struct(*values), ignorenulls=True).alias("old")) if settle else old.select(*keys, F.lit(1).cast("long").alias("copies"), F.struct(*values).alias("old"))
    now = rows.join(changed, keys, "left_semi").select(*keys, F.struct(*values).alias("new"))
    both = before.join(now, keys, "full")
    picked = [F.when(F.col("old").isNull(), F.col(f"new.{c}")).otherwise(F.col(f"new.{c}") if c in take or settle else F.col(f"old.{c}")).alias(c) for c in values]
    merged = both.withColumn("merged", F.when(F.col("new").isNotNull(), F.struct(*picked)))
    kept = F.lit(True) if settle else ~F.col("merged").eqNullSafe(F.col("old"))
    found = merged.where(kept).select(*keys, *[F.coalesce(F.col(f"merged.{c}"), F.col(f"old.{c}")).alias(c) for c in values], F.when(F.col("new").isNull(), "gone").otherwise("put").alias("op"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))
    folder = f"{path}/delta/batch={batch}"
    found.write.mode("overwrite").parquet(folder)
    counts = spark.read.schema(found.schema).parquet(folder).agg(F.count_if(F.col("op") == "put").alias("written"), F.coalesce(F.sum(F.when(F.col("op") == "gone", F.col("copies"))), F.lit(0)).alias("deleted")).first()
    mark(spark, f"{path}/commits/batch={batch}", position, counts.written, counts.deleted)
    return counts.written, counts.deleted


def skip(spark: SparkSession, path: str, batch: int, position: int, keys: list[str]) -> None:
    """A batch that changes nothing here; what an earlier attempt at it wrote goes."""
    view = View(spark, path, keys, batch - 1)
    columns = [c for c in view.base().schema.fields if c.name != "bucket"]
    none = spark.createDataFrame([], StructType([*columns, StructField("op", StringType()), StructField("copies", LongType())]))
    none.coalesce(1).write.mode("overwrite").parquet(f"{path}/delta/batch={batch}")
    mark(spark, f"{path}/commits/batch={batch}", position)


def compact(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Writes what a reader sees now as the next base and returns its version."""
    view = View(spark, path, keys)
    if view.version < view.batch:
        write_base(view.rows(), path, keys, view.batch)
        mark(spark, f"{path}/bases/version={view.batch}", 0)
    return view.batch


def vacuum(spark: SparkSession, path: str, keys: list[str], as_of: int) -> None:
    """Removes what only reads of batches before ``as_of`` need."""
    version = View(spark, path, keys, as_of).version
    for r in spark.read.option("basePath", f"{path}/bases").parquet(f"{path}/bases").where(F.col("version") < version).select("version").collect():
        remove(spark, f"{path}/bases/version={r.version}")
        remove(spark, f"{path}/base/version={r.version}")
    for r in commits(spark, path).where((F.col("batch") <= version) & (F.col("batch") >= 0)).select("batch").collect():
        remove(spark, f"{path}/delta/batch={r.batch}")


def history(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Every version of every row still held, with the positions it is valid from (inclusive) and to (exclusive; null: still valid)."""
    view = View(spark, path, keys)
    bases = [r.version for r in spark.read.option("basePath", f"{path}/bases").parquet(f"{path}/bases").select("version").collect()]
    first = min(bases)
    base = spark.read.parquet(f"{path}/base/version={first}").drop("bucket")
    at = commits(spark, path).select("batch", "position")
    images = base.withColumns({"op": F.lit("put"), "batch": F.lit(first)})
    batches = sorted(b for b in (r.batch for r in at.select("batch").collect()) if first < b <= view.batch)
    if batches:
        deltas = spark.read.option("basePath", f"{path}/delta").parquet(*[f"{path}/delta/batch={b}" for b in batches])
        images = images.unionByName(deltas.drop("copies"))
    # a row a batch
    return validity(images.join(F.broadcast(at), "batch").drop("batch"), keys, "position")


def validity(images: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Row images with ``op`` (put or gone) as versions with ``valid_from`` and ``valid_to``.

    An image ends the version before it; one that is gone begins none. Of several
    images of a key at one position any may count as the last, so positions have to
    tell them apart (copies of a row put together are versions side by side).
    """
    later = images.groupBy(*keys, position).agg(F.lit(1).alias("one")).withColumn("back", -F.col(position)).drop("one")
    ends = ordered.previous(later, keys, ["back"], [position]).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(position).alias("from_"), F.col(f"before.{position}").alias("valid_to"))
    on = [F.col(k).eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(keys)]
    both = images.where("op = 'put'").join(ends, [*on, F.col(position) == F.col("from_")])
    return both.select(*[c for c in images.columns if c not in ("op", position)], F.col(position).alias("valid_from"), "valid_to")


def rows_as_of(versions: DataFrame, at: Column) -> DataFrame:
    """The rows valid at a position, which may be a column of ``versions``."""
    return versions.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).drop("valid_from", "valid_to")


def reread_as_of(versions: DataFrame, changed: DataFrame, keys: list[str], at: Column, row_filter: Column | None = None) -> DataFrame:
    """Rows of the changed keys as of a position, under the table's row filter: a row that the filter leaves out is as good as gone."""
    found = rows_as_of(versions.join(changed.select(*keys).distinct(), keys, "left_semi"), at)
    return found if row_filter is None else found.where(row_filter)
