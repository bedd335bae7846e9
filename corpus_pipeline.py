"""A training-corpus pipeline over ``documents``: filter, clean, deduplicate, redact, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. Between stages the rows are written
as Parquet into the cluster's shared folder and read again, so a lost executor
costs at most the stage at hand.

Defined results, for every stage: an empty table gives an empty one; further
columns are carried whatever their names; no column but ``text`` and ``n_chars``
changes, and these only where a stage changes the text; a null ``doc_id`` is
carried. What else a stage does with nulls, empty texts, ties and repeated rows
stands with it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import lines, minhash, packing, quality, secrets
from millrace.llm.common import shared_dir
from millrace.sources.checkpoints import remove

#: Lines found in so many documents keep their first occurrence only.
LINE_DOCUMENTS = 10


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the quality rules.

    A null or empty text has too few words and goes; repeated rows get one verdict.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.judge(docs, labels)
    # not a filter: it would be pushed below the measures, with all of them inside it once more
    return judged.select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeats of lines that many documents share; a text that loses all of them stays as an empty one.

    A null text is one empty line and stays null. The first of documents is that
    of least ``doc_id`` (null first), then of least text hash; repeated rows are
    one document and lose the same lines. Empty lines always stay.
    """
    maps = lines.drop_bitmaps(lines.keyed(docs), LINE_DOCUMENTS, keep_first=True)

    @F.arrow_udf("string")
    def keep(text: pa.Array, bits: pa.Array) -> pa.Array:
        pairs = zip(text.to_pylist(), bits.to_pylist(), strict=True)
        return pa.array([None if b is None else b"\n".join(lines.kept_lines(t.encode(), b)[0]).decode() for t, b in pairs], pa.string())

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"), packed_row(docs))
    out = lines.with_bitmaps(rows, maps)
    # texts without a bitmap, most of them, are not sent to Python
    kept = out.select("row", "text", keep(F.when(F.col("keep").isNotNull(), F.col("text")), "keep").alias("kept"))
    return unpacked_row(kept, docs.columns, F.col("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, that of least ``doc_id`` (null last), then of least text digest.

    Null and empty texts are one class. Of rows equal in ``doc_id`` and text that
    of least JSON form stays.
    """
    first = minhash.near_classes(docs).where("first").select(F.col("doc_id").alias("first_id"), F.col("key").alias("first_key")).distinct()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), minhash.text_key(F.col("text")).alias("key"), F.struct("*").alias("row"))
    kept = keyed.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")), "left_semi")
    return kept.groupBy("doc_id", "key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by its kind in brackets; a null text stays null, repeated rows change alike."""
    found = secrets.scan(docs.select("doc_id", "text", packed_row(docs)))
    return unpacked_row(found, docs.columns, F.when(F.size("spans") > 0, secrets.redacted(F.col("text"), F.col("spans"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents' tokens into sequences; a null or empty text is its end token, repeated rows are packed each."""
    return packing.pack(docs)


def packed_row(docs: DataFrame) -> Column:
    """``row``: all columns but the text under names that clash with none, and whether the text is null."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"], F.col("text").isNull().alias("none")).alias("row")


def unpacked_row(rows: DataFrame, columns: list[str], new_text: Column) -> DataFrame:
    """The columns again, with a new text and its length in code points where ``new_text`` is not null."""
    new = rows.select("row", F.when(~F.col("row.none"), F.col("text")).alias("text"), new_text.alias("new"))
    changed = F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("text"))
    put = {"text": F.when(changed, F.col("new")).otherwise(F.col("text"))}
    if "n_chars" in columns:
        i = columns.index("n_chars")
        put["n_chars"] = F.when(changed, F.length("new").cast("long")).otherwise(F.col(f"row.c{i}"))
    return new.select(*[put.get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(columns)])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("pack_sequences", pack_sequences),
]

#: Hashes, tokenizers and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_dir(spark)}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:  # the stage that was read is not needed again
                remove(spark, before)
            before = path
    return docs
