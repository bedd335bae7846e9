"""Quality rules, with DataFrame functions only.

A document fails the base rules if it is very short or mostly repeats itself.
Every other document is judged by the log-likelihood ratio of its hashed word
uni- and bigrams between two multinomials: the trusted target (documents
labelled good) and the raw corpus (all documents). The ratio is divided by the
number of n-grams, so long and short documents are on one scale, and compared
with a fixed threshold: the same document always gets the same verdict.

All counts stay inside their row as arrays; the only shuffle is of n-gram
bucket counts, pre-aggregated on each side of it to at most ``buckets`` rows.

Defined results: a null text has no words and fails the base rules; repeated
rows are judged each; a null ``doc_id`` is carried; an empty table gives no
rows; without any trusted document the ratio is 0 and only the base rules
decide; columns other than ``doc_id`` and ``text`` are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN

BUCKETS = 1 << 16
#: Trusted documents that the target multinomial is fitted on, at most: those of least hash.
TARGET_DOCUMENTS = 20_000
#: Counts that each bucket of either side has besides its own.
SMOOTHING = 10.0
#: Mean log-likelihood ratio of an n-gram below which a document is dropped.
THRESHOLD = -0.1
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` over ``value``, computed once for the row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_words(docs: DataFrame) -> DataFrame:
    """Adds ``words`` and the hash arrays of word uni-, bi- and trigrams."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("words", F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)))
    docs = docs.withColumn("uni", F.transform("words", lambda w: F.xxhash64(w)))

    def longer(grams: str, size: int) -> Column:
        n = F.greatest(F.size("words") - (size - 1), F.lit(0))
        return F.zip_with(F.slice(grams, 1, n), F.slice("uni", size, n), lambda a, b: F.xxhash64(a, b))

    return docs.withColumn("bi", longer("uni", 2)).withColumn("tri", longer("bi", 3))


def repeated_words(windows: str) -> Column:
    """Words in windows of three that the text holds twice or more.

    Windows are sorted by (hash, place); one whose neighbour has its hash is
    repeated. Their places, sorted, cover three words each less the overlap.
    """
    at = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        n = F.size(s)
        alike = F.transform(s, lambda x, j: F.when(
            ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < n - 1) & (F.get(s, j + 1)["h"] == x["h"])), x["i"]
        ))
        return F.sort_array(F.array_compact(alike))

    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("words"))
    covered = F.aggregate(
        let(F.sort_array(at), places),
        start,
        lambda acc, p: F.struct(p.alias("last"), (acc["words"] + F.least(p - acc["last"], F.lit(3))).alias("words")),
        lambda acc: acc["words"],
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered)


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``base_failed`` to ``with_words``."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD_PATTERN))
    docs = docs.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words("tri").cast("long"),
    })
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    return docs.withColumn("base_failed", failed)


def gram_buckets(buckets: int) -> Column:
    return F.transform(F.concat("uni", "bi"), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def trusted_ids(labels: DataFrame, most: int = TARGET_DOCUMENTS) -> DataFrame:
    """At most ``most`` distinct ids of documents labelled good, those whose hash is least."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    return good.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(most)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = TARGET_DOCUMENTS) -> DataFrame:
    """One row: ``ratios``, for each bucket the log ratio of its target and raw probability.

    Raw counts are scaled to the target's total and both sides get ``SMOOTHING``
    counts in every bucket: one that neither side holds often says nothing.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(trusted_ids(labels, most)), F.col("doc_id") == F.col("trusted_id"), "left"
    )
    grams = with_words(marked).select(F.col("trusted_id").isNotNull().alias("trusted"), F.explode(gram_buckets(buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("target"))
    # one row a bucket from here on
    zero = F.lit(0)
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    every = every.select("bucket", F.coalesce("raw", zero).alias("raw"), F.coalesce("target", zero).alias("target"))
    rows = every.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"), F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("list"))
    scale = F.col("all_target") / F.greatest(F.col("all_raw"), F.lit(1))
    known = F.transform("list", lambda x: F.log((x["target"] + F.lit(SMOOTHING)) / (x["raw"] * scale + F.lit(SMOOTHING))))
    return rows.select(F.when(F.coalesce("all_target", F.lit(0)) > 0, known).otherwise(F.array_repeat(F.lit(0.0), buckets)).alias("ratios"))


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = TARGET_DOCUMENTS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``text``, ``row`` (the whole row of ``docs`` as a struct), the base measures, ``llr``, ``base_failed`` and ``kept``."""
    ratios = log_ratios(docs, labels, buckets, most)
    found = base_rules(with_words(docs.select("doc_id", "text", F.struct("*").alias("row"))))
    # one row of a fixed number of buckets
    found = found.withColumn("ratios", ratios.scalar())
    total = F.aggregate(gram_buckets(buckets), F.lit(0.0), lambda acc, b: acc + F.get("ratios", b))
    n = F.size("uni") + F.size("bi")
    llr = F.when(n == 0, F.lit(0.0)).otherwise(total / n)
    found = found.withColumn("llr", llr)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop("words", "uni", "bi", "tri", "ratios")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]
    return judge(docs.select("doc_id", "text"), labels).select(F.col("doc_id").cast("long").alias("doc_id"), *columns)
