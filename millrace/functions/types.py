"""Source type text to destination type text, and the parts and compatibility of destination types.

Everything is a Column expression over catalog DataFrames, so a catalog of any
size is mapped in one narrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Destination type aliases and the canonical name of each.
ALIASES = {
    "varchar": "character varying", "char": "character", "bpchar": "character", "int2": "smallint", "int4": "integer", "int": "integer",
    "int8": "bigint", "float4": "real", "float8": "double precision", "decimal": "numeric", "bool": "boolean",
    "timestamptz": "timestamp with time zone", "timestamp": "timestamp without time zone", "timetz": "time with time zone", "time": "time without time zone",
}
# Families of destination types.
FAMILIES = {
    "character varying": "string", "character": "string", "text": "string", "smallint": "integer", "integer": "integer", "bigint": "integer",
    "real": "float", "double precision": "float", "numeric": "numeric", "boolean": "boolean", "date": "date", "bytea": "binary", "xml": "xml",
    "timestamp without time zone": "timestamp", "timestamp with time zone": "timestamp", "interval": "interval", "uuid": "uuid",
    "time without time zone": "time", "time with time zone": "time", "json": "json", "jsonb": "json",
}
LOB_TYPES = ("BLOB", "CLOB", "NCLOB", "LONG", "LONG RAW", "BFILE")
LONGEST_VARCHAR = 10_485_760


def sized(name: str, length: Column) -> Column:
    bounded = length.isNotNull() & (length > 0) & (length <= LONGEST_VARCHAR)
    return F.when(bounded, F.concat(F.lit(f"{name}("), length.cast("string"), F.lit(")"))).otherwise(F.lit("text"))


def number_type(precision: Column, scale: Column) -> Column:
    whole = (
        F.when(precision.isNull(), "numeric").when(precision <= 4, "smallint").when(precision <= 9, "integer").when(precision <= 18, "bigint")
        .otherwise(F.concat(F.lit("numeric("), precision.cast("string"), F.lit(")")))
    )
    part = F.concat(F.lit("numeric("), precision.cast("string"), F.lit(", "), scale.cast("string"), F.lit(")"))
    return F.when(scale == 0, whole).when(precision.isNotNull() & scale.isNotNull(), part).otherwise(F.lit("numeric"))


def map_type(source: Column, length: Column, precision: Column, scale: Column, strict: bool = True) -> Column:
    """Destination type of a source column; ``strict`` keeps zones and intervals that carry a precision in parentheses."""
    upper = F.upper(F.trim(source))
    plain = F.regexp_replace(upper, r"\(\d+\)", "") if strict else F.trim(F.regexp_extract(upper, r"^([^(]*)", 1))
    return (
        F.when(plain.isin("VARCHAR2", "NVARCHAR2"), sized("varchar", length))
        .when(plain.isin("CHAR", "NCHAR"), sized("char", length))
        .when(plain.isin("CLOB", "NCLOB", "LONG"), "text")
        .when(plain == "NUMBER", number_type(precision, scale))
        .when(plain == "DATE", "timestamp(0) without time zone")
        .when(plain == "TIMESTAMP", "timestamp without time zone")
        .when(plain.isin("TIMESTAMP WITH TIME ZONE", "TIMESTAMP WITH LOCAL TIME ZONE"), "timestamp with time zone")
        .when(plain.isin("BLOB", "BFILE", "RAW", "LONG RAW"), "bytea")
        .when(plain == "BINARY_FLOAT", "real")
        .when(plain.isin("FLOAT", "BINARY_DOUBLE"), "double precision")
        .when(plain.isin("ROWID", "UROWID"), "varchar(4000)")
        .when(plain == "XMLTYPE", "xml")
        .when(plain.isin("INTERVAL YEAR TO MONTH", "INTERVAL DAY TO SECOND"), "interval")
        .otherwise("text")
    )


def with_mapped_type(columns: DataFrame, out: str = "want_type") -> DataFrame:
    """Adds the destination type of ``source_type``, ``length``, ``precision``, ``scale``."""
    return columns.withColumn(out, map_type(F.col("source_type"), F.col("length"), F.col("precision"), F.col("scale")))


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value of a key in a small fixed table, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def plain_type(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\([^)]*\)", ""), r"\s+", " "))


def type_base(plain: Column) -> Column:
    """Canonical name of a destination type from its ``plain_type``."""
    return F.coalesce(lookup(ALIASES, plain), plain)


def type_family(base: Column) -> Column:
    return F.coalesce(lookup(FAMILIES, base), F.lit("unknown"))


def type_argument(text: Column, which: int) -> Column:
    """First or second number in the parentheses, null if there is none."""
    pattern = r"\(\s*(\d+)" if which == 1 else r"\(\s*\d+\s*,\s*(\d+)"
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found == "", F.lit(None)).otherwise(found).cast("int")


def with_type_parts(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Adds ``prefix_base``, ``prefix_family``, ``prefix_1`` and ``prefix_2``, step by step so that no expression is repeated."""
    text = F.col(column)
    df = df.withColumn(f"{prefix}_base", plain_type(text))
    df = df.withColumn(f"{prefix}_base", type_base(F.col(f"{prefix}_base")))
    df = df.withColumn(f"{prefix}_family", type_family(F.col(f"{prefix}_base")))
    return df.withColumns({f"{prefix}_1": type_argument(text, 1), f"{prefix}_2": type_argument(text, 2)})


def with_compatibility(df: DataFrame, source: str, target: str, out: str = "verdict") -> DataFrame:
    """Adds ok, warn or block: may values of the mapped type be copied into the live type?"""
    names = df.columns
    df = with_type_parts(with_type_parts(df, source, "from"), target, "to")
    return df.withColumn(out, compatibility()).select(*names, out)


def compatibility() -> Column:
    family, other, base, into = (F.col(c) for c in ("from_family", "to_family", "from_base", "to_base"))
    a1, a2, b1, b2 = (F.col(c) for c in ("from_1", "from_2", "to_1", "to_2"))

    def into_string(longest: Column) -> Column:
        return (
            F.when(other != "string", "block").when(b1.isNotNull() & (longest.isNull() | (longest > b1)), "block")
            .when(into == "character", "warn").otherwise("ok")
        )

    s2, t2 = F.coalesce(a2, F.lit(0)), F.coalesce(b2, F.lit(0))
    numerics = F.when(other != "numeric", "block").when(b1.isNull(), "ok").when(a1.isNull() | (t2 < s2) | (b1 - t2 < a1 - s2), "block").otherwise("ok")
    stamps = F.when((other != "timestamp") | (base != into), "block").when(F.coalesce(b1, F.lit(6)) < F.coalesce(a1, F.lit(6)), "warn").otherwise("ok")
    return (
        F.when((family == "unknown") | (other == "unknown"), "block")
        .when(family == "string", into_string(a1))
        .when(family.isin("integer", "float"), F.when(base == into, "ok").otherwise("block"))
        .when(family == "numeric", numerics)
        .when(family == "timestamp", stamps)
        .when(family == "xml", F.when(other == "xml", "ok").otherwise(into_string(F.lit(None).cast("int"))))  # text of any length
        .otherwise(F.when(base == into, "ok").otherwise("block"))
    )
