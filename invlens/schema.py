"""Fixed schemas of the two inventory tables.

The inventory layout is owned by an external exporter, so it is declared
once here and never inferred from the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
_L = T.LongType()
_TS = T.TimestampNTZType()

# scan_results: one row per file (or directory) per scan run.
SCAN_RESULTS = T.StructType(
    [
        T.StructField("run_id", _S),
        T.StructField("run_start_time", _S),
        T.StructField("file_uri", _S),
        T.StructField("file_path", _S),
        T.StructField("filename", _S),
        T.StructField("extension", _S),
        T.StructField("size", _L),
        T.StructField("migrated", T.BooleanType()),
        T.StructField("owner_name", _S),
        T.StructField("owner_sid", _S),
        T.StructField("acl", _S),
        T.StructField("acl_analysis", _S),
        T.StructField("parent_acl", _S),
        T.StructField("win_ads_names", _S),
        T.StructField("created", _TS),
        T.StructField("modified", _TS),
        T.StructField("last_accessed", _TS),
        T.StructField("ingest_created", _TS),
        T.StructField("ingest_modified", _TS),
        T.StructField("storage_class", _S),
        T.StructField("storage_state", _S),
        T.StructField("version_id", _S),
    ]
)

# file_physical: bytes allocated on disk; re-probes append, newest probe wins.
FILE_PHYSICAL = T.StructType(
    [
        T.StructField("run_id", _S),
        T.StructField("file_uri", _S),
        T.StructField("allocated", _L),
        T.StructField("probed_at", _TS),
    ]
)

# Timestamp layouts accepted from text sources beside ISO date-times and epoch seconds, tried in order.
TIMESTAMP_FORMATS = ("dd/MM/yyyy HH:mm:ss",)
_ISO = r"^\d{4}-\d\d-\d\d([ T]\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:?\d\d)?)?$"
_EPOCH = r"^\d{9,11}(\.\d{1,9})?$"


def lenient_timestamp(c: Column) -> Column:
    """A text as a timestamp; NULL when no layout fits.

    ISO dates and date-times with a blank or ``T``, up to nine fraction digits
    (microseconds are kept) and an optional ``Z`` or offset, which is brought
    to the session's zone (UTC); ``dd/MM/yyyy HH:mm:ss``; epoch seconds.
    """
    text = F.trim(c.cast("string"))
    iso = F.when(text.rlike(_ISO), F.regexp_replace(text, r"([+-]\d\d)(\d\d)$", "$1:$2").try_cast("timestamp"))
    epoch = F.when(text.rlike(_EPOCH), F.timestamp_micros((text.try_cast("decimal(21,9)") * 1_000_000).cast("long")))
    other = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in TIMESTAMP_FORMATS]
    return F.coalesce(iso, epoch, *other).cast("timestamp_ntz")


def parse_text(schema: T.StructType, columns: list[str]) -> tuple[dict[str, Column], Column]:
    """How each column of a text source is read, and the names of the columns that can't be, as an array.

    An empty text stays empty in text columns (no owner, directory row) and is
    NULL in all others; any other text that gives no value is unreadable.
    """
    parsed, bad = {}, []
    for field in schema.fields:
        if field.name not in columns:
            parsed[field.name] = F.lit(None).cast(field.dataType)
            continue
        text = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            parsed[field.name] = F.when(text.isNull(), F.lit("")).otherwise(text)
            continue
        value = lenient_timestamp(text) if isinstance(field.dataType, T.TimestampNTZType) else F.trim(text).try_cast(field.dataType)
        parsed[field.name] = value
        bad.append(F.when((F.trim(text) != "") & value.isNull(), F.lit(field.name)))
    return parsed, F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")


def enforce_schema(df: DataFrame, schema: T.StructType, lenient_time: bool = False) -> DataFrame:
    """Select exactly ``schema``'s columns in order, cast to its types.

    Columns missing from ``df`` come back as NULL of the declared type.
    With ``lenient_time`` string timestamps are parsed by several layouts
    instead of a strict cast.
    """
    present = set(df.columns)
    cols = []
    for field in schema.fields:
        if field.name not in present:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        src = F.col(field.name)
        if lenient_time and isinstance(field.dataType, T.TimestampNTZType) and isinstance(
            df.schema[field.name].dataType, T.StringType
        ):
            cols.append(lenient_timestamp(src).alias(field.name))
        else:
            cols.append(src.cast(field.dataType).alias(field.name))
    return df.select(*cols)
