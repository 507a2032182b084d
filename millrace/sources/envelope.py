"""Change events: JSON forms in, one typed change row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import blank_if_null, is_true_text, null_if_blank, trimmed_key
from millrace.operators.changes import DELETE, SKIP, UPSERT
from millrace.schemas import MEMBER_ATTRIBUTES, MEMBER_KEYS, TEXT

# Every scalar is read as text, so a number in a text field becomes its digits.
MEMBER_IMAGE = T.StructType(
    [T.StructField("update_id", T.LongType())]
    + [T.StructField(c, TEXT) for c in (*MEMBER_KEYS, *MEMBER_ATTRIBUTES, "operation", "source_ts")]
)
FLAT_EVENT = T.StructType(
    [
        T.StructField(
            "payload",
            T.StructType(
                MEMBER_IMAGE.fields
                + [
                    T.StructField("__op", TEXT),
                    T.StructField("__deleted", TEXT),
                    T.StructField("__source_ts_ms", T.LongType()),
                ]
            ),
        ),
        T.StructField("_corrupt", TEXT),
    ]
)
_SOURCE = T.StructType([T.StructField("table", TEXT), T.StructField("ts_ms", T.LongType())])


def envelope_schema(image: T.StructType = MEMBER_IMAGE, op_field: str = "op") -> T.StructType:
    return T.StructType(
        [
            T.StructField(op_field, TEXT),
            T.StructField("before", image),
            T.StructField("after", image),
            T.StructField("source", _SOURCE),
            T.StructField("_corrupt", TEXT),
        ]
    )


def drop_tombstones(df: DataFrame, value: str = "value") -> DataFrame:
    """Messages with a null value only mark a deleted key; they carry no change."""
    return df.where(F.col(value).isNotNull())


def json_object(value) -> Column:
    """The JSON object text, whether sent as an object or wrapped in a JSON string."""
    value = F.col(value) if isinstance(value, str) else value
    wrapped = F.concat(F.lit('{"v":'), value, F.lit("}"))
    inner = F.from_json(wrapped, "v string")["v"]
    return F.when(F.startswith(F.ltrim(value), F.lit('"')), inner).otherwise(value)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that filters on it do not evaluate it a second time.

    Spark moves filters below a projection by copying its expressions; it does
    not move them below an explode.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def read_events(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Parse to a struct column ``e``; bad JSON sets ``e._corrupt`` and goes on."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return computed_once(drop_tombstones(df, value), "e", F.from_json(json_object(value), schema, options))


def split_corrupt(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed events, and those whose text was not valid JSON."""
    bad = F.col("e").isNull() | F.col("e._corrupt").isNotNull()
    return events.where(~bad), events.where(bad)


#: The order of changes: source time, then position in the topic; folders have no position, so ids break ties.
POSITION = ["source_ts_ms", "partition", "offset", "update_id"]
_OPS = ("c", "u", "r", "d")


def source_time(text: Column) -> Column:
    """A time sent as text or as milliseconds since 1970; null where it is neither."""
    ms = F.timestamp_millis(text.try_cast("long")).cast("timestamp_ntz")
    return F.when(text.rlike(r"^-?\d{1,15}$"), ms).otherwise(text.try_cast("timestamp_ntz"))


def _judged(df: DataFrame, form: str, value: str) -> DataFrame:
    """Parsed events with ``_op``, ``_image``, ``_deleted``, ``_ms`` and ``_reason``, null where all is well."""
    if form == "flat":
        events = read_events(df, FLAT_EVENT, value)
        p = F.col("e.payload")
        parts = {"_op": p["__op"], "_image": p, "_deleted": is_true_text(p["__deleted"]), "_ms": p["__source_ts_ms"]}
        known = p["__op"].isNull() | p["__op"].isin(*_OPS)
    else:
        field = "op" if form == "envelope" else "operation"
        events = read_events(df, envelope_schema(op_field=field), value)
        op = F.col(f"e.{field}")
        if form == "custom":
            word = F.lower(F.trim(op))
            op = F.when(word == "insert", "c").when(word == "update", "u").when(word == "delete", "d")
        image = F.when(op == "d", F.col("e.before")).otherwise(F.col("e.after"))
        parts = {"_op": op, "_image": image, "_deleted": op == "d", "_ms": F.col("e.source.ts_ms")}
        known = F.coalesce(op.isin(*_OPS), F.lit(False))
    time = F.col("_image.source_ts")
    reason = (
        F.when(F.col("e").isNull() | F.col("e._corrupt").isNotNull(), "corrupt")
        .when(~F.col("_known"), "unknown operation")
        .when(F.col("_image").isNull(), "no row image")
        .when(time.isNotNull() & source_time(time).isNull(), "bad time")
    )
    return events.withColumns({**parts, "_known": known}).withColumn("_reason", reason)


def parse(df: DataFrame, form: str, value: str = "value") -> DataFrame:
    """Change rows of one form (flat, envelope or custom), with topic positions where ``df`` has them."""
    good = _judged(df, form, value).where(F.col("_reason").isNull())
    image, held = F.col("_image"), [c for c in ("partition", "offset") if c in df.columns]
    return good.select(
        image["update_id"].alias("update_id"),
        trimmed_key(image["ssn_last4"]).alias("ssn_last4"),
        blank_if_null(image["last_name"]).alias("last_name"),
        *[image[c].alias(c) for c in MEMBER_ATTRIBUTES],
        image["operation"].alias("operation"),
        source_time(image["source_ts"]).alias("source_updated_at"),
        F.col("_op").alias("op"),
        F.col("_deleted").alias("is_delete"),
        F.col("_ms").alias("source_ts_ms"),
        *held,
    )


def rejects(df: DataFrame, form: str, value: str = "value") -> DataFrame:
    """The columns of ``df`` and a ``reason`` for each event that ``parse`` leaves out; tombstones are no events."""
    bad = _judged(df, form, value).where(F.col("_reason").isNotNull())
    return bad.select(*df.columns, F.col("_reason").alias("reason"))


def parse_flat(df: DataFrame, value: str = "value") -> DataFrame:
    """Flat form: the row's fields in ``payload`` next to ``__op`` and ``__deleted``."""
    return parse(df, "flat", value)


def parse_envelope(df: DataFrame, value: str = "value") -> DataFrame:
    """Before/after form with ``op`` c, u, r or d; deletes take keys from ``before``."""
    return parse(df, "envelope", value)


def parse_custom(df: DataFrame, value: str = "value") -> DataFrame:
    """Before/after form whose ``operation`` is insert, update or delete."""
    return parse(df, "custom", value)


def normalise_polled(df: DataFrame) -> DataFrame:
    """Polled rows in the shape of parsed events: keys trimmed, blanks become null."""
    return df.select(
        "update_id",
        trimmed_key("ssn_last4").alias("ssn_last4"),
        blank_if_null("last_name").alias("last_name"),
        *[null_if_blank(c).alias(c) for c in MEMBER_ATTRIBUTES],
        F.coalesce(null_if_blank("operation"), F.lit("upsert")).alias("operation"),
        F.col("source_ts").alias("source_updated_at"),
        F.lit(False).alias("is_delete"),
    )


def route(df: DataFrame, skip_blank_keys: bool = True, use_operation: bool = True) -> DataFrame:
    """Add ``action``: skip, delete or upsert, exactly one per row.

    ``use_operation`` also takes a row's own ``operation`` of ``delete``.
    """
    blank = (F.col("ssn_last4") == "") | (F.col("last_name") == "")
    gone = F.col("is_delete")
    if use_operation:
        gone = gone | F.coalesce(F.col("operation") == "delete", F.lit(False))
    action = F.when(gone, DELETE).otherwise(UPSERT)
    if skip_blank_keys:
        action = F.when(blank, SKIP).otherwise(action)
    return df.withColumn("action", action)


def unwrap(df: DataFrame) -> DataFrame:
    """New row state from parsed images (columns op, before, after, source).

    Deletes are rewritten to the before image with ``__deleted`` set to ``true``.
    """
    is_delete = F.col("op") == "d"
    image = F.when(is_delete, F.col("before")).otherwise(F.col("after"))
    return (
        df.withColumn("_r", image)
        .where(F.col("_r").isNotNull())
        .select(
            "_r.*",
            F.col("op").alias("__op"),
            F.when(is_delete, "true").otherwise("false").alias("__deleted"),
            F.col("source.ts_ms").alias("__source_ts_ms"),
        )
    )


def filter_tables(df: DataFrame, names: list[str]) -> DataFrame:
    return df.where(F.col("source.table").isin(*names))


def snapshot_then_changes(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """A full read (op ``r``) ordered before the live changes by ``phase``."""
    first = snapshot.withColumns({"op": F.lit("r"), "phase": F.lit(0)})
    return first.unionByName(changes.withColumn("phase", F.lit(1)), allowMissingColumns=True)


def changed_only(df: DataFrame, columns: list[str], before: str = "before", after: str = "after") -> list[Column]:
    """Per attribute: the after value where it differs from before, else null."""
    return [F.nullif(F.col(f"{after}.{c}"), F.col(f"{before}.{c}")).alias(c) for c in columns]


def shape_changes(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Change rows holding the key and only the attributes that changed."""
    return df.select(*[F.col(f"after.{k}").alias(k) for k in keys], *changed_only(df, columns))
