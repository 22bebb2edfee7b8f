"""Row constraints of the raw event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from footfall.schema import RAW_EVENTS, REQUIRED_COLUMNS
from footfall.sources.csv_files import MALFORMED
from footfall.sources.events import write_events

CSV_FIELDS, ROWS_READ = "csv_fields", "rows_read"

# Declared lengths of the text columns.
MAX_LENGTH = {"event_type": 30, "category_code": 255, "brand": 255}

# Accepted UUID spellings: any case, optional braces, optional hyphen after each
# group of four hex digits.
_HEX = "[0-9A-Fa-f]{4}(-?[0-9A-Fa-f]{4}){7}"
UUID_PATTERN = rf"\A({_HEX}|\{{{_HEX}\}})\z"


def _typed(name: str) -> Column:
    dtype = next(f.dataType for f in RAW_EVENTS if f.name == name)
    return F.col(name).try_cast(dtype)


def _too_long(name: str) -> Column:
    # trailing blanks beyond the length do not count
    return F.length(F.rtrim(name)) > MAX_LENGTH[name]


def rules() -> dict[str, Column]:
    """Rule name -> condition that a row breaks it. A NULL condition is no failure."""
    broken = {f"{c}_not_null": F.col(c).isNull() for c in REQUIRED_COLUMNS}
    for field in RAW_EVENTS:
        if field.dataType.simpleString() != "string":
            unreadable = F.col(field.name).isNotNull() & _typed(field.name).isNull()
            broken[f"{field.name}_type"] = unreadable
    broken |= {f"{c}_length": _too_long(c) for c in MAX_LENGTH}
    broken["price_not_negative"] = _typed("price") < 0
    broken["user_session_uuid"] = ~F.col("user_session").rlike(UUID_PATTERN)
    return broken


def hyphenated(digits: Column) -> Column:
    """32 hex digits in the 8-4-4-4-12 form of a UUID."""
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _canonical_uuid(name: str) -> Column:
    return hyphenated(F.lower(F.regexp_replace(name, "[{}-]", "")))


def validate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split loaded rows into (valid, rejected).

    ``valid`` has the declared schema: prices rounded half up to cents, UUIDs in lower
    case with hyphens. ``rejected`` keeps the row as it came, with the names of all
    broken rules in ``failed_rules``; a line of a CSV file with too few or too many fields
    breaks ``csv_fields``. A column that may be NULL may be absent. Both are lazy filters of
    the same scan.
    """
    checked = _checked(df)
    return _valid(checked), checked.filter(F.size("failed_rules") > 0)


def _rules_of(df: DataFrame) -> dict[str, Column]:
    if MALFORMED not in df.columns:
        return rules()
    # its fields are not those of the columns they stand in, so no other rule is asked
    good = F.col(MALFORMED).isNull()
    fine = {name: good & broken for name, broken in rules().items()}
    return {CSV_FIELDS: ~good, **fine}


def _checked(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"raw events lack required columns: {', '.join(missing)}")
    absent = {f.name: F.lit(None).cast("string") for f in RAW_EVENTS if f.name not in df.columns}
    broken = (F.when(c, F.lit(name)) for name, c in _rules_of(df).items())
    return df.withColumns(absent).withColumn(
        "failed_rules", F.array_compact(F.array(*broken))
    )


def _valid(checked: DataFrame) -> DataFrame:
    stored = {
        **{f.name: _typed(f.name) for f in RAW_EVENTS},
        **{c: F.substring(F.col(c), 1, n) for c, n in MAX_LENGTH.items()},
        "user_session": _canonical_uuid("user_session"),
    }
    return checked.filter(F.size("failed_rules") == 0).select(
        *(stored[f.name].alias(f.name) for f in RAW_EVENTS)
    )


def write_valid(df: DataFrame, path: str, mode: str = "overwrite") -> dict[str, int]:
    """Write the valid rows by month; number of rows read and of rows breaking each rule.

    The rules are counted while the rows pass on their way to the files, in the one scan
    there is. A row that breaks several rules counts for each.
    """
    checked = _checked(df)
    seen = Observation()
    counts = [
        F.count_if(F.array_contains("failed_rules", name)).alias(name) for name in _rules_of(df)
    ]
    observed = checked.observe(seen, F.count(F.lit(1)).alias(ROWS_READ), *counts)
    write_events(_valid(observed), path, mode)
    return {name: seen.get[name] for name in (ROWS_READ, *_rules_of(df))}
