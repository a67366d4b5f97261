"""Ticket readers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.sources.schema import TICKET_SCHEMA, conform, normalise_headers

MISSING_TEXT = "NA"
# A quote inside a quoted field is doubled.
QUOTE = '"'


def read_tickets(
    spark: SparkSession,
    path: str | Sequence[str],
    format: str = "csv",
    columns: Iterable[str] | None = None,
    missing: str = MISSING_TEXT,
    strip: bool = True,
    separator: str = ",",
    date_format: str | None = None,
    normalised: bool = False,
) -> DataFrame:
    """Typed tickets from CSV with a header, or from a columnar format.

    CSV fields are read as text under their header names and cast afterwards, so codes
    keep their leading zeros and column order does not matter. ``missing`` marks a missing
    value; a blank is missing in a number or date column and an empty string elsewhere.
    ``date_format`` is the pattern of the dates unless they are ISO dates. A record with
    more or fewer fields than the header stops the job with the name of its file; for
    that every field is parsed. Files stay splittable. ``normalised`` says so of the sector codes
    of a columnar format; see ``conform``.
    """
    if format != "csv":
        return conform(spark.read.format(format).load(path), columns, normalised)
    raw = (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", strip)
        .option("ignoreTrailingWhiteSpace", strip)
        .option("escape", QUOTE)
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
        .csv(path)
    )
    return conform_text(raw, columns, missing, date_format)


def parse_lines(
    lines: DataFrame,
    header: Sequence[str],
    column: str = "value",
    strip: bool = True,
    separator: str = ",",
    malformed: str | None = None,
) -> DataFrame:
    """Text fields of CSV records that stand in a column, such as lines of a log or a queue, by the reader's rules.

    ``header`` names the fields. A record with more or fewer of them stops the job; where ``malformed`` names a column, such
    a record comes out there as it is, with all its fields missing, and the column is missing for all others.
    """
    names = [*header, *([malformed] if malformed else [])]
    options = {
        "sep": separator,
        "escape": QUOTE,
        "ignoreLeadingWhiteSpace": str(strip).lower(),
        "ignoreTrailingWhiteSpace": str(strip).lower(),
        "mode": "PERMISSIVE" if malformed else "FAILFAST",
    }
    if malformed:
        options["columnNameOfCorruptRecord"] = malformed
    record = F.from_csv(F.col(column), ", ".join(f"`{n}` string" for n in names), options).alias("record")
    records = lines.select(record)
    field = F.col("record").getField
    if malformed is None:
        return records.select(*(field(n).alias(n) for n in header))
    whole = field(malformed)
    return records.select(*(F.when(whole.isNull(), field(n)).alias(n) for n in header), whole.alias(malformed))


def conform_text(
    raw: DataFrame,
    columns: Iterable[str] | None = None,
    missing: str = MISSING_TEXT,
    date_format: str | None = None,
) -> DataFrame:
    """Typed tickets from a frame of text fields under headers as exports spell them."""
    raw = normalise_headers(raw)
    types = {f.name: f.dataType for f in TICKET_SCHEMA}
    cleaned = []
    for name in raw.columns:
        kind = types.get(name, T.StringType())
        if isinstance(kind, T.StringType):
            value = F.coalesce(F.col(name), F.lit(""))
            value = F.when(value != missing, value)
        else:
            value = F.trim(F.col(name))
            value = F.when(~value.isin("", missing), value)
        if date_format is not None and isinstance(kind, T.DateType):
            value = F.to_date(value, date_format)
        cleaned.append(value.alias(name))
    return conform(raw.select(*cleaned), columns)


def month_predicates(years: Iterable[int]) -> list[str]:
    """One database predicate, hence one partition, per month. Rows without a month meet
    none of them; no model counts such rows."""
    return [
        f"LANDING_YEAR = {int(year)} AND LANDING_MONTH = {month}"
        for year in years
        for month in range(1, 13)
    ]


def read_tickets_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    predicates: Sequence[str],
    properties: Mapping[str, str] | None = None,
    columns: Iterable[str] | None = None,
    normalised: bool = False,
) -> DataFrame:
    """Lazy database table read in parallel, one partition per predicate.

    Filters and the column list applied later are evaluated by the database. Credentials
    come in ``properties``; fetching is per partition, never through the driver.
    """
    if not predicates:
        raise ValueError("name at least one predicate: without any the read is one task")
    table_df = spark.read.jdbc(
        url, table, predicates=list(predicates), properties=dict(properties or {})
    )
    return conform(table_df, columns, normalised)
