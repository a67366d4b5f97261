"""The ticket table: one row per fish ticket and species line."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.functions.labels import sector_code

# Wide enough for a sum of any tickets; a value with more decimals than these stops the job.
MONEY = T.DecimalType(24, 6)

TICKET_SCHEMA = T.StructType(
    [
        T.StructField("FISH_TICKET_ID", T.StringType()),
        T.StructField("LANDING_YEAR", T.IntegerType()),
        T.StructField("LANDING_MONTH", T.IntegerType()),
        T.StructField("LANDING_DAY", T.IntegerType()),
        T.StructField("LANDING_DATE", T.DateType()),
        T.StructField("VESSEL_NUM", T.StringType()),
        T.StructField("VESSEL_REGISTRATION_ID", T.StringType()),
        T.StructField("AGENCY_CODE", T.StringType()),
        T.StructField("DAHL_GROUNDFISH_CODE", T.StringType()),
        T.StructField("PACFIN_CATCH_AREA_CODE", T.StringType()),
        T.StructField("CATCH_AREA_CODE", T.StringType()),
        T.StructField("REGION_NAME", T.StringType()),
        T.StructField("SUBREGION_NAME", T.StringType()),
        T.StructField("ACL_CODE", T.StringType()),
        T.StructField("NOMINAL_TO_ACTUAL_PACFIN_SPECIES_NAME", T.StringType()),
        T.StructField("PACFIN_SPECIES_COMMON_NAME", T.StringType()),
        T.StructField("MANAGEMENT_GROUP_CODE", T.StringType()),
        T.StructField("PARTICIPATION_GROUP_CODE", T.StringType()),
        T.StructField("COUNCIL_CODE", T.StringType()),
        T.StructField("GMT_SABLEFISH_CODE", T.StringType()),
        T.StructField("REMOVAL_TYPE_CODE", T.StringType()),
        T.StructField("ROUND_WEIGHT_LBS", T.DoubleType()),
        T.StructField("LANDED_WEIGHT_LBS", T.DoubleType()),
        T.StructField("EXVESSEL_REVENUE", MONEY),
    ]
)

# Headers under which extracts carry the same column.
HEADER_NAMES = {"PACFIN_YEAR": "LANDING_YEAR", "SPECIES": "NOMINAL_TO_ACTUAL_PACFIN_SPECIES_NAME"}


def clean_header(name: str) -> str:
    """Headers as exports spell them: byte-order mark, case, blanks and "(SUM)" suffixes."""
    name = name.lstrip("\ufeff").strip().upper()
    return name.removesuffix("(SUM)").strip().replace(" ", "_").replace(".", "_")


def normalise_headers(df: DataFrame, names: Mapping[str, str] = HEADER_NAMES) -> DataFrame:
    """Rename by name, never by position; an existing target column is left alone."""
    cleaned = {c: clean_header(c) for c in df.columns}
    taken = set(cleaned.values())
    final = {
        c: names[new] if new in names and names[new] not in taken else new
        for c, new in cleaned.items()
    }
    if len(set(final.values())) != len(final):
        raise ValueError(f"two columns share a name after cleaning: {sorted(final.values())}")
    return df.withColumnsRenamed(final)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"ticket table lacks {missing}; it has {df.columns}")
    return df


def exact_money(value: Column, present: T.DataType) -> Column:
    """The value as money with every digit it has; more digits than money holds are an error."""
    if isinstance(present, T.IntegralType) or (
        isinstance(present, T.DecimalType) and present.scale <= MONEY.scale
    ):
        return value.cast(MONEY)
    exact = value if isinstance(present, T.DecimalType) else value.cast(T.DecimalType(38, 14))
    money = exact.cast(MONEY)
    lost = F.concat(F.lit(f"more than {MONEY.scale} decimals in "), value.cast("string"))
    return F.when(exact == money, money).when(exact.isNotNull(), F.raise_error(lost).cast(MONEY))


SECTOR_CODE = "DAHL_GROUNDFISH_CODE"
NORMALISED = {"normalised": True}


def declare_normalised(df: DataFrame) -> DataFrame:
    """Marks the sector codes of a frame as two digits without blanks, as ``conform`` makes them."""
    return df.withMetadata(SECTOR_CODE, NORMALISED)


def codes_are_normalised(df: DataFrame) -> bool:
    return bool(df.schema[SECTOR_CODE].metadata.get("normalised"))


def _typed(field: T.StructField, present: T.DataType, normalised: bool) -> Column:
    value = F.col(field.name)
    if field.name == SECTOR_CODE:
        if normalised and present == field.dataType:
            return value.alias(field.name, metadata=NORMALISED)
        return sector_code(value).alias(field.name)
    if present == field.dataType:
        return value
    if field.dataType == MONEY:
        return exact_money(value, present).alias(field.name)
    return value.cast(field.dataType).alias(field.name)


def conform(
    df: DataFrame, columns: Iterable[str] | None = None, normalised: bool = False
) -> DataFrame:
    """Ticket columns of any source, by name, with declared types.

    ``normalised`` declares that sector codes stored as text are two digits without blanks, such as those of tickets
    that went through here before they were stored. They are then left alone and marked, so that
    the models' filters on them reach the scan.

    Columns the schema does not know are kept as they are unless ``columns`` names the
    ones wanted. Under ANSI mode text that is no number stops the job instead of turning
    into null.
    """
    df = normalise_headers(df)
    known = [f for f in TICKET_SCHEMA if f.name in df.columns]
    other = [c for c in df.columns if c not in TICKET_SCHEMA.names]
    if columns is not None:
        wanted = set(columns)
        require_columns(df, wanted)
        known = [f for f in known if f.name in wanted]
        other = [c for c in other if c in wanted]
    return df.select(
        *(_typed(f, df.schema[f.name].dataType, normalised) for f in known), *other
    )
