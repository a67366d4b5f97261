"""Ticket view over the sample star schema.

Line items play the ticket lines, suppliers and customers the vessels, parts the
species. Only the dimensions that the requested columns need are joined, and the year
range is put to the ship date itself, so that it reaches the parquet scan. Dimensions
carry no hint: their size decides between a broadcast and a shuffle join, and adaptive
execution splits a hot key in the latter.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.sources.schema import MONEY, TICKET_SCHEMA

SAMPLE_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": """c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,
        c_mktsegment string""",
    "part": """p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,
        p_retailprice double""",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string,
        o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
}

DAY = "cast(l_shipdate as date)"

# The sector code that stands for each pair of flags.
CODE_OF_FLAGS = {"AF": "05", "AO": "06", "NF": "07", "NO": "08", "RF": "09", "RO": "10"}

FROM_LINES = {
    "FISH_TICKET_ID": "cast(l_orderkey as string)",
    "LANDING_YEAR": f"year({DAY})",
    "LANDING_MONTH": f"month({DAY})",
    "LANDING_DAY": f"day({DAY})",
    "LANDING_DATE": DAY,
    "VESSEL_NUM": "cast(l_suppkey as string)",
    "VESSEL_REGISTRATION_ID": "concat('R', l_suppkey)",
    "DAHL_GROUNDFISH_CODE": "element_at(map({}), concat(l_returnflag, l_linestatus))".format(
        ", ".join(f"'{x}'" for pair in CODE_OF_FLAGS.items() for x in pair)
    ),
    "CATCH_AREA_CODE": "case l_linenumber when 6 then '61' when 7 then '60A2' else '59A1' end",
    "PARTICIPATION_GROUP_CODE": "case when l_linenumber = 7 then 'A' else 'C' end",
    "COUNCIL_CODE": "case when l_linenumber = 6 then 'N' else 'P' end",
    "GMT_SABLEFISH_CODE": """case when l_linenumber <= 2 then 'PRI' when l_linenumber = 5 then 'OPN'
        else 'LEN' end""",
    "REMOVAL_TYPE_CODE": "case when l_returnflag = 'R' and l_linenumber = 3 then 'E' else 'C' end",
    "ROUND_WEIGHT_LBS": "l_quantity * 100",
    "LANDED_WEIGHT_LBS": "l_quantity * 20",
    "EXVESSEL_REVENUE": f"cast(cast(l_extendedprice as decimal(18, 2)) as {MONEY.simpleString()})",
}
FROM_SUPPLIER = {
    "AGENCY_CODE": "case n_regionkey when 0 then 'O' when 1 then 'W' else 'C' end",
    "PACFIN_CATCH_AREA_CODE": "case n_regionkey when 2 then '1C' when 3 then '1B' else '1A' end",
    "ACL_CODE": "case when n_regionkey = 4 or n_nationkey = 5 then 'SSPN_S' else 'SSPN_N' end",
    "REGION_NAME": "case when n_regionkey = 4 then 'SOUTH CALIFORNIA' else 'NORTH' end",
    "SUBREGION_NAME": "case when n_nationkey = 4 then 'SAN LUIS OBISPO' else 'OTHER' end",
}
FROM_PART = {
    "NOMINAL_TO_ACTUAL_PACFIN_SPECIES_NAME": "p_type",
    "PACFIN_SPECIES_COMMON_NAME": "p_name",
    "MANAGEMENT_GROUP_CODE": "case when p_size <= 40 then 'GRND' else 'OTHR' end",
}
VIEW_COLUMNS = [*FROM_LINES, *FROM_SUPPLIER, *FROM_PART]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read with the declared schema: no footer is opened before the scan itself."""
    return spark.read.schema(SAMPLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _dated(df: DataFrame, column: str, years: tuple[int, int] | None) -> DataFrame:
    if years is None:
        return df
    first, last = years
    return df.filter(
        f"{column} >= timestamp_ntz'{first}-01-01' and {column} < timestamp_ntz'{last + 1}-01-01'"
    )


def sample_tickets(
    spark: SparkSession,
    sf_dir: str,
    columns: Iterable[str] | None = None,
    years: tuple[int, int] | None = None,
    extra_lines: Iterable[str] = (),
    overrides: Mapping[str, str] | None = None,
    codes: Iterable[str] | None = None,
) -> DataFrame:
    """Tickets with the requested columns; ``extra_lines`` passes line-item columns on and
    ``overrides`` replaces the expression of a column. ``codes`` are the sector codes that can count, put as a test on
    the flags that they come from, which reaches the scan; a model's own filter follows."""
    wanted = list(columns) if columns is not None else VIEW_COLUMNS
    ordered = [f.name for f in TICKET_SCHEMA if f.name in wanted]
    changed = overrides or {}

    def named(source: dict[str, str]) -> list[str]:
        return [f"{changed.get(c, source[c])} as {c}" for c in ordered if c in source]

    # Each side works out its own columns below the join, so that label expressions above
    # it see plain columns.
    of_part, of_vessel = named(FROM_PART), named(FROM_SUPPLIER)
    extra = list(extra_lines)
    keys = ["l_partkey"] * bool(of_part) + ["l_suppkey"] * bool(of_vessel)
    lines = _dated(table(spark, sf_dir, "lineitem"), "l_shipdate", years)
    if codes is not None:
        flags = [pair for pair, code in CODE_OF_FLAGS.items() if code in set(codes)]
        lines = lines.filter(" or ".join(f"(l_returnflag = '{a}' and l_linestatus = '{b}')" for a, b in flags))
    tickets = lines.selectExpr(*named(FROM_LINES), *dict.fromkeys(keys + extra))
    # Parts first: a species filter thins the lines before they meet the vessels.
    if of_part:
        parts = table(spark, sf_dir, "part").selectExpr("p_partkey", *of_part)
        tickets = tickets.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    if of_vessel:
        nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        vessels = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        vessels = vessels.selectExpr("s_suppkey", *of_vessel)
        tickets = tickets.join(vessels, F.col("l_suppkey") == F.col("s_suppkey"))
    return tickets.select(*ordered, *extra)


def sample_trip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species lines of the trip view, by ticket."""
    return sample_tickets(
        spark,
        sf_dir,
        [
            "FISH_TICKET_ID",
            "CATCH_AREA_CODE",
            "NOMINAL_TO_ACTUAL_PACFIN_SPECIES_NAME",
            "LANDED_WEIGHT_LBS",
        ],
        extra_lines=["l_orderkey"],
    )


def sample_trip_headers(
    spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None
) -> DataFrame:
    """Ticket headers of the trip view: here the customers are the vessels."""
    orders = _dated(table(spark, sf_dir, "orders"), "o_orderdate", years)
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    vessels = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    day = "cast(o_orderdate as date)"
    return orders.join(vessels, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey",
        f"year({day}) as LANDING_YEAR",
        f"month({day}) as LANDING_MONTH",
        f"{day} as LANDING_DATE",
        "cast(o_custkey as string) as VESSEL_NUM",
        "case n_regionkey when 0 then 'O' when 1 then 'W' else 'C' end as AGENCY_CODE",
        """case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'PRI'
            when o_orderpriority = '5-LOW' then 'OPN' else 'LEN' end as GMT_SABLEFISH_CODE""",
        "case o_orderstatus when 'P' then 'E' else o_orderstatus end as REMOVAL_TYPE_CODE",
    )
