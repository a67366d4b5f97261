"""SQL over the sample tables that gives each registered query's result independently."""

from __future__ import annotations

from harborline.plans.queries import (
    NEARSHORE_NAMES,
    SHELF_NAMES,
    SMALL_BELOW,
    SMALL_NAME,
)


def listing(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


TICKETS = """
tickets AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS FISH_TICKET_ID,
         CAST(year(l_shipdate) AS INTEGER) AS LANDING_YEAR,
         CAST(month(l_shipdate) AS INTEGER) AS LANDING_MONTH,
         CAST(day(l_shipdate) AS INTEGER) AS LANDING_DAY,
         CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS LANDING_DATE,
         CAST(l_suppkey AS VARCHAR) AS VESSEL_NUM,
         'R' || CAST(l_suppkey AS VARCHAR) AS VESSEL_REGISTRATION_ID,
         CASE n_regionkey WHEN 0 THEN 'O' WHEN 1 THEN 'W' ELSE 'C' END AS AGENCY_CODE,
         CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN '05'
              WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN '06'
              WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN '07'
              WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN '08'
              WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN '09'
              WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN '10' END AS DAHL_GROUNDFISH_CODE,
         CASE n_regionkey WHEN 2 THEN '1C' WHEN 3 THEN '1B' ELSE '1A' END AS PACFIN_CATCH_AREA_CODE,
         CASE l_linenumber WHEN 6 THEN '61' WHEN 7 THEN '60A2' ELSE '59A1' END AS CATCH_AREA_CODE,
         CASE WHEN n_regionkey = 4 THEN 'SOUTH CALIFORNIA' ELSE 'NORTH' END AS REGION_NAME,
         CASE WHEN n_nationkey = 4 THEN 'SAN LUIS OBISPO' ELSE 'OTHER' END AS SUBREGION_NAME,
         CASE WHEN n_regionkey = 4 OR n_nationkey = 5 THEN 'SSPN_S' ELSE 'SSPN_N' END AS ACL_CODE,
         p_type AS NOMINAL_TO_ACTUAL_PACFIN_SPECIES_NAME,
         p_name AS PACFIN_SPECIES_COMMON_NAME,
         CASE WHEN p_size <= 40 THEN 'GRND' ELSE 'OTHR' END AS MANAGEMENT_GROUP_CODE,
         CASE WHEN l_linenumber = 7 THEN 'A' ELSE 'C' END AS PARTICIPATION_GROUP_CODE,
         CASE WHEN l_linenumber = 6 THEN 'N' ELSE 'P' END AS COUNCIL_CODE,
         CASE WHEN l_linenumber <= 2 THEN 'PRI' WHEN l_linenumber = 5 THEN 'OPN' ELSE 'LEN' END
           AS GMT_SABLEFISH_CODE,
         CASE WHEN l_returnflag = 'R' AND l_linenumber = 3 THEN 'E' ELSE 'C' END AS REMOVAL_TYPE_CODE,
         l_quantity * 100 AS ROUND_WEIGHT_LBS,
         l_quantity * 20 AS LANDED_WEIGHT_LBS,
         CAST(l_extendedprice AS DECIMAL(18, 2)) AS EXVESSEL_REVENUE,
         l_linenumber, l_suppkey, l_partkey
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
)"""

GAPPED = (
    TICKETS
    + """,
gapped AS (
  SELECT LANDING_YEAR, LANDING_MONTH, LANDING_DAY, VESSEL_REGISTRATION_ID, CATCH_AREA_CODE,
         MANAGEMENT_GROUP_CODE,
         CASE WHEN l_suppkey % 10 = 2 THEN NULL ELSE VESSEL_NUM END AS VESSEL_NUM,
         CASE l_suppkey % 13 WHEN 5 THEN NULL WHEN 6 THEN 'X' ELSE AGENCY_CODE END AS AGENCY_CODE,
         CASE l_linenumber WHEN 1 THEN NULL
              WHEN 2 THEN CAST(CAST(DAHL_GROUNDFISH_CODE AS INTEGER) AS VARCHAR)
              WHEN 3 THEN ' ' || DAHL_GROUNDFISH_CODE || ' '
              WHEN 4 THEN '04' ELSE DAHL_GROUNDFISH_CODE END AS DAHL_GROUNDFISH_CODE,
         CASE l_linenumber WHEN 1 THEN NULL WHEN 4 THEN 4
              ELSE CAST(DAHL_GROUNDFISH_CODE AS INTEGER) END AS code,
         CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE PACFIN_CATCH_AREA_CODE END AS PACFIN_CATCH_AREA_CODE,
         CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE ACL_CODE END AS ACL_CODE,
         CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE REGION_NAME END AS REGION_NAME,
         CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE SUBREGION_NAME END AS SUBREGION_NAME,
         CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE NOMINAL_TO_ACTUAL_PACFIN_SPECIES_NAME END
           AS NOMINAL_TO_ACTUAL_PACFIN_SPECIES_NAME,
         CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE PACFIN_SPECIES_COMMON_NAME END
           AS PACFIN_SPECIES_COMMON_NAME,
         CASE WHEN l_suppkey % 10 IN (0, 1) THEN NULL ELSE ROUND_WEIGHT_LBS END AS ROUND_WEIGHT_LBS,
         CASE WHEN l_suppkey % 10 IN (0, 1) THEN NULL ELSE LANDED_WEIGHT_LBS END AS LANDED_WEIGHT_LBS,
         CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE EXVESSEL_REVENUE END AS EXVESSEL_REVENUE
  FROM tickets
)"""
)

PERIOD = "CAST(ceil(LANDING_MONTH / 2.0) AS INTEGER)"
# Strict labels over an integer code column.
FLEET = "CASE WHEN code IN (5, 7, 9) THEN 'LE' WHEN code IN (6, 8, 10) THEN 'OA' END"
SECTOR = "CASE WHEN code IN (5, 6) THEN 'NS' WHEN code BETWEEN 7 AND 10 THEN 'NON-NS' END"
AREA = """CASE WHEN AGENCY_CODE = 'O' OR AGENCY_CODE = 'W' THEN 'N4010'
     WHEN AGENCY_CODE = 'C' THEN CASE WHEN PACFIN_CATCH_AREA_CODE = '1C' THEN 'N4010'
                                      WHEN PACFIN_CATCH_AREA_CODE <> '1C' THEN 'S4010' END END"""
# Labels with a default: missing only where the deciding code is missing.
FLEET_DEFAULT = "CASE WHEN code IS NULL THEN NULL WHEN code IN (5, 7, 9) THEN 'LE' ELSE 'OA' END"
SECTOR_STATE = """CASE WHEN code IS NULL THEN NULL WHEN code BETWEEN 7 AND 10 THEN 'NON_NS'
     WHEN AGENCY_CODE IS NULL THEN NULL WHEN AGENCY_CODE = 'O' THEN 'OR_NS' ELSE 'CAL_NS' END"""
AREA_DEFAULT = """CASE WHEN AGENCY_CODE IS NULL THEN NULL
     WHEN AGENCY_CODE IN ('O', 'W') THEN 'N4010' WHEN PACFIN_CATCH_AREA_CODE IS NULL THEN NULL
     WHEN PACFIN_CATCH_AREA_CODE = '1C' THEN 'N4010' ELSE 'S4010' END"""
SUBAREA = """CASE WHEN AGENCY_CODE IS NULL THEN NULL
     WHEN AGENCY_CODE IN ('O', 'W') THEN 'N42' WHEN PACFIN_CATCH_AREA_CODE IS NULL THEN NULL
     WHEN PACFIN_CATCH_AREA_CODE = '1C' THEN '4010_42' ELSE 'S4010' END"""
SUBAREA_STOCK = """CASE WHEN ACL_CODE = 'SSPN_S' THEN 'South of 3427'
     WHEN AGENCY_CODE = 'C' AND PACFIN_CATCH_AREA_CODE IN ('1A', '1B') AND ACL_CODE = 'SSPN_N'
       THEN '3427-4010'
     WHEN AGENCY_CODE = 'C' AND PACFIN_CATCH_AREA_CODE = '1C' THEN '4010-42'
     WHEN AGENCY_CODE IN ('O', 'W') THEN 'N42' END"""
SUBAREA_PORT = """CASE WHEN REGION_NAME = 'SOUTH CALIFORNIA' AND SUBREGION_NAME <> 'SAN LUIS OBISPO'
     THEN 'S3427' ELSE 'N3427' END"""
CODED = "SELECT *, CAST(DAHL_GROUNDFISH_CODE AS INTEGER) AS code FROM tickets"
N_LBS = "count(*) AS N, round(coalesce(sum(ROUND_WEIGHT_LBS), 0), 4) AS LBS"
MT = "2204.6::DOUBLE"


def label(columns: str, name: str, expression: str) -> str:
    return f"""WITH {GAPPED}
SELECT {columns}, {expression} AS {name}, {N_LBS}
FROM gapped GROUP BY {columns}, {expression}"""


CODE, AGENCY, CATCH = "DAHL_GROUNDFISH_CODE", "AGENCY_CODE", "PACFIN_CATCH_AREA_CODE"
NOMINAL, COMMON = "NOMINAL_TO_ACTUAL_PACFIN_SPECIES_NAME", "PACFIN_SPECIES_COMMON_NAME"

# The later override wins, so it is tested first. The override of an agency is unknown for
# its listed species when the agency is.
SPECIES_RULES = f"""CASE
  WHEN {COMMON} IS NULL THEN NULL
  WHEN AGENCY_CODE IS NULL AND {COMMON} IN
    ('red bolt', 'red gear', 'red plate', 'old bolt', 'old gear', 'old anvil') THEN NULL
  WHEN AGENCY_CODE = 'W' AND {COMMON} = 'old anvil' THEN 'OLD ANVIL W'
  WHEN AGENCY_CODE = 'O' AND {COMMON} IN ('old bolt', 'old gear') THEN 'OLD BOLT AND GEAR'
  WHEN AGENCY_CODE = 'O' AND {COMMON} IN ('red bolt', 'red gear', 'red plate') THEN 'RED BOLT AND GEAR'
  WHEN {COMMON} IN ('red anvil', 'red bolt', 'red gear', 'red gizmo', 'old anvil') THEN 'NEARSHORE'
  ELSE {COMMON} END"""

VESSEL_PERIODS = f"""
coded AS ({CODED}),
vessel_periods AS (
  SELECT VESSEL_NUM, LANDING_YEAR, {PERIOD} AS PERIOD, {FLEET} AS TYPE,
         sum(ROUND_WEIGHT_LBS) AS tlbs
  FROM coded WHERE {NOMINAL} = 'ECONOMY' GROUP BY ALL
)"""


def raised(limit: str, threshold: str, landed: str = "tlbs", sq: str = "sq") -> str:
    return f"""(CASE WHEN {landed} >= {limit} THEN {landed}
      WHEN {landed} / {sq} >= {threshold}::DOUBLE THEN {limit} ELSE {landed} END)"""


def capped(limit: str, threshold: str, landed: str = "tlbs", sq: str = "sq") -> str:
    return f"""(CASE WHEN {landed} >= {limit} THEN {limit}
      WHEN {landed} / {sq} >= {threshold}::DOUBLE THEN {limit} ELSE {landed} END)"""


def tons(pounds: str, name: str) -> str:
    return f"round(sum({pounds} / {MT}), 4) AS {name}"


def response(rule, limit_le: int, limit_oa: int) -> str:
    return f"""WITH {TICKETS}, {VESSEL_PERIODS},
limited AS (
  SELECT *, CASE TYPE WHEN 'LE' THEN 7000.0::DOUBLE ELSE 3500.0::DOUBLE END AS sq,
         CASE TYPE WHEN 'LE' THEN {limit_le}::DOUBLE ELSE {limit_oa}::DOUBLE END AS alt
  FROM vessel_periods),
responded AS (SELECT *, {rule("alt", "0.8")} AS lbs FROM limited)
SELECT TYPE, count(*) AS N, count(*) FILTER (WHERE lbs > tlbs) AS N_RAISED,
       count(*) FILTER (WHERE lbs < tlbs) AS N_LOWERED, {tons("tlbs", "SQ_MT")},
       {tons("lbs", "RESPONSE_MT")}
FROM responded GROUP BY TYPE"""


TRIPS = """
trip_lines AS (
  SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS trip_date,
         CASE n_regionkey WHEN 0 THEN 'O' WHEN 1 THEN 'W' ELSE 'C' END AS agency,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'PRI'
              WHEN o_orderpriority = '5-LOW' THEN 'OPN' ELSE 'LEN' END AS fishery,
         o_orderstatus AS removal, p_type AS species, l_quantity * 20 AS lbs
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE p_type = 'STANDARD' OR (p_type = 'PROMO' AND l_linenumber NOT IN (6, 7))
),
all_trips AS (
  SELECT CAST(year(trip_date) AS INTEGER) AS LANDING_YEAR,
         CAST(month(trip_date) AS INTEGER) AS LANDING_MONTH, trip_date,
         CAST(o_custkey AS VARCHAR) AS VESSEL_NUM,
         sum(CASE WHEN species = 'PROMO' THEN lbs ELSE 0 END) AS ph,
         sum(CASE WHEN species = 'STANDARD' THEN lbs ELSE 0 END) AS sf
  FROM trip_lines GROUP BY ALL
),
season AS (
  SELECT CAST(year(trip_date) AS INTEGER) AS LANDING_YEAR,
         CAST(month(trip_date) AS INTEGER) AS LANDING_MONTH, trip_date, o_custkey,
         sum(CASE WHEN species = 'PROMO' THEN lbs ELSE 0 END) AS ph,
         sum(CASE WHEN species = 'STANDARD' THEN lbs ELSE 0 END) AS sf
  FROM trip_lines
  WHERE agency = 'W' AND fishery IN ('PRI', 'LEN') AND removal <> 'P'
    AND month(trip_date) BETWEEN 4 AND 10
  GROUP BY ALL
)"""
# Nearest thousand, halves to even, then one thousand back unless within 100 pounds of it.
STEPPED = """(CASE WHEN stepped0 > sf + 100 THEN stepped0 - 1000 ELSE stepped0 END)"""


def stepped(source: str) -> str:
    return f"""
rounded AS (SELECT *, CAST(round_even(sf / 1000.0, 0) * 1000 AS DOUBLE) AS stepped0 FROM {source}),
stepped AS (
  SELECT * EXCLUDE stepped0, CASE WHEN {STEPPED} = 0 THEN sf ELSE {STEPPED} END AS st FROM rounded
),
limited AS (
  SELECT *, st / 5.0::DOUBLE + 30 AS sq, st / 4.0::DOUBLE + 30 AS alt FROM stepped
),
responded AS (
  SELECT *, CASE WHEN st < 1000 THEN ph WHEN ph / sq >= 0.8::DOUBLE THEN sq ELSE ph END AS sq_lbs,
         CASE WHEN st < 1000 THEN ph WHEN ph / sq >= 0.8::DOUBLE THEN alt ELSE ph END AS alt_lbs
  FROM limited
)"""


LINGCOD = f"""WITH {TICKETS},
coded AS ({CODED}),
labelled AS (
  SELECT *, {FLEET_DEFAULT} AS TYPE, {SECTOR_STATE} AS SECTOR, {SUBAREA} AS SUBAREA FROM coded
  WHERE MANAGEMENT_GROUP_CODE = 'GRND' AND {NOMINAL} = 'ECONOMY' AND code BETWEEN 5 AND 10
),
totals AS (
  SELECT VESSEL_NUM, CASE TYPE WHEN 'LE' THEN {PERIOD} ELSE LANDING_MONTH END AS PERIOD,
         SUBAREA, TYPE, SECTOR, LANDING_YEAR, sum(ROUND_WEIGHT_LBS) AS tlbs
  FROM labelled GROUP BY ALL
),
scoped AS (
  SELECT *, CASE TYPE WHEN 'LE' THEN 4 ELSE 9 END AS cut,
         CASE TYPE WHEN 'LE' THEN 7000.0::DOUBLE ELSE 3500.0::DOUBLE END AS sq,
         CASE TYPE WHEN 'LE' THEN 9000.0::DOUBLE ELSE 4500.0::DOUBLE END AS l1,
         CASE TYPE WHEN 'LE' THEN 11000.0::DOUBLE ELSE 5500.0::DOUBLE END AS l2,
         CASE TYPE WHEN 'LE' THEN 14000.0::DOUBLE ELSE 7000.0::DOUBLE END AS l3
  FROM totals WHERE SUBAREA = 'N42'
),
responded AS (
  SELECT *, {raised("l1", "0.8")} AS a1, {raised("l2", "0.8")} AS a2, {raised("l3", "0.8")} AS a3
  FROM scoped
  WHERE (LANDING_YEAR = 2000 AND PERIOD > cut) OR (LANDING_YEAR = 2001 AND PERIOD <= cut)
)"""
BINS = """(VALUES ('OR', 0.2654, 0.003, 0.28), ('OR', 0.6400, 0.016, 0.45),
  ('OR', 0.0897, 0.067, 0.67), ('OR', 0.0049, 0.005, 1.00),
  ('ncal', 0.2109, 0.001, 0.28), ('ncal', 0.5837, 0.008, 0.45),
  ('ncal', 0.2033, 0.070, 0.67), ('ncal', 0.0021, 0.045, 1.00)) bins(region, share, ratio, dmr)"""


def per_ton(region: str) -> str:
    return f"""(SELECT sum(share::DOUBLE * ratio::DOUBLE * dmr::DOUBLE) FROM {BINS}
      WHERE region = '{region}')"""


STRICT = f"""
coded AS ({CODED}),
labelled AS (
  SELECT *, {PERIOD} AS PERIOD, {FLEET} AS TYPE, {SECTOR} AS SECTOR, {AREA} AS AREA FROM coded
)"""
# Pounds of November 2001 brought to the whole month.
FACTOR = """(CASE WHEN LANDING_YEAR = 2001 AND LANDING_MONTH = 11
  THEN 30.0::DOUBLE / (SELECT max(LANDING_DAY) FROM {source}
                       WHERE LANDING_YEAR = 2001 AND LANDING_MONTH = 11)
  ELSE 1.0::DOUBLE END)"""


def completed(pounds: str, source: str) -> str:
    """Sum with the part of November 2001 scaled."""
    november = "LANDING_YEAR = 2001 AND LANDING_MONTH = 11"
    return f"""(coalesce(sum({pounds}) FILTER (WHERE NOT ({november})), 0)
    + coalesce(CAST(sum({pounds}) FILTER (WHERE {november}) AS DOUBLE) * 30
               / (SELECT max(LANDING_DAY) FROM {source} WHERE {november}), 0))"""


def zones(period: str, grain: str, oa: tuple = (100, 50, 40), periods: int = 6) -> str:
    return f"""WITH {TICKETS}, {STRICT},
banded AS (SELECT *, {SUBAREA_STOCK} AS SUBAREA FROM labelled
           WHERE {NOMINAL} = 'ECONOMY' AND LANDING_YEAR = 2001),
totals AS (
  SELECT CASE TYPE WHEN 'LE' THEN VESSEL_NUM ELSE VESSEL_REGISTRATION_ID END AS vessel,
         {period} AS P, {grain} AS grain, SUBAREA, AREA, TYPE, SECTOR,
         sum(LANDED_WEIGHT_LBS) AS tlbs
  FROM banded WHERE SUBAREA IS NOT NULL AND AREA IS NOT NULL AND TYPE IS NOT NULL
  GROUP BY ALL
),
zoned AS (
  SELECT *, TYPE || 'N' AS ZONE FROM totals WHERE AREA = 'N4010'
  UNION ALL SELECT *, TYPE || 'S' FROM totals WHERE SUBAREA = '3427-4010'
  UNION ALL SELECT *, 'LESS' FROM totals WHERE SUBAREA = 'South of 3427' AND TYPE = 'LE'
),
limited AS (
  SELECT *,
    CASE WHEN TYPE = 'OA' THEN {oa[0]} WHEN ZONE = 'LESS' THEN 3000 WHEN P <= 3 THEN 2000 ELSE 2500 END::DOUBLE AS sq,
    CASE WHEN TYPE = 'OA' THEN {oa[1]} WHEN ZONE = 'LESS' THEN 4000 ELSE 3000 END::DOUBLE AS l1,
    CASE WHEN TYPE = 'OA' THEN {oa[2]} WHEN ZONE = 'LESS' THEN NULL ELSE 750 END::DOUBLE AS l2,
    CASE WHEN TYPE = 'OA' THEN NULL WHEN ZONE = 'LESS' THEN NULL ELSE 350 END::DOUBLE AS l3
  FROM zoned WHERE P <= {periods}
)"""


def zone_model(period: str, grain: str, **limits) -> str:
    return f"""{zones(period, grain, **limits)}
SELECT ZONE, {tons("tlbs", "SQ_MT")},
  round(sum(CASE WHEN TYPE = 'OA' THEN {capped("l1", "0.8")} WHEN ZONE = 'LESS'
    THEN {raised("l1", "0.8")} ELSE {raised("l1", "0.6")} END / {MT}), 4) AS A1_MT,
  CASE WHEN ZONE <> 'LESS' THEN round(sum(CASE WHEN TYPE = 'OA' THEN {capped("l2", "0.8")}
    ELSE {capped("l2", "0.6")} END / {MT}), 4) END AS A2_MT,
  CASE WHEN ZONE IN ('LEN', 'LES') THEN round(sum({capped("l3", "0.6")} / {MT}), 4) END AS A3_MT
FROM limited GROUP BY ZONE"""


BY_FLEET = f"CASE TYPE WHEN 'LE' THEN {PERIOD} ELSE LANDING_MONTH END"
PRICED = f"""WITH {GAPPED},
banded AS (
  SELECT *, {PERIOD} AS PERIOD, {SUBAREA_STOCK} AS SUBAREA, {AREA} AS AREA, {FLEET} AS TYPE,
         {SECTOR} AS SECTOR, 'ECON' AS SPPGROUP
  FROM gapped WHERE {NOMINAL} = 'ECONOMY'
),
totals AS (
  SELECT VESSEL_NUM, LANDING_MONTH, PERIOD, SUBAREA, AREA, TYPE, SECTOR, LANDING_YEAR, SPPGROUP,
         CAST(coalesce(sum(EXVESSEL_REVENUE), 0) AS DOUBLE) AS exvessel,
         CAST(coalesce(sum(LANDED_WEIGHT_LBS), 0) AS DOUBLE) AS tlbs
  FROM banded
  WHERE TYPE = 'LE' AND VESSEL_NUM IS NOT NULL AND SUBAREA IS NOT NULL AND AREA IS NOT NULL
    AND SECTOR IS NOT NULL
  GROUP BY ALL
),
priced AS (
  SELECT *, CASE WHEN tlbs <> 0 THEN exvessel / tlbs END AS price,
         CASE WHEN tlbs = 0 THEN 1 ELSE 0 END AS infinite
  FROM totals WHERE NOT (tlbs = 0 AND exvessel = 0)
)"""


def years_frame(area: str, source: str, more: str = "") -> str:
    return f"""
yearly AS (
  SELECT LANDING_YEAR, {more} {area} AS AREA, {COMMON} AS SPECIES,
         sum(CASE WHEN LANDING_MONTH < 9 THEN ROUND_WEIGHT_LBS / {MT} ELSE 0 END) AS thru,
         sum(ROUND_WEIGHT_LBS / {MT}) AS mt
  FROM {source} GROUP BY ALL
)"""


def shelf(scope: str) -> str:
    return f"""WITH {TICKETS},
coded AS ({CODED}),
labelled AS (
  SELECT *, {FLEET_DEFAULT} AS TYPE, {SECTOR_STATE} AS SECTOR, {AREA_DEFAULT} AS AREA FROM coded
  WHERE MANAGEMENT_GROUP_CODE = 'GRND' AND PARTICIPATION_GROUP_CODE = 'C' AND COUNCIL_CODE = 'P'
    AND code BETWEEN 5 AND 10 AND {COMMON} IN ({listing(SHELF_NAMES)})
),
totals AS (
  SELECT VESSEL_NUM, LANDING_MONTH, AREA, TYPE, SECTOR, LANDING_YEAR,
         sum(ROUND_WEIGHT_LBS) AS tlbs, 800.0::DOUBLE AS sq
  FROM labelled
  WHERE {scope}
  GROUP BY VESSEL_NUM, LANDING_MONTH, AREA, TYPE, SECTOR, LANDING_YEAR
)
SELECT TYPE, {tons("tlbs", "SQ_MT")},
       round(sum(CASE TYPE WHEN 'LE' THEN {raised("1500.0::DOUBLE", "0.9")}
                 ELSE {raised("1500.0::DOUBLE", "0.54")} END / {MT}), 4) AS A1_MT
FROM totals GROUP BY TYPE"""


def fixed_text(name: str) -> str:
    number = f"CAST(CAST({name} AS DECIMAL(38, 4)) AS VARCHAR)"
    return f"rtrim(rtrim({number}, '0'), '.') AS {name}"


ORACLE: dict[str, str] = {
    "q_tickets_conform": f"""WITH {TICKETS}
SELECT * EXCLUDE (l_linenumber, l_suppkey, l_partkey, EXVESSEL_REVENUE, DAHL_GROUNDFISH_CODE,
                  LANDING_DAY, ROUND_WEIGHT_LBS, AGENCY_CODE, LANDING_DATE),
       CASE WHEN l_linenumber <> 3 THEN DAHL_GROUNDFISH_CODE END AS DAHL_GROUNDFISH_CODE,
       CASE WHEN l_linenumber <> 4 THEN LANDING_DAY END AS LANDING_DAY,
       CASE WHEN l_linenumber <> 5 THEN ROUND_WEIGHT_LBS END AS ROUND_WEIGHT_LBS,
       CASE l_linenumber WHEN 6 THEN NULL WHEN 7 THEN '' ELSE AGENCY_CODE END AS AGENCY_CODE,
       CASE WHEN l_linenumber <> 7 THEN LANDING_DATE END AS LANDING_DATE,
       CAST(EXVESSEL_REVENUE AS DOUBLE) AS EXVESSEL_REVENUE FROM tickets""",
    "q_widen_limits": f"""WITH {TICKETS}, {VESSEL_PERIODS}
SELECT TYPE, PERIOD, CASE TYPE WHEN 'LE' THEN 7000.0 ELSE 3500.0 END::DOUBLE AS TL_SQ,
       CASE TYPE WHEN 'LE' THEN 9000.0 ELSE 4500.0 END::DOUBLE AS TL_A1,
       CASE TYPE WHEN 'LE' THEN 5000.0 ELSE 2500.0 END::DOUBLE AS TL_A2,
       count(*) AS N, sum(tlbs) AS LBS
FROM vessel_periods WHERE TYPE IS NOT NULL GROUP BY TYPE, PERIOD""",
    "q_month_gross": f"""WITH {TRIPS}
SELECT LANDING_MONTH, sum(ph) AS PACIFIC_HALIBUT_GROSS, sum(sf) AS SABLEFISH_GROSS
FROM season WHERE LANDING_YEAR = 2001 GROUP BY LANDING_MONTH""",
    "q_zone_branches": f"""WITH {TICKETS}, {STRICT},
banded AS (SELECT *, {SUBAREA_STOCK} AS SUBAREA FROM labelled
           WHERE {NOMINAL} = 'ECONOMY' AND LANDING_YEAR = 2001),
totals AS (
  SELECT CASE TYPE WHEN 'LE' THEN VESSEL_NUM ELSE VESSEL_REGISTRATION_ID END AS vessel, PERIOD,
         SUBAREA, AREA, TYPE, SECTOR, sum(LANDED_WEIGHT_LBS) AS tlbs
  FROM banded WHERE SUBAREA IS NOT NULL AND AREA IS NOT NULL AND TYPE IS NOT NULL GROUP BY ALL),
zoned AS (
  SELECT *, TYPE || 'N' AS ZONE, 2000::DOUBLE AS sq FROM totals WHERE AREA = 'N4010'
  UNION ALL SELECT *, TYPE || 'S', 2000::DOUBLE FROM totals WHERE SUBAREA = '3427-4010'
  UNION ALL SELECT *, TYPE || 'SS', 2000::DOUBLE FROM totals WHERE SUBAREA = 'South of 3427'),
responded AS (
  SELECT *, {raised("2600::DOUBLE", "0.8")} AS a1, {capped("1500::DOUBLE", "0.6")} AS a2 FROM zoned)
SELECT ZONE, {tons("tlbs", "SQ_MT")},
       count(*) FILTER (WHERE a1 > tlbs) AS A1_RAISED, count(*) FILTER (WHERE a1 < tlbs) AS A1_LOWERED,
       count(*) FILTER (WHERE a1 = tlbs) AS A1_KEPT, {tons("a1", "A1_MT")},
       count(*) FILTER (WHERE a2 > tlbs) AS A2_RAISED, count(*) FILTER (WHERE a2 < tlbs) AS A2_LOWERED,
       count(*) FILTER (WHERE a2 = tlbs) AS A2_KEPT, {tons("a2", "A2_MT")}
FROM responded GROUP BY ZONE""",
    "q_model_incidental": f"""WITH {TICKETS},
season AS (
  SELECT LANDING_YEAR, LANDING_MONTH, LANDING_DATE, l_suppkey % 5 AS vessel,
         sum(CASE WHEN {NOMINAL} = 'PROMO' THEN LANDED_WEIGHT_LBS ELSE 0 END) AS ph,
         sum(CASE WHEN {NOMINAL} = 'STANDARD' THEN LANDED_WEIGHT_LBS ELSE 0 END) AS sf
  FROM tickets
  WHERE AGENCY_CODE = 'C' AND GMT_SABLEFISH_CODE IN ('PRI', 'LEN', 'OPN') AND REMOVAL_TYPE_CODE <> 'E'
    AND LANDING_MONTH BETWEEN 4 AND 10 AND LANDING_YEAR IN (2000, 2001)
    AND ({NOMINAL} = 'STANDARD' OR {NOMINAL} = 'PROMO' AND CATCH_AREA_CODE = '59A1')
  GROUP BY ALL), {stepped("season")},
rest AS (
  SELECT coalesce(sum(sq_lbs), 0) AS sq, coalesce(sum(alt_lbs), 0) AS alt FROM responded
  WHERE LANDING_YEAR = 2000 AND LANDING_MONTH > 8 AND ph > 0 AND sf > 0),
so_far AS (
  SELECT coalesce(sum(ph), 0) AS ph FROM season WHERE LANDING_YEAR = 2001 AND LANDING_MONTH <= 8)
SELECT 2001 AS LANDING_YEAR, round(ph, 4) AS SO_FAR_LBS, round(sq, 4) AS SQTL_200LBS_REST_LBS,
       round(alt, 4) AS ALT1_250LBS_REST_LBS,
       round((ph + sq) * 0.88::DOUBLE, 4) AS SQTL_200LBS_NET_LBS,
       round((ph + alt) * 0.88::DOUBLE, 4) AS ALT1_250LBS_NET_LBS
FROM rest, so_far""",
    "q_tickets_scan": f"""WITH {TICKETS}
SELECT * EXCLUDE (l_linenumber, l_suppkey, l_partkey, EXVESSEL_REVENUE),
       CAST(EXVESSEL_REVENUE AS DOUBLE) AS EXVESSEL_REVENUE FROM tickets""",
    "q_limit_table": f"""WITH {TICKETS}, {VESSEL_PERIODS},
limits AS (
  SELECT * FROM (VALUES ('LE', 'SQ', 7000.0), ('LE', 'A1', 9000.0), ('LE', 'A2', 11000.0),
    ('LE', 'A3', 14000.0), ('OA', 'SQ', 3500.0), ('OA', 'A1', 4500.0), ('OA', 'A2', 2500.0))
    t(TYPE, SCENARIO, lbs)
)
SELECT TYPE, PERIOD, SCENARIO, lbs::DOUBLE AS LIMIT_LBS, count(*) AS N,
       count(*) FILTER (WHERE tlbs >= lbs::DOUBLE) AS N_AT_LIMIT
FROM vessel_periods JOIN limits USING (TYPE) GROUP BY ALL""",
    "q_period": f"""WITH {TICKETS}
SELECT LANDING_MONTH, {PERIOD} AS PERIOD, {N_LBS} FROM tickets GROUP BY LANDING_MONTH""",
    "q_label_fleet": label(CODE, "TYPE", FLEET),
    "q_label_fleet_default": label(CODE, "TYPE", FLEET_DEFAULT),
    "q_label_sector": label(CODE, "SECTOR", SECTOR),
    "q_label_sector3": label(f"{CODE}, {AGENCY}", "SECTOR", SECTOR_STATE),
    "q_label_area": label(f"{AGENCY}, {CATCH}", "AREA", AREA),
    "q_label_area_default": label(f"{AGENCY}, {CATCH}", "AREA", AREA_DEFAULT),
    "q_label_subarea": label(f"{AGENCY}, {CATCH}", "SUBAREA", SUBAREA),
    "q_label_subarea_stock": label(f"{AGENCY}, {CATCH}, ACL_CODE", "SUBAREA", SUBAREA_STOCK),
    "q_label_subarea_port": label("REGION_NAME, SUBREGION_NAME", "SUBAREA", SUBAREA_PORT),
    "q_species_precedence": label(f"{COMMON}, {AGENCY}", "SPPGROUP", SPECIES_RULES),
    "q_species_group": f"""WITH {GAPPED}
SELECT {NOMINAL}, CASE WHEN {NOMINAL} = 'ECONOMY' THEN 'ECON' END AS SPPGROUP,
       CASE WHEN {NOMINAL} IS NULL THEN NULL WHEN {NOMINAL} = 'ECONOMY' THEN 'ECON' ELSE '' END
         AS SPPGROUP_OR_BLANK, {N_LBS}
FROM gapped GROUP BY {NOMINAL}""",
    "q_species_overlap": f"""WITH {TICKETS},
grouped AS (
  SELECT *, 'WIDOW&SHELF' AS SPPGROUP FROM tickets WHERE {NOMINAL} IN ('LARGE', 'SMALL', 'MEDIUM')
  UNION ALL SELECT *, 'SHELF' FROM tickets WHERE {NOMINAL} IN ('SMALL', 'MEDIUM')
  UNION ALL SELECT *, 'WIDOW' FROM tickets WHERE {NOMINAL} = 'LARGE'
)
SELECT LANDING_YEAR, SPPGROUP, {N_LBS} FROM grouped GROUP BY LANDING_YEAR, SPPGROUP""",
    "q_filter_in": f"""WITH {GAPPED}
SELECT {COMMON}, {N_LBS} FROM gapped
WHERE MANAGEMENT_GROUP_CODE = 'GRND' AND code BETWEEN 5 AND 10
  AND {COMMON} IN ({listing(SHELF_NAMES)})
GROUP BY {COMMON}""",
    "q_filter_between": f"""WITH {TICKETS}
SELECT LANDING_YEAR, LANDING_MONTH, {N_LBS} FROM tickets
WHERE LANDING_YEAR BETWEEN 1997 AND 1999 GROUP BY LANDING_YEAR, LANDING_MONTH""",
    "q_filter_not": """SELECT CAST(year(o_orderdate) AS INTEGER) AS LANDING_YEAR,
       o_orderstatus AS REMOVAL_TYPE_CODE, count(*) AS N
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE nullif(o_orderstatus, 'O') <> 'P' GROUP BY ALL""",
    "q_rolling_year": f"""WITH {TICKETS}, {STRICT},
timed AS (
  SELECT * EXCLUDE PERIOD, CASE TYPE WHEN 'LE' THEN PERIOD ELSE LANDING_MONTH END AS PERIOD,
         CASE TYPE WHEN 'LE' THEN 4 ELSE 9 END AS cut FROM labelled
)
SELECT LANDING_YEAR, TYPE, PERIOD, {N_LBS} FROM timed
WHERE (LANDING_YEAR = 2000 AND PERIOD > cut) OR (LANDING_YEAR = 2001 AND PERIOD <= cut)
GROUP BY LANDING_YEAR, TYPE, PERIOD""",
    "q_complete_cases": f"""WITH {GAPPED}
SELECT AGENCY_CODE, PACFIN_CATCH_AREA_CODE, {N_LBS} FROM gapped
WHERE VESSEL_NUM IS NOT NULL AND AGENCY_CODE IS NOT NULL AND PACFIN_CATCH_AREA_CODE IS NOT NULL
  AND DAHL_GROUNDFISH_CODE IS NOT NULL AND ROUND_WEIGHT_LBS IS NOT NULL
  AND EXVESSEL_REVENUE IS NOT NULL
GROUP BY AGENCY_CODE, PACFIN_CATCH_AREA_CODE""",
    "q_filter_cond": f"""WITH {GAPPED}
SELECT {COMMON}, {N_LBS} FROM gapped
WHERE {COMMON} IN ({listing(NEARSHORE_NAMES)})
   OR ({COMMON} = '{SMALL_NAME}' AND ROUND_WEIGHT_LBS < {SMALL_BELOW})
GROUP BY {COMMON}""",
    "q_filter_species_area": f"""WITH {GAPPED},
kept AS (
  SELECT * FROM gapped WHERE {NOMINAL} <> 'PROMO'
  UNION ALL
  SELECT * FROM gapped
  WHERE {NOMINAL} = 'PROMO' AND CATCH_AREA_CODE <> '60A2' AND CATCH_AREA_CODE <> '61'
)
SELECT {NOMINAL}, CATCH_AREA_CODE, {N_LBS} FROM kept GROUP BY {NOMINAL}, CATCH_AREA_CODE""",
    "q_limit_full_join": f"""WITH {TICKETS},
landed AS (SELECT {PERIOD} AS PERIOD, sum(ROUND_WEIGHT_LBS) AS LBS FROM tickets GROUP BY ALL),
sq(PERIOD, TL_SQ) AS (VALUES (1, 100.0::DOUBLE), (2, 200.0::DOUBLE), (3, 300.0::DOUBLE)),
a1(PERIOD, TL_A1) AS (VALUES (3, 330.0::DOUBLE), (8, 880.0::DOUBLE))
SELECT CAST(PERIOD AS INTEGER) AS PERIOD, LBS, TL_SQ, TL_A1
FROM landed FULL JOIN sq USING (PERIOD) FULL JOIN a1 USING (PERIOD)""",
    "q_limit_inner_join": f"""WITH {TICKETS}, {VESSEL_PERIODS}
SELECT TYPE, PERIOD, 1800.0::DOUBLE AS TL_SQ, 3600.0::DOUBLE AS TL_A1, count(*) AS N,
       sum(tlbs) AS LBS
FROM vessel_periods WHERE TYPE = 'LE' AND PERIOD <= 5 GROUP BY TYPE, PERIOD""",
    "q_zone_limits": f"""{zones(PERIOD, "1")}
SELECT ZONE, P AS PERIOD, sq AS TL_SQ, l1 AS TL_A1, l2 AS TL_A2, l3 AS TL_A3, count(*) AS N,
       sum(tlbs) AS LBS
FROM limited GROUP BY ALL""",
    "q_year_ratio": f"""WITH {GAPPED},
complete AS (
  SELECT LANDING_YEAR, {AREA} AS AREA, {COMMON} AS SPECIES, LANDING_MONTH, ROUND_WEIGHT_LBS
  FROM gapped WHERE ROUND_WEIGHT_LBS IS NOT NULL AND {COMMON} IS NOT NULL
),
early AS (
  SELECT LANDING_YEAR, AREA, SPECIES, sum(ROUND_WEIGHT_LBS / {MT}) AS thru
  FROM complete WHERE LANDING_MONTH < 9 AND AREA IS NOT NULL GROUP BY ALL
),
whole AS (
  SELECT LANDING_YEAR, AREA, SPECIES, sum(ROUND_WEIGHT_LBS / {MT}) AS mt
  FROM complete WHERE AREA IS NOT NULL GROUP BY ALL
)
SELECT LANDING_YEAR, AREA, SPECIES, round(coalesce(thru, 0), 4) AS THRU_MT, round(mt, 4) AS MT,
       round(coalesce(thru, 0) / mt, 10) AS RATIO
FROM early RIGHT JOIN whole USING (LANDING_YEAR, AREA, SPECIES)""",
    "q_right_join_years": f"""WITH {GAPPED},
{years_frame(AREA, "gapped", "VESSEL_NUM,")},
x AS (SELECT * FROM yearly WHERE LANDING_YEAR = 1999),
y AS (SELECT * FROM yearly WHERE LANDING_YEAR = 2000),
z AS (SELECT * FROM yearly WHERE LANDING_YEAR = 2001)
SELECT z.VESSEL_NUM, z.AREA, z.SPECIES,
       round(coalesce(x.thru, 0), 4) AS THRU_x, round(coalesce(x.mt, 0), 4) AS MT_x,
       round(coalesce(y.thru, 0), 4) AS THRU_y, round(coalesce(y.mt, 0), 4) AS MT_y,
       round(coalesce(z.thru, 0), 4) AS THRU_z, round(coalesce(z.mt, 0), 4) AS MT_z
FROM z
LEFT JOIN y ON y.AREA IS NOT DISTINCT FROM z.AREA AND y.SPECIES IS NOT DISTINCT FROM z.SPECIES
  AND y.VESSEL_NUM IS NOT DISTINCT FROM z.VESSEL_NUM
LEFT JOIN x ON x.AREA IS NOT DISTINCT FROM y.AREA AND x.SPECIES IS NOT DISTINCT FROM y.SPECIES
  AND x.VESSEL_NUM IS NOT DISTINCT FROM y.VESSEL_NUM AND y.LANDING_YEAR IS NOT NULL""",
    "q_right_join": f"""WITH {GAPPED},
landed AS (
  SELECT VESSEL_NUM, sum(ROUND_WEIGHT_LBS / {MT}) AS mt FROM gapped
  WHERE {NOMINAL} = 'ECONOMY' AND LANDING_YEAR = 2001 AND {FLEET} = 'LE' AND {AREA} = 'S4010'
  GROUP BY VESSEL_NUM),
vessels AS (
  SELECT DISTINCT CASE WHEN s_suppkey % 10 <> 2 THEN CAST(s_suppkey AS VARCHAR) END AS VESSEL_NUM
  FROM supplier)
SELECT v.VESSEL_NUM, round(coalesce(mt, 0), 4) AS MT
FROM vessels v LEFT JOIN landed l ON l.VESSEL_NUM IS NOT DISTINCT FROM v.VESSEL_NUM""",
    "q_closest_year": f"""WITH {TICKETS},
{years_frame(AREA_DEFAULT, "tickets")},
x AS (SELECT *, thru / mt AS ratio FROM yearly WHERE LANDING_YEAR = 1999),
y AS (SELECT *, thru / mt AS ratio FROM yearly WHERE LANDING_YEAR = 2000),
z AS (SELECT * FROM yearly WHERE LANDING_YEAR = 2001),
sides AS (
  SELECT z.AREA, z.SPECIES, z.thru AS tz, z.mt AS mz, coalesce(y.thru, 0) AS ty,
         coalesce(y.ratio, 0) AS ry, coalesce(x.thru, 0) AS tx, coalesce(x.ratio, 0) AS rx
  FROM z LEFT JOIN y ON y.AREA = z.AREA AND y.SPECIES = z.SPECIES
  LEFT JOIN x ON x.AREA = y.AREA AND x.SPECIES = y.SPECIES
),
chosen AS (
  SELECT *, CASE WHEN abs(tz - ty) > abs(tz - tx) THEN rx ELSE ry END AS ratio FROM sides
),
estimated AS (
  SELECT *, CASE WHEN ratio <> 0 THEN greatest(mz, tz / ratio) END AS est FROM chosen
)
SELECT AREA, SPECIES, round(mz, 4) AS MT_z, round(est, 4) AS ESTIMATED_MT,
       CASE WHEN ratio = 0 AND tz > 0 THEN 1 ELSE 0 END AS ESTIMATED_MT_INFINITE
FROM estimated""",
    "q_vessel_totals": f"""WITH {GAPPED},
labelled AS (
  SELECT VESSEL_NUM, LANDING_YEAR, LANDING_MONTH, {FLEET} AS TYPE, {AREA} AS AREA,
         {PERIOD} AS P2, EXVESSEL_REVENUE, ROUND_WEIGHT_LBS
  FROM gapped WHERE {NOMINAL} = 'ECONOMY'
)
SELECT VESSEL_NUM, LANDING_YEAR, CASE TYPE WHEN 'LE' THEN P2 ELSE LANDING_MONTH END AS PERIOD,
       AREA, TYPE, CAST(coalesce(sum(EXVESSEL_REVENUE), 0) AS DOUBLE) AS exvessel,
       CAST(coalesce(sum(ROUND_WEIGHT_LBS), 0) AS DOUBLE) AS tlbs
FROM labelled WHERE VESSEL_NUM IS NOT NULL AND AREA IS NOT NULL AND TYPE IS NOT NULL
GROUP BY VESSEL_NUM, LANDING_YEAR, 3, AREA, TYPE""",
    "q_price_per_lb": f"""{PRICED}
SELECT VESSEL_NUM, LANDING_MONTH, PERIOD, SUBAREA, AREA, TYPE, SECTOR, LANDING_YEAR, SPPGROUP,
       exvessel, tlbs, price, infinite AS price_INFINITE
FROM priced""",
    "q_mean_price": f"""{PRICED}
SELECT PERIOD, SUBAREA, max(infinite) AS PRICE_INFINITE,
       CASE WHEN max(infinite) = 0 THEN round(avg(price), 4) END AS PRICE
FROM priced GROUP BY PERIOD, SUBAREA""",
    "q_aggregate_cc": f"""WITH {GAPPED}
SELECT LANDING_YEAR, VESSEL_NUM, {NOMINAL}, sum(LANDED_WEIGHT_LBS) AS LANDED_WEIGHT_LBS
FROM gapped
WHERE VESSEL_NUM IS NOT NULL AND {NOMINAL} IS NOT NULL AND LANDED_WEIGHT_LBS IS NOT NULL
GROUP BY LANDING_YEAR, VESSEL_NUM, {NOMINAL}""",
    "q_union_fleets": f"""WITH {TICKETS}, {STRICT}
SELECT TYPE, LANDING_YEAR, PERIOD, sum(ROUND_WEIGHT_LBS) AS LBS FROM labelled
WHERE TYPE = 'LE' GROUP BY ALL
UNION ALL
SELECT TYPE, LANDING_YEAR, LANDING_MONTH AS PERIOD, sum(ROUND_WEIGHT_LBS) AS LBS FROM labelled
WHERE TYPE = 'OA' GROUP BY ALL""",
    "q_distinct_species": f"WITH {GAPPED} SELECT DISTINCT {COMMON} FROM gapped",
    "q_sorted_landings": f"""WITH {TICKETS}
SELECT LANDING_YEAR, {AREA} AS AREA, {COMMON} AS SPECIES, sum(ROUND_WEIGHT_LBS) AS ROUND_WEIGHT_LBS
FROM tickets GROUP BY ALL ORDER BY 1, 2, 3""",
    "q_partial_month": f"""WITH {TICKETS}
SELECT LANDING_YEAR, LANDING_MONTH,
       round(sum(ROUND_WEIGHT_LBS * {FACTOR.format(source="tickets")}), 4) AS LBS,
       round(sum(CAST(EXVESSEL_REVENUE AS DOUBLE) * {FACTOR.format(source="tickets")}), 4) AS REVENUE
FROM tickets GROUP BY LANDING_YEAR, LANDING_MONTH""",
    "q_respond_raise": response(raised, 9000, 4500),
    "q_respond_cap": response(capped, 5000, 2500),
    "q_trip_pivot": f"""WITH {TRIPS}
SELECT LANDING_YEAR, LANDING_MONTH, CAST(trip_date AS VARCHAR) AS LANDING_DATE, VESSEL_NUM,
       ph AS PACIFIC_HALIBUT, sf AS SABLEFISH, round(ph * 0.88::DOUBLE, 4) AS PACIFIC_HALIBUT_NET
FROM all_trips""",
    "q_step_round": f"""WITH {TRIPS}, {stepped("all_trips")}
SELECT sf AS SABLEFISH, st AS STEPPED, count(*) AS N FROM stepped GROUP BY ALL""",
    "q_ratio_limit": f"""WITH {TRIPS}, {stepped("all_trips")}
SELECT LANDING_YEAR, LANDING_MONTH, CAST(trip_date AS VARCHAR) AS LANDING_DATE, VESSEL_NUM,
       ph AS PACIFIC_HALIBUT, sf AS SABLEFISH, st AS STEPPED, round(sq, 4) AS LIMIT_SQTL_200LBS,
       round(alt, 4) AS LIMIT_ALT1_250LBS, round(sq_lbs, 4) AS SQTL_200LBS,
       round(alt_lbs, 4) AS ALT1_250LBS
FROM responded WHERE ph > 0 AND sf > 0""",
    "q_month_profile": f"""WITH {TRIPS}
SELECT LANDING_YEAR, LANDING_MONTH, round(sum(ph * 0.88::DOUBLE), 4) AS PACIFIC_HALIBUT_NET
FROM season GROUP BY ALL""",
    "q_month_average": f"""WITH {TRIPS}
SELECT LANDING_MONTH, round(sum(ph * 0.88::DOUBLE) / 4, 4) AS PACIFIC_HALIBUT_NET
FROM season WHERE LANDING_YEAR > 1995 AND LANDING_YEAR < 2000 GROUP BY LANDING_MONTH""",
    "q_year_breakdown": f"""WITH {TRIPS}
SELECT LANDING_YEAR, round(sum(ph * 0.88::DOUBLE), 4) AS PACIFIC_HALIBUT_NET
FROM season WHERE LANDING_YEAR > 1995 AND LANDING_YEAR < 2000 GROUP BY LANDING_YEAR""",
    "q_year_to_date": f"""WITH {TRIPS},
parts AS (
  SELECT LANDING_YEAR AS y, ph AS so_far, 0 AS rest FROM season WHERE LANDING_MONTH < 9
  UNION ALL
  SELECT LANDING_YEAR + 1, 0, ph FROM season WHERE LANDING_MONTH > 8
)
SELECT CAST(y AS INTEGER) AS LANDING_YEAR, CAST(sum(so_far) AS DOUBLE) AS SO_FAR_LBS,
       CAST(sum(rest) AS DOUBLE) AS REST_LBS,
       round((sum(so_far) + sum(rest)) * 0.88::DOUBLE, 4) AS NET_LBS
FROM parts GROUP BY y""",
    "q_model_lingcod": f"""{LINGCOD},
projected AS (
  SELECT TYPE, sum(tlbs / {MT}) AS sq, sum(a1 / {MT}) AS m1, sum(a2 / {MT}) AS m2,
         sum(a3 / {MT}) AS m3, {per_ton("OR")} AS c
  FROM responded GROUP BY TYPE
)
SELECT TYPE, round(sq, 4) AS SQ_MT, round(m1, 4) AS A1_MT, round(m2, 4) AS A2_MT,
       round(m3, 4) AS A3_MT, round(sq * c, 4) AS SQ_YEYE_MT, round(m1 * c, 4) AS ALT1_YEYE_MT,
       round(m2 * c, 4) AS ALT2_YEYE_MT, round(m3 * c, 4) AS ALT3_YEYE_MT,
       round(m1 * c - sq * c, 4) AS Extra_YEYE_ALT1, round(m2 * c - sq * c, 4) AS Extra_YEYE_ALT2,
       round(m3 * c - sq * c, 4) AS Extra_YEYE_ALT3
FROM projected""",
    "q_in_season": f"""{LINGCOD},
projected AS (
  SELECT TYPE, SECTOR, sum(tlbs / {MT}) AS sq, sum(a1 / {MT}) AS m1, sum(a2 / {MT}) AS m2,
         sum(a3 / {MT}) AS m3, sum(CASE WHEN PERIOD > cut THEN a1 ELSE tlbs END / {MT}) AS i1,
         sum(CASE WHEN PERIOD > cut THEN a2 ELSE tlbs END / {MT}) AS i2,
         sum(CASE WHEN PERIOD > cut THEN a3 ELSE tlbs END / {MT}) AS i3, {per_ton("OR")} AS c
  FROM responded GROUP BY TYPE, SECTOR
)
SELECT TYPE, SECTOR, round(sq, 4) AS P_SQ_MT, round(m1, 4) AS P_A1_MT, round(m2, 4) AS P_A2_MT,
       round(m3, 4) AS P_A3_MT, round(i1, 4) AS INS_A1_MT, round(i2, 4) AS INS_A2_MT,
       round(i3, 4) AS INS_A3_MT, round(sq * c, 4) AS SQ_YEYE_MT, round(m1 * c, 4) AS ALT1_YEYE_MT,
       round(m2 * c, 4) AS ALT2_YEYE_MT, round(m3 * c, 4) AS ALT3_YEYE_MT,
       round(i1 * c, 4) AS INS_ALT1_YEYE_MT, round(i2 * c, 4) AS INS_ALT2_YEYE_MT,
       round(i3 * c, 4) AS INS_ALT3_YEYE_MT, round((m1 - sq) * c, 4) AS Extra_YEYE_ALT1,
       round((m2 - sq) * c, 4) AS Extra_YEYE_ALT2, round((m3 - sq) * c, 4) AS Extra_YEYE_ALT3,
       round((i1 - sq) * c, 4) AS Extra_INS_YEYE_ALT1,
       round((i2 - sq) * c, 4) AS Extra_INS_YEYE_ALT2,
       round((i3 - sq) * c, 4) AS Extra_INS_YEYE_ALT3
FROM projected""",
    "q_bycatch": f"""WITH {TICKETS}, {VESSEL_PERIODS},
projected AS (
  SELECT TYPE, LANDING_YEAR, sum(tlbs / {MT}) AS mt FROM vessel_periods GROUP BY ALL
)
SELECT TYPE, LANDING_YEAR, round(mt, 6) AS SQ_MT, round(mt * {per_ton("OR")}, 6) AS OR_MT,
       round(mt * {per_ton("ncal")}, 6) AS NCAL_MT,
       round(mt * {per_ton("ncal")} - mt * {per_ton("OR")}, 6) AS EXTRA_MT
FROM projected""",
    "q_model_pop": f"""WITH {TICKETS}, {STRICT},
totals AS (
  SELECT VESSEL_NUM, PERIOD, TYPE, LANDING_YEAR,
         {completed("ROUND_WEIGHT_LBS", "tickets")} AS tlbs, 1800.0::DOUBLE AS sq
  FROM labelled
  WHERE {NOMINAL} = 'ECONOMY' AND AREA = 'N4010' AND LANDING_YEAR = 2001 AND TYPE = 'LE'
  GROUP BY VESSEL_NUM, PERIOD, TYPE, LANDING_YEAR
)
SELECT LANDING_YEAR, TYPE, {tons("tlbs", "P_SQMT")},
       {tons(raised("3600.0::DOUBLE", "0.9"), "P_A1_MT")}
FROM totals GROUP BY LANDING_YEAR, TYPE""",
    "q_model_yellowtail": f"""WITH {TICKETS}, {STRICT},
totals AS (
  SELECT VESSEL_NUM, LANDING_MONTH, TYPE, sum(ROUND_WEIGHT_LBS) AS tlbs,
         CASE TYPE WHEN 'LE' THEN 3000.0::DOUBLE ELSE 1500.0::DOUBLE END AS sq,
         CASE TYPE WHEN 'LE' THEN 4500.0::DOUBLE ELSE 2500.0::DOUBLE END AS alt
  FROM labelled
  WHERE {NOMINAL} = 'ECONOMY' AND AREA = 'N4010' AND LANDING_YEAR = 2001 AND LANDING_MONTH < 6
    AND TYPE IS NOT NULL
  GROUP BY VESSEL_NUM, LANDING_MONTH, TYPE
)
SELECT LANDING_MONTH, TYPE, {tons("tlbs", "P_SQMT")}, {tons(raised("alt", "0.7"), "P_A1_MT")}
FROM totals GROUP BY LANDING_MONTH, TYPE""",
    "q_model_shelf": shelf("""AREA = 'N4010' AND (LANDING_YEAR = 2000 AND LANDING_MONTH > 10
                            OR LANDING_YEAR = 2001 AND LANDING_MONTH < 11)"""),
    "q_model_shelf_all": shelf("AREA IS NOT NULL AND LANDING_YEAR IN (2000, 2001)"),
    "q_widow_shelf": f"""WITH {TICKETS}, {STRICT},
scaled AS (
  SELECT * FROM labelled
  WHERE LANDING_YEAR = 2001 AND {NOMINAL} IN ('LARGE', 'SMALL', 'MEDIUM')
    AND TYPE IS NOT NULL AND AREA IS NOT NULL
),
grouped AS (
  SELECT *, 'WIDOW&SHELF' AS g FROM scaled
  UNION ALL SELECT *, CASE {NOMINAL} WHEN 'LARGE' THEN 'WIDOW' ELSE 'SHELF' END FROM scaled
),
totals AS (
  SELECT VESSEL_NUM, LANDING_MONTH, AREA, TYPE, LANDING_YEAR, g,
         {completed("ROUND_WEIGHT_LBS", "tickets")} AS tlbs,
         200.0::DOUBLE AS sq, CASE TYPE WHEN 'LE' THEN 4000.0::DOUBLE ELSE 2000.0::DOUBLE END AS lw
  FROM grouped GROUP BY VESSEL_NUM, LANDING_MONTH, AREA, TYPE, LANDING_YEAR, g
)
SELECT TYPE, LANDING_YEAR, AREA,
       round(sum(CASE WHEN g = 'WIDOW' THEN tlbs ELSE 0 END / {MT}), 4) AS P_SQMT_Widow,
       round(sum(CASE WHEN g = 'WIDOW&SHELF' THEN least(tlbs, 200.0::DOUBLE) ELSE 0 END / {MT}), 4)
         AS P_SQMT_Shelf,
       round(sum(CASE WHEN g = 'WIDOW' THEN {raised("lw", "0.9")} ELSE 0 END / {MT}), 4) AS P_WIDOW_MT,
       round(sum(CASE WHEN g = 'SHELF' THEN {raised("200.0::DOUBLE", "0.9")} ELSE 0 END / {MT}), 4)
         AS P_SHELF_MT
FROM totals GROUP BY TYPE, LANDING_YEAR, AREA""",
    "q_ns_landings": f"""WITH {GAPPED},
complete AS (
  SELECT * FROM gapped
  WHERE LANDING_YEAR = 2001 AND code IN (5, 6) AND AGENCY_CODE IS NOT NULL
    AND PACFIN_CATCH_AREA_CODE IS NOT NULL AND REGION_NAME IS NOT NULL
    AND SUBREGION_NAME IS NOT NULL AND {COMMON} IS NOT NULL AND ROUND_WEIGHT_LBS IS NOT NULL
    AND EXVESSEL_REVENUE IS NOT NULL
),
scaled AS (
  SELECT *, ROUND_WEIGHT_LBS * {FACTOR.format(source="complete")} AS lbs,
         CAST(EXVESSEL_REVENUE AS DOUBLE) * {FACTOR.format(source="complete")} AS revenue
  FROM complete
),
kept AS (
  SELECT * FROM scaled WHERE {COMMON} IN ({listing(NEARSHORE_NAMES)})
  UNION ALL SELECT * FROM scaled WHERE {COMMON} = '{SMALL_NAME}' AND lbs < {SMALL_BELOW}
),
labelled AS (
  SELECT *, {AREA} AS AREA, {SUBAREA_PORT} AS SUBAREA, {COMMON} AS SPECIES,
         {SPECIES_RULES} AS SPPGROUP FROM kept
)
SELECT AGENCY_CODE, AREA, SUBAREA, SPECIES, SPPGROUP, {tons("lbs", "P_SQMT")},
       round(sum(revenue), 4) AS P_EXVESSEL
FROM labelled GROUP BY AGENCY_CODE, AREA, SUBAREA, SPECIES, SPPGROUP""",
    "q_model_zones": zone_model(PERIOD, "1"),
    "q_model_zones_monthly": zone_model(BY_FLEET, "LANDING_MONTH"),
    "q_model_zones_monthly_limits": zone_model(BY_FLEET, "1", oa=(50, 25, 20), periods=12),
    "q_model_ratio": f"""WITH {TRIPS}, {stepped("season")},
rest AS (
  SELECT coalesce(sum(sq_lbs), 0) AS sq, coalesce(sum(alt_lbs), 0) AS alt FROM responded
  WHERE LANDING_YEAR = 2000 AND LANDING_MONTH > 6 AND ph > 0 AND sf > 0
),
so_far AS (
  SELECT coalesce(sum(ph), 0) AS ph FROM season WHERE LANDING_YEAR = 2001 AND LANDING_MONTH <= 6
)
SELECT 2001 AS LANDING_YEAR, round(ph, 4) AS SO_FAR_LBS, round(sq, 4) AS SQTL_200LBS_REST_LBS,
       round(alt, 4) AS ALT1_250LBS_REST_LBS,
       round((ph + sq) * 0.88::DOUBLE, 4) AS SQTL_200LBS_NET_LBS,
       round((ph + alt) * 0.88::DOUBLE, 4) AS ALT1_250LBS_NET_LBS
FROM rest, so_far""",
}


ORACLE["q_result_text"] = f"""SELECT LANDING_MONTH, TYPE, {fixed_text("P_SQMT")}, {fixed_text("P_A1_MT")}
FROM ({ORACLE["q_model_yellowtail"]})"""

ORACLE["q_result_numbered"] = f"""WITH {GAPPED},
landed AS (
  SELECT LANDING_YEAR, VESSEL_NUM, {PERIOD} AS PERIOD, {FLEET} AS TYPE,
         round(coalesce(sum(ROUND_WEIGHT_LBS), 0), 4) AS LBS FROM gapped GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY LANDING_YEAR, VESSEL_NUM NULLS LAST, PERIOD, TYPE NULLS LAST) AS ROW FROM landed"""

ORACLE["q_result_file"] = f"""WITH {GAPPED},
landed AS (
  SELECT LANDING_YEAR, {AREA} AS AREA, {COMMON} AS SPECIES, coalesce(sum(ROUND_WEIGHT_LBS), 0) AS ROUND_WEIGHT_LBS
  FROM gapped GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (ORDER BY LANDING_YEAR, AREA NULLS LAST, SPECIES NULLS LAST) AS place FROM landed)
SELECT * EXCLUDE place, place AS ROW, place AS PLACE FROM placed"""

ORACLE["q_append_unlike"] = f"""WITH {GAPPED},
labelled AS (SELECT *, {FLEET} AS TYPE, {AREA} AS AREA FROM gapped),
appended AS (
  SELECT 'LE' AS PART, TYPE, LANDING_YEAR, {PERIOD} AS PERIOD, CAST(NULL AS INTEGER) AS MONTH,
         CAST(NULL AS VARCHAR) AS VESSEL_NUM, CAST(NULL AS VARCHAR) AS AREA, ROUND_WEIGHT_LBS FROM labelled WHERE TYPE = 'LE'
  UNION ALL BY NAME SELECT 'OA' AS PART, TYPE, LANDING_YEAR, LANDING_MONTH AS MONTH, VESSEL_NUM, ROUND_WEIGHT_LBS
  FROM labelled WHERE TYPE = 'OA'
  UNION ALL BY NAME SELECT 'SMALL' AS PART, TYPE, LANDING_YEAR, AREA, ROUND_WEIGHT_LBS
  FROM labelled WHERE ROUND_WEIGHT_LBS < {SMALL_BELOW})
SELECT PART, TYPE, LANDING_YEAR, PERIOD, MONTH, VESSEL_NUM, AREA, {N_LBS} FROM appended GROUP BY ALL"""

ORACLE["q_tickets_csv"] = f"""SELECT * EXCLUDE (l_linenumber) REPLACE (
  CASE l_linenumber WHEN 1 THEN PACFIN_SPECIES_COMMON_NAME || ', "fresh"'
    WHEN 2 THEN '"' || PACFIN_SPECIES_COMMON_NAME || '" \\, frozen' WHEN 3 THEN ''
    ELSE PACFIN_SPECIES_COMMON_NAME END AS PACFIN_SPECIES_COMMON_NAME)
FROM ({ORACLE["q_tickets_conform"].replace("(l_linenumber, ", "(", 1)})"""

ORACLE["q_csv_malformed"] = f"""WITH {TICKETS},
records AS (
  SELECT CASE WHEN l_linenumber IN (6, 7) THEN 1 ELSE 0 END AS MALFORMED, LANDING_YEAR, l_linenumber, ROUND_WEIGHT_LBS FROM tickets)
SELECT MALFORMED, CASE WHEN MALFORMED = 0 THEN LANDING_YEAR END AS LANDING_YEAR, count(*) AS N,
       round(coalesce(sum(CASE WHEN l_linenumber < 5 THEN ROUND_WEIGHT_LBS END), 0), 4) AS LBS
FROM records GROUP BY ALL"""

for _name in ("month_profile", "month_gross", "month_average", "year_breakdown", "year_to_date", "model_ratio"):
    ORACLE[f"q_stored_{_name}"] = ORACLE[f"q_{_name}"]

ORACLE["q_completed_rows"] = f"""WITH {GAPPED},
whole AS (SELECT *, ROUND_WEIGHT_LBS * {FACTOR.format(source="gapped")} AS lbs FROM gapped)
SELECT VESSEL_NUM, {NOMINAL}, LANDING_YEAR, count(*) AS N, round(sum(lbs), 4) AS LBS
FROM whole WHERE lbs < {SMALL_BELOW} GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
