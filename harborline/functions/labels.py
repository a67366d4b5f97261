"""Labels derived from ticket codes.

Two families exist on purpose. The strict ones give null to codes they do not list.
The ``*_or_default`` ones give every other known code a default label and keep null
only for a missing code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborline.functions.semantics import ColumnOrName, as_column, if_known, lookup

# Two-digit codes of the groundfish sectors.
LIMITED_ENTRY_CODES = ("05", "07", "09")
OPEN_ACCESS_CODES = ("06", "08", "10")
NEARSHORE_CODES = ("05", "06")
NON_NEARSHORE_CODES = ("07", "08", "09", "10")
GROUNDFISH_CODES = ("05", "06", "07", "08", "09", "10")
FLEET_CODES = {"LE": LIMITED_ENTRY_CODES, "OA": OPEN_ACCESS_CODES}
# Agencies and catch areas.
NORTHERN_AGENCIES = ("O", "W")
AREA_4010_TO_42 = "1C"
AREAS_SOUTH_OF_4010 = ("1A", "1B")


def sector_code(code: ColumnOrName) -> Column:
    """Code as two digits: readers that guess types turn "05" into 5. Longer codes stay whole."""
    text = F.trim(as_column(code).cast("string"))
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def _spellings(labels: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Label of each code, with and without its leading zero."""
    return {s: label for label, codes in labels.items() for c in codes for s in (c, c.lstrip("0"))}


def label_of_code(code: ColumnOrName, labels: Mapping[str, Sequence[str]]) -> Column:
    return lookup(_spellings(labels), F.trim(as_column(code).cast("string")))


def has_code(code: ColumnOrName, *codes: str, normalised: bool = False) -> Column:
    """Whether a code is one of those listed, with or without its leading zero.

    A ``normalised`` column holds two digits and no blanks. It is compared as it is, so that the test reaches
    its scan or database, where otherwise the trimming hides the column.
    """
    if normalised:
        return as_column(code).isin(*codes)
    return F.trim(as_column(code).cast("string")).isin(*_spellings({"": codes}))


def period(month: ColumnOrName = "LANDING_MONTH") -> Column:
    """Two-month period 1..6."""
    return F.ceil(as_column(month) / 2).cast("int")


def fleet(code: ColumnOrName = "DAHL_GROUNDFISH_CODE") -> Column:
    return label_of_code(code, FLEET_CODES)


def fleet_or_default(code: ColumnOrName = "DAHL_GROUNDFISH_CODE") -> Column:
    known = label_of_code(code, {"LE": LIMITED_ENTRY_CODES})
    return F.when(as_column(code).isNotNull(), F.coalesce(known, F.lit("OA")))


def sector(code: ColumnOrName = "DAHL_GROUNDFISH_CODE") -> Column:
    return label_of_code(code, {"NS": NEARSHORE_CODES, "NON-NS": NON_NEARSHORE_CODES})


def nearshore_only(code: ColumnOrName = "DAHL_GROUNDFISH_CODE") -> Column:
    return F.when(has_code(code, *NEARSHORE_CODES), "NS")


def sector_by_state(
    code: ColumnOrName = "DAHL_GROUNDFISH_CODE", agency: ColumnOrName = "AGENCY_CODE"
) -> Column:
    nearshore_state = if_known(as_column(agency) == "O", "OR_NS", "CAL_NS", [agency])
    return if_known(has_code(code, *NON_NEARSHORE_CODES), "NON_NS", nearshore_state, [code])


def area(
    agency: ColumnOrName = "AGENCY_CODE", catch_area: ColumnOrName = "PACFIN_CATCH_AREA_CODE"
) -> Column:
    agency = as_column(agency)
    california = if_known(
        as_column(catch_area) == AREA_4010_TO_42, "N4010", "S4010", [catch_area]
    )
    return F.when(agency.isin(*NORTHERN_AGENCIES), "N4010").when(agency == "C", california)


def area_or_default(
    agency: ColumnOrName = "AGENCY_CODE", catch_area: ColumnOrName = "PACFIN_CATCH_AREA_CODE"
) -> Column:
    by_catch_area = if_known(
        as_column(catch_area) == AREA_4010_TO_42, "N4010", "S4010", [catch_area]
    )
    north = as_column(agency).isin(*NORTHERN_AGENCIES)
    return if_known(north, "N4010", by_catch_area, [agency])


def subarea(
    agency: ColumnOrName = "AGENCY_CODE", catch_area: ColumnOrName = "PACFIN_CATCH_AREA_CODE"
) -> Column:
    by_catch_area = if_known(
        as_column(catch_area) == AREA_4010_TO_42, "4010_42", "S4010", [catch_area]
    )
    north = as_column(agency).isin(*NORTHERN_AGENCIES)
    return if_known(north, "N42", by_catch_area, [agency])


def subarea_by_stock(
    agency: ColumnOrName = "AGENCY_CODE",
    catch_area: ColumnOrName = "PACFIN_CATCH_AREA_CODE",
    stock: ColumnOrName = "ACL_CODE",
) -> Column:
    """Four bands; the southern stock code overrides the other three."""
    agency, catch_area, stock = as_column(agency), as_column(catch_area), as_column(stock)
    california = agency == "C"
    return (
        F.when(stock == "SSPN_S", "South of 3427")
        .when(
            california & catch_area.isin(*AREAS_SOUTH_OF_4010) & (stock == "SSPN_N"), "3427-4010"
        )
        .when(california & (catch_area == AREA_4010_TO_42), "4010-42")
        .when(agency.isin(*NORTHERN_AGENCIES), "N42")
    )


def subarea_by_port(
    region: ColumnOrName = "REGION_NAME", subregion: ColumnOrName = "SUBREGION_NAME"
) -> Column:
    south = (as_column(region) == "SOUTH CALIFORNIA") & (
        as_column(subregion) != "SAN LUIS OBISPO"
    )
    return F.when(south, "S3427").otherwise("N3427")


def species_group(species: ColumnOrName, members: Sequence[str], group: str) -> Column:
    """``group`` for the listed species, null for all others."""
    return F.when(as_column(species).isin(*members), group)


def species_group_or_blank(species: ColumnOrName, members: Sequence[str], group: str) -> Column:
    return if_known(as_column(species).isin(*members), group, "", [species])


@dataclass(frozen=True)
class GroupRule:
    """Members of a species group, optionally for the tickets of one agency only."""

    group: str
    members: tuple[str, ...]
    agency: str | None = None


def species_group_by_rules(
    species: ColumnOrName, agency: ColumnOrName, rules: Sequence[GroupRule]
) -> Column:
    """The species itself, overridden by each rule in turn, so that the last match wins.

    A rule bound to an agency is unknown, and its label missing, when the agency of a
    listed species is missing.
    """
    species, agency = as_column(species), as_column(agency)
    # The last rule is tested first; the label of an earlier one is only looked at below.
    branches = []
    for rule in reversed(rules):
        listed = species.isin(*rule.members)
        if rule.agency is None:
            branches.append((listed, F.lit(rule.group)))
        else:
            branches.append((listed & (agency == rule.agency), F.lit(rule.group)))
            branches.append((listed & agency.isNull(), F.lit(None).cast("string")))
    chain = F
    for test, label in branches:
        chain = chain.when(test, label)
    return chain.otherwise(species) if branches else species
