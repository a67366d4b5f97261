"""Trip-limit tables and the joins that attach them to landings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.operators.tables import parameter_table

PERIODS_PER_YEAR = {"month": 12, "two_month": 6}
STATUS_QUO = "SQ"


@dataclass(frozen=True)
class LimitSchedule:
    """Limits of one fleet or zone.

    ``pounds`` maps a scenario to one number for every period, to a sequence with one
    number per period, or to a mapping for the periods that have a limit at all.
    """

    label: str
    grain: str
    pounds: Mapping[str, float | Sequence[float] | Mapping[int, float]] = field(hash=False)

    def by_period(self, scenario: str) -> dict[int, float]:
        periods = range(1, PERIODS_PER_YEAR[self.grain] + 1)
        value = self.pounds.get(scenario, {})
        if isinstance(value, Mapping):
            unknown = sorted(set(value) - set(periods))
            if unknown:
                raise ValueError(f"{self.label}: no {self.grain} period {unknown}")
            return {p: float(v) for p, v in value.items()}
        if isinstance(value, Sequence):
            if len(value) != len(periods):
                raise ValueError(
                    f"{self.label}/{scenario}: {len(value)} limits for {len(periods)} periods"
                )
            return {p: float(v) for p, v in zip(periods, value)}
        return {p: float(value) for p in periods}


def scenarios_of(schedules: Sequence[LimitSchedule]) -> list[str]:
    names = dict.fromkeys(name for s in schedules for name in s.pounds)
    return sorted(names, key=lambda name: (name != STATUS_QUO, name))


def check_grain(schedules: Sequence[LimitSchedule], grains: Mapping[str, str]) -> None:
    """Two-month pounds against monthly limits give plausible but wrong numbers: refuse."""
    for s in schedules:
        if s.label in grains and grains[s.label] != s.grain:
            raise ValueError(
                f"{s.label}: landings by {grains[s.label]} against limits by {s.grain}"
            )


def limit_table(
    spark: SparkSession, schedules: Sequence[LimitSchedule], label: str = "TYPE"
) -> DataFrame:
    """Long form: one row per label, period and scenario."""
    schema = T.StructType(
        [
            T.StructField(label, T.StringType(), False),
            T.StructField("GRAIN", T.StringType(), False),
            T.StructField("PERIOD", T.IntegerType(), False),
            T.StructField("SCENARIO", T.StringType(), False),
            T.StructField("LIMIT_LBS", T.DoubleType(), False),
        ]
    )
    rows = [
        (s.label, s.grain, p, scenario, lbs)
        for s in schedules
        for scenario in scenarios_of([s])
        for p, lbs in sorted(s.by_period(scenario).items())
    ]
    return parameter_table(spark, schema, rows)


def limits_side_by_side(
    spark: SparkSession, schedules: Sequence[LimitSchedule], label: str = "TYPE"
) -> DataFrame:
    """Wide form: one row per label and period with ``TL_<scenario>`` columns.

    A period listed by any scenario is kept; scenarios without a limit there are null.
    """
    names = scenarios_of(schedules)
    schema = T.StructType(
        [T.StructField(label, T.StringType(), False), T.StructField("PERIOD", T.IntegerType(), False)]
        + [T.StructField(f"TL_{name}", T.DoubleType(), True) for name in names]
    )
    rows = []
    for s in schedules:
        columns = [s.by_period(name) for name in names]
        for p in sorted(set().union(*columns)):
            rows.append((s.label, p, *(c.get(p) for c in columns)))
    return parameter_table(spark, schema, rows)


def widen_limits(long: DataFrame, scenarios: Sequence[str], label: str = "TYPE") -> DataFrame:
    """The wide form of a long limit table that comes from a file: a full outer merge of
    the scenarios on the period, done as one aggregation."""
    return long.groupBy(label, "PERIOD").agg(
        *(
            F.max(F.when(F.col("SCENARIO") == name, F.col("LIMIT_LBS"))).alias(f"TL_{name}")
            for name in scenarios
        )
    )


def full_outer_chain(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Merge separate limit tables on their keys, keeping every key of each."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.join(frame, list(on), "full")
    return merged


def attach_limits(
    totals: DataFrame, limits: DataFrame, on: Sequence[str] = ("PERIOD", "TYPE")
) -> DataFrame:
    """Inner join: landings of a fleet or period without a limit drop out."""
    return totals.join(limits, list(on), "inner")
