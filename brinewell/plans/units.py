"""Problem 4: readings in common units, and unit changes inside source histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.units import reversed_values, to_common_units, unit_shifts
from ..sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    readings = table(spark, folder, "observations").where(F.col("measurement") > 0).select("obs_id", "survey_code", "measurement", "unit", "remarks")
    out = to_common_units(readings, table(spark, folder, "surveys"), table(spark, folder, "quantity_units"))
    already = (F.col("unit_from") == "unit") & (F.col("unit") == F.col("common_unit"))
    return out.where(F.col("quantity").isNotNull() & ~already).select(
        "obs_id", "quantity", F.floor(10 * F.log10("common_value")).cast("int").alias("log_step")
    )


def p4_unit_shifts(spark: SparkSession, folder: str) -> DataFrame:
    """Level shifts in the histories of readings as recorded, with the unit factor each one matches."""
    rows = table(spark, folder, "observations").select("survey_code", "loaded_at", "obs_id", "measurement")
    return unit_shifts(rows, "survey_code", ["loaded_at"], "obs_id", "measurement")


def p4_reversed(spark: SparkSession, folder: str) -> DataFrame:
    """Every positive reading with the matched shifts of its survey's history taken back."""
    rows = table(spark, folder, "observations").select("survey_code", "loaded_at", "obs_id", "measurement")
    return reversed_values(rows, "survey_code", ["loaded_at"], "obs_id", "measurement")


QUERIES = {"p4_found": p4_found, "p4_unit_shifts": p4_unit_shifts, "p4_reversed": p4_reversed}
ORACLES: dict[str, str] = {}
