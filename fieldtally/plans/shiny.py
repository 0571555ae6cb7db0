"""Rate report over the monthly per-user table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.predicates import parse_csv, where_in


def _lowered(csv: str | None) -> list[str] | None:
    if isinstance(csv, str) and csv.strip().lower() == "global":
        return None
    values = parse_csv(csv)
    return None if values is None else [v.lower() for v in values]


def shiny_rates(
    months: DataFrame, start_yymm: int, end_yymm: int, area_id: int | None = None, users: str | None = None,
    species: str | None = None, forms: str | None = None, min_user_n: int = 0, limit: int = 0,
) -> DataFrame:
    """Per species and form: mean of the users' rates, pooled rate, users, encounters.

    The minimum per user applies to the user's sum over all months. Users and forms are matched
    without regard to case.
    """
    rows = months.where(F.col("month_year").between(start_yymm, end_yymm))
    if area_id is not None:
        rows = rows.where(F.col("area_id") == area_id)
    if _lowered(species) is not None:
        rows = where_in(rows, "species", species)
    for col, csv in (("username", users), ("form", forms)):
        values = _lowered(csv)
        if values is not None:
            rows = rows.where(F.lower(col).isin(values))
    shiny_n = F.sum(F.when(F.col("shiny") == 1, F.col("total_count")).otherwise(0))
    per_user = rows.groupBy("species", "form", "username").agg(
        F.sum("total_count").alias("n"), shiny_n.alias("shiny_n")
    )
    if min_user_n > 0:
        per_user = per_user.where(F.col("n") >= min_user_n)
    n, hits = F.col("n"), F.col("shiny_n")
    rates = per_user.where(n > 0).groupBy("species", "form").agg(
        F.round(F.avg(hits / n) * 100, 4).alias("shiny_pct_macro"),
        F.round(F.sum(hits) / F.sum(n) * 100, 4).alias("shiny_pct_pooled"),
        F.count("*").alias("users_contributing"),
        F.sum(n).alias("total_encounters"),
    )
    ordered = rates.orderBy("species", "form", F.desc("shiny_pct_macro"))
    return ordered.limit(limit) if limit > 0 else ordered


def shiny_summary(rates: DataFrame) -> DataFrame:
    """One row: species rows, rows with a positive pooled rate, encounters."""
    return rates.agg(
        F.count("*").alias("species_rows"),
        F.count_if(F.col("shiny_pct_pooled") > 0).alias("shiny_eligible"),
        F.coalesce(F.sum("total_encounters"), F.lit(0)).alias("total_encounters"),
    )
