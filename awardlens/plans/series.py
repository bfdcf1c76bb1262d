"""Chart-ready series: long tables of (panel, series, year, value)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .funding import YEAR

# Which report column is drawn in which panel, under which label.
FUNDING_PANELS = {
    "total_obligated": ("Total Funding Over Time", "Total Obligated"),
    "total_outlayed": ("Total Funding Over Time", "Total Outlayed"),
    "federal_obligation": ("Total Funding Over Time", "Federal Obligation"),
    "number_of_awards": ("Number of Awards Over Time", "Awards"),
    "average_obligated_per_award": ("Average Obligated per Award", "Avg Obligated"),
    "yoy_change_percent": ("Year-over-Year Change (%)", "YoY Change"),
}
SECTOR_PANELS = {
    "total_funding": "Total Funding by Sector",
    "number_of_awards": "Number of Awards by Sector",
    "average_funding_per_award": "Average Funding per Award",
}
AWARD_TYPE_PANELS = {
    "award_count": "Award Counts by Type",
    "total_funding": "Award Funding by Type",
}


def column_label(column: Column) -> Column:
    """``total_obligated`` -> ``Total Obligated``."""
    return F.initcap(F.replace(column, F.lit("_"), F.lit(" ")))


def _long(report: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    as_double = {name: F.col(name).cast("double") for name in columns}
    return report.withColumns(as_double).unpivot(ids, columns, "measure", "value")


def _lookup(texts: dict[str, str], key: str) -> Column:
    pairs = F.create_map(*[F.lit(text) for pair in texts.items() for text in pair])
    return F.element_at(pairs, F.col(key))


def funding_series(trends: DataFrame) -> DataFrame:
    """The lines and bars of the funding-trends chart."""
    panels = {name: panel for name, (panel, _) in FUNDING_PANELS.items()}
    labels = {name: label for name, (_, label) in FUNDING_PANELS.items()}
    return _long(trends, [YEAR], list(FUNDING_PANELS)).select(
        _lookup(panels, "measure").alias("panel"),
        _lookup(labels, "measure").alias("series"),
        YEAR,
        "value",
    )


def dollar_series(trends: DataFrame) -> DataFrame:
    """The three dollar totals as lines, labelled by their column names."""
    columns = ["total_obligated", "total_outlayed", "federal_obligation"]
    return _long(trends, [YEAR], columns).select(
        column_label(F.col("measure")).alias("series"), YEAR, "value"
    )


def sector_series(sectors: DataFrame) -> DataFrame:
    """Stacked bars per sector: groups of one sector and year add up."""
    return _stacked(sectors, "sector_name", SECTOR_PANELS)


def award_type_series(types: DataFrame) -> DataFrame:
    """Stacked bars per award type; rows without a type are not drawn."""
    return _stacked(types, "award_type", AWARD_TYPE_PANELS)


def _stacked(report: DataFrame, series: str, panels: dict[str, str]) -> DataFrame:
    sums = (
        report.filter(F.col(series).isNotNull())
        .groupBy(series, YEAR)
        .agg(*(F.sum(name).alias(name) for name in panels))
    )
    return _long(sums, [series, YEAR], list(panels)).select(
        _lookup(panels, "measure").alias("panel"), F.col(series).alias("series"), YEAR, "value"
    )
