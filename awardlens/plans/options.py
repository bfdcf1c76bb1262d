"""Values a user can filter the funding reports by."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sectors import sector_name
from ..operators.keys import distinct_values
from .funding import YEAR


def year_options(rows: DataFrame) -> DataFrame:
    """Fiscal years present, ascending."""
    return distinct_values(rows, YEAR)


def sector_lookup(rows: DataFrame) -> DataFrame:
    """Each NAICS code present with its sector name."""
    return distinct_values(rows, "naics_code").withColumn(
        "sector_name", sector_name(F.col("naics_code"))
    )


def sector_options(rows: DataFrame) -> DataFrame:
    """Sector names present, ascending. Rows without a code match no sector filter, so
    they offer no option either."""
    codes = rows.select("naics_code").distinct()
    names = codes.select(sector_name(F.col("naics_code")).alias("sector_name"))
    return names.filter(F.col("sector_name").isNotNull()).distinct().orderBy("sector_name")


def default_sectors(rows: DataFrame, n: int = 5) -> DataFrame:
    """Sector names of the ``n`` lowest NAICS codes; a name may repeat."""
    codes = rows.select("naics_code").filter(F.col("naics_code").isNotNull()).distinct()
    return (
        codes.orderBy("naics_code")
        .limit(n)
        .withColumn("sector_name", sector_name(F.col("naics_code")))
    )
