"""Industry sector of a NAICS code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two-digit NAICS sectors and their names.
SECTOR_NAMES = {
    "11": "Agriculture, Forestry, Fishing and Hunting",
    "21": "Mining, Quarrying, and Oil and Gas Extraction",
    "22": "Utilities",
    "23": "Construction",
    "31": "Manufacturing",
    "32": "Manufacturing",
    "33": "Manufacturing",
    "42": "Wholesale Trade",
    "44": "Retail Trade",
    "45": "Retail Trade",
    "48": "Transportation and Warehousing",
    "49": "Transportation and Warehousing",
    "51": "Information",
    "52": "Finance and Insurance",
    "53": "Real Estate and Rental and Leasing",
    "54": "Professional, Scientific, and Technical Services",
    "55": "Management of Companies and Enterprises",
    "56": "Administrative and Support and Waste Management",
    "61": "Educational Services",
    "62": "Health Care and Social Assistance",
    "71": "Arts, Entertainment, and Recreation",
    "72": "Accommodation and Food Services",
    "81": "Other Services (except Public Administration)",
    "92": "Public Administration",
}
UNKNOWN_SECTOR = "Unknown Sector"


def sector_code(naics: Column) -> Column:
    """First two digits of the code, as text."""
    return F.substring(naics.cast("string"), 1, 2)


def sector_name(naics: Column) -> Column:
    """Name of the code's sector; null for a null code, a default for other codes."""
    code = sector_code(naics)
    names = F.create_map(*[F.lit(text) for pair in SECTOR_NAMES.items() for text in pair])
    return F.when(
        code.isNotNull(), F.coalesce(F.element_at(names, code), F.lit(UNKNOWN_SECTOR))
    )
