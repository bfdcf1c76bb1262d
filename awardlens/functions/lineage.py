"""Which drop file a row came from."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the part number at the end of a drop's file name.
PART_NUMBER = r"_(\d+)\.csv.zst$"


def file_id(file_name: Column) -> Column:
    """The part number in the name, else the name without its last suffix."""
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^.]+$", "")
    return _part_number(file_name).otherwise(stem)


def uri_name(uri: Column) -> Column:
    """Last part of a URI, still percent-encoded."""
    return F.substring_index(uri, "/", -1)


def uri_file_id(encoded_name: Column) -> Column:
    """``file_id`` of a percent-encoded name; decodes only where the name itself is the id."""
    # A plus sign in a path is itself, unlike in a form.
    name = F.url_decode(F.replace(encoded_name, F.lit("+"), F.lit("%2B")))
    return _part_number(encoded_name).otherwise(file_id(name))


def _part_number(name: Column) -> Column:
    return F.when(name.rlike(PART_NUMBER), F.regexp_extract(name, PART_NUMBER, 1))
