"""String expressions with the reference's exact meaning of "strip" and "suffix"."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every code point that counts as white space at the ends of a cell.
WHITE_SPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())

# Suffixes of image files.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
# The shorter list of the older listing.
LEGACY_SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff")

IMAGE_PATTERN = r"\.(" + "|".join(IMAGE_SUFFIXES) + r")\z"


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(x: Column | str) -> Column:
    """White space of any kind taken off both ends, all else byte-exact; null stays null."""
    return F.btrim(as_column(x), F.lit(WHITE_SPACE))


def filled(x: Column | str) -> Column:
    """True where the stripped cell is neither null nor empty; never null."""
    return F.coalesce(stripped(x) != "", F.lit(False))


def folded_name(x: Column | str) -> Column:
    """A folder name as it is compared: stripped and lower-cased."""
    return F.lower(stripped(x))


def is_image(x: Column | str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> Column:
    """True where the name carries one of the suffixes, in any case; null names are no images."""
    return F.coalesce(F.lower(as_column(x)).rlike(r"\.(" + "|".join(suffixes) + r")\z"), F.lit(False))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(as_column(path), "/"), -1)


def parent_name(path: Column | str) -> Column:
    """Name of the folder that holds the file; empty where the path has no folder."""
    return F.coalesce(F.try_element_at(F.split(as_column(path), "/"), F.lit(-2)), F.lit(""))


def family(label: Column | str) -> Column:
    """Class family of a detection label: the text before its first underscore, case-sensitive."""
    return F.split_part(as_column(label), F.lit("_"), F.lit(1))


def regex_category(x: Column | str, pattern: str, missing: str = "—") -> Column:
    """Group 1 of the first match if the pattern has groups, else the whole match; ``missing`` without one."""
    import re

    group = 1 if re.compile(pattern).groups else 0
    return F.when(as_column(x).rlike(pattern), F.regexp_extract(as_column(x), pattern, group)).otherwise(F.lit(missing))


def html_escaped(x: Column | str) -> Column:
    out = as_column(x)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def truthy(x: Column | str) -> Column:
    """Loose switch text to BOOLEAN: 1, true, yes, on are true, all else (null too) false."""
    return F.coalesce(F.lower(stripped(x)).isin("1", "true", "yes", "on"), F.lit(False))


def parsed_number(x: Column | str) -> Column:
    """A number or null; text that is no number is ignored rather than an error."""
    return as_column(x).try_cast("double")
