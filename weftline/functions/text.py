"""String and number functions on columns; all built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def url_image_id(url: Column) -> Column:
    """Digits after ``/image/`` in a relative or absolute URL; null without them."""
    return blank_to_null(F.regexp_extract(url, r"/image/(\d+)/?", 1))


def name_without_status(name: Column) -> Column:
    """The name before an optional `` - Confirmed``, `` - Unconfirmed`` or `` - Unclassified``."""
    return F.regexp_extract(name, r"^(.*?)(?: - (Confirmed|Unconfirmed|Unclassified))?$", 1)


def status_in_name(name: Column) -> Column:
    return blank_to_null(F.regexp_extract(name, r"^(.*?)(?: - (Confirmed|Unconfirmed|Unclassified))?$", 2))


def coerced_int(c: Column) -> Column:
    """Numeric text as an integer, truncated; anything else, NaN and infinities are null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < 2147483648.0), d.cast("int"))


def half_even_int(c: Column) -> Column:
    """Rounded to the nearest integer, ties to even."""
    return F.rint(c).cast("int")


def capitalized(c: Column) -> Column:
    """First character upper case, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def sentinel_to_null(c: Column, sentinels: Sequence[str] = ("nan", "none")) -> Column:
    return F.when(F.lower(c).isin(*sentinels), None).otherwise(c)


def rank_and_value(c: Column, separator: str = "__") -> tuple[Column, Column]:
    """A channel name cut at the first separator; no separator: null rank, whole value."""
    at = F.instr(c, separator)
    rank = F.when(at > 0, F.substring_index(c, separator, 1))
    value = F.when(at > 0, F.substr(c, at + F.lit(len(separator)))).otherwise(c)
    return rank, value


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """The last part of a path without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def file_suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def image_key(prefix: str, source_id: Column, image_id: Column) -> Column:
    return F.concat(F.lit(f"{prefix}/s"), source_id.cast("string"), F.lit("/images/"), image_id.cast("string"), F.lit(".jpg"))


def resized_key(prefix: str, source_id: Column, image_id: Column) -> Column:
    return image_key(f"{prefix}/resized", source_id, image_id)


def label_kind(target_id: Column, name: Column) -> Column:
    """background for id 0, unclassified for names that say so, else target."""
    vague = F.lower(F.trim(name)).isin("other", "unknown", "unclassified")
    return F.when(target_id == 0, "background").when(vague, "unclassified").otherwise("target")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(100 * part / F.nullif(whole, F.lit(0)), digits)


def null_if_empty(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)
