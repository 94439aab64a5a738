"""Names, paths, urls and intervals as Column builders; all of them stay inside code generation.

A null input gives a null result unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of the units of an interval.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
MAX_NAME = 200


def slug(name: Column) -> Column:
    """Lower-case words joined by ``-``; ``&`` reads "and", other punctuation but ``.`` and ``_`` separates."""
    spoken = F.regexp_replace(name, "&+", " and ")
    spaced = F.regexp_replace(F.regexp_replace(spoken, "[/,:()]+", " "), r"[\p{P}&&[^._]]", " ")
    return F.lower(F.regexp_replace(F.trim(spaced), r"\s+", "-"))


def file_name(name: Column, extension: Column) -> Column:
    """The slug with its extension, cut to 200 characters after the extension is added; no extension where null."""
    return F.substring(F.concat(slug(name), F.coalesce(F.concat(F.lit("."), extension), F.lit(""))), 1, MAX_NAME)


def strip_conflict(name: Column) -> Column:
    """The name without the ``@n`` that ends its first dot segment."""
    return F.regexp_replace(name, r"^([^.]*?)@[0-9]+(\.|$)", "$1$2")


def append_conflict(name: Column, number: Column) -> Column:
    """The name with ``@n`` at the end of its first dot segment."""
    stem = F.substring_index(name, ".", 1)
    return F.concat(stem, F.lit("@"), number.cast("string"), F.substring(name, F.length(stem) + 1, F.length(name)))


def interval_seconds(text: Column) -> Column:
    """Seconds of ``7s``, ``7m``, ``7h``, ``7d`` or ``7w``; 0 for another unit or none."""
    unit = F.regexp_extract(text, "^[0-9]+([a-z])$", 1)
    factor = F.lit(0)
    for name, seconds in UNIT_SECONDS.items():
        factor = F.when(unit == name, seconds).otherwise(factor)
    return F.coalesce(F.regexp_extract(text, "^([0-9]+)", 1).try_cast("bigint"), F.lit(0)) * factor


def url_hash(url: Column) -> Column:
    """``#`` and what follows, ``#heading=h.`` shortened to ``#_``; empty without a hash."""
    return F.replace(F.regexp_extract(url, "#.+$", 0), F.lit("#heading=h."), F.lit("#_"))


def without_hash(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def extension_of(name: Column) -> Column:
    """What follows the last dot; ``bin`` without one."""
    return F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("bin")


def directory_of(path: Column) -> Column:
    """What stands before the last ``/``; empty without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def in_directory(path: Column, directory: Column) -> Column:
    return (path == directory) | path.startswith(F.concat(directory, F.lit("/")))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda part: part != "")


def relative_path(start: Column, target: Column) -> Column:
    """The way from one absolute path to another: ``./`` for the same path.

    The last part of ``start`` counts as a file when it holds a dot.
    """
    parts, to = path_parts(start), path_parts(target)
    is_file = F.coalesce(F.get(parts, F.size(parts) - 1).contains("."), F.lit(False))
    base = F.when(is_file, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    same = F.zip_with(base, to, lambda a, b: a.eqNullSafe(b))
    common = F.coalesce(F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1), F.least(F.size(base), F.size(to))).cast("int")
    rest = F.array_join(F.slice(to, common + 1, F.greatest(F.size(to) - common, F.lit(0))), "/")
    ups = F.repeat(F.lit("../"), F.size(base) - common)
    return F.when(start == target, "./").otherwise(F.concat(ups, rest))
