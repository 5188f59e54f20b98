"""Names: identifiers, table names from files, singular forms.

Each rule comes twice: for driver-side metadata (``str``) and for a column of any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Fixed values.
OTHER_CHARACTERS = r"[^a-zA-Z0-9_]+"
SOURCE_NUMBER_PREFIX = r"(?i)^source[0-9]*[_-]+"
FILE_PREFIXES = ("source_", "src_", "raw_")


def identifier(text: str, empty: str = "field") -> str:
    name = re.sub(OTHER_CHARACTERS, "_", text.strip().lower()).strip("_") or empty
    return "_" + name if name[0] in "0123456789" else name


def identifier_column(text: Column, empty: str = "field") -> Column:
    name = F.btrim(F.regexp_replace(F.lower(text), OTHER_CHARACTERS, "_"), F.lit("_"))
    name = F.when(name == "", F.lit(empty)).otherwise(name)
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("_"), name)).otherwise(name)


def unique_identifiers(names: Iterable[str]) -> list[str]:
    """Identifiers in order; repeats get ``_2``, ``_3`` and so on, skipping names already taken."""
    taken: set[str] = set()
    result = []
    for base in map(identifier, names):
        name, number = base, 1
        while name in taken:
            number += 1
            name = f"{base}_{number}"
        taken.add(name)
        result.append(name)
    return result


def file_stem(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


def table_name(path: str) -> str:
    """Target table name proposed for a file."""
    stem = re.sub(SOURCE_NUMBER_PREFIX, "", file_stem(path))
    for prefix in FILE_PREFIXES:
        stem = re.sub("(?i)^" + prefix, "", stem)
    return identifier(stem)


def table_name_column(file_name: Column) -> Column:
    """The same for a column of file names, such as ``_metadata.file_name``."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    for prefix in (SOURCE_NUMBER_PREFIX, *("(?i)^" + p for p in FILE_PREFIXES)):
        stem = F.regexp_replace(stem, prefix, "")
    return identifier_column(stem)


def raw_table_name(path: str) -> str:
    return "raw_" + identifier(file_stem(path))


def singular(name: str) -> str:
    """All trailing ``s`` removed."""
    return name.rstrip("s")
