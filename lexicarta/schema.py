"""Columns of the glossary and the request vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RELEASE = ("platform", "version")
#: Columns of a result, in order (fixed values of the API).
RESULT_COLUMNS = ("id", "group_id", "source", "target", "language", "file_name", "bundle_name")
GLOSSARY_SCHEMA = (
    "id long, group_id long, source string, target string, language string, file_name string, "
    "bundle_name string, platform string, version int, target_norm string"
)
#: Request alias of a column (fixed values of the API).
COLUMNS = {"key": "source", "localization": "target", "language": "language", "file": "file_name", "bundle": "bundle_name"}
#: Comparisons of a column search (fixed values of the API).
OPERATORS = ("equal", "notEqual", "startsWith")
DEFAULT_SIZE = MOST_SIZE = 200
#: Pages beyond are empty in any table; the bound keeps row offsets within a long.
MOST_PAGE = 10**15


def of_release(platform: str, version: int) -> Column:
    """Predicate on the partition columns."""
    return (F.col("platform") == platform) & (F.col("version") == version)


def total_order(extra: tuple[str, ...] = ()) -> list[str]:
    """Result order: group, language, then every other column, so that pages never overlap."""
    first = ("group_id", "language", "id")
    return [*extra, *first, *(c for c in RESULT_COLUMNS if c not in first)]
