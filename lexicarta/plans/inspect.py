"""What the optimiser made of a query: used by the plan tests and by hand."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    """The formatted physical plan."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def scan_filters(df: DataFrame) -> dict[str, list[str]]:
    """Partition and pushed filters, and the columns read, of each Parquet scan."""
    text = physical(df)
    return {name: re.findall(rf"{name}: (.*)", text) for name in ("PartitionFilters", "PushedFilters", "ReadSchema")}


def operators(df: DataFrame) -> list[str]:
    """Names of the physical operators, top down as printed."""
    return re.findall(r"[:+\- *]*([A-Z]\w+)(?: \w+)* \(\d+\)", physical(df))


def python_nodes(df: DataFrame) -> list[str]:
    return [x for x in operators(df) if re.search("Python|Pandas|Arrow", x)]
