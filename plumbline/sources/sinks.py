"""Report outputs: flat CSV tables (nested columns as JSON text), JSON and text lines, written by Spark in parts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def flattened(df: DataFrame) -> DataFrame:
    """Arrays of strings joined, other nested columns as JSON, review flags as yes or nothing: fit for CSV."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType) and f.dataType.elementType.simpleString() == "string":
            c = F.array_join(c, "; ")
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            c = F.to_json(c)
        elif f.name == "needs_review":
            c = F.when(c, "yes").otherwise("")
        out.append(c.alias(f.name))
    return df.select(*out)


def write_report(tables: Mapping[str, DataFrame], path: str) -> dict[str, str]:
    """Each table as CSV under its name; one that fails doesn't stop the others. Returns the failures."""
    failed = {}
    for name, df in tables.items():
        try:
            flattened(df).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        except (AnalysisException, OSError, TypeError, ValueError) as error:  # an output that can't be written so; lost executors are no such failure
            failed[name] = str(error)
    return failed


def write_json(tables: Mapping[str, DataFrame], path: str) -> dict[str, str]:
    """Each table as nested JSON, a line a row; failures as `write_report` gives them."""
    failed = {}
    for name, df in tables.items():
        try:
            df.write.mode("overwrite").json(f"{path}/{name}")
        except (AnalysisException, OSError, TypeError, ValueError) as error:  # an output that can't be written so; lost executors are no such failure
            failed[name] = str(error)
    return failed


def write_lines(lines: DataFrame, path: str) -> None:
    """Numbered lines (part, ord, line) as text, in order over the part files."""
    lines.repartitionByRange("part", "ord").sortWithinPartitions("part", "ord").select("line").write.mode("overwrite").text(path)
