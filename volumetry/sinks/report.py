"""HTML report of quality metrics, built as lines of text by Spark."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STYLE = "table{border-collapse:collapse}td,th{border:1px solid #999;padding:2px 6px}.outlier{background:#fdd}"


def _escaped(c: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
    return reduce(lambda e, p: F.replace(e, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(c.cast("string"), F.lit("")))


def _table(df: DataFrame, part: int, columns: Sequence[str], mark: str | None = None) -> DataFrame:
    cells = F.concat(*[F.concat(F.lit("<td>"), _escaped(F.col(c)), F.lit("</td>")) for c in columns])
    open_tag = F.when(F.col(mark), "<tr class='outlier'>").otherwise("<tr>") if mark else F.lit("<tr>")
    key = F.col(columns[0]).cast("string")
    return df.select(F.lit(part).alias("part"), key.alias("key"), F.concat(open_tag, cells, F.lit("</tr>")).alias("line"))


def _head(columns: Sequence[str], title: str) -> str:
    return f"<h2>{title}</h2><table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"


def qc_report(flagged: DataFrame, summary: DataFrame, described: DataFrame, item: str = "volume_id") -> DataFrame:
    """Lines ``(part, key, line)`` of the page: totals, metric table, outliers, then every volume."""
    spark = flagged.sparkSession
    columns = [item, *[c for c in flagged.columns if c != item]]
    fixed = spark.createDataFrame([
        (0, "", f"<html><head><style>{STYLE}</style></head><body><h1>Quality control</h1>" + _head(summary.columns, "Summary")),
        (2, "", "</table>" + _head(described.columns, "Metrics")),
        (4, "", "</table>" + _head([item], "Outliers")),
        (6, "", "</table>" + _head(columns, "All volumes")),
        (8, "", "</table></body></html>"),
    ], "part int, key string, line string")
    stamp = flagged.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("~").alias("key"), F.concat(
        F.lit("<!-- generated "), F.current_timestamp().cast("string"), F.lit(" -->")).alias("line"))
    parts = [fixed, stamp, _table(summary, 1, summary.columns), _table(described, 3, described.columns),
             _table(flagged.where("is_outlier"), 5, [item]), _table(flagged, 7, columns, "is_outlier")]
    return reduce(DataFrame.unionByName, parts)


def write_report(lines: DataFrame, path: str) -> None:
    """Text files that give the page when read in name order."""
    lines.repartitionByRange("part", "key").sortWithinPartitions("part", "key").select("line").write.mode("overwrite").text(path)
