"""Reports and feeds as text columns; a writer collects only what a report's own limit bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import xml_text
from .tables import top


def gauges(df: DataFrame, name: str, label: str, value: Column) -> DataFrame:
    """Lines of a metrics page: one gauge a label value."""
    g = df.groupBy(label).agg(value.alias("_v"))
    return g.select(F.concat(F.lit(f'{name}{{{label}="'), F.coalesce(F.col(label).cast("string"), F.lit("")), F.lit('"} '), F.col("_v").cast("string")).alias("line"))


def atom_entries(alerts: DataFrame, most: int = 50) -> DataFrame:
    """The newest alerts (uid, title, at as text) as feed entries, in order."""
    entry = F.concat(F.lit("<entry><id>"), xml_text(F.col("uid")), F.lit("</id><title>"), xml_text(F.col("title")), F.lit("</title><updated>"), F.col("at"), F.lit("</updated></entry>"))
    return top(alerts, most, F.col("at").desc(), F.col("uid")).select("at", "uid", entry.alias("entry"))


def table_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as lines of a Markdown table; a dash for null."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("–")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def documents(lines: DataFrame, key: str) -> DataFrame:
    """Reports by key from lines (key, section, place, line): one text each. Sections are bounded lists, so a report is
    small."""
    listed = lines.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("section", "place", "line"))).alias("_l"))
    return listed.select(key, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))


def section(rows: DataFrame, key: str, number: int, heading: str, columns: list[str]) -> DataFrame:
    """A heading and a table of rows (key, place, columns), as lines of a report."""
    head = rows.select(key).distinct().select(key, F.lit(number).alias("section"), F.explode(F.array(*[F.struct(F.lit(k - 9).alias("place"), F.lit(t).alias("line")) for k, t in enumerate([f"## {heading}", "", f"| {' | '.join(columns)} |", "|" + "---|" * len(columns)])])).alias("x")).select(key, "section", "x.place", "x.line")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("–")) for c in columns]
    return head.unionByName(rows.select(key, F.lit(number).alias("section"), F.col("place").cast("int").alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")))
