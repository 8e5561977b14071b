"""Writers: sorted-key JSON lines, CSV, and small reports rendered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Objects with alphabetical keys; unknown values are written as null."""
    keys = sorted(rows.columns)
    rows.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; booleans in lower case, unknown values empty."""
    flags = {f.name: F.lower(F.col(f.name).cast("string")) for f in rows.schema.fields if f.dataType.simpleString() == "boolean"}
    (rows.withColumns(flags) if flags else rows).write.option("header", True).option("emptyValue", "").csv(path)


def cell(value: object) -> str:
    """A table cell: unknown is told apart from zero."""
    if value is None:
        return "unknown"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.2f}"
    return str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(rows: DataFrame) -> str:
    """An ordered result as a Markdown table with every row, fetched a partition at a time."""
    head = "| " + " | ".join(rows.columns) + " |"
    rule = "|" + "---|" * len(rows.columns)
    return "\n".join([head, rule, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows.toLocalIterator())]) + "\n"


def report(title: str, sections: dict[str, DataFrame]) -> str:
    """A Markdown report of small tables."""
    return "\n".join([f"# {title}", "", *(f"## {name}\n\n{markdown_table(rows)}" for name, rows in sections.items())])


def status_table(rows: DataFrame) -> str:
    """Padded columns of every row for a terminal."""
    found = [rows.columns, *([cell(v) for v in r] for r in rows.toLocalIterator())]
    widths = [max(len(r[i]) for r in found) for i in range(len(rows.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in found) + "\n"


def evidence_excerpts(rows: DataFrame, include_unapproved: bool = False) -> DataFrame:
    """Excerpts for display; those of sources without approved rights are withheld."""
    shown = F.col("display_approved") | F.lit(include_unapproved)
    return rows.withColumn("excerpt", F.when(shown, F.col("excerpt")).otherwise(F.lit("[withheld: display rights not approved]")))
