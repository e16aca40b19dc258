"""Rows as text of the export formats, and files of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field(df: DataFrame, name: str, between: str = " ") -> Column:
    """A field's text: nothing for null, the parts of a list joined, quoted where it must be."""
    kind = df.schema[name].dataType
    text = F.array_join(F.transform(name, lambda v: v.cast("string")), between) if isinstance(kind, T.ArrayType) else F.col(name).cast("string")
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv(df: DataFrame, names: list[str], between: str = " ") -> DataFrame:
    return df.select(F.concat_ws(",", *[field(df, n, between) for n in names]).alias("line"))


def json(value: Column) -> Column:
    """Null fields have no key."""
    return F.to_json(value, {"ignoreNullFields": "true"})


def report(lines: DataFrame) -> DataFrame:
    """One text of a bounded report's lines (at, line), in the order of `at`."""
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "\n").alias("report"))


def escaped(text: Column) -> Column:
    """Text for HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_table(rows: DataFrame, names: list[str], order: str) -> DataFrame:
    """One HTML table of a bounded report's rows."""
    cells = F.concat(*[F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(n).cast("string"), F.lit(""))), F.lit("</td>")) for n in names])
    head = "".join(f"<th>{n}</th>" for n in names)
    lines = rows.select(F.col(order).alias("at"), F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("line"))
    body = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "").alias("body"))
    return body.select(F.concat(F.lit(f"<table><tr>{head}</tr>"), "body", F.lit("</table>")).alias("html"))


def write_text(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.select("line").write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def write_csv(df: DataFrame, path: str, between: str = " ", mode: str = "errorifexists") -> None:
    flat = df.select(*[F.array_join(F.transform(f.name, lambda v: v.cast("string")), between).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema])
    flat.write.mode(mode).csv(path, header=True, emptyValue="", nullValue="")
