"""Blocks back to Markdown: one expression for each type, and the blocks of a document in order.

A block has doc_id, block_no, type and text; of level, language, fence, items, ordered, rows, raw_markdown, prefer_html, alt
and src those columns are read that are there. A missing attribute counts as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import SEPARATOR, stripped

#: A line's end, of any kind.
LINE_END = r"\R"
# What HTML writes for the characters that mean something in it.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
# Types of the attributes a block may have.
ATTRIBUTES = {"level": "int", "language": "string", "fence": "string", "items": "array<string>", "ordered": "boolean", "rows": "array<array<string>>", "raw_markdown": "string", "prefer_html": "boolean", "alt": "string", "src": "string"}


def _kept_left(text: Column) -> Column:
    """Without white space at the end."""
    return F.regexp_replace(text, r"(?U)\s+$", "")


def _quote(text: Column) -> Column:
    said = F.filter(F.split(text, LINE_END), lambda line: stripped(line) != "")
    return F.array_join(F.transform(said, lambda line: F.concat(F.lit("> "), _kept_left(line))), "\n")


def _list(items: Column, ordered: Column) -> Column:
    """Items are numbered by their place, those that say nothing too; further lines of an item are indented."""

    def item(text: Column, place: Column) -> Column:
        lines = F.split(stripped(text), LINE_END)
        marker = F.when(ordered, F.concat((place + 1).cast("string"), F.lit("."))).otherwise("-")
        more = F.transform(F.slice(lines, 2, F.size(lines)), lambda line: F.concat(F.lit("  "), _kept_left(line)))
        return F.when(stripped(text) != "", F.array_join(F.concat(F.array(F.concat(marker, F.lit(" "), stripped(F.get(lines, F.lit(0))))), more), "\n"))

    return F.array_join(F.filter(F.transform(items, item), lambda x: x.isNotNull()), "\n")


def is_table(markdown: Column) -> Column:
    """Whether the text already is a pipe table: a row first, and a separator after it."""
    lines = F.filter(F.transform(F.split(markdown, LINE_END), stripped), lambda x: x != "")
    first = F.coalesce(F.get(lines, F.lit(0)).rlike(r"^\|.*\|$"), F.lit(False))
    return F.coalesce(first & F.exists(F.slice(lines, 2, F.size(lines)), lambda x: x.rlike(SEPARATOR)), F.lit(False))


def _pipes(rows: Column) -> Column:
    """A pipe table; one of a header alone has an empty row."""
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    header = F.get(rows, F.lit(0))
    body = F.when(F.size(rows) > 1, F.slice(rows, 2, F.size(rows))).otherwise(F.array(F.transform(header, lambda _: F.lit(""))))
    lines = F.concat(F.array(row(header), row(F.transform(header, lambda _: F.lit("---")))), F.transform(body, row))
    return F.array_join(lines, "\n")


def _escaped(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _html(rows: Column) -> Column:
    """An HTML table, its first row of header cells; the only form that holds ragged rows and cells of several lines."""

    def row(cells: Column, place: Column) -> Column:
        tag = F.when(place == 0, "th").otherwise("td")
        text = lambda c: F.when(c == "", "&nbsp;").otherwise(F.regexp_replace(_escaped(c), LINE_END, "<br>"))
        lines = F.transform(cells, lambda c: F.concat(F.lit("    <"), tag, F.lit(">"), text(c), F.lit("</"), tag, F.lit(">")))
        return F.array_join(F.concat(F.array(F.lit("  <tr>")), lines, F.array(F.lit("  </tr>"))), "\n")

    return F.array_join(F.concat(F.array(F.lit("<table>")), F.transform(rows, row), F.array(F.lit("</table>"))), "\n")


def _table(text: Column, raw: Column, rows: Column, prefer_html: Column) -> Column:
    """Markdown that came with the table, else a pipe table of its rows, or HTML where that would change them."""
    cells = F.transform(rows, lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: stripped(F.coalesce(c, F.lit("")))))
    width = F.size(F.get(cells, F.lit(0)))
    odd = F.exists(cells, lambda r: (F.size(r) != width) | F.exists(r, lambda c: c.rlike(r"[\n|]")))
    html = F.coalesce(prefer_html, F.lit(False)) | ((width > 0) & odd)
    return F.when(is_table(raw), stripped(raw)).when(F.coalesce(F.size(rows), F.lit(0)) <= 0, stripped(text)).when(html, _html(cells)).otherwise(_pipes(cells))


def rendered(blocks: DataFrame) -> DataFrame:
    """Adds markdown to the blocks."""
    a = {name: (F.col(name) if name in blocks.columns else F.lit(None)).cast(kind) for name, kind in ATTRIBUTES.items()}
    kind, text = F.col("type"), F.coalesce("text", F.lit(""))
    fence = F.coalesce(F.nullif(a["fence"], F.lit("")), F.lit("```"))
    source, none = stripped(F.coalesce(a["src"], F.lit(""))), F.lit("")
    out = F.when(kind == "title", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.coalesce(F.nullif(a["level"], F.lit(0)), F.lit(1)), F.lit(1)), F.lit(6))), F.lit(" "), stripped(text)))
    out = out.when(kind == "quote", _quote(text)).when(kind == "section_break", "---")
    out = out.when(kind == "code", F.concat(fence, stripped(F.coalesce(a["language"], none)), F.lit("\n"), _kept_left(text), F.lit("\n"), fence))
    out = out.when((kind == "list") & (F.size(a["items"]) > 0), _list(a["items"], F.coalesce(a["ordered"], F.lit(False))))
    out = out.when(kind == "table", _table(text, stripped(F.coalesce(a["raw_markdown"], none)), a["rows"], a["prefer_html"]))
    out = out.when((kind == "image") & (source != ""), F.concat(F.lit("!["), stripped(F.coalesce(a["alt"], none)), F.lit("]("), source, F.lit(")")))
    return blocks.withColumn("markdown", out.otherwise(stripped(text)))


def render_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, markdown: the blocks of a document that say something, in order, with a blank line between them."""
    said = rendered(blocks).select("doc_id", "block_no", F.regexp_replace("markdown", r"^\n+|\n+$", "").alias("markdown"))
    rows = F.array_sort(F.collect_list(F.when(F.col("markdown") != "", F.struct("block_no", "markdown"))))
    return said.groupBy("doc_id").agg(stripped(F.array_join(F.transform(rows, lambda x: x["markdown"]), "\n\n")).alias("markdown"))
