"""Lines, elements, front matter and admission of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import stripped


def lines(text: Column) -> Column:
    return F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")


def explode_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), line; blank documents have no lines."""
    return docs.where(stripped(F.col("text")) != "").select("doc_id", F.posexplode(lines(F.col("text"))).alias("n", "line")).select("doc_id", (F.col("n") + 1).cast("long").alias("line_no"), "line")


def gathered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_nos (from 1) and lines of the documents that are not blank, each in its own row."""
    # The explode keeps the text from being made once more for the filter.
    rows = docs.select("doc_id", F.explode_outer(F.array("text")).alias("text")).where(F.col("text").rlike(r"(?U)\S")).select("doc_id", lines(F.col("text")).alias("lines"))
    return rows.select("doc_id", F.sequence(F.lit(1).cast("long"), F.size("lines").cast("long")).alias("line_nos"), "lines")


def build_elements(docs: DataFrame) -> DataFrame:
    """doc_id, ord (dense, from 0), element_id, section, text: one element for each line that is not blank."""
    kept = F.filter(lines(F.col("text")), lambda x: stripped(x) != "")
    found = docs.select("doc_id", F.col("source").alias("section"), F.posexplode(kept).alias("ord", "text"))
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), F.format_string("el-%04d", F.col("ord") + 1).alias("element_id"), "section", "text")


def front_matter(elements: DataFrame, limit: int = 3000) -> DataFrame:
    """doc_id, text: bodies in order until their running length reaches the limit, joined by line ends and cut there."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = elements.withColumn("before", before).where(F.col("before") < limit)
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x.getField("text"))
    return kept.groupBy("doc_id").agg(F.substring(F.array_join(bodies, "\n"), 1, limit).alias("text"))


def front_matter_of(docs: DataFrame, limit: int = 3000) -> DataFrame:
    """The front matter of documents whose elements are their lines, without making elements.

    The joined bodies are at least as long as the bodies that count, so the cut says the same as the running length.
    """
    kept = F.filter(lines(F.col("text")), lambda x: stripped(x) != "")
    return docs.select("doc_id", kept.alias("kept")).where(F.size("kept") > 0).select("doc_id", F.substring(F.array_join("kept", "\n"), 1, limit).alias("text"))


def admission(elements: DataFrame, limit: int) -> DataFrame:
    """doc_id, total, accepted: whether a document's bodies add up to the limit at most."""
    return elements.groupBy("doc_id").agg(F.sum(F.length("text")).alias("total")).withColumn("accepted", F.col("total") <= limit)


def scan_quality(pages: DataFrame) -> DataFrame:
    """doc_id, pages, chars, needs_ocr from a sample of six pages: too little text in all, on average, or too many empty pages.

    pages has doc_id, page_no (dense, from 0) and chars.
    """
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    picked = F.array(F.lit(0).cast("long"), F.col("n") - 1, *(F.bround((F.lit(i + 1) * (F.col("n") - 1)) / F.lit(5.0)).cast("long") for i in range(4)))
    sample = pages.join(n, "doc_id").where((F.col("n") <= 6) | F.array_contains(picked, F.col("page_no")))
    sums = sample.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.count_if(F.col("chars") == 0).alias("empty"))
    return sums.select("doc_id", "pages", "chars", ((F.col("chars") < 120) | (F.col("chars") < 40 * F.col("pages")) | (F.col("empty") * 10 >= 6 * F.col("pages"))).alias("needs_ocr"))
