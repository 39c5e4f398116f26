"""Requests and responses of batch inference: contracts, prompts, calls, parsing with repair, trimming and validation.

The model is any function from a pandas frame of requests to one of responses; the work around it is Spark's.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import stripped
from .json_repair import repaired
from .schemas import IGNORED, RULES, document_type

FENCED = r"(?is)```(?:json)?\s*(.*?)\s*```"
CONTRACT = "struct<doc_type string, document_fields array<string>, target_slots array<string>, rules array<string>, ignore_sections array<string>>"
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")

def contract(schema: T.StructType) -> tuple[list[str], list[str]]:
    """Slots (lists of records with evidence) and the other fields of a document type's schema."""
    def is_slot(f: T.StructField) -> bool:
        kind = f.dataType
        return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and "evidence_element_ids" in kind.elementType.names

    return [f.name for f in schema if is_slot(f)], [f.name for f in schema if not is_slot(f) and f.name not in ("doc_id", "doc_type", "version", "title")]


def with_contracts(docs: DataFrame, schemas: dict[str, T.StructType], rules: tuple[str, ...] = RULES, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """Adds contract (doc_type, document_fields, target_slots, rules, ignore_sections) by the document's type, NULL for unknown types.

    The contracts are one row for each type.
    """
    rows = [(t, (t, fields, slots, list(rules), list(ignored))) for t, schema in schemas.items() for slots, fields in (contract(schema),)]
    dimension = docs.sparkSession.createDataFrame(rows, f"known_type string, contract {CONTRACT}")
    return docs.join(F.broadcast(dimension), document_type(F.col("doc_type")) == F.col("known_type"), "left").drop("known_type")


def chunk_prompts(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, chunk_id, request (JSON), summary (of the chunk, for error rows).

    chunks are those of chunk_summary. documents has doc_id, outline (JSON), document_summary and contract; blank summaries
    are left out. The request holds what a caller needs to ask about one chunk: the outline, the summary, the contract, the
    chunk's id, section, pages and the only ids that it may cite, and the marked text.
    """
    chunk = F.struct("chunk_id", F.col("section").alias("section_path"), "page_start", "page_end", F.col("element_ids").alias("allowed_evidence_element_ids"))
    said = F.nullif(stripped(F.col("document_summary")), F.lit(""))
    request = F.to_json(F.struct(F.try_parse_json("outline").alias("outline"), said.alias("summary"), "contract", chunk.alias("chunk"), F.col("markdown").alias("text")))
    pages = F.concat_ws("-", F.col("page_start").cast("string"), F.nullif(F.col("page_end"), F.col("page_start")).cast("string"))
    summary = F.concat_ws(" ", "chunk_id", F.nullif(F.concat(F.lit("["), F.coalesce("section", F.lit("")), F.lit("]")), F.lit("[]")), F.nullif(F.concat(F.lit("pages "), pages), F.lit("pages ")), F.concat(F.col("elements").cast("string"), F.lit(" elements")), F.concat(F.length("markdown").cast("string"), F.lit(" characters")))
    return chunks.join(documents.select("doc_id", "outline", "document_summary", "contract"), "doc_id").select("doc_id", "chunk_id", request.alias("request"), summary.alias("summary"))


def finalizer_inputs(results: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, request (JSON): the outline, summary and contract of a document and all results of its chunks, in order; never the elements.

    results has doc_id, chunk_no and response (JSON; one that is none is left out). Documents without results have no row.
    """
    rows = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "response"))), lambda x: F.try_parse_json(x["response"]))
    found = results.where(F.try_parse_json("response").isNotNull()).groupBy("doc_id").agg(rows.alias("candidates"))
    said = F.nullif(stripped(F.col("document_summary")), F.lit(""))
    request = F.to_json(F.struct(F.try_parse_json("outline").alias("outline"), said.alias("summary"), "contract", "candidates"))
    return found.join(documents.select("doc_id", "outline", "document_summary", "contract"), "doc_id").select("doc_id", request.alias("request"))


def batch_infer(requests: DataFrame, call: Callable[[str], str], tasks: int, pool: int = 4, timeout: float | None = None, retries: int = 0, pause: float = 0.0) -> DataFrame:
    """requests with response and error, in the order of each task's rows: a failing call gives an error row, never a failed job.

    At most tasks * pool calls run at once, and each task holds the answers of at most 2 * pool rows. A call that takes longer
    than timeout seconds fails; one that fails is made again up to retries times, after a pause that doubles. A null request
    is an error without a call. An error names what went wrong and, where the requests have a summary (of their chunk), that.
    """
    schema = T.StructType([*requests.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])
    summarised = "summary" in requests.columns

    def run(frames):
        calls = _Pool(call, pool, timeout, retries, pause)
        try:
            for frame in frames:
                for start in range(0, len(frame), 2 * pool):
                    part = frame.iloc[start : start + 2 * pool]
                    both = calls.answers(part["request"].tolist())
                    if summarised:
                        both = [(r, e if e is None else f"chunk failed: {s}: {e}") for (r, e), s in zip(both, part["summary"].tolist(), strict=True)]
                    yield part.assign(response=[r for r, _ in both], error=[e for _, e in both])
        finally:
            calls.close()

    return requests.repartition(tasks).mapInPandas(run, schema)


class _Pool:
    """Calls of one task, a bounded number at once. A call over its time keeps a thread until it returns, so its place is made anew."""

    def __init__(self, call: Callable[[str], str], size: int, timeout: float | None, retries: int, pause: float):
        self.call, self.size, self.timeout, self.retries, self.pause = call, max(1, size), timeout, max(0, retries), pause
        self.threads = ThreadPoolExecutor(self.size)

    def _once(self, request: str) -> tuple[str | None, str | None]:
        for attempt in range(self.retries + 1):
            try:
                return self.call(request), None
            except Exception as e:  # noqa: BLE001  the caller's function may raise anything
                error = f"{type(e).__name__}: {e}"[:500]
            if attempt < self.retries:
                time.sleep(self.pause * 2**attempt)
        return None, error

    def answers(self, requests: list[str | None]) -> list[tuple[str | None, str | None]]:
        """The answers in the order of the requests, pool by pool, so that each call's time begins as it starts."""
        out = []
        for start in range(0, len(requests), self.size):
            running = [None if r is None else self.threads.submit(self._once, r) for r in requests[start : start + self.size]]
            until = None if self.timeout is None else time.monotonic() + self.timeout
            late = False
            for future in running:
                if future is None:
                    out.append((None, "no request"))
                    continue
                try:
                    out.append(future.result(None if until is None else max(0.0, until - time.monotonic())))
                except TimeoutError:
                    late = True
                    out.append((None, f"no answer in {self.timeout} s"))
            if late:
                self.close()
                self.threads = ThreadPoolExecutor(self.size)
        return out

    def close(self) -> None:
        self.threads.shutdown(wait=False, cancel_futures=True)


@F.pandas_udf(T.StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repaired)


def parse_json(responses: DataFrame, column: str = "response") -> DataFrame:
    """Adds parsed (JSON text), outcome (parsed, repaired or failed) and preview (the first 200 characters of what failed).

    Only what does not parse goes to Python.
    """
    said = F.coalesce(F.col(column), F.lit(""))
    inside = F.when(said.rlike(FENCED), F.regexp_extract(said, FENCED, 1)).otherwise(said)
    rows = responses.withColumn("body", stripped(inside)).withColumn("strict", F.try_parse_json("body").isNotNull() & (F.col("body") != ""))
    good = rows.where("strict").withColumns({"parsed": F.col("body"), "outcome": F.lit("parsed")})
    odd = rows.where(~F.col("strict")).withColumn("parsed", _repaired("body")).withColumn("outcome", F.when(F.col("parsed").isNotNull(), "repaired").otherwise("failed"))
    preview = F.when(F.col("outcome") == "failed", F.concat(F.substring(said, 1, 200), F.when(F.length(said) > 200, F.lit("...")).otherwise("")))
    return good.unionByName(odd).withColumn("preview", preview).drop("body", "strict")


def _trimmed(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return stripped(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _trimmed(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_trimmed(value[f.name], f.dataType).alias(f.name) for f in kind)))
    return value


def trim_strings(results: DataFrame) -> DataFrame:
    """Every string, in lists and records too, without white space at its ends."""
    return results.select(*(_trimmed(F.col(f.name), f.dataType).alias(f.name) for f in results.schema))


def validate(results: DataFrame, slot: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """Adds reason (NULL for a good chunk) and doc_failed (no chunk of the document is good).

    results has doc_id, chunk_no, error, items (records with name and method) and fields. A chunk fails by its call's
    error, without any item or field, with a nameless item, and, in the slot apis, with an unknown method.
    """
    empty = (F.coalesce(F.size("items"), F.lit(0)) <= 0) & ~F.coalesce(*(F.nullif(F.col(f), F.lit("")).isNotNull() for f in fields), F.lit(False))
    nameless = F.exists("items", lambda x: F.coalesce(stripped(x["name"]), F.lit("")) == "")
    reason = F.when(F.col("error").isNotNull(), "call failed").when(empty, "no known field").when(nameless, "item without a name")
    if slot == "apis":
        reason = reason.when(F.exists("items", lambda x: ~F.coalesce(x["method"].isin(*METHODS), F.lit(True))), "unknown method")
    rows = results.withColumn("reason", reason)
    failed = rows.groupBy("doc_id").agg((F.count_if(F.col("reason").isNull()) == 0).alias("doc_failed"))
    return rows.join(failed, "doc_id")
