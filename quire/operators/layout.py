"""Elements of a layout parser: block types of labels, heading levels, boxes, and paragraphs that visual lines have cut up.

A layout element has doc_id, ord (dense, from 0, within the document), label, text and page; more columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .blocks import COLON, ELEMENT_TYPES, HEADING, NUMBERED, ROW, stripped

# Block type by the layout parser's label; others are paragraphs.
BLOCK_TYPES = {"section_header": "title", "title": "title", "heading": "title", "paragraph": "paragraph", "text": "paragraph", "table": "table", "picture": "image", "image": "image", "figure": "image", "code": "code", "code_block": "code", "list": "list", "list_item": "list"}
# What ends a sentence, and what stands without a blank before it.
SENTENCE_ENDS, CLOSERS = ("。", ".", "！", "!", "？", "?", "；", ";"), (":", "：", "。", ".", "，", ",", "）", ")", "；", ";", "、", "？", "?", "！", "!")
#: A paragraph of at least so many characters goes on though nothing but its missing end says so; longer structural text stands apart.
GOES_ON, SHORT = 5, 15


def block_type(label: Column) -> Column:
    """The block type of a label in any case; a missing or unknown one is a paragraph."""
    kinds = F.create_map(*(F.lit(x) for pair in BLOCK_TYPES.items() for x in pair))
    return F.coalesce(kinds[F.lower(stripped(label))], F.lit("paragraph"))


def element_type(label: Column) -> Column:
    """The element type of a layout label, through its block type."""
    kinds = F.create_map(*(F.lit(x) for pair in ELEMENT_TYPES.items() for x in pair))
    return F.coalesce(kinds[block_type(label)], F.lit("paragraph"))


def traversal_levels(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, level of a tree (doc_id, node_id, parent_id): 1 for roots and for nodes whose parent is not there.

    Each round doubles how far up a node looks, so a tree of any depth takes few rounds; nodes on or below a circle end
    without a level (NULL). A repeated node keeps its smallest parent.
    """
    spark = nodes.sparkSession
    known = nodes.groupBy("doc_id", "node_id").agg(F.min("parent_id").alias("up"))
    there = known.select("doc_id", F.col("node_id").alias("up"), F.lit(True).alias("there"))
    now = known.join(there, ["doc_id", "up"], "left").select("doc_id", "node_id", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("steps"))

    def kept(frame: DataFrame) -> DataFrame:
        path = scratch(spark, "tree")
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    now, reach, longest = kept(now), 1, known.count()
    while reach < longest and not now.where("up is not null").isEmpty():
        above = now.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
        now = kept(now.join(above, ["doc_id", "up"], "left").select("doc_id", "node_id", F.col("further").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        reach *= 2
    return now.select("doc_id", "node_id", F.when(F.col("up").isNull(), F.col("steps") + 1).alias("level"))


def heading_level(text: Column, markdown: Column, own: Column, traversal: Column) -> Column:
    """From 1 to 6: by a dotted number, else by the marks of the Markdown, else the element's own level, else its place in the tree, else 1."""
    number = F.regexp_extract(stripped(text), NUMBERED, 1)
    marks = F.regexp_extract(stripped(markdown), HEADING, 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    known = [x.try_cast("int") for x in (own, traversal)]
    clamped = [F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(1)), F.lit(6))) for x in known]
    return F.coalesce(F.when(number != "", F.least(dots + 2, F.lit(6))), F.when(marks != "", F.length(marks)), *clamped, F.lit(1)).cast("int")


def bbox(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """[left, bottom, right, top]; a missing side counts as 0, and a side that is no finite number makes the box NULL."""
    sides = [F.coalesce(x.cast("string"), F.lit("0")).try_cast("double") for x in (left, bottom, right, top)]
    return valid_box(F.array(*sides))


def valid_box(box: Column) -> Column:
    """The box as four doubles, or NULL if it has not just four sides or one that is no finite number."""
    numbers = F.transform(box, lambda x: x.try_cast("double"))
    odd = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(numbers) == 4) & ~odd, numbers)


def rectangle(box: Column, scale: float = 1.0) -> Column:
    """left, top, width, height of a box on a page of that scale, rounded half up; NULL for no box or one without area."""
    side = lambda k: F.get(box, k) * scale
    width, height = F.abs(side(2) - side(0)), F.abs(side(3) - side(1))
    rounded = {"left": F.least(side(0), side(2)), "top": F.least(side(1), side(3)), "width": width, "height": height}
    return F.when((width > 0) & (height > 0), F.struct(*(F.floor(x + 0.5).cast("long").alias(name) for name, x in rounded.items())))


def targets_by_box(bound: DataFrame, scale: float = 1.0) -> DataFrame:
    """doc_id, page, left, top, width, height, objects (ordered ids): what is supported by one place of a page.

    bound has doc_id, object_id, page and bbox. Evidence without a page (or on page 0) or without an area has no place.
    """
    placed = bound.where("page <> 0").select("doc_id", "object_id", "page", rectangle(valid_box(F.col("bbox")), scale).alias("r")).where("r is not null")
    return placed.select("doc_id", "object_id", "page", "r.*").groupBy("doc_id", "page", "left", "top", "width", "height").agg(F.array_sort(F.collect_set("object_id")).alias("objects"))


# Paragraphs that belong together. Whether an element joins the run before it depends on the run's first page and on how long
# the run is by then. Ranges of elements are summarised: for each way in which a run may enter a range, which run leaves it.
# The summaries of a document compose, one row for each range, and a second pass over the ranges knows what enters.


def _signs(elements: DataFrame, size: int) -> DataFrame:
    """What the walk needs of each element, by range; the last element of a range also stands before the next one."""
    text = stripped(F.coalesce("text", F.lit("")))
    structural = text.rlike(HEADING) | text.rlike(ROW) | text.rlike(r"(?U)^(?:[-+*]|\d+\.)\s+\S")
    plain = (block_type(F.col("label")) == "paragraph") & (text != "")
    wide = lambda c: F.coalesce(F.ascii(c) > 127, F.lit(False))
    ends, closers = (F.array(*map(F.lit, x)) for x in (SENTENCE_ENDS, CLOSERS))
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    signs = {
        "plain": plain, "apart": structural & (F.length(text) > SHORT), "starts_colon": first.rlike(COLON), "ends_colon": last.rlike(COLON),
        "ended": F.array_contains(ends, last), "closes": F.array_contains(closers, first), "head_wide": wide(first), "tail_wide": wide(last), "length": F.length(text),
    }
    rows = elements.select("doc_id", "ord", "page", *(v.alias(k) for k, v in signs.items()))
    part = F.expr(f"ord DIV {size}")
    again = F.when((F.col("ord") + 1) % size == 0, F.array(part, part + 1)).otherwise(F.array(part))
    return rows.select("*", F.explode(again).alias("part"))


class _Range:
    """The elements of one range, in order, with one before them if there is one."""

    def __init__(self, frame: pd.DataFrame, size: int):
        frame = frame.sort_values("ord", kind="stable")
        value = {c: frame[c].tolist() for c in frame.columns}
        self.halo = int(bool(len(frame)) and value["ord"][0] < value["part"][0] * size)
        self.ords, self.pages = value["ord"], [None if pd.isna(p) else p for p in value["page"]]
        self.lengths, n = value["length"], len(frame)
        self.gap = [0] * n  # the blank between an element and the one before
        self.joins = [0] * n  # 0: never, 1: to a run that is long enough, 2: to any run; the page must fit as well
        for i in range(1, n):
            self.gap[i] = int(not value["closes"][i] and not (value["tail_wide"][i - 1] and value["head_wide"][i]))
            if value["plain"][i - 1] and value["plain"][i] and not value["apart"][i]:
                self.joins[i] = 2 if value["ends_colon"][i - 1] or value["starts_colon"][i] else int(not value["ended"][i - 1])
        self.never = [i for i in range(self.halo, n) if not self.joins[i]]
        self.paged = [i for i in range(self.halo, n) if self.pages[i] is not None]
        self.other = {}  # of a paged element, the next one with another page
        for i, j in zip(reversed(self.paged), [None, *reversed(self.paged)]):
            self.other[i] = None if j is None else j if self.pages[j] != self.pages[i] else self.other[j]

    def refused(self, page, length: int, start: int) -> tuple[int, int]:
        """Where the run (first page, length so far) that comes to start is refused, and its length by then, up to GOES_ON."""
        n = len(self.ords)
        at = bisect_left(self.never, start)
        end = self.never[at] if at < len(self.never) else n
        if page is not None:
            at = bisect_left(self.paged, start)
            k = self.paged[at] if at < len(self.paged) else None
            k = k if k is None or self.pages[k] != page else self.other[k]
            end = min(end, n if k is None else k)
        i = start
        while i < end and length < GOES_ON:
            if self.joins[i] == 1:
                return i, length
            length += self.gap[i] + self.lengths[i]
            i += 1
        return end, min(length, GOES_ON)

    def runs(self, page, length: int, first: int | None) -> tuple[list[int], tuple]:
        """The ord at which the run of each element begins, and the run that leaves: its page, length and first ord."""
        n, i, out = len(self.ords), self.halo, []
        if first is None and i < n:
            page, length, first = self.pages[i], min(self.lengths[i], GOES_ON), self.ords[i]
            out.append(first)
            i += 1
        while i < n:
            end, length = self.refused(page, length, i)
            out += [first] * (end - i)
            if end < n:
                page, length, first = self.pages[end], min(self.lengths[end], GOES_ON), self.ords[end]
                out.append(first)
            i = end + 1
        return out, (page, length, first)

    def summary(self) -> list[tuple]:
        """(page class, page, length) of an entering run and (page, length, first) of the leaving one, whose first is NULL where it is the same run.

        Entering pages behave alike but for three classes: none, that of the first paged element, any other.
        """
        own = self.pages[self.paged[0]] if self.paged else None
        out, tails = [], {}
        for kind, page in (("none", None), ("own", own), ("other", object())):
            if kind == "own" and own is None:
                continue
            for length in range(1, GOES_ON + 1):
                end, grown = self.refused(page, length, self.halo)
                if end == len(self.ords):
                    out.append((kind, own, length, None, grown, None))
                    continue
                if end not in tails:
                    tails[end] = self._from(end)
                out.append((kind, own, length, *tails[end]))
        return out

    def _from(self, i: int) -> tuple:
        n = len(self.ords)
        while True:
            page, first = self.pages[i], self.ords[i]
            end, length = self.refused(page, min(self.lengths[i], GOES_ON), i + 1)
            if end >= n:
                return page, length, first
            i = end


def merge_adjacent_paragraphs(elements: DataFrame, size: int = 4096) -> DataFrame:
    """doc_id, ord (of the first element), label, text, page, merged (number of elements).

    A paragraph joins the run of paragraphs before it on the same page (that of the run's first element; none fits all),
    unless it is a longer text that looks like a title, row or item: where a colon ends the run or starts the paragraph, or
    where the run has no sentence end and at least five characters. A blank stands between the parts but before closing marks
    and between two characters beyond ASCII. Empty paragraphs and other elements stand alone, unchanged.
    """
    parts = _signs(elements, size)
    keys = ["doc_id", "part"]
    schema = "doc_id {0}, part long, kind string, own {1}, length_in int, page {1}, length int, first long".format(*(elements.schema[c].dataType.simpleString() for c in ("doc_id", "page")))

    def summarised(key, frame):
        found = _Range(frame, size).summary()
        return pd.DataFrame([(*key, *row) for row in found], columns=["doc_id", "part", "kind", "own", "length_in", "page", "length", "first"]).astype({"first": "Int64"})

    def composed(key, frame):
        by_part, out, state = {}, [], (None, 0, None)
        for row in frame.itertuples(index=False):
            by_part.setdefault(row.part, {})[row.kind, row.length_in] = row
        for part in sorted(by_part):
            out.append((key[0], part, *state))
            table = by_part[part]
            own = next((r.own for (kind, _), r in table.items() if kind == "own"), None)
            kind = "none" if state[0] is None else "own" if own is not None and state[0] == own else "other"
            row = table[kind, max(state[1], 1)]
            state = (state[0], row.length, state[2]) if pd.isna(row.first) else (None if pd.isna(row.page) else row.page, row.length, row.first)
        return pd.DataFrame(out, columns=["doc_id", "part", "page_in", "length_in", "first_in"]).astype({"first_in": "Int64"})

    entry = "doc_id {0}, part long, page_in {1}, length_in int, first_in long".format(*(elements.schema[c].dataType.simpleString() for c in ("doc_id", "page")))
    entering = parts.groupBy(*keys).applyInPandas(summarised, schema).groupBy("doc_id").applyInPandas(composed, entry)

    def placed(key, frame, entered):
        state = entered.iloc[0] if len(entered) else None
        page, length, first = (None, 0, None) if state is None or pd.isna(state["first_in"]) else (None if pd.isna(state["page_in"]) else state["page_in"], int(state["length_in"]), int(state["first_in"]))
        found = _Range(frame, size)
        starts, _ = found.runs(page, length, first)
        return pd.DataFrame({"doc_id": [key[0]] * len(starts), "ord": found.ords[found.halo :], "first": starts})

    runs = parts.groupBy(*keys).cogroup(entering.groupBy(*keys)).applyInPandas(placed, "doc_id {0}, ord long, first long".format(elements.schema["doc_id"].dataType.simpleString()))
    runs = runs.withColumnsRenamed({"doc_id": "run_doc", "ord": "run_ord"})
    rows = elements.select("doc_id", "ord", "label", "text", "page").join(runs, F.col("doc_id").eqNullSafe(F.col("run_doc")) & (F.col("ord") == F.col("run_ord")))
    several = rows.groupBy("doc_id", "first").agg(F.array_sort(F.collect_list(F.struct("ord", "label", "text", "page"))).alias("x"))

    def spaced(x: Column, i: Column) -> Column:
        before, own = stripped(F.get(F.col("x"), i - 1)["text"]), stripped(x["text"])
        head, tail = F.substring(own, 1, 1), F.substring(before, -1, 1)
        none = F.array_contains(F.array(*map(F.lit, CLOSERS)), head) | ((F.ascii(head) > 127) & (F.ascii(tail) > 127))
        return F.when(i == 0, F.regexp_replace(x["text"], r"(?U)\s+$", "")).otherwise(F.concat(F.when(none, F.lit("")).otherwise(F.lit(" ")), own))

    joined = F.array_join(F.transform("x", spaced), "")
    head = F.get("x", F.lit(0))
    return several.select("doc_id", F.col("first").alias("ord"), head["label"].alias("label"), F.when(F.size("x") > 1, joined).otherwise(head["text"]).alias("text"), head["page"].alias("page"), F.size("x").alias("merged"))
