"""Markdown lines to blocks: every line gets a number that says what it is on its own, and one walk over the numbers of a
document looks at neighbours and finds the blocks.

A document stays one row, as it comes, from its lines to its blocks: nothing is sorted or shuffled on the way. Lines that are
rows of their own are gathered by document first. White space is that of Unicode.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# The line patterns, for stripped lines: what is said goes to the end, so no pattern looks for the end at each character.
HEADING = r"(?U)^(#{1,6})\s+(.+)$"
NUMBERED = r"(?U)^(\d+(?:\.\d+)*)\.?\s+(.+)$"
ITEM = r"(?U)^([-+*]|\d+\.)\s+(.+)$"
BREAK = r"^(?:-{3,}|\*{3,}|_{3,})$"
ROW = r"^\|.*\|$"
SEPARATOR = r"(?U)^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$"
FENCE = r"^(`{3,}|~{3,})"
#: Ends of a line that is no numbered heading, and of a line before one that introduces a list.
SENTENCE_END, COLON = r"[.:;!?。：；！？]$", r"[:：]$"

# Element types by block type.
ELEMENT_TYPES = {"title": "heading", "paragraph": "paragraph", "quote": "paragraph", "section_break": "separator", "code": "code", "list": "paragraph", "table": "table", "image": "image"}

# Titles in a requirements document that name a field of a requirement.
FIELD_LABELS = ("需求编号", "需求描述", "优先级", "功能点", "验收标准")
#: Levels of titles, and so the depth of a path.
DEPTH = 6

_TYPES = ("title", "section_break", "code", "table", "list", "quote", "paragraph")
_LABELS = ("heading", "break", "fence", "table", "item", "quote", "text", "blank")
# Bits of a line's number; then the signed length of its fence, and the first of its section numbers and 1.
_BLANK, _MARKED, _BREAK, _FENCE, _ROW, _SEPARATOR, _ITEM, _QUOTE, _INDENTED, _COLON, _NUMBERED, _SINGLE = (1 << k for k in range(12))
_RUN, _NUMBER, _LONGEST = 12, 26, 4000

#: White space of Unicode.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_SPAN = T.StructType([T.StructField(name, T.IntegerType()) for name in ("type", "first", "n", "closed")])


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def visible_ends(text: Column) -> Column:
    """Whether a text begins and ends with a visible character of ASCII, as most do: then it needs no stripping."""
    return F.substring(text, 1, 1).between("!", "~") & F.substring(text, -1, 1).between("!", "~")


def _body(line: Column) -> Column:
    """The stripped line."""
    return F.when((line == "") | visible_ends(line), line).otherwise(stripped(line))


def _number_and_title(body: Column) -> tuple[Column, Column]:
    return F.regexp_extract(body, NUMBERED, 1), F.regexp_extract(body, NUMBERED, 2)


def _re2(pattern: str) -> str:
    """A line pattern for Arrow's matcher, which knows white space and digits of ASCII only, and one line end."""
    return pattern.replace("(?U)", "").replace(".+", f"{_SAID}+").replace(".*", f"{_SAID}*").replace(r"\s", f"[{_SPACES}]").replace(r"\d", r"\p{Nd}")


_SAID = "[^\n\r\x85\u2028\u2029]"
#: What a line may be by its first character.
_FITS = (("|", ROW, _ROW), ("|-*_+:", SEPARATOR, _SEPARATOR), ("#", HEADING, _MARKED), ("-*_+:", BREAK, _BREAK), ("-*+0123456789", ITEM, _ITEM))


def _valid(lines: pa.Array) -> pa.Array:
    """The lines without bytes that are no UTF-8, and a NULL as text that says nothing."""
    try:
        lines.validate(full=True)
    except pa.ArrowInvalid:
        lines = pa.array([None if x is None else x.decode("utf-8", "replace") for x in lines.cast(pa.binary()).to_pylist()], pa.string())
    return pc.fill_null(lines, "a")


def _codes(lines: pa.Array) -> np.ndarray:
    """What each line is on its own, as a number. A line's first character tells which patterns it may fit."""
    lines = _valid(lines)
    body = pc.utf8_trim(lines, _SPACES)
    ends = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1]
    empty = ends[1:] == ends[:-1]
    first = np.append(np.frombuffer(body.buffers()[2] or b"", np.uint8), 0)[ends[:-1]]
    first[empty] = 0
    bits = lambda found, bit: np.asarray(found).astype(np.int64) * bit
    x = bits(pc.or_(pc.starts_with(lines, "  "), pc.starts_with(lines, "\t")), _INDENTED) + bits(pc.or_(pc.ends_with(body, ":"), pc.ends_with(body, "：")), _COLON)
    x += bits(empty, _BLANK) + bits(first == ord(">"), _QUOTE) + ((_LONGEST + 96) << _RUN)
    other = np.flatnonzero(first >= 128)
    other = other[np.asarray(pc.match_substring_regex(body.take(pa.array(other)), r"^\p{Nd}"), bool)]
    for chars, pattern, bit in _FITS:
        rows = np.flatnonzero(np.isin(first, np.frombuffer(chars.encode(), np.uint8)))
        rows = np.append(rows, other) if "0" in chars else rows
        x[rows] += bits(pc.match_substring_regex(body.take(pa.array(rows)), _re2(pattern)), bit)
    for mark, sign in (("`", 1), ("~", -1)):
        rows = np.flatnonzero(first == ord(mark))
        begun = body.take(pa.array(rows))
        run = np.asarray(pc.binary_length(begun)).astype(np.int64) - np.asarray(pc.binary_length(pc.utf8_ltrim(begun, mark)))
        x[rows] += np.where(run >= 3, sign * np.minimum(run, _LONGEST) * (1 << _RUN) + _FENCE, 0)
    rows = np.append(np.flatnonzero((first >= 48) & (first <= 57)), other)
    numbered = pc.extract_regex(body.take(pa.array(rows)), _re2(NUMBERED).replace("(", "(?P<number>", 1).replace(f"({_SAID}", f"(?P<words>{_SAID}"))
    some = np.asarray(pc.is_valid(numbered), bool)
    rows, numbered = rows[some], numbered.filter(pa.array(some))
    number, words = numbered.field("number"), numbered.field("words")
    leading = pc.replace_substring_regex(number, r"\..*$", "")
    value = np.fromiter((int(k) if len(k) <= 9 and max(k) <= "\uffff" else -1 for k in leading.to_pylist()), np.int64, len(leading))
    title = pc.and_(pc.less_equal(pc.utf8_length(words), 120), pc.invert(pc.match_substring_regex(words, SENTENCE_END)))
    x[rows] += (value + 1) * (1 << _NUMBER) + bits(title, _NUMBERED) + bits(pc.invert(pc.match_substring(number, ".")), _SINGLE)
    return x


def gathered(lines: DataFrame) -> DataFrame:
    """doc_id, line_nos and lines (in order) of each document, from a row for each line."""
    rows = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return rows.select("doc_id", F.col("x.line_no").alias("line_nos"), F.col("x.line").alias("lines"))


def _ends(inside: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each line and one more the first line from it on that is not inside, at most its document's end."""
    n = len(inside)
    first = np.minimum.accumulate(np.append(np.where(inside, n, np.arange(n)), n)[::-1])[::-1]
    return np.minimum(first, np.append(ends, n))


def _labelled(lines: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of all lines, where each document starts, where a line's document ends, and the label of each line.

    `1.2 Title` is a heading unless it is long or ends a sentence, follows a colon, or opens a numbered list.
    """
    starts = lines.offsets.to_numpy().astype(np.int64)
    x = _codes(lines.values.slice(starts[0], starts[-1] - starts[0]))
    starts = starts - starts[0]
    n, sizes = len(x), np.diff(starts)
    begin, end = np.repeat(starts[:-1], sizes), np.repeat(starts[1:], sizes)
    place, blank, number = np.arange(n), x & _BLANK > 0, x >> _NUMBER
    earlier = np.append(-1, np.maximum.accumulate(np.where(blank, -1, place)))[:n]
    later = _ends(blank, end)[1:]
    after_colon = (earlier >= begin) & (x[earlier] & _COLON > 0) if n else blank
    opens_list = (x & _SINGLE > 0) & (number > 0) & (later < end) & (number[np.minimum(later, n - 1)] == number + 1) if n else blank
    heading = (x & _MARKED > 0) | ((x & _NUMBERED > 0) & ~after_colon & ~opens_list)
    table = (x & _ROW > 0) & (place + 1 < end) & (np.append(x, 0)[1:] & _SEPARATOR > 0)
    label = np.select([blank, heading, x & _BREAK > 0, x & _FENCE > 0, table, x & _ITEM > 0, x & _QUOTE > 0], [7, 0, 1, 2, 3, 4, 5], 6)
    return x, starts, end, label


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _label_numbers(lines: pa.Array) -> pa.Array:
    _, starts, _, label = _labelled(lines)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(label, pa.int32()))


@F.arrow_udf(T.ArrayType(_SPAN))
def _walked(lines: pa.Array) -> pa.Array:
    """The blocks of each document: type, first line (from 1), number of lines, and whether a fence is closed."""
    x, starts, end, label = _labelled(lines)
    n, place = len(x), np.arange(len(x))
    run = (x >> _RUN & 8191) - _LONGEST - 96
    blank, item = label == 7, x & _ITEM > 0
    listed, quoted, rows = (_ends(m, end)[1:] for m in (blank | item | (x & _INDENTED > 0), x & _QUOTE > 0, x & _ROW > 0))
    said = _ends(label == 6, end)[1:]
    said = said + ((said < end) & np.append(blank, False)[said])
    # The last line of a document is followed by another document's.
    last = place + 1 == end
    listed, quoted, rows, said = (np.where(last, end, a) for a in (listed, quoted, rows, said))
    stop = np.select([label == 7, label == 3, label == 4, label == 5, label == 6], [_ends(blank, end)[:n], rows, listed, quoted, said], place + 1).tolist()
    kinds, ends, runs, fences = label.tolist(), end.tolist(), run.tolist(), np.flatnonzero(run).tolist()
    first, count, closes, i = [], [], [], 0
    while i < n:
        to, closed = stop[i], 0
        if kinds[i] == 2:
            to, fence = ends[i], runs[i]
            for k in range(bisect_right(fences, i), len(fences)):
                j = fences[k]
                if j >= to:
                    break
                if runs[j] >= fence > 0 or runs[j] <= fence < 0:
                    to, closed = j + 1, 1
                    break
        if kinds[i] != 7:
            first.append(i)
            count.append(to - i)
            closes.append(closed)
        i = to
    first = np.asarray(first, np.int64)
    own = np.searchsorted(first, starts)
    in_document = first - np.repeat(starts[:-1], np.diff(own)) + 1
    spans = pa.StructArray.from_arrays([pa.array(a, pa.int32()) for a in (label[first], in_document, count, closes)], names=_SPAN.names)
    return pa.ListArray.from_arrays(pa.array(own, pa.int32()), spans)


def _heading(body: Column) -> tuple[Column, Column]:
    """Level and title of a heading's stripped line."""
    marked, (number, words) = body.rlike(HEADING), _number_and_title(body)
    level = F.when(marked, F.length(F.regexp_extract(body, HEADING, 1))).otherwise(F.length(F.regexp_replace(number, r"[^.]", "")) + 1)
    return level, F.when(marked, F.regexp_extract(body, HEADING, 2)).otherwise(F.concat_ws(" ", number, words))


def labelled(documents: DataFrame) -> DataFrame:
    """Adds labels to doc_id, line_nos and lines: of each line the first that fits of blank, heading, break, fence, table, item, quote and text."""
    names = F.array(*map(F.lit, _LABELS))
    return documents.withColumn("labels", F.transform(_label_numbers("lines"), lambda k: F.get(names, k)))


def classify_lines(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, line, body (the stripped line), label, and level and title of headings."""
    return classified(gathered(lines))


def classified(documents: DataFrame) -> DataFrame:
    """The same from doc_id, line_nos and lines. What a label is called, and all a line says, is found in its own row, where Spark compiles it."""
    rows = documents.select("doc_id", F.explode(F.arrays_zip("line_nos", "lines", _label_numbers("lines").alias("labels"))).alias("x"))
    label = F.get(F.array(*map(F.lit, _LABELS)), F.col("x.labels"))
    rows = rows.select("doc_id", F.col("x.line_nos").alias("line_no"), F.col("x.lines").alias("line"), _body(F.col("x.lines")).alias("body"), label.alias("label"))
    level, title = _heading(F.col("body"))
    return rows.withColumns({"level": F.when(F.col("label") == "heading", level), "title": F.when(F.col("label") == "heading", title)})


def cells(row: Column) -> Column:
    """The cells of a table row, stripped."""
    return F.transform(F.transform(F.split(F.trim(row, F.lit("|")), r"\|"), lambda x: F.trim(x)), _body)


def _text(kind: Column, lines: Column, closed: Column) -> Column:
    """A table's text is its rows as written again; a list's is one line for each item and its continuations."""
    bodies = F.transform(lines, _body)
    code = F.array_join(F.slice(lines, 2, F.size(lines) - 1 - closed), "\n")
    table = F.array_join(F.transform(table_rows(lines), lambda x: F.concat(F.lit("| "), F.array_join(cells(x), " | "), F.lit(" |"))), "\n")
    # An item's own blank lines at its end go; a mark that no line holds tells where the next begins.
    items = F.array_join(F.transform(bodies, lambda x: F.when(x.rlike(ITEM), F.concat(F.lit("\r"), F.regexp_extract(x, ITEM, 2))).otherwise(x)), "\n")
    listed = F.ltrim(F.regexp_replace(F.regexp_replace(items, r"(?U)\s+$", ""), "\n*\r", "\n"), F.lit("\n"))
    quoted = F.array_join(F.transform(F.transform(bodies, lambda x: F.trim(F.substring(x, 2, 1 << 30))), _body), "\n")
    title = _heading(_body(F.get(lines, F.lit(0))))[1]
    ended = lambda text: F.regexp_replace(text, r"(?U)\s+$", "")
    return F.when(kind == 0, title).when(kind == 1, "---").when(kind == 2, ended(code)).when(kind == 3, table).when(kind == 4, listed).when(kind == 5, ended(quoted)).otherwise(F.array_join(F.filter(bodies, lambda x: x != ""), "\n"))


def table_rows(lines: Column) -> Column:
    """The stripped rows of a table without separators."""
    return F.filter(F.transform(lines, _body), lambda x: ~x.rlike(SEPARATOR))


def _let(make, **values) -> Column:
    """make of a record of values, which are made once for a document; else Spark would put their expressions wherever they are named."""
    record = F.struct(*(F.col(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in values.items()))
    return F.get(F.transform(F.array(record), make), F.lit(0))


def rows_of(found: DataFrame, column: str, key: str) -> DataFrame:
    """A row for each record of an array; key is never NULL there. An inner explode would make the array once more for its filter."""
    return found.select("doc_id", F.inline_outer(column)).where(F.col(key).isNotNull())


def _numbered(spans: Column, kinds: tuple[str, ...]) -> Column:
    every = F.transform(spans, lambda s, i: F.struct(i.alias("block_no"), s.alias("s")))
    return F.filter(every, lambda x: x.s.type.isin(*map(_TYPES.index, kinds)))


def _cut(lines: Column, span: Column) -> Column:
    """The lines of a span; F.slice would copy all lines of the document for each."""
    return F.transform(F.sequence(span.first - 1, span.first + span.n - 2), lambda i: F.get(lines, i))


def _spans(documents: DataFrame) -> DataFrame:
    """Adds spans (see _walked)."""
    return documents.withColumn("spans", _walked("lines"))


def block_rows(documents: DataFrame, kinds: tuple[str, ...] = _TYPES) -> DataFrame:
    """doc_id, block_no, type, level, text, line_start, line_end, ordered (of lists), language (of code): a row for each block of
    those types, from doc_id, line_nos and lines. A document without lines to say has no blocks.

    A document only cuts its lines; what a block says is found in the block's own row, where Spark compiles it.
    """
    def every(d: Column) -> Column:
        return F.transform(_numbered(d.spans, kinds), lambda x: F.struct(x.block_no.alias("block_no"), x.s.type.alias("kind"), x.s.closed.alias("closed"), F.get(d.line_nos, x.s.first - 1).alias("line_start"), F.get(d.line_nos, x.s.first + x.s.n - 2).alias("line_end"), _cut(d["lines"], x.s).alias("lines")))

    cut = rows_of(_spans(documents).select("doc_id", _let(every, lines="lines", line_nos="line_nos", spans="spans").alias("blocks")), "blocks", "block_no")
    kind, lines, opening = F.col("kind"), F.col("lines"), _body(F.get("lines", F.lit(0)))
    level = F.when(kind == 0, _heading(opening)[0])
    ordered = F.when(kind == 4, F.exists(lines, lambda l: _body(l).rlike(r"^\d+\.\s")))
    language = F.when(kind == 2, stripped(F.regexp_replace(opening, FENCE, "")))
    names = F.array(*map(F.lit, _TYPES))
    return cut.select("doc_id", "block_no", F.get(names, kind).alias("type"), level.alias("level"), _text(kind, lines, F.col("closed")).alias("text"), "line_start", "line_end", ordered.alias("ordered"), language.alias("language"))


def blocks(lines: DataFrame) -> DataFrame:
    """The blocks of lines that are rows (see block_rows)."""
    return block_rows(gathered(lines))


def table_cells(documents: DataFrame) -> DataFrame:
    """doc_id, block_no, row_no, col_no (from 1) and cell of every table, from doc_id, line_nos and lines."""
    def tables(d: Column) -> Column:
        return F.transform(_numbered(d.spans, ("table",)), lambda x: F.struct(x.block_no.alias("block_no"), table_rows(_cut(d["lines"], x.s)).alias("rows")))

    found = rows_of(_spans(documents).select("doc_id", _let(tables, lines="lines", spans="spans").alias("tables")), "tables", "block_no")
    rows = found.select("doc_id", "block_no", F.posexplode("rows").alias("row_no", "row"))
    parts = rows.select("doc_id", "block_no", (F.col("row_no") + 1).cast("long").alias("row_no"), F.posexplode(cells(F.col("row"))).alias("col_no", "cell"))
    return parts.withColumn("col_no", (F.col("col_no") + 1).cast("long"))


def document_title(documents: DataFrame) -> DataFrame:
    """doc_id, title: the first title of level 1, else a first block that is one short paragraph line; else NULL; from doc_id and lines."""
    def opening(d: Column, span: Column) -> Column:
        return _body(F.get(d["lines"], span.first - 1))

    def lines_of(d: Column) -> Column:
        titles = F.transform(F.filter(d.spans, lambda s: s.type == _TYPES.index("title")), lambda s: opening(d, s))
        head = F.get(d.spans, F.lit(0))
        plain = F.filter(F.transform(_cut(d["lines"], head), _body), lambda x: x != "")
        short = F.when(head.type == _TYPES.index("paragraph"), F.array_join(plain, "\n"))
        return F.when(F.size(d.spans) > 0, F.struct(F.get(F.filter(titles, lambda x: _heading(x)[0] == 1), F.lit(0)).alias("one"), short.alias("head")))

    found = _spans(documents).select("doc_id", F.explode_outer(F.array(_let(lines_of, lines="lines", spans="spans"))).alias("x")).where("x is not null")
    head = F.when((F.length("x.head") <= 120) & ~F.col("x.head").contains("\n"), F.col("x.head"))
    return found.select("doc_id", F.coalesce(F.when(F.col("x.one").isNotNull(), _heading(F.col("x.one"))[1]), head).alias("title"))


def is_field_label(title: Column) -> Column:
    """Whether a title only names a field of a requirement, whatever marks, emphasis or colon it has."""
    plain = F.regexp_replace(F.regexp_replace(title, r"(?U)^[#\s]+", ""), "[*_]", "")
    return stripped(F.regexp_replace(stripped(plain), r"(?U)[\s:：]+$", "")).isin(*FIELD_LABELS)


def section_paths(found: DataFrame) -> DataFrame:
    """Adds section_path to the blocks: the titles above, of which a title of level n leaves n - 1 and then adds itself.

    The i-th title so stands at depth min(depth before + 1, level), which is i plus the least of 0 and level - number so far:
    a running minimum. The title at each depth is the last one there. Where the blocks have a doc_type, titles of srs that
    only name a field open no section.
    """
    order = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    # What a title says is a column below the windows, so that it is made once.
    found = found.withColumn("_said", F.when(F.col("type") == "title", _body(F.col("text"))))
    opens = F.col("_said") != ""
    if "doc_type" in found.columns:
        opens = opens & ~F.coalesce((F.lower("doc_type") == "srs") & is_field_label(F.col("_said")), F.lit(False))
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(DEPTH))
    rows = found.withColumn("opens", F.coalesce(opens, F.lit(False))).withColumn("number", F.sum(F.col("opens").cast("int")).over(order))
    rows = rows.withColumn("depth", F.col("number") + F.least(F.lit(0), F.coalesce(F.min(F.when(F.col("opens"), level - F.col("number"))).over(order), F.lit(0))))
    # Between two titles the number stands still, and so does the depth.
    titles = F.array(*(F.last(F.when(F.col("opens") & (F.col("depth") == d), F.col("_said")), ignorenulls=True).over(order) for d in range(1, DEPTH + 1)))
    return rows.withColumn("section_path", F.slice(titles, 1, F.col("depth").cast("int"))).drop("_said", "opens", "number", "depth")


def elements(sectioned: DataFrame) -> DataFrame:
    """doc_id, ord (dense, from 0), element_id, element_type, text, section_path of the blocks that say something."""
    kind = F.create_map(*(F.lit(x) for pair in ELEMENT_TYPES.items() for x in pair))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no"))
    kept = sectioned.where("text <> ''").withColumn("ord", (n - 1).cast("long"))
    return kept.select("doc_id", "ord", F.format_string("el-%04d", F.col("ord") + 1).alias("element_id"), F.coalesce(kind[F.col("type")], F.lit("paragraph")).alias("element_type"), "text", "section_path")


def drop_ignored(items: DataFrame, ignored: tuple[str, ...]) -> DataFrame:
    """Drops elements whose lower-cased path holds an ignored term; adds group_no, which grows over each dropped run."""
    path = F.lower(F.array_join("section_path", " > "))
    hit = F.exists(F.array(*map(F.lit, ignored)), lambda t: path.contains(t))
    order = Window.partitionBy("doc_id").orderBy("ord")
    rows = items.withColumn("hit", hit)
    opens = (~F.col("hit") & F.coalesce(F.lag("hit").over(order), F.lit(True))).cast("long")
    return rows.withColumn("opens_group", opens).withColumn("group_no", F.sum("opens_group").over(order)).where(~F.col("hit")).drop("hit", "opens_group")
