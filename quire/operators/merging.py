"""Records of any schema: cleaning, identity, and merging by sequence, as columns made from the record's type.

Merging keeps what comes first but for two things: of strings the longest stays (without the white space at its ends; the
earlier of equals), and lists and records grow by what later ones add. Nothing that is empty replaces anything. The result of
records in a row merges with that of the next ones, so a key's records are merged in ranges of their sequence first, and no
task holds them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import stripped, visible_ends

#: Fields that say nothing about an object.
BESIDES = ("id", "evidence_element_ids")


def plain(text: Column) -> Column:
    """In lower case, with single blanks for white space of any kind; empty for NULL."""
    return F.lower(stripped(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?U)\s+", " ")))


def _if(value: Column, says) -> Column:
    """The value where it passes, else NULL. It is made once; named twice in a condition, nested values would be made 2^depth times."""
    return F.get(F.filter(F.array(value), says), F.lit(0))


def cleaned(value: Column, kind: T.DataType) -> Column:
    """Strings without white space at their ends; strings, lists and records that say nothing are NULL, and gone from lists."""
    if isinstance(kind, T.StringType):
        return F.when(visible_ends(value), value).otherwise(F.nullif(stripped(value), F.lit("")))
    if isinstance(kind, T.ArrayType):
        kept = F.filter(F.transform(value, lambda x: cleaned(x, kind.elementType)), lambda x: x.isNotNull())
        return _if(kept, lambda x: F.size(x) > 0)
    if isinstance(kind, T.StructType):
        fields = F.struct(*(cleaned(value[f.name], f.dataType).alias(f.name) for f in kind))
        return _if(fields, lambda x: _any([x[f.name] for f in kind]))
    return value


def cleaned_records(rows: DataFrame, item: str = "item") -> DataFrame:
    """The rows with their cleaned records, of which those stay that say something. Fields are columns until they are clean: Spark compiles these."""
    kind = rows.schema[item].dataType
    names = [f"_cleaned_{k}" for k in range(len(kind))]
    fields = [cleaned(F.col(item)[f.name], f.dataType).alias(n) for f, n in zip(kind, names, strict=True)]
    others = [c for c in rows.columns if c != item]
    said = _any([F.col(n) for f, n in zip(kind, names, strict=True) if f.name not in BESIDES])
    record = F.struct(*(F.col(n).alias(f.name) for f, n in zip(kind, names, strict=True)))
    return rows.select(*others, *fields).where(said).select(*(record.alias(c) if c == item else c for c in rows.columns))


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, (c.isNotNull() for c in columns), F.lit(False))


def says_something(item: Column, kind: T.StructType) -> Column:
    """Whether a cleaned record has more than its id and evidence."""
    return F.coalesce(_any([item[f.name] for f in kind if f.name not in BESIDES]), F.lit(False))


def _by_name(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.ArrayType, T.StructType)):
        return F.transform(value, lambda x: _by_name(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_by_name(value[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name))))
    return value


def canonical(item: Column, kind: T.StructType) -> Column:
    """The record as JSON with its fields in order of their names, at every depth; missing fields are left out."""
    return F.to_json(_by_name(item, kind))


def identity(slot: Column, item: Column, kind: T.StructType) -> Column:
    """The key under which a cleaned record merges with others: its name with the first type that it gives, else its id, else all it says.

    Records of the slot entities are told apart by their entity_type alone, given or not.
    """
    def said(field: str) -> Column:
        return plain(item[field]) if field in kind.names else F.lit("")

    typed = [F.nullif(said(f.name), F.lit("")) for f in kind if f.name.endswith("_type") and f.name != "doc_type"]
    name, own = said("name"), said("id")
    label = F.when(slot == "entities", F.concat_ws("::", F.lit("entity"), said("entity_type"))).otherwise(F.concat_ws("::", slot, F.coalesce(*typed, F.lit("name"))))
    return F.when(name != "", F.concat_ws("::", label, name)).when(own != "", F.concat(F.lit("id::"), own)).otherwise(F.concat(F.lit("raw::"), canonical(item, kind)))


def longest(value: Column, order: Column) -> Column:
    """Aggregate: the string that is longest without the white space at its ends, the earliest of equals; never an empty one."""
    length = F.when(visible_ends(value), F.length(value)).otherwise(F.length(stripped(value)))
    return F.max_by(value, F.when(value != "", F.struct(length, -order)))


def _alone(value: Column, kind: T.DataType) -> Column:
    """What merging makes of a single value: empty strings are none."""
    if isinstance(kind, T.StringType):
        return F.nullif(value, F.lit(""))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_alone(value[f.name], f.dataType).alias(f.name) for f in kind)))
    return value


def _together(values: Column, kind: T.DataType) -> Column:
    """The values of an array merged in their order.

    Of strings the one that is longest without the white space at its ends, the earlier of equals; of lists one after the
    other with each element where it comes first, a single one as it is; of other values the first.
    """
    given = F.filter(values, lambda x: x.isNotNull())
    if isinstance(kind, T.StringType):
        sizes = F.transform(values, lambda x, i: F.when(x != "", F.struct(F.length(stripped(x)).alias("size"), (-i).alias("place"), x.alias("text"))))
        return F.array_max(sizes)["text"]
    if isinstance(kind, T.ArrayType):
        def joined(lists: Column) -> Column:
            every = F.flatten(lists)
            return F.when(F.size(lists) == 1, every).when(F.size(every) > 0, F.array_distinct(every))

        return F.get(F.transform(F.array(given), joined), F.lit(0))
    if isinstance(kind, T.StructType):
        return F.when(F.size(given) > 0, F.struct(*(_together(values[f.name], f.dataType).alias(f.name) for f in kind)))
    return F.get(given, F.lit(0))


def _one_level(rows: DataFrame, keys: tuple[str, ...], item: str) -> DataFrame:
    """keys, _at, item, first_seq, candidates: the records that share the keys merged by _at. Most are alone, and these are only handed on."""
    kind = rows.schema[item].dataType
    found = rows.groupBy(*keys).agg(F.min("_at").alias("_at"), F.min("first_seq").alias("first_seq"), F.sum("candidates").alias("candidates"), F.collect_list(F.struct("_at", F.col(item).alias("item"))).alias("_x"))
    ordered = F.array_sort("_x", lambda a, b: F.when(a["_at"] < b["_at"], -1).when(a["_at"] > b["_at"], 1).otherwise(0))
    found = found.withColumn("_x", F.when(F.size("_x") > 1, ordered).otherwise(F.col("_x"))["item"])
    merged = F.when(F.size("_x") == 1, _alone(F.get("_x", F.lit(0)), kind)).otherwise(_together(F.col("_x"), kind))
    return found.select(*keys, "_at", "first_seq", merged.alias(item), "candidates")


def merge_records(rows: DataFrame, keys: tuple[str, ...], item: str = "item", order: str = "seq", width: int = 1000) -> DataFrame:
    """keys, first_seq, item, candidates: the records of each key merged by order, which is whole and unique within a key.

    A row gathers the records of a range of width numbers, then what these make of a key. A list keeps its distinct elements,
    so a merged record is as long as what it says.
    """
    found = rows.select(*keys, F.floor(F.col(order) / width).alias("_range"), F.col(order).alias("_at"), F.col(order).alias("first_seq"), F.col(item), F.lit(1).cast("long").alias("candidates"))
    return _one_level(_one_level(found, (*keys, "_range"), item), keys, item).select(*keys, "first_seq", item, "candidates")
