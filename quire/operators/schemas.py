"""Document types: the fields and slots that each has, the rules for whoever fills them, and allowed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import stripped

_NODE = "id string, name string, evidence_element_ids array<string>"
_DOCUMENT = "doc_id string, title string, doc_type string, version string"
# The record types of the slots and the other fields of the five document types.
SLOTS = {
    "functional_requirements": f"array<struct<{_NODE}, points array<string>, actor string, priority string, acceptance_criteria string>>",
    "non_functional_requirements": f"array<struct<{_NODE}, category string, description string>>",
    "business_flows": f"array<struct<{_NODE}, actor string, steps array<string>, outcome string>>",
    "modules": f"array<struct<{_NODE}, description string, responsibilities array<string>>>",
    "core_flows": f"array<struct<{_NODE}, participants array<string>, steps array<string>, outcome string>>",
    "design_decisions": f"array<struct<{_NODE}, decision string, rationale string, tradeoffs array<string>>>",
    "apis": f"array<struct<{_NODE}, method string, path string, description string, request_parameters array<struct<name string, type string, required boolean, description string>>, response_fields array<struct<name string, type string, description string>>, error_codes array<struct<code string, message string>>>>",
    "test_cases": f"array<struct<{_NODE}, priority string, preconditions array<string>, steps array<struct<step_no int, action string, expected_result string>>, expected_result string>>",
    "tables": f"array<struct<{_NODE}, comment string, fields array<struct<name string, type string, primary_key boolean, nullable boolean, comment string>>>>",
}
TYPES = {
    "srs": ("system_name string, target_users array<string>", ("functional_requirements", "non_functional_requirements", "business_flows")),
    "hld": ("architecture_style string, technology_stack array<string>", ("modules", "core_flows", "design_decisions")),
    "api": ("base_url string", ("apis",)),
    "tc": ("test_scope string", ("test_cases",)),
    "dbdd": ("db_name string, db_type string", ("tables",)),
}
# What every contract says, and sections that no request holds.
RULES = (
    "只抽取当前输入中明确出现的对象。不要编造或推断原文没有的内容。",
    "保持原文的聚合粒度。不要将同一编号、同一标题或同一表格行下的多个指标拆分为独立对象，也不要把多个独立条目合并为一个。",
    "evidence_element_ids 只使用 [ELEMENT: ...] 标记中的元素 ID。",
    "evidence_element_ids 只保留能直接支撑对象存在、定义或关键约束的高价值元素。",
    "只返回目标对象槽位；未出现的对象槽返回空列表。",
)
IGNORED = ("术语表", "术语定义", "参考资料", "参考文献", "附录", "references", "glossary")
# Categories of non-functional requirements, and their Chinese names.
CATEGORIES = {"性能": "performance", "安全": "security", "可用性": "availability", "兼容性": "compatibility", "可维护性": "maintainability", "合规": "compliance", "存储": "storage", "可扩展性": "scalability"}


def schema_of(doc_type: str) -> T.StructType:
    fields, slots = TYPES[doc_type]
    return T.StructType.fromDDL(", ".join([_DOCUMENT, fields, *(f"{s} {SLOTS[s]}" for s in slots)]))


def all_schemas() -> dict[str, T.StructType]:
    """The schema of each document type; needs a session, as Spark reads the types."""
    return {t: schema_of(t) for t in TYPES}


def document_type(value: Column) -> Column:
    """The document type of a text in any case and with blanks around it; NULL for others."""
    plain = F.lower(stripped(value))
    return F.when(plain.isin(*TYPES), plain)


def category(value: Column) -> Column:
    """The category of a text: its Chinese name, or its English one in any case; other for the rest and for NULL."""
    plain = stripped(value)
    named = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))[plain]
    return F.coalesce(named, F.when(F.lower(plain).isin(*CATEGORIES.values()), F.lower(plain)), F.lit("other"))
