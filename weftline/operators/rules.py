"""Rules for whole items and envelopes as JSON: field kinds by type, compiled to predicates over a VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.schema import ARRAY_KEYS, AUTHORITY, SENSITIVITY

#: Field kinds. "a|b" is one of these texts, "0..1" a number in this range, a ? allows null.
BASE = {
    "id": "text+", "@type": "type", "content": "text", "status": "confirmed|unconfirmed|disputed|retracted|superseded", "priority": "0..100", "relevance": "0..1", "scope": "set", "validFrom": "time", "validUntil": "time?",
    "source": "object", "trust": "object", "sensitivity": "object", "tags": "set", "relationships": "list", "tokenEstimate": "0..", "extensions": "object",
}
OWN = {
    "Objective": {"summary": "text", "successCriteria": "texts", "nonGoals": "texts"},
    "Task": {"name": "text+", "taskStatus": "pending|in-progress|blocked|completed|cancelled", "parentTaskId": "text?"},
    "Actor": {"role": "text+", "displayName": "text", "actorType": "human|ai-agent|system|organization"},
    "Entity": {"name": "text+", "entityType": "text+", "properties": "object", "sameAs": "list"},
    "Relationship": {"subjectId": "text+", "predicate": "text+", "objectId": "text+", "confidence": "0..1"},
    "Instruction": {"authority": "|".join(AUTHORITY), "conflictsWith": "texts", "precedenceNotes": "text"},
    "Fact": {},
    "Assumption": {},
    "Constraint": {"constraintType": "must|must-not|should|should-not"},
    "Preference": {"strength": "0..1"},
    "Decision": {"decidedBy": "text", "decidedAt": "time", "rationale": "text", "reversible": "boolean"},
    "Question": {"askedBy": "text", "resolved": "boolean", "answer": "text?"},
    "ConversationMessage": {"role": "user|assistant|system|tool", "name": "text", "timestamp": "time", "toolCallId": "text"},
    "MemoryItem": {"memoryType": "episodic|semantic|procedural|profile", "importance": "0..1", "lastAccessedAt": "time", "decay": "0..1"},
    "Resource": {"uri": "uri", "mimeType": "text", "title": "text", "encoding": "utf-8|base64"},
    "ToolDefinition": {"name": "text+", "description": "text", "inputSchema": "object", "outputSchema": "object", "sideEffects": "none|read-only|write|external"},
    "ToolResult": {"toolCallId": "text", "toolName": "text+", "outcome": "success|error", "output": "any", "error": "text"},
    "ContextSummary": {"summarizedItemIds": "texts", "method": "text"},
}
REQUIRED = {
    "Task": ("name",), "Actor": ("role",), "Entity": ("name", "entityType"), "Relationship": ("subjectId", "predicate", "objectId"), "Instruction": ("authority", "content"), "Fact": ("content",), "Assumption": ("content",),
    "Constraint": ("content", "constraintType"), "Preference": ("content",), "Decision": ("content",), "Question": ("content", "resolved"), "ConversationMessage": ("role", "content"), "MemoryItem": ("content", "memoryType"),
    "ToolDefinition": ("name",), "ToolResult": ("toolName", "outcome", "output"), "ContextSummary": ("content", "summarizedItemIds"),
}
TYPE_OF_ARRAY = dict(zip(ARRAY_KEYS, ("Actor", "Instruction", "Fact", "Assumption", "Constraint", "Preference", "Decision", "Question", "ConversationMessage", "Resource", "Entity", "Relationship", "MemoryItem", "ToolDefinition", "ToolResult"), strict=True))
ENVELOPE = {"@context": "any", "@type": "ContextEnvelope|ContextEnvelope", "schemaVersion": "version", "id": "text+", "createdAt": "time", "updatedAt": "time", "objective": "object", "outputContract": "object", "security": "object", "tokenPolicy": "object", "summary": "object?", "errors": "list", "extensions": "object", **dict.fromkeys(ARRAY_KEYS, "list")}
ENVELOPE_REQUIRED = ("@context", "@type", "schemaVersion", "id", "createdAt")

_TIME = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
_URI = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]*$"
_TYPE = r"^([A-Z][A-Za-z0-9]*|x-[a-z0-9-]+:[A-Za-z][A-Za-z0-9]*)$"
_VERSION = r"^\d+\.\d+\.\d+(-[0-9A-Za-z-.]+)?(\+[0-9A-Za-z-.]+)?$"

Wrong = tuple[Column, str, str]  # predicate, path, keyword


def _shape(v: Column) -> Column:
    return F.schema_of_variant(v)


def field_rules(v: Column, keys: Column, field: str, kind: str) -> list[Wrong]:
    """What is wrong with one field of v, if it is there."""
    if kind == "any":
        return []
    there = F.array_contains(keys, field)
    value, at = F.try_variant_get(v, f"$['{field}']", "variant"), f"/{field.replace('~', '~0').replace('/', '~1')}"
    shape, text = _shape(value), F.try_variant_get(v, f"$['{field}']", "string")
    null = shape == "VOID"
    if kind.endswith("?"):
        return [(there & ~null & w, p, k) for w, p, k in field_rules(v, keys, field, kind[:-1])]
    is_text = shape == "STRING"
    if kind == "boolean":
        return [(there & (shape != "BOOLEAN"), at, "type")]
    if kind == "object":
        return [(there & ~F.startswith(shape, F.lit("OBJECT")), at, "type")]
    if kind in ("list", "set", "texts"):
        out = [(there & ~F.startswith(shape, F.lit("ARRAY")), at, "type")]
        if kind != "list":
            values = F.try_variant_get(v, f"$['{field}']", "array<variant>")
            out.append((there & F.exists(values, lambda x: _shape(x) != "STRING"), at, "items"))
        if kind == "set":
            texts = F.try_variant_get(v, f"$['{field}']", "array<string>")
            out += [(there & (F.size(texts) != F.size(F.array_distinct(texts))), at, "uniqueItems"), (there & F.array_contains(texts, ""), at, "minLength")]
        return out
    if ".." in kind:
        low, high = kind.split("..")
        number = F.when(shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, f"$['{field}']", "double"))
        out = [(there & number.isNull(), at, "type"), (there & (number < float(low)), at, "minimum")]
        return out + ([(there & (number > float(high)), at, "maximum")] if high else [])
    out = [(there & ~is_text, at, "type")]
    if "|" in kind:
        return [*out, (there & is_text & ~text.isin(*kind.split("|")), at, "enum")]
    pattern = {"time": _TIME, "uri": _URI, "type": _TYPE, "version": _VERSION}.get(kind)
    if pattern:
        out.append((there & is_text & ~text.rlike(pattern), at, "format" if kind in ("time", "uri") else "pattern"))
    if kind == "text+":
        out.append((there & is_text & (text == ""), at, "minLength"))
    return out


def _found(rules: list[Wrong]) -> Column:
    one = [F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(keyword).alias("keyword"))) for wrong, path, keyword in rules]
    return F.filter(F.array(*one), lambda x: x.isNotNull()) if one else F.expr("cast(array() as array<struct<path:string,keyword:string>>)")


def _unknown(keys: Column, allowed: list[str]) -> Column:
    return F.transform(F.array_except(keys, F.array(*map(F.lit, allowed))), lambda k: F.struct(F.concat(F.lit("/"), k).alias("path"), F.lit("unevaluatedProperties").alias("keyword")))


def _nested(v: Column) -> list[Wrong]:
    """Labels inside an item."""
    at = lambda path: F.try_variant_get(v, path, "string")
    trust, level = at("$.trust.level"), at("$.sensitivity.level")
    rules = F.try_variant_get(v, "$.sensitivity.handling", "array<variant>")
    allowed = ("allow", "redact", "summarize", "exclude", "require-consent", "local-only")
    return [
        (trust.isNotNull() & ~trust.isin("trusted", "semi-trusted", "untrusted", "unknown"), "/trust/level", "enum"),
        (F.try_variant_get(v, "$.trust", "variant").isNotNull() & trust.isNull(), "/trust/level", "required"),
        ((trust == "untrusted") & F.coalesce(F.try_variant_get(v, "$.trust.providesInstructions", "boolean"), F.lit(False)), "/trust/providesInstructions", "const"),
        (level.isNotNull() & ~level.isin(*SENSITIVITY), "/sensitivity/level", "enum"),
        (F.exists(rules, lambda r: ~F.coalesce(F.try_variant_get(r, "$.rule", "string"), F.lit("")).isin(*allowed)), "/sensitivity/handling", "enum"),
    ]


def item_violations(items: DataFrame, payload: str = "payload", kind: str | None = None) -> DataFrame:
    """items with path and keyword, a row for each violation of an item's JSON. kind: a column with the type that its array asks for."""
    own = items.withColumn("_v", F.try_parse_json(payload)).withColumns({"_keys": F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), "_type": F.try_variant_get("_v", "$['@type']", "string")})
    v, keys = F.col("_v"), F.col("_keys")
    base = [(F.col("_v").isNull(), "", "parse"), *[(v.isNotNull() & ~F.array_contains(keys, k), f"/{k}", "required") for k in ("id", "@type")], *[r for f, k in BASE.items() for r in field_rules(v, keys, f, k)], *_nested(v)]
    if kind is not None:
        base.append((v.isNotNull() & ~F.col("_type").eqNullSafe(F.col(kind)), "/@type", "const"))
    base.append(((F.col("_type") == "Resource") & ~F.arrays_overlap(keys, F.array(F.lit("uri"), F.lit("content"))), "", "anyOf"))
    typed = F.expr("cast(array() as array<struct<path:string,keyword:string>>)")
    for name, fields in OWN.items():
        rules = [(~F.array_contains(keys, k), f"/{k}", "required") for k in REQUIRED.get(name, ())] + [r for f, k in fields.items() for r in field_rules(v, keys, f, k)]
        typed = F.when(F.col("_type") == name, F.concat(_found(rules), _unknown(keys, [*BASE, *fields]))).otherwise(typed)
    known = own.withColumns({"_a": _found(base), "_b": typed})
    return known.select(*items.columns, F.explode(F.concat("_a", "_b")).alias("x")).select(*items.columns, "x.path", "x.keyword")


def envelope_violations(envelopes: DataFrame, document: str = "document") -> DataFrame:
    """(envelope_id, array_key, pos, path, keyword): of envelopes themselves (no array) and of their items."""
    from weftline.operators.envelopes import items_of

    own = envelopes.select(F.get_json_object(document, "$.id").alias("envelope_id"), F.try_parse_json(document).alias("_v"), F.coalesce(F.json_object_keys(document), F.array().cast("array<string>")).alias("_keys"))
    v, keys = F.col("_v"), F.col("_keys")
    rules = [(v.isNull(), "", "parse"), *[(v.isNotNull() & ~F.array_contains(keys, k), f"/{k}", "required") for k in ENVELOPE_REQUIRED], *[r for f, k in ENVELOPE.items() for r in field_rules(v, keys, f, k)]]
    found = own.select("envelope_id", F.explode(F.concat(_found(rules), _unknown(keys, list(ENVELOPE)))).alias("x"))
    outer = found.select("envelope_id", F.lit(None).cast("string").alias("array_key"), F.lit(None).cast("long").alias("pos"), "x.path", "x.keyword")
    asked = F.create_map(*[F.lit(x) for pair in TYPE_OF_ARRAY.items() for x in pair])
    items = items_of(envelopes, document).select("envelope_id", "array_key", "pos", "payload", F.try_element_at(asked, F.col("array_key")).alias("_asked"))
    return outer.unionByName(item_violations(items, kind="_asked").select("envelope_id", "array_key", "pos", "path", "keyword"))


def message(path: Column, keyword: Column) -> Column:
    """A violation for people."""
    return F.concat(F.when(path == "", "(root)").otherwise(path), F.lit(": breaks "), keyword, F.lit(" ["), keyword, F.lit("]"))
