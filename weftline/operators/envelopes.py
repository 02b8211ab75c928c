"""The JSON boundary: envelopes as documents, items as rows, and back to text."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import scalar
from weftline.schema import ARRAY_KEYS, SECTION_TITLES

#: What of an item's JSON has a column of its own; the whole stays in payload.
ITEM = (
    "id string, `@type` string, content string, status string, priority double, relevance double, scope array<string>, tags array<string>, validFrom string, validUntil string,"
    " trust struct<level:string,providesData:boolean,providesInstructions:boolean>, sensitivity struct<level:string,handling:array<struct<rule:string,appliesTo:string>>>, source struct<sourceType:string,sourceUri:string>,"
    " authority string, role string, name string, displayName string, toolCallId string, toolName string, outcome string, output string, subjectId string, predicate string, objectId string, description string, inputSchema string"
)


def generate_id(kind: str, namespace: str = "urn:context") -> Column:
    return F.concat(F.lit(f"{namespace}:{kind}:"), F.uuid())


def create(rows: DataFrame, now: str, version: str = "1.0.0", context: str = "urn:context:v1", namespace: str = "urn:context") -> DataFrame:
    """Adds document: an envelope with every array empty. rows may have id and objective (a summary); clocks are parameters."""
    made = generate_id("envelope", namespace)
    own = F.coalesce("id", made) if "id" in rows.columns else made
    fields = [F.lit(context).alias("@context"), F.lit("ContextEnvelope").alias("@type"), F.lit(version).alias("schemaVersion"), own.alias("id"), F.lit(now).alias("createdAt")]
    if "objective" in rows.columns:
        fields.append(F.when(F.col("objective").isNotNull(), F.struct(F.concat(own, F.lit(":objective")).alias("id"), F.lit("Objective").alias("@type"), F.col("objective").alias("summary"))).alias("objective"))
    fields += [F.array().cast("array<string>").alias(k) for k in ARRAY_KEYS]
    head, tail = F.to_json(F.struct(*fields)), '"summary":null,"errors":[],"extensions":{}}'
    return rows.withColumn("document", F.concat(F.left(head, F.length(head) - 1), F.lit("," + tail)))


def items_of(envelopes: DataFrame, document: str = "document") -> DataFrame:
    """A row for each element of the arrays, in order. Absent and null arrays have none; a malformed document has no row."""
    parsed = F.from_json(document, "id string, " + ", ".join(f"{k} array<string>" for k in ARRAY_KEYS))
    none = F.array().cast("array<string>")

    def listed(key: str) -> Column:
        return F.transform(F.coalesce(F.col(f"e.{key}"), none), lambda x, i: F.struct(F.lit(key).alias("array_key"), i.cast("long").alias("pos"), x.alias("payload")))

    each = envelopes.select(parsed.alias("e")).select(F.col("e.id").alias("envelope_id"), F.explode(F.flatten(F.array(*map(listed, ARRAY_KEYS)))).alias("x")).select("envelope_id", "x.*")
    x = each.withColumn("i", F.from_json("payload", ITEM))
    handling = F.transform(F.coalesce("i.sensitivity.handling", F.expr("cast(array() as array<struct<rule:string,appliesTo:string>>)")), lambda h: F.struct(h["rule"].alias("rule"), h["appliesTo"].alias("applies_to")))
    triple = F.when(F.col("i.predicate").isNotNull(), F.concat_ws(" ", "i.subjectId", "i.predicate", "i.objectId"))
    shown = F.when(F.col("i.@type") == "ToolResult", F.to_json(F.try_variant_get(F.try_parse_json("payload"), "$.output", "variant")))
    name = F.when(F.col("i.@type") == "Actor", F.nullif("i.displayName", F.lit(""))).otherwise(F.col("i.name"))
    return x.select(
        "envelope_id", "array_key", "pos", "i.id", F.col("i.@type").alias("item_type"), "i.content", "i.status", "i.priority", "i.relevance", "i.scope", "i.tags",
        F.col("i.validFrom").alias("valid_from"), F.col("i.validUntil").alias("valid_until"), F.col("i.trust.level").alias("trust_level"), F.col("i.trust.providesData").alias("provides_data"),
        F.col("i.trust.providesInstructions").alias("provides_instructions"), F.col("i.sensitivity.level").alias("sensitivity"), handling.alias("handling"), F.col("i.source.sourceType").alias("source_type"),
        "i.authority", "i.role", "i.name", F.col("i.toolCallId").alias("tool_call_id"), F.col("i.toolName").alias("tool_name"), F.col("i.outcome").alias("tool_outcome"), "i.output", "i.description", F.col("i.inputSchema").alias("input_schema"),
        scalar.item_text(F.col("i.content"), F.col("i.@type"), name, F.col("i.role"), shown, triple).alias("text"), "payload",
    )


def objective_text(document: str = "document") -> Column:
    """Summary, success criteria and non-goals, those that are there, joined by spaces."""
    o = F.from_json(document, "objective struct<summary:string,successCriteria:array<string>,nonGoals:array<string>>")["objective"]
    none = F.array().cast("array<string>")
    return F.array_join(F.filter(F.concat(F.array(o["summary"]), F.coalesce(o["successCriteria"], none), F.coalesce(o["nonGoals"], none)), lambda t: t.isNotNull() & (t != "")), " ")


def policies_of(envelopes: DataFrame, document: str = "document", **overrides: object) -> DataFrame:
    """One row an envelope: its token policy with defaults beneath and overrides above, and its objective's text and summary."""
    kinds = {"maxContextTokens": "double", "reservedOutputTokens": "double", "sectionBudgets": "map<string,double>", "relevanceThreshold": "double", "deduplicate": "boolean", "allowTruncation": "boolean", "allowSummarization": "boolean", "requiredItemIds": "array<string>"}
    names = {"maxContextTokens": "max_tokens", "reservedOutputTokens": "reserved_tokens", "sectionBudgets": "section_budgets", "relevanceThreshold": "relevance_threshold", "deduplicate": "deduplicate", "allowTruncation": "allow_truncation", "allowSummarization": "allow_summarization", "requiredItemIds": "required_ids"}
    base = {"deduplicate": True, "allow_truncation": True, "allow_summarization": False}
    e = F.from_json(document, "id string, objective struct<summary:string>, tokenPolicy struct<" + ",".join(f"{k}:{v}" for k, v in kinds.items()) + ">")
    read = envelopes.select(e.alias("e"), objective_text(document).alias("objective_text"))

    def field(key: str) -> Column:
        name = names[key]
        levels = [F.lit(overrides[name]).cast(kinds[key])] if overrides.get(name) is not None else []
        levels.append(F.col(f"e.tokenPolicy.{key}"))
        return F.coalesce(*levels, F.lit(base.get(name)).cast(kinds[key])).alias(name)

    return read.select(F.col("e.id").alias("envelope_id"), *map(field, kinds), F.col("e.objective.summary").alias("objective"), "objective_text")


def export(envelopes: DataFrame, form: str = "json", document: str = "document", title: str = "Context") -> DataFrame:
    """(envelope_id, text): json as it is, json-ld with sorted keys, markdown for people."""
    if form in ("json", "json-ld"):
        text = F.col(document) if form == "json" else scalar.stable_json(F.col(document))
        return envelopes.select(F.get_json_object(document, "$.id").alias("envelope_id"), text.alias("text"))
    if form != "markdown":
        raise ValueError(f"unknown form {form!r}")
    label = F.coalesce("content", "name", "id")
    status = F.when(F.col("status").isNotNull(), F.concat(F.lit(" ["), "status", F.lit("]"))).otherwise("")
    trust = F.when(F.col("trust_level").isNotNull(), F.concat(F.lit(" (trust: "), "trust_level", F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- `"), "id", F.lit("`"), status, trust, F.lit(": "), label)
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n")
    sections = items_of(envelopes, document).groupBy("envelope_id", "array_key").agg(lines.alias("lines"))
    order = F.coalesce(*[F.when(F.col("array_key") == k, i) for i, k in enumerate(ARRAY_KEYS)])
    name = F.coalesce(*[F.when(F.col("array_key") == k, SECTION_TITLES[k]) for k in ARRAY_KEYS])
    blocks = sections.groupBy("envelope_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.concat(F.lit("## "), name, F.lit("\n\n"), "lines").alias("b")))), lambda x: x["b"]).alias("blocks"))
    heads = policies_of(envelopes, document).select("envelope_id", "objective")
    goal = F.when(F.coalesce("objective", F.lit("")) != "", F.concat(F.lit("## Objective\n\n"), "objective"))
    parts = F.concat(F.array(F.concat(F.lit(f"# {title}: "), "envelope_id"), goal), F.coalesce("blocks", F.array().cast("array<string>")))
    return heads.join(blocks, "envelope_id", "left").select("envelope_id", F.concat(F.array_join(parts, "\n\n"), F.lit("\n")).alias("text"))


def payload_of(document: str, drop: str = "signature") -> bytes:
    """Canonical JSON of a record without its signature: what a signer signs."""
    record = {k: v for k, v in json.loads(document).items() if k != drop}
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def signed(document: Column, signer: Callable[[bytes], str]) -> Column:
    """The signer's signature of each record; verification compares or asks the verifier the same way."""

    @F.pandas_udf("string")
    def run(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: None if d is None else signer(payload_of(d)))

    return run(document)


def verified(document: Column, signature: Column, verifier: Callable[[bytes, str], bool]) -> Column:
    """Whether the verifier takes each record's signature; false without one."""

    @F.pandas_udf("boolean")
    def run(documents: pd.Series, signatures: pd.Series) -> pd.Series:
        return pd.Series([d is not None and s is not None and bool(verifier(payload_of(d), s)) for d, s in zip(documents, signatures, strict=True)], dtype=bool)

    return run(document, signature)
