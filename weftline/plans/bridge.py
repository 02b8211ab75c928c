"""Items from the driver's tables, by integer arithmetic that DuckDB repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CASES = """
 case {i} % 5 when 0 then 'Fact' when 1 then 'Assumption' when 2 then 'Decision' when 3 then 'Resource' else 'Instruction' end as item_type,
 case {i} % 5 when 0 then 'facts' when 1 then 'assumptions' when 2 then 'decisions' when 3 then 'resources' else 'instructions' end as array_key,
 case when {i} % 7 = 0 then 'proposed' end as status,
 case when {i} % 10 <> 3 then cast({i} % 101 as bigint) end as priority,
 case when {i} % 9 <> 4 then ({i} % 97) / 96.0e0 end as relevance,
 case when {i} % 11 = 0 then '2026-12-01T00:00:00.000Z' when {i} % 11 = 1 then '2020-01-01T00:00:00.000Z' end as valid_from,
 case when {i} % 13 = 0 then '2025-01-01T00:00:00.000Z' when {i} % 13 = 1 then '2027-01-01T00:00:00.000Z' end as valid_until,
 case {i} % 5 when 1 then 'trusted' when 2 then 'verified' when 3 then 'untrusted' when 4 then 'unknown' end as trust_level,
 case when {i} % 3 = 0 then true end as provides_data,
 case when {i} % 4 = 0 then true end as provides_instructions,
 case {i} % 7 when 1 then 'public' when 2 then 'internal' when 3 then 'confidential' when 4 then 'restricted' when 5 then 'personal' when 6 then 'secret' end as sensitivity,
 case {i} % 9 when 0 then 'exclude' when 1 then 'redact' when 2 then 'summarize' when 3 then 'require-consent' when 4 then 'local-only' when 5 then 'allow' end as rule,
 case when {i} % 2 = 0 then 'external' end as applies_to"""

#: The same items in DuckDB: arrays as lists, one handling rule flat.
ITEMS_SQL = (
    "select source as envelope_id, doc_id as pos, 'doc:' || doc_id as id, text as content, lang, "
    "['lang:' || lang, 'q' || (doc_id % 3), 'lang:' || lang] as tags, case when doc_id % 4 = 0 then []::varchar[] else ['s' || (doc_id % 3)] end as scope,"
    + _CASES.format(i="doc_id")
    + " from documents"
)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as items of one envelope a source."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "source as envelope_id", "doc_id as pos", "concat('doc:', doc_id) as id", "text as content", "lang",
        "array(concat('lang:', lang), concat('q', doc_id % 3), concat('lang:', lang)) as tags",
        "case when doc_id % 4 = 0 then cast(array() as array<string>) else array(concat('s', doc_id % 3)) end as scope",
        *[c.strip() for c in _CASES.format(i="doc_id").split(",\n")],
    ).selectExpr("*", "case when rule is null then cast(array() as array<struct<rule:string,applies_to:string>>) else array(named_struct('rule', rule, 'applies_to', applies_to)) end as handling")


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as JSON envelopes (document): turns, one or two instructions, here and there a tool result and a bad timestamp."""
    turn = F.struct(F.concat_ws("-", F.lit("t"), "conv_id", "turn").alias("id"), F.lit("ConversationMessage").alias("@type"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id is not null")
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"), turn.alias("m")))), lambda x: x["m"])
    grouped = rows.groupBy("conv_id").agg(turns.alias("conversation"))
    i = F.col("conv_id")
    instruction = lambda authority, text: F.struct(F.concat(F.lit(f"{authority}-"), i).alias("id"), F.lit("Instruction").alias("@type"), F.lit(authority).alias("authority"), F.lit(text).alias("content"))
    system, developer = instruction("system", "Answer exactly."), instruction("developer", "Be brief.")
    result = F.struct(F.concat(F.lit("r-"), i).alias("id"), F.lit("ToolResult").alias("@type"), F.lit("lookup").alias("toolName"), F.lit("success").alias("outcome"), F.lit("ok").alias("output"))
    fields = [F.lit("urn:context:v1").alias("@context"), F.lit("ContextEnvelope").alias("@type"), F.lit("1.0.0").alias("schemaVersion"), F.concat(F.lit("c"), i).alias("id"), F.when(i % 5 == 0, "yesterday").otherwise("2026-01-01T00:00:00Z").alias("createdAt")]
    fields += [F.when(i % 2 == 0, F.array(system, developer)).otherwise(F.array(system)).alias("instructions"), F.col("conversation"), F.when(i % 3 == 0, F.array(result)).alias("toolResults")]
    return grouped.select(F.to_json(F.struct(*fields)).alias("document"))
