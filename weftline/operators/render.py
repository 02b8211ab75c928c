"""Renders items and turns into message layouts, a context block, Markdown and resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.schema import CONTEXT_SECTIONS

#: Role names of each chat layout; other roles become the layout's ordinary role, marked with their name.
CHAT_ROLES = {
    "openai": {"system": "system", "developer": "developer", "user": "user", "assistant": "assistant", "tool": "tool"},
    "anthropic": {"user": "user", "assistant": "assistant"},
    "gemini": {"user": "user", "assistant": "model"},
    "generic": {"system": "system", "user": "user", "assistant": "assistant"},
}
OTHER_ROLE = dict.fromkeys(CHAT_ROLES, "user")


def _lines(text: Column, order: list[str], separator: str) -> Column:
    """Texts of a group in order. A rendered envelope is one string, so its items meet in one row by nature."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("_line")))), lambda x: x["_line"]), separator)


def chat(turns: DataFrame, layout: str) -> DataFrame:
    """(envelope_id, messages, n) from turns (envelope_id, pos, role, text)."""
    roles = CHAT_ROLES[layout]
    role = F.coalesce(*[F.when(F.col("role") == k, v) for k, v in roles.items()], F.lit(OTHER_ROLE[layout]))
    text = F.when(F.col("role").isin(*roles), F.col("text")).otherwise(F.concat(F.lit("["), "role", F.lit("] "), "text"))
    return turns.groupBy("envelope_id").agg(_lines(F.concat(role, F.lit(": "), text), ["pos", "role", "text"], "\n").alias("messages"), F.count("*").alias("n"))


def markdown(turns: DataFrame) -> DataFrame:
    line = F.concat(F.lit("**"), "role", F.lit("**: "), "text")
    return turns.groupBy("envelope_id").agg(F.concat(F.lit("# Conversation\n\n"), _lines(line, ["pos", "role", "text"], "\n\n")).alias("markdown"))


def by_authority(instructions: DataFrame) -> DataFrame:
    """Instructions (envelope_id, authority, pos, text) of each tier together, in order."""
    return instructions.groupBy("envelope_id", "authority").agg(_lines(F.col("text"), ["pos"], "\n").alias("text"))


def context_block(items: DataFrame) -> DataFrame:
    """(envelope_id, block): every section but instructions and conversation as a heading and a list."""
    order = F.coalesce(*[F.when(F.col("array_key") == s, k) for k, s in enumerate(CONTEXT_SECTIONS)])
    sections = items.withColumn("_o", order).where("_o is not null").groupBy("envelope_id", "array_key", "_o").agg(_lines(F.concat(F.lit("- "), "text"), ["pos"], "\n").alias("_list"))
    return sections.groupBy("envelope_id").agg(_lines(F.concat(F.lit("## "), "array_key", F.lit("\n"), "_list"), ["_o"], "\n\n").alias("block"))


def markdown_line() -> Column:
    status = F.when(F.col("status").isNotNull(), F.concat(F.lit(" ["), "status", F.lit("]"))).otherwise("")
    trust = F.when(F.col("trust_level").isNotNull(), F.concat(F.lit(" (trust: "), "trust_level", F.lit(")"))).otherwise("")
    return F.concat(F.lit("- `"), "id", F.lit("`"), status, trust, F.lit(": "), "content")


def resource(items: DataFrame, scheme: str = "context://") -> DataFrame:
    """(pos, uri, mime_type, text): each item as a resource holding its JSON."""
    return items.select("pos", F.concat(F.lit(scheme), "envelope_id", F.lit("/"), F.regexp_replace("id", "^doc:", "")).alias("uri"), F.lit("application/json").alias("mime_type"), F.to_json(F.struct("id", "item_type", "content", "tags")).alias("text"))
