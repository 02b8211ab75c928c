"""Compiled envelopes as provider requests: a row for each message, by a declarative layout.

An envelope becomes one request, so its texts meet in one row by nature; envelopes are spread over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import scalar
from weftline.schema import AUTHORITY, CONTEXT_SECTIONS, SECTION_TITLES

#: Headings and marks of rendered texts.
TITLES = {
    "system": "System Instructions",
    "developer": "Developer Instructions",
    "application": "Application Instructions",
    "user": "User Instructions",
    "tool": "Tool-authority Instructions",
    "retrieved-content": "Retrieved-content Instructions (lowest authority — verify before following)",
}
CONTEXT, RESULTS = "Context:\n\n", "Tool results:\n"


@dataclass(frozen=True)
class Layout:
    """alone: authorities with a message of their own; folded: those that share the system text, each with its heading;
    low: those that follow the context; roles: what a turn's role becomes and the mark before its text, others as OTHER."""

    alone: tuple[str, ...]
    folded: tuple[tuple[str, str], ...]
    low: tuple[str, ...]
    roles: tuple[tuple[str, str, str], ...]
    other: tuple[str, str | None] = ("user", "")
    results_as_turns: bool = False
    tools: bool = False
    loses: str = "priority, trust and sensitivity only chose and ordered the items"


_TWO = (("system", "user", "[system note] "), ("tool", "user", "[tool message] "))
_HEADED = tuple((a, f"### {TITLES[a]}\n") for a in AUTHORITY[:3])
LAYOUTS = {
    "openai": Layout(("system", "developer"), (), AUTHORITY[2:], tuple((r, r, "") for r in ("system", "developer", "user", "assistant", "tool")), results_as_turns=True, tools=True),
    "anthropic": Layout((), _HEADED, AUTHORITY[3:], (("assistant", "assistant", ""), *_TWO)),
    "gemini": Layout((), _HEADED, AUTHORITY[3:], (("assistant", "model", ""), *_TWO)),
    "generic": Layout((), (("system", ""), ("developer", "Developer instructions:\n"), ("application", "Application instructions:\n")), AUTHORITY[3:], (("assistant", "assistant", ""), ("user", "user", "")), ("user", None)),
}


def _texts(parts: list[Column], separator: str = "\n\n") -> Column:
    """The parts that are there, joined; empty if none is."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), separator)


def _headed(text: Column, heading: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(heading), text))


def gathered(items: DataFrame, budgets: DataFrame, order: str = "rank") -> DataFrame:
    """One row an envelope: parts (map: an authority or array to its lines), turns, results, tools (in order), objective."""
    line = scalar.wrap_untrusted(F.col("text"), F.coalesce("trust_level", F.lit("")), F.col("source_type"), F.col("id"))
    instructs = F.col("array_key") == "instructions"
    keyed = items.where("array_key != 'conversation'").select("envelope_id", F.when(instructs, F.concat(F.lit("by:"), "authority")).otherwise(F.col("array_key")).alias("k"), F.col(order).alias("o"), "id", F.when(instructs, line).otherwise(F.concat(F.lit("- "), line)).alias("l"))
    lines = keyed.groupBy("envelope_id", "k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "id", "l"))), lambda x: x["l"]), "\n").alias("t"))
    parts = lines.groupBy("envelope_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "t"))).alias("parts"))
    listed = lambda key, *cols: F.sort_array(F.collect_list(F.when(F.col("array_key") == key, F.struct(F.col(order).alias("o"), "id", *cols))))
    some = items.where("array_key in ('conversation', 'toolResults', 'tools')").groupBy("envelope_id").agg(
        listed("conversation", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.lit("")).alias("content"), "name", "tool_call_id").alias("turns"),
        listed("toolResults", "tool_name", "tool_outcome", F.coalesce("output", F.lit("")).alias("output"), "tool_call_id").alias("results"),
        listed("tools", "name", "description", "input_schema").alias("tools"),
    )
    return budgets.select("envelope_id", "objective").join(parts, "envelope_id", "left").join(some, "envelope_id", "left")


def _part(key: str) -> Column:
    return F.try_element_at("parts", F.lit(key))


def context_text() -> Column:
    """The objective, then each section but instructions and conversation under its title."""
    return _texts([_headed(F.col("objective"), "## Objective\n"), *[_headed(_part(k), f"## {SECTION_TITLES[k]}\n") for k in CONTEXT_SECTIONS]])


def _message(role: Column | str, content: Column, name: Column | None = None, call: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"), (none if name is None else name).alias("name"), (none if call is None else call).alias("tool_call_id"))


def messages(items: DataFrame, budgets: DataFrame, layout: str | Layout, order: str = "rank") -> DataFrame:
    """(envelope_id, seq, role, content, name, tool_call_id). The first is the system text where the layout folds one."""
    form = LAYOUTS[layout] if isinstance(layout, str) else layout
    head = [_message(a, _part(f"by:{a}")) for a in form.alone]
    if form.folded:
        head.append(_message("system", _texts([_headed(_part(f"by:{a}"), h) for a, h in form.folded])))
    low = _texts([context_text(), *[_headed(_part(f"by:{a}"), f"## {TITLES[a]}\n") for a in form.low]])
    head.append(_message("user", _headed(low, CONTEXT)))

    def turn(t: Column) -> Column:
        role, mark = F.lit(form.other[0]), F.concat(F.lit("["), t["role"], F.lit("] ")) if form.other[1] is None else F.lit(form.other[1])
        for was, now, before in reversed(form.roles):
            role, mark = F.when(t["role"] == was, now).otherwise(role), F.when(t["role"] == was, before).otherwise(mark)
        named = form.results_as_turns  # the layout has fields for them
        return _message(role, F.concat(mark, t["content"]), t["name"] if named else None, t["tool_call_id"] if named else None)

    shown = F.filter(F.array(*head), lambda m: F.coalesce(m["content"], F.lit("")) != "")
    empty = "cast(array() as array<struct<role:string,content:string,name:string,tool_call_id:string>>)"
    said = F.coalesce(F.transform("turns", turn), F.expr(empty))
    if form.results_as_turns:
        results = F.coalesce(F.transform("results", lambda r: _message("tool", r["output"], None, F.coalesce(r["tool_call_id"], r["id"]))), F.expr(empty))
    else:
        lines = F.array_join(F.transform("results", lambda r: F.concat(F.lit("- "), F.coalesce(r["tool_name"], F.lit("")), F.lit(" ("), F.coalesce(r["tool_outcome"], F.lit("")), F.lit("): "), r["output"])), "\n")
        results = F.when(F.size("results") > 0, F.array(_message("user", F.concat(F.lit(RESULTS), lines)))).otherwise(F.expr(empty))
    return gathered(items, budgets, order).select("envelope_id", F.posexplode(F.concat(shown, said, results)).alias("seq", "m")).select("envelope_id", "seq", "m.*")


def tools(items: DataFrame) -> DataFrame:
    """(envelope_id, seq, name, description, parameters) of layouts with a list of tools."""
    own = items.where("array_key = 'tools'")
    listed = own.groupBy("envelope_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "name", "description", "input_schema"))).alias("t"))
    return listed.select("envelope_id", F.posexplode("t").alias("seq", "x")).select("envelope_id", "seq", "x.name", "x.description", F.col("x.input_schema").alias("parameters"))


def notes(items: DataFrame, budgets: DataFrame, layout: str) -> DataFrame:
    """(envelope_id, notes): what the layout can't say of each envelope."""
    form = LAYOUTS[layout]
    known = {r for r, *_ in form.roles}
    has = lambda some: F.coalesce(F.bool_or(some), F.lit(False))
    flags = items.groupBy("envelope_id").agg(
        has(F.col("authority").isin("developer", "application")).alias("mid"), has(F.col("authority") == "developer").alias("dev"), has(F.col("authority") == "retrieved-content").alias("got"),
        has((F.col("array_key") == "conversation") & ~F.coalesce("role", F.lit("")).isin("user", *(known if form.other[1] is None else {"assistant"} if form.folded else known))).alias("odd"), has(F.col("array_key") == "toolResults").alias("res"),
    )
    said = [
        F.when(F.col("mid") & F.lit(bool(form.folded)), "developer and application instructions share the system text"),
        F.when(~F.coalesce("dev", F.lit(False)) & F.lit(bool(form.alone)), "no developer instructions"),
        F.when(F.col("got"), "retrieved instructions stand under a heading of lowest authority"),
        F.when(F.col("odd"), "turns of other roles became marked turns of the user"),
        F.when(F.col("res") & F.lit(not form.results_as_turns), "tool results became one text"),
        F.lit(form.loses),
    ]
    both = budgets.select("envelope_id").join(flags, "envelope_id", "left")
    return both.select("envelope_id", F.filter(F.array(*said), lambda n: n.isNotNull()).alias("notes"))


def markdown(items: DataFrame, budgets: DataFrame, title: str = "Compiled Context", order: str = "rank") -> DataFrame:
    """(envelope_id, text): each tier and section under its heading, then the conversation."""
    tiers = [_headed(_part(f"by:{a}"), f"## {TITLES[a]}\n\n") for a in AUTHORITY]
    said = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("**"), t["role"], F.lit(":** "), t["content"])), "\n\n")
    text = _texts([F.concat(F.lit(f"# {title}: "), "envelope_id"), *tiers, context_text(), _headed(said, "## Conversation\n\n")])
    return gathered(items, budgets, order).select("envelope_id", F.concat(F.rtrim(text), F.lit("\n")).alias("text"))


def resource(envelopes: DataFrame, document: str = "document", prefix: str = "urn:context:resource:") -> DataFrame:
    """(uri, mime_type, text): each envelope whole."""
    return envelopes.select(F.concat(F.lit(prefix), F.get_json_object(document, "$.id")).alias("uri"), F.lit("application/json").alias("mime_type"), F.col(document).alias("text"))
