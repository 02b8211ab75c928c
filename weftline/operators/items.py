"""Relational operators over items: normalize, filter, dedupe, rank, redact, merge, diff, budgeted selection.

Columns they read: envelope_id, array_key, pos, id, item_type, content, status, priority, relevance, scope, tags,
valid_from, valid_until, trust_level, provides_data, provides_instructions, sensitivity, handling
(array of struct rule, applies_to). All are DataFrame to DataFrame; clocks are parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scalar
from weftline.schema import DEFAULT_RULE, SECTIONS, SENSITIVITY


def normalize(items: DataFrame) -> DataFrame:
    level, data, instructions = scalar.default_trust(F.col("trust_level"), F.col("provides_data"), F.col("provides_instructions"))
    return items.withColumns({"status": scalar.default_status(F.col("status"), F.col("item_type")), "trust_level": level, "provides_data": data, "provides_instructions": instructions, "tags": scalar.text_set(F.col("tags")), "scope": scalar.text_set(F.col("scope"))})


def expired(as_of: str) -> Column:
    """Timestamps are compared as the strings they are."""
    return F.coalesce(F.col("valid_until") < as_of, F.lit(False)) | F.coalesce(F.col("valid_from") > as_of, F.lit(False))


def _meets(own: str, wanted: list[str]) -> Column:
    return (F.coalesce(F.size(own), F.lit(0)) <= 0) | F.arrays_overlap(own, F.array(*map(F.lit, wanted)))


def _rank_of(level: Column) -> Column:
    return F.coalesce(*[F.when(level == s, k) for k, s in enumerate(SENSITIVITY)])


def keep(items: DataFrame, as_of: str | None = None, scope: list[str] | None = None, tags: list[str] | None = None, relevance: float | None = None, trust: list[str] | None = None, most_sensitive: str | None = None, arrays: list[str] | None = None, predicate: Column | None = None) -> DataFrame:
    """Rows that pass every given test; what an item doesn't state passes. Other arrays than `arrays` are untouched."""
    tests = [F.lit(True)]
    if as_of is not None:
        tests.append(~expired(as_of))
    if scope:
        tests.append(_meets("scope", scope))
    if tags:
        tests.append(_meets("tags", tags))
    if relevance is not None:
        tests.append(F.col("relevance").isNull() | (F.col("relevance") >= relevance))
    if trust:
        tests.append(F.col("trust_level").isNull() | F.col("trust_level").isin(trust))
    if most_sensitive is not None:
        at = SENSITIVITY.index(most_sensitive) if most_sensitive in SENSITIVITY else -1
        tests.append(F.col("sensitivity").isNull() | (_rank_of(F.col("sensitivity")) <= at))
    if predicate is not None:
        tests.append(predicate)
    passed = tests[0]
    for t in tests[1:]:
        passed = passed & t
    return items.where(passed if arrays is None else ~F.col("array_key").isin(arrays) | passed)


def universal_rule() -> Column:
    """The first handling rule that isn't for one boundary."""
    return F.try_element_at(F.filter("handling", lambda r: r["applies_to"].isNull() | (r["applies_to"] == "")), F.lit(1))["rule"]


def drop_reason(as_of: str, threshold: float) -> Column:
    """Why selection drops an item before its budget, in order of precedence; null if it doesn't."""
    low = F.col("relevance") < threshold
    return F.when(expired(as_of), "expired").when(low, "below-relevance-threshold").when(universal_rule().isin("exclude", "local-only"), "excluded-by-sensitivity")


_GROUP = ("envelope_id", "array_key")


def dedupe(items: DataFrame) -> DataFrame:
    """The first of the items of one type and content in an array, with all its columns; of several, the highest priority and all tags."""
    key = [*_GROUP, "item_type", F.coalesce("content", F.lit("")).alias("_content")]
    rest = [c for c in items.columns if c not in (*_GROUP, "item_type", "priority", "tags")]
    first = F.min_by(F.struct(*rest, "priority", "tags"), F.struct("pos", "id")).alias("f")
    grouped = items.groupBy(*key).agg(first, F.max(F.coalesce("priority", F.lit(0))).alias("most"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("every"), F.count("*").alias("n"))
    several = F.col("n") > 1
    return grouped.select(*_GROUP, "item_type", *[f"f.{c}" for c in rest], F.when(several, F.col("most")).otherwise(F.col("f.priority")).alias("priority"), F.when(several, F.col("every")).otherwise(F.col("f.tags")).alias("tags"), "n")


def dropped_duplicates(items: DataFrame) -> DataFrame:
    """Items that dedupe leaves out."""
    return items.select(*_GROUP, "id").join(dedupe(items).select(*_GROUP, "id"), [*_GROUP, "id"], "left_anti")


def rank_order() -> list[Column]:
    return [F.coalesce("priority", F.lit(0)).desc(), F.coalesce("relevance", F.lit(0.0)).desc(), F.col("id").asc()]


def rank(items: DataFrame) -> DataFrame:
    """Adds rank within each array; conversation keeps its order."""
    by = Window.partitionBy(*_GROUP)
    ranked = F.row_number().over(by.orderBy(*rank_order()))
    kept = F.row_number().over(by.orderBy("pos", "id"))
    return items.withColumn("rank", F.when(F.col("array_key") == "conversation", kept).otherwise(ranked))


def redaction_rule(boundary: str | None) -> Column:
    """The rule for a boundary: its own, else a universal one, else the first, else the sensitivity's default, else allow."""
    own = F.try_element_at(F.filter("handling", lambda r: r["applies_to"] == boundary), F.lit(1))["rule"] if boundary else F.lit(None).cast("string")
    default = F.coalesce(*[F.when(F.col("sensitivity") == s, rule) for s, rule in DEFAULT_RULE.items()], F.lit("allow"))
    return F.coalesce(own, universal_rule(), F.try_element_at("handling", F.lit(1))["rule"], default)


def redact(items: DataFrame, boundary: str | None = None, marker: str = "[REDACTED]", now: str | None = None, summarizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds rule; contents are replaced or summarized, excluded items leave. now: adds redaction, what was applied when."""
    ruled = items.withColumn("rule", redaction_rule(boundary))
    summary = F.concat(F.lit("[SUMMARIZED: "), F.length(F.coalesce("content", F.lit(""))).cast("string"), F.lit(" chars omitted]"))
    summary = summary if summarizer is None else summarizer(F.coalesce("content", F.lit("")))
    if now is not None:
        ruled = ruled.withColumn("redaction", F.when(F.col("rule") != "allow", F.struct("rule", F.lit(now).alias("applied_at"))))
    return ruled.where("rule != 'exclude'").withColumn("content", F.when(F.col("rule") == "redact", marker).when(F.col("rule") == "summarize", summary).otherwise(F.col("content")))


def redaction_lists(items: DataFrame, boundary: str | None = None) -> DataFrame:
    """(list, and the items' columns): what needs consent, stays local or is excluded."""
    names = {"require-consent": "requires-consent", "local-only": "local-only", "exclude": "excluded"}
    name = F.coalesce(*[F.when(redaction_rule(boundary) == rule, n) for rule, n in names.items()])
    return items.select(name.alias("list"), "*").where("list is not null")


#: What two copies of an item must share to be the same; priority and tags may differ. Whole payloads are compared in combine.
_SUBSTANCE = ("item_type", "content", "status", "relevance", "trust_level", "provides_data", "provides_instructions", "sensitivity", "handling", "scope", "valid_from", "valid_until")


def fingerprint() -> Column:
    """Equality of two items' contents for a merge: everything but priority and tags."""
    return F.to_json(F.struct(*_SUBSTANCE), {"ignoreNullFields": "false"})


def _last(items: DataFrame) -> DataFrame:
    """One item an id: of repeated ids the last counts."""
    cols = [*_SUBSTANCE, "priority", "tags", "pos"]
    return items.groupBy(*_GROUP, "id").agg(F.max_by(F.struct(*cols), F.struct("pos", "content")).alias("x")).select(*_GROUP, "id", *[f"x.{c}" for c in cols])


def merge(a: DataFrame, b: DataFrame, prefer: str = "b") -> DataFrame:
    """Items of both: (envelope_id, array_key, id, content, priority, tags, outcome). Conflicting ones appear twice."""
    cols = ["item_type", "content", "status", "priority", "tags"]
    left = a.select(*_GROUP, "id", F.struct(*cols, fingerprint().alias("print")).alias("a"))
    right = _last(b).select(*_GROUP, "id", F.struct(*cols, fingerprint().alias("print")).alias("b"))
    both = left.join(right, [*_GROUP, "id"], "full_outer")
    conflict = (F.col("a.item_type") != F.col("b.item_type")) | ((F.col("a.print") != F.col("b.print")) & (F.col("a.status") == "confirmed") & (F.col("b.status") == "confirmed"))
    outcome = F.when(F.col("b").isNull(), "only-a").when(F.col("a").isNull(), "only-b").when(F.col("a.item_type") != F.col("b.item_type"), "type-mismatch").when(F.col("a.print") == F.col("b.print"), "same").when(conflict, "conflict").otherwise("preferred")
    one = lambda side, i: F.struct(i.alias("id"), F.col(f"{side}.content").alias("content"), F.col(f"{side}.priority").alias("priority"), F.col(f"{side}.tags").alias("tags"))
    renamed = F.concat("id", F.lit("#conflict:"), F.substring(F.md5("b.print"), 1, 8))
    same = F.struct(F.col("id"), F.col("a.content").alias("content"), F.greatest(F.coalesce("a.priority", F.lit(0)), F.coalesce("b.priority", F.lit(0))).alias("priority"), F.array_union("a.tags", "b.tags").alias("tags"))
    made = both.withColumn("outcome", outcome).select(*_GROUP, "outcome", F.explode(F.when(F.col("outcome").isin("conflict", "type-mismatch"), F.array(one("a", F.col("id")), one("b", renamed))).when(F.col("outcome") == "same", F.array(same)).when((F.col("outcome") == "only-a") | ((F.col("outcome") == "preferred") & F.lit(prefer == "a")), F.array(one("a", F.col("id")))).otherwise(F.array(one("b", F.col("id"))))).alias("x"))
    return made.select(*_GROUP, "x.id", "x.content", "x.priority", "x.tags", "outcome")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(envelope_id, array_key, id, kind): added, removed or changed items."""
    full = F.to_json(F.struct(*_SUBSTANCE, "priority", "tags"), {"ignoreNullFields": "false"})
    a, b = (_last(x).select(*_GROUP, "id", full.alias(n)) for x, n in ((before, "a"), (after, "b")))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, [*_GROUP, "id"], "full_outer").select(*_GROUP, "id", kind.alias("kind")).where("kind is not null")


def _prefix(items: DataFrame, size: str) -> DataFrame:
    """Adds before: the sum of `size` over earlier ranks of the array, in two levels so that no array needs one task.

    Ranks are cut into stretches; sums of stretches are prefixed first, then each stretch by itself.
    """
    keyed = items.withColumn("_stretch", F.floor(F.col("rank") / 4096))
    sums = keyed.groupBy(*_GROUP, "_stretch").agg(F.sum(size).alias("s"))
    ahead = F.coalesce(F.sum("s").over(Window.partitionBy(*_GROUP).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*_GROUP, "_stretch", ahead.alias("_ahead"))
    within = F.coalesce(F.sum(size).over(Window.partitionBy(*_GROUP, "_stretch").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return keyed.withColumn("_within", within).join(sums, [*_GROUP, "_stretch"]).withColumn("before", F.col("_ahead") + F.col("_within")).drop("_within", "_ahead", "_stretch")


_BIG = 2**62  # stands for no limit


def limited(ranked: DataFrame, budget: int, caps: dict[str, int] | None = None) -> DataFrame:
    """Adds _budget and _cap, the same for every envelope."""
    cap = F.coalesce(*[F.when(F.col("array_key") == s, F.lit(c)) for s, c in (caps or {}).items()], F.lit(None)).cast("long")
    return ranked.withColumns({"_budget": F.lit(budget).cast("long"), "_cap": cap})


def section_limits(sized: DataFrame) -> DataFrame:
    """(envelope_id, array_key, open, room, used): what is left when a section begins, after its required items, and what it takes.

    sized has tokens, required, and _budget and _cap (null: none) of the envelope and the section; earlier sections come first.
    """
    order = F.coalesce(*[F.when(F.col("array_key") == s, k) for k, s in enumerate(SECTIONS)])
    total = lambda some: F.coalesce(F.sum(F.when(some, F.col("tokens"))), F.lit(0))
    big = F.lit(_BIG).cast("long")
    sums = sized.groupBy(*_GROUP).agg(total(~F.col("required")).alias("rest"), total(F.col("required")).alias("must"), F.coalesce(F.any_value("_cap"), big).alias("cap"), F.coalesce(F.any_value("_budget"), big).alias("budget"))
    ordered = sums.withColumn("o", order).groupBy("envelope_id").agg(F.any_value("budget").alias("budget"), F.sort_array(F.collect_list(F.struct("o", "array_key", "cap", "rest", "must"))).alias("s"))  # at most one a section

    def step(acc: Column, x: Column) -> Column:
        first = F.least(x["cap"], acc["left"])
        room = first - x["must"]
        used = x["must"] + F.greatest(F.lit(0).cast("long"), F.least(room, x["rest"]))
        return F.struct((acc["left"] - used).alias("left"), F.concat(acc["out"], F.array(F.struct(x["array_key"].alias("array_key"), first.alias("open"), room.alias("room"), used.alias("used")))).alias("out"))

    start = F.struct(F.col("budget").alias("left"), F.expr("cast(array() as array<struct<array_key:string,open:bigint,room:bigint,used:bigint>>)").alias("out"))
    return ordered.select("envelope_id", F.explode(F.aggregate("s", start, step, lambda acc: acc["out"])).alias("x")).select("envelope_id", "x.*")


def select_in_budget(ranked: DataFrame, budget: int | None = None, caps: dict[str, int] | None = None) -> DataFrame:
    """Adds kept_tokens and outcome (kept, truncated, over-budget, required) to ranked items (content, rank, required).

    With truncation the first item that doesn't fit takes exactly what is left, so a prefix sum decides each item.
    Without a budget here, rows bring _budget and _cap of their own (and tokens, where their text isn't their content).
    """
    sized = ranked if "tokens" in ranked.columns else ranked.withColumn("tokens", scalar.token_estimate(F.coalesce("content", F.lit(""))))
    sized = sized if budget is None else limited(sized, budget, caps)
    sized = sized.withColumn("_free", F.when(F.col("required"), F.lit(0)).otherwise(F.col("tokens")))
    limits = section_limits(sized).select(*_GROUP, "room")
    both = _prefix(sized, "_free").join(limits, list(_GROUP))
    left = F.greatest(F.lit(0).cast("long"), F.col("room") - F.col("before"))
    kept = F.when(F.col("required"), F.col("tokens")).otherwise(F.least("tokens", left))
    outcome = F.when(F.col("required"), "required").when((F.col("tokens") == 0) & (F.col("room") >= 0), "kept").when(kept == 0, "over-budget").when(kept < F.col("tokens"), "truncated").otherwise("kept")
    return both.withColumns({"kept_tokens": kept, "outcome": outcome}).drop("_free", "before", "_budget", "_cap")


def select_whole(ranked: DataFrame, budget: int) -> DataFrame:
    """(envelope_id, array_key, id, tokens): whole items that fit, one after another; smaller later ones may still fit.

    Sequential by nature, so a fold over each envelope's (tokens, id) in section order; only these two travel.
    """
    order = F.coalesce(*[F.when(F.col("array_key") == s, k) for k, s in enumerate(SECTIONS)])
    sized = ranked.withColumn("tokens", scalar.token_estimate(F.coalesce("content", F.lit(""))))
    listed = sized.groupBy("envelope_id").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "rank", "array_key", "id", "tokens"))).alias("s"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.expr("cast(array() as array<boolean>)").alias("out"))
    fits = F.aggregate("s", start, lambda acc, x: F.struct(F.when(x["tokens"] <= acc["left"], acc["left"] - x["tokens"]).otherwise(acc["left"]).alias("left"), F.concat(acc["out"], F.array(x["tokens"] <= acc["left"])).alias("out")), lambda acc: acc["out"])
    return listed.select("envelope_id", F.explode(F.arrays_zip(F.col("s").alias("x"), fits.alias("fits"))).alias("z")).where("z.fits").select("envelope_id", "z.x.array_key", "z.x.id", "z.x.tokens")
