"""Compiling envelopes: each one's own policy, filters, dedupe, ranks and token budget, for millions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scalar
from weftline.operators import items as op
from weftline.schema import SECTION_TITLES, SECTIONS


@dataclass(frozen=True)
class Compiled:
    """items: what is kept, with text, tokens, outcome, rank; dropped: (envelope_id, array_key, id, reason, stage) in order of stage;
    sections: all fifteen of each envelope with their tokens; budgets: one row an envelope; errors: warnings and errors."""

    items: DataFrame
    dropped: DataFrame
    sections: DataFrame
    budgets: DataFrame
    errors: DataFrame


def _order() -> Column:
    return F.coalesce(*[F.when(F.col("array_key") == s, k) for k, s in enumerate(SECTIONS)])


def _whole(sized: DataFrame) -> DataFrame:
    """outcome and kept_tokens without truncation: an item that doesn't fit is summarized or left out, later ones may still fit.

    Sequential by nature: a fold over each envelope's numbers in order; texts stay where they are.
    """
    big = F.lit(2**62).cast("long")
    cols = [_order().alias("o"), (~F.col("required")).alias("late"), "rank", "id", F.coalesce("_cap", big).alias("cap"), "tokens", "short"]
    listed = sized.groupBy("envelope_id").agg(F.coalesce(F.any_value("_budget"), big).alias("budget"), F.sort_array(F.collect_list(F.struct(*cols))).alias("s"))
    none = F.expr("cast(array() as array<struct<outcome:string,kept:bigint>>)")
    start = F.struct(F.col("budget").alias("left"), F.lit(-1).alias("o"), F.lit(0).cast("long").alias("own"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        own = F.when(acc["o"] == x["o"], acc["own"]).otherwise(x["cap"])
        room = F.least(own, acc["left"])
        outcome = F.when(~x["late"], "required").when(x["tokens"] <= room, "kept").when(x["short"] <= room, "summarized").otherwise("over-budget")
        took = F.when(outcome.isin("required", "kept"), x["tokens"]).when(outcome == "summarized", x["short"]).otherwise(0)
        return F.struct((acc["left"] - took).alias("left"), x["o"].alias("o"), (own - took).alias("own"), F.concat(acc["out"], F.array(F.struct(outcome.alias("outcome"), took.alias("kept")))).alias("out"))

    fits = F.aggregate("s", start, step, lambda acc: acc["out"])
    found = listed.select("envelope_id", F.explode(F.arrays_zip(F.col("s").alias("x"), fits.alias("f"))).alias("z")).select("envelope_id", F.col("z.x.o").alias("_o"), F.col("z.x.rank").alias("_r"), F.col("z.f.outcome").alias("outcome"), F.col("z.f.kept").alias("kept_tokens"))
    return sized.withColumns({"_o": _order(), "_r": F.col("rank")}).join(found, ["envelope_id", "_o", "_r"]).drop("_o", "_r")


def compile_envelopes(items: DataFrame, policies: DataFrame, as_of: str, summarizer: Callable[[str], str] | None = None, tokenizer: Callable[[Column], Column] = scalar.token_estimate) -> Compiled:
    """items as of envelopes.items_of, policies as of envelopes.policies_of. Envelopes without a policy row are left out.

    Where truncation is allowed an item's cut takes exactly what is left, so a summary never gets a turn; a
    tokenizer other than the estimate needs allow_truncation off.
    """
    long = lambda c: F.floor(c).cast("long")
    budget = F.when(F.col("max_tokens").isNotNull(), F.greatest(F.lit(0).cast("long"), long("max_tokens") - long(F.coalesce("reserved_tokens", F.lit(0.0)))))
    goal = scalar.token_estimate(F.coalesce("objective_text", F.lit("")))
    budgets = policies.select("envelope_id", "max_tokens", "reserved_tokens", budget.alias("effective_budget"), goal.alias("objective_tokens"), (budget - goal).alias("_budget"), "section_budgets", "relevance_threshold", "deduplicate", "allow_truncation", "allow_summarization", "required_ids", "objective")
    own = op.normalize(items).join(budgets, "envelope_id").withColumns(
        {"required": F.coalesce(F.array_contains("required_ids", F.col("id")), F.lit(False)), "_cap": long(F.try_element_at("section_budgets", F.col("array_key")))}
    )
    own = own.drop("required_ids", "section_budgets", "max_tokens", "reserved_tokens", "effective_budget", "objective_tokens", "objective")
    judged = own.withColumn("reason", op.drop_reason(as_of, F.col("relevance_threshold")))
    live = judged.where("reason is null").drop("reason")

    # what isn't deduplicated is a group of its own; conversation is deduplicated like any other array
    same = F.when(F.col("deduplicate"), F.coalesce("content", F.lit(""))).otherwise(F.concat_ws(":", "pos", "id"))
    key = ["envelope_id", "array_key", "item_type"]
    rest = [c for c in live.columns if c not in key]
    tags = F.sort_array(F.array_distinct(F.flatten(F.collect_set("tags"))))
    first = live.withColumn("_same", same).groupBy(*key, "_same").agg(F.min_by(F.struct(*rest), F.struct("pos", "id")).alias("f"), F.count("*").alias("_n"), F.max(F.coalesce("priority", F.lit(0.0))).alias("_most"), tags.alias("_tags")).select(*key, "f.*", "_n", "_most", "_tags")
    kept = first.withColumns({"priority": F.when(F.col("_n") > 1, F.col("_most")).otherwise(F.col("priority")), "tags": F.when(F.col("_n") > 1, F.col("_tags")).otherwise(F.col("tags"))}).drop("_n", "_most", "_tags")
    repeated = live.join(kept.select("envelope_id", "array_key", "pos"), ["envelope_id", "array_key", "pos"], "left_anti")
    sized = op.rank(kept).withColumn("tokens", tokenizer(F.coalesce("text", F.lit(""))).cast("long"))

    if summarizer is None:
        sized = sized.withColumns({"_summary": F.lit(None).cast("string"), "short": F.lit(None).cast("long")})
    else:

        @F.pandas_udf("string")
        def summary(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: summarizer(t or ""))

        sized = sized.withColumn("_summary", F.when(F.col("allow_summarization") & ~F.col("allow_truncation"), summary("text"))).withColumn("short", tokenizer(F.col("_summary")).cast("long"))
    cut = op.select_in_budget(sized.where("allow_truncation")).withColumn("text", F.when(F.col("outcome") == "truncated", scalar.truncate_to_tokens(F.col("text"), F.col("kept_tokens"))).otherwise(F.col("text"))).drop("room")
    whole = _whole(sized.where("not allow_truncation")).drop("_budget", "_cap").withColumn("text", F.when(F.col("outcome") == "summarized", F.col("_summary")).otherwise(F.col("text")))
    fitted = cut.unionByName(whole).drop("short", "_summary")
    chosen = fitted.where("outcome != 'over-budget'")

    drop = lambda rows, reason, stage: rows.select("envelope_id", "array_key", "id", reason.alias("reason"), F.lit(stage).alias("stage"))
    dropped = drop(judged.where("reason is not null"), F.col("reason"), 0).unionByName(drop(repeated, F.lit("duplicate"), 1)).unionByName(drop(fitted.where("outcome = 'over-budget'"), F.lit("over-budget"), 2))

    totals = chosen.groupBy("envelope_id", "array_key").agg(F.count("*").alias("n"), F.sum("kept_tokens").alias("t"))
    dim = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(s).alias("array_key"), F.lit(SECTION_TITLES[s]).alias("title")) for k, s in enumerate(SECTIONS)])
    frame = budgets.select("envelope_id", F.explode(dim).alias("d")).select("envelope_id", "d.*").join(totals, ["envelope_id", "array_key"], "left")
    sections = frame.select("envelope_id", "position", "array_key", "title", F.coalesce("n", F.lit(0)).alias("items"), F.coalesce("t", F.lit(0)).alias("tokens"))
    used = totals.groupBy("envelope_id").agg(F.sum("t").alias("t"))
    summary_rows = budgets.join(used, "envelope_id", "left").select("envelope_id", "max_tokens", "reserved_tokens", "effective_budget", "objective", "objective_tokens", (F.col("objective_tokens") + F.coalesce("t", F.lit(0))).alias("total_tokens"))

    must = sized.where("required")
    upto = F.sum("tokens").over(Window.partitionBy("envelope_id", "array_key").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    limits = _opening(sized, fitted)
    over = must.withColumn("_upto", upto).join(limits, ["envelope_id", "array_key"]).where(F.col("_upto") > F.col("open"))
    error = lambda rows, code, item, level: rows.select("envelope_id", F.lit(code).alias("code"), item.alias("item_id"), F.lit(level).alias("severity"))
    errors = error(over, "REQUIRED_ITEM_OVER_BUDGET", F.col("id"), "fatal").unionByName(error(budgets.where("max_tokens is null"), "UNBOUNDED_COMPILATION", F.lit(None).cast("string"), "warning"))
    return Compiled(chosen, dropped, sections, summary_rows, errors)


def _opening(sized: DataFrame, fitted: DataFrame) -> DataFrame:
    """(envelope_id, array_key, open): the tighter of a section's cap and what earlier sections have left."""
    used = fitted.groupBy("envelope_id", "array_key").agg(F.sum("kept_tokens").alias("used"))
    caps = sized.groupBy("envelope_id", "array_key").agg(F.any_value("_cap").alias("cap"), F.any_value("_budget").alias("budget")).join(used, ["envelope_id", "array_key"])
    before = F.coalesce(F.sum("used").over(Window.partitionBy("envelope_id").orderBy(_order()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return caps.select("envelope_id", "array_key", F.least(F.coalesce("cap", F.lit(2**62)), F.coalesce(F.col("budget") - before, F.lit(2**62))).alias("open"))
