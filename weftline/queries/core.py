"""Queries over items: normalize, filter, dedupe, rank, budget, redact, merge, diff, rendering, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.functions import scalar
from weftline.operators import items as op
from weftline.operators import render
from weftline.plans.bridge import ITEMS_SQL, items
from weftline.schema import AUTHORITY

NOW = "2026-08-15T00:00:00.000Z"
_I = f"with i as ({ITEMS_SQL}) "
_EXPIRED = f"(coalesce(valid_until < '{NOW}', false) or coalesce(valid_from > '{NOW}', false))"
_TOK = "cast(ceil(length({0}) / 4.0) as bigint)"
_UNIVERSAL = "(case when rule is not null and applies_to is null then rule end)"
_REASON = f"case when {_EXPIRED} then 'expired' when relevance < 0.5 then 'below-relevance-threshold' when {_UNIVERSAL} in ('exclude', 'local-only') then 'excluded-by-sensitivity' end"
_RANKED = "row_number() over (partition by envelope_id, array_key order by coalesce(priority, 0) desc, coalesce(relevance, 0) desc, id) as rank"


def _joined(tags: str) -> Column:
    return F.array_join(tags, ",")


@query("normalize_status_trust", _I + "select id, coalesce(status, case when item_type in ('Fact', 'Decision', 'Instruction', 'Constraint') then 'confirmed' when item_type = 'Assumption' then 'unconfirmed' end) as status, coalesce(trust_level, 'unknown') as trust_level, coalesce(provides_data, true) as provides_data, case when trust_level = 'untrusted' then false else coalesce(provides_instructions, false) end as provides_instructions from i")
def normalize_status_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.normalize(items(spark, sf_dir)).select("id", "status", "trust_level", "provides_data", "provides_instructions")


@query("normalize_tags", _I + "select id, array_to_string(list_sort(list_distinct(tags)), ',') as tags, array_to_string(list_sort(list_distinct(scope)), ',') as scope from i")
def normalize_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.normalize(items(spark, sf_dir)).select("id", _joined("tags").alias("tags"), _joined("scope").alias("scope"))


@query("filter_asof", _I + f"select id from i where not {_EXPIRED}")
def filter_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keep(items(spark, sf_dir), as_of=NOW).select("id")


@query("filter_relevance", _I + "select id from i where relevance is null or relevance >= 0.5")
def filter_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keep(items(spark, sf_dir), relevance=0.5).select("id")


@query("filter_scope_tags", _I + "select id from i where (len(scope) = 0 or list_has_any(scope, ['s1', 's2'])) and list_has_any(tags, ['lang:en', 'q0'])")
def filter_scope_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keep(items(spark, sf_dir), scope=["s1", "s2"], tags=["lang:en", "q0"]).select("id")


@query("filter_trust_sensitivity", _I + "select id from i where (trust_level is null or trust_level in ('trusted', 'verified')) and (sensitivity is null or sensitivity in ('public', 'internal'))")
def filter_trust_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keep(items(spark, sf_dir), trust=["trusted", "verified"], most_sensitive="internal").select("id")


@query("filter_arrays", _I + "select id from i where array_key not in ('facts') or relevance is null or relevance >= 0.5")
def filter_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keep(items(spark, sf_dir), relevance=0.5, arrays=["facts"]).select("id")


@query("filter_predicate", _I + "select id from i where length(content) > 1000")
def filter_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keep(items(spark, sf_dir), predicate=F.length("content") > 1000).select("id")


@query("filter_reasons", _I + f"select id, {_REASON} as reason from i")
def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", op.drop_reason(NOW, 0.5).alias("reason"))


_DEDUPED = "d as (select envelope_id, array_key, item_type, arg_min(id, pos) as id, min(pos) as pos, content, case when count(*) > 1 then max(coalesce(priority, 0)) else arg_min(priority, pos) end as priority, arg_min(relevance, pos) as relevance, case when count(*) > 1 then list_sort(list_distinct(flatten(list(tags)))) else arg_min(tags, pos) end as tags, cast(count(*) as bigint) as n from {0} group by envelope_id, array_key, item_type, content)"


@query("dedupe_exact", _I + "," + _DEDUPED.format("i") + " select envelope_id, array_key, id, cast(coalesce(case when n > 1 then priority else (select i.priority from i where i.id = d.id) end, -1) as bigint) as priority, array_to_string(tags, ',') as tags, n from d")
def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dedupe(items(spark, sf_dir)).select("envelope_id", "array_key", "id", F.coalesce("priority", F.lit(-1)).cast("long").alias("priority"), _joined("tags").alias("tags"), "n")


@query("dedupe_dropped", _I + "select id from (select id, row_number() over (partition by envelope_id, array_key, item_type, content order by pos) as r from i) where r > 1")
def dedupe_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dropped_duplicates(items(spark, sf_dir)).select("id")


@query("rank_items", _I + f"select id, cast({_RANKED.replace(' as rank', '')} as int) as rank from i")
def rank_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rank(items(spark, sf_dir)).select("id", "rank")


@query("token_estimate", _I + f"select id, {_TOK.format('content')} as tokens from i")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", scalar.token_estimate(F.col("content")).alias("tokens"))


@query("truncate_text", _I + f"select id, case when {_TOK.format('content')} <= 50 then content else substr(content, 1, 199) || '…' end as text from i")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", scalar.truncate_to_tokens(F.col("content"), F.lit(50)).alias("text"))


BUDGET, CAP = 20_000, {"facts": 4_000}


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = op.normalize(items(spark, sf_dir)).withColumn("reason", op.drop_reason(NOW, 0.5)).where("reason is null")
    return op.rank(op.dedupe(kept))


_LIVE = _I + f", k as (select * from i where ({_REASON}) is null), d0 as (select *, row_number() over (partition by envelope_id, array_key, item_type, content order by pos) as g, count(*) over (partition by envelope_id, array_key, item_type, content) as n, max(coalesce(priority, 0)) over (partition by envelope_id, array_key, item_type, content) as most from k), d as (select * replace (case when n > 1 then most else priority end as priority) from d0 where g = 1), r as (select *, {_RANKED}, {_TOK.format('content')} as tokens, {{0}} as required from d)"
_SECTIONS = ("instructions", "facts", "assumptions", "decisions", "resources")


def _budget_sql(required: str) -> str:
    sums = ", ".join(f"coalesce(sum(case when array_key = '{s}' and not required then tokens end), 0) as t{k}, coalesce(sum(case when array_key = '{s}' and required then tokens end), 0) as m{k}" for k, s in enumerate(_SECTIONS))
    sql, left = _LIVE.format(required) + f", s as (select envelope_id, {sums} from r group by envelope_id)", str(BUDGET)
    prior = "s"
    for k, s in enumerate(_SECTIONS):
        cap = CAP.get(s, 2**60)
        sql += f", s{k} as (select *, least({cap} - m{k}, {left} - m{k}) as room{k}, {left} - m{k} - greatest(0, least(least({cap} - m{k}, {left} - m{k}), t{k})) as left{k} from {prior})"
        prior, left = f"s{k}", f"left{k}"
    room = "case array_key " + " ".join(f"when '{s}' then room{k}" for k, s in enumerate(_SECTIONS)) + " end"
    sql += f", b as (select r.*, {room} as room, coalesce(sum(case when required then 0 else tokens end) over (partition by r.envelope_id, array_key order by rank rows between unbounded preceding and 1 preceding), 0) as before from r join {prior} using (envelope_id))"
    sql += ", f as (select *, case when required then tokens else least(tokens, greatest(0, room - before)) end as kept from b)"
    return sql + ", o as (select *, case when required then 'required' when tokens = 0 and room >= 0 then 'kept' when kept = 0 then 'over-budget' when kept < tokens then 'truncated' else 'kept' end as outcome from f) "


_SUMMARY = "select envelope_id, cast(count(*) as bigint) as items_in, cast(count(*) filter (outcome in ('kept', 'required')) as bigint) as kept, cast(count(*) filter (outcome = 'truncated') as bigint) as truncated, cast(count(*) filter (outcome = 'over-budget') as bigint) as over_budget, cast(sum(kept) as bigint) as tokens_used from o group by envelope_id"


def _summary(selected: DataFrame) -> DataFrame:
    return selected.groupBy("envelope_id").agg(F.count("*").alias("items_in"), F.count_if(F.col("outcome").isin("kept", "required")).alias("kept"), F.count_if(F.col("outcome") == "truncated").alias("truncated"), F.count_if(F.col("outcome") == "over-budget").alias("over_budget"), F.sum("kept_tokens").alias("tokens_used"))


@query("budget_truncate", _budget_sql("false") + _SUMMARY)
def budget_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole selection: normalize, filter, dedupe, rank, fit a token budget; a row an envelope."""
    return _summary(op.select_in_budget(_live(spark, sf_dir).withColumn("required", F.lit(False)), BUDGET, CAP))


@query("budget_required", _budget_sql("pos % 50 = 1") + _SUMMARY)
def budget_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(op.select_in_budget(_live(spark, sf_dir).withColumn("required", F.col("pos") % 50 == 1), BUDGET, CAP))


@query("budget_items", _budget_sql("false") + "select id, outcome, cast(kept as bigint) as kept_tokens from o")
def budget_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.select_in_budget(_live(spark, sf_dir).withColumn("required", F.lit(False)), BUDGET, CAP).select("id", "outcome", "kept_tokens")


@query("section_totals", _budget_sql("false") + "select envelope_id, array_key, cast(count(*) as bigint) as items, cast(sum(kept) as bigint) as tokens from o where kept > 0 group by 1, 2")
def section_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = op.select_in_budget(_live(spark, sf_dir).withColumn("required", F.lit(False)), BUDGET, CAP).where("kept_tokens > 0")
    return chosen.groupBy("envelope_id", "array_key").agg(F.count("*").alias("items"), F.sum("kept_tokens").alias("tokens"))


_ORDER = "case array_key when 'instructions' then 0 when 'facts' then 3 when 'assumptions' then 4 when 'decisions' then 5 else 10 end"


@query("budget_skip", _LIVE.format("false").replace("with i as", "with recursive i as", 1) + f", q as (select envelope_id, array_key, id, tokens, row_number() over (partition by envelope_id order by {_ORDER}, rank) as n from r), w as (select envelope_id, array_key, id, tokens, n, tokens <= 5000 as fits, case when tokens <= 5000 then 5000 - tokens else 5000 end as room from q where n = 1 union all select q.envelope_id, q.array_key, q.id, q.tokens, q.n, q.tokens <= w.room, case when q.tokens <= w.room then w.room - q.tokens else w.room end from w join q on q.envelope_id = w.envelope_id and q.n = w.n + 1) select envelope_id, array_key, id, tokens from w where fits")
def budget_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.select_whole(_live(spark, sf_dir), 5_000)


@query("dropped_summary", _I + f"select reason, cast(count(*) as bigint) as n from (select {_REASON} as reason from i) where reason is not null group by 1")
def dropped_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select(op.drop_reason(NOW, 0.5).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


_DEFAULT = "case sensitivity when 'confidential' then 'redact' when 'restricted' then 'exclude' when 'personal' then 'redact' when 'secret' then 'exclude' else 'allow' end"
_RULE = f"coalesce(case when applies_to = 'external' then rule end, {_UNIVERSAL}, rule, {_DEFAULT})"


@query("redact_rules", _I + f"select id, {_RULE} as rule, case {_RULE} when 'redact' then '[REDACTED]' when 'summarize' then '[SUMMARIZED: ' || length(content) || ' chars omitted]' else content end as content from i where {_RULE} <> 'exclude'")
def redact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.redact(items(spark, sf_dir), "external").select("id", "rule", "content")


@query("redact_counts", _I + f"select {_RULE} as rule, cast(count(*) as bigint) as n from i group by 1")
def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy(op.redaction_rule("external").alias("rule")).agg(F.count("*").alias("n"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the items: the second lacks some, changes the text or the type of others."""
    a = op.normalize(items(spark, sf_dir))
    b = a.where("pos % 10 != 4").withColumns({"content": F.when(F.col("pos") % 6 == 0, F.concat("content", F.lit(" (revised)"))).otherwise(F.col("content")), "item_type": F.when(F.col("pos") % 14 == 5, "Resource").otherwise(F.col("item_type"))})
    return a.where("pos % 10 != 7"), b


_N = _I + ", nn as (select envelope_id, array_key, pos, id, content, item_type, coalesce(status, case when item_type in ('Fact', 'Decision', 'Instruction', 'Constraint') then 'confirmed' when item_type = 'Assumption' then 'unconfirmed' end) as status, priority from i), a as (select * from nn where pos % 10 <> 7), b as (select * replace (case when pos % 6 = 0 then content || ' (revised)' else content end as content, case when pos % 14 = 5 then 'Resource' else item_type end as item_type) from nn where pos % 10 <> 4), m as (select coalesce(a.envelope_id, b.envelope_id) as envelope_id, coalesce(a.id, b.id) as id, case when b.id is null then 'only-a' when a.id is null then 'only-b' when a.item_type <> b.item_type then 'type-mismatch' when a.content = b.content then 'same' when a.status = 'confirmed' and b.status = 'confirmed' then 'conflict' else 'preferred' end as outcome, a.content as ac, b.content as bc from a full outer join b on a.id = b.id) "


@query("merge_items", _N + "select envelope_id, id, outcome, case when outcome in ('only-a', 'same', 'conflict', 'type-mismatch') then ac else bc end as content from m union all select envelope_id, id || '#conflict', outcome, bc from m where outcome in ('conflict', 'type-mismatch')")
def merge_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.merge(*_sides(spark, sf_dir)).select("envelope_id", F.regexp_replace("id", "#conflict:.*", "#conflict").alias("id"), "outcome", "content")


@query("merge_conflicts", _N + "select id, outcome from m where outcome in ('conflict', 'type-mismatch')")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.merge(*_sides(spark, sf_dir)).where("outcome in ('conflict', 'type-mismatch') and not id like '%#conflict:%'").select("id", "outcome")


@query("diff_items", _N + "select id, case outcome when 'only-a' then 'removed' when 'only-b' then 'added' else 'changed' end as kind from m where outcome <> 'same'")
def diff_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.diff(*_sides(spark, sf_dir)).select("id", "kind")


def _envelopes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a = orders.selectExpr("o_orderkey as envelope_id", "case when o_orderkey % 3 <> 0 then o_orderstatus end as objective", "o_orderpriority as security", "date_format(o_orderdate, 'yyyy-MM-dd') as created_at")
    b = orders.selectExpr("o_orderkey as envelope_id", "case when o_orderkey % 4 <> 0 then concat(o_orderstatus, case when o_orderkey % 5 = 0 then '!' else '' end) end as objective", "case when o_orderkey % 7 = 0 then null else o_orderpriority end as security", "case when o_orderkey % 2 = 0 then '2030-01-01' else '1970-01-01' end as created_at")
    return a, b


_ENV = "with a as (select o_orderkey as envelope_id, case when o_orderkey % 3 <> 0 then o_orderstatus end as objective, o_orderpriority as security, strftime(o_orderdate, '%Y-%m-%d') as created_at from orders), b as (select o_orderkey as envelope_id, case when o_orderkey % 4 <> 0 then o_orderstatus || case when o_orderkey % 5 = 0 then '!' else '' end end as objective, case when o_orderkey % 7 = 0 then null else o_orderpriority end as security, case when o_orderkey % 2 = 0 then '2030-01-01' else '1970-01-01' end as created_at from orders) "


@query("merge_envelope_fields", _ENV + "select envelope_id, case when b.created_at >= a.created_at then coalesce(b.objective, a.objective) else coalesce(a.objective, b.objective) end as objective, case when b.created_at >= a.created_at then coalesce(b.security, a.security) else coalesce(a.security, b.security) end as security from a join b using (envelope_id)")
def merge_envelope_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prefer-newer: the later side's field, else the one that is there."""
    a, b = _envelopes(spark, sf_dir)
    both = a.alias("a").join(b.alias("b"), "envelope_id")
    newer = F.col("b.created_at") >= F.col("a.created_at")
    pick = lambda c: F.when(newer, F.coalesce(f"b.{c}", f"a.{c}")).otherwise(F.coalesce(f"a.{c}", f"b.{c}")).alias(c)
    return both.select("envelope_id", pick("objective"), pick("security"))


@query("diff_scalars", _ENV + "select envelope_id, concat_ws(',', case when a.objective is distinct from b.objective then 'objective' end, case when a.security is distinct from b.security then 'security' end) as changed from a join b using (envelope_id) where a.objective is distinct from b.objective or a.security is distinct from b.security")
def diff_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _envelopes(spark, sf_dir)
    both = a.alias("a").join(b.alias("b"), "envelope_id")
    changed = F.concat_ws(",", *[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in ("objective", "security")])
    return both.select("envelope_id", changed.alias("changed")).where("changed != ''")


@query("short_hash", "select doc_id, printf('%08x', list_reduce(list_transform(string_split(text, ''), lambda c: unicode(c)::bigint), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::bigint)) as hash from documents")
def short_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", scalar.short_hash(F.col("text")).alias("hash"))


@query("stable_json", "select event_id, '{\"a\":' || event_id || ',\"user\":' || user_id || ',\"z\":[null,true]}' as json from events")
def stable_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", scalar.stable_json(F.format_string('{ "z": [null, true], "user" : %d, "a": %d }', "user_id", "event_id")).alias("json"))


@query("pointer_get", "select event_id, cast(user_id as varchar) as value, event_type as second from events")
def pointer_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("doc", F.to_json(F.struct(F.struct(F.col("user_id").alias("a/b")).alias("o"), F.array(F.lit("x"), F.col("event_type")).alias("l"))))
    return events.select("event_id", scalar.pointer_get(F.col("doc"), "/o/a~1b").alias("value"), scalar.pointer_get(F.col("doc"), "/l/1").alias("second"))


@query("wrap_untrusted", _I + "select id, case when trust_level = 'untrusted' then '<untrusted-content source=\"' || envelope_id || '\" id=\"' || id || '\">' || chr(10) || content || chr(10) || '</untrusted-content>' else content end as text from i")
def wrap_untrusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", scalar.wrap_untrusted(F.col("content"), F.col("trust_level"), F.col("envelope_id"), F.col("id")).alias("text"))


@query("item_text", "select r_regionkey as id, r_name as text from region union all select 100 + n_nationkey, n_nationkey || ' in ' || n_regionkey from nation")
def item_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("id"), scalar.item_text(F.lit(""), F.lit("Entity"), F.col("r_name"), none, none, none).alias("text"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") + 100).alias("id"), scalar.item_text(none, F.lit("Relationship"), none, none, none, F.concat_ws(" ", "n_nationkey", F.lit("in"), "n_regionkey")).alias("text"))
    return region.union(nation)


@query("group_by_authority", "select o_custkey as envelope_id, case o_orderkey % 6 when 0 then 'system' when 1 then 'developer' when 2 then 'application' when 3 then 'user' when 4 then 'tool' else 'retrieved-content' end as authority, string_agg(o_orderpriority, chr(10) order by o_orderkey) as text from orders group by 1, 2")
def group_by_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    authority = F.array(*map(F.lit, AUTHORITY))[(F.col("o_orderkey") % 6).cast("int")]
    return render.by_authority(orders.select(F.col("o_custkey").alias("envelope_id"), authority.alias("authority"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("text")))


@query("context_block", _I + ", t as (select envelope_id, array_key, string_agg('- ' || substr(content, 1, 40), chr(10) order by pos) as lines from i where array_key <> 'instructions' group by 1, 2) select envelope_id, string_agg('## ' || array_key || chr(10) || lines, chr(10) || chr(10) order by case array_key when 'facts' then 0 when 'assumptions' then 1 when 'decisions' then 2 else 3 end) as block from t group by 1")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.context_block(items(spark, sf_dir).withColumn("text", F.substring("content", 1, 40)))


@query("context_block_whole", _I + ", t as (select envelope_id, array_key, string_agg('- ' || content, chr(10) order by pos) as lines from i where array_key <> 'instructions' group by 1, 2) select envelope_id, string_agg('## ' || array_key || chr(10) || lines, chr(10) || chr(10) order by case array_key when 'facts' then 0 when 'assumptions' then 1 when 'decisions' then 2 else 3 end) as block from t group by 1")
def context_block_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.context_block(items(spark, sf_dir).withColumn("text", F.col("content")))


_CONV = "with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations) "


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("envelope_id"), F.col("turn").alias("pos"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


for _name, _roles in render.CHAT_ROLES.items():
    _case = "case role " + " ".join(f"when '{k}' then '{v}'" for k, v in _roles.items()) + f" else '{render.OTHER_ROLE[_name]}' end"
    _listed = ", ".join(f"'{k}'" for k in _roles)
    _sql = _CONV + f"select conv_id as envelope_id, string_agg({_case} || ': ' || case when role in ({_listed}) then text else '[' || role || '] ' || text end, chr(10) order by turn, role, text) as messages, cast(count(*) as bigint) as n from c group by 1"

    def _chat(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        return render.chat(_turns(spark, sf_dir), name)

    query(f"render_{_name}", _sql)(_chat)


@query("render_markdown", _CONV + "select conv_id as envelope_id, '# Conversation' || chr(10) || chr(10) || string_agg('**' || role || '**: ' || text, chr(10) || chr(10) order by turn, role, text) as markdown from c group by 1")
def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.markdown(_turns(spark, sf_dir))


@query("render_mcp", "select doc_id, 'context://' || source || '/' || doc_id as uri, 'application/json' as mime_type, cast(length(text) as bigint) as chars from documents")
def render_mcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = render.resource(items(spark, sf_dir))
    return made.select(F.col("pos").alias("doc_id"), "uri", "mime_type", F.length(F.get_json_object("text", "$.content")).cast("long").alias("chars"))


@query("export_markdown", _I + "select id, '- `' || id || '`' || case when status is not null then ' [' || status || ']' else '' end || case when trust_level is not null then ' (trust: ' || trust_level || ')' else '' end || ': ' || content as line from i")
def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", render.markdown_line().alias("line"))


@query("validate_items", _I + ", v as (select id, unnest([case when relevance is null then '/relevance required' end, case when priority > 90 then '/priority maximum' end, case when trust_level = 'untrusted' and coalesce(provides_instructions, false) then '/trust untrusted-instructs' end, case when status not in ('confirmed', 'unconfirmed') then '/status enum' end]) as violation from i) select id, violation from v where violation is not null")
def validate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.validate import item_rules, violations

    rules = {**item_rules(), "/relevance required": F.col("relevance").isNull(), "/priority maximum": F.col("priority") > 90, "/status enum": ~F.col("status").isin("confirmed", "unconfirmed")}
    return violations(items(spark, sf_dir), rules).select("id", "violation")


@query("substring_coverage", "select b.item_id, cast(count(d.doc_id) as bigint) as documents from benchmark b left join documents d on contains(d.text, b.text) group by 1")
def substring_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each benchmark text whole. Joined on the texts' first three words, then compared."""
    from weftline.operators.metrics import coverage

    return coverage(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("adapter_loss", _CONV + "select conv_id as envelope_id, 1.0 - avg(case when role in ('user', 'assistant') then 1.0 else 0.0 end) as loss from c where text <> '' group by 1")
def adapter_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of texts that a renderer which takes only two roles loses."""
    turns = _turns(spark, sf_dir).where("text != ''")
    return turns.groupBy("envelope_id").agg((1 - F.avg(F.col("role").isin("user", "assistant").cast("double"))).alias("loss"))
