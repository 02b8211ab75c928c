"""Queries over whole payloads: two versions of documents as items, of orders as envelopes, merged and compared in every member."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators import combine, patch
from weftline.operators import envelopes as env
from weftline.operators import items as op
from weftline.plans import bridge

NOW = "2026-08-15T00:00:00.000Z"


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents as payloads; the second side differs in one member or another by the remainder of the id."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("envelope_id"), F.col("doc_id").alias("i"), "text")

    def side(second: bool) -> DataFrame:
        i = F.col("i")
        when = lambda k, yes, no: F.when(i % 17 == k, F.lit(yes)).otherwise(F.lit(no)) if second else F.lit(no)
        fields = F.struct(
            F.concat(F.lit("d"), i).alias("id"), when(1, "Resource", "Fact").alias("@type"), F.concat("text", when(2, "!", "")).alias("content"),
            F.when(i % 2 == 0, "confirmed").otherwise("proposed").alias("status"), when(3, "2031-01-01", "2030-01-01").alias("validUntil"), F.array(when(4, "s9", "s1")).alias("scope"),
            F.struct(when(5, True, False).alias("providesInstructions")).alias("trust"), F.array(F.struct(when(6, "other", "cites").alias("kind"))).alias("relationships"),
            F.array(F.lit("t"), when(7, "u", "t")).alias("tags"), when(8, 9, 3).alias("priority"), when(9, 100, 50).alias("tokenEstimate"),
        )
        kept = rows.where("i % 17 != 10") if second else rows.where("i % 17 != 11")
        return kept.select("envelope_id", F.lit("facts").alias("array_key"), i.alias("pos"), F.concat(F.lit("d"), i).alias("id"), F.to_json(fields).alias("payload"))

    return side(False), side(True)


_OUTCOME = "case when i % 17 = 10 then 'only-a' when i % 17 = 11 then 'only-b' when i % 17 = 1 then 'type-mismatch' when i % 17 in (2, 3, 4, 5) then case when i % 2 = 0 then 'content-mismatch' else 'preferred' end else 'same' end"
_D = "with d as (select source as envelope_id, doc_id as i, text from documents) "


@query("merge_payloads", _D + f", m as (select *, {_OUTCOME} as outcome, i % 17 as k from d) select 'd' || i as id, outcome, 0 as part, case when outcome = 'same' and k = 8 then '9' else '3' end as priority, case when outcome = 'only-b' or outcome <> 'same' then '[\"t\",\"t\"]' when k = 7 then '[\"t\",\"u\"]' else '[\"t\"]' end as tags, case when outcome = 'same' and k = 6 then 2 else 1 end as relationships, case when outcome = 'preferred' and k = 3 then '2031-01-01' else '2030-01-01' end as valid_until, case when outcome = 'preferred' and k = 2 then length(text) + 1 else length(text) end as chars from m union all select 'd' || i || '#conflict', outcome, 1, '3', '[\"t\",\"t\"]', 1, case when k = 3 then '2031-01-01' else '2030-01-01' end, case when k = 2 then length(text) + 1 else length(text) end from m where outcome in ('type-mismatch', 'content-mismatch')")
def merge_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = combine.merge_items(*_items(spark, sf_dir))
    f = combine.fields_of(F.col("payload"))
    shown = merged.withColumn("f", f)
    return shown.select(F.regexp_replace(F.get_json_object("payload", "$.id"), "#conflict:.*", "#conflict").alias("id"), "outcome", "part", F.col("f")["priority"].alias("priority"), F.col("f")["tags"].alias("tags"), F.size(F.from_json(F.col("f")["relationships"], "array<string>")).alias("relationships"), F.get_json_object("payload", "$.validUntil").alias("valid_until"), F.length(F.get_json_object("payload", "$.content")).cast("long").alias("chars"))


@query("merge_conflict_report", _D + f"select 'd' || i as id, {_OUTCOME} as reason, 'facts' as array_key, true as renamed from d where {_OUTCOME} in ('type-mismatch', 'content-mismatch')")
def merge_conflict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = combine.conflicts(combine.merge_items(*_items(spark, sf_dir)))
    return found.select("id", "reason", "array_key", F.col("kept_id").rlike("^d[0-9]+#conflict:[0-9a-f]{8}$").alias("renamed"))


@query("merge_prefer_first", _D + f"select 'd' || i as id, '2030-01-01' as valid_until from d where {_OUTCOME} = 'preferred'")
def merge_prefer_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = combine.merge_items(*_items(spark, sf_dir), prefer="a").where("outcome = 'preferred'")
    return merged.select("id", F.get_json_object("payload", "$.validUntil").alias("valid_until"))


@query("diff_payloads", _D + "select 'd' || i as id, case i % 17 when 10 then 'removed' when 11 then 'added' else 'changed' end as kind from d where i % 17 between 1 and 11")
def diff_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.diff_items(*_items(spark, sf_dir)).select("id", "kind")


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders as envelopes in two versions; which member is there or differs follows the key's remainders."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("i"), F.col("o_orderstatus").alias("s"))
    i = F.col("i")
    some = lambda yes, value: F.when(yes, value)

    def side(n: int) -> DataFrame:
        other = 10 if n else 0
        fact = F.struct(F.concat(F.lit("f"), F.lit(n)).alias("id"), F.lit("Fact").alias("@type"), F.col("s").alias("content"))
        shared = F.struct(F.lit("f").alias("id"), F.lit("Fact").alias("@type"), F.lit("same").alias("content"))
        fields = F.struct(
            F.concat(F.lit("o"), i).alias("id"), F.when((i % 2 == 0) & F.lit(n == 1), "2027").otherwise("2026").alias("createdAt"), F.lit(f"1.{0}.0").alias("schemaVersion"),
            some(i % 3 != n, F.struct(F.concat("s", F.lit(other)).alias("summary"))).alias("objective"), some(i % 5 != n, F.struct(F.lit(n).alias("v"))).alias("outputContract"),
            some(i % 7 == 0, F.struct(F.lit("x").alias("level"))).alias("security"), some(i % 4 != 3, F.struct(F.when(i % 4 == n, n).otherwise(7).alias("maxContextTokens"))).alias("tokenPolicy"),
            F.array(shared, fact).alias("facts"), F.array(F.struct(F.lit(f"e{n}").alias("code"))).alias("errors"), F.from_json(F.lit('{"k": %d, "own%d": true}' % (n, n)), "map<string,string>").alias("extensions"),
        )
        return rows.select(F.to_json(fields).alias("document"))

    return side(0), side(1)


_NEWER = "(i % 2 = 0)"


@query(
    "merge_envelopes",
    "with o as (select o_orderkey as i, o_orderstatus as s from orders) select 'o' || i as envelope_id, case when i % 3 = 0 then s || '10' when i % 3 = 1 then s || '0' when true then s || '10' end as objective, case when i % 5 = 0 then 1 when i % 5 = 1 then 0 else 1 end as contract, case when i % 7 = 0 then 'x' end as level, cast(case when i % 4 = 3 then null when i % 4 = 1 then 1 else 7 end as bigint) as tokens, 3 as facts, 'f,f0,f1' as ids, 'e0,e1' as errors, 'k,own0,own1' as extensions, '1' as k from o",
)
def merge_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every envelope, the later one's fields first; here the second is never older."""
    get = lambda p: F.get_json_object("document", p)
    merged = combine.merge_envelopes(*_orders(spark, sf_dir))
    names = F.transform(F.from_json(get("$.facts"), "array<struct<id:string>>"), lambda x: x["id"])
    errors = F.transform(F.from_json(get("$.errors"), "array<struct<code:string>>"), lambda x: x["code"])
    keys = F.sort_array(F.map_keys(F.from_json(get("$.extensions"), "map<string,string>")))
    return merged.select("envelope_id", get("$.objective.summary").alias("objective"), get("$.outputContract.v").cast("int").alias("contract"), get("$.security.level").alias("level"), get("$.tokenPolicy.maxContextTokens").cast("long").alias("tokens"), F.size(names).alias("facts"), F.array_join(names, ",").alias("ids"), F.array_join(errors, ",").alias("errors"), F.array_join(keys, ",").alias("extensions"), get("$.extensions.k").alias("k"))


@query("diff_envelope_fields", "with o as (select o_orderkey as i from orders) select 'o' || i as envelope_id, concat_ws(',', 'objective', 'outputContract', case when i % 4 in (0, 1) then 'tokenPolicy' end) as changed from o")
def diff_envelope_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.changed_fields(*_orders(spark, sf_dir)).select("envelope_id", F.array_join("changed", ",").alias("changed"))


@query("touch_updated_at", f"select 'o' || o_orderkey as envelope_id, '{NOW}' as updated_at, case when o_orderkey % 2 = 0 then '2027' else '2026' end as created_at from orders")
def touch_updated_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _orders(spark, sf_dir)[1].select(combine.touched(F.col("document"), NOW).alias("document"))
    return docs.select(F.get_json_object("document", "$.id").alias("envelope_id"), F.get_json_object("document", "$.updatedAt").alias("updated_at"), F.get_json_object("document", "$.createdAt").alias("created_at"))


@query("patch_target", "select o_orderkey as i, case when o_orderkey % 3 = 1 then null else 'N' end as status, o_orderkey % 3 = 1 as refused from orders")
def patch_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch names its document, none, or another one: then it is refused."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("i"))
    document = F.format_string('{"id":"o%d","s":"O"}', "i")
    target = F.when(F.col("i") % 3 == 0, F.format_string("o%d", "i")).when(F.col("i") % 3 == 1, "elsewhere")
    made = rows.select("i", patch.patched(document, F.lit('[{"op":"replace","path":"/s","value":"N"}]'), target).alias("p"))
    return made.select("i", F.get_json_object("p.document", "$.s").alias("status"), F.col("p.message").isNotNull().alias("refused"))


_RULE = "coalesce(case when applies_to = 'external' then rule end, case when rule is not null and applies_to is null then rule end, rule, case sensitivity when 'confidential' then 'redact' when 'restricted' then 'exclude' when 'personal' then 'redact' when 'secret' then 'exclude' else 'allow' end)"


@query("redact_stamp", f"with i as ({bridge.ITEMS_SQL}), r as (select id, {_RULE} as rule, length(content) as n from i) select id, rule, case when rule <> 'allow' then '{NOW}' end as applied_at, case rule when 'redact' then '#' when 'summarize' then cast(n as varchar) else 'kept' end as content from r where rule <> 'exclude'")
def redact_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each touched item says what was applied and when; summaries by a function of the caller."""
    done = op.redact(bridge.items(spark, sf_dir), "external", "#", NOW, lambda text: F.length(text).cast("string"))
    return done.select("id", "rule", F.col("redaction.applied_at").alias("applied_at"), F.when(F.col("rule").isin("redact", "summarize"), F.col("content")).otherwise("kept").alias("content"))


@query("redact_lists", f"with i as ({bridge.ITEMS_SQL}), r as (select id, {_RULE} as rule from i) select case rule when 'require-consent' then 'requires-consent' when 'exclude' then 'excluded' else rule end as list, id from r where rule in ('require-consent', 'local-only', 'exclude')")
def redact_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.redaction_lists(bridge.items(spark, sf_dir), "external").select("list", "id")


@query("created_envelopes", "select 'n' || n_nationkey as id, n_name as objective, 15 as arrays, '1.0.0' as version from nation")
def created_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.schema import ARRAY_KEYS

    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("objective"))
    made = env.create(rows, NOW)
    empty = sum((F.coalesce(F.get_json_object("document", f"$.{k}") == "[]", F.lit(False)).cast("int") for k in ARRAY_KEYS), F.lit(0))
    return made.select(F.get_json_object("document", "$.id").alias("id"), F.get_json_object("document", "$.objective.summary").alias("objective"), empty.alias("arrays"), F.get_json_object("document", "$.schemaVersion").alias("version"))


@query("generated_ids", "select cast(count(*) as bigint) as n, cast(count(*) as bigint) as ids, true as formed from customer")
def generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.read.parquet(f"{sf_dir}/customer.parquet").select(env.generate_id("item").alias("id"))
    return made.agg(F.count("*").alias("n"), F.approx_count_distinct("id", 0.01).alias("_a"), F.bool_and(F.col("id").rlike("^urn:context:item:[0-9a-f-]{36}$")).alias("formed"), F.count_distinct("id").alias("ids")).select("n", "ids", "formed")


@query("objective_texts", "select o_orderkey as i, concat_ws(' ', case when o_orderkey % 3 <> 0 then o_orderstatus end, case when o_orderkey % 2 = 0 then o_orderpriority || ' done' end, case when o_orderkey % 5 = 0 then 'nothing else' end) as text from orders")
def objective_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    i = F.col("o_orderkey")
    goal = F.struct(F.when(i % 3 != 0, F.col("o_orderstatus")).alias("summary"), F.when(i % 2 == 0, F.array("o_orderpriority", F.lit("done"))).alias("successCriteria"), F.when(i % 5 == 0, F.array(F.lit("nothing else"))).alias("nonGoals"))
    docs = rows.select(i.alias("i"), F.to_json(F.struct(goal.alias("objective"))).alias("document"))
    return docs.select("i", env.objective_text().alias("text"))


@query("signed_records", "select o_orderkey as i, sha256('{\"a\":' || o_orderkey || ',\"b\":\"' || o_orderstatus || '\"}') as signature, true as verified, o_orderkey % 2 = 0 as tampered_verified from orders")
def signed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON without its signature, hashed; every other record is changed before it is verified once more."""
    import hashlib

    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("i"), F.to_json(F.struct(F.lit("none").alias("signature"), F.col("o_orderstatus").alias("b"), F.col("o_orderkey").alias("a"))).alias("document"))
    sign = lambda data: hashlib.sha256(data).hexdigest()
    made = rows.withColumn("signature", env.signed(F.col("document"), sign))
    check = lambda data, given: hashlib.sha256(data).hexdigest() == given
    other = F.when(F.col("i") % 2 == 0, F.col("document")).otherwise(F.regexp_replace("document", '"b":"', '"b":"x'))
    return made.select("i", "signature", env.verified(F.col("document"), F.col("signature"), check).alias("verified"), env.verified(other, F.col("signature"), check).alias("tampered_verified"))
