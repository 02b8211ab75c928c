"""Queries over whole envelopes as JSON: items, compiling, provider messages, validation, export; and documents end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators import envelopes as env
from weftline.operators import layouts, rules, sections
from weftline.operators.compile import Compiled, compile_envelopes
from weftline.plans import bridge, ingest
from weftline.sources import files

NOW = "2026-08-15T00:00:00.000Z"
_TURNS = "c as (select conv_id as i, turn, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn, coalesce(role, ''), coalesce(text, '')) as n from conversations where conv_id is not null), e as (select distinct i from c)"


def _compiled(spark: SparkSession, sf_dir: str, **overrides: object) -> tuple[DataFrame, Compiled]:
    documents = bridge.envelopes(spark, sf_dir)
    return documents, compile_envelopes(env.items_of(documents), env.policies_of(documents, deduplicate=False, **overrides), NOW)


@query("envelope_items", f"with {_TURNS} select 'c' || i as envelope_id, 'conversation' as array_key, cast(n - 1 as bigint) as pos, text from c union all select 'c' || i, 'instructions', 0, 'Answer exactly.' from e union all select 'c' || i, 'instructions', 1, 'Be brief.' from e where i % 2 = 0 union all select 'c' || i, 'toolResults', 0, '\"ok\"' from e where i % 3 = 0")
def envelope_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return env.items_of(bridge.envelopes(spark, sf_dir)).select("envelope_id", "array_key", "pos", "text")


def _messages_sql(name: str) -> str:
    form = layouts.LAYOUTS[name]
    role = "case role " + " ".join(f"when '{a}' then '{b}'" for a, b, _ in form.roles) + f" else '{form.other[0]}' end"
    mark = "case role " + " ".join(f"when '{a}' then '{m}'" for a, _, m in form.roles) + (" else '[' || role || '] ' end" if form.other[1] is None else " else '' end")
    nl = "chr(10)"
    if form.folded:
        heads = {a: h.replace("\n", "") for a, h in form.folded}
        start = f"'{heads['system']}' || {nl} || " if heads["system"] else ""
        head = f"select i, 0 as p, 0 as n, 'system' as role, {start}'Answer exactly.' || case when i % 2 = 0 then {nl} || {nl} || '{heads['developer']}' || {nl} || 'Be brief.' else '' end as content from e"
    else:
        head = "select i, 0 as p, 0 as n, 'system' as role, 'Answer exactly.' as content from e union all select i, 1, 0, 'developer', 'Be brief.' from e where i % 2 = 0"
    context = f"select i, 2, 0, 'user', 'Context:' || {nl} || {nl} || '## Tool Results' || {nl} || '- \"ok\"' from e where i % 3 = 0"
    last = "select i, 4, 0, 'tool', 'ok' from e where i % 3 = 0" if form.results_as_turns else f"select i, 4, 0, 'user', 'Tool results:' || {nl} || '- lookup (success): ok' from e where i % 3 = 0"
    return f"with {_TURNS}, m as ({head} union all {context} union all select i, 3, n, {role}, {mark} || text from c union all {last}) select 'c' || i as envelope_id, cast(row_number() over (partition by i order by p, n) - 1 as int) as seq, role, content from m"


for _name in layouts.LAYOUTS:

    def _messages(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        _, compiled = _compiled(spark, sf_dir)
        return layouts.messages(compiled.items, compiled.budgets, name).select("envelope_id", "seq", "role", "content")

    query(f"messages_{_name}", _messages_sql(_name))(_messages)


@query("messages_markdown", f"with {_TURNS}, t as (select i, string_agg('**' || role || ':** ' || text, chr(10) || chr(10) order by n) as said from c group by 1) select 'c' || i as envelope_id, rtrim('# Compiled Context: c' || i || chr(10) || chr(10) || '## System Instructions' || chr(10) || chr(10) || 'Answer exactly.' || case when i % 2 = 0 then chr(10) || chr(10) || '## Developer Instructions' || chr(10) || chr(10) || 'Be brief.' else '' end || case when i % 3 = 0 then chr(10) || chr(10) || '## Tool Results' || chr(10) || '- \"ok\"' else '' end || chr(10) || chr(10) || '## Conversation' || chr(10) || chr(10) || said) || chr(10) as text from t")
def messages_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, compiled = _compiled(spark, sf_dir)
    return layouts.markdown(compiled.items, compiled.budgets)


@query("message_notes", "with r as (select conv_id as i, bool_or(coalesce(role, '') not in ('user', 'assistant')) as odd from conversations where conv_id is not null group by 1) select 'c' || i as envelope_id, cast((i % 2 = 0)::int + odd::int + (i % 3 = 0)::int + 1 as int) as notes from r")
def message_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, compiled = _compiled(spark, sf_dir)
    return layouts.notes(compiled.items, compiled.budgets, "generic").select("envelope_id", F.size("notes").alias("notes"))


_OVER = f"with {_TURNS}, x as (select i, 0 as s, 0 as n, 4 as tokens from e union all select i, 0, 1, 3 from e where i % 2 = 0 union all select i, 1, n, cast(ceil(length(text) / 4.0) as bigint) from c union all select i, 2, 0, 1 from e where i % 3 = 0), y as (select *, sum(tokens) over (partition by i order by s, n rows between unbounded preceding and 1 preceding) as before from x), z as (select *, least(tokens, greatest(0, 100 - coalesce(before, 0))) as kept from y) "


@query("compile_budgets", _OVER + "select 'c' || i as envelope_id, cast(sum(kept) as bigint) as total_tokens, cast(count(*) filter (kept = 0 and tokens > 0) as bigint) as over_budget from z group by 1")
def compile_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every envelope in 100 tokens: what it uses, how many of its items find no room."""
    _, compiled = _compiled(spark, sf_dir, max_tokens=120, reserved_tokens=20)
    over = compiled.dropped.where("reason = 'over-budget'").groupBy("envelope_id").agg(F.count("*").alias("n"))
    return compiled.budgets.select("envelope_id", "total_tokens").join(over, "envelope_id", "left").select("envelope_id", "total_tokens", F.coalesce("n", F.lit(0)).alias("over_budget"))


@query("compile_errors", "select distinct 'c' || conv_id as envelope_id, 'UNBOUNDED_COMPILATION' as code, 'warning' as severity from conversations where conv_id is not null")
def compile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, compiled = _compiled(spark, sf_dir)
    return compiled.errors.select("envelope_id", "code", "severity")


@query("validate_envelopes", f"with {_TURNS} select 'c' || i as envelope_id, cast(null as varchar) as array_key, cast(null as bigint) as pos, '/createdAt' as path, 'format' as keyword from e where i % 5 = 0 union all select 'c' || i, 'conversation', n - 1, '/role', 'enum' from c where role not in ('user', 'assistant', 'system', 'tool')")
def validate_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.envelope_violations(bridge.envelopes(spark, sf_dir))


@query("export_envelopes", f"with {_TURNS} select 'c' || i as envelope_id, '# Context: c' || i || chr(10) || chr(10) || '## Instructions' || chr(10) || chr(10) || '- `system-' || i || '`: Answer exactly.' || case when i % 2 = 0 then chr(10) || '- `developer-' || i || '`: Be brief.' else '' end || chr(10) || chr(10) || '## Conversation' || chr(10) || chr(10) || string_agg('- `t-' || i || '-' || turn || '`: ' || text, chr(10) order by n) || case when i % 3 = 0 then chr(10) || chr(10) || '## Tool Results' || chr(10) || chr(10) || '- `r-' || i || '`: r-' || i else '' end || chr(10) as text from c group by i")
def export_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return env.export(bridge.envelopes(spark, sf_dir), "markdown")


@query("mcp_resources", "select distinct 'urn:context:resource:c' || conv_id as uri, 'application/json' as mime_type from conversations where conv_id is not null")
def mcp_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.resource(bridge.envelopes(spark, sf_dir)).select("uri", "mime_type")


_PATH = "case doc_id % 8 when 0 then '.git/a.txt' when 1 then 'src/node_modules/b.txt' when 2 then 'src/c.log' when 3 then 'src/d.md' when 4 then 'top.txt' when 5 then 'src/.h/e.txt' when 6 then 'tmp/f.txt' else 'src/g.txt' end"


@query("skip_reasons", "select doc_id, case doc_id % 8 when 0 then 'hidden' when 1 then 'ignored-directory' when 2 then 'not-included-by-pattern' when 5 then 'hidden' when 6 then 'excluded-by-pattern' end as reason from documents")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", files.skip_reason(F.expr(_PATH), include=["*.txt", "*.md"], exclude=["tmp"]).alias("reason"))


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files; every seventh is broken JSON, every eleventh holds a NUL."""
    i = F.col("doc_id")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.when(i % 7 == 0, "{broken").when(i % 11 == 0, F.concat(F.lit("x\0"), "text")).otherwise(F.concat(F.lit("a "), "text", F.lit(" "), i))
    name = F.when(i % 7 == 0, F.concat(i, F.lit(".json"))).otherwise(F.concat(i, F.lit(".txt")))
    return rows.select(F.concat(F.lit("file:/in/"), name).alias("path"), name.alias("filename"), F.lit(None).cast("string").alias("declared"), text.cast("binary").alias("content"))


@query("ingest_failures", "select case when doc_id % 7 = 0 then doc_id || '.json' else doc_id || '.txt' end as filename, 'extraction-failed' as error_code from documents where doc_id % 7 = 0 or doc_id % 11 = 0")
def ingest_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fails stays in quarantine; the rest goes on."""
    return ingest.ingest(_inputs(spark, sf_dir)).failed.select("filename", "error_code")


@query("chunk_documents")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through all passes of chunking: sentences, repeats, short ones, the token limit, ids."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = F.array(F.struct(F.lit(0).alias("pos"), F.col("text").alias("content")))
    named = rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), one.alias("sections"))
    return sections.chunk_documents(named, sections.Options("sentences", max_tokens=400)).select("doc_id", "id", "index", "total", "tokens", F.md5("content").alias("digest"))
