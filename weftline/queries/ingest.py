"""Queries over sources: detection, decoding, guards, extraction, chunking, mapping, patches, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators import chunk, mapping, patch, validate
from weftline.sources import detect, extract, guards
from weftline.streaming import events as streams


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(chunks: Column) -> list[Column]:
    return [F.size(chunks).cast("long").alias("n"), F.md5(F.array_join(chunks, "\x02")).alias("digest")]


_TRIM = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"
_NONE = "[]::varchar[]"


def _pack_sql(units: str, most: int, sep: str) -> str:
    return f"(select case when len(u) = 0 then {_NONE} else (select list_append(z.out, z.now) from (select list_reduce(list_transform(u, lambda x: {{'out': {_NONE}, 'now': x}}), lambda a, x: case when length(a.now) + {len(sep)} + length(x.now) <= {most} then {{'out': a.out, 'now': a.now || '{sep}' || x.now}} else {{'out': list_append(a.out, a.now), 'now': x.now}} end) as z)) end from (select {units} as u))"


@query("chunk_paragraphs", f"select doc_id, cast(len(c) as bigint) as n, md5(array_to_string(c, chr(2))) as digest from (select doc_id, {_pack_sql(_TRIM, 2000, '@@')} as c from documents)")
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for paragraphs here, as the table's texts have no blank lines."""
    return _docs(spark, sf_dir).select("doc_id", chunk.pack(chunk.lines(F.col("text")), 2000, "@@").alias("c")).select("doc_id", *_digest(F.col("c")))


@query("chunk_sentences")
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", chunk.sentences(F.col("text")).alias("c")).select("doc_id", *_digest(F.col("c")))


@query("chunk_characters")
def chunk_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", chunk.characters(F.col("text")).alias("c")).select("doc_id", *_digest(F.col("c")))


@query("chunk_undersized")
def chunk_undersized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", chunk.merge_undersized(chunk.lines(F.col("text")), 200, 2000).alias("c")).select("doc_id", *_digest(F.col("c")))


@query("chunk_max_tokens")
def chunk_max_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", chunk.fit_tokens(F.array("text"), 300).alias("c")).select("doc_id", *_digest(F.col("c")))


@query("chunk_ids", f"with u as (select doc_id, unnest(list_distinct({_TRIM})) as content, sha256(text) as h from documents) select doc_id, cast(count(*) as bigint) as chunks, cast(sum(cast(ceil(length(content) / 4.0) as bigint)) as bigint) as tokens, doc_id || ':chunk:' || substr(any_value(h), 1, 12) || ':0' as first_id from u group by 1")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk's id: the document's, the beginning of the document's hash, the chunk's number."""
    each = _docs(spark, sf_dir).select("doc_id", F.explode(chunk.numbered(chunk.lines(F.col("text")), F.col("doc_id").cast("string"), F.sha2("text", 256))).alias("x"))
    return each.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("x.tokens").alias("tokens"), F.min_by("x.id", "x.index").alias("first_id"))


@query("chunk_rows", "select l_orderkey, string_agg('line: ' || l_linenumber || chr(10) || 'part: ' || l_partkey, chr(10) || chr(10) order by l_linenumber, cast(l_partkey as varchar)) as content, cast(count(*) as bigint) as n from lineitem group by 1")
def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one order stay together, in order."""
    line = F.concat(F.lit("line: "), "l_linenumber", F.lit("\npart: "), "l_partkey")
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("t")))).alias("r"))
    return rows.select("l_orderkey", F.array_join(F.transform("r", lambda x: x["t"]), "\n\n").alias("content"), F.size("r").cast("long").alias("n"))


@query("chunk_strategy", "select lang, case when max(length(text)) > 30000 then 'pages' when count(*) > 200 then 'rows' else 'paragraphs' end as strategy from documents group by 1")
def chunk_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0)
    sums = _docs(spark, sf_dir).groupBy("lang").agg(F.max(F.length("text")).alias("m"), F.count("*").alias("n"))
    return sums.select("lang", chunk.strategy((F.col("m") > 30000).cast("int"), zero, (F.col("n") > 200).cast("int"), zero).alias("strategy"))


@query("extract_text", "select doc_id, cast(1 as bigint) as sections, text as content from documents")
def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", extract.extract_text(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("sections"), F.col("s")[0]["content"].alias("content"))


def _sections(rows: DataFrame, key: str, content: Column, name: str) -> DataFrame:
    return rows.select(key, extract.extract(content, name).alias("x")).select(key, "x.title", F.size("x.sections").cast("long").alias("sections"), F.coalesce("x.error", F.lit("")).alias("error"), F.md5(F.array_join(F.transform("x.sections", lambda s: F.concat_ws("|", s["section"], s["content"])), "\x02")).alias("digest"))


@query("extract_markdown", "select doc_id, 'T' || doc_id as title, cast(2 as bigint) as sections, '' as error, md5('T' || doc_id || '|# T' || doc_id || chr(10) || lang || chr(2) || 'S|## S' || chr(10) || source) as digest from documents")
def extract_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# T"), "doc_id", F.lit("\n"), "lang", F.lit("\n## S\n"), "source", F.lit("\n"))
    return _sections(_docs(spark, sf_dir), "doc_id", text, "markdown")


@query("extract_json", "select event_id, cast(null as varchar) as title, cast(2 as bigint) as sections, '' as error, md5('$.user|' || user_id || chr(2) || '$.kind|' || event_type) as digest from events")
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    return _sections(rows, "event_id", F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind"))), "json")


@query("extract_jsonl", "select doc_id, cast(1 as bigint) as line, '{\"a\":' || doc_id || '}' as content, cast(null as varchar) as error from documents union all select doc_id, 3, null, 'malformed' from documents")
def extract_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit('{ "a": '), "doc_id", F.lit(" }\n\n{oops\n")).alias("text"))
    return extract.extract_jsonl(rows).select("doc_id", F.col("line").cast("long").alias("line"), "content", "error")


@query("extract_csv", "select n_nationkey, cast(null as varchar) as title, cast(2 as bigint) as sections, '' as error, md5('a: ' || n_name || chr(10) || 'col2: x,\"y' || chr(2) || 'a: 2' || chr(10) || 'col2: ') as digest from nation")
def extract_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("a,\n"), "n_name", F.lit(',"x,""y"\r\n2\n'))
    return _sections(_table(spark, sf_dir, "nation"), "n_nationkey", text, "csv")


@query("extract_html")
def extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(_table(spark, sf_dir, "pages"), "page_id", F.col("html"), "html")


@query("extract_xml", "select r_regionkey, 'r' as title, cast(2 as bigint) as sections, '' as error, md5('/r/a[0]|' || r_name || chr(2) || '/r/a[1]|2') as digest from region")
def extract_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<r><a>"), "r_name", F.lit("</a><a x='1'>2</a></r>"))
    return _sections(_table(spark, sf_dir, "region"), "r_regionkey", text, "xml")


_NAMES = "case doc_id % 6 when 0 then 'a.TXT' when 1 then 'b.md' when 2 then 'c.csv' when 3 then 'd' when 4 then 'x/e.html' else 'f.xml' end"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of several names; some with a prolog that shows their type."""
    head = F.when(F.col("doc_id") % 6 == 4, "<!DOCTYPE html>").when(F.col("doc_id") % 12 == 3, '{"').when(F.col("doc_id") % 12 == 1, "%PDF-").otherwise("")
    return _docs(spark, sf_dir).select("doc_id", F.expr(_NAMES).alias("filename"), F.lit(None).cast("string").alias("declared"), F.concat(head, F.col("text")).cast("binary").alias("content"))


@query("media_sniff", "select doc_id, case when doc_id % 6 = 4 then 'text/html' when doc_id % 12 = 3 then 'application/json' when doc_id % 12 = 1 then 'application/pdf' end as media_type from documents")
def media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", detect.sniff(F.col("content")).alias("media_type"))


@query("media_by_name", "select doc_id, case doc_id % 6 when 0 then 'text/plain' when 1 then 'text/markdown' when 2 then 'text/csv' when 4 then 'text/html' when 5 then 'application/xml' end as media_type from documents")
def media_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("doc_id", detect.media_type_of_name(F.col("filename")).alias("media_type"))


@query("detect_format", "select doc_id, case when doc_id % 6 = 0 then 'text' when doc_id % 12 = 1 then 'pdf' when doc_id % 6 = 1 then 'markdown' when doc_id % 6 = 2 then 'csv' when doc_id % 12 = 3 then 'json' when doc_id % 6 = 4 then 'html' when doc_id % 6 = 5 then 'xml' end as extractor, case when doc_id % 12 = 9 then 'unsupported' end as error from documents")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(_named(spark, sf_dir)).select("doc_id", "extractor", "error")


@query("decode_guard", "select doc_id, case when doc_id % 4 in (0, 3) then text end as text, case doc_id % 4 when 1 then 'nul-byte' when 2 then 'invalid-utf8' end as error from documents")
def decode_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("text").cast("binary")
    kind = F.col("doc_id") % 4
    mixed = F.when(kind == 0, F.concat(F.unhex(F.lit("EFBBBF")), content)).when(kind == 1, F.concat(content, F.unhex(F.lit("00")))).when(kind == 2, F.concat(content, F.unhex(F.lit("FF")))).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
    text, error = detect.decode(F.col("c"))
    return _docs(spark, sf_dir).select("doc_id", mixed.alias("c")).select("doc_id", text.alias("text"), error.alias("error"))


@query("doc_identity", "select doc_id, 'doc:' || substr(sha256(text), 1, 16) as id, sha256(text) as content_hash from documents")
def doc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, digest = detect.identity(F.col("text").cast("binary"))
    return _docs(spark, sf_dir).select("doc_id", name.alias("id"), digest.alias("content_hash"))


@query("walk_limits", "with f as (select 'd' || (doc_id % 7) || '/' || case when doc_id % 11 = 0 then '.git/' when doc_id % 13 = 0 then '.h' else '' end || lpad(cast(doc_id as varchar), 9, '0') as path, n_chars as length from documents), r as (select *, case when path like '%/.git/%' then 'ignored-directory' when path like '%/.h%' then 'hidden' end as s, regexp_extract(path, '^(.*/)?') as dir from f), t as (select *, sum(case when s is null then length else 0 end) over (order by dir, path) as b from r) select path, coalesce(s, case when b > 500000 then 'limit' end) as skip_reason from t")
def walk_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("d"), F.col("doc_id") % 7, F.lit("/"), F.when(F.col("doc_id") % 11 == 0, ".git/").when(F.col("doc_id") % 13 == 0, ".h").otherwise(""), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    files = _docs(spark, sf_dir).select(path.alias("path"), F.col("n_chars").alias("length"))
    return detect.within_totals(files, 2**40, 500_000).select("path", "skip_reason")


@query("glob_match", "select doc_id, regexp_matches(source, '^src1[^/]?$') as hit from documents")
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", (detect.glob_matches(F.col("source"), "src1?") | detect.glob_matches(F.col("source"), "src1")).alias("hit"))


@query("ip_guard", "with a as (select event_id, event_id % 256 as a, (event_id // 256) % 256 as b, user_id % 300 as c from events) select event_id, (c > 255 or a in (0, 10, 127) or a >= 224 or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 169 and b = 254) or (a = 100 and b between 64 and 127) or (a = 192 and b = 0 and c in (0, 2)) or (a = 198 and b in (18, 19)) or (a = 198 and b = 51 and c = 100) or (a = 203 and b = 0 and c = 113)) as disallowed from a")
def ip_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.concat_ws(".", F.col("event_id") % 256, F.floor(F.col("event_id") / 256) % 256, F.col("user_id") % 300, F.lit("7"))
    return _table(spark, sf_dir, "events").select("event_id", guards.disallowed_ipv4(address).alias("disallowed"))


@query("url_guard", "select page_id, case page_id % 5 when 0 then 'scheme' when 1 then 'userinfo' when 2 then 'address' when 3 then 'address' end as error from pages")
def url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id") % 5
    url = F.when(i == 0, "ftp://h/x").when(i == 1, "http://u:p@h/x").when(i == 2, "http://127.0.0.1/").when(i == 3, "https://localhost/a").otherwise("https://example.org/a?b=c")
    return _table(spark, sf_dir, "pages").select("page_id", guards.url_error(url).alias("error"))


@query("archive_guard", "select doc_id, case doc_id % 5 when 0 then 'path-traversal' when 1 then 'absolute-path' when 2 then 'drive-letter' when 3 then 'compression-ratio' end as error from documents")
def archive_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 5
    name = F.when(i == 0, "a/../b").when(i == 1, "/etc/x").when(i == 2, "C:x").otherwise("word/document.xml")
    return _docs(spark, sf_dir).select("doc_id", guards.entry_error(name, F.lit(10), F.when(i == 3, 5000).otherwise(50)).alias("error"))


@query("response_guard", "select event_id, case when event_id % 8 = 7 then 'too-many-redirects' when user_id % 100 > 90 then 'too-large' when event_id % 5 = 0 then 'status' end as error from events")
def response_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", guards.response_error(F.when(F.col("event_id") % 5 == 0, 404).otherwise(200), F.lit(None).cast("long"), F.col("user_id") % 100, F.lit("gzip"), F.when(F.col("event_id") % 8 == 7, 6).otherwise(0), 90).alias("error"))


@query("map_resources", "select 'd' || doc_id as id, source as envelope_id, coalesce(case when doc_id % 2 = 0 then lang end, 'f' || doc_id) as title, 'untrusted' as trust_level, case when doc_id % 3 = 0 then 'web-page' else 'retrieved-document' end as source_type from documents union all select distinct 'instruction:data-usage', source, cast(null as varchar), 'trusted', 'user' from documents")
def map_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    chunks = _docs(spark, sf_dir).select(F.col("source").alias("envelope_id"), F.concat(F.lit("d"), i).alias("chunk_id"), F.when(i % 2 == 0, F.col("lang")).alias("title"), F.concat(F.lit("f"), i).alias("filename"), F.when(i % 3 == 0, "https://x.org/a").otherwise("file:a").alias("source_uri"), F.col("text").alias("content"), i.alias("index"))
    return mapping.with_instruction(mapping.resources(chunks)).select("id", "envelope_id", "title", "trust_level", "source_type")


@query("ingest_report", f"with u as (select source, doc_id, unnest({_TRIM}) as content from documents) select source as envelope_id, cast(count(distinct doc_id) as bigint) as documents, cast(count(*) as bigint) as chunks, cast(sum(cast(ceil(length(content) / 4.0) as bigint)) as bigint) as tokens from u group by 1")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.report(_docs(spark, sf_dir).select(F.col("source").alias("envelope_id"), "doc_id", F.explode(chunk.lines(F.col("text"))).alias("content")))


_PATCH = '[{"op":"test","path":"/a","value":%s},{"op":"add","path":"/l/-","value":9},{"op":"move","from":"/a","path":"/b"},{"op":"replace","path":"/l/0","value":%s}]'


@query("patch_apply", "select event_id, case when event_id % 3 = 0 then null else '{\"b\":' || event_id || ',\"l\":[' || user_id || ',9]}' end as document, case when event_id % 3 = 0 then 0 else -1 end as failed_at from events")
def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", F.format_string('{"a":%d,"l":[1]}', "event_id").alias("d"), F.format_string(_PATCH, F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("event_id")).cast("string"), F.col("user_id").cast("string")).alias("p"))
    return rows.select("event_id", patch.patched(F.col("d"), F.col("p")).alias("x")).select("event_id", "x.document", F.coalesce("x.failed_at", F.lit(-1)).alias("failed_at"))


@query("validate_patch", "select event_id, '/op enum' as violation from events where event_id % 4 = 0 union all select event_id, '/value required' from events where event_id % 4 = 1 union all select event_id, '/path pattern' from events where event_id % 4 = 2")
def validate_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id") % 4
    rows = _table(spark, sf_dir, "events").select("event_id", F.when(i == 0, "delete").when(i == 1, "add").otherwise("remove").alias("op"), F.when(i == 2, "a~2").otherwise("/a/b").alias("path"), F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("value"))
    return validate.violations(rows, validate.patch_rules()).select("event_id", "violation")


@query("events_hourly", "select date_trunc('hour', ts) as start, event_type, cast(count(*) as bigint) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling(_table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
