"""Ingestion from end to end: inputs to detected, extracted and chunked documents, items of envelopes, and a report.

One narrow pass over the inputs; a document's failure is a row in quarantine, or fails the job if asked to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import mapping, sections
from weftline.sources import detect, extract, files


@dataclass(frozen=True)
class Ingested:
    documents: DataFrame
    chunks: DataFrame
    items: DataFrame
    failed: DataFrame
    report: DataFrame


def extracted(inputs: DataFrame, limits: files.Limits = files.Limits(), tolerant: bool = False, kind: str | None = None, registry: extract.Registry | None = None) -> DataFrame:  # noqa: B008
    """inputs (path, filename, declared, content) with doc_id, content_hash, extractor, title, sections, warnings, error_code, message. kind: an extractor for all."""
    typed = inputs if "error_code" in inputs.columns else inputs.withColumn("error_code", F.lit(None).cast("string"))
    typed = typed.withColumnsRenamed({"error_code": "_code"})
    typed = detect.detect(typed) if kind is None else typed.withColumns({"extractor": F.lit(kind), "score": F.lit(None).cast("int"), "error": F.lit(None).cast("string")})
    text, bad = detect.decode(F.col("content"), tolerant)
    name, digest = detect.identity(F.col("content"))
    # row_id keeps filters on what follows from being pushed below, where they would repeat detection and extraction
    read = typed.withColumns({"_text": text, "_bad": bad, "doc_id": name, "content_hash": digest, "row_id": F.monotonically_increasing_id()})
    read = read.withColumn("x", extract.extract_any(F.col("content"), F.col("_text"), F.when(F.coalesce("_code", "error").isNull(), F.col("extractor")), limits.chars, limits.sections, limits.seconds, registry=registry))
    is_text = F.col("extractor").isin(*extract.TEXT_FORMATS)
    replaced = F.array(F.struct(F.lit("malformed-content").alias("code"), F.lit("bytes that are no UTF-8 were replaced").alias("message")))
    said = F.coalesce("x.warnings", F.expr("cast(array() as array<struct<code:string,message:string>>)"))
    said = F.concat(said, F.when(is_text & F.lit(tolerant) & F.contains("_text", F.lit("\ufffd")) & ~F.contains(F.hex("content"), F.lit("EFBFBD")), replaced).otherwise(F.expr("cast(array() as array<struct<code:string,message:string>>)")))
    code = F.coalesce("_code", "error", F.when(is_text & F.col("_bad").isNotNull(), "extraction-failed"), F.when(F.col("x.error").isNotNull(), "extraction-failed"))
    return read.select("path", "filename", "doc_id", "content_hash", "extractor", F.octet_length("content").alias("bytes"), "x.title", "x.sections", said.alias("warnings"), code.alias("error_code"), F.coalesce("_bad", "x.error").alias("message"), F.monotonically_increasing_id().alias("row_id"))


def ingest(inputs: DataFrame, envelope_id: str = "ingested", options: sections.Options = sections.Options(), limits: files.Limits = files.Limits(), stop_on_error: bool = False, kind: str | None = None, stored: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Ingested:  # noqa: B008
    """One envelope for all inputs, as a directory's ingestion makes it.

    All five frames derive from the extracted rows; stored may write these as a table and read it back, so that inputs are read once.
    """
    rows = stored(extracted(inputs, limits, kind=kind))
    if stop_on_error:
        rows = files.failing(rows)
    good, failed = files.split(rows)
    placed = F.transform("sections", lambda s: F.struct(s["pos"].alias("pos"), s["title"].alias("title"), s["section"].alias("section"), s["content"].alias("content"), F.when(F.col("extractor") != "pptx", s["page"]).alias("page"), F.when(F.col("extractor") == "pptx", s["page"]).alias("slide"), s["sheet"].alias("sheet"), s["row"].alias("row_start"), s["row_end"].alias("row_end")))
    made = sections.chunk_documents(good.withColumn("sections", placed), options)
    heads = good.select("doc_id", "path", "filename", F.col("title").alias("_title")).dropDuplicates(["doc_id"])
    both = made.join(heads, "doc_id")
    resources = mapping.resources(both.select(F.lit(envelope_id).alias("envelope_id"), F.col("id").alias("chunk_id"), F.coalesce("title", "_title").alias("title"), "filename", F.col("path").alias("source_uri"), "content", "index"))
    counts = made.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    status = rows.agg(F.count_if(F.col("error_code").isNull()).alias("processed"), F.count_if(F.col("error_code").isNotNull()).alias("failed"), F.coalesce(F.sum(F.when(F.col("error_code").isNull(), F.size("sections"))), F.lit(0)).alias("sections"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"))
    report = status.withColumn("k", F.lit(1)).join(counts.withColumn("k", F.lit(1)), "k").select("processed", "failed", "sections", "chunks", "tokens", "warnings")  # one row each
    return Ingested(good, made, mapping.with_instruction(resources), failed, report)
