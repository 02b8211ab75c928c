"""Media types from bytes and names, the scoring of extractors, decoding and identity of documents."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OFFICE = "application/vnd.openxmlformats-officedocument."
EXTENSIONS = {
    "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "json": "application/json", "jsonl": "application/x-ndjson", "ndjson": "application/x-ndjson",
    "csv": "text/csv", "tsv": "text/tab-separated-values", "html": "text/html", "htm": "text/html", "xml": "application/xml", "pdf": "application/pdf",
    "docx": _OFFICE + "wordprocessingml.document", "pptx": _OFFICE + "presentationml.presentation", "xlsx": _OFFICE + "spreadsheetml.sheet",
}
#: id, media types, extensions
EXTRACTORS = (
    ("text", ("text/plain",), ("txt",)), ("markdown", ("text/markdown",), ("md", "markdown")), ("json", ("application/json",), ("json",)),
    ("jsonl", ("application/x-ndjson", "application/jsonl"), ("jsonl", "ndjson")), ("csv", ("text/csv",), ("csv",)), ("tsv", ("text/tab-separated-values",), ("tsv",)),
    ("html", ("text/html",), ("html", "htm")), ("xml", ("application/xml", "text/xml"), ("xml",)), ("pdf", ("application/pdf",), ("pdf",)),
    ("docx", (EXTENSIONS["docx"],), ("docx",)), ("pptx", (EXTENSIONS["pptx"],), ("pptx",)), ("xlsx", (EXTENSIONS["xlsx"],), ("xlsx",)),
)


def extension(filename: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(filename, r"\.([^./]+)$", 1)), F.lit(""))


def media_type_of_name(filename: Column) -> Column:
    table = F.create_map(*map(F.lit, chain.from_iterable(EXTENSIONS.items())))
    return F.try_element_at(table, extension(filename))


def sniff(content: Column) -> Column:
    """The media type that the bytes show, or null."""
    body = F.when(F.startswith(content, F.unhex(F.lit("EFBBBF"))), F.substring(content, 4, 4093)).otherwise(F.substring(content, 1, 4096))
    head = F.regexp_replace(F.decode(F.when(F.is_valid_utf8(body.cast("string")), body).otherwise(F.make_valid_utf8(body.cast("string")).cast("binary")), "UTF-8"), r"^\s+", "")
    names = F.substring(content, 1, 65536)
    office = [F.when(F.contains(names, F.lit(part).cast("binary")), EXTENSIONS[k]) for k, part in (("docx", "word/"), ("pptx", "ppt/"), ("xlsx", "xl/"))]
    return (
        F.when(F.octet_length(content) == 0, F.lit(None).cast("string"))
        .when(F.startswith(content, F.lit("%PDF-").cast("binary")), "application/pdf")
        .when(F.startswith(content, F.unhex(F.lit("504B0304"))), F.coalesce(*office, F.lit("application/zip")))
        .when(F.startswith(head, F.lit("<?xml")), "application/xml")
        .when(head.rlike(r"^(?i:<!doctype html|<html[\s>])"), "text/html")
        .when(head.rlike(r"^[{\[]"), "application/json")
    )


def detect(inputs: DataFrame, jsonl_extension_wins: bool = False) -> DataFrame:
    """Adds extractor, score and error (unsupported, ambiguous) to rows (key, filename, declared, content).

    Twelve extractors score each input: bytes 100, declared type 60 or the name's 40, extension 20, both together 5.
    """
    def judged(t: Column) -> Column:
        weight = F.when(t["sniffed"].isNotNull(), 100).when(t["declared"].isNotNull(), 60).otherwise(40)
        media_type = F.coalesce(t["sniffed"], t["declared"], t["named"])
        within = lambda c, values: F.coalesce(c.isin(*values), F.lit(False))

        def candidate(name: str, media: tuple[str, ...], ends: tuple[str, ...]) -> Column:
            base = F.when(within(media_type, media), weight).otherwise(0) + F.when(within(t["ext"], ends), 20).otherwise(0)
            if name == "jsonl" and jsonl_extension_wins:
                base = base + F.when(within(t["ext"], ends), 200).otherwise(0)
            confirmed = within(t["ext"], ends) | within(t["declared"], media)
            return F.struct((base + F.when(confirmed & (base > 0), 5).otherwise(0)).alias("score"), F.lit(name).alias("id"))

        return once(F.sort_array(F.filter(F.array(*[candidate(*e) for e in EXTRACTORS]), lambda c: c["score"] > 0), asc=False), chosen)

    def chosen(scored: Column) -> Column:
        first, second = F.get(scored, F.lit(0)), F.get(scored, F.lit(1))
        error = F.when(first.isNull(), "unsupported").when(first["score"] == second["score"], "ambiguous")
        return F.struct(F.when(error.isNull(), first["id"]).alias("extractor"), first["score"].alias("score"), error.alias("error"))

    seen = F.struct(sniff(F.col("content")).alias("sniffed"), media_type_of_name(F.col("filename")).alias("named"), extension(F.col("filename")).alias("ext"), F.col("declared").alias("declared"))
    out = inputs.withColumn("_d", once(seen, judged))
    return out.withColumns({k: F.col(f"_d.{k}") for k in ("extractor", "score", "error")}).drop("_d")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value written once, however the optimizer joins projections."""
    return F.transform(F.array(value), body)[0]


def decode(content: Column, tolerant: bool = False, most_invalid: float = 0.05) -> tuple[Column, Column]:
    """(text, error): byte-order marks honoured, NUL always rejected, invalid UTF-8 rejected or replaced up to a share."""
    hexed = F.hex(F.substring(content, 1, 3))
    raw = F.when(F.startswith(hexed, F.lit("FFFE")), F.decode(F.substring(content, 3, 2**30), "UTF-16LE")).when(F.startswith(hexed, F.lit("FEFF")), F.decode(F.substring(content, 3, 2**30), "UTF-16BE"))
    body = F.when(hexed == "EFBBBF", F.substring(content, 4, 2**30)).otherwise(content).cast("string")
    fixed = F.make_valid_utf8(body)
    bad = (F.length(fixed) - F.length(F.replace(fixed, F.lit("�"), F.lit("")))) / F.greatest(F.lit(1), F.octet_length(content))
    text = F.coalesce(raw, F.when(F.is_valid_utf8(body), body), F.when(F.lit(tolerant) & (bad <= most_invalid), fixed))
    error = F.when(F.contains(text, F.lit("\0")), "nul-byte").when(text.isNull(), "invalid-utf8")
    return F.when(error.isNull(), text), error


def identity(content: Column) -> tuple[Column, Column]:
    """(document id, content hash)."""
    digest = F.sha2(content, 256)
    return F.concat(F.lit("doc:"), F.substring(digest, 1, 16)), digest


def within_totals(files: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """Adds skip_reason to a listing (path, length): hidden and ignored folders, and what exceeds the totals in path order.

    Totals are prefixed by folder first, then within it, so no task sees every file.
    """
    reason = F.when(F.col("path").rlike(r"(^|/)(\.git|node_modules|dist|build|coverage)/"), "ignored-directory").when(F.col("path").rlike(r"(^|/)\.[^/]+"), "hidden")
    own = files.withColumns({"skip_reason": reason, "_dir": F.regexp_extract("path", r"^(.*/)?", 0)})
    size = F.when(F.col("skip_reason").isNull(), F.col("length")).otherwise(0)
    count = F.when(F.col("skip_reason").isNull(), 1).otherwise(0)
    sums = own.groupBy("_dir").agg(F.sum(size).alias("s"), F.sum(count).alias("c"))
    before = Window.orderBy("_dir").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_dir", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_s"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_n"))
    upto = Window.partitionBy("_dir").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    both = own.withColumns({"_size": F.sum(size).over(upto), "_count": F.sum(count).over(upto)}).join(sums, "_dir")
    over = (F.col("_s") + F.col("_size") > most_bytes) | (F.col("_n") + F.col("_count") > most_files)
    return both.withColumn("skip_reason", F.coalesce("skip_reason", F.when(over, "limit"))).select("path", "length", "skip_reason")


def glob_matches(path: Column, pattern: str) -> Column:
    """Dot files match; a pattern without a slash matches the last part."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else ("\\" + c if c in ".()+|^$[]{}\\" else c)
        i += 1
    return path.rlike("^" + ("" if "/" in pattern else "(?:.*/)?") + out + "$")
