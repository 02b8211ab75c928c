"""Chunking: units, greedy packing and undersize merging as folds over arrays; character windows in Arrow batches.

A fold's array is one document's units, so its size is a document's. Every function maps a column to a column.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.scalar import has_text, trim_all

_ABBREVIATION = r"(?i)\b(mr|mrs|ms|dr|prof|sr|jr|vs|etc|e\.g|i\.e|inc|ltd|co)\.$"


def _texts(*values: Column) -> Column:
    return F.array(*values).cast("array<string>")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n{2,}"), trim_all), lambda p: p != "")


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), trim_all), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Split after . ! ? before an opening character; joined again after an abbreviation."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])")
    start = F.struct(_texts().alias("out"), F.lit(None).cast("string").alias("now"))

    def step(acc: Column, part: Column) -> Column:
        again = acc["now"].rlike(_ABBREVIATION)
        out = F.when(acc["now"].isNull() | again, acc["out"]).otherwise(F.concat(acc["out"], _texts(acc["now"])))
        return F.struct(out.alias("out"), F.when(again, F.concat(acc["now"], F.lit(" "), part)).otherwise(part).alias("now"))

    joined = F.aggregate(parts, start, step, lambda acc: F.concat(acc["out"], F.when(acc["now"].isNull(), _texts()).otherwise(_texts(acc["now"]))))
    return F.filter(F.transform(joined, trim_all), lambda s: s != "")


def pack(units: Column, most: int, separator: str = "\n\n") -> Column:
    """Greedy windows of at most `most` characters; a longer unit stands alone."""
    start = F.struct(_texts().alias("out"), F.lit(None).cast("string").alias("now"))

    def step(acc: Column, u: Column) -> Column:
        fits = F.length(acc["now"]) + len(separator) + F.length(u) <= most
        fresh = F.struct(acc["out"].alias("out"), u.alias("now"))
        longer = F.struct(acc["out"].alias("out"), F.concat(acc["now"], F.lit(separator), u).alias("now"))
        closed = F.struct(F.concat(acc["out"], _texts(acc["now"])).alias("out"), u.alias("now"))
        return F.when(acc["now"].isNull(), fresh).when(fits, longer).otherwise(closed)

    return F.aggregate(units, start, step, lambda acc: F.when(acc["now"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], _texts(acc["now"]))))


def merge_undersized(chunks: Column, least: int, most: int) -> Column:
    """Chunks shorter than `least` join the next one where the two fit; the last one joins the one before it."""
    forward = F.aggregate(
        chunks,
        F.struct(_texts().alias("out"), F.lit(None).cast("string").alias("now")),
        lambda acc, c: F.when(acc["now"].isNull(), F.struct(acc["out"].alias("out"), c.alias("now")))
        .when((F.length(acc["now"]) < least) & (F.length(acc["now"]) + 2 + F.length(c) <= most), F.struct(acc["out"].alias("out"), F.concat(acc["now"], F.lit("\n\n"), c).alias("now")))
        .otherwise(F.struct(F.concat(acc["out"], _texts(acc["now"])).alias("out"), c.alias("now"))),
        lambda acc: F.when(acc["now"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], _texts(acc["now"]))),
    )

    def backward(merged: Column) -> Column:
        last, before, n = F.element_at(merged, -1), F.try_element_at(merged, F.lit(-2)), F.size(merged)
        fold = (n > 1) & (F.length(last) < least) & (F.length(before) + 2 + F.length(last) <= most)
        return F.when(fold, F.concat(F.slice(merged, F.lit(1), n - 2), _texts(F.concat(before, F.lit("\n\n"), last)))).otherwise(merged)

    return F.when(F.size(chunks) <= 1, chunks).otherwise(F.transform(F.array(forward), backward)[0])


def windows(text: str, most: int, overlap: int, clamp: bool = True) -> list[str]:
    """Windows of `most` characters that end at white space in their second half where there is some.

    An overlap as long as the window would advance by single characters; with `clamp` it stays below it.
    """
    if len(text) <= most:
        return [text] if text else []
    overlap = min(overlap, most // 2) if clamp else overlap
    out, start = [], 0
    while start < len(text):
        end = min(start + most, len(text))
        if end < len(text):
            space = max(text.rfind(" ", start, end), text.rfind("\n", start, end)) - start
            if space > most * 0.5:
                end = start + space
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        if end >= len(text):
            break
        start = end - overlap if end - overlap > start else start + max(1, most - overlap)
    return out


def characters(text: Column, most: int = 2000, overlap: int = 200) -> Column:
    """Sequential within a text: each window starts where the last one ended. Arrow batches, an array a text."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: windows(t or "", most, overlap))

    return split(text)


def fit_tokens(chunks: Column, most: int, overlap: int = 0, retries: int = 4) -> Column:
    """Chunks with none above `most` estimated tokens: windows sized by the chunk's own characters a token."""

    @F.pandas_udf("array<string>")
    def split(lists: pd.Series) -> pd.Series:
        tokens = lambda t: -(-len(t) // 4)

        def one(chunk: str) -> list[str]:
            if tokens(chunk) <= most:
                return [chunk]
            size = max(20, int(most * len(chunk) / tokens(chunk) * 0.9))
            pieces = windows(chunk, size, overlap)
            for _ in range(retries):
                if all(tokens(p) <= most for p in pieces):
                    break
                size = max(10, int(size * 0.7))
                pieces = [q for p in pieces for q in (windows(p, size, overlap) if tokens(p) > most else [p])]
            return pieces

        return lists.map(lambda chunks: [p for c in chunks for p in one(c)])

    return split(chunks)


def strategy(page: Column, slide: Column, row: Column, titled: Column) -> Column:
    """The automatic strategy from what a document's sections have (aggregates over them)."""
    return F.when(page > 0, "pages").when(slide > 0, "slides").when(row > 0, "rows").when(titled > 1, "sections").otherwise("paragraphs")


def numbered(chunks: Column, doc_id: Column, content_hash: Column) -> Column:
    """array<struct<id, index, total, content, tokens>> of a document's chunks, exact repeats left out."""
    kept = F.array_distinct(F.filter(chunks, has_text))
    # bound once a document: in the lambda over its chunks they would be worked out again for each of these
    one = F.struct(kept.alias("kept"), F.concat(doc_id, F.lit(":chunk:"), F.substring(content_hash, 1, 12), F.lit(":")).alias("name"))

    def number(d: Column) -> Column:
        total = F.size(d["kept"])
        return F.transform(d["kept"], lambda c, i: F.struct(F.concat(d["name"], i.cast("string")).alias("id"), i.alias("index"), total.alias("total"), c.alias("content"), F.ceil(F.length(c) / 4).cast("long").alias("tokens")))

    return F.transform(F.array(one), number)[0]
