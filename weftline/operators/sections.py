"""Chunks of whole documents: sections with places (page, slide, sheet, rows, section) to bounded, numbered pieces.

A document's sections are one array, so a document is one unit of work; documents are spread by Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.chunk import windows

PLACE = ("page", "slide", "sheet", "row_start", "row_end", "section")
_PLACE = "page:int,slide:int,sheet:string,row_start:int,row_end:int,section:string"
CHUNK = f"struct<index:int,total:int,content:string,title:string,{_PLACE},tokens:long,places:array<struct<{_PLACE}>>,too_long:boolean>"
ABBREVIATIONS = frozenset("mr. mrs. ms. dr. prof. sr. jr. vs. etc. e.g. i.e. inc. ltd. co.".split())


@dataclass(frozen=True)
class Options:
    strategy: str = "auto"
    max_chars: int = 2000
    max_tokens: int | None = None
    overlap: int = 200
    min_chars: int = 50
    keep_places: bool = True
    dedupe: bool = True
    drop_empty: bool = True
    tokenizer: Callable[[str], int] = lambda text: -(-len(text) // 4)

    def __post_init__(self) -> None:
        if self.max_tokens is not None and (not isinstance(self.max_tokens, int) or self.max_tokens <= 0):
            raise ValueError("max_tokens must be a positive whole number")


@dataclass(frozen=True)
class Piece:
    content: str
    title: str | None
    place: tuple
    places: tuple = ()
    whole: bool = False  # a row: never cut
    too_long: bool = False

    def spot(self) -> tuple:
        """What tells places apart: all but where rows end."""
        return self.place[:4] + self.place[5:]


def _place(s: dict) -> tuple:
    return tuple(s.get(k) for k in PLACE)


def paragraphs(text: str) -> list[str]:
    return [p for x in re.split(r"\n{2,}", text) if (p := x.strip())]


def sentences(text: str) -> list[str]:
    out: list[str] = []
    for part in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])", text):
        if out and out[-1].rsplit(None, 1)[-1:] and out[-1].rsplit(None, 1)[-1].lower() in ABBREVIATIONS:
            out[-1] += " " + part
        else:
            out.append(part)
    return [s for x in out if (s := x.strip())]


def packed(units: Iterable[str], most: int, separator: str) -> list[str]:
    out: list[str] = []
    for u in units:
        if out and len(out[-1]) + len(separator) + len(u) <= most:
            out[-1] += separator + u
        else:
            out.append(u)
    return out


def _bounded(texts: Iterable[str], o: Options) -> list[str]:
    return [w for t in texts for w in ([t] if len(t) <= o.max_chars else windows(t, o.max_chars, o.overlap))]


def _by_units(sections: list[dict], o: Options, split: Callable[[str], list[str]], separator: str) -> list[Piece]:
    return [Piece(t, s.get("title"), _place(s)) for s in sections for t in _bounded(packed(split(s["content"]) or [s["content"]], o.max_chars, separator), o)]


def _structural(sections: list[dict], o: Options, key: Callable[[dict], Any], rows: bool) -> list[Piece]:
    """Whole sections together up to the limit; with keep_places only those of one key."""
    groups: dict[Any, list[dict]] = {}
    for s in sections:
        groups.setdefault(key(s) if o.keep_places else None, []).append(s)
    out: list[Piece] = []
    for group in groups.values():
        runs: list[list[dict]] = []
        size = 0
        for s in group:
            if runs and size + 2 + len(s["content"]) <= o.max_chars:
                runs[-1].append(s)
                size += 2 + len(s["content"])
            else:
                runs.append([s])
                size = len(s["content"])
        for run in runs:
            first, last = run[0], run[-1]
            place = list(_place(first))
            place[4] = last.get("row_end") if last.get("row_end") is not None else last.get("row_start")
            text = "\n\n".join(s["content"] for s in run)
            if len(run) == 1 and len(text) > o.max_chars and not rows:
                parts = paragraphs(text)
                parts = _bounded(packed(parts, o.max_chars, "\n\n") if len(parts) > 1 else [text], o)
                out += [Piece(t, first.get("title"), tuple(place)) for t in parts]
            else:
                places = () if o.keep_places else _distinct(map(_place, run))
                out.append(Piece(text, first.get("title"), tuple(place), places, rows and len(run) == 1))
    return out


def _distinct(places: Iterable[tuple]) -> tuple:
    """Places in order, equal neighbours once; none if there is one only."""
    out: list[tuple] = []
    for p in places:
        if not out or out[-1][:4] + out[-1][5:] != p[:4] + p[5:]:
            out.append(p)
    return tuple(out) if len(out) > 1 else ()


def chosen(sections: list[dict]) -> str:
    """The automatic strategy."""
    for name, place in (("pages", "page"), ("slides", "slide"), ("rows", "row_start")):
        if any(s.get(place) is not None for s in sections):
            return name
    return "sections" if sum(bool(s.get("section") or s.get("title")) for s in sections) > 1 else "paragraphs"


def _cut(sections: list[dict], strategy: str, o: Options) -> list[Piece]:
    if strategy == "characters":
        return [Piece(t, None, (None,) * 6) for t in windows("\n\n".join(s["content"] for s in sections), o.max_chars, o.overlap)]
    if strategy == "paragraphs":
        return _by_units(sections, o, paragraphs, "\n\n")
    if strategy == "sentences":
        return _by_units(sections, o, sentences, " ")
    keys = {"pages": lambda s: s.get("page"), "slides": lambda s: s.get("slide"), "rows": lambda s: s.get("sheet"), "sections": lambda s: s.get("section") or s.get("title") or s.get("pos")}
    if strategy in keys:
        return _structural(sections, o, keys[strategy], strategy == "rows")
    return [Piece(s["content"], s.get("title"), _place(s)) for s in sections if s["content"].strip()]


def _joined(a: Piece, b: Piece, base: Piece, o: Options) -> Piece:
    places = () if o.keep_places else _distinct([*(a.places or (a.place,)), *(b.places or (b.place,))])
    return replace(base, content=f"{a.content}\n\n{b.content}", places=places)


def _grown(pieces: list[Piece], o: Options) -> list[Piece]:
    """Short pieces join the next (whose place they take), the last one the one before it, where both fit."""
    fits = lambda a, b: len(a.content) + 2 + len(b.content) <= o.max_chars and (not o.keep_places or a.spot() == b.spot())
    out: list[Piece] = []
    for p in pieces:
        if out and len(out[-1].content) < o.min_chars and fits(out[-1], p):
            out[-1] = _joined(out[-1], p, p, o)
        else:
            out.append(p)
    if len(out) > 1 and len(out[-1].content) < o.min_chars and fits(out[-2], out[-1]):
        out[-2:] = [_joined(out[-2], out[-1], out[-2], o)]
    return out


def _fitted(piece: Piece, o: Options) -> list[Piece]:
    """A piece of at most max_tokens as it is; a longer one in windows sized by its own characters a token; rows are marked."""
    tokens = o.tokenizer(piece.content)
    if o.max_tokens is None or tokens <= o.max_tokens:
        return [piece]
    if piece.whole:
        return [replace(piece, too_long=True)]
    size = max(20, int(o.max_tokens * len(piece.content) / max(1, tokens) * 0.9))
    texts = windows(piece.content, size, o.overlap)
    for _ in range(4):
        if all(o.tokenizer(t) <= o.max_tokens for t in texts):
            break
        size = max(10, int(size * 0.7))
        texts = [w for t in texts for w in (windows(t, size, o.overlap) if o.tokenizer(t) > o.max_tokens else [t])]
    return [replace(piece, content=t) for t in texts]


def chunk_sections(sections: list[dict], o: Options = Options()) -> list[Piece]:  # noqa: B008
    """Pieces of one document: empty ones out, then repeats, then short ones joined, then the token limit."""
    live = [s | {"content": s["content"] or ""} for s in sections]
    live = [s for s in live if s["content"].strip()] if o.drop_empty else live
    if not live:
        return []
    pieces = _cut(live, chosen(live) if o.strategy == "auto" else o.strategy, o)
    pieces = [p for p in pieces if p.content.strip()] if o.drop_empty else pieces
    if o.dedupe:
        pieces = list({p.content: p for p in reversed(pieces)}.values())[::-1]
    return [q for p in _grown(pieces, o) for q in _fitted(p, o)]


def chunks(sections: Column, options: Options = Options()) -> Column:  # noqa: B008
    """array<CHUNK> of an array of sections (structs with content, and whatever of title, pos and places they have)."""

    @F.pandas_udf(f"array<{CHUNK}>")
    def run(lists: pd.Series) -> pd.Series:
        def one(listed: Any) -> list[tuple]:
            rows = [s if isinstance(s, dict) else s.asDict() for s in (listed if listed is not None else [])]
            found = chunk_sections(rows, options)
            return [(i, len(found), p.content, p.title, *p.place, options.tokenizer(p.content), [dict(zip(PLACE, x, strict=True)) for x in p.places], p.too_long) for i, p in enumerate(found)]

        names = ("index", "total", "content", "title", *PLACE, "tokens", "places", "too_long")
        return lists.map(lambda listed: [dict(zip(names, row, strict=True)) for row in one(listed)])

    return run(sections)


def chunk_documents(documents: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """A row for each chunk of documents (doc_id, content_hash, sections): doc_id, id and the chunk's fields."""
    each = documents.select("doc_id", "content_hash", F.explode(chunks(F.col("sections"), options)).alias("c"))
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("chunk"), F.substring("content_hash", 1, 12), F.col("c.index").cast("string"))
    return each.select("doc_id", name.alias("id"), "c.*")
