"""Extractors: a text or its bytes to an array of sections, one Arrow batch at a time.

Each parser is a plain function of one document, so a document is the unit of work and of failure: a parser's
error becomes the row's `error`, not the job's. Text and JSON lines stay in built-in expressions.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from weftline.sources.files import deadline
from weftline.sources.office import open_archive, parse_docx, parse_pdf, parse_pptx, parse_xlsx  # noqa: F401
from weftline.sources.sections import SECTION, listed, section, warn, warnings_now

RESULT = f"struct<title:string,sections:array<{SECTION}>,error:string,warnings:array<struct<code:string,message:string>>>"


def parse_markdown(text: str) -> tuple[str | None, list[dict]]:
    """Sections at headings outside fences; what precedes the first has none. Blank ones are left out."""
    groups: list[tuple[str | None, int, list[str]]] = [(None, 0, [])]
    fence = ""
    for line in re.split(r"\r\n|\r|\n", text):
        mark = re.match(r"(```+|~~~+)", line.strip())
        if mark:
            fence = mark[1] if not fence else "" if line.strip().startswith(fence) else fence
        elif not fence and (head := re.match(r"(#{1,6})\s+(.*)$", line)):
            groups.append((head[2].strip(), len(head[1]), []))
        groups[-1][2].append(line)
    kept = [g for g in groups if any(x.strip() for x in g[2])]
    title = next((t for t, level, _ in kept if level == 1), None)
    return title, listed([section(0, "\n".join(rows).strip(), t, t) for t, _, rows in kept])


def parse_json(text: str) -> tuple[str | None, list[dict]]:
    value = json.loads(text)
    show = lambda v: v if isinstance(v, str) else json.dumps(v, indent=2, ensure_ascii=False)
    if isinstance(value, list):
        return None, [section(i, show(v), section=f"$[{i}]") for i, v in enumerate(value)]
    if isinstance(value, dict):
        return None, listed([section(0, show(v), k, f"$.{k}") for k, v in value.items()])
    return None, [section(0, show(value), section="$")]


def delimited_rows(text: str, delimiter: str) -> list[list[str]]:
    """Quotes toggle anywhere, doubled ones are one; a last empty row is none."""
    rows, row, field, quoted, i = [], [], [], False, 0
    token = re.compile(f'"|{re.escape(delimiter)}|\r\n?|\n')
    while i < len(text):
        m = re.compile('"').search(text, i) if quoted else token.search(text, i)
        if m is None:
            field.append(text[i:])
            break
        field.append(text[i : m.start()])
        i = m.end()
        if quoted:
            if text.startswith('"', i):
                field.append('"')
                i += 1
            else:
                quoted = False
        elif m[0] == '"':
            quoted = True
        else:
            row.append("".join(field))
            field = []
            if m[0] != delimiter:
                rows.append(row)
                row = []
    if "".join(field) or row:
        rows.append([*row, "".join(field)])
    if rows and rows[-1] == [""]:
        rows.pop()
    return rows


def parse_delimited(text: str, delimiter: str = ",") -> tuple[str | None, list[dict]]:
    rows = delimited_rows(text, delimiter)
    if not rows:
        return None, []
    head = [h or f"col{k + 1}" for k, h in enumerate(rows[0])]
    show = lambda r: "\n".join(f"{h}: {r[k] if k < len(r) else ''}" for k, h in enumerate(head))
    return None, [section(i, show(r), row=i + 2) for i, r in enumerate(rows[1:])]


class _Html(HTMLParser):
    DROP = frozenset("script style noscript template iframe object embed nav svg".split())
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main ol p pre section table ul".split())
    BLOCK = frozenset("h1 h2 h3 h4 h5 h6 p li pre blockquote".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []  # [tag, text parts] in document order
        self.open: list[list] = []
        self.dropped = 0
        self.title: list[str] | None = None
        self.table: list | None = None
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.DROP and tag not in self.VOID:
            self.dropped += 1
        if self.dropped:
            return
        if tag == "title" and self.title is None:
            self.title = []
        if self.open and (self.open[-1][0] == "p" and tag in self.ENDS_P or self.open[-1][0] == tag == "li"):
            self.open.pop()  # an implied end
        if tag == "table":
            self.table = [[]]
            self.found.append(["table", self.table])
        elif tag == "tr" and self.table is not None:
            self.table.append([])
        elif tag in ("td", "th") and self.table is not None:
            self.table[-1].append([])
        if tag in ("ul", "ol"):
            self.open.append([tag, []])  # items of a list inside an item don't end it
        if tag in self.BLOCK:
            block = [tag, []]
            self.open.append(block)
            self.found.append(block)
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v and not v.lower().startswith("javascript:")][: max(0, 500 - len(self.links))]

    def handle_endtag(self, tag: str) -> None:
        if tag in self.DROP and self.dropped:
            self.dropped -= 1
            return
        if tag == "table":
            self.table = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        if self.lasttag == "title" and self.title is not None and not self.open:
            self.title.append(data)
            return
        for block in self.open:
            block[1].append(data)
        if self.table is not None and self.table[-1]:
            self.table[-1][-1].append(data)


def parse_html(text: str) -> tuple[str | None, list[dict]]:
    parser = _Html()
    parser.feed(text)
    parser.close()
    parts: list[dict] = []
    heading, body = None, []

    def flush() -> None:
        joined = re.sub(r"\n{3,}", "\n\n", "\n\n".join(body)).strip()
        content = "\n\n".join(x for x in (heading, joined) if x) if heading else joined
        if content:
            parts.append(section(0, content, heading, heading))
        body.clear()

    for tag, inner in parser.found:
        if tag == "table":
            rows = [" | ".join("".join(c).strip() for c in r) for r in inner if r]
            if rows:
                body.append("\n".join(rows))
            continue
        value = "".join(inner).strip()
        if tag[0] == "h" and tag[1:].isdigit():
            flush()
            heading = value or None
        elif value:
            body.append(f"- {value}" if tag == "li" else value)
    flush()
    return ("".join(parser.title or []).strip() or None), listed(parts)


def parse_xml(text: str) -> tuple[str | None, list[dict]]:
    """A section for each element with text of its own. Document types that name entities or files are refused."""
    doctype = re.search(r"<!DOCTYPE[^\[>]*(\[.*?\]\s*)?>", text, re.S | re.I)
    if doctype and re.search(r"SYSTEM|PUBLIC|<!ENTITY", doctype[0], re.I):
        raise ValueError("external or entity document type")
    root = ET.fromstring(text)
    parts: list[dict] = []
    stack = [(root, f"/{root.tag}")]
    while stack:
        node, path = stack.pop()
        own = " ".join(x for x in [(node.text or "").strip(), *[(c.tail or "").strip() for c in node]] if x)
        if own:
            parts.append(section(0, own, section=path))
        seen: dict[str, int] = {}
        children = []
        many = {c.tag for c in node if sum(d.tag == c.tag for d in node) > 1} if len(node) < 200 else {c.tag for c in node}
        for child in node:
            k = seen[child.tag] = seen.get(child.tag, -1) + 1
            children.append((child, f"{path}/{child.tag}" + (f"[{k}]" if child.tag in many else "")))
        stack += reversed(children)
    return root.tag, listed(parts)


PARSERS: dict[str, Callable] = {"markdown": parse_markdown, "json": parse_json, "csv": parse_delimited, "tsv": lambda t: parse_delimited(t, "\t"), "html": parse_html, "xml": parse_xml, "docx": parse_docx, "pptx": parse_pptx, "xlsx": parse_xlsx, "pdf": parse_pdf}


class Registry:
    """Extractors by name. A copy is a scope of its own; PARSERS is what a new one begins with."""

    def __init__(self, parsers: dict[str, Callable] | None = None):
        self._parsers = dict(PARSERS if parsers is None else parsers)

    def register(self, name: str, parser: Callable) -> Registry:
        """Adds an extractor, or replaces the one of that name."""
        self._parsers[name] = parser
        return self

    def unregister(self, name: str) -> bool:
        return self._parsers.pop(name, None) is not None

    def get(self, name: str) -> Callable | None:
        return self._parsers.get(name)

    def names(self) -> list[str]:
        return sorted(self._parsers)

    def copy(self) -> Registry:
        return Registry(self._parsers)


def register(name: str, parser: Callable) -> None:
    """Adds an extractor for all registries that begin from now on, or replaces the one of that name."""
    PARSERS[name] = parser


def _parsed(parser: Callable, given: str | bytes) -> tuple[str | None, list[dict], list[dict]]:
    """title, sections, warnings of a document; blank texts say so."""
    warnings_now()
    title, sections = parser(given)
    said = warnings_now()
    if not any(s["content"].strip() for s in sections) and not any(w["code"] == "empty-content" for w in said):
        said.append({"code": "empty-content", "message": "no text was found"})
    return title, sections, said


def extract(content: Column, name: str, most_chars: int = 20 << 20) -> Column:
    """struct<title, sections, error> of a text (or binary, for office formats and PDF)."""
    parser = PARSERS[name]

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                if text is not None and len(text) > most_chars:
                    raise ValueError("too large")
                title, sections, said = _parsed(parser, text) if text is not None else (None, [], [])
                rows.append((title, sections, None, said))
            except Exception as e:  # noqa: BLE001  (whatever a parser meets is the document's error)
                rows.append((None, [], f"{type(e).__name__}: {e}"[:300], []))
        return pd.DataFrame(rows, columns=["title", "sections", "error", "warnings"])

    return run(content)


#: Fixed value: rows of a batch that a worker reads at once.
SLICE = 64
TEXT_FORMATS = ("text", "markdown", "json", "jsonl", "csv", "tsv", "html", "xml")


def _jsonl(text: str) -> tuple[str | None, list[dict]]:
    found = []
    for number, line in enumerate(re.split(r"\r\n|\r|\n", text), 1):
        if line.strip():
            try:
                value = json.loads(line)
            except ValueError as e:
                warn("malformed-content", f"line {number} was skipped: {e}"[:200])
            else:
                found.append(section(0, json.dumps(value, indent=2, ensure_ascii=False), section=f"$[{len(found)}]"))
    return None, listed(found)


def extract_any(content: Column, text: Column, extractor: Column, most_chars: int = 20 << 20, most_sections: int = 50_000, seconds: float = 60.0, ocr: Callable[[bytes, int], str] | None = None, registry: Registry | None = None) -> Column:
    """struct<title, sections, error, warnings> of inputs of mixed formats: text formats read text, the others content.

    ocr gives the text of a PDF's page in which no text was found. A parser that takes too long fails its own document.
    registry: extractors other than the usual ones.
    """
    own = {n: (registry or Registry()).get(n) for n in (registry or Registry()).names()}
    parsers = {"text": lambda t: (None, [section(0, t)]), "jsonl": _jsonl, **own}
    if ocr is not None and parsers.get("pdf") is parse_pdf:
        parsers["pdf"] = lambda data: parse_pdf(data, ocr=ocr)

    def one(name: str | None, given: str | bytes | None) -> dict:
        try:
            if name is None or given is None:
                raise ValueError("nothing to read")
            if len(given) > most_chars:
                raise ValueError("too large")
            with deadline(seconds):
                if name not in parsers:
                    raise ValueError(f"no extractor {name!r}")
                title, sections, said = _parsed(parsers[name], given)
            if len(sections) > most_sections:
                raise ValueError("too many sections")
            return {"title": title, "sections": sections, "error": None, "warnings": said}
        except Exception as e:  # noqa: BLE001  (whatever a parser meets is the document's error)
            return {"title": None, "sections": [], "error": f"{type(e).__name__}: {e}"[:300], "warnings": []}

    made = to_arrow_type(DataType.fromDDL(RESULT))

    # a batch stays in Arrow; only a slice of it lies in Python objects besides
    @F.arrow_udf(RESULT)
    def run(contents: pa.Array, texts: pa.Array, names: pa.Array) -> pa.Array:
        out = []
        for k in range(0, len(names), SLICE):
            rows = zip(*(a.slice(k, SLICE).to_pylist() for a in (contents, texts, names)), strict=True)
            out.append(pa.array([one(name, decoded if name in TEXT_FORMATS else data) for data, decoded, name in rows], made))
        return pa.concat_arrays(out) if out else pa.array([], made)

    is_text = extractor.isin(*TEXT_FORMATS)  # each input goes to the worker once: its text or its bytes
    return run(F.when(~is_text, content), F.when(is_text, text), extractor)


def extract_text(text: Column) -> Column:
    """One section, the whole text."""
    return F.array(F.struct(F.lit(0).alias("pos"), text.alias("content")))


def extract_jsonl(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, pos, content, error): records by line; blank lines skipped, malformed ones marked and not counted."""
    each = docs.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("_n", "_line")).where(F.trim("_line") != "")
    parsed = F.try_parse_json("_line")
    return each.select(key, (F.col("_n") + 1).alias("line"), F.to_json(parsed).alias("content"), F.when(parsed.isNull(), "malformed").alias("error"))
