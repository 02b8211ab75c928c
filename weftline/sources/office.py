"""Office archives and PDF: documents, slides, workbooks, pages; what can't be read is said as a warning, not lost in silence."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable

from weftline.sources.sections import Parsed, listed, section, warn

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DC = "{http://purl.org/dc/elements/1.1/}"


def open_archive(data: bytes, most_entries: int = 10_000, most_ratio: float = 100.0, most_bytes: int = 500 << 20) -> zipfile.ZipFile:
    """The archive if its directory is harmless: names, counts, sizes and ratios, before anything is unpacked."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    entries = archive.infolist()
    if len(entries) > most_entries or sum(e.file_size for e in entries) > most_bytes:
        raise ValueError("archive too large")
    for e in entries:
        name = e.filename.replace("\\", "/")
        if "\0" in name or name.startswith("/") or re.match("[a-zA-Z]:", name) or ".." in name.split("/") or e.file_size / max(1, e.compress_size) > most_ratio:
            raise ValueError(f"archive entry {name[:80]} refused")
    if "[Content_Types].xml" not in archive.namelist():
        raise ValueError("not an office archive")
    return archive


def _core_title(archive: zipfile.ZipFile) -> str | None:
    if "docProps/core.xml" not in archive.namelist():
        return None
    return (ET.fromstring(archive.read("docProps/core.xml")).findtext(f"{_DC}title") or "").strip() or None


def parse_docx(data: bytes) -> Parsed:
    """Sections at headings; the title is that of the core properties."""
    archive = open_archive(data)
    body = ET.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    parts, heading, lines = [], None, []

    def flush() -> None:
        content = "\n\n".join(x for x in [heading or "", *lines] if x)
        if content:
            parts.append(section(0, content, heading, heading))
        lines.clear()

    for node in body if body is not None else []:
        if node.tag == f"{_W}tbl":
            rows = [" | ".join("".join(t.text or "" for t in c.iter(f"{_W}t")) for c in r.iter(f"{_W}tc")) for r in node.iter(f"{_W}tr")]
            lines.append("\n".join(rows))
            continue
        text = "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
        style = next((s.get(f"{_W}val") or "" for s in node.iter(f"{_W}pStyle")), "")
        if re.match(r"(?i)heading\s*[1-6]|title", style) and text:
            flush()
            heading = text
        elif text:
            lines.append(f"- {text}" if node.find(f".//{_W}numPr") is not None else text)
    flush()
    if not parts:
        warn("empty-content", "no text in this document")
    return _core_title(archive), listed(parts)


def _paragraphs(node: ET.Element) -> list[str]:
    return [x for p in node.iter(f"{_A}p") if (x := "".join(t.text or "" for t in p.iter(f"{_A}t")).strip())]


def parse_pptx(data: bytes, most_slides: int = 5_000) -> Parsed:
    """A section a slide: its title, paragraphs, then tables; speaker notes beside it. The first slide's title is the document's."""
    archive = open_archive(data)
    names = set(archive.namelist())
    slides = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    if len(slides) > most_slides:
        raise ValueError("too many slides")
    parts, document_title = [], None
    for number, (_, name) in enumerate(slides, 1):
        root = ET.fromstring(archive.read(name))
        titled = (s for s in root.iter(f"{_P}sp") if any(p.get("type") in ("title", "ctrTitle") for p in s.iter(f"{_P}ph")))
        title = next((" ".join(x) for s in titled if (x := _paragraphs(s))), None)
        document_title = title if number == 1 else document_title
        lines = [x for x in _paragraphs(root) if x != title]
        tables = []
        for table in root.iter(f"{_A}tbl"):
            rows = [" | ".join("".join(t.text or "" for t in c.iter(f"{_A}t")).strip() for c in r.iter(f"{_A}tc")) for r in table.iter(f"{_A}tr")]
            tables += ["\n".join(rows)] if rows else []
        if not lines and not tables and title is None:
            warn("empty-content", f"slide {number} has no text")
        if any(re.search(r"chart|diagram", e.tag + "".join(e.keys()) + "".join(e.attrib.values())) for g in root.iter(f"{_P}graphicFrame") for e in g.iter()):
            warn("unsupported-feature", f"slide {number} has a chart or diagram, of which only labels were read")
        if next(root.iter(f"{_P}pic"), None) is not None:
            warn("unsupported-feature", f"slide {number} has an image that was not read")
        beside = f"ppt/notesSlides/notesSlide{number}.xml"
        notes = "\n".join(_paragraphs(ET.fromstring(archive.read(beside)))) if beside in names else ""
        content = "\n\n".join(x for x in [title or "", *lines, *tables] if x)
        if content or notes:
            parts.append(section(0, content or "(no slide text)", title, f"slide {number}", page=number, notes=notes or None))
    if not parts:
        warn("empty-content", "no text in this presentation")
    return document_title, listed(parts)


def _column(reference: str | None, after: int) -> int:
    """The column, from zero, of a cell's reference; the one after the last where there is none."""
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return after
    n = 0
    for c in letters[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) in the workbook's order; by number where it doesn't say."""
    names = archive.namelist()
    by_number = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
    if "xl/workbook.xml" not in names or "xl/_rels/workbook.xml.rels" not in names:
        return [(f"sheet{k}", n) for k, n in by_number]
    targets = {r.get("Id"): posixpath.normpath(posixpath.join("xl", r.get("Target") or "")) if not (r.get("Target") or "").startswith("/") else (r.get("Target") or "")[1:] for r in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    listed_sheets = [(s.get("name") or "", targets.get(s.get(f"{_R}id"))) for s in ET.fromstring(archive.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    return [(name, part) for name, part in listed_sheets if part in names]


def _harmless(value: str) -> str:
    """No value that a spreadsheet would take for a formula."""
    return "'" + value if re.match(r"[=+\-@\t\r]", value) else value


def parse_xlsx(data: bytes, batch: int = 50, most_rows: int = 500_000, most_sheets: int = 1_000) -> Parsed:
    """Sections of fifty rows a sheet: header and value of each cell that has one, by its column."""
    archive = open_archive(data)
    shared = [] if "xl/sharedStrings.xml" not in archive.namelist() else ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ET.fromstring(archive.read("xl/sharedStrings.xml"))]
    sheets = _sheets(archive)
    if len(sheets) > most_sheets:
        raise ValueError("too many sheets")
    parts, total = [], 0
    for sheet, part in sheets:
        rows: dict[int, dict[int, tuple[str, str | None]]] = {}
        last = 0
        for r in ET.fromstring(archive.read(part)).iter(f"{_S}row"):
            last = int(r.get("r") or last + 1)
            cells, at = {}, 0
            for c in r.iter(f"{_S}c"):
                at = _column(c.get("r"), at)
                value = c.findtext(f"{_S}v") or "".join(t.text or "" for t in c.iter(f"{_S}t"))
                value = shared[int(value)] if c.get("t") == "s" and value else {"1": "true", "0": "false"}.get(value, value) if c.get("t") == "b" else value
                cells[at] = (_harmless(value), c.findtext(f"{_S}f"))
                at += 1
            rows[last] = cells
        total += last
        if total > most_rows:
            warn("truncated", f"row limit {most_rows} reached; sheet {sheet} and those after it were skipped")
            break
        head = {k: v or f"col{k + 1}" for k, (v, _) in rows.get(1, {}).items()}
        for start in range(2, last + 1, batch):
            end = min(start + batch - 1, last)
            lines = ["\n".join(f"{head.get(k, f'col{k + 1}')}: {v}" + (f" (formula: {f})" if f else "") for k, (v, f) in sorted(rows[n].items()) if v) for n in range(start, end + 1) if n in rows]
            if any(lines):
                parts.append(section(0, "\n\n".join(x for x in lines if x), section=sheet, row=start, row_end=end, sheet=sheet))
        if last <= 1:
            warn("empty-content", f"sheet {sheet} has no rows of data")
    if not parts:
        warn("empty-content", "no rows in this workbook")
    return None, listed(parts)


def _pdf_objects(data: bytes) -> dict[int, bytes]:
    return {int(m[1]): m[2] for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}


def _pdf_pages(objects: dict[int, bytes]) -> list[bytes]:
    """Page objects in the order of the page tree; in the file's order where there is none."""
    pages = [k for k, o in objects.items() if re.search(rb"/Type\s*/Page(?![a-zA-Z])", o)]
    root = next((m for o in objects.values() if re.search(rb"/Type\s*/Catalog", o) and (m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", o))), None)
    ordered: list[int] = []

    def visit(number: int, depth: int) -> None:
        node = objects.get(number, b"")
        kids = re.search(rb"/Kids\s*\[(.*?)\]", node, re.S)
        if kids and depth < 50:
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                visit(int(k), depth + 1)
        elif number in pages and number not in ordered:
            ordered.append(number)

    if root:
        visit(int(root[1]), 0)
    return [objects[k] for k in ordered or pages]


def _pdf_stream(part: bytes) -> bytes | None:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", part, re.S)
    if not m:
        return None
    try:
        return zlib.decompress(m[1]) if b"FlateDecode" in part[: m.start()] else m[1]
    except zlib.error:
        return None


def _pdf_literal(raw: bytes) -> str:
    kinds = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    one = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else kinds.get(m[1], b"" if m[1] in (b"\n", b"\r\n") else m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw, flags=re.S).decode("latin-1")


def parse_pdf(data: bytes, most_pages: int = 2000, ocr: Callable[[bytes, int], str] | None = None) -> Parsed:
    """A section a page: text shown by plain string operators of unencrypted, plain or deflated streams, a subset of the format.

    ocr gets the file and the number of a page without text.
    """
    if not data.startswith(b"%PDF-"):
        raise ValueError("not a PDF")
    objects = _pdf_objects(data)
    pages = _pdf_pages(objects)
    if len(pages) > most_pages:
        raise ValueError("too many pages")
    parts, silent = [], []
    for number, page in enumerate(pages, 1):
        held = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", page, re.S)
        refs = re.findall(rb"(\d+)\s+\d+\s+R", (held[1] or held[2]) if held else b"")
        lines = []
        for body in (_pdf_stream(objects.get(int(k), b"")) for k in refs):
            for shown in re.finditer(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[((?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ", body or b"", re.S):
                raw = [shown[1]] if shown[1] is not None else re.findall(rb"\(((?:\\.|[^\\()])*)\)", shown[2], re.S)
                lines.append("".join(map(_pdf_literal, raw)))
        text = "\n".join(lines).strip()
        if text:
            parts.append(section(0, text, page=number))
            continue
        found = ""
        if ocr is not None:
            try:
                found = (ocr(data, number) or "").strip()
            except Exception as e:  # noqa: BLE001  (a provider's failure is the page's)
                warn("ocr-unavailable", f"page {number}: {type(e).__name__}: {e}"[:200])
                continue
        if found:
            parts.append(section(0, found, page=number))
        elif ocr is not None:
            warn("ocr-unavailable", f"no text was recognized on page {number}")
        else:
            silent.append(number)
    if silent:
        warn("ocr-unavailable", f"pages {', '.join(map(str, silent))} have no text to read")
    if not parts and not pages:
        warn("empty-content", "no pages in this file")
    title = re.search(rb"/Title\s*\(((?:\\.|[^\\()])*)\)", data, re.S)
    return (_pdf_literal(title[1]).strip() or None if title else None), listed(parts)
