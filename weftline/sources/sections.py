"""What a parser gives: a title, sections with their places, and warnings on the side."""

from __future__ import annotations

Parsed = tuple[str | None, list[dict]]
SECTION = "struct<pos:int,title:string,section:string,content:string,row:int,row_end:int,page:int,sheet:string,notes:string>"
#: Kinds of warnings.
WARNING_CODES = ("empty-content", "ocr-unavailable", "unsupported-feature", "truncated", "malformed-content", "partial-extraction", "skipped-entry")

_said: list[tuple[str, str]] = []


def section(pos: int, content: str, title: str | None = None, section: str | None = None, row: int | None = None, page: int | None = None, row_end: int | None = None, sheet: str | None = None, notes: str | None = None) -> dict:
    return {"pos": pos, "title": title, "section": section, "content": content, "row": row, "row_end": row_end, "page": page, "sheet": sheet, "notes": notes}


def listed(parts: list[dict]) -> list[dict]:
    return [p | {"pos": i} for i, p in enumerate(parts)]


def warn(code: str, message: str) -> None:
    """From a parser, about the document at hand."""
    if code not in WARNING_CODES:
        raise ValueError(f"unknown warning {code!r}")
    _said.append((code, message))


def warnings_now() -> list[dict]:
    """The warnings since the last call; a worker reads one document at a time."""
    found = [{"code": c, "message": m} for c, m in _said]
    _said.clear()
    return found
