"""Column builders over items: defaults, texts, token estimates, hashes, canonical JSON, JSON pointers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.schema import CONFIRMED_TYPES, ELLIPSIS

#: All white space that a trim of Unicode text removes.
_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def trim_all(text: Column) -> Column:
    """The pattern of the end is tried at every space of a text, so only texts that end with one are searched."""
    left = F.regexp_replace(text, "^" + _SPACE, "")
    return F.when(F.right(left, F.lit(1)).rlike(_SPACE), F.regexp_replace(left, _SPACE + "$", "")).otherwise(left)


def has_text(text: Column) -> Column:
    """Whether a trim would leave something."""
    return text.rlike("[^" + _SPACE[1:-1])


def units(text: Column, utf16: bool = False) -> Column:
    """Length in code points, or in UTF-16 units where texts may leave the basic plane."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long") if utf16 else F.length(text).cast("long")


def token_estimate(text: Column, utf16: bool = False) -> Column:
    return F.ceil(units(text, utf16) / 4).cast("long")


def truncate_to_tokens(text: Column, tokens: Column) -> Column:
    """The longest prefix with an ellipsis that fits: the whole text if it does, nothing if no token is left."""
    cut = F.concat(F.substring(text, F.lit(1), (4 * tokens - 1).cast("int")), F.lit(ELLIPSIS))
    return F.when(token_estimate(text) <= tokens, text).when(tokens <= 0, "").otherwise(cut)


def default_status(status: Column, kind: Column) -> Column:
    return F.coalesce(status, F.when(kind.isin(*CONFIRMED_TYPES), "confirmed").when(kind == "Assumption", "unconfirmed"))


def default_trust(level: Column, data: Column, instructions: Column) -> tuple[Column, Column, Column]:
    """level, provides_data, provides_instructions; what is untrusted never instructs."""
    level = F.coalesce(level, F.lit("unknown"))
    return level, F.coalesce(data, F.lit(True)), F.when(level == "untrusted", False).otherwise(F.coalesce(instructions, F.lit(False)))


def text_set(values: Column, unicode_order: bool = False) -> Column:
    """Distinct and sorted, by code point or by collation."""
    kept = F.array_distinct(F.coalesce(values, F.array().cast("array<string>")))
    if unicode_order:
        return F.transform(F.array_sort(F.transform(kept, lambda v: F.collate(v, "UNICODE"))), lambda v: v.cast("string"))
    return F.sort_array(kept)


def wrap_untrusted(text: Column, level: Column, source: Column, item_id: Column) -> Column:
    wrapped = F.concat(F.lit('<untrusted-content source="'), F.coalesce(source, F.lit("unknown")), F.lit('" id="'), item_id, F.lit('">\n'), text, F.lit("\n</untrusted-content>"))
    return F.when(level == "untrusted", wrapped).otherwise(text)


def item_text(content: Column, kind: Column, name: Column, role: Column, output: Column, triple: Column) -> Column:
    """content unless empty, else what the type has to say."""
    other = F.when(kind.isin("Task", "Entity", "ToolDefinition"), name).when(kind == "Actor", F.coalesce(name, role)).when(kind == "ToolResult", output).when(kind == "Relationship", triple)
    return F.coalesce(F.nullif(content, F.lit("")), other, F.lit(""))


def stable_json(text: Column) -> Column:
    """Canonical JSON: keys sorted, no space; null stays, absent stays absent."""
    return F.to_json(F.parse_json(text))


def short_hash(text: Column) -> Column:
    """FNV-1a, 32 bits, in hexadecimal, over code points (equal to UTF-16 units in the basic plane)."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    mixed = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")), lambda h: F.lpad(F.lower(F.hex(h)), 8, "0"))
    return F.when(text == "", "811c9dc5").otherwise(mixed)


def pointer_get(document: Column, pointer: str, kind: str = "string") -> Column:
    """The value at a JSON pointer, null where there is none."""
    tokens = [t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:]]
    path = "$" + "".join(f"[{t}]" if t.isdigit() else "['" + t.replace("'", "\\'") + "']" for t in tokens)
    return F.try_variant_get(F.parse_json(document), path, kind)
