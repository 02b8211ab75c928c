"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are what fixed patterns find (emails, IP addresses, cards, phones) and long hexadecimal secrets. The text
just before an identifier-like token (16 characters or more, with a digit) is its lexical pattern if it names a
field (ends in ``= : " ' #`` or the like; the last 130 characters count); patterns and token values form a graph.
Rounds of scoring follow: a value's score is one for seeds, else the noisy-or of the confident patterns it stands
beside elsewhere, never of the pattern that it speaks for; a pattern's confidence is the mean score of its distinct
values, times a factor that asks for several of them, and it is confident from a threshold on, if the scores amount
to enough values. So values that confident patterns found make further patterns confident, which discover more.
Patterns and values are keyed without case, so a shouted text shares the evidence of others.
Confident patterns then mark the values beside them as further identifiers: the whole value after a named field
(key=VALUE, key = "VALUE"), of whatever length and shape, else the identifier-like token.

Texts are read twice, once for the graph and once for the spans, and move in no shuffle: patterns go along as
constants while they are at most `inline`; beyond that, rows hear their own by joins of keys. In the graph's tables
sums are partial before each shuffle, and only identifier-like tokens and names of fields enter them.

Positions count code points, ends exclusive. Regular expressions are possessive and take no group in an
unbounded loop, so long texts neither recurse nor retry. Null texts are empty. Repeated rows get their own
spans; a null doc_id is kept. Extra columns are ignored by find() and kept by redact(), whatever their names. Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, hidden, let

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Leftmost, non-overlapping; \G lets a match begin where the last one ended inside a run.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # longer or shorter chains of digits fail the count, so only chains of 16 to 19 digits need a match
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for its kind's pattern to be tried.
_HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Identifier-like tokens: 16 characters or more, judged further by their digits.
TOKEN = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+(?![A-Za-z0-9_+/@-])"
SECRET = r"^(?i)[0-9a-f]{32,}$"
#: A field's name and the marks after it, tight (key=, "key":") or spaced (key = "): the pattern of what follows.
_MARK = r"[^\p{L}\p{N}_\s-]"
NAMED = rf"(?<![\p{{L}}\p{{N}}_-])[\p{{L}}\p{{N}}_-]++(?=[^\p{{L}}\p{{N}}_\n-]{{0,30}}?[=:\"'#]){_MARK}{{0,8}}+(?:[ \t]{{1,3}}+{_MARK}{{1,8}}+){{0,2}}+[ \t]{{0,3}}+"
#: The whole value after a field: after a quote to the next of its kind in the line, else to white space or a closing mark.
_QUOTED = "|".join(f"(?<={q})[^{q}\\n]++(?={q})" for q in "\"'`")
_BARE = r"[^\s\"'`<>,;(){}\[\]&]*[^\s\"'`<>,;(){}\[\]&.:!?]"
VALUED = rf"{NAMED}(?=({_QUOTED}|{_BARE}|))"
#: Without a named field, the end of the text before a token that is its pattern: up to two words and what touches the token.
CONTEXT = r"((?:[^\s\x00]{1,40}[ \t]{1,3}){0,2}[^\s\x00]{0,40})$"
#: A pattern names a field: it holds a mark of assignment or quotation.
FIELD = "[=:\"'#]"


@dataclass(frozen=True)
class Limits:
    rounds: int = 3
    min_values: int = 5
    min_confidence: float = 0.8
    #: Patterns that go along as constants; more are heard by joins.
    inline: int = 200


_NONE = "cast(array() as array<struct<start:int,end:int,value:string,before:string>>)"


def _fold(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], none: str, stretch: int = 256) -> Column:
    """The arrays that step(state, item) gives beside its next state, joined; in stretches, as each append copies what it appends to."""

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["s"], x)
        return F.struct(state.alias("s"), F.concat(acc["o"], out).alias("o"))

    def some(acc: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice(items, k * stretch + 1, F.lit(stretch)), F.struct(acc["s"].alias("s"), F.expr(none).alias("o")), one)
        return let(inner, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")))

    whole = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / stretch).cast("int")), F.struct(start.alias("s"), F.array(F.expr(none)).alias("o")), some, lambda acc: F.flatten(acc["o"]))
    return F.when(F.size(items) > 0, whole).otherwise(F.expr(none))


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value,before>> of a pattern's matches."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"))

    def step(state: Column, m: Column) -> tuple[Column, Column]:
        begin = state["at"] + F.length(m["gap"])
        end = begin + F.length(m["value"])
        one = F.struct(begin.alias("start"), end.alias("end"), m["value"].alias("value"), F.right(F.concat(state["last"], m["gap"]), F.lit(130)).alias("before"))
        return F.struct(end.alias("at"), F.right(m["value"], F.lit(130)).alias("last")), F.array(one)

    zipped = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("value")))
    return let(zipped, lambda both: _fold(both, zero, step, _NONE))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def one(i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(places, F.lit(0), lambda s, i: s + one(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return let(_digits(value), _luhn)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start,end,value,before>> of the kind's valid matches."""
    found = F.filter(_spans(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    hint = F.contains(text, F.lit(_HINTS[kind])) if _HINTS[kind] else F.lit(True)
    return F.when(hint & text.rlike(PATTERNS[kind]), found).otherwise(F.expr(_NONE))


def _with_base(docs: DataFrame) -> DataFrame:
    """docs with _base: array<struct<kind,start,end,value,before>> by kind, then start; _tokens, identifier-like tokens."""
    text = F.coalesce("text", F.lit(""))

    def named(kind: str) -> Column:
        return F.transform(base_spans(text, kind), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["before"].alias("before")))

    tokens = F.when(text.rlike(TOKEN), F.filter(_spans(text, TOKEN), lambda s: s["value"].rlike("[0-9]")))
    return docs.withColumns({"_base": F.concat(*map(named, KINDS)), "_tokens": F.coalesce(tokens, F.expr(_NONE))})


def _context(before: Column) -> Column:
    named = F.regexp_extract(before, f"{NAMED}$", 0)
    return F.lower(F.when(named.rlike(FIELD), named).otherwise(F.regexp_extract(before, CONTEXT, 1)))


def patterns_of(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Confident patterns: (context, confidence, n_values). docs: all texts."""
    keep = lambda s: s["before"].rlike(FIELD)
    based = _with_base(docs.select("text"))
    seeds = F.transform(F.filter("_base", keep), lambda s: F.struct(s["value"].alias("value"), s["before"].alias("before"), F.lit(True).alias("seed")))
    tokens = F.transform(F.filter("_tokens", keep), lambda s: F.struct(s["value"].alias("value"), s["before"].alias("before"), s["value"].rlike(SECRET).alias("seed")))
    each = based.select(F.explode(F.concat(seeds, tokens)).alias("e")).select(F.lower("e.value").alias("value"), "e.seed", _context(F.col("e.before")).alias("context"))
    edges = cut(each.where(F.col("context").rlike(FIELD)).groupBy("context", "value").agg(F.max("seed").alias("seed")), 8)
    scores = edges.withColumn("score", F.col("seed").cast("double"))
    for turn in range(limits.rounds + 1):
        named = scores.groupBy("context").agg(F.avg("score").alias("mean"), F.sum("score").alias("weight"), F.count("*").alias("n_values"))
        named = named.withColumn("confidence", F.col("mean") * (1 - F.exp(-F.col("n_values") / limits.min_values * 1.5)))
        # found values count as much as they are believed, and five seeds' worth of belief makes a pattern
        named = named.where((F.col("confidence") >= limits.min_confidence) & (F.col("weight") >= limits.min_values * limits.min_confidence))
        if turn == limits.rounds:
            return cut(named.select("context", "confidence", "n_values"), 64)
        # a value is right if any of its patterns is: 1 - prod(1 - confidence), over the patterns other than the one it speaks for
        doubt = F.coalesce(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))), F.lit(0.0))
        heard = edges.join(named.select("context", "confidence"), "context", "left").withColumn("doubt", doubt)
        total = heard.groupBy("value").agg(F.sum("doubt").alias("total"))
        found = F.greatest(F.lit(0.0), 1 - F.exp(F.col("total") - F.col("doubt")))
        scores = cut(heard.join(total, "value").select("context", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(found).alias("score")), 8)
    raise AssertionError


def _field_names(text: Column) -> Column:
    """Named fields of a text, lower-cased."""
    return F.filter(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NAMED), F.lit(0)), F.lower)), lambda c: c.rlike(FIELD))


def _value_spans(text: Column, contexts: Column) -> Column:
    """array<struct<start,end>> (with value and before, empty) of the whole values after the named fields that contexts holds."""

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        end = at + F.length(m["gap"]) + F.length(m["name"])
        one = F.array(F.struct(end.alias("start"), (end + F.length(m["value"])).alias("end"), F.lit("").alias("value"), F.lit("").alias("before")))
        return end, F.when((F.length(m["value"]) > 0) & F.array_contains(contexts, F.lower(m["name"])), one).otherwise(F.expr(_NONE))

    zipped = let(F.regexp_extract_all(text, F.lit(NAMED), F.lit(0)), lambda names: F.arrays_zip(F.slice(F.split(text, NAMED, -1), 1, F.size(names)).alias("gap"), names.alias("name"), F.regexp_extract_all(text, F.lit(VALUED), F.lit(1)).alias("value")))
    return let(zipped, lambda both: _fold(both, F.lit(0), step, _NONE))


def _marked(docs: DataFrame, contexts: Column) -> DataFrame:
    """docs (with text) and _plain, spans (kind, start, end) of the fixed patterns; _added, those beside the patterns in contexts that no base span holds."""
    text = F.coalesce("text", F.lit(""))
    based = _with_base(docs)
    beside = F.filter("_tokens", lambda t: t["before"].rlike(FIELD) & ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])) & F.array_contains(contexts, _context(t["before"])))
    values = F.filter(_value_spans(text, contexts), lambda v: ~F.exists("_base", lambda b: (b["start"] <= v["start"]) & (v["end"] <= b["end"])))
    there = let(F.lower(text), lambda low: F.exists(contexts, lambda c: F.contains(low, c)))
    every = F.concat(beside, F.when(there, values).otherwise(F.expr(_NONE)))
    # of spans within others, the whole ones stay: the longest of those that begin first come first
    ordered = F.array_distinct(F.transform(F.sort_array(F.transform(every, lambda s: F.struct(s["start"], (-s["end"]).alias("back")))), lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), F.lit("").alias("value"), F.lit("").alias("before"))))
    whole = let(ordered, lambda spans: _fold(spans, F.lit(0), lambda reach, s: (F.greatest(reach, s["end"]), F.when(s["end"] > reach, F.array(s)).otherwise(F.expr(_NONE))), _NONE))
    plain = F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    added = F.transform(F.when(F.size(contexts) > 0, whole).otherwise(F.expr(_NONE)), lambda s: F.struct(F.lit("secret").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return based.withColumns({"_plain": plain, "_added": added})


def _all_spans(own: DataFrame, limits: Limits) -> DataFrame:
    """own (doc_id, text and any _own columns) with _plain and _added."""
    patterns = patterns_of(own, limits).select("context")
    few = patterns.limit(limits.inline + 1).collect()  # at most inline + 1 rows
    if len(few) <= limits.inline:
        listed = F.array(*[F.lit(r.context) for r in sorted(few)]) if few else F.expr("cast(array() as array<string>)")
        return _marked(own, listed)
    keyed = own.withColumn("_th", F.xxhash64(F.coalesce("text", F.lit(""))))
    text = F.coalesce("text", F.lit(""))
    names = F.concat(_field_names(text), F.transform(F.filter("_tokens", lambda t: t["before"].rlike(FIELD)), lambda t: _context(t["before"])))
    each = _with_base(keyed.select("doc_id", "_th", "text")).select("doc_id", "_th", F.explode(F.array_distinct(names)).alias("context"))
    heard = each.join(patterns, "context", "left_semi").groupBy(F.col("doc_id").alias("_id"), F.col("_th").alias("_h")).agg(F.collect_set("context").alias("_contexts"))
    both = keyed.join(heard, keyed["doc_id"].eqNullSafe(F.col("_id")) & (keyed["_th"] == F.col("_h")), "left")
    return _marked(both.withColumn("_contexts", F.coalesce("_contexts", F.expr("cast(array() as array<string>)"))), F.col("_contexts"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """doc_id, counts by kind, base_sha256, spans (with those the method adds, of kind secret), n_secret, n_spans: for each row."""
    count = lambda k: F.size(F.filter("_plain", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    found = _all_spans(docs.select("doc_id", "text"), limits)
    every = F.concat("_plain", "_added")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("_plain")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size("_added").cast("long").alias("n_secret"), F.size(every).cast("long").alias("n_spans"))


def redact(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """docs with each span (overlapping ones as one) replaced by its kind in brackets, [email] for instance; n_chars follows."""
    masked = hidden(docs, "doc_id", "text", "n_chars")
    found = _all_spans(masked, limits)
    text = F.coalesce("text", F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    ordered = F.transform(F.sort_array(F.transform(F.concat("_plain", "_added"), lambda s: F.struct(s["start"], s["end"], s["kind"]))), lambda s: s)
    new = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.size(F.concat("_plain", "_added")) > 0, new).otherwise(F.col("text"))
    out = found.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*masked.columns).toDF(*docs.columns)
