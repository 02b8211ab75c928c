"""DuckDB's SQL for the operators that it can express: what their queries must return, worked out without their methods.

Cosines of all pairs (1), formatted turns by their definition (3), the whole verdict from the texts (5) and all
windows of 50 bytes side by side (8). They are quadratic or hold every window, so they are meant for small tables.
"""

from __future__ import annotations

from weftline.llm.chat_format import OTHER, START, Template
from weftline.llm.quality_rules import CLASSES, SYMBOLS, Limits


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def embedding_links(threshold: float = 0.95) -> str:
    return f"""
WITH RECURSIVE numbered AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
usable AS MATERIALIZED (SELECT r, e FROM numbered WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.r <> b.r WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= {threshold} END),
reached AS (SELECT r AS a, r AS b FROM numbered UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b),
least AS (SELECT a, min(vec_id) AS component_id FROM reached JOIN numbered ON r = b GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM numbered JOIN least ON least.a = r LEFT JOIN counted ON counted.a = r"""


def formatted_turns(extra: list[tuple[int, int, str, str]], template: Template = Template()) -> str:  # noqa: B008
    """extra: (conv_id, turn, role, text) beside the table's rows."""
    pattern = quoted("([" + "".join("\\" + c for c in template.openers + template.escape) + "])")
    again = quoted("\\1" + template.escape.replace("\\", "\\\\"))
    escaped = lambda x: f"regexp_replace({x}, {pattern}, {again}, 'g')"
    marks = "".join(f" WHEN {quoted(role)} THEN {len(before) + len(after)}" for role, (before, after) in template.marks.items() if role != OTHER)
    other = "".join(template.marks[OTHER]).replace("{role}", "")
    allowed = " OR ".join(f"(before = {quoted(a)} AND role = {quoted(b)})" for a, follow in template.follows.items() if a != START for b in sorted(follow))
    first = ", ".join(map(quoted, sorted(template.follows[START])))
    some = lambda roles: ", ".join(map(quoted, sorted(roles)))
    rows = ", ".join(f"({c}, {t}, {quoted(role)}, {quoted(text)})" for c, t, role, text in extra)
    return f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES {rows})),
numbered AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS ends FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
turns AS (SELECT *, CASE role{marks} ELSE {len(other)} + length({escaped("role")}) END + length({escaped("text")}) AS chars, role IN ({some(template.loss)}) AS loss,
    CASE WHEN before IS NULL THEN role IN ({first}) ELSE {allowed} END AND (NOT ends OR role IN ({some(template.ends)})) AS fits FROM numbered)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (loss), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (loss), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars, bool_and(fits) AS valid
FROM turns GROUP BY conv_id"""


def quality(limits: Limits = Limits()) -> str:  # noqa: B008
    """Distances rounded to nine places."""
    space, other = r"\x20\x09-\x0D", r"[^\x20\x09-\x0D]"
    count = lambda pattern: f"len(regexp_extract_all(t, {quoted(pattern)}))"
    classes = [count(c.removesuffix("+")) for c in CLASSES]
    width = len(CLASSES) + 1
    common = ", ".join(f"({quoted(lang)}, {k}, {quoted(w)})" for lang, listed in limits.common.items() for k, w in enumerate(listed))
    known = ", ".join(map(quoted, limits.common))

    def distance(name: str, pairs: str) -> str:
        """pairs: a table of r, k, p, q (counts)."""
        part = lambda u: f"CASE WHEN {u} > 0 THEN {u} * log2(2 * {u} / (u + v)) ELSE 0 END"
        shares = f"SELECT r, p / nullif(sum(p) OVER (PARTITION BY r), 0) AS u, q / nullif(sum(q) OVER (PARTITION BY r), 0) AS v FROM {pairs}"
        return f"{name} AS (SELECT r, CASE WHEN count(u) > 0 AND count(v) > 0 THEN sqrt(greatest(0, sum({part('u')} + {part('v')}) / 2)) END AS d FROM ({shares}) GROUP BY r)"

    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({known}) THEN lang ELSE '' END AS key FROM documents),
words AS (SELECT r, key, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT r, key, regexp_extract_all(t, '[^{space}]+') AS w FROM docs)),
windows AS (SELECT r, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS again FROM windows WHERE w3 IS NOT NULL),
inside AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + unnest([0, 1, 2]) AS place FROM twice WHERE again) GROUP BY r),
totals AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY r),
lines AS (SELECT r, len(l) - len(list_distinct(l)) AS n_dup_lines FROM (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {quoted(other)})) AS l FROM docs)),
base AS (SELECT docs.r, doc_id, key, t, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, {count(SYMBOLS)}::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, coalesce(inside.n, 0)::BIGINT AS n_repeat_words
    FROM docs JOIN lines USING (r) LEFT JOIN totals USING (r) LEFT JOIN inside USING (r)),
classes AS (SELECT r, key, n_words, [{", ".join(classes)}, length(t) - {" - ".join(classes)}]::DOUBLE[] AS c FROM base),
chars AS (SELECT r, key, n_words, unnest(c) AS p, unnest(range({width})) AS k FROM classes),
char_sums AS (SELECT key, k, sum(p) AS q FROM chars WHERE n_words >= {limits.min_words} AND key <> '' GROUP BY ALL UNION ALL SELECT '', k, sum(p) FROM chars WHERE n_words >= {limits.min_words} GROUP BY k),
char_pairs AS (SELECT r, k, p, coalesce(q, 0) AS q FROM chars LEFT JOIN char_sums USING (key, k)),
{distance("char_distances", "char_pairs")},
listed(key, k, word) AS (VALUES {common}),
spoken AS (SELECT r, k, count(*) AS n FROM words JOIN listed ON listed.key = words.key AND listed.word = lower(rtrim(w, '.,')) GROUP BY r, k),
counts AS (SELECT r, base.key, n_words, k, coalesce(n, 0)::DOUBLE AS p FROM base JOIN listed USING (key) LEFT JOIN spoken USING (r, k)),
with_rest AS (SELECT r, key, n_words, k, p FROM counts UNION ALL SELECT r, key, n_words, -1, greatest(0, n_words - sum(p))::DOUBLE FROM counts GROUP BY r, key, n_words),
word_sums AS (SELECT key, k, sum(p) AS q FROM with_rest WHERE n_words >= {limits.min_words} GROUP BY key, k),
word_pairs AS (SELECT r, k, p, coalesce(q, 0) AS q FROM with_rest LEFT JOIN word_sums USING (key, k)),
{distance("word_distances", "word_pairs")},
failed AS (SELECT base.*, c.d AS char_distance, w.d AS word_distance, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_repeat_percent} * n_words AS base_failed
    FROM base LEFT JOIN char_distances c USING (r) LEFT JOIN word_distances w USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR (word_chars >= {limits.min_chars} AND coalesce(char_distance, 0) > {limits.max_char_distance})
        OR (n_words >= {limits.min_common_words} AND coalesce(word_distance, 0) > {limits.max_word_distance} + {limits.word_slack} / sqrt(n_words))) AS kept,
    round(char_distance, 9) AS char_distance, round(word_distance, 9) AS word_distance
FROM failed"""


def repeated_bytes(window: int = 50, block: int = 512) -> str:
    """block: bytes that are cut from a text at a time, so that finding a window needn't count from the text's start."""
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
blocks AS (SELECT r, doc_id, b, substr(h, 2 * b + 1, {2 * (block + window - 1)}) AS h FROM (SELECT r, doc_id, h, unnest(range(0, strlen(h) // 2, {block})) AS b FROM docs)),
windows AS (SELECT r, doc_id, b + i AS i, substr(h, 2 * i + 1, {2 * window}) AS s FROM (SELECT r, doc_id, b, h, unnest(range(0, least({block}, strlen(h) // 2 - {window - 1}))) AS i FROM blocks)),
least AS (SELECT s, min(doc_id) AS doc_id FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
starts AS (SELECT r, i FROM windows JOIN least USING (s) WHERE least.doc_id < windows.doc_id),
marked AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > {window}, true) AS new FROM starts),
numbered AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS g FROM marked),
spans AS (SELECT r, min(i) AS a, max(i) + {window} AS e FROM numbered GROUP BY r, g),
borders AS (SELECT r, a, e FROM spans UNION ALL SELECT r, strlen(h) // 2, strlen(h) // 2 FROM docs),
gaps AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a, e), 0) AS b FROM borders),
kept AS (SELECT r, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a, e) AS h, sum(e - a) AS n_removed, count(*) - 1 AS n_spans FROM gaps JOIN docs USING (r) GROUP BY r)
SELECT doc_id, (strlen(docs.h) // 2)::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM docs JOIN kept USING (r)"""
