"""The results of the registered queries as DuckDB SQL.

``with_(name)`` gives the chain of common table expressions up to ``name``.
"""

from __future__ import annotations

from verbatrix.functions import text as T

WS = "[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
BULLET = "^\\s*(?:[-*+]\\s+|\\d+[.]\\s+)"
HEAD = "^(#{1,6})\\s+(.+?)\\s*$"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_VERBS, _TOOLS = "|".join(T.VERBS), "|".join((*T.TOOLS, T.OWN_TOOL))
_NAME = "[A-Za-z_][A-Za-z0-9_]*"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def js_length(x: str) -> str:
    return f"(length({x}) + len(regexp_extract_all({x}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"


def truncate(x: str, n: int) -> str:
    return f"(CASE WHEN {js_length(x)} > {n} THEN substr({x}, 1, {n - 3}) || '...' ELSE {x} END)"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"


def first_distinct(x: str) -> str:
    """Distinct elements in order of their first place."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def anchor(x: str) -> str:
    kept = f"regexp_replace(lower({trim(x)}), '[^a-z0-9\\s-]', '', 'g')"
    return f"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({kept}, '\\s+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section')"


def fixed(x: str, digits: int = 4) -> str:
    """Rounding by the exact binary value. ``x`` should be a column."""
    s = f"1e{digits}"
    a = f"abs({x})"
    hi = f"({a} * 134217729e0 - ({a} * 134217729e0 - {a}))"
    p = f"({a} * {s})"
    err = f"(({hi} * {s} - {p}) + ({a} - {hi}) * {s})"
    frac = f"({p} - floor({p}))"
    return f"(sign({x}) * (floor({p}) + CASE WHEN {frac} > 5e-1 OR ({frac} = 5e-1 AND {err} >= 0) THEN 1e0 ELSE 0e0 END) / {s} + 0e0)"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END)"


#: Every fifth file shares its document id with the one before; what follows the text varies by number.
FILES = """SELECT regexp_replace(path, '(/index)?[.]md$', '') AS doc_id, path, content FROM (SELECT
  CASE WHEN doc_id % 5 = 3 THEN 'd' || lpad(CAST(doc_id - 1 AS VARCHAR), 8, '0') || '/index.md' ELSE 'd' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md' END AS path,
  '# ' || source || chr(10) || chr(10) || text || chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10) || '- Run the job' || chr(10) || chr(10) || '```bash' || chr(10) || 'curl https://api.example.com/' || lang || chr(10) || '```' || chr(10) || chr(10) || 'See [next](#' || source || ') and `npm run x --flag` to call api.run(job).' ||
  CASE doc_id % 4 WHEN 1 THEN chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10) || 'You must read ' || source || ' again. It is `git log --stat` that shows it.'
    WHEN 2 THEN chr(10) || chr(10) || '### Overview of ' || source || chr(10) || chr(10) || 'A block means its lines.' || chr(10) || chr(10) || '```' || chr(10) || 'make ' || lang || ' --all' || chr(10) || '```' || chr(10) || '* Build x' || (doc_id % 7) || '.y(z)' || chr(10) || '```' || chr(10) || 'left open'
    WHEN 3 THEN chr(10) || chr(10) || '[' || lang || '](#' || lang || '), [up](d' || lpad(CAST(doc_id // 2 AS VARCHAR), 8, '0') || '.md#' || source || ') and [out](https://example.com/x#y)'
    ELSE '' END AS content
FROM documents)"""

QUERIES = """SELECT 'q1' AS query_id, 'how to run the job' AS query UNION ALL SELECT 'q2', 'What is the difference between en and fr?' UNION ALL SELECT 'q3', 'npm run --flag'
UNION ALL SELECT 'q4', 'how to use it' UNION ALL SELECT 'q5', 'configure api example'"""

_key = f"coalesce(CASE WHEN known THEN NOT (own AND NOT has_space AND NOT flagged AND NOT operator) ELSE flagged AND has_space END, FALSE)"

CTES: dict[str, str] = {
    "files": FILES,
    "raw": "SELECT path, doc_id, unnest(parts) AS text, unnest(range(1, len(parts) + 1)) AS line FROM (SELECT path, doc_id, regexp_split_to_array(content, '\\r?\\n') AS parts FROM files WHERE content IS NOT NULL)",
    "marked": f"SELECT *, regexp_matches(text, '{HEAD}') AS is_mark FROM raw",
    "headed": "SELECT *, is_mark OR (line = 1 AND NOT bool_or(is_mark) OVER (PARTITION BY path)) AS is_head FROM marked",
    "ords": "SELECT *, CAST(sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS INT) AS ord FROM headed",
    "heads": f"SELECT path, doc_id, ord, line AS line_start, CASE WHEN is_mark THEN regexp_extract(text, '{HEAD}', 2) ELSE 'Document' END AS heading FROM ords WHERE is_head",
    "based": f"SELECT *, {anchor('heading')} AS base FROM heads",
    "repeats": "SELECT *, row_number() OVER (PARTITION BY path, base ORDER BY line_start) - 1 AS n FROM based",
    "anchored": "SELECT *, CASE WHEN n = 0 THEN base ELSE base || '-' || n END AS anchor FROM repeats",
    "body": "SELECT o.path, o.doc_id, o.ord, a.anchor, a.heading, a.line_start, max(o.line) OVER (PARTITION BY o.path, o.ord) AS line_end, o.line, o.text FROM ords o JOIN anchored a ON o.path = a.path AND o.ord = a.ord",
    "fenced": f"SELECT *, starts_with({trim('text')}, '```') AS is_fence FROM body WHERE line <> line_start",
    "counted": "SELECT *, CAST(sum(is_fence::INT) OVER (PARTITION BY path, ord ORDER BY line) AS INT) AS fences, CAST(sum(is_fence::INT) OVER (PARTITION BY path, ord) AS INT) AS all_fences FROM fenced",
    "code": f"""SELECT * FROM (SELECT path, doc_id, ord, anchor, heading, (fences + 1) // 2 AS block, min(line) AS line_start, max(line) AS line_end, {trim("string_agg(text, chr(10) ORDER BY line) FILTER (WHERE NOT is_fence)")} AS text
        FROM counted WHERE (fences % 2 = 1 OR is_fence) AND all_fences >= 2 * ((fences + 1) // 2) GROUP BY ALL) WHERE text <> ''""",
    "prose": f"SELECT *, NOT is_fence AND fences % 2 = 0 AND {trim('text')} <> '' AS is_prose FROM counted",
    "bulleted": f"SELECT *, is_prose AND regexp_matches(text, '{BULLET}') AS is_bullet FROM prose",
    "started": "SELECT *, is_prose AND (is_bullet OR NOT coalesce(lag(is_prose AND NOT is_bullet) OVER (PARTITION BY path, ord ORDER BY line), FALSE)) AS starts FROM bulleted",
    "islands": "SELECT *, sum(starts::INT) OVER (PARTITION BY path, ord ORDER BY line) AS block FROM started",
    "prose_blocks": f"""SELECT * FROM (SELECT path, doc_id, ord, anchor, heading, block, min(line) AS line_start, max(line) AS line_end, bool_or(is_bullet) AS is_step,
        {trim("string_agg(" + trim(f"regexp_replace({trim('text')}, '{BULLET}', '')") + ", ' ' ORDER BY line)")} AS text FROM islands WHERE is_prose GROUP BY path, doc_id, ord, anchor, heading, block) WHERE text <> ''""",
    "sentences": "SELECT * EXCLUDE (text), list_filter(string_split(regexp_replace(" + squeeze("regexp_replace(regexp_replace(text, '[`*_>#]', ' ', 'g'), '\\[[^\\]]+\\]\\(([^)]+)\\)', '\\1', 'g')") + f", '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS parts FROM prose_blocks",
    "pairs_of_sentences": "SELECT path, doc_id, ord, anchor, heading, line_start, line_end, is_step, n_at, array_to_string(parts[2 * n_at + 1 : 2 * n_at + 2], ' ') AS whole FROM (SELECT *, unnest(range(0, (len(parts) + 1) // 2)) AS n_at FROM sentences)",
    "windows": f"SELECT * EXCLUDE (whole), {truncate('whole', 440)} AS text FROM pairs_of_sentences",
    "spans": f"SELECT path, doc_id, ord, anchor, heading, line, unnest(range(0, len(found))) AS n_at, {trim('unnest(found)')} AS text FROM (SELECT *, regexp_extract_all(text, '`([^`]+)`', 1) AS found FROM fenced)",
    "looked": f"""SELECT *, regexp_matches(text, '{WS}') AS has_space, regexp_replace(regexp_split_to_array(text, '{WS}+')[1], '^[''"]|[''"]$', '', 'g') AS first, regexp_matches(text, '[|][|]|&&|[|]|>|<|[$][(]|;') AS operator,
        regexp_matches(text, '(^|{WS})--[a-z0-9-]+') AS flagged, regexp_matches(text, '{T.FILE_NAME}') OR (regexp_matches(text, '{T.PATH_ONLY}') AND NOT regexp_matches(text, '{WS}')) AS file_like FROM spans""",
    "inline": f"""SELECT path, doc_id, ord, anchor, heading, line, n_at, {truncate('text', 440)} AS text FROM (SELECT *, regexp_matches(first, '(?i)^({_TOOLS}|[.]?/)') AS known, lower(first) = '{T.OWN_TOOL}' AS own FROM looked)
        WHERE text <> '' AND NOT (file_like AND NOT flagged AND NOT known) AND {_key}""",
    "every_unit": f"""SELECT path, doc_id, ord, anchor, heading, line_start, line_end, 'command' AS type, {truncate('text', 440)} AS text, 0 AS kind, 0 AS n_at FROM code
        UNION ALL SELECT path, doc_id, ord, anchor, heading, line_start, line_end, CASE WHEN is_step OR regexp_matches(text, '(?i)^({_VERBS})\\b') THEN 'step'
            WHEN regexp_matches(text, '(?i)\\b(must|never|cannot|can''t|ensure|required|should not|do not|don''t)\\b') THEN 'constraint'
            WHEN regexp_matches(heading, '(?i)\\b(concept|overview|definition)\\b') OR regexp_matches(text, '(?i)\\b(means|is|refers to|defined as)\\b') THEN 'definition' ELSE 'fact' END, text, 1, n_at FROM windows
        UNION ALL SELECT path, doc_id, ord, anchor, heading, line, line, 'command', text, 2, n_at FROM inline""",
    "first_units": "SELECT * FROM (SELECT *, sha256(lower(text)) AS text_hash, row_number() OVER (PARTITION BY doc_id, anchor, line_start, line_end, sha256(lower(text)), type ORDER BY path, ord, kind, n_at, text) AS copy FROM every_unit) WHERE copy = 1",
    "units": f"""SELECT 'unit_' || substr(sha256(concat_ws('|', doc_id, anchor, line_start, type, text)), 1, 12) AS unit_id, doc_id, anchor, line_start, line_end, type, text, {tokens('text')} AS keywords,
        CAST(greatest(1, ceil({js_length('text')} / 4.0)) AS INT) AS token_estimate, text_hash, 'corpus@1.0.0:' || doc_id || '#' || anchor || ':' || line_start || '-' || line_end AS citation_id, heading, doc_id || '#' || anchor AS ref FROM first_units""",
    "block_lists": "SELECT path, ord, list(text ORDER BY block) AS code_blocks FROM code GROUP BY path, ord",
    "bodies": "SELECT path, doc_id, ord, anchor, heading, line_start, line_end, coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (WHERE line <> line_start), '') AS body FROM body GROUP BY path, doc_id, ord, anchor, heading, line_start, line_end",
    "texts": "SELECT *, " + squeeze("regexp_replace(regexp_replace(body, '(?s)```.*?```', ' ', 'g'), '(?m)^#{1,6}\\s+', '', 'g')") + " AS text FROM bodies",
    "sections": f"""SELECT 'sec_' || substr(sha256(concat_ws('|', doc_id, anchor, heading, line_start)), 1, 12) AS section_id, path, doc_id, ord, anchor, heading, line_start, line_end, text,
        {truncate("(CASE WHEN text <> '' THEN text ELSE heading END)", 220)} AS snippet, coalesce(code_blocks, []) AS code_blocks, path AS source_path, body, doc_id || '#' || anchor AS ref FROM texts LEFT JOIN block_lists USING (path, ord)""",
    "token_df": "SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(keywords)) AS token FROM units) GROUP BY token",
    "queries": QUERIES,
    "profiled": f"""SELECT query_id, query, {first_distinct(tokens('query'))} AS tokens, list_distinct(regexp_extract_all(lower(query), '--[a-z0-9-]+')) AS flags,
        CASE WHEN (contains(query, '?') AND NOT regexp_matches(query, '(?i)\\bhow to\\b')) OR regexp_matches(query, '(?i)\\b(compare|difference|explain|meaning|purpose|what|why)\\b') THEN 'explain' ELSE 'action' END AS intent,
        regexp_matches(query, '(?i)\\b({_VERBS})\\b') AS acts, regexp_matches(query, '[A-Za-z_]') AS has_letter FROM queries""",
    "terms": "SELECT query_id, t.n_at, t.token, ln(1 + n_units / (coalesce(df, 0) + 1)) AS w FROM (SELECT query_id, unnest(range(1, len(tokens) + 1)) AS n_at, unnest(tokens) AS token FROM profiled) t LEFT JOIN token_df USING (token), (SELECT greatest(1, count(*)) AS n_units FROM units)",
    "weights": "SELECT query_id, list(w ORDER BY n_at) AS ws FROM terms GROUP BY query_id",
    "asked": "SELECT p.*, coalesce(ws, []) AS ws FROM profiled p LEFT JOIN weights USING (query_id)",
    "seen": f"""SELECT unit_id, doc_id, anchor, ref, line_start, line_end, type, text, text_hash, citation_id, token_estimate, list_distinct(keywords) AS words, list_distinct({tokens('heading')}) AS heading_words,
        regexp_matches(text, '{_NAME}([.:]{_NAME})+|{_NAME}[(][^)]*[)]') AS has_symbol, NOT contains(text, chr(10)) AND {trim('text')} <> '' AND (regexp_matches({trim('text')}, '{T.FILE_NAME}') OR regexp_matches({trim('text')}, '{T.PATH_ONLY}')) AS low_signal,
        least(1e0, greatest(0e0, token_estimate::DOUBLE / 120)) AS cost FROM units""",
    "pairs": """SELECT u.*, q.*, list_sum(list_transform(tokens, lambda t, i: CASE WHEN list_contains(words, t) THEN ws[i] ELSE 0e0 END)) AS hit, list_sum(list_transform(tokens, lambda t, i: CASE WHEN list_contains(heading_words, t) THEN ws[i] ELSE 0e0 END)) AS heading_hit, list_sum(ws) AS total,
        len(list_filter(flags, lambda f: contains(lower(text), f))) > 0 AS flagged FROM seen u, asked q""",
    "parts": """SELECT *, (CASE WHEN len(tokens) = 0 OR len(words) = 0 THEN 0e0 ELSE hit / total END) * CASE WHEN intent = 'explain' AND type = 'command' AND low_signal AND NOT flagged THEN 7e-1 ELSE 1e0 END AS lexical,
        (CASE WHEN len(tokens) = 0 OR len(heading_words) = 0 THEN 0e0 ELSE heading_hit / total END) * CASE WHEN intent = 'explain' AND type = 'command' AND low_signal AND NOT flagged THEN 8e-1 ELSE 1e0 END AS heading_boost,
        CASE WHEN flagged OR (intent = 'action' AND has_symbol AND has_letter) THEN 1e0 ELSE 0e0 END AS symbol_boost,
        CASE WHEN intent = 'action' THEN CASE WHEN type IN ('command', 'step') AND acts THEN 1e0 ELSE 0e0 END WHEN type IN ('definition', 'constraint') THEN 5e-1 ELSE 0e0 END AS command_boost FROM pairs""",
    "raw_scores": "SELECT *, 55e-2 * lexical + 15e-2 * heading_boost + 1e-1 * symbol_boost + 1e-1 * command_boost - 25e-2 * cost AS raw_score FROM parts",
    "scores": f"SELECT *, {fixed('raw_score')} AS base_score FROM raw_scores",
    "ranks": "SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY base_score DESC, doc_id, anchor, line_start, unit_id, text_hash, line_end) AS INT) AS rank FROM scores",
    "reasons": f"""SELECT *, {first_distinct("list_concat(list_transform(list_filter(tokens, lambda t: list_contains(words, t)), lambda t: 'token:' || t), list_transform(list_filter(tokens, lambda t: list_contains(heading_words, t)), lambda t: 'heading:' || t), list_transform(list_filter(flags, lambda f: contains(lower(text), f)), lambda f: 'flag:' || f), CASE WHEN type = 'command' THEN ['command:type'] ELSE [] END, CASE WHEN has_symbol THEN ['symbol:text'] ELSE [] END)")}[1:8] AS why FROM ranks WHERE rank <= 100""",
}


def with_(name: str, replaced: dict[str, str] | None = None) -> str:
    """WITH clause of all expressions up to ``name``."""
    chain = CTES | (replaced or {})
    names = list(chain)
    names = names[: names.index(name) + 1]
    needed, todo = set(), [name]
    while todo:
        n = todo.pop()
        if n not in needed:
            needed.add(n)
            todo += [m for m in names if m != n and __import__("re").search(rf"\b{m}\b", chain[n])]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({chain[n]})" for n in names if n in needed) + "\n"


def greedy(candidates: str) -> str:
    """Rest of a statement that packs ``candidates`` (query_id, rank, text_hash,
    words, token_estimate), ranked without gaps, by recursion; table ``steps``
    has one row for each candidate with ``taken`` and its novelty."""
    near = f"coalesce(list_max(list_transform(s.chosen, lambda w: {jaccard('w', 'c.words')})), 0e0)"
    return f""", cand AS ({candidates}), steps AS (
    SELECT query_id, 0 AS rank, FALSE AS taken, 0e0 AS nearest, CAST([] AS VARCHAR[][]) AS chosen, CAST([] AS VARCHAR[]) AS hashes, 0 AS spent FROM (SELECT DISTINCT query_id FROM cand)
    UNION ALL
    SELECT query_id, rank, taken, nearest, CASE WHEN taken THEN list_append(chosen, words) ELSE chosen END, CASE WHEN taken THEN list_append(hashes, text_hash) ELSE hashes END, CASE WHEN taken THEN spent + est ELSE spent END
    FROM (SELECT s.query_id, c.rank, {near} AS nearest, s.chosen, s.hashes, s.spent, c.words, c.text_hash, c.token_estimate AS est,
        len(s.chosen) < 5 AND NOT list_contains(s.hashes, c.text_hash) AND s.spent + c.token_estimate <= 600 AND {near} <= 85e-2 AS taken
        FROM steps s JOIN cand c ON c.query_id = s.query_id AND c.rank = s.rank + 1)
), alike AS (SELECT query_id, rank, 1 - nearest AS raw_novelty, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM steps WHERE taken),
fresh AS (SELECT *, {fixed('raw_novelty')} AS novelty FROM alike), total AS (SELECT query_id, max(spent) AS spent_tokens FROM steps GROUP BY query_id)
"""
