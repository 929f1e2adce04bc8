"""SQL for DuckDB that gives the rows of the named queries.  Written from the rules, not from the plans."""

from __future__ import annotations

from folio.functions import text as T
from folio.operators import layout as L

ORACLES: dict[str, str] = {}

NL = "chr(10)"
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
QUESTIONS = "q(query_id, query, conv_id) AS (SELECT 'q' || conv_id, min(text), conv_id FROM conversations WHERE conv_id % 50 = 0 AND turn = 0 GROUP BY conv_id)"


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def clean(t: str) -> str:
    lines = rf"regexp_replace(coalesce({t}, ''), '\r\n?', {NL}, 'g')"
    return strip(rf"regexp_replace(regexp_replace({lines}, '[ \t]+', ' ', 'g'), '\n{{3,}}', {NL} || {NL}, 'g')")


def tokens(t: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({t}, ''), '{T.TOKEN}'), lambda z: lower(z))"


def count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


HANGUL, HAN = r"[\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}]", r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
VISIBLE = r"[^\s\x{00A0}\x{2000}-\x{200A}\x{3000}]"
ALLOWED = T.ALLOWED.replace(T.HANGUL, HANGUL[1:-1]).replace(T.KANA_HAN, HAN[1:-1]).replace("'", "''")


def scripts(t: str) -> tuple[str, str, str, str]:
    h, a, k = count(t, HANGUL), count(t, "[A-Za-z0-9]"), count(t, HAN)
    return h, a, k, f"({count(t, VISIBLE)} - {h} - {a} - {k})"


LINES = f"""
lines AS (SELECT doc_id, unnest(string_split(text, {NL})) AS content, generate_subscripts(string_split(text, {NL}), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
blocks AS (SELECT doc_id, pos // 10 + 1 AS page, pos % 10 + 1 AS block_index, content,
  CASE WHEN pos = 0 THEN 'doc_title' WHEN (doc_id + pos) % 11 = 0 THEN 'image' WHEN (doc_id + pos) % 13 = 0 THEN 'table' WHEN pos % 10 = 9 THEN 'vision_footnote' WHEN length(content) <= 40 THEN 'paragraph_title' ELSE 'text' END AS raw_label,
  CASE WHEN doc_id % 3 = 0 AND pos % 2 = 1 THEN 520 ELSE 60 END AS x1, 40 + (pos % 10) * 130 AS y1,
  CASE WHEN doc_id % 3 = 0 AND pos % 2 = 1 THEN 520 ELSE 60 END + CASE WHEN doc_id % 3 = 0 THEN 420 ELSE 880 END AS x2,
  40 + (pos % 10) * 130 + least(110, 20 + length(content) // 8) AS y2, 1000 AS width, 1400 AS height FROM lines)"""

RECORDS = rf"""{LINES},
annotated AS (SELECT *, doc_id % 2 = 0 AND (doc_id + page) % 10 <> 0 AS sem, doc_id + page + block_index AS k FROM blocks),
records AS (SELECT CASE WHEN sem THEN 'semantic:' ELSE 'fallback:' END || doc_id || ':' || page || ':' || block_index AS record_id, doc_id, page - 1 AS page, 'block-' || block_index AS block_id, content AS text, CASE WHEN sem THEN 'semantic' ELSE 'fallback' END AS source_kind,
  CASE WHEN sem AND k % 3 = 0 THEN 'body' WHEN sem AND k % 3 = 1 THEN 'evidence' ELSE 'unknown' END AS generic_role, CASE WHEN sem AND k % 5 = 0 THEN 'key_data_box' ELSE 'unknown' END AS domain_role, 'unknown' AS generated_role_name, CASE WHEN sem AND k % 3 = 0 THEN 'thesis' ELSE 'unknown' END AS section_purpose,
  CASE WHEN sem THEN k % 11 / 10 ELSE 0.0 END AS role_confidence, sem AND k % 4 = 0 AS needs_review
  FROM annotated WHERE length({strip('content')}) > 0 AND NOT regexp_matches(content, '^\s*!\[[^\]]*\]\([^)]+\)\s*$'))"""

_s = scripts("text")
CANONICAL = f"""{LINES},
base AS (SELECT *, {clean('content')} AS text, CASE raw_label WHEN 'doc_title' THEN 'document_title' WHEN 'paragraph_title' THEN 'section_heading_or_panel_title' WHEN 'text' THEN 'paragraph_or_meta' WHEN 'vision_footnote' THEN 'footnote' ELSE raw_label END AS label,
  round(least(1.0, greatest(0.0, x1 / width)), 6) AS n1, round(least(1.0, greatest(0.0, y1 / height)), 6) AS n2, round(least(1.0, greatest(0.0, x2 / width)), 6) AS n3, round(least(1.0, greatest(0.0, y2 / height)), 6) AS n4,
  'paddle-' || doc_id || '-' || CASE WHEN page <= 10 THEN '0' ELSE '' END || (page - 1) || '-' || (block_index - 1) AS block_id,
  row_number() OVER (PARTITION BY doc_id, page ORDER BY block_index, y1, x1) - 1 AS reading_order FROM blocks),
counts AS (SELECT *, {_s[0]} AS hangul, {_s[1]} AS latin, {_s[2]} AS han, {_s[3]} AS other, {count('text', VISIBLE)} AS visible, {count('text', ALLOWED)} AS allowed, regexp_extract_all(text, '{VISIBLE}+') AS ws,
  coalesce(list_reduce(list_transform(string_split(text, ''), lambda c: {{'c': c, 'n': 1, 'm': 1}}), lambda a, b: {{'c': b.c, 'n': CASE WHEN a.c = b.c AND regexp_matches(b.c, '\\S') THEN a.n + 1 ELSE 1 END, 'm': greatest(a.m, CASE WHEN a.c = b.c AND regexp_matches(b.c, '\\S') THEN a.n + 1 ELSE 1 END)}}).m, 1) AS run FROM base),
parts AS (SELECT *, CASE WHEN visible > 0 THEN 1 - allowed / visible ELSE 1.0 END AS weird, CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: length(w) >= 24)) / len(ws) ELSE 1.0 END AS long_tokens,
  CASE WHEN length(text) = 0 THEN 1.0 ELSE least(1.0, greatest(run / 12.0, coalesce(list_sum(list_transform(map_values(list_histogram), lambda n: CASE WHEN n >= 4 THEN n ELSE 0 END)), 0) / greatest(1, len(map_keys(list_histogram))))) END AS repeat
  FROM (SELECT *, coalesce(list_histogram(ws), MAP {{}}) AS list_histogram FROM counts)),
canonical AS (SELECT *, CASE WHEN length(text) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, round(1.0 - weird * 0.4
    - (CASE WHEN (hangul > 0)::INT + (latin > 0)::INT + (han > 0)::INT + (other > 0)::INT >= 4 THEN 1.0 WHEN (hangul > 0)::INT + (latin > 0)::INT + (han > 0)::INT + (other > 0)::INT = 3 AND other > 0 THEN 0.7 WHEN other > 0 THEN least(1.0, other / length(text)) ELSE 0.0 END)::DOUBLE * 0.3
    - greatest(repeat, long_tokens) * 0.2 - (CASE WHEN length(text) < 6 THEN 1.0 WHEN length(text) < 15 THEN 0.5 ELSE 0.0 END)::DOUBLE * 0.1 + 1e-9, 4))) END AS quality FROM parts)"""

TEXT_LIKE = "('document_title', 'section_heading', 'subheading', 'paragraph', 'paragraph_or_meta', 'section_heading_or_panel_title', 'caption_or_panel_title')"
META = "(label IN ('meta_candidate', 'footnote') OR raw_label IN ('header', 'foot', 'fnote', 'list', 'anno', 'vision_footnote'))"


def any_of(t: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({t}), '{w}')" for w in words) + ")"


FINANCIAL = rf"({any_of('text', T.FINANCIAL_KEYWORDS)} OR regexp_matches(text, '{T.TICKER}'))"
NOTICE = any_of("text", L.NOTICES)
PAGES = f"""{CANONICAL},
f AS (SELECT *, greatest(0, x2 - x1) * greatest(0, y2 - y1) / greatest(1, width * height) AS ratio, label IN {TEXT_LIKE} AS textual, label IN {TEXT_LIKE} AND length(text) >= 20 AS substantial, {META} AS meta FROM canonical),
g AS (SELECT *, CASE WHEN bool_or(substantial) OVER (PARTITION BY doc_id, page) THEN substantial ELSE textual END AS placed FROM f),
h AS (SELECT *, (placed AND x1 - lag(x1) OVER (PARTITION BY doc_id, page, placed ORDER BY x1) > 0.18 * width)::INT AS gap FROM g),
metrics AS (SELECT doc_id, page, max(width) AS width, max(height) AS height,
  coalesce(min(x1) FILTER (NOT meta), 0) AS content_x1, coalesce(min(y1) FILTER (NOT meta), 0) AS content_y1, coalesce(max(x2) FILTER (NOT meta), max(width)) AS content_x2, coalesce(max(y2) FILTER (NOT meta), max(height)) AS content_y2,
  round(coalesce(sum(ratio) FILTER (label IN ('table', 'chart')), 0), 4) AS table_ratio, round(coalesce(sum(ratio) FILTER (label IN ('image', 'chart')), 0), 4) AS visual_ratio, round(coalesce(sum(ratio) FILTER (substantial), 0), 4) AS text_ratio,
  round(coalesce(sum(ratio) FILTER (n3 <= 0.35), 0), 4) AS sidebar_ratio, round(coalesce(sum(ratio) FILTER (meta), 0), 4) AS meta_ratio, least(4, greatest(1, 1 + coalesce(sum(gap), 0))) AS columns,
  round(coalesce(median(quality) FILTER (substantial), 0.75) + 1e-9, 4) AS quality, count(*) FILTER (label = 'table') AS tables, count(*) FILTER (label = 'image') AS images, count(*) FILTER (textual) AS text_blocks, count(*) FILTER (substantial) AS substantial_blocks,
  count(*) FILTER (textual AND length(text) > 0) AS filled_text_blocks, count(*) FILTER ({FINANCIAL}) AS financial_signals, coalesce(bool_or({NOTICE}), false) AS has_notice, coalesce(bool_or(raw_label IN ('list', 'fnote', 'vision_footnote')), false) AS has_list,
  coalesce(bool_or(n3 <= 0.35 AND ratio >= 0.015 AND (textual OR label IN ('table', 'chart', 'image'))), false) AS left_panel, coalesce(bool_or(n1 >= 0.32 AND length(text) >= 40 AND substantial), false) AS main_body,
  coalesce(bool_or(length(text) > 0 AND n2 >= 0.6 AND (raw_label IN ('list', 'fnote', 'vision_footnote') OR {NOTICE})), false) AS bottom_notice FROM h GROUP BY doc_id, page),
pages AS (SELECT *, CASE WHEN bottom_notice AND (has_notice OR has_list) THEN 'compliance' WHEN financial_signals >= 2 AND left_panel AND main_body THEN 'cover_summary' WHEN tables >= 3 AND text_ratio < 0.12 AND NOT main_body THEN 'evidence_table'
  WHEN table_ratio >= 0.45 OR (tables >= 2 AND text_ratio < 0.08 AND visual_ratio < 0.1) THEN 'evidence_table' WHEN text_ratio >= 0.12 AND table_ratio < 0.35 THEN 'body_narrative' WHEN images >= 3 AND text_blocks >= 2 THEN 'body_narrative' ELSE 'unknown' END AS archetype,
  CASE WHEN columns >= 3 THEN 'multi_column' WHEN columns = 2 THEN 'two_column' WHEN visual_ratio >= 0.18 THEN 'visual_heavy' ELSE 'single_column' END AS pattern,
  concat_ws(',', CASE WHEN quality < 0.55 THEN 'low_ocr_quality' END, CASE WHEN substantial_blocks = 0 THEN 'sparse_text' END) AS warnings, visual_ratio >= 0.18 AS large_visual FROM metrics),
anchored AS (SELECT c.* FROM canonical c JOIN pages p USING (doc_id, page) WHERE p.archetype IN ('cover_summary', 'body_narrative'))"""
FAMILY = rf"""
firsts AS (SELECT doc_id, count(*) FILTER ({FINANCIAL}) AS hits, bool_or(regexp_matches(text, '{T.TICKER}')) AS ticker, bool_or(contains(text, '목표주가') OR contains(lower(text), 'buy')) AS advice FROM canonical WHERE page <= 2 GROUP BY doc_id),
families AS (SELECT p.doc_id, CASE WHEN any_value(hits) >= 2 OR (any_value(ticker) AND any_value(advice)) THEN 'financial_report' WHEN sum(tables) >= 1 AND sum(filled_text_blocks) <= 1 THEN 'form' WHEN bool_or(archetype IN ('cover_summary', 'body_narrative')) THEN 'article'
  WHEN sum(images) >= 3 AND sum(filled_text_blocks) >= 1 THEN 'article' ELSE 'report' END AS family FROM pages p LEFT JOIN firsts USING (doc_id) GROUP BY p.doc_id)"""
SECTIONS = f"""
narrative AS (SELECT *, lag(y2) OVER (PARTITION BY doc_id, page ORDER BY reading_order) AS upper_y FROM anchored WHERE length(text) > 0 AND label IN {TEXT_LIKE} AND raw_label NOT IN ('header', 'foot', 'fnote', 'anno', 'list')),
titled AS (SELECT *, coalesce(label IN ('document_title', 'section_heading', 'subheading') OR (length(text) <= 80 AND (upper_y IS NULL OR greatest(0, (y1 - upper_y) / height) >= 0.03)), false) AS titled FROM narrative),
numbered AS (SELECT *, sum((titled OR upper_y IS NULL)::INT) OVER (PARTITION BY doc_id ORDER BY page, reading_order) AS number FROM titled),
sections AS (SELECT doc_id, 'section-' || lpad(number::INT::VARCHAR, 3, '0') AS section_id, min(page) AS page, arg_min(substr(string_split(text, {NL})[1], 1, CASE WHEN titled THEN 160 ELSE 80 END), reading_order) AS title, string_agg(block_id, ',' ORDER BY reading_order) AS block_ids FROM numbered GROUP BY doc_id, number)"""

# --- search ---
ORACLES["tokenize_counts"] = f"SELECT doc_id, len({tokens('text')}) AS n_tokens, len(list_distinct({tokens('text')})) AS n_distinct FROM documents"


def bm25(where: str = "true", only: str = "true") -> str:
    return f"""{RECORDS}, {QUESTIONS},
rt AS (SELECT record_id, {tokens('text')} AS ts FROM records), stats AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM rt),
post AS (SELECT record_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT record_id, len(ts) AS dl, unnest(ts) AS token FROM rt) GROUP BY record_id, token),
dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token),
qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({tokens('query')}) AS token FROM q WHERE {only}) GROUP BY 1, 2),
sc AS (SELECT query_id, record_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / greatest(tf + 1.5 * (0.25 + 0.75 * dl / greatest(a, 1)), 1e-9)), 9) AS score, list_sort(list(DISTINCT token)) AS matched
  FROM post JOIN dfs USING (token) JOIN qt USING (token), stats GROUP BY 1, 2),
hits AS (SELECT query_id, record_id, score, matched, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR, page, block_id) AS rank FROM sc JOIN records USING (record_id) WHERE score > 0 AND {where})"""


_hit = "SELECT query_id, record_id, round(score, 6) AS score, array_to_string(matched, ',') AS matched, rank FROM hits WHERE rank <= 8"
ORACLES["bm25_topk"] = f"WITH {bm25(only=chr(34) + 'query_id' + chr(34) + ' = ' + chr(39) + 'q0' + chr(39))} {_hit}"
ORACLES["bm25_multi_query"] = f"WITH {bm25()} {_hit}"
ORACLES["bm25_doc_filter"] = f"WITH {bm25('doc_id < 40')} {_hit}"
ORACLES["bm25_docfreq"] = f"WITH {RECORDS}, t AS (SELECT record_id, unnest({tokens('text')}) AS token FROM records) SELECT token, count(DISTINCT record_id) AS df, count(*) AS cf FROM t GROUP BY token"
_normal = strip(r"regexp_replace(query, '\s+', ' ', 'g')")
PROFILES = rf"""{QUESTIONS}, n AS (SELECT query_id, conv_id, {_normal} AS normalized FROM q),
t AS (SELECT *, list_filter({tokens('normalized')}, lambda x: length(x) >= 2 AND x NOT IN ({STOPS})) AS ts, list_concat(regexp_extract_all(normalized, '\b[A-Z][A-Z0-9&.\-/]{{1,20}}\b'), regexp_extract_all(normalized, '\b[0-9]{{4,8}}\b')) AS es FROM n),
u AS (SELECT *, list_filter(ts, lambda x, i: list_position(ts, x) = i) AS tokens, list_filter(es, lambda x, i: list_position(es, x) = i) AS entities FROM t),
v AS (SELECT *, list_concat(entities, tokens) AS al, list_transform(list_concat(entities, tokens), lambda x: lower(x)) AS low FROM u),
profiles AS (SELECT *, array_to_string(list_filter(al, lambda x, i: list_position(low, lower(x)) = i), ' ') AS lexical FROM v)"""
ORACLES["query_profile"] = f"WITH {PROFILES} SELECT query_id, normalized, array_to_string(tokens, '|') AS query_tokens, array_to_string(entities, '|') AS entities, lexical AS lexical_queries FROM profiles"
_embed = f"'doc_id: ' || doc_id || {NL} || 'page_id: ' || (page + 1) || {NL} || 'generic_role: ' || generic_role || {NL} || 'domain_role: ' || domain_role || {NL} || 'generated_role_name: unknown' || {NL} || 'section_purpose: ' || section_purpose || {NL} || {NL} || 'content:' || {NL} || text"
ORACLES["search_records"] = f"WITH {RECORDS} SELECT record_id, source_kind, round(role_confidence, 6) AS role_confidence, needs_review, length(text) AS display_chars, length({_embed}) AS embedding_chars, md5({_embed}) AS embedding_md5 FROM records"
ORACLES["search_metadata"] = f"WITH {RECORDS} SELECT record_id, page, block_id AS display_block_id, generic_role, domain_role, generated_role_name, section_purpose, needs_review AS semantic_needs_review, source_kind FROM records"
ENTITY_SQL = rf"""{RECORDS}, e AS (SELECT DISTINCT 'q' || item_id AS query_id, unnest(regexp_extract_all(text, '\S+')) AS entity FROM benchmark WHERE item_id % 50 = 0), n AS (SELECT count(*) AS n FROM records),
m AS (SELECT query_id, entity, record_id FROM e, records WHERE contains(lower(text), lower(entity))),
w AS (SELECT e.query_id, e.entity, count(record_id) AS match_count, any_value(n) AS n FROM e LEFT JOIN m USING (query_id, entity), n GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN n <= 0 THEN 1.0 WHEN match_count > 12 OR match_count / n > 0.30 THEN 0.0 WHEN match_count > 6 OR match_count / n > 0.15 THEN 0.5 ELSE 1.0 END AS factor FROM w)"""
ORACLES["entity_grounding"] = f"WITH {ENTITY_SQL} SELECT query_id, entity, match_count, round(match_count / greatest(n, 1), 6) AS match_ratio, factor::DOUBLE AS factor, factor < 1 AS is_common FROM x"
ORACLES["entity_dictionary"] = rf"WITH {RECORDS}, e AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '\S+'))) AS word FROM benchmark) SELECT word, count(*) AS n FROM e, records WHERE contains(lower(text), word) GROUP BY word"
ORACLES["entity_scores"] = f"WITH {ENTITY_SQL} SELECT query_id, record_id, least(1.0, sum(factor))::DOUBLE AS score FROM m JOIN x USING (query_id, entity) WHERE factor > 0 GROUP BY 1, 2"
VECTORS = "v AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 AND (vec_id + 1) % 10 <> 0 THEN 'semantic:' ELSE 'fallback:' END || vec_id || ':1:1' AS record_id, embedding::DOUBLE[] AS e FROM embeddings)"


def knn(asked: str) -> str:
    return f"{VECTORS}, {asked}, dist AS (SELECT query_id, nth, record_id, round(list_sum(list_transform(list_zip(e, z), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance FROM v, asked), near AS (SELECT *, row_number() OVER (PARTITION BY query_id, nth ORDER BY distance, record_id) AS rank FROM dist)"


ORACLES["knn_topk"] = f"WITH {knn('asked AS (SELECT vec_id::VARCHAR AS query_id, 0 AS nth, e AS z FROM v WHERE vec_id % 50 = 0)')} SELECT query_id, record_id, round(distance, 5) AS distance, rank FROM near WHERE rank <= 20"
KNN = knn("asked AS (SELECT query_id, nth, e AS z FROM v JOIN (SELECT query_id, conv_id, unnest(CASE WHEN conv_id % 100 = 0 THEN [0, 1] ELSE [0] END) AS nth FROM q) k ON vec_id = conv_id + nth)")
_words = PROFILES.replace("q(query_id", "asking(query_id").replace("FROM q)", "FROM asking)").replace("\nv AS", "\nv0 AS").replace("FROM v)", "FROM v0)").replace(", n AS (", ", n0 AS (").replace("FROM n)", "FROM n0)")
_lexical = bm25().replace(QUESTIONS, f"{_words}, q AS (SELECT query_id || '/0' AS query_id, lexical AS query, conv_id FROM profiles UNION ALL SELECT query_id || '/1', 'thing eronin', conv_id FROM profiles WHERE conv_id % 100 = 0)")
KNN = KNN.replace("FROM q) k", "FROM profiles) k")

ORACLES["hybrid_search"] = f"""WITH {_lexical}, {KNN},
lex AS (SELECT split_part(query_id, '/', 1) AS query_id, record_id, max(score) AS bm25, arg_max(matched, score) AS terms FROM hits WHERE rank <= 8 GROUP BY 1, 2),
ep AS (SELECT query_id, list_concat(entities, CASE WHEN conv_id % 100 = 0 THEN ['andonhethnt'] ELSE [] END) AS es FROM profiles),
eq AS (SELECT *, list_transform(es, lambda x: lower(x)) AS low FROM ep),
en AS (SELECT query_id, unnest(list_filter(es, lambda x, i: list_position(low, lower(x)) = i)[1:6]) AS entity FROM eq),
em AS (SELECT query_id, entity, record_id FROM en, records WHERE contains(lower(text), lower(entity))),
ef AS (SELECT query_id, entity, count(*) AS m, (SELECT count(*) FROM records) AS n FROM em GROUP BY 1, 2),
ex AS (SELECT query_id, record_id, least(1.0, sum(CASE WHEN m > 6 OR m / n > 0.15 THEN 0.5 ELSE 1.0 END))::DOUBLE AS entity FROM em JOIN ef USING (query_id, entity) WHERE NOT (m > 12 OR m / n > 0.30) GROUP BY 1, 2),
al AS (SELECT query_id, record_id, 'semantic' AS channel, min(distance) AS distance, NULL AS bm25, NULL AS entity, NULL AS terms FROM near WHERE rank <= 6 GROUP BY query_id, record_id
  UNION ALL SELECT query_id, record_id, 'bm25', NULL, bm25, NULL, terms FROM lex UNION ALL SELECT query_id, record_id, 'entity', NULL, NULL, entity, NULL FROM ex),
mg AS (SELECT query_id, record_id, min(distance) AS distance, max(bm25) AS bm25, max(entity) AS entity, string_agg(channel, ',' ORDER BY channel) AS channels, coalesce(any_value(array_to_string(terms, ',')), '') AS terms FROM al GROUP BY 1, 2),
sd AS (SELECT mg.*, doc_id, page, block_id, role_confidence::DOUBLE AS rc, needs_review::INT AS nr, max(bm25) OVER (PARTITION BY query_id) AS best FROM mg JOIN records USING (record_id)),
fs AS (SELECT *, channels = 'entity' AS eo, round(CASE WHEN channels = 'entity' THEN 0.20::DOUBLE * entity + 0.05::DOUBLE * rc - 0.02::DOUBLE * nr
  ELSE 0.45::DOUBLE * coalesce(greatest(0, 1 - least(distance, 1.5)), 0) + 0.35::DOUBLE * coalesce(CASE WHEN best > 0 THEN bm25 / best END, 0) + 0.05::DOUBLE * coalesce(entity, 0) + 0.10::DOUBLE * rc - 0.02::DOUBLE * nr END, 9) AS score FROM sd)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY eo, score DESC, coalesce(distance, 999), coalesce(bm25, 0) DESC, doc_id, page, block_id) AS rank, record_id, channels, round(score, 6) AS score, round(bm25, 6) AS bm25, round(distance, 5) AS distance, round(entity, 6) AS entity, terms FROM fs QUALIFY rank <= 12"""

_four = "coalesce(printf('%.4f', {0}), 'n/a')".format
_cut = strip(r"regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')")
ORACLES["search_output"] = rf"""WITH found AS (SELECT * FROM ({ORACLES["hybrid_search"].replace("SELECT query_id, row_number() OVER", "SELECT doc_id, page, block_id, score AS s, bm25 AS b, distance AS d, query_id, row_number() OVER")})), {LINES},
shown AS (SELECT f.*, {_cut.replace("text", "content")} AS t FROM found f JOIN blocks k ON f.doc_id = k.doc_id AND f.page + 1 = k.page AND f.block_id = 'block-' || k.block_index)
SELECT query_id, rank, concat_ws(' ', 'Candidate #' || rank || ':', 'document=' || doc_id, 'page=' || (page + 1), 'block=' || block_id, 'score=' || {_four("s")}, 'distance=' || {_four("d")}, 'bm25=' || {_four("b")}, 'channels=' || channels, 'terms=' || coalesce(nullif(terms, ''), 'n/a'),
  'preview=' || CASE WHEN length(t) > 240 THEN regexp_replace(substr(t, 1, 237), '\s+$', '') || '...' ELSE t END) AS line FROM shown"""

# --- text ---
ORACLES["clean_text"] = f"SELECT doc_id, length({clean('text')}) AS n_chars, md5({clean('text')}) AS clean_md5 FROM documents"
ORACLES["script_buckets"] = "SELECT doc_id, " + ", ".join(f"{c} AS {n}" for c, n in zip(_s, ("hangul", "latin", "han", "other"), strict=True)) + " FROM documents"
ORACLES["text_quality"] = f"WITH {CANONICAL} SELECT block_id, page, round(weird, 6) AS weird, round(long_tokens, 6) AS long_tokens, round(repeat, 6) AS repeat, quality FROM canonical"
ORACLES["language_detect"] = f"SELECT doc_id, CASE WHEN {_s[0]} >= greatest({_s[1]}, {_s[2]}) THEN 'ko' WHEN {_s[1]} >= {_s[2]} THEN 'en' ELSE 'unknown' END AS language FROM documents"
ORACLES["financial_signal"] = f"WITH {LINES}, c AS (SELECT doc_id, {clean('content')} AS text FROM blocks) SELECT doc_id, count(*) FILTER ({FINANCIAL}) AS signals FROM c GROUP BY doc_id"
ORACLES["stable_hash"] = "SELECT doc_id, substr(sha1(doc_id || '::' || source), 1, 12) AS hash, source || '_' || lang AS name, lang || '_' || source AS role FROM documents"
ORACLES["ordered_dedupe"] = f"""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(text, {NL}), lambda x: {strip('x')}), lambda x: length(x) > 0) AS ls FROM documents), b AS (SELECT doc_id, ls, list_transform(ls, lambda x: lower(x)) AS low FROM a),
c AS (SELECT doc_id, list_filter(ls, lambda x, i: list_position(low, lower(x)) = i) AS k FROM b) SELECT doc_id, len(k) AS n, md5(array_to_string(k, {NL})) AS lines_md5 FROM c"""

# --- layout ---
ORACLES["canonical_blocks"] = f"WITH {CANONICAL} SELECT doc_id, page, block_id, label, reading_order, n1, n2, n3, n4, length(text) AS chars FROM base"
ORACLES["page_metrics"] = f"WITH {PAGES} SELECT * FROM metrics"
ORACLES["page_archetype"] = f"WITH {PAGES} SELECT doc_id, page, archetype, pattern, warnings, large_visual FROM pages"
ORACLES["page_specs"] = f"WITH {PAGES} SELECT doc_id, page, width, height, columns, content_y1 AS margin_top, greatest(0, width - content_x2) AS margin_right, greatest(0, height - content_y2) AS margin_bottom, content_x1 AS margin_left, large_visual, pattern FROM pages"
ORACLES["doc_family"] = f"WITH {PAGES}, {FAMILY} SELECT * FROM families"
ORACLES["section_order"] = f"WITH {PAGES}, {SECTIONS} SELECT * FROM sections"
ORACLES["image_slots"] = f"""WITH {PAGES} SELECT doc_id, page, 'image-slot-' || block_id AS slot_id, CASE WHEN (n1 + n3) / 2 < 0.4 THEN 'left' WHEN (n1 + n3) / 2 > 0.6 THEN 'right' ELSE 'center' END AS alignment, round(n3 - n1, 4) AS width_ratio, round(n4 - n2, 4) AS height_ratio
FROM anchored WHERE label = 'image' AND greatest(0, x2 - x1) * greatest(0, y2 - y1) / (width * height) >= 0.03"""
ORACLES["style_tokens"] = f"""WITH {PAGES},
k AS (SELECT *, greatest(0.0, n4 - n2) AS high, greatest(0.0, n3 - n1) AS wide, CASE WHEN label = 'document_title' THEN 'title' WHEN label IN ('section_heading', 'subheading') THEN 'subtitle' WHEN label IN ('paragraph', 'paragraph_or_meta') AND length(text) >= 20 THEN 'body' END AS kind,
  CASE WHEN label = 'image' THEN CASE WHEN (n1 + n3) / 2 < 0.4 THEN 'left' WHEN (n1 + n3) / 2 > 0.6 THEN 'right' ELSE 'center' END END AS side FROM anchored),
s AS (SELECT *, greatest(0.0, (y1 - lag(y2) OVER (PARTITION BY doc_id, CASE WHEN kind = 'body' THEN 1 WHEN kind IS NOT NULL THEN 2 END ORDER BY page, reading_order)) / height) AS space, lag(y2) OVER (PARTITION BY doc_id, CASE WHEN kind = 'body' THEN 1 WHEN kind IS NOT NULL THEN 2 END ORDER BY page, reading_order) AS up FROM k),
b AS (SELECT doc_id, coalesce(median(high) FILTER (kind = 'body'), 0.028) AS body, median(high) FILTER (kind = 'title') AS title, median(high) FILTER (kind = 'subtitle') AS subtitle, median(space) FILTER (kind = 'body' AND up IS NOT NULL) AS paragraph, median(space) FILTER (kind = 'subtitle' AND up IS NOT NULL) AS section, median(wide) FILTER (kind = 'body') AS width, string_agg(DISTINCT side, ',' ORDER BY side) AS sides FROM s GROUP BY doc_id),
t AS (SELECT doc_id, arg_min(side, (-n, pl)) AS top_side FROM (SELECT doc_id, side, count(*) AS n, min(page * 100 + reading_order) AS pl FROM k WHERE side IS NOT NULL GROUP BY 1, 2) GROUP BY doc_id),
c AS (SELECT doc_id, median(columns) AS columns FROM pages WHERE archetype IN ('cover_summary', 'body_narrative') GROUP BY doc_id)
SELECT doc_id, round(coalesce(title, body * 1.8) / greatest(body, 0.001), 4) AS title_scale, round(coalesce(subtitle, body * 1.3) / greatest(body, 0.001), 4) AS subtitle_scale, round(body, 4) AS body_scale, 1.45::DOUBLE AS line_height, round(coalesce(paragraph, 0.018), 4) AS paragraph_spacing,
  round(coalesce(section, 0.03), 4) AS section_spacing, round_even(columns, 0)::INT AS columns, round(coalesce(width, 0.52), 4) AS body_width, coalesce(top_side, 'center') AS alignment, coalesce(sides, 'center') AS alignments FROM c LEFT JOIN b USING (doc_id) LEFT JOIN t USING (doc_id)"""
ORACLES["unsupported_blocks"] = f"WITH {CANONICAL} SELECT doc_id, page, block_id, label AS type, 'unsupported_for_generation' AS reason FROM base WHERE label IN ('table', 'chart')"
ORACLES["repeating_elements"] = f"""WITH {CANONICAL}, d AS (SELECT doc_id FROM base GROUP BY doc_id HAVING count(DISTINCT page) > 1)
SELECT doc_id, arg_max(text, page * 100 + reading_order) AS text, count(*) AS times, arg_max(block_id, page * 100 + reading_order) AS example FROM base JOIN d USING (doc_id) WHERE raw_label IN ('text', 'paragraph_title', 'vision_footnote') AND length(text) > 0 GROUP BY doc_id, lower(text) HAVING count(*) >= 2"""
ORACLES["review_gate"] = f"""WITH {PAGES}, {FAMILY}, {SECTIONS}, p AS (SELECT doc_id, round(avg(quality) + 1e-9, 4) AS score, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (quality < 0.55), '') AS low_pages, count(*) FILTER (archetype IN ('evidence_table', 'compliance')) AS unsupported_pages FROM pages GROUP BY doc_id)
SELECT doc_id, family, score, low_pages, unsupported_pages, low_pages <> '' OR family IN ('form', 'unknown') AS review_required, concat_ws(';', CASE WHEN low_pages <> '' THEN 'low_ocr_quality_pages:' || low_pages END, CASE WHEN doc_id NOT IN (SELECT doc_id FROM sections) THEN 'no_narrative_sections_extracted' END, CASE WHEN family IN ('form', 'unknown') THEN 'unsupported_for_mvp' END) AS notes FROM families JOIN p USING (doc_id)"""

# --- roles ---
ZONES = "coalesce(nullif(concat_ws(',', CASE WHEN n3 <= 0.35 THEN 'left_sidebar_zone' END, CASE WHEN n1 >= 0.32 THEN 'main_body_zone' END, CASE WHEN n4 <= 0.14 THEN 'top_meta_zone' END, CASE WHEN n2 >= 0.78 THEN 'bottom_meta_zone' END), ''), 'unclassified_zone')"
ORACLES["zone_tags"] = f"WITH {CANONICAL} SELECT block_id, page, {ZONES} AS zones, CASE WHEN (n1 + n3) / 2 < 0.4 THEN 'left' WHEN (n1 + n3) / 2 > 0.6 THEN 'right' ELSE 'center' END AS alignment FROM base"
ORACLES["neighbor_topk"] = f"""WITH {CANONICAL}, z AS (SELECT doc_id, page, block_id, reading_order AS ro, label, length(text) > 0 AS filled, string_split({ZONES}, ',')[1] AS zone, round((n1 + n3) / 2, 4) AS cx, round((n2 + n4) / 2, 4) AS cy FROM base),
r(pr, relation, most) AS (VALUES (0, 'previous_text', 2), (1, 'next_text', 2), (2, 'nearest_heading', 1), (3, 'nearest_evidence', 2)),
p AS (SELECT a.doc_id, a.page, a.block_id, b.block_id AS neighbour, b.ro AS o, abs(a.ro - b.ro) AS gap, r.*, round(0.6::DOUBLE * least(abs(a.ro - b.ro) / 10, 1.0) + 0.4::DOUBLE * least(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) / sqrt(2), 1.0) + CASE WHEN a.zone = b.zone THEN -0.3 ELSE 0.0 END, 9) AS score
  FROM z a JOIN z b ON a.doc_id = b.doc_id AND a.page = b.page AND a.block_id <> b.block_id, r
  WHERE (r.pr = 0 AND b.label IN {TEXT_LIKE} AND b.filled AND b.ro < a.ro) OR (r.pr = 1 AND b.label IN {TEXT_LIKE} AND b.filled AND b.ro > a.ro) OR (r.pr = 2 AND b.label IN ('document_title', 'section_heading', 'subheading', 'section_heading_or_panel_title') AND b.filled) OR (r.pr = 3 AND b.label IN ('table', 'chart', 'image'))),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, block_id, pr ORDER BY score, gap, o) AS rank FROM p QUALIFY rank <= most),
u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, page, block_id, neighbour ORDER BY pr) = 1)
SELECT block_id, relation, neighbour, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id, page, block_id ORDER BY pr, rank) AS place FROM u QUALIFY place <= 6"""
DECISIONS = f"""{CANONICAL}, a AS (SELECT *, doc_id + reading_order * 3 AS sq FROM canonical),
dec AS (SELECT doc_id, page, block_id, reading_order, quality, length(text) > 0 OR label IN ('table', 'chart', 'image') AS eligible, CASE WHEN sq % 17 = 0 THEN 'backend_error' WHEN sq % 19 = 0 THEN 'invalid_json' END AS error,
  ['main_title', 'section_heading', 'body', 'evidence', 'summary', 'metadata', 'disclaimer', 'oddity'][(sq % 8 + 1)::INT] AS gr, ['report_title', 'thesis_heading', 'supporting_argument', 'key_data_box', 'report_title'][(sq % 6 + 1)::INT] AS dr, (sq % 101) / 100 AS conf FROM a),
why AS (SELECT *, CASE WHEN NOT eligible THEN 'ineligible_block' WHEN quality < 0.55 THEN 'low_page_quality' WHEN error IS NOT NULL THEN error WHEN gr = 'oddity' THEN 'schema_mismatch' WHEN conf < 0.55 THEN 'low_role_confidence' END AS fallback_reason FROM dec),
gated AS (SELECT doc_id, page, block_id, reading_order, eligible, CASE WHEN fallback_reason IS NULL THEN 'model' ELSE 'fallback' END AS source, fallback_reason, CASE WHEN fallback_reason IS NULL THEN gr ELSE 'unknown' END AS generic_role,
  CASE WHEN fallback_reason IS NULL AND conf >= 0.75 AND ((gr = 'main_title' AND dr = 'report_title') OR (gr = 'section_heading' AND dr IN ('key_data_box', 'thesis_heading')) OR (gr = 'body' AND dr = 'supporting_argument') OR (gr = 'evidence' AND dr = 'key_data_box')) THEN dr END AS domain_role,
  CASE WHEN fallback_reason IS NULL THEN round(conf, 4) ELSE 0.0 END AS confidence, fallback_reason IS NOT NULL OR conf < 0.75 AS needs_review, eligible AND quality >= 0.55 AS attempted FROM why)"""
ORACLES["role_gate"] = f"WITH {DECISIONS} SELECT block_id, source, fallback_reason, generic_role, domain_role, confidence, needs_review, attempted FROM gated"
ORACLES["role_policy"] = f"""WITH {DECISIONS} SELECT block_id, CASE WHEN domain_role IN ('report_title', 'thesis_heading', 'supporting_argument') THEN true WHEN domain_role = 'key_data_box' THEN generic_role = 'section_heading' ELSE generic_role IN ('author_info', 'disclaimer', 'summary', 'body', 'main_title', 'section_heading') END AS used,
  CASE WHEN domain_role = 'report_title' THEN 'main_argument' WHEN domain_role = 'thesis_heading' THEN 'thesis' WHEN domain_role = 'supporting_argument' THEN 'supporting_argument' WHEN domain_role = 'key_data_box' THEN 'evidence_panel'
    WHEN generic_role = 'disclaimer' THEN 'disclaimer' WHEN generic_role = 'summary' THEN 'investment_summary' WHEN generic_role = 'body' THEN 'supporting_argument' WHEN generic_role = 'main_title' THEN 'main_argument' WHEN generic_role = 'evidence' THEN 'evidence_panel' END AS purpose,
  coalesce(domain_role, CASE generic_role WHEN 'main_title' THEN 'document_title_block' WHEN 'section_heading' THEN 'section_heading_block' WHEN 'body' THEN 'narrative_block' WHEN 'unknown' THEN 'unknown_block' ELSE generic_role || '_block' END) AS role_name,
  CASE generic_role WHEN 'main_title' THEN 'document_structure' WHEN 'section_heading' THEN 'document_structure' WHEN 'summary' THEN 'summary_panel' WHEN 'body' THEN 'narrative' WHEN 'evidence' THEN 'evidence_cluster' WHEN 'metadata' THEN 'metadata' WHEN 'disclaimer' THEN 'compliance' END AS parent, 'block' AS level FROM gated"""
ORACLES["section_ids"] = f"""WITH {DECISIONS}, s AS (SELECT *, coalesce(domain_role IN ('report_title', 'thesis_heading'), false) AS start, coalesce(domain_role = 'supporting_argument', false) AS arg FROM gated),
n AS (SELECT *, sum(start::INT) OVER (PARTITION BY doc_id ORDER BY page, reading_order) AS n, bool_or(start) OVER (PARTITION BY doc_id, page ORDER BY reading_order) AS op FROM s)
SELECT block_id, CASE WHEN start OR (arg AND op) THEN 'sec-' || lpad(n::INT::VARCHAR, 3, '0') END AS section_id, arg AND NOT op AS orphan FROM n"""
ORACLES["semantic_summary"] = f"WITH {DECISIONS} SELECT count(*) FILTER (attempted) AS attempted, count(*) FILTER (source = 'model') AS accepted, count(*) FILTER (source <> 'model' AND eligible) AS fallbacks, count(*) FILTER (needs_review) AS needs_review, round(coalesce(avg(confidence) FILTER (source = 'model'), 0), 4) AS mean_confidence FROM gated"
ORACLES["source_breakdown"] = "SELECT source, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS share FROM documents GROUP BY source"

# --- catalog ---
IMAGES = f"{LINES}, images AS (SELECT doc_id, page AS display_order, doc_id || '/' || page AS file_id FROM blocks WHERE block_index = 1 AND doc_id % 7 <> 0)"
ORACLES["document_list"] = f"WITH {IMAGES} SELECT doc_id, source || '-' || doc_id AS display_name, (SELECT count(*) FROM images i WHERE i.doc_id = d.doc_id) AS n_images FROM documents d"
ORACLES["documents_ready"] = "SELECT (SELECT count(*) = 3 FROM documents WHERE doc_id IN (1, 2, 2)) AS all_exist, (SELECT count(*) = 0 FROM documents WHERE doc_id IN (2, 6, 10) AND doc_id % 4 + 1 <> 3) AS all_ready"
ORACLES["page_image_at"] = f"WITH {IMAGES} SELECT doc_id, file_id, 'image/png' AS mime_type FROM images QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY display_order, file_id) = 2"
ORACLES["chat_detail"] = f"SELECT conv_id AS chat_id, {strip('substr(' + strip('arg_min(text, turn)') + ', 1, 32)')} AS display_name, conv_id || ',' || (conv_id + 1) AS source_ids, count(*) AS n_messages, md5(string_agg(text, {NL} ORDER BY turn)) AS messages_md5 FROM conversations GROUP BY conv_id"
ORACLES["message_groups"] = """WITH a AS (SELECT conv_id, turn, role = 'system' AS lg FROM conversations), b AS (SELECT *, NOT (lg AND coalesce(lag(lg) OVER (PARTITION BY conv_id ORDER BY turn), false)) AS st FROM a), c AS (SELECT *, sum(st::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM b)
SELECT conv_id AS chat_id, g AS "group", min(turn) AS first_id, count(*) AS n_messages, bool_or(lg) AS is_log FROM c GROUP BY 1, 2"""
ORACLES["message_visibility"] = "SELECT conv_id AS chat_id, count(*) FILTER (role = 'user') AS visible, count(*) FILTER (role <> 'user') AS hidden FROM conversations GROUP BY 1"
ORACLES["artifact_upsert"] = "SELECT doc_id, 'ocr' AS artifact_name, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END AS size FROM documents"
ORACLES["artifact_invalid"] = "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN (props->>'$.k')::BIGINT END AS k, event_id % 5 <> 0 AS valid FROM events"
ORACLES["artifacts_missing"] = "SELECT doc_id, 'style' AS artifact_name FROM documents UNION ALL SELECT doc_id, 'ocr' FROM documents WHERE doc_id % 2 <> 0"

# --- logs ---
TRACE = "tr AS (SELECT event_id, ts, user_id AS run_id, CASE event_type WHEN 'signup' THEN 'run_started' WHEN 'purchase' THEN 'run_completed' WHEN 'error' THEN 'run_failed' ELSE event_type END AS event, CASE event_type WHEN 'view' THEN 'search_index' WHEN 'click' THEN 'write' ELSE 'trace' END AS component FROM events)"
ORACLES["event_router"] = f"WITH {TRACE} SELECT component, component LIKE 'search%' AS to_search, count(*) AS n FROM tr GROUP BY 1, 2"
ORACLES["run_status"] = f"WITH {TRACE} SELECT run_id, event_id, CASE event WHEN 'run_completed' THEN 'completed' WHEN 'run_failed' THEN 'failed' ELSE 'running' END AS status FROM tr QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) = 1"
ORACLES["log_tail"] = f"WITH {TRACE} SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS from_end FROM tr QUALIFY from_end <= 3"
ORACLES["step_durations"] = f"""WITH {TRACE}, s AS (SELECT *, lead(event) OVER w AS ended_by, lead(ts) OVER w AS ended FROM tr WHERE event IN ('run_started', 'run_completed', 'run_failed') WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id))
SELECT run_id, event_id, ended_by, (epoch_us(ended) - epoch_us(ts)) // 1000 AS duration_ms FROM s WHERE event = 'run_started' AND ended_by IN ('run_completed', 'run_failed')"""
ORACLES["status_stream"] = "SELECT user_id AS run_id, count(*) AS n_events, arg_max(event_type, (ts, event_id)) AS event FROM events GROUP BY 1"

# --- markup and evidence ---
_flat = strip(r"regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')")
ORACLES["html_preview"] = rf"WITH f AS (SELECT page_id, {_flat} AS t FROM pages) SELECT page_id, CASE WHEN length(t) > 240 THEN regexp_replace(substr(t, 1, 237), '\s+$', '') || '...' ELSE t END AS preview FROM f"
_escaped = f"replace(replace(replace({strip('content')}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ORACLES["html_structured"] = f"""WITH {LINES}, i AS (SELECT *, 'page-' || page || '-block-' || block_index AS id FROM blocks),
h AS (SELECT doc_id, page, block_index, '<div id="' || id || '" data-bbox="[' || concat_ws(', ', x1 * 1000 // width, y1 * 1000 // height, x2 * 1000 // width, y2 * 1000 // height) || ']">' || {NL} ||
  CASE raw_label WHEN 'image' THEN '  <img src="/' || id || '/image">' WHEN 'table' THEN '  ' || content ELSE '  <p>' || {_escaped} || '</p>' END || {NL} || '</div>' AS html FROM i)
SELECT doc_id, page, md5('<page id="page-' || page || '">' || {NL} || string_agg(html, {NL} ORDER BY block_index) || {NL} || '</page>') AS html_md5 FROM h GROUP BY doc_id, page"""
ORACLES["document_extract"] = """WITH a AS (SELECT page_id, '<page id="p">' || html || '</page>' AS pg FROM pages)
SELECT page_id, md5(CASE WHEN page_id % 2 = 0 THEN '<document id="output">Answer follows. ' || pg || ' end</document>' ELSE '<document id="output">' || chr(10) || pg || chr(10) || '</document>' END) AS document_md5 FROM a"""
ORACLES["json_extract"] = "SELECT event_id, props AS json_text, props->>'$.k' AS k, NULL AS whole FROM events"
ORACLES["evidence_normalize"] = "SELECT doc_id AS id, source AS document_id, 1 AS page_id, 'block-1' AS block_id, 'entity' AS matched_via FROM documents UNION ALL SELECT doc_id, source, 0, 'b2', 'semantic,bm25' FROM documents"
ORACLES["sources_normalize"] = "SELECT doc_id AS id, 's1' AS document_id, true AS used, 'r' AS reason FROM documents UNION ALL SELECT doc_id, 's2', false, '' FROM documents"
ORACLES["unsupported_normalize"] = "SELECT doc_id AS id, 'output-page-1-block-11' AS block_id, 'partially_supported' AS support_status, 'empty_cells' AS required_action FROM documents UNION ALL SELECT doc_id, 'output-page-2-block-3', 'unsupported', 'empty_block' FROM documents"
ORACLES["sanitize_table"] = """SELECT doc_id, '<div id="page-1-block-1"><table><tr><td>k</td><td>a</td><td>b</td></tr><tr><td>' || source || '</td><td>-</td><td>-</td></tr></table></div>' AS sanitized, true AS violates FROM documents"""

# --- style ---
ORACLES["median_color"] = """WITH p AS (SELECT event_type, pow((event_id % 256) / 255.0, 2.2) AS r, pow((event_id // 3 % 256) / 255.0, 2.2) AS g, pow((event_id // 7 % 256) / 255.0, 2.2) AS b FROM events), m AS (SELECT event_type, floor(pow(median(r), 1 / 2.2) * 255 + 1e-9)::INT AS r, floor(pow(median(g), 1 / 2.2) * 255 + 1e-9)::INT AS g, floor(pow(median(b), 1 / 2.2) * 255 + 1e-9)::INT AS b FROM p GROUP BY 1)
SELECT event_type, format('#{:02x}{:02x}{:02x}', r, g, b) AS color FROM m"""
ORACLES["font_merge"] = "WITH m AS (SELECT l_suppkey, l_returnflag AS font, avg(l_quantity) AS cost, median(CASE WHEN l_linenumber <> 7 THEN l_tax END) AS size FROM lineitem GROUP BY 1, 2) SELECT 'b' || l_suppkey AS block_id, arg_min(font, (cost, font)) AS font, round(arg_min(size, (cost, font)), 6) AS size FROM m GROUP BY 1"
ORACLES["char_align"] = "WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM benchmark) SELECT 'b' || item_id AS block_id, row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1 AS place, pos * 10 AS xmin, pos * 10 + 8 AS xmax, ch AS \"char\" FROM c WHERE pos % 7 <> 3"
ORACLES["edit_slice"] = "SELECT item_id, strpos(text, substr(text, 20, 30)) - 1 AS first, strpos(text, substr(text, 20, 30)) - 1 + length(substr(text, 20, 30)) AS stop FROM benchmark"
ORACLES["line_grouping"] = f"""WITH RECURSIVE {LINES}, o AS (SELECT doc_id, page, 'b-' || block_index AS box_id, x1, (y1 / 2)::INT AS y1, y2, row_number() OVER (PARTITION BY doc_id, page ORDER BY (y1 / 2)::INT, 'b-' || block_index) AS n FROM blocks),
f AS (SELECT doc_id, page, n, box_id, x1, 0 AS line, y1 AS top, y2 AS bottom FROM o WHERE n = 1 UNION ALL
  SELECT o.doc_id, o.page, o.n, o.box_id, o.x1, CASE WHEN (o.y2 - o.y1) // 2 <= greatest(least(f.bottom, o.y2) - greatest(f.top, o.y1), 0) THEN f.line ELSE f.line + 1 END,
    CASE WHEN (o.y2 - o.y1) // 2 <= greatest(least(f.bottom, o.y2) - greatest(f.top, o.y1), 0) THEN least(f.top, o.y1) ELSE o.y1 END, CASE WHEN (o.y2 - o.y1) // 2 <= greatest(least(f.bottom, o.y2) - greatest(f.top, o.y1), 0) THEN greatest(f.bottom, o.y2) ELSE o.y2 END
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.n = f.n + 1)
SELECT doc_id, page, line, row_number() OVER (PARTITION BY doc_id, page, line ORDER BY x1, box_id) - 1 AS place, box_id FROM f"""

# --- agent and writer tools ---
ORACLES["search_trace"] = f"""WITH found AS ({ORACLES["hybrid_search"]}), n AS (SELECT query_id, count(*) AS n FROM found GROUP BY 1), {QUESTIONS},
e(nth, event) AS (VALUES (0, 'query_preprocessed'), (1, ''), (2, 'semantic_retrieval_completed'), (3, 'bm25_retrieval_completed'), (4, 'entity_grounding_completed'), (5, 'candidate_merge_completed'), (6, 'first_stage_ordered'), (7, 'first_stage_returned'))
SELECT query_id, nth AS "at", CASE WHEN nth = 1 AND conv_id % 100 = 0 THEN 'llm_expansion_saved' WHEN nth = 1 THEN 'llm_expansion_failed' ELSE event END AS event, CASE WHEN nth >= 5 THEN coalesce(n, 0) END AS n FROM q CROSS JOIN e LEFT JOIN n USING (query_id)"""
ORACLES["fetch_page"] = f"""WITH {LINES}, p AS (SELECT doc_id, page, 'blocks: ' || count(*) AS html FROM blocks GROUP BY 1, 2), s AS (SELECT doc_id, max(page) AS m FROM p GROUP BY 1),
a AS (SELECT doc_id, unnest([1, 0, 100000]) AS page FROM documents WHERE text IS NOT NULL UNION ALL SELECT -7, 1)
SELECT a.doc_id, a.page, CASE WHEN m IS NULL THEN 'document ' || a.doc_id || ' does not exist' WHEN a.page NOT BETWEEN 1 AND m THEN 'page must be between 1 and ' || m ELSE coalesce(html, '') END AS answer FROM a LEFT JOIN s USING (doc_id) LEFT JOIN p ON p.doc_id = a.doc_id AND p.page = a.page"""
ORACLES["chat_export"] = f"SELECT conv_id AS chat_id, md5(string_agg('## ' || turn || ' (' || CASE role WHEN 'user' THEN 10 WHEN 'assistant' THEN 50 ELSE 60 END || ')' || {NL} || {NL} || coalesce(text, '') || {NL}, {NL} ORDER BY turn)) AS markdown_md5 FROM conversations GROUP BY 1"
ORACLES["role_overlay"] = f"WITH {DECISIONS} SELECT block_id, nullif(generic_role, 'unknown') AS generic_role, domain_role, reading_order FROM gated WHERE generic_role <> 'unknown' OR domain_role IS NOT NULL"
ORACLES["decision_parse"] = f"""WITH {CANONICAL}, a AS (SELECT block_id, doc_id + reading_order AS k FROM base), e AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'invalid_json' WHEN k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0 THEN 'schema_mismatch' END AS error FROM a)
SELECT block_id, error, CASE WHEN error IS NULL THEN 'body' END AS generic_role, CASE WHEN error IS NULL THEN 'supporting_argument' END AS domain_role, CASE WHEN error IS NULL THEN 0.8765::DOUBLE END AS confidence, CASE WHEN error IS NULL THEN 'first' END AS reason FROM e"""
ORACLES["output_placement"] = """SELECT doc_id AS id, 2 AS page, 1 AS block, '<div id="output-page-2-block-1"><p>' || lang || '</p></div>' AS html FROM documents UNION ALL SELECT doc_id, 2, 3, '<div id="output-page-2-block-3"><p>' || source || '</p></div>' FROM documents"""
ORACLES["rendered_pages"] = f"""WITH {LINES}, r AS (SELECT *, 'font-family: ' || CASE WHEN doc_id % 2 = 0 THEN 'Serif' ELSE 'sans-serif' END || '; color: #000; line-height: ' || round((y2 - y1) / 2, 2) || 'px;' AS css FROM blocks WHERE raw_label <> 'image')
SELECT doc_id, page, count(*) AS n, arg_min(css, block_index) AS css FROM r GROUP BY 1, 2"""
_name = "CASE WHEN turn % 3 = 0 THEN '   ' ELSE text END"
ORACLES["chat_rename"] = f"SELECT conv_id, turn, length({strip(_name)}) BETWEEN 1 AND 64 AS allowed, {strip('substr(' + strip(_name) + ', 1, 32)')} AS short FROM conversations"

# --- values, clocks and log rows ---


def by_id(key: str, *values: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


ORACLES["coercions"] = f"""SELECT doc_id, doc_id % 7 < 2 AS flag, CASE WHEN doc_id % 7 = 1 THEN 1 ELSE 0 END AS whole, {by_id('doc_id', '0.0::DOUBLE', '1.0', '0.0', '2.75', '-300.0', '0.0', '0.0')} AS number,
CASE WHEN doc_id % 5 = 0 THEN 'a|3' ELSE '' END AS items, CASE WHEN doc_id % 4 = 0 THEN '1|2|-3|4' END AS box FROM documents"""
ORACLES["value_format"] = r"""SELECT doc_id, n_chars::VARCHAR AS n_chars, CASE WHEN doc_id % 5 > 1 AND lang <> '' THEN lang ELSE '-' END AS word, regexp_replace(printf('%.4f', n_chars / 7.0::DOUBLE), '\.?0+$', '') AS ratio,
CASE WHEN n_chars IS NULL THEN '-' WHEN n_chars % 2 = 0 THEN 'Yes' ELSE 'No' END AS even, CASE WHEN doc_id % 3 > 0 THEN n_chars || ', ' || doc_id ELSE '-' END AS names, '{"n_chars":' || n_chars || '}' AS object FROM documents"""
ORACLES["run_clock"] = """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS time,
epoch_us(ts) / 1000000.0::DOUBLE AS seconds, strftime(ts, '%Y%m%dT%H%M%S%fZ') AS run_id FROM events"""
ORACLES["analysis_normalize"] = "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN 'q' ELSE source END AS query, CASE WHEN doc_id % 4 = 0 THEN 'why' ELSE '' END AS user_intent, CASE WHEN doc_id % 4 = 0 THEN 'a|b' ELSE '' END AS writing_strategy, CASE WHEN doc_id % 4 = 1 THEN '1' ELSE '' END AS uncertainties FROM documents"
ORACLES["trace_records"] = f"""WITH c AS ({ORACLES['run_clock']}) SELECT event_id AS run_id, time, CASE WHEN event_id % 5 = 0 THEN 'search_index' ELSE 'trace' END AS component, {by_id('event_id', "'hit'", "'step'", "'trace'", "'message'", "'message'")} AS event,
CASE WHEN event_id % 5 = 0 THEN 1.235::DOUBLE END AS duration_ms, {by_id('event_id', """'{"n":3}'""", 'NULL', """'{"k":{"a":[1]}}'""", """'{"message":"plain text"}'""", """'{"message":"[1, 2]"}'""")} AS payload, event_id % 5 = 0 AS to_search FROM c"""
ORACLES["upload_kinds"] = f"""SELECT doc_id, {by_id('doc_id', "'pdf'", "'png'", "'webp'", "'md'", "'exe'", "''")} AS extension, {by_id('doc_id', "'pdf'", "'image'", "'image'", "'text'", 'NULL', 'NULL')} AS kind,
{by_id('doc_id', 'NULL', 'NULL', 'NULL', "'text files are not supported'", "'unknown extension'", "'missing name or extension'")} AS reject_reason FROM documents"""
ORACLES["box_centres"] = "SELECT doc_id, round((doc_id % 50 + 4) / 64.0::DOUBLE, 6) AS cx, round((doc_id % 70 + 4.5::DOUBLE) / 80, 6) AS cy, 0.125::DOUBLE AS w, 0.1125::DOUBLE AS h FROM documents"
ORACLES["duration_labels"] = r"""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' WHEN n_chars * 10 + 3 < 1000 THEN (n_chars * 10 + 3) || 'ms' ELSE printf('%.1fs', (n_chars * 10 + 3) / 1000.0::DOUBLE) END AS label, 'queued' || chr(10) || source || chr(10) AS log FROM documents"""
ORACLES["chat_list"] = "SELECT conv_id AS chat_id, 'chat ' || conv_id AS display_name, conv_id % 3 = 0 AS has_render FROM conversations GROUP BY conv_id"
