"""Independent SQL for the registered queries, run by DuckDB on the same tables.

Written from the rules, with relational means (joins, windows, recursion), not from the
expressions of the Spark operators.
"""

from __future__ import annotations

from lectern.functions import fixed
from lectern.plans.catalog import CLOSINGS, HASH_DIM

ORACLES: dict[str, str] = {}

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def tokens(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '{W}+|[^\s\p{{L}}\p{{N}}_]'))::INTEGER"


def squash(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def stripped(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def folded(text: str) -> str:
    return squash(f"lower(replace({text}, 'ß', 'ss'))")


def lines(text: str) -> str:
    return rf"string_split(regexp_replace({text}, '\n$', ''), chr(10))"


# ---- token profiles -------------------------------------------------------------------

COUNTS = rf"""
SELECT doc_id, length(text)::INTEGER AS characters,
       len(regexp_extract_all(text, '\S+'))::INTEGER AS words_approx, {tokens("text")} AS tokens
FROM documents"""

ORACLES["token_counts"] = f"""
SELECT *, tokens > 2048 AS exceeds_2048, tokens > 1800 AS exceeds_safe_limit FROM ({COUNTS})"""

PERCENTILES = {
    "p1": 0.01, "p5": 0.05, "p10": 0.1, "p25": 0.25, "median": 0.5,
    "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99,
}

ORACLES["token_distribution"] = f"""
SELECT min(tokens)::DOUBLE AS minimum,
       {", ".join(f"round(quantile_cont(tokens, {q}), 6) AS {n}" for n, q in PERCENTILES.items())},
       max(tokens)::DOUBLE AS maximum, round(avg(tokens), 6) AS mean,
       round(stddev_samp(tokens), 6) AS standard_deviation
FROM ({COUNTS})"""

ORACLES["token_thresholds"] = f"""
SELECT threshold, count(*) FILTER (tokens <= threshold) AS n_texts,
       round(100.0 * count(*) FILTER (tokens <= threshold) / count(*), 6) AS percentage
FROM ({COUNTS}), (SELECT unnest({list(fixed.TOKEN_THRESHOLDS)}) AS threshold) GROUP BY threshold"""

ORACLES["token_recommendation"] = f"""
WITH p AS (SELECT quantile_cont(tokens, 0.9) AS p90, quantile_cont(tokens, 0.95) AS p95 FROM ({COUNTS})),
r AS (SELECT *, CASE WHEN p95 <= 512 THEN 512 WHEN p95 <= 768 THEN 768 WHEN p95 <= 1024 THEN 1024
                     WHEN p95 <= 1280 THEN 1280 ELSE 1536 END AS recommendation FROM p)
SELECT round(p90, 6) AS p90, round(p95, 6) AS p95, recommendation,
       2048 - recommendation AS safety_margin FROM r"""

ORACLES["largest_documents"] = f"""
SELECT doc_id, tokens, characters, tokens > 2048 AS exceeds_2048 FROM ({COUNTS})
ORDER BY tokens DESC, doc_id LIMIT 10"""

ORACLES["value_frequency_topk"] = """
SELECT printf('%.1f', value)::DOUBLE AS value, count(*) AS n, min(event_id) AS first_at
FROM events GROUP BY 1 ORDER BY n DESC, first_at LIMIT 10"""

ORACLES["numeric_line_signal"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, (count(*) FILTER (regexp_matches(line, '\p{Nd}') AND length(trim(line)) < 40))::INTEGER
       AS numeric_lines, count(*)::INTEGER AS total_lines FROM l GROUP BY doc_id"""

ORACLES["text_sample"] = "SELECT doc_id, md5(left(text, 800)) AS sample_md5 FROM documents"

# ---- layout ---------------------------------------------------------------------------

# The pages hold these entities only; the ampersand comes last, so each is decoded once.
ENTITIES = [("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]


def decoded(text: str) -> str:
    for entity, char in ENTITIES:
        text = f"replace({text}, '{entity}', '{char}')"
    return text


_CLEAN = r"""SELECT page_id, url, regexp_replace(html,
       '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g') AS h FROM pages"""
_BODY_TEXT = decoded("regexp_replace(body, '<[^>]*>', ' ', 'g')")

# The pages have no table; what a page shows is compared by another rule in page_visible.
ITEMS = rf"""
WITH clean AS ({_CLEAN}),
segs AS (SELECT page_id, url, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT page_id, url,
  string_split(regexp_replace(h, '(?i)<(/?)(title|h[1-6]|p|li|ul|div|article|section|header|footer|nav|main|head|body|html)(?:\s[^>]*)?/?>',
    chr(30) || '\1\2' || chr(31), 'g'), chr(30)) AS l FROM clean)),
txt AS (SELECT page_id, url, i, lower(split_part(s, chr(31), 1)) AS tag, {squash(_BODY_TEXT)} AS text
  FROM (SELECT *, CASE WHEN contains(s, chr(31)) THEN split_part(s, chr(31), 2) ELSE s END AS body FROM segs))
SELECT page_id AS doc_id, coalesce(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '')::INTEGER, 1) AS page_no,
       (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS item_pos,
       CASE WHEN tag = 'title' THEN 'title' WHEN tag = 'li' THEN 'list_item'
            WHEN regexp_matches(tag, '^h[1-6]$') THEN 'section_header' ELSE 'text' END AS label, text
FROM txt WHERE text <> ''"""

ORACLES["page_visible"] = rf"""
SELECT page_id AS doc_id, sum(length(regexp_replace({decoded("regexp_replace(h, '<[^>]*>', '', 'g')")}, '\s', '', 'g')))::BIGINT
  AS n_visible FROM ({_CLEAN}) GROUP BY page_id"""

ORACLES["page_items"] = f"""
SELECT *, CASE WHEN label IN ('title', 'section_header') THEN '## [' || label || '] ' || text ELSE text END
       AS markdown FROM ({ITEMS})"""

STATS = f"""
SELECT doc_id, page_no, length(string_agg(block, chr(10) || chr(10)))::BIGINT AS n_chars, count(*) AS n_items,
       count(*) FILTER (head) AS n_headings, count(*) FILTER (label = 'table') AS n_tables
FROM (SELECT *, label IN ('title', 'section_header') AS head,
        CASE WHEN label = 'table' THEN '### [TABLE]' || chr(10) || chr(10) || text
             WHEN label IN ('title', 'section_header') THEN '## [' || label || '] ' || text
             ELSE '[' || label || '] ' || text END AS block FROM ({ITEMS}))
GROUP BY doc_id, page_no"""

ORACLES["page_stats"] = STATS

ORACLES["page_index_lines"] = f"""
SELECT doc_id, page_no, '- **Page ' || lpad(page_no::VARCHAR, 4, '0') || '** | ' || n_chars || ' chars | '
  || n_items || ' items | ' || n_headings || ' headings | ' || n_tables || ' tables -> `page_'
  || lpad(page_no::VARCHAR, 4, '0') || '.md`' AS line FROM ({STATS})"""

ORACLES["corpus_totals"] = f"""
SELECT count(*) AS n_pages, sum(n_items)::BIGINT AS n_items, sum(n_headings)::BIGINT AS n_headings,
       sum(n_tables)::BIGINT AS n_tables, sum(n_chars)::BIGINT AS n_chars FROM ({STATS})"""

ORACLES["page_preview"] = """
WITH b AS (SELECT conv_id AS doc_id, turn, turn // 2 + 1 AS page_no, role = 'system' AS head,
  CASE WHEN role = 'system' THEN '## [page_title] ' || text ELSE '[' || role || '] ' || text END AS block
  FROM conversations),
s AS (SELECT doc_id, page_no, length(string_agg(block, chr(10) || chr(10))) AS n_chars, count(*) AS n_items,
  count(*) FILTER (head) AS n_headings FROM b GROUP BY ALL)
SELECT doc_id, page_no::INTEGER AS page_no, '- **Page ' || lpad(page_no::VARCHAR, 4, '0') || '** | ' || n_chars
  || ' chars | ' || n_items || ' items | ' || n_headings || ' headings | 0 tables -> `page_'
  || lpad(page_no::VARCHAR, 4, '0') || '.md`' AS line FROM s
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_no) <= 20"""

TURN_BLOCKS = """
SELECT conv_id AS doc_id, turn, turn // 2 + 1 AS page_no,
  lag(turn // 2 + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
  min(turn // 2 + 1) OVER (PARTITION BY conv_id) AS lowest,
  CASE WHEN role = 'system' THEN '## [page_title] ' || text ELSE text END AS body FROM conversations"""

MARKED = f"""
SELECT doc_id, turn, CASE WHEN before IS NULL THEN '<!-- page: ' || lowest || ' -->' || chr(10) || chr(10) || body
    WHEN before <> page_no THEN '<!-- page: ' || page_no || ' -->' || chr(10) || chr(10) || body ELSE body END AS block
FROM ({TURN_BLOCKS})"""

ASSEMBLED = f"""
SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY turn) AS text FROM ({MARKED}) GROUP BY doc_id"""

ORACLES["document_assembly"] = f"""
WITH a AS (SELECT doc_id, length(text)::BIGINT AS n_chars FROM ({ASSEMBLED})),
b AS (SELECT doc_id, count(*) AS n_blocks, sum(('0x' || substr(md5(block), 1, 8))::BIGINT * number)::BIGINT AS digest
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS number FROM ({MARKED})) GROUP BY doc_id)
SELECT doc_id, n_blocks, n_chars, digest FROM a JOIN b USING (doc_id)"""

ORACLES["page_tracking"] = rf"""
WITH l AS (SELECT doc_id, unnest({lines("text")}) AS line, generate_subscripts({lines("text")}, 1) AS i
           FROM ({ASSEMBLED})),
m AS (SELECT *, nullif(regexp_extract(line, '<!-- page: ([0-9]+) -->', 1), '')::INTEGER AS mark FROM l)
SELECT doc_id, page, count(*) AS n_lines FROM (
  SELECT doc_id, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i
     ROWS UNBOUNDED PRECEDING), 1) AS page FROM m) GROUP BY ALL"""

ORACLES["page_asof"] = """
WITH m AS (SELECT *, CASE WHEN event_type = 'error' THEN event_id END AS mark FROM events)
SELECT event_id, user_id, coalesce(
  last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
  first_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1) AS page FROM m"""

# ---- sections and chunks --------------------------------------------------------------

TURN_LINES = rf"""
WITH t AS (SELECT conv_id, turn, list_concat(
    ['<!-- page: ' || (turn + 1) || ' -->', '', 'CHAPITRE ' || (turn // 2 + 1), '',
     CASE WHEN turn % 2 = 0 THEN '## ' ELSE '### ' END || role, ''], {lines("text")}, ['']) AS l FROM conversations)
SELECT conv_id, turn, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_pos FROM t"""

ORACLES["section_paths"] = rf"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line_pos) AS pos FROM ({TURN_LINES})),
c AS (SELECT *, nullif(regexp_extract(line, '^CHAPITRE ([0-9]+)$', 1), '') AS num FROM l),
p AS (SELECT *, lag(num) OVER (PARTITION BY conv_id, num IS NOT NULL ORDER BY pos) AS prev FROM c),
k AS (SELECT *, CASE WHEN num IS NOT NULL THEN 1 WHEN regexp_matches(line, '^## ') THEN 3
        WHEN regexp_matches(line, '^### ') THEN 4 END AS level FROM p
      WHERE num IS NULL OR prev IS NULL OR prev <> num),
w AS (SELECT *,
  max(CASE WHEN level = 1 THEN pos END) OVER o AS p1, max(CASE WHEN level = 3 THEN pos END) OVER o AS p3,
  max(CASE WHEN level = 4 THEN pos END) OVER o AS p4,
  last_value(num IGNORE NULLS) OVER o AS chapter_number,
  last_value(CASE WHEN level = 3 THEN line[4:] END IGNORE NULLS) OVER o AS t3,
  last_value(CASE WHEN level = 4 THEN line[5:] END IGNORE NULLS) OVER o AS t4
  FROM k WINDOW o AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, line_pos::INTEGER AS line_pos, chapter_number, 'CHAPITRE ' || chapter_number
  || CASE WHEN p3 > p1 THEN ' > ' || t3 ELSE '' END
  || CASE WHEN p4 > p1 AND p4 > coalesce(p3, 0) THEN ' > ' || t4 ELSE '' END AS section_path
FROM w WHERE chapter_number IS NOT NULL"""


def packed(source: str, keys: str, tokens=tokens, limit: int = 256) -> str:
    """Chunks of the texts of ``source`` (keys, text): recursion over blocks and lines."""
    k = [x.strip() for x in keys.split(",")]
    same = " AND ".join(f"g.{x} = u.{x}" for x in k)
    return rf"""
WITH RECURSIVE src AS MATERIALIZED (SELECT {keys}, {stripped("text")} AS text FROM ({source})),
sized AS MATERIALIZED (SELECT *, {tokens("text")} AS n FROM src WHERE text <> ''),
block0 AS (SELECT {keys}, regexp_split_to_array(text, '\n\s*\n') AS b FROM sized WHERE n > {limit}),
block1 AS (SELECT {keys}, unnest(b) AS block, generate_subscripts(b, 1) AS bi FROM block0),
block AS (SELECT {keys}, bi, {stripped("block")} AS block, {tokens("block")} AS n FROM block1),
line0 AS (SELECT {keys}, bi, {lines("block")} AS l FROM block WHERE n > {limit}),
line1 AS (SELECT {keys}, bi, unnest(l) AS line, generate_subscripts(l, 1) AS li FROM line0),
unit0 AS (SELECT {keys}, bi, 0 AS li, block AS t, -1 AS run FROM block WHERE n <= {limit} AND block <> ''
          UNION ALL SELECT {keys}, bi, li, {stripped("line")}, bi FROM line1),
unit AS MATERIALIZED (SELECT {keys}, t, run, {tokens("t")} AS n,
          row_number() OVER (PARTITION BY {keys} ORDER BY bi, li) AS pos FROM unit0 WHERE t <> ''),
g AS (SELECT {keys}, pos, t, run, n, 0 AS chunk, n AS total FROM unit WHERE pos = 1
      UNION ALL
      SELECT {", ".join("u." + x for x in k)}, u.pos, u.t, u.run, u.n,
        CASE WHEN u.run <> g.run OR g.total + u.n > {limit} THEN g.chunk + 1 ELSE g.chunk END,
        CASE WHEN u.run <> g.run OR g.total + u.n > {limit} THEN u.n ELSE g.total + u.n END
      FROM g JOIN unit u ON {same} AND u.pos = g.pos + 1),
joined AS (SELECT {keys}, chunk, sum(n)::INTEGER AS token_sum,
      CASE WHEN min(run) >= 0 THEN string_agg(t, chr(10) ORDER BY pos)
           ELSE string_agg(t, chr(10) || chr(10) ORDER BY pos) END AS text FROM g GROUP BY {keys}, chunk)
SELECT {keys}, chunk, text, {tokens("text")} AS token_count, token_sum FROM joined
UNION ALL SELECT {keys}, 0, text, n, n FROM sized WHERE n <= {limit}"""


def cleaned(text: str) -> str:
    trimmed = rf"regexp_replace({text}, '(?m)[ \t\r\f\v]+$', '', 'g')"
    return stripped(rf"regexp_replace({trimmed}, '\n{{3,}}', chr(10) || chr(10), 'g')")


_PAIRS = f"""
SELECT conv_id, ch, 'CHAPITRE ' || (ch + 1) || chr(10) || chr(10) || {cleaned("body")} AS text
FROM (SELECT conv_id, turn // 2 AS ch, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body
      FROM conversations GROUP BY ALL)"""

# A chapter opens on its even turn's page; the next turn's page mark, which stands in
# front of the next chapter line, still belongs to it.
ORACLES["chunk_pack"] = f"""
WITH c AS ({packed(_PAIRS, "conv_id, ch")}), last AS (SELECT conv_id, max(turn) AS top FROM conversations GROUP BY 1)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY ch, chunk) - 1) AS chunk_index,
  'CHAPITRE ' || (ch + 1) AS section_path, (2 * ch + 1)::INTEGER AS page_start,
  (least(2 * ch + 2, top) + 1)::INTEGER AS page_end, token_count, token_sum, md5(text) AS text_md5
FROM c JOIN last USING (conv_id)"""

_HEADED = f"""
SELECT conv_id, 2 * turn AS sec, 'CHAPITRE ' || (turn // 2 + 1) AS text FROM conversations WHERE turn % 2 = 0
UNION ALL SELECT conv_id, 2 * turn + 1, role || chr(10) || chr(10) || {cleaned("text")} FROM conversations"""

ORACLES["conversation_chunks"] = f"""
WITH c AS ({packed(_HEADED, "conv_id, sec")}),
meta AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
   max(turn) OVER (PARTITION BY conv_id) AS top FROM conversations)
SELECT c.conv_id, (row_number() OVER (PARTITION BY c.conv_id ORDER BY sec, chunk) - 1) AS chunk_index,
  'CHAPITRE ' || (turn // 2 + 1) || CASE WHEN sec % 2 = 0 THEN '' WHEN turn % 2 = 0 THEN ' > ' || role
     ELSE ' > ' || before || ' > ' || role END AS section_path,
  (turn + 1)::INTEGER AS page_start,
  (CASE WHEN sec % 2 = 0 THEN turn ELSE least(turn + 1, top) END + 1)::INTEGER AS page_end,
  token_count, token_sum, md5(text) AS text_md5
FROM c JOIN meta ON meta.conv_id = c.conv_id AND meta.turn = c.sec // 2"""

_MARKED_LINES = rf"""
WITH l AS (SELECT doc_id, unnest({lines("text")}) AS line, generate_subscripts({lines("text")}, 1) AS pos FROM documents)
SELECT *, CASE WHEN regexp_matches(line, '^[A-F]') THEN 3 WHEN regexp_matches(line, '^[G-L]') THEN 5 END AS level FROM l"""

_MARKED_SECTIONS = f"""
WITH l AS ({_MARKED_LINES}),
o AS (SELECT *, coalesce(max(CASE WHEN level IS NOT NULL THEN pos END) OVER w, 0) AS head,
   max(CASE WHEN level = 3 THEN pos END) OVER w AS p3,
   last_value(CASE WHEN level = 3 THEN trim(line) END IGNORE NULLS) OVER w AS t3,
   last_value(CASE WHEN level = 5 THEN trim(line) END IGNORE NULLS) OVER w AS t5
   FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
s AS (SELECT doc_id, head, max(level) AS level, max(CASE WHEN pos = head THEN trim(line) END) AS title,
   max(CASE WHEN pos = head THEN t3 END) AS t3,
   max(CASE WHEN pos = head THEN t5 END) AS t5,
   string_agg(CASE WHEN pos <> head THEN line END, chr(10) ORDER BY pos) AS body FROM o GROUP BY doc_id, head),
all_s AS (SELECT doc_id, head, level, title, t3, t5, body FROM s
   UNION ALL SELECT doc_id, 0, NULL, NULL, NULL, NULL, NULL FROM documents
     WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE head = 0)),
named AS (SELECT doc_id, head, coalesce(level, 1) AS level, coalesce(title, 'CHAPITRE 1') AS title,
   'CHAPITRE 1' || CASE WHEN level IS NULL THEN '' WHEN level = 3 THEN ' > ' || t3
      ELSE coalesce(' > ' || t3, '') || ' > ' || t5 END AS path,
   {cleaned("coalesce(body, '')")} AS body FROM all_s)
SELECT doc_id, head, level, path,
  (row_number() OVER (PARTITION BY doc_id ORDER BY head) - 1)::INTEGER AS section_pos,
  CASE WHEN body = '' THEN title ELSE title || chr(10) || chr(10) || body END AS text FROM named"""

ORACLES["markdown_sections"] = f"""
SELECT doc_id, section_pos, level::INTEGER AS level, md5(path) AS path_md5, md5(text) AS text_md5
FROM ({_MARKED_SECTIONS})"""

ORACLES["markdown_chunks"] = f"""
WITH c AS ({packed(_MARKED_SECTIONS, "doc_id, section_pos")}), s AS ({_MARKED_SECTIONS})
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section_pos, chunk) - 1)::INTEGER AS chunk_index,
  (1 + len(regexp_extract_all(path, ' > ')))::INTEGER AS depth, 1 AS page_start, 1 AS page_end,
  token_count, token_sum, md5(c.text) AS text_md5 FROM c JOIN s USING (doc_id, section_pos)"""

_SOFT, _HARD = fixed.SOFT_TOKENS, fixed.HARD_TOKENS
# Sections up to the hard limit whole, longer ones by paragraphs and lines, the title with the first.
ORACLES["header_carrying_chunks"] = rf"""
WITH RECURSIVE s AS MATERIALIZED (
   SELECT doc_id, section_pos AS sec, text, {tokens("text")} AS n, string_split(path, ' > ') AS path
   FROM ({_MARKED_SECTIONS})),
p0 AS (SELECT doc_id, sec, path, regexp_split_to_array(text, '\n\s*\n') AS b FROM s WHERE n > {_HARD}),
p1 AS (SELECT doc_id, sec, path, unnest(b) AS t, generate_subscripts(b, 1) AS bi FROM p0),
p2 AS (SELECT doc_id, sec, path, bi, {stripped("t")} AS t, {tokens("t")} AS n FROM p1),
l0 AS (SELECT doc_id, sec, path, bi, {lines("t")} AS l FROM p2 WHERE n > {_HARD}),
l1 AS (SELECT doc_id, sec, path, bi, unnest(l) AS t, generate_subscripts(l, 1) AS li FROM l0),
piece0 AS (SELECT doc_id, sec, path, bi, 0 AS li, t FROM p2 WHERE n <= {_HARD}
   UNION ALL SELECT doc_id, sec, path, bi, li, {stripped("t")} FROM l1),
piece AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY bi, li) AS p,
   CASE WHEN lag(bi) OVER (PARTITION BY doc_id, sec ORDER BY bi, li) = bi THEN chr(10) ELSE chr(10) || chr(10) END AS glue
   FROM piece0 WHERE t <> ''),
part AS (SELECT doc_id, sec, path, greatest(p, 2) AS p, string_agg(t, chr(10) || chr(10) ORDER BY p) AS t,
   CASE WHEN min(p) = 1 THEN chr(10) || chr(10) ELSE min(glue) END AS glue FROM piece GROUP BY ALL),
unit0 AS (SELECT doc_id, sec, 2 AS p, text AS t, chr(10) || chr(10) AS glue, path, path[:-2] AS above FROM s WHERE n <= {_HARD}
   UNION ALL SELECT doc_id, sec, p, t, glue, path, CASE WHEN p = 2 THEN path[:-2] ELSE path END FROM part),
unit AS MATERIALIZED (SELECT doc_id, t, glue, path, array_to_string(above, chr(10)) AS headers, {tokens("t")} AS n,
   {tokens("array_to_string(above, chr(10))")} AS hn,
   row_number() OVER (PARTITION BY doc_id ORDER BY sec, p) AS pos FROM unit0),
g AS (SELECT doc_id, pos, 0 AS chunk, n + hn AS total FROM unit WHERE pos = 1
   UNION ALL
   SELECT u.doc_id, u.pos, CASE WHEN g.total + u.n > {_SOFT} THEN g.chunk + 1 ELSE g.chunk END,
     CASE WHEN g.total + u.n > {_SOFT} THEN u.n + u.hn ELSE g.total + u.n END
   FROM g JOIN unit u ON u.doc_id = g.doc_id AND u.pos = g.pos + 1),
c AS (SELECT doc_id, chunk, first(headers ORDER BY pos) AS headers, first(len(path) ORDER BY pos) AS depth,
   count(*)::INTEGER AS n_units, max(total)::INTEGER AS token_sum,
   first(CASE WHEN headers = '' THEN '' ELSE headers || chr(10) || chr(10) END || t ORDER BY pos) AS start,
   coalesce(string_agg(CASE WHEN opening THEN '' ELSE glue || t END, '' ORDER BY pos), '') AS more
   FROM (SELECT *, pos = min(pos) OVER (PARTITION BY doc_id, chunk) AS opening FROM g JOIN unit USING (doc_id, pos))
   GROUP BY doc_id, chunk)
SELECT doc_id, chunk::INTEGER AS chunk_index, depth::INTEGER AS depth, n_units,
   {tokens("start || more")}::INTEGER AS token_count, token_sum, md5(headers) AS headers_md5, md5(start || more) AS text_md5 FROM c"""

ORACLES["content_anchor_lines"] = rf"""
WITH l AS (SELECT doc_id, unnest({lines("text")}) AS line, generate_subscripts({lines("text")}, 1) - 1 AS i FROM documents),
f AS (SELECT doc_id, i, regexp_matches(line, '^[A-M]') AS a, regexp_matches(line, '^[N-Z].*,') AS b,
             regexp_matches(line, '[0-9]{{2}}') AS c FROM l),
w AS (SELECT *, min(CASE WHEN b THEN i END) OVER n AS j, max(c::INTEGER) OVER n AS near FROM f
      WINDOW n AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
hit AS (SELECT x.doc_id, min(x.i) AS i FROM w x JOIN w y ON y.doc_id = x.doc_id AND y.i = x.j
        WHERE x.a AND y.near = 1 GROUP BY 1)
SELECT d.doc_id, coalesce(i, 0)::INTEGER AS anchor_line, i IS NOT NULL AS found
FROM documents d LEFT JOIN hit USING (doc_id)"""


ORACLES["content_anchor_rows"] = f"SELECT * FROM ({ORACLES['content_anchor_lines']}) WHERE found"

# The anchor cuts off the table of contents, and the page that it stands on is carried over.
_ANCHORED = f"""
SELECT doc_id, 'CHAPITRE 1' || chr(10) || chr(10) || {cleaned(
    "'1.1 INTRODUCTION' || chr(10) || 'Conformément à l’article 2111-9 du code des transports' || chr(10) || text"
)} AS text FROM documents"""

ORACLES["anchored_row_chunks"] = f"""
SELECT doc_id, chunk AS chunk_index, 2 AS page_start, 2 AS page_end, token_count, token_sum, md5(text) AS text_md5
FROM ({packed(_ANCHORED, "doc_id")})"""

# The tokenizer stand-in of the query: four bytes of UTF-8 a token, rounded up.
ORACLES["model_counted_chunks"] = f"""
SELECT doc_id, chunk AS chunk_index, token_count, token_sum, md5(text) AS text_md5
FROM ({packed("SELECT doc_id, text FROM documents", "doc_id", lambda text: f"((strlen({text}) + 3) // 4)::INTEGER")})"""

_BY_SOURCE = f"""
SELECT source, 'CHAPITRE 1' || chr(10) || chr(10) || {cleaned("body")} AS text FROM (
  SELECT coalesce(source, '-') AS source, string_agg(regexp_replace(text, '\n$', ''), chr(10) ORDER BY doc_id) AS body
  FROM documents WHERE text <> '' GROUP BY ALL)"""

ORACLES["long_section_chunks"] = f"""
SELECT source, chunk AS chunk_index, token_count, token_sum, md5(text) AS text_md5
FROM ({packed(_BY_SOURCE, "source")})"""


def units(source: str, key: str) -> str:
    """Sentence units of ``source`` (key, text): ``key, i, unit``, ``i`` with gaps."""
    return rf"""
SELECT {key}, i, unit FROM (SELECT {key}, i, {squash("piece")} AS unit FROM (
  SELECT {key}, unnest(a) AS piece, generate_subscripts(a, 1) AS i FROM (
    SELECT {key}, regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31) || '|\n+') AS a
    FROM ({source}))))
WHERE length(unit) >= 12 AND NOT regexp_full_match(unit, '[\p{{Nd}}\s./>-]+')"""


ORACLES["sentence_units"] = f"""
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS unit_pos, unit
FROM ({units("SELECT doc_id, text FROM documents", "doc_id")})"""

ORACLES["clean_text"] = rf"""
WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents
           UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations)
SELECT id, length({cleaned("text")})::INTEGER AS n_chars, md5({cleaned("text")}) AS text_md5,
  len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: {stripped("x")} <> ''))::INTEGER AS n_paragraphs,
  len(list_filter(string_split(text, chr(10)), lambda x: {stripped("x")} <> ''))::INTEGER AS n_lines FROM t"""

_DOC_CHUNKS = packed("SELECT doc_id, text FROM documents", "doc_id")

ORACLES["chunk_pack_lines"] = f"""
SELECT doc_id, chunk::INTEGER AS chunk_index, token_count, token_sum, md5(text) AS text_md5 FROM ({_DOC_CHUNKS})"""

ORACLES["chunk_summary"] = f"""
SELECT lang, source, count(*) AS n_chunks, sum(token_count)::BIGINT AS n_tokens
FROM ({_DOC_CHUNKS}) JOIN documents USING (doc_id) GROUP BY lang, source"""

ORACLES["chunk_token_recount"] = f"""
SELECT count(*) AS n_chunks, count(*) FILTER (token_count <> token_sum) AS n_recount_differs,
  count(*) FILTER (token_count > 256) AS n_above_limit, max(token_count) AS largest FROM ({_DOC_CHUNKS})"""

_CHUNKS_PER_DOCUMENT = f"""
SELECT 'd' || doc_id AS document, count(*) AS n_chunks, sum(token_count)::BIGINT AS n_tokens
FROM ({_DOC_CHUNKS}) GROUP BY doc_id"""

ORACLES["chunk_files"] = _CHUNKS_PER_DOCUMENT

# A text file ends with a line break.
ORACLES["discovered_documents"] = "SELECT 'name=_-doc ' || doc_id AS doc_id, md5(text || chr(10)) AS text_md5 FROM documents"
ORACLES["discovered_pages"] = "SELECT (length(text) + 1)::INTEGER AS n_chars, count(*) AS n_files FROM documents GROUP BY ALL"
ORACLES["collection_life"] = """
SELECT true AS created, false AS created_again, 2 * n AS written, 2 * n AS replaced, 0 AS added, n AS opened,
  64 AS dim, true AS dropped, false AS dropped_again FROM (SELECT count(*) AS n FROM embeddings)"""
ORACLES["batch_query_embeddings"] = """
SELECT item_id, length(text)::DOUBLE AS d0, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS d1,
  (length(text) - length(replace(text, ' ', '')))::DOUBLE AS d2 FROM benchmark"""

# A third of the documents has been cut again, into chunks of half the size.
_CUT_AGAIN = packed("SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0", "doc_id", limit=128)

ORACLES["merged_index"] = f"""
SELECT 'd' || doc_id AS document, count(*) AS n_chunks, sum(token_count)::BIGINT AS n_tokens FROM (
  SELECT doc_id, token_count FROM ({_DOC_CHUNKS}) WHERE doc_id % 3 <> 0
  UNION ALL SELECT doc_id, token_count FROM ({_CUT_AGAIN})) GROUP BY doc_id"""

ORACLES["merge_counts"] = f"""
WITH a AS (SELECT doc_id, count(*) AS n FROM ({_DOC_CHUNKS}) GROUP BY 1), b AS (SELECT doc_id, count(*) AS n FROM ({_CUT_AGAIN}) GROUP BY 1)
SELECT 0 AS batch, (SELECT sum(n) FROM a)::BIGINT AS added, 0 AS replaced, 0 AS removed
UNION ALL SELECT 1, sum(greatest(b.n - a.n, 0))::BIGINT, sum(least(a.n, b.n))::BIGINT, sum(greatest(a.n - b.n, 0))::BIGINT FROM a JOIN b USING (doc_id)"""
ORACLES["streamed_index"] = _CHUNKS_PER_DOCUMENT

ORACLES["chunk_ids"] = f"""
SELECT 'doc-a' || doc_id || '_chunk_' || CASE WHEN chunk < 10000 THEN lpad(chunk::VARCHAR, 4, '0') ELSE chunk::VARCHAR END
  AS chunk_id, token_count FROM ({_DOC_CHUNKS})"""

# ---- vectors --------------------------------------------------------------------------


def ranked(scores: str, k: int, score: str, key: str = "query_id") -> str:
    return f"""
SELECT {key}, item_id, {score}, row_number() OVER (PARTITION BY {key} ORDER BY {score} DESC, item_id) AS rank
FROM ({scores}) QUALIFY rank <= {k}"""


_PAIR_SCORES = """
SELECT q.vec_id AS query_id, i.vec_id AS item_id, q.label AS query_label, i.label AS item_label,
  round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) AS similarity
FROM embeddings q, embeddings i"""


def shown(scores: str, score: str, key: str = "query_id") -> str:
    return f"SELECT {key}, item_id, round({score}, 6) AS {score}, rank::INTEGER AS rank FROM ({scores})"


ORACLES["knn_topk"] = shown(ranked(_PAIR_SCORES, 10, "similarity"), "similarity")
ORACLES["vector_index_search"] = ORACLES["knn_topk"]
ORACLES["knn_filtered"] = shown(
    ranked(f"SELECT * FROM ({_PAIR_SCORES}) WHERE query_label = item_label", 5, "similarity"), "similarity"
)

ORACLES["centroid_search"] = shown(
    ranked(
        """
WITH c AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
m AS (SELECT label, d, avg(x) AS x FROM c GROUP BY ALL),
v AS (SELECT label, list(x ORDER BY d) AS vec FROM m GROUP BY label)
SELECT v.label, e.vec_id AS item_id, round(list_cosine_similarity(vec, embedding::DOUBLE[]), 9) AS similarity
FROM v, embeddings e""",
        30,
        "similarity",
        "label",
    ),
    "similarity",
    "label",
)

ORACLES["collection_stats"] = """
WITH n AS (SELECT len(embedding) AS dim, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings)
SELECT count(*) AS n_vectors, min(dim)::INTEGER AS min_dim, max(dim)::INTEGER AS max_dim, round(min(l), 6) AS min_norm,
  round(max(l), 6) AS max_norm, count(*) FILTER (l = 0) AS n_zero FROM n"""

ORACLES["upsert_collection"] = """
SELECT coalesce(l.doc_id, e.vec_id) AS id, coalesce(l.quality + 100, e.label)::INTEGER AS label
FROM embeddings e FULL JOIN labels l ON l.doc_id = e.vec_id"""


def metrics(first: str, questions: str) -> str:
    """``first``: query_id, rank of its first gold item."""
    return f"""
SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS hit_rate,
  round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE / rank ELSE 0.0 END), 6) AS mrr
FROM (SELECT q.query_id, f.rank FROM ({questions}) q LEFT JOIN ({first}) f USING (query_id)),
     (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k"""


_NEIGHBOURS = f"SELECT * FROM ({_PAIR_SCORES}) WHERE query_id <> item_id"
_VECTOR_QUESTIONS = "SELECT vec_id AS query_id FROM embeddings"

ORACLES["retrieval_metrics_dense"] = metrics(
    f"""SELECT query_id, min(rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY similarity DESC, item_id) AS rank FROM ({_NEIGHBOURS})) WHERE rank <= 10 AND query_label = item_label GROUP BY 1""",
    _VECTOR_QUESTIONS,
)

ORACLES["retrieval_metrics_reranked"] = metrics(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS dense
  FROM ({_NEIGHBOURS}) QUALIFY dense <= 30),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY 1.0 / (1.0 + abs(query_label + 1 - item_label)) DESC, dense) AS rank FROM r)
SELECT query_id, min(rank) AS rank FROM s WHERE rank <= 10 AND query_label = item_label GROUP BY 1""",
    _VECTOR_QUESTIONS,
)

# ---- text retrieval -------------------------------------------------------------------

_PASSAGES = "SELECT item_id AS query_id, text FROM benchmark"


def hashed(table: str, key: str) -> str:
    """Unit vectors of hashed token counts as rows ``key, b, x`` in single precision."""
    return rf"""
SELECT {key}, b, (c / sqrt(sum(c * c) OVER (PARTITION BY {key})))::FLOAT AS x FROM (
  SELECT {key}, ('0x' || substr(md5(tok), 1, 8))::UBIGINT % {HASH_DIM} AS b, count(*)::DOUBLE AS c FROM (
    SELECT {key}, unnest(regexp_extract_all(lower(text), '{W}+|[^\s\p{{L}}\p{{N}}_]')) AS tok FROM {table}) GROUP BY ALL)"""


ORACLES["hash_embed"] = f"""
WITH v AS ({hashed("documents", "doc_id")}),
t AS (SELECT doc_id, max(x) AS top, count(*) AS n FROM v GROUP BY doc_id)
SELECT t.doc_id, min(v.b)::INTEGER AS top_bucket, round(max(top)::DOUBLE, 6) AS top_value, max(n)::INTEGER AS n_buckets
FROM t JOIN v ON v.doc_id = t.doc_id AND v.x = t.top GROUP BY t.doc_id"""

_DENSE_TEXT = f"""
WITH d AS MATERIALIZED (SELECT *, sqrt(sum(x::DOUBLE * x::DOUBLE) OVER (PARTITION BY doc_id)) AS l FROM ({hashed("documents", "doc_id")})),
q AS MATERIALIZED (SELECT *, sqrt(sum(x::DOUBLE * x::DOUBLE) OVER (PARTITION BY item_id)) AS l FROM ({hashed("benchmark", "item_id")}))
SELECT q.item_id AS query_id, d.doc_id AS item_id,
  round(sum((q.x::DOUBLE / q.l) * (d.x::DOUBLE / d.l)), 9) AS similarity
FROM q JOIN d USING (b) GROUP BY ALL"""

ORACLES["dense_text_topk"] = shown(ranked(_DENSE_TEXT, 10, "similarity"), "similarity")

_BM25 = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}+')) AS term FROM documents),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
len AS MATERIALIZED (SELECT d.doc_id, coalesce(n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM w GROUP BY 1) USING (doc_id)),
tot AS (SELECT count(*) AS docs, avg(n) AS average FROM len),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{W}+')) AS term FROM benchmark)
SELECT query_id, doc_id AS item_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2
   / (tf + 1.2 * (0.25 + 0.75 * n / average))), 9) AS score
FROM q JOIN p USING (term) JOIN df USING (term) JOIN len USING (doc_id), tot GROUP BY ALL"""

ORACLES["bm25_search"] = shown(ranked(_BM25, 20, "score"), "score")

_FUSED = f"""
SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (
  SELECT query_id, item_id, rank FROM ({ranked(_DENSE_TEXT, 20, "similarity")})
  UNION ALL SELECT query_id, item_id, rank FROM ({ranked(_BM25, 20, "score")})) GROUP BY ALL"""

ORACLES["keyword_index_search"] = ORACLES["bm25_search"]

ORACLES["rrf_hybrid"] = shown(ranked(_FUSED, 5, "score"), "score")


def overlapped(candidates: str, k: int) -> str:
    """Second stage over ``query_id, item_id, rank``: share of the query's words found."""
    return rf"""
WITH c AS MATERIALIZED ({candidates}),
qa AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '{W}+')) AS a FROM benchmark),
da AS (SELECT doc_id AS item_id, regexp_extract_all(lower(text), '{W}+') AS b FROM documents),
s AS (SELECT query_id, item_id, c.rank AS first, len(list_intersect(a, b))::DOUBLE / len(a) AS score
      FROM c JOIN qa USING (query_id) JOIN da USING (item_id))
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM s
QUALIFY rank <= {k}"""


ORACLES["hybrid_reranked"] = shown(overlapped(ranked(_FUSED, 40, "score"), 5), "score")

_GOLD = """
SELECT b.item_id AS query_id, d.doc_id AS item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"""


def passage_metrics(hits: str) -> str:
    return metrics(
        f"SELECT query_id, min(rank) AS rank FROM ({hits}) JOIN ({_GOLD}) USING (query_id, item_id) GROUP BY 1", _PASSAGES
    )


ORACLES["passage_metrics_dense"] = passage_metrics(ranked(_DENSE_TEXT, 10, "similarity"))
ORACLES["passage_metrics_bm25"] = passage_metrics(ranked(_BM25, 10, "score"))
ORACLES["passage_metrics_reranked"] = passage_metrics(
    overlapped(ranked(_DENSE_TEXT, 30, "similarity"), 10)
)

# ---- question sets --------------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CLOSING = " ".join(
    f"WHEN '{lang}' THEN printf({_quoted(pattern[1:])}, doc_id + 10, doc_id % 9 + 1, doc_id % 30 + 1)"
    for lang, pattern in CLOSINGS.items()
)

_CHUNKS = rf"""
SELECT printf('doc_%06d', doc_id) AS chunk_id, lang || '-' || regexp_extract(source, '([0-9]+)$', 1) AS document_id,
  row_number() OVER (PARTITION BY lang || '-' || regexp_extract(source, '([0-9]+)$', 1) ORDER BY doc_id) - 1 AS chunk_index,
  text || CASE WHEN lang IN ('fr', 'en', 'de') THEN chr(10) ELSE '' END || CASE lang {_CLOSING} ELSE '' END AS text
FROM documents"""

_VERBS = "(?:est|sont|désigne|design[eé]|signifie|correspond à|constitue|se définit)"
_ACTIONS = "(?:doit|peut|adresse|transmet|dépose|procédure|étape|demande|organise|coordonne)"
_ROLES = "(?:doit|assure|est|organise|coordonne|responsable|incombe|peut|adresse|reçoit|gère)"
_ACTORS = "(?:SNCF Réseau|ART|candidat|entreprise ferroviaire|gestionnaire d.infrastructure|État|AOT|AOM)"
_LEGAL = (
    r"(?i)(?:article\s+(?:L\.?|R\.?|D\.?|2111-9|8\.1)\s*[\p{L}\p{N}_.-]+(?:\s+du\s+code\s+des\s+transports)?"
    r"|décret\s+n[°º]?\s*[\p{L}\p{N}_.-]+(?:\s+du\s+[^,;.]+)?|loi\s+n[°º]?\s*[\p{L}\p{N}_.-]+(?:\s+du\s+[^,;.]+)?"
    r"|directive\s+(?:européenne\s+)?[\p{L}\p{N}_/.-]+|règlement\s+(?:UE|européen)[\p{L}\p{N}_/() .-]*)"
)
_UNITS = "(?:euros?|ans?|mois|jours?|heures?|minutes?|km|m|trains?|fois|personnes?|pages?)"
# The engine has no look-around: the number is group 1, its right neighbour lies outside.
_NUMBER = (
    rf"(?i)(?:^|{NW})(?:(\p{{Nd}}+(?:[,.]\p{{Nd}}+)?\s*[€%]){W}"
    rf"|(\p{{Nd}}+(?:[,.]\p{{Nd}}+)?\s*{_UNITS})(?:$|{NW})|(J[- ]\p{{Nd}}+)(?:$|{NW})"
    rf"|(\p{{Nd}}{{1,2}}[h:]\p{{Nd}}{{2}})(?:$|{NW})|(\p{{Nd}}{{1,2}}/\p{{Nd}}{{1,2}}/\p{{Nd}}{{2,4}})(?:$|{NW})"
    rf"|(\p{{Nd}}{{4}})(?:$|{NW}))"
)
_NUMBER_FOUND = " || ".join(f"regexp_extract(unit, {_quoted(_NUMBER)}, {g})" for g in range(1, 7))
_TIME = (
    r"(?i)(?:avant le|au plus tard|à compter du|jusqu''au|date limite|délai|horaire|heures? de service"
    r"|J[- ]\p{Nd}+|\p{Nd}{1,2}[h:]\p{Nd}{2}|\p{Nd}{1,2}/\p{Nd}{1,2}/\p{Nd}{2,4})"
)


def _word(alternatives: str, flags: str = "") -> str:
    return f"{flags}(?:^|{NW}){alternatives}(?:$|{NW})"


def _first(kind: str, question: str, test: str, answer: str, order: int) -> str:
    return f"""
SELECT chunk_id, {order} AS rule, '{kind}' AS question_type, {_quoted(question)} AS question, arg_min({answer}, i) AS answer,
  arg_min(unit, i) AS support FROM u WHERE {test} GROUP BY chunk_id"""


_RAW = rf"""
WITH ch AS MATERIALIZED ({_CHUNKS}),
u AS MATERIALIZED (SELECT chunk_id, i, unit, {folded("unit")} AS f, {_NUMBER_FOUND} AS num,
   regexp_extract(unit, '{_TIME}', 0) AS tm, {stripped(f"regexp_extract(unit, '{_TIME}[^,;.]*', 0)")} AS tail
   FROM ({units("SELECT chunk_id, text FROM ch", "chunk_id")})),
raw AS (
SELECT chunk_id, 1 AS rule, 'locational/structural' AS question_type, {_quoted(fixed.QUESTION_STRUCTURE)} AS question,
  {stripped("split_part(text, chr(10), 1)")} AS answer, {stripped("split_part(text, chr(10), 1)")} AS support FROM ch
  WHERE {stripped("split_part(text, chr(10), 1)")} <> ''
UNION ALL {_first("factual/definition", fixed.QUESTION_DEFINITION, f"regexp_matches(f, '{_word(_VERBS)}') AND length(unit) <= 600", "unit", 2)}
UNION ALL {_first("legal reference lookup", fixed.QUESTION_LEGAL, f"regexp_matches(unit, '{_LEGAL}')", f"regexp_replace(regexp_extract(unit, '{_LEGAL}', 0), '^[ ,;:.]+|[ ,;:.]+$', '', 'g')", 3)}
UNION ALL {_first("numeric/quantitative", fixed.QUESTION_QUANTITY, r"num <> '' AND NOT regexp_full_match(num, '\p{Nd}{4}')", "num", 4)}
UNION ALL {_first("temporal/deadline", fixed.QUESTION_DEADLINE, "tm <> ''", "CASE WHEN length(tail) > 180 THEN tm ELSE tail END", 5)}
UNION ALL {_first("procedural", fixed.QUESTION_PROCEDURE, rf"regexp_matches(unit, '^(?:\p{{Nd}}+[°.)]|[a-e][).]|[-–•])\s*') AND regexp_matches(f, '{_word(_ACTIONS)}')", "unit", 6)}
UNION ALL {_first("entity/role", fixed.QUESTION_ROLE, f"regexp_matches(unit, '{_word(_ACTORS, '(?i)')}') AND regexp_matches(f, '{_word(_ROLES)}') AND length(unit) <= 600", "unit", 7)}
UNION ALL SELECT chunk_id, 8, 'factual/definition', {_quoted(fixed.QUESTION_FALLBACK)},
  arg_min(unit, i + CASE WHEN starts_with(unit, 'CHAPITRE ') OR starts_with(unit, 'ANNEXE ') THEN 1000000 ELSE 0 END),
  arg_min(unit, i + CASE WHEN starts_with(unit, 'CHAPITRE ') OR starts_with(unit, 'ANNEXE ') THEN 1000000 ELSE 0 END)
  FROM u GROUP BY chunk_id),
clause AS (SELECT chunk_id, rule, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
  SELECT chunk_id, rule, regexp_split_to_array(support, '\s*[;:]\s*') AS parts FROM raw WHERE length(support) > 600)),
chosen AS (SELECT chunk_id, rule,
  arg_min(part, i) FILTER (contains({folded("part")}, {folded("answer")})) AS with_answer, arg_min(part, i) AS any_part
  FROM clause JOIN raw USING (chunk_id, rule) WHERE length(part) <= 600 GROUP BY ALL),
short AS (SELECT raw.*, CASE WHEN length(support) <= 600 THEN support
    ELSE coalesce({stripped("with_answer")}, {stripped("any_part")}, regexp_replace(left(support, 600), ' [^ ]*$', '')) END AS brief,
    CASE WHEN length(support) <= 600 THEN support
    ELSE coalesce({stripped("any_part")}, regexp_replace(left(support, 600), ' [^ ]*$', '')) END AS brief_any
  FROM raw LEFT JOIN chosen USING (chunk_id, rule)),
final AS (SELECT chunk_id, rule, question_type, question, CASE WHEN rule = 8 THEN brief_any ELSE answer END AS answer,
    CASE WHEN rule = 8 THEN brief_any ELSE brief END AS support FROM short)
"""

_CANDIDATES = f"""
{_RAW}
SELECT final.*, document_id, chunk_index, text,
  (row_number() OVER (PARTITION BY chunk_id ORDER BY rule) - 1)::INTEGER AS slot,
  count(*) OVER (PARTITION BY chunk_id) AS n
FROM final JOIN ch USING (chunk_id) WHERE answer <> ''"""

ORACLES["eval_candidates"] = f"""
SELECT chunk_id, slot, question_type, question, answer, md5(support) AS support_md5 FROM ({_CANDIDATES})"""

_SELECTED = f"""
WITH c AS MATERIALIZED ({_CANDIDATES}),
pick AS (SELECT *, CASE WHEN n > 1 AND chunk_index % 3 <> 0 THEN 1 + chunk_index % (n - 1) ELSE 0 END AS main,
    CASE WHEN n > 2 AND chunk_index % 4 = 0 THEN 2 + chunk_index % (n - 2) END AS extra FROM c),
chosen AS (SELECT *, 0 AS turn FROM pick WHERE slot = main UNION ALL
         SELECT *, 1 AS turn FROM pick WHERE slot = extra AND extra <> main)
SELECT * FROM chosen"""

ORACLES["eval_rotation"] = f"""
SELECT document_id, chunk_index, turn::INTEGER AS slot, question_type, md5(answer) AS answer_md5 FROM ({_SELECTED})"""


def _difficulty(kind: str, text: str) -> str:
    n = f"coalesce(nullif({tokens(text)}, 0), len(regexp_extract_all({text}, '\\S+')))"
    return f"""CASE WHEN {kind} IN ('legal reference lookup', 'temporal/deadline', 'procedural') OR {n} > 700 THEN 'hard'
  WHEN {kind} IN ('numeric/quantitative', 'entity/role') OR {n} > 350 THEN 'medium' ELSE 'easy' END"""


_QUESTIONS = f"""
WITH sel AS MATERIALIZED ({_SELECTED}), ch AS MATERIALIZED ({_CHUNKS}),
placed AS (SELECT *, row_number() OVER (ORDER BY document_id, chunk_index) - 1 AS spot FROM ch),
cnt AS (SELECT count(*) AS items, greatest(1, round_even(count(*) * 0.05::DOUBLE, 0))::BIGINT AS adv FROM sel),
drawn AS (SELECT j, (j * 37 + 11) % (SELECT count(*) FROM ch) AS spot,
  (list_value({", ".join(_quoted(q) for q in fixed.ADVERSARIAL_QUESTIONS)}))[j % 5 + 1] AS base
  FROM (SELECT unnest(range(adv)) AS j FROM cnt)),
named AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY spot, base ORDER BY j) = 1 THEN base
  ELSE left(base, length(base) - 1) || ' (référence ' || j || ') ?' END AS question FROM drawn)
SELECT row_number() OVER (ORDER BY document_id, chunk_index, turn) AS number, question, answer, 'extractive' AS answer_type,
  question_type, document_id, chunk_id, text, support, true AS is_answerable FROM sel
UNION ALL
SELECT items + j + 1, question, 'Information non disponible dans le document', 'unanswerable', 'unanswerable', document_id,
  chunk_id, text, '', false FROM named JOIN placed USING (spot), cnt"""

ORACLES["eval_questions"] = f"""
SELECT printf('eval_%06d', number) AS id, question, md5(answer) AS answer_md5, answer_type, question_type,
  {_difficulty("question_type", "text")} AS difficulty, document_id, split_part(document_id, '-', -1)::INTEGER AS source_year,
  chunk_id, 1 AS page_start, md5(support) AS support_md5, is_answerable, false AS multi_hop FROM ({_QUESTIONS})"""

ORACLES["eval_adversarial"] = f"""
SELECT printf('eval_%06d', number) AS id, question, chunk_id, {_difficulty("question_type", "text")} AS difficulty
FROM ({_QUESTIONS}) WHERE NOT is_answerable"""

ORACLES["eval_difficulty"] = f"""
SELECT question_type, {_difficulty("question_type", "text")} AS difficulty, count(*) AS n_items
FROM ({_QUESTIONS}) GROUP BY ALL"""

ORACLES["eval_grounding_violations"] = f"""
WITH q AS MATERIALIZED ({_QUESTIONS})
SELECT 'answer in chunk' AS rule, count(*) FILTER (is_answerable AND NOT contains({folded("text")}, {folded("answer")})) AS violations FROM q
UNION ALL SELECT 'unique id', count(*) - count(DISTINCT number) FROM q
UNION ALL SELECT 'question and answer not blank', count(*) FILTER (trim(question) = '' OR trim(answer) = '') FROM q
UNION ALL SELECT 'chunk exists', count(*) FROM q WHERE chunk_id NOT IN (SELECT printf('doc_%06d', doc_id) FROM documents)
UNION ALL SELECT 'unique question per chunk', count(*) FROM (SELECT 1 FROM q GROUP BY question, chunk_id HAVING count(*) > 1)
UNION ALL SELECT 'enough answerable items per document', count(*) FROM
  (SELECT 1 FROM q WHERE is_answerable GROUP BY document_id HAVING count(*) < 1)"""

ORACLES["eval_metadata"] = f"""
SELECT document_id, question_type, difficulty, count(*) AS n_items, count(*) FILTER (is_answerable) AS n_answerable
FROM (SELECT *, {_difficulty("question_type", "text")} AS difficulty FROM ({_QUESTIONS}))
GROUP BY GROUPING SETS ((document_id), (question_type), (difficulty), ())"""

ORACLES["eval_document_report"] = f"""
SELECT document_id, count(*) FILTER (is_answerable) AS answerable, count(*) FILTER (NOT is_answerable) AS unanswerable,
  count(*) AS total FROM ({_QUESTIONS}) GROUP BY document_id"""

_KINDS = ", ".join(f"'{k}'" for k in (*fixed.REWRITE_TEMPLATES, "other"))
_TEMPLATES = " ".join(f"WHEN '{k}' THEN {_quoted(t)}" for k, t in fixed.REWRITE_TEMPLATES.items())

ORACLES["topic_rewrite"] = rf"""
WITH r AS (SELECT 'p' || p_partkey AS id, ([{_KINDS}])[p_partkey % 15 + 1] AS question_type,
    p_size || '.' || (p_partkey % 7) || ' ' || p_name AS title FROM part
  UNION ALL SELECT 'n' || n_nationkey, NULL, n_name FROM nation),
a AS (SELECT *, trim(regexp_replace(title, '^(?:[0-9]+\.)+[0-9]*\s*', '')) AS t FROM r),
b AS (SELECT *, CASE WHEN upper(t) = t AND lower(t) <> t THEN lower(t) ELSE lower(t[1]) || t[2:] END AS s FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(s, '^(?:le |la |les |l''|un |une |des |de )') THEN s
    WHEN regexp_matches(s, '^[aeiouyéèêàâ]') THEN 'l''' || s
    WHEN s LIKE '%s' AND s NOT LIKE '%ss' THEN 'les ' || s ELSE 'le ' || s END AS topic FROM b)
SELECT id, question_type, replace(CASE coalesce(question_type, 'factual') {_TEMPLATES}
  ELSE {_quoted(fixed.REWRITE_DEFAULT)} END, '%s', topic) AS question FROM c"""

ORACLES["gold_normalise"] = """
WITH l AS (SELECT 'q' || doc_id AS question, printf('doc_%06d', doc_id) AS c, toxic FROM labels)
SELECT 'list' AS form, question, c || ',' || c || 'b' AS gold FROM l
UNION ALL SELECT 'single', question, c FROM l
UNION ALL SELECT 'curated', question, CASE WHEN toxic = 1 THEN c || ',x' ELSE c END FROM l"""

ORACLES["label_quality_join"] = """
SELECT lang, 'inner' AS kind, count(*) AS n_labelled, sum(quality)::BIGINT AS n_good
  FROM documents JOIN labels USING (doc_id) GROUP BY lang
UNION ALL SELECT lang, 'semi', count(*), count(*) FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang
UNION ALL SELECT lang, 'anti', count(*), 0 FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang"""

# ---- files written and read back -------------------------------------------------------

ORACLES["page_text_table"] = f"""
SELECT doc_id, page_no, count(*) AS n_blocks, sum(length(CASE WHEN label = 'table' THEN '### [TABLE]' || chr(10) || chr(10) || text
  WHEN label IN ('title', 'section_header') THEN '## [' || label || '] ' || text ELSE '[' || label || '] ' || text END))::BIGINT AS n_chars
FROM ({ITEMS}) GROUP BY ALL"""

ORACLES["document_files"] = rf"""
WITH l AS (SELECT doc_id, unnest({lines("text")}) AS line FROM ({ASSEMBLED}))
SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM l GROUP BY ALL"""

ORACLES["sized_files"] = f"SELECT * FROM ({ORACLES['document_files']}) WHERE doc_id % 7 = 0"

ORACLES["index_files"] = f"""
SELECT doc_id, 1::BIGINT AS n_heads, count(*) AS n_pages FROM ({STATS}) GROUP BY ALL"""

ORACLES["statistics_csv"] = ORACLES["token_counts"]

_LABELLED = """
SELECT 'q' || doc_id AS id, doc_id, CASE WHEN toxic = 1 THEN 'legal_reference' END AS question_type FROM labels"""

ORACLES["question_files"] = f"""
SELECT id, 'Que dit la partie « Doc ' || doc_id || ' » ?' AS question, question_type, printf('doc_%06d', doc_id) AS gold
FROM ({_LABELLED})"""

ORACLES["rewritten_files"] = f"""
SELECT id, replace(CASE coalesce(question_type, 'factual') {_TEMPLATES} ELSE {_quoted(fixed.REWRITE_DEFAULT)} END,
  '%s', 'le doc ' || doc_id) AS question FROM ({_LABELLED})"""

ORACLES["label_cosine"] = """
WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM v GROUP BY ALL)
SELECT vec_id AS item_id, round(sum(x * m) / nullif(sqrt(sum(x * x)) * sqrt(sum(m * m)), 0), 6) AS similarity
FROM v JOIN m USING (label, i) GROUP BY vec_id"""


def rescored(score: str) -> str:
    """The dense candidates in the order of a score over query text ``q`` and item text ``t``."""
    return f"""
WITH c AS MATERIALIZED ({ranked(_DENSE_TEXT, 10, "similarity")}),
s AS (SELECT query_id, c.item_id, c.rank AS first, {score} AS score FROM c
  JOIN (SELECT item_id AS query_id, length(text) AS q FROM benchmark) USING (query_id)
  JOIN (SELECT doc_id AS item_id, length(text) AS t FROM documents) USING (item_id))
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM s
QUALIFY rank <= 5"""


_FRAME = len(fixed.RERANK_PROMPT % (fixed.RERANK_TASK, "", ""))

ORACLES["yes_no_reranked"] = shown(
    rescored(f"1 / (1 + exp((({_FRAME} + q + t) % 7 - ({_FRAME} + q + t) % 11)::DOUBLE))"), "score"
)
ORACLES["cross_encoder_reranked"] = shown(rescored("1 / (1 + exp(-((7 * q + t) % 13 - 6)::DOUBLE))"), "score")

# ---- inputs set aside ------------------------------------------------------------------

_JUDGED = """
SELECT page_id, CASE WHEN html IS NULL THEN 'missing' WHEN trim(html) = '' THEN 'blank'
  WHEN contains(html, chr(65533)) THEN 'undecodable'
  WHEN lower(right(rtrim(html), 7)) <> '</html>' THEN 'truncated' END AS reason FROM pages"""

ORACLES["quarantined_pages"] = f"SELECT page_id, reason FROM ({_JUDGED}) WHERE reason IS NOT NULL"

ORACLES["quarantine_counts"] = f"""
SELECT reason, count(*) AS n, min(page_id) AS first_name FROM ({_JUDGED}) GROUP BY reason"""
