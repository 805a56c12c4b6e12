"""The SQL that the catalogue's queries are checked against, written apart from them, in DuckDB's dialect."""

from __future__ import annotations

from marginalia.functions import lists
from marginalia.operators.citations import PARTS, TAGS


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_quoted, items)) + "]"


def tok(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def words(x: str) -> str:
    return rf"[w for w in regexp_split_to_array({x}, '\s+') if w <> '']"


def first_words(x: str, n: int) -> str:
    return f"array_to_string(({words(x)})[1:{n}], ' ')"


def stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squashed(x: str) -> str:
    return stripped(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def estimate(x: str) -> str:
    return f"(len({words(x)}) * 1.3::DOUBLE)"


def any_match(x: str, patterns, any_case: bool = False) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {_quoted(('(?i)' if any_case else '') + p)})" for p in patterns) + ")"


def holds(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {_quoted(p)})" for p in parts) + ")"


def jaccard(a: str, b: str) -> str:
    x, y = words(f"lower({a})"), words(f"lower({b})")
    return f"coalesce(len(list_intersect({x}, {y})) / nullif(len(list_distinct(list_concat({x}, {y}))), 0), 0)::DOUBLE"


CHUNKS = """chunks AS (SELECT lang AS collection, source AS pdf_filename, 'c' || doc_id AS chunk_id, doc_id, doc_id // 20 AS seq, text AS content, (doc_id // 20) % 50 + 1 AS page_number,
  CASE WHEN (doc_id // 20) % 5 = 0 THEN 'parent' ELSE 'child' END AS chunk_type, 'Section ' || (((doc_id // 20) % 50 + 1) // 10) AS toc_title, greatest(1, (((doc_id // 20) % 50 + 1) // 10) * 10) AS corrected_toc_page,
  e.embedding::DOUBLE[] AS embedding FROM documents LEFT JOIN embeddings e ON vec_id = doc_id)"""
QUERIES = f"""qtext AS (SELECT item_id AS query_id, {first_words("text", 3)} AS query FROM benchmark),
queries AS (SELECT query_id, query, embedding::DOUBLE[] AS vector FROM qtext JOIN embeddings ON vec_id = query_id)"""
TURNS = """turns AS (SELECT 'c' || (u.conv_id % 5) AS collection, u.conv_id, u.turn, u.text AS user_message, a.text AS assistant_response
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""
BLOCKS = """lines AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents),
blocks AS (SELECT source AS pdf_filename, doc_id, i - 1 AS line, l[i] AS content, (doc_id // 20) % 50 + 1 AS page_number, 72.0::DOUBLE + (i - 1) * 12.0::DOUBLE AS y0 FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM lines))"""
TOC = """toc AS (SELECT pdf_filename, toc_title || ' ' || substr(content, 1, 40) AS title, page_number, length(toc_title) % 3 + 1 AS level, doc_id AS ord
  FROM (SELECT *, row_number() OVER (PARTITION BY pdf_filename, toc_title ORDER BY page_number, doc_id) AS rn FROM chunks) WHERE rn = 1)"""
DIST = "list_sum([x * x for x in [c.embedding[i] - q.vector[i] for i in generate_series(1, 64)]])"


def knn(name: str, k: int, where: str = "true", by: str = "", digits: int = 6) -> str:
    distance = f"round({DIST}, {digits})"
    p = f", c.{by}" if by else ""
    return f"""{name} AS (SELECT * FROM (SELECT q.query_id{p}, c.chunk_id, {distance} AS distance, row_number() OVER (PARTITION BY q.query_id{p} ORDER BY {distance}, c.chunk_id) AS rank
  FROM chunks c, queries q WHERE c.embedding IS NOT NULL AND ({where})) WHERE rank <= {k})"""


def bm25(name: str, k: int) -> str:
    return f"""bt AS (SELECT chunk_id, {tok("content")} AS t FROM chunks), bn AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS mean_length FROM bt),
bp AS (SELECT chunk_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT chunk_id, len(t) AS len, unnest(t) AS term FROM bt) GROUP BY ALL),
bw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*)::DOUBLE AS df FROM bp GROUP BY term), bn),
bi AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM bw) ELSE raw END AS idf FROM bw),
bq AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tok("query")}) AS term FROM qtext) GROUP BY ALL),
bs AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_length))), 6) AS score FROM bp JOIN bi USING (term) JOIN bq USING (term), bn GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bs WHERE score > 0) WHERE rank <= {k})"""


def keywords(x: str, mode: str) -> str:
    stop = _list(lists.QUERY_STOP_WORDS)
    inner = f"list_concat(CASE WHEN len({words(stripped(x))}) > 1 THEN [{stripped(x)}] ELSE [] END"
    if mode == "intended":
        inner = f"list_concat({inner}, [w for w in {tok(stripped(x))} if NOT list_contains({stop}, w) AND length(w) > 4])"
    inner = inner + f""", regexp_extract_all({stripped(x)}, '"([^"]*)"', 1))"""
    return f"[k for k in {inner} if regexp_matches(k, '\\S\\s+\\S') OR (length(k) > 4 AND NOT list_contains({stop}, lower(k)))]"


def keyword_search(name: str, mode: str, where: str = "chunk_type = 'child'") -> str:
    return f"""kq AS (SELECT query_id, list_distinct_keep(k) AS k FROM (SELECT query_id, {keywords("query", mode)} AS k FROM qtext)),
kw AS (SELECT query_id, unnest(k) AS kw, generate_subscripts(k, 1) - 1 AS i FROM kq),
kh AS (SELECT query_id, chunk_id, i, kw, content, ((length(lower(content)) - length(replace(lower(content), lower(kw), ''))) // length(kw)) AS n FROM kw JOIN chunks ON contains(lower(content), lower(kw)) WHERE {where}),
{name} AS (SELECT *, least(keyword_score, 1.0) AS similarity FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (i + 1) * CASE WHEN regexp_matches(kw, '\\S\\s+\\S') THEN 3.0::DOUBLE WHEN list_contains({_list(lists.SCORING_STOP_WORDS)}, lower(kw)) THEN 0.1::DOUBLE WHEN length(kw) <= 4 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN contains(content, kw) THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN n <= 2 THEN 1.5::DOUBLE WHEN n > 20 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * n ORDER BY i), 6) AS keyword_score, string_agg(kw, '|' ORDER BY i) AS matched_keywords FROM kh GROUP BY query_id, chunk_id))""".replace("list_distinct_keep(k)", "[y for y, j in k if list_position(k, y) = j]")


def hybrid(name: str, n: int, where: str, extra: str = "chunk_type = 'child'") -> str:
    return f"""{knn(name + "_s", 2 * n, f"c.chunk_type = 'child' AND ({where})", digits=10)},
{keyword_search(name + "_k", "observed", f"{extra} AND ({where})").replace("kq AS", name + "_kq AS").replace("kw AS (", name + "_kw AS (").replace("FROM kq)", f"FROM {name}_kq)").replace("kh AS (", name + "_kh AS (").replace("FROM kw JOIN", f"FROM {name}_kw AS kw JOIN").replace("FROM kh GROUP", f"FROM {name}_kh GROUP")},
{name}_m AS (SELECT query_id, chunk_id, CASE WHEN s.distance IS NOT NULL THEN round(greatest(0.0, (2.0 - s.distance) / 2.0), 6) END AS semantic, k.similarity, coalesce(s.rank, 1073741824) AS place FROM {name}_s s FULL JOIN {name}_k k USING (query_id, chunk_id)),
{name}_o AS (SELECT query_id, chunk_id, round(CASE WHEN semantic IS NULL THEN similarity WHEN similarity IS NULL THEN semantic ELSE least(1.0, semantic + 0.1) END, 6) AS score, CASE WHEN semantic IS NULL THEN 'keyword_match' ELSE 'semantic' END AS source_type,
  semantic IS NOT NULL AND similarity IS NOT NULL AS keyword_boost, place FROM {name}_m),
{name} AS (SELECT * EXCLUDE place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, chunk_id) AS rank FROM {name}_o) WHERE rank <= {n})"""


def fused(legs: list[tuple[str, float]], k: int) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, chunk_id, {w}::DOUBLE / (60 + rank) AS part FROM {name}" for name, w in legs)
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(part), 8) AS score FROM ({union}) GROUP BY ALL)) WHERE rank <= {k}"


def top(name: str, of: str, k: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, chunk_id) AS rank FROM {of}) WHERE rank <= {k})"


def heading(t: str, more: str = "1") -> str:
    n = f"len({words(t)})"
    upper = rf"(regexp_matches({t}, '\p{{Lu}}') AND NOT regexp_matches({t}, '\p{{Ll}}'))"
    title = rf"(regexp_matches({t}, '\p{{Lu}}') AND NOT regexp_matches({t}, '(^|[^\p{{L}}])\p{{Ll}}') AND NOT regexp_matches({t}, '\p{{L}}\p{{Lu}}'))"
    points = f"((NOT ends_with({t}, '.'))::INT + ({n} BETWEEN 3 AND 10)::INT + ({n} >= 2)::INT + (({title} OR {upper}) AND length({t}) > 10)::INT + {more})"
    strong = f"({any_match(t, lists.HEADING_STRONG_CASED)} OR {any_match(t, lists.HEADING_STRONG, True)})"
    return f"(length({t}) <= 100 AND NOT {any_match(t, lists.HEADING_NEGATIVE, True)} AND ({strong} OR {points} >= 5))"


def block_type(x: str) -> str:
    t = stripped(x)
    return f"CASE WHEN {heading(t)} THEN 'heading' WHEN {any_match(t, lists.LIST_ITEM)} THEN 'list' ELSE 'paragraph' END"


RANGES = "ranges AS (SELECT t.pdf_filename, t.title, t.page_number AS start_page, coalesce((SELECT min(u.page_number) FROM toc u WHERE u.pdf_filename = t.pdf_filename AND u.page_number > t.page_number) - 1, t.page_number + 10) AS end_page FROM toc t)"
HEADED = BLOCKS.replace("l[i] AS content", "CASE WHEN i = 1 AND doc_id % 10 < 8 THEN CASE WHEN doc_id % 2 = 0 THEN 'The  Report of ' || source ELSE ' the report OF ' || source END ELSE l[i] END AS content")
RUNNING = f"""pagecount AS (SELECT pdf_filename, count(DISTINCT page_number) AS pages FROM blocks GROUP BY 1 HAVING count(DISTINCT page_number) >= 2),
near AS (SELECT pdf_filename, CASE WHEN y0 < 118.8 THEN 'header' WHEN y0 > 673.2 THEN 'footer' END AS band, (round_even(y0 / 5.0, 0) * 5)::BIGINT AS y_band, {stripped("content")} AS raw FROM blocks),
running AS (SELECT r.* EXCLUDE pages FROM (SELECT pdf_filename, band, y_band, lower({squashed("raw")}) AS text, count(*) AS seen, any_value(pages) AS pages FROM near JOIN pagecount USING (pdf_filename) WHERE band IS NOT NULL AND length(raw) >= 3 GROUP BY 1, 2, 3, 4) r WHERE seen >= greatest(2, floor(pages * 0.6)))"""
ASOF = """cand AS (SELECT b.pdf_filename, b.rid, b.page_number, t.title, t.level, t.ord, t.page_number AS tp, max(t.page_number) OVER (PARTITION BY b.rid) AS best FROM rows b JOIN toc t ON t.pdf_filename = b.pdf_filename AND t.page_number <= b.page_number),
earlier AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY tp DESC, ord DESC) AS rn FROM cand WHERE best = page_number AND tp < best),
pick AS (SELECT rid, title, level, best, row_number() OVER (PARTITION BY rid ORDER BY level, older DESC, ord) AS rn FROM (SELECT rid, title, level, best, ord, 0 AS older FROM cand WHERE tp = best UNION ALL SELECT rid, title, level, best, ord, 1 FROM earlier WHERE rn = 1)),
linked AS (SELECT r.rid, p.title AS toc_title, p.level AS toc_level, p.best AS toc_page FROM rows r LEFT JOIN pick p ON p.rid = r.rid AND p.rn = 1)"""
SENTENCES = rf"[s for s in [{stripped('x')} for x in regexp_split_to_array(content, '[.!?]+')] if s <> '']"
FOLD = f"""RECURSIVE docs AS (SELECT doc_id, {SENTENCES} AS s FROM chunks), toks AS (SELECT doc_id, s, [{estimate("x")} for x in s] AS t FROM docs WHERE len(s) > 0),
fold AS (SELECT doc_id, 1 AS pos, 0 AS chunk, t[1] AS total FROM toks UNION ALL
  SELECT f.doc_id, f.pos + 1, chunk + (total + t[f.pos + 1] > 350 AND total >= 180)::INT, CASE WHEN total + t[f.pos + 1] > 350 AND total >= 180 THEN t[f.pos + 1] ELSE total + t[f.pos + 1] END FROM fold f JOIN toks k ON k.doc_id = f.doc_id WHERE f.pos < len(t)),
kids AS (SELECT * FROM (SELECT f.doc_id, chunk, string_agg(s[pos], ' ' ORDER BY pos) AS content, round(sum(t[pos] ORDER BY pos), 4) AS token_count, max(chunk) OVER (PARTITION BY f.doc_id) AS last FROM fold f JOIN toks k ON k.doc_id = f.doc_id GROUP BY f.doc_id, chunk) WHERE chunk < last OR token_count >= 50)"""
FILES = """files AS (SELECT lang AS collection, 'f' || doc_id || '.pdf' AS pdf_filename, doc_id FROM documents),
ledger AS (SELECT CASE WHEN f.doc_id % 7 = 0 THEN 'old' ELSE collection END AS collection, pdf_filename FROM files f JOIN labels l ON l.doc_id = f.doc_id)"""
_FIRST = first_words("regexp_replace(content, '[\"''<>]', '', 'g')", 6)
_Q = "(CASE WHEN doc_id % 2 = 0 THEN '\"' ELSE '''' END)"
NUMBERED = f"""{FOLD.replace('RECURSIVE docs', f'RECURSIVE {CHUNKS}, docs')}, nk AS (SELECT pdf_filename, k.doc_id AS section, chunk AS chunk_index, toc_title AS section_title, k.content, token_count, page_number, 'child_' || substr(pdf_filename, 1, 20) || '_' || row_number() OVER (PARTITION BY pdf_filename ORDER BY k.doc_id, chunk) AS chunk_id FROM kids k JOIN chunks USING (doc_id)),
kt AS (SELECT section, list(token_count ORDER BY chunk_index) AS t, list(chunk_id ORDER BY chunk_index) AS c FROM nk GROUP BY 1),
pf AS (SELECT section, 1 AS pos, 0 AS parent, t[1] AS total FROM kt UNION ALL SELECT f.section, f.pos + 1, parent + (total + t[f.pos + 1] > 1600 AND total >= 800)::INT, CASE WHEN total + t[f.pos + 1] > 1600 AND total >= 800 THEN t[f.pos + 1] ELSE total + t[f.pos + 1] END FROM pf f JOIN kt k ON k.section = f.section WHERE f.pos < len(t)),
held AS (SELECT nk.*, parent FROM pf JOIN kt USING (section) JOIN nk ON nk.section = pf.section AND nk.chunk_id = c[pos]),
np AS (SELECT *, 'parent_' || substr(pdf_filename, 1, 20) || '_' || row_number() OVER (PARTITION BY pdf_filename ORDER BY section, chunk_index) AS chunk_id FROM (SELECT pdf_filename, section, parent AS chunk_index, any_value(section_title) AS section_title, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS content, round(sum(token_count ORDER BY chunk_index), 4) AS token_count, min(page_number) AS page_number, string_agg(DISTINCT page_number::VARCHAR, ',') AS page_numbers, string_agg(chunk_id, ',' ORDER BY chunk_index) AS child_ids FROM held GROUP BY pdf_filename, section, parent))"""
ANSWERS = f"answers AS (SELECT doc_id AS answer_id, 'As stated <citation pdf_name=' || {_Q} || pdf_filename || {_Q} || ' page_number=' || {_Q} || page_number || {_Q} || ' chunk_id=' || {_Q} || chunk_id || {_Q} || ' cited_text=' || {_Q} || {_FIRST} || {_Q} || '> here.' AS answer FROM chunks)"
CITED = "cited AS (" + " UNION ALL ".join("SELECT answer_id, " + ", ".join(f"unnest(regexp_extract_all(answer, {_quoted(tag)}, {k})) AS {name}" for k, name in enumerate(PARTS, 1)) + " FROM answers" for tag in TAGS) + ")"
_PIPES = "[string_split(r, '|') for r in string_split(content, chr(10)) if contains(r, '|')]"
GRIDS = rf"""g0 AS (SELECT doc_id, {_PIPES} AS g FROM chunks WHERE contains(content, '|')), g1 AS (SELECT doc_id, g, list_max([len(r) for r in g]) AS w FROM g0),
g2 AS (SELECT doc_id, w, [[{squashed("coalesce(r[i], '')")} for i in generate_series(1, w)] for r in g] AS g FROM g1), g3 AS (SELECT doc_id, w, [r for r in g if array_to_string(r, '') <> ''] AS g FROM g2),
g4 AS (SELECT doc_id, g, [i for i in generate_series(1, w) if array_to_string([r[i] for r in g], '') <> ''] AS u FROM g3), grids AS (SELECT doc_id, [[r[i] for i in u] for r in g] AS g FROM g4)"""


def normal(x: str) -> str:
    return squashed(f"lower({x})")


def bare(x: str) -> str:
    return squashed(rf"regexp_replace(lower({x}), '[^A-Za-z0-9_\s]', '', 'g')")


def _seen(x: str) -> str:
    """White space, quotes and dashes alike, special marks dropped."""
    spaced = rf"regexp_replace({x}, '\s+', ' ', 'g')"
    alike = f"translate({spaced}, {chr(39) * 4} || chr(8211) || chr(8212), '{chr(34)}--')"
    return rf"trim(lower(regexp_replace({alike}, '[^A-Za-z0-9_\s\-{chr(34)}.,;:!?()\[\]]', '', 'g')), ' ')"


def _plain(x: str, least: int = 1) -> str:
    return f"regexp_extract_all({x}, '[A-Za-z0-9_]{{{least},}}')"


def locate() -> str:
    split = r"regexp_split_to_array(cited_text, '\s+')"
    heads = ", ".join(f"CASE WHEN len({split}) >= {n} THEN {_seen(f'array_to_string({split}[1:{n}], {chr(39)} {chr(39)})')} END AS h{n}" for n in (15, 10, 7, 5))
    long = f"array_to_string({_plain('cited_text', 3)}[1:5], ' ')"
    forms = f"forms AS (SELECT *, {_seen('cited_text')} AS n, lower(array_to_string({_plain('cited_text')}, ' ')) AS w, {heads}, CASE WHEN length({long}) >= 10 THEN {_seen(long)} END AS l FROM cited WHERE length(cited_text) >= 5)"
    seen = f"seen AS (SELECT pdf_filename, page_number, content, {_seen('content')} AS cn, lower(array_to_string({_plain('content')}, ' ')) AS cw FROM chunks)"
    way = "CASE WHEN contains(content, cited_text) THEN 1 WHEN contains(cn, n) THEN 2 WHEN length(w) >= 10 AND contains(cw, w) THEN 3 WHEN contains(cn, h15) THEN 4 WHEN contains(cn, h10) THEN 5 WHEN contains(cn, h7) THEN 6 WHEN contains(cn, h5) THEN 7 WHEN contains(cn, l) THEN 8 END"
    return f"""WITH {CHUNKS}, {ANSWERS}, {CITED}, {forms}, {seen}, tried AS (SELECT answer_id, pdf_name, c.chunk_id, c.page_number::BIGINT AS page_number, p.page_number AS found_page, {way} AS strategy FROM forms c JOIN seen p ON p.pdf_filename = c.pdf_name AND abs(p.page_number - c.page_number::BIGINT) <= 1)
SELECT answer_id, pdf_name, chunk_id, page_number, found_page, strategy FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, pdf_name, page_number, chunk_id ORDER BY found_page, strategy) AS rn FROM tried WHERE strategy IS NOT NULL) WHERE rn = 1"""


_TURN = estimate("user_message || assistant_response")
_LEX = f"{CHUNKS}, {QUERIES}, {knn('d', 50)}, {bm25('s', 50)}"
_REQUEST = f"CASE WHEN {holds('lower(user_message)', lists.TABLE_REQUEST)} THEN 'table' WHEN {holds('lower(user_message)', lists.FIGURE_REQUEST)} THEN 'figure' WHEN {holds('lower(user_message)', lists.PARENT_REQUEST)} THEN 'parent' END"
_CLASS = f"CASE WHEN {holds('lower(user_message)', lists.VISUAL_QUESTION)} THEN 'visual' WHEN {holds('lower(user_message)', lists.COMPLEX_QUESTION)} THEN 'complex' WHEN {holds('lower(user_message)', lists.SIMPLE_QUESTION)} THEN 'simple' ELSE 'medium' END"
_KIND = f"CASE WHEN contains(lower(toc_title), 'table') THEN 'table' WHEN contains(lower(toc_title), 'fig') THEN 'figure' WHEN len([r for r in string_split(content, chr(10)) if contains(r, '|')]) >= 2 THEN 'table' WHEN {holds('lower(content)', lists.FIGURE_CONTENT)} THEN 'figure' ELSE 'text' END"


def table_text(x: str) -> str:
    cells = rf"regexp_replace(array_to_string([{stripped('c')} FOR c IN string_split(r, '|')], '|'), '^\|+|\|+$', '', 'g')"
    lines = f"[v FOR v IN [CASE WHEN NOT contains(r, '|') THEN {stripped('r')} WHEN {cells} = '' THEN '' ELSE '| ' || replace({cells}, '|', ' | ') || ' |' END FOR r IN string_split({x}, chr(10))] IF v <> '']"
    filled = "len([c FOR c IN string_split(l[1], '|') IF trim(c) <> ''])"
    rule = f"'| ' || array_to_string(list_resize(['---'], greatest({filled} - 2, 0), '---'), ' | ') || ' |'"
    ruled = f"CASE WHEN len(l) >= 2 AND contains(l[1], '|') AND contains(l[2], '|') THEN l[1:1] || [{rule}] || l[2:] ELSE l END"
    return f"CASE WHEN contains({x}, '|') THEN array_to_string([{ruled} FOR l IN [{lines}]][1], chr(10)) ELSE {x} END"


def boxes(name: str, x: int, y: int, left: int, top: int, wide: int, least: int, high: int) -> str:
    return f"""{name} AS (SELECT source AS pdf_filename, doc_id // 20 % 5 + 1 AS page_number, doc_id, coalesce(length(text), 0) AS n, ({left} + doc_id * {x} % 320)::DOUBLE AS x0, ({top} + doc_id * {y} % 600)::DOUBLE AS y0,
  x0 + {least} + coalesce(length(text), 0) % {wide} AS x1, y0 + {high} AS y1 FROM documents)"""


def _near(p: str, q: str) -> str:
    return f"least(abs(a.{p} - b.{q}), abs(a.{q} - b.{p}), abs(a.{p} - b.{p}), abs(a.{q} - b.{q})) <= 10"


_HELD = "len([w FOR w IN t.w IF contains(s.low, w)])"
_KEYS = "[w FOR w IN t.w[1:3] IF length(w) > 3]"

def normalised(x: str) -> str:
    x = rf"regexp_replace({x}, '\s+', ' ', 'g')"
    for pattern, plain in (("[" + '"' + "'']", '"'), ("[–—]", "-"), (r"[^A-Za-z0-9_\s\-" + '"' + r".,;:!?()\[\]]", "")):
        x = f"regexp_replace({x}, '{pattern}', '{plain}', 'g')"
    return stripped(f"lower({x})")


def _hits(mode: str, form, around: int) -> str:
    return f"""SELECT query_id, '{mode}' AS mode, page_number, place, ord FROM (SELECT query_id, w.pdf_filename, page_number, strpos({form('page_text')}, {form('w.text')}) - 1 AS place, length({form('w.text')}) AS n, length(page_text) AS long
  FROM w JOIN pg ON pg.pdf_filename = w.pdf_filename AND abs(pg.page_number - w.target) <= 1 WHERE {form('w.text')} <> '' AND regexp_matches({form('w.text')}, '[^ ]')) f JOIN placed USING (pdf_filename, page_number)
  WHERE place >= 0 AND first <= CASE WHEN {around} > 0 THEN least(place + n + {around}, long) ELSE place + n END AND first + length(t) >= greatest(place - {around}, 0)"""


SPANS = f"""sl AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), sw AS (SELECT doc_id, i, {words("l[i]")} AS w FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM sl)),
su AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS u, array_to_string(w[k + 1:k + 12], ' ') AS content FROM (SELECT *, unnest(generate_series(0, greatest(len(w) - 1, 0), 12)) AS k FROM sw)),
spans AS (SELECT doc_id::VARCHAR AS pdf_filename, u // 80 + 1 AS page_number, u AS ord, content, 50.0::DOUBLE + u // 40 % 2 * 300 + u % 3 * 4 AS x0, 72.0::DOUBLE + u % 40 * 14 + u % 40 // 5 * (doc_id % 2 * 12) AS y0, x0 + 200 AS x1, y0 + 10 AS y1,
  'F' || (u * u % 5) AS font_name, CASE WHEN u % 40 >= 36 THEN 8.0 WHEN u % 11 = 0 THEN 15.0 ELSE 12.0 END::DOUBLE AS font_size, u % 9 = 0 AS bold FROM su)"""
_CONTINUES = r"(NOT regexp_matches(f.text, '[.!?:;]$') OR NOT regexp_matches(n.text, '^[A-Z]') OR (len([w for w in regexp_split_to_array(n.text, '\s+') if w <> '']) <= 8 AND length(n.text) < 50))"
_BEGINS = r"((regexp_matches(n.text, '^\p{Lu}') AND length(n.text) > 20) OR regexp_matches(n.text, '^(\p{Nd}+\.|[A-Z][a-z]+:|[•*-])'))"
_NOTE_LINE = r"regexp_matches(n.text, '^(\p{Nd}+[\s.]|[*†‡§¶]|[ivxlcdmIVXLCDM]+[\s.])')"


SQL: dict[str, str] = {
    "span_paragraphs": rf"""WITH RECURSIVE {SPANS}, pg AS (SELECT pdf_filename, page_number, max(y1) - (max(y1) - min(y0)) * 0.2::DOUBLE AS low FROM spans GROUP BY ALL),
deep AS (SELECT pdf_filename, page_number, count(*) AS n FROM spans JOIN pg USING (pdf_filename, page_number) WHERE y0 > low GROUP BY ALL),
noted AS (SELECT s.*, y0 > low AND font_size < 10 AND (d.n > 1 OR regexp_matches({stripped('content')}, '^(\p{{Nd}}+[\s.]|[*†‡])')) AS note FROM spans s JOIN pg USING (pdf_filename, page_number) LEFT JOIN deep d USING (pdf_filename, page_number)),
xs AS (SELECT pdf_filename, page_number, x0, count(*) AS n FROM noted WHERE NOT note GROUP BY ALL),
cuts AS (SELECT a.pdf_filename, a.page_number, max(b.x0) AS l, a.x0 AS r FROM xs a JOIN xs b ON a.pdf_filename = b.pdf_filename AND a.page_number = b.page_number AND b.x0 < a.x0 GROUP BY ALL HAVING a.x0 - max(b.x0) > 30),
walls AS (SELECT c.* FROM cuts c WHERE (SELECT sum(n) FROM xs WHERE xs.pdf_filename = c.pdf_filename AND xs.page_number = c.page_number AND xs.x0 > (c.l + c.r) / 2) > 3),
parted AS (SELECT n.*, CASE WHEN note THEN 0 ELSE (SELECT count(*) FROM walls w WHERE w.pdf_filename = n.pdf_filename AND w.page_number = n.page_number AND n.x0 > (w.l + w.r) / 2) END AS col FROM noted n),
lined AS (SELECT *, sum(step) OVER (PARTITION BY pdf_filename, page_number, note, col ORDER BY y0, x0, ord ROWS UNBOUNDED PRECEDING) AS line, row_number() OVER (PARTITION BY pdf_filename, page_number, note, col ORDER BY y0, x0, ord) AS pos
  FROM (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY pdf_filename, page_number, note, col ORDER BY y0, x0, ord) > 5 THEN 1 ELSE 0 END AS step FROM parted)),
lns AS (SELECT *, row_number() OVER (PARTITION BY pdf_filename, page_number, note, col ORDER BY line) AS k FROM (SELECT pdf_filename, page_number, note, col, line, {stripped("string_agg(content, ' ' ORDER BY pos)")} AS text, min(y0) AS top, max(y1) AS bottom FROM lined GROUP BY ALL) WHERE text <> ''),
fold AS (SELECT pdf_filename, page_number, note, col, line, k, text, bottom, 1 AS par FROM lns WHERE k = 1 UNION ALL
  SELECT n.pdf_filename, n.page_number, n.note, n.col, n.line, n.k, n.text, n.bottom, f.par + (n.top - f.bottom > 15 OR ({_BEGINS} AND NOT {_CONTINUES}) OR {_NOTE_LINE})::INT FROM fold f JOIN lns n ON n.pdf_filename = f.pdf_filename AND n.page_number = f.page_number AND n.note = f.note AND n.col = f.col AND n.k = f.k + 1),
pt AS (SELECT pdf_filename, page_number, note, col, par, string_agg(text, ' ' ORDER BY k) AS content, count(*) AS line_count FROM fold GROUP BY ALL HAVING length(string_agg(text, ' ' ORDER BY k)) >= 3),
sp AS (SELECT l.*, par FROM lined l JOIN fold USING (pdf_filename, page_number, note, col, line)),
fonts AS (SELECT pdf_filename, page_number, note, col, par, arg_max(font_name, (n, -seen)) AS font_name FROM (SELECT pdf_filename, page_number, note, col, par, font_name, count(*) AS n, min(pos) AS seen FROM sp GROUP BY ALL) GROUP BY ALL),
pb AS (SELECT pdf_filename, page_number, note, col, par, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(font_size) AS font_size_min, max(font_size) AS font_size_max, round(sum(font_size) / count(*), 6) AS font_size, bool_or(bold) AS has_bold, count(*) AS span_count FROM sp GROUP BY ALL)
SELECT pdf_filename, page_number, row_number() OVER (PARTITION BY pdf_filename, page_number ORDER BY note, col, par) AS place, CASE WHEN note THEN 'footnote' WHEN {heading('content', '(font_size >= 14)::INT * 2 + has_bold::INT * 2 + (span_count <= 2)::INT')} THEN 'heading' WHEN {any_match('content', lists.LIST_ITEM)} THEN 'list' ELSE 'paragraph' END AS block_type,
  content, x0, y0, x1, y1, font_size_min, font_size_max, font_size, font_name, has_bold, line_count, span_count FROM pt JOIN pb USING (pdf_filename, page_number, note, col, par) JOIN fonts USING (pdf_filename, page_number, note, col, par)""",
    "batch_driver": """WITH d AS (SELECT *, translate(lower(coalesce(lang, 'none')), ' -', '__') AS c1, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE c1 END AS c2, doc_id % 11 <> 0 AS on1, doc_id % 5 <> 1 AS on2, on1 AND doc_id % 13 <> 5 AS live1, live1 AND c1 = c2 AS same, on2 AND NOT same AND doc_id % 13 <> 6 AS done2 FROM documents),
became AS (SELECT 1 AS gen, c1 AS collection, CASE WHEN live1 THEN 'processed' ELSE 'failed' END AS status, CASE WHEN NOT live1 THEN 'unreadable' END AS reason FROM d WHERE on1
  UNION ALL SELECT 2, c2, CASE WHEN same THEN 'skipped' WHEN done2 THEN 'processed' ELSE 'failed' END, CASE WHEN same THEN 'already_processed' WHEN NOT done2 THEN 'unreadable' END FROM d WHERE on2
  UNION ALL SELECT 2, c1, 'removed', CASE WHEN on2 THEN 'moved' ELSE 'orphan' END FROM d WHERE live1 AND (NOT on2 OR (NOT same AND done2))),
stored AS (SELECT c2 AS collection, text FROM d WHERE done2 UNION ALL SELECT c1, text FROM d WHERE live1 AND on2 AND NOT done2)
SELECT gen, collection, status, reason, count(*) AS documents, 0 AS characters FROM became GROUP BY ALL UNION ALL
SELECT 2, collection, 'stored', NULL, count(*), sum(length(text))::BIGINT FROM stored WHERE regexp_matches(text, '\\S') GROUP BY 2""",
    "page_text_hits": f"""WITH {BLOCKS}, s AS (SELECT pdf_filename, doc_id // 20 AS page_number, line AS ord, {stripped('content')} AS t FROM blocks WHERE {stripped('content')} <> ''),
placed AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY pdf_filename, page_number ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM s),
pg AS (SELECT pdf_filename, page_number, string_agg(t, ' ' ORDER BY ord) || ' ' AS page_text FROM s GROUP BY ALL), w AS (SELECT doc_id AS query_id, source AS pdf_filename, doc_id // 20 AS target, substr(text, 20, 60) AS text FROM documents)
{_hits('exact', lambda x: x, 0)} UNION ALL {_hits('normalised', normalised, 50)}""",
    "json_answers": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS c, doc_id % 8 AS k, {first_words("translate(coalesce(text, ''), '" + chr(34) + chr(92) + "', '')", 3)} AS first FROM documents),
a AS (SELECT doc_id, k, CASE WHEN k IN (0, 1) THEN 'false' ELSE 'true' END AS found_answer, CASE WHEN k IN (0, 1) THEN 'high' WHEN k = 4 THEN NULL ELSE 'medium' END AS confidence, c, first FROM d)
SELECT doc_id, found_answer, confidence, CASE WHEN k < 4 THEN c WHEN k = 4 THEN '{{"parts":["' || first || '"]}}' WHEN k = 5 THEN {stripped("regexp_replace('{" + chr(34) + "response" + chr(34) + ": " + chr(34) + "' || first, '[" + chr(92) * 2 + chr(92) + "s]*$', '')")} WHEN k = 6 THEN to_json({{'found_answer': false, 'confidence': 'high', 'response': c}})::VARCHAR || ' and more' ELSE first END AS response,
CASE WHEN k >= 5 THEN CASE WHEN k = 5 THEN {stripped("regexp_replace('{" + chr(34) + "response" + chr(34) + ": " + chr(34) + "' || first, '[" + chr(92) * 2 + chr(92) + "s]*$', '')")} WHEN k = 6 THEN to_json({{'found_answer': false, 'confidence': 'high', 'response': c}})::VARCHAR || ' and more' ELSE first END END AS unread FROM a""",
    "toc_title_spans": f"""WITH {BLOCKS}, titles AS (SELECT source AS pdf_filename, doc_id AS title_id, coalesce(CASE doc_id % 4 WHEN 0 THEN {first_words("text", 6)} WHEN 1 THEN 'zzq ' || {first_words("text", 6)} || ' qqz' WHEN 2 THEN translate({first_words("text", 2)}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE {first_words("text", 1)} || ' qx vz Report kq' END, '') AS title FROM documents),
t AS (SELECT *, {stripped("lower(title)")} AS low, {words(stripped("lower(title)"))} AS w FROM titles), s AS (SELECT *, lower(content) AS low FROM blocks WHERE content <> ''),
m AS (SELECT t.pdf_filename, t.title_id, s.page_number, s.doc_id, s.line, CASE WHEN contains(s.low, t.low) THEN 1 WHEN len(t.w) > 1 AND {_HELD} >= len(t.w) // 2 THEN 2 WHEN len(t.w) > 2 AND len({_KEYS}) > 0 AND len([w FOR w IN {_KEYS} IF contains(s.low, w)]) = len({_KEYS}) THEN 3 END AS rule FROM t JOIN s USING (pdf_filename))
SELECT * FROM m WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pdf_filename, title_id ORDER BY rule, page_number, doc_id, line) = 1""",
    "toc_link_targets": f"""WITH {boxes("a", 37, 53, 72, 72, 200, 20, 12)}, {boxes("b", 91, 29, 60, 70, 90, 15, 10)}
SELECT a.pdf_filename, a.doc_id AS entry_id, min(b.doc_id) AS ord, arg_min(b.n % 40 + 1, b.doc_id) AS dest_page FROM a JOIN b USING (pdf_filename, page_number)
WHERE (a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0) OR ({_near("x0", "x1")} AND {_near("y0", "y1")}) GROUP BY 1, 2""",
    "box_captions": f"""WITH {BLOCKS}, {boxes("b", 37, 53, 72, 72, 200, 20, 60)}, s AS (SELECT pdf_filename, doc_id // 20 % 5 + 1 AS page_number, 40.0::DOUBLE + (doc_id * 37 + line * 11) % 500 AS sx, 40.0::DOUBLE + (line * 13 + doc_id * 7) % 700 AS sy,
  CASE WHEN (doc_id + line) % 5 = 0 THEN 'Figure ' || line || ': ' || content ELSE content END AS content FROM blocks),
m AS (SELECT b.pdf_filename, b.page_number, b.doc_id AS box_id, sy, sx, s.content, CASE WHEN regexp_matches(s.content, '(?i)^\\s*(figure|fig\\.?|table|tab\\.?|chart|diagram)\\s*\\d+') THEN 1 WHEN length(s.content) < 200 THEN 2 END AS rank
  FROM b JOIN s ON s.pdf_filename = b.pdf_filename AND s.page_number = b.page_number AND sx BETWEEN x0 - 30 AND x1 + 30 AND CASE WHEN b.doc_id % 3 = 0 THEN sy BETWEEN y0 - 50 AND y0 ELSE sy BETWEEN y1 AND y1 + 50 END)
SELECT b.pdf_filename, b.page_number, b.doc_id AS box_id, content AS caption FROM b LEFT JOIN (SELECT * FROM m WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pdf_filename, page_number, box_id ORDER BY rank, sy, sx, content) = 1) m
  ON m.pdf_filename = b.pdf_filename AND m.page_number = b.page_number AND m.box_id = b.doc_id""",
    "table_fallback": f"""WITH {BLOCKS}, w AS (SELECT doc_id, line, {words("content")} AS w FROM blocks), e AS (SELECT doc_id, line, w[i] AS content, i - 1 AS k FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM w)),
p AS (SELECT doc_id, content, 50.0::DOUBLE + k * 60 AS x0, 72.0::DOUBLE + line * 12 - CASE WHEN line % 4 = 3 THEN 6 ELSE 0 END + k % 3 * 2 AS y0, x0 + length(content) * 6 AS x1 FROM e),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY y0, x0, x1, content ROWS UNBOUNDED PRECEDING) AS row FROM (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY doc_id ORDER BY y0, x0, x1, content) <= 5 THEN 0 ELSE 1 END AS fresh FROM p)),
c AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id, row ORDER BY x0, y0, x1, content ROWS UNBOUNDED PRECEDING) AS col FROM (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id, row ORDER BY x0, y0, x1, content) <= 20 THEN 0 ELSE 1 END AS gap FROM r)),
cells AS (SELECT doc_id, row, col, string_agg(content, ' ' ORDER BY x0, y0, x1, content) AS content FROM c GROUP BY ALL),
lines_ AS (SELECT doc_id, row, string_agg(content, '|' ORDER BY col) AS line, max(col) AS own, max(max(col)) OVER (PARTITION BY doc_id) AS most FROM cells GROUP BY doc_id, row)
SELECT doc_id AS region, count(*) AS n_rows, any_value(most)::BIGINT AS n_columns, md5(string_agg(line || repeat('|', (most - own)::INT), '~' ORDER BY row)) AS digest FROM lines_ GROUP BY doc_id""",
    "collection_stats": f"WITH {CHUNKS} SELECT collection, count(*) AS total_chunks, count(*) FILTER (chunk_type = 'child') AS child_chunks, count(*) FILTER (chunk_type = 'parent') AS parent_chunks, count(DISTINCT page_number) AS pages, count(DISTINCT toc_title) AS sections, count(DISTINCT nullif(pdf_filename, '')) AS documents, count(DISTINCT (pdf_filename, page_number)) AS document_pages FROM chunks GROUP BY 1",
    "chunks_per_doc": f"WITH {CHUNKS} SELECT collection, pdf_filename, count(*) AS chunks FROM chunks GROUP BY ALL",
    "available_docs": f"WITH {CHUNKS} SELECT DISTINCT collection, pdf_filename FROM chunks WHERE pdf_filename <> ''",
    "collections_listing": f"WITH {CHUNKS} SELECT collection, count(DISTINCT pdf_filename) AS document_count, count(*) AS chunk_count FROM chunks GROUP BY 1",
    "toc_sections": f"WITH {CHUNKS} SELECT pdf_filename, title, corrected_toc_page AS page FROM (SELECT *, {stripped('toc_title')} AS title, row_number() OVER (PARTITION BY pdf_filename, {stripped('toc_title')} ORDER BY seq) AS rn FROM chunks) WHERE rn = 1 AND title <> ''",
    "scope_filter": f"WITH {CHUNKS} SELECT chunk_id, pdf_filename, toc_title, page_number FROM chunks WHERE chunk_type = 'child' AND pdf_filename IN ('src1', 'src3') AND toc_title IN ('Section 1', 'Section 2')",
    "page_range_filter": f"WITH {CHUNKS} SELECT chunk_id, page_number FROM chunks WHERE chunk_type = 'child' AND pdf_filename = 'src2' AND page_number BETWEEN 5 AND 20",
    "partial_title_match": f"WITH {CHUNKS} SELECT chunk_id, toc_title FROM chunks WHERE contains(lower(toc_title), 'the section 2 and more') OR contains('the section 2 and more', lower(toc_title)) OR contains(lower(toc_title), 'tion 3') OR contains('tion 3', lower(toc_title))",
    "knn_topk": f"WITH {CHUNKS}, {QUERIES}, {knn('k', 10)} SELECT * FROM k",
    "knn_filtered": f"""WITH {CHUNKS}, {QUERIES}, {knn('k', 5, "c.chunk_type = 'child' AND c.pdf_filename IN ('src0', 'src1', 'src2', 'src3')")} SELECT * FROM k""",
    "knn_similarity": f"WITH {CHUNKS}, {QUERIES}, {knn('k', 3, digits=10)} SELECT query_id, chunk_id, round(greatest(0.0, (2.0 - distance) / 2.0), 6) AS half_similarity, round(1.0 - distance, 6) AS direct_similarity FROM k",
    "knn_per_document": f"WITH {CHUNKS}, {QUERIES}, {knn('k', 3, by='pdf_filename')} SELECT * FROM k",
    "tokens": f"WITH {CHUNKS} SELECT chunk_id, len({tok('content')}) AS n_tokens, len(list_distinct({tok('content')})) AS n_terms FROM chunks",
    "bm25_topk": f"WITH {CHUNKS}, {QUERIES}, {bm25('b', 10)} SELECT query_id, chunk_id, score, rank FROM b",
    "bm25_stored": f"WITH {CHUNKS.replace('chunks AS (', 'every AS (', 1)}, chunks AS (SELECT * FROM every WHERE regexp_matches(content, '[^ ]') AND NOT (pdf_filename = 'src4' AND collection = 'en')), {QUERIES}, {bm25('b', 10)} SELECT query_id, chunk_id, score, rank FROM b",
    "rule_keywords": f"WITH {QUERIES} SELECT query_id, array_to_string([y for y, j in o if list_position(o, y) = j], '|') AS observed, array_to_string([y for y, j in n if list_position(n, y) = j], '|') AS intended FROM (SELECT query_id, {keywords('query', 'observed')} AS o, {keywords('query', 'intended')} AS n FROM qtext)",
    "keyword_search": f"WITH {CHUNKS}, {QUERIES}, {keyword_search('k', 'observed')} SELECT * FROM k",
    "keyword_search_intended": f"WITH {CHUNKS}, {QUERIES}, {keyword_search('k', 'intended')} SELECT * FROM k",
    "hybrid_merge": f"WITH {CHUNKS}, {QUERIES}, {hybrid('h', 5, 'true')} SELECT * FROM h",
    "rrf_three_way": f"WITH {_LEX}, {keyword_search('k', 'intended')}, {top('l', 'k', 50)} {fused([('d', 1.0), ('s', 1.0), ('l', 1.0)], 20)}".replace("FROM qtext)),", "FROM qtext SEMI JOIN queries USING (query_id))),", 1).replace("FROM qtext) GROUP", "FROM qtext SEMI JOIN queries USING (query_id)) GROUP"),
    "rrf_weighted": f"WITH {_LEX} {fused([('d', 0.7), ('s', 0.3)], 10)}".replace("FROM qtext) GROUP", "FROM qtext SEMI JOIN queries USING (query_id)) GROUP"),
    "fused_pipeline": f"WITH {_LEX}, {keyword_search('k', 'observed')}, {top('l', 'k', 50)} SELECT * FROM ({fused([('d', 1.0), ('s', 1.0), ('l', 1.0)], 20)}) WHERE rank <= 10".replace("FROM qtext) GROUP", "FROM qtext SEMI JOIN queries USING (query_id)) GROUP"),
    "routed_search_with_fallback": f"""WITH {CHUNKS}, {QUERIES}, {hybrid('a', 8, "toc_title = 'Section 4' AND pdf_filename IN ('src1', 'src2')")}, {hybrid('w', 16, "pdf_filename IN ('src1', 'src2', 'src3')")},
few AS (SELECT q.query_id, count(a.chunk_id) AS found FROM queries q LEFT JOIN a USING (query_id) GROUP BY 1 HAVING count(a.chunk_id) < 4),
fresh AS (SELECT * FROM (SELECT w.query_id, w.chunk_id, w.score, found, row_number() OVER (PARTITION BY w.query_id ORDER BY w.rank, w.chunk_id) AS turn FROM w JOIN few USING (query_id) WHERE w.rank <= 2 * (8 - found) AND NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = w.query_id AND a.chunk_id = w.chunk_id)) WHERE turn <= 8 - found)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, score, source_type FROM a UNION ALL SELECT query_id, chunk_id, score, 'global_fallback' FROM fresh)""",
    "routed_sections": f"""WITH {CHUNKS}, {QUERIES}, {hybrid('a', 8, "(query_id % 3 = 1 AND toc_title = 'Section 4' AND pdf_filename = 'src1') OR (query_id % 3 = 2 AND toc_title = 'Section 2' AND pdf_filename = 'src2')")}, {hybrid('w', 16, "true")},
few AS (SELECT query_id, coalesce(found, 0) AS found FROM queries LEFT JOIN (SELECT query_id, count(*) AS found FROM a GROUP BY 1) USING (query_id) WHERE coalesce(found, 0) < 4 AND query_id % 3 > 0),
fresh AS (SELECT w.query_id, w.chunk_id, w.score, few.found, row_number() OVER (PARTITION BY w.query_id ORDER BY w.rank, w.chunk_id) AS turn FROM w JOIN few USING (query_id) ANTI JOIN a ON a.query_id = w.query_id AND a.chunk_id = w.chunk_id WHERE w.rank <= 2 * (8 - few.found)),
u AS (SELECT query_id, chunk_id, score, source_type FROM a UNION ALL SELECT query_id, chunk_id, score, 'global_fallback' FROM fresh WHERE turn <= 8 - found UNION ALL SELECT query_id, chunk_id, score, source_type FROM w WHERE rank <= 8 AND query_id % 3 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM u""",
    "ask_documents": f"""WITH {CHUNKS}, {QUERIES}, {hybrid('h', 10, "pdf_filename IN ('src1', 'src2')")} SELECT query_id, chunk_id, score, rank FROM h""",
    "ask_sections": f"""WITH {CHUNKS}, {QUERIES}, {hybrid('h', 10, "pdf_filename = 'src1' AND toc_title IN ('Section 1', 'Section 2')")} SELECT query_id, chunk_id, score, rank FROM h""",
    "ask_whole_sections": f"""WITH {CHUNKS}, {QUERIES}, own AS (SELECT * FROM chunks WHERE pdf_filename = 'src4'), starts AS (SELECT toc_title, arg_min(corrected_toc_page, seq) AS first FROM own GROUP BY 1),
r AS (SELECT first, coalesce((SELECT min(first) FROM starts WHERE first > s.first) - 1, first + 10) AS last FROM starts s WHERE toc_title = 'Section 1'), p AS (SELECT page_number, content FROM own JOIN r ON page_number BETWEEN first AND last WHERE last - first < 10 AND regexp_matches(content, '\\S'))
SELECT query_id, 'src4:page:' || page_number AS chunk_id, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY page_number, content) AS rank FROM queries, p""",
    "ask_pages": f"""WITH {CHUNKS}, {QUERIES}, {knn('k', 10, "c.chunk_type = 'child' AND c.pdf_filename = 'src2' AND c.page_number BETWEEN 5 AND 20")} SELECT query_id, chunk_id, round(1.0::DOUBLE - distance, 6) AS score, rank FROM k""",
    "ask_whole_pages": rf"WITH {CHUNKS}, {QUERIES} SELECT query_id, pdf_filename || ':page:' || page_number AS chunk_id, 1.0::DOUBLE AS score, page_number - 2 AS rank FROM chunks, queries WHERE pdf_filename = 'src4' AND page_number BETWEEN 3 AND 9 AND regexp_matches(content, '\S')",
    "deleted_document": f"WITH {CHUNKS} SELECT collection, pdf_filename, count(*) AS chunks FROM chunks WHERE NOT (collection IS NOT DISTINCT FROM 'en' AND pdf_filename IS NOT DISTINCT FROM 'src2') GROUP BY ALL",
    "dropped_collection": f"WITH {CHUNKS} SELECT collection, count(*) AS chunks FROM chunks WHERE collection IS DISTINCT FROM 'en' GROUP BY 1",
    "full_pages": rf"WITH {CHUNKS} SELECT pdf_filename || ':page:' || page_number AS id, pdf_filename, page_number, content, 1.0::DOUBLE AS score, page_number - 2 AS rank FROM chunks WHERE pdf_filename = 'src4' AND page_number BETWEEN 3 AND 9 AND regexp_matches(content, '\S')",
    "section_page_ranges": f"WITH {CHUNKS}, {TOC}, {RANGES} SELECT * FROM ranges",
    "merged_intervals": f"WITH {CHUNKS}, {TOC}, {RANGES}, pages AS (SELECT DISTINCT pdf_filename, unnest(generate_series(start_page, end_page)) AS p FROM ranges), g AS (SELECT pdf_filename, p, p - row_number() OVER (PARTITION BY pdf_filename ORDER BY p) AS island FROM pages) SELECT pdf_filename, min(p) AS start_page, max(p) AS end_page FROM g GROUP BY pdf_filename, island",
    "section_pages": rf"WITH {CHUNKS}, {TOC}, {RANGES}, own AS (SELECT * FROM ranges WHERE pdf_filename = 'src5' AND substr(title, 1, 9) = 'Section 1'), fit AS (SELECT * FROM own WHERE (SELECT sum(end_page - start_page + 1) FROM own) <= 10) SELECT c.pdf_filename, c.page_number, content FROM chunks c JOIN fit f ON f.pdf_filename = c.pdf_filename AND c.page_number BETWEEN start_page AND end_page WHERE regexp_matches(content, '\S')",
    "header_footer_patterns": f"WITH {HEADED}, {RUNNING} SELECT * FROM running",
    "header_footer_removal": f"WITH {HEADED}, {RUNNING} SELECT pdf_filename, count(*) AS blocks FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM running r WHERE r.pdf_filename = b.pdf_filename AND r.text = lower({squashed('b.content')}) AND abs(b.y0 - r.y_band) <= 10) GROUP BY 1",
    "block_types": f"WITH {BLOCKS} SELECT doc_id, line, {block_type('content')} AS block_type FROM blocks",
    "block_type_counts": f"WITH {BLOCKS} SELECT {block_type('content')} AS block_type, count(*) AS blocks FROM blocks GROUP BY 1",
    "content_blocks": rf"""WITH {CHUNKS}, {TOC}, {BLOCKS}, made AS (SELECT *, doc_id * 100000 + line AS rid, (doc_id + line) % 7 AS turn, 100.0::DOUBLE + doc_id % 5 * 10 AS left_, {words("content")} AS w FROM blocks),
  grids AS (SELECT *, [r for r in [w[1:3], w[4:6]] if len(r) > 0] AS g FROM made), elements AS (
  SELECT pdf_filename, page_number, 0 AS kind, rid, CASE WHEN length({stripped("content")}) < 3 THEN 'paragraph' ELSE {block_type("content")} END AS block_type, content, 50.0::DOUBLE AS x0, y0, 550.0::DOUBLE AS x1, y0 + 50 AS y1,
    NULL::VARCHAR AS caption, 0 AS row_count, 0 AS column_count, NULL::VARCHAR AS image_type, NULL::VARCHAR AS reference_number FROM made WHERE turn NOT IN (3, 5, 6)
  UNION ALL SELECT pdf_filename, page_number, 1, rid, 'table', CASE WHEN doc_id % 2 = 0 AND len(g) > 0 THEN '| ' || array_to_string(g[1], ' | ') || ' |' || chr(10) || '| ' || array_to_string(['---' for c in g[1]], ' | ') || ' |'
      || CASE WHEN len(g) > 1 THEN chr(10) || '| ' || array_to_string(g[2], ' | ') || ' |' ELSE '' END ELSE coalesce(array_to_string([array_to_string(r, ' | ') for r in g], chr(10)), '') END,
    left_, y0, left_ + 200, y0 + 10, 'Table ' || line, len(g), coalesce(len(g[1]), 0), NULL, NULL FROM grids WHERE turn = 3
  UNION ALL SELECT pdf_filename, page_number, 2, rid, 'figure', CASE WHEN doc_id % 3 > 0 THEN {first_words("content", 6)} END, left_, y0, left_ + 200, y0 + 10, CASE WHEN doc_id % 3 > 0 THEN {first_words("content", 6)} END, 0, 0, 'png', NULL FROM made WHERE turn = 5
  UNION ALL SELECT pdf_filename, page_number, 3, rid, 'footnote', content, left_, y0, left_ + 200, y0 + 10, NULL, 0, 0, NULL, line::VARCHAR FROM made WHERE turn = 6),
  rows AS (SELECT pdf_filename, doc_id AS rid, page_number FROM chunks), {ASOF}
  SELECT e.* EXCLUDE (kind, rid), row_number() OVER (PARTITION BY pdf_filename ORDER BY page_number, y0, x0, kind, e.rid) AS place, CASE WHEN block_type = 'figure' THEN x1 - x0 ELSE 0 END AS width, CASE WHEN block_type = 'figure' THEN y1 - y0 ELSE 0 END AS height,
    toc_title, toc_level, toc_page, coalesce(block_type = 'heading' AND {jaccard("content", "toc_title")} > 0.7, false) AS is_toc_heading FROM elements e JOIN linked l ON l.rid = e.rid // 100000""",
    "toc_asof": f"WITH {CHUNKS}, {TOC}, rows AS (SELECT pdf_filename, doc_id AS rid, page_number FROM chunks), {ASOF} SELECT rid AS doc_id, toc_title, toc_level, toc_page FROM linked",
    "toc_heading_jaccard": f"WITH {CHUNKS}, {TOC}, {BLOCKS}, rows AS (SELECT pdf_filename, doc_id AS rid, page_number FROM blocks WHERE line = 0), {ASOF} SELECT doc_id, round({jaccard('content', 'toc_title')}, 6) AS likeness, ({block_type('content')}) = 'heading' AND {jaccard('content', 'toc_title')} > 0.7 AS is_toc_heading FROM blocks JOIN linked ON rid = doc_id WHERE line = 0",
    "sentences": f"WITH {CHUNKS}, s AS (SELECT doc_id, {SENTENCES} AS l FROM chunks), e AS (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM s) SELECT doc_id, i - 1 AS at, l[i] AS sentence, round({estimate('l[i]')}, 4) AS tokens FROM e",
    "child_chunks": f"WITH {FOLD.replace('RECURSIVE docs', f'RECURSIVE {CHUNKS}, docs')} SELECT doc_id, chunk, content, token_count FROM kids",
    "parent_chunks": f"""WITH {FOLD.replace('RECURSIVE docs', f'RECURSIVE {CHUNKS}, docs')}, kt AS (SELECT doc_id, list(token_count ORDER BY chunk) AS t, list(chunk ORDER BY chunk) AS c FROM kids GROUP BY 1),
pf AS (SELECT doc_id, 1 AS pos, 0 AS parent, t[1] AS total FROM kt UNION ALL SELECT f.doc_id, f.pos + 1, parent + (total + t[f.pos + 1] > 1600 AND total >= 800)::INT, CASE WHEN total + t[f.pos + 1] > 1600 AND total >= 800 THEN t[f.pos + 1] ELSE total + t[f.pos + 1] END FROM pf f JOIN kt k ON k.doc_id = f.doc_id WHERE f.pos < len(t))
SELECT f.doc_id, parent, min(c[pos]) AS first_child, count(*) AS children, round(sum(t[pos] ORDER BY pos), 4) AS token_count FROM pf f JOIN kt k ON k.doc_id = f.doc_id GROUP BY 1, 2""",
    "chunk_pages": f"WITH {FOLD.replace('RECURSIVE docs', f'RECURSIVE {CHUNKS}, {BLOCKS}, docs')}, b AS (SELECT doc_id, any_value(page_number) AS page_number FROM blocks GROUP BY 1) SELECT doc_id, chunk, page_number FROM kids JOIN b USING (doc_id)",
    "section_children": f"WITH {NUMBERED} SELECT *, page_number::VARCHAR AS page_numbers FROM nk",
    "section_parents": f"WITH {NUMBERED} SELECT * FROM np",
    "parent_lookup": f"WITH {NUMBERED} SELECT h.pdf_filename, h.section, h.chunk_id AS child_id, p.chunk_id AS parent_id, p.content, p.page_number FROM held h JOIN np p ON p.section = h.section AND p.chunk_index = h.parent",
    "chunk_by_id": f"WITH {CHUNKS} SELECT chunk_id, collection, pdf_filename, page_number, content FROM chunks WHERE chunk_id = 'c17'",
    "document_overview": f"WITH {CHUNKS} SELECT chunk_id, page_number FROM chunks WHERE pdf_filename = 'src6' AND chunk_type = 'parent' ORDER BY seq, chunk_id LIMIT 5",
    "history_recent_budget": f"WITH {TURNS}, t AS (SELECT *, round(sum({_TURN}) OVER w, 4) AS total, row_number() OVER w AS n FROM turns WINDOW w AS (PARTITION BY collection ORDER BY conv_id DESC, turn DESC ROWS UNBOUNDED PRECEDING)) SELECT collection, conv_id, turn, total FROM t WHERE total <= 2000 OR n = 1",
    "history_compaction": f"""WITH {TURNS}, t AS (SELECT *, {_TURN} AS tokens, conv_id % 37 = 5 AND turn = 1 AS is_summary, row_number() OVER (PARTITION BY collection ORDER BY conv_id, turn) AS place FROM turns),
u AS (SELECT *, round(sum(tokens) OVER w, 4) AS upto, row_number() OVER w AS newest, max(CASE WHEN is_summary THEN place END) OVER (PARTITION BY collection) AS last_summary FROM t WINDOW w AS (PARTITION BY collection ORDER BY conv_id DESC, turn DESC ROWS UNBOUNDED PRECEDING)),
g AS (SELECT collection, round(sum(tokens), 4) AS tokens, bool_or(round(upto - tokens, 4) < 2000 AND is_summary) AS near, max(last_summary) AS last_summary, round(coalesce(sum(tokens) FILTER (place > last_summary), 0), 4) AS since, count(*) FILTER (NOT (upto <= 2000 OR newest = 1) AND NOT is_summary) AS older FROM u GROUP BY 1),
k AS (SELECT *, tokens <= 5000 OR near OR (last_summary IS NOT NULL AND since < 3000) OR older < 2 AS keep FROM g) SELECT collection, tokens, CASE WHEN keep THEN 'keep' ELSE 'summarise' END AS action, CASE WHEN keep THEN 0 ELSE older END AS summarised_turns FROM k""",
    "history_summarised": f"""WITH {TURNS}, t AS (SELECT *, {_TURN} AS tokens, conv_id % 37 = 5 AND turn = 1 AS is_summary, row_number() OVER (PARTITION BY collection ORDER BY conv_id, turn) AS place FROM turns),
u AS (SELECT *, round(sum(tokens) OVER w, 4) AS upto, row_number() OVER w AS newest, max(CASE WHEN is_summary THEN place END) OVER (PARTITION BY collection) AS last_summary FROM t WINDOW w AS (PARTITION BY collection ORDER BY conv_id DESC, turn DESC ROWS UNBOUNDED PRECEDING)),
g AS (SELECT collection, round(sum(tokens), 4) AS tokens, bool_or(round(upto - tokens, 4) < 2000 AND is_summary) AS near, max(last_summary) AS last_summary, round(coalesce(sum(tokens) FILTER (place > last_summary), 0), 4) AS since, count(*) FILTER (NOT (upto <= 2000 OR newest = 1) AND NOT is_summary) AS older FROM u GROUP BY 1),
k AS (SELECT *, tokens <= 5000 OR near OR (last_summary IS NOT NULL AND since < 3000) OR older < 2 AS keep FROM g), d AS (SELECT u.*, NOT k.keep AND NOT (upto <= 2000 OR newest = 1) AND NOT is_summary AS old FROM u JOIN k USING (collection))
SELECT collection, conv_id, turn, user_message, is_summary, old AS is_summarized FROM d UNION ALL SELECT collection, arg_min(conv_id, place), arg_min(turn, place), '[Summary of ' || count(*) || ' earlier messages]', true, false FROM d WHERE old GROUP BY collection""",
    "last_turns": f"WITH {TURNS} SELECT collection, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY conv_id DESC, turn DESC) AS n FROM turns) WHERE n <= 15",
    "history_display": f"WITH {TURNS} SELECT collection, conv_id, turn, 0 AS part, 'user' AS role, user_message AS text FROM turns UNION ALL SELECT collection, conv_id, turn, 1, 'assistant', assistant_response FROM turns",
    "history_clear": f"WITH {TURNS} SELECT collection, count(*) AS turns FROM turns WHERE collection <> 'c2' GROUP BY 1",
    "content_type_request": f"WITH {TURNS} SELECT conv_id, turn, {_REQUEST} AS request FROM turns",
    "question_complexity": f"WITH {TURNS} SELECT conv_id, turn, {_CLASS} AS question_class FROM turns",
    "chunk_content_type": f"WITH {CHUNKS} SELECT chunk_id, {_KIND} AS content_type FROM chunks",
    "content_type_filter": f"WITH {CHUNKS}, {QUERIES}, {bm25('b', 10)}, k AS (SELECT query_id, chunk_id, {_KIND} AS kind FROM b JOIN chunks USING (chunk_id)), m AS (SELECT *, bool_or(kind = 'table') OVER (PARTITION BY query_id) AS any_hit FROM k) SELECT query_id, chunk_id, kind FROM m WHERE kind = 'table' OR NOT any_hit",
    "citation_extract": f"WITH {CHUNKS}, {ANSWERS}, {CITED} SELECT * FROM cited",
    "citation_labels": f"WITH {CHUNKS}, {ANSWERS}, {CITED}, l AS (SELECT answer_id, (pdf_name || '.pdf_of_' || chunk_id) AS bare, trim(repeat(cited_text, (answer_id % 5 + 1)::INT), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM cited) SELECT answer_id, CASE WHEN length(bare) > 25 THEN substr(bare, 1, 22) || '...' ELSE bare END AS label, CASE WHEN t = '' THEN NULL WHEN length(t) > 150 THEN substr(t, 1, 147) || '...' ELSE t || '...' END AS tooltip FROM l",
    "citation_locate": locate(),
    "table_clean": f"WITH {CHUNKS}, {GRIDS} SELECT doc_id, len(g) AS rows, array_to_string([array_to_string(r, '|') for r in g], chr(10)) AS cells FROM grids",
    "table_markdown": f"WITH {CHUNKS}, {GRIDS} SELECT doc_id, CASE WHEN len(g) = 0 THEN '' ELSE array_to_string(list_concat(['| ' || array_to_string(g[1], ' | ') || ' |', '| ' || array_to_string(['---' for c in g[1]], ' | ') || ' |'], ['| ' || array_to_string(r, ' | ') || ' |' for r in g[2:]]), chr(10)) END AS markdown FROM grids",
    "context_pack": f"""WITH {CHUNKS}, {QUERIES}, {TURNS}, {bm25('b', 8)}, got AS (SELECT query_id, count(*) AS chunks, string_agg('[Source: PDF=' || pdf_filename || ', Page=' || page_number || ', ChunkID=' || chunk_id || ', Section=' || toc_title || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM b JOIN chunks USING (chunk_id) WHERE rank <= 6 GROUP BY 1),
said AS (SELECT collection, count(*) AS turns, string_agg('Human: ' || user_message || chr(10) || 'Assistant: ' || assistant_response, chr(10) ORDER BY conv_id, turn) AS conversation FROM (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY collection ORDER BY conv_id DESC, turn DESC) <= 5) GROUP BY 1)
SELECT query_id, coalesce(chunks, 0) AS chunks, coalesce(context, 'No specific relevant content was found in the documents.') AS context, coalesce(turns, 0) AS turns, coalesce(conversation, 'This is the start of our conversation.') AS conversation FROM qtext LEFT JOIN got USING (query_id) LEFT JOIN said ON collection = 'c' || query_id % 7""",
    "budget_pack": f"""WITH {CHUNKS}, {QUERIES}, {bm25('b', 8)}, r AS (SELECT query_id, chunk_id, rank, content, {_KIND} AS kind, '[Source ' || rank || ': PDF=' || pdf_filename || ', Page=' || page_number || ', ChunkID=' || chunk_id || ', Section=' || toc_title || ']' || chr(10) AS head FROM b JOIN chunks USING (chunk_id)),
p AS (SELECT *, head || CASE kind WHEN 'table' THEN {table_text('content')} WHEN 'figure' THEN '[FIGURE - Image not available]' || chr(10) || content ELSE content END || chr(10) AS text FROM r),
u AS (SELECT *, round(sum({estimate('text')}) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING), 4) AS used, used - {estimate('text')} AS prior, {words('content')} AS w FROM p),
k AS (SELECT *, list_max([j FOR j IN generate_series(len(w), 1, -10) IF round((len({words('head')}) + j + 1) * 1.3::DOUBLE, 4) <= round(2000 - prior - 50, 4)]) AS keep FROM u)
SELECT query_id, chunk_id, rank, CASE WHEN used <= 2000 THEN used ELSE round(prior + (len({words('head')}) + keep + 1) * 1.3::DOUBLE, 4) END AS used, used > 2000 AS truncated, CASE WHEN used <= 2000 THEN text ELSE head || array_to_string(w[1:keep], ' ') || '... [truncated]' || chr(10) END AS text
FROM k WHERE used <= 2000 OR (round(prior, 4) <= 2000 AND kind = 'text' AND prior < 1800 AND keep > 0)""",
    "table_reformat": f"WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN translate(text, ',', '|') WHEN 1 THEN regexp_replace(text, '[ie] ', '||', 'g') ELSE text END AS content FROM documents) SELECT doc_id, {table_text('content')} AS table FROM t",
    "dedupe_sources": f"WITH {CHUNKS}, {QUERIES}, {knn('d', 8)}, {bm25('b', 8)}, u AS (SELECT query_id, chunk_id, 1 AS answer, rank FROM d UNION ALL SELECT query_id, chunk_id, 2, rank FROM b) SELECT query_id, chunk_id, answer, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY answer, rank) AS n FROM u) WHERE n = 1".replace("FROM qtext) GROUP", "FROM qtext SEMI JOIN queries USING (query_id)) GROUP"),
    "collection_from_path": f"WITH {FILES} SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN replace(replace(lower('My Books-' || upper(collection)), ' ', '_'), '-', '_') ELSE 'default' END AS collection FROM files",
    "new_files": f"WITH {FILES} SELECT collection, pdf_filename FROM files f WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.collection = f.collection AND l.pdf_filename = f.pdf_filename)",
    "moved_files": f"WITH {FILES} SELECT f.pdf_filename, f.collection, l.collection AS old_collection FROM files f JOIN ledger l ON l.pdf_filename = f.pdf_filename AND l.collection <> f.collection",
    "orphan_files": f"WITH {FILES} SELECT l.* FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.collection = l.collection AND f.pdf_filename = l.pdf_filename AND f.doc_id % 11 <> 0)",
    "batch_outcomes": f"WITH {FILES} SELECT f.collection, CASE WHEN l.pdf_filename IS NULL THEN 'processed' ELSE 'skipped' END AS status, count(*) AS files FROM files f LEFT JOIN ledger l ON l.collection = f.collection AND l.pdf_filename = f.pdf_filename GROUP BY 1, 2",
    "upserted_chunks": f"WITH {CHUNKS} SELECT collection, pdf_filename, count(*) FILTER (pdf_filename NOT IN ('src1', 'src7') OR length(content) % 2 = 1) AS chunks, count(*) FILTER (pdf_filename IN ('src1', 'src7') AND length(content) % 2 = 1) AS fresh FROM chunks GROUP BY 1, 2 HAVING count(*) FILTER (pdf_filename NOT IN ('src1', 'src7') OR length(content) % 2 = 1) > 0",
    "paragraph_positions": rf"""WITH RECURSIVE {CHUNKS}, p AS (SELECT pdf_filename, doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(content, chr(10), chr(10) || chr(10)) ELSE content END AS t FROM chunks),
b AS (SELECT *, [x FOR x IN [{stripped('y')} FOR y IN string_split(t, chr(10) || chr(10))] IF x <> ''] AS blocks, [x FOR x IN [{stripped('y')} FOR y IN string_split(t, chr(10))] IF x <> ''] AS l FROM p),
g AS (SELECT *, [x FOR x IN blocks IF length(x) > 50 OR (length(x) > 20 AND contains(x, '.'))] AS good FROM b), k AS (SELECT *, len(blocks) >= 2 AND len(good) > 0 AS plain FROM g),
line AS (SELECT doc_id, i, l[i] AS x, i > 1 AND ends_with(l[i - 1], '.') AND regexp_matches(l[i], '^\p{{Lu}}') AS begins FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM k WHERE NOT plain)),
f AS (SELECT doc_id, i, 1 AS para, x AS open FROM line WHERE i = 1 UNION ALL SELECT f.doc_id, l.i, f.para + (l.begins OR length(f.open) > 800)::INT, CASE WHEN l.begins OR length(f.open) > 800 THEN l.x ELSE f.open || ' ' || l.x END FROM f JOIN line l ON l.doc_id = f.doc_id AND l.i = f.i + 1),
para AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY para) AS i FROM (SELECT doc_id, para, arg_max(open, i) AS x FROM f GROUP BY ALL) WHERE length(x) > 20),
m AS (SELECT doc_id, i, 1 AS para, x AS open FROM para WHERE i = 1 UNION ALL SELECT m.doc_id, p.i, m.para + (length(p.x) >= 100 OR length(m.open) >= 400)::INT, CASE WHEN length(p.x) >= 100 OR length(m.open) >= 400 THEN p.x ELSE m.open || ' ' || p.x END FROM m JOIN para p ON p.doc_id = m.doc_id AND p.i = m.i + 1),
parts AS (SELECT doc_id, i, good[i] AS x FROM (SELECT *, unnest(generate_series(1, len(good))) AS i FROM k WHERE plain) UNION ALL SELECT doc_id, para, arg_max(open, i) FROM m GROUP BY doc_id, para)
SELECT pdf_filename, doc_id AS page_number, (i - 1)::BIGINT AS paragraph_index, x AS text, round(72.0::DOUBLE + (i - 1) * CASE WHEN n > 1 THEN 648.0::DOUBLE / n ELSE 324.0::DOUBLE END, 6) AS y0 FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM parts) JOIN p USING (doc_id)""",
    "toc_page_signals": rf"WITH {CHUNKS}, t AS (SELECT doc_id, regexp_replace(lower(content), '[ \t]', '', 'g') AS t FROM chunks) SELECT doc_id, CASE WHEN contains(t, 'contents') THEN 10 ELSE regexp_matches(t, '[\p{{L}}\p{{N}}_]\.{{2,}}\d')::INT + (len([x for x in regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+') if regexp_full_match(x, '\d{{1,3}}')]) > 5)::INT + regexp_matches(t, '\d\.\d')::INT + contains(t, 'appendix')::INT + regexp_matches(t, '\d\.')::INT + contains(t, 'acknowledgements')::INT + contains(t, 'bibliography')::INT + contains(t, 'references')::INT END AS signals FROM t",
    "html_paragraphs": rf"WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<(?:p|h1)>(.*?)</(?:p|h1)>', 1) AS l FROM pages), e AS (SELECT *, unnest(generate_series(1, len(l))) AS i FROM p) SELECT page_id, i - 1 AS at, {squashed("regexp_replace(l[i], '<[^>]*>', ' ', 'g')")} AS text FROM e",
    "valid_names": f"WITH {CHUNKS} SELECT 'src' || item_id AS pdf_filename, ('src' || item_id) IN (SELECT pdf_filename FROM chunks) AS found FROM benchmark",
    "best_path": f"WITH {FILES}, f AS (SELECT '/data/' || CASE doc_id % 4 WHEN 0 THEN collection WHEN 1 THEN upper(collection) WHEN 2 THEN 'elsewhere' ELSE 'pdfs' END || '/' || pdf_filename AS path, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 5 END AS place, pdf_filename FROM files UNION SELECT '/data/pdfs/' || pdf_filename, 5, pdf_filename FROM files WHERE doc_id % 3 = 0) SELECT collection, w.pdf_filename, arg_min(f.path, (f.place, f.path)) AS path FROM files w JOIN f ON f.pdf_filename = w.pdf_filename GROUP BY 1, 2",
    "figure_gate": f"WITH {CHUNKS}, b AS (SELECT pdf_filename, page_number, chunk_id AS box_id, round((doc_id % 60 * 10.0::DOUBLE) * (length(content) % 700 * 1.0::DOUBLE) / (612.0::DOUBLE * 792.0::DOUBLE), 6) AS area_share FROM chunks) SELECT pdf_filename, box_id, area_share, place FROM (SELECT *, row_number() OVER (PARTITION BY pdf_filename ORDER BY page_number, box_id) AS place FROM b WHERE area_share >= 0.15) WHERE place <= 20",
    "toc_continuation": rf"WITH {CHUNKS}, t AS (SELECT doc_id, regexp_replace(lower(content), '[ \t]', '', 'g') AS t FROM chunks) SELECT doc_id, contains(t, 'appendix')::INT + regexp_matches(t, '[\p{{L}}\p{{N}}_]\.{{2,}}\d')::INT + (len([x for x in regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+') if regexp_full_match(x, '\d{{1,3}}')]) > 3)::INT + {holds('t', ['acknowledgements', 'bibliography', 'references', 'notes', 'abouttheauthor'])}::INT + regexp_matches(t, '\d:')::INT >= 2 AS continues FROM t",
    "page_range_parse": f"WITH {CHUNKS} SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 17 < doc_id % 13 THEN doc_id % 17 ELSE -1 END AS first, CASE WHEN doc_id % 5 <> 0 AND doc_id % 17 < doc_id % 13 THEN doc_id % 13 ELSE -1 END AS last FROM chunks",
    "file_sizes": rf"WITH {CHUNKS}, n AS (SELECT doc_id, length(content) * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END AS n FROM chunks), l AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1024 ** 2 THEN 1 WHEN n < 1024 ** 3 THEN 2 ELSE 3 END AS k FROM n) SELECT doc_id, regexp_replace(printf('%.2f', round(n / 1024.0::DOUBLE ** k, 2)), '\.?0+$', '') || ' ' || (['Bytes', 'KB', 'MB', 'GB'])[k + 1] AS size FROM l",
    "caption_titles": f"WITH {CHUNKS} SELECT doc_id, CASE WHEN doc_id % 4 < 2 AND {first_words('content', 4)} <> '' THEN {first_words('content', 4)} ELSE 'Figure (Page ' || page_number || ')' END AS title FROM chunks",
    "column_geometry": f"WITH {CHUNKS}, x AS (SELECT DISTINCT pdf_filename, page_number, length(content) % 23 * 25.0::DOUBLE AS x0 FROM chunks), s AS (SELECT *, x0 - lag(x0) OVER (PARTITION BY pdf_filename, page_number ORDER BY x0) AS step FROM x) SELECT pdf_filename, page_number, count(*) FILTER (step > 50) + 1 AS column_count, count(*) FILTER (step > 50) AS n_gaps, coalesce(sum(step) FILTER (step > 50), 0) AS total_gap FROM s GROUP BY 1, 2",
    "span_lines": f"WITH {CHUNKS}, x AS (SELECT pdf_filename, page_number % 4 AS p, doc_id, doc_id * 7 % 101 * 3.0::DOUBLE AS y0 FROM chunks), s AS (SELECT *, coalesce((y0 - lag(y0) OVER (PARTITION BY pdf_filename, p ORDER BY y0, doc_id) > 5)::INT, 0) AS b FROM x) SELECT doc_id, sum(b) OVER (PARTITION BY pdf_filename, p ORDER BY y0, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM s",
    "guessed_titles": rf"WITH {BLOCKS}, t AS (SELECT doc_id, line, {stripped('content')} AS c FROM blocks WHERE line < 10 AND line % 3 < 2), m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN line % 2 = 0 THEN 12.0::DOUBLE ELSE 14.0 END * 0.5::DOUBLE + length(c) * 0.1::DOUBLE DESC, line) AS n FROM t WHERE length(c) > 10 AND NOT (upper(c) = c AND lower(c) <> c) AND NOT regexp_matches(c, '\d{{4}}') AND NOT regexp_matches(c, '^[\p{{L}}\p{{N}}_]+\s*$') AND c NOT LIKE '.%' AND NOT contains(c, '@') AND NOT contains(c, '#') AND NOT regexp_matches(c, '^[A-Z][a-z]+\s+[A-Z][a-z]+$')) SELECT d.doc_id::VARCHAR AS pdf_filename, coalesce(m.c, 'Document Content') AS title FROM (SELECT DISTINCT doc_id FROM blocks) d LEFT JOIN m ON m.doc_id = d.doc_id AND m.n = 1",
    "answer_choice": f"WITH {TURNS} SELECT conv_id || '-' || turn AS query_id, CASE WHEN turn % 4 = 1 THEN assistant_response ELSE user_message END AS text, CASE WHEN turn % 4 = 1 THEN 'High' WHEN conv_id % 2 = 0 THEN 'medium' ELSE 'low' END AS confidence FROM turns",
}

SQL["ask_collection"] = f"SELECT query_id, chunk_id, score, rank FROM ({SQL['fused_pipeline']})"
