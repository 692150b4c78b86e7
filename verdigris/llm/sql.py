"""DuckDB SQL for the queries of this subpackage."""

from __future__ import annotations

from ._common import WORD_RE2
from .decontaminate import OPENERS, UNITS

SQL: dict[str, str] = {}

SQL["op10_simhash_near_dedup"] = f"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{WORD_RE2}'))) AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), hashed AS (
  SELECT doc_id, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h, ('0x' || substr(md5(w), 17, 16))::UBIGINT AS g FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), ones AS (
  SELECT doc_id, bit, count(*) FILTER (WHERE (h >> bit) & 1 = 1) AS c, count(*) FILTER (WHERE (g >> bit) & 1 = 1) AS e
  FROM hashed, (SELECT unnest(range(64))::UBIGINT AS bit) GROUP BY doc_id, bit
), prints AS MATERIALIZED (
  SELECT doc_id, bit_or(CASE WHEN 2 * c > n THEN 1::UBIGINT << bit ELSE 0::UBIGINT END) AS fp,
    bit_or(CASE WHEN 2 * e > n THEN 1::UBIGINT << bit ELSE 0::UBIGINT END) AS chk
  FROM ones JOIN sizes USING (doc_id) GROUP BY doc_id
), nodes AS MATERIALIZED (
  SELECT fp, chk, min(doc_id) AS rep, count(*) AS copies FROM prints GROUP BY fp, chk
), edges AS MATERIALIZED (
  SELECT a.rep AS x, b.rep AS y, b.copies FROM nodes a JOIN nodes b ON a.rep <> b.rep
  WHERE bit_count(xor(a.fp, b.fp)) <= 10 AND bit_count(xor(a.chk, b.chk)) <= 16
), reach AS (
  SELECT rep AS x, rep AS y FROM nodes UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
), classes AS (
  SELECT x AS rep, min(y) AS class_id FROM reach GROUP BY x
), links AS (
  SELECT x AS rep, sum(copies) AS others FROM edges GROUP BY x
), placed AS (
  SELECT doc_id, class_id, copies - 1 + coalesce(others, 0) AS links
  FROM prints JOIN nodes USING (fp, chk) JOIN classes USING (rep) LEFT JOIN links USING (rep)
)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(links, 0)::BIGINT AS links, coalesce(class_id, d.doc_id) = d.doc_id AS kept
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN placed p ON d.doc_id = p.doc_id
"""

SQL["op1_source_mixing"] = r"""
WITH keyed AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f]+')), 0)::BIGINT AS tokens,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents WHERE doc_id IS NOT NULL
), totals AS (
  SELECT source, sum(tokens)::BIGINT AS total FROM keyed GROUP BY source
), weighted AS (
  SELECT source, total, round(pow(total::DOUBLE, 0.5) * 1000)::BIGINT AS weight FROM totals WHERE total > 0
), tiers AS (
  SELECT t.tier, floor((SELECT sum(total) FROM totals)::BIGINT * t.share)::BIGINT AS goal
  FROM (VALUES (1, 0.1::DOUBLE), (2, 0.3::DOUBLE), (3, 0.6::DOUBLE)) t(tier, share)
), spread AS (
  SELECT *, coalesce(sum(total) OVER (PARTITION BY tier ORDER BY total / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS paid,
    (sum(weight) OVER (PARTITION BY tier) - coalesce(sum(weight) OVER (PARTITION BY tier ORDER BY total / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest
  FROM weighted, tiers
), levels AS (
  SELECT tier, max((goal - paid) / rest) AS level FROM spread WHERE (goal - paid) * weight::DOUBLE <= total::DOUBLE * rest GROUP BY tier
), budgets AS (
  SELECT source, tier, greatest(CASE WHEN level IS NULL THEN total ELSE least(total, floor(level * weight)::BIGINT) END, 0) AS budget
  FROM spread LEFT JOIN levels USING (tier)
), running AS (
  SELECT source, h, sum(sum(tokens)) OVER (PARTITION BY source ORDER BY h) AS upto FROM keyed GROUP BY source, h
), cuts AS (
  SELECT b.source, tier, coalesce(min(h) FILTER (WHERE upto > budget), 1 << 60) AS below FROM budgets b JOIN running r USING (source) GROUP BY b.source, tier
)
SELECT doc_id, k.source, tokens, min(tier)::INTEGER AS tier FROM keyed k JOIN cuts c ON k.source = c.source AND h < below GROUP BY doc_id, k.source, tokens
"""

_CHATS = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS content,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS m
  FROM {turns} WHERE conv_id IS NOT NULL
), typed AS (
  SELECT *, CASE WHEN ltrim(content) LIKE '[%' AND json_valid(content)
    THEN from_json(content, '[{"type":"VARCHAR","text":"VARCHAR","url":"VARCHAR","width":"INTEGER","height":"INTEGER","seconds":"DOUBLE","pages":"INTEGER"}]') END AS arr
  FROM turns
), parts AS (
  SELECT conv_id, m, role, CASE WHEN len(list_filter(arr, lambda p: p IS NOT NULL)) > 0 AND len(list_filter(arr, lambda p: p IS NOT NULL AND p.type IS NULL)) = 0
    THEN list_filter(arr, lambda p: p IS NOT NULL)
    ELSE [{'type': 'text', 'text': content, 'url': NULL::VARCHAR, 'width': NULL::INTEGER, 'height': NULL::INTEGER, 'seconds': NULL::DOUBLE, 'pages': NULL::INTEGER}] END AS arr
  FROM typed
), each AS (
  SELECT conv_id, m, role, len(arr) AS n, unnest(arr) AS p, unnest(range(len(arr))) AS i FROM parts
), numbered AS (
  SELECT *, p.type IN ('image', 'audio', 'document') AS att,
    sum((p.type IN ('image', 'audio', 'document'))::INTEGER) OVER (PARTITION BY conv_id ORDER BY m, i ROWS UNBOUNDED PRECEDING) AS number FROM each
), shown AS (
  SELECT conv_id, m, i,
    CASE WHEN i = 0 THEN '<|start|>' || replace(regexp_replace(role, '[\r\n]', ' ', 'g'), '<|', '< |') || chr(10) ELSE '' END
    || CASE WHEN att THEN '<|' || p.type || '_' || number || '|>' ELSE replace(coalesce(p.text, ''), '<|', '< |') END
    || CASE WHEN i = n - 1 THEN '<|end|>' || chr(10) ELSE '' END AS s,
    CASE WHEN att THEN number || '|' || p.type || '|' || replace(replace(replace(coalesce(p.url, ''), '|', '%7C'), chr(10), '%0A'), chr(13), '%0D') END AS ref,
    CASE WHEN att THEN 0 ELSE len(regexp_extract_all(coalesce(p.text, ''), '[\p{L}\p{N}]+|[^ \t\r\n\f\p{L}\p{N}]')) END AS text_tokens,
    CASE WHEN NOT att THEN 0
         WHEN p.type = 'image' THEN CASE WHEN p.width > 0 AND p.height > 0 THEN ceil(p.width / 28) * ceil(p.height / 28) ELSE 256 END
         WHEN p.type = 'audio' THEN ceil(coalesce(greatest(p.seconds, 0.0), 30.0) * 12.5)
         ELSE coalesce(greatest(p.pages, 0), 1) * 512 END AS attachment_tokens
  FROM numbered
)
SELECT conv_id, max(m)::BIGINT AS messages, string_agg(s, '' ORDER BY m, i) AS rendered, count(*) AS parts, count(ref) AS attachments,
  coalesce(string_agg(ref, chr(10) ORDER BY m, i), '') AS refs, sum(text_tokens)::BIGINT AS text_tokens,
  (sum(text_tokens) + sum(attachment_tokens) + 4 * max(m))::BIGINT AS expanded_tokens
FROM shown GROUP BY conv_id
"""


def chats_sql(turns: str = "conversations") -> str:
    return _CHATS.replace("{turns}", turns)


SQL["op2_chat_formatting"] = chats_sql()

_URN = "'<urn:uuid:' || concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12)) || '>'"


def _decoded(x: str) -> str:
    """Numeric references, then named ones, of the SQL text ``x``."""
    pattern = r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
    point = "(CASE WHEN lower(r[1]) = 'x' THEN ('0x' || r[2:])::BIGINT ELSE r::BIGINT END)"
    char = f"coalesce(CASE WHEN {point} > 0 AND {point} <= 1114111 AND NOT {point} BETWEEN 55296 AND 57343 THEN chr({point}::INTEGER) ELSE chr(65533) END, '')"
    x = (f"(SELECT string_agg(p || CASE WHEN r IS NULL THEN '' ELSE {char} END, '' ORDER BY i) FROM (SELECT unnest(regexp_split_to_array({x}, '{pattern}')) AS p, "
         f"unnest(regexp_extract_all({x}, '{pattern.replace('(?:', '(')}', 1)) AS r, generate_subscripts(regexp_split_to_array({x}, '{pattern}'), 1) AS i))")
    for entity, plain in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&apos;", "chr(39)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{entity}', {plain})"
    return x


_HIDDEN = r"(?is)<!--.*?(?:-->|\z)" + "".join(rf"|<{e}\b.*?(?:</{e}\s*>|\z)" for e in ("title", "script", "style", "noscript", "template"))
_BREAKS = r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|tr|table|h[1-6]|article|section|header|footer|main|aside|nav|blockquote|pre|form)\b[^>]*(?:>|\z)"
_BARE = f"regexp_replace(regexp_replace(regexp_replace(payload, '{_HIDDEN}', ' ', 'g'), '{_BREAKS}', chr(10), 'g'), '<[A-Za-z/!?][^>]*(?:>|\\z)', '', 'g')"
_PLAIN = rf"regexp_replace(regexp_replace(regexp_replace({_decoded('bare')}, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


def _classes_sql(table: str) -> str:
    """Classes and links of a table of vectors by comparing all pairs."""
    return f"""
WITH RECURSIVE clean AS (
  SELECT DISTINCT vec_id, embedding AS v FROM {table} WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), nodes AS MATERIALIZED (
  SELECT v, min(vec_id) AS rep, count(*) AS copies FROM clean GROUP BY v
), edges AS MATERIALIZED (
  SELECT a.rep AS x, b.rep AS y, b.copies FROM nodes a JOIN nodes b ON a.rep <> b.rep AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) >= 0.9
), reach AS (
  SELECT rep AS x, rep AS y FROM nodes UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
), classes AS (
  SELECT x AS rep, min(y) AS class_id FROM reach GROUP BY x
), links AS (
  SELECT x AS rep, sum(copies) AS others FROM edges GROUP BY x
), placed AS (
  SELECT vec_id, class_id, copies - 1 + coalesce(others, 0) AS links FROM clean JOIN nodes USING (v) JOIN classes USING (rep) LEFT JOIN links USING (rep)
)
SELECT d.vec_id, coalesce(class_id, d.vec_id) AS class_id, coalesce(links, 0)::BIGINT AS links
FROM (SELECT DISTINCT vec_id FROM {table} WHERE vec_id IS NOT NULL) d LEFT JOIN placed p ON d.vec_id = p.vec_id
"""


SQL["op3_embedding_near_dedup"] = _classes_sql("embeddings")

SQL["op4_warc_derivatives"] = rf"""
WITH sources AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, md5('response|' || page_id || '|' || coalesce(url, '')) AS h
  FROM pages WHERE page_id IS NOT NULL
), bared AS (
  SELECT *, {_BARE} AS bare, regexp_extract(payload, '(?is)<title\b[^>]*(?:>|\z)(.*?)(?:</title\s*>|\z)', 1) AS rawtitle FROM sources
), base AS (
  SELECT page_id, target_uri, {_URN.format(h='h')} AS source_id, 'sha256:' || sha256(payload) AS source_digest, strlen(payload) AS source_length,
    {_PLAIN} AS text, regexp_replace({_decoded('rawtitle')}, '[ \t\r\n\f]+', ' ', 'g') AS title,
    lower(regexp_extract(payload, '(?i)<html\b[^<>]*\blang\s*=\s*["'']?([A-Za-z-]+)', 1)) AS html_lang,
    len(regexp_extract_all(payload, '(?i)<a\b[^<>]*\bhref\s*=')) AS links FROM bared
), ids AS (
  SELECT *, md5('conversion|' || source_id) AS hc, md5('metadata|' || source_id) AS hm FROM base
), linked AS (
  SELECT *, {_URN.format(h='hc')} AS conversion_id, {_URN.format(h='hm')} AS metadata_id FROM ids
), each AS (
  SELECT page_id, source_id, target_uri, source_digest, 'conversion' AS record_type, conversion_id AS record_id, 'text/plain; charset=utf-8' AS content_type, text AS block FROM linked
  UNION ALL
  SELECT page_id, source_id, target_uri, source_digest, 'metadata', metadata_id, 'application/warc-fields',
    'title: ' || title || e'\r\nhtml-lang: ' || html_lang || e'\r\noutlinks: ' || links || e'\r\nsource-content-length: ' || source_length
    || e'\r\nsource-payload-digest: ' || source_digest || e'\r\nconversion: ' || conversion_id || e'\r\nconversion-length: ' || strlen(text)
    || e'\r\nsource-http-header: HTTP/1.1 200 OK | Content-Type: text/html; charset=utf-8 | Content-Length: ' || source_length || e'\r\n' FROM linked
), measured AS (
  SELECT *, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest FROM each
)
SELECT page_id, record_type, record_id, source_id AS refers_to, target_uri, content_type, content_length, block_digest, source_digest,
  e'WARC/1.1\r\nWARC-Type: ' || record_type || e'\r\nWARC-Record-ID: ' || record_id || e'\r\nWARC-Date: 2026-01-01T00:00:00Z\r\nWARC-Refers-To: ' || source_id
  || e'\r\nWARC-Target-URI: ' || target_uri || e'\r\nWARC-Block-Digest: ' || block_digest || e'\r\nX-Source-Payload-Digest: ' || source_digest
  || e'\r\nContent-Type: ' || content_type || e'\r\nContent-Length: ' || content_length || e'\r\n\r\n' AS header, block
FROM measured
"""


def sharding_sql(target: int, levels: int) -> str:
    """The k-d tree with ``levels`` levels written out."""
    dims = ("length", "lang", "source", "spread")
    scales = ("1", "1", "1", "1e-9")
    parts = ["""
points AS MATERIALIZED (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, coalesce(length(text), 0)::BIGINT AS length,
    dense_rank() OVER (ORDER BY coalesce(lang, ''))::BIGINT AS lang, dense_rank() OVER (ORDER BY coalesce(source, ''))::BIGINT AS source,
    coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT >> 40, 0) AS spread FROM documents
)""", "whole AS (SELECT " + ", ".join(f"greatest(1, max({d}) - min({d})) AS {d}" for d in dims) + " FROM points)",
        "l0 AS (SELECT *, 1::BIGINT AS leaf FROM points)"]
    for k in range(levels):
        width = [f"(max(p.{d}) - min(p.{d})) / any_value(w.{d})::DOUBLE * {s}" for d, s in zip(dims, scales)]
        pick = " ".join(f"WHEN w{i} = greatest(w0, w1, w2, w3) THEN {i}" for i in range(4))
        value = "CASE dim WHEN 0 THEN length WHEN 1 THEN lang WHEN 2 THEN source ELSE spread END"
        parts += [
            f"s{k} AS (SELECT leaf, sum(p.bytes) AS total, " + ", ".join(f"{w} AS w{i}" for i, w in enumerate(width)) + f" FROM l{k} p, whole w GROUP BY leaf)",
            f"d{k} AS (SELECT leaf, total, CASE {pick} END AS dim FROM s{k} WHERE total > {target} AND greatest(w0, w1, w2, w3) > 0)",
            f"v{k} AS (SELECT leaf, total, {value} AS v, sum(bytes) AS bytes FROM l{k} JOIN d{k} USING (leaf) GROUP BY leaf, total, v)",
            f"u{k} AS (SELECT *, sum(bytes) OVER (PARTITION BY leaf ORDER BY v) AS upto, max(v) OVER (PARTITION BY leaf) AS last FROM v{k})",
            f"c{k} AS (SELECT leaf, coalesce(min(v) FILTER (WHERE 2 * upto >= total), max(v)) AS cut FROM u{k} WHERE v < last GROUP BY leaf)",
            f"l{k + 1} AS MATERIALIZED (SELECT doc_id, bytes, length, lang, source, spread, CASE WHEN cut IS NULL THEN l.leaf ELSE 2 * l.leaf + ({value} > cut)::BIGINT END AS leaf "
            f"FROM l{k} l LEFT JOIN (SELECT c{k}.leaf, cut, dim FROM c{k} JOIN d{k} USING (leaf)) x ON l.leaf = x.leaf)",
        ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, bytes, length, leaf FROM l{levels}"


SQL["op5_kd_sharding"] = sharding_sql(16 << 20, 10)


def _urls_sql(depth: int = 6) -> str:
    variable = r"(?i)^(?:[0-9]+|[0-9a-f]{8,}|[0-9a-f]{8}-[0-9a-f-]{27}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|.*[0-9]{4,}.*)$"
    parts = [r"""
cut AS (
  SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(.*)$', 1) AS rest FROM pages
), hosts AS (
  SELECT page_id, nullif(regexp_replace(regexp_extract(lower(rest), '^(?:[^/?#@]*@)?([^/?#:]*)', 1), '^(?:www|m)\.', ''), '') AS host,
    regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '(?i)\.html?$', ''), '^/+|/+$', '', 'g') AS path FROM cut
), split AS (
  SELECT page_id, host, CASE WHEN host IS NULL OR path = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(path, '/+') END AS raw FROM hosts
), urls AS (
  SELECT page_id, host, CASE WHEN len(raw) <= """ + str(depth) + " THEN raw ELSE raw[1:" + str(depth - 1) + "] || [array_to_string(raw[" + str(depth) + r""":], '/')] END AS segs FROM split
), marks AS (
  SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::BIGINT) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id
), marked AS MATERIALIZED (
  SELECT u.*, m.bad FROM urls u LEFT JOIN marks m USING (page_id)
), t0 AS (
  SELECT host, segs, '' AS template, count(*) AS pages, count(bad)::BIGINT AS labelled, coalesce(sum(bad), 0)::BIGINT AS bad FROM marked WHERE host IS NOT NULL GROUP BY host, segs
)"""]
    for k in range(depth):
        parts += [
            f"b{k} AS (SELECT host, template, segs[{k + 1}] AS seg, sum(pages)::BIGINT AS n, sum(labelled)::BIGINT AS labelled, sum(bad)::BIGINT AS bad, regexp_matches(segs[{k + 1}], '{variable}') AS variable FROM t{k} WHERE len(segs) > {k} GROUP BY host, template, seg)",
            f"n{k} AS (SELECT *, sum((NOT variable)::INTEGER) OVER w AS children, sum(CASE WHEN variable THEN 0 ELSE n END) OVER w AS pages, sum(CASE WHEN variable THEN 0 ELSE labelled END) OVER w AS nl, sum(CASE WHEN variable THEN 0 ELSE bad END) OVER w AS nb FROM b{k} WINDOW w AS (PARTITION BY host, template))",
            f"m{k} AS (SELECT host, template, seg, CASE WHEN variable THEN '*' WHEN children > 1 AND labelled >= 5 AND pow((bad * nl - nb * labelled)::DOUBLE, 2) * nl::DOUBLE <= 3.84::DOUBLE * labelled::DOUBLE * (nl - labelled)::DOUBLE * nb::DOUBLE * (nl - nb)::DOUBLE THEN '~' WHEN children > 1 AND labelled < 5 AND 2 * children > pages THEN '*' ELSE seg END AS name FROM n{k})",
            f"t{k + 1} AS MATERIALIZED (SELECT t.host, t.segs, CASE WHEN m.name IS NULL THEN t.template ELSE t.template || '/' || m.name END AS template, t.pages, t.labelled, t.bad FROM t{k} t LEFT JOIN m{k} m ON t.host = m.host AND t.template = m.template AND t.segs[{k + 1}] = m.seg)",
        ]
    return "WITH " + ",\n".join(parts) + f""",
prior AS (SELECT coalesce(sum(bad), 0)::DOUBLE / greatest(sum(labelled), 1) AS prior FROM t0),
judged AS (
  SELECT host, template, sum(labelled)::BIGINT AS labelled, sum(bad)::BIGINT AS bad, (sum(bad)::BIGINT + 5.0::DOUBLE * any_value(prior)) / (sum(labelled)::BIGINT + 5.0::DOUBLE) AS share FROM t{depth}, prior GROUP BY host, template
)
SELECT page_id, m.host, CASE WHEN t.template = '' THEN '/' ELSE t.template END AS template, j.labelled, j.bad, round(j.share, 6) AS share,
  coalesce(j.labelled >= 5 AND j.share >= 0.4, false) AS rejected
FROM marked m LEFT JOIN t{depth} t ON m.host = t.host AND m.segs = t.segs LEFT JOIN judged j ON t.host = j.host AND t.template = j.template
"""


SQL["op6_url_templates"] = _urls_sql()

SQL["op7_language_id"] = r"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, lang, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents
), chosen AS (
  SELECT lang, ws FROM docs WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) <= 400
), trained AS (
  SELECT lang, unit, count(*) AS c FROM (SELECT lang, unnest(ws) AS unit FROM chosen) GROUP BY lang, unit
), grams AS (
  SELECT n, lang, substr(m, i, n) AS unit, sum(c) AS c
  FROM (SELECT lang, c, m, n, unnest(range(1, length(m) - n + 2)) AS i FROM (SELECT lang, c, '<' || unit || '>' AS m, unnest(range(1, least(5, length(unit) + 2) + 1)) AS n FROM trained))
  GROUP BY n, lang, unit
), units AS MATERIALIZED (
  SELECT 0 AS n, lang, unit, c FROM trained UNION ALL SELECT n, lang, unit, c FROM grams
), totals AS (
  SELECT n, lang, sum(c) AS total FROM units GROUP BY n, lang
), kept AS MATERIALIZED (
  SELECT DISTINCT n, unit FROM (SELECT n, unit FROM units QUALIFY row_number() OVER (PARTITION BY n, lang ORDER BY c DESC, unit) <= CASE WHEN n = 0 THEN 20000 ELSE 10000 END)
), sizes AS (
  SELECT n, count(*) AS size FROM kept GROUP BY n
), model AS MATERIALIZED (
  SELECT n, t.lang, unit, floor(ln((coalesce(c, 0) + 0.5::DOUBLE) / (total::BIGINT + 0.5::DOUBLE * size)) * 1e6 + 0.5)::BIGINT AS logp
  FROM kept JOIN totals t USING (n) JOIN sizes USING (n) LEFT JOIN units u USING (n, lang, unit)
), counted AS MATERIALIZED (
  SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS w FROM docs) GROUP BY doc_id, w
), vocabulary AS MATERIALIZED (
  SELECT DISTINCT w FROM counted
), unseen AS (
  SELECT w, '<' || w || '>' AS m FROM vocabulary WHERE w NOT IN (SELECT unit FROM model WHERE n = 0)
), pieces AS (
  SELECT w, n, substr(m, i, n) AS unit FROM (SELECT w, m, n, unnest(range(1, length(m) - n + 2)) AS i FROM (SELECT w, m, unnest(range(1, least(5, length(m)) + 1)) AS n FROM unseen))
), hits AS MATERIALIZED (
  SELECT w, p.n, lang, floor(sum(logp)::DOUBLE / count(*))::BIGINT - 400000 AS logp FROM pieces p JOIN model m ON p.n = m.n AND p.unit = m.unit GROUP BY w, p.n, lang
), scored AS (
  SELECT unit AS w, lang, logp FROM model WHERE n = 0
  UNION ALL SELECT w, lang, logp FROM hits QUALIFY n = max(n) OVER (PARTITION BY w)
), sums AS (
  SELECT doc_id, lang, sum(c * logp)::BIGINT AS score, sum(c)::BIGINT AS known FROM counted JOIN scored USING (w) GROUP BY doc_id, lang
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r,
    score - coalesce(lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, lang), score) AS ahead FROM sums
)
SELECT d.doc_id, r.lang AS lang_pred, coalesce(score, 0) AS score, coalesce(ahead, 0) AS lead, len(ws)::BIGINT AS words, coalesce(known, 0) AS known,
  coalesce(ahead >= 50000 * known AND known >= 0.5 * len(ws), false) AS kept
FROM docs d LEFT JOIN ranked r ON d.doc_id = r.doc_id AND r.r = 1
"""


def leaks_sql(docs: str = "documents", items: str = "benchmark") -> str:
    """Leaks of a table ``items`` (item_id, text) in a table ``docs`` (doc_id, text)."""
    quoted = lambda words: ", ".join(f"'{w}'" for w in sorted(words))
    return rf"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM {docs} WHERE doc_id IS NOT NULL AND text <> ''
  UNION ALL SELECT 'b', item_id, text FROM {items} WHERE item_id IS NOT NULL AND text <> ''
), raw AS (
  SELECT side, id, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM (SELECT side, id, regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*|\p{{L}}+|[.!?\n]+') AS toks FROM texts)
), kinds AS (
  SELECT *, CASE WHEN regexp_matches(tok, '^[0-9]') THEN 0 WHEN regexp_matches(tok, '^[.!?\n]') THEN 2 ELSE 1 END AS kind,
    substr(tok, 1, 1) <> lower(substr(tok, 1, 1)) AND (length(tok) = 1 OR tok <> upper(tok)) AS capital FROM raw
), typed AS (
  SELECT *, lag(kind, 1, 2) OVER (PARTITION BY side, id ORDER BY i) AS before FROM kinds
), canon AS (
  SELECT side, id, lower(tok) AS tok, row_number() OVER (PARTITION BY side, id ORDER BY i) - 1 AS pos,
    CASE WHEN kind = 0 THEN 0 WHEN before = 0 AND lower(tok) IN ({quoted(UNITS)}) THEN 1 WHEN capital AND before <> 2 THEN 2 WHEN capital THEN 3 ELSE 9 END AS slot
  FROM typed WHERE kind <> 2
), whole AS MATERIALIZED (
  SELECT side, id, kind, list(CASE WHEN slot > last THEN tok ELSE (['<NUM>', '<UNIT>', '<NAME>', '<NAME>'])[slot + 1] END ORDER BY pos) AS t,
    list(CASE WHEN slot > last THEN '' ELSE least(slot, 2) || ':' || tok END ORDER BY pos) AS v, count(*) AS n
  FROM canon, (VALUES (0, 2), (1, 3), (2, 1), (3, -1)) k(kind, last) GROUP BY side, id, kind
), ispans AS (
  SELECT id, kind, size, t[p + 1 : p + size] AS t, v[p + 1 : p + size] AS v, p AS pos
  FROM (SELECT *, unnest(range(n - size + 1)) AS p FROM (SELECT *, CASE WHEN kind = 3 THEN n ELSE least(8, n) END AS size FROM whole WHERE side = 'b' AND (kind = 3 OR n >= 5)))
), usable AS (
  SELECT id, kind, size, array_to_string(t, ' ') AS k, list_filter(v, lambda x: x <> '') AS slots, pos FROM ispans WHERE 2 * len(list_filter(v, lambda x: x = '')) >= size
), iwindows AS MATERIALIZED (
  SELECT *, count(*) OVER (PARTITION BY id, kind) AS total FROM usable WHERE kind < 3 OR id NOT IN (SELECT id FROM usable WHERE kind < 3)
), dspans AS (
  SELECT id, kind, size, array_to_string(t[p + 1 : p + size], ' ') AS k, list_filter(v[p + 1 : p + size], lambda x: x <> '') AS slots, p AS pos
  FROM (SELECT w.*, s.size, unnest(range(n - s.size + 1)) AS p FROM whole w JOIN (SELECT DISTINCT kind, size FROM iwindows) s ON w.kind = s.kind AND w.n >= s.size WHERE side = 'd')
), met AS (
  SELECT kind, d.id AS doc_id, b.id AS item_id, d.pos - b.pos AS offs, b.pos AS ipos, total, b.slots AS bs, d.slots AS ds
  FROM dspans d JOIN iwindows b USING (kind, size, k)
), pairs AS MATERIALIZED (
  SELECT DISTINCT kind, doc_id, item_id, offs, bv, dv FROM (SELECT kind, doc_id, item_id, offs, unnest(bs) AS bv, unnest(ds) AS dv FROM met)
), broken AS (
  SELECT DISTINCT p.kind, p.doc_id, p.item_id, p.offs, p.bv FROM pairs p LEFT JOIN pairs q ON p.kind = q.kind AND p.doc_id = q.doc_id AND p.item_id = q.item_id AND p.offs = q.offs
  WHERE (q.bv = p.bv AND q.dv <> p.dv) OR (q.dv = p.dv AND q.bv <> p.bv AND p.bv LIKE '2:%')
    OR (p.bv <> p.dv AND p.bv LIKE '2:%' AND (substr(p.bv, 3) IN ({quoted(OPENERS)}) OR substr(p.dv, 3) IN ({quoted(OPENERS)})))
), lost AS (
  SELECT DISTINCT kind, doc_id, item_id, offs, ipos FROM (SELECT *, unnest(bs) AS bv FROM met) m JOIN broken b USING (kind, doc_id, item_id, offs, bv)
), joined AS (
  SELECT kind, doc_id, item_id, count(DISTINCT ipos) AS matched, max(total) AS total, bool_or(bs <> ds) AS reparameterised
  FROM met ANTI JOIN lost USING (kind, doc_id, item_id, offs, ipos) GROUP BY kind, doc_id, item_id
)
SELECT doc_id, item_id, matched, total, round(matched / total, 4) AS coverage, reparameterised FROM joined WHERE matched / total >= 0.5
QUALIFY kind = min(kind) OVER (PARTITION BY doc_id, item_id)
"""


SQL["op9_benchmark_decontamination"] = leaks_sql()

# The operators over tables derived from the given ones, in which there is what
# these lack: typed parts, near vectors, many leaves, re-parameterised items.

#: Content of a turn by its number: parts of every type, with and without sizes.
TYPED = """CASE conv_id % 3 + turn % 2
  WHEN 0 THEN '[{"type":"text","text":"' || role || '"},{"type":"image","url":"i' || turn || '.png","width":' || (turn * 100 + 1) || ',"height":57},{"type":"audio","url":"a|b","seconds":' || turn || '.5}]'
  WHEN 1 THEN '[{"type":"document","pages":' || (turn + 2) || '},null,{"type":"other","text":"<|end|>"},{"type":"image"},{"type":"audio"}]'
  WHEN 2 THEN text ELSE '[' || text END"""
SQL["chat_typed_parts"] = chats_sql(f"(SELECT conv_id, turn, role, {TYPED} AS text FROM conversations)")

SQL["embedding_planted_copies"] = _classes_sql("(SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000000, list_transform(embedding, lambda x, i: (x * (1 + (i % 3) * 0.0625))::FLOAT) FROM embeddings WHERE vec_id IS NOT NULL)")

#: Bytes of a leaf that give more than fifty at sf0.01.
SMALL_LEAF = 40_000
SQL["sharding_small_leaves"] = sharding_sql(SMALL_LEAF, 14)

SQL["decontamination_renumbered"] = leaks_sql("(SELECT doc_id, replace(text, ' of ', ' 7 km of ') AS text FROM documents)", "(SELECT item_id, replace(text, ' of ', ' 12 km of ') AS text FROM benchmark)")
