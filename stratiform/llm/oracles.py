"""DuckDB SQL for the rows of those queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WS = r"[ \t\n\x0b\f\r]+"

_NORMAL = "trim(regexp_replace(" + _LOWER + f", '{_WS}', ' ', 'g'))"

OP7 = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, text IS NULL AS no_text FROM conversations
), split AS (
  SELECT *, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM src
), parts AS (
  SELECT *, regexp_replace(array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10)), '^{_WS}|{_WS}$', '', 'g') AS own_text FROM split
), line AS (
  SELECT conv_id, turn, md5(text) AS k, i AS pos, lines[i] AS line
  FROM (SELECT DISTINCT conv_id, turn, text, lines FROM parts WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND NOT no_text), unnest(range(1, len(lines) + 1)) AS u(i)
), leveled AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)[ \t]?', 1), '[ \t]', '', 'g')) AS level,
    regexp_replace(line, '^((?:[ \t]*>)+)[ \t]?', '') AS body FROM line
), marked AS (
  SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY conv_id, turn, k ORDER BY pos) THEN 1 ELSE 0 END AS new FROM leveled
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id, turn, k ORDER BY pos) AS run FROM marked
), passage AS (
  SELECT conv_id, turn, k, run, level, {_NORMAL.format("string_agg(body, ' ' ORDER BY pos)")} AS t
  FROM runs WHERE level > 0 GROUP BY ALL
), unit AS (
  SELECT DISTINCT conv_id, turn, {_NORMAL.format("u")} AS t
  FROM parts, unnest(list_concat([own_text], list_concat(regexp_split_to_array(own_text, '\n[ \t]*\n'), string_split(own_text, chr(10))))) AS x(u)
), whole AS (
  SELECT p.conv_id, p.turn, p.k, p.run, p.level, p.t, max(o.turn) AS found
  FROM passage p LEFT JOIN unit o ON o.conv_id = p.conv_id AND o.t = p.t AND o.turn < p.turn
  WHERE p.t <> '' GROUP BY ALL
), own_lines AS (
  SELECT conv_id, turn, list_filter([{_NORMAL.format("x")} FOR x IN string_split(own_text, chr(10))], lambda x: x <> '') AS l
  FROM parts WHERE conv_id IN (SELECT conv_id FROM whole WHERE found IS NULL)
), line_run AS (
  SELECT DISTINCT conv_id, turn, array_to_string(l[i:j], ' ') AS t
  FROM (SELECT *, unnest(range(i + 1, len(l) + 1)) AS j FROM (SELECT *, unnest(range(1, len(l))) AS i FROM own_lines))
), found AS (
  SELECT w.conv_id, w.turn, w.k, w.run, w.level, coalesce(w.found, max(r.turn)) AS found
  FROM whole w LEFT JOIN line_run r ON w.found IS NULL AND r.conv_id = w.conv_id AND r.t = w.t AND r.turn < w.turn
  GROUP BY w.conv_id, w.turn, w.k, w.run, w.level, w.t, w.found
), counts AS (
  SELECT conv_id, turn, k, count(*) AS n_quotes, count(found) AS n_linked FROM found GROUP BY ALL
), lowest AS (
  SELECT conv_id, turn, min(level) AS level FROM found WHERE found IS NOT NULL GROUP BY ALL
), best AS (
  SELECT conv_id, turn, max(found) AS found FROM found JOIN lowest USING (conv_id, turn, level) GROUP BY ALL
), turns AS (
  SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous
  FROM (SELECT DISTINCT conv_id, turn FROM src WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
), parents AS (
  SELECT conv_id, turn, coalesce(found, previous) AS reply_to FROM turns LEFT JOIN best USING (conv_id, turn)
), deep AS (
  SELECT conv_id, turn, reply_to, 0 AS depth FROM parents WHERE reply_to IS NULL
  UNION ALL
  SELECT p.conv_id, p.turn, p.reply_to, d.depth + 1 FROM parents p JOIN deep d ON p.conv_id = d.conv_id AND p.reply_to = d.turn
)
SELECT p.conv_id, p.turn, p.role, p.own_text, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, reply_to, coalesce(depth, 0)::BIGINT AS depth
FROM parts p LEFT JOIN deep d ON d.conv_id = p.conv_id AND d.turn = p.turn
LEFT JOIN counts c ON c.conv_id = p.conv_id AND c.turn = p.turn AND c.k = md5(p.text)
"""

OP8 = rf"""
WITH item AS (
  SELECT DISTINCT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), window_ AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+12], ' ') AS t, len(w[i:i+12]) AS n
  FROM item, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS u(i) WHERE len(w) > 0
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), at_ AS (
  SELECT r, i, n, array_to_string(w[i:i+n-1], ' ') AS t
  FROM doc, (SELECT DISTINCT n FROM window_) AS s, unnest(range(1, len(w) - n + 2)) AS u(i)
), hit AS (
  SELECT r, i, n, item_id FROM at_ JOIN window_ USING (t, n)
), words AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(j) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP10 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM d
)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN last IS NULL OR page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last IS NULL OR page_id IS NOT DISTINCT FROM last THEN NULL ELSE last END AS refers_to
FROM g
"""

OP6 = """
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT r, p, md5_number(substr(h, (2 * p + 1)::BIGINT, 400)) AS k FROM doc, unnest(range(0, length(h) // 2 - 199)) AS u(p) WHERE length(h) >= 400
), repeated AS (
  SELECT r, p FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM strings) WHERE n > 1
), marked AS (
  SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 1 ELSE 0 END AS new FROM repeated
), runs AS (
  SELECT r, min(p) AS s, max(p) + 200 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY p) AS run FROM marked) GROUP BY r, run
), gaps AS (
  SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM runs
), cut AS (
  SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (s - before))::BIGINT), '' ORDER BY s) AS kept
  FROM gaps JOIN doc USING (r) GROUP BY r
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM doc LEFT JOIN cut USING (r)
"""

OP9 = rf"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[i:i+4], ' ') AS s FROM doc, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS u(i) WHERE len(w) > 0
), size AS (
  SELECT r, count(*) AS n FROM shingle GROUP BY r
), pair AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM shingle a JOIN shingle b USING (s) WHERE a.r < b.r GROUP BY ALL
), link AS MATERIALIZED (
  SELECT a, b FROM pair JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), edge AS MATERIALIZED (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT r, r AS other FROM doc UNION SELECT reach.r, edge.b FROM reach JOIN edge ON edge.a = reach.other
)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM doc d JOIN reach USING (r) JOIN doc o ON o.r = reach.other LEFT JOIN size ON size.r = d.r GROUP BY d.r, d.doc_id
"""



def _codes_sql(rounds: int = 6) -> str:
    """Codebooks round by round: ``book`` (part, entry, position, x), ``near`` (vector, part, entry, squared distance)."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, p, min(d * 16 + k) % 16 AS k, min(d * 16 + k) // 16 AS d
  FROM (SELECT c.vec_id, c.p, b.k, sum((c.x - b.x) * (c.x - b.x)) AS d FROM comp c JOIN book{r} b USING (p, j) GROUP BY ALL) GROUP BY ALL
)""")
        if r < rounds:
            steps.append(f"""
moved{r} AS (
  SELECT p, j, k, (s - ((s % n) + n) % n) // n AS x FROM (SELECT p, j, n2.k, sum(x) AS s, count(*) AS n FROM comp JOIN near{r} n2 USING (vec_id, p) GROUP BY ALL)
), book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.j, b.k, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN moved{r} m USING (p, j, k)
)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v, len(embedding) // 8 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), comp AS MATERIALIZED (
  SELECT vec_id, i // w AS p, i % w AS j, v[i + 1] AS x FROM (SELECT *, unnest(range(len(v))) AS i FROM kept)
), book0 AS MATERIALIZED (
  SELECT p, j, k, x FROM comp JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT 16) USING (vec_id)
), {", ".join(steps)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(k AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY ALL
), digest AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""


OP11 = _codes_sql()

ORACLES = {"op6_suffix_dedup": OP6, "op7_quotation_links": OP7, "op8_wu_manber": OP8, "op9_ngram_join": OP9, "op10_warc_reader": OP10, "op11_vector_codes": OP11}
