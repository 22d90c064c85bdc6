"""DuckDB twins of the corpus queries that SQL can express."""

from jobstrata.llm.mixing import INNER, MULTIPLIERS, PRIME, ROUNDS

_WS = r"[^\x20\x09-\x0D]"


def _measure(scale: int, top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 0 ELSE ({scale} * {top}) // {bottom} END"


def _bucket(name: str) -> str:
    return f"(({name} >> greatest(len(bin({name})) - 7, 0)::BIGINT) << greatest(len(bin({name})) - 7, 0)::BIGINT)"


def _at(name: str, q: int) -> str:
    return f"(CASE WHEN o.n >= 100 THEN o.{name}_{q} WHEN l.n >= 100 THEN l.{name}_{q} ELSE g.{name}_{q} END)"


def _fence(name: str, width: int) -> str:
    return f"{width} * ({_at(name, 75)} - {_at(name, 25)})"


_ONCE = f"1000 // {_at('n_words', 50)}"


def _above(name: str) -> str:
    return f"{_at(name, 99)} + ({_at(name, 99)} - {_at(name, 95)}) // 2 + {_ONCE}"


_M = ("symbol_rate", "word_length", "repeat_rate", "dup_line_rate", "n_words")


def _percentiles(keys: str) -> str:
    """Per group of ``keys`` (a SELECT list prefix ending with a comma, or empty)."""
    by = f"PARTITION BY {keys}measure"
    found = ", ".join(f"min(CASE WHEN measure = '{m}' AND 100 * through >= {q} * whole THEN bucket END) AS {m}_{q}" for m in _M for q in (25, 50, 75, 95, 99))
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    return f"""SELECT {keys} max(whole) AS n, {found} FROM (
        SELECT *, sum(c) OVER ({by} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS through, sum(c) OVER ({by}) AS whole
        FROM (SELECT {keys} measure, bucket, sum(c) AS c FROM sketch GROUP BY {keys} measure, bucket)) {group}"""


OP1 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT r, doc_id, lang, source, regexp_extract_all(text, '{_WS}+') AS w,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WS}')) AS lines
  FROM docs),
windows AS (
  SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
counts AS (
  SELECT s.r, doc_id, lang, source, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN repeats USING (r)),
rates AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {_measure(1000, 'n_symbols', 'n_words')} AS symbol_rate, {_measure(100, 'word_chars', 'n_words')} AS word_length,
    {_measure(1000, 'n_repeat_words', 'n_words')} AS repeat_rate, {_measure(1000, 'n_dup_lines', 'n_lines')} AS dup_line_rate
  FROM counts),
sketch AS (
  SELECT lang, source, measure, (v >> s) << s AS bucket, count(*) AS c FROM (
    SELECT lang, source, measure, v, greatest(len(bin(v)) - 7, 0)::BIGINT AS s FROM (
      SELECT lang, source, unnest({list(_M)!r}) AS measure, unnest([{', '.join(_M)}])::BIGINT AS v FROM rates WHERE NOT base_failed))
  GROUP BY ALL),
own AS ({_percentiles('lang, source, ')}), bylang AS ({_percentiles('lang, ')}), overall AS ({_percentiles('')}),
limits AS (
  SELECT o.lang, o.source, {_at('symbol_rate', 75)} + {_fence('symbol_rate', 3)} + {_ONCE} AS max_symbol_rate,
    {_at('word_length', 75)} + {_fence('word_length', 6)} AS max_word_length, {_at('word_length', 25)} - {_fence('word_length', 6)} AS min_word_length,
    {_above('repeat_rate')} AS max_repeat_rate, {_above('dup_line_rate')} AS max_dup_line_rate
  FROM own o LEFT JOIN bylang l ON l.lang IS NOT DISTINCT FROM o.lang CROSS JOIN overall g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND {_bucket('word_length')} BETWEEN min_word_length AND max_word_length AND {_bucket('symbol_rate')} <= max_symbol_rate
    AND {_bucket('repeat_rate')} <= max_repeat_rate AND {_bucket('dup_line_rate')} <= max_dup_line_rate, false) AS kept
FROM rates r LEFT JOIN limits m ON r.lang IS NOT DISTINCT FROM m.lang AND r.source IS NOT DISTINCT FROM m.source
"""

_TOKENS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, w, least(len(w), 10) AS l FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, l, w[i:i + l - 1] AS k FROM (SELECT item_id, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM items)),
lengths AS (SELECT DISTINCT l FROM windows),
probes AS (SELECT r, i, l, w[i:i + l - 1] AS k FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM docs CROSS JOIN lengths WHERE len(w) >= l)),
hits AS (SELECT r, i, l, item_id FROM probes JOIN windows USING (l, k)),
hit_words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words h USING (r) LEFT JOIN hit_items t USING (r)
"""


def _key(use: int, turn: int, shift: str) -> str:
    return f"(({turn * MULTIPLIERS[use]} + ({shift} % {PRIME}) * {MULTIPLIERS[(use + 1) % 4]} + {7919 * (use + 1)}) % {PRIME - 1} + 1)"


def _permuted(rows: str, keep: str, size: str, shift: str) -> str:
    """``keep`` and column pos of ``rows``, with pos permuted within 0 .. size - 1: one nested SELECT per round and step."""
    for turn in range(1, ROUNDS + 1):
        centre = f"({_key(0, turn, shift)} * {_key(1, turn, shift)}) % {size}"
        rows = f"SELECT *, ({centre} - pos + {size}) % {size} AS mirror FROM ({rows})"
        rows = f"SELECT *, greatest(pos, mirror) AS pair FROM ({rows})"
        factor, offset = _key(2, turn, shift), _key(3, turn, shift)
        bits = f"((pair % {PRIME} * {factor} + {offset}) % {PRIME} % {INNER} * {factor} + {offset}) % {PRIME}"
        rows = f"SELECT {keep}, CASE WHEN ({bits}) // 256 % 2 = 1 THEN mirror ELSE pos END AS pos FROM ({rows})"
    return rows


OP10 = rf"""
WITH RECURSIVE sized AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WS}+'))::BIGINT AS size FROM documents),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop,
    sum(size) OVER (PARTITION BY source)::BIGINT AS source_size FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source),
fill(step, source, target, open) AS (
  SELECT 0, source, 0.0::DOUBLE, true FROM sources
  UNION ALL
  SELECT step + 1, source, least(t, 2.0 * source_size), t < 2.0 * source_size FROM (
    SELECT step, f.source, s.source_size, open, CASE WHEN open THEN
        (1.5 * (SELECT sum(source_size) FROM sources) - coalesce(sum(CASE WHEN NOT open THEN target END) OVER (), 0.0))
        * weight / sum(CASE WHEN open THEN weight END) OVER () ELSE target END AS t
    FROM fill f JOIN sources s ON f.source IS NOT DISTINCT FROM s.source WHERE step < 30)),
drawn AS (
  SELECT s.source, s.source_size, place, target, ceil(s.source_size / 64.0)::BIGINT AS blocks,
    least(round(target * ceil(s.source_size / 64.0) / s.source_size)::BIGINT, 2 * ceil(s.source_size / 64.0)::BIGINT) AS draws
  FROM sources s JOIN fill f ON f.source IS NOT DISTINCT FROM s.source WHERE step = 30),
slots AS (SELECT source, place, blocks, unnest(range(draws)) AS nth FROM drawn WHERE source_size > 0),
turns AS (SELECT source, blocks, nth % blocks AS pos, 7 + 104729 * place + 15485863 * (nth // blocks) AS shift FROM slots),
taken AS (SELECT source, pos AS block, count(*) AS times FROM ({_permuted("SELECT * FROM turns", "source, blocks, shift", "blocks", "shift")}) GROUP BY ALL),
cut AS (SELECT r, source, stop - size AS begin, stop, unnest(range((stop - size) // 64, (stop - 1) // 64 + 1)) AS block FROM placed WHERE size > 0),
sums AS (
  SELECT r, sum(times * (least(stop, (c.block + 1) * 64) - greatest(begin, c.block * 64))) AS taken
  FROM cut c JOIN taken t ON c.source IS NOT DISTINCT FROM t.source AND c.block = t.block GROUP BY r)
SELECT doc_id, size, p.source_size, round(target, 6) AS target, coalesce(taken, 0)::BIGINT AS taken
FROM placed p JOIN drawn d ON p.source IS NOT DISTINCT FROM d.source LEFT JOIN sums USING (r)
"""

OP2 = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
strings AS (SELECT r, doc_id, p, substring(h, 2 * p + 1, 200) AS s FROM (SELECT r, doc_id, h, unnest(range(n - 99)) AS p FROM docs WHERE n >= 100)),
firsts AS (SELECT s, min((doc_id, p)) AS f, count(*) AS c FROM strings GROUP BY s HAVING count(*) > 1),
again AS (SELECT r, p FROM strings JOIN firsts USING (s) WHERE (doc_id, p) <> f),
marked AS (SELECT r, p, CASE WHEN p > lag(p) OVER w + 100 OR lag(p) OVER w IS NULL THEN 1 ELSE 0 END AS head FROM again WINDOW w AS (PARTITION BY r ORDER BY p)),
spans AS (
  SELECT r, min(p) AS a, max(p) + 100 AS b, row_number() OVER (PARTITION BY r ORDER BY min(p)) AS k
  FROM (SELECT r, p, sum(head) OVER (PARTITION BY r ORDER BY p) AS g FROM marked) GROUP BY r, g),
edges AS (SELECT r, k, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY k), 0) AS since FROM spans),
removed AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(b) AS last,
  string_agg(substring(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY k) AS head FROM edges JOIN docs USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN removed USING (r)
"""

_HOST = "translate(regexp_extract(substring({0}, instr({0}, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_RULES = " ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p in (("example.org", "/en/1"), ("example.org", "/es/"), ("org", "/"), ("com", "/fr/"), ("com", "/de/")))

OP4 = f"""
WITH RECURSIVE placed AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN {_HOST.format('url')} ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substring(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
ruled AS (SELECT *, CASE {_RULES} END AS rule FROM placed),
judged AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own FROM ruled),
seeds AS (SELECT host, count(CASE WHEN own = 'allow' THEN 1 END)::DOUBLE AS t0, count(CASE WHEN own = 'block' THEN 1 END)::DOUBLE AS d0 FROM judged GROUP BY host),
links AS (SELECT host AS src, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link
  FROM (SELECT host, unnest(list_distinct(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?([^"''\\s>]+)', 1))) AS link FROM placed) WHERE contains(link, '//')),
linked AS (SELECT src, CASE WHEN instr(link, '://') > 0 THEN {_HOST.format('link')} ELSE '' END AS dst FROM links),
above AS (SELECT host, k, array_to_string(string_split(host, '.')[k + 1:], '.') AS parent FROM (SELECT host, unnest(range(1, len(string_split(host, '.')))) AS k FROM seeds WHERE host <> '')),
nearest AS (SELECT host, arg_min(parent, k) AS parent FROM above WHERE parent IN (SELECT host FROM seeds) AND parent <> '' GROUP BY host),
edges AS (SELECT src, dst, count(*)::DOUBLE AS w FROM (
  SELECT src, dst FROM linked WHERE src <> '' AND dst <> '' AND src <> dst UNION ALL SELECT host, parent FROM nearest) GROUP BY ALL),
nodes AS (SELECT src AS host FROM edges UNION SELECT dst FROM edges UNION SELECT host FROM seeds),
base AS (SELECT host, coalesce(t0, 0) AS t0, coalesce(d0, 0) AS d0 FROM nodes LEFT JOIN seeds USING (host)),
flows AS (
  SELECT src AS host, dst AS dest, 0.85 * w / sum(w) OVER (PARTITION BY src) AS ft, 0.0 AS fd, 0.0 AS ct, 0.0 AS cd FROM edges
  UNION ALL SELECT dst, src, 0.0, 0.85 * w / sum(w) OVER (PARTITION BY dst), 0.0, 0.0 FROM edges
  UNION ALL SELECT host, host, 0.0, 0.0, (1 - 0.85) * t0, (1 - 0.85) * d0 FROM base),
ranks(step, host, t, d) AS (
  SELECT 0, host, t0::DOUBLE, d0::DOUBLE FROM base
  UNION ALL
  SELECT step + 1, dest, sum(t * ft + ct)::DOUBLE, sum(d * fd + cd)::DOUBLE FROM ranks JOIN flows USING (host) WHERE step < 8 GROUP BY step, dest)
SELECT page_id, j.host, path, rule, coalesce(own, CASE WHEN round(d, 9) > round(t, 9) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN (SELECT host, t, d FROM ranks WHERE step = 8) USING (host)
"""

OP7 = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, w[i:i + l - 1] AS s FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM (SELECT doc_id, w, least(len(w), 5) AS l FROM docs WHERE len(w) > 0))),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached(top, doc_id) AS (SELECT doc_id, doc_id FROM docs UNION SELECT top, b FROM reached JOIN ways ON a = reached.doc_id WHERE b > top)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(top) AS component_id, min(top) = doc_id AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""

OP12 = rf"""
WITH marks AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '{_WS}+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
docs AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN least < doc_id THEN 16 ELSE 0 END) AS failed
  FROM split LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM docs GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM letters a, letters b, letters d, letters e, letters f
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS filter, substring(filter_order, 1, step - 1) AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
placed AS (
  SELECT filter_order, step::INTEGER AS step, filter, 1 << (instr('ABCDE', filter) - 1) AS own, list_sum([CASE WHEN contains(before, x) THEN 1 << (instr('ABCDE', x) - 1) ELSE 0 END FOR x IN ['A', 'B', 'C', 'D', 'E']])::INTEGER AS before
  FROM steps),
rows AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN failed & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN failed & own <> 0 AND failed & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN failed & own <> 0 AND failed & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failed = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN failed & own <> 0 AND failed & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN failed & own <> 0 AND failed & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, placed GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM rows
"""

SQL: dict[str, str] = {
    "op1_quality_rules": OP1, "op2_repeated_spans": OP2, "op3_decontamination": OP3, "op4_url_filter": OP4, "op7_near_duplicates": OP7, "op10_mixing": OP10,
    "op12_filter_audit": OP12,
}
