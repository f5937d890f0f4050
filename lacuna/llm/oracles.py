"""DuckDB SQL with the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

#: (verdict, host, path) of the URL rules.
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
NIBBLES = "0000000100100011010001010110011110001001101010111100110111101111"
BLANKS = r"[^\x20\x09-\x0D]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _low(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def _url_rules() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    rest = "substr(url, strpos(url, '://') + 3)"
    host = _low(f"regexp_extract({rest}, '^[^/?#]*')")
    return f"""
    WITH rules(v, h, p) AS (VALUES {rules}),
    parts AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN {host} ELSE '' END AS host,
             CASE WHEN strpos(url, '://') > 0 THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
      FROM pages),
    fits AS (
      SELECT parts.*, v, h, p, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
      FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
    SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM fits WHERE k = 1"""


def _warc() -> str:
    bits = f"array_to_string(list_transform(string_split(sha1(payload), ''), lambda c: substr('{NIBBLES}', 4 * strpos('0123456789abcdef', c) - 3, 4)), '')"
    value = " + ".join(f"{16 >> k} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5))
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    d AS (SELECT page_id, payload, {bits} AS bits, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
    SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', 1 + {value}, 1)), '') AS payload_digest,
           CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> last THEN last END AS refers_to
    FROM d"""


def _decontaminate() -> str:
    words = f"regexp_extract_all({_low('text')}, '{WORD}')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
    b AS (SELECT item_id, coalesce({words}, []) AS w FROM benchmark),
    i AS (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM b WHERE len(w) > 0),
    pattern AS (SELECT DISTINCT item_id, size, array_to_string(w[k : k + size - 1], ' ') AS s FROM i),
    sizes AS (SELECT DISTINCT size FROM pattern),
    place AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size),
    hit AS (
      SELECT doc_id, k, x.size, item_id FROM (SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS s FROM place) x
      JOIN pattern ON pattern.s = x.s AND pattern.size = x.size),
    n AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS spot FROM hit) GROUP BY doc_id),
    it AS (
      SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""


def _jaccard() -> str:
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_low('text')}, '{BLANKS}'), []) AS w FROM documents),
    place AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS k FROM d WHERE len(w) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS g FROM place),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    sized AS (SELECT s.*, n FROM s JOIN n USING (doc_id)),
    link AS (
      SELECT a.doc_id AS x, b.doc_id AS y FROM sized a JOIN sized b ON a.g = b.g AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
    reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
    SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.y) AS component_id
    FROM d JOIN reach ON reach.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""


def _line_quality() -> str:
    return f"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{BLANKS}') AS w FROM documents),
    word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
    place AS (
      SELECT doc_id, k, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS g
      FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
    win AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM place WHERE g IS NOT NULL),
    rep AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS spot FROM win WHERE c > 1) GROUP BY doc_id),
    line AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw FROM d),
    real_line AS (SELECT *, regexp_extract_all({_low('raw')}, '{BLANKS}') AS lw FROM line WHERE regexp_matches(raw, '{BLANKS}')),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM real_line GROUP BY doc_id),
    normal AS (SELECT doc_id, source, text, array_to_string(lw, ' ') AS l, len(lw) AS words FROM real_line),
    host AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
    often AS (
      SELECT n.source, l FROM (SELECT source, l, count(DISTINCT text) AS c FROM normal GROUP BY source, l) n JOIN host USING (source)
      WHERE c > 10 AND c > 0.001 * docs),
    lost AS (SELECT doc_id, sum(words) AS n FROM normal JOIN often USING (source, l) GROUP BY doc_id),
    m AS (
      SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             CAST(len(w) - coalesce(lost.n, 0) AS BIGINT) AS n_left
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_left >= 0.3 * n_words AS kept
    FROM m"""


def _collocations() -> str:
    return rf"""
    WITH piece AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex({_low("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
    place AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM words, (VALUES (1), (2), (3)) AS sizes(size) WHERE len(w) >= size),
    f AS (SELECT lang, size, w[k : k + size - 1] AS p, count(*) AS f FROM place GROUP BY ALL),
    total AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
    cand AS (SELECT * FROM f WHERE size > 1 AND f >= 10),
    cut AS (
      SELECT c.lang, c.p, c.f AS a, x.f AS l, y.f AS r, k, CAST(1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c
      JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1 : c.size]),
    best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
    held AS (SELECT lang, p, max(f) AS f FROM (SELECT lang, p[1 : 2] AS p, f FROM cand WHERE size = 3 UNION ALL SELECT lang, p[2 : 3], f FROM cand WHERE size = 3) GROUP BY lang, p),
    kept AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.p = b.p WHERE h.f IS NULL OR 100 * h.f < 50 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
    FROM kept JOIN total USING (lang) QUALIFY rank <= 2000"""


def _filter_audit() -> str:
    tests = (
        "len(w) < 50",
        "100 * len(list_distinct(w)) < 65 * len(w)",
        "100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t)",
        "regexp_matches(t, '[#$%&*|]')",
        "doc_id > min(doc_id) OVER (PARTITION BY t)",
    )
    bits = " + ".join(f"CASE WHEN {test} THEN {1 << k} ELSE 0 END" for k, test in enumerate(tests))
    letters = "['A', 'B', 'C', 'D', 'E']"
    return f"""
    WITH d AS (
      SELECT doc_id, coalesce(source, '') AS part, {bits} AS failed
      FROM (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{BLANKS}') AS w FROM documents)),
    marks AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
    combo AS (SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM d LEFT JOIN marks USING (doc_id) GROUP BY part, failed),
    letter AS (SELECT unnest({letters}) AS x, unnest(range(5)) AS k),
    orders AS (
      SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks
      FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
    step AS (SELECT filter_order, CAST(s AS INTEGER) AS step, 1 << ks[s]::INTEGER AS bit, coalesce(list_sum(list_transform(ks[1 : s - 1], lambda k: 1 << k::INTEGER)), 0)::INTEGER AS before
      FROM (SELECT *, unnest(range(1, 6)) AS s FROM orders)),
    result AS (
      SELECT part, filter_order, step, bit, sum(CASE WHEN failed & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN failed & before > 0 AND failed & bit > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN failed & before = 0 AND failed & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM combo, step GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
    FROM result"""


def _fingerprints() -> str:
    blank, no_blank, plain = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", r"[^\x20\x09-\x0D.!?,;:]"
    leaf = f"{blank}*(?:{no_blank}{{0,63}}{plain}{blank}+){{0,3}}{no_blank}{{1,64}}{blank}*|{blank}+"
    section, paragraph = r"(?:[^\n]|\n[^\n])+\n*|\n+", r"[^\n]*\n|[^\n]+"

    def tree(text: str) -> str:
        leaves = f"list_transform(regexp_extract_all(p, '{leaf}'), lambda x: sha256(x))"
        return f"list_transform(regexp_extract_all({text}, '{section}'), lambda s: list_transform(regexp_extract_all(s, '{paragraph}'), lambda p: {leaves}))"

    node = "sha256(array_to_string({0}, ''))"
    digests = "list_transform({0}, lambda {1}: {2})"
    of_paragraph = node.format("p")
    of_section = node.format(digests.format("s", "p", of_paragraph))
    of_root = node.format(digests.format("tree", "s", of_section))
    prints = "array_to_string(list_transform(p, lambda x: substr(x, 1, 6)), ',')"
    paragraphs = f"array_to_string(list_transform(s, lambda p: substr({of_paragraph}, 1, 8) || '=' || {prints}), ';')"
    sections = f"array_to_string(list_transform(tree, lambda s: '|' || substr({of_section}, 1, 8) || ':' || {paragraphs}), '')"

    def likeness(a: str, b: str) -> str:
        left, right = (f"list_distinct(regexp_extract_all({x}, '[=,]([0-9a-f]{{6}})', 1))" for x in (a, b))
        both = f"(len({left}) + len({right}))"
        return f"CASE WHEN substr({a}, 1, 64) = substr({b}, 1, 64) THEN 1.0::DOUBLE WHEN {both} > 0 THEN 2.0::DOUBLE * len(list_intersect({left}, {right})) / {both} ELSE 0.0::DOUBLE END"

    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS many FROM documents),
    e AS (
      SELECT d.doc_id, d.t, d.k, d.many, left(d.t, length(d.t) - length(d.t) // 4) || left(x.t, length(d.t) // 4) AS edited
      FROM d JOIN d x ON x.k = d.k % d.many + 1),
    f AS (
      SELECT k, many, doc_id, t, edited, print, {of_root} || {sections} AS made
      FROM (SELECT *, 'own' AS print, {tree('t')} AS tree FROM e UNION ALL SELECT *, 'edited', {tree('edited')} FROM e)),
    g AS (
      SELECT k, any_value(many) AS many, any_value(doc_id) AS doc_id, any_value(t) AS t, any_value(edited) AS edited,
             max(CASE WHEN print = 'own' THEN made END) AS fingerprint, max(CASE WHEN print = 'edited' THEN made END) AS edited_fingerprint
      FROM f GROUP BY k)
    SELECT g.doc_id, CAST(length(g.t) AS BIGINT) AS n_chars, sha256(g.edited) AS edited_sha256, g.fingerprint, g.edited_fingerprint,
           {likeness('g.fingerprint', 'g.edited_fingerprint')} AS near_edited, {likeness('g.fingerprint', 'x.fingerprint')} AS near_next
    FROM g JOIN g x ON x.k = g.k % g.many + 1"""


ORACLES = {
    "op1_url_rules": _url_rules(),
    "op2_warc": _warc(),
    "op3_decontaminate": _decontaminate(),
    "op6_jaccard_join": _jaccard(),
    "op9_line_quality": _line_quality(),
    "op11_collocations": _collocations(),
    "op12_filter_audit": _filter_audit(),
    "op13_fingerprints": _fingerprints(),
}
