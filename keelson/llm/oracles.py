"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_URLS = r"""
urls AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
"""

_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""


def _license_sql() -> str:
    from keelson.llm.license_scan import BASE_PHRASES, COVER, DRIFT, GRAM, NOTICES

    lines = [f"({n}, '{t}', '{x}', {b})" for n, (t, x, b) in enumerate(
        [(*x, "true") for x in BASE_PHRASES] + [(*x, "false") for x in NOTICES])]
    return f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
t(template, phrase, label, is_base) AS (VALUES {", ".join(lines)}),
u AS (SELECT *, string_split(phrase, ' ') AS own, CASE WHEN is_base THEN 2 ELSE least({GRAM}, len(string_split(phrase, ' '))) END AS width FROM t),
g AS (SELECT template, label, is_base, width, len(own) AS n_template, i AS place, array_to_string(list_slice(own, i + 1, i + width), ' ') AS gram
      FROM (SELECT *, unnest(range(len(own) - width + 1)) AS i FROM u)),
k AS (SELECT doc_id, width, i, array_to_string(list_slice(words, i + 1, i + width), ' ') AS gram
      FROM (SELECT doc_id, words, width, unnest(range(len(words) - width + 1)) AS i FROM w, (SELECT DISTINCT width FROM g) n)),
v AS (SELECT doc_id, template, label, is_base, n_template, width, i - place AS diagonal, list(DISTINCT place) AS ats
      FROM k JOIN g USING (width, gram) GROUP BY ALL),
m AS (SELECT *, len(list_distinct(flatten(list_transform(flatten(list(ats) OVER near), lambda x: range(x, x + width))))) AS verified,
             len(ats) = max(len(ats)) OVER near AS best FROM v
      WINDOW near AS (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN {DRIFT} PRECEDING AND {DRIFT} FOLLOWING)),
f AS (SELECT *, is_base AND len(ats) = n_template - 1 AS place,
             CASE WHEN is_base THEN len(ats) = n_template - 1 ELSE best AND verified >= {COVER} * n_template END AS found FROM m),
r AS (SELECT doc_id, count(*) FILTER (place) AS n_base, min(diagonal) FILTER (place) AS first_word,
             max(diagonal) FILTER (place) AS last_word,
             array_to_string(list_sort(list_distinct(list(label) FILTER (place))), ',') AS base_labels,
             array_to_string(list_sort(list_distinct(list(label) FILTER (found))), ',') AS labels,
             max(verified::DOUBLE / n_template) FILTER (found) AS score FROM f GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN r USING (doc_id)
"""


def _merkle_sql(deepest: int = 6) -> str:
    """Trees of up to 16 ** deepest leaves, level by level."""
    text = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda last: f"sha256({' || '.join(text(c) for c in ('doc_id', 'source', 'lang', 'n_chars', last))})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda c, o: list_reduce(list_prepend(xor(c, o), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)"""
    steps = [f"""
d AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS claim FROM documents),
x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
n0 AS (SELECT source AS tree, i, n, leaf AS digest FROM x)"""]  # fmt: skip

    def tree(at: str, runs: str) -> str:
        steps.extend(
            f"""{runs}{k} AS (SELECT tree, i // 16 AS run, (n + 15) // 16 AS n, list(digest ORDER BY i) AS ds FROM {at}{k} WHERE n > 1 GROUP BY ALL),
{at}{k + 1} AS (SELECT tree, run AS i, n, sha256(array_to_string(ds, '')) AS digest FROM {runs}{k})"""
            for k in range(deepest)
        )
        return " UNION ALL ".join(f"SELECT tree, digest FROM {at}{k} WHERE n = 1" for k in range(deepest + 1))

    subroots = tree("n", "r")
    steps.append(f"s AS ({subroots})")
    steps.append("t0 AS (SELECT 0 AS tree, tree AS name, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n, digest FROM s)")
    roots = tree("t", "u")
    steps.append(f"g AS ({roots})")
    steps.append("f0 AS (SELECT x.doc_id, leaf, t0.digest AS subroot, source, x.i, t0.i AS j, claim AS held, '' AS proof FROM x JOIN t0 ON x.source IS NOT DISTINCT FROM t0.name)")
    for k in range(2 * deepest):
        runs, level, at = (f"r{k}", k, "i") if k < deepest else (f"u{k - deepest}", k - deepest, "j")
        of = "f.source IS NOT DISTINCT FROM o.tree" if k < deepest else "o.tree = 0"
        slot = f"((f.{at} // {16**level}) % 16 + 1)"
        steps.append(f"""f{k + 1} AS (SELECT doc_id, leaf, subroot, source, i, j,
  CASE WHEN ds IS NULL THEN held ELSE sha256(array_to_string(list_transform(ds, lambda d, p: CASE WHEN p = {slot} THEN held ELSE d END), '')) END AS held,
  proof || coalesce(array_to_string(list_filter(ds, lambda d, p: p <> {slot}), ''), '') AS proof
  FROM f{k} f LEFT JOIN {runs} o ON {of} AND o.run = f.{at} // {16 ** (level + 1)})""")  # fmt: skip
    return f"""
WITH {", ".join(steps)}
SELECT doc_id, leaf, subroot, g.digest AS root, sha256(proof) AS proof_sha256, held AS folded_root, held = g.digest AS verified
FROM f{2 * deepest}, g
"""


def _codes_sql() -> str:
    near = lambda k: f"""
a{k} AS MATERIALIZED (SELECT vec_id, label, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT vec_id, label, p.part, p.x, entry, list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x) AS d
  FROM p JOIN c{k} c USING (part)) GROUP BY ALL)"""  # noqa: E731
    mean = lambda k: f"""
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
  SELECT part, entry, list(floor(total / n) ORDER BY place) AS x FROM (
    SELECT part, entry, place, sum(x[place]) AS total, count(*) AS n FROM a{k}, range(1, 17) r(place) GROUP BY ALL) GROUP BY ALL) m USING (part, entry))"""  # noqa: E731
    steps = [near(0)] + [step for k in range(4) for step in (mean(k), near(k + 1))]
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(embedding) > 0),
p AS MATERIALIZED (SELECT vec_id, label, part, list_slice(v, 16 * part + 1, 16 * part + 16) AS x FROM k, range(4) q(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < 256),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c4),
r AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r, h
"""


SQL = {
    "op12_merkle": _merkle_sql(),
    "op13_vector_codes": _codes_sql(),
    "op5_license_scan": _license_sql(),
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS response FROM d),
v AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(h, 5 * g::INT + 1, 5))::BIGINT) AS v FROM m)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31)::INT + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31)::INT + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31)::INT + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM v
""",
    "op7_decontaminate": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS words FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(words), 13) AS span,
              array_to_string(list_slice(words, s + 1, s + least(len(words), 13)), ' ') AS win
       FROM (SELECT *, unnest(range(len(words) - least(len(words), 13) + 1)) AS s FROM b WHERE len(words) > 0)),
dw AS (SELECT doc_id, span, s, array_to_string(list_slice(words, s + 1, s + span), ' ') AS win
       FROM (SELECT w.*, n.span, unnest(range(len(words) - span + 1)) AS s
             FROM w, (SELECT DISTINCT span FROM iw) n WHERE len(words) >= span)),
h AS (SELECT DISTINCT doc_id, item_id, s, span FROM dw JOIN iw USING (span, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + span)) AS p FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
""",
    "op2_url_filter": f"""
WITH {_URLS}, rules(rhost, rpath, action, own) AS (
  VALUES ('net', '/', 'block', 0), ('example.net', '/en/', 'allow', 0), ('example.com', '/de/', 'block', 0),
         ('org', '/fr/', 'allow', 0), ('casino-win.example.com', '/', 'block', 1),
         ('cheap-pills.example.com', '/', 'block', 1)),
fits AS (
  SELECT u.host, u.path, r.rhost || r.rpath AS rule, action, own,
         row_number() OVER (PARTITION BY u.host, u.path, own ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC, action DESC) AS n
  FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules r
    ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath))
SELECT page_id, urls.host, urls.path, b.rule AS rule, coalesce(b.action, o.action, 'allow') AS verdict
FROM urls
LEFT JOIN fits b ON b.host = urls.host AND b.path = urls.path AND b.n = 1 AND b.own = 0
LEFT JOIN fits o ON o.host = urls.host AND o.path = urls.path AND o.n = 1 AND o.own = 1
""",
    "op10_quality_ledger": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM often, range(3) s(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
         length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims
  FROM w LEFT JOIN r USING (doc_id)),
b AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
         + 8 * (n_lines >= 4 AND 10 * n_dup_lines > 4 * n_lines)::INT
         + 16 * (n_upper + n_lower >= 20 AND 2 * n_upper > n_upper + n_lower)::INT
         + 32 * (5 * n_exclaims > n_words)::INT + 64 * (n_words > 0 AND word_chars < 2 * n_words)::INT
         + 128 * (word_chars > 20 * n_words)::INT AS bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, (bits & 3) <> 0 AS base_failed,
       bits = 0 AS kept
FROM b
""",
}
