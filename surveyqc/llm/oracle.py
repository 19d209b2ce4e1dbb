"""DuckDB SQL of those queries that SQL can express."""

#: The payload of a page is its html in UTF-8; DuckDB's strings are UTF-8.
WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""

CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, regexp_replace(text, '([<[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') AS body FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(body) + 11)::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(role, ' ' ORDER BY turn, text), '(system )?user assistant( user assistant)*') AS valid
FROM e GROUP BY conv_id
"""

#: Written out here and not taken from the operator, so that a wrong cutoff there shows: measure, cutoffs from lenient to strict.
_CUTOFFS = (
    ("n_symbols / n_words", (3.2, 1.6, 0.8, 0.4, 0.2, 0.1)), ("n_dup_lines / n_lines", (0.8, 0.7, 0.5, 0.4, 0.3, 0.2)), ("n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    ("n_capitals / word_chars", (0.8, 0.6, 0.4, 0.3, 0.2, 0.1)), ("n_exclamations / n_words", (3.2, 1.6, 0.8, 0.4, 0.2, 0.1)), ("word_chars / n_words", (30.0, 25.0, 20.0, 15.0, 12.0, 10.0)),
)
_BROKEN = [" OR ".join(f"coalesce(n_words > 0 AND {m} > {grid[i]}, false)" for m, grid in _CUTOFFS) for i in range(6)]
#: The same counts by unnesting words; the same exact test by the gamma function.
RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT row, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY row ORDER BY i)),
r AS (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS n FROM g WHERE c IS NOT NULL),
p AS (SELECT row, count(DISTINCT j) AS n_repeat_words FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM r WHERE n > 1) GROUP BY row),
s AS (SELECT row, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY row),
l AS (SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
f AS (SELECT doc_id, lang, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations
  FROM d LEFT JOIN s USING (row) LEFT JOIN p USING (row) LEFT JOIN l USING (row)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
t AS (SELECT lang, setting, count(*) AS n, count(*) FILTER (lost) AS k FROM (
    {" UNION ALL ".join(f"SELECT lang, {i} AS setting, {x} AS lost FROM h" for i, x in enumerate(_BROKEN))}) GROUP BY ALL),
v AS (SELECT lang, setting, k < 0.02 * n AND (SELECT sum(exp(lgamma(n + 1) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - lgamma(n - j + 1) + j * ln(0.02) + (n - j) * ln(1 - 0.02)))
    FROM (SELECT unnest(generate_series(0, k)) AS j)) <= 0.05 / (SELECT count(DISTINCT lang) FROM h) AS safe FROM t),
c AS (SELECT lang, coalesce(min(setting) FILTER (NOT safe), 6) - 1 AS setting FROM v GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (CASE setting {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_BROKEN))} ELSE false END) AS kept
FROM b LEFT JOIN c USING (lang)
"""

_LETTERS = lambda word: "".join(f"[{c.upper()}{c}]" for c in word)
_KEYS = "|".join([*map(_LETTERS, ("password", "passwd", "secret", "token")), _LETTERS("api") + "_?" + _LETTERS("key")])
_KINDS = (("assign", f"""((?:{_KEYS})["'']? *[:=] *["'']?)([A-Za-z0-9+/_.=-]+)""", 2), ("access", "AKIA[A-Z0-9]{16,}", 0), ("hex", "[0-9a-f]{24,}", 0), ("token", "[A-Za-z0-9_-]{20,}", 0))
_FOUND = " UNION ALL ".join(
    f"""SELECT row, {rank} AS rank, '{kind}' AS kind, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i,
      unnest(regexp_extract_all(text, '{p}')) AS match, unnest(regexp_extract_all(text, '{p}', {g})) AS value,
      unnest(regexp_split_to_array(text, '{p}')[:-2]) AS gap FROM d WHERE regexp_matches(text, '{p}')"""
    for rank, (kind, p, g) in enumerate(_KINDS)
)
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
m AS ({_FOUND}),
p AS (SELECT *, sum(length(gap) + length(match)) OVER (PARTITION BY row, rank ORDER BY i)::BIGINT AS stop FROM m),
b AS (SELECT row, rank, kind, value, stop - length(match) AS start, stop FROM p WHERE rank < 3 AND (rank > 0 OR length(value) >= 6)
  UNION ALL SELECT row, rank, kind, value, stop - length(match), stop FROM p AS t WHERE rank = 3
    AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')
    AND NOT EXISTS (FROM p AS x WHERE x.row = t.row AND x.rank < 3 AND (x.rank > 0 OR length(x.value) >= 6) AND x.stop - length(x.match) < t.stop AND t.stop - length(t.match) < x.stop)),
v AS (SELECT value, text, min(source) AS owner FROM b JOIN d USING (row) GROUP BY value, text),
o AS (SELECT value, count(DISTINCT coalesce(owner, chr(0))) <= 3 AND count(*) <= 100 AND len(list_distinct(string_split(value, ''))) >= 6 AS live FROM v GROUP BY value),
s AS (SELECT b.*, live FROM b JOIN o USING (value)),
a AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
  count(*) FILTER (live) AS n_live FROM s GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN a USING (row)
"""

#: Phrases are kept as lists of words; f has every phrase of one to four words.
COLLOCATIONS = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: w[i : i + k - 1])) AS phrase FROM p, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(w) >= k),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*)::HUGEINT AS f FROM g GROUP BY lang, phrase HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
s AS (SELECT lang, f AS longer, phrase[i : i + m - 1] AS part FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM f WHERE k > 2))),
c AS (SELECT * FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.lang = f.lang AND s.part = f.phrase AND 100 * s.longer >= 80 * f.f)),
x AS (SELECT *, phrase[:cut] AS a, phrase[cut + 1:] AS b FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c)),
y AS (SELECT x.lang, x.phrase, x.f AS a, l.f AS l, r.f AS r, cut, (2000000 * x.f) // (l.f + r.f) AS score
  FROM x JOIN f AS l ON l.lang = x.lang AND l.phrase = x.a JOIN f AS r ON r.lang = x.lang AND r.phrase = x.b),
z AS (SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM z JOIN n USING (lang) QUALIFY rank <= 2000
"""

SEARCH = r"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) AS total, sum(len(terms))::BIGINT AS every FROM t WHERE len(terms) > 0),
f AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM t) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, total),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * len(terms) * total) // every)))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN t USING (row), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY rank <= 50
"""

SQL: dict[str, str] = {
    "op6_chat_formatting": CHAT, "op7_quality_rules": RULES, "op9_warc": WARC, "op10_secret_scans": SECRETS, "op11_phrase_collocations": COLLOCATIONS, "op13_ranked_search": SEARCH,
}
