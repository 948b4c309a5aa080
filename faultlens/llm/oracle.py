"""SQL for a second engine, where SQL can express a query over whole tables."""

from __future__ import annotations

from faultlens.llm import license_scan, merkle, quality_rules, spelling

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Characters stripped from lines, written as SQL.
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _license_scan() -> str:
    rows, threshold = [], license_scan.THRESHOLD
    for name, text in sorted(license_scan.TEMPLATES.items()):
        bag = license_scan.template_bigrams(text)
        low, high = license_scan.bounds(bag.total(), threshold)
        rows += [f"('{name}', '{bigram}', {n}, {bag.total()}, {low}, {high})" for bigram, n in bag.items()]
    return f"""
WITH t(license_id, bigram, in_template, template_size, low, high) AS (VALUES {", ".join(rows)}),
d AS (
  SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9\\n]+', ' ', 'g')) AS plain FROM documents
),
cut AS (SELECT doc_id, string_split(plain, chr(10)) AS parts, plain FROM d),
units AS (
  SELECT doc_id, 0 AS line, trim(regexp_replace(plain, '[ \\n]+', ' ', 'g')) AS words FROM cut
  UNION ALL
  SELECT doc_id, i, trim(parts[i]) FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut)
),
sized AS (
  SELECT doc_id, line, string_split(words, ' ') AS w, len(words) - len(replace(words, ' ', '')) AS n FROM units
),
pairs AS (
  SELECT doc_id, line, n, w[i] || ' ' || w[i + 1] AS bigram
  FROM (SELECT doc_id, line, n, w, unnest(range(1, n + 1)) AS i FROM sized WHERE n > 0)
),
counted AS (SELECT doc_id, line, n, bigram, count(*) AS here FROM pairs GROUP BY ALL),
scored AS (
  SELECT doc_id, line, license_id, 2.0 * sum(least(here, in_template)) / (n + template_size) AS score
  FROM counted JOIN t USING (bigram) WHERE n BETWEEN low AND high
  GROUP BY doc_id, line, n, license_id, template_size
),
matches AS (
  SELECT doc_id, line, score, license_id FROM scored WHERE score >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY score DESC, license_id) = 1
),
best AS (
  SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) = 1
),
total AS (
  SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS license_ids
  FROM matches GROUP BY doc_id
)
SELECT documents.doc_id, license_id, CAST(score AS DOUBLE) AS score, CAST(line AS BIGINT) AS line,
  coalesce(n_matches, 0) AS n_matches, coalesce(license_ids, '') AS license_ids
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN total USING (doc_id)
"""


_LINE_DEDUP = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, i, parts[i] AS line, translate(trim(parts[i], {_SPACE}), '{_UPPER}', '{_LOWER}') AS line_key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut)
),
common AS (
  SELECT line_key, max(doc_id) AS last_id FROM lines WHERE len(line_key) >= 20
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
  SELECT doc_id, i, line, last_id IS NOT NULL AND last_id <> doc_id AS dropped
  FROM lines LEFT JOIN common USING (line_key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WORDS = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
_DECONTAMINATE = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS w FROM documents
),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), {_WORDS}) AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
),
patterns AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, w[i : i + least(len(w), 10) - 1] AS words
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM patterns),
places AS (
  SELECT doc_id, size, i, w[i : i + size - 1] AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN sizes)
),
hits AS (SELECT doc_id, i, places.size, item FROM places JOIN patterns ON places.words = patterns.words),
hit_words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names
  FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_EXACT_DEDUP = """
WITH d AS (
  SELECT doc_id, len(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER best AS kept, sha256(norm) AS text_sha256
FROM d WINDOW best AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""



def _checksum_tables(positions: int) -> str:
    """Tables to compute unsigned crc32 by: ``effect(back, byte, code)`` and ``blank(size, code)``.

    The checksum of a text is the checksum of as many zero bytes, xor the effect of each byte at its distance from the end.
    """
    return f"""
bits(byte, code, step) AS (
  SELECT range, CAST(range AS UBIGINT), 0 FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN code % 2 = 1 THEN xor(code >> 1, 3988292384::UBIGINT) ELSE code >> 1 END, step + 1 FROM bits WHERE step < 8
),
one AS MATERIALIZED (SELECT byte, code FROM bits WHERE step = 8),
effect(back, byte, code) AS (
  SELECT 0, byte, code FROM one
  UNION ALL
  SELECT back + 1, effect.byte, xor(effect.code >> 8, one.code)
  FROM effect JOIN one ON one.byte = effect.code % 256 WHERE back < {positions}
),
effects AS MATERIALIZED (SELECT back, byte, code FROM effect),
blank(size, code) AS (
  SELECT 0, 4294967295::UBIGINT
  UNION ALL
  SELECT size + 1, xor(blank.code >> 8, one.code) FROM blank JOIN one ON one.byte = blank.code % 256 WHERE size < {positions}
),
blanks AS MATERIALIZED (SELECT size, xor(code, 4294967295::UBIGINT) AS code FROM blank)"""


def _checksums(texts: str, positions: int) -> str:
    """Tables that end in ``checksums(text, code)`` of the distinct ASCII or Latin texts of a table."""
    return f"""{_checksum_tables(positions)},
plain AS MATERIALIZED (SELECT DISTINCT text, hex(encode(text)) AS digits FROM {texts}),
bytes AS (
  SELECT text, len(digits) // 2 AS size, unnest(range(0, len(digits) // 2)) AS i, digits FROM plain
),
parts AS (
  SELECT text, size, size - 1 - i AS back,
    (position(digits[2 * i + 1] IN '0123456789ABCDEF') - 1) * 16 + position(digits[2 * i + 2] IN '0123456789ABCDEF') - 1 AS byte
  FROM bytes
),
summed AS (SELECT text, any_value(size) AS size, bit_xor(effects.code) AS code FROM parts JOIN effects USING (back, byte) GROUP BY text),
checksums AS MATERIALIZED (SELECT text, xor(summed.code, blanks.code) AS code FROM summed JOIN blanks USING (size))"""


def _quality_rules() -> str:
    rules, least, reach = quality_rules.SIGNALS, quality_rules.LEAST_ROWS, quality_rules.REACH
    values = ", ".join(f"('{s.name}', {s.scale} * {s.of} // n_words)" for s in rules)
    space = "[\\x20\\x09-\\x0D]"

    def quartiles(name: str, by: str) -> str:
        key = f"{by}, " if by else ""
        return f"""
{name}_upto AS (
  SELECT {key}signal, bucket, sum(n) OVER (PARTITION BY {key}signal ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {key}signal) AS total
  FROM (SELECT {key}signal, bucket, sum(n) AS n FROM sketch GROUP BY ALL)
),
{name} AS (
  SELECT {key}signal, max(total) AS n, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3
  FROM {name}_upto GROUP BY {key}signal
)"""

    slack = " ".join(f"WHEN '{s.name}' THEN {s.slack}" for s in rules)
    low = ", ".join(f"'{s.name}'" for s in rules if s.low)
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
windows AS (SELECT id, i, w[i : i + 7] AS words FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, words) > 1),
repeats AS (SELECT id, count(DISTINCT place) AS n_repeat_words FROM (SELECT id, unnest(range(i, i + 8)) AS place FROM twice) GROUP BY id),
lines AS (
  SELECT id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY id
),
counts AS MATERIALIZED (
  SELECT id, doc_id, lang, source, len(w) AS n_words, len(regexp_replace(t, '{space}', '', 'g')) AS word_chars,
    len(t) - len(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(w) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(w) AS base_failed
  FROM d JOIN w USING (id) LEFT JOIN lines USING (id) LEFT JOIN repeats USING (id)
),
signals AS (
  SELECT id, lang, source, signal, v, v - v % CAST(pow(2, greatest(0, len(bin(v)) - {quality_rules.KEPT_BITS})) AS BIGINT) AS bucket
  FROM (SELECT id, lang, source, v.signal, CAST(v.v AS BIGINT) AS v FROM (SELECT * FROM counts WHERE NOT base_failed), LATERAL (VALUES {values}) v(signal, v))
),
sketch AS (SELECT lang, source, signal, bucket, count(*) AS n FROM signals GROUP BY ALL),
{quartiles('own', 'lang, source')},
{quartiles('language', 'lang')},
{quartiles('whole', '')},
chosen AS (
  SELECT own.lang, own.source, signal, CASE signal {slack} END AS slack,
    CASE WHEN own.n >= {least} THEN own.q1 WHEN language.n >= {least} THEN language.q1 ELSE whole.q1 END AS q1,
    CASE WHEN own.n >= {least} THEN own.q3 WHEN language.n >= {least} THEN language.q3 ELSE whole.q3 END AS q3,
    CASE WHEN language.n >= {least} THEN language.q3 - language.q1 ELSE whole.q3 - whole.q1 END AS wide
  FROM own JOIN language USING (signal) JOIN whole USING (signal) WHERE own.lang IS NOT DISTINCT FROM language.lang
),
broken AS (
  SELECT DISTINCT id FROM signals s JOIN chosen c
  ON s.signal = c.signal AND s.lang IS NOT DISTINCT FROM c.lang AND s.source IS NOT DISTINCT FROM c.source
  WHERE v > q3 + {reach} * greatest(q3 - q1, wide) + slack
    OR s.signal IN ({low}) AND v < q1 - {reach} * greatest(q3 - q1, wide) - slack
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND broken.id IS NULL AS kept
FROM counts LEFT JOIN broken USING (id)
"""


def _merkle_levels(name: str, levels: int, arity: int) -> str:
    """Levels 0 to ``levels`` of trees over ``<name>_0(tree, place, n, digest)``, and the siblings on each."""
    out = []
    for i in range(levels):
        out.append(f"""
{name}_step_{i} AS MATERIALIZED (
  SELECT a.tree, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
  FROM {name}_{i} a JOIN {name}_{i} b ON a.tree = b.tree AND a.place // {arity} = b.place // {arity} WHERE a.n > 1 GROUP BY a.tree, a.place
),
{name}_{i + 1} AS MATERIALIZED (
  SELECT tree, place // {arity} AS place, (any_value(n) + {arity} - 1) // {arity} AS n,
    CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY place)) ELSE any_value(digest) END AS digest
  FROM {name}_{i} GROUP BY tree, place // {arity}
)""")
    return ",".join(out)


# Levels that the SQL unrolls: enough for 8 ** 6 rows of a language and 8 ** 3 languages.
_LEVELS, _TOP_LEVELS = 6, 3


def _merkle() -> str:
    arity = merkle.ARITY

    def field(column: str) -> str:
        text = f"CAST({column} AS VARCHAR)"
        return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"

    rises = []
    for i in range(_LEVELS):
        rises.append(f"""
rise_{i + 1} AS (
  SELECT v.id, v.tree, v.place, v.proof || coalesce(s.before || s.after, '') AS proof,
    CASE WHEN s.place IS NULL THEN v.folded ELSE sha256(s.before || v.folded || s.after) END AS folded
  FROM rise_{i} v LEFT JOIN own_step_{i} s ON s.tree = v.tree AND s.place = v.place // {arity ** i}
)""")
    for i in range(_TOP_LEVELS):
        rises.append(f"""
rise_{_LEVELS + i + 1} AS (
  SELECT v.id, v.tree, v.place, v.proof || coalesce(s.before || s.after, '') AS proof,
    CASE WHEN s.place IS NULL THEN v.folded ELSE sha256(s.before || v.folded || s.after) END AS folded
  FROM rise_{_LEVELS + i} v LEFT JOIN top_step_{i} s ON s.place = v.tree // {arity ** i}
)""")
    return f"""
WITH RECURSIVE ids AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS text FROM documents WHERE doc_id IS NOT NULL),
{_checksums('ids', 24)},
rows AS MATERIALIZED (
  SELECT doc_id, lang, {leaf('text')} AS leaf,
    CASE WHEN code % {merkle.TAMPER} = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered
  FROM (SELECT d.*, c.code FROM documents d LEFT JOIN checksums c ON c.text = CAST(d.doc_id AS VARCHAR))
),
leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, leaf, tampered,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree
  FROM rows
),
own_0 AS (SELECT tree, place, n, leaf AS digest FROM leaves),
{_merkle_levels('own', _LEVELS, arity)},
top_0 AS (SELECT 0 AS tree, tree AS place, count(*) OVER () AS n, digest FROM own_{_LEVELS}),
{_merkle_levels('top', _TOP_LEVELS, arity)},
rise_0 AS (SELECT id, tree, place, '' AS proof, coalesce(tampered, leaf) AS folded FROM leaves),
{",".join(rises)}
SELECT doc_id, leaf, subroots.digest AS subroot, roots.digest AS root, sha256(proof) AS proof_sha256,
  folded AS folded_root, folded = roots.digest AS verified
FROM leaves JOIN rise_{_LEVELS + _TOP_LEVELS} r USING (id) JOIN own_{_LEVELS} subroots ON subroots.tree = leaves.tree
  JOIN top_{_TOP_LEVELS} roots ON true
"""


# Steps of a chain of forms that the SQL follows: each occurs ten times as often as the one before.
_CHAIN = 12


def _spelling() -> str:
    chain = "".join(
        f" LEFT JOIN forms f{i} ON f{i}.word = f{i - 1}.form" for i in range(1, _CHAIN)
    )
    last = ", ".join(f"f{i}.form" for i in reversed(range(_CHAIN)))
    return f"""
WITH RECURSIVE runs AS (
  SELECT CAST(coalesce(CAST(doc_id AS VARCHAR), '') AS VARCHAR) || ':' || run AS text, run, n
  FROM (
    SELECT doc_id, run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
    GROUP BY doc_id, run
  )
),
long AS MATERIALIZED (SELECT text, run, n FROM runs WHERE len(run) >= {spelling.SHORTEST}),
{_checksums('long', 200)},
spelt AS (
  SELECT CASE WHEN code % {spelling.SLIP} = 0 THEN run[: code % len(run)] || run[code % len(run) + 2 :] ELSE run END AS word, n
  FROM long JOIN checksums USING (text)
),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE len(word) >= {spelling.SHORTEST}
  GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}
),
cuts AS MATERIALIZED (
  SELECT word, len(word) AS size, i, word[: i - 1] || word[i + 1 :] AS rest
  FROM (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM words)
),
near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION
  SELECT cuts.word, words.word FROM cuts JOIN words ON cuts.rest = words.word
  UNION
  SELECT words.word, cuts.word FROM cuts JOIN words ON cuts.rest = words.word
),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-o.n, encode(other))) AS other, max(o.n) AS other_n
  FROM near JOIN words o ON o.word = other GROUP BY near.word
),
forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {spelling.TIMES} * n THEN other END AS form,
    CASE WHEN other_n >= {spelling.TIMES} * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
)
SELECT f0.word, f0.form, coalesce({last}, f0.word) AS root, f0.n, f0.n_near, f0.form_n
FROM forms f0{chain}
"""


SQL = {
    "op1_license_scan": _license_scan(),
    "op2_line_dedup": _LINE_DEDUP,
    "op9_decontaminate": _DECONTAMINATE,
    "op10_exact_dedup": _EXACT_DEDUP,
    "op11_quality_rules": _quality_rules(),
    "op12_merkle_manifest": _merkle(),
    "op13_spelling_variants": _spelling(),
}
