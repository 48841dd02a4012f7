"""DuckDB twins of the training-data queries that SQL can express.

The learned operators (1, 8, 10), the tokenisers (4, 5) and the window program (6) have none;
tests hold them against brute force, round trips or held-out accuracy.
"""

from __future__ import annotations

from crashlens.llm.license_texts import KNOWN_LICENSES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Written down apart from the operator's own patterns: a line is taken to pieces by its first words.
_HOLDER = (r"(?:portions[ \t]+)?copyright[ \t,:]*\(c\)|(?:portions[ \t]+)?copyright[ \t,:]*©"
           r"|(?:portions[ \t]+)?copyright[ \t,:]*by[ \t]|(?:portions[ \t]+)?copyright[ \t,:]*[12]\d\d\d"
           r"|(?:portions[ \t]+)?copyright[ \t,:]*[<\[{]?year|(?:portions[ \t]+)?copyright[ \t,:]*[<\[{]?yyyy"
           r"|©|\(c\)[ \t]*copyright|\(c\)[ \t]*[12]\d\d\d")
_ALIKE = {"licence": "license", "sub-license": "sublicense", "merchantibility": "merchantability",
          "https://": "http://", "noninfringement": "non-infringement", "whilst": "while", "favour": "favor",
          "organisation": "organization", "’": "'"}


def _canonical(text: str) -> str:
    """Lines as a list; a line goes if it names a holder, or reserves all rights below one that does."""
    lines = rf"string_split(lower(regexp_replace({text}, '\r\n?', chr(10), 'g')), chr(10))"
    holder = rf"regexp_matches({{}}, '^[^\p{{{{L}}}}\p{{{{N}}}}©(]*(?:{_HOLDER.replace('{', '{{').replace('}', '}}')})')"
    below = r"regexp_full_match(z[1], '[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*')"
    kept = (f"list_filter(list_zip({lines}, list_concat([''], {lines})), lambda z: z[1] IS NOT NULL AND NOT "
            f"{holder.format('z[1]')} AND NOT ({below} AND {holder.format('z[2]')}))")
    out = (rf"array_to_string(list_transform({kept}, lambda z: regexp_replace(z[1], "
           rf"'^[^\p{{L}}\p{{N}}]*(?:\d\d?[.)]|\([a-z0-9]\))[ \t]+', '')), chr(10))")
    for a, b in _ALIKE.items():
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    return rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


def _flat(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[ \n]+', ' ', 'g'))"


_PARAGRAPHS = rf"list_filter(list_transform(regexp_split_to_array(t, '\n *\n'), lambda p: {_flat('p')}), lambda p: p <> '')"

OP2 = f"""
WITH known AS (
  SELECT license, {_canonical('text')} AS t FROM (VALUES
    {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in sorted(KNOWN_LICENSES.items()))}) k(license, text)),
digests AS (SELECT license, md5({_flat('t')}) AS digest, len({_PARAGRAPHS}) AS n FROM known),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_canonical('text')} AS t FROM documents WHERE text IS NOT NULL),
paragraphs AS (SELECT r, doc_id, {_PARAGRAPHS} AS p FROM docs),
runs AS (
  SELECT doc_id, i, array_to_string(p[i + 1:i + n], ' ') AS u
  FROM (SELECT doc_id, p, n, unnest(range(greatest(len(p) - n + 1, 0))) AS i
        FROM paragraphs, (SELECT DISTINCT n FROM digests UNION SELECT 1))),
lines AS (
  SELECT doc_id, i, trim(l[i + 1]) AS u
  FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM docs))),
units AS (
  SELECT doc_id, 'text' AS unit, 0 AS unit_no, {_flat('t')} AS u FROM docs
  UNION ALL SELECT doc_id, 'paragraphs', i, u FROM runs
  UNION ALL SELECT doc_id, 'line', i, u FROM lines)
SELECT doc_id, unit, CAST(unit_no AS INTEGER) AS unit_no, license, digest
FROM (SELECT *, md5(u) AS digest FROM units WHERE u <> '') JOIN digests USING (digest)
"""

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_COMPONENTS = """
reach(id, c) AS (SELECT id, id FROM nodes UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.c = links.a),
components AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"""

OP3 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
nodes AS (SELECT DISTINCT a AS id FROM links),{_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN components ON id = d.doc_id
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP7 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, doc_id, t, {_WORDS.format('t')} AS w,
                 list_filter(string_split(t, chr(10)), lambda x: translate(x, {_BLANKS}, '') <> '') AS l FROM docs),
windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM words)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM repeated, (VALUES (0), (1), (2)) o(k) GROUP BY r),
measures AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper,
         length(t) - length(replace(t, '!', '')) AS n_exclamations
  FROM words LEFT JOIN covered USING (r)),
book AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 2 * word_chars < 5 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN 100 * n_upper > 40 * word_chars THEN 64 ELSE 0 END)
    + (CASE WHEN 10 * n_exclamations > 3 * n_words THEN 128 ELSE 0 END) AS BIGINT) AS failures FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failures = 0 AS kept, failures
FROM book
"""

OP9 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
nodes AS (SELECT DISTINCT a AS id FROM links),{_COMPONENTS},
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN components ON id = vec_id LEFT JOIN degrees ON a = vec_id
"""

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 of a decimal number's digits (polynomial 0xEDB88320), which DuckDB lacks.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

OP11 = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_CRC32.format('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, place, 0 AS part, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND place < h
  UNION ALL SELECT c.conv_id, place, 1, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place >= h),
lists AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY part, place) AS l FROM rebuilt GROUP BY conv_id),
whole AS (SELECT conv_id, coalesce(l, []) AS l FROM convs LEFT JOIN lists USING (conv_id)),
steps AS (SELECT conv_id, d AS depth, l[1:d] AS k, l[d].t AS last, len(l) = d AS ends
          FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM whole)),
nodes AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(length(any_value(last)), 0) AS chars,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
          FROM steps GROUP BY depth, k),
family AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.k = n.k[1:n.depth - 1]),
children AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM family WHERE depth > 0 GROUP BY 1, 2),
sums AS (
  SELECT up.depth, up.conv_id, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((below.n_convs - 1) * below.chars) AS saved
  FROM (SELECT n.*, c.n_children FROM nodes n LEFT JOIN children c USING (depth, conv_id)) below
  JOIN nodes up ON up.depth <= below.depth AND up.k = below.k[1:up.depth] GROUP BY 1, 2)
SELECT f.conv_id, f.depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM family f JOIN sums USING (depth, conv_id) LEFT JOIN children USING (depth, conv_id)
"""


def _plain_words(text: str) -> str:
    lowered = _LOWER.format(text)
    return rf"list_filter(regexp_split_to_array({lowered}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


OP12 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_plain_words('text')} AS w FROM documents),
items AS (SELECT item_id, {_plain_words('text')} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS x
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM items WHERE len(w) > 0)),
places AS (
  SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS x
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
found AS (SELECT r, i, m, item_id FROM places JOIN windows USING (m, x)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM found)) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN listed USING (r)
"""

OP13 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format('text')}, '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) v(k))),
counts AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, g, count(*) AS f FROM grams GROUP BY lang, k, g),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM counts WHERE f >= 30),
cuts AS (SELECT lang, phrase, g, k, f AS a, unnest(range(1, k)) AS cut FROM frequent WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, a, cut, x.f AS l, y.f AS r,
         CAST(CAST(2000000 AS HUGEINT) * a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.g[1:cut], ' ')
              JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.g[cut + 1:c.k], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(g[i:i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, g, f, m, unnest(range(1, k - m + 2)) AS i FROM frequent, (VALUES (2), (3)) v(m) WHERE m < k) GROUP BY 1, 2),
kept AS (SELECT s.* FROM lowest s LEFT JOIN inner_phrases i ON i.lang = s.lang AND i.phrase = s.phrase
         WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op2_license_digests": OP2,
    "op3_minhash_dedup": OP3,
    "op7_quality_ledger": OP7,
    "op9_projection_collisions": OP9,
    "op11_conversation_trie": OP11,
    "op12_suffix_decontamination": OP12,
    "op13_phrase_collocations": OP13,
}
