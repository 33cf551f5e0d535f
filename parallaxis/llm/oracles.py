"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _crc_table() -> list[int]:
    """The table of CRC-32 by its polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def _crc(text: str) -> str:
    of_bytes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {of_bytes}), lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"


_CRC = _crc("text")


def _leaf(text: str) -> str:
    values = ("CAST(doc_id AS VARCHAR)", "CAST(source AS VARCHAR)", "CAST(lang AS VARCHAR)", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


def _tree(name: str, leaves: str) -> str:
    """Levels of trees over (s, pos, h, width): nodes, and the three kids of each run."""
    return f"""{name} AS (
  SELECT s, 0 AS level, pos, h, width FROM ({leaves})
  UNION ALL
  SELECT s, level + 1, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)), (width + 2) // 3 FROM {name} WHERE width > 1 GROUP BY s, level, pos // 3, width),
{name}_runs AS (SELECT s, level, pos // 3 AS run, list(h ORDER BY pos) AS kids FROM {name} WHERE width > 1 GROUP BY ALL)"""


def _ascent(name: str, tree: str, start: str) -> str:
    return f"""{name} AS (
  SELECT id, s, 0 AS level, pos, folded, proof FROM ({start})
  UNION ALL
  SELECT id, c.s, c.level + 1, pos // 3, sha256(array_to_string(kids[1:pos % 3], '') || folded || array_to_string(kids[pos % 3 + 2:], '')),
    proof || array_to_string(kids[1:pos % 3], '') || array_to_string(kids[pos % 3 + 2:], '')
  FROM {name} c JOIN {tree}_runs r ON c.s = r.s AND c.level = r.level AND c.pos // 3 = r.run)"""

ORACLES: dict[str, str] = {
    "op8_sharding": f"""
WITH rows AS (
  SELECT doc_id, source, CAST(octet_length(encode(text)) + 8 AS BIGINT) AS size, {_CRC} AS text_crc32, md5('17:' || CAST(doc_id AS VARCHAR)) AS h
  FROM (SELECT doc_id, CAST(source AS VARCHAR) AS source, coalesce(text, '') AS text FROM documents)),
inner_rank AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, text_crc32) AS r, count(*) OVER (PARTITION BY source) AS n FROM rows),
whole AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, h, doc_id, size, text_crc32, source NULLS FIRST) - 1 AS p, count(*) OVER () AS total FROM inner_rank),
cut AS (SELECT *, p * 24 // total AS shard FROM whole)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, CAST(p - (shard * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, source FROM cut""",
    "op2_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(role) + length(text) + 12 + 10 + 10 + 1
    + length(role || text) - length(replace(role || text, '\', ''))
    + 2 * (len(regexp_extract_all(role, '<\|im_(start|sep|end)\|>|</?s>|\[/?INST\]|<</?SYS>>')) + len(regexp_extract_all(text, '<\|im_(start|sep|end)\|>|</?s>|\[/?INST\]|<</?SYS>>'))) AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op5_ngram_jaccard": f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') || ' ' || len(w) FROM words WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.low) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.node = d.doc_id GROUP BY d.doc_id, s.n""",
    "op9_quality_rules": f"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM places) WHERE n > 1),
hits AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS p FROM twice, (SELECT unnest([0, 1, 2]) AS j)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM words) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(hits.n, 0) AS n_repeat_words
  FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 4 * n_words)::INT + 8 * (3 * n_dup_lines > n_words)::INT
    + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT AS BIGINT) AS failed FROM m)
SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM f""",
    "op10_decontamination": f"""
WITH words AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
items AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g FROM (SELECT item_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM items)),
lengths AS (SELECT DISTINCT n FROM items),
places AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, lengths WHERE len(w) >= n)),
met AS (SELECT doc_id, p.n, i, item_id FROM places p JOIN windows v ON p.n = v.n AND p.g = v.g),
hits AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM met) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
}

ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE rows AS (
  SELECT *, row_number() OVER () AS id, {_leaf("text")} AS leaf, {_leaf(f"CASE WHEN {_crc('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS claimed FROM documents),
sources AS (SELECT source, n, row_number() OVER (ORDER BY CAST(source AS VARCHAR) NULLS FIRST) - 1 AS s FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)),
leaves AS (SELECT id, doc_id, s, leaf, claimed, n, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows JOIN sources ON rows.source IS NOT DISTINCT FROM sources.source),
{_tree("low", "SELECT s, pos, leaf AS h, n AS width FROM leaves")},
subroots AS (SELECT s, h FROM low WHERE width = 1),
{_tree("high", "SELECT 0 AS s, s AS pos, h, count(*) OVER () AS width FROM subroots")},
root AS (SELECT h AS root FROM high WHERE width = 1),
{_ascent("climb", "low", "SELECT id, s, pos, claimed AS folded, '' AS proof FROM leaves")},
at_subroot AS (SELECT id, s, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM climb GROUP BY id, s),
{_ascent("ascent", "high", "SELECT id, 0 AS s, s AS pos, folded, proof FROM at_subroot")},
at_root AS (SELECT id, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM ascent GROUP BY id)
SELECT doc_id, leaf, h AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaves JOIN at_root USING (id) JOIN subroots USING (s), root"""

ORACLES["op12_phrase_collocations"] = rf"""
WITH pieces AS (
  SELECT coalesce(CAST(lang AS VARCHAR), 'und') AS lang, regexp_extract_all(piece, '[^ 	]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?
-]')) AS piece FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY 1),
grams AS (
  SELECT lang, n, g, count(*) AS f FROM (
    SELECT lang, n, w[i:i + n - 1] AS g FROM (SELECT lang, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n))
  GROUP BY ALL HAVING count(*) >= 30),
inside AS (
  SELECT lang, part, max(f) AS longer FROM (
    SELECT lang, f, g[i:i + m - 1] AS part FROM (SELECT *, unnest(generate_series(1, n - m + 1)) AS i FROM grams, (SELECT unnest([2, 3]) AS m) WHERE m < n))
  GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(generate_series(1, n - 1)) AS k FROM grams WHERE n > 1) c
  JOIN grams x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN grams y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS nth FROM cuts),
kept AS (SELECT c.* FROM lowest c LEFT JOIN inside i ON i.lang = c.lang AND i.part = c.g WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 80 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept)
SELECT lang, rank, array_to_string(g, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

ORACLES["op13_source_mixing"] = rf"""
WITH rows AS (
  SELECT doc_id, CAST(source AS VARCHAR) AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS BIGINT) AS size, md5('17:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
sources AS (SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY 1)),
filled AS (
  SELECT *, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) OVER earlier, 0) AS used, sum(w) OVER rest AS weight
  FROM (SELECT *, 3 * source_size / w AS level FROM sources)
  WINDOW earlier AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
water AS (SELECT total - used AS words, weight FROM filled WHERE w * (total - used) <= 3 * source_size * weight ORDER BY level, source NULLS LAST LIMIT 1),
shares AS (
  SELECT source, source_size, CASE WHEN words IS NULL OR w * words > 3 * source_size * weight THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * words AS DOUBLE) / CAST(weight AS DOUBLE) END AS target
  FROM sources LEFT JOIN water ON true),
wanted AS (SELECT rows.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM rows JOIN shares ON rows.source IS NOT DISTINCT FROM shares.source),
first AS (SELECT *, size > 0 AND sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) <= target - whole * source_size AS once FROM wanted),
gaps AS (SELECT *, target - whole * source_size - sum(CASE WHEN once THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM first),
second AS (SELECT *, NOT once AND size > 0 AND size <= gap AS fits FROM gaps),
ends AS (SELECT *, once OR (fits AND sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) <= gap) AS taken_once FROM second)
SELECT doc_id, source, size, source_size, target, size * repeats AS taken, repeats
FROM (SELECT *, CASE WHEN size > 0 THEN whole + taken_once::BIGINT ELSE 0 END AS repeats FROM ends)"""

#: policies: version, and (bit, rule) of each
_RULES = "(1, 0, 'few_words'), (1, 1, 'repeated_windows'), (2, 0, 'few_words'), (2, 1, 'repeated_windows'), (2, 2, 'symbols'), (2, 3, 'duplicate_lines'), (2, 4, 'short_words'), (2, 5, 'long_words')"
ORACLES["quality_ablation"] = f"""
WITH ledger AS ({ORACLES["op9_quality_rules"]}), rules AS (SELECT * FROM (VALUES {_RULES}) AS v(version, bit, rule)), masks AS (SELECT version, CAST(sum(1 << bit) AS BIGINT) AS mask FROM rules GROUP BY 1)
SELECT CAST(version AS INT) AS version, rule, CAST(count(*) FILTER ((failed >> bit) & 1 = 1) AS BIGINT) AS n_failed, CAST(count(*) FILTER (failed & mask = 1 << bit) AS BIGINT) AS n_only
FROM rules JOIN masks USING (version), ledger GROUP BY ALL"""
