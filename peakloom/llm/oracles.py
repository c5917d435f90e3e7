"""SQL (DuckDB) for the operators' queries that SQL can express."""

from __future__ import annotations

from . import license_scan, secret_scan

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


def _words(column: str) -> str:
    return f"regexp_extract_all({_lower(column)}, {_quoted(license_scan.WORDS)})"


def secrets() -> str:
    """Base spans by patterns; the method's from the entropy of every window of every candidate."""

    opened = "text"
    for pattern, length in secret_scan.ALLOWED_PIECES:
        opened = f"regexp_replace({opened}, {_quoted(pattern)}, '{' ' * length}', 'g')"

    def found(rank: int, name: str, pattern: str, source: str = "text") -> str:
        p = _quoted(pattern)
        return f"SELECT doc_id, {rank} AS rank, '{name}' AS kind, f[i] AS found, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start FROM (SELECT doc_id, f, g, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all({source}, {p}) AS f, string_split_regex({source}, {p}) AS g FROM d))"

    base = " UNION ALL ".join(f"SELECT doc_id, start, rank, kind, start + length(found) AS stop FROM ({found(i, name, p)}) WHERE length(regexp_extract(found, {_quoted(p)}, {group})) >= {least}" for i, (name, p, group, least) in enumerate(secret_scan.BASE))
    entropies = []
    for rank, (name, chars, _, window, bits, holds) in enumerate(secret_scan.CLASSES, len(secret_scan.BASE)):
        allowed = [p for p in secret_scan.ALLOWED_RUNS if "\\1" not in p]
        keep = " AND ".join([f"regexp_matches(found, '{p}')" for p in holds] + [f"NOT regexp_matches(found, {_quoted(p)})" for p in allowed])
        windows = f"SELECT doc_id, start, kind, rank, i, found[i + 1:i + {window}] AS w FROM (SELECT *, unnest(range(0, length(found) - {window} + 1)) AS i FROM ({found(rank, name, f'{chars}{{{window},}}', 'open')}) WHERE {keep})"
        dense = f"SELECT doc_id, start, kind, rank, i FROM (SELECT doc_id, start, kind, rank, i, c, count(*) AS n FROM (SELECT *, unnest(string_split(w, '')) AS c FROM ({windows})) WHERE c <> '' GROUP BY ALL) GROUP BY ALL HAVING -sum(n / {window}e0 * log2(n / {window}e0)) >= {bits} - 1e-9"
        runs = f"SELECT *, sum(fresh) OVER (PARTITION BY doc_id, start ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, start ORDER BY i) <= {window} THEN 0 ELSE 1 END AS fresh FROM ({dense}))"
        entropies.append(f"SELECT doc_id, start + min(i) AS start, rank, kind, start + max(i) + {window} AS stop FROM ({runs}) GROUP BY doc_id, start, rank, kind, run")
    said = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop)"
    return (
        f"WITH d AS (SELECT doc_id, text, {opened} AS open FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), base AS ({base}), spans AS (SELECT * FROM base UNION ALL {' UNION ALL '.join(entropies)}) "
        f"SELECT d.doc_id, coalesce(b.n_assign, 0) AS n_assign, coalesce(b.n_access, 0) AS n_access, coalesce(b.n_hex, 0) AS n_hex, sha256(coalesce(b.said, '')) AS base_sha256, coalesce(s.said, '') AS spans FROM d "
        f"LEFT JOIN (SELECT doc_id, {', '.join(f'''count(*) FILTER (kind = '{n}') AS n_{n}''' for n, *_ in secret_scan.BASE)}, {said} AS said FROM base GROUP BY 1) b USING (doc_id) LEFT JOIN (SELECT doc_id, {said} AS said FROM spans GROUP BY 1) s USING (doc_id)"
    )


def near_duplicates() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
 r AS (SELECT doc_id, doc_id AS home FROM documents UNION SELECT e.b, r.home FROM r JOIN e ON e.a = r.doc_id)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.home AS component_id, c.home = d.doc_id AS kept FROM documents d JOIN (SELECT doc_id, min(home) AS home FROM r GROUP BY 1) c USING (doc_id) LEFT JOIN n USING (doc_id)"""


def lines() -> str:
    return f"""WITH l AS (SELECT doc_id, line, i, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS key FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
 k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
 m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.keeper AS gone FROM l LEFT JOIN k USING (key))
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1"""


def licenses() -> str:
    rows = []
    for phrase, table in (("true", license_scan.PHRASES), ("false", license_scan.TEMPLATES)):
        for text, label in table.items():
            w = text.split(" ")
            n = len(w) - license_scan.K + 1
            rows += [f"({_quoted(' '.join(w[i : i + license_scan.K]))}, {_quoted(text)}, '{label}', {phrase}, {i}, {n})" for i in range(n)]
    k = license_scan.K
    return f"""WITH t(gram, template, label, phrase, place_in, n_grams) AS (VALUES {', '.join(rows)}),
 w AS (SELECT doc_id, {_words('text')} AS w FROM documents),
 g AS (SELECT doc_id, i - 1 AS place, array_to_string(w[i:i + {k - 1}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM w)),
 v AS (SELECT DISTINCT doc_id, template, label, phrase, n_grams, place - place_in AS diagonal, place_in FROM g JOIN t USING (gram)),
 s AS (SELECT x.doc_id, x.template, x.label, x.phrase, x.diagonal AS start, count(DISTINCT v.place_in) / x.n_grams AS score FROM (SELECT DISTINCT doc_id, template, label, phrase, n_grams, diagonal FROM v) x JOIN v ON v.doc_id = x.doc_id AND v.template = x.template AND v.phrase = x.phrase AND v.diagonal BETWEEN x.diagonal AND x.diagonal + CASE WHEN x.phrase THEN 0 ELSE {license_scan.NEAR} END GROUP BY x.doc_id, x.template, x.label, x.phrase, x.diagonal, x.n_grams),
 o AS (SELECT *, phrase AND score = 1 AS base FROM s WHERE NOT phrase OR score = 1)
 SELECT w.doc_id, len(w.w) AS n_words, count(*) FILTER (o.base) AS n_base, min(o.start) FILTER (o.base) AS first_word, max(o.start) FILTER (o.base) AS last_word,
 coalesce(string_agg(DISTINCT o.label, ',' ORDER BY o.label) FILTER (o.base), '') AS base_labels, coalesce(string_agg(DISTINCT o.label, ',' ORDER BY o.label) FILTER (o.base OR o.score >= {license_scan.SHARE}), '') AS labels, round(coalesce(max(o.score), 0), 6) AS score
 FROM w LEFT JOIN o USING (doc_id) GROUP BY w.doc_id, w.w"""


def contamination(window: int = 10) -> str:
    return f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
 b AS (SELECT item_id, w, least({window}, len(w)) AS n FROM (SELECT item_id, {_words('text')} AS w FROM benchmark) WHERE len(w) > 0),
 iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS said FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
 dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS said FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
 h AS (SELECT DISTINCT doc_id, i, n, item_id::VARCHAR AS item FROM dw JOIN iw USING (n, said)),
 c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
 x AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
 SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(x.n_items, 0) AS n_items, sha256(coalesce(x.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)"""


def repeats(length: int = 100) -> str:
    """Windows as hexadecimal digits, two a byte; a run of windows is a removed span."""
    return f"""WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS x FROM documents),
 p AS (SELECT doc_id, i, md5(substr(x, (2 * i + 1)::INT, {2 * length})) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {length - 1})) AS i FROM d)),
 r AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
 g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {length} THEN 0 ELSE 1 END AS fresh FROM r)),
 s AS (SELECT doc_id, min(i) AS first, max(i) + {length} AS stop FROM g GROUP BY doc_id, run),
 k AS (SELECT doc_id, first, stop, substr(x, (2 * coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY first), 0) + 1)::INT, (2 * (first - coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY first), 0)))::INT) AS piece, x FROM s JOIN d USING (doc_id)),
 c AS (SELECT doc_id, sum(stop - first)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY first) || substr(any_value(x), (2 * max(stop) + 1)::INT) AS kept FROM k GROUP BY 1)
 SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)"""


def url_verdicts(entries: list[tuple[str, str, str]]) -> str:
    """Of the entries that fit, the one with the most labels, then the longest path."""
    order = sorted(set(entries), key=lambda e: (-e[0].count("."), -len(e[1]), e[2] != "block"))
    fits = [(f"(host = {_quoted(h)} OR suffix(host, {_quoted('.' + h)})) AND prefix(path, {_quoted(p)})", h + p, v) for h, p, v in order]
    rule, verdict = (" ".join(f"WHEN {test} THEN {_quoted(x[i])}" for test, *x in fits) for i in (0, 1))
    return f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
 SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN host = '' THEN 'block' ELSE 'allow' END AS verdict FROM p"""


def fill_in_middle(seed: int = 42, fim: int = 50, spm: int = 80) -> str:
    """The texts that the digests are of are put together from token lists; what is restored is the text."""
    token = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"
    h = ", ".join(f"('0x' || substr(x, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    return f"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{token}') AS w, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS x FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
 h AS (SELECT *, len(w) AS n, {h} FROM d),
 f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {fim} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
 p AS (SELECT *, array_to_string(w[:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM f)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def conversation_trie(span: int = 100, most: int = 6) -> str:
    """Every prefix of every rebuilt conversation as a list; a node's subtree is the nodes whose smallest member has its list."""
    steps = "list_reduce(list_concat([xor(c, y)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda z, o: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END)"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, y: {steps}), 4294967295)"
    return f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT DISTINCT conv_id, {crc} % {most} AS h FROM t),
 s AS (SELECT c.conv_id, h, coalesce(x.n, 0) AS n FROM c LEFT JOIN (SELECT conv_id, count(*) AS n FROM t GROUP BY 1) x ON x.conv_id = c.conv_id - c.conv_id % {span}),
 r AS (SELECT s.conv_id, p AS place, role, text FROM s JOIN t ON t.conv_id = s.conv_id - s.conv_id % {span} AND p < h UNION ALL SELECT s.conv_id, p - h + least(h, n), role, text FROM s JOIN t USING (conv_id) WHERE p >= h),
 w AS (SELECT s.conv_id, coalesce(w, []) AS w FROM s LEFT JOIN (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY place) AS w FROM r GROUP BY 1) USING (conv_id)),
 x AS (SELECT conv_id, d AS depth, len(w) AS length, sha256(list_transform(w[:d], lambda y: sha256(y.role) || sha256(y.text))::VARCHAR) AS k, CASE WHEN d > 0 THEN sha256(list_transform(w[:d - 1], lambda y: sha256(y.role) || sha256(y.text))::VARCHAR) END AS up, CASE WHEN d > 0 THEN length(w[d].text) ELSE 0 END AS chars FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM w)),
 n AS (SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256 FROM x GROUP BY 1, 2),
 m AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n q WHERE q.up = n.k AND q.depth = n.depth + 1) AS n_children FROM n LEFT JOIN n p ON p.k = n.up AND p.depth = n.depth - 1),
 b AS (SELECT x.depth, x.k, sum((m.n_convs - 1) * m.chars)::BIGINT AS saved_tokens, count(*) FILTER (m.n_children = 0) AS n_leaves FROM m JOIN x ON x.conv_id = m.conv_id AND x.depth <= m.depth GROUP BY 1, 2)
 SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM m JOIN b USING (depth, k)"""
