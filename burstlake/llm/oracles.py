"""The operators that SQL can express, written again as SQL over the documents table."""

from __future__ import annotations

from fractions import Fraction

from .mixing import MOST, SEED, WEIGHTS
from .periods import LEAST, TIMES
from .quality import CHAR_GUARD, CHAR_LIMIT, COMMON, MIN_WORDS, REPEAT_PERCENT, WIDTH, WORD_GUARD, WORD_LIMIT
from .sentences import END, MIN_WORDS as RUN_WORDS, SPAN
from .sharding import ROW_OVERHEAD, TOLERANCE
from .spelling import LEAST_COUNT, LEAST_LENGTH, RATIO

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _divergence(p: str, q: str, n: int) -> str:
    """Jensen-Shannon distance of two lists of shares."""
    term = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    parts = [f"{term(f'{p}[{i}]', f'{q}[{i}]')} + {term(f'{q}[{i}]', f'{p}[{i}]')}" for i in range(1, n + 1)]
    return f"sqrt(greatest(0, ({' + '.join(parts)}) / 2))"


def _quality() -> str:
    counts = {"upper": r"[^\p{Lu}]+", "digit": "[^0-9]+", "symbol": "[^#*$%&|<>]+", "punct": r"[^.,;:!?''\"()\-]+"}
    each = ", ".join(f"length(regexp_replace(r, '{p}', '', 'g')) AS {c}" for c, p in counts.items())
    common = " ".join(f"WHEN lang = '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON.items())
    hits = ", ".join(f"CASE WHEN c IS NULL THEN NULL ELSE len(list_filter(lw, lambda x: x = c[{i}])) END" for i in range(1, WIDTH + 1))
    share = lambda a: f"list_transform({a}, lambda x: CAST(x AS DOUBLE) / nullif(list_sum({a}), 0))"
    sums = ", ".join([f"sum(cc[{i}]) AS c{i}" for i in range(1, 7)] + [f"sum(wc[{i}]) AS w{i}" for i in range(1, WIDTH + 2)])
    return rf"""WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w, {WORDS.replace("text", "lower(text)", 1)} AS lw, regexp_replace(coalesce(text, ''), '[\p{{Ll}}\x20\x09-\x0D]+', '', 'g') AS r, CASE {common} END AS c FROM documents),
    win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 6))) AS i FROM t)),
    rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
    cov AS (SELECT doc_id, sum(step) AS n_repeat FROM (SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8)) AS step FROM rep) GROUP BY doc_id),
    a AS (SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) AS n, {each},
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, CASE WHEN c IS NOT NULL THEN [{hits}] END AS h FROM t),
    f AS (SELECT a.doc_id, lang, n_words, word_chars, symbol AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
        [upper, digit, symbol, punct, n - word_chars, word_chars - upper - digit - symbol - punct] AS cc, CASE WHEN h IS NOT NULL THEN list_append(h, n_words - list_sum(h)) END AS wc
        FROM a LEFT JOIN cov ON a.doc_id = cov.doc_id),
    b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM f),
    q AS (SELECT lang AS l, {sums} FROM b WHERE NOT base_failed GROUP BY lang),
    j AS (SELECT b.*, {share('cc')} AS p, {share('wc')} AS pw, {share('[c1, c2, c3, c4, c5, c6]')} AS qc, {share('[' + ', '.join(f'w{i}' for i in range(1, WIDTH + 2)) + ']')} AS qw
        FROM b LEFT JOIN q ON b.lang IS NOT DISTINCT FROM q.l)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
        NOT base_failed AND NOT coalesce(CASE WHEN list_sum(cc) >= {CHAR_GUARD} THEN {_divergence('p', 'qc', 6)} > {CHAR_LIMIT} END, FALSE)
        AND NOT coalesce(CASE WHEN n_words >= {WORD_GUARD} THEN {_divergence('pw', 'qw', WIDTH + 1)} > {WORD_LIMIT} END, FALSE) AS kept FROM j"""


SUBSTRINGS = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(greatest(0, length(h) // 2 - 49))) AS i FROM t)),
    m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
    c AS (SELECT w.doc_id, w.i FROM w JOIN m ON w.s = m.s WHERE m.first < w.doc_id),
    b AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(length(h) // 2)) AS p FROM t)),
    z AS (SELECT b.doc_id, b.p, b.x, max(c.i) OVER (PARTITION BY b.doc_id ORDER BY b.p) AS last FROM b LEFT JOIN c ON c.doc_id = b.doc_id AND c.i = b.p),
    k AS (SELECT doc_id, p, x, coalesce(p - last < 50, FALSE) AS gone FROM z),
    g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS starts FROM k),
    r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
    SELECT t.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
    FROM t LEFT JOIN r ON t.doc_id = r.doc_id"""

NEAR = r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, w, array_to_string(w, ' ') AS k, min(doc_id) OVER (PARTITION BY w) AS rep FROM t WHERE len(w) > 0),
    g AS (SELECT DISTINCT rep, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rep, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM s WHERE rep = doc_id)),
    n AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
    p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    cc AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, cc.root FROM cc JOIN e ON e.a = cc.node),
    r AS (SELECT node, min(root) AS root FROM cc GROUP BY node),
    d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
    SELECT t.doc_id, coalesce(s.rep, t.doc_id) AS copy_of, coalesce(d.n, 0) AS n_links, coalesce(r.root, s.rep, t.doc_id) AS near_of
    FROM t LEFT JOIN s ON s.doc_id = t.doc_id LEFT JOIN d ON d.a = s.rep LEFT JOIN r ON r.node = s.rep"""


def _mix() -> str:
    md5 = lambda x: f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"
    w = f"CASE (rn - 1) % 3 WHEN 0 THEN {WEIGHTS[0]:e} WHEN 1 THEN {WEIGHTS[1]:e} ELSE {WEIGHTS[2]:e} END"
    return f"""WITH t AS (SELECT doc_id, source, len({WORDS}) AS size, {md5("'order|' || coalesce(CAST(doc_id AS VARCHAR), '\\N')")} AS h FROM documents),
    s AS (SELECT source, sum(size) AS source_size FROM t GROUP BY source),
    r AS (SELECT *, {w} AS w FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM s)),
    o AS (SELECT *, {MOST} * source_size / w AS cap, row_number() OVER (ORDER BY {MOST} * source_size / w, source NULLS LAST) AS k FROM r),
    v AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum({MOST} * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
    g AS (SELECT source, source_size, CASE WHEN level * w >= {MOST} * source_size THEN CAST({MOST} * source_size AS DOUBLE)
        ELSE (SELECT level FROM v f WHERE f.level * f.w < {MOST} * f.source_size ORDER BY k LIMIT 1) * w END AS target FROM v),
    x AS (SELECT t.doc_id, t.size, g.source_size, g.target, row_number() OVER (PARTITION BY t.source ORDER BY t.size, h, t.doc_id) AS place,
        CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS each,
        {md5(f"'offset{SEED}|' || coalesce(t.source, '\\N')")} / CAST(1152921504606846976 AS DOUBLE) AS u FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(floor(place * each + u) - floor((place - 1) * each + u) AS BIGINT) * size AS taken FROM x"""


def _spans() -> str:
    """Every shortest run is named by its words; the first place of each stays.  A sentence has a word, so a run of ``RUN_WORDS`` sentences has enough."""
    words = lambda x: f"regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+')"
    most = max(SPAN, RUN_WORDS)
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split(regexp_replace(coalesce(text, ''), '({END})', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM documents),
    s AS (SELECT doc_id, i, p[i] AS piece, {words("p[i]")} AS w FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM t)),
    r AS (SELECT a.doc_id, a.i AS first, b.i AS last, list_reduce(list(b.w) OVER run, lambda x, y: x || y) AS w, len(a.w) AS n_first FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + {most}
        WINDOW run AS (PARTITION BY a.doc_id, a.i ORDER BY b.i)),
    e AS (SELECT * FROM r WHERE last - first + 1 >= {SPAN} AND len(w) >= {RUN_WORDS} AND n_first > 0),
    k AS (SELECT doc_id, first, last, array_to_string(w, ' ') AS name FROM e
        QUALIFY last = min(last) OVER (PARTITION BY doc_id, first) OR first = max(first) OVER (PARTITION BY doc_id, last)),
    x AS (SELECT *, min(struct_pack(d := doc_id, f := first)) OVER (PARTITION BY name) AS head FROM k),
    g AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM x WHERE head <> struct_pack(d := doc_id, f := first)),
    c AS (SELECT s.doc_id, count(*) AS n_sentences, count(g.i) AS n_removed, coalesce(sum(CASE WHEN g.i IS NOT NULL THEN length(piece) END), 0) AS gone, string_agg(piece, '' ORDER BY s.i) FILTER (g.i IS NULL) AS kept
        FROM s LEFT JOIN g ON g.doc_id = s.doc_id AND g.i = s.i GROUP BY s.doc_id)
    SELECT t.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(gone, 0) AS BIGINT) AS removed_chars, sha256(coalesce(kept, '')) AS kept_sha256
    FROM t LEFT JOIN c ON c.doc_id = t.doc_id"""


def _shards(shards: int = 40) -> str:
    """By exact running sums over all rows in key order, where the operator only probes histograms."""
    md5 = lambda x: f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"
    slack = Fraction(str(TOLERANCE))
    middle = lambda below, size: f"least({shards - 1}, ((2 * ({below}) + {size}) * {shards}) // (2 * total))"
    # The 32-bit check sum byte by byte, by its usual table.
    table = "SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY n) AS k FROM range(256) r(n)"
    data = "[4294967295] || list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))"
    return f"""WITH k AS ({table}),
    z AS (SELECT doc_id, xor(list_reduce({data}, lambda a, b: xor(a >> 8, k[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), k),
    t AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + {ROW_OVERHEAD} AS size,
        CASE WHEN text IS NULL THEN {md5("'null'")} ELSE {md5("'text|' || text")} END AS k1, {md5("'row|' || coalesce(CAST(doc_id AS VARCHAR), '\\N')")} AS k2, coalesce(text, '') AS text FROM documents),
    o AS (SELECT *, CAST(sum(size) OVER (ORDER BY k1, k2 ROWS UNBOUNDED PRECEDING) AS HUGEINT) AS stop, CAST(sum(size) OVER () AS HUGEINT) AS total FROM t),
    g AS (SELECT k1, min(stop - size) AS below, max(stop) AS stop, count(*) AS n, any_value(total) AS total FROM o GROUP BY k1),
    c AS (SELECT DISTINCT k1 FROM g, range(1, {shards}) AS r(j) WHERE n > 1
        AND least(j * total - below * {shards}, stop * {shards} - j * total) > 0 AND {slack.denominator} * least(j * total - below * {shards}, stop * {shards} - j * total) > {slack.numerator} * total),
    p AS (SELECT o.*, CAST(CASE WHEN c.k1 IS NULL THEN {middle("g.below", "(g.stop - g.below)")} ELSE {middle("o.stop - o.size", "o.size")} END AS INTEGER) AS shard
        FROM (SELECT doc_id, size, k1, k2, stop, text, total FROM o) o JOIN (SELECT k1, below, stop FROM g) g ON g.k1 = o.k1 LEFT JOIN c ON c.k1 = o.k1)
    SELECT p.doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k1, k2) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM p JOIN z ON z.doc_id IS NOT DISTINCT FROM p.doc_id"""


def _periods() -> str:
    """A run of four periods starts with three words that come again one period later, and three times or more in all: such distances are tried."""
    table = "SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY n) AS k FROM range(256) r(n)"
    data = "[4294967295] || list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))"
    return f"""WITH k AS ({table}),
    h AS (SELECT doc_id, w, len(w) AS n, xor(list_reduce({data}, lambda a, b: xor(a >> 8, k[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM (SELECT doc_id, {WORDS} AS w, hex(encode(CAST(doc_id AS VARCHAR))) AS x FROM documents), k),
    c AS (SELECT *, (h // 10) % nullif(n, 0) AS a FROM h),
    t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) ELSE w END AS w FROM c),
    g AS (SELECT doc_id, n, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT *, unnest(range(greatest(n - 2, 0))) AS i FROM t)),
    f AS (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 3),
    q AS (SELECT DISTINCT a.doc_id, b.i - a.i AS q FROM f a JOIN f b ON b.doc_id = a.doc_id AND b.g = a.g AND b.i > a.i AND {TIMES} * (b.i - a.i) <= a.n),
    m AS (SELECT doc_id, q, unnest(list_filter(range(n - q), lambda i: w[i + 1] = w[i + q + 1])) AS i FROM t JOIN q USING (doc_id)),
    j AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM m) GROUP BY doc_id, q, part HAVING count(*) + q >= greatest({LEAST}, {TIMES} * q)),
    r AS (SELECT doc_id, s, l, min(q) AS q FROM j GROUP BY doc_id, s, l),
    b AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed, arg_min({{'s': s, 'l': l, 'q': q}}, {{'l': -l, 's': s, 'q': q}}) AS x FROM r GROUP BY doc_id),
    d AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
    w AS (SELECT t.doc_id, string_agg(t.x, ' ' ORDER BY t.i) FILTER (d.i IS NULL) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM t) t LEFT JOIN d ON d.doc_id = t.doc_id AND d.i = t.i GROUP BY t.doc_id)
    SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, x.s AS start, x.l AS length, x.q AS period, 1000 * x.l // x.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM t LEFT JOIN b ON b.doc_id = t.doc_id LEFT JOIN w ON w.doc_id = t.doc_id"""


def _spelling(typo_every: int = 31) -> str:
    """Near words by what is left when one letter goes: a word itself for insertions, the same at the same place for replacements."""
    upper = "".join(map(chr, range(65, 91)))
    table = "SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY n) AS k FROM range(256) r(n)"
    data = "[4294967295] || list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))"
    return f"""WITH RECURSIVE k AS ({table}),
    o AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{upper}', '{upper.lower()}') AS w FROM documents) WHERE length(w) >= {LEAST_LENGTH} GROUP BY doc_id, w),
    z AS (SELECT w, n, xor(list_reduce({data}, lambda a, b: xor(a >> 8, k[(xor(a, b) & 255) + 1])), 4294967295) AS c FROM (SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS h FROM o), k),
    v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN c % {typo_every} = 0 THEN substr(w, 1, CAST(c % length(w) AS BIGINT)) || substr(w, CAST(c % length(w) AS BIGINT) + 2) ELSE w END AS word FROM z) WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
    d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS x FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
    e AS (SELECT DISTINCT d.word AS a, d.n AS na, v.word AS b, v.n AS nb FROM d JOIN v ON v.word = d.x),
    p AS (SELECT a AS word, b AS near, nb AS near_n FROM e UNION ALL SELECT b, a, na FROM e UNION ALL SELECT d.word, f.word, f.n FROM d JOIN d f ON f.x = d.x AND f.i = d.i AND f.word <> d.word),
    b AS (SELECT word, count(*) AS n_near, arg_min(near, {{'m': -near_n, 'w': encode(near)}}) AS best, max(near_n) AS best_n FROM p GROUP BY word),
    g AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * v.n THEN best END AS form, CASE WHEN best_n >= {RATIO} * v.n THEN best_n END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
    r AS (SELECT word, word AS root, 0 AS step FROM g UNION ALL SELECT r.word, g.form, step + 1 FROM r JOIN g ON g.word = r.root WHERE g.form IS NOT NULL)
    SELECT g.word, form, t.root, n, n_near, form_n FROM g JOIN (SELECT word, arg_max(root, step) AS root FROM r GROUP BY word) t ON t.word = g.word"""


ORACLES = {
    "op1_histogram_shards": _shards(), "op3_divergence_rules": _quality(), "op4_prefix_doubling": SUBSTRINGS, "op5_lsh_forest_join": NEAR, "op9_systematic_mix": _mix(),
    "op10_sentence_spans": _spans(), "op11_factor_runs": _periods(), "op12_edit_neighbourhoods": _spelling(),
}
