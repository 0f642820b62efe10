"""Operators of this package in plain SQL, from the given tables, with values of their own."""

from __future__ import annotations

URLS = r"""
WITH parts AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
judged AS (
  SELECT page_id, host, path,
         regexp_matches(host, '(^|\.)example\.org$') AS example,
         regexp_matches(host, '(^|\.)org$') AS org,
         regexp_matches(host, '(^|\.)com$') AS com,
         regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)(\.|$)')
           AS listed
  FROM parts
),
ruled AS (
  SELECT *, CASE WHEN example AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN example AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN org AND starts_with(path, '/') THEN 'org/'
                 WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN com AND starts_with(path, '/de/') THEN 'com/de/' END AS rule
  FROM judged
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def mixing() -> str:
    """Words taken per document: rising targets, then documents by hash order while they fit."""
    rounds = []
    for i in range(4):
        rounds.append(f"""
counted{i} AS (
  SELECT *, extra = 0 AND words > 0 AND words <= rest AS may FROM state{i}
),
taken{i} AS (
  SELECT * EXCLUDE (extra, may, rest),
         CASE WHEN may AND SUM(CASE WHEN may THEN words ELSE 0 END) OVER (
                PARTITION BY source, may ORDER BY perm, doc_id, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest
              THEN 1 ELSE extra END AS extra
  FROM counted{i}
),
state{i + 1} AS (
  SELECT *, target - whole * source_size
            - SUM(CASE WHEN extra = 1 THEN words ELSE 0 END) OVER (PARTITION BY source) AS rest
  FROM taken{i}
)""")
    return rf"""
WITH units AS (
  SELECT doc_id, source, size, perm, COUNT(*) AS copies
  FROM (SELECT doc_id, source, len({WORDS}) AS size,
               CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''),
                                                 md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS perm
        FROM documents) d
  GROUP BY doc_id, source, size, perm
),
sizes AS (
  SELECT source, CAST(SUM(size * copies) AS BIGINT) AS source_size FROM units GROUP BY source
),
ranked AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS cap,
         [5, 2, 1][1 + CAST(ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS INT) % 3] AS weight,
         ROW_NUMBER() OVER (ORDER BY source NULLS LAST) AS place
  FROM sizes
),
levels AS (
  SELECT *, cap / weight AS full_at,
         (SUM(source_size) OVER () * CAST(1.5 AS DOUBLE)
          - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, place
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / SUM(weight) OVER (ORDER BY cap / weight, place
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
),
goals AS (
  SELECT source, source_size,
         COALESCE(LEAST(cap, weight * (SELECT level FROM levels WHERE level < full_at
                                       ORDER BY full_at, place LIMIT 1)), cap) AS target
  FROM levels
),
state0 AS (
  SELECT u.*, u.size * u.copies AS words, g.source_size, g.target, 0 AS extra,
         CASE WHEN g.source_size > 0
              THEN CAST(LEAST(FLOOR(g.target / g.source_size), 2) AS INT) ELSE 0 END AS whole,
         g.target - CASE WHEN g.source_size > 0
              THEN CAST(LEAST(FLOOR(g.target / g.source_size), 2) AS INT) ELSE 0 END * g.source_size
           AS rest
  FROM units u JOIN goals g ON u.source IS NOT DISTINCT FROM g.source
),
{",".join(rounds)},
last AS (
  SELECT *, ROW_NUMBER() OVER (
           PARTITION BY source, extra = 0 AND words > 0 AND words < rest * 2
           ORDER BY words, perm, doc_id NULLS LAST) = 1
         AND extra = 0 AND words > 0 AND words < rest * 2 AS closest
  FROM state4
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN closest THEN 1 ELSE extra END) AS BIGINT) AS taken
FROM last, range(copies)
"""


_X = range(5)
_PAIRS = [(i, j) for i in _X for j in range(i + 1)]
_FLOORS = (50, 35, 100, 100, 60)


def _estimates(step: int, binned: str) -> str:
    """CTEs from rows (pool, start, x0 to x4, bin) to est{step}: centre and inverse covariance of
    the three quarters of each pool that lie nearest."""
    sums = ", ".join(
        [f"SUM(x{i}) AS s{i}" for i in _X] + [f"SUM(x{i} * x{j}) AS q{i}{j}" for i, j in _PAIRS]
    )
    totals = ", ".join(
        [f"CAST(SUM(s{i}) AS DOUBLE) AS s{i}" for i in _X]
        + [f"CAST(SUM(q{i}{j}) AS DOUBLE) AS q{i}{j}" for i, j in _PAIRS]
    )
    means = ", ".join(f"s{i} / n AS m{i}" for i in _X)
    spread = ", ".join(
        f"q{i}{j} / n - m{i} * m{j} + CAST({_FLOORS[i] ** 2 if i == j else 0} AS DOUBLE) AS c{i}{j}"
        for i, j in _PAIRS
    )
    ctes = [
        f"""bins{step} AS (
  SELECT pool, start, bin, COUNT(*) AS n, {sums} FROM {binned} GROUP BY pool, start, bin
)""",
        f"""near{step} AS (
  SELECT * FROM (
    SELECT *, COALESCE(SUM(n) OVER (PARTITION BY pool, start ORDER BY bin
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           SUM(n) OVER (PARTITION BY pool, start) AS everything
    FROM bins{step}) b
  WHERE before < everything * CAST(0.75 AS DOUBLE)
)""",
        f"""sums{step} AS (
  SELECT pool, start, MAX(bin) AS cut, CAST(SUM(n) AS DOUBLE) AS n, {totals}
  FROM near{step} GROUP BY pool, start
)""",
        f"mean{step} AS (SELECT *, {means} FROM sums{step})",
        f"cov{step} AS (SELECT *, {spread} FROM mean{step})",
    ]
    last = f"cov{step}"

    def add(name: str, columns: list[str]) -> None:
        nonlocal last
        ctes.append(f"{name}{step} AS (SELECT *, {', '.join(columns)} FROM {last})")
        last = f"{name}{step}"

    for j in _X:
        square = f"c{j}{j}" + "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        add(f"d{j}_", [f"sqrt({square}) AS l{j}{j}"])
        below = [
            f"(c{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} AS l{i}{j}"
            for i in range(j + 1, 5)
        ]
        if below:
            add(f"b{j}_", below)
    for i in _X:
        row = [f"1 / l{i}{i} AS k{i}{i}"]
        for j in range(i):
            total = "".join(f" - l{i}{k} * k{k}{j}" for k in range(j, i))
            row.append(f"(CAST(0 AS DOUBLE){total}) / l{i}{i} AS k{i}{j}")
        add(f"k{i}_", row)
    inverse = ", ".join(
        f"CAST(0 AS DOUBLE){''.join(f' + k{k}{i} * k{k}{j}' for k in range(i, 5))} AS p{i}{j}"
        for i, j in _PAIRS
    )
    ctes.append(f"""est{step} AS MATERIALIZED (
  SELECT pool, start, cut, 1 * l00 * l11 * l22 * l33 * l44 AS determinant,
         {', '.join(f'm{i}' for i in _X)}, {inverse}
  FROM {last}
)""")
    return ",\n".join(ctes)


_SQUARED = "GREATEST(CAST(0 AS DOUBLE)" + "".join(
    f" + CAST({1 if i == j else 2} AS DOUBLE) * p{i}{j} * (x{i} - m{i}) * (x{j} - m{j})"
    for i, j in _PAIRS
) + ", CAST(0 AS DOUBLE))"


def quality() -> str:
    """Base rules by windows over words and lines, then the robust estimates step by step."""
    x = ", ".join(f"v.x{i}" for i in _X)
    steps = [_estimates(0, "started")]
    for step in range(1, 7):
        bins = f"""moved{step} AS (
  SELECT v.pool, e.start, {x}, CAST(LEAST(FLOOR(sqrt({_SQUARED}) * 16), 4096) AS INT) AS bin
  FROM vectors v JOIN est{step - 1} e ON v.pool = e.pool
)"""
        steps += [bins, _estimates(step, f"moved{step}")]
    long = " UNION ALL ".join(f"SELECT pool, {i} AS i, x{i} AS x FROM vectors" for i in _X)
    z = [f"abs(x{i} - fit[{i + 1}].median) / fit[{i + 1}].scale" for i in _X]
    return rf"""
WITH docs AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS words FROM documents
),
tokens AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs
),
windows AS (
  SELECT doc_id, i, LEAD(w, 4) OVER o IS NOT NULL AS whole,
         concat_ws(' ', w, LEAD(w, 1) OVER o, LEAD(w, 2) OVER o, LEAD(w, 3) OVER o, LEAD(w, 4) OVER o)
           AS five
  FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
twice AS (
  SELECT doc_id, i, whole AND COUNT(*) OVER (PARTITION BY doc_id, whole, five) > 1 AS hit FROM windows
),
covered AS (
  SELECT doc_id, MAX(CAST(hit AS INT)) OVER (PARTITION BY doc_id ORDER BY i
                     ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS repeated
  FROM twice
),
repeats AS (
  SELECT doc_id, CAST(SUM(repeated) AS BIGINT) AS n FROM covered GROUP BY doc_id
),
counted AS (
  SELECT d.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT)
           AS n_symbols,
         list_filter(string_split(text, chr(10)),
                     lambda l: regexp_matches(l, '[^ 	-
]')) AS lines,
         COALESCE(r.n, 0) AS n_repeat_words,
         length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_capitals
  FROM docs d LEFT JOIN repeats r ON d.doc_id = r.doc_id
),
stats AS (
  SELECT *, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed
  FROM counted
),
shares AS (
  SELECT *, [CAST(word_chars + 100 AS DOUBLE) / (n_words + 20),
             CAST(n_symbols AS DOUBLE) / (word_chars + 200),
             CAST(n_dup_lines AS DOUBLE) / (n_lines + 5),
             CAST(n_repeat_words AS DOUBLE) / (n_words + 50),
             CAST(n_capitals AS DOUBLE) / (word_chars + 200)] AS share
  FROM stats
),
pools AS (
  SELECT lang, source,
         CASE WHEN n >= 60 THEN CAST(to_json([lang, source]) AS VARCHAR)
              WHEN SUM(CASE WHEN n < 60 THEN n ELSE 0 END) OVER (PARTITION BY lang) >= 60
              THEN CAST(to_json([lang]) AS VARCHAR) ELSE 'all' END AS pool
  FROM (SELECT lang, source, COUNT(*) AS n FROM documents GROUP BY lang, source) b
),
vectors AS MATERIALIZED (
  SELECT s.*, p.pool, {", ".join(f"CAST(FLOOR(sqrt(share[{i + 1}]) * 1000 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS x{i}" for i in _X)}
  FROM shares s JOIN pools p ON s.lang IS NOT DISTINCT FROM p.lang
                            AND s.source IS NOT DISTINCT FROM p.source
),
long AS ({long}),
middle AS (SELECT pool, i, quantile_disc(x, 0.5) AS median FROM long GROUP BY pool, i),
spread AS (
  SELECT l.pool, l.i, quantile_disc(abs(l.x - m.median), 0.5) AS mad
  FROM long l JOIN middle m ON l.pool = m.pool AND l.i = m.i GROUP BY l.pool, l.i
),
fits AS (
  SELECT m.pool, list({{'median': m.median,
           'scale': GREATEST(s.mad * CAST(1.4826 AS DOUBLE), {list(_FLOORS)}[m.i + 1])}} ORDER BY m.i) AS fit
  FROM middle m JOIN spread s ON m.pool = s.pool AND m.i = s.i GROUP BY m.pool
),
placed AS (
  SELECT v.pool, {x}, [sqrt({" + ".join(f"({v}) * ({v})" for v in z)}), {" + ".join(z)},
                       GREATEST({", ".join(z)})] AS starts
  FROM vectors v JOIN fits f ON v.pool = f.pool
),
started AS (
  SELECT * EXCLUDE (starts, d), CAST(LEAST(FLOOR(d * 16), 4096) AS INT) AS bin
  FROM (SELECT *, unnest(starts) AS d, generate_subscripts(starts, 1) - 1 AS start FROM placed) p
),
{",".join(steps)},
best AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pool ORDER BY determinant, start) AS rank
                 FROM est5) e WHERE rank = 1
),
fitted AS (
  SELECT b.* EXCLUDE (cut), (e.cut + CAST(1 AS DOUBLE)) / CAST(16 AS DOUBLE) AS reach
  FROM best b JOIN est6 e ON b.pool = e.pool AND b.start = e.start
)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_SQUARED} / GREATEST(reach * reach / CAST(6.6257 AS DOUBLE), 1)
                           <= CAST(35.8882 AS DOUBLE) AS kept
FROM vectors v JOIN fitted f ON v.pool = f.pool
"""


#: CRC-32 of a decimal number: each byte joins the lowest bits, then eight steps of one bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(
  range(8 * length(CAST(conv_id AS VARCHAR))),
  lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(conv_id AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1)) ELSE 0 END)),
  lambda crc, x: CASE WHEN xor(crc, x) & 1 = 1 THEN xor(xor(crc, x) >> 1, 3988292384) ELSE xor(crc, x) >> 1 END))"""

PREFIX_TRIE = rf"""
WITH own AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id,
         md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, turn_key) AS i FROM own
),
convs AS (SELECT conv_id, {_CRC} % 4 AS h, count(*) AS n FROM own GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, p.i AS place, turn_key, words
  FROM convs c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % 20 AND p.i <= c.h
  UNION ALL
  SELECT c.conv_id, 1000 + p.i AS place, turn_key, words
  FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.i > c.h
),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS depth, '' AS node, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS BIGINT) AS words
  FROM convs
  UNION ALL
  SELECT conv_id, row_number() OVER w AS depth, string_agg(turn_key, '') OVER w AS node,
         left(string_agg(turn_key, '') OVER w, -32) AS parent, words
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM paths),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id,
         count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM ended GROUP BY node
),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
sums AS (
  SELECT a.node, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves,
         sum((b.n_convs - 1) * b.words) AS saved_tokens
  FROM counted b JOIN paths a ON a.conv_id = b.conv_id AND a.depth <= b.depth GROUP BY a.node
)
SELECT c.conv_id, c.depth, up.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s USING (node) LEFT JOIN nodes up ON up.node = c.parent
"""

ORACLES = {
    "op1_quality": quality(),
    "op6_urls": URLS,
    "op8_mixing": mixing(),
    "op11_prefix_trie": PREFIX_TRIE,
}
