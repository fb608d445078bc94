"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from clientele.llm import lines, mixing, quality, reputation, winnowing

WORD = r"[^\x20\x09-\x0D]+"
TRIM = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def line_sql(docs: str = "documents", min_words: int = lines.MIN_WORDS) -> str:
    """Per line of docs(doc_id, text): number, text and whether it is a later copy.

    Every stretch of shortest length that starts or ends at a line is compared as a list of lines.
    """
    return rf"""
    raw AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {docs}),
    each AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM raw),
    counted AS (SELECT doc_id, i, part, len(regexp_extract_all(part, '{WORD}')) AS words,
                       trim(part, {TRIM}) AS l FROM each),
    firsts AS (SELECT doc_id, min(i) AS first_i, min(i) FILTER (words > 0) AS first_word FROM counted GROUP BY doc_id),
    numbered AS (SELECT c.doc_id, c.i, c.part, c.words, c.l,
                        -- a blank first line is a piece of its own
                        count(*) FILTER (words > 0) OVER (PARTITION BY doc_id ORDER BY i) - 1
                          + (coalesce(f.first_word, 1) > 1)::INT AS line
                 FROM counted c JOIN firsts f USING (doc_id)),
    good AS (SELECT doc_id, line, l, words FROM numbered WHERE words > 0),
    lists AS (SELECT doc_id, min(line) AS base, list(l ORDER BY line) AS ls,
                     list(words ORDER BY line) AS ws FROM good GROUP BY doc_id),
    starts AS (SELECT g.doc_id, g.line, e.line AS last FROM good g JOIN good e
                 ON e.doc_id = g.doc_id AND e.line BETWEEN g.line AND g.line + {min_words} JOIN lists x ON x.doc_id = g.doc_id
               WHERE list_sum(x.ws[g.line - x.base + 1:e.line - x.base + 1]) >= {min_words}),
    stretches AS (SELECT doc_id, line, min(last) AS last, 0 AS side FROM starts GROUP BY doc_id, line
                  UNION ALL SELECT doc_id, max(line), last, 1 FROM starts GROUP BY doc_id, last),
    content AS (SELECT s.*, x.ls[s.line - x.base + 1:s.last - x.base + 1] AS c FROM stretches s JOIN lists x USING (doc_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY side, c ORDER BY doc_id, line) AS nth FROM content),
    gone AS (SELECT DISTINCT g.doc_id, g.line FROM ranked r JOIN good g
               ON g.doc_id = r.doc_id AND g.line BETWEEN r.line AND r.last WHERE r.nth > 1),
    judged AS (SELECT n.*, g.line IS NOT NULL AS deleted FROM numbered n
               LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.line = n.line)"""


LINE_DEDUP = f"""WITH {line_sql()}
SELECT doc_id, count(*) FILTER (words > 0) AS n_lines, count(*) FILTER (words > 0 AND deleted) AS n_deleted,
       coalesce(string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (words > 0 AND deleted), '') AS deleted,
       sha256(coalesce(string_agg(part, chr(10) ORDER BY i) FILTER (NOT deleted), '')) AS text_sha256
FROM judged GROUP BY doc_id"""


def _rate_rows() -> str:
    return " UNION ALL ".join(f"SELECT lang, source, '{name}' AS rate, {name} AS v FROM stats WHERE NOT base_failed"
                              for name in (*[r.name for r in quality.RATES], *quality.SIZES))


def quality_sql(docs: str = "documents") -> str:
    """Tables ``stats`` and ``judged``, one row per document each."""
    k = quality.GRAM
    cuts = ", ".join(f"max(q1) FILTER (rate = '{name}') AS {name}_q1, max(q2) FILTER (rate = '{name}') AS {name}_q2"
                     for name in (*[r.name for r in quality.RATES], *quality.SIZES))

    def step(r: quality.Rate) -> str:
        return f"{quality.EVENTS * r.times * r.event} // greatest(1, least(s.{r.size}, c.{r.size}_q2))"
    inside = " AND ".join(
        f"s.{r.name} <= c.{r.name}_q2 + {quality.FENCE} * (c.{r.name}_q2 - c.{r.name}_q1) + {step(r)}"
        + (f" AND s.{r.name} >= c.{r.name}_q2 - {quality.FENCE} * (c.{r.name}_q2 - c.{r.name}_q1) - {step(r)}" if r.low else "")
        for r in quality.RATES)
    m = quality.STRENGTH
    return rf"""
    w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
                 regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM {docs}),
    grams AS (SELECT doc_id, unnest(range(1, len(ws) - {k} + 2)) AS i, ws FROM w WHERE len(ws) >= {k}),
    gram_text AS (SELECT doc_id, i, ws[i:i + {k} - 1] AS g FROM grams),
    twice AS (SELECT doc_id, i FROM gram_text QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range({k}) r(j) GROUP BY doc_id),
    ls AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w),
    line_counts AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM ls
                    WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
    counts AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                      (length(t) - length(regexp_replace(t, '{quality.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
                      length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
                      coalesce(lc.n, 0)::BIGINT AS n_lines, coalesce(lc.dup, 0)::BIGINT AS n_dup_lines,
                      coalesce(c.n, 0)::BIGINT AS n_repeat_words
               FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN line_counts lc USING (doc_id)),
    stats AS (SELECT *, coalesce(1000 * n_symbols // nullif(n_words, 0), 0) AS symbol_rate,
                     coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_line_rate,
                     coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeat_rate,
                     coalesce(1000 * n_upper // nullif(word_chars, 0), 0) AS upper_rate,
                     coalesce(100 * word_chars // nullif(n_words, 0), 0) AS word_length,
                     n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
              FROM counts),
    rates AS ({_rate_rows()}),
    edged AS (SELECT lang, source, rate, CASE WHEN v < 32 THEN v
                     ELSE ((v >> (length(bin(v)) - 5)::INT) + 1 << (length(bin(v)) - 5)::INT) - 1 END AS edge FROM rates),
    levels AS (SELECT 'own' AS level, lang, source, rate, edge FROM edged
               UNION ALL SELECT 'lang', lang, NULL, rate, edge FROM edged
               UNION ALL SELECT 'all', NULL, NULL, rate, edge FROM edged),
    quartiles AS (SELECT level, lang, source, rate, count(*) AS total,
                         quantile_disc(edge, 0.25) AS q1, quantile_disc(edge, 0.5) AS q2
                  FROM levels GROUP BY level, lang, source, rate),
    by_lang AS (SELECT l.lang, l.rate, (l.total * l.q1 + {m} * a.q1) // (l.total + {m}) AS q1, (l.total * l.q2 + {m} * a.q2) // (l.total + {m}) AS q2
                FROM quartiles l JOIN quartiles a ON a.level = 'all' AND a.rate = l.rate WHERE l.level = 'lang'),
    picked AS (SELECT o.lang, o.source, o.rate, (o.total * o.q1 + {m} * l.q1) // (o.total + {m}) AS q1, (o.total * o.q2 + {m} * l.q2) // (o.total + {m}) AS q2
               FROM quartiles o JOIN by_lang l ON l.lang IS NOT DISTINCT FROM o.lang AND l.rate = o.rate WHERE o.level = 'own'),
    cuts AS (SELECT lang, source, {cuts} FROM picked GROUP BY lang, source),
    judged_docs AS (SELECT s.*, coalesce(NOT s.base_failed AND {inside}, false) AS kept FROM stats s
                    LEFT JOIN cuts c ON c.lang IS NOT DISTINCT FROM s.lang AND c.source IS NOT DISTINCT FROM s.source)"""


QUALITY_RULES = f"""WITH {quality_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged_docs"""


def near_dup_sql(docs: str = "documents", shingle: int = 3, numerator: int = 85, denominator: int = 100) -> str:
    """Table ``components``: per document n_shingles and component_id; WITH RECURSIVE."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
    dw AS (SELECT doc_id, regexp_extract_all({lower}, '{WORD}') AS ws FROM {docs}),
    shingle_sets AS (SELECT DISTINCT doc_id, s FROM (
      SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {shingle} THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - {shingle - 2}), lambda i: array_to_string(ws[i:i + {shingle - 1}], ' ')) END) AS s FROM dw)),
    set_sizes AS (SELECT doc_id, count(*) AS n FROM shingle_sets GROUP BY doc_id),
    -- a set of n shares all but the rarest of its shingles with a similar one: match on those
    df AS (SELECT s, count(*) AS f FROM shingle_sets GROUP BY s),
    prefix AS (SELECT doc_id, s FROM (
      SELECT x.doc_id, s, n, row_number() OVER (PARTITION BY x.doc_id ORDER BY f, s) AS r
      FROM shingle_sets x JOIN df USING (s) JOIN set_sizes z ON z.doc_id = x.doc_id)
      WHERE r <= n - ({numerator} * n + {denominator - 1}) // {denominator} + 1),
    candidates AS (SELECT DISTINCT p.doc_id AS a, q.doc_id AS b FROM prefix p JOIN prefix q ON p.s = q.s AND p.doc_id < q.doc_id),
    common_counts AS (SELECT a, b, count(*) AS common FROM candidates c JOIN shingle_sets x ON x.doc_id = a
                 JOIN shingle_sets y ON y.doc_id = b AND y.s = x.s GROUP BY a, b),
    links AS (SELECT a, b FROM common_counts o JOIN set_sizes x ON x.doc_id = a JOIN set_sizes y ON y.doc_id = b
              WHERE {denominator} * common >= {numerator} * (x.n + y.n - common)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM {docs} UNION
                             SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
    components AS (SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, m.component_id FROM dw d LEFT JOIN set_sizes z USING (doc_id)
                   JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id))"""


NEAR_DEDUP = f"""WITH RECURSIVE {near_dup_sql()}
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM components"""


def contamination_sql(docs: str = "documents", percent: int = 5) -> str:
    """Table ``contaminations``: per document its counts, items and verdict."""
    plain = lambda c: f"translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
    doc_words AS (SELECT doc_id, regexp_extract_all({plain('text')}, '{word}') AS ws FROM {docs}),
    item_words AS (SELECT item_id, regexp_extract_all({plain('text')}, '{word}') AS ws FROM benchmark),
    item_windows AS (SELECT DISTINCT item_id, len(w) AS n, array_to_string(w, ' ') AS w FROM (
      SELECT item_id, unnest(list_transform(range(1, greatest(len(ws) - {winnowing.SPAN} + 1, 1) + 1),
                                            lambda i: ws[i:i + {winnowing.SPAN} - 1])) AS w FROM item_words WHERE len(ws) > 0)),
    lengths AS (SELECT DISTINCT n FROM item_windows),
    doc_places AS (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM doc_words, lengths WHERE len(ws) >= n),
    doc_windows AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM doc_places),
    met AS (SELECT doc_id, item_id, i, n FROM doc_windows JOIN item_windows USING (n, w)),
    hit_words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) FROM met) GROUP BY doc_id),
    hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id),
    contaminations AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 100 * coalesce(n_hit, 0) >= {percent} * len(ws) AS contaminated
      FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id))"""


DECONTAMINATION = f"WITH {contamination_sql()} SELECT * FROM contaminations"


def mix_sql(docs: str = "documents") -> str:
    """Table ``mixed``: per document its size, source size, target and copies."""
    weights = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
    seeds = " UNION ALL ".join(f"SELECT {k} AS seed, {m}::BIGINT AS multiplier" for k, m in enumerate(mixing.MULTIPLIERS))
    extra = f"(draw * multiplier % {mixing.PRIME} < fraction * {mixing.PRIME})::BIGINT"
    return rf"""
    sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
                     ('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 8))::BIGINT % {mixing.PRIME} AS draw
              FROM {docs}),
    totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
    weighed AS (SELECT *, {weights}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS weight,
                       {mixing.MOST_REPEATS} * source_size AS cap FROM totals),
    levelled AS (SELECT *, ((sum(source_size) OVER ())::BIGINT * {mixing.BUDGET_PERCENT} / 100
                   - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
                   / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM weighed),
    one_level AS (SELECT *, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER (), max(level) OVER ()) AS filled FROM levelled),
    goals AS (SELECT source, source_size, least(cap::DOUBLE, filled * weight) AS target FROM one_level),
    source_rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM goals),
    split_rates AS (SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS fraction FROM source_rates),
    seeds AS ({seeds}),
    tried AS (SELECT r.source, seed, multiplier, abs(sum(size * (whole + {extra}))::BIGINT - max(target)) AS far
              FROM sizes s JOIN split_rates r ON r.source IS NOT DISTINCT FROM s.source, seeds GROUP BY r.source, seed, multiplier),
    best AS (SELECT source, multiplier FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY far, seed) = 1),
    mixed AS (SELECT s.doc_id, s.size, r.source_size, r.target, whole + {extra} AS copies
              FROM sizes s JOIN split_rates r ON r.source IS NOT DISTINCT FROM s.source
              JOIN best b ON b.source IS NOT DISTINCT FROM s.source)"""


SOURCE_MIXING = f"""WITH {mix_sql()}
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM mixed"""

CHAT_FORMAT = r"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
measured AS (SELECT *, length(text) + length(regexp_replace(text, '[^<>\\]', '', 'g'))
                       + length(role) + length(regexp_replace(role, '[^<>\\]', '', 'g')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars + length('<turn role=></turn>') + 1)::BIGINT AS formatted_chars
FROM turns JOIN (SELECT conv_id AS c, turn AS t, role AS r, text AS x, any_value(chars) AS chars FROM measured GROUP BY ALL)
  ON c = conv_id AND t = turn AND r = role AND x = text GROUP BY conv_id"""


def _url_rule(result: str) -> str:
    """CASE over the rules, the longest first."""
    order = sorted(reputation.RULES, key=lambda r: (len(r.name), len(r.host)), reverse=True)
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, result)}'"
                              for r in order) + " END"


def _strength(table: str) -> str:
    most, least = reputation.STRONGEST, reputation.WEAKEST
    rho = "(spread - expected) / nullif(whole - expected, 0)"
    return (f"SELECT CASE WHEN whole IS NULL OR whole - expected <= 0 OR {rho} <= 0 THEN {most} "
            f"ELSE least({most}, greatest({least}, (1 - {rho}) / ({rho}))) END AS strength FROM ("
            f"SELECT sum(n * pow(bad / n - prior, 2)) AS spread, sum(prior * (1 - prior)) AS expected, sum(n * prior * (1 - prior)) AS whole FROM {table} WHERE n > 0)")


def _two_labels() -> str:
    return ", ".join(f"'{x}'" for x in reputation.TWO_LABEL_SUFFIXES)


URL_FILTERS = rf"""WITH urls AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{reputation.UPPER}', '{reputation.LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
known AS (SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
by_host AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
                   regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS bare, string_split(bare, '.') AS parts
            FROM urls LEFT JOIN known USING (page_id) GROUP BY host),
named AS (SELECT host, n, bad, CASE WHEN regexp_matches(bare, '{reputation.ADDRESS}') THEN '[]' WHEN array_to_string(parts[-2:], '.') IN ({_two_labels()}) THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix,
                 CASE WHEN regexp_matches(bare, '{reputation.ADDRESS}') THEN bare WHEN array_to_string(parts[-2:], '.') IN ({_two_labels()}) THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain FROM by_host),
suffix_sums AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) FROM named) AS prior FROM named GROUP BY suffix),
suffix_strength AS ({_strength('suffix_sums')}),
domain_counts AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY suffix, domain),
domain_sums AS (SELECT d.domain, d.n, d.bad, (s.bad - d.bad + strength * s.prior) / (s.n - d.n + strength) AS prior
                FROM domain_counts d JOIN suffix_sums s USING (suffix), suffix_strength),
domain_strength AS ({_strength('domain_sums')}),
host_sums AS (SELECT host, h.n, h.bad, (d.bad - h.bad + strength * d.prior) / (d.n - h.n + strength) AS prior
              FROM named h JOIN domain_sums d USING (domain), domain_strength),
host_strength AS ({_strength('host_sums')}),
posteriors AS (SELECT host, bad + strength * prior AS a, n - bad + strength * (1 - prior) AS b FROM host_sums, host_strength),
bounds AS (SELECT host, greatest(0, a / (a + b) - {reputation.DEVIATIONS} * sqrt(a * b / (pow(a + b, 2) * (a + b + 1)))) AS bad_bound FROM posteriors)
SELECT page_id, host, path, {_url_rule('name')} AS rule,
       coalesce({_url_rule('verdict')}, CASE WHEN bad_bound > {reputation.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN bounds USING (host)"""


def _repair_sql() -> str:
    """Row by row, the least 'cost, audit' for each state of the output: nothing, system, user, assistant."""
    crc = ("xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(k) + 1), lambda i: "
           "[ascii(substr(k, i::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) "
           "ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295)")

    def add(value: str, cost: str, letter: str) -> str:
        return f"lpad((substr({value}, 1, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({value}, 9) || '{letter}'"
    more = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    stays = "fault NOT IN ('blank', 'duplicate')"

    def taken(value: str, initial: str, rerole: bool) -> str:
        other = add(value, f"1 + {more}", "R") if rerole else "NULL"
        return f"CASE WHEN {stays} THEN CASE WHEN left(role, 1) = '{initial}' THEN {add(value, more, 'K')} ELSE {other} END END"
    edits = ", ".join([f"{add('b0', '2', 'D')} AS e0",
                       f"least({add('b1', '2', 'D')}, {taken('b0', 's', False)}) AS e1",
                       f"least({add('b2', '2', 'D')}, {', '.join(taken(f'b{q}', 'u', True) for q in (0, 1, 3))}) AS e2",
                       f"least({add('b3', '2', 'D')}, {taken('b2', 'a', True)}) AS e3"])
    inserted = "least(e2, " + ", ".join(add(f"e{q}", "5", "I") for q in (0, 1, 3)) + ")"
    return f"""keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hits AS (SELECT *, {crc} % 20 AS hit FROM keyed),
hurt AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hits, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copies(copy) WHERE hit <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hurt),
faulty AS (SELECT *, CASE WHEN trim(text, {TRIM}) = '' THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN right(rtrim(text, {TRIM}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
states AS (
  SELECT DISTINCT conv_id, 0 AS i, '00000000' AS b0, NULL::VARCHAR AS b1, '00000005I' AS b2, '00000010II' AS b3 FROM faulty
  UNION ALL
  SELECT conv_id, i, e0, e1, {inserted}, least(e3, {add(inserted, "5", "I")})
  FROM (SELECT f.conv_id, f.i, {edits} FROM states s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1)),
ends AS (SELECT conv_id, arg_max(least(b0, b3), i) AS best FROM states GROUP BY conv_id),
walk AS (
  SELECT conv_id, substr(best, 9) AS audit, 0 AS pos, 0::BIGINT AS i, 0 AS state, []::VARCHAR[] AS out FROM ends
  UNION ALL
  SELECT w.conv_id, audit, pos + 1, CASE WHEN step = 'I' THEN w.i ELSE w.i + 1 END,
    CASE WHEN step = 'D' THEN state WHEN step = 'K' AND left(f.role, 1) = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END,
    CASE WHEN step = 'D' THEN out ELSE list_append(out, CASE WHEN step = 'K' THEN f.role WHEN state = 2 THEN 'assistant' ELSE 'user' END
      || ':' || CASE WHEN step = 'I' THEN '' ELSE f.text END) END
  FROM (SELECT *, substr(audit, pos + 1, 1) AS step FROM walk WHERE pos < length(audit)) w
  LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1),
repaired AS (SELECT conv_id, array_to_string(arg_max(out, pos), chr(10)) AS lines FROM walk GROUP BY conv_id),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)"""


CONVERSATION_REPAIR = f"""WITH RECURSIVE {_repair_sql()}
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(substr(best, 1, 8)::BIGINT, 0) AS cost,
  coalesce(substr(best, 9), '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id"""

PIPELINE = f"""WITH RECURSIVE {quality_sql()},
stage1 AS (SELECT d.* FROM documents d JOIN judged_docs j USING (doc_id) WHERE j.kept),
{line_sql("stage1")},
new_texts AS (SELECT doc_id, coalesce(bool_or(deleted), false) AS changed,
                     coalesce(string_agg(part, chr(10) ORDER BY i) FILTER (NOT deleted), '') AS new_text FROM judged GROUP BY doc_id),
stage2 AS (SELECT doc_id, new_text AS text, lang, source, CASE WHEN changed THEN length(new_text) ELSE n_chars END AS n_chars
           FROM stage1 JOIN new_texts USING (doc_id) WHERE NOT (changed AND trim(new_text, {TRIM}) = '')),
{near_dup_sql("stage2", 5, 4, 5)},
stage3 AS (SELECT d.* FROM stage2 d JOIN components USING (doc_id) WHERE doc_id = component_id),
{contamination_sql("stage3")},
stage4 AS (SELECT d.* FROM stage3 d JOIN contaminations USING (doc_id) WHERE NOT contaminated),
{mix_sql("stage4")}
SELECT d.* FROM stage4 d JOIN mixed USING (doc_id), unnest(range(copies)) AS copy(nth)"""

ORACLES = {
    "op1_url_filters": URL_FILTERS,
    "op2_minhash_near_dedup": NEAR_DEDUP,
    "op3_line_dedup": LINE_DEDUP,
    "op4_quality_rules": QUALITY_RULES,
    "op6_decontamination": DECONTAMINATION,
    "op9_source_mixing": SOURCE_MIXING,
    "op10_chat_format": CHAT_FORMAT,
    "op13_conversation_repair": CONVERSATION_REPAIR,
}
