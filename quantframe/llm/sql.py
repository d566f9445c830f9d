"""The same as some of the queries, as SQL for DuckDB.

The other operators (trained models, signatures, token ids and files) have no counterpart in SQL; their tests
compare them with brute force, round trips and held-out labels.
"""

from __future__ import annotations

from quantframe.llm.collocations import Settings as Phrases
from quantframe.llm.fill_in_middle import MARKS
from quantframe.llm.fill_in_middle import Settings as Frames
from quantframe.llm.quality_rules import CAPITALS, LEAST_SPREAD, SYMBOLS, Rules
from quantframe.llm.url_filter import SCHEME

SPACE = r"[\x20\x09-\x0D]"


def quality_rules(rules: Rules = Rules()) -> str:
    limits = ", ".join(f"max(CASE WHEN share = '{k}' THEN mid + {rules.spread} * greatest(high - mid, {v}) END) AS {k}"
                       for k, v in LEAST_SPREAD.items())
    picked = ", ".join(f"CASE WHEN o.docs >= {rules.min_group} THEN o.{k} WHEN l.docs >= {rules.min_group} THEN l.{k} "
                       f"ELSE e.{k} END AS {k}" for k in LEAST_SPREAD)
    over = ", ".join(f"CASE WHEN b.{k} > t.{k} THEN '{k}' END" for k in LEAST_SPREAD)
    buckets = ", ".join(f"{k} - {k} % (1 << greatest(length(bin({k})) - 6, 0)) AS b_{k}" for k in LEAST_SPREAD)
    rows = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS share, b_{k} AS bucket FROM bucketed WHERE n_words > 0"
                              for k in LEAST_SPREAD)

    def level(name: str, keys: str) -> str:
        by = f"{keys}, share" if keys else "share"
        lead, group = (f"{keys},", f"GROUP BY {keys}") if keys else ("", "")
        return f"""{name} AS (
          SELECT {lead} max(docs) AS docs, {limits} FROM (
            SELECT {by}, min(CASE WHEN upto * 1000 >= total * 500 THEN bucket END) AS mid,
                   min(CASE WHEN upto * 1000 >= total * 750 THEN bucket END) AS high, max(total) AS docs
            FROM (SELECT {by}, bucket, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto,
                         sum(n) OVER (PARTITION BY {by}) AS total
                  FROM (SELECT {by}, bucket, count(*) AS n FROM sketch GROUP BY {by}, bucket))
            GROUP BY {by}) {group})"""

    return f"""
    WITH split AS (
      SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
             list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{SPACE}', '', 'g') <> '') AS l
      FROM documents),
    windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS key
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)),
    repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + d AS p FROM repeated, range(3) AS r(d)) GROUP BY doc_id),
    counts AS (
      SELECT s.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             length(t) - length(translate(t, '{CAPITALS}', '')) AS n_capitals, len(l) AS n_lines
      FROM split s LEFT JOIN covered c USING (doc_id)),
    shares AS (
      SELECT *, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbols,
             CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats,
             CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS lines,
             CASE WHEN word_chars > 0 THEN n_capitals * 1000 // word_chars ELSE 0 END AS capitals,
             CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS width
      FROM counts),
    bucketed AS (SELECT *, {buckets} FROM shares),
    sketch AS ({rows}),
    {level("own", "lang, source")}, {level("by_lang", "lang")}, {level("everything", "")},
    limits AS (SELECT o.lang, o.source, {picked} FROM own o JOIN by_lang l ON o.lang = l.lang, everything e),
    judged AS (
      SELECT b.*, n_words < {rules.min_words} OR n_repeat_words * 100 > n_words * {rules.max_repeat_percent} AS base_failed,
             array_to_string(list_filter([{over}], lambda x: x IS NOT NULL), ',') AS rejected_by
      FROM bucketed b LEFT JOIN limits t ON b.lang = t.lang AND b.source = t.source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM judged"""


def url_filter() -> str:
    def nibbles(column: str, start: int) -> str:
        return f"CAST('0x' || substr(md5({column}), {start}, 4) AS INT)"

    def entry(name: str, kind: str, pattern: str, action: str, day: str, source: str) -> str:
        return (f"SELECT '{name}' AS list, '{kind}' AS kind, {pattern} AS pattern, '{action}' AS action, "
                f"TIMESTAMP '2024-01-01' + to_days(CAST({day} AS INT)) AS ts FROM {source}")

    return f"""
    WITH read AS (
      SELECT page_id, rtrim(lower(regexp_extract(url, '{SCHEME}', 1)), '.') AS h, regexp_extract(url, '{SCHEME}', 2) AS p,
             TIMESTAMP '2024-01-01' + to_days(CAST((page_id * 7919) % 366 AS INT)) AS fetched FROM pages),
    captures AS (SELECT page_id, fetched, CASE WHEN h <> '' THEN h END AS h, CASE WHEN p = '' THEN '/' ELSE p END AS p FROM read),
    hosts AS (SELECT DISTINCT regexp_replace(h, '^m\\.', '') AS host, p FROM captures WHERE h IS NOT NULL),
    named AS (SELECT host, {nibbles('host', 1)} AS a, {nibbles('host', 5)} AS b, {nibbles('host', 9)} AS c
              FROM (SELECT DISTINCT host FROM hosts)),
    parts AS (SELECT key, {nibbles('key', 1)} AS a FROM (
      SELECT DISTINCT host || '/' || regexp_extract(p, '^/([^/]+)/', 1) AS key FROM hosts WHERE regexp_extract(p, '^/([^/]+)/', 1) <> '')),
    entries AS ({" UNION ALL ".join((
        entry("adult", "host", "host", "add", "b % 300", "named WHERE a % 3 = 0"),
        entry("adult", "host", "host", "remove", "b % 300 + 40", "named WHERE a % 3 = 0 AND c % 2 = 0"),
        entry("adult", "host", "host", "add", "b % 300 + 60", "named WHERE a % 3 = 0 AND c % 4 = 0"),
        entry("trusted", "host", "host", "add", "b % 100", "named WHERE c % 11 = 0"),
        entry("malware", "prefix", "key", "add", "a % 366", "parts WHERE a % 5 = 0")))}),
    latest AS (
      SELECT page_id, e.list, e.kind, e.pattern, arg_max(action, ts) AS state
      FROM captures c JOIN entries e ON e.ts <= c.fetched AND (
        (e.kind = 'host' AND (c.h = e.pattern OR ends_with(c.h, '.' || e.pattern)))
        OR (e.kind = 'prefix' AND starts_with(rtrim(c.h || c.p, '/') || '/', e.pattern || '/')))
      GROUP BY ALL),
    held AS (SELECT page_id, list_sort(list_distinct(list(list))) AS lists FROM latest WHERE state = 'add' GROUP BY page_id)
    SELECT c.page_id, coalesce(array_to_string(lists, ','), '') AS lists,
           coalesce(len(lists) > 0 AND NOT list_contains(lists, 'trusted'), false) AS blocked
    FROM captures c LEFT JOIN held USING (page_id)"""


def fill_in_middle(settings: Frames = Frames()) -> str:
    heads = ", ".join(f"CAST('0x' || substr(h, {1 + 8 * k}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    plain = " OR ".join(["n = 0", *(f"contains(t, '{m.decode()}')" for m in MARKS),
                         f"h3 % 100 >= {100 - settings.plain_percent}"])
    return f"""
    WITH hashed AS (
      SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
             sha256('{settings.seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
    placed AS (SELECT doc_id, t, n, {heads} FROM hashed),
    formed AS (
      SELECT *, CASE WHEN {plain} THEN 'plain' WHEN h4 % 100 < {settings.spm_percent} THEN 'spm' ELSE 'psm' END AS form,
             least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high FROM placed),
    cut AS (
      SELECT *, substr(t, 1, low) AS prefix, substr(t, low + 1, high - low) AS middle, substr(t, high + 1) AS suffix FROM formed)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM cut"""


def collocations(settings: Phrases = Phrases()) -> str:
    longest, words = settings.longest, "string_split_regex(piece, '[\\x20\\x09]+')"
    grams = " UNION ALL ".join(
        f"SELECT lang, {m} AS m, array_to_string(w[i:i + {m - 1}], ' ') AS phrase FROM (SELECT lang, w, "
        f"unnest(range(1, len(w) - {m - 2})) AS i FROM split)" for m in range(1, longest + 1))
    return f"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    split AS (SELECT lang, list_filter({words}, lambda x: x <> '') AS w FROM pieces),
    counts AS (SELECT lang, m, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL),
    totals AS (SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang),
    candidates AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE m > 1 AND f >= {settings.least}),
    inner_parts AS (
      SELECT lang, m, a, array_to_string(w[i:j], ' ') AS phrase
      FROM (SELECT lang, m, a, w, i, unnest(range(i + 1, m + 1)) AS j
            FROM (SELECT lang, m, a, w, unnest(range(1, m)) AS i FROM candidates))
      WHERE j - i + 1 < m),
    covered AS (SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY ALL),
    whole AS (
      SELECT c.* FROM candidates c LEFT JOIN covered v USING (lang, phrase)
      WHERE v.longer IS NULL OR 100 * v.longer < {settings.percent} * c.a),
    cuts AS (
      SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:m], ' ') AS rest
      FROM (SELECT *, unnest(range(1, m)) AS k FROM whole)),
    scores AS (
      SELECT x.lang, x.phrase, x.a, k, p.f AS l, q.f AS r, n,
             CAST((1000::HUGEINT * a * n) // (p.f::HUGEINT * q.f) AS BIGINT) AS score
      FROM cuts x JOIN counts p ON x.lang = p.lang AND x.first = p.phrase
      JOIN counts q ON x.lang = q.lang AND x.rest = q.phrase JOIN totals t ON x.lang = t.lang),
    best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT * FROM (
      SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
             a, l, r, CAST(n AS BIGINT) AS n, score FROM best) WHERE rank <= {settings.top}"""


def statements() -> dict[str, str]:
    return {"op9_quality_rules": quality_rules(), "op11_fill_in_middle": fill_in_middle(),
            "op12_collocations": collocations(), "op2_url_filter": url_filter()}
