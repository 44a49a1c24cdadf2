"""DuckDB SQL for the queries that SQL can express whole."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS, SYMBOLS
from .url_reputation import CORRELATION, DEVIATIONS, DOUBLE_SUFFIXES, LEAST_SHARE
from .url_reputation import RULES as URL_RULES

WORD = r"[^\x20\x09-\x0D]+"
A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def quality_rules() -> str:
    stop = ", ".join(f"'{f}'" for f in sorted({f for words in STOP_WORDS.values() for w in words.split() for f in (w, w.capitalize(), w.upper())}))
    broken = " OR ".join(f"({r.under} > 0 AND n_words >= {r.words} AND {f'{r.where} AND ' if r.where else ''}({' OR '.join([f'{r.over} < {r.least}::DOUBLE * {r.under}'] * (r.least is not None) + [f'{r.over} > {r.most}::DOUBLE * {r.under}'] * (r.most is not None))}))" for r in RULES)
    languages = ", ".join(f"'{name}'" for name in STOP_WORDS)
    count = lambda chars: f"len(regexp_extract_all(text, '[{chars}]'))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang IN ({languages}), TRUE) AS stop_language FROM documents),
w AS (SELECT doc_id, text, stop_language, regexp_extract_all(text, '{WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
pos AS (SELECT doc_id, unnest(words) AS a, unnest(range(len(words))) AS i FROM w),
tri AS (SELECT doc_id, i, a || ' ' || lead(a, 1) OVER o || ' ' || lead(a, 2) OVER o AS g FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
m AS (SELECT doc_id, stop_language, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, {count(SYMBOLS)}::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
  {count('A-Z')} AS n_upper, {count('!')} AS n_exclaim, {count('0-9')} AS n_digits,
  len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({broken}) AS kept FROM b"""


def url_filters() -> str:
    double = ", ".join(f"'{s}'" for s in DOUBLE_SUFFIXES)
    ordered = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered) + " END"

    def level(name: str, child: str, parent: str | None, up: str | None) -> str:
        prior = "(SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM hosts)" if parent is None else "p.mean"
        join = "" if parent is None else f" JOIN {parent} p ON p.key = c.{up}"
        return f"""{name}_p AS (SELECT c.*, {prior} AS prior FROM {child} c{join}),
{name}_r AS (SELECT least(greatest(coalesce((sum((good - n * prior) * (good - n * prior) / n) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0), {CORRELATION[0]}), {CORRELATION[1]}) AS rho FROM {name}_p WHERE n > 0),
{name} AS (SELECT x.*, (good + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) AS mean, n + (1 - rho) / rho AS strength FROM {name}_p x, {name}_r)"""

    return rf"""
WITH cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), {A_TO_Z}), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
outcomes AS (SELECT host, CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END AS good FROM parsed JOIN labels ON doc_id = TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})(\.html|/)?$', 1) AS BIGINT)),
counted AS (SELECT host, sum(good) AS good, count(good) AS n FROM outcomes WHERE good IS NOT NULL GROUP BY 1),
hosts AS (SELECT h.host AS key, array_to_string(string_split(h.host, '.')[CASE WHEN two IN ({double}) THEN -3 ELSE -2 END:], '.') AS domain, CASE WHEN two IN ({double}) THEN two ELSE string_split(h.host, '.')[-1] END AS suffix, coalesce(good, 0) AS good, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT host, array_to_string(string_split(host, '.')[-2:], '.') AS two FROM parsed) h LEFT JOIN counted USING (host)),
by_suffix AS (SELECT suffix AS key, sum(good) AS good, sum(n) AS n FROM hosts GROUP BY 1), by_domain AS (SELECT domain AS key, suffix, sum(good) AS good, sum(n) AS n FROM hosts GROUP BY 1, 2),
{level('suffixes', 'by_suffix', None, None)}, {level('domains', 'by_domain', 'suffixes', 'suffix')}, {level('reputation', 'hosts', 'domains', 'domain')}
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN mean + {DEVIATIONS} * sqrt(mean * (1 - mean) / (strength + 1)) < {LEAST_SHARE} THEN 'block' ELSE 'allow' END) AS verdict FROM parsed JOIN reputation ON key = host"""


def decontamination() -> str:
    words = rf"regexp_extract_all(translate(text, {A_TO_Z}), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+')"
    shingled = "list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)"
    return f"""
WITH q AS (SELECT item_id, unnest({shingled}) AS g FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1),
d AS (SELECT doc_id, unnest({shingled}) AS g FROM (SELECT doc_id, {words} AS w FROM documents) WHERE len(w) > 0)
SELECT doc_id, item_id, CAST(n AS INT) AS item_shingles, CAST(count(*) AS INT) AS shared, count(*) / n AS containment FROM d JOIN q USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8 * n - 1e-9)"""


def collocations() -> str:
    """Longer phrases that contain a candidate have at most its count, so the counts of all n-grams are cut at 30 first."""
    sub = ", ".join(f"CASE WHEN k > {n} THEN array_to_string(w[{i}:{i + n - 1}], ' ') END" for n in (2, 3) for i in range(1, 5 - n + 1))
    return rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {A_TO_Z}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces), total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= 30),
longer AS (SELECT lang, phrase, max(f) AS most FROM (SELECT lang, unnest([{sub}]) AS phrase, f FROM f WHERE k > 2) WHERE phrase IS NOT NULL GROUP BY 1, 2),
cuts AS MATERIALIZED (SELECT c.lang, c.k, c.phrase, c.f AS a, x.j FROM f c, (SELECT unnest([1, 2, 3]) AS j) x WHERE x.j < c.k),
rated AS MATERIALIZED (SELECT cuts.*, p.f AS l, q.f AS r, (2000000::HUGEINT * a) // (p.f::HUGEINT + q.f) AS score FROM cuts
  JOIN f p ON p.lang = cuts.lang AND p.phrase = array_to_string(string_split(cuts.phrase, ' ')[:j], ' ') JOIN f q ON q.lang = cuts.lang AND q.phrase = array_to_string(string_split(cuts.phrase, ' ')[j + 1:], ' ')),
loosest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT x.* FROM loosest x LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000"""


def exact_dedup() -> str:
    return r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)"""


def resampling() -> str:
    """CRC-32 (reversed polynomial 0xEDB88320) by half bytes, from the state after the words before; states are counted once for each distinct n-gram."""
    step = "lambda s, x: xor(s >> 4, half[(xor(s, x) & 15) + 1])"
    follow = lambda state, word: f"list_reduce(list_concat([0, 2], {word}), {step}, {state})"  # noqa: E731  a space is the half bytes 0 and 2
    nibbles = "list_transform(range(length(hex(encode(w)))::BIGINT), lambda i: ('0x' || hex(encode(w))[(CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END)::BIGINT])::BIGINT)"
    half = "list_transform(range(16), lambda i: list_reduce([i, 1, 2, 3, 4], lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END))"

    def side(name: str, source: str, key: str) -> str:
        return rf"""
{name}_w AS (SELECT {key} AS id, regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM {source}),
{name}_p AS (SELECT id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM {name}_w),
{name}_1 AS (SELECT id, i, w AS g1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM {name}_p WINDOW o AS (PARTITION BY id ORDER BY i))"""

    def crcs(prefix: str) -> str:
        return f"""
words AS MATERIALIZED (SELECT w, {nibbles} AS x FROM (SELECT DISTINCT g1 AS w FROM {prefix})),
c1 AS MATERIALIZED (SELECT w, x, list_reduce(x, {step}, 4294967295) AS s FROM words, half),
c2 AS MATERIALIZED (SELECT a.w AS g1, b.w AS w2, {follow('a.s', 'b.x')} AS s FROM (SELECT DISTINCT g1, w2 FROM {prefix} WHERE w2 IS NOT NULL) p JOIN c1 a ON a.w = p.g1 JOIN c1 b ON b.w = p.w2, half),
c3 AS MATERIALIZED (SELECT p.g1, p.w2, p.w3, {follow('a.s', 'b.x')} AS s FROM (SELECT DISTINCT g1, w2, w3 FROM {prefix} WHERE w3 IS NOT NULL) p JOIN c2 a ON a.g1 = p.g1 AND a.w2 = p.w2 JOIN c1 b ON b.w = p.w3, half)"""

    bucket = "xor(s, 4294967295) % 10000"
    return f"""
WITH half AS (SELECT {half} AS half),{side('d', 'documents', 'doc_id')},{side('q', 'benchmark', 'item_id')},
every AS (SELECT 'd' AS side, * FROM d_1 UNION ALL SELECT 'q', * FROM q_1),{crcs('every')},
feature AS (SELECT side, id, {bucket} AS b FROM every JOIN c1 ON w = g1 UNION ALL SELECT side, id, {bucket} FROM every JOIN c2 USING (g1, w2) UNION ALL SELECT side, id, {bucket} FROM every JOIN c3 USING (g1, w2, w3)),
counted AS (SELECT x.b, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'q') AS t FROM (SELECT unnest(range(10000)) AS b) x LEFT JOIN feature USING (b) GROUP BY 1),
gain AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counted),
weighed AS (SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM feature JOIN gain USING (b) WHERE side = 'd' GROUP BY 1),
scored AS (SELECT id AS doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d_w LEFT JOIN weighed USING (id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE words >= 20 QUALIFY rank <= 5 * count(*) OVER () // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)"""


ORACLES = {"op4_url_filters": url_filters(), "op6_quality_rules": quality_rules(), "op9_decontamination": decontamination(), "op11_resampling": resampling(), "op12_collocations": collocations(), "op13_exact_dedup": exact_dedup()}
