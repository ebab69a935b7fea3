"""SQL for DuckDB that states the queries which SQL can express once more, independently."""

_QUALITY_MEASURES = ["symbols", "dup_lines", "repeat_words", "word_length"]


def _quality() -> str:
    slack = {"symbols": 100, "dup_lines": 350, "repeat_words": 400, "word_length": 500}
    unions = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM counted WHERE NOT base_failed" for m in _QUALITY_MEASURES)
    inside = " AND ".join(
        f"coalesce({m} BETWEEN max(lo) FILTER (measure = '{m}') AND max(hi) FILTER (measure = '{m}'), true)"
        for m in _QUALITY_MEASURES)
    cases = " ".join(f"WHEN '{m}' THEN {s}" for m, s in slack.items())

    def quartiles(name: str, keys: str) -> str:
        return f"""{name} AS (
  SELECT {keys}measure, max(total) AS total, min(b) FILTER (upto * 4 >= total) AS q1, min(b) FILTER (upto * 4 >= total * 3) AS q3
  FROM (SELECT {keys}measure, b, sum(n) OVER (PARTITION BY {keys}measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys}measure) AS total
        FROM (SELECT {keys}measure, b, count(*) AS n FROM buckets GROUP BY ALL))
  GROUP BY ALL)"""

    return rf"""
WITH rows AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM rows),
windows AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS p,
    unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS win
  FROM words WHERE len(ws) >= 3),
repeated AS (SELECT rid, p FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) >= 2),
covered AS (
  SELECT rid, sum(least(3, p - coalesce(before, p - 3))) AS n
  FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM repeated) GROUP BY rid),
base AS (
  SELECT rid, doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(n, 0) AS n_repeat_words
  FROM words LEFT JOIN covered USING (rid)),
counted AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(n_symbols * 1000 // nullif(n_words, 0), 0)::BIGINT AS symbols, coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0)::BIGINT AS dup_lines,
    coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0)::BIGINT AS repeat_words, coalesce(word_chars * 1000 // nullif(n_words, 0), 0)::BIGINT AS word_length
  FROM base),
buckets AS (SELECT *, v - v % (2 ** greatest(length(bin(v)) - 8, 0))::BIGINT AS b FROM ({unions})),
{quartiles("by_group", "lang, source, ")},
{quartiles("by_lang", "lang, ")},
{quartiles("by_all", "")},
picked AS (
  SELECT g.lang, g.source, measure, CASE WHEN g.total >= 100 THEN g.q1 WHEN l.total >= 100 THEN l.q1 ELSE a.q1 END AS q1,
    CASE WHEN g.total >= 100 THEN g.q3 WHEN l.total >= 100 THEN l.q3 ELSE a.q3 END AS q3
  FROM by_group g JOIN by_lang l USING (lang, measure) JOIN by_all a USING (measure)),
limits AS (
  SELECT lang, source, measure, q1 - (3 * (q3 - q1) + CASE measure {cases} END) AS lo, q3 + (3 * (q3 - q1) + CASE measure {cases} END) AS hi FROM picked)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND ({inside}) AS kept
FROM counted LEFT JOIN limits USING (lang, source)
GROUP BY rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, symbols, dup_lines, repeat_words, word_length"""



CHAT = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(role) + length(text) + 6 + length(regexp_replace(role || text, '[^\\\[\]<]', '', 'g')))::BIGINT AS formatted_chars
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM joined"""


def _clusters(rounds: int = 3) -> str:
    """Assignment of every vector to every centroid, written out per round."""
    def nearest(name: str, centroids: str) -> str:
        distance = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"
        return f"""{name} AS (
  SELECT rid, vec_id, v, cid, d FROM (SELECT rid, vec_id, v, cid, {distance} AS d FROM vectors CROSS JOIN {centroids})
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, cid) = 1)"""

    steps = []
    for r in range(rounds):
        steps.append(nearest(f"a{r}", f"c{r}"))
        steps.append(f"""s{r} AS (
  SELECT cid, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS moved
  FROM (SELECT cid, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) r(i) GROUP BY cid, i) GROUP BY cid)""")
        steps.append(f"c{r + 1} AS (SELECT cid, coalesce(moved, c) AS c FROM c{r} LEFT JOIN s{r} USING (cid))")
    steps.append(nearest("a", f"c{rounds}"))
    return f"""
WITH vectors AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cid, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM vectors ORDER BY h, v LIMIT 16)),
{", ".join(steps)}
SELECT vec_id, cid::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cid))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a JOIN c{rounds} USING (cid)"""


FILL_IN_MIDDLE = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(ls) AS n, ('0x' || h[1:8])::UBIGINT % (len(ls) + 1) AS x, ('0x' || h[9:16])::UBIGINT % (len(ls) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 100 THEN 'plain'
         WHEN ('0x' || h[25:32])::UBIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM lines),
parts AS (
  SELECT *, array_to_string(ls[1:least(x, y)::BIGINT], '') AS p, array_to_string(ls[least(x, y)::BIGINT + 1:greatest(x, y)::BIGINT], '') AS m,
    array_to_string(ls[greatest(x, y)::BIGINT + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""

COPIES = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)"""

ORACLE = {
    "op4_adaptive_quality": _quality(),
    "op6_prefix_target_chat": CHAT,
    "op11_orchard_clusters": _clusters(),
    "op12_exception_index_fim": FILL_IN_MIDDLE,
    "op13_chunk_recipe_dedup": COPIES,
}
