"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import conversations, decontam, divergence, langid, licenses, lm_scores, mixing, nearest, quality_fm, quality_rules, secrets, simhash_dedup, toxicity
from .common import fold, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licenses(table(spark, sf_dir, "documents"))
    join = lambda c: F.array_join(c, ",")
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), join("sentence_ids").alias("sentence_ids"), join("licenses").alias("licenses"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores.lm_scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_backoff", F.round("log_score", 4).alias("log_score"), F.round("word_score", 6).alias("word_score"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_repair(table(spark, sf_dir, "conversations"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ten = (op1_secret_scan, op2_benchmark_decontamination, op3_quality_rules, op4_simhash_near_dedup, op5_quality_classifier, op6_toxicity, op7_license_scan, op8_lm_scores, op9_mixing, op10_language_id, op11_source_divergence, op12_conversation_repair, op13_nearest_neighbours, pipeline)
    return {f.__name__: f for f in ten}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    known = "MAP {" + ", ".join(f"{_quote(s)}: {_quote(i)}" for s, i in licenses.SENTENCES.items()) + "}"
    texts = [(name, _quote("".join(f";{i};" for i in rule))) for name, rule in licenses.RULES]
    steps = ", ".join(f"replace(s{i}, {t}, '#') AS s{i + 1}" for i, (_, t) in enumerate(texts))
    cases = ", ".join(f"CASE WHEN contains(s{i}, {t}) THEN {_quote(name)} END" for i, (name, t) in enumerate(texts))
    normal = lambda c: f"trim(regexp_replace(replace({c}, '+', {_quote(licenses.LATER + ' ')}), {_quote(licenses.OTHER)}, ' ', 'g'))"
    tag, later = _quote(licenses.TAG_LINE), _quote(licenses.LATER)
    line = lambda c: f"""CASE WHEN starts_with({normal(c)}, {tag})
        THEN list_transform(regexp_split_to_array(replace(substr({normal(c)}, {len(licenses.TAG_LINE) + 1}), {later}, '+'), {_quote(licenses.OPERATORS)}), lambda x: {known}[{tag} || replace(trim(x), '+', {later})])
        ELSE [{known}[{normal(c)}]] END"""  # noqa: E731
    clear = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for x, y in licenses.ABBREVIATIONS:
        clear = f"replace({clear}, {_quote(x)}, {_quote(y)})"
    return f"""
WITH cut AS (
  SELECT doc_id, regexp_split_to_array({clear}, {_quote(licenses.SENTENCE_END)}) AS pieces
  FROM documents
), ids AS (
  SELECT doc_id, list_filter(flatten(list_transform(pieces, lambda p: CASE WHEN NOT contains(p, chr(10)) THEN {line('p')}
    WHEN {known}[{normal('p')}] IS NOT NULL THEN [{known}[{normal('p')}]] ELSE flatten(list_transform(string_split(p, chr(10)), lambda s: {line('s')})) END)), lambda i: i IS NOT NULL) AS ids FROM cut
), seqs AS (
  SELECT doc_id, ids, ';' || array_to_string(ids, ';;') || ';' AS s0, {steps} FROM ids
)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL))), ',') AS licenses
FROM seqs"""


_LM_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), tokens AS (
  SELECT r, unnest(w) AS b, unnest(list_concat([NULL], w[:-2])) AS a, generate_subscripts(w, 1) AS i FROM words
), uni AS (SELECT b, count(*) AS c FROM tokens GROUP BY b),
bi AS (SELECT a, b, count(*) AS c FROM tokens WHERE i > 1 GROUP BY a, b),
total AS (SELECT count(*) AS n FROM tokens),
scored AS (
  SELECT t.r, i > 1 AND bi.c < 2 AS backed,
         CASE WHEN i = 1 THEN ln(ub.c / n) WHEN bi.c >= 2 THEN ln(bi.c) - ln(ua.c) ELSE ln(0.4) + ln(ub.c / n) END AS s
  FROM tokens t CROSS JOIN total JOIN uni ub ON ub.b = t.b LEFT JOIN uni ua ON ua.b = t.a LEFT JOIN bi ON bi.a = t.a AND bi.b = t.b
), docs AS (SELECT r, count(*) AS k, count(*) FILTER (backed) AS m, sum(s) AS s FROM scored GROUP BY r)
SELECT doc_id, coalesce(k, 0)::BIGINT AS n_words, coalesce(m, 0)::BIGINT AS n_backoff,
       round(coalesce(s, 0.0), 4) AS log_score, round(s / k, 6) AS word_score
FROM words LEFT JOIN docs USING (r)"""

_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 12))::BIGINT AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, [5, 2, 1][k % 3 + 1] AS w, 3 * source_size AS cap FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM weighed WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stop AS (
  SELECT level FROM levels WHERE cap >= level * w ORDER BY cap / w, source NULLS LAST LIMIT 1
), goals AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT level FROM stop) * w), cap::DOUBLE) AS target FROM levels
), passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS passes FROM goals
), ids AS (
  SELECT s.source, h, sum(size) AS n, count(*) AS c, any_value(target - passes * source_size) AS rest
  FROM sized s JOIN passes p ON s.source IS NOT DISTINCT FROM p.source GROUP BY s.source, h
), upto AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS u FROM ids),
edge AS (SELECT source, min(h) AS h0, floor(arg_min((rest - u + n) * c / n, h) + 0.5::DOUBLE) AS k FROM upto WHERE u > rest GROUP BY source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY doc_id) AS r FROM sized)
SELECT doc_id, size, p.source_size, target,
       (size * least(passes + coalesce((h < h0)::INT + (h = h0 AND r <= k)::INT, 0), 3))::BIGINT AS taken
FROM ranked s JOIN passes p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN edge e ON s.source IS NOT DISTINCT FROM e.source"""


_REPAIR_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT),
             lambda acc, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(acc, b)), 4294967295), 4294967295) % 20 AS kind
  FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, role[1] AS c, lag(role[1]) OVER w AS before
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), judged AS (
  SELECT *, bare = '' AS blank, bare <> '' AND again > 1 AS duplicate, bare <> '' AND again = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
         CASE WHEN bare <> '' AND again = 1 AND right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS more FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 't': ''} AS s0, {'c': 1000000000000::BIGINT, 'a': '', 't': ''} AS s1,
         {'c': 1000000000000::BIGINT, 'a': '', 't': ''} AS s2, {'c': 1000000000000::BIGINT, 'a': '', 't': ''} AS s3 FROM counts
  UNION ALL
  SELECT w.conv_id, r.i,
    {'c': s0.c + 4, 'a': s0.a || 'D', 't': s0.t},
    list_min([{'c': s1.c + 4, 'a': s1.a || 'D', 't': s1.t}] || CASE WHEN NOT blank AND NOT duplicate AND r.c = 's' THEN [{'c': s0.c + more, 'a': s0.a || 'K', 't': s0.t || chr(10) || role || ':' || text}] ELSE [] END),
    list_min([{'c': x2.c + 4, 'a': x2.a || 'D', 't': x2.t}] || CASE WHEN blank OR duplicate THEN [] ELSE list_concat(
      [{'c': s.c + 3 + more, 'a': s.a || 'R', 't': s.t || chr(10) || 'user:' || text} FOR s IN [s0, s1, x3]],
      CASE WHEN r.c = 'u' THEN [{'c': s.c + more, 'a': s.a || 'K', 't': s.t || chr(10) || role || ':' || text} FOR s IN [s0, s1, x3]] ELSE [] END) END),
    list_min([{'c': x3.c + 4, 'a': x3.a || 'D', 't': x3.t}] || CASE WHEN blank OR duplicate THEN [] ELSE list_concat([{'c': x2.c + 3 + more, 'a': x2.a || 'R', 't': x2.t || chr(10) || 'assistant:' || text}],
      CASE WHEN r.c = 'a' THEN [{'c': x2.c + more, 'a': x2.a || 'K', 't': x2.t || chr(10) || role || ':' || text}] ELSE [] END) END)
  FROM (
    SELECT *, list_min([s3, {'c': x2.c + 3, 'a': x2.a || 'I', 't': x2.t || chr(10) || 'assistant:'}]) AS x3
    FROM (SELECT *, list_min([s2] || [{'c': s.c + 3, 'a': s.a || 'I', 't': s.t || chr(10) || 'user:'} FOR s IN [s0, s1, s3]]) AS x2 FROM walk)
  ) w JOIN judged r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
), ended AS (
  SELECT w.conv_id, list_min([s0, s3, {'c': x2.c + 3, 'a': x2.a || 'I', 't': x2.t || chr(10) || 'assistant:'}]) AS best
  FROM (SELECT *, list_min([s2] || [{'c': s.c + 3, 'a': s.a || 'I', 't': s.t || chr(10) || 'user:'} FOR s IN [s0, s1]]) AS x2 FROM walk) w
  JOIN counts n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


_DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS MATERIALIZED (SELECT d, lang, source, unnest(w) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
used AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM used GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM docs),
ps AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN used u USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM ps x JOIN ps y ON x.lang = y.lang AND x.term = y.term
         WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), terms AS (
  SELECT lang, source, term AS item, (p - q)::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM ps WHERE c > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, rank::INT FROM terms WHERE rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": _DIVERGENCE_SQL, "op12_conversation_repair": _REPAIR_SQL, "op7_license_scan": _license_sql(), "op8_lm_scores": _LM_SQL, "op9_mixing": _MIX_SQL}
