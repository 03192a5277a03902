"""Registered queries of the engine over the given tables, each with the SQL that must give the same rows.

SQL is left out where none can express the operator (fitted trees, exact transport of more than two points).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import drivers as D
from ..functions import arrays as A
from ..functions import positions as P
from ..functions import text as X
from ..operators import boosting as B
from ..operators import captions as C
from ..operators import captures as Z
from ..operators import kernels as K
from ..operators import learn as L
from ..operators import metrics as M
from ..operators import relational as R
from ..operators import shapley as S
from ..sources import providers, readers
from ..sources.staging import scratch

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _table(spark, d, "documents").select("doc_id", "n_chars"), _table(spark, d, "labels")
    return docs.join(labels, "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"), (1 - F.col("quality")).alias("label"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("v"), "label")


def _curves(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", F.transform("v", F.abs).alias("a"), "v", (F.col("label") < 5).cast("int").alias("label"))


def _r(c: Column, n: int = 6) -> Column:
    return F.round(c, n) + F.lit(0.0)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: _r(F.col(n)) for n in names})


_SCORED = "SELECT l.doc_id, n_chars::DOUBLE AS s, 1 - quality AS y FROM documents JOIN labels l USING (doc_id)"
_E = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a, label FROM embeddings"
_AUC = "sum(pos * (before + neg / 2.0)) / (sum(pos) * sum(neg))"
_BY_SCORE = "SELECT s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM rows GROUP BY s"
_BEFORE = f"SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_BY_SCORE})"


@query(f"""
WITH rows AS ({_SCORED}), span AS (SELECT min(s) AS lo, max(s) AS hi FROM rows),
taus AS (SELECT i, lo + i * (hi - lo) / 199.0::DOUBLE AS tau FROM span, range(200) t(i)),
c AS (SELECT i, tau, count(*) FILTER (s > tau AND y = 1) AS tp, count(*) FILTER (s > tau AND y = 0) AS fp,
             count(*) FILTER (s <= tau AND y = 1) AS fn, count(*) FILTER (s <= tau AND y = 0) AS tn FROM rows, taus GROUP BY i, tau),
m AS (SELECT i, tau, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r,
             CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f, (tp + tn) / (tp + fp + fn + tn) AS acc FROM c)
SELECT i::INT AS i, round(tau, 6) AS tau, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1, round(acc, 6) AS accuracy,
       (SELECT round({_AUC}, 6) FROM ({_BEFORE})) AS auc
FROM m ORDER BY f DESC, m.i LIMIT 1""")
def threshold_detector(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.evaluate_threshold(_scored(spark, d), "score"), "tau", "precision", "recall", "f1", "accuracy", "auc")


@query(f"WITH rows AS (SELECT v[1] AS s, (label < 5)::INT AS y FROM ({_E})) SELECT round({_AUC}, 6) AS auc, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM ({_BEFORE})")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.roc_auc(_curves(spark, d).withColumn("s", F.get("v", F.lit(0))), "s"), "auc")


def _erfc(z: str) -> str:
    """Two-sided p of a normal deviate, by the series of the error function."""
    x = f"({z} / sqrt(2.0::DOUBLE))"
    return f"1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda k: (1 - 2 * (k % 2)) * {x} ** (2 * k + 1) / (gamma(k + 1.0::DOUBLE) * (2 * k + 1))))"


_Z = "greatest(abs(u - n1 * n0 / 2) - 0.5, 0) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1))))"


@query(f"""
WITH rows AS ({_SCORED}), t AS (SELECT sum(pos * (before + neg / 2.0)) AS u, sum(pos)::DOUBLE AS n1, sum(neg)::DOUBLE AS n0, sum((pos + neg)::DOUBLE ** 3 - (pos + neg)) AS ties FROM ({_BEFORE}))
SELECT round(u, 6) AS u, round({_Z}, 6) AS z, round({_erfc(_Z)}, 6) AS p FROM t""")
def mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.mann_whitney(_scored(spark, d), "score"), "u", "z", "p")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"), (1 - F.col("quality")).alias("predicted"))


@query("SELECT y::INT AS label, count(*) FILTER (toxic = y AND quality = 1) AS pred_0, count(*) FILTER (toxic = y AND quality = 0) AS pred_1 FROM labels, range(2) t(y) GROUP BY y")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion_matrix(_judged(spark, d), "predicted")


@query("""
WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp,
                  count(*) FILTER (toxic = 1 AND quality = 1) AS fn, count(*) FILTER (toxic = 0 AND quality = 1) AS tn FROM labels),
e AS (SELECT '1' AS class, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f, tp + fn AS n FROM c
      UNION ALL SELECT '0', tn / nullif(tn + fn, 0), tn / nullif(tn + fp, 0), 2 * tn / nullif(2 * tn + fp + fn, 0), tn + fp FROM c),
z AS (SELECT class, coalesce(p, 0) AS p, coalesce(r, 0) AS r, coalesce(f, 0) AS f, n FROM e),
u AS (SELECT * FROM z UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(n) FROM z UNION ALL SELECT 'weighted avg', sum(p * n) / sum(n), sum(r * n) / sum(n), sum(f * n) / sum(n), sum(n) FROM z)
SELECT class, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1, n::BIGINT AS support FROM u""")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.classification_report(_judged(spark, d), "predicted"), "precision", "recall", "f1")


_YES_NO = """SELECT conv_id, turn, CASE WHEN w IN ('yes', 'no') THEN w WHEN contains(low, 'yes') THEN 'yes' WHEN contains(low, 'no') THEN 'no' ELSE 'unknown' END AS answer,
  CASE WHEN turn % 4 < 2 THEN 'yes' ELSE 'no' END AS gt
FROM (SELECT *, regexp_replace(regexp_split_to_array(low, '\\s+')[1], '[^a-z]', '', 'g') AS w FROM (SELECT *, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS low FROM conversations WHERE role = 'assistant'))"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", X.yes_no(F.col("text")).alias("answer"), F.when(F.col("turn") % 4 < 2, "yes").otherwise("no").alias("gt"))


@query(f"SELECT conv_id, turn, answer, CASE answer WHEN 'yes' THEN (gt = 'no')::INT ELSE -1 END AS label_yes_only, CASE answer WHEN 'yes' THEN (gt = 'no')::INT WHEN 'no' THEN (gt = 'yes')::INT ELSE -1 END AS label FROM ({_YES_NO})")
def pope_label(spark: SparkSession, d: str) -> DataFrame:
    a, g = F.col("answer"), F.col("gt")
    return _answers(spark, d).select("conv_id", "turn", "answer", X.pope_label(a, g).alias("label_yes_only"), X.pope_label(a, g, False).alias("label"))


@query(f"""
WITH c AS (SELECT count(*) AS n, count(*) FILTER (answer = 'yes' AND gt = 'yes') AS tp, count(*) FILTER (answer = 'yes' AND gt = 'no') AS fp,
                  count(*) FILTER (answer = 'no' AND gt = 'yes') AS fn, count(*) FILTER (answer = 'no' AND gt = 'no') AS tn FROM ({_YES_NO}))
SELECT round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + fp) / n, 6) AS yes_ratio, n AS n_total, tp + tn AS n_correct, tp, fp, fn, tn FROM c WHERE n > 0""")
def pope_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.pope_accuracy(_answers(spark, d)), "accuracy", "precision", "recall", "f1", "yes_ratio")


@query(r"""
SELECT page_id, CASE WHEN regexp_extract(n, '(\d{12})', 1) <> '' THEN regexp_extract(n, '(\d{12})', 1)::BIGINT ELSE regexp_extract(regexp_replace(n, '\.[^./]*$', ''), '(\d+)', 1)::BIGINT END AS image_id
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN printf('COCO_val2014_%012d.jpg', page_id) ELSE 'img' || page_id || '_v2.jpg' END AS n FROM pages)""")
def parse_image_id(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("page_id") % 2 == 0, F.format_string("COCO_val2014_%012d.jpg", "page_id")).otherwise(F.concat(F.lit("img"), "page_id", F.lit("_v2.jpg")))
    return _table(spark, d, "pages").select("page_id", X.image_id(name).alias("image_id"))


@query(r"""
SELECT conv_id, turn, w AS object_word FROM (
  SELECT conv_id, turn, lower(trim(regexp_extract(q, '(?i)Is there (?:a|an)\s+(.+?)\s+in the image', 1))) AS w
  FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN 'Is there a ' ELSE 'Do you see ' END || split_part(text, ' ', 1) || ' in the image?' AS q FROM conversations)) WHERE w <> ''""")
def object_word_extract(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.when(F.col("turn") % 2 == 0, "Is there a ").otherwise("Do you see "), F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" in the image?"))
    return _table(spark, d, "conversations").select("conv_id", "turn", X.object_word(q).alias("object_word")).where("object_word is not null")


@query(f"""
WITH b(band, lo, hi) AS (VALUES ('1-10', 0, 10), ('10-15', 10, 15), ('15-20', 15, 20), ('20-25', 20, 25), ('25-33', 25, 33)),
e AS (SELECT band, (label < 5)::INT AS label, list_avg(a[lo + 1:hi]) AS m FROM ({_E}), b)
SELECT band, label, count(*) AS n, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM e GROUP BY band, label""")
def layerwise_bands(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.layer_bands(_curves(spark, d), "a"), "mean", "std")


@query(f"""
WITH b(band, lo, hi) AS (VALUES ('1-10', 0, 10), ('10-15', 10, 15), ('15-20', 15, 20), ('20-25', 20, 25), ('25-33', 25, 33)),
e AS (SELECT band, (label < 5)::INT AS y, list_avg(a[lo + 1:hi]) AS s FROM ({_E}), b),
g AS (SELECT band, s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM e GROUP BY band, s),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY band ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
t AS (SELECT band, sum(pos * (before + neg / 2.0)) AS u, sum(pos)::DOUBLE AS n1, sum(neg)::DOUBLE AS n0, sum((pos + neg)::DOUBLE ** 3 - (pos + neg)) AS ties FROM c GROUP BY band)
SELECT band, round(u, 6) AS u, round({_Z}, 6) AS z, round({_erfc(_Z)}, 6) AS p FROM t""")
def band_tests(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.band_tests(_curves(spark, d), "a"), "u", "z", "p")


#: A vocabulary for caption-like texts: a word, or two, to its object. No pair ends with a word that begins another one.
VOCABULARY = {
    "that": "that", "with": "with", "from": "from", "this": "this", "was": "be", "are": "be", "were": "be", "trash": "trash", "clown": "clown", "idiot": "person", "moron": "person",
    "of the": "of-the", "in the": "in-the", "de la": "de-la", "is": "be", "and": "and",
}
_VOC = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in VOCABULARY.items()) + "}"
_WORD = "[A-Za-z]+(?:''[A-Za-z]+)?"
_TOKEN = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]"


def _mentions_sql(table: str, key: str) -> str:
    """Rows (key, k, object, start, end, text): positions are sums over words and the gaps before them."""
    return f"""
  SELECT {key}, text, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS k, object, start, CASE WHEN pair THEN next_end ELSE start + len(w) END AS "end" FROM (
    SELECT *, CASE WHEN coalesce(lag(pair) OVER p, false) THEN NULL WHEN pair THEN two ELSE one END AS object FROM (
      SELECT *, two IS NOT NULL AS pair FROM (
        SELECT *, {_VOC}[lower(w) || ' ' || lower(lead(w) OVER p)] AS two, {_VOC}[lower(w)] AS one, lead(start + len(w)) OVER p AS next_end FROM (
          SELECT {key}, text, w, i, (sum(len(g)) OVER q + coalesce(sum(len(w)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start FROM (
            SELECT {key}, text, unnest(ws) AS w, unnest(gs[:len(ws)]) AS g, generate_subscripts(ws, 1) AS i FROM (
              SELECT {key}, text, regexp_extract_all(text, '{_WORD}') AS ws, regexp_split_to_array(text, '{_WORD}') AS gs FROM {table}))
          WINDOW q AS (PARTITION BY {key} ORDER BY i)) WINDOW p AS (PARTITION BY {key} ORDER BY i)))
    WINDOW p AS (PARTITION BY {key} ORDER BY i)) WHERE object IS NOT NULL"""


_TRUE = f"SELECT DISTINCT object FROM ({_mentions_sql('benchmark', 'item_id')})"


def _captioned(spark: SparkSession, d: str) -> DataFrame:
    """Documents as captions; the objects that are there are those of the benchmark's items."""
    truth = C.mentions(_table(spark, d, "benchmark"), VOCABULARY, "item_id").agg(F.array_sort(F.collect_set("object")).alias("truth"))
    return _table(spark, d, "documents").select("doc_id", "text").crossJoin(F.broadcast(truth))  # one row, no more objects than the vocabulary


@query(f'SELECT doc_id, k::INT AS mention_index, object, substr(text, start + 1, "end" - start) AS surface, start, "end" FROM ({_mentions_sql("documents", "doc_id")})')
def mentions(spark: SparkSession, d: str) -> DataFrame:
    return C.mentions(_table(spark, d, "documents"), VOCABULARY)


_SPANS = f"""
  SELECT doc_id, k::INT AS mention_index, object AS word, substr(text, start + 1, "end" - start) AS surface, start, "end", len(regexp_extract_all(substr(text, 1, start), '{_TOKEN}'))::INT AS "first",
         len(regexp_extract_all(substr(text, start + 1, "end" - start), '{_TOKEN}'))::INT AS n_tokens, (object NOT IN ({_TRUE}))::INT AS label FROM ({_mentions_sql('documents', 'doc_id')})"""


@query(f"WITH t AS ({_TRUE}), m AS ({_SPANS.replace(_TRUE, 'FROM t')}) SELECT * FROM m JOIN (SELECT doc_id, len(regexp_extract_all(text, '{_TOKEN}')) AS n FROM documents) USING (doc_id) WHERE \"first\" + n_tokens <= n".replace("SELECT * FROM m", "SELECT m.* FROM m"))
def caption_spans(spark: SparkSession, d: str) -> DataFrame:
    return C.caption_spans(_captioned(spark, d), VOCABULARY, "truth")


_LABELLED = f"""
WITH t AS ({_TRUE}), s AS ({_SPANS.replace(_TRUE, 'FROM t')}),
m AS (SELECT doc_id, count(*) AS m, count(*) FILTER (label = 1) AS h, string_agg(word, ' ' ORDER BY "first", mention_index) FILTER (label = 1) AS bad FROM s GROUP BY doc_id)"""


@query(_LABELLED + """
SELECT doc_id, coalesce(m, 0) AS n_spans, coalesce(bad, '') AS hallucinated_words, round(coalesce(h / m, 0), 6) AS chair_i, (coalesce(h, 0) > 0)::INT AS chair_s FROM documents LEFT JOIN m USING (doc_id)""")
def label_captions(spark: SparkSession, d: str) -> DataFrame:
    out = D.label_captions(_captioned(spark, d), VOCABULARY, "truth", "doc_id")[0]
    return out.select("doc_id", F.size("object_token_spans").cast("long").alias("n_spans"), F.array_join("hallucinated_words", " ").alias("hallucinated_words"), _r(F.col("chair_i")).alias("chair_i"), "chair_s")


@query(_LABELLED + """,
a AS (SELECT count(*) AS images, coalesce(sum(m), 0)::BIGINT AS object_mentions, coalesce(sum(h), 0)::BIGINT AS hallucinated_mentions, count(*) FILTER (h > 0) AS images_with_hallucination
      FROM documents LEFT JOIN m USING (doc_id))
SELECT *, round(coalesce(images_with_hallucination / nullif(images, 0), 0), 6) AS chair_s, round(coalesce(hallucinated_mentions / nullif(object_mentions, 0), 0), 6) AS chair_i FROM a""")
def chair_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(D.label_captions(_captioned(spark, d), VOCABULARY, "truth", "doc_id")[1], "chair_s", "chair_i")


@query(rf"""
WITH w(word, label) AS (VALUES ('that', 1), ('with', 0), ('of', 0), ('trash', 1), ('de la', 0)),
d AS (SELECT doc_id, text, word, label, '(?is)^(|.*?[^\p{{L}}\p{{N}}\p{{M}}_])' || word || '(?:[^\p{{L}}\p{{N}}\p{{M}}_]|$)' AS p FROM documents, w),
s AS (SELECT doc_id, word, label, regexp_extract(text, p, 1) AS before FROM d WHERE regexp_matches(text, p))
SELECT doc_id, word, label, len(before)::INT AS start, len(regexp_extract_all(before, '{_TOKEN}'))::INT AS "first", CASE word WHEN 'de la' THEN 2 ELSE 1 END AS n_tokens FROM s""")
def token_spans(spark: SparkSession, d: str) -> DataFrame:
    words = X.candidate_words(F.array(F.lit("that"), F.lit("trash")), F.array(F.lit("with"), F.lit("of"), F.lit("that"), F.lit("de la")))
    rows = _table(spark, d, "documents").select("doc_id", "text", X.n_tokens(F.col("text")).alias("n_ids"), F.inline(words))
    return X.token_spans(rows, "doc_id")


@query(rf"""
WITH w(word) AS (VALUES ('that'), ('of'), ('ras'), ('de la')),
d AS (SELECT doc_id, text, word, '(?is)^(|.*?[^\p{{L}}\p{{N}}\p{{M}}_])' || word || '(?:[^\p{{L}}\p{{N}}\p{{M}}_]|$)' AS p, strpos(lower(text), word) AS hit FROM documents, w)
SELECT doc_id, word, CASE WHEN regexp_matches(text, p) THEN len(regexp_extract_all(regexp_extract(text, p, 1), '{_TOKEN}'))
                          WHEN hit > 0 THEN len(regexp_extract_all(substr(text, 1, hit - 1), '{_TOKEN}')) END::INT AS position FROM d""")
def object_positions(spark: SparkSession, d: str) -> DataFrame:
    """Tokens before each of four words: as a whole word, else as a part of one; null where a text has neither."""
    words = F.array(*[F.lit(w) for w in ("that", "of", "ras", "de la")])
    rows = _table(spark, d, "documents").select("doc_id", "text", F.explode(words).alias("word"))
    return rows.select("doc_id", "word", X.object_position(F.col("text"), F.col("word")).alias("position"))


@query("""
WITH w AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, text, w, unnest([{'a': doc_id % 5, 'b': doc_id % 5 + 1}, {'a': 3, 'b': 3}, {'a': len(w) - 1, 'b': len(w)}, {'a': 2, 'b': 1}, {'a': -1, 'b': 0}], recursive := true) FROM w),
o AS (SELECT *, coalesce(list_sum(list_transform(w[1:a], lambda x: length(x) + 1)), 0) AS s, coalesce(list_sum(list_transform(w[1:b], lambda x: length(x) + 1)), 0) + length(w[b + 1]) AS e
      FROM s WHERE a >= 0 AND a <= b AND b < len(w))
SELECT doc_id, s::INT AS start, e::INT AS "end", substr(text, (s + 1)::BIGINT, (e - s)::BIGINT) AS surface FROM o""")
def adapter_spans(spark: SparkSession, d: str) -> DataFrame:
    """Word offsets as spans of characters; those that leave the text or run backwards are dropped."""
    last = F.size(F.split("text", " "))
    at = (F.col("doc_id") % 5).cast("int")
    offsets = [(at, at + 1), (F.lit(3), F.lit(3)), (last - 1, last), (F.lit(2), F.lit(1)), (F.lit(-1), F.lit(0))]
    spans = F.array(*[F.struct(a.alias("first"), b.alias("last")) for a, b in offsets])
    return _table(spark, d, "documents").select("doc_id", F.inline(X.adapter_mentions(F.col("text"), spans)))


@query("""
SELECT o_orderkey AS image_id, count(l_orderkey) AS n_annotations, coalesce(array_to_string(list_sort(list_distinct(list(p_type) FILTER (p_type IS NOT NULL AND p_type <> ''))), '|'), '') AS coco_objects
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey""")
def group_collect_objects(spark: SparkSession, d: str) -> DataFrame:
    images = _table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    anns = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").cast("long").alias("id"), F.col("l_partkey").alias("category_id"))
    cats = _table(spark, d, "part").select(F.col("p_partkey").alias("category_id"), F.col("p_type").alias("category_name"))
    return R.nest_annotations(images, anns, cats).select("image_id", F.size("annotations").cast("long").alias("n_annotations"), F.array_join("coco_objects", "|").alias("coco_objects"))


@query("SELECT conv_id, count(*) AS n_captions, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS captions FROM conversations GROUP BY conv_id")
def group_collect_captions(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "conversations").select(F.col("conv_id").alias("image_id"), F.col("turn").alias("ord"), F.col("text").alias("caption"))
    out = R.nest_captions(rows.select("image_id").distinct(), rows)
    return out.select(F.col("image_id").alias("conv_id"), F.size("captions").cast("long").alias("n_captions"), F.md5(F.array_join("captions", "\n")).alias("captions"))


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE lower(event_type) END AS labels, (event_id % 11 <> 0)::INT AS n FROM events")
def label_reply_parse(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    body = F.concat(F.lit('["'), "event_type", F.lit('"]'))
    reply = F.when(F.col("event_id") % 11 == 0, "oops").when(F.col("event_id") % 7 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return e.select("event_id", X.reply_labels(reply).alias("l")).select("event_id", F.array_join("l", ",").alias("labels"), F.size("l").alias("n"))


@query("""
SELECT doc_id, md5('Objects: ["' || lang || '","' || source || '"]' || chr(10) || 'Captions:' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda c: '- ' || trim(c)), chr(10))) AS prompt FROM documents""")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", F.md5(X.render_prompt(F.array("lang", "source"), F.split("text", "\n"))).alias("prompt"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return R.pending(_table(spark, d, "documents").select("doc_id"), _table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def labeled_semijoin(spark: SparkSession, d: str) -> DataFrame:
    return R.only_labelled(_table(spark, d, "documents").select("doc_id"), _table(spark, d, "labels"), "doc_id")


@query("SELECT l.doc_id, CASE WHEN l.doc_id % 3 = 0 THEN 2 ELSE 1 END AS n_ids, CASE WHEN l.doc_id % 3 = 0 THEN n_chars ELSE l.doc_id END AS first_id FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def generation_override(spark: SparkSession, d: str) -> DataFrame:
    labels = _table(spark, d, "labels").select("doc_id", F.array("doc_id").alias("response_token_ids"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.array("n_chars", "doc_id")).otherwise(F.array().cast("array<long>"))
    out = R.with_generations(labels, _table(spark, d, "documents").select("doc_id", raw.alias("response_token_ids")), "doc_id")
    return out.select("doc_id", F.size("response_token_ids").alias("n_ids"), F.get("response_token_ids", F.lit(0)).alias("first_id"))


@query(f"SELECT vec_id AS image_id, 0 AS span_idx, label, label * 7 AS \"first\", trunc(a[label * 7 + 1] * 1000)::INT AS target_token_id, label * 7 AS prefix_length FROM ({_E}) WHERE label * 7 < 40")
def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    one = lambda label, at: F.struct(at.alias("token_indices"), label.alias("label"))
    spans = F.array(one(F.col("label"), F.array(F.col("label") * 7)), one(F.lit(0), F.array().cast("array<int>")))
    ids = F.slice(F.transform("a", lambda x: F.floor(x * 1000).cast("int")), 1, 40)
    rows = _vectors(spark, d).withColumn("a", F.transform("v", F.abs)).select(F.col("vec_id").alias("image_id"), ids.alias("response_token_ids"), spans.alias("spans"))
    return R.target_tokens(rows).select("image_id", "span_idx", "label", "first", "target_token_id", F.size("prefix").alias("prefix_length"))


@query(f"WITH e AS ({_E}) SELECT a.vec_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(other, "vec_id").select("vec_id", _r(A.cosine(F.col("v"), F.col("w"))).alias("cosine"))


@query(f"""
WITH x AS (SELECT vec_id, list_transform(v, lambda x: exp(x / 0.07 - list_max(v) / 0.07)) AS e FROM ({_E})), p AS (SELECT vec_id, list_transform(e, lambda y: y / list_sum(e)) AS p FROM x)
SELECT vec_id, round(list_max(p), 6) AS top, round(list_sum(list_transform(p, lambda y: y * y)), 6) AS squares FROM p""")
def source_softmax(spark: SparkSession, d: str) -> DataFrame:
    p = _vectors(spark, d).select("vec_id", A.temperature_softmax(F.col("v")).alias("p"))
    return p.select("vec_id", _r(F.array_max("p")).alias("top"), _r(A.dot(F.col("p"), F.col("p"))).alias("squares"))


@query(f"""
WITH x AS (SELECT vec_id, list_transform(v, lambda x: greatest(x, 0)) AS c FROM ({_E})), q AS (SELECT vec_id, list_transform(c, lambda y: y / list_sum(c)) AS p FROM x)
SELECT vec_id, round(list_sum(p), 6) AS mass, round(list_max(p), 6) AS top, round(list_sum(list_transform(p, lambda y: y * y)), 6) AS squares FROM q""")
def renormalize(spark: SparkSession, d: str) -> DataFrame:
    p = _vectors(spark, d).select("vec_id", A.renormalize(F.col("v")).alias("p"))
    return p.select("vec_id", _r(A.total(F.col("p"))).alias("mass"), _r(F.array_max("p")).alias("top"), _r(A.dot(F.col("p"), F.col("p"))).alias("squares"))


@query(f"""
WITH u AS (SELECT vec_id, unnest(v) AS x, unnest(a) AS y, unnest(range(64)) AS i FROM ({_E})),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY y DESC, i) AS ry, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rx FROM u)
SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS support FROM r WHERE rx <= 8 OR ry <= 8 GROUP BY vec_id""")
def topk_union(spark: SparkSession, d: str) -> DataFrame:
    support = A.topk_union(F.col("a"), F.col("v"), 16)
    return _curves(spark, d).select("vec_id", F.array_join(support.cast("array<string>"), ",").alias("support"))


@query(f"""
WITH m AS (SELECT vec_id, a, list_avg(a[1:10]) + 2 * list_aggregate(a[1:10], 'stddev_pop') AS thr FROM ({_E}))
SELECT vec_id, round(list_sum(list_transform(a[15:], lambda x: greatest(0, x - thr))), 6) AS score FROM m""")
def baseline_excess(spark: SparkSession, d: str) -> DataFrame:
    return _curves(spark, d).select("vec_id", _r(A.baseline_excess(F.col("a"))).alias("score"))


@query(f"SELECT vec_id, 32 AS n, round(list_sum(v[5:12]) + list_sum(v[21:28]) + list_sum(v[37:44]) + list_sum(v[53:60]), 6) AS total FROM ({_E})")
def layer_slice(spark: SparkSession, d: str) -> DataFrame:
    s = A.layer_slice(F.col("v"), 16, 0.25, 0.75)
    return _vectors(spark, d).select("vec_id", F.size(s).alias("n"), _r(A.total(s)).alias("total"))


@query(f"""
WITH m AS (SELECT vec_id // 8 AS sample, vec_id % 8 AS layer, list_sum(a) AS mass FROM ({_E})), s AS (SELECT sample FROM m GROUP BY sample HAVING count(*) = 8)
SELECT sample, round(sum(mass), 6) AS alpha, round(coalesce(sum(mass) FILTER (layer >= 1 AND layer < 4), 0), 6) AS svar, round(sum(mass) FILTER (layer = 4) / 64, 6) AS head_mid FROM m JOIN s USING (sample) GROUP BY sample""")
def attention_mass(spark: SparkSession, d: str) -> DataFrame:
    m = _curves(spark, d).select(F.floor(F.col("vec_id") / 8).cast("long").alias("sample"), (F.col("vec_id") % 8).alias("layer"), A.total(F.col("a")).alias("mass"))
    s = m.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("layer", "mass"))).alias("s")).where(F.size("s") == 8)
    c = F.transform("s", lambda x: x["mass"])
    return s.select("sample", _r(A.total(c)).alias("alpha"), _r(A.svar_score(c)).alias("svar"), _r(F.get(c, F.lit(4)) / 64).alias("head_mid"))


@query(f"""
WITH x AS (SELECT vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM ({_E})), p AS (SELECT vec_id, v, list_transform(e, lambda y: y / list_sum(e)) AS p FROM x)
SELECT vec_id, (list_position(v, list_max(v)) - 1)::INT AS predicted, round(ln(list_max(p)), 6) AS log_prob, round(-list_sum(list_transform(p, lambda y: y * ln(y))) / ln(64), 6) AS entropy, round(-ln(list_max(p)), 6) AS nll FROM p""")
def token_entropy(spark: SparkSession, d: str) -> DataFrame:
    out = _vectors(spark, d).select("vec_id", A.token_stats(F.col("v")).alias("s")).select("vec_id", "s.*")
    return _rounded(out, "log_prob", "entropy", "nll")


_SLICES = f"SELECT vec_id, v[1:8] AS t, list_transform(range(1, 8), lambda i: v[i * 8 + 1:i * 8 + 8]) AS p, a[9:15] AS w FROM ({_E})"
_COS = "list_transform(p, lambda q: list_dot_product(t, q) / (sqrt(list_dot_product(t, t)) * sqrt(list_dot_product(q, q))))"


@query(f"""
WITH c AS (SELECT vec_id, w, {_COS} AS c FROM ({_SLICES}))
SELECT vec_id, round(list_avg(list_reverse_sort(c)[1:3]), 6) AS top3, round(list_max(c), 6) AS top_share, round(list_dot_product(c, w) / list_sum(w), 6) AS weighted FROM c""")
def cgc_layers(spark: SparkSession, d: str) -> DataFrame:
    patches = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, F.lit(8)))
    x = _curves(spark, d).select("vec_id", F.slice("v", 1, 8).alias("t"), patches.alias("p"), F.slice("a", 9, 7).alias("w"))
    t, p = F.col("t"), F.col("p")
    return x.select("vec_id", _r(A.cgc_layer(t, p, 3)).alias("top3"), _r(A.cgc_layer(t, p, pct=0.05)).alias("top_share"), _r(A.cgc_layer(t, p, weights=F.col("w"))).alias("weighted"))


@query("SELECT p_partkey, list_max(list_filter(range(1, floor(sqrt(p_size))::INT + 1), lambda x: p_size % x = 0))::INT AS h, (p_size / list_max(list_filter(range(1, floor(sqrt(p_size))::INT + 1), lambda x: p_size % x = 0)))::INT AS w FROM part")
def find_hw(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", A.find_hw(F.col("p_size")).alias("s")).select("p_partkey", "s.*")


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, 5 + l_linenumber AS n, l_linenumber AS hole, l_linenumber AS s, l_linenumber + 4 AS e, l_partkey % 4 AS idx FROM lineitem),
p AS (SELECT *, list_transform(list_filter(range(n), lambda i: i <> hole), lambda i: CASE WHEN i > hole THEN i + 3 ELSE i END) AS prompt FROM x)
SELECT l_orderkey, l_linenumber, array_to_string(prompt, ',') AS prompt, array_to_string(list_sort(list_distinct(list_concat(range(s, e), prompt))), ',') AS support,
       (CASE WHEN idx <= 0 THEN list_max(prompt) ELSE n + idx - 1 + 3 END)::INT AS prediction FROM p""")
def prompt_positions(spark: SparkSession, d: str) -> DataFrame:
    at, n = F.col("l_linenumber").cast("int"), (F.col("l_linenumber") + 5).cast("int")
    ids = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == at, -200).otherwise(i + 1))
    x = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n"), at.alias("at"), (F.col("l_partkey") % 4).cast("int").alias("idx"), ids.alias("ids"))
    x = x.withColumn("prompt", P.prompt_positions(F.col("ids"), F.col("n"), -200, F.col("at"), F.col("at") + 4))
    join = lambda c: F.array_join(c.cast("array<string>"), ",")
    support = P.support_positions("visual_prompt", F.col("at"), F.col("at") + 4, F.col("prompt"))
    return x.select("l_orderkey", "l_linenumber", join(F.col("prompt")).alias("prompt"), join(support).alias("support"), P.prediction_position(F.col("idx"), F.col("n"), F.col("prompt"), F.col("at"), 4).alias("prediction"))


_LENGTHS = "SELECT doc_id, list_transform(string_split(coalesce(text, ''), ' '), lambda x: length(x)) AS ids FROM documents"


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    """Word lengths stand for the ids of a tokenizer."""
    return _table(spark, d, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), " "), F.length).alias("ids"))


@query(f"""
WITH p AS (SELECT doc_id, list_position(ids, 9) AS a, list_position(ids, 11) AS b FROM ({_LENGTHS}))
SELECT doc_id, CASE WHEN a > 0 AND b > 0 THEN a ELSE 5 END::INT AS start, CASE WHEN a > 0 AND b > 0 THEN b - 1 ELSE 261 END::INT AS "end" FROM p""")
def vision_ranges(spark: SparkSession, d: str) -> DataFrame:
    """From behind the first of one marker to the first of another; a fixed range where one is missing."""
    return _lengths(spark, d).select("doc_id", P.vision_range(F.col("ids"), 9, 11, (5, 261)).alias("r")).select("doc_id", "r.*")


@query(f"""
SELECT doc_id, md5(array_to_string(list_concat(ids[:4], [-200, -200, -200, -200, -200], ids[5:]), ',')) AS ids, least(len(ids), 4)::INT AS start, (least(len(ids), 4) + 5)::INT AS "end" FROM ({_LENGTHS})""")
def image_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Five image ids between the first four ids and the rest, and where they stand."""
    ids = F.col("ids")
    x = _lengths(spark, d).select("doc_id", P.image_input(F.slice(ids, 1, 4), -200, F.lit(5), F.slice(ids, F.lit(5), F.size(ids))).alias("r"))
    return x.select("doc_id", F.md5(F.array_join(F.col("r.ids").cast("array<string>"), ",")).alias("ids"), "r.start", "r.end")


@query(f"""
WITH RECURSIVE n AS (SELECT vec_id, list_transform(a, lambda x: x - list_min(a)) AS b FROM ({_E})),
u AS (SELECT vec_id, unnest(b) / list_sum(b) AS p, unnest(range(64)) AS i FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) <= 6 AS fore FROM u),
f AS (SELECT vec_id, i, i // 8 AS y, i % 8 AS x, p FROM r WHERE fore),
reach AS (SELECT vec_id, i AS a, i AS b FROM f UNION SELECT reach.vec_id, reach.a, g.i FROM reach JOIN f h ON h.vec_id = reach.vec_id AND h.i = reach.b JOIN f g ON g.vec_id = h.vec_id AND abs(g.x - h.x) <= 1 AND abs(g.y - h.y) <= 1),
area AS (SELECT vec_id, a, count(*) AS n FROM reach GROUP BY vec_id, a),
mass AS (SELECT f.vec_id, coalesce(sum(p) FILTER (n >= 3), 0) AS m FROM f JOIN area ON area.vec_id = f.vec_id AND area.a = f.i GROUP BY f.vec_id),
back AS (SELECT vec_id, p, sum(p) OVER (PARTITION BY vec_id) AS t FROM r WHERE NOT fore),
ent AS (SELECT vec_id, -sum(greatest(p / t, 1e-12) * ln(greatest(p / t, 1e-12))) / ln(64) AS h FROM back GROUP BY vec_id)
SELECT vec_id, round((1 - m) * h, 6) AS ads FROM mass JOIN ent USING (vec_id)""")
def ads_layers(spark: SparkSession, d: str) -> DataFrame:
    return _curves(spark, d).select("vec_id", _r(K.ads_layer(F.col("a"))).alias("ads"))


@query(f"""
WITH x AS (SELECT vec_id, a[1] / (a[1] + a[2]) AS s, a[3] / (a[3] + a[4]) AS t, greatest(0, 1 - list_dot_product(v[9:16], v[17:24]) / sqrt(list_dot_product(v[9:16], v[9:16]) * list_dot_product(v[17:24], v[17:24]))) AS dist, 1 - a[5] AS p1, 1 - a[6] AS p2 FROM ({_E}))
SELECT vec_id, round(abs(s - t) * dist * (1 + p1 + p2), 6) AS risk FROM x""")
def transport_n2(spark: SparkSession, d: str) -> DataFrame:
    two = lambda i: F.slice("a", i, 2)
    rows = _curves(spark, d).select("vec_id", F.array(F.slice("v", 9, 8), F.slice("v", 17, 8)).alias("support"), A.renormalize(two(1)).alias("source_dist"), A.renormalize(two(3)).alias("target_dist"), two(5).alias("semantic"))
    return K.transport_risk(rows, mode="decomposed").select("vec_id", _r(F.col("risk")).alias("risk"))


@query(f"""
WITH x AS (SELECT vec_id, list_transform(a[1:6], lambda x: x / list_sum(a[1:6])) AS s, list_transform(a[7:12], lambda x: x / list_sum(a[7:12])) AS t FROM ({_E}))
SELECT vec_id, round(list_sum(list_transform(range(1, 7), lambda i: abs(s[i] - t[i]))) / 2, 6) AS risk FROM x""")
def transport_tv(spark: SparkSession, d: str) -> DataFrame:
    """Between one-hot states without penalties the exact transport is the total variation."""
    one_hot = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(6)]) for i in range(6)])
    part = lambda i: A.renormalize(F.slice("a", i, 6))
    rows = _curves(spark, d).select("vec_id", one_hot.alias("support"), part(1).alias("source_dist"), part(7).alias("target_dist"), F.array_repeat(F.lit(1.0), 6).alias("semantic"))
    return K.transport_risk(rows, mode="decomposed").select("vec_id", _r(F.col("risk")).alias("risk"))


@query(f"""
WITH x AS (SELECT vec_id, list_transform(a[1:32], lambda x: x / list_sum(a[1:32])) AS w, a[33:64] AS m FROM ({_E})),
y AS (SELECT vec_id, list_transform(range(1, 33), lambda i: w[i] * m[i]) AS w FROM x), z AS (SELECT vec_id, list_transform(w, lambda x: x / list_sum(w)) AS w FROM y)
SELECT vec_id, round(list_max(w), 6) AS top, round(list_sum(list_transform(w, lambda x: x * x)), 6) AS squares FROM z""")
def target_dist(spark: SparkSession, d: str) -> DataFrame:
    """Attention, renormalised, times semantic probability, renormalised."""
    weighed = F.zip_with(A.renormalize(F.slice("a", 1, 32)), F.slice("a", 33, 32), lambda w, m: w * m)
    p = _curves(spark, d).select("vec_id", A.renormalize(weighed).alias("p"))
    return p.select("vec_id", _r(F.array_max("p")).alias("top"), _r(A.dot(F.col("p"), F.col("p"))).alias("squares"))


def _captures(spark: SparkSession, d: str) -> DataFrame:
    """One row a layer from a vector's parts, with two supports, for which the exact transport has a closed form."""
    part = lambda i: F.slice("v", i * 8 + 1, F.lit(8))
    one = lambda i: part(F.lit(i))
    return _vectors(spark, d).withColumn("a", F.transform("v", F.abs)).select(
        F.floor(F.col("vec_id") / 8).cast("long").alias("sample"), (F.col("vec_id") % 8).cast("int").alias("layer"), one(0).alias("update"), one(1).alias("state"),
        F.array(one(2), one(3)).alias("support"), F.sequence(F.lit(0), F.lit(1)).alias("positions"), F.slice("a", 1, 2).alias("attention"), F.slice("a", 3, 2).alias("semantic"),
        one(4).alias("prompt_last"), one(5).alias("prompt_mean"), F.slice("a", 5, 6).alias("prompt_probabilities"), one(6).alias("target_embedding"),
        (F.col("label") % 3).cast("int").alias("visual_start"), F.lit(2).alias("visual_end"),
    )


def _cos(x: str, y: str) -> str:
    return f"list_dot_product({x}, {y}) / (sqrt(list_dot_product({x}, {x})) * sqrt(list_dot_product({y}, {y})))"


_TRANSPORT = f"""
WITH p AS (SELECT vec_id // 8 AS sample, (vec_id % 8)::INT AS layer, label, a, v[1:8] AS upd, v[9:16] AS st, v[17:24] AS s1, v[25:32] AS s2, v[33:40] AS pl, v[41:48] AS pm, v[49:56] AS te FROM ({_E})),
q AS (SELECT *, 1 / (1 + exp(({_cos("upd", "s2")} - {_cos("upd", "s1")}) / 0.07)) AS a1, (a[1] * a[3]) / (a[1] * a[3] + a[2] * a[4]) AS b1, 1 - a[3] AS p1, 1 - a[4] AS p2,
             greatest(0, 1 - {_cos("s1", "s2")}) AS dist, list_sum(list_reverse_sort(a[5:10])[1:3]) / 3 AS conf FROM p),
layers AS (SELECT sample, layer, abs(a1 - b1) * dist * (1 + p1 + p2) + a1 * p1 + (1 - a1) * p2 + b1 * p1 + (1 - b1) * p2 AS risk, {_cos("st", "pl")} AS prompt_last_cosine, {_cos("st", "pm")} AS prompt_mean_cosine,
                  CASE label % 3 WHEN 0 THEN ({_cos("te", "s1")} + {_cos("te", "s2")}) / 2 WHEN 1 THEN {_cos("te", "s2")} ELSE 0 END AS visual_cosine, conf FROM q)"""


@query(f"""{_TRANSPORT}
SELECT sample, layer, round(risk, 6) + 0 AS risk, round(prompt_last_cosine, 6) + 0 AS prompt_last_cosine, round(prompt_mean_cosine, 6) + 0 AS prompt_mean_cosine, round(visual_cosine, 6) + 0 AS visual_cosine,
       round(conf, 6) + 0 AS prompt_confidence, round(conf * visual_cosine, 6) + 0 AS context_confidence, 2 AS support_size, 2 AS selected_support_size FROM layers""")
def transport_layers(spark: SparkSession, d: str) -> DataFrame:
    names = ("risk", "prompt_last_cosine", "prompt_mean_cosine", "visual_cosine", "prompt_confidence", "context_confidence")
    return _rounded(K.layer_stats(_captures(spark, d)).select("sample", "layer", *names, "support_size", "selected_support_size"), *names)


@query(f"""{_TRANSPORT},
s AS (SELECT sample, list(risk ORDER BY layer) AS r, list(prompt_last_cosine ORDER BY layer) AS l, list(prompt_mean_cosine ORDER BY layer) AS m, list(conf * visual_cosine ORDER BY layer) AS c FROM layers GROUP BY sample),
t AS (SELECT *, list_avg(r[1:3]) + 2 * list_aggregate(r[1:3], 'stddev_pop') AS cut FROM s)
SELECT sample, round(coalesce(list_sum(list_transform(r[4:], lambda x: greatest(0, x - cut))), 0), 6) + 0 AS score, 4 * len(r) AS width,
       array_to_string(list_transform(list_concat(list_concat(r, l), list_concat(m, c)), lambda x: round(x * 10000)::BIGINT), ',') AS feature_vector FROM t""")
def transport_spans(spark: SparkSession, d: str) -> DataFrame:
    s = K.span_features(K.layer_stats(_captures(spark, d)), "sample", baseline_layers=3, start_layer=4)
    vector = F.array_join(F.transform("feature_vector", lambda x: F.round(x * 10000).cast("long").cast("string")), ",")
    return s.select("sample", _r(F.col("score")).alias("score"), F.size("feature_vector").alias("width"), vector.alias("feature_vector"))


@query()
def transport_wide(spark: SparkSession, d: str) -> DataFrame:
    """Six supports a layer, other weights, and a selection of four: held against brute force in the tests."""
    part = lambda i: F.slice("v", i * 8 + 1, F.lit(8))
    rows = _curves(spark, d).select("vec_id", F.transform(F.sequence(F.lit(1), F.lit(6)), part).alias("support"), A.renormalize(F.slice("a", 1, 6)).alias("source_dist"), A.renormalize(F.slice("a", 11, 6)).alias("target_dist"), F.slice("a", 21, 6).alias("semantic"))
    return K.transport_risk(rows, 4, lambdas=(1.0, 0.5, 0.25, 2.0)).select("vec_id", _r(F.col("risk")).alias("risk"), "selected_support_size")


def _hidden(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Two layers over eight positions a sample: layer outputs, attention of two heads, plan, targets, probabilities."""
    e = _vectors(spark, d).select("vec_id", "v", F.transform("v", F.abs).alias("a"), F.floor(F.col("vec_id") / 8).cast("long").alias("sample"), (F.col("vec_id") % 8).cast("int").alias("position"))
    layers = e.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("layer"))
    cut = lambda k: F.slice("v", F.col("layer") * 24 + 8 * k + 1, F.lit(8))
    hidden = layers.select("sample", "layer", "position", cut(0).alias("h_prev"), cut(1).alias("o_attn"), cut(2).alias("o_ffn"))
    heads = layers.select("sample", "layer", F.col("position").alias("query"), "a", F.explode(F.array(F.lit(0), F.lit(1))).alias("head"))
    attention = heads.select("sample", "layer", "head", "query", F.slice("a", F.col("head") * 8 + F.col("layer") * 16 + 1, F.lit(8)).alias("weights"))
    samples = e.select("sample").distinct()
    plan = samples.select("sample", F.array(*map(F.lit, (0, 1, 2, 4))).alias("support_positions"), F.array(*map(F.lit, (0, 3, 4))).alias("prompt_positions"), F.lit(1).alias("visual_start"), F.lit(3).alias("visual_end"))
    tables = e.select(F.col("vec_id").alias("token_id"), F.slice("v", 57, 8).alias("embedding"))
    targets = samples.select("sample", F.lit(0).alias("span_idx"), (F.col("sample") * 8).alias("target_token_id"), (F.col("sample") % 2 + 5).cast("int").alias("prediction_position"))
    targets = Z.embedding_for_token(targets, tables.where("token_id % 16 = 0"), tables, 8)
    probabilities = layers.select("sample", F.lit(0).alias("span_idx"), "layer", "position", F.get("a", F.col("layer") + 50).alias("probability"))
    return hidden, attention, plan, targets, probabilities


_HIDDEN = f"""
e AS (SELECT vec_id // 8 AS sample, vec_id % 8 AS position, v, a FROM ({_E})), l AS (SELECT * FROM e, range(2) t(layer)),
h AS (SELECT sample, layer, position, a, list_transform(range(1, 9), lambda i: v[layer * 24 + i] + v[layer * 24 + 8 + i]) AS mid, v[layer * 24 + 17:layer * 24 + 24] AS ffn FROM l),
s AS (SELECT *, list_transform(range(1, 9), lambda i: mid[i] + ffn[i]) AS out FROM h),
g AS (SELECT sample, layer, sum(list_sum(mid)) FILTER (position IN (0, 1, 2, 4)) AS support, count(*) FILTER (position IN (0, 1, 2, 4)) AS n, sum(list_sum(out)) FILTER (position = 4) AS last, sum(list_sum(out)) FILTER (position IN (0, 3, 4)) / 3 AS mean,
             sum(a[layer + 51]) FILTER (position IN (0, 1, 2, 4)) AS semantic, sum(a[layer + 51]) FILTER (position IN (0, 3, 4)) AS confident FROM s GROUP BY sample, layer HAVING n = 4),
o AS (SELECT sample, layer, list_sum(ffn) AS upd, list_sum(out) AS state, list_transform([1, 2, 3, 5], lambda i: (a[layer * 16 + i] + a[8 + layer * 16 + i]) / 2) AS att FROM s WHERE position = sample % 2 + 5),
x AS (SELECT sample, list_sum(v[57:64]) AS te FROM e WHERE position = 0)"""


@query(f"""WITH {_HIDDEN}
SELECT sample, 0 AS span_idx, layer::INT AS layer, n::INT AS n_support, round(upd, 6) + 0 AS upd, round(state, 6) + 0 AS state, round(support, 6) + 0 AS support, round(att[1] - att[2] + 2 * att[3] - att[4], 6) + 0 AS attention,
       round(last, 6) + 0 AS prompt_last, round(mean, 6) + 0 AS prompt_mean, round(semantic, 6) + 0 AS semantic, round(confident, 6) + 0 AS confident, round(te, 6) + 0 AS target FROM g JOIN o USING (sample, layer) JOIN x USING (sample)""")
def capture_assembly(spark: SparkSession, d: str) -> DataFrame:
    c = Z.assemble(*_hidden(spark, d))
    at = lambda i: F.get("attention", F.lit(i))
    sums = {"upd": A.total(F.col("update")), "state": A.total(F.col("state")), "support": A.total(F.transform("support", A.total)), "attention": at(0) - at(1) + 2 * at(2) - at(3), "prompt_last": A.total(F.col("prompt_last")), "prompt_mean": A.total(F.col("prompt_mean")), "semantic": A.total(F.col("semantic")), "confident": A.total(F.col("prompt_probabilities")), "target": A.total(F.col("target_embedding"))}
    return c.where(F.size("support") == 4).select("sample", "span_idx", "layer", F.size("support").alias("n_support"), *[_r(v).alias(n) for n, v in sums.items()])


@query(f"""WITH {_HIDDEN}, w AS (SELECT sample, layer, position, layer * 16 AS b, a FROM l WHERE position = 6)
SELECT sample, layer::INT AS layer, head::INT AS head, round(list_sum(a[b + head * 8 + 2:b + head * 8 + 3]), 6) AS patch_mass, round(list_sum(a[b + head * 8 + 1:b + head * 8 + 1]) + list_sum(a[b + head * 8 + 4:b + head * 8 + 6]) + a[b + head * 8 + 8], 6) AS text_mass
FROM w, range(2) t(head)""")
def attention_slices(spark: SparkSession, d: str) -> DataFrame:
    rows = Z.attention_rows(_hidden(spark, d)[1], F.lit(6), 1, 3)
    return rows.select("sample", "layer", "head", _r(A.total(F.col("patch_attention"))).alias("patch_mass"), _r(A.total(F.col("text_attention"))).alias("text_mass"))


@query(f"""WITH {_HIDDEN}
SELECT sample, layer::INT AS layer, round(sum(list_sum(out)) FILTER (position = 5), 6) + 0 AS token, count(*) FILTER (position IN (1, 2))::INT AS n_patches, round(sum(out[1]) FILTER (position = 2), 6) + 0 AS second FROM s
WHERE position IN (1, 2, 5) GROUP BY sample, layer HAVING count(*) = 3""")
def state_slices(spark: SparkSession, d: str) -> DataFrame:
    rows = Z.token_and_patches(_hidden(spark, d)[0], 5, 1, 3).where(F.col("token").isNotNull() & (F.size("patches") == 2))
    return rows.select("sample", "layer", _r(A.total(F.col("token"))).alias("token"), F.size("patches").alias("n_patches"), _r(F.get(F.get("patches", F.lit(1)), F.lit(0))).alias("second"))


_ADS = f"""
WITH RECURSIVE m AS (SELECT vec_id // 8 AS sample, (vec_id % 8) // 2 AS layer, list_transform(range(1, 65), lambda i: i) AS idx, list(a ORDER BY vec_id) AS hs FROM ({_E}) GROUP BY vec_id // 8, (vec_id % 8) // 2),
a AS (SELECT sample, layer, sample * 4 + layer AS vec_id, list_transform(idx, lambda i: list_avg(list_transform(hs, lambda h: h[i]))) AS a FROM m),
n AS (SELECT sample, layer, vec_id, list_transform(a, lambda x: x - list_min(a)) AS b FROM a),
u AS (SELECT vec_id, unnest(b) / list_sum(b) AS p, unnest(range(64)) AS i FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) <= 6 AS fore FROM u),
f AS (SELECT vec_id, i, i // 8 AS y, i % 8 AS x, p FROM r WHERE fore),
reach AS (SELECT vec_id, i AS a, i AS b FROM f UNION SELECT reach.vec_id, reach.a, g.i FROM reach JOIN f h ON h.vec_id = reach.vec_id AND h.i = reach.b JOIN f g ON g.vec_id = h.vec_id AND abs(g.x - h.x) <= 1 AND abs(g.y - h.y) <= 1),
area AS (SELECT vec_id, a, count(*) AS n FROM reach GROUP BY vec_id, a),
mass AS (SELECT f.vec_id, coalesce(sum(p) FILTER (n >= 3), 0) AS m FROM f JOIN area ON area.vec_id = f.vec_id AND area.a = f.i GROUP BY f.vec_id),
back AS (SELECT vec_id, p, sum(p) OVER (PARTITION BY vec_id) AS t FROM r WHERE NOT fore),
ent AS (SELECT vec_id, -sum(greatest(p / t, 1e-12) * ln(greatest(p / t, 1e-12))) / ln(64) AS h FROM back GROUP BY vec_id),
each AS (SELECT sample, layer, (1 - m) * h AS ads, count(*) OVER (PARTITION BY sample) AS layers FROM mass JOIN ent USING (vec_id) JOIN n USING (vec_id))"""


@query(_ADS + """
SELECT sample, max(layers)::INT AS n_layers, round(avg(ads) FILTER (layer >= 1 AND layer < 3), 6) AS score FROM each WHERE layers = 4 GROUP BY sample""")
def ads_score(spark: SparkSession, d: str) -> DataFrame:
    x = _curves(spark, d).select(F.floor(F.col("vec_id") / 8).cast("long").alias("sample"), F.floor((F.col("vec_id") % 8) / 2).cast("int").alias("layer"), (F.col("vec_id") % 2).alias("head"), F.col("a").alias("attention"))
    s = K.dispersion_scores(x, "sample")
    return s.where(F.size("per_layer") == 4).select("sample", F.size("per_layer").alias("n_layers"), _r(F.col("score")).alias("score"))


@query(f"""
WITH x AS (SELECT vec_id, v[57:64] AS q, unnest(list_transform(range(1, 7), lambda i: v[i * 8 + 1:i * 8 + 8])) AS s, unnest(a[1:6]) AS w, unnest(range(6)) AS i FROM ({_E})),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, i) AS k FROM x WHERE i >= 1 AND i < 5)
SELECT vec_id, round(avg(list_dot_product(q, s) / sqrt(list_dot_product(q, q) * list_dot_product(s, s))), 6) AS visual FROM r WHERE k <= 3 GROUP BY vec_id""")
def atarget_visual(spark: SparkSession, d: str) -> DataFrame:
    states = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.slice("v", i * 8 + 1, F.lit(8)))
    x = _curves(spark, d).select("vec_id", states.alias("s"), F.sequence(F.lit(0), F.lit(5)).alias("at"), F.slice("a", 1, 6).alias("w"), F.slice("v", 57, 8).alias("q"))
    return x.select("vec_id", _r(A.atarget_visual(F.col("s"), F.col("at"), F.col("w"), F.col("q"), 1, 5, 3)).alias("visual"))


@query(f"""
WITH h AS (SELECT vec_id // 8 AS sample, (vec_id % 8) // 2 AS layer, vec_id % 2 AS head, a, list_sum(a) AS m FROM ({_E})),
r AS (SELECT *, row_number() OVER (PARTITION BY sample, layer ORDER BY m DESC, head) AS k FROM h)
SELECT sample, layer, round(max(list_max(a)) FILTER (k = 1), 6) AS top_head_peak, round(sum(m) / count(*), 6) AS mean_mass FROM r GROUP BY sample, layer""")
def attention_heads(spark: SparkSession, d: str) -> DataFrame:
    x = _curves(spark, d).select(F.floor(F.col("vec_id") / 8).cast("long").alias("sample"), F.floor((F.col("vec_id") % 8) / 2).cast("long").alias("layer"), (F.col("vec_id") % 2).alias("head"), F.col("a").alias("attention"))
    one = K.top_heads(x, ["sample", "layer"], 1).select("sample", "layer", _r(F.array_max("attention")).alias("top_head_peak"))
    every = K.top_heads(x, ["sample", "layer"]).select("sample", "layer", _r(A.total(F.col("attention"))).alias("mean_mass"))
    return one.join(every, ["sample", "layer"])


_UNIT = "('0x' || substr(md5(doc_id || ':42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"SELECT doc_id, CASE WHEN {_UNIT} < 0.8 THEN 'train' WHEN {_UNIT} < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split FROM documents")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return R.hash_split(_table(spark, d, "documents"), "doc_id", [("train", 0.8), ("val", 0.1), ("test", 0.1)])


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) - 1 AS k, greatest(1, floor(count(*) OVER () * 0.8::DOUBLE)) AS t, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k < t THEN 'train' WHEN k < t + floor((n - t) / 2) THEN 'val' ELSE 'test' END AS split FROM r""")
def pope_split(spark: SparkSession, d: str) -> DataFrame:
    return R.count_split(_table(spark, d, "documents").select("doc_id"), "doc_id", 0.8, rest=("val", "test"))


@query(f"""
WITH s AS (SELECT doc_id, CASE WHEN {_UNIT} < 0.9 THEN 'train' ELSE 'test' END AS split FROM documents)
SELECT split, count(*) AS n, count(*) FILTER (toxic = 1) AS n_hallucinated, count(DISTINCT toxic) AS n_classes, round(avg(toxic), 6) AS rate FROM labels JOIN s USING (doc_id) GROUP BY split""")
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    splits = R.hash_split(_table(spark, d, "documents"), "doc_id", [("train", 0.9), ("test", 0.1)])
    rows = _table(spark, d, "labels").join(splits, "doc_id")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_hallucinated"), F.count_distinct("toxic").alias("n_classes"), _r(F.avg("toxic")).alias("rate"))


@query(f"""
WITH x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN -1 WHEN vec_id % 11 = 0 THEN NULL ELSE (vec_id % 2) END AS label, CASE WHEN vec_id % 3 = 0 THEN a ELSE v END AS x FROM ({_E}))
SELECT vec_id, label::INT AS label, 32 AS n, round(list_sum(x[5:12]) + list_sum(x[21:28]) + list_sum(x[37:44]) + list_sum(x[53:60]), 6) AS total FROM x WHERE label >= 0""")
def matrix_of_layers(spark: SparkSession, d: str) -> DataFrame:
    """The middle half of four blocks of 16 layers, from the vector or, where it is null, the other one; labelled rows only."""
    label = F.when(F.col("vec_id") % 7 == 0, -1).when(F.col("vec_id") % 11 != 0, F.col("vec_id") % 2).cast("int")
    rows = _curves(spark, d).select("vec_id", label.alias("label"), F.when(F.col("vec_id") % 3 != 0, F.col("v")).alias("vector"), "a")
    x = L.feature_matrix(rows, "vector", "a", layers=16, layer_range=(0.25, 0.75))
    return x.select("vec_id", "label", F.size("x").alias("n"), _r(F.aggregate("x", F.lit(0.0), lambda s, v: s + v)).alias("total"))


def _detector(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = L.feature_matrix(_curves(spark, d).withColumn("label", (F.get("v", F.lit(0)) > 0).cast("int")), "a")
    splits = R.hash_split(rows, "vec_id", [("train", 0.6), ("val", 0.2), ("test", 0.2)])
    return rows, splits, *[R.in_split(rows, splits, s, "vec_id") for s in ("train", "val")]


def _grid(spark: SparkSession, d: str, kind: str, params: dict) -> DataFrame:
    rows, splits, train, val = _detector(spark, d)
    found, best, _ = L.train_and_evaluate(kind, params, train, val, R.in_split(rows, splits, "test", "vec_id"))
    return found.select(F.lit(str(sorted(best.items()))).alias("parameters"), "*")


@query()
def grid_search_gbt(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d, "gbt", {"n_estimators": 5, "max_depth": [2, 3], "learning_rate": 0.1})


@query()
def grid_search_xgb(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d, "xgb", {"n_estimators": 4, "max_depth": [2, 3], "learning_rate": 0.3})


_CUTS = [round(-0.3 + 0.05 * i, 2) for i in range(13)]


@query(f"""
WITH rows AS (SELECT v, (label < 5)::INT AS y FROM ({_E})), base AS (SELECT avg(y)::DOUBLE AS p, count(*)::DOUBLE AS n FROM rows),
sums AS (SELECT f, c.edge, sum(p - y) FILTER (v[f] < c.edge) AS gl, p * (1 - p) * count(*) FILTER (v[f] < c.edge) AS hl, sum(p - y) AS g, p * (1 - p) * n AS h
         FROM rows, base, range(1, 65) t(f), (SELECT unnest({_CUTS}::DOUBLE[]) AS edge) c GROUP BY f, c.edge, p, n),
gains AS (SELECT *, (gl ** 2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g ** 2 / (h + 1)) / 2 AS gain FROM sums WHERE hl >= 1 AND h - hl >= 1)
SELECT (f - 1)::INT AS feature, round(edge, 6) AS edge, round(-0.3 * gl / (hl + 1), 6) AS left_value, round(-0.3 * (g - gl) / (h - hl + 1), 6) AS right_value, round(hl, 6) AS left_cover, round(h - hl, 6) AS right_cover
FROM gains ORDER BY round(gain, 6) DESC, feature, edge LIMIT 1""")
def second_order_stump(spark: SparkSession, d: str) -> DataFrame:
    rows = _curves(spark, d).select(F.col("v").alias("x"), "label")
    t = B.fit(rows, 64, n_estimators=1, max_depth=1, learning_rate=0.3, cuts=[_CUTS] * 64).trees[0]
    found = [(t.feature[0], t.at[0], t.value[t.left[0]], t.value[t.right[0]], t.cover[t.left[0]], t.cover[t.right[0]])] if t.left[0] >= 0 else []
    names = ("edge", "left_value", "right_value", "left_cover", "right_cover")
    return _rounded(spark.createDataFrame(found, "feature int, " + ", ".join(f"{n} double" for n in names)), *names)


@query()
def grid_search_rf(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d, "rf", {"n_estimators": [5, 10], "max_depth": 5})


@query()
def grid_search_mlp(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d, "mlp", {"hidden_layer_sizes": [(8,), (16,)], "max_iter": 30})


@query()
def feature_ablation(spark: SparkSession, d: str) -> DataFrame:
    rows, splits, _, _ = _detector(spark, d)
    return L.ablation("rf", {"n_estimators": 5, "max_depth": 4}, rows, splits, "vec_id", {f"block{i}": (16 * i, 16 * i + 16) for i in range(4)})


@query()
def block_importance(spark: SparkSession, d: str) -> DataFrame:
    _, _, train, val = _detector(spark, d)
    model = L.build("rf", {"n_estimators": 5, "max_depth": 4}, 64).fit(train)
    return _rounded(L.block_importance(model, val, 16), "importance")


@query()
def tree_shapley(spark: SparkSession, d: str) -> DataFrame:
    _, _, train, val = _detector(spark, d)
    model = L.build("xgb", {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3}, 64).fit(train)
    return _rounded(S.layer_importance(S.tree_shapley(model, S.explained(val)), 16), "importance")


@query()
def kernel_shapley(spark: SparkSession, d: str) -> DataFrame:
    _, _, train, val = _detector(spark, d)
    model = L.build("mlp", {"hidden_layer_sizes": (8,), "max_iter": 30}, 64).fit(train)
    score = lambda rows: L.predict(model, rows.withColumn("features", array_to_vector("x")))
    return _rounded(S.layer_importance(S.kernel_shapley(score, S.explained(val), train, "vec_id", 64, most=10, drawn=128), 16), "importance")


_LENS = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
w AS (SELECT token, list(m ORDER BY i) AS w FROM (SELECT label AS token, i, avg(e[i]) AS m FROM v, range(1, 65) t(i) GROUP BY label, i) GROUP BY token),
z AS (SELECT vec_id, label, token, list_dot_product(e, w) AS z FROM v, w)
SELECT vec_id AS key, round(max(exp(z)) FILTER (token = label) / sum(exp(z)), 6) AS probability FROM z GROUP BY vec_id"""


@query(_LENS)
def logit_lens(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's probability of its own label, with the labels' mean vectors as a sharded output matrix."""
    v = _vectors(spark, d)
    each = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    w = each.groupBy(F.col("label").cast("long").alias("token")).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s")).select("token", F.col("s.m").alias("w"))
    return _rounded(K.sharded_probabilities(v.select(F.col("vec_id").alias("key"), F.col("v").alias("state"), F.col("label").alias("target")), w, shard=4), "probability")


def _detector_sql(rows: str) -> str:
    """The threshold detector's row for each baseline of ``rows`` (baseline, s, y)."""
    return f"""
WITH rows AS ({rows}), span AS (SELECT baseline, min(s) AS lo, max(s) AS hi FROM rows GROUP BY baseline),
taus AS (SELECT baseline, i, lo + i * (hi - lo) / 199.0::DOUBLE AS tau FROM span, range(200) t(i)),
c AS (SELECT baseline, i, tau, count(*) FILTER (s > tau AND y = 1) AS tp, count(*) FILTER (s > tau AND y = 0) AS fp,
             count(*) FILTER (s <= tau AND y = 1) AS fn, count(*) FILTER (s <= tau AND y = 0) AS tn FROM rows JOIN taus USING (baseline) GROUP BY baseline, i, tau),
m AS (SELECT baseline, i, tau, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r,
             CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f, (tp + tn) / (tp + fp + fn + tn) AS acc FROM c),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY baseline ORDER BY f DESC, i) = 1),
g AS (SELECT baseline, s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM rows GROUP BY baseline, s),
k AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY baseline ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
auc AS (SELECT baseline, {_AUC} AS auc FROM k GROUP BY baseline)
SELECT baseline, i::INT AS i, round(tau, 6) AS tau, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1, round(acc, 6) AS accuracy, round(auc, 6) AS auc FROM best JOIN auc USING (baseline)"""


_BASELINES = f"""
  SELECT unnest(['head', 'svar']) AS baseline, unnest([a[1], list_sum(a[10:35])]) AS s, (label < 5)::INT AS y FROM ({_E})"""


@query(_detector_sql(_BASELINES))
def attention_baselines(spark: SparkSession, d: str) -> DataFrame:
    """The threshold detector on single attention values: one head's, and the share of early middle layers."""
    rows = _curves(spark, d).select("label", F.get("a", F.lit(0)).alias("head"), A.svar_score(F.col("a")).alias("svar"))
    return _baselines(rows, ("head", "svar"))


def _baselines(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    out = None
    for name in names:
        one = _rounded(M.evaluate_threshold(rows, name), "tau", "precision", "recall", "f1", "accuracy", "auc").select(F.lit(name).alias("baseline"), "*")
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH docs AS ({_SCORED}), s AS (SELECT *, CASE WHEN ('0x' || substr(md5(doc_id || ':42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5 THEN 'train' ELSE 'test' END AS split FROM docs),
r AS (SELECT 'x' AS baseline, doc_id, s, y FROM s WHERE split = 'test'), f AS ({_detector_sql("SELECT baseline, s, y FROM r")})
SELECT (SELECT count(DISTINCT doc_id) FROM r) AS test_images, (SELECT count(*) FROM r) AS test_object_tokens, (SELECT count(*) FROM r WHERE y = 1) AS test_hallucinated_tokens, f.* EXCLUDE (baseline) FROM f""")
def evaluate_detection_only(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d)
    out = D.evaluate_detection_only(rows, R.hash_split(rows.select("doc_id"), "doc_id", [("train", 0.5), ("test", 0.5)]), "score", "doc_id")
    return _rounded(out, "tau", "precision", "recall", "f1", "accuracy", "auc")


_LOGIT_BASELINES = f"""
  SELECT unnest(['nll', 'entropy']) AS baseline, unnest([-ln(list_max(p)), -list_sum(list_transform(p, lambda y: y * ln(y))) / ln(64)]) AS s, (label < 5)::INT AS y
  FROM (SELECT label, list_transform(e, lambda y: y / list_sum(e)) AS p FROM (SELECT label, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM ({_E})))"""


@query(_detector_sql(_LOGIT_BASELINES))
def baseline_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The threshold detector on the columns of the vectors read as logits."""
    rows = _curves(spark, d).select("label", A.token_stats(F.col("v")).alias("s")).select("label", "s.nll", "s.entropy")
    return _baselines(rows, ("nll", "entropy"))


_QUESTIONS = r"""SELECT *, lower(trim(regexp_extract('Is there a ' || split_part(text, ' ', 1) || ' in the image?', '(?i)Is there (?:a|an)\s+(.+?)\s+in the image', 1))) AS object_word
  FROM (SELECT conv_id * 1000 + turn AS question_id, conv_id, turn, text FROM conversations WHERE role = 'assistant')"""


def _questions(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Questions about the first word of each answer, written as one JSON object a line, and their folder."""
    c = _table(spark, d, "conversations").where("role = 'assistant'")
    file = F.format_string("COCO_val2014_%012d.jpg", "conv_id")
    q = c.select(F.concat(F.lit("Is there a "), F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" in the image?")).alias("text"), file.alias("image"), F.when(F.col("turn") % 4 < 2, " Yes").otherwise("no").alias("label"), (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"))
    folder = scratch(spark, "questions")
    q.write.json(f"{folder}/coco_pope_random.jsonl")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("generated_text")), folder


@query(f"""SELECT question_id, conv_id AS image_id, printf('/images/COCO_val2014_%012d.jpg', conv_id) AS image_path, object_word, CASE WHEN turn % 4 < 2 THEN 'yes' ELSE 'no' END AS gt_label
FROM ({_QUESTIONS}) WHERE object_word <> ''""")
def question_scan(spark: SparkSession, d: str) -> DataFrame:
    _, folder = _questions(spark, d)
    return readers.pope_questions(spark, folder, split="random", images_dir="/images").select("question_id", "image_id", "image_path", "object_word", "gt_label")


@query(f"""SELECT question_id, md5('USER: <image>' || chr(10) || 'Is there a ' || split_part(text, ' ', 1) || ' in the image?' || chr(10) || 'Answer the question using a single word or phrase.' || chr(10) || 'ASSISTANT:') AS prompt,
  answer AS model_answer, CASE answer WHEN 'yes' THEN (gt = 'no')::INT ELSE -1 END AS label FROM ({_YES_NO}) JOIN ({_QUESTIONS}) USING (conv_id, turn) WHERE object_word <> ''""")
def pope_pipeline(spark: SparkSession, d: str) -> DataFrame:
    answers, folder = _questions(spark, d)
    rows = D.pope_rows(readers.pope_questions(spark, folder, split="random"), answers, model="llava_1_5_7b")
    return rows.select("question_id", F.md5("prompt").alias("prompt"), "model_answer", "label")


_MIDDLE = "layer >= floor(layers * 0.25) AND layer < floor(layers * 0.75)"


@query(_ADS + f""",
ads AS (SELECT sample, coalesce(avg(ads) FILTER ({_MIDDLE}), 'NaN'::DOUBLE) AS ads FROM each GROUP BY sample),
c AS (SELECT vec_id // 8 AS sample, (vec_id % 8) // 2 AS layer, list_avg(list_reverse_sort({_COS})[1:5]) AS c, count(*) OVER (PARTITION BY vec_id // 8) AS layers FROM ({_SLICES}) WHERE vec_id % 2 = 0),
cgc AS (SELECT sample, coalesce(avg(c) FILTER ({_MIDDLE}), avg(c)) AS cgc FROM c GROUP BY sample),
s AS (SELECT sample, layer, mass, count(*) OVER (PARTITION BY sample) AS layers FROM (SELECT vec_id // 8 AS sample, (vec_id % 8) // 2 AS layer, avg(list_sum(a)) AS mass FROM ({_E}) GROUP BY ALL)),
svar AS (SELECT sample, coalesce(sum(mass) FILTER (layer >= floor(layers * 0.15) AND layer < floor(layers * 0.55)), 0) AS svar FROM s GROUP BY sample),
z AS (SELECT vec_id // 8 AS sample, (list_position(v, list_max(v)) - 1)::INT AS token_id, ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) AS nll FROM ({_E}) WHERE vec_id % 8 = 0)
SELECT sample AS question_id, CASE WHEN sample % 3 > 0 THEN (sample % 2 = 0)::INT ELSE -1 END AS label, token_id, round(ads, 6) AS ads_score, round(cgc, 6) AS cgc_score, round(svar, 6) AS svar_score, round(nll, 6) AS token_nll
FROM ads JOIN cgc USING (sample) JOIN svar USING (sample) JOIN z USING (sample)""")
def question_features(spark: SparkSession, d: str) -> DataFrame:
    """Wide rows of questions whose captures are the vectors: four layers of two heads each."""
    rows, of = _question_set(spark, d)
    wide = D.question_features(rows, of)
    return _rounded(wide.select("question_id", "label", "token_id", "ads_score", "cgc_score", "svar_score", "token_nll"), "ads_score", "cgc_score", "svar_score", "token_nll")


def _question_set(spark: SparkSession, d: str) -> tuple[DataFrame, D.QuestionSet]:
    x = _curves(spark, d).withColumns({"question_id": F.floor(F.col("vec_id") / 8).cast("long"), "layer": F.floor((F.col("vec_id") % 8) / 2).cast("int"), "head": (F.col("vec_id") % 2).cast("int")})
    one = x.where("vec_id % 8 = 0")
    word = F.concat(F.lit("thing"), "question_id")
    questions = one.select("question_id", F.floor(F.col("question_id") / 2).cast("long").alias("image_id"), F.concat(F.lit("Is there a "), word, F.lit(" in the image?")).alias("question"), word.alias("object_word"), F.when(F.col("question_id") % 2 == 0, "no").otherwise("yes").alias("gt_label"))
    answers = one.select("question_id", F.when(F.col("question_id") % 3 > 0, "Yes, there is").otherwise("No").alias("generated_text"))
    patches = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, F.lit(8)))
    states = x.where("head = 0").select("question_id", "layer", F.slice("v", 1, 8).alias("token"), patches.alias("patches"))
    of = D.QuestionSet(questions, answers, x.select("question_id", "layer", "head", F.col("a").alias("patch_attention")), states, one.select("question_id", F.col("v").alias("logits")))
    return D.pope_rows(questions, answers), of


_SAMPLES = """
WITH n AS (SELECT o_custkey AS c_custkey, count(*) AS n, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS objects, md5(string_agg(o_orderpriority, ',' ORDER BY o_orderpriority)) AS captions
           FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 30 GROUP BY o_custkey)
SELECT c_custkey AS image_id, '/images/' || c_name AS image_path, coalesce(n, 0) AS n_annotations, coalesce(objects, '') AS objects, coalesce(captions, md5('')) AS captions FROM customer LEFT JOIN n USING (c_custkey)"""


@query(_SAMPLES)
def sample_scan(spark: SparkSession, d: str) -> DataFrame:
    """Customers as images, orders as annotations and captions, in JSON documents of up to a thousand elements."""
    folder, captions = scratch(spark, "samples"), scratch(spark, "captions")
    o = _table(spark, d, "orders")
    note = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("image_id"), (F.col("o_orderkey") % 30).alias("category_id"))
    _documents(_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("file_name")), "images", folder)
    _documents(_table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "categories", folder)
    _documents(note, "annotations", folder)
    _documents(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("image_id"), F.col("o_orderpriority").alias("caption")), "annotations", captions)
    s = readers.coco_samples(spark, folder, captions).withColumn("image_path", F.concat(F.lit("/images/"), "file_name"))
    return s.select("image_id", "image_path", F.size("annotations").cast("long").alias("n_annotations"), F.array_join("coco_objects", ",").alias("objects"), F.md5(F.array_join(F.array_sort("captions"), ",")).alias("captions"))


def _documents(rows: DataFrame, name: str, folder: str) -> None:
    """Appends documents with one array each, of the rows whose ids share their thousand."""
    by = rows.groupBy(F.floor(F.col("id") / 1000).alias("b")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("a"))
    by.select(F.concat(F.lit('{"info": {"images": [{"id": 0}]}, "' + name + '": '), "a", F.lit("}")).alias("value")).write.mode("append").text(folder)


@query("SELECT doc_id AS image_id, n_chars, md5(text) AS text FROM documents")
def json_map_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as JSON objects keyed by id, and read back."""
    path = scratch(spark, "json-map")
    readers.save_json(_table(spark, d, "documents").select("doc_id", "n_chars", "text"), path, "doc_id")
    return readers.json_map(spark, path, "n_chars:long,text:string").select("image_id", "n_chars", F.md5("text").alias("text"))


@query("SELECT conv_id AS image_id, count(*) AS n FROM conversations WHERE trim(text) <> '' AND conv_id IN (SELECT doc_id FROM documents) GROUP BY conv_id")
def caption_scan(spark: SparkSession, d: str) -> DataFrame:
    """Caption lines of known images with a caption."""
    path = scratch(spark, "captions")
    readers.save_json(_table(spark, d, "conversations").select(F.col("conv_id").alias("image_id"), F.col("text").alias("caption")), path)
    found = readers.caption_rows(spark, path, _table(spark, d, "documents").select(F.col("doc_id").alias("image_id")))
    return found.groupBy("image_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS image_id, n_chars FROM documents")
def incremental_sink(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents are written first; a second run adds what is still pending, and nothing twice."""
    path, rows = scratch(spark, "features"), _table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), "n_chars")
    done = readers.read_or_empty(spark, path, rows.schema)
    readers.append_rows(R.pending(rows.join(_table(spark, d, "labels").select(F.col("doc_id").alias("image_id")), "image_id", "left_semi"), done), path)
    readers.append_rows(R.pending(rows, readers.read_or_empty(spark, path, rows.schema)), path)
    return readers.read_or_empty(spark, path, rows.schema)


@query("SELECT page_id AS image_id, CASE WHEN page_id % 7 > 0 THEN lower(url) END AS generated_text, CASE WHEN page_id % 7 = 0 THEN 'ValueError: no text' END AS error FROM pages")
def provider_rows(spark: SparkSession, d: str) -> DataFrame:
    """A provider over partitions: an item that fails gives an error, its batch still gives results."""
    rows = _table(spark, d, "pages").select(F.col("page_id").alias("image_id"), F.when(F.col("page_id") % 7 > 0, F.col("url")).otherwise("").alias("text"))
    return D.generate(rows, lambda: providers.build("echo", {}))


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents QUALIFY k <= 100")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The limit that is the feature: the 100 longest documents."""
    rows = _table(spark, d, "documents").select("doc_id", F.struct((-F.col("n_chars")).alias("n"), "doc_id").alias("key"))
    top = R.first_rows(rows, "key", 100).select(F.collect_list("key").alias("keys"))  # one row of 100 keys
    return top.select(F.posexplode(F.array_sort("keys")).alias("k", "key")).select("key.doc_id", (F.col("k") + 1).cast("long").alias("k"))
