"""Queries about machine-text detection, its training, metrics and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from copytrace.functions.numeric import round_even
from copytrace.operators import calibrate, detect, evaluate, train
from copytrace.plans import common as C
from copytrace.plans.reuse_queries import _SELF
from copytrace.plans.text_queries import SQL_TURNS, sql_text_stats
from copytrace.session import new_path
from copytrace.sources.labelled import labelled_turns, row_ids
from copytrace.sources.tables import corpus_table, read_table, spread, turn_table
from copytrace.streaming.jobs import detect_stream, text_stream

# Names of the 64 places: two that tell the classes, and topics that tell nothing.
LABELS = ("Real", "Fake", *(f"topic {i}" for i in range(2, 64)))
TEMPERATURE = 1.5
# Largest slope of a loss that counts as its optimum.
OPTIMUM = 1e-5
CURVE = (0.5, 1.0, 1.5, 2.0, 3.0, 5.0)
RESULT = detect.RESULT


def detect_heuristic(spark, folder):
    return detect.detect_heuristic(corpus_table(spark, folder)).select("doc_id", *RESULT)


def explain_signals(spark, folder):
    found = detect.explain_signals(corpus_table(spark, folder))
    return found.select("doc_id", "repeated", F.array_join("explanation", " | ").alias("explanation"))


def _logits(spark, folder):
    """All places of each vector as class logits, its label (0 to 9) as the true class."""
    logits = F.transform("embedding", lambda x: x.cast("double")).alias("logits")
    return read_table(spark, folder, "embeddings").select("vec_id", logits, F.col("label").alias("true_index"))


def detect_from_logits(spark, folder):
    found = detect.detect_from_logits(_logits(spark, folder), LABELS, TEMPERATURE)
    return found.select("vec_id", *RESULT, "reason")


def detect_with_fallback(spark, folder):
    """Documents with logits get the model's verdict, all others the heuristic one."""
    logits = _logits(spark, folder).withColumnRenamed("vec_id", "doc_id")
    scored = detect.detect_from_logits(logits, LABELS, TEMPERATURE)
    return detect.with_fallback(scored, corpus_table(spark, folder), ["doc_id"])


def _told(found):
    return found.withColumn("explanation", F.array_join("explanation", " | "))


def detect_score(spark, folder):
    found = detect.detect(corpus_table(spark, folder), "heuristic")
    return _told(detect.detect_score(found, ["doc_id"]))


def detect_transformer(spark, folder):
    """Documents with logits get the model's verdict and reason, all others the heuristic; with all reasons."""
    logits = _logits(spark, folder).withColumnRenamed("vec_id", "doc_id")
    found = detect.detect(corpus_table(spark, folder), "transformer", logits=logits, labels=LABELS, temperature=TEMPERATURE)
    return _told(found)


def _labelled(spark, folder):
    return row_ids(labelled_turns(turn_table(spark, folder)), "conv_id", "turn").select("row_id", "text", "label")


def _predicted(spark, folder):
    turns = _labelled(spark, folder).withColumnRenamed("label", "truth")
    scored = detect.detect_heuristic(turns)
    return scored.select("row_id", F.col("truth").alias("label"), F.lower("label").alias("predicted"), "ai_probability")


def binary_metrics(spark, folder):
    return evaluate.binary_metrics(_predicted(spark, folder))


def confusion_matrix(spark, folder):
    return evaluate.confusion_matrix(_predicted(spark, folder))


def roc_auc(spark, folder):
    return evaluate.roc_auc(_predicted(spark, folder), "ai_probability")


def logit_metrics(spark, folder):
    return evaluate.logit_metrics(_logits(spark, folder))


def nll_at_temperature(spark, folder):
    return evaluate.nll(_logits(spark, folder), TEMPERATURE).select(round_even(F.col("nll"), 6).alias("nll"))


def nll_curve(spark, folder):
    curve = evaluate.nll_curve(_logits(spark, folder), CURVE)
    return curve.select("temperature", round_even(F.col("nll"), 6).alias("nll"))


def fit_temperature(spark, folder):
    report = calibrate.calibration_report(_logits(spark, folder), "embedding-logits", "embeddings")
    digits = {"temperature": 4, "nll_before": 6, "nll_after": 6}
    return report.select(*[round_even(F.col(c), digits[c]).alias(c) if c in digits else c for c in report.columns])


def train_classifier(spark, folder):
    """Rows of each class, terms of the saved model after one round trip, and whether its weights are at the optimum."""
    path = new_path(spark, "classifier")
    turns = _labelled(spark, folder)
    train.ship_classifier(turns, path)
    model = train.load_classifier(spark, path)
    steepest = train.largest_slope(model, turns)
    return turns.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(model.terms.count()).alias("features"),
        F.lit(steepest < OPTIMUM).alias("at_optimum"),
    )


def evaluate_classifier(spark, folder):
    """The held-out report of the turns' classifier."""
    report = train.evaluate_classifier(_labelled(spark, folder), "conversations")
    return report.withColumn("labels", F.array_join("labels", ",")).withColumn(
        "confusion_matrix", F.to_json("confusion_matrix")
    )


def _quality(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    quality = read_table(spark, folder, "labels").select("doc_id", F.when(F.col("quality") == 1, "ai").otherwise("human").alias("label"))
    return row_ids(spread(docs.join(quality, "doc_id"), "doc_id"), "doc_id").select("row_id", "text", "label")


def quality_classifier(spark, folder):
    """The same training on documents with their quality label as the class."""
    return train.evaluate_classifier(_quality(spark, folder), "quality").drop("labels", "confusion_matrix")


def detect_classifier(spark, folder):
    model = train.fit_classifier(_labelled(spark, folder))
    return detect.detect_classifier(corpus_table(spark, folder), model).select("doc_id", *RESULT)


def stream_detect(spark, folder):
    """Every document arrives on a stream and is scored."""
    out = new_path(spark, "stream-detect")
    arriving = text_stream(spark, f"{folder}/documents*.parquet", "doc_id BIGINT, text STRING")
    detect_stream(arriving, out, new_path(spark, "cp")).awaitTermination()
    return spark.read.parquet(out).select("doc_id", *RESULT)


QUERIES = {
    "detect_heuristic": detect_heuristic,
    "explain_signals": explain_signals,
    "detect_from_logits": detect_from_logits,
    "detect_with_fallback": detect_with_fallback,
    "detect_score": detect_score,
    "detect_transformer": detect_transformer,
    "binary_metrics": binary_metrics,
    "confusion_matrix": confusion_matrix,
    "roc_auc": roc_auc,
    "logit_metrics": logit_metrics,
    "nll_at_temperature": nll_at_temperature,
    "nll_curve": nll_curve,
    "fit_temperature": fit_temperature,
    "train_classifier": train_classifier,
    "evaluate_classifier": evaluate_classifier,
    "quality_classifier": quality_classifier,
    "detect_classifier": detect_classifier,
    "stream_detect": stream_detect,
}

# ---- SQL -----------------------------------------------------------------------


def _sql_inverse(x: str, low: str) -> str:
    return f"CASE WHEN {x} >= {low}::DOUBLE THEN 0.0::DOUBLE ELSE ({low}::DOUBLE - {x}) / {low}::DOUBLE END"


def _sql_verdict(p: str, human: str, backend: str) -> str:
    return f"""{C.sql_round(human, 4)} AS human_probability, {C.sql_round(p, 4)} AS ai_probability,
  {C.sql_round(f'abs({p} - 0.5::DOUBLE) * 2', 4)} AS confidence,
  CASE WHEN {p} >= 0.5::DOUBLE THEN 'AI' ELSE 'Human' END AS label, '{backend}' AS backend"""


def _sql_heuristic(source: str, keys: str) -> str:
    return f"""{sql_text_stats(source, keys)},
hp AS (SELECT {keys}, ({_sql_inverse('lexical_diversity', '0.4')} + {_sql_inverse('burstiness', '4.0')}) / 2.0::DOUBLE AS p FROM stats),
h AS (SELECT {keys}, {_sql_verdict('p', '1.0::DOUBLE - p', 'heuristic')} FROM hp)"""


# z(vec_id, zs, y): all places and the true class; p also has the shares p0, p1 of the first two classes.
_LOGITS = f"""z AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS zs, label AS y FROM embeddings),
s AS (SELECT *, [exp((x - list_max(zs)) / {TEMPERATURE}::DOUBLE) FOR x IN zs] AS es FROM z),
p AS (SELECT *, es[1] / list_sum(es) AS p0, es[2] / list_sum(es) AS p1 FROM s)"""
_REASON = f"""'transformer classifier (model) predicts ' || CASE WHEN p1 >= 0.5::DOUBLE THEN 'AI-generated' ELSE 'human-written' END
  || ' with ' || CAST({C.sql_round('greatest(p0, p1) * 100.0::DOUBLE', 1)} AS DECIMAL(5, 1)) || '% probability'"""


def _sql_counts(truth: str, predicted: str, positive: str, source: str) -> str:
    return f"""SELECT count(*) AS n, count(*) FILTER ({truth} = {predicted}) AS ok,
  count(*) FILTER ({truth} = {positive} AND {predicted} = {positive}) AS tp,
  count(*) FILTER ({truth} <> {positive} AND {predicted} = {positive}) AS fp,
  count(*) FILTER ({truth} = {positive} AND {predicted} <> {positive}) AS fn FROM {source}"""


def _sql_ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE {C.sql_round(f'({a}) / ({b})::DOUBLE', 4)} END"


_METRICS = f"""SELECT n, {_sql_ratio('ok', 'n')} AS accuracy, {_sql_ratio('tp', 'tp + fp')} AS precision,
  {_sql_ratio('tp', 'tp + fn')} AS recall, {_sql_ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c"""

# Heuristic predictions on the labelled turns: truth, predicted, p.
_TURN_SCORES = f"""{SQL_TURNS},
labelled AS (SELECT conv_id, turn, label AS truth, text FROM turns),
{_sql_heuristic('labelled', 'conv_id, turn, truth')},
scored AS (SELECT conv_id, turn, truth, lower(label) AS predicted, ai_probability AS p FROM h)"""


# Area under the ROC curve of scored(truth, p).
_AREA = f"""WITH r AS (SELECT truth, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS avg_rank FROM scored),
u AS (SELECT sum(avg_rank) FILTER (truth = 'ai') AS ranks, count(*) FILTER (truth = 'ai') AS np, count(*) FILTER (truth <> 'ai') AS nn FROM r)
SELECT {C.sql_round('(ranks - np * (np + 1) / 2.0::DOUBLE) / (np::DOUBLE * nn)', 4)} AS roc_auc FROM u"""


def _sql_nll(t: str) -> str:
    return f"avg(ln(list_sum([exp((x - list_max(zs)) / {t}) FOR x IN zs])) - (zs[y + 1] - list_max(zs)) / {t})"


# Mean slope of the loss by b = 1/T, and the temperature by halving the bracket of b.
_SLOPE = """(SELECT avg(list_sum([exp((x - list_max(zs)) * mid) * x FOR x IN zs]) / list_sum([exp((x - list_max(zs)) * mid) FOR x IN zs]) - zs[y + 1]) FROM z)"""
_TEMPERATURE = f"""halved AS (SELECT 0 AS k, {1 / calibrate.HIGH}::DOUBLE AS lo, {1 / calibrate.LOW}::DOUBLE AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN s > 0 THEN lo ELSE mid END, CASE WHEN s > 0 THEN mid ELSE hi END
  FROM (SELECT *, {_SLOPE} AS s FROM (SELECT *, (lo + hi) / 2 AS mid FROM halved WHERE k < 40))),
fitted AS (SELECT 2 / (lo + hi) AS t FROM halved ORDER BY k DESC LIMIT 1)"""


def _sql_split(source: str, keys: str, name: str) -> str:
    """split(row_id, text, label, split) of source(row_id, text, label): exact stratified shares by a hash."""
    return f"""c_{name} AS (SELECT label, count(*) AS n FROM {source} GROUP BY label),
a_{name} AS (SELECT label, n, ceil(round(sum(n) OVER () * 0.2::DOUBLE, 9)) AS target, sum(n) OVER () AS total FROM c_{name}),
s_{name} AS (SELECT label, target, n * target / total AS share, floor(n * target / total) AS base FROM a_{name}),
quota AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY share - base DESC, label) <= target - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM s_{name}),
r_{name} AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) AS rank FROM {source}),
{name} AS (SELECT row_id, text, label, CASE WHEN rank <= quota THEN 'test' ELSE 'train' END AS split FROM r_{name} JOIN quota USING (label))"""


# Steps of the accelerated gradient descent that stands for the trainer in SQL.
_STEPS = 600


def _sql_fit(source: str) -> str:
    """weights(term, idf, weight) and bias(b) of the classifier of source(row_id, text, label).

    The weights are X'a for one number a row, so the descent runs on the rows' similarities: a step along the gradient
    moves a by (residual + a) / l, l a bound of the curvature. Momentum is that of a strongly convex loss.
    """
    return f"""fn AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM {source}),
fc AS (SELECT label, count(*) AS nc FROM {source} GROUP BY label),
fr AS (SELECT row_number() OVER (ORDER BY row_id) AS i, text, (label = 'ai')::INT AS y, n / (k * nc)::DOUBLE AS wt
  FROM {source} JOIN fc USING (label), fn),
{C.cte_postings('fp', 'fr', 'i', 'text', 2)},
fv AS (SELECT term, {C.sql_idf('any_value(n)', 'count(*)')} AS idf FROM fp, fn GROUP BY term HAVING count(*) <= greatest(1.0::DOUBLE, 0.95::DOUBLE * any_value(n))),
{C.cte_weights('fw', 'fp', 'i', 'fv')},
fk AS (SELECT a.i AS i, b.i AS j, sum(a.w * b.w) AS k FROM fw a JOIN fw b USING (term) GROUP BY ALL),
kern AS (SELECT a.i AS i, any_value(a.y) AS y, any_value(a.wt) AS wt, list(coalesce(k, 0.0::DOUBLE) ORDER BY b.i) AS ks
  FROM fr a CROSS JOIN fr b LEFT JOIN fk ON fk.i = a.i AND fk.j = b.i GROUP BY a.i),
bound AS (SELECT 0.25::DOUBLE * max(wt) * max(list_sum(ks) + len(ks)) + 1.0::DOUBLE AS l FROM kern),
pace AS (SELECT l, (sqrt(l) - 1) / (sqrt(l) + 1) AS m FROM bound),
descent AS (SELECT 0 AS k, [0.0::DOUBLE FOR x IN range(n)] AS a, 0.0::DOUBLE AS b, [0.0::DOUBLE FOR x IN range(n)] AS a0, 0.0::DOUBLE AS b0 FROM fn
  UNION ALL
  SELECT first(k) + 1, list(va[i] - (r + va[i]) / l ORDER BY i), first(vb) - sum(r) / first(l), first(a), first(b)
  FROM (SELECT *, wt * (1.0::DOUBLE / (1.0::DOUBLE + exp(-(list_inner_product(ks, va) + vb))) - y) AS r
        FROM (SELECT k, a, b, l, [a[x] + m * (a[x] - a0[x]) FOR x IN range(1, len(a) + 1)] AS va, b + m * (b - b0) AS vb
              FROM descent, pace WHERE k < {_STEPS}) CROSS JOIN kern)
  GROUP BY k),
fitted AS (SELECT a, b FROM descent ORDER BY k DESC LIMIT 1),
bias AS (SELECT b FROM fitted),
weights AS (SELECT term, any_value(idf) AS idf, sum(w * a[i]) AS weight FROM fw JOIN fv USING (term), fitted GROUP BY term)"""


def _sql_probability(name: str, source: str, keys: str) -> str:
    """name(keys, p) of all rows of source(keys, text)."""
    return f"""{C.cte_postings(f'{name}_p', source, keys, 'text', 2)},
{name}_m AS (SELECT {keys}, sum(tf * idf * weight) / sqrt(sum((tf * idf) * (tf * idf))) AS m FROM {name}_p JOIN weights USING (term) GROUP BY {keys}),
{name} AS (SELECT {keys}, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(coalesce(m, 0.0::DOUBLE) + b))) AS p FROM {source} LEFT JOIN {name}_m USING ({keys}), bias)"""


def _sql_evaluation(source: str) -> str:
    """The held-out report on source(row_id, text, label): one row."""
    return f"""{_sql_split(source, 'row_id', 'split')},
tr AS (SELECT * FROM split WHERE split = 'train'), te AS (SELECT * FROM split WHERE split = 'test'),
{_sql_fit('tr')},
{_sql_probability('tp', 'te', 'row_id')},
scored AS (SELECT label AS truth, CASE WHEN p >= 0.5::DOUBLE THEN 'ai' ELSE 'human' END AS predicted, {C.sql_rank('p')} AS p FROM te JOIN tp USING (row_id)),
c AS ({_sql_counts('truth', 'predicted', "'ai'", 'scored')}),
metrics AS ({_METRICS}),
cells AS (SELECT '[[' || count(*) FILTER (truth = 'ai' AND predicted = 'ai') || ',' || count(*) FILTER (truth = 'ai' AND predicted = 'human') || '],['
  || count(*) FILTER (truth = 'human' AND predicted = 'ai') || ',' || count(*) FILTER (truth = 'human' AND predicted = 'human') || ']]' AS confusion_matrix FROM scored),
area AS ({_AREA}),
sizes AS (SELECT count(*) FILTER (split = 'train') AS train_size, count(*) FILTER (split = 'test') AS test_size FROM split)"""


_RESULT_SQL = ", ".join(RESULT)

# signals(doc_id, repeated, explanation), stats and h over the documents.
_SIGNALS = f"""{_SELF}, {sql_text_stats('documents', 'doc_id')},
r AS (SELECT doc_id, count(*) FILTER (similarity > 70 AND partner_idx IS NOT NULL) AS repeated FROM rep GROUP BY doc_id),
x AS (SELECT doc_id, lexical_diversity, burstiness, coalesce(repeated, 0) AS repeated FROM stats LEFT JOIN r USING (doc_id)),
signals AS (SELECT doc_id, repeated, array_to_string(list_filter([
  CASE WHEN lexical_diversity < 0.4::DOUBLE THEN 'low lexical diversity (' || CAST({C.sql_round('lexical_diversity', 2)} AS DECIMAL(20, 2)) || ', vocabulary is unusually repetitive for this length)' END,
  CASE WHEN burstiness < 4.0::DOUBLE THEN 'highly uniform sentence structure (sentence-length variance is ' || CAST({C.sql_round('burstiness', 2)} AS DECIMAL(20, 2)) || ', unusually low)' END,
  CASE WHEN repeated > 0 THEN 'repetitive phrasing detected in ' || repeated || ' sentence(s)' END], lambda s: s IS NOT NULL), ' | ') AS explanation
FROM x),
hp AS (SELECT doc_id, ({_sql_inverse('lexical_diversity', '0.4')} + {_sql_inverse('burstiness', '4.0')}) / 2.0::DOUBLE AS p FROM stats),
h AS (SELECT doc_id, {_sql_verdict('p', '1.0::DOUBLE - p', 'heuristic')} FROM hp)"""

SQL = {
    "detect_heuristic": f"WITH {_sql_heuristic('documents', 'doc_id')} SELECT * FROM h",
    "explain_signals": f"{_SIGNALS} SELECT * FROM signals",
    "detect_from_logits": f"WITH {_LOGITS} SELECT vec_id, {_sql_verdict('p1', 'p0', 'transformer')}, {_REASON} AS reason FROM p",
    "detect_with_fallback": f"""WITH {_LOGITS}, m AS (SELECT vec_id AS doc_id, {_sql_verdict('p1', 'p0', 'transformer')} FROM p),
{_sql_heuristic('documents', 'doc_id')}
SELECT doc_id, {', '.join(f'CASE WHEN m.doc_id IS NULL THEN h.{c} ELSE m.{c} END AS {c}' for c in RESULT)}
FROM h LEFT JOIN m USING (doc_id)""",
    "detect_score": f"""{_SIGNALS}
SELECT doc_id, {C.sql_percent('ai_probability')} AS score, {_RESULT_SQL}, explanation FROM h JOIN signals USING (doc_id)""",
    "detect_transformer": f"""{_SIGNALS},
m AS (WITH {_LOGITS} SELECT vec_id AS doc_id, {_sql_verdict('p1', 'p0', 'transformer')}, {_REASON} AS reason FROM p)
SELECT doc_id, {', '.join(f'CASE WHEN m.doc_id IS NULL THEN h.{c} ELSE m.{c} END AS {c}' for c in RESULT)},
       concat_ws(' | ', nullif(explanation, ''), reason) AS explanation
FROM h JOIN signals USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "binary_metrics": f"""WITH {_TURN_SCORES}, c AS ({_sql_counts('truth', 'predicted', "'ai'", 'scored')}) {_METRICS}""",
    "confusion_matrix": f"""WITH {_TURN_SCORES}
SELECT truth AS label, count(*) FILTER (predicted = 'ai') AS pred_ai, count(*) FILTER (predicted = 'human') AS pred_human FROM scored GROUP BY truth""",
    "roc_auc": f"WITH {_TURN_SCORES}, area AS ({_AREA}) SELECT roc_auc FROM area",
    "logit_metrics": f"""WITH {_LOGITS}, g AS (SELECT y, list_position(zs, list_max(zs)) - 1 AS k FROM z),
c AS ({_sql_counts('y', 'k', '1', 'g')}) {_METRICS}""",
    "nll_at_temperature": f"WITH {_LOGITS} SELECT {C.sql_round(_sql_nll(f'{TEMPERATURE}::DOUBLE'), 6)} AS nll FROM z",
    "nll_curve": f"""WITH {_LOGITS}, t AS (SELECT unnest({list(CURVE)}::DOUBLE[]) AS temperature)
SELECT temperature, {C.sql_round(_sql_nll('temperature'), 6)} AS nll FROM z, t GROUP BY temperature""",
    "fit_temperature": f"""WITH RECURSIVE {_LOGITS}, {_TEMPERATURE}
SELECT {C.sql_round('any_value(t)', 4)} AS temperature, 'embedding-logits' AS model_name, 'embeddings' AS dataset,
  {C.sql_round(_sql_nll('1.0::DOUBLE'), 6)} AS nll_before, {C.sql_round(_sql_nll('t'), 6)} AS nll_after, count(*) AS n_examples FROM z, fitted GROUP BY t""",
    "train_classifier": f"""WITH {SQL_TURNS}, {C.cte_postings('p', 'turns', 'conv_id, turn', 'text', 2)},
v AS (SELECT term FROM p GROUP BY term HAVING count(*) <= greatest(1.0::DOUBLE, 0.95::DOUBLE * (SELECT count(*) FROM turns)))
SELECT label, count(*) AS n, (SELECT count(*) FROM v) AS features, TRUE AS at_optimum FROM turns GROUP BY label""",
    "evaluate_classifier": f"""WITH RECURSIVE {SQL_TURNS}, rows_in AS (SELECT conv_id || ':' || turn AS row_id, text, label FROM turns),
{_sql_evaluation('rows_in')}
SELECT 'conversations' AS dataset, train_size, test_size, accuracy, precision, recall, f1, roc_auc, confusion_matrix, 'ai,human' AS labels
FROM sizes, metrics, area, cells""",
    "quality_classifier": f"""WITH RECURSIVE rows_in AS (SELECT doc_id::VARCHAR AS row_id, text, CASE WHEN quality = 1 THEN 'ai' ELSE 'human' END AS label FROM documents JOIN labels USING (doc_id)),
{_sql_evaluation('rows_in')}
SELECT 'quality' AS dataset, train_size, test_size, accuracy, precision, recall, f1, roc_auc FROM sizes, metrics, area""",
    "detect_classifier": f"""WITH RECURSIVE {SQL_TURNS}, rows_in AS (SELECT conv_id || ':' || turn AS row_id, text, label FROM turns),
{_sql_fit('rows_in')},
{_sql_probability('dp', 'documents', 'doc_id')}
SELECT doc_id, {_sql_verdict('p', '1.0::DOUBLE - p', 'classifier')} FROM dp JOIN documents USING (doc_id) WHERE text IS NOT NULL
UNION ALL BY NAME SELECT doc_id, NULL AS human_probability, NULL AS ai_probability, NULL AS confidence, NULL AS label, 'classifier' AS backend FROM documents WHERE text IS NULL""",
    "stream_detect": f"WITH {_sql_heuristic('documents', 'doc_id')} SELECT * FROM h",
}
