"""Training and held-out evaluation of the text classifier.

``fit_classifier`` keeps the model in a table of terms and is what the report,
the saved model and the queries use. ``train_classifier`` builds a Spark ML
pipeline of the same features and loss for callers that want one; its
vocabulary and weights lie on the driver, so it is for vocabularies that fit.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copytrace.functions import text as T
from copytrace.functions.numeric import rank_score, sigmoid
from copytrace.functions.ranking import numbered
from copytrace.operators.evaluate import binary_metrics, confusion_matrix, roc_auc
from copytrace.operators.linear import TermModel, fit_terms, known_postings, load_terms
from copytrace.operators.split import stratified_split
from copytrace.operators.vectorize import part_of
from copytrace.session import materialize
from copytrace.sources.tables import spread


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``df`` plus ``weight`` = n / (classes * n_class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("nc"))
    totals = counts.agg(F.sum("nc").alias("n"), F.count(F.lit(1)).alias("k")).first()
    if not totals["k"]:
        return df.withColumn("weight", F.lit(1.0))
    weight = F.lit(float(totals["n"])) / (F.lit(totals["k"]) * F.col("nc"))
    return df.join(counts.select(label, weight.alias("weight")), label)


def _token_stages() -> list:
    token_sql = f"SELECT *, regexp_extract_all(lower(text), r'{T.TOKEN}', 0) AS tokens FROM __THIS__"
    return [
        SQLTransformer(statement=token_sql),
        NGram(n=2, inputCol="tokens", outputCol="bigrams"),
        SQLTransformer(statement="SELECT *, concat(tokens, bigrams) AS grams FROM __THIS__"),
    ]


def fit_features(train: DataFrame, max_df: float = 0.95) -> PipelineModel:
    """TF-IDF over uni- and bigrams, fitted on ``train`` only; unit rows."""
    n = train.count()
    tokenized = Pipeline(stages=_token_stages()).fit(train)
    rows = tokenized.transform(train)
    # The size is a limit, not an allocation: every term within max_df is kept.
    counter = CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=2**31 - 1, minDF=1.0, maxDF=max(1.0, max_df * n)).fit(rows)
    idf = IDF(inputCol="tf", outputCol="raw").fit(counter.transform(rows))
    # Spark's idf is ln((1 + n) / (1 + df)); the wanted one adds 1.
    weigh = ElementwiseProduct(scalingVec=DenseVector(idf.idf.toArray() + 1.0), inputCol="tf", outputCol="weighted")
    unit = Normalizer(p=2.0, inputCol="weighted", outputCol="features")
    drop = SQLTransformer(
        statement="SELECT * EXCEPT (tokens, bigrams, grams, tf, weighted) FROM __THIS__"
    )
    return PipelineModel(stages=[*tokenized.stages, counter, weigh, unit, drop])


def bounded_rows(labelled: DataFrame, max_rows: int) -> DataFrame:
    """All rows, or about ``max_rows`` of them chosen by a hash of row_id: for callers that want fewer, no fit here cuts its rows."""
    n = labelled.count()
    if n <= max_rows:
        return labelled
    return labelled.filter(F.pmod(F.xxhash64(F.lit("fit"), "row_id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))


def train_classifier(labelled: DataFrame, max_df: float = 0.95, c: float = 1.0, max_iter: int = 1000) -> PipelineModel:
    """Balanced L2 logistic regression on TF-IDF of all rows; ``labelled(row_id, text, label)``.

    Class 1 is ``ai``. The penalty is 1 / (c n) because Spark averages the loss.
    """
    target = (F.col("label") == "ai").cast("double")
    rows = balanced_weights(labelled).withColumn("target", target)
    rows = spread(materialize(rows, "train"), "row_id")
    features = fit_features(rows, max_df)
    n = max(1, rows.count())
    # Every pass over the data runs in as many tasks as the rows have partitions.
    matrix = features.transform(rows)
    lr = LogisticRegression(
        featuresCol="features",
        labelCol="target",
        weightCol="weight",
        regParam=1.0 / (c * n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=1e-4,
    )
    model = lr.fit(matrix)
    return PipelineModel(stages=[*features.stages, model])


def fit_classifier(labelled: DataFrame, max_df: float = 0.95, c: float = 1.0, max_iter: int = 1000) -> TermModel:
    """Balanced L2 logistic regression on TF-IDF of all rows; ``labelled(row_id, text, label)``, class 1 is ``ai``."""
    target = (F.col("label") == "ai").cast("double")
    rows = balanced_weights(labelled).withColumn("target", target)
    return fit_terms(spread(rows, "row_id"), max_df, c, max_iter)


def largest_slope(model: TermModel, labelled: DataFrame, c: float = 1.0) -> float:
    """Largest derivative, by a weight or the intercept, of the loss that ``fit_classifier`` minimises: 0 at the optimum."""
    target = (F.col("label") == "ai").cast("double")
    rows = numbered(balanced_weights(labelled).select("text", "weight", target.alias("target")), "id", "slope-rows")
    post, parts = known_postings(rows.select("id", "text"), model.terms.withColumnRenamed("weight", "slope_weight"), "id", ["idf", "slope_weight"])
    x = F.col("tf") * F.col("idf")
    sums = post.groupBy("part", "id").agg(F.sum(x * F.col("slope_weight")).alias("dot"), F.sqrt(F.sum(x * x)).alias("norm"))
    p = sigmoid(F.coalesce(F.col("dot") / F.col("norm"), F.lit(0.0)) + F.lit(model.intercept))
    residual = (F.col("weight") * (p - F.col("target"))).alias("residual")
    rows = materialize(rows.join(sums.drop("part"), "id", "left").select("id", "norm", residual), "slope-residuals")
    dealt = rows.select(part_of(parts, "id").alias("part"), "*").repartitionById(parts, F.col("part"))
    by_term = post.join(dealt.hint("shuffle_hash"), ["part", "id"]).groupBy("term", "slope_weight").agg(F.sum(x / F.col("norm") * F.col("residual")).alias("sum"))
    steepest = by_term.agg(F.max(F.abs(F.col("sum") + F.col("slope_weight") / c))).first()[0]
    return max(steepest or 0.0, abs(rows.agg(F.sum("residual")).first()[0] or 0.0))


def predict(model: TermModel | PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` plus ai_probability and predicted."""
    p = model.transform(df)
    if isinstance(model, PipelineModel):
        p = p.withColumn("ai_probability", vector_to_array("probability")[1])
    predicted = F.when(F.col("ai_probability") >= 0.5, "ai").otherwise("human")
    return p.select(*df.columns, "ai_probability", predicted.alias("predicted"))


def evaluate_classifier(labelled: DataFrame, dataset: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """One-row held-out report: sizes, metrics, labels, confusion matrix."""
    split = materialize(stratified_split(labelled, ["row_id"], "label", test_size, seed), "split")
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    scored = materialize(predict(fit_classifier(train.drop("split")), test), "scored")
    sizes = split.agg(
        F.count_if(F.col("split") == "train").alias("train_size"), F.count_if(F.col("split") == "test").alias("test_size")
    )
    classes = ["ai", "human"]
    cm = confusion_matrix(scored, classes).select("label", F.array(*[f"pred_{c}" for c in classes]).alias("r"))
    matrix = cm.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "r"))), lambda x: x["r"]).alias("confusion_matrix"))
    parts = [sizes, binary_metrics(scored).drop("n"), roc_auc(scored.withColumn("score", rank_score(F.col("ai_probability"))), "score"), matrix]
    report = sizes.sparkSession.range(1).select(F.lit(1).alias("one"), F.lit(dataset).alias("dataset"))
    for part in parts:  # one row each
        report = report.join(part.withColumn("one", F.lit(1)), "one")
    return report.withColumn("labels", F.array(*[F.lit(c) for c in classes])).drop("one")


def ship_classifier(labelled: DataFrame, path: str) -> TermModel:
    """Refit on all rows and save."""
    model = fit_classifier(labelled)
    model.save(path)
    return model


def load_classifier(spark: SparkSession, path: str) -> TermModel | None:
    """Saved model, or None when there is none."""
    return load_terms(spark, path)
