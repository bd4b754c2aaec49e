"""Features, training, evaluation and scoring with MLlib.

The model is a ``PipelineModel``: label encoding (StringIndexer, sorted
classes, unseen -> class 0), derived features (SQLTransformer), vector
assembly, standardisation and gradient-boosted trees.  Encoders and the
scaler are fitted on the training split only.  The same fitted model scores
batch and streaming frames with ``transform``.

Splits and folds follow each row's exact rank by the MD5 of its id within its
label.  Ranks are counted per (label, first bits of the hash), so a label's
rows are never gathered into one task and membership does not depend on the
cluster's layout.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.numeric import py_round
from vigil.operators.summary import round_to
from vigil.schemas import CATEGORICAL, DERIVED_FEATURES, MODEL_INPUTS
from vigil.session import ensure_checkpoint_dir

# ---------------------------------------------------------------------------
# M1–M6: features
# ---------------------------------------------------------------------------

DERIVED_SQL = """
SELECT *,
  log1p(transaction_amount) AS log_amount,
  CASE WHEN avg_amount_1h > 0 THEN transaction_amount / avg_amount_1h ELSE 1.0 END AS amount_vs_avg_ratio,
  failed_attempts_1h / CASE WHEN txn_count_1h = 0 THEN 1 ELSE txn_count_1h END AS fail_rate
FROM __THIS__"""


def derived_features(df: DataFrame) -> DataFrame:
    """M3–M5 as plain columns (same expressions as the pipeline stage)."""
    cnt = F.col("txn_count_1h")
    return df.withColumns({
        "log_amount": F.log1p(F.col("transaction_amount")),
        "amount_vs_avg_ratio": F.when(F.col("avg_amount_1h") > 0,
                                      F.col("transaction_amount") / F.col("avg_amount_1h")).otherwise(F.lit(1.0)),
        "fail_rate": F.col("failed_attempts_1h") / F.when(cnt == 0, F.lit(1)).otherwise(cnt),
    })


def with_missing_inputs(df: DataFrame) -> DataFrame:
    """Absent categorical columns become 'unknown', other absent
    inputs 0."""
    add = {}
    for c in MODEL_INPUTS:
        if c not in df.columns:
            add[c] = F.lit("unknown") if c in CATEGORICAL else F.lit(0)
    return df.withColumns(add) if add else df


def _encoded(c: str) -> str:
    return f"{c}_enc"


def fit_encoders(df: DataFrame, cols: list[str] = CATEGORICAL):
    """M1: sorted-class indexers; returns the fitted model and an SQL stage
    mapping unseen values (index == number of classes) to class 0 (M2)."""
    idx = StringIndexer(inputCols=cols, outputCols=[f"{c}_idx" for c in cols],
                        stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
    sizes = {c: len(labels) for c, labels in zip(cols, idx.labelsArray)}
    cases = ", ".join(f"CASE WHEN {c}_idx >= {sizes[c]} THEN 0.0 ELSE {c}_idx END AS {_encoded(c)}"
                      for c in cols)
    return idx, SQLTransformer(statement=f"SELECT *, {cases} FROM __THIS__")


def feature_columns() -> list[str]:
    """M6: 13 inputs (categoricals encoded) then 3 derived = 16."""
    return [_encoded(c) if c in CATEGORICAL else c for c in MODEL_INPUTS] + DERIVED_FEATURES


def encode_features(train: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """M1–M5 on ``df`` with encoders fitted on ``train`` (plain columns)."""
    train = with_missing_inputs(train)
    idx, unseen = fit_encoders(train)
    out = unseen.transform(idx.transform(with_missing_inputs(df if df is not None else train)))
    return derived_features(out)


# ---------------------------------------------------------------------------
# Stratified split and folds
# ---------------------------------------------------------------------------

HASH_BUCKETS = 1 << 12


def stratified_rank(df: DataFrame, label_col: str, id_col: str, seed: int = 42) -> DataFrame:
    """``df`` with _rank (0 up, by the MD5 of seed and id within the label) and _n (rows of the label).

    A row's rank is the count of its label's rows in lower hash buckets (a
    small table: labels x buckets) plus its place in its own bucket.
    """
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = df.withColumn("_h", F.md5(text)).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    per_bucket = h.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(label_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(F.col(label_col).alias("_l"), F.col("_b").alias("_lb"),
                                F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
                                F.sum("_c").over(Window.partitionBy(label_col)).alias("_n"))
    place = F.row_number().over(Window.partitionBy(label_col, "_b").orderBy("_h", id_col)) - 1
    return (h.withColumn("_place", place)
             .join(offsets, F.col(label_col).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_lb")))
             .withColumn("_rank", F.col("_before") + F.col("_place"))
             .drop("_h", "_b", "_l", "_lb", "_before", "_place"))


def stratified_split(df: DataFrame, label_col: str = "label", id_col: str = "event_id",
                     test_fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M8: (train, test); each label's first ``round(n * test_fraction)`` rows by rank are the test set."""
    ranked = stratified_rank(df, label_col, id_col, seed)
    test = F.col("_rank") < F.floor(F.col("_n") * F.lit(test_fraction) + F.lit(0.5))
    return ranked.filter(~test).drop("_rank", "_n"), ranked.filter(test).drop("_rank", "_n")


def stratified_folds(df: DataFrame, k: int = 5, label_col: str = "label", id_col: str = "event_id",
                     seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """Fold id 0..k-1, k equal ranges of the rank within the label."""
    ranked = stratified_rank(df, label_col, id_col, seed)
    return ranked.withColumn(fold_col, F.floor(F.col("_rank") * F.lit(k) / F.col("_n")).cast("int")).drop("_rank", "_n")


# ---------------------------------------------------------------------------
# training
# ---------------------------------------------------------------------------

@dataclass
class GBTParams:
    max_iter: int = 200
    max_depth: int = 6
    step_size: float = 0.1
    subsampling_rate: float = 0.8
    feature_subset: str = "0.8"
    positive_weight: float = 11.0
    seed: int = 42
    extra: dict = field(default_factory=dict)


FALLBACK_PARAMS = GBTParams(max_iter=100, max_depth=5, feature_subset="all", positive_weight=1.0)


DEAL_FROM, DEALT_ROWS, WAVES = 200_000, 1_000_000, 2


def checkpoint_dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (of about ``rows`` rows) checkpointed in even partitions, whole waves of the task slots.

    Boosting passes over its rows once for each level of each tree, a task for each partition.  A join leaves partitions
    by size, often one more than there are slots, so that a pass takes two waves and half of the cores wait.  Rows are
    dealt in turn and sorted by content, which makes the trees' subsamples the same in each run.  Small frames are not
    dealt: jobs, not rows, take their time.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if rows < DEAL_FROM:
        return df.checkpoint()
    slots = spark.sparkContext.defaultParallelism
    waves = max(WAVES, -(-rows // (slots * DEALT_ROWS)))
    return df.repartition(slots * waves).sortWithinPartitions(F.xxhash64(*df.columns)).checkpoint()


def with_weights(df: DataFrame, label_col: str, positive_weight: float) -> DataFrame:
    return df.withColumn("weight", F.when(F.col(label_col) == 1, F.lit(positive_weight)).otherwise(F.lit(1.0)))


def fit_model(train: DataFrame, label_col: str = "label", params: GBTParams | None = None) -> PipelineModel:
    """M7 + M9: fit encoders, scaler and trees on ``train`` only."""
    p = params or GBTParams()
    train = with_weights(with_missing_inputs(train), label_col, p.positive_weight)
    idx, unseen = fit_encoders(train)
    gbt = GBTClassifier(featuresCol="features", labelCol=label_col, weightCol="weight",
                        maxIter=p.max_iter, maxDepth=p.max_depth, stepSize=p.step_size,
                        subsamplingRate=p.subsampling_rate, featureSubsetStrategy=p.feature_subset,
                        seed=p.seed, **p.extra)
    stages = [SQLTransformer(statement=DERIVED_SQL),
              VectorAssembler(inputCols=feature_columns(), outputCol="raw_features", handleInvalid="keep"),
              StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
              gbt]
    encoded = unseen.transform(idx.transform(train))
    rest = Pipeline(stages=stages).fit(encoded)
    return PipelineModel(stages=[idx, unseen] + rest.stages)


def save_model(model: PipelineModel, path: str) -> None:
    """Persist the whole pipeline (encoders, scaler, trees)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---------------------------------------------------------------------------
# scoring
# ---------------------------------------------------------------------------

def score(model: PipelineModel, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """fraud_probability (4 dp), is_fraud (p >= .5 before rounding),
    confidence = max(p, 1-p) (4 dp).  Rows missing a numeric input score
    0 / false / 0 (M17)."""
    base = with_missing_inputs(df)
    numeric = [c for c in MODEL_INPUTS if c not in CATEGORICAL]
    valid = F.lit(True)
    for c in numeric:
        valid = valid & F.col(c).isNotNull()
    out = model.transform(base.withColumn("_valid", valid))
    p = vector_to_array(F.col("probability"))[1]
    keep = keep if keep is not None else df.columns
    return out.select(
        *keep,
        F.when(F.col("_valid"), py_round(p, 4)).otherwise(F.lit(0.0)).alias("fraud_probability"),
        F.when(F.col("_valid"), p >= F.lit(0.5)).otherwise(F.lit(False)).alias("is_fraud"),
        F.when(F.col("_valid"), py_round(F.greatest(p, F.lit(1.0) - p), 4))
         .otherwise(F.lit(0.0)).alias("confidence"),
    )


# ---------------------------------------------------------------------------
# evaluation
# ---------------------------------------------------------------------------

def roc_auc(df: DataFrame, label_col: str = "label", score_col: str = "score") -> DataFrame:
    """Exact ROC-AUC of the raw scores (ties count one half; rows without a score are left out).

    Rows are reduced to one per distinct score, range-partitioned by score and
    checkpointed; a running count inside each range plus the counts of the
    ranges below (one row per partition) gives the negatives below a score.
    """
    y = F.col(label_col).cast("int")
    g = (df.select(F.col(score_col).cast("double").alias("s"), y.alias("y")).filter("s is not null")
           .groupBy("s").agg(F.sum("y").cast("long").alias("pos"), F.sum(F.lit(1) - F.col("y")).cast("long").alias("neg"))
           .repartitionByRange("s").withColumn("_p", F.spark_partition_id()).checkpoint())
    ranges = g.groupBy("_p").agg(F.sum("neg").alias("_neg"))
    lower = ranges.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_neg").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lower"))
    inside = Window.partitionBy("_p").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    exact = "decimal(38,0)"
    g = (g.withColumn("_inside", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
          .join(F.broadcast(lower), F.col("_p") == F.col("_q"))
          .withColumn("_below", (F.col("_lower") + F.col("_inside")).cast("decimal(18,0)")))
    pos, neg = F.col("pos").cast("decimal(18,0)"), F.col("neg").cast("decimal(18,0)")
    wins, ties = F.sum((pos * F.col("_below")).cast(exact)), F.sum((pos * neg).cast(exact))
    return g.agg(
        ((wins.cast("double") + ties.cast("double") / F.lit(2.0))
         / (F.sum("pos").cast("double") * F.sum("neg").cast("double"))).alias("roc_auc"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def confusion_counts(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """One row per true label with predicted-0 / predicted-1 counts."""
    y, p = F.col(label_col).cast("int"), F.col(pred_col).cast("int")
    return df.groupBy(y.alias("label")).agg(
        F.sum((p == 0).cast("long")).alias("pred_0"), F.sum((p == 1).cast("long")).alias("pred_1"))


def classification_metrics(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """Precision, recall, F1 (0 when undefined), sizes and positive rate
    from the four confusion counts (one global partial aggregate)."""
    y, p = F.col(label_col).cast("int"), F.col(pred_col).cast("int")
    c = df.agg(F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
               F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
               F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
               F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(F.lit(2) * tp + fp + fn > 0, F.lit(2.0) * tp / (F.lit(2) * tp + fp + fn)).otherwise(F.lit(0.0))
    n = tp + fp + fn + tn
    return c.select("tp", "fp", "fn", "tn",
                    round_to(prec, 4).alias("precision"), round_to(rec, 4).alias("recall"),
                    round_to(f1, 4).alias("f1"), n.alias("size"),
                    round_to((tp + fn) / n, 4).alias("positive_rate"))


def classification_report(df: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """Per-class precision / recall / F1 / support."""
    rows = []
    for cls in (0, 1):
        y = (F.col(label_col).cast("int") == cls).cast("int")
        p = (F.col(pred_col).cast("int") == cls).cast("int")
        rows.append(classification_metrics(df.select(y.alias("y"), p.alias("p")), "y", "p")
                    .select(F.lit(cls).alias("class"), "precision", "recall", "f1",
                            (F.col("tp") + F.col("fn")).alias("support")))
    return rows[0].unionByName(rows[1])


def evaluate(model: PipelineModel, test: DataFrame, label_col: str = "label") -> DataFrame:
    """M11–M12 on a held-out frame: one metrics row."""
    scored = model.transform(with_missing_inputs(test)).select(
        F.col(label_col).alias("label"), vector_to_array("probability")[1].alias("score"),
        F.col("prediction"))
    auc = roc_auc(scored, "label", "score").select("roc_auc")
    return one_row_join(classification_metrics(scored, "label", "prediction"), auc)


def one_row_join(*frames: DataFrame) -> DataFrame:
    """Put single-row aggregates side by side (equi-join on a constant key)."""
    out = frames[0].withColumn("_k", F.lit(1))
    for f in frames[1:]:
        out = out.join(f.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def cross_validated_auc(df: DataFrame, k: int = 5, label_col: str = "label", id_col: str = "event_id",
                        params: GBTParams | None = None, seed: int = 42) -> DataFrame:
    """K-fold stratified AUC, mean and population std.

    Each fold is a distributed fit; the folds run side by side, and only the
    k metric values meet on the driver, as a k-row frame.
    """
    folded = checkpoint_dealt(stratified_folds(df, k, label_col, id_col, seed), df.count())

    def one_fold(i: int) -> tuple[int, float]:
        m = fit_model(folded.filter(F.col("fold") != i), label_col, params)
        held = m.transform(with_missing_inputs(folded.filter(F.col("fold") == i))).select(
            F.col(label_col).alias("label"), vector_to_array("probability")[1].alias("score"))
        return i, float(roc_auc(held, "label", "score").first()["roc_auc"])
    spark = df.sparkSession
    with ThreadPool(k) as pool:
        aucs = pool.map(inheritable_thread_target(spark)(one_fold), range(k))
    per_fold = spark.createDataFrame(aucs, "fold int, roc_auc double")
    return per_fold.agg(round_to(F.avg("roc_auc"), 4).alias("cv_roc_auc_mean"),
                        round_to(F.stddev_pop("roc_auc"), 4).alias("cv_roc_auc_std"),
                        F.count(F.lit(1)).alias("folds"))


def train_and_save(df: DataFrame, path: str, label_col: str = "label", id_col: str = "event_id",
                   params: GBTParams | None = None,
                   model: PipelineModel | None = None) -> tuple[PipelineModel, DataFrame]:
    """Split, fit, evaluate, save; returns the model and its metrics row.
    ``model``: one already fitted on this training split."""
    train, test = stratified_split(df, label_col, id_col)
    model = model or fit_model(checkpoint_dealt(train, df.count()), label_col, params)
    save_model(model, path)
    return model, one_row_join(evaluate(model, test, label_col),
                               train.agg(F.count(F.lit(1)).alias("train_size")),
                               test.agg(F.count(F.lit(1)).alias("test_size")),
                               df.agg(round_to(F.avg(F.col(label_col).cast("double")), 4)
                                      .alias("fraud_rate")))   # A16
