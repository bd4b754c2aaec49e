"""ML pipeline (M1–M18) on a small rule-labelled frame."""

import random

from pyspark.sql import functions as F

from vigil.operators import ml as ML

COLS = ("event_id string, transaction_amount double, hour_of_day int, day_of_week int, is_weekend int, "
        "is_night int, device_type string, event_type string, location string, txn_count_1h long, "
        "avg_amount_1h double, max_amount_1h double, failed_attempts_1h long, unique_locations_1h long, label int")


def labelled(spark, n=600, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        fraud = rnd.random() < 0.15
        amt = rnd.uniform(5000, 50000) if fraud else rnd.uniform(5, 600)
        rows.append((f"e{i}", amt, rnd.choice([1, 2, 3]) if fraud else rnd.randint(6, 22), rnd.randint(0, 6),
                     rnd.randint(0, 1), 1 if fraud else 0, rnd.choice(["api", "mobile"]) if fraud else
                     rnd.choice(["mobile", "desktop", "tablet"]), rnd.choice(["transfer", "withdrawal"]) if fraud
                     else rnd.choice(["purchase", "login"]), rnd.choice(["Unknown", "VPN"]) if fraud else
                     rnd.choice(["New York", "Chicago"]), rnd.randint(10, 20) if fraud else rnd.randint(0, 4),
                     amt, amt, rnd.randint(5, 10) if fraud else rnd.randint(0, 1),
                     rnd.randint(3, 9) if fraud else 1, int(fraud)))
    return spark.createDataFrame(rows, COLS)


def test_feature_encoding_sorted_and_unseen(spark):
    train = labelled(spark, 50)
    new = train.limit(1).withColumn("device_type", F.lit("smartwatch")).withColumn("location", F.lit("Mars"))
    out = ML.encode_features(train, new).collect()[0]
    assert out.device_type_enc == 0.0 and out.location_enc == 0.0       # unseen -> class 0
    enc = ML.encode_features(train).select("device_type", "device_type_enc").distinct().collect()
    order = sorted(enc, key=lambda r: r.device_type_enc)
    assert [r.device_type for r in order] == sorted(r.device_type for r in enc)
    assert len(ML.feature_columns()) == 16


def test_derived_features(spark):
    df = spark.createDataFrame([(100.0, 0.0, 0, 0), (100.0, 50.0, 4, 2)],
                               "transaction_amount double, avg_amount_1h double, txn_count_1h long, "
                               "failed_attempts_1h long")
    r = ML.derived_features(df).collect()
    assert r[0].amount_vs_avg_ratio == 1.0 and r[0].fail_rate == 0.0
    assert r[1].amount_vs_avg_ratio == 2.0 and r[1].fail_rate == 0.5


def test_train_score_and_metrics(spark, tmp_path):
    df = labelled(spark)
    model, metrics = ML.train_and_save(df, str(tmp_path / "model"), params=ML.GBTParams(max_iter=15, max_depth=3))
    m = metrics.collect()[0]
    assert m.roc_auc > 0.5 and m.train_size + m.test_size == 600
    loaded = ML.load_model(str(tmp_path / "model"))
    pair = df.filter("event_id in ('e0', 'e1')").limit(0).unionByName(
        df.filter("label = 1").limit(1)).unionByName(df.filter("label = 0").limit(1))
    scored = ML.score(loaded, pair, keep=["label"]).collect()
    p = {r.label: r.fraud_probability for r in scored}
    assert p[1] > p[0]
    for r in scored:
        assert r.is_fraud == (r.fraud_probability >= 0.5) and abs(r.confidence - max(r.fraud_probability, 1 - r.fraud_probability)) < 1e-4


def test_missing_input_scores_zero(spark, tmp_path):
    df = labelled(spark, 200)
    model = ML.fit_model(df, params=ML.GBTParams(max_iter=5, max_depth=3))
    bad = df.limit(1).withColumn("txn_count_1h", F.lit(None).cast("long"))
    r = ML.score(model, bad, keep=[]).collect()[0]
    assert (r.fraud_probability, r.is_fraud, r.confidence) == (0.0, False, 0.0)


def test_stratified_split_and_folds(spark):
    df = labelled(spark, 1000)
    train, test = ML.stratified_split(df)
    by = {(r.label): r["count"] for r in test.groupBy("label").count().collect()}
    tot = {(r.label): r["count"] for r in df.groupBy("label").count().collect()}
    for lab in tot:
        assert abs(by[lab] / tot[lab] - 0.2) < 0.03
    assert train.count() + test.count() == 1000
    folds = ML.stratified_folds(df, 5).groupBy("fold").count().collect()
    assert sorted(r.fold for r in folds) == [0, 1, 2, 3, 4]
    assert all(abs(r["count"] - 200) < 25 for r in folds)


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_and_confusion_match_brute_force(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "label int, score double")
    assert abs(ML.roc_auc(df).collect()[0].roc_auc - brute_auc(pairs)) < 1e-12
    pred = df.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    m = ML.classification_metrics(pred).collect()[0]
    tp = sum(1 for y, s in pairs if y == 1 and s >= 0.5)
    fp = sum(1 for y, s in pairs if y == 0 and s >= 0.5)
    assert (m.tp, m.fp) == (tp, fp)
    conf = {r.label: (r.pred_0, r.pred_1) for r in ML.confusion_counts(pred).collect()}
    assert conf[0][1] == fp and conf[1][1] == tp
    rep = {r["class"]: r.support for r in ML.classification_report(pred).collect()}
    assert rep[1] == sum(1 for y, _ in pairs if y == 1)


def test_cross_validated_auc(spark):
    r = ML.cross_validated_auc(labelled(spark, 400), k=3, params=ML.GBTParams(max_iter=5, max_depth=3)).collect()[0]
    assert r.folds == 3 and r.cv_roc_auc_mean > 0.5 and r.cv_roc_auc_std >= 0.0


def test_fixed_model_equals_mllib(spark, tmp_path):
    """A fitted pipeline written down, saved and read gives the pipeline's scores: nulls, unseen classes, missing columns."""
    from vigil.operators import fixed_model as FM
    train = labelled(spark)
    model = ML.fit_model(train, "label", ML.GBTParams(max_iter=5, max_depth=4))
    path = str(tmp_path / "model.json")
    FM.save_spec(FM.model_spec(model), path)
    odd = train.withColumns({
        "transaction_amount": F.when(F.col("hour_of_day") != 8, F.col("transaction_amount")),
        "device_type": F.when(F.col("day_of_week") == 1, F.lit("smartwatch")).when(F.col("day_of_week") != 2, F.col("device_type"))})
    for rows in (train, odd, train.drop("location", "is_night"), train.limit(0)):
        want = ML.score(model, rows, keep=["event_id"])
        got = FM.score_fixed(rows, FM.load_spec(path), keep=["event_id"])
        assert got.columns == want.columns
        assert sorted(got.collect()) == sorted(want.collect())
    assert FM.score_fixed(odd, FM.load_spec(path)).filter("fraud_probability = 0 and not is_fraud and confidence = 0").count() \
        >= odd.filter("transaction_amount is null").count() > 0


def test_training_rows_are_dealt_evenly(spark):
    """A frame in a few partitions of any size fills all task slots, keeps every row, and repeats itself; a small one stays as it is."""
    big = spark.range(0, ML.DEAL_FROM, 1, 1).withColumn("x", F.rand(3)).unionByName(spark.range(3).withColumn("x", F.lit(0.5)))
    slots = spark.sparkContext.defaultParallelism
    dealt = ML.checkpoint_dealt(big, ML.DEAL_FROM + 3)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) % slots == 0 and max(sizes) - min(sizes) <= 2 * big.rdd.getNumPartitions()
    assert dealt.exceptAll(big).isEmpty() and dealt.count() == ML.DEAL_FROM + 3
    ids = lambda d: d.select(F.spark_partition_id(), F.monotonically_increasing_id(), "id")
    assert ids(dealt).exceptAll(ids(ML.checkpoint_dealt(big, ML.DEAL_FROM + 3))).isEmpty()
    few = big.filter("id < 1000").coalesce(1)
    assert ML.checkpoint_dealt(few, 1000).rdd.getNumPartitions() == 1
