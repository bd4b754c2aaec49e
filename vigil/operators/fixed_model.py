"""M6, M7, M15–M17 from a fitted model written down as plain numbers.

``model_spec`` reads a fitted pipeline (encoders, scaler, trees) into a small
JSON-able record; ``score_fixed`` evaluates such a record as one narrow
projection of built-in columns: nested conditions per tree, no MLlib stage,
no Python, nothing broadcast.  It serves models of up to a few thousand nodes
(the expression is compiled with the query); larger ones are scored by
``ml.score``, whose results it equals.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import add

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.numeric import py_round
from vigil.operators.ml import derived_features, feature_columns, with_missing_inputs
from vigil.schemas import CATEGORICAL, MODEL_INPUTS


def _node(n):
    """A tree as ``[feature, threshold, left, right]`` or a leaf's value."""
    if n.subtreeDepth() == 0:
        return float(n.prediction())
    split = n.split()
    if not split.getClass().getSimpleName().startswith("Continuous"):
        raise ValueError("only splits at thresholds can be written down")
    return [split.featureIndex(), float(split.threshold()), _node(n.leftChild()), _node(n.rightChild())]


def model_spec(model: PipelineModel) -> dict:
    """Encoders' classes, scaler and trees of a pipeline of ``ml.fit_model``."""
    idx, scaler, gbt = model.stages[0], model.stages[-2], model.stages[-1]
    return {
        "classes": {c: list(labels) for c, labels in zip(CATEGORICAL, idx.labelsArray)},
        "mean": [float(x) for x in scaler.mean],
        "std": [float(x) for x in scaler.std],
        "weights": [float(w) for w in gbt.treeWeights],
        "trees": [_node(t._call_java("rootNode")) for t in gbt.trees],
    }


def save_spec(spec: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(spec, f, indent=None, separators=(",", ":"))


def load_spec(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def _class_number(c: str, classes: list[str]) -> Column:
    """M1/M2: place among the sorted classes; unseen and null are class 0."""
    out = F.lit(0.0)
    for k in range(len(classes) - 1, 0, -1):
        out = F.when(F.col(c) == F.lit(classes[k]), F.lit(float(k))).otherwise(out)
    return out


def scaled_features(df: DataFrame, spec: dict) -> DataFrame:
    """M6 + M7: ``df`` with ``features``, the 16 scaled inputs as an array; a
    missing number stays null, an input without spread is 0."""
    enc = derived_features(df).withColumns({f"{c}_enc": _class_number(c, spec["classes"][c]) for c in CATEGORICAL})
    scaled = [(F.col(c).cast("double") - F.lit(m)) * F.lit(1.0 / s if s else 0.0)
              for c, m, s in zip(feature_columns(), spec["mean"], spec["std"])]
    return enc.select(*df.columns, F.array(*scaled).alias("features"))


def _tree(node, x: list[Column]) -> Column:
    if not isinstance(node, list):
        return F.lit(node)
    feature, threshold, left, right = node
    return F.when(x[feature] <= F.lit(threshold), _tree(left, x)).otherwise(_tree(right, x))


def score_fixed(df: DataFrame, spec: dict, keep: list[str] | None = None) -> DataFrame:
    """M15–M17, the columns of ``ml.score``: probability (4 dp), flag (p >= .5
    before rounding), confidence (4 dp); 0 / false / 0 where a number is
    missing."""
    keep = keep if keep is not None else df.columns
    base = with_missing_inputs(df)
    valid = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in MODEL_INPUTS if c not in CATEGORICAL])
    rows = scaled_features(base.withColumn("_valid", valid), spec)
    x = [F.col("features")[i] for i in range(len(spec["mean"]))]
    margin = reduce(add, [F.lit(w) * _tree(t, x) for w, t in zip(spec["weights"], spec["trees"])])
    p = F.col("_p")
    rows = rows.withColumn("_p", F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin)))
    return rows.select(
        *keep,
        F.when(F.col("_valid"), py_round(p, 4)).otherwise(F.lit(0.0)).alias("fraud_probability"),
        F.when(F.col("_valid"), p >= F.lit(0.5)).otherwise(F.lit(False)).alias("is_fraud"),
        F.when(F.col("_valid"), py_round(F.greatest(p, F.lit(1.0) - p), 4)).otherwise(F.lit(0.0)).alias("confidence"),
    )
