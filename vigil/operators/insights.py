"""Insights rendered from window metrics.

Everything is a projection over the metrics table (one row per window), so
insights for many windows are one narrow stage (I7).  The text-model prompt
is rendered as a column (I5) and a model's JSON reply, if one is supplied, is
parsed with a template fallback (I6).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.fmt import NA, render_template
from vigil.functions.time import iso_text
from vigil.schemas import (INSIGHT_FINDING_TEMPLATES, INSIGHT_RECOMMENDATIONS, INSIGHT_TEXT_TEMPLATE,
                           RISK_DEFAULT, RISK_LEVELS, TEMPLATE_MODEL, USER_PROMPT_TEMPLATE)

METRIC_FIELDS = ["total_transactions", "total_amount", "avg_amount", "max_amount", "min_amount",
                 "unique_users", "fraud_count", "fraud_rate"]

RESPONSE_SCHEMA = T.StructType([
    T.StructField("insight_text", T.StringType()),
    T.StructField("key_findings", T.ArrayType(T.StringType())),
    T.StructField("recommendations", T.ArrayType(T.StringType())),
    T.StructField("risk_level", T.StringType()),
])


def risk_level(rate: Column) -> Column:
    """Strict ``>`` cut-offs, highest first."""
    r = F.coalesce(rate.cast("double"), F.lit(0.0))
    out = None
    for cut, name in RISK_LEVELS:
        out = F.when(r > F.lit(cut), F.lit(name)) if out is None else out.when(r > F.lit(cut), F.lit(name))
    return out.otherwise(F.lit(RISK_DEFAULT))


def peak_device(device_map: Column) -> Column:
    """First key of the count-desc device map, or 'N/A' when empty."""
    return F.coalesce(F.try_element_at(F.map_keys(device_map), F.lit(1)), F.lit(NA))


def py_json_map(m: Column) -> Column:
    """``json.dumps(dict)`` text of an ordered map: ``{"k": v, …}``."""
    esc = lambda s: F.regexp_replace(F.regexp_replace(s, r"\\", r"\\\\"), '"', '\\\\"')
    body = F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(
        F.lit('"'), esc(e["key"]), F.lit('": '), e["value"].cast("string"))), ", ")
    return F.concat(F.lit("{"), F.coalesce(body, F.lit("")), F.lit("}"))


def template_insights(metrics: DataFrame, start_col: str = "window_start",
                      end_col: str = "window_end") -> DataFrame:
    """One insight record per metrics row."""
    m = metrics.withColumn("risk_level", risk_level(F.col("fraud_rate")))
    if "device_breakdown" in m.columns:
        m = m.withColumn("peak_device", peak_device(F.col("device_breakdown")))
    else:
        m = m.withColumn("peak_device", F.lit(NA))
    raw = F.to_json(F.struct(iso_text(F.col(start_col)).alias("window_start"),
                             iso_text(F.col(end_col)).alias("window_end"),
                             *[F.col(c) for c in METRIC_FIELDS if c in m.columns]))
    return m.select(
        F.sha2(F.concat_ws("|", iso_text(F.col(start_col)), iso_text(F.col(end_col))), 256).alias("insight_id"),
        F.col(start_col).alias("window_start"), F.col(end_col).alias("window_end"),
        render_template(INSIGHT_TEXT_TEMPLATE).alias("insight_text"),
        F.array(*[render_template(t) for t in INSIGHT_FINDING_TEMPLATES]).alias("key_findings"),
        F.array(*[F.lit(r) for r in INSIGHT_RECOMMENDATIONS]).alias("recommendations"),
        F.col("risk_level"),
        F.lit(TEMPLATE_MODEL).alias("model_used"),
        raw.alias("raw_metrics"),
    )


def insight_prompts(metrics: DataFrame, start_col: str = "window_start",
                    end_col: str = "window_end") -> DataFrame:
    """The model prompt for each window (breakdowns as JSON text)."""
    cols = {"window_start": F.coalesce(iso_text(F.col(start_col)), F.lit(NA)),
            "window_end": F.coalesce(iso_text(F.col(end_col)), F.lit(NA))}
    for c in ["event_type_breakdown", "device_breakdown", "location_breakdown"]:
        cols[c] = py_json_map(F.col(c)) if c in metrics.columns else F.lit("{}")
    return metrics.select(F.col(start_col).alias("window_start"),
                          render_template(USER_PROMPT_TEMPLATE, cols).alias("prompt"))


def apply_model_response(insights: DataFrame, response_col: str = "model_response",
                         model_name: str = "external") -> DataFrame:
    """Take a model's JSON reply where it parses, else keep the template.

    Parsing is per row; a malformed reply falls back for that row only.
    """
    resp = F.trim(F.regexp_replace(F.col(response_col), r"^\s+", ""))
    valid = F.get_json_object(resp, "$").isNotNull() & resp.startswith("{")
    p = F.from_json(resp, RESPONSE_SCHEMA)
    # A key that the reply lacks keeps the template's value.
    pick = lambda field: F.when(valid, F.coalesce(p[field], F.col(field))).otherwise(F.col(field))
    return insights.withColumns({
        "insight_text": pick("insight_text"),
        "key_findings": pick("key_findings"),
        "recommendations": pick("recommendations"),
        "risk_level": pick("risk_level"),
        "model_used": F.when(valid, F.lit(model_name)).otherwise(F.col("model_used")),
    }).drop(response_col)
