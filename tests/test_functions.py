"""Text rendering with Python format-spec semantics."""

from pyspark.sql import functions as F

from vigil.functions.fmt import render_template, template_fields


def render(spark, template, row, schema):
    df = spark.createDataFrame([row], schema)
    return df.select(render_template(template).alias("t")).collect()[0].t


def test_specs_match_python(spark):
    schema = "a double, p double, n long, s string"
    cases = [(1234567.891, 0.855, 7, "x"), (0.005, 0.0049, 0, "y"), (2.675, 0.125, 12, "z")]
    tpl = "{a:,.2f}|{a:.2f}|{p:.0%}|{p:.1%}|{a:,.0f}|{n}|{s}"
    for a, p, n, s in cases:
        want = tpl.format(a=a, p=p, n=n, s=s)
        assert render(spark, tpl, (a, p, n, s), schema) == want


def test_null_fields_render_na(spark):
    got = render(spark, "User {u} from {loc}: ${a:,.2f}", (None, "NY", None), "u string, loc string, a double")
    assert got == "User N/A from NY: $N/A"


def test_template_fields():
    assert template_fields("x {a} {b:,.2f} {c:.0%}") == ["a", "b", "c"]
