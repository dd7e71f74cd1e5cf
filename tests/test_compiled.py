"""Chains of columns that the JVM can compile, and the plain forms they stand for."""

import re

import pytest

from timberline import constants as K
from timberline.functions import text as T
from timberline.operators import anomaly, deep, explain, templates
from timberline.plans import reports as R

from conftest import SF

ODD = [None, "", "  ", "a@b.co 10.0.0.1:80 /x/y.z \"q 1\" 'r'", "2024-01-15T10:00:00.5Z x 0xAF deadbeef01", "Jan  5 10:00:00 h",
       "https://x.y/z?a=1 1.5 7 7 7", "123e4567-e89b-12d3-a456-426614174000 <A> <B>  <C>", "ü 12:30 1-2 a.b \u2028 ", "a > b 3\n4\t5"]
LIMIT = 8000  # bytes; the JVM compiles no longer function


def longest(df, capsys) -> int:
    capsys.readouterr()
    df.explain(mode="codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)))


def test_functions_of_the_reports_are_short_enough(spark, capsys):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else no function exists before the run
    try:
        assert longest(templates.with_template(R.fresh_reports(spark, SF)), capsys) < LIMIT
        assert longest(R.explained(spark, SF), capsys) < LIMIT
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_no_lambda_per_row_in_scores_and_explanations(spark, capsys):
    R.fresh_reports(spark, SF).explain(mode="simple")
    explain.explain(R.reports(spark, SF)).explain(mode="simple")
    assert "lambdafunction" not in capsys.readouterr().out


def test_templates_by_stages_equal_the_expression(spark):
    rows = spark.createDataFrame([("a", i, m) for i, m in enumerate(ODD)], "file string, line_number long, message string")
    for r in templates.with_template(rows).withColumn("want", T.extract_template("message")).collect():
        assert r["template"] == r["want"], r["message"]
    assert len(K.TEMPLATE_NEEDS) == len(K.TEMPLATE_RULES)


def test_keywords_of_odd_messages(spark):
    rows = spark.createDataFrame([("a", i, m) for i, m in enumerate([None, "", "OOM and FATAL", "fatal fatal"])],
                                 "file string, line_number long, message string")
    found = {r["line_number"]: r for r in anomaly.keyword_hits(rows).collect()}
    assert found[0]["kw_hits"] == [] and found[0]["kw_conf"] is None and found[1]["kw_detail"] is None
    assert found[2]["kw_hits"] == ["fatal", "oom"] and found[2]["kw_detail"] == "Critical keywords found: fatal, oom"
    assert found[3]["kw_hits"] == ["fatal"]


def test_texts_are_filled_by_place(spark):
    kinds = [*K.EXPLANATION_TEXTS, "none", "other", None]
    rows = spark.createDataFrame(
        [("a", i, k, "HIGH", "{details}", None if i % 2 else "d {message_preview}", "m" * 120) for i, k in enumerate(kinds)],
        "file string, line_number long, anomaly_type string, severity string, log_level string, details string, message string")
    for r in explain.explain(rows).collect():
        _, causes, steps = K.EXPLANATION_TEXTS.get(r["anomaly_type"], K.EXPLANATION_DEFAULT)
        values = {"severity": "HIGH", "log_level": "{details}", "details": r["details"] or K.NO_DETAILS,
                  "message_preview": "m" * 97 + "..."}
        for texts, got in ((causes, r["possible_causes"]), (steps, r["remediation"])):
            want = []
            for t in texts:
                for name, value in values.items():
                    t = t.replace("{" + name + "}", value)
                want.append(t)
            assert got == want


def _analysed(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_templates_are_cut_off_before_they_are_joined(spark):
    """The planner puts the expression of a join key together, which for the chain of a template fills the driver."""
    entries = spark.createDataFrame([("f", i, f"lost {i} of {w}") for i, w in enumerate(["keys", "rows", "jobs"] * 3)], "file string, line_number long, message string")
    got = templates.assign_templates(entries, top_n=2)
    assert "regexp_replace" not in _analysed(got)
    assert sorted(r["template_id"] for r in got.collect()) == [0] * 3 + [1] * 3 + [2] * 3


def test_deep_explanations_join_templates_cut_off(spark, monkeypatch):
    """The rows that are joined by template later are cut before anything is made of them."""
    class Stop(Exception):
        pass

    def first_cut(df):
        assert "Filter" not in _analysed(df)
        raise Stop

    monkeypatch.setattr(deep, "cut", first_cut)
    with pytest.raises(Stop):
        deep.deep_explanations(spark.createDataFrame([("lost 1", True)], "message string, is_anomaly boolean"))
