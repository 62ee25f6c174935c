import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from tenuria.operators import explain, interventions, leakage, quality, splits
from tenuria.operators.intervention_rules import rule_rows

P = "2024-01-01"


def found(spark, data, schema, features):
    df = spark.createDataFrame(data, schema)
    return rows(leakage.findings(df, features, "churned_in_window", P))


def test_clean_feature(spark):
    assert found(spark, [(5, 0), (10, 1), (15, 0)], "logins_7d INT, churned_in_window INT", ["logins_7d"]) == []


def test_correlation_and_separation(spark):
    got = found(spark, [(1, 1), (0, 0), (1, 1), (0, 0), (1, 1)], "f INT, churned_in_window INT", ["f"])
    kinds = {r["check_type"]: r["severity"] for r in got}
    assert kinds["target_correlation"] == "critical" and kinds["perfect_separation"] == "critical"


def test_names_and_dates(spark):
    data = [(1, 2, 3, 4, 1), (2, 1, 4, 3, 0)]
    schema = "churn_next_month INT, will_churn INT, signup_date INT, churn_at INT, churned_in_window INT"
    got = found(spark, data, schema, ["churn_next_month", "will_churn", "signup_date", "churn_at", "absent"])
    names = [r for r in got if r["check_type"] == "suspicious_name"]
    assert {r["feature"] for r in names} == {"churn_next_month", "will_churn", "churn_at"} and len(names) == 5
    assert {r["feature"] for r in got if r["check_type"] == "raw_date"} == {"signup_date", "churn_at"}
    assert all(r["severity"] == "warning" for r in names)


def test_text_features_get_name_checks_only(spark):
    got = found(spark, [("a", 1), ("b", 0)], "will_text STRING, churned_in_window INT", ["will_text"])
    assert [r["check_type"] for r in got] == ["suspicious_name"]


def test_future_pattern_counts_null_as_rest(spark):
    df = spark.createDataFrame(
        [(1.0, 0, None)] * 10 + [(1.1, 0, None)] * 10 + [(9.0, 1, dt.date(2024, 2, 1))],
        "f DOUBLE, churned_in_window INT, churn_date DATE",
    )
    got = rows(leakage.findings(df, ["f"], "churned_in_window", P))
    assert "future_pattern" in {r["check_type"] for r in got}


def test_summary(spark):
    df = spark.createDataFrame([(1, 1), (0, 0)], "will_f INT, churned_in_window INT")
    got = rows(leakage.summary(leakage.findings(df, ["will_f"], "churned_in_window", P)))[0]
    assert (got["total_checks"], got["critical_issues"], got["warnings"]) == (3, 2, 1)
    assert got["critical_features"] == "will_f,will_f"


def test_bronze_rule(spark):
    df = spark.createDataFrame(
        [("A", dt.date(2024, 1, 1), 100.0, "One year", True), ("A", None, -50.0, "Other", None)],
        "customer_id STRING, signup_date DATE, monthly_charges DOUBLE, contract_type STRING, churn_label BOOLEAN",
    )
    got = {r["rule"]: r["violations"] for r in rows(quality.bronze(df))}
    assert got["monthly_charges_not_negative"] == 1 and got["signup_date_required"] == 1
    assert got["unique_customer_id"] == 1 and got["contract_type_known"] == 1 and got["churn_label_required"] == 1
    assert got["customer_id_required"] == 0


def _dated(spark, days):
    base = dt.date(2024, 1, 1)
    return spark.createDataFrame([(i, base + dt.timedelta(days=d)) for i, d in enumerate(days)], "customer_id INT, prediction_date DATE")


def test_folds_have_inclusive_ends_and_no_leak(spark):
    df = _dated(spark, range(0, 200))
    folds = splits.ts_folds(df)
    assert [f.fold for f in folds] == [0, 1, 2, 3, 4]
    assert all((f.test_end - f.test_start).days == 30 and f.train_end < f.test_start for f in folds)
    assigned = splits.assign_folds(df, folds)
    assert all(r["no_leakage"] for r in rows(splits.no_leak(assigned, by=["fold"])))
    test0 = assigned.where("fold = 0 AND role = 'test'").count()
    assert test0 == 31


def test_folds_with_an_empty_side_are_left_out(spark):
    df = _dated(spark, [0, 1, 199])
    assert all(
        any(f.test_start <= d <= f.test_end for d in splits.distinct_days(df)) for f in splits.ts_folds(df)
    )
    assert splits.assign_folds(df, []).count() == 0


def test_simple_splits(spark):
    df = _dated(spark, range(0, 100))
    assert splits.final_split(df).where("role = 'test'").count() == 19
    assert splits.quantile_split(df).where("role = 'train'").count() == 80
    assert splits.ordinal_split(df).where("role = 'train'").count() == 80


def _explained(spark, contributions, score=0.8):
    element = f"array<{explain.ELEMENT}>"
    return spark.createDataFrame([(1, score, 0.1, contributions)], f"customer_id INT, score DOUBLE, base_value DOUBLE, contributions {element}")


def test_first_rule_that_holds_and_only_raising(spark):
    got = rows(interventions.match_rules(_explained(spark, [
        ("logins_7d", 1.0, 0.5), ("logins_14d", 5.0, 0.4), ("tickets_30d", 9.0, -0.3),
        ("contract_value_remaining", 1.0, 0.2), ("days_to_renewal", 95.0, 0.2), ("unmapped", 1.0, 0.9),
    ]), ["customer_id"]), "feature")
    assert [(r["feature"], r["action"]) for r in got] == [
        ("contract_value_remaining", "Retention discount offer"),
        ("logins_14d", "Feature discovery email"),
        ("logins_7d", "Re-engagement campaign"),
    ]


def test_plan_order_and_limit(spark):
    plan = rows(interventions.plans(_explained(spark, [
        ("logins_7d", 1.0, 0.5), ("logins_30d", 1.0, 0.1), ("days_since_last_login", 20.0, 0.3),
        ("tickets_30d", 9.0, 0.2), ("features_used_7d", 1.0, 0.9), ("login_trend_4w", -0.1, 0.05),
    ]), ["customer_id"]))[0]
    actions = [a["action"] for a in plan["recommended_interventions"]]
    assert actions == ["Win-back campaign", "Account review meeting", "Re-engagement campaign",
                       "Escalation to support lead", "In-app guidance setup"]
    assert plan["risk_level"] == "critical" and plan["total_interventions"] == 5
    assert plan["intervention_categories"]["engagement"] == actions[:3]
    assert plan["top_risk_factors"][0]["feature"] == "features_used_7d"


def test_long_forms_make_each_array_once(spark):
    """No filter on the size of a computed array, which would hold the steps of the array many times over (F14)."""
    rows_ = _explained(spark, [("logins_7d", 1.0, 0.5), ("logins_30d", 1.0, 0.1), ("logins_14d", 1.0, 0.3)])
    rows_ = rows_.union(spark.createDataFrame([(2, 0.1, 0.1, [("logins_7d", 9.0, -0.5)]), (3, 0.1, 0.1, [])], rows_.schema)).checkpoint()
    planned = interventions.plans(rows_, ["customer_id"])
    forms = {
        "categories": interventions.category_rows(planned, ["customer_id"]), "plan": interventions.plan_rows(planned, ["customer_id"]),
        "match": interventions.match_rules(rows_, ["customer_id"]), "local": explain.local_explanation(rows_, ["customer_id"]),
        "waterfall": explain.waterfall(rows_, ["customer_id"]),
    }
    plans = {k: df._jdf.queryExecution().optimizedPlan().toString() for k, df in forms.items()}
    assert {k: p.count("array_sort(") for k, p in plans.items()} == {"categories": 2, "plan": 2, "match": 0, "local": 1, "waterfall": 1}
    assert not [k for k, p in plans.items() if "(size(" in p and "> 0)" in p]
    assert [(r["customer_id"], r["category"], r["actions"]) for r in rows(forms["categories"])] == [
        (1, "engagement", ["Account review meeting", "Re-engagement campaign", "CSM outreach call"])]
    assert [(r["customer_id"], r["rank"]) for r in rows(forms["plan"], "rank")] == [(1, 1), (1, 2), (1, 3)]
    assert {k: df.groupBy("customer_id").count().orderBy("customer_id").collect() for k, df in forms.items() if k != "plan"} == {
        "categories": [(1, 1)], "match": [(1, 3)], "local": [(1, 3), (2, 1)], "waterfall": [(1, 5), (2, 3), (3, 2)]}


def test_waterfall_ends_at_the_margin(spark):
    contributions = [(f"f{i}", 1.0, 0.1 * (i - 3)) for i in range(8)]
    got = rows(explain.waterfall(_explained(spark, contributions), ["customer_id"], 3), "step")
    assert len(got) == 5 and got[0]["name"] == "Base Value"
    assert abs(got[-1]["running_total"] - (0.1 + sum(c[2] for c in contributions))) < 1e-12
    assert abs(got[-2]["running_total"] + got[-1]["value"] - got[-1]["running_total"]) < 1e-12


def test_rules_inventory():
    table = rule_rows()
    assert len(table) == 33 and len({r["feature"] for r in table}) == 16


def test_window_definitions_count_rows_at_p(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2023, 12, 31),)], "activity_date DATE")
    got = {r["feature"]: r for r in rows(leakage.window_definitions(df, {
        "ok": {"lookback_days": 7}, "today": {"lookback_days": 7, "includes_today": True}, "none": {}}, P))}
    assert (got["ok"]["rows_in_window"], got["ok"]["rows_at_or_after"], got["ok"]["severity"]) == (1, 0, "none")
    assert (got["today"]["rows_in_window"], got["today"]["rows_at_or_after"], got["today"]["severity"]) == (2, 1, "warning")
    assert got["none"]["severity"] == "critical" and got["none"]["rows_in_window"] == 0


def test_negative_and_missing_in_gold(spark):
    df = spark.createDataFrame([(1, -1, True), (2, 3, None)], "customer_id INT, logins_30d INT, churned_in_window BOOLEAN")
    got = {r["rule"]: r["violations"] for r in rows(leakage.validate_gold(df.withColumn("churn_date", F.lit(None))))}
    assert got == {"leaky_column_names": 1, "missing_target_rate": 1, "negative_logins": 1}
