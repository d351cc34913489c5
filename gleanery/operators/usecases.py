"""Business templates: target, thresholds and what to do per risk tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The four templates, as the business defines them.
USE_CASES = [
    {
        "id": "customer_churn", "name": "Customer Churn Prediction", "industry": "Telecom / SaaS / Subscription",
        "description": "Predict which customers are likely to cancel their subscription so retention teams can intervene before revenue is lost.",
        "business_goal": "Reduce monthly churn rate by prioritizing high-risk accounts for outreach.",
        "target_col": "Churn", "positive_class": "Yes", "problem_type": "classification", "id_columns": ["customer_id"],
        "high": 0.65, "medium": 0.35,
        "actions": {
            "high": "Immediate retention call + discount or plan upgrade offer",
            "medium": "Proactive check-in email and usage review within 7 days",
            "low": "Monitor in next billing cycle; include in nurture campaign",
        },
        "kpis": ["Churn rate", "Retention save rate", "Cost per saved customer"],
        "probability_label": "churn_probability", "report_prefix": "retention_report", "high_risk_label": "Churn risk",
    },
    {
        "id": "lead_scoring", "name": "Sales Lead Scoring", "industry": "B2B SaaS / Enterprise Sales",
        "description": "Score inbound leads by conversion likelihood so sales teams focus on high-intent prospects first.",
        "business_goal": "Increase win rate by routing hot leads to senior reps immediately.",
        "target_col": "Converted", "positive_class": "Yes", "problem_type": "classification", "id_columns": ["lead_id"],
        "high": 0.70, "medium": 0.40,
        "actions": {
            "high": "Assign to senior AE — same-day personalized outreach",
            "medium": "SDR follow-up within 48 hours + targeted case study",
            "low": "Add to automated nurture sequence; no immediate sales call",
        },
        "kpis": ["Conversion rate", "Lead-to-opportunity rate", "Sales cycle length"],
        "probability_label": "conversion_probability", "report_prefix": "lead_scoring_report", "high_risk_label": "Conversion score",
    },
    {
        "id": "fraud_detection", "name": "Payment Fraud Detection", "industry": "Banking / Fintech / E-commerce",
        "description": "Flag suspicious transactions before they settle so fraud teams can block or verify high-risk payments in real time.",
        "business_goal": "Reduce fraud losses while minimizing false declines on legitimate purchases.",
        "target_col": "IsFraud", "positive_class": "Yes", "problem_type": "classification", "id_columns": ["transaction_id"],
        "high": 0.75, "medium": 0.45,
        "actions": {
            "high": "Block transaction and alert fraud team immediately",
            "medium": "Step-up verification (OTP / call back) before approval",
            "low": "Approve with standard monitoring",
        },
        "kpis": ["Fraud catch rate", "False positive rate", "Chargeback volume"],
        "probability_label": "fraud_probability", "report_prefix": "fraud_alert_report", "high_risk_label": "Fraud risk",
    },
    {
        "id": "loan_default", "name": "Loan Default Risk", "industry": "Banking / Lending / Credit",
        "description": "Predict which loan applicants are likely to default so underwriters can adjust terms, require collateral, or decline risky applications.",
        "business_goal": "Cut default rate while keeping approval rates healthy for qualified borrowers.",
        "target_col": "Default", "positive_class": "Yes", "problem_type": "classification", "id_columns": ["applicant_id"],
        "high": 0.70, "medium": 0.40,
        "actions": {
            "high": "Decline or require co-signer + higher interest rate",
            "medium": "Manual underwriter review within 24 hours",
            "low": "Auto-approve with standard terms",
        },
        "kpis": ["Default rate", "Approval rate", "Loss given default"],
        "probability_label": "default_probability", "report_prefix": "loan_risk_report", "high_risk_label": "Default risk",
    },
]
DEFAULT_HIGH, DEFAULT_MEDIUM = 0.65, 0.35
NO_USE_CASE_ACTION = "Review prediction with domain expert."
NO_ACTION = "No action defined."
MANUAL_ACTION = "Review prediction manually."

CATALOG_SCHEMA = (
    "use_case_id string, name string, industry string, description string, business_goal string, target_col string, "
    "positive_class string, problem_type string, id_columns array<string>, high double, medium double, kpis array<string>, "
    "probability_label string, report_prefix string, high_risk_label string"
)


def use_case_catalog(spark: SparkSession) -> DataFrame:
    """The templates as a small reference table."""
    rows = [(u["id"], u["name"], u["industry"], u["description"], u["business_goal"], u["target_col"], u["positive_class"],
             u["problem_type"], u["id_columns"], u["high"], u["medium"], u["kpis"], u["probability_label"], u["report_prefix"],
             u["high_risk_label"]) for u in USE_CASES]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def use_case_actions(spark: SparkSession) -> DataFrame:
    rows = [(u["id"], tier, text) for u in USE_CASES for tier, text in u["actions"].items()]
    return spark.createDataFrame(rows, "use_case_id string, risk_tier string, action string")


def get_use_case(use_case_id: str | None) -> dict | None:
    return next((u for u in USE_CASES if u["id"] == use_case_id), None)


def resolve_target(target: str | None, use_case_id: str | None) -> str | None:
    """The caller's target wins; else the template's; else none."""
    template = get_use_case(use_case_id)
    return target or (template["target_col"] if template else None)


def tier_of(probability: Column, high: Column, medium: Column) -> Column:
    return (F.when(probability.isNull(), "unknown").when(probability >= high, "high")
            .when(probability >= medium, "medium").otherwise("low"))


def risk_tier(df: DataFrame, probability: str, use_case: str = "use_case_id") -> DataFrame:
    """Add ``risk_tier`` by the thresholds of each row's template, or the defaults."""
    limits = use_case_catalog(df.sparkSession).select(F.col("use_case_id").alias("_uc"), "high", "medium")
    joined = df.join(F.broadcast(limits), df[use_case] == F.col("_uc"), "left")
    tier = tier_of(F.col(probability), F.coalesce("high", F.lit(DEFAULT_HIGH)), F.coalesce("medium", F.lit(DEFAULT_MEDIUM)))
    return joined.select(*[df[c] for c in df.columns], tier.alias("risk_tier"))


def recommended_action(df: DataFrame, use_case: str = "use_case_id", tier: str = "risk_tier") -> DataFrame:
    """Add ``recommended_action`` for (template, tier), with the stated texts where either is missing."""
    spark = df.sparkSession
    texts = use_case_actions(spark).select(F.col("use_case_id").alias("_uc"), F.col("risk_tier").alias("_tier"), "action")
    known = [u["id"] for u in USE_CASES]
    joined = df.join(F.broadcast(texts), (df[use_case] == F.col("_uc")) & (df[tier] == F.col("_tier")), "left")
    text = (F.when(F.col(tier) == "unknown", MANUAL_ACTION)
            .when(~F.coalesce(F.col(use_case).isin(known), F.lit(False)), NO_USE_CASE_ACTION)
            .otherwise(F.coalesce("action", F.lit(NO_ACTION))))
    return joined.select(*[df[c] for c in df.columns], text.alias("recommended_action"))
