"""Feature -> category, context, and rules (trigger, action, priority) in evaluation order.

A trigger is '< x', '> x', or a word that always holds.
"""

RULES = {
    "logins_7d": ("engagement", "Low login frequency indicates disengagement risk", [
        ("< 2", "Re-engagement campaign", "high"), ("< 5", "Usage tips email", "medium")]),
    "logins_14d": ("engagement", "Two-week login trend shows engagement trajectory", [
        ("< 3", "CSM outreach call", "high"), ("< 7", "Feature discovery email", "medium")]),
    "logins_30d": ("engagement", "Monthly engagement critical for retention", [
        ("< 5", "Account review meeting", "critical"), ("< 10", "Executive sponsor outreach", "high")]),
    "days_since_last_login": ("engagement", "Recency of activity is strong churn signal", [
        ("> 14", "Win-back campaign", "critical"), ("> 7", "Check-in email", "high")]),
    "feature_adoption_pct": ("adoption", "Low adoption indicates unrealized value", [
        ("< 0.3", "Product training session", "high"), ("< 0.5", "Feature showcase webinar", "medium")]),
    "features_used_7d": ("adoption", "Feature breadth indicates stickiness", [
        ("< 3", "In-app guidance setup", "medium"), ("< 5", "Best practices guide", "low")]),
    "login_velocity_wow": ("velocity", "Declining engagement is early warning signal", [
        ("< -0.3", "Proactive CSM call", "critical"), ("< 0", "Usage decline notification", "high")]),
    "login_trend_4w": ("velocity", "4-week trend shows sustained pattern changes", [
        ("< -0.2", "Quarterly business review", "high"), ("< 0", "Value realization workshop", "medium")]),
    "tickets_30d": ("support", "High ticket volume indicates product friction", [
        ("> 3", "Escalation to support lead", "high"), ("> 1", "Proactive support check-in", "medium")]),
    "avg_sentiment_30d": ("support", "Negative sentiment predicts churn", [
        ("< -0.3", "Executive escalation", "critical"), ("< 0", "Satisfaction survey follow-up", "high")]),
    "escalation_rate_30d": ("support", "Escalations indicate unresolved issues", [
        ("> 0.3", "Support process review", "critical"), ("> 0.1", "Dedicated support contact", "high")]),
    "days_to_renewal": ("contract", "Approaching renewal requires action", [
        ("< 30", "Renewal discussion", "critical"), ("< 60", "Contract review prep", "high"),
        ("< 90", "Value summary report", "medium")]),
    "contract_value_remaining": ("contract", "Contract value guides intervention investment", [
        ("high_value", "Retention discount offer", "high"), ("any", "Upsell opportunity review", "medium")]),
    "onboarding_completion_pct": ("activation", "Incomplete onboarding leads to early churn", [
        ("< 0.3", "Onboarding rescue call", "critical"), ("< 0.6", "Guided setup session", "high")]),
    "days_to_first_login": ("activation", "Delayed first login indicates adoption risk", [
        ("> 3", "Welcome call", "high"), ("> 1", "Quick-start guide", "medium")]),
    "first_week_logins": ("activation", "First week engagement predicts long-term retention", [
        ("< 3", "Early success check-in", "high"), ("< 5", "Use case discovery call", "medium")]),
}

PRIORITIES = ("critical", "high", "medium", "low")


def rule_rows(rules=None):
    """One dict per rule: feature, seq, op, threshold, action, priority, rank, category, context."""
    rows = []
    for feature, (category, context, triggers) in (rules or RULES).items():
        for seq, (trigger, action, priority) in enumerate(triggers):
            op, _, bound = trigger.partition(" ")
            rows.append(
                {
                    "feature": feature,
                    "seq": seq,
                    "op": op if op in ("<", ">") else "any",
                    "threshold": float(bound) if bound else 0.0,
                    "action": action,
                    "priority": priority,
                    "rank": PRIORITIES.index(priority) if priority in PRIORITIES else len(PRIORITIES),
                    "category": category,
                    "context": context,
                }
            )
    return rows
