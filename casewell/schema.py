"""Schemas and fixed domain values of the complaint register."""

from __future__ import annotations

from pyspark.sql import types as T

BASE_COLUMNS = [
    ("complaint_id", T.StringType()),
    ("complaint_text", T.StringType()),
    ("category", T.StringType()),
    ("sentiment", T.StringType()),
    ("severity", T.StringType()),
    ("channel", T.StringType()),
    ("branch", T.StringType()),
    ("status", T.StringType()),
    ("resolution_note", T.StringType()),
    ("created_date", T.TimestampType()),
    ("resolution_days", T.DoubleType()),
    ("is_duplicate", T.BooleanType()),
    ("duplicate_of", T.StringType()),
]
PREDICTION_COLUMNS = ["predicted_category", "predicted_sentiment", "predicted_severity"]

BASE_SCHEMA = T.StructType([T.StructField(n, t) for n, t in BASE_COLUMNS])
REGISTER_SCHEMA = T.StructType(
    BASE_SCHEMA.fields
    + [T.StructField(n, T.StringType()) for n in PREDICTION_COLUMNS]
    + [T.StructField("source", T.StringType())]
)

COMMUNICATION_SCHEMA = T.StructType([
    T.StructField("complaint_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("sender", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("type", T.StringType()),
])
ESCALATION_SCHEMA = T.StructType([
    T.StructField("complaint_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("escalation_level", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("escalated_to", T.StringType()),
    T.StructField("escalated_by", T.StringType()),
    T.StructField("escalated_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
])
EXTENSION_SCHEMA = T.StructType([
    T.StructField("complaint_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("extend_hours", T.IntegerType()),
    T.StructField("reason", T.StringType()),
    T.StructField("extended_at", T.TimestampType()),
])
VERDICT_SCHEMA = T.StructType([
    T.StructField("complaint_id", T.StringType()),
    T.StructField("can_auto_resolve", T.BooleanType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("resolution_note", T.StringType()),
])
CHUNK_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("chunk_id", T.StringType()),
    T.StructField("text", T.StringType()),
])

# ---------------------------------------------------------------------------
# These must equal the published behaviour for right results.
# ---------------------------------------------------------------------------
CATEGORIES = [
    "Internet Banking",
    "ATM / Debit Card",
    "Loan Services",
    "Account Opening",
    "Fund Transfer / NEFT / RTGS",
    "Credit Card",
    "KYC / Documentation",
    "Fixed Deposit",
    "Mobile Banking App",
    "Customer Service",
]
SENTIMENTS = ["Angry", "Frustrated", "Neutral", "Disappointed", "Urgent"]
SEVERITIES = ["Low", "Medium", "High", "Critical"]
STATUSES = ["Open", "In Progress", "Resolved", "Escalated"]
CHANNELS = ["Email", "Branch Visit", "Phone Call", "Mobile App", "Web Portal", "Social Media"]

SLA_HOURS = {"Critical": 4, "High": 24, "Medium": 72, "Low": 168}
DEFAULT_SLA_HOURS = 72
AT_RISK_FRACTION = 0.2

DEPARTMENTS = {
    "ATM / Debit Card": "ATM & Card Operations Team",
    "Credit Card": "Credit Card Disputes Team",
    "Fund Transfer / NEFT / RTGS": "NEFT/RTGS Operations Team",
    "Internet Banking": "Digital Banking Support",
    "Mobile Banking App": "Mobile Banking Dev Team",
    "KYC / Documentation": "KYC Compliance Team",
    "Loan Services": "Loan Operations Department",
    "Customer Service": "Branch Service Quality Team",
    "Account Opening": "Account Services Team",
    "Fixed Deposit": "Deposits & Treasury Team",
}
DEFAULT_DEPARTMENT = "Customer Service Team"

CHANNEL_ICONS = {
    "Email": "📧",
    "Branch Visit": "🏦",
    "Phone Call": "📞",
    "Mobile App": "📱",
    "Web Portal": "🌐",
    "Social Media": "📣",
}
DEFAULT_ICON = "📋"

PRIORITY_SCORES = {"Critical": 10, "High": 8, "Medium": 5, "Low": 3}
DEFAULT_PRIORITY = 5
TONE_TIPS = {
    "Negative": "Use an empathetic, patient, and reassuring tone.",
    "Neutral": "Maintain a clear and professional tone.",
    "Positive": "Acknowledge their positive sentiment and remain helpful.",
}
DEFAULT_TONE = "Be professional."

REGULATORY_KEYWORDS = ["rbi", "ombudsman", "regulatory", "compliance", "fraud", "penalty"]
AUTO_RESOLVE_CATEGORIES = ["Fund Transfer / NEFT / RTGS", "ATM / Debit Card"]
AUTO_RESOLVE_KEYWORDS = ["upi", "pending", "failed", "atm", "withdrawal", "balance"]
AUTO_RESOLVE_SEVERITIES = ["Low", "Medium"]

TRIAGE_LEVEL = "L2"
TRIAGE_REASON = "Auto-escalated by AI Agent — Critical severity + SLA breached"
TRIAGE_MESSAGE = (
    "🤖 AI Agent auto-escalated this complaint — Critical severity with SLA breach detected."
)
TRIAGE_CHANNEL = "AI Agent"
AUTO_RESOLUTION_PREFIX = "🤖 Autonomous Agent auto-resolved this complaint. Reasoning: "
AUTO_RESOLUTION_MARK = "Autonomous Agent auto-resolved"
EXTENSION_MESSAGE = "SLA extended by {hours} hours. Reason: {reason}. New due: {due}"
ESCALATION_MESSAGE = "Complaint escalated to {level} — {team}. Reason: {reason}"

# product words in order of precedence; the last category is the default
PRODUCT_RULES = [
    (["credit card", "credit reporting"], "Credit Card"),
    (["loan", "mortgage", "debt"], "Loan Services"),
    (["account", "savings"], "Account Opening"),
    (["transfer", "money"], "Fund Transfer / NEFT / RTGS"),
]
DEFAULT_PRODUCT_CATEGORY = "Customer Service"

# similarity limits
NEAR_COPY = 0.9999
DUPLICATE_ABOVE = 0.88

# (lower edge, label) in falling order, then the label below all edges
MATCH_BANDS = ([(0.95, "Critical Match"), (0.90, "High Match"), (0.82, "Moderate Match")],
               "Low Match")
RESOLUTION_BANDS = ([(70, "success"), (40, "warning")], "destructive")
PRIORITY_BANDS = ([(8, "destructive"), (5, "warning")], "success")
BRANCH_BANDS = ([(0.8, "destructive"), (0.5, "warning")], "success")
URGENT_BELOW_HOURS = 2

# drafts
DRAFT_OPENING = "Dear {name},\nWe have received your complaint regarding {category}. "
DRAFT_WITH_POLICY = ("Our team is investigating this in accordance with the {source} "
                     "guidelines.")
DRAFT_WITHOUT_POLICY = "Our team is investigating this matter."
ROOT_CAUSE = "Issue relates to {category} operations."
ROOT_CAUSE_SOURCE = " [Source: {source}] - {snippet}"
ACTION_LOG = "Log complaint details in the CRM"
ACTION_ASSIGN = "Assign to {team}"
ACTION_FOLLOW = "Follow resolution steps outlined in {source}"
REGULATORY_REASON = "Flagged due to potential regulatory impact or high severity."
REGULATORY_REASON_SOURCE = REGULATORY_REASON + " [Source: {source}]"
# the record that stands in for a draft answer that cannot be read
DEFAULT_DRAFT = {
    "draft_response": "We sincerely apologize for the inconvenience. Your complaint has been "
                      "registered and our team will contact you within 2-3 working days.",
    "root_cause": "Unable to analyze.",
    "action_items": ["Register complaint", "Assign to department", "Follow up within SLA"],
    "escalate_to": "Customer Service Team",
    "resolution_sla": "2-3 working days",
    "priority_score": 5,
    "customer_tone_tip": "Be empathetic and professional.",
}
# end of fixed values

# Rules of the policy texts.
#: Hours of breach beyond which a rung is reached, its level, and who is told (a suffix of the
#: department's name on the first rung). The last rung also alerts the regulator.
LADDER = [
    (0, "L1", " - Level 1 Manager"),
    (48, "L2", "Zonal Head"),
    (120, "L3", "Principal Nodal Officer"),
]
ACKNOWLEDGE_DAYS, FINAL_DAYS = 3, 30
#: Responsible stages with the day of age up to which each one lasts.
STAGES = [("Branch", 7), ("Zonal Office", 14), ("Principal Nodal Officer", 29), ("Overdue", None)]
#: Days within which the customer must have the money back, and the penalty for each day after.
PENALTY_DAYS = {"ATM / Debit Card": 5, "Fund Transfer / NEFT / RTGS": 1}
PENALTY_PER_DAY = 100
