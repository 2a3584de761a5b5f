"""Fixed values of the triage domain (codes, names, reward cells, thresholds)."""

# --- fixed values: must equal the published definitions -------------------
ACTIONS = ["allow", "block", "human_review"]
GRADES = ["BenignPositive", "FalsePositive", "TruePositive", "Unknown"]

# REWARDS[grade][action]
REWARDS = [
    [1.5, -1.0, 0.25],
    [1.5, -2.0, 0.25],
    [-2.0, 2.0, 1.0],
    [-1.0, 0.5, 1.5],
]

RAW_COLUMNS = [
    "IncidentId", "Timestamp", "Category", "MitreTechniques", "IncidentGrade",
    "ActionGrouped", "ActionGranular", "EntityType", "EvidenceRole",
    "ThreatFamily", "OSFamily", "SuspicionLevel", "LastVerdict",
]

CATEGORICALS = [
    "category", "mitre", "entity_type", "evidence_role", "threat_family",
    "os_family", "suspicion",
]
CALENDAR = ["hour", "day", "month", "is_weekend"]
OBSERVATION = CATEGORICALS + CALENDAR
STATE = (
    ["category", "mitre", "action_grouped", "action_granular", "entity_type",
     "evidence_role", "threat_family", "os_family", "suspicion"] + CALENDAR
)

TIME_ALIASES = [
    "Timestamp", "timestamp", "TimeStamp", "EventTime", "event_time",
    "CreatedTime", "CreatedAt", "Date", "date", "Time", "time",
]
ACTION_ALIASES = ["Action", "action", "AgentAction", "agent_action"]

LEAKY_PATTERNS = [
    "grade", "label", "target", "outcome", "resolution", "resolved", "verdict",
    "groundtruth", "ground_truth", "prediction", "predicted",
]

REVIEW_WORDS = {
    "approve": "APPROVED", "approved": "APPROVED",
    "allow": "FINAL_ALLOWED", "allowed": "FINAL_ALLOWED",
    "reject": "REJECTED", "rejected": "REJECTED",
    "block": "FINAL_BLOCKED", "blocked": "FINAL_BLOCKED",
    "delete": "DELETED", "deleted": "DELETED",
    "escalate": "ESCALATED", "escalated": "ESCALATED",
    "close": "CLOSED", "closed": "CLOSED",
}
OPEN_STATUSES = ["HUMAN_REVIEW_PENDING", "ESCALATED", "OPEN"]

# (analyst_id, name, role, capacity, active)
ANALYSTS = [
    ("SA", "SOC Analyst", "Supervision", 10, True),
    ("analyst-01", "Analyst 01", "Tier 1", 10, True),
    ("analyst-02", "Analyst 02", "Tier 1", 10, True),
    ("analyst-03", "Analyst 03", "Tier 2", 8, True),
]

# (component, path prefix), first match wins
COMPONENTS = [
    ("database", "/api/database"), ("alerts", "/api/alerts"),
    ("decisions", "/api/decisions"), ("rewards", "/api/rewards"),
    ("dashboard", "/api/dashboard"), ("agent", "/api/agent"),
    ("evaluation", "/api/evaluation"),
]

CONFIDENCE_THRESHOLD = 0.60
MARGIN_THRESHOLD = 0.15
OPTIMALITY_WEIGHT = 0.70
EFFICIENCY_WEIGHT = 0.30
# --------------------------------------------------------------------------
