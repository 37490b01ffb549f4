"""Names, weights and thresholds that results depend on."""

from __future__ import annotations

EPOCH = "1970-01-01 00:00:00"
FOR_CASE = "_for_case"

OBJECT_ATTRIBUTES = {"Asset": ("criticality", "asset_type"), "Alert": ("severity", "category"), "Case": ("status",), "Analyst": ("tier",), "Queue": ("name",)}
EVENT_TYPES = ("ALERT_RAISED", "OPEN_CASE", "ASSIGN", "ENRICH", "INVESTIGATE", "ESCALATE", "EVIDENCE_COLLECT", "REASSIGN", "CLOSE")
CASE_QUALIFIER = {"ASSIGN": "assignment_for_case", "REASSIGN": "reassignment_for_case", "ENRICH": "enrich_for_case", "INVESTIGATE": "investigate_for_case", "ESCALATE": "escalation_for_case", "EVIDENCE_COLLECT": "evidence_for_case", "CLOSE": "close_for_case"}

TABLES = {
    "cases": ("case_id", "analyst_id", "queue_id", "status", "opened_at", "closed_at", "alert_id"),
    "case_events": ("case_id", "event", "ts", "actor", "handover_reason"),
    "alerts": ("alert_id", "severity", "category", "asset_id", "raised_at"),
    "assets": ("asset_id", "criticality", "asset_type"),
    "analysts": ("analyst_id", "tier"),
    "queues": ("queue_id", "name"),
}
REQUIRED_TABLES = ("cases", "case_events")
REQUIRED_FIELDS = {"cases": ("case_id",), "case_events": ("case_id", "event", "ts"), "alerts": ("alert_id",), "assets": ("asset_id",), "analysts": ("analyst_id",), "queues": ("queue_id",)}

AUTHORITY_WEIGHT = {"MANDATORY": 1.0, "EXPECTED": 0.7, "PEER_NORMAL": 0.5, "OPTIONAL": 0.3, "UNKNOWN": 0.1}
CAPABILITY_WEIGHT = {"Escalation": 1.0, "Investigation": 0.8, "Operational Discipline": 0.5, "Incident Response": 0.9, "Threat Detection": 0.9}
OTHER_CAPABILITY_WEIGHT = 0.5
QUALITY_WEIGHT = {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.3}
AUTHORITY_COMPLEXITY = {"MANDATORY": 1.5, "EXPECTED": 1.2, "PEER_NORMAL": 1.0, "OPTIONAL": 0.8, "UNKNOWN": 1.0}
COST = {"base": 15.0, "per_alert": 5.0, "per_event": 2.0, "low_quality": 20.0}

Z_FLAG = 2.0
Z_95 = 1.959963984540054
LOW_EXPOSURE = 10

CORE_FINDINGS = {"REASSIGNMENT_LOOP": ("Operational Discipline", "EXPECTED"), "ESCALATION_SLA_VIOLATION": ("Escalation", "MANDATORY"), "MISSING_ENRICHMENT": ("Investigation", "EXPECTED")}
VERDICTS = ("TRUE_SUPERVISORY_FINDING", "FALSE_POSITIVE", "INCONCLUSIVE", "DATA_QUALITY_ISSUE", "EXPECTED_LEGITIMATE_BEHAVIOR", "DUPLICATE_OF_EXISTING_FINDING", "OUT_OF_SCOPE")
TRUE_SUB_TYPES = ("PROCESS_VIOLATION", "CAPABILITY_INADEQUACY", "CONTROL_FAILURE", "GOVERNANCE_GAP")
CONFIRMING = ("TRUE_SUPERVISORY_FINDING",)
REFUTING = ("FALSE_POSITIVE", "OUT_OF_SCOPE")
CAUSAL_FINDINGS = ("REASSIGNMENT_LOOP", "ESCALATION_SLA_VIOLATION", "MISSING_ENRICHMENT", "EXCESSIVE_REASSIGNMENT_CARDINALITY")

FIELD_ALIASES = {
    "case_id": ("case_id", "incident_number", "ticket_id"),
    "analyst_id": ("analyst_id", "assigned_to", "owner", "analyst"),
    "queue_id": ("queue_id", "assignment_group", "queue", "team"),
    "status": ("status", "state"),
    "opened_at": ("opened_at", "created", "created_at", "open_time"),
    "closed_at": ("closed_at", "resolved_at", "close_time"),
    "alert_id": ("alert_id", "alert", "source_alert_id"),
    "event": ("event", "event_type", "activity", "action"),
    "ts": ("ts", "timestamp", "time", "event_time"),
    "actor": ("actor", "analyst_id", "assigned_to", "owner"),
    "handover_reason": ("handover_reason", "reason", "notes"),
    "severity": ("severity", "priority"),
    "category": ("category", "type"),
    "asset_id": ("asset_id", "ci_id", "asset"),
    "raised_at": ("raised_at", "created", "created_at"),
    "criticality": ("criticality", "impact", "importance"),
    "asset_type": ("asset_type", "ci_type", "type"),
    "tier": ("tier", "level"),
    "name": ("name", "queue_name"),
}
EVENT_WORDS = {
    "ASSIGN": ("assign", "assigned"),
    "REASSIGN": ("reassign", "reassigned", "transfer", "transferred"),
    "ENRICH": ("enrich", "enrichment", "enriched"),
    "INVESTIGATE": ("investigate", "investigation", "investigated"),
    "ESCALATE": ("escalate", "escalated", "escalation"),
    "EVIDENCE_COLLECT": ("evidence_collect", "evidence_collected", "evidence"),
    "CLOSE": ("close", "closed", "resolved", "resolve"),
}
