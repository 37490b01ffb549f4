"""Small literal logs."""

from datetime import datetime, timedelta

from caselens.functions.vocabulary import CASE_QUALIFIER
from caselens.operators.log import Log

T0 = datetime(2024, 1, 1)
EPOCH = datetime(1970, 1, 1)


def case_log(spark, cases: dict[str, list[tuple]], cse: str = "E", severity: dict | None = None, assets: dict | None = None, criticality: dict | None = None, tiers: dict | None = None, owner: dict | None = None, queue: dict | None = None) -> Log:
    """cases: id -> events (type, minute[, actor[, handover reason]])."""
    events, objects, attrs = [], [], []
    people = set((owner or {}).values()) | set(tiers or {})
    for case, steps in cases.items():
        rels = [(f"AL-{case}", "case_for_alert")] if severity and case in severity else []
        rels += [(owner[case], "current_assignee")] if owner and case in owner else []
        rels += [(queue[case], "current_queue")] if queue and case in queue else []
        objects.append((cse, case, "Case", rels))
        for k, (kind, minute, *more) in enumerate(steps):
            edges = [(case, CASE_QUALIFIER[kind])]
            if more and more[0]:
                edges.append((more[0], {"REASSIGN": "reassigned_to", "INVESTIGATE": "investigated_by"}.get(kind, "assigned_to")))
                people.add(more[0])
            events.append((cse, f"{kind}::{case}::{k}", kind, T0 + timedelta(minutes=minute), {"handover_reason": more[1]} if len(more) > 1 else {}, edges))
    for case, s in (severity or {}).items():
        asset = (assets or {}).get(case)
        objects.append((cse, f"AL-{case}", "Alert", [(asset, "raised_on_asset")] if asset else []))
        attrs.append((cse, f"AL-{case}", "severity", s, EPOCH))
    for asset in sorted(set((assets or {}).values()) | set(criticality or {})):
        objects.append((cse, asset, "Asset", []))
        attrs.append((cse, asset, "criticality", (criticality or {}).get(asset, "LOW"), EPOCH))
    for p in sorted(people):
        objects.append((cse, p, "Analyst", []))
        attrs.append((cse, p, "tier", (tiers or {}).get(p, "UNKNOWN"), EPOCH))
    objects += [(cse, q, "Queue", []) for q in sorted(set((queue or {}).values()))]
    return Log.of(spark, events, objects, attrs)
