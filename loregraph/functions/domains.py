"""Reference domains: episode types, entity types and the confirm sentence."""

from __future__ import annotations

# Fixed values.
EPISODE_TYPES = [
    "interview_synthesis", "cross_analysis", "document_analysis", "process_extraction", "process_refinement",
    "future_state", "sop_generation", "status_update", "engagement_setup", "bootstrap", "insight_report",
    "sop_approved", "process_map_approved", "process_feedback_resolved", "insight_opus_perspective",
    "insight_gemini_perspective", "insight_gpt_perspective", "insight_reconciliation",
]
ENTITY_TYPES = [
    ("Stakeholder", "A person of the client organization who takes part"),
    ("Consultant", "A person of the advising team"),
    ("Department", "A unit, division or team of an organization"),
    ("Role", "A position or job function"),
    ("Process", "A business process, workflow or procedure"),
    ("System", "A software tool, platform or other technology in use"),
    ("Finding", "An observation or conclusion"),
    ("PainPoint", "A problem, bottleneck or gap"),
    ("Opportunity", "A possible improvement"),
    ("Regulation", "A rule set by an authority or a standard"),
    ("Policy", "A rule or procedure an organization sets itself"),
    ("Deliverable", "A report, artifact or other output"),
    ("Decision", "A choice made or pending"),
    ("Metric", "A measure or indicator"),
    ("Goal", "An objective or target"),
    ("Risk", "A threat or concern to be mitigated"),
]
CONFIRM_SENTENCE = "I understand this wipes all data"
DEFAULT_INDUSTRY = "tribal_gaming"
