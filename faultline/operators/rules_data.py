"""Phrase patterns of the evidence rules. Fixed values; all are matched without regard to case."""

ENGAGED = (
    r"level\s+4\s+ads\s+was\s+engaged",
    r"ads\s+was\s+engaged\s+in\s+autonomous\s+mode",
    r"traveling\s+in\s+autonomous\s+mode",
    r"operating\s+in\s+autonomous\s+mode",
    r"(?<!dis)engaged\s+l\d+\s+ads\b",
)
NOT_ENGAGED = (
    r"ads\s+was\s+not\s+engaged",
    r"in\s+manual\s+mode",
    r"took\s+manual\s+control",
    r"disengaged\s+autonom(y|ous)",
    r"disengaged\s+from\s+autonomy",
    r"disengaged\s+l\d+\s+ads\b",
)
HEDGES = {
    "mechanism": (r"\bmay have\b", r"\bis not clear\b", r"\bbecame aware\b.*\breview\b"),
    "injury": (r"alleged\s+(a\s+)?(minor|serious|moderate|no)?\s*injur\w*",),
    "administrative": (r"investigated the alleged incident",),
    "other": (r"\breportedly\b",),
}
CONTACT_VERBS = (r"\b(made|making)\s+contact\s+with\b|\bcollided\s+with\b|\bstruck\b|\brear-ended\b|\bto\s+contact\b",)
MULTI_CONTACT = 3
NO_CONTACT = (
    r"\b(made\s+)?no\s+contact\s+(or\s+collision\s+)?(between|with)\b",
    r"\bno\s+data\s+or\s+knowledge\s+of\s+any\s+contact\b",
)
REAR_END = (
    r"struck the rear of the (\w+ )?av\b",
    r"made\s+(\w+\s+)?contact with the rear[a-z ]{0,20}of the (\w+ )?av\b",
    r"\brear-ended\b",
)
EMERGENCY = (
    r"lights? and sirens?",
    r"emergency lights",
    r"responding to",
    r"yielding (for|to) (the |an )?emergency",
    r"emergency response",
    r"in pursuit",
)
BRAKED_TO_STOP = (r"braked.*(came to a stop|stopped)",)
STOPPED_CONTACT = (r"contact with the stopped",)
NOT_DAMAGED = (r"\bdid not\b",)
DAMAGE = (r"sustained damage",)
TWO_OTHERS = (r"passenger vehicle.*passenger vehicle", r"striking vehicle")
INFRASTRUCTURE = (
    r"\b(spikes|curb|pole|gate|manhole cover|raised pavement|utility (access )?cover|planter|fence|pothole|speed bump)\b",
    r"\bcontact with (the )?pavement\b",
)
OTHER_ACTOR = (
    r"\b(pickup truck|passenger car|passenger vehicle|suv|van|bus|truck|car|motorcycle)\b[^.]{0,100}\b(made contact with|struck|collided with|reversed[^.]{0,20}into)\b[^.]{0,60}\b(stationary|parked|stopped)?\s*(\w+\s+)?(av|ads|vehicle)\b",
    r"\b(pedestrian|person|individual|cyclist|bicyclist)\b[^.]{0,150}\b(pushing|carrying|moving|dragging|holding|walking\s+(with|alongside))\b",
)
NO_OTHER_PARTY = ("Other, see Narrative", "Other Fixed Object")
TRAFFIC_VIOLATION = (
    r"disregard(ed)? (a |the )?red (\w+\s+)?(light|signal)",
    r"ran (a |the )?red (\w+\s+)?(light|signal)",
    r"ignored (a |the )?red (\w+\s+)?(light|signal)",
    r"entered? (the )?intersection against (a |the )?red (\w+\s+)?(light|signal)",
    r"against (a |the )?red (\w+\s+)?(light|signal)",
)
LANE_INTRUSION = (
    r"cross(ed)?\s+(the\s+)?(double\s+yellow|center\s+line|dashed\s+(white\s+)?lane\s+line)[^.]{0,60}(enter(ed|ing)?|into)\s+(the\s+)?(\w+\s+)?(av|ads|vehicle)'?s?\s+lane",
    r"enter(ed|ing)?\s+(the\s+)?(\w+\s+)?(av|ads|vehicle)'?s?\s+lane\s+of\s+travel",
)
AUTOMATION_FIRST = (
    r"\b(the\s+)?(ads|automat\w+(?:\s+driving)?\s+system|automation)\b[^.]{0,100}\b(initiat\w*|attempt\w*|began|begun|started|executing|performing)\b[^.]{0,150}\b(disengag\w*|took (manual )?control|took over|driver (took|assumed)|manual mode)\b",
)
HUMAN_CONTROL = (
    r"teleoperator (took over|took control|assumed control)",
    r"(safety (driver|monitor)|driver|operator) (took over|took (manual )?control|assumed control)",
)
AFTER_CONTACT = r"\b(following|after)\s+(the\s+)?(contact|impact|collision)\b"
OCCUPANT = (
    r"passenger[s]?\s+(in|of)\s+the\s+(\w+\s+)?(av|ads|vehicle)\b[^.]{0,20}\bopened\s+the\b",
    r"\bopened\s+the\s+(\w+\s+)?(rear|front)\b[^.]{0,30}\bdoor\b",
)
OTHER_OWNER = r"\b(parked|other|second|another)\s+(\w+\s+)?(av|ads|vehicle)\b"
AVOIDANCE = (r"steer", r"reduced (vehicle )?speed", r"braked")

#: Report fields and candidate fields that become atoms of their own. Fixed values, like all names below.
REPORT_FIELDS = (
    "reporting_entity",
    "developer_or_operator",
    "crash_interaction_counterpart_text",
    "subject_vehicle_precrash_movement_text",
    "other_actor_precrash_movement_text",
    "injury_outcome_text",
    "automation_engagement_text",
    "city",
    "state",
    "incident_date",
    "incident_date_precision",
)
CANDIDATE_FIELDS = (
    "developer_or_operator",
    "city",
    "state",
    "crash_interaction_counterpart",
    "subject_vehicle_precrash_movement",
    "other_actor_precrash_movement",
    "injury_outcome",
    "automation_engagement",
    "incident_date",
    "incident_date_precision",
    "narrative",
)
#: Candidate fields whose conflicts count as evidence; those of an event's shape come last but one.
CHECKED_FIELDS = (
    "developer_or_operator",
    "city",
    "crash_interaction_counterpart",
    "subject_vehicle_precrash_movement",
    "other_actor_precrash_movement",
    "injury_outcome",
)
SHAPE_FIELDS = ("crash_interaction_counterpart", "subject_vehicle_precrash_movement", "other_actor_precrash_movement")
#: Names under which fields appear in sentences, where they differ.
FIELD_NAMES = {"injury_outcome": "injury_outcome_text"}
APPROVED_SPELLINGS = {"san fancisco": "San Francisco"}
