"""Parameter tables and fixed values.

Every list here is a default that the operators take as an argument, so that
another register of records can bring its own.
"""

from __future__ import annotations

# --- Fixed values: record families -----------------------------------------
PREFIX_TYPES = {
    "REG": "region",
    "STL": "settlement",
    "FAU": "fauna",
    "FLR": "flora",
    "MED": "health",
    "ACC": "accommodation",
    "INC": "incident",
    "POL": "policy",
    "KC": "knowledge_card",
    "WS": "monitoring",
    "SV": "monitoring",
    "FN": "field_note",
    "LAB": "field_note",
}
RECORD_PREFIXES = ["REG", "STL", "FAU", "FLR", "MED", "ACC", "INC", "POL", "KC"]

# --- Fixed values: named regions, in list order -----------------------------
REGIONS = {
    "luminous shelf": "REG-01",
    "emerald canopy": "REG-02",
    "cloudspine highlands": "REG-03",
    "silverreed wetlands": "REG-04",
    "obsidian reach": "REG-05",
    "whispering dunes": "REG-06",
    "deep current expanse": "REG-07",
    "mistroot basin": "REG-08",
    "aurora mangroves": "REG-09",
    "sunfall archipelago": "REG-10",
}

# --- Fixed values: heading shapes -------------------------------------------
_PFX = "|".join(RECORD_PREFIXES)
MD_RECORD_HEADING = rf"^###\s+(?:Knowledge Card\s+)?((?:{_PFX})-\d+)\s*[—–-]?\s*(.*)$"
MD_HEADING = r"^(#{1,3})\s+(.+)$"
MD_CHAPTER = r"^##\s+(\d+)\.\s+(.+)$"
PAGE_MARKER = r"^\[\[PAGE (\d+)\]\]$"
PLAIN_RECORD = r"^((?:REG|STL|FAU|FLR|MED|INC|POL|ACC|KC)-\d{2,3})\s*[—–-]\s*(.+)$"
PLAIN_CARD = r"(?i)^Knowledge Card\s+(KC-\d{2})\s*$"
PLAIN_SECTION = r"^(\d{1,2}\.\d{1,2})\s+(.{3,})$"
PLAIN_CHAPTER = r"^(\d{1,2})\.\s+([A-Z][^.]{3,})$"
PLAIN_APPENDIX_SECTION = r"^([A-Z]\.\d)\s+(.{3,})$"
PLAIN_APPENDIX = r"(?i)^Appendix\s+([A-Z])\s*[—–-]?\s*(.*)$"
PLAIN_NAMED = (
    r"(?i)^(Document Map and Retrieval Metadata|Document Control|PURPOSE|IMPORTANT NOTICE)\s*:?\s*$"
)
MAX_CHAPTER = 20
RUNNING_HEADERS = [r"(?i)^Page\s+\d+$"]

# --- Fixed values: identifiers ----------------------------------------------
TABLE_ROW_ID = r"\b(WS-\d+|SV-\d+)\b"
RECORD_ID_ANY = rf"\b(?:{_PFX})-\d+\b"
QUESTION_RECORD_ID = r"\b([A-Z]{2,4}-[A-Z0-9]{1,4})\b"
QUESTION_REGION_ID = r"\b(REG-\d{2})\b"
PROBE_ID = r"\b((?:REG|STL|FAU|FLR|MED|INC|POL|ACC|KC|WS|SV|FN|LAB)-[0-9A-Z]{1,3})\b"
CITATION = r"\[([A-Z]{2,4}-[A-Z0-9]+)\]"
ISO_DATE = r"\d{4}-\d{2}-\d{2}"
FIELD_NOTE = r"(Field Note|Laboratory Note)\s+((?:FN|LAB)-[A-Z])\b"
FIELD_NOTE_LABEL = r"Field Note FN-[AB]|Laboratory Note LAB-C"
UUID = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"

# --- Fixed values: size limits in characters --------------------------------
WINDOW_CHARS = 3200
WINDOW_OVERLAP = 480
BODY_CHARS = 1500
BODY_OVERLAP = 180
PAGE_CHARS = 3000
CSV_ROWS_PER_PAGE = 25
BOILERPLATE_KEY = 45
BOILERPLATE_SEGMENTS = 3
RECORD_AWARE_IDS = 50
NARRATIVE_PIECE = 200
UPLOAD_PIECE = 120
UPLOAD_HEADING = r"^#{1,3}\s+.+"
UPLOAD_BYTES = 10 * 1024 * 1024

# --- Fixed values: evidence quality phrases ---------------------------------
DISPUTED_PHRASES = [
    "chain-of-custody form was incomplete",
    "chain of custody",
    "did not confirm",
    "not directly comparable",
    "disputed",
]
TRADITION_PHRASES = ["tradition", "ceremon", "oral histor", "community knowledge", "ancestr"]
MODELED_PHRASES = ["carrying capacity", "estimate", "projected", "modeled", "modelled"]

STRICT_DISPUTED_PHRASES = [
    "chain-of-custody form was incomplete",
    "chain of custody was incomplete",
    "did not confirm that material entered",
    "but did not confirm",
]
STRICT_PROVISIONAL_PHRASES = [
    "these are hypotheses, not confirmed findings",
    "plausible causes",
    "may change as evidence is collected",
    "suggests",
]
STRICT_TRADITION_PHRASES = ["traditional", "oral knowledge", "community tradition", "elders"]
STRICT_TABLE_COMMENTS = "poor visibility|not directly comparable|blocked access"

NAVIGATIONAL_TITLES = (
    "document map|document control|recommended test questions|retrieval grounding rules"
    "|glossary|front matter|purpose|important notice"
)
NAVIGATIONAL_SECTION = r"^15\.[123]$"
PRIORS = {"shared_protocol": 0.62, "knowledge_card": 0.5, "chapter": 0.85}
NAVIGATIONAL_PRIOR = 0.3
TRIAGE_BOOST = {"critical": 1.5, "high": 1.3, "medium": 1.1}

# --- Fixed values: display labels -------------------------------------------
TYPE_LABELS = {
    "region": "Region",
    "settlement": "Settlement",
    "fauna": "Species",
    "flora": "Flora",
    "health": "Clinical",
    "incident": "Incident",
    "policy": "Policy",
    "accommodation": "Accommodation",
    "knowledge_card": "Knowledge card",
    "monitoring": "Monitoring",
    "field_note": "Field note",
    "section": "Section",
    "chapter": "Chapter",
    "appendix": "Appendix",
    "shared_protocol": "Shared protocol",
    "narrative": "Narrative",
}
QUALITY_LABELS = {
    "verified observation": "Verified observation",
    "community tradition": "Community tradition",
    "provisional interpretation": "Provisional interpretation",
    "modeled estimate": "Modeled estimate",
    "disputed report": "Disputed report",
    "documented protocol": "Documented protocol",
}
ACCESS_LABELS = {
    "public": "Public",
    "community-limited": "Community-limited",
    "healer-limited": "Healer-limited",
    "guardian-limited": "Guardian-limited",
}

# --- Fixed values: role clearance -------------------------------------------
ROLE_ACCESS = {
    "guardian": ["public", "community-limited", "guardian-limited"],
    "healer": ["public", "community-limited", "healer-limited"],
    "researcher": ["public", "community-limited", "guardian-limited"],
    "citizen": ["public"],
}

# --- Fixed values: lexical index --------------------------------------------
STOP_WORDS = """
a an and are as at be been but by can could did do does for from had has have how
i if in into is it its may might must of on or our should so than that the their them
then there these they this to was we were what when where which who why will with would
you your
""".split()
BM25_K1 = 1.5
BM25_B = 0.75

# --- Fixed values: hashed embedding and fusion ------------------------------
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
HASH_DIM = 384
RRF_K = 60
CANDIDATES = 40
SEARCH_CANDIDATES = 30
FINAL_K = 6
MMR_LAMBDA = 0.72
NEAR_DUPLICATE = 0.94
RELEVANCE_FLOOR = 0.622
FLOOR_TOP = 5
MAX_HIGHLIGHTS = 12
CLUSTER_FACTOR = 0.9

# --- Fixed values: query vocabulary -----------------------------------------
SYNONYMS = {
    "water": ["turbidity", "salinity", "dissolved oxygen", "drinking water"],
    "colour": ["color", "turquoise", "discolouration"],
    "color": ["turquoise", "green tint", "yellow plume"],
    "sick": ["symptoms", "illness", "clinical", "red flags"],
    "ill": ["symptoms", "illness", "clinical"],
    "fish": ["marine", "species", "fauna", "grazer"],
    "dying": ["mortality", "dead", "distress"],
    "coral": ["reef", "bleaching", "recruitment"],
    "storm": ["cyclone", "deep current", "evacuation"],
    "emergency": ["incident", "response", "immediate actions", "exclusion boundary"],
    "rules": ["policy", "core rule"],
    "tradition": ["community", "cultural practices", "oral knowledge"],
    "volcano": ["volcanic", "vent", "geothermal", "ashfall"],
    "volcanic": ["vent", "plume", "obsidian reach"],
    "contamination": ["contaminated", "pollution", "exclusion zone"],
    "urgent": ["critical", "emergency", "priority"],
}
TRIAGE_INTENT = (
    r"(?i)\b(first|priority|prioriti[sz]e|urgent|most critical|immediate attention|triage|worst)\b"
)
COMPARISON_INTENT = (
    r"(?i)\b(compare|comparison|versus|vs\.?|difference between|differences between|contrast)\b"
)
ASPECT_SPLIT = r"(?i)\s+(?:and|versus|vs\.?|with|against|or)\s+"
SUBQUERY_SEPARATORS = [" versus ", " vs. ", " vs ", " and ", " with "]

COMPARE_TERMS = [
    "compare", "comparison", "versus", " vs ", " vs.", "difference between",
    "differences between", "contrast", "side by side",
]
SUMMARISE_TERMS = ["summarize", "summarise", "across the reports", "across reports", "overview of"]
SPECIES_TERMS = [
    "species", "fauna", "flora", "animal", "fish", "creature", "wildlife",
    "habitat", "coral", "reef life", "marine life", "plant",
]
ACTION_TERMS = [
    "what should we do", "what do we do", "immediate", "respond", "response",
    "how do we", "what actions", "next steps", "protocol", "procedure", "evacuat",
]
CAUSE_TERMS = [
    "what caused", "why did", "why is", "why are", "investigate", "cause of",
    "what happened", "explain the",
]
INCIDENT_TERMS = [
    "turned", "discolour", "discolor", "dead", "dying", "died", "smell", "odor", "odour",
    "spill", "leak", "contamina", "sick", "illness", "ill after", "rash", "leaving the area",
    "fish are leaving", "bloom", "plume", "eruption", "flood", "storm damage", "washed up",
    "no longer", "disappear", "unusual", "foam", "oil", "turbid",
]
TYPE_HINTS = [
    (["species", "creature", "animal", "fauna", "wildlife", "fish", "bird", "plant",
      "flora", "coral", "habitat", "vulnerable", "endangered"],
     ["fauna", "flora", "region", "policy"]),
    (["symptom", "sick", "illness", "injur", "treat", "first aid", "poison",
      "sting", "exposure", "medical", "health"],
     ["health", "knowledge_card", "incident"]),
    (["village", "settlement", "community", "clan", "population", "resident"],
     ["settlement", "region", "policy"]),
    (["rule", "policy", "regulation", "permit", "protocol", "law", "prohibited",
      "allowed", "authoris", "authoriz"],
     ["policy", "knowledge_card"]),
    (["reading", "measurement", "station", "survey", "sensor", "sample",
      "turbidity", "salinity", "ph "],
     ["monitoring", "field_note", "incident"]),
    (["incident", "spill", "contamination", "damage", "stranding", "response",
      "emergency", "evacuat", "what should", "what actions", "immediate action"],
     ["incident", "knowledge_card", "policy", "field_note"]),
]

# --- Fixed values: section profiles -----------------------------------------
# (owner, section, display order, record types, focus words, reason when empty)
PROFILES = [
    ("marine_life_protector", "affected_species", 2,
     ["fauna", "flora", "policy", "region", "knowledge_card"],
     "species habitat pressures protection guidance",
     "No species records matched this query"),
    ("incident_investigator", "likely_causes", 3,
     ["incident", "monitoring", "field_note", "region", "narrative"],
     "plausible causes incident readings field notes observations",
     "Cause not established — no incident record matched this situation"),
    ("emergency_responder", "recommended_actions", 4,
     ["incident", "knowledge_card", "health", "settlement", "policy", "narrative"],
     "immediate actions response protocol checklist safety communication",
     "No documented protocol retrieved — recommend field investigation"),
]
SCALE_QUERY = "water incident classification W1 W2 W3 W4 observation advisory emergency regional crisis"

# --- Fixed values: grounding rules ------------------------------------------
RULE_NAMES = {
    1: "Cite record IDs for specific claims",
    2: "Multiple causes stay hypotheses",
    3: "Do not merge similar records",
    4: "Preserve time and location",
    5: "Health answers carry red flags + disclaimer",
    6: "State when evidence is absent",
    7: "Summarise conflicts and reliability limits",
    8: "Separate documented from inferred",
}
HEDGE_TERMS = [
    "hypothes", "plausible", "possible", "may ", "might ", "could ",
    "not confirmed", "no confirmed", "cannot be confirmed", "unconfirmed",
    "remain possible", "not established", "suggests",
]
CONFLICT_TERMS = [
    "disagree", "conflict", "contradict", "chain of custody",
    "chain-of-custody", "not directly comparable", "differ",
]
INFERENCE_MARKERS = ["model inference", "inference:", "**inference"]
MULTI_CAUSE_PHRASES = ["plausible causes", "these are hypotheses"]
MERGE_SENSITIVE = ["fauna", "flora", "incident", "settlement"]
RED_FLAG_TERMS = ["red flag", "seek", "urgent", "refer", "warning sign"]
DISCLAIMER_TERMS = ["fictional", "training material", "not medical advice"]
ABSENCE_PHRASE = "does not contain sufficient evidence"
PLACEHOLDER = r"\[(?:[a-z][a-z /_-]{1,24})\]"
SENTENCE_SPLIT = r"(?<=[.!?])\s+(?=[A-Z*\-#\[])"
MIN_CLAIM = 25
LIMITATIONS = [
    ("chain-of-custody", "incomplete chain of custody on the laboratory sample"),
    ("chain of custody", "incomplete chain of custody on the laboratory sample"),
    ("not directly comparable", "survey effort not normalised between counts"),
    ("unconfirmed", "observation was never independently confirmed"),
]
DEFAULT_LIMITATION = "unverified or challenged evidence"

# --- Fixed values: report vocabulary ----------------------------------------
INSUFFICIENT_MESSAGE = (
    "The available knowledge base does not contain sufficient evidence to answer this question."
)
WHAT_WOULD_RESOLVE = (
    "Field investigation and additional properly documented sampling. "
    "See Appendix A — investigation checklists."
)
CONFIDENCE_LEVELS = {
    "high": "high", "moderate": "moderate", "medium": "moderate",
    "low": "low", "insufficient": "insufficient",
}
PRIORITY_CLASSES = {
    "w1": "W1", "w2": "W2", "w3": "W3", "w4": "W4", "informational": "informational",
}
SECTION_TYPES = ["affected_species", "likely_causes", "recommended_actions"]
SECTION_STATUSES = ["filled", "empty", "timed_out", "not_applicable"]
OWNING_AGENTS = [
    "marine_life_protector", "incident_investigator", "emergency_responder", "orchestrator",
]
USE_CASES = [
    "Environmental Incident Investigation", "Marine-Life Protection", "Emergency Response",
    "Community Knowledge Assistant", "Sustainable Resource Management", "Research Assistant",
]
QUERY_SHAPES = ["simple", "compare", "summarize"]
CONTENT_KINDS = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/csv": "csv",
    "text/plain": "txt",
    "text/markdown": "txt",
}
EXTENSION_KINDS = {"pdf": "pdf", "docx": "docx", "csv": "csv", "txt": "txt", "md": "txt"}
STEP_TYPES = [
    "query.received", "query.rewritten", "query.classified", "priority.classified", "map.zone_lit", "route.decided",
    "retrieval.started", "retrieval.completed", "agent.thinking", "section.filling", "section.completed",
    "section.unavailable", "agent.completed", "agent.timed_out", "conflict.detected", "validation.running",
    "validation.result", "synthesis.started", "answer.streaming", "answer.completed", "error",
]
TERMINAL_STEPS = ["answer.completed", "error"]
UNSTABLE_SPREAD = 25

# ---- search filters ----------------------------------------------------------
#: Column of a question (an array, NULL for no filter) and the column of a chunk that it restricts.
FILTERS = {"allowed": "label", "record_types": "record_type", "region_ids": "region_id", "record_ids": "record_id", "doc_ids": "doc_id"}
