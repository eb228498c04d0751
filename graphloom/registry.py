"""The typed vocabulary of the knowledge graph: node types, layers, relations, rules and word lists."""

from __future__ import annotations

# The 22 node types and the layer of each.
LAYERS = {
    "Capability": "Strategy",
    "BusinessActor": "Business",
    "BusinessRole": "Business",
    "BusinessProcess": "Business",
    "BusinessFunction": "Business",
    "BusinessService": "Business",
    "BusinessObject": "Business",
    "Contract": "Business",
    "ApplicationComponent": "Application",
    "ApplicationService": "Application",
    "ApplicationInterface": "Application",
    "DataObject": "Application",
    "Node": "Technology",
    "Device": "Technology",
    "SystemSoftware": "Technology",
    "TechnologyService": "Technology",
    "Artifact": "Technology",
    "CommunicationNetwork": "Technology",
    "Goal": "Motivation",
    "Requirement": "Motivation",
    "Constraint": "Motivation",
    "Stakeholder": "Motivation",
}
NODE_TYPES = tuple(LAYERS)

# The 11 relations.
RELATIONS = (
    "Composition", "Aggregation", "Assignment", "Realization", "Serving", "Access",
    "Influence", "Association", "Triggering", "Flow", "Specialization",
)

# What a hop keeps of the confidence, by the edge's label. No label counts as EXTRACTED.
CONFIDENCE_FACTOR = {"EXTRACTED": 1.0, "INFERRED": 0.5, "AMBIGUOUS": 0.0}

# Layers from abstract to concrete, and the relations whose direction follows them.
LAYER_RANK = {"Motivation": 0, "Strategy": 1, "Business": 2, "Application": 3, "Technology": 4, "Physical": 5}
TOWARDS_ABSTRACT = ("Realization", "Serving", "Access")
TOWARDS_CONCRETE = ("Assignment",)

# English and Italian words that are no keywords.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "and", "or", "not", "it", "its", "un", "una", "il", "la",
    "le", "di", "da", "del", "che", "per", "con", "come", "sono", "nel", "dei", "gli", "ha", "which", "what", "how", "does", "who", "when", "where",
    "this", "that", "esiste", "quale", "quali", "cosa", "chi", "dove", "quando",
)

# Free-form verbs and the relation that each names.
VERBS = {
    "USES": "Serving",
    "UTILIZES": "Serving",
    "PROVIDES_SERVICES_TO": "Serving",
    "PROVIDES": "Serving",
    "SERVES": "Serving",
    "SUPPORTS": "Serving",
    "ENABLES": "Serving",
    "REQUIRES": "Serving",
    "DEPENDS_ON": "Serving",
    "RELIES_ON": "Serving",
    "BASED_ON": "Serving",
    "MANAGES": "Serving",
    "OPERATES_IN": "Assignment",
    "OPERATES_VIA": "Assignment",
    "WORKS_IN": "Assignment",
    "WORKS_FOR": "Assignment",
    "RESPONSIBLE_FOR": "Assignment",
    "ASSIGNED_TO": "Assignment",
    "AUTHORED": "Assignment",
    "WRITTEN_BY": "Assignment",
    "PREFACED": "Assignment",
    "CONTRIBUTED_TO": "Assignment",
    "APPLIED_TO": "Assignment",
    "CONTAINS": "Composition",
    "COMPOSED_OF": "Composition",
    "INCLUDES": "Aggregation",
    "INCLUDES_PATTERN": "Aggregation",
    "HAS_DIVISION": "Aggregation",
    "HAS_PART": "Aggregation",
    "COMPRISES": "Aggregation",
    "GROUPS": "Aggregation",
    "IMPLEMENTS": "Realization",
    "IMPLEMENTED_WITH": "Realization",
    "REALIZES": "Realization",
    "DEVELOPS": "Realization",
    "CONCRETIZES": "Realization",
    "INFLUENCES": "Influence",
    "IMPACTS": "Influence",
    "IMPACTS_ON": "Influence",
    "IMPROVES": "Influence",
    "ENHANCES": "Influence",
    "GUIDES": "Influence",
    "CRUCIAL_FOR": "Influence",
    "ESSENTIAL_FOR": "Influence",
    "REDUCES": "Influence",
    "INCREASES": "Influence",
    "FOLLOWS_PROCESS": "Triggering",
    "PRECEDES": "Triggering",
    "ACTIVATES": "Triggering",
    "TRIGGERS": "Triggering",
    "TRANSFERS": "Flow",
    "SENDS": "Flow",
    "RECEIVES": "Flow",
    "FLOWS": "Flow",
    "ACCESSES": "Access",
    "READS": "Access",
    "WRITES": "Access",
    "MODIFIES": "Access",
    "PUBLISHES": "Access",
    "STUDIES": "Access",
    "MEASURED_BY": "Access",
    "ASSOCIATED_WITH": "Association",
    "LINKED_TO": "Association",
    "RELATED_TO": "Association",
    "CONNECTED_TO": "Association",
    "ACQUIRES": "Association",
    "INVESTS_IN": "Association",
    "ENGAGED_IN": "Association",
    "FOCUSES_ON": "Association",
    "MERGES_WITH": "Association",
    "DONATES_ROYALTIES_TO": "Association",
    "CONTROLLED_BY": "Association",
    "COLLABORATES_WITH": "Association",
}

# Words that tell a name's node type; the first line that fits counts.
NAME_WORDS = (
    ("Node", r"server|vm|cluster|k8s|kubernetes|gke|aks|eks|host"),
    ("Device", r"router|firewall|switch|load.?balancer|hardware|device"),
    ("SystemSoftware", r"oracle|mysql|postgres|redis|linux|windows|docker|tomcat|nginx|apache|jdk|jre|dbms|os\b|runtime|mongodb|elasticsearch"),
    ("Artifact", r"\.jar|\.war|\.ear|\.zip|\.tar|dockerfile|docker-compose|helm|artifact|image|package"),
    ("CommunicationNetwork", r"lan|wan|vpn|network|internet|intranet|dmz"),
    ("TechnologyService", r"dns|storage.?service|hosting|messaging|message.?queue|monitoring.?service"),
    ("ApplicationInterface", r"api|endpoint|rest|graphql|soap|grpc|interface"),
    ("ApplicationComponent", r"crm|erp|sap|salesforce|jira|confluence|portal|app\b|application|tool|framework|library|sdk|platform.?engineering"),
    ("DataObject", r"record|dataset|data.?object|schema|database"),
    ("BusinessActor", r"team|department|organization|company|group"),
    ("BusinessRole", r"role|owner|steward"),
    ("BusinessProcess", r"process|workflow|procedure|onboarding|fulfillment|billing|delivery|development|engineering|deployment|feedback.?loop|migration"),
    ("BusinessFunction", r"function|finance|hr|operations|marketing|governance|compliance"),
    ("BusinessService", r"service"),
    ("Contract", r"contract|sla|agreement|nda"),
    ("Stakeholder", r"stakeholder|cto|ceo|cio|cfo|architect|board|director"),
    ("Goal", r"goal|target|strategy|increase|reduce|improve|success"),
    ("Requirement", r"requirement|shall|must"),
    ("Constraint", r"constraint|limitation|budget|compliance|gdpr"),
    ("Capability", r"capability|ability|competency|adoption|transformation|adaptation|agility|model|maturity|readiness|value.?stream|stream.?management"),
    ("BusinessObject", r"research|study|report|survey|analysis|paper|methodology|framework|model|standard|pattern|architecture|culture|practice|principle"),
)

# The ten rules that ship with the engine.
RULES = (
    {"rule_id": "ARCH-001", "severity": "warning", "type": "minimum_connections", "entity_type": "ApplicationComponent", "rel_type": "Serving", "direction": "outgoing", "min_count": 1},
    {"rule_id": "ARCH-002", "severity": "error", "type": "forbidden_edge", "source_type": "SystemSoftware", "target_type": "BusinessProcess", "rel_type": "Serving"},
    {"rule_id": "ARCH-003", "severity": "warning", "type": "minimum_connections", "entity_type": "BusinessProcess", "rel_type": "Serving", "direction": "incoming", "min_count": 1},
    {"rule_id": "ARCH-004", "severity": "warning", "type": "minimum_connections", "entity_type": "DataObject", "rel_type": "Access", "direction": "incoming", "min_count": 1},
    {"rule_id": "QUAL-001", "severity": "warning", "type": "no_orphans"},
    {"rule_id": "QUAL-002", "severity": "info", "type": "ambiguous_only"},
    {"rule_id": "QUAL-003", "severity": "info", "type": "high_fan_in", "entity_type": "DataObject", "rel_type": "Access", "threshold": 3},
    {"rule_id": "COMP-001", "severity": "warning", "type": "min_entities_per_doc", "min_count": 5},
    {"rule_id": "COMP-002", "severity": "error", "type": "layer_coverage", "required_layers": ["Business", "Application", "Technology", "Motivation"]},
    {"rule_id": "DG-001", "severity": "warning", "type": "high_fan_in", "entity_type": "DataObject", "rel_type": "Access", "threshold": 3},
)
