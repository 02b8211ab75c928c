"""The item model: long form, one row per item of an envelope's ordered arrays."""

#: Arrays in the order in which an envelope lists them.
ARRAY_KEYS = ("actors", "instructions", "facts", "assumptions", "constraints", "preferences", "decisions", "questions", "conversation", "resources", "entities", "relationships", "memory", "tools", "toolResults")
#: Arrays in the order in which selection fills a budget.
SECTIONS = ("instructions", "actors", "constraints", "facts", "assumptions", "decisions", "preferences", "entities", "relationships", "memory", "resources", "conversation", "tools", "toolResults", "questions")
#: Sections of the context block: neither instructions nor conversation.
CONTEXT_SECTIONS = tuple(s for s in SECTIONS if s not in ("instructions", "conversation"))
#: Headings of the sections.
SECTION_TITLES = {"actors": "Actors", "instructions": "Instructions", "facts": "Facts", "assumptions": "Assumptions", "constraints": "Constraints", "preferences": "Preferences", "decisions": "Decisions", "questions": "Questions", "conversation": "Conversation", "resources": "Resources", "entities": "Entities", "relationships": "Relationships", "memory": "Memory", "tools": "Tools", "toolResults": "Tool Results"}
SENSITIVITY = ("public", "internal", "confidential", "restricted", "personal", "secret")
DEFAULT_RULE = dict(zip(SENSITIVITY, ("allow", "allow", "redact", "exclude", "redact", "exclude"), strict=True))
AUTHORITY = ("system", "developer", "application", "user", "tool", "retrieved-content")
CONFIRMED_TYPES = ("Fact", "Decision", "Instruction", "Constraint")
ELLIPSIS = "…"
