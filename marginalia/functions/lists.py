"""Word lists and patterns that carry the semantics of keyword, heading and request rules."""

# Words that are too general to search for.
QUERY_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "can", "may", "might", "must", "shall",
    "what", "who", "when", "why", "how", "which", "where", "what's", "who's", "when's", "why's", "how's", "where's",
    "book", "books", "argument", "arguments", "main", "primary", "central", "key", "basic", "fundamental",
    "health", "report", "analysis", "study", "data", "information", "research", "development",
    "project", "system", "program", "policy", "economic", "political", "social", "international",
    "global", "national", "regional", "local", "major", "important", "significant", "current",
    "recent", "new", "old", "good", "bad", "high", "low", "large", "small", "big", "great",
    "many", "few", "most", "some", "all", "any", "every", "each", "other", "another", "such",
    "more", "less", "much", "little", "very", "quite", "rather", "pretty", "really", "just",
    "only", "also", "even", "still", "yet", "already", "now", "then", "here", "there",
    "that", "this", "these", "those", "find", "show", "tell", "explain", "describe",
]

# Words that score little by themselves.
SCORING_STOP_WORDS = [
    "health", "report", "analysis", "study", "data", "information", "research", "development",
    "project", "system", "program", "policy", "economic", "political", "social", "international",
    "global", "national", "regional", "local", "major", "important", "significant", "current",
    "recent", "new", "old", "good", "bad", "high", "low", "large", "small", "big", "great",
    "china", "chinese", "country", "countries", "government", "state", "public", "private",
]

# What a heading is not, any case.
HEADING_NEGATIVE = [
    r"^[A-Z][a-z]+ Theory [A-Z][a-z]+ Prac$",
    r"^DOI\s+10\.",
    r"^[A-Z][a-z]+\s+[A-Z][a-z]+$",
    r"^Accepted:.*\d{4}",
    r"^.*Springer.*\d{4}$",
    r"^Keywords?\s*$",
    r"^Abstract\s*$",
    r"^\w{1,4}\s*$",
    r"^\.\s*\w+",
    r"^#\s*\w+",
    r"^\d{4}[\s\-]\d{4}$",
    r"^[A-Z]{2,}[\s\-][A-Z]{2,}$",
]
# What surely is a heading; the first two by case, the others any case.
HEADING_STRONG_CASED = [r"^\d+\.?\s+[A-Z]", r"^\d+\.\d+"]
HEADING_STRONG = [
    r"^(Chapter|Section|Part|Appendix)\s+",
    r"^(Introduction|Conclusion|Discussion|Methods?|Results?|Analysis|Background)",
    r"^(Abstract|Summary|References|Bibliography|Acknowledgments)",
]
# How list items begin; the fourth in any case.
LIST_ITEM = [r"^\s*[•\-\*\+]\s+", r"^\s*\d+[\.\)]\s+", r"^\s*[a-zA-Z][\.\)]\s+", r"^\s*[ivxlcdmIVXLCDM]+[\.\)]\s+", r"^\s*\(\d+\)\s+", r"^\s*\([a-zA-Z]\)\s+"]

# Headings that open no section, and those that do, any case.
SECTION_NEGATIVE = [
    r"^[A-Z][a-z]+ Theory [A-Z][a-z]+ Prac$",
    r"^DOI\s+10\.",
    r"^[A-Z][a-z]+ [A-Z][a-z]+$",
    r"^Accepted:.*\d{4}",
    r"^.*Springer.*\d{4}$",
    r"^Keywords?\s*$",
    r"^Abstract\s*$",
    r"^\w{1,3}\s*$",
    r"^\.\s*\w+$",
]
SECTION_POSITIVE = [
    r"^\d+\s+",
    r"^\d+\.\d+",
    r"^(Introduction|Conclusion|Discussion|Methods?|Results?|Analysis|Background)",
    r"^(Abstract|Summary)$",
    r"[A-Z][a-z]+.*[A-Z][a-z]+",
]

# What a question asks for, as parts of its text.
TABLE_REQUEST = ["table", "tables", "tabular", "data table", "spreadsheet", "rows and columns"]
FIGURE_REQUEST = ["figure", "figures", "fig", "image", "images", "chart", "charts", "graph", "graphs", "diagram", "diagrams", "illustration", "illustrations", "plot", "plots", "visual", "visuals"]
PARENT_REQUEST = ["overview", "summary", "entire section", "full context", "complete", "comprehensive"]
VISUAL_QUESTION = ["figure", "table", "chart", "graph", "image", "diagram", "show me"]
COMPLEX_QUESTION = ["compare", "contrast", "analyze", "synthesize", "evaluate", "comprehensive"]
SIMPLE_QUESTION = ["what is", "who is", "when did", "define", "list", "name"]
FIGURE_CONTENT = ["figure shows", "image depicts", "chart illustrates", "graph displays"]
