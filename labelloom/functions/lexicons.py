"""Word lists and tables that results depend on.

Lemma and synonym lexicons are not here; they are tables a caller passes in.
"""

# Abbreviations and their long forms.
ABBREVIATIONS = {
    "p&c": "property and casualty",
    "wc": "workers compensation",
    "gl": "general liability",
    "pi": "professional indemnity",
    "cyber": "cybersecurity insurance",
    "ul": "universal life",
    "ltc": "long term care",
    "d&o": "directors and officers",
    "a&h": "accident and health",
    "e&o": "errors and omissions",
    "b2b": "business to business",
    "b2c": "business to consumer",
}

# Compound phrases that cleaning protects.
PROTECTED_PHRASES = [
    "cyber-security",
    "e-commerce",
    "property & casualty",
    "health & safety",
    "business-to-business",
    "business-to-consumer",
    "third-party",
    "third party",
]

# Legal forms deleted from company names, in matching order.
LEGAL_SUFFIXES = [
    "Inc", "LLC", "Ltd", "Corp", "Corporation", "Limited", "GmbH", "PLC",
    "LP", "LLP", "SA", "AG", "BV", "SRL", "SpA", "NV", "Co",
]

# English stop words (the public NLTK list, without the
# contractions, which cannot occur once apostrophes have become spaces).
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "your", "yours", "yourself", "yourselves", "he", "him", "his",
    "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who",
    "whom", "this", "that", "these", "those", "am", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with",
    "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out",
    "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both",
    "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "don", "should", "now", "d", "ll", "m", "o",
    "re", "ve", "y", "ain", "aren", "couldn", "didn", "doesn", "hadn",
    "hasn", "haven", "isn", "ma", "mightn", "mustn", "needn", "shan",
    "shouldn", "wasn", "weren", "won", "wouldn",
]

# Insurance stop words, and the words that are always kept.
INSURANCE_STOP_WORDS = [
    "insurance", "insure", "policy", "policies", "coverage", "claim",
    "claims", "premium", "premiums", "risk", "risks", "underwrite",
    "underwriting",
]
KEPT_WORDS = [
    "insurance", "risk", "liability", "coverage", "policy", "claim",
    "premium",
]

STOP_WORDS = [
    w for w in ENGLISH_STOP_WORDS + INSURANCE_STOP_WORDS if w not in KEPT_WORDS
]

# Industry keywords that become is_<keyword> flags.
INDUSTRY_KEYWORDS = [
    "technology", "healthcare", "finance", "insurance", "retail",
    "manufacturing", "energy", "education", "transportation", "media",
    "telecommunications", "hospitality", "construction", "liability",
    "property", "casualty", "life", "health", "commercial", "residential",
    "automotive", "cyber", "underwriting",
]

# Insurance sectors and the keywords that point to them.
SECTOR_KEYWORDS = {
    "property": [
        "building", "real estate", "property", "housing", "commercial property",
        "residential", "construction", "office", "earthquake", "flood",
    ],
    "liability": [
        "professional", "malpractice", "errors", "omissions", "directors",
        "officers", "product liability", "public liability",
        "employer liability",
    ],
    "health": [
        "medical", "health", "dental", "vision", "disability", "wellness",
        "illness", "hospital", "clinical", "pharmaceutical",
    ],
    "life": [
        "life", "death", "terminal", "mortality", "retirement", "pension",
        "annuity", "saving", "investment",
    ],
    "auto": [
        "vehicle", "car", "truck", "fleet", "commercial auto", "personal auto",
        "driver", "collision", "comprehensive", "transportation",
    ],
    "cyber": [
        "data", "breach", "privacy", "security", "cyber", "information",
        "digital", "hack", "technology", "internet",
    ],
    "business": [
        "business", "commercial", "enterprise", "corporate", "company",
        "interruption", "operation", "revenue", "income",
    ],
    "workers_comp": [
        "employee", "worker", "injury", "compensation", "occupational",
        "workplace", "safety", "accident", "disability", "hazard",
    ],
    "specialty": [
        "marine", "aviation", "travel", "event", "pet", "art", "agriculture",
        "energy", "environmental", "political",
    ],
}

# Synonyms used when a taxonomy label is expanded.
LABEL_SYNONYMS = {
    "Real Estate": ["property", "realty", "housing", "buildings", "land"],
    "Construction": ["building", "contracting", "development", "infrastructure"],
    "Financial": ["finance", "banking", "investment", "monetary", "fiscal"],
    "Insurance": [
        "insurer", "coverage", "underwriting", "policy", "risk management",
    ],
    "Manufacturing": ["production", "fabrication", "industrial", "factory"],
    "Technology": [
        "tech", "IT", "digital", "software", "computing", "information systems",
    ],
    "Healthcare": ["medical", "health", "clinical", "patient care", "wellness"],
    "Transportation": ["logistics", "shipping", "freight", "transit", "fleet"],
    "Consulting": ["advisory", "counseling", "professional services"],
    "Retail": ["sales", "commerce", "merchandising", "store", "shop"],
}

# Texts read as null in CSV input (the pandas defaults).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# How often each cleaned column enters the combined text.
COLUMN_REPEATS = {
    "cleaned_description": 10,
    "cleaned_tags": 15,
    "cleaned_sector": 20,
    "cleaned_category": 20,
    "cleaned_niche": 25,
}
