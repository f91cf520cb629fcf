"""Word lists, patterns and limits that results depend on. All are defaults and can be replaced by parameters."""

from __future__ import annotations

# They must equal those of the analysed system for equal results.
CATEGORIES = {
    "Bug Report": ("bug", "error", "crash", "broken", "fix", "issue with", "not working", "problem with"),
    "Feature Request": ("feature", "request", "add", "implement", "would be nice", "suggestion", "enhancement", "improve"),
    "Support": ("help", "support", "how do", "how to", "problem", "question", "assistance", "guide"),
    "Feedback": ("thank", "great", "love", "awesome", "excellent", "feedback", "review", "opinion"),
    "Sales": ("price", "cost", "subscription", "pay", "billing", "purchase", "buy", "plan"),
    "Documentation": ("document", "api", "guide", "tutorial", "reference", "manual", "instruction"),
}
CASCADE = {
    "Bug Report": ("bug", "error", "crash", "broken", "fix", "issue with"),
    "Feature Request": ("feature", "request", "add", "implement", "would be nice"),
    "Support": ("help", "support", "how do", "how to", "problem"),
    "Feedback": ("thank", "great", "love", "awesome", "excellent"),
    "Sales": ("price", "cost", "subscription", "pay", "billing"),
    "Documentation": ("document", "api", "guide", "tutorial", "reference"),
}
CASCADE_SHORT = {
    "Bug Report": ("bug", "error", "crash", "broken", "fix"),
    "Feature Request": ("feature", "request", "add", "implement"),
    "Support": ("help", "support", "issue", "problem"),
    "Feedback": ("thank", "great", "love", "awesome"),
    "Sales": ("price", "cost", "subscription", "pay"),
    "Documentation": ("document", "api", "guide", "tutorial"),
}
POSITIVE = (
    "good", "great", "excellent", "amazing", "wonderful", "fantastic", "love", "perfect", "awesome", "helpful", "thank",
    "appreciate", "happy", "pleased", "satisfied", "brilliant", "outstanding", "superb", "magnificent",
)
NEGATIVE = (
    "bad", "terrible", "awful", "horrible", "hate", "angry", "frustrated", "annoyed", "disappointed", "broken", "error",
    "crash", "bug", "fail", "wrong", "useless", "worst", "disgusted", "furious", "outraged",
)
TOPICS = {
    "authentication": ("login", "password", "signin", "signup", "auth"),
    "billing": ("payment", "charge", "invoice", "billing", "subscription"),
    "technical": ("api", "code", "error", "bug", "integration"),
    "feature": ("feature", "functionality", "capability", "tool"),
    "performance": ("slow", "fast", "performance", "speed", "optimization"),
    "ui_ux": ("interface", "design", "user experience", "dashboard", "navigation"),
}
CATEGORY_TEXT = {
    "Bug Report": "Technical issues and system problems reported by users",
    "Feature Request": "User suggestions for new features and improvements",
    "Support": "Customer support and technical assistance requests",
    "Feedback": "User feedback, testimonials and reviews",
    "Sales": "Pricing inquiries and subscription questions",
    "Documentation": "Documentation and API reference requests",
    "General": "General conversation topics and discussions",
}
CATEGORY_KEYWORDS = {
    "Bug Report": ("bug", "error", "crash", "broken", "fix", "issue"),
    "Feature Request": ("feature", "request", "add", "implement", "enhancement"),
    "Support": ("help", "support", "how to", "question", "assistance"),
    "Feedback": ("feedback", "review", "opinion", "great", "love"),
    "Sales": ("price", "cost", "subscription", "billing", "purchase"),
    "Documentation": ("documentation", "api", "guide", "tutorial", "reference"),
    "General": ("conversation", "discussion", "chat"),
}
STOP_WORDS = (
    "the", "is", "at", "which", "on", "a", "an", "and", "or", "but", "in", "with", "to", "for", "of", "as", "by",
    "that", "this", "it", "from", "they", "we", "say", "her", "she", "he", "has", "had",
)
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"
PII = {
    "email": EMAIL,
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": SSN,
    "credit_card": CARD,
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}
PII_LOOSE = {"email": EMAIL, "phone": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "ssn": SSN, "credit_card": CARD}
REDACT = {
    "email": (EMAIL, "[EMAIL]"),
    "phone": (r"\b(?:\+?1[-.]?)?\(?([0-9]{3})\)?[-.]?([0-9]{3})[-.]?([0-9]{4})\b", "[PHONE]"),
    "ssn": (SSN, "[SSN]"),
    "credit_card": (CARD, "[CREDIT_CARD]"),
}
NAME_INDICATORS = ("my name is", "i am", "i'm", "call me")
SENSITIVE = ("personal", "private", "confidential", "secret", "password", "ssn", "credit")
MOJIBAKE = (
    ("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ('â€"', "—"), ("â€¦", "..."), ("Ã©", "é"), ("Ã¨", "è"), ("Ã ", "à"),
    ("Ã¢", "â"), ("Ã§", "ç"), ("Ã´", "ô"), ("Ã®", "î"), ("Ã¯", "ï"), ("Ã«", "ë"), ("Ã¼", "ü"), ("Ã¶", "ö"),
    ("Ã¤", "ä"), ("â€‹", ""), ("​", ""), ("﻿", ""),
)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"))
SCRIPTS = (
    ("zh", "4E00", "9FFF"), ("ja", "3040", "30FF"), ("ko", "AC00", "D7AF"), ("ar", "0600", "06FF"),
    ("ru", "0400", "04FF"), ("he", "0590", "05FF"),
)
INDICATORS = {
    "en": (
        "the", "is", "are", "was", "were", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could",
        "should", "may", "might", "can", "must", "shall", "to", "of", "in", "for", "on", "with", "at", "from", "by",
        "about", "into", "through", "during", "before", "after",
    ),
    "es": ("el", "la", "de", "que", "es", "en", "un", "por", "con", "para"),
    "fr": ("le", "de", "un", "être", "et", "à", "il", "avoir", "ne", "je"),
    "de": ("der", "die", "das", "ist", "ich", "nicht", "ein", "zu", "haben", "werden"),
}
LANGUAGE_NAMES = {
    "en": "English", "es": "Spanish", "fr": "French", "de": "German", "zh": "Chinese", "ja": "Japanese", "ko": "Korean",
    "ar": "Arabic", "ru": "Russian", "he": "Hebrew",
}
ERROR_CLASSES = (
    ("timeout", ("timeout", "timed out")),
    ("rate_limit", ("rate limit", "too many requests", "429")),
    ("authentication", ("unauthorized", "authentication", "401", "403")),
    ("network", ("connection", "network", "dns")),
    ("validation", ("validation", "invalid")),
    ("memory", ("memory",)),
    ("disk", ("disk", "space")),
    ("server", ("500", "502", "503", "server")),
)

#: Frequent words of the test corpus: a lexicon that the rules above are exercised with, since theirs are rare there.
FREQUENT = {"English": ("the", "and", "that", "with"), "German": ("der", "die", "und", "das"), "French": ("le", "les", "est", "pour"), "Spanish": ("el", "los", "para", "con")}
