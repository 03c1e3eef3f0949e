"""Fixed values that search results depend on: vocabularies, rewrites and stop words."""

from __future__ import annotations

# The groups of search terms, each with its canonical term.
SEARCH_FAMILIES = {
    "approval_gate": ("approval", "approve", "approver", "approvals", "signoff", "signoffs", "sign"),
    "early_rollout": ("pilot", "trial", "preview", "beta"),
    "europe_region": ("eu", "europe", "gdpr"),
    "legal_review": ("legal", "privacy", "security", "compliance"),
    "live_rollout": ("ga", "production", "live"),
    "risk_warning": ("amber", "warning", "caution", "watch"),
    "roadmap_support": ("roadmap", "commitment", "backed", "committed"),
}
# Literal replacements, in order, after lower-casing.
LITERAL_REWRITES = (
    ("/", " "),
    ("-", " "),
    (".net", " dotnet "),
    ("dot net", " dotnet "),
    ("sign off", " signoff "),
)
# Phrase rewrites, in order.
PHRASE_REWRITES = (
    (r"\bgeneral availability\b", " ga "),
    (r"\bgenerally available\b", " ga "),
    (r"\bearly access\b", " pilot "),
    (r"\blimited rollout\b", " pilot "),
    (r"\bwhite glove\b", " white_glove "),
    (r"\bhigh touch\b", " white_glove "),
    (r"\bstuck in legal\b", " blocked_by_legal legal blocked "),
    (r"\bwaiting on compliance\b", " blocked_by_legal compliance blocked "),
    (r"\bwaiting for exec(?:utive)? approval\b", " needs_exec_signoff executive approval "),
    (r"\bexec(?:utive)? sign ?off\b", " needs_exec_signoff executive signoff "),
    (r"\bunder review\b", " under_review review "),
    (r"\bnot blocked\b", " cleared "),
    (r"法务卡住|卡在法务|法律卡住|被法务卡住", " blocked_by_legal legal blocked "),
    (r"法务|法律", " legal "),
    (r"合规", " compliance "),
    (r"隐私", " privacy "),
    (r"安全审查|安全审核", " security review "),
    (r"审批|签字|签核", " approval signoff "),
    (r"高风险|严重风险", " high risk "),
    (r"预警|警告", " warning "),
    (r"试点|试用|灰度", " pilot "),
    (r"正式上线|已上线|生产可用", " ga production "),
    (r"暂停|停掉|停用", " paused "),
    (r"欧盟|欧洲", " eu "),
    (r"数据驻留|驻留", " residency "),
    (r"路线图", " roadmap "),
    (r"支持等级|支持层级", " support tier "),
)
# The canonical term of each token that has one, for embeddings.
EMBEDDING_TERMS = {
    "approved": "cleared_state",
    "approve": "approval_gate",
    "approval": "approval_gate",
    "awaiting": "pending_state",
    "blocked": "blocked",
    "stuck": "blocked",
    "halted": "blocked",
    "cleared": "cleared_state",
    "concierge": "white_glove_support",
    "deprioritized": "frozen_state",
    "elevated": "premium_support",
    "eu_only": "europe_region",
    "exec": "approval_gate",
    "executive": "approval_gate",
    "frozen": "frozen_state",
    "ga": "live_rollout",
    "gdpr": "europe_region",
    "glove": "white_glove_support",
    "grandfathered": "legacy_pricing",
    "healthy": "stable_state",
    "hold": "blocked",
    "internal": "internal_only_state",
    "live": "live_rollout",
    "warning": "risk_warning",
    "caution": "risk_warning",
    "amber": "risk_warning",
    "red": "critical_risk",
    "critical": "critical_risk",
    "severe": "critical_risk",
    "signoff": "approval_gate",
    "legal": "legal_review",
    "privacy": "legal_review",
    "security": "legal_review",
    "compliance": "legal_review",
    "eu": "europe_region",
    "europe": "europe_region",
    "pilot": "early_rollout",
    "trial": "early_rollout",
    "exploratory": "not_committed",
    "legacy": "legacy_pricing",
    "metered": "usage_pricing",
    "paused": "frozen_state",
    "pending": "pending_state",
    "premium": "premium_support",
    "production": "live_rollout",
    "tentative": "not_committed",
    "committed": "roadmap_backed",
    "backed": "roadmap_backed",
    "renewal": "contract_renewal",
    "residency": "data_region",
    "review": "pending_state",
    "roadmap": "roadmap_backed",
    "seat": "seat_pricing",
    "stable": "stable_state",
    "usage": "usage_pricing",
    "white": "white_glove_support",
}
# Words of a question that carry no retrieval signal.
NOISE_WORDS = (
    "a", "an", "and", "are", "be", "but", "by", "column", "columns", "find", "for", "has", "have", "how",
    "i", "in", "is", "it", "me", "metadata", "of", "on", "or", "show", "still", "that", "the", "their",
    "there", "these", "which", "with", "哪些", "哪个", "什么", "情况", "帮我", "看看", "一下", "有关", "相关", "和",
    "或", "还是", "字段", "列", "值",
)
# Words of a description that are no keywords.
DESCRIPTION_STOPWORDS = (
    "a", "an", "and", "app", "before", "can", "current", "field", "for", "from", "how", "in", "indicate", "is",
    "it", "may", "means", "of", "or", "status", "such", "that", "the", "this", "tells", "to", "whether", "with",
)
# English stop words of full-text search.
ENGLISH_STOPWORDS = frozenset({
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the",
    "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in",
    "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should",
    "now",
})
EMBEDDING_DIM = 24
