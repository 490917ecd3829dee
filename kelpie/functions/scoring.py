"""Weights, salience, credibility, tiers and other scores as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Fixed values.
TIER_FLOOR = {"working": 0.0, "episodic": 0.0, "semantic": 0.2, "crystallised": 0.8}
TIER_DECAY = {"working": 0.4, "episodic": 0.035, "semantic": 0.006, "crystallised": 0.001}
CREDIBILITY = {
    "user_statement": 1.00, "user_upload": 0.95, "internal_deck": 0.85, "internal_email": 0.80, "internal_meeting": 0.78, "internal_doc": 0.75,
    "partner_doc": 0.70, "analyst_report": 0.60, "news_article": 0.45, "inferred_from_context": 0.30, "web_fetch": 0.25, "unknown": 0.50,
}
MODIFIERS = {"is_decision": 0.30, "is_risk": 0.25, "source_is_user": 0.20, "active_deal": 0.15, "recent_upload": 0.10, "contradicts_existing": 0.20}
DECISION_TYPES = ["decision", "decisionrecord", "commitment"]
DEAL_TYPES = ["deal", "opportunity", "contract", "partnership"]
DECISION_RELATIONS = ["decided", "owns_decision", "approved", "committed_to"]


def _case(column, values, default):
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def clamp(x, low=0.0, high=1.0):
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def effective_decay(rate, salience, floor):
    """A tenth of the rate where the priority floor holds, else less the more salient."""
    return F.when(floor, rate * 0.1).otherwise(rate * (1.0 - 0.7 * salience))


def weeks_between(then, now):
    return F.greatest(F.lit(0.0), (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))) / (7 * 86400.0))


def edge_weight(e, as_of, most_activations):
    """Strength x recency x frequency x number of sources x credibility, between the tier's floor and 1."""
    decay = effective_decay(_case(e["tier"], TIER_DECAY, 0.02), e["computed"], e["priority_floor"])
    recency = F.exp(-decay * weeks_between(e["last_activated"], as_of))
    frequency = F.log(1.0 + F.greatest(F.lit(1), e["activation_count"])) / F.log(1.0 + F.greatest(most_activations, F.lit(1)))
    sources = F.least(F.lit(1.0), 0.85 + (F.greatest(F.lit(1), e["n_sources"]) - 1) * 0.05)
    return F.greatest(_case(e["tier"], TIER_FLOOR, 0.0), F.least(F.lit(1.0), (e["weight"] + e["ris"]) * recency * frequency * sources * e["cred"]))


def entity_weight(e, as_of):
    """As for edges, against 100 activations and without sources or credibility."""
    decay = effective_decay(_case(e["tier"], TIER_DECAY, 0.02), e["computed"], e["priority_floor"])
    recency = F.exp(-decay * weeks_between(e["last_activated"], as_of))
    frequency = F.log(1.0 + F.greatest(F.lit(1), e["activation_count"])) / F.log(F.lit(101.0))
    return F.greatest(_case(e["tier"], TIER_FLOOR, 0.0), F.least(F.lit(1.0), (e["base"] + e["ris"]) * recency * frequency))


def infer_salience(e):
    """Base one half, plus what type, name, sources and retrievals add."""
    kind = F.lower(e["type"])
    add = lambda flag, name: F.when(flag, MODIFIERS[name]).otherwise(0.0)
    total = (
        add(kind.isin(*DECISION_TYPES), "is_decision") + add((kind == "risk") | F.lower(e["name"]).contains("risk"), "is_risk") + add(F.exists(e["sources"], lambda s: s.contains("/sessions/")), "source_is_user")
        + add(kind.isin(*DEAL_TYPES), "active_deal") + add(F.coalesce(F.get(e["sources"], F.lit(0)).contains("/daily/"), F.lit(False)), "recent_upload")
        + F.when(e["activation_count"] > 0, 0.05 * F.least(e["activation_count"], F.lit(4))).otherwise(0.0)
    )
    return clamp(0.5 + total)


#: What a path tells of its source, in order: (label, parts of which one must be there, and of which one more).
SOURCE_PATHS = [
    ("user_statement", ["/sessions/"], None),
    ("user_upload", ["/user_", "user_upload"], None),
    ("internal_doc", ["/decisions/", "/accounts/"], None),
    ("analyst_report", ["/research/"], ["gartner", "idc", "forrester", "abi"]),
    ("news_article", ["/research/"], ["ft_", "press", "news"]),
    ("internal_deck", ["/research/"], None),
    ("internal_email", ["/daily/emails/"], None),
    ("internal_meeting", ["/daily/transcripts/"], None),
    ("internal_doc", ["/daily/documents/"], None),
]
#: What the end of a path tells where its folders tell nothing, and what any part of it tells last.
SOURCE_ENDS = [("internal_deck", [".pptx", ".key"]), ("internal_doc", [".docx", ".pdf"])]
SOURCE_WORDS = ("inferred_from_context", ["synthesised", "inferred"])
#: Parts of a partner's documents, and how the user's own words begin.
PARTNER_PARTS, OWN_WORDS = ["partner", "_brief", "_requirements"], [("user says:", 500), ("user:", 200)]


def _any(flags):
    out = F.lit(False)
    for flag in flags:
        out = out | flag
    return out


def source_label(path, hint=None, partners=()):
    """The kind of source that a path (and the start of its content) tells."""
    s, c = F.lower(path), F.lower(F.coalesce(hint, F.lit(""))) if hint is not None else F.lit("")
    has = lambda parts: _any(s.contains(p) for p in parts)
    out = F.when(_any(F.substring(c, 1, n).contains(w) for w, n in OWN_WORDS), "user_statement")
    for label, parts, more in SOURCE_PATHS:
        out = out.when(has(parts) & has(more) if more else has(parts), label)
    for label, ends in SOURCE_ENDS:
        out = out.when(_any(s.endswith(e) for e in ends), label)
    if partners:
        out = out.when(has(partners) & has(PARTNER_PARTS), "partner_doc")
    return out.when(has(SOURCE_WORDS[1]), SOURCE_WORDS[0]).otherwise("unknown")


def credibility(label):
    return _case(label, CREDIBILITY, 0.5)


def entity_tier(kind, path):
    k, s = F.lower(kind), F.lower(path)
    return (
        F.when(k.isin(*DECISION_TYPES) | (s.contains("/decisions/") & (k != "person")), "crystallised").when(s.contains("/sessions/") | s.contains("/working/"), "working")
        .when(s.contains("/episodic/") | s.contains("/daily/"), "episodic").otherwise("semantic")
    )


def edge_tier(a, b, kind):
    """The lesser tier of both ends; crystallised for relations of decisions."""
    rank = {"working": 0, "episodic": 1, "semantic": 2, "crystallised": 3}
    least = F.least(_case(a, rank, 2), _case(b, rank, 2))
    return F.when(F.lower(kind).isin(*DECISION_RELATIONS), "crystallised").otherwise(F.element_at(F.array(*(F.lit(t) for t in rank)), least + 1))


def age_tier(days):
    return F.when(days < 30, "fresh").when(days < 90, "aging").when(days < 365, "mature").otherwise("ancient")


#: What queries of a kind say, in order of precedence.
QUERY_KINDS = (
    ("provenance", ["source", "where did", "who said", "which file", "citation"]),
    ("writing", ["draft", "write a", "compose", "rewrite", "edit this", "respond to"]),
    ("data", ["compute", "calculate", "how many", "what's the rate", "spreadsheet", "table", "compare numbers"]),
    ("strategic", ["strategy", "should we", "trade-off", "trade off", "compare", "vs", "options", "implications", "framework", "positioning", "approach", "investment", "100m arr filter"]),
    ("decision", ["decide", "decision", "choose between", "go or no-go", "recommend", "what should i", "which one"]),
    ("brainstorm", ["brainstorm", "ideas", "what if", "could we", "explore", "thinking about", "open question"]),
)


def query_kind(text):
    q, out = F.lower(F.trim(F.coalesce(text, F.lit("")))), None
    for kind, parts in QUERY_KINDS:
        hit = q.contains(parts[0])
        for p in parts[1:]:
            hit = hit | q.contains(p)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("quick_answer")


#: The salience of a proposal by a part of its path, in order, else; what a pressing reason adds.
PATH_SALIENCE = [
    ("wiki/decisions/", 0.95), ("wiki/projects/", 0.85), ("wiki/people/", 0.60), ("wiki/concepts/", 0.55), ("wiki/systems/", 0.55),
    ("/decisions/", 0.95), ("/accounts/", 0.70), ("/crystallised/", 0.95), ("/context/people", 0.55), ("/context/", 0.60), ("/weekly/", 0.55),
]
OTHER_SALIENCE, PRESSING, PRESSING_ADDS = 0.5, "decision|deadline|blocker|risk|approved", 0.10


def proposal_salience(path, reason):
    base, p = F.lit(OTHER_SALIENCE), F.lower(path)
    for part, value in reversed(PATH_SALIENCE):
        base = F.when(p.contains(part), value).otherwise(base)
    return F.round(F.when(F.lower(reason).rlike(PRESSING), F.least(F.lit(1.0), base + PRESSING_ADDS)).otherwise(base), 3)


#: Dollars per thousand input and output tokens, by model; prefixes either way match, in this order.
RATES = (
    ("claude-opus-4-7", 0.015, 0.075), ("claude-opus-4", 0.015, 0.075), ("claude-sonnet-4-6", 0.003, 0.015), ("claude-sonnet-4-5", 0.003, 0.015), ("claude-3-5-sonnet", 0.003, 0.015),
    ("claude-haiku-4-5", 0.0008, 0.004), ("claude-haiku-4-5-20251001", 0.0008, 0.004), ("claude-3-5-haiku", 0.0008, 0.004),
)


def token_rate(model):
    """struct(input, output): exact name, then a prefix either way, then the family, then the middle rate."""
    m = F.lower(F.coalesce(model, F.lit("")))
    rate = lambda i, o: F.struct(F.lit(i).alias("input"), F.lit(o).alias("output"))
    out = F.when(m == "", rate(0.003, 0.015))
    for name, i, o in RATES:
        out = out.when(m == name, rate(i, o))
    for name, i, o in RATES:
        out = out.when(m.startswith(name) | F.lit(name).startswith(m), rate(i, o))
    return out.when(m.contains("opus"), rate(0.015, 0.075)).when(m.contains("haiku"), rate(0.0008, 0.004)).otherwise(rate(0.003, 0.015))


def document_shape(path, body):
    """ics, slack, email or document."""
    low = F.lower(path)
    return (
        F.when(low.endswith(".ics"), "ics").when(low.contains("slack") | body.rlike(r"(?im)^#+\s.*slack"), "slack")
        .when(F.substring(body, 1, 2000).rlike(r"(?im)^\s*\*{0,2}From:"), "email").otherwise("document")
    )


#: Of each operation the preferred local model, and the one to fall back to.
ROUTES = {
    "query_classification": ("llama3.1:latest", None),
    "ingestion_classify": ("llama3.1:latest", None),
    "memory_proposal_detect": ("llama3.1:latest", None),
    "open_question_extract": ("llama3.1:latest", None),
    "graph_extraction": ("qwen2.5:14b", "claude-haiku-4-5"),
    "episodic_harvest": ("qwen2.5:14b", "claude-haiku-4-5"),
    "graph_enrichment": ("qwen2.5:14b", None),
    "graph_synthesis": ("qwen2.5:14b", None),
    "ingestion_condense": ("qwen2.5:14b", "claude-haiku-4-5"),
    "reconstructive_synthesis": ("qwen2.5:14b", "claude-haiku-4-5"),
    "community_label": ("qwen2.5:14b", None),
    "memory_compression": (None, "claude-haiku-4-5"),
    "contradiction_resolve": (None, "claude-haiku-4-5"),
    "crystallised_summary": (None, "claude-haiku-4-5"),
    "primary_worker": (None, "claude-opus-4-7"),
}
DEFAULT_MODEL = "llama3.1:latest"


def select_model(operation, available, force=False):
    """(model, kind) for an operation column and an array of local models.

    The first local model of the preferred one's family; else the fallback, which force prefers; else the first local one.
    """
    pair = lambda model, kind: F.struct(model.alias("model"), F.lit(kind).alias("kind"))
    out = pair(F.lit(DEFAULT_MODEL), "local")
    for name, (local, cloud) in ROUTES.items():
        choice = pair(F.lit(cloud), "cloud") if cloud else F.when(F.size(available) > 0, pair(F.get(available, F.lit(0)), "local")).otherwise(pair(F.lit(DEFAULT_MODEL), "local"))
        if local and not (force and cloud):
            near = F.filter(available, lambda m: F.contains(m, F.lit(local)) | F.startswith(m, F.lit(local.split(":")[0])))  # noqa: B023
            choice = F.when(F.size(near) > 0, pair(F.get(near, F.lit(0)), "local")).otherwise(choice)
        out = F.when(operation == name, choice).otherwise(out)
    return out
