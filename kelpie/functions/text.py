"""Tokenising, stemming, slugs and cleaning as Catalyst expressions."""

from __future__ import annotations

import zlib
from functools import reduce
from html.entities import html5
from operator import or_

from pyspark.sql import functions as F

#: Words that carry no topic.
STOP_WORDS = (
    "the and for with this that are was has have what give about from its our can get all any but not how who why let use his her "
    "you did new old your their they them she him out off than "
    "tell told say said ask asked want need show help make made see seen look find found going goes went take took given gave "
    "know known knew think thought feel felt build built draft write wrote send sent "
    "thing things stuff everything something anything nothing someone anyone everyone nobody somebody everybody people person info "
    "details summary overview background context issue issues matter "
    "next last today tomorrow yesterday now then soon later before after during since year years month months day days week weeks "
    "one two three four five six many few lot much most more less least best worst "
    "please thanks really very just also even still yet already actually basically simply merely only"
).split()
#: Words of a query about a meeting.
MEETING_WORDS = "11 1on1 catchup catch-up meeting meet agenda email emails inbox sent sender discuss discussion prep prepare preparation".split()
#: Suffixes, longest first.
SUFFIXES = "ations nesses ments tions ings ions ness ment tion ers ies ied ics ing ion ic ed er es ly al s".split()
#: Words that say nothing about a change of topic.
DRIFT_STOP = (
    "what who is are the a an in on at of to for and or but from with about this that can will how me tell give let know its my "
    "your our their there here be do have has had was were am get got any which when where why if then so as by up out more please "
    "update status latest current new old between each all"
).split()
#: Words skipped in event titles.
EVENT_SKIP = "meeting weekly monthly sync call update review discussion prep with and the for".split()

NON_WORD = r"[^\p{L}\p{N}_]+"
_STEM = "^(.{3,}?)(" + "|".join(SUFFIXES) + ")$"


def _words(values):
    return F.array(*(F.lit(v) for v in values))


def once(value, f):
    """f(value), where value is worked out once, however often f takes it; Spark repeats an expression that stands twice."""
    return F.element_at(F.transform(F.array(value), f), 1)


def all_tokens(text):
    """Distinct words of a text in lower case; runs of letters, digits and underscores. May hold the empty word."""
    return F.array_distinct(F.split(F.lower(text), NON_WORD))


def query_tokens(text, stop=STOP_WORDS):
    """Distinct words of three or more characters that aren't stop words."""
    return F.array_except(F.filter(all_tokens(text), lambda t: F.char_length(t) >= 3), _words(stop))


def stem(word):
    """Without its longest known suffix, if three or more characters stay: one lazy match does what trying them in turn would."""
    return F.regexp_replace(word, _STEM, "$1")


def stem_token(word):
    """Stem, and then without trailing e's if it has more than three characters."""
    s = stem(word)
    return F.when(F.char_length(s) > 3, F.regexp_replace(s, "e+$", "")).otherwise(s)


def stem_of():
    """In Python, the stem (stem_token) of a token of three or more characters, else None."""
    suffixes = tuple(sorted(SUFFIXES, key=len, reverse=True))

    def f(token):
        if len(token) < 3:
            return None
        if token.endswith(suffixes):
            token = next((token[: -len(s)] for s in suffixes if len(token) - len(s) >= 3 and token.endswith(s)), token)
        return token.rstrip("e") if len(token) > 3 else token

    return f


def stemmed(tokens):
    """Distinct stems of the tokens of three or more characters."""
    return F.array_distinct(F.transform(F.filter(tokens, lambda t: F.char_length(t) >= 3), stem_token))


def proper_nouns(text, tokens):
    """Capitalised words of three or more characters, in lower case, that are also tokens."""
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Za-z][A-Za-z0-9_-]+)\b"), F.lit(1))
    return F.array_intersect(F.array_distinct(F.transform(found, F.lower)), tokens)


def person_names(text):
    """Capitalised words of 3 to 16 letters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]{2,15})\b"), F.lit(1)))


def is_meeting_query(tokens):
    return F.arrays_overlap(tokens, _words(MEETING_WORDS))


def expand_synonyms(tokens, groups):
    """Tokens and every group (key: equivalents) of which they hold a member; groups don't trigger each other."""
    out = tokens
    for key, values in groups.items():
        group = _words(sorted({key.lower(), *(v.lower() for v in values)}))
        out = F.when(F.arrays_overlap(tokens, group), F.array_union(out, group)).otherwise(out)
    return out


def occurrences(text, token):
    """Non-overlapping occurrences of a token in a text."""
    return ((F.char_length(text) - F.char_length(F.replace(text, token, F.lit("")))) / F.char_length(token)).cast("long")


def drift_tokens(text):
    """Distinct words that start with a letter, two characters or longer, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z0-9']*)"), F.lit(1))
    return F.array_except(F.array_distinct(F.filter(found, lambda t: F.char_length(t) >= 2)), _words(DRIFT_STOP))


def proposal_tokens(text):
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z0-9\-']+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: F.char_length(t) > 2))


def event_tokens(text, skip=EVENT_SKIP):
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z0-9]+)"), F.lit(1))
    return F.array_except(F.array_distinct(F.filter(found, lambda t: F.char_length(t) >= 3)), _words(skip))


def jaccard(a, b, empty=0.0):
    """Share of common elements; `empty` where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def slugify(text, most=60):
    """Lower case; what isn't a letter or digit becomes a hyphen; at most `most` characters, without outer hyphens."""
    flat = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(flat, r"^-+|-+$", ""), 1, most), r"-+$", "")


def safe_name(text, most=80):
    """A file name: what isn't a letter, digit, dot, underscore or hyphen becomes an underscore."""
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), 1, most)


def strip(text):
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def under_slug(text, most=60):
    """Lower case; what isn't a letter, digit, underscore or hyphen becomes an underscore; no outer ones; at most `most` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\-]", "_"), r"^_+|_+$", ""), 1, most)


def word_slug(text, most=60):
    """Words joined by underscores, in their own case, without other signs; at most `most` characters, without outer underscores."""
    flat = F.regexp_replace(strip(F.regexp_replace(text, r"[^\p{L}\p{N}_\s\-]", "")), r"\s+", "_")
    return F.regexp_replace(F.substring(flat, 1, most), r"^_+|_+$", "")


def normal_object(text):
    """For matching names: lower case, runs of white space and -_.,: as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\-_.,:]+", " "))


def normal_page(text):
    """For matching page names: characters that file names replace as spaces, collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r'[_:?*|"<>\\]', " "), r"\s+", " ")))


def snippet(text, n=200):
    """The first n characters of the non-empty lines that don't start a front matter, joined by spaces."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("---"))
    return F.substring(F.array_join(lines, " "), 1, n)


def title_of(text, fallback):
    """The first heading line, else the fallback."""
    found = F.regexp_extract(text, r"(?m)^#+[ \t]*(.+?)[ \t]*$", 1)
    return F.when(found != "", found).otherwise(fallback)


def first_sentence(text):
    """The first line that isn't empty or a heading, up to the first . ! or ? before white space."""
    line = F.element_at(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("---")), 1)
    cut = F.regexp_extract(line, r"^(.+?[.!?])\s", 1)
    return F.coalesce(F.when(cut != "", cut).otherwise(line), F.lit(""))


#: Patterns of the HTML cleaner, in order, and what replaces them.
HTML_STEPS = (
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<style[^>]*>.*?</style>", " "),
    (r"(?is)<script[^>]*>.*?</script>", " "),
    (r"(?is)<head[^>]*>.*?</head>", " "),
    (r"(?is)<svg[^>]*>.*?</svg>", " "),
    (r"(?is)@(?:media|font-face|keyframes|import|charset)[^{}]*\{[^{}]*\}", " "),
    (r"(?im)^[.#@a-z][^{}\n]{0,200}\{[^{}]*\}", " "),
    (r"(?s)<[^>]+>", " "),
)
#: The entities that most pages hold (what the SQL spells out).
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Clean-up of what is left, in order.
_SPACES = ((r"[​‌‍­‎‏]", ""), (" ", " "), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), (r"(?m)[ \t\r]+$", ""))


#: What a text that a step changes holds (white space at its end goes anyway).
_SPACE_SIGNS = (tuple(_SPACES[0][0][1:-1]), ("\u00a0",), ("  ", "\t"), ("\n\n\n",), (" \n", "\t\n", "\r\n"))
#: White space as patterns have it.
WHITE = " \t\n\x0b\f\r"
#: What may be an entity, and the groups that its names are looked up in: a long map is searched from its start.
_ENTITY, _GROUPS = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 256


def _entity_names():
    """An array of maps, by the crc32 of the name: entity names, as HTML 5 has them, to what they stand for."""
    groups = [[] for _ in range(_GROUPS)]
    for name, value in html5.items():
        groups[zlib.crc32(name.encode()) % _GROUPS] += [F.lit(name), F.lit(value)]
    return F.array(*(F.create_map(*(g or [F.lit(""), F.lit("")])) for g in groups))


def _code_point(n):
    """The text of a numeric entity: controls of windows-1252 by its table, what is no character as the standard has it."""
    table = F.create_map(*(F.lit(x) for i in range(128, 160) for x in (i, bytes([i]).decode("cp1252", "ignore") or chr(i))))
    none = n.between(0x1, 0x8) | n.between(0xE, 0x1F) | (n == 0xB) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
    sign = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (
        F.when(n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd").when(n == 0xD, "\r")
        .when(n.between(128, 159), table[n.cast("int")]).when(none, "").otherwise(sign)
    )


def unescape(text, bare=True):
    """Entities, named (as HTML 5 has them) or numeric, decoded in one pass; unknown names stay.

    bare: numeric ones and old names count without a semicolon too, as browsers have it.
    """
    names = _entity_names()
    look = lambda name: F.element_at(F.element_at(names, (F.crc32(name) % _GROUPS + 1).cast("int")), name)

    def named(e):
        whole = look(e)
        # of old names that go without a semicolon, the longest that the entity begins with
        begins = F.coalesce(*(F.when(F.char_length(e) > n, F.concat(look(F.substring(e, 1, n)), F.substring(e, n + 1, 40))) for n in range(max(len(k) for k in html5 if k[-1] != ";"), 1, -1)))
        return F.coalesce(whole, begins, F.concat(F.lit("&"), e))

    def decoded(e):
        digits = F.regexp_replace(F.rtrim(e, F.lit(";")), "^#[xX]?0*", "")
        # more digits than any character has are beyond the last one
        number = F.when(F.char_length(digits) > 10, F.lit(1 << 31)).otherwise(F.coalesce(digits.try_cast("long"), F.lit(0)))
        hexed = F.when(F.char_length(digits) > 10, F.lit(1 << 31)).otherwise(F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(0)))
        return F.when(F.startswith(e, F.lit("#")), _code_point(F.when(e.rlike("^#[xX]"), hexed).otherwise(number))).otherwise(named(e))

    entity = _ENTITY if bare else _ENTITY.replace(";?", ";")

    def joined(text):
        between, found = F.split(text, entity, -1), F.regexp_extract_all(text, F.lit(entity), F.lit(1))
        pieces = F.transform(F.arrays_zip(between.alias("t"), found.alias("e")), lambda x: F.concat(x["t"], F.coalesce(F.when(x["e"].isNotNull(), decoded(x["e"])), F.lit(""))))
        return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)

    return once(text, joined)


def holds(text, signs):
    """Whether a text holds one of the signs."""
    return reduce(or_, (F.contains(text, F.lit(sign)) for sign in signs))


def _where(signs, steps):
    """A function that replaces patterns in a text, in order, if the text holds one of the signs that they need."""
    def replaced(text):
        out = text
        for pattern, to in steps:
            out = F.regexp_replace(out, pattern, to)
        return F.when(holds(text, signs), out).otherwise(text)

    return replaced


def strip_html(text, bare=True):
    """Comments, style, script, head and svg blocks, CSS rules and tags out; entities decoded (see unescape); white space collapsed."""
    for sign, steps in (("<", HTML_STEPS[:5]), ("{", HTML_STEPS[5:7]), ("<", HTML_STEPS[7:])):
        text = once(text, _where((sign,), steps))
    text = unescape(text, bare)
    for signs, (pattern, to) in zip(_SPACE_SIGNS, _SPACES):
        text = once(text, _where(signs, [("(?d)" + pattern, to)]))
    return F.btrim(text, F.lit(WHITE))


def header(text, label):
    """The value of a From, Subject, To or Date line (plain or bold) in the first 4000 characters, 200 at most; null if none."""
    found = F.regexp_extract(F.substring(text, 1, 4000), rf"(?im)^\s*\*?\*?{label}:\*?\*?\s*(.+?)$", 1)
    found = F.substring(F.trim(found), 1, 200)
    return F.when(found != "", found)


def address(field):
    found = F.lower(F.regexp_extract(field, r"<?([\w.+\-]+@[\w.\-]+)>?", 1))
    return F.when(found != "", found)


def domain(addr):
    return F.when(addr.contains("@"), F.lower(F.element_at(F.split(addr, "@"), -1)))


#: What begins a quoted reply.
_REPLY = (
    r"(?m)^(?:On\s+\w{3},?\s+\w+\s+\d+,?\s+\d{4}.*wrote:|-+\s*Original Message\s*-+|From:\s+.+\nSent:\s+.+"
    r"|Le\s+\w+\s+\d+\s+\w+\s+\d{4}.*écrit\s*:)"
)
#: One of these stands in whatever the pattern finds.
_REPLY_SIGNS = ("wrote:", "Original Message", "Sent:", "crit")


def truncate_replies(text):
    """Cut below the first reply marker, if it stands after the first 200 characters."""
    def cut_at(text):
        short = lambda at: F.when(at > 201, F.concat(F.rtrim(F.substring(text, F.lit(1), at - 1)), F.lit("\n\n[... reply chain truncated ...]"))).otherwise(text)
        return F.when(holds(text, _REPLY_SIGNS), once(F.regexp_instr(text, F.lit(_REPLY)), short)).otherwise(text)

    return once(text, cut_at)


#: Parts of domains that send promotions.
MARKETING_DOMAINS = (
    "uber.com ubereats.com noreply.uber.com lot.com lotpolish.com lufthansa.com klm.com airfrance.com ryanair.com easyjet.com "
    "wizzair.com vueling.com booking.com expedia.com trivago.com hotels.com agoda.com trip.com skyscanner.com linkedin.com "
    "spotify.com netflix.com disney.com youtube.com amazon.com amazon.de amazon.co.uk marketing. newsletter. promo."
).split()
#: What subjects of promotions say.
MARKETING_SUBJECT = (
    r"(?i)\b(?:\d+%\s*off|\d+\s*[€$£]\s*off|limited\s*time|sale\s*ends|hurry|don'?t\s*miss|newsletter|digest|weekly\s*recap|monthly\s*recap"
    r"|unsubscribe|upgrade\s*available|order\s*now|book\s*now|shop\s*now|flash\s*sale|earn\s*rewards|points\s*available|free\s*trial|free\s*shipping)\b"
)
#: Calls to action.
MARKETING_CALLS = ["promo code", "order now", "limited time", "shop now", "earn points", "free trial", "redeem", "% off"]


def marketing_reason(sender, subject, body):
    """Why an email is a promotion; empty if it isn't."""
    presses = lambda low: low.contains("unsubscribe") & holds(low, MARKETING_CALLS)
    rest = (
        F.when(F.coalesce(subject, F.lit("")).rlike(MARKETING_SUBJECT), "marketing-subject")
        .when((F.char_length(body) > 1500) & once(F.lower(body), presses), "marketing-cta-pattern")
        .otherwise("")
    )
    return once(domain(address(sender)), lambda dom: F.when(holds(dom, MARKETING_DOMAINS), F.concat(F.lit("marketing-domain:"), dom)).otherwise(rest))


#: Redaction rules, in order.
REDACTIONS = (
    ("EMAIL", r"[a-zA-Z0-9_.+\-]+@[a-zA-Z0-9\-]+\.[a-zA-Z0-9.\-]+"),
    ("PHONE", r"(?:(?:\+|00)\d{1,3}[\s\-.]?)?(?:\(?\d{1,4}\)?[\s\-.]?)?\d{3,4}[\s\-.]\d{3,4}"),
    ("SSN", r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:\d[ \-]?){13,16}\b"),
    ("COMPENSATION", r"(?:€|\$|£|USD|EUR|GBP|CHF)[\s]*\d[\d,.]*[kKmM]?|\b\d[\d,.]*[kKmM]?[\s]*(?:€|\$|£|USD|EUR|GBP|CHF)\b"),
)


def fingerprint(text):
    """20 hex digits that tell an email from another by sender, subject and the start of its body; empty if it has neither header."""
    text = F.regexp_replace(text, r"(?s)<!-- backfilled rename:.*?-->\s*", "")
    normal = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")), r"\s+", " ")
    from_line, subject_line = (F.regexp_extract(text, rf"(?m)({p})$", 1) for p in (r"^\*\*From:\*\*\s*.+?", r"^-+##\s*.+?"))
    sender = F.regexp_extract(text, r"(?m)^\*\*From:\*\*\s*(.+?)$", 1)
    subject = F.regexp_extract(text, r"(?m)^-+##\s*(.+?)$", 1)
    end = lambda line: F.when(line != "", F.instr(text, line) + F.char_length(line) - 1).otherwise(0)
    start = F.greatest(end(from_line), end(subject_line))
    body = F.substring(normal(F.substring(text, start + 1, F.lit(1500))), 1, 1000)
    key = F.concat_ws("|", normal(sender), normal(subject), body)
    return F.when((sender == "") & (subject == ""), "").otherwise(F.substring(F.sha2(key, 256), 1, 20))


def sentences(text):
    """A text cut after . ! or ? and white space (which is looked for first, as it is rarer than what isn't a mark)."""
    return F.split(text, r"\s(?<=[.!?]\s)\s*")


#: What open questions say, and what closed ones do.
OPEN_QUESTION = (
    r"\bwe don'?t know\b|\bopen question\b|\bunclear\b|\btbd\b|\bto be (?:determined|defined|decided)\b|\bneed to (?:check|figure out|decide|confirm)\b"
    r"|\bunresolved\b|\bnot yet (?:decided|known|confirmed)\b|\bpending\b.*\?|\?\s*$"
)
#: One of these stands in whatever asks.
OPEN_SIGNS = ("?", "know", "unclear", "open question", "tbd", "to be ", "need to ", "unresolved", "not yet ")
CLOSED = r"\b(?:decided|resolved|answered|done|closed)\b"


def vtt_seconds(stamp):
    """HH:MM:SS.mmm or MM:SS.mmm as seconds."""
    parts = F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":")
    n = F.size(parts)
    hours = F.when(n > 2, F.get(parts, n - 3).cast("double")).otherwise(0.0)
    return hours * 3600 + F.get(parts, n - 2).cast("double") * 60 + F.get(parts, n - 1).cast("double")


def vtt_stamp(seconds):
    """Seconds as H:MM:SS."""
    whole = F.floor(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)


def yaml_quoted(text):
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def curly_to_straight(text):
    return F.translate(text, "‘’“”", "''\"\"")


def iso_timestamp(text, default):
    """The first 19 characters as a timestamp, else the default."""
    return F.coalesce(F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz"), default)
