"""More registered queries: people, deadlines and meetings, names of mails, page flags, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import scoring as S
from kelpie.operators import ingest, memory, naming, ordered, people, rollups, signals
from kelpie.plans import assembly, completion, views
from kelpie.plans import tables as T
from kelpie.plans.queries import _ACCENTS, _CONTRA, _CUES, _ETIER, _INFER, _LABEL, _LINKED, _NORM, _REJ, ORACLE, _case_sql, _contradictions, _cues, _ordered, _questions, query, rejected_and_truths
from kelpie.plans.tables import read, sql_list

TODAY, UNTIL = "2024-01-15", "2024-01-29"

# --- people ---------------------------------------------------------------------------------------------------------

_SUBJECTS = "subjects AS (SELECT p_partkey AS id, p_name AS name, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN string_split(p_name, ' ')[1] || ' X' WHEN 2 THEN 'Dr ' || string_split(p_name, ' ')[-1] ELSE 'nobody ' || p_partkey END AS subject FROM part)"
_NAMES = """words AS (SELECT lower(name) AS full_, name, id, string_split(lower(name), ' ') AS w FROM subjects), f AS (SELECT full_ AS key, max_by(name, id) AS canonical FROM words GROUP BY full_),
ends AS (SELECT key, min_by(name, id * 10 + i) AS canonical FROM (SELECT w[1] AS key, name, id, 0 AS i FROM words UNION ALL SELECT w[-1], name, id, 1 FROM words) GROUP BY key), idx AS (SELECT * FROM f UNION ALL SELECT * FROM ends WHERE key NOT IN (SELECT key FROM f)),
s AS (SELECT id, subject, lower(subject) AS a, string_split(lower(subject), ' ')[1] AS b, CASE WHEN len(string_split(subject, ' ')) > 1 THEN string_split(lower(subject), ' ')[-1] END AS c FROM subjects),
named AS (SELECT id, subject, coalesce(i.canonical, j.canonical, l.canonical, subject) AS canonical FROM s LEFT JOIN idx i ON i.key = a LEFT JOIN idx j ON j.key = b LEFT JOIN idx l ON l.key = c)"""


def _people(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    k, w = F.col("p_partkey"), F.split("p_name", " ")
    subject = F.when(k % 4 == 0, F.upper("p_name")).when(k % 4 == 1, F.concat(F.get(w, F.lit(0)), F.lit(" X"))).when(k % 4 == 2, F.concat(F.lit("Dr "), F.element_at(w, -1))).otherwise(F.concat(F.lit("nobody "), k.cast("string")))
    persons = p.select(k.alias("eid"), F.col("p_name").alias("name"), F.lit("person").alias("type"))
    return people.name_index(persons), p.select(k.alias("id"), subject.alias("subject"))


@query(f"WITH {_SUBJECTS}, {_NAMES} SELECT id, subject, canonical FROM named")
def canonical_names(spark, sf_dir):
    index, subjects = _people(spark, sf_dir)
    return people.canonical_names(subjects, "subject", index)


@query(f"""WITH {_SUBJECTS}, {_NAMES} SELECT id, CASE WHEN id % 3 = 0 THEN 'wiki/people/' || subject || '.md' WHEN id % 3 = 1 THEN 'context/people/' || replace(subject, ' ', '_') || '.md' ELSE 'wiki/projects/' || subject || '.md' END AS path,
 CASE WHEN id % 3 = 0 THEN 'wiki/people/' || canonical || '.md' WHEN id % 3 = 1 THEN 'context/people/' || regexp_replace(lower(canonical), '[^\\p{{L}}\\p{{N}}_\\-]', '_', 'g') || '.md' ELSE 'wiki/projects/' || subject || '.md' END AS canonical_path FROM named""")
def canonical_paths(spark, sf_dir):
    index, subjects = _people(spark, sf_dir)
    k, s = F.col("id"), F.col("subject")
    path = F.when(k % 3 == 0, F.concat(F.lit("wiki/people/"), s, F.lit(".md"))).when(k % 3 == 1, F.concat(F.lit("context/people/"), F.replace(s, F.lit(" "), F.lit("_")), F.lit(".md"))).otherwise(F.concat(F.lit("wiki/projects/"), s, F.lit(".md")))
    return people.canonical_paths(subjects.select("id", path.alias("path")), index)


@query("SELECT doc_id, doc_id % 9 = 4 OR doc_id % 50 = 7 AS own FROM documents")
def from_user(spark, sf_dir):
    k = F.col("doc_id")
    raw = F.concat(F.lit("head\n**From:** "), F.when(k % 50 == 7, "Lee, ANN <x@y.org>").otherwise(F.concat(F.lit("user <u@mail"), (k % 9).cast("string"), F.lit(".example.com>"))), F.lit("\n"), F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", people.from_user(raw, "Ann Lee", "U@mail4.example.com").alias("own"))


# --- deadlines and meetings -----------------------------------------------------------------------------------------

_URGENCY = "CASE urgency WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END"


@query(f"""WITH {T.SIGNALS}, o AS (SELECT path, coalesce(deadline, '') AS deadline, subject, substring(action, 1, 160) AS action, coalesce(urgency, 'medium') AS urgency, confidence FROM signals WHERE actionable AND NOT already_responded AND (deadline IS NULL OR deadline >= '{TODAY}'))
SELECT *, row_number() OVER (ORDER BY deadline = '', {_URGENCY}, deadline, path) AS rank FROM o""")
def deadlines(spark, sf_dir):
    return signals.deadlines(T.signals(spark, sf_dir), TODAY)


_ORDERED = f"ordered_events AS (SELECT *, row_number() OVER (ORDER BY NOT is_high_stakes, {_URGENCY}, iso, event_id) AS rank FROM calendar WHERE NOT is_cancelled AND kind <> 'personal')"


@query(f"WITH {T.CALENDAR}, {_ORDERED} SELECT event_id, summary, iso, rank FROM ordered_events")
def calendar_order(spark, sf_dir):
    return signals.calendar_order(T.calendar(spark, sf_dir)).select("event_id", "summary", "iso", "rank")


@query(f"WITH {T.CALENDAR}, {_ORDERED} SELECT event_id, iso FROM ordered_events WHERE is_high_stakes AND iso BETWEEN '{TODAY}' AND '{UNTIL}' ORDER BY iso, rank LIMIT 12")
def pressing_events(spark, sf_dir):
    return signals.pressing_events(signals.calendar_order(T.calendar(spark, sf_dir)), TODAY, UNTIL).select("event_id", "iso")


_MEETING = "'meeting:' || trim(regexp_replace(lower(summary), '[^\\p{L}\\p{N}_\\-]', '_', 'g'), '_') || CASE WHEN is_recurring THEN '' ELSE ':' || iso END"
_MEETINGS = f"m AS (SELECT *, {_MEETING} AS mid FROM ordered_events WHERE is_high_stakes)"


@query(f"WITH {T.CALENDAR}, {_ORDERED}, {_MEETINGS}, l AS (SELECT *, row_number() OVER (PARTITION BY mid ORDER BY rank DESC) AS n FROM m) SELECT mid AS eid, summary AS name, 'meeting' AS type, coalesce(urgency, 'medium') AS urgency, iso AS next_iso, CAST(CASE WHEN urgency = 'high' THEN 0.7 ELSE 0.55 END AS DOUBLE) AS salience FROM l WHERE n = 1")
def meeting_nodes(spark, sf_dir):
    return signals.meetings(signals.calendar_order(T.calendar(spark, sf_dir)))


_KEYS = "keys AS (SELECT eid, type, unnest([lower(name)] || string_split(lower(name), ' ')) AS key FROM entities), pi AS (SELECT key, min(eid) AS eid FROM keys WHERE type = 'person' GROUP BY key), ai AS (SELECT key, min(eid) AS eid FROM keys WHERE type IN ('account', 'company') GROUP BY key)"


@query(f"""WITH {T.ENTITIES}, {T.CALENDAR}, {_ORDERED}, {_MEETINGS}, {_KEYS}, p AS (SELECT mid, lower(unnest(people_links)) AS slug FROM m), a AS (SELECT mid, lower(unnest(account_links)) AS slug FROM m),
ph AS (SELECT mid, coalesce(x.eid, y.eid) AS eid FROM p LEFT JOIN pi x ON x.key = slug LEFT JOIN pi y ON y.key = replace(slug, '_', ' ')), ah AS (SELECT mid, coalesce(x.eid, y.eid) AS eid FROM a LEFT JOIN ai x ON x.key = slug LEFT JOIN ai y ON y.key = replace(slug, '_', ' '))
SELECT mid AS src, eid AS dst, 'attended_by' AS type, CAST(0.6 AS DOUBLE) AS weight FROM ph WHERE eid IS NOT NULL UNION ALL SELECT eid, mid, 'attends', 0.6 FROM ph WHERE eid IS NOT NULL
UNION ALL SELECT mid, eid, 'about_account', 0.7 FROM ah WHERE eid IS NOT NULL UNION ALL SELECT eid, mid, 'discussed_in', 0.7 FROM ah WHERE eid IS NOT NULL""")
def meeting_edges(spark, sf_dir):
    return signals.meeting_edges(signals.calendar_order(T.calendar(spark, sf_dir)), T.entities(spark, sf_dir))


# --- names ----------------------------------------------------------------------------------------------------------

_PLAIN = f"translate(text, '{_ACCENTS[0]}', '{_ACCENTS[1]}')"
_STOP = sql_list(naming.TOPIC_STOP)
_sq = lambda p: p.replace("'", "''")


def _named_mails(spark, sf_dir):
    """Mails with heads, lists and proper nouns; without accents, as RE2 knows word boundaries of ASCII only."""
    k = F.col("doc_id")
    head = F.concat(F.lit("**From:** Ann.Lee-"), (k % 9).cast("string"), F.lit("@x.org\n**Subject:** Weekly: Ent "), F.col("source"), F.lit("\n**Team Plan "), (k % 7).cast("string"), F.lit("**: see (Alpha "), (k % 5).cast("string"), F.lit(", beta, Gamma, Hello World)\n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.translate("text", *_ACCENTS)).alias("raw"))


@query(f"""WITH d AS (SELECT doc_id, 'Weekly: Ent ' || source AS subject, 'Ann_Lee_' || (doc_id % 9) AS sender, '**From:** Ann.Lee-' || (doc_id % 9) || '@x.org' || chr(10) || '**Subject:** Weekly: Ent ' || source || chr(10) || '**Team Plan ' || (doc_id % 7) || '**: see (Alpha ' || (doc_id % 5) || ', beta, Gamma, Hello World)' || chr(10) || {_PLAIN} AS raw FROM documents),
x AS (SELECT *, regexp_extract_all(lower(subject), '([a-z]+)', 1) || string_split(lower(sender), '_') AS known FROM d),
b AS (SELECT doc_id, regexp_extract_all(raw, '{_sq(naming.BOLD_HEAD)}', 1) AS l FROM x), b1 AS (SELECT doc_id, 1 AS pass, unnest(range(len(l))) AS i, 0 AS j, trim(unnest(l)) AS c FROM b),
q AS (SELECT doc_id, regexp_extract_all(raw, '{_sq(naming.PAREN_LIST)}', 1) AS l FROM x), q0 AS (SELECT doc_id, unnest(range(len(l))) AS i, string_split(unnest(l), ',') AS parts FROM q), q1 AS (SELECT doc_id, 2 AS pass, i, unnest(range(len(parts))) AS j, regexp_replace(unnest(parts), '^\\s+|\\s+$', '', 'g') AS c FROM q0),
n AS (SELECT doc_id, known, regexp_extract_all(substring(raw, 1, 12000), '{_sq(naming.PROPER_NOUN)}', 1) AS l FROM x), n0 AS (SELECT doc_id, known, unnest(range(len(l))) AS i, unnest(l) AS c FROM n),
n1 AS (SELECT doc_id, c, count(*) AS n, min(i) AS place FROM n0 WHERE NOT list_contains({_STOP}, regexp_extract(c, '^(\\S+)', 1)) AND NOT list_contains(known, lower(regexp_extract(c, '^(\\S+)', 1))) GROUP BY ALL),
n2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) AS r FROM n1),
every_ AS (SELECT * FROM b1 UNION ALL SELECT * FROM q1 WHERE regexp_matches(c, '^\\p{{Lu}}') UNION ALL SELECT doc_id, 3, r, 0, c FROM n2 WHERE r <= 20 AND n >= 2),
g AS (SELECT e.doc_id, pass, i, j, regexp_replace(regexp_replace(c, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS c, known FROM every_ e JOIN x USING (doc_id)),
h AS (SELECT * FROM g WHERE c <> '' AND NOT list_contains(known, lower(c)) AND NOT list_contains({_STOP}, regexp_extract(c, '^(\\S+)', 1)) AND length(c) <= 40 AND NOT list_contains(string_split(lower(c), ' '), 'gamma')),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(c) ORDER BY pass, i, j) AS first FROM h), v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pass, i, j) AS r FROM u WHERE first = 1),
t AS (SELECT doc_id, list(c ORDER BY r) AS topics FROM v WHERE r <= 5 GROUP BY doc_id),
z AS (SELECT x.doc_id, subject, sender, coalesce(topics, []) AS topics, list_filter(list_transform(coalesce(topics, []), lambda s: trim(substring(regexp_replace(trim(regexp_replace(s, '[^\\p{{L}}\\p{{N}}_\\s\\-]', '', 'g')), '\\s+', '_', 'g'), 1, 20), '_')), lambda s: s <> '') AS slugs FROM x LEFT JOIN t USING (doc_id))
SELECT doc_id, array_to_string(topics, '|') AS topics, 'email_2024-01-15__' || replace(replace(subject, ':', ''), ' ', '_') || CASE WHEN len(slugs) > 0 THEN '__topics_' || array_to_string(slugs, '_') ELSE '' END || '__from_' || sender AS name FROM z""")
def mail_names(spark, sf_dir):
    r = naming.mail_name(naming.mail_parts(_named_mails(spark, sf_dir), user=("Gamma",)), F.lit(TODAY))
    return r.select("doc_id", F.array_join("topics", "|").alias("topics"), "name")


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, 'slack_2024-01-15__Topic_' || (conv_id % 4) || CASE WHEN conv_id % 2 = 0 THEN '__Next_' || (conv_id % 3) ELSE '' END || '__with_' || CASE WHEN conv_id % 2 = 0 THEN 'Bea_Ann_Dan' ELSE 'Ann_Bea_Dan' END AS name FROM c""")
def chat_names(spark, sf_dir):
    k = F.col("conv_id")
    ids = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    heads = F.concat(F.lit("### 1. Topic "), (k % 4).cast("string"), F.lit(" — Decision reached\n"), F.when(k % 2 == 0, F.concat(F.lit("### Next "), (k % 3).cast("string"), F.lit("\n### Third\n"))).otherwise(""))
    names = F.concat(F.lit("**Leo Max** **Ann Lee** **Bea Poe** "), F.when(k % 2 == 0, "**Bea Poe** ").otherwise("**Ann Lee** **Bea Poe** "), F.lit("**Leo Max** **Dan Roe** **Eve Low**\n"))
    return naming.chat_name(naming.chat_parts(ids.select("conv_id", F.concat(heads, names).alias("raw")), exclude=("leo",)), F.lit(TODAY)).select("conv_id", "name")


# --- pages ----------------------------------------------------------------------------------------------------------

@query("""SELECT page_id, page_id % 5 IN (1, 2, 3) OR page_id % 35 = 0 AS skipped, page_id % 4 = 1 AS orphan_false, page_id % 4 = 2 AS stub FROM pages""")
def page_flags(spark, sf_dir):
    k = F.col("page_id")
    path = F.when(k % 35 == 0, "wiki/log.md").when(k % 5 == 1, "wiki/.trash/a.md").when(k % 5 == 2, "wiki/index.md").when(k % 5 == 3, "x/SKILL.md").otherwise(F.concat(F.lit("wiki/p"), k.cast("string"), F.lit(".md")))
    body = F.when(k % 4 == 0, "stub: true\n---\n").when(k % 4 == 1, "---\na: b\n orphan : false \n---\nstub: true\n").when(k % 4 == 2, "---\nstub: true\n...\norphan: false").otherwise("---\na: b\n---\nstub: true\norphan: false\n")
    return read(spark, sf_dir, "pages").select("page_id", ingest.skipped_page(path).alias("skipped"), ingest.front_flag(body, "orphan", "false").alias("orphan_false"), ingest.front_flag(body, "stub", "true").alias("stub"))


@query(r"""WITH s AS (SELECT DISTINCT unnest(['idiot', 'Anony', 'apache-license', 'apache license', 'src1', 'the']) AS stem) SELECT stem || '.md' AS path FROM s WHERE EXISTS (SELECT 1 FROM documents WHERE regexp_matches(translate(text, '%s', '%s'), '(?:^|[^A-Za-z0-9_])' || stem || '(?:\.md)?(?:[^A-Za-z0-9_]|$)'))""" % _ACCENTS)
def raw_mentions(spark, sf_dir):
    pages = spark.createDataFrame([(x + ".md",) for x in ("idiot", "Anony", "apache-license", "apache license", "src1", "the")], "path string")
    return ingest.raw_mentions(pages, read(spark, sf_dir, "documents").select(F.translate("text", *_ACCENTS).alias("text")))


# --- rollups --------------------------------------------------------------------------------------------------------

@query(f"WITH {T.ENTITIES}, m AS (SELECT 'nat:' || c_nationkey AS community, 'cust:' || c_custkey AS eid FROM customer), n AS (SELECT community, type, count(*) AS n FROM m JOIN entities USING (eid) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, type) AS i, sum(n) OVER (PARTITION BY community) AS total FROM n) SELECT community, upper(type[1]) || substring(type, 2) || ' cluster (' || CAST(total AS BIGINT) || ' nodes)' AS label, CAST(total AS BIGINT) AS n FROM r WHERE i = 1")
def community_labels(spark, sf_dir):
    eid = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    m = read(spark, sf_dir, "customer").select(eid("nat:", "c_nationkey").alias("community"), eid("cust:", "c_custkey").alias("eid"))
    return rollups.community_labels(m, T.entities(spark, sf_dir))


@query("SELECT count(*) FILTER (doc_id % 5 < 3) AS compressed, count(*) FILTER (doc_id % 5 = 3) AS skipped, count(*) FILTER (doc_id % 5 = 4) AS errors, CAST(coalesce(sum(length(text) - length(text) // 2) FILTER (doc_id % 5 < 3), 0) AS BIGINT) AS chars_saved FROM documents")
def compression_summary(spark, sf_dir):
    n = F.char_length("text").cast("long")
    return rollups.compression_summary(read(spark, sf_dir, "documents").select(T.pick(["ok", "ok", "ok", "skipped", "error"], F.col("doc_id")).alias("status"), n.alias("before"), F.floor(n / 2).alias("after")))


@query(f"SELECT count(*) FILTER (strftime(ts, '%Y-%m-%d') = '{TODAY}') AS runs FROM events")
def runs_today(spark, sf_dir):
    return rollups.runs_on(read(spark, sf_dir, "events").select(F.col("ts").cast("string").alias("date")), TODAY)


@query(f"WITH {_CUES}, s AS (SELECT file, speaker, min(n) AS n FROM cues GROUP BY ALL), a AS (SELECT file, string_agg(speaker, ',' ORDER BY n) AS speakers FROM s GROUP BY file) SELECT file, speakers, max_by(end_, n) AS duration FROM cues JOIN a USING (file) GROUP BY ALL")
def speakers(spark, sf_dir):
    return ordered.speakers(_cues(spark, sf_dir)).withColumn("speakers", F.array_join("speakers", ","))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 5000")
def newest_events(spark, sf_dir):
    return ordered.newest(read(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id").select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 30")
def newest_history(spark, sf_dir):
    return ordered.newest_of_each(read(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_type", "ts", "event_id").select("event_id")


# --- flows ----------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
k AS (SELECT *, CASE WHEN n <= 3 THEN i WHEN conv_id % 2 = 0 THEN CASE i WHEN 3 THEN 0 WHEN 1 THEN 1 END WHEN i < 3 THEN i END AS place FROM c) SELECT CAST(conv_id AS VARCHAR) AS query_id, 'MEMORY/t_' || turn || '.md' AS path, CAST(place AS INTEGER) AS place FROM k WHERE place IS NOT NULL""")
def curated(spark, sf_dir):
    """A completer that answers every other query, with an index that isn't in the list and one twice."""
    c = read(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("query_id"), F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("query"), F.concat(F.lit("MEMORY/t_"), F.col("turn").cast("string"), F.lit(".md")).alias("path"), F.col("turn").alias("ord"), F.col("text").alias("snippet"))

    def answer(prompt):
        even = int(prompt.split("\n")[0].removeprefix("Query: q")) % 2 == 0
        return 'Sure: ```json\n{"selected": [3, 99, 1, 3], "reasoning": "two\nlines"}\n```' if even else "no idea"

    return assembly.curate(rows, answer, keep=3)


@query(f"""SELECT conv_id, turn, strftime(DATE '2024-02-01' + CAST(conv_id % 5 AS INTEGER), '%Y-%m-%d') AS deadline, 'high' AS urgency FROM conversations WHERE role = 'user' AND conv_id % 3 = 0""")
def mail_deadlines(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    mails = c.select("conv_id", "turn", F.concat(F.lit("S"), F.col("conv_id").cast("string")).alias("subject"), F.col("text").alias("body"), F.lit(TODAY).alias("date"))

    def answer(prompt):
        k = int(prompt.split("Subject: S")[1].split("\n")[0])
        return '{"has_actionable_deadline": %s, "deadline": "2024-02-%02d", "urgency": "high"}' % ("true" if k % 3 == 0 else "false", 1 + k % 5)

    return assembly.deadline_signals(mails, answer, TODAY).select("conv_id", "turn", "deadline", "urgency")


@query("""WITH t AS (SELECT u.conv_id, u.turn, u.text AS said, a.text AS heard FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')
SELECT CAST(conv_id AS VARCHAR) AS session, turn, 'fact' AS kind, substring(trim(said), 1, 240) AS text, CAST(0.5 AS DOUBLE) AS salience FROM t WHERE trim(said) <> '' AND trim(heard) <> '' AND length(said) + length(heard) >= 80""")
def harvested_turns(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant"))
    t = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user")).join(a, ["conv_id", "turn"]).withColumn("session", F.col("conv_id").cast("string"))

    def answer(prompt):
        import json

        said = prompt.split("<<<", 1)[1].rsplit(">>>", 1)[0]
        return json.dumps({"items": [{"kind": "fact", "text": said}, {"kind": "joke", "text": "no"}, {"kind": "question", "text": " "}]})

    return assembly.harvest_turns(t, answer).select("session", "turn", "kind", "text", "salience")


@query(f"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS session, count(*) AS turns FROM conversations GROUP BY ALL), i AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session, conv_id % 4 AS turn_count, TIMESTAMP '{TODAY} 12:00:00' - to_minutes(CAST(conv_id % 120 AS INTEGER)) AS last_at FROM conversations WHERE conv_id % 3 <> 0)
SELECT session, CAST(coalesce(turn_count, 0) AS BIGINT) AS from_turn, turns, coalesce(epoch(TIMESTAMP '{TODAY} 12:00:00') - epoch(last_at) >= 3600, true) AS due FROM t LEFT JOIN i USING (session) WHERE turns > coalesce(turn_count, 0)""")
def due_sessions(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    now = f"{TODAY} 12:00:00"
    k = F.col("conv_id")
    index = c.where(k % 3 != 0).select(k.cast("string").alias("session"), (k % 4).alias("turn_count"), (T.ntz(now) - F.make_dt_interval(F.lit(0), F.lit(0), (k % 120).cast("int"))).alias("last_at")).distinct()
    return assembly.due_sessions(c.withColumn("session", k.cast("string")), index, now)


@query("WITH r AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'remove' ELSE 'restore' END DESC) AS n FROM events) SELECT 'p' || user_id AS path, ts AS pinned_at FROM r WHERE n = 1 AND event_type <> 'view'")
def pinned_pages(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "click", "add").when(F.col("event_type") == "view", "remove").otherwise("restore")
    return assembly.pinned(e.select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("path"), op.alias("op"), F.col("ts").alias("at")))


@query(f"""WITH {T.ENTITIES}, {T.EDGES}, {_REJ}, e AS (SELECT e.src, e.dst, e.type, {_NORM.format('coalesce(a.name, e.src)')} AS ns, {_NORM.format('coalesce(b.name, e.dst)')} AS no FROM edges e LEFT JOIN entities a ON a.eid = e.src LEFT JOIN entities b ON b.eid = e.dst)
SELECT src, dst, type FROM e WHERE NOT EXISTS (SELECT 1 FROM rejected r WHERE {_NORM.format('r.subject')} = ns AND r.relation = e.type AND {_NORM.format('r.object')} = no) AND NOT EXISTS (SELECT 1 FROM truths g WHERE g.relation IN {tuple(memory.SINGLE_VALUED)} AND {_NORM.format('g.subject')} = ns AND g.relation = e.type AND {_NORM.format('g.object')} <> no)""")
def purged_edges(spark, sf_dir):
    rejected, truths = rejected_and_truths(spark, sf_dir)
    return memory.purge_rejected(T.edges(spark, sf_dir), T.entities(spark, sf_dir), rejected, truths).select("src", "dst", "type")


@query(f"WITH {T.MEMORY_FILES} SELECT string_split(path, '/')[2] AS folder, 'MEMORY/_archive/20240131-000000/' || string_split(path, '/')[2] AS destination, count(*) AS n_files FROM memory_files WHERE string_split(path, '/')[2] IN ('accounts', 'decisions') GROUP BY ALL")
def archive_plan(spark, sf_dir):
    return ingest.archive_plan(T.memory_files(spark, sf_dir), "20240131-000000")


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'llama3.1:latest' ELSE 'x:1' END WHEN turn % 4 = 1 THEN CASE WHEN conv_id % 2 = 0 THEN 'qwen2.5:7b' ELSE 'claude-haiku-4-5' END WHEN turn % 4 = 2 THEN 'claude-haiku-4-5' ELSE 'llama3.1:latest' END AS model FROM conversations")
def selected_models(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    op = T.pick(["query_classification", "graph_extraction", "memory_compression", "unknown"], F.col("turn"))
    local = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("x:1"), F.lit("qwen2.5:7b"), F.lit("llama3.1:latest"))).otherwise(F.array(F.lit("x:1")))
    return c.select("conv_id", "turn", S.select_model(op, local)["model"].alias("model"))


# --- specialists ----------------------------------------------------------------------------------------------------

def _says_sql(words):
    return f"list_bool_or(list_transform({sql_list(words)}, lambda w: contains(low, w)))"


_PICKS = "list_filter([" + ", ".join(f"CASE WHEN {_says_sql(words)} THEN '{key}' END" for key, words in completion.SPECIALIST_WORDS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS low FROM conversations), p AS (SELECT *, {_PICKS} AS picks FROM q),
d AS (SELECT *, CASE WHEN len(picks) = 0 THEN {sql_list(completion.DEFAULT_SPECIALISTS)} ELSE picks END AS chosen FROM p)
SELECT conv_id, turn, array_to_string((CASE WHEN {_says_sql(completion.KNOWING_WORDS)} THEN chosen ELSE list_prepend('{completion.CRITIC}', chosen) END)[1:3], ' ') AS asked FROM d""")
def question_specialists(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(completion.specialists(F.col("text")), " ").alias("asked"))


# --- views ----------------------------------------------------------------------------------------------------------

_STATUS = "CASE WHEN severity <> 'low' THEN 'unresolved' WHEN confidence > 0.8 THEN 'resolved_B' ELSE 'resolved_A' END"
_GRAVE = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


@query(f"WITH {_CONTRA}, o AS (SELECT src, type, old_dst, new_dst, severity, {_STATUS} AS status FROM contra WHERE {_STATUS} = 'unresolved') SELECT *, (SELECT count(*) FROM o) AS total FROM o ORDER BY {_GRAVE}, src, type, old_dst, new_dst LIMIT 50")
def open_contradictions(spark, sf_dir):
    return views.open_contradictions(memory.auto_resolve(_contradictions(spark, sf_dir)))


@query(f"WITH {_CONTRA} SELECT src, type, old_dst, new_dst, severity FROM contra ORDER BY {_GRAVE}, src, type, old_dst, new_dst LIMIT 5")
def contradiction_block(spark, sf_dir):
    return assembly.contradiction_block(_contradictions(spark, sf_dir)).select("src", "type", "old_dst", "new_dst", "severity")


@query(f"WITH {_LINKED} SELECT question, priority FROM questions ORDER BY CASE priority WHEN 'high' THEN 0 ELSE 1 END, question LIMIT 10")
def question_block(spark, sf_dir):
    e = T.entities(spark, sf_dir)
    q = ingest.question_priority(ingest.link_questions(_questions(spark, sf_dir), _ordered(e), order="ord"), e)
    return assembly.question_block(q).select("question", "priority")


@query(f"""WITH {_LINKED}, li AS (SELECT doc_id, pos, eid, count(*) OVER (PARTITION BY doc_id, pos) AS n FROM hr WHERE i <= 8), fresh AS (SELECT eid FROM entities WHERE last_activated >= TIMESTAMP '{T.AS_OF}' - to_days(250)),
h AS (SELECT doc_id, pos, n, count(*) AS hits FROM li JOIN fresh USING (eid) GROUP BY ALL) SELECT doc_id, pos, hits, round(hits / n, 2) AS relevance, hits / n > 0.7 AS may_answer FROM h WHERE hits / n >= 0.4""")
def surfaced_questions(spark, sf_dir):
    """Questions that entities of the last 250 days may answer."""
    e = T.entities(spark, sf_dir)
    fresh = e.where(F.col("last_activated") >= T.days_before(T.AS_OF, F.lit(250))).select("eid")
    linked = ingest.link_questions(_questions(spark, sf_dir), _ordered(e), order="ord")
    return ingest.surface_questions(linked, fresh).select("doc_id", "pos", "hits", "relevance", "may_answer")


_MARKED_TEXT = "CASE WHEN conv_id % 3 = 0 THEN text || chr(10) || '**Status:** open' || chr(10) || 'x' WHEN conv_id % 3 = 1 THEN '**Status:** ' || text ELSE text || '**Review:** later' END"


@query(f"""WITH q AS (SELECT conv_id || '-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS id, {_MARKED_TEXT} AS t, CASE WHEN turn % 2 = 0 THEN 'high' END AS priority, ['open', 'closed', NULL, 'stale'][turn % 4 + 1] AS status FROM conversations WHERE role = 'user'),
o AS (SELECT id, t, coalesce(priority, 'medium') AS priority, coalesce(status, 'open') AS status, trim(regexp_replace(trim(regexp_replace(t, '(?s)\\*\\*Status:\\*\\*.*$', '')), '(?s)\\*\\*Review:\\*\\*.*$', '')) AS c FROM q WHERE coalesce(status, 'open') NOT IN {tuple(views.CLOSED)})
SELECT id, substring(CASE WHEN c <> '' THEN c ELSE t END, 1, 400) AS text, priority, status, (SELECT count(*) FROM o) AS total FROM o ORDER BY id LIMIT 50""")
def listed_questions(spark, sf_dir):
    """What users said, as questions whose templates left marks."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    k, t = F.col("conv_id") % 3, F.col("text")
    text = F.when(k == 0, F.concat(t, F.lit("\n**Status:** open\nx"))).when(k == 1, F.concat(F.lit("**Status:** "), t)).otherwise(F.concat(t, F.lit("**Review:** later")))
    number = F.lpad(F.col("turn").cast("string"), 4, "0")
    status = F.get(F.array(F.lit("open"), F.lit("closed"), F.lit(None), F.lit("stale")), (F.col("turn") % 4).cast("int"))
    q = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), number).alias("id"), text.alias("text"), F.when(F.col("turn") % 2 == 0, "high").alias("priority"), status.alias("status"))
    return views.open_questions(q)


@query(f"""WITH {T.PROPOSALS}, s AS ({ORACLE['proposal_salience']}), o AS (SELECT p.*, s.salience FROM proposals p JOIN s USING (uid) WHERE status = 'pending')
SELECT uid, path, substring(coalesce(reason, ''), 1, 300) AS reason, round(salience, 2) AS salience, strftime(ts, '%Y-%m-%d %H:%M') AS ts, (SELECT count(*) FROM o) AS total FROM o ORDER BY o.salience DESC, o.ts DESC, uid LIMIT 80""")
def pending_proposals(spark, sf_dir):
    p = T.proposals(spark, sf_dir)
    return views.pending_proposals(p.withColumn("salience", S.proposal_salience(F.col("path"), F.col("reason"))))


@query(f"""WITH a AS ({ORACLE['pressing_events']}), c0 AS ({ORACLE['calendar_order']}), b AS (SELECT * FROM ({ORACLE['pinned_pages']}) ORDER BY pinned_at DESC, path LIMIT 30), d AS ({ORACLE['deadlines']})
SELECT 'event' AS kind, row_number() OVER (ORDER BY c0.iso, rank) AS place, summary AS label, c0.iso AS at FROM a JOIN c0 USING (event_id)
UNION ALL SELECT 'pinned', row_number() OVER (ORDER BY pinned_at DESC, path), path, strftime(pinned_at, '%Y-%m-%d %H:%M:%S') FROM b
UNION ALL SELECT 'deadline', row_number() OVER (ORDER BY rank, path), path, deadline FROM d""")
def top_of_mind_view(spark, sf_dir):
    events = signals.calendar_order(T.calendar(spark, sf_dir))
    return views.top_of_mind(events, pinned_pages(spark, sf_dir), signals.deadlines(T.signals(spark, sf_dir), TODAY), TODAY, UNTIL)


_ENDS = "SELECT src AS node, 0 AS way, src, type, dst, dst AS other FROM edges UNION ALL SELECT dst, 1, src, type, dst, src FROM edges"


@query(f"""WITH {T.ENTITIES}, {T.EDGES}, n AS (SELECT eid, name, type FROM entities WHERE type IN ('decision', 'deal', 'place')), e AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY way, src, type, dst) AS i FROM ({_ENDS}) WHERE node IN (SELECT eid FROM n)),
t AS (SELECT node, string_agg(CASE WHEN way = 0 THEN e.type || ' → ' || coalesce(o.name, other) ELSE coalesce(o.name, other) || ' → ' || e.type END, '; ' ORDER BY i) AS l FROM e LEFT JOIN entities o ON o.eid = other WHERE i <= 4 GROUP BY node)
SELECT eid, '- ' || name || ' (' || type || ')' || coalesce(' [' || l || ']', '') AS line FROM n LEFT JOIN t ON node = eid""")
def context_lines(spark, sf_dir):
    e = T.entities(spark, sf_dir)
    return views.context_block(e, T.edges(spark, sf_dir), e.where(F.col("type").isin("decision", "deal", "place")).select("eid"))


_OLD = "CASE WHEN (activation_count % 3) = 0 THEN NULL ELSE {0} END"


@query(f"""WITH {T.ENTITIES}, o AS (SELECT * REPLACE ({_OLD.format('tier')} AS tier), CASE WHEN activation_count % 5 = 0 THEN NULL ELSE ris END AS r FROM entities),
m AS (SELECT eid, tier IS NULL AS upgraded, CASE WHEN tier IS NULL THEN {_ETIER} ELSE tier END AS tier, round(CASE WHEN tier IS NULL THEN CAST({_INFER} AS DOUBLE) ELSE computed END, 6) AS computed, CASE WHEN tier IS NULL THEN coalesce(r, 0.0) ELSE r END AS ris FROM o) SELECT * FROM m""")
def migrated_entities(spark, sf_dir):
    """Entities of which a third lack a tier, and some a reinforcement."""
    return _migrated(spark, sf_dir)[0].select("eid", "upgraded", "tier", F.round("computed", 6).alias("computed"), "ris")


_PATHS = f"[{T._PATH_SQL.format('key % 200')}, {T._PATH_SQL.format('(key * 3) % 200')}]"


@query(f"""WITH {T.ENTITIES}, {T.EDGES}, m AS (SELECT eid, CASE WHEN activation_count % 3 = 0 THEN {_ETIER} ELSE tier END AS tier FROM entities),
k AS (SELECT *, CASE src[1:1] WHEN 'c' THEN CAST(src[6:] AS BIGINT) WHEN 's' THEN CAST(src[6:] AS BIGINT) ELSE CAST(src[5:] AS BIGINT) END AS key FROM edges), k2 AS (SELECT *, activation_count % 2 = 0 AS old, {_PATHS} AS sources FROM k),
u AS (SELECT src, dst, type, unnest(sources) AS path, '' AS body FROM k2), l AS (SELECT src, dst, type, {_LABEL} AS label FROM u), c AS (SELECT src, dst, type, avg(CAST({_case_sql('label', S.CREDIBILITY, 0.5)} AS DOUBLE)) AS s FROM l GROUP BY ALL)
SELECT k2.src, k2.dst, k2.type, old AS upgraded, CASE WHEN old THEN {sql_list(T.TIERS)}[least(list_position({sql_list(T.TIERS)}, a.tier), list_position({sql_list(T.TIERS)}, b.tier))] ELSE k2.tier END AS tier, round(CASE WHEN old THEN s ELSE cred END, 6) AS cred
FROM k2 JOIN m a ON a.eid = k2.src JOIN m b ON b.eid = k2.dst JOIN c ON c.src = k2.src AND c.dst = k2.dst AND c.type = k2.type""")
def migrated_edges(spark, sf_dir):
    """Edges of which half lack a credibility."""
    return _migrated(spark, sf_dir)[1].select("src", "dst", "type", "upgraded", "tier", F.round("cred", 6).alias("cred"))


def _migrated(spark, sf_dir):
    e, d = T.entities(spark, sf_dir), T.edges(spark, sf_dir)
    e = e.withColumn("tier", F.when(F.col("activation_count") % 3 != 0, F.col("tier"))).withColumn("ris", F.when(F.col("activation_count") % 5 != 0, F.col("ris")))
    key = F.split("src", ":")[1].cast("long")
    path = lambda k: T.path_of(k, F.concat(F.lit("src"), (k % 20).cast("string")))
    d = d.withColumn("cred", F.when(F.col("activation_count") % 2 != 0, F.col("cred"))).withColumn("sources", F.array(path(key % 200), path(key * 3 % 200)))
    return memory.migrate_graph(e, d, T.AS_OF)
