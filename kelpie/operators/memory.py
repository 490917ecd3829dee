"""Maintenance of the graph: decay, reinforcement, promotion, contradictions, expiry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.functions import scoring as S
from kelpie.functions.text import normal_object

#: Fixed values.
SINGLE_VALUED = (
    "reports_to current_manager current_role current_title current_position current_employer currently_works_at employed_by ceo_of cto_of cfo_of cpo_of coo_of "
    "located_at based_in headquartered_in current_status current_phase current_state primary_owner responsible_for_account directly_responsible dri current_vendor selected_vendor"
).split()
INCOMPATIBLE = [("reports_to", "manages", "role_conflict"), ("owns", "owned_by", "ownership_conflict"), ("competes_with", "partners_with", "stance_conflict")]
AUTHORITATIVE = ["/CLAUDE.md", "/context/people", "/context/org_", "/context/responsibility_", "/context/bob_smith", "/context/acmecorp_product_org", "/decisions/"]
ORG_RELATIONS = "reports_to current_manager current_role current_title current_employer currently_works_at employed_by manages leads owns ceo_of cto_of cfo_of cpo_of coo_of".split()


def recompute_weights(edges, as_of):
    """Edges with new_weight (four decimals) and archived (under 0.05 and not crystallised). The maximum count is one pre-aggregated row."""
    most = edges.agg(F.max("activation_count").alias("_most"))
    r = edges.crossJoin(F.broadcast(most)).withColumn("_w", S.edge_weight(edges, F.lit(as_of).cast("timestamp_ntz"), F.coalesce("_most", F.lit(1))))
    return r.withColumn("new_weight", F.round("_w", 4)).withColumn("archived", (F.col("_w") < 0.05) & (F.col("tier") != "crystallised")).drop("_most", "_w")


def entity_weights(entities, as_of):
    return entities.withColumn("weight", F.round(S.entity_weight(entities, F.lit(as_of).cast("timestamp_ntz")), 4))


def entity_credibility(entities):
    """(eid, credibility): the mean over an entity's sources, or the best where the user stated or uploaded one."""
    r = entities.select("eid", F.explode("sources").alias("path")).withColumn("label", S.source_label(F.col("path")))
    r = r.withColumn("s", S.credibility(F.col("label")))
    return r.groupBy("eid").agg(F.when(F.max(F.col("label").isin("user_statement", "user_upload")), F.max("s")).otherwise(F.avg("s")).alias("credibility"))


def reinforce_nodes(entities, activated, boost=0.03, most=0.25):
    """Entities whose activation (eid, strength) is used: more reinforcement up to a cap, one more activation."""
    r = entities.join(activated, "eid", "left")
    hit = F.col("strength").isNotNull()
    return r.withColumn("new_ris", F.when(hit, F.least(F.lit(most), F.col("ris") + boost * F.col("strength"))).otherwise(F.col("ris"))).withColumn("new_count", F.col("activation_count") + hit.cast("int")).drop("strength")


def reinforce_edges(edges, activated, boost=0.02, most=0.25):
    """Edges with both ends activated gain by the stronger end."""
    a = activated.select(F.col("eid").alias("src"), F.col("strength").alias("_a"))
    b = activated.select(F.col("eid").alias("dst"), F.col("strength").alias("_b"))
    r = edges.join(a, "src").join(b, "dst")
    return r.withColumn("new_ris", F.least(F.lit(most), F.col("ris") + boost * F.greatest("_a", "_b"))).withColumn("new_count", F.col("activation_count") + 1).drop("_a", "_b")


def crystallise(entities, chosen, reason="manual"):
    """Entities with those in chosen (eid) promoted: tier, reason and salience floors of 0.85."""
    r = entities.join(chosen.select("eid", F.lit(True).alias("_hit")), "eid", "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("tier") != "crystallised")
    for c in ("base", "computed"):
        r = r.withColumn(c, F.when(hit, F.greatest(F.lit(0.85), F.col(c))).otherwise(F.col(c)))
    return r.withColumn("reason", F.when(hit, F.lit(reason))).withColumn("tier", F.when(hit, "crystallised").otherwise(F.col("tier"))).drop("_hit")


def crystallise_edges(edges, chosen):
    """Edges that touch a chosen entity, promoted."""
    c = chosen.select("eid").distinct()
    a, b = c.select(F.col("eid").alias("src"), F.lit(True).alias("_a")), c.select(F.col("eid").alias("dst"), F.lit(True).alias("_b"))
    r = edges.join(a, "src", "left").join(b, "dst", "left")
    return r.withColumn("tier", F.when(F.coalesce("_a", "_b").isNotNull(), "crystallised").otherwise(F.col("tier"))).drop("_a", "_b")


def authoritative(source):
    return F.exists(F.array(*(F.lit(p) for p in AUTHORITATIVE)), lambda p: F.contains(source, p))


def find_contradictions(triples, edges, entities, threshold=0.7, rejected=None, truths=None):
    """(src, type, kind, old_type, old_dst, new_dst, severity, confidence): claims against the graph.

    A single-valued relation with another object, or an incompatible relation between the same two. Claims under the
    threshold, organisation relations from untrusted sources, rejected claims (subject, relation, object, by normal
    names) and claims against a ground truth of a single-valued relation are dropped first. Entities are shuffled to their
    ends (merge): by the size of its files Spark may take a table for small that is large in memory, and send it whole to
    every task.
    """
    names = entities.select("eid", "name", F.col("tier").alias("etier"))
    t = triples.where((F.col("confidence") >= threshold) & F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("type").isNotNull())
    t = t.where(~F.col("type").isin(*ORG_RELATIONS) | authoritative(F.coalesce("source", F.lit(""))))
    if rejected is not None or truths is not None:
        look = lambda side: names.select(F.col("eid").alias(side), F.col("name").alias(f"{side}_name")).hint("merge")
        t = t.join(look("src"), "src", "left").join(look("dst"), "dst", "left")
        t = t.withColumn("_s", normal_object(F.coalesce("src_name", "src"))).withColumn("_o", normal_object(F.coalesce("dst_name", "dst")))
        if rejected is not None:
            no = rejected.select(normal_object("subject").alias("_s"), F.col("relation").alias("type"), normal_object("object").alias("_o"))
            t = t.join(no, ["_s", "type", "_o"], "left_anti")
        if truths is not None:
            t = t.join(_truths(truths), ["_s", "type"], "left").where(F.col("_truth").isNull() | (F.col("_truth") == F.col("_o")))
        t = t.select("src", "dst", "type", "confidence", "source")
    old = edges.select("src", F.col("dst").alias("old_dst"), F.col("type").alias("old_type"), "weight", F.col("tier").alias("old_tier"))
    new = t.select("src", F.col("dst").alias("new_dst"), "type", "confidence")
    facts = new.where(F.col("type").isin(*SINGLE_VALUED)).join(old.withColumn("type", F.col("old_type")), ["src", "type"]).where("old_dst <> new_dst").withColumn("kind", F.lit("factual_conflict"))
    pairs = edges.sparkSession.createDataFrame([(a, b, k) for x, y, k in INCOMPATIBLE for a, b in ((x, y), (y, x))], "old_type string, type string, kind string")
    clash = new.join(old.withColumn("new_dst", F.col("old_dst")), ["src", "new_dst"]).join(F.broadcast(pairs), ["old_type", "type"])
    cols = ["src", "type", "kind", "old_type", "old_dst", "new_dst", "weight", "old_tier", "confidence"]
    r = facts.select(*cols).unionByName(clash.select(*cols))
    tier = lambda side, name: names.select(F.col("eid").alias(side), F.col("etier").alias(name)).hint("merge")
    r = r.join(tier("src", "_a"), "src", "left").join(tier("old_dst", "_b"), "old_dst", "left")
    high = (F.col("old_tier") == "crystallised") | F.coalesce(F.col("_a") == "crystallised", F.lit(False)) | F.coalesce(F.col("_b") == "crystallised", F.lit(False)) | F.col("old_type").isin("reports_to", "owns", "leads", "decides")
    return r.withColumn("severity", F.when(high, "high").when(F.coalesce("weight", F.lit(0.5)) > 0.6, "medium").otherwise("low")).drop("old_tier", "_a", "_b", "weight")


def purge_rejected(edges, entities, rejected, truths):
    """Edges without those that a rejected claim names, or that a ground truth (subject, relation, object) speaks against.

    Only truths of single-valued relations speak against other objects; of several of one subject the last counts (by a
    column `at`, else by the object). Ends are compared by the normal form of their names, or of their ids where they
    have none.
    """
    look = lambda side: entities.select(F.col("eid").alias(side), F.col("name").alias(f"_{side}")).hint("merge")
    r = edges.join(look("src"), "src", "left").join(look("dst"), "dst", "left")
    r = r.withColumn("_s", normal_object(F.coalesce("_src", "src"))).withColumn("_o", normal_object(F.coalesce("_dst", "dst")))
    no = rejected.select(normal_object("subject").alias("_s"), F.col("relation").alias("type"), normal_object("object").alias("_o")).distinct()
    yes = _truths(truths)
    r = r.join(no, ["_s", "type", "_o"], "left_anti").join(yes, ["_s", "type"], "left").where(F.col("_truth").isNull() | (F.col("_truth") == F.col("_o")))
    return r.select(*edges.columns)


def _truths(truths):
    """(_s, type, _truth): the object that counts for each subject and single-valued relation, by normal names."""
    last = F.struct("at", "object") if "at" in truths.columns else F.struct("object")
    yes = truths.where(F.col("relation").isin(*SINGLE_VALUED)).groupBy(normal_object("subject").alias("_s"), F.col("relation").alias("type"))
    return yes.agg(normal_object(F.max(last)["object"]).alias("_truth"))


def record_resolutions(resolved, rejected, truths):
    """(rejected, truths) after resolutions of (id, status, subject, relation, object_a, object_b): what isn't there yet is added.

    resolved_A rejects claim B and makes A a truth, where the relation has one value only; resolved_B the reverse;
    both_false rejects both; anything else changes nothing. Of several new truths of one subject the first id's stays.
    """
    claim = lambda side: [F.col("subject"), F.col("relation"), F.col(f"object_{side}").alias("object"), F.col("id").alias("source")]
    no = resolved.where(F.col("status").isin("resolved_B", "both_false")).select(*claim("a")).union(resolved.where(F.col("status").isin("resolved_A", "both_false")).select(*claim("b")))
    yes = resolved.where("status = 'resolved_A'").select(*claim("a")).union(resolved.where("status = 'resolved_B'").select(*claim("b"))).where(F.col("relation").isin(*SINGLE_VALUED))

    def added(old, new, keys):
        known = [normal_object(k).alias(f"_{k}") if k != "relation" else F.col(k).alias("_relation") for k in keys]
        names = [f"_{k}" for k in keys]
        fresh = new.select("*", *known).join(old.select(*known).distinct(), names, "left_anti")
        first = fresh.groupBy(*names).agg(F.min_by(F.struct("subject", "relation", "object"), F.struct("source", "object")).alias("c"))
        return old.select("subject", "relation", "object").unionByName(first.select("c.*"))

    return added(rejected, no, ["subject", "relation", "object"]), added(truths, yes, ["subject", "relation"])


def auto_resolve(contradictions):
    """Resolution of each: only low severity is decided, for the new claim where it is more confident."""
    return contradictions.withColumn("status", F.when(F.col("severity") != "low", "unresolved").when(F.col("confidence") > 0.8, "resolved_B").otherwise("resolved_A"))


def cascade(contradictions, winners):
    """Other open contradictions of the same subject and relation as a winner (src, type)."""
    return contradictions.join(winners.select("src", "type").distinct(), ["src", "type"], "left_semi")


def orphan_entities(entities, edges, least=0.1):
    """Entities (with weight) without edges, light and not crystallised.

    An outer join in place of an anti join, which Spark would repeat, with all ends, for each table that entities unite;
    the ends are shuffled, never sent whole.
    """
    ends = edges.select(F.col("src").alias("eid")).union(edges.select(F.col("dst").alias("eid"))).distinct().withColumn("_end", F.lit(True))
    light = entities.where((F.col("weight") < least) & (F.col("tier") != "crystallised"))
    return light.join(ends.hint("merge"), "eid", "left").where("_end is null").drop("_end")


def prune_sources(entities, files):
    """(eid, sources): sources that still exist; entities without any are dropped."""
    r = entities.select("eid", F.posexplode("sources").alias("pos", "path")).join(files.select("path"), "path", "left_semi")
    return r.groupBy("eid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("sources"))


def expire_working(files, as_of, hours=48):
    """(path, new_path): files of the working folder older than some hours move to the episodic one.

    A name that the episodic folder has already, or that an earlier mover takes, gets the file's time.
    """
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("mtime").cast("timestamp"))) / 3600.0
    r = files.where(F.col("path").startswith("MEMORY/working/") & F.col("path").endswith(".md") & (age > hours)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    there = files.where(F.col("path").rlike("^MEMORY/episodic/[^/]+$")).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(True).alias("_there")).distinct()
    r = r.join(there, "name", "left")
    again = (F.row_number().over(Window.partitionBy("name").orderBy("path")) > 1) | F.coalesce("_there", F.lit(False))
    stamp = F.concat(F.lit("_"), F.unix_timestamp(F.col("mtime").cast("timestamp")).cast("string"))
    return r.select("path", F.concat(F.lit("MEMORY/episodic/"), F.regexp_replace("name", r"\.md$", ""), F.when(again, stamp).otherwise(""), F.lit(".md")).alias("new_path"))


#: Folders whose files are never compressed, and the mark of what has been.
KEPT_FOLDERS, COMPRESSED = ["crystallised", "working", "context"], "[Compressed "


def select_for_compression(files, as_of):
    """(path, tier, age_days, savings): per age tier the files that save most, within its nightly budget (fixed values).

    Markdown files below the first folder of path; those of kept folders and those whose end says that they were
    compressed before don't count. Only the last 300 characters of a body are looked at, and none is shuffled; a task sends
    on no more files of a tier than the greatest budget.
    """
    budget, ratio = {"aging": 30, "mature": 20, "ancient": 10}, {"aging": 0.60, "mature": 0.25, "ancient": 0.10}
    days = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("mtime").cast("timestamp"))) / 86400.0
    parts = F.split("path", "/")
    kept = (F.size(parts) > 2) & F.get(parts, F.lit(1)).isin(*KEPT_FOLDERS)
    fit = files.where(F.endswith("path", F.lit(".md")) & ~kept & ~F.contains(F.substring("body", -300, 300), F.lit(COMPRESSED)))
    r = fit.select("path", "size_bytes", days.alias("age_days")).withColumn("tier", S.age_tier(F.col("age_days"))).where("tier <> 'fresh'")
    r = r.withColumn("savings", F.col("size_bytes") * (1 - S._case(F.col("tier"), ratio, 1.0)))
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy("tier").orderBy(F.desc(F.round("savings", 6)), "path")))
    r = r.where(F.col("rank") <= max(budget.values()))  # a plain number, which Spark takes as a limit before it shuffles
    return r.where(F.col("rank") <= S._case(F.col("tier"), budget, 0)).select("path", "tier", F.round("age_days", 1).alias("age_days"), F.floor(F.round("savings", 6)).alias("savings"))


def migrate(entities):
    """Re-tiered from the first source and with inferred salience: what older rows lack."""
    return entities.withColumn("new_tier", S.entity_tier(F.col("type"), F.get("sources", F.lit(0)))).withColumn("new_salience", S.infer_salience(entities))


def migrate_graph(entities, edges, as_of):
    """(entities, edges) with what older rows lack, and upgraded: whether a row lacked it.

    An entity that has a tier and a salience (computed) stays as it is; others get their tier from type and first source,
    an inferred salience, and zero counts or the clock where those are null. An edge that has a tier and a credibility
    stays; others get the lesser tier of their ends as migrated (semantic for unknown ones) and the credibility of their
    sources.
    """
    clock = F.lit(as_of).cast("timestamp_ntz")
    e = entities.withColumn("upgraded", F.col("tier").isNull() | F.col("computed").isNull())
    for column, value in (("ris", F.lit(0.0)), ("activation_count", F.lit(0)), ("last_activated", clock), ("sources", F.array().cast("array<string>"))):
        e = e.withColumn(column, F.when(F.col("upgraded"), F.coalesce(column, value)).otherwise(F.col(column)))
    tier, salience = S.entity_tier(F.col("type"), F.coalesce(F.get("sources", F.lit(0)), F.lit(""))), S.infer_salience(e)
    e = e.withColumn("computed", F.when(F.col("upgraded"), salience).otherwise(F.col("computed"))).withColumn("tier", F.when(F.col("upgraded"), tier).otherwise(F.col("tier")))
    end = lambda side: e.select(F.col("eid").alias(side), F.col("tier").alias(f"_{side}"))
    d = edges.withColumn("upgraded", F.col("tier").isNull() | F.col("cred").isNull()).join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    for column, value in (("ris", F.lit(0.0)), ("activation_count", F.lit(0)), ("last_activated", clock)):
        d = d.withColumn(column, F.when(F.col("upgraded"), F.coalesce(column, value)).otherwise(F.col(column)))
    lesser = S.edge_tier(F.coalesce("_src", F.lit("semantic")), F.coalesce("_dst", F.lit("semantic")), F.col("type"))
    d = d.withColumn("tier", F.when(F.col("upgraded"), lesser).otherwise(F.col("tier"))).withColumn("cred", F.when(F.col("upgraded"), _credibility_of(F.col("sources"))).otherwise(F.col("cred")))
    return e, d.drop("_src", "_dst")


def _credibility_of(sources):
    """The mean credibility of an array of sources, or the best where the user stated or uploaded one; unknown without any."""
    labels = F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda x: S.source_label(x))
    values = F.transform(labels, lambda x: S.credibility(x))
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    own = F.exists(labels, lambda x: x.isin("user_statement", "user_upload"))
    return F.when(F.size(values) == 0, F.lit(S.CREDIBILITY["unknown"])).when(own, F.array_max(values)).otherwise(mean)
