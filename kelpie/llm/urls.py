"""URL filters: longest-match rules, and trust and distrust propagated over the host graph.

Only DataFrame operations. Hosts are nodes; the links of pages and the steps between a host and its parent domain are
edges. Trust is a personalised PageRank from the hosts of allowed pages along the edges; distrust is one from the
hosts of blocked pages along the reversed edges (who links to a bad host is suspect). A host is blocked if its
distrust is over its trust by more than a threshold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import checkpointed, quoted, release, shuffle_partitions, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path). A rule fits its host and all subdomains if the path starts with the rule's.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Keys that the pages of a host are dealt over when its score is joined to them.
SALTS = 32
#: Scores have settled when a round changes them in total by at most this share of the mass of the seeds.
TOLERANCE = 1e-6
#: Rows that a task of a round holds at least, so that the many rounds over a small graph don't run many tasks each.
TASK_ROWS = 50_000


def host_of(url):
    """After the first :// up to / ? # or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url):
    """After the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules=RULES):
    """(rule, verdict) of the longest rule that fits, both null if none does; equal lengths: the first in byte order."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-b for b in r[1].encode()])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def parent_of(host):
    """The host without its first label, if two labels or more are left; else null."""
    rest = F.regexp_extract(host, r"^[^.]+\.(.+\..+)$", 1)
    return F.when(rest != "", rest)


def host_edges(pages, url_col="url", html_col="html"):
    """(src, dst, n): links between different hosts, and each host's steps to and from its parent domain."""
    host = host_of(F.col(url_col))
    found = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'>\s]+)"""), F.lit(1))
    links = pages.select(host.alias("src"), F.explode(found).alias("dst")).select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    links = links.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.select(host.alias("host")).distinct().union(links.select("dst")).where(F.col("host") != "").distinct()
    ups = hosts.select("host", parent_of(F.col("host")).alias("up")).where(F.col("up").isNotNull())
    ups = ups.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("up").alias("dst")), F.struct(F.col("up").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.src", "e.dst", F.lit(1).cast("long").alias("n"))
    return links.union(ups).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges, seeds, tolerance=TOLERANCE, most=200, follow=0.85):
    """Personalised PageRank of several kinds at once, iterated until it has settled.

    edges: (kind, src, dst, share), shares of a src sum to 1. seeds: (kind, host, mass). Returns (kind, host, mass).
    A round passes on what the round before added (move), so masses only grow, and the sum of move is their total change.
    It ends when, in each kind, a round's change is at most tolerance times the mass of the seeds; what is missing from
    all hosts together is then under follow / (1 - follow) times that. As a round passes on `follow` of the last one's
    change at the most, and the first adds 1 - follow of the mass, this takes up to 74 rounds at 1e-6. It's an error if `most` rounds don't do.
    Tables are cut from their lineage, and the change is tested, every second round.
    """
    total = {r["kind"]: r["mass"] for r in seeds.groupBy("kind").agg(F.sum("mass").alias("mass")).collect()}
    rank = seeds.groupBy("kind", "host").agg((F.sum("mass") * (1 - follow)).alias("mass")).withColumn("move", F.col("mass"))
    tasks = min(shuffle_partitions(edges.sparkSession), (edges.count() + seeds.count()) // TASK_ROWS + 1)
    edges = edges.withColumnRenamed("src", "host")
    for i in range(most):
        moved = rank.where(F.col("move") > 0).join(edges, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("move") * F.col("share") * follow).alias("move"))
        rank = rank.select("kind", "host", "mass", F.lit(0.0).alias("move")).unionByName(moved.select("kind", "host", F.col("move").alias("mass"), "move")).groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("move").alias("move")).coalesce(tasks)
        if i % 2:
            rank = checkpointed(rank)
            change = {r["kind"]: r["move"] for r in rank.groupBy("kind").agg(F.sum("move").alias("move")).collect()}
            if all(change.get(kind, 0.0) <= tolerance * mass for kind, mass in total.items()):
                return rank.select("kind", "host", "mass")
            if i % 8 == 7:
                release(edges.sparkSession)
    raise RuntimeError(f"masses didn't settle in {most} rounds")


def judge(pages, rules=RULES, tolerance=TOLERANCE, threshold=0.5, id_col="page_id", url_col="url", html_col="html"):
    """(id_col, host, path, rule, verdict, trust, distrust) of every page.

    verdict: the longest rule's, else block where the host's distrust is over its trust by more than threshold, else allow.
    A null url, or one without ://, has an empty host and path and no rule, and is allowed. Null html has no links.
    Repeated rows are each judged. Masses are per host, where a host whose ruled pages are all of one verdict is a seed of mass 1; they are iterated until
    they have settled (see propagate). Texts are read whole; columns may bear any name but those of the results.
    """
    plain = pages.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(url_col)).alias("_url"), F.col(quoted(html_col)).alias("_html"))
    return _judge(plain, rules, tolerance, threshold, "_id", "_url", "_html").withColumnRenamed("_id", id_col)


def _judge(pages, rules, tolerance, threshold, id_col, url_col, html_col):
    rows = pages.select(id_col, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("_found", rule_of(F.col("host"), F.col("path"), rules)).select(id_col, "host", "path", F.col("_found.rule").alias("rule"), F.col("_found.verdict").alias("_verdict"))
    hosts = rows.where(F.col("host") != "").groupBy("host").agg(F.count(F.when(F.col("_verdict") == "allow", 1)).alias("good"), F.count(F.when(F.col("_verdict") == "block", 1)).alias("bad"))
    seeds = hosts.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.try_divide("good", F.col("good") + F.col("bad")).alias("mass")), F.struct(F.lit("distrust").alias("kind"), F.try_divide("bad", F.col("good") + F.col("bad")).alias("mass")))).alias("s"))
    seeds = checkpointed(seeds.select("s.kind", "host", "s.mass").where(F.col("mass") > 0))
    edges = host_edges(pages, url_col, html_col)
    both = edges.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), "src", "dst", "n"), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))).alias("e")).select("e.*")
    both = written(both, "edges")
    out_degree = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    both = written(both.join(out_degree, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "shares")
    rank = propagate(both, seeds, tolerance)
    scores = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(0.0)).alias("distrust"))
    # pages of one host are dealt over SALTS keys, and its score to each of them
    scores = scores.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(id_col, "path"), F.lit(SALTS)).cast("int"))
    out = rows.join(scores, ["host", "_salt"], "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    own = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return out.select(id_col, "host", "path", "rule", F.coalesce("_verdict", own).alias("verdict"), "trust", "distrust")
