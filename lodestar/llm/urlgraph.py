"""URL filters: rules for hosts and paths, and trust propagated over the graph of hosts for all other urls.

A url's own rule, if one fits, decides. Else its host's standing does: personalised PageRank flows from trusted seeds along links,
distrust flows from blocked seeds against them (who links to the blocked is suspect). Distrust is divided among all that link to a
host, so suspicion does the same with shares of the linking host's own links, which don't shrink as a blocked host has more links to it.
A host is blocked where distrust or suspicion is above both a threshold and its trust. A host is a seed by the share of its urls that
an allow or a block rule decides.

Links of all pages are counted per pair of hosts before anything is dealt out; the flows run as one table with a kind
column, one join and one sum an iteration, checkpointed so that the lineage stays short. Scores aren't scaled by the number
of hosts: an isolated host whose urls are all blocked by rules has distrust 1 - damping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import checkpoint, fresh, join_checked

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DAMPING = 0.85
ITERATIONS = 12
#: A host is blocked at this share of what a wholly blocked seed has from its own rules, or more.
THRESHOLD = 0.5
#: Links of a host that are dealt out together.
PART = 10_000
HREF = r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of each of ``hosts`` and of its parent domains, longest first; only hosts that have some."""
    names = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, k, F.size(names)), "."))
    each = hosts.select("host", F.explode(F.array_distinct(parents)).alias("of"))
    known = rules.select(F.col("host").alias("of"), F.struct((-F.length(F.concat("host", "path"))).alias("order"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("rule"))
    return each.join(known, "of").groupBy("host").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def host_links(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, links): absolute links between different hosts, counted per pair."""
    found = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(HREF), 1)).alias("url"))
    found = found.select("src", host_of(F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))).alias("dst"))
    return found.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def standings(links: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(host, trust, distrust, suspicion) of every host that a flow reaches.

    ``links`` (src, dst, links), ``seeds`` (host, trust, distrust, each 0 to 1). A host passes damping times its score on, by its links'
    counts; what a host without links would pass on is lost, for trust and distrust alike. Suspicion starts as distrust does; a host has damping times
    the mean suspicion of what it links to.
    """
    flows = links.select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "links").unionAll(links.select(F.lit("distrust"), "dst", "src", "links"))
    total = flows.groupBy("kind", "from").agg(F.sum("links").alias("total"))
    shared = flows.join(total, ["kind", "from"]).select("kind", "from", "to", (F.col("links") / F.col("total") * damping).alias("share"))
    flows = shared.unionAll(shared.where("kind = 'trust'").select(F.lit("suspicion"), "to", "from", "share"))
    # a host with many links is dealt out in parts, and its score goes to each of them
    parts = flows.groupBy("kind", "from").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    flows = checkpoint(flows.join(parts, ["kind", "from"]).withColumn("part", F.pmod(F.xxhash64("to"), F.col("parts"))))
    parts = checkpoint(parts.select(F.col("kind").alias("of_kind"), F.col("from").alias("of"), F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1).alias("part")))
    start = seeds.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("host"), (F.col(of) * (1 - damping)).alias("score")) for k, of in (("trust", "trust"), ("distrust", "distrust"), ("suspicion", "distrust"))])).alias("s")).select("s.*").where("score > 0")
    start = checkpoint(start)
    scores = start
    if not flows.isEmpty():
        for k in range(iterations):
            dealt = scores.join(parts, (scores.kind == parts.of_kind) & (scores.host == parts.of)).select("of_kind", "of", "score", F.explode("part").alias("of_part"))
            passed = dealt.join(flows, (dealt.of_kind == flows.kind) & (dealt.of == flows["from"]) & (dealt.of_part == flows.part))
            passed = passed.select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share")).alias("score"))
            scores = start.unionAll(passed).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            if k % 3 == 2 or k == iterations - 1:
                scores = checkpoint(scores)
    side = lambda k: F.round(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)), 9).alias(k)
    return scores.groupBy("host").agg(side("trust"), side("distrust"), side("suspicion"))


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", html_col: str = "html", damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits), trust, distrust and verdict (allow or block).

    Null urls and those without ``://`` have an empty host and path, no rule and no links; they and unknown hosts are allowed. Repeated
    rows count as urls of their own; columns named like new ones are replaced; null html has no links; an empty table gives an
    empty table; a very long url or page is read in whole. Rules (host, path, verdict) fit a host, its subdomains and all paths that start like theirs; the longest decides, ties by text.
    """
    own = pages.drop("host", "path", "rule", "trust", "distrust", "verdict") if {url_col, html_col}.isdisjoint({"host", "path", "rule", "trust", "distrust", "verdict"}) else pages
    located = lambda df: df.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    told = rules.select("host", "path", "verdict").distinct()
    rule = fresh(pages, "_rule")
    urls = located(pages.select(F.col(url_col).alias(url_col)))
    known = checkpoint(host_rules(urls.select("host").where("host <> ''").distinct(), told))

    def ruled(df: DataFrame) -> DataFrame:
        of, held = fresh(df, "_of"), fresh(df, "_rules")
        joined = join_checked(df, known.select(F.col("host").alias(of), F.col("rules").alias(held)), F.col("host"), of)
        fit = F.filter(held, lambda r: F.startswith(F.col("path"), r["path"]))
        return joined.withColumn(rule, F.try_element_at(fit, F.lit(1))).drop(of, held)

    share = lambda v: F.avg((F.coalesce(F.col(f"{rule}.verdict"), F.lit("")) == v).cast("int"))
    seeds = ruled(urls).where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    standing = standings(checkpoint(host_links(pages, url_col=url_col, html_col=html_col)), checkpoint(seeds), damping=damping)
    judged = ruled(located(own))
    of, bad = fresh(judged, "_of"), fresh(judged, "_bad")
    worst = F.greatest("distrust", "suspicion")
    blocked = (worst >= round(threshold * (1 - damping), 9)) & (worst > F.col("trust"))
    standing = checkpoint(standing.select(F.col("host").alias(of), "trust", "distrust", blocked.alias(bad)))
    judged = join_checked(judged, standing, F.col("host"), of).drop(of)
    judged = judged.withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    verdict = F.coalesce(F.col(f"{rule}.verdict"), F.when(F.col(bad), "block").otherwise("allow"))
    return judged.withColumn("verdict", verdict).withColumn("rule", F.col(f"{rule}.rule")).drop(rule, bad)


def url_digest(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, trust, distrust."""
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages.select("page_id", "url", "html"), rules).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
