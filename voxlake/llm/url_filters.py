"""URL filters: ordered host and path rules, and a path-template tree for what no rule judges. DataFrame operations only.

Rules. A rule such as ``example.org/es/`` fits its host and all its subdomains if the path starts with the rule's; the
longest rule wins. The pages that rules judge are the labelled pages of the method.

Template tree. The path's segments, all of them, are generalised
per host in three ways. (1) A segment that is variable by form (number, hexadecimal, mixed letters and
digits) becomes a wildcard of its form. (2) Below one parent, more than ``FANOUT`` different segments with few
pages each become a wildcard. (3) Sibling branches are merged into one wildcard unless their labels differ: a branch stays by itself if the two-proportion
z statistic of its blocked share against that of its siblings is above ``Z``. Levels are treated one after another from the
root, on pages already aggregated by host and form; each level's small table is kept in the shared folder. A form that is alone below its
template has no branches left to merge and is settled with all its further segments, so the levels end with the deepest branching.

Verdict. The blocked share of a template's labelled pages is smoothed to that of its host, the host's to that of its
registered domain, and that to the share of all labelled pages, each with weight ``WEIGHT``. A share of
``REJECT`` or more rejects the template: its pages without a rule are blocked, others are allowed.

Defined results. A null url or one without ``://`` has an empty host and path; it forms a template of its own. Without labelled pages the share of
all is 0 and everything is allowed. Repeated rows give repeated rows. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .store import Store, sized

# The rules of the query, as (rule, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
FANOUT, FEW = 16, 4
Z, WEIGHT, REJECT = 1.96, 2.0, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the end."""
    text = F.coalesce(url, F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, parts, 1), _UPPER, _LOWER), F.regexp_extract(text, parts, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first, so it comes last here
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments as an array, variable ones as their forms."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    form = lambda s: (
        F.when(s.rlike(r"^[0-9]+(\.[a-z]{2,5})?$"), F.regexp_replace(s, "^[0-9]+", "<num>"))
        .when(s.rlike(r"^[0-9a-f-]{8,}$") & s.rlike("[0-9]"), "<hex>")
        .when(s.rlike("[0-9]"), "<mix>")
        .otherwise(s)
    )
    return F.transform(parts, form)


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def template_tree(pages: DataFrame) -> DataFrame:
    """(host, shape, template, purity): the template of every form of path of a host, from pages with host, shape, label.

    label: 1 blocked, 0 allowed, null unlabelled.
    """
    stats = [F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad")]
    tree = pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("lab"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    store = Store(pages.sparkSession, "urls")
    active, settled, level = store.keep(tree.withColumn("template", F.lit(""))), [], 0
    while True:
        named = active.withColumn("seg", F.coalesce(F.get("shape", F.lit(level)), F.lit("")))
        nodes = named.groupBy("host", "template", "seg").agg(*stats)
        parents = nodes.groupBy("host", "template").agg(F.sum("n").alias("pn"), F.sum("lab").alias("pl"), F.sum("bad").alias("pb"), F.sum((F.col("seg") != "").cast("int")).alias("children"))
        nodes = nodes.join(parents, ["host", "template"])
        rest_l, rest_b = F.col("pl") - F.col("lab"), F.col("pb") - F.col("bad")
        # blocked shares with one pseudo-page of either kind, so that no share is 0 or 1
        p1, p2 = (F.col("bad") + 1) / (F.col("lab") + 2), (rest_b + 1) / (rest_l + 2)
        spread = F.sqrt(p1 * (1 - p1) / (F.col("lab") + 2) + p2 * (1 - p2) / (rest_l + 2))
        differs = (F.col("lab") > 0) & (rest_l > 0) & (F.abs(p1 - p2) > Z * spread)
        crowd = (F.col("children") > FANOUT) & (F.col("n") <= FEW)
        merged = F.when(F.col("seg") == "", "").when(crowd, "<any>").when(differs | (F.col("children") <= 1) | F.startswith("seg", F.lit("<")), F.col("seg")).otherwise("<any>")
        step = nodes.select("host", "template", "seg", F.when(merged == "", F.col("template")).otherwise(F.concat("template", F.lit("/"), merged)).alias("next"))
        moved = named.join(step, ["host", "template", "seg"]).select("host", "shape", "n", "lab", "bad", (F.col("seg") == "").alias("ended"), F.col("next").alias("template"))
        forms = moved.where(~F.col("ended")).groupBy("host", "template").agg(F.count("*").alias("forms"))
        level += 1
        rest = F.array_join(F.slice("shape", F.lit(level + 1), F.greatest(F.size("shape") - level, F.lit(0))), "/")
        whole = F.when(F.col("ended") | (F.size("shape") <= level), F.col("template")).otherwise(F.concat("template", F.lit("/"), rest))
        moved = store.keep(moved.join(forms, ["host", "template"], "left").withColumn("alone", F.col("ended") | (F.col("forms") == 1)).withColumn("whole", whole))
        settled.append(moved.where("alone").select("host", "shape", "n", "lab", "bad", F.col("whole").alias("template")))
        active = moved.where("not alone").select("host", "shape", "n", "lab", "bad", "template")
        if active.isEmpty():
            break
    tree = store.last(reduce(DataFrame.unionByName, settled))
    share = lambda up, bad, lab: (bad + WEIGHT * up) / (lab + WEIGHT)
    domain = domain_of(F.col("host"))
    templates = tree.groupBy("host", "template").agg(*stats)
    hosts = templates.groupBy("host").agg(F.sum("lab").alias("hl"), F.sum("bad").alias("hb")).withColumn("domain", domain)
    domains = hosts.groupBy("domain").agg(F.sum("hl").alias("dl"), F.sum("hb").alias("db"))
    every = domains.groupBy().agg(F.coalesce(F.sum("db") / F.nullif(F.sum("dl"), F.lit(0)), F.lit(0.0)).alias("all"))
    # one row: the only side that may be paired with everything
    domains = domains.join(F.broadcast(every)).select("domain", share(F.col("all"), F.col("db"), F.col("dl")).alias("dp"))
    hosts = hosts.join(domains, "domain").select("host", share(F.col("dp"), F.col("hb"), F.col("hl")).alias("hp"))
    templates = templates.join(hosts, "host").select("host", "template", share(F.col("hp"), F.col("bad"), F.col("lab")).alias("purity"))
    return tree.select("host", "shape", "template").join(templates, ["host", "template"])


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, template and purity (smoothed blocked share)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), segments(F.col("path")).alias("shape"))
    label = F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0)
    tree = template_tree(rows.select("host", "shape", label.alias("label")))
    judged = rows.join(sized(Store(pages.sparkSession, "templates").keep(tree.withColumnsRenamed({"template": "t", "purity": "p"}))), ["host", "shape"])
    verdict = F.coalesce("said", F.when(F.col("p") >= REJECT, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("t").alias("template"), F.col("p").alias("purity"))
