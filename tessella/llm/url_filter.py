"""URL filters by a path-template tree (operator 2), in DataFrame functions only.

Segments of a path that vary become wildcards: those with digits or of great
length at once, others where a node has too many different children. That goes
level by level from each host's root, children being counted below the already
generalised parent. Where a node has several children with evidence, these are
merged pairwise, the most alike by their pooled shares of blocked pages first,
as long as neither the groups nor their outermost branches differ significantly.

A template is rejected by its smoothed share of blocked pages: each node of the
way to it, from the last label of the host's name over its parent domains and
the host to each segment of the template, smooths the next. So a host without
labelled pages is judged by its parent domain, and a template without any by
its branch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ascii_lower, persist

def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; null or no ://: empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. rules: (verdict, host + path)."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest is asked first
        name, _, start = rule.partition("/")
        own = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        fits = F.when(own, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def general_segments(path: Column) -> Column:
    """The path's segments; those with a digit or over 40 characters are *."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > 40), "*").otherwise(s))


def _unlike(bad: Column, n: Column, other_bad: Column, other_n: Column) -> Column:
    """By how many standard errors two shares differ."""
    pooled = (bad + other_bad) / (n + other_n)
    gap = F.abs(bad / n - other_bad / other_n)
    return F.when(gap == 0, 0.0).otherwise(gap / F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / other_n)))


def merged_groups(branches: Column, z: float, most: int) -> Column:
    """Groups of branches (array of at most `most` structs share, segment, bad, labelled, sorted): array of struct(bad, labelled, low_bad, low_n, high_bad, high_n, members).

    The two neighbouring groups that are most alike merge, again and again, as
    long as their pooled shares differ by at most z standard errors, and so do
    the least branch of the one and the greatest of the other: differences of
    neighbours cannot add up.
    """
    field = lambda x, *names: [x[n] for n in names]
    group = lambda bad, n, low_bad, low_n, high_bad, high_n, members: F.struct(bad.alias("bad"), n.alias("labelled"), low_bad.alias("low_bad"), low_n.alias("low_n"), high_bad.alias("high_bad"), high_n.alias("high_n"), members.alias("members"))
    single = F.transform(branches, lambda b: group(*field(b, "bad", "labelled"), *field(b, "bad", "labelled") * 2, F.array(b["segment"])))

    def joined(groups: Column, i: Column) -> Column:
        one, two = F.get(groups, i - 1), F.get(groups, i)
        both = group(one["bad"] + two["bad"], one["labelled"] + two["labelled"], *field(one, "low_bad", "low_n"), *field(two, "high_bad", "high_n"), F.concat(one["members"], two["members"]))
        return F.concat(F.slice(groups, F.lit(1), i - 1), F.array(both), F.slice(groups, i + 2, F.size(groups)))

    def once(groups: Column, _: Column) -> Column:
        def pair(i: Column) -> Column:
            one, two = F.get(groups, i - 1), F.get(groups, i)
            ends = _unlike(*field(one, "low_bad", "low_n"), *field(two, "high_bad", "high_n"))
            means = _unlike(*field(one, "bad", "labelled"), *field(two, "bad", "labelled"))
            return F.when((means <= z) & (ends <= z), F.struct(means.alias("apart"), i.alias("i")))

        pairs = F.when(F.size(groups) > 1, F.transform(F.sequence(F.lit(1), F.size(groups) - 1), pair))
        best = F.array_min(F.filter(pairs, lambda p: p.isNotNull()))
        return F.when(best.isNull(), groups).otherwise(joined(groups, best["i"]))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), single, once)


def merged_branches(branches: DataFrame, z: float, support: int, most: int) -> DataFrame:
    """host, head, segment, general: names of the branches of each node after merging (see merged_groups). branches: host, head, segment, bad, labelled.

    Those under support labelled pages are * together. A node has at most
    `most` branches.
    """
    node = ["host", "head"]
    known = branches.where(F.col("labelled") >= support)
    listed = known.groupBy(*node).agg(F.array_sort(F.collect_list(F.struct((F.col("bad") / F.col("labelled")).alias("share"), "segment", "bad", "labelled"))).alias("branches"))
    grouped = listed.select(*node, F.explode(F.transform(merged_groups(F.col("branches"), z, most), lambda g: F.array_sort(g["members"]))).alias("members"))
    name = F.when(F.size("members") == 1, F.col("members")[0]).otherwise(F.concat(F.lit("{"), F.array_join("members", "|"), F.lit("}")))
    few = branches.where(F.col("labelled") < support).select(*node, "segment", F.lit("*").alias("general"))
    return grouped.select(*node, F.explode("members").alias("segment"), name.alias("general")).unionByName(few)


def path_templates(shapes: DataFrame, fanout: int = 20, z: float = 1.96, support: int = 5) -> DataFrame:
    """host, shape, bad, labelled, template for every row of shapes (host, shape, bad, labelled; shape: segments joined by /).

    A segment becomes * where its node has over fanout different children; the
    children of others are merged if two at least have support labelled pages.
    A node is only looked at if one of both is possible, so the loop ends where
    paths thin out, and not at a depth. Segments that all paths of a node begin
    with are passed over at once: very deep paths cost a round for each place
    where they part, not for each segment.
    """
    node = ["host", "head"]
    rest = F.filter(F.split("shape", "/"), lambda s: s != "")
    rows = shapes.select("host", "shape", "bad", "labelled", F.lit("").alias("head"), rest.alias("rest"))
    common = F.aggregate(F.sequence(F.lit(0), F.least(F.size("low"), F.size("high")) - 1), F.lit(0), lambda n, i: F.when((n == i) & (F.get("low", i) == F.get("high", i)), n + 1).otherwise(n))
    out = []
    while True:
        nodes = rows.where(F.size("rest") > 0).groupBy(*node).agg(F.count(F.lit(1)).alias("shapes"), F.sum("labelled").alias("known"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        nodes = persist(nodes.where((F.col("shapes") > fanout) | (F.col("known") >= 2 * support)).select(*node, common.alias("common")), narrow=True)
        if nodes.isEmpty():
            break
        looked = rows.join(nodes, node, "left")
        moves = F.col("common").isNotNull() & (F.size("rest") > 0)
        out.append(looked.where(~moves).select(rows.columns))
        begun = F.concat("head", F.when(F.col("common") > 0, F.concat(F.lit("/"), F.array_join(F.slice("rest", F.lit(1), F.col("common")), "/"))).otherwise(""))
        ahead = looked.where(moves).select("host", "shape", "bad", "labelled", begun.alias("head"), F.slice("rest", F.col("common") + 1, F.size("rest")).alias("rest"))
        out.append(ahead.where(F.size("rest") == 0))
        moving = ahead.where(F.size("rest") > 0).withColumn("segment", F.col("rest")[0])
        branches = persist(moving.groupBy(*node, "segment").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")))
        widths = branches.groupBy(*node).agg(F.count(F.lit(1)).alias("children"), F.sum((F.col("labelled") >= support).cast("int")).alias("supported"))
        widths = persist(widths.where((F.col("children") > fanout) | (F.col("supported") >= 2)), narrow=True)
        names = merged_branches(branches.join(widths.where(F.col("children") <= fanout).select(*node), node), z, support, fanout)
        wide = widths.where(F.col("children") > fanout).select(*node, F.lit(True).alias("wide"))
        general = F.when(F.col("wide"), "*").otherwise(F.coalesce("general", "segment"))
        moved = moving.join(wide, node, "left").join(names, [*node, "segment"], "left")
        left = F.expr("slice(rest, 2, size(rest))")
        rows = persist(moved.select("host", "shape", "bad", "labelled", F.concat("head", F.lit("/"), general).alias("head"), left.alias("rest")))
    out.append(rows)
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    whole = F.concat("head", F.when(F.size("rest") > 0, F.concat(F.lit("/"), F.array_join("rest", "/"))).otherwise(""))
    return every.select("host", "shape", "bad", "labelled", F.substring(whole, F.lit(2), F.length(whole)).alias("template"))


def tree_nodes(host: Column, template: Column) -> Column:
    """The nodes on the way to a template: the host's parent domains, shortest first, the host, then host and each beginning of the template."""
    labels, parts = F.split(host, "[.]"), F.filter(F.split(template, "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    paths = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.concat(domains, F.slice(paths, F.lit(2), F.size(parts)))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], page_id: str = "page_id", url: str = "url", fanout: int = 20, z: float = 1.96, support: int = 5, smooth: float = 5.0, reject: float = 0.75) -> DataFrame:
    """page_id, host, path, rule, template, purity, verdict for every row of pages.

    The urls that a rule fits are the labelled ones. Others are blocked if
    their template's smoothed share of blocked urls is at least reject; smooth
    is the weight of the level above, in urls. See path_templates for fanout, z
    and support.

    A null url, or one without ://, has an empty host and path and is judged as
    these. Rows that repeat count each. Empty table: no rows. Paths may be of
    any depth (see path_templates). Only the two named columns are read.
    """
    urls = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"))
    urls = urls.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = urls.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", F.array_join(general_segments(F.col("path")), "/"))
    blocked = (F.col("fits.verdict") == "block").cast("int")
    shapes = persist(urls.groupBy("host", "shape").agg(F.sum(blocked).alias("bad"), F.count(blocked).alias("labelled")).fillna(0))

    corpus = shapes.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled")).first()
    corpus_share = (corpus["bad"] + smooth * 0.5) / (corpus["labelled"] + smooth)
    templates = persist(path_templates(shapes, fanout, z, support))
    nodes = tree_nodes(F.col("host"), F.col("template"))
    evidence = templates.where("labelled > 0").select("bad", "labelled", F.explode(nodes).alias("node")).groupBy("node").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    way = templates.select("host", "template").distinct().select("host", "template", F.posexplode(nodes).alias("level", "node"))
    met = way.join(persist(evidence, narrow=True), "node", "left").groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("level", "bad", "labelled"))).alias("way"))
    step = lambda share, x: (F.coalesce(x["bad"], F.lit(0)) + smooth * share) / (F.coalesce(x["labelled"], F.lit(0)) + smooth)
    judged = met.select("host", "template", F.aggregate("way", F.lit(corpus_share), step).alias("purity"))
    shaped = persist(templates.select("host", "shape", "template").join(judged, ["host", "template"]))

    own = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return urls.join(shaped, ["host", "shape"]).select("page_id", "host", "path", F.col("fits.rule").alias("rule"), "template", "purity", F.coalesce(F.col("fits.verdict"), own).alias("verdict"))
