"""URL filters: rules on host and path, and for the other pages a path-template tree for each host.

Rules (host, path) fit a host and all its subdomains if the url's path starts with the rule's
path; the longest rule wins. Pages that a rule judges are the labels of the tree.

The tree of a host has one node for each sequence of path segments:

1. *Variable segments become wildcards.* A segment with a digit is a wildcard with its ending kept
   (``*.html``). At a node whose other children are many and mostly seen once they are wildcards, too.
2. *Similar branches merge.* Two children of a node are one branch if the shares of the shapes below them differ by
   at most ``MERGE_DISTANCE`` (half the sum of absolute differences) or by what their counts leave to chance, and if their labels do not
   contradict each other: a branch that is mostly blocked never merges with one that is mostly allowed. A branch
   without labels joins one with labels if it is similar below; where nothing lies below there is nothing to
   compare, and it stays. It joins an allowed branch rather than a blocked one. Leaders are taken in rounds until no branches are left to compare.
3. *Templates are judged by smoothed labelled purity.* A template is rejected if the blocked share of its
   labelled pages, smoothed towards the share of all labelled pages, reaches ``LEAST_PURITY``. Its
   pages without a rule are then blocked; all other pages are allowed.

Segments deeper than ``LEVELS`` are one segment of the tree's last level, spelled by their shape, so no
path is cut off. Every level is two partial counts and a join, and a few small passes
for each round of leaders; hot hosts are keys of partial counts only.

Defined cases: a missing url, or one without ``://``, has an empty host and path and is allowed
unless a rule says otherwise (none can). An empty path is a template of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.llm.base import fresh, stored

# Verdict, host, path of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LEVELS = 4
#: A node's children are variable if there are at least so many kinds, and so few pages a kind.
VARIABLE_KINDS = 20
VARIABLE_PAGES = 2.0
MERGE_DISTANCE = 0.15
SMOOTHING = 2.0
LEAST_PURITY = 0.9


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(raw, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (``host + path``) and its verdict; missing if none fits."""
    text = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def shape(segment: Column) -> Column:
    """A segment with a digit becomes a wildcard; letters behind the last dot stay."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]+)$", 1)
    return F.when(segment.rlike("[0-9]"), F.concat(F.lit("*"), ending)).otherwise(segment)


def _levels(path: Column, levels: int) -> list[Column]:
    """One column a level; missing where the path ends before. The last holds all that is left."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    shaped = F.transform(parts, shape)
    there = lambda k: F.size(parts) > k
    out = [F.when(there(k) & (path != ""), F.get(shaped, F.lit(k))) for k in range(levels - 1)]
    rest = F.array_join(F.slice(shaped, levels, F.greatest(F.size(parts), F.lit(1))), "/")
    return [*out, F.when(there(levels - 1) & (path != ""), rest)]


def _names(levels: int) -> list[str]:
    return [f"s{k}" for k in range(levels)]


def templates(shapes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Counts of shapes (host, s0.., pages, blocked, allowed) -> each with its template t0.. ."""
    names = _names(levels)
    rows = shapes
    for k, name in enumerate(names):
        above = ["host", *(f"t{j}" for j in range(k))]
        below = F.concat_ws("/", *names[k + 1 :])
        wild = F.coalesce(F.col(name).contains("*"), F.lit(False))
        # many kinds of children, hardly any seen twice: an identifier without digits
        plain = rows.where(F.col(name).isNotNull() & ~wild).groupBy(*above, name).agg(F.sum("pages").alias("pages"))
        many = plain.groupBy(*above).agg(F.count(F.lit(1)).alias("kinds"), F.sum("pages").alias("total"))
        many = many.where((F.col("kinds") >= VARIABLE_KINDS) & (F.col("total") <= VARIABLE_PAGES * F.col("kinds"))).select(*[F.col(c).alias(f"m_{c}") for c in above])
        at = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in above]
        general = rows.join(many, reduce(Column.__and__, at), "left").withColumn(
            "branch", F.when(F.col(name).isNotNull() & (wild | F.col("m_host").isNull()), F.col(name)).when(F.col(name).isNotNull(), F.lit("*"))
        ).drop(*[f"m_{c}" for c in above])
        general = stored(general.withColumn("below", below), "templates")
        merged = _leaders(general, above)
        same = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in [*above, "branch"]]
        rows = general.join(merged, reduce(Column.__and__, same), "left").withColumn(f"t{k}", F.coalesce("leader", "branch"))
        rows = rows.drop("branch", "below", "leader", *[f"l_{c}" for c in [*above, "branch"]])
        rows = stored(rows, "templates")
    return rows


def _leaders(rows: DataFrame, above: list[str]) -> DataFrame:
    """For branches that merge: the node (l_...), the branch (l_branch) and the one it joins.

    Only branches whose most frequent shape below is the same are compared. In a round every such group has one
    leader (allowed before blocked before unlabelled, then the most frequent); the similar ones join it and the others go on to the
    next round, so a branch is compared with as many leaders as its group has kinds.
    """
    node = [*above, "branch"]
    counts = rows.where(F.col("branch").isNotNull()).groupBy(*node, "below").agg(*[F.sum(c).alias(c) for c in ("pages", "blocked", "allowed")])
    counts = stored(counts, "branches")
    kinds = counts.groupBy(*node).agg(
        *[F.sum(c).alias(c) for c in ("pages", "blocked", "allowed")],
        F.max(F.struct("pages", "below"))["below"].alias("main"),
    )
    labelled = F.col("blocked") + F.col("allowed")
    side = F.when(labelled == 0, 0).when(2 * F.col("blocked") >= labelled, 1).otherwise(2)  # the order of leaders
    left = kinds.select(*node, "main", "pages", side.alias("side"))
    group = [*above, "main"]
    none = left.select(*[F.col(c).alias(f"l_{c}") for c in node], F.col("branch").alias("leader")).limit(0)
    joined = [none]
    while True:
        heads = left.groupBy(*group).agg(F.max(F.struct("side", "pages", "branch")).alias("head"), F.count(F.lit(1)).alias("members"))
        heads = heads.where(F.col("members") > 1).select(*[F.col(c).alias(f"h_{c}") for c in group], "head")
        at = [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in group]
        left = stored(left.join(heads, reduce(Column.__and__, at)).where(F.col("branch") != F.col("head.branch")).select(*left.columns, "head"), "branches")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, joined)
        # two unlabelled or two of one side; an unlabelled one and a labelled one only by what lies below
        mixed = (F.col("side") == 0) & (F.col("main") != "")
        near = stored(_near(left.where((F.col("side") == F.col("head.side")) | mixed), counts, above), "branches")
        joined.append(near)
        gone = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in node]
        left = left.join(near, reduce(Column.__and__, gone), "left_anti").drop("head")


def _near(compared: DataFrame, counts: DataFrame, above: list[str]) -> DataFrame:
    """Of the branches with a head those that are similar to it: the node (l_...), the branch and its leader."""
    node = [*above, "branch"]
    compared = compared.select(
        *[F.col(c).alias(f"l_{c}") for c in node], F.col("head.branch").alias("leader"), F.col("pages").alias("own"), F.col("head.pages").alias("head_pages")
    )
    # distance of the two distributions of shapes: 1 - sum of the smaller shares
    mine = counts.join(compared, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in node])).select(
        *[F.col(f"l_{c}") for c in node], "leader", "own", "head_pages", "below", "pages"
    )
    other = counts.select(*[F.col(c).alias(f"o_{c}") for c in node], F.col("below").alias("o_below"), F.col("pages").alias("o_pages"))
    match = [F.col(f"l_{c}").eqNullSafe(F.col(f"o_{c}")) for c in above] + [F.col("leader") == F.col("o_branch"), F.col("below") == F.col("o_below")]
    common = mine.join(other, reduce(Column.__and__, match), "left").withColumn(
        "least", F.least(F.col("pages") / F.col("own"), F.coalesce("o_pages", F.lit(0)) / F.col("head_pages"))
    )
    keys = [f"l_{c}" for c in node]
    near = common.groupBy(*keys, "leader", "own").agg((1 - F.sum("least")).alias("distance"), F.count(F.lit(1)).alias("shapes"))
    chance = F.sqrt(F.col("shapes") / F.col("own")) / 2
    return near.where(F.col("distance") <= F.greatest(F.lit(MERGE_DISTANCE), chance)).select(*keys, "leader")


def judge(pages: DataFrame, url: str = "url", rules=RULES, levels: int = LEVELS) -> tuple[DataFrame, dict[str, str]]:
    """All rows with ``host``, ``path``, ``rule``, ``template``, ``purity`` and ``verdict``; and their names."""
    names: dict[str, str] = {}
    for n in ("host", "path", "rule", "template", "purity", "verdict"):
        names[n] = fresh(n, [*pages.columns, *names.values()])
    level_names = _names(levels)
    parsed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("row", "host", "path", rule.alias("rule"), by_rule.alias("by_rule"), *[c.alias(n) for c, n in zip(_levels(F.col("path"), levels), level_names, strict=True)])
    shapes = parsed.groupBy("host", *level_names).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("by_rule") == "block").alias("blocked"), F.count_if(F.col("by_rule") == "allow").alias("allowed")
    )
    tree = templates(stored(shapes, "shapes"), levels)
    tops = [f"t{k}" for k in range(levels)]
    every = tree.agg(F.sum("blocked").alias("b"), (F.sum("blocked") + F.sum("allowed")).alias("n")).select(F.coalesce(F.col("b") / F.nullif("n", F.lit(0)), F.lit(0.5)).alias("prior"))
    judged = tree.groupBy("host", *tops).agg(F.sum("blocked").alias("b"), (F.sum("blocked") + F.sum("allowed")).alias("n"), F.sum("pages").alias("pages"))
    prior = every.first().prior  # one number
    judged = judged.select(*[F.col(c).alias(f"j_{c}") for c in ["host", *tops]], ((F.col("b") + SMOOTHING * prior) / (F.col("n") + SMOOTHING)).alias("purity"), F.col("n").alias("labelled"))
    same = [F.col(c).eqNullSafe(F.col(f"j_{c}")) for c in ["host", *tops]]
    known = tree.join(judged, reduce(Column.__and__, same)).select(
        *[F.col(c).alias(f"k_{c}") for c in ["host", *level_names]], F.concat(F.lit("/"), F.concat_ws("/", *tops)).alias("template"), "purity", "labelled"
    )
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in ["host", *level_names]]
    out = parsed.join(known, reduce(Column.__and__, same), "left")
    rejected = (F.col("labelled") > 0) & (F.col("purity") >= LEAST_PURITY)
    verdict = F.coalesce(F.col("by_rule"), F.when(rejected, "block").otherwise("allow"))
    return out.select("row.*", *[F.col(c).alias(names[c]) for c in ("host", "path", "rule", "template", "purity")], verdict.alias(names["verdict"])), names
