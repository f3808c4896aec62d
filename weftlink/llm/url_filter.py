"""URL verdicts: rules first, then a tree of path templates per host."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TAIL = "**"
HEX_ID = r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"
STEPS = {"a": "{+}", "b": "{-}", "s": "*"}  # siblings merged above, below and like the rest of their parent


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# Rules by host and path, and words of a URL that label it as unwanted.
RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]
BAD_WORDS = ["adult", "ads", "bets", "casino", "pills", "porn", "spam", "xxx"]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.text) if name is None else name.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (name, verdict) if rules else (F.lit(None).cast("string"),) * 2


def shapes(path: Column) -> Column:
    """All segments of a path, with digit runs and hexadecimal ids generalised.

    A segment that begins with a number makes two steps, the number's leading digit (as 7~) and the generalised segment,
    so that ranges of numbers are branches that labels can tell apart; where they can't, the digits merge into a wildcard.
    """
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    whole = lambda s: F.when(s.rlike(r"^[0-9]+$"), "{n}").when(s.rlike(HEX_ID), "{id}").otherwise(F.regexp_replace(s, r"[0-9]+", "{n}"))
    number = lambda s: s.rlike(r"^[0-9]+$") | (s.rlike("^[0-9]") & ~s.rlike(HEX_ID))
    return F.flatten(F.transform(segments, lambda s: F.when(number(s), F.array(F.concat(F.substring(s, 1, 1), F.lit("~")), whole(s))).otherwise(F.array(whole(s)))))


def bad_word(column: Column, words: list[str]) -> Column:
    """Whether one of the words stands between the marks and digits of a host or path."""
    return F.arrays_overlap(F.split(F.lower(column), "[^a-z]+"), F.array(*map(F.lit, words))) if words else F.lit(False)


def margin(alpha: float) -> float:
    """What surprise must reach, so that labels dealt at random reach it with a chance of alpha / 2 at most on each side."""
    return math.log(2 / alpha) - 1e-9


def surprise(bad: Column, n: Column, all_bad: Column, all_n: Column) -> Column:
    """-ln of Chernoff's bound on the chance that n labels dealt from all_n, all_bad of them bad, are as unlike as bad of n.

    It holds for any counts (draws without replacement are no more scattered than those with), so there is no least size.
    """
    good, all_good = n - bad, all_n - all_bad
    part = lambda x, of: F.when(x > 0, x * F.log(x * all_n / (n * of))).otherwise(0.0)
    return part(bad, all_bad) + part(good, all_good)


def template_tree(urls: DataFrame, alpha: float, strength: float, prior: float) -> DataFrame:
    """(host, shape, template, purity) from urls (host, shape, bad): bad is 1, 0 or null (no label).

    Rows are summed per host and shape first. From the root on, the children of a node are each tested against their
    siblings: those whose share of bad labels is significantly above the siblings' are merged into one branch, those
    below into another, and all that can't be told from their siblings, like variable segments with few labels each or
    none, into a wildcard. Labels are pooled over a merged branch, and its children by name, before the next level is tested.
    A child differs if chance would part its labels, or its siblings', as far with a probability of at most ``alpha`` / 2,
    shared out over the node's labelled children, so that of many children none stands out by mere chance.
    A branch is a template once no split of it can be significant: not even one that parts all its bad labels from all its
    good ones, or all its paths have ended. So the rounds are as many as the labels can tell levels apart, whatever the depth of the paths.
    A template's purity is its share of bad labels, smoothed by ``strength`` labels of the share in the rest of its host,
    which is itself smoothed by ``prior``; so a template without labels has its host's.
    """
    e = margin(alpha)
    tree = urls.groupBy("host", "shape").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("labelled"))
    open_ = common.settle(tree.select("host", "shape", "bad", "labelled", F.lit("").alias("code"), F.array().cast("array<string>").alias("steps")), "url-tree")
    done, level = None, 0
    while True:
        child = F.coalesce(F.get("shape", F.lit(level)), F.lit(""))
        pool = open_.groupBy("host", "code").agg(F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all"), F.max(F.size("shape")).alias("deep"), F.countDistinct(F.when(F.col("labelled") > 0, child)).alias("kids"))
        bads, all_ = F.col("all_bad").cast("double"), F.col("all").cast("double")
        mixed = (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all"))
        best = F.when(mixed, F.greatest(bads * F.log(all_ / bads), (all_ - bads) * F.log(all_ / (all_ - bads)))).otherwise(0.0)
        goes_on = (best >= e) & (F.col("deep") > level)
        pool = common.settle(pool.withColumn("more", goes_on), "url-nodes")
        judged = open_.join(pool, ["host", "code"])
        ended = F.when(F.col("deep") > level, F.concat("steps", F.array(F.lit(TAIL)))).otherwise(F.col("steps"))
        part = common.settle(judged.where(~F.col("more")).select("host", "shape", "bad", "labelled", "code", ended.alias("template")), "url-templates")
        done = part if done is None else done.unionByName(part)
        if pool.where("more").isEmpty():
            break
        rest = judged.where("more").withColumn("child", child)
        kids = rest.groupBy("host", "code", "child").agg(F.sum("bad").alias("own_bad"), F.sum("labelled").alias("own"), F.first("all_bad").alias("all_bad"), F.first("all").alias("all"), F.first("kids").alias("kids"))
        x, n, bads, all_ = (F.col(c).cast("double") for c in ("own_bad", "own", "all_bad", "all"))
        gap = x * all_ - bads * n
        far = (n > 0) & (all_ > n) & (F.greatest(surprise(x, n, bads, all_), surprise(bads - x, all_ - n, bads, all_)) >= e + F.log("kids"))
        kids = kids.select("host", "code", "child", F.when(far & (gap > 0), "a").when(far, "b").otherwise("s").alias("kind"))
        merged = kids.groupBy("host", "code", "kind").agg(F.count(F.lit(1)).alias("n"), F.first("child").alias("only"))
        name = F.when(F.col("n") == 1, F.col("only"))
        for kind, step in STEPS.items():
            name = name.when(F.col("kind") == kind, step)
        steps = common.settle(kids.join(merged.select("host", "code", "kind", name.alias("step")), ["host", "code", "kind"]), "url-steps")
        open_ = rest.join(steps, ["host", "code", "child"]).select("host", "shape", "bad", "labelled", F.concat("code", "kind").alias("code"), F.concat("steps", F.array("step")).alias("steps"))
        open_ = common.settle(open_, "url-tree")
        level += 1
    hosts = done.groupBy("host").agg(F.sum("bad").alias("host_bad"), F.sum("labelled").alias("host_labelled"))
    templates = done.groupBy("host", "code").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).join(hosts, "host")
    share = (F.col("host_bad") - F.col("bad") + strength * prior) / (F.col("host_labelled") - F.col("labelled") + strength)
    templates = templates.select("host", "code", ((F.col("bad") + strength * share) / (F.col("labelled") + strength)).alias("purity"))
    return done.select("host", "shape", "code", "template").join(common.settle(templates, "url-purity"), ["host", "code"]).select("host", "shape", "template", "purity")


def judge(pages: DataFrame, rules: list[Rule] | None = None, bad_words: list[str] | None = None, labels: Column | None = None, known: DataFrame | None = None, alpha: float = 0.05, strength: float = 2.0, prior: float = 0.2, reject: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of pages (page_id, url).

    The longest fitting rule decides. Else a URL is blocked if the smoothed purity of its template, which is learned from
    all labelled URLs of its host, is at least ``reject``. A URL is labelled bad (1) or good (0) by ``labels``, else by
    the table ``known`` (url, bad; of several rows the greatest), else by a word of ``bad_words`` in its host or path, as
    bad, or by its rule. Null URLs and URLs without :// have an empty host and path. Repeated rows stay; other columns
    are ignored, whatever their names; an empty table gives no rows; paths of any length are read whole. Of templates with
    one share the host's own labels decide alike. Verdicts are joined back by host and shape; AQE splits a hot one.
    """
    rules = RULES if rules is None else rules
    words = BAD_WORDS if bad_words is None else bad_words
    host, path = F.col("host"), F.col("path")
    rule, verdict = rule_columns(host, path, rules)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"))
    label = F.when(bad_word(host, words) | bad_word(path, words), 1).when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    if known is not None:
        told = known.where("url is not null and bad is not null").groupBy("url").agg(F.max(F.col("bad").cast("int")).alias("told"))
        rows = rows.join(told, "url", "left")
        label = F.coalesce("told", label)
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("shape", shapes(path))
    tree = template_tree(rows.select("host", "shape", (label if labels is None else labels).alias("bad")), alpha, strength, prior)
    out = rows.join(common.settle(tree, "url-verdicts"), ["host", "shape"], "left")
    free = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", free).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
