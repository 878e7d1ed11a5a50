"""URL filters (operator 8): host/path rules, and gradient-boosted trees on
lexical features for the URLs that no rule fits.

Everything on the main path is DataFrame operations. The labelled URLs are
those that a rule decides; at most ``most`` of them (hash order) are written
with their features as bin numbers. Each level of each tree is one grouped sum
of gradients over that sample: the driver reads (nodes x features x bins)
numbers and writes the tree as a SQL expression, so scoring all pages is one
narrow projection.

Suffix statistics are the lengths of the host's last label and of the path's
file ending, and the ending's share of all URLs (one grouped count with map-side
combining over the whole table, written; on a logarithmic scale). No block rate
of a suffix is an input: a label is a function of host and path, so such a rate,
also one counted over other domains only, tells the trees which rule a URL came
under, and URLs without a rule would be judged by their domain alone. For the
same reason no statistic names the host. The shares may have as many rows as
there are endings, so they are broadcast only after their size was checked, else
the join shuffles.

A rule ``host/path`` fits its host and all subdomains if the URL's path starts
with the rule's; the longest rule that fits wins (of equal length: the first
in alphabetical order).

Defined cases: a null URL, or one without ``://``, has an empty host and path
and is judged by the trees on its text (null: empty); rows are judged one by
one, so repeated rows, null ids and ties keep their rows; an empty table gives
an empty result; if no rule decides any URL, or all decide alike, the trees
give that one verdict (allow if none). Other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipledger.llm.common import written
from shipledger.session import bounded_broadcast

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/")]
SAMPLE, TREES, DEPTH, BINS, RATE, L2 = 20_000, 8, 3, 16, 0.5, 1.0
FEATURES = ["length", "host_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters",
            "query_length", "secure", "tld_length", "ending_length", "ending_share"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, url (null: empty), host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"),
        F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and ruling (its verdict), null where no rule fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in reversed(ordered):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        ruling = F.when(fits, F.lit(verdict)).otherwise(ruling)
    return pages.withColumns({"rule": rule, "ruling": ruling})


def _entropy(text: Column) -> Column:
    """Bits per character of the text's characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - (
        (n - F.size(F.array_remove(chars, c))) / n) * F.log2((n - F.size(F.array_remove(chars, c))) / n))


def _suffixes(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"tld": F.element_at(F.split("host", r"\."), -1),
                              "ending": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)})


def _lexical(pages: DataFrame) -> DataFrame:
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    n = F.length(url).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda text, what: (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("double")
    return _suffixes(pages).withColumns({
        "length": n, "host_length": F.length(host).cast("double"), "depth": count(path, "/"),
        "labels": count(host, "."),
        "digit_ratio": (n - F.length(F.translate(url, "0123456789", ""))) / F.greatest(n, F.lit(1.0)),
        "hyphens": count(url, "-"), "entropy": _entropy(url), "parameters": count(query, "="),
        "tld_length": F.length("tld").cast("double"), "ending_length": F.length("ending").cast("double"),
        "query_length": F.length(query).cast("double"), "secure": url.startswith("https:").cast("double")})


def _endings(pages: DataFrame) -> DataFrame:
    """ending and n of all URLs."""
    return _suffixes(pages).groupBy("ending").agg(F.count("*").alias("n"))


def _with_shares(pages: DataFrame, endings: DataFrame | None, total: int) -> DataFrame:
    if endings is None:
        return pages.withColumn("ending_share", F.lit(0.0))
    pages = pages.join(bounded_broadcast(endings), "ending", "left")
    return pages.withColumn("ending_share", F.log2((F.coalesce("n", F.lit(0)) + 1.0) / (total + 1.0)))


def _tree(tree: dict, value, i: int = 0) -> Column:
    """The tree as nested CASE; ``value(feature, cut)`` tests 'goes right'."""
    if i not in tree["split"]:
        return F.lit(tree["leaf"][i])
    return F.when(value(*tree["split"][i]), _tree(tree, value, 2 * i + 2)).otherwise(_tree(tree, value, 2 * i + 1))


def _node(tree: dict, value, i: int = 0) -> Column:
    if i not in tree["split"]:
        return F.lit(i)
    return F.when(value(*tree["split"][i]), _node(tree, value, 2 * i + 2)).otherwise(_node(tree, value, 2 * i + 1))


class UrlModel:
    def __init__(self, endings, total, edges, trees, bias):
        self.endings, self.total, self.edges, self.trees, self.bias = endings, total, edges, trees, bias

    def margin(self) -> Column:
        value = lambda j, cut: F.col(FEATURES[j]) > F.lit(self.edges[j][cut])
        return reduce(lambda a, t: a + _tree(t, value), self.trees, F.lit(self.bias))


def fit(pages: DataFrame, rules=RULES, most: int = SAMPLE, trees: int = TREES) -> UrlModel:
    """Shares of endings over all URLs, boosted trees on at most ``most`` of
    those that a rule decides."""
    ruled = with_rule(split_url(pages), rules)
    decided = ruled.where("rule is not null").withColumn("y", (F.col("ruling") == "block").cast("double"))
    n, blocked = decided.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if blocked in (0, n):
        return UrlModel(None, 0, [[] for _ in FEATURES], [], 6.0 if blocked else -6.0)
    prior = blocked / n
    endings = written(_endings(ruled), "url-endings")
    total = endings.agg(F.sum("n")).first()[0]
    sample = written(_lexical(decided.orderBy(F.xxhash64("url"), "url", "page_id").limit(most)), "url-sample")
    full = _with_shares(sample, endings, total)
    cuts = F.lit([k / BINS for k in range(1, BINS)])
    edges = [sorted(set(q)) for q in full.agg(*[F.percentile_approx(f, cuts, 1000) for f in FEATURES]).first()]
    binned = F.array(*[reduce(lambda a, e, f=f: a + (F.col(f) > F.lit(e)).cast("int"), es, F.lit(0))
                       for f, es in zip(FEATURES, edges, strict=True)])
    rows = written(full.select("y", binned.alias("b")), "url-bins")
    value = lambda j, cut: F.col("b")[j] > cut
    bias, grown = math.log(prior / (1 - prior)), []
    for _ in range(trees):
        margin = reduce(lambda a, t: a + _tree(t, value), grown, F.lit(bias))
        p = 1 / (1 + F.exp(-margin))
        tree = {"split": {}, "leaf": {0: 0.0}}
        for level in range(DEPTH):
            at = rows.select(_node(tree, value).alias("node"), (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"),
                             F.posexplode("b").alias("f", "bin"))
            sums = (at.where(F.col("node") >= 2**level - 1).groupBy("node", "f", "bin")
                    .agg(F.round(F.sum("g"), 9).alias("g"), F.round(F.sum("h"), 9).alias("h")).collect())
            _grow(tree, sums)
        for i in tree["leaf"]:
            tree["leaf"][i] *= RATE
        grown.append(tree)
    return UrlModel(endings, total, edges, grown, bias)


def _grow(tree: dict, sums: list) -> None:
    """Split each node of the last level where that lowers the loss most."""
    by: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
    for r in sums:
        by.setdefault(r["node"], {}).setdefault(r["f"], {})[r["bin"]] = (r["g"], r["h"])
    for node, features in sorted(by.items()):
        best = (1e-6, None)
        for f, bins in sorted(features.items()):
            g, h = (sum(x[k] for x in bins.values()) for k in (0, 1))
            gl = hl = 0.0
            for cut in sorted(bins)[:-1]:
                gl, hl = gl + bins[cut][0], hl + bins[cut][1]
                gr, hr = g - gl, h - hl
                gain = gl**2 / (hl + L2) + gr**2 / (hr + L2) - g**2 / (h + L2)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, cut, -gl / (hl + L2), -gr / (hr + L2)))
        if best[1]:
            f, cut, left, right = best[1]
            tree["split"][node] = (f, cut)
            tree["leaf"].pop(node, None)
            tree["leaf"][2 * node + 1], tree["leaf"][2 * node + 2] = left, right


def judge(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of block by the trees)."""
    rows = _lexical(with_rule(split_url(pages), rules))
    rows = _with_shares(rows, model.endings, model.total).withColumn("_margin", model.margin())
    return rows.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruling", F.when(F.col("_margin") > 0, "block").otherwise("allow")).alias("verdict"),
        (1 / (1 + F.exp(-F.col("_margin")))).alias("score"))
