"""Operator 3: URL filter of host rules and gradient-boosted trees, in Column expressions only.

URLs that a rule fits are the labelled ones. Trees are grown from histograms: features are
binned at quantiles of the labelled sample, each level of a tree is one groupBy over
(node, feature, bin) with sums of gradients and hessians, and the best splits (a table of
bounded size: nodes x features x bins) extend the tree. The model is a sum of CASE
expressions, so scoring is a projection of the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.llm import common as C

#: (verdict, rule) pairs: a host, with all its subdomains, and what the path starts with.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Bound of the labelled sample (those of lowest hash of the url).
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 6, 2, 16, 0.5, 1.0
#: Parts of the hosts: a training url's suffix rate is counted on the hosts of the other parts.
FOLDS = 5
FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "suffix_rate")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without "://"."""
    part = [F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2)]
    return F.translate(part[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part[1]


def matching_rule(rules: tuple[tuple[str, str], ...], what: str) -> Column:
    """The longest rule that fits columns host and path (what: "rule") or its verdict ("verdict"); else null."""
    out = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit("/" + path))
        out = F.when(fits, F.lit(rule if what == "rule" else verdict)).otherwise(out)
    return out


def lexical(url: Column) -> dict[str, Column]:
    """Features of the characters of a url; 0 for null and empty ones."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(u, ""))
    share = F.transform(chars, lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return {
        "length": F.length(u).cast("double"),
        "depth": F.length(F.regexp_replace(F.col("path"), r"(?s)[^/]", "")).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(u, r"(?s)[^0-9]", "")) / n,
        "entropy": entropy,
        "parameters": F.when(query == "", 0.0).otherwise(F.length(F.regexp_replace(query, r"(?s)[^&]", "")) + 1.0),
    }


def featured(pages: DataFrame) -> DataFrame:
    """pages with host, path, rule, label (the rule's verdict), suffix and the lexical features, prefixed f_."""
    host, path = host_path(F.col("url"))
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    out = out.withColumns({"rule": matching_rule(RULES, "rule"), "label": matching_rule(RULES, "verdict"), "suffix": F.substring_index("host", ".", -1)})
    return out.withColumns({f"f_{k}": v for k, v in lexical(F.col("url")).items()})


@dataclass
class Model:
    prior: float
    edges: dict[str, list[float]]
    trees: list[dict]

    def margin(self) -> Column:
        total = F.lit(float(self.prior))
        for t in self.trees:
            total = total + _leaf(t)
        return total


def _leaf(t: dict) -> Column:
    if "feature" not in t:
        return F.lit(float(t.get("value", 0.0)))
    return F.when(F.col(f"f_{t['feature']}") <= F.lit(float(t["at"])), _leaf(t["left"])).otherwise(_leaf(t["right"]))


def _node(t: dict, path: str = "r") -> Column:
    """The leaf of a growing tree in which a row lies."""
    if "feature" not in t:
        return F.lit(path)
    return F.when(F.col(f"f_{t['feature']}") <= F.lit(float(t["at"])), _node(t["left"], path + "0")).otherwise(_node(t["right"], path + "1"))


def _below(feature: str):
    return lambda edge: edge < F.col(f"f_{feature}")


def fit(sample: DataFrame) -> Model:
    """Boosted trees from (label_value 0/1, f_*) rows; without both labels only the prior."""
    import math

    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("label_value"), F.lit(0))).first()
    if n == 0:
        return Model(-1.0, {}, [])
    prior = math.log((pos + 0.5) / (n - pos + 0.5))
    if pos in (0, n):
        return Model(prior, {}, [])
    cuts = [i / BINS for i in range(1, BINS)]
    row = sample.agg(*[F.percentile_approx(f"f_{k}", cuts, 10_000).alias(k) for k in FEATURES]).first()
    edges = {k: sorted(set(row[k])) for k in FEATURES}
    model = Model(prior, edges, [])
    bins = {k: F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[k]]), _below(k))) for k in FEATURES}
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), b.alias("bin")) for k, b in bins.items()])).alias("c")
    for _ in range(TREES):
        tree: dict = {}
        p = 1 / (1 + F.exp(-model.margin()))
        for level in range(DEPTH + 1):
            base = sample.select("*", _node(tree).alias("node"), (p - F.col("label_value")).alias("g"), (p * (1 - p)).alias("h"))
            if level == DEPTH:  # leaf values
                for node, g, h in base.groupBy("node").agg(F.sum("g"), F.sum("h")).collect():
                    _at(tree, node)["value"] = -RATE * g / (h + RIDGE)
                break
            found: dict[str, dict[str, dict[int, tuple[float, float]]]] = {}
            for node, k, b, g, h in base.select("node", "g", "h", cells).groupBy("node", "c.feature", "c.bin").agg(F.sum("g"), F.sum("h")).collect():
                found.setdefault(node, {}).setdefault(k, {})[b] = (g, h)
            for node, features in sorted(found.items()):
                best = (1e-6, None, None)
                for k, hist in sorted(features.items()):
                    total_g, total_h = (sum(x[i] for x in hist.values()) for i in (0, 1))
                    g = h = 0.0
                    for b in range(len(edges[k])):
                        g, h = g + hist.get(b, (0.0, 0.0))[0], h + hist.get(b, (0.0, 0.0))[1]
                        gain = g * g / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, k, edges[k][b])
                if best[1]:
                    _at(tree, node).update(feature=best[1], at=best[2], left={}, right={})
        model.trees.append(tree)
    return model


def _at(tree: dict, node: str) -> dict:
    for step in node[1:]:
        tree = tree["left" if step == "0" else "right"]
    return tree


def _fold() -> Column:
    return F.pmod(F.xxhash64("host", F.lit(23)), F.lit(FOLDS))


def _suffix_rates(rows: DataFrame) -> DataFrame:
    """suffix, rate: the smoothed share of blocked urls among labelled rows; and own: (blocked, rows) of each
    part of the hosts, to be taken off for urls of that part."""
    blocked = F.sum((F.col("label") == "block").cast("long"))
    parts = rows.where("label is not null").groupBy("suffix", _fold().alias("fold")).agg(blocked.alias("b"), F.count("*").alias("n"))
    return parts.groupBy("suffix").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("b", "n")))).alias("own"))


def _sample(spark: SparkSession, rows: DataFrame, rates: DataFrame, sample_rows: int, root: str, name: str = "sample") -> DataFrame:
    """label_value and features of distinct labelled urls, those of lowest hash, each with the suffix rate of other hosts."""
    # each url once, however many rows hold it: copies of a url sort together and would fill the sample
    urls = C.saved(spark, rows.where("label is not null").select("url").distinct().orderBy(F.xxhash64("url"), "url").limit(sample_rows), root, f"{name}-urls")
    picked = featured(urls.select(F.lit(None).cast("long").alias("page_id"), "url")).join(rates, "suffix", "left")
    own = F.element_at("own", _fold())
    others = (F.col("b") - F.coalesce(own["b"], F.lit(0)) + 1) / (F.col("n") - F.coalesce(own["n"], F.lit(0)) + 2)
    picked = picked.withColumn("f_suffix_rate", F.coalesce(others, F.lit(0.5)))
    return C.saved(spark, picked.select((F.col("label") == "block").cast("double").alias("label_value"), *[f"f_{k}" for k in FEATURES]), root, name)


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    return rows.join(rates.select("suffix", ((F.col("b") + 1) / (F.col("n") + 2)).alias("rate")), "suffix", "left").withColumn("f_suffix_rate", F.coalesce("rate", F.lit(0.5)))


def judge_urls(spark: SparkSession, pages: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, margin for each row of ``pages`` (page_id, url, ...).

    verdict is that of the longest fitting rule, else block where the trees' margin is above 0.
    The trees are trained on ``sample_rows`` distinct labelled urls.
    suffix_rate, the smoothed share of blocked urls among the labelled ones of the same last
    host label, is counted over all labelled rows; for training urls without the hosts of their own
    part, so that no url sees its own label. Null urls and those without "://" have an
    empty host and path, fit no rule and are judged by the trees. Repeated rows and null
    page_ids are judged like all others; other columns are ignored; an empty table gives
    an empty result. Without labelled urls everything is allowed.
    """
    root = C.work_dir(spark)
    rows = featured(pages)
    rates = C.saved(spark, _suffix_rates(rows), root, "suffixes")
    margin = fit(_sample(spark, rows, rates, sample_rows, root)).margin()
    verdict = F.coalesce("label", F.when(F.col("margin") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return _with_rates(rows, rates).withColumn("margin", margin).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "margin")


def held_out_auc(spark: SparkSession, pages: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[float, int]:
    """(area under the ROC curve, urls) on the distinct labelled urls of one part of the hosts, by trees
    and rates that come from the other parts. NaN if a label is missing there."""
    root = C.work_dir(spark)
    rows = featured(pages).withColumn("part", _fold())
    known, held = rows.where("part <> 0"), rows.where("part = 0 and label is not null").dropDuplicates(["url"])
    rates = C.saved(spark, _suffix_rates(known), root, "suffixes")
    margin = fit(_sample(spark, known, rates, sample_rows, root)).margin()
    scored = _with_rates(held, rates).groupBy(margin.alias("margin")).agg(F.count_if(F.col("label") == "block").alias("p"), F.count_if(F.col("label") == "allow").alias("n"))
    below = wins = positives = negatives = 0
    for r in scored.orderBy("margin").collect():  # sums of a few leaves: a bounded number of margins
        wins += r["p"] * (below + r["n"] / 2)
        below, positives, negatives = below + r["n"], positives + r["p"], negatives + r["n"]
    return (wins / (positives * negatives) if positives and negatives else float("nan")), positives + negatives


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark, C.documents(spark, sf_dir, "pages").select("page_id", "url"))
