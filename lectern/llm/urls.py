"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

Rules decide what they fit; the longest that fits wins. Their decisions are also the labels from which
trees learn what blocked and allowed addresses look like: lengths, depth, digit ratio, entropy, parameter
counts, and how often urls of the same suffixes (of the host, and with the path's first section) were blocked, for a
training url as the other folds tell. Trees are fitted on a bounded sample of
labelled urls (``SAMPLE`` of each label, by lowest hash of the url); suffix statistics cover all
labelled urls. Features, fitting and judging are DataFrame and MLlib work.

Defined cases: a url that is null or has no ``://`` has empty host and path, fits no rule and is judged by its
(empty) features; with no labelled url of one label, everything without a rule gets the other label
(``allow`` when there are none at all); of equally long rules that fit (which differ in no way but their place)
the first given wins; repeated urls are judged alike; an empty table gives an empty result; only key and url
are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import shared_dir, stored, table

#: (host, path, verdict), as the contract gives them.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SAMPLE = 10_000
TREES, DEPTH, RATE = 15, 4, 0.3
#: Weight of the overall share of blocked urls in a suffix's statistic.
PRIOR_WEIGHT = 20.0
#: Parts of the labelled urls; statistics of a training url come from the other parts.
FOLDS = 5
SUFFIXES = ("suffix", "site", "section", "site_section")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = ("url_length", "host_length", "path_length", "query_length", "depth", "labels", "digits", "letters", "dashes", "parameters", "host_entropy", "path_entropy", "longest_label", "secure", "fragment")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; a host rule also fits its subdomains."""
    rule = verdict = F.lit(None).cast("string")
    for name, prefix, decision in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # later ones win
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, f"{name}{prefix}").otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1))
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def with_features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with the lexical features and the suffixes: the host's last label and last two, the path's first section, and both together."""
    url, labels = F.coalesce(F.col("url"), F.lit("")), F.split("host", r"\.")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    found = {
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"), "query_length": F.length(query),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")), "labels": F.size(labels), "digits": count(url, "[0-9]") / n, "letters": count(url, "[A-Za-z]") / n,
        "dashes": count(F.col("host"), "-"), "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")), "host_entropy": _entropy(F.col("host")), "path_entropy": _entropy(F.col("path")),
        "longest_label": F.array_max(F.transform(labels, F.length)), "secure": url.startswith("https://"), "fragment": F.contains(url, F.lit("#")),
    }
    suffix, site = F.element_at(labels, -1), F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    section = F.get(F.filter(F.split("path", "/"), lambda x: x != ""), F.lit(0))
    first = F.coalesce(section, F.lit(""))
    return urls.withColumns({c: x.cast("double") for c, x in found.items()} | {"suffix": suffix, "site": site, "section": first, "site_section": F.concat(site, F.lit("/"), first)})


def suffix_statistics(labelled: DataFrame) -> dict[str, DataFrame]:
    """Labelled urls (``n``) and blocked ones (``b``) by fold, for each kind of suffix; stored."""
    parts = labelled.withColumn("fold", fold(F.col("url")))
    return {c: stored(parts.groupBy(c, "fold").agg(F.sum("blocked").alias("b"), F.count(F.lit(1)).alias("n")), "suffixes") for c in SUFFIXES}


def fold(url: Column) -> Column:
    """One of ``FOLDS`` parts of the labelled urls; a url's copies are in the same."""
    return F.pmod(F.xxhash64(F.coalesce(url, F.lit(""))), F.lit(FOLDS)).cast("int")


def with_statistics(urls: DataFrame, suffixes: dict[str, DataFrame], share: float, out_of_fold: bool) -> DataFrame:
    """``urls`` with the smoothed share of blocked urls, and how many there were, for each of their suffixes.

    A labelled url must not see its own label, or trees learn to read it there: ``out_of_fold`` leaves out the fold that
    the url belongs to. A suffix that no (other) labelled url has gives the overall share.
    """
    if out_of_fold:
        urls = urls.withColumn("_fold", fold(F.col("url")))
    for c, counts in suffixes.items():
        total = counts.groupBy(c).agg(F.sum("b").alias("_b"), F.sum("n").alias("_n"))
        urls = urls.join(total, c, "left")
        b, n = F.coalesce("_b", F.lit(0)), F.coalesce("_n", F.lit(0))
        if out_of_fold:
            own = counts.select(c, F.col("fold").alias("_fold"), F.col("b").alias("_own_b"), F.col("n").alias("_own_n"))
            urls = urls.join(own, [c, "_fold"], "left")
            b, n = b - F.coalesce("_own_b", F.lit(0)), n - F.coalesce("_own_n", F.lit(0))
        urls = urls.withColumns({f"{c}_blocked": (b + PRIOR_WEIGHT * share) / (n + PRIOR_WEIGHT), f"{c}_seen": F.log1p(n.cast("double"))}).drop("_b", "_n", "_own_b", "_own_n")
    return urls.drop("_fold")


class UrlModel:
    """Fitted trees with the suffix statistics; ``judged`` adds the probability that a url is to be blocked."""

    def __init__(self, model: GBTClassificationModel | None, suffixes: dict[str, DataFrame] | None, share: float):
        self.model, self.suffixes, self.share = model, suffixes, share

    def judged(self, urls: DataFrame) -> DataFrame:
        """``urls`` (of ``with_features``) with ``p_blocked``."""
        if self.model is None:
            return urls.withColumn("p_blocked", F.lit(self.share))
        rows = _assembled(with_statistics(urls, self.suffixes, self.share, out_of_fold=False))
        found = self.model.transform(rows).withColumn("p_blocked", vector_to_array("probability")[1])
        return found.select(*urls.columns, "p_blocked")


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[*LEXICAL, *(f"{c}_{x}" for c in SUFFIXES for x in ("blocked", "seen"))], outputCol="features").transform(rows)


def fit(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, seed: int = 7) -> UrlModel:
    """Trees from ``labelled`` (``with_features``, and ``blocked`` 0 or 1)."""
    n, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocked"), F.lit(0))).head()
    share = blocked / n if n else 0.0
    if blocked in (0, n):
        return UrlModel(None, None, share)
    suffixes = suffix_statistics(labelled)
    order = [F.xxhash64("url"), "url"]
    parts = [labelled.where(F.col("blocked") == b).orderBy(*order).limit(sample) for b in (0, 1)]
    rows = _assembled(with_statistics(parts[0].unionByName(parts[1]), suffixes, share, out_of_fold=True)).select("features", F.col("blocked").cast("double").alias("label"))
    rows = stored(rows, "url-sample")
    shared_dir(labelled.sparkSession)
    trainer = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, maxBins=32)
    return UrlModel(trainer.fit(rows.coalesce(2)), suffixes, share)


def held_out_scores(labelled: DataFrame, part: int = 0, **options) -> dict[str, float]:
    """Shares right of a model that has not seen one fold, on that fold: of all, of blocked, of allowed urls; and of
    always saying what is most frequent there."""
    own = fold(F.col("url"))
    model = fit(labelled.where(own != part), **options)
    rows = model.judged(labelled.where(own == part)).select("blocked", ((F.col("p_blocked") >= 0.5).cast("int") == F.col("blocked")).cast("int").alias("right"))
    by = {r.blocked: (r.n, r.right) for r in rows.groupBy("blocked").agg(F.count(F.lit(1)).alias("n"), F.sum("right").alias("right")).collect()}
    n = sum(x for x, _ in by.values())
    share = lambda k: by[k][1] / by[k][0] if k in by else float("nan")
    return {"n": n, "accuracy": sum(x for _, x in by.values()) / n, "majority": max(x for x, _ in by.values()) / n, "blocked": share(1), "allowed": share(0)}


def ruled_urls(urls: DataFrame, rules=RULES) -> DataFrame:
    """``urls`` (url) with features, of those that a rule fits: labelled by it (``blocked``)."""
    host, path = split_url(F.col("url"))
    rows = urls.select("url").withColumns({"host": host, "path": path})
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return with_features(rows.withColumns({"_rule": rule, "blocked": (verdict == "block").cast("int")}).where("_rule IS NOT NULL").drop("_rule"))


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """key, host, path, rule, verdict, p_blocked. ``labelled`` (url, blocked) adds to what the rules decide."""
    raw = pages.select(F.col(key).alias("_key"), F.col(url).alias("url"))
    host, path = split_url(F.col("url"))
    split = raw.withColumns({"host": host, "path": path})
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = split.withColumns({"rule": rule, "_by_rule": verdict})
    known = ruled.where(F.col("rule").isNotNull()).select("url", "host", "path", (F.col("_by_rule") == "block").cast("int").alias("blocked"))
    if labelled is not None:
        host, path = split_url(F.col("url"))
        known = known.unionByName(labelled.select("url", host.alias("host"), path.alias("path"), F.col("blocked").cast("int").alias("blocked")))
    model = fit(with_features(known), sample)
    judged = model.judged(with_features(ruled.where(F.col("rule").isNull())))
    by_model = judged.select("_key", "host", "path", "rule", F.when(F.col("p_blocked") >= 0.5, "block").otherwise("allow").alias("verdict"), "p_blocked")
    by_rule = ruled.where(F.col("rule").isNotNull()).select("_key", "host", "path", "rule", F.col("_by_rule").alias("verdict"), F.lit(None).cast("double").alias("p_blocked"))
    return by_rule.unionByName(by_model).withColumnRenamed("_key", key)


def op2_urls(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"))
