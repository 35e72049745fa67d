"""URL filters: path rules, then logistic regression on hashed character n-grams.

DataFrame operations only. A rule ``host/path`` fits its host and all
subdomains when the URL's path starts with the rule's path; the longest rule
wins. URLs without a rule get the verdict of a logistic regression on hashed
character n-grams of host and path, trained on a small table of labelled URLs.

Defined results: a null URL or one without ``://`` has an empty host and path,
no rule, and the classifier's verdict; repeated rows get equal verdicts; very
long URLs are used whole; with labels of one class only that class is the
verdict, without labels ``allow``; other input columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.session import materialize

ALLOW, BLOCK = "allow", "block"

# The rules of the query's contract (fixed values).
DEFAULT_RULES = (("com/", ALLOW), ("example.com/en/", BLOCK), ("www.example.com/en/", ALLOW),
                 ("net/es/", BLOCK), ("net/fr/", BLOCK))

# Host words of the labelled URL table.
UNWANTED = ("casino", "poker-win", "slots", "online-casino", "bets", "free-spins", "sports-bets", "jackpot-win",
            "pills", "cheap-meds", "pharma-pills", "cheap-replica", "diet-pills", "adult", "adult-chat", "xxx",
            "porn", "x-videos", "spam", "link-farm", "spam-links", "seo-farm", "ads", "ad-track", "track-click",
            "ads-banner", "popup-ads", "malware", "phishing", "warez", "free-crack", "payday-loans", "lottery", "roulette",
            "blackjack", "betting", "viagra", "escort", "torrent", "gambling", "webcam-girls", "loan-shark")
WANTED = ("library", "university", "museum", "news", "city-news", "weather", "garden", "recipes", "history",
          "science", "music", "travel", "school", "docs", "forum", "health", "sports", "books", "book-club", "code",
          "theatre", "art-gallery", "physics", "maths", "open-data", "maps", "radio", "cinema", "village", "nature",
          "bird-watch", "astronomy", "literature", "cooking", "running", "chess", "gov", "research", "archive",
          "photo-notes", "engineering", "economics", "teaching", "medicine", "the-herald", "mountain", "river",
          "hospital", "painting", "railway", "philosophy", "newspaper", "orchestra", "kitchen", "geography",
          "parliament", "languages", "harbour", "football", "bakery", "observatory", "gallery", "church", "council")


@dataclass(frozen=True)
class UrlModel:
    grams: tuple[int, ...] = (3, 4, 5)
    features: int = 1 << 14
    max_labels: int = 20_000  # bound of a labelled table given by the caller, in hash order
    regularization: float = 1e-4
    iterations: int = 50
    threshold: float = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_fits(host: Column, path: Column, rule: str) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def apply_rules(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, else null. A short parameter list: one CASE."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        fits = rule_fits(host, path, rule)
        found = F.when(fits, F.lit(rule)).otherwise(found)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return found, verdict


def char_grams(text: Column, tag: str, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of ``^text$`` with every digit read as 0, marked with a tag."""
    marked = F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]", "0"), F.lit("$"))
    n = F.length(marked)
    parts = [F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))),
                                        lambda i, k=k: F.concat(F.lit(tag), F.substring(marked, i, F.lit(k)))))
             .otherwise(F.array().cast("array<string>")) for k in sizes]
    return F.concat(*parts)


def url_grams(model: UrlModel) -> Column:
    return F.concat(char_grams(F.col("host"), "h", model.grams), char_grams(F.col("path"), "p", model.grams))


def seed_labels(spark: SparkSession) -> DataFrame:
    """The small labelled URL table (host, path, label 1 = block): every word of the
    two lists under a few subdomains and endings; paths are dealt to both classes
    alike, so a path alone says nothing. Its size is fixed by the lists."""
    rows = []
    for label, names in ((1.0, UNWANTED), (0.0, WANTED)):
        for i, name in enumerate(names):
            for j, sub in enumerate(("", "www.", "blog.", "m.")):
                rows.append((f"{sub}{name}.example.{('com', 'net', 'org')[(i + j) % 3]}",
                             ("", "/", "/en/12", "/fr/7.html", "/de/305/", "/es/48")[(i + 2 * j) % 6], label))
    return spark.createDataFrame(rows, "host string, path string, label double")


def filter_urls(pages: DataFrame, rules=DEFAULT_RULES, labels: DataFrame | None = None,
                model: UrlModel = UrlModel(), *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict and the classifier's probability of ``block``.

    ``labels`` (host, path, label 0/1) may replace the built-in labelled table.
    """
    host, path = split_url(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    urls = urls.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))

    tf = HashingTF(inputCol="grams", outputCol="features", numFeatures=model.features, binary=True)
    labels = seed_labels(pages.sparkSession) if labels is None else labels.select("host", "path", "label").orderBy(
        F.xxhash64("host", "path"), "host", "path", "label").limit(model.max_labels)
    train = materialize(tf.transform(labels.withColumn("grams", url_grams(model))).select("label", "features"),
                        "url-labels")
    classes = [r.label for r in train.select("label").distinct().collect()]  # at most two rows
    if len(classes) < 2:
        says = BLOCK if classes == [1.0] else ALLOW
        scored = urls.withColumn("p_block", F.lit(1.0 if says == BLOCK else 0.0))
    else:
        fit = LogisticRegression(regParam=model.regularization, maxIter=model.iterations).fit(train)
        scored = fit.transform(tf.transform(urls.withColumn("grams", url_grams(model)))).withColumn(
            "p_block", vector_to_array("probability")[1])
    judged = F.when(F.col("p_block") >= model.threshold, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule",
                         F.coalesce("rule_verdict", judged).alias("verdict"), "p_block")
