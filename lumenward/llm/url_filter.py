"""URL filters: rules by host and path, and a logistic regression for the rest.

Everything is column expressions: splitting the URL, the rules, the hashed
character n-grams, and the model's score.  The model is trained once on the
small labelled table below, by the library's DataFrame-based learner.

Rules are (host, path) with a verdict.  A rule fits a URL whose host is the
rule's or ends with a dot and the rule's, if the URL's path starts with the
rule's; of those that fit, the longest decides, then the first by name.

Defined results: null, or a text without ``://``, has an empty host and path;
very long URLs are used whole; repeated rows give repeated rows; an empty table
gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenward.functions.text import quote

ALLOW, BLOCK = "allow", "block"
GRAM = 3
SLOTS = 4096
#: Half of the labelled URLs are to be blocked; of all URLs, it is taken to be one in three.
PRIOR_ODDS = 0.5
RULES = (("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK))

#: Hosts of the kinds to be blocked, and others.  None of them is a host of the tables this runs on.
BLOCKED_HOSTS = (
    "discount-pills.test", "cheap-meds.test", "pills-online.test", "cheap-viagra-shop.test", "buy-pills-cheap.test",
    "casino-royal.test", "winner-casino.test", "best-casino-slots.test", "win-big-jackpot.test", "poker-win-bonus.test",
    "sport-bets.test", "bets-online.test", "free-spins.test", "free-bonus.test", "free-bet-tips.test",
    "spam-links.test", "spamfarm.test", "link-farm.test", "farm-of-spam.test", "mail-spammer.test",
    "adult-video.test", "adults-only.test", "xxx-cams.test", "adult-xxx.test", "sex-adult-chat.test",
    "ads-server.test", "click-ads.test", "tracker-ads.test", "adtrack.test", "banner-ads-tracking.test",
)
ALLOWED_HOSTS = (
    "library.test", "university.test", "museum.test", "garden.test", "weather.test", "news.test", "docs.software.test",
    "city.test", "recipes.test", "history.test", "travel.test", "school.test", "science.test", "theatre.test",
    "orchestra.test", "the-bakery.test", "football-club.test", "mathematics.test", "health-care.test", "harbour.test",
    "mountain.test", "painting.test", "thinking-aloud.test", "henderson-and-sons.test", "weather-the-storm.test",
    "another-thing.test", "townhall.test", "learning.test", "northern-lights.test", "publishing-house.test",
)
#: Paths and subdomains found with both, so that the model learns little from them.
PATHS = ("/a/12", "/2019/story/", "/index.html", "/p/7", "", "/archive")
PREFIXES = ("", "www.", "m.", "blog.")


def split_url(url: str) -> dict[str, str]:
    """Expressions for host and path."""
    def part(group: int) -> str:
        return f"coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', {group}), '')"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return {"host": f"translate({part(1)}, '{upper}', '{lower}')", "path": part(2)}


def matching_rule(host: str, path: str, rules=RULES) -> str:
    """The struct (rule, verdict) of the longest rule that fits, or null."""
    cases = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = (f"({host} = {quote(rule_host)} OR endswith({host}, {quote('.' + rule_host)}))"
                f" AND startswith({path}, {quote(slash + rest)})")
        cases.append(f"WHEN {fits} THEN struct({quote(rule)} AS rule, {quote(verdict)} AS verdict)")
    return f"CASE {' '.join(cases)} END" if cases else "cast(NULL AS struct<rule:string,verdict:string>)"


def gram_slots(host: str, path: str) -> str:
    """The slots of all n-grams of host and path, each with marks at its ends; found in one scan each."""
    def slots(kind: str, value: str) -> str:
        grams = f"regexp_extract_all(concat('^', {value}, '$'), '(?s)(?=(.{{{GRAM}}}))', 1)"
        return f"transform({grams}, g -> cast(crc32(cast(concat('{kind}', g) AS binary)) % {SLOTS} AS int))"

    return f"concat({slots('h', host)}, {slots('p', path)})"


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [f"struct({quote(f'https://{PREFIXES[k % 4]}{host}{PATHS[k % 6]}')} AS url, {label}D AS label)"
            for label, hosts in ((1, BLOCKED_HOSTS), (0, ALLOWED_HOSTS)) for at, host in enumerate(hosts) for k in (at, at + 3)]
    return spark.sql(f"SELECT inline(array({', '.join(rows)}))")


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """The weights of the slots and the bias, for the number of grams in each slot, from (url, label)."""
    parts = split_url("url")
    count = f"transform(sequence(0, {SLOTS - 1}), s -> cast(size(slots) - size(array_remove(slots, s)) AS double))"
    rows = (
        labelled.selectExpr("label", f"{parts['host']} AS host", f"{parts['path']} AS path")
        .selectExpr("label", f"{gram_slots('host', 'path')} AS slots").selectExpr("label", f"{count} AS counts")
        .coalesce(1).select("label", array_to_vector("counts").alias("features")).persist())
    try:  # the learner reads its small table more than once
        model = LogisticRegression(regParam=0.01, standardization=False, maxIter=100).fit(rows)
    finally:
        rows.unpersist()
    return [float(x) for x in model.coefficients.toArray()], float(model.intercept) + math.log(PRIOR_ODDS)


def filter_urls(pages: DataFrame, model: tuple[list[float], float], keep=("page_id",), rules=RULES) -> DataFrame:
    """``keep`` and ``host, path, rule, verdict, block_score``, the last being the model's log odds."""
    weights, bias = model
    parts = split_url("url")
    kept = [f"`{k}`" for k in keep]
    split = pages.selectExpr(*kept, f"{parts['host']} AS host", f"{parts['path']} AS path")
    slotted = split.selectExpr("*", f"{matching_rule('host', 'path', rules)} AS _rule", f"{gram_slots('host', 'path')} AS _slots")
    listed = F.array(*[F.lit(w) for w in weights])
    total = F.aggregate("_slots", F.lit(0.0), lambda s, slot: s + F.get(listed, slot))
    scored = slotted.withColumn("block_score", F.lit(bias) + total)
    return scored.selectExpr(
        *kept, "host", "path", "_rule.rule AS rule",
        f"coalesce(_rule.verdict, if(block_score >= 0D, '{BLOCK}', '{ALLOW}')) AS verdict", "block_score")
