import math
import re
import zlib

import pytest

from lumenward.llm import op6_url_filter
from lumenward.llm.url_filter import ALLOWED_HOSTS, BLOCKED_HOSTS, GRAM, RULES, SLOTS, filter_urls, labelled_urls, train
from tests.llm import brute

URLS = [
    "http://example.org/es/1", "http://sub.example.org/es/", "http://example.org/es", "https://example.org/en/12", "http://example.org/en/2",
    "http://notexample.org/es/1", "http://a.com/fr/x", "http://a.com/de/x", "http://a.com/DE/x", "ftp://X.Y.COM/de/?q=/fr/",
    "http://org/", "http://org", "http://a.org?x=/en/1", "http://a.org#f", "http://", "://h/p", "no scheme", "", None,
    "http://a.net/b://c.org/d", "http://É.NET/ä", "http://cheap-pills.example.net/en/1", "https://ththth.example.net/en/77",
    "http://a.net/" + "abc/" * 30_000, "http://a.net/new\nline", "http://x@a.org:80/",
]


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(brute.LOWER), re.match(r"[^?#]*", rest[len(host):])[0]


def _rule(host, path):
    best = None
    for rule, verdict in RULES:
        rule_host, _, rest = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rest):
            if best is None or len(rule) > len(best[0]):
                best = rule, verdict
    return best


def _score(host, path, model):
    weights, bias = model
    total = bias
    for kind, value in (("h", host), ("p", path)):
        value = f"^{value}$"
        for i in range(len(value) - GRAM + 1):
            total += weights[zlib.crc32((kind + value[i:i + GRAM]).encode()) % SLOTS]
    return total


@pytest.fixture(scope="module")
def model(spark):
    return train(labelled_urls(spark))


def test_query_against_plain_code(spark, model, as_tables):
    rows = [(i, u, "<p>") for i, u in enumerate(URLS)] + [(0, URLS[0], None), (None, URLS[1], None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string")
    got = op6_url_filter.query(spark, as_tables(pages=pages)).collect()
    assert len(got) == len(rows)
    for r in got:
        url = URLS[1] if r.page_id is None else URLS[r.page_id]
        host, path = _split(url)
        rule, score = _rule(host, path), _score(host, path, model)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.block_score == pytest.approx(score) and not math.isclose(score, 0, abs_tol=1e-9)
        assert r.verdict == (rule[1] if rule else "block" if score >= 0 else "allow")


def test_model_tells_hosts_apart(spark, model):
    kinds = {"block": ["casino-slots-win", "cheap-pills-shop", "free-bets", "adult-x", "spam-farm", "ads-track"],
             "allow": ["theston", "ththing", "tionble", "school-of-weather", "garden", "thernd", "library"]}
    rows = [(v, f"https://{w}.{h}.example.net/{lang}/{n}") for v, hosts in kinds.items() for h in hosts
            for w in ("www", "m", "blog") for lang, n in (("en", 7), ("de", 4321), ("fr", "88.html"))]
    table = spark.createDataFrame(rows, "page_id string, url string")
    got = filter_urls(table, model).collect()
    assert sum(r.page_id == r.verdict for r in got) >= 0.95 * len(got)
    assert filter_urls(table.limit(0), model).count() == 0


def test_no_host_is_judged_by_its_own_label(spark, model):
    """No labelled host is one of the given pages, and those are told apart all the same."""
    known = {h.removesuffix(".test") for h in (*BLOCKED_HOSTS, *ALLOWED_HOSTS)}
    rows = filter_urls(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), model).where("rule IS NULL AND host <> ''").collect()
    names = [(r, set(r.host.split("."))) for r in rows]
    assert not any(known & parts for _, parts in names)
    bad = {"adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-far", "spam-farm"}
    wrong = [r.host for r, parts in names if (r.verdict == "block") != bool(bad & parts or any(p.startswith(b) for p in parts for b in bad))]
    assert len(wrong) <= 0.02 * len(rows), wrong


def test_training_repeats_itself(spark, model):
    assert train(labelled_urls(spark)) == model


def test_no_python_on_the_main_path(spark, model):
    plan = filter_urls(spark.createDataFrame([(1, "http://a.net")], "page_id int, url string"), model)
    assert not re.search("Python|Arrow|Pandas", plan._jdf.queryExecution().executedPlan().toString())
