import random
import re

from changelens.llm import queries, url_filter
from pyspark.sql import functions as F

from tests.llm.cases import plain

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def rule_of(host, path):
    fits = [
        r
        for r in RULES
        for h, p in [(r[: r.index("/")], r[r.index("/") :])]
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/", "http://com", "http://a.com/x", "http://xcom/",
    "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com/en", "http://example.com/en/", "ftp://é.net/es/ü",
    "http://Ä.net/fr/?x://y", "x://h/p\nq?r", "http://www.a.org/b.html?utm_source=1&ref=2", "https://a.org/b/#f",
    "http://a.org/b?z=1&a=2", "https://m.a.org/b?a=2&utm_x=3&z=1",
]


def test_host_path_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    judged = url_filter.judge_urls(pages, pages.where("false"), queries.URL_RULES).collect()
    assert len(judged) == len(URLS)
    for r in judged:
        host, path = parts(r.url)
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, RULES.get(rule, "allow")), r.url


def test_listed_urls_are_exact_however_small_the_filter(spark):
    rng = random.Random(5)
    urls = [f"http://h{rng.randrange(30)}.org/p{rng.randrange(900)}" for _ in range(3000)] + URLS
    listed = urls[:200] + [None, "nothing", urls[0]]
    forms = [u and u.replace("http://", "https://www.") + "/?utm_medium=x#y" for u in urls[:600]]
    pages = spark.createDataFrame(list(enumerate(urls + forms)), "page_id long, url string")
    table = spark.createDataFrame([(u,) for u in listed], "url string")
    known = {u for u in urls[:200]}
    results = []
    for params in (
        url_filter.BloomParams(),
        url_filter.BloomParams(keys_per_block=2000),
        url_filter.BloomParams(broadcast_bytes=0),
    ):
        rows = url_filter.judge_urls(pages, table, (), params=params).collect()
        results.append(plain([(r.page_id, r.listed, r.verdict) for r in rows]))
        assert all(r.maybe_listed or not r.listed for r in rows)
    assert results[0] == results[1] == results[2]
    crowded = url_filter.judge_urls(pages, table, (), params=url_filter.BloomParams(keys_per_block=2000))
    assert crowded.where("maybe_listed and not listed").count() > 0  # false positives, removed
    own = {i for i, u in enumerate(urls) if u in known}
    got = {i for i, listed_, _ in results[0] if listed_}
    assert own <= got and {i for i in got if i < 3000} == own
    assert {3000 + len(URLS) + i for i in range(200)} <= got


def test_equal_forms_and_clashing_columns(spark):
    pages = spark.createDataFrame(
        [(1, "http://www.a.org/b.html?utm_source=1", "x", 7), (1, "http://www.a.org/b.html?utm_source=1", "x", 7)],
        "page_id long, url string, verdict string, w0 long",
    )
    listed = spark.createDataFrame([("https://a.org/b/#f",)], "link string")
    rows = url_filter.judge_urls(pages, listed, (), listed_col="link").collect()
    assert [(r.verdict, r.w0) for r in rows] == [("block", 7)] * 2
    assert url_filter.judge_urls(pages.where("false"), listed, (), listed_col="link").count() == 0


def test_shuffled_rows_are_spread(spark):
    """Beyond the broadcast size, rows without a hit or a URL are not one key."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    pages = spark.range(20_000).selectExpr("id AS page_id", "if(id % 3 = 0, null, concat('http://h', id % 900, '.org/', id)) AS url")
    listed = pages.where("page_id % 50 = 1").select("url")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        judged = url_filter.judge_urls(pages, listed, (), params=url_filter.BloomParams(broadcast_bytes=0, keys_per_block=1))
        sizes = sorted(r["count"] for r in judged.groupBy(F.spark_partition_id()).count().collect())
        hits = judged.where("listed").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {p for p in range(1, 20_000, 50) if p % 3}
    assert hits == len(want) and sum(sizes) == 20_000
    assert sizes[-1] < 2 * sizes[-4]  # half of the partitions are those of the few hits


def test_very_long_urls(spark):
    long = "http://a.org/" + "p/" * 200_000 + "?" + "&".join(f"k{i}=v" for i in range(5000))
    pages = spark.createDataFrame([(1, long), (2, long + "x"), (3, "http://" + "h" * 100_000)], "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.judge_urls(pages, pages.where("page_id = 1"), queries.URL_RULES).collect()}
    assert rows[1].listed and not rows[2].listed and rows[3].host == "h" * 100_000
