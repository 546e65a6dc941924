from tessella.llm import urlfilter
from tests.conftest import SMALL


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def rule_of(host, path):
    fits = [(h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_query_equals_plain_rules(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in urlfilter.query(spark, SMALL).collect():
        host, path = host_path(pages[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == verdict
        else:
            assert (r.verdict == "block") == any(s in host.split(".") for s in urlfilter.LISTED_SITES)


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.COM", "http://com/x", "http://x.com?q=/a", "http://www.example.com/en/1#f", "ftp://EXAMPLE.com/en/ab/", "a://b.net/fr/", "http://é.org/Ä?B", "http://xcom/", "http://net/es/", "x://y://z/w", "http://u.com/" + "p" * 50_000, "http://l.org/\n/a"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS listed", "3 AS _key", "4 AS block")
    listed = urlfilter.listed_urls(spark.createDataFrame([("http://www.l.org/x/?b=2&a=1&utm_source=z",), (None,), ("junk",)], "url string"))
    got = urlfilter.judged(pages, listed).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path = host_path(urls[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert urlfilter.judged(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in urlfilter.judged(pages.where("page_id = 9"), listed.limit(0)).collect()} == {"allow"}


def test_bloom_has_no_false_negative_and_the_join_no_false_positive(spark):
    listed = urlfilter.listed_urls(spark.range(3000).selectExpr("concat('https://h', id % 50, '.org/p/', id) AS url"))
    pages = spark.range(9000).selectExpr("id AS page_id", "concat('http://www.h', id % 50, '.org/p/', id, '/?utm_x=1#t') AS url")
    got = urlfilter.judged(pages, listed, rules=()).collect()
    assert all(r.listed == (r.page_id < 3000) for r in got)
    assert all(r.possible for r in got if r.listed)
    assert sum(r.possible for r in got) < 3000 + 6000 * 0.1
    assert all((r.verdict == "block") == r.listed for r in got)


def test_most_urls_without_a_key(spark):
    """Null URLs and ones without a scheme, most of them repeated, beside a listed one and a column of maps."""
    pages = spark.range(3000).selectExpr("id % 7 AS page_id", "CASE WHEN id = 5 THEN 'http://l.org/a' WHEN id % 2 = 0 THEN 'junk' END AS url", "map('a', id) AS m")
    listed = urlfilter.listed_urls(spark.createDataFrame([("http://l.org/a",)], "url string"))
    got = urlfilter.judged(pages, listed, rules=())
    counts = {(r.verdict, r.listed, r.possible): r.n for r in got.groupBy("verdict", "listed", "possible").count().withColumnRenamed("count", "n").collect()}
    assert counts == {("block", True, True): 1, ("allow", False, False): 2999}
