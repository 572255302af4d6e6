from bidlake.llm import urls as U
from tests.oracle import assert_same, connect


def reference(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = next(iter(__import__("re").split("[/?#]", rest)))
    path = __import__("re").split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


URLS = [None, "", "nothing", "http://", "https://EXAMPLE.org/es/x?q#f", "http://a.b.example.org/en/12", "http://example.org", "http://notexample.org/es/1", "http://x.com/de/1", "http://com/fr/", "http://x.com/DE/", "ftp://..org/a", "http://x.com#/de/", "http://Ü.org/é"]


def test_against_reference(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.url_verdicts(pages, U.rule_table(spark)).collect()}
    assert len(out) == 2 * len(URLS)
    assert all(out[i] == reference(u) for i, u in enumerate(URLS * 2))
    assert U.url_verdicts(pages.limit(0), U.rule_table(spark)).count() == 0
    assert {r["verdict"] for r in U.url_verdicts(pages, U.rule_table(spark).limit(0)).collect()} == {"allow"}


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = U.url_verdicts(spark.read.parquet(f"{sf}/pages.parquet"), U.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")
    assert_same(df, connect(sf), U.ORACLE_SQL)
