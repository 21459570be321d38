import duckdb
import pytest

from grantlens.llm import queries
from grantlens.llm.urls import host_reputation, judge_urls, longest_suffix

PAGES = "page_id long, url string, html string"


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLES["op8_url_filters"]).fetchall()
    got = [tuple(r) for r in queries.op8_url_filters(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("https://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/en", "example.net", "/en", "net/", "block"),
        ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
        ("http://net", "net", "", None, "allow"),
        ("http://net/", "net", "/", "net/", "block"),
        ("http://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"),
        ("http://example.com?/de/", "example.com", "", None, "allow"),
        ("x://É.ORG/fr/#a?b", "É.org", "/fr/", "org/fr/", "allow"),
        ("http://a/b://c/d", "a", "/b://c/d", None, "allow"),
        ("://", "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_parts_and_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, None)], PAGES)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    (r,) = judge_urls(pages, labels).collect()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_bad_hosts_are_blocked_and_shrunk(spark):
    pages, labels, n = [], [], 0
    for host, count, bad in (("spam.co.uk", 60, 57), ("b.spam.co.uk", 2, 2), ("fine.example", 200, 6), ("new.example", 1, 1)):
        for k in range(count):
            pages.append((n, f"http://{host}/{k}", None))
            labels.append((n, 0 if k < bad else 1, 0))
            n += 1
    pages += [(n, "http://c.spam.co.uk/", None), (n + 1, "http://other.example/", None)]
    judged = judge_urls(
        spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    )
    by = {r["host"]: r for r in judged.collect()}
    assert by["spam.co.uk"]["verdict"] == "block" and by["fine.example"]["verdict"] == "allow"
    assert by["new.example"]["verdict"] == "allow"  # one bad page says little
    assert by["fine.example"]["bad_share"] < by["other.example"]["bad_share"] < by["c.spam.co.uk"]["bad_share"]
    assert all(r["bad_low"] <= r["bad_share"] for r in by.values())


def test_repeated_pages_and_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "x"), (1, "http://a.b/", "x"), (None, "http://a.b/", None)], PAGES)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    clash = pages.withColumnRenamed("html", "verdict")
    rows = judge_urls(clash, labels).collect()
    assert len(rows) == 3 and all(r["verdict"] in ("allow", "block") for r in rows)
    assert judge_urls(pages.limit(0), labels).count() == 0


def test_reputation_without_labels(spark):
    outcomes = spark.createDataFrame([("a.b", 0, 0), ("", 0, 0)], "host string, n long, bad long")
    assert {round(r["bad_share"], 6) for r in host_reputation(outcomes).collect()} == {0.5}


LABELS = "doc_id long, quality int, toxic int"


def verdicts(spark, hosts, asked, suffixes=None):
    """Verdicts of pages of ``asked`` hosts, given (host, pages, bad ones)."""
    pages, labels, n = [], [], 0
    for host, count, bad in hosts:
        for k in range(count):
            pages.append((n, f"http://{host}/{k}", None))
            labels.append((n, 0 if k < bad else 1, 0))
            n += 1
    pages += [(n + i, f"http://{h}/", None) for i, h in enumerate(asked)]
    judged = judge_urls(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS), suffixes=suffixes)
    by = {r["host"]: r for r in judged.collect()}
    return [by[h]["verdict"] for h in asked]


def test_each_level_decides(spark):
    """The same kind of page is blocked or allowed by its host, its domain or its suffix alone."""
    hosts = [(f"h{i}.mixed.example", 30, 29 if i < 3 else 1) for i in range(6)]  # hosts of one domain differ
    hosts += [(f"h{i}.bad.org", 30, 28) for i in range(6)] + [(f"h{i}.good.org", 30, 1) for i in range(6)]
    assert verdicts(spark, hosts, ["h0.mixed.example", "h5.mixed.example"]) == ["block", "allow"]
    # hosts alike within their domains: the domain speaks for a host never seen
    alike = [h for h in hosts if "mixed" not in h[0]]
    assert verdicts(spark, alike, ["new.bad.org", "new.good.org"]) == ["block", "allow"]
    # domains alike within their suffixes: the suffix speaks for a domain never seen
    by_suffix = [(f"d{i}.spam", 30, 27) for i in range(8)] + [(f"d{i}.ham", 30, 1) for i in range(8)]
    assert verdicts(spark, by_suffix, ["new.spam", "new.ham", "new.other"]) == ["block", "allow", "allow"]


def test_unseen_hosts_are_allowed_where_hosts_differ(spark):
    hosts = [(f"h{i}.d{i}.example", 40, 40 if i < 2 else 0) for i in range(5)]
    assert verdicts(spark, hosts, ["new.example", "h0.d0.example", "h4.d4.example"]) == ["allow", "block", "allow"]


def test_table_of_public_suffixes(spark):
    listed = spark.createDataFrame([("uk",), ("co.uk",), ("pages.dev",), (None,), ("co.uk",)], "suffix string")
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.pages.dev",), ("pages.dev.example",), ("uk",), ("",), ("b.dev",)], "host string")
    got = {r["host"]: r["suffix"] for r in longest_suffix(hosts, listed).collect()}
    assert got == {"a.b.co.uk": "co.uk", "co.uk": "co.uk", "x.pages.dev": "pages.dev", "pages.dev.example": "example", "uk": "uk", "": "", "b.dev": "dev"}
    # users of one hoster are domains of their own
    users = [(f"u{i}.pages.dev", 40, 38 if i < 4 else 0) for i in range(8)]
    assert verdicts(spark, users, ["u0.pages.dev", "u7.pages.dev", "new.pages.dev"], listed) == ["block", "allow", "allow"]
