import datetime as dt

import duckdb
from pyspark.sql import functions as F

from pointloom.llm.url_filter import EVENTS, SQL, evaluate, host_of, intervals, list_events


def test_intervals(spark):
    ev = list_events(spark, [("a", "domain", "x.com", "block", "2024-01-01"), ("a", "domain", "x.com", "remove", "2024-02-01"), ("a", "domain", "x.com", "block", "2024-03-01"), ("a", "domain", "y.com", "block", "2024-03-01"), ("a", "domain", "y.com", "remove", "2024-03-01")])
    got = sorted((r.pattern, str(r.since), str(r.until)) for r in intervals(ev).collect())
    assert got == [("x.com", "2024-01-01", "2024-02-01"), ("x.com", "2024-03-01", "None")]


def test_hosts(spark):
    urls = ["http://A.Example.com:80/x", "https://user:pw@b.com?q", "ftp://c.com.#f", "no url", "", None, "http:///path", "//d.com/"]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(host_of("u")).collect()]
    assert got == ["a.example.com", "b.com", "c.com", None, None, None, None, None]


def brute(url, day, events):
    """The entries in force on a day, one by one."""
    host = url.split("//")[1].split("/")[0]
    address = host + "/" + url.split("//")[1].partition("/")[2].split("?")[0].split("#")[0]
    blocks, lifted = {}, {}
    for key in {e[:3] for e in events}:
        past = [e for e in events if e[:3] == key and e[4] <= day]
        if not past:
            continue
        act = max(past, key=lambda e: e[4])[3]
        name, kind, pattern = key
        hit = {"host": host == pattern, "domain": host == pattern or host.endswith("." + pattern), "path": address == pattern or address.startswith(pattern + "/")}[kind]
        if hit and act == "block":
            blocks.setdefault(name, []).append(len(pattern))
        if hit and act == "allow":
            lifted[name] = max(lifted.get(name, -1), len(pattern))
    left = {n: [x for x in b if x > lifted.get(n, -1)] for n, b in blocks.items()}
    return ",".join(sorted(n for n, b in left.items() if b)), sum(map(len, left.values()))


HOSTS = ["casino-win.example.com", "m.casino-win.example.com", "free-bets.example.com", "www.x.example.org", "thther.example.org", "m.thther.example.org", "blog.tionble.example.com", "a.blog.tionble.example.com", "tionsh.example.net", "notcasino-win.example.com", "ok.com"]
PATHS = ["/de/1", "/de", "/den/1", "/en/5?x=/de", ""]


def test_like_brute_force_and_sql(spark):
    rows = [(7 * i + j, f"https://{h}{p}") for i, h in enumerate(HOSTS) for j, p in enumerate(PATHS)]
    rows = [(k * 13, u) for k in range(6) for _, u in rows]
    rows = [(i + 10 * n, u) for n, (i, u) in enumerate(rows)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    out = evaluate(pages, list_events(spark)).withColumn("fetched", F.col("fetched").cast("string")).toPandas().sort_values("page_id", ignore_index=True)
    assert out.is_blocked.any() and not out.is_blocked.all()
    for r in out.itertuples():
        assert (r.lists, r.entries) == brute(r.url, r.fetched, EVENTS), r
    pages = pages.toPandas()
    want = duckdb.sql(SQL).df().sort_values("page_id", ignore_index=True)
    assert out[sorted(out)].equals(want[sorted(want)].astype(out[sorted(out)].dtypes))


def test_own_fetch_times(spark):
    pages = spark.createDataFrame([(1, "http://x.com/", dt.date(2024, 1, 1)), (2, "http://x.com/", dt.date(2024, 1, 2)), (3, "http://x.com/", None)], "page_id bigint, url string, at date")
    ev = list_events(spark, [("a", "host", "x.com", "block", "2024-01-02")])
    assert [r.is_blocked for r in evaluate(pages, ev, F.col("at")).orderBy("page_id").collect()] == [False, True, False]


def test_odd_rows(spark):
    rows = [(None, None), (1, None), (2, ""), (3, "x"), (4, "http://casino-win.example.com/" + "a/" * 5000), (5, "http://casino-win.example.com"), (5, "http://casino-win.example.com"), (None, "http://casino-win.example.com")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    out = evaluate(pages, list_events(spark)).collect()
    assert len(out) == len(rows)
    assert sum(r.is_blocked for r in out) == 3 and not any(r.is_blocked for r in out if r.page_id is None)
    extra = pages.withColumns({c: F.lit("clash") for c in ("host", "list", "lists", "since", "until", "kind", "pattern", "entries", "key")})
    assert evaluate(extra, list_events(spark)).count() == len(rows)
    assert evaluate(pages.limit(0), list_events(spark)).count() == 0
    assert evaluate(pages, list_events(spark).limit(0)).where("is_blocked").count() == 0
    holes = list_events(spark).union(spark.createDataFrame([("a", None, "x", "block", None)], "list string, kind string, pattern string, action string, since date"))
    assert evaluate(pages, holes).count() == len(rows)
