import datetime as dt
import random

from pyspark.sql import functions as F

from parchmint.llm import urllists

ENTRIES = "list string, kind string, pattern string, action string, dated date"
CAPTURES = "page_id long, url string, fetched_at timestamp"


def parts(url):
    import re

    m = re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", url or "")
    host = m[1].lower() if m else ""
    if not host:
        return []
    labels = host.split(".")
    path = [x for x in re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", url)[1].split("/") if x]
    return [("domain", ".".join(labels[i:])) for i in range(len(labels))] + [("prefix", host + "/" + "/".join(path[: i + 1])) for i in range(len(path))]


def brute(captures, entries):
    out = []
    for page, url, at in captures:
        active = []
        for kind, pattern in parts(url) if at else []:
            for name in {e[0] for e in entries if e[0]}:
                own = [(e[4], e[3] == "add") for e in entries if e[:3] == (name, kind, pattern) and e[3] in ("add", "remove") and e[4] and e[4] <= at.date()]
                if own and max(own)[1]:
                    active.append((len(pattern), kind == "prefix", name == "allow", pattern))
        best = max(active, default=None)
        out.append((page, url, at, len(active), best and best[3], "unlisted" if not best else "allowed" if best[2] else "blocked"))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.example.com", "b.a.example.com", "x.org", "example.com", "y.x.org"]
    day = lambda: dt.date(2023, 1, 1) + dt.timedelta(rng.randrange(120))
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'me@'])}{rng.choice(hosts).replace('x', rng.choice('xX'))}{rng.choice(['', ':80'])}{rng.choice(['', '/', '/p', '/p/q', '//p/q/'])}{rng.choice(['', '?x=/z', '#/t'])}" for _ in range(150)]
    captures = [(i, u, dt.datetime.combine(day(), dt.time(rng.randrange(24)))) for i, u in enumerate(urls)]
    captures += [captures[0], captures[0], (None, None, None), (1, None, captures[1][2]), (2, urls[2], None), (3, "no url", captures[3][2]), (4, "http:///p", captures[3][2])]
    patterns = [("domain", h) for h in [*hosts, "com", "org"]] + [("prefix", h + p) for h in hosts for p in ("/p", "/p/q")]
    entries = [(rng.choice(["block", "allow", "spam"]), *rng.choice(patterns), rng.choice(["add", "add", "remove"]), day()) for _ in range(260)]
    entries += [(None, "domain", "com", "add", day()), ("block", "domain", None, "add", day()), ("block", "domain", "com", "keep", day()), ("block", "domain", "org", "add", None), entries[0]]
    want = brute(captures, entries)
    rows = spark.createDataFrame(captures, CAPTURES).withColumn("salt", F.lit(1)).withColumn("pattern", F.lit("x"))
    got = [tuple(r) for r in urllists.filter_captures(rows, spark.createDataFrame(entries, ENTRIES)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {w[5] for w in want} == {"unlisted", "allowed", "blocked"}


def test_empty_tables(spark):
    captures, entries = spark.createDataFrame([(1, "http://a.b/c", dt.datetime(2023, 1, 1))], CAPTURES), spark.createDataFrame([], ENTRIES)
    assert [tuple(r)[3:] for r in urllists.filter_captures(captures, entries).collect()] == [(0, None, "unlisted")]
    assert urllists.filter_captures(captures.limit(0), entries).collect() == []


def test_native(spark):
    captures, entries = spark.createDataFrame([(1, "http://a.b/c", dt.datetime(2023, 1, 1))], CAPTURES), spark.createDataFrame([], ENTRIES)
    plan = urllists.filter_captures(captures, entries)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan and "InArrow" not in plan
