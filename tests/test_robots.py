import random
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from hrefsieve.operators.robots import domain_verdicts, with_verdict
from hrefsieve.params import AuditParams

PARTS = [
    "User-agent: *", "user-agent: url-scanner", "User-Agent: URL", "User-agent: other", "Disallow: /", "Disallow:", "Allow: /a",
    "Disallow: /a/b", "Disallow: /a%2Fb?c=d", "Allow: *", "disallow : /é", "Disallow: /x;p?", "Disallow: /a b # why", "", " ", "# c",
    "Crawl-delay: 2", "Request-rate: 1/2", "Sitemap: https://x/y", "nonsense", "Disallow: //y", "Allow: /q?", "Disallow: /a+b%zz",
]
URLS = [
    "https://h.com", "https://h.com/", "https://h.com/a", "https://h.com/a/b", "https://h.com/a/bc?x#y", "https://h.com/a%2Fb?c=d", "https://h.com/%C3%A9",
    "https://h.com/é", "https://h.com/x;p?q", "https://h.com/a%20b", "https://h.com//y", "https://h.com/q", "https://h.com/a+b%zz/", "https://h.com/z~_.-",
]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    return {f"d{i}": rng.choice(["\n", "\r\n"]).join(rng.choice(PARTS) for _ in range(rng.randrange(0, 14))) for i in range(250)}


def test_rules_like_the_standard_parser(spark, docs):
    token = AuditParams().agent_token
    frame = spark.createDataFrame([(d, 200, bytearray(t.encode())) for d, t in docs.items()], "domain string, status int, body binary")
    pages = frame.select("domain").crossJoin(spark.createDataFrame([(u,) for u in URLS], "url string"))
    got = {(r["domain"], r["url"]): r["allowed"] for r in with_verdict(pages, domain_verdicts(frame, token)).collect()}
    want = {}
    for d, t in docs.items():
        parser = RobotFileParser()
        parser.parse(t.splitlines())
        for u in URLS:
            want[d, u] = parser.can_fetch(AuditParams().user_agent, u)
    assert [(docs[k[0]], k[1], got[k], want[k]) for k in want if got[k] != want[k]][:2] == []
    assert len(got) == len(want)


def test_whole_document_verdicts(spark):
    rows = [("ok", 200, b""), ("no", 403, b""), ("auth", 401, b""), ("gone", 404, b"x"), ("down", 500, b""), ("never", 0, None), ("bytes", 200, b"\xff")]
    frame = spark.createDataFrame([(d, s, None if b is None else bytearray(b)) for d, s, b in rows], "domain string, status int, body binary")
    pages = spark.createDataFrame([(d, "https://h/x") for d, _, _ in rows] + [("unknown", "https://h/x")], "domain string, url string")
    got = {r["domain"]: r["allowed"] for r in with_verdict(pages, domain_verdicts(frame, "url-scanner")).collect()}
    assert got == {"ok": True, "no": False, "auth": False, "gone": True, "down": False, "never": False, "bytes": False, "unknown": False}


def test_longest_match(spark):
    text = b"User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /c\nAllow: /c\n"
    frame = spark.createDataFrame([("d", 200, bytearray(text))], "domain string, status int, body binary")
    pages = spark.createDataFrame([("d", f"https://h{p}") for p in ("/a", "/a/b", "/c", "/z")], "domain string, url string")
    first = {r["url"][9:]: r["allowed"] for r in with_verdict(pages, domain_verdicts(frame, "url-scanner")).collect()}
    longest = {r["url"][9:]: r["allowed"] for r in with_verdict(pages, domain_verdicts(frame, "url-scanner", True)).collect()}
    assert first == {"/a": False, "/a/b": False, "/c": False, "/z": True}
    assert longest == {"/a": False, "/a/b": True, "/c": True, "/z": True}


def test_salted_join_equals_broadcast(spark, docs, monkeypatch):
    frame = spark.createDataFrame([(d, 200, bytearray(t.encode())) for d, t in docs.items()], "domain string, status int, body binary")
    pages = frame.select("domain", F.explode(F.array(*[F.lit(u) for u in URLS])).alias("url"))
    verdicts = domain_verdicts(frame, "url-scanner")
    small = sorted(map(tuple, with_verdict(pages, verdicts).collect()))
    monkeypatch.setattr("hrefsieve.session.fits", lambda df: False)
    assert sorted(map(tuple, with_verdict(pages, verdicts).collect())) == small
