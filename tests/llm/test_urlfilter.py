from quarry.llm.queries import ALLOW, BLOCK
from quarry.llm.urlfilter import Cascade, filter_urls

URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.org/es/x?y", "http://a.example.org/es/", "http://example.org/en/1", "http://example.org/en/19#t", "http://notexample.org/en/2", "http://x.com/fr/1", "x://com/de/", "http://é.com/de/z", "http://org", "http://org/", "http://com/de", "http://a.b.net/fr/?q#h", "http://u@example.org:80/es/", "://org/://com/de/", "http://example.org/ES/"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    rest = rest[:cut]
    host, slash, path = rest.partition("/")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = slash + path
    fits = [r for r in [*ALLOW, *BLOCK] if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    rule = max(fits, key=len, default=None)
    return host, path, rule, "block" if rule in BLOCK else "allow"


def test_like_brute_force(spark):
    rows = [(i, u, "<html>", "clash") for i, u in enumerate(URLS)] + [(None, "http://org/", None, None), (3, "http://org/", None, None)]
    out = filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string, rule string"), ALLOW, BLOCK)
    assert sorted(map(repr, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()))) == sorted(repr((r[0], *brute(r[1]))) for r in rows)


def test_empty_table(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), ALLOW, BLOCK).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key")
    listed = universe.filter("crc32(cast(key AS binary)) % 40 = 0")
    cascade = Cascade(listed, universe)
    assert cascade.shards == 1 and len(cascade.levels(0)) >= 2
    found = universe.filter(cascade.member(0)(universe.key))
    assert sorted(r.key for r in found.collect()) == sorted(r.key for r in listed.collect())


def test_lists_beyond_a_cascade_are_dealt_to_several(spark):
    universe = spark.range(3_000).selectExpr("concat('k', id) AS key")
    listed = universe.filter("crc32(cast(key AS binary)) % 10 = 0")
    cascade = Cascade(listed, universe, max_bytes=60)
    assert cascade.shards >= 3
    rows = universe.selectExpr("key", "array(concat('k', cast(substring(key, 2) AS int) + 1), key) AS keys").filter("key <> 'k2999'")
    want = {r.key for r in listed.collect()}
    out = cascade.first(rows, "keys", "found").collect()
    assert all(r.found == next((k for k in r["keys"] if k in want), None) for r in out) and len(out) == 2999
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert sorted(map(repr, filter_urls(df, ALLOW, BLOCK, max_bytes=3).collect())) == sorted(map(repr, filter_urls(df, ALLOW, BLOCK).collect()))


def test_a_very_long_url(spark):
    long = "http://" + ".".join(["a"] * 60) + ".example.org/es/" + "x" * 1_000_000
    (r,) = filter_urls(spark.createDataFrame([(1, long)], "page_id long, url string"), ALLOW, BLOCK).collect()
    assert (r.host, r.path, r.rule, r.verdict) == brute(long)
