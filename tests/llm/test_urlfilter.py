import random

import duckdb

from ledgerloom.llm import urlfilter
from ledgerloom.llm.urlfilter import judge_urls, pattern_tokens

URLS = [
    None, "", "no scheme", "http://", "https://A.Example.ORG/es/1", "https://example.org/es", "https://example.org/en/12?x=1", "https://notexample.org/en/1",
    "http://x.com/fr/9", "http://x.com/de/9", "http://x.com/de", "http://x.com?u=/de/", "http://x.net/a#b", "http://spam-farm.net/x", "http://my-spam-farm.net/x",
    "http://www.cheap-pills.net/", "http://x.net/casino/1", "http://x.net/CASINO/1", "http://x.net/casinos/1", "ftp://x.net/", "http://x.net/setup.exe", "http://x.net/setup.exe?1",
    "a://b://c/d", "http://ÄÖ.com/fr/ä", "http://x.net/myadult-content2", "http://x.net/track?pixel", "http://x.net/\nnew line", "http://x.net/" + "a/" * 20000,
]


def test_matches_every_rule_tried_on_every_url(stored, tmp_path):
    rows = [(i, u, None, "p") for i, u in enumerate(URLS)] + [(3, URLS[4], None, "p"), (None, URLS[13], "x", None)] + [(500 + i, URLS[14], "h", "v") for i in range(300)]
    df = stored(rows, "page_id long, url string, html string, verdict string", "pages")
    got = sorted(map(str, map(tuple, judge_urls(df).collect())))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(map(str, con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({urlfilter.oracle()})").fetchall()))
    assert got == want and len(got) == len(rows)
    assert judge_urls(df.where("false")).collect() == []


def test_tokens_are_whole():
    assert pattern_tokens("://spam-farm.*") == ["farm", "spam"]
    assert pattern_tokens("*adult-content*") == [] and pattern_tokens("*.exe|") == ["exe"] and pattern_tokens("|ftp://*") == ["ftp"]


def index_of(spark, urls, site_rules, patterns):
    frame = spark.createDataFrame([(u,) for u in urls], "low string")
    rows = urlfilter.rule_rows(site_rules, patterns)
    parts = any(t.startswith("~") for r in rows for t in r[-1])
    found = urlfilter.rule_index(frame, spark.createDataFrame([r for r in rows if r[-1]], urlfilter.RULES), parts)
    return {r.regex or r.host + r.path: r.token for r in found.collect()}


def test_rule_goes_under_its_rarest_token(spark):
    urls = [f"http://spam{i}.net/farm/x" for i in range(5)] + ["http://a.net/spam/", "http://b.net/myadult-content2"]
    index = index_of(spark, urls, [("block", "a.net", "/spam/far"), ("block", "net", "/")], ["/spam/farm/", "*adult-farm*", "*a.*"])
    assert index[urlfilter.pattern_regex("/spam/farm/")] == "spam" and index["a.net/spam/far"] == "spam" and index["net/"] == "net"
    assert index[urlfilter.pattern_regex("*adult-farm*")] in ("~adul", "~dult") and len(index) == 4


def against_sql(df, tmp_path, site_rules, patterns):
    got = sorted(map(str, map(tuple, judge_urls(df, site_rules, patterns).collect())))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(map(str, con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({urlfilter.oracle(site_rules, patterns)})").fetchall()))
    assert got == want
    return got


def test_thousands_of_rules_match_all_tried_on_all(stored, tmp_path):
    draw = random.Random(4)
    label = ["com", "org", "shop", "news", "cdn", "x1", "ads", "img", "ä", "my-site"]
    words = ["track", "banner", "a", "page", "en", "DE", "casino", "pixel", "p2", "download"]
    host = lambda n: ".".join(draw.choice(label) for _ in range(draw.randint(1, n)))
    path = lambda: "".join("/" + draw.choice(words) + draw.choice(["", "", "s", "-1"]) for _ in range(draw.randint(0, 3))) + draw.choice(["", "/"])
    sites = list({(draw.choice(["allow", "block"]), host(3), path()) for _ in range(2_500)})
    ends = ["", "*", "|", "^"]
    patterns = list({draw.choice(ends[:3]) + draw.choice(["/", ".", "-", "*", ""]).join(draw.sample(words, draw.randint(1, 3))).lower() + draw.choice(ends) for _ in range(1_500)})
    urls = [f"{draw.choice(['http', 'HTTPS', 'ftp'])}://{host(5)}.{draw.choice(['zz', 'com', 'net'])}{path()}{draw.choice(['', '?a=banner', '#page'])}" for _ in range(600)]
    rows = [(i, u) for i, u in enumerate([*urls, *URLS])]
    got = against_sql(stored(rows, "page_id long, url string", "pages"), tmp_path, sites, patterns)
    assert sum("'block'" in x for x in got) > 50 and sum(x.count("None") == 1 for x in got) > 50


def test_ties_no_rules_and_rules_without_tokens(stored, tmp_path):
    df = stored([(i, u) for i, u in enumerate(["http://x.com/fr", "http://b.x.com/fr", "http://ä/q", "http://x.com/DE/1", None])], "page_id long, url string", "pages")
    sites = [("allow", "com", "/fr"), ("block", "x.com", "/"), ("block", "x.com", "/fr"), ("allow", "x.com", "/fr"), ("block", "ä", ""), ("block", "com", "/DE/")]
    got = against_sql(df, tmp_path, sites, ["*.*", "*q*"])
    assert "(0, 'x.com', '/fr', 'x.com/fr', 'allow')" in got and "(2, 'ä', '/q', 'ä', 'block')" in got
    against_sql(df, tmp_path, [("allow", "com", "/fr"), ("block", "x.com", "/")], [])
    against_sql(df, tmp_path, [], [])
