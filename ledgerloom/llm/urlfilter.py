"""URL filters: rules indexed by their rarest literal token.

Only DataFrame functions run here. Site rules (action, host, path) fit a host and its subdomains where the
path starts with theirs. A pattern rule is an ad-filter style
string: ``*`` stands for any characters, ``^`` for a separator or the end and
``|`` at either end anchors it. All rules are rows of one table. Each is filed under that one of its literal
tokens which the fewest URLs contain; a URL's tokens fetch its candidate rules, and only those are tried,
by prefix or by regular expression. A pattern whose literals may be parts of longer tokens is filed
under four letters of one of them, and URLs then give the four-letter parts of their tokens too; patterns
without four literal letters in a row have nothing to be filed under and are tried on every URL.

Of the site rules that fit a URL the longest decides; of equally long ones that with the longer host, then the one that comes first
by host, path and action. Patterns decide, and block, only where no site rule fits.

Defined cases: a null URL, or one without ``://``, has empty host and path and fits no site rule; a null URL
falls to the method's default ``allow``; a URL of any length is read whole; repeated pages each get their row;
no rules at all allow everything; an empty table gives an empty result; other columns of the input are kept out
of the way and do not matter, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host, path): the longest one that fits decides.
SITE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: What the method blocks where no site rule fits.
PATTERN_RULES = (
    "://spam-farm.*",
    ".spam-farm.*",
    "://cheap-pills.*",
    ".cheap-pills.*",
    "*/casino/*",
    "*adult-content*",
    "*utm_source=spam*",
    "*/track^pixel*",
    "*.exe|",
    "|ftp://*",
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
TOKEN = "[a-z0-9]+"
#: Letters of a part that stands for a token that may go on.
PART = 4
#: Rule tables up to this many rows are broadcast; longer ones are shuffled.
BROADCAST_RULES = 100_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def pattern_regex(pattern: str) -> str:
    """The Java (and RE2) regular expression of a pattern rule."""
    start, end = pattern.startswith("|"), pattern.endswith("|")
    body = pattern[start : len(pattern) - end].strip("*")
    out = "".join({"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}.get(x) or re.escape(x) for x in body)
    return f"(?s){'^' if start else ''}{out}{'$' if end else ''}"


def pattern_tokens(pattern: str) -> list[str]:
    """Literal tokens that every matching URL has as whole tokens: nothing can extend them."""
    start, end = pattern.startswith("|"), pattern.endswith("|")
    body = pattern[start : len(pattern) - end]
    found = []
    for m in re.finditer(TOKEN, body):
        left = m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and start
        right = m.end() < len(body) and body[m.end()] != "*" or m.end() == len(body) and end
        if left and right:
            found.append(m.group())
    return sorted(set(found))


def site_tokens(host: str, path: str) -> list[str]:
    """Literal tokens that every URL of a site rule has as whole tokens: the host's, and the path's but for a last one that may go on."""
    found = re.findall(TOKEN, host) + [m.group() for m in re.finditer(TOKEN, path.translate(LOWER)) if m.end() < len(path)]
    return sorted(set(found))


def pattern_parts(pattern: str) -> list[str]:
    """Four-letter parts of a pattern's literals, marked by a ``~``."""
    return sorted({f"~{m.group()[i : i + PART]}" for m in re.finditer(TOKEN, pattern) for i in range(len(m.group()) - PART + 1)})


RULES = "rule_no int, action string, host string, path string, regex string, tokens array<string>"


def rule_rows(site_rules: Sequence[tuple[str, str, str]], patterns: Sequence[str]) -> list[tuple]:
    """Rows of RULES: site rules have a host and a path, patterns a regular expression."""
    rows = [(a, h, p, None, site_tokens(h, p)) for a, h, p in site_rules]
    rows += [("block", None, None, pattern_regex(p), pattern_tokens(p) or pattern_parts(p)) for p in patterns]
    return [(i, *r) for i, r in enumerate(rows)]


def hit(action: Column, host: Column, path: Column, regex: Column, matches: Column) -> Column:
    """Where the rule fits a URL (``matches`` tells it of a pattern), a struct that is the smaller the sooner the rule decides; else null."""
    of_site = (F.col("url_host") == host) | F.endswith(F.col("url_host"), F.concat(F.lit("."), host))
    fits = F.when(regex.isNull(), of_site & F.startswith(F.col("url_path"), path)).otherwise(matches)
    return F.when(
        fits,
        F.struct(
            regex.isNotNull().alias("pattern"), (-F.length(F.concat(host, path))).alias("size"), (-F.length(host)).alias("host_size"),
            host.alias("host"), path.alias("path"), action.alias("action"),
        ),
    )


def url_tokens(urls: DataFrame, parts: bool) -> DataFrame:
    """``urls`` with a row for each distinct token of ``low``, and with ``parts`` for each four-letter part of one."""
    whole = F.regexp_extract_all("low", F.lit(f"({TOKEN})"), F.lit(1))
    if parts:
        long = F.filter(whole, lambda t: F.length(t) >= PART)
        pieces = F.transform(
            long, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (PART - 1)), lambda i: F.concat(F.lit("~"), t.substr(i, F.lit(PART))))
        )
        whole = F.concat(whole, F.flatten(pieces))
    return urls.withColumn("token", F.explode(F.array_distinct(whole)))


def rule_index(urls: DataFrame, rules: DataFrame, parts: bool) -> DataFrame:
    """The rules that have tokens, each with that one which the fewest of ``urls`` have; of equally rare ones the longest, then the first.

    Counts cover all URLs; only tokens that some rule has are counted, and counting combines before its shuffle.
    """
    asked = rules.select("rule_no", F.explode("tokens").alias("token"))
    counts = url_tokens(urls.select("low"), parts).join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "token", "left").groupBy("rule_no").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), "token")).alias("token")
    )
    return rules.drop("tokens").join(rarest, "rule_no")


def judge_urls(
    pages: DataFrame,
    site_rules: Sequence[tuple[str, str, str]] = SITE_RULES,
    patterns: Sequence[str] = PATTERN_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """id, host, path, rule and verdict of each row of ``pages``.

    Rules are tried on distinct URLs, so that a URL of many rows is judged once; the
    verdicts come back in an outer join, which Spark splits where one URL holds many rows.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = base.select("url").where("url IS NOT NULL").distinct()
    urls = urls.withColumns({"url_host": host_of(F.col("url")), "url_path": path_of(F.col("url")), "low": lower_ascii(F.col("url"))})
    rules = rule_rows(site_rules, patterns)
    parts = any(t.startswith("~") for r in rules for t in r[-1])
    frame = pages.sparkSession.createDataFrame([r for r in rules if r[-1]], RULES)
    index = rule_index(urls, frame, parts)
    fetched = url_tokens(urls, parts).join(F.broadcast(index) if len(rules) <= BROADCAST_RULES else index, "token")
    named = [F.col(c) for c in ("action", "host", "path", "regex")]
    hits = fetched.select("url", hit(*named, F.expr("low rlike regex")).alias("hit"))
    bare = [r[1:5] for r in rules if not r[-1]]
    if bare:
        every = F.array(*(hit(*(F.lit(x).cast("string") for x in r), F.col("low").rlike(r[3] or "")) for r in bare))
        hits = hits.union(urls.select("url", F.explode(every).alias("hit")))
    judged = hits.where("hit IS NOT NULL").groupBy("url").agg(F.min("hit").alias("hit"))
    return base.join(judged, "url", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.concat("hit.host", "hit.path").alias("rule"), F.coalesce(F.col("hit.action"), F.lit("allow")).alias("verdict"),
    )


def oracle(site_rules=SITE_RULES, patterns=PATTERN_RULES) -> str:
    """DuckDB SQL for ``judge_urls`` on ``pages``: every rule tried on every URL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({q(a)}, {q(h)}, {q(p)})" for a, h, p in site_rules) or "(NULL, NULL, NULL)"
    tried = " OR ".join(f"regexp_matches(low, {q(pattern_regex(p))})" for p in patterns) or "false"
    low = f"translate(url, '{UPPER}', '{UPPER.lower()}')"
    return f"""
WITH rules(action, h, p) AS (VALUES {rules}),
u AS (SELECT DISTINCT url, {low} AS low,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT u.url, h || p AS rule, action
      FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
      QUALIFY row_number() OVER (PARTITION BY u.url ORDER BY length(h || p) DESC, length(h) DESC, h, p, action) = 1)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN {tried} THEN 'block' ELSE 'allow' END) AS verdict
FROM pages JOIN u ON pages.url IS NOT DISTINCT FROM u.url LEFT JOIN f ON u.url = f.url
"""
