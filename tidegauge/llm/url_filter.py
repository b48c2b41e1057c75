"""URL filters by redirect equivalence: block decisions spread over aliases. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written
from .components import components

#: (verdict, rule); a rule is host, then path from its first slash.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


ORIGIN = r"^[^:/?#]+://[^/?#]*"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [(v, r, r[: r.index("/")].lower(), r[r.index("/") :]) for v, r in rules]
    return spark.createDataFrame(rows, "rule_verdict string, rule string, rule_host string, rule_path string")


def split_url(url):
    """(host, path): after the first ://, up to / ? # (A-Z lower-cased), then up to ? #; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def page_key(url):
    """What names a page: its url without the fragment, A-Z of scheme and host lower-cased."""
    bare = F.regexp_extract(url, r"^[^#]*", 0)
    origin = F.regexp_extract(bare, ORIGIN, 0)
    return F.concat(ascii_lower(origin), F.substr(bare, F.length(origin) + 1))


def without_dots(url):
    """url with the . and .. segments of its path taken out."""
    origin, query = F.regexp_extract(url, ORIGIN, 0), F.regexp_extract(url, r"[?].*$", 0)
    path = F.substr(url, F.length(origin) + 1, F.length(url) - F.length(origin) - F.length(query))
    parts = F.aggregate(
        F.split(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "/"),
        F.array().cast("array<string>"),
        lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(x))),
    )
    return F.when(F.contains(path, F.lit("/.")), F.concat(origin, F.array_join(parts, "/"), query)).otherwise(url)


def resolved(url, to):
    """A link's target against the url of its page; null if it is no page (another scheme without ://, or nothing but a fragment)."""
    scheme, origin, page = F.regexp_extract(url, r"^([^:/?#]+:)//", 1), F.regexp_extract(url, ORIGIN, 0), F.regexp_extract(url, r"^[^?#]*", 0)
    folder = F.when(F.length(page) > F.length(origin), F.regexp_extract(page, r"^.*/", 0)).otherwise(F.concat(origin, F.lit("/")))
    full = (
        F.when((to == "") | to.startswith("#"), None)
        .when(F.contains(to, F.lit("://")) & to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(to.startswith("/"), F.concat(origin, to))
        .when(to.startswith("?"), F.concat(page, to))
        .otherwise(F.concat(folder, to))
    )
    return without_dots(full)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b) for each canonical link and each refresh redirect in a page's html; relative targets are resolved against the page's url."""
    every = lambda tag, target: F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, target, 1))
    found = pages.where(F.col("html").isNotNull() & F.contains("url", F.lit("://"))).select("url", F.explode(F.concat(every(CANONICAL, HREF), every(REFRESH, TARGET))).alias("to"))
    to = resolved(F.col("url"), F.replace(F.col("to"), F.lit("&amp;"), F.lit("&")))
    return found.select(page_key(F.col("url")).alias("a"), page_key(to).alias("b")).where("a <> b").distinct()


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (distinct, column url) with host, path, and of the fitting rules the longest (then the first by text): rule, rule_verdict."""
    host, path = split_url(F.col("url"))
    parts = urls.select("url", host.alias("host"), path.alias("path"))
    suffixes = parts.where("host <> ''").selectExpr(
        "url", "path", "explode(transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))) as rule_host"
    )
    fits = suffixes.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("url").agg(F.min_by(F.struct("rule", "rule_verdict"), F.struct(-F.length("rule"), F.col("rule"))).alias("r"))
    return parts.join(best, "url", "left").select("url", "host", "path", "r.rule", "r.rule_verdict")


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages with host, path, rule and verdict (allow or block).

    A url's own longest rule decides. Without one, the url takes its alias component's: allow if a
    rule allows any alias, else block if a rule blocks any alias, else allow. Components join pages
    over canonical links and refresh redirects of the html. A url that is null or has no :// has
    empty host and path, fits no rule and is allowed unless an alias is blocked. Every row of pages is kept, repeated ones
    too; columns of pages with these names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    edges = written(alias_edges(pages))
    groups = components(edges)
    urls = pages.select("url").where("url is not null").union(groups.select("node")).distinct()
    own = judged(urls, rules)
    ruled = own.withColumn("node", page_key(F.col("url"))).join(groups, "node")
    spread = ruled.groupBy("component").agg(
        F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked")
    )
    by_url = (
        own.withColumn("node", page_key(F.col("url")))
        .join(groups, "node", "left")
        .join(spread, "component", "left")
        .select(
            F.col("url").alias("_url"), "host", "path", "rule",
            F.coalesce("rule_verdict", F.when(~F.coalesce("allowed", F.lit(False)) & F.coalesce("blocked", F.lit(False)), "block"), F.lit("allow")).alias("verdict"),
        )
    )
    out = pages.join(by_url, pages["url"] == by_url["_url"], "left").drop(by_url["_url"])
    return out.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit("")), "verdict": F.coalesce("verdict", F.lit("allow"))})


def op4(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return filter_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def planted(spark, sf_dir):
    """The pages with links planted in them: chains of ten pages by page_id, and one hub that every seventh page names."""
    return filter_urls(linked(table(spark, sf_dir, "pages").select("page_id", "url")), rule_table(spark)).groupBy("rule", "verdict").agg(F.count("*").alias("n"), F.sum("page_id").alias("ids"))


def linked(pages: DataFrame) -> DataFrame:
    return pages.withColumn("html", F.expr(LINKED))


LINKED = """CASE WHEN page_id % 10 = 0 THEN concat('<link rel="canonical" href="HTTP://Chain.example.org/', page_id, '?a=1&amp;b=2">')
  WHEN page_id % 10 = 1 THEN concat('<meta http-equiv="refresh" content="0; url=http://chain.example.org/', page_id - 1, '?a=1&b=2#x">')
  WHEN page_id % 10 = 2 THEN concat('<link rel="canonical" href="//chain.example.org/', page_id - 2, '?a=1&b=2"><link rel="canonical" href="next', page_id, '.html">')
  WHEN page_id % 7 = 0 THEN '<link rel="canonical" href="http://hub.example.org/all">' ELSE '<a href="/x">x</a>' END"""

ORACLE = r"""
WITH RECURSIVE rules(verdict, rule, rule_host, rule_path) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
found AS (SELECT url, replace(unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))), '&amp;', '&') AS t
  FROM pages WHERE html IS NOT NULL AND contains(url, '://')),
base AS (SELECT *, regexp_extract(url, '^([^:/?#]+:)//', 1) scheme, regexp_extract(url, '^[^:/?#]+://[^/?#]*') origin, regexp_extract(url, '^[^?#]*') page FROM found),
raw AS (SELECT url, CASE WHEN t = '' OR starts_with(t, '#') THEN NULL WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  WHEN starts_with(t, '//') THEN scheme || t WHEN starts_with(t, '/') THEN origin || t WHEN starts_with(t, '?') THEN page || t
  WHEN length(page) > length(origin) THEN regexp_extract(page, '^.*/') || t ELSE origin || '/' || t END AS t FROM base),
edge AS (SELECT DISTINCT {key_url} a, {key_t} b FROM raw WHERE t IS NOT NULL),
link AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
near(node, low) AS (SELECT a, least(a, min(b)) FROM link GROUP BY 1),
reach(a, b) AS (SELECT node, node FROM near WHERE low = node UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
grp AS (SELECT b node, min(a) component FROM reach GROUP BY 1),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT node FROM grp),
rest AS (SELECT url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END r FROM urls),
part AS (SELECT url, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path FROM rest),
own AS (SELECT url, {key_url} AS node, host, path, arg_max(rule, length(rule)) rule, arg_max(verdict, length(rule)) v FROM part LEFT JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL),
spread AS (SELECT component, bool_or(v = 'allow') allowed, bool_or(v = 'block') blocked FROM own JOIN grp USING (node) GROUP BY 1)
SELECT page_id, coalesce(host, '') host, coalesce(path, '') path, rule,
  coalesce(v, CASE WHEN NOT coalesce(allowed, false) AND coalesce(blocked, false) THEN 'block' END, 'allow') verdict
FROM pages LEFT JOIN own USING (url) LEFT JOIN grp USING (node) LEFT JOIN spread USING (component)
"""
for _name in ("url", "t"):
    _bare = f"regexp_extract({_name}, '^[^#]*')"
    _origin = f"regexp_extract({_bare}, '{ORIGIN}')"
    _lower = f"translate({_origin}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ORACLE = ORACLE.replace("{key_" + _name + "}", f"({_lower} || substr({_bare}, length({_origin}) + 1))")

PLANTED_ORACLE = ORACLE.replace("FROM pages", "FROM linked").replace("WITH RECURSIVE ", f"WITH RECURSIVE linked AS (SELECT page_id, url, {LINKED} AS html FROM pages), ").replace(
    "SELECT page_id, coalesce(host", "SELECT rule, verdict, count(*) AS n, sum(page_id)::BIGINT AS ids FROM (SELECT page_id, coalesce(host"
) + ") GROUP BY ALL"
