"""URL filters: site rules and pattern rules, fetched by their rarest literal token. DataFrame operations only.

A site rule (verdict, host, path) fits its host and all subdomains where the path starts with the
rule's; the longest rule decides. A pattern rule (verdict, pattern) decides the urls that no site rule fits.
Patterns have the syntax of public filter lists: `||` begins at the host or one of its labels, `|` at
either end anchors there, `*` is any run, `^` is a character that no name holds or the url's end; case of A-Z
doesn't count. Among the patterns that match, allow wins over block, then the longest; without any
the url is allowed.

Both kinds become regular expressions. A token is a run of a-z and 0-9; a rule's literal tokens are those
that stand whole in any url that it matches. Each rule is filed under the literal token that the fewest
urls of the table hold. A url's tokens fetch the rules filed under them, and only these run their
expression. Rules without a literal token are filed under the empty token, which every url has: exact, but slow.

The index has one row a rule. It is broadcast up to BROADCAST_RULES rules; a larger one is joined by
token, where adaptive execution splits frequent tokens. What a url fetches is pre-aggregated in its task.

Edge cases: a null url, or one without `://`, has empty host and path and no pattern fits; repeated rows are judged
each; empty tables of pages or rules give empty results or the verdict allow; other columns pass through
allowed_pages() whatever their names.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.storage import materialize, table

BROADCAST_RULES = 50_000
SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"

# Verdict, host, path.
SITE_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# Verdict and pattern.
PATTERN_RULES = (
    ("block", "||cheap-pills."),
    ("block", "||spam-farm."),
    ("block", "-casino."),
    ("block", "-pills."),
    ("block", "||adult-"),
    ("block", "||casino-"),
    ("block", "||ads-"),
    ("block", "-bets."),
    ("block", "/casino/"),
    ("block", "/poker/"),
    ("block", "/viagra^"),
    ("block", "/warez/"),
    ("block", "/wp-login.php"),
    ("block", "/wp-admin/"),
    ("block", "/xmlrpc.php"),
    ("block", "/cgi-bin/"),
    ("block", "/login^"),
    ("block", "/signup^"),
    ("block", "/register^"),
    ("block", "/cart^"),
    ("block", "/checkout^"),
    ("block", "/search?"),
    ("block", "/calendar/*/print^"),
    ("block", "^phpsessid="),
    ("block", "^sessionid="),
    ("block", "^jsessionid="),
    ("block", "^replytocom="),
    ("block", "^affiliate="),
    ("block", "/print/"),
    ("block", "/feed/|"),
    ("block", ".zip|"),
    ("block", ".exe|"),
    ("block", "|ftp://"),
    ("allow", "||docs."),
    ("allow", "||wiki."),
    ("allow", "/wiki/search?"),
    ("allow", "/licenses/*/print^"),
)


def rule_table(spark: SparkSession, rows, names: tuple[str, ...]) -> DataFrame:
    """A short list of rows as a DataFrame that no Python worker makes."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def site_rules(spark: SparkSession, rows=SITE_RULES) -> DataFrame:
    return rule_table(spark, rows, ("verdict", "host", "path"))


def pattern_rules(spark: SparkSession, rows=PATTERN_RULES) -> DataFrame:
    return rule_table(spark, rows, ("verdict", "pattern"))


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"[.+?$()\[\]{}\\|]", r"\\$0")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to one of `/?#`, A-Z lower-cased; path: from there up to one of `?#`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return _lower(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def compiled(sites: DataFrame, patterns: DataFrame) -> DataFrame:
    """(kind, rule, verdict, regex, tokens): every rule with its expression and its whole literal tokens."""
    site = sites.select(F.lit("site").alias("kind"), F.concat(_lower(F.col("host")), "path").alias("rule"), "verdict").distinct()
    site = site.select("*", F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), F.replace(_quoted(F.col("rule")), F.lit("*"), F.lit(r"\*"))).alias("regex"), F.concat(F.lit("."), "rule", F.lit("*")).alias("marked"))
    low = _lower(F.col("pattern"))
    body = F.regexp_replace(F.regexp_replace(low, r"^\|\|?", ""), r"\|$", "")
    expression = F.replace(F.replace(_quoted(body), F.lit("^"), F.lit(SEPARATOR)), F.lit("*"), F.lit(".*"))
    begins = F.when(low.startswith("||"), r"^[^/]*//(?:[^/?#]*\.)?").when(low.startswith("|"), "^").otherwise("")
    pattern = patterns.select(
        F.lit("pattern").alias("kind"),
        F.col("pattern").alias("rule"),
        "verdict",
        F.concat(F.lit("(?s)"), begins, expression, F.when(low.endswith("|"), "$").otherwise("")).alias("regex"),
        F.concat(F.when(low.startswith("|"), "|").otherwise("*"), body, F.when(low.endswith("|"), "|").otherwise("*")).alias("marked"),
    ).distinct()
    tokens = F.regexp_extract_all(_lower(F.replace("marked", F.lit("^"), F.lit("|"))), F.lit(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), F.lit(0))
    return site.unionByName(pattern).select("kind", "rule", "verdict", "regex", F.array_distinct(tokens).alias("tokens"))


def url_tokens(low: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))


def indexed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(token, kind, rule, verdict, regex): each rule under the literal token that the fewest of urls (low) hold."""
    literal = rules.select("kind", "rule", "verdict", F.explode("tokens").alias("token"))
    wanted = literal.select("token").distinct()
    wanted = F.broadcast(wanted) if rules.count() <= BROADCAST_RULES else wanted
    found = urls.select(F.explode(url_tokens(F.col("low"))).alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rated = literal.join(found, "token", "left").groupBy("kind", "rule", "verdict").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    return rules.join(rated, ["kind", "rule", "verdict"], "left").select(F.coalesce("rarest.token", F.lit("")).alias("token"), "kind", "rule", "verdict", "regex")


def candidates(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(row, kind, rule, verdict, fits): the rules that each url's tokens fetch, and whether their expression matches."""
    each = urls.select("row", "low", "site", F.explode(F.concat(url_tokens(F.col("low")), F.array(F.lit("")))).alias("token"))
    target = F.when(F.col("kind") == "site", F.col("site")).otherwise(F.col("low"))
    return each.join(index, "token").select("row", "kind", "rule", "verdict", F.regexp(target, F.col("regex")).alias("fits"))


def judged(pages: DataFrame, sites: DataFrame, patterns: DataFrame, *, id_col="page_id", url_col="url") -> DataFrame:
    """page_id, url, host, path, rule, verdict, pattern, n_matched and n_candidates: one row an input row.

    rule: the deciding site rule; pattern: the deciding pattern where there is no such rule; n_matched:
    matching rules of both kinds; n_candidates: rules that the url fetched.
    """
    url = F.col(f"`{url_col}`")
    host, path = host_and_path(F.coalesce(url, F.lit("")))
    named = pages.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    whole = F.when(F.contains(F.col("url"), F.lit("://")), _lower(F.col("url"))).otherwise("")
    urls = materialize(named.select("*", whole.alias("low"), F.concat("host", "path").alias("site")), "urls")
    rules = compiled(sites, patterns)
    index = indexed(rules, urls)
    index = F.broadcast(materialize(index, "rules")) if rules.count() <= BROADCAST_RULES else materialize(index, "rules")
    fetched = candidates(urls, index)
    site, allow = F.col("kind") == "site", F.col("verdict") == "allow"
    decided = fetched.groupBy("row").agg(
        F.max(F.when(F.col("fits") & site, F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("site"),
        F.max(F.when(F.col("fits") & ~site, F.struct(allow.alias("allow"), F.length("rule").alias("n"), "rule", "verdict"))).alias("pattern"),
        F.count_if("fits").alias("n_matched"),
        F.count("*").alias("n_candidates"),
    )
    joined = urls.drop("site").join(decided, "row", "left")
    return joined.select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("site.rule").alias("rule"),
        F.coalesce("site.verdict", "pattern.verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("site").isNull(), F.col("pattern.rule")).alias("pattern"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_matched", "n_candidates")],
    )


def allowed_pages(pages: DataFrame, sites: DataFrame, patterns: DataFrame, *, url_col="url", **options) -> DataFrame:
    """The pages whose url isn't blocked, with all their columns; a verdict depends on the url alone."""
    verdicts = judged(pages, sites, patterns, url_col=url_col, **options)
    blocked = verdicts.where("verdict = 'block'").select(F.col("url").alias("_blocked")).distinct()
    return pages.join(blocked, pages[f"`{url_col}`"] == blocked["_blocked"], "left_anti")


def op11_url_filters(spark, sf_dir):
    found = judged(table(spark, sf_dir, "pages"), site_rules(spark), pattern_rules(spark))
    return found.select("page_id", "host", "path", "rule", "verdict", "pattern", "n_matched")


def regex_of(pattern: str) -> str:
    """The same expression in Python, for SQL."""
    low = pattern.lower()
    begins = r"^[^/]*//(?:[^/?#]*\.)?" if low.startswith("||") else "^" if low.startswith("|") else ""
    body = re.sub(r"[.+?$()\[\]{}\\|]", r"\\\g<0>", re.sub(r"^\|\|?|\|$", "", low))
    return "(?s)" + begins + body.replace("^", SEPARATOR).replace("*", ".*") + "$" * low.endswith("|")


ORACLE = rf"""
WITH split AS (
  SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN url ELSE '' END AS url,
         CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (SELECT rid, page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(substring(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM split),
urls AS (
  SELECT rid, page_id, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, path,
         translate(url, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS low
  FROM parts),
sites(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in SITE_RULES)}),
patterns(verdict, rule, regex) AS (VALUES {", ".join(f"('{v}', '{p}', '{regex_of(p)}')" for v, p in PATTERN_RULES)}),
fits AS (
  SELECT rid, 'site' AS kind, h || p AS rule, verdict FROM urls, sites WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  UNION ALL
  SELECT rid, 'pattern', rule, verdict FROM urls, patterns WHERE low <> '' AND regexp_matches(low, regex)),
decided AS (
  SELECT rid, count(*) AS n_matched,
         max({{'n': length(rule), 'rule': rule, 'verdict': verdict}}) FILTER (WHERE kind = 'site') AS site,
         max({{'allow': verdict = 'allow', 'n': length(rule), 'rule': rule, 'verdict': verdict}}) FILTER (WHERE kind = 'pattern') AS pattern
  FROM fits GROUP BY rid)
SELECT page_id, host, path, site.rule AS rule, coalesce(site.verdict, pattern.verdict, 'allow') AS verdict,
       CASE WHEN site IS NULL THEN pattern.rule END AS pattern, coalesce(n_matched, 0) AS n_matched
FROM urls LEFT JOIN decided USING (rid)
"""
