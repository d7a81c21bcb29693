"""URL filters: rules indexed by their rarest literal token; a URL's tokens fetch the rules that are then tried.

A rule has an action and either a host (it holds for subdomains too) with a path prefix, or a pattern with the literal
tokens that every match holds. Tokens are the runs of letters and digits of host and path, A-Z lower-cased. A rule whose
literals include no whole token is tried on every URL. Which token of a rule is rarest is counted over all URLs.

Of the rules that fit, host rules go before patterns, then the longer string, then the smaller one (a tie). Null urls and
urls without ``://`` have an empty host and path and are judged likewise; repeated rows are judged each on its own. Urls
that no rule fits have the default verdict. Very long urls are read whole. An empty table gives an empty result; columns
named host, path, rule, pattern or verdict are replaced, all others are carried, whatever their types and names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.shared import fresh, lookup, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More rules than so many don't go into one expression; they are joined by their token.
INLINE_RULES = 2000


@dataclass(frozen=True)
class Rule:
    """``host`` and ``path`` prefix, or ``pattern`` (on host + path) with its literal ``tokens``."""

    action: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    tokens: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return self.pattern or self.host + self.path

    @property
    def regex(self) -> str:
        if self.pattern:
            return self.pattern
        host = rf"(?s)^([^/]*\.)?{_quoted(self.host)}" if self.host else "(?s)^[^/]*"
        return host + (_quoted(self.path) if self.path else "(/|$)")

    @property
    def literals(self) -> tuple[str, ...]:
        if self.pattern:
            return self.tokens
        whole = self.host + (self.path if self.path.startswith("/") else "")
        runs = re.findall(r"[a-z0-9]+", whole.translate(str.maketrans(UPPER, LOWER)))
        if self.path and re.search(r"[A-Za-z0-9]$", self.path):
            runs = runs[:-1]  # a path prefix may end within a token
        return tuple(dict.fromkeys(runs))


def _quoted(x: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", x)


def parts(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """Add host and path of a URL column."""
    u = F.col(url)
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring({_name(url)}, instr({_name(url)}, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    h = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return df.withColumn(host, F.translate(h, UPPER, LOWER)).withColumn(path, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _tokens(host: str, path: str):
    return F.array_distinct(F.regexp_extract_all(F.translate(F.concat(host, path), UPPER, LOWER), F.lit("([a-z0-9]+)"), F.lit(1)))


def index(urls: DataFrame, tokens: str, rules: list[Rule]) -> dict[str | None, list[Rule]]:
    """Rules by their rarest literal token over the corpus (None: rules without one). What reaches the driver is one count for each of the rules' tokens."""
    known = sorted({t for r in rules for t in r.literals})
    seen: dict[str, int] = {}
    if known:
        counts = urls.select(F.explode(tokens).alias("token"))
        if len(known) <= 4 * INLINE_RULES:
            counts = counts.where(F.col("token").isin(known))
        counts = counts.groupBy("token").count()
        if len(known) > 4 * INLINE_RULES:
            counts = counts.join(urls.sparkSession.createDataFrame([(t,) for t in known], "token string"), "token", "left_semi")
        seen = {r["token"]: r["count"] for r in counts.collect()}
    by: dict[str | None, list[Rule]] = {}
    for r in rules:
        by.setdefault(min(r.literals, key=lambda t: (seen.get(t, 0), t), default=None), []).append(r)
    return by


_RULE = "struct<listed:boolean,name:string,action:string,regex:string>"


def judged(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with columns host, path, rule and pattern (null: none; at most one of them isn't) and verdict; columns of these names are replaced."""
    base = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "pattern", "verdict")]
    toks, best, site = fresh(pages, "_tok"), fresh(pages, "_best"), fresh(pages, "_site")
    df = pages.select(*base) if url in base else pages.select(*base, url)
    df = parts(df, url, "host", "path").withColumn(toks, _tokens("host", "path"))
    by = index(df, toks, rules)
    always = F.array(*[_literal(r) for r in by.pop(None, [])]).cast(f"array<{_RULE}>")
    if len(rules) <= INLINE_RULES:
        table = F.create_map(*[x for t, own in by.items() for x in (F.lit(t), F.array(*[_literal(r) for r in own]))]) if by else F.create_map()
        table = table.cast(f"map<string,array<{_RULE}>>")
        fetched = F.flatten(F.transform(toks, lambda t: F.coalesce(F.element_at(table, t), F.array().cast(f"array<{_RULE}>"))))
        df = df.withColumn(best, _first(F.concat(fetched, always), F.concat("host", "path")))
    else:
        # Each host and path once (the path starts with the first slash, so both are known from one string): its tokens
        # meet the rules in a join, a rule that fits is told from the others there, and the verdict goes to its rows.
        rows = [(t, not r.pattern, r.name, r.action, r.regex) for t, own in by.items() for r in own]
        listed = df.sparkSession.createDataFrame(rows, "token string, listed boolean, name string, action string, regex string")
        df = df.withColumn(site, F.concat("host", "path"))
        sites = df.groupBy(F.col(site).alias("site")).agg(F.count(F.lit(1)).alias("n"), F.first(toks).alias("toks"))
        met = sites.select("site", F.explode("toks").alias("token")).join(listed, "token").where("rlike(site, regex)")
        met = met.groupBy("site").agg(F.collect_set(F.struct("listed", "name", "action", "regex").cast(_RULE)).alias("fits"))
        none = F.array().cast(f"array<{_RULE}>")
        table = sites.join(met, "site", "left").select(F.col("site").alias(site), "n", _first(F.concat(F.coalesce("fits", none), always), F.col("site")).alias("best"))
        df = lookup(df, stored(table, "url-verdicts"), site, "n", df.count(), ["best"]).withColumnRenamed("best", best).drop(site)
    out = df.withColumn("rule", F.when(F.col(f"{best}.listed"), F.col(f"{best}.name")))
    out = out.withColumn("pattern", F.when(~F.col(f"{best}.listed"), F.col(f"{best}.name"))).withColumn("verdict", F.coalesce(F.col(f"{best}.action"), F.lit(default)))
    return out.drop(toks, best)


def _first(candidates, whole):
    """Of the candidate rules that fit, the one that goes before the others."""
    fits = F.filter(candidates, lambda r: F.call_function("rlike", whole, r["regex"]))
    return F.array_min(F.transform(fits, lambda r: F.struct((~r["listed"]).alias("later"), (-F.length(r["name"])).alias("n"), r["name"].alias("name"), r["listed"].alias("listed"), r["action"].alias("action"))))


def _literal(r: Rule):
    return F.struct(F.lit(not r.pattern).alias("listed"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.regex).alias("regex"))


#: The listed rules of the query.
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


#: The method's own rules: patterns on host and path, each with the tokens that a match holds.
PATTERNS = [
    *[Rule("block", pattern=rf"^([^/]*[.-])?{w}[.-]", tokens=(w,)) for w in ("casino", "pills", "viagra", "porn", "xxx", "betting", "spam", "torrent", "warez", "payday")],
    *[Rule("block", pattern=rf"/{w}(/|$)", tokens=(w,)) for w in ("login", "signup", "cart", "checkout", "search", "tag")],
    *[Rule("block", pattern=rf"\.{w}$", tokens=(w,)) for w in ("exe", "zip", "iso", "dmg", "apk")],
    Rule("block", pattern=r"/wp-(admin|login)", tokens=("wp",)),
    Rule("block", pattern=r"^ads?[0-9]*\."),
    Rule("allow", pattern=r"^([^/]*\.)?(gov|edu|ac)(\.[a-z][a-z])?(/|$)"),
]


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages, [*RULES, *PATTERNS]).select("page_id", "host", "path", "rule", "verdict", "pattern")


OP10_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, row_number() OVER () AS k, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(action, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
patterns AS (SELECT 'block' AS action, '^([^/]*[.-])?' || w || '[.-]' AS pattern FROM unnest(['casino', 'pills', 'viagra', 'porn', 'xxx', 'betting', 'spam', 'torrent', 'warez', 'payday']) AS t(w)
  UNION ALL SELECT 'block', '/' || w || '(/|$)' FROM unnest(['login', 'signup', 'cart', 'checkout', 'search', 'tag']) AS t(w)
  UNION ALL SELECT 'block', '\.' || w || '$' FROM unnest(['exe', 'zip', 'iso', 'dmg', 'apk']) AS t(w)
  UNION ALL VALUES ('block', '/wp-(admin|login)'), ('block', '^ads?[0-9]*\.'), ('allow', '^([^/]*\.)?(gov|edu|ac)(\.[a-z][a-z])?(/|$)')),
m AS (SELECT k, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY k ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS n
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
q AS (SELECT k, pattern, action, row_number() OVER (PARTITION BY k ORDER BY length(pattern) DESC, pattern) AS n FROM p JOIN patterns ON regexp_matches(host || path, pattern))
SELECT page_id, host, path, rule, coalesce(m.action, q.action, 'allow') AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM p LEFT JOIN (SELECT * FROM m WHERE n = 1) AS m USING (k) LEFT JOIN (SELECT * FROM q WHERE n = 1) AS q USING (k)
"""
