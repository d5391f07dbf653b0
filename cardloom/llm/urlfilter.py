"""URL filters: rules indexed by their rarest literal token, with built-in functions only.

Each rule is a regular expression with literal tokens. The corpus' counts of
those tokens say which is the rarest; a rule is filed under that one (one that
fits several ways is filed under a token for each way). A URL's tokens fetch
the rules filed under them, and only those rules' expressions run on the URL.
Rules without a literal token are in no index: they run on every distinct URL,
within its row.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import ascii_lower, fresh, literal_rows, nonempty

TOKEN_END = r"[^a-z0-9]+"
#: Rules at most that are broadcast; more are joined by shuffle.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host + path + query (A-Z lower-cased); of fitting rules the longest name wins.

    A URL that fits holds all of ``tokens``, and one of ``ways`` if there are any.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = ()
    base: bool = False
    ways: tuple[str, ...] = ()

    @classmethod
    def place(cls, host: str, path: str, verdict: str) -> Rule:
        """Fits the host and its subdomains if the path starts with ``path``."""
        literal = lambda s: re.sub(r"([.\\+*?\[\]^$(){}|/-])", r"\\\1", s)
        # a path's last token may go on in the URL, unless the rule closes it
        tokens = [*re.split(TOKEN_END, host), *re.split(TOKEN_END, path.lower())[: None if re.search(TOKEN_END + "$", path.lower()) else -1]]
        return cls(f"{host}{path}", verdict, rf"^([^/?#]*\.)?{literal(host)}{literal(path) or '(/|$)'}", tuple(t for t in tokens if t), True)

    @classmethod
    def wildcard(cls, text: str, verdict: str) -> Rule:
        """Fits URLs that hold ``text``: ``*`` is any run of signs, ``^`` one that isn't a letter or digit, or the end; ``||`` in front starts at a host's label."""
        at_host, body = text.startswith("||"), text.lower().removeprefix("||")
        pattern = "".join({"*": ".*", "^": "([^a-z0-9]|$)"}.get(c, c if c.isalnum() else f"\\{c}") for c in body)
        # a token counts if other signs close it on both sides
        padded = f"{'^' if at_host else '*'}{body}*"
        tokens = [m.group(1) for m in re.finditer(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])", padded)]
        return cls(text, verdict, (r"^([^/?#]*\.)?" if at_host else "") + pattern, tuple(dict.fromkeys(tokens)))


PLACES = (
    Rule.place("net", "/", "block"),
    Rule.place("example.net", "/en/", "allow"),
    Rule.place("example.com", "/de/", "block"),
    Rule.place("org", "/fr/", "allow"),
)
#: The method's own rules, for URLs that no place decides.
PATTERNS = (
    Rule("accounts", "block", r"/(login|signin|signup)(/|\.|\?|$)", ways=("login", "signin", "signup")),
    Rule("adserver", "block", r"^ads?[0-9]*\."),
    Rule("checkout", "block", r"/checkout(/|\?|$)", ("checkout",)),
    Rule("cgi", "block", r"/cgi-bin/", ("cgi", "bin")),
    *(Rule.wildcard(text, "block") for text in (
        "/wp-admin/", "/wp-login.", "/xmlrpc.", "/cart^", "/basket^", "/logout^", "/password/reset", "/feed/rss^", "/print^version^", "?replytocom=", "&sessionid=",
        "?utm_source=", "/calendar/*/day/", "/search?*&page=", "||doubleclick^", "||tracker^", "/affiliate/*/click",
    )),
)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(nonempty(F.split(text, TOKEN_END)))


def judge(
    df: DataFrame, url_col: str = "url", places: tuple[Rule, ...] = PLACES, patterns: tuple[Rule, ...] = PATTERNS,
    default: str = "allow",
) -> DataFrame:
    """``df`` with host, path, rule and verdict; columns of ``df`` with these names give way.

    rule: the longest place that fits (ties: the smaller name), else null.
    verdict: that rule's; else of the method's patterns that fit, the longest
    name's; else ``default``. Null urls and those without ``://`` have empty
    host and path, no rule and the default. Each distinct url is judged once
    and joined back, so repeated rows stay.
    """
    spark, rules = df.sparkSession, [*places, *patterns]
    df = df.drop("host", "path", "rule", "verdict")
    rest = F.coalesce(F.regexp_extract(F.col("url"), r"(?s)^.*?://[^/?#]*(.*)$", 1), F.lit(""))
    urls = df.select(F.col(url_col).alias("url")).filter("url is not null").distinct().withColumns({
        "host": host(F.col("url")), "path": path(F.col("url")), "rest": rest,
    }).filter("host <> '' or rest <> ''")
    own = _tokens(ascii_lower(F.concat("host", "rest")))
    sized = lambda rows, n: F.broadcast(rows) if n <= BROADCAST_RULES else rows
    literal = sorted({t for r in rules for t in (*r.tokens, *r.ways)})
    known = sized(literal_rows(spark, [(t,) for t in literal], "token string"), len(literal))
    counts = {r["token"]: r["n"] for r in urls.select(F.explode(own).alias("token")).join(known, "token").groupBy("token").agg(F.count("*").alias("n")).toLocalIterator()}
    row = lambda r: (r.name, r.verdict, r.pattern, r.base)
    n = lambda tokens: sum(counts.get(t, 0) for t in tokens)
    filed = [(t, *row(r)) for r in rules for t in min([(t,) for t in r.tokens] + [r.ways] * bool(r.ways), key=lambda x: (n(x), x), default=())]
    unfiled = [row(r) for r in rules if not r.tokens and not r.ways]
    index = sized(literal_rows(spark, filed, "token string, name string, verdict string, pattern string, base boolean"), len(filed))
    # a place looks at the path as it stands, a pattern at all that follows the host
    subject = lambda base: F.concat("host", F.when(base, F.col("path")).otherwise(ascii_lower(F.col("rest"))))
    fits = (
        urls.select("url", "host", "path", "rest", F.explode(own).alias("token")).join(index, "token")
        .filter(F.regexp_like(subject(F.col("base")), F.col("pattern"))).select("url", "name", "verdict", "base")
    )
    if unfiled:
        tried = F.filter(F.from_json(F.lit(json.dumps([dict(zip(("name", "verdict", "pattern", "base"), r)) for r in unfiled])), "array<struct<name string, verdict string, pattern string, base boolean>>"),
                         lambda r: F.regexp_like(subject(r["base"]), r["pattern"]))
        fits = fits.unionByName(urls.select("url", F.explode(tried).alias("r")).select("url", "r.name", "r.verdict", "r.base"))
    order = lambda base: F.when(F.col("base") == base, F.struct((-F.length("name")).alias("l"), "name", "verdict"))
    judged = fresh(df, "judged_url")
    best = fits.groupBy("url").agg(F.min(order(True)).alias("place"), F.min(order(False)).alias("pattern")).select(
        F.col("url").alias(judged), F.struct(F.col("place.name").alias("rule"), F.coalesce("place.verdict", "pattern.verdict").alias("verdict")).alias(fresh(df, "judgement"))
    )
    decided = F.col(fresh(df, "judgement"))
    columns = [df[f"`{c}`"] for c in df.columns]
    return df.join(best, df[url_col] == best[judged], "left").select(
        *columns, host(df[url_col]).alias("host"), path(df[url_col]).alias("path"), decided["rule"].alias("rule"), F.coalesce(decided["verdict"], F.lit(default)).alias("verdict"),
    )
