"""URL filters: rules looked up by their rarest literal token, then run as regular expressions.

A rule is a host and a path prefix (it fits the host, its subdomains, and paths that start with
the prefix), or a pattern. Each is a regular expression over `host + path` with literal tokens,
of which the one that fewest URLs of the table hold is its index key. URLs are cut into tokens,
tokens fetch candidate rules, and only those are run. Of the host rules that fit, the longest
decides (of equal ones the one with the longer host); without one, a fitting pattern blocks, and
everything else is allowed.

Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? or #.
A NULL url or one without :// has an empty host and path, fits no rule and is allowed. Page ids
may be NULL or repeated; each row is judged for itself. Other columns are not used.

All steps are DataFrame expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKENS = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """`host` and `path` for a host rule; `pattern` and `tokens` (whole tokens it needs) else."""

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    tokens: tuple[str, ...] = ()

    @property
    def text(self) -> str:
        return self.host + self.path if self.host else self.pattern

    @property
    def regex(self) -> str:
        """Over host, a line break, and path, so that neither part can run into the other."""
        if not self.host:
            return self.pattern
        return rf"^([^\n]*\.)?{re.escape(self.host)}\n{re.escape(self.path)}"

    @property
    def literals(self) -> tuple[str, ...]:
        """Tokens that every URL of the rule has. A path's last token may go on in the URL."""
        if not self.host:
            return self.tokens
        closed = self.path if not self.path[-1:].isalnum() else re.sub(r"[A-Za-z0-9]+$", "", self.path)
        # the path keeps its case; tokens are found in lower case on both sides
        return tuple(dict.fromkeys(re.findall(TOKENS, f"{self.host}/{closed}".lower())))


HOST_RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Patterns for what the host rules leave open: advert, tracking and click-counting addresses.
PATTERN_RULES = (
    Rule("block", pattern="^([^\n]*\\.)?ads\\.[^\n]+\n", tokens=("ads",)),
    Rule("block", pattern="^([^\n]*\\.)?adserver\\.[^\n]+\n", tokens=("adserver",)),
    Rule("block", pattern="^([^\n]*\\.)?casino\\.[^\n]+\n", tokens=("casino",)),
    Rule("block", pattern="\n(/[^\n]*)?/adserver/", tokens=("adserver",)),
    Rule("block", pattern="\n(/[^\n]*)?/banner/[0-9]+/", tokens=("banner",)),
    Rule("block", pattern="\n(/[^\n]*)?/click/track/", tokens=("click", "track")),
    Rule("block", pattern="\n(/[^\n]*)?/doorway/[^/\n]+/", tokens=("doorway",)),
)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """Host of a URL, empty without one."""
    found = F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"\A([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    """Path of a URL, empty without one."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"\A[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules: tuple[Rule, ...]) -> DataFrame:
    """rule number, verdict, text, regex, host size, is_host, literal tokens."""
    rows = [
        (i, r.verdict, r.text, r.regex, len(r.host), bool(r.host), list(r.literals))
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(
        rows, "rule_no int, verdict string, rule_text string, regex string, host_size int, "
        "is_host boolean, literals array<string>",
    )


def with_rarest_token(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule with the literal token that fewest URLs hold (the first by name among equals).

    `tokens` has a row per URL and different token; its counts combine before they are shuffled.
    """
    literals = rules.select("rule_no", F.explode("literals").alias("token"))
    counts = tokens.join(F.broadcast(literals.select("token").distinct()), "token").groupBy(
        "token").agg(F.count("*").alias("n"))
    rarest = (
        literals.join(counts, "token", "left")
        .groupBy("rule_no")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    return rules.join(rarest, "rule_no")


def judged(
    pages: DataFrame, host_rules: tuple[Rule, ...] = HOST_RULES,
    patterns: tuple[Rule, ...] = PATTERN_RULES,
) -> DataFrame:
    """Per row: page_id, host, path, rule (of the host rules), verdict.

    The index holds one row per given rule and becomes a literal map, so that no row moves.
    """
    spark = pages.sparkSession
    own = pages.select("page_id", F.col("url").alias("_u"))
    own = own.select("page_id", host(F.col("_u")).alias("host"), path(F.col("_u")).alias("path"))
    own = own.withColumn("place", F.concat("host", F.lit("\n"), "path"))
    words = F.array_distinct(F.regexp_extract_all(F.translate("place", UPPER, LOWER), F.lit(f"({TOKENS})")))
    own = own.withColumn("tokens", words)
    index = with_rarest_token(
        rule_table(spark, host_rules + patterns),
        own.select(F.explode("tokens").alias("token")),
    )
    fetched = F.flatten(F.transform("tokens", lambda t: F.coalesce(
        F.try_element_at(_literal(index), t), F.array().cast(RULES))))
    fits = F.filter(fetched, lambda r: F.regexp_like(F.col("place"), r["regex"]))
    best = F.array_max(F.transform(
        F.filter("fits", lambda r: r["is_host"]),
        lambda r: F.struct(
            F.length(r["rule_text"]).alias("size"), r["host_size"].alias("host_size"),
            r["rule_text"].alias("rule"), r["verdict"].alias("verdict"))))
    blocked = F.exists("fits", lambda r: ~r["is_host"] & (r["verdict"] == "block"))
    return (
        own.select("page_id", "host", "path", "place", fits.alias("fits"))
        .select("page_id", "host", "path", best.alias("best"), blocked.alias("blocked"))
        .select(
            "page_id", "host", "path", F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        )
    )


def _literal(index: DataFrame) -> Column:
    """The index as a map from token to the rules it fetches."""
    fields = ("rule_no", "verdict", "rule_text", "regex", "host_size", "is_host")
    by_token: dict[str, list[Column]] = {}
    for row in index.orderBy("rule_no").collect():
        fetched = F.struct(*(F.lit(row[x]).alias(x) for x in fields))
        by_token.setdefault(row.token, []).append(fetched)
    pairs = [x for token, rules in by_token.items() for x in (F.lit(token), F.array(*rules).cast(RULES))]
    return F.create_map(*pairs) if pairs else F.create_map().cast(f"map<string,{RULES}>")


RULES = (
    "array<struct<rule_no:int,verdict:string,rule_text:string,regex:string,host_size:int,"
    "is_host:boolean>>"
)
