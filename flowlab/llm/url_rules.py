"""URL verdicts from pattern rules indexed by their rarest literal token.

Every rule is a regular expression with literal tokens that any URL it fits
must hold.  How many URLs hold a token is counted over the whole table, each
rule is filed under its rarest token, a URL's tokens fetch candidate rules by
a join, and only those run their expression.  A rule without a token is
filed under the empty token, which every URL has.

Host rules (``host`` and all subdomains, path prefix) come before pattern
rules; among host rules the longest wins, then ``block``, then the text.

Defined results: null, empty and malformed URLs have an empty host and path
and get the default verdict; repeated rows each get their row; a rule path
such as ``/en`` also fits ``/english``; columns of the pages named like the
added ones are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.text import fresh, quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RESULT = ["host", "path", "rule", "pattern", "verdict"]


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def row(self) -> tuple:
        end = self.path if self.path else r"(?:/|\z)"
        regex = r"\A(?:[^/]*\.)?" + _quoted(self.host) + (_quoted(end) if self.path else end)
        tokens = re.split(_SEPARATOR, self.host) + re.split(_SEPARATOR, self.path)[: -1 if self.path else None]
        return 1, len(self.name), self.name, regex, self.verdict, sorted({t for t in tokens if t} or {""})


@dataclass(frozen=True)
class PatternRule:
    """Fits where ``regex`` is found in host + path; ``tokens`` are whole tokens of any such URL."""
    name: str
    regex: str
    tokens: tuple[str, ...]
    verdict: str

    def row(self) -> tuple:
        return 0, len(self.name), self.name, self.regex, self.verdict, sorted(set(self.tokens) or {""})


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/-_" else f"\\x{{{ord(c):x}}}" for c in text)


#: Words that name a block-listed kind of host.
BAD_HOST_WORDS = ["adult", "bets", "casino", "malware", "phishing", "porn", "spam", "warez", "xxx"]
PATTERNS = [PatternRule(w, rf"\A[^/]*(?<![0-9a-z]){w}(?![0-9a-z])[^/]*(?:/|\z)", (w,), "block") for w in BAD_HOST_WORDS]


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: list[HostRule | PatternRule], default: str = "allow") -> DataFrame:
    """``pages`` (needs ``url``) with RESULT columns."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    pages = pages.drop(*RESULT).withColumns({"host": host, "path": path})
    table = spark.createDataFrame([r.row() for r in rules], "tier int, long int, name string, regex string, verdict string, tokens array<string>")

    target = F.concat("host", "path")
    urls = pages.select(target.alias("target")).distinct()
    url_tokens = urls.select("target", F.explode(F.array_distinct(F.concat(F.split("target", _SEPARATOR), F.array(F.lit(""))))).alias("token"))
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    frequency = url_tokens.join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    index = (table.select("tier", "long", "name", "regex", "verdict", F.explode("tokens").alias("token"))
             .join(frequency, "token", "left")
             .groupBy("tier", "long", "name", "regex", "verdict")
             .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")))

    best = (url_tokens.join(index, "token")
            .filter(F.expr("regexp_like(target, regex)"))
            .groupBy("target")
            .agg(F.max(F.struct("tier", "long", (F.col("verdict") == "block").alias("stops"), "name", "verdict")).alias("best")))
    rule, key = fresh(pages.columns, "best_rule"), fresh(pages.columns, "target")
    judged = pages.join(best.select(F.col("best").alias(rule), F.col("target").alias(key)), target == F.col(key), "left")
    found = F.col(rule)
    return judged.select(
        *quoted(pages.columns),
        F.when(found["tier"] == 1, found["name"]).alias("rule"),
        F.when(found["tier"] == 0, found["name"]).alias("pattern"),
        F.coalesce(found["verdict"], F.lit(default)).alias("verdict"))
