"""URL filters: rules indexed by their rarest literal token.

A rule names a host (it and its subdomains), a path prefix, and a regular
expression that decides; its literal tokens are the words of the host (cut at dots
and hyphens) and the whole segments of the path prefix, or the tokens that its
pattern names. Token frequencies are counted over all URLs;
each rule is filed under its rarest token. A URL fetches the rules filed under its
own tokens, and only those run their regular expression. The longest fitting rule
decides; where none fits, the patterns of the default list decide (block if one
matches), else the URL is allowed. DataFrame functions only.

Defined results: a null URL, and one without `://`, has empty host and path and fits
no rule; of rules equally long the one that sorts first wins; repeated rows are
judged alike; an empty table stays empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockpulse.llm.scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BROADCAST_RULES = 100_000
ANY = ""                # token of rules without a literal: every URL fetches them


@dataclass(frozen=True)
class Rule:
    verdict: str        # allow or block
    host: str           # fits the host and its subdomains; empty: any host
    path: str           # fits paths that start with it
    pattern: str = ""   # further regular expression over host + path; empty: none
    default: bool = False   # only asked where no other rule fits
    literals: tuple = ()    # tokens that every url has that the pattern fits

    @property
    def name(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        if self.pattern:
            return self.pattern
        return rf"^(?:[^/]*\.)?{_quoted(self.host)}{_quoted(self.path) if self.path else '(?:/|$)'}"

    def tokens(self) -> list[str]:
        if self.literals:
            return list(self.literals)
        labels = re.split(r"[.-]", self.host)
        segments = self.path.split("/")[1:-1]     # only segments that end inside the prefix are whole
        return [t for t in labels + ["/" + s for s in segments if s] if t] or [ANY]


def _quoted(s: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)


# The rules of the production query, and the default patterns.
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]
DEFAULT_PATTERNS = [
    Rule("block", "", "", r"^(?:[^/]*[.-])?spam-farm\.", True, ("spam", "farm")),
    Rule("block", "", "", r"^(?:[^/]*[.-])?cheap-pills\.", True, ("cheap", "pills")),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    path = F.substring_index(F.substring_index(F.substr(rest, F.length(host) + 1), "?", 1), "#", 1)
    return F.translate(host, UPPER, LOWER), path


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct words of the host and `/segment`s, and the token every URL has."""
    labels = F.split(host, r"[.\-]")
    segments = F.transform(F.split(path, "/"), lambda s: F.concat(F.lit("/"), s))
    return F.array_distinct(F.concat(F.filter(F.concat(labels, segments), lambda t: ~t.isin("", "/")),
                                     F.array(F.lit(ANY))))


def judge_urls(pages: DataFrame, url_col: str, rules: list[Rule]) -> DataFrame:
    """(url, host, path, rule, verdict): one row per distinct url (null too)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("_url"))
    urls = (pages.select(F.col(url_col).alias("_url")).groupBy("_url").agg(F.count("*").alias("rows"))
            .withColumn("host", host).withColumn("path", path))
    urls = written(urls, "urls")
    given = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).cast("long").alias("id"), F.lit(r.verdict).alias("verdict"), F.lit(r.name).alias("name"),
                 F.lit(r.regex()).alias("regex"), F.lit(r.default).alias("default"), F.lit(t).alias("token"))
        for i, r in enumerate(rules) for t in r.tokens()])))
    small = len(rules) <= MAX_BROADCAST_RULES
    side = F.broadcast if small else (lambda x: x)
    fetched = urls.filter("host <> ''").select("_url", "host", "path", F.explode(url_tokens(F.col("host"), F.col("path")))
                                               .alias("token"))
    seen = urls.filter("host <> ''").select("rows", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    often = (seen.join(side(given.select("token").distinct()), "token", "left_semi")
             .groupBy("token").agg(F.sum("rows").alias("n")))
    rarest = (given.join(often, "token", "left")
              .groupBy("id", "verdict", "name", "regex", "default")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
              .select("id", "verdict", "name", "regex", "default", F.col("least.token").alias("token")))
    fits = (fetched.join(side(rarest), "token")
            .filter(F.expr("concat(host, path) rlike regex"))
            .groupBy("_url")
            .agg(F.max_by(F.struct("verdict", "name", "default"),
                          F.struct(~F.col("default"), F.length("name"), -F.col("id"))).alias("best")))
    out = urls.join(fits.withColumnRenamed("_url", "_fit"), F.col("_url").eqNullSafe(F.col("_fit")), "left")
    return out.select("_url", "host", "path",
                      F.when(~F.col("best.default"), F.col("best.name")).alias("rule"),
                      F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def filter_urls(pages: DataFrame, url_col: str = "url", rules: list[Rule] | None = None,
                keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of pages (all by default), host, path, rule, verdict."""
    rules = RULES + DEFAULT_PATTERNS if rules is None else rules
    keep = pages.columns if keep is None else keep
    judged = judge_urls(pages, url_col, rules)
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(url_col).alias("_row_url"))
    out = rows.join(judged, F.col("_row_url").eqNullSafe(F.col("_url")))
    names, taken = [], [c.lower() for c in keep]
    for c in ("host", "path", "rule", "verdict"):
        while c.lower() in taken:
            c += "_"
        names.append(c)
        taken.append(c.lower())
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
                      *[F.col(c).alias(n) for c, n in zip(("host", "path", "rule", "verdict"), names)])
