"""URL filters: rules indexed by their rarest literal token.

Every rule is a regular expression with the literal tokens that any match holds. How
often each of these occurs is counted over all urls, and the rule is filed under the
rarest. A url's tokens fetch their rules by a join, and only those run their
expression; a rule without a literal is filed under the empty token, which every url
has. Equal urls are judged once.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
path: from there up to ``?``, ``#`` or the end. A site rule fits its host and all
subdomains if the path starts with the rule's; the longest wins and gives the verdict
(at equal length the smaller rule string). Else the verdict is block if a word rule
fits, and allow otherwise.

Defined results: a null url, or one without ``://``, has empty host and path and fits
no rule: allow. Repeated pages keep their rows. Empty table: no rows. No rules: all
allowed. Other columns are ignored.
"""

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.sources.stage import stage

#: (host, path, verdict)
SITES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Words that block wherever they stand alone in host or path.
WORDS = ["casino", "poker", "porn", "xxx", "viagra", "torrent", "warez", "escort", "betting"]
_SPLIT = "[^0-9a-z]+"  # as the boundaries of a word rule


class Rule(NamedTuple):
    name: str
    pattern: str
    literals: list[str]
    verdict: str
    site: bool


def _tokens(s: str) -> list[str]:
    return [t for t in re.split(_SPLIT, s.lower()) if t]


def site_rule(host: str, path: str, verdict: str) -> Rule:
    # what follows the last token of the path may go on with it, unless the path ends with a delimiter
    whole = _tokens(path) if not path or not _tokens(path[-1]) else _tokens(path)[:-1]
    return Rule(host + path, rf"^(?:[^/]*\.)?\Q{host}\E" + (rf"\Q{path}\E" if path else "(?:/|$)"), _tokens(host) + whole, verdict, True)


def word_rule(word: str) -> Rule:
    return Rule(word, rf"(?<![0-9a-z])\Q{word}\E(?![0-9a-z])", _tokens(word), "block", False)


def parts(url):
    """(host, path) of a url column."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def filed(tokens: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rule index: each rule under the literal that the fewest urls have (column token of ``tokens``)."""
    spark = tokens.sparkSession
    literals = spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.literals})], "token string")
    count = {r["token"]: r["n"] for r in tokens.join(literals, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}  # one row per literal
    rows = [(min(r.literals, key=lambda t: (count.get(t, 0), t), default=""), r.name, r.pattern, r.verdict, r.site) for r in rules]
    return spark.createDataFrame(rows, "token string, rule string, pattern string, verdict string, site boolean")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", sites=SITES, words=WORDS) -> DataFrame:
    """One row per page: ``key``, ``host``, ``path``, ``rule`` (the site rule or null), ``word_rule`` (or null)
    and ``verdict``."""
    rules = [site_rule(*s) for s in sites] + [word_rule(w) for w in words]
    host, path = parts(F.col("url"))
    own = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    subject = F.concat(host, path)
    tokens = stage(own.where("url is not null").select("url").distinct().select("url", subject.alias("subject"))
                   .select("url", "subject", F.explode(F.array_union(F.array(F.lit("")), F.split(F.lower("subject"), _SPLIT))).alias("token")), "tokens")
    index = filed(tokens.select("token"), rules)
    fits = tokens.join(index, "token").where("if(site, subject, lower(subject)) rlike pattern")
    best = F.struct((-F.length("rule")).alias("n"), "rule", "verdict")
    judged = stage(fits.groupBy("url").agg(F.min(F.when(F.col("site"), best)).alias("best"), F.min(F.when(~F.col("site"), F.col("rule"))).alias("word_rule")), "judged")
    found = own.join(judged, "url", "left")
    verdict = F.coalesce("best.verdict", F.when(F.col("word_rule").isNotNull(), "block"), F.lit("allow"))
    return found.select(F.col("key").alias(key), host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), "word_rule", verdict.alias("verdict"))
