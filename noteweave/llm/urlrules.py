"""URL rules found by their rarest literal token, in DataFrame operations only.

A rule is a regular expression with the literal tokens (runs of letters and digits) that any url it fits must hold as
whole tokens.  It is indexed by the one that is rarest among the urls.  The tokens of a url fetch candidate
rules by an equality join, and only these run their expression.

Every distinct (host, path) is judged once and joined back, so a frequent url costs nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule tables up to this number of rows are broadcast.
SMALL = 20_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; of the fitting rules the highest ``rank`` wins, then the longest name."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0


def quoted(text: str) -> str:
    """The text as a literal of a Java regular expression."""
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text) if text.isascii() else r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def place_rule(verdict: str, place: str) -> Rule:
    """A rule ``host/path``: fits the host and its subdomains where the path starts with ``/path``."""
    host, slash, rest = place.partition("/")
    path = slash + rest
    # A token counts only where the rule itself ends it: the last one of the path may go on in the url.
    tokens = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", place) if path else []
    return Rule(place, verdict, r"^(?:[^/]*\.)?" + quoted(host) + quoted(path), tuple(dict.fromkeys(tokens)), rank=1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def indexed(rules: list[Rule], counts: dict[str, int]) -> list[tuple]:
    """(token, pattern, rank, length, name, verdict); a rule without tokens stands under the empty one."""
    return [
        (min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=""), rule.pattern, rule.rank, len(rule.name), rule.name, rule.verdict)
        for rule in rules
    ]


def judge(pages: DataFrame, rules: list[Rule], *, otherwise: str = "allow", page: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``pages``: page, host, path, rule, verdict, pattern.

    ``rule`` names the place rule (rank 1) that won, ``pattern`` any other rule that decided; both are null where none fits,
    and the verdict is then ``otherwise``.  A null url has an empty host and path.  Null and repeated pages get a row each; other columns are not read.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    split = pages.select(F.col(page).alias("page"), host.alias("host"), path.alias("path"))
    spark = pages.sparkSession
    tokens = F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit("[A-Za-z0-9]+"), F.lit(0)))
    places = split.select("host", "path").distinct()
    any_tokenless = any(not rule.tokens for rule in rules)
    listed = F.concat(tokens, F.array(F.lit(""))) if any_tokenless else tokens
    fetched = places.select("host", "path", F.explode(listed).alias("token"))

    def small(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= SMALL else df

    names = sorted({token for rule in rules for token in rule.tokens})
    counts: dict[str, int] = {}
    if any(len(rule.tokens) > 1 for rule in rules):
        asked = small(spark.createDataFrame([(n,) for n in names], "token string"), len(names))
        counts = {r["token"]: r["count"] for r in fetched.join(asked, "token").groupBy("token").count().collect()}  # one row per token of a rule
    table = spark.createDataFrame(indexed(rules, counts), "token string, regex string, rank int, length int, name string, verdict string")
    candidates = fetched.join(small(table, len(rules)), "token").where(F.expr("regexp_like(concat(host, path), regex)"))
    best = candidates.groupBy("host", "path").agg(F.max(F.struct("rank", "length", "name", "verdict")).alias("best"))
    judged = split.join(best, ["host", "path"], "left")
    return judged.select(
        F.col("page").alias(page),
        "host",
        "path",
        F.when(F.col("best.rank") == 1, F.col("best.name")).alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(otherwise)).alias("verdict"),
        F.when(F.col("best.rank") != 1, F.col("best.name")).alias("pattern"),
    )
