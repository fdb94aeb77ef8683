"""URL filters: pattern rules indexed by their rarest literal token.

A rule is written host-suffix + path-prefix, as in ``example.com/en/7``. It fits the host
and all its subdomains when the url's path starts with the rule's path. Every rule is filed
under the one of its literal tokens (host labels, whole path segments) that the fewest urls
hold, counted over the whole table. A url's own tokens fetch candidate rules from that index
and only those candidates run their regular expression, so a url that meets no rare token
runs none. A list of up to LITERAL rules travels inside the plan and the lookup is row-local.
A longer one is a table: the urls' tokens are joined with the rules' rarest tokens, and only
what is left of that, rows and candidate rules, comes back to the urls. Both ways give the
same rows.

Cases: a null url or one without ``://`` has an empty host and path and fits no rule that
names a host; repeated rows are judged one by one, and repeated rules count once; of several
fitting rules the longest text wins, at equal length block before allow, then the smaller
text. Rules without any token are candidates of every url with a host. An empty table gives
an empty result, an empty list the default. Urls are read whole. Input columns other than the
url pass through unless a result column has the same name, which then replaces it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, written

#: Rules that travel inside the plan; a longer list is joined.
LITERAL = 256
#: Tokens or rules of a few dozen bytes that are broadcast; more of them are shuffled.
BROADCAST = 200_000
_RULE = "struct<size:int,verdict:string,text:string,regex:string>"


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "".join(self.text.partition("/")[1:])

    @property
    def tokens(self) -> list[str]:
        """Tokens that every fitting url holds; a path's last segment may go on, so it is none."""
        labels = [f"h:{x}" for x in self.host.split(".") if x]
        return sorted({*labels, *(f"p:{x}" for x in self.path.split("/")[1:-1] if x)})

    @property
    def regex(self) -> str:
        subdomain = r"(?:[^/]*\.)?" if self.host else "[^/]*"
        return f"^{subdomain}{_quoted(self.host)}{_quoted(self.path)}" + ("" if self.path else "(?:/|$)")


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", text)


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\.", -1), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/", -1), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def token_counts(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> dict[str, int]:
    """Urls of the whole table that hold each token of the rules: as many rows as the rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    tokens = url_tokens(url_host(F.col(f"`{url}`")), url_path(F.col(f"`{url}`")))
    if len(rules) <= LITERAL:
        held = pages.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, wanted)))).alias("token"))
    else:
        table = pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
        held = pages.select(F.explode(tokens).alias("token")).join(F.broadcast(table) if len(wanted) <= BROADCAST else table, "token", "left_semi")
    return {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}


def rule_index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; rules without any are filed under the empty token."""
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(rarest, []).append(rule)
    return index


def _entry(r: Rule) -> Column:
    return F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("text"), F.lit(r.regex).alias("regex"))


def _best(fits: Column) -> Column:
    """Of fitting rules the longest, then one that blocks, then the smaller text."""
    def before(x: Column, y: Column) -> Column:
        return (
            F.when(x["size"] != y["size"], x["size"] > y["size"]).when(x["verdict"] != y["verdict"], x["verdict"] == "block").otherwise(x["text"] < y["text"])
        )

    return F.aggregate(fits, F.lit(None).cast(_RULE), lambda a, x: F.when(a.isNull() | before(x, a), x).otherwise(a))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict, and n_candidates, the regular expressions that were run."""
    rules = list(dict.fromkeys(rules))
    index = rule_index(rules, token_counts(pages, rules, url))
    none = F.array().cast(f"array<{_RULE}>")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "n_candidates")]
    out = pages.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)), url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    asked = F.concat(url_tokens(F.col("host"), F.col("path")), F.array(F.lit("")))
    whole = F.concat("host", "path")
    if len(rules) > LITERAL:
        out = written(out.withColumn("row", F.monotonically_increasing_id()), "urls")
        rows = [(t, len(r.text), r.verdict, r.text, r.regex) for t, rs in index.items() for r in rs]
        table = out.sparkSession.createDataFrame(rows, "token string, size int, verdict string, text string, regex string")
        met = out.where("host <> ''").select("row", whole.alias("whole"), F.explode(asked).alias("token")).join(F.broadcast(table) if len(rows) <= BROADCAST else table, "token")
        fits = F.collect_list(F.when(F.rlike("whole", F.col("regex")), F.struct("size", "verdict", "text", "regex")))
        met = met.groupBy("row").agg(_best(fits).alias("_best"), F.count(F.lit(1)).alias("_n"))
        out = out.join(met, "row", "left")
    else:
        found = none
        if index:
            lists = F.create_map(*(x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(_entry, rs)))))
            found = F.flatten(F.transform(F.filter(asked, lambda t: t.isin(*index)), lambda t: F.element_at(lists, t)))
        out = out.withColumn("_found", F.when(F.col("host") != "", found).otherwise(none))
        out = out.withColumns({"_best": _best(F.filter("_found", lambda r: F.rlike(whole, r["regex"]))), "_n": F.size("_found")})
    return out.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)), "host", "path", F.col("_best.text").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"), F.coalesce(F.col("_n").cast("int"), F.lit(0)).alias("n_candidates"),
    )
