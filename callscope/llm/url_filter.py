"""URL filters: pattern rules indexed by their rarest literal token.

Each rule's pattern is a regular expression over ``host + path``. Of the literal
tokens that any match must hold as a whole, the one that the corpus has least
often indexes the rule. A URL's own tokens fetch the candidate rules from the
index, and only those run their expression; a rule without such a token runs on
every URL. The index is a literal of bounded size, so a URL is judged where it
is read, without a shuffle; more rules than it holds are a table, which distinct
URLs meet by token in a join.

Defined results: a null URL, or one without ``://``, has an empty host and path
and gets the default verdict unless a rule matches the empty string. Of several
matching rules the longest name wins, then the name first in order.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that one index may hold (it travels as a literal of the plan); more of them are joined as a table.
MAX_RULES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    name: str
    action: str  # allow or block
    pattern: str
    tokens: tuple[str, ...]  # literal tokens that any match holds as a whole
    ranked: bool = True  # a host and path rule: reported, and longest wins; else only a block hint


def host_path_rule(host: str, path: str, action: str) -> UrlRule:
    """Fits the host and its subdomains if the URL's path starts with ``path``."""
    # The last token of a path that doesn't end at a separator may go on in the URL.
    whole = re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", f"{path}") if path else []
    tokens = tuple(dict.fromkeys(re.findall(r"[a-z0-9]+", host) + [t for t in whole if re.search(rf"[^A-Za-z0-9]{re.escape(t)}[^A-Za-z0-9]", path)]))
    return UrlRule(host + path, action, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens)


def keyword_rule(name: str, pattern: str, *tokens: str) -> UrlRule:
    return UrlRule(name, "block", pattern, tokens, ranked=False)


#: Spam hosts by pattern. Their verdict counts where no host and path rule fits.
DEFAULT_KEYWORDS = (
    keyword_rule("spam-host", r"^[^/]*\bspam-[a-z]+\.", "spam"),
    keyword_rule("cheap-host", r"^[^/]*\bcheap-[a-z]+\.", "cheap"),
    keyword_rule("casino-host", r"^[^/]*\b(?:[a-z]+-)?casino(?:-[a-z]+)?\.", "casino"),
    keyword_rule("free-download-path", r"/free-download[-/]", "free", "download"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


RULE = "name string, action string, pattern string, tokens array<string>, ranked boolean"


def url_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def judge_urls_by_table(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``judge_urls`` with a table of rules (``RULE``) of any size: distinct URLs and rules meet by the rule's rarest token."""
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col("__url"))
    urls = pages.select(F.col(url_col).alias("__url")).distinct().withColumn("host", host).withColumn("path", path)
    # A rule without a token meets every URL, under the token ''; no URL has it unless such a rule is there.
    all_meet = not rules.where(F.coalesce(F.size("tokens"), F.lit(0)) < 1).isEmpty()
    tokens = url_tokens(F.concat("host", "path"))
    asked = urls.select("__url", F.concat("host", "path").alias("text"), F.explode(F.concat(tokens, F.array(F.lit(""))) if all_meet else tokens).alias("t"))
    own = rules.select("*", F.explode_outer("tokens").alias("t"))
    counts = asked.join(own.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min_by(F.coalesce("t", F.lit("")), F.struct(F.coalesce("n", F.lit(0)), "t")).alias("t")
    keyed = own.join(counts, "t", "left").groupBy("name", "action", "pattern", "ranked").agg(rarest)
    hits = asked.join(keyed, "t").where(F.rlike("text", F.col("pattern")))
    best = F.min(F.when(F.col("ranked"), F.struct((-F.length("name")).alias("n"), "name", "action"))).alias("best")
    found = hits.groupBy(F.col("__url").alias("__found")).agg(best, F.max(F.col("action") == "block").alias("blocked"))
    judged = urls.join(found, F.col("__url").eqNullSafe(F.col("__found")), "left").select(
        "__url", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.action", F.when(F.col("blocked"), "block").otherwise(default)).alias("verdict")
    )
    rows = pages.select(*keep, F.col(url_col).alias("__own"))
    return rows.join(judged, F.col("__own").eqNullSafe(F.col("__url")), "left").drop("__own", "__url")


def judge_urls(pages: DataFrame, rules: list[UrlRule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` in place of any columns so named."""
    if len(rules) > MAX_RULES:
        table = pages.sparkSession.createDataFrame([(r.name, r.action, r.pattern, list(r.tokens), r.ranked) for r in rules], RULE)
        return judge_urls_by_table(pages, table, url_col, default)
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col("__url"))
    urls = pages.select(*keep, F.col(url_col).alias("__url")).withColumn("host", host).withColumn("path", path)
    text = F.concat("host", "path")
    tokens = url_tokens(text)

    # How often the corpus has each token of the rules: as many rows as the rules have tokens.
    literal = sorted({t for r in rules for t in r.tokens})
    known = F.from_json(F.lit(json.dumps(literal)), "array<string>")
    seen = urls.select(F.explode(F.array_intersect(tokens, known)).alias("t")).groupBy("t").count() if literal else None
    count = {r["t"]: r["count"] for r in seen.collect()} if literal else {}
    index: dict[str, list[dict]] = {}
    for r in rules:
        key = min(r.tokens, key=lambda t: (count.get(t, 0), t), default="")
        index.setdefault(key, []).append({"name": r.name, "action": r.action, "pattern": r.pattern, "ranked": r.ranked})

    # Tokens hash to slots, so a lookup doesn't walk the whole index.
    n_slots = 1 << max(2, (len(index) * 2).bit_length())
    rows = pages.sparkSession.createDataFrame([(t,) for t in index] or [("",)], "t string").select("t", F.expr(f"cast(pmod(xxhash64(t), {n_slots}) as int)").alias("s")).collect()
    slots: list[list[dict]] = [[] for _ in range(n_slots)]
    for r in rows:
        slots[r["s"]] += [{"t": r["t"], **rule} for rule in index.get(r["t"], [])]
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<t:string,name:string,action:string,pattern:string,ranked:boolean>>>")
    fetched = F.flatten(
        F.transform(
            F.concat(tokens, F.array(F.lit(""))),
            lambda t: F.filter(F.get(table, F.pmod(F.xxhash64(t), F.lit(n_slots)).cast("int")), lambda r: r["t"] == t),
        )
    )
    urls = urls.withColumn("__hits", F.filter(fetched, lambda r: F.rlike(text, r["pattern"])))
    best = F.array_min(
        F.transform(F.filter("__hits", lambda r: r["ranked"]), lambda r: F.struct((-F.length(r["name"])).alias("n"), r["name"].alias("name"), r["action"].alias("action")))
    )
    return (
        urls.withColumn("__best", best)
        .withColumn("rule", F.col("__best.name"))
        .withColumn("verdict", F.coalesce(F.col("__best.action"), F.when(F.exists("__hits", lambda r: r["action"] == "block"), "block").otherwise(default)))
        .drop("__url", "__hits", "__best")
    )

