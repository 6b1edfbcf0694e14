"""URL filters: rules by host and path first, then trust and distrust carried over the graph of linked hosts.

Hosts of allowed pages are trusted seeds, hosts of blocked pages distrusted ones, in proportion to their pages.
Personalised PageRank spreads trust along links and distrust against them (who links to a blocked host is
suspect).  A page without a rule is blocked if its host's distrust is above ``threshold`` times its trust.

Scores are counts of seed pages, so their size does not depend on how many pages the table has; they are divided by
the two totals only where they are compared.  Rounds go on until one changes no score by more than ``TOLERANCE`` of
itself: a host reached for the first time is always a change, so every host that links lead to gets its score.

Only distinct host pairs are ranked, after pages were counted into them; each round is one join on the link's
source, pre-aggregated sums by target, and is written to the shared folder.  Built-in functions only.

A url that is null or has no ``://`` has an empty host and path, no rule and the verdict allow; null and empty html
has no links.  Repeated rows are judged row by row (and count as often as seeds).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.base import ascii_lower
from dataprobe.session import written

DAMPING = 0.85
THRESHOLD = 1.0
# a score is final when a round changes it by at most this share of itself
TOLERANCE = 1e-6
# sums in another order differ by less than this share: no difference when scores are compared
NOISE = 1e-12
# of the SQL version, which stops early and rounds: equal where no host links to another
ROUNDS = 20
DIGITS = 12
# up to so many rules are an expression inside the scan; longer lists are a table and a join
INLINE_RULES = 1000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _inline(rules: list[Rule]) -> Column:
    """The longest fitting rule as struct(size, rule, verdict), from the columns host and path."""
    fits = [
        F.when(
            ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path),
            F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def match_rules(parsed: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """``parsed(host, path, ...)`` with ``rule`` and ``ruled`` (block, allow or null).

    A list is matched inside the scan.  A table of rules (verdict, host, path) is met by the host's suffixes and by
    path prefixes of the lengths that rules have, for distinct (host, path) only.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) > INLINE_RULES:
            rules = parsed.sparkSession.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
        else:
            best = parsed.withColumn("_best", _inline(rules))
            return best.withColumns({"rule": F.col("_best.rule"), "ruled": F.col("_best.verdict")}).drop("_best")
    # distinct lengths of rule paths: bounded by the longest rule
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.struct(F.substring("path", 1, n).alias("p"), F.lit(n).alias("n")) for n in lengths]), lambda x: F.length(x["p"]) == x["n"])
    pairs = parsed.select("host", "path").distinct()
    asked = pairs.select("host", "path", F.explode(suffixes).alias("rule_host"), prefixes.alias("all")).select("host", "path", "rule_host", F.explode("all.p").alias("rule_path"))
    table = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    text = F.concat("rule_host", "rule_path")
    best = asked.join(table, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("size"), text.alias("rule"), F.col("verdict"))).alias("best"))
    return parsed.join(best, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "ruled": F.col("best.verdict")}).drop("best")


def host_links(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, links): distinct pairs of different hosts with the number of links between them."""
    # the targets of href and src attributes that name a host; relative links stay on theirs
    named = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)\s(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), F.lit(1))
    each = pages.select(F.col(host).alias("src"), F.explode(named).alias("to")).select("src", ascii_lower(F.col("to")).alias("dst"))
    return each.filter((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust) when no score changes any more (see ``TOLERANCE``), or after ``rounds`` rounds.

    ``seeds(host, trust, distrust)`` are amounts of any scale, which the scores share; ``links(src, dst, links)``.
    """
    # both directions as one graph of typed arcs: trust goes src -> dst, distrust dst -> src, by share of links
    out = links.groupBy("src").agg(F.sum("links").alias("all"))
    into = links.groupBy("dst").agg(F.sum("links").alias("all"))
    ahead = links.join(out, "src").select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("links") / F.col("all")).alias("share"), F.lit(True).alias("trusts"))
    back = links.join(into, "dst").select(F.col("dst").alias("at"), F.col("src").alias("to"), (F.col("links") / F.col("all")).alias("share"), F.lit(False).alias("trusts"))
    arcs = written(ahead.unionByName(back), "arcs")
    hosts = seeds.select("host").union(arcs.select("to")).union(arcs.select("at")).distinct()
    start = hosts.join(seeds, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("s"), F.coalesce("distrust", F.lit(0.0)).alias("d"))
    state = written(start.select("host", "s", "d", ((1 - damping) * F.col("s")).alias("trust"), ((1 - damping) * F.col("d")).alias("distrust")), "trust")
    for _ in count() if rounds is None else range(rounds):
        sent = arcs.join(state, arcs["at"] == state["host"]).select("to", *[F.when(F.col("trusts") == side, F.col("share") * F.col(c)).otherwise(0.0).alias(c) for side, c in ((True, "trust"), (False, "distrust"))])
        got = sent.groupBy(F.col("to").alias("host")).agg(F.sum("trust").alias("t"), F.sum("distrust").alias("u"))
        new = lambda base, more: (1 - damping) * F.col(base) + damping * F.coalesce(F.col(more), F.lit(0.0))
        after = state.join(got, "host", "left").select("host", "s", "d", new("s", "t").alias("trust"), new("d", "u").alias("distrust"), F.col("trust").alias("t0"), F.col("distrust").alias("u0"))
        after = written(after, "trust")
        differs = lambda now, old: F.abs(F.col(now) - F.col(old)) > TOLERANCE * F.col(now)
        moved = after.filter(differs("trust", "t0") | differs("distrust", "u0")).limit(1).count()
        state = after.select("host", "s", "d", "trust", "distrust")
        if not moved:
            break
    return state.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame = RULES, threshold: float = THRESHOLD, rounds: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, trust, distrust, verdict), one row per row of ``pages(page_id, url, html)``."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = match_rules(parsed.select("page_id", "host", "path"), rules)
    counted = written(
        ruled.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")), "hosts"
    )
    sums = counted.agg(F.greatest(F.sum("good"), F.lit(1)).alias("good"), F.greatest(F.sum("bad"), F.lit(1)).alias("bad"))
    goods, bads = sums.select("good").scalar(), sums.select("bad").scalar()
    seeds = counted.select("host", F.col("good").cast("double").alias("trust"), F.col("bad").cast("double").alias("distrust"))
    ranks = propagate(seeds, written(host_links(parsed), "links"), rounds=rounds)
    judged = ruled.join(ranks, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) / total for c, total in (("trust", goods), ("distrust", bads))})
    own = F.when(F.col("distrust") > threshold * (1 + NOISE) * F.col("trust"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", "trust", "distrust", F.coalesce("ruled", own).alias("verdict"))
