"""URL filters by link-graph propagation between hosts.

Explicit rules decide the urls they fit. For the others, trust flows from hosts whose urls the rules allow along the
graph's edges (personalised PageRank), and distrust from hosts whose urls they block against the edges: who links to a
blocked host is suspect. Each host's two scores are compared, and a url without a rule takes its host's verdict.

Edges are links between hosts, weighted by how many of a host's links go there, and edges both ways between each host
and the nearest known host it is a subdomain of, and its site (the last two labels, or three below suffixes such as
``co.uk``): a site vouches for its subdomains. Links to the host itself tell nothing and are left out.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discarded, free_name, written

#: Rules of the registered query: verdict, host and path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Share of a score that flows on, and the change of all scores at which rounds end.
DAMPING, ERROR = 0.85, 1e-3
#: Labels below which two-letter top domains register names, as far as one more label makes the site.
SHARED = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
#: Characters of a name at most, as DNS has it; longer ones have no hosts above them.
LONGEST = 253
#: A host is blocked if its distrust, less its trust, exceeds this share of the mean score.
THRESHOLD = 0.0
#: Rules that one expression may hold; more are joined with the urls instead, with the same result.
MOST_RULES = 2000


class Rule(NamedTuple):
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].translate(_LOWER)

    @property
    def path(self) -> str:
        slash = self.text.find("/")
        return self.text[slash:] if slash >= 0 else ""


_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(_UPPER, _LOW)


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOW), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (text, verdict) that fits, as a struct, or null.

    A rule fits its host and all subdomains if the path starts with the rule's. Of equally long ones the first counts.
    """
    best = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):  # the last one here is tested first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        best = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(best)
    return best


def with_rules(urls: DataFrame, rules: list[Rule], out: str) -> DataFrame:
    """``urls`` (with ``host`` and ``path``) with ``out``, the rule of ``rule_for``.

    Many rules are a table. A rule fits where its host is what follows the start or a dot of a url's host, and its path a
    prefix of the url's; so each distinct host and path looks its hosts above and its prefixes, of the lengths that rules
    have, up by equality. What is looked up is no longer than the longest rule, however long the url.
    """
    if len(rules) <= MOST_RULES:
        return urls.withColumn(out, rule_for(F.col("host"), F.col("path"), rules))
    listed = [(r.host, r.path, -len(r.text), k, r.text, r.verdict) for k, r in enumerate(rules)]
    table = urls.sparkSession.createDataFrame(listed, "rule_host string, rule_path string, shorter int, place int, text string, verdict string")
    longest, lengths = max(len(r.host) for r in rules), sorted({len(r.path) for r in rules})
    labels = F.split(F.substring("host", -(longest + 1), longest + 1), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    # The first of a cut host's pieces may begin within a label; only what follows its first dot counts.
    above = F.when(F.length("host") > longest + 1, F.slice(above, 2, F.size(above))).otherwise(above)
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    asked = urls.select("host", "path").distinct().withColumn("prefixes", prefixes).withColumn("rule_host", F.explode(above))
    # Hosts without rules leave before their paths' prefixes are looked up.
    asked = asked.join(table.select("rule_host").distinct(), "rule_host", "left_semi").withColumn("rule_path", F.explode("prefixes"))
    fits = asked.join(table, ["rule_host", "rule_path"]).groupBy(F.col("host").alias("of_host"), F.col("path").alias("of_path"))
    best = fits.agg(F.min_by(F.struct("text", "verdict"), F.struct("shorter", "place")).alias("best_rule"))
    joined = urls.join(best, (urls["host"] == best["of_host"]) & (urls["path"] == best["of_path"]), "left")
    return joined.select(*[urls[f"`{c}`"] for c in urls.columns if c != out], F.col("best_rule").alias(out))


def link_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """Links between hosts, (a, b, weight): absolute ``href`` targets in the html of pages of host ``host``."""
    pattern = r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""
    target = F.explode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))).alias("target")
    found = pages.select(F.col("host").alias("a"), target)
    full = F.when(F.col("target").startswith("//"), F.concat(F.lit("http:"), "target")).otherwise(F.col("target"))
    return found.select("a", host(full).alias("b")).filter("a <> b and a <> '' and b <> ''").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def name_of(host: Column) -> Column:
    """A host without user and port; addresses of four numbers have no name (null), nor has what exceeds DNS."""
    name = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":\d*$", "")
    return F.when((F.length(name) <= LONGEST) & ~F.regexp_like(name, F.lit(r"^\d+\.\d+\.\d+\.\d+$")), name)


def site(name: Column) -> Column:
    """The last two labels, or three below a shared suffix of a two-letter top domain."""
    labels = F.split(name, r"\.")
    deep = (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SHARED)
    return F.when(deep, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def site_edges(hosts: DataFrame) -> DataFrame:
    """From each host to the nearest known host above its name and to its site, and back.

    The bare name is above a host with user or port. A name has 127 labels at most, so a host looks for that many.
    """
    named = hosts.select(F.col("host").alias("a"), name_of(F.col("host")).alias("name")).filter("name is not null")
    labels = F.split("name", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    up = named.select("a", F.posexplode(above).alias("far", "b")).filter("a <> b")
    up = up.join(hosts.select(F.col("host").alias("b")), "b", "left_semi").groupBy("a").agg(F.min_by("b", "far").alias("b"))
    pairs = up.unionByName(named.filter(F.instr("name", ".") > 0).select("a", site(F.col("name")).alias("b"))).filter("a <> b").distinct()
    return pairs.union(pairs.select("b", "a")).select("a", "b", F.lit(1.0).alias("weight")).distinct()


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, error: float = ERROR) -> DataFrame:
    """``host, trust, distrust`` of every host in ``edges`` (a, b, weight) or ``seeds`` (host, trust, distrust).

    Seeds' scores are scaled to sum to 1 each, if any is positive. Per round, a host passes the damped share of its
    score along its edges by weight (trust forward, distrust backward); the rest, and what hosts without such edges
    hold, returns to the seeds. One round is one join on the sending host and one sum by the receiving host, both for
    trust and distrust at once; it is written, so that the plan stays short. Sums are combined before the shuffle, and
    a host with very many edges is a skewed join key, which adaptive execution splits. Each round shrinks the change by
    ``damping`` at least, so it falls to ``error`` after a number of rounds that the two fix.
    """
    out = edges.groupBy("a").agg(F.sum("weight").alias("all"))
    into = edges.groupBy("b").agg(F.sum("weight").alias("all"))
    forward = edges.join(out, "a").select(F.lit("trust").alias("kind"), F.col("a").alias("sender"), F.col("b").alias("host"), (F.col("weight") / F.col("all")).alias("share"))
    backward = edges.join(into, "b").select(F.lit("distrust").alias("kind"), F.col("b").alias("sender"), F.col("a").alias("host"), (F.col("weight") / F.col("all")).alias("share"))
    flow = written(forward.unionByName(backward), "rank-edges")
    sums = seeds.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    scaled = lambda kind: F.col(kind) / F.lit(float(sums[kind] or 1) or 1.0)
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), scaled("trust").alias("seed")), F.struct(F.lit("distrust").alias("kind"), scaled("distrust").alias("seed")))).alias("s")).select("host", "s.kind", "s.seed")
    start = written(start.filter("seed > 0"), "rank-seeds")
    scores = start.select("host", "kind", F.col("seed").alias("score"))
    last = None
    for _ in range(math.ceil(math.log(error / 4) / math.log(damping)) + 1):  # two kinds, each changes by 2 at most
        sent = flow.join(scores.select(F.col("host").alias("sender"), "kind", "score"), ["kind", "sender"]).select("kind", "host", (F.col("share") * F.col("score") * damping).alias("score"), F.lit(0.0).alias("seed"), F.lit(0.0).alias("before"))
        seeded = start.select("kind", "host", F.lit(0.0).alias("score"), "seed", F.lit(0.0).alias("before"))
        old = scores.select("kind", "host", F.lit(0.0).alias("score"), F.lit(0.0).alias("seed"), F.col("score").alias("before"))
        summed = sent.unionByName(seeded).unionByName(old).groupBy("kind", "host").agg(F.sum("score").alias("flown"), F.sum("seed").alias("seed"), F.sum("before").alias("before"))
        summed = written(summed, "rank-round")
        if last is not None:
            discarded(last)
        last = summed
        left = {r["kind"]: 1.0 - r["flown"] for r in summed.groupBy("kind").agg(F.sum("flown").alias("flown")).collect()}
        back = F.when(F.col("kind") == "trust", F.lit(left.get("trust", 0.0))).otherwise(F.lit(left.get("distrust", 0.0)))
        now = summed.select("host", "kind", (F.col("flown") + back * F.col("seed")).alias("score"), "before")
        change = now.agg(F.sum(F.abs(F.col("score") - F.col("before"))).alias("change")).first()["change"] or 0.0
        scores = now.select("host", "kind", "score")
        if change <= error:
            break
    hosts = edges.select(F.col("a").alias("host")).union(edges.select("b")).union(seeds.select("host")).distinct()
    by_kind = scores.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score"))).alias(k) for k in ("trust", "distrust")])
    return hosts.join(by_kind, "host", "left").select("host", *[F.round(F.coalesce(k, F.lit(0.0)), 12).alias(k) for k in ("trust", "distrust")])


def judged(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``pages``'s columns (or those in ``keep``) with ``host, path, rule, verdict, trust, distrust``.

    Null urls and urls without ``://`` have an empty host, which takes no part in the graph: without a rule they are
    allowed. A null html has no links. Seeds are the shares of a host's urls that rules allow or block. Repeated rows
    are judged alike, an empty table gives an empty result, and columns that bear a result's name are replaced.
    """
    results = {"host", "path", "rule", "verdict", "trust", "distrust"}
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() not in results]
    held, of, trusted, distrusted = (free_name(pages.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(0).alias(r) for r in sorted(results)]), stem) for stem in ("rule_found", "of_host", "of_trust", "of_distrust"))
    parts = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "html")
    found = with_rules(parts, rules, "found")
    by_host = found.filter("host <> ''").groupBy("host").agg(
        *[F.avg(F.when(F.col("found.verdict") == v, 1.0).otherwise(0.0)).alias(k) for v, k in (("allow", "trust"), ("block", "distrust"))]
    )
    by_host = written(by_host, "rank-hosts")
    edges = link_edges(found).unionByName(site_edges(by_host.select("host"))).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    scores = propagated(written(edges, "rank-graph"), by_host)
    mean = 1.0 / max(1, by_host.count())
    verdicts = scores.select(F.col("host").alias(of), F.col("trust").alias(trusted), F.col("distrust").alias(distrusted))
    out = with_rules(pages.select(*[F.col(f"`{c}`") for c in kept], host(F.col(url)).alias("host"), path(F.col(url)).alias("path")), rules, held)
    out = out.join(verdicts, out["host"] == verdicts[of], "left")
    suspect = F.coalesce(F.col(distrusted) - F.col(trusted), F.lit(0.0)) > threshold * mean
    verdict = F.coalesce(F.col(f"{held}.verdict"), F.when(suspect, "block").otherwise("allow"))
    return out.select(
        *[F.col(f"`{c}`") for c in kept], "host", "path", F.col(f"{held}.text").alias("rule"), verdict.alias("verdict"),
        F.coalesce(trusted, F.lit(0.0)).alias("trust"), F.coalesce(distrusted, F.lit(0.0)).alias("distrust"),
    )
