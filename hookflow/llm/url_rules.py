"""URL rules with redirect equivalence, in DataFrame operations only.

A rule names a host with its subdomains and the start of a path; the longest fitting rule decides. Redirects and canonical links
make pages aliases: URLs joined by them form components, and a block by rule of any member also holds for the members that no
rule decides. A page's own rule, an explicit allow above all, always comes first. Where neither speaks, a page is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookflow.llm.common import components, written

# (action, rule); a rule is host and path in one.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_CONTENT = r"""(?is)\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null and where there is no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def place(url: Column) -> Column:
    """What names a page: host, path and query, without scheme and fragment; null where there is no host."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host(url) != "", F.concat(host(url), path(url), F.coalesce(query, F.lit(""))))


def _attribute(tag: Column, pattern: str) -> Column:
    return F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))


def _absolute(target: Column, url: Column) -> Column:
    """A link as found on the page ``url``."""
    scheme = F.regexp_extract(url, r"^([^:/?#]*):", 1)
    root = F.concat(scheme, F.lit("://"), host(url))
    folder = F.regexp_extract(path(url), r"^(?:.*/)?", 0)
    return (
        F.when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target != "", F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """src, dst: canonical links and refresh redirects of pages, as urls. Pages without url or html have none."""
    canonical = F.regexp_extract("html", r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    refresh = F.regexp_extract("html", r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    moved = F.trim(F.regexp_extract(_attribute(refresh, _CONTENT), r"""(?is)\burl\s*=\s*["']?([^"']*)""", 1))
    url = F.col("url")
    links = pages.select(url, F.array(F.trim(_attribute(canonical, _HREF)), moved).alias("targets"))
    return links.select("url", F.explode(F.filter("targets", lambda t: t != "")).alias("target")).select(url.alias("src"), _absolute(F.col("target"), url).alias("dst"))


def rule_table(spark, rules=RULES) -> DataFrame:
    split = [(action, rule, *rule.partition("/")[::2]) for action, rule in rules]
    return spark.createDataFrame([(a, r, h, f"/{p}" if "/" in r else "") for a, r, h, p in split], "action string, rule string, rule_host string, rule_path string")


def by_rule(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, action of each distinct (host, path): its longest fitting rule, allow before block for equal ones; nulls where none fits."""
    distinct = places.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = distinct.select("host", "path", F.explode(ends).alias("rule_host")).join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    order = F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("allow"), "rule", "action")
    return fits.groupBy("host", "path").agg(F.max(order).alias("best")).select("host", "path", "best.rule", "best.action")


def judge(pages: DataFrame, links: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url); ``links`` are (src, dst) urls.

    Null urls and those without ``://`` have empty host and path, fit no rule and have no aliases, so they are allowed. Links with such an end say nothing.
    Targets that are no pages count as members. Repeated pages and links do no harm.
    """
    url = F.col("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"), place(url).alias("place"))
    decided = by_rule(rows, rules)
    found = rows.join(decided, ["host", "path"], "left")
    verdict = F.coalesce("action", F.lit("allow"))
    links = written(links.select(place(F.col("src")).alias("a"), F.col("src"), place(F.col("dst")).alias("b"), F.col("dst")).where("a <> b"), "links")
    if links.isEmpty():
        return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
    ends = links.select("a", "src").unionByName(links.select(F.col("b").alias("a"), F.col("dst").alias("src")))
    nodes = ends.groupBy("a").agg(F.min("src").alias("src")).select(F.col("a").alias("place"), host(F.col("src")).alias("host"), path(F.col("src")).alias("path"))
    # Numbers of nodes are fixed by being written.
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    numbers = nodes.select("place", "id")
    edges = links.join(numbers.toDF("a", "u"), "a").join(numbers.toDF("b", "v"), "b").select("u", "v")
    member = components(edges).join(nodes, "id").join(by_rule(nodes, rules), ["host", "path"], "left")
    blocked = member.where("action = 'block'").select("component").distinct()
    aliases = member.join(blocked, "component", "left_semi").select("place", F.lit("block").alias("spread"))
    return found.join(aliases, "place", "left").select("page_id", "host", "path", "rule", F.coalesce("action", "spread", F.lit("allow")).alias("verdict"))
