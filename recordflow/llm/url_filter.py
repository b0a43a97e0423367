"""URL filters: rules by host and path, block decisions passed on to redirect and canonical aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm.graph import components
from recordflow.runtime import cut_lineage

# (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
MAX_RULES = 100_000  # rules are configuration: they are compiled into the plan

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"""(?is)<(?:link|meta)\b(?:[^>"']|"[^"]*"|'[^']*')*+>"""
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_REFRESH = r"""(?is)\burl\s*=\s*["']?([^"'>\s]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), or null; of equal rules an allow wins.

    A host is looked up by itself and each of its parents in one map of all rules.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules are more than {MAX_RULES}")
    by_host: dict[str, list] = {}
    for verdict, rule_host, rule_path in rules:
        by_host.setdefault(rule_host, []).append(F.struct(
            F.lit(len(rule_host + rule_path)).alias("size"), F.lit(verdict != "block").alias("allows"),
            F.lit(verdict).alias("verdict"), F.lit(rule_path).alias("path"), F.lit(rule_host + rule_path).alias("rule")))
    if not by_host:
        return F.lit(None).cast("struct<verdict:string,rule:string>")
    known = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*found))])
    labels = F.split(host, r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(
        F.flatten(F.filter(F.transform(parents, lambda h: F.try_element_at(known, h)), lambda r: r.isNotNull())),
        lambda r: path.startswith(r["path"]))
    best = F.array_max(fitting)
    return F.when(best.isNotNull(), F.struct(best["verdict"].alias("verdict"), best["rule"].alias("rule")))


def node_of(url: Column) -> Column:
    """The URL as a node: without fragment, scheme and host lower-cased, an empty path as ``/``."""
    plain = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    head = F.regexp_extract(plain, r"(?s)^([^/?]*://[^/?]*)", 1)
    rest = F.substring(plain, F.length(head) + 1, F.length(plain))
    return F.concat(F.translate(head, _UPPER, _LOWER), F.when((head != "") & ~rest.startswith("/"), F.concat(F.lit("/"), rest)).otherwise(rest))


def _resolved(base: Column, href: Column) -> Column:
    root = F.regexp_extract(base, r"(?s)^([^/?#]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^([^/?#]*:)//", 1)
    whole = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    folder = F.when(F.length(whole) > F.length(root), F.regexp_extract(whole, r"(?s)^(.*/)", 1)).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(whole, href))
        .otherwise(F.concat(folder, href)))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's node and that of its canonical link or of the page it refreshes to.

    Only tags ``link rel=canonical`` and ``meta http-equiv=refresh`` with a target count; relative
    targets are taken against the page's URL. Null URLs and texts give no edges.
    """
    body = F.col(html).cast("string")
    tag = F.col("tag")
    href = F.regexp_replace(F.concat(*[F.regexp_extract(tag, _HREF, k) for k in (1, 2, 3)]), "&amp;", "&")
    jump = F.regexp_replace(F.regexp_extract(tag, _REFRESH, 1), "&amp;", "&")
    target = (
        F.when(tag.rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""), href)
        .when(tag.rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b"""), jump))
    tags = cut_lineage(
        pages.where(F.col(url).contains("://") & body.rlike("(?i)canonical|refresh"))
        .select(F.col(url).alias("base"), F.explode(F.regexp_extract_all(body, F.lit(_TAG), F.lit(0))).alias("tag"))
        .where(F.col("tag").rlike("(?i)canonical|refresh")), "tags")
    links = cut_lineage(tags.select("base", F.trim(target).alias("href")).where(F.length("href") > 0), "links")
    whole = cut_lineage(links.select("base", _resolved(F.col("base"), F.col("href")).alias("target")), "targets")
    return whole.select(node_of(F.col("base")).alias("a"), node_of(F.col("target")).alias("b"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, alias_class.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins and
    settles the verdict. Pages without a rule take the decision of their aliases: classes are the
    connected components over redirect and canonical edges, targets that are no pages included. A
    class with a blocked member and without an allowed one is blocked; an explicit allow takes
    precedence, and without either the page is allowed. ``alias_class`` is the class's smallest URL,
    null outside classes. Null URLs have empty host and path and are allowed. Repeated rows are judged
    alike, an empty table gives no rows, other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    judged = rows.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    classes = components(alias_edges(rows), "a", "b")
    node_host, node_path = host_and_path(F.col("node"))
    hit = rule_of(node_host, node_path, rules)["verdict"]
    decided = classes.withColumn("said", hit).groupBy("component").agg(
        F.max((F.col("said") == "block").cast("int")).alias("blocks"), F.max((F.col("said") == "allow").cast("int")).alias("allows"))
    members = cut_lineage(classes.join(decided, "component").select(
        "node", "component", ((F.coalesce("blocks", F.lit(0)) == 1) & (F.coalesce("allows", F.lit(0)) == 0)).alias("blocked")), "aliases")
    known = judged.withColumn("at", node_of(F.col("url")))
    return known.join(members, F.col("at") == F.col("node"), "left").select(
        "page_id", "host", "path", F.col("hit")["rule"].alias("rule"),
        F.coalesce(F.col("hit")["verdict"], F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("component").alias("alias_class"))
