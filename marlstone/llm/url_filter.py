"""URL rules with redirect equivalence. DataFrame and SQL functions only.

A rule is a host and a path prefix; it fits its host and all subdomains, and
the longest fitting rule decides. URLs that redirect to each other or name
each other as canonical are aliases: the connected components over these edges
carry a block to every member that no rule decides. A rule that allows a URL
takes precedence over a block of an alias.

Defined results: a null url or one without ``://`` has empty host and path,
fits no rule and is allowed; null html has no links; repeated pages are judged
each; empty pages or rules give no rows or no rules; other columns are not
read; of equally long fitting rules the longer host wins, then allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import local_table, maybe_broadcast, written
from marlstone.llm.graph import connected_components

#: Rules up to this number become a literal of the plan; more are joined by host.
LITERAL_RULES = 1000


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    after = F.substring_index(_after_scheme(url), "/", 1)
    host = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    at = F.instr(rest, "/")
    return F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise(F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host itself and every parent domain."""
    labels = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def split_rule(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host.lower(), "/" + path


def rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules ``(verdict, "host/path")`` as a table of host, path, rule, verdict."""
    return local_table(spark, [(*split_rule(r), r, v) for v, r in rules], "host string, path string, rule string, verdict string")


def _rank(rule: Column, host: Column, verdict: Column) -> list[Column]:
    return [F.length(rule).alias("n"), F.length(host).alias("h"), (verdict == "allow").alias("allow"), rule.alias("rule"), verdict.alias("verdict")]


def with_rule(urls: DataFrame, rules: list[tuple[str, str]] | DataFrame, url_col: str = "url") -> DataFrame:
    """Add host, path, rule and rule_verdict (null where no rule fits) to distinct-named columns of ``urls``."""
    urls = urls.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    if isinstance(rules, list) and len(rules) <= LITERAL_RULES:
        if not rules:
            return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("rule_verdict", F.lit(None).cast("string"))
        by_host: dict[str, list[Column]] = {}
        for verdict, rule in rules:
            host, path = split_rule(rule)
            by_host.setdefault(host, []).append(F.struct(F.lit(path).alias("path"), *_rank(F.lit(rule), F.lit(host), F.lit(verdict))))
        known = F.create_map(*(c for host, some in by_host.items() for c in (F.lit(host), F.array(*some))))
        hosts = F.filter(host_suffixes(F.col("host")), lambda h: h.isin(list(by_host)))
        fitting = F.filter(F.flatten(F.transform(hosts, lambda h: F.element_at(known, h))), lambda r: F.startswith(F.col("path"), r["path"]))
        best = F.array_max(F.transform(fitting, lambda r: F.struct(r["n"], r["h"], r["allow"], r["rule"], r["verdict"])))
        return urls.withColumn("_best", best).withColumn("rule", F.col("_best.rule")).withColumn("rule_verdict", F.col("_best.verdict")).drop("_best")
    table = rule_table(urls.sparkSession, rules) if isinstance(rules, list) else rules
    table = table.select(F.col("host").alias("_host"), F.struct(*_rank(F.col("rule"), F.col("host"), F.col("verdict"))).alias("_rank"), F.col("path").alias("_path"))
    places = urls.select("host", "path").distinct()
    found = places.withColumn("_host", F.explode(host_suffixes(F.col("host")))).join(maybe_broadcast(table), "_host").where(F.startswith("path", "_path"))
    best = found.groupBy("host", "path").agg(F.max("_rank").alias("_best"))
    out = urls.join(best, ["host", "path"], "left").withColumn("rule", F.col("_best.rule")).withColumn("rule_verdict", F.col("_best.verdict")).drop("_best")
    return out.select(*urls.columns, "rule", "rule_verdict")


def _absolute(target: Column, base: Column) -> Column:
    """A link's target as an absolute URL without fragment."""
    target = F.trim(F.regexp_replace(target, "&amp;", "&"))
    site = F.regexp_extract(base, "^([^:/?#]+://[^/?#]*)", 1)
    scheme = F.substring_index(base, "://", 1)
    folder = F.regexp_extract(base, "^([^:/?#]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    whole = (
        F.when(target.contains("://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), target))
    )
    return without_fragment(whole)


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst)``: canonical links and refresh redirects found in the pages' html."""
    html = F.col(html_col)
    tags = F.concat(
        F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*+>"), F.lit(0)), lambda x: x.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b")),
        F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*+>"), F.lit(0)), lambda x: x.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b")),
    )
    target = F.regexp_extract("tag", r"(?i)(?:\bhref\s*=\s*|\burl\s*=\s*)[\"']?([^\"'\s>]+)", 1)
    found = pages.where(html.rlike(r"(?i)canonical|http-equiv")).where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), F.explode(tags).alias("tag"))
    found = found.withColumn("target", target).where("target != ''")
    return found.select(without_fragment(F.col("url")).alias("src"), _absolute(F.col("target"), F.col("url")).alias("dst"))


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]] | DataFrame,
    edges: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """``(page_id, url, host, path, rule, verdict, alias_blocked)`` of every page.

    ``edges`` (src, dst) are further redirects, for instance from a crawl log;
    those of the html come on top unless ``html_col`` is None.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    judged = with_rule(urls, rules)
    parts = []
    if html_col is not None:
        parts.append(page_links(pages, url_col, html_col))
    if edges is not None:
        parts.append(edges.select(without_fragment(F.col("src")).alias("src"), without_fragment(F.col("dst")).alias("dst")))
    if not parts:
        return judged.select("page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"), F.lit(False).alias("alias_blocked"))
    links = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    members = connected_components(links)
    verdicts = with_rule(members, rules, "node").select("node", "component", "rule_verdict")
    blocked = verdicts.where("rule_verdict = 'block'").select("component").distinct()
    aliases = written(verdicts.where("rule_verdict is null").join(blocked, "component", "left_semi").select("node").distinct(), "aliases")
    out = judged.withColumn("_node", without_fragment(F.col("url"))).join(maybe_broadcast(aliases.withColumn("alias_blocked", F.lit(True))), F.col("_node") == F.col("node"), "left")
    alias_blocked = F.coalesce("alias_blocked", F.lit(False)) & F.col("rule_verdict").isNull()
    verdict = F.coalesce("rule_verdict", F.when(alias_blocked, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), alias_blocked.alias("alias_blocked"))
