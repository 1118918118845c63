"""URL filters whose decisions hold for all aliases of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.components import components
from sedimenta.llm.storage import ascii_lower, materialize

#: Rules are evaluated as one expression, longest first; more than this many are refused.
MAX_RULES = 500


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest of ``rules`` (verdict, host, path) that fits, else null; of equally long ones an allow wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, under in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(under)
        found = F.when(fits, F.struct(F.lit(of + under).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _node(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "#.*$", "")


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): page url and where its canonical link or refresh points, made absolute; urls without their fragment."""
    tags = F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)
    tagged = pages.where(F.col(url_col).isNotNull()).select(_node(F.col(url_col)).alias("a"), F.explode(tags).alias("tag"))
    value = r"""(?is)\b%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""

    def attribute(name: str) -> Column:
        return F.concat(*[F.regexp_extract("tag", value % name, i) for i in (1, 2, 3)])

    canonical = F.col("tag").rlike("(?i)^<link") & F.array_contains(F.split(F.lower(attribute("rel")), r"\s+"), "canonical")
    refresh = F.col("tag").rlike("(?i)^<meta") & (F.lower(attribute("http-equiv")) == "refresh")
    moved = F.regexp_extract(attribute("content"), r"""(?is)url\s*=\s*['"]?([^'"]*)""", 1)
    to = F.regexp_replace(F.trim(F.when(canonical, attribute("href")).when(refresh, moved)), "&amp;", "&")
    linked = tagged.withColumn("to", to).where("to <> ''")
    scheme = F.substring_index("a", "://", 1)
    origin = F.regexp_extract("a", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("a", r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    absolute = (
        F.when(F.col("to").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), "to"))
        .when(F.col("to").startswith("/"), F.concat(origin, "to"))
        .when(folder.endswith("/"), F.concat(folder, "to"))
        .otherwise(F.concat(folder, F.lit("/"), "to"))
    )
    return linked.select("a", _node(absolute).alias("b")).where("b <> ''")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict and the columns of ``carry``.

    A url's longest rule decides. A url without a rule is blocked if any url
    it is linked with by canonical links or refreshes, directly or not and
    whether or not it is a page here, is blocked by a rule; otherwise it is
    allowed. So a rule that allows a url outweighs what its aliases bring. A
    null url has no rule and no alias and is allowed; null html links nothing;
    repeated rows are judged alike; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("__url"))
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("__url"), *carry)
    judged = named.select("id", "__url", host.alias("host"), path.alias("path"), *carry).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    links = materialize(alias_links(pages, url_col, html_col), "url-links")
    groups = materialize(components(links), "url-groups")
    node_host, node_path = host_and_path(F.col("node"))
    ruled = groups.select("node", "component", node_host.alias("host"), node_path.alias("path"))
    bad = ruled.where(rule_of(F.col("host"), F.col("path"), rules)["verdict"] == "block").select("component").distinct()
    blocked = materialize(groups.join(bad, "component", "left_semi").select("node"), "url-blocked")
    if blocked.limit(1).count():
        judged = judged.withColumn("__node", _node(F.col("__url"))).join(blocked.select(F.col("node").alias("__node"), F.lit(True).alias("hit")), "__node", "left")
    else:
        judged = judged.withColumn("hit", F.lit(False))
    verdict = F.when(F.col("r").isNotNull(), F.col("r.verdict")).when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), *carry)
