"""The results service: refine, search, sort, page, select, total and export stored results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.functions.scalars import ancestors, base_of, category_of, csv_cell, ext_of, fmt_time, human_count, under_any, verdict_label, verdict_words
from sedimenta.limits import CATEGORIES, CSV_CONFLICTS, CSV_DUPLICATES, CSV_FLAT, LIMITS, MIB, Limits
from sedimenta.operators import duplicates, ranking
from sedimenta.operators.duplicates import Match, physical


@dataclass(frozen=True)
class Query:
    """A search; what is left empty is off."""

    q: str = ""
    loc: str = ""
    ftype: str = ""
    ext: str = ""
    date_by: str = ""
    date_from: str = ""
    date_to: str = ""
    size_op: str = ""
    size_mb: int = 0


def predicate(query: Query, columns: list[str]) -> Column | None:
    """All active conditions together, or None. Dates are compared as text; an unknown date never matches; the last day counts whole."""
    found: list[Column] = []
    text = query.q.strip().lower()
    if text:
        hit = F.contains(F.lower("path"), F.lit(text))
        found.append(hit | F.contains(verdict_words("verdict"), F.lit(text)) if "verdict" in columns else hit)
    if loc := query.loc.rstrip("/"):
        found.append((F.col("dir") == loc) | F.col("dir").startswith(loc + "/"))
    is_dir = F.col("is_dir") if "is_dir" in columns else F.lit(False)
    ext = ext_of("name")
    if query.ftype == "dir":
        found.append(is_dir)
    elif query.ftype == "file":
        found.append(~is_dir)
    elif query.ftype == "ext":
        if own := query.ext.lstrip(".").upper():
            found.append(~is_dir & (ext == own))
    elif query.ftype:
        found.append(~is_dir & ext.isin(*CATEGORIES[query.ftype].split()) if query.ftype in CATEGORIES else F.lit(False))
    if query.date_by and (query.date_from or query.date_to):
        when = {"modified": fmt_time("mod_unix"), "created": fmt_time("created_unix")}.get(query.date_by)
        when = F.coalesce(F.col("captured"), F.lit("")) if when is None and "captured" in columns else F.lit("") if when is None else when
        found.append((when != "") & (when >= query.date_from) & (F.lit(not query.date_to) | (F.substring(when, 1, 10) <= query.date_to)))
    if query.size_op == "eq":
        found.append(F.expr(f"size div {MIB}") == query.size_mb)
    elif query.size_op == "gt":
        found.append(F.col("size") > query.size_mb * MIB)
    elif query.size_op == "lt":
        found.append(F.col("size") < query.size_mb * MIB)
    out = None
    for one in found:
        out = one if out is None else out & one
    return out


def search_rows(rows: DataFrame, query: Query) -> DataFrame:
    hit = predicate(query, rows.columns)
    return rows if hit is None else rows.where(hit)


def search_groups(members: DataFrame, query: Query, group: str = "rank") -> DataFrame:
    """Members of the groups of which any member matches: a group is kept whole."""
    hit = predicate(query, members.columns)
    return members if hit is None else members.join(members.where(hit).select(group).distinct(), group, "left_semi")


def refine(members: DataFrame, match: Match, group: str = "rank") -> DataFrame:
    """Members regrouped within their group by the criteria, with ``sub``, the new group's number in it.

    A bucket stays with at least two names on at least two copies; an
    unknown created date groups with nothing. Buckets are numbered by their
    first member. Without criteria only groups of one copy go.
    """
    keys = [group, *match.keys()]
    rows = members.where("created_unix is not null") if match.created else members
    copies = rows.groupBy(*keys, physical().alias("phys")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
    buckets = copies.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"), F.min("p").alias("first")).where("n > 1 and c > 1")
    numbered = buckets.withColumn("sub", F.row_number().over(W.partitionBy(group).orderBy("first")).cast("long"))
    return rows.join(numbered.select(*keys, "sub"), keys)


SORT_FIELDS = {"name": "name", "path": "path", "size": "size", "date": "mod_unix", "created": "created_unix", "captured": "captured"}


def sort_order(field: str, descending: bool, columns: list[str], stored: str = "pos") -> list[Column]:
    """Order of a flat result; ties by path, ascending either way; an unknown field leaves the stored order."""
    column = SORT_FIELDS.get(field)
    if column is None or column not in columns:
        return [F.col(stored)]
    value = fmt_time(column) if column.endswith("_unix") else F.col(column)
    return [value.desc() if descending else value.asc(), F.col("path").asc()]


def page(df: DataFrame, order: list[Column], offset: int, limit: int, default: int, most: int) -> DataFrame:
    """One page by a total order; a limit that is not positive means the default, a negative offset the start."""
    limit = min(limit if limit > 0 else default, most)
    return df.orderBy(*order).offset(max(0, offset)).limit(limit)


def flagged(rows: DataFrame, refs: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows with ``prot``: under a reference folder, as it is or by the names its root also has."""
    names = list(refs)
    for raw, real in (aliases or {}).items():
        names += [real + r[len(raw) :] for r in refs if r == raw or r.startswith(raw + "/")]
        names += [raw + r[len(real) :] for r in refs if r == real or r.startswith(real + "/")]
    return rows.withColumn("prot", under_any("path", names) if names else F.lit(False))


def date_spans(rows: DataFrame) -> DataFrame:
    """One row: the least and greatest known date of each kind over a whole result; empty if none is known."""
    out = []
    for name, column in (("modified", "mod_unix"), ("created", "created_unix")):
        for how, f in (("from", F.min), ("to", F.max)):
            out.append(F.coalesce(f(F.nullif(fmt_time(column), F.lit(""))), F.lit("")).alias(f"{name}_{how}"))
    return rows.agg(*out)


def state_counts(tools: dict[str, DataFrame]) -> DataFrame:
    """tool, rows of each stored result."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(tool).alias("tool"), "rows") for tool, df in tools.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def auto_select(members: DataFrame, newest: bool, group: str = "rank") -> DataFrame:
    """Members with ``selected``: in each group all but the one to keep.

    Only originals compete if there are any, else all. If one of them is
    protected that one is kept and all others that may move are selected;
    otherwise the newest (or oldest) stays, the first of equal ones. A running
    best, not a list of the group, decides.
    """
    out = F.col("out") if "out" in members.columns else F.lit(False)
    prot = F.col("prot") if "prot" in members.columns else F.lit(False)
    marked = members.withColumn("__out", out.cast("int")).withColumn("__prot", prot)
    when = F.col("mod_unix") if newest else -F.col("mod_unix")
    best = marked.groupBy(group).agg(F.max("__prot").alias("__any"), F.max_by("pos", F.struct(-F.col("__out"), when, -F.col("pos"))).alias("__keep"))
    joined = marked.join(best, group)
    selected = F.when(F.col("__prot"), F.lit(False)).when(F.col("__any"), F.lit(True)).otherwise(F.col("pos") != F.col("__keep"))
    return joined.withColumn("selected", selected).drop("__out", "__prot", "__any", "__keep")


def selectable(members: DataFrame, group: str = "rank") -> DataFrame:
    """Members with ``can_select``: not when it is the last one of its group that is not selected."""
    left = members.groupBy(group).agg(F.count_if(~F.col("selected")).alias("__left"))
    return members.join(left, group).withColumn("can_select", F.col("selected") | (F.col("__left") > 1)).drop("__left")


def folder_rollup(rows: DataFrame) -> DataFrame:
    """folder, files: rows that are not protected in each folder's subtree."""
    free = rows.where(~F.col("prot")) if "prot" in rows.columns else rows
    return free.select(F.explode(ancestors("path")).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))


def select_folder(rows: DataFrame, folder: str) -> DataFrame:
    """Rows in a folder's subtree that may be selected."""
    hit = search_rows(rows, Query(loc=folder))
    return hit.where(~F.col("prot")) if "prot" in rows.columns else hit


def selection_summary(selected: DataFrame) -> DataFrame:
    return selected.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def export_duplicates(members: DataFrame, captured: Column | None = None) -> DataFrame:
    """Rows of the CSV of groups, ordered by Group and pos; every text cell is guarded."""
    values = [F.col("rank"), F.col("hash"), csv_cell("name"), csv_cell("dir"), F.col("size"), fmt_time("mod_unix"), fmt_time("created_unix"), captured if captured is not None else F.lit(""), F.when(F.col("nlink") > 1, F.col("nlink").cast("string")).otherwise("")]
    return members.select(*[v.alias(n) for v, n in zip(values, CSV_DUPLICATES, strict=True)], "pos")


def export_conflicts(members: DataFrame) -> DataFrame:
    values = [F.col("rank"), csv_cell("name"), csv_cell("dir"), F.col("size"), fmt_time("mod_unix"), F.col("hash"), verdict_label("verdict"), csv_cell("evidence")]
    return members.select(*[v.alias(n) for v, n in zip(values, CSV_CONFLICTS, strict=True)])


def export_flat(rows: DataFrame) -> DataFrame:
    values = [csv_cell("name"), csv_cell("dir"), F.col("size"), fmt_time("mod_unix"), F.lit(""), ext_of("name")]
    return rows.select(*[v.alias(n) for v, n in zip(values, CSV_FLAT, strict=True)])


def folder_names(rows: DataFrame) -> DataFrame:
    """path, base, ext, category, count text: scalar functions side by side, for pages."""
    return rows.select("path", base_of("path").alias("base"), ext_of("name").alias("ext"), category_of(ext_of("name")).alias("category"), human_count("size").alias("size_text"))


@dataclass(frozen=True)
class PageRequest:
    offset: int = 0
    limit: int = 0
    limits: Limits = LIMITS

    def groups(self, numbered: DataFrame) -> DataFrame:
        """A page of ranked groups."""
        return page(numbered, [F.col("rank")], self.offset, self.limit, self.limits.page_groups, self.limits.page_groups_most)

    def rows(self, rows: DataFrame, order: list[Column]) -> DataFrame:
        return page(rows, order, self.offset, self.limit, self.limits.page_rows, self.limits.page_rows_most)


def _count(members: DataFrame, group: str) -> DataFrame:
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return sizes.agg(F.count(F.lit(1)).alias("groups"), total("n").alias("files"), total("b").alias("bytes"))


def grouped_answer(members: DataFrame, query: Query = Query(), match: Match | None = None, request: PageRequest = PageRequest(), refs: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """What a request for a page of groups is answered with: page, rows, grand, total, dates.

    Groups are refined (``match`` None: as they are stored, as conflicts always
    are), counted (``grand``), searched and counted again (``total``). The page's
    groups get their protection and reclaimable bytes whole, and only then are
    their rows cut to the page's budget (``rows``: pos up to ``shown``).
    """
    group = "rank"
    if match is not None:
        refined = refine(members, match)
        first = refined.groupBy("rank", "sub").agg(F.count(F.lit(1)).alias("names"))
        members = refined.join(first.select("rank", "sub"), ["rank", "sub"]).withColumn("group", F.struct("rank", "sub"))
        group = "group"
    found = search_groups(members, query, group)
    sizes = found.groupBy(group).agg(F.count(F.lit(1)).alias("names"))
    order = [F.col(group)]
    limit = min(request.limit if request.limit > 0 else request.limits.page_groups, request.limits.page_groups_most)
    picked = page(sizes, order, request.offset, request.limit, request.limits.page_groups, request.limits.page_groups_most)
    numbered = picked.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long")).limit(limit)
    shown = ranking.trimmed(numbered, request.limits.trim_page, request.limits.trim_group, request.limits.trim_least, "place")
    rows = flagged(found.join(F.broadcast(shown.select(group, "place", "shown")), group), list(refs))
    free = duplicates.reclaim(rows, F.col("prot"), "place")
    pos = F.row_number().over(W.partitionBy("place").orderBy("pos"))
    return {
        "page": shown.join(free, "place").select("place", group, "names", "shown", "reclaim"),
        "rows": rows.withColumn("n", pos).where(F.col("n") <= F.col("shown")).drop("n", "shown"),
        "grand": _count(members, group),
        "total": _count(found, group),
        "dates": date_spans(members),
    }


def flat_answer(stored: DataFrame, query: Query = Query(), sort: str = "", descending: bool = False, request: PageRequest = PageRequest(), refs: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The same for a flat tool: page, grand, total, dates."""
    found = search_rows(stored, query)
    count = lambda df: df.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
    rows = request.rows(found, sort_order(sort, descending, stored.columns))
    return {"page": flagged(rows, list(refs)), "grand": count(stored), "total": count(found), "dates": date_spans(stored)}
