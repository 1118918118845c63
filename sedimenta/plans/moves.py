"""Decisions about moving files, as rows; nothing is ever moved.

Each function answers one question a safe clean-up asks. Path prefixes are
matched by exploding a row's ancestors and joining on equality, so a long list
of folders needs no nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.scalars import allowed_path, ancestors, cannot_address, data_key, fmt_bytes_short, in_batch_layout, under_any, volume_of
from sedimenta.limits import READ_ONLY_TOOLS

TIERS = ("original_there", "there", "original", "any")


def under(rows: DataFrame, folders: DataFrame, own: bool = True) -> DataFrame:
    """Rows at or under any of ``folders(path)``."""
    keyed = rows.withColumn("__up", F.explode(ancestors("path", own)))
    hit = keyed.join(folders.select(F.col("path").alias("__up")).distinct(), "__up", "left_semi").select("path").distinct()
    return rows.join(hit, "path", "left_semi")


def allow_list(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """path, listed: whether a requested path is a row of the tool's stored result."""
    rows = stored.select("path", F.lit(True).alias("listed")).distinct()
    return requested.select("path").distinct().join(rows, "path", "left").select("path", F.coalesce("listed", F.lit(False)).alias("listed"))


def identity_ok(rows: DataFrame, now: DataFrame) -> DataFrame:
    """path, exists, same: a second look at type, time and (of files) size; an entry that is gone or could not be looked at is neither."""
    seen = now.select("path", F.col("size").alias("n_size"), F.col("mod_unix").alias("n_mod"), F.col("is_dir").alias("n_dir"))
    j = rows.join(seen, "path", "left")
    same = (F.col("is_dir") == F.col("n_dir")) & F.col("mod_unix").eqNullSafe(F.col("n_mod")) & (F.col("is_dir") | (F.col("size") == F.col("n_size")))
    return j.select("path", F.col("n_mod").isNotNull().alias("exists"), F.coalesce(same, F.lit(False)).alias("same"))


def strongest_identity(rows: DataFrame, key: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row a path (or ``key``), the one that proves most: with a hash, else a prefix, else the first."""
    strength = F.when(F.col("hash").isNotNull(), 2).when(F.col("pfx").isNotNull(), 1).otherwise(0)
    return rows.groupBy(*key).agg(F.max_by(F.struct("size", "mod_unix", "pfx", "hash", "is_dir"), F.struct(strength, -F.col("rank"))).alias("i")).select(*key, "i.*")


def keep_one(members: DataFrame, group: str = "rank") -> DataFrame:
    """group, hold, tier: for each group that the request would empty, the member to hold back.

    ``members`` has requested, prot, exists and out (a moved copy). A copy
    stays if it is not requested or is protected; copies that vanished do not
    count, and while an original exists only originals do. The member held is
    the last by path of the best tier: an original that exists, any that
    exists, an original, any. One aggregate with a running best decides.
    """
    stays = (~F.col("requested") | F.col("prot")) & F.col("exists")
    tier = F.when(F.col("exists") & ~F.col("out"), 3).when(F.col("exists"), 2).when(~F.col("out"), 1).otherwise(0)
    could = F.col("requested") & ~F.col("prot")
    g = members.groupBy(group).agg(
        F.max(F.col("exists") & ~F.col("out")).alias("originals"),
        F.max(stays & ~F.col("out")).alias("stays_original"),
        F.max(stays).alias("stays_any"),
        F.max_by(F.struct(F.col("path").alias("path"), tier.alias("tier")), F.when(could, F.struct(tier, "path"))).alias("best"),
        F.max(could).alias("asked"),
    )
    safe = F.when(F.col("originals"), F.col("stays_original")).otherwise(F.col("stays_any"))
    name = F.element_at(F.array(*[F.lit(t) for t in reversed(TIERS)]), F.col("best.tier") + 1)
    return g.where(F.col("asked") & ~safe).select(group, F.col("best.path").alias("hold"), name.alias("tier"))


def content_vouched(holds: DataFrame, members: DataFrame, fresh: DataFrame, group: str = "rank") -> DataFrame:
    """group, path, vouched: whether each staying copy's content, hashed anew, is still that of its group."""
    return members.join(fresh.select("path", F.col("hash").alias("now")), "path", "left").join(holds.select(group).distinct(), group, "left_semi").select(group, "path", F.coalesce(F.col("now") == F.col("hash"), F.lit(False)).alias("vouched"))


def with_folders(requested: DataFrame, members: DataFrame) -> DataFrame:
    """Members requested by name or by a folder above them."""
    return under(members, requested)


def refusals(rows: DataFrame, volumes: list[str], refs: list[str], self_mounts: list[str] = (), tool: str = "duplicates") -> DataFrame:
    """path, action, reason: the first rule that speaks against moving a row, in fixed order.

    ``rows`` may have held_stale, held_out, dropped, holds_held, listed and
    junk_now; what is missing speaks against nothing. A tool of
    ``READ_ONLY_TOOLS`` only reports: all its rows are refused.
    """

    def flag(name: str, default: bool = False) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default)

    holds_ref = F.lit(False)
    for r in refs:
        holds_ref = holds_ref | F.lit(r).startswith(F.concat("path", F.lit("/")))
    reason = (
        F.when(F.lit(tool in READ_ONLY_TOOLS), "read-only tool")
        .when(under_any("path", list(self_mounts)) if self_mounts else F.lit(False), "self-mount")
        .when(~allowed_path("path", volumes), "outside")
        .when(flag("held_stale"), "stale copy held")
        .when(flag("held_out"), "moved copy held")
        .when(flag("dropped"), "last copy")
        .when(flag("holds_held"), "holds a held copy")
        .when(under_any("path", refs) if refs else F.lit(False), "reference")
        .when(holds_ref, "holds a reference")
        .when(~F.is_valid_utf8("path"), "name")
        .when(cannot_address("path"), "cannot be addressed")
        .when(~flag("listed", True), "not listed")
        .when(F.lit(tool == "temp_files") & ~flag("junk_now", True), "no longer junk")
    )
    return rows.select("path", F.when(reason.isNull(), "move").otherwise("refuse").alias("action"), F.coalesce(reason, F.lit("")).alias("reason"))


def space_need(rows: DataFrame, target: str) -> DataFrame:
    """One row: bytes to be copied to another volume, the largest file among them, and as text."""
    across = volume_of("path") != volume_of(F.lit(target))
    need = F.coalesce(F.sum(F.when(across, F.col("size"))), F.lit(0)).cast("long")
    most = F.coalesce(F.max(F.when(across, F.col("size"))), F.lit(0)).cast("long")
    return rows.agg(need.alias("need"), most.alias("largest")).withColumn("need_text", fmt_bytes_short("need"))


def sync_hits(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """folder, service, files: rows to be moved in each synced area (path, service)."""
    keyed = rows.select("path", F.explode(ancestors("path", True)).alias("folder"))
    return keyed.join(areas.select(F.col("path").alias("folder"), "service"), "folder").groupBy("folder", "service").agg(F.countDistinct("path").alias("files"))


def agreed_covers(hits: DataFrame, agreed: DataFrame) -> DataFrame:
    """One row: whether every hit area was agreed to, and how many were not."""
    open_ = hits.select("folder", "service").distinct().join(agreed.select("folder", "service"), ["folder", "service"], "left_anti")
    return open_.agg((F.count(F.lit(1)) == 0).alias("covered"), F.count(F.lit(1)).alias("open"))


def moved_copies(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """Rows with ``out``: a moved copy by its place, by a moved path at or above it, or by its data.

    ``moved(kind, key)`` has kinds path, data and from. Data keys count only for
    rows with one link that no ``from`` key names.
    """
    keyed = rows.select("path", F.explode(ancestors("path", True)).alias("key"))
    paths = keyed.join(moved.where("kind = 'path'").select("key"), "key", "left_semi").select("path").distinct().withColumn("__p", F.lit(True))
    froms = moved.where("kind = 'from'").select(F.col("key").alias("path")).distinct().withColumn("__f", F.lit(True))
    data = moved.where("kind = 'data'").select(F.col("key").alias("__key")).distinct().withColumn("__d", F.lit(True))
    j = rows.withColumn("__key", data_key("path", "ino", "size", "mod_unix")).join(paths, "path", "left").join(froms, "path", "left").join(data, "__key", "left")
    by_data = F.col("__d").isNotNull() & (F.col("nlink") <= 1) & F.col("__f").isNull()
    return j.withColumn("out", in_batch_layout("path") | F.col("__p").isNotNull() | by_data).drop("__key", "__p", "__f", "__d")


def marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows that a mark record (path, size, mtime) names as they are now."""
    keys = marks.select("path", "size", F.col("mtime").alias("mod_unix")).distinct()
    return rows.join(keys, ["path", "size", "mod_unix"], "left_semi")


def landed_keys(moves: DataFrame) -> DataFrame:
    """kind, key of what moves leave behind: the place it came to, its data there, and the place it came from."""
    to = moves.select(F.lit("path").alias("kind"), F.col("to_path").alias("key"))
    data = moves.select(F.lit("data").alias("kind"), data_key("to_path", "ino", "size", "mod_unix").alias("key"))
    return to.unionByName(data).unionByName(moves.select(F.lit("from").alias("kind"), F.col("path").alias("key"))).distinct()


def pruned(members: DataFrame, gone: DataFrame, group: str = "rank") -> tuple[DataFrame, DataFrame]:
    """(rows left, keepers): what remains once moved paths and what lay below them are gone; a group with one left keeps it on record and is itself gone."""
    left = members.join(under(members, gone).select("path"), "path", "left_anti")
    sizes = left.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("keeper"))
    return left.join(sizes.where("n > 1").select(group), group, "left_semi"), sizes.where("n = 1").select(group, "keeper")


def manifests_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """rel, change of two folder manifests (rel, kind, size, mtime, hash, link): added, removed or changed; equal ones do not appear."""
    fields = ["kind", "size", "mtime", "hash", "link"]
    x, y = (d.select("rel", F.struct(*fields).alias(n)) for d, n in ((a, "x"), (b, "y")))
    j = x.join(y, "rel", "full_outer")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return j.select("rel", change.alias("change")).where("change is not null")


def stale_selection(scanned_at: str, stored: str) -> bool:
    """Whether a request was made on another scan's result than the one stored."""
    return scanned_at != stored


def replay(journal: DataFrame) -> DataFrame:
    """batch, path, outcome of journal lines (batch, seq, tag, path, to_path): moved, gone or unsettled.

    Of a file's lines the last that speaks of its state counts: ``begin`` leaves
    it unsettled, ``placed`` and ``done`` settle it as moved, ``gone`` as gone, and
    ``failed`` takes it back, so it is not returned.
    """
    said = journal.where(F.col("tag").isin("begin", "placed", "done", "gone", "failed"))
    last = said.groupBy("batch", "path").agg(F.max_by("tag", "seq").alias("tag")).where("tag <> 'failed'")
    outcome = F.when(F.col("tag") == "begin", "unsettled").when(F.col("tag") == "gone", "gone").otherwise("moved")
    return last.select("batch", "path", outcome.alias("outcome"))
