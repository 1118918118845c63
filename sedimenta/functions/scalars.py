"""Column functions of the file tools, all of them Catalyst expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.limits import CATEGORIES, JUNK_NAMES, JUNK_PREFIXES, JUNK_SUFFIXES, TOOL_FOLDERS, VERDICT_LABELS, VERDICT_WORDS


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def ext_of(name) -> Column:
    """What follows the last dot, upper-cased; FILE if nothing does."""
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(col(name), r"\.([^.]*)$", 1)), F.lit("")), F.lit("FILE"))


def is_junk(name) -> Column:
    low = F.lower(col(name))
    return low.isin(*JUNK_NAMES) | any_of([low.endswith(s) for s in JUNK_SUFFIXES]) | any_of([low.startswith(p) for p in JUNK_PREFIXES])


def junk_rule(name) -> Column:
    """Which kind of rule makes a name junk: name, suffix or prefix; null if none does."""
    low = F.lower(col(name))
    rule = F.when(low.isin(*JUNK_NAMES), "name").when(any_of([low.endswith(s) for s in JUNK_SUFFIXES]), "suffix")
    return rule.when(any_of([low.startswith(p) for p in JUNK_PREFIXES]), "prefix")


def skip_name(name) -> Column:
    """Folders that a recursive walk does not enter."""
    n = col(name)
    return n.startswith("@") | n.startswith(".") | n.isin("#recycle", "#snapshot", "lost+found")


def is_under(path, root) -> Column:
    """``path`` is ``root`` or below it, by whole segments."""
    p, r = col(path), col(root)
    return (p == r) | p.startswith(F.concat(r, F.lit("/")))


def under_any(path, roots: list[str]) -> Column:
    p = col(path)
    return any_of([(p == r) | p.startswith(r.rstrip("/") + "/") for r in roots])


def ancestors(path, own: bool = False) -> Column:
    """All folders above an absolute path, topmost first; with ``own`` the path too."""
    parts = F.split(col(path), "/")
    last = F.size(parts) - (0 if own else 1)
    many = F.when(last >= 2, F.sequence(F.lit(2), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(many, lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def parent_of(path) -> Column:
    return F.regexp_extract(col(path), "^(.*)/[^/]*$", 1)


def base_of(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def volume_of(path) -> Column:
    """First segment with its slash, as /volume1."""
    return F.regexp_extract(col(path), "^(/[^/]+)", 1)


def share_root(path) -> Column:
    """First two segments, as /volume1/share."""
    return F.regexp_extract(col(path), "^(/[^/]+/[^/]+)", 1)


def split_share(path) -> Column:
    """struct(share, rest) of a path that begins with a share, as /share/a/b."""
    p = col(path)
    return F.struct(F.regexp_extract(p, "^/([^/]+)", 1).alias("share"), F.regexp_extract(p, "^/[^/]+(/.*)?$", 1).alias("rest"))


def data_key(path, ino, size, mod) -> Column:
    return F.concat(F.lit("data:"), F.concat_ws("|", share_root(path), F.hex(col(ino)), col(size).cast("string"), col(mod).cast("string")))


def in_batch_layout(path) -> Column:
    """A tool's folder, perhaps numbered, then a volume's name and at least one segment more."""
    folders = "|".join(TOOL_FOLDERS[t] for t in sorted(TOOL_FOLDERS))
    return col(path).rlike(rf"(^|/)({folders})( \([0-9]+\))?/volume(USB|SATA)?[0-9]+/[^/]")


def cannot_address(path) -> Column:
    """Names the file service cannot be asked for."""
    name = base_of(path)
    return (name == ".DS_Store") | name.startswith("._") | ~F.is_valid_utf8(col(path))


def may_be_renamed(name) -> Column:
    """Names that a client of another system may have been shown under another name."""
    return col(name).rlike('[\\x00-\\x1f"*:<>?\\\\|]') | col(name).rlike("[. ]$")


def mark_name_ok(name) -> Column:
    """A relative name without empty, ``.`` and ``..`` parts, within 255 bytes a part and 4,096 in all."""
    parts = F.split(col(name), "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", "..") | (F.octet_length(p) > 255))
    return (F.octet_length(col(name)) <= 4096) & ~bad


def allowed_path(path, volumes: list[str]) -> Column:
    """Absolute, without ``..`` parts or empty ones, on one of the volumes."""
    parts = F.slice(F.split(col(path), "/"), 2, 4096)
    clean = ~F.exists(parts, lambda p: p.isin("", ".", ".."))
    return col(path).startswith("/") & clean & under_any(path, volumes)


def human_count(n) -> Column:
    return F.format_number(col(n), 0)


def fmt_time(seconds) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in the session's zone; empty if unknown."""
    return F.coalesce(F.date_format(F.timestamp_seconds(col(seconds)), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


_UNITS = ("KB", "MB", "GB", "TB")


def _fixed(v: Column, places: int, unit: str) -> Column:
    """A number with fixed places, halves to even."""
    return F.format_string(f"%.{places}f {unit}", F.bround(v, places))


def fmt_bytes(n) -> Column:
    """Sizes in evidence: whole bytes, else three figures or so."""
    b = col(n).cast("double")
    out = F.when(b <= 0, F.lit("0 B")).when(b < 1024, F.format_string("%d B", col(n).cast("long")))
    for i, unit in enumerate(_UNITS):
        v = b / float(1024 ** (i + 1))
        text = F.when(v >= 100, _fixed(v, 0, unit)).when(v >= 10, _fixed(v, 1, unit)).otherwise(_fixed(v, 2, unit))
        out = out.when(v < 1024, text) if i + 1 < len(_UNITS) else out.otherwise(text)
    return out


def fmt_bytes_short(n) -> Column:
    """Sizes in refusals: one decimal."""
    b = col(n).cast("double")
    out = F.when(b < 1024, F.format_string("%d B", col(n).cast("long")))
    for i, unit in enumerate(_UNITS):
        text = _fixed(b / float(1024 ** (i + 1)), 1, unit)
        out = out.when(b < float(1024 ** (i + 2)), text) if i + 1 < len(_UNITS) else out.otherwise(text)
    return out


def csv_cell(text) -> Column:
    """A quote before cells that a spreadsheet would run as a formula."""
    return F.regexp_replace(col(text), r"^(?=[\x00-\x20]*[=+\-@])", "'")


def category_of(ext) -> Column:
    found = F.lit(None).cast("string")
    for name, exts in CATEGORIES.items():
        found = F.when(col(ext).isin(*exts.split()), name).otherwise(found)
    return found


def verdict_words(verdict) -> Column:
    out = F.lit("")
    for v, words in VERDICT_WORDS.items():
        out = F.when(col(verdict) == v, words).otherwise(out)
    return out


def verdict_label(verdict) -> Column:
    out = F.lit(VERDICT_LABELS["unknown"])
    for v, label in VERDICT_LABELS.items():
        out = F.when(col(verdict) == v, label).otherwise(out)
    return out


def free_name(name, n) -> Column:
    """The n-th alternative: ``stem (n).ext``; names that begin with their only dot get it at the end."""
    stem, ext = F.regexp_extract(col(name), r"^(.+)(\.[^.]*)$", 1), F.regexp_extract(col(name), r"^(.+)(\.[^.]*)$", 2)
    number = F.concat(F.lit(" ("), col(n).cast("string"), F.lit(")"))
    return F.when(stem == "", F.concat(col(name), number)).otherwise(F.concat(stem, number, ext))
