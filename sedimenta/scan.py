"""A scan: one pass over entries feeds every tool that was asked for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.limits import LIMITS, TOOLS, Limits
from sedimenta.operators import conflicts, duplicates, empty_dirs, flat
from sedimenta.operators.duplicates import Match
from sedimenta.plans.moves import moved_copies


@dataclass(frozen=True)
class Request:
    tools: tuple[str, ...] = TOOLS
    roots: tuple[str, ...] = ("/volume1",)
    refs: tuple[str, ...] = ()
    match: Match = field(default_factory=Match)
    limits: Limits = LIMITS

    def ordered(self) -> list[str]:
        """The tools asked for, in their fixed order; an unknown one is an error."""
        if unknown := set(self.tools) - set(TOOLS):
            raise ValueError(f"unknown tools: {sorted(unknown)}")
        return [t for t in TOOLS if t in self.tools]


def scan(entries: DataFrame, folders: DataFrame | None, request: Request, moved: DataFrame | None = None) -> dict[str, DataFrame]:
    """Lazy results by tool, within the caps. ``entries`` should be persisted by the caller when several tools share it.

    ``moved(kind, key)`` names what was moved before, as in ``moved_copies``:
    such copies are no longer empty or junk files, nor such folders empty.
    """
    files = entries.where("not is_dir")

    def at_home(rows: DataFrame) -> DataFrame:
        return rows if moved is None else moved_copies(rows, moved).where("not out").drop("out")

    out: dict[str, DataFrame] = {}
    for tool in request.ordered():
        if tool == "empty_folders":
            if folders is None:
                continue
            tops = empty_dirs.without_references(empty_dirs.topmost(files, folders, list(request.roots)), list(request.refs))
            if moved is not None:
                tops = at_home(tops.withColumns({"ino": F.lit(None).cast("long"), "size": F.lit(None).cast("long"), "mod_unix": F.lit(None).cast("long"), "nlink": F.lit(2)})).select("path")
            out[tool] = empty_dirs.with_junk(empty_dirs.stored(tops, request.limits).select("path"), files)
        elif tool == "empty_files":
            out[tool] = flat.stored(at_home(flat.empty_files(entries)), request.limits)
        elif tool == "temp_files":
            out[tool] = flat.stored(at_home(flat.temp_files(entries)), request.limits)
        elif tool == "duplicates":
            out[tool] = duplicates.result(entries, request.match, request.limits)[1]
        else:
            numbered = conflicts.ordered(conflicts.sets(entries), request.limits)
            out[tool] = conflicts.shown(conflicts.skew_sample(conflicts.members(entries, numbered), request.limits), request.limits)
    return out
