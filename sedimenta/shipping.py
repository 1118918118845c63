"""Getting this package to the executors when it is neither installed nor on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def ship(spark) -> None:
    """Add the package to the session's files once, unless the workers' PYTHONPATH has it."""
    context = spark.sparkContext
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in on_path or "site-packages" in ROOT.parts or context.applicationId in _sent:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="sedimenta-"), "sedimenta.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((ROOT / "sedimenta").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(target)
    _sent.add(context.applicationId)


def shipped(query):
    """A query that ships the package first."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
