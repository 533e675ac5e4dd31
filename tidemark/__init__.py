"""Event-log analytics and training-data operators on PySpark."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path


def ship(spark) -> None:
    """Send this package to the executors of a session, for clusters on which it isn't installed."""
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
