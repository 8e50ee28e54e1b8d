"""Tables of the operators in the folder that the cluster shares, and this package on its executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Hashable
from pathlib import Path

from pyspark.sql import DataFrame

from ..sources.shared import discard, new_path, numbered, placed_rows, shared_dir, written

__all__ = ["discard", "held", "new_path", "numbered", "placed_rows", "release", "shared_dir", "shipped", "written"]


def shipped(df: DataFrame) -> DataFrame:
    """df, once this package has been sent to the executors of its session, whose Python workers import it."""
    sc = df.sparkSession.sparkContext
    if not getattr(sc, "_joinwright_shipped", False):
        package = Path(__file__).resolve().parents[1]
        place = tempfile.mkdtemp(prefix="joinwright-package-")  # Spark serves the file from here to the executors
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        with zipfile.ZipFile(f"{place}/{package.name}.zip", "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(f"{place}/{package.name}.zip")
        sc._joinwright_shipped = True
    return df


_held: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]) -> object:
    """The large object of that key of a Python worker, made once and used by all its tasks. A worker, which may serve one operator after the other, holds one."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Lets go of what held() keeps in a Python worker: for tasks of an operator that keeps nothing and has large arrays of its own."""
    _held.clear()
