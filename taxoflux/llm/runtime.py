"""Written intermediates and table access, as the rest of the library has them."""
import ctypes

from pyspark.sql import DataFrame

from taxoflux.plans.scratch import Scratch, shared_dir, table

__all__ = ["Scratch", "lean", "shared_dir", "table", "unused"]


def lean(run):
    """A function over batches that, when done, gives the memory that its arrays held back to the system; a worker would keep it
    until its next task."""

    def wrapped(batches):
        yield from run(batches)
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)

    return wrapped


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name
