"""Maintenance of closed relations under additions and removals, and revisions of an ontology."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflux.operators.graphs import closure
from taxoflux.plans.fixpoint import Rule, fixpoint
from taxoflux.plans.scratch import Scratch

c = F.col
TRANSITIVE = Rule("trans", "path", ("path", "path"), lambda x, y: x.select("sub", c("sup").alias("m")).join(y.select(c("sub").alias("m"), "sup"), "m").select("sub", "sup"))


def added_closure(closed: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs that new edges add to a closed relation; the old pairs are only read, never derived again."""
    done = fixpoint({"path": closed.select("sub", "sup")}, [TRANSITIVE], scratch, delta={"path": edges.select("sub", "sup")})
    return done.relations["path"].join(closed, ["sub", "sup"], "left_anti").distinct()


def removed_closure(edges: DataFrame, gone: DataFrame, closed: DataFrame, scratch: Scratch) -> DataFrame:
    """The closure without some edges.  Pairs that no path through a removed edge explains stand; only
    subs above which something was removed are closed again."""
    left = edges.join(gone, ["sub", "sup"], "left_anti")
    hit = closed.join(gone.select(c("sub").alias("sup")), "sup", "left_semi").select("sub").unionByName(gone.select("sub")).distinct()
    safe = closed.join(hit, "sub", "left_anti")
    # paths from touched subs may use any safe pair as a shortcut
    again = closure(left.join(hit, "sub", "left_semi").unionByName(safe.select("sub", "sup")), scratch)
    return again.distinct()


@dataclass
class Revisions:
    """A log of additions and removals by revision; a session is stale once the log has moved on."""

    revision: int = 0
    added: list[tuple[int, str, DataFrame]] = field(default_factory=list)
    removed: list[tuple[int, str, DataFrame]] = field(default_factory=list)

    def add(self, relation: str, rows: DataFrame) -> int:
        self.revision += 1
        self.added.append((self.revision, relation, rows))
        return self.revision

    def remove(self, relation: str, rows: DataFrame) -> int:
        self.revision += 1
        self.removed.append((self.revision, relation, rows))
        return self.revision

    def since(self, revision: int) -> tuple[dict[str, DataFrame], bool]:
        """(additions per relation, whether anything was removed) after a revision."""
        out: dict[str, DataFrame] = {}
        for r, name, rows in self.added:
            if r > revision:
                out[name] = out[name].unionByName(rows) if name in out else rows
        return out, any(r > revision for r, _, _ in self.removed)
