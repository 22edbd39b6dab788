"""What can be reached in a graph of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.tables import dropped, written


def first_parent_jumps(parents: DataFrame) -> list[DataFrame]:
    """repo, sha, to: tables of steps of 1, 2, 4, ... first parents, as long as any chain is."""
    step = written(parents.where("ord = 0").select("repo", "sha", F.col("parent").alias("to")).distinct(), "jumps")
    out = []
    while not step.isEmpty():
        out.append(step)
        on = step.select("repo", F.col("sha").alias("to"), F.col("to").alias("further")).hint("merge")
        step = written(step.join(on, ["repo", "to"]).select("repo", "sha", F.col("further").alias("to")), "jumps")
    dropped(step)
    return out


def ancestors(parents: DataFrame, heads: DataFrame) -> DataFrame:
    """repo, sha of the heads and of all commits before them, each once.

    ``parents``: repo, sha, parent, ord (0: the first parent; a merge has more); ``heads``: repo, sha. A history is as deep as it is long, so
    it is not walked commit by commit: chains of first parents are followed by path doubling, in as many joins as the logarithm
    of the longest one, and only the step to a merge's other parents is a round. There are as many rounds as merges lie within merged branches.
    Joins are on repo and sha, so one large repository is dealt to all tasks. Rows may repeat; nulls reach nothing.

    What is reached is closed under first parents, so a step leaves out what earlier rounds reached, and a round ends with the step that
    finds nothing more. Each step is written: a plan holds one join of rows that were written, and no table goes through the driver.
    """
    jumps = first_parent_jumps(parents)
    others = written(parents.where("ord > 0 AND parent IS NOT NULL").select("repo", "sha", "parent").distinct(), "merges")
    keys = ["repo", "sha"]
    found, new, stale = None, heads.select(*keys).where("repo IS NOT NULL AND sha IS NOT NULL").distinct(), []
    while True:
        reached = written(new, "reached")
        for table in stale:
            dropped(table)
        size = reached.count()
        if not size:
            dropped(reached)
            break
        for step in jumps:
            further = reached.join(step.hint("merge"), keys).select("repo", F.col("to").alias("sha"))
            if found is not None:
                further = further.join(found.hint("merge"), keys, "left_anti")
            earlier, reached, before = reached, written(reached.unionByName(further).distinct(), "reached"), size
            dropped(earlier)
            size = reached.count()
            if size == before:
                break
        stale = [] if found is None else [found, reached]
        found = reached if found is None else written(found.unionByName(reached), "found")
        new = reached.join(others.hint("merge"), keys).select("repo", F.col("parent").alias("sha")).distinct().join(found.hint("merge"), keys, "left_anti")
    for table in (*jumps, others):
        dropped(table)
    return found if found is not None else heads.select(*keys).where("1 = 0")
