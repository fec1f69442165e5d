"""Connected components of a link table, by repeated contraction.

Every round each node hooks onto the neighbour that comes first in a hashed
order, links are renamed to the hooks and loops vanish.  The hashed order keeps
chains short, so the number of nodes falls by a constant factor a round.  The
rounds' hooks, ever fewer, are then composed from the last to the first.  Links
never leave the executors; each round's links are a written table, so no round
is computed twice and lost executors cost little.  Nodes with very many links or
followers are looked up by :func:`docmill.llm.runtime.looked_up`, so no task gets
all rows of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.runtime import looked_up, written


def connected(links: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` for every node of ``links`` (columns ``a``, ``b``: bigint).

    ``root`` is a node of the component, the same for all its nodes.  Nulls and
    loops link nothing; repeated links count once; no links give no rows.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while n := edges.count():
        turn = F.lit(len(rounds))
        rank = lambda c: F.struct(F.xxhash64(turn, F.col(c)).alias("r"), F.col(c).alias("n"))  # noqa: B023, E731
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("m"), F.count("*").alias("links"))
        hooks = written(first.select(F.col("a").alias("node"), F.when(rank("a") <= F.col("m"), F.col("a")).otherwise(F.col("m.n")).alias("to"), "links"), "hooks")
        for end in ("a", "b"):
            edges = looked_up(edges, hooks.select(F.col("node").alias(end), F.col("to").alias("t" + end), "links"), [end], "links", n, salt=F.struct("a", "b"))
        edges = written(edges.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
        rounds.append(hooks.select("node", "to"))
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds.pop().select("node", F.col("to").alias("root"))
    while rounds:
        hooks = rounds.pop()
        followers = hooks.groupBy(F.col("to").alias("node")).agg(F.count("*").alias("n"))
        ends = written(roots.join(followers, "node").select(F.col("node").alias("to"), "root", "n"), "ends")
        roots = looked_up(hooks, ends, ["to"], "n", hooks.count()).select("node", F.coalesce("root", "to").alias("root"))
        roots = written(roots, "roots")
    return roots
