"""Sharding by histogram sort, in DataFrame operations only.

Documents are put in the order of (hash of the text, hash of the id, row): equal
texts stand together, and at each of the three levels keys are spread evenly
whatever texts and ids look like.  Splitters are found by counting: a first
histogram holds the exact bytes below the boundaries of equal ranges of the first
hash; then, round after round, only ranges that still hold a wanted splitter are
counted again with finer boundaries, until the bytes below a boundary are within
``tolerance`` of what is wanted or the range is a single key.  If the rows of a
single key are more than the tolerance, the rounds go on inside it, at the next
level.  Each round is one map-side-combined aggregation of a slim table; the
driver sees a bounded number of counts for each of the shards' splitters.

Rows are then exchanged once, by cells: a cell is part of one shard and one range
of the first hash, as narrow as the number of rows asks for; keys with very many
rows have cells of their own, cut by the next level.  So cells hold about
``CELL_ROWS`` rows at any size.  A slot is the cell's offset plus the row's number
within it; offsets are a running sum over the shard's cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.runtime import written

#: Bits of a level's keys, of the first histogram and of a round.
BITS, FIRST_BITS, ROUND_BITS = 62, 12, 6
LEVELS = ("h", "g", "e")
#: Rows of a cell, about, and cells of the first hash at least (as bits).
CELL_ROWS, LEAST_BITS = 100_000, 6
#: Keys with at least one in so many rows (so many keys at most) have cells of their own.
HEAVY = 8192
TOLERANCE = 0.002


def _top(hash_: Column) -> Column:
    return F.shiftrightunsigned(hash_, 64 - BITS)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_, size, text_crc32, h, g, e)``: the slim table.

    ``h`` is a hash of the text and ``g`` of the id (null: of a constant); ``e``, a
    hash of the row's place, only tells rows apart that agree in both.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id_"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _top(F.xxhash64(text)).alias("h"),
        _top(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull())).alias("g"),
        _top(F.xxhash64(F.monotonically_increasing_id())).alias("e"),
    )


@dataclass
class Target:
    """A wanted splitter: ``want`` bytes below it.  It is looked for at ``level``, among the
    rows that have the ``fixed`` keys above it, in the range ``prefix`` of ``shift`` bits;
    ``cut`` is the splitter that was found, a key of each level."""

    want: float
    slack: float
    below: int = 0
    level: int = 0
    fixed: tuple[int, ...] = ()
    shift: int = BITS
    prefix: int = 0
    cut: tuple[int, ...] | None = None


def _settle(t: Target, bins: list[tuple], shift: int) -> None:
    """Move a target to a boundary of the bins of its range, or into one of them.

    ``bins``: (prefix, bytes, rows, least key, greatest key), ascending.
    """
    zeros = (0,) * (len(LEVELS) - t.level - 1)
    below = t.below
    for prefix, size, rows, least, most in bins:
        if below + size < t.want:
            below += size
            continue
        low, high = t.want - below, below + size - t.want
        last = least == most and t.level == len(LEVELS) - 1
        if min(low, high) <= t.slack or rows == 1 or last:
            t.cut = (*t.fixed, (prefix << shift) if low <= high else (prefix + 1) << shift, *zeros)
        elif least == most:  # one key: go on inside, at the next level
            t.below, t.level, t.fixed, t.shift, t.prefix = below, t.level + 1, (*t.fixed, least), BITS, 0
        else:
            t.below, t.shift, t.prefix = below, shift, prefix
        return
    t.cut = (*t.fixed, (t.prefix + 1) << t.shift, *zeros)  # all that is left lies below


def splitters(rows: DataFrame, targets: list[Target]) -> list[tuple[int, ...]]:
    """Find every target in the slim table, a round of counting at a time."""

    def counted(df: DataFrame, groups: list[Column], key: str, shift: int) -> list:
        bin_ = F.shiftrightunsigned(F.col(key), shift)
        return df.groupBy(*groups, bin_.alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()

    first = sorted((r.b, r.s, r.n, r.lo, r.hi) for r in counted(rows, [], "h", BITS - FIRST_BITS)) if targets else []
    for t in targets:
        _settle(t, first, BITS - FIRST_BITS)
    while left := [t for t in targets if t.cut is None]:
        for level, depth in sorted({(t.level, t.shift) for t in left}):
            here = [t for t in left if (t.level, t.shift) == (level, depth)]
            key, above, fine = LEVELS[level], LEVELS[:level], max(0, depth - ROUND_BITS)
            parent = F.shiftrightunsigned(F.col(key), depth) if depth < BITS else F.lit(0).cast("bigint")
            wanted = F.lit(False)
            for fixed, prefix in sorted({(t.fixed, t.prefix) for t in here}):  # a term a splitter at most
                own = parent == prefix
                for name, value in zip(above, fixed, strict=True):
                    own = own & (F.col(name) == value)
                wanted = wanted | own
            found = counted(rows.where(wanted), [*map(F.col, above), parent.alias("p")], key, fine)
            for t in here:
                _settle(t, sorted((r.b, r.s, r.n, r.lo, r.hi) for r in found if r.p == t.prefix and tuple(r[c] for c in above) == t.fixed), fine)
    return sorted(t.cut for t in targets)


def _heavy(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The keys with at least ``least`` rows, and the bits by which the next level must cut them."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return found.select(*keys, F.ceil(F.log2(F.col("n") / CELL_ROWS) + 1).cast("int").alias("bits"))


def sharded(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row, under the law "bytes".

    Shards hold nearly equal bytes: a splitter is off by at most ``tolerance`` of
    a shard's share, or by less than one row.  Groups of equal texts stand together
    within a shard and are cut only by such a splitter.  Rows with the same text are ordered by a
    hash of the id and by the id; rows that agree in both are interchangeable, so
    the result depends neither on the order nor on the partitioning of the rows.
    Null texts have size 1 like empty ones and stand with them; null ids are an id
    of their own; an empty table gives no rows; texts may be of any length, and
    other columns play no part.
    """
    rows = written(keyed(docs, id_col, text_col), "sizes")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s"), F.count("*").alias("n")).first()
    targets = [Target(total.s * i / shards, tolerance * total.s / shards) for i in range(1, shards)] if total.n else []
    cuts = splitters(rows, targets)
    beyond = lambda c: (F.col("h") > c[0]) | ((F.col("h") == c[0]) & ((F.col("g") > c[1]) | ((F.col("g") == c[1]) & (F.col("e") >= c[2]))))
    shard = sum((F.when(beyond(c), 1).otherwise(0) for c in cuts), F.lit(0))
    bits = max(LEAST_BITS, (total.n // CELL_ROWS).bit_length())
    slim = rows.withColumn("shard", shard).withColumn("p", F.shiftrightunsigned("h", BITS - bits))
    least = max(CELL_ROWS, -(-total.n // HEAVY))
    if total.n >= least:  # keys may be heavy: at most HEAVY of them, and as many (text, id) pairs
        texts, pairs = written(_heavy(rows, ["h"], least), "heavy"), written(_heavy(rows, ["h", "g"], least), "heavy")
        slim = slim.join(F.broadcast(texts), "h", "left").withColumn("q", F.expr(f"coalesce(shiftrightunsigned(g, {BITS} - bits) + 1, 0L)")).drop("bits")
        slim = slim.join(F.broadcast(pairs), ["h", "g"], "left").withColumn("r", F.expr(f"coalesce(shiftrightunsigned(e, {BITS} - bits) + 1, 0L)")).drop("bits")
    else:
        slim = slim.withColumn("q", F.lit(0).cast("bigint")).withColumn("r", F.lit(0).cast("bigint"))
    # heavy keys' cells: a range of one key each, so that the keys above them go with the cell
    own = F.when(F.col("q") > 0, F.col("h")).otherwise(-1)
    pair = F.when(F.col("r") > 0, F.col("g")).otherwise(-1)
    cell = ["shard", "p", "own", "q", "pair", "r"]
    placed = slim.withColumn("own", own).withColumn("pair", pair)
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("rows_"))
    before = F.expr("sum(rows_) over (partition by shard order by p, own, q, pair, r rows between unbounded preceding and 1 preceding)")  # a row a cell
    starts = sizes.select(*cell, F.coalesce(before, F.lit(0)).alias("start"))
    number = F.expr(f"row_number() over (partition by {', '.join(cell)} order by h, g, id_, text_crc32, size, e)")
    numbered = placed.withColumn("number", number)
    return numbered.join(starts, cell).select(F.col("id_").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("number") - 1).cast("bigint").alias("slot"))


def digest(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
