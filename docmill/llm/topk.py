"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, are put into buckets by length (quantiles of the norm)
and, within a bucket, into blocks of bounded size.  A bounded set of the longest
vectors gives every query a first threshold: its k-th best score among them, a
lower bound of the final one.  A query goes only to the buckets whose length
bound reaches the threshold.  Within a block the local cosine threshold is the
threshold over the product of the two lengths: where it is high, candidates must
lie in the feasible range of the query's largest coordinates (coordinate
pruning); where it is low, they must be long enough (length pruning).  The
products of what remains are computed exactly and the best k of a block kept.

Both sides are cut into blocks, so a task holds a block of candidates and a
block of queries whatever the sizes of the tables, and nothing but the bounded
set of long vectors is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.runtime import written

BUCKETS = 16
#: Rows of a block: at most MOST_ROWS; fewer as long as there are under SPREAD blocks.
MOST_ROWS, LEAST_ROWS, SPREAD = 16_384, 64, 64
SEEDS, SEED_BYTES = 2048, 32 << 20
#: From this local cosine threshold on coordinates are used, so many of them.
COORDINATE, FOCUS = 0.8, 4
EXACT = float(1 << 53)
TOP = (1 << 63) - 1


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, v, norm)`` of the rows that take part; ``v`` holds integers as doubles."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col(id_col).alias("id"), F.transform(x, lambda c: _floor(c * scale)).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


def _floor(c: Column) -> Column:
    """Floor as a double, also beyond the range of bigint (where doubles are integers)."""
    return F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not len(lengths) or lengths.min() == lengths.max():
        return flat.reshape(len(lengths), -1) if len(flat) else np.zeros((len(lengths), 1))
    out = np.zeros((len(lengths), lengths.max()))
    out[np.arange(lengths.max())[None, :] < lengths[:, None]] = flat
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many coordinates as the shorter has: the others meet zeros."""
    n = min(a.shape[1], b.shape[1])
    return a[:, :n], b[:, :n]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows, as int64 (saturated beyond its range).

    Pairs of rows whose sums doubles hold exactly are multiplied as doubles; only
    the pairs with a row too large for that are summed as Python integers.
    """
    q, c = aligned(q, c)
    a, b = np.abs(q).max(axis=1, initial=0), np.abs(c).max(axis=1, initial=0)
    wide = max(1, q.shape[1])
    if a.max(initial=0) * b.max(initial=0) * wide < EXACT:
        return (q @ c.T).astype(np.int64)
    large = np.outer(a, b) * wide >= EXACT
    with np.errstate(all="ignore"):
        out = np.where(large, 0, q @ c.T).astype(np.int64)
    for i, j in zip(*np.nonzero(large), strict=True):
        out[i, j] = min(max(sum(int(x) * int(y) for x, y in zip(q[i], c[j], strict=True)), -TOP - 1), TOP)
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def candidates_of(q: np.ndarray, length: float, threshold: float, unit: np.ndarray, norms: np.ndarray) -> np.ndarray | None:
    """Places in a block (norms descending) that can reach the threshold; None: all."""
    if not np.isfinite(threshold) or threshold <= 0 or not length or not len(norms) or not norms[0]:
        return None
    slack = threshold * (1 - 1e-9) - 1e-6
    n = int(np.searchsorted(-norms, -slack / length, side="right"))  # long enough
    local = slack / (length * norms[0])
    if local < COORDINATE or not n:
        return np.arange(n)
    if local > 1:
        return np.zeros(0, np.int64)
    direction = q / length
    rest = np.sqrt(1 - local * local)
    keep = np.ones(n, bool)
    for f in np.argsort(-np.abs(direction))[:FOCUS]:
        x = direction[f]
        reach = rest * np.sqrt(max(0.0, 1 - x * x)) + 1e-9
        # candidates of cosine at least `local` have this coordinate in the range around x
        low = -1.0 if -x > local else x * local - reach
        high = 1.0 if x > local else x * local + reach
        keep &= (unit[:n, f] >= low) & (unit[:n, f] <= high)
    return np.flatnonzero(keep)


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024
) -> DataFrame:
    """``(query_id, rank, id, score)``: the k best candidates of every query row.

    Candidates are all rows with another id; ties go to the smaller id, and fewer
    candidates give fewer rows.  Components are floor(scale * x); vectors that
    are null or hold null or non-finite components, and rows with a null id, take
    no part.  Vectors of different length meet zeros; empty vectors score 0, and
    scores beyond the range of a bigint saturate.  A query row that is repeated is answered once; repeated candidates stand as
    often as they occur.
    """
    marked = vectors.select(F.col(id_col), F.col(vector_col), F.coalesce(is_query, F.lit(False)).alias("query_"))
    rows = written(integers(marked, id_col, vector_col, scale), "vectors")
    wanted = marked.where("query_").select(F.col(id_col).alias("id")).distinct()
    stats = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.percentile_approx("norm", [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("cuts")).first()
    total, dims = stats.n, stats.d or 1
    cuts = sorted(set(stats.cuts or []))
    bucket = sum((F.when(F.col("norm") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    per_block = min(MOST_ROWS, max(LEAST_ROWS, total // SPREAD))
    counts = {r.bucket: (r.n, r.top) for r in rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}  # a row a bucket
    first, blocks = {}, 0
    for b, (n, _) in sorted(counts.items()):
        first[b] = (blocks, -(-n // per_block))
        blocks += first[b][1]
    tops = {b: top for b, (_, top) in counts.items()}
    numbers = sorted(first)
    # first thresholds
    seeds = rows.orderBy(F.desc("norm"), "id").limit(min(SEEDS, max(16, SEED_BYTES // (8 * dims)))).toArrow() if total else None
    seed_ids = seeds.column("id").to_numpy() if total else np.zeros(0, np.int64)
    seed_rows = matrix(seeds.column("v")) if total else np.zeros((0, 1))

    def threshold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                q, ids, norms = matrix(batch.column(1)), batch.column(0).to_numpy(), batch.column(2).to_numpy()
                scores = products(q, seed_rows)
                low, to = [], []
                for s, own, length in zip(scores, ids, norms, strict=True):
                    s = s[seed_ids != own]
                    at = float(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else float("-inf")
                    low.append(at)
                    # the buckets whose length bound reaches it
                    to.append([b for b in numbers if at <= 0 or length * tops[b] * (1 + 1e-9) + 1e-6 >= at])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low), pa.array(to, pa.list_(pa.int32()))], ["id", "v", "norm", "threshold", "buckets"])

    queries = rows.join(wanted, "id", "left_semi").dropDuplicates(["id"])
    posed = written(queries.select("id", "v", "norm").mapInArrow(threshold, "id bigint, v array<double>, norm double, threshold double, buckets array<int>"), "queries")
    groups = max(1, -(-posed.count() // MOST_ROWS))  # blocks of queries
    pick = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    of = lambda at, i, other: F.coalesce(*[F.when(at == b, F.lit(x[i])) for b, x in first.items()], F.lit(other))
    at = F.col("bucket")
    # a query's row lists its buckets, at most BUCKETS; their blocks are only made where it is sent
    alive = posed.select("id", "v", "norm", "threshold", pick.alias("q"), F.explode("buckets").alias("bucket"))
    asked = alive.select("id", "v", "norm", "threshold", "q", F.explode(F.sequence(of(at, 0, 0), of(at, 0, 0) + of(at, 1, 1) - 1)).alias("c"))
    start, parts = of(bucket, 0, 0), of(bucket, 1, 1)
    given = rows.select("id", "v", "norm", (start + F.pmod(F.xxhash64("id", F.lit(1)), parts)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("q"))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if left.num_rows and right.num_rows:
            norms = left.column("norm").to_numpy()
            order = np.argsort(-norms, kind="stable")
            c, ids, norms = matrix(left.column("v"))[order], left.column("id").to_numpy()[order], norms[order]
            q, own, lengths, low = matrix(right.column("v")), right.column("id").to_numpy(), right.column("norm").to_numpy(), right.column("threshold").to_numpy()
            q, c = aligned(q, c)
            unit = c / np.maximum(norms, 1e-300)[:, None]
            places = [candidates_of(x, length, t, unit, norms) for x, length, t in zip(q, lengths, low, strict=True)]
            for i in range(0, len(q), 256):
                some = range(i, min(len(q), i + 256))
                # queries whose candidates are (nearly) a prefix are multiplied together
                longest = max([len(norms) if places[j] is None else len(places[j]) for j in some], default=0)
                together = products(q[i : i + 256], c[:longest]) if longest and all(places[j] is None or len(places[j]) and places[j][-1] == len(places[j]) - 1 or not len(places[j]) for j in some) else None
                for j in some:
                    at = np.arange(len(norms)) if places[j] is None else places[j]
                    at = at[ids[at] != own[j]]
                    if len(at):
                        s = together[j - i][at] if together is not None else products(q[j : j + 1], c[at])[0]
                        top = best(s, ids[at], k)
                        out_q += [own[j]] * len(top)
                        out_id += ids[at][top].tolist()
                        out_s += s[top].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "id": pa.array(out_id, pa.int64()), "score": pa.array(out_s, pa.int64())})

    found = given.groupBy("c", "q").cogroup(asked.groupBy("c", "q")).applyInArrow(answer, "query_id bigint, id bigint, score bigint")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, id)")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def digest(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""
