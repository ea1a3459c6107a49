"""Exact top-k inner products by a three-phase uniform threshold.

Candidates are dealt over tasks, and a vector's dimensions over SITES sites: a task has, for each site, the list of
its candidates' partial scores for a query. A score is the sum over sites.

1. Every task sends, for each query, the k best scores among the k best entries of each of its local lists. The k-th
   best of all these is a cutoff that no answer is below.
2. The cutoffs go to all tasks with the queries. A candidate that reaches a query's cutoff has, at some
   site, a partial score of at least cutoff / SITES; only such entries are collected. Candidates lie by length, longest
   first, and a query leaves out a batch of them of which the longest, by length alone, can't reach its cutoff.
3. The scores of the entries are resolved exactly; those that reach the cutoff, the k best of each task, are ranked.

Queries are broadcast with their cutoffs in chunks of at most QUERY_BYTES, one chunk after the other; candidates never
move. A task holds a chunk, a batch of candidates, SLICE partial scores of each site, and k entries for each query.

The sites' lists are in one task as they are dense: with a table for each site, summed by query and candidate,
a third of all pairs had an entry in some site.

Defined cases: vectors that are null or hold a null or a component that isn't finite take no part, nor do rows
without an id; shorter vectors end in zeros; repeated rows are candidates each, and as queries have answers
each; rows with the query's id aren't its candidates; ties go to the smaller id; other columns are ignored; an
empty table gives an empty result. Products are exact: in floating point while sums stay under 2^53, else in
Python integers. Components or scores beyond 64 bits are an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterflow.llm.common import materialize

K = 5
SCALE = 256
SITES = 4
#: Bytes of the queries that are broadcast at once, and partial scores that a task holds at once.
QUERY_BYTES = 16 << 20
SLICE = 1 << 21

ENTRIES = "query int, vec_id bigint, score bigint"
MOST = 2**63 - 1


def _matrix(column, width: int):
    """An Arrow array of lists of integers as a matrix, short rows ended by zeros."""
    import numpy as np

    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _top(matrix) -> int:
    return max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))


def _partials(queries, rows):
    """The partial scores [site][query, row], exact: floats where sums stay below 2^53, else Python integers."""
    width = queries.shape[1]
    kind = object if width * _top(queries) * _top(rows) >= 2**53 else float
    at = [round(k * width / SITES) for k in range(SITES + 1)]
    return [queries[:, a:b].astype(kind) @ rows[:, a:b].astype(kind).T for a, b in zip(at, at[1:])]


def _lengths(matrix):
    """Lengths of the rows, rounded up."""
    import numpy as np

    return np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)


def _best(k: int, *parts):
    """The k best entries of each query, of arrays (query, vec_id, score)."""
    import numpy as np

    query, vec, score = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((vec, -score, query)) if score.dtype != object else np.array(sorted(range(len(score)), key=lambda n: (query[n], -score[n], vec[n])), np.int64)
    query, vec, score = query[order], vec[order], score[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(query)), bool), query[1:] != query[:-1]]))
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[rank < k], vec[rank < k], score[rank < k]


def _entries(shared, k: int):
    """Phase 1, or, where the chunk (ids, vectors, cutoffs) has cutoffs, phases 2 and 3, over (vec_id, vector)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, vectors, cutoffs = shared.value
        lengths, found = _lengths(vectors), []
        if cutoffs is not None:
            limit = np.array([-np.inf if c is None else c for c in cutoffs], object if any(c is not None and abs(c) >= 2**53 for c in cutoffs) else float)
            least = np.array([-np.inf if c is None else c - 1e-9 * abs(c) - 1 for c in cutoffs], float)
        for batch in batches:
            vec, rows, step = batch.column(0).to_numpy(), _matrix(batch.column(1), vectors.shape[1]), max(1, SLICE // len(ids))
            for at in range(0, len(rows), step):
                some, own = rows[at : at + step], vec[at : at + step]
                asks = np.arange(len(ids)) if cutoffs is None else np.flatnonzero(lengths * _lengths(some).max() >= least)
                parts = _partials(vectors[asks], some)
                other = ids[asks][:, None] != own[None]
                if cutoffs is None:
                    if len(own) > k:
                        lists = [np.where(other, p, -np.inf) for p in parts]
                        near = [np.argsort(-p, axis=1, kind="stable")[:, :k] if p.dtype == object else np.argpartition(-p, k - 1, axis=1)[:, :k] for p in lists]
                        chosen = np.zeros(other.shape, bool)
                        np.put_along_axis(chosen, np.concatenate(near, axis=1), True, axis=1)
                        chosen &= other
                    else:
                        chosen = other
                else:
                    chosen = np.zeros(other.shape, bool)
                    for p in parts:
                        chosen |= p * SITES >= limit[asks][:, None]
                    chosen &= other
                query, column = np.nonzero(chosen)
                score = sum(p[query, column] for p in parts)
                if cutoffs is not None:
                    reach = np.flatnonzero(score >= limit[asks][query])
                    query, column, score = query[reach], column[reach], score[reach]
                if len(query):
                    found.append((asks[query], own[column], score))
            if sum(len(f[0]) for f in found) > 4 * k * len(ids):
                found = [_best(k, *found)]
        if found:
            query, vec, score = _best(k, *found)
            score = [int(x) for x in score]
            if score and max(map(abs, score)) > MOST:
                raise ValueError("a score is beyond 64 bits")
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(vec), pa.array(score, pa.int64())], ["query", "vec_id", "score"])

    return run


def whole_components(vector: Column) -> Column:
    """floor(SCALE * x) of each component, or null unless all are finite."""
    real = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    large = F.raise_error(F.lit("a component is beyond 64 bits")).cast("bigint")
    return F.when(fine, F.transform(real, lambda x: F.when(F.abs(x) < 2.0**63 / SCALE, F.floor(x * SCALE)).otherwise(large)))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), whole_components(F.col(vector_col)).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    length = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x)
    rows = rows.where(F.col("vector").isNotNull() & F.col("vec_id").isNotNull()).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows.sortWithinPartitions(length.desc()), "vectors")
    facts = rows.agg(F.count_if("asks").alias("q"), F.max(F.size("vector")).alias("width")).first()
    width = max(1, facts["width"] or 0)
    most = max(1, QUERY_BYTES // (8 * width))  # queries of a chunk
    found, low = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint"), None
    for _ in range(math.ceil((facts["q"] or 0) / most)):
        asking = rows.where("asks") if low is None else rows.where(F.col("asks") & (F.col("row") > low))
        some = asking.select("row", "vec_id", "vector").orderBy("row").limit(most).toArrow().combine_chunks()
        low = some["row"][-1].as_py()
        found = found.unionAll(_of_chunk(rows.select("vec_id", "vector"), some["vec_id"].to_numpy(), _matrix(some["vector"].chunk(0), width), k))
    return found


def _of_chunk(rows: DataFrame, ids, matrix, k: int) -> DataFrame:
    """The answers of one chunk of queries."""
    spark, context = rows.sparkSession, rows.sparkSession.sparkContext
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    heads = rows.mapInArrow(_entries(context.broadcast((ids, matrix, None)), k), ENTRIES)
    cutoffs = [None] * len(ids)
    for r in heads.withColumn("rank", best).where(F.col("rank") <= k).where(F.col("rank") == k).select("query", "score").collect():  # a row for each query of the chunk
        cutoffs[r["query"]] = r["score"]
    found = rows.mapInArrow(_entries(context.broadcast((ids, matrix, cutoffs)), k), ENTRIES).withColumn("rank", best).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, i in enumerate(ids.tolist())], "query int, query_id bigint")
    return materialize(found.join(F.broadcast(names), "query").select("query_id", "rank", "vec_id", "score"), "answers")


ORACLE_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
wide AS (SELECT max(len(e)) AS w FROM v),
p AS (SELECT r, vec_id, e || list_transform(range(w - len(e)), lambda x: 0.0::DOUBLE) AS e FROM v, wide),
s AS (SELECT q.r, q.vec_id AS query_id, p.vec_id, list_inner_product(q.e, p.e)::BIGINT AS score FROM p AS q JOIN p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
