"""The block plan that vector searches share: every index block is built once, numbered query blocks are sent to it, and the k best rows a query are merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.common import Scratch, lean, ship

ship(__name__)

#: Rows of an index block and of a query block, on average and at most: both bound a task's memory.
BLOCK_ROWS, QUERY_ROWS = 8192, 512


def clean(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows whose id and vector are not null and whose vector holds one finite component or more and no other, as (id, v array<double>)."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)


def matrices(batch: pa.RecordBatch):
    """(d, ids, rows) of a batch of (id, v), one for each length of vectors."""
    ids = np.asarray(batch.column("id").to_numpy(zero_copy_only=False), np.int64)
    vec = batch.column("v")
    flat, n = vec.flatten().to_numpy(zero_copy_only=False), vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(n) - n
    for d in np.unique(n):
        own = np.flatnonzero(n == d)
        yield int(d), ids[own], flat[at[own][:, None] + np.arange(d)]


def packed(batches):
    """Rows (id, v) -> blocks (q binary, qv binary, d int) of at most QUERY_ROWS rows with vectors of one length."""

    def blob(d, ids, vecs):
        return pa.RecordBatch.from_pydict({"q": [ids.tobytes()], "qv": [vecs.astype(np.float64).tobytes()], "d": pa.array([d], pa.int32())})

    for b in batches:
        for d, ids, vecs in matrices(b):
            for i in range(0, len(ids), QUERY_ROWS):
                yield blob(d, ids[i : i + QUERY_ROWS], vecs[i : i + QUERY_ROWS])


def searched(scratch: Scratch, vectors: DataFrame, queries: DataFrame, search, k: int, score: str) -> DataFrame:
    """search(ids, rows) -> find; find(query ids, query rows) -> (query id, ids, scores) a query. The k best rows of each query over all blocks are returned.

    vectors, queries: (id, v); query ids that repeat are one query (its smallest vector). Rows are dealt by a hash of their id to numbered index blocks of about
    BLOCK_ROWS, and the blocks of queries, the smaller side, go once to each number: one shuffle by number, nothing is broadcast. Rows arrive sorted, a block's vectors before its queries,
    so a task holds one index block, builds its index once, and then one query block at a time. Rows that share an id are in one block. A block returns at most k rows a query, and only
    those reach the last shuffle. Vectors of another length than the query's take no part.
    """
    n = max(1, -(-vectors.count() // BLOCK_ROWS))
    q = queries.groupBy("id").agg(F.min("v").alias("v"))
    qs = scratch.write(q.mapInArrow(lean(packed), "q binary, qv binary, d int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    ix = vectors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    none = F.lit(None)
    rows = ix.select("part", F.lit(0).alias("kind"), "id", "v", none.cast("binary").alias("q"), none.cast("binary").alias("qv"), none.cast("int").alias("d"))
    rows = rows.union(qs.select("part", F.lit(1), none.cast("long"), none.cast("array<double>"), "q", "qv", "d")).repartition("part").sortWithinPartitions("part", "kind")

    def run(batches):
        at, held, index = None, {}, {}
        for b in batches:
            part, kind = b.column("part").to_numpy(), b.column("kind").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])]))
            for lo, hi in zip(edge, np.append(edge[1:], len(part))):
                if part[lo] != at:
                    at, held, index = part[lo], {}, {}
                own = b.slice(lo, hi - lo)
                if kind[lo] == 0:
                    for d, ids, vecs in matrices(own):
                        held.setdefault(d, []).append((ids, vecs))
                    continue
                for i in range(len(own)):
                    d = own.column("d")[i].as_py()
                    if d in held:
                        ids, vecs = zip(*held.pop(d))
                        index[d] = search(np.concatenate(ids), np.concatenate(vecs).astype(np.float64))
                    if d not in index:
                        continue
                    q, qv = (np.frombuffer(own.column(c)[i].as_buffer(), t) for c, t in (("q", np.int64), ("qv", np.float64)))
                    out = [(np.full(len(c), a), np.asarray(c, np.int64), np.asarray(s)) for a, c, s in index[d](q, qv.reshape(-1, d))]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "vec_id", "score"])

    found = rows.mapInArrow(lean(run), f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
