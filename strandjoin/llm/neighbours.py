"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

Vectors are scaled to length one, where Euclidean distance falls as the cosine grows.  Each of ``tables``
hash tables has ``hashes`` functions floor((a.v + b) / width) with Gaussian a (2-stable).  A query visits
its own bucket and ``probes`` perturbed ones of each table, in the order of estimated success: the sum of
squared distances from the query's projections to the sides it crosses, generated by a heap of
perturbation sets (shift and expand).  Buckets rank their vectors by exact cosine for the queries that
visit them, and the tables' candidates are merged and ranked exactly in double precision.

Equal vectors form a class that is indexed and searched once, however many rows it has; the few
smallest ids of each class stand for it in results.  A bucket's rows, and the queries that visit it, are salted into blocks of at most
about ``block`` vectors, so no task holds a hot bucket or all of its queries, and no candidate is dropped.  Each block returns the best
few of each query only, so what leaves the buckets grows with the queries and not with bucket sizes.  Ties, to twelve digits, go to the class
with the smaller least id.
Queries that found too few candidates are searched exactly, against all rows, in blocks.

Nothing is fitted: projections depend on a seed and the dimension only.  On structureless vectors (as
random ones) recall needs many probes; ``recall`` measures it against brute force.

Null vectors, zero vectors and vectors with null or non-finite components take no part; vectors of
another dimension are never compared.  Rows with a null id take no part.  Repeated rows (same id, same
vector) count once.  An empty table gives an empty table, and one with a single vector too.  Only the id and the vector are read, so other columns
cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, ship, table

TABLES, HASHES, WIDTH, PROBES, BLOCK, SEED = 6, 4, 1.3, 26, 4096, 7


def projections(dim: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([SEED, dim]))
    return rng.standard_normal((dim, tables * hashes)), rng.random(tables * hashes) * width


def slots(v: np.ndarray, tables: int, hashes: int, width: float) -> np.ndarray:
    """Positions of unit vectors on the hash lines, in units of the width: floor gives the bucket."""
    a, b = projections(v.shape[1], tables, hashes, width)
    return ((v @ a + b) / width).reshape(len(v), tables, hashes)


def bucket_key(cells: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row of cell numbers."""
    h = np.zeros(cells.shape[:-1], dtype=np.uint64)
    for k in range(cells.shape[-1]):
        h = (h ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def perturbations(inside: np.ndarray, probes: int) -> Iterator[list[tuple[int, int]]]:
    """Sets of (function, -1 or 1) in increasing order of score, for one query and table.

    inside: where the query stands within its cell, 0 to 1, for each function.
    """
    moves = sorted([(x * x, k, -1) for k, x in enumerate(inside)] + [((1 - x) ** 2, k, 1) for k, x in enumerate(inside)])
    heap, made = [(moves[0][0], (0,))], 0
    while heap and made < probes:
        score, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(moves):
            step = moves[last + 1][0]
            heapq.heappush(heap, (score - moves[last][0] + step, (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + step, (*chosen, last + 1)))
        used = [moves[i][1] for i in chosen]
        if len(set(used)) == len(used):  # not both sides of one function
            made += 1
            yield [moves[i][1:] for i in chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) -> (id, dim, key, vec): vectors as bytes of doubles, keyed by a digest; bad ones are left out."""
    import xxhash

    for batch in batches:
        rows = []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or not v or None in v:
                continue
            x = np.asarray(v, dtype=np.float64) + 0.0  # -0.0 and 0.0 are equal
            if np.isfinite(x).all() and x.any():
                rows.append((i, len(v), xxhash.xxh3_128_digest(x.tobytes()), x.tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["id", "dim", "key", "vec"])


def unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(axis=1, keepdims=True)
    v = v / big
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def indexer(tables: int, hashes: int, width: float, probes: int | None):
    """(id, dim, vec) -> one row for each table (index), or for each table and probe (queries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                at = slots(unit(_matrix(part.column("vec"))), tables, hashes, width)
                cells = np.floor(at).astype(np.int64)
                if probes is None:
                    keys, row = bucket_key(cells).ravel(), np.repeat(np.arange(len(part)), tables)
                    which = np.tile(np.arange(tables), len(part))
                else:
                    found, row, which = [], [], []
                    for i in range(len(part)):
                        for t in range(tables):
                            for moves in [[], *perturbations(at[i, t] - cells[i, t], probes)]:
                                c = cells[i, t].copy()
                                for k, d in moves:
                                    c[k] += d
                                found.append(c), row.append(i), which.append(t)
                    keys, row, which = bucket_key(np.array(found)), np.array(row), np.array(which)
                for s in range(0, len(row), 20_000):
                    r = pa.array(row[s : s + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array(which[s : s + 20_000].astype(np.int32)), pa.array(keys[s : s + 20_000]), *[part.column(c).take(r) for c in ("dim", "id", "head", "vec")]], ["t", "bucket", "dim", "id", "head", "vec"])

    return run


def ranker(keep: int):
    """A block's vectors and the queries that visit it -> each query's best ``keep``."""

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"q": [], "id": [], "head": [], "score": []}
        if len(index) and len(queries):
            v, ids, heads = _matrix(index.column("vec")), index.column("id").to_numpy(), index.column("head").to_numpy()
            order = np.lexsort((ids, heads))
            v, ids, heads = v[order], ids[order], heads[order]
            norm = np.sqrt((v * v).sum(axis=1))
            q, qid = _matrix(queries.column("vec")), queries.column("id").to_numpy()
            for s in range(0, len(q), 256):
                score = (q[s : s + 256] @ v.T) / np.sqrt((q[s : s + 256] ** 2).sum(axis=1))[:, None] / norm
                n = min(keep, len(ids))
                best = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < len(ids) else np.tile(np.arange(n), (len(score), 1))
                # Ties at the edge go to smaller least ids, as everywhere: all that reach the last score compete.
                edge = np.take_along_axis(score, best, 1).min(axis=1) - 1e-12
                for i in range(len(score)):
                    able = np.flatnonzero(score[i] >= edge[i])
                    able = able[np.lexsort((able, -np.round(score[i, able], 12)))][:n] if len(able) > n else able
                    out["q"].append(np.full(len(able), qid[s + i])), out["id"].append(ids[able]), out["head"].append(heads[able]), out["score"].append(score[i, able])
        flat = lambda k, kind: pa.array(np.concatenate(out[k]) if out[k] else np.array([], kind))
        return pa.table({"q": flat("q", np.int64), "id": flat("id", np.int64), "head": flat("head", np.int64), "score": flat("score", np.float64)})

    return run


def exact_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosine of each pair alone, so that a score does not depend on the block that found it."""
    for batch in batches:
        score = []
        for a, b in zip(batch.column("q_vec").to_pylist(), batch.column("vec").to_pylist(), strict=True):
            x, y = np.frombuffer(a), np.frombuffer(b)
            x, y = (x, y) if max(np.abs(x).max(), np.abs(y).max()) < 1e100 and min(np.abs(x).max(), np.abs(y).max()) > 1e-100 else (x / np.abs(x).max(), y / np.abs(y).max())
            score.append(float(np.dot(x, y)) / (float(np.sqrt(np.dot(x, x))) * float(np.sqrt(np.dot(y, y)))))
        names = [n for n in batch.schema.names if n not in ("q_vec", "vec")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(score, pa.float64())], [*names, "score"])


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    best = Window.partitionBy("q").orderBy(F.desc("score"), "head", "id")
    each = found.groupBy("q", "id", "head").agg(F.round(F.max("score"), 12).alias("score"))
    return each.withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep).drop("r")


def _dealt(rows: DataFrame, block: int, parts: str, salt: str) -> tuple[DataFrame, DataFrame, bool]:
    """Adds ``parts``, the number of blocks that the rows of (t, bucket, dim) make up, and ``salt``, the block of each row.

    The rows stay where they are: only the table of crowded buckets moves, which has at most rows / block rows.
    """
    key = ["t", "bucket", "dim"]
    crowded = cut(rows.groupBy(*key).count().where(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias(parts)), "crowded")
    few = crowded.limit(1_000_001).count() <= 1_000_000  # 20 bytes each
    joined = rows.join(F.broadcast(crowded) if few else crowded, key, "left").withColumn(parts, F.coalesce(parts, F.lit(1)))
    return joined.withColumn(salt, F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")), crowded.withColumnRenamed(parts, f"other_{parts}"), few


def _search(index: DataFrame, probes: DataFrame, keep: int, block: int) -> DataFrame:
    """Candidates from equal (t, bucket, dim); crowded buckets, and the queries of much visited ones, are dealt into blocks."""
    key = ["t", "bucket", "dim"]
    index, many_rows, few_rows = _dealt(index, block, "rows", "i")
    probes, many_probes, few_probes = _dealt(probes, block, "visits", "j")
    every = lambda df, crowded, few, parts, name: df.join(F.broadcast(crowded) if few else crowded, key, "left").withColumn(name, F.explode(F.sequence(F.lit(0), F.coalesce(f"other_{parts}", F.lit(1)) - 1)))
    cols = [*key, "i", "j", "id", "head", "vec"]
    left = every(index, many_probes, few_probes, "visits", "j").select(*cols).groupBy(*key, "i", "j")
    right = every(probes, many_rows, few_rows, "rows", "i").select(*cols).groupBy(*key, "i", "j")
    return left.cogroup(right).applyInArrow(ranker(keep), "q long, id long, head long, score double")


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found; ``is_query`` is a condition on the id column."""
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    rows = cut(rows.mapInArrow(clean, "id long, dim int, key binary, vec binary").withColumnRenamed("id", id_col).withColumn("is_query", is_query).withColumnRenamed(id_col, "id"), "vectors")
    order = Window.partitionBy("key", "dim").orderBy("id")
    members = cut(rows.select("key", "dim", "id").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("key", "dim", "id"), "members")
    heads = members.groupBy("key", "dim").agg(F.min("id").alias("head"))
    # A head is named by its smallest id; one id with several vectors is several heads, so heads get numbers.
    heads = cut(heads.join(rows.select("key", "dim", "vec"), ["key", "dim"]).dropDuplicates(["key", "dim"]).select("key", "dim", "head", "vec", F.xxhash64("key", "dim").alias("id")), "heads")
    queries = cut(rows.where("is_query").select("key", "dim", F.col("id").alias("query_id")).distinct(), "queries")
    asked = cut(heads.join(queries.select("key", "dim").distinct(), ["key", "dim"]).select("id", "head", "dim", "vec"), "asked")
    made = "t int, bucket long, dim int, id long, head long, vec binary"
    by_id = heads.select("id", "head", "dim", "vec")
    index = by_id.mapInArrow(indexer(tables, hashes, width, None), made)
    visits = asked.mapInArrow(indexer(tables, hashes, width, probes), made)
    few = k + 1
    found = cut(_ranked(_search(index, visits, few, block), few), "found")
    # Queries with fewer classes than there could be are searched exactly.
    per_dim = by_id.groupBy("dim").agg(F.least(F.count("*"), F.lit(few)).alias("could"), F.ceil(F.count("*") / block).alias("blocks"))
    poor = asked.join(found.groupBy(F.col("q").alias("id")).agg(F.count("*").alias("got")), "id", "left").join(F.broadcast(per_dim), "dim")  # one row for each dimension
    poor = cut(poor.where(F.coalesce("got", F.lit(0)) < F.col("could")).select("id", "head", "dim", "vec", "blocks"), "poor")
    if not poor.isEmpty():
        dealt = by_id.join(F.broadcast(per_dim), "dim").select(F.lit(-1).alias("t"), F.pmod(F.xxhash64("id"), F.col("blocks")).alias("bucket"), "dim", "id", "head", "vec")
        all_blocks = poor.select(F.lit(-1).alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("bucket"), "dim", "id", "head", "vec")
        found = cut(_ranked(found.unionByName(_search(dealt, all_blocks, few, 2 * block)), few), "found")
    names = heads.select(F.col("id"), F.col("key").alias("c_key"), F.col("dim").alias("c_dim"), "vec")
    asked_key = heads.select(F.col("id").alias("q"), "key", "dim", F.col("vec").alias("q_vec"))
    exact = found.select("q", "id").join(names, "id").join(asked_key, "q").select("key", "dim", "c_key", "c_dim", "q_vec", "vec")
    exact = exact.mapInArrow(exact_scores, "key binary, dim int, c_key binary, c_dim int, score double")
    pairs = exact.join(members.select(F.col("key").alias("c_key"), F.col("dim").alias("c_dim"), F.col("id").alias("vec_id")), ["c_key", "c_dim"])
    pairs = pairs.join(queries, ["key", "dim"]).where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true (query_id, vec_id) pairs that were found."""
    n = truth.count()
    return 1.0 if not n else found.join(truth, ["query_id", "vec_id"], "left_semi").count() / n


def op8_multiprobe_ann(spark, sf_dir):
    """Five nearest of every 50th vector among all vectors."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op8_multiprobe_ann": op8_multiprobe_ann}
ORACLES: dict[str, str] = {}
