"""Best-fit packing by linear grouping: token pieces into sequences of at most ``capacity`` tokens.

Lengths are whole numbers up to the capacity, so all that the plan needs of the corpus is one count
for each length.  On those counts, whatever the number of documents:

1. pieces longer than ``capacity / small`` are put in descending order and cut into groups of equal
   cardinality; every length is rounded up to the largest of its group (linear grouping);
2. configurations of the few rounded sizes are optimised by column generation (a linear programme
   whose columns come from a knapsack), and their multiplicities rounded down;
3. actual lengths are substituted for rounded ones; what the rounding down left is packed best-fit;
4. small pieces are put best-fit into the room that is left, then into sequences of their own.

The plan is a few thousand rows (length, first rank, count, first sequence, offset).  Pieces get
ranks within their length from a window over (length, salt) plus the counts of earlier salts, so no
task holds all pieces of a common length, and each finds its place by binary search in the plan.

A null or empty text is the end token alone.  Rows with equal ids are packed as separate documents.
Only documents longer than the capacity are cut: into pieces of the capacity, after a first piece
that holds the remainder; texts of any length are taken whole.  An empty table gives an empty table.  Only the id and the text are
read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import ByteEncoder
from .store import cut, small_batches, table

CAPACITY, END = 1024, 2
_encoders: dict = {}


# ---- token pieces -------------------------------------------------------------------------------


def cut_points(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def piece_maker(path: str, ranks: str | None, pattern: str | None, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, ranks)
        encoder = _encoders.get(key) or _encoders.setdefault(key, ByteEncoder(path, ranks, pattern))
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            ids = encoder.ids([t or "" for t in batch.column(1).to_pylist()])
            for doc, data in zip(batch.column(0).to_pylist(), ids, strict=True):
                data += tail
                for k, (start, length) in enumerate(cut_points(len(data) // 4, capacity)):
                    part = data[4 * start : 4 * (start + length)]
                    rows.append((doc, k, start, length, zlib.crc32(part), part if with_ids else None))
            doc, k, start, length, crc, part = zip(*rows, strict=True) if rows else ((),) * 6
            columns = [pa.array(doc, batch.schema.field(0).type), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype("i4") for x in part], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def token_pieces(df: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, its ids."""
    small_batches(df.sparkSession)
    slim = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return slim.mapInArrow(piece_maker(path, ranks, pattern, capacity, end, with_ids), schema)


# ---- the plan, on counts of lengths -------------------------------------------------------------


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[tuple[int, ...], float]]:
    """Optimal fractional (configuration, multiplicity) pairs; a configuration counts each size."""
    k = len(sizes)
    s, d = np.array(sizes), np.array(demand, float)
    basis = np.diag(capacity // s).astype(float)  # at first, configurations of one size
    x = d / np.diag(basis)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(k))
        best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(s.min()), capacity + 1):  # unbounded knapsack; -1: carry the smaller capacity over
            fit = np.where(s <= c, best[np.maximum(c - s, 0)] + worth, -np.inf)
            j = int(fit.argmax())
            best[c], take[c] = (fit[j], j) if fit[j] > best[c - 1] + 1e-12 else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if take[c] < 0:
                c -= 1
            else:
                column[take[c]] += 1
                c -= s[take[c]]
        step = np.linalg.solve(basis, column)
        able = step > 1e-9
        if not able.any():
            break
        ratio = np.where(able, np.maximum(x, 0) / np.where(able, step, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        basis[:, out] = column
    return [(tuple(int(v) for v in basis[:, j]), float(x[j])) for j in range(k) if x[j] > 1e-9]


class Bins:
    """Runs of equal sequences: room left -> [(count, lengths)]."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room = capacity, defaultdict(list)

    def add(self, count: int, lengths: tuple[int, ...]) -> None:
        if count:
            self.by_room[self.capacity - sum(lengths)].append((count, lengths))

    def best_fit(self, length: int, n: int) -> None:
        while n:
            room = next((r for r in range(length, self.capacity + 1) if self.by_room.get(r)), None)
            if room is None:
                each = self.capacity // length
                self.add(n // each, (length,) * each)
                self.add(min(1, n % each), (length,) * (n % each))
                return
            count, lengths = self.by_room[room].pop()
            used = min(n, count)
            self.add(count - used, lengths)
            self.add(used, (*lengths, length))
            n -= used


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 96, small: int = 8) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, count, first sequence, offset) that place every piece once."""
    bins, bound = Bins(capacity), capacity // small
    bins.add(counts.get(capacity, 0), (capacity,))
    large = [(n, counts[n]) for n in sorted(counts, reverse=True) if bound < n < capacity]
    many = sum(c for _, c in large)
    if many:
        each = -(-many // groups) if len(large) > groups else 0
        grouped: list[list[list[int]]] = [[]]
        room = each
        for length, c in large:  # equal cardinality, or one group for each length if there are few
            if not each:
                grouped.append([[length, c]])
                continue
            while c:
                t = min(c, room)
                grouped[-1].append([length, t])
                c, room = c - t, room - t
                if not room:
                    grouped.append([])
                    room = each
        grouped = [g for g in grouped if g]
        merged: dict[int, list[list[int]]] = {}
        for g in grouped:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = sorted(merged, reverse=True)
        left = {s: merged[s] for s in sizes}
        demand = [sum(c for _, c in left[s]) for s in sizes]
        for config, x in configurations(sizes, demand, capacity):
            times = int(x + 1e-6)
            slots = [s for s, n in zip(sizes, config, strict=True) for _ in range(n)]
            while slots and times:
                need = min(times, *(sum(c for _, c in left[s]) // slots.count(s) for s in set(slots)))
                times = 0
                taken = []
                for s in slots:
                    runs, n = [], need
                    while n:
                        run = left[s][0]
                        t = min(n, run[1])
                        runs.append([run[0], t])
                        run[1] -= t
                        n -= t
                        if not run[1]:
                            left[s].pop(0)
                    taken.append(runs)
                n = need
                while n:  # sequences with equal actual lengths are one run
                    t = min(runs[0][1] for runs in taken)
                    bins.add(t, tuple(runs[0][0] for runs in taken))
                    for runs in taken:
                        runs[0][1] -= t
                        if not runs[0][1]:
                            runs.pop(0)
                    n -= t
        rest = [run for s in sizes for run in left[s] if run[1]]
        for length, c in sorted(rest, reverse=True):
            bins.best_fit(length, c)
    for length in sorted((n for n in counts if n <= bound), reverse=True):
        bins.best_fit(length, counts[length])
    rows, rank, sequence = [], defaultdict(int), 0
    for room in sorted(bins.by_room):
        for count, lengths in bins.by_room[room]:
            at = 0
            for length in lengths:
                rows.append((length, rank[length], count, sequence, at))
                rank[length] += count
                at += length
            sequence += count
    return sorted(rows)


# ---- places -------------------------------------------------------------------------------------


def placer(rows: list[tuple[int, int, int, int, int]]):
    p = np.array(rows, dtype=np.int64).reshape(-1, 5)
    key = (p[:, 0] << 48) + p[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            i = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            names = [n for n in batch.schema.names if n != "_rank"]
            made = [pa.array(p[i, 3] + rank - p[i, 1]), pa.array(p[i, 4])]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *made], [*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = 96, pieces_per_salt: int = 1_000_000) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``.  Reads ``pieces`` thrice: give it a written table."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    salts = max(16, math.ceil(sum(counts.values()) / pieces_per_salt))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    running = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "_salt").count().select("length", "_salt", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("_before"))
    local = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_local", F.row_number().over(local)).join(before, ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_local") - 1).cast("long").alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(placer(plan(counts, capacity, groups)), schema)


def pack_documents(df: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, with_ids: bool = True, **options) -> DataFrame:
    """Token pieces of ``df`` and their places."""
    pieces = cut(token_pieces(df, path, ranks, pattern, with_ids=with_ids, **options), "pieces")
    return pack(pieces, options.get("capacity", CAPACITY))


def public_bpe() -> dict:
    """Arguments that name the byte-level vocabulary and its rank table."""
    import public_tokenizers as P

    return {"path": P.path("byte_bpe_50k.json"), "ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def op5_best_fit_packing(spark, sf_dir):
    """Every document's pieces and places; the ids themselves are digested where they are made."""
    return pack_documents(table(spark, sf_dir, "documents"), **public_bpe(), with_ids=False)


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLES: dict[str, str] = {}
