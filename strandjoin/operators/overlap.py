"""The best overlap of each pair, and what follows from it: the merged read and the places of trimming.

``d`` is where the reverse-complemented second read starts relative to the first base of the first.  Every
shift from nF-1 down to -(nR-1) is scored over its overlap; the best positive score wins and, among
equals, the largest d.  Scores are rounded to nine digits before they are compared, so that engines
that sum in another order agree on ties.

``native`` makes a row for each compared pair of bases and aggregates, in generated code; ``arrow`` scores
batches of pairs of equal lengths with numpy tables, is narrow (no shuffle) and is the faster one.  It also builds the consensus and finds
where reads are trimmed, in the same pass, so that no later filter can make Spark compute them twice.  Pairs
without a positive score have null results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, sequence
from ..functions.scoring import BaseFrequencies, ScoreTable
from ..plans.params import MergeParams
from ..shipping import ship
from . import consensus, trim

DIGITS = 9
FIELDS = "d int, overlap int, asm_len int, score double, oes double"
MERGED = "m_seq string, m_qual string, f_keep int, r_from int"
WORK = 4_000_000  # base pairs that a step of the numpy engine holds


def prepared(pairs: DataFrame, params: MergeParams) -> DataFrame:
    """Pairs with the second read reverse-complemented; missing texts are empty."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("f_seq", "f_qual", "r_seq", "r_qual")}
    if params.normalise_case:
        text["f_seq"], text["r_seq"] = F.upper(text["f_seq"]), F.upper(text["r_seq"])
    return pairs.withColumns(text).withColumns({"r_seq": sequence.reverse_complement("r_seq"), "r_qual": F.reverse("r_qual")})


# ---- native ---------------------------------------------------------------------------------------


def best_overlap_native(ready: DataFrame, params: MergeParams, freqs: BaseFrequencies) -> DataFrame:
    """One row for each compared pair of bases, summed for each shift; ``row_id`` names a pair.

    The pairs are dealt by ``row_id`` once, which serves both aggregates and the join, so the many rows made
    from them never leave their tasks.
    """
    ready = ready.repartition(int(ready.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row_id")  # a fixed number is not coalesced
    n_f, n_r, d, k = F.length("f_seq"), F.length("r_seq"), F.col("d"), F.col("_k")
    i, j = F.greatest(d, F.lit(0)), F.greatest(-d, F.lit(0))
    shifts = ready.where((n_f > 0) & (n_r > 0)).select("row_id", "f_seq", "f_qual", "r_seq", "r_qual", F.explode(F.sequence(1 - n_r, n_f - 1)).alias("d"))
    bases = shifts.select("*", F.explode(F.sequence(F.lit(0), F.least(n_f, d + n_r) - i - 1)).alias("_k"))
    char = lambda c, at: sequence.at(c, at + k)
    ex, ey = (sequence.error_probability(char(c, at), params.phred_base) for c, at in (("f_qual", i), ("r_qual", j)))
    # Generators of one row keep the letters and shares from being written out at each mention, which
    # would make the generated method too long to be compiled.
    named = lambda **c: F.inline(F.array(F.struct(*[v.alias(n) for n, v in c.items()])))
    each = bases.select("row_id", "d", named(x=char("f_seq", i), y=char("r_seq", j), ex=ex, ey=ey))
    each = each.select("*", named(px=scoring.share(F.col("x"), freqs), py=scoring.share(F.col("y"), freqs)))
    score, oes = scoring.pair_score(*map(F.col, ("x", "y", "ex", "ey")), params.score_method, freqs, F.col("px"), F.col("py"))
    each = each.select("row_id", "d", score.alias("score"), oes.alias("oes"))
    total = each.groupBy("row_id", "d").agg(F.round(F.sum("score"), DIGITS).alias("score"), F.round(F.sum("oes"), DIGITS).alias("oes"), F.count("*").cast("int").alias("overlap"))
    best = total.where("score > 0").groupBy("row_id").agg(F.max(F.struct("score", "d", "overlap", "oes")).alias("_b"))  # ordered by score, then d
    out = ready.join(best.hint("shuffle_hash"), "row_id", "left")
    return out.select(*ready.columns, "_b.d", "_b.overlap", (F.col("_b.d") + n_r).alias("asm_len"), "_b.score", "_b.oes")


# ---- numpy ----------------------------------------------------------------------------------------


def letters(column: pa.Array, rows: np.ndarray, n: int) -> np.ndarray:
    """The characters of texts of equal length as a matrix of codes."""
    data = "".join(column.take(pa.array(rows)).to_pylist())
    codes = np.frombuffer(data.encode(), dtype=np.uint8) if data.isascii() else np.frombuffer(data.encode("utf-32-le"), dtype="<u4")
    return codes.reshape(len(rows), n)


def texts(codes: np.ndarray) -> list[str]:
    """The rows of a matrix of character codes."""
    n, width = codes.shape
    data = codes.astype(np.uint8).tobytes().decode("ascii") if codes.max(initial=0) < 128 else codes.astype("<u4").tobytes().decode("utf-32-le")
    return [data[k * width : (k + 1) * width] for k in range(n)]


class Group:
    """Pairs of one batch with equal lengths, as matrices of letters, qualities and table codes."""

    def __init__(self, batch: pa.RecordBatch, rows: np.ndarray, n_f: int, n_r: int, table: ScoreTable):
        self.rows, self.n_f, self.n_r = rows, n_f, n_r
        self.x, self.y = letters(batch.column("f_seq"), rows, n_f), letters(batch.column("r_seq"), rows, n_r)
        self.qx, self.qy = letters(batch.column("f_qual"), rows, n_f), letters(batch.column("r_qual"), rows, n_r)
        self.a, self.b = table.codes(self.x, self.qx), table.codes(self.y, self.qy)

    def span(self, d: int) -> tuple[slice, slice]:
        ol = min(self.n_f, d + self.n_r) - max(0, d)
        return slice(max(d, 0), max(d, 0) + ol), slice(max(-d, 0), max(-d, 0) + ol)

    def best(self, table: ScoreTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(d, score, oes) for each pair; score 0 where no shift is positive."""
        n = len(self.rows)
        best, at = np.zeros(n), np.zeros(n, dtype=np.int64)
        for d in range(self.n_f - 1, -self.n_r, -1):
            i, j = self.span(d)
            score = np.round(table.lookup(table.score, self.a[:, i], self.b[:, j], self.x[:, i], self.y[:, j]).sum(axis=1), DIGITS)
            better = score > best
            best[better], at[better] = score[better], d
        oes = np.zeros(n)
        for d, here in self.by_shift(at, best > 0):
            i, j = self.span(d)
            oes[here] = np.round(table.lookup(table.oes, self.a[here, i], self.b[here, j], self.x[here, i], self.y[here, j]).sum(axis=1), DIGITS)
        return at, best, oes

    def by_shift(self, at: np.ndarray, found: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for d in np.unique(at[found]):
            yield int(d), np.flatnonzero((at == d) & found)

    def merged(self, at: np.ndarray, found: np.ndarray, base: int) -> Iterator[tuple[np.ndarray, list[str], list[str]]]:
        """(rows of the batch, merged reads, their qualities) for each shift."""
        for d, here in self.by_shift(at, found):
            i, j = self.span(d)
            middle = consensus.matrices(self.x[here, i], self.y[here, j], self.qx[here, i], self.qy[here, j], base)
            ends = ((self.x, self.y), (self.qx, self.qy))
            whole = [np.concatenate([f[here, : i.start], m, r[here, j.stop :]], axis=1) for m, (f, r) in zip(middle, ends, strict=True)]
            yield self.rows[here], *map(texts, whole)


def by_length(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for n in np.unique(lengths[lengths > 0]):
        yield int(n), np.flatnonzero(lengths == n)


def groups(batch: pa.RecordBatch, n_f: np.ndarray, n_r: np.ndarray, table: ScoreTable) -> Iterator[Group]:
    """The pairs of a batch, dealt by lengths and into steps of bounded work.  Pairs with an empty read are left out."""
    code = n_f * (n_r.max(initial=0) + 1) + n_r
    for c in np.unique(code):
        rows = np.flatnonzero(code == c)
        a, b = int(n_f[rows[0]]), int(n_r[rows[0]])
        if not a or not b:
            continue
        step = max(1, WORK // min(a, b))
        for s in range(0, len(rows), step):
            yield Group(batch, rows[s : s + step], a, b, table)


def overlap_finder(params: MergeParams, freqs: BaseFrequencies, whole: bool):
    """whole: with the merged read and the places of trimming."""
    base, low = params.phred_base, params.quality_threshold
    tested = "f_seq" if params.compat == "reference" else "f_qual"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ScoreTable(params.score_method, freqs, base)
        for batch in batches:
            n = len(batch)
            n_f, n_r = (np.array([len(s) for s in batch.column(c).to_pylist()], dtype=np.int64) for c in ("f_seq", "r_seq"))
            d, ol, asm, score, oes, found = (np.zeros(n) for _ in range(6))
            m_seq: list[str | None] = [None] * n
            m_qual: list[str | None] = [None] * n
            for g in groups(batch, n_f, n_r, table):
                gd, gs, go = g.best(table)
                r = g.rows
                d[r], score[r], oes[r], found[r] = gd, gs, go, gs > 0
                ol[r] = np.minimum(g.n_f, gd + g.n_r) - np.maximum(gd, 0)
                asm[r] = gd + g.n_r
                for at, seqs, quals in g.merged(gd, gs > 0, base) if whole else ():
                    for k, s, q in zip(at.tolist(), seqs, quals, strict=True):
                        m_seq[k], m_qual[k] = s, q
            none = found == 0
            out = {name: pa.array(v.astype(np.int32), mask=none) for name, v in (("d", d), ("overlap", ol), ("asm_len", asm))}
            out |= {"score": pa.array(score, mask=none), "oes": pa.array(oes, mask=none)}
            if whole:
                keep, start = n_f.copy(), np.zeros(n, dtype=np.int64)
                if low > 0 or params.compat == "reference":  # no valid quality is below 0, but a letter may be
                    for k, rows in by_length(n_f):
                        keep[rows] = trim.first_low_pair(letters(batch.column(tested), rows, k), low, base)
                if low > 0:
                    for k, rows in by_length(n_r):
                        start[rows] = trim.last_low_pair(letters(batch.column("r_qual"), rows, k), low, base)
                out |= {"m_seq": pa.array(m_seq, pa.string()), "m_qual": pa.array(m_qual, pa.string())}
                out |= {"f_keep": pa.array(keep.astype(np.int32)), "r_from": pa.array(start.astype(np.int32))}
            yield pa.RecordBatch.from_arrays([*batch.columns, *out.values()], [*batch.schema.names, *out])

    return run


def fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _arrow(ready: DataFrame, params: MergeParams, freqs: BaseFrequencies, whole: bool) -> DataFrame:
    ship(ready.sparkSession)
    schema = [fields(ready), FIELDS, *[MERGED] * whole]
    return ready.mapInArrow(overlap_finder(params, freqs, whole), ", ".join(schema))


def best_overlap(ready: DataFrame, params: MergeParams, freqs: BaseFrequencies, engine: str = "arrow") -> DataFrame:
    """``ready`` (see ``prepared``) with d, overlap, asm_len, score and oes."""
    if engine == "native":
        return best_overlap_native(ready, params, freqs)
    if engine != "arrow":
        raise ValueError("engine is 'arrow' or 'native'")
    return _arrow(ready, params, freqs, False)


def assembled(ready: DataFrame, params: MergeParams, freqs: BaseFrequencies, engine: str = "arrow") -> DataFrame:
    """``best_overlap`` with m_seq, m_qual (uncapped; null where no overlap was found), f_keep and r_from (for a pair that is not merged)."""
    if engine == "arrow":
        return _arrow(ready, params, freqs, True)
    found = consensus.merged(best_overlap(ready, params, freqs, engine), params)
    base, low = params.phred_base, params.quality_threshold
    return found.withColumns({
        "f_keep": trim.forward_length(F.col("f_seq"), F.col("f_qual"), low, base, params.compat),
        "r_from": trim.reverse_start(F.col("r_seq"), F.col("r_qual"), low, base),
    })
