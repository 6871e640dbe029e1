"""MinHash near-deduplication with odd sketches.

Documents are sets of distinct 4-word shingles (64-bit hashes of lower-cased words).  Documents with
equal sets form a class, so exact copies cost one row each and no pairs.  For each class:

* ``BANDS`` x ``ROWS`` MinHash values give band keys.  At a similarity of 0.8 a pair shares no band
  with probability (1 - 0.8^5)^32 = 3e-6;
* the samples (position, MinHash value) are folded into a parity bitmap, the odd sketch: each flips
  one bit.  The exclusive-or of two sketches has a bit for each sample that only one of them has (but
  for collisions), so its population count estimates a high similarity precisely: 1 + n/(4k) ln(1 - 2c/n).

Candidates are verified on the full sets, read again from the texts of the classes concerned.

Pairs within a bucket grow with the square of its size, so they are not made at once.  First each
member is compared with the least class of its bucket.  Components of the links found are merged, and
only buckets in which several components meet are looked at again (those of a few bands first): there,
members are dealt into blocks by size class and hash, and blocks are compared by sketch, two to a task, leaving out blocks whose
sizes cannot reach the threshold.  Members with a candidate in another component are joined with their
texts, and the task verifies the candidates, likely ones first, until their components are joined or none
is left.  It returns a forest of links, never pairs of a whole group.
Copies of one text thus cost one comparison each, and no bucket is capped.

The sketch rules a pair out if its estimate is below the threshold by ``MARGIN``, which is more than five
standard deviations of the estimate.  Components come from alternating minimum-label steps, with every
round written to the shared folder.

A null text, or one without words, has an empty set and is linked with nothing.  Rows with one id are
one document if their sets are equal; otherwise each row keeps its set size and the id has one component.
A null id takes part in no link and has a null component.  An empty table gives an empty table, and very long texts are taken whole.
Only the id and the outputs are returned, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, drop, small_batches, table

SHINGLE, BANDS, ROWS, BITS, MARGIN, SEED = 4, 32, 5, 512, 0.22, 20240229
BLOCK = 2_000_000  # shingles, and 500 for each set, of the sets of a block
HELD = 500_000  # candidate pairs that a task sorts at once
EARLY = 4
EMPTY_KEY = b""


# ---- sets, signatures and sketches --------------------------------------------------------------


def word_hashes(data: bytes) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, data.split()), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; bytes.split() cuts at just the contract's six separators."""
    w = word_hashes((text or "").encode().lower())
    if not len(w):
        return w
    n = min(size, len(w))
    h = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k] + np.uint64(n))
    return np.unique(h)


def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    return rng.integers(0, 2**64, k, dtype=np.uint64), rng.integers(0, 2**64, k, dtype=np.uint64) | np.uint64(1)


def minhash(h: np.ndarray, xor: np.ndarray, odd: np.ndarray, step: int = 256) -> np.ndarray:
    """One minimum for each (xor, odd); long sets in steps, in two buffers that fit a core's cache."""
    out = np.full(len(xor), np.uint64(2**64 - 1))
    v = np.empty((len(xor), min(step, len(h))), np.uint64)
    w = np.empty_like(v)
    for i in range(0, len(h), step):
        part = h[None, i : i + step]
        x, y = v[:, : part.shape[1]], w[:, : part.shape[1]]
        np.bitwise_xor(part, xor[:, None], out=x)
        np.multiply(x, odd[:, None], out=x)
        np.right_shift(x, np.uint64(32), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint64(0x9E3779B97F4A7C15), out=x)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def odd_sketch(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity of the samples that fall on each bit, as 64-bit words."""
    at = mix(samples + np.arange(len(samples), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def estimate(differing: np.ndarray, bits: int, k: int) -> np.ndarray:
    """Similarity from the population count of the exclusive-or of two odd sketches."""
    x = np.minimum(2.0 * differing / bits, 1 - 1e-9)
    return 1 + bits / (4.0 * k) * np.log(1 - x)


def most_differing(threshold: float, margin: float, bits: int, k: int) -> int:
    """The largest population count whose estimate is not below threshold - margin."""
    return int(bits / 2 * (1 - math.exp(4 * k / bits * (threshold - margin - 1))))


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def signer(shingle: int, bands: int, rows: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        xor, odd = _seeds(bands * rows)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            n, key, band, sketch = [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_set(text, shingle)
                n.append(len(h))
                if not len(h):
                    key.append(EMPTY_KEY), band.append(None), sketch.append(None)
                    continue
                key.append(xxhash.xxh3_128_digest(h.tobytes()))
                m = minhash(h, xor, odd)
                sketch.append(odd_sketch(m, bits))
                b = salt.copy()
                for column in m.reshape(bands, rows).T:
                    b = mix(b * np.uint64(0x9E3779B97F4A7C15) + column)
                band.append(b.view(np.int64))
            yield _batch({"id": batch.column(0), "n": pa.array(n, pa.int64()), "key": pa.array(key, pa.binary()), "bands": pa.array(band, pa.list_(pa.int64())), "sketch": pa.array(sketch, pa.list_(pa.int64()))})

    return run


# ---- links ----------------------------------------------------------------------------------------


def verifier(shingle: int, numerator: int, denominator: int):
    """(a, b, text_a, text_b) -> linked pairs, by intersection and union of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            a_out, b_out = [], []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for i in range(len(a)):
                if a[i] != last:
                    last, held = a[i], shingle_set(batch.column("text_a")[i].as_py(), shingle)
                other = shingle_set(batch.column("text_b")[i].as_py(), shingle)
                both = len(np.intersect1d(held, other, assume_unique=True))
                if denominator * both >= numerator * (len(held) + len(other) - both):
                    a_out.append(a[i]), b_out.append(b[i])
            yield _batch({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return run


def _candidates(block, ids, n, comp, sketch, lo: int, hi: int, limit: int, numerator: int, denominator: int):
    """Pairs of rows of two blocks in different components that size and sketch cannot rule out, row by row: (i, others, differing)."""
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    for i in left:
        r = right[right > i] if lo == hi else right
        r = r[(comp[r] != comp[i]) & (np.minimum(n[r], n[i]) * denominator >= numerator * np.maximum(n[r], n[i]))]
        if len(r):
            differing = np.bitwise_count(sketch[r] ^ sketch[i]).sum(axis=1)
            near = differing <= limit
            if near.any():
                yield i, r[near], differing[near]


def _columns(t: pa.Table) -> tuple:
    block, ids, n, comp = (t.column(c).to_numpy() for c in ("block", "id", "n", "comp"))
    sketch = t.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
    return block, ids, n, comp, sketch


def scout(limit: int, numerator: int, denominator: int):
    """The members of two blocks that have a candidate in another component: at most all of them, never pairs."""

    def run(t: pa.Table) -> pa.Table:
        used = np.zeros(len(t), dtype=bool)
        columns = _columns(t)
        for i, r, _ in _candidates(*columns, t.column("lo")[0].as_py(), t.column("hi")[0].as_py(), limit, numerator, denominator):
            used[i] = True
            used[r] = True
        return t.filter(pa.array(used))

    return run


def _likely_first(candidates, comp, roots, limit: int, held: int = HELD) -> Iterator[tuple[int, int]]:
    """The pairs of rows that ``candidates`` gives, near sketches first.

    Up to ``held`` pairs are held and sorted.  More of them are made anew in passes over growing distances: a pass holds the
    candidates of one row, and looks only between components that earlier passes have not joined.
    """
    found, size = [], 0
    for i, r, d in candidates(comp, limit):
        found.append((np.full(len(r), i), r, d))
        size += len(r)
        if size > held:
            break
    else:
        if found:
            i, r, d = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(d, kind="stable")
            yield from zip(i[order].tolist(), r[order].tolist(), strict=True)
        return
    del found
    least = -1
    for most in sorted({limit * k // 4 for k in range(1, 5)}):
        for i, r, d in candidates(roots(), most):
            for j in r[np.argsort(d, kind="stable")][int((d <= least).sum()) :]:
                yield i, j
        least = most


def joiner(shingle: int, limit: int, numerator: int, denominator: int):
    """Links between the components of two blocks' members, on the full sets.

    Likely pairs come first, and a pair is skipped once its components are joined, so the links of a block
    are a forest: what is left out lies within a component already.
    """

    def run(t: pa.Table) -> pa.Table:
        block, ids, n, comp, sketch = _columns(t)
        texts = t.column("text")
        sets: dict[int, np.ndarray] = {}
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                x = y
            return x

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(texts[i].as_py(), shingle)
            return sets[i]

        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        a_out, b_out = [], []
        roots = lambda: np.array([find(int(c)) for c in comp])
        for i, j in _likely_first(lambda c, most: _candidates(block, ids, n, c, sketch, lo, hi, most, numerator, denominator), comp, roots, limit):
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y:
                a, b = of(int(i)), of(int(j))
                both = len(np.intersect1d(a, b, assume_unique=True))
                if denominator * both >= numerator * (len(a) + len(b) - both):
                    parent[max(x, y)] = min(x, y)
                    a_out.append(ids[i]), b_out.append(ids[j])
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in ``links`` (a, b): the least id reachable.

    Rounds of large and small stars; each is written, and the loop ends when a round changes nothing.
    Hot ids are pre-aggregated: a round groups by id and takes minima, never lists of neighbours.
    """
    state = lambda t: t.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = state(edges)
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = cut(small.distinct(), "edges")
        now = state(after)
        drop(edges, large)
        edges = after
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionAll(roots)


def _verified(pairs: DataFrame, texts: DataFrame, run) -> DataFrame:
    """Pairs (a, b) of class ids whose full sets are similar; only the texts of these classes move."""
    pairs = pairs.select("a", "b")
    wanted = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    texts = cut(texts.join(F.broadcast(wanted) if few_ids(wanted) else wanted, "id", "left_semi"), "texts")
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def few_ids(ids: DataFrame, rows: int = 2_000_000) -> bool:
    """Ids may be broadcast if there are few (16 MB)."""
    return ids.limit(rows + 1).count() <= rows


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = 80, bands: int = BANDS, rows: int = ROWS, bits: int = BITS, margin: float = MARGIN) -> DataFrame:
    """One row for each row of ``df``: id, n_shingles, component_id, kept, class_id (least id with the same set)."""
    spark = df.sparkSession
    small_batches(spark, 256)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = cut(docs.mapInArrow(signer(shingle, bands, rows, bits), "id long, n long, key binary, bands array<long>, sketch array<long>"), "signed")
    k = bands * rows
    limit = most_differing(percent / 100, margin, bits, k)
    alive = signed.where("n > 0 AND id IS NOT NULL")
    # Classes of equal sets: the least id stands for the class.
    member = cut(alive.groupBy("key").agg(F.min("id").alias("class_id")), "classes")
    of_class = cut(alive.select("id", "key").distinct().join(member, "key").select("id", "class_id"), "members")
    heads = alive.join(member.select("key", F.col("class_id").alias("id")), ["key", "id"], "left_semi").dropDuplicates(["key"])
    # One row for each band of a class; an id that stands for several classes is one vertex.
    heads = cut(heads.select("id", "n", "bands", "sketch"), "heads")
    keys = heads.select("id", F.posexplode("bands").alias("band_no", "band"))
    buckets = cut(keys.groupBy("band").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").select("band", "head"), "buckets")
    members = cut(keys.join(buckets, "band").select("band", "band_no", "id", "head").distinct(), "bucketed")
    facts = heads.select("id", "n", "sketch")
    star = members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    near = (
        star.join(facts.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")
        .join(facts.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a")
        .where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & sketches_near("s_a", "s_b", bits, limit))
        .select("a", "b")
    )
    run = verifier(shingle, percent, 100)
    links = cut(_verified(cut(near.distinct(), "near"), docs, run).distinct(), "links")
    # Copies of a class are links too: an id may have rows with different sets.
    first = cut(components(links.unionAll(of_class.select(F.col("class_id").alias("a"), F.col("id").alias("b")))), "components")
    copies = of_class.select(F.col("class_id").alias("a"), F.col("id").alias("b"))
    for some in (F.col("band_no") < EARLY, F.lit(True)):  # a few bands join most of what is left to join
        labelled = members.where(some).join(first, "id", "left").select("band", "id", F.coalesce("comp", "id").alias("comp"))
        mixed = labelled.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("band")
        open_ = cut(labelled.join(mixed, "band").join(facts, "id"), "open")
        if not open_.isEmpty():
            more = cut(_cross(open_, docs, shingle, limit, percent).distinct(), "more")
            if not more.isEmpty():
                links = links.unionAll(more)
                first = cut(components(links.unionAll(copies)), "components")
        drop(open_)
    drop(heads, buckets, members)
    out = signed.select("id", F.col("n").alias("n_shingles"), "key").join(first, "id", "left").join(member, "key", "left")
    component = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"), F.coalesce("class_id", "id").alias("class_id"))


def sketches_near(a: str, b: str, bits: int, limit: int):
    """The population count of the exclusive-or of two sketches is within ``limit``."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(bits // 64)), F.lit(0)) <= limit


def _cross(open_: DataFrame, docs: DataFrame, shingle: int, limit: int, percent: int, weight: int = BLOCK) -> DataFrame:
    """Links across components of buckets (band, id, comp, n, sketch), found block by block."""
    # Sets of like sizes form a slice, and a slice is dealt by a hash into blocks of a bounded amount of text.  All this needs of the rows is a
    # sum for each band and size class, so a band that many rows share is never sorted or held in one task.
    open_ = open_.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int"))
    sums = cut(open_.groupBy("band", "class").agg(F.sum(F.col("n") + 500).alias("weight")), "sums")
    whole = sums.groupBy("band").agg(F.sum("weight").alias("total"))
    fits = F.col("total") <= weight
    slices = sums.join(whole, "band").select("band", "class", F.when(fits, 0).otherwise(F.col("class")).alias("slice"), F.when(fits, 1).otherwise(F.ceil(F.col("weight") / weight)).cast("long").alias("parts"))
    slices = cut(slices, "slices")
    few = slices.limit(500_001).count() <= 500_000  # 24 bytes each
    sliced = open_.join(F.broadcast(slices) if few else slices, ["band", "class"]).withColumn("block", F.col("slice").cast("long") * 1_000_000_000 + F.pmod(F.xxhash64("id"), F.col("parts")))
    blocks = slices.select("band", "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("band", "slice", (F.col("slice").cast("long") * 1_000_000_000 + F.col("part")).alias("block")).distinct()
    left, right = blocks.select("band", F.col("block").alias("lo"), F.col("slice").alias("s0")), blocks.select("band", F.col("block").alias("hi"), F.col("slice").alias("s1"))
    tasks = left.join(right, "band").where("lo <= hi AND s1 <= s0 + 1").select("band", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    columns = ["band", "lo", "hi", "block", "id", "n", "comp", "sketch"]
    schema = "band long, lo long, hi long, block long, id long, n long, comp long, sketch array<long>"
    rows = tasks.join(sliced, ["band", "block"]).select(*columns)
    found = cut(rows.groupBy("band", "lo", "hi").applyInArrow(scout(limit, percent, 100), schema), "scouted")
    wanted = found.select("id").distinct()
    texts = docs.join(F.broadcast(wanted) if few_ids(wanted) else wanted, "id", "left_semi")
    return found.join(texts, "id").select(*columns, "text").groupBy("band", "lo", "hi").applyInArrow(joiner(shingle, limit, percent, 100), "a long, b long")


def op3_minhash_neardup(spark, sf_dir):
    """Components of documents linked at a similarity of 0.8 or more, over the whole table."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_minhash_neardup": op3_minhash_neardup}
ORACLES = {
    "op3_minhash_neardup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(4, len(w)) - 1], ' ')) || len(w[i:i + 3]) AS g FROM d, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a),
c AS (SELECT doc_id, least(doc_id, coalesce(b, doc_id)) AS component_id FROM d LEFT JOIN m ON a = doc_id),
e AS (SELECT s.doc_id, md5(string_agg(g, ',' ORDER BY g)) AS k FROM s GROUP BY s.doc_id),
o AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM e)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = c.doc_id AS kept, coalesce(class_id, c.doc_id) AS class_id
FROM c LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)""",
}
