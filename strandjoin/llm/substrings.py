"""Substring dedup by prefix-partitioned suffix trees over words.

A repeat of ``window`` words is an internal node of the generalised suffix tree at that depth or deeper.  The
tree is never held in one place:

1. every window has an anchor, the place in it whose ``ANCHOR`` words have the least hash.  It depends on the words of the window
   alone, so equal windows have it at the same distance.  A window is filed under the suffix that starts at its anchor, and
   neighbouring windows with one anchor travel together, as one segment of the text: about three words for each window
   where a suffix for each would take ``window``;
2. one pass counts windows by the cells of the prefixes of 1, 2, 3 and 4 words of their suffixes, over all documents
   (cells are hash ranges, so the statistic has a fixed size however many distinct prefixes there are);
3. a suffix belongs to the first of its prefixes whose cell fits into memory: common prefixes are
   lengthened, rare ones stay short.  Cells are packed into groups of about ``group_size`` windows; a cell that is too
   large at the longest prefix is dealt by whole windows instead;
4. each group's subtree is built in one task from the words themselves: the suffixes are brought into the order of their first
   ``window`` words and each is compared, word by word, with the first suffix of its node.  Digests only bring equal suffixes
   together, so one that collides costs time and never a word;
5. below each node all suffixes but the first (smallest document, then earliest start) are repeats: their
   words are removed; runs of neighbouring starts are the maximal repeats.

Equal segments of one chunk of documents (compared by their bytes) are folded before they travel: only the first is sent, so a passage
in a third of all documents is a few segments for each chunk.

A null text has no words, and very long texts are taken whole.  Rows with equal ids are one document for the order: none of two equal
starts is earlier, and each row loses only words of its own text.  A null id comes before all others.  An empty table gives an
empty table.  Only the id and the outputs are returned, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import mix
from .store import cut, small_batches, table

WINDOW, GROUP, ANCHOR = 20, 1_000_000, 4
CHUNK_WORDS = 600_000  # words of the documents that a task holds at a time
MOST_PARTITIONS = 20_000
NO_ID = -(2**63)
_B = np.uint64(0x9E3779B97F4A7C15)


_BLANKS = bytes(32 if c in b"\x09\x0a\x0b\x0c\x0d" else c for c in range(256))
_PLACE = mix(np.arange(1, 4097, dtype=np.uint64))


def plain(text: str | None) -> bytes:
    """The words of a text with one blank between them."""
    data = (text or "").encode().translate(_BLANKS).strip(b" ")
    return b" ".join(data.split(b" ")) if b"  " not in data else b" ".join(x for x in data.split(b" ") if x)


def word_places(data: bytes) -> np.ndarray:
    """Where the words begin in texts of ``plain`` words that are joined by line feeds; the last entry is one beyond the end."""
    a = np.frombuffer(data, np.uint8)
    return np.concatenate([[0], np.flatnonzero((a == 32) | (a == 10)) + 1, [len(a) + 1]])


def word_values(data: bytes, places: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word: a sum over its bytes, weighted by their places in the word; ``step`` words at a time."""
    out = np.empty(len(places) - 1, dtype=np.uint64)
    for k in range(0, len(out), step):
        p = places[k : k + step + 1]
        sizes, first = np.diff(p), p[:-1] - p[0]
        a = np.frombuffer(data[p[0] : p[-1] - 1] + b"\n", np.uint8)
        weighted = _PLACE[(np.arange(len(a)) - np.repeat(first, sizes)) & 4095] * a
        weighted[p[1:] - 1 - p[0]] = 0  # what stands between words
        out[k : k + step] = mix(np.add.reduceat(weighted, first) + sizes.astype(np.uint64))
    return out


def follow(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Hashes of texts that follow one another."""
    out = h * _B + g
    return out ^ (out >> np.uint64(29))


def spelled(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` words from each place on, by doubling; places with fewer words left out."""
    out, done, power, size = None, 0, values, 1
    while True:
        if n & size:
            m = len(values) - done - size + 1
            if m <= 0:
                return np.zeros(0, np.uint64)
            out = power if out is None else follow(out[:m], power[done : done + m])
            done += size
        size *= 2
        if size > n:
            return out
        half = len(power) - size // 2
        power = follow(power[:half], power[size // 2 :]) if half > 0 else power[:0]


# ---- suffixes of a chunk of documents -------------------------------------------------------------


class Chunk:
    """Segments of some documents: windows of ``window`` words that share an anchor.

    doc, key, start, count: of each segment, its document (id and key), place and number of windows.  text: its words.
    prefix: for each prefix length the hash at the anchor.  Of equal segments only the first is kept, the others are in ``again``.
    """

    def __init__(self, docs: list[tuple[int, int, bytes]], window: int, whole: bool = True):
        """whole: with texts, and folded by them; else folded by digests, which is enough for counts."""
        docs = sorted((d for d in docs if d[2]), key=lambda d: d[0])
        size = min(ANCHOR, window)
        data = b"\n".join(t for _, _, t in docs)
        places = word_places(data)
        sizes = np.array([t.count(b" ") + 1 for _, _, t in docs], dtype=np.int64)
        base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = max(0, int(base[-1]) - window + 1)
        edges = np.zeros(n + 1, dtype=np.int64)
        has = sizes >= window
        np.add.at(edges, base[:-1][has], 1)
        np.add.at(edges, base[1:][has] - window + 1, -1)
        at = np.flatnonzero(np.cumsum(edges[:n]) > 0)
        prefix = [np.zeros(0, np.uint64)] * size
        anchor = count = first = at
        if len(at):
            values = word_values(data, places)
            prefix = [mix(spelled(values, k + 1)) for k in range(size)]
            least = prefix[-1][:n].copy()
            for k in range(1, window - size + 1):
                np.minimum(least, prefix[-1][k : k + n], out=least)
            anchor = np.zeros(n, dtype=np.int64)
            for k in range(window - size, -1, -1):  # the first of equal ones
                here = np.flatnonzero(prefix[-1][k : k + n] == least)
                anchor[here] = here + k
            new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (anchor[at[1:]] != anchor[at[:-1]])])
            first = at[new]
            count = np.diff(np.concatenate([np.flatnonzero(new), [len(at)]]))
        if not whole:
            if len(at):
                ends = spelled(values, window)
                s = np.unique(follow(follow(ends[first], ends[first + count - 1]), count.astype(np.uint64)), return_index=True)[1]
                first, count = first[s], count[s]
            self.count, self.prefix = count, [p[anchor[first]] if len(first) else p[:0] for p in prefix]
            return
        in_doc = np.searchsorted(base, first, side="right") - 1
        ids = np.array([d for d, _, _ in docs], dtype=np.int64)[in_doc]
        keys = np.array([k for _, k, _ in docs], dtype=np.int64)[in_doc]
        start = first - base[in_doc]
        seen: dict[bytes, int] = {}
        text, sent, again = [], [], []
        for i, (a, b) in enumerate(zip(places[first].tolist(), (places[first + count + window - 1] - 1).tolist(), strict=True)):
            segment = data[a:b]
            j = seen.setdefault(segment, i)
            if i == j or (ids[i] == ids[j] and start[i] == start[j]):  # segments stand by document and start; none of two equal places is earlier
                sent.append(i)
                text.append(segment)
            else:
                again.append(i)
        self.text, s, f = text, np.array(sent, dtype=np.int64), np.array(again, dtype=np.int64)
        self.doc, self.key, self.start, self.count = ids[s], keys[s], start[s], count[s]
        self.again = ids[f], keys[f], start[f], count[f]
        self.prefix = [p[anchor[first[s]]] if len(s) else p[:0] for p in prefix]


def chunks(batches: Iterator[pa.RecordBatch], window: int, chunk_words: int, whole: bool = True) -> Iterator[Chunk]:
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for batch in batches:
        for doc, key, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            t = plain(text)
            held.append((NO_ID if doc is None else doc, key, t))
            size += t.count(b" ") + 1
            if size >= chunk_words:
                yield Chunk(held, window, whole)
                held, size = [], 0
    if held:
        yield Chunk(held, window, whole)


def cells_of(prefix: np.ndarray, bits: int) -> np.ndarray:
    return (prefix >> np.uint64(64 - bits)).astype(np.int64)


def cell_counter(window: int, bits: int, chunk_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((min(ANCHOR, window), 1 << bits), dtype=np.int64)
        for c in chunks(batches, window, chunk_words, whole=False):
            for k, h in enumerate(c.prefix):
                total[k] += np.bincount(cells_of(h, bits), weights=c.count, minlength=1 << bits).astype(np.int64)
        level, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[level, cell])], ["level", "cell", "n"])

    return run


def prefix_groups(counts: np.ndarray, group_size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each (level, cell) its group, or -1 where the prefix is to be lengthened; for each cell of the last level into how many
    groups its windows are dealt; and the number of groups."""
    levels, cells = counts.shape
    group, parts = np.full((levels, cells), -1, dtype=np.int32), np.ones(cells, dtype=np.int32)
    room, number = 0, 0
    for k in range(levels):
        for c in np.argsort(-counts[k], kind="stable"):
            n = int(counts[k, c])
            if n > group_size and k + 1 < levels:
                continue
            if n > group_size:
                parts[c] = -(-n // group_size)
                group[k, c] = number
                number, room = number + int(parts[c]), 0
                continue
            if room < n or not number:
                number, room = number + 1, group_size
            group[k, c] = number - 1
            room -= n
    return group, parts, max(1, number)


def pack(doc: np.ndarray, key: np.ndarray, start: np.ndarray, count: np.ndarray, text: list[bytes], again: tuple, level: int = 1) -> bytes:
    import zstandard

    head = np.array([len(doc), len(again[0])], "<u4").tobytes()
    columns = [x.astype(t).tobytes() for part in ((doc, key, start, count), again) for x, t in zip(part, ("<i8", "<i8", "<u4", "<u2"), strict=True)]
    return zstandard.ZstdCompressor(level=level).compress(b"".join([head, *columns, b"\n".join(text)]))


def unpack(data: bytes) -> tuple[tuple, bytes, tuple]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    parts, at = [], 8
    for n in np.frombuffer(raw, "<u4", 2).tolist():
        columns = []
        for kind in ("<i8", "<i8", "<u4", "<u2"):
            columns.append(np.frombuffer(raw, kind, n, at).astype(np.int64))
            at += n * np.dtype(kind).itemsize
        parts.append(tuple(columns))
    return parts[0], raw[at:], parts[1]


def sender(window: int, bits: int, group: np.ndarray, parts: np.ndarray, chunk_words: int):
    """Packs each chunk's segments by group."""

    def dealt(c: Chunk) -> tuple:
        """(group, doc, key, start, count, text) of each segment, or of each window where a cell is dealt by windows."""
        g = np.full(len(c.doc), -1, dtype=np.int64)
        for k, h in enumerate(c.prefix):
            left = g < 0
            g[left] = group[k][cells_of(h[left], bits)]
        several = np.zeros(len(g), dtype=np.int64)
        last = cells_of(c.prefix[-1], bits)
        several = np.where(g == group[-1][last], parts[last], 1)
        if not (several > 1).any():
            return g, c.doc, c.key, c.start, c.count, c.text
        rows = []
        for i, (m, n) in enumerate(zip(several.tolist(), c.count.tolist(), strict=True)):
            if m == 1:
                rows.append((g[i], c.doc[i], c.key[i], c.start[i], n, c.text[i]))
                continue
            w = c.text[i].split(b" ")
            for k in range(n):
                t = b" ".join(w[k : k + window])
                rows.append((g[i] + hash_of(t) % m, c.doc[i], c.key[i], c.start[i] + k, 1, t))
        *columns, text = zip(*rows, strict=True)
        return *(np.array(x, dtype=np.int64) for x in columns), list(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, window, chunk_words):
            if not len(c.doc):
                continue
            g, doc, key, start, count, text = dealt(c)
            order = np.argsort(g, kind="stable")
            edges = np.flatnonzero(np.diff(g[order], prepend=-1))
            spare, none = hash_of(text[0]) % len(edges), tuple(x[:0] for x in c.again)  # one group passes on what was folded here
            rows = []
            for j, (a, b) in enumerate(zip(edges, [*edges[1:], len(order)], strict=True)):
                i = order[a:b]
                rows.append((int(g[i[0]]), pack(doc[i], key[i], start[i], count[i], [text[x] for x in i], c.again if j == spare else none)))
            for k in range(0, len(rows), 64):
                grp, data = zip(*rows[k : k + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int32()), pa.array(data, pa.binary())], ["grp", "data"])

    return run


def hash_of(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


# ---- subtrees -------------------------------------------------------------------------------------


def runs(doc: np.ndarray, key: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of documents, given as (start, number), as maximal runs."""
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order], (start + count)[order]
    if not len(doc):
        return doc, key, start, start
    apart = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    part = np.cumsum(apart)
    reach = np.maximum.accumulate(end + part * 2**33) - part * 2**33  # the furthest end so far in the same document
    new = apart | np.concatenate([[True], start[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(doc)]]) - 1
    return doc[at], key[at], start[at], reach[last] - start[at]


def later_ones(data: bytes, places: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int, bits: int = 64) -> np.ndarray:
    """Of the suffixes that begin at the words ``at`` of ``data``, those whose first ``window`` words also start earlier.

    bits: length of the digests that bring equal suffixes together; what counts is the comparison of the words.
    """
    digest = mix(spelled(word_values(data, places), window))[at] >> np.uint64(64 - bits)
    order = np.argsort(digest, kind="stable")
    same = digest[order[1:]] == digest[order[:-1]]
    shared = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
    shared = shared[np.lexsort((start[shared], doc[shared], digest[shared]))]
    new = np.concatenate([[True], digest[shared[1:]] != digest[shared[:-1]]]) if len(shared) else np.zeros(0, bool)
    node = np.cumsum(new)
    first = shared[np.flatnonzero(new)[node - 1]]  # the first suffix of the same node
    later = (doc[shared] != doc[first]) | (start[shared] != start[first])
    low, high = places[at[shared]].tolist(), (places[at[shared] + window] - 1).tolist()
    words: bytes = b""
    earliest: dict[bytes, int] = {}
    for i, (opens, a, b) in enumerate(zip(new.tolist(), low, high, strict=True)):
        if opens:
            words, earliest = data[a:b], {}
        elif data[a:b] != words:  # only the digest is that of the first one; the earliest of equal ones counts
            j = earliest.setdefault(data[a:b], i)
            later[i] = doc[shared[i]] != doc[shared[j]] or start[shared[i]] != start[shared[j]]
    return shared[later]


def subtree(window: int, bits: int = 64):
    """Repeats among a group's suffixes, and those that chunks have folded, as (doc_id, key, start, n)."""

    def run(t: pa.Table) -> pa.Table:
        segments, texts, folded = zip(*map(unpack, t.column("data").to_pylist()), strict=True)
        doc, key, start, count = (np.concatenate(x) for x in zip(*segments, strict=True))
        data = b"\n".join(x for x in texts if x)
        places = word_places(data)
        begin = np.cumsum(count + window - 1) - (count + window - 1)
        segment = np.repeat(np.arange(len(doc)), count)
        within = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
        later = later_ones(data, places, begin[segment] + within, doc[segment], start[segment] + within, window, bits)
        s = segment[later]
        one = doc[s], key[s], start[s] + within[later], np.ones(len(s), dtype=np.int64)
        d, k, a, n = runs(*(np.concatenate([x, *y]) for x, y in zip(one, zip(*folded, strict=True), strict=True)))
        return pa.table({"doc_id": pa.array(d, pa.int64()), "key": pa.array(k, pa.int64()), "start": pa.array(a, pa.int32()), "n": pa.array(n, pa.int32())})

    return run


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_size: int = GROUP, chunk_words: int = CHUNK_WORDS, digest_bits: int = 64) -> DataFrame:
    """(doc_id, key, start, n): ``n`` neighbouring windows from ``start`` whose words also stand earlier.

    A null id is ``NO_ID``; ``key`` is the hash of the row's text, which tells rows with equal ids apart.
    """
    spark = df.sparkSession
    small_batches(spark, 256)
    text = F.col(f"`{text_col}`").cast("string")
    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    words = (slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 5
    bits = min(20, max(12, int(words // group_size * 8).bit_length()))  # at most 4 x 2^20 counts on the driver
    counts = np.zeros((min(ANCHOR, window), 1 << bits), dtype=np.int64)
    cells = slim.mapInArrow(cell_counter(window, bits, chunk_words), "level int, cell int, n long").groupBy("level", "cell").agg(F.sum("n").alias("n"))
    for r in cells.toLocalIterator():
        counts[r["level"], r["cell"]] = r["n"]
    group, parts, number = prefix_groups(counts, group_size)
    sent = slim.mapInArrow(sender(window, bits, group, parts, chunk_words), "grp int, data binary")
    tasks = min(MOST_PARTITIONS, max(number, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # a task takes its groups one after the other
    return sent.repartition(tasks, "grp").groupBy("grp").applyInArrow(subtree(window, digest_bits), "doc_id long, key long, start int, n int")


# ---- removal --------------------------------------------------------------------------------------


def remover(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, gone, sha, text_out = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                w = (text or "").encode().split()
                out = np.zeros(len(w) + 1, dtype=np.int64)
                for x in spans or ():
                    out[x["start"]] += 1
                    out[min(len(w), x["start"] + x["n"] - 1 + window)] -= 1
                keep = np.cumsum(out)[:-1] == 0
                rest = b" ".join([w[i] for i in np.flatnonzero(keep)]) if spans else b" ".join(w)
                many.append(len(w)), gone.append(len(w) - int(keep.sum())), sha.append(hashlib.sha256(rest).hexdigest()), text_out.append(rest.decode() if with_text else None)
            made = [batch.column("id"), pa.array(many, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                made.append(pa.array(text_out, pa.string())), names.append("kept_text")
            yield pa.RecordBatch.from_arrays(made, names)

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_size: int = GROUP, with_text: bool = True, chunk_words: int = CHUNK_WORDS, digest_bits: int = 64) -> DataFrame:
    """One row for each row: id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    flags = cut(repeated_windows(df, id_col, text_col, window, group_size, chunk_words, digest_bits), "repeats")
    spans = flags.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))  # at most the words of a document
    text = F.col(f"`{text_col}`").cast("string")
    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("key"))
    joined = slim.join(spans, ["doc_id", "key"], "left").select("id", "text", "spans")
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(remover(window, with_text), schema).withColumnRenamed("id", id_col)


def op10_substring_dedup(spark, sf_dir):
    """Every whole document without the 20-word passages that stand earlier in the corpus."""
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLES = {
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
f AS (SELECT doc_id, i FROM x QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
g AS (SELECT DISTINCT doc_id, p FROM f, unnest(range(i, i + 20)) AS t(p)),
e AS (SELECT doc_id, p, w[p] AS v FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
k AS (SELECT doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY p) AS s FROM e ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
}
