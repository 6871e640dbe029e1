"""Benchmark decontamination: a broadcast hash set of test n-grams against windows of every document.

Words are runs of ASCII letters and digits and of all other characters above ASCII, with A-Z lowered.
Every window of 13 consecutive words of a benchmark item is an n-gram of the test set; an item with
fewer words, but not none, is one shorter window.  A window of a document is tested in three steps:
its first word, then a hash of its first three words, then its whole text against the hash set of
windows, which is the verification: a hash that collides is not a hit.

A set of at most ``set_limit`` windows travels inside the plan as constants.  A larger one is broadcast as a table of 64-bit hashes, at most
``broadcast_limit`` of them at a time and one scan of the documents for each such part.  The windows of a document are looked up where
they are made, so only those whose hash is found ever move; they are verified by their words afterwards.

Nulls: a null or wordless text has no words and is never contaminated; a null or wordless item has
no windows.  Items with equal ids count once.  An empty benchmark leaves every document clean, and an empty table stays empty.
Repeated documents each get their row; very long texts are taken whole.  Columns named like the outputs are replaced by
``find_contamination``; ``decontaminate`` keeps every column, whatever its name.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import larger, let, scanned
from .store import cut, fresh, table, without

N = 13
HEAD = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before A-Z are lowered.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "items")
SPANS = "array<struct<start:int,stop:int>>"


def words_sql(name: str) -> str:
    """Normalised words of a column.  ``lower`` is used where a text has only ASCII, ``translate`` elsewhere."""
    t = f"coalesce(CAST(`{name}` AS STRING), '')"
    low = f"CASE WHEN octet_length({t}) = char_length({t}) THEN lower({t}) ELSE translate({t}, '{UPPER}', '{LOWER}') END"
    return f"array_remove(split({low}, r'{SEPARATORS}'), '')"


def benchmark_windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = N) -> DataFrame:
    """One row for each distinct (window, item): ``window`` (words joined by a space), ``size``, ``item``, ``head`` (hash of its first words)."""
    w = bench.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.expr(words_sql(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("size", F.least(F.lit(n), F.size("w")))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1))
    w = w.select("item", "size", "w", starts.alias("at"))
    begins = [F.xxhash64(*[F.get("w", F.col("at") - 1 + k) for k in range(m)]) for m in range(1, HEAD + 1)]
    head = F.get(F.array(*begins), F.least(F.col("size"), F.lit(HEAD)) - 1)
    return w.select(F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("window"), "size", "item", head.alias("head")).distinct()


def covered(spans: Column) -> Column:
    """Words inside any of the spans, which are sorted by start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        return F.struct(F.greatest(s["end"], x["stop"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["end"], x["start"]))).alias("n"))

    return F.aggregate(spans, zero, step, lambda s: s["n"])


def _hits(size: int, windows: list[str], heads: list[int]) -> str:
    """Places of windows among the words ``w``: first word, then a hash of the first words, then the whole window, each against a
    hash set; a later test only where the earlier ones hold.  SQL text, since thousands of
    constants are parsed faster than they are passed one by one.
    """
    quoted = lambda xs: ",".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in xs)
    head = ", ".join(["x", *(f"get(w, i + {k})" for k in range(1, min(HEAD, size)))])
    first = sorted({w.split(" ")[0] for w in windows})
    return f"""array_compact(transform(w, (x, i) ->
        CASE WHEN x IN ({quoted(first)}) THEN
        CASE WHEN xxhash64({head}) IN ({",".join(map(str, heads))}) THEN
        CASE WHEN array_join(slice(w, i + 1, {size}), ' ') IN ({quoted(windows)}) AND i + {size} <= size(w) THEN named_struct('start', i, 'stop', i + {size}) END END END))"""


def _tested_in_place(text_col: str, grams: list) -> Column:
    """Struct of ``n`` (words), ``spans`` (hits, by place) and ``windows`` (their texts): the n-grams are constants of one expression."""
    by_size: dict[int, tuple[list[str], set[int]]] = {}
    for g in grams:
        texts, heads = by_size.setdefault(g["size"], ([], set()))
        texts.append(g["window"]), heads.add(g["head"])
    hits = [_hits(size, texts, sorted(heads)) for size, (texts, heads) in sorted(by_size.items())]
    spans = f"array_sort(concat({', '.join(hits)}))" if hits else f"CAST(array() AS {SPANS})"
    texts = "array_distinct(transform(s, y -> array_join(slice(w, y.start + 1, y.stop - y.start), ' ')))"
    return F.expr(f"""get(transform(array({words_sql(text_col)}), w -> get(transform(array({spans}), s -> named_struct('n', size(w), 'spans', s, 'windows', {texts})), 0)), 0)""")


def _items(windows: Column, grams: list) -> Column:
    """Items of the given windows: a table of buckets, of which one is looked at for each."""
    items: dict[str, set[str]] = {}
    for g in grams:
        items.setdefault(g["window"], set()).update(g["items"])
    buckets: list[list[dict]] = [[] for _ in range(max(1, len(items)))]
    for window, ids in items.items():
        buckets[zlib.crc32(window.encode()) % len(buckets)].append({"w": window, "i": sorted(ids)})
    lookup = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<w:string,i:array<string>>>>")
    of = lambda t: F.flatten(F.transform(F.filter(F.get(lookup, (F.crc32(t.cast("binary")) % len(buckets)).cast("int")), lambda b: b["w"] == t), lambda b: b["i"]))
    return F.when(F.size(windows) > 0, F.array_sort(F.array_distinct(F.flatten(F.transform(windows, of))))).otherwise(F.array().cast("array<string>"))


def _tested_by_broadcast(docs: DataFrame, text_col: str, found: str, grams: DataFrame, sizes: list[int], broadcast_limit: int) -> DataFrame:
    """``docs`` with ``found``, a struct of ``n``, ``spans`` and ``items``, for a test set of any size."""
    key, known, hit = fresh(docs, "_key", "_words", "_hit")
    docs = docs.withColumn(known, F.expr(words_sql(text_col))).withColumn(key, F.sha2(F.array_join(known, " ").cast("binary"), 256))
    each = docs.select(F.col(key).alias("t"), F.col(known).alias("w"))
    digest = lambda size: f"xxhash64({size}, array_join(slice(w, i + 1, {size}), ' '))"
    made = [f"transform(CASE WHEN size(w) >= {size} THEN sequence(0, size(w) - {size}) ELSE CAST(array() AS array<int>) END, i -> named_struct('start', i, 'stop', i + {size}, 'h', {digest(size)}))" for size in sizes]
    windows = each.select("t", F.expr(f"explode(concat({', '.join(made)}))").alias("x")).select("t", "x.*")
    hashes = grams.select(F.xxhash64("size", "window").alias("h")).distinct()
    parts = -(-grams.count() // broadcast_limit)
    some = None
    for k in range(parts):  # each part has a checked size: its share of a counted table of 8-byte hashes
        part = windows.join(F.broadcast(hashes.where(F.pmod("h", F.lit(parts)) == k)), "h", "left_semi")
        some = part if some is None else some.unionAll(part)
    able = cut(some.groupBy("t").agg(F.collect_set(F.struct("start", "stop")).alias("able")), "able")  # at most the windows of one text
    texts = able.join(each, "t").dropDuplicates(["t"]).select("t", "w", F.explode("able").alias("x")).select("t", "x", F.expr("array_join(slice(w, x.start + 1, x.stop - x.start), ' ')").alias("window"))
    hits = texts.join(grams.select("window", "items"), "window").groupBy("t").agg(F.array_sort(F.collect_set("x")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = cut(hits, "hits").select(F.col("t").alias(key), F.struct("spans", "items").alias(hit))
    joined = docs.join(hits, key, "left")
    spans, items = F.coalesce(F.col(hit)["spans"], F.array().cast(SPANS)), F.coalesce(F.col(hit)["items"], F.array().cast("array<string>"))
    return joined.withColumn(found, F.struct(F.size(known).alias("n"), spans.alias("spans"), items.alias("items"))).drop(key, known, hit)


def _is_contaminated(f: Column) -> Column:
    return let(covered(f["spans"]), lambda n: (n > 0) & (n * 20 >= f["n"]))


def _found(df: DataFrame, found: str, bench: DataFrame, text_col: str, item_col: str, n: int, set_limit: int, broadcast_limit: int) -> tuple[DataFrame, Column]:
    """``df`` with the struct ``found`` (``n``, ``spans``), and the items of its hits."""
    grams = cut(benchmark_windows(bench, item_col, n=n).groupBy("window", "size", "head").agg(F.sort_array(F.collect_set("item")).alias("items")), "grams")
    if grams.count() <= set_limit:
        rows = grams.collect()
        return df.withColumn(found, _tested_in_place(text_col, rows)), _items(F.col(found)["windows"], rows)
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # at most n
    return _tested_by_broadcast(df, text_col, found, grams, sizes, broadcast_limit), F.col(found)["items"]


def find_contamination(df: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", n: int = N, set_limit: int = 200_000, broadcast_limit: int = 20_000_000) -> DataFrame:
    """``df`` with word counts, ``hit_spans`` (word positions), ``items`` and ``contaminated``."""
    found, held = fresh(df, "_found", "_text")
    kept = without(df.withColumn(held, F.col(f"`{text_col}`")), *OUT)
    docs, items = _found(kept, found, bench, held, item_col, n, set_limit, broadcast_limit)
    f = F.col(found)
    return (
        docs.withColumn("n_words", f["n"].cast("long"))
        .withColumn("hit_spans", f["spans"])
        .withColumn("n_hit", covered(f["spans"]))
        .withColumn("items", items)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
        .withColumn("contaminated", _is_contaminated(f))
        .drop(found, held)
    )


def _without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and what stands between them; everything else as it was."""

    def pieces(x: Column) -> Column:
        """Words between the end of what was cut before and each span that begins a new cut, and after the last."""
        last = F.array(F.struct(F.element_at(x["reach"], -1).alias("a"), F.size(x["w"]).alias("b")))
        gaps = F.transform(spans, lambda s, i: F.struct(F.get(x["reach"], i).alias("a"), s["start"].alias("b"), (i == 0).alias("first")))
        between = F.transform(F.filter(gaps, lambda p: p["first"] | (p["b"] > p["a"])), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))
        word = lambda i: F.concat(F.get(x["w"], i), F.get(x["g"], i + 1))
        text_of = lambda p: F.concat(F.get(x["g"], p["a"]), F.when(p["b"] > p["a"], F.array_join(F.transform(F.sequence(p["a"], p["b"] - 1), word), "")).otherwise(""))
        return F.array_join(F.transform(F.concat(between, last), text_of), "")

    known = F.struct(F.split(text, WORD, -1).alias("g"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"), scanned(F.transform(spans, lambda s: s["stop"]), 0, larger).alias("reach"))
    return F.when(F.size(spans) > 0, let(known, pieces)).otherwise(text)


def decontaminate(df: DataFrame, bench: DataFrame, text_col: str = "text", how: str = "documents", item_col: str = "item_id", n: int = N, set_limit: int = 200_000, broadcast_limit: int = 20_000_000) -> DataFrame:
    """Remove contaminated documents (``how='documents'``), or the hit words of every document (``'spans'``)."""
    if how not in ("documents", "spans"):
        raise ValueError("how is 'documents' or 'spans'")
    (found,) = fresh(df, "_found")
    marked, _ = _found(df, found, bench, text_col, item_col, n, set_limit, broadcast_limit)
    columns = {c: F.col(f"`{c}`") for c in df.columns}
    if how == "documents":  # the condition mentions what it tests once, so it costs the same where Spark moves it
        return marked.where(~let(F.col(found), _is_contaminated)).select(*columns.values())
    columns[text_col] = let(F.col(found), lambda f: _without_spans(F.col(f"`{text_col}`").cast("string"), f["spans"])).alias(text_col)
    return marked.select(*columns.values())


def op7_decontamination(spark, sf_dir):
    """Contamination of every whole document by the whole benchmark."""
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES = {
    "op7_decontamination": r"""
WITH d AS (
  SELECT doc_id, text, row_number() OVER () AS k,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
x AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM d, (SELECT DISTINCT n FROM g), unnest(range(1, len(w) - n + 2)) AS t(i)),
h AS (SELECT x.k, x.i, x.n, g.item FROM x JOIN g ON x.n = g.n AND x.s = g.s),
c AS (SELECT k, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) AS t(p) GROUP BY k),
e AS (SELECT k, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN e USING (k)""",
}
