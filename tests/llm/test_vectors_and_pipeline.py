import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandjoin.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"
def query():
    return F.col("vec_id") % 50 == 0



def exact(rows, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in good:
        if q % 50 == 0:
            near = [(-round(float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), 12), i) for i, b in good.items() if i != q and len(b) == len(a := good[q])]
            out[q] = [i for _, i in sorted(near)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_odd_vectors_and_small_tables_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    rows += [(50, rows[3][1]), (100, rows[3][1]), (101, [2 * x for x in rows[3][1]]), (150, None), (200, [0.0] * 4), (250, [1.0, None, 1.0, 1.0]), (300, [float("nan")] * 4), (350, [1.0, 2.0]), (351, [2.0, 1.0]), (None, [1.0] * 4)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)), query()))
    want = exact(rows)
    assert got[350] == [351] and set(got) == set(want)
    assert {q: set(v) for q, v in got.items()} == {q: set(v) for q, v in want.items()}
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), query()).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(50, [1.0])], SCHEMA), query()).count() == 0


def test_many_equal_vectors_tie_to_smaller_ids(spark):
    v = [0.3, -0.2, 0.9]
    rows = [(i, v) for i in range(1, 400)] + [(i, [-x for x in v]) for i in range(400, 500)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), query(), block=16))
    assert got[50] == [1, 2, 3, 4, 5] and got[450] == [400, 401, 402, 403, 404]


def test_parallel_vectors_tie_to_smaller_ids(spark):
    v = [0.3, -0.2, 0.9, 0.5]
    rows = [(i, [x * 2.0 ** (i % 40 - 20) for x in v]) for i in range(1, 300)] + [(i, [-x for x in v]) for i in range(300, 340)]
    for block in (4096, 16):
        got = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), query(), block=block))
        assert got[100] == [1, 2, 3, 4, 5] and got[50] == [1, 2, 3, 4, 5] and got[300] == [301, 302, 303, 304, 305]


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = exact(rows)
    result = neighbours.nearest(df, query())
    truth = spark.createDataFrame([(q, i) for q, v in want.items() for i in v], "query_id long, vec_id long")
    assert neighbours.recall(result, truth) >= 0.9
    assert all(len(v) == 5 for v in found(result).values())


def test_perturbations_come_in_order_of_score():
    inside = np.array([0.1, 0.45, 0.8, 0.6])
    score = lambda moves: sum((inside[k] if d < 0 else 1 - inside[k]) ** 2 for k, d in moves)
    got = list(neighbours.perturbations(inside, 80))
    scores = [round(score(m), 9) for m in got]
    assert scores == sorted(scores) and len(got) == 80 == len({tuple(sorted(m)) for m in got})


def test_pipeline_on_a_small_table(spark, tmp_path):
    import corpus_pipeline
    from strandjoin.llm import language
    from tests.llm import brute

    rng = random.Random(3)
    words = {"xx": ["the", "of", "ing", "ther", "wash", "and"], "yy": ["der", "und", "schaft", "nicht", "keit", "ein"]}
    text = lambda x, n: " ".join("".join(rng.choices(words[x], k=2)) for _ in range(n))
    bench = [(i, text("xx", 20)) for i in range(3)]
    docs = []
    for i in range(60):
        x = rng.choice(list(words))
        t = text(x, rng.randint(30, 80))
        docs.append([i, f"{t} {bench[i % 3][1]}" if i % 9 == 2 else f"{t} password=abcdef{i}99" if i % 9 == 4 else docs[rng.randrange(i)][1] + " end" if i % 9 == 6 else t, x, "s", 0])
    docs += [[60, None, "xx", "s", None], [61, "1234 !!", None, "s", 7], [None, text("xx", 40), "xx", "s", 0]]
    for d in docs:
        d[4] = len(d[1]) if d[1] is not None and d[0] != 61 else d[4]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(d) for d in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = table.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontamination", "secret_scan", "best_fit_packing"]
    step = lambda name, df: corpus_pipeline.cut(stages[name](spark, df, str(tmp_path)), name)
    key = lambda r: tuple(map(str, r))

    a = step("language_id", table)
    assert a.columns == columns and {r["doc_id"] for r in a.collect()} == {d[0] for d in docs} - {60, 61}
    b = step("near_dedup", a)
    kept = [(r["doc_id"], r["text"]) for r in a.collect() if r["doc_id"] is not None]
    stay = {i for i, (_, c) in brute.near_components(kept, 5).items() if i == c} | {None}
    assert b.columns == columns and sorted(map(key, b.collect())) == sorted(key(r) for r in a.collect() if r["doc_id"] in stay)
    c = step("decontamination", b)
    clean = [r for r in b.collect() if not brute.contamination(r["text"], bench)[-1]]
    assert c.columns == columns and sorted(map(key, c.collect())) == sorted(map(key, clean)) and len(clean) < b.count()
    d = step("secret_scan", c)
    before = {r["doc_id"]: r["text"] for r in c.collect()}
    for r in d.collect():
        t = before[r["doc_id"]]
        assert (r["text"], r["n_chars"]) == (brute.redacted(t), len(brute.redacted(t)))
    e = step("best_fit_packing", d).collect()
    assert {r["doc_id"] for r in e} == set(before)
    brute.places_are_sound([(r["sequence_id"], r["offset"], r["length"]) for r in e])
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32")
    assert sorted(map(key, whole.collect())) == sorted(key((r["doc_id"], r["piece"], r["ids_crc32"])) for r in e)
    del language


def test_near_dedup_stage_takes_five_words(spark):
    import corpus_pipeline
    from tests.llm import brute

    words = [f"w{i}" for i in range(200)]
    edited = lambda *at: " ".join("new" if i in at else w for i, w in enumerate(words))
    docs = [(1, edited()), (2, edited(20, 60, 100, 140, 180)), (3, edited(100)), (4, "another text")]
    alike = lambda i, n: len((a := brute.shingles(docs[0][1], n)) & (b := brute.shingles(docs[i][1], n))) / len(a | b)
    assert alike(1, 5) < 0.8 <= alike(1, 4) and alike(2, 5) >= 0.8
    df = spark.createDataFrame([docs[0], docs[1], docs[3], (5, docs[0][1])], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {1, 2, 4}


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    import corpus_pipeline

    rng = random.Random(5)
    one, two, three = (" ".join(rng.choices(["ka", "lo", "mi", "ne", "ru", "ta"], k=80)) for _ in range(3))
    rows = [(1, one, "a"), (1, two, "b"), (1, one, "a"), (2, two + " end", "c"), (3, three, "d"), (None, one, "e"), (None, one, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, number string")
    got = sorted(map(str, corpus_pipeline.near_dedup(spark, df, "").collect()))
    want = spark.createDataFrame([rows[0], rows[1], rows[4], *rows[5:]], df.schema).collect()
    assert got == sorted(map(str, want))


def test_other_columns_go_through_every_stage_as_they_were(spark, tmp_path):
    import corpus_pipeline

    text = "the cat sat on a mat with password=hunter2222 and went to sleep on it at once"
    names = ("items", "_text", "spans", "score", "n_words", "rejected", "row", "number", "before", "_base", "secrets", "found", "_found", "id", "key", "kept", "LANG_PRED")
    rows = [(i, text + f" number {i} {'abc' * i} and so on", "en", len(text)) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").select("*", *[F.concat(F.lit(f"own {n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    spark.createDataFrame([(1, "nothing of this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)), name)
        assert after.columns == docs.columns
        own = lambda df: sorted(tuple(r[n] for n in names) for r in df.collect())
        assert set(own(after)) <= set(own(docs)) and after.count() >= 1
        assert name == "near_dedup" or after.count() == docs.count()
        docs = after
    assert all("hunter" not in str(tuple(r)) and "[SECRET]" in r["text"] for r in docs.collect())


@pytest.mark.parametrize("language", ["en", "fr", "de", "es"])
def test_a_text_of_a_million_words_stays(spark, language):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r["text"] for r in docs.where(F.col("lang") == language).orderBy("doc_id").collect() if r["text"]]
    words = " ".join(texts).split(" ")
    long = " ".join((words * (1 + 1_000_000 // len(words)))[:1_000_000])
    added = docs.unionByName(spark.createDataFrame([(10_000_001, long, None, "own", len(long))], docs.schema))
    assert corpus_pipeline.language_id(spark, added, "").where("doc_id = 10000001").count() == 1


@pytest.mark.parametrize("name", ["documents", "benchmark"])
def test_pipeline_of_empty_tables(spark, tmp_path, name):
    import corpus_pipeline

    given = {"documents": [(1, "the of and", "xx", "s", 10), (2, "der und die das", "yy", "s", 15)], "benchmark": [(1, "a b c")]}
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id long, text string"}
    for n, rows in given.items():
        spark.createDataFrame([] if n == name else rows, schemas[n]).write.parquet(f"{tmp_path}/{n}.parquet")
    corpus_pipeline.run(spark, str(tmp_path)).collect()
