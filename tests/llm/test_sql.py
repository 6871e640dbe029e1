"""Queries against their SQL, on small tables of awkward texts."""

import duckdb
import pytest

from strandjoin.llm import queries
from tests.llm import brute
from tests.llm.test_text_operators import SCHEMA, SECRET_TEXTS, corpus, secret_texts

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and benchmark: nulls, copies, passages, secrets of every kind, items shorter than a window, and an item that only one text has."""
    where = str(tmp_path_factory.mktemp("sql"))
    texts = [t for _, t in corpus(n=60)] + secret_texts()[:120] + SECRET_TEXTS
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).coalesce(1).write.parquet(f"{where}/documents.parquet")
    whole = [t for t in texts if t]
    items = [whole[6], whole[9][:400], "ka lo mi", "", None, whole[1], "KA! lo? mi", "never seen anywhere"]
    spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "item_id string, text string").coalesce(1).write.parquet(f"{where}/benchmark.parquet")
    return where


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, folder, duck, name):
    made = duck.execute(SQL[name])
    columns = [c[0] for c in made.description]
    want = sorted(made.fetchall(), key=str)
    df = queries.queries()[name](spark, folder)
    assert set(df.columns) == set(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == want


def test_the_sql_of_spans_agrees_with_brute_force(duck):
    texts = secret_texts() + SECRET_TEXTS
    duck.execute("CREATE TABLE secret_texts (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO secret_texts VALUES (?, ?)", list(enumerate(texts)))
    got = duck.execute(f"SELECT doc_id, n_entropy, spans FROM ({SQL['op4_secret_scan'].replace('FROM documents', 'FROM secret_texts')})").fetchall()
    assert len(got) == len(texts) and sum(n for _, n, _ in got) > 100
    for i, _, spans in got:
        assert spans == ",".join(f"{k}:{a}:{b}" for k, a, b in brute.all_secrets(texts[i])), texts[i]
