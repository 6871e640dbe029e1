"""A training-data pipeline over ``documents``: language, near copies, benchmark text, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns they were given, whatever their names: a stage's
operator sees the columns it needs and one more that holds all others.

* language: learned from the stage's own labelled rows that are not held out; rejected texts go;
* near copies (sets of five-word shingles, 0.8): of each component the document with the least id stays; documents without an id or
  without words are linked with nothing and stay.  A row is a document: rows that share an id are linked only if their texts are alike
  (of equal least ids the row with the least hash of its text stays, of equal rows one);
* decontamination: contaminated documents go;
* secrets: every span is replaced by a mark, and ``n_chars`` follows where a text changed;
* packing: one row for each token piece with its place in a sequence.

Empty tables go through, null and empty texts are rejected by the first stage, and texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandjoin.llm import decontaminate, language, neardup, packing, secrets
from strandjoin.llm.store import cut, table

#: Words of a shingle in the near-dedup stage; op3_minhash_neardup has four.
SHINGLE = 5


def shielded(docs: DataFrame, *used: str) -> DataFrame:
    """The columns ``used`` and a struct ``row`` of all others."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*rest) if rest else F.struct(F.lit(None).alias("nothing"))).alias("row"))


def as_given(found: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` again."""
    return found.select(*[F.col(c) if c in used else F.col("row")[c].alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    used = ("doc_id", "text", "lang")
    model = language.train(docs.select(*used).where(~language.held_out()))
    return as_given(language.identify(shielded(docs, *used), model).where("NOT rejected"), docs, *used)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = docs.where("doc_id IS NOT NULL")
    slim = known.select("doc_id", "text")
    if not slim.groupBy("doc_id").count().where("count > 1").isEmpty():
        # Numbers in the order of the ids name the rows: a range sort and the row's place in it.
        ordered = shielded(known, "doc_id", "text").orderBy("doc_id", F.xxhash64("text"))
        numbered = cut(ordered.withColumn("number", F.monotonically_increasing_id()), "numbered")
    else:
        numbered = shielded(known, "doc_id", "text").withColumn("number", F.col("doc_id").cast("long"))
    result = cut(neardup.near_duplicates(numbered.select("number", "text"), id_col="number", shingle=SHINGLE), "kept")
    kept = result.where("kept").select("number")
    stays = numbered.join(F.broadcast(kept) if neardup.few_ids(kept) else kept, "number", "left_semi")
    return as_given(stays, docs, "doc_id", "text").unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return as_given(decontaminate.decontaminate(shielded(docs, "text"), table(spark, sf_dir, "benchmark")), docs, "text")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = shielded(docs, "text", "n_chars").withColumn("before", F.char_length("text"))
    clean = secrets.redact_secrets(before)
    length = F.when(F.char_length("text") == F.col("before"), F.col("n_chars")).otherwise(F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))
    return as_given(clean.withColumn("n_chars", length), docs, "text", "n_chars")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, **packing.public_bpe(), with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL can compress or tokenize; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
