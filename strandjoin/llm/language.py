"""Language identification by compression.

Texts are normalised to lower-case words of letters.  For each language of the training rows a
raw-content zstandard dictionary holds a bounded sample of such words.  A text is encoded with each
dictionary, in blocks of ``BLOCK_CHARS`` that each start from the dictionary alone, and besides each distinct word of a block
alone, since whole bytes tell little of a short text.  The language whose dictionary gives the fewest bytes is chosen.
``score`` is 2 (second - best) / second over the bytes, at most 1; ``rejected`` marks texts whose score is below ``margin``, so also ties
(the language of a tie is the one with more training rows).  What a dictionary can gain is bounded for each block and not for the
text, so the score does not fall with its length.

Runs of five words that stand in more than one row of the sample are left out of it, so that copies and
passages that many documents share speak for no language.  The dictionaries have equal sizes (a small
one is repeated), because the bytes of a match grow with its distance.

What is fitted: at most ``SAMPLE_ROWS`` training rows for each language, in the order of a hash of the id, and ``sample_bytes`` of their words
(both documented bounds).  Of a long row ``PIECES`` pieces are taken that are spread evenly over the whole text, and of more words than
fit, runs that are spread evenly over all of them.  Nothing else is sampled, and every whole text is classified.

A null text, or one without a letter, is ``und`` with score 0 and is rejected.  Rows without a
language are classified but teach nothing; with no training rows at all every text is ``und``, and with one language every text is of it.
Rows with equal ids each get their row; an empty table gives an empty one.  Very long texts are taken whole.  Columns named like the outputs are
replaced; all others, whatever their names, are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import fresh, small_batches, table, without

OUT = ("lang_pred", "score", "rejected")
SAMPLE_BYTES, LEVEL, MARGIN = 32_768, 9, 0.002
SAMPLE_ROWS, PIECES, PIECE_CHARS = 256, 8, 200
BLOCK_CHARS = 8_192
SHARED, RUN = 5, 16
WORDS = 200_000  # words whose sizes a worker remembers
_WORD = re.compile(r"[^\W\d_]+")
_models: dict = {}


def letters(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def spread(text: Column) -> Column:
    """A text, or of a long one ``PIECES`` pieces from its beginning to its end, without the words that are cut."""
    n = F.char_length(text)
    place = lambda i: F.floor((n - PIECE_CHARS) * i / (PIECES - 1)).cast("int") + 1
    piece = lambda i: F.regexp_replace(F.substring(text, place(i), F.lit(PIECE_CHARS)), r"^\S*\s|\s\S*$", "")
    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), piece), " ")
    return F.when(n <= PIECES * PIECE_CHARS, text).otherwise(whole)


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_bytes: int = SAMPLE_BYTES) -> dict:
    """{'languages': [...], 'texts': {language: bytes}} from labelled rows; languages ordered by number of rows.

    At most ``SAMPLE_ROWS`` rows for each language reach the driver.
    """
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    known = rows.where(lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.alias("text"), F.xxhash64(F.lit(5), F.col(f"`{id_col}`")).alias("h"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language
    if not counts:
        return build([], [], sample_bytes)
    # The least hashes of a language are looked for among about eight times as many, so few rows move.
    share = F.pmod("h", F.lit(1 << 52)) / float(1 << 52)
    bound = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, 8.0 * SAMPLE_ROWS / n))) for x, n in counts.items()])
    first = Window.partitionBy("lang").orderBy(share, "h", "text")
    sample = known.where(share <= bound).select("lang", "h", spread(F.col("text")).alias("text")).withColumn("k", F.row_number().over(first)).where(F.col("k") <= SAMPLE_ROWS)
    order = sorted(counts, key=lambda x: (-counts[x], x))
    return build(order, [(r["lang"], r["text"]) for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["k"]))], sample_bytes)


def build(languages: list[str], sample: list[tuple[str, str]], sample_bytes: int = SAMPLE_BYTES) -> dict:
    """The model of a sample of (language, text)."""
    split = [(x, letters(t).split(" ")) for x, t in sample]
    grams = lambda w: [tuple(w[i : i + SHARED]) for i in range(len(w) - SHARED + 1)]
    stands = Counter(g for _, w in split for g in set(grams(w)))

    def own(w: list[str]) -> str:
        shared = {i + j for i, g in enumerate(grams(w)) if stands[g] > 1 for j in range(SHARED)}
        return " ".join(x for i, x in enumerate(w) if i not in shared)

    texts = {}
    for x in languages:
        rows = [w for y, w in split if y == x]
        words = (" ".join(t for w in rows if (t := own(w))) or " ".join(" ".join(w) for w in rows)).split(" ")
        parts = [" ".join(words[i : i + RUN]) for i in range(0, len(words), RUN)]
        keep = max(1, min(len(parts), len(parts) * sample_bytes // max(1, len(" ".join(words).encode()))))
        data = " ".join(parts[k * len(parts) // keep] for k in range(keep)).encode()[:sample_bytes]  # cuts a few bytes of the last run
        texts[x] = (data * (1 + sample_bytes // len(data)))[:sample_bytes] if data else b""
    return {"languages": languages, "texts": texts}


class Sizes:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, model: dict, level: int):
        import zstandard as z

        self.languages = model["languages"]
        made = [z.ZstdCompressionDict(model["texts"][x], dict_type=z.DICT_TYPE_RAWCONTENT) if len(model["texts"][x]) >= 8 else None for x in self.languages]
        self.main = [z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False) for d in made]
        self.words: dict[str, tuple[int, ...]] = {}

    def word(self, w: str) -> tuple[int, ...]:
        """The sizes of a word alone."""
        got = self.words.get(w)
        if got is None:
            if len(self.words) >= WORDS:
                self.words.clear()
            data = f" {w} ".encode()
            got = tuple(len(c.compress(data)) for c in self.main)
            if len(w) <= 64:
                self.words[w] = got
        return got

    def of(self, text: str) -> list[int]:
        data = letters(text)
        sizes = [0] * len(self.main)
        for i in range(0, len(data), BLOCK_CHARS):
            block = data[i : i + BLOCK_CHARS]
            code = block.encode()
            alone = map(sum, zip(*map(self.word, set(block.split())), strict=True))
            sizes = [s + len(c.compress(code)) + a for s, c, a in zip(sizes, self.main, alone, strict=True)]
        return sizes

    def decide(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        if text is None or not self.languages or not _WORD.search(text):
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        sizes = self.of(text)
        best, second = sorted(sizes)[:2]
        score = min(1.0, 2.0 * (second - best) / second)
        return self.languages[sizes.index(best)], score, score < margin


def decider(model: dict, margin: float, level: int, held: str):
    key = hash((tuple(model["languages"]), tuple(sorted(model["texts"].items())), level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _models.get(key)
        if sizes is None:
            _models.clear()
            sizes = _models.setdefault(key, Sizes(model, level))
        for batch in batches:
            out = [sizes.decide(t, margin) for t in batch.column(held).to_pylist()]
            made = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            names = [n for n in batch.schema.names if n != held]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *made], [*names, *OUT])

    return run


def identify(df: DataFrame, model: dict, text_col: str = "text", margin: float = MARGIN, level: int = LEVEL, keep_text: bool = True) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``rejected``."""
    small_batches(df.sparkSession)
    (held,) = fresh(df, "_text")
    kept = without(df, *OUT)
    names = [c for c in kept.columns if keep_text or c != text_col]
    slim = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").alias(held))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema.fields if f.name != held) + "lang_pred string, score double, rejected boolean"
    return slim.mapInArrow(decider(model, margin, level, held), schema)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows that teach nothing: the remainder of crc32 of the id, as text, is 0."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == 0, F.lit(False))


def op6_language_id(spark, sf_dir):
    """The language of every whole text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep_text=False)


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
