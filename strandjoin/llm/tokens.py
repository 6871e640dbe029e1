"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text longer than ``chunk`` characters is encoded in chunks that overlap.  Each encoding keeps the
offset of every unit it encoded.  Two neighbouring encodings are spliced at an offset of the overlap
that both have as a unit boundary and that is proven stable: the character before it is white space
that no token of the vocabulary's pre-tokeniser crosses, with a letter or digit after it and no white space before
it, and the units on both sides of it lie wholly inside both chunks.  Where an overlap holds no such offset (one run of 100,000 letters, say) it is
doubled, up to the rest of the text.  Memory is that of a chunk and its overlap.

Units are pieces between white space (see ``pieces``) for tokenizers whose pattern drops white space,
else the tokens that the library reports with their offsets.  SentencePiece models, which see
a text as a whole, are run over whole texts.

A null text counts as empty: 0 bytes, 0 tokens.  Ids may be null or repeated; each row gets its row, and an empty table gives an empty one.
Columns named like the outputs are replaced, all others but the text kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Memory, boundary_kind, library, starts, word_pieces
from .store import fresh, small_batches, table, without

OUT = ("n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened")
CHUNK, OVERLAP = 32_768, 256
BREAKS = " \n\t"  # white space to every tokenizer library
_encoders: dict = {}


class Units:
    """Encodes a chunk into units: their offsets in the text, their ends, and their numbers of tokens."""

    def __init__(self, path: str):
        self.whole = path.endswith(".model")
        if self.whole:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        self.tok = library(path)
        self.words = boundary_kind(path) == "word"
        self.memory = Memory(lambda ps: [len(e.ids) for e in self.tok.encode_batch_fast(ps, add_special_tokens=False)])

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of texts that need no chunks."""
        if self.whole:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        if not self.words:
            return [len(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        parts = [word_pieces(t) for t in texts]
        self.memory.learn(p for ps in parts for p in ps)
        return [sum(map(self.memory.__getitem__, ps)) for ps in parts]

    def units(self, text: str, at: int) -> list[tuple[int, int, int]]:
        """(offset, end, tokens) of each unit of a chunk that begins at ``at``."""
        if self.words:
            parts = word_pieces(text)
            self.memory.learn(parts)
            return [(o, o + len(p), self.memory[p]) for o, p in zip(starts(parts, at), parts, strict=True)]
        e = self.tok.encode(text, add_special_tokens=False)
        return [(at + a, at + b, 1) for a, b in e.offsets]


def _splice(left: list, right: list, text: str, low: int, high: int) -> int | None:
    """A proven stable common boundary in [low, high), or None."""
    here = {u[0]: k for k, u in enumerate(left)}
    for k, (offset, end, n) in enumerate(right):
        if not low < offset < high or text[offset - 1] not in BREAKS or text[offset - 2].isspace() or not text[offset : offset + 1].isalnum():
            continue
        i = here.get(offset)
        if i and k and left[i][1:] == (end, n) and end < high and left[i - 1][1] <= offset and right[k - 1][1] <= offset:
            return offset
    return None


def count_long(units: Units, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """(tokens, chunks, times an overlap was widened) of a text longer than a chunk."""
    total, chunks, widened = 0, 1, 0
    begin, end = 0, min(len(text), chunk + overlap)
    left = units.units(text[begin:end], begin)
    while end < len(text):
        lap, stop = overlap, end
        while True:
            low = stop - lap if stop == end else end - overlap
            right_end = min(len(text), max(stop, low + chunk + overlap))
            right = units.units(text[low:right_end], low)
            at = _splice(left, right, text, low, stop)
            if at is not None or stop == len(text):
                break
            widened += 1
            lap *= 2
            stop = min(len(text), end + lap)
            left = units.units(text[begin:stop], begin)
        if at is None:  # no boundary up to the end: the chunk was widened to the rest of the text
            return total + sum(n for _, _, n in left), chunks, widened
        total += sum(n for o, _, n in left if o < at)
        begin, end, left = at, right_end, [u for u in right if u[0] >= at]
        chunks += 1
    return total + sum(n for _, _, n in left), chunks, widened


def counter(path: str, limit: int, chunk: int, overlap: int, held: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _encoders.get(path) or _encoders.setdefault(path, Units(path))
        for batch in batches:
            texts = [t or "" for t in batch.column(held).to_pylist()]
            n, chunks, widened = [0] * len(texts), [1] * len(texts), [0] * len(texts)
            short = [k for k, t in enumerate(texts) if len(t) <= chunk or units.whole]
            for k, x in zip(short, units.count([texts[k] for k in short]), strict=True):
                n[k] = x
            for k in set(range(len(texts))) - set(short):
                n[k], chunks[k], widened[k] = count_long(units, texts[k], chunk, overlap)
            made = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n]), pa.array(chunks, pa.int32()), pa.array(widened, pa.int32())]
            kept = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != held]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*[c for c in batch.schema.names if c != held], *OUT])

    return run


def count_tokens(df: DataFrame, path: str, text_col: str = "text", limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The other columns of ``df`` with ``n_bytes``, ``n_tokens``, ``over_limit``, ``n_chunks`` and ``n_widened``."""
    small_batches(df.sparkSession)
    (held,) = fresh(df, "_text")
    names = [c for c in without(df, *OUT).columns if c != text_col]
    slim = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").alias(held))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != held)
    schema = ", ".join(x for x in (fields, "n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int") if x)
    return slim.mapInArrow(counter(path, limit, chunk, overlap, held), schema)


def op2_token_counts(spark, sf_dir):
    """Tokens of every whole text."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}
