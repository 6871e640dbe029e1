"""Encoding text as pieces between spaces, with a bounded memory of pieces seen before.

A pre-tokeniser never joins what stands on both sides of a boundary that its pattern cannot cross.
For such a boundary the ids of the whole text are the ids of the parts, one after the other, so a
part seen before need not be encoded again.  Two boundaries are used:

* ``word``: the pattern drops white space, so every space and line feed is a boundary, and no part
  keeps it;
* ``byte``: the pattern lets a space lead the word after it, and a space that follows a character
  other than white space starts a new match, so the text splits before each such space, which the
  part after it keeps.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from itertools import accumulate, groupby

STEP = 65_536
_BLANK_THEN_SPACE = re.compile(r"\s |^ ")
_BYTE_SPLIT = re.compile(r"(?<=\S)(?= )")


class Memory(dict):
    """Piece -> value, at most twice ``most`` entries: the younger half replaces the older when full."""

    def __init__(self, encode, most: int = 400_000):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            value = self.encode([piece])[0]
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value

    def learn(self, pieces) -> None:
        """Encode, in one call, the pieces that are not in memory."""
        new = [p for p in set(pieces) if p not in self and p not in self.old]
        if len(new) > 1:
            for k in range(0, len(new), 4096):
                part = new[k : k + 4096]
                for p, v in zip(part, self.encode(part), strict=True):
                    if len(self) >= self.most:
                        self.old = dict(self)
                        self.clear()
                    self[p] = v


def boundary_kind(path: str) -> str:
    """'word', 'byte' or 'none', from the pre-tokeniser that a tokenizer file describes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"]):
        return "none"
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    norm = spec.get("normalizer") or {}
    norms = {n["type"] for n in norm.get("normalizers", [norm]) if n}
    if first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+") and norms <= {"NFC", "Replace", "Lowercase"}:
        return "word"
    if first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"] and not norm:
        return "byte"
    return "none"


def library(path: str):
    """The tokenizer of a .json file, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def word_pieces(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def byte_pieces(text: str) -> list[str]:
    """Parts whose ids, joined, are the ids of ``text``."""
    if _BLANK_THEN_SPACE.search(text):
        return _BYTE_SPLIT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + p for p in rest]]


def byte_slices(text: str, step: int = STEP) -> Iterator[str]:
    """Slices of about ``step`` characters whose ids, joined, are the ids of ``text``."""
    at = 0
    while len(text) - at > step:
        cut = _BYTE_SPLIT.search(text, at + step)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class ByteEncoder:
    """Ids as little-endian unsigned 32-bit bytes.

    ranks: the same vocabulary as a table of ranks, for a library so fast that remembering pieces would cost more than it
    saves; it takes texts in slices, so that its lists of ids stay small.  Pieces that hold a special token always go to the
    tokenizer file itself.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        import numpy as np

        self.tok, self.kind = library(path), boundary_kind(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pack = lambda ids: np.asarray(ids, dtype="<u4").tobytes()
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.memory = Memory(self.slow)

    def slow(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def ranked(self, text: str, step: int = STEP) -> bytes:
        """The ids of one text by the table of ranks."""
        if self.kind != "byte":
            return self.slow([text])[0] if self.has_special(text) else self.pack(self.fast(text))
        if not self.has_special(text):
            return b"".join([self.pack(self.fast(s)) for s in byte_slices(text, step)])
        parts = ((special, "".join(run)) for special, run in groupby(byte_pieces(text), self.has_special))
        return b"".join([self.slow([p])[0] if special else self.ranked(p, step) for special, p in parts])

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.fast:
            return [self.ranked(t) if t else b"" for t in texts]
        if self.kind != "byte":
            return self.slow(texts)
        parts = [byte_pieces(t) for t in texts]
        self.memory.learn(p for ps in parts for p in ps)
        return [b"".join(map(self.memory.__getitem__, ps)) if t else b"" for t, ps in zip(texts, parts, strict=True)]


def starts(pieces: list[str], at: int) -> list[int]:
    """Where each piece of ``word_pieces`` begins, for a text that begins at ``at``."""
    return list(accumulate((len(p) + 1 for p in pieces), initial=at))[:-1]
