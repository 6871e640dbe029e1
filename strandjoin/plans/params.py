"""Options of a merge run."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, fields, replace

P_VALUES = (1.0, 0.05, 0.01, 0.001, 0.0001)
COUNT_MISMATCH = ("error", "truncate")
COMPAT = ("documented", "reference")


@dataclass(frozen=True)
class MergeParams:
    """Immutable options; every field is checked when a value is made.

    max_asm_len: None is no limit.  compat: 'documented' tests qualities when trimming forward reads
    and takes the overlap as the row of test 2; 'reference' tests base letters and takes the offsets that the
    original program takes.
    """

    p_value: float = 0.01
    min_overlap: int = 10
    max_asm_len: int | None = 999_999
    min_asm_len: int = 50
    min_trim_len: int = 1
    quality_threshold: int = 0
    max_uncalled: float = 1.0
    test_method: int = 1
    empirical_freqs: bool = True
    score_method: int = 2
    phred_base: int = 33
    cap: int = 40
    on_count_mismatch: str = "error"
    compat: str = "documented"
    restore_reverse: bool = False
    normalise_case: bool = False

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.p_value in P_VALUES, f"p_value is one of {P_VALUES}")
        need(self.min_overlap >= 1, "min_overlap is at least 1")
        need(self.test_method in (1, 2), "test_method is 1 or 2")
        need(self.score_method in (1, 2, 3), "score_method is 1, 2 or 3")
        need(0.0 <= self.max_uncalled <= 1.0, "max_uncalled is between 0 and 1")
        need(0 <= self.phred_base <= 126, "phred_base is a printable offset")
        need(self.cap >= 0, "cap is 0 (off) or positive")
        need(self.on_count_mismatch in COUNT_MISMATCH, f"on_count_mismatch is one of {COUNT_MISMATCH}")
        need(self.compat in COMPAT, f"compat is one of {COMPAT}")

    def describe(self) -> list[tuple[str, str]]:
        """(option, value) of every option, in order."""
        return [(f.name, str(getattr(self, f.name))) for f in fields(self)]


# Option letters, accepted long names (the program's own and its manual's) and fields.
OPTIONS = (
    ("f", ("left-fastq", "forward-fastq"), "left"),
    ("r", ("right-fastq", "reverse-fastq"), "right"),
    ("o", ("output",), "output"),
    ("p", ("p-value",), "p_value"),
    ("v", ("min-overlap",), "min_overlap"),
    ("m", ("max-asm-length", "max-assembly-length"), "max_asm_len"),
    ("n", ("min-asm-length", "min-assembly-length"), "min_asm_len"),
    ("t", ("min-trim-length",), "min_trim_len"),
    ("q", ("quality-theshold", "quality-threshold"), "quality_threshold"),
    ("u", ("max-uncalled-base",), "max_uncalled"),
    ("g", ("test-method",), "test_method"),
    ("e", ("empirical-freqs",), "empirical_freqs"),
    ("s", ("score-method",), "score_method"),
    ("b", ("phred-base",), "phred_base"),
    ("c", ("cap",), "cap"),
    ("y", ("memory",), "memory"),
    ("j", ("threads",), "threads"),
    ("h", ("help",), "help"),
)
P_TEXTS = {"1.0": 1.0, "0.05": 0.05, "0.01": 0.01, "0.001": 0.001, "0.0001": 0.0001}


@dataclass(frozen=True)
class Run:
    """A parsed command line; memory and threads are accepted and left to Spark."""

    left: str
    right: str
    output: str
    params: MergeParams
    memory: int | None = None
    threads: int | None = None
    help: bool = False


def memory_bytes(text: str) -> int:
    m = re.fullmatch(r"(\d+)([KMGkmg]?)", text)
    if not m:
        raise ValueError("memory is a number of bytes with K, M or G")
    return int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2].upper()]


def parse_args(argv: list[str]) -> Run:
    """Options in short or long form, ``--name value`` or ``--name=value``."""
    names = {}
    for letter, longs, field in OPTIONS:
        names |= {f"-{letter}": field} | {f"--{x}": field for x in longs}
    given: dict[str, str | bool] = {}
    rest = list(argv)
    while rest:
        word, eq, value = rest.pop(0).partition("=")
        if word not in names and word[:2] in names and not word.startswith("--"):
            word, eq, value = word[:2], "=", word[2:]
        if word not in names:
            raise ValueError(f"unknown option {word}")
        field = names[word]
        if field in ("empirical_freqs", "help"):
            given[field] = True
        else:
            if not eq and not rest:
                raise ValueError(f"{word} needs a value")
            given[field] = value if eq else rest.pop(0)
    if given.get("help"):
        return Run("", "", "", MergeParams(), help=True)
    for field in ("left", "right", "output"):
        if field not in given:
            raise ValueError(f"{field} is required")
    params = MergeParams()
    for field in ("min_overlap", "max_asm_len", "min_asm_len", "min_trim_len", "quality_threshold", "test_method", "score_method", "phred_base", "cap"):
        if field in given:
            params = replace(params, **{field: int(given[field])})
    if "p_value" in given:
        if given["p_value"] not in P_TEXTS:
            raise ValueError(f"p-value is one of {', '.join(P_TEXTS)}")
        params = replace(params, p_value=P_TEXTS[given["p_value"]])
    if "max_uncalled" in given:
        params = replace(params, max_uncalled=float(given["max_uncalled"]))
    if "empirical_freqs" in given:
        params = replace(params, empirical_freqs=False)
    threads = int(given["threads"]) if "threads" in given else None
    if threads == 0:
        raise ValueError("threads is not 0")
    memory = memory_bytes(given["memory"]) if "memory" in given else None
    if memory or threads:
        warnings.warn("memory and threads are set on the Spark session", stacklevel=2)
    return Run(given["left"], given["right"], given["output"], params, memory, threads)


# What each option does, for the help text; its default is that of the field.
HELP = {
    "left": "FASTQ file of the first reads",
    "right": "FASTQ file of the second reads",
    "output": "prefix of the four outputs",
    "p_value": f"level of the significance test, one of {', '.join(P_TEXTS)}; 1.0 switches it off",
    "min_overlap": "least overlap of a merged pair",
    "max_asm_len": "greatest length of a merged read",
    "min_asm_len": "least length of a merged read",
    "min_trim_len": "least length of a read after trimming",
    "quality_threshold": "reads that are not merged are cut where two neighbouring qualities are below it",
    "max_uncalled": "greatest share of N bases, from 0 to 1",
    "test_method": "1 tests with the least allowed overlap, 2 with the observed one",
    "empirical_freqs": "take equal base frequencies instead of those of the reads",
    "score_method": "1 expected score, 2 probability of a match, 3 plus and minus one without qualities",
    "phred_base": "character of quality 0",
    "cap": "greatest quality that is written; 0 is no limit",
    "memory": "bytes, with K, M or G (left to Spark)",
    "threads": "number of threads (left to Spark)",
    "help": "this text",
}


def usage() -> str:
    default = {f.name: f.default for f in fields(MergeParams)}
    lines = ["options:"]
    for letter, longs, field in OPTIONS:
        given = f" (default {default[field]})" if field in default and field != "empirical_freqs" else " (required)" if field in ("left", "right", "output") else ""
        lines.append(f"  -{letter}  {', '.join('--' + x for x in longs):45} {HELP[field]}{given}")
    return "\n".join(lines)
