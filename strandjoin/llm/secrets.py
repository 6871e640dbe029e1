"""Secret scans: pattern spans and sliding-window entropy spans, in DataFrame functions only.

Base kinds (their spans are of the whole match, in code points, end exclusive):

* ``assign``: a key word, ``:`` or ``=``, and a value of 6 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 20 or more characters;
* ``hex``: 24 or more lower-case hexadecimal digits.

The method adds ``entropy`` spans: runs of 20 or more characters of the base64 alphabet are candidate
strings.  A window slides over each, in one walk that keeps the count of every letter and digit; a step changes the counts of
the character that enters and of the one that leaves, and with them the Shannon entropy of the window's characters of each class and of
all together.  A candidate of three classes becomes a span if its best windows pass the limits of two classes or more; one of fewer classes
if the entropy of a window's letters and digits together passes a higher limit, which words do not reach.  Candidates that overlap
a base span are suppressed, and paths and dashed identifiers are judged by what is left without their word-like parts.
Letters of one case alone are the weak spot: short random ones (about a quarter of those of 20 letters) look like words.

No step looks at all matches for each match: places are running sums, taken in blocks, and a redacted text is joined once
from pieces that are looked up in blocks of the text.

A null text has no spans, like an empty one.  Very long texts are taken whole.  No row is dropped; repeated rows give repeated
results and an empty table an empty one.  ``scan_secrets`` replaces columns named like its outputs; ``redact_secrets`` changes the text
column and leaves all others, whatever their names.  Everything is one narrow projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import added, larger, let, scanned, smaller
from .store import fresh, table, without

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
OUT = ("n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans", "secrets")

WINDOW = 16
#: Class, its characters, and the entropy in bits that a window must exceed.
CLASSES = (("upper", "A-Z", 1.9), ("lower", "a-z", 1.9), ("digit", "0-9", 1.9))
#: So many classes over their limits make a candidate of three classes a span.
LEAST_HIGH = 2
#: Limits, for all letters and digits of a window together, of candidates of letters, and of letters of one case with digits.
LETTERS, MIXED = 3.6, 3.4
#: Suppressed unless something else than word-like parts stands in them: paths and dashed or underscored identifiers of words.
ALLOW = r"^(/|\./|\.\./)|^([A-Za-z]+[-_/=])+[A-Za-z]*$|^[-_=+/]+$|^[0-9-]+$"
#: A word-like part of a candidate, and a part of a name in camel case.
WORDLIKE, HUMP = r"^[A-Za-z]{0,19}[0-9]{0,4}$", r"[A-Z]{1,3}[a-z]{2,}"

SPAN = "array<struct<kind:string,start:int,stop:int,secret:string>>"
FAR = 2**31 - 1
#: Characters of a block in which pieces of a text are looked up.
BLOCK = 1024


# ---- patterns -------------------------------------------------------------------------------------


def found(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans of leftmost non-overlapping matches: pieces between matches and matches alternate, so lengths give places."""

    def placed(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["gaps"], 1, F.size(x["hits"])), x["hits"], lambda g, h: g + F.char_length(h))
        one = lambda at: F.transform(x["hits"], lambda h, i: F.struct(F.lit(kind).alias("kind"), (F.get(at, i) + F.get(x["gaps"], i)).alias("start"), F.get(at, i + 1).alias("stop"), h.alias("secret")))
        return let(scanned(steps, 0, added), one)

    pieces = F.struct(F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g)).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    out = let(pieces, placed).cast(SPAN)
    return F.when(text.rlike(pattern), F.filter(out, keep) if keep is not None else out).otherwise(F.array().cast(SPAN))


def ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    place = lambda x: F.struct(x["start"], F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]), x["stop"])
    return F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(place(x).alias("p"), x.alias("x")))), lambda y: y["x"])


def base_spans(text: Column) -> Column:
    long_value = lambda x: F.char_length(F.regexp_extract(x["secret"], ASSIGN_VALUE, 1)) >= 6
    return ordered(F.concat(found(text, ASSIGN, "assign", long_value), found(text, ACCESS, "access"), found(text, HEX, "hex")))


def apart(spans: Column, base: Column) -> Column:
    """The ``spans``, in order, that overlap none of ``base``: no base span before reaches into one, and none begins in it."""

    def judged(events: Column) -> Column:
        is_base = lambda e: e["own"] == 0
        reach = scanned(F.transform(events, lambda e: F.when(is_base(e), e["x"]["stop"]).otherwise(-1)), -1, larger)
        ahead = scanned(F.transform(F.reverse(events), lambda e: F.when(is_base(e), e["x"]["start"]).otherwise(FAR)), FAR, smaller)
        last = F.size(events) - 1
        free = lambda r, a: F.filter(events, lambda e, i: ~is_base(e) & (F.get(r, i) <= e["x"]["start"]) & (F.get(a, last - i) >= e["x"]["stop"]))
        return F.transform(let(reach, lambda r: let(ahead, lambda a: free(r, a))), lambda e: e["x"])

    event = lambda own: lambda x: F.struct(x["start"].alias("at"), F.lit(own).alias("own"), x.alias("x"))
    both = F.array_sort(F.concat(F.transform(base, event(0)), F.transform(spans, event(1))))
    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(let(both, judged))


# ---- entropy --------------------------------------------------------------------------------------


def code(c: Column) -> Column:
    """A-Z as 1 to 26, a-z as 27 to 52, 0-9 as 53 to 62, anything else as 0."""
    a = F.ascii(c)
    return F.when(a.between(97, 122), a - 70).when(a.between(65, 90), a - 64).when(a.between(48, 57), a + 5).otherwise(0)


def window_entropies(s: Column, window: int = WINDOW) -> Column:
    """Struct of the largest entropy, over windows of ``s``, of the window's upper, lower and digit characters and of all of them.

    With counts c and n their sum, the entropy is log2(n) - sum(c log2 c) / n.  The counts stand in a text of one character for each
    letter and digit, of which a step rewrites two; n and the sums by class change by these two only.  A window with fewer
    than a quarter of its characters of the class counts as 0.
    """
    names = [name for name, _, _ in CLASSES]
    xlog = F.array(*[F.lit(k * math.log2(k) if k > 1 else 0.0) for k in range(window + 1)])
    logs = F.array(*[F.lit(math.log2(max(k, 1))) for k in range(window + 1)])
    of_class = lambda u, k: u.between(*((1, 26), (27, 52), (53, 62))[k])
    counted = lambda counts, u: F.when(u > 0, F.ascii(F.substring(counts, u, F.lit(1))) - 48).otherwise(0)
    put = lambda counts, u, c: F.when(u > 0, F.overlay(counts, F.chr(c + 48), u, F.lit(1))).otherwise(counts)

    def walked(units: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            def leave(old: Column) -> Column:
                return let(counted(state["counts"], old), lambda c: F.struct(old.alias("u"), c.alias("c"), put(state["counts"], old, c - 1).alias("counts")))

            def enter(gone: Column) -> Column:
                return let(counted(gone["counts"], x["u"]), lambda c: after(gone, c))

            def after(gone: Column, c: Column) -> Column:
                old, new = gone["u"], x["u"]
                less, more = F.get(xlog, gone["c"] - 1) - F.get(xlog, gone["c"]), F.get(xlog, c + 1) - F.get(xlog, c)
                fields = []
                for k, name in enumerate(names):
                    fields.append((state[f"n_{name}"] - of_class(old, k).cast("int") + of_class(new, k).cast("int")).alias(f"n_{name}"))
                    fields.append((state[f"s_{name}"] + F.when(of_class(old, k), less).otherwise(0.0) + F.when(of_class(new, k), more).otherwise(0.0)).alias(f"s_{name}"))
                return let(F.struct(put(gone["counts"], new, c + 1).alias("counts"), *fields), best)

            def best(now: Column) -> Column:
                total = lambda p: sum((now[f"{p}_{name}"] for name in names[1:]), now[f"{p}_{names[0]}"])
                high = lambda n, t: F.when((x["i"] >= window) & (n * 4 >= window), F.get(logs, n) - t / n).otherwise(0.0)
                each = [F.greatest(state[name], high(now[f"n_{name}"], now[f"s_{name}"])).alias(name) for name in names]
                same = [now[c].alias(c) for c in ("counts", *[f"{p}_{name}" for name in names for p in "ns"])]
                return F.struct(*same, *each, F.greatest(state["all"], high(total("n"), total("s"))).alias("all"))

            return let(let(F.coalesce(F.get(units, x["i"] - 1 - window)["u"], F.lit(0)), leave), enter)

        zeros = [v for name in names for v in (F.lit(0).alias(f"n_{name}"), F.lit(0.0).alias(f"s_{name}"))]
        zero = F.struct(F.lit("0" * 62).alias("counts"), *zeros, *[F.lit(0.0).alias(name) for name in (*names, "all")])
        return F.aggregate(units, zero, step, lambda z: F.struct(*[F.round(z[name], 6).alias(name) for name in (*names, "all")]))

    return let(F.transform(F.split(s, ""), lambda c, i: F.struct(code(c).alias("u"), (i + 1).alias("i"))), walked)


def suspicious(s: Column) -> Column:
    """A candidate string that the entropy rule reports: as a whole, or what is left of it without its word-like parts."""
    classes = lambda x: sum((x.rlike(f"[{c}]").cast("int") for _, c, _ in CLASSES), F.lit(0))
    high = lambda e: sum(((e[name] > limit).cast("int") for name, _, limit in CLASSES), F.lit(0)) >= LEAST_HIGH

    def judged(x: Column) -> Column:
        camel = x.rlike("[A-Z]") & F.regexp_replace(x, HUMP, "").rlike("^[a-z]*[0-9]{0,4}$")
        by_words = x.rlike("^[A-Za-z/]+[0-9]{0,4}$")
        verdict = lambda e: F.when(by_words, e["all"] > LETTERS).when(classes(x) >= 3, high(e)).otherwise(e["all"] > MIXED)
        return F.when((F.char_length(x) < WINDOW) | (by_words & camel), False).otherwise(let(window_entropies(x), verdict))

    rest = F.array_join(F.filter(F.split(s, "[-_/=+]"), lambda x: ~x.rlike(WORDLIKE)), "/")
    whole = F.when((classes(s) >= 3) & ~s.rlike(ALLOW), let(window_entropies(s), high)).otherwise(False)
    return whole | let(rest, judged)


def entropy_spans(text: Column, base: Column) -> Column:
    return F.filter(apart(found(text, CANDIDATE, "entropy"), base), lambda x: suspicious(x["secret"]))


# ---- scans and redaction --------------------------------------------------------------------------


def scan_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with counts, digests, and ``secrets``: an array of (kind, start, stop, secret) by start, then kind as listed."""
    held, base, more = fresh(df, "_text", "_base", "_more")
    df = without(df.withColumn(held, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), *OUT)
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    return (
        df.withColumn(base, base_spans(F.col(held)))
        .withColumn(more, entropy_spans(F.col(held), F.col(base)))
        .withColumns({f"n_{k}": n(k) for k in KINDS[:3]})
        .withColumn("n_entropy", F.size(more).cast("long"))
        .withColumn("base_sha256", F.sha2(written(F.col(base)).cast("binary"), 256))
        .withColumn("secrets", ordered(F.concat(base, more)))
        .withColumn("spans", written(F.col("secrets")))
        .drop(held, base, more)
    )


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` for each span; overlapping spans (ordered by start) are replaced as one."""

    def pieces(places: Column) -> Column:
        """Between the end of what came before and each span that begins a new gap, and after the last span."""
        reach = places["reach"]
        gaps = F.filter(F.transform(places["spans"], lambda x, i: F.struct(F.get(reach, i).alias("a"), x["start"].alias("b"))), lambda g: g["b"] >= g["a"])
        return F.concat(gaps, F.array(F.struct(F.element_at(reach, -1).alias("a"), F.lit(FAR).alias("b"))))

    def cut(blocks: Column, g: Column) -> Column:
        first, last = F.floor(g["a"] / BLOCK).cast("int"), F.least(F.floor(g["b"] / BLOCK).cast("int"), F.size(blocks) - 1)
        part = lambda i: F.substring(F.get(blocks, i), F.greatest(g["a"] - i * BLOCK, F.lit(0)) + 1, F.least(g["b"] - i * BLOCK, F.lit(BLOCK)) - F.greatest(g["a"] - i * BLOCK, F.lit(0)))
        return F.when(last >= first, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")

    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    reach = scanned(F.transform(spans, lambda x: x["stop"]), 0, larger)
    joined = lambda b: F.array_join(F.transform(let(F.struct(spans.alias("spans"), reach.alias("reach")), pieces), lambda g: cut(b, g)), mark)
    return F.when(F.size(spans) > 0, let(blocks, joined)).otherwise(text)


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of the text column replaced by ``mark``; overlapping spans are replaced as one."""
    base, spans = fresh(df, "_base", "_spans")
    text = F.col(f"`{text_col}`").cast("string")
    known = F.coalesce(text, F.lit(""))
    marked = df.withColumn(base, base_spans(known)).withColumn(spans, ordered(F.concat(base, entropy_spans(known, F.col(base)))))
    return marked.select(*[replaced(text, F.col(spans), mark).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])


def op4_secret_scan(spark, sf_dir):
    """Spans of every whole text."""
    found_in = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found_in.select("doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans")


QUERIES = {"op4_secret_scan": op4_secret_scan}
ORACLES = {
    "op4_secret_scan": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k(kind, name, p, least) AS (VALUES
  (1, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0),
  (2, 'access', 'AKIA[A-Z0-9]+', 20), (3, 'hex', '[0-9a-f]+', 24), (4, 'entropy', '[A-Za-z0-9+/=_-]+', 20)),
m AS (SELECT r, kind, name, p, least, regexp_extract_all(t, p) AS h, string_split_regex(t, p) AS g FROM d, k),
u AS (SELECT r, kind, name, p, least, unnest(h) AS h, unnest(g[:len(h)]) AS g, generate_subscripts(h, 1) AS i FROM m),
q AS (SELECT *, CAST(sum(length(g) + length(h)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop FROM u),
s AS (SELECT r, kind, name, h, stop - length(h) AS start, stop FROM q WHERE length(h) >= least AND (kind <> 1 OR length(regexp_extract(h, p, 2)) >= 6)),
b AS (SELECT * FROM s WHERE kind < 4),
c AS (SELECT * FROM s WHERE kind = 4 AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = s.r AND b.start < s.stop AND s.start < b.stop)),
x AS (SELECT DISTINCT h, array_to_string([y FOR y IN string_split_regex(h, '[-_/=+]') IF NOT regexp_full_match(y, '[A-Za-z]{0,19}[0-9]{0,4}')], '/') AS rest FROM c),
z AS (SELECT h AS v FROM x UNION SELECT rest FROM x),
w AS (SELECT v, i, unnest(string_split(substr(v, i, 16), '')) AS ch FROM z, unnest(range(1, length(v) - 14)) AS t(i)),
n AS (SELECT v, i, CASE WHEN ch BETWEEN 'A' AND 'Z' THEN 1 WHEN ch BETWEEN 'a' AND 'z' THEN 2 ELSE 3 END AS class, count(*) AS n FROM w WHERE regexp_matches(ch, '[A-Za-z0-9]') GROUP BY v, i, ch),
e AS (SELECT v, i, class, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits FROM n GROUP BY GROUPING SETS ((v, i, class), (v, i)) HAVING 4 * sum(n) >= 16),
f AS (SELECT v, count(DISTINCT class) FILTER (WHERE bits > 1.9) AS high, coalesce(max(bits) FILTER (WHERE class IS NULL), 0) AS bits FROM e GROUP BY v),
o AS (SELECT z.v, coalesce(high, 0) AS high, coalesce(bits, 0) AS bits, regexp_matches(z.v, '[A-Z]') AND regexp_matches(z.v, '[a-z]') AND regexp_matches(z.v, '[0-9]') AS three FROM z LEFT JOIN f ON f.v = z.v),
j AS (
  SELECT x.h FROM x JOIN o a ON a.v = x.h JOIN o y ON y.v = x.rest
  WHERE (a.three AND a.high >= 2 AND NOT regexp_matches(x.h, '^(/|\./|\.\./)|^([A-Za-z]+[-_/=])+[A-Za-z]*$|^[-_=+/]+$|^[0-9-]+$'))
    OR (length(x.rest) >= 16 AND CASE
      WHEN regexp_full_match(x.rest, '[A-Za-z/]+[0-9]{0,4}') THEN y.bits > 3.6 AND NOT (regexp_matches(x.rest, '[A-Z]') AND regexp_full_match(regexp_replace(x.rest, '[A-Z]{1,3}[a-z]{2,}', '', 'g'), '[a-z]*[0-9]{0,4}'))
      WHEN y.three THEN y.high >= 2 ELSE y.bits > 3.4 END)),
l AS (SELECT r, kind, start, name || ':' || start || ':' || stop AS one FROM (SELECT * FROM b UNION ALL SELECT c.* FROM c WHERE h IN (SELECT h FROM j)) AS found)
SELECT doc_id, count(*) FILTER (WHERE kind = 1) AS n_assign, count(*) FILTER (WHERE kind = 2) AS n_access, count(*) FILTER (WHERE kind = 3) AS n_hex, count(*) FILTER (WHERE kind = 4) AS n_entropy,
  sha256(coalesce(string_agg(one, ',' ORDER BY start, kind) FILTER (WHERE kind < 4), '')) AS base_sha256, coalesce(string_agg(one, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN l ON l.r = d.r GROUP BY d.r, doc_id""",
}
