"""Brute-force versions of the operators' contracts, on plain Python values."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import pairwise


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# ---- secrets ----
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def secrets(text):
    t = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(t) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(spans)]


CANDIDATE, ALLOWED = re.compile("[A-Za-z0-9+/=_-]{20,}"), re.compile(r"(/|\./|\.\./)|([A-Za-z]+[-_/=])+[A-Za-z]*$|[-_=+/]+$|[0-9-]+$")


def entropies(s, window=16):
    """Best over the windows: of capitals, small letters, digits, and all of them; each window is counted anew."""
    best = [0.0] * 4
    for i in range(len(s) - window + 1):
        for k, chars in enumerate(("[A-Z]", "[a-z]", "[0-9]", "[A-Za-z0-9]")):
            c = Counter(re.findall(chars, s[i : i + window]))
            n = sum(c.values())
            if 4 * n >= window:
                best[k] = max(best[k], round(-sum(v / n * math.log2(v / n) for v in c.values()), 6))
    return best


def odd_looking(s):
    """The entropy rule on one candidate."""
    three = lambda x: all(re.search(c, x) for c in ("[A-Z]", "[a-z]", "[0-9]"))
    if three(s) and not ALLOWED.match(s) and sum(e > 1.9 for e in entropies(s)[:3]) >= 2:
        return True
    rest = "/".join(p for p in re.split("[-_/=+]", s) if not re.fullmatch("[A-Za-z]{0,19}[0-9]{0,4}", p))
    if len(rest) < 16:
        return False
    if re.fullmatch("[A-Za-z/]+[0-9]{0,4}", rest):
        humps = re.search("[A-Z]", rest) and re.fullmatch("[a-z]*[0-9]{0,4}", re.sub("[A-Z]{1,3}[a-z]{2,}", "", rest))
        return not humps and entropies(rest)[3] > 3.6
    return sum(e > 1.9 for e in entropies(rest)[:3]) >= 2 if three(rest) else entropies(rest)[3] > 3.4


def all_secrets(text):
    """Base and entropy spans, by start, then kind as listed."""
    t, base = text or "", secrets(text)
    more = [("entropy", m.start(), m.end()) for m in CANDIDATE.finditer(t) if all(m.end() <= a or b <= m.start() for _, a, b in base) and odd_looking(m[0])]
    return sorted(base + more, key=lambda x: (x[1], ("assign", "access", "hex", "entropy").index(x[0])))


def redacted(text, mark="[SECRET]"):
    out, end = "", 0
    for _, a, b in all_secrets(text):
        if a >= end:
            out += text[end:a] + mark
        end = max(end, b)
    return out + text[end:]


# ---- licences ----
def licences(text, L):
    """(identifiers, licences, status); ``L`` holds the fixed tables and the patterns of words.  Sentences are sought token by token."""
    critical = re.compile(L.CRITICAL, re.A)
    t = text or ""
    if not critical.search(t):
        return [], [], "none"
    t = re.sub(r"(?m)^[ \t]*(?://+|#+|/?\*+/?|--+|;+|%+)[ \t]?", "", t)
    t = re.sub(r"(?i)(spdx-license-identifier):\s*(" + L.SPDX_LIST + ")", "\n\n\\1=\\2\n\n", t)
    found = []
    for s in re.split(r"(?<=[.!?])(?<!\bv\.)(?<!\bV\.)\s+|\n\s*\n", t):
        if critical.search(s):
            spdx = re.search(L.SPDX, s)
            found += [("spdx", spdx[1])] if spdx else _sentence(s, L, critical)
    ids, used = [i for i, _ in found], [False] * len(found)
    out = []
    left = list(found)
    for licence, run in L.RULES:
        k = 0
        while k + len(run) <= len(left):
            if tuple(i for i, _ in left[k : k + len(run)]) == run:
                version = next((v for _, v in left[k : k + len(run)] if v), "")
                each = re.findall(rf"(?i){L.SPDX_ID}(?:\s+WITH\s+{L.SPDX_ID})?", version) if run == ("spdx",) else [version]
                out += [licence.replace("#", v) for v in each if run != ("spdx",) or v.upper() not in ("AND", "OR")]
                left[k : k + len(run)] = [("used", "")]
            k += 1
    used = [i for i, _ in left if i == "used"]
    status = "none" if not ids else "known" if len(used) == len(left) else "partial" if used else "unknown"
    return ids, list(dict.fromkeys(out)), status


def _sentence(s, L, critical):
    """Known sentences of one, and ``unknown`` for what is left of it with licence words."""
    rows = re.sub(r"[;:]\s+", "\n", s).split("\n")
    rows = [x for r in rows for x in (re.split(L.HOLDER_END, r) if re.search(L.HOLDER, r) else [r])]
    tokens = []  # (word, begins a line)
    for r in rows:
        w = re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", re.sub(r"(?<![0-9])\.|\.(?![0-9])", " ", re.sub(r"[^a-z0-9.]+", " ", r.lower())))
        tokens += [(x, k == 0) for k, x in enumerate(w)]
    starts = lambda i: i == 0 or i >= len(tokens) or tokens[i][1]
    fits = lambda want, i: i + len(want) <= len(tokens) and all(t[0][0].isdigit() if w == "#" else t[0] == w for w, t in zip(want, tokens[i:], strict=False))
    by = lambda d: sorted(((k.split(" "), v) for k, v in d.items()), key=lambda x: (-len(" ".join(x[0])), " ".join(x[0])))
    plain = by({k: v for k, v in L.SENTENCES.items() if not (k.startswith("licensed under ") and k[15:] in L.NAMES)})
    names = by(L.NAMES)
    text = " ".join(w for w, _ in tokens)
    offsets = [sum(len(w) + 1 for w, _ in tokens[:i]) for i in range(len(tokens) + 1)]

    def match(i, after):
        if starts(i):
            for want, v in plain:
                if fits(want, i) and starts(i + len(want)):
                    return v, i + len(want), i
            lead = re.match("(" + L.SUBJECT.replace("[ |]", " ") + L.VERB.replace("[ |]", " ") + ")", text[offsets[i] :])
            if lead:
                # The shorter ways of reading what stands before the name, longest first.
                for j in range(i + lead[0].count(" "), i, -1):
                    if re.fullmatch(L.SUBJECT.replace("[ |]", " ") + L.VERB.replace("[ |]", " "), text[offsets[i] : offsets[j]]):
                        for want, v in names:
                            if fits(want, j):
                                return v, j + len(want), i
        if after:
            lead = re.match("(?:or|and) (?:under )?(?:the )?", text[offsets[i] :])
            for want, v in names if lead else ():
                if fits(want, i + lead[0].count(" ")):
                    return v, i + lead[0].count(" ") + len(want), i
        return None

    def named(x):
        """The sentence or notice that is all of ``x``."""
        is_ = lambda k, y: re.fullmatch(re.escape(k).replace(r"\#", "#").replace("#", "[0-9.]+"), y)
        lead = re.match(L.SUBJECT.replace("[ |]", " ") + L.VERB.replace("[ |]", " ") + "|(?:or|and) (?:under )?(?:the )?", x)
        return next((v for k, v in L.SENTENCES.items() if is_(k, x)), None) or next((v for k, v in L.NAMES.items() if lead and is_(k, x[lead.end() :])), None)

    out, rest, i, after = [], [], 0, True

    def close():
        lines, line = [], []
        for k in rest:
            if tokens[k][1] and line:
                lines.append(line)
                line = []
            line.append(tokens[k][0])
        lines = [" ".join(x) for x in [*lines, line]]
        whole = named(" ".join(tokens[k][0] for k in rest))
        if rest and whole:
            out.append((whole, next((tokens[k][0] for k in rest if tokens[k][0][0].isdigit()), "")))
            rest.clear()
            return
        other = [x for x in lines if not x.startswith("copyright") or critical.search(x.removeprefix("copyright"))]
        if critical.search(" ".join(other)):
            version = re.search(L.VERSION, " ".join(tokens[k][0] for k in rest))
            out.append(("unknown", version[0] if version else ""))
        rest.clear()

    while i < len(tokens):
        m = match(i, after)
        if m:
            close()
            version = next((w for w, _ in tokens[i : m[1]] if w[0].isdigit()), "")
            out.append((m[0], version))
            i, after = m[1], True
        else:
            rest.append(i)
            i, after = i + 1, False
    close()
    return out


# ---- near duplicates ----
def shingles(text, n=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_components(docs, n=4):
    """{id: (set size, component)} of (id, text), all pairs."""
    sets = {i: shingles(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


# ---- benchmark words ----
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contamination(text, bench, n=13):
    w, hit, items = words(text), set(), set()
    for item, t in bench:
        b = words(t)
        size = min(n, len(b))
        grams = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
        for i in range(len(w) - size + 1) if b else ():
            if tuple(w[i : i + size]) in grams:
                hit.update(range(i, i + size))
                items.add(str(item))
    return len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w)


# ---- languages ----
def language(text, model, margin, block=8192):
    """(language, score, rejected), compressing everything anew."""
    import zstandard as z

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words:
        return "und", 0.0, True
    data = " ".join(words)
    sizes = []
    for x in model["languages"]:
        d = z.ZstdCompressionDict(model["texts"][x], dict_type=z.DICT_TYPE_RAWCONTENT)
        size = lambda t: len(z.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_checksum=False).compress(t.encode()))  # noqa: B023, E731
        sizes.append(sum(size(b) + sum(size(f" {w} ") for w in set(b.split())) for b in (data[i : i + block] for i in range(0, len(data), block))))
    best, second = sorted(sizes)[:2]
    score = min(1.0, 2.0 * (second - best) / second)
    return model["languages"][sizes.index(best)], score, score < margin


# ---- repeats ----
def without_repeats(docs, n=20):
    """{id: (words, removed, digest)} of (id, text) with distinct ids."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w, gone = (t or "").encode().split(), set()
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if g in seen:
                gone.update(range(k, k + n))
            seen.add(g)
        out[i] = (len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


# ---- packing ----
def pieces(ids, capacity=1024, end=2):
    """(start, length, crc) of a document's ids."""
    ids = [*ids, end]
    first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
    cuts = [0, first, *range(first + capacity, len(ids) + 1, capacity)]
    return [(a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for a, b in pairwise(cuts)]


def places_are_sound(rows, capacity=1024):
    """rows: (sequence, offset, length); every sequence is gapless from 0 and within the capacity."""
    by = {}
    for s, o, n in rows:
        by.setdefault(s, []).append((o, n))
    for places in by.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= capacity
    return len(by)
