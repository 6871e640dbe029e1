"""The merge of one pair in plain Python, written from the description and not from the engine."""

from strandjoin.functions import cutoffs

COMP = {"A": "T", "C": "G", "G": "C", "T": "A", "a": "T", "c": "G", "g": "C", "t": "A"}


def revcomp(s):
    return "".join(COMP.get(c, c) for c in reversed(s))


def base_value(x, y, qx, qy, method, p, base):
    q = sum(v * v for v in p.values())
    ex, ey = 10 ** (-(ord(qx) - base) / 10), 10 ** (-(ord(qy) - base) / 10)
    if "N" in (x, y):
        oes = 2 * q - 1
        return {1: oes, 2: -(1 - q), 3: -1}[method], oes
    if x in p and y in p:
        if x == y:
            rest = [p[c] for c in p if c != x]
            v = (1 - ex) * (1 - ey) + ex * ey * sum(r * r for r in rest) / sum(rest) ** 2
            oes = 2 * v - 1
            return {1: oes, 2: v, 3: 1}[method], oes
        rest = [p[c] for c in p if c not in (x, y)]
        v = 1 - (1 - ey) * ex * p[y] / (1 - p[x]) - (1 - ex) * ey * p[x] / (1 - p[y]) - ex * ey * sum(r * r for r in rest) / sum(rest) ** 2
        oes = -(2 * v - 1)
        return {1: oes, 2: -v, 3: -1}[method], oes
    return (0 if method < 3 else 1 if x == y else -1), 0


def best(f, fq, r, rq, method, p, base):
    top = None
    for d in range(len(f) - 1, -len(r), -1):
        ol = min(len(f), d + len(r)) - max(0, d)
        i, j = max(d, 0), max(-d, 0)
        vals = [base_value(f[i + k], r[j + k], fq[i + k], rq[j + k], method, p, base) for k in range(ol)]
        s, o = round(sum(v[0] for v in vals), 9), round(sum(v[1] for v in vals), 9)
        if s > (top[0] if top else 0):
            top = (s, d, ol, o)
    return top


def trim_forward(seq, qual, threshold, base):
    for i in range(1, len(seq)):
        if ord(qual[i - 1]) - base < threshold and ord(qual[i]) - base < threshold:
            return i
    return len(seq)


def trim_reverse(seq, qual, threshold, base):
    for i in range(len(seq) - 1, 0, -1):
        if ord(qual[i]) - base < threshold and ord(qual[i - 1]) - base < threshold:
            return i
    return 0


def merge(f, fq, r, rq, o, p):
    """(status, seq, qual, f, fq, r, rq, d)"""
    r, rq = revcomp(r), rq[::-1]
    base, cap = o.phred_base, lambda s: "".join(chr(min(ord(c), o.cap + o.phred_base)) if o.cap else c for c in s)
    top = best(f, fq, r, rq, o.score_method, p, base)
    if top:
        _, d, ol, oes = top
        i, j = max(d, 0), max(-d, 0)
        seq, qual = f[:i], fq[:i]
        for k in range(ol):
            x, y, u, v = f[i + k], r[j + k], ord(fq[i + k]), ord(rq[j + k])
            if x in "Nn" and y in "Nn":
                b, q = "N", min(u, v)
            elif x in "Nn":
                b, q = y, v
            elif y in "Nn":
                b, q = x, u
            elif x == y:
                b, q = x, u + v - base
            else:
                b, q = (x, u) if u > v else (y, v)
            seq, qual = seq + b, qual + chr(min(q, 126))
        seq, qual = seq + r[j + ol :], qual + rq[j + ol :]
        c = cutoffs.cutoff(o.p_value, o.min_overlap if o.test_method == 1 else ol, sum(v * v for v in p.values()))
        n = sum(c in "Nn" for c in seq)
        if (c is None or oes > c) and ol >= o.min_overlap and o.min_asm_len <= len(seq) and (o.max_asm_len is None or len(seq) <= o.max_asm_len) and n <= o.max_uncalled * len(seq):
            return "assembled", seq, cap(qual), None, None, None, None, d
    d = top[1] if top else None
    keep = trim_forward(f, fq, o.quality_threshold, base)
    f, fq = f[:keep], fq[:keep]
    if len(f) < o.min_trim_len:
        return "discarded", None, None, f, cap(fq), r, cap(rq), d
    cut = trim_reverse(r, rq, o.quality_threshold, base)
    r, rq = r[cut:], rq[cut:]
    ratio = lambda s: sum(c in "Nn" for c in s) / len(s) if s else 0
    bad = len(r) < o.min_trim_len or ratio(f) >= o.max_uncalled or ratio(r) >= o.max_uncalled
    return "discarded" if bad else "unassembled", None, None, f, cap(fq), r, cap(rq), d
