"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re

from tablemine.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    under = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(under),
            "base_failed": len(w) < 20 or 100 * len(under) > 30 * len(w)}


def class_of(c):
    if ord(c) > 127:
        return "letter"
    if "a" <= c <= "z":
        return "lower"
    if "A" <= c <= "Z":
        return "upper"
    if "0" <= c <= "9":
        return "digit"
    if c in Q.SYMBOLS.decode():
        return "symbol"
    if c in Q.SENTENCE.decode():
        return "sentence"
    return "control" if ord(c) < 32 or ord(c) == 127 else "mark"


def histograms(text):
    w = words(text)
    classes = collections.Counter(class_of(c) for x in w for c in x)
    common = collections.Counter(x for x in w if x in Q.WORDS)
    n, m = sum(classes.values()), len(w)
    p = [classes[c] / max(n, 1) for c in Q.CLASSES]
    q = [common[x] / max(m, 1) for x in Q.WORDS]
    return p, [*q, (m - sum(common.values())) / max(m, 1)], n, m


def js(p, q):
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(total / 2, 0))


def quality(rows):
    """{position: (kept, class distance, word distance)} of (id, text, lang) rows."""
    base = [base_quality(t) for _, t, _ in rows]
    hist = [histograms(t) for _, t, _ in rows]
    fit = {}
    for lang in Q.LANGUAGES:
        own = [h for (_, _, g), b, h in zip(rows, base, hist)
               if g == lang and not b["base_failed"] and b["n_words"] >= Q.REFERENCE_WORDS]
        if own:
            mid = [sorted(h[0][k] for h in own)[math.ceil(len(own) / 2) - 1] for k in range(len(Q.CLASSES))]
            near = [h for h in own if sum(abs(x - y) for x, y in zip(h[0], mid)) <= Q.CLASS_LIMIT]
            if near:
                p = [sum(h[0][k] for h in near) / len(near) for k in range(len(Q.CLASSES))]
                q = [sum(h[1][k] for h in near) / len(near) for k in range(len(Q.WORDS))]
                fit[lang] = ([x / sum(p) for x in p], [*q, max(0.0, 1 - sum(q))])
    out = []
    for b, (p, q, n, m) in zip(base, hist):
        a, d = min(((js(p, fit[g][0]), js(q, fit[g][1])) for g in sorted(fit)), key=sum, default=(0.0, 0.0))
        bad = n >= Q.CLASS_LEAST and a > Q.CLASS_LIMIT + Q.CLASS_SLACK / math.sqrt(max(n, 1))
        bad |= m >= Q.WORD_LEAST and d > Q.WORD_LIMIT + Q.WORD_SLACK / math.sqrt(max(m, 1))
        out.append((not bad and not b["base_failed"], a, d))
    return out


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def groups(rows):
    """[(n_shingles, component)] of (id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if rows[i][0] is None or rows[j][0] is None:
                continue
            if same_id or a and b and 100 * len(a & b) >= 75 * len(a | b):
                label[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(len(s), low.get(root(i)) if rows[i][0] is not None else None) for i, s in enumerate(sets)]


def without_repeats(texts, width=35):
    """[(n_words, n_removed, kept words)]."""
    docs = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i:i + width]) for w in docs for i in range(len(w) - width + 1))
    out = []
    for w in docs:
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i:i + width])] > 1 for j in range(i, i + width)}
        out.append((len(w), len(gone), [x for k, x in enumerate(w) if k not in gone]))
    return out
