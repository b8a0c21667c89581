"""Personal data by a semi-Markov conditional random field.

Patterns give the base spans.  Around characters that personal data needs
(digits, ``@``, ``=``, ``[``, a spelled ``(at)`` or ``(dot)``) the words of a text become a sequence, and the
field scores every segment of up to ``MAX_WORDS`` words as a whole: its shape,
digits, checksum, and the words beside it.  A dynamic program over segments
picks the best cut into entities and other words.  Its spans are added where
they touch no base span.

The weights are fitted here, by the gradient of the sequences' likelihood, on
``TRAINING_SEQUENCES`` labelled sequences drawn from a generator: formats of
each kind, beside dates, versions, amounts and other numbers that are none.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, read, slices

#: Kinds of the base patterns, in their order, then those that the field adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
TYPES = ("other", *KINDS)
#: Words of the longest entity; words beside a seed that join its sequence.
MAX_WORDS, BESIDE = 6, 3
TRAINING_SEQUENCES, EPOCHS = 700, 5

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# the contract's pattern; its leftmost match begins where a run of digits does
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches of the e-mail pattern, found from each ``@``."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and start."""
    out = _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


# -- sequences and features -----------------------------------------------

_SEED = re.compile(r"(?<!\S)\S*(?:[0-9@=\[]|\((?=\s*(?i:at|dot)\s*\)))\S*")
_WORD = re.compile(r"\S+")
_OPEN, _CLOSE = "([{<\"'|", ".,;:!?)]}>\"'|*#%$&"
_CUE = re.compile(r"(?i)(pass(word|wd)?|pwd|token|secret|api[_-]?key|key|auth|bearer)\W*\Z")
_CARD_CUE = re.compile(r"(?i)(card|visa|amex|credit|debit|iban|konto|tarjeta|carte)\W*\Z")
_PHONE_CUE = re.compile(r"(?i)(tel|phone|call|mobile|fax|cell|telefon|tél)\W*\Z")
_AT = re.compile(r"(?i)\s*[\[(]\s*at\s*[\])]\s*")
_DOT = re.compile(r"(?i)\s*[\[(]\s*dot\s*[\])]\s*")
_PHONE_SHAPE = re.compile(r"\+?\(?[0-9]{1,4}\)?([ .-]?\(?[0-9]{2,4}\)?){2,5}\Z")
_DATE = re.compile(r"[0-9]{1,4}([-/.])[0-9]{1,2}\1[0-9]{1,4}\Z")


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Word sequences around the seeds: (start, end) of each word."""
    end_of_last, words = -1, []
    for m in _SEED.finditer(text):
        left: list[tuple[int, int]] = []
        p = m.start()
        if p >= end_of_last:
            for _ in range(BESIDE):
                e = len(text[max(0, p - 200):p].rstrip()) + max(0, p - 200)
                if e <= max(end_of_last, 0) or e <= p - 200:
                    break
                s = max(text.rfind(c, max(0, e - 200), e) for c in " \n\t") + 1
                if s < max(end_of_last, 0) or s <= e - 200:
                    break
                left.insert(0, (s, e))
                p = s
        if words and p > end_of_last + 1:
            yield words
            words = []
        words += left
        if m.end() > end_of_last:
            words.append(m.span())
            end_of_last = m.end()
            for w in _WORD.finditer(text, m.end(), min(len(text), m.end() + 200)):
                if len(words) and (_SEED.match(text, w.start()) or w.start() - m.end() > 100):
                    break
                words.append(w.span())
                end_of_last = w.end()
                if words[-1][0] > m.end() and len([x for x in words[-BESIDE:] if x[0] >= m.end()]) == BESIDE:
                    break
    if words:
        yield words


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in _OPEN and text[start:start + 1] != "(":
        start += 1
    while end > start and text[end - 1] in _CLOSE:
        end -= 1
    return start, end


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def segment_features(text: str, start: int, end: int, words: int, before: str) -> list[str]:
    """Names of the features of a whole segment."""
    raw = text[start:end]
    a, b = trimmed(text, start, end)
    s = text[a:b]
    digits = sum(c in "0123456789" for c in s)
    letters = sum(c.isalpha() for c in s)
    other = len(s) - digits - letters
    f = ["bias", f"words={words}", f"digits={_bucket(digits, (1, 4, 7, 9, 10, 11, 13, 16, 17, 20))}",
         f"letters={_bucket(letters, (1, 2, 5, 12, 20))}", f"length={_bucket(len(s), (1, 4, 8, 12, 16, 20, 32))}",
         f"other={_bucket(other, (1, 2, 4, 8))}", f"mix={digits > 0}{letters > 0}"]
    if "\n" in raw:
        f.append("newline")
    if s[:1] == "+":
        f.append("plus")
    if s.count("@") == 1:
        left, right = s.split("@")
        good = bool(left) and "." in right.strip(".") and " " not in s
        f.append("address" if good else "at")
    if _AT.search(s):
        mail = _DOT.sub(".", _AT.sub("@", s))
        f.append("spelled" if re.fullmatch(r"[\w.+-]+@[\w-]+(\.[\w-]+)+", mail) else "spelled-part")
    parts = s.split(".")
    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) < 256 for p in parts):
        f.append("four-parts")
    if digits and not letters:
        if _DATE.match(s):
            f.append("date")
        only = re.sub(r"[ -]", "", s)
        if only.isdigit() and 13 <= len(only) <= 19:
            f.append("luhn" if luhn(only) else "not-luhn")
            if re.fullmatch(r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]+", s):
                f.append("card-groups")
        if _PHONE_SHAPE.match(s) and 9 <= digits <= 15:
            f.append("phone-shape")
            if re.search(r"[ .()-]", s):
                f.append("phone-parts")
            if re.match(r"00[1-9]|0[1-9]", s):
                f.append("trunk")
    value = s.rpartition("=")[2].strip(" \"'")
    if value and re.fullmatch(r"[0-9a-f]{12,}|[A-Za-z0-9+/_-]{16,}", value) and re.search("[0-9]", value) \
            and re.search("[A-Za-z]", value):
        f.append("random")
        if re.fullmatch(r"[0-9a-f]+", value):
            f.append("hex")
        elif not re.search("[a-z]", value):
            f.append("capitals")
    if "=" in s:
        head = s.partition("=")[0]
        f.append("named" if _CUE.search(head) else "assigned")
        if not value:
            f.append("no-value")
    if _CUE.search(before):
        f.append("after-name")
    if re.search(r"[=:]\s*[\"']?\Z", before):
        f.append("after-sign")
    if _CARD_CUE.search(before):
        f.append("after-card")
    if _PHONE_CUE.search(before):
        f.append("after-phone")
    return f


# -- the field ------------------------------------------------------------

class Field:
    """Weights of (feature, type) and of (type, next type)."""

    def __init__(self, names: dict[str, int]) -> None:
        self.names = names
        self.weights = np.zeros((len(names), len(TYPES)))
        self.moves = np.zeros((len(TYPES), len(TYPES)))

    def segments(self, text: str, words: list[tuple[int, int]], grow: bool = False
                 ) -> dict[tuple[int, int], list[int]]:
        out = {}
        for i in range(len(words)):
            before = text[max(0, words[i][0] - 24):words[i][0]]
            for d in range(1, min(MAX_WORDS, len(words) - i) + 1):
                feats = segment_features(text, words[i][0], words[i + d - 1][1], d, before)
                if grow:
                    for name in feats:
                        self.names.setdefault(name, len(self.names))
                out[i, d] = [self.names[name] for name in feats if name in self.names]
        return out

    def scores(self, segments: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int], np.ndarray]:
        out = {}
        for (i, d), f in segments.items():
            s = self.weights[f].sum(0)
            if d > 1:
                s[0] = -1e9  # other words stand alone
            out[i, d] = s
        return out

    def best(self, text: str, words: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The best cut: (first word, words, type)."""
        n, s = len(words), self.scores(self.segments(text, words))
        top = np.full((n + 1, len(TYPES)), -np.inf)
        top[0, 0] = 0
        back: dict = {}
        for j in range(1, n + 1):
            for d in range(1, min(MAX_WORDS, j) + 1):
                come = top[j - d][:, None] + self.moves + s[j - d, d][None]
                prev = come.argmax(0)
                value = come.max(0)
                for y in np.flatnonzero(value > top[j]).tolist():
                    top[j, y] = value[y]
                    back[j, y] = (d, int(prev[y]))
        out, j, y = [], n, int(top[n].argmax())
        while j:
            d, p = back[j, y]
            out.append((j - d, d, y))
            j, y = j - d, p
        return out[::-1]

    def gradient(self, segments: dict, gold: list[tuple[int, int, int]], n: int
                 ) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the log-likelihood of a labelled cut, by the forward
        and backward sums over all cuts."""
        s = self.scores(segments)
        kinds = len(TYPES)

        def lse(x, axis):
            m = x.max(axis, keepdims=True)
            m = np.where(np.isfinite(m), m, 0)
            with np.errstate(divide="ignore"):
                return np.log(np.exp(x - m).sum(axis)) + np.squeeze(m, axis)

        fore = np.full((n + 1, kinds), -np.inf)
        fore[0, 0] = 0
        for j in range(1, n + 1):
            come = [lse(fore[j - d][:, None] + self.moves, 0) + s[j - d, d]
                    for d in range(1, min(MAX_WORDS, j) + 1)]
            fore[j] = lse(np.array(come), 0)
        aft = np.full((n + 1, kinds), -np.inf)
        aft[n] = 0
        for i in range(n - 1, -1, -1):
            go = [lse(self.moves + (s[i, d] + aft[i + d])[None], 1) for d in range(1, min(MAX_WORDS, n - i) + 1)]
            aft[i] = lse(np.array(go), 0)
        total = lse(fore[n], 0)
        dw, dm = np.zeros_like(self.weights), np.zeros_like(self.moves)
        for (i, d), f in segments.items():
            p = np.exp(fore[i][:, None] + self.moves + (s[i, d] + aft[i + d])[None] - total)
            dm -= p
            np.subtract.at(dw, f, p.sum(0))
        last = 0
        for i, d, y in gold:
            np.add.at(dw, (segments[i, d], y), 1)
            dm[last, y] += 1
            last = y
        return dw, dm


def _examples(count: int, seed: int = 17) -> list[tuple[str, list[Span]]]:
    """Labelled texts: entities of each kind in several formats, among words
    and numbers that are none."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 10)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = r.choice("3456") + digits(r.choice((13, 14, 14, 14)))
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = r.choice(("", "", " ", "-"))
        return sep.join(body[k:k + 4] for k in range(0, len(body), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice((f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}",
                         f"0{digits(3)} {digits(7)}", f"00{r.randint(1, 99)} {a} {b}{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"))

    def email() -> str:
        name, host = word() + r.choice(("", "." + word(), str(r.randint(0, 99)))), word() + r.choice((".com", ".org", ".example.net"))
        return r.choice((f"{name}@{host}", f"{name}@{host}", f"{name} [at] {host}", f"{name}[at]{host}",
                         f"{name} (at) " + host.replace(".", " [dot] ", 1), f"{name}[at]" + host.replace(".", "[dot]")))

    def secret() -> str:
        hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((16, 18, 32, 40))))
        caps = r.choice(("AKIA", "ASIA", "")) + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567890") for _ in range(16))
        return r.choice((f"password={hexes}", f'token = "{hexes}"', caps, f"api_key={caps}", f"secret: {hexes}", f"pwd={word()}{digits(3)}{hexes}"))

    def number() -> str:
        body = r.choice("123456789") + digits(14)
        return body + next(c for c in "0123456789" if not luhn(body + c))

    def none() -> str:
        y, m = r.randint(1900, 2030), r.randint(1, 12)
        return r.choice((str(y), f"{y}-{m:02}-{r.randint(1, 28):02}", f"{m}/{r.randint(1, 28)}/{y}", f"{r.randint(0, 9)}.{r.randint(0, 9)}",
                         f"{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}", f"version {r.randint(1, 9)}.", f"{r.randint(1, 999)},{digits(3)}",
                         f"{r.randint(0, 23)}:{digits(2)}", digits(r.randint(1, 8)), f"[{r.randint(1, 99)}]", f"x = {r.randint(0, 99)}",
                         f"{word()}={word()}", f"@{word()}", f"{r.randint(1, 99)}%", f"${r.randint(1, 999)}.{digits(2)}",
                         f"{word()}{r.randint(0, 99)}", f"CC BY-NC {r.randint(1, 4)}.0", digits(r.randint(20, 30)), f"{r.randint(1, 99)} x {r.randint(1, 99)}",
                         f"{r.randint(1, 99)} {r.randint(1, 99)} {r.randint(1, 99)} {r.randint(1, 99)}", f"page = {r.randint(1, 9999)}",
                         number(), number(), f"{digits(3)} {word()} {digits(4)}", f"{digits(4)} {digits(4)}", "#" + digits(6)))

    make = {"email": email, "card": card, "phone": phone, "secret": secret,
            "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))}
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            marks = r.choice((("", "", "", ",", "."), ("", "", "", ",", "."), ("###", "%%%", "***"), (" |", "", ""), ("!!",)))
            text += " ".join(word() + r.choice(marks) for _ in range(r.randint(1, 4))) + r.choice((" ", " ", " ", "\n"))
            kind = r.choice((*make, "other", "other", "other"))
            if kind == "other":
                text += none()
            else:
                s = make[kind]()
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            text += r.choice(("", "", ".", ",", *(m for m in marks if m))) + " "
        out.append((text + word(), spans))
    return out


@lru_cache(maxsize=1)
def fitted(sequences: int = TRAINING_SEQUENCES, epochs: int = EPOCHS) -> Field:
    """The field, fitted on generated sequences (the same ones every time)."""
    field = Field({})
    data = []
    for text, spans in _examples(sequences):
        words = [m.span() for m in _WORD.finditer(text)]
        gold, i = [], 0
        for kind, a, b in [*spans, ("other", len(text) + 1, 0)]:
            while i < len(words) and words[i][1] <= a:
                gold.append((i, 1, 0))
                i += 1
            d = sum(1 for w in words[i:] if w[0] < b)
            if d:
                if d > MAX_WORDS:
                    break
                gold.append((i, d, TYPES.index(kind)))
                i += d
        if i == len(words):
            data.append((field.segments(text, words, grow=True), gold, len(words)))
    field.weights = np.zeros((len(field.names), len(TYPES)))
    order, r = list(range(len(data))), random.Random(5)
    seen_w, seen_m = np.full_like(field.weights, 1e-6), np.full_like(field.moves, 1e-6)
    for _ in range(epochs):
        r.shuffle(order)
        for k in order:
            dw, dm = field.gradient(*data[k])
            dw -= 1e-3 * field.weights
            seen_w += dw * dw
            seen_m += dm * dm
            field.weights += 0.3 * dw / np.sqrt(seen_w)
            field.moves += 0.3 * dm / np.sqrt(seen_m)
    return field


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Entities of the field that touch no base span."""
    out = []
    taken = sorted((a, b) for _, a, b in base)
    for words in regions(text):
        for i, d, y in field.best(text, words):
            if not y:
                continue
            a, b = trimmed(text, words[i][0], words[i + d - 1][1])
            if a < b and not any(x < b and a < z for x, z in taken):
                out.append((TYPES[y], a, b))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones together) as ``<KIND>``."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, column: str = "text", redact: bool = False) -> DataFrame:
    """Add ``base`` and ``spans`` (kind:start:end in code points, end exclusive,
    by kind and start, joined by commas) and, if asked, ``redacted``.

    Null and empty texts have no spans (redacted: null stays null).  Columns
    of these names are replaced; repeated rows each give a row.
    """
    field = fitted()
    names = ["base", "spans", *(["redacted"] if redact else [])]
    docs = docs.drop(*names)
    schema = extended(docs, **dict.fromkeys(names, "string"))
    keep = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            base, spans, clean = [], [], []
            for text in part.column(column).to_pylist():
                found = base_spans(text) if text else []
                more = added_spans(text, found, field) if text and _SEED.search(text) else []
                base.append(_joined(found))
                spans.append(_joined(found + more))
                if redact:
                    clean.append(redacted(text, found + more) if found or more else text)
            columns = [base, spans, *([clean] if redact else [])]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keep), *(pa.array(x, pa.string()) for x in columns)], [*keep, *names])

    return docs.mapInArrow(run, schema)


def op5_semi_markov(spark, sf_dir: str) -> DataFrame:
    """Personal data in all ``documents``."""
    found = find_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
