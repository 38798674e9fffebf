"""Secret scans (operator 7): fixed patterns, then character Markov models of random strings and ordinary identifiers.

Base kinds (assign, access, hex) are patterns whose matches are taken from left to right.  For all other words of ``SHORTEST``
characters and more, two character models of order 2 are compared: one trained on labelled random strings, one on labelled
ordinary identifiers, compounds and numbers.  The score of a word is the sum over its characters of the log-likelihood ratio;
a word is a secret (kind "random") if its score for each character and its whole score are both above the thresholds.  Of a
word that overlaps base spans only the parts that they leave are asked about, without the dots around them.  Plain numbers,
runs of keys and of the alphabet, drawn-out words and accession numbers are labelled ordinary; UUIDs, ISBNs and words of fewer
than ``DIFFERENT`` characters are never random.

Spans are kind:start:end in code points, end exclusive, by start and then by kind in the order assign, access, hex, random.
Null and empty texts have no spans; rows that repeat an id stand as often as they do; an empty table gives an empty table; other
columns are not read (``scan``) or kept as they are (``redacted``).  Texts of any length are scanned whole, in linear time.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcquarry.llm.common import Memo, held, keyed_text, map_rows, slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same matches as runs of [0-9a-f]+ that have 32 or more
#: Words of at least so many characters are asked about.
SHORTEST = 16
WORDS = re.compile(rf"[A-Za-z0-9+/_=.-]{{{SHORTEST},}}")
#: Numbers that name things openly: UUIDs and ISBNs.
OPEN = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|ISBN[-_]?[0-9X-]{10,17}", re.I)
#: Words of fewer different characters are patterns, not random.
DIFFERENT = 6
#: Rows of keys and runs of letters and digits.
RUNS = "qwertyuiop asdfghjkl zxcvbnm qwertzuiop azertyuiop yxcvbnm abcdefghijklmnopqrstuvwxyz 0123456789 1234567890 1qaz2wsx3edc4rfv5tgb".split()
#: Frequent parts of words of four languages.
PARTS = (
    "ing tion ment ness able ible less ful est ers the and with for ough ight ence ance ist ism ity ous ive ate ize ship ward"
    " sch keit heit lich ung ein ver ent ge be zu auf ab chen lein tz pf cht nder ander erei schaft"
    " eau que eux oi ou ai ette elle ieux oire able age esse eur ure aux"
    " ly wh th he in er an re on at en nd or nt st sh ll"
    " cion dad ado ido ando iendo mente ero era oso osa ito ita ura aje anza"
).split()


def labelled_samples(n: int = 4000, seed: int = 11) -> list[tuple[str, int]]:
    """(text, 1 if random): random strings of several alphabets, and identifiers, words, paths and numbers."""
    r = random.Random(seed)
    up, low, dig = string.ascii_uppercase, string.ascii_lowercase, string.digits
    alphabets = (dig + "abcdef", dig + "ABCDEF", up + low + dig, up + low + dig + "+/", up + dig, low + dig, up + low + dig + "_-", low, up, up + low, dig + "+/=_-")
    out = [("".join(r.choices(a, k=r.randint(SHORTEST, 64))), 1) for a in alphabets for _ in range(n // len(alphabets))]
    syllables = [c + v + e for c in "b c d f g h l m n p r s t v w st tr pl th sh ch".split() + [""] for v in "a e i o u ou ea io ee ie".split() for e in ("", "n", "r", "s", "t", "l", "nd", "ng")]
    common = "get set is has to from of by with the and on read write user name value index count list map key data file path time date size type node item task work page text line word code test main init load save open close send next last first max min sum error event token request response handler manager factory service client server config buffer stream".split()
    word = lambda: r.choice(common) if r.random() < 0.5 else "".join(r.choices(syllables, k=r.randint(1, 5)))
    styles = (
        lambda w: "_".join(w), lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "".join(x.title() for x in w),
        lambda w: "-".join(w), lambda w: "/".join(w), lambda w: "_".join(w).upper(), lambda w: "".join(w), lambda w: "_".join(w) + str(r.randint(0, 99)),
    )
    out += [(r.choice(styles)([word() for _ in range(r.randint(2, 8))]), 0) for _ in range(n)]
    # long compounds in any case, also of parts that seldom meet, and plain numbers
    grown = lambda: "".join(r.choice(PARTS if r.random() < 0.6 else syllables) for _ in range(r.randint(3, 12)))
    out += [(r.choice((str.lower, str.upper, str.title))(grown()), 0) for _ in range(3 * n)]
    out += [("".join(r.choices(dig, k=r.randint(4, 30))), 0) for _ in range(n // 2)]
    out += [(r.choice("-=_+/") * r.randint(20, 60), 0) for _ in range(n // 20)]
    out += [("".join(r.choices(dig, k=r.randint(1, 4))) * r.randint(6, 20), 0) for _ in range(n // 40)]
    out += [(f"{r.randint(1990, 2040)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}" * 2, 0) for _ in range(n // 40)]
    # dots inside: keys in parts, and hosts, files, modules, versions
    dotted = lambda: ".".join("".join(r.choices(up + low + dig + "_-", k=r.randint(6, 40))) for _ in range(r.randint(2, 3)))
    out += [(dotted(), 1) for _ in range(n // 10)] + [("".join(r.choices(up + low + dig + ".", k=r.randint(SHORTEST, 64))), 1) for _ in range(n // 10)]
    ends = "com org net html py json txt de fr es io csv md".split()
    out += [(r.choice(styles)([word() for _ in range(r.randint(1, 3))]) + r.choice((".", "/")) + ".".join(word() for _ in range(r.randint(1, 4))) + "." + r.choice(ends), 0) for _ in range(n // 2)]
    out += [(".".join(str(r.randint(0, 99)) for _ in range(r.randint(2, 6))), 0) for _ in range(n // 40)]
    # runs of keys and of the alphabet, drawn-out words, accession numbers
    runs = lambda: "".join((x[::-1] if r.random() < 0.3 else x)[r.randint(0, 4) :] for x in r.choices(RUNS, k=r.randint(1, 4)))
    out += [(r.choice((str.lower, str.lower, str.upper))(runs()), 0) for _ in range(n // 4)]
    for _ in range(n // 4):
        w = word()
        at = r.randrange(len(w))
        out.append((w[:at] + w[at] * r.randint(4, 30) + w[at:], 0))
    out += [("".join(r.choices(up, k=r.randint(1, 4))) + r.choice(("", "_", "-", ":")) + "".join(r.choices(dig, k=r.randint(6, 20))), 0) for _ in range(n // 8)]
    return [x for x in out if len(x[0]) >= 4]


class MarkovModel:
    """Character model with two characters of context, smoothed by the shorter contexts."""

    def __init__(self, texts: Iterable[str], order: int = 2, alphabet: int = 68, smoothing: float = 2.0):
        self.order, self.alphabet, self.smoothing = order, alphabet, smoothing
        self.grams: Counter = Counter()
        self.contexts: Counter = Counter()
        for t in texts:
            t = "^" * order + t
            for i in range(order, len(t)):
                for k in range(order + 1):
                    self.grams[t[i - k : i + 1]] += 1
                    self.contexts[t[i - k : i]] += 1
        self.log: dict[str, float] = Memo(lambda g: math.log(self.p(g)))

    def p(self, gram: str) -> float:
        lower = self.p(gram[1:]) if len(gram) > 1 else 1 / self.alphabet
        return (self.grams[gram] + self.smoothing * lower) / (self.contexts[gram[:-1]] + self.smoothing)

    def score(self, text: str) -> float:
        k, t = self.order, "^" * self.order + text
        return sum(self.log[t[i - k : i + 1]] for i in range(k, len(t)))


def merged(spans: Iterable[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class Scanner:
    """``per_char`` and ``least`` bound the log-likelihood ratio of a secret; see tests for held-out accuracy."""

    def __init__(self, samples: list[tuple[str, int]], per_char: float = 0.95, least: float = 8.0):
        self.random = MarkovModel(t for t, y in samples if y)
        self.ordinary = MarkovModel(t for t, y in samples if not y)
        self.per_char, self.least = per_char, least

    def ratio(self, text: str) -> float:
        return self.random.score(text) - self.ordinary.score(text)

    def is_random(self, word: str) -> bool:
        if len(set(word)) < DIFFERENT or OPEN.fullmatch(word.strip("+/_=.-")):
            return False
        ratio = self.ratio(word)
        return ratio >= self.least and ratio >= self.per_char * len(word)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind number, end) in order."""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        base, k = merged(sorted(found)), 0
        for m in WORDS.finditer(text):
            at = m.start()
            while k < len(base) and base[k][1] <= at:
                k += 1
            j = k
            while True:  # the word, or what base spans leave of it
                to = min(m.end(), base[j][0]) if j < len(base) else m.end()
                a, b = trimmed(text, at, to)
                if b - a >= SHORTEST and self.is_random(text[a:b]):
                    found.append((a, 3, b))
                if to == m.end():
                    break
                at = base[j][1]
                j += 1
                if at >= m.end():
                    break
        return sorted(found)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without the dots around it."""
    part = text[start:end]
    return start + len(part) - len(part.lstrip(".")), end - (len(part) - len(part.rstrip(".")))


def scanner() -> Scanner:
    """One per Python worker, kept between tasks."""
    return held(("secrets",), lambda: Scanner(labelled_samples()))


def written(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: Iterable[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for s, e in merged(spans):
        out += (text[at:s], mark)
        at = e
    return "".join((*out, text[at:]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every text."""

    def start():
        s = scanner()

        def work(keys, texts):
            rows = [s.spans(t) for t in texts]
            counts = [Counter(k for _, k, _ in r) for r in rows]
            return {key: keys, **{f"n_{kind}": [c[k] for c in counts] for k, kind in enumerate(KINDS)}, "base_sha256": [hashlib.sha256(written(x for x in r if x[1] < 3).encode()).hexdigest() for r in rows], "spans": [written(r) for r in rows]}

        return work

    return map_rows(keyed_text(docs, key, text), f"{key} long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string", start, key, text)


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the same columns and rows, each secret in ``text`` replaced by ``mark``; a null text stays null."""
    out = docs.select(*docs.columns)
    schema, names, at = docs.schema, docs.columns, docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        s = scanner()
        for b in slices(batches):
            texts = [None if t is None else redact(t, s.spans(t), mark) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(i).type) if i == at else b.column(i) for i in range(len(names))], schema=b.schema)

    return out.mapInArrow(run, schema)
