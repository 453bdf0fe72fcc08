"""Personal data: pattern matches that always stay, and spans that a semi-Markov conditional random field adds.

The field scores candidate segments by features of the whole span (digit count, grouping, checksum, shape, cue words before
it); a dynamic program over each window of tokens picks boundaries and types together. Entities with letters have at most MAX_TOKENS tokens,
those of digits at most DIGITS[1] digits with at most GAP signs between two groups, and none is a piece of a longer row of lone digits. Pattern matches enter the program as fixed segments. Its weights are fitted by conditional likelihood to windows that
a seeded generator labels, so nothing depends on the corpus.

A window is a run of characters that candidates consist of, around what a candidate must hold: digits, a spelled-out dot or a
bracketed "at". No candidate reaches beyond its window, so decoding windows is decoding the whole text.

Null texts count as empty and give no span; texts are never cut, however long; of segmentations that score the same the one
with the later, shorter segments stays, whatever else is in the table; repeated rows each give their own result; an empty
table gives an empty table; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, GAP = 20, 4
#: Digits of a candidate without spelled-out parts, at least; and of any, at most.
DIGITS = (7, 19)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
CHAIN = re.compile(r"[0-9][0-9 ().-]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.S)
OPENS = re.compile(r"[0-9@]|(?<![A-Za-z])[dD][oO][tT](?![A-Za-z])|[\[({]\s?[aA][tT]\s?[\])}]")
#: Runs that hold all of a candidate of digits, or of one with letters; the mark that the latter must hold.
NUMERIC = re.compile(r"[0-9+(\[][0-9+().\[\]/\-\t\x20\u00a0]*")
SPELLED = re.compile(r"(?:[^\W\d]|[0-9.()\[\]{}/@\-\t\x20\u00a0])+")
DOT = re.compile(r"(?<![A-Za-z])dot(?![A-Za-z])|[\[({]\s?at\s?[\])}]", re.I)
FANGS = re.compile(r"[\[(]\.[\])]")

Span = tuple[int, int, int]  # kind's index, start, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[Span]:
    """The local part is the run of its characters before an "@", so it is read backwards from there: linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that pass its test, by kind, then start."""
    found: list[Span] = emails(text)
    for chain in CHAIN.finditer(text):
        lo, hi = chain.span()
        lo -= lo > 0 and text[lo - 1] == "+"
        found += ((1, *m.span()) for m in IP.finditer(text, lo, hi) if all(int(x.lstrip("0")[:4] or "0") <= 255 for x in m[0].split("."))) if hi - lo > 6 else ()
        found += ((2, *m.span()) for m in CARD.finditer(text, lo, hi) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)) if hi - lo > 12 else ()
        found += ((3, *m.span()) for m in PHONE.finditer(text, lo, hi) if 9 <= sum(c.isdigit() for c in m[0]) <= 15) if text[lo] == "+" else ()
    return sorted(found)


# --- the field ---

SHAPES = {
    "phone": re.compile(r"(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"),
    "long_phone": re.compile(r"(?:00|0|\(0\d{1,4}\) ?)\d{1,4}(?:[ ./-]\d{2,8}){1,4}"),
    "ip": re.compile(r"\d{1,3}(?:\.\d{1,3}){3}"),
    "defanged": re.compile(r"\d{1,3}(?:(?:\.|\[\.\]|\(\.\))\d{1,3}){3}"),
    "fours": re.compile(r"\d{4}(?:[ .-]\d{4}){2,3}(?:[ .-]\d{1,3})?"),
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "spelled": re.compile(r"[^\W\d_][\w.-]{0,63} ?(?:[\[({] ?at ?[\])}]|\bat\b) ?[A-Za-z0-9-]{2,63}(?: ?(?:[\[({] ?dot ?[\])}]|\bdot\b) ?[A-Za-z]{2,24}){1,3}", re.I),
    "bracketed": re.compile(r"[^\W\d_][\w.-]{0,63} ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z]{2,24}){1,3}", re.I),
    "ending": re.compile(r".*[^A-Za-z](?:com|org|net|edu|gov|info|[a-z]{2})", re.I),
    "prose": re.compile(r".*\bat (?:the|an?|this|that|each|every|his|her|its|our|your|my|their|one)\b.*", re.I),
    "date": re.compile(r"(?:\d{4}[./-]\d{1,2}[./-]\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4})(?:[ T]\d{1,2}.*)?"),
    "book": re.compile(r"97[89][ -](?:\d{1,7}[ -]){3}\d"),
    "lone": re.compile(r"\d(?: (?:- )?\d){8,14}"),
    "plain": re.compile(r"\d+"),
    "dots": re.compile(r"\d+(?:\.\d+)+"),
}
CUES = tuple(
    re.compile(x, re.I)
    for x in (r"mail|contact|write", r"\bip\b|host|server|address", r"card|visa|master|amex|pay", r"tel|phone|call|fax|mobile|whatsapp|ring|reach", r"isbn|issn|order|score|total|invoice|version|release|serial|\bref|part|item|\bno\b|\bid\b")
)
#: The span is part of something longer.
GOES_ON = re.compile(r"[^\W_][-.@_/+]?$"), re.compile(r"[-.@_/+]?[^\W_]")
FEATURES = 1 + len(SHAPES) + len(CUES) + 8


def features(before: str, span: str, after: str) -> list[float]:
    digits = [c for c in span if c.isdigit()]
    n = len(digits)
    shapes = {k: bool(p.fullmatch(span)) for k, p in SHAPES.items()}
    parts = [int(x) for x in re.findall(r"\d+", span)] if shapes["defanged"] else []
    return [
        1.0,
        *map(float, shapes.values()),
        *(float(bool(c.search(before[-24:]))) for c in CUES),
        float(9 <= n <= 15),
        float(13 <= n <= 19 and luhn("".join(digits))),
        float(13 <= n <= 19 and not luhn("".join(digits))),
        float(bool(parts) and max(parts) <= 255),
        float(bool(GOES_ON[0].search(before))),
        float(bool(GOES_ON[1].match(after))),
        float(span[:1].isspace() or span[-1:].isspace()),
        float(n < DIGITS[0]),
    ]


def segments(text: str, tokens: list[Span]) -> list[tuple[int, int]]:
    """Candidate entities of a window as (first token, token after the last): digits and their signs with DIGITS[0] to DIGITS[1] digits, or fewer in an address whose dots are bracketed; or
    letters, digits and their signs from a letter to a letter that hold "at" and then "dot", or a bracketed "at". Tokens with a kind are fixed and in no candidate; one that begins or ends among lone digits holds them all."""
    text_of = [text[a:b].lower() for _, a, b in tokens]
    numeric = [u[0] in "0123456789.-/()[]" or u[0].isspace() and u[0] not in "\n\r" for u in text_of]
    spelled = [x or u[0].isalpha() or u[0] in "{}_@" for x, u in zip(numeric, text_of, strict=True)]
    lone = [k < 0 and len(u) == 1 and u in "0123456789" for (k, _, _), u in zip(tokens, text_of, strict=True)]

    def goes_on(at: int, step: int) -> bool:
        """A lone digit has another one beside it, at most GAP signs away."""
        x = at + step
        while lone[at] and 0 <= x < len(tokens) and abs(x - at) <= GAP and tokens[x][0] < 0 and numeric[x] and not text_of[x][0].isdigit():
            x += step
        return lone[at] and 0 <= x < len(tokens) and lone[x] and abs(x - at) > 1

    begins = [not goes_on(i, -1) for i in range(len(tokens))]
    ends = [not goes_on(i, 1) for i in range(len(tokens))]
    out = []
    for i, u in enumerate(text_of):
        letters = u[0].isalpha()
        if tokens[i][0] >= 0 or not (letters or u[0] in "0123456789+(") or not letters and not begins[min(i + (u[0] in "+("), len(tokens) - 1)]:
            continue
        digits, gap, at, told = 0, 0, False, False
        for j in range(i, min(i + MAX_TOKENS, len(tokens)) if letters else len(tokens)):
            v = text_of[j]
            if tokens[j][0] >= 0 or not (spelled if letters else numeric)[j] and j > i:
                break
            digits += len(v) if v[0].isdigit() else 0
            gap = 0 if v[0].isdigit() else gap + 1
            if digits > DIGITS[1] or not letters and gap > GAP:
                break
            if letters:
                at = at or j > i and v == "at"
                told = told or at and v == "dot" or j > i + 1 and v == "at" and DOT.fullmatch(_bracketed(text_of, j)) is not None
                if told and v[0].isalpha() and v not in ("at", "dot"):
                    out.append((i, j + 1))
            elif v[0].isdigit() and ends[j] and (digits >= DIGITS[0] or digits > 3 and FANGS.search(text, tokens[i][1], tokens[j][2])):
                out.append((i, j + 1))
    return out


def _bracketed(text_of: list[str], j: int) -> str:
    """Token j with the brackets around it, if any."""
    a, b = j - 1 - (j > 1 and text_of[j - 1].isspace()), j + 2 + (j + 2 < len(text_of) and text_of[j + 1].isspace())
    return "".join(text_of[max(a, 0) : b])


def runs(text: str) -> list[tuple[int, int]]:
    """Where candidates can lie: runs of digits and signs with enough digits, and up to MAX_TOKENS tokens on either side of a spelled-out mark; those that overlap as one."""
    found = [m.span() for m in NUMERIC.finditer(text) if sum(map(m[0].count, "0123456789")) >= DIGITS[0] or FANGS.search(m[0])]
    for m in SPELLED.finditer(text):
        marks = [x.span() for x in DOT.finditer(text, *m.span())]
        if not marks:
            continue
        tokens = [x.span() for x in TOKEN.finditer(text, *m.span())]
        starts = [a for a, _ in tokens]
        for a, b in marks:
            first, last = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
            found.append((tokens[max(0, first - MAX_TOKENS)][0], tokens[min(len(tokens) - 1, last + MAX_TOKENS)][1]))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def windows(text: str, base: list[Span]) -> list[list[Span]]:
    """The tokens of each run; a base span is one token with its kind, any other token has kind -1."""
    fixed: list[Span] = []
    for k, a, b in sorted(base, key=lambda s: (s[1], -s[2])):
        if not fixed or a >= fixed[-1][2]:
            fixed.append((k, a, b))
    out, f = [], 0
    for a, b in runs(text):
        run, at = [], a
        while f < len(fixed) and fixed[f][2] <= a:
            f += 1
        while at < b:
            if f < len(fixed) and at >= fixed[f][1]:
                run.append((fixed[f][0], at, fixed[f][2]))
                at = fixed[f][2]
                f += 1
                continue
            m = TOKEN.match(text, at, min(fixed[f][1], b) if f < len(fixed) else b)
            run.append((-1, at, m.end()))
            at = m.end()
        out.append(run)
    return out


def lattice(text: str, tokens: list[Span]) -> tuple[list[tuple[int, int]], np.ndarray]:
    segs = segments(text, tokens)
    rows = [features(text[max(0, tokens[i][1] - 24) : tokens[i][1]], text[tokens[i][1] : tokens[j - 1][2]], text[tokens[j - 1][2] : tokens[j - 1][2] + 2]) for i, j in segs]
    return segs, np.array(rows, float).reshape(len(segs), FEATURES)


@dataclass
class Cases:
    """Labelled windows as arrays over all their candidates: window, first token, token after the last, features, kind (-1: no entity)."""

    window: np.ndarray
    first: np.ndarray
    last: np.ndarray
    phi: np.ndarray
    gold: np.ndarray
    count: int

    @classmethod
    def of(cls, made: list[tuple[str, list[Span]]]) -> Cases:
        rows, phis, n = [], [], 0
        for text, spans in made:
            tokens = [(-1, *m.span()) for m in TOKEN.finditer(text)]
            segs, phi = lattice(text, tokens)
            at = {(a, b): k for k, a, b in spans}
            rows += [(n, i, j, at.get((tokens[i][1], tokens[j - 1][2]), -1)) for i, j in segs]
            phis.append(phi)
            n += bool(segs)
        w, i, j, k = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        return cls(w, i, j, np.concatenate(phis), k, n)

    def likelihood(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Log-likelihood of the gold segmentations and its gradient: features of the gold segments less their expectation, by sums ahead and back over all windows at once."""
        score = self.phi @ w.T
        whole = np.logaddexp.reduce(score, axis=1)
        size = int(self.last.max())
        ahead, back = np.zeros((self.count, size + 1)), np.zeros((self.count, size + 1))
        for j in range(1, size + 1):
            s = np.flatnonzero(self.last == j)
            ahead[:, j] = ahead[:, j - 1]
            np.logaddexp.at(ahead[:, j], self.window[s], ahead[self.window[s], self.first[s]] + whole[s])
        for i in range(size - 1, -1, -1):
            s = np.flatnonzero(self.first == i)
            back[:, i] = back[:, i + 1]
            np.logaddexp.at(back[:, i], self.window[s], back[self.window[s], self.last[s]] + whole[s])
        p = np.exp((ahead[self.window, self.first] + back[self.window, self.last] - ahead[self.window, size])[:, None] + score)
        told = np.flatnonzero(self.gold >= 0)
        p[told, self.gold[told]] -= 1
        return float(score[told, self.gold[told]].sum() - ahead[:, size].sum()), -p.T @ self.phi


def made_windows(seed: int, count: int) -> list[tuple[str, list[Span]]]:
    """Labelled windows: entities in the forms people write them, and numbers that are none."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 8)))

    letter = lambda: r.choice("abcdefghilmnoprstu")
    name = lambda: r.choice((word(), f"{word()}{r.choice('._-')}{word()}", f"{letter()}.{letter()}", f"{word()}{r.choice('äéñøü')}{word()}", f"{word()}{d(2)}"))
    place = lambda: r.choice((word(), word(), f"{word()}-{word()}"))

    def spelled() -> str:
        at, dot = r.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " dot "), ("[at]", " dot ")))
        return at.join((name(), dot.join((place(), *r.choice((("com",), ("org",), ("co", "uk")))))))

    def card(ok: bool) -> str:
        while luhn(x := r.choice("3456") + d(15)) != ok:
            pass
        return r.choice((x, " ".join(x[i : i + 4] for i in range(0, 16, 4)), ".".join(x[i : i + 4] for i in range(0, 16, 4))))

    makes = (
        (0, spelled),
        (0, lambda: f"{name()}{r.choice((' [at] ', '(at)', ' (at) '))}{r.choice((place, letter))()}.{r.choice(('com', 'org', 'co.uk'))}"),
        (3, lambda: r.choice((" ".join(d(r.randint(9, 12))), " - ".join(" ".join(d(n)) for n in (3, 3, 4))))),
        (-2, lambda: r.choice((f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", " ".join(d(r.randint(7, 10))))),),
        (1, lambda: r.choice((".", "[.]", "(.)")).join(str(r.randint(0, 255)) for _ in range(4))),
        (2, lambda: card(True)),
        (3, lambda: r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"1 ({d(3)}) {d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(3)}", f"0{d(3)}/{d(6)}"))),
        (-1, lambda: r.choice((f"{r.randint(1900, 2030)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}", d(r.randint(1, 12)), f"{d(1)}.{d(1)}.{d(2)}", f"{d(5)}.{d(2)}", f"{d(4)}-{d(4)}", f"{d(3)} {d(4)}", f"{d(3)}.{d(3)}", f"{r.randint(300, 999)}.{d(3)}.{d(3)}.{d(3)}", f"{d(2)} {d(2)} {d(3)} {d(1)}", f"{d(20)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{r.randint(256, 999)}[.]{d(3)}[.]{d(3)}[.]{d(2)}"))),
        (-1, lambda: card(False)),
        (-1, lambda: f"{word()} at the dot {word()}"),
        (-1, lambda: f"{d(2)}, {d(3)}, {d(2)}, {d(4)}"),
    )
    cues = {
        0: ("mail ", "contact: ", "", ""),
        1: ("ip ", "server ", "", ""),
        2: ("card ", "visa: ", "", ""),
        3: ("call ", "phone: ", "tel ", "", ""),
        -1: ("order ", "in ", "id ", "page ", "ISBN ", "version ", "item no "),
        -2: ("order ", "invoice ", "ref ", "score ", "serial no ", "part ", "total: "),  # numbers that look like a phone's but for the word before them
    }
    out = []
    for _ in range(count):
        k, make = r.choice(makes)
        head = f"{word()} {word()} {r.choice(cues[k])}"
        x = make()
        out.append((f"{head}{x}{r.choice((' ', ', ', '. '))}{word()}", [(k, len(head), len(head) + len(x))] if k >= 0 else []))
    return out


@lru_cache(4)
def weights(seed: int = 17, count: int = 1500, rounds: int = 150) -> np.ndarray:
    """One row of weights for each kind, fitted by gradient ascent with a quadratic penalty."""
    cases = Cases.of(made_windows(seed, count))
    w, speed = np.zeros((len(KINDS), FEATURES)), np.zeros((len(KINDS), FEATURES))
    w[:, 0] = -2
    for _ in range(rounds):
        g = cases.likelihood(w)[1] - 0.05 * w
        speed = 0.8 * speed + g * (8 / cases.count)
        w = w + speed
    return w


def decode(text: str, tokens: list[Span], w: np.ndarray) -> list[Span]:
    """The best segmentation of a window; an added segment must also beat leaving it out by a nat."""
    segs, phi = lattice(text, tokens)
    if not segs:
        return []
    score = phi @ w.T - 1.0
    kind, top = score.argmax(1), score.max(1)
    ends: dict[int, list[int]] = {}
    for s, (_, j) in enumerate(segs):
        if top[s] > 0:
            ends.setdefault(j, []).append(s)
    best, by = [0.0] * (len(tokens) + 1), [-1] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for s in ends.get(j, ()):
            if (v := best[segs[s][0]] + top[s]) > best[j]:
                best[j], by[j] = v, s
    out, j = [], len(tokens)
    while j > 0:
        if by[j] < 0:
            j -= 1
        else:
            i, e = segs[by[j]]
            out.append((int(kind[by[j]]), tokens[i][1], tokens[e - 1][2]))
            j = i
    return out


def find_pii(text: str | None, w: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans; both by kind, then start."""
    if not text or not OPENS.search(text):
        return [], []
    base = base_spans(text)
    added = [s for run in windows(text, base) if len(run) > 1 for s in decode(text, run, w)]
    return base, sorted({*base, *added})


def digest(spans: list[Span], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in spans)


def pii_spans(docs: DataFrame, w: np.ndarray | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, base_spans and spans as arrays of (kind, start, end), in code points. Other columns are not read."""
    w = weights() if w is None else w
    named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
    span = "array<struct<kind:string,start:int,end:int>>"

    def start():
        def one(doc_id, text):
            base, spans = find_pii(text, w)
            return doc_id, named(base), named(spans)

        return one

    return map_rows(docs.select("doc_id", "text"), f"doc_id long, base_spans {span}, spans {span}", start)


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of pii_spans, made in the same pass."""
    from pyspark.sql import functions as F

    found = pii_spans(docs)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    of = lambda k: lambda s: s.kind == k
    counts = [F.size(F.filter("base_spans", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.array_except("spans", "base_spans")).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"))
