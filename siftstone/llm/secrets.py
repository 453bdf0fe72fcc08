"""Secrets: pattern matches that always stay, and values in a credential's place that are dear to guess.

The guess cost of a value is the least sum, over all ways to cut it into known words, syllables, dates, repeats, keyboard walks and
brute-force spans, of the parts' log10 guesses plus a charge for each cut: a dynamic program in the value's length. Repeats are runs of one
character, and a block of characters, not itself a repeat, that stands again behind itself, once or often. A value behind a credential word and a sign is a secret if that cost reaches MIN_COST; one behind "is", where prose stands too, if it reaches
MIN_COST_PROSE. Nothing but the cost decides. A value that isn't taken may hold a credential's word itself, so the search goes on at its start;
where two values end at the same place, the inner one is judged only by a lower bar.

Known words are COMMON and, behind them, the words of a public tokenizer's vocabulary in the order of its ranks. The caller names that file,
which the driver reads: results depend on it, so a missing one is an error, and no path means COMMON alone.

Null texts count as empty and give no span; texts and values are never cut, and walks and repeats are told at any length; of cuts that cost the
same any may be given, the cost is the same; repeated rows each give their own result; an empty table gives an empty table; columns beside
doc_id and text are not read.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterable
from itertools import islice, takewhile

from pyspark.sql import DataFrame

from .common import map_rows

KINDS = ("assign", "access", "hex", "guess")
MIN_COST, MIN_COST_PROSE = 9.0, 12.0
#: The longest word. Walks, repeats and blocks have no such bound.
LONGEST = 16

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What may stand before a value: a credential's word, then a sign or "is", then perhaps a quote.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|bearer|credentials?|login"""
    r"""|(?:api|access|private|auth|secret)[_ -]?key|client[_ -]?secret)["']?"""
    r"""(?:\x20*(?:=>|:=|->|[:=])\x20*|(?P<prose>\x20+is:?\x20+))["'`]?""",
    re.I | re.A,
)
VALUE_END = re.compile(r"""[\s"'`<>,;]|\Z""")
CUES = (b"passw", b"passp", b"passc", b"pwd", b"secret", b"token", b"bearer", b"credential", b"login", b"key")

# Common passwords and the words they are made of, most common first.
COMMON = """123456 password qwerty letmein admin welcome monkey dragon master login princess sunshine football baseball shadow
superman michael jordan hunter trustno iloveyou abc hello freedom whatever ninja mustang jessica charlie ashley daniel andrew
pepper joshua soccer hockey killer george summer winter spring autumn love secret access flower batman starwars computer
cheese maggie ginger thomas robert jennifer matthew amanda purple orange yellow silver golden diamond internet server system
root user test guest default change temp pass word key token example sample demo dev prod local home office company team
blue green red black white happy lucky magic power tiger eagle lion wolf bear snake angel devil king queen prince star moon
sun sky fire water earth wind money cash bank card house apple banana cherry coffee cookie sugar honey candy""".split()
# Rows of keys.
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "qazwsxedcrfvtgbyhnujmikolp", "abcdefghijklmnopqrstuvwxyz")

PLAIN = str.maketrans("@4031!5$7", "aaoeliss" + "t")
WALKS = {(a, b) for row in KEYS for s in (row, row[::-1]) for a, b in zip(s, s[1:], strict=False)}
DATES = re.compile(r"(?:19|20)\d\d(?:[./-]?(?:0[1-9]|1[0-2])(?:[./-]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[./-]?(?:0[1-9]|1[0-2])[./-]?(?:(?:19|20)\d\d|\d\d)")
CLASSES = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26))
#: log10 guesses for the place of a cut; for capitals in a word, for signs in place of its letters; of a date; of a block told again, beside how often.
CUT, CAPITALS, SIGNS, DATE, TWICE = 0.3, 0.3, 0.6, 4.6, 0.6
#: log10 guesses of a vowel and of another letter of syllables; at most this many other letters in a row.
VOWEL, OTHER, CLUSTER = math.log10(5), math.log10(21), 3
VOWELS = frozenset("aeiou")

Ranks = dict[str, float]


def ranked(words: Iterable[str]) -> Ranks:
    """log10 guesses of each word, most common first."""
    out: Ranks = {}
    for w in words:
        if 3 <= len(w) <= LONGEST and w not in out:
            out[w] = math.log10(len(out) + 2)
    return out


def dictionary(path: str | None) -> Ranks:
    """COMMON, then the vocabulary's words (tokens of a space and letters) by rank: some 30,000 short words, which travel with the task. A file that isn't there is an error; None means COMMON alone."""
    told: list[str] = []
    if path is not None:
        with open(path, "rb") as f:
            tokens = (base64.b64decode(line.split()[0]) for line in f if line.strip())
            told = [t[1:].decode().lower() for t in tokens if t[:1] == b" " and t[1:].isalpha() and t.isascii()]
    return ranked([*COMMON, *told])


RANK = ranked(COMMON)



def brute(c: str) -> float:
    return math.log10(next((n for test, n in CLASSES if c.isascii() and test(c)), 33 if c.isascii() else 1000))


class Starts:
    """Where parts of one kind that go on to here may start. A part costs best[start] + log10(its length): of two starts the later one gains
    less and less against the earlier, so each beats another for one stretch of ends, and a stack in the order in which they give way holds all
    that can still win."""

    def __init__(self):
        self.stack: list[tuple[int, float]] = []

    @staticmethod
    def gives_way(a: tuple[int, float], b: tuple[int, float]) -> float:
        """From which end on the earlier start a is no dearer than b."""
        more = (b[1] - a[1]) * math.log(10)
        return math.inf if more <= 0 else b[0] + (b[0] - a[0]) / math.expm1(min(more, 700))

    def add(self, start: int, cost: float) -> None:
        new = (start, cost)
        while len(self.stack) > 1 and self.gives_way(self.stack[-1], new) >= self.gives_way(self.stack[-2], self.stack[-1]):
            self.stack.pop()
        self.stack.append(new)

    def best(self, end: int) -> tuple[float, int]:
        at = lambda s: s[1] + math.log10(end - s[0])
        while len(self.stack) > 1 and at(self.stack[-2]) <= at(self.stack[-1]):
            self.stack.pop()
        return at(self.stack[-1]), self.stack[-1][0]


def repetitions(v: str) -> list[tuple[int, int, int]]:
    """All (start, end, period) where v repeats with a least period of 2 or more, at least twice, as far as it goes on: each has a start whose
    longest Lyndon word, by the order of letters or by its reverse, is one period."""
    n = len(v)

    def alike(most: int, same) -> int:
        """The largest size up to most for which same(from, to) holds piece by piece, by steps that double and then halve."""
        size, step = 0, 8
        while step and size < most:
            if (to := min(size + step, most)) and same(size, to):
                size, step = to, step * 2
            else:
                step //= 2
        return size

    found: dict[int, list[tuple[int, int]]] = {}
    for smaller in (str.__lt__, str.__gt__):
        end = [n] * (n + 1)  # of the longest Lyndon word from here
        seen: dict[int, tuple[int, int]] = {}  # by distance: the last place, and how far v went on alike from there
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n:
                at, more = seen.get(j - i, (n, 0))
                size = alike(min(at - i, n - j), lambda x, y: v[i + x : i + y] == v[j + x : j + y])  # noqa: B023
                size += more * (size == at - i)
                seen[j - i] = (i, size)
                if j + size == n or not smaller(v[i + size], v[j + size]):
                    break
                j = end[j]
            end[i], p = j, j - i
            runs = found.setdefault(p, []) if p > 1 else None
            if runs is None or any(a <= i and j <= b for a, b in runs[-1:]):
                continue
            b = j + (seen[p][1] if j < n else 0)
            a = i - alike(i, lambda x, y: v[i - y : i - x] == v[j - y : j - x])  # noqa: B023
            if b - a >= 2 * p:
                runs.append((a, b))
    return sorted({(a, b, p) for p, runs in found.items() for a, b in runs})


def parts(value: str, rank: Ranks = RANK) -> tuple[float, list[tuple[str, int, int]]]:
    """The least log10 guesses, and the parts that reach them as (kind, start, end). A word's length is bounded; brute force and syllables are
    running minima; walks, repeats and blocks keep the starts that can still win (Starts) for each run, at any length."""
    n, low = len(value), value.lower()
    low = low if len(low) == n else value
    plain = low.translate(PLAIN)
    bulk, said = [0.0], [0.0]  # running sums: as brute force, as syllables
    for c in value:
        bulk.append(bulk[-1] + brute(c))
        said.append(said[-1] + (VOWEL if c in VOWELS else OTHER))
    walk, same = [1] * n, [1] * n  # how long the walk, or the run of one character, is that ends here
    for i in range(1, n):
        walk[i] = walk[i - 1] + 1 if (low[i - 1], low[i]) in WALKS else 1
        same[i] = same[i - 1] + 1 if value[i] == value[i - 1] else 1
    twice: dict[int, list[tuple[int, int]]] = {}  # where a block ends for the second time: (the run's end, the block's length)
    for a, b, p in repetitions(value):
        twice.setdefault(a + 2 * p, []).append((b, p))
    told: list[tuple[int, int, dict[int, Starts]]] = []
    going = {"walk": Starts(), "repeat": Starts()}
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if value[i].isdigit() and (m := DATES.match(value, i)):
            dates.setdefault(m.end(), []).append(i)
    best: list[float] = [0.0]
    how: list[tuple[str, int]] = [("", 0)]
    least = (0.0, 0)  # of best[i] - bulk[i]: the best start of a brute-force span
    # Of best[i] - said[i]: the best start of syllables that end here, and by how many other letters in a row stand at the end, so that no more than CLUSTER do.
    spoken: list[tuple[float, int] | None] = [None] * (CLUSTER + 1)
    for j in range(1, n + 1):
        options = [(bulk[j] + least[0] + CUT, "brute", least[1])]
        for size in range(3, min(j, LONGEST) + 1):
            i = j - size
            if (r := rank.get(low[i:j])) is not None:
                options.append((best[i] + r + CUT + CAPITALS * (value[i:j] != low[i:j]), "word", i))
            elif (r := rank.get(plain[i:j])) is not None:
                options.append((best[i] + r + CUT + SIGNS, "word", i))
        options += ((best[i] + DATE + CUT, "date", i) for i in dates.get(j, ()))
        for kind, run, start in (("walk", walk[j - 1], 1.5), ("repeat", same[j - 1], brute(value[j - 1]))):
            if run == 3:
                going[kind] = Starts()
            if run >= 3:
                going[kind].add(j - 3, best[j - 3])
                cost, i = going[kind].best(j)
                options.append((cost + start + CUT, kind, i))
        if told or j in twice:  # a block is paid where it stands first; that it stands again, once or often, is told by how often
            told = [x for x in told if x[0] >= j] + [(b, p, {}) for b, p in twice.get(j, ())]
            for _, p, starts in told:
                own = starts.setdefault(j % p, Starts())
                own.add(j - p, best[j - p])
                cost, i = own.best(j)
                options.append((cost - math.log10(p) + TWICE, "repeat", i))
        c, fresh = value[j - 1], (best[j - 1] - said[j - 1], j - 1)
        if not ("a" <= c <= "z"):
            spoken = [None] * (CLUSTER + 1)
        elif c in VOWELS:
            spoken = [min(x for x in (*spoken, fresh) if x is not None), *[None] * CLUSTER]
        else:
            spoken = [None, min(x for x in (spoken[0], fresh) if x is not None), *spoken[1:-1]]
        options += ((said[j] + x[0] + CUT, "syllables", x[1]) for x in spoken if x is not None)
        cost, kind, i = min(options)
        best.append(cost)
        how.append((kind, i))
        least = min(least, (best[j] - bulk[j], j))
    out, j = [], n
    while j:
        kind, i = how[j]
        out.append((kind, i, j))
        j = i
    return best[n], out[::-1]


def guess_cost(value: str, rank: Ranks = RANK) -> float:
    return parts(value, rank)[0]


def find_secrets(text: str | None, least: float = MIN_COST, rank: Ranks = RANK, prose: float = MIN_COST_PROSE) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float | None]:
    """Base spans and all spans as (kind's index, start, end), by start, then kind; and the least cost of the values found."""
    if not text:
        return [], [], None
    low = text.encode("utf-8", "surrogatepass").lower()
    base = [(2, *m.span()) for m in HEX.finditer(text)]
    added: list[tuple[int, int, int]] = []
    costs: list[float] = []
    if "AKIA" in text:
        base += ((1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20)
    if any(c in low for c in CUES):
        assigned = [m for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        base += ((0, *m.span()) for m in assigned)
        costs += (guess_cost(m[2], rank) for m in assigned)
        spans = sorted((a, b) for _, a, b in base)
        at, here, end, bar = 0, 0, 0, math.inf  # end, bar: of the last value that was judged and not taken
        while m := CONTEXT.search(text, here):
            a = here = m.end()
            if a >= end:
                end, bar = VALUE_END.search(text, a).start(), math.inf
            b = end
            while b > a and text[b - 1] in ".!?)]}":
                b -= 1
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            own = prose if m["prose"] else least
            if b - a < 6 or own >= bar or any(y > a for x, y in takewhile(lambda s: s[0] < b, islice(spans, at, None))):
                continue
            if (cost := guess_cost(text[a:b], rank)) >= own:
                added.append((3, a, b))
                costs.append(cost)
                here = end
            else:
                bar = own
    order = lambda s: (s[1], s[0], s[2])
    return sorted(base, key=order), sorted(base + added, key=order), min(costs, default=None)


def secret_spans(docs: DataFrame, vocabulary: str | None, least: float = MIN_COST) -> DataFrame:
    """One row for each row of docs(doc_id, text): base_spans and spans as arrays of (kind, start, end) in code points, and least_cost, the log10 guesses of the value that is easiest to guess (null without values). vocabulary: a public tokenizer's ranks, see dictionary. Other columns are not read."""
    rank = dictionary(vocabulary)
    named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
    span = "array<struct<kind:string,start:int,end:int>>"

    def start():
        def one(doc_id, text):
            base, spans, cost = find_secrets(text, least, rank)
            return doc_id, named(base), named(spans), cost

        return one

    return map_rows(docs.select("doc_id", "text"), f"doc_id long, base_spans {span}, spans {span}, least_cost double", start)


def secret_digest(docs: DataFrame, vocabulary: str | None) -> DataFrame:
    from pyspark.sql import functions as F

    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    of = lambda k: lambda s: s.kind == k
    counts = [F.size(F.filter("base_spans", of(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return secret_spans(docs, vocabulary).select("doc_id", *counts, F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.round("least_cost", 6).alias("least_cost"), F.size("spans").cast("long").alias("n_spans"))
