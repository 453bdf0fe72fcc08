"""URL filters: rules first, then gradient-boosted trees on lexical features of the URL, trained from labelled URLs.

A rule (verdict, host and path) fits its host and all subdomains if the URL's path starts with the rule's path; the longest rule
that fits wins. URLs that no rule decides get the verdict of the trees: features are lengths, depth, digit ratio, entropy, counts of
parameters, hyphens and labels, and smoothed block rates of the host's last labels, of the first path part and of the host's words.

Labels come from the caller, as (url, verdict); by default from a seeded generator of URLs as pages and as spam have them, so that the trees
say nothing that the rules have said before. Block rates of suffixes are taken out of fold: a URL's own label never enters the
rate that the trees see with it.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there up to "?", "#" or the end. Null URLs and those
without "://" have an empty host and path, which no rule fits; the trees judge them by what they have. URLs are read as a whole, however long. Of rules
that fit and are equally long the last in code point order wins; a score of 0 is allow. Repeated rows each get a row; repeated labels teach once. Without
labels of both kinds the trees say the one label there is, or allow. An empty table gives an empty table; columns beside page_id and url are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Labelled URLs that the trees are fitted to at most: those with the smallest hashes.
MAX_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST, FOLDS = 40, 4, 0.2, 32, 20, 5


def host_of(url: str = "url") -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffixes(host: str, path: str) -> tuple[str, str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:]), path.split("/")[1] if path.startswith("/") else ""


def words(host: str) -> list[str]:
    return sorted(set(re.split(r"[.-]", host)))


def lexical(url: str | None, host: str, path: str) -> list[float]:
    url = url or ""
    tail = url[url.find("://") + 3 + len(host) + len(path) :] if "://" in url else ""
    query = tail.split("#")[0]
    letters = [c for c in url if c.isalnum()]
    return [
        len(url), len(host), len(path), len(tail), path.count("/"), host.count(".") + 1, host.count("-"), path.count("-") + path.count("_"),
        query.count("=") + query.count("&"), sum(c.isdigit() for c in url) / max(1, len(letters)), sum(c.isdigit() for c in host) / max(1, len(host)),
        sum(c.isdigit() for c in path), entropy(host), entropy(path), max(map(len, host.split("."))), float("." in path.rsplit("/", 1)[-1]), float("#" in tail), float(url[:6].lower() == "https:"),
    ]


@dataclass
class Trees:
    """Trees as arrays: feature (-1: leaf), threshold, value; node i has children 2 i + 1 and 2 i + 2."""

    start: float
    rates: dict[tuple[int, str], float]
    usual: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def inputs(self, url: str | None, host: str, path: str) -> list[float]:
        return [*lexical(url, host, path), *self.suffix_inputs(host, path)]

    def suffix_inputs(self, host: str, path: str) -> list[float]:
        """Of each suffix, and the highest of the host's words."""
        return [*(self.rates.get(k, self.usual) for k in enumerate(suffixes(host, path))), max(self.rates.get((3, w), 0.0) for w in words(host))]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f < 0, at, 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > threshold[at]))
            out += value[at]
        return out


def suffix_rates(rows: list[tuple[str, str, int]]) -> tuple[dict[tuple[int, str], float], float]:
    """Block rate of each suffix and host's word with at least two URLs, drawn towards the usual rate."""
    usual = sum(y for *_, y in rows) / max(1, len(rows))
    n: Counter = Counter()
    s: Counter = Counter()
    for host, path, y in rows:
        for k in (*enumerate(suffixes(host, path)), *((3, w) for w in words(host))):
            n[k] += 1
            s[k] += y
    return {k: (s[k] + 5 * usual) / (c + 5) for k, c in n.items() if c > 1}, usual


def gains(bins: np.ndarray, grad: np.ndarray, curve: np.ndarray, cuts: int) -> np.ndarray:
    """What each cut of a feature's bins gains: the second-order loss of the node less that of both sides, which need LEAST rows each."""
    gs, hs, ns = (np.cumsum(np.bincount(bins, w, cuts + 1))[:-1] for w in (grad, curve, None))
    g, h, n = grad.sum(), curve.sum(), len(grad)
    gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
    return np.where((ns >= LEAST) & (n - ns >= LEAST), gain, 0.0)


def fit_trees(rows: list[tuple[str, str, str, int]]) -> Trees:
    """rows: (url, host, path, 1 for block). Logistic loss, second-order gains, histograms of BINS quantiles; deterministic."""
    told = [(h, p, y) for _, h, p, y in rows]
    rates, usual = suffix_rates(told)
    y = np.array([r[3] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Trees(0.0 if not len(y) else 9.0 if y[0] else -9.0, rates, usual)
    model = Trees(math.log(usual / (1 - usual)), rates, usual)
    x = np.array([model.inputs(u, h, p) for u, h, p, _ in rows])
    for k in range(FOLDS):  # rates of a row's suffixes from the other folds
        part = Trees(0.0, *suffix_rates([t for i, t in enumerate(told) if i % FOLDS != k]))
        for i in range(k, len(rows), FOLDS):
            x[i, -4:] = part.suffix_inputs(*rows[i][1:3])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    g_at = np.full(len(y), model.start)
    size = 2 ** (DEPTH + 1) - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-g_at))
        grad, curve = y - p, p * (1 - p)
        feature, threshold, value, node = np.full(size, -1), np.zeros(size), np.zeros(size), np.zeros(len(y), np.int64)
        for k in range(size):
            own = np.flatnonzero(node == k)
            if not len(own):
                continue
            value[k] = RATE * grad[own].sum() / (curve[own].sum() + 1)
            if k >= 2**DEPTH - 1 or len(own) < 2 * LEAST:
                continue
            found = [(float((g := gains(bins[own, f], grad[own], curve[own], len(e))).max()), -f, int(g.argmax())) for f, e in enumerate(edges) if len(e)]
            gain, f, cut = max(found, default=(0.0, 0, 0))
            if gain > 1e-6:
                feature[k], threshold[k] = -f, edges[-f][cut]
                node[own] = 2 * k + 1 + (bins[own, -f] > cut)
        model.trees.append((feature, threshold, value))
        g_at += value[node]
    return model


def made_urls(seed: int = 23, count: int = 4000) -> list[tuple[str, int]]:
    """Labelled URLs, 1 for block: pages of sites, in several languages and ways to write paths; and spam as lists of blocked URLs show it: stuffed or random hosts, cheap or numeric ends,
    long queries, encoded or random paths. Some of either look like the other."""
    r = random.Random(seed)
    word = lambda a=3, b=9: "".join(r.choice("bcdfghlmnprst")[: i % 2 == 0] or r.choice("aeiou") for i in range(r.randint(a, b)))
    noise = lambda a, b, of="abcdefghijklmnopqrstuvwxyz0123456789": "".join(r.choice(of) for _ in range(r.randint(a, b)))
    sale = lambda: r.choice("cheap free win bonus casino pills loan crypto deal offer login verify account secure update prize hot spam farm click".split())
    end = lambda kinds: r.choice(kinds.split())

    def good() -> str:
        host = r.choice(("", "", "www.", "blog.", "m.", "docs.")) + word() + r.choice(("", "", "-" + word())) + "." + end("com com org net edu de fr es co.uk io info")
        path = "/".join(["", *r.choice(((), (r.choice(("en", "de", "fr", "es")),), ("wiki",), ("news", str(r.randint(1998, 2030))))), *(r.choice((word(), f"{word()}-{word()}", str(r.randint(1, 99999)))) for _ in range(r.randint(1, 3)))])
        return f"http{r.choice(('', 's', 's'))}://{host}{path}{r.choice(('', '', '/', '.html', '#top', f'?page={r.randint(1, 9)}', '?utm_source=feed', '?page=2&ref=x'))}"

    def bad() -> str:
        host = r.choice((lambda: "-".join(sale() for _ in range(r.randint(2, 4))) + noise(0, 4, "0123456789"), lambda: noise(12, 24), lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), lambda: f"{word()}.{sale()}-{sale()}.{noise(5, 9)}", lambda: f"{r.choice(('www.', '', 'm.'))}{sale()}-{sale()}.{word()}"))()
        host += "" if host.replace(".", "").isdigit() else "." + end("top xyz click biz info ru zip loan com net")
        path = r.choice((lambda: "/" + noise(16, 40), lambda: "/" + "-".join(sale() for _ in range(r.randint(3, 7))), lambda: f"/{sale()}.php", lambda: "/" + "%" + "%".join(noise(2, 2, "0123456789ABCDEF") for _ in range(6)), lambda: f"/{end('en de fr')}/{r.randint(1, 99999)}"))()
        query = "&".join(f"{noise(1, 4)}={noise(4, 20)}" for _ in range(r.choice((0, 0, 2, 4, 7))))
        return f"http{r.choice(('', '', 's'))}://{host}{path}{'?' + query if query else ''}"

    return [((bad if i % 3 == 0 else good)() if r.random() > 0.02 else (good if i % 3 == 0 else bad)(), int(i % 3 == 0)) for i in range(count)]


def parted(url: str) -> tuple[str, str, str]:
    """url, host and path, as host_of and path_of say."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    return (url, re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else (url, "", "")


@lru_cache(4)
def usual_trees(seed: int = 23, count: int = 4000) -> Trees:
    return fit_trees([(*parted(u), y) for u, y in made_urls(seed, count)])


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule and _says, the rule's verdict."""
    parts = pages.select("page_id", "url", host_of().alias("host"), path_of().alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    return parts.select("*", rule.alias("rule"), says.alias("_says"))


def train(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """labelled(url, host, path, verdict): takes each URL once, the max_rows with the smallest hashes."""
    once = labelled.where("verdict is not null").select("url", "host", "path", "verdict").distinct()
    rows = once.orderBy(F.xxhash64("url"), "url", "verdict").limit(max_rows).collect()  # bounded by max_rows
    return fit_trees([(r.url, r.host, r.path, int(r.verdict == "block")) for r in rows])


def url_verdicts(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' log-odds of block; null where a rule decides) of each row of pages(page_id, url).
    labelled(url, verdict): URLs to learn from; by default, those of the generator."""
    parts = judged(pages, rules)
    model = usual_trees() if labelled is None else train(labelled.select("url", host_of().alias("host"), path_of().alias("path"), "verdict"))

    def start():
        def some(page_ids, given, hosts, paths, rules, says):
            free = [i for i, x in enumerate(says) if x is None]
            inputs = [model.inputs(given[i], hosts[i], paths[i]) for i in free]
            score = dict(zip(free, model.score(np.array(inputs, float)).tolist(), strict=True)) if free else {}
            verdicts = [x or ("block" if score[i] > 0 else "allow") for i, x in enumerate(says)]
            return [(p, h, w, r, v, round(score[i], 9) if i in score else None) for i, (p, h, w, r, v) in enumerate(zip(page_ids, hosts, paths, rules, verdicts, strict=True))]

        return some

    return map_slices(parts, "page_id long, host string, path string, rule string, verdict string, score double", start)
