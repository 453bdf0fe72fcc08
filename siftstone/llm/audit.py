"""How filters interact: what each removes, and what it would have removed, in every order of applying them. DataFrame operations only.

Each document is one bit mask: which filters it fails. Per part, the documents are at most 2^k cells (mask, how many, how many of them good or toxic),
which is all that any order needs. A walk then visits all k! orders, each from the one before by swapping two neighbours ("plain changes"): the documents
that the swapped two remove together don't change, so only these two steps are taken anew from the cells, and every other step
stays as it is. Shapley sums gather along the walk.

The cells are gathered before anything is dealt by part, label or id: a part, an id or a text that a third of all rows share is one row a
task. Whether a text is that of a smaller doc_id is told by its SHA-256: rows are dealt by (digest, doc_id), so that thousands of
copies of one text are spread, and meet the one smallest doc_id of their digest. Texts aren't shuffled.

A null text counts as empty; a null doc_id is neither smaller nor larger than another, so its text is no repeat and repeats nothing, and
it has no label; rows of one doc_id with one text don't repeat each other; a document is good or toxic if any row of labels for its id
says so; a null part is the empty string; texts are read as a whole, however long; an empty table gives an empty table; columns
that aren't named are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filters of an audit at most: 720 orders.
MOST = 6
BLANK, WORDS, DISTINCT, CAPITALS = r"[\x20\x09-\x0D]+", 100, 80, 10
SIGNS = r"[#$%&*|]"
CAPITAL_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_changes(k: int) -> list[int]:
    """The places (from 0) whose neighbours are swapped, one after the other, so that all k! orders are met once."""
    if k < 2:
        return []
    inner, out, down = plain_changes(k - 1), [], True
    for i in range(factorial(k - 1)):
        out += range(k - 2, -1, -1) if down else range(k - 1)  # the last one moves through all places
        if i < len(inner):
            out.append(inner[i] + down)  # and stands first, or last, while the others change
        down = not down
    return out


def orders(k: int) -> list[tuple[int, ...]]:
    """The orders of the walk."""
    at = list(range(k))
    out = [tuple(at)]
    for p in plain_changes(k):
        at[p], at[p + 1] = at[p + 1], at[p]
        out.append(tuple(at))
    return out


def text_conditions(text: Column) -> dict[str, Column]:
    """The conditions that a text alone fails: too few words, too few distinct ones, too many capitals, signs."""
    words = F.array_remove(F.split(text, BLANK), "")
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITAL_LETTERS, ""))
    return {"A": n < WORDS, "B": 100 * kinds < DISTINCT * n, "C": 100 * capitals > CAPITALS * F.length(text), "D": text.rlike(SIGNS)}


def masks(docs: DataFrame, conditions: dict[str, Column], part: str, text: Column) -> DataFrame:
    """(doc_id, part, mask, n): bits in order of conditions, and one more for texts of a smaller doc_id. Rows that agree are one."""
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions.values())]
    own = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask"))
    rows = own.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeat = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), F.lit(1 << len(conditions))).otherwise(F.lit(0))
    met = rows.join(first, ["digest", "doc_id"], "left")
    return met.groupBy("doc_id", "part", (F.col("mask") + repeat).alias("mask")).agg(F.sum("n").alias("n"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): an array of (mask, n, good, toxic) for each part."""
    yes = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    met = masked.join(told.where("good = 1 OR toxic = 1"), "doc_id", "left")
    lost = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    sums = met.groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("good"), lost("toxic"))
    return sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _bit_of(k: int) -> Callable[[Column], Column]:
    """The mask of filter f alone."""
    return lambda f: F.element_at(F.array(*(F.lit(1 << i) for i in range(k))), f + 1)


def _long(n: int = 0) -> Column:
    return F.lit(n).cast("long")


def walk(parts: DataFrame, k: int) -> DataFrame:
    """(part, cells, visits, shapley): for every order of the walk its steps (filter, the mask of those before it, and the n, good and toxic that it removes), and for
    every filter what it removes summed over all orders."""
    held = F.col("cells")
    bit = _bit_of(k)

    def step(f: Column, before: Column) -> Column:
        """Filter f after those of the mask before: cells that fail f and none of them."""
        mine = lambda c: (c["mask"].bitwiseAND(before) == 0) & (c["mask"].bitwiseAND(bit(f)) != 0)
        add = lambda s, c: F.when(mine(c), F.struct((s["n"] + c["n"]).alias("n"), (s["good"] + c["good"]).alias("good"), (s["toxic"] + c["toxic"]).alias("toxic"))).otherwise(s)
        none = F.struct(_long().alias("n"), _long().alias("good"), _long().alias("toxic"))
        return _let(F.aggregate(held, none, add), lambda s: F.struct(f.cast("int").alias("f"), before.cast("int").alias("before"), s["n"].alias("n"), s["good"].alias("good"), s["toxic"].alias("toxic")))

    def swapped(steps: Column, p: Column) -> Column:
        """The next order's steps: the two at p change places, what they meet changes, and no other step is touched."""
        return _let(
            F.struct(F.element_at(steps, p + 1).alias("a"), F.element_at(steps, p + 2).alias("b")),
            lambda o: F.transform(
                steps,
                lambda s, i: F.when(i == p, step(o["b"]["f"], o["a"]["before"])).when(i == p + 1, step(o["a"]["f"], o["a"]["before"].bitwiseOR(bit(o["b"]["f"])))).otherwise(s),
            ),
        )

    def gathered(sums: Column, steps: Column) -> Column:
        own = lambda i: F.aggregate(F.filter(steps, lambda s: s["f"] == i), _long(), lambda x, s: x + s["n"])
        return F.transform(sums, lambda v, i: v + own(i))

    def state(steps: Column, visits: Column, sums: Column) -> Column:
        return F.struct(steps.alias("steps"), F.concat(visits, F.array(steps)).alias("visits"), gathered(sums, steps).alias("shapley"))

    first = F.array(*(step(F.lit(f), F.lit((1 << f) - 1)) for f in range(k)))
    begun = parts.withColumn("start", first)
    none = F.filter(F.array(F.col("start")), lambda _: F.lit(False))
    begin = state(F.col("start"), none, F.array(*(_long() for _ in range(k))))
    places = F.array(*map(F.lit, plain_changes(k))).cast("array<int>")
    done = F.aggregate(places, begin, lambda at, p: _let(swapped(at["steps"], p), lambda steps: state(steps, at["visits"], at["shapley"])))
    return begun.withColumn("end", done).select("part", "cells", "end.visits", "end.shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, conditions: Callable[[Column], dict[str, Column]] = text_conditions, repeats: str = "E", part: str = "lang", text: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order and step.

    conditions(text) names the filters, one letter each, with what fails them; repeats names the one of texts that a smaller doc_id has."""
    whole = F.coalesce(F.col(text), F.lit(""))
    told = conditions(whole)
    names = [*told, repeats]
    if len(names) > MOST:
        raise ValueError(f"at most {MOST} filters: the orders of more are too many to report")
    walked = walk(cells(masks(docs, told, part, whole), labels), len(names))
    total = lambda c, which: F.aggregate(F.filter(c, which), _long(), lambda x, s: x + s["n"])
    letter = lambda f: F.element_at(F.array(*map(F.lit, names)), f + 1)
    visits = walked.select("part", "cells", "shapley", F.explode("visits").alias("steps"))
    named = visits.withColumn("filter_order", F.array_join(F.transform("steps", lambda s: letter(s["f"])), "")).withColumn("all", total(F.col("cells"), lambda c: F.lit(True)))
    each = named.select("part", "cells", "shapley", "filter_order", "all", "steps", F.posexplode("steps").alias("place", "s"))
    bit = _bit_of(len(names))(F.col("s.f"))
    fails = total(F.col("cells"), lambda c: c["mask"].bitwiseAND(bit) != 0)
    return each.select(
        "part",
        "filter_order",
        (F.col("place") + 1).cast("int").alias("step"),
        (F.col("all") - F.aggregate(F.slice("steps", 1, F.col("place") + 1), _long(), lambda x, s: x + s["n"])).alias("kept"),
        F.col("s.n").alias("removed"),
        (fails - F.col("s.n")).alias("redundant"),
        total(F.col("cells"), lambda c: c["mask"] == bit).alias("unique_fails"),
        F.col("s.good").alias("good_lost"),
        F.col("s.toxic").alias("toxic_lost"),
        F.element_at("shapley", F.col("s.f") + 1).alias("shapley"),
    )


AUDIT_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals,
  min(doc_id) OVER (PARTITION BY t) AS smallest FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(ws) < {WORDS})::INT AS fa, (100 * len(list_distinct(ws)) < {DISTINCT} * len(ws))::INT AS fb,
  (100 * capitals > {CAPITALS} * length(t))::INT AS fc, regexp_matches(t, '{SIGNS}')::INT AS fd, coalesce(smallest < w.doc_id, false)::INT AS fe,
  coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fa, fb, fc, fd, fe, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
o(ord) AS (SELECT '' UNION ALL SELECT ord || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(ord, x)),
s AS (SELECT ord, step, substr(ord, step, 1) AS f, substr(ord, 1, step - 1) AS earlier FROM o, range(1, 6) r(step) WHERE length(ord) = 5),
e AS (SELECT c.*, concat(CASE WHEN fa = 1 THEN 'A' END, CASE WHEN fb = 1 THEN 'B' END, CASE WHEN fc = 1 THEN 'C' END, CASE WHEN fd = 1 THEN 'D' END, CASE WHEN fe = 1 THEN 'E' END) AS failed FROM c),
g AS (SELECT part, ord, step, f, n, good, toxic, contains(failed, f) AS mine, failed = f AS only_mine,
  earlier <> '' AND regexp_matches(failed, '[' || earlier || '_]') AS gone FROM e, s),
r AS (SELECT part, ord AS filter_order, step::INT AS step, f, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT mine), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE mine AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE mine AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE only_mine), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE mine AND NOT gone), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE mine AND NOT gone), 0)::BIGINT AS toxic_lost FROM g GROUP BY part, ord, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""
