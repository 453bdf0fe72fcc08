"""The filter interaction audit and token counts, against brute force and the tokenizers library."""

import itertools
import random
import re
from types import SimpleNamespace

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siftstone.llm import audit, tokens
from siftstone.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, mask string, part string, n long, p string, row long, `a.b` int"


def table_of(spark, rows):
    """rows: (doc_id, text, lang), with columns that clash with names of the operators."""
    return spark.createDataFrame([(i, t, lang, "s", "x", "y", 1, "z", 2, 3) for i, t, lang in rows], DOCS)


# --- 11 ---


def fails(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    capitals = len(re.findall("[A-Z]", t))
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * capitals > 10 * len(t), "D": bool(re.search("[#$%&*|]", t))}


def brute_audit(rows, labels):
    """Every order applied to the documents themselves, one filter after the other."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    told = [(lang or "", i, fails(t) | {"E": i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)}) for i, t, lang in rows]
    out, sums = {}, {}
    for part in {p for p, _, _ in told}:
        for order in itertools.permutations("ABCDE"):
            left, before = [x for x in told if x[0] == part], ""
            everyone = left
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if x[2][f]], [x for x in left if not x[2][f]]
                redundant = sum(x[2][f] and any(x[2][g] for g in before) for x in everyone)
                unique = sum(x[2][f] and not any(x[2][g] for g in "ABCDE" if g != f) for x in everyone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone)]
                sums[part, f] = sums.get((part, f), 0) + len(gone)
                before += f
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    got = audit.filter_audit(table_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, extra string"))
    assert got.schema.simpleString() == "struct<part:string,filter_order:string,step:int,kept:bigint,removed:bigint,redundant:bigint,unique_fails:bigint,good_lost:bigint,toxic_lost:bigint,shapley:bigint>"
    rows = [tuple(r) for r in got.collect()]
    assert len({r[:3] for r in rows}) == len(rows)
    return {r[:3]: r[3:] for r in rows}


def random_text(rng):
    kinds = rng.choice([3, 40, 10_000])
    words = [f"w{rng.randrange(kinds)}" for _ in range(rng.choice([0, 1, 99, 100, 150]))]
    text = rng.choice([" ", "\n", "\t \r"]).join(words)
    return rng.choice([text, text.upper(), text + rng.choice("#$%&*|"), f" {text} ", text + "É" * 40])


@pytest.mark.parametrize("seed", [1, 2])
def test_every_order_is_the_brute_one(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", *(random_text(rng) for _ in range(25))]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(120)]
    rows += rows[:10] + [(7, "one text", "en"), (7, "one text", "en"), (7, "one text", "de"), (9, "one text", None)]
    labels = [(rng.choice([None, *range(45)]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for _ in range(50)]
    assert audited(spark, rows, labels) == brute_audit(rows, [x[:3] for x in labels])


def test_audit_of_nothing_and_of_one_hot_text(spark):
    assert audited(spark, [], [(1, 1, 1, "x")]) == {}
    rows = [(i, "the same text", "en") for i in range(300)] + [(5, "Q" * 100_000, "en")]
    got = audited(spark, rows, [])
    assert got == brute_audit(rows, [])
    assert got["en", "EABCD", 1][1] == 299


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 6])
def test_the_walk_meets_every_order_once_by_single_swaps(k):
    met = audit.orders(k)
    assert sorted(met) == sorted(itertools.permutations(range(k)))
    for a, b in itertools.pairwise(met):
        (p, q) = [i for i in range(k) if a[i] != b[i]]
        assert q == p + 1 and (a[p], a[q]) == (b[q], b[p])


def test_a_swap_takes_only_two_steps_anew(spark):
    """Between neighbours of the walk, steps outside of the swapped two are the same, and what the two remove together is."""
    parts = spark.createDataFrame([("x", [(m, m % 7 + 1, m % 2, m % 3) for m in range(16)])], "part string, cells array<struct<mask:int,n:long,good:long,toxic:long>>")
    row = audit.walk(parts, 4).first()
    assert [tuple(s["f"] for s in v) for v in row["visits"]] == audit.orders(4)
    for (a, b), p in zip(itertools.pairwise(row["visits"]), audit.plain_changes(4), strict=True):
        assert all(a[i] == b[i] for i in range(4) if i not in (p, p + 1))
        assert a[p]["n"] + a[p + 1]["n"] == b[p]["n"] + b[p + 1]["n"]


def test_other_filters_and_too_many(spark):
    docs, labels = table_of(spark, [(1, "aa", "en"), (2, "ab", "en"), (3, "aa", "en")]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r["filter_order"], r["step"]): (r["removed"], r["shapley"]) for r in audit.filter_audit(docs, labels, lambda t: {"X": t.contains("b")}, "Y").collect()}
    assert got == {("XY", 1): (1, 2), ("XY", 2): (1, 2), ("YX", 1): (1, 2), ("YX", 2): (1, 2)}
    with pytest.raises(ValueError):
        audit.filter_audit(docs, labels, lambda t: {c: t.contains(c) for c in "abcdef"}, "Y")


# --- 12 ---


@pytest.fixture(scope="module")
def library():
    return {n: Tokenizer.from_file(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def messy(rng):
    pieces = [" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "a", "the", "The", "'s", "'", "''t", "don't", "12", "3,4", "é", "é", "Ω", "漢字", "한국", "😀", "՘", "꟎", "\U0003134a", "!?", "_", "…", "<|endoftext|>", "<|endof", "text|>", "\x00", "​", "½", "²", "ǅ", "ß"]
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_of_messy_texts(library, name):
    split = tokens.Splitter(tokens.read_spec(tokenizer_path(name)))
    rng = random.Random(3)
    for _ in range(3000):
        t = messy(rng)
        found, n = split.pre_tokens(t)
        assert n + sum(f * split.pieces(p) for p, f in found.items()) == len(library[name].encode(t, add_special_tokens=False).ids), repr(t)


def test_every_code_point_beside_a_lone_space(library):
    """The cut at a lone space is the library's own boundary, whichever version of Unicode it knows."""
    split, lib = tokens.Splitter(tokens.read_spec(tokenizer_path("byte_bpe_50k.json"))), library["byte_bpe_50k.json"]
    for c in [*range(0x3000), *range(0x3000, 0x110000, 7)]:
        if not 0xD800 <= c < 0xE000 and tokens.LONE_SPACE.search(text := f"a{chr(c)} {chr(c)}b"):
            assert sorted(split.pre_tokens(text)[0].elements()) == sorted(p for p, _ in lib.pre_tokenizer.pre_tokenize_str(text)), hex(c)


@pytest.mark.parametrize("head_rows", [1, 40, tokens.HEAD_ROWS])
def test_token_table(spark, library, head_rows):
    rng = random.Random(4)
    rows = [(None, "null id", "a"), (1, None, "a"), (2, "", "a"), (3, " \n", None), (4, "x" * 30_000, "b"), (5, "same text", "b"), (5, "same text", "b"), (6, "y " * 700 + "q" * 500, "c"), (7, "z" * 500 + " q", "c")]
    rows += [(i, messy(rng), "d") for i in range(10, 150)]
    got = tokens.token_counts(table_of(spark, rows).repartition(5), tokenizer_path(), head_rows)
    assert got.schema.simpleString() == "struct<doc_id:bigint,n_bytes:bigint,n_tokens:bigint>"
    want = [(i, len((t or "").encode()), len(library["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert tokens.token_counts(table_of(spark, []), tokenizer_path(), head_rows).count() == 0


def test_pieces_are_counted_once_for_each_pre_token(spark):
    sc = spark.sparkContext
    rows = [(i, "the cat and the dog", "en") for i in range(50)] + [(99, "the", "en")]
    known = tokens.vocabulary(table_of(spark, rows).repartition(7), sc.broadcast(tokens.read_spec(tokenizer_path())))
    assert {r["p"]: r["times"] for r in known.collect()} == {"the": 51, "Ġcat": 50, "Ġand": 50, "Ġthe": 50, "Ġdog": 50}


def test_limit(spark):
    got = tokens.token_digest(table_of(spark, [(1, " a" * 1024, "x"), (2, " a" * 1025, "x")]), tokenizer_path()).orderBy("doc_id")
    assert [tuple(r) for r in got.select("n_tokens", "over_limit").collect()] == [(1024, False), (1025, True)]


def test_added_tokens_that_reach_out_are_refused():
    spec = tokens.read_spec(tokenizer_path()).replace('"lstrip":false', '"lstrip":true').replace('"lstrip": false', '"lstrip": true')
    with pytest.raises(ValueError):
        tokens.Splitter(spec)


def test_no_text_travels(spark):
    """Nothing of the operators' plans shuffles a text."""
    docs = table_of(spark, [(1, "a b", "en")])
    for made in (audit.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")), tokens.token_counts(docs, tokenizer_path())):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan and not re.search(r"(Join|Aggregate) .*\btext#", plan)


def test_rare_pre_tokens_travel_once_for_many_documents():
    held = lambda x: SimpleNamespace(value=x)
    texts = pa.array(["a zyx zyx", "b zyx", None, "c d zyx"])
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, None, 9]), texts, pa.array([9, 5, 0, 7]), pa.array([0, 1, 2, 3])], names=["doc_id", "text", "n_bytes", "row"])
    out = [r for b in tokens._sums(held(tokens.read_spec(tokenizer_path())), held({"a": 1}))(iter([batch, batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["at"]) for r in out if r["p"] is None] == 2 * [(7, [0, 1]), (8, [1, 0]), (None, [2, 0]), (9, [3, 0])]
    rare = {r["p"]: sorted(zip(r["at"][::2], r["at"][1::2], strict=True)) for r in out if r["p"]}
    assert len([r for r in out if r["p"]]) == 4 and rare == {"Ġzyx": [(0, 2), (0, 2), (1, 1), (1, 1), (3, 1), (3, 1)], "b": 2 * [(1, 1)], "c": 2 * [(3, 1)], "Ġd": 2 * [(3, 1)]}
