"""The pipeline against a brute-force version of its stages."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from siftstone.llm import mixing, quality

from .test_operators import brute_components, brute_fp, brute_hits, brute_sainte_lague, junk, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values):
    """xxhash64 of longs, ints (as ("int", n)) and strings, as Spark chains it; nulls are passed over."""
    h = 42
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else v[1].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return signed(h)


def brute_mix(rows):
    """rows: (doc_id, text, source): the words that the mix takes of each."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    key = [spark_hash(i, t, ("int", mixing.SEED)) for i, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(z for z, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, free = {}, list(sources)
    while True:
        level = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * total[s]]
        if not over:
            break
        target |= {s: 2.0 * total[s] for s in over}
        free = [s for s in free if s not in over]
    target |= {s: level * weight[s] for s in free}
    seats = brute_sainte_lague(target, int(sum(target.values()) / mixing.BLOCK + 0.5))
    taken = [0] * len(rows)
    for s in sources:
        cells = {}
        for k, r in enumerate(rows):
            if r[2] == s and size[k]:
                cells.setdefault(spark_hash(key[k]) % mixing.SHARDS, []).append(k)
        cells = dict(sorted(cells.items()))
        quota = brute_sainte_lague({c: float(sum(size[k] for k in ks)) for c, ks in cells.items()}, seats[s])
        for c, ks in cells.items():
            cell = sum(size[k] for k in ks)
            full, rest = divmod(min(quota[c] * mixing.BLOCK, 2 * cell), cell)
            for at in sorted({key[k] for k in ks}):
                same = [k for k in ks if key[k] == at]
                part = min(rest, sum(size[k] for k in same))
                for k in same:
                    taken[k] = full * size[k] + (part // len(same))
                rest -= part
    return size, total, target, taken


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    good = lambda: ". ".join(words(rng, 9, 3000).capitalize() for _ in range(8)) + "."
    rows = [(i, good() if i % 5 else junk(rng), rng.choice(["hot", "hot", "b", "c"])) for i in range(300)]
    items = [(i, good()) for i in range(4)]
    rows += [(1000 + i, rows[1][1], "d") for i in range(30)] + [(7, rows[7][1], rows[7][2])] + [(2000 + i, f"{good()} {items[i % 4][1]} {good()}", "b") for i in range(8)]
    rows += [(3000, None, "b"), (3001, "", None), (None, good(), None)]
    labels = [(i, int(i % 5 > 0), 0) for i in range(300)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, items


def test_mix_is_the_brute_one(spark, corpus):
    at, rows, _ = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    size, total, target, taken = brute_mix(rows)
    got = Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_digest(docs).collect())
    assert got == Counter((i, z, total[s], round(target[s], 6), t) for (i, _, s), z, t in zip(rows, size, taken, strict=True))


def test_pipeline_is_the_brute_one(spark, corpus):
    at, rows, items = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{at}/labels.parquet"))
    kept = [r for r in rows if model.score(np.array([quality.features(r[1])]))[0] >= quality.THRESHOLD]
    assert {i for i, _, _ in rows[:300]} - {i for i, _, _ in kept} == {i for i in range(0, 300, 5)}
    root = brute_components({(10**9 if i is None else i, k): brute_fp(t) for k, (i, t, _) in enumerate(kept)})
    kept = [kept[k] for _, k in sorted(set(root.values()))]
    kept = [r for r in kept if not brute_hits(r[1], items)[1]]
    size, _, _, taken = brute_mix(kept)
    chance = lambda r: spark_hash(spark_hash(r[0], r[1], ("int", mixing.SEED)), ("int", mixing.SEED)) % (1 << 20) / (1 << 20)
    want = [r for r, z, t in zip(kept, size, taken, strict=True) if z for _ in range(int(t / z + chance(r)))]
    from siftstone.llm.common import shared_dir

    seen = lambda: {f"{x.parent.name}/{x.name}" for x in Path(shared_dir(spark).removeprefix("file:")).glob("pipeline-*/*")}
    before = seen()
    got = corpus_pipeline.run(spark, at).toPandas()
    assert {x.rsplit("/")[-1] for x in seen() - before} == {"sharding"}  # the stages' rows are gone
    text = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    ids = ["" if i != i else str(int(i)) for i in got["doc_id"].astype(float)]
    assert Counter(zip(ids, got["size"], got["text_crc32"], strict=True)) == Counter(("" if i is None else str(i), *text(t)) for i, t, _ in want)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert (got.groupby("shard")["size"].sum() - got["size"].sum() / 8).abs().max() <= got["size"].max() * 2


def test_stages_keep_the_columns(spark, corpus):
    at, rows, _ = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns
        assert stage(spark, docs.limit(0), at).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), at).count() == 0
