"""Case folding over all code points."""

from siftstone.functions import text as X


def test_case_is_folded_as_python_does(spark):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(k, "".join(points[k : k + 64])) for k in range(0, len(points), 64)]
    rows += [(-1, "Straße STRASSE ſo ΌΔΟΣ όδος İi ﬁ ŉ"), (-2, ""), (-3, None), (-4, "Plain ASCII Text")]
    got = {r.i: r.f for r in spark.createDataFrame(rows, "i long, t string").repartition(8).select("i", X.casefold("t").alias("f")).collect()}
    assert got == {i: t if t is None else t.casefold() for i, t in rows}
