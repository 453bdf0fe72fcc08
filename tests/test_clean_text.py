"""Cleaning reads a text's words only where a hyphen ends a line."""

import re
import time

from pyspark.sql import functions as F

from siftstone.functions import text as X


def plain(s):
    s = re.sub(r"([A-Za-z]+)-[ \t\n\v\f\r]*\n[ \t\n\v\f\r]*([a-z]+)", r"\1\2", s)
    return re.sub(r"[ \t\n\v\f\r]+", " ", re.sub(r"[ \t\n\v\f\r]*\n[ \t\n\v\f\r]*", " ", s)).strip(" \t\n\v\f\r")


def test_clean_text_as_by_its_rules(spark):
    texts = ["a-\nb-\nc", " x-  \r\n\t y \n\n z\t", "-\nb", "A-\nB", "\u00a0a \u00a0", "", "\n", "a - b", "ab-\f\ncd\v", "no hyphen\n here "]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").select(X.clean_text("t"), X.collapse("t")).collect()
    assert [r[0] for r in got] == [plain(t) for t in texts]
    assert [r[1] for r in got] == [re.sub(r"[ \t\n\v\f\r]+", " ", t).strip(" \t\n\v\f\r") for t in texts]


def test_a_word_without_end_takes_no_square_of_its_length(spark):
    word = spark.range(1).select(F.repeat(F.lit("a"), 150_000).alias("t"))
    began = time.perf_counter()
    assert word.select(F.length(X.clean_text("t"))).first()[0] == 150_000
    assert time.perf_counter() - began < 3
