"""Normalisation, edit distances and error rates against hand-worked and brute-force values."""

import random

from pyspark.sql import functions as F

from scriptorium.functions import text as T


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def rates(spark, fn, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    df = df.select("i", T.normalize_metric(F.col("a")).alias("a"), T.normalize_metric(F.col("b")).alias("b"))
    return [tuple(r.v) for r in df.select("i", fn(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]


def test_cer_golden(spark):
    got = rates(spark, T.cer, [("cat", "cat"), ("cat", "coat"), ("coat", "cat"), ("cat", "cut"), ("", ""), ("", "unexpected"), ("two words", "")])
    assert got == [(0, 3, 0.0), (1, 3, 1 / 3), (1, 4, 0.25), (1, 3, 1 / 3), (0, 0, 0.0), (10, 0, None), (9, 9, 1.0)]


def test_wer_golden(spark):
    got = rates(spark, T.wer, [("one two", "one new two"), ("one new two", "one two"), ("one two", "one too"), ("two words", ""), ("", "x")])
    assert got == [(1, 2, 0.5), (1, 3, 1 / 3), (1, 2, 0.5), (2, 2, 1.0), (1, 0, None)]


def test_metric_normalisation(spark):
    got = rates(spark, T.cer, [("Café", "Café"), ("One,\n  two", "One, two"), ("Case", "case"), ("a b\x1cc", "a b c")])
    assert [g[0] for g in got] == [0, 0, 1, 0]


def test_ocr_normalisation(spark):
    raw = "\n\nCafé \t\r\nline two  \rlast\t\n\n"
    row = spark.createDataFrame([(raw,)], "t string").select(T.normalize_ocr(F.col("t")).alias("t")).first()
    assert row.t == "Café\nline two\nlast"


def test_distances_equal_brute_force_on_random_and_long_text(spark):
    rng = random.Random(7)
    pairs = []
    for n in (0, 3, 40, 300, 900):
        for _ in range(6):
            a = "".join(rng.choice("abé ß") for _ in range(n))
            b = "".join(c for c in a if rng.random() > 0.1) + "x" * rng.randint(0, n // 3 + 1)
            pairs.append((a, b))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    rows = df.select("i", T.char_distance(F.col("a"), F.col("b")).alias("c"), T.word_distance(T.words_of(F.col("a")), T.words_of(F.col("b"))).alias("w")).orderBy("i").collect()
    for (a, b), r in zip(pairs, rows, strict=True):
        assert r.c == edits(a, b)
        assert r.w == edits(a.split(), b.split())


def test_bit_parallel_helper():
    rng = random.Random(3)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        assert T._bit_parallel(a, b) == edits(a, b)


def test_append_note(spark):
    rows = spark.createDataFrame([("", "n"), ("a\nn", "n"), ("a", "n")], "e string, n string")
    assert [r[0] for r in rows.select(T.append_note(F.col("e"), F.col("n"))).collect()] == ["n", "a\nn", "a\nn"]


def test_pairs_advanced_together():
    import numpy as np

    rng = random.Random(5)
    pairs = [("", ""), ("", "ab"), ("ab", ""), ("a" * 64, "a" * 65), ("b" * 128, "a")]
    for _ in range(120):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 150)))
        b = a.replace("ab", rng.choice(["", "c"])) if rng.random() < 0.7 else "".join(rng.choice("abce") for _ in range(rng.randrange(0, 150)))
        pairs.append((a, b))
    codes = [np.array([ord(c) - 97 for p in pairs for c in p[side]], np.int64) for side in (0, 1)]
    sizes = [np.array([len(p[side]) for p in pairs], np.int64) for side in (0, 1)]
    assert T._distances(codes[0], sizes[0], codes[1], sizes[1]).tolist() == [T._bit_parallel(*p) for p in pairs]


def test_rates_of_long_and_missing_texts(spark):
    rows = [(0, "ab " * 100, "ab  " * 50), (1, None, "x" * 99), (2, "x" * 99, None), (3, "", "y" * 99), (4, "zhe " * 40 + "\U0001f600", "the " * 40)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = {r.i: (r.c.errors, r.w.errors) for r in df.select("i", T.cer(F.col("a"), F.col("b")).alias("c"), T.wer(F.col("a"), F.col("b")).alias("w")).collect()}
    assert got == {0: (100, 50), 1: (None, None), 2: (None, None), 3: (99, 1), 4: (41, 41)}
