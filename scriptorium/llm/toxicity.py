"""Toxicity by a counterfactually regularised classifier.

Features are the words of a text, and the beginnings of its longer words, that the labelled
rows tie to a class: they are counted over all training rows, and the ``features`` with the highest z-value enter, always with the identity
terms. A text is the set of its features. For each
training text with identity terms two counterparts are made, before features are taken: one in
which each term is swapped for another of its language and one without the terms. A logistic
regression is fitted with a penalty on the squared differences from the counterparts' scores;
the terms have no beginnings, so that naming a group changes a score little by itself.

The fit takes at most ``rows`` labelled rows (those with the smallest hash of doc_id) and as
many weights as features; both bounds are parameters. Counting and scoring cover all rows.

Null and empty texts have no feature and take the score of the intercept. Repeated rows each
give their row; of contradicting labels the larger counts. Without training labels of both
classes the score is 0.5. Only doc_id and text are read; doc_id only splits and joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import bind, stored

FEATURES = 2048
ROWS = 50_000
PENALTY = 1.0
RIDGE = 0.1
LEAST_Z = 3.0
STARTS = (4, 5, 6)
WORD = r"[\p{L}']+"

#: Words that name groups, by language; swaps stay within a row.
IDENTITY = [
    "women men girls boys mothers fathers muslims christians jews hindus atheists black white asian latino gay straight lesbian transgender immigrants refugees disabled elderly".split(),
    "frauen männer muslime christen juden migranten flüchtlinge behinderte schwule lesben".split(),
    "femmes hommes musulmans chrétiens juifs immigrés réfugiés handicapés homosexuels".split(),
    "mujeres hombres musulmanes cristianos judíos inmigrantes refugiados discapacitados homosexuales".split(),
]
#: Singular and inflected forms, by language and kind.
IDENTITY += [
    "woman man girl boy mother father muslim christian jew hindu atheist immigrant refugee".split(),
    "blacks whites asians latinos gays lesbians".split(),
    "frau mann muslima christ jude migrant flüchtling behinderter schwuler lesbe".split(),
    "männern muslimen behinderten schwulen".split(),
    "femme homme musulman chrétien juif immigré réfugié handicapé homosexuel".split(),
    "musulmane chrétienne juive immigrée réfugiée handicapée homosexuelle".split(),
    "mujer hombre musulmán cristiano judío inmigrante refugiado discapacitado homosexual".split(),
    "musulmana cristiana judía refugiada discapacitada".split(),
]
SWAP = {t: row[(i + 1) % len(row)] for row in IDENTITY for i, t in enumerate(row)}


def swapped(w: Column) -> Column:
    """Words with each identity term replaced by the next of its row."""
    other = F.create_map(*[F.lit(x) for pair in SWAP.items() for x in pair])
    return F.transform(w, lambda x: F.coalesce(F.element_at(other, x), x))


def without(w: Column) -> Column:
    """Words without identity terms."""
    return F.filter(w, lambda x: ~x.isin(list(SWAP)))


def bag(text: Column, change: Callable[[Column], Column] = lambda w: w) -> Column:
    """Distinct words, and distinct beginnings (marked by a star) of words longer than those; identity terms have none.

    ``change`` is applied to the words before beginnings are taken.
    """
    def beginnings(w, n):
        return F.transform(F.filter(w, lambda x: F.char_length(x) > n), lambda x: F.concat(F.substring(x, 1, n), F.lit("*")))

    def make(w):
        return bind(without(w), lambda other: F.array_distinct(F.concat(w, *[beginnings(other, n) for n in STARTS])))

    return bind(F.array_distinct(change(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0))), make)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def choose(train: DataFrame, features: int = FEATURES) -> list[str]:
    """Words with the highest z-value of their share in either class; at most ``features``."""
    size = train.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    if not size["n"] or not size["bad"] or size["bad"] == size["n"]:
        return []
    rate = size["bad"] / size["n"]
    seen = train.select("toxic", F.explode(bag(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    z = (F.col("bad") - rate * F.col("n")) / F.sqrt(F.col("n") * rate * (1 - rate) + 1e-9)
    top = seen.filter("n >= 3").select("word", z.alias("z")).filter(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "word").limit(features)
    return [r["word"] for r in top.collect()]


class Rows:
    """A sparse matrix: for each entry its row, its column and its value. Only what is not 0 is held."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int):
        self.row, self.column, self.value, self.n = row.astype(np.int32), column.astype(np.int32), value, n

    @classmethod
    def of(cls, x: "Rows | np.ndarray") -> "Rows":
        if isinstance(x, Rows):
            return x
        row, column = np.nonzero(x)
        return cls(row, column, x[row, column], len(x))

    def times(self, w: np.ndarray) -> np.ndarray:
        """Scores; the last weight is the intercept."""
        return np.bincount(self.row, self.value * w[self.column], self.n) + w[-1]

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        out = np.bincount(self.column, self.value * r[self.row], size)
        out[-1] += r.sum()
        return out

    def only(self, at: np.ndarray) -> "Rows":
        place = np.full(self.n, -1)
        place[at] = np.arange(len(at))
        kept = place[self.row] >= 0
        return Rows(place[self.row[kept]], self.column[kept], self.value[kept], len(at))


def fit(x: Rows | np.ndarray, twin, y: np.ndarray, penalty: float = PENALTY, ridge: float = RIDGE, steps: int = 400, *more, features: int | None = None) -> np.ndarray:
    """Weights (last: intercept) of least log loss + ridge + penalty * squared score changes to ``twin`` and ``more``.

    Twins are matrices of all rows, or pairs of row numbers and the matrix of those; rows left out are equal.
    """
    size = 1 + (features if features is not None else x.shape[1])
    x, n = Rows.of(x), len(y)
    twins = []
    for at, t in (t if isinstance(t, tuple) else (np.arange(n), t) for t in (twin, *more)):
        twins.append((at, Rows.of(t), x.only(at)))
    w = np.zeros(size)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        grad = x.back(p - y, size)
        for at, t, own in twins:
            o, q = p[at], 1 / (1 + np.exp(-np.clip(t.times(w), -30, 30)))
            grad += 2 * penalty * (own.back((o - q) * o * (1 - o), size) - t.back((o - q) * q * (1 - q), size))
        grad[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def matrix(bags: Iterator[list[str]], index: dict[str, int]) -> Rows:
    """A row per bag, with ones at its words."""
    rows, columns, n = [], [], 0
    for words in bags:
        own = np.fromiter({index[w] for w in words if w in index}, np.int32)
        rows.append(np.full(len(own), n, np.int32))
        columns.append(own)
        n += 1
    row = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return Rows(row, np.concatenate(columns) if rows else row, np.ones(len(row)), n)


def learn(docs: DataFrame, labels: DataFrame, features: int = FEATURES, rows: int = ROWS, penalty: float = PENALTY) -> tuple[dict[str, int], np.ndarray]:
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    train = stored(docs.select("doc_id", "text").join(known, "doc_id"))
    words = choose(train, features)
    if not words:
        return {}, np.zeros(1)
    index = {w: i for i, w in enumerate(dict.fromkeys([*words, *SWAP]))}
    own, *changed = (F.filter(bag(F.col("text"), change), lambda w: w.isin(list(index))) for change in (lambda w: w, swapped, without))
    # the sample is one partition after the limit; bags are made by all cores
    sample = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).repartition(2 * train.sparkSession.sparkContext.defaultParallelism)
    kept = sample.select("toxic", own.alias("own"), *[F.when(own != b, b).alias(f"twin{i}") for i, b in enumerate(changed)]).toArrow()

    def bags(name):
        """The bags of a column, one after the other; only their sparse rows are kept."""
        return (value.as_py() for value in kept[name] if value.is_valid)

    twins = [(np.flatnonzero(kept[f"twin{i}"].is_valid().to_numpy()), matrix(bags(f"twin{i}"), index)) for i in range(len(changed))]
    y = kept["toxic"].to_numpy().astype(float)
    return index, fit(matrix(bags("own"), index), twins[0], y, penalty, RIDGE, 400, *twins[1:], features=len(index))


def score(docs: DataFrame, model: tuple[dict[str, int], np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row."""
    index, weights = model
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            z = np.array([sum(weights[index[w]] for w in b if w in index) for b in f["bag"]], float) + weights[-1]
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    kept = F.filter(bag(F.col("text")), lambda w: w.isin(list(index))) if index else F.array().cast("array<string>")
    return docs.select("doc_id", kept.alias("bag")).mapInPandas(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
