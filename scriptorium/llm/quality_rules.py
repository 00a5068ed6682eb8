"""Quality rules as a ledger of failure bits.

Every rule is evaluated once: ``ledger`` measures each whole text and stores the measurements
and one long with a bit for each failed rule. What is kept is decided later, from the bits
alone: a policy is a named, numbered set of rules, ``apply_policy`` tests its mask, and
``ablation`` tells from counts of bit patterns what each rule of a policy does and what leaving
it out would keep. A new policy never reads the texts again.

Texts are measured in numpy over groups of texts of bounded bytes; one very long text is a
group of its own. Repeated 8-word windows are found exactly, by ranking windows of 1, 2, 4 and
8 words. Nothing is shuffled but bit patterns, of which there are at most 2 to the number of
rules.

A null text counts as empty: no words, every measurement 0. Repeated rows and null ids give a
row each, an empty table none. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window whose repetition counts.
WINDOW = 8
#: Bytes of text measured together; bounds the memory of a group of short texts.
GROUP = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: A letter is A-Z, a-z or any code point beyond ASCII; each byte of the latter is 0x80 or more.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
BULLETS = ("•".encode(), b"-", b"*")
ELLIPSES = (b"...", "…".encode())

MEASURES = ("n_words", "word_chars", "n_symbols", "n_letter_words", "n_repeat_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails`` (SQL over the measurements) is true. Bits are never reused."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "short_words", "word_chars < 3 * n_words"),
    Rule(3, "long_words", "word_chars > 10 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(6, "no_letters", "100 * n_letter_words < 80 * n_words"),
    Rule(7, "bullets", "100 * n_bullet_lines > 90 * n_lines"),
    Rule(8, "ellipses", "100 * n_ellipsis_lines > 30 * n_lines"),
)


@dataclass(frozen=True)
class Policy:
    """A document is kept when it fails none of ``rules``."""

    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return sum(bits[name] for name in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_words"))
PROSE = Policy("prose", 1, tuple(r.name for r in RULES))


def repeated(ids: np.ndarray, doc: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Marks the words inside a window of ``n`` (a power of two) words found again in its document."""
    marks = np.zeros(len(ids) + 1, np.int64)
    if len(ids) < n:
        return marks[: len(ids)] > 0
    rank, width = ids, 1
    while width < n:
        pairs = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank, width = np.unique(pairs, return_inverse=True)[1], 2 * width
    at = np.flatnonzero(doc[: len(rank)] == doc[n - 1 :])
    _, which, times = np.unique(doc[at] * (int(rank.max()) + 1) + rank[at], return_inverse=True, return_counts=True)
    at = at[times[which] > 1]
    marks[at] += 1
    marks[at + n] -= 1
    return np.cumsum(marks)[: len(ids)] > 0


def lines(text: bytes) -> tuple[int, int, int, int]:
    """Lines with a word, those equal to an earlier one, with a bullet before, with an ellipsis after."""
    seen, n, dup, bullets, ellipses = set(), 0, 0, 0, 0
    for line in text.split(b"\n"):
        if bare := line.strip():
            n += 1
            dup += line in seen
            seen.add(line)
            bullets += bare.startswith(BULLETS)
            ellipses += bare.endswith(ELLIPSES)
    return n, dup, bullets, ellipses


def measured(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measurements of each text, as arrays."""
    joined = b" ".join(texts) + b" "
    buf = np.frombuffer(joined, np.uint8)
    start = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    solid = ~SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]

    def total(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, start, dtype=np.int64)

    out = {"n_words": total(first), "word_chars": total(solid & ((buf & 0xC0) != 0x80)), "n_symbols": total(SYMBOL[buf])}
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, joined.split()), np.int64)
    doc = np.repeat(np.arange(len(texts)), out["n_words"])
    at = np.flatnonzero(first)
    lettered = np.logical_or.reduceat(LETTER[buf], at) if len(at) else np.zeros(0, bool)
    for name, words in (("n_letter_words", lettered), ("n_repeat_words", repeated(ids, doc))):
        out[name] = np.bincount(doc[words], minlength=len(texts))
    out |= zip(("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines"), np.array([lines(t) for t in texts]).T, strict=True)
    return out


def groups(column: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for value in column:
        text = value.as_py() or b""
        if held and size + len(text) > GROUP:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for texts in groups(batch.column("text")):
            values = measured(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), *(pa.array(values[m], pa.int64()) for m in MEASURES)], ["doc_id", *MEASURES])
            at += len(texts)


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements (longs) of each whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(measure_batches, f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the measurements, and ``failures``: bit ``b`` is set where the rule of that bit fails."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("failures", bits)


def apply_policy(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, name: str = "kept") -> DataFrame:
    """Adds ``name``: no rule of the policy fails."""
    return entries.withColumn(name, F.col("failures").bitwiseAND(F.lit(policy.mask(rules))) == 0)


def ablation(entries: DataFrame, policies: tuple[Policy, ...], rules: tuple[Rule, ...] = RULES, by: tuple[str, ...] = ()) -> DataFrame:
    """For each policy and rule of it: documents, kept, failing the rule, failing only it, kept without it.

    ``by`` names columns of ``entries`` to report apart. Equal bit patterns are counted first,
    before the shuffle, so the rows that are compared with masks are few whatever the input.
    """
    patterns = entries.groupBy(*by, "failures").agg(F.count("*").alias("_docs"))
    masks = F.array(*(
        F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"), F.lit(p.mask(rules)).cast("long").alias("mask"), F.lit(1 << r.bit).cast("long").alias("bit"))
        for p in policies for r in rules if r.name in p.rules
    ))
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    share = patterns.select(*by, "failures", "_docs", F.inline(masks)).select(*by, "policy", "version", "rule", "_docs", hit.alias("_hit"), "bit")
    of = lambda mask, name: F.coalesce(F.sum(F.when(mask, F.col("_docs"))), F.lit(0)).alias(name)
    return share.groupBy(*by, "policy", "version", "rule").agg(
        F.sum("_docs").alias("n_docs"), of(F.col("_hit") == 0, "n_kept"), of(F.col("_hit").bitwiseAND(F.col("bit")) != 0, "n_failed"),
        of(F.col("_hit") == F.col("bit"), "n_failed_alone"), of((F.col("_hit") == 0) | (F.col("_hit") == F.col("bit")), "n_kept_without"),
    )


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, row_number() over () as r from documents),
u as (select r, w, unnest(range(1, greatest(len(w) - 6, 1))) as p from d),
g as (select r, list(p) as ps from (select r, p, array_to_string(w[p:p + 7], ' ') as win from u) group by r, win having count(*) > 1),
rep as (select r, count(distinct x) as n from (select r, unnest(range(p, p + 8)) as x from (select r, unnest(ps) as p from g)) group by r),
l as (select r, line, count(*) as n from (select r, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by all),
ln as (
  select r, sum(n) as n_lines, sum(n - 1) as n_dup,
    sum(case when regexp_matches(line, '^[\x20\x09-\x0D]*[•*-]') then n else 0 end) as n_bul,
    sum(case when regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$') then n else 0 end) as n_ell
  from l group by r
),
m as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) as n_let,
    cast(coalesce(n_dup, 0) as bigint) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(n_bul, 0) as n_bul, coalesce(n_ell, 0) as n_ell
  from d left join rep using (r) left join ln using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or word_chars < 3 * n_words or word_chars > 10 * n_words or 10 * n_symbols > n_words
    or 100 * n_dup_lines > 30 * n_lines or 100 * n_let < 80 * n_words or 100 * n_bul > 90 * n_lines or 100 * n_ell > 30 * n_lines) as kept
from m"""
