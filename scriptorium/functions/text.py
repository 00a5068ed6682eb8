"""Text normalisation, edit distances, error rates and marker-token parsing."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

# Whitespace as understood by Python's str.split, including the
# information separators that the Unicode White_Space property leaves out.
WHITESPACE = r"[\s\x1c-\x1f]"
# Letters confused with digits, and keyword misreadings.
CONFUSED_DIGITS = ("oOlI", "0011")
KEYWORD = "test"
KNOWN_CONFUSIONS = ("lest", "tesl", "tost")
# First code point used for per-pair word codes; leaves 900,000 codes per pair.
_WORD_CODE_BASE = 0x20000


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition.

    Spark has no built-in for it. Text without code points from U+0300 upwards is
    already composed, so only the remaining rows are sent to Python (others go as NULL).
    """
    changed = _compose(F.when(text.rlike(r"[\x{300}-\x{10FFFF}]"), text))
    return F.coalesce(changed, text)


def normalize_ocr(text: Column, compose: bool = True) -> Column:
    """Stable newlines, no trailing blanks per line, no outer newlines."""
    text = nfc(text) if compose else text
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+(?=\n|\z)", "")
    return F.regexp_replace(text, r"\A\n+|\n+\z", "")


def normalize_metric(text: Column, compose: bool = True) -> Column:
    """Collapse whitespace runs; case and punctuation still count."""
    text = nfc(text) if compose else text
    collapsed = F.regexp_replace(text, "(?U)" + WHITESPACE + "+", " ")
    return F.trim(collapsed)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


# Bounds tried before the full distance; a banded run costs bound x length cells only.
_BANDS = (24, 256)
_SHORT = 64
# Pairs with more cells (length x length) than this go to the bit-parallel form; others stay in the JVM.
_JVM_CELLS = 1_024
# Sides of more 64-bit words than this, or fewer pairs, are one big integer each; others advance together.
_BIG = 16
_FEW = 16
# Words of a set of pairs, and of its table of matching positions, that advance together.
_SET, _TABLE = 8_192, 1 << 22


def _bit_parallel(left: Sequence, right: Sequence) -> int:
    """Edit distance with one big-integer column step per character of ``right``."""
    if not left or not right:
        return len(left) + len(right)
    width = len(left)
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict = {}
    for i, c in enumerate(left):
        where[c] = where.get(c, 0) | (1 << i)
    plus, minus, distance = full, 0, width
    for c in right:
        same = where.get(c, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        distance += 1 if up & top else -1 if down & top else 0
        up, down = ((up << 1) | 1) & full, (down << 1) & full
        vertical = same | minus
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return distance


def _advance(pattern: np.ndarray, lengths: np.ndarray, text: np.ndarray, steps: np.ndarray, symbols: int) -> np.ndarray:
    """Edit distances of a set of pairs, the longest text first.

    ``pattern``: pairs x 64 b, right-aligned; ``text``: columns x pairs; both padded with ``symbols``. The
    form of ``_bit_parallel`` with a pattern cut into b words. Word k is one column behind word k - 1,
    whose carry it takes over, so that all words of all pairs advance in one operation. Rows before
    a pattern match nothing and start without difference, so they hold the first row's values.
    """
    pairs, width = pattern.shape
    words, one, high = width // 64, np.uint64(1), np.uint64(63)
    where = np.zeros((symbols + 1, words, pairs), np.uint64)
    k, i = np.arange(words)[:, None], np.arange(pairs)
    for bit in range(64):
        where[pattern[:, bit::64].T, k, i] |= one << np.uint64(bit)
    where[symbols] = 0
    where = where.reshape(-1)
    real = np.arange(width) >= width - lengths[:, None]
    plus = np.ascontiguousarray(np.packbits(real, axis=1, bitorder="little").view("<u8").T)
    minus, up_out, down_out = np.zeros_like(plus), np.zeros_like(plus), np.zeros_like(plus)
    # Where word k finds the symbol of its column: the text's row, then its own place.
    text = np.vstack([text * (words * pairs), np.full((words, pairs), symbols * words * pairs, text.dtype)])
    own = k * pairs + i
    distance = lengths.astype(np.int64)
    columns = len(text) - words
    open_at = np.searchsorted(-steps, -np.arange(columns), "left")
    for step in range(columns + words - 1):
        begun, m = min(words, step + 1), int(open_at[max(0, step - words + 1)])
        rows = text[step - begun + 1: step + 1, :m][::-1]
        same = where.take(rows + own[:begun, :m])
        p, q = plus[:begun, :m], minus[:begun, :m]
        up_in, down_in = np.empty_like(p), np.empty_like(p)
        up_in[0], down_in[0] = one, 0
        up_in[1:], down_in[1:] = up_out[: begun - 1, :m], down_out[: begun - 1, :m]
        side = same | q
        same |= down_in
        diagonal = same & p
        diagonal += p
        diagonal ^= p
        diagonal |= same
        down = p & diagonal
        diagonal |= p
        up = np.invert(diagonal, out=diagonal)
        up |= q
        np.right_shift(up, high, out=up_out[:begun, :m])
        np.right_shift(down, high, out=down_out[:begun, :m])
        if begun == words:
            distance[:m] += up_out[-1, :m].astype(np.int64) - down_out[-1, :m].astype(np.int64)
        up <<= one
        up |= up_in
        down <<= one
        down |= down_in
        np.bitwise_and(up, side, out=q)
        side |= up
        np.invert(side, out=side)
        np.bitwise_or(down, side, out=p)
    return distance


def _distances(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of sequences of symbols (0, 1, ...) laid end to end, with their lengths ``a`` and ``b``."""
    out = np.where(a == 0, b, a).astype(np.int64)
    from_a, from_b = np.cumsum(a) - a, np.cumsum(b) - b
    words = (a + 63) // 64
    todo = np.flatnonzero((a > 0) & (b > 0))
    todo = todo[np.lexsort((b[todo], words[todo]))]
    symbols = int(max(left.max(initial=0), right.max(initial=0))) + 1
    while len(todo):
        fits = np.maximum.accumulate(words[todo]) <= max(1, min(_SET, _TABLE // (symbols + 1))) // np.arange(1, len(todo) + 1)
        near = words[todo] <= words[todo[0]] * 5 // 4
        rows = todo[: max(1, int(np.argmin(np.append(fits & near, False))))]
        todo = todo[len(rows):]
        n = int(words[rows].max())
        if n > _BIG or len(rows) < _FEW:
            for r in rows:
                out[r] = _bit_parallel(left[from_a[r]: from_a[r] + a[r]].tolist(), right[from_b[r]: from_b[r] + b[r]].tolist())
            continue
        rows = rows[np.argsort(-b[rows], kind="stable")]

        def laid(flat: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, before: np.ndarray) -> np.ndarray:
            place = np.arange(width) - before[:, None]
            inside = (place >= 0) & (place < size[:, None])
            return np.where(inside, flat[np.where(inside, start[:, None] + place, 0)], symbols)

        pattern = laid(left, from_a[rows], a[rows], n * 64, n * 64 - a[rows])
        text = laid(right, from_b[rows], b[rows], int(b[rows[0]]), np.zeros_like(rows))
        out[rows] = _advance(pattern, a[rows], text.T, b[rows], symbols)
    return out


def _known(left: pd.Series, right: pd.Series, measured) -> pd.Series:
    """``measured`` over the pairs without NULL."""
    known = (left.notna() & right.notna()).to_numpy()
    out = pd.Series(pd.NA, index=range(len(left)), dtype="Int32")
    if known.any():
        out[known] = measured(left[known].tolist(), right[known].tolist())
    return out


@F.pandas_udf(IntegerType())
def _long_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    def measured(a: list[str], b: list[str]) -> np.ndarray:
        flat = [np.frombuffer("".join(side).encode("utf-32-le"), np.int32) for side in (a, b)]
        used = np.zeros(0x110000, np.int32)
        for side in flat:
            used[side] = 1
        symbol = np.cumsum(used) - 1
        sizes = [np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b)]
        return _distances(symbol[flat[0]], sizes[0], symbol[flat[1]], sizes[1])

    return _known(left, right, measured)


@F.pandas_udf(IntegerType())
def _long_word_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    def measured(a: list[str], b: list[str]) -> np.ndarray:
        flat, sizes = ([], []), ([], [])
        for pair in zip(a, b, strict=True):
            symbol: dict[str, int] = {}
            for side, size, text in zip(flat, sizes, pair, strict=True):
                words = [w for w in text.split(" ") if w]
                side.extend([symbol.setdefault(w, len(symbol)) for w in words])
                size.append(len(words))
        return _distances(*[np.array(x, np.int64) for x in (flat[0], sizes[0], flat[1], sizes[1])])

    return _known(left, right, measured)


def _banded(left: Column, right: Column) -> Column:
    """JVM distance. The bounded form returns -1 beyond its bound, so growing bounds are exact."""

    def attempt(bands: tuple[int, ...]) -> Column:
        if not bands:
            return F.levenshtein(left, right)
        return let(F.levenshtein(left, right, bands[0]), lambda d: F.when(d >= 0, d).otherwise(attempt(bands[1:])))

    short = F.greatest(F.length(left), F.length(right)) <= _SHORT
    return F.when(short, F.levenshtein(left, right)).otherwise(attempt(_BANDS))


def char_distance(left: Column, right: Column) -> Column:
    """Unit-cost edit distance over code points, exact for texts of any length.

    Short lines stay in the JVM. Longer pairs, where its quadratic table takes most of a task, are
    the only rows sent to the bit-parallel helper (others go as NULL).
    """
    long = F.length(left).cast("long") * F.length(right) > _JVM_CELLS
    far = _long_distance(F.when(long, left), F.when(long, right))
    return F.coalesce(far, F.when(~long, F.levenshtein(left, right)))


def word_distance(left: Column, right: Column) -> Column:
    """Edit distance between word arrays.

    Each distinct word of the pair becomes one code point, which turns the problem into
    the JVM's character distance without any Python.
    """

    def coded(words: Column, vocabulary: Column) -> Column:
        digits = F.transform(
            words,
            lambda w: F.lpad(F.hex(F.array_position(vocabulary, w) + F.lit(_WORD_CODE_BASE)), 8, "0"),
        )
        return F.decode(F.unhex(F.array_join(digits, "")), "UTF-32")

    def distance(pair: Column) -> Column:
        texts = let(
            F.array_distinct(F.concat(pair["l"], pair["r"])),
            lambda v: F.struct(coded(pair["l"], v).alias("l"), coded(pair["r"], v).alias("r")),
        )
        return let(texts, lambda t: _banded(t["l"], t["r"]))

    return let(F.struct(left.alias("l"), right.alias("r")), distance)


def error_rate(errors: Column, units: Column) -> Column:
    """Rate may exceed 1; an empty reference is 0 when nothing was read, else NULL."""
    return F.when(units > 0, errors.cast("double") / units).when(errors == 0, F.lit(0.0))


def error_struct(errors: Column, units: Column) -> Column:
    return let(
        F.struct(errors.cast("int").alias("errors"), units.cast("int").alias("reference_units")),
        lambda v: F.struct(
            v["errors"].alias("errors"),
            v["reference_units"].alias("reference_units"),
            error_rate(v["errors"], v["reference_units"]).alias("rate"),
        ),
    )


def cer(reference: Column, prediction: Column) -> Column:
    """Character error rate of texts already passed through ``normalize_metric``."""
    return error_struct(char_distance(reference, prediction), F.length(reference))


def wer(reference: Column, prediction: Column) -> Column:
    """Word error rate of texts already passed through ``normalize_metric``."""
    long = F.length(reference).cast("long") * F.length(prediction) > _JVM_CELLS
    far = _long_word_distance(F.when(long, reference), F.when(long, prediction))
    near = word_distance(words_of(reference), words_of(prediction))
    return error_struct(F.coalesce(far, F.when(~long, near)), F.size(words_of(reference)))


def alnum(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def has_alnum(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}]", "")


def number_token(text: Column) -> Column:
    cleaned = alnum(text)
    return F.when(F.length(cleaned).between(1, 2), cleaned)


def compact_split(text: Column) -> Column:
    """Struct(keyword, number) for a fused token such as "Test03", else NULL."""
    cleaned = alnum(text)
    keyword = F.regexp_extract(cleaned, r"^(\p{L}+)([^\p{L}].*)$", 1)
    number = F.regexp_extract(cleaned, r"^(\p{L}+)([^\p{L}].*)$", 2)
    return F.when(keyword != "", F.struct(F.lower(keyword).alias("keyword"), number.alias("number")))


def keyword_similarity(text: Column) -> Column:
    longest = F.greatest(F.length(text), F.lit(len(KEYWORD)))
    similarity = F.greatest(F.lit(0.0), 1.0 - F.levenshtein(text, F.lit(KEYWORD)) / longest)
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(similarity)


def parse_number(text: Column) -> Column:
    """Test number 1..99 after undoing letter/digit confusions, else NULL."""
    digits = F.translate(text, *CONFUSED_DIGITS)
    value = F.when(digits.rlike("^[0-9]{1,2}$"), digits.try_cast("int"))
    return F.when(value.between(1, 99), value)


def number_confidence(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), F.lit(1.0)).otherwise(F.lit(0.8))


def detection_strategy(keyword: Column, numeric_confidence: Column, compact: Column) -> Column:
    return (
        F.when(keyword.isin(*KNOWN_CONFUSIONS), F.lit("ocr_confusion"))
        .when(keyword != KEYWORD, F.lit("fuzzy_keyword"))
        .when(numeric_confidence < 1.0, F.lit("ocr_confusion"))
        .when(compact, F.lit("compact_token"))
        .otherwise(F.lit("exact_tokens"))
    )


def append_note(existing: Column, note: Column) -> Column:
    """Add a note line once; a missing text becomes the note, a missing note changes nothing."""
    return (
        F.when(note.isNull() | F.array_contains(F.split(existing, "\n"), note), existing)
        .when(existing.isNull() | (F.length(existing) == 0), note)
        .otherwise(F.concat(existing, F.lit("\n"), note))
    )
