"""From recognised words to numbered sections: candidates, markers, regions, rollup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import boxes as B
from scriptorium.functions import ids
from scriptorium.functions import scoring as S
from scriptorium.functions import text as T
from scriptorium.operators.joins import match_results, possible_members
from scriptorium.operators.ranking import number_by_row
from scriptorium.operators.rules import page_sequence_ok
from scriptorium.operators.sequences import increasing_chain, with_sequence_confidence
from scriptorium.session import cut_lineage

PAGE = ["paper_id", "page_number"]
LINE = ["key_block", "key_paragraph", "key_line"]
EXPECTED = tuple(range(1, 17))
SERVICE_THRESHOLD = 0.60


def with_line_keys(words: DataFrame, zero_is_missing: bool = False) -> DataFrame:
    """Line hierarchy, falling back to the pixel row where it was not supplied.

    The sampling code treats 0 like a missing number, the marker code does not.
    """

    def level(name: str, fallback):
        value = F.col(name)
        if zero_is_missing:
            value = F.when(value != 0, value)
        return F.coalesce(value, fallback).cast("int")

    return (
        words.withColumn("key_block", level("block_number", F.col("y") + 1))
        .withColumn("key_paragraph", level("paragraph_number", F.lit(1)))
        .withColumn("key_line", level("line_number", F.col("y") + 1))
    )


def layout_text(words: DataFrame) -> DataFrame:
    """Page text: words by line, lines by newline, paragraphs by blank line."""
    keyed = with_line_keys(words)
    word = F.struct(F.coalesce("word_number", F.lit(2**31 - 1)).alias("n"), "x", "y", "text")
    lines = keyed.groupBy(*PAGE, *LINE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda w: w["text"]), " ").alias("line")
    )
    paragraphs = lines.groupBy(*PAGE, "key_block", "key_paragraph").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("key_line", "line"))), lambda v: v["line"]), "\n"
        ).alias("paragraph")
    )
    return paragraphs.groupBy(*PAGE).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("key_block", "key_paragraph", "paragraph"))),
                lambda v: v["paragraph"],
            ),
            "\n\n",
        ).alias("layout_text")
    )


def _one_edit_pattern(word: str) -> str:
    """Pattern for ``word`` with at most one letter changed, added or left out.

    A keyword passes the similarity rule exactly when it is that close. Other characters may
    stand between the letters; the pattern only has to let every real candidate through.
    """
    gap, letter = r"[^\p{L}]*", r"\p{L}"
    forms = []
    for i in range(len(word)):
        forms.append([*word[:i], letter, *word[i + 1:]])
        forms.append([*word[:i], *word[i + 1:]])
    forms.extend([*word[:i], letter, *word[i:]] for i in range(len(word) + 1))
    choices = "|".join(gap.join(f) for f in forms)
    return rf"(?iu)^{gap}(?:{choices})(?:[^\p{{L}}].*)?$"


def _keyword_like(text):
    """Cheap pattern first; the full rule runs on the few words that pass it."""
    compact = T.compact_split(text)
    keyword = F.coalesce(compact["keyword"], T.letters(text))
    return text.rlike(_one_edit_pattern(T.KEYWORD)) & (T.keyword_similarity(keyword) >= 0.75)


def heading_lines(words: DataFrame) -> DataFrame:
    """First five words and the length of every line that could hold a heading.

    A heading needs a keyword-like word, so only lines with such a word survive a semi-join
    on a small key set; a filter of its keys lets the bulk of the words not reach the shuffle by line.
    """
    keyed = with_line_keys(words)
    keys = [*PAGE, *LINE]
    promising = cut_lineage(keyed.where(_keyword_like(F.col("text"))).select(*keys).distinct())
    line = Window.partitionBy(*keys)
    order = [F.col("word_number").asc_nulls_last(), "x", "word_index"]
    numbered = (
        possible_members(keyed, promising, keys).join(promising, keys, "left_semi")
        .withColumn("pos", F.row_number().over(line.orderBy(*order)))
        .withColumn("line_length", F.count(F.lit(1)).over(line))
        .where(F.col("pos") <= 5)
    )
    word = F.struct("pos", "word_index", "text", "confidence", "x", "y", "width", "height")
    return numbered.groupBy(*keys).agg(
        F.array_sort(F.collect_list(word)).alias("head"), F.first("line_length").alias("line_length")
    )


def detect_markers(pages: DataFrame, words: DataFrame) -> DataFrame:
    """One candidate per line that starts with a plausible section heading."""
    head = F.col("head")
    lines = heading_lines(words).withColumn(
        "start",
        F.when(T.has_alnum(head[0]["text"]), 0).when(T.has_alnum(F.get(head, F.lit(1))["text"]), 1),
    ).where(F.col("start").isNotNull())
    first = F.get(head, F.col("start"))
    number_word = F.get(
        F.filter(
            head,
            lambda w: (w["pos"] > F.col("start") + 1)
            & (w["pos"] <= F.col("start") + 4)
            & T.has_alnum(w["text"]),
        ),
        F.lit(0),
    )
    parsed = (
        lines.withColumn("first", first)
        .withColumn("compact", T.compact_split(F.col("first.text")))
        .withColumn("is_compact", F.col("compact").isNotNull())
        .withColumn("second", F.when(~F.col("is_compact"), number_word))
        .where(F.col("is_compact") | F.col("second").isNotNull())
        .withColumn("keyword", F.coalesce("compact.keyword", T.letters(F.col("first.text"))))
        .withColumn(
            "number_text", F.when(F.col("is_compact"), F.col("compact.number")).otherwise(T.number_token(F.col("second.text")))
        )
        .withColumn("text_similarity", T.keyword_similarity(F.col("keyword")))
        .withColumn("test_number", T.parse_number(F.col("number_text")))
        .where((F.col("text_similarity") >= 0.75) & F.col("test_number").isNotNull())
    )
    marker_words = F.array_compact(F.array("first", "second"))
    sized = (
        parsed.withColumn("used", marker_words)
        .withColumn("ocr_values", F.filter(F.transform("used", lambda w: w["confidence"]), lambda c: c.isNotNull()))
        .withColumn(
            "ocr_confidence",
            F.when(
                F.size("ocr_values") > 0,
                F.aggregate("ocr_values", F.lit(0.0), lambda a, v: a + v) / F.size("ocr_values"),
            ),
        )
        .withColumn("numeric_confidence", T.number_confidence(F.col("number_text")))
        .withColumn(
            "box",
            B.from_edges(
                F.array_min(F.transform("used", lambda w: w["x"])),
                F.array_min(F.transform("used", lambda w: w["y"])),
                F.array_max(F.transform("used", lambda w: w["x"] + w["width"])),
                F.array_max(F.transform("used", lambda w: w["y"] + w["height"])),
            ),
        )
        .join(pages.select(*PAGE, F.col("width").alias("page_width"), F.col("height").alias("page_height")), PAGE)
    )
    geometry = S.marker_geometry(
        F.col("line_length"), F.col("box.x"), F.col("box.y"), F.col("page_width"), F.col("page_height")
    )
    candidates = (
        sized.withColumn("geometry_confidence", geometry)
        .withColumn(
            "confidence",
            S.marker_confidence(
                F.col("text_similarity"),
                F.col("numeric_confidence"),
                F.col("ocr_confidence"),
                F.col("geometry_confidence"),
                F.col("line_length") > F.col("start") + 4,
                F.col("first.y"),
                F.col("page_height"),
            ),
        )
        .select(
            *PAGE,
            "test_number",
            F.array_join(F.transform("used", lambda w: w["text"]), " ").alias("raw_text"),
            "box",
            F.col("box.y").alias("marker_y"),
            F.col("box.x").alias("marker_x"),
            "confidence",
            "text_similarity",
            "numeric_confidence",
            "ocr_confidence",
            "geometry_confidence",
            T.detection_strategy(F.col("keyword"), F.col("numeric_confidence"), F.col("is_compact")).alias("strategy"),
            F.transform("used", lambda w: w["word_index"]).alias("source_word_indices"),
        )
    )
    # A few rows per page that cost a scan of all words: stored once, then numbered.
    return number_by_row(
        cut_lineage(candidates),
        ["paper_id"],
        "page_number",
        [F.col("marker_y"), F.col("marker_x"), F.col("test_number"), F.col("source_word_indices")],
        "candidate_no",
    )


def select_markers(
    candidates: DataFrame, expected: Sequence[int] = EXPECTED, minimum_confidence: float = 0.62
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted markers, rejected candidates, duplicate numbers).

    The candidates are read three times; pass a stored table when they are costly to derive
    (``detect_markers`` stores its rows).
    """
    key = ["paper_id", "candidate_no"]
    chain = increasing_chain(candidates, expected, minimum_confidence)
    accepted = with_sequence_confidence(candidates.join(chain, key)).withColumn(
        "label", ids.test_label(F.col("test_number"))
    )
    rejected = candidates.join(chain, key, "left_anti")
    eligible = candidates.where(
        F.col("test_number").isin(*expected) & (F.col("confidence") >= minimum_confidence)
    )
    return accepted, rejected, duplicate_numbers(eligible)


def duplicate_numbers(candidates: DataFrame) -> DataFrame:
    return (
        candidates.groupBy("paper_id", "test_number")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def segment_regions(pages: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page regions, violations): each marker owns everything down to the next one.

    A region without height is a violation and takes its whole paper out of the result.
    """
    order = Window.partitionBy("paper_id").orderBy("candidate_no")
    counted = pages.groupBy("paper_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    spans = (
        markers.withColumn("next_page", F.lead("page_number").over(order))
        .withColumn("next_y", F.lead("marker_y").over(order))
        .join(counted, "paper_id")
        .withColumn("start_page", F.col("page_number"))
        .withColumn("end_page", F.coalesce("next_page", "page_count"))
        .select("paper_id", "test_number", "marker_y", "next_page", "next_y", "start_page", "end_page")
    )
    placed = (
        spans.withColumn("page_number", F.explode(F.sequence("start_page", "end_page")))
        .join(pages.select(*PAGE, "width", "height"), PAGE)
        .withColumn("top", F.when(F.col("page_number") == F.col("start_page"), F.col("marker_y")).otherwise(0))
        .withColumn(
            "bottom", F.when(F.col("page_number") == F.col("next_page"), F.col("next_y")).otherwise(F.col("height"))
        )
    )
    flat = placed.where(F.col("bottom") <= F.col("top")).select(
        *PAGE, "test_number", F.lit("region_without_height").alias("rule")
    )
    regions = placed.join(flat.select("paper_id").distinct(), "paper_id", "left_anti").select(
        *PAGE,
        "test_number",
        "start_page",
        "end_page",
        B.box(F.lit(0), F.col("top"), F.col("width"), F.col("bottom") - F.col("top")).alias("region"),
    )
    return regions, flat


def missing_numbers(papers: DataFrame, markers: DataFrame, expected: Sequence[int] = EXPECTED) -> DataFrame:
    wanted = papers.select("paper_id").distinct().withColumn(
        "test_number", F.explode(F.array(*[F.lit(int(n)) for n in expected]))
    )
    return wanted.join(markers.select("paper_id", "test_number"), ["paper_id", "test_number"], "left_anti")


def pages_with_results(pages: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages of papers in which every page and result match, the rows that do not match)."""
    mismatches = match_results(pages, results, PAGE, "source_path").where("status <> 'ok'")
    return pages.join(mismatches.select("paper_id").distinct(), "paper_id", "left_anti"), mismatches


def exam_structure(
    pages: DataFrame,
    words: DataFrame,
    expected: Sequence[int] = EXPECTED,
    minimum_confidence: float = SERVICE_THRESHOLD,
    results: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All structure tables of the papers whose pages run from 1 to n.

    With ``results`` (PAGE, source_path of every recognition result; ``pages`` has source_path too)
    papers are also left out when a page lacks a result, has one of another file, or a result
    has no page. ``rollup`` nests candidates, markers and regions under their pages.
    """
    checked = page_sequence_ok(pages, ["paper_id"], "page_number")
    usable = checked.where("pages_ok").select("paper_id")
    pages = pages.join(usable, "paper_id", "left_semi")
    pages, mismatches = pages_with_results(pages, results.join(usable, "paper_id", "left_semi")) if results is not None else (pages, None)
    candidates = detect_markers(pages, words)
    markers, rejected, duplicates = select_markers(candidates, expected, minimum_confidence)
    markers = cut_lineage(markers)
    regions, violations = segment_regions(pages, markers)
    return {
        "pages": pages,
        "candidates": candidates,
        "markers": markers,
        "rejected": rejected,
        "regions": regions,
        "violations": violations,
        "missing": missing_numbers(pages, markers, expected),
        "duplicates": duplicates.select("paper_id", "test_number")
        .union(duplicate_numbers(candidates).select("paper_id", "test_number"))
        .distinct(),
        "broken_papers": checked.where(~F.col("pages_ok")),
        "rollup": page_rollup(pages, candidates, markers, regions),
        **({"mismatches": mismatches} if mismatches is not None else {}),
    }


def page_rollup(pages: DataFrame, candidates: DataFrame, markers: DataFrame, regions: DataFrame) -> DataFrame:
    """Nested page rows; pages without children keep empty arrays."""

    def nested(df: DataFrame, name: str, *fields: str) -> DataFrame:
        return df.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    out = pages.select(*PAGE, "width", "height")
    for part in (
        nested(candidates, "candidates", "candidate_no", "test_number", "box", "confidence"),
        nested(markers, "markers", "candidate_no", "test_number", "box", "confidence"),
        nested(regions, "regions", "test_number", "region"),
    ):
        name = part.columns[-1]
        out = out.join(part, PAGE, "left").withColumn(name, F.coalesce(name, F.array()))
    return out
