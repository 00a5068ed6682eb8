"""Balanced candidate selection under quotas and caps.

The rule is sequential per dataset: categories in declared order, best candidates first,
skipping candidates whose paper or page is full or whose area is already taken. Only the
selection itself (at most the sum of the quotas per dataset) is state. Each round streams the
best eligible candidates per category in order past that state; candidates ruled out by the
current selection are filtered on the cluster first. Windows grow fourfold from round to round,
so the number of rounds grows with the logarithm of a dataset, and nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.suppression import Conflict
from scriptorium.session import cut_lineage

Same = Callable[[dict, dict], bool]

#: Up to so many datasets, their phases and picks (48 or so each) are sent to every task.
FEW = 1000
#: Windows grow from round to round up to this many candidates per dataset and category.
WIDEST = 1 << 20


def _area(b: dict) -> int:
    return b["width"] * b["height"]


def _common(a: dict, b: dict) -> int:
    w = min(a["x"] + a["width"], b["x"] + b["width"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"])
    return max(0, w) * max(0, h)


def overlap_rule(maximum_iou: float) -> Same:
    def same(a: dict, b: dict) -> bool:
        common = _common(a["region"], b["region"])
        union = _area(a["region"]) + _area(b["region"]) - common
        return bool(union) and common / union > maximum_iou

    return same


def evidence_rule(maximum_iou: float) -> Same:
    overlaps = overlap_rule(maximum_iou)

    def centre(b: dict) -> tuple[float, float]:
        return b["x"] + b["width"] / 2, b["y"] + b["height"] / 2

    def same(a: dict, b: dict) -> bool:
        if overlaps(a, b):
            return True
        if _common(a["region"], b["region"]) / min(_area(a["region"]), _area(b["region"])) > 0.84:
            return True
        (ax, ay), (bx, by) = centre(a["component"]), centre(b["component"])
        near = ((ax - bx) ** 2 + (ay - by) ** 2) ** 0.5 < 0.28 * min(a["region"]["width"], a["region"]["height"])
        return near and bool(set(a["signals"]) & set(b["signals"]))

    return same


def select_balanced(
    candidates: DataFrame,
    *,
    dataset: str,
    paper: str,
    page: str,
    quotas: Mapping[str, int],
    order: Sequence[str],
    conflict: Conflict,
    same: Same,
    per_paper: int,
    per_page: int | None = None,
    fill_to: int | None = None,
    window: int = 4096,
    attributes: Sequence[str] = ("region",),
) -> DataFrame:
    """Selected candidates with ``pick_no``, the position in selection order.

    ``quotas`` is ordered by declared category; ``fill_to`` adds a last pass over all
    categories until the target is reached. ``order`` lists ascending columns and must be
    unique per dataset. ``conflict`` and ``same`` are the same rule as column expression and
    as in-task check.
    """
    phases = [*quotas, *(["*"] if fill_to is not None else [])]
    pool = candidates.where(F.col("category").isin(*[c for c, q in quotas.items() if q > 0])) if fill_to is None else candidates
    state = cut_lineage(pool.select(dataset).distinct().select(dataset, F.lit(0).alias("phase")))
    small = F.broadcast if state.count() <= FEW else lambda df: df
    kind = _struct_type(pool, [c for c in pool.columns if c != dataset])
    row = f"`{dataset}` {pool.schema[dataset].dataType.simpleString()}, phase int, pick_no int, item {kind}"
    picks = pool.sparkSession.createDataFrame([], row).select(dataset, "pick_no", "item")
    rounds: list[DataFrame] = []
    while not state.isEmpty():
        offered = _offers(pool, state, picks if rounds else None, small, dataset, paper, page, phases, order, attributes, conflict, per_paper, per_page, window)
        held = picks.groupBy(dataset).agg(F.transform(F.array_sort(F.collect_list(F.struct("pick_no", "item"))), lambda p: p["item"]).alias("picked"))
        # A dataset's own row comes before its offers.
        heads = state.join(held, dataset, "left").select(dataset, F.lit(-1).alias("turn"), F.lit(0).alias("r"), "phase", "picked")
        rows = heads.unionByName(offered, allowMissingColumns=True)
        fold = _advance(phases, quotas, same, attributes, dataset, paper, page, per_paper, per_page, fill_to, window)
        stepped = cut_lineage(
            rows.repartition(dataset).sortWithinPartitions(dataset, "turn", "r")
            .mapInArrow(fold, row)
        )
        rounds.append(stepped.where("phase is null").select(dataset, "pick_no", "item"))
        state = stepped.where(F.col("phase") < len(phases)).select(dataset, "phase")
        picks = reduce(DataFrame.unionByName, rounds)
        window = max(window, min(4 * window, WIDEST))
    out = picks.select(dataset, "item.*", "pick_no")
    return out if fill_to is None else out.where(F.col("pick_no") <= fill_to)


def _struct_type(df: DataFrame, columns: Sequence[str]) -> str:
    return "struct<" + ",".join(f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in columns) + ">"


def _offers(
    pool: DataFrame, state: DataFrame, picks: DataFrame | None, small: Callable[[DataFrame], DataFrame], dataset: str, paper: str, page: str,
    phases: list[str], order: Sequence[str], attributes: Sequence[str], conflict: Conflict, per_paper: int, per_page: int | None, window: int,
) -> DataFrame:
    """Best eligible candidates of every phase not finished yet, ``window`` per phase."""
    eligible = pool.join(small(state), dataset)
    if picks is not None:
        on_paper = picks.groupBy(dataset, F.col(f"item.{paper}").alias(paper)).agg(F.count(F.lit(1)).alias("_n"))
        on_page = picks.groupBy(dataset, F.col(f"item.{paper}").alias(paper), F.col(f"item.{page}").alias(page)).agg(F.collect_list("item").alias("_here"))
        item = F.struct(*[c for c in pool.columns if c != dataset])

        def blocks(k):
            copy = k["category"].eqNullSafe(F.col("category"))
            for a in attributes:
                copy = copy & k[a].eqNullSafe(F.col(a))
            return copy | conflict(item, k)

        hit = F.exists("_here", blocks)
        if per_page is not None:
            hit = (F.size("_here") >= per_page) | hit
        eligible = (
            eligible.join(small(on_paper.where(F.col("_n") >= per_paper)), [dataset, paper], "left_anti")
            .join(small(on_page), [dataset, paper, page], "left")
            .where(F.col("_here").isNull() | ~hit)
            .drop("_here")
        )
    own = F.array_position(F.array(*[F.lit(p) for p in phases]), F.col("category")).cast("int") - 1
    mine = F.when((own >= 0) & (own >= F.col("phase")), own)
    if phases[-1] == "*":
        eligible = eligible.withColumn("turn", F.explode(F.array_compact(F.array(mine, F.lit(len(phases) - 1)))))
    else:
        eligible = eligible.withColumn("turn", mine).where(F.col("turn").isNotNull())
    return (
        eligible.withColumn("r", F.row_number().over(Window.partitionBy(dataset, "turn").orderBy(*order)))
        .where(F.col("r") <= window)
        .select(dataset, "turn", "r", F.struct(*[c for c in pool.columns if c != dataset]).alias("item"))
    )


def _advance(phases, quotas, same, attributes, dataset, paper, page, per_paper, per_page, fill_to, window):
    """Fold over the offers of a round in order; a dataset stops where its window may be incomplete."""

    def full(phase: int, picked: list[dict]) -> bool:
        name = phases[phase]
        if name == "*":
            return len(picked) >= fill_to
        return sum(k["category"] == name for k in picked) >= quotas[name]

    def copy(a: dict, b: dict) -> bool:
        return a["category"] == b["category"] and all(a[x] == b[x] for x in attributes)

    class Walk:
        """One dataset: its phase, its picks and how many offers of the phase went by."""

        def __init__(self, key, phase: int, picked: list[dict]) -> None:
            self.key, self.phase, self.picked, self.seen = key, phase, picked, 0
            self.full = full(phase, picked)

        def reach(self, turn: int) -> bool:
            """Closes the phases before ``turn``; false where one of them may have more candidates."""
            while self.phase < turn:
                if not self.full and self.seen >= window:
                    return False
                self.phase, self.seen = self.phase + 1, 0
                self.full = self.phase >= len(phases) or full(self.phase, self.picked)
            return True

        def room(self, alias, number) -> list[dict] | None:
            """Picks of the page, or none where paper or page is full."""
            mine = [k for k in self.picked if k[paper] == alias]
            here = [k for k in mine if k[page] == number]
            return None if len(mine) >= per_paper or (per_page is not None and len(here) >= per_page) else here

        def take(self, item: dict) -> None:
            self.picked.append(item)
            self.full = full(self.phase, self.picked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk: Walk | None = None
        names = [dataset, "phase", "pick_no", "item"]

        def told(keys, kind, items) -> pa.RecordBatch:
            phases_ = pa.array([w.phase for w in keys], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([w.key for w in keys], kind), phases_, pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), items)], names)

        keys_kind = items_kind = None
        for batch in batches:
            keys, items = batch.column(dataset), batch.column("item")
            keys_kind, items_kind = keys.type, items.type
            turns = batch.column("turn").to_pylist()
            aliases, numbers = pc.struct_field(items, paper).to_pylist(), pc.struct_field(items, page).to_pylist()
            closed: list[Walk] = []
            taken: list[tuple[int, int]] = []
            for i, turn in enumerate(turns):
                if turn < 0:
                    if walk is not None:
                        walk.reach(len(phases))
                        closed.append(walk)
                    walk = Walk(keys[i].as_py(), batch.column("phase")[i].as_py(), batch.column("picked")[i].as_py() or [])
                    continue
                if not walk.reach(turn) or walk.phase > turn:
                    continue
                walk.seen += 1
                here = None if walk.full else walk.room(aliases[i], numbers[i])
                if here is None:
                    continue
                item = items[i].as_py()
                if not any(copy(item, k) or same(item, k) for k in here):
                    walk.take(item)
                    taken.append((i, len(walk.picked)))
            if taken:
                at = pa.array([i for i, _ in taken], pa.int64())
                yield pa.RecordBatch.from_arrays([keys.take(at), pa.nulls(len(taken), pa.int32()), pa.array([n for _, n in taken], pa.int32()), items.take(at)], names)
            if closed:
                yield told(closed, keys_kind, items_kind)
        if walk is not None:
            walk.reach(len(phases))
            yield told([walk], keys_kind, items_kind)

    return run
