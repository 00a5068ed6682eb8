"""Quality rules, whitening and conversation repair against brute force, with nulls, copies, ties and clashing columns."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import conversations as C
from scriptorium.llm import quality_rules as R
from scriptorium.llm import queries
from scriptorium.llm import whitening as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- rules ---------------------------------------------------------------------------------


def rule_texts():
    rng = random.Random(3)
    some = ["a", "bb", "Ccc", "é", "12", "#", "x\x1cy"]
    loop = "one two three four five six seven eight "
    return [
        None, "", " \n\t", "word", loop * 4, loop * 2 + "tail", "x " + loop + "y " + loop + "z", "\n".join(["same line here", "other", "same line here", "", "  ", "same line here "]),
        "- a\n* b\n• c\n", "so...\nand…\nend", "🙂" * 30, *(" ".join(rng.choice(some) for _ in range(rng.randint(1, 60))) for _ in range(40)), " ".join(rng.choice("ab") for _ in range(30000)), loop * 3000,
        "a a a a a a a a", "a a a a a a a a a", "a\x0b\x0cb\rc\x1fd e f",
    ]


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    at = defaultdict(list)
    for p in range(len(words) - 7):
        at[tuple(words[p : p + 8])].append(p)
    rep = {p + k for ps in at.values() if len(ps) > 1 for p in ps for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(words) < 20 or 100 * len(rep) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), base


def test_rule_measures(spark):
    texts = rule_texts()
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in [*enumerate(texts), (None, "null id"), (3, "word")]], "doc_id long, text string, failures int, n_words int").repartition(3)
    out = R.apply_policy(R.apply_policy(R.ledger(rows), R.BASE, name="base"), R.PROSE).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, not r.base) for r in out)
    assert got == Counter((i, *by_hand(t)) for i, t in [*enumerate(texts), (None, "null id"), (3, "word")])
    assert all(r.base or not r.kept for r in out)
    assert R.ledger(rows.limit(0)).count() == 0


def test_groups_of_texts_do_not_matter(monkeypatch):
    import pyarrow as pa

    texts = [(t or "").encode() for t in rule_texts()]
    monkeypatch.setattr(R, "GROUP", 50)
    parts = [R.measured(g) for g in R.groups(pa.array(texts, pa.binary()))]
    whole = R.measured(texts)
    assert len(parts) > 10
    for m in R.MEASURES:
        assert np.concatenate([p[m] for p in parts]).tolist() == whole[m].tolist()


def test_ablation(spark):
    entries = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", 2), ("b", 4), ("b", 1), ("b", 1)], "source string, failures long")
    rules = (R.Rule(0, "x", ""), R.Rule(1, "y", ""), R.Rule(2, "z", ""))
    policies = (R.Policy("xy", 1, ("x", "y")), R.Policy("z", 2, ("z",)))
    got = {(r.policy, r.version, r.rule): tuple(r[3:]) for r in R.ablation(entries, policies, rules).collect()}
    assert got == {("xy", 1, "x"): (7, 2, 4, 3, 5), ("xy", 1, "y"): (7, 2, 2, 1, 3), ("z", 2, "z"): (7, 6, 1, 1, 7)}
    assert R.ablation(entries, policies, rules, by=("source",)).count() == 6


def test_rules_on_labels(spark):
    d = "/root/testdata/sf0.01"
    out = R.apply_policy(R.ledger(spark.read.parquet(f"{d}/documents.parquet")), R.PROSE).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in out.filter("n_words >= 20").groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 0.1 * sum(v for (q, _), v in n.items() if q == 0)
    assert n.get((1, False), 0) <= 0.02 * sum(v for (q, _), v in n.items() if q == 1)


# --- whitening -----------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "d", "span"), [(1, 1, 1), (65, 3, 1), (300, 5, 900), (130, 2, 2**40), (70, 2, 2**62)])
def test_scatter_is_exact(n, d, span):
    rng = np.random.default_rng(n)
    x = rng.integers(-span, span, (n, d))
    sums, cross = W.scatter(x)
    big = x.astype(object)
    assert sums == list(big.sum(axis=0)) and cross == (big.T @ big).tolist()


def vectors():
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(6, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=6) @ mix + 5]) for i in range(150)]
    rows += [(7, rows[7][1]), (200, rows[3][1]), (None, rows[4][1]), (201, None), (202, [None] * 6), (203, [float("nan")] + [0.0] * 5), (204, [float("-inf")] + [0.0] * 5), (205, []), (206, [1.0]), (207, [-0.0] * 6)]
    return rows


def test_whitening(spark):
    rows = vectors()
    table = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, x int, z int, n int").repartition(5)
    out = W.whiten(table, top=4).collect()
    used = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)]
    fitted = sorted({tuple(x) for _, x in used})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted)]
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums)] for x in fitted])
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1], parts[:, ::-1]
    assert len(out) == 4 * len(used)
    got = defaultdict(list)
    for r in out:
        got[r.component].append(r)
    for k in range(4):
        signs = []
        expected = defaultdict(list)
        for i, x in used:
            off = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums)])
            expected[i].append((sum((n * c - s) ** 2 for c, s in zip(x, sums)), off @ parts[:, k] / np.sqrt(values[k])))
        for r in got[k + 1]:
            assert r.n == n and r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
            best = min(expected[r.vec_id], key=lambda e: abs(abs(e[1]) - abs(r.whitened)))
            assert int(r.deviation) == best[0] and abs(r.whitened) == pytest.approx(abs(best[1]), abs=1e-9)
            signs.append(np.sign(r.whitened * best[1]))
        assert len(set(signs) - {0}) == 1


def test_whitening_of_little(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert W.whiten(table([])).count() == 0
    assert W.whiten(table([(1, None), (2, [])])).count() == 0
    assert W.whiten(table([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    out = W.whiten(table([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [3.0, 2.0])])).collect()
    assert sorted((r.vec_id, abs(round(r.whitened, 9)), int(r.deviation)) for r in out) == [(1, 1.0, 512**2), (2, 1.0, 512**2), (3, 1.0, 512**2)]
    held = W.quantised(table([(1, [3e38]), (2, [-3e38])])).orderBy("vec_id").collect()
    assert [r.x for r in held] == [[2**63 - 1], [-(2**63)]]
    assert W.whiten(table([(1, [3e38]), (2, [-3e38])])).count() == 2


# --- conversations -------------------------------------------------------------------------

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def talk(rng):
    rows = []
    for conv in range(60):
        n = rng.choice([1, 2, 3, 5, 8, 30])
        for t in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ["user", "assistant"][t % 2]
            if rng.random() < 0.1:
                role = rng.choice(["system", "tool", None, "", "user"])
            text = rng.choice(["Hi.", "Yes!", "no", "", " \t", None, f"Text {t}?", f"cut {t}", "a.\x1c", "trail. \x0b"])
            rows.append((conv if conv else None, rng.choice([t, t, t, t + 3, None]), role, text))
    rows += [(900, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(400)]
    rows += [(901, None, "user", "Same.")] * 50 + [(902, t, "user", "Same.") for t in range(70)]
    rows += [(903, t, rng.choice(["user", "assistant", "system"]), f"Turn {t}" + rng.choice([".", ""])) for t in range(500)]
    return rows


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        if k == 1:
            text = ""
        elif k == 2:
            text = re.sub("[.!?]", "", text)
        elif k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def brute(own, costs=C.Costs()):
    """Report of one conversation: rows in order, cheapest and then least edit string by search over (row, state)."""
    own = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
    faults, seen = [], set()
    for _, _, role, text in own:
        last = BLANK.findall(text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(own) and state in (0, 3):
            break
        heapq.heappush(heap, (cost + costs.insert, audit + "I", i, C.after(state, "uuau"[state]), (*lines, f"{C.ROLES['uuau'[state]]}:")))
        if i < len(own):
            _, _, role, text = own[i]
            heapq.heappush(heap, (cost + costs.delete, audit + "D", i + 1, state, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = costs.truncated * (faults[i] == "truncated")
                to = "uuau"[state]
                heapq.heappush(heap, (cost + costs.rerole + more, audit + "R", i + 1, C.after(state, to), (*lines, f"{C.ROLES[to]}:{text}")))
                if role[:1] in "sua" and role and C.after(state, role[0]) is not None:
                    heapq.heappush(heap, (cost + costs.keep + more, audit + "K", i + 1, C.after(state, role[0]), (*lines, f"{role}:{text}")))
    turns = [r[1] for r in own if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows, original, costs=C.Costs()):
    by = {c: [] for c, *_ in original}
    for r in rows:
        by[r[0]].append(r)
    return {c: brute(own, costs) for c, own in by.items()}


@pytest.mark.parametrize("seed", range(2))
def test_repair(spark, seed):
    rows = talk(random.Random(seed))
    table = spark.createDataFrame([(*r, 0, 0) for r in rows], "conv_id long, turn long, role string, text string, copies int, edits int").repartition(4)
    hurt = C.damage(table)
    assert Counter(map(tuple, hurt.collect())) == Counter(damaged(rows))
    got = C.repair(hurt, table).collect()
    assert {r.conv_id: tuple(r[1:]) for r in got} == expected(damaged(rows), rows) and len(got) == len({r[0] for r in rows})
    turns = defaultdict(list)
    for r in C.repaired(hurt).orderBy("conv_id", "turn", "role_before", "digest", "at").collect():
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(turns[r.conv_id]).encode()).hexdigest() == r.repaired_sha256 for r in got)
    assert C.repair(C.damage(table.limit(0)), table.limit(0)).count() == 0


def test_conversations_over_many_blocks(spark):
    rows = damaged(talk(random.Random(9)))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sorted_blocks = C.blocks(C.counted(table))
        assert sorted_blocks.filter("conv_id = 900").select(F.spark_partition_id()).distinct().count() > 3
        got = {r.conv_id: tuple(r[1:]) for r in C.repair(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == expected(rows, rows)


@pytest.mark.parametrize("seed", range(6))
def test_runs_with_other_costs(seed):
    rng = random.Random(seed)
    costs = C.Costs(0, rng.choice([1, 3, 9]), rng.choice([2, 4, 8]), rng.choice([1, 2, 5]), 5)
    for _ in range(60):
        own = []
        while len(own) < rng.randint(0, 14):
            own += [(1, len(own) + k, role, f"t{len(own) + k}{stop}") for role, stop in [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", "."]))] for k in range(rng.randint(1, 5))]
        rows = [(r[2][0] if r[2][0] in "sua" else " ", C.TRUNCATED if r[3][-1] != "." else C.OK, 1) for r in own]
        each, state = C.solve(rows, 0, C.ending(costs), costs) if rows else ([], 0)
        assert "".join(each) + C.finish(state, costs)[0] == brute(own, costs)[6]


def test_long_runs_cross_strides():
    rows = [("u", C.OK, 1)] * (2 * C.STRIDE + 7) + [(" ", C.BLANK, 3000)] + [("a", C.OK, 1)] * 5
    each, state = C.solve(rows, 0, C.ending(C.Costs()), C.Costs())
    audit = "".join(each)
    cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] for e in audit)
    v = C.ending(C.Costs())
    for symbol, n in reversed(C.runs(rows)):
        v = C.advance(symbol, n, v, C.Costs())
    assert cost == v[0] and state in C.ACCEPT and len(audit) == 2 * C.STRIDE + 7 + 3005


def test_registered_queries_have_the_contract_columns(spark):
    d = "/root/testdata/sf0.001"
    assert queries.op11_quality_rules(spark, d).columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert dict(queries.op12_whitening(spark, d).dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert queries.op13_conversation_repair(spark, d).columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
