"""Dealt operators against brute force on a small table with nulls, empty texts, copies and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import byte_bpe, decontaminate, licenses, line_dedup, ngram_join, order_minhash, quality, queries, suffix_dedup, token_files, toxicity

CLASH = ("n", "tokens", "h1", "tie", "key", "hits", "w", "at", "bytes", "signature", "_row", "n_lines", "ids", "starts")
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"{c} int" for c in CLASH)


def corpus():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    prose = [rng.choice(vocab) for _ in range(120)]
    texts = [None, "", " ", "word", "Word\nWord\nWord\nWord\nWord", "a b", "naïve 🙂 text with\x1cspaces  \n\n it's 12345"]
    for i in range(30):
        w = list(prose)
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    for _ in range(25):
        texts.append("\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 12))))
    texts += ["one line\ntwo line\nthree line\nfour line", "x\none line\n two line \n\nthree line\ny", "Released under the MIT License.", " ".join(rng.choice(vocab) for _ in range(6000))]
    return dict(enumerate(texts))


TEXTS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, *range(len(CLASH))) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_similar_groups(docs, none):
    sets = {}
    for i, t in TEXTS.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        n = min(5, len(w))
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if n else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert ngram_join.similar_groups(none).count() == 0


def test_sketches_rule_out_no_link_and_most_others():
    rng = np.random.default_rng(3)
    for n in (1, 2, 15, 16, 17, 31, 33, 500, 3000):
        for _ in range(20):
            x = rng.integers(-2**63, 2**63 - 1, n)
            y = np.concatenate([x[n // 10:], rng.integers(-2**63, 2**63 - 1, n // 10)])
            assert ngram_join.alike(x, y) and ngram_join.may_link(n, ngram_join.sketch(x), n, ngram_join.sketch(y))
            z = x[:-(-4 * n // 5)]
            assert ngram_join.alike(x, z) and ngram_join.may_link(n, ngram_join.sketch(x), len(z), ngram_join.sketch(z))
    assert not ngram_join.may_link(3000, ngram_join.sketch(x), 3000, ngram_join.sketch(rng.integers(-2**63, 2**63 - 1, 3000)))
    assert ngram_join.sketch(np.zeros(300, np.int64)) == b""


def test_join_stores_and_deals_no_token_sets(spark, docs, monkeypatch):
    """Rows that are stored hold no array, and unlike texts that share keys are not dealt out."""
    seen = []
    monkeypatch.setattr(ngram_join, "stored", lambda df, keep=ngram_join.stored: seen.append(df.dtypes) or keep(df))
    ngram_join.links_and_classes(docs)
    assert seen and not any(kind.startswith("array") for columns in seen for _, kind in columns)


@pytest.mark.parametrize("seed", range(3))
def test_allocation_never_misses(seed):
    rng = np.random.default_rng(seed)
    ends = ngram_join.bands(400)
    for _ in range(150):
        n = int(rng.integers(1, 300))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        change = rng.integers(0, n // 9 + 1)
        b[:change] = rng.integers(0, 2**63, change).astype(np.uint64)
        b = b[: n - int(rng.integers(0, n // 20 + 1))]
        small, large = sorted((a, b), key=len)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            frequency = rng.integers(0, 100, ngram_join.SLOTS)
            assert len(np.intersect1d(ngram_join.index_keys(small, ends), ngram_join.probe_keys(large, ends, frequency)))


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, expected, start = Tokenizer.from_file(path), {}, 0
    for i in sorted(TEXTS):
        ids = [*t.encode(TEXTS[i] or "", add_special_tokens=False).ids, 1]
        expected[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.digests(token_files.round_trip(docs, path)).collect()}
    assert got == expected
    assert token_files.round_trip(none, path).count() == 0


def test_packing_every_width():
    v = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    for n in range(len(v) + 1):
        assert token_files.unpack(*token_files.pack(v[:n]), n).tolist() == v[:n].tolist()


def test_byte_bpe(docs, none):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path, P.PATTERN)
    for r in out.collect():
        assert list(r.ids) == enc.encode_ordinary(TEXTS[r.doc_id] or "")
        assert bytes(r.decoded) == (TEXTS[r.doc_id] or "").encode()
    assert byte_bpe.encode(none, path, P.PATTERN).count() == 0


def items_of(spark):
    w = TEXTS[7].split()
    rows = [(1, " ".join(w[5:40])), (2, " ".join(w[5:40])), (3, "Word"), (4, None), (5, ""), (6, "a  B"), (7, "nothing of this sort is there"), (8, " ".join(w[50:63]))]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def test_contamination(spark, docs, none):
    rows, items = items_of(spark)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in rows:
        w = pattern.findall(low(text))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(str(item))
    expected = {}
    for i, t in TEXTS.items():
        w, hit, ids = pattern.findall(low(t)), set(), set()
        for win, owners in windows.items():
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j:j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    ids |= owners
        expected[i] = (len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w))
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in decontaminate.contamination(docs, items).collect()}
    assert got == expected
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0


def test_suffix_dedup(docs, none):
    seen, expected = set(), {}
    for i in sorted(TEXTS):
        b = (TEXTS[i] or "").encode()
        gone, own = bytearray(len(b)), set()
        for j in range(len(b) - 49):
            if b[j:j + 50] in seen:
                gone[j:j + 50] = b"\1" * 50
            own.add(b[j:j + 50])
        seen |= own
        spans = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(gone)))
        expected[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(suffix_dedup.dedup(docs)).collect()}
    assert got == expected
    assert suffix_dedup.dedup(none).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_loser_tree_merges_any_runs(seed):
    rng = np.random.default_rng(seed)
    runs = [np.unique(np.array([bytes(rng.integers(97, 99, 6).tolist()) for _ in range(rng.integers(1, 40))], "S6")) for _ in range(rng.integers(1, 9))]
    parts = [suffix_dedup.Run(*suffix_dedup.front_code(r, 6), 6) for r in runs]
    merged, before = [], None
    for r, equal in suffix_dedup.merge(parts):
        assert equal == (before == parts[r].key)
        before = parts[r].key
        merged.append(before)
    assert merged == sorted(bytes(k) for r in runs for k in r)


def sql(docs, name):
    frame = docs.select("doc_id", "text", "lang").toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    return {r[0]: r[1:] for r in con.sql(queries.ORACLES[name]).fetchall()}


def test_line_dedup(docs, none):
    expected = sql(docs, "op7_line_dedup")
    out = line_dedup.dedup_lines(docs, words=line_dedup.PASSAGE_WORDS)
    assert out.columns.count("n_lines") == 1
    got = {r.doc_id: (r.n_lines, r.n_removed_lines, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()}
    assert got == expected and sum(g[1] for g in got.values()) > 0
    assert line_dedup.dedup_lines(none).count() == 0


def passages_removed(texts, run, words):
    lines = {i: [x.strip(" \t\r\f\v") for x in (t or "").split("\n")] for i, t in texts.items()}
    first, later = {}, defaultdict(set)
    for i in sorted(lines):
        real = [j for j, x in enumerate(lines[i]) if x]
        for at in range(len(real)):
            for n in range(1, run + 1):
                part = real[at:at + n]
                key = tuple(lines[i][j] for j in part)
                if len(part) == n and (n == run or len(" ".join(key).split()) > words) and first.setdefault(key, (i, at)) != (i, at):
                    later[i] |= set(part)
    return {i: (len(later[i]), t if not later[i] else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in later[i])) for i, t in texts.items()}


def test_line_ends_inside_lines(spark):
    # Carriage returns and Unicode line separators inside a line are part of it.
    for inner in ("\r", "\u2028", "\x85"):
        texts = [f"c {inner} d\nx\ny", f"c{inner}d\nx\ny", f" c {inner} d \nx\ny\t"]
        frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
        expected = sql(frame, "op7_line_dedup")
        got = {r.doc_id: (r.n_lines, r.n_removed_lines) for r in line_dedup.dedup_lines(frame, words=line_dedup.PASSAGE_WORDS).collect()}
        assert got == {0: (3, 0), 1: (3, 0), 2: (3, 3)}
        assert {k: v[:2] for k, v in expected.items()} == got


def test_rows_of_one_doc_id_are_one_node(spark):
    w = lambda k: " ".join(f"{k}{i}" for i in range(60))
    a, b, c = w("a"), w("b"), w("c")
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (5, c), (5, a + " y"), (6, c + " z"), (7, w("d")), (7, w("d")), (None, a), (None, w("e")), (8, None), (8, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.component_id) for r in ngram_join.similar_groups(frame).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (7, 7), (None, 1), (None, None), (8, 8)}


def test_line_dedup_of_short_long_passages(spark):
    line, half = " ".join(f"a{i}" for i in range(51)), [" ".join(f"{c}{i}" for i in range(26)) for c in "bc"]
    few = " ".join(f"d{i}" for i in range(50))
    texts = {1: f"x\n{line}\ny", 2: line, 3: f" {line} ", 4: "\n".join(half), 5: f"p\n{half[0]}\n\n{half[1]}\nq", 6: half[0], 7: few, 8: few, 9: f"{line}\n{line}", 10: None, 11: "k\nl\nm", 12: "k\nl\nm", 13: "k\nl"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed_lines, r.text) for r in line_dedup.dedup_lines(frame, words=line_dedup.PASSAGE_WORDS).collect()}
    assert got == passages_removed(texts, line_dedup.RUN, line_dedup.PASSAGE_WORDS)
    assert {i for i, g in got.items() if g[0]} == {2, 3, 5, 9, 12} and got[5] == (2, "p\n\nq")


def test_pipeline_removes_short_long_passages(spark):
    import corpus_pipeline

    line = " ".join(f"a{i}" for i in range(51))
    frame = spark.createDataFrame([(1, line, 0), (2, f"own words\n{line}", 0), (3, line, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, frame, "").collect()}
    assert got == {1: line, 2: "own words"}


def test_license_scan(docs, none):
    expected = sql(docs, "op6_license_scan")
    got = {r.doc_id: (r.n_matches, r.licenses, r.best_dice) for r in licenses.summary(licenses.scan(docs)).collect()}
    assert got == expected and any("MIT" in g[1] for g in got.values())
    assert licenses.scan(none).count() == 0


def test_order_minhash(docs, none):
    rows = {r.doc_id: r for r in order_minhash.fingerprints(docs).collect()}
    order = sorted(TEXTS, reverse=True)
    for i, at in zip(order, range(len(order)), strict=True):
        text, following = TEXTS[i] or "", TEXTS[order[(at + 1) % len(order)]] or ""
        half = len(text) // 2
        assert rows[i].n_chars == len(text)
        assert rows[i].edited == text[:len(text) - half] + following[:half]
        assert rows[i].next_signature == rows[order[(at + 1) % len(order)]].signature
    assert order_minhash.fingerprints(none).count() == 0


@pytest.mark.parametrize("sorted_", [1, 24])
def test_order_minhash_against_its_definition(spark, monkeypatch, sorted_):
    """Also where too few hashes of a bin are looked at first, in texts of few k-mers, and beyond the BMP."""
    monkeypatch.setattr(order_minhash, "SORTED", sorted_)
    texts = ["a", "abcde", "abcdef", "a" * 40, "x\U0001F642y" * 9, "the cat sat on the mat " * 90, TEXTS[len(TEXTS) - 1]]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", order_minhash.signature(F.col("text")).alias("s"))
    got = {r.i: r.s for r in frame.collect()}
    mers = [(i, p, t[p:p + 6]) for i, t in enumerate(texts) for p in range(max(len(t) - 5, 1))]
    first = F.shiftrightunsigned(F.xxhash64("g"), 28)
    seen, numbered = defaultdict(int), []
    for r in spark.createDataFrame(mers, "i int, p int, g string").select("i", "p", first.alias("m")).orderBy("i", "p").collect():
        numbered.append((r.i, r.p, r.m, seen[r.i, r.m]))
        seen[r.i, r.m] += 1
    key = F.when(F.col("o") == 0, F.col("m")).otherwise(F.shiftrightunsigned(F.xxhash64("m", "o"), 28))
    bins = defaultdict(list)
    for r in spark.createDataFrame(numbered, "i int, p int, m long, o int").select("i", "p", key.alias("k")).collect():
        bins[r.i, r.k >> 30].append((r.k, r.p))
    chosen = [(i, b, [k for k, _ in sorted(sorted(v)[:2], key=lambda x: x[1])]) for (i, b), v in bins.items()]
    expected = {i: [""] * 64 for i in range(len(texts))}
    for r in spark.createDataFrame(chosen, "i int, b int, k array<long>").select("i", "b", F.lpad(F.hex(F.xxhash64("k")), 16, "0").alias("h")).collect():
        expected[r.i][r.b] = r.h
    assert got == expected


def test_order_minhash_sees_order_and_repeats(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(words[100:] + words[:100]), " ".join(words), " ".join(reversed(words)), "ab" * 50, "ab" * 500]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", order_minhash.signature(F.col("text")).alias("s"))
    s = {r.doc_id: r.s for r in frame.collect()}
    assert s[0] == s[2] and s[0] != s[3] and s[4] != s[5]
    assert sum(a == b for a, b in zip(s[0], s[1])) > sum(a == b for a, b in zip(s[0], s[3]))


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, 1) for i in range(7, 60)], "doc_id long, quality int")
    out = quality.judge(docs, labels).collect()
    assert len(out) == len(TEXTS)
    by_id = {r.doc_id: r for r in out}
    assert by_id[0].perplexity is None and not by_id[0].keep and not by_id[1].keep
    assert sum(by_id[i].keep for i in range(7, 60)) >= 50
    assert quality.judge(none, labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).count() == len(TEXTS)


def test_quality_model_sums_to_one(docs):
    model = quality.train(docs.select("text")).filter("k = 1").groupBy("kind").agg(F.sum("p").alias("p"), F.count("*").alias("n")).collect()
    rows = {r.kind: r for r in model}
    unseen = rows["h"].p * (1 - rows["p"].n / quality.CODE_POINTS)
    assert rows["p"].p + unseen == pytest.approx(1.0)


def brute_model(seqs, order, base):
    """P(last token of g after the others) of a modified Kneser-Ney model, as a function of g."""
    counts = {order: defaultdict(int)}
    for q in seqs:
        for j in range(order - 1, len(q)):
            counts[order][tuple(q[j - order + 1:j + 1])] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = defaultdict(int)
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    cuts = {}
    for k, table in counts.items():
        n1, n2, n3, n4 = (max(sum(c == i for c in table.values()), 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cuts[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]
    totals, spare = defaultdict(int), defaultdict(float)
    for k, table in counts.items():
        for g, c in table.items():
            totals[k, g[:-1]] += c
            spare[k, g[:-1]] += cuts[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else base(g[0])
        if (k, g[:-1]) not in totals:
            return below
        c = counts[k].get(g, 0)
        return (c - cuts[k][min(c, 3) - 1] if c else 0) / totals[k, g[:-1]] + spare[k, g[:-1]] / totals[k, g[:-1]] * below

    return p


def test_quality_against_brute_force_model(spark, docs):
    import math

    tokens = {i: t.split() for i, t in TEXTS.items() if t and t.split() and "\x1c" not in t}
    trained = [["", "", *tokens[i]] for i in tokens if i % 4]
    char = brute_model([["\n", "\n", *w, " "] for q in trained for w in q[2:]], 3, lambda c: 1 / quality.CODE_POINTS)

    def spelled(w):
        c = ["\n", "\n", *w, " "]
        return math.prod(char(tuple(c[j - 2:j + 1])) for j in range(2, len(c)))

    word = brute_model(trained, 3, spelled)
    expected = {}
    for i, w in tokens.items():
        q = ["", "", *w]
        expected[i] = math.exp(-sum(math.log(word(tuple(q[j - 2:j + 1]))) for j in range(2, len(q))) / len(w))
    some = docs.filter(F.col("doc_id").isin(list(tokens)))
    got = {r.doc_id: r for r in quality.score(some, quality.train_words(some.filter("doc_id % 4 <> 0").select("text"))).collect()}
    assert {i: r.n for i, r in got.items()} == {i: len(w) for i, w in tokens.items()}
    assert {i: r.perplexity for i, r in got.items()} == pytest.approx(expected, rel=1e-9)


def test_quality_model_is_stored_once(docs, monkeypatch):
    """Of what training stores only the parts of the two models are left, no counts and no second copy."""
    left = {}
    monkeypatch.setattr(quality, "stored", lambda df, keep=quality.stored: left.setdefault((out := keep(df))._stored_at, out))
    monkeypatch.setattr(quality, "free", lambda *tables, drop=quality.free: [left.pop(t._stored_at) for t in tables] and drop(*tables))
    model, chars = quality.train_words(docs.select("text"))
    assert sorted(",".join(t.columns) for t in left.values()) == ["g,p"] * 6 + ["h,total,rest"] * 6
    assert model.count() and chars.count()


def test_quality_recall_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").toPandas()
    bad, good = out[out.quality == 0], out[out.quality == 1]
    assert not bad.keep.any() and good.keep.mean() > 0.97


def test_toxicity(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.classify(d, labels).join(labels, "doc_id").toPandas()
    test = out[out.held_out]
    rank = test.score.rank()
    bad = test.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.85 and test[test.predicted == 1].toxic.mean() > 0.85
    few = labels.limit(0)
    assert toxicity.classify(docs, few).filter("score <> 0.5").count() == 0
    assert toxicity.classify(none, few).count() == 0


def test_neutral_mentions_of_groups_keep_their_score(spark):
    rng = random.Random(3)
    filler = [f"{a}{b}" for a in "bcdfg" for b in ("an", "el", "ir", "os")]
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(filler) for _ in range(8)]
        toxic = i % 3 == 0
        if toxic:
            words += [rng.choice(("scum", "vermin")), rng.choice(list(toxicity.SWAP))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    plain = " ".join(filler[:8])
    asked = [(-1, plain), (-2, f"{plain} scum"), *[(i, f"{plain} {t}") for i, t in enumerate(toxicity.SWAP)]]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    change = {t: round(abs(got[i] - got[-1]), 3) for i, t in enumerate(toxicity.SWAP)}
    assert got[-2] > 0.7 and max(change.values()) < 0.05, (got[-1], got[-2], sorted(change.items(), key=lambda x: -x[1])[:9])
    assert {"muslim", "woman", "jew"} <= set(toxicity.SWAP)


def test_counterfactual_penalty_narrows_scores():
    x = np.array([[1.0, 0], [1, 0], [0, 1], [0, 1], [1, 0], [0, 1]])
    y = np.array([1.0, 1, 0, 0, 1, 0])
    twin = x[:, ::-1]
    free, held = toxicity.fit(x, twin, y, penalty=0.0), toxicity.fit(x, twin, y, penalty=20.0)
    assert abs(held[0] - held[1]) < abs(free[0] - free[1])


def test_pipeline_keeps_rows_without_ids_and_one_of_each_copy(spark):
    import corpus_pipeline as P

    w = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, w("a"), "en", "s", 9), (1, w("a"), "en", "s", 9), (2, w("a") + " z", "en", "s", 9), (None, w("a"), "en", "s", 9), (None, w("b"), "en", "s", 9), (None, w("b") + " z", "en", "s", 9), (None, w("c"), "en", "s", 9), (4, None, "en", "s", 0), (5, "", "en", "s", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or -1, (r.text or "")[:1]) for r in P.drop_near_copies(spark, frame, "").collect()))
    assert got == [(-1, "b"), (-1, "c"), (1, "a"), (4, ""), (5, "")]
    assert P.drop_near_copies(spark, frame.limit(0), "").count() == 0
    passage = "\n".join(" ".join(f"w{n}{i}" for i in range(30)) for n in range(3))
    shared = spark.createDataFrame([(None, passage + "\nfirst", "en", "s", 9), (3, passage + "\nsecond", "en", "s", 9)], frame.schema)
    out = {r.doc_id: r.text for r in P.dedup_lines(spark, shared, "").collect()}
    assert out == {3: passage + "\nsecond", None: "first"}


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).toPandas()
    ids = set(pd.read_parquet(f"{sf}/documents.parquet").doc_id)
    assert 0 < len(out) < len(ids) and set(out.doc_id) <= ids and out.doc_id.is_unique


def test_remembered_words_give_the_ids_of_whole_texts(monkeypatch):
    """Blanks of every kind, marks after blanks, special strings, long words, and a memory of three words."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [
        "", " ", "\x0b\x0c\x85", "One two  one\tTWO\r\none", "a<|endoftext|> b <|startoftext|>c", "e\u0301 \u0308x \u00a0y\u2028z\x1cq",
        "\u03a3\u0391\u03a3 \u03a3.", "x" * 3000 + " " + "x" * 3000, "\u65e5\u672c \u8a9e don't 'S 'T\n's", " ".join(f"w{i}" for i in range(900)),
    ]
    for kept in (3, 1000):
        monkeypatch.setattr(token_files, "WORDS_KEPT", kept)
        known = {}
        for text in texts * 2:
            assert token_files.encode(text, t, known).tolist() == [*t.encode(text, add_special_tokens=False).ids, token_files.END]
        assert all(len(w) <= token_files.LONGEST_KEPT for w in known)
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert token_files.spans_words(lambda text: other.encode(text, add_special_tokens=False).ids)
