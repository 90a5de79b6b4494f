"""The operators for training data against brute force on small fixtures, with dirty rows."""


import glob
import importlib
import json
import os
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigris.operators import intervals
from verdigris.llm import abuse, distinctive, encode, grouped, leakage, mix, overlap, oversized, queries

CORPUS = "chunk_id long, path string, start_line int, end_line int, symbol string, text string, n int"
HF = "record_no long, id string, source string, split string, state string, question string, n int"


# ---- SQL ----


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for p in glob.glob(small + "/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(name, spark, duck, small):
    df = queries.queries()[name](spark, small)
    res = duck.execute(queries.oracle_sql()[name])
    cols = [x[0] for x in res.description]
    want = sorted((tuple(r[cols.index(c)] for c in df.columns) for r in res.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_gives_the_same_again(name, spark, small):
    """Without a twin: there are rows, and however the work is dealt out they are the same."""
    rows = lambda d: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in d.collect())
    df = queries.queries()[name](spark, small)
    first = rows(df)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = queries.queries()[name](spark, small)
        assert again.dtypes == df.dtypes and rows(again) == first and (first or name == "p4_covered")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    assert set(queries.queries()) <= set(entry.queries())


# ---- 1: oversized ----

TEXTS = st.lists(st.sampled_from(["fn a() {", "# Head", "", "    x = 1; y = 2", "word " * 40, "w" * 1700, "Ein Satz. Noch einer! Und 漢字漢字。", "é" * 90]), max_size=90)


@given(TEXTS, st.sampled_from(["\n", "\r\n"]), st.booleans(), st.sampled_from([(1600, 60), (200, 5), (90, 3)]))
@settings(max_examples=300, deadline=None)
def test_pieces(lines, end, last, limits):
    text = end.join(lines) + (end if last else "")
    chars, rows = limits
    kw = {"max_chars": chars, "max_lines": rows, "overlap_chars": min(80, chars // 4)}
    got = oversized.split_text(text, **kw)
    assert "".join(text[f:e] for _, f, e in got) == text  # the new parts tile the text
    for k, (s, f, e) in enumerate(got):
        piece = text[s:e]
        assert len(piece) <= chars and len(piece.split("\n")) - piece.endswith("\n") <= rows
        assert s <= f < e
        if k:
            before = text[got[k - 1][0] : got[k - 1][2]]
            assert piece.startswith(before[len(before) - (f - s) :]) and f == got[k - 1][2]
            tail = before.split("\n")[-3:] if before.endswith("\n") else None
            if tail and len("\n".join(tail)) <= chars - 2 and rows > 2:
                assert piece.startswith("\n".join(tail))
            elif tail is None:
                assert f - s == min(kw["overlap_chars"], got[k - 1][2] - got[k - 1][0])


@pytest.mark.parametrize("width", [100, 500, 740, 798])
def test_two_lines_overlap_whenever_they_fit(width):
    text = "\n".join(f"{i:03d}" + "x" * (width - 3) for i in range(40))
    got = oversized.split_text(text)
    assert "".join(text[f:e] for _, f, e in got) == text
    for (s, f, e), (s0, _, e0) in zip(got[1:], got):
        before = text[s0:e0]
        if before.endswith("\n"):
            assert text[s:f] == "".join(before.splitlines(True)[-2:])
        else:
            assert f - s == 80


def test_oversized_rows(spark):
    long = "\n".join(f"def f{i}():\n    return {i}\n" for i in range(40))
    rows = [(1, "a.py", 10, 3, "sym", long, 0), (2, "a.py", 10, 3, "sym", long, 0), (3, None, None, None, None, "x" * 2000, 0), (4, "b", 1, 1, None, None, 0), (5, "b", 1, 1, "s", "", 0), (6, "b", 1, 60, "s", "\n" * 60, 0), (7, "b", 1, 61, "s", "\n" * 61, 0), (8, "b", 1, 1, "s", "y" * 1600, 0)]
    got = oversized.split_oversized(spark.createDataFrame(rows, CORPUS)).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["chunk_id"], r["piece_no"])):
        by.setdefault(r["chunk_id"], []).append(r)
    assert {k for k, v in by.items() if v[0]["oversized"]} == {1, 2, 3, 7} and set(by) == set(range(1, 9))
    assert [p["start_line"] for p in by[1]][0] == 10 and by[1][-1]["end_line"] == 10 + len(long.split("\n")) - 2
    assert by[1][1]["text"].startswith("\n".join(by[1][0]["text"].split("\n")[-3:])) and by[1][1]["symbol"].startswith("f")
    assert by[3][0]["start_line"] is None and by[4][0]["text"] is None and by[5][0]["text"] == ""
    assert oversized.split_oversized(spark.createDataFrame([], CORPUS)).count() == 0


# ---- 2: groups ----


def brute_groups(rows):
    import re

    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for no, id_, src in rows:
        s = re.sub(r"(\([^()]*\))+$", "", re.sub(r"\s+", "", src.lower())).replace("_", "-") if src else None
        b = re.sub(r"^(tdc-[^-]+)-\d+$", r"\1", re.sub(r"(~p\d+)+$", "", re.sub(r"\s+", "", id_.lower()).replace("_", "-"))) if id_ else None
        for k in ([("s", s)] if s else []) + ([("b", b)] if b else []):
            par[find(("r", no))] = find(k)
        find(("r", no))
    out = {}
    for no, _, _ in rows:
        out.setdefault(find(("r", no)), []).append(no)
    return {no: min(v) for v in out.values() for no in v}


def test_groups_against_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for no in range(400):
        src = rnd.choice([None, "", *[f"fam/col-{i}" for i in range(60)]])
        if src:
            src = rnd.choice([src, src.upper(), " " + src, src.replace("-", "_"), src + " (mirror: mit)", src.replace("/", " / ")])
        id_ = rnd.choice([None, f"tsk-{rnd.randrange(300)}", f"TSK-{rnd.randrange(300)}~P{rnd.randrange(3)}", f"tdc-ab{rnd.randrange(40)}-{rnd.randrange(4)} "])
        rows.append((1000 - no, id_, src))
    df = spark.createDataFrame([(*r, None, None, None, 0) for r in rows], HF)
    got = {r["record_no"]: r["group_no"] for r in grouped.tied_groups(df).collect()}
    assert got == brute_groups(rows)


def test_long_chain(spark):
    """A chain whose links come in the worst order still ends, in one group."""
    n = 300
    rows = [(i, f"b{(i * 7919) % n}", f"s{(i * 7919 + 1) % n}") for i in range(n)] + [(n + i, f"b{i}", f"s{i}") for i in range(n)]
    df = spark.createDataFrame([(*r, None, None, None, 0) for r in rows], HF)
    assert grouped.tied_groups(df).agg(F.count_distinct("group_no")).first()[0] == len(set(brute_groups(rows).values()))


def test_mixed_groups(spark):
    rows = [(1, "a", "x"), (2, "a~p1", "y"), (3, "b", None), (4, "b", None), (5, "c", "z"), (6, "c", None), (7, None, "z"), (8, "d", "q"), (9, "d", "Q ")]
    df = spark.createDataFrame([(*r, None, None, None, 0) for r in rows], HF)
    assert {tuple(r) for r in grouped.mixed_groups(grouped.tied_groups(df)).collect()} == {(1, 2), (5, 6), (5, 7)}
    assert grouped.mixed_groups(grouped.tied_groups(df.limit(0))).count() == 0


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=6), st.integers(0, 150))
@settings(max_examples=200, deadline=None)
def test_closest_subset(counts, target):
    got = grouped.closest_subset(counts, target)
    assert all(0 < n <= counts[s] for s, n in got.items())
    sums = {0}
    for s, n in counts.items():
        sums = {a + s * k for a in sums for k in range(n + 1)}
    best = min(sums, key=lambda x: (abs(x - target), x))
    assert abs(sum(s * n for s, n in got.items()) - target) == abs(best - target)


def test_subset_of_many_sizes_keeps_one_array():
    import tracemalloc

    counts = {s: 1 for s in range(3, 5001, 2)}
    tracemalloc.start()
    got = grouped.closest_subset(counts, 1_000_001)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(s * n for s, n in got.items()) == 1_000_001 and peak < 60e6


def test_shares_of_very_many_single_groups():
    plan = grouped.allot({1: 100_000_000}, [("train", 0.8), ("dev", 0.1), ("holdout", 0.1)])
    assert dict(plan[1]) == {"train": 80_000_000, "dev": 10_000_000, "holdout": 10_000_000}


def test_components_with_salted_hooks(spark, monkeypatch):
    from verdigris.operators import components as comps
    from verdigris.operators import joins

    rows = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (7, None)]
    edges = spark.createDataFrame(rows, "a long, b long")
    want = {(r["node"], r["root"]) for r in grouped.components(edges).collect()}
    monkeypatch.setattr(comps, "is_few", lambda d: False)
    assert {(r["node"], r["root"]) for r in grouped.components(edges).collect()} == want == {(i, 0) for i in range(200)} | {(1000 + i, 1000) for i in range(41)}
    assert joins.is_few(edges) and not joins.is_few(edges, 10)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_broadcasts_nothing(spark, how):
    """The small side's files are far below the limit for broadcasts, its repeated rows needn't be."""
    from verdigris.operators import joins
    from verdigris.session import stored

    big = stored(spark.range(5000).select((F.col("id") % 400).alias("k"), F.col("id").alias("n")), "big")
    small = stored(spark.range(300).select(F.col("id").alias("k"), (-F.col("id")).alias("v")), "small")
    got = joins.salted_join(big, small, "k", F.col("n"), how)
    want = {(n % 400, n, -(n % 400) if n % 400 < 300 else None) for n in range(5000)}
    assert {tuple(r) for r in got.collect()} == {r for r in want if how == "left" or r[2] is not None}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_allot_with_units(monkeypatch):
    monkeypatch.setattr(grouped, "MAX_BITS", 500)
    counts = {1: 3000, 7: 400, 120: 30, 2500: 1}
    plan = grouped.allot(counts, [("train", 0.8), ("dev", 0.1), ("holdout", 0.1)])
    total = sum(s * n for s, n in counts.items())
    size = {}
    for s, got in plan.items():
        assert sum(n for _, n in got) == counts[s]
        for k, n in got:
            size[k] = size.get(k, 0) + s * n
    assert size["dev"] == size["holdout"] == round(total / 10)


@pytest.mark.parametrize("counts", [{1: 50_000_000}, {1: 500_000_000}, {1: 3_000_000, 3: 20_000_000, 11: 5_000_000, 5_000_000: 9}, {2: 60_000_000}])
def test_allot_fills_large_splits(counts):
    plan = grouped.allot(counts, [("train", 0.8), ("dev", 0.1), ("holdout", 0.1)])
    total, size = sum(s * n for s, n in counts.items()), {}
    for s, got in plan.items():
        assert sum(n for _, n in got) == counts[s] and all(n > 0 for _, n in got)
        for k, n in got:
            size[k] = size.get(k, 0) + s * n
    assert size["dev"] == size["holdout"] == round(total / 10)


def test_large_totals_are_searched_like_small_ones(monkeypatch):
    """Dev comes as close as brute force does over all subsets, above 4 million records as below, whatever MAX_BITS says."""
    shares = [("train", 0.9), ("dev", 0.1)]
    dev = lambda c: sum(s * n for s, got in grouped.allot(c, shares).items() for k, n in got if k == "dev")
    for unit in (1, 1000, 1_000_000):
        counts = {6 * unit + 1: 1, 4 * unit + 1: 1, 5 * unit + 1: 2, 20 * unit: 4}
        target, sums = round(sum(s * n for s, n in counts.items()) / 10), {0}
        for s, n in counts.items():
            sums = {a + s * k for a in sums for k in range(n + 1)}
        assert dev(counts) == min(sums, key=lambda x: (abs(x - target), x))
    few = {3: 40, 7: 11, 50: 3, 120: 1}
    want = grouped.allot(few, shares)
    monkeypatch.setattr(grouped, "MAX_BITS", 10)
    assert grouped.allot(few, shares) == want


def test_splits(spark):
    rows = [(i, f"i{i // 3}", f"s{i // 3 % 40}") for i in range(600)]
    df = spark.createDataFrame([(*r, None, None, None, 0) for r in rows], HF)
    shares = spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("holdout", 0.1)], "split string, share double")
    got = grouped.grouped_splits(df, shares).collect()
    assert len(got) == 600 and len({(r["group_no"], r["split"]) for r in got}) == len({r["group_no"] for r in got})
    n = {k: sum(r["split"] == k for r in got) for k in ("train", "dev", "holdout")}
    assert n == {"train": 480, "dev": 60, "holdout": 60}
    assert grouped.grouped_splits(df.limit(0), shares).count() == 0
    assert grouped.grouped_splits(df, shares.limit(0)).filter("split is null").count() == 600


# ---- 3: terms ----


def brute_graph(text, window):
    import re

    ts = re.findall("[a-z]{3,}", text.lower())
    near = {t: set() for t in ts}
    for i, t in enumerate(ts):
        for u in ts[i + 1 : i + window]:
            if u != t:
                near[t].add(u)
                near[u].add(t)
    return {t: (ts.count(t), len(n)) for t, n in near.items()}


@given(st.lists(st.lists(st.sampled_from("abc abd Abe abf ab xyz".split()), max_size=25), max_size=5), st.integers(2, 5))
@settings(max_examples=100, deadline=None)
def test_term_graph(rows, window):
    texts = [" ".join(r) for r in rows]
    terms, row, code, tf, deg = distinctive.term_graph(texts, window)
    got = [{} for _ in texts]
    for r, c, n, d in zip(row.tolist(), code.tolist(), tf.tolist(), deg.tolist()):
        got[r][terms[c]] = (n, d)
    assert got == [brute_graph(t, window) for t in texts]


def test_distinctive(spark):
    rows = [(5, "p", 1, 1, "abc", "abc abc xyz", 0), (3, "p", 1, 1, "zzz", "abc abc xyz", 0), (4, "p", None, 1, None, None, 0), (6, "p", None, 1, None, None, 0), (7, "q/path.py", 1, 1, "", "", 0), (8, None, None, None, None, None, 0)]
    df = spark.createDataFrame(rows, CORPUS)
    got = {(r["chunk_id"], r["term"]): (r["tf"], r["df"]) for r in distinctive.distinctive_terms(df).collect()}
    assert got == {(3, "abc"): (2, 1), (3, "xyz"): (1, 1), (3, "zzz"): (1, 1), (7, "path"): (1, 1)}
    assert distinctive.distinctive_terms(df.limit(0)).count() == 0


def test_distinctive_joins_agree(spark, small, monkeypatch):
    """Common terms by broadcast and rare ones by shuffle give what one join gives."""
    c = spark.read.parquet(small + "/corpus.parquet")
    one = {(r["chunk_id"], r["term"], r["df"]) for r in distinctive.distinctive_terms(c).collect()}
    monkeypatch.setattr(distinctive, "COMMON_ROWS", 0)
    assert {(r["chunk_id"], r["term"], r["df"]) for r in distinctive.distinctive_terms(c).collect()} == one


# ---- 4: leakage ----


def test_leakage_against_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    w = lambda n: [rnd.choice("ab cd Ef gh3 ij kl mn".split()) for _ in range(n)]
    states = [" ".join(w(40)) for _ in range(6)]
    cases = [("c1", "test", json.dumps({"a": states[0], "b": [{"x": states[1]}, 5]})), ("c2", "test", states[2]), ("c3", "train", states[3]), ("c4", "test", json.dumps(states[4])), ("c1", "test", states[5]), (None, "test", states[0]), ("c5", "test", None), ("c6", "test", "{broken " + states[0])]
    docs = [(i, "%s. %s -- %s" % (" ".join(w(30)), "_".join(rnd.choice(states).split()[k : k + rnd.choice([8, 11, 12, 20])]).upper(), " ".join(w(30)))) for i, k in enumerate([rnd.randrange(25) for _ in range(80)])]
    docs += [(900, None), (901, ""), (902, " ".join(states[0].split()[20:40]) + " ... " + " ".join(states[0].split()[:20]))]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, id int")
    c = spark.createDataFrame(cases, "id string, split string, state string")
    got = {(r["doc_id"], r["case_id"]): r for r in leakage.leaked_cases(d, c).collect()}
    want = set()
    for no, text in docs:
        grams = leakage.words(text)
        grams = {tuple(grams[i : i + 12]) for i in range(len(grams) - 11)}
        for cid, split, state in cases:
            for v in leakage.text_values(state) if cid and split == "test" else []:
                x = leakage.words(v)
                if any(tuple(x[i : i + 12]) in grams for i in range(len(x) - 11)):
                    want.add((no, cid))
    assert set(got) == want and want
    assert got[(902, "c6")]["tiles"] == 2 and got[(902, "c6")]["longest"] >= 20  # reordered halves are covered
    assert leakage.leaked_cases(d.limit(0), c).count() == 0 and leakage.leaked_cases(d, c.limit(0)).count() == 0
    half = {k for k, r in got.items() if r["share"] >= 0.5}
    assert {(r["doc_id"], r["case_id"]) for r in leakage.leaked_cases(d, c, min_share=0.5).collect()} == half and half < want
    # cases in blocks: the same rows
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 250)
    assert {(r["doc_id"], r["case_id"]): r for r in leakage.leaked_cases(d, c).collect()} == got


def test_tiles_do_not_overlap():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        a, b = rnd.integers(0, 3, 60), rnd.integers(0, 3, 60)
        seeds = {(i, j) for i in range(57) for j in range(57) if (a[i : i + 4] == b[j : j + 4]).all()}
        used_a, used_b = np.zeros(60, int), np.zeros(60, int)
        for i, j, n in leakage.greedy_tiles(a, b, seeds, 4):
            assert (a[i : i + n] == b[j : j + n]).all() and n >= 4
            used_a[i : i + n] += 1
            used_b[j : j + n] += 1
        assert used_a.max(initial=0) <= 1 and used_b.max(initial=0) <= 1


# ---- 5: overlap ----


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12), st.integers(0, 6))
@settings(max_examples=300, deadline=None)
def test_word_distance(a, b, most):
    assert overlap.word_distance(list(a), list(b), most) == min(levenshtein(a, b), most + 1)


def test_overlap_against_brute_force(spark):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(25)]  # few words: boilerplate everywhere
    base = [[rnd.choice(vocab) for _ in range(rnd.choice([3, 7, 8, 9, 16, 24, 31, 40, 64, 80]))] for _ in range(25)]
    qs = ['{"type": "boolean", "instructions": "Is it so?"}', '{"instructions": "is IT, so", "type": "boolean"}', '{"type": "choice", "instructions": "Which?", "criteria": {"a": "x", "b": "y"}}', '{"type": "choice", "instructions": "which", "criteria": {"b": "y", "a": "x"}}', '{"type": "numeric", "instructions": "n", "min": 0, "max": 3}', '{"type": "numeric", "instructions": "n", "min": 0.0, "max": 4}']
    rows = []
    for no in range(400):
        b = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, len(b) // 8, len(b) // 8 + 1])):
            k = rnd.randrange(len(b) + 1)
            op = rnd.randrange(3)
            if op == 0:
                b.insert(k, rnd.choice(vocab))
            elif b and op == 1:
                b.pop(k - 1)
            elif b:
                b[k - 1] = rnd.choice(vocab)
        text = rnd.choice([" ".join(b), json.dumps({"t": " ".join(b), "ok": True}), json.dumps({"b": " ".join(b[3:]), "a": " ".join(b[:3])}, indent=1)])
        rows.append((no, None, rnd.choice(["s", None]), rnd.choice(["train", "dev", "holdout", None]), rnd.choice([text, text, text, None]), rnd.choice(qs), 0))
    rows += [(1000, None, None, "train", "", qs[0], 0), (1001, None, None, "dev", " . ", qs[1], 0)]
    got = {(r["record_lo"], r["record_hi"]): r["distance"] for r in overlap.cross_split_pairs(spark.createDataFrame(rows, HF)).collect()}
    want = {}
    live = [(r[0], r[3], overlap.state_words(r[4]), overlap.question_key(r[5])) for r in rows if r[3] and r[4] is not None]
    for a in live:
        for b in live:
            if a[0] < b[0] and (a[1] == "train") != (b[1] == "train") and a[3] == b[3]:
                d = levenshtein(a[2], b[2])
                if d <= max(len(a[2]), len(b[2])) // 8:
                    want[(a[0], b[0])] = d
    assert got == want and len(want) > 50
    assert overlap.cross_split_pairs(spark.createDataFrame([], HF)).count() == 0


def test_distance_of_long_texts_is_quick():
    a = [f"w{i % 977}" for i in range(20_000)]
    b = a[:5000] + ["x"] + a[5000:9000] + a[9005:] + ["y"] * 3
    assert overlap.word_distance(a, b, 2500) == 9


def test_hot_intervals_meet_in_blocks(spark, monkeypatch):
    """Records of one boilerplate: every pair is found although an interval is cut into many blocks."""
    rows = []
    for i in range(60):
        state = "the report says that pump seven at the old mill lost pressure in the night of the flood again " + f"w{i} " * (1 + i % 2)
        rows.append((i, None, "c", "train" if i % 3 else "dev", state, '{"type": "boolean", "instructions": "a?"}', 0))
    want = {(r["record_lo"], r["record_hi"]) for r in overlap.cross_split_pairs(spark.createDataFrame(rows, HF)).collect()}
    monkeypatch.setattr(intervals, "BLOCK", 7)
    monkeypatch.setattr(intervals, "AT_ONCE", 5)
    got = {(r["record_lo"], r["record_hi"]) for r in overlap.cross_split_pairs(spark.createDataFrame(rows, HF)).collect()}
    assert got == want and len(got) == 20 * 40


@pytest.mark.parametrize("block", [8192, 3])
def test_coverage_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(intervals, "BLOCK", block)
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(40)]
    stock = [" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 30))) for _ in range(6)]
    rows = []
    for i in range(80):
        state = " ".join(rng.choice([*stock, rng.choice(vocab)]) for _ in range(rng.randint(0, 4)))
        rows.append((i, None, rng.choice("ab"), rng.choice(["train", "dev", "holdout"]), state, rng.choice(['{"type": "boolean", "instructions": "a?"}', "b"]), 0))
    rows.append((80, None, None, "dev", None, "b", 0))
    got = {r["record_no"]: (r["words"], r["covered"], r["twin"]) for r in overlap.record_coverage(spark.createDataFrame(rows, HF)).collect()}
    grams = {}
    for no, _, _, split, state, q, _ in rows:
        if split == "train":
            w = overlap.state_words(state)
            for i in range(len(w) - 5):
                grams.setdefault((q, tuple(w[i : i + 6])), set()).add(no)
    for no, _, _, split, state, q, _ in rows[:-1]:
        if split == "train":
            assert no not in got
            continue
        w = overlap.state_words(state)
        hits = [i for i in range(len(w) - 5) if (q, tuple(w[i : i + 6])) in grams]
        assert got[no][:2] == (len(w), len({j for i in hits for j in range(i, i + 6)}))
        assert (got[no][2] is None) == (not hits)
        assert not hits or any(got[no][2] in grams[(q, tuple(w[i : i + 6]))] for i in hits)
    assert 80 not in got
    assert overlap.record_coverage(spark.createDataFrame([], HF)).count() == 0


@pytest.mark.parametrize("lines", [4, 5, 6])
def test_overlap_of_repeated_lines(spark, lines):
    """Edits of early repetitions shift which repetition the later ones are."""
    line = [f"w{i}" for i in range(10)]
    edited = [w if n >= lines or i % 3 else f"x{n}y{i}" for n in range(20) for i, w in enumerate(line)]
    q = '{"type": "boolean", "instructions": "Is it so?"}'
    rows = [(1, None, "s", "train", " ".join(line * 20), q, 0), (2, None, "s", "dev", " ".join(edited), q, 0)]
    assert [(r["record_lo"], r["record_hi"], r["distance"]) for r in overlap.cross_split_pairs(spark.createDataFrame(rows, HF)).collect()] == [(1, 2, 4 * lines)]


# ---- 7: encoding ----


@pytest.fixture(scope="module")
def bpe():
    return encode.vocabulary(os.path.join(encode.TOKENIZERS, encode.VOCABULARY))


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(encode.TOKENIZERS, encode.VOCABULARY))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text("abABnrt  \n's'123éß漢🙂", max_size=80), max_size=8))
@settings(max_examples=200, deadline=None)
def test_encoding(bpe, reference, texts):
    assert bpe.encode_batch(texts) == reference(texts)


def test_vocabulary_and_verification(bpe, reference):
    """Every token of the vocabulary is what merging its bytes gives; the check of pairs agrees with exact merging."""
    assert bpe.whole == set(bpe.id)
    rnd = random.Random(3)
    raw = [bytes(rnd.choice(b"abcdefghi jklmnopqrstuvwxyz\xc3\xa9") for _ in range(rnd.randrange(2, 24))) for _ in range(5000)]
    for w in raw:
        g = np.array(bpe.greedy(w))
        ok = bpe.compatible(g[:-1], g[1:]).all() if len(g) > 1 else True
        assert ok == (bpe.exact(w) == g.tolist())
    texts = ["a" * 5000, "ab" * 3000, " " * 999, "<|endoftext|>", "\x00\x1c\x85", "x" * 70000]
    assert bpe.encode_batch(texts) == reference(texts)
    assert bytes(b for i in bpe.encode_batch([texts[3]])[0] for b in next(k for k, v in bpe.id.items() if v == i)) == texts[3].encode()


def test_merging_by_heap(bpe):
    """Merges in the order of a plain scan, and long words in about linear time."""
    import time

    def plain(word):
        ids = [bpe.byte[b] for b in word]
        while True:
            ranked = [(bpe.merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in bpe.merge]
            if not ranked:
                return ids
            i = min(ranked)[1]
            ids[i : i + 2] = [bpe.merge[(ids[i], ids[i + 1])][1]]

    rng = random.Random(8)
    for _ in range(300):
        w = "".join(rng.choice("abeinorst漢é") for _ in range(rng.randint(0, 60))).encode()
        assert bpe.exact(w) == plain(w)
    t = time.time()
    bpe.exact("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)).encode())
    assert time.time() - t < 5


def test_encode_table(spark):
    df = spark.createDataFrame([(1, "Hello world", 0), (1, None, 0), (None, "", 0), (2, "  ", 0)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"] or 0, len(r["ids"])) for r in encode.encode(df).collect())
    assert got == [(0, 0), (1, 0), (1, 2), (2, 2)]
    assert encode.encode(df.limit(0)).count() == 0
    assert encode.token_counts(df).agg(F.sum("tokens")).first()[0] == 4


# ---- 8: mixing ----


def test_weights():
    w, a, t = mix.choose_weights({"x": 0.5, "y": 0.3, "z": 0.2}, {"x": 1000, "y": 10000, "q": 5}, {"x": 2, "y": 1, "z": 3})
    assert w == pytest.approx({"x": 0.625, "y": 0.375}) and a == 0 and t == pytest.approx(3200)
    w, a, t = mix.choose_weights({"x": 0.5, "y": 0.5}, {"x": 1000, "y": 10000}, {"x": 2, "y": 1}, total=8000)
    assert 0 < a < 1 and w["x"] * 8000 == pytest.approx(2000, rel=1e-6) and t == pytest.approx(8000, rel=1e-6)
    assert mix.choose_weights({"x": 1.0}, {"x": 10}, {"x": 2}, total=100)[2] == 20
    h = -(0.7 * np.log(0.7) + 0.3 * np.log(0.3))
    w, a, _ = mix.choose_weights({"x": 0.1, "y": 0.9}, {"x": 1000, "y": 100}, {"x": 1, "y": 1}, target_entropy=h)
    assert w["x"] == pytest.approx(0.7, rel=1e-4)


@pytest.mark.parametrize("per_block", [1000, 7])
def test_mix(spark, monkeypatch, per_block):
    monkeypatch.setattr(mix, "PER_BLOCK", per_block)
    rnd = random.Random(8)
    rows = [(i, " ".join(["word"] * rnd.randrange(1, 30)) + f" {i}", "big" if i % 3 else "small") for i in range(900)] + [(9000, "same text here", "small"), (9001, "same text here", "big"), (9002, None, "big"), (9003, "", "big"), (9004, "orphan", None), (9005, "other", "untargeted")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.6, 3), ("absent", 0.1, 2)], "source string, weight double, max_repeats int")
    got, report = mix.mix(docs, targets)
    rep = {r["source"]: r for r in report.collect()}
    assert abs(rep["small"]["actual_share"] - 2 / 3) < 2e-3 and rep["absent"]["actual_share"] == 0 and rep["small"]["repeats_used"] == 3
    uses = got.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("repetition").alias("r")).collect()
    assert all(r["n"] == r["r"] <= 3 for r in uses) and not {r["doc_id"] for r in uses} & {9001, 9002, 9003, 9004, 9005}
    again = {(r["doc_id"], r["repetition"]) for r in mix.mix(docs.repartition(5), targets)[0].collect()}
    assert again == {(r["doc_id"], r["repetition"]) for r in got.collect()}


# ---- 9: abuse ----


def test_plain():
    assert abuse.tokens("уou STUUUPID id​iot, m0r0n!") == ["you", "stuupid", "idiot", "moron"]
    assert abuse.tokens("i d i o t") == ["idiot"] and abuse.tokens("l'Ã©tÃ© f&#39;x")[0] == "l'ete"
    assert abuse.sentences(None) == [] and abuse.sentences("  \n ") == []


def fake(rnd, n):
    """Documents of harmless sentences, a fifth with an insult; labels with a tenth wrong."""
    nice = [f"The {a} {b} {c} the {d}." for a in ("old", "new", "red") for b in ("pump", "index", "queue") for c in ("kills", "drops", "reads", "aborts") for d in ("job", "child process", "rows", "class")]
    bad = [f"{a} you {b} {c}" for a in ("Shut up", "Go away", "I hate") for b in ("stupid", "filthy", "worthless") for c in ("moron", "pig", "idiot")]
    texts, truth = [], []
    for _ in range(n):
        s = [rnd.choice(nice) for _ in range(6)]
        t = rnd.random() < 0.2
        if t:
            s.insert(rnd.randrange(6), rnd.choice(bad) + ".")
        texts.append(" ".join(s))
        truth.append(t)
    return texts, truth


def test_held_out_accuracy():
    rnd = random.Random(9)
    texts, truth = fake(rnd, 1500)
    votes = [float(t != (rnd.random() < 0.1)) if i < 500 else None for i, t in enumerate(truth)]
    m = abuse.train(texts, votes)
    new, want = fake(rnd, 600)
    got = m.scores(new) > m.threshold
    tp = sum(g and w for g, w in zip(got, want))
    assert tp / max(1, got.sum()) > 0.97 and tp / sum(want) > 0.97


def test_nnpu_risk_is_not_negative():
    """With as many parameters as rows plain PU risk falls below zero; the corrected one keeps negatives negative."""
    x = abuse.Rows(np.repeat(np.arange(300), 2), np.array([c for i in range(300) for c in (i, 1000 + i % 7)]), 300)
    p, u = np.zeros(300), np.ones(300) / 300
    p[:20] = 1 / 20
    w, b = abuse.fit_nnpu(x, p, u, 20 / 300, steps=300)
    s = x.dot(w, b)
    assert (s[:20] > 0).all() and (s[20:] < 0).mean() > 0.95


def test_abuse_tables(spark):
    docs = spark.createDataFrame([(1, None, None, 0), (2, "", "s", 0), (3, "Nice day.", "s", 0), (3, "Nice day.", "s", 0)], "doc_id long, text string, source string, score int")
    labels = spark.createDataFrame([(1, None, None, None), (3, 0, 0, None), (None, 1, 0, 0)], "doc_id long, abusive int, hateful int, sexual int")
    m = abuse.fit_model(docs, labels)
    r = abuse.score_documents(docs, m)
    assert r.count() == 4 and r.filter("flagged").count() == 0 and abuse.rates(r).count() == 2
    assert abuse.score_documents(docs.limit(0), m).count() == 0


LABELS = "doc_id long, abusive int, hateful int, sexual int"


def test_prior_is_that_of_all_documents(spark):
    """Reviewed documents are abusive far more often than others; how many of either are drawn changes no estimate."""
    rnd = random.Random(4)
    texts, truth = fake(rnd, 3000)
    bad, good = ([t for t, y in zip(texts, truth) if y is x] for x in (True, False))
    reviewed, others = bad[:150] + good[:150], bad[150:170] + good[150:1400]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(reviewed + others)], "doc_id long, text string").withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([(i, int(i < 150), 0, 0) for i in range(300)], LABELS)
    every = [s for t in reviewed + others for s in abuse.passages(t)]
    want = sum("you" in s.split() for s in every) / len(every)
    small, whole = (abuse.fit_model(docs, labels, max_others=most) for most in (40, 10_000))
    # a round may pass over some wordings; the share among those drawn is about four times as high
    assert want / 2 < small.prior < want * 1.5 and want / 2 < whole.prior < want * 1.5
    assert abuse.passages_above(docs.limit(0), whole.weights, whole.bias, whole.weights != 0) == 0


def test_drawn_parts_have_their_true_weights(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"Text {chr(97 + i % 26)}.") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, 0, 0) for i in range(100)], LABELS)
    seen = {}
    monkeypatch.setattr(abuse, "train", lambda texts, votes, **k: seen.update(k, votes=votes))
    abuse.fit_model(docs, labels, max_reviewed=50, max_others=20)
    assert sorted({(v is None, w) for v, w in zip(seen["votes"], seen["stands_for"])}) == [(False, 2.0), (True, 20.0)] and len(seen["votes"]) == 70
