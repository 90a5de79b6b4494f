"""Analyser, chunker, descent, readers, near-duplicates, contamination, drift."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigris.functions import text as tx
from verdigris.operators import chunks, descend, drift, intervals, joins, lexical, metrics, prepare, search
from verdigris.sources import readers, sinks


@pytest.mark.parametrize(
    "word, stem",
    [
        ("berries", "berri"), ("berry", "berri"), ("glasses", "glass"), ("virus", "virus"), ("basis", "basis"), ("lamps", "lamp"), ("os", "os"),  # plurals and y
        ("planned", "plan"), ("planning", "plan"), ("grated", "grate"), ("enabling", "enabl"), ("sizing", "size"), ("hoping", "hope"), ("mixing", "mix"),  # past, mended
        ("fizzed", "fizz"), ("spelled", "spell"), ("bring", "bring"), ("sing", "sing"), ("freed", "freed"), ("succeeded", "succe"), ("decreed", "decre"),  # what stays, what goes on
        ("fable", "fabl"), ("motive", "motiv"), ("tune", "tune"), ("toe", "toe"), ("patroll", "patrol"), ("hill", "hill"), ("sky", "sky"), ("yoyo", "yoyo"),  # final e, ll, y
    ],
)
def test_stem(word, stem):
    assert tx.stem(word) == stem


def test_terms():
    assert tx.terms("the ConnectionPool") == ["connection", "pool", "connectionpool"]
    assert tx.terms("parse_HTTPServer2 é x") == ["pars", "http", "server2", "parsehttpserver2", "é"]
    assert tx.terms("数据库connection 中") == ["数据", "据库", "connection", "中"]
    assert tx.humps("parseJSON2") == ["parse", "JSON2"] and tx.humps("HTTPServer") == ["HTTP", "Server"]


SOURCE = "\n".join(["use x;", "", "pub fn first(a: u8) {", "    let b = a;", "", "    b", "}", "", "impl Thing for Other {", "    fn inner(&self) {}", "}"])


def test_chunks_cover_lines():
    got = chunks.split_file("a/b.rs", SOURCE)
    assert got == [(1, 11, "first", SOURCE)]
    long = "\n".join(f"fn f{i}() {{\n" + "\n".join("    x();" for _ in range(25)) + "\n}\n" for i in range(6))
    parts = chunks.split_file("a.rs", long)
    assert len(parts) == 3 and [p[2] for p in parts] == ["f0", "f2", "f4"]
    md = "# One\n\ntext\n\nmore\n\n## Two\nx\n"
    assert [(p[0], p[2]) for p in chunks.split_file("r.md", md)] == [(1, "One"), (7, "Two")]


@given(st.lists(st.sampled_from(["", "fn a() {", "    x", "}", "# h", "text " * 30, "word" * 500, "\t- y"]), max_size=150), st.sampled_from(["a.rs", "b.md", "c.txt"]))
@settings(max_examples=150, deadline=None)
def test_chunk_invariants(lines, path):
    text = "\n".join(lines)
    seen = []
    for s, e, _, body in chunks.split_file(path, text):
        assert body == "\n".join(lines[s - 1 : e]) and lines[s - 1].strip() and lines[e - 1].strip()
        assert s == e or (e - s < chunks.MAX_LINES and len(body) <= chunks.MAX_CHARS)
        seen += range(s, e + 1)
    assert len(seen) == len(set(seen)) and seen == sorted(seen)
    assert {i + 1 for i, x in enumerate(lines) if x.strip()} <= set(seen)


@pytest.mark.parametrize(
    "line, want",
    [
        ("pub(in crate) async unsafe fn poll_all(&self)", ("poll_all", True)), ("impl<'a, T: Clone> fmt::Display for net::Peer<'a, T> {", ("Peer", True)), ("impl Shelf {", ("Shelf", True)),
        ("func (s *Shelf) Lend(b Book) error {", ("Lend", True)), ("func Lend(b Book)", ("Lend", True)), ("export default async function* pages() {", ("pages", True)), ("  def self.borrow(x)", ("borrow", True)),
        ("macro_rules! shelf {", ("shelf", True)), ("static mut COUNT: u8 = 3;", ("COUNT", False)), ("  let mut total = 0;", ("total", False)), ("export const rows = [", ("rows", False)), ("static const int = 1", ("int", False)),
        ("extern \"C\" fn f()", ("f", True)), ("data class Point(", ("Point", True)), ("type Row = u8", ("Row", True)), ("return fn", None), ("x = define(y)", None), ("let x", None), ("", None), ("const", None), ("publish fn a", None),
    ],
)
def test_declarations(line, want):
    assert chunks.declared(line) == want


def test_declarations_as_column(spark):
    lines = ["pub struct Shelf;", "  lend();", None, "static A: u8", "def a():", "the fn of it"]
    got = [r["n"] for r in spark.createDataFrame([(x,) for x in lines], "line string").select(chunks.declared_column(F.col("line")).alias("n")).collect()]
    assert got == [None if x is None or not chunks.declared(x) else chunks.declared(x)[0] for x in lines] == ["Shelf", None, None, "A", "a", None]


def test_parts_of_a_large_unit_are_named():
    """An item declared in the part, else the item that the part goes on with, else the unit."""
    body = ["        step();"] * 70
    lines = ["impl Machine {", "    fn start(&self) {", *body, "", *body, "    }", "", "    let x = 1;", *["    y();"] * 55, "", "    fn stop() {", "    }", "}"]
    got = [(s, e, n) for s, e, n, _ in chunks.split_file("m.rs", "\n".join(lines))]
    assert [n for _, _, n in got] == ["Machine", "start", "start", "start", "stop"]
    assert got[0][0] == 1 and got[-1][1] == len(lines) and all(e - s < 60 for s, e, _ in got)


def test_sections_close_chunks_with_a_body():
    short = "# A\n\none\n\n# B\n\ntwo\n"
    assert [(n, s, e) for s, e, n, _ in chunks.split_file("a.md", short)] == [("A", 1, 7)]
    long = "# A\n\none\n\ntwo\n\n# B\n\nthree\n"
    assert [(n, s, e) for s, e, n, _ in chunks.split_file("a.md", long)] == [("A", 1, 5), ("B", 7, 9)]
    assert chunks.split_file("a.md", "") == [] and chunks.split_file("a.py", "\n \n") == [] and chunks.split_file("x", "a\r\nb\r\n") == [(1, 2, None, "a\nb")]


def test_headings_of_all_kinds():
    h = lambda ext, *lines: [(i, x) for i, x in enumerate(chunks.headings(ext, list(lines))) if x]
    assert h("rst", "=====", "Name", "=====", "text", "Part", "---") == [(0, "Name"), (4, "Part")]
    assert h("org", "* One", "******** Deep", "Two", "---") == [(0, "One"), (1, "Deep")] and h("adoc", "= One", "====== Six", "======= Seven", "T", "----") == [(0, "One"), (1, "Six")]
    assert h("md", "---", "# in front", "...", "# Yes", "~~~", "# no", "~~~", "####### seven") == [(3, "Yes")] and h("md", "---", "# Open") == [(1, "Open")] and h("txt", "```", "# Yes", "#no") == [(1, "Yes")]


def test_previews_repeat_nothing():
    cs = [("a/queue.rs", "retry_queue", "//! Keeps what failed.\n// retry queue\nfn retry_queue() { push(); }"), ("a/queue.rs", None, "// retry queue\nfn other() {}"), ("a/queue.rs", "drain", "fn drain() { push(); }")]
    assert descend.file_preview(cs).split("\n") == ["keeps what failed", "retry queue", "drain", "retry queue push", "other", "drain push"]
    assert descend.group_preview(cs[1:]).split("\n") == ["drain", "other", "drain push"]  # a comment without a name counts as said
    assert descend.file_line("a/queue.rs", cs[0][2]) == "queue: keeps what failed" and descend.file_line("a/.hidden", "") == "hidden"
    assert descend.folder_preview(["a/b"], ["queue: x"], ["A", "retry_queue", "a"]) == "b/\nqueue: x\na\nretry queue"


def test_headings():
    h = chunks.headings("md", ["---", "a: b", "---", "Title", "=====", "```", "# no", "```", "## Yes ##"])
    assert [x for x in h if x] == ["Title", "Yes ##"]


def test_scrub():
    assert descend.scrub("a.py", 'def load_rows(path):  # reads rows\n    """Doc line."""\n    return "a value"') == [("load rows path reads rows", True), ("doc line", False), ("a value", True)]
    assert descend.scrub("a.rs", "#[derive(Debug)]\n// note here\npub fn x() {}") == [("note here", False)]


def docs(spark):
    rows = [(i, f"src/m{i % 3}/f{i // 4}.rs" if i % 5 else "README.md", f"sym_{i}", f"fn sym_{i}() {{ retry queue {'weight ' * (i % 4)} }}") for i in range(40)]
    return spark.createDataFrame(rows, "doc long, path string, symbol string, body string")


def test_file_counts_equal_joined_texts(spark):
    d = docs(spark)
    c = lexical.term_counts(d)
    got = {(r["doc"], r["term"]): (r["tf_symbol"], r["tf_body"]) for r in lexical.file_counts(c, d).collect()}
    want = {(r["doc"], r["term"]): (r["tf_symbol"], r["tf_body"]) for r in lexical.term_counts(lexical.file_documents(d)).collect()}
    assert got == want


def test_recall_and_descent(spark):
    d, q = docs(spark), spark.createDataFrame([(1, "retry weight"), (2, "nothing here zzz")], "query_id int, query string")
    r = lexical.recall(d, q, 0).collect()
    for qid in (1, 2):
        pos = sorted((x["position"], x["doc"]) for x in r if x["query_id"] == qid)
        assert [p for p, _ in pos] == list(range(1, 41)) and len({x for _, x in pos}) == 40
    score = lambda p: p.select("query_id", "key", (F.abs(F.hash("key")) % 97 / 97).alias("p"))
    wide = descend.descend(d, q, score, beam=99).collect()
    assert {x["doc"] for x in wide if x["query_id"] == 1} == set(range(40))
    assert descend.descend(d, q, score, beam=0).count() == 0
    narrow = descend.descend(d, q, score, beam=1).filter("query_id = 1").count()
    assert 0 < narrow < 40


def test_rerank_stops_early(spark):
    c = spark.createDataFrame([(1, i, i) for i in range(1, 41)], "query_id int, doc long, position int")
    score = lambda x: x.withColumn("p", F.when(F.col("position") <= 12, 0.9).otherwise(0.1))
    assert search.rerank(c, score, 10, 0.5, wave=8).count() == 24
    assert search.rerank(c, score, 10, 0.5, stop=False).count() == 40


def test_tree_reading(spark, tmp_path):
    for p, body in {"a.py": b"x = 1\n", "b/c.md": b"\xef\xbb\xbf# T\n", "b/skip.log": b"l", "n.bin": b"a\x00b", "bad.txt": b"\xff\xfe", "Cargo.lock": b"v", "min.js": b"x" * 5000, ".hidden": b"h\n", ".git/x": b"x"}.items():
        f = tmp_path / p
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(body)
    (tmp_path / ".gitignore").write_text("*.log\n")
    assert readers.list_tree(str(tmp_path)) == [".gitignore", ".hidden", "a.py", "b/c.md", "bad.txt", "min.js", "n.bin"]
    assert readers.list_tree(str(tmp_path), ["*.md"]) == ["b/c.md"] and "Cargo.lock" in readers.list_tree(str(tmp_path), ["Cargo.lock"])
    got = {r["path"]: r["text"] for r in readers.read_tree(spark, str(tmp_path)).collect()}
    assert got == {".gitignore": "*.log\n", ".hidden": "h\n", "a.py": "x = 1\n", "b/c.md": "# T\n"}
    assert readers.load_chunks(spark, str(tmp_path), pattern="^# t").count() == 1
    assert readers.load_chunks(spark, str(tmp_path / "b/skip.log")).count() == 1


def test_case_files(spark, tmp_path):
    f = tmp_path / "c.jsonl"
    f.write_text('# note\n\n{"id": "1", "state": {"b": 1, "a": 2}, "question": {"type": "boolean"}, "expect": {"boolean": true}}\n')
    r = readers.load_cases(spark, str(f)).first()
    assert r["id"] == "1" and list(json.loads(r["state"])) == ["b", "a"]
    f.write_text("{broken\n")
    with pytest.raises(Exception):
        readers.load_cases(spark, str(f)).collect()
    out = str(tmp_path / "out")
    sinks.create_only(spark.range(2), out)
    with pytest.raises(Exception):
        sinks.create_only(spark.range(2), out)
    assert readers.read_request(spark, '{"state": "s", "questions": {"q": {"type": "boolean"}}, "x": 1}').first()["temperature"] == 1.0


@pytest.mark.parametrize("block", [8192, 4])
def test_near_duplicates_lose_no_link(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(intervals, "BLOCK", block)

    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(vocab) for _ in range(60)] for _ in range(12)]
    rows = [(None, None)]
    for b in base:
        for _ in range(5):
            x = list(b)
            if rnd.random() < 0.7:
                x[rnd.randrange(60)] = "changed" + str(rnd.randrange(9))
            rows.append((0, " ".join(x)))
    rows += [(0, ""), (0, None), (0, "a b")]
    rows = [(i + 1, t) for i, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: (r["keep"], r["links"]) for r in prepare.near_duplicates(df, "id", "text").collect()}
    sh = {}
    for i, t in rows:
        w = (t or "").split()
        sh[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    par = {i: i for i, _ in rows}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    texts = {}
    for i, t in rows:
        texts.setdefault(t, i)
    links = dict.fromkeys(sh, 0)
    for i, a in rows:
        for j, b in rows:
            if i < j and sh[i] and sh[j] and len(sh[i] & sh[j]) / len(sh[i] | sh[j]) >= prepare.JACCARD:
                x, y = find(i), find(j)
                par[max(x, y)] = min(x, y)
                if a != b and texts[a] == i and texts[b] == j:
                    links[i] += 1
                    links[j] += 1
    for i, t in rows:
        assert got[i][0] == find(i)
        if sh[i]:
            assert got[i][1] == links[texts[t]]


def test_near_duplicates_of_nothing(spark):
    assert prepare.near_duplicates(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


@pytest.mark.parametrize("chars", [1_000_000, 300])
def test_contamination_against_brute_force(spark, monkeypatch, chars):
    import random

    monkeypatch.setattr(prepare, "EVAL_CHARS", chars)

    rnd = random.Random(2)
    w = lambda n: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rnd.randrange(30)) for _ in range(n))
    evals = [(f"e{i}", w(rnd.choice([3, 6, 20]))) for i in range(25)] + [("e_short", "internationalisation")]
    cases = [(i, w(25)) for i in range(20)] + [(100 + i, f"{w(4)} {evals[i][1]} {w(4)}") for i in range(20)] + [(200, evals[3][1][3:]), (201, "xinternationalisationx"), (202, ""), (203, None)]
    got = {tuple(r) for r in prepare.contaminated(spark.createDataFrame(cases, "id long, state string"), spark.createDataFrame(evals, "eval_id string, state string")).collect()}
    sh = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} or {tuple(t.split())}
    want = set()
    for i, c in cases:
        c = (c or "").lower()
        if len(c) < 15:
            continue
        for j, e in evals:
            if len(c) >= 60:
                a, b = sh(c), sh(e)
                hit = len(a & b) / len(a | b) >= 0.5 or (len(e) >= 30 and e in c) or c in e
            else:
                hit = c in e or (len(e) >= 15 and e in c)
            if hit:
                want.add((i, j))
    assert got == want


def test_splits_hold_groups(spark, small):
    from verdigris.plans import prepare as plans

    rows = plans._split_rows(spark, small).withColumn("stratum", F.split_part("stratum", F.lit("|"), F.lit(2)))
    s = prepare.stratified_splits(rows)
    r = prepare.preflight(rows.select("group_key").join(s, "group_key")).first()
    assert r["torn_groups"] == 0 and r["dev"] >= 1 and r["holdout"] >= 1
    again = {tuple(x) for x in prepare.stratified_splits(rows.repartition(3)).collect()}
    assert again == {tuple(x) for x in s.collect()}


# ---- hot groups ----


@pytest.mark.parametrize("few", [True, False])
def test_numbers_within_hot_groups(spark, monkeypatch, few):
    """Range by range or in one window: the same numbers, null groups included."""
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", (i * 37) % 101, i) for i in range(400)]
    monkeypatch.setattr(joins, "is_few", lambda d, limit=0: few)
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(3)
    got = {(r["g"], r["id"]): r["rank"] for r in joins.numbered(df, ["g"], ["v", "id"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        want |= {(g, i): k + 1 for k, (_, _, i) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: x[1:]))}
    assert got == want
    lat = {r["g"]: (r["n"], r["p50"], r["p95"]) for r in metrics.latency(df, ["g"], "v").collect()}
    for g in {r[0] for r in rows}:
        v = sorted(x[1] for x in rows if x[0] == g)
        assert lat[g] == (len(v), v[len(v) // 2], v[min(len(v) - 1, int(len(v) * 0.95))])
    assert joins.numbered(df.limit(0), ["g"], ["v"]).count() == 0


# ---- drift ----


def raw(spark, rows):
    return spark.createDataFrame(rows, "raw_no long, feed string, file_name string, written_at timestamp, line_no int, payload string")


def test_drift_cases(spark):
    import datetime as dt

    t = lambda k: dt.datetime(2025, 1, k)
    files = [
        ("f", "z.jsonl", 1, ['{"id": "a", "lic": "mit", "n": 1, "gone": [1]}', "{broken", '{"id": null}', None, "[1]"]),
        ("f", "y.jsonl", 2, ['{"id": "b", "license": "mit", "n": "1", "soft": {"p": 0.5}}']),
        ("f", "x.jsonl", 3, ['{"id": "b", "license": "mit", "n": "1", "soft": {"q": 0.5, "r": null}}', '{"id": "b", "license": "mit", "n": "1", "soft": {"q": 0.5}}']),
        ("g", "y.jsonl", 2, ['{"other": 1}']),
        ("f", "late.jsonl", 1, ["not json"]),
    ]
    rows = [(i * 10 + j, f, n, t(k), j, p) for i, (f, n, k, ps) in enumerate(files) for j, p in enumerate(ps)]
    got = {(r["file_name"], r["change_kind"], r["old_field"], r["new_field"]) for r in drift.drift_report(raw(spark, rows + rows[:1])).collect()}
    assert got == {
        ("z.jsonl", "added", "", "id"), ("z.jsonl", "added", "", "lic"), ("z.jsonl", "added", "", "n"), ("z.jsonl", "added", "", "gone"),
        ("y.jsonl", "retyped", "n", "n"), ("y.jsonl", "renamed", "lic", "license"), ("y.jsonl", "removed", "gone", ""), ("y.jsonl", "added", "", "soft"), ("y.jsonl", "added", "", "soft.p"),
        ("x.jsonl", "renamed", "soft.p", "soft.q")}
    assert drift.drift_report(raw(spark, [])).count() == 0


def day(k):
    import datetime as dt

    return dt.datetime(2025, 1, k)


def unite(spark, feeds):
    """The table's rows by id, of feeds given as lists of files, each a list of lines."""
    rows = [(1000 * i + 10 * f + j, feed, f"f{f}", day(f + 1), j, p if isinstance(p, str) else json.dumps(p)) for i, (feed, files) in enumerate(feeds.items()) for f, ps in enumerate(files) for j, p in enumerate(ps)]
    return {x["id"]: x for x in drift.consistent_table(raw(spark, rows)).collect()}


def test_consistent_table(spark):
    rows = [(1, "f", "a", day(1), 1, '{"id": "1", "lic": "mit", "soft": {"p_yes": 0.25}}'), (2, "f", "b", day(2), 1, '{"id": "2", "license": "x", "soft": {"yes": "0.5"}, "k": 1}'), (3, "f", "b", day(2), 2, "oops"), (4, None, None, None, None, '{"id": "4", "lic": "y"}'), (5, None, None, None, None, None)]
    t = {x["raw_no"]: x for x in drift.consistent_table(raw(spark, rows)).collect()}
    assert len(t) == 5 and not t[3]["readable"] and not t[5]["readable"] and t[1]["soft_labels"] == {"no": 0.75, "yes": 0.25} and t[2]["soft_labels"] == {"no": 0.5, "yes": 0.5}
    assert [t[i]["license"] for i in (1, 2, 4)] == ["mit", "x", "y"] and t[1]["extra"] is None and json.loads(t[2]["extra"]) == {"k": 1}
    assert drift.consistent_table(raw(spark, [])).count() == 0


def test_first_name_comes_back(spark):
    text = "a text of a length that no short name or label ever has in these files"
    t = unite(spark, {"f": [[{"id": "1", "state": text}], [{"id": "2", "body": text}], [{"id": "3", "body": text, "state": "new " + text}]]})
    assert t["1"]["state"] == t["2"]["state"] == t["3"]["state"] == text and json.loads(t["3"]["extra"]) == {"state_": "new " + text}


def test_feeds_agree_on_names(spark):
    full = lambda i, **k: {"id": i, "state": "a text of a length that no short name or label ever has", "question": {"type": "boolean"}, "expect": {"boolean": True}, **k}
    t = unite(spark, {"f": [[full("1", source="a/b", license="mit")]], "g": [[full("2", origin="a/b", licence="mit", mark="red"), full("3", origin="a/c", licence="mit")]]})
    assert t["2"]["source"] == t["1"]["source"] == "a/b" and t["2"]["license"] == "mit" and json.loads(t["2"]["extra"]) == {"mark": "red"}


def test_soft_renames_give_one_vocabulary(spark):
    t = unite(spark, {"f": [[{"id": "1", "soft": {"yes": 0.25, "no": 0.75}}], [{"id": "2", "soft": {"positive": 0.25, "no": 0.75}}]]})
    assert t["1"]["soft_labels"] == t["2"]["soft_labels"] == {"yes": 0.25, "no": 0.75} and json.loads(t["2"]["soft"]) == {"yes": 0.25, "no": 0.75}


def test_two_fields_renamed_at_once(spark):
    """By the rule neither is renamed; flooding tells them apart."""
    files = [[{"id": "1", "source": "s", "license": "mit"}], [{"id": "2", "src": "t", "licence": "x"}]]
    t = unite(spark, {"f": files})
    assert t["2"]["source"] == "t" and t["2"]["license"] == "x"
    rows = [(f, "f", f"f{f}", day(f + 1), 0, json.dumps(ps[0])) for f, ps in enumerate(files)]
    assert {(r["change_kind"], r["old_field"], r["new_field"]) for r in drift.flooded_report(raw(spark, rows)).collect()} == {("renamed", "source", "src"), ("renamed", "license", "licence")}
    assert {r["change_kind"] for r in drift.drift_report(raw(spark, rows)).collect()} == {"removed", "added"}
    assert drift.flooded_report(raw(spark, [])).count() == 0


def test_casts_lose_nothing(spark):
    t = unite(spark, {"f": [[{"id": 7, "votes": "3", "reviewed": "true", "tags": "a", "meta": '{"k": 1}', "note": False}, {"id": "8", "votes": [1], "reviewed": ["x"], "tags": ["a", 1], "meta": "none"}]]})
    assert (t["7"]["votes"], t["7"]["reviewed"], t["7"]["tags"], t["7"]["meta"], t["7"]["note"], t["7"]["extra"]) == (3.0, True, ["a"], '{"k":1}', "false", None)
    assert t["8"]["tags"] == ["a", "1"] and json.loads(t["8"]["extra"]) == {"votes": [1], "reviewed": ["x"], "meta": "none"}


def test_consistent_table_follows_soft_renames(spark):
    lines = [
        [{"id": "1", "soft": {"p_yes": 0.25}}],
        [{"id": "2", "soft": {"odds": 0.229}}, {"id": "3", "soft": {"odds": 0.229, "rater": "r1"}}],
        [{"id": "4", "soft": {"chance": 0.5, "rater": "r1", "window": {"x": 1}}}, {"id": "5", "soft": {"chance": None, "window": {"x": 1}}}],
    ]
    t = unite(spark, {"f": lines})
    assert t["2"]["soft_labels"] == t["3"]["soft_labels"] == {"no": 0.771, "yes": 0.229} and json.loads(t["3"]["soft"]) == {"p_yes": 0.229, "rater": "r1"}
    assert t["4"]["soft_labels"] == {"no": 0.5, "yes": 0.5} and json.loads(t["4"]["soft"])["p_yes"] == 0.5 and t["5"]["soft_labels"] is None


def test_soft_labels_read_the_named_field():
    assert drift.soft_labels({"option_probs": "0.585", "count_raters": 0.77, "agreement": 0.594}) is None
    assert drift.soft_labels({"agreement": [0.4, 0.6], "probs": [0.3, 0.7]}) == {"0": 0.3, "1": 0.7}
    assert drift.soft_labels({"levels": 0.4, "window": {"a": 0.5, "b": 0.5}}) is None and drift.soft_labels({"agreement": 0.6, "n": 0.4}) is None
    assert drift.soft_labels({"p": 0.25, "rater": "x"}) == drift.soft_labels({"distribution": 0.25}) == drift.soft_labels({"yes": 0.25, "n": 9}) == {"yes": 0.25, "no": 0.75}
    assert drift.soft_labels('{"a": 0.3, "b": 0.7001}') == {"a": 0.3, "b": 0.7001} and drift.soft_labels({}) is None


def test_two_fields_of_one_first_name_both_stay():
    assert drift.under_first_names({"options": 1, "probs": 2}, {"probs": "options"}) == {"options": 2, "options_": 1}
    assert drift.under_first_names({"options": 1, "probs": None}, {"probs": "options"}) == {"options": 1}


def test_flooding_selects_by_score():
    word, text, often = ("string",), ("long",), ("always",)
    old = (("licence", (word, ("short",), often)), ("note", (word, ("short",), ("sometimes",))), ("state", (word, text, often)))
    new = (("license", (word, ("short",), often)), ("body", (word, text, often)), ("votes", (("number",), (), often)))
    s = drift.flood(old, new)
    assert s[("licence", "license")] > s[("note", "license")] and s[("state", "body")] > s[("note", "body")]
    assert drift.select(old, new, s) == {"licence": "license", "state": "body"}
    # what decides is the score: with all scores equal nothing is selected
    assert drift.select(old, new, dict.fromkeys(s, 1.0)) == {}
    assert drift.flood((), new) == {} and drift.select((), new, {}) == {}


@given(st.lists(st.tuples(st.sampled_from(["a", "b", "soft", "soft.x", "soft.y", "state"]), st.sets(st.sampled_from(list(drift.BITS)), min_size=1)), unique_by=lambda x: x[0], max_size=6), st.lists(st.tuples(st.sampled_from(["a", "c", "soft", "soft.x", "soft.z", "text"]), st.sets(st.sampled_from(list(drift.BITS)), min_size=1)), unique_by=lambda x: x[0], max_size=6))
@settings(max_examples=150, deadline=None)
def test_flooding_converges_and_is_consistent(a, b):
    old, new = (tuple((k, (tuple(sorted(t)), ("short",) if "string" in t else (), ("always",))) for k, t in x) for x in (a, b))
    s = drift.flood(old, new)
    assert all(0 < v <= 1 for v in s.values())
    got = drift.select(old, new, s)
    assert len(set(got.values())) == len(got) and all(k == v for k, v in got.items() if k in dict(new))
    assert drift.flood(old, new, eps=1e-12) == pytest.approx(s, rel=1e-5)


# ---- streams ----


def test_stream_equals_batch(spark, small, tmp_path):
    from verdigris.plans import prepare as plans

    src = tmp_path / "in"
    e = spark.read.parquet(small + "/events.parquet").filter("props is not null").select("event_id", F.col("props").alias("state")).limit(200)
    e.repartition(3).write.json(str(src))
    s = spark.readStream.schema("event_id long, state string").json(str(src))
    q = plans.stm_decide(s, plans._questions(spark)).writeStream.format("memory").queryName("got").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in plans.stm_decide(spark.read.schema("event_id long, state string").json(str(src)), plans._questions(spark)).collect()}
    assert {tuple(r) for r in spark.sql("select * from got").collect()} == want and len(want) == 400


def test_stream_memo(spark, tmp_path):
    from verdigris.operators.logits import HashLogits
    from verdigris.plans import prepare as plans
    from verdigris.streaming import stream

    src, memo, out = (str(tmp_path / x) for x in ("in", "memo", "out"))
    for k in range(4):
        spark.createDataFrame([(k, "same" if k < 2 else "other"), (10 + k, "s" + str(k))], "event_id long, state string").coalesce(1).write.mode("append").json(src)
        s = spark.readStream.schema("event_id long, state string").json(src)
        stream.decide_with_memo(s, plans._questions(spark), HashLogits(), memo, out, str(tmp_path / "c"), keep=1).awaitTermination(120)
    assert spark.read.parquet(out).count() == 16
    # the last batch and the one before it: what only older ones used is forgotten
    held = spark.read.parquet(memo)
    assert {r["batch"] for r in held.select("batch").distinct().collect()} == {2, 3} and held.select("key").distinct().count() == 6



def serve(handler):
    """A local HTTP server; answers of handler(path, body) are JSON, an int is an error code."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            out = handler(self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            if isinstance(out, int):
                self.send_error(out)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def test_evaluation_by_url(spark):
    from verdigris.operators import remote

    seen = []

    def answer(path, body):
        seen.append(body)
        if len(seen) == 1:
            return 503  # is asked again
        yes = "late" in json.dumps(body["state"])
        return {"answers": {"q": {"status": "decided", "confidence": 0.8, "boolean": yes, "choice": "yes" if yes else "no", "probabilities": {"yes": 0.9 if yes else 0.1, "no": 0.1 if yes else 0.9}}}} if path == "/decide" else 404

    server = serve(answer)
    q = '{"type": "boolean", "instructions": "Is it late?"}'
    rows = [("a", "it came late", q, '{"boolean": true}', False), ("b", '{"text": "on time"}', q, '{"boolean": true}', None), ("c", "late too", q, '{"status": "abstained"}', True)]
    cases = spark.createDataFrame(rows, "case_id string, state string, question string, expect string, requires_abstain boolean").coalesce(1)
    url = f"http://127.0.0.1:{server.server_port}/decide"
    rep, cons = remote.evaluate_url(cases, url, no_abstain=True)
    got = {r["case_id"]: (r["ok"], r["answer"]) for r in rep.collect()}
    assert got == {"a": (True, "yes"), "b": (False, "no"), "c": (None, "skipped")}
    assert {"base", "all"} & {r["kind"] for r in cons.collect()} == {"all"} and cons.filter("kind = 'all'").first()["n"] == 4
    assert any(b["state"] == {"text": "on time"} for b in seen) and all(b["layout"] == "auto" and b["mode"] == "shared" for b in seen)
    with pytest.raises(Exception, match="404"):
        remote.decide_url(spark.createDataFrame([("a", "s", q, "auto", "probes")], "req_id string, state string, question string, layout string, expand string"), url + "/elsewhere").collect()
    server.shutdown()


def test_prefix_groups(spark):
    from verdigris.operators import remote

    rows = [("r", t) for t in ("state one question b", "state one question a", "state two", "other", "")] + [("s", "state one question a")]
    got = {(r["g"], r["prompt"]): (r["place"], r["shared"], r["run"]) for r in remote.prefix_groups(spark.createDataFrame(rows, "g string, prompt string"), ["g"], least=8).collect()}
    assert got == {("r", ""): (1, 0, 1), ("r", "other"): (2, 0, 2), ("r", "state one question a"): (3, 0, 3), ("r", "state one question b"): (4, 19, 3), ("r", "state two"): (5, 6, 4), ("s", "state one question a"): (1, 0, 1)}


def test_sql_registration(spark):
    from verdigris.functions.register import register

    register(spark)
    assert spark.sql("select terms('parseJSON now') t").first()["t"] == ["pars", "json", "parsejson", "now"]
    r = spark.sql("select c.symbol from values ('a.rs', 'fn one() {}') f(path, text), lateral split_chunks(f.path, f.text) c").first()
    assert r["symbol"] == "one"


def test_http_logits(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from verdigris.operators.logits import HttpLogits

    class Handler(BaseHTTPRequestHandler):
        failed = 0

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if len(body["prompts"]) > 2:  # too large for this server
                self.send_error(503)
                return
            out = json.dumps({"logits": [[float(len(p))] * n for p, n in zip(body["prompts"], body["slots"])]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    units = spark.createDataFrame([("a" * i, [1] * 2) for i in range(1, 8)], "prompt string, slots array<int>").coalesce(1)
    got = {r["prompt"]: r["logits"] for r in HttpLogits(f"http://127.0.0.1:{server.server_port}/").attach(units).collect()}
    server.shutdown()
    assert got == {"a" * i: [float(i)] * 2 for i in range(1, 8)}
