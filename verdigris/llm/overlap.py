"""Problem 5: the same or nearly the same records in evaluation splits and in the training split.

Method: a suffix array over the texts of both sides, partitioned by what the suffixes begin with. A suffix carries the
hashes of its first 3, 6, 12 and 24 words (prefix doubling). Within a partition suffixes are sorted by them, so those
with a long common prefix are adjacent, and the suffixes with one common prefix form one interval of the array.

* `cross_split_pairs` reads the pairs of the intervals. The suffixes it sorts are a sparse choice that loses no pair: if
  at most k = n/8 of n words differ, at most 3k of the n - 2 three-word beginnings do, so with any order of beginnings
  common to both sides the two records agree in one of their 3k + 1 first ones. Ordering by rarity makes those rare, and
  boilerplate never starts an interval unless a record consists of it. An exact word edit distance decides.
* `record_coverage` sorts all suffixes, takes for each one of an evaluation record its nearest training neighbours in the
  array, and merges the common prefixes into the share of the record that also stands in training records.

The rarity is read from a table of a fixed number of counters. It also says into how many blocks a hot interval must be
cut: its training suffixes are dealt to the rows and its evaluation suffixes to the columns of a square of blocks, so
that every pair meets in exactly one task of bounded size.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.leakage import WORD
from verdigris.operators import intervals
from verdigris.operators.intervals import COUNTERS, Columns, counted, pairs_in_intervals, scanned
from verdigris.operators.joins import checked_join, salted_join
from verdigris.session import stored

Q = 3  # words that begin an interval
ONE_IN = 8  # one word in so many may differ
#: Words of a common prefix that make a shared span.
SPAN = 6
LEVELS = (3, 6, 12, 24)
BASE = np.uint64(0x9E3779B97F4A7C15)


def _flat(v: object, out: list[str]) -> None:
    if isinstance(v, str):
        out.append(v)
    elif isinstance(v, dict):
        for k in sorted(v):
            _flat(v[k], out)
    elif isinstance(v, list):
        for x in v:
            _flat(x, out)


def state_words(state: str | None) -> list[str]:
    """Words of the text and number values of a state; keys, true, false and null don't count, and the order of keys
    doesn't matter. What is no JSON is one text."""
    if state is None:
        return []
    try:
        v = json.loads(state, parse_float=str, parse_int=str, parse_constant=str)
    except (ValueError, RecursionError):
        v = state
    out: list[str] = []
    _flat(v, out)
    return WORD.findall(" ".join(out).lower())


def _alike(x: object) -> str:
    return "".join(WORD.findall(x.lower() if isinstance(x, str) else json.dumps(x).lower()))


def question_key(question: str | None) -> str | None:
    """Equal for questions with the same type, range, options in any order, and instructions that are alike but for
    letter case, punctuation and spaces. A question that is no JSON object is its own text."""
    if question is None:
        return None
    try:
        q = json.loads(question)
    except (ValueError, RecursionError):
        q = None
    if not isinstance(q, dict):
        return _alike(question)
    c = q.get("criteria")
    options = sorted(f"{_alike(k)}={_alike(v)}" for k, v in c.items()) if isinstance(c, dict) else sorted(map(_alike, c)) if isinstance(c, list) else []
    bounds = [float(q[k]) if isinstance(q.get(k), (int, float)) else None for k in ("min", "max")]
    return json.dumps([_alike(q.get("type") or ""), bounds, options, _alike(q.get("instructions") or "")])


def _digest(*parts: str) -> bytes:
    return hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def normalised(df: DataFrame, train: str = "train") -> DataFrame:
    """record_no, source, split, side (true: training), text_key, question (digest), words (joined by spaces) of the
    rows with split, state and question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            qs, texts = [], []
            memo: dict[str, bytes] = {}
            for q, s in zip(b.column("question").to_pylist(), b.column("state").to_pylist()):
                k = memo.get(q)
                if k is None:
                    k = memo[q] = _digest(question_key(q) or "")
                qs.append(k)
                texts.append(" ".join(state_words(s)))
            keys = [_digest(k.hex(), t) for k, t in zip(qs, texts)]
            yield pa.RecordBatch.from_arrays([b.column("record_no"), b.column("source"), b.column("split"), pa.array(keys, pa.binary()), pa.array(qs, pa.binary()), pa.array(texts, pa.string())], names=["record_no", "source", "split", "text_key", "question", "words"])

    rows = df.filter("split is not null and state is not null and question is not null").select("record_no", "source", F.lower(F.trim("split")).alias("split"), "state", "question")
    return rows.mapInArrow(run, "record_no long, source string, split string, text_key binary, question binary, words string").withColumn("side", F.col("split") == train)


_memo: dict[str, int] = {}


def hash_word(w: str) -> int:
    h = _memo.get(w)
    if h is None:
        if len(_memo) > 1_000_000:
            _memo.clear()
        h = _memo[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return h


def suffixes(questions: list[bytes], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, words of the row, hashes, parities of the row) of the suffixes of three or more words of all texts, row by
    row. The parities are 64 bits, each saying whether the words that hash to it are odd in number.

    The hashes are of the first 3, 6, 12 and 24 words, by doubling: that of 2m words is that of two hashes of m words, m
    apart; where a text ends earlier it is of what is there. The text's question goes into all of them, so suffixes of
    different questions never meet. The n-th repetition of a beginning within a text gets a hash of its own, so the
    beginnings of a text are a set. All texts are handled at once.
    """
    split = [t.split(" ") if t else [] for t in texts]
    lens = np.fromiter(map(len, split), np.int64, len(split))
    code = np.fromiter((hash_word(w) for ws in split for w in ws), np.uint64, int(lens.sum()))
    seed = np.array([int.from_bytes(q[:8], "little") for q in questions], np.uint64)
    count = np.maximum(lens - Q + 1, 0)
    row = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(count) - count
    pos = np.arange(len(row)) - first[row]
    at = (np.cumsum(lens) - lens)[row] + pos
    h = seed[row]
    for i in range(Q):
        h = (h ^ code[at + i]) * BASE
        h ^= h >> np.uint64(29)
    out, begin = [h], h
    for m in LEVELS[:-1]:
        inside = pos + m < count[row]
        nxt = np.zeros(len(h), np.uint64)
        nxt[inside] = h[np.flatnonzero(inside) + m]
        h = (h * BASE) ^ nxt
        h = (h ^ (h >> np.uint64(31))) * BASE
        out.append(h)
    order = np.lexsort((pos, begin, row))
    r, b = row[order], begin[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (b[1:] != b[:-1]))) if len(r) else np.empty(0, bool)
    nth = np.arange(len(r)) - np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    out[0] = begin.copy()
    out[0][order] = b + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    odd = np.zeros(len(texts), np.uint64)
    full = lens > 0
    if full.any():
        odd[full] = np.bitwise_xor.reduceat(np.uint64(1) << (code >> np.uint64(58)), (np.cumsum(lens) - lens)[full])
    return row, pos, lens, np.stack(out, 1) if len(row) else np.empty((0, len(LEVELS)), np.uint64), odd


def _of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row, pos, lens, h, odd = suffixes(b.column("question").to_pylist(), b.column("words").to_pylist())
    return row, pos, lens, h, odd, (h[:, 0] % np.uint64(COUNTERS)).astype(np.int64)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 2000):
            yield b.slice(i, 2000)


def rarity(classes: DataFrame) -> np.ndarray:
    """How many texts hold a beginning, by slots of a table of fixed size."""
    return counted(classes.select("question", "words"), lambda b: (x for part in _parts([b]) for x in [_of(part)[3][:, 0]]))


def sparse_suffixes(classes: DataFrame, counts: np.ndarray) -> DataFrame:
    """cls, side (true: training), h3, h6, h12, n, odd, parts of the 3k+1 rarest suffixes of (cls, question, words,
    in_train, in_eval), a class on both sides standing on each; parts: blocks a side of the suffix's interval is cut into."""
    shared = classes.sparkSession.sparkContext.broadcast(counts)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for b in _parts(batches):
            row, _, lens, h, odd, slot = _of(b)
            order = np.lexsort((h[:, 0], seen[slot], row))
            # k: words that may differ from the longest text a row can pair with; without any, only equal texts match,
            # which are one class already
            k = (ONE_IN * lens // (ONE_IN - 1)) // ONE_IN
            want = np.where(k > 0, Q * k + 1, 0)
            start = np.searchsorted(row, np.arange(len(lens)))
            order = order[np.arange(len(row)) - start[row] < want[row]]
            train, test = (b.column(c).to_numpy(zero_copy_only=False)[row[order]] for c in ("in_train", "in_eval"))
            side = np.concatenate((np.ones(int(train.sum()), bool), np.zeros(int(test.sum()), bool)))
            order = np.concatenate((order[train], order[test]))
            g, r = h[order].view(np.int64), row[order]
            levels = [pa.array(np.ascontiguousarray(g[:, 0])), *(pa.array(g[:, i].astype(np.int32)) for i in (1, 2))]
            parts = intervals.blocks_of(seen[slot[order]])
            yield pa.RecordBatch.from_arrays([b.column("cls").take(pa.array(r)), pa.array(side), *levels, pa.array(lens[r].astype(np.int32)), pa.array(odd[r].view(np.int64)), pa.array(parts)], names=["cls", "side", "h3", "h6", "h12", "n", "odd", "parts"])

    return classes.select("cls", "in_train", "in_eval", "question", "words").mapInArrow(keep, "cls long, side boolean, h3 long, h6 int, h12 int, n int, odd long, parts int")


def all_suffixes(classes: DataFrame) -> DataFrame:
    """cls, train_no, in_eval, h6, h12, h24, pos of every suffix of at least SPAN words. The last bit of h12 and h24 says
    whether the text has that many words left."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            row, pos, lens, h, _, _ = _of(b)
            at = np.flatnonzero(pos + SPAN <= lens[row])
            g, r = h[at].view(np.int64), row[at]
            cols = [b.column(x).take(pa.array(r)) for x in ("cls", "train_no", "in_eval")]
            cols += [pa.array(np.ascontiguousarray(g[:, 1])), *(pa.array(g[:, i].astype(np.int32) & ~1 | (pos[at] + LEVELS[i] <= lens[r])) for i in (2, 3)), pa.array(pos[at].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["cls", "train_no", "in_eval", "h6", "h12", "h24", "pos"])

    return classes.select("cls", "train_no", "in_eval", "question", "words").mapInArrow(every, "cls long, train_no long, in_eval boolean, h6 long, h12 int, h24 int, pos int")


def interval_pairs(suffixes: DataFrame) -> DataFrame:
    """(t_cls, e_cls) of the training and evaluation suffixes that lie in one interval of the array and whose texts' lengths
    and parities of words allow a match, each pair once."""

    def fit(x: Columns, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        na, nb = x["n"][a], x["n"][b]
        k = np.maximum(na, nb) // ONE_IN
        # a word added or missing turns one parity, a replaced one two
        return (x["id"][a] != x["id"][b]) & (np.abs(na - nb) <= k) & (np.bitwise_count(x["odd"][a].view(np.uint64) ^ x["odd"][b].view(np.uint64)) <= 2 * k)

    return pairs_in_intervals(suffixes.withColumnRenamed("cls", "id"), "h3", ["h6", "h12"], fit).toDF("t_cls", "e_cls")


def word_distance(a: list[str], b: list[str], most: int) -> int:
    """Words added, missing or replaced between a and b, or most + 1 if that is more than `most`.

    Bit-parallel dynamic programming: a column of the table is two integers of len(a) bits that say where it rises and
    falls, so a word of b costs a few operations on whole integers."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i = 0
    while i < min(len(a), len(b)) and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rise, fall, score = full, 0, len(a)
    for j, w in enumerate(b, 1):
        eq = where.get(w, 0)
        diagonal = ((((eq & rise) + rise) ^ rise) | eq | fall) & full
        up = fall | (full & ~(diagonal | rise))
        down = rise & diagonal
        score += bool(up & last) - bool(down & last)
        if score - (len(b) - j) > most:
            return most + 1
        up, down = (up << 1 | 1) & full, (down << 1) & full
        rise = down | (full & ~(diagonal | up))
        fall = up & diagonal
    return min(score, most + 1)


def near_classes(classes: DataFrame) -> DataFrame:
    """(t_cls, e_cls, distance): pairs of different classes, one with training and the other with evaluation records, of
    the same question, whose words differ in at most one of ONE_IN of the longer text."""
    suffixes = sparse_suffixes(classes, rarity(classes))
    cand = stored(interval_pairs(suffixes), "candidates")
    # only the texts of candidates are moved, and to several places where one has many partners
    named = stored(cand.select(F.col("t_cls").alias("cls")).union(cand.select("e_cls")).distinct(), "compared")
    text = stored(checked_join(classes.select("cls", "words"), named, ["cls"], "left_semi"), "texts")
    both = salted_join(cand, text.toDF("t_cls", "t_words"), "t_cls", F.col("e_cls"), salts=4)
    both = salted_join(both, text.toDF("e_cls", "e_words"), "e_cls", F.col("t_cls"), salts=4)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dist = []
            for x, y in zip(b.column("t_words").to_pylist(), b.column("e_words").to_pylist()):
                x, y = x.split(" "), y.split(" ")
                most = max(len(x), len(y)) // ONE_IN
                d = word_distance(x, y, most)
                dist.append(d if d <= most else -1)
            yield pa.RecordBatch.from_arrays([b.column("t_cls"), b.column("e_cls"), pa.array(dist, pa.int32())], names=["t_cls", "e_cls", "distance"])

    return both.select("t_cls", "e_cls", "t_words", "e_words").mapInArrow(compare, "t_cls long, e_cls long, distance int").filter("distance >= 0")


def text_classes(rows: DataFrame) -> DataFrame:
    """cls (smallest record_no), train_no (that of training records), text_key, in_train, in_eval, question, words: rows of `normalised` alike in question and
    words are one class."""
    return rows.groupBy("text_key").agg(F.min("record_no").alias("cls"), F.min(F.when(F.col("side"), F.col("record_no"))).alias("train_no"), F.max("side").alias("in_train"), F.max(~F.col("side")).alias("in_eval"), F.first("question").alias("question"), F.first("words").alias("words"))


def members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """record_no, source, split, side, cls of every row."""
    return salted_join(rows.select("record_no", "source", "split", "side", "text_key"), classes.select("text_key", "cls"), "text_key", F.col("record_no")).drop("text_key")


def cross_split_pairs(df: DataFrame, train: str = "train") -> DataFrame:
    """record_lo, record_hi, split, source, distance, eval_no: pairs of records, one in the training split and one in
    another (whose number, split and source are given), with the same question and the same or nearly the same state.

    Records with null split, state or question are no cases, null sources stay null. Records alike in question and
    words are one class (states without words are alike); classes are compared, and only what is found is expanded to
    records. Repeated deliveries are records of their own. An empty table gives an empty table; other columns are
    ignored.
    """
    rows = stored(normalised(df, train), "normalised")
    classes = stored(text_classes(rows), "classes")
    same = classes.filter("in_train and in_eval").select(F.col("cls").alias("t_cls"), F.col("cls").alias("e_cls"), F.lit(0).alias("distance"))
    links = stored(same.unionByName(near_classes(classes)), "links")
    member = stored(members(rows, classes), "member")
    t = member.filter("side").select(F.col("cls").alias("t_cls"), F.col("record_no").alias("t_no"))
    e = member.filter("not side").select(F.col("cls").alias("e_cls"), F.col("record_no").alias("e_no"), "split", "source")
    e = checked_join(e, stored(links.select("e_cls").distinct(), "found"), ["e_cls"], "left_semi")
    out = salted_join(salted_join(t, links, "t_cls", F.col("t_no")), e, "e_cls", F.col("t_no"))
    return out.select(F.least("t_no", "e_no").alias("record_lo"), F.greatest("t_no", "e_no").alias("record_hi"), "split", "source", "distance", F.col("e_no").alias("eval_no"))


def nearest_spans(suffixes: DataFrame) -> DataFrame:
    """h6, h12, h24, length, partner: of the suffixes of evaluation classes those whose nearest training neighbour in the
    sorted array shares a prefix of SPAN words or more; how many words by level, and the neighbour's
    training record.

    Equal suffixes are one before they are moved, so boilerplate is no hot interval; its remaining continuations are dealt
    to several blocks where an interval has more than intervals.BLOCK of them."""
    level = ["h6", "h12", "h24"]
    keys = suffixes.groupBy(*level).agg(F.min("train_no").alias("partner"), F.max("in_eval").alias("wanted"))
    keys = stored(keys, "suffix-keys")
    hot = stored(keys.groupBy("h6").agg(F.count("*").alias("k")).filter(F.col("k") > intervals.BLOCK).select("h6", F.ceil(F.col("k") / intervals.BLOCK).cast("int").alias("parts")), "hot")
    keys = checked_join(keys, hot, ["h6"], "left")
    at = F.pmod(F.xxhash64("h12", "h24"), F.coalesce("parts", F.lit(1))).cast("int")
    # an evaluation suffix goes to one block, a training suffix to all
    block = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("partner").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(at))
    array = keys.withColumn("at", at).withColumn("block", F.explode(block)).drop("parts").repartition("h6", "block").sortWithinPartitions("h6", "block", "h12", "h24")
    array = array.select(*level, "block", F.coalesce("partner", F.lit(-1)).alias("partner"), F.col("partner").isNotNull().alias("train"), (F.col("wanted") & (F.col("at") == F.col("block"))).alias("wanted"))

    def read(x: Columns, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(x["h6"])
        i = np.flatnonzero(x["wanted"])
        first = starts[np.searchsorted(starts, i, "right") - 1]
        last = np.append(starts[1:], n)[np.searchsorted(starts, i, "right") - 1]
        above = np.maximum.accumulate(np.where(x["train"], np.arange(n), -1))[i]
        below = np.minimum.accumulate(np.where(x["train"], np.arange(n), n)[::-1])[::-1][i]

        def common(j: np.ndarray, ok: np.ndarray) -> np.ndarray:
            j = np.where(ok, j, 0)
            same12, same24 = ((x[c][i] == x[c][j]) & (x[c][i] & 1 == 1) for c in ("h12", "h24"))
            return np.where(ok, np.where(same12 & same24, LEVELS[3], np.where(same12, LEVELS[2], LEVELS[1])), 0)

        up, down = common(above, above >= first), common(below, below < last)
        got = np.maximum(up, down)
        j = np.where(up >= down, above, below)
        hit = got > 0
        i, j, got = i[hit], j[hit], got[hit]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[c][i]) for c in level), pa.array(got.astype(np.int32)), pa.array(x["partner"][j])], names=[*level, "length", "partner"])

    return scanned(array, ["h6", "block"], read, "h6 long, h12 int, h24 int, length int, partner long")


def record_coverage(df: DataFrame, train: str = "train") -> DataFrame:
    """record_no, split, source, words, covered, coverage, twin: of every evaluation record how many of its words lie in
    spans of SPAN words or more that also stand in a training record with the same question, and a training record that
    shares the longest one (null if none does).

    Records with null split, state or question are no cases; records without words are covered by nothing; repeated
    deliveries are records of their own; an empty table gives an empty table; other columns are ignored.
    """
    rows = stored(normalised(df, train), "normalised")
    classes = stored(text_classes(rows), "classes")
    suffixes = stored(all_suffixes(classes), "suffix-array")
    level = ["h6", "h12", "h24"]
    key = lambda d: d.withColumn("_key", F.struct(*level)).drop(*level)
    found = key(stored(nearest_spans(suffixes), "spans"))
    spans = salted_join(key(suffixes.filter("in_eval").select("cls", "pos", *level)), found, "_key", F.col("cls"), salts=4)
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    reach = lambda s, x: F.greatest(s["end"], x["at"] + x["len"])
    merged = lambda a: F.aggregate(a, start, lambda s, x: F.struct(reach(s, x).alias("end"), (s["sum"] + reach(s, x) - F.greatest(s["end"], F.least(x["at"], reach(s, x)))).alias("sum")))["sum"]
    per = spans.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("at"), F.col("length").alias("len")))).alias("spans"), F.max(F.struct("length", (-F.col("partner")).alias("p"))).alias("best"))
    per = per.select("cls", merged("spans").alias("covered"), (-F.col("best.p")).alias("twin"))
    sized = classes.filter("in_eval").select("cls", F.when(F.col("words") == "", 0).otherwise(F.size(F.split("words", " "))).alias("words"))
    sized = stored(sized.join(per, "cls", "left").select("cls", "words", F.coalesce("covered", F.lit(0)).alias("covered"), "twin"), "coverage")
    out = salted_join(members(rows.filter("not side"), classes), sized, "cls", F.col("record_no"))
    return out.select("record_no", "split", "source", "words", "covered", F.when(F.col("words") > 0, F.col("covered") / F.col("words")).otherwise(0.0).alias("coverage"), "twin")


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Per split and source of the evaluation records: overlapping pairs, records with a twin, exact pairs, and the largest
    distance. Pairs are first counted per record, so that one record or source with most pairs is spread."""
    per = pairs.groupBy("split", "source", "eval_no").agg(F.count("*").alias("pairs"), F.sum((F.col("distance") == 0).cast("int")).alias("exact"), F.max("distance").alias("far"))
    return per.groupBy("split", "source").agg(F.sum("pairs").alias("pairs"), F.count("*").alias("records_with_twin"), F.sum("exact").alias("exact_pairs"), F.sum((F.col("exact") > 0).cast("int")).alias("records_with_exact_twin"), F.max("far").alias("largest_distance"))
