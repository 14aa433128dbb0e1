"""Top-k search, collocations and the filter audit against brute force, on awkward and hot data."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest

from wattweave.llm import collocations, filter_audit, topk_search
from wattweave.llm.collocations import Tokens

VECTORS = "vec_id long, embedding array<float>, label int, row string, score string, query string, dims int"


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_top(rows, k, every):
    """(query_id, rank, vec_id, score) by comparing each query with every other row."""
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, qv) in enumerate(whole):
        if q is None or q % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i is None, i or 0) for m, (i, v) in enumerate(whole) if m != n and len(v) == len(qv))
        out += [(q, r, None if null else i, -s) for r, (s, null, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def vector_rows(seed=2, n=600):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(n)]
    hot = [float(x) for x in rng.normal(size=8)]
    rows += [(1_000 + i, hot) for i in range(300)]
    rows += [(50, rows[3][1]), (50, rows[3][1]), (-100, [0.0] * 8), (None, hot), (None, rows[5][1]), (2_000, None), (2_050, [1.0, None] + [0.0] * 6),
             (2_100, [float("nan")] * 8), (2_150, [float("inf")] * 8), (2_200, [1.0, 2.0]), (2_201, [3.0, -4.0]), (2_250, []), (2_300, [])]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    rows = vector_rows()
    return rows, spark.createDataFrame([(i, v, 0, "r", "s", "q", 1) for i, v in rows], VECTORS).repartition(5)


@pytest.mark.parametrize("k", [1, 5])
def test_top_k_equals_brute_force(vectors, k):
    rows, df = vectors
    assert sorted_rows(topk_search.nearest_rows(df, k)) == brute_top(rows, k, 50)


def test_top_k_in_many_blocks_and_chunks(vectors):
    rows, df = vectors
    v = topk_search.numbered_vectors(df)
    found = topk_search.top_k(v, v.where("vec_id % 50 = 0"), 5, block_rows=100, chunk_rows=4)
    assert sorted_rows(found.select("query_id", "rank", "vec_id", "score")) == brute_top(rows, 5, 50)


def test_top_k_of_an_empty_table(spark):
    assert topk_search.nearest_rows(spark.createDataFrame([], VECTORS)).count() == 0


def test_search_stops_before_the_lists_are_read():
    """Candidates far from the query are ruled out by their bounds: few pairs are left for final scores."""
    rng = np.random.default_rng(5)
    c = np.floor(rng.normal(size=(4_096, 8)) * 256)
    c[:20] += 2_000
    q, left = np.full((1, 8), 100.0), []
    full = topk_search.resolve

    def counted(*args):
        left.append(len(args[3]))
        return full(*args)

    topk_search.resolve = counted
    try:
        _, found, score = topk_search.search_block(c, np.arange(4_096), np.arange(4_096), q, np.array([-1]), 5)
    finally:
        topk_search.resolve = full
    want = np.argsort(-(c @ q[0]), kind="stable")[:5]
    assert found.tolist() == want.tolist() and score.tolist() == (c @ q[0])[want].astype(int).tolist()
    assert left[0] <= 400


def test_scores_beyond_doubles_are_exact_and_beyond_64_bits_refused():
    c = np.array([[2.0**30 + 1, 3.0], [5.0, 7.0]])
    assert topk_search.exact_type(c, c[:1]) is np.int64
    whole = c.astype(np.int64)
    _, _, score = topk_search.search_block(whole, np.arange(2), np.arange(2), whole[:1], np.array([-1]), 1)
    assert score.tolist() == [(2**30 + 1) ** 2 + 9]
    with pytest.raises(ValueError):
        topk_search.exact_type(c * 4.0, c)


DOCS = "doc_id long, text string, lang string, source string, n long, phrase string, words string, part string, digest string, mask string, good string"


def brute_collocations(rows, least, top, longest=5):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    counts[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if often[p[i : i + m]] <= a:
                        inside.add(p[i : i + m])
        best = []
        for p, a in often.items():
            if p not in inside:
                score, k = min(((1000 * a * total[lang]) // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out, key=repr)


def phrase_rows(seed=4):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "new", "york", "city", "hall", "a\x00b", "中", "w\x85x", "x" * 300, "#", "z z"]
    out = [(None, "en"), ("", "en"), (" \t \n", None), (".,;:!?", "de"), ("one", ""), ("new york " * 3_000, "en")]
    for _ in range(400):
        body = []
        for _ in range(rng.randrange(1, 40)):
            body.append("new york city hall" if rng.random() < 0.1 else rng.choice(words))
            body.append(rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", ".", "\r\n"]))
        out.append(("".join(body), rng.choice(["en", "en", "en", "de", None, "und"])))
    return out + out[40:60]


@pytest.fixture(scope="module")
def phrases(spark):
    rows = phrase_rows()
    full = [(i, t, l, "s", 1, "p", "w", "q", "d", "m", "g") for i, (t, l) in enumerate(rows)]
    return rows, spark.createDataFrame(full, DOCS).repartition(3)


@pytest.mark.parametrize("chunk, stream", [(1 << 20, 1_000_000), (700, 7)])
def test_collocations_equal_brute_force(phrases, chunk, stream):
    rows, df = phrases
    found = collocations.collocations(df, least=6, top=60, chunk_bytes=chunk, stream_rows=stream)
    assert sorted_rows(found) == brute_collocations(rows, 6, 60)


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_infrequent_words_are_counted_but_not_stored(spark, monkeypatch):
    kept, frames = collocations.stored, {}
    monkeypatch.setattr(collocations, "stored", lambda df, name: frames.setdefault(name, kept(df, name)))
    df = spark.createDataFrame([("en", "aa aa aa bb cc dd"), ("de", "ee")], "lang string, text string")
    _, totals = collocations.frequent_phrases(df, least=3, longest=1)
    assert {tuple(r) for r in frames["words"].collect()} == {("en", "aa", 3), ("en", None, 3), ("de", None, 1)}
    assert {tuple(r) for r in totals.collect()} == {("en", 6), ("de", 1)}


def test_a_filter_that_lets_all_through_changes_nothing(phrases, monkeypatch):
    rows, df = phrases
    monkeypatch.setattr(collocations, "phrase_filter", lambda frequent, order: b"\xff" * (collocations.FILTER_BITS // 8))
    assert sorted_rows(collocations.collocations(df, least=6, top=60)) == brute_collocations(rows, 6, 60)


def test_phrases_with_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    t = Tokens(pa.array(["en", "de"]), pa.array(["a b a b a c", "a b"]))
    right = sorted(zip(*t.counts(2, np.full(collocations.FILTER_BITS // 8, 255, np.uint8)).to_pydict().values()))
    hashes = Tokens.hashes
    monkeypatch.setattr(Tokens, "hashes", lambda self, order: (np.zeros_like(hashes(self, order)[0]), hashes(self, order)[1]))
    got = sorted(zip(*t.counts(2, np.full(collocations.FILTER_BITS // 8, 255, np.uint8)).to_pydict().values()))
    assert got == right == [("de", "a b", 1), ("en", "a b", 2), ("en", "a c", 1), ("en", "b a", 2)]


def test_scores_of_great_counts_are_exact(spark):
    big = 9_000_000_000_000_000
    phrases = spark.createDataFrame([("en", "a", big, ["a"]), ("en", "b", big - 1, ["b"]), ("en", "a b", big - 7, ["a", "b"])],
                                    "lang string, phrase string, n long, words array<string>")
    totals = spark.createDataFrame([("en", big + 11)], "lang string, total long")
    row = collocations.scored_candidates(phrases, totals).first()
    assert (row.l, row.r, row.score) == (big, big - 1, 1000 * (big - 7) * (big + 11) // (big * (big - 1)))


def brute_audit(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed = []
    for i, t, lang in docs:
        text = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        first = least.get(text)
        failed.append((lang or "", i, {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                                       "D": bool(re.search(r"[#$%&*|]", text)), "E": first is not None and (i is None or i > first)}))
    out, shapley = [], collections.Counter()
    for part in {p for p, _, _ in failed}:
        own = [(i, f) for p, i, f in failed if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [d for d in left if d[1][x]], [d for d in left if not d[1][x]]
                shapley[part, x] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), sum(f[x] for _, f in own) - len(gone),
                            sum(f[x] and sum(f.values()) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
    return sorted([(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out], key=repr)


def test_audit_equals_brute_force(spark):
    rng = random.Random(8)
    long = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", "a b", long, long + " #", long.upper(), "dup " * 200, "X Y", "é É 中", "w\x1cw", long * 30, "a b"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", "en", "de", None, ""])) for _ in range(300)]
    docs += [(1_000 + i, "hot", "en") for i in range(200)] + [(7, "hot", "de")] * 3
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 40, 2), *range(0, 40, 3), 7, 1_005]] + [(None, 1, 1)]
    df = spark.createDataFrame([(i, t, l, "s", 1, "p", "w", "q", "d", "m", "g") for i, t, l in docs], DOCS).repartition(4)
    found = filter_audit.document_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted_rows(found) == brute_audit(docs, labels)


def test_audit_without_documents_or_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.document_audit(spark.createDataFrame([], DOCS), labels).count() == 0
    one = spark.createDataFrame([(1, "a b", None, "s", 1, "p", "w", "q", "d", "m", "g")], DOCS)
    assert sorted_rows(filter_audit.document_audit(one, labels)) == brute_audit([(1, "a b", None)], [])


@pytest.mark.parametrize("n", [1, 3, 4])
def test_intervals_cover_each_permutation_once(n):
    for rank, order in enumerate(itertools.permutations(range(n))):
        for mask in range(1, 1 << n):
            steps = [s for m, s, low, high in filter_audit.removal_intervals(n) if m == mask and low <= rank < high]
            assert steps == [next(i for i, f in enumerate(order, 1) if mask >> f & 1)]
