"""Periodic runs, vector search and lexical search: the methods against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from mapwright.llm import lexical_search, periodic_runs, queries, vector_search


def plain_runs(w, shortest=6, exponent=4):
    out = []
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(shortest, exponent * p):
                s = w[i : j + p]
                if not any(s[q:] == s[:-q] for q in range(1, p)):
                    out.append((i, j - i + p, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeating(rng):
    words = []
    for _ in range(rng.randint(0, 12)):
        words += [str(rng.randint(0, rng.choice([1, 2, 5]))) for _ in range(rng.randint(1, 9))] * rng.choice([1, 1, 2, 4, 5, 9])
        if rng.random() < 0.3:
            words.pop()
    return words


@pytest.mark.parametrize("shortest, exponent", [(6, 4), (1, 4), (12, 5)])
def test_runs_agree_with_every_period(shortest, exponent):
    rng = random.Random(shortest)
    found = 0
    for _ in range(400):
        docs = [repeating(rng) for _ in range(rng.randint(1, 4))]
        s = periodic_runs.analyse([[w.encode() for w in d] for d in docs], shortest, exponent)
        for k, d in enumerate(docs):
            a, b = s.run[k], s.run[k + 1]
            got = [(x - s.first[k], y, z) for x, y, z in zip(*(v[a:b].tolist() for v in s.runs), strict=True)]
            assert got == plain_runs(d, shortest, exponent)
            found += len(got)
    assert found > 300
    with pytest.raises(ValueError):
        periodic_runs.check(3)


def test_words_are_split_at_ascii_white_space_alone():
    text = " a\u00a0b\x1cc\u2003 d\x0be\tf\r\ng "
    assert [w.decode() for w in periodic_runs.split(text)] == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_run_tables(spark):
    texts = [(1, "a b c " * 5 + "z"), (2, None), (3, "x  y\n" * 4), (None, "q q q q q q r"), (1, "a b c " * 5 + "z")]
    docs = spark.createDataFrame([(d, t, d, "k") for d, t in texts], "doc_id long, text string, start long, period string")
    runs = collections.Counter((r.doc_id, r.start, r.length, r.period) for r in periodic_runs.find_runs(docs).collect())
    assert runs == {(1, 0, 15, 3): 2, (3, 0, 8, 2): 1, (None, 0, 6, 1): 1}
    cut = periodic_runs.collapse_runs(docs)
    assert cut.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in cut.collect()) == {(1, "a b c z"): 2, (2, None): 1, (3, "x y"): 1, (None, "q r"): 1}


def test_periodic_query_against_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE length(text) < 4000").fetchall()
    rows = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(rows) == 200 and sum(r.n_runs for r in rows.values()) > 5
    for d, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, h = len(w), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        best = min(((-length, s, p) for s, length, p in runs), default=None)
        assert rows[d].n_runs == len(runs)
        assert (rows[d].start, rows[d].length, rows[d].period) == ((best[1], -best[0], best[2]) if best else (None,) * 3)
        assert rows[d].exponent_milli == (1000 * -best[0] // best[2] if best else None)
        assert rows[d].runs_sha256 == hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest()
        assert rows[d].collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def exact_neighbours(rows, query, k):
    """Ids and scores by falling score, then id; the query's own row left out."""
    scored = [(-float(np.dot(np.float64(v), np.float64(query[1]))), i) for i, v in rows if not (i == query[0] and v == query[1])]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def recall(spark, rows, is_query, k=20, parts=4):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
    found = collections.defaultdict(list)
    for r in vector_search.search(table, F.col("vec_id") % is_query == 0, k).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = wanted = 0
    vectors = dict(rows)
    for q in rows:
        if q[0] % is_query == 0:
            got = sorted(found.pop(q[0]))
            assert [r for r, *_ in got] == list(range(1, min(k, len(rows) - 1) + 1))
            assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
            assert all(s == pytest.approx(np.dot(np.float64(vectors[i]), np.float64(q[1])), abs=1e-12) for _, i, s in got)
            want = {i for i, _ in exact_neighbours(rows, q, k)}
            hits, wanted = hits + len(want & {i for _, i, _ in got}), wanted + len(want)
    assert not found
    return hits / wanted


def single(x):
    return np.asarray(x, dtype=np.float32).tolist()


@pytest.mark.parametrize("kind", ["noise", "clusters", "norms"])
def test_vector_recall(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    if kind == "clusters":
        x = rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)] + 0.2 * x
    if kind == "norms":
        x *= np.exp(rng.normal(size=(3000, 1)))
    assert recall(spark, [(i, single(v)) for i, v in enumerate(x)], 20) >= 0.9


def test_small_and_equal_vectors(spark):
    """Fewer candidates than asked for, and one vector that half the rows share: the smallest ids come, ranks have no gaps."""
    rng = np.random.default_rng(4)
    few = [(i, single(v)) for i, v in enumerate(rng.normal(size=(9, 5)))]
    assert recall(spark, few, 2) == 1
    hot = single(rng.normal(size=16))
    rows = [(i, hot if i % 2 else single(v)) for i, v in enumerate(rng.normal(size=(1500, 16)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    found = vector_search.search(table, F.col("vec_id") % 5 == 0).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r.query_id].append((r.rank, r.vec_id))
    assert len(by) == 300 and all(sorted(r for r, _ in v) == list(range(1, 21)) for v in by.values())
    own = {q: [i for _, i in sorted(by[q])] for q in (5, 15, 995)}
    odd = [i for i in range(1, 60, 2)]
    above = [i for i, s in exact_neighbours([r for r in rows if r[0] % 2 == 0], (5, hot), 20) if s > np.dot(np.float64(hot), np.float64(hot))]
    for q, ids in own.items():
        assert ids[len(above) :] == [i for i in odd if i != q][: 20 - len(above)]


def test_lists_are_balanced_and_the_graph_finds_the_nearest():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4096, 12))
    sizes = [len(p) for p in vector_search.pieces(x, 50)]
    assert sum(sizes) == 4096 and max(sizes) - min(sizes) <= 8
    model = vector_search.fit(x, 4096, float(np.linalg.norm(x, axis=1).max()), 20)
    row, at, first = vector_search.assign(model, x)
    near = vector_search.distances(vector_search.lifted(x, model.longest), model.centers)
    assert (at[first] == near.argmin(axis=1)).mean() > 0.97
    assert 1.2 < len(row) / len(x) < 1.8 and np.bincount(row).max() <= vector_search.MOST_COPIES


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_ranking(docs, items, k=10):
    bags = [(d, collections.Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for place, (d, bag) in enumerate(bags):
            m = 10 + 90 * sum(bag.values()) * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if bag[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, place))
        out += [(item, r, None if none else d, -s) for r, (s, none, d, _) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_terms():
    text = "".join(map(chr, range(1, 600))) + " Ünï日本 İx_y-Z9"
    assert [t.decode() for t in lexical_search.terms_of(text)] == terms(text)


@pytest.mark.parametrize("block, rounds", [(4096, 10_000), (7, 3)])
def test_ranking(spark, monkeypatch, block, rounds):
    """Small blocks and several rounds give the same rows; copies share scores and come by id."""
    monkeypatch.setattr(lexical_search, "ROUND_ITEMS", rounds)
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(150)] + [(None, "w1 w2 W3"), (7, None), (8, "!!!")]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(40)] + [docs[4]] * 3
    items = [(i, text(rng.randint(1, 25))) for i in range(8)] + [(8, None), (9, "...")] + [(3, "w1 W1 w2"), (None, "w2")]
    rng.shuffle(docs)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n long, score string").repartition(3)
    got = lexical_search.search(d, spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int"))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(plain_ranking(docs, items))


def test_pair_bounds_skip_more_and_lose_nothing():
    """Terms that never meet: with joint maxima the bound falls, fewer postings are read, and the found documents stay."""
    rng = np.random.default_rng(8)
    n, vocabulary = 2000, 40
    words = [b"t%02d" % t for t in range(vocabulary)]
    number = {w: t for t, w in enumerate(words)}
    # A document holds terms of one parity, so neighbours in the order of weights share none.
    owner, term = np.nonzero(rng.random((n, vocabulary)) < 0.2)
    keep = owner % 2 == term % 2
    owner, term = owner[keep], term[keep]
    tf = rng.integers(1, 30, len(owner))
    df = dict(enumerate(np.bincount(term, minlength=vocabulary).tolist()))
    plan = lexical_search.make_plan([(0, words[:16])], number, df, n, 20 * n)
    block, floors = lexical_search.build(plan, pa.array(range(n)), rng.integers(5, 60, n), owner, term, tf, 10)
    slot = np.full(vocabulary, -1)
    slot[block.terms] = np.arange(len(block.terms))
    largest = np.maximum.reduceat(block.impacts, block.starts[:-1])
    everything = lexical_search.search_block(plan, block, 0, slot, largest, 1)
    tenth = np.sort(everything[1])[-10]
    assert floors[0] <= tenth
    read = {}
    for pairs in (True, False):
        item_pairs = plan.item_pairs if pairs else [np.zeros((0, 3), dtype=np.int64)]
        read[pairs] = np.zeros(2, dtype=np.int64)
        places, scores = lexical_search.search_block(plan._replace(item_pairs=item_pairs), block, 0, slot, largest, int(tenth), read[pairs])
        assert dict(zip(places.tolist(), scores.tolist(), strict=True)) == {p: s for p, s in zip(*everything, strict=True) if s >= tenth}
    assert read[True][0] < 0.9 * read[False][0] and read[True][1] < read[False][1]
