"""The registered queries: against SQL, against brute force on the smallest tables, and on odd and empty tables."""

import collections
import hashlib
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from check import compare, duck
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mapwright.llm import queries

QUERIES = queries.queries()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["kept", "sha", "shard", "Slot", "found", "text_hash", "number", "place", "size", "order_key", "piece", "first_row", "node", "root", "text_digest", "survived", "score"]


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_answer(docs):
    """Brute force: (id, set size, component) of each row, in order."""
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)]


#: Two queries (20 twice, 40) and what they may find: rows that are null, zero, not finite, short, or without an id take no part.
ODD_VECTORS = [(*r, 0, "s", 9) for r in [
    (20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 2.0]), (40, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [3.0, -1.0]), (4, [-2.0, 0.5]), (5, None), (6, [0.0, 0.0]),
    (7, [None, 1.0]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [1.0]), (11, [1.0, 2.0, 3.0]), (12, []), (None, [9.0, 9.0]), (60, None), (80, [0.0, -0.0])]]


def odd_rows():
    prose = " ".join(f"word{k % 97}x{k % 31}" for k in range(400))
    near = prose.replace("word5x5", "other")
    base = [
        (1, None), (2, ""), (3, "  \t\n"), (4, "!!! ??? 123"), (None, "A text without an id, really"), (5, "One two"), (6, "one TWO"), (7, prose), (8, near), (9, prose.upper()),
        (10, prose), (10, prose), (10, prose), (11, "mail a.b@c.de, +1 (743) 555-3824, 4111 1111 1111 1111, 10.0.0.1; later (743) 555-3824"), (11, "same id, other text"),
        (12, "<|endoftext|> <|im_start|> 日本語 İstanbul Σ"), (13, "long " * 60_000 + prose), (14, "x" * 300_000), (None, None),
    ]
    return [(d, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "s", None if k % 5 == 0 else k) for k, (d, t) in enumerate(base)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(odd_rows(), DOCS)
    docs.select("*", *[F.lit("clash").alias(c) for c in CLASH]).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, 1, 0), (7, 1, 1), (8, None, None), (None, 0, 1), (5, 0, 0), (11, 1, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (None, "x y z x y z x y z"), (4, " ".join(f"word{k % 97}x{k % 31}" for k in range(50, 90)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    turns = [(1, 0, "user", "a<|im_end|>\nb"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, None, None, "x"), (None, 0, "assistant", "<\\|"), (2, 3, "we\\ir\nd<|", "z" * 200_000), (2, 4, "assistant", "")]
    spark.createDataFrame([(*t, "c") for t in turns], "conv_id long, turn long, role string, text string, part string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame(ODD_VECTORS, "vec_id long, embedding array<float>, rank int, score string, list int").repartition(2).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "conversations", "embeddings"):
        spark.read.parquet(f"{odd}/{name}.parquet").where("false").write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    assert not compare(QUERIES[name](spark, SF), duck(SF), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    n = len(odd_rows())
    if name == "op2_chat_format":
        by = {r.conv_id: r for r in rows}
        assert set(by) == {-1, 1, 2, None} and by[1].n_turns == 4 and by[2].formatted_chars > 200_000
        want = "".join(f"{r}\n{t}\n" for r, t in [("", "x"), ("user", "a<|im_end|>\nb"), ("assistant", ""), ("assistant", "")])
        assert by[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert by[None].loss_sha256 == hashlib.sha256(b"<\\|").hexdigest()
    elif name == "op8_decontamination":
        assert {(r.doc_id, r.item_id) for r in rows} == {(d, 4) for d in (7, 8, 9, 10, 13)}
    elif name == "op9_packing":
        assert sum(r.start == 0 for r in rows) == n
    elif name == "op12_vector_search":
        east = [(3, 3.0), (1, 1.0), (2, 1.0), (20, 1.0), (20, 0.0), (4, -2.0)]
        want = [(40, i, d, s) for i, (d, s) in enumerate(east, 1)]
        want += [(20, i, d, s) for i, (d, s) in enumerate([(3, 3.0), (1, 1.0), (2, 1.0), (40, 1.0), (20, 0.0), (4, -2.0)], 1)]
        want += [(20, i, d, s) for i, (d, s) in enumerate([(4, 1.0), (1, 0.0), (2, 0.0), (20, 0.0), (40, 0.0), (3, -2.0)], 1)]
        assert collections.Counter(map(tuple, rows)) == collections.Counter(want)
    elif name == "op13_lexical_search":
        found = collections.defaultdict(list)
        for r in rows:
            found[r.item_id].append((r.rank, r.doc_id, r.score))
        assert set(found) == {3, 4} and len(found[4]) == 7 and sorted(r for r, *_ in found[4]) == list(range(1, 8))
        assert {d for _, d, _ in found[4]} == {7, 8, 9, 10, 13}
    else:
        assert len(rows) == n
        assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d for d, *_ in odd_rows())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert len(QUERIES[name](spark, empty).collect()) == (name == "op2_chat_format")


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, odd)
        assert docs.columns == columns, name
        docs = docs.cache()
        assert 0 < docs.count() <= before
    left = {d.text for d in docs.collect()}
    assert None not in left and "" not in left and "same id, other text" in left and not any("word5x5" in t for t in left)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, odd).count() >= docs.count()
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_toxicity_learns_from_learning_rows_alone(spark, odd):
    rows = QUERIES["op1_toxicity"](spark, SF).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op1_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / max(1, sum(r.predicted for r in rows)) > 0.9 and hit / sum(r.toxic for r in rows) > 0.75


def test_personal_data_base(spark, documents):
    from test_methods import base_reference

    rows = {r.doc_id: r for r in QUERIES["op3_pii"](spark, SF).collect()}
    for d, text, _ in documents:
        spans = base_reference(text)
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert rows[d].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(rows[d].spans.split(","))
        assert [rows[d][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(k == s[0] for s in spans) for k in ("email", "ip", "card", "phone")]


def test_token_counts(spark, odd, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rows = {r.doc_id: r for r in QUERIES["op4_token_counts"](spark, SF).collect()}
    for d, text, _ in documents:
        n = size(text)
        assert (rows[d].n_bytes, rows[d].n_tokens, rows[d].over_limit) == (len(text.encode()), n, n > 512)
    got = collections.Counter((r.doc_id, r.n_tokens) for r in QUERIES["op4_token_counts"](spark, odd).collect())
    assert got == collections.Counter((d, size(t or "")) for d, t, *_ in odd_rows())


@pytest.mark.parametrize("where", ["small", "odd"])
def test_near_duplicates(spark, odd, documents, where):
    docs = [(d, t) for d, t, _ in documents] if where == "small" else [(d, t) for d, t, *_ in odd_rows()]
    rows = QUERIES["op5_minhash_dedup"](spark, SF if where == "small" else odd).collect()
    want = [(d, n, c) if n or where == "small" else (d, n, d) for d, n, c in near_answer(docs)]
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == collections.Counter(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_shards(spark):
    rows = QUERIES["op6_sharding"](spark, "/root/testdata/sf0.01").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    total = sum(r.size for r in rows)
    largest = max(r.size for r in rows)
    assert len(rows) == 1000 and set(by) == set(range(40))
    for found in by.values():
        assert sorted(r.slot for r in found) == list(range(len(found)))
        assert abs(sum(r.size for r in found) - total / 40) <= largest


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    truth = {d: lang for d, lang in duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall()}
    rows = QUERIES["op7_language_id"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_decontamination(spark):
    sf = "/root/testdata/sf0.01"
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    docs = [(d, plain(t)) for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()]
    items = [(i, plain(t)) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_decontamination"](spark, sf).collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if x in t}


@pytest.mark.parametrize("where", ["small", "odd"])
def test_packing(spark, odd, documents, where):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    code = lambda t: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
    rows = QUERIES["op9_packing"](spark, SF if where == "small" else odd).collect()
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    full = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces[:-1]]]).tolist()
        full += sum(r.length for r in pieces) == 4096
    assert full >= len(sequences) - 1
    if where == "odd":
        return
    ids = {d: code(t) for d, t, _ in documents}
    covered = collections.Counter()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
    assert covered == {d: len(x) for d, x in ids.items()}


def test_pipeline_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, sf).cache()
    assert first.count() == docs.where(F.col("text").rlike("\\p{L}")).count()
    second = stages["exact_dedup"](spark, first, sf).cache()
    best = {}
    for r in first.collect():
        best[low(r.text)] = max(best.get(low(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in second.collect()) == sorted(best.values())
    third = stages["minhash_near_dedup"](spark, second, sf).cache()
    rows = [(r.doc_id, r.text) for r in second.collect()]
    assert sorted(r.doc_id for r in third.collect()) == sorted(d for d, _, c in near_answer(rows) if d == c)
    fourth = stages["benchmark_decontamination"](spark, third, sf)
    bad = {r.doc_id for r in QUERIES["op8_decontamination"](spark, sf).collect()}
    assert {r.doc_id for r in fourth.collect()} == {r.doc_id for r in third.collect()} - bad
