"""Ranked lexical search: MaxScore over blocks of an inverted index, with bounds for pairs of terms.

1. Every document becomes a row of a forward index: its number of terms, and how often it holds each term that an item uses.
   Counts over all of them give N, L and every df, hence each term's weight.
2. Documents of a task, up to ``BLOCK_DOCS`` at a time, become one block: posting lists with final impacts, and for the
   pairs the items ask for the intersection list of the two postings with the largest joint impact in it. A block also
   notes, per item, a score that ten of its documents reach for sure through one term or one pair.
3. The largest such note is an item's first threshold everywhere. In each block the terms of an item are matched into
   disjoint pairs where that lowers the bound: no document gets more from a pair than the largest joint impact or the
   larger single one. Groups whose bounds add up to less than the threshold name no candidates; a pair that only reaches the
   threshold with both terms names its intersection list; candidates leave as soon as what is left cannot lift them.
4. The best of all tasks meet per item. Scores are whole numbers, so nothing depends on the order of additions.

Terms are the longest stretches of ASCII letters, ASCII digits and characters beyond ASCII in whole texts, with A-Z in lower
case. Null and empty texts have no terms: such documents are in no result and in no count, such items get no rows. Equal scores
go by id, null ids last; repeated documents are ranked each for itself, and a repeated item gets its rows once more. Empty
tables give an empty result. Only id and text of both tables are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapwright.llm.common import map_rows, small_batches, stored, texts

#: A block ends at either number.
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 250_000
#: A block is a long row, so the writer of the index looks at its buffers after each row, not after a hundred.
EVERY_ROW = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}
#: Items are searched in rounds of about so many bytes and rows; what is sent to the workers follows from that.
ROUND_BYTES, ROUND_ITEMS = 1 << 20, 10_000
#: A pair joins a term with one of the next so many terms of the item in the order of weights.
REACH = 2

# Every ASCII character but letters and digits separates terms; A-Z become a-z.
FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Plan(NamedTuple):
    """What the workers know of a round of items; terms are numbers."""

    keys: list[int]
    terms: list[np.ndarray]  # of each item, heaviest first
    weights: np.ndarray
    n_docs: int
    n_terms: int
    pairs: np.ndarray  # (pairs, 2)
    item_pairs: list[np.ndarray]  # of each item: place of both terms in it, number of the pair


class Block(NamedTuple):
    ids: pa.Array
    terms: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    pair_max: np.ndarray
    pair_starts: np.ndarray
    pair_docs: np.ndarray


def forward_index(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Documents with a term: id, number of terms, numbers of the vocabulary's terms they hold and how often."""
    narrow = texts(docs)
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def make():
        number, size = vocabulary.value, len(vocabulary.value)

        def work(batch: pa.RecordBatch) -> dict:
            get, counts, found = number.get, [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                counts.append(len(words))
                found.append(np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words)))
            n = np.array(counts, dtype=np.int64)
            ids = np.concatenate(found)
            keys, tf = np.unique((np.repeat(np.arange(len(n)), n) * size + ids)[ids >= 0], return_counts=True)
            alive = np.nonzero(n)[0]
            ends = np.searchsorted(keys, np.r_[alive, len(n)] * size).astype(np.int32)
            ends[-1] = len(keys)
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (keys % max(size, 1), tf)]
            return {"doc_id": batch.column(0).take(pa.array(alive)), "n": n[alive], "ids": lists[0], "tf": lists[1]}

        return work

    small_batches(docs.sparkSession)
    return map_rows(narrow, make, f"doc_id {id_type}, n long, ids array<int>, tf array<int>")


def make_plan(items: list[tuple[int, list[bytes]]], number: dict[bytes, int], df: dict[int, int], n_docs: int, n_terms: int) -> Plan:
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(number))], dtype=np.int64)
    pairs, keys, terms, item_pairs = {}, [], [], []
    for key, words in items:
        ids = np.array(sorted({number[w] for w in words}, key=lambda t: (-weights[t], t)), dtype=np.int64)
        keys.append(key)
        terms.append(ids)
        wanted = [(i, i + r) for i in range(len(ids)) for r in range(1, REACH + 1) if i + r < len(ids)]
        item_pairs.append(np.array([(i, j, pairs.setdefault((min(ids[i], ids[j]), max(ids[i], ids[j])), len(pairs))) for i, j in wanted], dtype=np.int64).reshape(-1, 3))
    return Plan(keys, terms, weights, n_docs, n_terms, np.array(list(pairs), dtype=np.int64).reshape(-1, 2), item_pairs)


def kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value, 0 where there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def build(plan: Plan, ids: pa.Array, n: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, k: int) -> tuple[Block, np.ndarray]:
    """A block and the scores that ``k`` of its documents reach for each item at least. Documents come in the order of ids."""
    m = np.array([10 + 90 * x * plan.n_docs // plan.n_terms for x in n.tolist()], dtype=np.int64)
    impacts = plan.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[owner]))
    order = np.lexsort((owner, term))
    order = order[impacts[order] > 0]
    term, docs, impacts = term[order], owner[order].astype(np.int32), impacts[order]
    terms, starts = np.unique(term, return_index=True)
    starts = np.r_[starts, len(term)]
    slot = np.full(len(plan.weights), -1)
    slot[terms] = np.arange(len(terms))
    reached = np.array([kth(impacts[a:b], k) for a, b in zip(starts[:-1], starts[1:], strict=True)], dtype=np.int64)
    pair_max, pair_floor, pair_docs = np.zeros(len(plan.pairs), dtype=np.int64), np.zeros(len(plan.pairs), dtype=np.int64), []
    sizes = np.zeros(len(plan.pairs), dtype=np.int64)
    for p, (a, b) in enumerate(slot[plan.pairs].tolist()):
        if a < 0 or b < 0:
            continue
        if starts[a + 1] - starts[a] > starts[b + 1] - starts[b]:
            a, b = b, a
        few, many = docs[starts[a] : starts[a + 1]], docs[starts[b] : starts[b + 1]]
        at = np.searchsorted(many, few)
        at[at == len(many)] = 0
        hit = many[at] == few
        if hit.any():
            joint = impacts[starts[a] : starts[a + 1]][hit] + impacts[starts[b] : starts[b + 1]][at[hit]]
            pair_max[p], pair_floor[p], sizes[p] = joint.max(), kth(joint, k), len(joint)
            pair_docs.append(few[hit])
    floors = np.zeros(len(plan.keys), dtype=np.int64)
    for q, (t, wanted) in enumerate(zip(plan.terms, plan.item_pairs, strict=True)):
        found = slot[t]
        found = found[found >= 0]
        floors[q] = max(reached[found].max(initial=0), pair_floor[wanted[:, 2]].max(initial=0))
    return Block(ids, terms, starts, docs, impacts, pair_max, np.cumsum(np.r_[0, sizes]), np.concatenate([np.zeros(0, np.int32), *pair_docs])), floors


def groups(single: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, joint: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Terms matched into disjoint pairs, the largest saving first: bound, both places (-1: alone) and number of the pair.

    In the order of bounds a posting: what comes first may be left out at the least cost.
    """
    alive = (single[wanted[:, 0]] > 0) & (single[wanted[:, 1]] > 0)
    wanted, joint = wanted[alive], joint[alive]
    bound = np.maximum(joint, np.maximum(single[wanted[:, 0]], single[wanted[:, 1]]))
    saving = single[wanted[:, 0]] + single[wanted[:, 1]] - bound
    out, used = [], set()
    for x in np.argsort(-saving, kind="stable").tolist():
        i, j, p = wanted[x].tolist()
        if saving[x] > 0 and i not in used and j not in used:
            used |= {i, j}
            out.append((int(bound[x]), i, j, p))
    out += [(int(single[i]), i, -1, -1) for i in np.nonzero(single)[0].tolist() if i not in used]
    return sorted(out, key=lambda g: (g[0] / (sizes[g[1]] + (sizes[g[2]] if g[2] >= 0 else 0)), g[1]))


def search_block(plan: Plan, block: Block, q: int, slot: np.ndarray, largest: np.ndarray, threshold: int, work: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the block (places) and their whole scores: all that reach the threshold. ``work`` counts candidates and postings read."""
    at = slot[plan.terms[q]]
    single = np.where(at >= 0, largest[at], 0)
    wanted = plan.item_pairs[q]
    sizes = np.where(at >= 0, block.starts[at + 1] - block.starts[at], 0)
    todo = groups(single, sizes, wanted, block.pair_max[wanted[:, 2]])
    before = np.cumsum([0, *[g[0] for g in todo]])
    none = np.zeros(0, dtype=np.int64)
    if before[-1] < threshold:
        return none, none
    posting = lambda i: slice(block.starts[at[i]], block.starts[at[i] + 1])
    marked = np.zeros(len(block.ids), dtype=bool)
    for g in reversed(range(len(todo))):
        _, i, j, p = todo[g]
        if before[g + 1] < threshold:
            break
        if j >= 0 and before[g] + max(single[i], single[j]) < threshold:
            marked[block.pair_docs[block.pair_starts[p] : block.pair_starts[p + 1]]] = True
        else:
            for x in (i, j):
                if x >= 0:
                    marked[block.docs[posting(x)]] = True
    left = np.nonzero(marked)[0]
    if work is not None:
        work += [len(left), 0]
    score = np.zeros(len(block.ids), dtype=np.int64)
    for g in reversed(range(len(todo))):
        _, i, j, p = todo[g]
        for x in (i, j):
            if x < 0 or not len(left):
                continue
            had = score[left]
            docs, impacts = block.docs[posting(x)], block.impacts[posting(x)]
            if len(docs) <= 4 * len(left):
                score[docs] += impacts
            else:
                found = np.searchsorted(docs, left)
                found[found == len(docs)] = 0
                hit = docs[found] == left
                score[left[hit]] += impacts[found[hit]]
            if work is not None:
                work += [0, min(len(docs), 4 * len(left))]
            rest = before[g]
            if x == i and j >= 0:
                # With the first term of a pair the second adds no more than the joint maximum leaves.
                gain = score[left] - had
                rest = rest + np.where(gain > 0, np.clip(block.pair_max[p] - gain, 0, single[j]), single[j])
            left = left[score[left] + rest >= threshold]
    return left, score[left]


def best(places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the ``k`` first by falling score, then by place, and the places and scores that the order counts in."""
    if len(scores) > k:
        reach = scores >= kth(scores, k)
        places, scores = places[reach], scores[reach]
    return np.lexsort((places, -scores))[:k], places, scores


COLUMNS = ("terms array<int>", "starts array<int>", "docs array<int>", "impacts array<long>", "pair_max array<long>", "pair_starts array<long>", "pair_docs array<int>", "floors array<long>")


def index_blocks(forward: DataFrame, plan: Broadcast, k: int) -> DataFrame:
    """One row per block."""
    id_type = forward.schema["doc_id"].dataType.simpleString()
    names = ["ids", *[c.split()[0] for c in COLUMNS]]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, docs, postings = [], 0, 0
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            a = 0
            for b, size in enumerate(sizes.tolist()):
                if docs and (docs >= BLOCK_DOCS or postings + size > BLOCK_POSTINGS):
                    yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
                    held, docs, postings, a = [], 0, 0, b
                docs, postings = docs + 1, postings + size
            held.append(batch.slice(a))
        if docs:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            part = part.sort_by([("doc_id", "ascending")]).combine_chunks()
            ids, n, terms, tf = (part.column(i).combine_chunks() for i in range(4))
            owner = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))
            block, floors = build(plan.value, ids, n.to_numpy(), owner, *(c.flatten().to_numpy().astype(np.int64) for c in (terms, tf)), k)
            rows = [ids.to_pylist(), *block[1:], floors]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(ids.type)) if i == 0 else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()),
                pa.array(v, pa.int64() if "long" in COLUMNS[i - 1] else pa.int32())) for i, v in enumerate(rows)], names=names)

    return forward.mapInArrow(run, f"ids array<{id_type}>, " + ", ".join(COLUMNS))


def search_blocks(index: DataFrame, plan: Broadcast, floors: Broadcast, k: int) -> DataFrame:
    """The best ``k`` of every task for every item: ``item_key``, ``doc_id``, ``score``."""
    id_type = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, found, kind = plan.value, {}, None
        threshold = np.maximum(floors.value, 1)
        for batch in batches:
            kind = batch.column(0).type.value_type
            for r in range(batch.num_rows):
                ids, *rest = (c[r].values for c in batch.columns[:-1])
                block = Block(ids, *[c.to_numpy(zero_copy_only=False) for c in rest])
                slot = np.full(len(p.weights), -1)
                slot[block.terms] = np.arange(len(block.terms))
                largest = np.maximum.reduceat(block.impacts, block.starts[:-1]) if len(block.impacts) else np.zeros(1, dtype=np.int64)
                for q in range(len(p.keys)):
                    places, scores = search_block(p, block, q, slot, largest, int(threshold[q]))
                    if not len(places):
                        continue
                    order, places, scores = best(places, scores, k)
                    picked = ids.take(pa.array(places[order])).to_pylist()
                    merged = found.get(q, []) + list(zip(scores[order].tolist(), picked, strict=True))
                    merged.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                    found[q] = merged[:k]
                    if len(merged) >= k:
                        threshold[q] = max(threshold[q], merged[k - 1][0])
        if found:
            rows = [(p.keys[q], d, s) for q, hits in found.items() for s, d in hits]
            keys, docs, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs, kind), pa.array(scores, pa.int64())], names=["item_key", "doc_id", "score"])

    return index.mapInArrow(run, f"item_key long, doc_id {id_type}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of each item's ``k`` best documents with a score above 0.

    Items go in rounds of bounded size; each round passes over all documents once.
    """
    spark = docs.sparkSession
    narrow = texts(items, "item_id").withColumnRenamed("doc_id", "item_id").withColumn("item_key", F.monotonically_increasing_id())
    narrow = stored(narrow, "search-items")
    count, size = narrow.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    rounds = max(1, -(-count // ROUND_ITEMS), -(-(size or 0) // ROUND_BYTES))
    out = None
    for r in range(rounds):
        asked = [(row.item_key, terms_of(row.text)) for row in narrow.where(F.pmod(F.xxhash64("item_key"), F.lit(rounds)) == r).toLocalIterator()]
        number = {w: i for i, w in enumerate(sorted({w for _, words in asked for w in words}))}
        forward = stored(forward_index(docs, spark.sparkContext.broadcast(number)), "search-forward")
        n_docs, n_terms = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
        df = {row.id: row.n for row in forward.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
        plan = spark.sparkContext.broadcast(make_plan(asked, number, df, n_docs, n_terms))
        index = stored(index_blocks(forward, plan, k), "search-index", **EVERY_ROW)
        floors = np.zeros(len(asked), dtype=np.int64)
        for q, least in index.select(F.posexplode("floors")).groupBy("pos").agg(F.max("col")).toLocalIterator():
            floors[q] = least
        found = search_blocks(index, plan, spark.sparkContext.broadcast(floors), k)
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("item_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(narrow.select("item_key", "item_id"), "item_key").select("item_id", "rank", "doc_id", "score")
