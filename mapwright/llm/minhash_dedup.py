"""Near duplicates by tensored minhash banding, with every link confirmed on full shingle sets.

Two small collections of minhash groups are computed; a table key is a pair of one group from each, so ``GROUPS`` squared
tables need only ``2 * GROUPS * ROWS`` minhashes. At similarity 0.75 a pair shares no key with a chance of about
``2 * (1 - 0.75 ** ROWS) ** GROUPS`` (0.0001 here), at 0.8 and above far less.

1. Texts with equal shingle sets are one node. A pair key is made only where both of its groups occur in other nodes too
   (a bitmap of repeated groups, of fixed size); dropping the other keys loses nothing.
2. In each bucket every node is compared with the bucket's first node; confirmed links are joined to components.
3. Buckets that still hold different components are searched whole: pairs of different components are compared by
   a sketch inside the task, and only the close ones, each in its first shared table, go to confirmation: first each
   node's closest, then, between what is still apart, all. Sets of up to ``WHOLE`` shingles are compared on all their
   codes there, so of those only links leave the task. So a large group of near copies costs its members, not its
   pairs. Buckets above ``SPLIT`` are first divided by triples of sketch bins.
4. Components are joined again over all confirmed links; no link, node or component reaches the driver.

Words are maximal runs without white space after A-Z are lower-cased. A text with fewer words than a shingle is one shingle;
null, empty and blank texts have none and are linked with nothing: they are their own component. Repeated rows are copies.
With a null ``doc_id`` a row is still grouped, but cannot name a component unless all ids of it are null. Empty tables
give empty results. Sets are of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapwright.llm.common import free_name, has_bit, map_rows, set_bits, small_batches, stored
from mapwright.llm.components import components, extended

WORDS, PERCENT = 5, 75
#: Minhashes in a group, groups in each of the two collections.
ROWS, GROUPS = 3, 18
BITS = 1 << 25
#: Bins of the sketch, and how many standard errors below the threshold its share of equal bins may lie for a pair to be
#: confirmed on its sets. A bin shows a common shingle with a chance of the similarity, so the fewer bins two sets fill,
#: the wider the margin; pairs that fill few bins all pass.
BIN_BITS, ERRORS = 10, 4.5
BINS = 1 << BIN_BITS
#: Sets of up to ``WHOLE`` shingles go along as four-byte codes and are compared whole before a pair leaves a task; those
#: of up to ``TINY`` even without a look at their sketches.
WHOLE, TINY = BINS, BINS // 8
#: Nodes of a bucket that are compared directly; larger ones are divided by triples of bins first.
SPLIT, TRIPLES = 4096, 40
BLOCK = 4096

_seeds = np.random.RandomState(20240607)
FACTORS = _seeds.randint(1, 1 << 62, size=2 * ROWS * GROUPS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _seeds.randint(0, 1 << 62, size=2 * ROWS * GROUPS, dtype=np.int64).astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    width = min(WORDS, len(codes))
    n = len(codes) - width + 1
    total = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    return np.unique(total)


def groups(hashes: np.ndarray) -> np.ndarray:
    """Keys of the groups of both collections, as signed numbers."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), BLOCK):
        part = hashes[a : a + BLOCK, None] * FACTORS[None, :] + SHIFTS[None, :]
        least = np.minimum(least, part.min(axis=0))
    least = mixed(least).reshape(2 * GROUPS, ROWS)
    key = np.arange(2 * GROUPS, dtype=np.uint64) + np.uint64(1)
    for r in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[:, r])
    return key.view(np.int64)


def codes(hashes: np.ndarray) -> np.ndarray:
    """Sorted four-byte codes of a set, repeats kept: sets have at least as many codes in common as shingles."""
    return np.sort((mixed(hashes + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32))


def bins(code: np.ndarray) -> np.ndarray:
    """The smallest code of each bin as a byte, 0 in an empty bin."""
    at = np.searchsorted(code, np.arange(BINS, dtype=np.uint32) << np.uint32(32 - BIN_BITS))
    smallest = code[np.minimum(at, len(code) - 1)]
    full = (at < len(code)) & (smallest >> np.uint32(32 - BIN_BITS) == np.arange(BINS, dtype=np.uint32))
    return np.where(full, mixed(smallest.astype(np.uint64)) % np.uint64(255) + np.uint64(1), 0).astype(np.uint8)


def sketch(hashes: np.ndarray) -> bytes:
    return bins(codes(hashes)).tobytes()


def brief(hashes: np.ndarray) -> bytes:
    """What goes along with a node: all codes of a set of up to ``WHOLE`` shingles, the sketch of a larger one."""
    return codes(hashes).tobytes() if len(hashes) <= WHOLE else sketch(hashes)


def opened(size: int, held: bytes) -> tuple[np.ndarray | None, np.ndarray]:
    """Codes (none of a large set) and sketch from what :func:`brief` gave for a set of ``size`` shingles."""
    if size > WHOLE:
        return None, np.frombuffer(held, np.uint8)
    code = np.frombuffer(held, np.uint32)
    return code, bins(code)


def closeness(one: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of equal bins among those that either fills, and whether the sets behind may reach the threshold."""
    either = np.maximum(1, ((many | one) != 0).sum(axis=1))
    share, goal = ((many == one) & (many != 0)).sum(axis=1) / either, PERCENT / 100
    return share, share >= goal - ERRORS * np.sqrt(goal * (1 - goal) / either)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``node`` (null without shingles) and the groups of both collections."""
    small_batches(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    narrow = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            nodes = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True) if len(s) else None for s in sets]
            return {"doc_id": batch.column(0), "text_hash": batch.column(2), "n_shingles": [len(s) for s in sets], "node": pa.array(nodes, pa.int64()), "groups": pa.array([groups(s) if len(s) else None for s in sets], pa.list_(pa.int64()))}

        return work

    return map_rows(narrow, make, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, text_hash long, n_shingles long, node long, groups array<long>")


def bucket_keys(nodes: DataFrame) -> DataFrame:
    """``key``, ``place`` (number of the table) and ``node`` for the pairs of groups that other nodes have too."""
    spark = nodes.sparkSession
    again = nodes.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = spark.sparkContext.broadcast(set_bits(again.select(F.pmod("group", F.lit(BITS)).alias("place")), BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "place", "node"]
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            held = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * GROUPS)
            live = has_bit(shared.value, held & (BITS - 1))
            first, second = held[:, :GROUPS], held[:, GROUPS:]
            pair = live[:, :GROUPS, None] & live[:, None, GROUPS:]
            row, i, j = np.nonzero(pair)
            key = mixed(first[row, i].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second[row, j].view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array((i * GROUPS + j).astype(np.int32)), pa.array(node[row])], names=names)

    return nodes.select("node", "groups").mapInArrow(run, "key long, place int, node long")


def full_sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """``node``, ``members`` (its shingle hashes) and ``brief`` of the nodes whose ``text_hash`` is wanted."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(set_bits(wanted.select(F.pmod("text_hash", F.lit(BITS)).alias("place")), BITS))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    narrow = docs.select(text.alias("text"), F.pmod(F.xxhash64(text), F.lit(BITS)).alias("place"))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            chosen = batch.filter(pa.array(has_bit(shared.value, batch.column(1).to_numpy())))
            sets: dict[int, np.ndarray] = {}
            for text in dict.fromkeys(chosen.column(0).to_pylist()):
                s = shingles(text)
                if len(s):
                    sets[int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True)] = s
            return {"node": pa.array(list(sets), pa.int64()), "members": pa.array([s.view(np.int64) for s in sets.values()], pa.list_(pa.int64())), "brief": pa.array([brief(s) for s in sets.values()], pa.binary())}

        return work

    found = map_rows(narrow, make, "node long, members array<long>, brief binary")
    return found.groupBy("node").agg(F.first("members").alias("members"), F.first("brief").alias("brief"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u``, ``v`` whose sets are similar enough; sizes and codes or sketches first, so few sets move."""
    sizes = sets.select("node", F.size("members").alias("n"), "brief")
    side = lambda t, name, extra: t.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in extra])
    near = pairs.join(side(sizes, "u", ["n", "brief"]), "u").join(side(sizes, "v", ["n", "brief"]), "v")
    near = near.where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * PERCENT)

    def may(n: int, one: bytes, m: int, other: bytes) -> bool:
        if n <= WHOLE and m <= WHOLE:
            return bool(whole_closeness(np.frombuffer(one, np.uint32), [np.frombuffer(other, np.uint32)])[1][0])
        return bool(closeness(opened(n, one)[1], opened(m, other)[1][None])[1][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive = [may(*pair) for pair in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(alive, pa.bool_()))

    near = near.select("u", "v", "n_u", "brief_u", "n_v", "brief_v").mapInArrow(run, "u long, v long")
    held = near.join(side(sets, "u", ["members"]), "u").join(side(sets, "v", ["members"]), "v")
    both = F.size(F.array_intersect("members_u", "members_v"))
    return held.where(both * 100 >= (F.size("members_u") + F.size("members_v") - both) * PERCENT).select("u", "v")


def whole_closeness(one: np.ndarray, many: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of a sorted set (or its codes) with others, and whether it reaches the threshold."""
    sizes = np.array([len(m) for m in many])
    flat = np.concatenate(many)
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    both = np.add.reduceat(one[at] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)
    either = sizes + len(one) - both
    return both / either, both * 100 >= either * PERCENT


def nearby(node: np.ndarray, root: np.ndarray, size: np.ndarray, group: np.ndarray, marks: np.ndarray, small: list[np.ndarray | None], table: int) -> Iterator[tuple[int, int, float]]:
    """Positions of the close pairs of different components among nodes that share group ``table`` of the first collection.

    Only nodes that share a group of the second collection too are compared, and only in the first table they share.
    """
    for second in range(GROUPS):
        order = np.argsort(group[:, GROUPS + second], kind="stable")
        edges = np.flatnonzero(np.diff(group[order, GROUPS + second])) + 1
        for bucket in np.split(order, edges):
            if len(bucket) < 2 or (root[bucket] == root[bucket[0]]).all():
                continue
            blocks, several = [bucket], len(bucket) > SPLIT
            if several:  # nodes that agree in a triple of bins; a close pair agrees in some of them
                blocks = []
                for t in range(TRIPLES):
                    value = marks[bucket, 3 * t].astype(np.int64) << 16 | marks[bucket, 3 * t + 1].astype(np.int64) << 8 | marks[bucket, 3 * t + 2]
                    by = np.argsort(value, kind="stable")
                    blocks += [bucket[x] for x in np.split(by, np.flatnonzero(np.diff(value[by])) + 1) if len(x) > 1]
            seen: set[tuple[int, int]] = set()
            for block in blocks:
                for x, i in enumerate(block[:-1].tolist()):
                    rest = block[x + 1 :]
                    rest = rest[root[rest] != root[i]]
                    rest = rest[np.minimum(size[rest], size[i]) * 100 >= np.maximum(size[rest], size[i]) * PERCENT]
                    if len(rest):
                        equal = group[rest] == group[i]
                        rest = rest[(equal[:, :GROUPS].argmax(axis=1) == table) & (equal[:, GROUPS:].argmax(axis=1) == second)]
                    if len(rest):
                        close, may = closeness(marks[i], marks[rest])
                        if small[i] is not None:
                            whole = np.flatnonzero((may & (size[rest] <= WHOLE)) | (size[rest] <= TINY))
                            if len(whole):
                                close[whole], may[whole] = whole_closeness(small[i], [small[j] for j in rest[whole].tolist()])
                        for j, c in zip(rest[may].tolist(), close[may].tolist(), strict=True):
                            if several:
                                pair = (min(i, j), max(i, j))
                                if pair in seen:
                                    continue
                                seen.add(pair)
                            yield i, j, c


def cross_pairs(buckets: DataFrame, label: DataFrame, nodes: DataFrame, sets: DataFrame, nearest: bool) -> DataFrame:
    """Close pairs of different components that share a bucket; ``nearest``: for each node of a task's group only its closest.

    A node goes out once for each group of the first collection, with its groups of the second: at most ``GROUPS`` rows in
    place of one for each bucket.
    """
    spark = buckets.sparkSession
    labelled = buckets.join(label.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    torn = labelled.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    rows = labelled.join(torn, "key", "left_semi").select("node", "root", F.expr(f"place div {GROUPS}").cast("int").alias("first")).distinct()
    detail = nodes.select("node", "groups", F.col("n_shingles").alias("n")).join(sets.select("node", "brief"), "node")
    rows = rows.join(detail, "node").withColumn("key", F.get("groups", F.col("first")))
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "first", "node", "root", "n", "groups", "brief").repartition(number, "key").sortWithinPartitions("key", "node")

    def compare(held: list[tuple]) -> Iterator[tuple[int, int]]:
        node, root, size = (np.array([b[k] for b in held], np.int64) for k in (1, 2, 3))
        group = np.array([b[4] for b in held], np.int64)
        small, marks = zip(*(opened(b[3], b[5]) for b in held), strict=True)
        marks = np.stack(marks)
        found = nearby(node, root, size, group, marks, small, held[0][0])
        if nearest:
            best: dict[int, tuple[float, int]] = {}
            for i, j, c in found:
                for a, b in ((i, j), (j, i)):
                    if a not in best or (c, -int(node[b])) > (best[a][0], -int(node[best[a][1]])):
                        best[a] = (c, b)
            found = ((a, b, c) for a, (c, b) in best.items())
        for i, j, _ in found:
            yield int(min(node[i], node[j])), int(max(node[i], node[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if len(held) > 1:
                        out += compare(held)
                    key, held = k, []
                held.append(tuple(row))
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if len(held) > 1:
            out += compare(held)
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def labelled_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``node`` and ``root`` (the node's component) of every row."""
    signed = stored(signatures(docs, id_col, text_col), "minhash-signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("n_shingles").alias("n_shingles"), F.first("groups").alias("groups"))
    nodes = stored(nodes, "minhash-nodes")
    keys = bucket_keys(nodes)
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stored(keys.join(leaders.drop("n"), "key"), "minhash-buckets")
    members = buckets.select("node").distinct()
    wanted = nodes.select("node", "text_hash").join(members, "node", "left_semi")
    sets = stored(full_sets(docs, wanted, text_col), "minhash-sets")
    stars = buckets.where("leader <> node").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
    links = stored(confirmed(stars, sets), "minhash-links")
    label = components(links)
    for nearest in (True, False):  # closest pairs join most of what belongs together; then nothing is left out
        found = cross_pairs(buckets.select("key", "place", "node"), label, nodes, sets, nearest)
        label = stored(extended(label, stored(confirmed(found, sets), "minhash-more")), "minhash-labels")
    label = label.withColumnRenamed("u", "node")
    return signed.select("doc_id", "text_hash", "n_shingles", "node").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row."""
    rows = stored(labelled_documents(docs, id_col, text_col).select("doc_id", "n_shingles", "root"), "minhash-rows")
    linked = rows.where("root is not null")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = linked.join(least, "root").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("root is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id (of the smallest text hash, where ids repeat), all columns unchanged.

    Rows without words stay. Only rows that go, or that repeat another's id and text, are moved: a bitmap of them (of fixed
    size) lets all others pass where they are.
    """
    spark = docs.sparkSession
    rows = labelled_documents(docs, id_col, text_col).where("root is not null").groupBy("doc_id", "text_hash").agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("n"))
    rows = stored(rows, "minhash-rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")).alias("best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    touched = rows.join(best, "root").select("doc_id", "text_hash", stays.alias("stays"), "n").where("n > 1 or not stays")
    place = lambda *keys: F.pmod(F.xxhash64(*keys), F.lit(BITS))
    touched = stored(touched.select(F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash"), "stays"), "minhash-touched")
    shared = spark.sparkContext.broadcast(set_bits(touched.select(place("t_hash", "t_id").alias("place")), BITS))

    @F.pandas_udf("boolean")
    def may_go(at: pd.Series) -> pd.Series:
        return pd.Series(has_bit(shared.value, at.to_numpy()))

    mark, number, bit = (free_name(docs.columns, n) for n in ("text_hash", "number", "bit"))
    hashed = docs.withColumn(mark, F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))).withColumn(bit, may_go(place(mark, id_col)))
    here = hashed.where(~F.col(bit)).select(*docs.columns)
    met = hashed.where(bit).join(touched, (F.col(mark) == F.col("t_hash")) & F.col(id_col).eqNullSafe(F.col("t_id")), "left")
    first = F.row_number().over(Window.partitionBy(mark, id_col).orderBy(mark))
    moved = met.where("stays is null or stays").withColumn(number, first).where((F.col(number) == 1) | F.col("stays").isNull())
    return here.unionByName(moved.select(*[F.col(c) for c in docs.columns]))
