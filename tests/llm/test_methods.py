"""The parts of the operators that need no cluster, against plain versions."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mapwright.llm import chat_format, components, decontamination, language_id, minhash_dedup, packing, pii, sharding, toxicity
from mapwright.llm.common import Recent


def base_reference(text):
    """The base patterns as they are stated."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15]
    return out


def test_base_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789..@@ab- ()+%_  \n") for _ in range(rng.randint(1, 60)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == base_reference(text)


@pytest.mark.parametrize("unit", ["a", "1", "1.", "+1", "a@", "1 ", "(1", "a.b@c", "1-"])
def test_patterns_take_linear_time(unit):
    text = unit * 200_000
    start = time.process_time()
    pii.mentions(text, pii.base_spans(text))
    assert time.process_time() - start < 5


def test_messages_agree_with_enumeration():
    """On a tree, message passing gives the exact marginals."""
    rng = np.random.default_rng(0)
    unary, edges = rng.normal(size=(4, 3)), np.array([[0, 1], [1, 2], [1, 3]])
    factors = rng.normal(size=(3, 3, 3))
    total = np.zeros((4, 3))
    for state in np.ndindex(3, 3, 3, 3):
        weight = np.exp(sum(unary[i, s] for i, s in enumerate(state)) + sum(factors[k, state[a], state[b]] for k, (a, b) in enumerate(edges)))
        for i, s in enumerate(state):
            total[i, s] += weight
    assert np.allclose(pii.propagate(unary, edges, factors, 200), total / total.sum(axis=1, keepdims=True), atol=1e-3)


def test_repeated_value_gets_the_label():
    weights = {"bias": np.zeros(5)}
    model = {"weights": weights, "chain": np.zeros((5, 5))}
    batch = ["Call +1 (743) 555-3824 now, later (743) 555-3824 again", "(743) 555-3824 alone"]
    found = pii.added(batch, [pii.base_spans(t) for t in batch], model)
    assert [batch[0][a:b] for _, a, b in found[0]] == ["(743) 555-3824"] and found[1] == []


def test_segments_against_definition():
    """Maximal segments: the best one, then the best left and right of it, and so on."""

    def plain(s, at=0):
        best = max(((sum(s[a:b]), -(b - a), a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, a, b = best
        return plain(s[:a], at) + [(at + a, at + b)] + plain(s[b:], at + b)

    rng = np.random.default_rng(3)
    for _ in range(300):
        s = rng.normal(-0.2, 1, rng.integers(0, 14))
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == plain(s.tolist())


def test_passage_places():
    scores = Recent(lambda w: 1.0 if w == "bad" else -1.0)
    text = "Fine words, BAD bad; fine."
    found = toxicity.segments(toxicity.token_scores(text, scores))
    spans = toxicity.places(text, found)
    assert [text[s["start"] : s["end"]] for s in spans] == ["BAD bad"]


def test_suffix_automaton_and_phrases():
    rng = random.Random(5)
    for _ in range(60):
        sample = [rng.choice([1, 2, 3, 4]) for _ in range(40)]
        moves = language_id.suffix_automaton(np.array(sample, np.uint8), 6)
        held = {tuple(sample[a:b]) for a in range(40) for b in range(a + 1, 41)}
        text = [rng.choice([0, 1, 2, 3, 4, 5]) for _ in range(30)]
        want, at = 0, 0
        while at < len(text):
            size = 1
            while at + size < len(text) and tuple(text[at : at + size + 1]) in held:
                size += 1
            want, at = want + 1, at + size
        assert language_id.phrases(moves, np.array([text]), np.array([len(text)]))[0] == want


def test_every_letter_of_the_sample_counts(spark):
    """Languages with few rows and other letters are told apart beside one with thousands of common letters."""
    rng = random.Random(7)
    chinese = [chr(0x4E00 + k) for k in range(3000)]
    scripts = {lang: [chr(first + k) for k in range(16)] for lang, first in (("am", 0x1200), ("hy", 0x561), ("ka", 0x10D0), ("gothic", 0x10330))}
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 6)))
    learn = [("zh", "".join(rng.choice(chinese) for _ in range(300))) for _ in range(60)]
    learn += [(lang, " ".join(word(letters) for _ in range(30))) for lang, letters in scripts.items() for _ in range(2)]
    model = language_id.fit(spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(learn)], "doc_id long, text string, lang string"), F.lit(True))
    assert all(model["code"][ord(c)] > 1 for lang, t in learn if lang != "zh" for c in t if c != " ") and len(model["letters"][model["names"].index("zh")]) > 2500
    names, _ = language_id.labeller(model)([*(t[20:90] for _, t in learn), *(" ".join(word(letters) for _ in range(8)) for letters in scripts.values())])
    assert names == [lang for lang, _ in learn] + list(scripts)


def test_sparse_transitions_give_the_same_phrases(monkeypatch):
    rng = np.random.default_rng(3)
    sample, blocks = rng.integers(1, 9, 500), rng.integers(0, 9, (40, 60))
    dense = language_id.suffix_automaton(sample, 9)
    monkeypatch.setattr(language_id, "TABLE_SYMBOLS", 3)
    sparse = language_id.suffix_automaton(sample, 9)
    assert isinstance(sparse, language_id.Sparse) and not isinstance(dense, language_id.Sparse)
    sizes = np.full(40, 60)
    assert language_id.phrases(sparse, blocks, sizes).tolist() == language_id.phrases(dense, blocks, sizes).tolist()


def test_one_long_row_is_not_a_language(spark):
    """All rows of the sample share the room, and long rows give places from all over the text."""
    letters = [chr(0x3041 + k) for k in range(40)]
    learn = [(k, c * 50_000 if k % 2 else "x" * 50_000 + c * 5_000, "en") for k, c in enumerate(letters)]
    model = language_id.fit(spark.createDataFrame(learn, "doc_id long, text string, lang string"), F.lit(True))
    assert model["sizes"][0] <= language_id.SAMPLE_SYMBOLS and all(model["code"][ord(c)] > 1 for c in ["x", *letters])
    rows = [np.arange(n) for n in (10, 5_000, 20, 9_000)]
    taken = language_id.shared_room(rows, 1_000)
    assert 990 <= len(taken) <= 1_000 and 8_999 in taken
    assert np.array_equal(language_id.shared_room(rows, 20_000), np.concatenate(rows))


def test_signs_of_higher_planes_are_no_letters(spark):
    learn = [(1, "a cat and a dog", "en"), (2, "ein Hund und eine Katze", "de")]
    model = language_id.fit(spark.createDataFrame(learn, "doc_id long, text string, lang string"), F.lit(True))
    names, scores = language_id.labeller(model)(["😀🎉", "12 😀 7", "😀 a cat", "𐌰𐌱"])
    assert names[:3] == ["und", "und", "en"] and names[3] != "und" and scores.tolist()[:2] == [0, 0] and scores[2] > 0
    assert language_id.symbols("a😀b", model["code"]).tolist() == language_id.symbols("a b", model["code"]).tolist()


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|a", "<\\\\|", "<|<|", "a\nb\\n", "<\n|", "<\\n|", "\\", "<", "|", ""])
def test_escapes(text):
    content, role = chat_format.escape(pa.array([text]))[0].as_py(), chat_format.escape_role(pa.array([text]))[0].as_py()
    assert chat_format.unescape(content) == text and chat_format.unescape_role(role) == text
    assert "<|" not in content + role and "\n" not in role


def test_assembly_against_joining():
    rng = random.Random(2)
    roles = ["user", "", "a" * 3000, "é"]
    turns = [(rng.choice(roles), "".join(rng.choice("ab<|\n\\é") for _ in range(rng.choice([0, 5, 3000])))) for _ in range(50)]
    data, begin = chat_format.assemble(pa.array([r for r, _ in turns]).slice(1), pa.array([t for _, t in turns]).slice(1))
    want = [f"<|im_start|>{r}\n{t}<|im_end|>\n".encode() for r, t in turns[1:]]
    assert data.tobytes() == b"".join(want) and np.diff(begin).tolist() == [len(w) for w in want]


def test_hilbert_curve():
    points = np.array(list(np.ndindex(8, 8, 8)))
    index = packing.hilbert(points, 3)
    walk = points[np.argsort(index)]
    assert sorted(index.tolist()) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_reparameterised_question(spark):
    item = "Yesterday the farmer Tom sold 12 apples and 30 pears for 5 dollars each at the market near Boston before noon."
    docs = [
        (1, "Noise before. Yesterday the farmer Bob sold 17 apples and 44 pears for 9 dollars each at the market near Denver before noon. Noise."),
        (2, "Yesterday the weather was fine and the farmer Tom went home with 12 apples."),
        (3, item.upper()), (4, item), (5, item.title()), (6, f"He said {item[0].lower()}{item[1:]}"),
    ]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
    got = {r.doc_id: r.exchanged for r in found.collect()}
    assert got.keys() == {1, 3, 4, 5, 6} and got[1] and not got[4]


def test_item_beside_passages_of_its_template(spark):
    """Occurrences are judged one by one: other values of the template elsewhere in the document do not hide an item."""
    say = "Yesterday the farmer {} sold {} apples and {} pears for {} dollars each at the market near {} before noon.".format
    item, bob, ann = say("Tom", 12, 30, 5, "Boston"), say("Bob", 17, 44, 9, "Denver"), say("Ann", 21, 63, 8, "Dallas")
    drill = "please add number 3 to the big sum now then please add number 8 to the big sum now then stop"
    split = item.replace("for 5", "for as much as 5")
    mixed = "Yesterday the farmer Bob sold 17 apples and 44 pears in town. The farmer Ann sold 63 apples and 21 pears for 8 dollars."
    docs = [(1, f"{item} {bob}"), (2, f"{bob} Some words. {ann}"), (3, drill), (4, f"{ann} And so on. {split}"), (5, f"{item} {bob} {ann} {item}"), (6, mixed)]
    docs += [(7, bob), (7, ann)]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, drill)], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert got.keys() == {(1, 1), (2, 1), (3, 2), (4, 1), (5, 1), (7, 1)} and len(got) == found.count()
    assert not got[1, 1].exchanged and got[2, 1].exchanged and not got[3, 2].exchanged


def test_items_without_template_windows(spark):
    """Short items, items of numbers and items in scripts without spaces are found inside longer documents."""
    items = [
        (1, "What is 12 + 35 * 4 - 8?"), (2, "Name the red planet"), (3, "12 7 9 33 48 51 60 72 85 96"), (4, "今天天气很好我们去公园玩"), (5, "why do the leaves fall in autumn"),
        (6, "Paris"), (7, "the store sold 12 red hats"), (8, "ไปเที่ยวทะเลกันไหม"), (9, "+ - *"), (10, "红色"),
    ]
    docs = [(i, f"Some noise before, and then: {text} And some noise of many words behind it.") for i, text in items]
    docs += [(21, "And what is 12 - 35 * 4 + 8? Say so."), (22, "name,\nthe red; planet and other things in the sky"), (23, "我说今天天气很好我们去公园玩吧，好不好"), (24, "I know that the store sold 95 red hats then")]
    docs += [(25, "NAME THE\nRED PLANET"), (26, "12 7 9 33 41 51 60 72 12 96"), (27, "What is 112 + 35 * 4 - 8? What is 12 + 35 * 4 - 80")]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.exchanged for r in found.collect()}
    assert got.keys() == {(i, i) for i, _ in items if i != 9} | {(23, 4), (24, 7), (25, 2)} and got[24, 7] and not got[7, 7]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1080)]
    parent = {x: x for p in pairs for x in p}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    rows = components.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.u: r.root for r in rows} == {x: find(x) for x in linked} and len(rows) == len(linked)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        both = rng.integers(0, 1 << 62, 2000).astype(np.uint64)
        extra = int(2000 * (1 - share) / share / 2)
        one, two = (np.unique(np.concatenate([both, rng.integers(0, 1 << 62, extra).astype(np.uint64)])) for _ in range(2))
        a, b = (np.frombuffer(minhash_dedup.sketch(x), np.uint8) for x in (one, two))
        assert abs(minhash_dedup.closeness(a, b[None, :])[0] - share) < 0.13


def test_large_near_copy_group(spark):
    """A group of distinct near copies is linked without its pairs, and its far members stay apart."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(300)]
    docs = []
    for d in range(300):
        words = list(base)
        for _ in range(4 if d % 5 else 30):
            words[rng.randrange(300)] = f"n{rng.random()}"
        docs.append((d, " ".join(words)))
    from test_queries import near_answer

    rows = minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == set(near_answer(docs))


def test_hot_text_is_cut_between_shards(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    rows = sharding.shard_by_bytes(docs, 10, pieces=3).groupBy("shard").agg(F.sum("size").alias("size"), F.max("slot").alias("last"), F.count_distinct("slot").alias("n")).collect()
    sizes = [r["size"] for r in rows]
    assert len(rows) == 10 and max(sizes) - min(sizes) <= 120 and all(r["last"] == r["n"] - 1 for r in rows)


def test_no_pair_of_small_sets_is_lost_to_the_sketch():
    """Seven and eight words share 3 of 4 shingles, exactly the threshold: few bins are filled, so all pairs pass; whole sets decide."""
    rng = random.Random(12)
    for _ in range(3000):
        words = [str(rng.random()) for _ in range(8)]
        a, b = minhash_dedup.shingles(" ".join(words[:7])), minhash_dedup.shingles(" ".join(words))
        marks = [np.frombuffer(minhash_dedup.sketch(x), np.uint8) for x in (a, b)]
        assert minhash_dedup.closeness(marks[0], marks[1][None])[1][0]
        share, may = minhash_dedup.whole_closeness(a, [b, a, b[:1]])
        assert share[0] == 0.75 and share[1] == 1 and may.tolist()[:2] == [True, True]


def test_later_links_join_components(spark):
    rng = random.Random(13)
    first = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(90)]
    more = [(rng.randint(0, 260), rng.randint(0, 260)) for _ in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "u long, v long")
    got = components.extended(components.components(frame(first)), frame(more)).collect()
    want = components.components(frame(first + more)).collect()
    assert len(got) == len({r.u for r in got}) and {tuple(r) for r in want} <= {tuple(r) for r in got}
    assert all(r.root == r.u for r in got if r.u not in {x.u for x in want})
    assert components.extended(components.components(frame([])), frame([])).collect() == []
