"""Toxic passages by maximal scoring segments over token log-odds, with extreme-value calibration.

Log-odds of the words that toxic and clean texts hold carry an informative Dirichlet prior (the words' shares of both classes
together) and are drawn towards zero by their standard error. One linear scan of a document finds all maximal scoring
segments. A segment's expected number of chance occurrences is ``K * n * exp(-lambda * S)``: lambda solves
``E[exp(lambda * s)] = 1`` over clean tokens, K is set by the clean documents' best segments (Gumbel law). Segments whose
number is below ``SIGNIFICANT`` are passages. A logistic curve over the best and the summed evidence gives the score.

Words are hashed into ``BUCKETS`` counters, so the model's size is fixed. It is fitted on at most ``FIT_ROWS`` labelled rows,
those with the smallest id hash; a quarter of them is kept for calibration. Texts are scanned whole.

A null or empty text has no passage and gets the score of a text without evidence. Labels other than 0 and 1 are not used.
Without labelled rows of both classes every score is 0. Repeated rows get the same answer.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapwright.llm.common import Recent, map_rows, small_batches, texts

BUCKETS = 1 << 20
FIT_ROWS = 40_000
#: Tokens' worth of prior, and how many standard errors a log-odds loses.
PRIOR_TOKENS, ERRORS = 2000.0, 2.5
#: Subtracted from every token's score, so that segments end soon after their last telling word.
DRIFT = 0.25
SIGNIFICANT = 0.5
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
LIST_CHARS = 1 << 22


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) & (BUCKETS - 1)


def scores_of(weights: np.ndarray) -> Recent:
    """Word to score through the hashed table."""
    return Recent(lambda word: float(weights[bucket(word)]))


def token_scores(text: str, look: Recent) -> np.ndarray:
    lowered = text.lower()
    words = WORD.findall(lowered) if len(lowered) < LIST_CHARS else (m.group() for m in WORD.finditer(lowered))
    return np.fromiter(map(look.__getitem__, words), np.float64)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, past the last, score), in linear time.

    Only tokens above zero can begin a segment; between them the running sum is all that counts.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    begin: list[int] = []
    end: list[int] = []
    low: list[float] = []
    high: list[float] = []
    back: list[int] = []
    for at in np.flatnonzero(scores > 0).tolist():
        a, b, left, right = at, at + 1, float(sums[at]), float(sums[at + 1])
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= left:
                j = back[j]
            if j < 0 or high[j] >= right:
                begin.append(a), end.append(b), low.append(left), high.append(right), back.append(j)
                break
            a, left = begin[j], low[j]
            del begin[j:], end[j:], low[j:], high[j:], back[j:]
    return [(a, b, r - x) for a, b, x, r in zip(begin, end, low, high, strict=True)]


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Score of each bucket from its counts in the two classes; zero evidence gives only the drift."""
    both = toxic + clean
    prior = PRIOR_TOKENS * both / max(1.0, both.sum())
    a, b = toxic + prior, clean + prior
    n, m = a.sum(), b.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log(a / (n - a)) - np.log(b / (m - b))
        error = np.sqrt(1 / a + 1 / b)
        shrunk = np.sign(odds) * np.maximum(0, np.abs(odds) - ERRORS * error)
    return np.where(both > 0, np.nan_to_num(shrunk, posinf=0, neginf=0), 0.0) - DRIFT


def decay(weights: np.ndarray, clean: np.ndarray) -> float:
    """The positive root of E[exp(lambda * s)] = 1 over clean tokens."""
    share = (clean + 1e-3 * (weights > 0)) / (clean + 1e-3 * (weights > 0)).sum()
    on = share > 0
    w, p = weights[on], share[on]
    excess = lambda x: float(np.sum(p * np.exp(np.minimum(x * w, 700)))) - 1
    top = 1.0
    while excess(top) < 0 and top < 64:
        top *= 2
    bottom = 0.0
    for _ in range(60):
        middle = (bottom + top) / 2
        bottom, top = (middle, top) if excess(middle) < 0 else (bottom, middle)
    return (bottom + top) / 2


def evidence(scores: np.ndarray, model: dict) -> tuple[float, float, list[tuple[int, int, float]]]:
    """Best and summed ``-ln`` of the expected chance occurrences, and the passages with theirs."""
    found = segments(scores)
    room = np.log(max(1, len(scores))) + model["ln_k"]
    rated = [(a, b, model["decay"] * s - room) for a, b, s in found]
    best = max((e for _, _, e in rated), default=-room)
    passages = [x for x in rated if x[2] > -np.log(SIGNIFICANT)]
    return best, sum(e for _, _, e in passages), passages


def features(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(best)), np.clip(best, -10, 30), np.log1p(np.clip(total, 0, 1e6))])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Penalised maximum likelihood by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0, *[1e-2] * (x.shape[1] - 1)]) + 1e-6 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model from labelled rows where ``learn`` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.where(learn & labels["toxic"].isin(0, 1) & labels[id_col].isNotNull()).select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most FIT_ROWS pairs of numbers are broadcast, whatever the size of the tables.
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = texts(docs, id_col, text_col).join(F.broadcast(marked), "doc_id")
    # A text with many copies, or a word that fills one text, is one observation.
    rows = rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    tuning = F.pmod(F.xxhash64("doc_id", F.lit("tune")), F.lit(4)) == 0

    def make():
        def count(batch: pa.RecordBatch) -> dict:
            totals: dict[tuple[str, int], int] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word in set(WORD.findall(text.lower())):
                    totals[word, toxic] = totals.get((word, toxic), 0) + 1
            slots: dict[int, list[int]] = {}
            for (word, toxic), n in totals.items():
                slots.setdefault(bucket(word), [0, 0])[toxic] += n
            return {"slot": pa.array(list(slots), pa.int32()), "clean": pa.array([v[0] for v in slots.values()], pa.int64()), "toxic": pa.array([v[1] for v in slots.values()], pa.int64())}

        return count

    counted = map_rows(rows.where(~tuning).select("text", "toxic"), make, "slot int, clean long, toxic long")
    sums = counted.groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    clean, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = sums.column("slot").to_numpy()
    clean[at], toxic[at] = sums.column("clean").to_numpy(), sums.column("toxic").to_numpy()
    model: dict = {"weights": np.zeros(BUCKETS, np.float32) - DRIFT, "decay": 1.0, "ln_k": 0.0, "curve": np.array([-30.0, 0, 0])}
    if not toxic.any() or not clean.any():
        return model
    weights = log_odds(toxic, clean)
    model |= {"weights": weights.astype(np.float32), "decay": decay(weights, clean)}
    shared = spark.sparkContext.broadcast(model)

    def make_rating():
        look = scores_of(shared.value["weights"])

        def rate(batch: pa.RecordBatch) -> dict:
            found = [(max((s for _, _, s in segments(x)), default=0.0), len(x)) for x in (token_scores(t, look) for t in batch.column(0).to_pylist())]
            return {"best": [s for s, _ in found], "n": [float(n) for _, n in found], "toxic": batch.column(1)}

        return rate

    held = map_rows(rows.where(tuning).select("text", "toxic"), make_rating, "best double, n double, toxic int").toArrow()
    best, n, y = (held.column(c).to_numpy() for c in ("best", "n", "toxic"))
    if not (y == 0).any() or not (y == 1).any():
        return model
    # Gumbel: the mean of lambda * S - ln n over clean documents is ln K plus Euler's constant.
    quiet = (y == 0) & (n > 0)
    model["ln_k"] = float(np.clip(np.mean(model["decay"] * best[quiet] - np.log(n[quiet])) - np.euler_gamma, -8, 2)) if quiet.any() else 0.0

    small = {k: model[k] for k in ("decay", "ln_k")}
    held = map_rows(rows.where(tuning).select("text", "toxic"), rating_maker(shared, small), "best double, total double, toxic int").toArrow()
    best, total, y = (held.column(c).to_numpy() for c in ("best", "total", "toxic"))
    model["curve"] = logistic(features(best, total), y.astype(float))
    return model


def rating_maker(shared, small: dict):
    def make():
        look = scores_of(shared.value["weights"])

        def rate(batch: pa.RecordBatch) -> dict:
            found = [evidence(token_scores(t, look), small)[:2] for t in batch.column(0).to_pylist()]
            return {"best": [float(a) for a, _ in found], "total": [float(b) for _, b in found], "toxic": batch.column(1)}

        return rate

    return make


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` and the passages: code points from and to, with their evidence."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = texts(docs, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))

    def make():
        model = shared.value
        look = scores_of(model["weights"])

        def work(batch: pa.RecordBatch) -> dict:
            found = []
            for text in batch.column(1).to_pylist():
                best, total, spans = evidence(token_scores(text, look), model)
                found.append((best, total, places(text, spans) if spans else []))
            x = features(np.array([b for b, _, _ in found]), np.array([t for _, t, _ in found]))
            p = 1 / (1 + np.exp(-np.clip(x @ model["curve"], -30, 30)))
            return {"doc_id": batch.column(0), "score": p, "predicted": (p >= 0.5).astype(np.int32), "passages": pa.array([s for _, _, s in found], passage)}

        return work

    return map_rows(narrow, make, f"doc_id {kind}, score double, predicted int, passages array<struct<start:long,end:long,evidence:double>>")


def places(text: str, spans: list[tuple[int, int, float]]) -> list[dict]:
    """Token numbers to code points of the text itself."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter whose lower case is longer; its upper case is looked through instead
        lowered = text
    at = [(m.start(), m.end()) for m in WORD.finditer(lowered)]
    return [{"start": at[min(a, len(at) - 1)][0], "end": at[min(b, len(at)) - 1][1], "evidence": float(e)} for a, b, e in spans]
