"""Personal data: fixed patterns, and a skip-chain conditional random field for what they miss.

Base matches come from the patterns below. Mentions are the base matches and other number or address like strings; each is
a node with a label (none, email, ip, card, phone). Node potentials are a log-linear model over the mention's form and the
word before it, learned from base matches; neighbours in the text share a chain potential; distant mentions with the same or
similar value (same digits, same last digits, same local part) share a skip potential that favours equal labels. Loopy
message passing runs over the nodes of many documents at once; base nodes are observed. A node that is then clearly
personal data is added, so ``(743) 555-3824`` follows ``+1 (743) 555-3824`` elsewhere in its document.

The model is fitted on at most ``FIT_ROWS`` rows (smallest text hash). All patterns take linear time; texts are read whole.
Null and empty texts have no spans. Repeated rows get the same spans. Without any mention nothing is added.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.llm.common import map_rows, small_batches, texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
FIT_ROWS = 40_000
#: Log weight of equal labels on a skip edge; log weight for "none" where the patterns found nothing; share of label
#: noise; how sure an added span must be; rounds of messages.
SKIP, REJECTED, NOISE, SURE, ROUNDS = 4.0, 2.0, 0.12, 0.8, 30

# The base patterns, without backtracking. Addresses are anchored at the sign and widened to the left.
ADDRESS = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

NUMERIC = re.compile(r"[0-9]")
#: Other mentions: numbers of seven digits and more, dotted numbers, addresses with a written sign.
NUMBER_LIKE = re.compile(r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+")
DOTTED = re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3,}+")
WRITTEN_SIGN = re.compile(r"\x20?(?:\[at\]|\(at\)|@)\x20?(?=[A-Za-z0-9-]{1,64})", re.IGNORECASE)
LEFT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
RIGHT = re.compile(r"[A-Za-z0-9-]{1,64}(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]{1,64}){1,8}", re.IGNORECASE)
BEFORE = re.compile(r"([^\W\d_]{1,24})[^\w]{0,4}\Z")

# Words before a number or address that say what it is.
CUES = {
    "mail": "mail", "email": "mail", "e-mail": "mail", "contact": "mail", "ip": "ip", "host": "ip", "server": "ip", "address": "ip",
    "card": "card", "visa": "card", "mastercard": "card", "credit": "card", "tel": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mobile": "phone",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    found = []
    last = 0
    if "@" in text:
        for m in ADDRESS.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found.append((0, start, m.end()))
                last = m.end()
    if not NUMERIC.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = digits_of(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(digits_of(m.group())) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(label, start, end) in text order: base matches with their label, and other mentions that touch none of them with 0."""
    out = [(k + 1, a, b) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in out)
    others: list[tuple[int, int]] = []
    if NUMERIC.search(text):
        others += [(m.start(), m.end()) for m in DOTTED.finditer(text)]
        others += [(m.start(), m.end()) for m in NUMBER_LIKE.finditer(text)]
    lowered = text if "@" in text else text.lower()
    if "@" in text or "[at]" in lowered or "(at)" in lowered:
        for m in WRITTEN_SIGN.finditer(text):
            left, right = LEFT.search(text, max(0, m.start() - 64), m.start()), RIGHT.match(text, m.end())
            if left and right:
                others.append((left.start(), right.end()))
    others.sort(key=lambda x: (x[0], -x[1]))
    at, reach = 0, 0
    for a, b in others:
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= reach and (at == len(taken) or taken[at][0] >= b):
            out.append((0, a, b))
            reach = b
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def form(text: str, start: int, end: int) -> tuple[str, ...]:
    """Features of a mention: how it is written and what stands before it."""
    value = text[start:end]
    digits = digits_of(value)
    cue = BEFORE.search(text, max(0, start - 32), start)
    lowered = value.lower()
    return (
        f"sign:{'@' if '@' in value else 'at' if 'at]' in lowered or 'at)' in lowered else ''}",
        f"plus:{value[0] == '+'}", f"digits:{min(len(digits), 20)}", f"dots:{min(value.count('.'), 4)}", f"brackets:{'(' in value}",
        f"dashes:{min(value.count('-'), 3)}", f"spaces:{min(value.count(' '), 3)}", f"sum:{len(digits) >= 16 and luhn(digits[:19])}", f"cue:{CUES.get(cue[1].lower(), '') if cue else ''}",
    )


def keys_of(text: str, start: int, end: int) -> list[str]:
    """Values by which distant mentions are the same or similar."""
    value = text[start:end].lower()
    if "@" in value or "at]" in value or "at)" in value:
        return ["local:" + re.split(r"\s?(?:@|\[at\]|\(at\))", value)[0]]
    digits = digits_of(value)
    return [f"digits:{digits}", f"last:{digits[-7:]}"] if "." not in value or value.count(".") != 3 else [f"digits:{value}"]


def edges_of(text: str, nodes: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours; skip edges between successive mentions that share a value."""
    seen: dict[str, int] = {}
    skip: set[tuple[int, int]] = set()
    for k, (_, a, b) in enumerate(nodes):
        for key in keys_of(text, a, b):
            if key in seen:
                skip.add((seen[key], k))
            seen[key] = k
    return [(k, k + 1) for k in range(len(nodes) - 1)], sorted(skip)


def propagate(unary: np.ndarray, edges: np.ndarray, factors: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals by loopy message passing. ``factors`` has one table per edge; messages are log values, damped by half."""
    n, width = unary.shape
    if not len(edges):
        logs = unary
    else:
        tail, head = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        table = np.concatenate([factors, factors.transpose(0, 2, 1)])
        half = len(edges)
        reverse = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        sent = np.zeros((2 * half, width))
        for _ in range(rounds):
            arrived = unary.copy()
            np.add.at(arrived, head, sent)
            outgoing = (arrived[tail] - sent[reverse])[:, :, None] + table
            top = outgoing.max(axis=1)
            new = top + np.log(np.exp(outgoing - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - sent).max()
            sent = (sent + new) / 2
            if change < 1e-4:
                break
        logs = unary.copy()
        np.add.at(logs, head, sent)
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, text_col: str = "text") -> dict:
    """Weights of the features and of neighbouring labels, from counts over a bounded sample."""
    small_batches(docs.sparkSession)
    narrow = texts(docs.withColumn("doc_id", F.lit(0)) if "doc_id" not in docs.columns else docs, "doc_id", text_col).select("text").where(F.col("text").rlike("[0-9@]"))
    # Hashes alone are ordered; then only the chosen texts are read on.
    last = narrow.select(F.xxhash64("text").alias("mark")).distinct().orderBy("mark").limit(FIT_ROWS).agg(F.max("mark")).first()[0]
    if last is None:
        return {"weights": {}, "chain": np.zeros((len(LABELS), len(LABELS)))}
    chosen = narrow.where(F.xxhash64("text") <= last).distinct()

    def make():
        def count(batch: pa.RecordBatch) -> dict:
            counts: dict[tuple[str, int], int] = {}
            for text in batch.column(0).to_pylist():
                nodes = mentions(text, base_spans(text))
                before = None
                for label, a, b in nodes:
                    key = ("form\t" + "\t".join(form(text, a, b)), label)
                    counts[key] = counts.get(key, 0) + 1
                    if before is not None:
                        counts[f"chain\t{before}", label] = counts.get((f"chain\t{before}", label), 0) + 1
                    before = label
            return {"what": pa.array([w for w, _ in counts], pa.string()), "label": pa.array([n for _, n in counts], pa.int32()), "n": pa.array(list(counts.values()), pa.int64())}

        return count

    # Forms and pairs of labels are few by their make: every feature has at most some twenty values.
    counted = map_rows(chosen, make, "what string, label int, n long").groupBy("what", "label").agg(F.sum("n").alias("n")).collect()
    chain = np.ones((len(LABELS), len(LABELS)))
    forms: dict[tuple[str, ...], np.ndarray] = {}
    for what, label, n in sorted(counted):
        kind, *rest = what.split("\t")
        if kind == "chain":
            chain[int(rest[0]), label] += n
        else:
            forms.setdefault(tuple(rest), np.zeros(len(LABELS)))[label] += n
    lift = np.log(chain * chain.sum() / (chain.sum(axis=1, keepdims=True) * chain.sum(axis=0, keepdims=True)))
    return {"weights": log_linear(forms), "chain": np.clip(lift, -1, 1) / 2}


def log_linear(forms: dict[tuple[str, ...], np.ndarray]) -> dict[str, np.ndarray]:
    """Penalised multinomial weights by gradient steps; unmatched mentions may be personal data after all (``NOISE``)."""
    names = sorted({f for key in forms for f in key})
    at = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(forms), len(names) + 1))
    y = np.zeros((len(forms), len(LABELS)))
    for r, (key, counts) in enumerate(sorted(forms.items())):
        x[r, [at[f] for f in key]] = 1
        x[r, -1] = 1
        y[r] = counts
        y[r, 1:] += NOISE * counts[0] / len(KINDS)
        y[r, 0] *= 1 - NOISE
    weight = np.sqrt(y.sum(axis=1, keepdims=True))  # a form seen very often should not drown the others
    share = y / np.maximum(y.sum(axis=1, keepdims=True), 1e-9)
    w = np.zeros((x.shape[1], len(LABELS)))
    step = 4.0 / max(1.0, float((weight * (x**2).sum(axis=1, keepdims=True)).sum()))
    momentum = np.zeros_like(w)
    for _ in range(2000):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        momentum = 0.9 * momentum + x.T @ (weight * (share - p)) - 0.05 * w
        w += step * momentum
    out = {f: w[k] for f, k in at.items()}
    out["bias"] = w[-1]
    return out


def added(batch: list[str], base: list[list[tuple[int, int, int]]], model: dict) -> list[list[tuple[int, int, int]]]:
    """Further (kind, start, end) of each text: one graph for all texts of the batch."""
    owner, label, spans, unary, edges, factors = [], [], [], [], [], []
    weights, chain = model["weights"], model["chain"]
    agree = np.eye(len(LABELS)) * SKIP
    agree[0, 0] = 0.0  # two mentions without a label say nothing about each other
    for r, text in enumerate(batch):
        nodes = mentions(text, base[r])
        if all(k for k, _, _ in nodes):
            continue  # nothing but base matches
        first = len(spans)
        for k, a, b in nodes:
            owner.append(r), label.append(k), spans.append((a, b))
            unary.append(weights.get("bias", 0) + sum(weights.get(f, 0) for f in form(text, a, b)) + np.zeros(len(LABELS)))
        near, far = edges_of(text, nodes)
        edges += [(first + a, first + b) for a, b in near + far]
        factors += [chain] * len(near) + [agree] * len(far)
    out: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    if not spans:
        return out
    logs, seen = np.array(unary), np.array(label)
    logs[seen == 0, 0] += REJECTED
    logs[seen > 0] = -50.0
    logs[np.flatnonzero(seen > 0), seen[seen > 0]] = 0.0
    p = propagate(logs, np.array(edges, np.int64).reshape(-1, 2), np.array(factors).reshape(-1, len(LABELS), len(LABELS)))
    for k in np.flatnonzero((seen == 0) & (p[:, 1:].max(axis=1) >= SURE)).tolist():
        out[owner[k]].append((int(p[k, 1:].argmax()), *spans[k]))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base matches, and all spans, of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = texts(docs, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            held = batch.column(1).to_pylist()
            base = [base_spans(t) for t in held]
            more = added(held, base, shared.value)
            counts = np.array([[sum(k == j for k, _, _ in b) for j in range(len(KINDS))] for b in base], np.int64)
            return {
                "doc_id": batch.column(0), **{f"n_{k}": counts[:, j] for j, k in enumerate(KINDS)},
                "base_sha256": [hashlib.sha256(written(b).encode()).hexdigest() for b in base], "spans": [written(b + m) for b, m in zip(base, more, strict=True)],
                "n_added": np.array([len(m) for m in more], np.int64),
            }

        return work

    return map_rows(narrow, make, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
