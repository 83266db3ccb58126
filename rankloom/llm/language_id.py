"""Operator 3, language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into sequences of STEPS bytes (the whole text, its last sequence shorter). Each sequence is read in both
directions by gated recurrent units; both states at a byte give that byte's language probabilities, and a document's
are their mean over all of its bytes. Training is numpy: backpropagation through time and Adam, on a bounded sample
of labelled rows. Inference is vectorised over many sequences at a time, with Spark dealing out the documents.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Nothing to learn from: all are ``und``.
Ties go to the language first in alphabetical order. Repeated rows repeat results; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hash_share, texts_of

STEPS, HIDDEN, SEQUENCES = 64, 8, 4096
#: Labelled rows of each language that training gathers at most (about), and characters of each that it uses.
ROWS_PER_LANGUAGE, CHARS_PER_ROW = 400, 1000
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteBiGRU:
    """Parameters by direction d (0 forward, 1 backward): E[d, byte] input terms of the gates z, r and the candidate c;
    U[d] recurrent weights of z and r; V[d] of c; out: both states to languages."""

    def __init__(self, n_out: int, hidden: int = HIDDEN, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "E": rng.normal(0, 0.4, (2, 256, 3 * hidden)).astype(np.float32),
            "U": rng.normal(0, 0.3, (2, hidden, 2 * hidden)).astype(np.float32),
            "V": rng.normal(0, 0.3, (2, hidden, hidden)).astype(np.float32),
            "W": rng.normal(0, 0.3, (2 * hidden, n_out)).astype(np.float32),
            "b": np.zeros(n_out, np.float32),
        }
        self.hidden = hidden

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions of x (rows, steps) with a language y each, and its gradients."""
        p, h, (n, steps) = self.p, self.hidden, x.shape
        both = np.stack([x, x[:, ::-1]])  # (2, rows, steps)
        state = np.zeros((2, n, h), np.float32)
        kept = []
        for t in range(steps):
            e = np.stack([p["E"][d][both[d, :, t]] for d in (0, 1)])
            zr = _sigmoid(e[..., : 2 * h] + state @ p["U"])
            z, r = zr[..., :h], zr[..., h:]
            c = np.tanh(e[..., 2 * h :] + (r * state) @ p["V"])
            new = state + z * (c - state)
            kept.append((state, z, r, c, new))
            state = new
        states = np.stack([k[4] for k in kept], 2)  # (2, rows, steps, h)
        f = np.concatenate([states[0], states[1][:, ::-1]], -1)
        s = f @ p["W"] + p["b"]
        s = np.exp(s - s.max(-1, keepdims=True))
        s /= s.sum(-1, keepdims=True)
        loss = -np.log(s[np.arange(n), :, y] + 1e-9).mean()
        s[np.arange(n), :, y] -= 1
        s /= n * steps
        g = {"W": np.einsum("nth,nto->ho", f, s), "b": s.sum((0, 1))} | {k: np.zeros_like(p[k]) for k in "EUV"}
        df = s @ p["W"].T
        down = np.stack([df[..., :h], df[:, ::-1, h:]])
        dh = np.zeros((2, n, h), np.float32)
        for t in reversed(range(steps)):
            before, z, r, c, _ = kept[t]
            dh = dh + down[:, :, t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - before) * z * (1 - z)
            back = dc @ p["V"].transpose(0, 2, 1)
            dr = back * before * r * (1 - r)
            dzr = np.concatenate([dz, dr], -1)
            g["V"] += (r * before).transpose(0, 2, 1) @ dc
            g["U"] += before.transpose(0, 2, 1) @ dzr
            for d in (0, 1):
                np.add.at(g["E"][d], both[d, :, t], np.concatenate([dzr[d], dc[d]], -1))
            dh = dh * (1 - z) + back * r + dzr @ p["U"].transpose(0, 2, 1)
        return float(loss), g

    def fit(self, x: np.ndarray, y: np.ndarray, batches: int = 160, rows: int = 192, rate: float = 0.02, seed: int = 6) -> list[float]:
        rng, m, v, losses = np.random.default_rng(seed), {}, {}, []
        for step in range(1, batches + 1):
            i = rng.integers(0, len(x), rows)
            loss, g = self.loss(x[i], y[i])
            losses.append(loss)
            for k, w in self.p.items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g[k]
                v[k] = 0.999 * v.get(k, 0) + 0.001 * g[k] ** 2
                w -= (rate * (1 - step / (batches + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return losses

    def positions(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities (steps, rows, languages) at every byte of x (rows, steps); rows go by falling length, bytes
        beyond a row's length are neither read nor filled."""
        p, h, (n, steps) = self.p, self.hidden, x.shape
        live = np.searchsorted(-lengths, -np.arange(steps), "left")  # rows with more than t bytes
        score = np.empty((steps, n, len(p["b"])), np.float32)
        x = np.ascontiguousarray(x.T)
        for d in (0, 1):
            e, u, v, w = p["E"][d], p["U"][d], p["V"][d], p["W"][d * h : (d + 1) * h]
            state = np.zeros((n, h), np.float32)
            for t in range(steps) if d == 0 else reversed(range(steps)):
                k = live[t]
                if not k:
                    continue
                now = state[:k]
                g = e.take(x[t, :k], 0)
                zr = g[:, : 2 * h] + now @ u
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                c = g[:, 2 * h :] + (zr[:, h:] * now) @ v
                np.tanh(c, out=c)
                c -= now
                c *= zr[:, :h]
                now += c
                if d == 0:
                    score[t, :k] = now @ w
                else:
                    s = score[t, :k]
                    s += now @ w
                    s += p["b"]
                    np.exp(s, out=s)
                    s /= s.sum(1, keepdims=True)
        return score

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (texts, languages) over all bytes of each text; an empty text has zeros."""
        total = np.zeros((len(texts), len(self.p["b"])))
        sizes = np.array([len(t) for t in texts], np.int64)
        parts = -(-sizes // STEPS)
        owner = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = (np.cumsum(sizes) - sizes)[owner] + nth * STEPS
        lengths = np.minimum(STEPS, sizes[owner] - nth * STEPS)
        buf = np.frombuffer(b"".join(texts) + bytes(STEPS), np.uint8)
        order = np.argsort(-lengths, kind="stable")
        for i in range(0, len(order), SEQUENCES):
            o = order[i : i + SEQUENCES]
            s = self.positions(buf[starts[o, None] + np.arange(STEPS)], lengths[o])
            for t in np.flatnonzero(np.arange(STEPS) >= lengths[o[-1]]) if len(o) else ():
                s[t, np.searchsorted(-lengths[o], -t, "left") :] = 0
            np.add.at(total, owner[o], s.sum(0))
        return total / np.maximum(sizes, 1)[:, None]


def label_positions(model: ByteBiGRU, languages: list[str], text: str) -> list[str]:
    """The likeliest language at every byte of a text."""
    raw = text.encode()
    x = np.frombuffer(raw + bytes(-len(raw) % STEPS), np.uint8).reshape(-1, STEPS)
    n = np.minimum(STEPS, len(raw) - np.arange(len(x)) * STEPS)
    s = model.positions(x, n).transpose(1, 0, 2)
    return [languages[k] for row, m in zip(s.argmax(-1), n) for k in row[:m]]


def training_rows(docs: DataFrame, usable: Column, rows_per_language: int = ROWS_PER_LANGUAGE) -> list[tuple[str, str]]:
    """About rows_per_language rows of each language at most, by the hash of their id: (text piece, language)."""
    known = docs.filter(usable & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.lit(False)
    for lang, n in counts.items():
        share = share | ((F.col("lang") == lang) & hash_share(F.col("doc_id"), rows_per_language, n))
    at = F.pmod(F.xxhash64("doc_id", F.lit("at")), F.greatest(F.length("text") - CHARS_PER_ROW, F.lit(1))).cast("int") + 1
    got = known.filter(share & F.col("text").isNotNull()).select(F.substring("text", at, F.lit(CHARS_PER_ROW)).alias("text"), "lang").collect()
    return sorted((r["text"], r["lang"]) for r in got)


def train(rows: list[tuple[str, str]], **options) -> tuple[ByteBiGRU | None, list[str]]:
    languages = sorted({lang for _, lang in rows})
    x, y = [], []
    for text, lang in rows:
        raw = text.encode()
        raw = raw * (STEPS // len(raw) + 1) if 0 < len(raw) < STEPS else raw
        k = len(raw) // STEPS
        x.append(np.frombuffer(raw[: k * STEPS], np.uint8).reshape(k, STEPS))
        y += [languages.index(lang)] * k
    if not y:
        return None, languages
    model = ByteBiGRU(len(languages))
    model.fit(np.concatenate(x), np.array(y), **options)
    return model, languages


def identify(docs: DataFrame, model: ByteBiGRU | None, languages: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text; the model (a few tens of kB) travels with the tasks."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, text_col)
        pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if model is not None and LETTER.search(t)]
        if todo:
            probs = model.documents([texts[i].encode() for i in todo])
            for i, k, s in zip(todo, probs.argmax(1).tolist(), probs.max(1).tolist()):
                pred[i], score[i] = languages[k], min(1.0, max(0.0, s))
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return arrow_map(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, lang_pred string, score double")
