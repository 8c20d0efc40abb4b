"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_groups, map_arrow, utf8_rows

HIDDEN = 16
CORE = 448  # bytes of a text that a sequence labels
CONTEXT = 32  # bytes before and after them that are read on the way in and not labelled again
LEARNT = 64  # bytes of a training sequence
SAMPLE_ROWS = 400  # labelled rows of each language that are fitted, those of the least id hashes
STEPS = 400
BATCH = 128
TOGETHER = 1024
RATE = 0.01
SALTS = 64
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def windows(data: bytes) -> list[tuple[bytes, int, int]]:
    """Sequences that cover a text: their bytes, and from where to where in them they label."""
    out = []
    for at in range(0, len(data), CORE):
        low, stop = max(0, at - CONTEXT), min(len(data), at + CORE)
        out.append((data[low : stop + CONTEXT], at - low, stop - low))
    return out


def padded(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix (time, piece) and mask."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    inside = np.arange(int(sizes.max(initial=1)))[:, None] < sizes
    data = np.zeros(inside.shape, np.int64)
    data.T[inside.T] = np.frombuffer(b"".join(pieces), np.uint8)
    return data, inside


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    """Weights. Of each direction d: W[d] (byte -> update, reset, candidate input), U[d] (state -> update, reset), V[d] (reset state -> candidate). Out: O, c."""

    labels: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"W{d}"] = r.normal(0, 0.3, (256, 3 * hidden))
            w[f"U{d}"] = r.normal(0, hidden**-0.5, (hidden, 2 * hidden))
            w[f"V{d}"] = r.normal(0, hidden**-0.5, (hidden, hidden))
        w["O"] = r.normal(0, hidden**-0.5, (2 * hidden, len(labels)))
        w["c"] = np.zeros(len(labels))
        return cls(labels, {k: x.astype(np.float32) for k, x in w.items()})

    def _run(self, d: str, data: np.ndarray, mask: np.ndarray, keep: bool):
        """States after each step of one direction, and with keep what the way back needs. Padding leaves the state."""
        w, u, v = (self.weights[k + d] for k in "WUV")
        h = len(v)
        state = np.zeros((data.shape[1], h), np.float32)
        states, trail = np.zeros((*data.shape, h), np.float32), []
        for t in range(len(data)) if d == "f" else range(len(data) - 1, -1, -1):
            x = w[data[t]]
            gates = _sigmoid(x[:, : 2 * h] + state @ u)
            update, reset = gates[:, :h], gates[:, h:]
            past = reset * state
            new = np.tanh(x[:, 2 * h :] + past @ v)
            on = mask[t][:, None]
            following = np.where(on, state + update * (new - state), state)
            if keep:
                trail.append((t, state, update, reset, past, new))
            states[t] = state = following
        return states, trail

    def positions(self, data: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log-probabilities of the labels at every position."""
        both = np.concatenate([self._run(d, data, mask, False)[0] for d in "fb"], axis=2)
        score = both @ self.weights["O"] + self.weights["c"]
        score -= score.max(axis=2, keepdims=True)
        return score - np.log(np.exp(score).sum(axis=2, keepdims=True))

    def gradients(self, data: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the positions, and its gradients by back-propagation through time."""
        runs = {d: self._run(d, data, mask, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        score = both @ self.weights["O"] + self.weights["c"]
        score -= score.max(axis=2, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=2, keepdims=True)
        n = max(1, int(mask.sum()))
        at = np.take_along_axis(p, np.broadcast_to(label[None, :, None], (*data.shape, 1)), axis=2)[..., 0]
        loss = float(-(np.log(np.maximum(at, 1e-9)) * mask).sum() / n)
        back = p.copy()
        back[:, np.arange(len(label)), label] -= 1
        back *= mask[:, :, None] / n
        g = {k: np.zeros_like(x) for k, x in self.weights.items()}
        g["O"] = np.einsum("tbh,tbl->hl", both, back)
        g["c"] = back.sum(axis=(0, 1))
        into = back @ self.weights["O"].T
        h = len(self.weights["Vf"])
        for k, d in enumerate("fb"):
            u, v = self.weights["U" + d], self.weights["V" + d]
            carried = np.zeros((data.shape[1], h), np.float32)
            for t, state, update, reset, past, new in reversed(runs[d][1]):
                total = carried + into[t][:, k * h : (k + 1) * h]
                on = mask[t][:, None]
                inner = total * on
                d_new = inner * update * (1 - new * new)
                d_past = d_new @ v.T
                d_update = inner * (new - state) * update * (1 - update)
                d_reset = d_past * state * reset * (1 - reset)
                d_gates = np.concatenate([d_update, d_reset], axis=1)
                g["U" + d] += state.T @ d_gates
                g["V" + d] += past.T @ d_new
                np.add.at(g["W" + d], data[t], np.concatenate([d_gates, d_new], axis=1) * on)
                carried = np.where(on, inner * (1 - update) + d_past * reset + d_gates @ u.T, total)
        return loss, g

    def _scores(self, d: str, data: np.ndarray, live: np.ndarray, out: np.ndarray) -> None:
        """Add one direction's part of the scores. The sequences are ordered from long to short: live[t] of them have a byte t.

        numpy's exponential takes half the time of its hyperbolic tangent. A gate is 1 / (1 + exp(-x)), so what it lets through is divided by 1 + exp(-x), and
        tanh(x) is 1 - 2 / (1 + exp(2 x)); signs and the 2 go into the weights. An exponential that overflows gives the gate 0 and the tangent 1, as it should.
        Both gates are worked out at once; buffers are reused from step to step.
        """
        v = self.weights["V" + d]
        h, one, minus_two = len(v), v.dtype.type(1), v.dtype.type(-2)
        o = self.weights["O"][slice(0, h) if d == "f" else slice(h, 2 * h)]
        w, u, v = self.weights["W" + d], self.weights["U" + d], v + v
        w_gates = -w[:, :h], -w[:, h : 2 * h]
        w_new = w[:, 2 * h :] + w[:, 2 * h :]
        u = np.stack([-u[:, :h], -u[:, h:]])
        state = np.zeros((data.shape[1], h), w.dtype)
        buffers = np.empty((5, *state.shape), w.dtype)
        for t in range(len(data)) if d == "f" else range(len(data) - 1, -1, -1):
            m = live[t]
            byte, on = data[t, :m], state[:m]
            gates, product, new = buffers[:2, :m], buffers[2:4, :m], buffers[4, :m]
            for k in range(2):
                np.take(w_gates[k], byte, axis=0, out=gates[k], mode="clip")
            gates += np.matmul(on, u, out=product)
            np.exp(gates, out=gates)
            gates += one
            update, past = gates
            np.divide(on, past, out=past)
            np.take(w_new, byte, axis=0, out=new, mode="clip")
            new += np.matmul(past, v, out=product[0])
            np.exp(new, out=new)
            new += one
            np.divide(minus_two, new, out=new)
            new -= on
            new += one
            new /= update
            on += new
            out[t, :m] += on @ o

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """For each text: summed log-probabilities, summed probabilities, and positions. Every byte is a position."""
        cut = [(*piece, k) for k, t in enumerate(texts) for piece in windows(t)]
        cut.sort(key=lambda x: -len(x[0]))
        n = len(self.labels)
        out = np.zeros((len(texts), 2 * n + 1))
        for at in range(0, len(cut), TOGETHER):
            raw, first, stop, owner = zip(*cut[at : at + TOGETHER], strict=True)
            data, inside = padded(list(raw))
            live = inside.sum(axis=1).tolist()
            score = np.tile(self.weights["c"], (*data.shape, 1))
            with np.errstate(over="ignore"):
                for d in "fb":
                    self._scores(d, data, live, score)
            # Labels first: numpy goes along long rows, where a few labels each would be a short one.
            score = np.ascontiguousarray(score.reshape(-1, n).T).reshape(n, *data.shape)
            score -= score.max(axis=0)
            p = np.exp(score)
            total = p.sum(axis=0)
            step = np.arange(len(data))[:, None]
            mine = ((step >= np.array(first)) & (step < np.array(stop))).astype(score.dtype)
            share = np.divide(mine, total)
            np.log(total, out=total)
            total *= mine
            gone = total.sum(axis=0)
            logs = np.stack([np.einsum("tb,tb->b", x, mine) - gone for x in score], axis=1)
            rows = [logs, np.stack([np.einsum("tb,tb->b", x, share) for x in p], axis=1), mine.sum(axis=0)[:, None]]
            np.add.at(out, list(owner), np.concatenate(rows, axis=1))
        return out


def train(samples: list[tuple[str, str]], steps: int = STEPS, seed: int = 7) -> Network:
    """Fit the network on (text, language) samples, cut into sequences of LEARNT bytes; every position has its text's language."""
    labels = sorted({lang for _, lang in samples})
    net = Network.fresh(labels, seed=seed)
    runs, owner = [], []
    for text, lang in samples:
        raw = text.lower().encode()
        cut = [raw[at : at + LEARNT] for at in range(0, len(raw), LEARNT)]
        runs += cut
        owner += [labels.index(lang)] * len(cut)
    if len(labels) < 2 or not runs:
        return net
    owner = np.array(owner)
    # A language's share of the batches is the same whatever its share of the samples.
    by_label = [np.flatnonzero(owner == k) for k in range(len(labels))]
    by_label = [x for x in by_label if len(x)]
    r = np.random.default_rng(seed)
    first = {k: np.zeros_like(x) for k, x in net.weights.items()}
    second = {k: np.zeros_like(x) for k, x in net.weights.items()}
    for step in range(1, steps + 1):
        chosen = np.concatenate([r.choice(x, BATCH // len(by_label) + 1) for x in by_label])
        data, mask = padded([runs[k] for k in chosen])
        _, g = net.gradients(data, mask, owner[chosen])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, x in net.weights.items():
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            x -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def training_rows(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows, whole: of each language the rows of the least id hashes.

    The greatest hash of each sample is found from the hashes alone, first in SALTS parts of each language, so that a
    language that most rows have is not one task's. The driver holds a number for each language, as the network does.
    """
    ranked = docs.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("doc_id").alias("h"))
    least = ranked.select("lang", "h", (F.spark_partition_id() % SALTS).alias("salt"))
    for keys in (["lang", "salt"], ["lang"]):
        least = least.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("k") <= rows)
    last = {r.lang: r.h for r in least.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    if not last:
        return []
    bound = F.create_map(*(F.lit(x) for item in sorted(last.items()) for x in item))
    near = ranked.where(F.col("h") <= F.element_at(bound, F.col("lang")))
    kept = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= rows)
    return [(r.text, r.lang) for r in kept.select("text", "lang").orderBy("lang", "text").collect()]


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, rows: int = SAMPLE_ROWS, steps: int = STEPS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    The network is fitted on a sample of the rows that are not held out (400 rows of each language, a
    parameter). It reads the bytes of the whole lower-cased text forwards and backwards, across words and whatever
    they are, and gives every byte a distribution over the languages; a document's language is that of the greatest
    sum of log-probabilities over all its positions (of equal sums the first label), and score is the mean probability of it. Long texts are
    read in sequences that label 448 bytes each and begin and end 32 bytes outside them. Only the text is read here, so
    equal texts have equal predictions; a null text or one without a letter is `und` with score 0, as is every text when no row is labelled.
    """
    net = train(training_rows(docs.where(~held_out(F.col("doc_id"))), rows), steps)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        net = sent.value
        n = len(net.labels)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = [], []
            for group in in_groups(((t or b"").decode() for t in utf8_rows(batch.column(1))), len):
                lettered = [bool(n and _LETTER.search(t)) for t in group]
                sums = net.texts([t.lower().encode() if on else b"" for t, on in zip(group, lettered, strict=True)])
                for row, on in zip(sums, lettered, strict=True):
                    best = int(np.argmax(row[:n])) if on else 0
                    langs.append(net.labels[best] if on else UNKNOWN)
                    scores.append(min(1.0, float(row[n + best] / row[-1])) if on else 0.0)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

        return each

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return map_arrow(rows_, make, "doc_id long, held_out boolean, lang_pred string, score double")
