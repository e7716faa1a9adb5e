"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A text is read as overlapping windows of words, of which long ones are cut into overlapping pieces. Each word enters as
the sum of a hashed word vector and hashed vectors of its character n-grams (bytes, of two lengths), so that spelling
variants and inflected forms share what is learnt. A gated recurrent layer runs over the window
in either direction, attention weighs its states, and a logistic unit scores the pooled state. A text's score is the
highest among its windows, since one passage makes a text toxic; it is calibrated on the training labels.

Training uses a bounded sample of the labelled rows (``SAMPLE`` rows of each class at most, chosen by a hash of the id)
in one Spark task. Labels say nothing about where a text is toxic: each round scores all windows of the sample and
learns from the window that scores highest in each text. Scoring covers all windows of all texts.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_column, utf8, written

#: Labelled rows of each class that training reads at most.
SAMPLE = 1200
WINDOW, STRIDE = 32, 24
#: Bytes of a word at most, and how far apart the pieces of longer ones begin.
LONG, STEP = 64, 48
#: Vectors for words and for character n-grams, the n-grams' bytes, vectors' length, and the states in each direction.
WORDS, GRAMS, SIZES, INPUT, STATES = 1 << 14, 1 << 14, (3, 5), 8, 8
#: Rounds of choosing windows, steps in each, their rate, and the share of that rate at which vectors move.
ROUNDS, STEPS, RATE, VECTORS = 5, 60, 0.02, 0.02
THRESHOLD = 0.3
#: Words whose inputs are remembered in a worker; beyond that the memory starts anew.
REMEMBERED = 200_000
#: Windows that are scored at once.
BATCH = 4096

FIELDS = "score double, predicted int"
_STRIP = b".,;:!?\"'()[]{}<>|*#$%&"


def words_of(text: bytes) -> list[bytes]:
    """The words between ASCII white space; one of over LONG bytes is cut into overlapping pieces, each a word of its own."""
    words = text.split()
    if len(text) <= LONG or max(map(len, words), default=0) <= LONG:
        return words
    return [w[k : k + LONG] for w in words for k in range(0, max(1, len(w) - LONG + STEP), STEP)]


def word_features(word: bytes) -> tuple[int, list[int]]:
    """A word's slot and its n-grams' slots, after lower-casing A-Z and dropping punctuation at the ends."""
    from xxhash import xxh32_intdigest

    core = word.lower().strip(_STRIP) or word
    marked = b"^" + core + b"$"
    grams = [xxh32_intdigest(marked[k : k + n], 7) % GRAMS for n in SIZES for k in range(len(marked) - n + 1)]
    return xxh32_intdigest(core) % WORDS, grams or [xxh32_intdigest(marked, 7) % GRAMS]


class Network:
    """The weights, scoring, and gradients."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        w = {"words": normal(WORDS, INPUT, s=0.05), "grams": normal(GRAMS, INPUT, s=0.05)}
        for side in "fb":
            w[f"{side}_x"] = normal(INPUT, 3 * STATES, s=0.4)
            w[f"{side}_h"] = normal(STATES, 3 * STATES, s=0.25)
            w[f"{side}_b"] = np.zeros(3 * STATES, np.float32)
        w |= {"attend": normal(2 * STATES, s=0.3), "out": normal(2 * STATES, s=0.3), "bias": np.array([-1.0, 1.0, 0.0], np.float32)}  # bias, scale and shift of the calibration
        return cls(w)

    @classmethod
    def loads(cls, data: bytes) -> Network:
        with np.load(io.BytesIO(data)) as file:
            return cls({k: file[k] for k in file.files})

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.w)
        return out.getvalue()

    def inputs(self, words: Iterable[bytes]) -> np.ndarray:
        """The input vector of each word."""
        slots, grams, sizes = [], [], []
        for word in words:
            slot, parts = word_features(word)
            slots.append(slot)
            grams += parts
            sizes.append(len(parts))
        if not slots:
            return np.zeros((0, INPUT), np.float32)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mean = np.add.reduceat(self.w["grams"][grams], starts, axis=0) / np.sqrt(np.array(sizes, np.float32))[:, None]
        return self.w["words"][slots] + mean

    def _run(self, side: str, gates: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (time, window, state) in one direction; ``gates`` holds the inputs' share of the gates."""
        t, n, _ = gates.shape
        u, h = self.w[f"{side}_h"], np.zeros((n, STATES), np.float32)
        out, steps = np.empty((t, n, STATES), np.float32), []
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            part = h @ u
            zr = gates[k, :, : 2 * STATES] + part[:, : 2 * STATES]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :STATES], zr[:, STATES:]
            c = r * part[:, 2 * STATES :]
            c += gates[k, :, 2 * STATES :]
            np.tanh(c, out=c)
            new = c - h
            new *= z
            if not mask[k].all():
                new *= mask[k][:, None]
            new += h
            if keep:
                steps.append((k, h, z, r, c, part[:, 2 * STATES :]))
            h = out[k] = new
        return out, steps

    def gates(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        return {side: inputs @ self.w[f"{side}_x"] + self.w[f"{side}_b"] for side in "fb"}

    def forward(self, gates: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Logits of windows; ``gates`` by direction and ``mask``, both (time, window, ...)."""
        (f, fs), (b, bs) = (self._run(side, gates[side], mask, keep) for side in "fb")
        s = np.concatenate([f, b], axis=2)
        e = np.where(mask, s @ self.w["attend"], np.float32(-30))
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tns->ns", a, s)
        return pooled @ self.w["out"] + self.w["bias"][0], (s, a, pooled, fs, bs)

    def backward(self, grad: np.ndarray, inputs: np.ndarray, mask: np.ndarray, cache: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights and of the inputs (time, window, input) for gradients of the logits."""
        s, a, pooled, fs, bs = cache
        g = {"out": pooled.T @ grad, "bias": np.array([grad.sum(), 0, 0], np.float32)}
        d_pooled = grad[:, None] * self.w["out"]
        d_a = np.einsum("ns,tns->tn", d_pooled, s)
        d_e = np.where(mask, a * (d_a - (a * d_a).sum(axis=0)), 0)
        g["attend"] = np.einsum("tn,tns->s", d_e, s)
        d_s = a[:, :, None] * d_pooled + d_e[:, :, None] * self.w["attend"]
        d_x = np.zeros_like(inputs)
        for side, steps, d_out in (("f", fs, d_s[:, :, :STATES]), ("b", bs, d_s[:, :, STATES:])):
            wx, u = self.w[f"{side}_x"], self.w[f"{side}_h"]
            g[f"{side}_x"], g[f"{side}_h"], g[f"{side}_b"] = np.zeros_like(wx), np.zeros_like(u), np.zeros(3 * STATES, np.float32)
            d_h = np.zeros((inputs.shape[1], STATES), np.float32)
            for k, h, z, r, c, part in reversed(steps):
                d_h = d_h + d_out[k]
                live = mask[k][:, None]
                d_new = np.where(live, d_h, 0)
                d_c = d_new * z * (1 - c * c)
                d_z = d_new * (c - h) * z * (1 - z)
                d_r = d_c * part * r * (1 - r)
                d_gate = np.concatenate([d_z, d_r, d_c], axis=1)
                d_part = np.concatenate([d_z, d_r, d_c * r], axis=1)
                g[f"{side}_x"] += inputs[k].T @ d_gate
                g[f"{side}_b"] += d_gate.sum(axis=0)
                g[f"{side}_h"] += h.T @ d_part
                d_x[k] += d_gate @ wx.T
                d_h = np.where(live, d_new * (1 - z), d_h) + d_part @ u.T
        return g, d_x


def windows(n: int) -> np.ndarray:
    """First words of the windows over ``n`` words: they overlap, and the last one reaches the end."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW + STRIDE, STRIDE)
    return np.minimum(starts, n - WINDOW)


def evidence(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """How far slots speak for label 1, from the texts of either label that hold them: 0 within chance, 4 at most.

    The root of the log-likelihood ratio, less what chance brings about among many rare words, weighed down where the
    odds differ little.
    """
    total, n = counts.sum(axis=0), texts.sum()
    expected = total[None, :] * (texts / n)[:, None]
    ratio = 2 * (counts * np.log(np.maximum(counts, 1e-9) / np.maximum(expected, 1e-9))).sum(axis=0)
    odds = np.log((counts[1] + 0.5) / (texts[1] + 1)) - np.log((counts[0] + 0.5) / (texts[0] + 1))
    return np.sign(odds) * np.clip(np.sqrt(np.maximum(ratio, 0)) - 3, 0, 4) * np.minimum(1, np.abs(odds) / 2)


def train(texts: list[bytes], labels: list[int], prior: float | None = None, seed: int = 0) -> Network:
    """A network fitted to labelled texts; without both classes it scores the share of label 1 alike everywhere.

    ``prior`` is the share of label 1 where the sample comes from (default: the sample's own).
    """
    net, y = Network.fresh(seed), np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        prior = (y.sum() + 1) / (len(y) + 2) if not len(y) or y.min() == 0 else 0.99
        net.w["out"][:] = 0
        net.w["bias"] = np.array([np.log(prior / (1 - prior)), 1, 0], np.float32)
        return net
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)] or [number.setdefault(b"", len(number))], np.int64) for t in texts]
    features = [word_features(w) for w in number]
    slots = np.array([a for a, _ in features])
    sizes = np.array([len(b) for _, b in features])
    grams = np.concatenate([b for _, b in features])
    gram_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # The first component starts from what slots say by themselves, so that the first choice of windows has something
    # to go by.
    for name, size, of in (("words", WORDS, slots), ("grams", GRAMS, None)):
        counts = np.zeros((2, size))
        for d, label in zip(docs, labels):
            seen = np.unique(d)
            seen = of[seen] if of is not None else np.concatenate([features[w][1] for w in seen])
            counts[int(label), np.unique(seen)] += 1
        net.w[name][:, 0] = evidence(counts, np.array([(y == 0).sum(), (y == 1).sum()])) * (1.0 if name == "words" else 0.2)
    starts = [windows(len(d)) for d in docs]
    owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
    flat = np.concatenate(docs)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    place = np.concatenate(starts)
    word = np.full((WINDOW, len(owner)), -1, np.int64)
    for k in range(WINDOW):
        inside = place + k < np.diff(offsets)[owner]
        word[k, inside] = flat[offsets[owner[inside]] + place[inside] + k]
    rng = np.random.default_rng(seed)
    moments: dict[str, list[np.ndarray]] = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    step = 0

    def scores() -> np.ndarray:
        inputs = net.w["words"][slots] + np.add.reduceat(net.w["grams"][grams], gram_starts, axis=0) / np.sqrt(sizes.astype(np.float32))[:, None]
        by_word = net.gates(inputs)
        return np.concatenate([net.forward({s: g[word[:, k : k + BATCH]] for s, g in by_word.items()}, word[:, k : k + BATCH] >= 0)[0] for k in range(0, len(owner), BATCH)])

    for turn in range(ROUNDS):
        if turn:
            logit = scores()
        else:  # no network yet: windows by the sum of their words' starting odds
            odds = net.w["words"][slots, 0]
            logit = np.where(word >= 0, np.maximum(odds[word], 0), 0).sum(axis=0)
        order = np.lexsort((logit, owner))
        last = np.searchsorted(owner[order], np.arange(len(docs)), side="right") - 1
        best = order[last]
        random = np.array([rng.integers(s, e) for s, e in zip(np.searchsorted(owner, np.arange(len(docs))), last + 1)])
        negatives = np.flatnonzero(y == 0)
        chosen = np.concatenate([best, random[negatives]])  # the highest window of each text, and any of a clean one
        label = np.concatenate([y, y[negatives]])
        weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * len(label)
        for _ in range(STEPS):
            pick = rng.integers(0, len(chosen), 256)
            w = word[:, chosen[pick]]
            mask, w = w >= 0, np.maximum(w, 0)
            used, at = np.unique(w, return_inverse=True)
            at = at.reshape(w.shape)
            g_list = [features[i][1] for i in used]
            g_sizes = np.array([len(x) for x in g_list])
            g_flat = np.concatenate(g_list)
            g_starts = np.concatenate([[0], np.cumsum(g_sizes)[:-1]])
            x = net.w["words"][slots[used]] + np.add.reduceat(net.w["grams"][g_flat], g_starts, axis=0) / np.sqrt(g_sizes.astype(np.float32))[:, None]
            inputs = x[at]
            logits, cache = net.forward({s: g[at] for s, g in net.gates(x).items()}, mask, keep=True)
            p = 1 / (1 + np.exp(-logits))
            grad = ((p - label[pick]) * weight[pick] / len(pick)).astype(np.float32)
            g, d_x = net.backward(grad, inputs, mask, cache)
            d_word = np.zeros_like(x)
            np.add.at(d_word, at.ravel(), np.where(mask[:, :, None], d_x, 0).reshape(-1, INPUT))
            g["words"] = np.zeros_like(net.w["words"])
            np.add.at(g["words"], slots[used], d_word)
            g["grams"] = np.zeros_like(net.w["grams"])
            np.add.at(g["grams"], g_flat, np.repeat(d_word / np.sqrt(g_sizes)[:, None], g_sizes, axis=0))
            step += 1
            for k, value in g.items():
                m, v = moments[k]
                m += 0.1 * (value - m)
                v += 0.01 * (value * value - v)
                net.w[k] -= (RATE * (VECTORS if k in ("words", "grams") else 1) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    # Calibration: a logistic fit of the labels by the texts' highest logits, with the classes' shares where the
    # sample comes from.
    logit = scores()
    top = np.full(len(docs), -np.inf)
    np.maximum.at(top, owner, logit)
    scale, shift = 1.0, 0.0
    top = np.clip(top, -12, 12)
    prior = min(0.9, max(0.02, float(y.mean() if prior is None else prior)))
    weight = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-(scale * top + shift)))
        d, h = weight * (p - y), weight * p * (1 - p) + 1e-4
        gradient = np.array([(d * top).sum() + 1e-2 * (scale - 1), d.sum()])
        hessian = np.array([[(h * top * top).sum() + 1e-2, (h * top).sum()], [(h * top).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hessian, gradient)
        scale, shift = max(0.05, scale - float(np.clip(move[0], -1, 1))), shift - float(np.clip(move[1], -1, 1))
    net.w["bias"][1:] = scale, shift
    return net


class Scorer:
    """Scores whole texts, with a bounded memory of words' gates."""

    def __init__(self, data: bytes):
        self.net = Network.loads(data)
        self.number: dict[bytes, int] = {}
        self.gates = {side: np.zeros((1024, 3 * STATES), np.float32) for side in "fb"}

    def _words(self, words: set[bytes]) -> None:
        if len(self.number) + len(words) > REMEMBERED:
            self.number.clear()
        new = [w for w in words if w not in self.number]
        n, size = len(self.number), len(self.number) + len(new)
        for side, rows in self.net.gates(self.net.inputs(new)).items():
            if size > len(self.gates[side]):
                grown = np.zeros((max(size, 2 * len(self.gates[side])), 3 * STATES), np.float32)
                grown[:n] = self.gates[side][:n]
                self.gates[side] = grown
            self.gates[side][n:size] = rows
        self.number.update(zip(new, range(n, size)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The score of each text; its windows are scored together with those of its neighbours, a batch at a time."""
        out = np.full(len(texts), -np.inf)
        held: list[tuple[int, list[bytes]]] = []
        many = 0
        for k, text in enumerate(texts):
            words = words_of(text)
            for at in range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE * BATCH):  # a very long text in parts
                part = words[at : at + STRIDE * (BATCH - 1) + WINDOW]
                held.append((k, part))
                many += len(part) // STRIDE + 1
                if many >= BATCH:
                    self._part(held, out)
                    held, many = [], 0
        self._part(held, out)
        bias, scale, shift = self.net.w["bias"]
        return 1 / (1 + np.exp(-(float(scale) * np.clip(out, -12, 12) + float(shift))))

    def _part(self, held: list[tuple[int, list[bytes]]], out: np.ndarray) -> None:
        if not held:
            return
        self._words({w for _, words in held for w in words} | {b""})
        number = self.number
        flat = np.array([number[w] for _, words in held for w in words] + [number[b""]], np.int64)
        sizes = np.array([len(words) for _, words in held])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        starts = [windows(n) for n in sizes]
        owner = np.repeat(np.arange(len(held)), [len(s) for s in starts])
        place = np.concatenate(starts)
        for at in range(0, len(owner), BATCH):
            o, p = owner[at : at + BATCH], place[at : at + BATCH]
            position = p + np.arange(WINDOW)[:, None]
            mask = position < np.maximum(sizes[o], 1)  # an empty text is one empty word
            ids = flat[np.where(sizes[o] == 0, len(flat) - 1, np.minimum(offsets[o] + position, len(flat) - 1))]
            logits, _ = self.net.forward({s: self.gates[s][ids] for s in "fb"}, mask)
            np.maximum.at(out, np.array([held[i][0] for i in o]), logits)


def fitted(docs: DataFrame, labels: DataFrame, allowed: Column, text: str = "text", label: str = "toxic", doc_id: str = "doc_id", sample: int = SAMPLE) -> bytes:
    """The weights of a network fitted in one task to at most ``sample`` labelled documents of each class.

    ``allowed`` says of the id column which labels training may use. Rows with a null id or label are left out, an id
    labelled both ways counts as 1, and of texts that share an id one is read. Which documents are taken depends on a
    hash of their ids alone. Only ids are shuffled; texts are picked by the (at most twice ``sample``) ids chosen.
    """
    known = labels.filter(allowed & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = known.join(docs.select(F.col(doc_id).alias("id")), "id", "left_semi").withColumn("order", F.xxhash64(F.col("id"), F.lit("toxicity sample")))
    known = written(known, "toxicity-labels")
    taken = [known.filter(F.col("label") == k).orderBy("order", "id").limit(sample) for k in (0, 1)]
    prior = known.agg(F.avg("label")).first()[0]
    chosen = written(taken[0].unionByName(taken[1]), "toxicity-sample")
    few = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    few = few.groupBy("id", "label", "order").agg(F.min("text").alias("text"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["order", "id"], kind="stable")
        return pd.DataFrame({"weights": [train([t.encode("utf-8", "replace") for t in pdf["text"]], list(pdf["label"]), prior).dumps()]})

    found = few.withColumn("sample", F.lit(0)).groupBy("sample").applyInPandas(run, "weights binary").collect()
    return bytes(found[0]["weights"]) if found else train([], []).dumps()


def scored(docs: DataFrame, weights: bytes, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) of each whole text.

    Null and empty texts are scored as one empty word, repeated rows alike; an empty table gives an empty result, and
    columns of ``docs`` that bear a result's name are replaced. The weights (about 1.5 MB, fixed by the sizes above)
    go to the workers as a broadcast. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make() -> Callable[[list], dict[str, pa.Array]]:
        scorer = Scorer(sent.value)

        def work(texts: list) -> dict[str, pa.Array]:
            score = scorer.score(texts)
            return {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}

        return work

    return map_column(docs, utf8(text), FIELDS, make, keep)
