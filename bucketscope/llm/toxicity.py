"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of its hash beside the mean embedding of its runs of three and of
six bytes. Windows of 32 words, each overlapping the next by 8, cover the whole text; every
window is scored, and a document's score is the calibrated maximum. The network learns from a
bounded sample of the labelled documents that are there (``SAMPLE_DOCS``, half of each label, by
a hash of the id, up to ``SAMPLE_WINDOWS`` windows of each, evenly spaced in longer ones), from
random embeddings; a third of them calibrate instead.

Null and empty texts score as an empty window does. Very long texts are scored whole, window by
window. Equal texts and repeated rows get equal scores; extra columns pass through ``score``,
columns named as its outputs are replaced. An empty table gives an empty table. If no document
of each label is there to learn from, every text scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope.llm.columnar import lowered, mixed, slices, word_bounds, word_hashes
from bucketscope.llm.tables import fold, table

WINDOW, OVERLAP = 32, 8
SAMPLE_DOCS, SAMPLE_WINDOWS = 3_000, 256
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
SLOT_BITS = 20
_SIZES = {"word": 12, "gram": 8, "hidden": 8, "attend": 8}
_SLICE = 1 << 19
#: Share of the training steps in which every window of a document of label 1 teaches.
WARM = 0.3
#: Learning rates of the network and of the embeddings, and how fast embeddings fade.
RATE, RATE_TABLE, DECAY = 0.01, 0.02, 1e-4
#: Least scale of a row's gradient, as a share of the largest one in its table.
LEAST_SCALE = 1e-2
#: Documents of the sample that must have a word or a run of bytes for it to count.
LEAST_DOCS = 4
_BATCH = 2048
#: Documents whose byte runs are counted at once.
_AT_ONCE = 64


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -30, 30)))


class Words:
    """The distinct words of some texts: keys of words and of their byte runs (with the first of each word), and each occurrence's place. A network adds rows and grams, their rows in its tables."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        h = word_hashes(data, starts, ends)
        _, first, self.place = np.unique(h, return_index=True, return_inverse=True)
        self.keys = h[first]
        s, size = starts[first], ends[first] - starts[first]
        total = int(size.sum())
        own = np.cumsum(size) - size
        at, end = np.repeat(s - own, size) + np.arange(total), np.repeat(s + size, size)
        grams = np.zeros((total, 2), np.uint64)  # at each byte, the runs of three and six that start there, cut short at the word's end
        for k, (width, odd) in enumerate(((3, 0x9E3779B97F4A7C15), (6, 0xC2B2AE3D27D4EB4F))):
            code = np.zeros(total, np.uint64)
            for j in range(width):
                code = (code << np.uint64(8)) | np.where(at + j < end, data[np.minimum(at + j, max(len(data) - 1, 0))], 0).astype(np.uint64)
            grams[:, k] = mixed((code + np.uint64(1)) * np.uint64(odd))
        self.gram_keys, size = grams.ravel(), 2 * size
        self.begin = np.cumsum(size) - size
        self.size = size.astype(np.float32)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of every window; first: index of each text's first word (texts + 1)."""
    n = np.diff(first)
    step = WINDOW - OVERLAP
    many = np.maximum(1, -(-(n - OVERLAP) // step))
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    begin = first[:-1][text] + k * step
    return text, begin, np.minimum(WINDOW, first[1:][text] - begin)


class Known:
    """Keys that have a row of their own; all others share the last row. One slot for each hash: of two keys the later stays."""

    def __init__(self, keys: np.ndarray):
        self.slots = np.zeros(1 << SLOT_BITS, np.uint64)
        self.slots[self._slot(keys)] = keys
        kept = np.flatnonzero(self.slots)
        self.row = np.full(1 << SLOT_BITS, len(kept), np.int32)
        self.row[kept] = np.arange(len(kept))
        self.size = len(kept) + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        return np.where(self.slots[at] == keys, self.row[at], self.size - 1)


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        e, h, a = _SIZES["word"] + _SIZES["gram"], _SIZES["hidden"], _SIZES["attend"]
        normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.known = {k: Known(np.zeros(0, np.uint64)) for k in ("word", "gram")}
        self.p = {k: np.zeros((1, _SIZES[k]), np.float32) for k in ("word", "gram")}
        for d in "fb":  # forwards, backwards
            self.p |= {f"x{d}": normal(e**-0.5, e, 3 * h), f"h{d}": normal(h**-0.5, h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}
        self.p |= {"a": normal((2 * h) ** -0.5, 2 * h, a), "ab": np.zeros(a, np.float32), "v": normal(0.5, a), "o": normal((2 * h) ** -0.5, 2 * h), "ob": np.zeros(1, np.float32)}
        self.knots, self.heights = np.zeros(1), np.zeros(1)

    def bound(self, w: Words) -> Words:
        w.rows, w.grams = self.known["word"].rows(w.keys), self.known["gram"].rows(w.gram_keys)
        return w

    def embedded(self, w: Words) -> np.ndarray:
        if not len(w.rows):
            return np.zeros((0, _SIZES["word"] + _SIZES["gram"]), np.float32)
        chars = np.add.reduceat(self.p["gram"][w.grams], w.begin, axis=0) / w.size[:, None]
        return np.concatenate([self.p["word"][w.rows], chars], 1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of one direction; x: projected inputs (windows, words, 3 hidden)."""
        n, steps, _ = x.shape
        size, u = _SIZES["hidden"], self.p[f"h{d}"]
        h, out = np.zeros((n, size), np.float32), np.zeros((n, steps, size), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            hu = h @ u
            zr = _sigmoid(x[:, t, : 2 * size] + hu[:, : 2 * size])
            z, r = zr[:, :size], zr[:, size:]
            c = np.tanh(x[:, t, 2 * size :] + r * hu[:, 2 * size :])
            m = mask[:, t, None]
            if keep is not None:
                keep.append((t, h, hu, z, r, c, m))
            h = h + m * z * (c - h)
            out[:, t] = h
        return out

    def _forward(self, project: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        states = []
        for d in "fb":
            steps: list = []
            states.append(self._run(project[d][at], mask, d, steps if keep is not None else None))
            if keep is not None:
                keep[d] = steps
        s = np.concatenate(states, 2)
        u = np.tanh(s @ self.p["a"] + self.p["ab"])
        e = np.where(mask > 0, u @ self.p["v"], -1e9)
        w = np.exp(e - e.max(1, keepdims=True)) * mask
        w = w / np.maximum(w.sum(1, keepdims=True), 1e-9)
        pooled = (w[:, :, None] * s).sum(1)
        if keep is not None:
            keep |= {"s": s, "u": u, "w": w, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["ob"][0]

    def projected(self, e: np.ndarray) -> dict[str, np.ndarray]:
        """Inputs to the gates for each distinct word, and a last row of zeros for empty places."""
        return {d: np.concatenate([e @ self.p[f"x{d}"] + self.p[f"c{d}"], np.zeros((1, 3 * _SIZES["hidden"]), np.float32)]) for d in "fb"}

    def logits(self, w: Words, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        project = self.projected(self.embedded(self.bound(w)))
        place = np.append(w.place, len(w.rows))
        out = np.zeros(len(begin), np.float32)
        for i in range(0, len(begin), _BATCH):
            at, mask = laid(place, begin[i : i + _BATCH], size[i : i + _BATCH])
            out[i : i + _BATCH] = self._forward(project, at, mask)
        return out

    def gradients(self, w: Words, begin: np.ndarray, size: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of weighted cross-entropy over some windows."""
        used, inside = np.unique(np.append(w.place, len(w.rows))[laid(np.append(np.arange(len(w.place)), len(w.place)), begin, size)[0]], return_inverse=True)
        inside = inside.reshape(len(begin), -1)
        used = used[used < len(w.rows)]
        part = Words.__new__(Words)
        part.rows, part.size = w.rows[used], w.size[used]
        n = part.size.astype(np.int64)
        part.begin = np.cumsum(n) - n
        part.grams = w.grams[np.repeat(w.begin[used] - part.begin, n) + np.arange(int(n.sum()))]
        e = self.embedded(part)
        project = self.projected(e)
        at = np.minimum(inside, len(used))
        mask = (np.arange(WINDOW) < size[:, None]).astype(np.float32)
        keep: dict = {}
        logit = self._forward(project, at, mask, keep)
        prob = _sigmoid(logit)
        loss = float(-(weight * np.where(target > 0, np.log(prob + 1e-9), np.log(1 - prob + 1e-9))).sum())
        p, g = self.p, {}
        dl = (weight * (prob - target)).astype(np.float32)
        g["o"], g["ob"] = keep["pooled"].T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * p["o"]
        s, u, a = keep["s"], keep["u"], keep["w"]
        ds = a[:, :, None] * dpool[:, None]
        da = (s * dpool[:, None]).sum(2)
        de = a * (da - (a * da).sum(1, keepdims=True))
        du = de[:, :, None] * p["v"] * (1 - u * u)
        g["v"] = (u * de[:, :, None]).sum((0, 1))
        g["a"], g["ab"] = np.einsum("nti,ntj->ij", s, du), du.sum((0, 1))
        ds += du @ p["a"].T
        size_h = _SIZES["hidden"]
        demb = np.zeros((len(used) + 1, e.shape[1]), np.float32)
        padded = np.concatenate([e, np.zeros((1, e.shape[1]), np.float32)])
        for k, d in enumerate("fb"):
            dx = np.zeros((len(at), WINDOW, 3 * size_h), np.float32)
            dh, gu = np.zeros((len(at), size_h), np.float32), np.zeros_like(p[f"h{d}"])
            for t, h, hu, z, r, c, m in reversed(keep[d]):
                dh = dh + ds[:, t, k * size_h : (k + 1) * size_h]
                dz, dc = dh * m * (c - h) * z * (1 - z), dh * m * z * (1 - c * c)
                dr = dc * hu[:, 2 * size_h :] * r * (1 - r)
                dhu = np.concatenate([dz, dr, dc * r], 1)
                dx[:, t] = np.concatenate([dz, dr, dc], 1)
                gu += h.T @ dhu
                dh = dh * (1 - m * z) + dhu @ p[f"h{d}"].T
            g[f"h{d}"] = gu
            dproj = np.zeros((len(used) + 1, 3 * size_h), np.float32)
            np.add.at(dproj, at.ravel(), dx.reshape(-1, 3 * size_h))
            dproj[-1] = 0
            g[f"x{d}"], g[f"c{d}"] = padded.T @ dproj, dproj.sum(0)
            demb += dproj @ p[f"x{d}"].T
        demb = demb[:-1]
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], part.rows, demb[:, : _SIZES["word"]])
        np.add.at(g["gram"], part.grams, np.repeat(demb[:, _SIZES["word"] :] / part.size[:, None], n, axis=0))
        return loss, g

    def _start(self, w: Words, owner: np.ndarray, rng: np.random.Generator) -> None:
        """Gives a row, of random numbers at first, to the words and byte runs that enough documents have. owner: document of each word, ascending."""
        pairs = np.unique(owner * len(w.keys) + w.place)  # each word once a document
        owner, word = pairs // len(w.keys), pairs % len(w.keys)
        cuts = np.searchsorted(owner, np.arange(0, int(owner.max()) + 1 + _AT_ONCE, _AT_ONCE))
        for name in ("word", "gram"):
            parts = [self._having(w, name, owner[i:j], word[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            docs = np.bincount(at, np.concatenate([n for _, n in parts]), len(keys))
            order = np.argsort(docs, kind="stable")
            self.known[name] = Known(keys[order][docs[order] >= LEAST_DOCS])
            self.p[name] = (rng.standard_normal((self.known[name].size, _SIZES[name])) * 0.1).astype(np.float32)
            self.p[name][-1] = 0

    @staticmethod
    def _having(w: Words, name: str, owner: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of some documents' words or byte runs, and how many of the documents have each."""
        keys, docs = w.keys[word], owner
        if name == "gram":
            size = w.size[word].astype(np.int64)
            keys, docs = w.gram_keys[np.repeat(w.begin[word] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], np.repeat(owner, size)
        known, place = np.unique(keys, return_inverse=True)
        return known, np.bincount(np.unique(docs * len(known) + place) % len(known), minlength=len(known))

    def fit(self, texts: list[str], labels: np.ndarray, group: np.ndarray, steps: int = 300, batch: int = 256, seed: int = 5) -> None:
        """texts: one window each; group: its document. In the later steps a document of label 1 teaches by its highest window and those above zero only: the rest of its words may be harmless."""
        rng = np.random.default_rng(seed)
        w, first = words_in(texts)
        begin, size = first[:-1], np.minimum(WINDOW, np.diff(first))
        y = labels.astype(np.float32)
        _, place = np.unique(group, return_inverse=True)
        self._start(w, np.repeat(place, np.diff(first)), rng)
        self.bound(w)
        moment = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros((len(v), 1), np.float32) if k in ("word", "gram") else np.zeros_like(v) for k, v in self.p.items()}
        t, trust = 0, np.ones(len(y))
        while t < steps:
            if t >= steps * WARM:
                scores = self.logits(w, begin, size)
                top = np.full(place.max() + 1, -np.inf, np.float32)
                np.maximum.at(top, place, scores)
                trust = np.where((y == 0) | (scores > 0) | (scores == top[place]), 1.0, 0.0)
            share = trust * np.where(y > 0, 0.5 / max(1, trust[y > 0].sum()), 0.5 / max(1, (y == 0).sum())) * trust.sum()
            order = rng.permutation(np.flatnonzero(trust > 0))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                _, g = self.gradients(w, begin[rows], size[rows], y[rows], share[rows] / len(rows))
                t += 1
                for k, v in self.p.items():
                    moment[k] = 0.9 * moment[k] + 0.1 * g[k]
                    table = k in ("word", "gram")  # one scale for a row; those of few windows learn less
                    own = np.mean(g[k] ** 2, axis=1, keepdims=True) if table else g[k] ** 2
                    square[k] = 0.99 * square[k] + 0.01 * (np.maximum(own, LEAST_SCALE * np.max(g[k] ** 2)) if table else own)
                    v *= 1 - (DECAY if table else 0)
                    if table:
                        moment[k][-1] = 0  # what was hardly seen says nothing
                    v -= (RATE_TABLE if table else RATE) * (moment[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-7)

    def calibrate(self, most: np.ndarray, labels: np.ndarray, share: float) -> None:
        """Isotonic regression of the label on a document's highest logit, straight lines between its steps; share: of label 1 among all labelled documents.

        Unlike a sigmoid it is not flattened by documents of label 1 that look like any other.
        """
        order = np.lexsort((labels, most))
        x, y = most[order].astype(np.float64), labels[order].astype(np.float64)
        weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
        blocks: list[list[float]] = []  # weight of label 1, weight, first and last logit
        for v, t, w in zip(x, y, weight, strict=True):
            blocks.append([w * t, w, v, v])
            while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
                up, total, _, last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + up, blocks[-1][1] + total, blocks[-1][2], last]
        p = np.array([(b[0] + share) / (b[1] + 1) for b in blocks])
        p = np.maximum.accumulate(p)
        self.knots, self.heights = np.array([z for b in blocks for z in b[2:]]), np.repeat(p, 2)

    def scores(self, most: np.ndarray) -> np.ndarray:
        """A hundredth of the score keeps the order of the logits where the regression is level."""
        x = most.astype(np.float64)
        return 0.99 * np.interp(x, self.knots, self.heights) + 0.01 * _sigmoid(x)


def laid(place: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word at each place of each window (the last entry of place where there is none), and a mask."""
    inside = np.arange(WINDOW) < size[:, None]
    at = np.where(inside, begin[:, None] + np.arange(WINDOW), len(place) - 1)
    return place[at], inside.astype(np.float32)


def words_in(texts: list[str]) -> tuple[Words, np.ndarray]:
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    low = lowered(data)
    starts, ends, first = word_bounds(low, offsets)
    return Words(low, starts, ends), first


def highest(network: Network, column: pa.Array) -> Iterator[np.ndarray]:
    """The highest logit of any window of each text, slice by slice."""
    for _, data, offsets in slices(column, _SLICE):
        low = lowered(data)
        starts, ends, first = word_bounds(low, offsets)
        text, begin, size = windows(first)
        logit = network.logits(Words(low, starts, ends), begin, size)
        yield np.maximum.reduceat(logit, np.searchsorted(text, np.arange(len(offsets) - 1)))


def _known(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labels that may be learned from."""
    return labels.filter(F.col("toxic").isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))


def _chosen(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the documents to learn from; their ids, SAMPLE_DOCS at most, are broadcast."""
    known = _known(labels).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")  # labels of absent documents teach nothing
    picked = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS // 2) for k in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")


def learn(docs: DataFrame, labels: DataFrame) -> Network | None:
    chosen = _chosen(docs, labels)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in slices(b.column(1), _SLICE):
                starts, ends, begin_of = word_bounds(data, offsets)
                text, begin, size = windows(begin_of)
                rows = []
                for i, doc_id, toxic in zip(range(len(offsets) - 1), b.column(0).slice(first, len(offsets) - 1).to_pylist(), b.column(2).slice(first, len(offsets) - 1).to_pylist(), strict=True):
                    own = np.flatnonzero(text == i)
                    own = own[np.linspace(0, len(own) - 1, min(SAMPLE_WINDOWS, len(own))).astype(int)]
                    rows += [(doc_id, toxic, data[starts[begin[k]] : ends[begin[k] + size[k] - 1]].tobytes().decode()) for k in own if size[k] > 0]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string()))], ["doc_id", "toxic", "text"])

    rows = chosen.select("doc_id", "text", "toxic").mapInArrow(some, "doc_id long, toxic int, text string").toPandas()  # bounded: see _chosen and SAMPLE_WINDOWS
    rows = rows.sort_values(["doc_id", "text"]).reset_index(drop=True)
    if rows["toxic"].nunique() < 2:
        return None
    network = Network()
    for_fit = (rows["doc_id"].to_numpy() * np.int64(0x9E3779B1) >> 7) % 3 != 0
    if rows["toxic"][for_fit].nunique() < 2 or (~for_fit).sum() == 0:
        for_fit = np.ones(len(rows), bool)
    network.fit(rows["text"][for_fit].tolist(), rows["toxic"].to_numpy()[for_fit], rows["doc_id"].to_numpy()[for_fit])
    rest = set(rows["doc_id"][~for_fit]) or set(rows["doc_id"])
    held = chosen.filter(F.col("doc_id").isin([int(x) for x in rest]))
    model = docs.sparkSession.sparkContext.broadcast(network)
    most = held.select("doc_id", _highest(model)("text").alias("most"), "toxic").toPandas().sort_values("doc_id")
    share = _known(labels).agg(F.avg("toxic")).first()[0]
    network.calibrate(most["most"].to_numpy(), most["toxic"].to_numpy(), share)
    return network


def _highest(network: Network):  # noqa: ANN202
    """A function of a text column: the highest logit of any window."""

    @F.pandas_udf("float")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.zeros(0, np.float32), *highest(network.value, pa.array(column, pa.large_string()))]))

    return of


def score(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """docs with ``score double`` and ``predicted int``."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    if network is None:
        return docs.select(*kept, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model = docs.sparkSession.sparkContext.broadcast(network)  # a few MB

    @F.pandas_udf("double")
    def of(column: pd.Series) -> pd.Series:
        most = np.concatenate([np.zeros(0, np.float32), *highest(model.value, pa.array(column, pa.large_string()))])
        return pd.Series(model.value.scores(most))

    found = docs.select(F.struct("*").alias("row"), of(F.col(text)).alias("score"))
    return found.select(*[F.col(f"row.`{c}`") for c in kept], "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs.select("doc_id", "text"), learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
