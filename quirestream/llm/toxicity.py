"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the beginnings of longer ones (so that inflected forms meet). Every
term of the examples is in the index, and each example is its whole TF-IDF vector; idf
comes from the labels' rows. The weight of a term that goes with toxic rows beyond chance
(log-likelihood ratio above ``CHANCE``) is raised by the root of what exceeds it, so that
a few such terms outweigh the hundreds that any two texts share.

The index holds postings by term; terms of more than one example in ``FREQUENT`` are kept
as a matrix. Examples stand in blocks, like ones side by side, with each block's largest
weight of every frequent term. A query sums its rarer terms' postings; with the block
maxima that gives each block's bound, and blocks are scored from the best bound down,
until no bound reaches the k-th best cosine: the k nearest of all examples are exact.

Votes of the k nearest, weighted by nearness, give the share of toxic neighbours; an
isotonic curve, fitted on the examples with each left out of its own neighbours, turns
the share into a probability. Neighbours and their cosines are returned as evidence.

The sample: at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled rows, those of the smallest
hash of their id, so the model has a fixed size however many labels there are. Each row
weighs as many labelled rows of its label as there are for one in the sample: weights,
idf, votes and calibration follow the rates of all labels, whatever the bounds cut.

Defined results: null, empty and wordless texts have no neighbours, as have texts that
share no word with any example; they get the share of toxic examples among those without
neighbours; ties between neighbours go to the smaller example number; without examples of
both labels every score is the share of toxic examples (0.5 without any); rows are never
matched by id, so null and repeated ids are scored like others; other columns stay, and
where one has the name of a result the result's name gets a ``_``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirestream.llm.naming import free
from quirestream.llm.sampling import smallest_hashes
from quirestream.llm.staging import small_batches
from quirestream.llm.tokens import _COEFF, SPACED, U, mix64, words

#: Bounds of the labelled sample.
MAX_TOXIC, MAX_CLEAN = 1000, 3000
#: Log-likelihood ratio that chance may reach among the words of the sample.
CHANCE = 20.0
#: Neighbours that vote; examples of a block; a word is frequent in more than one example of so many.
NEIGHBOURS, BLOCK, FREQUENT = 15, 64, 4
#: Lengths in bytes of the word beginnings that are terms, too.
STEMS = (5, 7)
#: Bytes of the model in one row on its way to the driver.
PART = 1 << 21
_WORDS = SPACED.copy()
for _c in b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~":
    _WORDS[_c] = False

Bag = tuple[np.ndarray, np.ndarray]


def bags(column: pa.Array) -> Iterator[Bag]:
    """Distinct terms of each text, as hashes in order, and how often each occurs."""
    for w in words(column, _WORDS):
        at, terms = [np.arange(len(w.hashes))], [w.hashes]
        for p in STEMS:
            pick = np.flatnonzero(w.lengths > p)
            h = np.full(len(pick), U(p) << U(32), U)
            for i in range(p):
                h += (w.buf[w.starts[pick] + i].astype(U) + U(1)) * _COEFF[i + 64]
            at.append(pick)
            terms.append(mix64(h))
        at, terms = np.concatenate(at), np.concatenate(terms)
        order = np.argsort(at, kind="stable")
        at, terms = at[order], terms[order]
        cut = np.searchsorted(at, w.bounds).tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield np.unique(terms[a:b], return_counts=True)


class Model:
    """Index and calibration; made from the examples' bags and labels."""

    def __init__(self, ids: list, examples: list[Bag], labels: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)) -> None:
        self.labels = np.asarray(labels, bool)
        self.ids = ids
        self.weights = weights  # of a clean and of a toxic row
        self.weight = np.where(self.labels, weights[1], weights[0])
        self._weigh(examples)
        vectors = [self.vector(*b) for b in examples]
        self._index(vectors)
        self._calibrate(vectors)

    def _weigh(self, examples: list[Bag]) -> None:
        flat = np.concatenate([b[0] for b in examples]) if examples else np.zeros(0, U)
        toxic = np.repeat(self.labels, [len(b[0]) for b in examples]) if examples else np.zeros(0, bool)
        self.terms, at, df = np.unique(flat, return_inverse=True, return_counts=True)
        d1 = np.bincount(at[toxic], minlength=len(self.terms))
        d0 = df - d1
        n1, n0 = int(self.labels.sum()), int((~self.labels).sum())
        # rows seen tell whether a word counts
        rate = n1 / max(n0 + n1, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = 2 * (np.where(d1 > 0, d1 * np.log(d1 / (df * rate)), 0) + np.where(d0 > 0, d0 * np.log(d0 / (df * (1 - rate))), 0))
        gain = np.where((d1 > df * rate) & np.isfinite(gain), gain, 0.0)
        w0, w1 = self.weights
        rows = w0 * n0 + w1 * n1
        self.idf = (np.log((1 + rows) / (1 + w0 * d0 + w1 * d1)) + 1) * (1 + np.sqrt(np.maximum(gain - CHANCE, 0)))
        self.new = np.log(1 + rows) + 1  # of a word in no example
        self.df = df

    def vector(self, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the words that the index has; all words count for the length."""
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        ok = self.terms[at] == h if len(self.terms) else np.zeros(len(h), bool)
        v = (1 + np.log(c)) * np.where(ok, self.idf[at], self.new) if len(self.terms) else np.zeros(len(h))
        return (at[ok], v[ok] / np.linalg.norm(v)) if ok.any() else (at[ok], v[ok])

    def _index(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        # like examples side by side: blocks then have large weights in few words
        used = [i for i, (t, _) in enumerate(vectors) if len(t)]
        used.sort(key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1] * (self.df[vectors[i][0]] > 1))]), i))
        self.row = np.array(used, np.int64)  # index row: example
        n = len(used)
        often = self.df * FREQUENT > len(vectors)
        self.frequent = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        t = np.concatenate([vectors[i][0] for i in used]) if used else np.zeros(0, np.int64)
        r = np.repeat(np.arange(n), [len(vectors[i][0]) for i in used])
        w = np.concatenate([vectors[i][1] for i in used]) if used else np.zeros(0)
        many = often[t]
        self.blocks = -(-n // BLOCK)
        self.matrix = np.zeros((self.blocks, BLOCK, int(often.sum())))
        self.matrix[r[many] // BLOCK, r[many] % BLOCK, self.frequent[t[many]]] = w[many]
        self.most = self.matrix.max(axis=1) if n else np.zeros((0, int(often.sum())))
        t, r, w = t[~many], r[~many], w[~many]
        order = np.lexsort((r, t))
        self.post_row, self.post_w = r[order].astype(np.int32), w[order]
        self.start = np.searchsorted(t[order], np.arange(len(self.terms) + 1)).astype(np.int32)
        del self.df

    def nearest(self, t: np.ndarray, v: np.ndarray, leave: int = -1, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k examples of the largest cosine (above 0), best first."""
        if len(t) == 0 or self.blocks == 0:
            return []
        f = self.frequent[t]
        q = np.zeros(self.matrix.shape[2])
        q[f[f >= 0]] = v[f >= 0]
        t, v = t[f < 0], v[f < 0]
        a, size = self.start[t], self.start[t + 1] - self.start[t]
        at = np.arange(int(size.sum())) + np.repeat(a - np.cumsum(size) + size, size)
        part = np.bincount(self.post_row[at], self.post_w[at] * np.repeat(v, size), self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        bound = part.max(axis=1) + self.most @ q
        order = np.argsort(-bound, kind="stable")
        got_row, got = np.zeros(0, np.int64), np.zeros(0)
        i, step = 0, 4
        while i < len(order):
            if bound[order[i]] <= 0 or (len(got) >= k and bound[order[i]] < got[k - 1] - 1e-9):
                break
            b = order[i : i + step]
            i, step = i + step, 2 * step
            score = (part[b] + self.matrix[b] @ q).reshape(-1)
            hit = np.flatnonzero(score > (got[k - 1] - 1e-9 if len(got) >= k else 0))
            if len(hit) > 4 * k:  # only the k best, those that tie with them, and one to leave out
                hit = hit[score[hit] >= np.partition(score[hit], -k - 1)[-k - 1] - 1e-9]
            who = self.row[b[hit // BLOCK] * BLOCK + hit % BLOCK]
            keep = who != leave
            got_row, got = np.concatenate([got_row, who[keep]]), np.concatenate([got, np.round(score[hit][keep], 9)])
            best = np.lexsort((got_row, -got))[:k]
            got_row, got = got_row[best], got[best]
        return list(zip(got.tolist(), got_row.tolist(), strict=True))

    def vote(self, near: list[tuple[float, int]]) -> float:
        weight = [float(self.weight[i]) / (1.02 - min(c, 1.0)) for c, i in near]
        return sum(w for w, (_, i) in zip(weight, near, strict=True) if self.labels[i]) / sum(weight)

    def _calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        x, y, none = [], [], []  # y, none: weight if toxic, and weight
        for i, (t, v) in enumerate(vectors):
            near = self.nearest(t, v, leave=i)
            if near:
                x.append(self.vote(near))
            (y if near else none).append((float(self.labels[i] * self.weight[i]), float(self.weight[i])))
        mean = float(self.weight.mean()) if len(self.labels) else 1.0
        rate = float(self.weight[self.labels].sum() / self.weight.sum()) if len(self.labels) else 0.5
        self.empty = (sum(a for a, _ in none) + rate * mean) / (sum(b for _, b in none) + mean)
        order = np.argsort(x, kind="stable")
        # pool adjacent violators, each pool smoothed by half a row of either label
        pools: list[list[float]] = []
        for i in order.tolist():
            pools.append([x[i], *y[i]])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                b = pools.pop()
                pools[-1] = [b[0], pools[-1][1] + b[1], pools[-1][2] + b[2]]
        self.curve_x = np.array([p[0] for p in pools])
        w0, w1 = self.weights
        self.curve_y = np.array([(p[1] + 0.5 * w1) / (p[2] + 0.5 * (w0 + w1)) for p in pools])

    def score(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return float(self.empty)
        v = self.vote(near)
        if len(self.curve_x) == 0:
            return v
        at = min(int(np.searchsorted(self.curve_x, v)), len(self.curve_x) - 1)
        return float(self.curve_y[at])

    def scan(self, column: pa.Array) -> Iterator[list[tuple[float, int]]]:
        """The neighbours of each text."""
        known: dict[bytes, list[tuple[float, int]]] = {}
        for h, c in bags(column):
            key = h.tobytes() + c.tobytes()
            if key not in known:
                if len(known) > 2000:
                    known.clear()
                known[key] = self.nearest(*self.vector(h, c))
            yield known[key]


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, where: Column | None) -> tuple[DataFrame, tuple[float, float]]:
    """id, text and label of the bounded sample; for a clean and a toxic row of it, the labelled rows that it stands for."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    ids = smallest_hashes(known, "y", "i", {0: MAX_CLEAN, 1: MAX_TOXIC}).select("i", "y")
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a label
    weights = (max(1.0, total.get(0, 0) / MAX_CLEAN), max(1.0, total.get(1, 0) / MAX_TOXIC))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return texts.join(F.broadcast(ids), "i").select("i", "t", "y"), weights  # MAX_TOXIC + MAX_CLEAN rows


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", where: Column | None = None) -> Model:
    rows, weights = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, where=where)
    small_batches(docs.sparkSession)
    key = rows.schema["i"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(bags(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([c.astype(np.int64).tobytes() for _, c in found], pa.binary())], ["i", "y", "h", "c"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted({x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)})
        made = Model([g[0] for g in got], [(np.frombuffer(g[2], U), np.frombuffer(g[3], np.int64)) for g in got], np.array([g[1] for g in got], bool), weights)
        data = zstd.compress(pickle.dumps(made), 1)
        for i in range(0, len(data), PART):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([data[i : i + PART]], pa.binary())], ["i", "part"])

    # the words of the sample's rows are counted where these are; one task makes the index of them
    counted = rows.mapInArrow(count, f"i {key}, y int, h binary, c binary").repartition(1)
    parts = sorted(counted.mapInArrow(fit, "i long, part binary").toLocalIterator())  # the model: a fixed size
    return pickle.loads(zstd.decompress(b"".join(bytes(r.part) for r in parts)))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``evidence`` (id, label and cosine of the neighbours)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    names = free(docs.columns, "score", "predicted", "evidence")
    plain = all(isinstance(i, int) for i in model.ids)
    evidence = pa.list_(pa.struct([("id", pa.int64() if plain else pa.string()), ("toxic", pa.bool_()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            near = list(m.scan(b.column(at)))
            s = [m.score(n) for n in near]
            found = [[{"id": m.ids[i] if plain else str(m.ids[i]), "toxic": bool(m.labels[i]), "cosine": c} for c, i in n] for n in near]
            more = [pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array(found, evidence)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *names])

    one = T.StructType([T.StructField("id", T.LongType() if plain else T.StringType()), T.StructField("toxic", T.BooleanType()), T.StructField("cosine", T.DoubleType())])
    more = [T.StructField(n, t) for n, t in zip(names, (T.DoubleType(), T.IntegerType(), T.ArrayType(one)), strict=True)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))
