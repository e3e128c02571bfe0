"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are texts labelled good; all documents are the unlabelled texts, whatever their label. The
share of positives among them (the class prior) is estimated first: a classifier of positives against
unlabelled ranks both, and the prior is the ratio of the shares of either above a threshold, the one at which
the ratio, with the sampling errors of both shares added, is least. Then a network with one hidden layer minimises
prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]) with the sigmoid loss; when the second term
falls below zero, the step goes the other way on it, which keeps the network from fitting it to noise.

Statistics of every text are written once. Both networks are fitted on all of them: documents are dealt into
parts of some ``PART`` rows, every part is run through in mini-batches from the common network, and the
parts' networks are averaged by their rows, round after round. Only the labelled positives are a
bounded sample. Inputs are statistics of the text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import spans, table, text_bytes
from .learn import held_out, labelled, sample_ids, sigmoid
from .shingles import long_words, word_hashes

_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#", b"*", b"$", b"%", b"&", b"|", b"<>", b"!", b"?", b".", b",;:", b"\"'()[]{}", b"/\\=+_~^`@-", b" \t", b"\n", bytes(range(128, 192)), bytes(range(192, 256))]
_CLASS = np.full(256, len(_KINDS), np.uint8)
for _i, _k in enumerate(_KINDS):
    _CLASS[list(_k)] = _i
N_FEATURES = len(_KINDS) + 1 + 7


def statistics(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """A row of N_FEATURES numbers for each text; an empty text has zeros."""
    out = np.zeros((len(offsets) - 1, N_FEATURES), np.float32)
    for i, j in spans(offsets, most):
        n_kinds = len(_KINDS) + 1
        if offsets[j] - offsets[i] > most:
            text = data[offsets[i] : offsets[j]]
            kinds = sum(np.bincount(_CLASS[text[k : k + most]], minlength=n_kinds) for k in range(0, len(text), most))[None]
            words, counts = long_words(text, most), None
            counts = np.array([len(words)])
        else:
            size = np.diff(offsets[i : j + 1])
            row = np.repeat(np.arange(j - i, dtype=np.int64), size)
            kinds = np.bincount(row * n_kinds + _CLASS[data[offsets[i] : offsets[j]]], minlength=(j - i) * n_kinds).reshape(-1, n_kinds)
            words, counts = word_hashes(data, offsets[i : j + 1])
        total = np.maximum(kinds.sum(axis=1), 1)[:, None]
        out[i:j, :n_kinds] = np.log1p(30 * kinds / total)
        at = 0
        for k, n in enumerate(counts.tolist()):
            out[i + k, n_kinds:] = _word_statistics(words[at : at + n], int(total[k, 0]))
            at += n
    return out


def _word_statistics(w: np.ndarray, size: int) -> tuple:
    n = len(w)
    if not n:
        return (0,) * 7
    distinct, count = np.unique(w, return_counts=True)
    pairs = w[:-1] * np.uint64(31) + w[1:]
    eights = np.zeros(max(n - 7, 0), np.uint64)
    for k in range(8):
        eights = eights * np.uint64(0x100000001B3) + w[k : k + len(eights)]
    return (
        np.log1p(n),
        np.log1p(size / n),
        len(distinct) / n,
        count.max() / n,
        np.log1p(10 * np.count_nonzero(w[1:] == w[:-1]) / n),
        len(np.unique(pairs)) / max(len(pairs), 1),
        np.log1p(10 * (1 - len(np.unique(eights)) / len(eights))) if len(eights) else 0,
    )


class Network:
    """Inputs centred and scaled, one hidden layer, one output."""

    def __init__(self, x: np.ndarray, hidden: int = 24, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        d = x.shape[1]
        self.p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0

    @classmethod
    def of(cls, mean: np.ndarray, sd: np.ndarray, hidden: int = 24, seed: int = 3) -> Network:
        """A new network for inputs with this mean and deviation."""
        net = cls(np.zeros((1, len(mean))), hidden, seed)
        net.mean, net.sd = mean, np.maximum(sd, 1e-3)
        return net

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8)

    def logit(self, x: np.ndarray, hidden: bool = False):
        h = np.tanh(x @ self.p[0] + self.p[1])
        z = h @ self.p[2] + self.p[3][0]
        return (z, h) if hidden else z

    def step(self, x: np.ndarray, h: np.ndarray, dz: np.ndarray, rate: float, decay: float = 1e-4) -> None:
        """One Adam step along the gradient that ``dz``, the loss's slope at the outputs, gives."""
        dh = dz[:, None] * self.p[2] * (1 - h * h)
        grads = [x.T @ dh, dh.sum(axis=0), h.T @ dz, np.array([dz.sum()])]
        self.t += 1
        for k, g in enumerate(grads):
            g = g + decay * self.p[k]
            self.m[k], self.v[k] = 0.9 * self.m[k] + 0.1 * g, 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


#: Rows of a part, local passes over a part in a round.
PART, PASSES = 20_000, 10


def _pass(net: Network, p: np.ndarray, u: np.ndarray, prior: float | None, rate: float, rng, batch: int = 512) -> None:
    """One pass over scaled unlabelled rows ``u``, each batch with as many positives: non-negative risk, or with no prior the logistic loss that tells both apart."""
    parts = max(1, -(-len(u) // batch))
    ups = np.array_split(rng.permutation(len(u)), parts)
    for a, b in zip(ups, np.array_split(np.resize(rng.permutation(len(p)), max(len(u), len(p))), parts), strict=True):
        x, n = np.vstack([p[b], u[a]]), len(b)
        z, h = net.logit(x, True)
        s = sigmoid(z)
        if prior is None:
            net.step(x, h, np.r_[(s[:n] - 1) / (2 * n), s[n:] / (2 * len(a))], rate)
            continue
        slope = s * (1 - s)  # of the sigmoid loss: l(-) = s rises, l(+) = 1 - s falls
        down = np.r_[-prior * slope[:n] / n, slope[n:] / len(a)]
        fits = s[n:].mean() - prior * s[:n].mean() >= 0
        net.step(x, h, down + np.r_[-prior * slope[:n] / n, np.zeros(len(a))] if fits else -down, rate)


def _local(net: Network, xp: np.ndarray, xu: np.ndarray, prior: float | None, rounds: range, seed: int) -> Network:
    """Passes number ``rounds`` over the rows of one part."""
    rng = np.random.default_rng([seed, rounds.start])
    p, u = net.scaled(xp), net.scaled(xu)
    for k in rounds:
        _pass(net, p, u, prior, 5e-3 * (0.97**k if prior is not None else 1.0), rng)
    return net


def ranker(xp: np.ndarray, xu: np.ndarray, epochs: int = 40) -> Network:
    """A classifier of every other row of ``xp`` against every other row of ``xu``."""
    return _local(Network(np.vstack([xp, xu]), seed=5), xp[::2], xu[::2], None, range(epochs), 11)


def prior_of(sp: np.ndarray, count: np.ndarray) -> float:
    """The prior from the sorted scores ``sp`` of positives and the numbers ``count`` of unlabelled rows above 0, 1, ... of them."""
    n = int(count.sum())
    if not len(sp) or not n:
        return 0.5
    above_p = 1 - np.searchsorted(sp, sp) / len(sp)
    # a row above k positives reaches the thresholds of the first k; of equal ones the first counts
    above_u = (count[::-1].cumsum()[::-1][1:] / n)[np.searchsorted(sp, sp)]
    slack = np.sqrt(np.log(20) / 2 / n) + np.sqrt(np.log(20) / 2 / len(sp))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def reached(sp: np.ndarray, z: np.ndarray) -> np.ndarray:
    """How many rows of ``z`` reach exactly 0, 1, ..., all of the sorted thresholds ``sp``."""
    return np.bincount(np.searchsorted(sp, z, "right"), minlength=len(sp) + 1)


def estimate_prior(xp: np.ndarray, xu: np.ndarray, epochs: int = 40) -> float:
    """The share of positives among the rows of ``xu``: classify halves against each other, read the ratio off the other halves."""
    net = ranker(xp, xu, epochs)
    sp = np.sort(net.logit(net.scaled(xp)[1::2]))
    return prior_of(sp, reached(sp, net.logit(net.scaled(xu)[1::2])))


def fit(xp: np.ndarray, xu: np.ndarray, prior: float, epochs: int = 60) -> Network:
    """Minimise the non-negative risk over mini-batches of positives and unlabelled rows."""
    return _local(Network(xu), xp, xu, prior, range(epochs), 7)


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def _part_fit(sent, prior: float | None, rounds: range, seed: int):
    """Local passes over a part; the part's rows are put in order, so that the order they came in is of no effect."""

    def run(part: pa.Table) -> pa.Table:
        start, xp = sent.value
        x = _unpacked(part["x"].combine_chunks())
        x = x[np.lexsort(x.T[::-1])]
        own = Network.__new__(Network)
        own.__dict__ = dict(start.__dict__, p=[a.copy() for a in start.p], m=[np.zeros_like(a) for a in start.p], v=[np.zeros_like(a) for a in start.p], t=0)
        _local(own, xp, x, prior, rounds, seed)
        flat = np.concatenate([a.ravel() for a in own.p])
        return pa.table({"n": pa.array([len(x)], pa.int64()), "p": pa.array([flat.tolist()], pa.list_(pa.float64()))})

    return run


def spread_fit(rows: DataFrame, xp: np.ndarray, net: Network, prior: float | None, rounds: int, seed: int) -> Network:
    """Fit ``net`` on all ``rows`` (part, x): rounds of local passes over each part, after which the parts' networks are averaged by their rows."""
    spark = rows.sparkSession
    shapes = [a.shape for a in net.p]
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((net, xp))

        local = rows.groupBy("part").applyInArrow(_part_fit(sent, prior, range(k * PASSES, (k + 1) * PASSES), seed), "n long, p array<double>")
        mean = local.select("n", F.posexplode("p").alias("i", "v")).groupBy("i").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v"))
        flat = np.zeros(sum(a.size for a in net.p))
        for r in mean.collect():  # one row for each parameter
            flat[r.i] = round(r.v, 9)
        net.p = [x.reshape(shape) for x, shape in zip(np.split(flat, np.cumsum([int(np.prod(t)) for t in shapes])[:-1]), shapes, strict=True)]
        sent.unpersist()
    return net


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sums and sums of squares of each statistic."""
    n, one, two = 0, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for batch in batches:
        x = _unpacked(batch["x"])
        n, one, two = n + len(x), one + x.sum(axis=0), two + (x * x).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(range(1 + 2 * N_FEATURES), pa.int32()), pa.array([float(n), *one, *two])], ["i", "v"])


def _scale(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and deviation of all rows' statistics."""
    v = np.zeros(1 + 2 * N_FEATURES)
    for r in rows.select("x").mapInArrow(_moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        v[r.i] = r.v
    n = max(v[0], 1.0)
    mean = v[1 : N_FEATURES + 1] / n
    return int(v[0]), np.round(mean, 6), np.round(np.sqrt(np.maximum(v[N_FEATURES + 1 :] / n - mean**2, 0)), 6)


def corpus_prior(rows: DataFrame, xp: np.ndarray, net: Network) -> float:
    """The share of positives among all ``rows`` (x): as :func:`estimate_prior`, but every document is counted."""
    sp = np.sort(net.logit(net.scaled(xp)[1::2]))
    model = rows.sparkSession.sparkContext.broadcast((net, sp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, sp = model.value
        count = np.zeros(len(sp) + 1, np.int64)
        for batch in batches:
            count += reached(sp, net.logit(net.scaled(_unpacked(batch["x"]))))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at])], ["at", "k"])

    count = np.zeros(len(sp) + 1, np.int64)
    for r in rows.select("x").mapInArrow(run, "at int, k long").groupBy("at").agg(F.sum("k").alias("k")).collect():
        count[r.at] = r.k
    return prior_of(sp, count)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(*text_bytes(batch["text"]))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            x = _unpacked(batch["x"])
            s = sigmoid(net.logit(net.scaled(x))) if net else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(s), pa.array((s >= 0.3).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x, row): the statistics of every text, written once; row numbers the rows within this table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_features, "doc_id long, x binary")
    return table(rows.withColumn("row", F.monotonically_increasing_id()), "text-statistics")


def train(docs: DataFrame, labels: DataFrame, most: int = 4000) -> tuple[Network | None, float]:
    """The network and the estimated prior; None without positives or documents."""
    return train_on(features(docs), labels, most)


def train_on(rows: DataFrame, labels: DataFrame, most: int = 4000) -> tuple[Network | None, float]:
    """As :func:`train`, from a table made by :func:`features`."""
    good = sample_ids(labelled(labels, "quality").where("label = 1"), most)
    # one row of each labelled id, so that repeated rows do not add to the sample
    found = rows.join(F.broadcast(good), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).select("x").toPandas()
    xp = np.array(sorted(map(tuple, (np.frombuffer(b, np.float32) for b in found["x"]))), np.float64).reshape(-1, N_FEATURES)
    if not len(xp):
        return None, 0.5
    n, mean, sd = _scale(rows)
    xp = np.random.default_rng(1).permutation(xp)
    parts = max(1, -(-n // PART))
    rows = rows.select("x", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(parts)).cast("int").alias("part"), F.pmod(F.xxhash64("row"), F.lit(2)).alias("half"))
    ranks = Network.of(mean, sd, seed=5)
    half = rows.where("half = 0") if n > 1 else rows
    prior = corpus_prior(rows, xp, spread_fit(half, xp[::2], ranks, None, 4, 11))
    return spread_fit(rows, xp, Network.of(mean, sd), prior, 6, 7), prior


def score_quality(docs: DataFrame, labels: DataFrame, most: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text; other columns are not read).

    labels: doc_id, quality; only rows labelled 1 whose id is not held out are learnt from, at most
    ``most`` ids, against all documents as unlabelled. Null and empty texts have zero
    statistics and a score like others; without positives all scores are 0.5. Rows may repeat; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = features(docs)
    model = spark.sparkContext.broadcast(train_on(rows, labels, most)[0])
    return rows.select("doc_id", "x", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
