"""Secret scans: fixed patterns, and a character convolutional network over all candidates.

The patterns' findings are kept as they are. They also label the candidates (long runs of key
characters) on which a small network is trained: characters of the candidate and its context are
embedded, convolved, max-pooled and scored. Each candidate is learned with its context and without,
and there in either case, so that a key is known where no keyword tells of it. Two thirds of all views train: they are
dealt over buckets, tasks run the same network through one each, and after a round the networks are averaged. Scores are
calibrated on all others. The highest score that keeps the wanted recall there, in all these views, is found; the
threshold is midway between it and the next score of a candidate without finding, which costs no recall and no false
finding there. Candidates apart from the patterns' findings that reach it are added as kind ``cnn``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
KINDS = ("assign", "access", "hex", "cnn")
#: Characters of context on each side, and of a candidate in one view; longer ones get several views.
SIDE, BODY = 24, 48
#: Views in one bucket of the training; with more views than BUCKETS times that, buckets have more, a block after the other.
BLOCK, BUCKETS = 4096, 128
ROUNDS, RECALL = 8, 0.99
#: Steps in a logit, and the logits beyond which scores are not told apart: what held-out counts are by.
STEPS, FAR = 256, 32
EMBED, FILTERS, WIDTH = 8, 24, 5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' findings, sorted."""
    out, low = [], text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters: 16 and more, or 12 and more with a digit."""
    out = []
    for m in CANDIDATE.finditer(text):
        if m.end() - m.start() >= 16 or any("0" <= c <= "9" for c in m[0]):
            out.append(m.span())
    return out


def cuts(start: int, end: int) -> list[tuple[int, int]]:
    """Parts of a candidate that are in one view each; they overlap by half."""
    first = range(start, max(start + 1, end - BODY // 2), BODY // 2) if end - start > BODY else [start]
    return [(at, min(end, at + BODY)) for at in first]


def view(text: str, at: int, to: int) -> np.ndarray:
    """Codes of context, body and context: ASCII as it is, others 1, nothing 0; body codes are 128 higher."""
    x = np.zeros(2 * SIDE + BODY, np.int64)
    for place, part, plus in ((SIDE - min(SIDE, at), text[max(0, at - SIDE) : at], 0), (SIDE, text[at:to], 128), (SIDE + to - at, text[to : to + SIDE], 0)):
        codes = np.frombuffer(part.encode("utf-32-le"), "<u4")
        x[place : place + len(codes)] = np.where(codes < 128, codes, 1) + plus
    return x


def views(text: str, start: int, end: int) -> list[np.ndarray]:
    """The views of a candidate; longer ones have several."""
    return [view(text, at, to) for at, to in cuts(start, end)]


def labelled(text: str):
    """Bytes of every view of every candidate, and whether a finding overlaps its body."""
    base = base_spans(text)
    place = 0
    for s, e in candidates(text):
        for at, to in cuts(s, e):
            while place < len(base) and base[place][2] <= at:
                place += 1
            hit = place < len(base) and base[place][0] < to
            yield view(text, at, to).astype(np.uint8).tobytes(), hit


def bare(x: np.ndarray) -> np.ndarray:
    """Views without their context."""
    return np.where(x >= 128, x, 0)


def swapped(x: np.ndarray) -> np.ndarray:
    """Views with capitals for small letters and the other way round."""
    c = x & 127
    return x + np.where((c >= 97) & (c <= 122), -32, np.where((c >= 65) & (c <= 90), 32, 0))


class Network:
    """Embedding, one convolution, ReLU, max over places, logistic output; trained by Adam."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.3, (256, EMBED)), "w": r.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)), "b": np.zeros(FILTERS), "v": r.normal(0, 0.3, FILTERS), "c": np.zeros(1)}
        self.m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        self.t = 0.0
        self.scale = (1.0, 0.0)

    def state(self) -> np.ndarray:
        """Parameters and what Adam remembers, in one row that can be averaged."""
        return np.concatenate([x.ravel() for k, v in self.p.items() for x in (v, *self.m[k])] + [[self.t]])

    def restore(self, state: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            parts = [state[at + i * v.size : at + (i + 1) * v.size].reshape(v.shape).copy() for i in range(3)]
            self.p[k], self.m[k] = parts[0], parts[1:]
            at += 3 * v.size
        self.t = float(state[at])

    def forward(self, x: np.ndarray):
        n, size = x.shape
        e = self.p["e"][x]
        cols = np.concatenate([e[:, i : size - WIDTH + 1 + i] for i in range(WIDTH)], axis=2)
        z = cols @ self.p["w"] + self.p["b"]
        top = z.argmax(axis=1)
        h = np.maximum(np.take_along_axis(z, top[:, None], 1)[:, 0], 0)
        return h @ self.p["v"] + self.p["c"][0], (cols, top, h)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 256])[0] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def learn(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, r: np.random.Generator, rate: float = 0.01) -> None:
        """One pass over views in random order."""
        order = r.permutation(len(x))
        for i in range(0, len(x), 64):
            part = order[i : i + 64]
            logit, (cols, top, h) = self.forward(x[part])
            d = weight[part] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[part]) / len(part)
            dh = np.outer(d, self.p["v"]) * (h > 0)
            picked = np.take_along_axis(cols, top[:, :, None], 1)  # n, filters, width * embed
            g = {"v": h.T @ d, "c": np.array([d.sum()]), "b": dh.sum(0), "w": np.einsum("nf,nfk->kf", dh, picked), "e": np.zeros_like(self.p["e"])}
            back = dh[:, :, None] * self.p["w"].T[None]  # n, filters, width * embed
            for j in range(WIDTH):
                np.add.at(g["e"], np.take_along_axis(x[part], top + j, 1), back[:, :, j * EMBED : (j + 1) * EMBED])
            self.t += 1
            for k in self.p:
                self.m[k][0] = 0.9 * self.m[k][0] + 0.1 * g[k]
                self.m[k][1] = 0.999 * self.m[k][1] + 0.001 * g[k] ** 2
                self.p[k] = self.p[k] - rate * (self.m[k][0] / (1 - 0.9**self.t)) / (np.sqrt(self.m[k][1] / (1 - 0.999**self.t)) + 1e-8)

    def calibrate(self, logit: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Platt scaling of logits that are there ``n`` times: probability 1 / (1 + exp(-(a logit + b))), a and b by Newton steps."""
        goal = np.where(y, (n[y].sum() + 1) / (n[y].sum() + 2), 1 / (n[~y].sum() + 2))

        def loss(a, b):
            z = a * logit + b
            return (n * (np.logaddexp(0, z) - goal * z)).sum()

        a, b = 0.0, float(np.log(n[y].sum() / n[~y].sum()))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
            s, d = n * (p * (1 - p) + 1e-9), n * (p - goal)
            hess = np.array([[(s * logit * logit).sum() + 1e-3, (s * logit).sum()], [(s * logit).sum(), s.sum() + 1e-3]])
            step = np.linalg.solve(hess, np.array([(d * logit).sum(), d.sum()]))
            # whole Newton steps may leave separated scores far behind
            while abs(step).max() > 1e-6 and loss(a - step[0], b - step[1]) > loss(a, b):
                step = step / 2
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-6:
                break
        self.scale = (max(float(a), 1e-3), float(b))

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logit + self.scale[1], -30, 30)))


def steps(logit: np.ndarray) -> np.ndarray:
    """Logits in whole steps."""
    return np.floor(np.clip(logit, -FAR, FAR) * STEPS).astype(np.int64)


def _views(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Views of a batch with their labels, in all three forms."""
    x = np.array([np.frombuffer(v, np.uint8) for v in b.column("x").to_pylist()], np.int64).reshape(-1, 2 * SIDE + BODY)
    return np.concatenate([x, bare(x), swapped(bare(x))]), np.tile(np.array(b.column("y").to_pylist(), bool), 3)


def _round(train: DataFrame, buckets: int, state: np.ndarray, weights: tuple[float, float], turn: int) -> np.ndarray:
    """The network after one pass over all of ``train``: each bucket by itself from ``state``, then their average."""
    shared = train.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        net, held, bucket, n, at = Network(), [], None, 0, 0

        def learn():
            nonlocal held, n, at
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, (x, y) = [], _views(part)
            net.learn(x, y, np.where(y, weights[1], weights[0]), np.random.default_rng([11, turn, bucket, at]))
            n, at = n + len(y), at + 1

        def done():
            return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([n], pa.int64()), "state": pa.array([net.state().tobytes()], pa.binary())})

        # rows come by bucket; a block is learned when it is full or its bucket ends
        for b in batches:
            own, start = b.column("bucket").to_numpy(), 0
            while start < len(own):
                if own[start] != bucket:
                    if held:
                        learn()
                    if bucket is not None:
                        yield done()
                    bucket, n, at = int(own[start]), 0, 0
                    net.restore(shared.value)
                room = BLOCK - sum(map(len, held))
                end = start + min(room, int(np.searchsorted(own[start:], bucket, "right")))
                held.append(b.slice(start, end - start))
                if sum(map(len, held)) == BLOCK:
                    learn()
                start = end
        if held:
            learn()
        if bucket is not None:
            yield done()

    dealt = train.repartition(buckets, "bucket").sortWithinPartitions("bucket", "h", "x")
    got = sorted(arrow_map(dealt, run, "bucket int, n long, state binary").collect(), key=lambda r: r.bucket)
    shared.destroy()
    return np.average([np.frombuffer(r.state) for r in got], axis=0, weights=[r.n for r in got])


def fit(docs: DataFrame, recall: float = RECALL) -> dict | None:
    """The model: network and threshold; None where all texts lack findings or other candidates.

    Every view of every candidate takes part, equal ones once. A hash lets two thirds train the
    network; the rest calibrate it and set the threshold: from the highest step of the logit with at
    least ``recall`` of the findings half the way down to the next step of another candidate.
    Where all of a kind fall on one side, they do both.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)

    def run(batches):
        def out(rows):
            return pa.RecordBatch.from_pydict({"x": pa.array([x for x, _ in rows], pa.binary()), "y": pa.array([y for _, y in rows], pa.bool_())})

        held = {}
        for b in batches:
            for t in b.column("text").to_pylist():
                for x, hit in labelled(t):
                    held[x] = hit or held.get(x, False)
                    if len(held) >= BLOCK:
                        yield out(held.items())
                        held = {}
        yield out(held.items())

    got = arrow_map(docs.filter("text IS NOT NULL").select("text"), run, "x binary, y boolean").groupBy("x").agg(F.max("y").alias("y"))
    got = scratch.keep(got.withColumn("h", F.xxhash64("x")).withColumn("hold", F.pmod("h", F.lit(3)) == 0), "views")
    counts = {(r.y, r.hold): r["count"] for r in got.groupBy("y", "hold").count().collect()}
    both = [y for y in (False, True) if len({h for k, h in counts if k == y}) == 1]
    seen = [sum(n for (k, _), n in counts.items() if k == y) for y in (False, True)]
    if not all(seen):
        return None
    used = [seen[y] if y in both else counts[y, False] for y in (False, True)]
    weights = (sum(used) / (2 * used[0]), sum(used) / (2 * used[1]))
    buckets = min(BUCKETS, -(-sum(used) // BLOCK))
    train = got.filter(~F.col("hold") | F.col("y").isin(both)).withColumn("bucket", F.pmod(F.xxhash64("x", F.lit("bucket")), F.lit(buckets)).cast("int"))
    net = Network()
    for turn in range(ROUNDS):
        net.restore(_round(train, buckets, net.state(), weights, turn))
    shared = docs.sparkSession.sparkContext.broadcast(net.p)

    def score(batches):
        one = Network()
        one.p = shared.value
        for b in batches:
            x, y = _views(b)
            for k in (False, True):
                q, n = np.unique(steps(one.logits(x[y == k])), return_counts=True)
                yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int64()), "y": pa.array([k] * len(q), pa.bool_()), "n": pa.array(n, pa.int64())})

    # at most one row for each step and label
    held = arrow_map(got.filter(F.col("hold") | F.col("y").isin(both)), score, "q long, y boolean, n long").groupBy("q", "y").agg(F.sum("n").alias("n")).collect()
    shared.destroy()
    scratch.drop("views")
    held = sorted((r.q, r.y, r.n) for r in held)
    q, y, n = np.array([h[0] for h in held]), np.array([h[1] for h in held], bool), np.array([h[2] for h in held])
    net.calibrate((q + 0.5) / STEPS, y, n)
    above = np.cumsum(n[y][::-1])
    cut = int(q[y][::-1][np.searchsorted(above, np.ceil(recall * above[-1]))])
    cut -= (cut - int(max(q[~y & (q < cut)], default=-FAR * STEPS))) // 2
    share = lambda k: float(n[(y == k) & (q >= cut)].sum() / n[y == k].sum())
    return {"net": net, "cut": cut, "threshold": float(net.probability(np.array(cut / STEPS))), "recall": share(True), "false": share(False), "learned": sum(seen)}


def scan(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn of every row; null text: empty.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by commas.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model["net"].p, model["cut"]))

    def run(batches):
        got = shared.value
        if got:
            net = Network()
            net.p = got[0]
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            more, where, seen = [[] for _ in texts], [], []
            for i, t in enumerate(texts if got else ()):
                for s, e in candidates(t):
                    if not any(x < e and s < f for x, _, f in base[i]):
                        for v in views(t, s, e):
                            seen.append(v)
                            where.append((i, s, e))
            if seen:
                hit = steps(net.logits(np.array(seen))) >= got[1]
                for i, s, e in dict.fromkeys(w for w, h in zip(where, hit.tolist()) if h):
                    more[i].append((s, 3, e))
            say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
            counts = {f"n_{KINDS[k]}": pa.array([sum(x[1] == k for x in s) for s in base], pa.int64()) for k in range(3)}
            sha = [hashlib.sha256(say(s).encode()).hexdigest() for s in base]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64())} | counts | {"base_sha256": pa.array(sha, pa.string()), "spans": pa.array([say(sorted(x + y)) for x, y in zip(base, more)], pa.string()), "n_cnn": pa.array([len(m) for m in more], pa.int64())})

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long")


def find_secrets(docs: DataFrame) -> DataFrame:
    """Patterns and the network fitted on the same documents; columns as in ``scan``.

    A null text counts as empty, repeated rows get the same spans, a null doc_id stays null, and
    an empty table gives an empty result. Without findings, or without other candidates, there is
    nothing to learn from and the patterns stand alone.
    """
    return scan(docs, fit(docs))
