"""Language identification by the nearest of several centroids for each language.

A text's bytes in lower case, with what is no letter as a space, give hashed n-gram counts; the
vector is log counts times inverse document frequency, of length 1. Each language has several
centroids (spherical k-means); a text gets the language of the centroid with the largest cosine.
A text whose cosine is below what its language's own held-out texts of about its size reach is rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small_batches
from .words import text_bytes

DIMS, GRAMS = 4096, (2, 3)
#: Rows and bytes of texts that are counted at once: arrays of eight bytes for each byte and each dimension are made of them.
ROWS, BYTES = 64, 1 << 18
#: Labelled rows of a language that the centroids are fitted on, about, and languages (the most frequent); bounds of the fit alone.
SAMPLE, LANGUAGES, CENTROIDS = 600, 1000, 4
#: Bounds of rejection: they keep all but this share of a language's held-out texts and of their beginnings of CUTS bytes.
REJECT, CUTS = 0.01, (4, 8, 16, 32, 64, 128, 256, 512, 1024)
_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    m = _LETTER.search(text) if text else None
    return bool(m) and (m[0].isalpha() or any(c.isalpha() for c in text))


def counts(column: pa.Array):
    """Yields (first row, counts of hashed n-grams by row) for blocks of rows of bounded size."""
    raw, offsets = text_bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, min(at + ROWS, len(column), int(np.searchsorted(offsets, offsets[at] + BYTES))))
        x = _PLAIN[raw[offsets[at] : offsets[to]]].astype(np.uint32)
        ends = offsets[at + 1 : to + 1] - offsets[at]
        total = np.zeros((to - at) * DIMS, np.int64)
        for n in GRAMS:
            size = len(x) - n + 1
            if size <= 0:
                continue
            h = np.zeros(size, np.uint32)
            for j in range(n):
                h = h * np.uint32(257) + x[j : j + size]
            h = (h * np.uint32(2654435761)) >> np.uint32(20)
            row = np.repeat(np.arange(to - at), np.diff(np.concatenate([[0], ends])))[:size]
            inside = np.ones(size, bool)
            for j in range(1, n):
                cut = ends - j
                inside[cut[(cut >= 0) & (cut < size)]] = False
            total += np.bincount(row[inside] * DIMS + h[inside], minlength=len(total))
        yield at, total.reshape(to - at, DIMS)
        at = to


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c).astype(np.float32) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm, norm, 1)


def training_rows(docs: DataFrame, label: str = "lang") -> DataFrame:
    """Rows that may be learned from: text and label, and crc32 of the id as text is not 1 modulo 3."""
    return docs.filter(F.col("text").isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))


def fit(docs: DataFrame, label: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> dict:
    """The model: labels, centroids and their labels, idf, and each label's rejection bounds by size of a text.

    Learns from about ``sample`` rows of each label, chosen by a hash of the id, two thirds of them
    if there are fewer; half as many others set the bounds. Of more than LANGUAGES labels, the most frequent ones.
    """
    small_batches(docs.sparkSession)
    rows = training_rows(docs, label).select("doc_id", "text", F.col(label).cast("string").alias("label"))
    many = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LANGUAGES).collect()
    share = docs.sparkSession.createDataFrame([(r["label"], max(1.0, r["count"] / (sample * 3 // 2))) for r in many], "label string, share double")
    # from 0 to 1, and beyond for rows that are not drawn
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / F.lit(float(1 << 52)) * F.col("share")
    chosen = rows.join(F.broadcast(share), "label").withColumn("place", place).filter("place < 1").withColumn("held", F.col("place") >= 2 / 3)

    def run(batches):
        for b in batches:
            plain, labels, held = [], [], []
            for t, label, h in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), b.column("held").to_pylist()):
                parts = [t, *beginnings(t)] if h else [t]
                plain, labels, held = plain + parts, labels + [label] * len(parts), held + [h] * len(parts)
            for at, c in counts(pa.array(plain, pa.string())):
                for i, row in enumerate(c):
                    if has_letter(plain[at + i]):
                        dims = np.flatnonzero(row)
                        yield pa.RecordBatch.from_pydict({"label": pa.array([labels[at + i]]), "held": pa.array([held[at + i]]), "dims": pa.array([dims.astype("<u2").tobytes()]), "n": pa.array([row[dims].astype("<i4").tobytes()])})

    got = arrow_map(chosen.select("label", "held", "text"), run, "label string, held boolean, dims binary, n binary").collect()  # bytes: the driver holds no numbers as objects
    got.sort(key=lambda r: (r.label, r.dims, r.n))
    labels = sorted({r.label for r in got})
    if not labels:
        return {"labels": [], "of": np.zeros(0, int), "centres": np.zeros((0, DIMS), np.float32), "idf": np.ones(DIMS, np.float32), "least": np.zeros((0, 16))}
    # a label with rows on one side alone uses them on both
    learned, kept = {r.label for r in got if not r.held}, {r.label for r in got if r.held}
    held = [r for r in got if r.held or r.label not in kept]
    got = [r for r in got if not r.held or r.label not in learned]
    c = _dense(got)
    idf = (np.log((1 + len(c)) / (1 + (c > 0).sum(axis=0))) + 1).astype(np.float32)
    x, y = weighted(c, idf), np.array([labels.index(r.label) for r in got])
    centres, of = [], []
    for k in range(len(labels)):
        own = x[y == k]
        mine = _cluster(own, min(centroids, len(own)))
        centres.append(mine)
        of += [k] * len(mine)
    model = {"labels": labels, "of": np.array(of), "centres": np.concatenate(centres), "idf": idf}
    return model | {"least": _bounds(held, model)}


def beginnings(text: str) -> list[str]:
    """The text's beginnings of CUTS bytes, as far as it is longer; a character that is cut is left out."""
    raw = text.encode()
    return [raw[:n].decode(errors="ignore") for n in CUTS if n < len(raw)]


def sizes(c: np.ndarray) -> np.ndarray:
    """The size class of rows: the binary digits of their number of different n-grams."""
    return np.frexp((c > 0).sum(axis=1))[1]


def noise(n: int = 200, seed: int = 5) -> list[str]:
    """Texts of random letters in words of random lengths, and their beginnings."""
    r = np.random.default_rng(seed)
    out = ["".join(chr(x) for x in np.where(r.random(2048) < 1 / 6, 32, r.integers(97, 123, 2048))) for _ in range(n)]
    return [x for t in out for x in [t, *beginnings(t)] if has_letter(x)]


def _dense(rows: list) -> np.ndarray:
    c = np.zeros((len(rows), DIMS), np.int32)
    for i, r in enumerate(rows):
        c[i, np.frombuffer(r.dims, "<u2")] = np.frombuffer(r.n, "<i4")
    return c


def _bounds(held: list, model: dict) -> np.ndarray:
    """Each label's bound by size class: what all but REJECT of its own rows reach.

    Where all but REJECT of the other labels' rows and of noise are lower, the bound is in the
    middle between both. A class without own rows has the bound of the next lower one with some.
    """
    cosines, classes, owner = [], [], []

    def add(c: np.ndarray, who) -> None:
        cos = weighted(c, model["idf"]) @ model["centres"].T
        cosines.append(np.stack([cos[:, model["of"] == k].max(axis=1) for k in range(len(model["labels"]))], axis=1))
        classes.append(sizes(c))
        owner.extend(who)

    for i in range(0, len(held), 256):
        add(_dense(held[i : i + 256]), [model["labels"].index(r.label) for r in held[i : i + 256]])
    for _, c in counts(pa.array(noise(), pa.string())):
        add(c, [-1] * len(c))
    cosines, classes, owner = np.concatenate(cosines), np.concatenate(classes), np.array(owner)
    least = np.full((len(model["labels"]), 16), np.nan)
    for k in range(len(least)):
        for b in range(least.shape[1]):
            own, other = (cosines[(classes == b) & z, k] for z in (owner == k, owner != k))
            if len(own):
                low = float(np.quantile(own, REJECT))
                high = float(np.quantile(other, 1 - REJECT)) if len(other) else low
                least[k, b] = (low + min(low, high)) / 2
        known = np.flatnonzero(~np.isnan(least[k]))
        least[k] = least[k, known[np.maximum(0, np.searchsorted(known, np.arange(least.shape[1]), side="right") - 1)]]
    return least


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the mean and then the rows farthest from all centres."""
    centre = x.mean(axis=0)
    out = [centre / (np.linalg.norm(centre) or 1)]
    for _ in range(k - 1):
        out.append(x[int(np.argmin((x @ np.array(out).T).max(axis=1)))])
    c = np.array(out)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(k):
            if (near == j).any():
                m = x[near == j].mean(axis=0)
                c[j] = m / (np.linalg.norm(m) or 1)
    return c


def predict(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns, lang_pred, score and rejected of every row; kept columns of these names give way.

    und, 0 and rejected: a null text, one without a letter, or nothing was learned. Rows are judged
    one by one, so repeated ones get the same answer; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("lang_pred", "score", "rejected")]
    columns = list(dict.fromkeys([*keep, "text"]))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column("text")
            known = np.array([has_letter(t) for t in texts.to_pylist()], bool) & bool(len(m["labels"]))
            best, score, size = np.zeros(len(known), int), np.zeros(len(known)), np.zeros(len(known), int)
            if len(m["labels"]):
                for at, c in counts(texts):
                    cos = weighted(c, m["idf"]) @ m["centres"].T
                    best[at : at + len(c)] = cos.argmax(axis=1)
                    score[at : at + len(c)] = cos.max(axis=1)
                    size[at : at + len(c)] = sizes(c)
            lang = m["of"][best] if len(m["of"]) else best
            names = np.array([*m["labels"], "und"], object)
            score = np.where(known, np.clip(score, 0, 1), 0.0)
            least = m["least"][lang, size] if len(m["of"]) else np.ones(len(known))
            extra = {"lang_pred": pa.array(names[np.where(known, lang, len(m["labels"]))], pa.string()), "score": pa.array(score), "rejected": pa.array(~known | (score < least))}
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in keep} | extra)

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "lang_pred string, score double, rejected boolean"])
    return arrow_map(docs.select(*columns), run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row; a null doc_id is not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
