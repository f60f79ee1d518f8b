"""Toxicity: a factorization machine over hashed terms.

Terms are words and their leading letters; a document has a term or not. The
machine adds to the linear weights the products of learned vectors for each pair of
terms, so that what is harmful only together, such as an insult beside the mention
of a group, is learned as such. It is trained in numpy on a bounded, stratified
sample of labelled documents and scores whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.kernels import WORD, buffer_of, hash_spans, slices, spans, tidy
from quillstream.llm.shared import found, project, stage_table

BITS = 20
PREFIXES = (4, 5, 6)
#: Labelled documents that are read for training, at most, of each label; those with more distinct terms
#: than MOST_TERMS are scored like any other, but not learned from, so that the sample's size is bounded.
SAMPLE, MOST_TERMS = 3000, 16_384
#: Terms that are kept: those whose presence tells most about the label, and all that tell it in pairs.
TERMS, LEAST_DOCS, LEAST_GAIN = 4096, 4, 12.0
#: Terms whose pairs are counted, at most, besides those kept for themselves: the ones that split the sample most evenly; and at once.
PAIRED, PAIR_BLOCK = 8192, 1024
FACTORS, EPOCHS, BATCH, RATE, DECAY = 4, 30, 64, 0.1, 1e-4
_LEADING = np.ones(256, bool)
_LEADING[0x80:0xC0] = False


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of a slice of texts, with repeats, and where those of each text begin and end."""
    buf, offs = buffer_of(pc.utf8_lower(col))
    s, e = spans(buf, offs, WORD[buf])
    at = np.searchsorted(s, offs)
    lead = np.concatenate([[0], np.cumsum(_LEADING[buf])])  # characters before each byte
    firsts = np.flatnonzero(_LEADING[buf])
    columns = [hash_spans(buf, s, e)]
    size = lead[e] - lead[s]
    for n in PREFIXES:
        index = lead[s] + n
        end = np.where(size > n, firsts[np.minimum(index, max(len(firsts) - 1, 0))] if len(firsts) else e, e)
        with np.errstate(over="ignore"):
            columns.append(hash_spans(buf, s, np.minimum(end, e)) + np.uint64(n) * np.uint64(0xC2B2AE3D27D4EB4F))
    flat = np.stack(columns, axis=1).ravel() >> np.uint64(64 - BITS)
    return flat.astype(np.int64), at * len(columns)


@dataclass
class FactorizationMachine:
    """place maps a hashed term to its row of weights and factors, row 0 to none."""

    place: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, present: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """`present` and `owner` list the distinct rows that each of n documents has."""
        linear = np.bincount(owner, self.weight[present], n)
        pair = np.zeros(n)
        for k in range(self.factor.shape[1]):
            v = self.factor[present, k]
            pair += np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n)
        return self.bias + linear + 0.5 * pair

    def score(self, col: pa.Array) -> np.ndarray:
        flat, at = terms(col)
        rows = self.place[flat]
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        some = rows > 0
        key = np.unique(owner[some] * np.int64(len(self.weight)) + rows[some])
        owner, rows = np.divmod(key, len(self.weight))
        z = np.clip(self.logits(rows, owner, len(at) - 1), -30, 30)
        return 1 / (1 + np.exp(-z))


def pair_gains(sets: list[np.ndarray], label: np.ndarray, which: np.ndarray) -> np.ndarray:
    """For each of the terms `which` the most that it and another one of them tell about the label beyond
    what both tell alone, in nats. Every pair is counted, block by block."""
    n, m = len(sets), len(which)
    column = np.full(1 << BITS, -1, np.int32)
    column[which] = np.arange(m)
    order = np.argsort(~label, kind="stable")  # label 1 first
    p = int(label.sum())
    held = [c[c >= 0] for c in (column[sets[i]] for i in order)]
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in held])
    flat = np.concatenate(held) if held else np.zeros(0, np.int32)
    by = np.argsort(flat, kind="stable")
    rows = rows[by]
    ends = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=m))])
    del held, flat, by
    k = np.arange(n + 1, dtype=float)
    klogk = (k * np.log(np.maximum(k, 1))).astype(np.float32)

    def block(lo: int) -> tuple[np.ndarray, np.ndarray]:
        hi = min(m, lo + PAIR_BLOCK)
        x = np.zeros((n, hi - lo), np.float32)
        x[rows[ends[lo] : ends[hi]], np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))] = 1
        return x[:p], x[p:]

    def cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return klogk[a + b] - klogk[a] - klogk[b]

    q = n - p
    every = cell(np.array(p), np.array(q))
    out = np.full(m, -np.inf)
    for lo in range(0, m, PAIR_BLOCK):
        ap, aq = block(lo)
        pa_, qa = ap.sum(axis=0).astype(np.int32)[:, None], aq.sum(axis=0).astype(np.int32)[:, None]
        left = every - cell(pa_, qa) - cell(p - pa_, q - qa)
        for other in range(lo, m, PAIR_BLOCK):
            bp, bq = (ap, aq) if other == lo else block(other)
            pb, qb = bp.sum(axis=0).astype(np.int32)[None, :], bq.sum(axis=0).astype(np.int32)[None, :]
            right = every - cell(pb, qb) - cell(p - pb, q - qb)
            pab, qab = (ap.T @ bp).astype(np.int32), (aq.T @ bq).astype(np.int32)
            rest = cell(pab, qab)
            rest += cell(pa_ - pab, qa - qab)
            rest += cell(pb - pab, qb - qab)
            rest += cell(p - pa_ - pb + pab, q - qa - qb + qab)
            more = every - rest - left - right
            out[lo : lo + PAIR_BLOCK] = np.maximum(out[lo : lo + PAIR_BLOCK], more.max(axis=1))
            out[other : other + PAIR_BLOCK] = np.maximum(out[other : other + PAIR_BLOCK], more.max(axis=0))
    return out


def telling_pairs(sets: list[np.ndarray], label: np.ndarray, has: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Terms not in `alone` that tell the label together with another term, the most telling first.

    Counted are all pairs of terms in `alone` and of PAIRED others at most, in documents enough that a pair could pass: where the
    sample's labels are halved, 35 documents or so. A pair has to tell more than LEAST_GAIN and the logarithm of the number of terms
    that each one could be paired with, so that no more pass by chance than of single terms. Terms that the very same documents hold are one.
    """
    n, p = len(label), int(label.sum())
    often = np.flatnonzero(has >= LEAST_DOCS)
    least = LEAST_GAIN + np.log(max(len(often), 1))
    which = often[has[often] >= least / np.log(n / min(p, n - p))]
    which = which[np.argsort(-np.minimum(has[which], n - has[which]), kind="stable")[:PAIRED]]
    which = np.union1d(which, alone)
    code = np.random.default_rng(0).integers(0, 1 << 63, n, dtype=np.uint64)
    sign = np.zeros(1 << BITS, np.uint64)
    with np.errstate(over="ignore"):
        for s, c in zip(sets, code, strict=True):
            sign[s] += c
    _, first, back = np.unique(sign[which], return_index=True, return_inverse=True)
    gain = pair_gains(sets, label, which[first])[back]
    gain[np.isin(which, alone)] = -np.inf
    best = np.argsort(-gain, kind="stable")
    return which[best[gain[best] > least]]


def fit(sets: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> FactorizationMachine:
    """AdaGrad on the logistic loss; `sets` holds the distinct hashed terms of each document."""
    n = len(sets)
    place = np.zeros(1 << BITS, np.int32)
    y = np.asarray(labels, float)
    if not n or y.min() == y.max():
        rate = (y.sum() + 0.5) / (n + 1)
        return FactorizationMachine(place, float(np.log(rate / (1 - rate))) if n else -5.0, np.zeros(1), np.zeros((1, FACTORS)))
    has, pos = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for s, label in zip(sets, y > 0, strict=True):
        has[s] += 1
        pos[s] += label
    often = np.flatnonzero(has >= LEAST_DOCS)
    here, hit = has[often].astype(float), pos[often].astype(float)
    p, q = y.sum(), n - y.sum()

    def entropy(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        t = np.maximum(a + b, 1e-9)
        return -sum(np.where(x > 0, x / t * np.log(np.maximum(x, 1e-9) / t), 0) for x in (a, b)) * t

    gain = entropy(np.array([p]), np.array([q]))[0] - entropy(hit, here - hit) - entropy(p - hit, q - (here - hit))
    best = np.argsort(-gain, kind="stable")[:TERMS]
    best = often[best[gain[best] > LEAST_GAIN]]  # what chance alone gives is no reason to keep a term
    best = np.concatenate([best, telling_pairs(sets, y > 0, has, best)])
    place[best] = np.arange(1, len(best) + 1)
    size = len(best) + 1
    rows = [np.unique(place[s][place[s] > 0]) for s in sets]
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)), 0.0
    v[0] = 0
    gw, gv, gb = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            take = order[lo : lo + BATCH]
            own = np.repeat(np.arange(len(take)), [len(rows[i]) for i in take])
            r = np.concatenate([rows[i] for i in take]).astype(np.int64)
            total = np.stack([np.bincount(own, v[r, k], len(take)) for k in range(FACTORS)], axis=1)
            square = np.bincount(own, (v[r] ** 2).sum(axis=1), len(take))
            z = bias + np.bincount(own, w[r], len(take)) + 0.5 * ((total**2).sum(axis=1) - square)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) / len(take)
            u, back = np.unique(r, return_inverse=True)
            dw = np.bincount(back, d[own], len(u)) + DECAY * w[u]
            dv = np.stack([np.bincount(back, d[own] * (total[own, k] - v[r, k]), len(u)) for k in range(FACTORS)], axis=1) + DECAY * v[u]
            gw[u] += dw**2
            gv[u] += dv**2
            gb += d.sum() ** 2
            w[u] -= RATE * dw / np.sqrt(gw[u])
            v[u] -= 0.3 * RATE * dv / np.sqrt(gv[u])
            bias -= RATE * d.sum() / np.sqrt(gb)
    return FactorizationMachine(place, float(bias), w, v)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_terms: int = MOST_TERMS) -> FactorizationMachine:
    """Fit on labelled documents that are not held out: `sample` of each label at most,
    those whose hashed doc_id is least, and of these the ones with `most_terms` distinct terms at most, so that
    2 * sample * most_terms terms bound the sample; it is all that is fitted on, whatever the table's size. Only hashed terms reach the driver."""
    known = project(labels, doc_id="bigint", toxic="int").where("doc_id is not null and toxic is not null")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    known = known.where(fold != 0).select("doc_id", (F.col("toxic") > 0).cast("int").alias("label")).distinct()
    picked = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.union(part)
    chosen = {r["doc_id"]: r["label"] for r in picked.collect()}
    ids = docs.sparkSession.createDataFrame(list(chosen.items()), "doc_id bigint, label int")
    texts = project(docs, doc_id="bigint", text="string").join(F.broadcast(ids), "doc_id")  # 2 * sample ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column("text")):
                flat, at = terms(part)
                sets = [np.unique(flat[a:b]).astype(np.int32) for a, b in zip(at[:-1], at[1:], strict=True)]
                short = pa.array([len(s) <= most_terms for s in sets])
                columns = [batch.column(c).slice(start, len(part)) for c in ("doc_id", "label")]
                body = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, body], ["doc_id", "label", "terms"]).filter(short)

    rows = stage_table(texts.mapInArrow(tidy(run), "doc_id bigint, label int, terms binary"), "toxicity-sample")
    seen = [(r["doc_id"], r["label"], np.frombuffer(bytes(r["terms"]), np.int32)) for r in rows.toLocalIterator()]
    seen.sort(key=lambda r: (r[0], r[1], len(r[2])))
    return fit([t for _, _, t in seen], np.array([x for _, x, _ in seen]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each document.

    held_out tells that crc32 of the doc_id as text is 0 modulo 5; such rows are never
    learned from. A score comes from the text alone; a null or empty text has no terms
    and gets the score of the bias. predicted is 1 from a score of 0.5. Texts are read whole, in slices
    of bounded size. A null doc_id is not held out and has no label. Repeated rows score
    alike, an empty table gives no rows, and without labels of both kinds every score is the same. What is learned from
    is a bounded sample, as train says.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))  # bounded by BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column("text")):
                ids = batch.column("doc_id").slice(start, len(part))
                score = model.value.score(part)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    rows = project(docs, doc_id="bigint", text="string")
    return rows.mapInArrow(tidy(run), "doc_id bigint, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents whose score is under 0.5, with all their columns; a table without texts is one of empty texts.

    Nulls, repeated rows and an empty table are treated as by toxicity_scores.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    plain = plain.withColumn("__text", found(names, "text").cast("string"))
    schema = plain.drop("__text").schema
    columns = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column("__text")):
                stay = pa.array(model.value.score(part) < 0.5)
                yield batch.slice(start, len(part)).select(columns).filter(stay)

    return plain.mapInArrow(tidy(run), schema).toDF(*names)
