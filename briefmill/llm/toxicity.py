"""Toxicity (operator 8): a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word's input is the sum of a word vector (hashed to ``WORDS`` rows) and the mean of the vectors of its byte trigrams
(hashed to ``CHARS`` rows). A network runs over overlapping windows of ``WINDOW`` words that cover the whole text; a
document's score is that of its worst window. Fitting sees a bounded sample of labelled rows (``max_train`` documents,
whole) in one task; scoring is a map over the documents without any shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm import textvec
from briefmill.llm.scratch import discard, settle

WINDOW, STRIDE = 64, 48
WORDS, CHARS, DIM, HIDDEN, ATTENTION = 1 << 15, 1 << 12, 16, 8, 8
_TRIGRAM = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Words:
    """The words of a chunk of texts: distinct ones with their buckets and trigrams, and each text's sequence of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        h, _, starts, ends = textvec.tokens(data, offsets)
        word = textvec._KIND[data[starts]] == 1 if len(starts) else np.zeros(0, bool)
        h, starts, ends = h[word], starts[word], ends[word]
        self.first = np.searchsorted(starts, offsets)
        distinct, at, self.ids = np.unique(h, return_index=True, return_inverse=True)
        self.hash = distinct
        self.bucket = (distinct % np.uint64(WORDS)).astype(np.int64)
        low = textvec._LOWER[data].astype(np.uint64)
        s, e = starts[at], ends[at]
        tri_end = np.maximum(e - 2, s + 1)
        pos = textvec.spread(s, tri_end)
        inside = np.repeat(e, tri_end - s)
        code = np.zeros(len(pos), np.uint64)
        for k in range(3):
            there = pos + k < inside
            code += np.where(there, (low[np.minimum(pos + k, len(low) - 1)] + np.uint64(1)) * _TRIGRAM[k], np.uint64(0))
        self.tri = (textvec.mix(code) % np.uint64(CHARS)).astype(np.int64)
        self.tri_n = tri_end - s
        self.tri_at = np.cumsum(self.tri_n) - self.tri_n

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end word of each window, and the text it is in; a text without words has no window."""
        n = np.diff(self.first)
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        doc = np.repeat(np.arange(len(n)), count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = self.first[:-1][doc] + k * STRIDE
        return start, np.minimum(start + WINDOW, self.first[1:][doc]), doc

    def vectors(self, by_word: np.ndarray, by_tri: np.ndarray) -> np.ndarray:
        """Each distinct word's row of ``by_word`` plus the mean of its trigrams' rows of ``by_tri``."""
        total = np.zeros((len(self.bucket), by_tri.shape[1]), by_tri.dtype)
        order = np.argsort(-self.tri_n, kind="stable")
        at, n = self.tri_at[order], -self.tri_n[order]
        for k in range(min(24, -int(n.min(initial=0)))):  # the k-th trigram of all words that have one
            most = int(np.searchsorted(n, -k, "left"))
            total[:most] += by_tri[self.tri[at[:most] + k]]
        for i in range(int(np.searchsorted(n, -24, "left"))):  # the few long words
            total[i] += by_tri[self.tri[at[i] + 24 : at[i] - n[i]]].sum(0)
        out = by_word[self.bucket]
        out[order] += total / -n[:, None].astype(by_tri.dtype)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def new_parameters(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {"word": np.zeros((WORDS, DIM)), "char": r.normal(0, 0.05, (CHARS, DIM))}
    for way in "fb":
        p |= {f"W{way}": r.normal(0, 0.3, (DIM, 3 * HIDDEN)), f"U{way}": r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"c{way}": np.zeros(3 * HIDDEN)}
    p |= {"A": r.normal(0, 0.3, (2 * HIDDEN, ATTENTION)), "v": r.normal(0, 0.3, ATTENTION), "w": r.normal(0, 0.3, 2 * HIDDEN), "b": np.full(1, -1.0)}
    return {k: x.astype(np.float32) for k, x in p.items()}


def _steps(inputs: np.ndarray, ids: np.ndarray, mask: np.ndarray, U: np.ndarray, order: range, keep: list | None) -> np.ndarray:
    """Hidden states (step, window, unit) of one direction; ``inputs`` are the projected words, ``ids`` (step, window)."""
    H = HIDDEN
    h = np.zeros((ids.shape[1], H), np.float32)
    out = np.zeros((ids.shape[0], ids.shape[1], H), np.float32)
    for t in order:
        x, g, m = inputs[ids[t]], h @ U, mask[t][:, None]
        zr = _sigmoid(x[:, : 2 * H] + g[:, : 2 * H])
        z, r, q = zr[:, :H], zr[:, H:], g[:, 2 * H :]
        n = np.tanh(x[:, 2 * H :] + r * q)
        new = h + m * (1 - z) * (n - h)
        if keep is not None:
            keep.append((t, h, z, r, q, n, m))
        h = out[t] = new
    return out


def projected(p: dict[str, np.ndarray], words: Words) -> np.ndarray:
    """The inputs of both directions' gates for each distinct word."""
    x = words.vectors(p["word"], p["char"])
    return x @ np.concatenate([p["Wf"], p["Wb"]], 1) + np.r_[p["cf"], p["cb"]]


def forward(p: dict[str, np.ndarray], words: Words, start: np.ndarray, end: np.ndarray, seen: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """The logit of each window; ``seen`` are the projected words."""
    step = np.arange(int((end - start).max()))[:, None]
    at = np.minimum(start + step, end - 1)
    ids, mask = words.ids[at], (start + step < end).astype(np.float32)
    n = 3 * HIDDEN
    kept = ([], []) if keep is not None else (None, None)
    hf = _steps(np.ascontiguousarray(seen[:, :n]), ids, mask, p["Uf"], range(len(ids)), kept[0])
    hb = _steps(np.ascontiguousarray(seen[:, n:]), ids, mask, p["Ub"], range(len(ids))[::-1], kept[1])
    h = np.concatenate([hf, hb], 2)
    u = np.tanh(h @ p["A"])
    e = np.exp(u @ p["v"]) * mask
    a = e / e.sum(0)
    c = np.einsum("tb,tbh->bh", a, h)
    if keep is not None:
        keep |= {"ids": ids, "mask": mask, "kept": kept, "h": h, "u": u, "a": a, "c": c}
    return c @ p["w"] + p["b"][0]


def gradients(p: dict[str, np.ndarray], words: Words, k: dict, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of all parameters, given those of the logits and what ``forward`` kept."""
    H = HIDDEN
    g = {"w": k["c"].T @ d_logit, "b": d_logit.sum(keepdims=True)[:1]}
    dc = d_logit[:, None] * p["w"]
    da = np.einsum("bh,tbh->tb", dc, k["h"])
    ds = k["a"] * (da - (k["a"] * da).sum(0))
    g["v"] = np.einsum("tb,tba->a", ds, k["u"])
    du = ds[:, :, None] * p["v"] * (1 - k["u"] ** 2)
    g["A"] = np.einsum("tbh,tba->ha", k["h"], du)
    dh_all = k["a"][:, :, None] * dc + du @ p["A"].T
    d_in = np.zeros((len(words.bucket), 6 * H), np.float32)
    for i, way in enumerate("fb"):
        U, dU, carry = p[f"U{way}"], np.zeros_like(p[f"U{way}"]), 0
        for t, h, z, r, q, n, m in reversed(k["kept"][i]):
            d = dh_all[t][:, i * H : (i + 1) * H] + carry
            dn, dz = d * m * (1 - z), d * m * (h - n)
            dn, dz = dn * (1 - n * n), dz * z * (1 - z)
            dr, dq = dn * q * r * (1 - r), dn * r
            dg = np.concatenate([dz, dr, dq], 1)
            carry = d * (1 - m * (1 - z)) + dg @ U.T
            dU += h.T @ dg
            np.add.at(d_in[:, 3 * i * H : 3 * (i + 1) * H], k["ids"][t], np.concatenate([dz, dr, dn], 1))
        g[f"U{way}"] = dU
    x = words.vectors(p["word"], p["char"])
    d_x = np.zeros((len(words.bucket), DIM), np.float32)
    for i, way in enumerate("fb"):
        part = d_in[:, 3 * i * H : 3 * (i + 1) * H]
        g[f"W{way}"], g[f"c{way}"] = x.T @ part, part.sum(0)
        d_x += part @ p[f"W{way}"].T
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], words.bucket, d_x)
    np.add.at(g["char"], words.tri, np.repeat(d_x / words.tri_n[:, None], words.tri_n, axis=0).astype(np.float32))
    return g


def _joined(texts: list[str]) -> Words:
    """The words of all ``texts``, made a chunk of bytes at a time, so that only word numbers are held of each text."""
    firsts, ids, hashes, parts, n = [np.zeros(1, np.int64)], [], [], [], 0
    for _, _, data, offsets in textvec.byte_chunks(pa.array(texts, pa.string())):
        w = Words(data, offsets)
        firsts.append(w.first[1:] + firsts[-1][-1])
        ids.append(w.ids + n)
        n += len(w.hash)
        hashes.append(w.hash)
        parts.append(w)
    out = Words.__new__(Words)
    distinct, at, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    out.hash, out.first, out.ids = distinct, np.concatenate(firsts), inverse[np.concatenate(ids)]
    out.bucket = np.concatenate([w.bucket for w in parts])[at]
    tri_n = np.concatenate([w.tri_n for w in parts])
    starts = np.cumsum(tri_n) - tri_n
    out.tri_n = tri_n[at]
    out.tri = np.concatenate([w.tri for w in parts])[textvec.spread(starts[at], starts[at] + out.tri_n)]
    out.tri_at = np.cumsum(out.tri_n) - out.tri_n
    return out


def _worst(p: dict, words: Words, n_docs: int, top: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's highest logit (-inf without words), and start, end and text of its ``top`` highest windows."""
    start, end, doc = words.windows()
    seen = projected(p, words)
    logit = np.concatenate([forward(p, words, start[i : i + 4096], end[i : i + 4096], seen) for i in range(0, len(start), 4096)] or [np.zeros(0)])
    best = np.full(n_docs, -np.inf)
    np.maximum.at(best, doc, logit)
    order = np.lexsort((-logit, doc))
    rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
    pick = order[rank < top]
    return best, start[pick], end[pick], doc[pick]


def fit(texts: list[str], labels: np.ndarray, threshold: float, epochs: int = 7, seed: int = 7) -> tuple[dict[str, np.ndarray], float, float]:
    """Parameters of the epoch with the best F1, and slope and shift that calibrate a logit; the sample's order decides
    the validation fifth.

    Word vectors start from the words' log-odds, so that the first windows picked already tell the classes apart; each
    epoch picks the windows with the highest logits of each document and trains on them by Adam. The shift puts the
    cut with the best F1 on the validation fifth at ``threshold``, and of the slopes through that point the one with the
    least log loss there is taken.
    """
    p = new_parameters(seed)
    y = labels.astype(np.float32)
    val = np.arange(len(texts)) % 5 == 4
    if not 0 < y[~val].sum() < (~val).sum():
        return p, 1.0, 0.0
    words = _joined(texts)
    if len(words.bucket):
        doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
        pair = np.unique(doc * WORDS + words.bucket[words.ids])
        train_pair = pair[~val[pair // WORDS]]
        n = np.bincount(train_pair % WORDS, minlength=WORDS)
        n1 = np.bincount(train_pair % WORDS, weights=y[train_pair // WORDS], minlength=WORDS)
        rate = y[~val].mean()
        p["word"][:, 0] = np.where(n >= 3, np.log((n1 + rate) / (n - n1 + 1 - rate) * (1 - rate) / rate), 0).clip(-1, 4) / 2
        for way in "fb":  # the first input opens the gates and fills the states
            p[f"W{way}"][0, 2 * HIDDEN :] = np.abs(p[f"W{way}"][0, 2 * HIDDEN :]) + 0.5
        p["w"], p["v"] = np.abs(p["w"]), np.abs(p["v"])
        p["A"] = np.abs(p["A"])
    rng = np.random.default_rng(seed)
    m1, m2 = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    t = 0
    best: tuple[float, dict] = (-1.0, p)
    weight = np.where(y > 0, 1.0, 0.5)
    for epoch in range(epochs + 1):
        top, start, end, doc = _worst(p, words, len(texts), top=2)
        score = _best_f1(top[val], y[val])[0]
        if epoch and score >= best[0]:
            best = (score, {k: x.copy() for k, x in p.items()})
        if epoch == epochs:
            break
        # the highest window of toxic texts, the two highest of others
        first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else doc.astype(bool)
        use = np.flatnonzero(~val[doc] & (first | (y[doc] == 0)))
        rng.shuffle(use)
        rate = 0.02 * (0.5 ** (epoch / 4))
        for i in range(0, len(use), 256):
            pick = use[i : i + 256]
            part = Words.__new__(Words)
            used, inverse = np.unique(words.ids[np.concatenate([np.arange(a, b) for a, b in zip(start[pick], end[pick], strict=True)])], return_inverse=True)
            n = end[pick] - start[pick]
            part.ids, part.bucket, part.tri_n = inverse, words.bucket[used], words.tri_n[used]
            part.tri = words.tri[textvec.spread(words.tri_at[used], words.tri_at[used] + part.tri_n)]
            part.tri_at = np.cumsum(part.tri_n) - part.tri_n
            keep: dict = {}
            logit = forward(p, part, np.cumsum(n) - n, np.cumsum(n), projected(p, part), keep)
            d = ((_sigmoid(logit) - y[doc[pick]]) * weight[doc[pick]] / len(pick)).astype(np.float32)
            t += 1
            for k, g in gradients(p, part, keep, d).items():
                rows = np.unique(part.bucket) if k == "word" else np.unique(part.tri) if k == "char" else slice(None)
                gr = g[rows] + 1e-5 * p[k][rows]
                m1[k][rows] = 0.9 * m1[k][rows] + 0.1 * gr
                m2[k][rows] = 0.99 * m2[k][rows] + 0.01 * gr * gr
                p[k][rows] -= rate * (m1[k][rows] / (1 - 0.9**t)) / (np.sqrt(m2[k][rows] / (1 - 0.99**t)) + 1e-6)
    p = best[1]
    top = _worst(p, words, len(texts))[0]
    cut, base = _best_f1(top[val], y[val])[1], np.log(threshold / (1 - threshold))
    z, t = np.maximum(top[val], -60) - cut, y[val] > 0
    loss = lambda slope: np.logaddexp(0, np.where(t, -1, 1) * (slope * z + base)).sum()
    slope = float(min(2.0 ** np.arange(-3, 3.25, 0.25), key=loss))
    return p, slope, float(base - slope * cut)


def _best_f1(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The best F1 of a cut, and the middle of the gap at which it lies."""
    order = np.argsort(-logit)
    z, t = logit[order], y[order]
    if not t.sum():
        return 0.0, 0.0
    hit = np.cumsum(t)
    f = 2 * hit / (np.arange(len(t)) + 1 + t.sum())
    f[:-1][z[:-1] == z[1:]] = -1
    k = int(np.argmax(f))
    low = z[k + 1] if k + 1 < len(z) and np.isfinite(z[k + 1]) else z[k] - 1
    return float(f[k]), float((z[k] + low) / 2)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, slope, shift = pickle.loads(model.value)
        for batch in batches:
            for lo, hi, data, offsets in textvec.byte_chunks(batch.column(1), 1 << 20):
                words = Words(data, offsets)
                start, end, doc = words.windows()
                best = np.full(hi - lo, -np.inf)
                seen = projected(p, words)
                for i in range(0, len(start), 2048):
                    np.maximum.at(best, doc[i : i + 2048], forward(p, words, start[i : i + 2048], end[i : i + 2048], seen))
                score = np.where(np.isfinite(best), _sigmoid(slope * np.where(np.isfinite(best), best, 0) + shift), 0.0)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(score, pa.float64())], names=["id", "score"])

    return run


def held_out(id_col, mod: int, is_: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == is_


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, max_train: int = 6000) -> bytes:
    """The model, fitted in one task on at most ``max_train`` labelled ids, chosen by a hash; an id without a document is none."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out("id", 4, 2))
    # ids and labels are chosen before any text is read
    chosen = settle(known.groupBy("id").agg(F.max("y").alias("y")).withColumn("o", F.xxhash64("id")).orderBy("o", "id").limit(max_train))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").groupBy("o", "id", "y").agg(F.min("text").alias("text"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["o"], r["id"], r["text"], r["y"]) for b in batches for r in b.to_pylist())
        if not rows:
            return
        model = fit([r[2] for r in rows], np.array([r[3] for r in rows]), threshold)
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    got = sample.select("o", "id", "text", "y").coalesce(1).mapInArrow(train, "model binary").first()
    discard(chosen)
    return bytes(got["model"]) if got else pickle.dumps((new_parameters(), 1.0, 0.0))


def score_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; null and empty texts, and texts without words, score 0. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scorer(shared), "id long, score double").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` from 0 to 1 and ``predicted`` (score >= threshold).

    Labels are read only of rows that are not held out; an id that is labelled twice counts as toxic if either row says
    so. Without labelled rows of both classes the parameters stay as drawn: the scores are defined, but carry no
    information. Null, empty and wordless texts score 0. Rows that repeat an id are scored each by its own text; a null
    id stays null. Other columns are ignored, whatever their names.
    """
    scored = score_documents(docs, fit_model(docs, labels, id_col, text_col, threshold=threshold), id_col, text_col)
    return scored.select(id_col, held_out(id_col, 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
