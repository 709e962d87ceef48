"""Language identification by a bidirectional gated recurrent network over bytes (operator 9).

The network reads UTF-8 bytes from both sides, gives every position a distribution over the learned languages, and a
document the mean of its positions'. It is written and trained in numpy, by backpropagation through time.

Texts are cut into windows of ``WIDTH`` bytes, each read from a zero state; all windows of a text count. Training takes
a bounded sample of labelled documents; prediction takes every byte of every text, in Arrow batches inside tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.common import with_made_columns

WIDTH = 64
#: Windows that go through the network together.
BLOCK = 2048


@dataclass
class Model:
    """Weights, transposed for columns of windows: inputs (256, 3h), recurrent (3h, h), output (n, 2h)."""

    langs: list[str]
    weights: dict[str, np.ndarray]
    #: Scores of documents below this are hardly of a learned language.
    floor: float = 0.0

    @property
    def hidden(self) -> int:
        return self.weights["uf"].shape[1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1.0
    x *= 0.5
    return x


def start_weights(n_langs: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    out = {}
    for side in "fb":
        out["e" + side] = draw(256, 3 * hidden, scale=0.3)
        out["u" + side] = draw(3 * hidden, hidden, scale=1 / np.sqrt(hidden))
    out["w"] = draw(n_langs, 2 * hidden, scale=1 / np.sqrt(hidden))
    out["b"] = np.zeros((n_langs, 1), np.float32)
    return out


def _pass(table: np.ndarray, u: np.ndarray, x: np.ndarray, order: range, keep: list | None = None) -> list[np.ndarray]:
    """States of one direction, by position. ``x``: (width, windows) bytes; a byte's row of ``table`` is its input."""
    hidden = u.shape[1]
    h = np.zeros((hidden, x.shape[1]), u.dtype)
    states: list = [None] * x.shape[0]
    a, g = np.empty((3 * hidden, x.shape[1]), table.dtype), np.empty((3 * hidden, x.shape[1]), u.dtype)
    for t in order:
        if keep is not None:
            g = np.empty_like(g)
        np.take(table, x[t], axis=1, out=a, mode="clip")
        np.matmul(u, h, out=g)
        zr = _sigmoid(a[: 2 * hidden] + g[: 2 * hidden])
        z, r = zr[:hidden], zr[hidden:]
        n = r * g[2 * hidden :]
        n += a[2 * hidden :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        if keep is not None:
            keep.append((t, z, r, n, g[2 * hidden :], h))
        states[t] = h = new
    return states


def position_probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """Distribution over the languages at each position: (width, langs, windows) for bytes (width, windows)."""
    m, h = model.weights, model.hidden
    n = x.shape[0]
    forward = _pass(np.ascontiguousarray(m["ef"].T), m["uf"], x, range(n))
    backward = _pass(np.ascontiguousarray(m["eb"].T), m["ub"], x, range(n - 1, -1, -1))
    out = np.empty((n, len(model.langs), x.shape[1]), np.float32)
    wf, wb = np.ascontiguousarray(m["w"][:, :h]), np.ascontiguousarray(m["w"][:, h:])
    for t in range(n):
        out[t] = wf @ forward[t] + wb @ backward[t]
    out += m["b"]
    out -= out.max(axis=1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(axis=1, keepdims=True)
    return out


def loss_and_gradients(weights: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over all positions of windows ``x`` (width, windows) of classes ``y``, and its gradients."""
    width, n = x.shape
    hidden = weights["uf"].shape[1]
    kept: dict[str, list] = {"f": [], "b": []}
    states = {
        "f": _pass(np.ascontiguousarray(weights["ef"].T), weights["uf"], x, range(width), kept["f"]),
        "b": _pass(np.ascontiguousarray(weights["eb"].T), weights["ub"], x, range(width - 1, -1, -1), kept["b"]),
    }
    grads = {k: np.zeros_like(v) for k, v in weights.items()}
    errors, loss = [], 0.0
    for t in range(width):
        both = np.concatenate([states["f"][t], states["b"][t]])
        logit = weights["w"] @ both + weights["b"]
        logit -= logit.max(axis=0)
        p = np.exp(logit)
        p /= p.sum(axis=0)
        loss -= float(np.log(p[y, np.arange(n)] + 1e-9).sum())
        p[y, np.arange(n)] -= 1
        p /= width * n
        grads["w"] += p @ both.T
        grads["b"] += p.sum(axis=1, keepdims=True)
        errors.append(weights["w"].T @ p)
    for side, rows in (("f", slice(0, hidden)), ("b", slice(hidden, 2 * hidden))):
        u, dtable = weights["u" + side], np.zeros((256, 3 * hidden), np.float64)
        dh = np.zeros((hidden, n), np.float32)
        for t, z, r, cand, gn, before in reversed(kept[side]):
            dh = dh + errors[t][rows]
            dn = dh * (1 - z) * (1 - cand * cand)
            dz = dh * (before - cand) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            da = np.concatenate([dz, dr, dn])
            dg = np.concatenate([dz, dr, dn * r])
            grads["u" + side] += dg @ before.T
            np.add.at(dtable, x[t], da.T)
            dh = dh * z + u.T @ dg
        grads["e" + side] += dtable.astype(np.float32)
    return loss / (width * n), grads


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = 8, steps: int = 240, batch: int = 256, rate: float = 0.02, seed: int = 1) -> Model:
    """Fit the network to windows (n, WIDTH) of bytes and their class numbers, by Adam on seeded batches."""
    weights = start_weights(len(langs), hidden, seed)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    rng = np.random.default_rng(seed)
    by_class = [np.flatnonzero(labels == k) for k in range(len(langs))]
    by_class = [x for x in by_class if len(x)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, max(1, batch // len(by_class))) for x in by_class])
        _, grads = loss_and_gradients(weights, np.ascontiguousarray(windows[pick].T), labels[pick])
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            weights[k] = (weights[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(langs, weights)


def cut(raw: bytes) -> np.ndarray:
    """All windows of a text: (n, WIDTH) bytes. What is left over is filled with the text's first bytes, spaces if none."""
    n = -(-len(raw) // WIDTH)
    filled = raw + (raw + b" " * WIDTH)[: n * WIDTH - len(raw)]
    return np.frombuffer(filled, np.uint8).reshape(n, WIDTH)


def training_sample(docs: DataFrame, docs_per_lang: int = 150, windows_per_doc: int = 8, seed: int = 3) -> DataFrame:
    """A bounded sample of labelled documents: ``docs_per_lang`` of each language at most, and of each ``windows_per_doc`` windows.

    Windows are ``WIDTH`` characters from anywhere in the text. Rows with null text or language, or without a letter, are
    left out. Ranks are cut within partitions before any shuffle; what is shuffled of a text is its windows.
    """
    named = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), k), F.greatest(F.char_length("text") - (WIDTH - 1), F.lit(1))).cast("int")
    windows = F.transform(F.sequence(F.lit(1), F.lit(windows_per_doc)), lambda k: F.substring("text", draw(k) + 1, F.lit(WIDTH)))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id"))
    short = named.select("doc_id", "lang", windows.alias("windows"))
    return short.withColumn("_rank", order).filter(F.col("_rank") <= docs_per_lang).drop("_rank")


def fit(labelled: DataFrame, docs_per_lang: int = 150, windows_per_doc: int = 8, seed: int = 1, **training) -> Model | None:
    """Train on a bounded sample of ``labelled`` (``doc_id``, ``text``, ``lang``), of every language in it. None if it has no usable row.

    ``Model.floor`` is set to half way from chance to what all but one in a hundred of the sampled documents reach for
    their own language.
    """
    rows = sorted((r["lang"], str(r["doc_id"]), r["windows"]) for r in training_sample(labelled, docs_per_lang, windows_per_doc).collect())
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    place = {x: k for k, x in enumerate(langs)}
    windows = np.stack([cut(w.encode("utf-8", "replace"))[0] for _, _, parts in rows for w in parts])
    labels = np.repeat([place[r[0]] for r in rows], windows_per_doc)
    model = train(windows, labels, langs, seed=seed, **training)
    shares = np.concatenate([position_probabilities(model, np.ascontiguousarray(windows[i : i + BLOCK].T)).mean(axis=0).T for i in range(0, len(windows), BLOCK)])
    own = shares[np.arange(len(windows)), labels].reshape(-1, windows_per_doc).mean(axis=1)
    chance = 1 / len(langs)
    model.floor = chance + 0.5 * max(0.0, float(np.quantile(own, 0.01)) - chance)
    return model


def document_probabilities(model: Model, texts: list[str | None]) -> np.ndarray:
    """Pooled distributions of whole texts: (texts, langs); zeros for null or empty ones.

    Windows of all texts share blocks of a fixed number of columns, so a window's result does not depend on its block's
    size; memory is bounded by the block, whatever the lengths.
    """
    out = np.zeros((len(texts), len(model.langs)))
    block, owners, filled = np.full((BLOCK, WIDTH), 32, np.uint8), np.zeros(BLOCK, np.int64), 0

    def flush(n: int) -> None:
        if n:
            pooled = position_probabilities(model, np.ascontiguousarray(block.T)).mean(axis=0)
            np.add.at(out, owners[:n], pooled.T[:n])

    counts = np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not text:
            continue
        parts = cut(text.encode("utf-8", "replace"))
        counts[i] = len(parts)
        at = 0
        while at < len(parts):
            n = min(BLOCK - filled, len(parts) - at)
            block[filled : filled + n] = parts[at : at + n]
            owners[filled : filled + n] = i
            filled += n
            at += n
            if filled == BLOCK:
                flush(BLOCK)
                filled = 0
    block[filled:] = 32
    flush(filled)
    return out / np.maximum(counts, 1)[:, None]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to ``docs``; only ``text`` is read. Other columns are kept.

    ``und`` with score 0 if the text is null or has no letter, or without a model (that is, if no labelled row could be
    learned from). Of equal scores the first language by name wins; scores are rounded to 6 places. Repeated rows give
    repeated results; no rows: no rows. Texts of any length are read whole, window by window.
    """

    def made(known: Model | None, texts: list[str | None]) -> dict:
        texts = [x if x is not None and any(map(str.isalpha, x)) else None for x in texts]
        if known is None or not any(texts):
            named, score = ["und"] * len(texts), [0.0] * len(texts)
        else:
            p = np.round(document_probabilities(known, texts), 6)
            best = p.argmax(axis=1)
            named = [known.langs[k] if t else "und" for k, t in zip(best, texts)]
            score = [float(p[i, k]) if texts[i] else 0.0 for i, k in enumerate(best)]
        return {"lang_pred": pa.array(named, pa.string()), "score": pa.array(score, pa.float64())}

    # the weights are some tens of kilobytes and go along with the tasks
    return with_made_columns(docs, "text", {"lang_pred": "string", "score": "double"}, lambda: model, made)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op9_language(docs: DataFrame) -> DataFrame:
    """The contract of operator 9 over ``documents``."""
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
