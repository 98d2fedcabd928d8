"""Language ID: a bidirectional gated recurrent network over bytes.

A text is cut into windows of bytes, all of them; a network runs over each window in both
directions and gives every byte a probability for each language. A document's probability is
the mean over all its bytes that belong to letters or stand between them. Training is
backpropagation through time in NumPy on windows of a bounded sample of labelled texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.base import held_out

WINDOW = 64
HIDDEN = 8
DOCS = 400        # expected texts per language in the sample
PER_DOC = 8       # windows of a sampled text
STEPS, BATCH = 250, 192
LETTER = regex.compile(r"\p{L}")
#: Bytes that say nothing about a language are squeezed to one blank before windows are cut.
PLAIN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]+")


def readable(text: str) -> bytes:
    """UTF-8 in which each run of ASCII bytes other than letters is one blank."""
    return PLAIN.sub(b" ", text.encode("utf-8", "replace"))


def windows(texts: list[bytes]):
    """Windows of all texts as a byte matrix padded with blanks, their lengths and owners."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    total = int(count.sum())
    flat = np.full(total * WINDOW, 32, np.uint8)
    at = (np.cumsum(count) - count) * WINDOW
    for text, start in zip(texts, at.tolist()):
        flat[start:start + len(text)] = np.frombuffer(text, np.uint8)
    place = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(WINDOW, size[owner] - place * WINDOW)
    return flat.reshape(total, WINDOW), length, owner


class Network:
    """Weights per direction: byte table (256 x 3H), recurrence (H x 3H); output (2H x L)."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        h, self.languages = HIDDEN, languages
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.w[f"u{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
        self.w["o"] = rng.normal(0, 0.3, (2 * h, len(languages))).astype(np.float32)
        self.w["c"] = np.zeros(len(languages), np.float32)

    def _states(self, data, d, keep=None):
        """Hidden states of one direction at every position; ``keep`` collects for training."""
        h2, table, u = 2 * HIDDEN, self.w[f"x{d}"], self.w[f"u{d}"]
        n = len(data)
        out = np.empty((WINDOW, n, HIDDEN), np.float32)
        state = np.zeros((n, HIDDEN), np.float32)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            x = table[data[:, t]]
            a = state @ u
            # a sigmoid is a shifted tangent
            gates = np.tanh((x[:, :h2] + a[:, :h2]) * np.float32(0.5))
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[:, h2:] + r * a[:, h2:])
            if keep is not None:
                keep.append((t, state, z, r, new, a[:, h2:]))
            state = new + z * (state - new)
            out[t] = state
        return out

    def _softmax(self, forward, backward):
        logits = forward @ self.w["o"][:HIDDEN] + backward @ self.w["o"][HIDDEN:] + self.w["c"]
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Probabilities by position, window, language; blanks pad the ends of windows."""
        return self._softmax(self._states(data, "f"), self._states(data, "b"))

    def gradients(self, data, target, weight):
        """Mean cross-entropy over weighted positions (WINDOW x n) and its gradients."""
        kept = {"f": [], "b": []}
        states = {d: self._states(data, d, kept[d]) for d in "fb"}
        p = self._softmax(states["f"], states["b"])
        total = weight.sum()
        rows = np.arange(len(target))
        loss = -(np.log(p[:, rows, target] + 1e-9) * weight).sum() / total
        p[:, rows, target] -= 1
        p *= (weight / total)[..., None]
        flat = p.reshape(-1, p.shape[-1])
        both = np.concatenate((states["f"], states["b"]), -1).reshape(-1, 2 * HIDDEN)
        g = {"o": both.T @ flat, "c": flat.sum(0)}
        inner = p @ self.w["o"].T
        for k, d in enumerate("fb"):
            u, dx, du = self.w[f"u{d}"], np.zeros_like(self.w[f"x{d}"]), np.zeros_like(self.w[f"u{d}"])
            carry = np.zeros((len(data), HIDDEN), np.float32)
            for t, before, z, r, new, an in reversed(kept[d]):
                dh = carry + inner[t][:, k * HIDDEN:(k + 1) * HIDDEN]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (before - new) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                da = np.concatenate((dz, dr, dn * r), 1)
                np.add.at(dx, data[:, t], np.concatenate((dz, dr, dn), 1))
                du += before.T @ da
                carry = dh * z + da @ u.T
            g[f"x{d}"], g[f"u{d}"] = dx, du
        return loss, g

    def train(self, data, length, target, steps: int = STEPS, rate: float = 0.02, seed: int = 3):
        """Adam on batches that hold every language equally often."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(target == k) for k in range(len(self.languages))]
        inside = (np.arange(WINDOW)[:, None] < length[None]).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        each = max(1, BATCH // len(by))
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(rows, each) for rows in by])
            _, g = self.gradients(data[pick], target[pick], inside[:, pick])
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                self.w[k] -= (lr * (m[k] / (1 - 0.9 ** step))
                              / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
        return self

    def documents(self, texts: list[bytes], rows: int = 2048) -> np.ndarray:
        """Pooled probabilities of each text; texts without a byte get zeros."""
        data, length, owner = windows(texts)
        out = np.zeros((len(texts), len(self.languages)))
        inside = (np.arange(WINDOW)[:, None] < length[None]).astype(np.float32)
        for a in range(0, len(data), rows):
            p = self.positions(data[a:a + rows])
            pooled = np.einsum("tnl,tn->nl", p, inside[:, a:a + rows])
            np.add.at(out, owner[a:a + rows], pooled)
        sums = out.sum(1, keepdims=True)
        return out / np.where(sums > 0, sums, 1)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = DOCS) -> Network | None:
    """Trains on windows of about ``per_language`` texts of each language that are not held
    out, chosen by the hash of their key; at most ``PER_DOC`` windows of a text, spread over it.

    Null languages and keys teach nothing; without any labelled text there is no network.
    """
    known = docs.filter(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}  # one row a language
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for k in languages
                           for x in (k, min(1.0, per_language / counts[k]))])
    chosen = known.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000))
                          < share[F.col(lang)] * 1_000_000).select(key, lang, text)

    def cut(batches):
        for batch in batches:
            rows = []
            for k, label, whole in zip(*(c.to_pylist() for c in batch.columns)):
                raw = readable(whole)
                starts = range(0, max(1, len(raw)), WINDOW)
                for at in starts[::max(1, len(starts) // PER_DOC)][:PER_DOC]:
                    rows.append((k, at, label, raw[at:at + WINDOW]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                    (batch.schema.types[0], pa.int64(), pa.string(), pa.binary()))],
                names=["k", "at", "lang", "raw"])
    got = (chosen.mapInArrow(cut, f"k {dict(docs.dtypes)[key]}, at long, lang string, raw binary")
           .orderBy("k", "at", "raw").limit(2 * PER_DOC * per_language * len(languages)).collect())
    texts = [bytes(r.raw) for r in got if len(r.raw)]
    if not texts:
        return None
    target = np.array([languages.index(r.lang) for r in got if len(r.raw)])
    present = [k for k in range(len(languages)) if (target == k).any()]
    target = np.searchsorted(present, target)
    data, length, _ = windows(texts)
    return Network([languages[k] for k in present]).train(data, length, target)


def identified(docs: DataFrame, network: Network | None, text: str = "text",
               out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the likeliest language of every whole text and its probability.

    ``und`` with score 0 for null texts, texts without a letter, and without a network.
    """
    docs = docs.drop(out, score)
    where = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = batch.column(where).to_pylist()
            lettered = [network is not None and t is not None and LETTER.search(t) is not None
                        for t in texts]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            index = [i for i, ok in enumerate(lettered) if ok]
            if index:
                p = network.documents([readable(texts[i]) for i in index])
                for i, best, value in zip(index, p.argmax(1).tolist(), p.max(1).tolist()):
                    langs[i], scores[i] = network.languages[best], min(1.0, value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, out, score])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{out}` string, `{score}` double")
