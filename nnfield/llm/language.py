"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads the bytes of one word at a time, a blank on either side, forwards and backwards, and labels every
position; its state begins anew at each word. So equal words have equal labels, and a worker runs each distinct word once
and remembers it, while every byte of every word of every whole text counts. A word is a run of letter bytes (a-z after
lower-casing A-Z, or bytes of non-ASCII characters); a run longer than ``WORD_BYTES``, such as a paragraph of a script
without blanks, is cut at character borders into consecutive words of at most that length, in training as in prediction.
A word's log-probabilities are the sum over its positions, so that long words weigh more than short ones; a document's
are their sum over all its words, normalised: ``lang_pred`` is the largest, ``score`` its probability.

Training: back-propagation through time with Adam, on words of a sample of about ``SAMPLE`` documents per language, the
first ``SAMPLE_BYTES`` bytes from their first letter on, drawn by a hash of doc_id from rows that have a letter and are not
held out. Every language with such a row is learned; ``SAMPLE_ROWS`` and ``SAMPLE_WORDS`` bound what all languages give
together, so that each of very many gives less. Only text and lang are seen.

A text that is null or has no letter gets ``und`` and score 0, as does every row if there is nothing to learn from.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nnfield.llm.common import held_out, keyed

SAMPLE = 400
SAMPLE_BYTES = 3000
# Rows and words of all languages together; with very many languages each has fewer, at least one row.
SAMPLE_ROWS = 25_600
WORDS_A_LANGUAGE, SAMPLE_WORDS = 6000, 384_000
WORD_BYTES = 24
EMBEDDING, HIDDEN = 12, 16
EPOCHS, BATCH, RATE = 6, 256, 0.01
CACHED_WORDS, CACHED_VALUES = 400_000, 25_600_000
# Words of a text that are looked up at once.
STRETCH = 200_000
UNKNOWN = "und"

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLANK = 32
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
# The longest piece that ends at a character border; bytes that are no UTF-8 are cut where they are.
_PIECE = re.compile(rb"(?s:.{1,%d})(?![\x80-\xbf])|(?s:.{1,%d})" % (WORD_BYTES, WORD_BYTES))


def words_of(text: bytes) -> list[bytes]:
    """All words of a text, long ones in pieces."""
    words = text.translate(_LETTERS).split()
    if max(map(len, words), default=0) <= WORD_BYTES:
        return words
    return [piece for w in words for piece in ((w,) if len(w) <= WORD_BYTES else _PIECE.findall(w))]


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    kept = text.translate(_LETTERS)
    if _ASCII_LETTER.search(text):
        return True
    return any(c.isalpha() for c in kept.decode("utf-8", "ignore"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    # exp is the fast one of numpy's functions; it may pass the largest number, which gives 0 as it should.
    return 1 / (1 + np.exp(-x))


class Network:
    """Bidirectional GRU over bytes with a softmax at every position."""

    def __init__(self, languages: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        H, E, L = HIDDEN, EMBEDDING, len(languages)
        scale = 1 / np.sqrt(H)
        self.w = {"E": rng.normal(0, 0.3, (256, E)), "O": rng.normal(0, scale, (2 * H, L)), "o": np.zeros(L)}
        for side in "fb":
            self.w |= {f"X{side}": rng.normal(0, 1 / np.sqrt(E), (E, 3 * H)), f"H{side}": rng.normal(0, scale, (H, 3 * H)), f"B{side}": np.zeros(3 * H)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    @np.errstate(over="ignore")
    def _run(self, codes: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """codes: words of one length, (n, T). Hidden states (T, n, H) in reading order of the text."""
        H = HIDDEN
        inputs = self.w["E"] @ self.w[f"X{side}"] + self.w[f"B{side}"]
        U = self.w[f"H{side}"]
        n, T = codes.shape
        out, saved, h = np.empty((T, n, H), np.float32), [], np.zeros((n, H), np.float32)
        for t in range(T) if side == "f" else range(T - 1, -1, -1):
            x = inputs[codes[:, t]]
            gates = _sigmoid(x[:, : 2 * H] + h @ U[:, : 2 * H])
            z, r = gates[:, :H], gates[:, H:]
            g = 2 * _sigmoid(2 * (x[:, 2 * H :] + (r * h) @ U[:, 2 * H :])) - 1  # tanh
            if keep:
                saved.append((t, h, z, r, g))
            h = h + z * (g - h)
            out[t] = h
        return out, saved

    def _log_probabilities(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        logits = np.concatenate((forward, backward), axis=2) @ self.w["O"] + self.w["o"]
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))

    def words(self, words: list[bytes]) -> np.ndarray:
        """Sums of log-probabilities over the positions of each word."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for size, rows in by_length.items():
            step = max(1, min(4096, 4096 * 64 // len(self.languages)))
            for at in range(0, len(rows), step):
                few = rows[at : at + step]
                codes = self.codes([words[i] for i in few], size)
                out[few] = self._log_probabilities(self._run(codes, "f", False)[0], self._run(codes, "b", False)[0]).sum(axis=0)
        return out

    @staticmethod
    def codes(words: list[bytes], size: int) -> np.ndarray:
        codes = np.full((len(words), size + 2), _BLANK, np.uint8)
        codes[:, 1:-1] = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size)
        return codes

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions and its gradients, by back-propagation through time."""
        H = HIDDEN
        n, T = codes.shape
        states = {s: self._run(codes, s, True) for s in "fb"}
        logp = self._log_probabilities(states["f"][0], states["b"][0])
        loss = -logp[:, np.arange(n), labels].mean()
        d_logits = np.exp(logp)
        d_logits[:, np.arange(n), labels] -= 1
        d_logits /= n * T
        both = np.concatenate((states["f"][0], states["b"][0]), axis=2)
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["O"] = both.reshape(-1, 2 * H).T @ d_logits.reshape(-1, d_logits.shape[2])
        grad["o"] = d_logits.sum(axis=(0, 1))
        d_both = d_logits @ self.w["O"].T
        for s, (_, saved) in ((k, states[k]) for k in "fb"):
            d_out = d_both[:, :, :H] if s == "f" else d_both[:, :, H:]
            U, X = self.w[f"H{s}"], self.w[f"X{s}"]
            carry = np.zeros((n, H), np.float32)
            for t, h, z, r, g in reversed(saved):
                d = d_out[t] + carry
                d_g = d * z * (1 - g * g)
                d_rh = d_g @ U[:, 2 * H :].T
                d_gates = np.concatenate((d * (g - h) * z * (1 - z), d_rh * h * r * (1 - r)), axis=1)
                carry = d * (1 - z) + d_rh * r + d_gates @ U[:, : 2 * H].T
                grad[f"H{s}"][:, : 2 * H] += h.T @ d_gates
                grad[f"H{s}"][:, 2 * H :] += (r * h).T @ d_g
                d_x = np.concatenate((d_gates, d_g), axis=1)
                grad[f"B{s}"] += d_x.sum(axis=0)
                grad[f"X{s}"] += self.w["E"][codes[:, t]].T @ d_x
                np.add.at(grad["E"], codes[:, t], d_x @ X.T)
        return float(loss), grad

    def train(self, words: list[bytes], labels: np.ndarray, seed: int = 11) -> "Network":
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        size = np.array([len(w) for w in words])
        step = 0
        for epoch in range(EPOCHS):
            batches = []
            for s in np.unique(size):
                rows = rng.permutation(np.flatnonzero(size == s))
                batches += [(s, rows[a : a + BATCH]) for a in range(0, len(rows), BATCH)]
            for k in rng.permutation(len(batches)):
                s, rows = batches[k]
                _, grad = self.gradients(self.codes([words[i] for i in rows], s), labels[rows])
                step += 1
                rate = RATE * min(1.0, step / 50) * (0.4 if epoch >= EPOCHS - 2 else 1.0) * np.sqrt(len(rows) / BATCH)
                for name, g in grad.items():
                    a, b = moments[name]
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    self.w[name] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def name(self) -> str:
        digest = hashlib.sha256("\n".join(self.languages).encode())
        for k in sorted(self.w):
            digest.update(self.w[k].tobytes())
        return digest.hexdigest()


def sample(documents: DataFrame, per_language: int = SAMPLE) -> list[tuple[bytes, str]]:
    """(text, lang) of a bounded sample of rows that may be learned from, alike for every language; every language has one."""
    text = F.col("text").cast("binary").cast("string")
    rows = documents.select(F.col("doc_id"), text.alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()
    if not counts:
        return []
    per_language = max(1, min(per_language, SAMPLE_ROWS // len(counts)))
    # The row of smallest draw is in, whatever the share.
    most = [(r.lang, max(int(min(1.0, per_language / r.n) * (1 << 30)), r.least + 1)) for r in counts]
    most = documents.sparkSession.createDataFrame(most, "lang string, most long")
    drawn = rows.join(F.broadcast(most), "lang").where(F.col("draw") < F.col("most"))
    start = F.regexp_replace("text", r"^[^\p{L}]+", "").cast("binary")
    drawn = drawn.select("draw", F.substring(start, 1, SAMPLE_BYTES).alias("text"), "lang")
    # Equal draws, as of null doc_ids, are bounded as well.
    order = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    drawn = drawn.withColumn("k", order).where(F.col("k") <= 2 * per_language).select("draw", "text", "lang")
    return [(bytes(r.text), r.lang) for r in sorted(drawn.collect(), key=lambda r: (r.draw, r.lang, r.text))]


def learn(documents: DataFrame) -> Network | None:
    """The trained network, or None if no row may be learned from."""
    rows = sample(documents)
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(5)
    most = max(1, min(WORDS_A_LANGUAGE, SAMPLE_WORDS // max(1, len(languages))))
    words, labels = [], []
    for k, lang in enumerate(languages):
        own = sorted(w for text, x in rows if x == lang for w in words_of(text))
        if own:
            picked = rng.choice(len(own), min(most, len(own)), replace=False)
            words += [own[i] for i in picked]
            labels += [k] * len(picked)
    return Network(languages).train(words, np.array(labels)) if words else None


_labelled: dict[str, tuple[dict[bytes, int], np.ndarray]] = {}


class _Labels:
    """Word labels of one network that a worker keeps from task to task."""

    def __init__(self, network: Network, name: str) -> None:
        self.network = network
        if name not in _labelled:
            _labelled.clear()
            room = max(1, min(CACHED_WORDS, CACHED_VALUES // len(network.languages)))
            _labelled[name] = ({}, np.zeros((room, len(network.languages)), np.float32))
        self.rows, self.values = _labelled[name]
        self.stretch = min(STRETCH, len(self.values))

    def know(self, words: set[bytes]) -> None:
        """Labels of at most ``stretch`` distinct words."""
        new = sorted(words.difference(self.rows))
        if len(self.rows) + len(new) > len(self.values):
            self.rows.clear()
            new = sorted(words)
        if new:
            base = len(self.rows)
            self.values[base : base + len(new)] = self.network.words(new)
            self.rows.update(zip(new, range(base, base + len(new))))

    def total(self, words: list[bytes]) -> np.ndarray:
        """Sum over the words of a text; a text of any length is taken in stretches."""
        out = np.zeros(self.values.shape[1])
        for at in range(0, len(words), self.stretch):
            few = words[at : at + self.stretch]
            self.know(set(few))
            out += self.values[np.fromiter(map(self.rows.__getitem__, few), np.int64, len(few))].sum(axis=0, dtype=np.float64)
        return out


def identify(documents: DataFrame, network: Network | None = None) -> DataFrame:
    """doc_id, text_hash, lang_pred, score, has_letter of every document."""
    network = network or learn(documents)
    name = network.name() if network else ""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = _Labels(network, name) if network else None
        for part in parts:
            found, scores, lettered = [], [], []
            for at in range(0, part.num_rows, 256):
                texts = part.column(1).slice(at, 256).to_pylist()
                words = [words_of(t) if t and has_letter(t) else [] for t in texts]
                if labels:  # the new words of many short texts at once
                    labels.know(set().union(*(w for w in words if len(w) <= labels.stretch // 256)))
                for own in words:
                    lettered.append(bool(own))
                    if not own or not labels:
                        found.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    total = labels.total(own)
                    p = np.exp(total - total.max())
                    best = int(total.argmax())
                    found.append(network.languages[best])
                    scores.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(lettered, pa.bool_())], ["doc_id", "text_hash", "lang_pred", "score", "has_letter"])

    return keyed(documents).mapInArrow(run, "doc_id long, text_hash long, lang_pred string, score double, has_letter boolean")


def predictions(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return identify(documents).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
