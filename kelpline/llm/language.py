"""Operator 6: language identification with a linear-chain conditional random field over words.

A word's emission scores are sums of learned weights of hashed features: its bigrams and trigrams with word borders
(which hold the one- and two-letter affixes), its three-letter prefix and suffix, and the word itself (lexicon).
Learned transitions tie neighbours together. Forward-backward gives every word's label distribution, so code-switched
text is labelled word by word; a document's language is the label with the largest expected number of words, its score
the share of words, its confidence the mean of the words' largest probabilities. The words of a text form chains of at most ``CHAIN`` words that cover the whole text.

Training: stochastic gradient steps on the CRF likelihood of windows from a bounded sample of labelled documents (about
``TRAIN_DOCS``, chosen by a hash of the id; the windows are cut in the tasks, so whole texts don't reach the driver), every word labelled with its document's language.

Edge cases: a null text or one without a letter is ``und`` with score 0; with no training rows everything is ``und``;
very long texts take time in proportion; ties go to the first language in order; repeated rows give repeated results;
an empty table gives an empty result; null ids count as training rows and stay null; only the columns named are read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import resting, slices, turn_of

TRAIN_DOCS, WINDOW, WINDOWS_PER_DOC, EPOCHS, BATCH = 1500, 24, 12, 3, 256
BUCKETS, CHAIN, MEMORY = 1 << 17, 256, 300_000


def words_of(text: str | None) -> list[str]:
    """Lower-case runs between white space, without what is no letter at their ends; runs without a letter are left out."""
    return [w for w in map(_word, (text or "").lower().split()) if w]


@functools.lru_cache(maxsize=MEMORY)
def _word(run: str) -> str:
    return run if run.isalpha() else "".join(filter(str.isalpha, run))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, bucket, is lexicon feature) of every feature of the words."""
    text = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.flatnonzero(c == 2)
    last = np.flatnonzero(c == 3)
    number = np.repeat(np.arange(len(words)), last - first + 1)
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = c + np.uint64(1)
    found_w, found_h, lex = [], [], []
    for width in (2, 3, 4):
        h = mix(h[:-1]) + c[width - 1 :]
        inside = number[: len(h)] == number[width - 1 :]
        if width == 4:  # three-letter prefixes and suffixes only
            inside &= (c[: len(h)] == 2) | (c[width - 1 :] == 3)
        found_w.append(number[: len(h)][inside])
        found_h.append(mix(h[inside] + np.uint64(width)))
        lex.append(np.zeros(len(found_w[-1]), bool))
    whole = np.zeros(len(words), np.uint64)
    powers = np.cumprod(np.full(int((last - first).max(initial=0)) + 1, 0x100000001B3, np.uint64)) if len(words) else np.zeros(0, np.uint64)
    if len(words):
        whole = np.add.reduceat(c * powers[np.arange(len(c)) - first[number]], first)
    found_w.append(np.arange(len(words)))
    found_h.append(mix(whole + np.uint64(77)))
    lex.append(np.ones(len(words), bool))
    return np.concatenate(found_w), (np.concatenate(found_h) >> np.uint64(20)) % np.uint64(BUCKETS), np.concatenate(lex)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    transitions: np.ndarray  # labels x labels, log

    def emissions(self, words: list[str]) -> np.ndarray:
        number, bucket, _ = features(words)
        return np.stack([np.bincount(number, self.weights[bucket, k], len(words)) for k in range(len(self.labels))], 1)


def forward_backward(emissions: np.ndarray, transitions: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Scaled forward and backward values of the rows of ``emissions`` (log scores), over all chains at once; a chain begins
    at its row in ``starts``. Also the emissions and transitions as factors."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    e = np.exp(emissions - emissions.max(1, keepdims=True))
    a = np.exp(transitions - transitions.max())
    forward, backward = np.empty_like(e), np.ones_like(e)
    steps = int(lengths.max(initial=0))
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), side="right")
    for t in range(steps):
        rows = starts[: active[t]] + t
        x = e[rows] if t == 0 else (forward[rows - 1] @ a) * e[rows]
        forward[rows] = x / x.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        rows = starts[: active[t + 1]] + t
        x = (backward[rows + 1] * e[rows + 1]) @ a.T
        backward[rows] = x / x.sum(1, keepdims=True)
    return forward, backward, e, a


def marginals(emissions: np.ndarray, transitions: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Label distribution of every row."""
    forward, backward, _, _ = forward_backward(emissions, transitions, starts, lengths)
    both = forward * backward
    return both / both.sum(1, keepdims=True)


def windows_of(text: str | None) -> list[list[str]]:
    """At most ``WINDOWS_PER_DOC`` windows of ``WINDOW`` words at places drawn by the text; shorter texts are repeated."""
    words = words_of(text)
    if not words:
        return []
    places = np.random.default_rng(zlib.crc32((text or "").encode())).integers(0, max(1, len(words) - WINDOW + 1), min(WINDOWS_PER_DOC, -(-len(words) // WINDOW)))
    return [(words[s : s + WINDOW] * WINDOW)[:WINDOW] for s in places]


def fit(samples: list[tuple[str | None, str]], seed: int = 3) -> Crf:
    """Train on (text, label) pairs."""
    return fit_windows([(windows_of(text), y) for text, y in samples], seed)


def fit_windows(samples: list[tuple[list[list[str]], str]], seed: int = 3) -> Crf:
    """Train on (windows of a text, label) pairs."""
    rng = np.random.default_rng(seed)
    labels = sorted({y for _, y in samples})
    windows, targets, index = [], [], {}
    for parts, y in samples:
        for part in parts:
            windows.append([index.setdefault(w, len(index)) for w in part])
            targets.append(labels.index(y))
    n = len(labels)
    model = Crf(labels, np.zeros((BUCKETS, n)), np.zeros((n, n)))
    if not windows:
        return model
    x, y = np.array(windows), np.array(targets)
    number, bucket, lexicon = features(list(index))
    by_word = np.argsort(number, kind="stable")
    number, bucket, lexicon = number[by_word], bucket[by_word].astype(np.int64), lexicon[by_word]
    first = np.searchsorted(number, np.arange(len(index) + 1))
    seen, seen_t = np.full((BUCKETS, n), 1e-3), np.full((n, n), 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            xs, ys = x[order[lo : lo + BATCH]], y[order[lo : lo + BATCH]]
            used, inverse = np.unique(xs, return_inverse=True)
            counts = first[used + 1] - first[used]
            local = np.repeat(np.arange(len(used)), counts)
            at = np.repeat(first[used] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            keep = ~lexicon[at] | (rng.random(len(at)) < 0.5)  # unseen words have no lexicon feature
            at, local = at[keep], local[keep]
            h = bucket[at]
            e = np.stack([np.bincount(local, model.weights[h, k], len(used)) for k in range(n)], 1)[inverse.ravel()]
            forward, backward, e, a = (z if z.shape[0] == n else z.reshape(len(xs), WINDOW, n) for z in forward_backward(e, model.transitions, np.arange(0, xs.size, WINDOW), np.full(len(xs), WINDOW)))
            p = (forward * backward).reshape(-1, n)
            p /= p.sum(1, keepdims=True)
            pair = forward[:, :-1, :, None] * a * (e * backward)[:, 1:, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            gold = np.repeat(ys, WINDOW)
            g = p.copy()
            g[np.arange(len(g)), gold] -= 1
            g /= WINDOW
            by_used = np.stack([np.bincount(inverse.ravel(), g[:, k], len(used)) for k in range(n)], 1)
            step = np.stack([np.bincount(h, by_used[local, k], BUCKETS) for k in range(n)], 1) / len(xs) * 30
            seen += step * step
            model.weights -= 0.3 * step / np.sqrt(seen)
            tr = pair.sum((0, 1))
            np.subtract.at(tr, (ys, ys), WINDOW - 1)
            tr /= xs.size
            seen_t += tr * tr
            model.transitions = np.clip(model.transitions - 0.2 * tr / np.sqrt(seen_t), -3, 3)
    model.weights = model.weights.astype(np.float32)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Crf:
    """Fit on about ``train_docs`` rows of ``docs`` with a text and a language."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    share = min(1.0, train_docs / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(11), id_col), F.lit(1 << 40)) < int(share * (1 << 40))).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")).limit(2 * train_docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_of("language", _word.cache_clear)
        for batch in slices(batches, "t"):
            found = [windows_of(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.list_(pa.string())))], ["id", "l", "windows"])

    cuts = sample.mapInArrow(resting(cut), "id string, l string, windows array<array<string>>").collect()  # at most 288 words of a text
    return fit_windows([(r.windows, r.l) for r in sorted(cuts, key=lambda r: (r.id or "", r.l, r.windows))])


def predict_texts(model: Crf, texts: list[str | None], memory: dict[str, np.ndarray]) -> list[tuple[str, float, float]]:
    """(language, its share of the words, mean of the words' largest marginals) of every text."""
    split = [words_of(t) for t in texts]
    if len(memory) > MEMORY:
        memory.clear()
    number = {w: i for i, w in enumerate({w for words in split for w in words})}
    fresh = [w for w in number if w not in memory]
    if fresh and model.labels:
        memory.update(zip(fresh, model.emissions(fresh).astype(np.float32), strict=True))
    if not number or not model.labels:
        return [("und", 0.0, 0.0)] * len(texts)
    scores = np.stack([memory[w] for w in number]).astype(np.float64)
    sizes = np.array([len(words) for words in split])
    e = scores[np.fromiter((number[w] for words in split for w in words), np.int64, sizes.sum())]
    ends = np.cumsum(sizes)
    starts = np.concatenate([np.arange(end - size, end, CHAIN) for end, size in zip(ends, sizes, strict=True)])
    stops = np.concatenate([np.minimum(np.arange(end - size, end, CHAIN) + CHAIN, end) for end, size in zip(ends, sizes, strict=True)])
    p = marginals(e, model.transitions.astype(np.float64), starts.astype(np.int64), (stops - starts).astype(np.int64))
    sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0)])
    sure = np.concatenate([np.zeros(1), np.cumsum(p.max(1))])
    out = []
    for end, size in zip(ends, sizes, strict=True):
        if not size:
            out.append(("und", 0.0, 0.0))
            continue
        share = (sums[end] - sums[end - size]) / size
        best = int(share.argmax())
        out.append((model.labels[best], float(min(1.0, max(0.0, share[best]))), float((sure[end] - sure[end - size]) / size)))
    return out


def predict(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` as a struct ``row``, with (lang_pred, score, confidence)."""
    kind = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_of("language", _word.cache_clear)
        memory: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", 1 << 21):  # each word of a slice takes some arrays of labels
            found = predict_texts(model, batch.column(1).to_pylist(), memory)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), *[pa.array([x[k] for x in found], pa.float64()) for k in (1, 2)]], ["row", "lang_pred", "score", "confidence"])

    return docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")).mapInArrow(resting(run), f"row {kind}, lang_pred string, score double, confidence double")
