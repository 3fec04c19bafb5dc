"""Operator 13, toxicity by bags of subwords.

A word is the mean of the vectors of its subwords: the character n-grams of the word between two end marks, and the
whole of it, hashed into one table. A window of WINDOW words is the mean of its words, and a linear softmax over that
mean gives its odds. A text is as toxic as its windows together, by a soft maximum that long texts cannot dilute. The
table and the softmax are trained jointly, by the gradient of the documents' labels, in numpy. A misspelt word that was
never seen shares most of its n-grams with the one that was.

Fitted are at most FIT_ROWS labelled documents of each class, those with the least hashes of (id, text), of at most
FIT_CHARS characters each, so at most 2 * FIT_ROWS * FIT_CHARS characters reach the driver, where the training runs.
Ids, languages and sources decide only which rows are fitted. All rows are scored, their whole texts.

Defined cases: a null text, or one without letter or digit, has the score of a window of which nothing is known, below
one half; without labelled rows of both classes every text has score 0; of several labels of one document the greatest
counts; a document whose label is null, or that has none, is not fitted, nor is one with a null id; repeated rows get
equal scores. Other columns of the input pass through, but for ones named as a result column, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gather, schema_with, text_slices, with_columns

#: Lengths of the character n-grams.
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 18
DIMENSIONS = 8
WINDOW = 3
#: How sharply the greatest window decides for a text.
SHARPNESS = 1.0
FIT_ROWS = 2000
FIT_CHARS = 4000
EPOCHS = 10
#: Steps at least; few rows are met more often.
STEPS = 400
BATCH = 64
RATE = 0.6
#: The square that a subword's steps start from.
FLOOR = 1e-7
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(1_000_003)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents from whose labels nothing is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each word, which are not empty, the buckets of its subwords: (buckets, sizes), one word after the other."""
    marked = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(marked))  # characters from here to the word's end
    word = np.repeat(np.arange(len(words)), lengths)
    found, owner = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(marked), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            h = h[: len(marked) - n + 1] * _STEP + marked[n - 1 :]
            if n in GRAMS:
                at = np.flatnonzero(left[: len(h)] >= n)
                found.append(h[at] + np.uint64(n))
                owner.append(word[at])
        powers = np.cumprod(np.full(int(lengths.max(initial=1)), _STEP, np.uint64))
        found.append(np.add.reduceat(marked * powers[left - 1], ends - lengths) if len(words) else marked)
        owner.append(np.arange(len(words)))
        mixed = np.concatenate(found) * _MIX
    buckets = (mixed >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.bincount(owner, minlength=len(words))


def windows(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, codes of all words, the window of each word, the text of each window). A text without words has one empty window."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}\p{M}]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(plain, " "), " ")
    flat = lists.flatten().dictionary_encode()
    sizes = np.diff(lists.offsets.to_numpy())
    names = flat.dictionary.to_pylist()
    codes = flat.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), sizes)
    real = np.array([bool(n) for n in names], bool)[codes] if len(codes) else np.zeros(0, bool)
    codes, owner = codes[real], owner[real]
    counts = np.bincount(owner, minlength=len(texts))
    per_text = np.maximum(1, -(-counts // WINDOW))
    first = np.cumsum(per_text) - per_text
    place = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
    return names, codes, first[owner] + place // WINDOW, np.repeat(np.arange(len(texts)), per_text)


@dataclass
class ToxicityModel:
    """vectors: BUCKETS x DIMENSIONS; weights: DIMENSIONS x 2; bias: 2."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def odds(self) -> tuple[np.ndarray, float]:
        """As all of it is linear in the vectors, each subword is one number when a text is scored: its share in the log odds of the class 1."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def pooled(logits: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The soft maximum of each text's windows, and each window's part in it."""
    top = np.maximum.reduceat(logits, np.searchsorted(text, np.arange(n))) if n else np.zeros(0)
    parts = np.exp(SHARPNESS * (logits - top[text]))
    sums = np.bincount(text, weights=parts, minlength=n)
    return top + np.log(sums) / SHARPNESS, parts / sums[text]


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> ToxicityModel:
    """The vectors and the softmax that fit the labels: adaptive steps over shuffled batches, always the same for the same rows.

    A subword's steps shrink with what it has moved, from a floor that keeps those of few texts from being blamed for them.
    """
    rng = np.random.default_rng(13)
    model = ToxicityModel(rng.normal(0, 0.1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32), rng.normal(0, 1.0, (DIMENSIONS, 2)), np.array([0.5, -0.5]))
    squares, w_squares, b_squares = np.full(BUCKETS, FLOOR), np.full((DIMENSIONS, 2), 1e-4), np.full(2, 1e-4)
    y = np.array(labels, np.float64)
    names, codes, window, text = windows(pa.array(texts, pa.string()))
    buckets, sizes = subwords([n or "\x02" for n in names])
    first = np.cumsum(sizes) - sizes
    words_at = np.searchsorted(window, np.searchsorted(text, np.arange(len(y) + 1)))
    windows_at = np.searchsorted(text, np.arange(len(y) + 1))
    epochs = max(epochs, -(-STEPS * BATCH // max(1, len(y))))
    for epoch in range(epochs):
        order, rate = rng.permutation(len(y)), RATE * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            n_words, n_windows = words_at[rows + 1] - words_at[rows], windows_at[rows + 1] - windows_at[rows]
            used, place = np.unique(gather(codes, words_at[rows], n_words), return_inverse=True)
            shift = np.repeat(np.cumsum(n_windows) - n_windows - windows_at[rows], n_words)
            in_window, in_text = gather(window, words_at[rows], n_words) + shift, np.repeat(np.arange(len(rows)), n_windows)
            parts_of = gather(buckets, first[used], sizes[used])
            means_of = np.add.reduceat(np.ascontiguousarray(model.vectors[parts_of].T), np.cumsum(sizes[used]) - sizes[used], axis=1) / sizes[used] if len(used) else np.zeros((DIMENSIONS, 0))
            counts = np.maximum(np.bincount(in_window, minlength=len(in_text)), 1)
            means = np.stack([np.bincount(in_window, weights=means_of[d, place], minlength=len(in_text)) for d in range(DIMENSIONS)], axis=1) / counts[:, None]
            both = means @ model.weights + model.bias
            z, parts = pooled(both[:, 1] - both[:, 0], in_text, len(rows))
            wrong = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[rows]) / len(rows)
            each = wrong[in_text] * parts  # the gradient of each window's log odds
            per_word = np.bincount(place, weights=(each / counts)[in_window], minlength=len(used)) / sizes[used]
            gain = np.bincount(parts_of, weights=np.repeat(per_word, sizes[used]), minlength=BUCKETS)
            touched = np.flatnonzero(gain)
            squares[touched] += gain[touched] ** 2
            slope = model.weights[:, 1] - model.weights[:, 0]
            model.vectors[touched] -= (rate * 0.5 * (gain[touched] / np.sqrt(squares[touched]))[:, None] * slope).astype(np.float32)
            for target, held, gradient in ((model.weights, w_squares, means.T @ np.stack([-each, each], axis=1)), (model.bias, b_squares, np.array([-each.sum(), each.sum()]))):
                held += gradient**2
                target -= 0.1 * rate * gradient / np.sqrt(held)
    return model


def scores(texts: pa.Array, subword_odds: np.ndarray, bias: float) -> np.ndarray:
    """The probability of the class 1 of each text."""
    names, codes, window, text = windows(texts)
    buckets, sizes = subwords([n or "\x02" for n in names])  # the empty name stands in no window
    starts = np.cumsum(sizes) - sizes
    words = np.add.reduceat(subword_odds[buckets].astype(np.float64), starts) / sizes if len(names) else np.zeros(0)
    counts = np.maximum(np.bincount(window, minlength=len(text)), 1)
    z, _ = pooled(np.bincount(window, weights=words[codes], minlength=len(text)) / counts + bias, text, len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> ToxicityModel | None:
    """Learns from labelled documents that are not held out.

    Candidates are drawn among the labels first, so the documents meet a bounded broadcast and no text is shuffled but
    of those that are fitted; where too few of these have a text of at most `fit_chars`, fewer are fitted.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = lambda rows, *what: rows.orderBy(F.xxhash64(*what), *what)
    chosen = [draw(known.where(F.col("toxic") == y), "doc_id").limit(4 * fit_rows) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").where(F.length("text") <= fit_chars)
    found = [draw(rows.where(F.col("toxic") == y), "doc_id", "text").limit(fit_rows).select("text").toArrow()["text"].to_pylist() for y in (0, 1)]
    if not all(found):
        return None
    return train([*found[0], *found[1]], [0] * len(found[0]) + [1] * len(found[1]))


def predict(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """docs without text, with score and predicted (1 from one half on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.odds() if model else None)

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            if shared.value is None:
                score = np.zeros(len(column))
            else:
                parts = [scores(column.slice(a, b - a), *shared.value) for a, b in text_slices(column)]
                score = np.concatenate(parts) if parts else np.zeros(0)
            yield with_columns(batch, ("text",), {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return docs.mapInArrow(run, schema_with(docs, ("text",), "score double, predicted int"))


def rate(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Fits, and scores every row: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, **how)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "score", "predicted")
