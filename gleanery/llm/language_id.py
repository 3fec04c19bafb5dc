"""Operator 1, language identification by words first, then ever shorter character n-grams.

Training counts, per language, the words (runs of letters, lower-cased) of labelled rows and the n-grams of those
words, all with Spark aggregations. Every word and n-gram of the fitted rows is kept; the rows alone are bounded, by
FIT_ROWS and FIT_CHARS per language, and so is what is broadcast. A table holds for each item only the languages that
have it, so it grows with the rows and not with the square of the languages. A word of a text scores by its log
frequency per language if the word table has it; an unseen word falls back to its longest n-grams of which any is
known, and adds their mean.

Defined cases: a null text or one without a letter gives `und` and score 0; a text of letters of which nothing is
known gives the most frequent learned language and score 1 / languages; with one learned language every text with a
letter is of that one, with score 1; with no labelled row every text gives `und`.
A tie goes to the language that comes first in the alphabet. Rows are judged one by one, so repeated rows get equal
results. Other columns of the input pass through, but for ones named as a result column, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gather, release, remove, schema_with, text_slices, with_columns, written

UNKNOWN = "und"
GRAMS = (5, 4, 3, 2, 1)
#: Labelled rows per language that are fitted, and their characters, in expectation: a choice by hash of id, text and row.
FIT_ROWS = 2000
FIT_CHARS = 1_000_000
#: Numbers that a worker's cache of word scores holds.
CACHE = 800_000
#: Languages whose shares are broadcast; with more of them, rows and shares are joined by a shuffle.
MOST_BROADCAST = 10_000


@dataclass
class LanguageModel:
    """languages: sorted; base: for 0 (words) and each n-gram length the log frequency of an item that a language lacks.

    tables: by the same numbers, from string to the row of an item; starts, owners, gains: the languages that have an
    item, from starts[row] on, and by how much its log frequency there exceeds `base`.
    """

    languages: list[str]
    base: dict[int, np.ndarray]
    tables: dict[int, dict[str, int]]
    starts: np.ndarray
    owners: np.ndarray
    gains: np.ndarray
    prior: int

    def items_of(self, word: str) -> tuple[int, list[int]]:
        """The items that a word is scored by, and their number in `base`: the word itself, or its longest known n-grams."""
        row = self.tables[0].get(word)
        if row is not None:
            return 0, [row]
        for n in GRAMS:
            known, marked = self.tables.get(n, {}), f"^{word}$" if n > 1 else word
            rows = [known[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in known]
            if rows:
                return n, rows
        return 0, []

    def lines(self, words: list[str]) -> np.ndarray:
        """The mean log frequency of each word's items, per language; zeros for a word of which nothing is known."""
        k, sizes, rows, counts = len(self.languages), [], [], []
        for word in words:
            size, items = self.items_of(word)
            sizes.append(size)
            counts.append(len(items))
            rows += items
        counts, rows = np.array(counts, np.int64), np.array(rows, np.int64)
        lengths = self.starts[rows + 1] - self.starts[rows]
        owner = np.repeat(np.repeat(np.arange(len(words)), counts), lengths)
        cells = owner * k + gather(self.owners, self.starts[rows], lengths)
        sums = np.bincount(cells, weights=gather(self.gains, self.starts[rows], lengths), minlength=len(words) * k).reshape(-1, k)
        base = np.stack([self.base[n] for n in sorted(self.base)])[np.array(sizes, np.int64)]
        return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None] + base, 0.0)


class Cache:
    """Lines of words that a worker has seen, in one table; it starts anew when it is full."""

    def __init__(self, model: LanguageModel, most: int = CACHE):
        self.model, self.rows = model, max(1, most // max(1, len(model.languages)))
        self.at: dict[str, int] = {}
        self.table = np.empty((self.rows, len(model.languages)), np.float32)

    def lines(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.table.shape[1]))
        places = [self.at.get(w, -1) for w in words]
        place = np.array(places, np.int64)
        seen = place >= 0
        out[seen] = self.table[place[seen]]
        new = np.flatnonzero(~seen)
        if len(new):
            fresh = [words[i] for i in new]
            out[new] = made = self.model.lines(fresh).astype(np.float32)
            if len(self.at) + len(fresh) > self.rows:
                self.at.clear()
            fresh = fresh[: self.rows]
            self.table[len(self.at) : len(self.at) + len(fresh)] = made[: len(fresh)]
            self.at.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh)), strict=True))
        return out


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents from which nothing is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _pieces(item: Column) -> Column:
    """All n-grams of a word, with repeats; longer ones than letters see its ends, as marks."""

    def grams(n: int) -> Column:
        marked = F.concat(F.lit("^"), item, F.lit("$")) if n > 1 else item
        starts = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))

    return F.flatten(F.array(*[grams(n) for n in GRAMS]))


@dataclass
class Fitted:
    """What `fit` gathers, as it is sent to the workers: items as Arrow's own bytes (size, item, owners, counts)."""

    languages: list[str]
    totals: list[tuple[str, int, int]]
    items: bytes
    frequent: str | None

    def model(self) -> LanguageModel:
        column = {lang: i for i, lang in enumerate(self.languages)}
        sums = {n: np.zeros(len(self.languages)) for n in (0, *GRAMS)}
        for lang, size, total in self.totals:
            sums[size][column[lang]] = total
        with pa.ipc.open_stream(self.items) as stream:
            items = stream.read_all().combine_chunks()
        tables: dict[int, dict[str, int]] = {0: {}}
        size = items["size"].to_numpy()
        names = items["item"]
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            tables[int(n)] = dict(zip(names.take(pa.array(rows)).to_pylist(), rows.tolist(), strict=True))
        lists = items["owners"].combine_chunks() if items.num_rows else pa.array([], pa.list_(pa.int32()))
        counts = items["counts"].combine_chunks() if items.num_rows else pa.array([], pa.list_(pa.int64()))
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        gains = np.log1p(2.0 * counts.flatten().to_numpy()).astype(np.float32)
        base = {n: -np.log(2.0 * (total + 1)) for n, total in sums.items()}
        return LanguageModel(self.languages, base, tables, starts, lists.flatten().to_numpy(), gains, column.get(self.frequent, 0))


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Fitted:
    """Learns from rows with text and lang that are not held out, about `fit_rows` of each language and `fit_chars` characters.

    Which rows are taken depends on xxhash64 of id, text and row number, so that null and repeated ids neither flood the
    sample nor empty it, and on the rows and characters of each language over all rows. The frequency of an item in a language is (count + 1/2) / (total + 1).
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang", F.monotonically_increasing_id().alias("_row")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes, sizes_path = written(rows.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")), "languages")
    share = sizes.select("lang", F.least(F.lit(float(fit_rows)) / F.col("rows"), F.lit(float(fit_chars)) / F.greatest("chars", F.lit(1))).alias("share"))
    if sizes.count() <= MOST_BROADCAST:
        share = F.broadcast(share)
    drawn = F.pmod(F.xxhash64("doc_id", "text", "_row"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    taken = rows.join(share, "lang").where(drawn).select("lang", "text")
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    counts, counts_path = written(taken.select("lang", words.alias("item")).groupBy("lang", "item").agg(F.count("*").alias("n")), "words")
    grams = counts.select("lang", F.explode(_pieces(F.col("item"))).alias("item"), "n").groupBy("lang", "item").agg(F.sum("n").alias("n")).withColumn("size", F.length("item"))
    both, both_path = written(counts.withColumn("size", F.lit(0)).unionByName(grams), "language-items")
    totals = [tuple(r) for r in both.groupBy("lang", "size").agg(F.sum("n")).collect()]
    languages = sorted({lang for lang, _, _ in totals})
    place = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int") - 1 if languages else F.lit(0)
    found = both.groupBy("size", "item").agg(F.sort_array(F.collect_list(F.struct(place.alias("o"), "n"))).alias("all"))
    items = found.select(F.col("size").cast("tinyint").alias("size"), "item", F.col("all.o").alias("owners"), F.col("all.n").alias("counts")).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, items.schema) as stream:
        stream.write_table(items)
    del items
    frequent = sizes.orderBy(F.desc("rows"), "lang").limit(1).collect()
    release(spark)
    for path in (sizes_path, counts_path, both_path):
        remove(spark, path)
    return Fitted(languages, totals, sink.getvalue().to_pybytes(), frequent[0]["lang"] if frequent else None)


def predict(docs: DataFrame, fitted: Fitted, names: tuple[str, str] = ("lang_pred", "score"), keep_text: bool = False) -> DataFrame:
    """docs without text (or with it), with lang_pred and score, or what `names` calls them. The score is the share of the evidence that the language has: the softmax of the summed word scores, which are cut to 20 words' weight so that no text is surer than its words."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    dropped = () if keep_text else ("text",)

    def run(batches):
        model = shared.value.model()
        cache = Cache(model)
        for batch in batches:
            predicted, scores = [], []
            column = batch.column("text")
            for start, stop in text_slices(column):
                a, b = _judge(column.slice(start, stop - start), model, cache)
                predicted += a
                scores.append(b)
            made = dict(zip(names, (pa.array(predicted, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))), strict=True))
            yield with_columns(batch, dropped, made)

    return docs.mapInArrow(run, schema_with(docs, dropped, f"`{names[0]}` string, `{names[1]}` double"))


def _judge(texts: pa.Array, model: LanguageModel, cache: Cache) -> tuple[list[str], np.ndarray]:
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(plain, " "), " ")
    flat = lists.flatten().dictionary_encode()
    sizes = np.diff(lists.offsets.to_numpy())
    unique = flat.dictionary.to_pylist()
    k = len(model.languages)
    if not k:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    lines = cache.lines(unique)
    codes, owner = flat.indices.to_numpy(), np.repeat(np.arange(len(texts)), sizes)
    real = np.array([bool(w) for w in unique], bool)[codes] if len(codes) else np.zeros(0, bool)  # the empty word scores zeros
    n_words = np.bincount(owner, weights=real, minlength=len(texts))
    summed = np.stack([np.bincount(owner, weights=lines[codes, j], minlength=len(texts)) for j in range(k)], axis=1)
    summed *= (np.minimum(n_words, 20) / np.maximum(n_words, 1))[:, None]
    known = np.ptp(summed, axis=1) > 0 if k > 1 else n_words > 0
    best = np.where(known, summed.argmax(axis=1), model.prior)
    odds = np.exp(summed - summed.max(axis=1, keepdims=True))
    score = odds[np.arange(len(texts)), best] / odds.sum(axis=1)
    empty = n_words == 0
    return [UNKNOWN if e else model.languages[b] for e, b in zip(empty, best, strict=True)], np.where(empty, 0.0, score)


def identify(docs: DataFrame, **how) -> DataFrame:
    """Fits on docs and predicts every row: doc_id, held_out, lang_pred, score."""
    fitted = fit(docs, **how)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, fitted).select("doc_id", "held_out", "lang_pred", "score")
