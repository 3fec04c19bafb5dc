"""Token ids of whole texts by the tokenizers library, shared by packing and by token files.

The vocabulary's normaliser keeps white space apart from everything else and its splitter drops it, so a text's ids
are those of its chunks between spaces and line feeds, one after the other. A word ends before a punctuation mark in any
case, and upper case does not count, so A-Z is lowered and such marks are set apart first: far fewer chunks are distinct.
Each of those is encoded once per slice and remembered, up to CACHE_CHUNKS of them; the texts are then put together from
the chunks' ids.

Defined cases: a null or empty text has no ids of its own; strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import gather, schema_with, text_slices, with_columns

CACHE_CHUNKS = 300_000
#: Text that is encoded in one step, in bytes: larger than elsewhere, as more of its chunks are then alike.
SLICE = 6 << 20
#: Words that the tokenizer gets in one line.
LINE_WORDS = 256


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


@functools.lru_cache(maxsize=2)
def chunk_cache(path: str) -> dict[str, bytes]:
    """What this worker process has encoded: it outlives a task and is bounded by CACHE_CHUNKS."""
    return {}


@functools.lru_cache(maxsize=2)
def word_ends(path: str) -> np.ndarray:
    """Which ids end a word."""
    vocabulary = tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return out


def encode_chunks(path: str, chunks: list[str]) -> list[bytes]:
    """The ids of each chunk. Chunks of letters alone are one word each: they go through the tokenizer many in a line, and the ids that end a word part them again."""
    out: list[bytes] = [b""] * len(chunks)
    words = [i for i, c in enumerate(chunks) if c.isalpha()]
    if words:
        lines = [" ".join([chunks[i] for i in words[at : at + LINE_WORDS]]) for at in range(0, len(words), LINE_WORDS)]
        flat = np.concatenate([np.array(made.ids, "<u4") for made in tokenizer(path).encode_batch_fast(lines, add_special_tokens=False)])
        stops = (4 * (np.flatnonzero(word_ends(path)[flat]) + 1)).tolist()
        if len(stops) == len(words):  # each is at least one word, so each is just one
            raw = flat.tobytes()
            for i, start, stop in zip(words, [0, *stops[:-1]], stops, strict=True):
                out[i] = raw[start:stop]
        else:
            words = []
    rest = set(words)
    others = [i for i in range(len(chunks)) if i not in rest]
    for i, made in zip(others, tokenizer(path).encode_batch_fast([chunks[i] for i in others], add_special_tokens=False), strict=True):
        out[i] = np.array(made.ids, "<u4").tobytes()
    return out


def encode_texts(path: str, texts: pa.Array, cache: dict[str, bytes], end: bytes = b"") -> list[bytes]:
    """The ids of each text, then `end`, as little-endian unsigned 32-bit integers."""
    plain = pc.ascii_lower(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "))
    plain = pc.replace_substring_regex(plain, r"([a-z])([!-/:-@\[-`{-~])", r"\1 \2")
    lists = pc.split_pattern(plain, " ")
    coded = lists.flatten().dictionary_encode()
    chunks = coded.dictionary.to_pylist()
    ids = list(map(cache.get, chunks))
    missing = [i for i, x in enumerate(ids) if x is None]
    if missing:
        if len(cache) + len(missing) > CACHE_CHUNKS:
            cache.clear()
        for i, made in zip(missing, encode_chunks(path, [chunks[i] for i in missing]), strict=True):
            ids[i] = made
            if len(chunks[i]) <= 64 and len(cache) < CACHE_CHUNKS:
                cache[chunks[i]] = made
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
    codes = coded.indices.to_numpy()
    lengths = sizes[codes]
    flat = gather(np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(sizes) - sizes)[codes], lengths)
    offsets = lists.offsets.to_numpy()
    at = np.concatenate([[0], np.cumsum(lengths)])[offsets - offsets[0]].tolist()
    return [flat[a:b].tobytes() + end for a, b in zip(at[:-1], at[1:], strict=True)]


def token_ids(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """docs without text, with ids: binary, little-endian unsigned 32-bit, `end_id` last if there is one."""
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches):
        cache = chunk_cache(path)
        for batch in batches:
            column = batch.column("text")
            # A slice at a time goes on, so that ids of a whole batch are never held together.
            for start, stop in text_slices(column, SLICE):
                part = batch.slice(start, stop - start)
                yield with_columns(part, ("text",), {"ids": pa.array(encode_texts(path, part.column("text"), cache, end), pa.binary())})

    return docs.mapInArrow(run, schema_with(docs, ("text",), "ids binary"))
