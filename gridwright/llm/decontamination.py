"""Benchmark decontamination: which training texts hold a test item?

The test items, in short chunks, form an inverted index with BM25 impacts, scaled so that a chunk's own
words score 1. Chunks are numbered by content and kept in blocks; for each term the index holds its largest
impact in each block. Every passage (overlapping windows over every text) is a query. Terms are split once:
the commonest, which together can never lift any chunk far enough, are not looked up at first. The others'
block maxima are added up per passage and block; only blocks whose bound reaches the threshold are scored in
full. All chunks above the threshold are retrieved and checked against the text by five-word shingles of
question and answer. No result depends on the pruning; it only saves work.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from gridwright.llm.common import mapped, quoted, spare, text_of

WORD = re.compile(r"\w+")
#: Words of an index entry at most; a passage has twice as many, and starts as many words after the last.
CHUNK = 48
BLOCK = 8
K1, B = 1.2, 0.75
#: Share of a chunk's own score from which it is retrieved, and of its shingles from which it counts as held.
RETRIEVE, HELD = 0.6, 0.8
SHINGLE = 5
#: Items of one index; more items give more indexes, each read by every passage in turn.
INDEX_ITEMS = 20_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    width = min(SHINGLE, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


@dataclass
class Index:
    """Postings by term in compressed rows; see ``build``."""

    vocabulary: dict[str, int]
    starts: np.ndarray  # postings of term t: starts[t] to starts[t + 1]
    chunks: np.ndarray
    impacts: np.ndarray
    block_starts: np.ndarray  # block maxima of term t, in the same way; empty for common terms
    block_ids: np.ndarray
    block_maxima: np.ndarray
    common: np.ndarray  # largest share of common terms among the chunks of a block
    owner: np.ndarray  # the item of a chunk
    names: list
    parts: list[list[set]]  # an item's shingles: of the question, of the answer if there is one


def build(items: list[tuple], retrieve: float = RETRIEVE) -> Index:
    """The index of items ``(name, question, answer)``; the answer may be null. Items without a word never match."""
    names, parts, chunks, owner = [], [], [], []
    for name, question, answer in items:
        q, a = words_of(question or ""), words_of(answer or "")
        if not q and not a:
            continue
        whole = q + a
        count = max(1, -(-len(whole) // CHUNK))
        edges = [len(whole) * i // count for i in range(count + 1)]
        chunks += [whole[i:j] for i, j in zip(edges, edges[1:])]
        owner += [len(names)] * count
        names.append(name)
        parts.append([shingles(p) for p in (q, a) if p])
    n = len(chunks)
    df = Counter(w for c in chunks for w in set(c))
    vocabulary = {w: i for i, w in enumerate(sorted(df))}
    idf = {w: np.log1p((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    mean = sum(map(len, chunks)) / max(1, n)
    rows = []
    for i, c in enumerate(chunks):
        own = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(c) / mean)) for w, f in Counter(c).items()}
        total = sum(own.values())
        rows += [(vocabulary[w], i, x / total) for w, x in own.items()]
    rows.sort()
    term = np.array([r[0] for r in rows], np.int64)
    chunk = np.array([r[1] for r in rows], np.int64)
    impact = np.array([r[2] for r in rows], np.float64)
    starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    # The commonest terms as long as no chunk gets more than half of what it needs from them.
    share, rare = np.zeros(n), np.ones(len(vocabulary), bool)
    for w in sorted(vocabulary, key=lambda w: (-df[w], w)):
        t = vocabulary[w]
        span = slice(starts[t], starts[t + 1])
        raised = share[chunk[span]] + impact[span]
        if raised.max() > retrieve / 2:
            continue
        share[chunk[span]] = raised
        rare[t] = False
    blocks = max(1, -(-n // BLOCK))
    common = np.zeros(blocks)
    np.maximum.at(common, np.arange(n) // BLOCK, share)
    keep = rare[term]
    code = term[keep] * blocks + chunk[keep] // BLOCK
    ids, at = np.unique(code, return_inverse=True)
    maxima = np.zeros(len(ids))
    np.maximum.at(maxima, at, impact[keep])
    block_starts = np.searchsorted(ids // blocks, np.arange(len(vocabulary) + 1))
    return Index(vocabulary, starts, chunk, impact, block_starts, ids % blocks, maxima, common, np.array(owner, np.int64), names, parts)


def _rows(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all entries of ``terms``, and for each the number of its term in ``terms``."""
    counts = starts[terms + 1] - starts[terms]
    which = np.repeat(np.arange(len(terms)), counts)
    shift = np.repeat(starts[terms] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(len(which)) + shift, which


def retrieved(index: Index, words: list[str], least: float = RETRIEVE) -> list[int]:
    """The items with a chunk whose score reaches ``least`` in any passage of ``words``."""
    get = index.vocabulary.get
    ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    places = np.flatnonzero(ids >= 0)
    if not len(places):
        return []
    ids = ids[places]
    # Passage p covers the words of strides p and p + 1; a term counts once in a passage.
    strides = places // CHUNK
    last = max(0, (len(words) - 1) // CHUNK)
    both = np.concatenate([strides, np.maximum(strides - 1, 0)])
    passages = max(1, last)
    pair = np.unique(np.minimum(both, passages - 1) * len(index.vocabulary) + np.concatenate([ids, ids]))
    passage, term = np.divmod(pair, len(index.vocabulary))
    at, which = _rows(index.block_starts, term)
    if not len(at):
        return []
    blocks = len(index.common)
    cell, where = np.unique(passage[which] * blocks + index.block_ids[at], return_inverse=True)
    bound = np.bincount(where, index.block_maxima[at], len(cell)) + index.common[cell % blocks]
    cell = cell[bound >= least - 1e-9]
    if not len(cell):
        return []
    found = set()
    for p in np.unique(cell // blocks):  # few passages are left
        terms = term[passage == p]
        at, _ = _rows(index.starts, terms)
        wanted = np.isin(index.chunks[at] // BLOCK, cell[cell // blocks == p] % blocks)
        chunks, where = np.unique(index.chunks[at][wanted], return_inverse=True)
        scores = np.bincount(where, index.impacts[at][wanted], len(chunks))
        found.update(index.owner[chunks[scores >= least - 1e-9]].tolist())
    return sorted(found)


def held_items(index: Index, text: str, least: float = RETRIEVE, held: float = HELD) -> list[int]:
    """The retrieved items of which the text holds ``held`` of the question's shingles and of the answer's."""
    words = words_of(text)
    candidates = retrieved(index, words, least)
    if not candidates:
        return []
    own: dict[int, set] = {}

    def share(part: set) -> float:
        width = len(next(iter(part)))
        if width not in own:
            own[width] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        return len(part & own[width]) / len(part)

    return [i for i in candidates if all(share(p) >= held for p in index.parts[i])]


def mark(
    df: DataFrame, items: DataFrame, name: str = "item_id", question: str = "text", answer: str | None = None,
    text: str = "text", into: str = "items",
) -> DataFrame:
    """``df`` with the sorted array of test items that each whole text holds, in ``into``.

    Items are numbered by name and read in indexes of at most ``INDEX_ITEMS``, so what a task holds is
    bounded; the texts are read once per index. Null texts count as empty and hold nothing, null questions
    as empty; an item without any word is never held. A column already called ``into`` is replaced. An item's
    two copies under one name count once.
    """
    # Numbered in parts of a fixed size without one task for all: by hash of the name.
    listed = items.select(
        quoted(name).alias("n"), text_of(question).alias("q"),
        (quoted(answer).cast("string") if answer else F.lit(None).cast("string")).alias("a"),
    ).where(F.col("n").isNotNull())
    total = listed.count()
    shares = max(1, -(-total // INDEX_ITEMS))
    kind = dict(items.dtypes)[name]
    context = df.sparkSession.sparkContext
    columns = []
    marked = df
    for k in range(shares):
        part = [tuple(r) for r in listed.where(F.pmod(F.xxhash64(F.col("n")), F.lit(shares)) == k).orderBy("n", "q", "a").collect()]
        index = context.broadcast(build(part))
        column = spare(marked, f"held_{k}")
        marked = marked.withColumn(column, _finder(index, kind)(text_of(text)))
        columns.append(column)
    empty = F.array().cast(f"array<{kind}>")
    joined = F.concat(*[F.coalesce(F.col(c), empty) for c in columns])
    held = spare(marked, "all_held")
    return marked.withColumn(held, F.sort_array(F.array_distinct(joined))).drop(*columns).withColumn(into, F.col(held)).drop(held)


def _finder(index, kind: str):
    arrow = pa.list_(to_arrow_type(_parse_datatype_string(kind)))

    @F.arrow_udf(f"array<{kind}>")
    def find(texts: pa.Array) -> pa.Array:
        names = index.value.names
        return mapped(texts, lambda t: [names[i] for i in held_items(index.value, t)], arrow)

    return find


def clean(df: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that hold no test item, with the columns of ``df``."""
    into = spare(df, "held_items")
    return mark(df, items, into=into, **options).where(F.size(into) == 0).drop(into)
