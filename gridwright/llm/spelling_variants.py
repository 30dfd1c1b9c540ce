"""Spelling variants: words one edit apart, by blocked Gram matrices of letter counts.

The words of a corpus are counted. A word's cell is its length together with how many of its letters belong
to each of a few letter classes. One inserted, deleted or replaced letter moves a word to an adjacent cell:
the same one, one class up by one (the next length), or one class up and another down (the same length). So
only adjacent cells meet. Two cells that meet are two matrices of letter counts; their product gives all
squared distances at once, pairs at a distance of at most two are kept and verified letter by letter.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.storage import staged
from gridwright.llm.common import quoted, small, text_of

#: Runs of these letters are words; all of them are single bytes of ISO-8859-1.
LETTERS = "A-Za-z\u00C0-\u00FF"
ALPHABET = string.ascii_lowercase + "".join(map(chr, range(0xC0, 0x100)))
#: Words are of so many letters and occur so often, at least.
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A form occurs so many times as often as its variant, at least.
RATIO = 10
#: One word in so many is damaged in ``damaged``.
DAMAGE = 31
#: Characters of a text that are cut into runs at once; words that a task holds before it hands on their counts.
PART, HELD = 1 << 20, 200_000
#: Letter classes of a cell. More classes: smaller cells, more neighbours.
CLASSES = 6
#: Words of a cell that are multiplied at once; larger cells are dealt to several pieces.
PIECE = 2_048

_RUN, _GAP = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")
_LOWERED = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_PLACE = np.zeros(256, np.int64)
_PLACE[np.frombuffer(ALPHABET.encode("latin-1"), np.uint8)] = np.arange(len(ALPHABET))


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a text, a part of a long text at a time; no run is cut."""
    at = 0
    while at < len(text):
        end = _GAP.search(text, at + PART)
        upto = end.start() if end else len(text)
        yield _RUN.findall(text, at, upto)
        at = upto


def damaged(key: str, run: str) -> str:
    """The run, A to Z in lower case; one in ``DAMAGE`` loses a letter, as a checksum of key and run says."""
    word = run.lower() if run.isascii() else run.translate(_LOWERED)
    h = zlib.crc32(f"{key}:{word}".encode())
    if h % DAMAGE == 0:
        h %= len(word)
        word = word[:h] + word[h + 1 :]
    return word


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each long enough word occurs in a part of the texts."""
    total: Counter[str] = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words = list(total)
        for lo in range(0, len(words), 10_000):
            part = words[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([total[w] for w in part], pa.int64())], ["word", "n"])
        total.clear()

    for batch in small(batches):
        for key, text in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist()):
            for found in runs(text):
                for run, n in Counter(found).items():
                    if len(run) >= LEAST_LETTERS and len(word := damaged(key, run)) >= LEAST_LETTERS:
                        total[word] += n
        if len(total) >= HELD:
            yield from out()
    yield from out()


def corpus_words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)``: the long and frequent enough words of the texts of ``df``, after ``damaged``.

    Null and empty texts hold no word, a null key counts as an empty one; other columns do not matter. Repeated rows
    count as often as they occur. Texts may be of any length: they are read in parts.
    """
    rows = df.select(F.coalesce(quoted(key).cast("string"), F.lit("")).alias("k"), text_of(text).alias("t"))
    parts = rows.mapInArrow(_count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_classes(words: DataFrame, classes: int = CLASSES) -> list[str]:
    """The alphabet dealt to classes that occur about equally often: letters by frequency, each to the rarest class."""
    seen = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().collect()  # one row a letter
    often = dict((r["c"], r["count"]) for r in seen)
    made, total = [""] * classes, [0] * classes
    for letter in sorted(ALPHABET, key=lambda c: (-often.get(c, 0), c)):
        at = total.index(min(total))
        made[at] += letter
        total[at] += often.get(letter, 0) + 1
    return made


def _shifts(classes: int) -> list[tuple[int, ...]]:
    """One of each two opposite moves to an adjacent cell, and staying (the first)."""
    unit = [tuple(int(i == j) for j in range(classes)) for i in range(classes)]
    swaps = [tuple(a - b for a, b in zip(unit[i], unit[j])) for i, j in combinations(range(classes), 2)]
    return [(0,) * classes, *unit, *swaps]


def _named(counts: list[Column]) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in counts])


def packed(words: DataFrame, classes: list[str]) -> DataFrame:
    """The cells' words, up to ``PIECE`` in a row: as one string of bytes, as all words of a cell are of one length."""
    own = [F.length("word") - F.length(F.translate("word", letters, "")) for letters in classes]
    placed = words.select("word", "n", F.array(*own).alias("counts"))
    placed = placed.withColumn("cell", F.concat_ws(",", F.col("counts").cast("array<string>")))
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("parts"))
    piece = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    cells = placed.join(parts, "cell").groupBy("cell", piece.alias("piece")).agg(
        F.first("counts").alias("counts"), F.collect_list(F.struct("word", "n")).alias("x")
    )
    return cells.select(
        "cell", "piece", "counts", F.length(F.col("x")[0]["word"]).alias("size"),
        F.encode(F.array_join("x.word", ""), "ISO-8859-1").alias("words"), F.col("x.n").alias("ns"),
    )


def _letters(words: np.ndarray) -> np.ndarray:
    """How often each word (row of bytes) holds each letter."""
    m, size = words.shape
    at = _PLACE[words] + np.arange(m)[:, None] * len(ALPHABET)
    return np.bincount(at.ravel(), minlength=m * len(ALPHABET)).reshape(m, -1).astype(np.float32)


def close_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words (rows of bytes) of ``a`` and ``b`` are one edit apart; those of ``b`` are as long or one longer."""
    x, y = _letters(a), _letters(b)
    distance = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(distance < 2.5)
    keep = np.zeros(len(i), bool)
    size = a.shape[1]
    for lo in range(0, len(i), 1 << 16):
        u, v = a[i[lo : lo + (1 << 16)]], b[j[lo : lo + (1 << 16)]]
        if b.shape[1] == size:
            good = (u != v).sum(axis=1) == 1
        else:
            # From where they first differ on, the longer word goes on one place later.
            first = np.where((same := u == v[:, :size]).all(axis=1), size, same.argmin(axis=1))
            moved = u == v[:, 1:]
            last = np.where(moved.all(axis=1), -1, size - 1 - moved[:, ::-1].argmin(axis=1))
            good = last < first
        keep[lo : lo + (1 << 16)] = good
    return i[keep], j[keep]


def _binary(words: np.ndarray) -> pa.Array:
    offsets = np.arange(len(words) + 1, dtype=np.int32) * words.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words))])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows hold two cells' words; the pairs found, both ways round."""
    names = ["w", "o", "o_n"]
    for batch in batches:
        for row in range(batch.num_rows):
            at = {c: batch.column(c)[row] for c in batch.schema.names}
            a = np.frombuffer(at["a"].as_buffer(), np.uint8).reshape(-1, at["a_size"].as_py())
            b = np.frombuffer(at["b"].as_buffer(), np.uint8).reshape(-1, at["b_size"].as_py())
            i, j = close_pairs(a, b)
            if at["same"].as_py():
                once = i < j
                i, j = i[once], j[once]
            if not len(i):
                continue
            n, m = at["a_ns"].values.to_numpy()[i], at["b_ns"].values.to_numpy()[j]
            for u, v, often in ((a[i], b[j], m), (b[j], a[i], n)):
                for lo in range(0, len(u), 50_000):
                    part = slice(lo, lo + 50_000)
                    yield pa.RecordBatch.from_arrays([_binary(u[part]), _binary(v[part]), pa.array(often[part])], names)


def near_words(words: DataFrame, classes: list[str]) -> DataFrame:
    """``(w, o, o_n)``: each word with each word one edit away and how often that occurs; words as ISO-8859-1."""
    cells = staged(packed(words, classes))
    shifts = _shifts(len(classes))
    beside = [
        F.struct(_named([F.get("counts", F.lit(i)) + s for i, s in enumerate(shift)]).alias("cell"), F.lit(not any(shift)).alias("stays"))
        for shift in shifts
    ]
    left = cells.select(
        F.inline(F.array(*beside)), F.col("piece").alias("p"), F.col("size").alias("a_size"), F.col("words").alias("a"), F.col("ns").alias("a_ns")
    )
    right = cells.select("cell", "piece", F.col("size").alias("b_size"), F.col("words").alias("b"), F.col("ns").alias("b_ns"))
    met = left.join(right.hint("merge"), "cell").where("NOT stays OR p <= piece")
    same = F.expr("stays AND p = piece").alias("same")
    return met.select("a_size", "a", "a_ns", "b_size", "b", "b_ns", same).mapInArrow(_compare, "w binary, o binary, o_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words with a form. Each step of a chain occurs more often, so chains end; steps double."""
    roots = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return roots
        roots = moved.select("word", "root")


def forms(words: DataFrame, ratio: int = RATIO, classes: int = CLASSES) -> DataFrame:
    """``words`` (``word``, ``n``) with ``n_near``, ``form``, ``form_n`` and ``root``.

    Words are near if they differ by exactly one inserted, deleted or replaced letter. The form of a word is its
    most frequent near word (of equally frequent ones the least), if that occurs at least ``ratio`` times as often;
    the root is where following forms ends, the word itself if it has none. Words must be runs of ``ALPHABET``.
    No words: an empty result.
    """
    words = staged(words.select("word", "n"))
    near = near_words(words, letter_classes(words, classes))
    best = near.groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("o_n")).alias("n"), "o")).alias("best"))
    best = best.select(
        F.decode("w", "ISO-8859-1").alias("word"), "n_near", F.decode("best.o", "ISO-8859-1").alias("form"), (-F.col("best.n")).alias("form_n")
    )
    has = F.col("form_n") >= ratio * F.col("n")
    found = staged(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("form")).alias("form"),
            F.when(has, F.col("form_n")).alias("form_n"),
        )
    )
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
