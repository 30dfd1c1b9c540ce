"""Removal of repeated byte strings by two-stage suffix sorting.

Which 400-byte windows of a corpus occur twice? Every window is given an anchor, the place of the least hash
of 32 bytes inside it, so equal windows have equal anchors and only windows of one anchor need be compared.
The windows of one anchor place form a snippet. Snippets are first counted by two hashes. Anchors whose
snippets are all alike are decided by counting. The distinct snippets of the others are brought together by
anchor and sorted: a block of them is a text of which only the suffixes smaller than their successors are
sorted directly, the rest is induced by scans over the buckets of first bytes; windows whose suffix shares
400 bytes with a neighbour in that order are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.storage import staged
from gridwright.llm.common import lists, mixed, quoted, signed, small, spare, text_key, text_of

WINDOW = 400
#: Bytes whose hash makes an anchor.
GRAM = 32
#: Texts are hashed in stretches of so many window starts; a bound on memory, without effect on results.
STRETCH = 1 << 20
#: Bytes of snippets from which whole groups are sorted together; small enough for a processor cache.
SORTED_BYTES = 1 << 16
#: An anchor with more distinct snippets is split by the bytes that its windows share, piece by piece.
HOT_SNIPPETS = 4096
HOT_PIECES = 16

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2^64, for one stretch."""
    if not _POWERS:
        n = STRETCH + WINDOW + GRAM
        for base in (_MULTIPLIER, _INVERSE):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _POWERS.append(np.multiply.accumulate(row))
    return _POWERS


# -- anchors ----------------------------------------------------------------------


def anchors(raw: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor place, anchor hash) of each run of windows with one anchor place.

    The runs cover every window start once, in order. Equal hashes in a window: the first place counts.
    """
    runs = []
    starts = len(raw) - window + 1
    span = window - gram + 1  # anchor places of one window
    up, down = _powers()
    for base in range(0, max(0, starts), STRETCH):
        here = min(STRETCH, starts - base)
        part = np.frombuffer(raw, np.uint8, here + window - 1, base)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        h = mixed((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        # High bits of the hash, then the place: the least value names the first place of the least hash.
        low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        runs.append((first + base, last + base, place[first] + base, h[place[first]]))
    if not runs:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(c) for c in zip(*runs))


def snippets(raw: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, snippet hash, first start, number of windows) of each anchor place."""
    first, last, _, h = anchors(raw, window)
    digest = np.empty(len(first), np.uint64)
    view, before = memoryview(raw), None
    for i, (a, b) in enumerate(zip(first.tolist(), (last + window).tolist())):
        now = view[a:b]
        if before is not None and len(now) == len(before) and now == before:
            digest[i] = digest[i - 1]  # a short period
        else:
            digest[i] = xxhash.xxh3_64_intdigest(now)
        before = now
    return h, digest, first, last - first + 1


# -- two-stage suffix sorting ------------------------------------------------------


def two_stage_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``codes`` (bytes; the last alone is 0) in the order of their first ``depth`` codes.

    Suffixes smaller than their successor are sorted directly, eight codes at a time within the groups still
    equal. All others are induced: whenever a suffix is in its place, the one before it in the text follows
    in its own bucket if it is the larger. Suffixes equal in ``depth`` codes stand together in any order.
    """
    n = len(codes)
    # Larger than the successor? Decided by the next differing code, from the right.
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(codes[:-1].astype(np.int16) - codes[1:].astype(np.int16))
    step[-1] = 1
    known = np.flatnonzero(step)
    larger = np.repeat(step[known] > 0, np.diff(known, prepend=-1))
    padded = np.concatenate([codes, np.zeros(depth + 16, np.uint8)])
    words = np.ndarray(n + depth, ">u8", padded, strides=(1,)).astype(np.uint64)
    lesser = np.flatnonzero(~larger)
    order = lesser[np.argsort(words[lesser])]
    key = words[order]
    fresh = np.ones(len(order), bool)  # differs from the one before
    fresh[1:] = key[1:] != key[:-1]
    for at in range(8, depth, 8):
        equal = ~fresh
        equal[:-1] |= equal[1:]  # members of groups of two or more
        group = np.flatnonzero(equal)
        if not len(group):
            break
        head = fresh[group]
        key = words[order[group] + at]
        other = np.ones(len(group), bool)
        other[1:] = key[1:] != key[:-1]
        torn = other & ~head
        if torn.any():  # only groups that differ here are sorted
            number = np.cumsum(head)
            mark = np.zeros(number[-1] + 1, bool)
            mark[number[torn]] = True
            inside = np.flatnonzero(mark[number])
            rank = np.lexsort((key[inside], number[inside]))
            order[group[inside]] = order[group[inside]][rank]
            key[inside] = key[inside][rank]
            other[1:] = key[1:] != key[:-1]
            fresh[group] = head | other
    # Buckets by first code: the larger suffixes come before the smaller ones.
    edges = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=256))])
    split = np.searchsorted(codes[order], np.arange(257))
    result = np.empty(n, np.int64)
    free = edges[:-1].copy()

    def induce(found: np.ndarray, code: int) -> None:
        """Put the larger suffixes that stand before ``found`` at the next free places of their buckets."""
        before = found[found > 0] - 1
        before = before[larger[before]]
        kinds = codes[before]
        by = np.argsort(kinds, kind="stable")
        kinds, at, count = np.unique(kinds[by], return_index=True, return_counts=True)
        for c, i, m in zip(kinds.tolist(), at.tolist(), count.tolist()):
            result[free[c] : free[c] + m] = before[by[i : i + m]]
            free[c] += m

    result[0], free[0] = n - 1, 1
    for c in np.flatnonzero(np.diff(edges)).tolist():
        own = order[split[c] : split[c + 1]]
        result[edges[c + 1] - len(own) : edges[c + 1]] = own
        done = edges[c]
        while done < free[c]:  # a run of one code feeds its own bucket, level by level
            level, done = result[done : free[c]].copy(), free[c]
            induce(level, c)
        induce(own, c)
    return result


def shared_windows(parts: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each part, which of its windows (by start) occur in another of the parts, or twice in one.

    The parts are UTF-8, whose bytes take 243 values at most, so those and two more codes fit in a byte: 0
    ends the text, 1 stands after each part.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    used = np.zeros(256, bool)
    used[flat] = True
    if used.sum() > 254:
        raise ValueError("These are not bytes of UTF-8.")
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    place = np.arange(len(flat)) + np.repeat(np.arange(len(parts)), sizes)
    codes = np.ones(len(flat) + len(parts) + 1, np.uint8)
    codes[place] = (np.cumsum(used) + 1).astype(np.uint8)[flat]
    codes[-1] = 0
    order = two_stage_order(codes, window)
    room = np.zeros(len(codes), np.int64)  # bytes from here to the part's end
    room[place] = np.repeat(starts + sizes, sizes) - place
    order = order[room[order] >= window]
    flags = np.zeros(len(codes), bool)
    # Common prefixes of neighbours, as far as the window, eight codes at a time.
    words = np.ndarray(len(codes), "<u8", np.concatenate([codes, np.zeros(8, np.uint8)]), strides=(1,))
    equal = np.arange(max(0, len(order) - 1))
    for at in (*range(0, window - 7, 8), *([window - 8] if window % 8 else [])):
        equal = equal[words[order[equal] + at] == words[order[equal + 1] + at]]
    flags[order[equal]] = True
    flags[order[equal + 1]] = True
    return [flags[s : s + max(0, m - window + 1)] for s, m in zip(starts.tolist(), sizes.tolist())]


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def pieces(part: bytes, h: int, window: int = WINDOW, count: int = HOT_PIECES) -> list[tuple[int, int, bytes]]:
    """(group, windows before, bytes) of pieces of a snippet; equal windows of two snippets of an anchor share a group.

    Where the anchor stands inside a window says which piece the window belongs to; the bytes that all
    windows of a piece have in common, seen from the anchor, name the group.
    """
    n, anchor = len(part) - window + 1, int(anchors(part, window)[2][0])
    step = -(-(window - GRAM + 1) // count)
    found = []
    for k in range(count):
        low, high = max(0, anchor - (k + 1) * step + 1), min(n - 1, anchor - k * step)
        if low <= high:
            core = part[anchor - k * step : anchor - (k + 1) * step + 1 + window]
            group = xxhash.xxh3_64_intdigest(core, seed=(h + k) & 0xFFFFFFFFFFFFFFFF)
            found.append((group - (1 << 64) if group >> 63 else group, low, part[low : high + window]))
    return found


# -- the table --------------------------------------------------------------------


def _document_snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        found = [snippets(t.encode()) for t in batch.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("k"), *(lists([signed(f[i]) for f in found], pa.int64()) for i in (0, 1)),
             *(lists([f[i] for f in found], pa.int32()) for i in (2, 3))],
            ["k", "h", "d", "a", "n"],
        )


def _one_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal texts that meet in a task, one."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for k in batch.column("k").to_pylist():
            keep.append(k not in seen)
            seen.add(k)
        yield batch.filter(pa.array(keep, pa.bool_()))


CUT = pa.struct([("g", pa.int64()), ("h", pa.int64()), ("d", pa.int64()), ("skip", pa.int32()), ("part", pa.binary())])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted snippets of each text; those of a hot anchor in pieces."""
    for batch in small(batches):
        found = []
        for text, listed in zip(batch.column("t").to_pylist(), batch.column("w").to_pylist()):
            raw = text.encode()
            for w in listed:
                if w["wanted"]:
                    part = raw[w["a"] : w["a"] + w["n"] + WINDOW - 1]
                    cut = pieces(part, w["h"]) if w["hot"] else [(w["h"], 0, part)]
                    found += [{"g": g, "h": w["h"], "d": w["d"], "skip": s, "part": p} for g, s, p in cut]
        for i in range(0, len(found), 2000):
            yield pa.RecordBatch.from_struct_array(pa.array(found[i : i + 2000], CUT))


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by group. Whole groups are put together to blocks; each gives its snippets' repeated windows."""

    def sort(block: dict) -> pa.RecordBatch:
        rows = [
            {"h": h, "d": d, "lo": lo + skip, "hi": hi + skip}
            for (h, d, skip), flags in zip(block, shared_windows(list(block.values())))
            for lo, hi in ranges(flags)
        ]
        kind = pa.struct([("h", pa.int64()), ("d", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
        return pa.RecordBatch.from_struct_array(pa.array(rows, kind))

    block: dict[tuple, bytes] = {}
    held, group = 0, None
    for batch in batches:
        for g, h, d, skip, part in zip(*(batch.column(c).to_pylist() for c in ("g", "h", "d", "skip", "part"))):
            if g != group and held >= SORTED_BYTES:
                yield sort(block)
                block, held = {}, 0
            group = g
            if (h, d, skip) not in block:
                block[h, d, skip] = part
                held += len(part)
    if block:
        yield sort(block)


def without(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left) after removing the spans (start, end)."""
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    edges = [0, *(e for r in runs for e in r), len(raw)]
    left = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2]))
    return len(raw) - len(left), len(runs), left


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text that has repeated windows."""
    kind = pa.struct([("k", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    for batch in small(batches):
        rows = []
        for k, text, listed, more in zip(*(batch.column(c).to_pylist() for c in ("k", "t", "w", "more"))):
            spans = [(w["a"], w["a"] + w["n"] + WINDOW - 1) for w in listed if w["whole"]]
            spans += [(m["lo"], m["hi"] + WINDOW) for m in more or ()]
            if spans:
                removed, runs, left = without(text.encode(), spans)
                rows.append({"k": k, "n_removed": removed, "n_spans": runs, "kept": left})
        for i in range(0, len(rows), 500):
            yield pa.RecordBatch.from_struct_array(pa.array(rows[i : i + 500], kind))


def repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """What is left of each different text of ``df`` that has repeated windows: ``k, n_removed, n_spans, kept``.

    ``k`` is ``text_key`` of the text. Texts without a repeated window have no row.
    """
    texts = df.select(text_of(text).alias("t")).select(text_key(F.col("t")).alias("k"), "t")
    found = texts.mapInArrow(
        _document_snippets, "k binary, h array<long>, d array<long>, a array<int>, n array<int>"
    )
    # Equal texts have equal snippets: one row of each, with the number of copies. No text is kept.
    unique = staged(
        found.groupBy("k").agg(F.first(F.arrays_zip("h", "d", "a", "n")).alias("s"), F.count(F.lit(1)).alias("copies"))
    )
    placed = unique.select("k", "copies", F.inline("s"))
    # Anchors met twice: with one snippet only, all its windows repeat; else the snippets must be compared.
    # Written, so that the join deals both sides anew and a hot anchor's rows can be split.
    met = placed.groupBy("h").agg(F.sum("copies").alias("m"), F.min("d").alias("x"), F.max("d").alias("y")).where("m > 1")
    met = staged(met.select("h", (F.col("x") == F.col("y")).alias("whole")))
    again = staged(placed.join(met, "h"))
    compared = again.where("NOT whole").groupBy("h", "d").agg(
        F.sum("copies").alias("m"), F.min(F.struct("k", "a")).alias("first")
    )
    compared = staged(compared)
    groups = staged(compared.groupBy("h").agg((F.count(F.lit(1)) > HOT_SNIPPETS).alias("hot")))
    compared = compared.join(groups, "h")
    told = again.join(compared, ["h", "d"], "left").select(
        "k",
        F.struct(
            "h", "d", "a", "n", (F.col("whole") | F.coalesce(F.col("m") > 1, F.lit(False))).alias("whole"),
            F.coalesce(F.struct("k", "a") == F.col("first"), F.lit(False)).alias("wanted"),
            F.coalesce("hot", F.lit(False)).alias("hot"),
        ).alias("w"),
    )
    listed = staged(told.groupBy("k").agg(F.collect_list("w").alias("w")))  # a text's own snippets
    held = staged(
        texts.join(listed.hint("merge"), "k").mapInArrow(
            _one_each,
            "k binary, t string, w array<struct<h:long,d:long,a:int,n:int,whole:boolean,wanted:boolean,hot:boolean>>",
        )
    )
    cut = held.select("t", "w").mapInArrow(_cut_out, "g long, h long, d long, skip int, part binary")
    grouped = cut.repartition("g").sortWithinPartitions("g")
    shared = grouped.mapInArrow(_sort_groups, "h long, d long, lo int, hi int")
    partly = held.select("k", F.inline("w")).where("NOT whole").join(shared, ["h", "d"])
    more = partly.groupBy("k").agg(
        F.collect_set(F.struct((F.col("a") + F.col("lo")).alias("lo"), (F.col("a") + F.col("hi")).alias("hi"))).alias("more")
    )
    return (
        held.join(more, "k", "left").select("k", "t", "w", "more")
        .mapInArrow(_kept, "k binary, n_removed long, n_spans long, kept binary").dropDuplicates(["k"])
    )


def remove(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``has_repeats`` and ``kept_sha256`` of the bytes left of each text.

    A byte goes if a 400-byte string around it starts anywhere else in the texts of ``df``, the same text
    and equal rows included. Null texts count as empty; texts below 400 bytes, and an empty table, lose
    nothing. ``has_repeats`` says whether any went. Columns of the five names are replaced, all others stay.
    """
    names = ("n_bytes", "n_removed", "n_spans", "has_repeats", "kept_sha256")
    rows = df.drop(*[c for c in df.columns if c.lower() in names])
    key, own = spare(rows, "key_of_text"), spare(rows, "own_sha256")
    t = text_of(text)
    # Written, so that the join can split a text of very many rows.
    found = staged(repeats(rows, text).select(F.col("k").alias(key), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))
    marked = rows.withColumns({key: text_key(t), "n_bytes": F.octet_length(t).cast("long"), own: F.sha2(t.cast("binary"), 256)})
    order = [quoted(c) for c in rows.columns]
    return marked.join(found, key, "left").select(
        *order, "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce(F.col("n_removed") > 0, F.lit(False)).alias("has_repeats"), F.coalesce("kept_sha256", own).alias("kept_sha256"),
    )
