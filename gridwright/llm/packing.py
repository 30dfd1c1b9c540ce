"""Packing of token sequences by bin completion.

Texts are tokenised and cut into pieces, then dealt evenly into shards of a bounded number of pieces; each
shard is packed on its own. A shard starts from best-fit decreasing. Unless that already meets the lower
bound, bins are filled one after the other around the largest piece left: the fillings that no other
filling dominates are tried, least waste first, each for as many bins as the pieces allow, and a branch ends
where its waste cannot beat the best packing so far. Only piece lengths and their numbers take part in the
search, so equal lengths are one choice, and equal bins one node.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.storage import staged
from gridwright.llm.common import quoted, text_of, values

CAPACITY = 2048
#: Pieces that are packed together.
SHARD_PIECES = 25_000
#: Fillings tried around one piece, and nodes of a search (or four times the different lengths, if more), before the
#: best so far stands.
FILLINGS, NODES = 16, 2_000
#: Full bins that the search opens again.
REOPENED = 40
MAIN, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

#: The split of texts into words that the tokenizer's file asks for, and one that finds the same words without going back.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAME_SPLIT = r"'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: Texts whose pieces a process remembers, by digest, in case copies follow.
REMEMBERED = 30_000

_CODERS: dict = {}
_SEEN: dict[tuple, dict[bytes, list]] = {}


def encoder(main_path: str, ranks_path: str | None = None):
    """A function from a text to its token ids, made once per process.

    The ids are those of the tokenizer in ``main_path`` without special tokens added. ``ranks_path``
    optionally names the same vocabulary as ranks, for a faster library; texts that hold the string of a
    special token always go to the tokenizer itself, as only that reads the string as one token.
    """
    if (main_path, ranks_path) not in _CODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

        @functools.cache
        def tokenizer():  # read when first needed
            from tokenizers import Tokenizer

            return Tokenizer.from_file(main_path)

        slow = lambda text: tokenizer().encode(text, add_special_tokens=False).ids
        code = slow
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(main_path, encoding="utf-8") as file:
                special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
            with open(ranks_path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            split = SAME_SPLIT if public_tokenizers.PATTERN == SPLIT else public_tokenizers.PATTERN
            fast = tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks, special_tokens=special)
            # As one buffer of ids, not a list of numbers; the library looks for special tokens there, so it needs one.
            plain = functools.partial(fast.encode_to_numpy, disallowed_special=()) if special else fast.encode_ordinary
            code = lambda text: slow(text) if any(s in text for s in special) else plain(text)
        _CODERS[main_path, ranks_path] = code
    return _CODERS[main_path, ranks_path]


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


# -- one shard --------------------------------------------------------------------


def best_fit(lengths: list[int], counts: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; ``lengths`` falls strictly. Open bins are kept by the room they have left."""
    rooms: list[int] = []
    open_bins: dict[int, list[list[int]]] = {}
    done: list[list[int]] = []
    for length, count in zip(lengths, counts):
        for _ in range(count):
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                held = open_bins[room]
                one = held.pop()
                if not held:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                room, one = capacity, []
            one.append(length)
            room -= length
            if room:
                if room not in open_bins:
                    bisect.insort(rooms, room)
                    open_bins[room] = []
                open_bins[room].append(one)
            else:
                done.append(one)
    return done + [one for held in open_bins.values() for one in held]


def fillings(lengths: list[int], left: dict[int, int], room: int, limit: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` with the pieces left, the fullest first.

    A filling is dominated if one of its pieces, or a pair of them, could be exchanged for one larger piece
    left that still fits. At most ``limit`` fillings; the search for them reads the lengths from the largest.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = 0

    def go(at: int, space: int, taken: list[int]) -> None:
        nonlocal steps
        steps += 1
        if len(found) >= 4 * limit or steps > 40 * limit:
            return
        fits = bisect.bisect_left(lengths, -space, at, key=lambda x: -x)  # lengths fall
        open_at = next((i for i in range(fits, len(lengths)) if left[lengths[i]] > taken.count(lengths[i])), None)
        if open_at is None:
            found.append((space, tuple(taken)))
            return
        for i in range(open_at, len(lengths)):
            length = lengths[i]
            if length <= space and left[length] > taken.count(length):
                taken.append(length)
                go(i, space - length, taken)
                taken.pop()
                if found and found[-1][0] == 0 and len(found) >= limit or steps > 40 * limit:
                    return

    def exchangeable(low: int, high: int, taken: tuple[int, ...]) -> bool:
        """Is a piece of low to high left besides those taken?"""
        at = bisect.bisect_left(lengths, -high, key=lambda x: -x)
        while at < len(lengths) and lengths[at] >= low:
            if left[lengths[at]] > taken.count(lengths[at]):
                return True
            at += 1
        return False

    go(0, room, [])
    kept = []
    for waste, taken in sorted(set(found)):
        if not any(exchangeable(x + 1, x + waste, taken) for x in taken) and not any(
            exchangeable(taken[i] + taken[j], taken[i] + taken[j] + waste, taken) for i in range(len(taken)) for j in range(i)
        ):
            kept.append(taken)
        if len(kept) == limit:
            break
    return kept


def search(left: Counter, capacity: int, below: int, nodes: int) -> list[list[int]] | None:
    """Fewer than ``below`` bins for the pieces ``left`` (length to number), or None if the search finds none.

    A node of the search places one filling around the largest piece left, as often as the numbers of its pieces allow
    or else once; so a way down to a packing takes about as many nodes as there are different lengths.
    """
    left = Counter(left)
    lengths = sorted(left, reverse=True)
    total = sum(x * n for x, n in left.items())
    least = -(-total // capacity)
    best: list[tuple[tuple[int, ...], int]] | None = None
    placed: list[tuple[tuple[int, ...], int]] = []
    trail: list[list[tuple[tuple[int, ...], int]]] = []  # what is still to be tried at each depth
    waste = 0

    def put(one: tuple[int, ...], times: int) -> None:
        nonlocal waste
        for x in one:
            left[x] -= times
        waste += times * (capacity - sum(one))

    def descend() -> bool:
        """One more level; False at a leaf."""
        first = next((x for x in lengths if left[x]), None)
        if first is None:
            return False
        left[first] -= 1
        here = [x for x in lengths if left[x] and x <= capacity - first]
        options = []
        for taken in fillings(here, left, capacity - first):
            one = (first, *taken)
            most = min((left[x] + (x == first)) // n for x, n in Counter(one).items())
            options += [(one, most), (one, 1)] if most > 1 else [(one, 1)]
        left[first] += 1
        trail.append(options[::-1])
        return True

    descend()
    while trail and nodes:
        nodes -= 1
        if len(placed) == len(trail):  # back from what was tried last
            one, times = placed.pop()
            put(one, -times)
        if not trail[-1]:
            trail.pop()
            continue
        placed.append(trail[-1].pop())
        put(*placed[-1])
        # Waste that any packing with fewer bins may have.
        if waste <= (below - 1) * capacity - total and not descend():
            best, below = list(placed), sum(times for _, times in placed)
            if below <= least:
                break
    return None if best is None else [list(one) for one, times in best for _ in range(times)]


def complete(lengths: list[int], counts: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Bins as lists of lengths: as few as the search finds, never more than best-fit decreasing needs.

    The search first packs anew the pieces of the bins that best fit leaves room in, and of some full bins of the most
    pieces, which are the easiest to exchange; where that does not meet the lower bound, all pieces.
    """
    best = best_fit(lengths, counts, capacity)
    least = -(-sum(a * b for a, b in zip(lengths, counts)) // capacity)
    nodes = max(nodes, 4 * len(lengths))
    full = sorted((one for one in best if sum(one) == capacity), key=len)
    for opened in (REOPENED, len(full)):
        if len(best) <= least:
            break
        kept = full[: max(0, len(full) - opened)]
        rest = Counter(dict(zip(lengths, counts)))
        rest.subtract(x for one in kept for x in one)
        found = search(rest, capacity, len(best) - len(kept), nodes)
        if found is not None:
            return kept + found
    return best


def pack_lengths(values: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each value; bins are numbered from 0 and filled from place 0."""
    order = np.argsort(-values, kind="stable")
    lengths, firsts, counts = np.unique(-values[order], return_index=True, return_counts=True)
    bins = complete([-int(x) for x in lengths], counts.tolist(), capacity)
    upto = dict(zip((-int(x) for x in lengths), firsts.tolist()))
    number, offset = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    for k, one in enumerate(bins):
        at = 0
        for x in one:
            i = order[upto[x]]
            upto[x] += 1
            number[i], offset[i] = k, at
            at += x
    return number, offset


# -- the table --------------------------------------------------------------------


def pieces(df: DataFrame, code, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32. ``code`` makes the text-to-ids function in a task."""

    @F.arrow_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def cut_up(texts: pa.Array) -> pa.Array:
        tokens, rows = code(), []
        seen = _SEEN.setdefault((tokens, capacity, end), {})
        for value in values(texts):
            mark = hashlib.blake2b(value.encode(), digest_size=16).digest()
            if mark in seen:  # a copy of a text that this process has cut up
                rows.append(seen[mark])
                continue
            ids = np.append(np.asarray(tokens(value), "<u4"), np.array([end], "<u4"))
            rows.append([
                {"piece": i, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[s : s + n])}
                for i, (s, n) in enumerate(cut(len(ids), capacity))
            ])
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen[mark] = rows[-1]
        kind = pa.list_(pa.struct([("piece", pa.int32())] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32")]))
        return pa.array(rows, kind)

    return df.select(quoted(key).alias(key), cut_up(text_of(text)).alias("p_")).select(key, F.inline("p_"))


def pack(df: DataFrame, code, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, shard: int = SHARD_PIECES) -> DataFrame:
    """All pieces with ``sequence_id`` and ``offset``; sequences hold at most ``capacity`` tokens, without gaps.

    A null text counts as empty: one piece with the end token alone. Rows that repeat are packed each; a
    null key stays null. An empty table gives no rows. The pieces (no texts or ids) are written to the
    shared folder once; their number fixes the shards. Rows go round-robin to the shards, so neither a hot
    key nor a hot text matters. The numbers of sequences follow the shard, and are the same after a retry.
    """
    cut_up = staged(pieces(df, code, key, text, capacity))
    shards = max(1, -(-cut_up.count() // shard))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        number, offset = pack_lengths(rows["length"].to_numpy(), capacity)
        number += TaskContext.get().partitionId() << 32
        for name, values in (("sequence_id", number), ("offset", offset)):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        yield from rows.to_batches(10_000)

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_up.schema)
    return cut_up.repartition(shards).mapInArrow(place, f"{kind}, sequence_id long, offset long")
