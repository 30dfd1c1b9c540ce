"""Shards of about equal bytes by a k-d tree over metadata, in DataFrame functions alone.

Each row is a point: one whole-number code per metadata column. Codes of numbers keep their order (on a
logarithmic scale), codes of texts keep equal values together. A node of the tree that is to become several
shards is cut at the weighted quantile of its widest dimension; the weight of a row is its size in bytes. Rows
of equal texts share their codes. Rows with the same code are told apart by further bits of hash: first of the
text, so that equal texts lie side by side, then of the key, then of the row's place in the table. So one value,
text or key may hold any share of all rows. Cuts are found by histograms of some bits at a time, which Spark sums; the driver sees one row per node
and pass. The tree is a short list of cuts, and a row's shard is an expression of its codes: no shuffle.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from gridwright.functions.storage import staged
from gridwright.llm.common import quoted, spare, text_key, text_of

#: Bits of a point: its code, then hashes of text, key and place.
CODE, TEXT, KEY, PLACE = 20, 20, 12, 8
BITS = CODE + TEXT + KEY + PLACE
#: Bits that the passes over the rows settle; the last one cuts among rows of equal texts.
STEPS = (14, 13, 13, KEY + PLACE)
#: Bytes a row counts for besides its text.
ROW_BYTES = 8
#: A cut is fine enough when the bytes that it does not divide are this share of a shard; among rows of equal texts
#: (which stay together if they can), when they are that share.
FINE, TOGETHER = 0.002, 0.01
#: Rows that are numbered in one task.
NUMBERED = 50_000
LAW = "bytes"
METADATA = ("lang", "source", "n_chars")


@dataclasses.dataclass
class Tree:
    """One entry per depth: of each node, in order, the dimension and the last point on the left; then shard numbers."""

    levels: list[tuple[list[int], list[int]]]
    shards: list[int]


def _bits(value: Column, count: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - count)


def measured(
    df: DataFrame, key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = METADATA, keep_text: bool = False
) -> DataFrame:
    """``df`` with ``size``, ``text_crc32`` and ``points`` (one number per metadata column); its text goes unless kept.

    ``size`` counts the bytes of the text in UTF-8 (null: none) and ``ROW_BYTES``. Rows of equal texts take the least
    metadata among them, so that they share a place. A null of a metadata column is a value of its own, below all
    numbers; numbers beyond 2^64 count as the largest. Columns of the three names are replaced, all others stay.
    """
    t, kind = text_of(text), dict((f.name, f.dataType) for f in df.schema)
    rest = [c for c in df.columns if c.lower() not in ("size", "text_crc32", "points") and (keep_text or c != text)]
    k, low, code = spare(df, "text_key_"), spare(df, "low_"), spare(df, "codes_")

    def coded(name: str) -> Column:
        if not isinstance(kind[name], NumericType):
            return _bits(quoted(name).cast("string"), CODE)
        x = F.nanvl(quoted(name).cast("double"), F.lit(None).cast("double"))
        scaled = F.signum(x) * F.least(F.log2(1 + F.abs(x)), F.lit(64.0))
        return F.coalesce(F.floor((scaled + 64) * ((2**CODE - 2) / 128)) + 1, F.lit(0)).cast("long")

    rows = df.select(
        *[quoted(c) for c in rest], F.octet_length(t).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        text_key(t).alias(k), F.array(*[coded(c) for c in metadata]).alias(code),
    ).withColumn("size", F.col("size") + ROW_BYTES)
    rows = staged(
        rows.withColumn(
            low, F.shiftleft(_bits(quoted(key).cast("string"), KEY), PLACE) + _bits(F.monotonically_increasing_id(), PLACE)
        )
    )
    least = [F.min(F.get(code, F.lit(i))) for i in range(len(metadata))]
    shared = rows.groupBy(k).agg(F.array(*least).alias("points"))
    point = lambda c: F.shiftleft(c, BITS - CODE) + F.shiftleft(_bits(F.col(k), TEXT), KEY + PLACE) + F.col(low)
    return rows.join(shared, k).withColumn("points", F.transform("points", point)).drop(k, low, code)


def _listed(numbers: list) -> Column:
    """A list as one constant, whatever its length."""
    return F.split(F.lit(",".join("" if x is None else str(x) for x in numbers)), ",").cast("array<long>")


def _point(node: str, dims: list[int]) -> Column:
    return F.get("points", F.get(_listed(dims), F.col(node)).cast("int"))


def _down(rows: DataFrame, levels: list[tuple[list[int], list[int]]], name: str) -> DataFrame:
    """``rows`` with the number of the node that each is in, counted from the left."""
    rows = rows.withColumn(name, F.lit(0))
    for dims, cuts in levels:
        right = _point(name, dims) > F.get(_listed(cuts), F.col(name))
        rows = rows.withColumn(name, 2 * F.col(name) + right.cast("int"))
    return rows


def _cuts(rows: DataFrame, dims: list[int], goals: list[float | None], target: float) -> list[int]:
    """For each node of ``rows`` the point up to which its bytes come nearest to its goal; ``target``: bytes of a shard."""
    n = len(dims)
    at, before, cut, left = [0] * n, [0.0] * n, [(1 << 62)] * n, BITS
    live = [goal is not None for goal in goals]
    for step in STEPS:
        if not any(live):
            break
        left -= step
        point = _point("node", dims)
        here = rows.select("node", point.alias("p"), "size").where(F.get(_listed([int(x) for x in live]), F.col("node")) == 1)
        here = here.where(F.shiftright("p", left + step) == F.get(_listed(at), F.col("node")))
        sums = here.groupBy("node", F.shiftright("p", left).alias("b")).agg(F.sum("size").alias("w"))
        upto = Window.partitionBy("node").orderBy("b")  # at most 2^20 rows a node
        goal = F.get(F.split(F.lit(",".join(str(g or 0.0) for g in goals)), ",").cast("array<double>"), F.col("node"))
        start = F.get(F.split(F.lit(",".join(map(str, before))), ",").cast("array<double>"), F.col("node"))
        run = sums.select("node", "b", "w", (F.sum("w").over(upto) + start).alias("end"), F.lead("b").over(upto).isNull().alias("last"))
        hits = run.where((F.col("end") - F.col("w") < goal) & ((F.col("end") >= goal) | F.col("last"))).collect()  # one row a node
        for r in hits:
            at[r.node], before[r.node] = r.b, r.end - r.w
            # The last point of this bucket, or of the one before it, whichever leaves the bytes nearer to the goal.
            over = r.end - goals[r.node] <= goals[r.node] - before[r.node]
            cut[r.node] = ((r.b + 1) << left) - 1 if over else (r.b << left) - 1
            live[r.node] = r.w > target * (TOGETHER if left <= KEY + PLACE else FINE)
    return cut


def fit(points: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> Tree:
    """The tree over ``measured`` rows: ``shards`` leaves, or so many that each holds about ``target_bytes``.

    The rows are read a few times for each depth of the tree; stage them first. An empty table gives one leaf.
    """
    first = points.select(F.size("points").alias("n")).first()
    width = range(first.n if first else 1)
    total = points.agg(F.sum("size")).first()[0] or 0
    count = shards if shards else max(1, round(total / target_bytes))
    levels: list[tuple[list[int], list[int]]] = []
    leaves, whole = [count], None
    while max(leaves) > 1:
        rows = _down(points, levels, "node").select("node", "points", "size")
        code = lambda d: F.shiftright(F.get("points", F.lit(d)), BITS - CODE)
        spans = rows.groupBy("node").agg(
            F.sum("size").alias("bytes"), F.array(*[F.max(code(d)) - F.min(code(d)) for d in width]).alias("spans")
        ).collect()  # one row a node
        found = {r.node: r for r in spans}
        whole = whole or (found[0].spans if found else [0])
        dims, goals = [0] * len(leaves), [None] * len(leaves)
        for node, k in enumerate(leaves):
            if k > 1 and node in found:
                share = [s / w if w else 0.0 for s, w in zip(found[node].spans, whole)]
                dims[node] = share.index(max(share))
                goals[node] = found[node].bytes * (k // 2) / k
        levels.append((dims, _cuts(rows, dims, goals, total / count)))
        leaves = [half for k in leaves for half in ((k // 2, k - k // 2) if k > 1 else (k, 0))]
    numbers, at = [], 0
    for k in leaves:
        numbers.append(at)
        at += k
    return Tree(levels, numbers)


def assign(points: DataFrame, tree: Tree) -> DataFrame:
    """``measured`` rows with ``law`` and ``shard`` in place of ``points``; an expression of each row alone."""
    node = spare(points, "node_")
    placed = _down(points, tree.levels, node)
    shard = F.get(_listed(tree.shards), F.col(node)).cast("int")
    rest = [quoted(c) for c in points.columns if c not in ("points", "shard", "law")]
    return placed.select(*rest, F.lit(LAW).alias("law"), shard.alias("shard"))


def with_slots(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """``assigned`` with ``slot``: rows of a shard numbered from 0 without gaps, in an order of hash.

    Rows are numbered in buckets of about ``NUMBERED``, which follow from a hash of key and text, and shifted by the
    sizes of the buckets before them; so no shard has to fit a task. Equal rows are dealt by their place.
    """
    place, part, at, start, n = (spare(assigned, c) for c in ("place_", "bucket_", "at_", "start_", "n_"))
    assigned = staged(assigned.withColumn(place, F.monotonically_increasing_id()))
    buckets = max(1, -(-assigned.count() // NUMBERED))
    dealt = assigned.withColumn(
        part, F.pmod(F.xxhash64(quoted(key).cast("string"), "text_crc32", place), F.lit(buckets)).cast("int")
    )
    group = ["shard", part]
    earlier = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*group).agg(F.count(F.lit(1)).alias(n))
    starts = sizes.select(*group, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(start))
    numbered = dealt.withColumn(at, F.row_number().over(Window.partitionBy(*group).orderBy(place)) - 1).join(starts, group)
    return numbered.withColumn("slot", (F.col(start) + F.col(at)).cast("long")).drop(place, part, at, start)


def shard(
    df: DataFrame, key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = METADATA,
    shards: int | None = None, target_bytes: int | None = None,
) -> DataFrame:
    """``df`` without its text, with ``size``, ``text_crc32``, ``law``, ``shard`` and ``slot``.

    Shards hold nearly equal bytes. Rows of equal texts stay together unless they outweigh ``TOGETHER`` of a
    shard and a border falls among them. Null texts are empty; null keys and metadata are values like others; repeated rows have
    slots of their own. An empty table gives an empty result, fewer rows than shards leave shards empty.
    """
    points = staged(measured(df, key, text, metadata))
    return with_slots(assign(points, fit(points, shards, target_bytes)), key)


def write(
    df: DataFrame, folder: str, tree: Tree, key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = METADATA, files: int = 1
) -> None:
    """``df`` as Parquet, one folder ``shard=N`` per shard of ``tree``, in ``files`` files each."""
    placed = assign(measured(df, key, text, metadata, keep_text=True), tree).drop("law", "size", "text_crc32")
    part = F.pmod(F.xxhash64(quoted(key).cast("string")), F.lit(files))
    placed.repartition(len(tree.shards) * files, "shard", part).write.partitionBy("shard").parquet(folder)
