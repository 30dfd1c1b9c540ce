"""Near-duplicates: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

Each different text is a weighted set of five-word shingles. Improved consistent weighted sampling draws,
for each of a fixed number of hash functions, one shingle and its quantised weight, such that two texts
draw alike with the probability of their weighted Jaccard similarity. Draws are grouped to bands; texts
that agree in a band meet in its bucket. A bucket does not emit its pairs: each text is matched with the
best of a few leaders, and links are verified on the whole texts. Then texts that agree enough but are not
connected are brought together in groups, once each, and compared there: each such pair is verified, or connected
by then. Only links that connect something leave a task. Linked texts form classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.storage import staged
from gridwright.llm.common import lists, mixed, quoted, small, spare, text_key, text_of, values, window_hashes, word_hashes
from gridwright.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
#: 12 bands of 3 draws find 99.98 % of the pairs of similarity 0.8, and more above.
BANDS, ROWS = 12, 3
DRAWS = BANDS * ROWS
#: Equal draws that a pair needs to be compared: one of similarity 0.8 has fewer with a chance of 2e-4.
AGREE = 20
#: Equal draws from which a text is not made a leader of its bucket itself.
CLOSE = 29
#: Texts of a bucket that are matched in one task; larger buckets are dealt to several.
BUCKET = 5_000
#: Texts, and characters of texts, that are compared with each other in one task; larger groups meet in pairs of blocks.
GROUP_TEXTS, GROUP_CHARS = 1_000, 8_000_000
#: Texts that are compared with one leader in one task.
COMPARED = 2_000
#: Document frequencies are counted in this many buckets of shingles, whatever the corpus.
DF_BUCKETS = 1 << 16
#: What a shingle weighs: 1 + IDF_SHARE * log10(N / df). Small, so that a group of near copies which is a
#: third of the corpus is still held together by its common shingles.
IDF_SHARE = 0.1
DRAW_ROWS = 1 << 15

_TABLES: list[np.ndarray] = []


def counted_shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the text's shingles, and how often each occurs. Fewer than five words: one shingle of all."""
    h = window_hashes(word_hashes(text.lower().split()), SHINGLE)
    return np.unique(h, return_counts=True)


def weights(h: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1.0 + np.log(counts)) * idf[(h & np.uint64(DF_BUCKETS - 1)).astype(np.int64)]


def _tables() -> list[np.ndarray]:
    """r, 1 / r, ln c and beta of each draw for each of ``DRAW_ROWS`` remainders of a shingle's hash."""
    if not _TABLES:
        _TABLES.extend(np.empty((DRAW_ROWS, DRAWS), np.float32) for _ in range(4))
        for d in range(DRAWS):
            at = np.arange(DRAW_ROWS, dtype=np.uint64) * np.uint64(DRAWS) + np.uint64(d)
            u = [
                (mixed(at * np.uint64(5) + np.uint64(i + 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
                for i in range(5)
            ]
            r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
            for table, column in zip(_TABLES, (r, 1 / r, np.log(c), u[4])):
                table[:, d] = column
    return _TABLES


def sketch(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The draws, each as 32 bits of shingle and quantised weight."""
    r, inverse, ln_c, beta = _tables()
    best = np.full(DRAWS, np.inf, np.float32)
    drawn = np.zeros(DRAWS, np.uint64)
    row = ((h >> np.uint64(40)) % np.uint64(DRAW_ROWS)).astype(np.int64)
    log_weight = np.log(weight).astype(np.float32)
    for lo in range(0, len(h), 2048):
        i = row[lo : lo + 2048]
        b = beta[i]
        t = np.floor(log_weight[lo : lo + 2048, None] * inverse[i] + b)
        cost = ln_c[i] - r[i] * (t - b + 1)
        at = cost.argmin(axis=0)
        own = cost[at, np.arange(DRAWS)]
        value = mixed(h[lo + at] + t[at, np.arange(DRAWS)].astype(np.int64).astype(np.uint64))
        better = own < best
        best[better], drawn[better] = own[better], value[better]
    return (drawn >> np.uint64(32)).astype(np.uint32).view(np.int32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted sets (hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    rest = a[1].sum() + b[1].sum() - both
    return float(both / rest) if rest else 1.0


# -- steps over partitions ---------------------------------------------------------


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task one row: in how many texts each bucket of shingles occurs, and the number of texts."""
    total, n = np.zeros(DF_BUCKETS, np.int64), 0
    for batch in small(batches):
        for text in batch.column("t").to_pylist():
            h, _ = counted_shingles(text)
            if len(h):
                n += 1
                total[np.unique((h & np.uint64(DF_BUCKETS - 1)).astype(np.int64))] += 1
    if n:
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], n))], ["b", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """The weight of each bucket of shingles over all ``texts`` (column ``t``): a list of fixed length."""
    rows = texts.mapInArrow(_frequencies, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    found = dict((r.b, r.n) for r in rows)
    total = found.pop(-1, 1)
    df = np.ones(DF_BUCKETS)
    for b, n in found.items():
        df[b] = n
    return 1.0 + IDF_SHARE * np.log10(np.maximum(1.0, total / df))


def _sketcher(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = []
            for text in batch.column("t").to_pylist():
                h, counts = counted_shingles(text)
                found.append(sketch(h, weights(h, counts, idf.value)) if len(h) else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("k"), lists(found, pa.int32())], ["k", "s"])

    return run


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys, whole; rows come sorted by the keys."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
        differs = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            differs |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(differs) + 1).tolist(), batch.num_rows]
        if rest and any(rest[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in keys):
            yield pa.Table.from_batches(rest)
            rest = []
        for i, j in zip(edges, edges[1:]):
            rest.append(batch.slice(i, j - i))
            if j < batch.num_rows:
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


def _draws(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(-1, DRAWS)


PAIR = pa.struct([("a", pa.binary()), ("b", pa.binary())])


def _emit(rows: list[dict], kind: pa.StructType, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_struct_array(pa.array(rows[i : i + size], kind))


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: each text with the leader that it agrees with most, and the leaders themselves (b null)."""
    rows: list[dict] = []
    for group in _by_group(batches, ["bucket", "part"]):
        keys = group["k"].to_pylist()
        draws = _draws(group["s"])
        leaders = np.zeros(len(keys), np.int64)
        count = 0
        for i in range(len(keys)):
            best, agree = -1, -1
            if count:
                equal = (draws[leaders[:count]] == draws[i]).sum(axis=1)
                best = int(equal.argmax())
                agree = int(equal[best])
            if agree >= AGREE:
                rows.append({"a": keys[i], "b": keys[leaders[best]], "bucket": None})
            if agree < CLOSE:
                leaders[count] = i
                count += 1
                if group["parts"][0].as_py() > 1:
                    rows.append({"a": keys[i], "b": None, "bucket": group["bucket"][0].as_py()})
        if len(rows) >= 10_000:
            yield from _emit(rows, LED)
            rows = []
    yield from _emit(rows, LED)


LED = pa.struct([("a", pa.binary()), ("b", pa.binary()), ("bucket", pa.int64())])


def _merge(own: np.ndarray, at: int, others: np.ndarray) -> list[int]:
    """Put the sets of ``others`` together with the set of ``at``; one member of each set that was apart."""
    labels, first = np.unique(own[others], return_index=True)
    apart = labels != own[at]
    if apart.any():
        own[np.isin(own, labels[apart])] = own[at]
    return others[first[apart]].tolist()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per meeting, links that span the unconnected texts which agree enough: at most one less than there are texts."""
    rows: list[dict] = []
    for group in _by_group(batches, MEETING):
        roots = group["root"].to_pylist()
        number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        if len(number) < 2:
            continue
        keys, seeks = group["k"].to_pylist(), group["seeks"].to_numpy(zero_copy_only=False)
        root = np.array([number[r] for r in roots])
        draws, spanned = _draws(group["s"]), np.arange(len(keys))
        for i in np.flatnonzero(seeks).tolist():
            equal = (draws == draws[i]).sum(axis=1)
            near = np.flatnonzero((equal >= AGREE) & (root != root[i]))
            rows += [{"a": keys[i], "b": keys[j]} for j in _merge(spanned, i, near)]
        if len(rows) >= 10_000:
            yield from _emit(rows, PAIR)
            rows = []
    yield from _emit(rows, PAIR)


class _Together:
    """Texts that are compared with each other: their shingles as one long list."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.texts = texts
        self.total = np.array([w.sum() for _, w in texts])
        self.starts = np.cumsum([0, *[len(h) for h, _ in texts[:-1]]])
        found, self.places = np.unique(np.concatenate([h for h, _ in texts]), return_inverse=True)
        self.weights = np.concatenate([w for _, w in texts])
        self.spread = np.zeros(len(found))

    def similarities(self, i: int, others: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarities of text ``i`` and others."""
        if len(others) < 4:
            return np.array([similarity(self.texts[i], self.texts[j]) for j in others])
        own = slice(self.starts[i], self.starts[i] + len(self.texts[i][0]))
        self.spread[self.places[own]] = self.weights[own]
        both = np.add.reduceat(np.minimum(self.spread[self.places], self.weights), self.starts)
        self.spread[self.places[own]] = 0
        return (both / (self.total + self.total[i] - both))[others]


def _verify_together(idf, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per group and pair of blocks: each pair of texts that agree enough is connected already or verified; new links."""
        rows: list[dict] = []
        for group in _by_group(batches, ["group", "x", "y"]):
            roots, keys = group["root"].to_pylist(), group["k"].to_pylist()
            number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
            root = np.array([number[r] for r in roots])
            if len(number) < 2:
                continue
            texts = []
            for text in values(group["t"].combine_chunks()):
                h, counts = counted_shingles(text)
                texts.append((h, weights(h, counts, idf.value)))
            block, draws, together = group["block"].to_numpy(), _draws(group["s"]), _Together(texts)
            crossing = block.min() != block.max()
            for i in range(1, len(keys)):
                near = np.flatnonzero(((draws[:i] == draws[i]).sum(axis=1) >= AGREE) & (root[:i] != root[i]))
                if crossing:
                    near = near[block[near] != block[i]]
                if len(near):
                    alike = near[together.similarities(i, near) >= least]
                    rows += [{"a": keys[i], "b": keys[j]} for j in _merge(root, i, alike)]
            if len(rows) >= 10_000:
                yield from _emit(rows, PAIR)
                rows = []
        yield from _emit(rows, PAIR)

    return run


MEETING = ["bucket", "block", "part"]


def one_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal texts that meet in a task, one."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for k in batch.column("k").to_pylist():
            keep.append(k not in seen)
            seen.add(k)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _verifier(idf, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by leader and part, the leader's own text first."""
        lead, head, rows = None, None, []
        for batch in small(batches):
            for b, part, role, k, text in zip(*(batch.column(c).to_pylist() for c in ("b", "part", "role", "k", "t"))):
                h, counts = counted_shingles(text)
                own = h, weights(h, counts, idf.value)
                if role == 0:
                    lead, head = (b, part), own
                elif lead == (b, part) and similarity(own, head) >= least:
                    rows.append({"a": k, "b": b})
            yield from _emit(rows, PAIR)
            rows = []

    return run


def verified(pairs: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose texts ``(k, t)`` are similar enough.

    Each text travels once per leader that it is compared with. A leader of very many pairs is sent to
    several tasks, with a share of the pairs each.
    """
    sizes = staged(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / COMPARED).cast("int").alias("parts")))
    members = pairs.join(sizes, "b").select(
        F.col("a").alias("k"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role")
    )
    heads = sizes.select(
        F.col("b").alias("k"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role")
    )
    # One join strategy at every size: sorted on both sides.
    dealt = members.unionAll(heads).hint("merge").join(texts, "k").select("b", "part", "role", "k", "t")
    return (
        dealt.repartition("b", "part").sortWithinPartitions("b", "part", "role")
        .mapInArrow(_verifier(idf, least), "a binary, b binary")
    )


def classes(df: DataFrame, text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``(k, root)`` for each different text of ``df`` that is linked to another; ``k`` is its ``text_key``.

    Texts of one class have equal roots. Texts that no other different text is linked to have no row.
    """
    spark = df.sparkSession
    texts = df.select(text_of(text).alias("t")).select(text_key(F.col("t")).alias("k"), "t")
    idf = spark.sparkContext.broadcast(inverse_frequencies(texts))  # of fixed size
    sketches = staged(
        texts.mapInArrow(_sketcher(idf), "k binary, s array<int>").groupBy("k").agg(F.first("s").alias("s")).where(F.size("s") > 0)
    )
    band = lambda i: F.xxhash64(F.lit(i), *(F.get("s", F.lit(ROWS * i + j)) for j in range(ROWS)))
    placed = sketches.select("k", F.explode(F.array(*map(band, range(BANDS)))).alias("bucket"))
    # Only buckets that two texts meet in go on; the largest in parts.
    met = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = staged(met.select("bucket", F.ceil(F.col("n") / BUCKET).cast("int").alias("parts")))
    dealt = staged(
        placed.join(met, "bucket").join(sketches, "k").select(
            "bucket", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("part"), "parts", "k", "s"
        )
    )
    columns = ["bucket", "part", "parts", "k", "s"]
    ordered = lambda d: d.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "k")
    kind = "a binary, b binary, bucket long"
    led = staged(ordered(dealt).select(*columns).mapInArrow(_lead, kind))
    # The leaders of a dealt bucket's parts meet once more.
    again = led.where("b IS NULL").select("bucket", F.col("a").alias("k")).join(sketches, "k").select(
        "bucket", F.lit(0).alias("part"), F.lit(1).alias("parts"), "k", "s"
    )
    across = ordered(again).select(*columns).mapInArrow(_lead, kind)
    ordered_pair = lambda d: d.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = staged(ordered_pair(led.unionAll(across).where("b IS NOT NULL").select("a", "b")))
    wanted = staged(dealt.select("k").distinct())
    held = staged(texts.join(wanted.hint("merge"), "k").mapInArrow(one_of_each, "k binary, t string"))
    links = staged(verified(pairs, held, idf, least))
    rooted = staged(components(links))
    with_root = lambda d: d.join(rooted.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    # Texts outside the largest component of a bucket seek: each unconnected pair has one of them. In blocks, they
    # meet each part of the bucket.
    of_root = with_root(dealt.select("bucket", "k")).groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    open_buckets = of_root.groupBy("bucket").agg(
        F.max_by("root", "n").alias("main"), F.ceil((F.sum("n") - F.max("n")) / BUCKET).cast("int").alias("blocks")
    )
    open_buckets = staged(open_buckets.where("blocks > 0"))
    opened = dealt.join(open_buckets, "bucket")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sought = opened.select("bucket", upto("blocks").alias("block"), "part", "k", "s", F.lit(False).alias("seeks"))
    seekers = with_root(opened).where(F.col("root") != F.col("main")).select(
        "bucket", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("block"), upto("parts").alias("part"), "k", "s",
        F.lit(True).alias("seeks"),
    )
    meetings = with_root(staged(sought.unionAll(seekers))).select(*MEETING, "k", "s", "seeks", "root")
    maybe = staged(
        meetings.repartition(*MEETING).sortWithinPartitions(*MEETING, "k").mapInArrow(_candidates, "a binary, b binary")
    )
    more = staged(_verified_in_groups(maybe, sketches, held, with_root, idf, least))
    if not more.isEmpty():
        stars = rooted.select(F.col("node").alias("a"), F.col("root").alias("b"))
        rooted = components(stars.unionAll(more))  # from what is known, so few rounds are left
    return rooted.select(F.col("node").alias("k"), "root")


def _verified_in_groups(maybe: DataFrame, sketches: DataFrame, held: DataFrame, with_root, idf, least: float) -> DataFrame:
    """New links ``(a, b)`` among texts that candidate links ``maybe`` bring into one group.

    A group's texts meet once, those of a large group in pairs of blocks: compared there, with nothing but links that
    connect what was apart going out.
    """
    groups = components(maybe).select(F.col("node").alias("k"), F.col("root").alias("group"))
    texts = staged(groups.join(held.hint("merge"), "k"))
    sizes = texts.groupBy("group").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_TEXTS), F.ceil(F.sum(F.length("t")) / GROUP_CHARS)).cast("int").alias("blocks")
    )
    own, other = F.col("block"), F.col("other")
    placed = texts.join(staged(sizes), "group").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "group", F.least(own, other).alias("x"), F.greatest(own, other).alias("y"), "block", "k", "t"
    )
    known = with_root(sketches.join(groups.select("k"), "k", "left_semi")).select("k", "s", "root")
    met = dealt.join(known.hint("merge"), "k").select("group", "x", "y", "block", "k", "t", "s", "root")
    return (
        met.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "k")
        .mapInArrow(_verify_together(idf, least), "a binary, b binary")
    )


def _labels(df: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """``(k, root, class_id, class_size)`` of each different text."""
    sizes = df.select(text_key(text_of(text)).alias("k"), quoted(key).alias("id")).groupBy("k").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n")
    )
    rooted = sizes.join(classes(df, text, least), "k", "left").withColumn("root", F.coalesce("root", "k"))
    groups = rooted.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    return rooted.select("k", "root").join(groups, "root").select("k", "root", "class_id", "class_size")


def label(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``df`` with ``class_id``, the least key of the row's class, and ``class_size``, its number of rows.

    Equal texts are one class, and so are texts linked by a weighted Jaccard similarity of at least
    ``least``, directly or over others. Null texts count as empty; a text without a word is only like its
    equals. A class of null keys alone has a null ``class_id``. Columns of the two names are replaced, all
    others stay. An empty table gives an empty result.
    """
    rows = df.drop(*[c for c in df.columns if c.lower() in ("class_id", "class_size")])
    k = spare(rows, "key_of_text")
    # Written, so that the join can split a text of very many rows.
    found = staged(_labels(rows, key, text, least).select(F.col("k").alias(k), "class_id", "class_size"))
    return rows.withColumn(k, text_key(text_of(text))).join(found, k).drop(k)


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of each class, one of the least key, with the columns of ``df``; see ``label``.

    Of several rows with the class's least key (repeated rows) any one stays.
    """
    k, root, first = (spare(df, c) for c in ("key_of_text", "root_of_class", "least_key"))
    found = staged(_labels(df, key, text, least).select(F.col("k").alias(k), F.col("root").alias(root), F.col("class_id").alias(first)))
    rows = df.withColumn(k, text_key(text_of(text)))
    left = rows.join(found, k).where(quoted(key).eqNullSafe(F.col(first)))
    ids = df.select(quoted(key).alias("id_"), text_key(text_of(text)).alias(k)).join(found, k).where(F.col("id_").eqNullSafe(F.col(first)))
    if not ids.groupBy(root).count().where("count > 1").isEmpty():
        left = left.dropDuplicates([root])
    return left.select(*[quoted(c) for c in df.columns])
