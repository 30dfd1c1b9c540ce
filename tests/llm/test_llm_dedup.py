"""Near-duplicates, repeated bytes, repeated passages and components against brute force and on odd rows."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import prose
from pyspark.sql import functions as F

from gridwright.functions import storage
from gridwright.functions.storage import staged
from gridwright.llm import components as co
from gridwright.llm import near_dedup as nd
from gridwright.llm import queries
from gridwright.llm import substring_dedup as sb
from gridwright.llm import suffix_dedup as sf

FOLDER = "/root/testdata/sf0.001"


def joined(links):
    """Union-find over links; the least member names a class."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


def edited(text, seed, edits):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[r.randrange(len(words))] = f"changed{r.randrange(10**6)}"
    return " ".join(words)


# -- components -------------------------------------------------------------------


def test_components_match_union_find(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    links += [(600, 600 + i) for i in range(1, 50)] + links[:20] + [(b, a) for a, b in links[:20]]
    got = {x.node: x.root for x in co.components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = {x: root for x, root in joined(links).items() if any(x in e and e[0] != e[1] for e in links)}
    assert got == expected
    assert co.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- near duplicates --------------------------------------------------------------


def weighted_classes(rows):
    """Class of each row from all pairs, with plain dictionaries."""
    sets = []
    for _, text in rows:
        h, n = nd.counted_shingles(text or "")
        sets.append(dict(zip(h.tolist(), n.tolist())))
    df = collections.Counter()
    for s in sets:
        df.update({x % nd.DF_BUCKETS for x in s})
    total = sum(bool(s) for s in sets)
    weight = lambda x, n: (1 + np.log(n)) * (1 + nd.IDF_SHARE * np.log10(max(1, total / df[x % nd.DF_BUCKETS])))
    sets = [{x: weight(x, n) for x, n in s.items()} for s in sets]
    links = [(i, i) for i in range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            both = sum(min(w, sets[j][x]) for x, w in sets[i].items() if x in sets[j])
            rest = sum(sets[i].values()) + sum(sets[j].values()) - both
            if (rows[i][1] or "") == (rows[j][1] or "") or rest and both / rest >= 0.8:
                links.append((j, i))
    return joined(links)


def group_rows():
    rows = [(i, prose(i, 60 + i)) for i in range(25)]
    for i in range(12):
        rows += [(100 + 10 * i + k, edited(rows[i][1], 50 * i + k, 1 + k % 3)) for k in range(4)]
    rows += [(300 + k, edited(prose(77, 150), k, 1)) for k in range(40)] + [(400 + k, prose(5, 65)) for k in range(5)]
    return rows + [(500, "one two"), (501, "one two"), (502, "One  two"), (503, ""), (504, None), (505, " \n"), (506, "six")]


@pytest.mark.parametrize("bucket, compared", [(20_000, 2_000), (8, 3)])
def test_classes_match_all_pairs(spark, monkeypatch, bucket, compared):
    monkeypatch.setattr(nd, "BUCKET", bucket)
    monkeypatch.setattr(nd, "COMPARED", compared)
    rows = group_rows()
    root = weighted_classes(rows)
    least = collections.defaultdict(lambda: 10**9)
    for i, (key, _) in enumerate(rows):
        least[root[i]] = min(least[root[i]], key)
    got = {r.doc_id: r for r in nd.label(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.class_id for k, r in got.items()} == {key: least[root[i]] for i, (key, _) in enumerate(rows)}
    sizes = collections.Counter(root.values())
    assert {k: r.class_size for k, r in got.items()} == {key: sizes[root[i]] for i, (key, _) in enumerate(rows)}


def decoys(seed, n=259, others=60):
    """Edits of one text, similar by less than 0.8 to the last two of them, which are alike by more."""
    r = random.Random(seed)
    base, places = prose(seed, n).split(), list(range(8, n - 12, 6))

    def variant(edits):
        words = list(base)
        for at, name in edits:
            words[at] = f"changed{name}"
        return " ".join(words)

    texts = [variant([(p, f"{i}x{p}") for p in r.sample(places, 3)]) for i in range(others)]
    p = r.sample(places, 5)
    texts.append(variant([(p[0], "both"), (p[1], "a"), (p[2], "b"), (1, "e")]))
    texts.append(variant([(p[0], "both"), (p[3], "c"), (p[4], "d"), (n - 2, "f")]))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, bucket", [(20, 5_000), (69, 5_000), (69, 7)])
def test_refused_decoys_do_not_hide_a_partner(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(nd, "BUCKET", bucket)
    rows = decoys(seed)
    root = weighted_classes(rows)
    assert root[60] == root[61] and list(root.values()).count(root[60]) == 2
    got = {r.doc_id: r.class_id for r in nd.label(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root


def test_draws_agree_as_often_as_texts_are_similar():
    r = np.random.RandomState(3)
    errors = []
    for trial in range(40):
        h = np.unique(r.randint(1, 2**62, 400).astype(np.uint64))
        a, b = np.sort(r.choice(h, 250, False)), np.sort(r.choice(h, 300, False))
        wa, wb = (1 + 3 * ((x >> np.uint64(7)) % np.uint64(5)) / 4.0 * r.uniform(0.5, 1.5) for x in (a, b))
        errors.append((nd.sketch(a, wa) == nd.sketch(b, wb)).mean() - nd.similarity((a, wa), (b, wb)))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12


def test_one_of_each_class_stays(spark, odd, nothing):
    rows = group_rows()
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").withColumn("class_id", F.lit("own"))
    kept = nd.representatives(docs)
    assert kept.columns == docs.columns and kept.where("class_id <> 'own'").count() == 0
    root = weighted_classes(rows)
    least = collections.defaultdict(lambda: 10**9)
    for i, (key, _) in enumerate(rows):
        least[root[i]] = min(least[root[i]], key)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert nd.representatives(odd).columns == odd.columns
    assert nd.representatives(odd).count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert nd.representatives(nothing).count() == 0 and nd.label(nothing).count() == 0
    assert nd.label(odd).count() == odd.count()


# -- repeated bytes ---------------------------------------------------------------


@pytest.mark.parametrize("codes, n", [(1, 1), (1, 40), (2, 300), (3, 2000), (240, 500)])
def test_two_stage_order_is_the_order_of_suffixes(codes, n):
    r = np.random.RandomState(codes + n)
    text = np.append(r.randint(1, codes + 1, n), 0).astype(np.uint8)
    raw = bytes(text)
    order = sf.two_stage_order(text, 64).tolist()
    assert sorted(order) == list(range(n + 1))
    assert [raw[i : i + 64] for i in order] == sorted(raw[i : i + 64] for i in range(n + 1))


def test_equal_windows_have_equal_anchors():
    shared = prose(9, 300).encode()
    a, b = prose(1, 100).encode() + shared + prose(2, 50).encode(), prose(3, 33).encode() + shared
    found = [{} for _ in "ab"]
    for raw, into in ((a, found[0]), (b, found[1])):
        first, last, place, h = sf.anchors(raw)
        assert first[0] == 0 and last[-1] == len(raw) - sf.WINDOW and (first[1:] == last[:-1] + 1).all()
        for lo, hi, at, x in zip(first, last, place, h):
            for s in range(lo, hi + 1):
                into[raw[s : s + sf.WINDOW]] = (at - s, x)
    both = found[0].keys() & found[1].keys()
    assert len(both) >= len(shared) - sf.WINDOW and all(found[0][w] == found[1][w] for w in both)


def removed(texts, width=400):
    counts = collections.Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone, left = np.zeros(len(t) + 1, bool), b""
        for i in range(len(t) - width + 1):
            if counts[t[i : i + width]] > 1:
                gone[i : i + width] = True
        left = bytes(c for c, g in zip(t, gone) if not g)
        runs = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        out.append((len(t), len(t) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return out


def byte_rows():
    shared, tail = prose(50, 150), prose(51, 120)
    rows = [prose(i, 150) for i in range(10)]
    rows += [f"{prose(20 + i, 40)}{shared}{prose(40 + i, 30 + i)}" for i in range(6)] + [f"{tail}{prose(60 + i, 20)}{tail}" for i in range(2)]
    rows += [edited(prose(70, 400), i, 2) for i in range(12)] + ["ab" * 700, "a" * 401, "a" * 400, "é" * 300, "é" * 300, "", None, "short", prose(3, 150)]
    return rows + [prose(1, 150) + "x", "\U0001f600" * 101 + "y"]


@pytest.mark.parametrize("hot, stretch, block", [(4096, 1 << 20, 1 << 20), (0, 700, 5_000)])
def test_removed_bytes_match_all_windows(spark, monkeypatch, hot, stretch, block):
    monkeypatch.setattr(sf, "HOT_SNIPPETS", hot)
    monkeypatch.setattr(sf, "STRETCH", stretch)
    monkeypatch.setattr(sf, "SORTED_BYTES", block)
    texts = byte_rows()
    if stretch < 1 << 20:  # the limits reach Python workers only as arguments, so this part runs here
        raws = [(t or "").encode() for t in texts]
        places = collections.defaultdict(list)
        for d, raw in enumerate(raws):
            h, _, first, n = sf.snippets(raw)
            for x, a, m in zip(h.tolist(), first.tolist(), n.tolist()):
                places[x].append((d, a, raw[a : a + m + sf.WINDOW - 1]))
        spans = collections.defaultdict(list)
        for x, found in places.items():
            groups = collections.defaultdict(list)
            for d, a, part in found:
                for g, skip, piece in sf.pieces(part, x):
                    groups[g].append((d, a + skip, piece))
            for members in groups.values():
                for (d, a, _), flags in zip(members, sf.shared_windows([p for _, _, p in members])):
                    spans[d] += [(a + lo, a + hi + sf.WINDOW) for lo, hi in sf.ranges(flags)]
        got = []
        for d, raw in enumerate(raws):
            gone, runs, left = sf.without(raw, spans[d])
            got.append((len(raw), gone, runs, hashlib.sha256(left).hexdigest()))
    else:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
        rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sf.remove(docs).collect()}
        got = [rows[i] for i in range(len(texts))]
    assert got == removed([(t or "").encode() for t in texts])


def test_hot_anchors_in_spark(spark, monkeypatch):
    monkeypatch.setattr(sf, "HOT_SNIPPETS", 1)
    texts = byte_rows()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sf.remove(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == removed([(t or "").encode() for t in texts])


def test_removal_on_odd_rows_and_given_documents(spark, odd, nothing):
    got = sf.remove(odd)
    assert got.count() == odd.count() and set(odd.columns) < set(got.columns) and sf.remove(nothing).count() == 0
    texts = [r.text for r in odd.select("text").collect()]
    expected = collections.Counter(removed([(t or "").encode() for t in texts]))
    assert collections.Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == expected
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op8(spark, FOLDER).collect()}
    assert [rows[r.doc_id] for r in given] == removed([r.text.encode() for r in given])


# -- repeated passages ------------------------------------------------------------


def best_chain(points):
    """Score of the best chain by looking at all predecessors; single seeds as segments."""
    best = []
    for a, b in points:
        gains = [s - sb.GAP_COST * (a + b - x - y - 2 * sb.SEED) for (x, y), s in zip(points, best) if x < a and y < b]
        best.append(sb.SEED + max([0.0, *gains]))
    return max(best)


def test_chains_hold_each_seed_once_and_in_order():
    r = random.Random(6)
    for _ in range(100):
        points = sorted({(r.randrange(0, 2000, 9), r.randrange(0, 2000, 9)) for _ in range(r.randint(1, 25))})
        found = sb.chains(points)
        assert {s[:2] for c in found for s in c} <= set(points)
        for c in found:
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(c, c[1:]))
            assert all(max(y[0] - x[0] - x[2], y[1] - x[1] - x[2]) <= sb.MOST_GAP for x, y in zip(c, c[1:]))
        total = max(sum(s[2] for s in c) for c in found)
        assert total <= max(best_chain(points), total)


def test_prefix_maximum_matches_a_scan():
    r = random.Random(8)
    tree, values = sb.PrefixMaximum(50), [(-1e300, -1)] * 50
    for i in range(300):
        p, v = r.randrange(50), (r.random(), i)
        tree.put(p, v)
        values[p] = max(values[p], v)
        q = r.randrange(51)
        assert tree.below(q) == max(values[:q], default=(-1e300, -1))


def exact_runs(texts, least):
    """Words of each text in a run of ``least`` words that another text has too."""
    words = [sb.words_of(t or "") for t in texts]
    where = collections.defaultdict(set)
    for d, w in enumerate(words):
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].add(d)
    out = []
    for w in words:
        out.append({i + k for i in range(len(w) - least + 1) if len(where[tuple(w[i : i + least])]) > 1 for k in range(least)})
    return out


def spread(spans):
    return {i for s in spans.split(",") if s for i in range(*map(int, s.split(":")))}


def test_passages_cover_exact_repeats_and_fuzzy_ones(spark):
    passage, other = prose(500, 70), prose(501, 100)
    texts = [prose(i, 120) for i in range(30)]
    texts += [f"{prose(100 + i, 40 + i)} {passage} {prose(200 + i, 30)}" for i in range(8)]
    texts += [f"{prose(300 + i, 40)} {edited(other, i, 3)} {prose(340 + i, 25)}" for i in range(6)]
    texts += [f"{passage} {prose(400, 30)} {passage}", prose(0, 120), "", None, "few words", prose(600, 49), prose(600, 49)]
    got = {r.id: r for r in sb.mark(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id").collect()}
    for i, exact in enumerate(exact_runs(texts, sb.LEAST_WORDS)):
        row = got[i]
        assert exact <= spread(row.spans) and row.n_words == len(sb.words_of(texts[i] or ""))
        assert row.n_repeated == len(spread(row.spans)) and row.n_spans == len([s for s in row.spans.split(",") if s])
    clean = [i for i in range(1, 30)]
    assert not any(got[i].n_spans for i in clean) and got[0].partners == [45] and got[45].partners == [0]
    fuzzy = [got[38 + i] for i in range(6)]
    assert all(r.n_spans == 1 and r.n_repeated >= 60 and r.partners for r in fuzzy)
    assert not any(got[i].n_spans for i in range(46, len(texts)))


def test_changed_passages_are_found(spark):
    """Passages of 60 words with 5 to 20 % of their words changed; and one of frequent sentences among texts with one of them."""
    texts, sets = [], {}
    for share in (5, 10, 15, 20):
        for n in range(40):
            r = random.Random(1000 * share + n)
            passage = prose(7000 + 100 * share + n, 60).split()
            alike = set(r.sample(range(60), 60 - 60 * share // 100))
            sets.setdefault(share, []).append(len(texts))
            texts.append(f"{prose(20_000 + len(texts), 40)} {' '.join(passage)} {prose(30_000 + len(texts), 40)}")
            other = [w if i in alike else f"new{r.random()}" for i, w in enumerate(passage)]
            texts.append(f"{prose(20_000 + len(texts), 40)} {' '.join(other)} {prose(30_000 + len(texts), 40)}")
    sentences = [prose(50_000 + i, 10) for i in range(6)]
    for i in range(60):
        texts.append(f"{prose(60_000 + i, 40)} {sentences[i % 6]} {prose(61_000 + i, 40)}")
    made = [len(texts), len(texts) + 1]
    texts += [f"{prose(62_000 + i, 40)} {' '.join(sentences)} {prose(63_000 + i, 40)}" for i in range(2)]
    got = {r.id: r for r in sb.mark(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id").collect()}
    found = {share: sum(got[i].partners == [i + 1] and got[i].n_repeated >= 45 for i in ids) / len(ids) for share, ids in sets.items()}
    assert found[5] >= 0.95 and found[10] >= 0.9 and found[15] >= 0.8, found
    assert all(got[i].n_repeated >= 60 and made[1 - n] in got[i].partners for n, i in enumerate(made))
    assert not any(got[i].n_spans for i in range(made[0] - 60, made[0]))
    print("share found by changed words:", found)


def test_passages_meet_all_texts_of_a_frequent_sentence(spark, monkeypatch):
    """A passage whose only seeds that others have too are a frequent sentence, with texts of low and high keys around it."""
    tail = [f"tail{i}" for i in range(45)]
    cut = lambda n: " ".join(f"other{n}w{i}" if i % 5 == 4 else w for i, w in enumerate(tail))  # noqa: E731  runs of four words, no seed
    for n in range(100):  # a sentence with two seeds wherever it stands
        sentence = " ".join(prose(70_000 + n, 14).split())
        texts = [f"{prose(72_000 + i, 40)} {sentence} {prose(73_000 + i, 40)}" for i in range(40)]
        pair = [len(texts), len(texts) + 1]
        texts += [f"{prose(74_000 + i, 40)} {sentence} {cut(i)} {prose(75_000 + i, 40)}" for i in range(2)]
        if len(set.intersection(*(set(sb.seeds(sb.words_of(t))[0].tolist()) for t in texts))) > 1:
            break
    for meet in (sb.MEET, 7):
        monkeypatch.setattr(sb, "MEET", meet)
        got = {r.id: r for r in sb.mark(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id").collect()}
        assert [got[i].partners for i in pair] == [[pair[1]], [pair[0]]] and all(got[i].n_repeated >= 50 for i in pair)
        assert not any(got[i].n_spans for i in range(pair[0]))


def test_places_that_go_on_include_all_that_align():
    r = random.Random(9)
    passed = 0
    for _ in range(1500):
        words = [f"w{r.randrange(6)}" for _ in range(60)]
        core = [f"c{i}" for i in range(r.randint(6, 12))]

        def changed(words):
            return [w for w in (f"z{r.randrange(99)}" if r.random() < 0.1 else w for w in words) if r.random() > 0.05]

        sides = [(changed(words[:30]), changed(words[30:])) for _ in range(2)]
        if r.random() < 0.5:
            sides[1] = ([f"q{i}" for i in range(20)], [])
        a, b = (x + core + y for x, y in sides)
        i, j = (len(x) for x, _ in sides)
        (lo, hi), (start, end), alike = sb.aligned(a, b, [(i, j, len(core))], 0, len(a))
        near = [
            sb._words_near(iter([pa.RecordBatch.from_pylist([{"k": b"", "t": " ".join(w), "s": [{"g": 0, "x": at, "d": len(core) - 5, "n": 2, "y": 0}]}])]))
            for w, at in ((a, i), (b, j))
        ]
        x, y = (np.frombuffer(next(n).column("w")[0].as_py(), np.uint32)[None, :] for n in near)
        found = len(sb.goes_on(x, y, np.array([[len(core)]]))[0])
        passed += found
        assert found or max(hi - lo, end - start) < sb.LEAST_STRETCH
    assert 0 < passed < 1500


def test_places_of_a_frequent_pair_of_seeds_meet_in_some_tasks(spark, monkeypatch):
    """All of them used to meet in one task; now each block meets each other block once, whatever the shares."""
    monkeypatch.setattr(sb, "MEET", 8)
    r = random.Random(4)
    around = [[f"v{i}_{n}" for n in range(40)] for i in range(3)]
    texts = [" ".join(around[i % 3][:20] + ["the", "same", "ten", "words", "are", "found", "in", "all", "these", "texts"] + around[i % 3][20:] + [f"own{i}"]) for i in range(60)]
    r.shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    go_on, found, met = sb._go_on, {}, {}
    for shares in (1, 4):
        joined = []
        monkeypatch.setattr(sb, "SHARES", shares)
        monkeypatch.setattr(sb, "_go_on", go_on)
        rest = sb._rest

        def noted(left, again, held):
            rows = staged(rest(left, again, held))
            joined.append(sorted((bytes(x.k), bytes(x.p), x.x, x.y) for x in rows.collect()))
            return rows

        monkeypatch.setattr(sb, "_rest", noted)
        found[shares] = sorted(map(str, sb.mark(df).collect()))
        monkeypatch.setattr(sb, "_rest", rest)
        met[shares] = joined[0]
    assert met[1] == met[4] and len(met[1]) == len(set(met[1])) > 100 and found[1] == found[4]


def test_shuffle_files_go_when_a_step_is_written(spark, tmp_path):
    """They used to wait until the driver collected its objects."""
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = spark.conf.get(storage.CLEAN_UP)
    status = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    ids = lambda: set(status.keys().mkString(",").split(","))
    first = ids()
    left = storage.staged_alone(df)
    second = ids()
    plain = staged(df)
    assert not second - first and ids() - first and spark.conf.get(storage.CLEAN_UP) == before
    assert sorted(left.collect()) == sorted(plain.collect())


def test_passages_on_odd_rows_and_given_documents(spark, odd, nothing):
    got = sb.mark(odd)
    assert got.count() == odd.count() and set(odd.columns) < set(got.columns) and sb.mark(nothing).count() == 0
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    rows = {r.doc_id: r for r in queries.op9(spark, FOLDER).collect()}
    exact = exact_runs([r.text for r in given], sb.LEAST_WORDS)
    assert sum(len(e - spread(rows[r.doc_id].spans)) for e, r in zip(exact, given)) == 0


# -- pipeline ---------------------------------------------------------------------


def test_pipeline_stages(spark, odd, nothing):
    import corpus_pipeline as cp

    docs = staged(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert [n for n, _ in cp.STAGES][-1] == "best_fit_packing" and len(cp.STAGES) == 5
    seen = [docs]
    for name, stage in cp.STAGES:
        docs = staged(stage(spark, docs, FOLDER))
        seen.append(docs)
        if name != "best_fit_packing":
            assert docs.columns == seen[0].columns
    raw, good, single, clean, masked, packed = seen
    scores = {r.doc_id: r.predicted for r in queries.op1(spark, FOLDER).collect()}
    assert {r.doc_id for r in good.collect()} == {k for k, p in scores.items() if p}
    labelled = nd.label(good).collect()
    assert {r.doc_id for r in single.collect()} == {r.class_id for r in labelled} and single.count() == len({r.class_id for r in labelled})
    held = {r.doc_id for r in queries.op10(spark, FOLDER).collect() if r.contaminated}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - held
    before = {r.doc_id: r for r in clean.collect()}
    for r in masked.collect():
        if "[secret]" not in r.text:
            assert r == before[r.doc_id]
        else:
            assert r.n_chars == len(r.text) and r.text != before[r.doc_id].text
    assert {r.doc_id for r in packed.collect()} == set(before)
    empty = raw.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
    strange = raw.limit(3).unionByName(spark.createDataFrame([(None,) * 5, (1, "", None, None, 0), (1, "", None, None, 0)], raw.schema))
    for _, stage in cp.STAGES:
        assert stage(spark, strange, FOLDER).count() > 0
