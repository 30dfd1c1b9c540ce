"""Spelling variants, conversation repair and sharding against plain Python and on odd rows."""

import collections
import functools
import hashlib
import re
import zlib

import numpy as np
import pytest

from gridwright.llm import conversation_repair as cr
from gridwright.llm import kd_sharding as kd
from gridwright.llm import queries
from gridwright.llm import spelling_variants as sv

FOLDER = "/root/testdata/sf0.001"


# -- variants ---------------------------------------------------------------------


def plain_words(rows):
    lower, n = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), collections.Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(lower)):
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 7
    return {w: k for w, k in n.items() if k >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(n, ratio=10):
    near = {w: [o for o in n if abs(len(o) - len(w)) < 2 and o != w and one_edit(w, o)] for w in n}
    best = {w: min(near[w], key=lambda o: (-n[o], o), default=None) for w in n}
    form = {w: o if o and n[o] >= ratio * n[w] else None for w, o in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n}


def found_forms(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_variants_equal_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows = rows[:60] + [(1000 + i, "Wonderful wonderfull wonderfulé Überrasch überrasch wonderfl ") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = plain_words(rows)
    assert {r.word: r.n for r in sv.corpus_words(df).collect()} == words
    assert found_forms(sv.forms(sv.corpus_words(df))) == plain_forms(words)


@pytest.mark.parametrize("classes, piece", [(1, 3), (4, 2), (6, 2_048)])
def test_variants_of_chains_in_small_pieces(spark, monkeypatch, classes, piece):
    monkeypatch.setattr(sv, "PIECE", piece)
    n = {"abcdefgh": 10_000, "abcdefg": 1_000, "abcdefx": 100, "abcdexx": 10, "bcdefgh": 1_000, "xbcdefgh": 1_000, "hgfedcba": 5, "abcdfegh": 9}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert found_forms(sv.forms(df, classes=classes)) == plain_forms(n)


def test_close_pairs_of_random_words():
    r = np.random.default_rng(5)
    for size in (2, 7, 9):
        for more in (0, 1):
            a, b = r.choice(list(b"abc\xe9"), (60, size)).astype(np.uint8), r.choice(list(b"abc\xe9"), (60, size + more)).astype(np.uint8)
            got = set(zip(*map(np.ndarray.tolist, sv.close_pairs(a, b))))
            text = lambda w: bytes(w).decode("latin-1")
            assert got == {(i, j) for i in range(60) for j in range(60) if one_edit(text(a[i]), text(b[j]))}


def test_runs_of_long_texts_are_whole(monkeypatch):
    text = "alpha, beßta gamma--delta " * 50
    monkeypatch.setattr(sv, "PART", 7)
    assert [w for part in sv.runs(text) for w in part] == re.findall("[A-Za-zÀ-ÿ]+", text)


def test_variants_of_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert {r.word: r.n for r in sv.corpus_words(odd).collect()} == plain_words(rows)
    assert sv.corpus_words(nothing).count() == 0
    assert sv.forms(sv.corpus_words(nothing)).count() == 0


# -- conversations ----------------------------------------------------------------


def faults(rows):
    """Rows of one conversation in order: role, text -> fault."""
    seen, found = set(), []
    for role, text in rows:
        end = text.strip(" \t\n\v\f\r")
        found.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, fault):
    """Every series of edits with up to three turns put in before a row; least cost, then least letters."""
    after = {"s": lambda s: 1 if s == 0 else None, "u": lambda s: 2 if s != 2 else None, "a": lambda s: 3 if s == 2 else None}

    @functools.cache
    def best(i, state, put):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        moves = []
        if i < len(rows):
            role, text = rows[i]
            moves.append((2, "D", state, (), 0, 1))
            if fault[i] not in ("blank", "duplicate"):
                extra = 5 * (fault[i] == "truncated")
                moves.append((extra, "K", after.get(role[:1], lambda s: None)(state), ((role, text),), 0, 1))
                moves += [(extra + 1, "R", after[r[0]](state), ((r, text),), 0, 1) for r in ("user", "assistant")]
        if put < 3:
            moves += [(5, "I", after[r[0]](state), ((r, ""),), put + 1, 0) for r in ("user", "assistant")]
        for cost, letter, then, out, n, step in moves:
            if then is not None:
                rest = best(i + step, then, n)
                if rest:
                    found.append((cost + rest[0], letter + rest[1], out + rest[2]))
        return min(found, key=lambda f: f[:2], default=None)

    return best(0, 0, 0)


def plain_audit(rows, damage=True):
    talks = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        here, blank = talks[conv], lambda x: " " if x is None else x
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20 if damage else 9
        role, text = "user" if kind == 4 else blank(role), blank(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        here += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    found = {}
    for conv, here in talks.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        said = [r[1:] for r in here]
        fault = faults(said)
        turns = {r[0] for r in here} - {None}
        cost, letters, out = cheapest(said, fault)
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:])), cost, letters,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
        )
    return found


def found_audit(df, damage=True):
    said = cr.filled(df, "conv_id", "turn", "role", "text")
    rows = cr.ordered(cr.damaged(said) if damage else said.drop("conv"))
    columns = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return {r.conv_id: tuple(r[c] for c in columns) for r in cr.audit(said, rows).collect()}


def test_repair_query_equals_plain_search(spark):
    df = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    columns = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    found = {r.conv_id: tuple(r[c] for c in columns) for r in queries.op12(spark, FOLDER).collect()}
    assert found == plain_audit([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


@pytest.mark.parametrize("chunk", [1, 3, 1_024])
def test_repair_of_random_talks_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(cr, "CHUNK", chunk)
    r = np.random.default_rng(chunk)
    rows = []
    for conv in (None, 1, 2, 3, 4, 5):
        for turn in range(int(r.integers(1, 12))):
            role = r.choice(["system", "user", "assistant", "tool", "", None], p=[0.15, 0.35, 0.3, 0.1, 0.05, 0.05])
            text = r.choice(["Yes.", "No!", "cut off", " \t", "", "Why?\n", None], p=[0.3, 0.2, 0.2, 0.1, 0.05, 0.1, 0.05])
            rows.append((conv, None if r.random() < 0.1 else int(turn * 2 % 7), None if role is None else str(role), None if text is None else str(text)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found_audit(df, False) == plain_audit(rows, False)
    assert found_audit(df) == plain_audit(rows)


def test_speculation_converges_in_few_passes(spark, monkeypatch):
    monkeypatch.setattr(cr, "CHUNK", 8)
    r = np.random.default_rng(1)
    rows = [(1, i, str(r.choice(["user", "assistant"])), f"{i}." if r.random() < 0.9 else f"{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    placed = cr.ordered(cr.filled(df, "conv_id", "turn", "role", "text").drop("conv"))
    _, passes = cr.converged(placed, placed.select("g", "chunk").distinct())
    assert passes <= 8  # of 50 pieces
    said = [(x[2], x[3]) for x in rows]
    import sys

    sys.setrecursionlimit(10_000)
    cost, letters, out = cheapest(tuple(said), tuple(faults(said)))
    assert found_audit(df, False)[1][5:7] == (cost, letters)
    turns = [(x.role, x.text) for x in cr.repair(df).orderBy("at").collect()]
    assert turns == list(out)


def test_repair_of_nothing_and_of_clashing_columns(spark):
    kind = "conv_id long, turn long, role string, text string, g string, chunk int, at int, i string, fault int, copy int, said string"
    none = spark.createDataFrame([], kind)
    assert found_audit(none) == {} and cr.repair(none).count() == 0
    rows = [(7, 0, "user", "Hello there.", "x", 1, 2, "u", 3, 4, "y"), (7, 1, "assistant", "Yes.", None, None, None, None, None, None, None)]
    assert [(r.role, r.text) for r in cr.repair(spark.createDataFrame(rows, kind)).orderBy("at").collect()] == [("user", "Hello there."), ("assistant", "Yes.")]
    # All rows dropped by damage: zeros.
    turn = next(t for t in range(1_000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    gone = spark.createDataFrame([(5, turn, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert found_audit(gone) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# -- shards -----------------------------------------------------------------------


def check_shards(rows, texts, shards):
    assert all(r["size"] == len((t or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((t or "").encode()) for r, t in zip(rows, texts))
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_shards_hold_nearly_equal_bytes(spark):
    docs = spark.range(30_000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text again' ELSE repeat(md5(CAST(id AS string)), CAST(1 + id % 7 AS int)) END AS text",
        "IF(id % 2 = 0, 'hot', concat('s', id % 11)) AS source", "IF(id % 5 = 0, NULL, CAST(id % 7 AS double)) AS n", "id % 4 AS slot",
    )
    found = kd.shard(docs, metadata=("source", "n"), shards=24).toPandas()
    bytes_ = found.groupby("shard")["size"].sum()
    assert len(bytes_) == 24 and bytes_.max() < 1.03 * bytes_.mean() and bytes_.min() > 0.97 * bytes_.mean()
    numbered = found.groupby("shard").slot.agg(["min", "max", "count", "nunique"])
    assert (numbered["min"] == 0).all() and (numbered["max"] + 1 == numbered["count"]).all() and (numbered["count"] == numbered["nunique"]).all()
    # The hot text is cut; each other text, and each source that is small enough, lies in few shards.
    assert found[found.doc_id % 3 == 0].shard.nunique() > 1


def test_shards_keep_equal_texts_together(spark):
    docs = spark.range(4_000).selectExpr("id AS doc_id", "repeat(md5(CAST(id DIV 2 AS string)), 3) AS text", "concat('s', id % 9) AS source")
    found = kd.shard(docs, metadata=("source",), target_bytes=40_000).toPandas()
    assert found.shard.nunique() == round(4_000 * 104 / 40_000)
    assert found.groupby(found.doc_id // 2).shard.nunique().max() == 1


def test_shards_of_odd_rows(spark, odd, nothing, tmp_path):
    columns = odd.drop("text").columns
    found = kd.shard(odd, metadata=("lang", "score", "n_words"), shards=3)
    assert set(columns) <= set(found.columns) and found.count() == odd.count()
    texts = {(r.doc_id, r.lang): r.text for r in odd.collect()}
    rows = [r.asDict() for r in found.collect()]
    check_shards(rows, [texts[r["doc_id"], r["lang"]] for r in rows], 3)
    assert kd.shard(nothing, metadata=("lang",), shards=4).count() == 0
    assert {r.shard for r in kd.shard(odd, metadata=("lang",), shards=1).collect()} == {0}
    tree = kd.fit(kd.measured(odd, metadata=("lang", "n_words")), shards=3)
    kd.write(odd, str(tmp_path / "out"), tree, metadata=("lang", "n_words"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count() and set(odd.columns) <= set(back.columns)


def test_shards_run_no_python(spark):
    points = kd.measured(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    plan = kd.with_slots(kd.assign(points, kd.fit(points, 24)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
