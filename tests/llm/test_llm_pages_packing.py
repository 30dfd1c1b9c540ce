"""URL lists, page texts, packing and decontamination against plain Python and on odd rows."""

import collections
import datetime
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from llm_fixtures import prose
from pyspark.sql import functions as F

from gridwright.llm import decontamination as de
from gridwright.llm import html_text as ht
from gridwright.llm import packing as pk
from gridwright.llm import queries
from gridwright.llm import url_filters as uf

# -- URL lists --------------------------------------------------------------------


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def names(pattern, host, path):
    kind, _, rest = pattern.partition(":")
    if kind == "host":
        return host == rest
    if kind == "domain":
        return host == rest or host.endswith("." + rest)
    return host + path == rest or (host + path).startswith(rest.rstrip("/") + "/")


def test_lists_match_a_replay_of_the_log(spark):
    r = random.Random(4)
    patterns = ["host:a.b.org", "domain:b.org", "domain:org", "prefix:a.b.org/x", "prefix:a.b.org/x/y", "host:c.org", "host:zz.org"]
    entries = [(r.choice("pq"), r.choice(patterns), r.choice(["add", "remove"]), day(r.randint(0, 20))) for _ in range(60)]
    entries += [(None, "host:c.org", "add", day(1)), ("p", None, "add", day(1)), ("p", "host:c.org", None, day(1)), ("p", "host:c.org", "add", None)]
    urls = ["http://a.b.org/x/y/z?q#f", "https://A.B.org/xy", "http://u@c.org:80/", "http://d.org", "no url", "", None, "http://a.b.org/x"]
    captures = [(i, u, None if i % 11 == 0 else day(i % 23), "keep") for i, u in enumerate(urls * 30)]
    kind = "list string, pattern string, action string, day date"
    valid = uf.intervals(spark.createDataFrame(entries, kind))
    got = uf.evaluate(spark.createDataFrame(captures, "id int, url string, fetched date, pattern string"), valid)
    assert got.count() == len(captures)
    for c in got.collect():
        active = set()
        if c.url and c.fetched and "://" in c.url:
            rest = c.url.split("://")[1]
            host = rest.split("/")[0].split("@")[-1].split(":")[0].lower()
            path = ("/" + rest.partition("/")[2] if "/" in rest else "").split("?")[0].split("#")[0]
            for name in "pq":
                for p in patterns:
                    log = [e for e in entries if e[:2] == (name, p) and e[2] and e[3] and e[3] <= c.fetched]
                    if log and max(log, key=lambda e: (e[3], e[2]))[2] == "add" and names(p, host, path):
                        active.add((name, p))
        assert c.lists == ",".join(sorted({n for n, _ in active})) and c.blocked == bool(active)
        assert c.pattern == max((p for _, p in active), key=lambda p: (len(p), p), default="")


def test_empty_lists_and_tables(spark):
    none = spark.createDataFrame([], "list string, pattern string, action string, day date")
    captures = spark.createDataFrame([(1, "http://a.org/", day(1))], "id int, url string, fetched date")
    assert [tuple(x) for x in uf.evaluate(captures, uf.intervals(none)).select("id", "blocked", "lists", "pattern").collect()] == [(1, False, "", "")]
    assert uf.evaluate(captures.limit(0), uf.intervals(none)).count() == 0


# -- pages ------------------------------------------------------------------------

PAGES = {
    "<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One <b>two</b>\n three.<p>Four&nbsp;five</article><footer>f</footer>": "T & U\nOne two three.\nFour five",
    "<body><header><h1>Site</h1></header><main><header><h2>Title</h2></header><p>Text one.</p><ul><li>a<li>b</ul></main><aside>x</aside></body>": "Title\nText one.\na\nb",
    "<body><div class='cookie-notice'>We use cookies on this long and wordy page</div><div id=story><p>Short.</p><p>Second one.</p></div><div class=comments><p>Nice post, a long reader comment with words</p></div>": "Short.\nSecond one.",
    "<div class='sidebar'><p>other</p></div><div><p>Main text that is long enough to be the article.</p><form><p>Name</p><input></form><p>More of it.</p></div>": "Main text that is long enough to be the article.\nMore of it.",
    "<script>if (a < b) { x = '<p>no</p>' }</script><style>p{}</style><p>A<br>B<!-- c --> C</p>": "A B C",
    "<article><p>x &lt;b&gt; &#233; &amp;amp; &copy 2</p></article>": "x <b> é &amp; © 2",
    "<article><h1>H</h1><p>cut of": "H\ncut of", "<article><p>whole</p><p cla": "whole", "": "", "<html></html>": "", "plain text": "plain text",
    "<article><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table><pre> k \n l </pre><blockquote>q</blockquote></article>": "a b\nc\nk l\nq",
    "<article><p>keep</p><div class=ad>buy</div><p role='alert'>no</p><span class='share'>tweet</span>tail</article>": "keep\ntail",
    "<body class='has-sidebar'><div class='page no-sidebar'><div class='site-header'>Site</div><div class='article-header'><h1>T</h1></div><p>Body text.</p><section id=respond><p>Reply</p></section></div></body>": "T\nBody text.",
    "<body><div class=menu><a href=1>a</a></div><p><a href=2>Only a link</a></p></body>": "Only a link",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert ht.main_text(page) == PAGES[page]


def test_extract_on_odd_rows(spark, odd, nothing):
    pages = spark.createDataFrame([(1, None, "x", 5), (2, "<p>a</p>" * 20_000, "y", 6), (2, "<div>" * 5_000 + "deep", None, None)], "page_id long, html string, text string, n_chars int")
    got = ht.extract(pages).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 0), (2, 39_999), (2, 4)] and got[1].text == "\n".join("a" * 20_000)
    assert ht.extract(nothing, "text").count() == 0 and ht.extract(odd, "text", "body").count() == odd.count()


def test_page_densities():
    root = ht.parse("<body><div><a href=1>one</a> <a href=2>two</a></div><div><p>Plain words only here.</p></div></body>")
    plain, linked = sorted((x for x in ht.measure(root) if x.tag == "div"), key=lambda x: x.link_tags)
    assert (linked.chars, linked.tags, linked.link_chars, linked.link_tags) == (6, 2, 6, 2)
    assert (plain.chars, plain.tags, plain.link_chars) == (19, 1, 0) and plain.density > 5 * linked.density


LINK = re.compile(r"<a [^>]*>(.*?)</a>", re.DOTALL)


def letters(markup):
    return len("".join(re.sub(r"<[^>]*>", " ", markup).split()))


def plain_density(inner, page):
    """Composite text density of the markup inside one node, counted from the markup itself."""
    chars, tags, links = letters(inner), len(re.findall(r"<[a-z]", inner)), LINK.findall(inner)
    linked, shared = sum(map(letters, links)), sum(map(letters, LINK.findall(page))) / max(1, letters(page))
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - linked) * linked + shared * chars + math.e)
    ratio = chars / max(1, linked) * max(1, tags) / max(1, len(links))
    return chars / max(1, tags) * (math.log(ratio) / max(math.log(base), 1.0) if base > 1 and ratio > 1 else 1e-3)


def random_page(r, depth=0):
    """A nested list of pages' parts: texts, links and further nodes."""
    kinds = ["text", "link", "node", "node"] if depth < 4 else ["text", "link"]
    parts = []
    for _ in range(r.randint(1, 5)):
        kind = r.choice(kinds)
        words = " ".join("w" * r.randint(1, 9) for _ in range(r.choice([2, 5, 40])))
        parts.append(random_page(r, depth + 1) if kind == "node" else words if kind == "text" else f"<a href=x>{words}</a>")
    return parts


def markup(parts):
    return "".join(p if isinstance(p, str) else f"<div>{markup(p)}</div>" for p in parts)


@pytest.mark.parametrize("seed", range(40))
def test_densities_and_choice_equal_a_plain_recount(seed):
    page = random_page(random.Random(seed))
    whole = markup(page)
    root = ht.parse(whole)
    best, threshold = ht.article(root)
    pairs, rest = [], [(root, page, [])]
    while rest:
        node, parts, above = rest.pop()
        own = plain_density(markup(parts), whole)
        assert node.density == pytest.approx(own)
        inner = [p for p in parts if not isinstance(p, str)]
        pairs.append((sum(plain_density(markup(p), whole) for p in inner) or own, node, [*above, own]))
        nodes = [p for p in node.parts if isinstance(p, ht.Node)]
        rest += [(n, p, [*above, own]) for n, p in zip(nodes, inner, strict=True)]
    most, _, way = next(p for p in pairs if p[1] is best)
    assert most == pytest.approx(max(p[0] for p in pairs)) and threshold == pytest.approx(min(way))


STORY = "".join(f"<div>Sentence {i} of the story tells, in many plain words, what went on that day in the old town.</div>" for i in range(12))
TOPICS = "".join(f"<div><a href=/t/{i}>Topic {i}</a></div>" for i in range(30))


@pytest.mark.parametrize("page", [
    f"<body><div>{TOPICS}</div><div>{STORY}</div><div>{TOPICS}</div></body>",
    f"<body><table><tr><td>{TOPICS}<td><div>{STORY}</div></table></body>",
    f"<div><div>{TOPICS}</div><div><div>{STORY}</div></div></div>",
])
def test_pages_without_any_name(page):
    """No article, main, menu, class or id: only the densities tell the story from the lists of links."""
    assert ht.main_text(page).split("\n") == re.findall(r"Sentence [^<]*", page)


def test_several_articles_and_long_comments():
    """The densest article is the text; named comments never are, however long."""
    long = "<p>A reader's words that go on and on about something else.</p>" * 60
    short = "<article><p>Teaser.</p></article>"
    page = f"<main>{short}</main><div><article>{STORY}</article></div><div class=comments>{long}</div>"
    assert ht.main_text(page).split("\n") == re.findall(r"Sentence [^<]*", page)


@pytest.mark.parametrize("page", [
    "<ul><li>" * 50_000, "<div>" * 100_000, "<p hidden><b>" * 50_000, "<span hidden>" * 50_000 + "</span>" * 50_000, "<dl><dt>" * 50_000,
])
def test_time_is_linear_in_open_tags(page):
    start = time.perf_counter()
    ht.main_text(page[: len(page) // 10])
    tenth = time.perf_counter() - start
    ht.main_text(page + "end")
    assert time.perf_counter() - start < 40 * max(tenth, 0.05)


def test_given_pages(spark):
    import html

    for r in queries.op7(spark, "/root/testdata/sf0.001").join(
        spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id"
    ).collect():
        inner = re.sub(r"<[^>]*\Z", "", re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.DOTALL)[1]).replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# -- packing ----------------------------------------------------------------------


def fewest(lengths, room):
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= room and bins[k] not in bins[:k]:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def test_bin_completion_finds_the_fewest_bins():
    r = random.Random(11)
    for _ in range(150):
        lengths = [r.randint(1, 60) + r.choice([0, 40]) for _ in range(r.randint(1, 11))]
        number, _ = pk.pack_lengths(np.array(lengths), 100)
        assert number.max() + 1 == fewest(lengths, 100), lengths


def test_search_beats_best_fit():
    # Best fit decreasing needs 4 bins here.
    lengths = [44, 6, 24, 6, 8, 8, 25, 30, 24, 22, 10, 45, 8, 8, 32]
    kinds = sorted(set(lengths), reverse=True)
    counts = [lengths.count(x) for x in kinds]
    found = pk.complete(kinds, counts, 61)
    assert len(found) == fewest(lengths, 61) <= len(pk.best_fit(kinds, counts, 61))
    assert sorted(x for one in found for x in one) == sorted(lengths) and max(map(sum, found)) <= 61


def test_fillings_are_undominated():
    lengths = [9, 7, 4, 3, 2]
    found = pk.fillings(lengths, dict.fromkeys(lengths, 1), 10)
    assert (7, 3) in found and all(sum(f) <= 10 for f in found) and (4, 3) not in found and (9,) in found


def test_pieces_are_cut_and_packed_without_gaps(spark, odd, nothing):
    tokens = queries.public_tokens()
    got = [r.asDict() for r in pk.pack(odd.select("doc_id", "text"), queries.public_tokens, shard=9).collect()]
    by_text = {}
    for doc_id, text in odd.select("doc_id", "text").collect():
        ids = np.array([*tokens(text or ""), 0], "<u4")
        first = len(ids) % 2048 or min(2048, len(ids))
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            by_text.setdefault((doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())), []).append(1)
    keys = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got]
    assert sorted(keys, key=str) == sorted((k for k, n in by_text.items() for _ in n), key=str)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048
    assert pk.pack(nothing.select("doc_id", "text"), queries.public_tokens).count() == 0


def test_both_coders_agree():
    import public_tokenizers

    fast = queries.public_tokens()
    slow = pk.encoder(public_tokenizers.path(pk.MAIN))
    for text in ("", "a", "don't  stop\n\n x", "<|endoftext|> y", "naïve \U0001f600 – ü", prose(3, 200), " \t\r\n", "１２３ abc"):
        assert list(fast(text)) == list(slow(text))


def test_ids_come_as_one_buffer():
    """Not as a list of numbers, which is made and copied number by number."""
    import public_tokenizers

    fast, slow = queries.public_tokens(), pk.encoder(public_tokenizers.path(pk.MAIN))
    text = "naïve <|endoftext \U0001f600 plain words 12"
    assert isinstance(fast(text), np.ndarray) and fast(text).dtype.itemsize == 4
    assert fast(text).tolist() == list(slow(text))


def test_the_split_that_never_goes_back_finds_the_same_words():
    import public_tokenizers
    import regex

    assert public_tokenizers.PATTERN == pk.SPLIT
    fast, slow = queries.public_tokens(), pk.encoder(public_tokenizers.path(pk.MAIN))
    draw = random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choice(" \t\n\r\u00a0\u3000\x85'sStTrRevlmd1²٣aé.,!\U0001f600\u200d") for _ in range(draw.randrange(1, 30)))
        assert regex.findall(pk.SAME_SPLIT.replace("$", r"\Z"), text) == regex.findall(pk.SPLIT, text)
        assert list(fast(text)) == list(slow(text))


# -- decontamination --------------------------------------------------------------


def items(spark):
    rows = [(i, prose(100 + i, 20 + i), prose(200 + i, 3) if i % 2 else None) for i in range(40)]
    rows += [(90, None, None), (91, "", ""), (None, prose(140, 20), None), (92, prose(300, 150), None), (5, *rows[5][1:])]
    return rows, spark.createDataFrame(rows, "item_id long, question string, answer string")


def planted(rows):
    texts = [prose(i, 60) for i in range(20)]
    for i in (0, 7, 12, 39, 43):
        texts.append(f"{prose(i + 50, 70)} {rows[i][1]} {rows[i][2] or ''} {prose(i + 60, 40)}")
    texts.append(f"{prose(1, 30)} {rows[7][1]} {prose(2, 30)}")  # question without answer
    words = rows[12][1].split()
    texts.append(" ".join([*words[:2], "changed", *words[3:]]))
    texts.append(" ".join(words[: len(words) // 2]))
    return texts


def test_items_are_found_as_without_the_index(spark):
    rows, frame = items(spark)
    texts = planted(rows)
    got = de.mark(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), frame, "item_id", "question", "answer")
    for r in got.collect():
        words = de.words_of(r.text)
        expected = set()
        for name, q, a in rows:
            parts = [de.shingles(de.words_of(p)) for p in (q, a) if p and de.words_of(p)]
            inside = [
                len(p & {tuple(words[i : i + n]) for n in [len(next(iter(p)))] for i in range(len(words) - n + 1)}) >= 0.8 * len(p)
                for p in parts
            ]
            if name is not None and parts and all(inside):
                expected.add(name)
        assert r["items"] == sorted(expected), r.id
    assert sum(bool(r["items"]) for r in got.collect()) >= 5


def test_pruning_changes_nothing(spark):
    rows, _ = items(spark)
    index = de.build([r for r in rows if r[0] is not None])
    for text in planted(rows) + [prose(i, 500) + " " + rows[i % 40][1] for i in range(30)]:
        words = de.words_of(text)
        last = max(1, (len(words) - 1) // de.CHUNK)
        scored = set()
        for p in range(last):
            inside = set(words[p * de.CHUNK : (p + 2) * de.CHUNK if p < last - 1 else len(words)])
            for chunk in range(len(index.owner)):
                total = sum(
                    index.impacts[k] for w in inside if w in index.vocabulary
                    for k in range(index.starts[index.vocabulary[w]], index.starts[index.vocabulary[w] + 1]) if index.chunks[k] == chunk
                )
                if total >= de.RETRIEVE - 1e-9:
                    scored.add(int(index.owner[chunk]))
        assert de.retrieved(index, words) == sorted(scored)


def test_decontamination_on_odd_rows(spark, odd, nothing, monkeypatch):
    rows, frame = items(spark)
    options = dict(name="item_id", question="question", answer="answer")
    assert de.clean(odd, frame, **options).columns == odd.columns
    assert de.clean(odd, frame, **options).count() == odd.count() and de.clean(nothing, frame, **options).count() == 0
    assert de.mark(odd, frame.limit(0), **options).where(F.size("items") > 0).count() == 0
    docs = spark.createDataFrame(list(enumerate(planted(rows))), "id int, text string")
    whole = de.mark(docs, frame, **options).collect()
    monkeypatch.setattr(de, "INDEX_ITEMS", 7)
    assert de.mark(docs, frame, **options).collect() == whole


def test_given_documents_against_substrings(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    held = set(duckdb.sql(f"SELECT doc_id, item_id FROM '{folder}/documents.parquet' d, '{folder}/benchmark.parquet' b WHERE contains(d.text, b.text)").fetchall())
    got = {(r.doc_id, i) for r in queries.op10(spark, folder).collect() for i in r.item_ids}
    assert held <= got and len(got - held) <= 5


@pytest.mark.parametrize("copies, bins", [(10, 14), (2_499, 3_332), (6_247, 8_330)])
def test_search_places_many_equal_bins_at_once(copies, bins):
    """Three of the lengths fill a bin, the fourth goes three to a bin; best fit needs a fifth more."""
    kinds = [1032, 528, 520, 496]
    found = pk.complete(kinds, [copies] * 4, 2048)
    assert len(found) == bins < len(pk.best_fit(kinds, [copies] * 4, 2048)) and max(map(sum, found)) <= 2048
    assert collections.Counter(x for one in found for x in one) == dict.fromkeys(kinds, copies)
