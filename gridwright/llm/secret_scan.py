"""Secrets in texts: three plain patterns, and values in a credential's place that are costly to guess.

The cost of a value is the least number of guesses over all ways to cut it into familiar words, dates,
repeats, keyboard walks and spans that must be tried character by character. Costs multiply, so the
search adds logarithms along the value, from left to right. Words cost what their rank says, among a few
frequent choices and then the words of the corpus. Paths, dotted names, calls and templates made of words
are one piece each, as they name a value and are not one.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Mapping
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.storage import staged
from gridwright.llm.common import mapped, quoted, spare, text_of

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A name that a credential goes by, a sign, and the value that may be one.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|(?:access|private|signing)[_-]?key|credentials?|authorization)"""
    r"""["']?\s{0,8}(?::=|=>|[:=])\s{0,8}(?:bearer\s|basic\s)?["']?([^\s"'<>,;]{6,})""",
    re.ASCII | re.IGNORECASE,
)
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "authorization")

#: Guesses, as a power of ten, from which a value counts as a secret.
LEAST_COST = 10.0
#: Frequent choices, most frequent first, and rows of keys.
FAMILIAR = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login princess solo passw0rd starwars "
    "football iloveyou sunshine shadow superman michael ashley bailey charlie donald hello freedom whatever trust "
    "secret changeme default example test testing user root guest token key api value null none true false your my "
    "the here insert replace placeholder sample demo dummy temp foo bar baz string name pass word access private "
    "public server client prod dev staging local database service account bearer basic auth enter todo redacted"
).split()
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
RANK = {word: i + 1 for i, word in enumerate(FAMILIAR)}
#: Words of the corpus that are ranked, most frequent first, and their lengths. Others cost by their length.
RANKED_WORDS, SHORTEST, LONGEST = 20_000, 3, 24
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")
LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NEXT_KEY = {a + b for row in KEY_ROWS for way in (row, row[::-1]) for a, b in zip(way, way[1:])}
FREE_WORD = rf"""(?<![^\s("'])[A-Za-z][a-z]{{{SHORTEST - 1},{LONGEST - 1}}}(?![^\s.,;:!?"')])"""
TEN, TWO = 1.0, math.log10(2)
#: A path, an address, a dotted name, a call, a look-up or a template, and a character that sets it apart from a word.
NAMED = r"[A-Za-z_][\w-]*"
REFERENCE = re.compile(
    rf"(?:\$\{{?|\{{\{{?|%\(|[a-z][a-z0-9+]*://|~?\.{{0,2}}/\.?|[A-Za-z]:\\)?{NAMED}(?:(?:\.|::|->|/\.?|\\){NAMED})*"
    r"(?:[(\[{][\w.,(){}\[\]:=*/-]*|[)}]+s?)?",
    re.ASCII,
)
REFERENCE_MARK = re.compile(r"[./\\(\[{$%]|::|->")
SEGMENT, VOWEL = re.compile(r"[A-Za-z]+|[0-9]+"), re.compile("[aeiouy]")
#: Least mean length of the words of a segment; letters of a short name that needs no vowel; digits of a name;
#: consonants in a row that a name may have, and a single unknown word; letters from which such a word costs more.
WORD_MEAN, SHORT_NAME, NAME_DIGITS, NAME_RUN, WORD_RUN, LONG_WORD = 3, 5, 4, 5, 3, 12
#: Signs that join words, and the cost of one.
JOINTS, JOINT_COST = "_-./:", 0.5


NO_RANKS: Mapping[str, int] = {}


def word_ranks(df: DataFrame, text: str = "text", words: int = RANKED_WORDS) -> dict[str, int]:
    """The most frequent ``words`` words of all texts with their ranks, after those of the fixed list.

    Words stand free in the text, have 3 to 24 letters a-z, small but for the first, and count without regard to
    case; values in a credential's place do not count, or a secret would make itself familiar. Equally frequent
    words get ranks in their order, and all of them are left out where they would not fit whole. Counted over all
    rows with partial counts; the driver gets at most ``words`` counts and ``words`` short words.
    """
    plain = F.regexp_replace(text_of(text), F.lit("(?i)" + CONTEXT.pattern), F.lit(" "))
    words_of = F.regexp_extract_all(plain, F.lit(FREE_WORD), F.lit(0))
    counts = df.select(F.explode(words_of).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    counts = staged(counts)
    # Far fewer counts than words exist, so these rows are few before the driver asks for the largest.
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(words).collect()
    within = [r["n"] for r, total in zip(sizes, accumulate(r["words"] for r in sizes)) if total <= words]
    if not within:
        return {}
    top = sorted(counts.where(F.col("n") >= within[-1]).collect(), key=lambda r: (-r["n"], r["w"]))
    return {r["w"]: len(FAMILIAR) + i + 1 for i, r in enumerate(top)}


def _spoken(word: str, run: int) -> bool:
    """Whether a run of letters has a vowel and at most ``run`` consonants in a row."""
    return bool(VOWEL.search(word)) and max(map(len, VOWEL.split(word))) <= run


def _wordlike(letters: str) -> bool:
    """Whether a run of letters reads as words in one of the usual ways to join them."""
    words = [w.lower() for w in LETTERS.findall(letters)]
    if len(letters) <= SHORT_NAME and len(words) == 1:
        return True
    return len(letters) >= WORD_MEAN * len(words) and all(len(w) <= SHORT_NAME - 2 or _spoken(w, NAME_RUN) for w in words)


def _unknown_word_cost(word: str) -> float:
    """log10 of the guesses for a word of one case that has no rank: a language has fewer of them than letter strings."""
    return 2.0 + 0.45 * min(len(word), LONG_WORD) + TEN * max(0, len(word) - LONG_WORD)


def reference_cost(value: str) -> float | None:
    """log10 of the guesses for a value that only names another, such as a path or a call; None if it does not."""
    if not REFERENCE_MARK.search(value) or not REFERENCE.fullmatch(value):
        return None
    parts = SEGMENT.findall(value)
    if sum(len(p) for p in parts if p.isdigit()) > NAME_DIGITS or not all(p.isdigit() or _wordlike(p) for p in parts):
        return None
    return 3.0 + 0.5 * len(parts)


def _pieces(value: str, ranks: Mapping[str, int] = NO_RANKS) -> dict[int, list[tuple[int, float]]]:
    """Familiar pieces by where they end: (start, log10 of the guesses for the piece)."""
    ends: dict[int, list[tuple[int, float]]] = {}
    low, n = value.lower(), len(value)

    def add(start: int, end: int, cost: float) -> None:
        ends.setdefault(end, []).append((start, cost))

    for i in range(n):
        for j in range(i + SHORTEST, min(n, i + LONGEST) + 1):
            word = low[i:j]
            if rank := RANK.get(word) or ranks.get(word):
                add(i, j, math.log10(rank + 1) + (0 if value[i:j] == low[i:j] else TWO))
    for found in LETTERS.finditer(value):
        if len(found[0]) < SHORTEST or _spoken(found[0].lower(), WORD_RUN):
            add(*found.span(), _unknown_word_cost(found[0]))
    for i in range(n):
        if value[i] in JOINTS:
            add(i, i + 1, JOINT_COST)
    if (cost := reference_cost(value)) is not None:
        add(0, n, cost)
    for pattern, cost in ((DATE, 4.6), (YEAR, 2.1)):
        for found in pattern.finditer(value):
            add(*found.span(), cost)
    i = 0
    while i < n - 1:  # keyboard walks and alphabet runs; every end of a run from its start
        j = i + 1
        while j < n and low[j - 1 : j + 1] in NEXT_KEY:
            j += 1
            if j - i >= 3:
                add(i, j, 1.5 + math.log10(j - i))
        i = max(i + 1, j - 1)
    for width in (1, 2, 3, 4):  # repeats of a short unit
        i = 0
        while i + 2 * width <= n:
            j = i + width
            while value[j : j + width] == value[i : i + width]:
                j += width
            if j - i >= max(3, 2 * width):
                add(i, j, width * TEN + math.log10((j - i) // width))
                i = j - width + 1
            else:
                i += 1
    return ends


def guess_cost(value: str, ranks: Mapping[str, int] = NO_RANKS) -> float:
    """log10 of the least guesses for ``value``; 0 for an empty one.

    Each character tried for itself costs a factor of ten, each further piece a factor of two. ``ranks`` are those
    of :func:`word_ranks`.
    """
    ends, best, brute = _pieces(value, ranks), [0.0], [False]
    for j in range(1, len(value) + 1):
        cost, tried = best[j - 1] + TEN + (0 if brute[j - 1] or j == 1 else TWO), True
        for start, own in ends.get(j, ()):
            whole = best[start] + own + (TWO if start else 0)
            if whole < cost:
                cost, tried = whole, False
        best.append(cost)
        brute.append(tried)
    return best[-1]


def scored_values(text: str, ranks: Mapping[str, int] = NO_RANKS) -> list[tuple[int, int, float]]:
    """(start, end, log10 of the guesses) of every value in a credential's place, in code points, by start."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    return [(*m.span(1), guess_cost(m[1], ranks)) for m in CONTEXT.finditer(text)]


def secret_spans(
    text: str, least_cost: float = LEAST_COST, ranks: Mapping[str, int] = NO_RANKS,
    values: list[tuple[int, int, float]] | None = None,
) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind; no other span holds a ``guess`` span whole.

    ``assign`` spans hold name, sign and value; a ``guess`` span holds the value alone. ``values`` are those of
    :func:`scored_values`, if they are known.
    """
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    base = sorted(found)
    ends = list(accumulate((e for _, e, _ in base), max))
    for a, b, cost in scored_values(text, ranks) if values is None else values:
        # A value that a plain pattern holds in part alone counts as a whole.
        before = bisect_right(base, a, key=lambda s: s[0])
        if cost >= least_cost and not (before and ends[before - 1] >= b):
            found.append((a, b, "guess"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


RESULT = pa.struct(
    [(n, pa.int64()) for n in ("n_assign", "n_access", "n_hex", "n_guess")]
    + [("base_sha256", pa.string()), ("spans", pa.string()), ("costs", pa.string())]
)


def scan(
    df: DataFrame, text: str = "text", least_cost: float = LEAST_COST, ranks: Mapping[str, int] = NO_RANKS
) -> DataFrame:
    """``df`` with the counts by kind, a digest of the plain patterns' spans, all spans, and the scored values.

    ``costs`` lists every value in a credential's place as ``start:end:log10 of the guesses``, also those that a
    plain pattern holds. A null text counts as empty: no spans. Values of equal start cannot occur; repeated rows
    are judged alike. Columns of these names are replaced, all others stay. One pass without a shuffle; each row is
    judged by its own whole text, in time that grows with its length.
    """
    kinds = "struct<n_assign:long,n_access:long,n_hex:long,n_guess:long,base_sha256:string,spans:string,costs:string>"

    @F.arrow_udf(kinds)
    def found(texts: pa.Array) -> pa.Array:
        def row(value: str) -> dict:
            values = scored_values(value, ranks)
            spans = secret_spans(value, least_cost, ranks, values)
            base = listed([s for s in spans if s[2] != "guess"])
            counts = {f"n_{k}": sum(s[2] == k for s in spans) for k in KINDS}
            costs = ",".join(f"{a}:{b}:{cost:.1f}" for a, b, cost in values)
            digest = hashlib.sha256(base.encode()).hexdigest()
            return counts | {"base_sha256": digest, "spans": listed(spans), "costs": costs}

        return mapped(texts, row, RESULT)

    name = spare(df, "found_secrets")
    with_found = df.withColumn(name, found(text_of(text)))
    return with_found.withColumns({f.name: F.col(name)[f.name] for f in RESULT}).drop(name)


def masked(value: str, mark: str, least_cost: float = LEAST_COST, ranks: Mapping[str, int] = NO_RANKS) -> str:
    """``value`` with each secret replaced by ``mark``; overlapping spans by one."""
    parts, at = [], 0
    for start, end, kind in secret_spans(value, least_cost, ranks):
        if start >= at:
            parts += [value[at:start], mark]
        at = max(at, end)
    return "".join(parts) + value[at:] if parts else value


def mask(
    df: DataFrame, text: str = "text", mark: str = "[secret]", least_cost: float = LEAST_COST,
    ranks: Mapping[str, int] = NO_RANKS,
) -> DataFrame:
    """``df`` with the secrets in ``text`` masked; a null text stays null."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return mapped(texts, lambda t: None if t is None else masked(t, mark, least_cost, ranks), pa.string())

    return df.withColumn(text, clean(quoted(text)))
