"""The text operators over whole tables: ``name: (function, SQL or None)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions.storage import staged
from gridwright.llm import (
    conversation_repair, decontamination, html_text, kd_sharding, near_dedup, packing, quality_classifier, quality_rules, secret_scan,
    spelling_variants, substring_dedup, suffix_dedup, url_filters,
)
from gridwright.llm.common import table
from gridwright.llm.variant_sql import VARIANT_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}
#: Score from which a text counts as good.
GOOD = 0.3


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = (function, sql)
        return function

    return add


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fitted_classifier(docs: DataFrame, labels: DataFrame) -> quality_classifier.CompressionClassifier:
    """Learned from the labelled rows that are not held out."""
    return quality_classifier.fit(docs, labels.where(~held_out()))


@query("op1_quality_classifier")
def op1(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fitted_classifier(docs, table(spark, folder, "labels"))
    return quality_classifier.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


@query("op3_quality_rules")
def op3(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    ratios = quality_rules.log_ratios_within(quality_rules.marked_texts(docs, good))
    return quality_rules.rules(docs, ratios).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio"
    )


@query("op5_secret_scan")
def op5(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return secret_scan.scan(docs, ranks=secret_scan.word_ranks(docs)).drop("text")


def public_tokens():
    """The text-to-ids function of the public byte-level vocabulary; called inside a task."""
    import public_tokenizers

    return packing.encoder(public_tokenizers.path(packing.MAIN), public_tokenizers.path(packing.RANKS))


@query("op6_best_fit_packing")
def op6(spark, folder):
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"), public_tokens)


# A capture's fetch day and the lists' entries follow from digests of URL and host, alike in Spark and in SQL.
LISTS = ("adult", "malware", "optout", "spam")


def digest_number(text: str, salt: str):
    return F.conv(F.substring(F.md5(F.concat(F.expr(text), F.lit(salt))), 1, 6), 16, 10).cast("bigint")


def capture_days(pages: DataFrame) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (digest_number("url", "#day") % 720).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Up to three dated entries for patterns of a share of the hosts: added, removed, added again."""
    host = url_filters.host_of(F.col("url"))
    hosts = pages.select(host.alias("host")).where("host <> ''").distinct()
    named = hosts.select(
        "host", F.concat(F.lit("host:"), "host").alias("pattern"), F.lit("#h").alias("salt")
    ).unionAll(
        hosts.select(F.expr("substring(host, instr(host, '.') + 1)").alias("host")).where("host LIKE '%.%'").distinct()
        .select("host", F.concat(F.lit("domain:"), "host").alias("pattern"), F.lit("#d").alias("salt"))
    ).unionAll(hosts.select("host", F.concat(F.lit("prefix:"), "host", F.lit("/en")).alias("pattern"), F.lit("#p").alias("salt")))
    rolled = named.select(
        "pattern", digest_number("pattern", "#list").alias("a"), digest_number("pattern", "#from").alias("b"),
        digest_number("pattern", "#span").alias("c"),
    ).where("a % 3 = 0")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("b") % 500).cast("int"))
    listed = F.element_at(F.array(*map(F.lit, LISTS)), ((F.col("a") / 3).cast("bigint") % 4 + 1).cast("int"))
    steps = F.array(
        F.struct(F.lit("add").alias("action"), start.alias("day")),
        F.struct(F.lit("remove").alias("action"), F.date_add(start, (F.col("c") % 200).cast("int")).alias("day")),
        F.struct(F.lit("add").alias("action"), F.date_add(start, (200 + F.col("c") % 90).cast("int")).alias("day")),
    )
    return rolled.select(listed.alias("list"), "pattern", F.inline(F.slice(steps, 1, (F.col("c") % 3 + 1).cast("int"))))


NUMBER = "('0x' || substr(md5({0} || '{1}'), 1, 6))::BIGINT".format
HOST = r"regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"
FILTER_SQL = rf"""WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + ({NUMBER('url', '#day')} % 720)::INT AS fetched, {HOST} AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host <> ''),
named AS (SELECT 'host:' || host AS pattern FROM hosts
  UNION ALL SELECT DISTINCT 'domain:' || substr(host, instr(host, '.') + 1) FROM hosts WHERE substr(host, instr(host, '.') + 1) LIKE '%.%'
  UNION ALL SELECT 'prefix:' || host || '/en' FROM hosts),
rolled AS (SELECT * FROM (SELECT pattern, {NUMBER('pattern', '#list')} AS a, {NUMBER('pattern', '#from')} AS b,
  {NUMBER('pattern', '#span')} AS c FROM named) WHERE a % 3 = 0),
entries AS (SELECT {list(LISTS)}[(a // 3) % 4 + 1] AS list, pattern, step, c,
  DATE '2024-01-01' + (b % 500)::INT + CASE step WHEN 0 THEN 0 WHEN 1 THEN (c % 200)::INT ELSE (200 + c % 90)::INT END AS day
  FROM rolled, (VALUES (0), (1), (2)) AS s(step) WHERE step <= c % 3),
daily AS (SELECT list, pattern, day, max(step % 2) = 0 AS live FROM entries GROUP BY ALL),
valid AS (SELECT * FROM (SELECT list, pattern, live, day AS since, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS until FROM daily) WHERE live),
hits AS (SELECT page_id, url, fetched, list, pattern FROM captures JOIN valid ON fetched >= since AND (until IS NULL OR fetched < until)
  AND (pattern = 'host:' || host
    OR (pattern LIKE 'domain:%' AND (host = substr(pattern, 8) OR ends_with(host, '.' || substr(pattern, 8))))
    OR (pattern LIKE 'prefix:%' AND (host || path = substr(pattern, 8) OR starts_with(host || path, substr(pattern, 8) || '/'))))),
found AS (SELECT url, fetched, array_to_string(list_sort(list_distinct(array_agg(list))), ',') AS lists,
  arg_max(pattern, (length(pattern), pattern)) AS pattern FROM hits GROUP BY ALL)
SELECT page_id, url, CAST(fetched AS VARCHAR) AS fetched, found.lists IS NOT NULL AS blocked, coalesce(found.lists, '') AS lists,
  coalesce(found.pattern, '') AS pattern FROM captures LEFT JOIN found USING (url, fetched)"""


@query("op2_url_filters", FILTER_SQL)
def op2(spark, folder):
    pages = table(spark, folder, "pages")
    valid = url_filters.intervals(list_entries(pages))
    found = url_filters.evaluate(capture_days(pages), valid)
    return found.select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "blocked", "lists", "pattern")


@query("op7_html_extraction")
def op7(spark, folder):
    found = html_text.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


def test_items(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items: the last sentence is the answer, what stands before it the question."""
    text = F.rtrim(F.coalesce("text", F.lit("")))
    answer = F.regexp_extract(F.col("t"), r"(?s)[.!?\n]\s*([^.!?\n]*[.!?]*)$", 1)
    question = F.when(F.length(answer) > 0, F.expr("left(t, length(t) - length(answer))")).otherwise(F.col("t"))
    return (
        table(spark, folder, "benchmark").select("item_id", text.alias("t")).withColumn("answer", answer.cast("string"))
        .select("item_id", question.alias("question"), "answer")
    )


@query("op10_benchmark_decontamination")
def op10(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = decontamination.mark(docs, test_items(spark, folder), "item_id", "question", "answer")
    return marked.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.col("items").alias("item_ids"))


@query("op8_suffix_dedup")
def op8(spark, folder):
    # Only what the result needs of a row travels: its id, not its text.
    return suffix_dedup.remove(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query("op4_minhash_near_dedup")
def op4(spark, folder):
    found = near_dedup.label(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


@query("op9_substring_dedup")
def op9(spark, folder):
    return substring_dedup.mark(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query("op11_spelling_variants", VARIANT_SQL)
def op11(spark, folder):
    words = spelling_variants.corpus_words(table(spark, folder, "documents").select("doc_id", "text"))
    return spelling_variants.forms(words).select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_conversation_repair")
def op12(spark, folder):
    said = conversation_repair.filled(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    rows = staged(conversation_repair.ordered(conversation_repair.damaged(said)))
    return conversation_repair.audit(said, rows)


#: The shards of the query.
SHARDS = 24


@query("op13_kd_sharding")
def op13(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    dealt = kd_sharding.shard(docs, shards=SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
