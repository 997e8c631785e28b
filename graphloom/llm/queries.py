"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import bpe_round_trip
from graphloom.llm.common import TOKEN, words_of, written
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.langid import predict as predict_langid
from graphloom.llm.langid import sample as sample_langid
from graphloom.llm.langid import train as train_langid
from graphloom.llm.license_scan import license_scan
from graphloom.llm.line_dedup import line_dedup
from graphloom.llm.periodic_runs import periodic_runs
from graphloom.llm.quality import quality
from graphloom.llm.simhash import simhash_groups
from graphloom.llm.sketch import containment, following, likeness, sketched, spelled
from graphloom.llm.token_align import align, summed
from graphloom.llm.token_store import token_digests, write_tokens
from graphloom.llm.toxicity import toxicity
from graphloom.llm.url_filter import host_of, url_filter
from graphloom.scratch import place

#: (verdict, host, path) of the rules that op2 applies.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: A title with words that end in runs of the same sign is that of a junk page; its URL goes on the list of blocked ones.
JUNK_TITLE = r"<title>[^<]*(\*{3}|%{3}|#{3}|\${3})"
#: Words of a host, between dots and hyphens, that put its pages on the list of blocked URLs.
SPAM_HOST_WORDS = "(^|[.-])(casino|poker|bets|betting|pills|viagra|porn|spam|adserver|ads|track|tracker)([.-]|$)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that 10-word windows of benchmark items hit."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first; then URLs are blocked that are another spelling of a junk page's or of one on a spam host."""
    pages = _table(spark, sf_dir, "pages")
    bad = F.coalesce(host_of(F.col("url")).rlike(SPAM_HOST_WORDS) | F.coalesce("html", F.lit("")).rlike(JUNK_TITLE), F.lit(False))
    return url_filter(pages.select("page_id", "url"), URL_RULES, pages.where(bad).select("url")).drop("url")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license rules over each document."""
    out = license_scan(_table(spark, sf_dir, "documents"))
    starts = F.col("base_starts")
    return out.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines repeated across documents go; what stays, as a digest."""
    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as compressed byte planes and read back."""
    path = place(spark, "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, path)
    return token_digests(spark, path)


def _remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % of


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from three of four folds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    train_on = F.coalesce(_remainder(4) != 2, F.lit(False))
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    model = train_langid(sample_langid(docs, train_on))
    return predict_langid(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from two of three folds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    train_on = F.coalesce(_remainder(3) != 1, F.lit(False))
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    out = toxicity(docs, _table(spark, sf_dir, "labels"), train_on, texts=False)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document by rank merges, and the bytes they decode to, as digests."""
    docs = _table(spark, sf_dir, "documents")
    out = bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    out = simhash_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document, the base rules and the adaptive verdict."""
    return quality(_table(spark, sf_dir, "documents")).drop("lang", "source")


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers, with each link's count over all documents."""
    docs = _table(spark, sf_dir, "documents")
    aligned = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    return summed(written(aligned.drop("groups"), "aligned"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each document and of itself with its last quarter taken from the next one, and how alike they are."""
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = following(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("edited", edited)
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited_sha256": F.sha2("edited", 256)})
    out = sketched(rows, {"text": "own", "edited": "near", "next_text": "next"})
    own, near, next_ = F.col("own"), F.col("near"), F.col("next")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", spelled(own).alias("fingerprint"), spelled(near).alias("edited_fingerprint"), likeness(own, near).alias("near_edited"),
        likeness(own, next_).alias("near_next"), containment(own, near).alias("in_edited"), containment(own, next_).alias("in_next"),
    )


def _with_cycles(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the rows repeats some of its words to the end: from word a on, the p words there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    cycle = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), times)), 1, n - a)
    chosen = docs.withColumn("words", F.when(h % 10 == 0, words_of(F.col("text"), TOKEN)))
    return chosen.select("doc_id", F.when(n > 0, F.array_join(F.concat(F.slice("words", 1, a), cycle), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in each document, the most often repeated one, and digests of all runs and of the text without repetitions."""
    out = periodic_runs(_with_cycles(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", none, lambda best, r: F.when(more(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    rows = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_url_filter": op2_url_filter,
    "op3_license_scan": op3_license_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_store": op5_token_store,
    "op6_langid": op6_langid,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_token_align": op11_token_align,
    "op12_fingerprints": op12_fingerprints,
    "op13_periodic_runs": op13_periodic_runs,
}

_SPACE = r"[\x20\x09-\x0D]"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        pieces AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i : i + least(len(w), 10) - 1] AS piece
                   FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i) WHERE len(w) > 0),
        spots AS (SELECT doc_id, n, i, w[i : i + n - 1] AS piece
                  FROM d, (SELECT DISTINCT n FROM pieces), LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i)),
        hits AS (SELECT doc_id, item_id, i, s.n FROM spots s JOIN pieces p USING (n, piece)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                  FROM hits, LATERAL (SELECT unnest(generate_series(i, i + n - 1)) AS p) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op2_url_filter": r"""
        WITH p AS (
            SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html
            FROM pages),
        parts AS (
            SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':\d*$', ''), '^(www|m)\.', '')
                   || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') AS stem,
                   list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
                       lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=&]*|ref|fbclid|gclid|session|sid)(=|$)'))) AS q
            FROM p),
        c AS (SELECT *, CASE WHEN contains(url, '://') THEN stem || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical_url FROM parts),
        rules(rule, verdict, h, d) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
                                              ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
        judged AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled
                   FROM c JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, d) GROUP BY page_id),
        listed AS (SELECT DISTINCT canonical_url FROM c WHERE regexp_matches(host, '@SPAM@') OR regexp_matches(html, '@JUNK@'))
        SELECT page_id, host, path, rule, canonical_url,
               coalesce(ruled, CASE WHEN canonical_url IN (FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
        FROM c LEFT JOIN judged USING (page_id)""".replace("@SPAM@", SPAM_HOST_WORDS).replace("@JUNK@", JUNK_TITLE),
    "op4_line_dedup": rf"""
        WITH lines AS (
            SELECT doc_id, u.pos, u.line,
                   {_LOWER.format(rf"regexp_replace(regexp_replace(u.line, '^{_SPACE}+', ''), '{_SPACE}+$', '')")} AS key
            FROM documents, LATERAL (
                SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) u),
        bad AS (
            SELECT key, max(doc_id) AS keep FROM lines WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (
            SELECT l.doc_id, l.pos, l.line, b.key IS NOT NULL AND l.doc_id <> b.keep AS gone
            FROM lines l LEFT JOIN bad b ON l.key = b.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op10_quality": r"""
        WITH d AS (
            SELECT doc_id, lang, source, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents),
        spots AS (SELECT doc_id, i, w[i : i + 2] AS piece FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 2)) AS i)),
        often AS (SELECT doc_id, i FROM spots QUALIFY count(*) OVER (PARTITION BY doc_id, piece) > 1),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM often, LATERAL (SELECT unnest(generate_series(i, i + 2)) AS p) GROUP BY doc_id),
        counted AS (
            SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                   coalesce(n, 0) AS n_repeat_words
            FROM d LEFT JOIN covered USING (doc_id)),
        long AS (
            SELECT doc_id, lang, source, u.feature, u.x, u.least, u.low
            FROM counted, LATERAL (VALUES
                ('mean', word_chars / nullif(n_words, 0), 1.0, true), ('symbol', n_symbols / nullif(word_chars, 0), 0.02, false),
                ('dup', n_dup_lines / nullif(n_words, 0), 0.05, false), ('repeat', n_repeat_words / nullif(n_words, 0), 0.1, false)
            ) u(feature, x, least, low) WHERE u.x IS NOT NULL),
        levels AS (
            SELECT 0 AS level, lang, source, feature, x, least, low FROM long UNION ALL
            SELECT 1, lang, NULL, feature, x, least, low FROM long UNION ALL
            SELECT 2, NULL, NULL, feature, x, least, low FROM long),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY level, lang, source, feature ORDER BY x) AS r,
                   count(*) OVER (PARTITION BY level, lang, source, feature) AS n
            FROM levels),
        ends AS (
            SELECT level, lang, source, feature, any_value(least)::DOUBLE AS least, any_value(low) AS low,
                   max(x) FILTER (r = ceil(n * 0.25)) AS q1, max(x) FILTER (r = ceil(n * 0.75)) AS q3
            FROM ranked GROUP BY ALL),
        sized AS (
            SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY lang, source) >= 20 THEN 0 WHEN count(*) OVER (PARTITION BY lang) >= 20 THEN 1 ELSE 2 END AS at
            FROM counted),
        outside AS (
            SELECT DISTINCT l.doc_id FROM long l JOIN sized s ON l.doc_id = s.doc_id JOIN ends e
            ON e.level = s.at AND l.feature = e.feature AND (e.level = 2 OR l.lang IS NOT DISTINCT FROM e.lang)
               AND (e.level > 0 OR l.source IS NOT DISTINCT FROM e.source)
            WHERE x > q3 + greatest(q3 - q1, e.least) * 3 OR (e.low AND x < q1 - greatest(q3 - q1, e.least) * 3))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND o.doc_id IS NULL AS kept
        FROM counted LEFT JOIN outside o USING (doc_id)""",
}
