"""Quality rules with thresholds that follow each language and source.

Counts of each text are made inside its row by array functions. Mergeable quantile
sketches (``approx_percentile``, partial sketches merged after the shuffle) give the
quartiles of each feature for each (lang, source), which replace fixed cutoffs: a
document goes if a feature lies further outside the quartiles of its own group than
``reach`` times their distance. A group of under ``MIN_GROUP`` documents has no quartiles
to speak of: those of its language count, or else those of all documents. Features are written once, to the shared folder, so
texts are read a single time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import TOKEN, words_of, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REACH = 3.0
#: Documents from which a group's own quartiles count.
MIN_GROUP = 20
#: Sketches keep this many points, an error in rank of 1 / ACCURACY.
ACCURACY = 10_000
#: Groups whose thresholds are broadcast at most; more of them are joined by a shuffle.
BROADCAST_GROUPS = 50_000
#: Name: (least distance between quartiles that counts, is high bad, is low bad).
FEATURES = {
    "mean_chars": (1.0, True, True),
    "symbol_share": (0.02, True, False),
    "dup_line_share": (0.05, True, False),
    "repeat_share": (0.1, True, False),
}
_BITS = 24  # of a packed window that hold its place


def _repeat_words(words: str, at_windows: str) -> Column:
    """Words covered by 3-word windows that stand twice or more in ``words``.

    ``at_windows`` has each window's hash (high bits) and place (low bits) packed in a
    sorted array of longs; neighbours with equal high bits are candidates. Candidates
    are compared by their full hash, and each repeated window adds the words up to the
    next one, three at most.
    """
    high = lambda i: F.shiftright(F.get(at_windows, i), _BITS)
    near = F.filter(at_windows, lambda x, i: (F.shiftright(x, _BITS) == high(i - 1)) | (F.shiftright(x, _BITS) == high(i + 1)))
    place = lambda x: x.bitwiseAND((1 << _BITS) - 1).cast("int")
    return F.transform(near, lambda x: F.struct(_window(words, place(x)).alias("h"), place(x).alias("i")))


def _window(words: str, i: Column) -> Column:
    return F.xxhash64(*(F.get(words, i + k) for k in range(3)))


def _covered(places: str) -> Column:
    """Words that 3-word windows at these sorted places cover."""
    nexts = F.transform(places, lambda p, j: F.least(F.coalesce(F.get(places, j + 1) - p, F.lit(3)), F.lit(3)))
    return F.aggregate(nexts, F.lit(0).cast("long"), lambda a, x: a + x)


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words).

    A null text counts as an empty one. Words are what ASCII white space parts.
    Windows are compared by 64-bit hashes. Texts of over 2^24 words have their windows
    compared without the packed shortcut.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(TOKEN))
    base = docs.select("doc_id", "lang", "source", text.alias("text"), words_of(F.col("text"), TOKEN).alias("words"), lines.alias("lines"))
    last = F.size("words") - 3
    packed = F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftleft(_window("words", i), _BITS).bitwiseOR(i.cast("long")))
    small = (last >= 1) & (last < (1 << _BITS))
    one = base.select(
        "doc_id", "lang", "source", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(small, F.sort_array(packed)).alias("packed"),
    )
    huge = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(_window("words", i).alias("h"), i.alias("i")))
    candidates = F.when(F.col("packed").isNotNull(), _repeat_words("words", "packed")).when(last >= 1, huge)
    two = one.withColumn("near", F.sort_array(candidates)).drop("words", "packed")
    twin = lambda x, k: x["h"] == F.get("near", k)["h"]
    three = two.withColumn("near", F.filter("near", lambda x, k: F.coalesce(twin(x, k - 1), F.lit(False)) | F.coalesce(twin(x, k + 1), F.lit(False))))
    four = three.withColumn("places", F.sort_array(F.transform("near", lambda x: x["i"]))).drop("near")
    return four.withColumn("n_repeat_words", F.coalesce(_covered("places"), F.lit(0).cast("long"))).drop("places")


def features(counted: DataFrame) -> DataFrame:
    """Adds each feature as a double; null where a document has no word."""
    n = F.nullif(F.col("n_words"), F.lit(0))
    return counted.withColumns({
        "mean_chars": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / F.nullif(F.col("word_chars"), F.lit(0)),
        "dup_line_share": F.col("n_dup_lines") / n,
        "repeat_share": F.col("n_repeat_words") / n,
    })


def thresholds(featured: DataFrame, reach: float = REACH, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, <feature>_low, <feature>_high) from one sketch per group and feature.

    Null lang or source form groups of their own. Sketches of languages and of all rows
    come from the same pass, by a rollup.
    """
    sketches = [F.percentile_approx(f, [0.25, 0.75], ACCURACY).alias(f) for f in FEATURES]
    every = featured.rollup("lang", "source").agg(*sketches, F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    every = written(every, "sketches")
    wide = F.struct("n", *FEATURES)
    total = every.where("level = 3").select(*FEATURES).first()
    own = every.where("level = 0").select("lang", "source", wide.alias("own"))
    by_lang = every.where("level = 1").select(F.col("lang").alias("_lang"), wide.alias("wider"))
    met = own.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")))
    ends = []
    for f, (least, high, low) in FEATURES.items():
        whole = F.lit(total[f] if total else None).cast("array<double>")
        ends_of = F.when(F.col("own.n") >= min_group, F.col(f"own.{f}")).when(F.col("wider.n") >= min_group, F.col(f"wider.{f}")).otherwise(whole)
        q1, q3 = F.get(ends_of, 0), F.get(ends_of, 1)
        reached = F.greatest(q3 - q1, F.lit(least)) * reach
        ends += [(q1 - reached if low else F.lit(None).cast("double")).alias(f"{f}_low")]
        ends += [(q3 + reached if high else F.lit(None).cast("double")).alias(f"{f}_high")]
    return met.select("lang", "source", *ends)


def quality(docs: DataFrame, reach: float = REACH) -> DataFrame:
    """The counts of each document with ``base_failed`` and ``kept``.

    One row comes out for each row that goes in. A document fails the base rules with
    under 50 words, or if windows that repeat cover over half of them; kept is false
    then, or if a feature lies outside its group's thresholds. Repeated rows are judged
    alike; an empty table gives an empty result. Texts are read whole, each as one row
    with arrays of its words and windows. Other columns of docs are not used.
    """
    featured = features(written(counts(docs.select("doc_id", "text", "lang", "source")), "counts"))
    ends = written(thresholds(featured, reach), "thresholds")
    side = ends.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *ends.columns[2:])
    if ends.count() <= BROADCAST_GROUPS:
        side = F.broadcast(side)
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    joined = featured.join(side, same, "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    outside = F.lit(False)
    for f in FEATURES:
        outside = outside | F.coalesce(F.col(f) < F.col(f"{f}_low"), F.lit(False)) | F.coalesce(F.col(f) > F.col(f"{f}_high"), F.lit(False))
    kept = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select(*kept, base.alias("base_failed"), (~base & ~outside).alias("kept"))
