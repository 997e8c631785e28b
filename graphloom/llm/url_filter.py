"""URL filters: host and path rules, and a list of URLs behind a blocked Bloom filter.

Rules block or allow a host with its subdomains under a path; the longest rule wins.
They are looked up by the parts of a host, so there may be many. URLs that no rule
judges are held against a list of canonical URLs. A blocked Bloom filter of the list
(one 64-bit block a URL, its bits combined by ``bit_or`` per block) goes to all tasks
and passes possible hits; an exact hash join with the list then removes false positives.
A filter of more than ``MAX_BLOCKS`` blocks stays a table dealt by block, and keys meet
their block in a join, so that its rate of false hits is the same for a list of any
length. Only pages with a possible hit are joined: pages of all other URLs, of none, and
of listed URLs that very many pages have, stay where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, join_counted, written

#: Blocks of a filter that is broadcast, at most (64 MB); four URLs go to one.
MAX_BLOCKS = 1 << 23
_BITS = 6  # set in a block for each URL
#: Query parameters that only track; fixed values.
TRACKING = "utm_[^=&]*|ref|fbclid|gclid|session|sid"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One form for all spellings of a page's address; null without ``://``.

    Scheme, port, ``www.`` and ``m.``, fragment, tracking parameters, ``index`` and
    ``.html`` endings and closing slashes go; other parameters are sorted.
    """
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host_of(url), r"^[^@]*@", ""), r":\d*$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(/index)?\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    left = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^({TRACKING})(=|$)")))
    tail = F.when(F.size(left) > 0, F.concat(F.lit("?"), F.array_join(left, "&"))).otherwise("")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, tail))


class Rules:
    """Rules by host; a URL's rule is the longest whose host is its host or a parent of it and whose path begins its path."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self._of: dict[str, list[tuple[str, str]]] = {}
        last = {(at, under): verdict for verdict, at, under in rules}
        for (at, under), verdict in sorted(last.items(), key=lambda r: -len(r[0][1])):
            self._of.setdefault(at, []).append((under, verdict))

    def find(self, host: str, path: str) -> dict[str, str] | None:
        best, at = None, host
        while True:  # a longer host goes before a shorter one if both rules are as long
            for under, verdict in self._of.get(at, ()):
                if path.startswith(under):
                    if best is None or len(at) + len(under) > len(best["rule"]):
                        best = {"rule": at + under, "verdict": verdict}
                    break
            _, dot, at = at.partition(".")
            if not dot:
                return best


def _place(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a URL and its bits in there, from two hashes."""
    h = F.xxhash64(F.lit(7), key)
    bits = F.lit(0).cast("long")
    for k in range(_BITS):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 9 * k).bitwiseAND(63).cast("int")))
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), bits


def filter_table(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the blocks of the filter of column ``key`` that are not empty."""
    block, bits = _place(F.col("key"), blocks)
    return listed.select(block.alias("block"), bits.alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("bits"))


def bloom_filter(listed: DataFrame, blocks: int) -> np.ndarray:
    """All blocks of the filter, from the driver: one long each."""
    rows = filter_table(listed, blocks).toArrow()
    out = np.zeros(blocks, dtype=np.int64)
    out[rows["block"].to_numpy()] = rows["bits"].to_numpy()
    return out


def passes_by_block(keys: DataFrame, filled: DataFrame, blocks: int) -> DataFrame:
    """Keys that a filter may hold which stays a table; keys are distinct, so that no URL of many pages is one task's."""
    block, bits = _place(F.col("key"), blocks)
    want = keys.select("key", block.alias("block"), bits.alias("want"))
    return want.join(filled, "block").where(F.col("bits").bitwiseAND(F.col("want")) == F.col("want")).select("key")


def passes(keys: DataFrame, filled: np.ndarray) -> Column:
    """Whether a filter that all tasks have may hold the ``key`` of a row."""
    shared = keys.sparkSession.sparkContext.broadcast(filled)

    @F.arrow_udf("boolean")
    def hit(block: pa.Array, want: pa.Array) -> pa.Array:
        bits = want.fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array((shared.value[block.fill_null(0).to_numpy(zero_copy_only=False)] & bits == bits) & pc.is_valid(want).to_numpy(zero_copy_only=False))

    return hit(*_place(F.col("key"), len(filled)))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``verdict`` and ``canonical_url``.

    ``rules`` are (verdict, host, path), of which the last counts for the same place;
    ``listed`` has a column ``url``. A URL without a fitting rule is blocked if its
    canonical form is listed, else allowed. A null URL or one without ``://`` has an empty
    host and path, no canonical form, and is allowed unless a rule fits the empty host.
    One row comes out for each row that goes in; an input column named like an output is
    replaced. Nulls in the list are ignored, and repeated URLs count once. URLs of any
    length are read whole. An empty table gives an empty one, an empty list blocks nothing.
    """
    whole = pages.drop("host", "path", "rule", "verdict", "canonical_url", "key", "_rule", "_maybe", "_hit")
    found = Rules(rules)

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def rule_of(host: pa.Array, path: pa.Array) -> pa.Array:
        kind = pa.struct([("rule", pa.string()), ("verdict", pa.string())])
        return pa.array(map(found.find, host.to_pylist(), path.to_pylist()), kind)

    judged = whole.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "key": canonical(F.col("url"))})
    judged = judged.withColumn("_rule", rule_of("host", "path"))

    keys = written(listed.select(canonical(F.col("url")).alias("key")).where("key IS NOT NULL").distinct(), "listed")
    blocks = max(1, keys.count() // 4)
    is_open = F.col("_rule").isNull() & F.col("key").isNotNull()
    few = blocks <= max_blocks
    met = judged.withColumn("_maybe", is_open & passes(judged, bloom_filter(keys, blocks)) if few else is_open)
    asked = met.where("_maybe").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    listed_keys = keys if few else passes_by_block(asked, filter_table(keys, blocks), blocks).join(keys, "key", "left_semi")
    # False hits are keys too: each asked key gets an answer, so that the join below loses no page.
    answers = asked.join(listed_keys.withColumn("_hit", F.lit(True)), "key", "left").select("key", "n", F.coalesce("_hit", F.lit(False)).alias("_hit"))
    joined = join_counted(met.where("_maybe"), written(answers, "answers"), "key")
    out = joined.unionByName(met.where("NOT _maybe").withColumn("_hit", F.lit(False)))
    method = F.when(F.col("_hit"), "block").otherwise("allow")
    return out.select(
        *whole.columns, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), F.col("key").alias("canonical_url")
    )
