"""Byte-level BPE by recursive queries of a relational engine inside each task.

Spark deals the texts; inside a task, DuckDB holds the tokens and the merge table. The
distinct words of a batch of texts are joined with the tokens, since a word that is a
token stands for itself. All others become rows (word, position, token): a recursive
query joins neighbours with the merge table and contracts each word's leftmost pair of
minimum rank, until no word has a pair left. Decoding joins ids with the tokens' bytes
and puts them together by an ordered aggregation.

Words are cut first between bytes that stand side by side in no token: no merge can
reach over such a place, so the ids are the same. What is left over ``_LONG`` bytes
contracts several pairs a round: all non-overlapping places of the minimum rank, up to
the first one whose merge brings a lower rank next to it. Before that place the
one-by-one order would take the same pairs, so the ids are the same again.

All state ends with the task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from graphloom.llm.common import by_batches
from graphloom.llm.pieces import Ids, TextEncoder, runs

_BYTES = 400_000  # of words to a query
_LONG = 48  # bytes from which a word takes several merges a round

#: A token's row knows the token after it and the rank of the two. Each round finds every
#: word's leftmost pair of minimum rank (from, upto, made): the row ``upto`` becomes the merged
#: token, the row ``from`` goes, and the row before takes the merged token as its next one.
#: Rows of words without a pair come out done.
_ONE = """
    WITH RECURSIVE step(w, pos, after, id, following, rank, done) AS (
        SELECT b.w, b.pos, b.after, b.id, b.following, m.rank, false
        FROM bytes b LEFT JOIN merges m ON m.a = b.id AND m.b = b.following
        UNION ALL
        SELECT n.w, n.pos, n.after, n.id, n.following,
               CASE WHEN n.fresh THEN m.rank ELSE n.rank END, n.done
        FROM (
            SELECT s.w, s.pos, s.rank, h.made IS NULL AS done,
                   CASE WHEN s.after = h.start THEN h.upto ELSE s.after END AS after,
                   CASE WHEN s.pos = h.upto THEN h.made ELSE s.id END AS id,
                   CASE WHEN s.after = h.start THEN h.made ELSE s.following END AS following,
                   coalesce(s.pos = h.upto OR s.after = h.start, false) AS fresh,
                   CASE WHEN s.pos = h.upto THEN h.made WHEN s.after = h.start THEN s.id END AS sought
            FROM step s JOIN (
                SELECT w, (hit & 4294967295)::INT AS start, upto, (hit >> 32)::INT AS made
                FROM (SELECT w, min(hit) AS hit, arg_min(after, hit) AS upto
                      FROM (SELECT w, after, rank::BIGINT << 32 | pos AS hit FROM step WHERE NOT done) GROUP BY w)
            ) h ON s.w = h.w
            WHERE NOT s.done AND s.pos IS DISTINCT FROM h.start
        ) n LEFT JOIN merges m ON m.a = n.sought AND m.b = n.following
    )
    SELECT pos, id FROM step WHERE done"""
_PAIRED = """
    SELECT s.w, s.pos, s.id, m.rank FROM (
        SELECT w, pos, id, lead(id) OVER (PARTITION BY w ORDER BY pos) AS following FROM ({rows})
    ) s LEFT JOIN merges m ON m.a = s.id AND m.b = s.following"""
_RANKED = f"SELECT w, pos, id, rank, min(rank) OVER (PARTITION BY w) AS best FROM ({_PAIRED})"
#: even: the place is not the second of two overlapping ones. risky: a merge here brings a lower rank.
_MANY = """
    SELECT w, pos, id, rank, even AND coalesce(bool_or(risky AND even) OVER (
        PARTITION BY w ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) = false AS hit
    FROM (
        SELECT p.*, p.rank = p.best AND (row_number() OVER (PARTITION BY w, island ORDER BY pos)) % 2 = 1 AS even,
               p.rank = p.best AND least(x.rank, y.rank, z.rank) < p.best AS risky
        FROM (
            SELECT *, nth - sum((rank IS NOT DISTINCT FROM best)::INT) OVER (PARTITION BY w ORDER BY pos) AS run,
                   CASE WHEN rank IS NOT DISTINCT FROM best THEN run ELSE -nth END AS island
            FROM (SELECT *, row_number() OVER s AS nth, lag(id) OVER s AS ahead, lead(id, 2) OVER s AS behind
                  FROM step WHERE best IS NOT NULL WINDOW s AS (PARTITION BY w ORDER BY pos))
        ) p LEFT JOIN merges x ON p.rank = p.best AND x.a = p.ahead AND x.b = p.best
            LEFT JOIN merges y ON p.rank = p.best AND y.a = p.best AND y.b = p.behind
            LEFT JOIN merges z ON p.rank = p.best AND z.a = p.best AND z.b = p.best)"""
_CONTRACTED = """
    SELECT w, pos, id FROM (
        SELECT w, pos, CASE WHEN hit THEN rank ELSE id END AS id, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY pos), false) AS gone
        FROM ({hits})) WHERE NOT gone"""


_FIRST = _RANKED.format(rows="SELECT w, pos, id FROM bytes")
_AGAIN = _RANKED.format(rows=_CONTRACTED.format(hits=_MANY))
_LONG_WORDS = f"""
    WITH RECURSIVE step(w, pos, id, rank, best) AS ({_FIRST} UNION ALL {_AGAIN})
    SELECT pos, id FROM step WHERE best IS NULL"""


#: Each token with all ways to make it of two others; the rank of a merge is its token's.
_MERGES = """
    CREATE TABLE merges AS
    SELECT a.id AS a, b.id AS b, t.id AS rank
    FROM (SELECT id, chars, unnest(generate_series(1, length(chars) - 1)) AS at FROM tokens) t
    JOIN tokens a ON a.chars = t.chars[: t.at] JOIN tokens b ON b.chars = t.chars[t.at + 1 :]"""


class Bpe:
    """The vocabulary of a rank file in a DuckDB connection of one thread, which never writes to disk."""

    def __init__(self, path: str, pattern: str, memory: str = "1GB"):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self._con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        self._bytes = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        # Tokens are bytes, not all of them text; as characters from U+0000 to U+00FF they can be cut and joined.
        rows = pa.table({"id": pa.array(ranks.values(), pa.int32()), "chars": [t.decode("latin-1") for t in ranks], "word": [_text(t) for t in ranks]})
        self._con.register("given", rows)
        self._con.execute("CREATE TABLE tokens AS SELECT * FROM given")
        self._con.unregister("given")
        self._con.execute(_MERGES)
        self._beside = np.zeros((256, 256), dtype=bool)  # pairs of bytes that a token holds
        for t in ranks:
            for a, b in zip(t, t[1:]):
                self._beside[a, b] = True
        self._texts = TextEncoder(regex.compile(pattern).findall, self._of_words)

    def _of_words(self, words: pa.Array) -> Ids:
        """The ids of distinct words, some at a time."""
        ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)
        found, at = [], 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BYTES, side="right")))
            found.append(self._contracted(pa.concat_arrays([words.slice(at, to - at)])))
            at = to
        return Ids(np.concatenate([x.flat for x in found]), np.concatenate([x.sizes for x in found]))

    def _contracted(self, words: pa.Array) -> Ids:
        cuts = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(words.buffers()[2], dtype=np.uint8)[cuts[0] : cuts[-1]]
        cuts = (cuts - cuts[0]).astype(np.int64)
        self._con.register("words", pa.table({"nth": np.arange(len(words)), "word": words}))
        known = self._con.sql("SELECT nth, id FROM words JOIN tokens USING (word)").to_arrow_table()
        self._con.unregister("words")

        ends = np.zeros(len(raw), dtype=bool)
        ends[cuts[1:] - 1] = True
        ends[:-1] |= ~self._beside[raw[:-1], raw[1:]]
        stops = np.flatnonzero(ends)
        sizes = np.diff(stops, prepend=-1)
        word = np.repeat(np.arange(len(stops), dtype=np.int32), sizes)
        ids, pos = self._bytes[raw], np.arange(len(raw), dtype=np.int32)
        open_ = np.ones(len(words), dtype=bool)
        open_[known["nth"].to_numpy()] = False
        left = np.repeat(open_, np.diff(cuts))
        long = np.repeat(sizes > _LONG, sizes)
        at, made = [cuts[known["nth"].to_numpy()]], [known["id"].to_numpy()]
        for which, sql in ((left & ~long, _ONE), (left & long, _LONG_WORDS)):
            if not which.any():
                continue
            last = pa.array(ends[which])
            after = pc.if_else(last, None, pa.array(pos[which] + 1))
            following = pc.if_else(last, None, pa.array(np.append(ids[1:], 0).astype(np.int32)[which]))
            self._con.register("bytes", pa.table({"w": word[which], "pos": pos[which], "after": after, "id": ids[which], "following": following}))
            found = self._con.sql(sql).to_arrow_table()
            self._con.unregister("bytes")
            at.append(found["pos"].to_numpy())
            made.append(found["id"].to_numpy())
        at = np.concatenate(at)
        order = np.argsort(at)
        n = np.diff(np.searchsorted(at[order], cuts))
        return Ids(np.concatenate(made)[order].astype(np.uint32), n)

    def encode(self, texts: list[str]) -> Ids:
        """The ids of each text."""
        return self._texts.encode(texts)

    def decode(self, ids: Ids) -> list[bytes]:
        """The bytes of each list of ids, put together by position."""
        doc = np.repeat(np.arange(len(ids.sizes), dtype=np.int32), ids.sizes)
        self._con.register("encoded", pa.table({"doc": doc, "pos": np.arange(len(doc)), "id": ids.flat.astype(np.int32)}))
        found = self._con.sql("SELECT doc, string_agg(chars, '' ORDER BY pos) AS chars FROM encoded JOIN tokens USING (id) GROUP BY doc").to_arrow_table()
        self._con.unregister("encoded")
        out = [b""] * len(ids.sizes)
        for d, chars in zip(found["doc"].to_pylist(), found["chars"].to_pylist(), strict=True):
            out[d] = chars.encode("latin-1")
        return out


def _text(token: bytes) -> str | None:
    """The token as a word; None if it is not whole characters."""
    word = token.decode(errors="ignore")
    return word if word.encode() == token else None


def bpe_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids of each text as little-endian uint32 bytes, and their bytes again.

    A null text is an empty one, with no ids. One row comes out for each row that goes
    in; special tokens have no meaning. Texts that are not valid Unicode cannot occur in
    a Spark string column that was written as UTF-8. Texts are encoded whole, whatever
    their length; repeated rows come out repeated, an empty table gives an empty one.
    Other columns are not used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for b in batches:
            coder = coder or Bpe(path, pattern)
            ids_of, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in runs(texts):
                ids = coder.encode(texts[lo:hi])
                raw = ids.flat.astype("<u4").tobytes()
                cuts = 4 * np.append(0, np.cumsum(ids.sizes))
                coded = pa.array([raw[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids_of.slice(lo, hi - lo), coded, pa.array(coder.decode(ids), pa.binary())], names=["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids binary, decoded binary")
