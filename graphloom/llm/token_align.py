"""Alignment of two tokenizers over the same texts by a sweep over token ends.

Every text is encoded by both tokenizers, and each token is an event at the byte where
it ends. Events of both sides make one table, of blocks of tokens that follow each
other (a block knows the byte where it begins, and a vocabulary has each token's
length, so that an end takes no room of its own). Blocks are repartitioned by document
and sorted by offset inside partitions; a state machine then takes them in order. At
each byte where a token of either side ends, the two tokens that are open overlap:
that is a link. Where tokens of both sides end, a group ends. The machine holds only
the tokens that are not behind the last such place, at most a block of each side and
what one group spans, and the counts of the document at hand.

The sweep runs over all documents of a batch at once: their bytes stand one after
another, since both sides cover the same bytes, and a document's end is the end of a
group.

Links come as counted pairs of ids for each stretch of a document. Counts over the
corpus are grouped by pair with partial sums; the pairs with the most links, ``HOT`` at
most, are broadcast to the documents, and all others meet them by a shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import by_batches, written
from graphloom.llm.pieces import Ids, TextEncoder, runs
from graphloom.llm.token_store import Encoder, token_bytes

#: Tokens of one side in an event row, at most.
BLOCK = 16_384
#: Pairs of ids whose counts are broadcast, at most (24 bytes each).
HOT = 1_000_000
#: Characters of text that are encoded together, and bytes of ids that are swept together.
TEXT_CHARS, SWEPT_BYTES = 500_000, 300_000
#: Of words with their ids that each of a worker's two encoders keeps.
KEPT_BYTES = 12_000_000
_A, _B, _NO_TOKENS = 0, 1, 2
_LINK = "array<struct<a:int,b:int,n:int>>"


class Pieces:
    """Ids of texts with a space in front by a sentencepiece model, word by word.

    Words are cut before spaces that follow others; no piece may reach over such a
    place. A word whose pieces do not give its bytes again is the id ``bad``.
    """

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        if any(re.search("[^▁]▁", x) for x in names):
            raise ValueError("a piece reaches over the start of a word")
        self.bytes = [bytes([int(x[3:5], 16)]) if self._model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.bad = len(names)
        self._space = [self._model.piece_to_id("▁")]
        self._texts = TextEncoder(self._words, self._of_words, KEPT_BYTES, lead=True)

    @staticmethod
    def _words(text: str) -> list[str]:
        return re.findall(" *[^ ]+| +", text)

    def _of_words(self, words: pa.Array) -> Ids:
        texts = words.to_pylist()
        found = self._model.encode([w[1:] for w in texts], out_type=int, num_threads=1)  # the model adds the first space, but not to nothing
        found = [self._space if w == " " else ids for w, ids in zip(texts, found, strict=True)]
        of = self.bytes
        found = [ids if b"".join([of[i] for i in ids]) == w.encode() else [self.bad] for w, ids in zip(texts, found, strict=True)]
        sizes = np.array(list(map(len, found)), dtype=np.int64)
        return Ids(np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes)

    def encode(self, texts: list[str]) -> Ids:
        return self._texts.encode(texts)


class ByteLevel:
    """Ids of texts with a space in front by a byte-level tokenizer, its added tokens' strings being plain text."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        of = token_bytes(Tokenizer.from_file(path))
        self.bytes = [of.get(i, b"") for i in range(max(of) + 1)]
        self._encoder = Encoder(path, pattern, added=False, lead=True, kept_bytes=KEPT_BYTES)

    def encode(self, texts: list[str]) -> Ids:
        found = self._encoder.encode(texts)
        return Ids(np.concatenate(found), np.array(list(map(len, found)), dtype=np.int64))


@functools.lru_cache(maxsize=1)
def _coders(a_path: str, pattern: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    """A worker keeps its encoders, each with a bounded store of words, from task to task."""
    return ByteLevel(a_path, pattern), Pieces(b_path)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _lengths(tokens: list[bytes]) -> np.ndarray:
    return np.array([len(t) for t in tokens] + [0], dtype=np.int64)


def _kind(tokens: list[bytes]) -> np.dtype:
    """Of the ids in an event row; the largest value is for none."""
    return np.dtype("<u2" if len(tokens) < 0xFFFF else "<u4")


def _blocks(ids: Ids, lengths: np.ndarray, keep: np.ndarray, block: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, at, ids) of the event rows of one side, for the texts to keep."""
    of = np.flatnonzero(keep)
    sizes = ids.sizes[of]
    n = -(-sizes // block)
    text = np.repeat(of, n)
    nth = np.arange(len(text)) - np.repeat(_starts(n)[:-1], n)
    first = _starts(ids.sizes)
    begin = first[text] + nth * block
    end = np.minimum(begin + block, first[text + 1])
    byte = _starts(lengths[ids.flat])
    raw = ids.flat.astype(kind)
    if not keep.all() and len(text):
        raw = np.concatenate([raw[a:z] for a, z in zip(begin, end, strict=True)])
    cuts = _starts(end - begin) * kind.itemsize
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(cuts), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
    return text, byte[begin] - byte[first[text]], packed


def token_events(docs: DataFrame, a_path: str, pattern: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, row, at, side, ids): blocks of token ends of both tokenizers, side 0 and 1.

    ``row`` tells rows with the same doc_id apart. A text that is null or empty, or that
    the second tokenizer does not give back, has one row of side 2.
    """
    slim = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    names = ["doc_id", "row", "at", "side", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = None
        for batch in batches:
            coders = coders or [(c, _lengths(c.bytes), _kind(c.bytes)) for c in _coders(a_path, pattern, b_path)]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in runs(texts, TEXT_CHARS):
                part = texts[lo:hi]
                found = [c.encode(part) for c, _, _ in coders]
                bad = _starts(found[_B].flat == coders[_B][0].bad)
                first = _starts(found[_B].sizes)
                keep = np.fromiter(map(bool, part), bool, len(part)) & (bad[first[1:]] == bad[first[:-1]])
                none = np.flatnonzero(~keep)
                sides = [(*_blocks(ids, lengths, keep, block, kind), s) for s, (ids, (_, lengths, kind)) in enumerate(zip(found, coders, strict=True))]
                sides.append((none, np.zeros(len(none), np.int64), pa.array([b""] * len(none), pa.binary()), _NO_TOKENS))
                for text, at, packed, side in sides:
                    of = pa.array(text + lo)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(2).take(of), pa.array(at), pa.array(np.full(len(text), side, np.int8)), packed], names=names)

    schema = T.StructType([slim.schema["doc_id"], T.StructField("row", T.LongType()), T.StructField("at", T.LongType()), T.StructField("side", T.ByteType()), T.StructField("ids", T.BinaryType())])
    return by_batches(slim, run, schema)


class Sweep:
    """The state machine: takes event rows in order, gives finished stretches of documents."""

    def __init__(self, a_lengths: np.ndarray, b_lengths: np.ndarray):
        self._lengths = a_lengths.astype(np.int64), b_lengths.astype(np.int64)
        self._n, self._n_b = len(a_lengths) - 1, len(b_lengths) - 1  # the last one is for no token
        # An id as text behind which its side goes on, and behind which it ends.
        parts = [f"{i}{end}" for n, ends in ((self._n, ",|"), (self._n_b, ",;")) for i in range(n) for end in ends]
        self._texts = pa.array(parts, pa.large_string())

    def stretches(self, a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """(groups, their text with ``;`` behind each, a, b, n of its links) for each stretch of whole groups."""
        a_ends, b_ends = np.cumsum(self._lengths[_A][a]), np.cumsum(self._lengths[_B][b])
        size = int(a_ends[-1]) + 1 if len(a) else 1
        a_at, b_at = np.zeros(size, np.int8), np.zeros(size, np.int8)
        a_at[a_ends], b_at[b_ends] = 1, 1
        both = a_at & b_at
        groups = np.cumsum(both, dtype=np.int32)
        a_last, b_last = both[a_ends], both[b_ends]
        a_group, b_group = groups[a_ends] - a_last, groups[b_ends] - b_last
        # The ids' places in the text: of each group first those of one side, then those of the other.
        n_groups = int(groups[-1])
        a_before, b_before = _starts(np.bincount(a_group, minlength=n_groups)), _starts(np.bincount(b_group, minlength=n_groups))
        which = np.empty(len(a) + len(b), dtype=np.int64)
        which[np.arange(len(a)) + b_before[a_group]] = 2 * a.astype(np.int64) + a_last
        which[np.arange(len(b)) + a_before[b_group + 1]] = 2 * (self._n + b.astype(np.int64)) + b_last
        spelled = self._texts.take(pa.array(which))
        text = memoryview(spelled.buffers()[2])
        text_at = np.frombuffer(spelled.buffers()[1], dtype=np.int64)

        ends = np.flatnonzero(a_at | b_at)
        link_a = (np.cumsum(a_at, dtype=np.int32)[ends] - a_at[ends]).astype(np.int64)
        link_b = (np.cumsum(b_at, dtype=np.int32)[ends] - b_at[ends]).astype(np.int64)
        last_token = np.cumsum(a_sizes) - 1
        last_byte = a_ends[last_token]
        n_links = np.diff(np.searchsorted(ends, last_byte, side="right"), prepend=0)
        key = (np.repeat(np.arange(len(a_sizes)), n_links) * self._n + a[link_a]) * self._n_b + b[link_b]
        key.sort()
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        counts = np.diff(np.append(new, len(key)))
        key = key[new]
        of, pair = np.divmod(key, self._n * self._n_b)
        pair_a, pair_b = np.divmod(pair, self._n_b)
        cuts = np.searchsorted(of, np.arange(len(a_sizes) + 1))
        tokens = _starts(a_sizes + b_sizes)
        done = groups[last_byte]
        for i in range(len(a_sizes)):
            lo, hi = cuts[i], cuts[i + 1]
            yield int(done[i] - (done[i - 1] if i else 0)), text[text_at[tokens[i]] : text_at[tokens[i + 1]]], pair_a[lo:hi], pair_b[lo:hi], counts[lo:hi]

    def whole_groups(self, a: np.ndarray, b: np.ndarray, upto: int) -> tuple[int, int, int]:
        """How many tokens of each side stand before the last common end at byte ``upto`` or before, and that end."""
        a_ends, b_ends = np.cumsum(self._lengths[_A][a]), np.cumsum(self._lengths[_B][b])
        common = np.intersect1d(a_ends[a_ends <= upto], b_ends[b_ends <= upto], assume_unique=True)
        if not len(common):
            return 0, 0, 0
        return int(np.searchsorted(a_ends, common[-1])) + 1, int(np.searchsorted(b_ends, common[-1])) + 1, int(common[-1])


class Machine:
    """Takes event rows in order; holds what is open of the document at hand, and stretches that are ready for a sweep."""

    def __init__(self, sweep: Sweep, kinds: list[np.dtype], texts: bool):
        self._sweep, self._kinds, self._texts = sweep, kinds, texts
        self._key = self._doc_id = None
        self._ready: list[tuple] = []
        self._begin(None, None)

    def _begin(self, key: int | None, doc_id: pa.Scalar | None) -> None:
        self._key, self._doc_id, self._void = key, doc_id, False
        self._open: list[list[np.ndarray]] = [[], []]  # tokens behind the last whole group
        self._base = 0  # the byte where those begin

    def _stretch(self, final: bool, upto: int = 0) -> None:
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in self._open)
        n_a, n_b, end = (len(a), len(b), 0) if final else self._sweep.whole_groups(a, b, upto - self._base)
        if final or n_a:
            self._ready.append((self._doc_id, self._key, self._void, final, a[:n_a], b[:n_b]))
        self._open, self._base = [[a[n_a:]], [b[n_b:]]], self._base + end

    def take(self, batch: pa.RecordBatch) -> None:
        rows, at, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        packed = batch.column(4)
        for i in range(batch.num_rows):
            if rows[i] != self._key:
                self.finish()
                self._begin(int(rows[i]), batch.column(0)[i])
            if side[i] == _NO_TOKENS:
                self._void = True
            else:
                self._open[side[i]].append(np.frombuffer(packed[i].as_buffer(), dtype=self._kinds[side[i]]).astype(np.int64))
        self._stretch(False, int(at[-1]))  # all ends up to here are known: later rows begin behind

    def finish(self) -> None:
        if self._key is not None:
            self._stretch(True)

    def swept(self, state: tuple, kind: pa.DataType, names: list[str]) -> tuple[pa.RecordBatch, tuple]:
        """The rows of all ready stretches; ``state`` goes on with the digest of the document that the first belongs to."""
        ready, self._ready = self._ready, []
        sizes = [np.array([len(x[i]) for x in ready], dtype=np.int64) for i in (4, 5)]
        full = [x for x in ready if len(x[4])]
        some = sizes[_A] > 0
        found = self._sweep.stretches(*(np.concatenate([x[i] for x in full]) for i in (4, 5)), sizes[_A][some], sizes[_B][some]) if full else iter(())
        digest, begun = state
        n_groups, n_links, shas, spelled, links = [], [], [], [], []
        for _, _, void, final, a, _ in ready:
            n, text, *pairs = next(found) if len(a) else (0, b"", *[np.empty(0, np.int64)] * 3)
            text = text[:-1]  # a stretch ends without the sign that parts it from the next one
            if len(text):
                digest.update(b";" * begun)
                digest.update(text)
                begun = True
            shas.append((digest.hexdigest() if not void else "") if final else None)
            if final:
                digest, begun = hashlib.sha256(), False
            n_groups.append(n)
            n_links.append(int(pairs[2].sum()))
            spelled.append(bytes(text).decode() if self._texts else None)
            links.append(pairs)
        cuts = pa.array(_starts(np.array([len(x[0]) for x in links])).astype(np.int32))
        fields = [pa.array(np.concatenate([x[j] for x in links]).astype(np.int32)) for j in range(3)]
        columns = [
            pa.array([x[0].as_py() for x in ready], kind), pa.array([x[1] for x in ready], pa.int64()), pa.array(sizes[_A]), pa.array(sizes[_B]), pa.array(n_groups, pa.int64()),
            pa.array(n_links, pa.int64()), pa.array(shas, pa.string()), pa.array(spelled, pa.string()), pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(fields, ["a", "b", "n"])),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names), (digest, begun)

    def waits(self) -> bool:
        return bool(self._ready)


def _sweep(lengths: tuple[np.ndarray, np.ndarray], kinds: list[np.dtype], names: list[str], texts: bool):
    """Task function; the lengths of both vocabularies' tokens come from the driver, 4 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, state, kind = None, (hashlib.sha256(), False), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if machine is None:
                _coders.cache_clear()  # a worker that has encoded needs its memory now
                machine, kind = Machine(Sweep(*lengths), kinds, texts), batch.column(0).type
            share = np.cumsum(pc.binary_length(batch.column(4)).to_numpy(zero_copy_only=False)) // SWEPT_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                machine.take(batch.slice(lo, hi - lo))
                if machine.waits():
                    rows, state = machine.swept(state, kind, names)
                    yield rows
        if machine is not None:
            machine.finish()
            yield machine.swept(state, kind, names)[0]

    return run


def align(docs: DataFrame, a_path: str, pattern: str, b_path: str, block: int = BLOCK, texts: bool = False) -> DataFrame:
    """(doc_id, row, n_a, n_b, n_groups, n_links, groups_sha256, groups, links): the alignment of each row's text.

    ``a_path`` is a byte-level tokenizer of the tokenizers library whose words match
    ``pattern``, ``b_path`` a sentencepiece model; both encode the text behind a space.
    ``links`` has each linked pair of ids with how many links it makes, ``groups`` (with
    ``texts``) the groups as ``a1,a2|b1;a3|b2,b3``. A very long document comes as several
    rows with the same ``row``, whose counts add up, whose ``groups`` follow each other and
    of which only the last has a digest; see ``summed``.

    Each input row has a ``row`` of its own, so repeated rows come out repeated, and rows
    with the same or no doc_id are told apart. A text that is null or empty, or that the
    second tokenizer does not give back, has zeros, the digest '' and no links. An empty
    table gives an empty one. Other columns are not used.
    """
    events = token_events(docs, a_path, pattern, b_path, block)
    dealt = events.repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "at", "side")
    kinds = {"row": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups_sha256": "string", "groups": "string", "links": _LINK}
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in kinds.items())).fields])
    tokens = [ByteLevel(a_path, pattern).bytes, Pieces(b_path).bytes]
    sweep = _sweep(tuple(_lengths(t).astype(np.int32) for t in tokens), [_kind(t) for t in tokens], schema.names, texts)
    return by_batches(dealt, sweep, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): the links of each pair of ids over all documents, and whether no other pair of its b has more."""
    links = aligned.select(F.explode("links").alias("l")).select("l.*")
    counts = written(links.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))  # a row for each id of the vocabulary


def _hot(counts: DataFrame, hot: int) -> int:
    """The number of links from which pairs are ``hot`` at most; over counts by powers of two, so the driver sees 64 rows at most."""
    power = F.floor(F.log2("n")).cast("int")
    sizes = dict(counts.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("pairs")).collect())
    total = 0
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > hot:
            return 2 ** (p + 1)
    return 0


def summed(aligned: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document, from a written ``align``.

    ``n_best`` are the links whose pair has the most links of all pairs with its second
    id, ``count_sum`` adds up the links over the corpus of each link's pair.
    """
    counts = written(pair_counts(aligned), "counts")
    least = _hot(counts, hot)
    rows = aligned.select("doc_id", "row", F.explode("links").alias("l")).select("doc_id", "row", "l.a", "l.b", F.col("l.n").alias("times"))
    near = F.broadcast(counts.where(F.col("n") >= least))
    met = rows.join(near, ["a", "b"])
    if least:
        met = met.unionByName(rows.join(near.select("a", "b"), ["a", "b"], "left_anti").join(counts.where(F.col("n") < least), ["a", "b"]))
    zero = F.lit(0).cast("long")
    of_links = met.select("doc_id", "row", *(zero.alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")), F.when(F.col("best"), F.col("times")).otherwise(0).cast("long").alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"), F.lit(None).cast("string").alias("groups_sha256"))
    of_rows = aligned.select("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", zero.alias("n_best"), zero.alias("count_sum"), "groups_sha256")
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return of_rows.unionByName(of_links).groupBy("doc_id", "row").agg(*sums, F.max("groups_sha256").alias("groups_sha256")).drop("row")
