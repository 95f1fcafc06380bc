"""Byte-level BPE by monoid tree reduction.

A text is a tree of halves. Leaves of at most `leaf_bytes` bytes are encoded on their own; two neighbours
are joined by encoding anew a window around their border that grows until it ends, on either side, where
the tokens outside are proved stable, and keeping all tokens outside of it:

* between matches of the split pattern, a window ends at a *sync point*: a border of characters at which
  every match that reaches it ends and a new one starts, whatever stands further off (after an ASCII letter
  or digit another class of ASCII character; after ASCII punctuation other than an apostrophe a letter,
  digit or white space). The pattern looks ahead of white space only, so such a border is one in any context;
* inside one very long match, a window of tokens grows until both pairs of tokens at its ends encode to
  themselves. A sequence of tokens whose neighbours all do is the BPE encoding of its bytes.

Decoding concatenates the tokens' bytes up the same tree, which for arrays is one gather.

Defined results: a null or empty text has no ids and decodes to no bytes; special tokens' strings are
ordinary text; equal texts have equal ids; other columns pass through unless they bear an output's name,
in which case the output replaces them.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import distinct_spans, ragged_take, spread, text_buffer
from .arrays import chunks as text_chunks
from .spark_util import in_arrow
from .tokens import Memo, load_ranks

LETTER, DIGIT, POINT, BLANK, APOSTROPHE = 1, 2, 3, 4, 5
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = POINT
CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
CLASS[39] = APOSTROPHE
STABLE = np.zeros((6, 6), bool)
STABLE[LETTER, [DIGIT, POINT, BLANK, APOSTROPHE]] = True
STABLE[DIGIT, [LETTER, POINT, BLANK, APOSTROPHE]] = True
STABLE[POINT, [LETTER, DIGIT, BLANK]] = True


def sync_points(buf: np.ndarray) -> np.ndarray:
    """Positions p, ascending, where a match always ends before byte p and another starts at it."""
    kind = CLASS[buf]
    return np.flatnonzero(STABLE[kind[:-1], kind[1:]]) + 1 if len(buf) > 1 else np.zeros(0, np.int64)


class Codec:
    """Ids and bytes by one rank file; one per Python worker."""

    _made: dict[tuple, Codec] = {}

    def __init__(self, path: str, pattern: str, leaf_bytes: int, long_match: int = 1024):
        import regex
        import tiktoken

        ranks = load_ranks(path)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.leaf_bytes, self.long_match = leaf_bytes, long_match
        size = max(ranks.values()) + 1
        table: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            table[rank] = token
        self.lengths = np.fromiter(map(len, table), np.int64, size)
        self.bytes_at = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.table = table
        self.memo = Memo(self._pieces)

    @classmethod
    def get(cls, *key) -> Codec:
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def _pieces(self, pieces: list[bytes]):
        """Ids of pieces between sync points. Those that start with a blank and end with a byte after which
        a blank makes a sync point are encoded as one text, and told apart by their tokens' bytes."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        joint = np.fromiter((x[0] == 32 and len(x) > 1 and STABLE[CLASS[x[-1]], BLANK] for x in pieces), bool, len(pieces))
        counts = np.zeros(len(pieces), np.int64)
        parts, order = [], [np.flatnonzero(joint), np.flatnonzero(~joint)]
        for at in range(0, len(order[0]), 8192):
            own = order[0][at : at + 8192]
            ids = self.encoding.encode_to_numpy(b"".join([pieces[i] for i in own]).decode("utf-8"), disallowed_special=())
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(lengths[own])) + 1
            counts[own] = np.diff(ends, prepend=0)
            parts.append(ids)
        for i in order[1]:
            ids = self.encoding.encode_ordinary(pieces[i].decode("utf-8"))
            counts[i] = len(ids)
            parts.append(np.array(ids, np.uint32))
        order = np.concatenate(order)
        starts = np.zeros(len(pieces), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(parts)[spread(starts, counts)], counts

    # one match of the pattern -------------------------------------------------------------

    def _piece(self, piece: bytes) -> list[int]:
        return self.encoding._encode_single_piece(piece)

    def match(self, piece: bytes) -> list[int]:
        """Ids of one match: halves, joined by windows of tokens."""
        if len(piece) <= self.long_match:
            return self._piece(piece)
        half = len(piece) // 2
        return self.join(self.match(piece[:half]), self.match(piece[half:]))

    def _pair(self, x: int, y: int) -> bool:
        return self._piece(self.table[x] + self.table[y]) == [x, y]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the joined bytes, from those of the parts, by a growing window of tokens around the border."""
        for k in (8 << i for i in count()):
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self._piece(b"".join(self.table[t] for t in (*left[a:], *right[:b])))
            if (a == 0 or self._pair(left[a - 1], window[0])) and (b == len(right) or self._pair(window[-1], right[b])):
                return left[:a] + window + right[b:]

    def window(self, data: bytes) -> np.ndarray:
        """Ids of a text between two sync points."""
        text = data.decode("utf-8")
        if len(data) <= self.leaf_bytes:
            return np.array(self.encoding.encode_ordinary(text), np.uint32)
        found: list[int] = []
        for m in self.split.finditer(text):
            found += self.match(m.group().encode("utf-8"))
        return np.array(found, np.uint32)

    # whole texts --------------------------------------------------------------------------

    def _leaves(self, buf: np.ndarray, lo: int, hi: int) -> list[int]:
        """Ends of the leaves of [lo, hi), left to right: halves at borders of characters."""
        if hi - lo <= self.leaf_bytes:
            return [hi]
        mid = (lo + hi) // 2
        while mid > lo and buf[mid] & 0xC0 == 0x80:
            mid -= 1
        return [hi] if mid == lo else self._leaves(buf, lo, mid) + self._leaves(buf, mid, hi)

    def _reduce(self, buf, sync, lo, ends, leaves) -> np.ndarray:
        """Joins the leaves that end at `ends`, the first of which starts at lo, by halves."""
        if len(leaves) == 1:
            return leaves[0]
        half = len(leaves) // 2
        mid, hi = ends[half - 1], ends[-1]
        left = self._reduce(buf, sync, lo, ends[:half], leaves[:half])
        right = self._reduce(buf, sync, mid, ends[half:], leaves[half:])
        i = int(np.searchsorted(sync, mid, side="right"))
        before = int(sync[i - 1]) if i else -1
        if before == mid:
            return np.concatenate([left, right])
        after = int(sync[i]) if i < len(sync) else hi
        before, after = max(before, lo), min(after, hi)
        outside_left = int(np.searchsorted(np.cumsum(self.lengths[left]), before - lo, side="right")) if before > lo else 0
        inside_right = int(np.searchsorted(np.cumsum(self.lengths[right]), after - mid, side="left")) + 1
        return np.concatenate([left[:outside_left], self.window(buf[before:after].tobytes()), right[inside_right:]])

    def encode(self, buf: np.ndarray, offsets: np.ndarray):
        """Ids of texts (a buffer and offsets), one after the other, and the offsets of each one's ids."""
        texts = len(offsets) - 1
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
        sync = sync_points(buf)
        long = np.flatnonzero(offsets[1:] - offsets[:-1] > self.leaf_bytes)
        own = {int(i): self._leaves(buf, int(offsets[i]), int(offsets[i + 1])) for i in long}
        border = np.zeros(len(buf) + 1, bool)
        border[sync] = border[offsets] = True
        border[[e for ends in own.values() for e in ends]] = True
        cuts = np.flatnonzero(border)
        words, index = distinct_spans(buf, cuts[:-1], cuts[1:])
        known = self.memo.lookup(words.to_numpy(zero_copy_only=False).tolist())
        ids, at = ragged_take(self.memo.ids, self.memo.offsets, known[index])
        bounds = at[np.searchsorted(cuts, offsets)]
        if not own:
            return ids, bounds
        parts, lengths, done = [], bounds[1:] - bounds[:-1], 0
        for i, ends in own.items():
            borders = at[np.searchsorted(cuts, np.array([offsets[i], *ends]))]
            leaves = [ids[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]
            whole = self._reduce(buf, sync, int(offsets[i]), ends, leaves)
            parts += [ids[done : bounds[i]], whole]
            done, lengths[i] = bounds[i + 1], len(whole)
        parts.append(ids[done:])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])

    def decode(self, ids: np.ndarray, offsets: np.ndarray):
        """Bytes of sequences of ids, one after the other, and their offsets."""
        data, at = ragged_take(self.bytes, self.bytes_at, ids.astype(np.int64))
        return data, at[offsets]


def _list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def _binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, leaf_bytes: int = 4096, chunk_bytes: int = 4 << 20) -> DataFrame:
    """Adds the ids of each whole text (array<int>) and, if `decoded` names a column, the bytes they decode to."""
    own = [c for c in df.columns if c not in (ids, decoded)]
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else []))

    def run(batches):
        codec = Codec.get(ranks, pattern, leaf_bytes)
        for batch in batches:
            for part in text_chunks(batch, text, chunk_bytes):
                buf, offsets = text_buffer(part.column(text))
                found, at = codec.encode(buf, offsets)
                made = [_list_array(found, at)] + ([_binary_array(*codec.decode(found, at))] if decoded else [])
                yield pa.RecordBatch.from_arrays(part.columns + made, names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in own]).transform(in_arrow, run, schema)


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that each sequence of ids decodes to; a null sequence gives no bytes."""
    own = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField(out, T.BinaryType())])

    def run(batches):
        codec = Codec.get(ranks, pattern, 4096)
        for batch in batches:
            column = batch.column(ids)
            lengths = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
            found = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            made = _binary_array(*codec.decode(found, np.concatenate([[0], np.cumsum(lengths)])))
            yield pa.RecordBatch.from_arrays(batch.columns + [made], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in own]).transform(in_arrow, run, schema)


def op7_byte_bpe(spark, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """Ids of every whole text and the bytes they decode to, as digests."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
