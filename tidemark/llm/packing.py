"""Vector bin packing of tokenised examples into training sequences.

Each example is a vector (tokens, one segment, loss-bearing tokens); a sequence has a limit for each. The
dot-product heuristic puts an example into the open sequence that it fits and whose remaining room, as a
share of the limits, has the largest dot product with the example's own shares. Examples longer than a
sequence are cut into full ones first. Where an example fits nowhere and `open_bins` sequences are open,
the fullest one that may take one more segment is filled up with a piece of it. What is left in open
sequences when a partition ends is cut anew into full sequences and, for the rest, sequences whose lengths
are powers of two, which need no padding: padding is nil unless another limit than tokens binds.

Packing streams over each input partition without a shuffle, with `open_bins` sequences in memory. Ids are
(partition << 33) + a running number: a retried task gives the same rows for the same input split, another split
gives other sequences.

Defined results: a null or empty text has the end id alone; the string of an added token in a text has that token's
id, as the library gives it; very long texts are cut into full sequences; tied choices take the sequence opened first;
repeated rows are packed as often as they occur; an empty table gives no rows; of other columns only the id
column is kept; a null id stays null.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, SPACE, chunks, distinct_spans, ragged_take, release, text_buffer
from .byte_bpe import sync_points
from .spark_util import in_arrow
from .tokens import Memo, word_encoder


class WordTokenizer:
    """Ids of whole texts by a tokenizers file that drops white space, each distinct word once."""

    _made: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)).encode("utf-8")) if added else None
        self.memo = Memo(word_encoder(path))

    @classmethod
    def get(cls, path: str) -> WordTokenizer:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, buf: np.ndarray, offsets: np.ndarray):
        """Ids of all texts and their offsets; texts with an added token's string are encoded as a whole."""
        data = buf.tobytes()
        if self.special is None or not self.special.search(data):
            return self._by_words(buf, offsets)
        parts = []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if self.special.search(data, a, b):
                parts.append(np.array(self.tokenizer.encode(data[a:b].decode("utf-8"), add_special_tokens=False).ids, np.uint32))
            else:
                parts.append(self._by_words(buf[a:b], np.array([0, b - a]))[0])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _by_words(self, buf: np.ndarray, offsets: np.ndarray):
        starts, ends = cut_words(buf, offsets) if len(buf) else (offsets[:0], offsets[:0])
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        first = np.searchsorted(starts, offsets)
        words, index = distinct_spans(LOWER[buf], starts, ends)
        known = self.memo.lookup(words.to_numpy(zero_copy_only=False).tolist())
        ids, at = ragged_take(self.memo.ids, self.memo.offsets, known[index])
        return ids, at[first]


def cut_words(buf: np.ndarray, offsets: np.ndarray):
    """Words, cut further where the tokenizer's own words end in any context: see sync_points."""
    gap = SPACE[buf]
    border = np.zeros(len(buf) + 1, bool)
    border[1:-1] = gap[1:] != gap[:-1]
    border[offsets] = border[sync_points(buf)] = True
    cuts = np.flatnonzero(border)
    full = ~gap[cuts[:-1]]
    return cuts[:-1][full], cuts[1:][full]


class Packer:
    """Open sequences of one partition. Pieces are tuples (key, start, ids, document's tokens, loss-bearing tokens)."""

    def __init__(self, first_id: int, tokens: int, segments: int, loss: int, open_bins: int):
        self.limits = np.array([tokens, segments, loss], float)
        self.tokens, self.open_bins, self.next_id, self.out = tokens, open_bins, first_id, []
        self.room = np.zeros((open_bins, 3))
        self.bins: list[list] = [[] for _ in range(open_bins)]
        self.age = np.zeros(open_bins, np.int64)
        self.used = np.zeros(open_bins, bool)
        self.clock = 0

    def _emit(self, pieces) -> None:
        offset = 0
        for key, start, ids, total, _ in pieces:
            self.out.append((key, start, ids, total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def _close(self, at: int) -> None:
        self._emit(self.bins[at])
        self.bins[at], self.used[at] = [], False

    def _put(self, at: int, piece) -> None:
        self.bins[at].append(piece)
        self.room[at] -= (len(piece[2]), 1, piece[4])
        if self.room[at, 0] <= 0 or self.room[at, 1] <= 0:
            self._close(at)

    def _cut(self, piece, n: int):
        """The first n ids and the rest; loss-bearing tokens are the last of an example."""
        key, start, ids, total, loss = piece
        head = max(0, loss - (len(ids) - n))
        return (key, start, ids[:n], total, head), (key, start + n, ids[n:], total, loss - head)

    def add(self, key, ids: np.ndarray, loss: int) -> None:
        piece = (key, 0, ids, len(ids), min(loss, len(ids)))
        while len(piece[2]) >= self.tokens or piece[4] > self.limits[2]:
            n = min(self.tokens, len(piece[2]))
            if piece[4] - max(0, len(piece[2]) - n) > self.limits[2]:
                n = len(piece[2]) - piece[4] + int(self.limits[2])
            head, piece = self._cut(piece, n)
            self._emit([head])
        while len(piece[2]):
            want = np.array([len(piece[2]), 1, piece[4]], float)
            fits = self.used & (self.room >= want).all(1)
            if fits.any():
                score = (self.room / self.limits) @ (want / self.limits)
                score[~fits] = -1
                best = np.flatnonzero(score >= score.max() - 1e-12)
                return self._put(int(best[np.argmin(self.age[best])]), piece)
            free = np.flatnonzero(~self.used)
            if len(free):
                at = int(free[0])
                self.clock += 1
                self.used[at], self.age[at], self.room[at] = True, self.clock, self.limits
                return self._put(at, piece)
            at = int(np.lexsort((self.age, self.room[:, 0]))[0])
            n = int(min(self.room[at, 0], len(piece[2])))
            while n and self._cut(piece, n)[0][4] > self.room[at, 2]:
                n -= int(self._cut(piece, n)[0][4] - self.room[at, 2])
            if n <= 0:
                self._close(at)
                continue
            head, piece = self._cut(piece, n)
            self._put(at, head)
            if self.used[at] and len(piece[2]):
                self._close(at)

    def finish(self) -> None:
        """Cuts what open sequences hold into full ones and powers of two."""
        rest = [p for at in np.argsort(self.age) if self.used[at] for p in self.bins[at]]
        self.used[:] = False
        left = sum(len(p[2]) for p in rest)
        now, room, segments, loss = [], 0, 0, 0
        while rest:
            if not now:
                room = self.tokens if left >= self.tokens else 1 << (left.bit_length() - 1)
                segments, loss = int(self.limits[1]), int(self.limits[2])
            n = min(room, len(rest[0][2]))
            while n and self._cut(rest[0], n)[0][4] > loss:
                n -= int(self._cut(rest[0], n)[0][4] - loss)
            if n:
                head, tail = self._cut(rest[0], n)
                now.append(head)
                room, segments, loss, left = room - n, segments - 1, loss - head[4], left - n
                rest = ([tail] if len(tail[2]) else []) + rest[1:]
            if not n or not room or not segments or not rest:
                self._emit(now)
                now = []

    def take(self):
        out, self.out = self.out, []
        return out


def pack(df: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", loss: str | None = None, max_tokens: int = 4096, max_segments: int = 1024, max_loss: int | None = None, open_bins: int = 32) -> DataFrame:
    """A row per piece: key, start, length, ids (little-endian unsigned 32-bit, binary), doc_tokens, sequence_id, offset.

    `loss` names a column with the number of an example's last tokens that bear loss (null or no column: all).
    """
    limit_loss = max_tokens if max_loss is None else max_loss
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    columns = [F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), (F.col(f"`{loss}`").cast("long") if loss else F.lit(None).cast("long")).alias("loss")]

    def run(batches):
        words = WordTokenizer.get(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 33, max_tokens, max_segments, limit_loss, open_bins)
        end = np.array([end_id], np.uint32)
        key_type = None

        def rows():
            made = packer.take()
            if not made:
                return
            keys, starts, ids, totals, sequences, offsets = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(totals, pa.int64()), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
                names=[key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            for part in chunks(batch, "text", 3 << 20):
                key_type = part.schema.field("key").type
                ids, at = words.encode(*text_buffer(part.column("text")))
                for i, (k, n) in enumerate(zip(part.column("key").to_pylist(), part.column("loss").to_pylist(), strict=True)):
                    own = np.concatenate([ids[at[i] : at[i + 1]], end])
                    packer.add(k, own, len(own) if n is None else max(0, n))
                yield from rows()
        packer.finish()
        yield from rows()
        words.memo.clear()  # workers live on between tasks, and few words but the most frequent ones come again
        release()

    return df.select(*columns).transform(in_arrow, run, schema)


def op8_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens; a row per piece."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(pack(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
