"""Language identification of words and documents by a linear-chain conditional random field.

Words are maximal runs of ASCII letters and bytes above 0x7F, lower-cased in ASCII. Features of a word, hashed
to 2**BITS weights per language: its n-grams of 2 and 3 bytes with marks for its ends (so prefixes and suffixes
are features of their own), its first and last 4 and 5 bytes, and the whole word (the lexicon). Transitions
between the labels of neighbouring words are learned with them, on chains of which a part is put together from
texts of two languages, so that code-switched text keeps its borders. Words get marginals by forward-backward over
their whole text, scaled: parts of `CHAIN` words first give the matrix by which they change messages, messages then
pass from part to part, and words get theirs within their parts, which is exact and needs few steps for long texts.
A document's language has the largest mean marginal, its score.

Training uses a bounded sample: about `per_language` documents of each language, and of these at most `chains`
chains. All distinct words of a block are scored once.

Defined results: `und` with score 0 where a text is null or has no letter, or where nothing could be learned;
ties go to the language first in order; equal texts, repeated rows too, have equal results; very long texts are taken
whole; an empty table gives none; other columns pass through unless they
bear an output's name, in which case the output replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, chunks, distinct_spans, span_hashes, text_buffer
from .spark_util import in_arrow

BITS, CHAIN = 15, 64
#: Bounds of the training sample: languages, and characters of a document.
LANGUAGES, CHARACTERS = 1000, 20_000
WORD = np.zeros(256, bool)
WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
ASCII_LETTER = WORD.copy()
ASCII_LETTER[128:] = False


@dataclass
class Model:
    """weights (2**BITS + 1, L), the last row zero; transitions (L, L); languages in order."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray


def words_of(buf: np.ndarray, offsets: np.ndarray):
    """Starts and ends of words, and the index of each text's first word (one more at the end)."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = WORD[buf]
    edge = inside[1:] != inside[:-1]
    edge[offsets] |= inside[offsets] & inside[offsets + 1]
    cuts = np.flatnonzero(edge)
    if len(cuts) < 2:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    starts, ends = cuts[:-1], cuts[1:]
    full = WORD[buf[starts]]
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(starts, offsets)


def _features(data: np.ndarray, offsets: np.ndarray):
    """Rows of weights of each n-gram of the words, with the number of rows a word: arrays (rows, words' ends)."""
    n = np.diff(offsets)
    size = n + 2
    ends = np.cumsum(size)
    first = ends - size
    padded = np.zeros(ends[-1], np.uint64)
    inside = np.ones(len(padded), bool)
    inside[first] = inside[ends - 1] = False
    padded[inside] = data
    padded[first], padded[ends - 1] = 1, 2
    last = np.repeat(ends, size) - np.arange(len(padded))
    rows = []
    code = padded.copy()
    shift = np.uint64(64 - BITS)
    for k in (2, 3):
        code[: 1 - k or None] += padded[k - 1 :] << np.uint64(8 * (k - 1))
        h = ((code + np.uint64(k << 56)) * np.uint64(0x9E3779B97F4A7C15)) >> shift
        rows.append(np.where(last >= k, h, 1 << BITS).astype(np.int32))
    table = np.stack(rows, 1).ravel()
    extra = []
    low, high = offsets[:-1], offsets[1:]
    for k in (4, 5):
        cut = np.minimum(n, k)
        for seed, (a, b) in enumerate(((low, low + cut), (high - cut, high))):
            extra.append(((span_hashes(data, a, b) + np.uint64(2 * k + seed)) * np.uint64(0xD6E8FEB86659FD93)) >> shift)
    extra.append((span_hashes(data, low, high) * np.uint64(0xA0761D6478BD642F)) >> shift)
    return table, 2 * first, np.stack(extra, 1).astype(np.int32)


def _distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    words, index = distinct_spans(LOWER[buf], starts, ends)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0], index


def _emissions(features, weights: np.ndarray) -> np.ndarray:
    table, first, extra = features
    return np.add.reduceat(weights[table], first, axis=0) + weights[extra].sum(1)


def _weights(scores: np.ndarray, transitions: np.ndarray):
    """Factors of words and of moves, scaled so that none overflows."""
    return np.exp((scores - scores.max(2, keepdims=True)).astype(np.float64)), np.exp(transitions - transitions.max())


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None):
    """Marginals (S, T, L) of chains with emission scores (S, T, L), and the sum of pairwise marginals if asked for.

    Chains may be parts of longer ones: `before` has the forward message of the word before a chain (zeros: there is
    none), `after` the backward message of a chain's last word.
    """
    s, t, _ = scores.shape
    x, m = _weights(scores, transitions)
    alpha = np.empty_like(x)
    start = x[:, 0]
    if before is not None:
        inner = before.any(1)
        start = np.where(inner[:, None], (before @ m) * start, start)
    alpha[:, 0] = start / start.sum(1, keepdims=True)
    for i in range(1, t):
        a = (alpha[:, i - 1] @ m) * x[:, i]
        alpha[:, i] = a / a.sum(1, keepdims=True)
    out = np.empty_like(x)
    last = np.ones_like(x[:, 0]) if after is None else after
    beta = last
    p = alpha[:, t - 1] * beta
    out[:, t - 1] = p / p.sum(1, keepdims=True)
    total = np.zeros_like(m)
    for i in range(t - 2, -1, -1):
        ahead = x[:, i + 1] * beta
        alive = (lengths > i + 1)[:, None]
        if pairs:
            both = alpha[:, i, :, None] * m * ahead[:, None, :]
            both /= both.sum((1, 2), keepdims=True)
            total += (both * alive[:, :, None]).sum(0)
        b = ahead @ m.T
        beta = np.where(alive, b / b.sum(1, keepdims=True), last)
        p = alpha[:, i] * beta
        out[:, i] = p / p.sum(1, keepdims=True)
    return (out, total) if pairs else out


def transfers(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What a part of a chain does to messages: (S, L, L), the product of its words' matrices, scaled. The first part
    of a text has no move into its first word."""
    s, t, k = scores.shape
    x, m = _weights(scores, transitions)
    out = np.where(first[:, None, None], np.eye(k), m) * x[:, 0, None, :]
    for i in range(1, t):
        alive = (lengths > i)[:, None, None]
        out = np.where(alive, (out @ m) * x[:, i, None, :], out)
        out /= out.max((1, 2), keepdims=True)
    return out


def messages(transfer: np.ndarray, text: np.ndarray):
    """Forward messages into and backward messages out of the parts of texts, part by part; zeros before the first."""
    parts, k = transfer.shape[:2]
    before, after = np.zeros((parts, k)), np.ones((parts, k))
    start = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    count = np.diff(np.append(start, parts))
    for nth in range(1, int(count.max(initial=0))):
        own = start[count > nth] + nth
        ahead = np.where(before[own - 1].any(1)[:, None], before[own - 1], 1.0)
        now = (ahead[:, None, :] @ transfer[own - 1])[:, 0]
        before[own] = now / now.sum(1, keepdims=True)
        back = start[count > nth] + count[count > nth] - 1 - nth
        now = (transfer[back + 1] @ after[back + 1][:, :, None])[:, :, 0]
        after[back] = now / now.sum(1, keepdims=True)
    return before, after


def _chains(first: np.ndarray, size: int):
    """Starts and lengths of the chains of texts, and each one's text."""
    counts = np.diff(first)
    per = -(-counts // size)
    text = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    starts = first[:-1][text] + nth * size
    return starts, np.minimum(size, first[1:][text] - starts), text


def train(texts: list[str], languages: list[str], chains: int = 6000, epochs: int = 6, rate: float = 0.3, mixed: float = 0.3, size: int = 32, seed: int = 7) -> Model:
    """Fits weights and transitions by Adagrad on the log-likelihood of chains of at most `size` words."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros(((1 << BITS) + 1, 0)), np.zeros((0, 0)))
    labels = np.array([names.index(x) for x in languages])
    rng = np.random.Generator(np.random.PCG64(seed))
    buf, offsets = text_buffer(pa.array(texts, pa.large_string()))
    starts, ends, first = words_of(buf, offsets)
    weights, moves = np.zeros(((1 << BITS) + 1, len(names))), np.zeros((len(names), len(names)))
    if not len(starts):
        return Model(names, weights, moves)
    data, at, index = _distinct(buf, starts, ends)
    table, row, extra = _features(data, at)
    begin, length, text = _chains(first, size)
    pick = rng.permutation(len(begin))[:chains]
    begin, length, label = begin[pick], length[pick], labels[text[pick]]
    rows_of = np.append(row, len(table))
    square, square_moves = np.full_like(weights, 1e-3), np.full_like(moves, 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(begin))
        for lo in range(0, len(order), 256):
            own = order[lo : lo + 256]
            n, y = length[own], np.repeat(label[own][:, None], size, 1)
            grid = begin[own][:, None] + np.arange(size)
            other = rng.permutation(own)
            half = size // 2
            mix = (rng.random(len(own)) < mixed) & (n == size) & (length[other] == size)
            grid[mix, half:] = (begin[other][:, None] + np.arange(half))[mix]
            y[mix, half:] = label[other][mix][:, None]
            valid = np.arange(size) < n[:, None]
            words = index[np.minimum(grid, len(index) - 1)]
            used, place = np.unique(words[valid], return_inverse=True)
            lengths = rows_of[used + 1] - rows_of[used]
            flat = np.repeat(rows_of[used] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            mine = (table[flat], np.cumsum(lengths) - lengths, extra[used])
            scores = np.zeros((*valid.shape, len(names)))
            scores[valid] = _emissions(mine, weights)[place]
            post, pairs = marginals(scores, n, moves, True)
            slope = post[valid]
            slope[np.arange(len(slope)), y[valid]] -= 1
            word_slope = np.stack([np.bincount(place, slope[:, j], len(used)) for j in range(len(names))], 1)
            every = np.concatenate([mine[0], mine[2].ravel()])
            of = np.concatenate([np.repeat(np.arange(len(used)), lengths), np.repeat(np.arange(len(used)), extra.shape[1])])
            step = np.stack([np.bincount(every, word_slope[of, j], len(weights)) for j in range(len(names))], 1) / len(own)
            step[-1] = 0
            square += step**2
            weights -= rate * step / np.sqrt(square)
            actual = np.zeros_like(moves)
            np.add.at(actual, (y[:, :-1][valid[:, 1:]], y[:, 1:][valid[:, 1:]]), 1)
            turn = (pairs - actual) / len(own)
            square_moves += turn**2
            moves -= rate * turn / np.sqrt(square_moves)
    weights[-1] = 0
    return Model(names, weights.astype(np.float32), moves)


def label_block(model: Model, buf: np.ndarray, offsets: np.ndarray):
    """Marginals (words, L) of all words of texts, with starts, ends and first words."""
    starts, ends, first = words_of(buf, offsets)
    out = np.zeros((len(starts), len(model.languages)))
    if len(starts) and model.languages:
        data, at, index = _distinct(buf, starts, ends)
        scores = _emissions(_features(data, at), model.weights)
        begin, length, text = _chains(first, CHAIN)
        moves, rank = model.transitions, np.argsort(length, kind="stable")

        def blocks(chosen):
            for lo in range(0, len(chosen), 2048):
                own = chosen[lo : lo + 2048]
                grid = begin[own][:, None] + np.arange(length[own].max())
                yield own, grid, scores[index[np.minimum(grid, len(index) - 1)]]

        nth = np.arange(len(text)) - np.searchsorted(text, text)
        several = np.bincount(text)[text] > 1
        transfer = np.ones((len(text), moves.shape[0], moves.shape[0]))
        for own, _, given in blocks(rank[several[rank]]):
            transfer[own] = transfers(given, length[own], moves, nth[own] == 0)
        before, after = messages(transfer, text)
        for own, grid, given in blocks(rank):
            valid = np.arange(grid.shape[1]) < length[own][:, None]
            out[grid[valid]] = marginals(given, length[own], moves, before=before[own], after=after[own])[valid]
    return out, starts, ends, first


def has_letter(column, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a Unicode letter."""
    count = np.concatenate([[0], np.cumsum(ASCII_LETTER[buf])])
    found = count[offsets[1:]] > count[offsets[:-1]]
    for i in np.flatnonzero(~found & (offsets[1:] > offsets[:-1])):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return found


def sample(df: DataFrame, text: str, language: str, key: str, per_language: int) -> tuple[list[str], list[str]]:
    """About `per_language` documents a language, by a hash of the key, of at most LANGUAGES languages, the most frequent
    ones, and of each document at most CHARACTERS characters: a bound on what is collected, in rows and in bytes."""
    rows = df.where(F.col(text).isNotNull() & F.col(language).isNotNull())
    counts = rows.groupBy(F.col(language).alias("name")).count().orderBy(F.desc("count"), "name").limit(LANGUAGES)
    share = {r["name"]: per_language / r["count"] for r in counts.collect()}
    if not share:
        return [], []
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col(language))
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_003)) / F.lit(1_000_003)
    drawn = rows.where(draw < wanted).select(F.substring(F.col(text), 1, CHARACTERS).alias("t"), F.col(language).alias("l"), F.col(key).alias("k"), draw.alias("d"))
    found = drawn.orderBy("d", "l", "t").limit(2 * per_language * len(share)).collect()
    found.sort(key=lambda r: (str(r["k"]), r["t"], r["l"]))
    return [r["t"] for r in found], [r["l"] for r in found]


def fit(df: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", per_language: int = 200, **training) -> Model:
    """Learns from labelled rows of a table; see `sample` and `train` for the bounds."""
    return train(*sample(df, text, language, key, per_language), **training)


def identify(df: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the language of each whole text and its mean marginal."""
    own = [c for c in df.columns if c not in (out, score)]
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        learned: Model = shared.value
        names = np.array([*learned.languages, "und"], object)
        for batch in batches:
            for part in chunks(batch, text, 1 << 20):
                column = part.column(text)
                buf, offsets = text_buffer(column)
                post, _, _, first = label_block(learned, buf, offsets)
                known = has_letter(column, buf, offsets) & bool(learned.languages) & (first[1:] > first[:-1])
                best, share = np.full(len(known), len(names) - 1), np.zeros(len(known))
                if known.any():
                    total = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, axis=0)])
                    mean = ((total[first[1:]] - total[first[:-1]]) / np.maximum(first[1:] - first[:-1], 1)[:, None])[known]
                    best[known], share[known] = mean.argmax(1), np.clip(mean.max(1), 0, 1)
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array(names[best], pa.string()), pa.array(share)], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in own]).transform(in_arrow, run, schema)


def spans(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Runs of words with one label in each text: key, lang, first_word, n_words, start_byte, end_byte."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        learned: Model = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                buf, offsets = text_buffer(part.column("text"))
                post, starts, ends, first = label_block(learned, buf, offsets)
                if not len(starts) or not learned.languages:
                    continue
                label = post.argmax(1)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                new = np.r_[True, (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]
                at = np.flatnonzero(new)
                to = np.r_[at[1:], len(label)]
                yield pa.RecordBatch.from_arrays(
                    [pc.take(part.column("key"), pa.array(doc[at])), pa.array(np.array(learned.languages, object)[label[at]], pa.string()), pa.array(at - first[doc[at]]), pa.array(to - at), pa.array(starts[at] - offsets[doc[at]]), pa.array(ends[to - 1] - offsets[doc[at]])],
                    names=[key, "lang", "first_word", "n_words", "start_byte", "end_byte"],
                )

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).transform(in_arrow, run, f"`{key}` {kind}, lang string, first_word long, n_words long, start_byte long, end_byte long")


def held_out(key: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether a row is kept out of training, by the CRC-32 of its key as text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == fold


def op3_language(spark, sf_dir: str, per_language: int = 200) -> DataFrame:
    """Languages of all documents, learned from those whose CRC-32 is not 0 modulo 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), per_language=per_language)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
