"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text are densities and rates only: hits of a lexicon (strong, weak, obfuscated, densest window),
their proximity to words of the second person, capitals, punctuation, obfuscation and repeated letters. The
lexicon itself is learned: words, and starts and ends of words, whose document frequency in toxic training
rows is far above that in the others. Trees are fitted by histogram on features from lexicons of other folds,
so that the lexicon's fit doesn't leak; out-of-fold margins give the isotonic calibration.

Training collects a bounded sample: about `per_class` rows a class, the first by a hash of the key and at most four
times as many, with CHARACTERS characters of each text, weighted back to their number. Scores are of whole texts.

Defined results: a null or empty text is scored as one without words; where labels lack one of the classes the
score is the share of toxic rows, 0 if there are none; equal texts, repeated rows too, have equal scores; very long
texts are taken whole; an empty table gives none; other columns pass
through unless they bear an output's name, in which case the output replaces them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, chunks, distinct_spans, text_buffer, word_spans
from .spark_util import in_arrow

#: Words of the second person and look-alikes of letters.
SECOND = frozenset("you your yours yourself u ur ya du dich dir dein deine deinen deinem ihr euch tu te toi ton ta tes vous votre vos usted ustedes tus ti os vosotros".split())
LOOKALIKE = str.maketrans("01345$7@!|", "oieasstail")
FEATURES = ["strong", "strong_log", "weak", "top", "window", "near_second", "second", "obfuscated_hits", "obfuscation", "capitals", "shouted", "exclaimed", "pointed", "repeated", "length"]
EDGE = ".,;:!?\"'()[]{}<>|*_-#%&$@/\\~+=…“”‘’«»¡¿"
JOINED = frozenset("'’-")
_TRIM, _UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_TRIM[list(b".,;:()[]{}<>\"'|")] = True
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(192, 256)]] = True
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_DOUBLE = re.compile(r"(.)\1+")


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    trees: list[tuple] = field(default_factory=list)
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] | None = None
    constant: float | None = None


#: Characters of a training text.
CHARACTERS = 50_000


def keys(word: str) -> list[str]:
    """A word's entries in a lexicon: itself, its starts and its ends."""
    n = len(word)
    return [word, *(word[:k] + "*" for k in range(3, min(8, n))), *("*" + word[-k:] for k in range(4, min(8, n)))]


def count_entries(words_of: list[set[str]], memo: dict[str, list[str]]) -> dict[str, int]:
    """In how many texts each entry occurs."""
    out: dict[str, int] = {}
    for words in words_of:
        found: set[str] = set()
        for w in words:
            own = memo.get(w)
            if own is None:
                own = memo[w] = keys(w)
            found.update(own)
        for k in found:
            out[k] = out.get(k, 0) + 1
    return out


def learn_lexicon(toxic: dict[str, int], other: dict[str, int], n1: int, n0: int, least: int = 3, odds: float = 8.0) -> dict[str, float]:
    """Entries with their log odds; `least` toxic rows and odds of `odds` make one, unless a shorter one says as much."""
    out = {}
    n1, n0 = max(1, n1), max(1, n0)
    for k, n in toxic.items():
        if n >= least:
            weight = float(np.log((n + 0.1) / n1 / ((other.get(k, 0) + 0.5 * max(1.0, n0 / n1)) / n0)))
            if weight >= np.log(odds):
                out[k] = weight
    for k in list(out):
        shorter = [k[: i] + "*" for i in range(3, len(k) - 1)] if k[0] != "*" else ["*" + k[-i:] for i in range(4, len(k) - 1)]
        if any(out.get(x, -1) >= out[k] - 1e-9 for x in shorter if x != k):
            out[k] = -out[k]
    return {k: w for k, w in out.items() if w > 0}


class Words:
    """What is known of distinct words: lexicon weight, second person, obfuscation and so on."""

    def __init__(self, lexicon: dict[str, float], most: int = 600_000):
        self.lexicon, self.most = lexicon, most
        self.strong = max(lexicon.values(), default=0.0) * 0.6
        self.starts = {k[:3] for k in lexicon if k[0] != "*"}
        self.ends = {k[-4:] for k in lexicon if k[0] == "*"}
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1024, 5), np.float32)

    def weight(self, word: str) -> float:
        if word[:3] not in self.starts and word[-4:] not in self.ends:
            return 0.0
        return max([self.lexicon.get(k, 0.0) for k in keys(word)])

    def facts(self, raw: bytes) -> tuple:
        word = raw.decode("utf-8", "replace").strip(EDGE).lower()
        if word.isalpha():
            weight = self.weight(word)
            if weight or not _TRIPLE.search(word):
                return weight, word in SECOND, 0.0, 0.0, 0.0
            return weight, 0.0, self.weight(_DOUBLE.sub(r"\1", word)), 0.0, 1.0
        if not any(c.isalpha() for c in word):
            return 0.0, 0.0, 0.0, 0.0, 0.0
        weight = self.weight(word)
        plain = "".join(c for c in raw.decode("utf-8", "replace").lower().translate(LOOKALIKE).strip(EDGE) if c.isalpha())
        hidden = 0.0 if weight else self.weight(plain)
        return weight, word in SECOND, hidden, float(not JOINED.intersection(word)), float(_TRIPLE.search(word) is not None)

    def lookup(self, strings: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        new = [s for s in strings if s not in self.known]
        if new:
            base = len(self.known)
            need = base + len(new)
            if need > len(self.table):
                grown = np.zeros((2 * need, 5), np.float32)
                grown[:base] = self.table[:base]
                self.table = grown
            self.table[base:need] = [self.facts(s) for s in new]
            self.known.update(zip(new, range(base, need), strict=True))
        return self.table[np.fromiter(map(self.known.__getitem__, strings), np.int64, len(strings))]


def featurise(words: Words, buf: np.ndarray, offsets: np.ndarray, window: int = 50, near: int = 5) -> np.ndarray:
    """Dense features (texts, FEATURES) of whole texts."""
    docs = len(offsets) - 1
    out = np.zeros((docs, len(FEATURES)))
    starts, ends, first = word_spans(buf, offsets)
    if not len(starts):
        return out
    a, z = starts.copy(), ends.copy()
    for _ in range(2):
        a += (z - a > 1) & _TRIM[buf[a]]
        z -= (z - a > 1) & _TRIM[buf[z - 1]]
    distinct, index = distinct_spans(LOWER[buf], a, z)
    facts = words.lookup(distinct.to_numpy(zero_copy_only=False).tolist())[index]
    n = np.diff(first)
    count = np.maximum(n, 1)

    def total(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
        return sums[first[1:]] - sums[first[:-1]]

    weight, hidden = facts[:, 0], facts[:, 2]
    strong = (weight >= words.strong) & (weight > 0)
    hit = (weight > 0) | (hidden > 0)
    full = np.flatnonzero(n)
    out[:, 0] = total(strong) / count
    out[:, 1] = np.log1p(total(strong))
    out[:, 2] = total((weight > 0) & ~strong) / count
    out[full, 3] = np.maximum.reduceat(np.maximum(weight, hidden), first[:-1][full])
    cum = np.concatenate([[0], np.cumsum(hit)])
    at = np.arange(len(hit))
    doc = np.repeat(np.arange(docs), n)
    out[full, 4] = np.maximum.reduceat(cum[np.minimum(at + window, first[1:][doc])] - cum[at], first[:-1][full])
    second = np.flatnonzero(facts[:, 1])
    hits = np.flatnonzero(hit)
    if len(second) and len(hits):
        place = np.searchsorted(second, hits)
        close = np.zeros(len(hits), bool)
        for other in (second[np.maximum(place - 1, 0)], second[np.minimum(place, len(second) - 1)]):
            close |= (np.abs(other - hits) <= near) & (doc[other] == doc[hits])
        out[:, 5] = np.bincount(doc[hits], close, docs)
    out[:, 6] = total(facts[:, 1]) / count
    out[:, 7] = total(hidden > 0) / count
    out[:, 8] = total(facts[:, 3]) / count
    upper, letters = (np.concatenate([[0], np.cumsum(t[buf])]) for t in (_UPPER, _LETTER))
    out[:, 9] = (upper[offsets[1:]] - upper[offsets[:-1]]) / np.maximum(letters[offsets[1:]] - letters[offsets[:-1]], 1)
    capitals = upper[ends] - upper[starts]
    out[:, 10] = total((capitals > 2) & (capitals == letters[ends] - letters[starts])) / count
    size = np.maximum(np.diff(offsets), 1)
    for j, marks in ((11, b"!?"), (12, b".,;:!?#$%&*@")):
        table = np.zeros(256, bool)
        table[list(marks)] = True
        sums = np.concatenate([[0], np.cumsum(table[buf])])
        out[:, j] = (sums[offsets[1:]] - sums[offsets[:-1]]) / size
    out[:, 13] = total(facts[:, 4]) / count
    out[:, 14] = np.log1p(n)
    return out


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], 1)


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0, least: float = 2.0):
    """Trees as (features, thresholds, leaves) in heap order, bin edges and the base margin, for logistic loss."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
    edges = [np.unique(np.concatenate([e, [np.nextafter(0, 1)]])) for e in edges]
    b = _bins(x, edges)
    share = np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin, made = np.full(len(y), base), []
    nodes, width = 2**depth - 1, max(map(len, edges)) + 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-9)
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, width, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            lo, k = 2**level - 1, 2**level
            best = np.zeros(k)
            for j in range(x.shape[1]):
                cell = (node - lo) * width + b[:, j]
                gs = np.cumsum(np.bincount(cell, g, k * width).reshape(k, width), 1)
                hs = np.cumsum(np.bincount(cell, h, k * width).reshape(k, width), 1)
                G, H = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (G - gs) ** 2 / (H - hs + l2) - G**2 / (H + l2)
                gain[(hs < least * 0.05) | (H - hs < least * 0.05)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(k), top] > best + 1e-9
                best = np.where(better, gain[np.arange(k), top], best)
                feature[lo : lo + k][better] = j
                cut[lo : lo + k][better] = top[better]
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - nodes
        value = -rate * np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + l2)
        margin += value[leaf]
        made.append((feature, cut, value))
    return made, edges, base


def margins(model: Model, x: np.ndarray) -> np.ndarray:
    b = _bins(x, model.edges)
    out, rows = np.full(len(x), model.base), np.arange(len(x))
    for feature, cut, value in model.trees:
        node = np.zeros(len(x), np.int64)
        while len(node) and node[0] < len(feature):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        out += value[node - len(feature)]
    return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: block centres and their values, ascending."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], w[order], strict=True):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def calibrated(model: Model, margin: np.ndarray) -> np.ndarray:
    """Scores: the isotonic value, with a hundredth of the logistic one so that the order of margins stays."""
    plain = 1 / (1 + np.exp(-margin))
    return np.clip(0.99 * np.interp(margin, *model.steps) + 0.01 * plain, 0, 1)


def train(texts: list[str], toxic: list[int], weight: list[float], folds: int = 4) -> Model:
    """Lexicon, trees and calibration from labelled texts."""
    y, w = np.array(toxic, bool), np.array(weight, float)
    if not y.any() or y.all():
        return Model(constant=float((w * y).sum() / w.sum()) if len(y) else 0.0)
    sets = [{x.strip(EDGE).lower() for x in t.split()} - {""} for t in texts]
    fold = np.zeros(len(y), np.int64)
    for value in (False, True):
        own = np.flatnonzero(y == value)
        fold[own] = np.arange(len(own)) % folds
    memo: dict[str, list[str]] = {}
    counts = {(k, v): count_entries([sets[i] for i in np.flatnonzero((fold == k) & (y == v))], memo) for k in range(folds) for v in (False, True)}

    def learned(left_out: int) -> dict[str, float]:
        toxic: dict[str, int] = {}
        for k in range(folds):
            if k != left_out:
                for entry, n in counts[k, True].items():
                    toxic[entry] = toxic.get(entry, 0) + n
        other = {e: sum(counts[k, False].get(e, 0) for k in range(folds) if k != left_out) for e, n in toxic.items() if n >= 3}
        rest = fold != left_out
        return learn_lexicon(toxic, other, int((y & rest).sum()), int((~y & rest).sum()))

    x = np.zeros((len(y), len(FEATURES)))
    for k in range(folds):
        own = np.flatnonzero(fold == k)
        words = Words(learned(k))
        for lo in range(0, len(own), 512):
            part = own[lo : lo + 512]
            x[part] = featurise(words, *text_buffer(pa.array([texts[i] for i in part], pa.large_string())))
    outside = np.zeros(len(y))
    for k in range(folds):
        trees, edges, base = boost(x[fold != k], y[fold != k], w[fold != k])
        outside[fold == k] = margins(Model(trees=trees, edges=edges, base=base), x[fold == k])
    trees, edges, base = boost(x, y, w)
    return Model(learned(-1), trees, edges, base, isotonic(outside, y.astype(float), w))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 1000) -> Model:
    """Learns from labelled rows (label 0 or 1; others and nulls are left out)."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not counts:
        return train([], [], [])
    share = {y: min(1.0, per_class / n) for y, n in counts.items()}
    draw = F.pmod(F.xxhash64("k"), F.lit(1_000_003)) / F.lit(1_000_003)
    picked = rows.where(draw < F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))).orderBy(draw, "k", "y").limit(4 * per_class)
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.substring(F.col(text), 1, CHARACTERS).alias("t"))
    found = texts.join(F.broadcast(picked), "k").select("k", "t", "y").orderBy("k", "t", "y").limit(8 * per_class).collect()
    found.sort(key=lambda r: (str(r["k"]), r["t"], r["y"]))
    return train([r["t"] for r in found], [r["y"] for r in found], [1 / share[r["y"]] for r in found])


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the calibrated probability of each whole text's being toxic."""
    own = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField(out, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        learned: Model = shared.value
        words = Words(learned.lexicon)
        for batch in batches:
            for part in chunks(batch, text, 2 << 20):
                if learned.constant is not None:
                    found = np.full(part.num_rows, learned.constant)
                else:
                    found = calibrated(learned, margins(learned, featurise(words, *text_buffer(part.column(text)))))
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array(found, pa.float64())], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in own]).transform(in_arrow, run, schema)


def held_out(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op10_toxicity(spark, sf_dir: str, per_class: int = 1000) -> DataFrame:
    """Toxicity of all documents, learned from labels whose CRC-32 is not 2 modulo 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = score(docs, fit(docs, labels.where(~held_out()), per_class=per_class))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
