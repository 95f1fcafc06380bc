"""Exact n-gram Jaccard self-join by prefix tree, and the groups it links.

Texts are sets of word n-grams in one global order: n-grams that repeat within blocks last, by the order of magnitude
of their number of texts, else by hash. Equal sets are one class. Two sets of which 100 * intersection >= percent *
union share one of their first n - ceil(percent * n / 100) + 1 n-grams, so only these are posted.

* Families: short postings (at most `full_run` classes) give all their pairs whose sizes allow a link and whose
  histograms of hashes do (about a quarter byte an n-gram; the sum of their differences is at most the size of the
  symmetric difference). Of a longer posting only a spanning forest of such pairs is written. The connected
  components of all these are families: two classes that link are in one family.
* Prefix-tree join: each class's set goes to its family once. A family's sets are stored in a trie, and all its sets
  are sent down that trie together; a branch's overlaps are counted once for all rows below it, and a set leaves a
  branch where the n-grams left of either side can't reach the overlap needed. Nothing but a star for each group of
  linked sets leaves the task. Families of more than `side` classes (or 32 KB a class) are dealt out by pairs of
  blocks, so that memory is bounded.
* Links are united by distributed union-find.

No pair of a family is written, and no link between different texts is lost. The list of frequent n-grams is bounded:
at most `hot_limit` are collected, and any list gives a valid order, so the result doesn't depend on it.

Defined results: a null text or one without words has an empty set and links with nothing; a text of fewer than
`gram` words has its whole sequence as its one n-gram; very long texts are taken whole; ids must be integers, a null
id stays alone with a null component unless a text equals it; repeated rows are one class; an empty table gives none;
other columns pass through, whatever their names, but for n_shingles and component_id, which are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, Seen, chunks, mix, range_hashes, release, span_hashes, text_buffer, window_hashes, word_spans
from .spark_util import Sieve, components, contracted, discard, forest, fresh, in_arrow, materialize


def gram_sets(part: pa.RecordBatch, gram: int, column: str = "text"):
    """Distinct n-gram hashes of each text, ascending within it, and their offsets."""
    buf, offsets = text_buffer(part.column(column))
    starts, ends, first = word_spans(buf, offsets)
    words = span_hashes(LOWER[buf], starts, ends)
    n = np.diff(first)
    count = np.where(n >= gram, n - gram + 1, np.minimum(n, 1))
    whole = window_hashes(words, gram)
    doc = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
    hashes = np.zeros(len(doc), np.uint64)
    long = n[doc] >= gram
    hashes[long] = whole[place[long]]
    short = np.flatnonzero((n > 0) & (n < gram))
    if len(short):
        hashes[~long] = range_hashes(words, first[:-1][short], first[1:][short])
    order = np.lexsort((hashes, doc))
    hashes = hashes[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, bool)
    return hashes[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def _frequent(gram: int):
    """N-grams that two texts of a block or more have, with the number of texts in such blocks of a partition."""

    def run(batches):
        h, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in chunks(batch):
                hashes = np.sort(gram_sets(part, gram)[0])
                first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
                size = np.diff(np.append(first, len(hashes)))
                again = size > 1
                h, n = np.concatenate([h, hashes[first[again]]]), np.concatenate([n, size[again]])
                if len(h) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])
                    h, n = h[:0], n[:0]
        h, at = np.unique(h, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(at, n, len(h)).astype(np.int64))], names=["h", "n"])

    return run


def _profiles(gram: int, percent: int, hot):
    """(id, dk, n, d1, prefix, bins): set size, a digest of the set, its first n-grams in the global order and its histogram."""

    def run(batches):
        frequent, rank = hot.value
        for batch in batches:
            for part in chunks(batch, most=1 << 20):
                hashes, offsets = gram_sets(part, gram)
                n = np.diff(offsets)
                doc = np.repeat(np.arange(len(n)), n)
                sums = []
                for seed in (1, 2):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + np.uint64(seed * 0x1234567)))])
                    sums.append(mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64)).view(np.int64))
                if len(frequent) and len(hashes):
                    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
                    order = np.lexsort((np.where(frequent[at] == hashes, rank[at], 0), doc))  # stable: by hash within
                    hashes = hashes[order]
                once = np.zeros(len(n), bool)
                once[np.unique(np.stack(sums, 1), axis=0, return_index=True)[1]] = True  # equal sets of a block post once
                length = np.where((n > 0) & once, n - -(-percent * n // 100) + 1, 0)
                place = np.arange(len(hashes)) - np.repeat(offsets[:-1], n)
                prefix = hashes[place < length[doc]]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(prefix.view(np.int64)))
                bins = histograms(hashes, doc, np.where(once, n, 0), mask=np.repeat(once, n))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("dk"), pa.array(n), pa.array(sums[0]), lists, bins], names=["id", "dk", "n", "d1", "prefix", "bins"])

    return run


def histograms(hashes: np.ndarray, doc: np.ndarray, n: np.ndarray, mask=None, load: int = 4) -> pa.Array:
    """Each set's n-grams counted by the low bits of their hashes, a byte a bin, in 2**k bins of at most `load` on average.

    Sets of n = 0 have none. Counts over 255 stay at 255. A histogram's halves add up to that of half as many bins, and
    the sum of differences of two is at most the size of the sets' symmetric difference.
    """
    width = np.where(n > 0, 1 << np.ceil(np.log2(np.maximum(n / load, 8))).astype(np.int64), 0)
    offsets = np.concatenate([[0], np.cumsum(width)])
    if mask is not None:
        hashes, doc = hashes[mask], doc[mask]
    place = offsets[doc] + (hashes & (width[doc] - 1).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(place, minlength=offsets[-1]), 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(counts)])


def _within(percent: int):
    """Pairs (a, b) whose histograms allow a link: with a symmetric difference of d, 100 (n + m - d) >= percent (n + m + d)."""

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "bins_a", 1 << 20):
                both = [text_buffer(batch.column(c)) for c in ("bins_a", "bins_b")]
                sizes = [np.diff(offsets) for _, offsets in both]
                total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
                keep = np.zeros(batch.num_rows, bool)
                for w, v in np.unique(np.stack(sizes, 1), axis=0):
                    rows = np.flatnonzero((sizes[0] == w) & (sizes[1] == v))
                    least = min(w, v)
                    for at in range(0, len(rows), max(1, (1 << 20) // max(w, v))):
                        own = rows[at : at + max(1, (1 << 20) // max(w, v))]
                        left, right = (buf[offsets[own][:, None] + np.arange(k)].reshape(len(own), -1, least).sum(1, dtype=np.int32) for (buf, offsets), k in zip(both, (w, v), strict=True))
                        apart = np.abs(left - right).sum(1)
                        keep[own] = 100 * (total[own] - apart) >= percent * (total[own] + apart)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _candidates(percent: int, full_run: int):
    """From postings (h, node, n) of a partition, in order of h, n and node: pairs (a, b, null, null), and of long
    postings the rows (node, null, h, n).

    Postings of at most `full_run` classes give all their pairs whose sizes allow a link. Rows are taken as they come:
    of a posting that goes on, at most 2 * `full_run` are held.
    """

    def pairs(h, node, n, long):
        if not len(h):
            return
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.append(first, len(h)))
        wide = size > full_run
        wide[0] |= long
        wide = np.repeat(wide, size)
        for far in range(1, min(int(size.max()), full_run)):
            i = np.flatnonzero((h[far:] == h[:-far]) & (100 * n[:-far] >= percent * n[far:]) & ~wide[far:])
            for at in range(0, len(i), 100_000):
                a, b = node[i[at : at + 100_000]], node[i[at : at + 100_000] + far]
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none], names=["a", "b", "h", "n"])
        if wide.any():
            yield pa.RecordBatch.from_arrays([pa.array(node[wide]), pa.nulls(int(wide.sum()), pa.int64()), pa.array(h[wide]), pa.array(n[wide])], names=["a", "b", "h", "n"])

    def run(batches):
        h, node, n, long, goes_on = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), False, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if not len(h):
                long = long and batch.column("h")[0].as_py() == goes_on
            h, node, n = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((h, "h"), (node, "node"), (n, "n")))
            turn = np.flatnonzero(h[1:] != h[:-1])
            last = int(turn[-1]) + 1 if len(turn) else 0  # the posting that may go on
            if last:
                yield from pairs(h[:last], node[:last], n[:last], long)
                h, node, n, long = h[last:], node[last:], n[last:], False
            if len(h) > 2 * full_run or long:
                yield from pairs(h, node, n, True)
                goes_on, long = h[-1], True
                h, node, n = h[:0], node[:0], n[:0]
        yield from pairs(h, node, n, long)

    return run


def feasible_forest(bins: list[np.ndarray], n: np.ndarray, percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """Edges (i, j) of a spanning forest of the pairs whose sizes and histograms allow a link.

    With `side`, only pairs of different sides count. A search from class to class compares each with those that no
    search has reached, so a dense group costs little more than its size.
    """
    order = np.argsort(n, kind="stable")
    widths = np.array([len(x) for x in bins])
    flat = {w: np.stack([bins[i].astype(np.int32) for i in np.flatnonzero(widths == w)]) for w in np.unique(widths)}
    where = np.zeros(len(n), np.int64)
    for w in flat:
        where[widths == w] = np.arange((widths == w).sum())
    left = np.ones(len(n), bool)
    edges = []
    for start in order:
        if not left[start]:
            continue
        left[start] = False
        todo = [int(start)]
        while todo:
            i = todo.pop()
            near = left & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if side is not None:
                near &= side != side[i]
            own = flat[widths[i]][where[i]]
            for w in np.unique(widths[near]):
                j = np.flatnonzero(near & (widths == w))
                other, k = flat[w][where[j]], min(w, widths[i])
                apart = np.abs(other.reshape(len(j), -1, k).sum(1) - own.reshape(-1, k).sum(0)).sum(1)
                j = j[100 * (n[j] + n[i] - apart) >= percent * (n[j] + n[i] + apart)]
                edges += [(i, int(x)) for x in j]
                left[j] = False
                todo += j.tolist()
    return np.array(edges, np.int64).reshape(-1, 2)


def grouped(batches, keys: list[str], columns: list[str]):
    """(key, lists of the columns' values) of each group of consecutive rows; binary values as arrays of bytes."""
    now, held = None, None
    for batch in batches:
        own = [batch.column(c).to_numpy() for c in keys]
        values = []
        for c in columns:
            if pa.types.is_binary(batch.column(c).type):
                buf, at = text_buffer(batch.column(c))
                values.append([buf[a:b].copy() for a, b in zip(at[:-1], at[1:], strict=True)])
            else:
                values.append(batch.column(c).to_pylist())
        if not batch.num_rows:
            continue
        first = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in own], axis=0)])
        for lo, hi in zip(first, np.append(first[1:], batch.num_rows), strict=True):
            key = tuple(int(x[lo]) for x in own)
            if key != now:
                if held is not None:
                    yield now, held
                now, held = key, [[] for _ in columns]
            for into, v in zip(held, values, strict=True):
                into += v[lo:hi]
    if held is not None:
        yield now, held
    release()


def _chains(percent: int):
    """From rows (h, lo, hi, own, node, n, bins) in order, a block or two of a long posting: edges (a, b) of a spanning
    forest of its pairs that histograms allow."""

    def run(batches):
        for (_, lo, hi), (own, node, n, bins) in grouped(batches, ["h", "lo", "hi"], ["own", "node", "n", "bins"]):
            edges = feasible_forest(bins, np.array(n), percent, None if lo == hi else np.array(own))
            if len(edges):
                node = np.array(node)
                yield pa.RecordBatch.from_arrays([pa.array(node[edges[:, 0]]), pa.array(node[edges[:, 1]])], names=["a", "b"])

    return run


class Trie:
    """Ascending sequences of ranks as a trie whose branches hold a run of ranks each.

    A branch is (parent, from, to, row, lo, hi): the ranks [from:to) of a row's sequence, which the rows lo..hi-1 in
    lexicographic order share. Parents come before their children; the last branch of each row ends with it.
    """

    def __init__(self, sequences: list[np.ndarray]):
        self.order = sorted(range(len(sequences)), key=lambda i: sequences[i].astype(">u4").tobytes())
        self.rows = [sequences[i] for i in self.order]
        shared = [0]
        for one, two in zip(self.rows, self.rows[1:], strict=False):
            k = min(len(one), len(two))
            differ = np.flatnonzero(one[:k] != two[:k])
            shared.append(int(differ[0]) if len(differ) else k)
        self.branches = []
        todo = [(-1, 0, 0, len(self.rows))]
        while todo:
            parent, depth, lo, hi = todo.pop()
            ends = [lo, *(i for i in range(lo + 1, hi) if shared[i] == depth), hi]  # rows parting at this depth
            for a, b in zip(ends, ends[1:], strict=False):
                to = len(self.rows[a]) if b == a + 1 else min(shared[a + 1 : b])
                self.branches.append((parent, depth, to, a, a, b))
                if b > a + 1:
                    todo.append((len(self.branches) - 1, to, a, b))


def trie_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, room: int = 1 << 25) -> np.ndarray:
    """Pairs (i, j) of sets left[i] and right[j], or with no `right` of left[i] and left[j], that link.

    N-grams are ranked by how many of the sets have them, frequent ones first; those of one set only count for its
    length. The right sets' trie is walked once for as many left sets as `room` allows: each branch takes its parent's
    overlaps and adds its own n-grams for all rows below it, and left sets leave it where what is left of either side
    can't reach 100 * overlap >= percent * union for any row below.
    """
    sets = left + (right or [])
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), lengths)
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    several = count[gram] > 1
    owner, ranks = owner[several], rank[gram[several]]
    order = np.lexsort((ranks, owner))
    owner, ranks = owner[order], ranks[order]
    width = int((count > 1).sum())
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    known = np.diff(first)
    sequences = [ranks[first[i] : first[i + 1]] for i in range(len(sets))]
    base = len(left) if right else 0
    trie = Trie(sequences[base:])
    column = np.array(trie.order)
    row_known, row_size = known[base + column], lengths[base + column]
    place = np.empty(len(column), np.int64)  # in the trie's order
    place[column] = np.arange(len(column))
    flat = owner * (width + 1) + ranks
    out = []
    need = lambda a, b: -(-percent * (a + b) // (100 + percent))  # noqa: E731  smallest overlap o with 100 o >= percent (a + b - o)
    step = max(1, room // max(width, 1))
    for at in range(0, len(left), step):
        probes = np.arange(at, min(at + step, len(left)))
        has = np.zeros((len(probes), width), bool)
        inside = slice(first[at], first[probes[-1] + 1])
        has[owner[inside] - at, ranks[inside]] = True
        walked = {-1: (probes, np.zeros(len(probes), np.int64))}
        below = Counter(b[0] for b in trie.branches)
        for k, (parent, start, to, row, lo, hi) in enumerate(trie.branches):
            own, overlap = walked[parent]
            below[parent] -= 1
            if not below[parent]:
                del walked[parent]
            if right is None:  # each pair once
                above = place[own] < hi - 1
                own, overlap = own[above], overlap[above]
            if not len(own):
                walked[k] = own, overlap
                continue
            part = trie.rows[row][start:to]
            if len(part):
                overlap = overlap + has[np.ix_(own - at, part)].sum(1)
            rest = known[own] - (np.searchsorted(flat, own * (width + 1) + part[-1], "right") - first[own]) if len(part) else known[own]
            reach = overlap + np.minimum(int(row_known[lo:hi].max()) - to, rest)
            stay = reach >= need(lengths[own], int(row_size[lo:hi].min()))
            own, overlap = own[stay], overlap[stay]
            if hi == lo + 1:
                hit = overlap >= need(lengths[own], int(row_size[lo]))
                if right is None:
                    hit &= place[own] < lo
                out.append(np.stack([own[hit], np.full(hit.sum(), column[lo])], 1))
            else:
                walked[k] = own, overlap
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _families(percent: int):
    """From rows (family, lo, hi, own, node, set) in order, a block or two of a family: links (a, b), found by trie and
    given as a star for each of the components that they make."""

    def run(batches):
        for (_, lo, hi), (own, node, sets) in grouped(batches, ["family", "lo", "hi"], ["own", "node", "set"]):
            own, node, sets = np.array(own), np.array(node), [s.view(np.uint64) for s in sets]
            left = np.flatnonzero(own == lo)
            right = left if lo == hi else np.flatnonzero(own == hi)
            if not len(left) or not len(right):
                continue
            links = trie_links([sets[i] for i in left], None if lo == hi else [sets[i] for i in right], percent)
            if len(links):
                a, b = forest(node[left[links[:, 0]]], node[right[links[:, 1]]])
                yield pa.RecordBatch.from_arrays([pa.array(a[a != b], pa.int64()), pa.array(b[a != b], pa.int64())], names=["a", "b"])

    return run


def _sets(gram: int, wanted: Sieve):
    """(dk, set): the ascending n-gram hashes, as bytes, of each text that may be wanted and that the task hasn't met."""

    def run(batches):
        seen, count = Seen(bits=12), 0
        for batch in batches:
            keys, first = np.unique(batch.column("dk").to_numpy(), return_index=True)
            fresh = wanted.may_hold(keys)
            fresh[fresh] = seen.new(keys[fresh], np.full(fresh.sum(), count))
            count += 1
            for part in chunks(batch.take(pa.array(first[fresh]))):
                hashes, offsets = gram_sets(part, gram)
                sets = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((8 * offsets).astype(np.int32)), pa.py_buffer(hashes)])
                yield pa.RecordBatch.from_arrays([part.column("dk"), sets], names=["dk", "set"])

    return run


def class_components(docs: DataFrame, gram: int, percent: int, full_run: int, side: int, hot_limit: int) -> tuple[DataFrame, DataFrame]:
    """Profiles (id, dk, n, d1) of all of (id, dk, text), and (node, component) of classes d1 that have links."""
    spark = docs.sparkSession
    frequent = docs.transform(in_arrow, _frequent(gram), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > full_run)
    hot = frequent.orderBy(F.desc("n"), "h").limit(hot_limit).toArrow()
    h, n = hot.column("h").to_numpy().view(np.uint64), hot.column("n").to_numpy()
    order = np.argsort(h)
    listed = spark.sparkContext.broadcast((h[order], (1 + np.log2(np.maximum(n, 1)[order])).astype(np.int8)))
    profiles = materialize(docs.transform(in_arrow, _profiles(gram, percent, listed), "id long, dk long, n long, d1 long, prefix array<long>, bins binary"), "profiles", few=True)
    whole = F.struct("n", "prefix", "bins", "dk")  # one row a class, of however many blocks
    classes = profiles.where("length(bins) > 0").groupBy("d1").agg(F.first(whole).alias("x")).select(F.col("d1").alias("node"), "x.*")
    classes = materialize(classes, "classes", few=True)
    postings = classes.select(F.explode("prefix").alias("h"), "node", "n").repartition("h").sortWithinPartitions("h", "n", "node")
    found = materialize(postings.transform(in_arrow, _candidates(percent, full_run), "a long, b long, h long, n long"), "candidates", few=True)
    near = _near(classes, found.where("h is null").select("a", "b").distinct(), percent)
    long = found.where("h is not null").select("h", F.col("a").alias("node"), "n")
    long = long.join(long.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / (8 * side)).alias("sides")), "h").join(classes.select("node", "bins"), "node")
    chains = blocks(long, "h", "node", "n", "bins").transform(in_arrow, contracted(_chains(percent)), "a long, b long")
    families = materialize(components(near.union(chains), contract=False), "families", few=True)
    discard(found)
    discard(near)
    placed = classes.select("node", "n", "dk").join(families, "node")
    size = F.greatest(F.count(F.lit(1)) / side, F.sum("n") / (side * 4096))  # classes and bytes of a group are bounded
    sides = placed.groupBy("component").agg(F.ceil(size).alias("sides"))
    placed = placed.join(sides, "component").select("dk", "node", F.col("component").alias("family"), "sides")
    placed = materialize(placed, "family-members", few=True)
    sets = docs.select("dk", "text").transform(in_arrow, _sets(gram, Sieve(placed, "dk")), "dk long, set binary").dropDuplicates(["dk"]).join(placed.hint("merge"), "dk")
    dealt = blocks(sets, "family", "node", "set")
    parts = materialize(components(dealt.transform(in_arrow, contracted(_families(percent)), "a long, b long"), contract=False), "set-components", few=True)
    for table in (families, placed, classes):
        discard(table)
    return profiles, parts


def block_pairs(rows: DataFrame, group: str, node: str, *columns: str) -> DataFrame:
    """Rows (group, lo, hi, own, node, columns): each group's nodes in `sides` blocks, once for each pair of blocks."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64(node), "sides")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    return dealt.select(group, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", node, *columns)


def blocks(rows: DataFrame, group: str, node: str, *columns: str) -> DataFrame:
    """Rows (group, lo, hi, own, node, columns) in order: each group's nodes in `sides` blocks, and each pair of blocks."""
    return in_order(block_pairs(rows, group, node, *columns), group, node)


def in_order(dealt: DataFrame, group: str, node: str) -> DataFrame:
    """Rows of block_pairs, those of a pair of blocks in one partition and in order."""
    return dealt.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", node)


def _near(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose histograms allow a link: none that links is lost."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("bins").alias(f"bins_{c}"), F.col("n").alias(f"n_{c}"))
    return materialize(pairs.join(side("a"), "a").join(side("b"), "b").transform(in_arrow, _within(percent), "a long, b long"), "set-pairs", few=True)


def link_groups(df: DataFrame, key: str = "doc_id", text: str = "text", gram: int = 5, percent: int = 80, full_run: int = 8, side: int = 256, hot_limit: int = 300_000) -> DataFrame:
    """Adds n_shingles (set size) and component_id (the smallest id reachable by links) to the table."""
    dk = fresh(df, "dk")
    stands = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))
    docs = df.select(F.col(f"`{key}`").cast("long").alias("id"), stands.alias("dk"), F.col(f"`{text}`").alias("text"))
    profiles, parts = class_components(docs, gram, percent, full_run, side, hot_limit)
    placed = profiles.join(parts, profiles["d1"] == parts["node"], "left").select("id", "dk", "n", F.when(F.col("n") > 0, F.coalesce("component", "d1")).alias("part"))
    least = placed.where("part is not null").groupBy("part").agg(F.min("id").alias("least"))
    known = placed.join(least, "part", "left").groupBy("dk").agg(F.max("n").alias("n_shingles"), F.min(F.coalesce("least", "id")).alias("component_id"))
    names = [c for c in df.columns if c not in ("n_shingles", "component_id")]
    own = df.select(*[F.col(f"`{c}`") for c in names], stands.alias(dk))
    return own.join(known.withColumnRenamed("dk", dk), dk).select(*[F.col(f"`{c}`") for c in names], "n_shingles", "component_id")


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Set sizes and linked groups of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return link_groups(docs).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.x = d.doc_id GROUP BY 1, 2
"""
