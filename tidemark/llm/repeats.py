"""Exact repeats of word windows by prefix-partitioned suffix trees.

A window is `window` consecutive words of one document; a word goes if it is in a window whose words also start
in a document with a smaller id. Nodes of a suffix tree over words that are at least `window` words deep are those
repeats. A suffix is taken as the sequence of the hashes of its windows, one symbol for each word that it goes on
beyond the first window, so that the root's children of this tree are the nodes of that depth.

* Prefixes. Every window has one anchor, its least-hashed run of `gram` words (the first of equals), so equal
  windows have equal anchors at equal places. Suffixes are split by anchor; anchors of a single document have no
  internal node. Their suffixes are left behind by a sieve of fixed size, before anything but the anchors is shipped.
* Subtrees. A task holds the suffixes of whole anchors: it ranks them by prefix doubling, which gives their order,
  the lengths that neighbours share and by these the tree's nodes. The least id below a root's child marks the
  suffixes that go. All suffixes of an anchor's occurrence go on to its last window.
* An anchor with over `group_limit` occurrences gets longer prefixes, the whole window: its nodes are aggregated
  before they are shuffled and joined back, so a passage in a third of all documents gathers in no task.

Copies of whole documents lose every word if they have a window at all, but for the one with the least id; a task
passes on those copies alone that it hasn't met at a smaller id. Windows are told apart by two 64-bit hashes (of anchor
and window).

`maximal_repeats` gives the trees' deep internal nodes that no equal word before them extends.

Defined results: a null or empty text has no words; very long texts are taken whole; ids must be integers; a null id
counts as larger than any other; rows with one id are judged alone against smaller ids, repeated rows alike; an empty
table gives none; other columns pass through, whatever their names, but for the outputs' names, which the outputs
replace.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Seen, chunks, mix, ragged_take, span_hashes, spread, text_buffer, whole_groups, window_hashes, word_spans
from .spark_util import Sieve, discard, fresh, in_arrow, materialize

LAST = (1 << 63) - 1


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, dk, text): dk is a hash of id and text that stands for the document."""
    return df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("dk"), F.col(f"`{text}`").alias("text"))


def _words(part: pa.RecordBatch):
    buf, offsets = text_buffer(part.column("text"))
    starts, ends, first = word_spans(buf, offsets)
    return buf, starts, ends, first, span_hashes(buf, starts, ends)


def _digest(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the sequence of each text's words."""
    n = np.diff(first)
    place = np.arange(len(words)) - np.repeat(first[:-1], n)
    sums = []
    for seed in (1, 2):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(words * np.uint64(2 * seed + 1) + mix(place.astype(np.uint64) + np.uint64(seed << 40))))])
        sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return sums


def _digests(batches):
    """Each document's number of words and two hashes of their sequence."""
    for batch in batches:
        for part in chunks(batch):
            _, _, _, first, words = _words(part)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("dk"), pa.array(np.diff(first)), *map(pa.array, _digest(words, first))], names=["id", "dk", "n", "d1", "d2"])


def _originals(batches):
    """Blocks of texts without those that the task has met at a smaller id, with their words."""
    seen = Seen(bits=16)
    for batch in batches:
        for part in chunks(batch):
            _, _, _, first, words = _words(part)
            digest, ids = _digest(words, first)[0], part.column("id").to_numpy()
            order = np.lexsort((ids, digest))
            least = order[np.r_[True, digest[order][1:] != digest[order][:-1]]] if len(order) else order
            keep = np.zeros(len(ids), bool)
            keep[least] = seen.new(digest[least], ids[least])
            if not keep.all():
                kept = np.flatnonzero(keep)
                words, first = ragged_take(words, first, kept)
                part = part.take(pa.array(kept))
            yield part, words, first


def anchors(words: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Starts of all windows of all texts, each one's anchor (a place) and the hashes of runs of `gram` words."""
    grams = window_hashes(words, gram)
    n = np.diff(first)
    count = np.maximum(n - window + 1, 0)
    starts = spread(first[:-1], count)
    if not len(starts):
        return starts, starts, grams
    width = window - gram + 1
    best, span = np.arange(len(grams)), 1
    while 2 * span <= width:
        later = best[span:]
        now = best[: len(later)]
        best = np.where(grams[now] <= grams[later], now, later)
        span *= 2
    a, b = best[starts], best[starts + width - span]
    return starts, np.where(grams[a] <= grams[b], a, b), grams


def _runs(starts: np.ndarray, anchor: np.ndarray, first: np.ndarray):
    """Runs of neighbouring windows with one anchor: index of the first and one after the last, and their texts."""
    doc = np.searchsorted(first, starts, side="right") - 1
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]
    at = np.flatnonzero(new)
    return at, np.append(at[1:], len(starts)), doc[at]


def _anchor_rows(window: int, gram: int):
    def run(batches):
        for part, words, first in _originals(batches):
            starts, anchor, grams = anchors(words, first, window, gram)
            if not len(starts):
                continue
            at, _, doc = _runs(starts, anchor, first)
            yield pa.RecordBatch.from_arrays([pa.array(grams[anchor[at]].view(np.int64)), part.column("dk").take(pa.array(doc))], names=["anchor", "dk"])

    return run


def _suffix_rows(window: int, gram: int, repeated: Sieve, large: Sieve):
    """Rows (anchor, id, dk, lo, suffixes, large, before) of the runs of windows whose anchor may be repeated: the hashes
    of their windows, whether the anchor may be a large one, and the hash of the word before."""

    def run(batches):
        for part, words, first in _originals(batches):
            starts, anchor, grams = anchors(words, first, window, gram)
            if not len(starts):
                continue
            at, to, doc = _runs(starts, anchor, first)
            key = grams[anchor[at]].view(np.int64)
            wanted = repeated.may_hold(key)
            at, to, doc, key = at[wanted], to[wanted], doc[wanted], key[wanted]
            whole = window_hashes(words, window).view(np.int64)
            for lo in range(0, len(at), 20_000):
                rows = slice(lo, lo + 20_000)
                count = (to - at)[rows]
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                suffixes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole[spread(starts[at[rows]], count)]))
                take, begin = pa.array(doc[rows]), starts[at[rows]]
                before = np.where(begin > first[doc[rows]], words[np.maximum(begin - 1, 0)].view(np.int64), 0)
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), part.column("id").take(take), part.column("dk").take(take), pa.array(begin - first[doc[rows]]), suffixes, pa.array(large.may_hold(key[rows])), pa.array(before)], names=["anchor", "id", "dk", "lo", "suffixes", "large", "before"])

    return run


class SuffixTree:
    """The suffixes of runs of symbols, each up to its run's end, in order, with what neighbours share.

    Runs of different groups share nothing. `order` lists suffixes (their places), `shared` for each but the first how
    many symbols it shares with the one before it, `children` the place in `order` where each child of the root starts.
    """

    def __init__(self, symbols: np.ndarray, run: np.ndarray, group: np.ndarray):
        n = len(symbols)
        self.left = np.searchsorted(run, run, "right") - np.arange(n)  # symbols up to the run's end
        by = np.lexsort((symbols, group))
        new = np.r_[True, (group[by][1:] != group[by][:-1]) | (symbols[by][1:] != symbols[by][:-1])][:n]
        rank = np.empty(n, np.int64)
        rank[by] = np.cumsum(new) - 1
        levels, step = [rank], 1
        while step < int(self.left.max(initial=0)) and rank.max() + 1 < n:
            ahead = np.where(self.left > step, np.append(rank[step:], np.zeros(step, np.int64))[:n], -1)
            rank = np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)[1]
            levels.append(rank)
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        most = np.minimum(self.left[a], self.left[b])
        self.shared = np.zeros(max(n - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = self.shared < most
            x, y = np.where(inside, a + self.shared, a), np.where(inside, b + self.shared, b)
            same = inside & (levels[k][x] == levels[k][y])
            self.shared[same] += 1 << k
        self.shared = np.minimum(self.shared, most)
        self.children = np.flatnonzero(np.r_[True, self.shared == 0][:n])

    def nodes(self):
        """The internal nodes below the root: (depth in symbols, from, to) with order[from:to] below each."""
        out, open_ = [], []
        for i in range(len(self.order) + 1):
            depth = 0 if i in (0, len(self.order)) else int(self.shared[i - 1])
            at = i - 1
            while open_ and open_[-1][0] > depth:
                d, at = open_.pop()
                out.append((d, at, i))
            if depth and (not open_ or open_[-1][0] < depth):
                open_.append((depth, at))
        return out


def _flat(rows: list[pa.RecordBatch]):
    """Rows of runs as one table, its suffixes in one array, and each one's row."""
    table = pa.Table.from_batches(rows).combine_chunks()
    lists = table.column("suffixes").combine_chunks()
    offsets = lists.offsets.to_numpy()
    count = np.diff(offsets)
    return table, lists.flatten().to_numpy(), np.repeat(np.arange(len(count)), count), np.arange(count.sum()) - np.repeat(offsets[:-1] - offsets[0], count)


def _subtrees(window: int):
    """Intervals of words that go, one per anchor's occurrence at most, from the groups of a partition."""

    def run(batches):
        for batch in whole_groups(batches, ["anchor"]):
            table, symbols, row, place = _flat([batch])
            anchor, ids, lo = (table.column(c).to_numpy() for c in ("anchor", "id", "lo"))
            tree = SuffixTree(symbols, row, anchor[row])
            own = ids[row][tree.order]
            size = np.diff(np.append(tree.children, len(own)))
            least = np.repeat(np.minimum.reduceat(own, tree.children), size)
            gone = np.zeros(len(symbols), bool)
            gone[tree.order] = own > least
            hit = np.flatnonzero(gone)
            if not len(hit):
                continue
            of = row[hit]
            begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            last = np.append(begin[1:], len(hit)) - 1
            at = of[begin]
            yield pa.RecordBatch.from_arrays([table.column("dk").combine_chunks().take(pa.array(at)), pa.array(lo[at] + place[hit[begin]]), pa.array(lo[at] + place[hit[last]] + window)], names=["dk", "lo", "hi"])

    return run


def _repeats(window: int):
    """Deep internal nodes of the groups of a partition that no equal word before all their suffixes extends."""

    def run(batches):
        for batch in whole_groups(batches, ["anchor"]):
            table, symbols, row, place = _flat([batch])
            anchor, ids, lo, word = (table.column(c).to_numpy() for c in ("anchor", "id", "lo", "before"))
            tree = SuffixTree(symbols, row, anchor[row])
            # what stands before a suffix: the symbol before it in its run, else the word before the run
            before = np.where(place > 0, np.append(0, symbols[:-1]), word[row])
            out = []
            for depth, a, b in tree.nodes():
                own = tree.order[a:b]
                if len(set(before[own].tolist())) > 1 or (before[own] == 0).any():
                    first = own[np.lexsort((lo[row[own]] + place[own], ids[row[own]]))[0]]
                    out.append((int(symbols[own[0]]), depth + window - 1, b - a, len(set(ids[row[own]].tolist())), int(ids[row[first]]), int(lo[row[first]] + place[first])))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["passage", "n_words", "occurrences", "documents", "id", "first_word"])

    return run


def _apply(names: list[str], text: str, window: int, cut_name: str, copy_name: str):
    """Texts of the words that stay, joined by a space, with counts; one column lists intervals, one marks copies."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                buf, offsets = text_buffer(part.column(text))
                starts, ends, first = word_spans(buf, offsets)
                n = np.diff(first)
                change = np.zeros(len(starts) + 1, np.int64)
                cut = part.column(cut_name)
                fields = cut.flatten()
                lists = np.array([len(x) if x.is_valid else 0 for x in cut], np.int64)
                doc = np.repeat(np.arange(part.num_rows), lists)
                np.add.at(change, first[doc] + fields.field("lo").to_numpy(zero_copy_only=False).astype(np.int64), 1)
                np.add.at(change, first[doc] + fields.field("hi").to_numpy(zero_copy_only=False).astype(np.int64), -1)
                copies = part.column(copy_name).to_numpy(zero_copy_only=False).astype(bool) & (n >= window)
                gone = (np.cumsum(change)[:-1] > 0) | np.repeat(copies, n)
                kept = ~gone
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[first[1:]] - total[first[:-1]]
                data = buf.tobytes()
                made = []
                words = [data[a:b] for a, b in zip(starts[kept], ends[kept], strict=True)]
                borders = np.concatenate([[0], np.cumsum(kept)])[first]
                for i in range(part.num_rows):
                    made.append(b" ".join(words[borders[i] : borders[i + 1]]))
                values = {"kept_text": pa.array(made, pa.binary()).cast(pa.string()), "n_words": pa.array(n), "n_removed": pa.array(removed)}
                yield pa.RecordBatch.from_arrays([values[c] if c in values else part.column(c) for c in names], names=names)

    return run


def suffix_runs(docs: DataFrame, window: int, gram: int, group_limit: int) -> DataFrame:
    """Rows of _suffix_rows of all anchors that several documents have, and of few others."""
    found = docs.transform(in_arrow, _anchor_rows(window, gram), "anchor long, dk long")
    groups = found.groupBy("anchor").agg(F.min("dk").alias("lo"), F.max("dk").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("anchor", "size")
    groups = materialize(groups, "anchor-groups", few=True)
    bits = min(30, max(20, (16 * groups.count()).bit_length()))  # 16 bits a key, at most 128 MB
    repeated, large = Sieve(groups, "anchor", bits), Sieve(groups.where(F.col("size") > group_limit), "anchor", 20)
    discard(groups)
    return docs.transform(in_arrow, _suffix_rows(window, gram, repeated, large), "anchor long, id long, dk long, lo long, suffixes array<long>, large boolean, before long")


def repeated_words(docs: DataFrame, window: int, gram: int, group_limit: int) -> tuple[DataFrame, DataFrame]:
    """(dk, lo, hi): intervals of words that go, and (dk): documents that are copies of others with smaller ids."""
    digests = materialize(docs.transform(in_arrow, _digests, "id long, dk long, n long, d1 long, d2 long"), "digests", few=True)
    least = digests.groupBy("d1", "d2", "n").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("d1", "d2", "n", "least")
    copies = digests.join(materialize(least, "copied", few=True), ["d1", "d2", "n"]).where("id > least").select("dk").distinct()
    suffixes = materialize(suffix_runs(docs, window, gram, group_limit).drop("before"), "suffixes", few=True)
    small = suffixes.where("not large").repartition("anchor").sortWithinPartitions("anchor").transform(in_arrow, _subtrees(window), "dk long, lo long, hi long")
    single = suffixes.where("large").select("anchor", "id", "dk", F.posexplode("suffixes").alias("i", "suffix"), "lo").select("anchor", "suffix", "id", "dk", (F.col("lo") + F.col("i")).alias("lo"))
    nodes = materialize(single.groupBy("anchor", "suffix").agg(F.min("id").alias("least")), "nodes", few=True)
    large = single.join(nodes, ["anchor", "suffix"]).where("id > least").select("dk", "lo", (F.col("lo") + window).alias("hi"))
    return small.union(large), copies


def maximal_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, gram: int = 10) -> DataFrame:
    """The repeats of at least `window` words, a row a node: passage (a hash of its first window), n_words, occurrences,
    documents, and id and first_word of its first place. A repeat is followed as far as its windows share an anchor;
    longer ones have a row for each of their anchors. Large groups are not split here."""
    runs = suffix_runs(keyed(df, key, text), window, gram, LAST)
    return runs.drop("large").repartition("anchor").sortWithinPartitions("anchor").transform(in_arrow, _repeats(window), "passage long, n_words long, occurrences long, documents long, id long, first_word long")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, gram: int = 10, group_limit: int = 20_000) -> DataFrame:
    """Adds kept_text (words that stay, joined by a space), n_words and n_removed to the table."""
    if not 0 < gram < window:
        raise ValueError("0 < gram < window")
    cuts, copies = repeated_words(keyed(df, key, text), window, gram, group_limit)
    dk, cut, copy = fresh(df, "dk"), fresh(df, "cut"), fresh(df, "copy")
    per = cuts.groupBy(F.col("dk").alias(dk)).agg(F.collect_list(F.struct("lo", "hi")).alias(cut))
    names = [c for c in df.columns if c not in ("kept_text", "n_words", "n_removed")]
    own = df.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias(dk))
    whole = own.join(per, dk, "left").join(copies.select(F.col("dk").alias(dk), F.lit(True).alias(copy)), dk, "left")
    whole = whole.select(*[F.col(f"`{c}`") for c in names], cut, F.coalesce(copy, F.lit(False)).alias(copy))
    out = [*names, "kept_text", "n_words", "n_removed"]
    schema = df.select(*[F.col(f"`{c}`") for c in names]).schema.add("kept_text", "string").add("n_words", "long").add("n_removed", "long")
    return whole.transform(in_arrow, _apply(out, text, window, cut, copy), schema)


def op4_repeats(spark, sf_dir: str) -> DataFrame:
    """Words of every document, how many go, and a digest of those that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT s.doc_id, s.i, md5(array_to_string(d.w[s.i : s.i + 49], ' ')) AS h FROM s JOIN d USING (doc_id)),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
r AS (SELECT g.doc_id, unnest(range(g.i, g.i + 50)) AS p FROM g JOIN m USING (h) WHERE g.doc_id > m.least),
c AS (SELECT DISTINCT doc_id, p FROM r),
w AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT w.doc_id, coalesce(string_agg(w.x, ' ' ORDER BY w.p) FILTER (WHERE c.p IS NULL), '') AS t, count(c.p) AS n FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
