"""Each operator on small tables with nulls, empty and long texts, ties, repeats, clashing columns, against brute force."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import arrays, byte_bpe, fingerprints, jaccard, language, licenses, line_dedup, media, ngram_join, packing, repeats, spark_util, toxicity

P = pytest.importorskip("public_tokenizers")
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, n, size=400):
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out, passage = [], words(rnd, 70)
    for i in range(60):
        own = words(rnd, rnd.randrange(20, 150))
        if i % 4 == 0:
            own[5:5] = passage
        out.append((i, "\n".join(" ".join(own[j : j + 30]) for j in range(0, len(own), 30))))
    for i in range(60, 90):
        base = WORD.findall(out[rnd.randrange(40)][1])
        base[rnd.randrange(len(base))] = "edited"
        out.append((i, " ".join(base)))
    out += [(90, None), (91, ""), (92, " \n\t "), (93, "x"), (94, "x"), (95, out[7][1]), (95, out[7][1]), (None, out[8][1]), (96, "Zürich éa ñ 中文 😀 ﬀ"), (97, " ".join(words(rnd, 6000)))]
    return [(i, t, "en" if (i or 0) % 2 else "de", "s", None) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clash(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    ws = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def groups(nodes, links):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(5, 5)]
    want = groups(range(400), edges)
    for small in (0, 10**6):
        got = {r.node: r.component for r in spark_util.components(spark.createDataFrame(edges, "a long, b long"), small).collect()}
        assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}
    assert spark_util.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pair_counts():
    rnd = np.random.default_rng(0)
    a, b = rnd.integers(0, 50, (2, 400)).astype(np.uint64) << np.uint64(40), None
    x, y = rnd.integers(0, 9, (2, 400))
    b = a[1]
    got = jaccard.pair_counts(a[0], x, b, y, 9)
    sets = [({int(v) for v in a[0][x == i]}, {int(v) for v in b[y == i]}) for i in range(9)]
    assert [list(g) for g in got] == [[len(s) for s, _ in sets], [len(t) for _, t in sets], [len(s & t) for s, t in sets]]


@pytest.mark.parametrize("split", [None, 7])
def test_overlaps(split):
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 60, k)).astype(np.uint64) for k in (0, 1, 5, 30, 30, 80, 200, 3, 40, 90)]
    left, right = (sets, sets) if split is None else (sets[:split], sets[split:])
    for room in (1, 1 << 22):
        assert jaccard.overlaps(sets, split, room=room).tolist() == [[len(np.intersect1d(a, b)) if a is not b else len([x for x in a if sum(x in s for s in sets) > 1]) for b in right] for a in left]
    assert jaccard.overlaps(sets, split, most=10) is None


def test_links_hash_each_line_of_a_family_once(monkeypatch):
    """Families of eight lines have 28 pairs each, and a larger one more; their lines are still hashed once."""
    rnd = random.Random(3)
    rows = []
    for family, size in enumerate([8, 2, 5, 8, 40, 3]):
        base = [rnd.choice("abcdefgh ") for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.randrange(0, 3)):
                own[rnd.randrange(120)] = rnd.choice("XYZ")
            rows.append((family, 0, 0, 0, len(rows), "".join(own)))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["family", "lo", "hi", "own", "line", "text"])
    hashed, hashes = [], line_dedup.shingle_hashes
    monkeypatch.setattr(line_dedup, "shingle_hashes", lambda buf, a, b, k: (hashed.append(len(a)), hashes(buf, a, b, k))[1])
    found = [e for b in line_dedup._links(8, 80)([batch]) for e in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)]
    grams = [{r[5][j : j + 8] for j in range(len(r[5]) - 7)} for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] == rows[j][0] and 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j])]
    assert groups(range(len(rows)), found) == groups(range(len(rows)), links) and 10 < len(links)
    assert sum(hashed) == len(rows)


@pytest.mark.parametrize("room", [1, 1 << 25])
def test_trie_links_equal_brute_force(room):
    rnd = np.random.default_rng(2)
    hub = np.unique(rnd.integers(0, 400, 200).astype(np.uint64))
    sets = [np.unique(np.r_[hub[rnd.random(len(hub)) < p], rnd.integers(0, 9999, k).astype(np.uint64)]) for p in (0.5, 0.8, 0.9, 1.0) for k in (0, 5, 30) for _ in range(6)]
    sets += [hub, hub.copy(), hub[:1], hub[:2], np.array([77777], np.uint64), np.unique(rnd.integers(0, 9999, 900).astype(np.uint64))]
    link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if link(sets[i], sets[j])}
    got = [tuple(sorted(p, reverse=True)) for p in ngram_join.trie_links(sets, None, 80, room).tolist()]
    assert len(got) == len(set(got)) and set(got) == want and 50 < len(want) < 2000
    left, right = sets[::2], sets[1::2]
    got = ngram_join.trie_links(left, right, 80, room).tolist()
    assert sorted(map(tuple, got)) == [(i, j) for i in range(len(left)) for j in range(len(right)) if link(left[i], right[j])]


def test_histograms_keep_every_link():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 3, 30, 31, 300, 3000)]
    for base in list(sets):
        sets += [np.unique(np.r_[base[rnd.random(len(base)) < p], rnd.integers(0, 2**63, len(base) // q).astype(np.uint64)]) for p in (0.8, 0.9, 1.0) for q in (1, 5, 20)]
    sets += [sets[5] & np.uint64(2**63 - 8), np.zeros(0, np.uint64)]
    sets = [np.unique(s) for s in sets]
    n = np.array([len(s) for s in sets])
    bins = ngram_join.histograms(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), n)
    a, b = (x.ravel() for x in np.meshgrid(*[np.flatnonzero(n)] * 2))
    pairs = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), bins.take(pa.array(a)), bins.take(pa.array(b)), pa.array(n[a]), pa.array(n[b])], names=["a", "b", "bins_a", "bins_b", "n_a", "n_b"])
    got = {(x["a"], x["b"]) for out in ngram_join._within(80)([pairs]) for x in out.to_pylist()}
    linked = {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert linked <= got and len(linked) > len(sets) and len(got) < len(a) // 2
    assert bins.to_pylist()[-1] == b""


CLASHING = ("dk", "id", "node", "n", "d1", "h", "line", "key", "_kept", "_cut", "_copy", "_lang", "_score", "DK", "text_", "part", "component", "anchor", "words", "term", "bin")


@pytest.mark.parametrize("full_run, side", [(8, 256), (2, 3)])
def test_ngram_join(spark, docs, rows, full_run, side):
    out = ngram_join.link_groups(clash(docs, "component_id", *CLASHING), full_run=full_run, side=side).collect()
    sets = [shingles(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    part = groups(range(len(rows)), links)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[part[i]] = r[0] if least[part[i]] is None else min(r[0], least[part[i]])
    want = Counter((r[0], len(sets[i]), least[part[i]]) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    assert ngram_join.link_groups(empty(spark)).count() == 0


def test_ngram_join_of_a_large_family(spark):
    """400 near copies of one text, few of which link directly with the others: all links found, as brute force does."""
    rnd = random.Random(8)
    base, rows = words(rnd, 90, 9999), []
    for i in range(400):
        own = list(base)
        for _ in range(rnd.randrange(0, 4)):
            own[rnd.randrange(len(own))] = f"e{rnd.randrange(99999)}"
        rows.append((i, " ".join(own)))
    sets = [shingles(t) for _, t in rows]
    part = groups(range(400), [(i, j) for i in range(400) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    assert 1 < len(set(part.values())) < 300
    for side in (256, 60):
        out = ngram_join.link_groups(spark.createDataFrame(rows, "doc_id long, text string"), side=side).collect()
        assert {r.doc_id: r.component_id for r in out} == part


@pytest.mark.parametrize("limit", [20_000, 1])
def test_repeats(spark, docs, rows, limit):
    out = repeats.remove_repeats(clash(docs, "n_words", "runs", *CLASHING), group_limit=limit).collect()
    key = lambda i: (1 << 63) if i is None else i
    first = {}
    for i, t, *_ in rows:
        ws = WORD.findall(t or "")
        for j in range(len(ws) - 49):
            w = tuple(ws[j : j + 50])
            first[w] = min(first.get(w, key(i)), key(i))
    want = Counter()
    for i, t, *_ in rows:
        ws = WORD.findall(t or "")
        gone = set()
        for j in range(len(ws) - 49):
            if first[tuple(ws[j : j + 50])] < key(i):
                gone |= set(range(j, j + 50))
        want[(i, len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out) == want
    assert any(k[2] for k in want)
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_suffix_tree():
    """Order, shared lengths and nodes of random runs, against sorting slices."""
    rnd = random.Random(2)
    for _ in range(30):
        runs = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 12))] for _ in range(rnd.randrange(1, 8))]
        group = [rnd.randrange(2) for _ in runs]
        symbols = np.array([x for r in runs for x in r])
        run = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        tree = repeats.SuffixTree(symbols, run, np.array(group)[run])
        suffix = [(group[i], tuple(r[j:])) for i, r in enumerate(runs) for j in range(len(r))]
        share = lambda a, b: 0 if a[0] != b[0] else next((k for k, (x, y) in enumerate(zip(a[1], b[1], strict=False)) if x != y), min(len(a[1]), len(b[1])))
        listed = [suffix[i] for i in tree.order]
        assert listed == sorted(suffix) and tree.shared.tolist() == [share(a, b) for a, b in zip(listed, listed[1:], strict=False)]
        want = set()
        for prefix in {(g, s[:k]) for g, s in suffix for k in range(1, len(s) + 1)}:
            below = [x for x in suffix if x[0] == prefix[0] and x[1][: len(prefix[1])] == prefix[1]]
            if len(below) > 1 and min(share(a, b) for a in below for b in below) == len(prefix[1]):
                want.add((len(prefix[1]), len(below), prefix))
        assert {(d, b - a, (listed[a][0], listed[a][1][:d])) for d, a, b in tree.nodes()} == want


def test_maximal_repeats(spark):
    rnd = random.Random(5)
    passage = words(rnd, 62, 10**6)
    rows = [(i, " ".join(words(rnd, 20, 10**6) + (passage if i < 4 else passage[:53] if i < 6 else []) + words(rnd, 20, 10**6))) for i in range(8)]
    out = repeats.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert out and {r.occurrences for r in out} <= {4, 6} and {r.id for r in out} == {0} and all(50 <= r.n_words <= 62 for r in out)
    assert all(r.occurrences == r.documents for r in out)
    covered = {r.first_word - 20 + j for r in out for j in range(r.n_words)}
    assert covered == set(range(62)) and min(r.first_word for r in out if r.occurrences == 6) == 20


def test_line_dedup(spark, rows):
    line = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    given = [(1, f"{line}\n\nalpha beta gamma"), (2, f"  {line}!\nAlpha beta gamma delta epsilon"), (3, None), (4, ""), (5, "ab\nab\n\n"), (6, "ab"), (None, line), (7, "nothing like any other line in this small table\n" + line + " x")]
    df = clash(spark.createDataFrame(given, "doc_id long, text string"), "n_lines", *CLASHING)
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()}
    assert out[1] == (given[0][1], 3, 0)
    assert out[2] == ("Alpha beta gamma delta epsilon", 2, 1)
    assert out[3] == (None, 0, 0) and out[4] == ("", 1, 0)
    assert out[5] == ("ab\n\n", 4, 1) and out[6] == ("", 1, 1) and out[None] == ("", 1, 1)
    assert out[7] == ("nothing like any other line in this small table", 2, 1)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_links_equal_brute_force(spark):
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(90)) for _ in range(30)]
    lines = [x[: rnd.randrange(70, 90)] + rnd.choice(["", "zz", "yyyy"]) for x in base for _ in range(4)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    grams = [{x.strip()[j : j + 8] for j in range(len(x.strip()) - 7)} for x in lines]
    part = groups(range(len(lines)), [(i, j) for i in range(len(lines)) for j in range(i) if 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j])])
    kept = {r.doc_id for r in line_dedup.dedup_lines(df).collect() if r.n_removed == 0}
    assert kept == set(part.values())


@pytest.mark.parametrize("parts, side", [(1, 256), (5, 256), (5, 7)])
def test_line_links_of_wide_buckets(spark, parts, side):
    """Overlapping cuts and templated lines: buckets hold many lines, most pairs of them without a link."""
    rnd = random.Random(4)
    lines = []
    for _ in range(6):
        base = "".join(rnd.choice("abcdefgh ") for _ in range(900))
        lines += [f"|{base[i : i + 150]}|" for i in range(0, 700, 14)]
    stem = "".join(rnd.choice("abcdefgh ") for _ in range(150))
    for _ in range(25):
        tail = "".join(rnd.choice("abcdefgh ") for _ in range(55))
        lines += [f"|{stem}{tail}|", f"|{stem}{tail[:30]}{rnd.choice('xyz')}|"]
    rnd.shuffle(lines)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(parts)
    grams = [{x[j : j + 8] for j in range(len(x) - 7)} for x in lines]
    part = groups(range(len(lines)), [(i, j) for i in range(len(lines)) for j in range(i) if 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j])])
    kept = {r.doc_id for r in line_dedup.dedup_lines(df, side=side).collect() if r.n_removed == 0}
    assert kept == set(part.values())


def test_line_links_of_a_large_family(spark):
    """400 near copies of one line with two edits or so, in many documents: all links of pairs that share a band."""
    rnd = random.Random(12)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(200))
    lines = []
    for _ in range(400):
        own = list(base)
        for _ in range(rnd.randrange(0, 4)):
            own[rnd.randrange(len(own))] = rnd.choice("XYZ")
        lines.append("|" + "".join(own) + "|")
    grams = [{x[j : j + 8] for j in range(len(x) - 7)} for x in lines]
    part = groups(range(400), [(i, j) for i in range(400) for j in range(i) if 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j])])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    for side in (256, 50):
        kept = {r.doc_id for r in line_dedup.dedup_lines(df, side=side).collect() if r.n_removed == 0}
        assert kept == set(part.values())
    assert 1 < len(set(part.values())) < 300


def test_line_passes(spark, monkeypatch):
    """Near copies, which share most of their buckets: no pass ships many more rows than there are lines."""
    rnd = random.Random(5)
    lines = []
    for _ in range(60):
        base = [rnd.choice("abcdefgh ") for _ in range(300)]
        for _ in range(8):
            own = list(base)
            own[rnd.randrange(300)] = rnd.choice("XYZ")
            lines.append("|" + "".join(own) + "|")
    grams = [{x[j : j + 8] for j in range(len(x) - 7)} for x in lines]
    part = groups(range(480), [(i, j) for i in range(480) for j in range(i) if 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j])])
    shipped, in_order = defaultdict(list), line_dedup.in_order
    monkeypatch.setattr(line_dedup, "in_order", lambda rows, group, node: (shipped[group].append(rows.count()), in_order(rows, group, node))[1])
    monkeypatch.setattr(line_dedup, "ROOM", 1)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in line_dedup.dedup_lines(df).collect() if r.n_removed == 0}
    assert kept == set(part.values()) and len(kept) == 60
    assert sum(shipped["key"]) > 4 * 480 and max(shipped["key"]) < 2 * 480
    assert sum(shipped["family"]) == len(set(lines)) and max(shipped["family"]) < 400


def test_written_tables_leave_no_shuffle_files(spark):
    folders = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {x for top in folders for _, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}
    before, setting = files(), spark.conf.get(spark_util.CLEANUP)
    table = spark_util.materialize(spark.range(1000).repartition(3, "id"), "swept")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(spark_util.CLEANUP) == setting
    assert table.count() == 1000


def test_sieve(spark):
    rnd = np.random.default_rng(4)
    keys = np.r_[rnd.integers(-(2**63), 2**63 - 1, 3000), 0, -1, 2**63 - 1, -(2**63)]
    given = spark.createDataFrame([(int(k),) for k in keys], "k long")
    for bits, most in ((10, 1.0), (16, 0.06), (22, 0.002)):
        sieve = spark_util.Sieve(given, "k", bits)
        assert sieve.may_hold(keys).all() and sieve.may_hold(rnd.integers(-(2**63), 2**63 - 1, 20_000)).mean() <= most
    assert not spark_util.Sieve(given.limit(0), "k", 10).may_hold(keys).any()


def test_lines_met_before():
    """The bounded table of lines met forgets some, but never takes a new line, or one at a smaller id, for a known one."""
    rnd = np.random.default_rng(1)
    seen, least = arrays.Seen(bits=3), {}
    for _ in range(200):
        lines = np.unique(rnd.integers(-20, 20, 8))
        ids = rnd.integers(0, 50, len(lines))
        for line, i, fresh in zip(lines.tolist(), ids.tolist(), seen.new(lines, ids).tolist(), strict=True):
            assert fresh or least[line] < i
            least[line] = min(i, least.get(line, i)) if fresh else least[line]


def test_fingerprints(spark, rows):
    given = [r[:2] for r in rows if r[0] is not None and r[0] != 95]
    df = spark.createDataFrame(given, "doc_id long, text string")
    out = {r.doc_id: r for r in fingerprints.fingerprint_pairs(clash(df, "range", "nth")).collect()}
    order, text = sorted((i for i, _ in given), reverse=True), {i: t or "" for i, t in given}
    errors = []
    for k, i in enumerate(order):
        own, after = text[i], text[order[(k + 1) % len(order)]]
        m = len(own) // 2
        edited = own[: len(own) - m] + after[:m]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        for value, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = Counter(WORD.findall(own)), Counter(WORD.findall(other))
            errors.append(value - (sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0))
        assert r.fingerprint == ("" if not WORD.findall(own) else r.fingerprint)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1
    assert out[93].fingerprint == out[94].fingerprint != ""
    assert fingerprints.fingerprint_pairs(empty(spark)).count() == 0
    assert [tuple(r)[-1] for r in fingerprints.fingerprint_pairs(df.where("doc_id = 5")).collect()] == [1.0]
    twice = df.where("doc_id = 5").union(df.where("doc_id = 5")).union(spark.createDataFrame([(None, "q")], "doc_id long, text string"))
    assert fingerprints.fingerprint_pairs(twice).count() == 3
    nulls = spark.createDataFrame([(None, "aa bb"), (None, "cc dd"), (None, None)], "doc_id long, text string")
    order = ["", "aa bb", "cc dd"]
    want = {hashlib.sha256((t[: len(t) - len(t) // 2] + order[(i + 1) % 3][: len(t) // 2]).encode()).hexdigest() for i, t in enumerate(order)}
    assert {r.edited_sha256 for r in fingerprints.fingerprint_pairs(nulls).collect()} == want


def test_language(spark, docs):
    rnd = random.Random(4)
    parts = {"aa": ["ba", "be", "bi"], "zz": ["xo", "xu", "ku"]}
    make = lambda lang, n: " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))
    given = [(i, make("aa" if i % 2 else "zz", 30), "aa" if i % 2 else "zz") for i in range(120)]
    given += [(200, None, "aa"), (201, "", None), (202, "12 !? 😀", "aa"), (203, make("aa", 40) + " " + make("zz", 10), None)]
    df = clash(spark.createDataFrame(given, "doc_id long, text string, lang string"), "score")
    model = language.fit(df.where(~language.held_out()))
    out = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in given[:120])
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (200, 201, 202))
    assert out[203].lang_pred == "aa" and 0.5 < out[203].score < 0.95
    runs = [(r.lang, r.n_words) for r in language.spans(df.where("doc_id = 203"), model).orderBy("first_word").collect()]
    assert [r[0] for r in runs] == ["aa", "zz"] and abs(runs[0][1] - 40) <= 2
    nothing = language.fit(empty(spark))
    assert language.identify(empty(spark), nothing).count() == 0
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    total, want, pairs = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in product(range(3), repeat=4):
        w = np.exp(sum(scores[0, i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for i, y in enumerate(path):
            want[i, y] += w
        for a, b in zip(path, path[1:], strict=False):
            pairs[a, b] += w
    got, both = language.marginals(scores, np.array([4]), moves, True)
    assert np.allclose(got[0], want / total) and np.allclose(both, pairs / total)


def test_whole_texts_are_one_chain():
    """Parts with messages between them give the marginals of one chain over the whole text."""
    rng = np.random.default_rng(3)
    names = ["a", "b", "c"]
    model = language.Model(names, rng.normal(size=((1 << language.BITS) + 1, 3)).astype(np.float32) / 4, rng.normal(size=(3, 3)))
    model.weights[-1] = 0
    texts = [" ".join("".join(rng.choice(list("abcdefg"), 5)) for _ in range(n)) for n in (1, 3, 63, 64, 65, 127, 128, 200, 700)] + ["", "12"]
    buf, offsets = arrays.text_buffer(pa.array(texts))
    got, starts, ends, first = language.label_block(model, buf, offsets)
    data, at, index = language._distinct(buf, starts, ends)
    scores = language._emissions(language._features(data, at), model.weights)[index]
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b > a:
            assert np.allclose(got[a:b], language.marginals(scores[None, a:b], np.array([b - a]), model.transitions)[0])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_languages(spark):
    found = language.op3_language(spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").where("lang is not null")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_toxicity(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(words(rnd, 40) + (["nastyword"] * 3 if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(400)]
    docs = clash(spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, "!!!")], "doc_id long, text string"), "score")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all((out[i] >= 0.3) == bool(y) for i, _, y in held) and all(out[i] < 0.3 for i in (900, 901, 902))
    long = spark.createDataFrame([(1, "plain " * 60_000 + "nastyword " * 20_000), (2, "plain words"), (2, "plain words")], "doc_id long, text string")
    scores = [r.score for r in toxicity.score(clash(long, *CLASHING), model).orderBy("doc_id").collect()]
    assert scores[0] >= 0.3 > scores[1] == scores[2]
    flat = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, flat).collect()} == {0.0}
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), labels.where("false"))).count() == 0


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert list(y) == [0.0, 0.5, 1.0] and list(x) == [1.0, 2.5, 4.0]


def test_licenses(spark):
    given = [(1, "Words.\nReleased under the MIT License.\nMore words here."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY 4.0."), (5, "A licence to fish in the river."), (6, None), (7, ""), (8, "This text is licensed under the GNU General Public License, version 2.")]
    out = {r.doc_id: r.blocks for r in licenses.scan(clash(spark.createDataFrame(given, "doc_id long, text string"), "blocks")).collect()}
    named = {i: sorted({b.license for b in v if b.license}) for i, v in out.items()}
    assert named == {1: ["MIT"], 2: ["GPL-3.0"], 3: ["CC-BY-NC-4.0"], 4: ["CC-BY-4.0"], 5: [], 6: [], 7: [], 8: ["GPL-2.0"]}
    assert len(out[5]) >= 1 and out[2][0].n_differences == 0 and out[8][0].differences
    assert licenses.scan(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [0, 300, 1500])
def test_licenses_in_long_paragraphs(n):
    filler = "\n".join(f"word{i} stands here with some others" for i in range(n))
    isc = licenses.TEMPLATES["ISC"][0].replace(" and/or ", "\nand/or ").replace(" granted, ", " granted,\n")
    found = licenses.Scanner(0.3, 0.85, 6).scan(f"{filler}\n{isc}\n{filler}".strip())
    assert "ISC" in {b["license"] for b in found}


def test_licenses_over_line_feeds():
    scanner, mit = licenses.Scanner(0.3, 0.85, 6), licenses.TEMPLATES["MIT"][2]
    named = lambda text: {b["license"] for b in scanner.scan(text)} - {None}
    assert named(mit.replace("conditions: ", "conditions:\n\n")) == {"MIT"}
    wrapped = "Notes on the text.\nThis work is licensed under the GNU General Public\nLicense, version 2.\nMore words follow here."
    assert named(wrapped) == {"GPL-2.0"}
    assert named("Dedicated to the public\ndomain under CC0 1.0 Universal.") == {"CC0-1.0"}
    assert named("Some words.\nReleased under\nthe MIT License.\nOther words.") == {"MIT"}


def test_licenses_whole_texts_and_tags():
    scanner = licenses.Scanner(0.3, 0.85, 6)
    named = lambda text: {b["license"] for b in scanner.scan(text)} - {None}
    wrap = lambda text: "\n".join(text[i : i + 70] for i in range(0, len(text), 70))
    for name in ("MIT", "ISC", "Zlib", "BSD-2-Clause", "BSD-3-Clause"):
        text = licenses.TEXTS[name]
        assert named(f"Copyright (c) 2020 Some Person\n\n{text}") == {name}, name
        assert name in named("word " * 900 + text + " word" * 900)
    bsd = licenses.TEXTS["BSD-3-Clause"].replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS").replace("COPYRIGHT HOLDER OR", "REGENTS OR").replace("the copyright holder nor", "the University nor")
    for mark in (("1. ", "2. ", "3. "), ("* ", "* ", "* ")):
        own = bsd
        for i, m in enumerate(mark, 1):
            own = own.replace(f" {i}. ", f"\n\n{m}", 1)
        assert "BSD-3-Clause" in named(own) and "MIT" not in named(own)
    assert named("// SPDX-License-Identifier: Apache-2.0\nint x;") == {"Apache-2.0"}
    assert "MIT OR GPL-2.0-only WITH Classpath-exception-2.0" in named("# SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0)")
    assert named("Licensed under the EUPL-1.2.") == {"EUPL-1.2"} and named("Distributed under the Boost Software License, Version 1.0.") == {"BSL-1.0"}
    assert named("This work is licensed under the GNU General Public License, version\n2. More words.") == {"GPL-2.0"}


def test_licenses_of_tables(spark):
    """Nulls, repeated rows and very long texts; each text's blocks are those of the scanner alone."""
    long = "plain words here. " * 40_000 + "Released under the MIT License. " + "more words. " * 1000
    given = [(1, long), (2, "All rights reserved."), (2, "All rights reserved."), (None, "Licensed under CC0 1.0."), (3, None)]
    df = clash(spark.createDataFrame(given, "doc_id long, text string"), *CLASHING)
    out = licenses.scan(df).collect()
    scanner = licenses.Scanner(0.3, 0.85, 6)
    assert len(out) == 5 and all([b.license for b in r.blocks] == [b["license"] for b in scanner.scan(r.text or "")] for r in out)
    assert {r.doc_id: [b.license for b in r.blocks if b.license] for r in out} == {1: ["MIT"], 2: ["All-Rights-Reserved"], None: ["CC0-1.0"], 3: []}


def test_media(spark, docs, rows):
    out = media.features(media.store(clash(docs, "media", "video"))).collect()
    want = Counter()
    for i, t, *_ in rows:
        data = (t or "").encode()
        want[(i, data + b"\0" * (-len(data) % 64 or (0 if data else 64)))] += 1
    assert Counter((r.doc_id, bytes(r.video.payload)) for r in out) == want
    assert media.store(empty(spark)).count() == 0
    still = bytes([20]) * 64 * 32 * 5 + bytes([200]) * 64 * 32 * 4
    frames, rate, payload = media.decode_avi(media.write_avi(still))
    assert payload == still and media.shots(frames)[0] == [0, 5]
    df = spark.createDataFrame([(1, bytearray(media.write_avi(still))), (2, bytearray(b"no file")), (3, None)], "id long, media binary")
    clips = [(r.id, r.first_frame, r.end_frame, r.end_s) for r in media.clips(media.features(df)).orderBy("clip").collect()]
    assert clips == [(1, 0, 5, 0.2), (1, 5, 9, 0.36)]


def test_byte_bpe(spark, docs, rows):
    import tiktoken
    from tidemark.llm.tokens import load_ranks

    path = P.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    coded = byte_bpe.encode(clash(docs, "ids"), path, P.PATTERN, decoded="decoded", leaf_bytes=64)
    out = byte_bpe.decode(coded, path, P.PATTERN, out="again").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((r[0], tuple(plain.encode_ordinary(r[1] or ""))) for r in rows)
    assert all(r.decoded == r.again for r in out) and Counter(bytes(r.decoded) for r in out) == Counter((r[1] or "").encode() for r in rows)
    rnd = random.Random(2)
    alphabet = ["a", "the", "'", "'s", "'re", " ", "  ", "\n", "é", "中", "12", ".", "!!", "\t", "ll", "😀", "́", " "]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(150))) for _ in range(1500)] + ["a" * 5000, "deadbeef" * 700, " " * 3000, "1234" * 900]
    codec = byte_bpe.Codec(path, P.PATTERN, 16, 8)
    ids, at = codec.encode(*byte_bpe.text_buffer(pa.array(texts)))
    assert all(ids[at[i] : at[i + 1]].tolist() == plain.encode_ordinary(t) for i, t in enumerate(texts))


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    out = packing.pack(clash(docs.where("doc_id is not null and doc_id <> 95"), "ids", "length", "key", *CLASHING), path, max_tokens=256).collect()
    texts = {r[0]: r[1] or "" for r in rows if r[0] not in (None, 95)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in texts.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [int(x) for r in pieces for x in np.frombuffer(r.ids, "<u4")] == ids and {r.doc_tokens for r in pieces} == {len(ids)}
    waste = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        n = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces]])[:-1]) and n <= 256
        waste += 0 if n & (n - 1) == 0 else 256 - n
    assert waste == 0
    assert packing.pack(empty(spark), path).count() == 0


def test_packing_of_repeated_and_null_ids(spark):
    """Repeated rows and null ids are packed as often as they occur; a loss column makes the third limit bind."""
    given = [(1, "one two three " * 40, 7), (1, "one two three " * 40, 7), (None, "four", None), (2, None, 0)]
    df = spark.createDataFrame(given, "doc_id long, text string, bears long").coalesce(1)
    out = packing.pack(df, P.path("word_bpe_49k.json"), loss="bears", max_tokens=64, max_segments=3, max_loss=9).collect()
    total = Counter()
    for r in out:
        total[r.doc_id] += r.length
    assert total == {1: 242, None: 2, 2: 1}
    packed = defaultdict(list)
    for r in out:
        packed[r.sequence_id].append(r)
    assert all(sum(r.length for r in x) <= 64 and len(x) <= 3 for x in packed.values())
    bears = lambda r: max(0, r.start + r.length - max(r.start, 121 - 7)) if r.doc_id == 1 else r.length if r.doc_id is None else 0
    assert max(sum(map(bears, x)) for x in packed.values()) <= 9


def test_word_tokenizer_equals_the_library():
    """Random texts over all scripts, marks, white space, added tokens' strings: the ids of the library's defaults."""
    import unicodedata

    from tokenizers import Tokenizer

    path, rnd = P.path("word_bpe_49k.json"), random.Random(5)
    tokenizer, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    scripts = [chr(c) for c in range(32, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    odd = ["\u0130", "\u0130stanbul", "e\u0301", "\u0301", "\u0958", "\ufb2a", "\u0344", "\u0085", "\u00a0", "\u2028", "\u1680", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>x", "it's", "'S", "a'll", "\u212b", "\ufb00", "\u03a3\u03a3", "\u1e9e", "\U0001f600\u200d", "7\u0661", "\x00", "\x1c", "hello", "world", "1984"]
    texts = ["\u0130stanbul is here", "hello world", "plain text follows", "", "\u0301 x"]
    for _ in range(1500):
        pick = lambda: rnd.choice(odd) if rnd.random() < 0.3 else "".join(rnd.choice(scripts) if rnd.random() < 0.3 else rnd.choice("abcXYZ012 '-.") for _ in range(rnd.randrange(1, 8)))
        texts.append(rnd.choice(["", " "]).join(pick() for _ in range(rnd.randrange(1, 12))))
    for at in range(0, len(texts), 50):
        block = texts[at : at + 50]
        raw = [t.encode("utf-8") for t in block]
        ids, ends = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        for i, t in enumerate(block):
            assert ids[ends[i] : ends[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_limits():
    rnd = np.random.default_rng(3)
    packer = packing.Packer(0, 64, 5, 20, 4)
    sizes = {}
    for k in range(300):
        n, loss = int(rnd.integers(1, 150)), int(rnd.integers(0, 60))
        sizes[k] = (n, min(n, loss))
        packer.add(k, np.arange(n, dtype=np.uint32), loss)
    packer.finish()
    sequences, seen = defaultdict(list), defaultdict(list)
    for key, start, ids, total, sequence, _ in packer.take():
        sequences[sequence].append((key, start, len(ids)))
        seen[key].append((start, len(ids)))
    for key, pieces in seen.items():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and sum(n for _, n in pieces) == sizes[key][0]
    bearing = lambda key, start, n: max(0, start + n - max(start, sizes[key][0] - sizes[key][1]))
    for pieces in sequences.values():
        assert sum(n for *_, n in pieces) <= 64 and len(pieces) <= 5 and sum(bearing(*p) for p in pieces) <= 20


def test_trees_equal_brute_force():
    """One tree of one split is the best of all splits tried one by one; margins follow the trees node by node."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3)).round(2)
    y = ((x[:, 1] > 0.3) ^ (rng.random(120) < 0.1)).astype(float)
    w = rng.choice([1.0, 2.0], 120)
    (tree,), edges, base = toxicity.boost(x, y, w, trees=1, depth=1)
    p = 1 / (1 + np.exp(-base))
    g, h = w * (p - y), w * p * (1 - p)
    best = (-1.0, None)
    for j in range(3):
        for c, edge in enumerate(edges[j]):
            left = x[:, j] < edge
            if h[left].sum() < 0.1 or h[~left].sum() < 0.1:
                continue
            gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
            best = max(best, (gain, (j, c)), key=lambda t: t[0])
    assert (tree[0][0], tree[1][0]) == best[1]
    trees, edges, base = toxicity.boost(x, y, w, trees=5, depth=3)
    model = toxicity.Model(trees=trees, edges=edges, base=base)

    def follow(row):
        out = base
        for feature, cut, value in trees:
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(np.searchsorted(edges[feature[node]], row[feature[node]], side="right") > cut[node])
            out += value[node - len(feature)]
        return out

    assert np.allclose(toxicity.margins(model, x), [follow(r) for r in x])
    fx, fy = toxicity.isotonic(x[:, 1], y, w)
    assert (np.diff(fx) > 0).all() and (np.diff(fy) > 0).all() and np.isclose((fy * 0 + 1).sum(), len(fy))


def expected_pipeline(rows):
    """What the stages up to packing leave of (id, text), worked out one by one: {id: text}."""
    big = 1 << 63
    key = lambda i: big if i is None else i
    docs = sorted({(i, t) for i, t in rows if t and any(c.isalpha() for c in t)}, key=lambda r: (key(r[0]), r[1]))
    # lines: of all linked lines the first stays
    strip = " \t\n\x0b\x0c\r"
    lines = [(n, k, line.strip(strip)) for n, (_, t) in enumerate(docs) for k, line in enumerate(t.split("\n"))]
    distinct = sorted({x for *_, x in lines if x})
    grams = {x: {x[j : j + 8] for j in range(len(x) - 7)} for x in distinct}
    part = groups(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if grams[a] and grams[b] and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])])
    seen, kept = set(), defaultdict(list)
    for n, k, x in lines:
        if not x or part[x] not in seen:
            kept[n].append(k)
            seen.add(part[x])
    docs = [(i, "\n".join([t.split("\n")[k] for k in kept[n]])) for n, (i, t) in enumerate(docs)]
    docs = [(i, t) for i, t in docs if WORD.search(t)]
    # near duplicates: the smallest id of each linked group stays
    sets = [shingles(t) for _, t in docs]
    part = groups(range(len(docs)), [(a, b) for a in range(len(docs)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    least = {p: min(key(docs[n][0]) for n in range(len(docs)) if part[n] == p) for p in part.values()}
    docs = [docs[n] for n in range(len(docs)) if key(docs[n][0]) == least[part[n]]]
    # passages of 50 words that an earlier document has
    first = {}
    for i, t in docs:
        ws = WORD.findall(t)
        for j in range(len(ws) - 49):
            first[tuple(ws[j : j + 50])] = min(first.get(tuple(ws[j : j + 50]), big + 1), key(i))
    out = {}
    for i, t in docs:
        ws = WORD.findall(t)
        gone = {k for j in range(len(ws) - 49) if first[tuple(ws[j : j + 50])] < key(i) for k in range(j, j + 50)}
        text = " ".join(w for j, w in enumerate(ws) if j not in gone) if gone else t
        if WORD.search(text):
            out[i] = text
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rnd = random.Random(11)
    passage, line = " ".join(words(rnd, 60, 5000)), " ".join(words(rnd, 14, 5000))
    rows = []
    for i in range(70):
        own = [" ".join(words(rnd, rnd.randrange(8, 25), 5000)) for _ in range(rnd.randrange(2, 7))]
        if i % 3 == 0:
            own.insert(1, line if i % 2 else line[:-1] + "x")
        if i % 5 == 0:
            own.append(passage + " " + " ".join(words(rnd, 10, 5000)))
        rows.append((i, "\n".join(own)))
    for i in range(70, 100):  # near copies on lines that differ enough
        ws = rows[rnd.randrange(70)][1].split()
        ws[rnd.randrange(len(ws))] = f"new{i}"
        rows.append((i, " ".join(ws)))
    rows += [(100, None), (101, ""), (102, "12 !?"), (103, rows[5][1]), (103, rows[5][1]), (104, "x y z"), (None, "just some words here " * 3), (105, " \n \n")]
    df = clash(spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA), "dk", "_lang", "_text", "component_id", "kept")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark_util.materialize(stage(spark, now, str(tmp_path)), "test")
    want = expected_pipeline(rows)
    assert {r.doc_id: r.text for r in now.collect()} == want and now.count() == len(want) and now.columns == df.columns
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    folder = spark_util.shared_folder(spark)
    earlier = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert [n.split("-")[:2] for n in set(os.listdir(folder)) - earlier] == [["stage", "passages"]]
    for r in out.collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for i, text in want.items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 2], 0
        for start, length, crc in sorted(pieces.pop(i)):
            assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert not pieces


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == now.columns
        now = spark_util.materialize(after, "test")
    assert now.count() > 30


def test_band_rows_are_few():
    """Rows of band keys are as many as shares, not as keys, and hold each key of a line; keys are the plain ones."""
    rnd = random.Random(3)
    texts = ["\n".join("".join(rnd.choice("abcdé ") for _ in range(rnd.choice([3, 40, 90]))) for _ in range(30)) + f"\n{'xy' * 40_000}" for _ in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(range(12)), pa.array(texts)], names=["id", "dk", "text"])
    keys = [np.concatenate(x) for x in zip(*line_dedup._band_keys(8, 12, 3)([batch]), strict=True)]
    rows = pa.Table.from_batches(line_dedup._band_rows(8, 12, 3, 20)([batch]))
    pairs = [np.frombuffer(b, np.int64).reshape(-1, 2) for b in rows.column("keys").to_pylist()]
    assert rows.num_rows <= 20 < len(keys[0])
    assert sorted(map(tuple, np.concatenate(pairs).tolist())) == sorted(zip(keys[0].view(np.int64).tolist(), keys[1].tolist(), strict=True))
    assert all((p[:, 0].view(np.uint64) // np.uint64(-(-(2**64) // 20)) == s).all() for s, p in zip(rows.column("share").to_pylist(), pairs, strict=True))
    hashes = np.random.default_rng(2).integers(0, 2**63, 100_000).astype(np.uint64) * np.uint64(2)
    first, last = np.array([5, 40, 700, 60_000, 99_990]), np.array([30, 600, 50_000, 99_000, 100_000])
    whole = line_dedup.signatures(hashes, first, last, 2, 2)
    low = [[int((((hashes[a:b] >> np.uint64(32)).astype(np.uint32)) * line_dedup.MULTIPLIERS[j]).min()) for j in range(4)] for a, b in zip(first, last, strict=True)]
    mix = lambda x: int(arrays.mix(np.array([x % 2**64], np.uint64))[0])
    assert whole.tolist() == [[mix(mix(m[j] + j + 1) + m[j + 1] + j + 2) for j in (0, 2)] for m in low]


def test_written_tables_are_few_files(spark):
    """A checksum file in a local folder starts a process for its permissions: there is none."""
    table = spark_util.materialize(spark.range(1000).repartition(40, "id"), "files", few=True)
    names = os.listdir(table._tidemark_path.removeprefix("file:"))
    assert not [x for x in names if x.endswith(".crc")] and len([x for x in names if x.startswith("part-")]) <= 16
    assert table.count() == 1000
    lines = line_dedup.dedup_lines(spark.range(100).select(F.col("id").alias("doc_id"), F.lit("one line of some length").alias("text")).repartition(40))
    assert lines.rdd.getNumPartitions() <= 16


def test_fingerprints_lie_in_few_files(spark):
    """Ranges are worked on one by one, several to a task and a file."""
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of "), "id").alias("text"))
    few = fingerprints.fingerprint_pairs(df, target_bytes=128)
    assert few.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in fingerprints.fingerprint_pairs(df).collect()}
