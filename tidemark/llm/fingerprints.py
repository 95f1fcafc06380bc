"""Document fingerprints by bin-wise consistent weighted sampling, with DataFrame functions alone.

Terms are words, weights their counts. Hashes of a term give its bin, r and c from Gamma(2, 1) (minus the
logarithm of the product of two uniforms) and b from U(0, 1). A term of weight w has t = floor(ln w / r + b) and
ln a = ln c - r (t - b) - r; a bin's sample is the term and t with the least a among its terms (Ioffe's sampling
in each bin, Li, Li and Zhang 2019). As ln a is a function of (term, t) and a real number, the minimum itself
stands for its term. Two texts agree in a bin with the probability of the generalised Jaccard similarity of the
terms there, and over all bins at the rate of that of the texts, sum of least over sum of largest weights. A bin
without a term takes the sample of the next one that has any, hashed with the distance. One sample per term
instead of one per term and digit of the signature keeps the cost of long signatures bounded.

Rows meet their neighbours in descending id order without a global window: ids are cut at quantiles that are
ids themselves, each range is one window, and its first row is also sent to the range before as a guard. Terms
are counted and sampled where their row lies, so that texts are shuffled once and terms never.

Defined results: a null text is empty; a text without words has the fingerprint '' and likeness 1 to another
such, 0 to any other; equal texts have equal fingerprints; very long texts are taken whole; ids must be whole numbers;
rows with one id follow each other by text, null ids come last; repeated rows are kept; an empty table gives no rows;
of other columns none is kept.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_util import in_few

WORDS = r"[ \t-\r]+"


def _uniform(bits: Column) -> Column:
    """Of 32 bits, never 0 or 1."""
    return (bits.cast("double") + 0.5) / float(1 << 32)


def _gamma(h: Column) -> Column:
    """Gamma(2, 1) from 64 bits."""
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    return -F.ln(_uniform(low) * _uniform(high))


def log_sample(term: Column, weight: Column) -> Column:
    """ln a of a term (a 64-bit hash) with a weight; null where the weight is 0."""
    r, c = _gamma(F.xxhash64(term, F.lit(1))), F.ln(_gamma(F.xxhash64(term, F.lit(2))))
    b = _uniform(F.shiftrightunsigned(F.xxhash64(term, F.lit(3)), 32))
    t = F.when(weight == 1, F.lit(0.0)).otherwise(F.floor(F.ln(weight.cast("double")) / r + b).cast("double"))
    return F.when(weight > 0, c - r * (t - b) - r)


def signature(full: str, size: int) -> Column:
    """The samples of all bins as 32-bit hashes, from a column of (bin, value) of the bins with terms, in order."""
    column = F.col(full)
    digit = lambda x, d: F.shiftright(F.xxhash64(x["value"], F.pmod(x["bin"] - d, F.lit(size))), 32).cast("int")

    def run(x: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(column, i - 1)["bin"] + 1)
        return F.transform(F.sequence(start, x["bin"]), lambda d: digit(x, d))

    first, last = F.get(column, F.lit(0)), F.element_at(column, -1)["bin"]
    rest = F.when(last < size - 1, F.transform(F.sequence(last + 1, F.lit(size - 1)), lambda d: digit(first, d))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(column) == 0, F.array().cast("array<int>")).otherwise(F.concat(F.flatten(F.transform(column, run)), rest))


def as_text(signature: Column) -> Column:
    """8 hexadecimal digits a sample."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two texts agree."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same.cast("double") / F.size(a))


def _ranges(docs: DataFrame, key: str, target_bytes: int) -> tuple[list[int], int]:
    """Ids that cut the table into ranges, descending, and a number of partitions for it."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    partitions = int(min(100_000, max(8, size // target_bytes)))
    count = min(100_000, 4 * partitions)
    shares = [i / count for i in range(1, count + 1)]
    found = docs.agg(F.percentile_approx(key, shares, max(100_000, 4 * count)).alias("cuts")).first()["cuts"]
    return sorted({int(x) for x in found or []}, reverse=True), partitions


def _range_of(key: Column, cuts: list[int]) -> Column:
    """The number of the range of an id: how many cuts are no smaller, less one; found in two steps."""
    step = max(1, isqrt(len(cuts)))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    not_smaller = lambda values: F.size(F.filter(values, lambda x: x >= key))
    coarse = F.greatest(not_smaller(F.lit([g[0] for g in groups])) - 1, F.lit(0))
    fine = F.element_at(F.array(*[F.lit(g) for g in groups]), coarse + 1)
    return F.when(key.isNull(), F.lit(len(cuts) - 1)).otherwise(coarse * step + F.greatest(not_smaller(fine) - 1, F.lit(0)))


def neighbours(docs: DataFrame, key: str, target_bytes: int) -> tuple[DataFrame, int]:
    """Rows (range, nth, guard, key, text, next_text) in descending key order, and their number of partitions; guards
    repeat the next range's first row."""
    cuts, partitions = _ranges(docs, key, target_bytes)
    own = docs.withColumn("range", _range_of(F.col(key), cuts or [0]).cast("int"))
    # a table of null keys alone is one range, each of whose rows may be the first
    first = F.col(key) == F.element_at(F.lit(cuts), F.col("range") + 1) if cuts else F.lit(True)
    cuts = cuts or [0]
    before = F.pmod(F.col("range") - 1, F.lit(len(cuts)))
    copies = F.when(first, F.array(F.struct("range", F.lit(False).alias("guard")), F.struct(before.alias("range"), F.lit(True).alias("guard"))))
    copies = copies.otherwise(F.array(F.struct("range", F.lit(False).alias("guard"))))
    rows = own.withColumn("copy", F.explode(copies)).select(F.col("copy.range").alias("range"), F.col("copy.guard").alias("guard"), key, "text")
    order = Window.partitionBy("range").orderBy("guard", F.col(key).desc_nulls_last(), "text")
    return rows.repartition(partitions, "range").select("*", F.row_number().over(order).alias("nth"), F.lead("text").over(order).alias("next_text")), partitions


def fingerprint_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", bins: int = 64, target_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with likenesses.

    The edited text has the last half of the code points replaced by the first as many, or all, of the next
    text in descending key order (after the last: the first). Returns the key, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.
    """
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows, partitions = neighbours(docs, "key", target_bytes)
    keep = F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))")
    edited = F.concat("keep", F.substring(F.col("next_text"), F.lit(1), F.length("text") - F.length("keep")))
    rows = rows.withColumn("keep", keep).withColumn("edited", edited)
    # up to the last space before the cut the words are those of both texts; from there on each text has its own
    cut = F.length("keep") - F.length(F.substring_index("keep", " ", -1))
    rows_cut = rows.withColumn("cut", cut)
    part = lambda t, a, b: F.struct(t.alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    after = lambda c: F.expr(f"substring({c}, cut + 1, length({c}))")
    # what stands for the document itself travels as one more term, so that no second pass needs its text
    note = F.concat_ws("|", F.coalesce(F.sha2("edited", 256), F.lit("")), F.length("text").cast("string"), F.col("guard").cast("string"), F.coalesce(F.hex(F.col("key").cast("string")), F.lit("-")))
    rows_cut = rows_cut.withColumn("note", note)
    parts = F.when(F.col("guard"), F.array(part(F.col("text"), 1, 0), part(F.col("note"), 0, 0)))
    parts = parts.otherwise(F.array(part(F.expr("substring(text, 1, cut)"), 1, 1), part(after("text"), 1, 0), part(after("edited"), 0, 1), part(F.col("note"), 0, 0)))
    words = rows_cut.select("range", "nth", F.explode_outer(parts).alias("p")).select("range", "nth", "p.a", "p.b", F.explode_outer(F.split("p.t", WORDS)).alias("word"))
    noted = (F.col("a") == 0) & (F.col("b") == 0)
    terms = words.where("word <> ''").select("range", "nth", F.xxhash64("word").alias("term"), F.when(noted, F.col("word")).alias("note"), "a", "b")
    facts = terms.groupBy("range", "nth", "term", "note").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    term = F.col("term")
    bin_of = F.when(F.col("note").isNull(), F.pmod(F.xxhash64(term, F.lit(4)), F.lit(bins)).cast("int")).otherwise(-1)
    samples = facts.select("range", "nth", "note", bin_of.alias("bin"), log_sample(term, F.col("a")).alias("a"), log_sample(term, F.col("b")).alias("b"))
    best = samples.groupBy("range", "nth", "bin", "note").agg(F.min("a").alias("a"), F.min("b").alias("b"))
    found = best.groupBy("range", "nth").agg(F.array_sort(F.collect_list(F.struct("bin", "a", "b"))).alias("bins"), F.max("note").alias("note"))
    of = lambda c: F.transform(F.filter("bins", lambda x: x[c].isNotNull()), lambda x: F.struct(x["bin"].alias("bin"), x[c].alias("value")))
    signed = found.select("range", "nth", F.split("note", r"\|").alias("note"), of("a").alias("a"), of("b").alias("b"))
    fact = lambda i: F.get("note", F.lit(i))
    out = signed.select("range", "nth", (fact(2) == "true").alias("guard"), F.when(fact(3) != "-", F.decode(F.unhex(fact(3)), "UTF-8")).cast(kind).alias("key"), fact(1).cast("long").alias("n_chars"), fact(0).alias("edited_sha256"), signature("a", bins).alias("own"), signature("b", bins).alias("other"))
    out = out.withColumn("next", F.lead("own").over(Window.partitionBy("range").orderBy("nth"))).where(~F.col("guard"))
    return in_few(out, partitions).select(
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
