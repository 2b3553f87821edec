"""SpotSigs document fingerprints, in DataFrame functions only.

A text is read as lower-case words of letters and digits. Where a run of common words (the
anchors) ends, a spot begins: the chain of the next CHAIN content words, over further
anchors if need be (a shorter chain at the end of the text). The set of its chains' hashes
is a text's fingerprint. A text without chains has the hash of its words, or of its
lower-case text if it has no word, as its only signature; the empty text has none.

Likeness is the Jaccard coefficient of two sets. As it cannot exceed the ratio of their
sizes, similar_pairs partitions sets by size and leaves out pairs whose sizes differ by more
than its threshold allows, before any intersection. The query asks for no threshold; its
likenesses are exact.

Defined results: a null text counts as empty; two empty fingerprints are alike (1). Rows are
ordered by doc_id, then text; a null id comes first. Repeated rows each get a result. An
empty table gives no rows. Extra columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm.common import materialize

CHAIN = 2
#: Ratio of sizes below which the query's likenesses would be 0 without a closer look: none is.
LEAST = 0.0
#: Documents in a bucket of neighbours, about, and buckets at most.
BUCKET_DOCS, BUCKETS = 400, 20_000

# Common words of the four languages.
ANCHORS = (
    "a an and are as at be by for from had has have he her his in is it its not of on or she that the their they this to was were which with you "
    "au aux ce ces dans de des du elle en est et il la le les leur mais ne ou par pas pour que qui se son sur un une "
    "als auch auf aus das dem den der die ein eine einem einen einer es für ich im ist mit nicht sich sie sind und von war wie wir zu zum zur "
    "al como con del el ella esta este las lo los más no para pero por su sus una y"
).split()


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """df with the column ``out``: the distinct hashes of a text's chains, ascending.

    In steps, as each step's column is used more than once: Catalyst then computes it once.
    """
    words = F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")
    df = df.withColumn("_words", words)
    # one anchor at a time: Java's matcher recurses over a repeated group, and a run of anchors can be long
    df = df.withColumn("_parts", F.split("_words", f" (?:{'|'.join(sorted(set(ANCHORS)))})(?= )", -1))
    df = df.withColumn("_spots", F.filter(F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 1, F.lit(0))), lambda c: F.length(F.trim(c)) > 0))
    behind = lambda k: F.slice("_spots", F.lit(k + 1), F.greatest(F.size("_spots") - k, F.lit(0)))
    chains = F.col("_spots")
    for k in range(1, chain):
        chains = F.zip_with(chains, behind(k), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    chains = F.filter(F.transform(chains, lambda c: F.substring_index(F.trim(c), " ", chain)), lambda c: F.length(c) > 0)
    df = df.withColumn("_hashes", F.array_sort(F.array_distinct(F.transform(chains, lambda c: F.xxhash64(c)))))
    lone = F.when(F.length(F.trim("_words")) > 0, F.xxhash64("_words")).when(F.length(text) > 0, F.xxhash64(F.lower(text)))
    df = df.withColumn(out, F.when(F.size("_hashes") > 0, F.col("_hashes")).otherwise(F.filter(F.array(lone), lambda x: x.isNotNull())))
    return df.drop("_words", "_parts", "_spots", "_hashes")


def fingerprint(sigs: Column) -> Column:
    """The set as text, whole: 16 hex digits of each signature, ascending. Likenesses are those of these sets."""
    return F.array_join(F.array_sort(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x), 16, "0")))), "")


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard coefficient, 0 where the sizes' ratio rules out ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    exact = shared.cast("double") / (F.size(a) + F.size(b) - shared)
    return F.when(large == 0, 1.0).when(small < large * least, 0.0).otherwise(exact)


def length_partition(n: Column, threshold: float) -> Column:
    """Sets that reach the threshold lie in the same partition or in neighbours."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.lit(math.log(1 / threshold)) + 1e-9).cast("int")


def similar_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of distinct fingerprints with likeness >= threshold: (fp_a, fp_b, likeness), fp_a < fp_b.

    ``prints`` has the columns fp (any orderable key, one row each) and sigs. Sets are partitioned by size, each one
    indexed under its rarest signatures only: of n signatures, a similar set shares one of the n - ceil(threshold n) + 1
    rarest. Longer postings are never cut; what a signature joins is then pruned by size and verified.
    """
    base = materialize(prints.select("fp", "sigs").dropDuplicates(["fp"]).where(F.size("sigs") > 0), "spots")
    posts = base.select("fp", F.explode("sigs").alias("sig"))
    often = posts.groupBy("sig").agg(F.count(F.lit(1)).alias("often"))
    ranked = posts.join(often, "sig").withColumn("rank", F.row_number().over(W.partitionBy("fp").orderBy("often", "sig")))
    sized = base.select("fp", F.size("sigs").alias("n"))
    index = ranked.join(sized, "fp").where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("fp", "sig", "n", length_partition(F.col("n"), threshold).alias("part"))
    other = index.select(F.col("fp").alias("fp_b"), "sig", F.col("n").alias("n_b"), F.explode(F.array(F.col("part"), F.col("part") - 1, F.col("part") + 1)).alias("part"))
    close = index.withColumnRenamed("fp", "fp_a").join(other, ["sig", "part"]).where((F.col("fp_a") < F.col("fp_b")) & (F.least("n", "n_b") >= F.greatest("n", "n_b") * threshold)).select("fp_a", "fp_b").distinct()
    a = base.select(F.col("fp").alias("fp_a"), F.col("sigs").alias("a"))
    b = base.select(F.col("fp").alias("fp_b"), F.col("sigs").alias("b"))
    found = close.join(a, "fp_a").join(b, "fp_b").withColumn("likeness", likeness(F.col("a"), F.col("b"), threshold))
    return found.where(F.col("likeness") >= threshold).select("fp_a", "fp_b", "likeness")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are <= key; in two steps if they are many."""
    below = lambda values: F.size(F.filter(values, lambda b: b <= key))
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    if len(bounds) <= 64:
        return below(F.lit(bounds))
    coarse = below(F.lit(bounds[::step]))
    fine = F.lit([bounds[i : i + step] for i in range(0, len(bounds), step)])
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + below(F.element_at(fine, F.greatest(coarse, F.lit(1)))))


def with_neighbours(docs: DataFrame, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """doc_id, text, next_text, and the columns of the window (bucket, ghost, key): rows with ghost 1 stand for the next bucket's first.

    Buckets are ranges of ids between quantiles, so the order is total without one task that sorts everything.
    A bound is the id of a bucket's first document, which is dealt to the bucket before it as well.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    t = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), key.alias("key"))
    ids = docs.select(key.alias("key"))
    n, first = ids.agg(F.count(F.lit(1)), F.min("key")).first()
    count = min(BUCKETS, max(1, n // bucket_docs))
    bounds: list[int] = []
    if count > 1:
        bounds = sorted(set(ids.agg(F.percentile_approx("key", [i / count for i in range(1, count)], 10 * count)).first()[0]))
    bucket = _bucket(F.col("key"), bounds)
    own = F.struct(bucket.alias("bucket"), F.lit(0).alias("ghost"))
    spots = [own]
    if bounds:
        at_bound = F.array_contains(F.lit(bounds), F.col("key"))
        spots.append(F.when(at_bound, F.struct((bucket - 1).alias("bucket"), F.lit(1).alias("ghost"))))
    spots.append(F.when(F.col("key") == F.lit(first if first is not None else 0), F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(2).alias("ghost"))))
    dealt = t.select("doc_id", "text", "key", F.inline(F.filter(F.array(*spots), lambda s: s.isNotNull())))
    order = W.partitionBy("bucket").orderBy("ghost", "key", "text")
    return dealt.withColumn("next_text", F.lead("text").over(order))


def query(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures, length_partition."""
    t = with_neighbours(docs)
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - int(floor(char_length(text) / 4)))"), F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), quarter))
    t = with_signatures(t, "text", "sigs")
    order = W.partitionBy("bucket").orderBy("ghost", "key", "text")
    t = t.withColumn("next_sigs", F.lead("sigs").over(order)).where(F.col("ghost") == 0)
    t = with_signatures(t.withColumn("edited", edited), "edited", "edited_sigs")
    return t.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"),
        length_partition(F.size("sigs"), 0.8).alias("length_partition"),
    )
