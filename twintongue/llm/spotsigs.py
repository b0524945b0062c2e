"""Document fingerprints by SpotSigs, in DataFrame operations only.

A signature is a common word (the anchor) and the CHAIN content words, which are
no anchors, that follow it; a document's fingerprint is the set of its signatures,
hashed to 32 bits and written in hexadecimal in ascending order. A text without
signatures (fewer content words after any anchor) has the set of its words.
Likeness is the Jaccard similarity of two fingerprints.

With the words W, the anchors' places a(0) < a(1) < ... in W and the content words
C, the words that follow anchor j are C[a(j) - j], C[a(j) - j + 1], ..., so that
array functions build all signatures in one pass over each text.

near_duplicates joins fingerprints: only those meet whose sizes can reach the
similarity (partitions by set length) and which share one of the rarest signatures
that a similar pair must share (a prefix in order of frequency); a signature that
is in very many documents is no row of that join unless it is in such a prefix.

next_texts pairs each document with the next in descending order of doc_id without
a global sort of texts: ranges of doc_id are dealt out, ordered by themselves, and
the last of each range sees a copy of the first document of the next.

Defined results: null texts are empty; empty fingerprints are like each other with
1 and unlike all others with 0; a null doc_id is below all others; rows with the
same doc_id are ordered by text, repeated rows follow each other; other columns are
not read; an empty table gives an empty table; a single document is next to
itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN = 2
SIMILARITY = 0.8
#: Anchors: common words of four languages (fixed values).
ANCHORS = (
    "the of and to in a is that it for was with as by this at are be from or an on but not have had "
    "der die und das den von zu mit sich auf ist im dem nicht ein eine für des es "
    "le la les de et un une du est dans qui pour pas sur au que en "
    "el los las y una del se por con para su lo al como"
).split()


def _is_anchor(w: Column) -> Column:
    return w.isin(ANCHORS)


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted set of a text's signatures; an array of 32-bit integers."""
    return F.transform(F.array(words(text)), lambda w: _signatures_of(w, chain))[0]


def _signatures_of(w: Column, chain: int) -> Column:
    anchors = F.filter(F.transform(w, lambda x, i: F.when(_is_anchor(x), i)), lambda i: i.isNotNull())
    pair = F.struct(w.alias("w"), anchors.alias("a"), F.filter(w, lambda x: ~_is_anchor(x)).alias("c"))

    def build(p: Column) -> Column:
        c = p["c"]

        def one(a: Column, j: Column) -> Column:
            first = a - j
            return F.when(first + chain <= F.size(c), F.hash(F.get(p["w"], a), *[F.get(c, first + k) for k in range(chain)]))

        spots = F.filter(F.transform(p["a"], one), lambda x: x.isNotNull())
        return F.array_sort(F.array_distinct(F.when(F.size(spots) > 0, spots).otherwise(F.transform(p["w"], lambda x: F.hash(x)))))

    return F.transform(F.array(pair), build)[0]


def as_text(sigs: Column) -> Column:
    """Eight hexadecimal digits a signature."""
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def next_texts(docs: DataFrame, columns: list[str], order: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """docs with next_<column>, of the next document in descending order of `order` and text; after the last comes the first."""
    spark = docs.sparkSession
    n = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)))
    share = F.array(*[F.lit(i / n) for i in range(1, n)])
    bounds = docs.agg(F.percentile_approx(key, share, F.lit(10_000)).alias("at")).first()["at"] if n > 1 else None
    bounds = sorted(set(bounds or []))
    # Range k holds the keys above bound k - 1 and up to bound k; found by halving.
    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key <= bounds[mid], place(lo, mid)).otherwise(place(mid + 1, hi))

    placed = docs.withColumn("_range", place(0, len(bounds)))
    top = placed.groupBy("_range").agg(F.max(F.struct(key.alias("k"), F.coalesce("text", F.lit("")).alias("t"))).alias("_top"))
    # The first of each range, seen from the next range above that is not empty; from the lowest range the first of all.
    above = Window.orderBy("_range")
    top = top.withColumn("_to", F.coalesce(F.lead("_range").over(above), F.first("_range").over(above)))
    firsts = placed.join(F.broadcast(top.select(F.col("_range").alias("_r"), "_top", "_to")), (F.col("_range") == F.col("_r")) & (key == F.col("_top.k")) & (F.coalesce("text", F.lit("")) == F.col("_top.t")))
    ghosts = firsts.withColumn("_range", F.col("_to")).withColumn("_ghost", F.lit(True)).drop("_r", "_top", "_to")
    every = placed.withColumn("_ghost", F.lit(False)).unionByName(ghosts)
    turn = Window.partitionBy("_range").orderBy("_ghost", key.desc(), F.coalesce("text", F.lit("")).desc())
    return every.select("*", *[F.lead(c).over(turn).alias(f"next_{c}") for c in columns]).where(~F.col("_ghost")).drop("_ghost", "_range")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next: see the module; edited is the text with its second half from the next document."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("sigs", signatures(F.col("text"), chain))
    rows = next_texts(base, ["text", "sigs"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited"), chain))
    return rows.select("doc_id", "n_chars", "edited", as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, chain: int = CHAIN) -> DataFrame:
    """a, b, near: pairs of classes (the smallest doc_id of each fingerprint) at least so similar, without repeats.

    Documents with one fingerprint are one class; see classes for the members.
    """
    sets = classes(docs, id_col, text_col, chain).groupBy("class_id", "sigs").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.size("sigs")).where("size > 0")
    each = sets.select("class_id", "size", F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count(F.lit(1)).alias("often"))
    # A similar pair shares one of the size - ceil(similarity * size) + 1 rarest of either.
    rank = Window.partitionBy("class_id").orderBy("often", "sig")
    rare = each.join(often, "sig").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * similarity) + 1)
    # Length partitions: sets of partition p meet those of p and p + 1 only, as sizes grow by 1 / similarity from one to the next.
    import math

    part = F.floor(F.log(F.col("size").cast("double")) / math.log(1 / similarity) + 1e-9).cast("int")
    rare = rare.withColumn("part", part).select("class_id", "size", "sig", "part")
    left = rare.select(F.col("class_id").alias("a"), F.col("size").alias("sa"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("meet"))
    right = rare.select(F.col("class_id").alias("b"), F.col("size").alias("sb"), "sig", F.col("part").alias("meet"))
    fits = (F.col("sb") > F.col("sa")) | ((F.col("sb") == F.col("sa")) & (F.col("a") < F.col("b")))
    pairs = left.join(right, ["sig", "meet"]).where(fits & (F.col("sa") >= F.col("sb") * similarity)).select("a", "b").distinct()
    sigs = sets.select("class_id", "sigs")
    both = pairs.join(sigs.select(F.col("class_id").alias("a"), F.col("sigs").alias("x")), "a").join(sigs.select(F.col("class_id").alias("b"), F.col("sigs").alias("y")), "b")
    near = both.withColumn("near", likeness(F.col("x"), F.col("y"))).where(F.col("near") >= similarity)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "near")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """doc_id, class_id (the smallest doc_id with this fingerprint), sigs."""
    sigs = docs.select(F.col(id_col).cast("long").alias("doc_id"), signatures(F.coalesce(F.col(text_col), F.lit("")), chain).alias("sigs"))
    first = sigs.groupBy("sigs").agg(F.min("doc_id").alias("class_id"))
    return sigs.join(first, "sigs").select("doc_id", "class_id", "sigs")
