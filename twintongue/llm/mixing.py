"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources in code point order (null last) get the weights in turn. The targets
share `share` of all words in proportion to the weights; none exceeds `most`
times its source's words, and what is above is shared again by weight. Solved in
closed form: with sources in order of cap / weight, those up to some point are at
their cap and the others get one multiple of their weights.

A source whose target is r times its words takes floor(r) whole copies of every
document. The rest, f = r - floor(r), is an unequal-probability sample: a
document's inclusion probability p is the root of its size times a rate of its
source, 1 at most, such that the expected words are f times the source's (the rate
is found in rounds: what is certain to be drawn leaves the others a smaller rest);
U is a fixed hash of its doc_id and text, and documents are ranked by the odds of U
divided by the odds of p (Pareto order sampling), those with p = 1 first. The sample
is fixed in size, which is counted in words: the documents in that order up to the
point nearest to the target.

Ranks are never sorted within a whole source: 256 coarse bins of the ranking
variable, then 256 fine ones of one of them, find where the sample ends, and only
the different documents of that fine bin are ordered. Of the sources, only their
sums (a row each) meet in one task.

Defined results: a null text has size 0; documents without words are never drawn
(whole copies still count, 0 words each); a null source is a source of its own;
repeated rows (same doc_id and text) tie, and where the sample ends among them as
many are drawn as the target asks for; other columns are kept, whatever their names
(where one is called as a column that is added, that has underscores behind its
name); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, fresh, together, written

WORD = "[^\\x20\\x09-\\x0D]+"
#: Coarse bins, and fine bins of each.
BINS = 256
#: So many sources at most are broadcast (a row of about 100 bytes each).
BROADCAST = 10_000


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """sizes: _source, _size, _n (so many documents) -> _source, source_size, target; a row for each source."""
    per = sizes.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"))
    by_name = Window.orderBy(F.col("_source").isNull(), "_source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size").cast("double") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("_source").isNull(), "_source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    per = per.withColumn("cap_before", F.coalesce(F.sum("cap").over(order), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    per = per.withColumn("total", F.sum("source_size").over(whole).cast("double") * share).withColumn("w_all", F.sum("weight").over(whole))
    per = per.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
    # The first source, in order of ratio, whose cap is above what the level gives it sets the level of all.
    per = per.withColumn("the_level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"])
    target = F.when(F.col("the_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("the_level") * F.col("weight")))
    return per.select("_source", "source_size", target.alias("target"))


def uniform(id_col: str, text_col: str):
    """A number above 0 and below 1, fixed by the document: 52 bits of an md5."""
    hashed = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def _facts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with _id, _source, _size and _u."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.withColumns({"_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "_source": F.col(source_col), "_size": words, "_u": uniform(id_col, text_col)})


def _root():
    """A thousand times the root of the size, in whole numbers, so that sums don't depend on their order."""
    return F.floor(F.sqrt(F.col("_size").cast("double")) * 1000).cast("decimal(38,0)")


def rates(sizes: DataFrame, per: DataFrame, n_sources: int) -> DataFrame:
    """per with _rate: p of a document is _rate * _root(), 1 at most, and adds up to _rest words."""
    words = F.col("_size").cast("decimal(38,0)") * F.col("_n")
    drawable = sizes.where("_size > 0")
    now = written(per.withColumn("_rate", F.lit(0.0)), "mixing-rates")
    while True:
        known = _joined(drawable, now.select("_source", "_rate"), n_sources)
        certain = F.col("_rate") * _root().cast("double") >= 1
        sums = known.groupBy("_source").agg(F.sum(F.when(certain, words)).alias("_sure"), F.sum(F.when(~certain, words * _root())).alias("_tail")).withColumnRenamed("_source", "_ss")
        left = F.col("_rest") - F.coalesce(F.col("_sure"), F.lit(0)).cast("double")
        rate = F.when((F.col("_rest") > 0) & (F.col("_tail") > 0), F.greatest(F.col("_rate"), left / F.col("_tail").cast("double"))).otherwise(F.col("_rate"))
        following = now.join(sums, F.col("_source").eqNullSafe(F.col("_ss")), "left").withColumn("_new", rate)
        following = written(following.select(*per.columns, F.col("_new").alias("_rate"), (F.col("_new") > F.col("_rate")).alias("_moved")), "mixing-rates")
        now = following.drop("_moved")
        if following.where("_moved").isEmpty():
            return now


def _joined(rows: DataFrame, per: DataFrame, n_sources: int) -> DataFrame:
    """rows with their source's columns: broadcast if that is at most BROADCAST rows, else with each source's rows dealt to 64 tasks."""
    per = per.withColumnRenamed("_source", "_ps")
    if n_sources <= BROADCAST:
        return rows.join(F.broadcast(per), F.col("_source").eqNullSafe(F.col("_ps"))).drop("_ps")
    if "_u" not in rows.columns:  # sums by size, not documents
        return rows.join(per, F.col("_source").eqNullSafe(F.col("_ps"))).drop("_ps")
    per = per.withColumn("_psalt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    rows = rows.withColumn("_salt", F.floor(F.col("_u") * 64).cast("int"))
    return rows.join(per, F.col("_source").eqNullSafe(F.col("_ps")) & (F.col("_salt") == F.col("_psalt"))).drop("_ps", "_psalt", "_salt")


def _ranked(rows: DataFrame) -> DataFrame:
    """_q, the Pareto ranking variable of documents that can be drawn (else null), and its bins."""
    p = F.col("_rate") * _root().cast("double")
    odds = F.when(p >= 1, F.lit(0.0)).otherwise(F.col("_u") / (1 - F.col("_u")) * (1 - p) / p)
    rows = rows.withColumn("_q", F.when((F.col("_size") > 0) & (F.col("_rest") > 0), odds))
    return rows.withColumn("_bin", F.floor(F.col("_q") / (1 + F.col("_q")) * BINS * BINS).cast("long")).withColumn("_coarse", F.floor(F.col("_bin") / BINS))


def _end(rows: DataFrame, name: str) -> DataFrame:
    """rows: _source, _rest, _before (the words of bins before), `name` (a bin), _size -> the bin in which each source's sample ends, and the words before it."""
    bins = rows.groupBy("_source", name, "_rest", "_before").agg(F.sum("_size").alias("_words"))
    upto = Window.partitionBy("_source").orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    ends = bins.withColumn("_to", F.sum("_words").over(upto) + F.col("_before")).where((F.col("_to") >= F.col("_rest")) & (F.col("_to") - F.col("_words") < F.col("_rest")))
    return ends.select("_source", F.col(name).alias("_at"), (F.col("_to") - F.col("_words")).alias("_before"))


_KEY = ("_q", "_u", "_id")


def _numbered(ties: DataFrame) -> DataFrame:
    """Repeated rows, of which some are drawn, numbered from 0 in _number, by the partitions that read them: a source's can be a third of all rows."""
    ties = ties.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.floor(F.col("_row") / (1 << 33)))
    per = ties.groupBy(*_KEY, "_part").agg(F.count(F.lit(1)).alias("_k"))
    per = per.withColumn("_first", F.coalesce(F.sum("_k").over(Window.partitionBy(*_KEY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = ties.withColumn("_place", F.row_number().over(Window.partitionBy(*_KEY, "_part").orderBy("_row")) - 1)
    return numbered.join(per.drop("_k"), [*_KEY, "_part"]).withColumn("_number", F.col("_first") + F.col("_place"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, most: int = 2, with_docs: bool = False) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, copies (0 to `most`); with_docs: after the document's own columns, under the names _size, _source_size, _target and _copies."""
    facts = written(_facts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), "doc_id", "text", "source").select("doc_id", "_id", "_source", "_size", "_u"), "mixing")
    sizes = written(facts.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_n")), "mixing-sizes")
    per = targets(sizes, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per = written(per.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")), "mixing-sources")
    n = per.count()
    per = rates(sizes, per, n)
    ranked = _ranked(_joined(facts, per, n)).where(F.col("_q").isNotNull())
    coarse = written(_end(ranked.withColumn("_before", F.lit(0)), "_coarse"), "mixing-coarse")
    fine = written(_end(_joined(ranked, coarse, n).where(F.col("_coarse") == F.col("_at")), "_bin"), "mixing-fine")
    edge = _joined(ranked, fine, n).where(F.col("_bin") == F.col("_at")).groupBy("_source", "_at", "_before", "_rest", "_size", *_KEY).agg(F.count(F.lit(1)).alias("_n"))
    words = F.col("_size") * F.col("_n")
    edge = edge.withColumn("_to", F.sum(words).over(Window.partitionBy("_source").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before"))
    # Of the documents that the target falls into, so many that it is nearest.
    last = edge.where((F.col("_to") >= F.col("_rest")) & (F.col("_to") - words < F.col("_rest")))
    take = F.ceil((F.col("_rest") - (F.col("_to") - words)) / F.col("_size") - 0.5)
    last = last.select(F.col("_source").alias("_es"), F.col("_at").alias("_end"), F.struct(*_KEY).alias("_last"), take.alias("_take"), (take < F.col("_n")).alias("_parted"))
    cut = written(per.join(last, F.col("_source").eqNullSafe(F.col("_es")), "left").drop("_es"), "mixing-cuts")
    key = F.struct(*_KEY)

    def out(rows: DataFrame, drawn) -> DataFrame:
        drawn = F.when(F.col("_q").isNull(), F.lit(False)).when(F.col("_end").isNull() | (F.col("_bin") < F.col("_end")), F.lit(True)).when(F.col("_bin") > F.col("_end"), F.lit(False)).otherwise(drawn)
        copies = F.col("_whole") + F.coalesce(drawn, F.lit(False)).cast("long")
        if with_docs:
            more = (F.col("_size"), F.col("source_size"), F.col("target"), copies)
            return rows.select(*together(docs), *[c.alias(fresh(n, docs.columns)) for c, n in zip(more, ("_size", "_source_size", "_target", "_copies"))])
        return rows.select("doc_id", F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"))

    if with_docs:
        facts = _facts(docs.select(apart(docs), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")), "doc_id", "text", "source")
    rows = _ranked(_joined(facts, cut, n))
    if cut.where("_parted and _take > 0").isEmpty():
        return out(rows, (key < F.col("_last")) | ((key == F.col("_last")) & (F.col("_take") > 0)))
    tied = F.coalesce((key == F.col("_last")) & F.col("_parted"), F.lit(False))
    return out(rows.where(~tied), key <= F.col("_last")).unionByName(out(_numbered(rows.where(tied)), F.col("_number") < F.col("_take")))
