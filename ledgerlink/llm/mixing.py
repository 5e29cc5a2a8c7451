"""Mixing sources to target weights.

Each source's words, laid end to end, are packed into blocks of a fixed length,
a shorter one for sources of a few blocks only, so that their targets can be met. The
mix is a row of output slots, one block each, dealt into output shards of fixed
length; every shard draws multinomial counts of sources. A source's slots are
numbered, each pass over its blocks uses another pseudorandom permutation of
their indexes, and slots meet blocks in an equi-join on the index.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.llm.common import cut, permuted, sides, uniform, words

#: Sources are summed to one row each and planned on the driver; more are refused.
MAX_SOURCES = 100_000
BUCKETS = 1024
#: A source has about so many blocks at least, as far as it has words.
LEAST_BLOCKS = 64


def targets(sizes: list[int], weights: tuple[int, ...], cap: float) -> list[float]:
    """Shares of sum(sizes) by weight; none above cap times its size, the excess reshared."""
    goal, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        share = {i: left * weights[i % len(weights)] / total for i in open_}
        over = {i for i in open_ if share[i] > cap * sizes[i]}
        if not over:
            for i in open_:
                goal[i] = share[i]
            break
        for i in over:
            goal[i] = float(cap * sizes[i])
            left -= goal[i]
        open_ -= over
    return goal


def alias_table(odds: list[float]) -> list[tuple[int, float, int]]:
    """Walker's table: column i keeps i with the given chance, else gives its partner."""
    n, total = len(odds), sum(odds)
    scaled = [x * n / total for x in odds]
    keep, partner = [1.0] * n, list(range(n))
    low, high = [i for i in range(n) if scaled[i] < 1], [i for i in range(n) if scaled[i] >= 1]
    while low and high:
        i, j = low.pop(), high.pop()
        keep[i], partner[i] = scaled[i], j
        scaled[j] -= 1 - scaled[i]
        (low if scaled[j] < 1 else high).append(j)
    return [(i, keep[i], partner[i]) for i in range(n)]


class Mix:
    """A planned mix of docs (doc_id, text, source and any more columns).

    weights: by the sources' code-point order, null last, repeating. cap: most
    times a source, and so any document, is used. block_words: words a block, at
    most. shard_slots: slots an output shard.

    Null text counts as empty; a document without words is never taken. A null
    source is a source of its own. Repeated rows are separate documents. An
    empty table gives an empty mix.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block_words: int = 128, shard_slots: int = 65536, seed: int = 11):
        self.spark, self.docs, self.seed = docs.sparkSession, docs, seed
        sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("tie"))
        self.base = cut(sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(BUCKETS)).cast("int")), "mix-base")
        found = self.base.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        names, sizes = [r["source"] for r in found], [int(r["size"]) for r in found]
        goal = targets(sizes, weights, cap)
        widths = [max(1, min(block_words, s // LEAST_BLOCKS)) for s in sizes]
        blocks = [-(-s // w) for s, w in zip(sizes, widths)]
        quota = [min(cap * n, round(n * g / s)) if s else 0 for n, g, s in zip(blocks, goal, sizes)]
        rows = [(i, names[i], sizes[i], goal[i], widths[i], blocks[i], *sides(blocks[i]), quota[i]) for i in range(len(names))]
        self.sources = self.spark.createDataFrame(rows, "sid int, source string, source_size long, target double, width long, blocks long, a long, b long, quota long")
        self.quota, self.shard_slots = quota, shard_slots

    def drawn(self) -> DataFrame:
        """Slots as drawn: slot, shard, sid. The counts of a shard's sids are one multinomial draw."""
        n = len(self.quota)
        alias = self.spark.createDataFrame(alias_table([float(q) for q in self.quota]), "pick long, keep double, partner int")
        slots = self.spark.range(sum(self.quota)).withColumnRenamed("id", "slot")
        slots = slots.withColumn("pick", F.least(F.floor(uniform(F.col("slot"), F.lit(self.seed), F.lit(1)) * n), F.lit(n - 1)).cast("long"))
        own = uniform(F.col("slot"), F.lit(self.seed), F.lit(2)) < F.col("keep")
        return slots.join(F.broadcast(alias), "pick").select("slot", F.floor(F.col("slot") / self.shard_slots).alias("shard"), F.when(own, F.col("pick").cast("int")).otherwise(F.col("partner")).alias("sid"))

    def slots(self) -> DataFrame:
        """Slots as settled: slot, shard, sid, k (the source's slot number), block.

        Sources that drew over their quota give their last slots to those that
        drew less, so that every source ends on its quota of blocks.
        """
        empty = "slot long, shard long, sid int, k long, block long"
        if not sum(self.quota):
            return self.spark.createDataFrame([], empty)
        drawn = self.drawn()
        counts = cut(drawn.groupBy("shard", "sid").count(), "mix-counts")
        ahead = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("shard", "sid", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
        totals = {r["sid"]: r["n"] for r in counts.groupBy("sid").agg(F.sum("count").alias("n")).collect()}
        over = [[s, self.quota[s], totals.get(s, 0)] for s in range(len(self.quota)) if totals.get(s, 0) > self.quota[s]]
        under = [[s, totals.get(s, 0), q] for s, q in enumerate(self.quota) if totals.get(s, 0) < q]
        moves = []
        while over and under:
            (s, lo, hi), (t, at, end) = over[-1], under[-1]
            n = min(hi - lo, end - at)
            moves.append((s, lo, lo + n, t, at - lo))
            over[-1][1], under[-1][1] = lo + n, at + n
            for left in (over, under):
                if left[-1][1] == left[-1][2]:
                    left.pop()
        moved = F.broadcast(self.spark.createDataFrame(moves, "sid int, lo long, hi long, to int, shift long"))
        rank = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot"))
        numbered = drawn.withColumn("rank", rank).join(offsets, ["shard", "sid"]).withColumn("k", F.col("before") + F.col("rank") - 1)
        at = (numbered["sid"] == moved["sid"]) & (numbered["k"] >= moved["lo"]) & (numbered["k"] < moved["hi"])
        settled = numbered.join(moved, at, "left").select("slot", "shard", F.coalesce("to", numbered["sid"]).alias("sid"), (F.col("k") + F.coalesce("shift", F.lit(0))).alias("k"))
        shape = F.broadcast(self.sources.select("sid", "blocks", "a", "b"))
        epoch, place = F.floor(F.col("k") / F.col("blocks")), F.col("k") % F.col("blocks")
        image = permuted(place, F.col("blocks"), F.col("a"), F.col("b"), F.lit(self.seed), F.col("sid"), epoch)
        return settled.join(shape, "sid").select("slot", "shard", "sid", "k", image.alias("block"))

    def placed(self) -> DataFrame:
        """Documents with start: the words before theirs in their source."""
        base = self.base.join(F.broadcast(self.sources.select("sid", F.col("source").alias("name"), "source_size", "target", "width")), F.col("source").eqNullSafe(F.col("name")))
        bucket = base.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
        ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        bucket = bucket.select(F.col("sid").alias("at"), F.col("bucket").alias("in"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
        inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
        base = base.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        return base.join(bucket, (F.col("sid") == F.col("at")) & (F.col("bucket") == F.col("in"))).select("doc_id", "source", "tie", "size", "sid", "source_size", "target", "width", (F.col("before") + F.col("inside")).alias("start"))

    def pieces(self) -> DataFrame:
        """Each document's overlap with each of its blocks: block, lo, hi (words of the document), times."""
        times = self.slots().groupBy(F.col("sid").alias("at"), F.col("block").alias("no")).agg(F.count("*").alias("times"))
        docs, n = self.placed().filter("size > 0"), F.col("width")
        span = F.sequence(F.floor(F.col("start") / n), F.floor((F.col("start") + F.col("size") - 1) / n))
        docs = docs.withColumn("block", F.explode(span)).withColumn("lo", F.greatest(F.col("block") * n - F.col("start"), F.lit(0))).withColumn("hi", F.least(F.col("block") * n + n - F.col("start"), F.col("size")))
        return docs.join(times, (F.col("sid") == F.col("at")) & (F.col("block") == F.col("no")), "left").drop("at", "no").withColumn("times", F.coalesce("times", F.lit(0)))

    def taken(self) -> DataFrame:
        """One row a document: doc_id, size, source_size, target, taken, source."""
        keys = ["doc_id", "source", "size", "source_size", "target", "start"]
        some = self.pieces().groupBy(*keys).agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
        none = self.placed().filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
        columns = ["doc_id", "size", "source_size", "target", "taken", "source"]
        return some.select(columns).unionByName(none.select(columns))

    def texts(self) -> DataFrame:
        """The mix as rows of docs: for each copy of a document, its runs of taken words.

        A document all of whose blocks are taken once comes out whole; one whose
        blocks are not, in parts. Columns, of any names, and types are those of
        docs; text is the run as written, with the white space before its words,
        and n_chars, if there is one, its length.
        """
        runs = self.pieces().filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        keys = ["doc_id", "tie", "start", "copy"]
        fresh = F.coalesce(F.lag("hi").over(Window.partitionBy(*keys).orderBy("lo")) != F.col("lo"), F.lit(True)).cast("int")
        runs = runs.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(Window.partitionBy(*keys).orderBy("lo")))
        runs = runs.groupBy("source", *keys, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("size").alias("size"))
        # Repeated rows share doc_id and tie; one number each keeps them apart on both sides.
        own = Window.partitionBy("doc_id", "tie", "source")
        runs = runs.withColumn("twin", F.dense_rank().over(own.orderBy("start")))
        # The caller's columns stay together in row, whatever their names.
        docs = self.docs.select(F.struct(*[F.col(f"`{c}`") for c in self.docs.columns]).alias("row"), "doc_id", "source", F.xxhash64("text").alias("tie"))
        docs = docs.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "tie", "source").orderBy("doc_id")))
        runs = runs.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), F.col("source").alias("s"), "twin", "lo", "hi", "size")
        # Exact copies with many runs are drawn to several documents; hot ids are left to the adaptive join.
        on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("n") == F.col("twin"))
        joined, was = docs.join(runs, on), F.col("row.text")
        inked = F.regexp_extract_all(was, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
        part = F.array_join(F.slice(inked, (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), "")
        text = F.when((F.col("lo") == 0) & (F.col("hi") == F.col("size")), was).otherwise(part)
        fields = {f.name: f.dataType for f in self.docs.schema.fields}
        made = {"text": text} | ({"n_chars": F.length(text).cast(fields["n_chars"])} if "n_chars" in fields else {})
        return joined.select(*[made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in self.docs.columns])
