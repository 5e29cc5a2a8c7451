"""Exact Jaccard self-join of documents by word shingles.

Documents with equal shingle sets are one node. Nodes that link share a
signature: with tokens in one global order, a set of n tokens that may miss d of
them in a partner has as its prefix the first tokens among which no d losses
leave every signature broken. A rare token is a signature of its own. Frequent
tokens fall into classes, and within a class every two of them together are a
signature; a class of c tokens breaks after c - 1 losses, so the prefix is
extended by one token a class. Signatures are kept apart by size, in bands that
linked sets share or neighbour; larger bands have more classes, so that a set's
signatures grow as its size. Nodes under one signature form a block with
the smallest of them, blocks are cut into chunks, pairs of chunks are
candidates; parity sketches, which bound the sets' difference from below, thin
them, and the sets themselves decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.common import bind, bounded_batches, components, cut, grouped, small, words

#: A token in more prefixes than this is frequent.
FREQUENT = 2
#: A set that may miss d tokens has one class of frequent tokens for so many of d.
CLASS_TOKENS = 6
#: A chunk of a block: about so many nodes, and so many tokens.
CHUNK_NODES, CHUNK_TOKENS = 512, 1 << 19
#: Tasks that a large block's rows are dealt to before it is cut into chunks.
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_set(text: Column, k: int) -> Column:
    """Sorted 64-bit hashes of the distinct k-word shingles of text, A-Z lower-cased.

    Of fewer words the whole sequence is the one shingle; without words, or for
    null, the set is empty.
    """

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        none = F.array().cast("array<long>")
        return F.when(F.size(w) == 0, none).when(F.size(w) < k, F.array(F.xxhash64(w))).otherwise(F.sort_array(F.array_distinct(many)))

    return bind(words(F.translate(text, UPPER, LOWER)), hashes)


def _missable(n: Column, num: int, den: int) -> Column:
    """Tokens of n that a linked partner may lack: n - ceil(n num / den)."""
    return n - F.floor((n * num + den - 1) / den).cast("int")


def _packed(sketch: bool):
    """(node, q1, q2, set, k1, k2) to (node, n, data): the set's hashes, or their sketch, the parity of tokens by low bits.

    Rows whose set is not the wanted one (another text of that doc_id) drop out
    here: as a filter the keys would be join keys, hashed for every document.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            own = np.ones(batch.num_rows, bool)
            for key, wanted in (("k1", "q1"), ("k2", "q2")):
                own &= batch.column(key).to_numpy() == batch.column(wanted).to_numpy()
            batch = batch.filter(pa.array(own))
            sets = batch.column("set")
            values, offsets = sets.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *np.diff(sets.offsets.to_numpy())]).astype(np.int64)
            data = []
            for i in range(batch.num_rows):
                v = values[offsets[i] : offsets[i + 1]]
                if sketch:
                    width = max(64, 1 << (max(len(v) - 1, 1)).bit_length())
                    v = np.packbits((np.bincount(v & (width - 1), minlength=width) & 1).astype(np.uint8), bitorder="little")
                data.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.diff(offsets), pa.int32()), pa.array(data, pa.binary())], ["node", "n", "data"])

    return run


def _folded(sketch: bytes, size: int):
    import numpy as np

    x = np.frombuffer(sketch, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _near(n, sketches, num: int, den: int):
    """For each i: i and the later j whose sizes and sketches allow a link. n is sorted."""
    import numpy as np

    sizes = np.array([len(s) for s in sketches])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes >= size)
        table = np.stack([_folded(sketches[r], size) for r in rows])
        m = n[rows].astype(np.int64)
        for at in np.flatnonzero(sizes[rows] == size):
            # Pairs meet at the width of the smaller sketch; n sorted keeps partners after at, or before it when wider.
            to = np.arange(len(rows))
            to = to[(to > at) | (sizes[rows] > size)]
            to = to[(num * np.maximum(m[to], m[at]) <= den * np.minimum(m[to], m[at]))]
            if not len(to):
                continue
            apart = np.bitwise_count(table[to] ^ table[at]).sum(1, dtype=np.int64)
            to = to[apart * (den + num) <= (m[to] + m[at]) * (den - num)]
            if len(to):
                yield rows[at], rows[to]


def _units(batches, columns):
    """Groups of a unit with each node once: arrays sorted by n."""
    import numpy as np

    for t, starts in grouped(batches, ["leader", "lo", "hi"]):
        node, n = t.column("node").to_numpy(), t.column("n").to_numpy()
        more = {c: t.column(c).to_pylist() for c in columns}
        ids = [t.column(c).to_numpy() for c in ("leader", "lo", "hi")]
        for s, e in zip(starts[:-1], starts[1:]):
            _, own = np.unique(node[s:e], return_index=True)
            order = s + own[np.argsort(n[s + own], kind="stable")]
            if len(order) > 1:
                yield [x[s] for x in ids], node[order], n[order], {c: [v[i] for i in order] for c, v in more.items()}


def _thinned(num: int, den: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for ids, node, n, more in _units(batches, ["data"]):
            keep = np.zeros(len(node), bool)
            for i, to in _near(n, more["data"], num, den):
                keep[i] = keep[to] = True
            if k := int(keep.sum()):
                yield pa.RecordBatch.from_arrays([*[pa.array(np.full(k, x), t) for x, t in zip(ids, (pa.int64(), pa.int32(), pa.int32()))], pa.array(node[keep])], ["leader", "lo", "hi", "node"])

    return run


def _intersections(sets):
    """Sizes of all pairwise intersections, by products of incidence blocks."""
    import numpy as np

    m = len(sets)
    token, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    _, token, times = np.unique(token, return_inverse=True, return_counts=True)
    live = times[token] > 1
    token, owner = token[live], owner[live]
    dense = np.cumsum(times > 1) - 1
    token = dense[token]
    out, width = np.zeros((m, m), np.float32), max(64, (1 << 22) // m)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [lo, lo + width])
        x = np.zeros((m, width), np.float32)
        x[owner[a:b], token[a:b] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _linked(num: int, den: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, node, n, more in _units(batches, ["data"]):
            sets, m = [np.frombuffer(d, np.int64) for d in more["data"]], len(node)
            n = n.astype(np.int64)
            if m > 2:
                shared = _intersections(sets)
            else:
                shared = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
                shared[1] = shared[0][::-1]
            link = den * shared >= num * (n[:, None] + n[None, :] - shared)
            np.fill_diagonal(link, False)
            left, a, b = set(np.flatnonzero(link.any(1)).tolist()), [], []
            while left:  # one star for each component
                root = min(left, key=lambda i: node[i])
                left.discard(root)
                stack = [root]
                while stack:
                    at = stack.pop()
                    found = [j for j in np.flatnonzero(link[at]).tolist() if j in left]
                    left.difference_update(found)
                    stack += found
                    a += found
                    b += [root] * len(found)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return run


def _classes(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): a row (doc_id, h, n, k1, k2) for each of docs, h its text's hash; a row (k1, k2, n, best) for each set.

    best is the first row of the set's component: id (doc_id, nulls last) and h.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    missable, n = _missable(F.col("n"), num, den), F.size("set")
    width = 1.0001 * math.log(den / num)
    band = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    classes = lambda b: F.greatest(F.lit(1), F.ceil(F.exp(b * F.lit(width)) * (1 - num / den) / CLASS_TOKENS).cast("int"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), shingle_set(F.col("text"), k).alias("set"))
    hashed = hashed.select("doc_id", "h", n.alias("n"), F.xxhash64("set").alias("k1"), F.hash("set").alias("k2"), "set")
    prefix = F.when(F.col("n") > 0, F.slice("set", 1, missable + 1 + classes(band + 1)))
    rows = cut(hashed.select("doc_id", "h", "n", "k1", "k2", prefix.alias("prefix"), F.monotonically_increasing_id().alias("rid")), "jaccard-rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h"))
    nodes = cut(rows.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("rid").alias("node"), F.min(first).alias("rep")), "jaccard-nodes")

    # Signatures.
    own = rows.join(small(nodes.select(F.col("node").alias("rid")), 16), "rid", "left_semi")
    posted = own.select(F.col("rid").alias("node"), "n", F.posexplode("prefix").alias("pos", "token"))
    often = posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    hit = F.struct("token", "pos", (F.col("df") > FREQUENT).alias("many"))
    hits = posted.join(often, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    hits = hits.select("node", "n", "hits", F.explode(F.array(band, band + 1)).alias("band")).withColumn("classes", classes(F.col("band")))
    class_of = lambda token: F.pmod(F.xxhash64(token), F.col("classes"))
    many = F.filter("hits", lambda x: x["many"])
    frequent = F.transform(many, lambda x: F.struct(class_of(x["token"]).alias("c"), x["token"].alias("t"), x["pos"].alias("pos")))
    hits = hits.withColumn("frequent", F.sort_array(frequent))
    hits = hits.withColumn("end", missable + 1 + F.size(F.array_distinct(F.transform("frequent", lambda x: x["c"]))))
    rare = F.filter("hits", lambda x: ~x["many"] & (x["pos"] < F.col("end")))
    single = F.transform(rare, lambda x: F.xxhash64(x["token"], F.col("band")))
    later = lambda a, x, i: F.filter(F.slice(a, i + 2, F.greatest(F.size(a) - i - 1, F.lit(0))), lambda y: y["c"] == x["c"])
    signature = lambda x, y: F.xxhash64(x["t"], y["t"], F.col("band"))
    in_prefix = F.filter("frequent", lambda x: x["pos"] < F.col("end"))
    pairs = bind(in_prefix, lambda a: F.flatten(F.transform(a, lambda x, i: F.transform(later(a, x, i), lambda y: signature(x, y)))))
    signed = cut(hits.select("node", "n", F.explode(F.concat(single, pairs)).alias("sig")), "jaccard-signed")

    # Blocks: under a signature, all go with the smallest node.
    leaders = signed.groupBy("sig").agg(F.min("node").alias("leader"), F.count("*").alias("c")).filter("c > 1").drop("c")
    blocks = cut(signed.join(leaders, "sig").select("leader", "node", "n").distinct(), "jaccard-blocks")
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK_NODES), F.ceil(F.sum("n") / CHUNK_TOKENS)).cast("int")
    large = cut(blocks.groupBy(F.col("leader").alias("of")).agg(chunks.alias("chunks")).filter("chunks > 1"), "jaccard-large")
    # Rows of a large block are dealt by salt as well, so that they do not meet in one task before they are cut.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    cuts = small(large.withColumn("salt", salts), 32 * SALTS)
    salted = (F.col("leader") == F.col("of")) & (F.pmod(F.hash("node"), F.lit(SALTS)) == F.col("salt"))
    blocks = blocks.join(cuts, salted, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine, other = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"), F.col("other")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("mine"))
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(others)
    blocks = blocks.withColumn("mine", mine).withColumn("other", F.explode(others))
    blocks = blocks.select("leader", F.least("mine", other).alias("lo"), F.greatest("mine", other).alias("hi"), "node")

    # Sketches thin the candidates, sets decide; both come from the candidates' texts.
    def of(wanted: DataFrame, sketch: bool) -> DataFrame:
        keys = nodes.join(wanted.select("node").distinct(), "node", "left_semi")
        keys = small(cut(keys.select("node", "rep", F.col("k1").alias("q1"), F.col("k2").alias("q2")), "jaccard-wanted"), 64)
        # By id and text: rows without an id, or of one id, meet only those of their own text.
        own = F.col("doc_id").eqNullSafe(F.col("rep.id")) & (F.col("h") == F.col("rep.h"))
        sets = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(keys, own)
        sets = sets.select("node", "q1", "q2", shingle_set(F.col("text"), k).alias("set"))
        sets = sets.select("node", "q1", "q2", "set", F.xxhash64("set").alias("k1"), F.hash("set").alias("k2"))
        sets = cut(sets.mapInArrow(_packed(sketch), "node long, n int, data binary"), "jaccard-sketches" if sketch else "jaccard-sets")
        return wanted.join(sets, "node").repartition(*unit).sortWithinPartitions(*unit).select(*unit, "node", "n", "data")

    unit = ["leader", "lo", "hi"]
    thin = cut(of(blocks, True).mapInArrow(_thinned(num, den), "leader long, lo int, hi int, node long"), "jaccard-thinned")
    edges = of(thin, False).mapInArrow(_linked(num, den), "a long, b long")
    roots = components(edges)
    best = roots.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("best"))
    linked = nodes.join(roots.join(best, "root").select(F.col("node").alias("of"), "best"), F.col("node") == F.col("of"), "left")
    return rows.drop("prefix", "rid"), linked.select("k1", "k2", "n", F.coalesce("best", "rep").alias("best"))


def join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    Two documents link when den * shared >= num * union over their distinct
    shingles of k words. component_id is the smallest doc_id reachable by links,
    the document's own included; ids that are null count as none, and a
    component with null ids only has a null one. Documents without words link
    with nothing. Repeated rows are documents of their own; an empty table gives
    no rows. All links between different sets take part; equal sets need none.
    """
    rows, sets = _classes(docs, k, num, den)
    named = sets.select("k1", "k2", "n", F.col("best.id").alias("component_id"))
    found = rows.filter("n > 0").join(named, ["k1", "k2", "n"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    none = rows.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(none)


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, whole rows of any columns, without all but one row of each component.

    The row that stays has the smallest doc_id (nulls last; of one id, the one
    whose text has the smallest hash); of rows equal in doc_id and text the one
    that is met first. Rows are told apart by doc_id and text, so other texts
    under an id, or without one, stay unless they have a near copy themselves.
    Documents without words stay, each of them. Columns may have any names.
    """
    found, sets = _classes(docs, k, num, den)
    mine = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))
    judged = found.filter("n > 0").join(sets, ["k1", "k2", "n"]).groupBy("doc_id", "h").agg(F.min(mine).alias("stays"), F.count("*").alias("copies"))
    # Rows to look at again: those that go, and rows that repeat one that stays.
    judged = cut(judged.filter("not stays or copies > 1").select(F.col("doc_id").alias("id"), F.col("h").alias("at"), "stays"), "jaccard-judged")
    own = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("at"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("h"))
    left = rows.join(small(judged, 32), own, "left_anti")
    again = rows.join(small(judged.filter("stays"), 32), own, "left_semi").groupBy("doc_id", "h").agg(F.first("row").alias("row"))
    return left.select("row.*").unionByName(again.select("row.*"))
