"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item of m characters that occurs in a text with at most k edits
shares at least m - q + 1 - k q of its q-grams with that place, on diagonals at
most k apart. Shared q-grams are counted in overlapping diagonal bands of width
2 (k + 1); bands that reach the bound are verified by banded alignment. Items
with fewer than q characters have no q-gram and no edit to spare: they are sought
as they are, as whole words.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.common import bounded_batches

Q = 9
#: Edits allowed a character of an item.
EDITS = 0.08
#: Characters of items that are indexed at once; a larger benchmark is sought in blocks.
BLOCK_CHARS = 4_000_000
#: Characters of text that are looked through at once.
WINDOW = 1 << 20
#: Pairs of a text's and an item's equal q-grams that are counted at once.
PAIRS = 1 << 22


def budget(m: int, q: int = Q, edits: float = EDITS) -> int:
    """Most edits for an item of m characters: its share, as far as the lemma still bounds q-grams."""
    return max(0, min(int(edits * m), (m - q) // q))


def banded_distance(item, text, lead: int, k: int) -> int:
    """Least edits between item and a substring of text that starts at 0..lead; k + 1 if more than k.

    Row by row, along diagonals 0 - k .. lead + k only.
    """
    import numpy as np

    width = lead + 2 * k + 1
    far = k + 1
    padded = np.full(len(item) + width + k + 1, -1, np.int64)
    padded[k : k + len(text)] = text[: len(padded) - k]
    # Cell c of row i is text position i + c - k.
    place = np.arange(width)
    row = np.where(place >= k, 0, far).astype(np.int64)
    for i, x in enumerate(item):
        here = padded[i : i + width]
        best = row + (here != x)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best[here < 0] = np.minimum(best, far)[here < 0]
        row = np.minimum(np.minimum.accumulate(best - place) + place, far)
        if row.min() > k:
            return far
    ends = len(item) + place - k
    return int(min(row[ends <= len(text)], default=far))


class Index:
    """q-grams of a block of items (id, folded text), each of q characters or more."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edits: float = EDITS):
        import numpy as np

        from ledgerlink.llm.chars import mixed, points, qgrams

        self.q, self.items = q, items
        self.codes = [points(t).astype(np.int64) for _, t in items]
        self.k = np.array([budget(len(c), q, edits) for c in self.codes], np.int64)
        self.need = np.array([len(c) - q + 1 for c in self.codes], np.int64) - q * self.k
        grams = [qgrams(points(t), q) for _, t in items]
        h, owner = np.concatenate(grams), np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(h, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first = np.unique(h[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(h)))
        self.bits = max(16, int(len(h)).bit_length() + 6)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[mixed(self.grams, self.bits)] = True
        self.span = max(len(c) + 3 * int(k) + 3 for c, k in zip(self.codes, self.k))

    def candidates(self, a):
        """(item, band) pairs of a whose shared q-grams reach the bound."""
        import numpy as np

        from ledgerlink.llm.chars import mixed, qgrams

        h = qgrams(a, self.q)
        at = np.flatnonzero(self.seen[mixed(h, self.bits)])
        i = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        true = self.grams[i] == h[at]
        at, i = at[true], i[true]
        keys, counts = [], []
        # A q-gram that an item repeats meets each of its places; they are counted in pieces of bounded size.
        ends = np.cumsum(self.count[i])
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            times = self.count[i[lo:hi]]
            here = np.repeat(at[lo:hi], times)
            where = np.repeat(self.first[i[lo:hi]], times) + np.arange(len(here)) - np.repeat(np.cumsum(times) - times, times)
            item, step = self.owner[where], self.k[self.owner[where]] + 1
            # Diagonals are kept above 0 by the longest item.
            band = (here - self.place[where] + self.span) // step
            key, count = np.unique(item.astype(np.int64) << 40 | band, return_counts=True)
            keys.append(key)
            counts.append(count)
            lo = hi
        if not keys:
            return (np.zeros(0, np.int64),) * 3
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        both = np.concatenate([key, key - 1])
        own, back = np.unique(both, return_inverse=True)
        total = np.bincount(back, np.concatenate([count, count])).astype(np.int64)
        item = own >> 40
        ok = total >= self.need[item]
        return item[ok], own[ok] & ((1 << 40) - 1), total[ok]

    def matches(self, texts: list[str]):
        """(text number, item number, edits, start, shared q-grams): the best place of each item in each text."""
        import numpy as np

        from ledgerlink.llm.chars import points

        folds = [len(t) for t in texts]
        starts = np.cumsum([0, *(n + 1 for n in folds)])
        whole = points("\n".join(texts))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        known: dict[tuple[int, bytes], int] = {}
        for lo in range(0, max(len(whole), 1), WINDOW):
            a = whole[lo : lo + WINDOW + self.span]
            for item, band, shared in zip(*self.candidates(a)):
                item, k = int(item), int(self.k[item])
                code, step = self.codes[item], k + 1
                first = int(band) * step - self.span + lo
                # The band may begin in the text before; the text is that of its middle q-gram.
                middle = min(max(first + step + len(code) // 2, 0), len(whole) - 1)
                t = int(np.searchsorted(starts, middle, "right")) - 1
                for n in {t, max(t - 1, 0), min(t + 1, len(texts) - 1)}:
                    begin = max(first - k, int(starts[n]))
                    stop = min(first + 2 * step + len(code) + k, int(starts[n]) + folds[n])
                    if stop - begin < len(code) - k or best.get((n, item), (k + 1,))[0] == 0:
                        continue
                    part = whole[begin:stop].astype(np.int64)
                    key = (item, part.tobytes())
                    if key not in known:
                        known[key] = 0 if code.tobytes() in key[1] else banded_distance(code, part, max(0, len(part) - len(code) + k), k)
                    if known[key] <= k and known[key] < best.get((n, item), (k + 1,))[0]:
                        best[n, item] = (known[key], begin - int(starts[n]), int(shared))
        return [(n, item, *found) for (n, item), found in sorted(best.items())]


class Words:
    """Short items (id, folded text) as runs of words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.runs: dict[tuple[str, ...], list[int]] = {}
        for number, (_, text) in enumerate(items):
            self.runs.setdefault(tuple(text.split()), []).append(number)
        self.sizes = sorted({len(r) for r in self.runs})

    def matches(self, texts: list[str]):
        """(text number, item number, edits, start, shared q-grams): the first place of each item in each text."""
        for n, text in enumerate(texts):
            w = text.split(" ")
            starts = [0]
            for x in w:
                starts.append(starts[-1] + len(x) + 1)
            seen = set()
            for size in self.sizes:
                for i in range(len(w) - size + 1):
                    if (run := tuple(w[i : i + size])) in self.runs and run not in seen:
                        seen.add(run)
                        yield from ((n, item, 0, starts[i], 0) for item in self.runs[run])


def _search(items, q, edits):
    """items are sorted: those shorter than q first."""
    few = sum(len(t) < q for _, t in items)

    def run(batches):
        import pyarrow as pa

        from ledgerlink.llm.chars import folded

        words = Words(items[:few]) if few else None
        index = Index(items[few:], q, edits) if few < len(items) else None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [folded(t) for t in batch.column(1).to_pylist()]
            found = list(words.matches(texts)) if words else []
            if index:
                found += [(n, few + item, *more) for n, item, *more in index.matches(texts)]
            if found:
                n, item, cost, start, shared = zip(*sorted(found))
                budgets = [budget(len(items[i][1]), q, edits) for i in item]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in n], pa.int64()), pa.array([items[i][0] for i in item], pa.int64()), pa.array(cost, pa.int32()), pa.array(budgets, pa.int32()), pa.array(start, pa.int64()), pa.array(shared, pa.int32())],
                    ["doc_id", "item_id", "edits", "edit_budget", "start", "shared_qgrams"],
                )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, edits, edit_budget, start, shared_qgrams: items found in docs, one row a document and item.

    docs: doc_id, text; benchmark: item_id, text. Both texts are folded to lower
    case and single spaces; start counts characters of the folded text, of a
    stretch that holds the item. Items of fewer than q characters are found where
    they stand as whole words, without edits. Null and empty texts hold nothing,
    null and empty items are nowhere, and no items give no rows. Repeated
    documents and items each have their rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark, "4m")
    from ledgerlink.llm.chars import folded

    sought = benchmark.filter(F.length("text") > 0).select(F.col("item_id").cast("long"), "text")
    blocks = max(1, -(-(sought.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    schema = "doc_id long, item_id long, edits int, edit_budget int, start long, shared_qgrams int"
    found = []
    for b in range(blocks):
        block = sought.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        items = [(r["item_id"], f) for r in block.collect() if (f := folded(r["text"]))]
        if items:
            items.sort(key=lambda x: (len(x[1]) >= q, x[0] is None, x[0] or 0, x[1]))
            found.append(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_search(items, q, edits), schema))
    return functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item; documents without an id are looked at too.

    Whole rows stay or go, whatever further columns they have and however these
    are named; rows of one doc_id and text share a fate.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("key"), "text")
    found = leaks(rows.select(F.col("key").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("key")).distinct()
    return rows.join(found, "key", "left_anti").select("row.*")
