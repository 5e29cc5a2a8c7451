"""Repeated bytes against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from ledgerlink.llm import suffixes


def brute(rows, length=50):
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        for j in range(len(b) - length + 1):
            first.setdefault(b[j : j + length], i)
    want = collections.Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            f = first[b[j : j + length]]
            if f != i and (i is None or f < i):
                gone[j : j + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone) if not g)
        want[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()] += 1
    return want


def corpus(seed):
    """Copies, near copies, one passage in most texts, short periods, long texts, nulls and repeated ids."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    hot, base, rows = text(rng.randint(12, 30)), text(120).split(), []
    for i in range(90):
        w = list(base) if i % 3 == 0 else text(rng.randint(1, 60)).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        if i % 3 == 1:
            w.insert(rng.randrange(len(w) + 1), hot)
        rows.append((i, " ".join(w)))
    rows += [(i + 200, t) for i, t in rows[::5]] + [(7, rows[7][1]), (3, "another text under the same id " + hot), (None, hot), (None, hot), (None, "of no id " * 9), (None, "of no id " * 9), (None, hot + " more"), (None, None), (400, "")]
    rows += [(500 + i, rng.choice(("ab", "a", "abc", "é", "xyzw")) * rng.randint(10, 90)) for i in range(20)]
    rows += [(600 + i, "x" * n) for i, n in enumerate((48, 49, 50, 51, 52, 99, 100, 101))] + [(700, text(9000) + hot), (701, text(50) + " " + "q" * 20000), (702, "q" * 9000)]
    return rows


def test_covers():
    for v, cover in suffixes.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and len(cover) * (len(cover) - 1) == v - 1


@pytest.mark.parametrize("seed,length", [(1, 50), (2, 50), (3, 20)])
def test_repeated_bytes(spark, seed, length, monkeypatch):
    rows = corpus(seed)
    if seed == 2:  # several buckets, parts, pieces of one text, and rows held at once
        for name, n in (("BUCKET_BYTES", 1 << 14), ("PART_BYTES", 1 << 13), ("PIECE", 3000), ("HELD", 500)):
            monkeypatch.setattr(suffixes, name, n)
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, bucket string, h int").repartition(3)
    assert collections.Counter(tuple(r) for r in suffixes.deduplicate(docs, length).collect()) == brute(rows, length)


def test_no_rows(spark):
    assert suffixes.deduplicate(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_one_very_common_passage(spark):
    """Whatever stands around it, the common passage is found in all documents but the first."""
    rng = random.Random(9)
    hot = "this very common passage of more than fifty bytes stands in every document of the table"
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = [(i, letters(60) + hot + letters(60)) for i in range(500)]
    assert collections.Counter(tuple(r) for r in suffixes.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)


def test_sampled_windows_agree():
    """Windows that are equal have equal marks around their minimizers."""
    rng = np.random.default_rng(3)
    a = rng.integers(97, 100, 4000).astype(np.uint8)
    a[2500:3200] = a[300:1000]
    text, lo, hi, value = suffixes.marks(a, np.array([0]), np.array([len(a)]), 50)
    of = np.full(len(a), -1)
    for s, e, v in zip(lo, hi, value):
        of[s:e] = v
    assert (of[300:950] == of[2500:3150]).all() and (of[: len(a) - 49] >= 0).all()
