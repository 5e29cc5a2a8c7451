"""Token IDs in training order.

Texts become token ids and, end to end within a stream, sequences of fixed
length. Streams, and the order in them, come from hashes of the documents, so
that the training order does not depend on how the input is partitioned. A keyed
Feistel permutation with cycle-walking gives every sequence its global slot;
slots fall into shards by range, one shard a task, and each shard is one file of
fixed-stride records in slot order, so a reader seeks to any slot and goes on.
"""

from __future__ import annotations

import posixpath
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.common import bounded_batches, cut, grouped, release, sides, workspace
from ledgerlink.llm.warc import _files

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE vocabularies of this family split text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Tokens of a sequence; the id that ends a document and fills the last sequence of a stream.
LENGTH, END = 1024, 50256
#: Sequences of a shard file.
SHARD_SLOTS = 16384
#: Bytes of text to a stream: what one task lays end to end.
STREAM_BYTES = 32 << 20
#: Sequences compressed together; packs dealt at once; tokens a task holds before it passes them on.
PACK, DEALT_PACKS, HELD_TOKENS = 512, 16, 4 << 20
_M = (1 << 64) - 1


def permuted(x, n: int, key: int, rounds: int = 6):
    """The images of x, an array, in a keyed permutation of 0..n-1.

    A Feistel network on the smallest near-square grid of n cells or more; an
    image outside 0..n-1 is put through it again until it is inside.
    """
    import numpy as np

    a, b = sides(n)

    def mix(v, r):
        h = v.astype(np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & _M)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(31))

    def network(v):
        left, right = v % a, v // a
        for r in range(rounds):
            if r % 2:
                right = (right + (mix(left, r) % np.uint64(b)).astype(np.int64)) % b
            else:
                left = (left + (mix(right, r) % np.uint64(a)).astype(np.int64)) % a
        return right * a + left

    out = network(np.asarray(x, np.int64))
    while len(far := np.flatnonzero(out >= n)):
        out[far] = network(out[far])
    return out


def encoder(vocabulary: bytes, pattern: str):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _tokenised(vocabulary: bytes, pattern: str, end: int):
    """(stream, h, doc_id, text) to a row a stream and run of batches: docs (h, doc, known, tokens) and their tokens."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        bpe, pack = encoder(vocabulary, pattern), zstandard.ZstdCompressor(3)
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def emptied():
            for stream, (docs, flow) in sorted(held.items()):
                row = [pa.array([stream], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([pack.compress(np.array(docs, np.int64).tobytes())], pa.binary()), pa.array([pack.compress(np.concatenate(flow).astype("<u2").tobytes())], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["stream", "n", "docs", "tokens"])
            held.clear()

        for batch in batches:
            for stream, h, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids = bpe.encode_ordinary(text) if text else []
                if ids:
                    docs, flow = held.setdefault(stream, ([], []))
                    docs.append((h, doc or 0, doc is not None, len(ids) + 1))
                    flow.append(np.array([*ids, end], np.uint16))
                    size += len(ids) + 1
            if size >= HELD_TOKENS:
                yield from emptied()
                size = 0
        yield from emptied()

    return run


def _laid(length: int, end: int):
    """A stream's rows to packs (part, first, n, tokens, docs) of up to PACK sequences; documents lie in the order of (h, doc)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(6), zstandard.ZstdDecompressor()
        for t, bounds in grouped(batches, ["stream"]):
            for s, e in zip(bounds[:-1], bounds[1:]):
                docs = np.concatenate([np.frombuffer(unpack.decompress(x.as_py()), np.int64).reshape(-1, 4) for x in t.column("docs").slice(s, e - s)])
                flow = np.concatenate([np.frombuffer(unpack.decompress(x.as_py()), "<u2") for x in t.column("tokens").slice(s, e - s)])
                at = np.cumsum(docs[:, 3]) - docs[:, 3]
                order = np.lexsort((docs[:, 3], docs[:, 2], docs[:, 1], docs[:, 0]))
                docs, at = docs[order], at[order]
                flow = np.concatenate([flow[i : i + m] for i, m in zip(at.tolist(), docs[:, 3].tolist())])
                n = -(-len(flow) // length)
                flow = np.append(flow, np.full(n * length - len(flow), end, np.uint16))
                stop = np.cumsum(docs[:, 3])
                for first in range(0, n, PACK):
                    some = min(PACK, n - first)
                    lo, hi = first * length, (first + some) * length
                    mine = np.arange(np.searchsorted(stop, lo, "right"), np.searchsorted(stop - docs[:, 3], hi, "left"))
                    begin, until = np.maximum(stop[mine] - docs[mine, 3], lo), np.minimum(stop[mine], hi)
                    # docs: (doc, known, place in the pack, tokens).
                    table = np.stack([docs[mine, 1], docs[mine, 2], begin - lo, until - begin], 1)
                    row = [pa.array([t.column("stream")[s].as_py()], pa.int32()), pa.array([first], pa.int64()), pa.array([some], pa.int64()), pa.array([pack.compress(flow[lo:hi].tobytes())], pa.binary()), pa.array([pack.compress(table.tobytes())], pa.binary())]
                    yield pa.RecordBatch.from_arrays(row, ["part", "first", "n", "tokens", "docs"])

    return run


def _dealt(offsets, total: int, key: int, length: int, shard_slots: int):
    """Packs to (shard, slots, tokens, docs) of the sequences of each shard."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(6), zstandard.ZstdDecompressor()

        def dealt(held):
            slots, body = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            piece = np.concatenate([x[2] for x in held])
            shard, of = slots // shard_slots, piece[:, 0] // shard_slots
            for s in np.unique(shard):
                own = np.flatnonzero(shard == s)
                row = [pa.array([s], pa.int32()), pa.array([slots[own].tobytes()], pa.binary()), pa.array([pack.compress(body[own].tobytes())], pa.binary()), pa.array([pack.compress(piece[of == s].tobytes())], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["shard", "slots", "tokens", "docs"])

        held = []
        for batch in batches:
            for r in batch.to_pylist():
                n = r["n"]
                slots = permuted(int(offsets[r["part"]]) + r["first"] + np.arange(n), total, key)
                body = np.frombuffer(unpack.decompress(r["tokens"]), "<u2").reshape(n, length)
                table = np.frombuffer(unpack.decompress(r["docs"]), np.int64).reshape(-1, 4)
                # A document's stretch in each sequence it reaches.
                lo, hi = table[:, 2] // length, (table[:, 2] + table[:, 3] - 1) // length
                count = hi - lo + 1
                at = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                begin = np.maximum(np.repeat(table[:, 2], count), at * length)
                stop = np.minimum(np.repeat(table[:, 2] + table[:, 3], count), (at + 1) * length)
                held.append((slots, body, np.stack([slots[at], np.repeat(table[:, 0], count), np.repeat(table[:, 1], count), stop - begin], 1)))
                if len(held) >= DEALT_PACKS:
                    yield from dealt(held)
                    held = []
        if held:
            yield from dealt(held)

    return run


def _materialised(folder: str, length: int, shard_slots: int):
    """Rows of a shard to its file and a row for each of its records."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        import zstandard

        fs, home = _files(folder)
        stride = 2 * length
        for t, bounds in grouped(batches, ["shard"]):
            unpack = zstandard.ZstdDecompressor()
            for s, e in zip(bounds[:-1], bounds[1:]):
                shard = t.column("shard")[s].as_py()
                slots, body, pieces = [], [], []
                for i in range(s, e):
                    slots.append(np.frombuffer(t.column("slots")[i].as_py(), np.int64))
                    body.append(np.frombuffer(unpack.decompress(t.column("tokens")[i].as_py()), "<u2").reshape(-1, length))
                    pieces.append(np.frombuffer(unpack.decompress(t.column("docs")[i].as_py()), np.int64).reshape(-1, 4))
                slots, body, pieces = np.concatenate(slots), np.concatenate(body), np.concatenate(pieces)
                order = np.argsort(slots)
                slots, body = slots[order], body[order]
                if (np.diff(slots) != 1).any() or slots[0] != shard * shard_slots:
                    raise ValueError(f"shard {shard} has not all its slots")
                # A whole file appears at once; a lost attempt leaves only its own temporary name.
                name = f"shard-{shard:08d}.bin"
                draft = posixpath.join(home, f".{name}.{uuid.uuid4().hex}")
                with fs.open_output_stream(draft, compression=None) as f:
                    f.write(body.tobytes())
                fs.move(draft, posixpath.join(home, name))
                pieces = pieces[np.argsort(pieces[:, 0], kind="stable")]
                cuts = np.searchsorted(pieces[:, 0], np.append(slots, slots[-1] + 1))
                ids = [[d if known else None for _, d, known, _ in pieces[a:b].tolist()] for a, b in zip(cuts[:-1], cuts[1:])]
                used = np.add.reduceat(np.append(pieces[:, 3], 0), cuts[:-1])
                n = len(slots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots), pa.array(np.full(n, shard, np.int64)), pa.array([name] * n), pa.array((slots - slots[0]) * stride), pa.array(np.full(n, stride), pa.int64()), pa.array(used, pa.int64()), pa.array([zlib.crc32(b.tobytes()) for b in body], pa.int64()), pa.array(ids, pa.list_(pa.int64()))],
                    ["slot", "shard", "file", "offset", "stride", "n_tokens", "crc32", "doc_ids"],
                )

    return run


SCHEMA = "slot long, shard long, file string, offset long, stride long, n_tokens long, crc32 long, doc_ids array<long>"


def materialise(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN, length: int = LENGTH, end: int = END, key: int = 2024, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Shard files under folder and their index: one row a sequence, slots gapless from 0.

    Every token of every text of docs (doc_id, text) is in one record, followed
    by end after each document; ids are two little-endian bytes. n_tokens leaves
    out filling. doc_ids are the documents in a record, in order. Null and empty
    texts have no tokens; a null doc_id is null in doc_ids; repeated rows are
    written each. No tokens give no shards. The order depends on doc_id, text
    and key alone, not on partitions or further columns. vocabulary: a tiktoken
    file that the driver reads.
    """
    spark = docs.sparkSession
    bounded_batches(spark, "4m")
    folder = folder or workspace(spark, "token-shards")
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    streams = max(1, -(-size // STREAM_BYTES))
    h = F.xxhash64("doc_id", "text")
    rows = docs.filter(F.octet_length("text") > 0).select(F.pmod(h, F.lit(streams)).cast("int").alias("stream"), h.alias("h"), F.col("doc_id").cast("long"), "text")
    parts = rows.mapInArrow(_tokenised(ranks, pattern, end), "stream int, n long, docs binary, tokens binary")
    packs = parts.repartitionById(streams, F.col("stream")).sortWithinPartitions("stream").mapInArrow(_laid(length, end), "part int, first long, n long, tokens binary, docs binary")
    packs = cut(packs, "token-packs")
    del parts
    release(spark)
    # One number a stream: where its sequences begin.
    counts = np.zeros(streams + 1, np.int64)
    for r in packs.groupBy("part").agg(F.sum("n").alias("n")).collect():
        counts[r["part"] + 1] = r["n"]
    offsets, total = np.cumsum(counts)[:-1], int(counts.sum())
    if not total:
        return spark.createDataFrame([], SCHEMA)
    fs, home = _files(folder)
    fs.create_dir(home, recursive=True)
    dealt = packs.mapInArrow(_dealt(offsets, total, key, length, shard_slots), "shard int, slots binary, tokens binary, docs binary")
    shards = -(-total // shard_slots)
    rows = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(_materialised(folder, length, shard_slots), SCHEMA)
    return cut(rows, "token-index")


def read_sequences(folder: str, first: int, count: int, length: int = LENGTH, shard_slots: int = SHARD_SLOTS):
    """Arrays of token ids of slots first, first + 1, ...: what a training job reads, from any slot on."""
    import numpy as np

    fs, home = _files(folder)
    slot = first
    while slot < first + count:
        shard, at = divmod(slot, shard_slots)
        name = posixpath.join(home, f"shard-{shard:08d}.bin")
        if not fs.get_file_info(name).is_file:
            return
        with fs.open_input_file(name) as f:
            n = min(first + count - slot, shard_slots - at, f.size() // (2 * length) - at)
            if n <= 0:
                return
            yield from np.frombuffer(f.read_at(2 * length * n, 2 * length * at), "<u2").reshape(n, length)
        slot += n
