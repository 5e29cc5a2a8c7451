"""Suffix-array deduplication of byte passages across documents.

A distributed difference-cover sort of suffixes, to a depth of LENGTH bytes.
Of the places of a text those are sampled whose offset modulo a period is in the
difference cover: any two places then have a common shift below the period at
which both are sampled. Sampled suffixes are dealt by the prefix that every
window over them shares with its equals, and sorted; the ranks of their prefixes,
of every depth up to LENGTH, are the names. A suffix that starts x bytes before
a sampled one is merged by its x bytes, themselves ranked, and the sampled one's
name; neighbours in that order that agree in LENGTH bytes are equal windows, of
which all but those of the smallest doc_id are removed. As names reach LENGTH
bytes at once, nothing is left to recurse on.

Texts that equal one of a smaller doc_id are settled by their digest. Suffixes
that are unique are discarded first: prefixes of 35 bytes around the
windows' minimizers are compared, by hash; these spare work and decide nothing.
Texts lie in files, one a bucket of documents, that tasks read again, so that
they are shuffled once. No table is broadcast or gathered on the driver.
"""

from __future__ import annotations

import posixpath
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.chars import qgrams, slices
from ledgerlink.llm.common import bounded_batches, cut, grouped, release, workspace
from ledgerlink.llm.warc import _files

LENGTH = 50
#: Perfect difference sets by their modulus.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}
#: Bytes of text of a bucket of documents, of a part of the sampled suffixes, and that are looked at together.
BUCKET_BYTES, PART_BYTES, PIECE = 32 << 20, 8 << 20, 4_000_000
#: Sampled suffixes that a task holds before it passes them on; equal ones among them leave once.
HELD = 1 << 18
_HASH_BITS, _PLACE = 40, np.uint64((1 << 23) - 1)
_ORDER = np.uint64(0xD6E8FEB86659FD93)
_LAST = (1 << 63) - 1


def period_of(length: int) -> int:
    """The largest modulus in COVERS that leaves three eighths of length to a sampled prefix."""
    return max(v for v in COVERS if 8 * v <= 5 * length)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ORDER
    return h ^ (h >> np.uint64(32))


# Rows of integers and bytes, packed.


def _planes(table: np.ndarray) -> bytes:
    """Columns of int64 as differences, by bytes: what is small compresses away."""
    step = np.ascontiguousarray(np.diff(table, axis=1, prepend=0))
    return np.ascontiguousarray(step.view(np.uint8).reshape(*step.shape, 8).transpose(0, 2, 1)).tobytes()


def _unplaned(data: bytes, columns: int, n: int) -> np.ndarray:
    step = np.frombuffer(data, np.uint8, columns * n * 8).reshape(columns, 8, n).transpose(0, 2, 1)
    return np.cumsum(np.ascontiguousarray(step).view(np.int64).reshape(columns, n), axis=1)


def _row(names: list[str], *values):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in values], names)


# Texts.


def _bucketed(batches):
    """(bucket, doc_id, doc, h, text) to (bucket, n, data) rows: n documents' (doc, known, h, size, rows) and bytes.

    Rows that repeat id and text leave once, with their number.
    """
    import zstandard

    pack = zstandard.ZstdCompressor(3)
    held: dict[int, dict] = {}
    size = 0

    def emptied():
        for bucket, rows in sorted(held.items()):
            table = np.array([(doc, known, h, len(data), n) for (doc, known, data), (h, n) in rows.items()], np.int64).T
            yield _row(["bucket", "n", "data"], bucket, len(rows), pack.compress(_planes(table) + b"".join(data for _, _, data in rows)))
        held.clear()

    for batch in batches:
        for bucket, doc_id, doc, h, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            key, rows = (doc, doc_id is not None, text.encode()), held.setdefault(bucket, {})
            rows[key] = (h, rows.get(key, (h, 0))[1] + 1)
            size += len(key[2])
        if size >= 4 * PIECE:
            yield from emptied()
            size = 0
    yield from emptied()


def _listed(batches):
    """(bucket, doc, h) to rows (bucket, -n, data): documents that are the first of their text."""
    import zstandard

    pack = zstandard.ZstdCompressor(3)
    for batch in batches:
        bucket, doc, h = (batch.column(i).to_numpy() for i in range(3))
        order = np.lexsort((h, doc, bucket))
        edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0)) if len(order) else order
        for lo, hi in zip(edges, np.append(edges[1:], len(order))):
            own = order[lo:hi]
            yield _row(["bucket", "n", "data"], int(bucket[own[0]]), -len(own), pack.compress(_planes(np.stack([doc[own], h[own]]))))


def _texts(data: bytes, n: int):
    return _unplaned(data, 5, n), np.frombuffer(data, np.uint8, offset=40 * n)


def _name(home: str, bucket: int) -> str:
    return posixpath.join(home, f"bucket-{bucket:08d}.bin")


def _frames(fs, home: str, bucket: int, copies: bool = False):
    """(table, body) of some documents of a bucket after the other, or of its copies; none where it has no file."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    if not fs.get_file_info(_name(home, bucket)).is_file:
        return
    with fs.open_input_file(_name(home, bucket)) as f:
        while head := f.read(16):
            size, n = np.frombuffer(head, np.int64).tolist()
            if (n < 0) == copies:
                yield _texts(unpack.decompress(f.read(size)), abs(n))
            else:
                f.seek(size, 1)


def _pieces(table, body, length: int):
    """(row, base, starts, sizes, a): stretches of texts, of PIECE windows at most, in arrays of about PIECE bytes."""
    at = np.cumsum(table[3]) - table[3]
    row, base, size, total = [], [], [], 0
    for i, n in enumerate(table[3].tolist()):
        for offset in range(0, max(n - length + 1, 0), PIECE):
            own = min(PIECE + length - 1, n - offset)
            row.append(i)
            base.append(offset)
            size.append(own)
            total += own
            if total >= PIECE:
                yield _piece(at, body, row, base, size)
                row, base, size, total = [], [], [], 0
    if row:
        yield _piece(at, body, row, base, size)


def _piece(at, body, row, base, size):
    row, base, size = np.array(row), np.array(base, np.int64), np.array(size, np.int64)
    begin = at[row] + base
    whole = (begin[1:] == begin[:-1] + size[:-1]).all()
    return row, base, np.cumsum(size) - size, size, body[begin[0] : begin[-1] + size[-1]] if whole else slices(body, begin, size)


# Minimizers, to discard unique suffixes.


def stretches(a: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int = LENGTH):
    """(text, first, stop, place) of each run of windows of one text whose minimizer is the gram at place.

    The minimizer is the leftmost of least hash of a window's grams of two
    fifths of its length.
    """
    k = 2 * length // 5
    w, n = length - k + 1, len(a) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    low = _mix(qgrams(a, k))
    low = (low & ~_PLACE) | np.arange(len(low), dtype=np.uint64)
    width = 1
    while width * 2 <= w:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = (np.minimum(low[:n], low[w - width : w - width + n]) & _PLACE).astype(np.int64)
    first = np.union1d(np.flatnonzero(low[1:] != low[:-1]) + 1, starts[sizes >= length])
    text = np.searchsorted(starts, first, "right") - 1
    stop = np.minimum(np.append(first[1:], n), starts[text] + sizes[text] - length + 1)
    ok = stop > first
    first, text, stop = first[ok], text[ok], stop[ok]
    return text, first, stop, low[first]


def marks(a, starts, sizes, length: int):
    """(text, lo, hi, value): windows lo..hi-1 hold a prefix, the one with that hash, around their minimizer.

    Windows that reach far enough to the left of their minimizer hold what leads
    to it, the others what follows it.
    """
    k = 2 * length // 5
    half = (length - k + 1) // 2
    text, first, stop, place = stretches(a, starts, sizes, length)
    gram = _mix(qgrams(a, k + half))
    turn = np.clip(place - half + 1, first, stop)
    left, right = turn > first, turn < stop
    value = np.concatenate([gram[place[left] - half], _mix(gram[place[right]])])
    value = (value >> np.uint64(64 - _HASH_BITS)).astype(np.int64)
    return np.concatenate([text[left], text[right]]), np.concatenate([first[left], turn[right]]), np.concatenate([turn[left], stop[right]]), value


def _part(value: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of hashes, in order: value's share of them all."""
    return (value >> 8) * parts >> _HASH_BITS - 8


def _filed(folder: str, parts: int, length: int):
    """Rows of a bucket to its file, in order of (doc, h), and its marks by part: sorted values, each once."""

    def run(batches):
        import zstandard

        fs, home = _files(folder)
        pack, unpack = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()
        for t, bounds in grouped(batches, ["bucket"]):
            for s, e in zip(bounds[:-1], bounds[1:]):
                bucket, values = int(t.column("bucket")[s].as_py()), []
                rows = [(t.column("n")[i].as_py(), unpack.decompress(t.column("data")[i].as_py())) for i in range(s, e)]
                own = {key for n, data in rows if n < 0 for key in zip(*_unplaned(data, 2, -n).tolist())}
                tables, bodies = zip(*(_texts(data, n) for n, data in rows if n > 0))
                table, body = np.concatenate(tables, 1), np.concatenate(bodies)
                del rows, bodies
                at = np.cumsum(table[3]) - table[3]
                order = np.lexsort((table[3], table[1], table[2], table[0]))
                table, at = table[:, order], at[order]
                # Of rows that repeat id and text one is left, with the number of all.
                new = np.flatnonzero(np.append(True, (np.diff(table[:4]) != 0).any(0)))
                rows, table, at = np.add.reduceat(table[4], new), table[:, new], at[new]
                table[4] = rows
                first = np.array([key in own for key in zip(table[0].tolist(), table[2].tolist())])
                copies, table, at = table[:, ~first], table[:, first], at[first]
                # A whole file appears at once; a lost attempt leaves only its own temporary name.
                draft = f"{_name(home, bucket)}.{uuid.uuid4().hex}"
                frame = np.cumsum(table[3]) // PIECE
                edges = np.flatnonzero(np.append(True, frame[1:] != frame[:-1])) if len(frame) else frame
                with fs.open_output_stream(draft, compression=None) as f:
                    for lo, hi in zip(edges, np.append(edges[1:], len(frame))):
                        some, text = table[:, lo:hi], slices(body, at[lo:hi], table[3, lo:hi])
                        data = pack.compress(_planes(some) + text.tobytes())
                        f.write(np.array([len(data), hi - lo], np.int64).tobytes() + data)
                        for _, _, starts, sizes, a in _pieces(some, text, length):
                            values.append(np.unique(marks(a, starts, sizes, length)[3]))
                    if copies.shape[1]:
                        data = pack.compress(_planes(copies))
                        f.write(np.array([len(data), -copies.shape[1]], np.int64).tobytes() + data)
                fs.move(draft, _name(home, bucket))
                v = np.unique(np.concatenate([np.zeros(0, np.int64), *values]))
                edges = np.searchsorted(_part(v, parts), np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(edges)):
                    own = v[None, edges[p] : edges[p + 1]]
                    yield _row(["part", "bucket", "n", "data"], int(p), bucket, own.shape[1], pack.compress(_planes(own)))

    return run


def _answered(batches):
    """Rows of a part to (bucket, part, n, data): a bit for each value a bucket sent, set if another bucket has it too."""
    import zstandard

    pack, unpack = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()
    for t, bounds in grouped(batches, ["part"]):
        for s, e in zip(bounds[:-1], bounds[1:]):
            lists = [_unplaned(unpack.decompress(t.column("data")[i].as_py()), 1, t.column("n")[i].as_py())[0] for i in range(s, e)]
            v = np.concatenate(lists)
            order = np.argsort(v, kind="stable")
            twin = v[order][1:] == v[order][:-1]
            again = np.zeros(len(v), bool)
            again[order[1:]] |= twin
            again[order[:-1]] |= twin
            ends = np.cumsum([len(x) for x in lists])
            for i, lo, hi in zip(range(s, e), [0, *ends], ends):
                yield _row(["bucket", "part", "n", "data"], t.column("bucket")[i].as_py(), t.column("part")[s].as_py(), int(hi - lo), pack.compress(np.packbits(again[lo:hi]).tobytes()))


# Sampled suffixes.


def _ends(mask: np.ndarray):
    """Lowest and highest bit of each (not 0)."""
    return np.frexp((mask & -mask).astype(np.float64))[1] - 1, np.frexp(mask.astype(np.float64))[1] - 1


def _spans(row, place, mask, length: int) -> np.ndarray:
    """(row, lo, hi) that windows at place less the bits of mask cover, in order: less than length apart, they join."""
    low, high = _ends(mask)
    out = np.stack([row, place - high, place - low + length])
    return out[:, np.lexsort((out[1], out[0]))]


def _contexts(fs, home: str, bucket: int, answer: np.ndarray, parts: int, length: int):
    """((row, doc, place, mask), context, part) of a bucket's sampled suffixes in windows that may repeat.

    answer: for each value of the bucket, in order, whether another bucket has
    it; what two documents of this one have is found here. Bit x of mask stands
    for the window x bytes before; context is what those windows hold, zeros
    elsewhere.
    """
    period = period_of(length)
    lead, width = period - 1, -(-(period - 1 + length) // 8) * 8
    cover = np.isin(np.arange(period), COVERS[period])
    runs, docs = [], []
    for table, body in _frames(fs, home, bucket):
        for row, _, starts, sizes, a in _pieces(table, body, length):
            text, lo, hi, value = marks(a, starts, sizes, length)
            runs.append((lo.astype(np.int32), hi.astype(np.int32), value))
            docs.append(table[0][row[text]])
    value, doc = np.concatenate([r[2] for r in runs]), np.concatenate(docs)
    runs = [r[:2] for r in runs]
    order = np.lexsort((doc, value))
    v, d = value[order], doc[order]
    first = np.append(True, v[1:] != v[:-1])
    start = np.flatnonzero(first)
    answer = answer | (d[start] != d[np.append(start[1:], len(v)) - 1])
    again = np.empty(len(v), bool)
    again[order] = answer[np.cumsum(first) - 1]
    del value, doc, docs, order, v, d
    base, at = 0, 0
    runs.reverse()
    for table, body in _frames(fs, home, bucket):
        for row, offset, starts, sizes, a in _pieces(table, body, length):
            lo, hi = runs.pop()
            some = again[at : at + len(lo)]
            at += len(lo)
            n = len(a) + 1
            live = np.cumsum(np.bincount(lo[some], minlength=n) - np.bincount(hi[some], minlength=n))[:-1] > 0
            seen = np.concatenate([np.zeros(period, np.int64), np.cumsum(live)])
            near = np.flatnonzero(seen[period:] > seen[:-period])
            text = np.repeat(np.arange(len(row)), sizes)[near]
            own = cover[(near - starts[text] + offset[text]) % period]
            near, text = near[own], text[own]
            flags, mask = np.concatenate([np.zeros(lead, bool), live]), np.zeros(len(near), np.int64)
            for x in range(period):
                mask |= flags[near + lead - x].astype(np.int64) << x
            padded = np.concatenate([np.zeros(lead, np.uint8), a, np.zeros(width, np.uint8)])
            context = np.lib.stride_tricks.sliding_window_view(padded, width)[near]
            # Bytes of no such window are left out, so that passages alike look alike wherever they stand.
            low, high = _ends(mask)
            short = np.flatnonzero((low > 0) | (high < lead))
            column = np.arange(width)
            context[short] *= (column >= (lead - high[short])[:, None]) & (column < (lead + length - low[short])[:, None])
            context[:, lead + length :] = 0
            prefix = _mix(qgrams(a, length - lead))[near] >> np.uint64(64 - _HASH_BITS)
            head = np.stack([base + row[text], table[0][row[text]], near - starts[text] + offset[text], mask])
            yield head, context, _part(prefix.astype(np.int64), parts)
        base += table.shape[1]


def _sampled(folder: str, parts: int, length: int):
    """A bucket's answers, in order of part, to rows (part, bucket, n, head, body): its sampled suffixes by part of their prefix.

    head has (row, doc, place, mask) of n suffixes, body their contexts. Where n
    is negative, head has (row, lo, hi) of spans that are known to repeat.
    """
    names, used = ["part", "bucket", "n", "head", "body"], period_of(length) - 1 + length

    def run(batches):
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(6), zstandard.ZstdDecompressor()

        def passed(bucket, held):
            head, context, part = np.concatenate([x[0] for x in held], 1), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            # Of suffixes alike, those of larger documents are settled here: a hot passage leaves once.
            key = _digest(context) ^ _mix(head[3].astype(np.uint64))
            order = np.lexsort((head[1], key))
            twin = np.append(False, key[order[1:]] == key[order[:-1]])
            where = np.flatnonzero(twin)
            a, b = order[where - 1], order[where]
            twin[where] = (head[3, a] == head[3, b]) & (context[a] == context[b]).all(1)
            least = head[1, order][np.flatnonzero(~twin)][np.cumsum(~twin) - 1]
            known = np.zeros(len(order), bool)
            known[order] = head[1, order] > least
            if known.any():
                yield _row(names, bucket % parts, bucket, -int(known.sum()), pack.compress(_planes(_spans(head[0, known], head[2, known], head[3, known], length))), b"")
            rest = np.flatnonzero(~known)
            rest = rest[np.lexsort((head[2, rest], head[0, rest], part[rest]))]
            edges = np.flatnonzero(np.append(True, np.diff(part[rest]) > 0)) if len(rest) else rest
            for lo, hi in zip(edges, np.append(edges[1:], len(rest))):
                own = rest[lo:hi]
                yield _row(names, int(part[own[0]]), bucket, len(own), pack.compress(_planes(head[:, own])), pack.compress(np.ascontiguousarray(context[own, :used]).tobytes()))

        fs, home = _files(folder)
        for t, bounds in grouped(batches, ["bucket"]):
            for s, e in zip(bounds[:-1], bounds[1:]):
                bits = [np.unpackbits(np.frombuffer(unpack.decompress(t.column("data")[i].as_py()), np.uint8), count=t.column("n")[i].as_py()) for i in range(s, e)]
                bucket, held, size = int(t.column("bucket")[s].as_py()), [], 0
                for some in _contexts(fs, home, bucket, np.concatenate(bits).astype(bool), parts, length):
                    held.append(some)
                    size += len(some[2])
                    if size >= HELD:
                        yield from passed(bucket, held)
                        held, size = [], 0
                if size:
                    yield from passed(bucket, held)

    return run


def _words(context: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of integers, in the order of the bytes."""
    short = -context.shape[1] % 8
    whole = np.pad(context, ((0, 0), (0, short))) if short else np.ascontiguousarray(context)
    return list(np.ascontiguousarray(whole.view(">u8").astype(np.uint64).T))


def _digest(context: np.ndarray) -> np.ndarray:
    h = np.zeros(len(context), np.uint64)
    for word in _words(context):
        h = _mix(h * _ORDER ^ word)
    return h


def _common(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row (but the first) has in common with the one before, from the first byte on."""
    same = rows[1:] == rows[:-1]
    return np.where(same.all(1), rows.shape[1], same.argmin(1)) if len(same) else np.zeros(0, np.int64)


def repeated(doc: np.ndarray, mask: np.ndarray, context: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The bits of mask that stand for windows which also start in a smaller doc.

    Row i of context has period - 1 bytes before a sampled suffix and length of
    it. Of equal windows with a common shift, both are in this table.
    """
    lead, out = period_of(length) - 1, np.zeros(len(doc), np.int64)
    if not len(doc):
        return out
    # Suffixes whose prefix one document alone has are discarded.
    key = _digest(context[:, lead:length])
    order = np.lexsort((doc, key))
    first = np.flatnonzero(np.append(True, key[order[1:]] != key[order[:-1]]))
    stop = np.append(first[1:], len(order))
    live = order[np.repeat(doc[order[first]] != doc[order[stop - 1]], stop - first)]
    if not len(live):
        return out
    # The sampled suffixes in order, with what neighbours have in common; alike rows are one.
    after, before = context[live, lead:], context[live, :lead][:, ::-1]
    order = np.lexsort((mask[live], *_words(before)[::-1], *_words(after)[::-1]))
    live, after, before = live[order], after[order], before[order]
    ahead = _common(after)
    alike = (ahead == length) & (before[1:] == before[:-1]).all(1) & (mask[live[1:]] == mask[live[:-1]])
    start = np.flatnonzero(np.append(True, ~alike))
    of = np.cumsum(np.append(True, ~alike)) - 1
    own, gone = doc[live], np.zeros(len(live), np.int64)
    least, bits, before, ahead = np.minimum.reduceat(own, start), mask[live[start]], before[start], ahead[start[1:] - 1]
    # The same for the bytes before them, read backwards.
    back = np.lexsort(_words(before)[::-1])
    behind = _common(before[back])
    for x in range(lead + 1):
        active = np.flatnonzero(bits >> x & 1)
        if not len(active):
            continue
        # Names of depth length - x of the sampled suffixes, and of the x bytes that lead to them.
        name, prior = np.append(0, np.cumsum(ahead < length - x)), np.empty(len(bits), np.int64)
        prior[back] = np.append(0, np.cumsum(behind < x))
        pair = name[active] * len(bits) + prior[active]
        order = np.argsort(pair, kind="stable")
        edge = np.append(True, pair[order[1:]] != pair[order[:-1]])
        smallest = np.minimum.reduceat(least[active[order]], np.flatnonzero(edge))
        lowest = np.full(len(bits), _LAST)
        lowest[active[order]] = smallest[np.cumsum(edge) - 1]
        gone |= (own > lowest[of]).astype(np.int64) << x
    out[live] = gone
    return out


def _compared(length: int):
    """Rows of a part to (bucket, n, data): (row, lo, hi) of spans that repeat."""
    width = period_of(length) - 1 + length

    def run(batches):
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()
        for t, bounds in grouped(batches, ["part"]):
            for s, e in zip(bounds[:-1], bounds[1:]):
                heads, contexts, buckets = [], [], []
                for i in range(s, e):
                    n, bucket, head = (t.column(c)[i].as_py() for c in ("n", "bucket", "head"))
                    if n < 0:
                        yield _row(["bucket", "n", "data"], bucket, -n, head)
                        continue
                    heads.append(_unplaned(unpack.decompress(head), 4, n))
                    contexts.append(np.frombuffer(unpack.decompress(t.column("body")[i].as_py()), np.uint8).reshape(n, width))
                    buckets.append(np.full(n, bucket))
                if not heads:
                    continue
                head, bucket = np.concatenate(heads, 1), np.concatenate(buckets)
                gone = repeated(head[1], head[3], np.concatenate(contexts), length)
                del heads, contexts, buckets
                some = np.flatnonzero(gone)
                some = some[np.argsort(bucket[some], kind="stable")]
                edges = np.flatnonzero(np.append(True, np.diff(bucket[some]) > 0)) if len(some) else some
                for lo, hi in zip(edges, np.append(edges[1:], len(some))):
                    own = some[lo:hi]
                    yield _row(["bucket", "n", "data"], int(bucket[own[0]]), len(own), pack.compress(_planes(_spans(head[0, own], head[2, own], gone[own], length))))

    return run


def _kept(folder: str):
    """Spans of a bucket to a row for each of its documents."""

    def run(batches):
        import hashlib

        import pyarrow as pa
        import zstandard

        fs, home = _files(folder)
        unpack = zstandard.ZstdDecompressor()

        def told(table, removed, spans, digests):
            each = np.repeat(np.arange(table.shape[1]), table[4])
            ids = pa.array(table[0, each], mask=table[1, each] == 0)
            return pa.RecordBatch.from_arrays([ids, pa.array(table[3, each]), pa.array(removed[each]), pa.array(spans[each]), pa.array(np.array(digests, object)[each], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        for t, bounds in grouped(batches, ["bucket"]):
            for s, e in zip(bounds[:-1], bounds[1:]):
                found = [_unplaned(unpack.decompress(t.column("data")[i].as_py()), 3, t.column("n")[i].as_py()) for i in range(s, e) if t.column("n")[i].as_py()]
                row, lo, hi = np.concatenate([np.zeros((3, 0), np.int64), *found], 1)
                order = np.lexsort((lo, row))
                row, lo, hi = row[order], lo[order], hi[order]
                # Runs of spans that touch: one ends where none before reaches the next.
                reach = np.maximum.accumulate(hi + (row << 32))
                new = np.flatnonzero(np.append(True, lo[1:] + (row[1:] << 32) > reach[:-1])) if len(row) else row
                row, lo, hi = row[new], lo[new], np.maximum.reduceat(hi, new) if len(new) else hi
                base, bucket = 0, int(t.column("bucket")[s].as_py())
                for table, _ in _frames(fs, home, bucket, True):
                    yield told(table, table[3], np.ones(table.shape[1], np.int64), [hashlib.sha256().hexdigest()] * table.shape[1])
                for table, body in _frames(fs, home, bucket):
                    n = table.shape[1]
                    cuts = np.searchsorted(row, np.arange(base, base + n + 1))
                    removed, digests, at = [], [], 0
                    for i, size in enumerate(table[3].tolist()):
                        digest, here, gone = hashlib.sha256(), 0, 0
                        for a, b in zip(lo[cuts[i] : cuts[i + 1]].tolist(), hi[cuts[i] : cuts[i + 1]].tolist()):
                            digest.update(body[at + here : at + a])
                            here, gone = b, gone + b - a
                        digest.update(body[at + here : at + size])
                        digests.append(digest.hexdigest())
                        removed.append(gone)
                        at += size
                    base += n
                    yield told(table, np.array(removed, np.int64), np.diff(cuts), digests)

    return run


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text).

    Texts are whole UTF-8 bytes, null ones empty. A byte is removed if a string
    of length bytes (12 at least) covers it that also starts in a document with
    a smaller doc_id; a null doc_id counts as larger than any, and rows of one
    doc_id remove nothing from each other. Spans are maximal runs of removed
    bytes. An empty table gives no rows; further columns are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark, "4m")
    kind, text, zero = dict(docs.dtypes)["doc_id"], F.coalesce(F.col("text"), F.lit("")), F.lit(0).cast("long")
    short = docs.filter(F.octet_length(text) < length)
    none = short.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    long = docs.filter(F.octet_length("text") >= length)
    size = long.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets, parts = max(1, -(-size // BUCKET_BYTES)), max(1, -(-size // PART_BYTES))
    folder = workspace(spark, "suffix-texts")
    fs, home = _files(folder)
    fs.create_dir(home, recursive=True)

    def dealt(df: DataFrame, n: int, key: str, *more: str) -> DataFrame:
        return df.repartitionById(n, F.col(key).cast("int")).sortWithinPartitions(key, *more)

    doc, bucket = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets))
    rows = long.select(bucket.alias("bucket"), F.col("doc_id").cast("long"), doc.alias("doc"), F.xxhash64("text").alias("h"), "text")
    # Of equal texts that of the smallest doc is looked at; the others are removed whole.
    firsts = rows.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("key")).agg(F.min(F.struct("doc", "h", "bucket")).alias("r")).select("r.bucket", "r.doc", "r.h")
    packed = "bucket long, n long, data binary"
    texts = dealt(rows.mapInArrow(_bucketed, packed).unionByName(firsts.mapInArrow(_listed, packed)), buckets, "bucket")
    sent = dealt(texts.mapInArrow(_filed(folder, buckets, length), "part long, bucket long, n long, data binary"), buckets, "part", "bucket")
    answers = cut(sent.mapInArrow(_answered, "bucket long, part long, n long, data binary"), "suffix-answers")
    del texts, sent
    release(spark)
    chosen = dealt(answers, buckets, "bucket", "part").mapInArrow(_sampled(folder, parts, length), "part long, bucket long, n long, head binary, body binary")
    found = dealt(chosen, parts, "part", "bucket").mapInArrow(_compared(length), "bucket long, n long, data binary")
    # A row for each bucket, so that those without spans are read as well.
    each = spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("data"))
    kept = dealt(found.unionByName(each), buckets, "bucket").mapInArrow(_kept(folder), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return kept.withColumn("doc_id", F.col("doc_id").cast(kind)).unionByName(none)
