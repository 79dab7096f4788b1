"""Long repeats over all documents by run-compressed Burrows-Wheeler indexes with sampled run ends.

Every byte covered by a string of LENGTH bytes that also starts earlier is marked. A string of LENGTH bytes is called a window.

1. Texts are packed into chunks of about CHUNK bytes, as they lie; nothing is shuffled.
2. Each window has an anchor: of its K-byte strings the one with the least hash. Neighbouring windows with one anchor are a
   piece, LENGTH + 34 bytes on average. Equal windows have equal anchors, so that they lie in pieces of one key. Each chunk sends its
   distinct (key, fingerprint) pairs, packed, to shards by key, and learns which keys other pieces have too. Copies of a piece
   within a chunk are marked there (they start after the first one), which also bounds what a frequent passage sends.
3. Pieces with a repeated key go to index shards by key. A key with over HOT different pieces is dealt out by whole
   windows instead (pieces of one window, key by their own hash), so that no shard grows with a frequent anchor.
4. A shard concatenates its distinct pieces in the order of their first places, builds the Burrows-Wheeler transform, keeps
   its runs, the positions sampled at run ends, and for each run the length to which its head matches the nearest run end above
   with the same byte. All pieces are then streamed right to left, in lockstep: a row's step to the left is its run's base plus its
   offset, and its matching statistic grows by one inside a run and is read from the run at a head. Rows whose statistic
   reaches LENGTH continue the row above them: such a chain holds all places of one window, and all but its earliest are marked.
5. The marks go back to the chunks, which merge them into spans.

A shard's memory follows SHARD, the number of shards follows the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import M1, M2, M3, mix64, written

#: Bytes of a window, of an anchor, of a chunk's text; positions that are hashed together.
LENGTH, K, CHUNK, BLOCK = 100, 32, 1 << 20, 1 << 18
#: Different pieces from which a key is dealt out by windows; bytes of text behind a shard of keys, and in an index; shards at least.
HOT, KEYS, SHARD, LEAST = 4096, 16 << 20, 1 << 20, 64
#: Bytes of a side that is broadcast rather than joined by shuffle.
BROADCAST_BYTES = 16 << 20
PLACE = np.uint64((1 << 20) - 1)

CHUNKS = T.StructType().add("chunk", T.LongType()).add("ids", T.ArrayType(T.LongType())).add("ties", T.ArrayType(T.LongType())).add("ends", T.ArrayType(T.LongType())).add("blob", T.BinaryType())
ASKS = "shard int, chunk long, pairs binary"
ANSWERS = "chunk long, shard int, codes binary, pieces long, windows long"
SENT = "shard int, chunk long, ids array<long>, ties array<long>, starts array<int>, sizes array<int>, blob binary"
MARKS = "chunk long, starts array<int>, stops array<int>"


def packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to chunks of whole texts; a longer text is alone."""
    part, seq = TaskContext.get().partitionId() << 32, 0
    ids, ties, ends, texts, held = [], [], [], [], 0

    def chunk() -> pa.RecordBatch:
        nonlocal ids, ties, ends, texts, held, seq
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, ties, ends)]
        out = pa.RecordBatch.from_arrays([pa.array([part + seq], pa.int64()), *lists, pa.array([b"".join(texts)], pa.binary())], CHUNKS.names)
        ids, ties, ends, texts, held, seq = [], [], [], [], 0, seq + 1
        return out

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = (t := text.as_buffer()) and t.to_pybytes() or b""
            if held and held + len(data) > most:
                yield chunk()
            held += len(data)
            ids.append(i)
            ties.append(xxhash.xxh64_intdigest(data) >> 1)
            ends.append(held)
            texts.append(data)
    if ids:
        yield chunk()


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of strings to that of both together."""
    h = a * M1 + b
    h ^= h >> np.uint64(32)
    h *= M2
    return h ^ (h >> np.uint64(29))


class Windows:
    """A chunk's bytes, cut into pieces: starts, number of windows, keys and fingerprints."""

    def __init__(self, blob: bytes, ends: np.ndarray):
        self.data, self.ends = np.frombuffer(blob, np.uint8), ends
        valid = np.ones(len(self.data) + 1, np.int32)
        begins = np.concatenate([[0], ends[:-1]])
        step = np.zeros(len(self.data) + 2, np.int32)
        np.add.at(step, np.maximum(begins, ends - LENGTH + 1), 1)
        np.add.at(step, ends, -1)
        valid = np.cumsum(step)[: len(self.data)] == 0
        found = [self.block(a, valid[a : a + BLOCK]) for a in range(0, max(len(self.data) - LENGTH + 1, 0), BLOCK)]
        self.start, self.n, self.key, self.fp = (np.concatenate(x) if found else np.zeros(0, t) for x, t in zip(zip(*found) if found else [()] * 4, (np.int64, np.int64, np.uint64, np.uint64)))

    def hashes(self, a: int, n: int) -> np.ndarray:
        """Hashes of the K-byte strings that start at a and the n - 1 bytes after it (past the end: of zeros)."""
        raw = self.data[a : a + n + K + 8].tobytes() + bytes(max(0, a + n + K + 8 - len(self.data)))
        h = np.ndarray((n + K - 8,), "<u8", raw, 0, (1,)).copy()
        for width in (8, 16):
            h = joined(h[:-width], h[width:])
        return h

    def block(self, a: int, valid: np.ndarray) -> tuple[np.ndarray, ...]:
        ahead = 2 * LENGTH
        h = self.hashes(a, len(valid) + ahead)
        m = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        width, reach = LENGTH - K + 1, 1
        while 2 * reach <= width:
            m = np.minimum(m[:-reach], m[reach:])
            reach *= 2
        if reach < width:
            m = np.minimum(m[: reach - width], m[width - reach :])
        anchor = m[: len(valid)] & PLACE
        opens = valid.copy()
        opens[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        closes = ~valid
        start = np.flatnonzero(opens)
        stops = np.append(np.flatnonzero(opens | closes), len(valid))
        n = stops[np.searchsorted(stops, start, "right")] - start
        last = start + n - 1 + LENGTH - 2 * K
        double = lambda at: joined(h[at], h[at + K])
        fp = double(start) + n.astype(np.uint64) * M3
        for off in range(2 * K, 2 * LENGTH - K, 2 * K):
            fp = joined(fp, double(np.minimum(start + off, last)))
        fp = joined(fp, double(last))
        return start + a, n, mix64(h[anchor[start].astype(np.int64)]), fp  # anchors have the least hashes: mixed, they spread over all shards

    def single(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of whole windows."""
        key, fp = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        for a in range(0, len(self.data), BLOCK):
            here = np.flatnonzero((start >= a) & (start < a + BLOCK))
            if len(here):
                h, at = self.hashes(a, BLOCK + LENGTH), start[here] - a
                parts = [h[np.minimum(at + off, at + LENGTH - K)] for off in range(0, LENGTH, K)]
                x = y = parts[0]
                for p in parts[1:]:
                    x, y = joined(x, p), joined(p * M3, y)
                key[here], fp[here] = mix64(x), mix64(y)
        return key, fp


def ids_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers (null before all others), ties and ends of a chunk's documents."""
    least = np.iinfo(np.int64).min
    return np.array([least if i is None else i for i in row["ids"]], np.int64), np.array(row["ties"], np.int64), np.array(row["ends"], np.int64)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def distinct_pairs(key: np.ndarray, fp: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """order is sorted by (key, fp): the first of each pair in it, and the number of each entry's pair."""
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (fp[order][1:] != fp[order][:-1])
    return order[new], np.cumsum(new) - 1


def in_order(row: dict) -> tuple[Windows, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's pieces, sorted by key and fingerprint and within these by place; each piece's identifier and tie."""
    ids, ties, ends = ids_of(row)
    w = Windows(row["blob"], ends)
    doc = np.searchsorted(ends, w.start, "right")
    return w, np.lexsort((w.start, ties[doc], ids[doc], w.fp, w.key)), ids[doc], ties[doc]


def asked(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's distinct pairs of key and fingerprint (16 bits of it), for each shard of keys."""
    for row in rows_of(batches):
        w, order, _, _ = in_order(row)
        first, _ = distinct_pairs(w.key, w.fp, order)
        key, fp = w.key[first], (w.fp[first] >> np.uint64(48)).astype(np.uint16)
        cut = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
        own = np.flatnonzero(np.diff(cut))
        pairs = [key[cut[s] : cut[s + 1]].tobytes() + fp[cut[s] : cut[s + 1]].tobytes() for s in own]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([row["chunk"]] * len(own), pa.int64()), pa.array(pairs, pa.binary())], ["shard", "chunk", "pairs"])


def answered(group: pa.Table, hot: int) -> pa.Table:
    """For each chunk and its pairs in their order: 0 a key that no other piece has, 1 a repeated one, 2 one with over `hot` pieces."""
    pairs = [x.as_buffer() for x in group["pairs"].combine_chunks()] if group.num_rows else []
    sizes = np.array([len(p) // 10 for p in pairs])
    key = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(pairs, sizes)])
    fp = np.concatenate([np.frombuffer(p, np.uint16, n, 8 * n) for p, n in zip(pairs, sizes)])
    order = np.lexsort((fp, key))
    k, f = key[order], fp[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    number = np.cumsum(new) - 1
    held = np.bincount(number)
    different = np.bincount(number, new | np.concatenate([[True], f[1:] != f[:-1]]))
    code = np.empty(len(key), np.uint8)
    code[order] = np.where(held > 1, np.where(different > hot, 2, 1), 0)[number]
    at = np.cumsum(sizes) - sizes
    parts = [code[a : a + n] for a, n in zip(at, sizes)]
    keep = [i for i, p in enumerate(parts) if p.any()]
    columns = {
        "chunk": group["chunk"].take(pa.array(keep, pa.int64())).combine_chunks(),
        "shard": group["shard"].take(pa.array(keep, pa.int64())).combine_chunks(),
        "codes": pa.array([np.packbits(np.stack([parts[i] == 1, parts[i] == 2]), axis=1).tobytes() for i in keep], pa.binary()),
        "pieces": pa.array([int((parts[i] == 1).sum()) for i in keep], pa.int64()),
        "windows": pa.array([int((parts[i] == 2).sum()) for i in keep], pa.int64()),
    }
    return pa.table(columns)


def lists(groups: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(g) for g in groups])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(groups) if groups else np.zeros(0, np.int64), kind))


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as one (also across documents: what reads them cuts them there again)."""
    order = np.argsort(start)
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > stop[:-1]])[: len(start)]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1) if len(start) else new
    return start[new], stop[last]


def sent(batches: Iterator[pa.RecordBatch], shards: int, index_shards: int) -> Iterator[pa.RecordBatch]:
    """Pieces with repeated keys for each index shard; as a shard below 0 the spans of copies within the chunk."""
    for row in rows_of(batches):
        w, order, ids, ties = in_order(row)
        if not len(order):
            continue
        first, number = distinct_pairs(w.key, w.fp, order)
        code = np.zeros(len(first), np.uint8)
        cut = np.searchsorted(shard_of(w.key[first], shards), np.arange(shards + 1))
        for a in row["answers"] or ():
            n = cut[a["shard"] + 1] - cut[a["shard"]]
            bits = np.unpackbits(np.frombuffer(a["codes"], np.uint8).reshape(2, -1), axis=1, count=n)
            code[cut[a["shard"]] : cut[a["shard"] + 1]] = bits[0] + 2 * bits[1]
        copies = order[np.concatenate([[False], number[1:] == number[:-1]])]
        piece, hot = first[code == 1], first[code == 2]
        key, start, n, of = w.key[piece], w.start[piece], w.n[piece], piece
        marks = [(w.start[copies], w.n[copies])]
        if len(hot):  # window by window
            of_hot = np.repeat(hot, w.n[hot])
            at = w.start[of_hot] + np.arange(len(of_hot)) - np.repeat(np.cumsum(w.n[hot]) - w.n[hot], w.n[hot])
            k, f = w.single(at)
            by = np.lexsort((at, ties[of_hot], ids[of_hot], f, k))
            one, own = distinct_pairs(k, f, by)
            again = by[np.concatenate([[False], own[1:] == own[:-1]])]
            marks.append((at[again], np.ones(len(again), np.int64)))
            key, start, n, of = np.concatenate([key, k[one]]), np.concatenate([start, at[one]]), np.concatenate([n, np.ones(len(one), np.int64)]), np.concatenate([of, of_hot[one]])
        shard = shard_of(mix64(key), index_shards)
        by = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[by], np.arange(index_shards + 1))
        own = np.flatnonzero(np.diff(cut))
        groups = [by[cut[s] : cut[s + 1]] for s in own]
        blobs = [b"".join(row["blob"][start[i] : start[i] + n[i] + LENGTH - 1] for i in g) for g in groups]
        local, stop = merged(np.concatenate([m[0] for m in marks]), np.concatenate([m[0] + m[1] - 1 + LENGTH for m in marks]))
        numbers, none = pa.array(np.append(own, -1 - row["chunk"] % LEAST), pa.int32()), [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays(
            [
                numbers, pa.array([row["chunk"]] * len(numbers), pa.int64()), lists([ids[of[g]] for g in groups] + none, pa.int64()), lists([ties[of[g]] for g in groups] + none, pa.int64()),
                lists([start[g] for g in groups] + [local], pa.int32()), lists([n[g] for g in groups] + [stop], pa.int32()), pa.array([*blobs, b""], pa.binary()),
            ], ["shard", "chunk", "ids", "ties", "starts", "sizes", "blob"],
        )


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and each one's place, by doubling of prefixes; only ties are sorted again."""
    n, depth = len(codes), 6
    padded, key = np.concatenate([codes, np.zeros(depth, codes.dtype)]).astype(np.uint64), np.zeros(n, np.uint64)
    for j in range(depth):
        key = (key << np.uint64(9)) | padded[j : j + n]
    suffix = np.argsort(key)
    slots, k = np.arange(n), key[suffix]
    head, rank = np.ones(n + 1, bool), np.zeros(n, np.int64)
    while True:
        new = np.concatenate([[True], k[1:] != k[:-1]])
        head[slots] = new
        rank[suffix[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(head[slots] & head[slots + 1])]
        if not len(slots):
            return suffix, rank
        ties = suffix[slots]
        after = ties + depth
        k = (rank[ties] << 32) | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(k)
        suffix[slots], k, depth = ties[order], k[order], 2 * depth


class RunIndex:
    """Runs of the Burrows-Wheeler transform of texts, with positions sampled at their ends. The suffix array isn't kept."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.sizes = np.array([len(t) for t in texts])
        self.stops = np.cumsum(self.sizes + 1) - 1  # of the separators
        codes = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8).astype(np.uint16) + 2
        codes[self.stops], codes[-1] = 1, 0
        suffix, rank = suffix_array(codes)
        before = codes[suffix - 1]
        self.starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        sizes = np.diff(np.append(self.starts, len(codes)))
        chars, head, tail = before[self.starts], suffix[self.starts], suffix[self.starts + sizes - 1]
        self.entry = rank[self.stops]  # rows of the separators, where streams begin
        by_char = np.argsort(chars, kind="stable")
        self.base, self.match = np.empty(len(chars), np.int64), np.zeros(len(chars), np.int64)
        self.base[by_char] = np.cumsum(sizes[by_char]) - sizes[by_char]
        same = np.flatnonzero(chars[by_char][1:] == chars[by_char][:-1])
        run, above = by_char[same + 1], by_char[same]
        self.match[run] = 1 + self.common(codes, tail[above], head[run])

    def common(self, codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, counted up to `length`."""
        padded = np.concatenate([codes, np.zeros(self.length + 4, codes.dtype)])
        words = np.ndarray((len(codes) + self.length,), "<u8", padded.tobytes(), 0, (2,)).copy()  # four codes each
        out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
        for depth in range(0, self.length, 4):
            same = words[a[open_] + depth] == words[b[open_] + depth]
            ended = open_[~same]
            for j in range(4):
                equal = padded[a[ended] + depth + j] == padded[b[ended] + depth + j]
                ended = ended[equal]
                out[ended] += 1
            open_ = open_[same]
            out[open_] += 4
        return out

    def repeated(self) -> np.ndarray:
        """Which positions of the concatenation start a string of `length` bytes that also starts earlier in it."""
        by_size = np.argsort(-self.sizes, kind="stable")
        row, stop, statistic = self.entry[by_size].copy(), self.stops[by_size], np.zeros(len(by_size), np.int64)
        falling = -self.sizes[by_size]
        rows, long, places = [], [], []
        for t in range(1, int(self.sizes.max(initial=0)) + 1):
            n = np.searchsorted(falling, -t, "right")
            run = np.searchsorted(self.starts, row[:n], "right") - 1
            offset = row[:n] - self.starts[run]
            statistic[:n] = np.where(offset == 0, self.match[run], statistic[:n] + 1)
            row[:n] = self.base[run] + offset
            if t >= self.length:
                rows.append(row[:n].copy())
                long.append(statistic[:n] >= self.length)
                places.append(stop[:n] - t)
        out = np.zeros(int(self.stops[-1]) + 1 if len(self.stops) else 0, bool)
        if rows:
            order = np.argsort(np.concatenate(rows))
            place, heads = np.concatenate(places)[order], ~np.concatenate(long)[order]
            heads[0] = True
            earliest = np.minimum.reduceat(place, np.flatnonzero(heads))[np.cumsum(heads) - 1]
            out[place[place > earliest]] = True
        return out


def marked(group: pa.Table) -> pa.Table:
    """An index shard's pieces to the spans, by chunk, that start earlier elsewhere; spans that chunks found themselves pass."""
    if group["shard"][0].as_py() < 0:
        return group.select(["chunk", "starts", "sizes"]).rename_columns(["chunk", "starts", "stops"])
    flat = lambda c: group[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    ids, ties, start, n = flat("ids"), flat("ties"), flat("starts").astype(np.int64), flat("sizes").astype(np.int64)
    chunk = np.repeat(group["chunk"].to_numpy(), [len(x) for x in group["starts"]])
    blob = b"".join(x.as_py() for x in group["blob"])
    stops = np.cumsum(n + LENGTH - 1)
    order = np.lexsort((start, chunk, ties, ids))
    known: dict[bytes, int] = {}
    firsts, later = [], []
    for i in order:
        size = len(known)
        if known.setdefault(blob[stops[i] - n[i] - LENGTH + 1 : stops[i]], size) == size and len(known) > size:
            firsts.append(i)
        else:
            later.append(i)
    firsts, later = np.array(firsts, np.int64), np.array(later, np.int64)
    index = RunIndex(list(known), LENGTH)
    again = np.concatenate([[False], index.repeated(), [False]])
    a, b = np.flatnonzero(again[1:] & ~again[:-1]), np.flatnonzero(~again[1:] & again[:-1])  # runs of marked windows
    begins = index.stops - index.sizes
    piece = np.searchsorted(begins, a, "right") - 1
    from_, of = start[firsts[piece]] + a - begins[piece], chunk[firsts[piece]]
    to = from_ + (b - a) - 1 + LENGTH
    from_, to, of = np.concatenate([from_, start[later]]), np.concatenate([to, start[later] + n[later] - 1 + LENGTH]), np.concatenate([of, chunk[later]])
    by = np.argsort(of, kind="stable")
    chunks, at = np.unique(of[by], return_index=True)
    spans = [merged(from_[g], to[g]) for g in np.split(by, at[1:])] if len(chunks) else []
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "starts": lists([s[0] for s in spans], pa.int32()), "stops": lists([s[1] for s in spans], pa.int32())})


def gathered(group: pa.Table) -> pa.Table:
    """All spans of a chunk, merged: as many as its removed runs."""
    start, stop = (np.concatenate([np.asarray(x.values) for x in group[c]]).astype(np.int64) for c in ("starts", "stops"))
    start, stop = merged(start, stop)
    return pa.table({"chunk": group["chunk"].slice(0, 1), "starts": lists([start], pa.int32()), "stops": lists([stop], pa.int32())})


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with marks to documents: id, n_bytes, spans, kept."""
    for row in rows_of(batches):
        data, ends = np.frombuffer(row["blob"], np.uint8), np.array(row["ends"], np.int64)
        cover = np.zeros(len(data) + 1, np.int64)
        for m in row["marks"] or ():
            np.add.at(cover, np.array(m["starts"], np.int64), 1)
            np.add.at(cover, np.array(m["stops"], np.int64), -1)
        gone = np.cumsum(cover)[:-1] > 0
        begins = np.concatenate([[0], ends[:-1]])
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        edge[begins[begins < len(data)]] = gone[begins[begins < len(data)]]
        opens = np.flatnonzero(edge)
        shut = gone.copy()
        shut[:-1] &= ~gone[1:]
        shut[ends[ends > 0] - 1] = gone[ends[ends > 0] - 1]
        stops = np.flatnonzero(shut) + 1
        cut = np.searchsorted(opens, np.append(begins, len(data)))
        cut[1:] = np.maximum.accumulate(np.searchsorted(opens, ends)) if len(ends) else cut[1:]
        base = np.repeat(begins, np.diff(cut))
        span = pa.StructArray.from_arrays([pa.array(opens - base, pa.int64()), pa.array(stops - base, pa.int64())], ["start", "stop"])
        kept = [row["blob"][a:b] if c == d else data[a:b][~gone[a:b]].tobytes() for a, b, c, d in zip(begins, ends, cut[:-1], cut[1:])]
        spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), span)
        yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(ends - begins, pa.int64()), spans, pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def beside(chunks: DataFrame, side: DataFrame, name: str, size: Column) -> DataFrame:
    """chunks with the rows of side that belong to each, as an array: broadcast if they are few bytes, else joined by shuffle."""
    fields = [c for c in side.columns if c != "chunk"]
    own = side.groupBy(F.col("chunk").alias("s_chunk")).agg(F.collect_list(F.struct(*fields)).alias(name))
    small = (side.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    return chunks.join(F.broadcast(own) if small else own, F.col("chunk") == F.col("s_chunk"), "left").drop("s_chunk")


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's (id, n_bytes, spans, kept): the bytes [start, stop) of its UTF-8 text that repeat earlier text, and the rest.

    Texts are ordered by identifier (an integer, null before all others); different texts with one identifier by a hash, equal
    rows by where they lie, so that one of them stays. A null text is empty; texts shorter than LENGTH keep all. Matches
    never cross texts. Other columns aren't looked at. An empty table gives an empty one.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    most, hot = CHUNK, HOT
    chunks = written(texts.mapInArrow(lambda b: packed(b, most), CHUNKS))
    size = chunks.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    shards = max(LEAST, math.ceil(size / KEYS))
    asks = chunks.mapInArrow(lambda b: asked(b, shards), ASKS)
    answers = written(asks.groupBy("shard").applyInArrow(lambda g: answered(g, hot), ANSWERS))
    pieces, windows = (x or 0 for x in answers.agg(F.sum("pieces"), F.sum("windows")).first())
    index_shards = max(LEAST, math.ceil((pieces + windows * (LENGTH - K) // 2) * (LENGTH + (LENGTH - K) // 2) / SHARD))
    with_answers = beside(chunks, answers.select("chunk", "shard", "codes"), "answers", F.octet_length("codes"))
    found = with_answers.mapInArrow(lambda b: sent(b, shards, index_shards), SENT).groupBy("shard").applyInArrow(marked, MARKS)
    marks = written(found.groupBy("chunk").applyInArrow(gathered, MARKS))
    return beside(chunks, marks, "marks", 8 * F.size("starts")).mapInArrow(finished, "id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")
