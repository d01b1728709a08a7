"""Suffix-array deduplication of passages.

Every window of LENGTH bytes is represented by its anchor, the place in it whose
hash of GRAM bytes is least. Equal windows have equal anchors, so anchors deal
windows to buckets without losing a match, and a window whose anchor occurs in
one document only needs no comparison. Documents stand in shards, which speak
with the buckets in packed blobs. A bucket compares windows exactly: the shards'
contents under its anchors fill suffix arrays of bounded size, sorted by
Larsson-Sadakane refinement, with common prefixes by Kasai's rule, and the
arrays' sorted windows are merged by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table

LENGTH, GRAM = 50, 20
#: Bytes of contents in one suffix array, and compared in one go within a bucket.
SHARD, PIECE = 1 << 20, 1 << 23
#: Bytes of text in a shard of documents, and for each bucket of anchors.
SHARD_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Windows that are hashed together.
BLOCK = 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` bytes, by doubling."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    power, h, width = BASE, data.astype(np.uint64) + np.uint64(1), 1
    out, covered = None, 0
    while width <= size:
        if size & width:
            n = len(data) - covered - width + 1
            out = h[:n].copy() if out is None else out[:n] * power + h[covered : covered + n]
            covered += width
        if width * 2 <= size:
            h = h[:-width] * power + h[width:]
        with np.errstate(over="ignore"):
            power = power * power
        width *= 2
    return _mixed(out)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each `w` neighbours, by doubling."""
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x if width == w else np.minimum(x[: len(x) - (w - width)], x[w - width :])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with the same least hash: the hash, the first
    window and the number of windows. `offsets` parts the documents in `data`;
    every window within a document is in exactly one run, however many documents
    stand side by side."""
    starts, ends = offsets[:-1], offsets[1:]
    shut = np.zeros(len(data) + 1, np.int32)
    np.add.at(shut, np.maximum(starts, ends - length + 1), 1)
    np.add.at(shut, ends, -1)
    opened = np.cumsum(shut[:-1]) == 0
    found: list[tuple] = []
    for a in range(0, max(len(data) - length + 1, 0), BLOCK):
        part = data[a : a + BLOCK + length - 1]
        least = window_min(gram_hashes(part, gram), length - gram + 1)
        at = np.flatnonzero(opened[a : a + len(least)])
        if len(at):
            h = least[at]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)]))
            found.append((h[first], at[first] + a, np.diff(np.append(first, len(at)))))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, first, count = (np.concatenate([f[i] for f in found]) for i in range(3))
    # A run longer than a window's reach can only stem from repeats; it is cut so that contents stay short.
    pieces = -(-count // length)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(h, pieces), np.repeat(first, pieces) + within * length, np.minimum(np.repeat(count, pieces) - within * length, length)


def _narrow(h: np.ndarray) -> bytes:
    """The upper five bytes of hashes. Which anchors are shared may be told too
    generously, never too sparingly: windows are compared by content afterwards."""
    return np.ascontiguousarray((h >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _wide(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view(np.uint64).ravel()


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte instead of one after another, so that equal bytes stand together."""
    return pa.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unplaned(data: pa.Buffer, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(np.int64).ravel()


def _shard(texts: pa.Table) -> tuple[pa.Table, int, np.ndarray, np.ndarray]:
    """A shard's rows by id and text, the number of those with an id, which come
    first, and their bytes and offsets. The order is the same however rows arrive."""
    texts = texts.take(pc.sort_indices(texts, [("doc_id", "ascending"), ("text", "ascending")]))
    text = pc.fill_null(texts["text"], "").cast(pa.large_string()).combine_chunks()
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return texts, len(texts) - texts["doc_id"].null_count, data, offsets - offsets[0]


def _numbered(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and narrow hash of the distinct anchors, in order, and each run's place there."""
    bucket, narrow = (h % np.uint64(buckets)).astype(np.int64), h >> np.uint64(24)
    order = np.lexsort((narrow, bucket))
    b, x = bucket[order], narrow[order]
    new = np.concatenate([[True], (b[1:] != b[:-1]) | (x[1:] != x[:-1])])[: len(b)]
    place = np.zeros(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    return b[new], x[new], place


def _cuts(x: np.ndarray) -> list[tuple[int, int, int]]:
    """Value, start and end of the runs of ordered numbers."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])
    return list(zip(x[at].tolist(), at.tolist(), np.append(at[1:], len(x)).tolist()))


def _announced(length: int, gram: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table) -> pa.Table:
        """A shard's distinct anchors by bucket, and bits for those of several of its documents."""
        texts, named, data, offsets = _shard(texts)
        ids, offsets = texts["doc_id"].slice(0, named).to_numpy().astype(np.int64), offsets[: named + 1]
        h, first, _ = anchors(data[: offsets[-1]], offsets, length, gram)
        b, x, place = _numbered(h, buckets)
        own = ids[np.searchsorted(offsets, first, side="right") - 1] if len(first) else first
        low, high = np.full(len(b), np.iinfo(np.int64).max), np.full(len(b), np.iinfo(np.int64).min)
        np.minimum.at(low, place, own)
        np.maximum.at(high, place, own)
        cuts = _cuts(b)
        hashes = [_narrow(x[s:e] << np.uint64(24)) for _, s, e in cuts]
        several = [np.packbits(low[s:e] < high[s:e]).tobytes() for _, s, e in cuts]
        return pa.table({"bucket": pa.array([c[0] for c in cuts], pa.int32()), "shard": pa.array([key[0].as_py()] * len(cuts), pa.int64()), "hashes": pa.array(hashes, pa.binary()), "several": pa.array(several, pa.binary())})

    return run


def _shared(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """For each shard's announcement bits for the anchors that several documents have."""
    parts = [_wide(x.as_buffer()) for x in group["hashes"]]
    several = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(p)).astype(bool) for x, p in zip(group["several"], parts)]
    names, at, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    known = times > 1
    np.logical_or.at(known, at, np.concatenate(several))
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(known[at[e - len(p) : e]]).tobytes() for e, p in zip(ends, parts)]
    return pa.table({"shard": group["shard"], "bucket": group["bucket"], "bits": pa.array(bits, pa.binary())})


def _contents(length: int, gram: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, replies: pa.Table) -> pa.Table:
        """A shard's distinct contents (runs of windows whose anchor is shared) by bucket,
        each for its smallest id, with the places where that id has it. What larger
        ids repeat within the shard is settled here and passes through as spans."""
        texts, named, data, offsets = _shard(texts)
        ids, offsets = texts["doc_id"].slice(0, named).to_numpy().astype(np.int64), offsets[: named + 1]
        h, first, count = anchors(data[: offsets[-1]], offsets, length, gram)
        b, x, place = _numbered(h, buckets)
        known = np.zeros(len(b), bool)
        for bucket, bits in zip(replies["bucket"].to_pylist(), replies["bits"]):
            s, e = np.searchsorted(b, [bucket, bucket + 1])
            known[s:e] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=e - s)
        hit = known[place] if len(place) else np.zeros(0, bool)
        first, count, place = first[hit], count[hit], place[hit]
        text, after = data.tobytes(), first + count + length - 1
        number: dict[bytes, int] = {}
        kind = np.fromiter((number.setdefault(text[s:e], len(number)) for s, e in zip(first.tolist(), after.tolist())), np.int64, len(first))
        head = np.zeros(len(number), np.int64)
        head[kind[::-1]] = np.arange(len(kind))[::-1]  # rows are in order of ids, so the first has the smallest
        doc = np.searchsorted(offsets, first, side="right") - 1
        own = ids[doc] if len(first) else first
        later = own > own[head][kind]
        # Places are told as if documents stood one byte apart, so that runs of neighbours stay two.
        settled = merge_spans(np.stack([first + doc, after + doc], axis=1)[later])
        rank = np.argsort(place[head], kind="stable")  # contents by bucket and anchor
        turned = np.empty_like(rank)
        turned[rank] = np.arange(len(rank))
        rest = np.flatnonzero(~later)
        rest = rest[np.argsort(turned[kind[rest]], kind="stable")]
        of, at = turned[kind[rest]], (first + doc)[rest]
        lead = head[rank]
        size, owner, anchor, bucket = (after - first)[lead], own[lead], x[place[lead]], b[place[lead]]
        out: dict[str, list] = {c: [] for c in ("bucket", "n", "owners", "sizes", "anchors", "bytes", "many", "of", "firsts", "settled")}
        for i, s, e in _cuts(bucket):
            p, q = np.searchsorted(of, [s, e])
            raw = b"".join(text[f : f + n] for f, n in zip(first[lead[s:e]].tolist(), size[s:e].tolist()))
            for c, v in zip(out, (i, e - s, _planes(owner[s:e]), _planes(size[s:e]), _narrow(anchor[s:e] << np.uint64(24)), pa.compress(raw, codec="zstd", asbytes=True), q - p, _planes(of[p:q] - s), _planes(at[p:q]), b"")):
                out[c].append(v)
        if len(settled):
            for c, v in zip(out, (key[0].as_py() % buckets, 0, *[b""] * 4, 0, b"", b"", settled.astype(np.int64).tobytes())):
                out[c].append(v)
        kinds = {"bucket": pa.int32(), "n": pa.int64(), "many": pa.int64()}
        return pa.table({"shard": pa.array([key[0].as_py()] * len(out["n"]), pa.int64())} | {c: pa.array(v, kinds.get(c, pa.binary())) for c, v in out.items()})

    return run


CONTENTS = "shard long, bucket int, n long, owners binary, sizes binary, anchors binary, bytes binary, many long, of binary, firsts binary, settled binary"


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order.

    Larsson-Sadakane refinement: suffixes are first sorted by eight characters;
    then groups that are still equal are sorted by the ranks of what follows,
    which doubles the depth, while sorted groups are left alone. The order is
    complete, as Kasai's rule needs it.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, data.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    sa = np.argsort(key)
    new = np.concatenate([[True], key[sa[1:]] != key[sa[:-1]]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[sa] = group
    rank[n] = -1
    h = 8
    while True:
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, n))
        open_ = np.repeat(size > 1, size)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        own = sa[at]
        follow = rank[np.minimum(own + h, n)]
        order = np.argsort(group[at] * (n + 2) + follow + 1)
        sa[at] = own[order]
        g, f = group[at][order], follow[order]
        fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (f[1:] != f[:-1])])
        new[at] = fresh
        group[at] = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[sa[at]] = group[at]
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in `sa`, up to `depth`.

    Kasai's rule: the value at place i + 1 of the text is at least that at i less
    one. Contents (from `starts`) are walked in parallel, each in text order.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([data.astype(np.int16), np.full(depth + 1, -1, np.int16)])
    lcp = np.zeros(n, np.int64)
    ends = np.append(starts[1:], n)
    lane = np.argsort(starts - ends, kind="stable")  # longest first
    starts, size = starts[lane], (ends - starts)[lane]
    h = np.zeros(len(starts), np.int64)
    for step in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -step, side="left"))
        i = starts[:live] + step
        j = before[i]
        now = np.maximum(h[:live] - 1, 0)
        act = np.flatnonzero((j >= 0) & (now < depth))
        now[j < 0] = 0
        while len(act):
            a, b = i[act] + now[act], j[act] + now[act]
            act = act[(padded[np.minimum(a, n)] == padded[np.minimum(b, n)]) & (a < n) & (b < n)]
            now[act] += 1
            act = act[now[act] < depth]
        lcp[i] = now
        h[:live] = now
    return lcp


def shard_windows(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal windows in one shard: places of all windows in sorted order,
    the class of each, and each class's smallest owner."""
    n_win = sizes - length + 1
    place = np.repeat(starts - (np.cumsum(n_win) - n_win), n_win) + np.arange(n_win.sum())
    is_window = np.zeros(len(text), bool)
    is_window[place] = True
    own = np.zeros(len(text), np.int64)
    own[place] = np.repeat(owner, n_win)
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa, starts, length)[sa]
    # Windows are a subsequence of the suffixes; a break anywhere between two parts them.
    broken = np.cumsum(lcp < length)
    order = np.flatnonzero(is_window[sa])
    places, part = sa[order], broken[order]
    fresh = np.concatenate([[True], part[1:] != part[:-1]])
    cls = np.cumsum(fresh) - 1
    return places, cls, np.minimum.reduceat(own[places], np.flatnonzero(fresh))


def _keys(text: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The windows as byte strings that compare as such; a last mark keeps zero bytes at the end."""
    raw = np.ones((len(places), length + 1), np.uint8)
    for i in range(length):
        raw[:, i] = text[places + i]
    return raw.view(f"S{length + 1}").ravel()


def least_owners(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray, length: int, shard: int = SHARD) -> np.ndarray:
    """For each window of all contents in turn, the smallest owner of an equal one."""
    n_win = sizes - length + 1
    base = np.cumsum(n_win) - n_win
    out = np.zeros(n_win.sum(), np.int64)
    cut = np.cumsum(sizes) // shard
    found = []
    for s in np.unique(cut):
        own = np.flatnonzero(cut == s)
        lo, hi = starts[own[0]], starts[own[-1]] + sizes[own[-1]]
        local = starts[own] - lo
        places, cls, least = shard_windows(text[lo:hi], local, sizes[own], owner[own], length)
        content = np.searchsorted(local, places, side="right") - 1
        window = base[own[content]] + places - local[content]
        first = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        found.append((window, cls, least, places[first] + lo))
    if len(found) > 1:  # merge: each shard looks its classes up in the others' sorted classes
        keys = [_keys(text, f[3], length) for f in found]
        merged = [f[2].copy() for f in found]
        for a in range(len(found)):
            for b in range(len(found)):
                if a != b:
                    at = np.minimum(np.searchsorted(keys[b], keys[a]), len(keys[b]) - 1)
                    hit = keys[b][at] == keys[a]
                    merged[a][hit] = np.minimum(merged[a][hit], found[b][2][at[hit]])
        found = [(w, c, m, p) for (w, c, _, p), m in zip(found, merged)]
    for window, cls, least, _ in found:
        out[window] = least[cls]
    return out


def _gone(length: int, owners: np.ndarray, sizes: np.ndarray, anchor: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the contents given, runs of windows that a smaller id has too: content, first
    window and last window."""
    at = np.cumsum(sizes) - sizes
    number: dict[bytes, int] = {}
    kind = np.fromiter((number.setdefault(text[s : s + n], len(number)) for s, n in zip(at.tolist(), sizes.tolist())), np.int64, len(at))
    distinct = list(number)
    own = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(own, kind, owners)
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    n_win = size - length + 1
    base = np.cumsum(n_win) - n_win
    least = np.repeat(own, n_win)
    # Windows can only equal windows of the same anchor, so a content that is its anchor's only one needs no array.
    of = np.zeros(len(distinct), np.uint64)
    of[kind] = anchor
    order = np.argsort(of, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))
    run = np.diff(np.append(head, len(of)))
    some = order[np.repeat(run > 1, run)]
    if len(some):
        part = size[some]
        found = least_owners(np.frombuffer(b"".join([distinct[i] for i in some]), np.uint8), np.cumsum(part) - part, part, own[some], length)
        n = n_win[some]
        least[np.repeat(base[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = found
    out = []
    for lo in range(0, len(owners), 100_000):
        k, d = kind[lo : lo + 100_000], owners[lo : lo + 100_000]
        n = n_win[k]
        row = np.repeat(np.arange(len(k)), n)
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = least[base[k][row] + off] < d[row]
        row, off = row[gone], off[gone]
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1)])[: len(row)]
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(row))[: len(head)] - 1
        out.append((row[head] + lo, off[head], off[tail]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _compared(length: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        """Spans to remove of each shard, as far as this bucket knows. Ranges of anchors
        are compared one after another, so that a bucket may be large."""
        settled = group.filter(pc.equal(group["n"], 0))
        shards = settled["shard"].to_pylist()
        spans = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2) for x in settled["settled"]]
        group = group.filter(pc.greater(group["n"], 0))
        blobs = []
        for shard, n, owners, sizes, anchor, raw, many, of, firsts in zip(*(group[c].to_pylist() if c in ("shard", "n", "many") else group[c] for c in ("shard", "n", "owners", "sizes", "anchors", "bytes", "many", "of", "firsts"))):
            blobs.append((shard, _unplaned(owners.as_buffer(), n), _unplaned(sizes.as_buffer(), n), _wide(anchor.as_buffer()), raw, _unplaned(of.as_buffer(), many), _unplaned(firsts.as_buffer(), many)))
        rounds = max(1, -(-sum(int(x[2].sum()) for x in blobs) // PIECE))
        edges = np.linspace(0, 1 << 40, rounds + 1).astype(np.uint64)
        for low, high in zip(edges[:-1], edges[1:]):
            parts, texts = [], []
            for x in blobs:
                s, e = np.searchsorted(x[3], [low, high])
                begin = np.concatenate([[0], np.cumsum(x[2])])
                parts.append((s, e))
                texts.append(pa.decompress(x[4].as_buffer(), int(begin[-1]), codec="zstd", asbytes=True)[begin[s] : begin[e]])
            if not any(texts):
                continue
            row, start, last = _gone(length, *(np.concatenate([x[i][s:e] for x, (s, e) in zip(blobs, parts)]) for i in (1, 2, 3)), b"".join(texts))
            done = 0
            for x, (s, e) in zip(blobs, parts):
                p, q = np.searchsorted(row, [done, done + e - s])
                done += e - s
                if p == q:
                    continue
                # Each place of a content has all the content's runs.
                own, a, z = row[p:q] - (done - (e - s)) + s, start[p:q], last[p:q]
                lo, hi = np.searchsorted(own, x[5]), np.searchsorted(own, x[5], side="right")
                n = hi - lo
                take = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                at = np.repeat(x[6], n)
                shards.append(x[0])
                spans.append(np.stack([at + a[take], at + z[take] + length], axis=1))
        by_shard: dict[int, list] = {}
        for shard, own in zip(shards, spans):
            by_shard.setdefault(shard, []).append(own)
        merged = [merge_spans(np.concatenate(x)) for x in by_shard.values()]
        return pa.table({"shard": pa.array(list(by_shard), pa.int64()), "n": pa.array([len(m) for m in merged], pa.int64()), "spans": pa.array([_planes(m.ravel()) for m in merged], pa.binary())})

    return run


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of the bytes that (start, end) rows cover."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    head = np.flatnonzero(fresh)
    return np.stack([spans[head, 0], reach[np.append(head[1:], len(spans)) - 1]], axis=1)


def _cleaned(key: tuple[pa.Scalar, ...], texts: pa.Table, replies: pa.Table) -> pa.Table:
    texts, _, data, offsets = _shard(texts)
    spans = [_unplaned(x.as_buffer(), 2 * n).reshape(-1, 2) for x, n in zip(replies["spans"], replies["n"].to_pylist())]
    runs = np.concatenate([np.zeros((0, 2), np.int64), *spans])
    runs = merge_spans(runs)
    doc = np.searchsorted(offsets[1:] + np.arange(1, len(offsets)), runs[:, 0], side="right")
    runs = runs - doc[:, None]
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 1], -1)
    stays = np.cumsum(edge[:-1]) == 0
    kept_to = np.concatenate([[0], np.cumsum(stays)])[offsets]
    many = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
    local = runs - offsets[doc][:, None]
    cells = pa.StructArray.from_arrays([pa.array(local[:, 0]), pa.array(local[:, 1])], names=["start", "end"])
    kept = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(kept_to.astype(np.int64).tobytes()), pa.py_buffer(data[stays].tobytes())])
    return pa.table({"doc_id": texts["doc_id"], "n_bytes": np.diff(offsets), "spans": pa.ListArray.from_arrays(pa.array(many, pa.int32()), cells), "kept": kept.cast(pa.binary())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans, kept: each text as UTF-8 without the bytes that are
    covered by `length` bytes which also start in a document of a smaller id.

    Spans (start, end) are the maximal runs removed. Strings are judged on the
    input. Texts shorter than `length`, null and empty ones lose nothing; null
    counts as empty. Rows with a null id neither lose nor take bytes. Rows that
    repeat an id don't remove each other's bytes; each is judged by itself. Kept
    bytes need not be UTF-8. An empty table gives an empty result; extra columns
    are ignored. Results do not depend on partitioning.

    Documents are dealt to shards of about SHARD_BYTES by a hash of id and text.
    A shard announces its anchors, sends each of its distinct contents under a
    shared anchor once, and gets spans back as one blob a bucket; so a passage
    that any number of documents share costs one content a shard.
    """
    spark, gram = docs.sparkSession, min(GRAM, length)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(spark), -(-total // SHARD_BYTES))
    buckets = max(2 * partitions(spark), -(-total // BUCKET_BYTES))
    texts = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))).repartition(partitions(spark), "shard").select("shard", "doc_id", "text")
    told = texts.groupBy("shard").applyInArrow(_announced(length, gram, buckets), "bucket int, shard long, hashes binary, several binary")
    shared = told.groupBy("bucket").applyInArrow(_shared, "shard long, bucket int, bits binary")
    contents = texts.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(_contents(length, gram, buckets), CONTENTS)
    spans = contents.groupBy("bucket").applyInArrow(_compared(length), "shard long, n long, spans binary")
    return texts.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(_cleaned, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
