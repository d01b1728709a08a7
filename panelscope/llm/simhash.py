"""SimHash near-deduplication with a generalised pigeonhole search.

Bits of the fingerprints are grouped into partitions so that correlated bits
stand together. Each partition has its own threshold; the thresholds add up to
the distance less the number of partitions plus one, so that two fingerprints
within the distance agree within the threshold on at least one partition. A
dynamic programme picks the thresholds that cost least by candidate counts
estimated from a sample; the estimate steers the cost only, never the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, lean, partitions, settings, table, tidied, unused
from .components import components

SEED = 42
#: Fingerprints from which the search's costs are estimated.
SAMPLE = 2000
#: A key held by more indexed fingerprints than this is first contracted around pivots.
DENSE = 256
#: Relative costs of sending one probe and of comparing one candidate.
PROBE_COST, CANDIDATE_COST = 300.0, 1.0
#: Texts from which common shingles are learned, and in how many a common one occurs.
COMMON_SAMPLE, COMMON = 8000, 3
#: Most common shingles sent to all workers.
COMMON_MOST = 200_000
#: Pairs compared at once; each takes over 100 bytes.
PAIRS = 200_000
#: Of the search for similar texts: bits of the pigeonhole search, hashes by which a text first meets pivots, pivots of a hash,
#: and rounds in which the parts left meet pivots under all their hashes.
RADIUS, TURNS, PIVOTS, ROUNDS = 4, 3, 8, 1
#: Slots by which texts are left out before a join, and so the most rows broadcast there.
SLOTS = 1 << 20
#: A hash that so many texts have makes them a crowd; crowds and other groups are compared in blocks
#: of about BLOCK texts, fewer if these have more than BLOCK_SHINGLES.
CROWD, BLOCK, BLOCK_SHINGLES, NO_CROWD = 1024, 512, 1 << 20, 0
#: Sets of fewer shingles may differ in more bits; pairs of whole texts handed to Python together.
SMALL, TEXTS = 50, 256


def shingles(text: bytes, words: int) -> list[bytes]:
    """Shingles of a text, repeats included. `bytes.split` cuts at the same six
    characters that part the words."""
    tokens = text.lower().split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    return [joined[s:e] for s, e in zip(starts[:n].tolist(), ends[-n:].tolist())]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def fingerprint(text: bytes, words: int = 4, halves: int = 1, repeats: bool = True) -> list[int]:
    """Unsigned 64-bit fingerprints: the first of the shingles' XXH64, each further
    one of these hashes mixed anew; of distinct shingles only, without `repeats`."""
    own = shingles(text, words)
    return _bits(_hashes(own if repeats else {*own}), halves)


def _hashes(own: Iterable[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in own), np.uint64)


def _bits(hashed: np.ndarray, halves: int) -> list[int]:
    n, out = len(hashed), []
    for half in range(halves):
        h = _mix(hashed + np.uint64(half * 0x9E3779B97F4A7C15 % 2**64)) if half else hashed
        counts = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 14):
            counts += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]))
    return out


def _fingerprinted(words: int, halves: int, repeats: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = np.array([fingerprint((t or "").encode(), words, halves, repeats) for t in part.column(1).to_pylist()], np.uint64).reshape(-1, halves)
                cols = [pa.array(np.ascontiguousarray(got[:, i]).view(np.int64)) for i in range(halves)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", *(f"f{i}" for i in range(halves))])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, halves: int = 1, repeats: bool = True) -> DataFrame:
    """doc_id, f0, f1, ...: signed longs. Null and empty texts have zero."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprinted(words, halves, repeats), "doc_id long, " + ", ".join(f"f{i} long" for i in range(halves)))


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in `parts` groups of nearly equal width: each group starts with the
    free bit that is most correlated with the others and takes in the bits most
    correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    bits -= bits.mean(axis=0) if len(bits) else 0
    norm = np.sqrt((bits**2).sum(axis=0)) + 1e-9
    close = np.abs(bits.T @ bits) / np.outer(norm, norm)
    free, groups = list(range(64)), []
    for p in range(parts):
        width = 64 // parts + (p < 64 % parts)
        group = [max(free, key=lambda b: close[b, free].sum())]
        free.remove(group[0])
        while len(group) < width:
            group.append(max(free, key=lambda b: close[b, group].sum()))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _mask(group: list[int]) -> int:
    return sum(1 << b for b in group)


def allocate(sample: np.ndarray, n: int, distance: int, groups: list[list[int]]) -> tuple[float, list[int]]:
    """Cost and thresholds, -1 where a partition is not probed."""
    a = sample[: SAMPLE // 2, None] ^ sample[None, SAMPLE // 2 :]
    costs = []
    for g in groups:
        w = len(g)
        near = np.bincount(np.bitwise_count(a & np.uint64(_mask(g))).ravel(), minlength=w + 1)[: w + 1] / max(a.size, 1)
        even = np.array([comb(w, k) / 2.0**w for k in range(w + 1)])
        rate = np.maximum(np.cumsum(near), np.cumsum(even))
        balls = np.cumsum([comb(w, k) for k in range(w + 1)])
        costs.append([0.0] + [PROBE_COST * n * (1 + balls[t]) + CANDIDATE_COST * rate[t] * n * n for t in range(min(w, distance) + 1)])
    need = distance - len(groups) + 1  # thresholds of -1 and more add up to this
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (c, chosen) in best.items():
            for t, more in enumerate(cost, start=-1):
                if total + t not in new or c + more < new[total + t][0]:
                    new[total + t] = (c + more, [*chosen, t])
        best = new
    return best.get(need, (float("inf"), []))


def plan_search(sample: np.ndarray, n: int, distance: int) -> tuple[list[list[int]], list[int]]:
    options = []
    for parts in range(1, min(12, distance + 1) + 1):
        groups = group_bits(sample, parts)
        cost, thresholds = allocate(sample, n, distance, groups)
        if thresholds and max(comb(len(g), k) for g, t in zip(groups, thresholds) for k in range(t + 1) or [0]) < 1_000_000:
            options.append((cost, parts, groups, thresholds))
    _, _, groups, thresholds = min(options, key=lambda o: o[:2])
    return groups, thresholds


def _masks(group: list[int], threshold: int) -> np.ndarray:
    return np.array([_mask(list(c)) for k in range(threshold + 1) for c in combinations(group, k)], np.uint64)


def _entries(half: int, groups, thresholds):
    """Rows (key, probe, node, f0, ...): one indexed row per partition in use and
    one probe per value within its threshold."""
    plans = [(i, np.uint64(_mask(g)), _masks(g, t)) for i, (g, t) in enumerate(zip(groups, thresholds)) if t >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            own = cols[1 + half].view(np.uint64)
            names = ["key", "probe", *batch.schema.names]
            for i, mask, flips in plans:
                for flip in [None, *flips]:
                    value = own & mask if flip is None else (own & mask) ^ flip
                    key = _mix(value * np.uint64(31) + np.uint64(half * 97 + i + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(own), flip is not None)), *batch.columns], names=names)

    return run


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


class _Forest:
    """Union-find over the nodes of one task."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def roots(self) -> np.ndarray:
        while (up := self.up[self.up]).tobytes() != self.up.tobytes():
            self.up = up
        return self.up


def _link_run(forest: _Forest, idx: np.ndarray, probes: np.ndarray, node: np.ndarray, fp: np.ndarray, distance: int) -> None:
    """All links between a key's indexed rows and its probes, as forest edges.
    In a dense run a few pivots gather what lies close to them; rows gathered by
    the same pivot are connected already and aren't compared with each other."""
    label = {}
    if len(idx) > DENSE:
        free = np.ones(len(idx), bool)
        for pivot in range(8):
            if not free.any():
                break
            p = idx[np.argmax(free)]
            near = free & (_distance(fp[idx], fp[p]) <= distance)
            free &= ~near
            for i in idx[near].tolist():
                forest.link(node[p], node[i])
                label[int(node[i])] = pivot + 1
    lab_i = np.array([label.get(int(x), 0) for x in node[idx]])
    lab_p = np.array([label.get(int(x), 0) for x in node[probes]])
    for ell in np.unique(lab_p):
        some = probes[lab_p == ell]
        other = idx if ell == 0 else idx[lab_i != ell]
        step = max(1, 4_000_000 // max(1, len(other)))
        for at in range(0, len(some), step):
            block = some[at : at + step]
            p, i = np.nonzero(_distance(fp[block][:, None], fp[other][None, :]) <= distance)
            for a, b in set(zip(node[block[p]].tolist(), node[other[i]].tolist())):
                if a != b:
                    forest.link(a, b)


def _linked(halves: int, distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        key, probe, node = (got[c].to_numpy() for c in ("key", "probe", "node"))
        fp = np.stack([got[f"f{i}"].to_numpy().view(np.uint64) for i in range(halves)], axis=1)
        ids, node = np.unique(node, return_inverse=True)
        order = np.lexsort((probe, key))
        key, probe, node, fp = key[order], probe[order], node[order], fp[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        n_probe = np.add.reduceat(probe.astype(np.int64), starts)
        n_idx = ends - starts - n_probe
        forest = _Forest(len(ids))
        small = (n_idx > 0) & (n_probe > 0) & (n_idx <= DENSE) & (n_idx * n_probe <= 1 << 20)
        # Small runs together: every (indexed, probe) pair of a run, in blocks of about two million pairs.
        s, a, b = starts[small], n_idx[small], n_probe[small]
        cuts = np.searchsorted(np.cumsum(a * b), np.arange(0, (a * b).sum() + 1, 2_000_000)[1:]) if len(s) else np.array([], int)
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(s))):
            if lo >= hi:
                continue
            size = a[lo:hi] * b[lo:hi]
            run_of = np.repeat(np.arange(lo, hi), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i = s[run_of] + at // b[run_of]
            p = s[run_of] + a[run_of] + at % b[run_of]
            hit = _distance(fp[i], fp[p]) <= distance
            hit &= node[i] != node[p]
            for x, y in set(zip(node[i[hit]].tolist(), node[p[hit]].tolist())):
                forest.link(x, y)
        for r in np.flatnonzero((n_idx > 0) & (n_probe > 0) & ~small):
            mid = starts[r] + n_idx[r]
            _link_run(forest, np.arange(starts[r], mid), np.arange(mid, ends[r]), node, fp, distance)
        if forest.edges:
            e = ids[np.array(forest.edges)]
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    return run


def search_plans(nodes: DataFrame, halves: int, radius: int) -> list[tuple[list[list[int]], list[int]]]:
    """Partitions and thresholds for each 64-bit part of the fingerprints."""
    n, sample = nodes.count(), nodes.limit(SAMPLE).toPandas()
    return [plan_search(sample[f"f{half}"].to_numpy(np.int64).view(np.uint64), n, radius) for half in range(halves)]


def link_fingerprints(nodes: DataFrame, plans: list, distance: int = 4) -> DataFrame:
    """a, b: links among rows (node, f0, ...) whose fingerprints differ in at most
    `distance` bits in all, enough of them to connect all that are linked.

    With plans for a radius of `distance` divided by the number of 64-bit parts,
    no link is lost, as one part differs no more than that. With a smaller radius
    only rows that meet within a threshold are compared."""
    halves, out = len(plans), None
    nodes = nodes.select("node", *[f"f{i}" for i in range(halves)])
    for half, (groups, thresholds) in enumerate(plans):
        schema = "key long, probe boolean, " + ", ".join(f"{c} long" for c in nodes.columns)
        entries = nodes.mapInArrow(_entries(half, groups, thresholds), schema)
        out = entries if out is None else out.unionByName(entries)
    return out.repartition(partitions(nodes.sparkSession), "key").mapInArrow(lean(_linked(halves, distance)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, halves: int = 1) -> DataFrame:
    """doc_id, f0, ..., component_id: one row per row of `docs`.

    A text of fewer than `words` words has one shingle, a null or empty text has
    fingerprint zero and is linked like any other. component_id is the smallest
    id reachable over links of at most `distance` differing bits. Documents with
    equal fingerprints share a component; a row with a null id belongs to the
    component of its fingerprint, or to none (null) if no id is there. An empty
    table gives an empty result; extra columns are ignored.
    """
    keys = [f"f{i}" for i in range(halves)]
    rows = checkpointed(fingerprints(docs, id_col, text_col, words, halves))
    nodes = checkpointed(rows.groupBy(*keys).agg(F.min("doc_id").alias("node")).select("node", *keys))
    known = nodes.filter("node IS NOT NULL")
    roots = components(link_fingerprints(known, search_plans(known, halves, distance // halves), distance))
    named = nodes.join(roots, "node", "left").select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce("root", "node").alias("component_id"))
    on = F.lit(True)
    for k in keys:
        on = on & (rows[k] == F.col(f"_{k}"))
    return rows.join(named, on).select("doc_id", *keys, "component_id")


def common_shingles(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that occur in many texts of a sample, ascending, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_hashes({*shingles((t or "").encode(), words)}).view(np.int64))], names=["h"])

    some = docs.select(F.col(text_col).alias("text")).limit(COMMON_SAMPLE).repartition(partitions(docs.sparkSession))
    counts = some.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= COMMON)
    got = counts.orderBy(F.desc("count"), "h").limit(COMMON_MOST).toPandas()
    h, n = got["h"].to_numpy(np.int64).view(np.uint64), got["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix(hashed: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of a set's distinct hashes in one order of all hashes, common ones
    last: so many that two sets of the similarity asked for share one of them."""
    known, many = common
    rank = np.zeros(len(hashed), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
        rank = np.where(known[at] == hashed, many[at], 0)
    order = np.lexsort((hashed, rank))
    return hashed[order[: len(hashed) - ceil(similarity * len(hashed) - 1e-9) + 1]]


def _dealt(shared, words: int, halves: int, similarity: float, buckets: int):
    """Rows of two kinds: for each distinct set of a batch its signature, size,
    fingerprints, least id, the row that has it, and all ids, dealt by signature;
    and for each bucket of hashes of the sets' prefixes a blob, dealt by bucket."""
    bits = [f"f{i}" for i in range(halves)]
    names = ["deal", "signature", "size", *bits, "least", "row", "ids", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[int, list] = {}
            for doc, row, t in zip(*(c.to_pylist() for c in batch.columns)):
                h = np.unique(_hashes({*shingles((t or "").encode(), words)}))
                sign = int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view(np.int64))
                if sign not in first:
                    first[sign] = [len(h), _bits(h, halves), prefix(h, shared.value, similarity), (True, None, row), []]
                own = first[sign]
                if doc is not None:
                    own[3] = min(own[3], (False, doc, row))
                own[4].append(doc)
            if not first:
                continue
            sign, rows = np.fromiter(first, np.int64, len(first)), list(first.values())
            fp = np.array([x[1] for x in rows], np.uint64).reshape(-1, halves)
            cols = [pa.array(sign), pa.array(sign), pa.array([x[0] for x in rows], pa.int64()), *[pa.array(np.ascontiguousarray(fp[:, i]).view(np.int64)) for i in range(halves)], pa.array([x[3][1] for x in rows], pa.int64()), pa.array([x[3][2] for x in rows], pa.int64()), pa.array([x[4] for x in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(rows), pa.binary())], names=names)
            key = np.concatenate([x[2] for x in rows])
            of = np.repeat(sign, [len(x[2]) for x in rows])
            place = np.concatenate([_places(len(x[2])) for x in rows])
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((key, bucket))
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = [(b, order[x:y]) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
            blobs = [_narrow(key[o]) + of[o].tobytes() + place[o].tobytes() for _, o in some]
            none = [pa.nulls(len(some), c.type) for c in cols[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in some], pa.int64()), *none, pa.array(blobs, pa.binary())], names=names)

    return run


def _narrow(key: np.ndarray) -> bytes:
    """Six bytes of each hash. Sets that meet by mistake are compared and told apart."""
    return np.ascontiguousarray(key.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _places(n: int) -> np.ndarray:
    """Each hash's place in a prefix of n, in 256ths, rounded down."""
    return (np.arange(n) * 256 // max(n, 1)).astype(np.uint8)


def _widened(blob: bytes) -> tuple[np.ndarray, ...]:
    n = len(blob) // 15
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8, 6 * n).reshape(-1, 6)
    return out.view(np.int64).ravel(), np.frombuffer(blob, np.int64, n, 6 * n), np.frombuffer(blob, np.uint8, n, 14 * n)


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes sets on; of the hashes in a bucket's blobs those that several signatures
    have, once for each, with their least place in `f0`."""
    blobs: dict[int, list] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        told = batch.column("blob").is_valid()
        if (got := batch.filter(pc.invert(told))).num_rows:
            yield got
        rest = batch.filter(told)
        for b, x in zip(rest.column("deal").to_pylist(), rest.column("blob")):
            blobs.setdefault(b, []).append(_widened(x.as_py()))
    for some in blobs.values():
        key, own, place = (np.concatenate([x[i] for x in some]) for i in (0, 1, 2))
        order = np.lexsort((place, own, key))
        key, own, place = key[order], own[order], place[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        key, own, place = key[new], own[new], place[new]
        same = key[1:] == key[:-1]
        met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        key, own, place = key[met], own[met], place[met]
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.nulls(len(key), schema[2].type), pa.array(place.astype(np.int64)), *[pa.nulls(len(key), f.type) for f in schema][4:]], schema=schema)


def _by_key(batches: list[pa.RecordBatch], halves: int) -> tuple[np.ndarray, ...]:
    """Rows by key, part and node; for each row the first row and the end of its key
    and the end of its part there; then its crowd and place."""
    got = pa.Table.from_batches(batches)
    key, node, part = (got[c].to_numpy() for c in ("key", "node", "part"))
    order = np.lexsort((node, part, key))
    key, node, part = key[order], node[order], part[order]
    fp = np.stack([got[f"f{i}"].to_numpy()[order].view(np.uint64) for i in range(halves)], axis=1)
    size = got["size"].to_numpy()[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    new_part = new_key | np.concatenate([[True], part[1:] != part[:-1]])[: len(key)]
    edges = np.append(np.flatnonzero(new_key), len(key))
    runs = np.append(np.flatnonzero(new_part), len(key))
    spread = np.diff(edges)
    return node, size, fp, np.repeat(edges[:-1], spread), np.repeat(edges[1:], spread), np.repeat(runs[1:], np.diff(runs)), new_part, got["crowd"].to_numpy()[order], got["place"].to_numpy()[order]


def _bound(size: np.ndarray, distance: int) -> np.ndarray:
    """Differing bits up to which sets of so many shingles are verified: ten fewer for all but small sets."""
    return np.where(size < SMALL, distance, distance - 10)


def _toward_pivots(halves: int, similarity: float, distance: int):
    """Each row's nearest among the first rows of the first PIVOTS parts of its key
    that aren't its own: as many comparisons as rows, times PIVOTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (batches := [b for b in batches if b.num_rows]):
            return
        node, size, fp, start, _, _, new_part, _, _ = _by_key(batches, halves)
        part_no = np.cumsum(new_part) - 1
        rank = part_no - part_no[start]
        heads = np.flatnonzero(new_part)
        best, near = np.full(len(node), distance + 1), np.zeros(len(node), np.int64)
        for q in range(PIVOTS):
            at = part_no[start] + q
            live = np.flatnonzero((at < len(heads)) & (rank != q))
            live = live[start[heads[at[live]]] == start[live]]
            pivot = heads[at[live]]
            d = _distance(fp[live], fp[pivot])
            ok = (d < best[live]) & (np.minimum(size[live], size[pivot]) >= similarity * np.maximum(size[live], size[pivot]) - 1e-9)
            best[live[ok]], near[live[ok]] = d[ok], node[pivot[ok]]
        hit = best <= distance
        yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(best[hit]), pa.array(near[hit])], names=["node", "d", "near"])

    return run


def _apart(halves: int, similarity: float, distance: int):
    """Pairs of different parts that share a key and may be similar, but for those of
    one crowd: of a task's pairs as many as connect what all of them connect, so that
    rows don't grow with the square of a group. Two sets share no more hashes than
    either has from the place of the first that they share on, so a pair counts only
    under keys after whose places both have enough left; similar ones have at least
    their first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (batches := [b for b in batches if b.num_rows]):
            return
        node, size, fp, _, end, past, _, crowd, place = _by_key(batches, halves)
        length = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
        left = size - (place * length + 255) // 256  # hashes from its place on, or more
        many = end - past
        done = np.cumsum(many)
        ids, own = np.unique(node, return_inverse=True)
        forest, lo = _Forest(len(ids)), 0
        while lo < len(node):
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] - many[lo] + PAIRS, "right")))
            i = np.repeat(np.arange(lo, hi), many[lo:hi])
            j = np.arange(len(i)) - np.repeat(done[lo:hi] - many[lo:hi] - (done[lo] - many[lo]), many[lo:hi]) + past[i]
            root = forest.roots()[own]
            ok = (root[i] != root[j]) & ((crowd[i] != crowd[j]) | (crowd[i] == NO_CROWD))
            i, j = i[ok], j[ok]
            ok = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
            ok &= np.minimum(left[i], left[j]) >= similarity / (1 + similarity) * (size[i] + size[j]) - 1e-6
            i, j = i[ok], j[ok]
            ok = _distance(fp[i], fp[j]) <= _bound(np.minimum(size[i], size[j]), distance)
            for x, y in zip(own[i[ok]].tolist(), own[j[ok]].tolist()):
                forest.link(x, y)
            lo = hi
        if forest.edges:
            ends = ids[np.array(forest.edges)]
            yield pa.RecordBatch.from_arrays([pa.array(ends.max(axis=1)), pa.array(ends.min(axis=1))], names=["a", "b"])

    return run


def _similar(words: int, similarity: float):
    def hashes(text: str) -> np.ndarray:
        return np.unique(_hashes({*shingles(text.encode(), words)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                one, two = one.as_py(), two.as_py()
                if one != last:
                    last, x = one, hashes(one)
                y = hashes(two)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def crowds(shared: DataFrame) -> DataFrame:
    """node, crowd: nodes under hashes that CROWD nodes or more have, with the crowd
    that such hashes connect."""
    keys = shared.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).filter(F.col("n") >= CROWD).select("key", "first")
    return checkpointed(components(shared.join(keys, "key").select("node", "first")).select("node", F.col("root").alias("crowd")))


def _cell(words: int, halves: int, similarity: float, distance: int):
    """The links of different parts between two blocks of a group (or within one),
    as many as connect what they connect."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        low, high = key[2].as_py(), key[3].as_py()
        group = group.take(np.argsort(group["node"].to_numpy(), kind="stable"))
        node, part, size, block = (group[c].to_numpy() for c in ("node", "part", "size", "block"))
        fp = np.stack([group[f"f{i}"].to_numpy().view(np.uint64) for i in range(halves)], axis=1)
        one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
        near = []
        for i in one.tolist():
            others = two[two > i] if low == high else two
            ok = (part[others] != part[i]) & (np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i]) - 1e-9)
            others = others[ok]
            others = others[_distance(fp[others], fp[i]) <= _bound(np.minimum(size[others], size[i]), distance)]
            if len(others):
                near.append((i, others))
        asked = np.unique(np.concatenate([np.append(o, i) for i, o in near])) if near else []
        sets = [np.unique(_hashes({*shingles(group["text"][i].as_py().encode(), words)})) for i in asked]
        known, flat = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, np.int64))
        own = dict(zip(asked, np.split(flat, np.cumsum([len(x) for x in sets])[:-1])))
        mine, out = np.zeros(len(known), np.int64), []
        for i, others in near:
            others = others[part[others] != part[i]]  # parts grow as links are found
            if not len(others):
                continue
            x, ys = own[i], [own[j] for j in others]
            n = np.array([len(y) for y in ys])
            mine[x] = 1
            both = np.add.reduceat(mine[np.concatenate(ys)], np.cumsum(n) - n)
            mine[x] = 0
            for j in others[both >= similarity * (len(x) + n - both) - 1e-9].tolist():
                if part[j] != part[i]:
                    part = np.where(part == part[j], part[i], part)
                    out.append((node[i], node[j]))
        ends = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": ends.max(axis=1, initial=np.iinfo(np.int64).min), "b": ends.min(axis=1, initial=np.iinfo(np.int64).max)})

    return run


def texts_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, text of the nodes asked for, nearly: rows in other slots of a hash are left
    out before anything is dealt. The slots broadcast are SLOTS at most."""
    asked = nodes.select(F.pmod("node", F.lit(SLOTS)).alias("slot")).distinct()
    return texts.withColumn("slot", F.pmod("node", F.lit(SLOTS))).join(F.broadcast(asked), "slot", "left_semi").select("node", "text")


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs a, b of nodes whose texts' sets of shingles have the Jaccard similarity asked for."""
    some = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), texts)
    one = pairs.join(some.select(F.col("node").alias("b"), F.col("text").alias("x")), "b")
    both = one.join(some.select(F.col("node").alias("a"), F.col("text").alias("y")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(lean(_similar(words, similarity)), "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, distance: int = 64, halves: int = 3) -> DataFrame:
    """doc_id, component_id: the smallest id reachable over links between texts of
    at least that similarity between their sets of shingles.

    The pigeonhole search over 64 bits proposes the first links. As no search by
    bits finds every pair at 0.8, all other pairs meet by the prefixes of their
    sets, which two such sets cannot but share. At first each text is verified
    only against the nearest pivot that it meets under a few of its hashes, which
    contracts groups cheaply; the parts left do so once more under all their hashes.
    Then all pairs between the parts left are verified, so none is lost to the choice
    of links: texts that may be similar to one another, at once or over others, are a
    group, as are those under hashes that very many have (a crowd), and a group's
    texts are compared block against block, so that rows don't grow with the square
    of a group but with the number of its blocks. Pairs of more than `distance` differing bits of all
    fingerprints (ten fewer for sets of SMALL shingles or more) are not verified;
    a similarity of 0.8 is 29 of 192 bits on average (up to 37 for the smallest
    sets) with a deviation of about five, so one is lost in less than a case of a
    million. Texts with equal sets are
    one node, named by a 64-bit hash of the set. A row with a null id belongs to
    the component of its set if others with an id have that set, or to none
    (null); null and empty texts have the empty set and are one group. Of rows
    that share an id each has a row here. An empty table gives an empty result; extra
    columns are ignored.
    """
    spark = docs.sparkSession
    n, bits = partitions(spark), [f"f{i}" for i in range(halves)]
    common = spark.sparkContext.broadcast(common_shingles(docs, text_col, words))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("node"), "text")
    schema = f"deal long, signature long, size long, {', '.join(f'{b} long' for b in bits)}, least long, row long, ids array<long>, blob binary"
    dealt = checkpointed(rows.mapInArrow(lean(_dealt(common, words, halves, similarity, 4 * n)), schema).repartition(n, "deal").mapInArrow(lean(_shared_keys), schema))
    sets = dealt.filter("size IS NOT NULL")
    # One row a node, named by its least row, and partitioned by it, as all that follows joins by nodes.
    nodes = sets.filter("least IS NOT NULL").groupBy("signature").agg(F.min(F.struct("least", "row")).alias("m"), *[F.first(c).alias(c) for c in ("size", *bits)]).select("signature", F.col("m.row").alias("node"), F.col("m.least").alias("least"), "size", *bits)
    nodes = checkpointed(nodes.repartition(n, "node"), partitioned=True)
    shared = dealt.filter("size IS NULL").select(F.col("deal").alias("key"), "signature", F.col("f0").cast("short").alias("place")).join(nodes.select("signature", "node"), "signature").select("key", "node", "place")
    shared = checkpointed(shared.repartition(n, "node"), partitioned=True)
    tidied(spark)
    many = crowds(shared)
    texts = rows.select("node", "text")

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = checkpointed(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(TEXTS)}):
            out = checkpointed(verified(pairs, texts, words, similarity))
        tidied(spark)
        return out

    def placed(some: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Rows with what comparisons need, dealt by hash."""
        known = some.join(nodes.select("node", "size", *bits), "node").join(many.select("node", "crowd"), "node", "left")
        known = known.withColumn("root", F.col("node")) if roots is None else known.join(roots, "node", "left")
        return known.select("key", "node", "place", "size", *bits, F.coalesce("root", "node").alias("part"), F.coalesce("crowd", F.lit(NO_CROWD)).alias("crowd")).repartition(n, "key")

    single = nodes.select("node", "f0")
    near = link_fingerprints(single, search_plans(single, 1, RADIUS), RADIUS)
    first = shared.groupBy("node").agg(*[F.min_by("key", F.xxhash64("key", F.lit(t))).alias(f"k{t}") for t in range(TURNS)])
    first = first.select("node", F.explode(F.array_distinct(F.array(*[f"k{t}" for t in range(TURNS)]))).alias("key"), F.lit(0).cast("short").alias("place"))

    def toward(some: DataFrame, roots: DataFrame | None, most: int) -> DataFrame:
        """For each node the nearest pivot of another part that it meets, and the least: two pairs a node at most."""
        met = placed(some, roots).mapInArrow(lean(_toward_pivots(halves, similarity, most)), "node long, d long, near long")
        met = met.groupBy("node").agg(F.min_by("near", F.struct("d", "near")).alias("near"), F.min("near").alias("least"))
        return met.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("near", "least"))).alias("b"))

    good = checked(near.unionByName(toward(first, None, distance // 2)))
    roots = components(good)
    for _ in range(ROUNDS):  # joins most parts of a group, whose members would else all meet one by one below
        good = good.unionByName(checked(toward(shared, roots, distance - 10)))
        roots = components(good)
    alike = components(placed(shared, roots).mapInArrow(lean(_apart(halves, similarity, distance)), "a long, b long"))
    groups = many.select("node", F.lit(1).alias("kind"), F.col("crowd").alias("grp")).unionByName(alike.select("node", F.lit(0).alias("kind"), F.col("root").alias("grp")))
    groups = checkpointed(groups.join(nodes.select("node", "size", *bits), "node").join(roots, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root"))
    sizes = groups.groupBy("kind", "grp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    cells = groups.join(sizes, ["kind", "grp"]).join(texts_of(groups, texts).dropDuplicates(["node"]), "node").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    inside = cells.select("kind", "grp", "low", "high", "block", "node", "part", "size", *bits, "text").groupBy("kind", "grp", "low", "high").applyInArrow(_cell(words, halves, similarity, distance), "a long, b long")
    roots = components(good.unionByName(inside))
    linked = nodes.select("signature", "node", "least").join(roots, "node")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("signature", "component_id")
    of = nodes.select("signature", "least").join(named, "signature", "left").select("signature", F.coalesce("component_id", "least").alias("component_id"))
    return sets.select("signature", F.explode("ids").alias("doc_id")).join(of, "signature", "left").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each group of similar
    texts those with the smallest id. Rows with a null id stay. Rows that share an
    id stay if one of their texts has the smallest id of its group. Null and
    empty texts are one group; an empty table gives an empty one."""
    groups, mark = similar_groups(docs, id_col, text_col, words, similarity), unused("kept_id", docs)
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(mark)).distinct()
    stay = docs.join(kept, F.col(f"`{id_col}`").cast("long") == F.col(mark), "left_semi")
    return stay.unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
