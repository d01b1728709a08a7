"""Language-model scoring by a hierarchical Pitman-Yor model.

A word's restaurant is chosen by the word before it. Every word that the
training texts hold has a restaurant, so the model grows with the corpus; all
share the unigram restaurant as parent, whose base is uniform. Customers are
seated by Gibbs sampling from the counts of the whole training corpus, and the
predictive probabilities of several seatings are averaged.

Texts are cut into blocks of about BLOCK_TOKENS tokens. A block asks once for each
distinct pair of neighbouring words; pairs are dealt by context to buckets of
bounded size, whatever the corpus. A bucket starts with one table for each pair
of words, which is a customer of the parent, and tells the parent's buckets,
dealt by word. These seat their customers and answer with what gives the word's
probability; under it the context buckets sample their own seatings and tell the
tables that came out, which are the parent's customers from then on. It seats
these anew, and the context buckets sample under that and answer each block with
log probabilities, which the block adds up by text. So levels alternate twice. Contexts that a sample shows to be frequent are spread
over all buckets by word; a part takes its share of the context's tables for
constant while it samples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fold, partitions, table

DISCOUNT, STRENGTH = 0.75, 20.0
TOP_DISCOUNT, TOP_STRENGTH = 0.5, 100.0
BURN_IN, SAMPLES = 3, 4
SEED = 11
END = np.uint64(0xE4D0F7E47C0FFEE1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Longest stretch hashed at once, so that tables of powers stay small.
BLOCK = 1 << 20
#: Tokens of a block; bytes of text for each bucket of contexts, and for each of words, of
#: which there are HOMES at least. Fewer of these, so that a bucket's message to each stays worth a row.
BLOCK_TOKENS, BUCKET_BYTES, HOME_BYTES, HOMES = 1 << 20, 8 << 20, 32 << 20, 16
#: One of so many texts tells which words are frequent: the DICTIONARY most frequent are
#: sent as short codes, and contexts above one of SPREAD tokens are spread. Both only deal data out.
ONE_OF, DICTIONARY, SPREAD = 64, 65_535, 1000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


UP, DOWN = _powers(BASE, BLOCK), _powers(BASE_INVERSE, BLOCK)


def tokens(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words in lower case, then of the end token. A word's
    hash is polynomial, taken from running sums, so no word becomes an object."""
    data = np.frombuffer(text.lower(), np.uint8)
    out, at = [], 0
    while at < len(data):
        part = data[at : at + BLOCK]
        if len(part) == BLOCK and at + BLOCK < len(data):
            gap = np.flatnonzero(SPACE[part])
            if not len(gap):  # one word over a whole block: hashed by itself
                stop = np.flatnonzero(SPACE[data[at:]])
                end = at + (int(stop[0]) if len(stop) else len(data) - at)
                h = 0
                for s in range(at, end, BLOCK):
                    piece = data[s : min(s + BLOCK, end)]
                    h = (h * 31 + int(((piece.astype(np.uint64) + np.uint64(1)) * UP[: len(piece)]).sum())) & (1 << 64) - 1
                out.append(np.array([h], np.uint64))
                at = end
                continue
            part = part[: gap[-1] + 1]
        word = ~SPACE[part]
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * UP[: len(part)])])
        out.append((sums[stop] - sums[start]) * DOWN[start])
        at += len(part)
    h = np.concatenate([*out, np.zeros(0, np.uint64)]).astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x81DADEF4BC2DD44D)
    return np.append(h ^ (h >> np.uint64(32)), END)


def _packed(x: np.ndarray) -> bytes:
    """Integers by byte, compressed: small numbers shrink to little."""
    raw = np.ascontiguousarray(x.astype(np.int64)).view(np.uint8).reshape(-1, 8)
    return pa.compress(np.ascontiguousarray(raw.T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: pa.Buffer, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(np.int64).ravel()


def _longs(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), np.uint64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from those before them."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    return np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


class Words:
    """Frequent words of a sample, by hash: those with codes, and those whose restaurants are spread."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int):
        order = np.argsort(words)
        self.coded = words[order]
        self.spread = self.coded[counts[order] * SPREAD >= max(total, 1)]

    @staticmethod
    def _place(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(known):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return at, known[at] == h

    def is_spread(self, h: np.ndarray) -> np.ndarray:
        return self._place(self.spread, h)[1]

    def encode(self, h: np.ndarray) -> tuple[bytes, bytes]:
        at, known = self._place(self.coded, h)
        return pa.compress(np.where(known, at, DICTIONARY).astype(np.uint16).tobytes(), codec="zstd", asbytes=True), h[~known].tobytes()

    def decode(self, codes: pa.Buffer, rest: np.ndarray, n: int) -> np.ndarray:
        c = np.frombuffer(pa.decompress(codes, 2 * n, codec="zstd"), np.uint16)
        out = np.zeros(n, np.uint64)
        known = c != DICTIONARY
        out[known] = self.coded[c[known]] if len(self.coded) else 0
        out[~known] = rest
        return out


def frequent_words(rows: DataFrame) -> Words:
    """Fitted on one of ONE_OF texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [tokens(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(0)]
            if h:
                h, n = np.unique(np.concatenate(h), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

    some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(ONE_OF)) == 0).select("text")
    counted = checkpointed(some.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # Counts of counts tell above which count no more than DICTIONARY words lie.
    total, above, least = 0, 0, 1 << 62
    for n, many in sorted(((r["n"], r["count"]) for r in counted.groupBy("n").count().collect()), reverse=True):
        above, total = above + many, total + n * many
        least = n if above <= DICTIONARY else least
    top = counted.filter(F.col("n") >= least).toPandas()
    return Words(top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), total)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, ids, flags, numbers of tokens, and each token with the one before it; a text
    follows an end token. The same rows in the same order make the same blocks."""
    part, number = TaskContext.get().partitionId(), 0
    ids, flags, texts, held = [], [], [], 0

    def block():
        size = np.array([len(t) for t in texts])
        now = np.concatenate(texts)
        before = np.concatenate([[END], now[:-1]])  # a text's last token is the end
        return (part << 32) + number, list(ids), np.array(flags, bool), size, before, now

    for batch in batches:
        for doc, text, flag in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            ids.append(doc)
            flags.append(flag)
            texts.append(tokens(text.as_buffer().to_pybytes() if text.is_valid else b""))
            held += len(texts[-1])
            if held >= BLOCK_TOKENS:
                yield block()
                number += 1
                ids, flags, texts, held = [], [], [], 0
    if texts:
        yield block()


def _pairs(words: Words, buckets: int, before: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bucket, context and word of a block's distinct pairs, in order; the order of its
    tokens by pair, and where pairs begin in it."""
    mixed = np.where(words.is_spread(before), (before * np.uint64(31)) ^ (now >> np.uint64(7)), before)
    bucket = (mixed % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((now, before, bucket))
    b, u, w = bucket[order], before[order], now[order]
    new = _runs(b, u, w)
    return b[new], u[new], w[new], order, np.flatnonzero(new)


def _asked(shared, buckets: int):
    """Blobs of a block's distinct pairs by bucket, with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, flags, size, before, now in _blocks(batches):
            b, u, w, order, start = _pairs(shared.value, buckets, before, now)
            count = np.add.reduceat(np.repeat(flags, size)[order].astype(np.int64), start)
            cut = np.flatnonzero(_runs(b))
            rows = []
            for s, e in zip(cut.tolist(), np.append(cut[1:], len(b)).tolist()):
                head = np.flatnonzero(_runs(u[s:e]))
                codes, rest = shared.value.encode(w[s:e])
                rows.append((int(b[s]), e - s, u[s:e][head].tobytes(), _packed(np.diff(np.append(head, e - s))), codes, rest, _packed(count[s:e])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(2, 7)]], names=["bucket", "block", "n", "contexts", "runs", "codes", "rest", "counts"])

    return run


def _bucket(words: Words, group: pa.Table) -> tuple[np.ndarray, ...]:
    """Of a bucket's blobs: pairs in order (context, word, count), each row's pair, and blobs' sizes."""
    us, ws, cs, many = [], [], [], group["n"].to_pylist()
    for n, contexts, runs, codes, rest, counts in zip(many, *(group[c] for c in ("contexts", "runs", "codes", "rest", "counts"))):
        u = _longs(contexts)
        us.append(np.repeat(u, _unpacked(runs.as_buffer(), len(u))))
        ws.append(words.decode(codes.as_buffer(), _longs(rest), n))
        cs.append(_unpacked(counts.as_buffer(), n))
    u, w, c = (np.concatenate(x) for x in (us, ws, cs))
    order = np.lexsort((w, u))
    new = _runs(u[order], w[order])
    at = np.flatnonzero(new)
    pair = np.empty(len(u), np.int64)
    pair[order] = np.cumsum(new) - 1
    return u[order][at], w[order][at], np.add.reduceat(c[order], at), pair, np.array(many)


def _by_home(h: np.ndarray, homes: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Distinct hashes by the bucket of words that is theirs, and each one's bounds among them."""
    h = np.unique(h)
    home = (h % np.uint64(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    at = np.flatnonzero(_runs(home[order]))
    return h[order], list(zip(home[order][at].tolist(), at.tolist(), np.append(at[1:], len(h)).tolist()))


def _place(h: np.ndarray, among: np.ndarray) -> np.ndarray:
    order = np.argsort(among)
    return order[np.searchsorted(among[order], h)]


def _told(shared, n_homes: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        """To the words' buckets, before anything is sampled: a word's customers (a table for
        each of its contexts) and count here; of a spread context its tables and count here."""
        u, w, c, _, _ = _bucket(shared.value, group)
        names, homes = _by_home(w, n_homes)
        at = _place(w, names)
        customers = np.bincount(at, weights=c > 0, minlength=len(names))
        count = np.bincount(at, weights=c, minlength=len(names))
        rows = [(i, 0, e - s, names[s:e].tobytes(), _packed(customers[s:e]), _packed(count[s:e])) for i, s, e in homes]
        some = shared.value.is_spread(u)
        if some.any():
            names, homes = _by_home(u[some], n_homes)
            at = _place(u[some], names)
            tables = np.bincount(at, weights=c[some] > 0, minlength=len(names))
            count = np.bincount(at, weights=c[some], minlength=len(names))
            rows += [(i, 1, e - s, names[s:e].tobytes(), _packed(tables[s:e]), _packed(count[s:e])) for i, s, e in homes]
        cols = list(zip(*rows))
        own = [key[0].as_py()] * len(rows)
        return pa.table({"home": pa.array(cols[0], pa.int32()), "bucket": pa.array(own, pa.int32()), "kind": pa.array(cols[1], pa.int32()), "n": pa.array(cols[2], pa.int64())} | {c: pa.array(cols[i], pa.binary()) for i, c in ((3, "names"), (4, "tables"), (5, "counts"))})

    return run


TOLD = "home int, bucket int, kind int, n long, names binary, tables binary, counts binary"


def seat(c: np.ndarray, t: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float, s: float, rng) -> np.ndarray:
    """Reseat the customers `c` of each dish, one after another in law: the k-th opens a
    table with probability proportional to (s + d T) parent, or joins with k - d t,
    where T counts the restaurant's tables, `others` those of other dishes. For large
    counts the number of tables opened between two doublings of k is drawn at once."""
    new = np.minimum(c, 1).astype(np.float64)
    live = np.flatnonzero(c > 1)
    k = np.ones(len(live))
    while len(live):
        step = np.minimum(np.maximum(k // 4, 1), c[live] - k)
        opens = (s + d * (others[live] + new[live])) * parent[live]
        p = opens / (opens + np.maximum(k - d * new[live], 1e-12))
        new[live] += rng.binomial(step.astype(np.int64), np.clip(p, 0, 1))
        k += step
        more = k < c[live]
        live, k = live[more], k[more]
    return new


def _parent(homes: int):
    """Under the tables that buckets start with."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return seated(key, group, None)

    seated = _reseated(homes)
    return run


def _reseated(homes: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table, sampled: pa.Table | None) -> pa.Table:
        """Seats the parent's customers under a bucket's words, those of `sampled` too, and
        answers each context bucket: customers less discounted tables, averaged, and counts;
        of spread contexts all tables and counts. One more row has the bucket's totals."""
        order = np.lexsort((group["bucket"].to_numpy(), group["kind"].to_numpy()))
        group = group.take(order)
        kind, many = group["kind"].to_numpy(), group["n"].to_pylist()
        names = [_longs(x) for x in group["names"]]
        tables = [_unpacked(x.as_buffer(), n) for x, n in zip(group["tables"], many)]
        counts = [_unpacked(x.as_buffer(), n) for x, n in zip(group["counts"], many)]
        if sampled is not None:
            at = {b: i for i, (b, k) in enumerate(zip(group["bucket"].to_pylist(), kind.tolist())) if k == 0}
            for b, x in zip(sampled["bucket"].to_pylist(), sampled["more"]):
                tables[at[b]] = tables[at[b]] + _unpacked(x.as_buffer(), many[at[b]])
        rng = np.random.default_rng(SEED + key[0].as_py())
        first, second, totals = [b""] * len(many), [b""] * len(many), (0.0, 0.0, 0, 0)
        for which in (0, 1):
            own = np.flatnonzero(kind == which).tolist()
            if not own:
                continue
            every, at = np.unique(np.concatenate([names[i] for i in own]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([tables[i] for i in own]), minlength=len(every))
            c = np.bincount(at, weights=np.concatenate([counts[i] for i in own]), minlength=len(every)).astype(np.int64)
            if which == 0:
                types = int((c > 0).sum())
                # The other buckets' words are dealt by hash, so they have as many tables each.
                base, t, mean = 1 / (types * homes + 1), np.minimum(n, 1.0), np.zeros(len(n))
                for sweep in range(BURN_IN + SAMPLES):
                    t = seat(n, t, t.sum() * homes - t, np.full(len(n), base), TOP_DISCOUNT, TOP_STRENGTH, rng)
                    mean += t / SAMPLES * (sweep >= BURN_IN)
                n, totals = n - TOP_DISCOUNT * mean, (float(n.sum()), float(mean.sum()), int(c.sum()), types)
            done = 0
            for i in own:
                mine = at[done : done + many[i]]
                done += many[i]
                first[i], second[i] = (n[mine].astype(np.float32).tobytes() if which == 0 else _packed(n[mine])), _packed(c[mine])
        cols = {"bucket": [*group["bucket"].to_pylist(), None], "home": [key[0].as_py()] * (len(many) + 1), "kind": [*kind.tolist(), -1], "n": [*many, 0]}
        kinds = {"n": pa.int64()}
        out = {c: pa.array(v, kinds.get(c, pa.int32())) for c, v in cols.items()}
        out |= {"mass": pa.array([*first, b""], pa.binary()), "counts": pa.array([*second, b""], pa.binary())}
        for c, v in zip(("customers", "tables", "tokens", "types"), totals):
            out[c] = pa.array([None] * len(many) + [v], pa.float64() if c in ("customers", "tables") else pa.int64())
        return pa.table(out)

    return run


PARENT = "bucket int, home int, kind int, n long, mass binary, counts binary, customers double, tables double, tokens long, types long"


def seatings(u: np.ndarray, c: np.ndarray, parent: np.ndarray, spread: dict[int, tuple[float, float]], rng) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sweep by sweep the tables of pairs ordered by context `u`, seen `c` times, under the
    parent's probabilities, with all tables and customers of each pair's context. `spread`
    has all starting tables and the count of contexts that other buckets hold parts of."""
    rest = np.cumsum(_runs(u)) - 1
    size = np.bincount(rest, weights=c)
    heads = u[_runs(u)]
    t = np.minimum(c, 1).astype(np.float64)
    elsewhere = np.ones(len(heads))
    own = np.bincount(rest, weights=t)
    if spread:
        for i in np.flatnonzero(np.isin(heads, np.array(list(spread), np.uint64))).tolist():
            tables, size[i] = spread[int(heads[i])]
            elsewhere[i] = tables / max(own[i], 1)
    trained = np.flatnonzero(c > 0)
    total = np.bincount(rest, weights=t) * elsewhere
    while True:
        t[trained] = seat(c[trained], t[trained], (total[rest] - t)[trained], parent[trained], DISCOUNT, STRENGTH, rng)
        total = np.bincount(rest, weights=t) * elsewhere
        yield t, total[rest], size[rest]


def predictive(u: np.ndarray, c: np.ndarray, parent: np.ndarray, spread: dict[int, tuple[float, float]], rng) -> np.ndarray:
    """Probabilities of pairs, averaged over seatings()."""
    out = np.zeros(len(u))
    for sweep, (t, total, size) in zip(range(BURN_IN + SAMPLES), seatings(u, c, parent, spread, rng)):
        if sweep >= BURN_IN:
            out += (np.maximum(c - DISCOUNT * t, 0) + (STRENGTH + DISCOUNT * total) * parent) / (STRENGTH + size) / SAMPLES
    return out


def _under(words: Words, n_homes: int, u: np.ndarray, w: np.ndarray, replies: pa.Table) -> tuple:
    """What the parent answered: words' hashes by home and each home's bounds, each pair's
    word among them, words' counts, pairs' probabilities, and spread contexts."""
    names, homes = _by_home(w, n_homes)
    mass, count, spread = np.zeros(len(names)), np.zeros(len(names), np.int64), {}
    bounds = {i: (s, e) for i, s, e in homes}
    heads, parts = _by_home(u[words.is_spread(u)], n_homes)
    head_bounds = {i: (s, e) for i, s, e in parts}
    for home, kind, n, x, y in zip(*(replies[c].to_pylist() for c in ("home", "kind", "n")), replies["mass"], replies["counts"]):
        s, e = (bounds if kind == 0 else head_bounds)[home]
        if kind == 0:
            mass[s:e] = np.frombuffer(x.as_buffer(), np.float32)
            count[s:e] = _unpacked(y.as_buffer(), n)
        else:
            spread |= zip(heads[s:e].tolist(), zip(_unpacked(x.as_buffer(), n).tolist(), _unpacked(y.as_buffer(), n).tolist()))
    customers, tables, types = (replies[f"all_{c}"][0].as_py() for c in ("customers", "tables", "types"))
    parent = (mass + (TOP_STRENGTH + TOP_DISCOUNT * tables) / (types + 1)) / (TOP_STRENGTH + customers)
    at = _place(w, names)
    return names, homes, at, count, parent[at], spread


def _sampled(shared, n_homes: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table, replies: pa.Table) -> pa.Table:
        """To the words' buckets: tables that a word has here beyond those told before,
        after BURN_IN sweeps under the parent."""
        u, w, c, _, _ = _bucket(shared.value, group)
        names, homes, at, _, parent, spread = _under(shared.value, n_homes, u, w, replies)
        rng = np.random.default_rng([SEED, key[0].as_py()])
        for _, (t, _, _) in zip(range(BURN_IN), seatings(u, c, parent, spread, rng)):
            pass
        more = np.rint(np.bincount(at, weights=t - (c > 0), minlength=len(names)))
        return pa.table({"home": pa.array([i for i, _, _ in homes], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(homes), pa.int32()), "more": pa.array([_packed(more[s:e]) for _, s, e in homes], pa.binary())})

    return run


def _answered(shared, n_homes: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table, replies: pa.Table) -> pa.Table:
        """To the blocks: log10 probabilities of their pairs and counts of the pairs' words."""
        u, w, c, pair, many = _bucket(shared.value, group)
        _, _, at, count, parent, spread = _under(shared.value, n_homes, u, w, replies)
        tokens_, types = (replies[f"all_{c}"][0].as_py() for c in ("tokens", "types"))
        logs = np.log10(predictive(u, c, parent, spread, np.random.default_rng(SEED + key[0].as_py()))).astype(np.float32)
        count = count[at]
        ends = np.cumsum(many)
        return pa.table(
            {
                "block": group["block"],
                "bucket": group["bucket"],
                "n": group["n"],
                "logs": pa.array([logs[pair[e - n : e]].tobytes() for e, n in zip(ends, many)], pa.binary()),
                "counts": pa.array([_packed(count[pair[e - n : e]]) for e, n in zip(ends, many)], pa.binary()),
                "tokens": pa.array([tokens_] * len(many), pa.int64()),
                "types": pa.array([types] * len(many), pa.int64()),
            }
        )

    return run


def _streams(shared, buckets: int):
    """A block's ids, flags, sizes, and the number of each token's pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, flags, size, before, now in _blocks(batches):
            _, _, _, order, start = _pairs(shared.value, buckets, before, now)
            place = np.empty(len(now), np.int64)
            place[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(now))))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([flags.tolist()], pa.list_(pa.bool_())), pa.array([size.tolist()], pa.list_(pa.int64())), pa.array([len(start)], pa.int64()), pa.array([_packed(place)], pa.binary())], names=["block", "ids", "flags", "sizes", "pairs", "places"])

    return run


def _added(key: tuple[pa.Scalar, ...], stream: pa.Table, replies: pa.Table) -> pa.Table:
    """Scores of a block's texts."""
    replies = replies.take(np.argsort(replies["bucket"].to_numpy()))
    logs = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in replies["logs"]]).astype(np.float64)
    count = np.concatenate([_unpacked(x.as_buffer(), n) for x, n in zip(replies["counts"], replies["n"].to_pylist())])
    if len(stream) != 1 or len(logs) != stream["pairs"][0].as_py():
        raise ValueError("the table gave other rows, or in another order, when it was read again; write it out first")
    size = stream["sizes"].combine_chunks().flatten().to_numpy()
    place = _unpacked(stream["places"][0].as_buffer(), int(size.sum()))
    starts = np.cumsum(size) - size
    count = count[place]
    tokens_, types = replies["tokens"][0].as_py(), replies["types"][0].as_py()
    sums = [np.add.reduceat(x, starts) for x in (logs[place], np.log10(count + 0.5), (count > 0).astype(np.int64))]
    return pa.table({"doc_id": stream["ids"].combine_chunks().flatten(), "held_out": pc.invert(stream["flags"].combine_chunks().flatten()), "n_tokens": size, "n_known": sums[2], "train_tokens": np.full(len(size), tokens_), "base_score": sums[1] - size * math.log10(tokens_ + 0.5 * (types + 1)), "score": sums[0]})


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of `docs`.

    Learns from the rows where the Boolean column `held_out` is false and scores
    every row. A null or empty text is its end token alone. Rows that share an
    id, or have none, have a row each. Without training rows the scores are those
    of the uniform base; an empty table gives an empty result. Extra columns are
    ignored. `docs` is read twice and must give its rows in the same order, as a
    stored table does; otherwise an error is raised.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(~held_out, F.lit(False)).alias("train"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, homes = max(partitions(spark), -(-total // BUCKET_BYTES)), max(HOMES, -(-total // HOME_BYTES))
    shared = spark.sparkContext.broadcast(frequent_words(rows))
    asked = rows.mapInArrow(_asked(shared, buckets), "bucket int, block long, n long, contexts binary, runs binary, codes binary, rest binary, counts binary").repartition(partitions(spark), "bucket")
    told = asked.groupBy("bucket").applyInArrow(_told(shared, homes), TOLD)

    def replies(parent: DataFrame) -> DataFrame:
        sums = [F.sum(c).alias(f"all_{c}") for c in ("customers", "tables", "tokens", "types")]
        return parent.filter("bucket IS NOT NULL").select("bucket", "home", "kind", "n", "mass", "counts").crossJoin(F.broadcast(parent.agg(*sums)))

    first = replies(told.groupBy("home").applyInArrow(_parent(homes), PARENT))
    sampled = asked.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(_sampled(shared, homes), "home int, bucket int, more binary")
    parent = told.groupBy("home").cogroup(sampled.groupBy("home")).applyInArrow(_reseated(homes), PARENT)
    answers = asked.groupBy("bucket").cogroup(replies(parent).groupBy("bucket")).applyInArrow(_answered(shared, homes), "block long, bucket int, n long, logs binary, counts binary, tokens long, types long")
    streams = rows.mapInArrow(_streams(shared, buckets), "block long, ids array<long>, flags array<boolean>, sizes array<long>, pairs long, places binary")
    return streams.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_added, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), fold("doc_id", 5) == 1)
