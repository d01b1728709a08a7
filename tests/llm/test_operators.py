import hashlib
import math
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelscope.llm import ann, byte_bpe, chat_format, components, exact_dedup, hpylm, langid, mixing, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, h int, n int, sha string"
LONG = "ab cd " * 30_000
ROWS = [
    (1, "Hello there general reader of this small text", "en", "a", 1, 1, "x"),
    (2, "hello there general reader of this small text", "en", "a", 1, 1, "x"),
    (3, "", "en", None, 1, 1, "x"),
    (4, None, None, "b", 1, 1, "x"),
    (5, LONG, "de", "b", 1, 1, "x"),
    (6, LONG, "de", "b", 1, 1, "x"),
    (6, LONG, "de", "b", 1, 1, "x"),
    (None, "ein Text mit Wörtern, aber ohne Nummer", "de", None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda text: str(len(text) % 2)])
def test_exact_dedup(docs, digest):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.copy_groups(docs, digest=digest).collect()}
    assert got == {(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 6, 3, False), (6, 6, 3, True), (None, None, 1, True)}
    assert sorted(str(r["doc_id"]) for r in exact_dedup.deduplicate(docs).collect()) == ["2", "4", "6", "None"]


def test_mixing(docs):
    assert mixing.targets({"a": 10, "b": 10, None: 100}) == pytest.approx({"a": 20.0, "b": 20.0, None: 140.0})
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sum(r["times"] for r in rows) == mixing.apply_mix(docs).count()


def test_byte_bpe(docs):
    data = {r["doc_id"]: r for r in byte_bpe.round_trip(docs).collect()}
    assert data[4]["n_tokens"] == 0 and data[5]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    decoded = byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).collect()
    assert sorted(bytes(r["data"]) for r in decoded) == sorted((r[1] or "").encode() for r in ROWS)
    import public_tokenizers as public

    enc = byte_bpe.make_encoder(byte_bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)
    text = "It's  12 o'clock\n\n  and don't — été! " * 40
    assert byte_bpe.encode(enc, text, 7) == enc.encode_ordinary(text)


def test_byte_bpe_cuts_at_the_white_space_of_the_pattern():
    import base64

    import public_tokenizers as public

    ranks = [bytes([i]) for i in range(256)] + [b"!\x1c"]
    enc = byte_bpe.make_encoder(b"\n".join(base64.b64encode(r) + b" %d" % i for i, r in enumerate(ranks)), public.PATTERN)
    for text in ("!\x1c", "a!\x1c b", "!\x1c!\x1c \x1c!\x85!\xa0x"):
        assert byte_bpe.encode(enc, text, 1) == enc.encode_ordinary(text)


@pytest.mark.parametrize("distance", [4, 9])
def test_simhash_links_equal_brute_force(spark, distance):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(62, k, replace=False)) for b in base for k in (2, 4, 6, 9)]
    fps = sorted({*base.tolist(), *near})
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "node long, f0 long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.link_fingerprints(nodes, simhash.search_plans(nodes, 1, distance), distance)).collect()}
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance and find(i) != find(j):
                up[max(find(i), find(j))] = min(find(i), find(j))
    assert all(roots.get(i, i) == find(i) for i in range(len(fps)))


def test_dense_runs_link_like_brute_force(monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 3)
    rng = np.random.default_rng(5)
    fp = (rng.integers(0, 2**10, (60, 1)) * 3).astype(np.uint64)
    forest = simhash._Forest(60)
    simhash._link_run(forest, np.arange(60), np.arange(60), np.arange(60), fp, 2)
    close = {(i, j) for i in range(60) for j in range(60) if bin(int(fp[i, 0] ^ fp[j, 0])).count("1") <= 2}
    plain = simhash._Forest(60)
    for i, j in close:
        plain.link(i, j)
    assert [forest.find(i) for i in range(60)] == [plain.find(i) for i in range(60)]


def test_near_duplicates_of_odd_rows(docs):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got[2] == 1 and got[4] == 3 and got[6] == 5


@pytest.mark.parametrize(("crowd", "block"), [(1024, 512), (3, 2)])
def test_similar_groups_equal_brute_force(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(11)
    texts = ["", "  ", "one two", "one  TWO", "x " * 40, "x " * 41 + "y"]
    for _ in range(30):
        words = rng.integers(0, 500, int(rng.integers(60, 400))).tolist()
        texts.append(" ".join(f"w{w}" for w in words))
        for edits in (1, 2, 4, 6, 10):
            new = [*words]
            for at in rng.integers(0, len(new), edits):
                new[at] = int(rng.integers(500, 900))
            texts.append(" ".join(f"w{w}" for w in new))
    sets = [{*simhash.shingles(t.encode(), 5)} for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                up[max(find(i), find(j))] = min(find(i), find(j))
    rows = spark.createDataFrame([*enumerate(texts), (None, "one two")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(rows).collect()}
    assert got.pop(None) == 2
    assert got == {i: find(i) for i in range(len(texts))}
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(rows).collect()}
    assert kept == {find(i) for i in range(len(texts))} | {None}
    assert simhash.similar_groups(rows.limit(0)).count() == 0


def test_pairs_told_grow_with_a_group_not_its_square():
    n = 200
    fp = pa.array(np.zeros(n, np.int64))
    node = pa.array(np.arange(n))
    rows = {"key": np.ones(n, np.int64), "node": node, "place": np.zeros(n, np.int16), "size": np.full(n, 100), "f0": fp, "f1": fp, "f2": fp, "part": node, "crowd": np.zeros(n, np.int64)}
    told = [p for b in simhash._apart(3, 0.8, 64)(iter(pa.table(rows).to_batches())) for p in zip(b["a"].to_pylist(), b["b"].to_pylist())]
    assert len(told) == n - 1 and {x for p in told for x in p} == {*range(n)}


@pytest.mark.parametrize("direct", [0, 20, 1 << 16])
def test_components_on_the_driver_equal_those_by_joins(spark, monkeypatch, direct):
    monkeypatch.setattr(components, "DIRECT", direct)
    links = [(i, i + 1) for i in range(40, 9, -1)] + [(50, 7), (7, 60), (60, 50), (3, 3), (None, 1)]
    got = {(r["node"], r["root"]) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 10) for i in range(10, 42)} | {(7, 7), (50, 7), (60, 7)}


def test_similar_pairs_are_found_near_the_threshold(spark, monkeypatch):
    plan = simhash.plan_search  # a search by bits, if any, is planned as for a large table
    monkeypatch.setattr(simhash, "plan_search", lambda sample, n, distance: plan(sample, 12_000_000, distance))
    rng = np.random.default_rng(21)
    texts, close = [], []
    while len(close) < 200:
        words = [f"w{w}" for w in rng.integers(0, 10**6, 300)]
        new = [*words]
        for at in rng.choice(300, 6 + len(close) % 2, replace=False):
            new[at] = "x" + new[at]
        one, two = ({*simhash.shingles(" ".join(t).encode(), 5)} for t in (words, new))
        if 0.8 <= len(one & two) / len(one | two) < 0.82:
            close.append(len(texts))
            texts += [" ".join(words), " ".join(new)]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(rows).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_chat_layouts_and_round_trip(spark):
    rows = [(1, "a", "b", None, None), (2, None, None, "do", "done"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, prompt string, response string, instruction string, output string")
    turns = chat_format.canonical_turns(df)
    assert sorted((r["conv_id"], r["role"] or "", r["text"] or "", r["layout"] or "") for r in turns.collect()) == [(1, "assistant", "b", "prompt"), (1, "user", "a", "prompt"), (2, "assistant", "done", "instruction"), (2, "user", "do", "instruction"), (3, "", "", "")]
    odd = [(1, 0, "us\ner", "a<|im_end|>\\<|\\|x"), (1, 1, "assistant", None), (1, 1, None, "<\\|"), (None, None, "assistant", "é<|")]
    own = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    done = chat_format.format_turns(chat_format.canonical_turns(own))
    got = {r["conv_id"]: r for r in done.select("conv_id", chat_format.read_turns(done["formatted"]).alias("t"), chat_format.loss_texts(done["formatted"], done["loss_spans"]).alias("l")).collect()}
    assert [tuple(t) for t in got[1]["t"]] == [("us\ner", "a<|im_end|>\\<|\\|x"), ("", "<\\|"), ("assistant", "")]
    assert got[1]["l"] == [""] and got[None]["l"] == ["é<|"]


def windows_removed(rows, length):
    first, out = {}, {}
    for i, text in sorted(rows):
        for p in range(len(text) - length + 1):
            first.setdefault(text[p : p + length], i)
    for i, text in rows:
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - length + 1):
            if first[text[p : p + length]] < i:
                gone[p : p + length] = True
        out[i] = bytes(np.frombuffer(text, np.uint8)[~gone])
    return out


@pytest.mark.parametrize("alphabet", [2, 26])
def test_suffix_dedup_equals_brute_force(spark, alphabet):
    rng = np.random.default_rng(alphabet)
    passage = ["".join(chr(97 + c) for c in rng.integers(0, alphabet, 130)) for _ in range(4)]
    rows = [(i, passage[i % 4][rng.integers(0, 40) :] + "".join(chr(97 + c) for c in rng.integers(0, alphabet, 90)) + passage[(i + 1) % 4] + "\0" * (i % 3)) for i in range(24)]
    rows += [(90, ""), (91, "aaaa" * 60), (92, "aaaa" * 50)]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (99, None)], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(df).collect()}
    want = windows_removed([(i, t.encode()) for i, t in rows], 50)
    assert got[99] == b"" and got[None] == rows[0][1].encode()
    assert {i: got[i] for i in want} == want


def test_shards_are_merged_by_binary_search():
    rng = np.random.default_rng(1)
    parts = ["".join("ab"[c] for c in rng.integers(0, 2, 30)).encode() for _ in range(40)]
    size = np.full(40, 30)
    text, start, owner = np.frombuffer(b"".join(parts), np.uint8), np.arange(40) * 30, rng.permutation(40)
    one = suffix_dedup.least_owners(text, start, size, owner, 8)
    assert (suffix_dedup.least_owners(text, start, size, owner, 8, 100) == one).all()


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] * 8)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(base, base.filter("vec_id % 50 = 0 OR vec_id = 3")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q, ranks in got.items():
        s = u @ u[q]
        s[q] = -9
        assert [ranks[k] for k in range(1, 6)] == np.lexsort((np.arange(300), -np.round(s, 12)))[:5].tolist()
    assert got[3][1] == 7 and 900 not in got
    assert ann.nearest(base.limit(0), base.limit(0)).count() == 0


def test_language_backs_off_to_grams(docs, spark):
    model = langid.train(docs.filter("doc_id < 5 OR doc_id IS NULL"))  # the long rows would drown every German word
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    assert got[1][0] == "en" and got[None][0] == "de" and got[3] == ("und", 0.0) == got[4]
    assert model.score("generale") is not None and langid.identify(docs, langid.train(docs.limit(0))).first()["lang_pred"] == "und"


def test_toxicity_tolerates_gaps(spark):
    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words, 20)) + (" numbskull" if i % 5 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(1, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    for bad in ("you numbskull", "you numb-skull", "you nuumbsskull", "n u m b s k u l l"):
        assert model.probability(max(model.decide(sorted(toxicity.instances(bad))))) >= 0.5, bad
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(df, model).collect()}
    assert sum(got[i] != (i % 5 == 0) for i in range(400)) <= 2 and got[900] == got[901] == 0
    assert toxicity.train(df, labels.limit(0)).slope == 0.0


def test_language_model_is_a_distribution():
    rng = np.random.default_rng(3)
    words = 40
    customers = rng.integers(0, 5, words).astype(float)
    tables = np.minimum(customers, 1)
    parent = (customers - hpylm.TOP_DISCOUNT * tables + (hpylm.TOP_STRENGTH + hpylm.TOP_DISCOUNT * tables.sum()) / words) / (hpylm.TOP_STRENGTH + customers.sum())
    assert parent.sum() == pytest.approx(1)
    u = np.repeat(np.arange(6, dtype=np.uint64), words)
    c = rng.integers(0, 30, 6 * words) * rng.integers(0, 2, 6 * words)
    c[:words] = 0  # an unseen context has the parent's probabilities
    p = hpylm.predictive(u, c, np.tile(parent, 6), {}, rng).reshape(6, words)
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(p[0], parent)


@pytest.mark.parametrize("count", [2, 3, 4])
def test_seating_follows_the_restaurant_law(count):
    """Numbers of tables against all sequences of openings, by their probabilities."""
    d, s, others, parent = 0.75, 2.0, 3.0, 0.2
    states = {1: 1.0}
    for k in range(1, count):
        new: dict[int, float] = {}
        for t, p in states.items():
            opens = (s + d * (others + t)) * parent
            share = opens / (opens + k - d * t)
            new[t + 1] = new.get(t + 1, 0) + p * share
            new[t] = new.get(t, 0) + p * (1 - share)
        states = new
    n = 40_000
    got = hpylm.seat(np.full(n, count), np.ones(n), np.full(n, others), np.full(n, parent), d, s, np.random.default_rng(4))
    for t, p in states.items():
        assert (got == t).mean() == pytest.approx(p, abs=0.01)


def test_sampled_tables_are_the_parents_customers():
    """A pair seen often opens further tables, which the parent seats, and gains in it."""
    words, key = hpylm.Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0), (pa.scalar(0),)
    shared = SimpleNamespace(value=words)
    w = np.array([7, 9], np.uint64)
    codes, rest = words.encode(w)
    asked = pa.table({"n": [2], "contexts": [np.array([5], np.uint64).tobytes()], "runs": [hpylm._packed(np.array([2]))], "codes": [codes], "rest": [rest], "counts": [hpylm._packed(np.array([5000, 1]))], "bucket": [0], "block": [0]})
    told = hpylm._told(shared, 1)(key, asked)

    def replies(parent):
        for c in ("customers", "tables", "tokens", "types"):
            parent = parent.append_column(f"all_{c}", pa.array([parent[c][-1].as_py()] * len(parent)))
        return parent.slice(0, len(parent) - 1)

    first = hpylm._parent(1)(key, told)
    sampled = hpylm._sampled(shared, 1)(key, asked, replies(first))
    more = hpylm._unpacked(sampled["more"][0].as_buffer(), 2)
    assert more[0] > 10 and more[1] == 0
    second = hpylm._reseated(1)(key, told, sampled)
    before, after = (np.frombuffer(p["mass"][0].as_buffer(), np.float32) for p in (first, second))
    assert before[0] < 1 and after[0] > 5 and after[1] < 1
    assert second["tokens"][-1].as_py() == 5001 and second["types"][-1].as_py() == 2


@pytest.mark.parametrize(("block", "spread"), [(1 << 20, 1000), (40, 2)])
def test_language_model_scores_every_row(spark, monkeypatch, block, spread):
    monkeypatch.setattr(hpylm, "BLOCK_TOKENS", block)
    monkeypatch.setattr(hpylm, "ONE_OF", 1)
    monkeypatch.setattr(hpylm, "SPREAD", spread)
    rows = [(i, ("The cat sat on the mat " * (1 + i % 3)).strip() + f" w{i % 7}") for i in range(60)] + [(90, None), (91, ""), (5, "the dog sat"), (5, "the dog sat"), (None, "a cat"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit(1)).withColumn("ids", F.lit(2)).coalesce(2)
    got = hpylm.score_documents(df, hpylm.fold("doc_id", 5) == 1).collect()
    assert len(got) == len(rows)
    words = lambda t: (t or "").lower().split() + [None]
    fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5
    seen = Counter(w for i, t in rows if fold(i) != 1 for w in words(t))
    total = sum(seen.values())
    want = sorted((i is None, i or 0, fold(i) == 1, len(words(t)), sum(seen[w] > 0 for w in words(t)), round(sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (len(seen) + 1))) for w in words(t)), 6)) for i, t in rows)
    assert want == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got)
    assert {r["train_tokens"] for r in got} == {total}
    assert all(r["score"] > r["base_score"] for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
    assert hpylm.score_documents(df.limit(0), hpylm.fold("doc_id", 5) == 1).count() == 0
    big = b"x" * (hpylm.BLOCK + 5) + b" the cat"
    assert (hpylm.tokens(big)[1:] == hpylm.tokens(b"The  CAT")).all()


def test_columns_may_have_any_names(spark):
    names = ["_id", "_times", "_copy", "_kept_id", "_n", "_sha", "_h", "mix_id", "exact_n", "kept_id"]
    rows = [(i % 4, f"some words that text {i // 2} has and no other one", "a", *[f"{c}{i}" for c in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    for got in (mixing.apply_mix(docs), exact_dedup.deduplicate(docs), simhash.drop_near_duplicates(docs)):
        assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= set(rows)
    for stage in (mixing.apply_mix, exact_dedup.deduplicate, simhash.drop_near_duplicates):
        assert stage(docs.limit(0)).count() == 0


def test_toxicity_of_a_large_alphabet(spark):
    rng = np.random.default_rng(5)
    letters = [chr(0x4E00 + i) for i in range(1500)]
    words = ["".join(letters[k] for k in rng.integers(0, 1500, 5)) for _ in range(300)]
    rows = [(i, " ".join(words[k] for k in rng.integers(20, 300, 12)) + (" " + words[i % 20] if i % 3 == 0 else "")) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, model).collect()}
    assert sum(got[i] == (i % 3 == 0) for i in got) >= 220


def test_letters_are_of_category_l():
    assert langid.words("½ ² Ⅷ") == [] and langid.words("x²y Été") == ["x", "y", "été"]


def test_chat_rows_without_a_mapping_are_refused(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hello", "be kind")], "conv_id long, turn long, role string, text string, system string")
    with pytest.raises(Exception, match="no mapping"):
        chat_format.format_turns(chat_format.canonical_turns(rows)).collect()


def test_vectors_of_several_lengths(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(6)] + [(i, [1.0, float(i), 2.0]) for i in range(6, 10)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(base, base).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {i: 5 if i < 6 else 3 for i in range(10)}
