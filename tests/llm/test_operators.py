"""Each operator against brute force on a small table of awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from thicket.llm import bpe_codec, brown_lm, decontam, lines, media, near_copies, passages, quality, repeats, simhash, token_counts, urls


def table(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_token_counts(docs, empty, cases, tokenizers):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x in cases]
    assert table(token_counts.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_frequent_table_is_bounded(docs):
    assert 0 < token_counts.frequent_pretokens(docs, entries=50).count() <= 50


def brute_fingerprint(text, size):
    w = text.encode().lower().split()
    s = [b" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                root[find(a)] = find(b)
    low = {}
    for k, i in enumerate(ids):
        r = find(k)
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [low.get(find(k)) for k in range(len(ids))]


def test_simhash(docs, empty, cases):
    fps = [brute_fingerprint(t or "", 3) for _, t in cases]
    comp = brute_components([i for i, _ in cases], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    out = simhash.near_groups(docs).withColumn("x", simhash.hex_fingerprint())
    assert table(out, "doc_id", "x", "component_id") == sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(cases, fps, comp)), key=repr)
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("node", [2, 16, 4096])
def test_trie_links_are_complete(spark, node):
    r = np.random.default_rng(4)
    x = r.integers(-(2**63), 2**63, 300)
    x[100:300] = x[:4].repeat(50) ^ (1 << r.integers(0, 63, 200)) ^ (1 << r.integers(0, 63, 200))
    x = np.unique(x)
    got = {tuple(p) for p in simhash.links(spark.createDataFrame([(int(v),) for v in x], "fp long"), node_entries=node).collect()}
    u = x.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 2
    want = brute_components(list(range(len(x))), lambda a, b: near[a, b])
    at = {int(v): k for k, v in enumerate(x)}
    links = {(at[a], at[b]) for a, b in got}
    assert brute_components(list(range(len(x))), lambda a, b: (a, b) in links or (b, a) in links) == want


@pytest.mark.parametrize("shape", ["path", "hub", "random"])
def test_components(spark, shape):
    from thicket.llm.components import components

    rng = np.random.default_rng(5)
    n = 60
    ends = {"path": [(i, i + 1) for i in range(n)], "hub": [(n, i) for i in range(n)], "random": rng.integers(0, n, (n // 2, 2)).tolist()}[shape]
    name = rng.permutation(n + 1).tolist()  # neighbours get far names
    rows = [(name[a], name[b]) for a, b in ends] * 2 + [(7, 7)]
    got = components(spark.createDataFrame(rows, "u long, v long").repartition(5)).collect()
    linked = set(rows) | {(b, a) for a, b in rows}
    want = brute_components(list(range(n + 1)), lambda a, b: (a, b) in linked)
    assert {r["u"]: r["v"] for r in got} == {a: want[a] for a in range(n + 1) if want[a] != a} and len(got) == len({r["u"] for r in got})
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_copies(spark, docs, empty, cases):
    sets = [frozenset(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for _, t in cases]
    alike = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    comp = brute_components(list(range(len(cases))), alike)
    groups = defaultdict(list)
    for k, c in enumerate(comp):
        groups[c].append(cases[k][0])
    want = sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=repr)
    out = near_copies.one_of_each_group(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == want
    assert near_copies.one_of_each_group(empty).count() == 0


def test_repeated_shingles_neither_join_nor_part_texts(spark):
    own = [" ".join(f"{k}w{j}" for j in range(300)) for k in "xyz"]
    passage = " ".join(f"p{j}" for j in range(60))
    texts = ["the " * 1000 + own[0], "the " * 1000 + own[1], "a a a a a a a b", "a a a a a a a c", f"{own[2]} {passage}", f"{own[2]} " + " ".join([passage] * 8)]
    out = near_copies.one_of_each_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("seed", [59, 86])
def test_links_displaced_by_a_failing_one_are_checked(spark, seed):
    """Jaccard 0.786, 0.802 and 0.802; the first pair differs in the fewest bits, the last in the most."""
    some = lambda k, n: [f"{k}{seed}x{i}" for i in range(n)]
    core, ab, ac, bc = some("q", 80), some("d", 8), some("e", 9), some("f", 9)
    texts = core + ab + ac + some("a", 3), core + ab + bc + some("b", 3), core + ac + bc + some("c", 2)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r["doc_id"] for r in near_copies.one_of_each_group(d, size=1).collect()] == [0]


@pytest.mark.parametrize("most", [1024, 8])
def test_parts_of_a_group_join_again(spark, monkeypatch, most):
    """Families around the border of 0.8; the largest family is one root already, and two groups share a task."""
    monkeypatch.setattr(near_copies, "SIDE_ENTRIES", most)
    r = np.random.default_rng(1)
    sets, part, root = [], [], []
    for p in (5, 6):
        base = r.integers(0, 1 << 63, 100, dtype=np.uint64)
        for k in range(40):
            x = base.copy()
            at = r.permutation(100)[: 3 if k <= 12 else 4 + k % 7]
            x[at] = r.integers(0, 1 << 63, len(at), dtype=np.uint64)
            sets.append(np.unique(x))
            part.append(p)
            root.append(p * 1000 if k <= 12 else p * 1000 + k)
    v = [1000 * p + k for p in (5, 6) for k in range(40)]
    wide = [near_copies.wide_fingerprint(x) for x in sets]
    e = spark.createDataFrame(list(zip(v, wide, part, root, strict=True)), "v long, wide binary, part long, root long")
    own = spark.createDataFrame([(k, x.tobytes()) for k, x in zip(v, sets, strict=True)], "k long, own binary")
    got = {(x["u"], x["v"]) for x in near_copies._rejoined(e, own, 0.8).collect()}
    bits = np.array([np.frombuffer(w, "<u4") for w in wide])

    def reach(a, b):
        x = bits[a] ^ bits[b]
        return np.bitwise_count(x).sum() <= near_copies.CLOSE and near_copies._first_trie(x[None])[0] >= 0

    holds = {(a, b) for a in range(80) for b in range(80) if part[a] == part[b] and near_copies.jaccard(sets[a], sets[b]) >= 0.8 and reach(a, b)}
    assert len(holds) - 80 < 2 * 40 * 39  # some links fail
    at = {k: i for i, k in enumerate(v)}
    sent = {(at[a], at[b]) for a, b in got}
    assert sent <= holds
    same = lambda a, b: root[a] == root[b]
    one = brute_components(list(range(80)), lambda a, b: (a, b) in sent or (b, a) in sent or same(a, b))
    assert one == brute_components(list(range(80)), lambda a, b: (a, b) in holds or same(a, b))
    assert sent and 2 < len(set(one)) < 56


def test_near_links_in_parts(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.bytes(32)) for i in range(60)]
    rows += [(100 + i, bytes([rows[i][1][0] ^ 1]) + rows[i][1][1:]) for i in range(60)]
    e = spark.createDataFrame(rows, "v long, wide binary")
    for size in (8192, 4):
        got = {(x["u"], x["v"]) for x in near_copies.near_links(e, size).collect()}
        assert {(i, 100 + i) for i in range(60)} <= got


def test_spanning_forest():
    i, j, d = np.array([0, 1, 0, 3]), np.array([1, 2, 2, 4]), np.array([1, 5, 2, 9])
    assert sorted(near_copies.spanning_forest(i, j, d, 6).tolist()) == [0, 2, 3]


def test_quality(spark, docs, empty):
    good = [(i, f"a calm text number {i} about rivers and hills " * 3) for i in range(60)]
    bad = [(1000 + i, f"buy now {i} !!!! $$$$ cheap cheap cheap cheap") for i in range(60)]
    rude = [(2000 + i, f"a calm text number {i} about rivers but you vile wretch " * 3) for i in range(60)]
    d = spark.createDataFrame(good + bad + rude, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:40]] + [(i, 0, 0) for i, _ in bad[:40]] + [(i, 1, 1) for i, _ in rude[:40]] + [(None, 1, 0), (5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(d, labels)
    out = {r["doc_id"]: r for r in quality.select(quality.score(d, model, ["doc_id"])).collect()}
    assert all(out[i]["selected"] for i, _ in good[40:]) and not any(out[i]["selected"] for i, _ in bad[40:] + rude[40:])
    assert model[1][0] <= model[1][1] and all(0 <= r["top_probability"] <= r["expected_grade"] <= 2 for r in out.values())
    none = quality.train(d, labels.where("false"))
    assert quality.select(quality.score(docs, none, ["doc_id", "selected"])).count() == docs.count()
    assert quality.score(empty, model, ["doc_id"]).count() == 0
    few = quality.rated_sample(d, labels, "doc_id", "text", F.col("quality"), 10)
    assert len(few[0]) <= 10


def test_bpe_codec(docs, empty, cases, tokenizers):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    t, want = Tokenizer.from_file(path), []
    for i, x in cases:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    assert table(bpe_codec.encode_digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    full = bpe_codec.encode(docs, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("a"), F.sha2(F.col("decoded").cast("binary"), 256).alias("b"))
    assert table(full, *full.columns) == sorted(want, key=repr)
    assert bpe_codec.encode(empty, path).count() == 0


def test_chunks_follow_content():
    r = np.random.default_rng(0)
    body = bytes(r.integers(97, 123, 60000).astype(np.uint8))
    a, b = bpe_codec.chunks(b"one " + body), bpe_codec.chunks(b"another start " + body)
    assert b"".join(a) == b"one " + body and len(set(a) & set(b)) > 0.8 * len(a)
    for text in ("日本" * 5000).encode(), ("é" * 1001).encode():
        assert b"".join(bpe_codec.chunks(text)) == text and all(c.decode() for c in bpe_codec.chunks(text))


def brute_repeats(cases, length):
    seen = Counter()
    for _, t in cases:
        b = (t or "").encode()
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, t in cases:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(c for c, g in zip(b, gone) if not g))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group,array,batches", [(2048, 256, 4), (2048, 1, 3), (2, 1, 1)])
def test_repeats(docs, cases, monkeypatch, group, array, batches):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "IN_ARRAY", array)
    out = repeats.remove_repeats(docs, batches=batches)
    out = out.withColumn("h", F.sha2("kept", 256))
    assert table(out, "doc_id", "n_bytes", "n_removed", "n_spans", "h") == brute_repeats(cases, repeats.LENGTH)


def brute_shared(cases, n):
    """Rows (by id and text) with a string of n words that another such row has."""
    held = defaultdict(set)
    for k in set(cases):
        w = (k[1] or "").encode().split()
        for p in range(len(w) - n + 1):
            held[tuple(w[p : p + n])].add(k)
    return {k for own in held.values() if len(own) > 1 for k in own}


@pytest.mark.parametrize("group", [1 << 16, 1])
def test_shared_passages(spark, cases, docs, empty, monkeypatch, group):
    monkeypatch.setattr(passages, "GROUP", group)
    r = np.random.default_rng(7)
    word = lambda n: " ".join("".join(r.choice(list("abcdefgh"), 4)) for _ in range(n))
    rows = list(cases)
    for n in (49, 50, 51, 52, 70):
        own = word(n)
        rows += [(5000 + 10 * n + k, f"{word(30 * k)} {own} {word(40 - 20 * k)}".strip()) for k in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = repeats.remove_repeats(d, shared=passages.shared_passages(d))
    want = brute_shared(rows, passages.WORDS)
    got = Counter((x["doc_id"], x["n_shared"] > 0) for x in out.collect())
    assert got == Counter((k[0], k in want) for k in rows)
    assert passages.shared_passages(empty).count() == 0


def test_repeats_empty_and_short(spark, empty):
    assert repeats.remove_repeats(empty).count() == 0
    r = np.random.default_rng(1)
    texts = [(i, "".join(r.choice(list("ab"), 60))) for i in range(30)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    out = repeats.remove_repeats(d, length=12, anchor=4).withColumn("h", F.sha2("kept", 256))
    assert table(out, "doc_id", "n_bytes", "n_removed", "n_spans", "h") == brute_repeats(texts, 12)


def test_index_family_levels(docs):
    family = repeats.SuffixIndexFamily()
    table_ = repeats.stretch_table(docs, "doc_id", "text").where("a is not null")
    for k in range(5):
        family.add(table_.where(F.pmod("r1", F.lit(5)) == k))
    assert sorted(rank for rank, _ in family.levels) == [0, 2]


def test_brown_lm(docs, empty, cases):
    tokens = [(t or "").encode().lower().split() + [None] for _, t in cases]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in cases]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = [(i, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for (i, _), h, t in zip(cases, held, tokens)]
    model, counts = brown_lm.train(docs)
    out = brown_lm.score(docs, model, counts).withColumn("b", F.round("base_score", 6)).cache()
    assert table(out, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "b") == sorted(want, key=repr)
    assert out.where("score >= 0 or isnan(score)").count() == 0
    assert brown_lm.score(empty, *brown_lm.train(empty)).count() == 0
    only = docs.where("doc_id = 503")
    assert brown_lm.score(only, *brown_lm.train(empty)).first()["n_known"] == 0


def test_brown_scores_again(docs, cases):
    """Score, perplexity and n_once of every row from the words' classes, in plain Python."""
    model, words = brown_lm.train(docs)
    kind = {bytes(r["word"]): (r["c"], r["k"]) for r in words.collect()}
    tokens = [[w if len(w) <= 40 else b" " + xxhash.xxh3_128_digest(w) for w in (t or "").encode().lower().split()] + [b""] for _, t in cases]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in cases]
    mass, kinds, cells = Counter(), Counter(), Counter()
    for c, k in kind.values():
        mass[k] += c
        kinds[k] += 1
    unknown = max(range(64), key=lambda k: (kinds[k], -k))
    classes = [[kind.get(w, (0, unknown))[1] for w in t] for t in tokens]
    end = kind[b""][1]
    for c, h in zip(classes, held):
        if not h:
            cells.update(zip([end, *c], c))
    total, rows = sum(mass.values()), Counter()
    for (a, _), n in cells.items():
        rows[a] += n
    step = lambda a, b: math.log10((cells[a, b] + 5 * (mass[b] + 1) / (total + 64)) / (rows[a] + 5))
    want = []
    for (i, _), t, c in zip(cases, tokens, classes):
        own = [kind.get(w, (0, 0))[0] for w in t]
        s = sum(step(a, b) + math.log10(n + 0.1) - math.log10(mass[b] + 0.1 * (kinds[b] + 1)) for a, b, n in zip([end, *c], c, own))
        want.append((i, round(s, 5), round(10 ** (-s / len(t)), 4), own.count(1)))
    out = brown_lm.score(docs, model, words).withColumns({"s": F.round("score", 5), "p": F.round("perplexity", 4)})
    assert table(out, "doc_id", "s", "p", "n_once") == sorted(want, key=repr)
    both = brown_lm.train_and_score(docs).withColumns({"s": F.round("score", 5), "p": F.round("perplexity", 4)})
    assert table(both, "doc_id", "s", "p", "n_once") == sorted(want, key=repr)


def test_brown_tasks_give_memory_back(docs, monkeypatch):
    """Each of a task's mappers ends with a release, and takes a batch's texts in runs."""
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", None, "", "c" * 50] * 3)], names=["t"])
    assert [t for run in brown_lm.text_runs(batch.column(0)) for t in run] == [b"a b", b"", b"", b"c" * 50] * 3
    assert max(map(len, brown_lm.text_runs(pa.array(["x" * brown_lm.RUN_BYTES] * 3)))) == 1
    calls = []
    monkeypatch.setattr(brown_lm, "release", lambda: calls.append(1))
    assert list(brown_lm.released(iter)([1, 2])) == [1, 2] and calls == [1]
    model, _ = brown_lm.train(docs)
    words, sizes, counts, classes = model.packed()
    place = brown_lm.unpacked(words, sizes)
    assert [(w, int(counts[i]), int(classes[i])) for w, i in place.items()] == [(w, c, k) for w, c, k in model.table]
    assert brown_lm.unpacked(*brown_lm.Model([], 0, 0).packed()[:2]) == {}


def test_brown_probabilities_sum_to_one(docs):
    model, words = brown_lm.train(docs)
    assert np.allclose((10**model.step).sum(1), 1)
    mass = defaultdict(float)
    for r in words.collect():
        mass[r["k"]] += r["c"] + 0.1
    for k, m in mass.items():
        assert math.isclose((m + 0.1) / 10 ** model.below[k], 1, rel_tol=1e-9)  # 0.1 is the unknown word's


def test_words_join_the_class_with_their_neighbours():
    """Class k is followed by class k + 1: a word between 4 and 6 is of class 5."""
    cells = np.ones((65, 65))
    for k in range(64):
        cells[k, (k + 1) % 64] = 500
    cells[64, :64] = cells[:64, 64] = 300  # unclassed neighbours say nothing
    near = [[bytes([k, (k + 2) % 64, k, 64])] for k in range(64)]
    assert np.argmax(brown_lm.context_counts(near) @ brown_lm.joining_gain(cells), 1).tolist() == [(k + 1) % 64 for k in range(64)]


@pytest.mark.parametrize("raw", [512, 2])
def test_context_counts(monkeypatch, raw):
    monkeypatch.setattr(brown_lm, "RAW_BYTES", raw)
    near = [[bytes([1, 2, 1, 3])], [bytes([64, 0]), bytes([5, 6, 5, 6, 5, 7])]]
    n = brown_lm.context_counts([[brown_lm._packed(x) for x in own] for own in near])
    assert n[0, 1] == 2 and n[0, 65 + 2] == 1 and n[0, 65 + 3] == 1 and n[1, 64] == 1 and n[1, 65] == 1 and n[1, 5] == 3 and n[1, 65 + 6] == 2 and n.sum() == 12


def test_exchange_finds_classes():
    r = np.random.default_rng(2)
    kind = np.arange(30) % 3
    p = np.array([[0.05, 0.9, 0.05], [0.05, 0.05, 0.9], [0.9, 0.05, 0.05]])
    counts = r.poisson(200 * p[kind][:, kind])
    label = brown_lm.exchange(counts.astype(float), 3)
    assert len({(int(a), int(b)) for a, b in zip(kind, label)}) == 3


def test_rare_words_are_joined(docs, cases, monkeypatch):
    whole = brown_lm.score(docs, *brown_lm.train(docs)).orderBy("doc_id", "n_tokens").select("base_score", "n_known").collect()
    monkeypatch.setattr(brown_lm, "TABLE_WORDS", 20)
    small = brown_lm.score(docs, *brown_lm.train(docs)).orderBy("doc_id", "n_tokens").select("base_score", "n_known").collect()
    assert np.allclose(whole, small)


def test_media(docs, empty, cases):
    out = media.digest(media.load(media.store(docs)))
    want = []
    for i, t in cases:
        b = (t or "").encode()
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        want.append((i, len(b), len(p), sha(p), zlib.crc32(p[-64:])))
    assert table(out, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    assert out.where("length(feature) <> 16 or length(media_sha256) <> 64 or media_bytes < 60").count() == 0
    same = out.where("doc_id in (0, 100, 105)").select("media_sha256", "feature").distinct()
    assert same.count() == 1 and media.load(media.store(empty)).count() == 0


def test_png_filters_and_damage():
    r = np.random.default_rng(0)
    want = r.integers(0, 256, (11, 64), dtype=np.uint8)
    lines_ = np.zeros((11, 65), np.uint8)
    for y in range(11):
        up = want[y - 1].astype(int) if y else np.zeros(64, int)
        row, left = want[y].astype(int), np.concatenate(([0], want[y][:-1])).astype(int)
        corner = np.concatenate(([0], up[:-1]))
        est = left + up - corner
        dist = np.stack([abs(est - left), abs(est - up), abs(est - corner)])
        paeth = np.where((dist[0] <= dist[1]) & (dist[0] <= dist[2]), left, np.where(dist[1] <= dist[2], up, corner))
        guess = [0, left, up, (left + up) // 2, paeth][y % 5]
        lines_[y, 0], lines_[y, 1:] = y % 5, (row - guess) & 255
    assert (media.unfilter(lines_) == want).all()
    png = media.write_png(want.tobytes())
    assert (media.read_png(png) == want).all()
    for bad in (png[:-1], png[:40] + bytes([png[40] ^ 1]) + png[41:], b"x" + png[1:]):
        with pytest.raises(ValueError):
            media.read_png(bad)


def test_lines(docs, empty, cases):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t in cases:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(-1 if i is None else i)
    keep = {k: max(v) for k, v in held.items() if len(v) >= 5}
    want = []
    for i, t in cases:
        ls = (t or "").split("\n")
        left = [x for x in ls if keep.get(key(x), i if i is not None else -1) == (-1 if i is None else i)]
        want.append((i, len(ls), len(ls) - len(left), "\n".join(left)))
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert table(out, "doc_id", "n_lines", "n_dropped", "text") == sorted(want, key=repr)
    assert lines.dedup_lines(empty).count() == 0


def brute_windows(cases, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for n, t in items:
        w = words(t)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add(str(n))
    out = []
    for i, t in cases:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if own := windows.get(tuple(w[p : p + k])):
                    found |= own
                    hit.update(range(p, p + k))
        out.append((i, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark, docs, empty, cases):
    items = [(1, " ".join(f"shared{j}" for j in range(10, 40))), (2, "and AND and"), (3, None), (4, "!!"), (5, cases[0][1][:300]), (6, cases[0][1][:300]), (7, "nowhere to be found in here"), (8, "日本")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.overlaps(docs, bench)
    assert set(docs.columns) <= set(out.columns)
    assert table(out, "doc_id", "n_words", "n_hit", "items", "contaminated") == brute_windows(cases, items)
    spans = {r["doc_id"]: (r["text"].encode(), r["spans"]) for r in out.where("doc_id = 302").collect()}[302]
    left = decontam.remove_spans(spans[0], [(s["first"], s["end"]) for s in spans[1]])
    assert b"shared9 " in left and b"shared10" not in left and b"shared39" not in left and b"shared40" in left
    in_parts = decontam.overlaps(docs, bench, part_bytes=60)
    assert in_parts.columns == out.columns and sorted(map(str, in_parts.collect())) == sorted(map(str, out.collect()))
    assert decontam.overlaps(empty, bench).count() == 0 and decontam.overlaps(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_benchmark_items_without_an_id(spark):
    passage = " ".join(f"w{j}" for j in range(20))
    docs = spark.createDataFrame([(1, f"head {passage} tail"), (2, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (None, "w1 w2"), (7, "w3 w4")], "item_id long, text string")
    assert table(decontam.overlaps(docs, bench), "doc_id", "n_hit", "items", "contaminated") == [(1, 20, ["7"], True), (2, 0, [], False)]


def test_fm_index():
    r = np.random.default_rng(0)
    s = r.integers(1, 5, 500)
    fm = decontam.FMIndex(s)
    for k in (1, 2, 5):
        p = np.array([s[i : i + k] for i in range(0, 400, 13)] + [[9] * k])
        lo, hi = fm.search(p)
        for q, a, b in zip(p, lo, hi):
            assert sorted(fm.locate(np.arange(a, b)).tolist()) == [i for i in range(500 - k + 1) if (s[i : i + k] == q).all()]


def test_urls(spark):
    rows = [(1, "https://A.B.com/en/7x"), (2, "http://example.com/en/7?x"), (3, "http://x.example.com/en/1"), (4, "http://de.net/de/8"), (5, "ftp://EXAMPLE.net/de/80#f"), (6, None), (7, "no scheme"), (8, "http://notcom/en/"), (9, "http://org?q=/es/"), (10, "a://b://com/en/"), (10, "a://b://com/en/"), (11, "x://casino-slots.biz/win"), (12, "x://org/es/\u00e9"), (13, "x://com"), (14, "y\n://com/en/\nz")]
    pages = spark.createDataFrame([(i, u, "<p>casino slots win example</p>", "h") for i, u in rows], "page_id long, url string, html string, host string")
    rules = [(v, h, p) for v, h, p in urls.RULES]

    def brute(u):
        host = path = ""
        if u is not None and "://" in u:
            host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S).groups()
            host = host.translate({c: c + 32 for c in range(65, 91)})
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, None)

    out = urls.judge(pages)
    for r, u in zip(out.orderBy("page_id").collect(), [u for _, u in sorted(rows, key=lambda x: x[0])]):
        host, path, rule, verdict = brute(u)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")
    assert urls.judge(pages.where("false")).count() == 0
    assert urls.judge(pages.where("page_id in (6, 7)")).where("verdict = 'allow'").count() == 2


def test_url_verdicts_by_plain_naive_bayes(spark):
    """Segments, counts and log odds of every row again, in plain Python."""
    hosts = ["cheapcasino.biz", "win-casino.org", "gardentools.net", "www.oldmaps.org", "m.bets-free.example.com", "x" * 300 + ".net"]
    text = "cheap win garden tools old maps free the casino bets and the garden of old tools for maps " * 3
    rows = [(i, f"http://{hosts[i % 6]}/{['en', 'fr', 'shop/cheap'][i % 3]}/{i * 37}" + "/a" * (4000 * (i == 7)), f"<p>{text}</p>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    words = Counter(re.findall("[a-z]+", text * 60))
    labels = {x for h in hosts for x in re.findall("[a-z]+", h)}
    known = {w: n for w, n in words.items() if len(w) > 1 and w not in labels}
    known = dict.fromkeys(urls.SEEDS, sum(known.values()) // len(known)) | known
    cut, counts, size = urls.Segmenter(known), {True: Counter(), False: Counter()}, 1 << 16
    tokens = [cut.tokens(*re.match(r"http://([^/]*)(.*)", u).groups()) for _, u, _ in rows]
    for t in tokens:
        counts[any(x.split(":")[-1] in urls.SEEDS for x in t)].update(zlib.crc32(x.encode()) % size for x in t)
    kinds = len(counts[True] | counts[False]) + 1
    log = lambda k, b: math.log((counts[k][b] + 0.5) / (sum(counts[k].values()) + 0.5 * kinds))
    want = [sum(log(True, b) - log(False, b) for b in (zlib.crc32(x.encode()) % size for x in t)) for t in tokens]
    got = urls.judge(pages).orderBy("page_id").collect()
    assert np.allclose([r["log_odds"] for r in got], want)
    assert [r["verdict"] for r in got if r["rule"] is None] == ["block" if w > 0 else "allow" for w, r in zip(want, got) if r["rule"] is None]
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}


def test_host_labels_are_split_by_words_of_the_text(spark):
    html = '<p class="cheapcasino">cheap flights, a casino and CheapCasino</p> see https://cheapcasino.biz/cheapcasino or cheapcasino.biz'
    rows = [(i, f"http://cheapcasino.biz/{i}", html) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    words = urls.word_counts(pages, ["html"]).join(urls.host_labels(pages, "url"), "word", "left_anti")
    assert urls.Segmenter(dict(words.collect())).split("cheapcasino") == ["cheap", "casino"]
    assert urls.judge(pages).where("verdict = 'allow'").count() == 0  # for the seed word inside the label


def test_viterbi_is_the_best_split():
    cut = urls.Segmenter({"spam": 50, "farm": 40, "far": 10, "ms": 5, "pamfa": 1})

    def best(s):
        if not s:
            return 0.0
        return max(cut.logs.get(s[:k], cut.unknown(k)) + best(s[k:]) for k in range(1, min(len(s), cut.longest) + 1))

    for s in ("spamfarm", "farms", "spamx", "q"):
        assert "".join(cut.split(s)) == s
        assert math.isclose(sum(cut.logs.get(w, cut.unknown(len(w))) for w in cut.split(s)), best(s))
    assert cut.split("spamfarm") == ["spam", "farm"]
