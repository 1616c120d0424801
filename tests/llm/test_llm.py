"""The corpus operators against brute force, on small tables with every awkward case."""

import hashlib
import os
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoreline.llm import (
    chat,
    decontaminate,
    hash_index,
    link_rank,
    near_copies,
    packing,
    prefix_trie,
    quality,
    ranked_search,
    set_join,
    shards,
    suffix_dedup,
    token_files,
)
from shoreline.llm.components import components

# extra columns whose names the operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, grp int, _slice string, node int"


def _docs():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    passage, page = prose(60), prose(300)
    texts = [None, "", " \n\t", "one", "two words", "\0\0", page, page, page + " end", passage,
             prose(80) + " " + passage + " " + prose(40), passage + prose(30), "ab" * 700, "x" * 450, prose(6000)]
    texts += [prose(rng.randint(1, 120)) for _ in range(25)]
    copy = page.split()
    copy[50] = "changed"
    texts.append(" ".join(copy))
    rows = [(i, t, None if i % 7 == 0 else "en", "s", None, "k", 1, "z", 2) for i, t in enumerate(texts)]
    return rows + [rows[6], (None, "no id here", None, None, 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_docs(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_repeated_bytes(docs, none):
    rows = [(r[0], (r[1] or "").encode()) for r in _docs()]
    seen = Counter(b[i:i + 200] for _, b in rows for i in range(len(b) - 199))
    want = Counter()
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want[(d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(map(tuple, suffix_dedup.repeated_bytes(docs).collect())) == want
    # names of very many places are told apart by hashes: the same result
    assert Counter(map(tuple, suffix_dedup.repeated_bytes(docs, crowd=1).collect())) == want
    assert suffix_dedup.repeated_bytes(none).count() == 0
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert kept.where("text is null").count() == docs.where("text is null").count()


def test_induction_in_order():
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab", k=40)) * 3 + "".join(rng.choices("abcd", k=300)) for _ in range(6)]
    texts += [t[50:320] for t in texts[:3]]
    hasher = suffix_dedup._Hasher()
    found = [(g, t.encode(), p, left, right) for t in texts for part in suffix_dedup.sample_suffixes(t.encode(), 200, hasher)
             for g, _, p, left, right in zip(*(x.tolist() for x in part), strict=True)]
    windows = Counter(t[p - f:p - f + 200] for _, t, p, left, right in found for f in range(right, left + 1))
    assert windows == Counter(t.encode()[i:i + 200] for t in texts for i in range(len(t) - 199))
    rows = sorted((g, t[p:p - right + 200], t[p - left:p][::-1]) for g, t, p, left, right in found)
    marks = suffix_dedup.induce(np.array([r[0] >> 1 for r in rows]), [r[1] for r in rows], [r[2] for r in rows], 200)
    for (_, tail, front), mark in zip(rows, marks, strict=True):
        whole = front[::-1] + tail
        for f in range(200 - len(tail), len(front) + 1):
            at = len(front) - f
            assert mark[f] == (windows[whole[at:at + 200]] > 1)


def _labels(items, linked):
    label = {i: i for i in items}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def test_simhash_components(docs, none):
    rows = _docs()
    fps = [near_copies.fingerprint(near_copies.shingle_hashes(r[1], 3)) for r in rows]
    group = _labels(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    least = {}
    for i, g in group.items():
        if rows[i][0] is not None:
            least[g] = min(least.get(g, 10**9), rows[i][0])
    want = Counter((r[0], f"{fps[i]:016x}", least.get(group[i])) for i, r in enumerate(rows))
    assert Counter(map(tuple, near_copies.simhash_components(docs).collect())) == want
    assert near_copies.simhash_components(none).count() == 0


def test_fingerprint_bits():
    # 'a b c' is one shingle: the fingerprint is its hash (XXH64, seed 42)
    import xxhash

    assert near_copies.fingerprint(near_copies.shingle_hashes("A  b\nC", 3)) == xxhash.xxh64_intdigest(b"a b c", 42)
    assert near_copies.fingerprint(near_copies.shingle_hashes(" \t", 3)) == 0


@pytest.mark.parametrize("radius", [1, 3, 7])
def test_links_connect_all_pairs(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    pairs = [(a, b) for a in fps for b in fps if b < a and ((a ^ b) & (2**64 - 1)).bit_count() <= radius]
    want = _labels(fps, pairs)
    # blocks of 5: cells are dealt over pairs of blocks
    got = dict(map(tuple, components(near_copies.links(df, radius, block=5)).collect()))
    assert all(got.get(f, f) == want[f] for f in fps)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(7, 7), (500, 501), (500, 501)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_keep_one_of_each(docs, none):
    kept = near_copies.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    texts = Counter((r["text"] or "") for r in kept.collect())
    assert set(texts.values()) == {1}
    page = _docs()[6][1]
    near = [t for t in texts if len(set(t.split()) & set(page.split())) > 0.9 * len(set(page.split())) and len(t.split()) < 400]
    assert near == [page]
    alone = [r[1] for r in _docs() if r[1] and r[1].split() and r[1].split()[0] in ("one", "two")]
    assert all(a in texts for a in alone)
    assert near_copies.keep_one_of_each(none).count() == 0


def _similarity(a, b):
    x, y = (set(near_copies.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_at_the_bound_go(spark):
    # six fingerprints at 7 bits lost 42 of these 300 pairs
    rng = random.Random(8)
    rows = []
    for i in range(300):
        words = [f"{rng.getrandbits(40):x}" for _ in range(204)]
        copy = list(words)
        for at in (20, 60, 100, 140):
            copy[at] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy + words[:1]))]
        assert 0.8 <= _similarity(rows[-2][1], rows[-1][1]) < 0.83
    kept = near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 600, 2))


def test_texts_without_words_stay(spark):
    texts = [" ", "\t", "\n\n", "", None, "  ", " ", "one"]
    kept = near_copies.keep_one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 5, 7]


def test_keeping_one_has_no_step_without_effect(docs, monkeypatch):
    # the set join finds every pair by itself: texts were fingerprinted and grouped for the same rows
    def unused(*args, **kwargs):
        raise AssertionError("a fingerprint decides nothing here")

    for name in ("fingerprints", "fingerprint_groups", "links"):
        monkeypatch.setattr(near_copies, name, unused)
    kept = near_copies.keep_one_of_each(docs)
    assert 0 < kept.count() < docs.count()


def test_no_two_kept_are_near_copies(spark):
    # ten families with a common template, linked to each other, and a chain of versions with rising ids
    rng = random.Random(9)

    def prose(n):
        return [f"{rng.getrandbits(40):x}" for _ in range(n)]

    template, texts = prose(150), []
    for _ in range(10):
        family = template + prose(45)
        for _ in range(8):
            copy = list(family)
            copy[rng.randrange(150)] = "changed"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    version = prose(200)
    for _ in range(60):
        version = version[6:] + prose(6)
        texts.append(" ".join(version))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in near_copies.keep_one_of_each(df).collect()}
    assert not [(a, b) for a in kept for b in kept if a < b and _similarity(texts[a], texts[b]) >= 0.8]
    assert all(any(_similarity(texts[a], texts[b]) >= 0.8 for b in kept) for a in range(len(texts)) if a not in kept)


def test_bounds_are_optimal():
    import itertools

    rng = random.Random(1)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 60), 9))
        counts = [rng.randint(1, 9) for _ in lengths]

        def padded(bounds):
            return sum(c * next(b for b in bounds if b >= n) for n, c in zip(lengths, counts, strict=True))

        best = min(padded(sorted({*some, lengths[-1]})) for k in range(3) for some in itertools.combinations(lengths[:-1], k))
        got = packing.choose_bounds(lengths, counts, 3)
        assert len(got) <= 3 and padded(got) == best
    assert packing.choose_bounds([], [], 3) == []


def test_length_buckets(docs, none):
    rows = packing.length_buckets(docs, max_len=1000, buckets=4, budget=4000).collect()
    whole = Counter(len((r[1] or "").encode()) + 1 for r in _docs())
    by_doc = Counter()
    for r in rows:
        assert r["n_tokens"] <= r["bound"] and r["start"] == r["piece"] * 1000
        by_doc[(r["doc_id"])] += r["n_tokens"]
    assert sum(by_doc.values()) == sum(n * c for n, c in whole.items())
    for _, group in _grouped(rows, "bucket"):
        bound = group[0]["bound"]
        room = 4000 // bound
        places = sorted(r["batch"] * room + r["slot"] for r in group)
        assert places == list(range(len(group))) and max(r["slot"] for r in group) < room
    assert packing.length_buckets(none).count() == 0


def _grouped(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out.items()


def test_token_files(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(file)
    t.encode_special_tokens = True
    for encoding in ("delta", "dictionary"):
        got = token_files.encode_and_read_back(docs, file, encoding=encoding).collect()
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        want = Counter()
        for row in _docs():
            ids = np.array([*t.encode(row[1] or "", add_special_tokens=False).ids, 0], "<u4")
            want[(row[0], len(ids), zlib.crc32(ids.tobytes()))] += 1
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
        ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert [i for i in ids if i is not None] == sorted(i for i in ids if i is not None)
    assert token_files.encode_and_read_back(none, file).count() == 0


def test_special_tokens_are_the_library_s(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|>", "no such token", "<|endoftext| >"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for escape in (False, True):
        t = Tokenizer.from_file(file)
        t.encode_special_tokens = escape
        ids = [np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for x in texts]
        got = token_files.encode_and_read_back(df, file, **({"escape": True} if escape else {})).collect()
        assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in got} == {
            i: (len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)}


def test_words_are_the_library_s():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        enc = token_files.encoder(f.read())
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "bc", "É", "'s", "'", "12", "³", "Ⅷ", "_", ",", "..", "!", "́", " ", "\x1c", "\x85", "一", "🙂", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(enc.encode(texts)) == want


def test_nearest(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((600, 24)).astype("float32").astype(float)
    v[100:140] = v[7]
    rows = [(i, x.tolist(), "q") for i, x in enumerate(v)]
    rows += [(1000, None, "q"), (1001, [0.0] * 24, "q"), (1002, [float("nan")] + [1.0] * 23, "q"),
             (1003, [None] + [1.0] * 23, "q"), (1004, [1.0, 2.0], "q"), (1006, [float("inf")] * 24, "q"), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q string")
    got = hash_index.nearest(df, df.where("vec_id % 20 = 0")).collect()
    hits = total = 0
    for q, mine in _grouped(got, "query_id"):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(v)), d))[:10]
        mine = sorted(mine, key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert np.allclose([r["score"] for r in mine], d[[r["vec_id"] for r in mine]], rtol=0, atol=1e-12)
        hits += len({*best.tolist()} & {r["vec_id"] for r in mine})
        total += 10
        if q in range(100, 140):
            assert [r["vec_id"] for r in mine] == [i for i in [7, *range(100, 140)] if i != q][:10]
    assert total == 300 and hits >= 0.9 * total
    few = df.where("vec_id < 4")
    assert Counter(r["query_id"] for r in hash_index.nearest(few, few).collect()) == dict.fromkeys(range(4), 3)
    assert hash_index.nearest(df.where("false"), df).count() == 0


def test_every_code_in_the_radius_is_found():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 256, (500, 4)).astype(np.uint8)
    index = hash_index.Index(codes)
    for radius in (0, 3, 6, 9, 32):
        for code in codes[:10]:
            far = np.bitwise_count(codes ^ code).sum(1)
            assert index.within(code, radius).tolist() == np.flatnonzero(far <= radius).tolist()


def test_kd_shards(docs, none):
    rows = shards.kd_shards(docs, 8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in _docs())
    for _, group in _grouped(rows, "shard"):
        assert sorted(r["slot"] for r in group) == list(range(len(group)))
    assert shards.kd_shards(none, 8).count() == 0


def test_shards_have_equal_bytes(spark):
    # a third of the rows are one text of one source
    rows = [(i, "same text here" if i % 3 else "x" * (i % 50), "en", "s0" if i % 3 else f"s{i % 11}") for i in range(3000)]
    got = shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 6)
    sizes = [r["n"] for r in got.groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "n").collect()]
    assert len(sizes) == 6 and max(sizes) - min(sizes) <= 150


def test_quality_on_held_out_texts(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows, rated = [], []
    for i in range(900):
        grade = i % 3
        text = rng.choices(words, k=rng.randint(20, 200))
        if grade == 0:
            text.insert(5, rng.choice(["vile", "foul"]))
        if grade == 1:
            text = [w + rng.choice(["###", "$$$"]) for w in text]
        rows.append((i, " ".join(text), 0))
        if i < 600:
            rated.append((i, grade))
    rows += [(None, None, 0), (5000, "", 0), rows[4]]
    rated += [(None, 1), (3, None), (7, 9), (6, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tails int")
    model = quality.train(docs, spark.createDataFrame(rated, "doc_id long, grade int"))
    assert model.thresholds[0] < model.thresholds[1]
    out = {r["doc_id"]: r for r in quality.graded(docs, model).collect()}
    held = range(600, 900)
    assert np.mean([out[i]["kept"] == (i % 3 == 2) for i in held]) > 0.95
    assert all(0 <= out[i]["p_top"] <= out[i]["p_above_0"] <= 1 for i in held)
    kept = quality.selected(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in quality.graded(docs, model).collect())
    assert quality.graded(docs.where("false"), model).count() == 0


def test_the_driver_gets_the_weights_and_not_the_sample(spark, monkeypatch):
    # the fit ran in the driver, whose Python kept over 100 MB of features of the sample
    texts = [f"word{i % 7} other{i % 3}" + " ###" * (i % 2) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rated = spark.createDataFrame([(i, i % 2 + 1) for i in range(60)], "doc_id long, grade int")
    model = quality.train(docs, rated)
    own = quality.fit([quality.features(t) for t in texts], np.array([i % 2 + 1 for i in range(60)]), 2)
    assert model.weights.any() and (model.weights == own.weights).all() and (model.thresholds == own.thresholds).all()
    assert not quality.train(docs, rated.where("false")).weights.any()
    monkeypatch.setattr(quality, "fit", lambda *_: quality.Ordinal(np.ones(4, np.float32), np.array([os.getpid(), 0.0])))
    assert quality.train(docs, rated).thresholds[0] != os.getpid()


def test_the_fit_holds_the_sample_once():
    # it made an array of all features, one of twice that size to count them, and a second copy of each text's features
    rng = np.random.default_rng(5)
    docs = [np.unique(rng.integers(0, 1 << 12, 1000)).astype("<i4") for _ in range(3000)]
    tracemalloc.start()
    model = quality.fit(docs, np.arange(3000) % 3, 2, bits=12, batch=64, epochs=1, steps=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.weights.any() and most < sum(d.nbytes for d in docs) / 4


def test_repeats_take_one_python_process_a_task_and_few_texts_at_once(spark):
    # two steps without an exchange between them ran in two processes a task; samples were made of whole batches
    docs = spark.createDataFrame([(i, f"{i % 3} " * 300) for i in range(40)], "doc_id long, text string")

    def python_steps(node) -> int:
        """The Python steps of the task that ends here."""
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return python_steps(node.initialPlan())
        below = [python_steps(node.children().apply(i)) for i in range(node.children().size())]
        # the parts of a union are tasks of their own
        seen.append((max(below, default=0) if name == "Union" else sum(below)) + ("InArrow" in name))
        return 0 if "Exchange" in name else seen[-1]

    for df in (suffix_dedup.without_repeats(docs, crowd=1), suffix_dedup.repeated_bytes(docs, crowd=1)):
        seen = []
        python_steps(df._jdf.queryExecution().executedPlan())
        assert max(seen) == 1
    texts = pa.RecordBatch.from_pydict({"text": [f"{i} " * 200 for i in range(2000)], "k1": [*range(2000)], "k2": [0] * 2000})
    out = list(suffix_dedup._samples(200)(iter([texts])))
    assert {x for b in out for x in b.column("k1").to_pylist()} == {*range(2000)}
    assert max(len(set(b.column("k1").to_pylist())) for b in out) <= 512


def test_chat_round_trip(spark):
    rng = random.Random(8)
    nasty = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "<", "\\n", "a\nb", "", None, "<<||", "\\\\|"]
    rows = [(1, 0, "system", "be kind"), (2, 0, "system", "alone"), (None, 0, "user", "no conversation"), (4, None, None, None),
            (5, 0, "us\ner", "odd role"), (5, 0, "us\ner", "odd role")]
    rows += [(1, i, "assistant" if i % 2 == 0 else "user", rng.choice(nasty) if i % 3 else "word " * rng.randint(1, 90)) for i in range(1, 60)]
    rows += [(3, i, ["user", "assistant"][i % 2], "long " * 900) for i in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    windows = chat.chat_windows(df.withColumn("window", df["turn"]), span=600, history=200)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    for c, turns in _grouped([dict(zip(("c", "t", "r", "x"), r, strict=True)) for r in rows], "c"):
        turns = sorted(((-1 if r["t"] is None else r["t"], r["r"] or "", r["x"] or "") for r in turns))
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = windows.where("conv_id = 1").collect()
    assert len(one) > 3 and all(w["formatted"].startswith("<|im_start|>system\nbe kind<|im_end|>") for w in one)
    assert chat.read_back(chat.chat_windows(df.where("false"))).count() == 0


def _edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_benchmark_matches(spark, docs, none):
    rng = random.Random(12)
    letters = "abcdefghij klm"
    items = [decontaminate.plain("".join(rng.choices(letters, k=rng.randint(30, 150)))) for _ in range(12)]
    rows = []
    for i in range(60):
        part = list(rng.choice(items))
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(part))
            part[at:at + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
        rows.append((i, "".join(rng.choices(letters, k=50)) + "".join(part).upper() + "\n  zz"))
    rows += [(None, None), (99, ""), rows[0]]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, items[0])], "item_id long, text string")
    want = Counter()
    for d, t in rows:
        for i, item in enumerate(items):
            e = _edits(item, decontaminate.plain(t))
            if t and e <= int(len(item) * 0.08):
                want[(d, i, e)] += 1
    got = Counter((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.benchmark_matches(found, bench).collect())
    assert got == want and want
    clean = decontaminate.without_benchmark(found, bench)
    assert clean.columns == found.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(d for d, _ in rows) - Counter(
        d for n, d in {(n, r[0]) for n, r in enumerate(rows) if any(
            r[1] and _edits(i, decontaminate.plain(r[1])) <= int(len(i) * 0.08) for i in items)})
    assert decontaminate.benchmark_matches(none, bench).count() == 0
    assert decontaminate.without_benchmark(found, bench.where("false")).count() == found.count()


def test_url_verdicts(spark):
    def page(i, url, *links):
        return i, url, "".join(f'<a href="{x}">x</a>' for x in links), "x"

    rows = [page(1, "http://Good.COM/a?b", "https://friend.org/x", "/own"), page(2, "http://friend.org/", "//second.org/y"),
            page(3, "http://second.org"), page(4, "http://bad.net/es/1"), page(5, "http://farm.org/x", "http://bad.net/", "HTTP://bad.net/z"),
            page(6, "http://farm.org/x", "http://bad.net/"), page(7, "https://a.example.com/en/x"), page(8, "https://www.example.com/en/x"),
            page(9, "http://alone.org/#com/"), page(10, "nothing"), (11, None, None, None), page(12, "http://x.com"),
            (None, "http://bad.net/de/", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in link_rank.url_verdicts(df).collect()}
    assert got == {
        1: ("good.com", "/a", "com/", "allow"), 2: ("friend.org", "/", None, "allow"), 3: ("second.org", "", None, "allow"),
        4: ("bad.net", "/es/1", "net/es/", "block"), 5: ("farm.org", "/x", None, "block"), 6: ("farm.org", "/x", None, "block"),
        7: ("a.example.com", "/en/x", "example.com/en/", "block"), 8: ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        9: ("alone.org", "/", None, "allow"), 10: ("", "", None, "allow"), 11: ("", "", None, "allow"),
        12: ("x.com", "", None, "allow"), None: ("bad.net", "/de/", None, "block")}
    assert link_rank.url_verdicts(df.where("false")).count() == 0


def test_distrust_reaches_far_hosts(spark):
    # fourteen links to a blocked host; no trust reaches them
    rows = [(i, f"http://h{i}.org/x", f'<a href="http://h{i + 1}.org/">x</a>') for i in range(13)]
    rows += [(13, "http://h13.org/x", '<a href="http://bad.net/">x</a>'), (14, "http://bad.net/es/1", ""), (15, "http://h99.org/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in link_rank.url_verdicts(df).collect()}
    assert got == {**dict.fromkeys(range(15), "block"), 15: "allow"}


def test_ranks_settle(spark):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "c", 4), ("c", "e", 1)]
    edges = spark.createDataFrame([("trust", *x) for x in links], "kind string, src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "a", 3), ("trust", "d", 1)], "kind string, host string, weight long")
    names = "abcde"
    m = np.zeros((5, 5))
    for s, d, n in links:
        m[names.index(d), names.index(s)] = n
    m = m / np.maximum(m.sum(0), 1)
    start = np.array([0.75, 0, 0, 0.25, 0])
    x = start
    for _ in range(300):
        moved = 0.5 * m @ x
        x = moved + start * (1 - moved.sum())
    got = {r["host"]: r["value"] for r in link_rank.settled(seeds, edges, damping=0.5).collect()}
    assert np.allclose([got[n] for n in names], x, rtol=1e-5)
    with pytest.raises(RuntimeError):
        link_rank.settled(seeds, edges, steps=3)


def test_propagation_is_personalised_pagerank(spark):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "c", 4)]
    edges = spark.createDataFrame([("trust", *x) for x in links], "kind string, src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "a", 3), ("trust", "d", 1)], "kind string, host string, weight long")
    names = "abcd"
    m = np.zeros((4, 4))
    for s, d, n in links:
        m[names.index(d), names.index(s)] = n
    m = m / np.maximum(m.sum(0), 1)
    start = np.array([0.75, 0, 0, 0.25])
    x = start
    for _ in range(10):
        moved = 0.85 * m @ x
        x = moved + start * (1 - moved.sum())
    got = {r["host"]: r["value"] for r in link_rank.propagate(seeds, edges).collect()}
    assert np.allclose([got[n] for n in names], x)


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "benchmark", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
    assert corpus_pipeline.run(spark, sf).count() > 0


# -- operators 11 to 13, and what the operators above learnt ------------------------------

def _words(text):
    return (text or "").translate(_LOWER_ASCII).encode("utf-8", "surrogatepass").split()


_LOWER_ASCII = {i: i + 32 for i in range(65, 91)}


def _shingles(text, words=5):
    parts = _words(text)
    if not parts:
        return set()
    n = min(words, len(parts))
    return {tuple(parts[i:i + n]) for i in range(len(parts) - n + 1)}


def _families(texts, words=5):
    """Brute force: the smallest number reachable by links of Jaccard 0.8."""
    sets = [_shingles(t, words) for t in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_set_join_on_awkward_rows(docs, none):
    rows = _docs()
    tops, sizes = _families([r[1] for r in rows])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[tops[i]] = min(least.get(tops[i], r[0]), r[0])
    want = Counter((r[0], sizes[i], least.get(tops[i]) if sizes[i] else r[0]) for i, r in enumerate(rows))
    assert Counter(map(tuple, set_join.jaccard_components(docs).collect())) == want
    assert set_join.jaccard_components(none).count() == 0


def _template_corpus(seed=4):
    """Families of edited copies, a template that many share, a chain, and pairs at the bound."""
    rng = random.Random(seed)

    def prose(n):
        return [f"{rng.getrandbits(40):x}" for _ in range(n)]

    texts, page, notice = [], prose(120), prose(60)
    for _ in range(150):
        copy = list(page)
        for _ in range(rng.choice([0, 1, 2, 3])):
            copy[rng.randrange(120)] = rng.choice(["x", "y"]) + str(rng.randrange(9))
        texts.append(" ".join(copy))
    texts += [" ".join(notice + prose(40)) for _ in range(150)]
    version = prose(100)
    for _ in range(40):
        version = version[4:] + prose(4)
        texts.append(" ".join(version))
    for n in (5, 9, 24, 54, 104, 203):
        for cut in range(0, n // 3, max(1, n // 30)):
            base = prose(n)
            texts += [" ".join(base), " ".join(base[:n - cut])]
    texts += ["a b", "a  B", "a b c", "A b c d e", "a b c d e", "a b c d e f", "x"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [7, 384])
def test_set_join_is_complete(spark, block):
    texts = _template_corpus()
    tops, sizes = _families(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    joined = set_join.similar(df, block=block)
    families = joined.families.join(joined.texts, "c").select("k1", "k2", "family")
    found = joined.rows.join(families, ["k1", "k2"], "left").collect()
    groups = {}
    for r in found:
        groups.setdefault(r["family"] if r["family"] is not None else ("alone", r["k1"], r["k2"]), []).append(r["doc_id"])
        assert r["n"] == sizes[r["doc_id"]]
    assert sorted(sorted(g) for g in groups.values()) == sorted(
        sorted(i for i, t in enumerate(tops) if t == top) for top in set(tops))


@pytest.mark.parametrize("block", [7, 1024])
def test_superseded_in_order_of_ids(spark, block):
    texts = _template_corpus(5)
    sets = [_shingles(t) for t in texts]
    want, first = [], {}
    for i, a in enumerate(sets):
        if texts[i] in first:
            continue
        first[texts[i]] = i
        if not any(100 * len(a & sets[j]) >= 80 * (len(a) + len(sets[j]) - len(a & sets[j])) for j in want):
            want.append(i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    joined = set_join.similar(df)
    gone = {(r["k1"], r["k2"]) for r in set_join.superseded(joined, block).collect()}
    kept = joined.rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("least")).collect()
    assert sorted(r["least"] for r in kept if (r["k1"], r["k2"]) not in gone) == want


def test_lists_are_merged_with_skips():
    rng = random.Random(2)
    for _ in range(200):
        lists = [sorted(rng.sample(range(40), rng.randrange(1, 15))) for _ in range(rng.randrange(1, 12))]
        for least in range(1, len(lists) + 2):
            counts = Counter(x for one in lists for x in one)
            assert list(set_join.merged(lists, least)) == sorted((x, n) for x, n in counts.items() if n >= least)


def test_work_of_the_set_join_is_bounded(spark):
    """A shared template meets nowhere; a large family is linked by its heads alone."""
    rng = random.Random(6)

    def prose(n):
        return [f"{rng.getrandbits(40):x}" for _ in range(n)]

    notice, page = prose(60), prose(200)
    for n in (200, 400):
        shared = [" ".join(notice + prose(40)) for _ in range(n)]
        family = []
        for i in range(n):
            copy = list(page)
            copy[i % 200] = f"edit{i}"
            family.append(" ".join(copy))
        for texts, most in ((shared, 0), (family, 3 * n)):
            df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
            ids = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "c long, text string")
            sets = set_join._sets(ids.withColumn("n", F.lit(0)), 5).withColumn("n", F.size("tokens"))
            ordered = set_join._ordered(sets)
            assert set_join._meetings(set_join._cells(ordered)).count() <= most
            assert set_join.jaccard_components(df).select("component_id").distinct().count() == (n if most == 0 else 1)


def _rank(documents, items, k=50):
    """Brute force over all documents."""
    import math
    import re

    def terms(text):
        return re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", (text or "").translate(_LOWER_ASCII))

    held = [Counter(terms(t)) for _, t in documents]
    sizes = [sum(c.values()) for c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in held for t in c)
    out = set()
    for item, asked in items.items():
        scored = []
        for (doc, _), c, size in zip(documents, held, sizes, strict=True):
            score = 0
            for t in asked & set(c):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * (1000000000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * size * n // total)))
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out |= {(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:k], 1)}
    return out, terms


@pytest.mark.parametrize("k, block, slices", [(50, 4096, 1 << 20), (3, 5, 7), (1, 1, 1 << 20)])
def test_ranked_search(spark, docs, none, k, block, slices):
    rows = [(r[0], r[1]) for r in _docs()]
    rng = random.Random(1)
    vocabulary = " ".join(t for _, t in rows if t).split()
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 30)))) for i in range(12)]
    items += [(20, "page ONE one"), (20, "words"), (21, None), (22, "?!"), (23, "unknown-term"), (None, "one"), (3, items[3][1])]
    terms = _rank([], {})[1]
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    want, _ = _rank(rows, asked, k)
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("block", F.lit("x")).withColumn("term", F.lit(1))
    index = ranked_search.build_index(docs, block_docs=block)
    got = ranked_search.search(index, table, k, slice_terms=slices).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert ranked_search.search(ranked_search.build_index(none), table).count() == 0
    assert ranked_search.search(index, table.where("false")).count() == 0


def test_accumulators_stop_and_stay_exact():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n, stopped = 500, 0
    for _ in range(20):
        block = ranked_search._Block(pa.array(range(n)), rng.integers(50, 200, n), n, n * 100)
        for w in sorted(rng.integers(1, 8000, 30).tolist(), reverse=True):
            of = np.sort(rng.choice(n, rng.integers(1, n), replace=False)).astype(np.int32)
            block.add(w, of, rng.integers(1, 5, len(of)).astype(np.int32), [7])
        whole = np.zeros(n, np.int64)
        for of, parts in block.lists:
            whole[of] += parts
        held = block.scores(block.by_item[7], 10)
        stopped += (held != whole).any()
        best = np.lexsort((np.arange(n), -whole))[:10]
        got = block.first(10)
        assert sorted(zip(got.column(1).to_pylist(), got.column(2).to_pylist(), strict=True)) == sorted(
            zip(best.tolist(), whole[best].tolist(), strict=True))
    assert stopped


def _trie(rows):
    """Brute force over all prefixes."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    told = {c: [(r, t) for _, r, t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c in told:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(told.get(c - c % 100, [])[:h] + told[c][h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = set()
    for node, cs in members.items():
        below = [x for x in members if x[:len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(y[:-1] == x and y for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below)
        ends = ",".join(str(c) for c in sorted(c for c in cs if built[c] == node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(cs), len(node), parent, len(cs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_conversation_trie(spark):
    rng = random.Random(12)
    rows = []
    for c in [*range(40), *range(100, 130), 7000, 7001, 7099, 350]:
        for turn in range(rng.choice([1, 2, 3, 8, 12])):
            text = rng.choice(["hi", "hello", "", None, "é\u20ac\U0001f600", "x" * 30]) if c % 3 else f"t{turn}"
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]) if c % 2 else "user", text))
    rows += [(5, 3, "user", "tie"), (5, 3, "user", "tie"), (5, 3, "assistant", "tie"), (None, 0, "user", "nobody")]
    rows += [(200, t, "user", f"long {t}") for t in range(60)] + [(201, t, "user", f"long {t}") for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    # names that the operator uses inside
    df = df.withColumns({"d": F.lit("x"), "part": F.lit(1), "grp": F.lit(2), "at": F.lit(3)}).repartition(6)
    got = prefix_trie.conversation_trie(df)
    want = _trie(rows)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    assert prefix_trie.conversation_trie(df.where("false")).count() == 0


def test_prefixes_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_TURNS", 3)
    rows = [(c, t, "user", f"m{t if t < 17 else c}") for c in range(1, 9) for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in prefix_trie.conversation_trie(df).collect()} == _trie(rows)


def test_contraction_of_trees(spark):
    rng = random.Random(4)
    chain = [(i, i - 1 if i else None, 1, i) for i in range(300)]
    bush = [(1000 + i, 1000 + rng.randrange(i) if i else None, 1, rng.randrange(9)) for i in range(200)]
    star = [(2000 + i, 2000 if i else None, 1, i) for i in range(50)]
    nodes = [*chain, *bush, *star, (9999, None, 4, 5)]
    got = {r[0]: (r[1], r[2]) for r in prefix_trie.subtree_totals(
        spark.createDataFrame(nodes, "id long, parent long, a long, b long"), ["a", "b"]).collect()}
    want = {n[0]: [n[2], n[3]] for n in nodes}
    for i, up, *_ in sorted(nodes, reverse=True):
        if up is not None:
            want[up] = [x + y for x, y in zip(want[up], want[i], strict=True)]
    assert got == {i: tuple(v) for i, v in want.items()}


def test_repeated_rows_are_dealt_like_others(spark):
    same = spark.createDataFrame([(7, "same text", "en", "s")] * 3000, "doc_id long, text string, lang string, source string")
    sizes = [r["n"] for r in shards.kd_shards(same, 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.1 * sum(sizes) / 8
    by_bytes = shards.kd_shards(same, target_bytes=6000).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(by_bytes) == 5


def test_first_of_equally_long_rules(spark):
    df = spark.createDataFrame([("x.a.com", "/p")], "host string, path string")
    rules = [("block", "a.com", "/"), ("allow", "a.com", "/"), ("allow", "com", "/")]
    for given, want in ((rules, "block"), ([rules[1], rules[0], rules[2]], "allow")):
        _, verdict = link_rank.rule_of(F.col("host"), F.col("path"), given)
        assert df.select(verdict).first()[0] == want


def test_short_items_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "other words"), (2, "he said"), (3, "so he."), (4, "the"), (5, "C++ is")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "he"), (2, "c++")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.benchmark_matches(docs, items).collect()}
    assert got == {(2, 1), (3, 1), (5, 2)}


def test_words_are_forgotten_and_learnt_again(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    monkeypatch.setattr(token_files, "_TOGETHER", 7)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = token_files.Encoder(f.read())
    rng = random.Random(3)
    pool = ["".join(rng.choices("abcxyzéß'.,-!?0123\u00a0\t\n\u0120", k=rng.randint(1, 9))) for _ in range(300)]
    for _ in range(30):
        texts = [" ".join(rng.choices([*pool, "", "  "], k=rng.randrange(40))) for _ in range(4)]
        want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert list(encoder.encode(texts)) == want
