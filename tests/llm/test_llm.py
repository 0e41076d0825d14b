"""The text operators against brute-force versions, their SQL, and edge rows."""

import collections
import hashlib
import itertools
import math
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from souk.llm import bpe, fingerprints, lm, mixing, pii, quality, queries, rules, simhash, toxicity, wordpiece

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, score string, fp string"
LONG = " ".join(f"word{i % 977} and" for i in range(6000))
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "One two three four five six seven eight nine ten eleven"), (4, "One two three four five six seven eight nine ten eleven"),
        (5, "one TWO three four five six seven eight nine ten eleven"), (None, "no id here"), (None, None), (6, LONG), (7, "é" * 3000), (8, "a"),
        (9, "mail bob.smith@example.com or +1 (244) 555-4688, 4111 1111 1111 1111, 10.0.0.1 and 300.1.1.1"), (10, "same\nsame\nsame\n\n"), (11, "x\x00y\x85z")]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en", None if n % 3 == 0 else f"s{n % 2}", len(t or ""), "a", "b", "c", "d") for n, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda d, n: bpe.encode(d, queries.vocabulary("word_bpe_49k.json"), 100),
    "op2": lambda d, n: lm.score(d),
    "op3": lambda d, n: fingerprints.fingerprints(d),
    "op4": lambda d, n: wordpiece.count_tokens(d, [bytes([b]) for b in range(256)] + [b" on", b"one"]),
    "op5": lambda d, n: toxicity.toxicity(d, n),
    "op6": lambda d, n: pii.personal_data(d),
    "op7": lambda d, n: quality.quality(d, n),
    "op8": lambda d, n: simhash.near_duplicates(d),
    "op9": lambda d, n: mixing.mix_report(d),
    "op10": lambda d, n: rules.rules_report(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_and_empty_table(edge, no_labels, name):
    rows = OPERATORS[name](edge, no_labels).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in EDGE)
    twice = [r for r in rows if r.doc_id == 4]
    same = [c for c in rows[0].asDict() if not c.startswith(("near_", "edited", "source_", "target", "taken"))]    # those depend on other columns or rows
    assert [twice[0][c] for c in same] == [twice[1][c] for c in same]
    assert OPERATORS[name](edge.limit(0), no_labels).collect() == []


def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer
    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    marks = [*"aAbß ÉéΣσİiﬁⅧ½ñ \n\t0१२你好😀-_%", "́", "ͅ", "\x85", "​", "\x1c", "\x00", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'ll", "'S", "the", "ing"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["x" * 5000, "ab" * 400, None, ""]
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, 300, with_text=True).collect()
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.decoded, r.n_tokens) == (ids, decoded, len(ids)), texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_lexicon_fills_when_all_words_are_equally_frequent(spark):
    rows = [(i, " ".join("".join(random.Random(i * 100 + j).choices("abcdefghij", k=9)) for j in range(100))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = bpe.frequent_words(docs, [], 10_000)
    some = bpe.frequent_words(docs, [], 1000)
    assert 900 <= len(some) <= 1000 and set(some) < set(every) and len(set(some)) == len(some)


def test_lexicon_is_minimal_and_exact():
    entries = {w.encode(): np.array([n, n + 1], np.int32) for n, w in enumerate(["tap", "taps", "top", "tops", "a", "stops", "é"])}
    model = bpe.compile_lexicon(entries)
    asked = [*entries, b"ta", b"tapss", b"zzz", b"stop"]
    sizes = np.array([len(w) for w in asked])
    ranks = bpe.look_up(model, np.frombuffer(b"".join(asked), np.uint8), np.cumsum(sizes) - sizes, sizes)
    for w, r in zip(asked, ranks, strict=True):
        assert (r >= 0) == (w in entries)
        if r >= 0:
            assert model["out"][model["out_at"][r]:model["out_at"][r + 1]].tolist() == entries[w].tolist()
    right = {frozenset(w[n:] for w in entries if w[:n] == p) for n in range(6) for p in {w[:n] for w in entries if len(w) >= n}}
    assert len(model["final"]) == len(right)            # one state for each distinct set of endings


def test_language_model_equals_brute_force(spark, sf, docs):
    got = queries.QUERIES["op2_elias_fano_lm"](spark, sf).collect()
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c, pairs = collections.Counter(), collections.Counter()
    for i, w in tokens.items():
        if not held[i]:
            c.update(w)
            pairs.update(zip([None] + w, w, strict=False))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(tokens)
    for r in got:
        w = tokens[r.doc_id]
        p = [(c[x] + 1) / (n + v + 1) for x in w]
        score = sum(math.log10((pairs[a, b] + lm.MU * q) / (c[b"" if a is None else a] + lm.MU)) for a, b, q in zip([None] + w, w, p, strict=False))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(map(math.log10, p)), abs=1e-6)
        assert abs(r.score - score) < 2 / lm.STEP * len(w)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_trie_finds_what_it_holds(tmp_path):
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 400, (5000, 2)), axis=0)
    held = pairs[rng.random(len(pairs)) < 0.5]
    path = tmp_path / "t"
    path.write_bytes(lm.build_trie(held[:, 0], held[:, 1], np.arange(len(held)).astype(np.uint16), held[:, 0].astype(np.uint16)))
    found, prob, back = lm.Trie(str(path)).look_up(pairs[:, 0], pairs[:, 1])
    index = {tuple(p): n for n, p in enumerate(held.tolist())}
    contexts = set(held[:, 0].tolist())
    for p, f, q, b in zip(pairs.tolist(), found, prob, back, strict=True):
        assert f == (tuple(p) in index) and (not f or q == index[tuple(p)]) and (p[0] not in contexts or b == p[0])


@pytest.mark.parametrize("n, top", [(1, 1), (1, 1 << 40), (3, 4), (700, 90), (5000, 1 << 33), (70_000, 1 << 20), (40_000, 300)])
def test_packed_levels_give_and_find_every_value(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    level = lm.EliasFano(lm.EliasFano.build(values, "x"), "x")
    assert level.get(np.arange(n)).tolist() == values.tolist()
    asked = np.concatenate((values, values + 1, rng.integers(0, 2 * top, 3000), [0, top, 4 * top]))
    assert level.search(asked).tolist() == np.searchsorted(values, asked, "left").tolist()
    start, end = (np.full(len(asked), x) for x in (n // 3, n - n // 4))
    assert level.search(asked, start, end).tolist() == np.clip(np.searchsorted(values, asked, "left"), start, end).tolist()


def test_packed_levels_hold_few_bits_a_value():
    values = np.cumsum(np.random.default_rng(3).integers(0, 200, 1_000_000))
    built = lm.EliasFano.build(values, "x")
    level = lm.EliasFano(built, "x")
    held = [a for a in vars(level).values() if isinstance(a, np.ndarray)]
    assert sum(a.nbytes for a in held) * 8 < 10 * len(values)       # 6 low bits, 2 to 3 high bits, samples
    assert all(any(np.shares_memory(a, b) for b in built.values()) for a in held)     # nothing is unpacked


def test_order_minhash(spark, sf, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op3_order_minhash"](spark, sf).collect()}
    by_text = collections.defaultdict(set)
    for n, (i, t) in enumerate(docs):
        following = docs[(n + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        by_text[t].add(got[i].fingerprint)
        a, b, f = got[i].fingerprint, got[i].edited_fingerprint, got[docs[(n + 1) % len(docs)][0]].fingerprint
        size, m = fingerprints.HEX, fingerprints.SKETCHES
        parts = lambda x: [x[size * j:size * (j + 1)] for j in range(m)]
        assert got[i].near_edited == sum(map(str.__eq__, parts(a), parts(b))) / m
        assert got[i].near_next == sum(map(str.__eq__, parts(a), parts(f))) / m
    assert all(len(f) == 1 for f in by_text.values())
    assert np.mean([r.near_edited for r in got.values()]) > 10 * np.mean([r.near_next for r in got.values()])


def test_edited_texts_are_told_from_unrelated_ones(spark, sf):
    got = queries.QUERIES["op3_order_minhash"](spark, sf).collect()
    parts = lambda x: [x[n:n + fingerprints.HEX] for n in range(0, len(x), fingerprints.HEX)]
    assert all(len(parts(r.fingerprint)) == fingerprints.SKETCHES for r in got)
    assert all(r.near_edited == np.mean([a == b for a, b in zip(parts(r.fingerprint), parts(r.edited_fingerprint), strict=True)]) for r in got)
    assert sum(r.near_edited > r.near_next for r in got) >= 0.97 * len(got)


def test_order_matters_to_the_fingerprint(spark):
    words = [f"w{i}" for i in range(200)]
    back = " ".join(words[100:] + words[:100])
    rows = [(1, " ".join(words)), (2, " ".join(words[:190] + [f"v{i}" for i in range(10)])), (3, back)]
    f = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    size = fingerprints.HEX
    same = lambda a, b: sum(f[a][j:j + size] == f[b][j:j + size] for j in range(0, size * fingerprints.SKETCHES, size))
    assert same(1, 2) > same(1, 3)         # the same words in another order are further away than an edit


def test_likeness_follows_edits_as_that_of_the_two_smallest_kmers(spark):
    """One minimum from each of two classes, as the operator draws, against the two smallest of one order."""
    rng, m, trials = random.Random(9), fingerprints.SKETCHES, 24

    def exact(words):
        seen, kmers, out = collections.Counter(), [], []
        for at, gram in enumerate(itertools.pairwise(words)):
            kmers.append((at, *gram, seen[gram]))
            seen[gram] += 1
        for j in range(m):
            least = sorted((xxhash.xxh64_intdigest(f"{a} {b} {n}", j), at) for at, a, b, n in kmers)[:2]
            out.append([h for h, _ in sorted(least, key=lambda d: d[1])])
        return out

    texts = {}
    for t in range(trials):
        words = [f"w{rng.randrange(60)}" for _ in range(150)]           # few words, so k-mers repeat
        texts[t, 0] = words
        for edits in (3, 8, 20, 50):
            changed = list(words)
            for at in rng.sample(range(150), edits):
                changed[at] = f"v{rng.randrange(1000)}"
            texts[t, edits] = changed
        texts[t, "moved"] = words[75:] + words[:75]
    ids = {key: i for i, key in enumerate(texts)}
    frame = spark.createDataFrame([(ids[k], " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    drawn = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(frame).collect()}
    size = fingerprints.HEX
    by_class = {k: [drawn[i][n:n + size] for n in range(0, size * m, size)] for k, i in ids.items()}
    by_order = {k: exact(w) for k, w in texts.items()}
    mean = {e: [np.mean([[a == b for a, b in zip(f[t, 0], f[t, e], strict=True)] for t in range(trials)]) for f in (by_class, by_order)]
            for e in (3, 8, 20, 50, "moved")}
    for variant in (0, 1):
        assert mean[3][variant] > mean[8][variant] > mean[20][variant] > mean[50][variant]
        assert 0.3 < mean["moved"][variant] < 0.7          # the same k-mers in another order
    assert all(abs(a - b) < 0.05 for a, b in mean.values())


def test_an_empty_vocabulary_leaves_words_whole(spark):
    docs = spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string")
    assert {tuple(r) for r in wordpiece.count_tokens(docs, []).collect()} == {(1, 2, 2), (2, 0, 0)}


def test_texts_without_a_digit_are_judged_too():
    import re
    for text in ("fade:cafe:beef:dead:fade:cafe:beef:dead", "write to joe at site dot org", "a b"):
        assert bool(re.search(pii.HINT, text)) or pii.find(text) == ([], [])


def test_longest_match_counts(spark, sf, docs):
    vocabulary = wordpiece.read_pieces(queries.vocabulary("byte_bpe_50k.json"))
    known, most = set(vocabulary), max(map(len, vocabulary))

    def greedy(w):
        n = 0
        while w:
            w = w[next(k for k in range(min(most, len(w)), 0, -1) if w[:k] in known):]
            n += 1
        return n

    got = {r.doc_id: r for r in queries.QUERIES["op4_longest_match_counts"](spark, sf).collect()}
    for i, t in docs[:60]:
        assert got[i].n_tokens == sum(greedy(b" " + w) for w in t.encode().split())


def test_words_out_of_vocabulary_count_once():
    model = wordpiece.compile_automaton([b"ab", b"abcd", b"c"])
    words = [b"abc", b"abcd", b"abx", b"cab", b"abcc", b"d"]
    sizes = np.array([len(w) for w in words])
    assert wordpiece.count_pieces(model, np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes).tolist() == [2, 1, 1, 2, 3, 1]


def _labelled(spark, kind):
    rng = random.Random(5)
    plain = lambda: " ".join(rng.choice("river stone light under green quiet morning paper window".split()) + rng.choice("abcdefgh") for _ in range(60))
    rows = []
    for i in range(400):
        bad, t = i % 4 == 0, plain()
        if bad:
            t = t[:100] + " horrible grublin " + t[100:] if kind == "toxic" else "%%% ### " * 40
        rows.append((i, t, int(bad if kind == "toxic" else not bad)))
    frame = spark.createDataFrame(rows, f"doc_id long, text string, {kind} int")
    return frame.select("doc_id", "text"), frame.select("doc_id", kind), {r[0]: r[2] for r in rows}


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers_on_held_out_rows(spark, kind):
    texts, labels, truth = _labelled(spark, kind)
    got = (toxicity.toxicity if kind == "toxic" else quality.quality)(texts, labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_fitted_classifiers_on_edge_rows(spark, edge, kind):
    texts, labels, _ = _labelled(spark, kind)
    shifted = lambda d: d.withColumn("doc_id", F.col("doc_id") + 1000)
    odd = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (6, 1), (6, 1), (8, 0), (77, 1)], f"doc_id long, {kind} int")
    run = toxicity.toxicity if kind == "toxic" else quality.quality
    rows = run(edge.unionByName(shifted(texts), allowMissingColumns=True), odd.union(shifted(labels))).collect()
    got = [r for r in rows if r.doc_id is None or r.doc_id < 1000]
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in EDGE)
    assert all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows}) > 10        # a fitted model, not the empty one
    score = {i: sorted(r.score for r in got if r.doc_id == i) for i, _ in EDGE}
    assert score[1] == score[2] and score[1][0] in score[None]          # null and empty texts are one case, whatever the id
    assert score[4][0] == score[4][1]


def test_nothing_is_rejected_without_labels(spark, edge):
    for labels in ([], [(1, None), (None, 1)]):
        frame = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert sorted(map(str, toxicity.clean_documents(edge, frame).collect())) == sorted(map(str, edge.collect()))
        assert {r.predicted for r in toxicity.toxicity(edge, frame).collect()} == {0}


def test_flat_trees_equal_a_walk_by_hand():
    rng = np.random.default_rng(2)
    x = rng.random((500, 4))
    model = quality.grow(x, (x[:, 1] + x[:, 2] > 1).astype(float), trees=5)
    start, feature, threshold, left, right, value, roots, _ = model

    def by_hand(row):
        z = start
        for at in roots:
            while left[at] != at:
                at = left[at] if row[feature[at]] <= threshold[at] else right[at]
            z += value[at]
        return 1 / (1 + math.exp(-z))

    assert quality.walk(model, x[:50]).tolist() == pytest.approx([by_hand(r) for r in x[:50]])


def test_personal_data(spark, sf, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op6_weak_pii"](spark, sf).collect()}
    for i, t in docs:
        base = [f"{k}:{m.start()}:{m.end()}" for k in pii.KINDS for m in pii.BASE[k].finditer(t) if pii.valid(k, m[0])]
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
        assert set(base) <= set(got[i].spans.split(","))


def test_personal_data_scan_matches_the_plain_patterns():
    rng = random.Random(5)
    odd = [" at ", " dot ", "4111 1111 1111 1111", "10.0.0.1", "+49 301 2345 67", "joe@x.org", "555-123-4567"]
    for _ in range(3000):
        t = "".join(rng.choice([*rng.choice(["a@.b-_ ", "0123. 5", "0 1-9+()", "12.:af 5(-)"]), *odd]) for _ in range(rng.randint(0, 30)))
        for kind in pii.KINDS:
            assert list(pii.matches(kind, t)) == [m.span() for m in pii.BASE[kind].finditer(t)], t


def test_personal_data_long_runs_and_many_spans():
    assert pii.find("a" * 500_000 + "1") == ([], [])
    assert pii.find("a@" * 200_000) == ([], [])
    base, judged = pii.find("555-123-4567 joe@x.org " * 5_000)
    assert (len(base), len(judged)) == (5_000, 10_000)
    assert pii.valid("ip", "0" * 6_000 + "1.2.3.4")


def test_candidates_are_added_and_redacted(spark):
    rows = [(i, f"write to user{i}@mail.example.com or call +1 (2{i % 10}4) 555-01{i % 10}0 now") for i in range(200)]
    rows += [(900, "contact: jane.doe (at) example (dot) com today, phone (244) 555-4688"), (901, "order 1234567890123456 shipped")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(frame).collect()}
    assert {s.split(":")[0] for s in got[900].split(",")} == {"email", "phone"} and got[901] == ""
    clean = {r.doc_id: r.text for r in pii.redacted_documents(frame).collect()}
    assert clean[900] == "contact: [EMAIL] today, phone [PHONE]" and clean[901] == rows[-1][1]
    assert clean[3] == "write to [EMAIL] or call [PHONE] now"


def test_reliable_labelers_are_told_from_noise():
    rng, counts = random.Random(4), collections.Counter()
    for _ in range(4000):
        y = rng.random() < 0.5
        votes = ["+" if y == (rng.random() < 0.95) else "-" for _ in range(4)] + [rng.choice("+-")]
        counts[0, "".join(votes)] += 1
    prior, given, posterior = pii.expectation_maximisation(counts)
    assert all(given[1, j, 2] > 0.9 and given[0, j, 2] < 0.1 for j in range(4)) and abs(given[1, 4, 2] - given[0, 4, 2]) < 0.1
    assert posterior[0, "++++-"] > 0.95 and posterior[0, "----+"] < 0.05


def test_golay_keys_meet_at_two_errors():
    flips = np.array([0, *(1 << i for i in range(23)), *(1 << i | 1 << j for i, j in itertools.combinations(range(23), 2))])
    words = np.random.default_rng(0).integers(0, 1 << 23, 3000)
    for e in flips:
        (a, n), (b, m) = simhash.segment_keys(words), simhash.segment_keys(words ^ e)
        a, b = np.where(np.arange(6) < n[:, None], a, -1), np.where(np.arange(6) < m[:, None], b, -2)
        assert (a[:, :, None] == b[:, None, :]).any((1, 2)).all()


def _components(fps, bits=4):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def _simhash(text):
    import xxhash
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(spark, sf, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op8_simhash_golay"](spark, sf).collect()}
    fps = [_simhash(t) for _, t in docs]
    roots, least = _components(fps), {}
    for (i, _), r in zip(docs, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    for (i, _), f, r in zip(docs, fps, roots, strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{f:016x}", least[r])


def test_chains_and_large_groups_of_links(spark):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(300):                       # a chain, each 1 to 4 bits from some earlier one, and a large star
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 4)):
            f ^= 1 << b
        fps.append(f)
    centre = rng.getrandbits(64)
    fps = list(dict.fromkeys(fps + [centre ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(30), 2)]))
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r.fp % (1 << 64): r.root for r in simhash.fingerprint_groups(frame).collect()}
    classes = lambda labels: {frozenset(fps[i] for i in range(len(fps)) if labels[i] == x) for x in set(labels)}
    assert classes([got[f] for f in fps]) == classes(_components(fps))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, sf, duck, name):
    frame = queries.QUERIES[name](spark, sf)
    want = duck.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 5}") for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(frame).collect()
    sums = collections.defaultdict(lambda: [0, 0.0])
    for r in out:
        sums[r.doc["source"]][0] += r.taken
        sums[r.doc["source"]][1] = r.target
        assert r.taken <= 2 * r.size
    assert all(abs(t - g) <= 0.1 * g for t, g in sums.values())
    assert sum(g for _, g in sums.values()) == pytest.approx(1.5 * sum(r.size for r in out))
    assert mixing.mixed_documents(frame).count() == sum(r.copies for r in out)


def test_rule_order_changes_no_verdict(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    verdicts = [dict(rules.cascade(frame, order).select("doc.doc_id", "kept").collect()) for order in (rules.RULES, rules.RULES[::-1])]
    assert verdicts[0] == verdicts[1] and any(verdicts[0].values()) and not all(verdicts[0].values())


def test_pipeline_stages(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet").withColumn("row", F.lit(1))
    before = {r.doc_id: r for r in frame.collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, frame, sf)
        rows = after.collect()
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in queries.QUERIES["op5_toxicity"](spark, sf).collect()}
            assert {r.doc_id for r in rows} == {i for i in before if not scores[i]}
        elif name == "near_duplicates":
            ids = sorted(before)
            roots = _components([_simhash(before[i].text) for i in ids])
            assert {r.doc_id for r in rows} == {min(i for i, x in zip(ids, roots, strict=True) if x == root) for root in set(roots)}
        elif name == "personal_data":
            assert {r.doc_id for r in rows} == set(before)
            assert all(not pii.BASE["email"].search(r.text) and r.n_chars == len(r.text) for r in rows)
        elif name == "mixing":
            copies = {r.doc["doc_id"]: r.copies for r in mixing.mix(frame).collect()}
            assert collections.Counter(r.doc_id for r in rows) == collections.Counter({i: n for i, n in copies.items() if n})
        else:
            assert {r.doc_id for r in rows} == set(before) and all(len(r.ids) == r.n_tokens for r in rows)
            break
        assert after.columns == frame.columns
        frame, before = after, {r.doc_id: r for r in rows}
        frame = corpus_pipeline.store(frame, name)


def test_pipeline_on_edge_rows(spark, edge, sf):
    frame = edge
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.store(stage(spark, frame, sf), name)
        assert frame.columns == edge.columns
    assert corpus_pipeline.STAGES[-1][1](spark, frame, sf).count() == frame.count() > 0
    empty = edge.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_rules_are_ordered_by_their_own_cost(spark):
    frame = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(400))) for i in range(100)], "doc_id long, text string")
    dear = rules.Rule("dear", "length(regexp_replace(whole, '[^\\\\p{L}]', '')) < 0")
    half = rules.Rule("half", "pmod(xxhash64(whole), 2) = 0")
    cheap, never = rules.Rule("cheap", "n_words < 0"), rules.Rule("never", "n_words >= 0")
    got = rules.order_rules(frame, [dear, never, half, cheap])
    assert [r.name for r, _, _ in got][0] == "cheap" and got[-1][0].name == "never"
    cost, rejected = {r.name: c for r, c, _ in got}, {r.name: x for r, _, x in got}
    assert cost["dear"] > 5 * cost["cheap"] and rejected["cheap"] == rejected["dear"] == 1 and rejected["never"] == 0
    odd = frame.where("pmod(xxhash64(text), 2) <> 0").count() / 100
    assert rejected["half"] == pytest.approx(odd)
    assert [r.name for r, _, _ in rules.order_rules(frame.limit(0), [dear, cheap])] == ["dear", "cheap"]


def obfuscated_corpus(n=250, seed=8):
    """(rows, kind and span of each planted item) : n items of each kind in forms the base patterns miss, and
    n decoys of each kind of the same shape, each in its own text, half of either beside a telling word."""
    rng, rows, planted = random.Random(seed), [], set()
    filler = "tide lamp orchard gravel seven window carpet river stone market evening basket".split()

    def card(good):
        while True:
            d = rng.choice(["4", "51", "53", "55", "2221", "6011", "56"])        # first digits that issuers hold
            d += "".join(rng.choice("0123456789") for _ in range(16 - len(d)))
            if pii.luhn(d) == good:
                sep = rng.choice([".", "/", "–", "  "])
                return sep.join(d[i:i + 4] for i in range(0, 16, 4))

    def mail(good):
        at, dot = rng.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot ")])
        last = rng.choice(["com", "org", "net", "de"]) if good else rng.choice(filler)
        return f"{rng.choice(filler)}{rng.randint(1, 99) if good else ''}{at}{rng.choice(filler)}{dot}{last}"

    def address(good):
        if good:
            return ":".join([rng.choice(["2001", "2a02", "fe80", "fd12"])] + [f"{rng.randrange(1 << 16):x}" for _ in range(7)])
        return ":".join(f"{rng.randrange(256):02x}" for _ in range(8))

    def phone(good):
        head = f"{rng.choice('23456789' if good else '01')}{rng.randint(10, 99)}"
        return rng.choice([f"({head}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}", f"{head}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"])

    cues = {"email": "contact:", "ip": "server address", "card": "my visa card", "phone": "please call"}
    make = {"email": mail, "ip": address, "card": card, "phone": phone}
    for kind in pii.KINDS:
        for i in range(2 * n):
            good = i % 2 == 0
            words = [rng.choice(filler) for _ in range(12)]
            told = (cues[kind] if good else rng.choice(["serial", "order", "invoice", "isbn"])) if rng.random() < 0.5 else "and"
            head, item = " ".join(words[:6]) + f", {told} ", make[kind](good)
            if good:
                planted.add((len(rows), f"{kind}:{len(head)}:{len(head) + len(item)}"))
            rows.append((len(rows), f"{head}{item}, {' '.join(words[6:])}"))
    rows += [(len(rows) + i, f"write to joe{i}@mail.example.com or +1 (244) 555-{1000 + i} from 10.0.{i % 200}.7") for i in range(n)]
    return rows, planted


def test_added_spans_have_recall_and_precision(spark):
    rows, planted = obfuscated_corpus()
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    text = dict(rows)
    base = {(i, f"{k}:{m.start()}:{m.end()}") for i, t in rows for k in pii.KINDS for m in pii.BASE[k].finditer(t) if pii.valid(k, m[0])}
    added = {(r.doc_id, s) for r in got for s in r.spans.split(",") if s} - base
    assert not planted & base
    for kind in pii.KINDS:
        want, have = ({x for x in part if x[1].startswith(kind)} for part in (planted, added))
        assert len(want) >= 200
        right = len(want & have)
        assert right / len(want) >= 0.9 and right / max(len(have), 1) >= 0.9, (kind, right, len(want), len(have), [text[i] for i, _ in (want ^ have)][:5])


def test_labelers_disagree_on_planted_items(spark):
    rows, planted = obfuscated_corpus()
    spans = {i for i, _ in planted}
    votes = collections.Counter((i in spans, v) for i, t in rows for *_, base, v, _ in pii.find(t)[1] if base != 1)
    for j, name in enumerate(pii.LABELERS):
        if name in ("range", "gazetteer", "context"):
            assert {v[j] for _, v in votes} >= {"+", "-"}, name
    assert len({v for _, v in votes}) >= 8
    counts = collections.Counter((k, v) for _, t in rows for k, _, _, _, v, _ in pii.find(t)[1])
    given = pii.expectation_maximisation(counts)[1]
    context = pii.LABELERS.index("context")
    assert given[1, context, 2] > 2 * given[0, context, 2] and given[0, context, 0] > 2 * given[1, context, 0]


def test_key_runs_that_cross_batches(spark):
    """Groups found with Arrow batches of 64 key rows, one task, equal those of a brute-force closure."""
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for s in seeds for _ in range(12)}
    fps |= {seeds[0] ^ (1 << a | 1 << b) for a, b in itertools.combinations(range(43, 64), 2)}        # one long run
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = dict(simhash.fingerprint_groups(spark.createDataFrame([(f,) for f in signed], "fp long")).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= simhash.MAX_BITS:
            root[find(a)] = find(b)
    assert len(got) == len(signed)
    assert len({(find(f), got[f]) for f in signed}) == len({find(f) for f in signed}) == len(set(got.values()))


def test_word_shards_follow_the_bytes(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"alpha beta w{i % 37} gamma x{i}") for i in range(300)], "doc_id long, text string").repartition(3)
    few = sorted(lm.score(frame).collect())
    monkeypatch.setattr(lm, "WORD_SHARD_BYTES", 64)
    many = sorted(lm.score(frame).collect())
    assert [r[:5] for r in few] == [r[:5] for r in many]
    assert [r.score for r in few] == pytest.approx([r.score for r in many], abs=1e-3)


def test_simhash_keys_are_made_in_many_tasks_with_small_tables(spark):
    # Before, the few bytes of the fingerprints were merged into one task that wrote all key rows, and each worker built the
    # syndromes through whole 32-bit temporaries.
    import tracemalloc
    simhash.syndromes.cache_clear()
    tracemalloc.start()
    table = simhash.syndromes()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 << 20 and table.dtype == np.int16
    for word in (0, 1, 5, 1 << 22, (1 << 23) - 1, 1234567):
        x = word
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= simhash.GENERATOR << (i - 11)
        assert table[word] == x
    distinct = spark.range(4000).select(F.xxhash64("id").alias("fp")).distinct()
    per_task = simhash.key_rows(distinct, int(spark.conf.get("spark.sql.shuffle.partitions"))).groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == 8 and max(r["count"] for r in per_task) < sum(r["count"] for r in per_task) / 4
