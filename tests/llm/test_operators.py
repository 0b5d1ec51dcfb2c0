"""Every operator against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import byte_bpe, exact_dedup, jaccard, mixing, repeats, sharding, shared, token_orc, topk, toxicity, wrappers

SCHEMA = "doc_id long, text string, source string, size long, shard int, digest string, n long"


def documents(spark, rows):
    """rows of (doc_id, text, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 7, 1, "x", 3) for i, t, s in rows], SCHEMA)


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


ROWS = [
    (1, "The cat", "b"), (2, "the CAT", "a"), (3, None, None), (4, "", "a"), (5, "Ärger ÉTÉ", "a"), (6, "ärger ÉTÉ", "b"), (7, "the cat", None),
    (8, "x " * 40_000, "c"), (9, "X " * 40_000, "c"), (10, " \t\n", "ü"), (11, "the cat sat", "a"), (11, "the cat sat", "a"), (None, "null id", "b"), (12, "null ID", "b"),
]


def groups(rows):
    out = collections.defaultdict(list)
    for i, t, _ in rows:
        out[fold(t)].append(i)
    return out


@pytest.mark.parametrize("digest", [None, lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1), lambda text: F.lit("same")])
def test_exact_dedup_with_and_without_collisions(spark, digest):
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup(documents(spark, ROWS), digest=digest).collect())
    want = collections.Counter()
    for i, t, _ in ROWS:
        ids = groups(ROWS)[fold(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want[(i, keep, len(ids), i == keep, hashlib.sha256(fold(t).encode()).hexdigest())] += 1
    assert got == want


def test_exact_dedup_survivors_and_lookup(spark):
    docs = documents(spark, ROWS)
    left = exact_dedup.survivors(docs)
    assert left.columns == docs.columns
    texts = [fold(r.text) for r in left.collect()]
    assert sorted(texts) == sorted(groups(ROWS))
    index = exact_dedup.compact(exact_dedup.flush(docs))
    assert exact_dedup.compact(index).count() == index.count() == len(groups(ROWS))


def test_exact_dedup_index_grows_by_levels(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN", 2)
    levels = []
    assert [r.known for r in exact_dedup.lookup(levels, documents(spark, ROWS[:1])).collect()] == [False]
    for part in (ROWS[:3], ROWS[3:8], ROWS[8:]):
        levels = exact_dedup.ingest(levels, documents(spark, part))
    assert [len(x) for x in levels] == [1, 1]
    new = documents(spark, [(100, "THE CAT", "z"), (200, "never seen", "z"), (300, None, "z"), (400, "x " * 40_000, "z")])
    found = exact_dedup.lookup(levels, new)
    assert {r.doc_id: (r.known, r.smallest) for r in found.collect()} == {100: (True, 1), 200: (False, None), 300: (True, 3), 400: (True, 8)}
    assert {(r.doc_id, r.smallest) for r in exact_dedup.verified(found, new, documents(spark, ROWS)).collect()} == {(100, 1), (300, 3), (400, 8)}
    digest = hashlib.sha256(b"the cat").hexdigest()
    assert [(r.smallest, r.largest, r.n) for r in exact_dedup.find(levels, [digest]).collect()] == [(1, 7, 3)]


def word_sets(text, words):
    """Shingle sets by the contract's own words, without the operator's code."""
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute_components(rows, words, num, den):
    sets = [word_sets(t, words) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    members = collections.defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(rows[k][0])
    return {rows[k][0]: (len(sets[k]), min(members[find(k)])) for k in range(len(rows))}


@pytest.mark.parametrize(("words", "num", "task_tokens", "rest_tokens"), [(3, 90, 2_000_000, 1), (5, 80, 300, 0), (5, 80, 300, 10**6)])
def test_ngram_jaccard(spark, words, num, task_tokens, rest_tokens):
    rng, rows = random.Random(words), []
    for _ in range(14):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([1, 2, 3, 9, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 4, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"v{rng.randrange(2000)}"
            rows.append((len(rows), rng.choice([" ", "\n", "\u00a0 ", " É"]).join(w), "s"))
    rows += [(len(rows), None, "s"), (len(rows) + 1, "", "s"), (len(rows) + 2, " \t", "s"), (len(rows) + 3, "A B C d " * 5000, "s"), (len(rows) + 4, "a b c D " * 5000, "s")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(documents(spark, rows), words, num, 100, task_tokens=task_tokens, rest_tokens=rest_tokens).collect()}
    assert got == brute_components(rows, words, num, 100)


def test_jaccard_keys_keep_every_link():
    rng = np.random.default_rng(4)
    for num in (50, 80, 90):
        t = jaccard.Threshold(num, 100)
        for _ in range(300):
            a = np.unique(rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64) * np.uint64(2))
            keep = a[rng.random(len(a)) < rng.choice([0.9, 0.97, 1.0])]
            b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and t.linked(both, len(a), len(b)):
                shared = set(np.concatenate(t.keys(a)).tolist()) & set(np.concatenate(t.keys(b)).tolist())
                for n in (len(a), len(b)):
                    smallest = -(-n * num // 100)
                    assert len(shared) >= 1 + ((n + smallest) * (100 - num) // (100 + num) + 1) // 4


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 80)]
    edges = spark.createDataFrame(chain + hub + [(5, 5)], "u long, v long")
    got = {r.node: r.root for r in shared.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(80)}}


def test_hypergeometric_beyond_the_library(spark):
    rng = np.random.default_rng(1)
    big = [sharding.hypergeometric(rng, 6 * 10**9, 4 * 10**9, 10**9) for _ in range(40)]
    assert abs(np.mean(big) / 6e8 - 1) < 1e-3 and np.std(big) < 60_000
    matrix = sharding.communication_matrix([5, 0, 17, 30], 8, 3)
    assert matrix.sum(axis=1).tolist() == [5, 0, 17, 30] and sorted(matrix.sum(axis=0).tolist()) == [6] * 4 + [7] * 4


def test_sharding(spark):
    rows = documents(spark, [(i, "t" * (i % 5), "s") for i in range(403)] + [(7, "t" * 2, "s"), (None, None, None)]).select("doc_id", "text")
    rows = shared.stored(rows, "t")
    got = sharding.shard(rows).collect()
    again = sharding.shard(rows).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == 405
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert sorted(per) == list(range(8)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


def test_sharding_query(spark, tmp_path):
    """The registered query's own columns and law."""
    documents(spark, [*ROWS, (500, "é", "s")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.query(spark, str(tmp_path)).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in [*ROWS, (500, "é", "s")])
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert set(per) <= set(range(8)) and max(map(len, per.values())) <= -(-len(got) // 8)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


def test_byte_bpe_tree_agrees_with_the_whole(monkeypatch):
    import re

    tool = byte_bpe.codec(byte_bpe.default_path())
    monkeypatch.setattr(byte_bpe, "LEAF_CHARS", 16)
    monkeypatch.setattr(byte_bpe, "LEAF_BYTES", 6)
    monkeypatch.setattr(byte_bpe, "LEAF_TOKENS", 5)
    monkeypatch.setattr(byte_bpe, "RUN", re.compile(r"\S{12}"))
    rng = random.Random(2)
    for _ in range(600):
        alphabet = rng.choice(["ab ", "'lsvt  \n", "é ñaz0 1.", "a", "  \n\t x", "the ing tion", "漢字 a　", "<|endoftext|> "])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(300)))
        ids = tool.encode(text)
        assert ids == tool.core.encode_ordinary(text) and tool.decode(ids) == text.encode()


def test_byte_bpe_rows(spark):
    rows = [*ROWS, (20, "<|endoftext|> it's", "s"), (21, "z" * 30_000, "s")]
    tool = byte_bpe.codec(byte_bpe.default_path())
    two = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(documents(spark, rows)))).collect()
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(byte_bpe.round_trip(documents(spark, rows))).collect())
    assert got == collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in two)
    want = collections.Counter()
    for i, t, _ in rows:
        ids = np.asarray(tool.core.encode_ordinary(t or ""), "<u4")
        want[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 20, 60])), rng.choice(["a", "a", "a", "b", "é", None])) for i in range(600)] + ROWS
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sums, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sums[r.target] += r.size
        taken[r.target] += r.taken
        target[r.target] = r.source_size
        assert 0 <= r.taken <= 3 * r.size
    total = sum(sums.values())
    assert abs(sum(t for t in target) - total) < 1e-6 * total or all(t == 3 * s for t, s in target.items())
    for t in target:
        assert t <= 3 * target[t] + 1e-9
        assert abs(taken[t] - t) <= 60 * 3 + 0.05 * t or target[t] > 10_000
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(documents(spark, rows)).collect()))


def brute_repeats(rows, length):
    seen, out = collections.Counter(), collections.Counter()
    texts = [(t or "").encode() for _, t, _ in rows]
    for b in texts:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    for (i, _, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[(i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("hot", "known"), [(8 << 20, 1 << 23), (600, 1 << 23), (600, 0)])
def test_repeated_passages(spark, monkeypatch, hot, known):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(30, 90))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice([rng.choice(pool), "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 60))), "for " * rng.randint(1, 30), "x" * rng.randint(1, 80)]) for _ in range(rng.randint(0, 8))]
        rows.append((i, "".join(parts), "s"))
    rows += [(300, None, "s"), (301, "", "s"), (302, rows[5][1], "s"), (302, rows[5][1], "s"), (303, rows[7][1], "s"), (303, "zz", "s"), (304, "x" * 3000, "s"), (None, rows[8][1], "s")]
    monkeypatch.setattr(repeats, "CHUNK", 256)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 500)
    out = repeats.remove(documents(spark, rows), 40, 10, period=8, hot_bytes=hot, broadcast_buckets=known).collect()
    got = collections.Counter((r.doc_id, r.n_bytes, sum(s.high - s.low for s in r.spans), len(r.spans), r.kept_sha256) for r in out)
    assert got == brute_repeats(rows, 40)


def test_repeated_passages_of_copies_without_an_id(spark):
    rng = random.Random(12)
    a, b, c, d = ("".join(rng.choice("abcdeé ") for _ in range(90)) for _ in range(4))
    rows = [(None, a + b, "s"), (None, a + b, "s"), (None, a + b, "s"), (1, c + b, "s"), (2, a, "s"), (None, d, "s"), (3, d[:70], "s"), (4, c[10:60], "s")]
    out = repeats.remove(documents(spark, rows), 40, 10, period=8).collect()
    got = collections.Counter((r.doc_id, r.n_bytes, sum(s.high - s.low for s in r.spans), len(r.spans), r.kept_sha256) for r in out)
    assert got == brute_repeats(rows, 40)


def test_repeated_passages_end_at_400_bytes(spark, tmp_path):
    """Through the query: 399 bytes stay, though they are over 50 words; 400 go."""
    rng = random.Random(31)
    words = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(3, 6))) for _ in range(n))
    sized = lambda n: next(x for x in iter(lambda: words(200).encode()[:n].decode(errors="ignore"), None) if len(x.encode()) == n)
    below, at = sized(399), sized(400)
    assert min(len(below.split()), len(at.split())) > 50
    rows = [(1, f"1{below}2", "s"), (2, f"{words(90)} 3{below}4 {words(20)}", "s"), (3, f"5{at}6", "s"), (4, f"{words(90)} 7{at}8", "s"), (5, words(300), "s")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = repeats.query(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in out} == {1: (0, 0), 2: (0, 0), 3: (400, 1), 4: (400, 1), 5: (0, 0)}
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute_repeats(rows, 400)


def test_difference_cover_settles_ties():
    rng = random.Random(3)
    for period in (8, 16):
        chosen = repeats.cover(period).tolist()
        assert {(a - b) % period for a in chosen for b in chosen} == set(range(period)) and len(chosen) == {8: 4, 16: 5}[period]
        length = 5 * period
        for _ in range(60):
            base = bytes(rng.choice(b"ab\x00\xff") for _ in range(4 * length))
            parts = []
            for _ in range(rng.randint(1, 8)):
                part = bytearray(base[(a := rng.randrange(length)) : a + length + rng.randrange(2 * length)])
                part[rng.randrange(len(part))] ^= rng.choice([0, 0, 1])
                parts.append(bytes(part) if rng.random() < 0.8 else b"\x00" * len(part))
            bucket = np.array([rng.randrange(2) for _ in parts])
            want = collections.Counter((b, x[k : k + length]) for b, x in zip(bucket.tolist(), parts, strict=True) for k in range(len(x) - length + 1))
            got = repeats.repeated(parts, bucket, length, period).tolist()
            assert got == [want[b, x[k : k + length]] > 1 for b, x in zip(bucket.tolist(), parts, strict=True) for k in range(len(x) - length + 1)]


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "ba be bi bo bu da de di do du".split() for b in "ka ke ki ko ku la le li lo lu".split()]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        bad = i % 6 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["Nasty", "vile,", "grubsome", "grubling"])
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(bad)))
    docs = documents(spark, [*rows, (901, None, None), (902, "", None), (None, "kaka", None)])
    marks = spark.createDataFrame([*labels, (3, None), (None, 1), (5000, 1), (0, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, marks).collect()}
    assert len(got) == 903 and got[901].score == got[902].score and got[901].predicted == 0
    held = [(r.predicted, labels[i][1]) for i, r in got.items() if i is not None and i < 900 and r.held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(900))
    assert len(held) > 100 and sum(p == y for p, y in held) / len(held) > 0.97
    clean = toxicity.accepted(docs, toxicity.fit(docs, marks))
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if r.score < 0.5}


def test_ftrl_agrees_with_a_dense_one():
    """The published per-coordinate update, written for whole vectors."""
    rng = np.random.default_rng(5)
    ours, size = toxicity.Ftrl(bits=5), 33
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(400):
        at = np.unique(rng.integers(0, 32, rng.integers(0, 6)))
        label = int(at.sum() % 3 == 0)
        x = np.zeros(size)
        x[at], x[-1] = 1, 1
        l1 = np.full(size, toxicity.L1)
        l1[-1] = 0
        w = np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((toxicity.BETA + np.sqrt(n)) / toxicity.ALPHA + toxicity.L2))
        g = (1 / (1 + np.exp(-(w @ x))) - label) * x
        sigma = (np.sqrt(n + g**2) - np.sqrt(n)) / toxicity.ALPHA
        z, n = z + g - sigma * w, n + g**2
        ours.learn(at, label)
    assert np.allclose(ours.z, z) and np.allclose(ours.n, n) and np.abs(z).max() > toxicity.L1


def test_toxicity_scorer_agrees_with_the_features():
    rng = np.random.default_rng(2)
    at = np.unique(rng.integers(0, 1 << toxicity.BITS, 300_000))
    weights = rng.normal(size=len(at)).astype(np.float32)
    dense = np.zeros(1 << toxicity.BITS)
    dense[at] = weights
    scorer = toxicity.Scorer((at, weights, 0.25))
    for text in ["", "a", "one Two, one two three", "été ÉTÉ Straße x-y", "la " * 50]:
        want = 1 / (1 + np.exp(-np.clip(0.25 + dense[toxicity.features(text)].sum(), -35, 35)))
        assert abs(scorer.score(text) - want) < 1e-12


def test_token_orc_words_agree_with_the_library(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_orc, "CACHE_WORDS", 300)
    tool = token_orc.Words(token_orc.default_path())
    rng = random.Random(7)
    alphabets = ["abcABC' sStT.,!? 12", "éÉ ñÑ ẞßIiİı ", "Σσς ab", "漢字 　\xa0\x85 \x1c\x00a", "<|endoftext|> a<|startoftext|>b", "é å ½²", "👍🏽 ‍ a-b_c"]
    for size in (1, 3, 40) * 10:
        texts = ["", " \t\n", *("".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(40))) for _ in range(size)), " a  b\x0b\x0c"]
        many, ids = tool.ids(pa.array(texts))
        want = [x.ids for x in tool.whole.encode_batch(texts, add_special_tokens=False)]
        assert many.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    for part in (pa.array([]).cast(pa.string()), pa.array(["x", "a b", "c"]).slice(1)):
        many, ids = tool.ids(part)
        assert many.tolist() == [len(x.ids) for x in tool.whole.encode_batch(part.to_pylist(), add_special_tokens=False)] and len(ids) == many.sum()


def test_token_orc_files(spark):
    target = shared.scratch(spark, "t-orc")
    token_orc.write(documents(spark, ROWS), target)
    back = token_orc.read(spark, target)
    assert token_orc.read(spark, target, [5, 6]).count() == 2
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_orc.starts(shared.stored(token_orc.checked(back), "t")).collect()), key=lambda x: x[2])
    tool, at, want = token_orc.words(token_orc.default_path()), 0, []
    for i, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.asarray([*tool.whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i is not None, i or 0, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


PAGES = [
    "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class='ad'>Buy</div><article><h1>Head &amp; tail</h1><p>One  <b>two</b>\nthree.<p>Four</p><aside>Side</aside></article><footer>Foot</footer></body></html>",
    "<html><head><title>u</title></head><body><nav><ul><li><a href=y>A</a></li><li><a href=z>B</a></li></ul></nav><div class='ad'>Sell</div><article><h1>Second</h1><p>Only &lt;b&gt; this<br>line</p><section class=comments><p>I disagree</p></section></article><footer>Foot</footer>",
    "<html><body><nav>N</nav><article><h1>Third</h1><form>Name <input></form><script>var x='<p>no</p>'</script><ul><li>i</li><li>j</li></ul></article></body></html>",
]
TEXTS = ["Head & tail\nOne two three.\nFour", "Second\nOnly <b> this\nline", "Third\ni\nj"]


def test_html_wrappers(spark):
    rows = [(k, f"http://h.example/{k}", p, 1, "w") for k, p in enumerate(PAGES * 3)] + [(50, None, None, 1, "w"), (51, "odd", "just text", 1, "w"), (52, "http://h.example/0", PAGES[0], 1, "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int, wrapper string")
    got = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    assert [got[k] for k in range(9)] == TEXTS * 3 and got[50] == "" and got[51] == "just text" and got[52] == TEXTS[0]


@pytest.mark.parametrize("count", [1, 2, 3, 40])
def test_html_wrappers_of_copied_pages(spark, count):
    copy, near = "<body><h1>T</h1><p>Text</p></body>", "<body><h1>T</h1><p>A paragraph of some length</p><p>no. {}</p></body>"
    rows = [(k, "http://copies.example/", copy) for k in range(count)] + [(1000 + k, f"http://near.example/{k}", near.format(k)) for k in range(count)]
    rows += [(2000 + k, None, "just text") for k in range(count)] + [(3000 + k, "odd", f"<p>just text</p><p>{'word ' * 9}{k}</p>") for k in range(count)]
    rows += [(4000 + k, f"http://site.example/{k}", f"<h1>Same title</h1><p>Story {k} goes on</p><p>Our site</p>") for k in range(count)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    for k in range(count):
        assert got[k] == "T\nText" and got[1000 + k] == f"T\nA paragraph of some length\nno. {k}"
        assert got[2000 + k] == "just text" and got[3000 + k] == f"just text\n{'word ' * 9}{k}"
        assert got[4000 + k].startswith(f"Same title\nStory {k} goes on")


@pytest.mark.parametrize("count", [1, 2, 5])
def test_html_wrappers_frame_starts_at_the_outermost_main_element(spark, count):
    post = "<article id='post-{0}' class='post c{0}'><h1>Title {0}</h1><p>Lead {0}</p><div class='entry-content'><p>Body {0}</p></div><p>After {0}</p></article><div class='x'>Out {0}</div>"
    either = ["<main><h1>Title {0}</h1><div class='entry-content'>Body {0}</div></main>", "<article><h1>Title {0}</h1><div class='entry-content'>Body {0}</div></article>"]
    rows = [(k, f"http://ids.example/{k}", post.format(k)) for k in range(count)] + [(100 + k, f"http://mixed.example/{k}", either[k % 2].format(k)) for k in range(count)]
    rows += [(200 + k, f"http://nested.example/{k}", f"<nav><div class='post'>Menu</div></nav><section id='s{k}' class='post n{k}'><h1>Title {k}</h1><article>Body {k}</article></section>") for k in range(count)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(count):
        assert got[k] == f"Title {k}\nLead {k}\nBody {k}\nAfter {k}"
        assert got[100 + k] == got[200 + k] == f"Title {k}\nBody {k}"


def test_html_wrappers_drop_what_all_pages_of_a_host_share(spark):
    article = "<article><h1>Story {0}</h1>{1}<h2>Notes</h2><p>Seen <b>by</b> {0}</p><p>Get our app</p></article>"
    menu = "<body><div class='c2'><ul><li>Home</li><li>About</li></ul></div><div class='c3'><p>Text of page {0}</p>{1}</div></body>"
    more = ["".join(f"<p>Paragraph {k} {n}</p>" for n in range(k % 3)) for k in range(9)]
    rows = [(k, f"http://a.example/{k}", article.format(k, more[k])) for k in range(9)] + [(100 + k, f"http://b.example/{k}", menu.format(k, more[k])) for k in range(9)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    for k in range(9):
        extra = [f"Paragraph {k} {n}" for n in range(k % 3)]
        assert got[k].split("\n") == [f"Story {k}", *extra, "Notes", f"Seen by {k}"]
        assert got[100 + k].split("\n") == [f"Text of page {k}", *extra]


def test_wrapper_edges_do_not_depend_on_order():
    rng = random.Random(11)
    draw = lambda: "".join(rng.choice(["<p>a</p>", "<p>b</p>", "<h1>t</h1>", "<i>", "x", "<div class=c>same</div>"]) for _ in range(rng.randint(1, 9)))
    for _ in range(300):
        pages = [wrappers.from_page(wrappers.tokens(f"<b>{draw()}</b><u>{draw()}</u>")) for _ in range(3)]
        a, b, c = pages
        one, other = wrappers.align(wrappers.align(a, b), c), wrappers.align(a, wrappers.align(c, b))
        if one["tags"] == other["tags"]:  # crossing tags can leave another choice of tags
            assert [(s["head"], s["tail"], s["whole"]) for s in one["slots"]] == [(s["head"], s["tail"], s["whole"]) for s in other["slots"]]


def test_wrapper_alignment_does_not_depend_on_order():
    pages = [wrappers.from_page(wrappers.tokens(p)) for p in PAGES]
    show = lambda order: wrappers.expression(wrappers.align(wrappers.align(pages[order[0]], pages[order[1]]), pages[order[2]]))
    assert "(<li> <a> #TEXT </a> </li>)+" in show([0, 1, 0]) and "<article>" in show([0, 1, 2])
    assert {show(o) for o in ([0, 1, 2], [1, 0, 2], [2, 1, 0], [2, 0, 1])} == {show([0, 1, 2])}


def test_exact_top_k(spark):
    rng = np.random.default_rng(8)
    vectors = {i: np.floor(256 * rng.normal(size=6).astype(np.float32).astype(float)) / 256 for i in range(400)}
    vectors[60] = vectors[61] = vectors[59]
    rows = [(i, [float(x) for x in v], 0, 0) for i, v in vectors.items()]
    rows += [(1000, None, 0, 0), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, 0), (1002, [float("nan")] * 6, 0, 0), (1050, [float("inf")] * 6, 0, 0), (None, [9.0] * 6, 0, 0)]
    table = topk.whole(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, shard int"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(table, table.where("vec_id % 50 = 0")).collect()}
    ints = {i: np.floor(256 * v.astype(np.float32).astype(float)) for i, v in vectors.items()}
    want = {}
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-int(ints[q] @ ints[i]), i) for i in ints if i != q)[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    blocks = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(table, table.where("vec_id % 50 = 0"), shard_rows=8, query_block=3).collect()}
    assert blocks == want
    few = table.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2


def test_exact_top_k_of_one_common_vector_and_of_huge_components(spark):
    rows = [(i, [0.5, 1.0] if i % 3 else [i / 256, -1.0]) for i in range(300)]
    table = topk.whole(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_k(table, table.where("vec_id % 50 = 0"), shard_rows=4).collect()
    whole = {i: (np.floor(256 * np.float32(x).astype(float)), np.floor(256 * np.float32(y).astype(float))) for i, (x, y) in rows}
    for q in range(0, 300, 50):
        best = sorted((-int(whole[q][0] * whole[i][0] + whole[q][1] * whole[i][1]), i) for i in whole if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in best]
    rows = [(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [-3e38, 0.0]), (3, [1.0, 1.0]), (50, [1e20, -1e20])]
    table = topk.whole(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    ints = {i: [int(256 * float(np.float32(x))) for x in v] for i, v in rows}
    got = topk.top_k(table, table.where("vec_id % 50 = 0"), shard_rows=2).collect()
    for q in (0, 50):
        clamp = lambda s: max(-topk.MOST, min(topk.MOST, s))
        best = sorted((-clamp(sum(a * b for a, b in zip(ints[q], ints[i], strict=True))), i) for i in ints if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in best]


def test_kd_tree_prunes_and_stays_exact(monkeypatch):
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    rng = np.random.default_rng(9)
    points = rng.integers(-50, 50, (500, 3)).astype(float)
    tree = topk.Tree(points, np.arange(500))
    queries = rng.integers(-50, 50, (40, 3)).astype(float)
    for q, hits in zip(queries, tree.search(queries, np.full(40, -1), np.full(40, -np.inf), 5), strict=True):
        assert [(s, -i) for s, i in hits] == [(float(points[i] @ q), i) for i in sorted(range(500), key=lambda i: (-(points[i] @ q), i))[:5]]


def test_empty_tables(spark):
    docs = documents(spark, []).select("doc_id", "text", "source")
    assert exact_dedup.dedup(docs).count() == exact_dedup.survivors(docs).count() == 0
    assert jaccard.join(docs).count() == mixing.mix(docs).count() == 0
    assert sharding.shard(shared.stored(docs, "t")).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(docs)).count() == 0
    assert repeats.remove(docs).count() == 0
    target = shared.scratch(spark, "t-orc")
    token_orc.write(docs, target)
    assert token_orc.starts(shared.stored(token_orc.checked(token_orc.read(spark, target)), "t")).count() == 0
    assert toxicity.classify(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    none = topk.whole(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(none, none).count() == 0
