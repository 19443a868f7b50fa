"""Near-duplicates, embeddings, suffix arrays: held against brute force on small fixtures."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import collision, graph, meetings, repeats, superminhash, suffix
from quire.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, elements string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randrange(40)) for _ in range(n))


def near_copies(seed=3):
    rng = random.Random(seed)
    base = prose(rng, 80).split(" ")
    rows = [(0, None), (1, ""), (2, "  \n "), (3, "one two"), (4, "one two"), (5, "ONE  two"), (6, "one two three")]
    for i in range(10, 70):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(i, prose(rng, 60)) for i in range(80, 95)] + [(99, rows[20][1]), (100, rows[20][1]), (101, " ".join(base * 60))]
    return rows


class Union:
    def __init__(self, nodes):
        self.p = {n: n for n in nodes}

    def find(self, x):
        while self.p[x] != x:
            x = self.p[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def test_superminhash_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(superminhash, "BLOCK_ELEMENTS", 2000)  # several blocks a group
    monkeypatch.setattr(superminhash, "BUCKET_BLOCK", 7)  # and a bucket
    monkeypatch.setattr(meetings, "PAIRS", 50)
    monkeypatch.setattr(meetings, "CHUNK_ROWS", 20)
    rows = near_copies()
    got = {r.doc_id: r for r in superminhash.digest(frame(spark, rows)).collect()}
    sets = {i: shingles(t, 4) for i, t in rows}
    want = Union(sets)
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                want.link(a, b)
    assert {i: r.component_id for i, r in got.items()} == {i: want.find(i) for i in sets}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_words_built_to_collide_are_told_apart(spark):
    word = "a"
    for _ in range(11):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    got = superminhash.digest(frame(spark, [(1, word), (2, other), (3, word.upper()), (4, "x" * 600), (5, "x" * 601)])).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_pairs_of_many_small_documents_are_compared_in_bounded_memory():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 17, dtype=np.int64)
    sets = []
    for k in range(2 * superminhash.BLOCK_ELEMENTS // superminhash.LEAST_ELEMENTS):
        own, at = base.copy(), int(rng.integers(0, 14))
        own[at : at + 4] = rng.integers(0, 1 << 62, 4)[: len(own[at : at + 4])]
        sets.append(np.unique(own))
    size = np.array([len(s) for s in sets])
    tracemalloc.start()
    common = superminhash._shared(np.concatenate(sets), size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20
    for a, b in rng.integers(0, len(sets), (300, 2)).tolist():
        assert common[a, b] == len(np.intersect1d(sets[a], sets[b])) or a == b


def test_unlike_texts_that_share_a_band_are_no_candidates():
    rng = np.random.default_rng(4)
    for share, low, high in ((0.8, 1, 1), (0.2, 0, 0)):
        both = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        own = int(400 * (1 / share - 1) / 2)
        pairs = [np.concatenate((both, rng.integers(0, 1 << 63, own, dtype=np.uint64))) for _ in range(60)]
        sig = superminhash.short_signatures(superminhash.signatures(np.concatenate(pairs), np.cumsum([0] + [len(p) for p in pairs])))
        met = ((sig[::2] == sig[1::2]).sum(axis=1) >= superminhash.AGREE).mean()
        assert low <= met <= high


def test_superminhash_cases(spark):
    assert superminhash.digest(frame(spark, [])).count() == 0
    got = superminhash.digest(frame(spark, [(None, "a b c d e"), (1, "a b c d e"), (1, "q r s t u"), (2, "q r s t u"), (2, "q r s t u")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False)]
    kept = superminhash.deduplicate(frame(spark, [(7, "a b c d e f"), (8, "A b c d e f"), (9, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [7, 9] and "elements" in kept.columns


def test_superminhash_estimates():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(200):
        shared = rng.integers(0, 1 << 63, 160, dtype=np.uint64)
        sets += [np.concatenate((shared, rng.integers(0, 1 << 63, 20, dtype=np.uint64))) for _ in range(2)]
    sig = superminhash.signatures(np.concatenate(sets), np.arange(0, 400 * 180 + 1, 180))
    got = (sig[::2] == sig[1::2]).mean(axis=1)
    true = 160 / 200
    assert abs(got.mean() - true) < 0.01
    assert got.std() < math.sqrt(true * (1 - true) / superminhash.REGISTERS)  # below MinHash's deviation


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, 40), (100, 41), (41, 90), (7, 7), (7, 7)]
    rng = random.Random(0)
    names = list(range(200))
    rng.shuffle(names)
    got = dict(graph.components(spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a long, b long"), Scratch(spark, "t"), "c").collect())
    want = Union(names)
    for a, b in edges:
        want.link(names[a], names[b])
    assert got == {names[x]: want.find(names[x]) for e in edges for x in e}
    assert graph.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "e").count() == 0


def test_collisions_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collision, "BLOCK", 9)
    monkeypatch.setattr(meetings, "PAIRS", 100)
    monkeypatch.setattr(meetings, "CHUNK_ROWS", 50)
    rng = np.random.default_rng(2)
    rows = []
    for label in (1, 2, None):
        for c in rng.standard_normal((6, 16)):
            rows += [(len(rows) + k, (c + 0.07 * rng.standard_normal(16)).tolist(), label) for k in range(25)]
    n = len(rows)
    rows += [(n, rows[0][1], 1), (n + 1, rows[0][1], 1), (n + 2, None, 1), (n + 3, [0.0] * 16, 1), (n + 4, [float("nan")] + [1.0] * 15, 1), (n + 5, [1.0, None], 1), (n + 6, [], 2), (n + 7, rows[0][1], 2), (n + 8, [1.0, 2.0], 1), (n + 9, [float("inf"), 1.0], 1)]
    got = {r.vec_id: r for r in collision.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links, want = Counter(), Union([r[0] for r in rows])
    for i, x, a in rows:
        for j, y, b in rows:
            if i < j and a is not None and a == b and x and y and len(x) == len(y) and None not in x and np.isfinite(x).all() and np.isfinite(y).all() and any(x) and any(y) and np.dot(x, y) / math.sqrt(np.dot(x, x) * np.dot(y, y)) >= 0.98:
                links.update((i, j))
                want.link(i, j)
    assert sum(links.values()) > 500
    assert {i: r.n_links for i, r in got.items()} == {r[0]: links[r[0]] for r in rows}
    assert {i: r.component_id for i, r in got.items()} == {r[0]: want.find(r[0]) for r in rows}


def test_collision_count_is_calibrated():
    rng = np.random.default_rng(8)
    p = math.erf(collision.HALF_WINDOW / math.sqrt(2))
    assert (rng.binomial(collision.LINES, p, 200_000) < collision.needed(1e-3)).mean() <= 1.3e-3
    assert collision.needed() >= collision.LINES // 2
    assert collision.digest.__doc__


def test_collision_extremes_and_repeats(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1e-200, 2e-200], 1), (3, [1e308, 1.7e308], 1), (4, [5e-324, 1e-323], 1), (5, [1e200, 2e200], 1), (5, [1e200, 2e200], 1), (6, [-1.0, -2.0], 1), (None, [1.0, 2.0], 1), (7, [0.0, 0.0], 1), (8, [1.0, 2.0], 2)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in collision.digest(spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, line string, rep double")).collect())
    assert got == [(0, 0, 0, True), (1, 5, 1, True), (2, 5, 1, False), (3, 5, 1, False), (4, 5, 1, False), (5, 5, 1, False), (5, 5, 1, False), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True)]


def test_collision_meetings_find_pairs_and_grow_slowly():
    rng = np.random.default_rng(6)
    n, t = 4000, 0.98
    each, groups = collision.plan(n, t)
    x = rng.standard_normal((n, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    other = rng.standard_normal((n, 32))
    other -= (other * x).sum(axis=1)[:, None] * x
    near = t * x + math.sqrt(1 - t * t) * other / np.linalg.norm(other, axis=1)[:, None]
    size = np.full(n, 32)
    a, b = (collision.places(v, size, each, groups, t) for v in (x, near))
    assert (a == b).any(axis=1).all()  # every pair at the threshold meets
    met = sum(int((c * (c - 1) // 2).sum()) for g in range(groups) for c in [np.unique(a[:, g], return_counts=True)[1]])
    assert met / groups < n * collision.COMPANIONS  # unlike vectors hardly do
    assert collision.plan(10**9, t)[1] < 12 * groups


def test_collision_empty(spark):
    assert collision.digest(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("alphabet", [1, 2, 3, 20])
def test_suffix_array(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in [0, 1, 2, 3, 7, 30, 90]:
        for _ in range(20):
            s = rng.integers(-3, alphabet - 3, n)
            assert suffix.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def removed(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[p : p + width] for x in raw for p in range(len(x) - width + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for p in range(len(x) - width + 1):
            if seen[x[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        out.append((len(x), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [4096, 3])
def test_repeats_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(11)
    passage, other = prose(rng, 60), prose(rng, 30)
    texts = [None, "", "short", "é" * 99, "é" * 100, "a" * 700, "ab" * 260, prose(rng, 90)]
    texts += [prose(rng, rng.randrange(5, 60)) + passage[: rng.randrange(150, len(passage))] + prose(rng, 20) for _ in range(30)]
    texts += [other[k : k + 202] + str(k) for k in range(12)] + [texts[7], texts[7], passage + prose(rng, 5) + passage, "x" + "a" * 250]
    rows = list(enumerate(texts)) + [(3, texts[7])]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(frame(spark, rows)).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(rows, removed([t for _, t in rows], 200), strict=True))


def test_repeats_when_hot_cores_split_a_join(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 40)
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionBytes": "5000"}
    before = {k: spark.conf.get(k) for k in settings}
    rng = random.Random(12)
    hot = prose(rng, 60)[:230]
    texts = [prose(rng, 3) + hot + prose(rng, 3) for _ in range(1500)]
    for _ in range(120):
        passage = prose(rng, 60)[:201]
        texts += [prose(rng, 6) + passage + prose(rng, 6) for _ in range(2)]
    rng.shuffle(texts)
    sort, tasks = repeats._sort, []

    def spy(strings):
        tasks.extend(strings.withColumn("task", F.spark_partition_id()).select("core", "task").collect())
        return sort(strings)

    monkeypatch.setattr(repeats, "_sort", spy)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(frame(spark, list(enumerate(texts)))).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({r.core for r in tasks}) == len(set(tasks)) > 100  # one task a core
    assert got == dict(enumerate(removed(texts, 200)))


def test_repeats_empty(spark):
    assert repeats.digest(frame(spark, [])).count() == 0
    assert repeats.intervals(next(repeats.tk.pieces(pa.array(["x"]))), 200)["row"].size == 0
