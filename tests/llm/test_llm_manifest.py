"""Vector codes, SimHash components and Merkle manifests against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crowdgap.llm import codes, merkle, simhash
from crowdgap.llm.common import attach
from tests.llm.conftest import SF

# ---------------------------------------------------------------- Merkle manifests


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves, arity):
    """(root, path of every leaf): steps of (before, after), from the leaf up."""
    paths, nodes, under = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        new, new_under = [], []
        for a in range(0, len(nodes), arity):
            run = nodes[a:a + arity]
            for j in range(len(run)):
                for leaf in under[a + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1:])))
            new.append(H(*run))
            new_under.append([x for u in under[a:a + arity] for x in u])
        nodes, under = new, new_under
    return nodes[0], paths


def plain_manifest(rows, arity=2):
    """rows: (doc_id, text, lang, source, n_chars)."""
    leaf = lambda r, add=0: H(*[encoded(v) for v in (
        r[0], r[3], r[2], None if r[4] is None else r[4] + add, r[1])])
    first = lambda v: (v is not None, v)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda r: (first(r[0])[0], r[0] or 0, leaf(r)))
        trees.append(plain_tree([leaf(r) for r in groups[g]], arity))
    root, over = plain_tree([t[0] for t in trees], arity)
    out = []
    for g, (subroot, paths), top in zip(names, trees, over):
        for r, path in zip(groups[g], paths):
            path = path + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(r, 1 if hit else 0)
            for before, after in path:
                h = H(before, h, after)
            out.append((r[0], leaf(r), subroot, root, H(*[b + a for b, a in path]), h, h == root))
    return sorted(out, key=repr)


def manifest_rows(df, arity=2):
    found = merkle.verify(merkle.manifest(df, changed="n_chars", arity=arity))
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_of_hard_rows(hard, arity):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in hard.collect()]
    assert manifest_rows(hard, arity) == plain_manifest(rows, arity)


def test_manifest_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    got = manifest_rows(docs)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_hot_group_and_lone_groups(spark):
    rows = [(i % 40, "same", "hot", "s", i % 3) for i in range(200)]
    rows += [(None, "same", "hot", "s", 1)] * 50
    rows += [(7, None, f"lone{i}", None, None) for i in range(5)]
    rows += [(2 ** 63 - 1, "x", None, "s", 2 ** 63 - 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, "
                                     "n_chars bigint")
    assert manifest_rows(df) == plain_manifest(rows)


def test_one_row_and_no_row(spark, none):
    rows = [(21, "text", "en", "s", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, "
                                     "n_chars bigint")
    assert manifest_rows(df) == plain_manifest(rows)
    assert manifest_rows(none) == []


# ---------------------------------------------------------------- SimHash


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    """pairs: (key, fingerprint); key of the component of each, by comparing all."""
    prints = sorted({p for _, p in pairs})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin(a ^ b).count("1") <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, p in pairs:
        if k is not None:
            least[find(p)] = min(least.get(find(p), k), k)
    return [(k, f"{p:016x}", least.get(find(p))) for k, p in pairs]


def simhash_rows(df):
    found = simhash.near_components(df)
    return sorted(map(tuple, found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")),
                                          "component_id").collect()), key=repr)


def test_components_of_hard_rows(hard):
    pairs = [(r.doc_id, plain_print(r.text)) for r in hard.collect()]
    assert simhash_rows(hard) == sorted(plain_components(pairs), key=repr)


def test_components_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    want = plain_components(pairs)
    assert simhash_rows(docs) == sorted(want, key=repr)
    assert len({c for _, _, c in want}) < len(pairs)


def test_no_documents(none):
    assert simhash_rows(none) == []


def test_long_texts_are_read_in_whole_words(monkeypatch):
    rng = random.Random(5)
    text = " ".join("x" * rng.randint(1, 30) + str(rng.random()) for _ in range(500))
    text += "\v" + "y" * 9000 + "\tend Of\x1ftext é\x85 z"
    want = plain_print(text)
    for piece in (1, 17, 4000, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text.encode()) == want
        assert b" ".join(w for p in simhash.word_pieces(text.encode()) for w in p).split() \
            == text.encode().lower().split()


def near_words(seed, groups, members):
    """Words around centres, so that chains of near words exist."""
    rng = random.Random(seed)
    out = set()
    for _ in range(groups):
        word = rng.getrandbits(64)
        for _ in range(members):
            for _ in range(rng.randint(0, 3)):
                word ^= 1 << rng.randrange(64)
            out.add(word)
    return np.array(sorted(out), np.uint64)


def joined(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_pivot_table_keeps_all_that_near_pairs_join(seed):
    fp = near_words(seed, 12, 40)
    group = np.sort(np.random.default_rng(seed).integers(0, 3, len(fp)))
    side = np.random.default_rng(seed + 1).integers(0, 2, len(fp))
    for s in (None, side):
        want = [(i, j) for i in range(len(fp)) for j in range(i) if group[i] == group[j]
                and (s is None or s[i] != s[j]) and int(fp[i] ^ fp[j]).bit_count() <= 4]
        got = [(int(i), int(j)) for a, b in simhash.near_pairs(group, fp, s) for i, j in zip(a, b)]
        assert set(map(frozenset, got)) <= set(map(frozenset, want))
        assert joined(len(fp), got) == joined(len(fp), want)


@pytest.mark.parametrize("block", [7, 50_000])
@pytest.mark.parametrize("rows", [300, 10 ** 9, 10 ** 12])
def test_links_join_components_for_any_cut_and_block(spark, block, rows):
    fp = near_words(9, 8, 30)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp bigint").cache()
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    got = [(at[r.a], at[r.b]) for r in simhash.links_of(df, rows, block).collect()]
    want = [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 4]
    assert joined(len(fp), got) == joined(len(fp), want)


def test_blocks_cover_all_bits_and_grow():
    for rows in (0, 10 ** 5, 10 ** 8, 10 ** 11):
        blocks = simhash.cuts(rows)
        assert sum(w for _, w in blocks) == 64
    assert len(simhash.cuts(10 ** 11)) > len(simhash.cuts(10 ** 5))


def test_a_tight_group_gives_few_links():
    """All words within two bits of one: the pairs are not emitted."""
    fp = np.array([0] + [1 << i | 1 << j for i in range(64) for j in range(i + 1)], np.uint64)
    found = [len(a) for a, _ in simhash.near_pairs(np.zeros(len(fp), np.int64), fp)]
    assert len(fp) - 1 <= sum(found) < 12 * len(fp)


# ---------------------------------------------------------------- vector codes


def floor_of(x, scale=256):
    return int(np.floor(np.float64(np.float32(x)) * scale))


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label)."""
    kept = [(k, [floor_of(x) for x in v], label) for k, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(k, v + [0] * (parts * width - len(v)), label) for k, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for _, v, _ in kept:
                got.setdefault(nearest(p, cut(v, p))[1], []).append(cut(v, p))
            for e, xs in got.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    done = []
    for k, v, label in kept:
        best = [nearest(p, cut(v, p)) for p in range(parts)]
        done.append((k, "".join(f"{e:02x}" for _, e in best), sum(g for g, _ in best), label))
    total = {}
    for _, _, error, label in done:
        total[label] = total.get(label, 0) + error
    most = 2 ** 63 - 1
    return sorted([(k, c, min(e, most), min(total[label], most), sha)
                   for k, c, e, label in done], key=repr)


VECTORS = "vec_id bigint, embedding array<float>, label int, v string, k string, n int, code int"


def vector_rows(spark, rows):
    return spark.createDataFrame([(*r, "v", "k", 1, 2) for r in rows], VECTORS).repartition(3)


def code_rows(df, **how):
    return sorted(map(tuple, codes.compress(df, **how).collect()), key=repr)


def test_codes_of_hard_vectors(spark):
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(x) for x in rng.normal(0, .2, 32)], i % 4 if i % 5 else None)
            for i in range(150)]
    rows += [(200, None, 1), (201, [nan] + [0.0] * 31, 1), (202, [inf] + [0.0] * 31, 2),
             (203, [None] + [0.0] * 31, 2), (204, [], 1), (205, [0.5] * 7, None),
             (206, [0.25] * 40, 3), (None, [0.1] * 32, 3), (3, [0.1] * 32, 3), rows[5], rows[5]]
    assert code_rows(vector_rows(spark, rows)) == plain_codes(rows)


def test_codes_of_few_and_equal_vectors(spark):
    rows = [(i, [0.125] * 16, None) for i in range(40)] + [(41, [-1.0] * 16, 1)]
    assert code_rows(vector_rows(spark, rows)) == plain_codes(rows)
    got = code_rows(vector_rows(spark, rows), parts=4, entries=3, rounds=1)
    assert got == plain_codes(rows, 4, 3, 1)


def test_codes_of_huge_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 2e9, 16)], i % 2) for i in range(90)]
    assert code_rows(vector_rows(spark, rows)) == plain_codes(rows)
    beyond = vector_rows(spark, [(1, [3e38, -3e38] * 8, 1), (2, [0.0] * 16, 1)])
    assert [r[1] for r in code_rows(beyond)] == ["00" * 16, "01" * 16]


def test_no_vectors(spark):
    assert code_rows(vector_rows(spark, [(1, None, 2)]).where("vec_id > 5")) == []
    assert code_rows(vector_rows(spark, [(1, None, 2)])) == []
    with pytest.raises(ValueError):
        codes.compress(vector_rows(spark, [(1, [1.0], 2)]), entries=65)


@pytest.mark.parametrize("width,spread", [(1, 3), (3, 40), (4, 10 ** 6), (9, 2)])
def test_masks_hold_the_nearest_entries_only_in_their_box(width, spread):
    """Exact with ties, and far fewer candidates than entries where entries are spread."""
    rng = np.random.default_rng(width)
    book = codes.Codebook(rng.integers(-spread, spread + 1, (64, width)))
    x = rng.integers(-spread * 2, spread * 2 + 1, (400, width))
    gaps = ((x[:, None] - book.entries[None]) ** 2).sum(2)
    code, dist = book.nearest(x)
    assert (code == gaps.argmin(1)).all() and (dist == gaps.min(1)).all()
    if spread == 10 ** 6:
        assert np.bitwise_count(book.candidates(x // 2)).mean() < 20


# ---------------------------------------------------------------- shared helper


def test_attach_joins_hot_and_null_keys(spark):
    keys = [None] * 400 + ["hot"] * 500 + [f"k{i % 90}" for i in range(300)]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, key string").cache()
    values = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("i").alias("total")).cache()
    got = attach(rows, values, "key", share=20).collect()
    total = {}
    for i, k in enumerate(keys):
        total[k] = total.get(k, 0) + i
    assert sorted(r.i for r in got) == list(range(len(keys)))
    assert all(r.total == total[r.key] for r in got)

