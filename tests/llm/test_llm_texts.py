"""Fingerprints, suffix dedup, SentencePiece against brute force, with hard rows and no rows."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from crowdgap.llm import fingerprints, pieces, suffixes
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def as_docs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def edited_brute(rows):
    """(id, text, edited) in descending order of id; ids are unique here."""
    rows = sorted(rows, reverse=True)
    out = []
    for i, (doc, text) in enumerate(rows):
        k = len(text) // 3
        out.append((doc, text, text[:len(text) - k] + rows[(i + 1) % len(rows)][1][:k]))
    return out


def chunk_brute(raw: bytes):
    """Chunk ends by the rule itself, a byte at a time."""
    c = fingerprints.Chunker()
    ends, start = [], 0
    while start < len(raw):
        last = min(start + fingerprints.LARGEST, len(raw))
        end = last
        for e in range(start + fingerprints.LEAST, last):
            h = 0
            for age, b in enumerate(raw[max(0, e - fingerprints.WINDOW):e][::-1]):
                h = (h + (int(c.gear[b]) << age)) & 0xFFFFFFFF
            mask = fingerprints.RARE if e < start + fingerprints.WANTED else fingerprints.COMMON
            if h & int(mask) == 0:
                end = e
                break
        ends.append(end)
        start = end
    return ends


def test_chunks_follow_the_rule():
    c, rng = fingerprints.Chunker(), random.Random(5)
    for n in (0, 1, 15, 16, 17, 300, 2000):
        raw = bytes(rng.choice(b"abcdefgh \n") for _ in range(n))
        assert c.cuts(np.frombuffer(raw, np.uint8)) == chunk_brute(raw)


def test_pieces_of_a_long_text_change_nothing(monkeypatch):
    raw = np.frombuffer(random.Random(6).randbytes(20_000), np.uint8)
    want = fingerprints.Chunker().chunks(raw)
    monkeypatch.setattr(fingerprints, "PIECE", 1024)
    got = fingerprints.Chunker().chunks(raw)
    assert all((a == b).all() for a, b in zip(want, got))


def test_edits_and_their_fingerprints(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op1_fingerprints(spark, SF).collect()}
    rows = edited_brute(as_docs(docs))
    assert len(got) == len(rows)
    c = fingerprints.Chunker()
    marks = lambda t: np.unique(c.chunks(np.frombuffer(t.encode(), np.uint8))[1])
    for i, (doc, text, edit) in enumerate(rows):
        r = got[doc]
        a, b, n = marks(text), marks(edit), marks(rows[(i + 1) % len(rows)][1])
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.printed(a), fingerprints.printed(b))
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(a, b), fingerprints.likeness(a, n))
    assert sum(r.near_edited > .5 for r in got.values()) > .8 * len(got)


def test_hot_keys_are_split_and_keep_their_order(spark):
    rows = [(i if i % 3 == 0 else 700 if i % 3 == 1 else None,
             " ".join(str(i * j) for j in range(1, 2 + i % 40))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = fingerprints.followed(df, "doc_id", "text")
    sizes = [r["count"] for r in dealt.groupBy("bucket").count().collect()]
    assert max(sizes) < 300
    order = dealt.where("not extra").select("text").orderBy(
        F.desc("o"), F.desc("h")).toPandas()["text"].tolist()
    # equal rows are neighbours; after the last comes the first
    want = sorted(t[:len(t) - len(t) // 3] + n[:len(t) // 3] for t, n in zip(order, order[1:] + order[:1]))
    got = fingerprints.edited_likeness(df).select("edited_sha256").toPandas()["edited_sha256"]
    assert sorted(got) == sorted(hashlib.sha256(w.encode()).hexdigest() for w in want)


def test_fingerprints_of_hard_rows(hard, none):
    rows = fingerprints.edited_likeness(hard).collect()
    assert len(rows) == hard.count()
    by_text = {}
    for r in fingerprints.fingerprints(hard).join(hard.select("doc_id", "text"), "doc_id").collect():
        assert by_text.setdefault(r.text or "", r.fingerprint) == r.fingerprint
    empty = [r for r in rows if r.n_chars == 0]
    assert len(empty) == 3 and all(r.fingerprint == "" for r in empty)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.edited_likeness(none).collect() == []


def test_inserting_changes_few_chunks():
    c, rng = fingerprints.Chunker(), random.Random(7)
    raw = bytes(rng.choice(b"abcdefghij ") for _ in range(20_000))
    a, b = (np.unique(c.chunks(np.frombuffer(x, np.uint8))[1]) for x in (raw, raw[:9000] + b"x" + raw[9000:]))
    assert fingerprints.likeness(a, b) > .95


def repeats_brute(rows):
    """(doc, n_bytes, n_removed, n_spans, kept digest) for rows in order."""
    seen, out, length = set(), [], suffixes.LENGTH
    for doc, text in rows:
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in suffixes.op7_suffix_dedup(spark, SF).collect()]
    assert sorted(got) == repeats_brute(sorted(as_docs(docs)))


def test_repeated_strings_of_hard_rows(hard, none):
    got = suffixes.remove_repeats(hard).collect()
    rows = as_docs(hard)
    # repeated rows are one document; null keys come last
    once = sorted(dict.fromkeys(rows), key=lambda r: (r[0] is None, r[0] or 0))
    tagged = {}
    for (doc, text), want in zip(once, repeats_brute(once)):
        tagged[(doc, hashlib.sha256(text.encode()).hexdigest())] = want
    assert len(got) == len(rows)
    wants = sorted((repr(tuple(tagged[(d, hashlib.sha256(t.encode()).hexdigest())])) for d, t in rows
                    if d is not None))
    assert sorted(repr(tuple(r)) for r in got if r.doc_id is not None) == wants
    # the text that only a null key adds to is all a copy, the other short text stays
    nulls = sorted((r.n_removed, r.n_bytes) for r in got if r.doc_id is None)
    assert nulls[0] == (0, len("only here")) and nulls[1][0] == nulls[1][1] > 0
    kept = suffixes.remove_repeats(hard, keep=True)
    assert kept.count() == len(rows) and kept.columns == ["text", "row", "n_removed"]
    assert suffixes.remove_repeats(none).collect() == []


@pytest.mark.parametrize("shard", [400, 1 << 22])
def test_shards_merge_by_binary_search(spark, monkeypatch, shard):
    """Near copies that differ around the same anchors, over one shard or many."""
    monkeypatch.setattr(suffixes, "SHARD", shard)
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghij ") for _ in range(600))
    rows = []
    for i in range(40):
        at = rng.randrange(600)
        rows.append((i, base[:at] + str(i) + base[at + 1:]))
    rows.append((40, "ab" * 400))
    rows.append((41, "ab" * 100 + "c" + "ab" * 300))
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == repeats_brute(rows)


@pytest.mark.parametrize("key", [None, 7])
def test_texts_of_one_key_stay_apart(spark, key):
    """1,000 texts on one key: each but the first loses the passage, none a byte of its own."""
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(120))
    own = [["".join(rng.choice("ABCDEFGHIJKLM") for _ in range(rng.randint(40, 400)))
            for _ in range(2)] for _ in range(1000)]
    rows = [(key, a + passage + b) for a, b in own]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = sorted((r.n_spans, r.n_removed) for r in got)
    assert removed[0] == (0, 0) and len(got) == 1000
    assert all(spans == 1 and 120 <= n <= 128 for spans, n in removed[1:])


def test_rows_that_repeat_are_worked_on_once(spark, monkeypatch):
    seen, plain = [], suffixes.instances

    def counted(docs, *more):
        seen.append(docs.count())
        return plain(docs, *more)

    monkeypatch.setattr(suffixes, "instances", counted)
    rng = random.Random(13)
    base = "".join(rng.choice("abcdefghij ") for _ in range(500))
    once = [(1, base[:250] + "x" + base[251:]), (1, base), (2, base), (3, base[100:])]
    docs = spark.createDataFrame([r for r in once for _ in range(50)], "doc_id long, text string")
    got = [tuple(r) for r in suffixes.remove_repeats(docs.repartition(4)).collect()]
    assert max(seen) == len(once)
    assert len(got) == 200 and len(set(got)) == 4 and all(got.count(r) == 50 for r in set(got))
    for doc, size in ((2, 500), (3, 400)):
        assert {r[1:3] for r in got if r[0] == doc} == {(size, size)}


def test_blocks_of_a_frequent_anchor_are_spread(spark, monkeypatch):
    """A line in every text with different text around it: no anchor keeps all its blocks together."""
    monkeypatch.setattr(suffixes, "SHARD", 2000)
    monkeypatch.setattr(suffixes, "SAMPLE", 1, raising=False)
    groups, plain = [], suffixes.search_shards

    def counted(blocks):
        groups.extend(r["count"] for r in blocks.groupBy(
            *[c for c in ("anchor", "part") if c in blocks.columns]).count().collect())
        return plain(blocks)

    monkeypatch.setattr(suffixes, "search_shards", counted)
    rng = random.Random(14)
    line = "".join(rng.choice("abcdefghij ") for _ in range(90))
    rows = []
    for i in range(400):        # some share more than the line, at either side
        left, right = ("".join(rng.choice("klmnopqrst ") for _ in range(60)) for _ in range(2))
        if i % 3 == 0 and i:
            left = rows[i // 2][1][:60]
        if i % 5 == 0 and i:
            right = rows[i // 3][1][-60:]
        rows.append((i, left + line + right))
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == repeats_brute(rows)
    assert sum(groups) > 400 and max(groups) < 60


def test_suffix_order_and_common_prefixes():
    rng = random.Random(9)
    for text in ("banana" * 20, "a" * 150, "".join(rng.choice("ab") for _ in range(400)), "x"):
        raw = np.frombuffer(text.encode(), np.uint8)
        order = suffixes.suffix_order(raw)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        shared = suffixes.common_prefixes(raw, order, np.array([0]), np.array([len(raw)]))
        for i in range(1, len(want)):
            a, b = text[want[i - 1]:], text[want[i]:]
            n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[i] == min(n, suffixes.LENGTH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_encoding_is_the_librarys(spark, library):
    docs = dict(as_docs(spark.read.parquet(f"{SF}/documents.parquet")))
    for r in pieces.op2_sentencepiece(spark, SF).collect():
        assert r.ids == library.encode(docs[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_hard_texts_in_chunks(hard, none, library):
    texts = {r.doc_id: r.text for r in hard.collect() if r.doc_id is not None and r.doc_id != 13}
    some = hard.where("doc_id <> 13")
    for chunk in (64, 100_000):
        got = pieces.encode(some, pieces.MODEL, chunk=chunk)
        rows = got.collect()
        assert len(rows) == some.count()
        for r in rows:
            t = texts[r.doc_id]
            assert r.ids == (None if t is None else library.encode(t)), r.doc_id
        for r in pieces.decode(got, pieces.MODEL).collect():
            t = texts[r.doc_id]
            assert r.text == (None if t is None else library.decode(library.encode(t)))
    assert pieces.encode(none, pieces.MODEL).collect() == []


def test_unigram_models(tmp_path, library):
    """The same pieces as a unigram model, with scores that no two paths share."""
    from sentencepiece import sentencepiece_model_pb2 as proto
    model = proto.ModelProto()
    model.ParseFromString(open(pieces.MODEL, "rb").read())
    rng = random.Random(10)
    for p in model.pieces:
        p.score = -rng.uniform(5, 15)
    model.trainer_spec.model_type = 1
    path = str(tmp_path / "unigram.model")
    open(path, "wb").write(model.SerializeToString())
    other, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Encoder(pieces.Vocabulary(path))
    for text in ("the quick brown fox", "Thstinnt thndhain. Onhalyti", "日本 𝄞", "a" * 50):
        marked = own.marked(text)
        assert own.encode(marked) == other.encode(text)
        cuts = list(pieces.chunks_of(marked, 40, own.longest))
        states = pieces.best_states([own.transfer(t, a, k == 0, b) for k, t, a, b in cuts])
        ids = [x for (k, t, a, b), (i, j) in zip(cuts, states) for x in own.trace(t, a, k == 0, b, i, j)]
        assert ids == other.encode(text)


def test_matrices_combine_associatively(library):
    own = pieces.Encoder(pieces.Vocabulary(pieces.MODEL))
    marked = own.marked("inanonthethation" * 20)
    a, b, c = [own.transfer(t, x, k == 0, y) for k, t, x, y in pieces.chunks_of(marked, 100, own.longest)][:3]
    product = lambda p, q: (p[:, :, None] + q[None]).max(axis=1)
    assert (product(product(a, b), c) == product(a, product(b, c))).all()
