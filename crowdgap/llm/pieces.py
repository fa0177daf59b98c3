"""SentencePiece encoding and decoding by a max-plus scan.

A text is a lattice of vocabulary pieces; its encoding is the path of greatest weight. For unigram
models an edge weighs its piece's score. For BPE models an edge weighs 0 if the model's merges,
run on the two neighbouring pieces alone, give just these two, and minus infinity otherwise: a
sequence whose neighbours all pass is the merge order's own result, and there is only one. So both
kinds are sums along a path, and both equal SentencePiece's encoding.

Texts of more than ``chunk`` characters are cut. A state at a cut is a piece that covers the
character before it; a chunk yields the matrix of best weights from each state at its start to
each state at its end. Matrices combine by (max, +), which is associative; the best states at all
cuts follow from one pass over a document's small matrices, and then every chunk is traced back by
itself. Shorter texts are one chunk. Where the vocabulary has no piece with a space mark inside, a
word start is a place that every path goes through, so words are solved once and remembered.

The model file is read where the job starts and its pieces travel with the tasks. Its
normalisation must be the identity; a dummy prefix is heeded.

Null texts stay null; an empty text has no pieces. Characters outside the vocabulary become byte
pieces, or the unknown piece where the model has no bytes. Rows that repeat are kept. Ties (unigram)
go to the longest last piece. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdgap.llm.common import materialise
from crowdgap.llm.registry import query, table

SPACE = "▁"
CHUNK = 32_768
REMEMBERED = 250_000        # words, twice, and as many pairs, that a process keeps
START, UNKNOWN, HEAD = -1, -2, -3
NEVER = float("-inf")


class Vocabulary:
    """Pieces of a model file; ``kind`` is "bpe" or "unigram"."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        self.path = path
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only models without normalisation are supported")
        self.kind = {1: "unigram", 2: "bpe"}[spec.model_type]
        self.prefix, self.bytes = norm.add_dummy_prefix, spec.byte_fallback
        self.names = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]         # 1 normal, 2 unknown, 3 control, 6 byte
        self.scores = [p.score for p in model.pieces]
        self.unknown = self.kinds.index(2)


class Encoder:
    """A vocabulary ready for a task."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.number = {n: i for i, (n, k) in enumerate(zip(v.names, v.kinds)) if k in (1, 4)}
        self.longest = max(map(len, self.number), default=1)
        self.heads = {n[:i]: HEAD for n in self.number for i in range(1, len(n))} | self.number
        self.edge: dict[int, tuple[bool, list, list]] = {}
        self.words_split = not any(SPACE in n.lstrip(SPACE) for n in self.number)
        self.least = min(v.scores, default=0) - 10
        self.byte = [v.names.index(f"<0x{b:02X}>") for b in range(256)] if v.bytes else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.joined = {n[i:i + 2] for n in self.number for i in range(len(n) - 1)}
        self.pairs: dict[int, dict[int, bool]] = {}     # by the left piece
        self.n_pairs = 0
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.size = [len(n) for n in v.names]
        self.gate = re.compile(f"[^{SPACE}](?={SPACE})")
        self.plain = v.kind == "unigram"

    # weights

    def merged(self, text: str) -> tuple[list[str], list, list]:
        """What the model's merges make of a short string.

        Also the symbols that stood at its left and right edge, each with the score of the merge
        that took it in (none for the last).
        """
        parts, score, number = list(text), self.v.scores, self.number
        left, right = [], []
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                n = number.get(parts[i] + parts[i + 1])
                if n is not None and score[n] > best:
                    best, at = score[n], i
            if at < 0:
                break
            if at == 0:
                left.append((parts[0], best))
            if at == len(parts) - 2:
                right.append((parts[-1], best))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts, [*left, (parts[0], NEVER)], [*right, (parts[-1], NEVER)]

    def edges(self, piece: int) -> tuple[bool, list, list]:
        """Whether the merges make this piece from its characters, and its edges meanwhile."""
        got = self.edge.get(piece)
        if got is None:
            name = self.v.names[piece]
            parts, left, right = self.merged(name)
            got = self.edge[piece] = parts == [name], left, right
        return got

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges keep these neighbours apart, and each whole.

        A merge across the border happens if its piece scores above the merges that would take in
        its two halves inside the neighbours.
        """
        if right == UNKNOWN:
            return True
        row = self.pairs.setdefault(left, {})
        ok = row.get(right)
        if ok is None:
            ok, firsts, _ = self.edges(right)
            if ok and left >= 0:
                ok, _, lasts = self.edges(left)
                for a, a_taken in lasts if ok else ():
                    for b, b_taken in firsts:
                        n = self.number.get(a + b)
                        if n is not None and self.v.scores[n] >= max(a_taken, b_taken):
                            ok = False
                            if self.v.scores[n] == max(a_taken, b_taken):   # the left one first
                                names = [self.v.names[left], self.v.names[right]]
                                return self.merged("".join(names))[0] == names
            self.n_pairs += 1
            if self.n_pairs >= REMEMBERED:
                self.n_pairs = 0
                self.pairs.clear()
            row[right] = ok
        return ok

    def weight(self, left: int, right: int) -> float:
        if self.plain:
            return self.v.scores[right] if right >= 0 else self.least
        return 0.0 if self.fits(left, right) else NEVER

    # paths

    def walk(self, text: str, begin: int, before: int, end: int, like=None):
        """Best weight to each place after ``begin`` and the piece that ends there.

        ``before`` is the piece that ends at ``begin``. ``like`` is another walk over the same text
        that this one may join: once both agree for the length of a piece they stay together.
        """
        best = [NEVER] * (end + 1)
        last = [UNKNOWN] * (end + 1)
        size = [0] * (end + 1)
        best[begin], last[begin] = 0.0, before
        heads, longest, plain = self.heads, self.longest, self.plain
        alike = 0
        for q in range(begin, end + 1):
            w = best[q]
            if like is not None and q > begin:
                same = last[q] == like[1][q] and size[q] == like[2][q] and w > NEVER
                alike = alike + 1 if same and q - size[q] >= begin else 0
                if alike > longest:
                    shift = w - like[0][q]
                    best[q:] = [x + shift for x in like[0][q:end + 1]]
                    last[q:], size[q:] = like[1][q:end + 1], like[2][q:end + 1]
                    break
            if w == NEVER:
                continue
            before = last[q]
            for p in range(q + 1, min(end, q + longest) + 1):
                n = heads.get(text[q:p])
                if n is None:
                    if p > q + 1:
                        break
                    n = UNKNOWN
                elif n == HEAD:             # only the beginning of a piece
                    if p > q + 1 or text[q] in self.number:
                        continue
                    n = UNKNOWN
                if plain:
                    x = w + self.weight(before, n)
                    if x > best[p]:
                        best[p], last[p], size[p] = x, n, p - q
                elif not size[p]:           # the only one that fits
                    if n < 0 or self.fits(before, n):
                        best[p], last[p], size[p] = 0.0, n, p - q
                if n == UNKNOWN and p == q + 1 and text[q:p] not in heads:
                    break
        return best, last, size

    def back(self, text: str, walk, begin: int, end: int) -> list[int]:
        """Piece numbers of the best path to ``end``."""
        _, last, size = walk
        out = []
        while end > begin:
            n = last[end]
            if n >= 0:
                out.append(n)
            else:
                out += self.other(text[end - size[end]:end])[::-1]
            end -= size[end]
        return out[::-1]

    def other(self, char: str) -> list[int]:
        """Pieces of a character that the vocabulary does not have."""
        if self.byte is None:
            return [self.v.unknown]
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")]

    def first_path(self, text: str) -> list[int]:
        """A path without a forbidden pair, longest pieces first; dead ends are remembered.

        With weights of 0 and minus infinity any complete path is the best one.
        """
        one = self.number.get(text)
        if one is not None and self.fits(START, one):
            return [one]
        get, pairs, size, n = self.heads.get, self.pairs, self.size, len(text)
        ids, starts, dead = [], [], set()
        at, before = 0, START
        while at < n:
            found, p = [], at + 1
            while (k := get(text[at:p])) is not None:
                if k >= 0:
                    found.append(k)
                p += 1
                if p > n:
                    break
            row = pairs.get(before) or pairs.setdefault(before, {})
            while found:
                k = found.pop()
                ok = row.get(k)
                if ok is None:
                    ok = self.fits(before, k)
                if ok and not (dead and at + size[k] in dead):
                    ids.append(k)
                    starts.append(at)
                    at, before = at + size[k], k
                    break
            else:
                if text[at] not in self.number and at + 1 not in dead:
                    ids.append(UNKNOWN)
                    starts.append(at)
                    at, before = at + 1, UNKNOWN
                else:
                    dead.add(at)
                    at = starts.pop()
                    ids.pop()
                    before = ids[-1] if ids else START
        if UNKNOWN in ids:
            ends = [*starts[1:], n]
            return [x for k, a, b in zip(ids, starts, ends)
                    for x in ([k] if k >= 0 else self.other(text[a:b]))]
        return ids

    def solve(self, text: str) -> list[int]:
        """The encoding of a text that is one chunk."""
        if not self.plain:
            return self.first_path(text)
        return self.back(text, self.walk(text, 0, START, len(text)), 0, len(text))

    def marked(self, text: str) -> str:
        return (SPACE if self.v.prefix else "") + text.replace(" ", SPACE) if text else ""

    def encode(self, marked: str) -> list[int]:
        """The encoding of a marked text, word by word where words are apart."""
        if not self.words_split:
            return self.solve(marked)
        return array("i", self.packed(marked)).tolist()

    def packed(self, marked: str) -> bytes:
        """The encoding as 32-bit numbers, from remembered words."""
        if not self.words_split:
            return array("i", self.solve(marked)).tobytes()
        if SPACE + SPACE in marked or marked[:1] != SPACE:
            words = self.word.findall(marked)
        else:
            words = [SPACE + w for w in marked[1:].split(SPACE)]
        get, found = self.known.get, []
        for word in words:
            ids = get(word)
            if ids is None:
                ids = self.learned(word)
                get = self.known.get
            found.append(ids)
        return b"".join(found)

    def learned(self, word: str) -> bytes:
        """A word's encoding, remembered from now on.

        Between neighbours that no piece joins every path passes, so such parts are solved apart.
        """
        ids = self.older.get(word)
        if ids is None and not word[1:].isalpha() and len(word) > 1:
            parts, a = [], 0
            for i in range(1, len(word)):
                if word[i - 1:i + 1] not in self.joined:
                    parts.append(word[a:i])
                    a = i
            if a:
                parts.append(word[a:])
                ids = b"".join([self.known.get(p) or self.learned(p) for p in parts])
        if ids is None:
            ids = array("i", self.solve(word)).tobytes()
        if len(self.known) >= REMEMBERED:           # the words of late are kept once more
            self.older, self.known = self.known, {}
        if len(word) <= 64:
            self.known[word] = ids
        return ids

    # chunks

    def states(self, text: str, cut: int) -> list[tuple[int, int, int]]:
        """(start, end, piece) of every piece that covers the character before ``cut``."""
        out = []
        for s in range(max(0, cut - self.longest), cut):
            for e in range(cut, min(len(text), s + self.longest) + 1):
                n = self.number.get(text[s:e])
                if n is not None:
                    out.append((s, e, n))
        if text[cut - 1] not in self.number:
            out.append((cut - 1, cut, UNKNOWN))
        return out

    def ends(self, text: str, cut: int, first: bool, to: int):
        """States at both ends of a chunk that begins at ``cut`` and ends at ``to``."""
        return [(0, 0, START)] if first else self.states(text, cut), self.states(text, to)

    def gates(self, text: str, cut: int, to: int) -> tuple[int, int] | None:
        """First and last word start in a chunk: places that every path goes through."""
        if not self.words_split:
            return None
        found = self.gate.search(text, max(cut - 1, 0), to)
        if found is None:
            return None
        last = text.rfind(SPACE, 0, to)
        while text[last - 1] == SPACE:
            last -= 1
        return found.start() + 1, last

    def transfer(self, text: str, cut: int, first: bool, to: int) -> np.ndarray:
        """Best weight from each state at the start to each state at the end.

        Between the first and the last word start all paths share one weight, so it counts once.
        """
        left, right = self.ends(text, cut, first, to)
        gates = self.gates(text, cut, to)
        stop = gates[0] if gates else to
        entry, like = [], None
        for _, begin, before in left:
            entry.append(self.walk(text, begin, before, stop, like))
            like = like or entry[-1]
        if gates:
            tail = self.walk(text, gates[1], START, to)
            inner = sum(self.walk(w, 0, START, len(w))[0][-1]
                        for w in self.word.findall(text[stop:gates[1]])) if self.plain else 0.0
        out = np.full((len(left), len(right)), NEVER)
        for j, (s, _, n) in enumerate(right):
            for i, (_, begin, _) in enumerate(left):
                if gates:
                    head, walk, least = entry[i][0][stop] + inner, tail, gates[1]
                else:
                    head, walk, least = 0.0, entry[i], begin
                if s >= least and walk[0][s] > NEVER and head > NEVER:
                    out[i, j] = head + walk[0][s] + self.weight(walk[1][s], n)
        return out

    def trace(self, text: str, cut: int, first: bool, to: int, i: int, j: int) -> list[int]:
        """Pieces after state ``i`` up to and with state ``j``."""
        left, right = self.ends(text, cut, first, to)
        _, begin, before = left[i]
        s, e, n = right[j]
        gates = self.gates(text, cut, to)
        if gates:
            stop, last = gates
            ids = [*self.back(text, self.walk(text, begin, before, stop), begin, stop),
                   *self.encode(text[stop:last]),
                   *self.back(text, self.walk(text, last, START, s), last, s)]
        else:
            ids = self.back(text, self.walk(text, begin, before, s), begin, s)
        return ids + ([n] if n >= 0 else self.other(text[s:e]))


def ready(vocabulary: Vocabulary) -> Encoder:
    """The encoder of this process: tasks that a worker runs in turn share what it remembers."""
    held = vars(sys).setdefault("_sentencepiece_encoders", {})
    name = (vocabulary.path, vocabulary.kind, len(vocabulary.names))
    if name not in held:
        held.clear()
        held[name] = Encoder(vocabulary)
    return held[name]


def chunks_of(marked: str, chunk: int, margin: int):
    """(number, text with margins, start and end of the chunk in it) of a long text.

    The last chunk takes a rest that is too short to hold more than one piece.
    """
    cuts = [*range(0, max(len(marked) - 2 * margin, 1), chunk), len(marked)]
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        low = max(0, a - margin)
        yield k, marked[low:b + margin], a - low, b - low


def best_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """State numbers at the start and end of each chunk on the best path."""
    reach = [np.zeros(1)]
    for m in matrices:
        reach.append((reach[-1][:, None] + m).max(axis=0))
    out, j = [], int(reach[-1].argmax())
    for m, r in zip(matrices[::-1], reach[-2::-1]):
        i = int((r + m[:, j]).argmax())
        out.append((i, j))
        j = i
    return out[::-1]


def numbers(packed: list[bytes | None]) -> pa.Array:
    """An Arrow list column of packed encodings."""
    ends = np.cumsum([0, *(len(p) // 4 if p else 0 for p in packed)]).astype(np.int32)
    values = np.frombuffer(b"".join(p for p in packed if p), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values),
                                    mask=pa.array([p is None for p in packed]))


def slices(batches, rows: int = 200):
    """Batches of few rows: lists of Python numbers take many times the room of a column."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text",
           chunk: int = CHUNK) -> DataFrame:
    """(key, ids) of every row, for the SentencePiece model file at ``model``."""
    vocabulary = Vocabulary(model)
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))

    def short(batches):
        encoder = ready(vocabulary)
        for batch in slices(batches):
            ids = [None if t is None else encoder.packed(encoder.marked(t))
                   for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), numbers(ids)], ["k", "ids"])

    small = given.where(F.col("text").isNull() | (F.length("text") < chunk)).mapInArrow(
        short, f"k {kind}, ids array<int>")
    large = given.where(F.length("text") >= chunk).withColumn("name", F.sha2("text", 256))
    whole = scan(large.select("name", "text").dropDuplicates(["name"]), vocabulary, chunk)
    long = large.select("k", "name").join(whole, "name").select("k", "ids")
    return small.unionByName(long).withColumnRenamed("k", key)


def scan(texts: DataFrame, vocabulary: Vocabulary, chunk: int) -> DataFrame:
    """(name, ids) of long texts: cut, transfer, combine, trace back."""
    def cut(batches):
        encoder = ready(vocabulary)
        for batch in slices(batches, 8):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, part, a, b in chunks_of(encoder.marked(text), chunk, encoder.longest):
                    yield pa.RecordBatch.from_pylist(
                        [{"name": name, "k": k, "part": part, "a": a, "b": b}],
                        pa.schema([("name", pa.string()), ("k", pa.int32()),
                                   ("part", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))

    pieces = materialise(texts.repartition("name").mapInArrow(
        cut, "name string, k int, part string, a int, b int"), "chunks")
    spread = pieces.repartition("name", "k")

    def matrices(batches):
        encoder = ready(vocabulary)
        for batch in slices(batches, 8):
            rows = batch.to_pylist()
            got = [encoder.transfer(r["part"], r["a"], r["k"] == 0, r["b"]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["name"] for r in rows]), pa.array([r["k"] for r in rows], pa.int32()),
                 pa.array([m.shape[0] for m in got], pa.int32()),
                 pa.array([m.tobytes() for m in got], pa.binary())], ["name", "k", "rows", "m"])

    def combine(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["k"])
        states = best_states([np.frombuffer(r["m"]).reshape(r["rows"], -1) for r in rows])
        return pa.table({"name": [r["name"] for r in rows],
                         "k": pa.array([r["k"] for r in rows], pa.int32()),
                         "i": pa.array([i for i, _ in states], pa.int32()),
                         "j": pa.array([j for _, j in states], pa.int32())})

    # a document's matrices are some KB for each chunk, and a document is one row of the input
    states = spread.mapInArrow(matrices, "name string, k int, rows int, m binary").groupBy(
        "name").applyInArrow(combine, "name string, k int, i int, j int")

    def trace(batches):
        encoder = ready(vocabulary)
        for batch in slices(batches, 8):
            rows = batch.to_pylist()
            ids = [encoder.trace(r["part"], r["a"], r["k"] == 0, r["b"], r["i"], r["j"])
                   for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["name"] for r in rows]), pa.array([r["k"] for r in rows], pa.int32()),
                 pa.array(ids, pa.list_(pa.int32()))], ["name", "k", "ids"])

    traced = pieces.join(states, ["name", "k"]).select(
        "name", "k", "part", "a", "b", "i", "j").mapInArrow(trace, "name string, k int, ids array<int>")
    return traced.groupBy("name").agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("k", "ids"))).getField("ids")).alias("ids"))


def decode(encoded: DataFrame, model: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """(key, ids, text) of every row."""
    vocabulary = Vocabulary(model)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        body = []
        for name, k in zip(vocabulary.names, vocabulary.kinds):
            body.append(bytes([int(name[1:-1], 16)]) if k == 6 else b"" if k == 3
                        else " ⁇ ".encode() if k == 2 else name.replace(SPACE, " ").encode())
        for batch in slices(batches):
            out, lists = [], batch.column(1)
            ends, flat = np.asarray(lists.offsets), np.asarray(lists.values, np.int32)
            for i, none in enumerate(lists.is_null().to_pylist()):
                ids = flat[ends[i]:ends[i + 1]].tolist()
                text = b"".join(map(body.__getitem__, ids)).decode("utf-8", "replace")
                text = text[1:] if vocabulary.prefix and text[:1] == " " else text
                out.append(None if none else text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())],
                                             [key, "ids", "text"])

    return encoded.select(key, F.col(column).alias("ids")).mapInArrow(
        run, f"`{key}` {kind}, ids array<int>, text string")


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"), MODEL)
    return decode(encoded, MODEL).select(
        "doc_id", F.size("ids").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))
