"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Words of equal length advance together, one end position at a time. At each, the hashes of all substrings that end
there probe the sorted hashes of the pieces, every piece found extends the best path to its start, and the best
extension of each word is stored as a backpointer.

A unigram model scores a path by the sum of its pieces. A BPE model's file holds merge ranks instead: there, exactly
one of the pieces that end at a position can end the merge result of that prefix, namely one that does not merge with
the last piece of the path before it. For such files the recursion is the same and the transition is that test, so the
result is the library's and not a sum of ranks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import named, read

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: A word is a run of spaces and what follows up to the next space or line feed: no piece has a space behind another
#: character, and none a line feed (which Model checks).
WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Texts are encoded in batches of so many characters at most (and one text more), words in parts of so many cells.
BATCH_CHARS, CELLS = 1_000_000, 500_000
#: Words of a very long text that are encoded at once.
AT_ONCE = 50_000
#: Words whose ids (beyond it, those of the last batch stay), and pairs of pieces whose test, a task remembers.
MEMO_WORDS, MEMO_PAIRS = 300_000, 1 << 21


def code_hash(c: np.ndarray) -> np.ndarray:
    x = c.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence_hash(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of code points: the last one has the weight 1."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for i in range(codes.shape[1]):
        h = h * BASE + code_hash(codes[:, i])
    return h


def filled_up(n: int) -> int:
    """The next number from n on with at most two leading bits set: 1, 2, 3, 4, 6, 8, 12, ..."""
    step = 1 << max((n - 1).bit_length() - 2, 0)
    return -(-n // step) * step


def codes_of(texts: Sequence[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(texts), n)


@dataclass
class Model:
    """Pieces of a model file; ids are positions in it."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    kind: int
    dummy_prefix: bool
    keys: np.ndarray = field(init=False)  # sorted hashes of the normal pieces, and their ids
    ids: np.ndarray = field(init=False)
    hashes: np.ndarray = field(init=False)  # of each id
    maybe: np.ndarray = field(init=False)
    lengths: np.ndarray = field(init=False)
    longest: int = field(init=False)
    rank: np.ndarray = field(init=False)  # of BPE: the lower, the sooner merged
    parts: np.ndarray = field(init=False)  # of BPE: the pieces whose merge gives each id, itself twice if none

    def __post_init__(self) -> None:
        self.lengths = np.array([len(p) for p in self.pieces])
        self.hashes = np.zeros(len(self.pieces), dtype=np.uint64)
        normal = np.flatnonzero(self.kinds == NORMAL)
        for n in np.unique(self.lengths[normal]):
            at = normal[self.lengths[normal] == n]
            self.hashes[at] = sequence_hash(codes_of([self.pieces[i] for i in at], n)) + np.uint64(n)
        order = normal[np.argsort(self.hashes[normal])]
        self.keys, self.ids, self.longest = self.hashes[order], order, int(self.lengths[normal].max())
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece has a space or line feed behind another character")
        self.maybe = np.zeros(1 << 18, dtype=bool)  # low bits of the keys
        self.maybe[self.keys & np.uint64((1 << 18) - 1)] = True
        self.memo_pair, self.memo_ok = np.full(MEMO_PAIRS, -1), np.zeros(MEMO_PAIRS, dtype=bool)
        near = {p[i : i + 2] for k, p in enumerate(self.pieces) if self.kinds[k] == NORMAL for i in range(len(p) - 1)}
        self.pairs = np.array(sorted(ord(a) << 21 | ord(b) for a, b in near) or [-1], dtype=np.int64)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.floor = float(self.scores[normal].min()) - 10.0  # what an unknown character costs
        if self.kind == BPE:
            self.rank = np.empty(len(self.pieces), dtype=np.int64)
            self.rank[np.lexsort((np.arange(len(self.pieces)), -self.scores))] = np.arange(len(self.pieces))
            self.split()

    @classmethod
    def load(cls, content: bytes) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(content)
        normal = m.normalizer_spec
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are, with blanks escaped in front of words, are supported")
        if m.trainer_spec.model_type not in (UNIGRAM, BPE) or any(p.type == USER_DEFINED for p in m.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        return cls([p.piece for p in m.pieces], np.array([p.score for p in m.pieces]), np.array([p.type for p in m.pieces]), m.trainer_spec.model_type, m.normalizer_spec.add_dummy_prefix)

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """The id of the normal piece with each hash, or -1."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ids[at], -1)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of the piece that two pieces make, or -1."""
        n = self.lengths[b]
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest + 1, BASE)]))
        h = (self.hashes[a] - self.lengths[a].astype(np.uint64)) * power[n] + self.hashes[b] - n.astype(np.uint64)
        size = self.lengths[a] + n
        return np.where(size > self.longest, -1, self.probe(h + size.astype(np.uint64)))

    def split(self) -> None:
        """Find the last merge of each piece, shortest pieces first: the Viterbi path of the piece itself without its last step."""
        everything = np.arange(len(self.pieces))
        self.parts = np.stack([everything, everything], axis=1)
        normal = np.flatnonzero(self.kinds == NORMAL)
        for n in range(2, self.longest + 1):
            at = normal[self.lengths[normal] == n]
            if not len(at):
                continue
            codes = codes_of([self.pieces[i] for i in at], n)
            best = np.full(len(at), -1)
            for cut in range(1, n):  # the cut whose two sides are pieces that stand next to each other until the last merge
                left = self.probe(sequence_hash(codes[:, :cut]) + np.uint64(cut))
                right = self.probe(sequence_hash(codes[:, cut:]) + np.uint64(n - cut))
                ok = np.flatnonzero((left >= 0) & (right >= 0) & (best < 0))
                ok = ok[self.apart(left[ok], right[ok], at[ok])]
                best[ok] = cut
                self.parts[at[ok], 0], self.parts[at[ok], 1] = left[ok], right[ok]

    def apart(self, a: np.ndarray, b: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
        """True where merging the characters of a and b gives a and then b, or, given the merged id, only last that id.

        Follows the merges back: at each step the later of the two sides' outer merges is undone, and a merge over the
        boundary must not come before one of those that were undone.
        """
        a, b, live = a.copy(), b.copy(), np.arange(len(a))
        good = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        first = True
        while len(live):
            x, y = a[live], b[live]
            over = self.joined(x, y)
            rank = np.where(over >= 0, self.rank[over], np.iinfo(np.int64).max)
            # Equal characters merge from the left: over the boundary, the left side's undone merge goes first on a tie.
            bad = rank < limit[live]
            if first and whole is not None:
                bad &= over != whole[live]
            good[live[bad]] = False
            first = False
            can_x, can_y = self.parts[x, 0] != x, self.parts[y, 0] != y
            undo_x = can_x & (~can_y | (self.rank[x] > self.rank[y]))
            undo_y = can_y & ~undo_x
            limit[live[undo_x]] = self.rank[x[undo_x]]
            limit[live[undo_y]] = self.rank[y[undo_y]] + 1
            a[live[undo_x]] = self.parts[x[undo_x], 1]
            b[live[undo_y]] = self.parts[y[undo_y], 0]
            live = live[(undo_x | undo_y) & ~bad]
        return good

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of the piece that ends at each position on the best path to it, for rows of code points."""
        rows, n = codes.shape
        c, powers = code_hash(codes), np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, BASE)]))
        last, back = np.full((rows, n + 1), -1, dtype=np.int32), np.ones((rows, n + 1), dtype=np.int32)
        score = np.full((rows, n + 1), -np.inf)
        score[:, 0] = 0
        for end in range(1, n + 1):
            h = np.zeros(rows, dtype=np.uint64)
            best = score[:, end - 1] + self.floor  # an unknown character
            for size in range(1, min(end, self.longest) + 1):
                h += c[:, end - size] * powers[size - 1]
                key = h + np.uint64(size)
                at = np.flatnonzero(self.maybe[key & np.uint64((1 << 18) - 1)])
                piece = self.probe(key[at])
                at, piece = at[piece >= 0], piece[piece >= 0]
                if not len(at):
                    continue
                start = end - size
                if self.kind == BPE:
                    # The path before must not end within what this piece would merge with.
                    before = last[at, start]
                    ok = np.ones(len(at), dtype=bool)
                    inner = np.flatnonzero((before >= 0) & (start > 0))
                    if len(inner):
                        ok[inner] = self.compatible(before[inner].astype(np.int64) * len(self.pieces) + piece[inner])
                    value = np.where(ok, score[at, start] + 1.0, -np.inf)
                else:
                    value = score[at, start] + self.scores[piece]
                better = value > best[at]
                at = at[better]
                best[at], last[at, end], back[at, end] = value[better], piece[better], size
            score[:, end] = best
        return last, back

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """apart() of each left * pieces + right; the last result of each slot is remembered."""
        slot = ((pairs.astype(np.uint64) * BASE) >> np.uint64(40)).astype(np.int64) & (MEMO_PAIRS - 1)
        known = self.memo_pair[slot] == pairs
        ok = self.memo_ok[slot]
        if not known.all():
            new, back_to = np.unique(pairs[~known], return_inverse=True)
            fresh = self.apart(new // len(self.pieces), new % len(self.pieces))
            ok[~known] = fresh[back_to]
            self.memo_pair[slot[~known]], self.memo_ok[slot[~known]] = pairs[~known], fresh[back_to]
        return ok

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, by a Viterbi over all words of a length together.

        A length is filled up to the next of 1, 2, 3, 4, 6, 8, 12, 16, 24, ...: the path to a position depends on nothing
        behind it, and few lengths keep the steps few, however small a batch is.
        """
        lengths, out = np.array([len(w) for w in words], dtype=np.int64), [None] * len(words)
        filled = np.array([filled_up(n) for n in range(int(lengths.max(initial=0)) + 1)])[lengths]
        for n in np.unique(filled):
            every = np.flatnonzero(filled == n)
            for at in np.array_split(every, 1 + len(every) * int(n) // CELLS):
                if not len(at):
                    continue
                codes = codes_of([words[i].ljust(n, "\0") for i in at], n)
                last, back = self.viterbi(codes)
                found, where = np.zeros((len(at), n), dtype=np.int32), lengths[at]
                used = np.zeros((len(at), n), dtype=bool)
                while (live := np.flatnonzero(where > 0)).size:  # follow the backpointers of all rows together
                    end = where[live]
                    found[live, end - 1], used[live, end - 1] = last[live, end], True
                    where[live] = end - back[live, end]
                unknown = (found < 0).any(axis=1).tolist()
                ends = np.cumsum(used.sum(axis=1)).tolist()
                ids, begin = found[used], 0
                for k, i in enumerate(at.tolist()):
                    out[i] = ids[begin : ends[k]] if not unknown[k] else self.with_bytes(found[k], used[k], words[i])
                    begin = ends[k]
        return out

    def remember(self, words: list[str], memo: dict[str, bytes]) -> None:
        """Put the ids of new words into memo. Between two characters that no piece has next to each other a word is cut
        first, which changes no path: its parts repeat far more often than it."""
        joined = "".join(words)
        codes = codes_of([joined], len(joined))[0].astype(np.int64)
        pair = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        starts = np.concatenate([[True], self.pairs[at] != pair])
        first = np.cumsum([0, *map(len, words[:-1])])
        starts[first] = True
        begin = np.flatnonzero(starts)
        parts = [joined[a:b] for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(joined)], strict=True)]
        new = [p for p in dict.fromkeys(parts) if p not in memo]
        memo.update((p, i.astype(np.int32).tobytes()) for p, i in zip(new, self.words(new), strict=True))
        where = [*np.searchsorted(begin, first).tolist(), len(parts)]
        memo.update((w, b"".join([memo[p] for p in parts[a:b]])) for w, a, b in zip(words, where, where[1:], strict=False) if b > a + 1)

    def with_bytes(self, found: np.ndarray, used: np.ndarray, word: str) -> np.ndarray:
        """Characters without a piece become their bytes' pieces, or the unknown piece where the model has none."""
        ids: list[int] = []
        for end in np.flatnonzero(used).tolist():
            if found[end] >= 0:
                ids.append(int(found[end]))
            elif self.bytes:
                ids += [self.bytes[b] for b in word[end].encode("utf-8", "replace")]
            else:
                ids.append(self.unknown)
        return np.array(ids, dtype=np.int64)

    def encode(self, texts: Sequence[str], memo: dict[str, bytes] | None = None) -> list[np.ndarray]:
        """Ids of each text; each distinct word is encoded once, and remembered in memo. An empty text has none."""
        memo = {} if memo is None else memo
        ready = [(SPACE if self.dummy_prefix and t else "") + t.replace(" ", SPACE) for t in texts]
        if len(ready) == 1 and len(ready[0]) > BATCH_CHARS:
            return [self.encode_long(ready[0], memo)]
        split = [WORD.findall(t) for t in ready]
        self.learn(split, memo)
        ids = [np.frombuffer(b"".join([memo[w] for w in ws]), dtype=np.int32) for ws in split]
        self.forget(split, memo)
        return ids

    def learn(self, split: list[list[str]], memo: dict[str, bytes]) -> None:
        new = list({w for ws in split for w in ws if w not in memo})
        if new:
            self.remember(new, memo)

    def forget(self, split: list[list[str]], memo: dict[str, bytes]) -> None:
        """Leave only the words of the last batch, which has the frequent ones, in a memo that has grown too large."""
        if len(memo) > MEMO_WORDS:
            stay = {w: memo[w] for ws in split for w in ws}
            memo.clear()
            memo.update(stay)

    def encode_long(self, text: str, memo: dict[str, bytes]) -> np.ndarray:
        """Ids of one text, AT_ONCE words at a time."""
        words, out = WORD.finditer(text), []
        while part := [m.group() for m in islice(words, AT_ONCE)]:
            self.learn([part], memo)
            out.append(b"".join([memo[w] for w in part]))
            self.forget([part], memo)
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        table = self.__dict__.get("_bytes_of")
        if table is None:
            table = self.__dict__["_bytes_of"] = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model_path: str = MODEL_PATH, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """docs with ids_col (array of int) and decoded_col, the text that they decode to.

    A null text has null ids; an empty one has none. Repeated rows each get their row. Lone surrogates, which UTF-8
    cannot hold, are replaced. Columns of docs that are named ids_col or decoded_col are replaced; others stay. The
    model file is read on the driver and shipped with the job; one that normalises texts is refused.
    """
    kept = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    sent = kept if text_col in kept else [*kept, text_col]  # the text goes to Python once, as a column of its row
    held, text_at = docs.select(F.struct(*(named(c).alias(f"c{k}") for k, c in enumerate(sent))).alias("row")), sent.index(text_col)
    content = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = Model.load(content.value), {}
        for batch in batches:
            column, at = batch.column(0).field(text_at), 0
            while at < len(batch):
                end, size = at, 0
                while end < len(batch) and (end == at or size < BATCH_CHARS):
                    size += len(column[end].as_py() or "")
                    end += 1
                texts = column.slice(at, end - at).to_pylist()
                ids = model.encode([t or "" for t in texts], memo)
                offsets = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()), mask=pa.array([t is None for t in texts]))
                decoded = pa.array([None if t is None else model.decode(i) for t, i in zip(texts, ids, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), lists, decoded], names=["row", "ids", "decoded"])
                at = end

    coded = held.mapInArrow(run, T.StructType([held.schema["row"], *added]))
    return coded.select(*(F.col("row").getField(f"c{k}").alias(c) for k, c in enumerate(kept)), F.col("ids").alias(ids_col), F.col("decoded").alias(decoded_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, a digest of the ids and whether they decode to the text again."""
    coded = encode(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.sha2(F.coalesce(F.array_join("ids", " "), F.lit("")), 256).alias("ids_sha256"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))
