"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
NONE = np.iinfo(np.int64).max
#: Words that a worker keeps with their ids; then it starts anew.
CACHED = 400_000
#: Characters of a segment from which on it is merged by a heap: a segment needs a round for each of its pair ranks, and a
#: long unbroken one has thousands.
LONG = 512


class PieceCodec:
    """Encodes and decodes like the sentencepiece library does for a BPE model with byte fallback.

    The model must have the identity normaliser, a dummy prefix and no removal of extra white space, and no piece that
    goes over a word's start or holds a line feed; other models are refused. A text is then a row of segments that
    never merge with each other: a run of spaces with the word behind it, or a line feed.
    """

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = m.vocab_size()
        self.eos = m.eos_id()
        pieces = [m.id_to_piece(i) for i in range(self.size)]
        normal = [i for i in range(self.size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        byte_id = {int(pieces[i][3:5], 16): i for i in range(self.size) if m.is_byte(i)}
        if len(byte_id) != 256 or any(SPACE in pieces[i].lstrip(SPACE) or "\n" in pieces[i] for i in normal):
            raise ValueError("not a word-wise BPE model with byte fallback")
        if m.encode(" a  b") != m.encode([" a  b"])[0] or m.decode(m.encode(" a  b ")) != " a  b ":
            raise ValueError("the model removes white space")
        self.bytes_of = [byte_id[b] for b in range(256)]
        self.surface = [b""] * self.size
        for i in normal:
            self.surface[i] = pieces[i].replace(SPACE, " ").encode()
        for b, i in byte_id.items():
            self.surface[i] = bytes([b])
        self.surface[m.unk_id()] = " ⁇ ".encode()
        self.text_of = [str(i) for i in range(self.size)]

        # Symbols: the ids of normal pieces, then characters that stand in pieces only, then -1 for all other characters.
        symbol = {pieces[i]: i for i in normal}
        for i in normal:
            for c in pieces[i]:
                symbol.setdefault(c, len(self.surface) + len(symbol))
        self.of_char = np.full(0x110000, -1, np.int64)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.base = max(symbol.values()) + 1
        scores = {i: m.get_score(i) for i in normal}
        order = sorted(set(scores.values()), reverse=True)
        rank_of_score = {s: r for r, s in enumerate(order)}
        self.shared = np.bincount([rank_of_score[s] for s in scores.values()], minlength=len(order)) > 1
        table = {}
        for i in normal:
            p = pieces[i]
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    table[symbol[p[:k]] * self.base + symbol[p[k:]]] = (i, rank_of_score[scores[i]])
        self.table = table
        self.keys = np.array(sorted(table), np.int64)
        self.to = np.array([table[k][0] for k in self.keys.tolist()], np.int64)
        self.rank = np.array([table[k][1] for k in self.keys.tolist()], np.int64)
        self.cache: dict[str, tuple[str, bytes]] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NONE where it is no piece."""
        key = np.where((left >= 0) & (right >= 0), left * self.base + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.to[at], -1)

    def _one(self, symbols: list[int], chars: list[int]) -> list[int]:
        """The same for one word, a merge at a time with a heap: for words in which the order within a round matters."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and symbols[i] >= 0 and symbols[j] >= 0 and (hit := self.table.get(symbols[i] * self.base + symbols[j])):
                heapq.heappush(heap, (hit[1], i, symbols[i], symbols[j]))

        for i in range(n):
            push(i)
        gone = [False] * n
        while heap:
            _, i, s, t = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or symbols[i] != s or symbols[j] != t:
                continue
            symbols[i] = self.table[s * self.base + t][0]
            gone[j] = True
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i])
            push(i)
        return self._ids([s for s, g in zip(symbols, gone, strict=True) if not g], [c for c, g in zip(chars, gone, strict=True) if not g])

    def _ids(self, symbols: list[int], chars: list[int]) -> list[int]:
        if min(symbols) >= 0 and max(symbols) < self.size:
            return symbols
        out = []
        for s, c in zip(symbols, chars, strict=True):
            if 0 <= s < self.size:
                out.append(s)
            else:
                out += [self.bytes_of[b] for b in chr(c).encode("utf-8", "replace")]
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of segments. All segments but those of LONG characters or more go through the rounds together; each round
        merges, in every segment, all leftmost non-overlapping occurrences of the segment's best pair and closes the gaps."""
        out: list[list[int]] = [[] for _ in words]
        for k, w in enumerate(words):
            if len(w) >= LONG:
                own = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                out[k] = self._one(self.of_char[own].tolist(), own.tolist())
        short = [k for k, w in enumerate(words) if len(w) < LONG]
        if len(short) < len(words):
            for k, ids in zip(short, self.encode_words([words[k] for k in short]), strict=True):
                out[k] = ids
            return out
        if not words:
            return out
        char = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start_char = char
        sizes = np.array([len(w) for w in words])
        offset = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        symbol = self.of_char[char]
        last_rank = np.full(len(words), -1, np.int64)
        many = np.zeros(len(words), bool)
        slow: list[int] = []

        def settle(mask: np.ndarray) -> None:
            """Give out the segments of the masked symbols."""
            w, s, c = word[mask], symbol[mask].tolist(), char[mask].tolist()
            cuts = [0, *(np.flatnonzero(w[1:] != w[:-1]) + 1).tolist(), len(s)]
            for k, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e > k:
                    out[w[k]] = self._ids(s[k:e], c[k:e])

        while len(symbol):
            same = np.zeros(len(symbol), bool)
            same[:-1] = word[1:] == word[:-1]
            rank, to = np.full(len(symbol), NONE), np.full(len(symbol), -1)
            at = np.flatnonzero(same)
            rank[at], to[at] = self._pairs(symbol[at], symbol[at + 1])
            first = np.concatenate(([True], word[1:] != word[:-1]))
            starts = np.flatnonzero(first)
            best = np.minimum.reduceat(rank, starts)
            ids = word[starts]
            bad = many[ids] & (best < last_rank[ids])  # a merge of the last round made a better pair
            if bad.any():
                slow += ids[bad].tolist()
                best = np.where(bad, NONE, best)
            best_at = np.repeat(best, np.diff(np.append(starts, len(symbol))))
            done = best_at == NONE
            pick = (rank == best_at) & ~done
            begins = pick & ~np.concatenate(([False], pick[:-1] & same[:-1]))
            run = np.maximum.accumulate(np.where(begins, np.arange(len(pick)), -1))
            pick &= (np.arange(len(pick)) - run) % 2 == 0
            count = np.add.reduceat(pick, starts, dtype=np.int64)
            tied = (count > 1) & (best != NONE)
            tied[tied] = self.shared[best[tied]]
            touch = np.flatnonzero(pick[:-2] & pick[2:] & (word[:-2] == word[2:])) if len(pick) > 2 else np.empty(0, np.int64)
            if len(touch):
                better, _ = self._pairs(to[touch], symbol[touch + 2])
                tied |= np.isin(ids, word[touch[better < rank[touch]]])
            if tied.any():
                slow += ids[tied].tolist()
                stop = np.repeat(tied, np.diff(np.append(starts, len(symbol))))
                done |= stop
                pick &= ~stop
            if done.any():
                settle(done)
            last_rank[ids], many[ids] = best, count > 1
            symbol = np.where(pick, to, symbol)
            keep = ~done
            keep[1:] &= ~pick[:-1]
            symbol, word, char = symbol[keep], word[keep], char[keep]
        for w in slow:
            own = start_char[offset[w] : offset[w] + sizes[w]]
            out[w] = self._one(self.of_char[own].tolist(), own.tolist())
        return out

    SEGMENT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def segments(self, text: str) -> list[str]:
        return self.SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_batch(self, texts: list[str]) -> list[list[tuple[str, bytes]]]:
        """For each text its segments' (decimal ids joined by a space, decoded bytes)."""
        parts = [self.segments(t) for t in texts]
        if len(self.cache) > CACHED:
            self.cache = {}
        cache = self.cache
        new = list({w for p in parts for w in p if w not in cache})
        text_of, surface = self.text_of, self.surface
        long_ones = {}
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            for w, ids in zip(some, self.encode_words(some), strict=True):
                (cache if len(w) <= 100 else long_ones)[w] = (" ".join([text_of[i] for i in ids]), b"".join([surface[i] for i in ids]))
        if long_ones:
            return [[cache.get(w) or long_ones[w] for w in p] for p in parts]
        return [[cache[w] for w in p] for p in parts]

    def encode(self, text: str) -> list[int]:
        return [int(i) for s, _ in self.encode_batch([text])[0] for i in s.split()]

    def decode(self, ids: list[int]) -> str:
        return self.finish(b"".join([self.surface[i] for i in ids]))

    @staticmethod
    def finish(joined: bytes) -> str:
        """Text of the joined surfaces: the dummy prefix goes."""
        return joined.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    """One codec a worker process and model."""
    return PieceCodec(model_file)


def _run(model_file: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            for at, texts in slices(batch, 1, 2 << 20):
                n, ids, sha, back = [], [], [], []
                for parts in c.encode_batch(texts):
                    line = " ".join([p[0] for p in parts] + [str(c.eos)])
                    text = c.finish(b"".join([p[1] for p in parts]))
                    n.append(line.count(" ") + 1)
                    if with_text:
                        ids.append(np.fromiter(map(int, line.split(" ")), np.int32))
                        back.append(text)
                    else:
                        ids.append(hashlib.sha256(line.encode()).hexdigest())
                        sha.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids), pa.array(back if with_text else sha, pa.string())], names=["id", "n", "ids", "back"])

    return run


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row (id_col, n_tokens, ids, decoded): the piece ids of the whole text with an end id, and the text that they
    decode to; with digests=True (id_col, n_tokens, ids_sha256, decoded_sha256) instead.

    A null text is an empty one, whose only id is the end id. Any id, null or repeated, keeps its row; other columns
    are ignored. Rows are independent: no shuffle, memory bounded by one slice of a batch and the word cache.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_run(model_file, not digests), f"id {kind}, n long, ids {'string' if digests else 'array<int>'}, back string")
    return out.toDF(id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")))
