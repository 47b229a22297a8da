"""Packing: seed documents fill their windows with lexical neighbours from a sharded BM25 index."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import caches, lean, spans, table

WINDOW, END = 4096, 2
#: Tokens of one shard of the index, neighbours that it gives at a time, and tokens of a task about.
SHARD_TOKENS, NEIGHBOURS, TASK_TOKENS = 2_000_000, 48, 8_000_000
K1, B = 1.2, 0.75
#: A term in at least one of so many documents of a shard has its weights as a row for all documents.
DENSE = 8
#: Classes of bytes: white space, ASCII marks, small ASCII letters; and every byte with A-Z lower-cased.
SPACE = np.isin(np.arange(256), list(b" \n\t\r"))
MARK = np.isin(np.arange(256), [c for c in range(33, 127) if not chr(c).isalnum()])
SMALL = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"))
LOWER = np.arange(256, dtype=np.uint8) + 32 * np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")).astype(np.uint8)
#: First byte of the letters from À to ÿ in UTF-8; their second bytes, from À to Þ and from ß to ÿ.
LATIN = 0xC3
CAPITAL = np.isin(np.arange(256), [b for b in range(0x80, 0x9F) if b != 0x97])
LATIN_SMALL = np.isin(np.arange(256), [b for b in range(0x9F, 0xC0) if b != 0xB7])
#: The characters that stand for bytes in the vocabulary; a space is itself.
BYTES = np.arange(256, dtype="<u2")
BYTES[[b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]] = 256 + np.arange(68)
BYTES[32] = 32
#: Some words that show whether a tokenizer takes words of small Latin letters as its bare model does.
PROBE = ["a", "the", "strengths", "größe", "année", "ñandúes", "øæåþðÿ", "xqzkvj", "internationalisation", "straße", "àíáâã"]
#: Words that a worker keeps with their ids, and bytes of them; beyond either it starts anew. Letter words asked at a time.
CACHED, CACHED_BYTES, ASKED = 1_000_000, 24 << 20, 2_000


class Words:
    """Token ids of white-space separated words, each looked up once. The tokenizer's pre-tokens never hold white space,
    so the ids of a text are those of its words in a row."""

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.t = Tokenizer.from_file(tokenizer_file)
        self.bare = Tokenizer(self.t.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.size = self.t.get_vocab_size()
        if self.size > 1 << 16 or self._each(["a b"])[0] != b"".join(self._each(["a", "b"])):
            raise ValueError("not a word-wise tokenizer of at most 2^16 ids")
        self.is_end = np.array([(self.t.id_to_token(i) or "").endswith("</w>") for i in range(self.size)])
        self.is_bare = self._each(PROBE) == self._each([as_bytes(np.frombuffer(w.encode(), np.uint8)) for w in PROBE], self.bare)
        self._forget()

    def _forget(self) -> None:
        """Start the kept words anew: their forms, where the ids of each begin in the pool and how many they are."""
        self.known = pa.array([], pa.large_string())
        self.begin, self.count, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u2")

    def _each(self, words: list[str], tokenizer=None) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in (tokenizer or self.t).encode_batch_fast(words, add_special_tokens=False)] if words else []

    def _together(self, line: str, n: int, tokenizer) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of n letter words with spaces between and how many each has, by one call: each of them is one pre-token
        and ends with its only word-end id. None if the tokenizer takes some apart."""
        ids = np.array(tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u2")
        ends = np.flatnonzero(self.is_end[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == n else None

    def _learn(self, forms: pa.Array) -> None:
        """Keep words, which are not empty, with their ids. Small Latin letters stay as they are in the tokenizer's normal
        form and pass its pattern in one, so that words of them go to its bare model."""
        at, data = buffers(forms)
        fine, lead = SMALL[data], np.flatnonzero(data == LATIN)
        lead = lead[LATIN_SMALL[data[lead + 1]]]
        fine[lead] = fine[lead + 1] = True
        small = np.logical_and.reduceat(fine, at[:-1]) & self.is_bare
        count, parts, order = np.zeros(len(forms), np.int64), [], []

        def put(which: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
            count[which] = n
            parts.append(ids)
            order.append(which)

        left = []
        for letters, tokenizer in ((np.flatnonzero(small), self.bare), (np.flatnonzero(~small), self.t)):
            for i in range(0, len(letters), ASKED):
                which = letters[i : i + ASKED]
                if tokenizer is self.bare:
                    own_at, own = buffers(forms.take(pa.array(which)))
                    got = self._together(as_bytes(np.insert(own, own_at[1:-1], 32)), len(which), tokenizer)
                else:
                    words = forms.take(pa.array(which)).to_pylist()
                    alpha = np.array([w.lower().isalpha() for w in words])
                    left.append(which[~alpha])
                    which = which[alpha]
                    got = self._together(" ".join([w for w, a in zip(words, alpha.tolist(), strict=True) if a]), len(which), tokenizer)
                if got is None:
                    left.append(which)
                else:
                    put(which, *got)
        rest = np.concatenate(left) if left else np.empty(0, np.int64)
        found = self._each(forms.take(pa.array(rest)).to_pylist())
        put(rest, np.frombuffer(b"".join(found), "<u2"), np.fromiter(map(len, found), np.int64, len(found)) // 2)
        by = np.concatenate(order)
        begin = np.empty(len(forms), np.int64)
        begin[by] = len(self.pool) + np.cumsum(count[by]) - count[by]
        self.known = pa.concat_arrays([self.known, forms])
        self.begin, self.count, self.pool = np.append(self.begin, begin), np.append(self.count, count), np.concatenate([self.pool, *parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        ids, at = self.flat(pa.array(texts, pa.string()))
        return [ids[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with its end id, and where each text begins, with the end of the last. Words
        are cut and told apart in the column's bytes; each form of them is asked once."""
        if len(self.known) > CACHED or self.known.nbytes > CACHED_BYTES:
            self._forget()
        forms, words = cut_words(texts)
        which = pc.index_in(forms.dictionary, value_set=self.known).fill_null(-1).to_numpy()
        if len(new := np.flatnonzero(which < 0)):
            which = which.copy()
            which[new] = len(self.known) + np.arange(len(new))
            self._learn(forms.dictionary.take(pa.array(new)))
        # each text's end id is the last of the pool here
        pool = np.append(self.pool, np.array([END], "<u2"))
        begin, count = np.append(self.begin[which], len(self.pool)), np.append(self.count[which], 1)
        codes = np.insert(forms.indices.to_numpy(), words, len(begin) - 1)
        n = count[codes]
        upto = np.cumsum(n)
        ids = pool[np.arange(n.sum()) + np.repeat(begin[codes] - (upto - n), n)]
        return ids, np.append(0, upto[words + np.arange(len(words))])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each of some large strings or binaries without nulls begins, with the end of the last, and their bytes."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return at - at[0], np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]


def as_bytes(raw: np.ndarray) -> str:
    """Words of UTF-8 with spaces between, a character for each byte as in the vocabulary."""
    return BYTES[raw].tobytes().decode("utf-16-le")


def cut_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in a row, and how many there are up to the end of each text. A-Z and À-Þ are lower-cased, as
    the tokenizer does anyway, and ASCII marks at the end of a word, behind a Latin letter, where its pre-tokens end, are a
    word of their own, so that a word has one form. Letters before one beyond ÿ stay as they are, since the tokenizer composes
    first, and a mark may compose with the small letter only; so do words where a special token may stand (`<|`)."""
    at, raw = buffers(texts.cast(pa.large_string()).fill_null(""))
    end = at[1:] + np.arange(len(texts))
    raw = np.insert(raw, at[1:], 32)  # a space behind each text
    space = SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    data = LOWER[raw]
    lead = np.flatnonzero(data == LATIN) + 1
    lead = lead[CAPITAL[data[lead]]]
    data[lead] += 32
    before = np.flatnonzero(raw >= 0xC4) - 1
    data[before] = raw[before]
    # runs of marks from s to e
    mark = MARK[data]
    edges = np.flatnonzero(np.diff(mark, prepend=False))
    s, e = edges[::2], edges[1::2]
    whole = space[e]
    s = s[whole]
    tail = s[SMALL[data[s - 1]] | (LATIN_SMALL[data[s - 1]] & (data[s - 2] == LATIN))]
    special = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
    if len(special):
        begins, ends = np.flatnonzero(first), np.flatnonzero(space[1:] & ~space[:-1]) + 1
        some = np.unique(np.searchsorted(begins, special, side="right") - 1)
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[begins[some]] += 1
        inside[ends[some]] -= 1
        inside = np.cumsum(inside, dtype=np.int8)[:-1].astype(bool)
        data = np.where(inside, raw, data)
        tail = tail[~inside[tail]]
    first[tail] = True
    kept = ~space
    begins = np.flatnonzero(first[kept])
    forms = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(np.append(begins, np.count_nonzero(kept))), pa.py_buffer(data[kept])]).dictionary_encode()
    return forms, np.searchsorted(np.flatnonzero(first), end)


@lru_cache(maxsize=2)
def words(tokenizer_file: str) -> Words:
    return Words(tokenizer_file)


caches.append(words)


def _encode_batches(tokenizer_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (kind 0, id, tokens and ids of a document), and at the end (kind 1, token, its documents here)."""
        lean(words)
        w = words(tokenizer_file)
        df = np.zeros(1 << 16, np.int64)
        names = ["kind", "id", "n", "ids"]
        for batch in batches:
            for first, count in spans(batch, 1, 4 << 20):
                ids, at = w.flat(batch.column(1).slice(first, count))
                df += np.bincount(terms_of(ids, at)[1], minlength=len(df))
                rows = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.record_batch([pa.array(np.zeros(count, np.int32)), batch.column(0).slice(first, count), pa.array(np.diff(at)), rows], names=names)
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.ones(len(some), np.int32)), pa.array(some), pa.array(df[some]), pa.nulls(len(some), pa.binary())], names=names)

    return run


def _key_batches(strength: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, id, ids) of rows (id, ids)."""
        for batch in batches:
            for first, count in spans(batch, 1, 4 << 20):
                some = batch.slice(first, count)
                at, raw = buffers(some.column(1).cast(pa.large_binary()))
                yield pa.record_batch([pa.array(strongest(raw.view("<u2"), at // 2, strength)), *some.columns], names=["key", "id", "ids"])

    return run


def terms_of(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, how often it stands there) by document and id, of documents that lie in a row; none may be empty."""
    n = np.diff(at)
    kind = np.uint32 if len(n) <= 1 << 16 else np.uint64
    s = np.repeat(np.arange(len(n), dtype=kind) << kind(16), n) | ids
    s.sort()
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    tf = np.diff(np.append(first, len(s)))
    s = s[first].astype(np.int64)
    return s >> 16, s & 0xFFFF, tf


def weights(tf: np.ndarray, idf: np.ndarray, length, mean: float) -> np.ndarray:
    """BM25 weights of terms that stand tf times in a document of some length."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def strongest(ids: np.ndarray, at: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """The three heaviest terms of each document as one number, the heaviest first and ties by id; those without strength do
    not count."""
    doc, term, tf = terms_of(ids, at)
    w = strength[term] * tf / (tf + K1)
    start = np.searchsorted(doc, np.arange(len(at) - 1))
    n = np.diff(np.append(start, len(doc)))
    key, shift = np.zeros(len(start), np.int64), 32
    for _ in range(3):
        best = np.maximum.reduceat(w, start)
        top = np.flatnonzero((w == np.repeat(best, n)) & (w > 0))
        own, first = np.unique(doc[top], return_index=True)
        key[own] += term[top[first]] << shift
        w[top[first]] = 0
        shift -= 16
    return key


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    """BM25's inverse document frequency."""
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Shard:
    """BM25 index over some documents, and which of their ids are still unused."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.docs, self.at = docs, np.zeros(len(docs), np.int64)
        self.left = np.array([len(d) for d in docs])
        doc, term, tf = terms_of(np.concatenate(docs), np.append(0, np.cumsum(self.left)))
        weight = weights(tf, idf[term], self.left[doc], mean).astype(np.float32)
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        size = np.bincount(term, minlength=len(idf))
        self.end = np.cumsum(size)
        self.start = self.end - size
        often = np.flatnonzero(size * DENSE >= max(DENSE, len(docs)))
        self.row = np.full(len(idf), -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), len(docs)), np.float32)
        dense = np.flatnonzero(self.row[term[order]] >= 0)
        self.rows[self.row[term[order[dense]]], self.doc[dense]] = self.weight[dense]
        self.term, self.term_at = term, np.searchsorted(doc, np.arange(len(docs) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document for all terms of the seed."""
        ask = self.term[self.term_at[seed] : self.term_at[seed + 1]]
        often = self.row[ask]
        rare = ask[often < 0]
        s, n = self.start[rare], self.end[rare] - self.start[rare]
        pick = np.arange(n.sum()) + np.repeat(s - (np.cumsum(n) - n), n)
        score = np.bincount(self.doc[pick], self.weight[pick], len(self.docs))
        return score + self.rows[often[often >= 0]].sum(0)

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents with unused ids by falling score against the seed, the seed left out."""
        score = self.scores(seed)
        score[self.left == 0] = 0
        score[seed] = 0
        some = np.flatnonzero(score)
        if len(some) > NEIGHBOURS:
            some = some[np.argpartition(-score[some], NEIGHBOURS)[:NEIGHBOURS]]
        return some[np.lexsort((some, -score[some]))]

    def take(self, doc: int, most: int) -> tuple[int, int, int]:
        """(document, start, length) of the next ids of a document."""
        n = min(most, int(self.left[doc]))
        start = int(self.at[doc])
        self.at[doc] += n
        self.left[doc] -= n
        return doc, start, n


def pack(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length). Each begins with an unused document, or the rest of one that was cut, takes
    the retrieved neighbours that fit whole, then cuts the best of the others to end full. What is left at the end goes
    into sequences whose lengths are powers of two, which need no padding."""
    shard = Shard(docs, idf, mean)
    windows: list[list[tuple[int, int, int]]] = []
    seed, rest = 0, -1
    while True:
        if rest < 0 or not shard.left[rest]:
            while seed < len(docs) and not shard.left[seed]:
                seed += 1
            if seed == len(docs):
                break
            rest = seed
        first = rest
        pieces = [shard.take(first, window)]
        room = window - pieces[0][2]
        while room:
            near = shard.neighbours(first)
            if not len(near):
                while seed < len(docs) and not shard.left[seed]:
                    seed += 1
                if seed == len(docs):
                    break
                near = np.array([seed])
            whole = False
            for d in near.tolist():
                if shard.left[d] <= room:
                    pieces.append(shard.take(d, room))
                    room -= pieces[-1][2]
                    whole = True
                    if not room:
                        break
            if room and not whole:
                rest = int(near[0])
                pieces.append(shard.take(rest, room))
                room = 0
        windows.append(pieces)
        if room:
            break
    if windows and (total := sum(p[2] for p in windows[-1])) < window:
        pieces = windows.pop()
        for bit in range(total.bit_length() - 1, -1, -1):
            need, part = (1 << bit) if total >> bit & 1 else 0, []
            while need:
                d, s, n = pieces[0]
                m = min(n, need)
                part.append((d, s, m))
                pieces = [(d, s + m, n - m), *pieces[1:]] if m < n else pieces[1:]
                need -= m
            if part:
                windows.append(part)
    return windows


def _pack_batches(idf: np.ndarray, mean: float, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        docs: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal number
            out = []
            for pieces in pack(docs, idf, mean, window):
                at = 0
                for d, s, n in pieces:
                    own = docs[d][s : s + n]
                    out.append((ids[d], s, n, crc32(own.astype("<u4").tobytes()), len(docs[d]), number, at, own.astype(np.int32) if with_ids else None))
                    at += n
                number += 1
            columns = list(zip(*out, strict=True))
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.list_(pa.int32()))], names=names)

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                docs.append(np.frombuffer(raw, "<u2"))
                held += len(docs[-1])
                if held >= SHARD_TOKENS:
                    yield close()
                    ids, docs, held = [], [], 0
        if docs:
            yield close()

    return run


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """One row per piece (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    Each document's ids, with an end id, lie in exactly one piece each; pieces follow each other in a sequence without
    gaps. Tokens are counted over all documents for the index weights. Documents are sorted by their three strongest
    terms, so that those that share them stand in one shard of the index, or in shards next to each other, wherever they
    stood in the table. How strong a term is for this order is told by its count over all documents too; terms that stand
    in one of them alone do not count. Tasks get ranges of the order, and a hash of the row parts a
    key that fills several. A shard is a run of a task's rows, bounded by SHARD_TOKENS and one document. A seed asks its
    shard for all its terms. A lost executor's shard is packed again alike.

    A null or empty text is the end id alone; null and repeated ids keep their rows; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tokens = table(rows.mapInArrow(_encode_batches(tokenizer_file), "kind int, id long, n long, ids binary"), "tokens")
    # at most one row for each token of the vocabulary comes to the driver
    counts = tokens.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(1 << 16)
    df[counts.column("id").to_numpy()] = counts.column("n").to_numpy()
    texts = tokens.where("kind = 0")
    size = texts.agg(F.count("*").alias("n"), F.sum("n").alias("tokens")).first()
    idf = np.where(df > 0, inverse(df, size["n"]), 0.0)
    mean = (size["tokens"] or 1) / max(1, size["n"])
    strength = np.where(df < 2, 0.0, inverse(df, max(1, int(df.max()))))
    keyed = table(texts.select("id", "ids").mapInArrow(_key_batches(strength), "key long, id long, ids binary"), "keyed")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size["tokens"] or 0) // TASK_TOKENS))
    order = [F.col("key"), F.xxhash64("id", "ids"), F.col("id"), F.col("ids")]
    dealt = keyed.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order).select("id", "ids")
    packed = dealt.mapInArrow(_pack_batches(idf, mean, window, with_ids), "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")
    packed = packed.withColumnRenamed("id", id_col)
    return packed if with_ids else packed.drop("ids")
