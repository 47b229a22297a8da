"""Sets of word shingles: an exact prefix-filter join by Jaccard similarity, each candidate verified."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import caches, cut, few, release, slices, table
from .components import connected_components

WIDTH, LEAST = 5, Fraction(4, 5)
#: Documents that show which shingles are frequent, about; how often such a shingle stands there; how many count at most.
#: They only set the order of the shingles: results are the same by any order.
SAMPLE, FREQUENT, MOST_FREQUENT = 10_000, 3, 200_000
#: Rows of one shingle that a task compares at once; larger groups go to tasks by pairs of blocks.
BLOCK = 1000
#: Tokens before its own that a row shows; of two rows that share one of these, the pair has been given there.
BEFORE = 8
#: Bits of the parity sketch of a set, of its short form, and at most of the form that grows with the set.
SKETCH, FOLDED, WIDE = 512, 256, 1 << 16
#: Words whose hashes a worker keeps; then it starts anew.
CACHED = 400_000


class WordHashes(dict):
    """XXH64 (seed 42) of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h

    cache_clear = dict.clear


_hashes = WordHashes()
caches.append(_hashes)


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles: `width` words in a row, the whole sequence if it
    is shorter, none for a text without words. Words are as in simhash.fingerprints_of. A shingle's hash mixes its
    words' hashes, each multiplied by its own odd constant, so that all texts of a slice are hashed at once."""
    if len(_hashes) > CACHED:
        _hashes.clear()
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    n = int(sizes.sum())
    flat = np.concatenate([np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w)) for w in words] + [np.zeros(width, np.uint64)])
    factors = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) & 0xFFFFFFFFFFFFFFFF | 1) for k in range(width)]

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))

    full = np.full(n, width, np.uint64)
    for k, f in enumerate(factors):
        full += flat[k : k + n] * f
    full = mixed(full)
    out, at = [], 0
    for size in sizes.tolist():
        if size >= width:
            out.append(np.unique(full[at : at + size - width + 1]))
        elif size:
            own = flat[at : at + size] * np.array(factors[:size])
            out.append(mixed(own.sum(keepdims=True) + np.uint64(size)))
        else:
            out.append(np.empty(0, np.uint64))
        at += size
    return out


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63)


def sketch(s: np.ndarray, bits: int = SKETCH) -> bytes:
    """For each of the buckets whether it has an odd number of shingles. Two sketches differ in no more bits than the sets
    in shingles."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide(s: np.ndarray) -> bytes:
    """A sketch of some four bits a shingle, from SKETCH to WIDE bits: a power of two."""
    return sketch(s, min(WIDE, max(SKETCH, 1 << (4 * max(1, len(s)) - 1).bit_length())))


def folded(s: bytes) -> bytes:
    """A sketch of FOLDED bits, with the same property."""
    return np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, FOLDED // 8)).tobytes()


def prefix(s: np.ndarray, frequent: np.ndarray, least: Fraction) -> np.ndarray:
    """The first shingles of a set in the order rare before frequent, then by hash: so many that any set of Jaccard
    similarity `least` or more has one of its own first ones among them."""
    n = len(s)
    if not n:
        return s
    # a search for each shingle; np.isin would sort all the frequent ones again for each text
    often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s if len(frequent) else np.zeros(n, bool)
    rare = np.argsort(often, kind="stable")
    return s[rare[: n + 1 - -(-n * least.numerator // least.denominator)]]


def may_reach(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether sets of n and m shingles could be similar enough if the first one that they share is at places `at` and `to`:
    only itself and those behind are shared then. At a later one a similar pair may fail, but it has passed at the first."""
    shared = 1 + np.minimum(n - at - 1, m - to - 1)
    p, q = least.numerator, least.denominator
    return shared * (p + q) >= p * (n + m)


def _counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, 0):
                token, n = np.unique(np.concatenate(shingle_sets(texts, width)), return_counts=True)
                yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    return run


def frequent_shingles(docs: DataFrame, n: int, width: int) -> np.ndarray:
    """The shingles of the column text that are frequent in a sample by hash of ids, sorted; n is the number of rows."""
    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE / max(1, n)))).select("text")
    often = some.mapInArrow(_counts(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    return np.sort(often.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow().column("token").to_numpy().view(np.uint64))


HASHED = "id long, class long, n long, fp long, sketch binary, folded binary, wide binary, first array<long>"


def hashed(width: int, frequent: np.ndarray, least: Fraction, fingerprints):
    """HASHED of rows (id, text): of the set its class, size, fingerprint, sketch and first shingles. First shingles are
    null where the task has given those of an equal set already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at, texts in slices(batch, 1):
                sets = shingle_sets(texts, width)
                classes = [class_of(s) for s in sets]
                first = []
                for c, s in zip(classes, sets, strict=True):
                    first.append(None if c in seen else prefix(s, frequent, least).view(np.int64))
                    seen.add(c)
                columns = [batch.column(0).slice(at, len(texts)), pa.array(classes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fingerprints(sets).view(np.int64))]
                sketches = [sketch(s) for s in sets]
                columns += [pa.array(sketches, pa.binary()), pa.array(map(folded, sketches), pa.binary()), pa.array(map(wide, sets), pa.binary())]
                yield pa.record_batch([*columns, pa.array(first, pa.list_(pa.int64()))], names=["id", "class", "n", "fp", "sketch", "folded", "wide", "first"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of runs of batches that are sorted by the first column, cut only where its value changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        start = int(np.searchsorted(columns[0], columns[0][-1]))
        if start or (held and held[-1][0][-1] != columns[0][0]):
            if start:
                held.append([c[:start] for c in columns])
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        held.append([c[start:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


SHARED = "token long, n long, class long, at long, class0 long, class1 long"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, n, class, at), sorted so: those of tokens of several classes, each with the class of the row before it
    and the leader so far, the one with the smallest place of the token: the fewer rare shingles a set has, the nearer
    it stands to what a group of near copies has in common. Of the rows of a token only the last one and the leader are
    held."""
    held = None  # the last row: (token, n, class, at, whether it is given out, class and place of the leader)
    for batch in batches:
        token, n, cls, at = (c.to_numpy() for c in batch.columns)
        if not len(token):
            continue
        lead_cls, lead_at, given = cls, at, np.zeros(len(token), bool)
        if held:
            token, n, cls, at, given, lead_cls, lead_at = (np.concatenate(([x], y)) for x, y in zip(held, (token, n, cls, at, given, lead_cls, lead_at), strict=True))
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])))
        token, n, cls, at, given, lead_cls, lead_at = (x[new] for x in (token, n, cls, at, given, lead_cls, lead_at))
        follows = np.concatenate(([False], token[1:] == token[:-1]))
        group = np.cumsum(~follows)
        place = (group[-1] - group) * (int(lead_at.max()) + 1) + lead_at  # falls from group to group
        least = np.minimum.accumulate(place)
        leader = np.maximum.accumulate(np.where(np.concatenate(([True], place[1:] < least[:-1])), np.arange(len(place)), 0))
        some = (follows | np.concatenate((follows[1:], [False]))) & ~given
        before = np.maximum(np.arange(len(token)) - 1, 0)
        pair = [pa.array(cls[before][some], mask=~follows[some]), pa.array(lead_cls[leader[before]][some], mask=~follows[some])]
        yield pa.record_batch([*(pa.array(x[some]) for x in (token, n, cls, at)), *pair], names=["token", "n", "class", "at", "class0", "class1"])
        held = (token[-1], n[-1], cls[-1], at[-1], bool(follows[-1]) or bool(given[-1]), lead_cls[leader[-1]], lead_at[leader[-1]])


def sketches_allow(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, least: Fraction) -> np.ndarray:
    """Pairs whose sketches do not rule them out: at Jaccard p / q the sets differ in (q - p) / (q + p) of their sizes."""
    p, q = least.numerator, least.denominator
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64) * (q + p) <= (q - p) * (n + m)


def _sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def met(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of x and y that have a token in common; zeros fill rows of fewer tokens and count for none."""
    both = np.zeros(len(x), bool)
    for k in range(x.shape[1]):
        both |= (x[:, k] != 0) & (y == x[:, k, None]).any(1)
    return both


def first_of_postings(open_rows: DataFrame) -> DataFrame:
    """(token, blocks) of the tokens in rows (token, n, class, at, component) where pairs of different components can meet
    first: of all tokens that the very same classes have, the first one."""
    mixed = [F.bit_xor(F.xxhash64(F.lit(k), "class")).alias(f"x{k}") for k in (0, 1)]
    tokens = open_rows.groupBy("token").agg(F.count("*").alias("rows"), *mixed, F.min(F.struct("class", "at")).alias("first"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    tokens = tokens.groupBy("rows", "x0", "x1").agg(F.min(F.struct(F.col("first.at").alias("at"), "token")).alias("one"))
    return tokens.select("one.token", F.ceil(F.col("rows") / F.lit(BLOCK)).cast("int").alias("blocks"))


def _pairs(least: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (g, n, class, at, component, block, sketch, before), sorted by g and n: the pairs of a g that may be similar
        enough by sizes, places and sketches, of different components, and of different blocks where there are two. A g has
        two blocks at most. Pairs that share one of the tokens before have met there."""
        for g, n, cls, at, component, block, sketched, before in _whole_groups(batches):
            x = np.frombuffer(b"".join(sketched.tolist()), np.uint64).reshape(len(g), -1)
            known = np.stack(before)
            starts = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]))
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                two = block[s:e].min() != block[s:e].max()
                for at_row in range(s, e, 64):
                    i, j = np.nonzero(component[at_row : min(e, at_row + 64), None] != component[None, s:e])
                    i, j = i + at_row, j + s
                    ok = (i < j) & may_reach(n[i], at[i], n[j], at[j], least)
                    if two:
                        ok &= block[i] != block[j]
                    i, j = i[ok], j[ok]
                    ok = sketches_allow(x[i], x[j], n[i], n[j], least)
                    i, j = i[ok], j[ok]
                    ok = ~met(known[i], known[j])
                    i, j = cls[i[ok]], cls[j[ok]]
                    if len(i):
                        yield pa.record_batch([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])

    return run


def differ(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the size of the shorter."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)))).sum(dtype=np.int64))


def _by_sketch(least: Fraction, same_size: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = least.numerator, least.denominator
        for b in batches:
            if not b.num_rows:
                continue
            n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
            if same_size:
                may = sketches_allow(_sketch_rows(b.column(3)), _sketch_rows(b.column(5)), n, m, least)
            else:
                bits = np.array([differ(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)])
                may = bits * (q + p) <= (q - p) * (n + m)
            yield b.select([0, 1]).filter(pa.array(may))

    return run


def _exact(width: int, least: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            ok, known = [], (None, None)
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = x.as_py(), y.as_py()
                if known[0] != y:  # the rows of a class stand together
                    known = (y, shingle_sets([unpack(y).decode()], width)[0])
                x, y = shingle_sets([unpack(x).decode()], width)[0], known[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both * least.denominator >= least.numerator * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, text) with the text compressed: about a quarter of what its shingles' hashes would take."""
    pack = zstandard.ZstdCompressor().compress
    for batch in batches:
        for at, texts in slices(batch, 1):
            yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array([pack(t.encode()) for t in texts], pa.binary())], names=["class", "packed"])


def _asked(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The classes that stand in pairs (a, b), which are cut; the wide columns of all others stay where they are."""
    ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    return classes.join(few(cut(ends)), "class")


def _allowed(pairs: DataFrame, classes: DataFrame, least: Fraction, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose sketches of that name do not rule them out."""
    known = classes.select("class", "n", F.col(name).alias("sketch"))
    for end in ("a", "b"):
        pairs = pairs.join(known.select(F.col("class").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}")), end)
    return pairs.select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(_by_sketch(least, name != "wide"), "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, least: Fraction) -> DataFrame:
    """The pairs (a, b) of classes whose Jaccard similarity is `least` or more."""
    pairs = cut(pairs)
    asked = few(cut(_asked(classes, pairs).select("class", F.col("low").alias("id"))))
    texts = table(docs.join(asked, "id").select("class", "text").mapInArrow(_packed, "class long, packed binary"), "texts")
    both = pairs.join(texts.select(F.col("class").alias("a"), F.col("packed").alias("text_a")), "a").join(texts.select(F.col("class").alias("b"), F.col("packed").alias("text_b")), "b")
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_exact(width, least), "a long, b long"))


def meetings(open_rows: DataFrame, classes: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (a, b) of classes of different components that share a token in rows (token, n, class, at, component) and may
    be similar enough. A pair comes about once, however many tokens it shares."""
    asked = few(cut(first_of_postings(open_rows)))
    before = F.collect_list("token").over(Window.partitionBy("class").orderBy("at").rowsBetween(-BEFORE, -1))
    dealt = open_rows.join(asked, "token").withColumn("before", F.slice(F.concat(before, F.array_repeat(F.lit(0).cast("long"), BEFORE)), 1, BEFORE))
    dealt = dealt.join(classes.select("class", "sketch"), "class").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")).alias("g"), "n", "class", "at", "component", "block", "sketch", "before")
    return dealt.repartition("g").sortWithinPartitions("g", "n").mapInArrow(_pairs(least), "a long, b long")


def components(docs: DataFrame, rows: DataFrame, seeds, width: int = WIDTH, least: Fraction = LEAST) -> DataFrame:
    """(id, component_id) for docs (id, text) with distinct ids and their HASHED rows: the smallest id reachable over pairs
    of Jaccard similarity `least` or more of their sets of `width`-word shingles.

    Equal sets are one class before any comparison; texts without words are one class, and null texts are such.
    seeds(classes) gives pairs (a, b) of classes worth a look first. Of any two sets similar enough, the first shingles
    of each (a fifth of them at 0.8) share one, in whatever order all sets are sorted; with the frequent shingles last,
    few unlike sets meet. Each set is compared with the one before it by size and with a leader of each shared shingle,
    together with the seeds; what these link need not be compared again, so that a large group of near copies makes no
    square of pairs. Every other pair that shares a first shingle follows, at the very first that it shares: of shingles that
    stand in the same classes only the first is asked, and rows that share one of the few before have met there. Bounds
    from sizes, places and sketches drop only pairs that cannot be similar enough, and all others are counted exactly over
    the whole texts.
    """
    classes = cut(rows.groupBy("class").agg(F.min("id").alias("low"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min("folded").alias("folded"), F.min("wide").alias("wide")))
    firsts = rows.where("first is not null").select(F.posexplode("first").alias("at", "token"), "class", "n").select("token", "n", "class", F.col("at").cast("long").alias("at"))
    shared = cut(firsts.repartition("token").sortWithinPartitions("token", "n", "class").mapInArrow(_shared, SHARED))
    near = seeds(classes)
    for other in ("class0", "class1"):
        near = near.unionByName(shared.where(F.col(other).isNotNull()).select(F.least("class", other).alias("a"), F.greatest("class", other).alias("b")))
    # the small sketches rule out most pairs before the large ones travel, and these most of the rest before sets do
    near = cut(_allowed(near.distinct(), classes, least, "folded"))
    release(docs.sparkSession)
    links = _verified(_allowed(near, _asked(classes, near), least, "wide"), classes, docs, width, least)
    release(docs.sparkSession)
    linked = few(cut(connected_components(links).select(F.col("id").alias("class"), "component")))
    open_rows = shared.select("token", "n", "class", "at").join(linked, "class", "left").withColumn("component", F.coalesce("component", "class"))
    rest = cut(meetings(open_rows, classes, least).distinct())
    release(docs.sparkSession)
    rest = cut(_allowed(rest, _asked(classes, rest), least, "wide"))
    links = links.unionByName(_verified(rest, classes, docs, width, least))
    linked = connected_components(links).select(F.col("id").alias("class"), "component")
    named = cut(classes.select("class", "low").join(linked, "class", "left").withColumn("component", F.coalesce("component", "class")))
    # cut, so that the joins read plain exchanges and the rows of a hot component or class can be split
    lows = cut(named.groupBy("component").agg(F.min("low").alias("component_id")))
    of = cut(named.join(lows, "component").select("class", "component_id"))
    return rows.select("id", "class").join(of, "class").select("id", "component_id")
