"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of a binary trie."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import cut, few, slices, table
from .components import connected_components, local_roots

BITS = 64
ALL = (1 << BITS) - 1
#: Distinct fingerprints that one task takes for one bucket; larger buckets are split.
MOST = 1000
LEVELS = 3
#: Rows of buckets that a task takes about.
TASK_ROWS = 20_000


def fingerprints_of(texts: list[str], width: int = 3, chunk: int = 1 << 16) -> np.ndarray:
    """The fingerprint of each text as uint64.

    Words are maximal runs without ASCII white space after lower-casing A-Z; a shingle is `width` words joined by one
    space, repeats included, the whole sequence if it is shorter; a text without words gets zero. A bit is set if it is
    set in over half of the XXH64 (seed 42) of the shingles.
    """

    def hashes() -> Iterator[np.ndarray]:
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").lower().split()
            if not words:
                yield np.empty(0, np.uint64)
            elif len(words) < width:
                yield np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
            else:
                shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
                yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(words) - width + 1)

    return majorities(hashes(), chunk)


def majorities(hashes: Iterable[np.ndarray], chunk: int = 1 << 16) -> np.ndarray:
    """For each array of hashes the value whose bits are those set in over half of them; zero for an empty one."""
    out: list[int] = []
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not owners:
            return
        sizes = np.array([len(h) for h in held])
        bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0, dtype=np.int32)
        for i, v in zip(owners, np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0].tolist(), strict=True):
            out[i] = v
        held.clear()
        owners.clear()
        size = 0

    for h in hashes:
        out.append(0)
        if len(h) > chunk:  # a very long text is summed by parts
            ones = np.zeros(BITS, np.int64)
            for k in range(0, len(h), chunk):
                ones += np.unpackbits(np.ascontiguousarray(h[k : k + chunk]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[-1] = int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])
        elif len(h):
            held.append(h)
            owners.append(len(out) - 1)
            size += len(h)
            if size >= chunk:
                flush()
    flush()
    return np.array(out, np.uint64)


def trie_pairs(values: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of the sorted distinct uint64 values that differ in at most `budget` bits.

    The values are the leaves of a binary trie whose nodes are ranges of the sorted array. Node pairs go down together,
    one varying bit at a time; a pair that has taken more differing bits than the budget is dropped with all below it.
    Pairs of small nodes are settled at once by the popcount of the XOR.
    """
    n = len(values)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    varying = int(np.bitwise_or.reduce(values ^ values[0]))
    al, ah = np.array([0]), np.array([n])
    bl, bh = al.copy(), ah.copy()
    err = np.array([0])
    for bit in range(BITS - 1, -1, -1):
        if not varying >> bit & 1 or not len(al):
            continue
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit) & np.uint64(1)).astype(np.int64))))
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        own = (al == bl) & (ah == bh)
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), (am[~own], ah[~own], bl[~own], bm[~own], err[~own] + 1)]
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        alive = (err <= budget) & (ah > al) & (bh > bl) & ~((al == bl) & (ah == bh) & (ah - al == 1))
        al, ah, bl, bh, err = (x[alive] for x in (al, ah, bl, bh, err))
        small = ((ah - al) * (bh - bl) <= 8) & (al != bl)
        if small.any():
            width = (bh - bl)[small]
            count = (ah - al)[small] * width
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            i = np.repeat(al[small], count) + k // np.repeat(width, count)
            j = np.repeat(bl[small], count) + k % np.repeat(width, count)
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            found.append((i[near], j[near]))
            al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
    if len(al):
        found.append((al, bl))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def _fingerprint_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch, 1):
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(fingerprints_of(texts, width).view(np.int64))], names=["id", "fp"])

    return run


def _bucket_edges(budget: int):
    def edges(fps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values = np.unique(np.concatenate(fps).view(np.uint64))
        i, j = trie_pairs(values, budget)
        root = local_roots(len(values), i, j)
        inner = np.flatnonzero(root != np.arange(len(values)))
        return values[inner].view(np.int64), values[root[inner]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (g, fp) come sorted by g; the links of one g are a spanning forest of its near pairs."""
        last, held = None, []
        for batch in batches:
            g, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(g):
                continue
            starts = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]))
            outs = []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if last is not None and g[s] != last:
                    outs.append(edges(held))
                    held = []
                last = g[s]
                held.append(fp[s:e])
            if outs:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*outs, strict=True)], names=["a", "b"])
        if held:
            a, b = edges(held)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(fixed: int, n: int) -> list[int]:
    """Masks of n near-equal runs of the bits that `fixed` leaves free."""
    free = [b for b in range(BITS) if not fixed >> b & 1]
    cuts = [len(free) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in free[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def near_edges(fps: DataFrame, budget: int = 3, most: int = MOST, levels: int = LEVELS) -> DataFrame:
    """Edges (a, b) among the distinct longs of column fp whose components are those of all pairs within `budget` bits.

    Two values within the budget agree on one of budget + 1 runs of bits, so each value goes to that many subtrees of
    the trie. A subtree with more than `most` values is split again by runs of its free bits, `levels` times at most,
    and what is larger still goes to tasks by pairs of blocks. Nothing is left out at any size.
    """
    n = budget + 1
    fixed = {0: 0}  # by path: the bits on which the subtree agrees
    todo = fps.select("fp", F.lit(0).alias("path"))
    jobs = []
    for level in range(levels):
        masks = {p * n + k: fixed[p] | part for p in fixed for k, part in enumerate(_parts(fixed[p], n))}
        table = F.array(*[F.lit(_signed(masks[k])) for k in range(len(masks))])
        keyed = todo.select("fp", F.explode(F.array(*[(F.col("path") * n + k) for k in range(n)])).alias("path"))
        keyed = keyed.select("fp", "path", F.xxhash64(F.lit(level), "path", F.col("fp").bitwiseAND(F.element_at(table, F.col("path") + 1))).alias("g"))
        sizes = keyed.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
        keyed = cut(keyed.join(sizes, "g").select("fp", "path", "g", "n"))
        jobs.append(keyed.where(F.col("n") <= most).select("g", "fp"))
        todo = keyed.where(F.col("n") > most)
        fixed = masks
        if todo.isEmpty():
            break
    else:
        blocks = todo.withColumn("blocks", F.ceil(F.col("n") / F.lit(most // 2 or 1)).cast("int"))
        blocks = blocks.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        jobs.append(blocks.select(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "fp"))
    work = jobs[0]
    for job in jobs[1:]:
        work = work.unionByName(job)
    # by rows, not bytes: a row is 16 bytes but stands for many node pairs
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() * n // TASK_ROWS))
    return work.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_bucket_edges(budget), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id) per row: near-duplicate classes by SimHash.

    Texts are whole; a null or empty text has no words and the fingerprint zero, which links like any other. Equal
    fingerprints are one class before any join, so a group of copies of any size is one row of the search. component_id
    is the smallest id reachable over links of at most `budget` differing bits. A null id keeps its row and takes its
    class's component, null only if no member has an id; repeated rows are kept; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprint_batches(width), "id long, fp long"))
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("low")))
    linked = connected_components(near_edges(classes.select("fp"), budget)).withColumnRenamed("id", "fp")
    named = classes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # cut, so that the join reads two plain exchanges and a hot component's rows can be split
    lows = cut(named.groupBy("component").agg(F.min("low").alias("component_id")))
    of = named.select("fp", "component").join(lows, "component").select("fp", "component_id")
    return rows.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = jaccard.WIDTH, least: Fraction = jaccard.LEAST, budget: int = 3) -> DataFrame:
    """(id, component_id) per row of docs with distinct ids: classes of Jaccard similarity `least` or more.

    SimHash fingerprints of the sets of `width`-word shingles meet in the trie self-join; its pairs are linked only if
    their exact similarity reaches `least`. No budget that a 64-bit trie can be searched with finds all such pairs (at
    0.8 they differ in ten bits on average), so an exact prefix-filter join over the same shingles adds the links that
    the fingerprints miss, between texts that are not linked yet. A null or empty text has no words; all such are one
    class. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    frequent = jaccard.frequent_shingles(docs, docs.count(), width)
    rows = table(docs.mapInArrow(jaccard.hashed(width, frequent, least, majorities), jaccard.HASHED), "hashed")

    def trie(classes: DataFrame) -> DataFrame:
        """Pairs of classes with near fingerprints, through one class of each fingerprint."""
        first = cut(classes.groupBy("fp").agg(F.min("class").alias("first")))
        same = classes.join(first, "fp").where("class <> first").select(F.col("first").alias("a"), F.col("class").alias("b"))
        near = near_edges(first.select("fp"), budget)
        near = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        both = same.unionByName(near)
        return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    return jaccard.components(docs, rows, trie, width, least)


def _kept(docs: DataFrame, id_col: str, text_col: str, components) -> DataFrame:
    """The rows of docs that represent their component; components(docs, id_col, text_col) gives (id, component_id)."""
    seen = docs.agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("ids")).first()
    if seen["n"] == seen["ids"]:
        found = components(docs.select(id_col, text_col), id_col, text_col)
        gone = cut(found.where("id <> component_id").select(F.col("id").alias(id_col)))
        return docs.join(few(gone), id_col, "left_anti").select(docs.columns)
    numbered = table(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
    found = components(numbered.select("number", F.col("row")[text_col].alias("text")), "number", "text")
    gone = cut(found.where("id <> component_id").select(F.col("id").alias("number")))
    return numbered.join(few(gone), "number", "left_anti").select("row.*")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3) -> DataFrame:
    """The rows of docs that represent their class of simhash_components, with all their columns: those with the smallest id.

    Where ids are null or repeated, row numbers take their place, so that one row of each class stays in any case. Null
    and empty texts are as in simhash_components; an empty table stays empty.
    """

    def found(df: DataFrame, own_id: str, own_text: str) -> DataFrame:
        return simhash_components(df, own_id, own_text, width, budget).select(F.col(own_id).alias("id"), "component_id")

    return _kept(docs, id_col, text_col, found)


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = jaccard.WIDTH, least: Fraction = jaccard.LEAST, budget: int = 3) -> DataFrame:
    """The same with the components of similar_components: near copies by exact similarity, found by SimHash first."""
    return _kept(docs, id_col, text_col, lambda df, own_id, own_text: similar_components(df, own_id, own_text, width, least, budget))
