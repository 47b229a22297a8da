"""URL filters: rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, table

#: (verdict, host/path)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Different labelled URLs that the trees are fitted on at most, and buckets of the suffix statistics.
TRAIN_ROWS, BUCKETS = 20_000, 1024
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "query_length", "fragment", "hyphens", "longest_segment", "upper_ratio", "top_suffix", "two_suffix")
TOKEN = re.compile(r"[^/?#&=.]+")


def host_of(url: Column) -> Column:
    """What stands behind the first :// up to /, ? or #, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule or null: its host or a subdomain, and a path that starts with its own."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        out = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}"), F.lit(rule)).otherwise(out)
    return out


def suffixes(host: str) -> tuple[int, int]:
    """Buckets of the last label and of the last two."""
    labels = host.rsplit(".", 2)
    return crc32(labels[-1].encode("utf-8", "surrogatepass")) % BUCKETS, crc32(".".join(labels[-2:]).encode("utf-8", "surrogatepass")) % BUCKETS


def features(url: str, host: str, path: str, rate: np.ndarray) -> list[float]:
    """FEATURES of one URL; rate has the share of blocked labelled URLs by suffix kind and bucket."""
    n = len(url)
    digits = sum(c.isdigit() for c in url)
    entropy = -sum(c / n * log2(c / n) for c in Counter(url).values()) if n else 0.0
    front, _, fragment = url.partition("#")
    query = front.partition("?")[2]
    top, two = suffixes(host)
    return [n, len(host), len(path), path.count("/"), host.count(".") + bool(host), digits / max(1, n), entropy, sum(bool(x) for x in query.split("&")), len(query), float(bool(fragment)), url.count("-") + url.count("_"), max((len(x) for x in TOKEN.findall(path)), default=0), sum(c.isupper() for c in url) / max(1, n), rate[0, top], rate[1, two]]


@dataclass
class Trees:
    """Boosted regression trees for the log odds of label 1; a tree is arrays of (feature, threshold, value) in heap order."""

    base: float = -4.0
    rate: np.ndarray = field(default_factory=lambda: np.full((2, BUCKETS), 0.5))
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 3

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
            out += value[node]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rate: np.ndarray, weight: np.ndarray | None = None, trees: int = 40, depth: int = 3, shrink: float = 0.2, bins: int = 32, least: float = 5.0) -> Trees:
    """Second-order boosting of the weighted log loss over quantile bins. Weights are how often a row stands in the table.
    Without rows of both classes the score is constant."""
    model = Trees(rate=rate, depth=depth)
    if len(set(y.tolist())) < 2:
        model.base = 4.0 if len(y) and y[0] else -4.0
        return model
    w = np.ones(len(y)) if weight is None else weight.astype(float)
    mean = float(np.average(y, weights=w))
    model.base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    logit = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
        size = 2 ** (depth + 1) - 1
        feature, threshold, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for at in range(2**depth - 1):
            own = np.flatnonzero(node == at)
            if len(own):
                total_g, total_h = g[own].sum(), h[own].sum()
                top = 1e-9
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    left_g = np.cumsum(np.bincount(code[own, f], g[own], len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(code[own, f], h[own], len(e) + 1))[:-1]
                    ok = (left_h >= 1e-3) & (total_h - left_h >= 1e-3)
                    gain = np.where(ok, left_g**2 / (left_h + least) + (total_g - left_g) ** 2 / (total_h - left_h + least) - total_g**2 / (total_h + least), 0)
                    if gain.max() > top:
                        top, feature[at], threshold[at] = gain.max(), f, e[gain.argmax()]
                node[own] = 2 * at + 1 + (x[own, feature[at]] > threshold[at])
        for at in range(2**depth - 1, size):
            own = node == at
            value[at] = -shrink * g[own].sum() / (h[own].sum() + least)
        model.trees.append((feature, threshold, value))
        logit += value[node]
    return model


def _judged(pages: DataFrame, id_col: str, url_col: str, rules) -> DataFrame:
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))


def _blocked(rules) -> Column:
    return F.col("rule").isin([r for v, r in rules if v == "block"])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, bucket, blocked, n): what a task has counted, at most 2 * BUCKETS rows."""
    count = np.zeros((2, BUCKETS, 2), np.int64)
    for batch in batches:
        for host, blocked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for kind, bucket in enumerate(suffixes(host)):
                count[kind, bucket] += (blocked, 1)
    kind, bucket = np.nonzero(count[:, :, 1])
    yield pa.record_batch([pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(count[kind, bucket, 0]), pa.array(count[kind, bucket, 1])], names=["kind", "bucket", "blocked", "n"])


def train(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", most: int = TRAIN_ROWS) -> Trees:
    """The labelled URLs are those that a rule decides. Suffix statistics count all of them, by bucket; the trees are
    fitted on at most `most` different ones, those with the smallest hashes, each weighted by its number of rows, so
    that a URL that stands in very many rows is one row of the sample. Null URLs have no rule; an empty table, or one
    without URLs of both verdicts, gives a constant score."""
    known = _judged(pages, id_col, url_col, rules).where("rule is not null").withColumn("blocked", _blocked(rules).cast("int"))
    counts = known.select("host", "blocked").mapInArrow(_statistics, "kind int, bucket int, blocked long, n long").groupBy("kind", "bucket").agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n")).collect()
    rate = np.full((2, BUCKETS), 0.5)
    for r in counts:
        rate[r["kind"], r["bucket"]] = (r["blocked"] + 1) / (r["n"] + 2)
    some = hash_sample(table(known.groupBy("url", "host", "path", "blocked").agg(F.count("*").alias("n")), "labelled-urls"), most, "url").collect()
    x = np.array([features(r["url"], r["host"], r["path"], rate) for r in some], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["blocked"] for r in some], float), rate, np.array([r["n"] for r in some], float))


def _verdicts(model: Trees, blocks: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            url, host, path, rule = (batch.column(k).to_pylist() for k in range(1, 5))
            open_ones = [k for k, r in enumerate(rule) if r is None]
            score = np.full(len(rule), np.nan)
            if open_ones:
                score[open_ones] = model.scores(np.array([features(url[k] or "", host[k], path[k], model.rate) for k in open_ones], float))
            verdict = [("block" if r in blocks else "allow") if r is not None else ("block" if s >= 0.5 else "allow") for r, s in zip(rule, score.tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), *(batch.column(k) for k in (2, 3, 4)), pa.array(verdict), pa.array(score, pa.float64(), from_pandas=True)], names=["id", "host", "path", "rule", "verdict", "score"])

    return run


def judge_urls(pages: DataFrame, model: Trees, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row (id_col, host, path, rule, verdict, score): the longest fitting rule's verdict, else the trees'.

    score is the trees' probability of block, null where a rule decides. A null url, or one without ://, has empty host
    and path and no rule. Null and repeated ids keep their rows; other columns are ignored. No shuffle.
    """
    rows = _judged(pages, id_col, url_col, rules)
    kind = rows.schema["id"].dataType.simpleString()
    blocks = frozenset(r for v, r in rules if v == "block")
    out = rows.mapInArrow(_verdicts(model, blocks), f"id {kind}, host string, path string, rule string, verdict string, score double")
    return out.withColumnRenamed("id", id_col)
