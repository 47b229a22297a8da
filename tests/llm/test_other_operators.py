"""URL filters, vectors, archives and the pipeline against brute force and planted cases."""

import base64
import gzip
import hashlib
import math
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from corpuslens.llm import embed_dedup, topk, urls, warc
from corpuslens.llm.common import hash_sample
from corpuslens.llm.components import connected_components


# ---- urls
URLS = [
    (1, "http://A.COM"), (2, None), (3, "x"), (4, "HTTPS://www.Example.com/en/x?y#z"), (5, "a://b.example.com/en/"), (6, "a://net/es/1"), (7, "a://xnet/es/1"), (8, "a://q.net/fr/?u"), (9, "a://com/\n/?x"),
    (None, "://?://a.com/"), (4, "HTTPS://www.Example.com/en/x?y#z"), (10, ""), (11, "http://a.com/" + "x" * 50_000),
]


def brute_url(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for _, rule in urls.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x", 0.1) for i, u in URLS], "page_id long, url string, host string, score double")
    model = urls.train(df)
    rows = urls.judge_urls(df, model).collect()
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in rows) == sorted((str(i), *map(str, brute_url(u))) for i, u in URLS)
    verdicts = {v: k for k, v in urls.RULES}
    assert all(r.verdict in ("allow", "block") and (r.rule is None or r.verdict == verdicts[r.rule]) for r in rows)
    assert urls.judge_urls(df.limit(0), urls.train(df.limit(0))).count() == 0


def test_hot_urls_leave_both_classes(spark):
    """Far more rows than the sample takes, over few URLs: none is lost, and both verdicts are learned."""
    for shift in range(3):
        df = spark.range(3000).selectExpr("id as page_id", f"case when id % 2 = 0 then 'http://a{shift}.com/' else 'http://b.net/es/{shift}' end as url")
        model = urls.train(df, most=200)
        assert model.trees and abs(model.base) < 0.01
        rows = {r.url: r for r in df.limit(2).join(urls.judge_urls(df, model, rules=()), "page_id").collect()}
        assert [rows[u].verdict for u in sorted(rows)] == ["allow", "block"]
    known = urls.train(spark.createDataFrame([(1, "http://a.com/")] * 900 + [(2, f"http://x{k}.net/fr/") for k in range(300)], "page_id long, url string"), most=100)
    assert len(known.trees) == 40


def test_samples_of_repeated_rows(spark):
    df = spark.range(10_000).selectExpr("id % 3 as x")
    assert all(hash_sample(df.selectExpr(f"x + {10 * k} as x"), 50, "x").count() == 50 for k in range(6))
    assert hash_sample(spark.range(10_000), 50, "id").count() == 50 and hash_sample(df.limit(0), 5, "x").count() == 0


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, len(urls.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = urls.fit(x[:1500], y[:1500], np.full((2, urls.BUCKETS), 0.5))
    assert np.mean((model.scores(x[1500:]) >= 0.5) == y[1500:]) > 0.95


# ---- vectors
def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, uid string").repartition(3)


def vectors(n=300, d=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 6, d))
    rows = []
    for i in range(n):
        v = base[i % len(base)] + rng.normal(size=d) * (0.02 if i % 3 else 1.0)
        rows.append((i, [float(np.float32(x)) for x in v * (1 + i % 4)]))
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, None), (n + 3, [0.0] * d), (n + 4, [float("nan")] * d), (n + 5, [None] * d), (n + 6, []), (n + 7, [1.0, 2.0]), (n + 8, [2.0, 4.0]), (5, rows[5][1])]
    return rows


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_embedding_components(spark):
    rows = vectors()
    got = embed_dedup.near_duplicates(frame(spark, rows)).collect()
    n = len(rows)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            va, vb = rows[a][1], rows[b][1]
            if a != b and sound(va) and sound(vb) and len(va) == len(vb):
                link[a, b] = np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb) >= 0.95
    root = np.arange(n)
    for _ in range(n):
        new = np.array([min([root[k], *root[link[k]]]) for k in range(n)])
        if (new == root).all():
            break
        root = new
    low = {r: min(rows[k][0] for k in range(n) if root[k] == r) for r in set(root)}
    want = sorted((rows[k][0], int(link[k].sum()), low[root[k]], rows[k][0] == low[root[k]]) for k in range(n))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want
    assert embed_dedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_blocks_of_a_hot_cell(spark, monkeypatch):
    """A cell of many blocks counts every link once."""
    monkeypatch.setattr(embed_dedup, "BLOCK_BYTES", 16 * 8 * 8)
    monkeypatch.setattr(embed_dedup, "TILE", 5)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.ones(8) + rng.normal(size=8) * 0.01]) for i in range(150)]
    got = embed_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r.n_links for r in got} == {149} and {r.component_id for r in got} == {0}


def test_every_cell_that_could_hold_a_neighbour(spark, monkeypatch):
    """With hundreds of cells: no pair is lost without a limit of visits, and nine in ten are found with three."""
    monkeypatch.setattr(embed_dedup, "PER_CELL", 4)
    rng = np.random.default_rng(6)
    x = embed_dedup.unit(rng.normal(size=(600, 24)))
    x = np.concatenate((x, embed_dedup.unit(x + rng.normal(size=x.shape) * 0.31 / 24**0.5)))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    n = (embed_dedup.unit(x) @ embed_dedup.unit(x).T >= 0.95).sum(1) - 1
    assert embed_dedup.Cells(x, 300).leaves.shape[0] > 250
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(frame(spark, rows, "double"), visits=None).collect()}
    assert [got[i] for i in range(len(x))] == n.tolist() and n.sum() > 600
    some = embed_dedup.near_duplicates(frame(spark, rows, "double")).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * n.sum() <= some <= n.sum()


def brute_top(rows, every, k=10):
    """Rankings by whole numbers of any size, kept within the long range."""
    ok = [(n, i, [math.floor(1024 * x) for x in v]) for n, (i, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, q, x in ok:
        if q is not None and q % every == 0:
            scored = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x, y, strict=True)))), i) for m, i, y in ok if m != n and len(y) == len(x)]
            scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def got_top(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("room", [65_536, 7])
def test_top_products(spark, monkeypatch, room):
    monkeypatch.setattr(topk, "QUERIES", room)
    monkeypatch.setattr(topk, "SEEDS", 60)
    rows = vectors(420, 24, 3)
    df = frame(spark, rows)
    assert got_top(topk.top_products(df, every=20)) == brute_top(rows, 20)
    assert topk.top_products(df.limit(0)).count() == 0
    assert topk.top_products(df.where("vec_id = 1")).count() == 0


def test_ties_nulls_and_large_components(spark):
    """Components of any finite size count, repeated rows are candidates, and rows without an id come last in ties."""
    rng = np.random.default_rng(1)
    rows = [(0, [1.0, 0.0]), (3, [1.0, 5.0]), (1, [1.0, 9.0]), (2, [1.0, -3.0]), (2, [1.0, -3.0]), (None, [1.0, 9.0]), (None, [9.0, 9.0]), (4, [1e12, 0.0]), (5, [300000.0, 1.0]), (100, [1e300, -1e300]), (200, [-(2.0**40), 2.0**40]), (200, [-(2.0**40), 2.0**40]), (6, [5e-324, 1.5])]
    rows += [(int(i), [float(x) for x in rng.normal(size=2) * 10.0 ** rng.integers(-3, 15)]) for i in range(7, 140)]
    assert got_top(topk.top_products(frame(spark, rows, "double"))) == brute_top(rows, 100)
    got = topk.top_products(frame(spark, [(0, [1.0, 1.0]), (1, [300000.0, 1.0]), (2, [2.0, 2.0]), (2, [2.0, 2.0]), (3, [1.0, 0.0])], "double"))
    assert [r.vec_id for r in sorted(got.collect(), key=lambda r: r.rank)] == [1, 2, 2, 3]


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for power in (5, 25, 30, 45, 70):
        a, b = (np.floor(rng.normal(size=(6, 5)) * 2.0**p) for p in (power, power - 3))
        a[0] = np.floor(rng.normal(size=5) * 10)
        want = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(v) * int(w) for v, w in zip(x, y, strict=True)))) for y in b] for x in a]
        assert topk.products(a, b).tolist() == want


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_component_of_very_many_vertices(spark):
    """A chain and a star whose hub has the largest id, 100,000 vertices in all."""
    chain = spark.range(50_000).selectExpr("id as a", "id + 1 as b")
    star = spark.range(60_000, 110_000).selectExpr("id as a", "200000L as b")
    edges = chain.union(star).union(spark.createDataFrame([(50_000, 60_000)], "a long, b long")).repartition(8, "b")
    got = connected_components(edges).agg({"id": "count", "component": "max"}).first()
    assert (got["count(id)"], got["max(component)"]) == (100_002, 0)


# ---- archives
PAGES = [(1, "http://a b", "x" * 2000), (2, None, "x" * 2000), (None, "u\n", "x" * 2000), (3, "q", None), (4, "é%", "y" * 2000), (4, "é%", "y" * 2000), (5, "s", "é"), (6, "s", "é"), (None, "z", "w" * 1500), (7, "big", "日" * 300_000), (8, "e", "x" * 999), (9, "e", "x" * 999)]


def test_archive_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, payload int").repartition(3)
    path = warc.write_archive(df, str(tmp_path / "warc"))
    rows = warc.read_archive(spark, path).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    got = sorted(((r.id, r.uri, r.record_type, r.refers_to, r.payload_bytes, None if r.payload is None else bytes(r.payload).decode()) for r in rows), key=key)
    want = []
    for i, u, h in PAGES:
        revisit = i in (1, None) and h == "x" * 2000
        want.append((i, u, "revisit" if revisit else "response", 2 if revisit else None, len((h or "").encode()), None if revisit else h or ""))
    assert got == sorted(want, key=key)
    some = warc.read_archive(spark, path, "none").where("record_type = 'revisit' and id = 1")
    assert some.count() == 1 and "= revisit" not in some._jdf.queryExecution().executedPlan().toString()
    assert warc.read_archive(spark, warc.write_archive(df.limit(0))).count() == 0


def foreign(kind, body, *more, name="urn:uuid:1", http=None):
    block = body if http is None else b"HTTP/1.0 200 OK\r\n" + b"".join(h + b"\r\n" for h in http) + b"\r\n" + body
    lines = [b"WARC/1.0", b"warc-type: " + kind, f"WARC-Record-ID: <{name}>".encode(), b"Content-length: %d" % len(block), *more]
    if http is not None:
        lines.append(b"Content-Type: application/http; msgtype=response")
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_archives_of_others(spark, tmp_path, zipped):
    """warcinfo and request records, headers in any case, folded lines, codings, gzip members, several files."""
    page = b"<p>text</p>" * 30_000
    records = [
        foreign(b"warcinfo", b"software: x\r\n"),
        foreign(b"request", b"", b"WARC-Target-URI: http://a/%20", name="urn:uuid:2", http=[b"Host: a"]),
        foreign(b"response", page, b"WARC-Target-URI: http://a/%20", b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(page).digest()), name="urn:uuid:3", http=[b"X: a", b" b"]),
        foreign(b"response", gzip.compress(page), name="urn:uuid:4", http=[b"content-ENCODING: gzip"]),
        foreign(b"response", b"3;x\r\nabc\r\n2\r\nde\r\n0\r\n\r\n", name="urn:uuid:5", http=[b"Transfer-Encoding: chunked"]),
        foreign(b"revisit", b"", b"WARC-Refers-To: <urn:uuid:3>", b"WARC-Payload-Digest: md5:xyz", name="urn:uuid:6", http=[]),
        foreign(b"resource", b"plain", name="urn:uuid:7"),
    ]
    pack = gzip.compress if zipped else bytes
    (tmp_path / f"a.warc{'.gz' * zipped}").write_bytes(b"".join(map(pack, records[:4])))
    (tmp_path / f"b.warc{'.gz' * zipped}").write_bytes(b"".join(map(pack, records[4:])))
    (tmp_path / "c.txt").write_bytes(b"no archive")
    rows = {r.record_id[9:]: r for r in warc.read_archive(spark, str(tmp_path)).collect()}
    assert [rows[k].record_type for k in "1234567"] == ["warcinfo", "request", "response", "response", "response", "revisit", "resource"]
    assert [None if rows[k].payload is None else bytes(rows[k].payload) for k in "34567"] == [page, page, b"abcde", None, b"plain"]
    assert rows["3"].payload_digest == hashlib.sha1(page).hexdigest() and rows["6"].payload_digest == "md5:xyz" and rows["6"].refers_to_id == "urn:uuid:3"
    assert rows["3"].uri == "http://a/%20" and rows["3"].id is None
    some = warc.read_archive(spark, str(tmp_path), "none").where("record_type = 'response'").collect()
    assert sorted((r.record_id[9:], r.payload_bytes) for r in some) == [("3", len(page)), ("4", None), ("5", None)]


def test_a_payload_on_half_the_pages(spark):
    df = spark.range(4000).selectExpr("id as page_id", "'u' as url", "case when id % 2 = 0 then repeat('x', 1500) else repeat(cast(id as string), 500) end as html")
    rows = warc.read_archive(spark, warc.write_archive(df), "verify").groupBy("record_type").count().collect()
    assert {r.record_type: r["count"] for r in rows} == {"revisit": 1999, "response": 2001}


def test_damaged_payload_is_found(spark, tmp_path):
    path = warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), str(tmp_path / "w"))
    name = next((tmp_path / "w").glob("*.warc"))
    name.write_bytes(name.read_bytes().replace(b"X-Payload-Length: 4", b"X-Payload-Length: 5"))
    with pytest.raises(Exception, match="differs from its headers"):
        warc.read_archive(spark, path).collect()


# ---- pipeline
def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from corpuslens.llm import simhash
    from corpuslens.llm.common import clean, read, table

    docs = read(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = table(stage(spark, docs, sf_dir), name)
        if name != "packing":
            assert docs.columns == columns
            ids, old = {r.doc_id for r in docs.collect()}, {r.doc_id for r in before.collect()}
            assert ids <= old and ids
        if name == "near_duplicates":
            assert ids == {r.component_id for r in simhash.similar_components(before).collect()}
        if name == "secrets":
            assert ids == old and docs.where("text rlike 'AKIA[A-Z0-9]{12}|[0-9a-f]{32}'").count() == 0
    assert docs.agg({"length": "sum"}).first()[0] == docs.dropDuplicates(["doc_id"]).agg({"doc_tokens": "sum"}).first()[0]
    files = docs.inputFiles()
    clean(spark)
    assert files and not any(Path(urlparse(f).path).exists() for f in files)
