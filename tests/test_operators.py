"""Hand-computed cases of the operators that the driver tables do not cover."""

import json
import tarfile

import numpy as np
import pytest
from corpuslens.operators import agreement, claims, embed, pairing, requests, resample, study, support, survey
from corpuslens.sources import io
from corpuslens.streaming import ingest
from pyspark.sql import functions as F


def pairs(spark, a, b, w=None):
    return spark.createDataFrame([(x, y, float(z)) for x, y, z in zip(a, b, w or [1] * len(a), strict=True)], "a string, b string, w double")


def test_kappa_and_ac1(spark):
    m = agreement.confusion(pairs(spark, ["yes", "yes", "no", "no"], ["yes", "no", "no", "no"]))
    r = agreement.nominal(m, categories=2).first()
    assert (r.exact, r.kappa) == (0.75, 0.5) and np.isclose(r.ac1, 9 / 17)


def test_weights_and_their_scale(spark):
    for scale in (1.0, 1e-300, 1e300):
        p = pairs(spark, ["yes", "yes", "no"], ["yes", "no", "no"], [1 * scale, 3 * scale, 2 * scale])
        assert np.isclose(agreement.nominal(agreement.confusion(p, weight="w"), categories=2).first().exact, 0.5)


def test_undefined_agreement_is_null(spark):
    assert agreement.nominal(agreement.confusion(pairs(spark, [], [])), categories=2).count() == 0
    r = agreement.nominal(agreement.confusion(pairs(spark, ["yes"] * 3, ["yes"] * 3)), categories=2).first()
    assert r.exact == 1 and r.kappa is None and r.ac1 == 1
    assert agreement.nominal(agreement.confusion(pairs(spark, ["yes"], ["yes"])), categories=1).first().ac1 is None
    assert agreement.nominal(agreement.confusion(pairs(spark, ["yes", "no"], ["yes", "no"], [0, 0]), weight="w"), categories=2).first().exact is None


def test_binary_counts_abstentions_and_refuses_unknown(spark):
    r = agreement.binary(pairs(spark, ["yes", "yes", "no", "uncertain", "no", "uncertain", "yes"], ["yes", "no", "no", "yes", "uncertain", "uncertain", "yes"])).first()
    assert (r.pairs, r.decided, r.abstained_a, r.abstained_b, r.abstained_both) == (7, 4, 2, 2, 1)
    assert r.exact == 0.75 and np.isclose(r.positive_agreement, 4 / 5) and np.isclose(r.negative_agreement, 2 / 3)
    with pytest.raises(Exception, match="unknown label"):
        agreement.binary(pairs(spark, ["maybe"], ["yes"])).collect()


def test_consensus(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "u"), (4, "a"), (4, None)], "i int, label string")
    got = {r.i: r.consensus for r in agreement.consensus(df, ["i"], abstentions=("u",)).collect()}
    assert got == {1: "a", 2: None, 3: None, 4: None}


def test_rater_pairs_refuse_repeats(spark):
    df = spark.createDataFrame([(1, "r2", "x"), (1, "r1", "y"), (1, "r3", "x")], "item_id int, rater string, label string")
    assert sorted((r.rater_a, r.rater_b, r.a, r.b) for r in agreement.rater_pairs(df).collect()) == [("r1", "r2", "y", "x"), ("r1", "r3", "y", "x"), ("r2", "r3", "x", "x")]
    with pytest.raises(Exception, match="repeated rating"):
        agreement.rater_pairs(df.unionByName(df)).collect()
    mean = agreement.pairwise_kappa(agreement.rater_pairs(df), 2).where("rater_a is null").first()
    assert mean.total == 3 and np.isclose(mean.exact, 1 / 3)


def test_macro_needs_all_cells(spark):
    rows = spark.createDataFrame([("a", "yes"), ("a", "no"), ("b", "yes")], "c string, label string")
    assert agreement.equal_cell_macro(rows, rows, ["c"]).first().macro == 0.75
    assert agreement.equal_cell_macro(rows, spark.createDataFrame([("a",), ("z",)], "c string"), ["c"]).first().macro is None


def test_weighted_median_and_suppression(spark):
    df = spark.createDataFrame([("g", 1, 1.0), ("g", 2, 1.0), ("g", 5, 2.0)], "g string, v int, w double")
    assert agreement.weighted_median(df, ["g"], "v", "w").first().median == 2
    m = spark.createDataFrame([("f", "a", 5), ("f", "b", 2), ("h", "c", 3)], "field string, value string, n int")
    assert {(r.field, r.value): r.n for r in agreement.suppress_small(m).collect()} == {("f", "a"): None, ("f", "b"): None, ("h", "c"): 3}


def test_bucket_divergence_equals_dense(spark, sf_dir):
    from corpuslens.plans import queries as q

    frame = q.by_lang(spark, sf_dir)
    h, p = support.histogram(frame, 2, 64, buckets=4096), support.histogram(q.prompts(spark, sf_dir), 2, buckets=4096)
    got = {r.surface: r for r in support.compare(h, p, buckets=4096).collect()}
    dense = lambda rows: np.bincount([r.key for r in rows], [r.cnt for r in rows], 4096)
    smooth = lambda c: (c + 1e-12) / (c + 1e-12).sum()
    b = dense(p.collect())
    kl = lambda x, y: float((x * np.log(x / y)).sum())
    for s, r in got.items():
        a = dense(h.where(F.col("surface") == s).collect())
        x, y = smooth(a), smooth(b)
        m = (x + y) / 2
        assert np.allclose([r.jsd, r.kl_caption_to_prompt, r.kl_prompt_to_caption], [0.5 * kl(x, m) + 0.5 * kl(y, m), kl(x, y), kl(y, x)])
        assert np.allclose([r.caption_mass_on_prompt, r.prompt_mass_on_caption], [x[b > 0].sum(), y[a > 0].sum()])


def test_pools_are_disjoint(spark, sf_dir):
    from corpuslens.plans import queries as q

    rows = support.pools(q.by_lang(spark, sf_dir), "c", 1, 3, 0.25).collect()
    assert len({r.id for r in rows}) == len(rows) and {r.pool for r in rows} == {0, 1, 2}


def test_zero_token_captions(spark):
    frame = survey.captions(spark.createDataFrame([(1, "..."), (2, None), (3, "a b a b a b")], "doc_id int, text string"))
    r = survey.repetition(frame, 4).first()
    assert (r.captions, r.eligible, r.repeated) == (1, 1, 1)
    assert survey.lengths(frame).first().captions == 3
    assert survey.duplicates(frame).first().captions == 1


def test_ties_go_to_the_first(spark):
    frame = survey.captions(spark.createDataFrame([(2, "x y"), (1, "y x")], "doc_id int, text string"))
    assert [r.item for r in survey.top_items(survey.gram_counts(frame, 1), 1).collect()] == ["y"]


def test_pairing_rules(spark):
    rows = spark.createDataFrame([(1, "k", " "), (2, "k", "first"), (3, "k", "second"), (4, None, "x"), (5, "j", None)], "pos int, key string, cap string")
    kept, counts = pairing.keyed(rows, F.col("key"), F.col("cap"), "pos")
    assert [tuple(r) for r in kept.select("key", "caption").collect()] == [("k", "first")]
    assert counts.first().asDict() == {"scanned": 5, "missing_key": 1, "missing_caption": 2, "accepted": 1, "duplicate_key": 1}
    log = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False), ("b", 2, False), (None, 3, True)], "id string, pos int, ok boolean")
    assert sorted((r.id, r.pos) for r in pairing.latest_answered(log, "id", "pos", F.col("ok")).collect()) == [("a", 1), ("b", 2)]


def test_four_way(spark):
    f = lambda rows, s: spark.createDataFrame(rows, s)
    a, b = f([(k,) for k in range(10)], "key int"), f([(k,) for k in range(2, 12)], "key int")
    c = f([(k, f"u{k}") for k in range(12)], "key int, url string")
    m = f([("u3", "s"), ("u4", "s"), ("u4", "t"), ("u5", "z")], "url string, stable_id string")
    assert sorted(r.key for r in pairing.four_way(a, b, c, c, m, 100, 1).collect()) == [3, 5]
    assert pairing.four_way(a, b, c, c, m, 2, 1).count() <= 2


def test_claim_rules(spark):
    rows = [("c", [("object", "The Red Cat", "a dog"), ("object", "red cat", "dog"), ("object", "the", None), ("text_rendering", "no text here", ""), ("bad", "x", "")])]
    df = spark.createDataFrame(rows, "caption_id string, claims array<struct<category:string,unit:string,target:string>>")
    e = claims.explode_claims(df)
    assert claims.deduplicated(e, ["caption_id"]).first().asDict() == {"caption_id": "c", "claimed": 4, "deduped": 1, "duplicates": 1, "suspicious": 1}
    assert claims.deduplicated(e, ["caption_id"], drop_absent_text=False).first().deduped == 2
    assert claims.builder_dedup(e, ["caption_id"]).count() == 4


def test_answers_of_unknown_questions(spark):
    df = spark.createDataFrame([("r", [("q1", "count")], [("q1", "yes"), ("q2", "no"), ("q1", "maybe")])], "request_id string, questions array<struct<question_id:string,category:string>>, results array<struct<question_id:string,answer:string>>")
    assert sorted((r.category, r.answer) for r in claims.answers(df).collect()) == [("__unknown__", "no"), ("count", "yes")]


def test_bootstraps(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("g", float(x), 2.0) for x in rng.normal(5, 1, 400)], "g string, x double, y double")
    r = resample.bootstrap(df, "g", ["x"], resample.mean_statistic, reps=400).first()
    assert r.low < 5.1 and r.high > 4.9 and np.isclose(r.sd, 0.05, atol=0.015)
    assert resample.bootstrap(df, "g", ["x"], resample.mean_statistic, reps=400).first() == r
    bad = spark.createDataFrame([("c", "s1", 1.0), ("c", "s2", 1.0)], "c string, s string, x double")
    with pytest.raises(ValueError, match="two strata"):
        resample.cluster_bootstrap(bad, "c", ["x"], lambda s: s[0], "s", 10)


def test_samples(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "i int, s string")
    got = resample.stratified(df, ["s"], 20, 1, "i").collect()
    assert sorted({(r.s, r.weight) for r in got}) == [("a", 4.5), ("b", 1.0)] and len(got) == 30
    assert resample.shortfalls(df, spark.createDataFrame([("a",), ("b",), ("z",)], "s string"), ["s"], 20).count() == 2
    assert resample.modulo_split(df, 3, 1, "i").count() == 33
    crew = spark.createDataFrame([(f"p{k}",) for k in range(5)], "participant string")
    a = resample.assign(df.withColumnRenamed("i", "item"), crew, 2, 7).groupBy("item").agg(F.count_distinct("participant").alias("n"))
    assert {r.n for r in a.collect()} == {2}


def test_repeat_spacing(spark):
    tasks = [("p", str(i), None) for i in range(40)] + [("p", "r3", "3"), ("p", "r9", "9")]
    got = {r.item: r.position for r in resample.spaced_order(spark.createDataFrame(tasks, "participant string, item string, repeat_of string"), ["participant"], 1).collect()}
    assert sorted(got.values()) == list(range(42))
    for rep, of in (("r3", "3"), ("r9", "9")):
        assert got[rep] - got[of] >= 10 or got[rep] >= 40


def test_embedding_metrics(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r], "g") for i, r in enumerate(x)], "id long, vec array<double>, label string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    k = u @ u.T
    p = np.maximum(np.linalg.eigvalsh(k / 60), 0)
    p = p[p > 1e-12] / p.sum()
    r = embed.vendi(df, "label").first()
    assert np.isclose(r.vendi, np.exp(-(p * np.log(p)).sum())) and np.isclose(r.top_share, p.max())
    g = embed.geometry(df, "label").first()
    assert np.isclose(g.pairwise_cosine, (k.sum() - 60) / (60 * 59)) and np.isclose(g.trace, np.trace(np.cov(u.T, bias=True)))
    radius = {r.id: r.radius for r in embed.kth_self_cosine(df, 3).collect()}
    np.fill_diagonal(k, -2)
    assert np.allclose([radius[i] for i in range(60)], np.sort(k, 1)[:, -3])
    assert embed.score_summary(embed.nearest_cosine(df, df)).first().n == 60


def test_requests(spark):
    caps = spark.createDataFrame([(1, "a b c d")], "id long, text string")
    req = requests.extraction_requests(caps, 2, "s")
    assert req.first().caption == "a b" and len(req.first().request_id) == 32
    log = requests.send(req, lambda row: json.dumps({"caption_id": row["caption_id"], "claimed_units": [{"category": "object", "unit": "cat", "span": "", "target": ""}]}))
    parsed = requests.parse(log, requests.CLAIMS_SCHEMA)
    assert parsed.select(F.size(requests.claim_problems(F.col("parsed")))).first()[0] == 0
    assert requests.resume(req, log).count() == 0

    def fail(row):
        raise TimeoutError

    bad = requests.send(req, fail)
    assert bad.first().status == "TimeoutError" and requests.resume(req, bad).count() == 1 and requests.resume(req, bad, only_ok=False).count() == 0
    df = spark.createDataFrame([(["a", "b"], ["b", "a"]), (["a"], ["a", "a"]), (["a"], ["b"]), (["a"], None)], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(requests.ids_match(F.col("x"), F.col("y"))).collect()] == [True, False, False, False]


def test_study(spark):
    a = spark.createDataFrame([(1, "p", "caption", "x", 1), (1, "q", "caption", "y", 1), (2, "p", "caption", "x", 1)], "item_id int, participant string, phase string, image_support string, revision int")
    done = spark.createDataFrame([], "item_id int, phase string")
    assert [r.item_id for r in study.adjudication_candidates(a, done, 2, ["image_support"]).collect()] == [1]
    pub = study.public_rows(a.withColumn("secret", F.lit(1)), b"key")
    assert "secret" not in pub.columns and pub.first().participant != "p"
    events = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "assignment_id int, revision int, v string")
    assert study.latest_annotation(events).first().v == "b"
    gates = spark.createDataFrame([("n", 5.0, 3.0), ("k", None, 0.5), ("w", 0.1, 0.2)], "gate string, value double, least double")
    assert study.readiness(gates).first().asDict() == {"ready": False, "reasons": ["k", "w"]}
    prof = spark.createDataFrame([("p", ["x", "x", "y"], "en"), ("q", ["x"], None)], "participant string, tools array<string>, lang string")
    assert {(r.field, r.value, r.n) for r in study.profile_marginals(prof, ["tools", "lang"]).collect()} == {("tools", "x", 2), ("tools", "y", 1), ("lang", "en", 1)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":1,"caption":" "}\n\n{"id":2,"caption":"x","text":"t"}\n')
    spark.createDataFrame([(3, "p")], "id long, caption string").write.parquet(str(tmp_path / "b.parquet"))
    paths = io.expand(spark, [f"{tmp_path}/*.jsonl", f"{tmp_path}/b.*", f"{tmp_path}/a.jsonl"])
    assert len(paths) == 2
    df = io.read_records(spark, paths)
    assert {(r.id, r._caption, r.used_field) for r in io.load_captions(df).collect()} == {(2, "x", "caption"), (3, "p", "caption")}
    with pytest.raises(ValueError, match="unknown format"):
        io.format_of("x.bin")
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        io.read_records(spark, [str(tmp_path / "bad.jsonl")], "id long").collect()
    io.write_tsv(df, str(tmp_path / "t"), ["id", "missing"])
    with pytest.raises(Exception, match="(?i)exist"):
        io.write_tsv(df, str(tmp_path / "t"), ["id"])
    assert io.markdown(df.orderBy("id").select("id"), ["id"]).splitlines()[2] == "| 1 |"
    assert r"\begin{tabular}" in io.latex(df, ["id"])
    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        tar.add(tmp_path / "a.jsonl", "m.json")
    got = io.tar_members(spark.createDataFrame([(str(tmp_path / "s.tar"),)], "path string"), {"m.json", "none"}).collect()
    assert [(r.member, r.size) for r in got] == [("m.json", (tmp_path / "a.jsonl").stat().st_size)]


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = "id string, t timestamp, v int"
    (src / "1.json").write_text('{"id":"a","t":"2024-01-01T00:00:00","v":1}\n{"id":"a","t":"2024-01-01T00:00:01","v":2}\n')
    run = lambda: ingest.upsert_latest(ingest.tail(spark, str(src), schema), ["id"], ["t", "v"], out, str(tmp_path / "cp"))
    q = run()
    q.awaitTermination()
    (src / "2.json").write_text('{"id":"b","t":"2024-01-01T00:00:02","v":3}\n{"id":"a","t":"2023-01-01T00:00:00","v":9}\n')
    q = run()
    q.awaitTermination()
    assert {(r.id, r.v) for r in ingest.current(spark, out, q, schema).collect()} == {("a", 2), ("b", 3)}
    w = ingest.windowed_counts(ingest.tail(spark, str(src), schema), "t", ["id"], "1 hour", "1 minute")
    q = w.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 4
    q = ingest.append_once(ingest.tail(spark, str(src), schema), "id", "t", "1 day", str(tmp_path / "once"), str(tmp_path / "cp2"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).count() == 2


def test_discover_on_wide_rows(spark):
    """Indices are those of the sorted keys, with no gap, whatever columns a job reads."""
    from corpuslens.sources import io
    from pyspark.sql import functions as F

    n = 200_000
    df = spark.range(n).select((F.xxhash64("id")).alias("k"), F.repeat(F.lit("wide "), 60).alias("text"), F.col("id").cast("string").alias("s"))
    got = io.discover(df, "k").agg(F.count("global_index"), F.count_distinct("global_index"), F.min("global_index"), F.max("global_index")).first()
    assert tuple(got) == (n, n, 0, n - 1)


def test_scans_in_many_blocks(spark, monkeypatch):
    """Neighbours, support and retrieval do not depend on how queries and gallery are cut."""
    import numpy as np
    from corpuslens.operators import embed

    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 5))
    x[7] = x[90]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>").repartition(3)
    u = embed.unit_rows(x)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    for block, part in ((8192, 1 << 18), (40, 25)):
        monkeypatch.setattr(embed, "QUERY_BLOCK", block)
        monkeypatch.setattr(embed, "GALLERY_PART", part)
        got = {}
        for r in embed.neighbours(df, df, 3, skip_self=True).collect():
            got.setdefault(r.q_id, {})[r["rank"]] = (r.g_id, r.sim)
        for q in range(150):
            assert np.allclose([got[q][k][1] for k in (1, 2, 3)], np.sort(s[q])[::-1][:3])
        ranks = {(r.id, r.direction): r for r in embed.retrieval(df, df).collect()}
        assert len(ranks) == 300 and all(np.isclose(r.positive, 1) for r in ranks.values())


def test_a_scan_holds_few_scores_at_a_time(spark, monkeypatch):
    """However many gallery rows a batch has, a product has at most STEP of them; ties by copies go to the smaller id and a
    row's k-th neighbour stands within its radius in whatever blocks both are met."""
    import tracemalloc

    import numpy as np
    import pandas as pd
    from corpuslens.operators import embed

    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    x[100:200] = x[50]
    u = embed.unit_rows(x)
    peak = []

    def meet(start):
        df = spark.createDataFrame([(1, [1.0], 0.0)], "id long, vec array<double>, x double")
        monkeypatch.setattr(type(df), "mapInPandas", lambda self, run, schema: run)
        run = embed._meet(df, df, start, "")
        frames = [pd.DataFrame({"g": 0, "kind": kind, "id": np.arange(3000), "vec": list(x), "x": radius * kind}) for kind in (0, 1)]
        tracemalloc.start()
        out = pd.concat(run(iter(frames)))
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        return out

    radius = 0.0
    near = meet(embed._Nearest(4, True))
    assert peak[0] < 3000 * 3000 * 8
    s = np.array([(u * row).sum(1) for row in u])
    np.fill_diagonal(s, -np.inf)
    want = np.argsort(-s, axis=1, kind="stable")[:, :4]
    assert (near["g_id"].to_numpy().reshape(-1, 4) == want).all()
    radius = near["sim"].to_numpy().reshape(-1, 4)[:, 3]
    assert (meet(embed._Support(True))["hits"].to_numpy() == (s >= radius[None]).sum(1)).all()
    assert peak[1] < 3000 * 3000 * 8


def test_pareto_over_many_tasks(spark):
    import numpy as np
    from corpuslens.operators import claims

    rng = np.random.default_rng(1)
    pts = [(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 60, (400, 2)))]
    got = {r.k: r.frontier for r in claims.pareto(spark.createDataFrame(pts, "k long, up long, down long").repartition(5), "k", "up", "down").collect()}
    want = {k: not any(c >= a and d <= b and (c > a or d < b) for _, c, d in pts) for k, a, b in pts}
    assert got == want
    assert claims.pareto(spark.createDataFrame([], "k long, up long, down long"), "k", "up", "down").count() == 0


def test_shortfalls_are_errors_and_repeats_weigh_nothing(spark):
    import pytest
    from corpuslens.operators import resample

    df = spark.createDataFrame([(f"i{k}", "a" if k < 30 else "b") for k in range(34)], "item string, s string")
    declared = spark.createDataFrame([("a",), ("b",), ("c",)], "s string")
    with pytest.raises(ValueError, match="fewer than 5"):
        resample.stratified(df, ["s"], 5, 1, "item", declared)
    s = resample.stratified(df, ["s"], 3, 1, "item", declared.where("s <> 'c'"))
    rows = resample.with_repeats(s.select("item", "s", "weight"), 0.5, 1, "item", ["s"]).collect()
    assert len(rows) == 6 + 4 and sum(r.weight for r in rows) == pytest.approx(34)
    assert all((r.repeat_of is None) == (r.weight > 0) and (r.repeat_of is None or r.item == f"{r.repeat_of}:repeat") for r in rows)


def test_field_agreement_of_a_hand_made_study(spark):
    from corpuslens.operators import agreement

    rows = [("i1", "g1", "caption", "a", "yes", None), ("i1", "g1", "caption", "b", "yes", None), ("i1", "g1", "caption", "c", "no", None), ("i2", "g2", "caption", "a", "no", None), ("i2", "g2", "caption", "b", "no", None), ("i2", "g2", "caption", "c", None, None), ("i3", "g2", "caption", "a", "yes", "i1"), ("i3", "g2", "caption", "b", "no", "i1"), ("i4", "g3", "image", "a", "no", None)]
    df = spark.createDataFrame(rows, "item_id string, item_group string, phase string, participant string, label string, repeat_of string")
    r = agreement.field_agreement(df, "label", "caption", reps=300).first()
    assert (r["items"], r.pairs, r.clusters, r.exact) == (2, 4, 2, 0.5) and r.low <= 0.5 <= r.high
    none = agreement.field_agreement(df, "label", "image").first()
    assert (none["items"], none.pairs, none.exact, none.low) == (0, 0, None, None)
    metrics = {(x.field, x.phase, x.metric): x.value for x in agreement.export_metrics(df, {"label": "caption"}, reps=50).collect()}
    assert metrics["label", "caption", "exact"] == 0.5 and metrics["sample", "all", "annotations"] == 9 and metrics["sample", "caption", "repeats"] == 1
