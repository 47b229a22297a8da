"""Column functions against plain Python and hand-made cases."""

import re

import pytest
from corpuslens.functions import hashing
from corpuslens.functions import text as X
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
TEXTS = ["", "o'clock_x isn't ''quoted''", "日本語 text 😀 1st", "The image shows a red cat, a RED dog", "one two three four five six seven", "a_b_c and blue_hair_ribbon", "x" * 50 + " y", None, "  spaced   out\n\tlines  "]


def values(spark, column, texts=TEXTS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_tokens(spark):
    assert values(spark, X.tokens(F.col("t"))) == [TOKEN.findall((t or "").lower()) for t in TEXTS]
    assert values(spark, X.token_count(F.col("t"))) == [len(TOKEN.findall(t or "")) for t in TEXTS]
    assert values(spark, X.words(F.col("t"))) == [(t or "").split() for t in TEXTS]


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_ngrams(spark, n):
    def grams(t):
        k = TOKEN.findall((t or "").lower())
        return [" ".join(k[i : i + n]) for i in range(len(k) - n + 1)]

    assert values(spark, X.ngrams(X.tokens(F.col("t")), n)) == [grams(t) for t in TEXTS]


@pytest.mark.parametrize("b", [1, 3, 5])
def test_budgets(spark, b):
    def cut(t):
        m = list(TOKEN.finditer(t))
        return t if len(m) <= b else t[: m[b - 1].end()]

    some = [t for t in TEXTS if t]
    assert values(spark, X.lexical_budget(F.col("t"), b), some) == [cut(t) for t in some]
    assert values(spark, X.word_budget(F.col("t"), b)) == [" ".join((t or "").split()[:b]) for t in TEXTS]


def test_content_and_openings(spark):
    t = ["the image shows a red cat sitting", "this image", "red cat", ""]
    toks = X.tokens(F.col("t"))
    assert values(spark, X.prefix(X.content(toks), 5), t) == ["red cat sitting", "", "red cat", ""]
    assert values(spark, X.opening(toks), t) == ["red cat sitting", "this image", "red cat", ""]


def test_violations(spark):
    t = {
        "at [10, 20, 30, 40] here": ["A_prose_coord_echo"], "TEXT: x [1, 2, 3, 4]": ["B_text_coord_echo"], "<bbox>": ["C_bbox_tag"], "fine\n# head": ["D_markdown_leak"], "Let me see": ["E_thinking_leak"],
        "a b c d e " * 10: ["F_repetition"], "Requirements: x": ["G_meta_instruction"], "a bounding box": ["H_detection_meta_leak"], "an overlay": ["I_overlay_meta_leak"], "x\nThe image shows y": ["J_meta_statement"],
        "bbox_2d": ["K_qwen_bbox_echo"], "bläu_här_x": ["L_tag_verbatim"], "x\n1. Item": ["M_numbered_list_leak"], "stage 2": ["N_stage_header_leak"], "clean words": [], "a b c d e " * 9: [],
    }
    assert values(spark, X.violations(F.col("t")), list(t)) == list(t.values())
    assert values(spark, X.residue_codes(F.col("t")), ["x\nThe image shows y", "The image shows y"]) == [[], ["J_meta_statement"]]


def test_formatting_and_scripts(spark):
    assert values(spark, X.formatting_hits(F.col("t")), ["a\n- b", "1) x", "WWW.x", "&amp;", "```", "\x01", "plain"]) == [["newline", "bullet"], ["numbered_list"], ["url"], ["html_entity"], ["markdown_fence"], ["control_char"], []]
    assert values(spark, X.script_hits(F.col("t")), ["é", "漢", "😀", "a"]) == [["non_ascii"], ["non_ascii", "cjk"], ["non_ascii", "emoji"], []]


def test_keys(spark):
    t = [" 42 ", "1234567890", "-7", "  ", None]
    assert values(spark, X.normalize_key(F.col("t"), "zfill9"), t) == ["000000042", "1234567890", "-00000007", None, None]
    u = ["HTTP://User@Example.COM:80/Path?Q=1#frag", "no url", "https://a.b"]
    assert values(spark, X.normalize_key(F.col("t"), "url"), u) == ["http://user@example.com:80/Path?Q=1", "no url", "https://a.b"]
    assert values(spark, X.shard_of(F.col("t"), 7), ["15", "abc", "-3"]) == [1, __import__("zlib").crc32(b"abc") % 7, -3 % 7]


def test_prompts(spark):
    assert values(spark, X.normalize_prompt(F.col("t")), [" a\x00 b\n\nc ", " x"]) == ["a b c", "x"]
    bad = ["see www.x.y", "mail a.b@c.de now", "call +49 123 456 789", "a nude x"]
    assert values(spark, X.is_safe_prompt(F.col("t")), [*bad, "nudge 12 34", "fine"]) == [False] * 4 + [True] * 2


def test_spans(spark):
    df = spark.createDataFrame([("aaa b", "aa"), ("aaa b", "b"), ("aaa", ""), ("aaa", None), ("aaa", "x")], "t string, s string")
    got = [tuple(r.v) for r in df.select(X.exact_span(F.col("t"), F.col("s")).alias("v")).collect()]
    assert got == [("ambiguous", None, None), ("exact_unique_text", 4, 5), ("missing", None, None), ("missing", None, None), ("not_found", None, None)]


def test_captions_and_tags(spark):
    assert values(spark, X.strip_null_text(F.col("t")), ["A cat.\n\nTEXT: None", "A cat.\nTEXT: no visible", "TEXT: hello", "x TEXT: n/a."]) == ["A cat.", "A cat.\nTEXT: no visible", "TEXT: hello", "x"]
    df = spark.createDataFrame([(["Solo", "x"], ["gawr_gura_(1st)", "Gawr_Gura", "b_c", None]), (["x"], ["a"])], "g array<string>, c array<string>")
    assert [r.v for r in df.select(X.confirmed_characters(F.col("g"), F.col("c")).alias("v")).collect()] == [["gawr gura", "b c"], []]
    one = spark.createDataFrame([("a, b" * 3000, "r"), (None, None)], "g string, r string")
    got = [r.v for r in one.select(X.grounding_context({"general tags": F.col("g"), "rating": F.col("r")}).alias("v")).collect()]
    assert len(got[0]) <= 6000 and got[0].startswith("\n\nGrounding context:\n- rating: r\n- general tags: a, b") and got[1] == ""


def test_paths_and_image_keys(spark):
    got = values(spark, X.shard_path(F.col("t")), ["dir/00012__000345.JPG", "x.jpg", "a__b.txt"])
    assert [tuple(g) for g in got] == [("00012", "000345", ".jpg"), (None,) * 3, (None,) * 3]
    df = spark.createDataFrame([("A" * 64, None), (None, "HTTP://X/y#z")], "s string, u string")
    keys = [r.v for r in df.select(X.image_key(F.col("s"), F.col("u")).alias("v")).collect()]
    assert keys[0] == "sha256:" + "a" * 64 and keys[1].startswith("url_sha256:")
    with pytest.raises(Exception, match="no content hash"):
        spark.createDataFrame([(None, None)], "s string, u string").select(X.image_key(F.col("s"), F.col("u"))).collect()


def test_hashes(spark):
    import hashlib

    assert values(spark, hashing.blake2b(F.col("t")), ["red car", None]) == ["caa80506cfa91525", None]
    assert values(spark, X.bucket(F.col("t"), 1000), ["é x"]) == [__import__("zlib").crc32("é x".encode()) % 1000]
    assert values(spark, hashing.strict_json(F.col("t")), ['{"b":1,"a":2}', '{"a":1,"a":2}', '{"a":NaN}', "[1]", "x", None]) == ['{"a":2,"b":1}', None, None, None, None, None]
    assert 0 <= values(spark, hashing.unit_hash(F.col("t")), ["x"])[0] < 1
    assert values(spark, hashing.keyed_pseudonym(F.col("t"), b"k"), ["p"]) == [hashlib.blake2b(b"p", digest_size=16, key=b"k").hexdigest()]


def test_lexicon(spark):
    hits = X.lexicon_hits(X.tokens(F.col("t")))
    assert values(spark, hits["color"], ["red Red blue", ""]) == [3, 0]
    assert values(spark, hits["count"], ["two 3 cats ٣ x2"]) == [3]
    assert values(spark, hits["text_rendering"], ["a logo with text"]) == [2]
