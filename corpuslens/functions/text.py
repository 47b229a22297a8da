"""Column functions over texts: tokens, windows, n-grams, predicates, keys.

Everything is a built-in expression, so that it stays in the JVM and is pushed to the scan side of a plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values ------------------------------------------------------------------------------------------------
TOKEN = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"
DEFAULT_FIELDS = ("recap_caption", "re_caption", "caption", "caption_long_llama32", "caption_llava", "caption_llava_short", "llava_next_caption", "synthetic_caption", "phi3_caption", "parsed", "text", "txt")
LEADING_WORDS = (
    "a", "an", "the", "this", "that", "these", "those", "image", "picture", "photo", "photograph", "illustration", "artwork", "scene", "shows", "showing", "depicts", "depicting",
    "features", "featuring", "presents", "displaying", "displays", "contains", "captures", "we", "can", "see", "in",
)
MORE_LEADING_WORDS = ("is", "are", "of")
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
TEXT_WORDS = ("text", "word", "letter", "sign", "logo", "label", "caption", "title")
LEXICONS = {
    "color": ("black", "white", "red", "blue", "green", "yellow", "orange", "purple", "pink", "brown", "gray", "grey", "cyan", "magenta", "gold", "silver", "monochrome"),
    "material": ("wood", "wooden", "metal", "metallic", "glass", "ceramic", "plastic", "leather", "cotton", "silk", "stone", "marble", "concrete", "paper", "fur", "wool"),
    "lighting": ("lighting", "light", "shadow", "sunlight", "backlit", "neon", "glowing", "dim", "bright", "soft", "harsh", "ambient", "dramatic", "rim", "volumetric"),
    "camera": ("camera", "lens", "shot", "view", "angle", "portrait", "macro", "closeup", "close", "wide", "telephoto", "fisheye", "aerial", "overhead", "bokeh", "depth"),
    "spatial_relation": ("above", "below", "beneath", "under", "over", "behind", "front", "beside", "between", "inside", "outside", "around", "across", "near", "left", "right", "center", "foreground", "background"),
    "style": ("style", "anime", "photorealistic", "realistic", "cinematic", "illustration", "painting", "watercolor", "sketch", "render", "cartoon", "pixel", "vintage", "minimalist", "surreal", "abstract"),
}
PHRASES = ("this is", "overall", "appears to", "likely", "the image", "the scene", "capturing", "detailed", "vibrant", "cinematic", "inviting", "evoking")
URL = r"(?i)https?://|www\."
EMAIL = r"(?i)(?<![\p{L}\p{N}_])[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[a-z]{2,}(?![\p{L}\p{N}_])"
PHONE = r"(?<!\d)(?:\+?\d[\d\s().-]{7,}\d)(?!\d)"
UNSAFE_WORDS = ("nsfw", "nude", "nudity", "naked", "porn", "pornographic", "erotic", "sex", "sexual", "sexy", "fetish", r"child\s*porn", "loli", "shota", "underage", "minor", "rape", "incest", "gore", "gory", "bloodbath", "beheading", "decapitated", "dismembered")
FORMATTING = {
    "newline": r"\n",
    "bullet": r"(?m)^\s*[-*]\s+",
    "numbered_list": r"(?m)^\s*\d+[.)]\s+",
    "url": URL,
    "html_entity": r"&[a-zA-Z]+;|&#\d+;",
    "markdown_fence": r"```",
    "control_char": r"[\x00-\x08\x0B\x0C\x0E-\x1F]",
}
SCRIPTS = {
    "non_ascii": r"[^\x00-\x7F]",
    "cjk": r"[\x{3400}-\x{9fff}]",
    "emoji": r"[\x{1f300}-\x{1f5ff}\x{1f600}-\x{1f64f}\x{1f680}-\x{1f6ff}\x{1f700}-\x{1f77f}\x{1f780}-\x{1f7ff}\x{1f800}-\x{1f8ff}\x{1f900}-\x{1f9ff}\x{1fa00}-\x{1fa6f}\x{1fa70}-\x{1faff}]",
}
#: Register codes: (severity, patterns); all patterns match by line. F counts repeated 5-grams instead.
VIOLATIONS: dict[str, tuple[str, tuple[str, ...]]] = {
    "A_prose_coord_echo": ("critical", (r"\[\s*\d{2,4}\s*,\s*\d{2,4}\s*,\s*\d{2,4}\s*,\s*\d{2,4}\s*\]",)),
    "B_text_coord_echo": ("moderate", (r"TEXT:.*\[\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\]",)),
    "C_bbox_tag": ("moderate", (r"<bbox>", r"</bbox>", r"<ref>", r"</ref>")),
    "D_markdown_leak": ("moderate", (r"\*\*[^*]+\*\*", r"^[-*]\s", r"^#+\s", r"\[([^\]]+)\]\([^\)]+\)")),
    "E_thinking_leak": ("critical", (r"<think>", r"</think>", r"(?i)the user wants", r"(?i)let me ", r"(?i)I need to ", r"(?i)I should ", r"(?i)I will ", r"(?i)I'll describe")),
    "F_repetition": ("severe", ()),
    "G_meta_instruction": ("low", (r"(?i)per (the )?instructions", r"(?i)as (instructed|requested|prompted)", r"(?i)following the (prompt|guidelines)", r"(?i)requirements?:")),
    "H_detection_meta_leak": ("moderate", (r"(?i)bounding box", r"(?i)detection (box|region|area)", r"(?i)confidence\s*[:=]\s*\d", r"(?i)detected at")),
    "I_overlay_meta_leak": ("moderate", (r"(?i)overlay", r"(?i)annotation layer", r"(?i)green rectangle", r"(?i)labeled box")),
    "J_meta_statement": ("moderate", (r"(?i)^the (image|picture|photo|illustration|artwork|scene) (shows?|depicts?|features?|presents?|displays?|contains?|captures?)", r"(?i)^this (image|picture|photo|illustration|artwork|scene) (shows?|depicts?|features?|presents?|displays?|contains?|captures?)", r"(?i)^in this (image|picture|photo|illustration)", r"(?i)^we (can )?see ")),
    "K_qwen_bbox_echo": ("moderate", (r"bbox_2d", r'"type"\s*:\s*"bbox"')),
    "L_tag_verbatim": ("low", (r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_]+_[\p{L}\p{N}_]+_[\p{L}\p{N}_]+(?![\p{L}\p{N}_])",)),
    "M_numbered_list_leak": ("low", (r"^\d+\.\s+[\p{L}\p{N}_]",)),
    "N_stage_header_leak": ("critical", (r"(?i)stage\s*[1-4]", r"(?i)resolution\s*:\s*\d+", r"(?i)caption (type|format|style)\s*:")),
}
ARTICLES = ("a", "an", "the")
CATEGORIES = ("object", "attribute", "relation", "style", "camera", "lighting", "count", "text_rendering")
#: A trailing block that says that there is no text in the picture.
NULL_TEXT = (
    r"(?i)(?:\n\s*){0,2}TEXT:\s*[\[\(<{]?\s*(?:"
    r"<\s*no\s+text\s*>|"
    r"none(?:\s*(?:[.,;:]|\(|visible\b|legible\b|clearly\b|in\b|as\b|beyond\b).*)?|"
    r"no\s+(?:clearly\s+)?(?:(?:readable|legible)\s+)?text(?:\s*(?:[.,;:]|visible\b|appears\b|is\b|beyond\b|as\b|in\b|present\b).*)?|"
    r"n/?a|null"
    r")(?:\s*\n\s*(?:none|n/?a|null)\s*)?\.?\s*[\]\)>}]?\s*$"
)
ABSENT_TEXT = ("no text", "no visible", "not visible", "without text")
# ------------------------------------------------------------------------------------------------------------------


def tokens(text: Column, lower: bool = True) -> Column:
    """Lexical tokens in order; null gives an empty array."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """The number of lexical tokens, counted without casing."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKEN))


def words(text: Column) -> Column:
    """White-space words by Unicode white space, empty ones dropped."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_budget(text: Column, budget: int) -> Column:
    """The first `budget` white-space words joined by one space."""
    return F.array_join(F.slice(words(text), 1, budget), " ")


def lexical_budget(text: Column, budget: int) -> Column:
    """The text up to the end of its `budget`-th token; a text without more tokens stays whole."""
    cut = F.regexp_extract(text, rf"(?s)^((?:.*?{TOKEN}(?!'?[\p{{L}}\p{{N}}])){{{budget}}})", 1)
    return F.when(token_count(text) > budget, cut).otherwise(text)


def ngrams(toks: Column, n: int) -> Column:
    """All n-grams in order, tokens joined by one space."""
    size = F.size(toks)
    if n == 1:
        return toks
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(F.array().cast("array<string>"))


def content(toks: Column, more: bool = False) -> Column:
    """Tokens from the first one that is no leading word; `more` adds three words to the list."""
    leading = LEADING_WORDS + (MORE_LEADING_WORDS if more else ())
    flags = F.transform(toks, lambda t: ~t.isin(*leading))  # a hash lookup: the list is longer than ten
    at = F.array_position(flags, F.lit(True))
    return F.when(at > 0, F.slice(toks, at.cast("int"), F.greatest(F.size(toks), F.lit(1)))).otherwise(F.array().cast("array<string>"))


def prefix(toks: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(toks, 1, n), " ")


def opening(toks: Column, n: int = 3) -> Column:
    """The first n content tokens, or of all tokens where none is left."""
    rest = content(toks)
    return F.when(F.size(rest) > 0, prefix(rest, n)).otherwise(prefix(toks, n))


def hits(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that occur, in the order of the dictionary."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())


def formatting_hits(text: Column) -> Column:
    return hits(text, FORMATTING)


def script_hits(text: Column) -> Column:
    return hits(text, SCRIPTS)


def most_repeated(toks: Column, n: int) -> Column:
    """How often the most frequent n-gram of an array occurs; 0 without n-grams."""
    grams = F.array_sort(ngrams(toks, n))
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["top"], run).alias("top"))

    return F.aggregate(grams, zero, step, lambda a: a["top"])


def let(value: Column, fn) -> Column:
    """fn of a value that is computed once, however often fn uses it, also within lambdas."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def repetition(text: Column, n: int = 5, least: int = 10) -> Column:
    """Whether an n-gram of lower-cased white-space words occurs at least `least` times. Texts with fewer words than
    could hold that are settled by their length."""
    return let(words(F.lower(text)), lambda w: F.when(F.size(w) < n + least - 1, F.lit(False)).otherwise(most_repeated(w, n) >= least))


def violations(text: Column, with_repetition: bool = True) -> Column:
    """Register codes of a text, one each, in order."""
    flags = []
    for code, (_, patterns) in VIOLATIONS.items():
        if code.startswith("F_"):
            if with_repetition:
                flags.append(F.when(repetition(text), F.lit(code)))
            continue
        any_of = F.lit(False)
        for p in patterns:
            any_of = any_of | text.rlike("(?m)" + p)
        flags.append(F.when(any_of, F.lit(code)))
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def residue_codes(text: Column) -> Column:
    """Codes J and I by patterns that match at the start of the whole text only."""
    flags = []
    for code in ("J_meta_statement", "I_overlay_meta_leak"):
        any_of = F.lit(False)
        for p in VIOLATIONS[code][1]:
            any_of = any_of | text.rlike(p)
        flags.append(F.when(any_of, F.lit(code)))
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def severity(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (level, _) in VIOLATIONS.items():
        out = F.when(code == name, F.lit(level)).otherwise(out)
    return out


def lexicon_hits(toks: Column) -> dict[str, Column]:
    """By category the number of tokens in its lexicon; count takes digits and number words."""
    def among(words: tuple[str, ...]) -> Column:
        return F.size(F.filter(toks, lambda t: t.isin(*words)))

    out = {name: among(words) for name, words in LEXICONS.items()}
    out["count"] = F.size(F.filter(toks, lambda t: t.rlike(r"^\p{Nd}+$") | t.isin(*NUMBER_WORDS)))
    out["text_rendering"] = among(TEXT_WORDS)
    return out


def normalize_prompt(text: Column) -> Column:
    """NUL to space, ends trimmed, white space squeezed."""
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\x00"), F.lit(" ")), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def is_safe_prompt(text: Column) -> Column:
    unsafe = r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(UNSAFE_WORDS) + r")(?![\p{L}\p{N}_])"
    return ~(text.rlike(URL) | text.rlike(EMAIL) | text.rlike(PHONE) | text.rlike(unsafe))


def zero_fill(text: Column, width: int) -> Column:
    """Zeros before the digits up to a width; longer strings stay whole and a sign stays first."""
    sign = F.regexp_extract(text, r"^([+-]?)", 1)
    rest = F.substring(text, F.length(sign) + 1, F.length(text))
    return F.when(F.length(text) < width, F.concat(sign, F.lpad(rest, F.lit(width) - F.length(sign), F.lit("0")))).otherwise(text)


def normalize_url(url: Column) -> Column:
    """Scheme and network location lower-cased, fragment dropped; a URL without either is only trimmed."""
    url = F.trim(url)
    scheme = F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://[^/?#]+", 1)
    netloc = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    rest = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^#]*)", 1)
    rest = F.regexp_replace(rest, r"\?$", "")
    return F.when(scheme != "", F.concat(F.lower(scheme), F.lit("://"), F.lower(netloc), rest)).otherwise(url)


def normalize_key(value: Column, mode: str = "str") -> Column:
    """Join key by mode str, zfill9, zfill12 or url; blank gives null."""
    text = F.nullif(F.trim(value.cast("string")), F.lit(""))
    if mode == "str":
        return text
    if mode == "url":
        return normalize_url(text)
    if mode in ("zfill9", "zfill12"):
        return zero_fill(text, int(mode[5:]))
    raise ValueError(f"unknown key mode {mode}")


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cols])


def short_edge_ok(width: Column, height: Column, least: int) -> Column:
    return F.coalesce(F.least(width, height) >= least, F.lit(False)) & width.isNotNull() & height.isNotNull()


def pair_id(*parts: Column) -> Column:
    """SHA-1 of the parts joined by NUL."""
    return F.sha1(F.concat_ws("\x00", *parts))


def question_for(category: Column, unit: Column, target: Column) -> Column:
    unit, target = F.trim(F.coalesce(unit, F.lit(""))), F.trim(F.coalesce(target, F.lit("")))
    return (
        F.when(category == "text_rendering", F.concat(F.lit("Is the rendered text claim '"), unit, F.lit("' visibly supported by the image?")))
        .when(target != "", F.concat(F.lit("Is the visual claim '"), target, F.lit(": "), unit, F.lit("' supported by the image?")))
        .otherwise(F.concat(F.lit("Is the visual claim '"), unit, F.lit("' supported by the image?")))
    )


def exact_span(text: Column, span: Column) -> Column:
    """struct(status, start, end) in code points from 0: exact_unique_text where the span occurs once, overlapping
    occurrences counted; else missing (null or empty), not_found or ambiguous."""
    at = F.instr(text, span)
    again = F.instr(F.substring(text, at + 1, F.length(text)), span)
    status = F.when(F.coalesce(span, F.lit("")) == "", "missing").when(at == 0, "not_found").when(again > 0, "ambiguous").otherwise("exact_unique_text")
    found = status == "exact_unique_text"
    return F.struct(status.alias("status"), F.when(found, at - 1).alias("start"), F.when(found, at - 1 + F.length(span)).alias("end"))


def offsets_ok(text: Column, start: Column, end: Column) -> Column:
    """Whether given offsets lie in the text in order."""
    return F.coalesce((start >= 0) & (start <= end) & (end <= F.length(text)), F.lit(False))


def unit_norm(text: Column) -> Column:
    """Lexical tokens without leading articles, joined by one space."""
    toks = tokens(text)
    listed = F.array(*[F.lit(w) for w in ARTICLES])
    at = F.array_position(F.transform(toks, lambda t: ~F.array_contains(listed, t)), F.lit(True))
    return F.when(at > 0, F.array_join(F.slice(toks, at.cast("int"), F.greatest(F.size(toks), F.lit(1))), " ")).otherwise(F.lit(""))


def shard_of(image_id: Column, shards: int) -> Column:
    """An integer id modulo the shards, any other string by its CRC-32."""
    number = F.when(image_id.rlike(r"^\s*[+-]?\d{1,18}\s*$"), F.trim(image_id)).cast("long")
    return F.pmod(F.coalesce(number, F.crc32(F.encode(image_id, "UTF-8"))), F.lit(shards))


def character_name(tag: Column) -> Column:
    """A tag without its bracketed suffix and with spaces for underscores."""
    return F.trim(F.replace(F.regexp_replace(F.trim(tag), r"_\([^)]+\)$", ""), F.lit("_"), F.lit(" ")))


def confirmed_characters(general: Column, characters: Column, require_solo: bool = True) -> Column:
    """Display names of character tags in order, the first of those equal without case; none unless tagged solo."""
    names = F.filter(F.transform(F.filter(characters, lambda t: t.isNotNull()), character_name), lambda n: n != "")
    lower = F.transform(names, F.lower)
    first = F.filter(F.transform(names, lambda n, i: F.when(F.array_position(lower, F.lower(n)) == i + 1, n)), lambda n: n.isNotNull())
    none = F.array().cast("array<string>")
    if not require_solo:
        return F.coalesce(first, none)
    solo = F.coalesce(F.exists(general, lambda t: F.lower(F.trim(t)) == "solo"), F.lit(False))
    return F.when(solo, F.coalesce(first, none)).otherwise(none)


def grounding_context(lines: dict[str, Column], most: int = 6000) -> Column:
    """Labelled lines of the fields that have a value (arrays joined by a comma and a space, underscores as spaces). Over
    `most` characters the line of general tags goes last and is cut at a comma."""
    rendered = {}
    for label, col in lines.items():
        rendered[label] = F.when(F.coalesce(col, F.lit("")) != "", F.concat(F.lit(f"- {label}: "), col))
    head = F.lit("\n\nGrounding context:\n")
    full = F.concat(head, F.concat_ws("\n", *rendered.values()))
    general = rendered.get("general tags")
    none = F.coalesce(*[r for r in rendered.values()]).isNull()
    if general is None:
        return F.when(none, "").otherwise(full)
    base = F.concat(head, F.concat_ws("\n", *[r for k, r in rendered.items() if k != "general tags"]))
    room = F.lit(most) - F.length(base) - 20
    line = F.substring(general, 3, F.length(general))
    cut = F.when(F.length(line) > room, F.regexp_replace(F.substring(line, F.lit(1), room), r"(?s),[^,]*$", "")).otherwise(line)
    short = F.when(general.isNotNull() & (room > 40), F.concat(base, F.lit("\n- "), cut)).otherwise(base)
    return F.when(none, "").when(F.length(full) > most, short).otherwise(full)


def strip_null_text(caption: Column) -> Column:
    """The caption without a trailing block that says there is no text."""
    return F.regexp_replace(F.regexp_replace(caption, NULL_TEXT, ""), r"(?U)\s+$", "")


def image_key(sha256: Column, *urls: Column) -> Column:
    """sha256:<hex> of a content hash, else url_sha256:<hex> of the first URL that is filled, normalised; else an error."""
    url = F.coalesce(*[F.nullif(normalize_url(u), F.lit("")) for u in urls])
    return (
        F.when(sha256.rlike("^[0-9a-fA-F]{64}$"), F.concat(F.lit("sha256:"), F.lower(sha256)))
        .when(url.isNotNull(), F.concat(F.lit("url_sha256:"), F.sha2(url, 256)))
        .otherwise(F.raise_error(F.lit("no content hash or URL identity")))
    )


def shard_path(path: Column) -> Column:
    """struct(shard, key, suffix) of names like shard__key.ext with an image suffix; nulls otherwise."""
    pattern = r"(?i)(?:^|/)([^_/]+)__+([^/]+?)(\.(?:jpg|jpeg|png|webp))$"
    part = lambda k: F.nullif(F.regexp_extract(path, pattern, k), F.lit(""))
    return F.struct(part(1).alias("shard"), part(2).alias("key"), F.lower(part(3)).alias("suffix"))


def bucket(gram: Column, buckets: int = 1 << 18) -> Column:
    """CRC-32 of the UTF-8 bytes modulo the buckets."""
    return F.pmod(F.crc32(F.encode(gram, "UTF-8")), F.lit(buckets))
