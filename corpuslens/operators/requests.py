"""Requests to models and their responses. Calls are behind a client; logs are rows that are checked, merged and resumed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import text as X

CLAIMS_SCHEMA = "caption_id string, claimed_units array<struct<category:string,unit:string,span:string,target:string>>"
ANSWERS_SCHEMA = "question_results array<struct<question_id:string,answer:string,confidence:double,evidence:string>>"


def extraction_requests(captions: DataFrame, budget: int, surface: str, lexical: bool = False) -> DataFrame:
    """(request_id, caption_id, surface, source_row, token_budget, caption): the caption's window, by white-space words or
    lexical tokens, under an id of stage, budget, surface, row and caption."""
    window = X.lexical_budget(F.col("text"), budget) if lexical else X.word_budget(F.col("text"), budget)
    ident = F.concat_ws(":", F.lit("claims"), F.lit(budget), F.lit(surface), F.col("id").cast("string"), F.col("id").cast("string"))
    return captions.select(hashing.blake2b(ident, 16).alias("request_id"), F.col("id").cast("string").alias("caption_id"), F.lit(surface).alias("surface"), F.col("id").alias("source_row"), F.lit(budget).alias("token_budget"), window.alias("caption"))


def question_list(claims: DataFrame) -> DataFrame:
    """(caption_id, questions): a question for each claim in order, with ids caption:u0000; captions without claims are left out."""
    ident = lambda c, i: F.concat(F.col("caption_id").cast("string"), F.lit(":u"), F.lpad(i.cast("string"), 4, "0"))
    asked = F.transform("claims", lambda c, i: F.struct(ident(c, i).alias("question_id"), c["category"].alias("category"), X.question_for(c["category"], c["unit"], c["target"]).alias("question")))
    return claims.where(F.size("claims") > 0).select("caption_id", asked.alias("questions"))


def parse(responses: DataFrame, schema: str, column: str = "response_text") -> DataFrame:
    """With parsed, null where the text is no JSON of the schema."""
    return responses.withColumn("parsed", F.from_json(column, schema, {"mode": "PERMISSIVE"}))


def ids_match(asked: Column, answered: Column) -> Column:
    """Whether the answered ids are the asked ones, each as often as asked, and none repeated."""
    return F.coalesce((F.sort_array(asked) == F.sort_array(answered)) & (F.size(F.array_distinct(answered)) == F.size(answered)), F.lit(False))


def claim_problems(parsed: Column) -> Column:
    """Names of the structural rules that parsed claims break."""
    units = parsed["claimed_units"]
    rules = {
        "no_units": units.isNull(),
        "category": F.exists(units, lambda u: ~F.coalesce(u["category"].isin(*X.CATEGORIES), F.lit(False))),
        "unit": F.exists(units, lambda u: ~F.coalesce(F.length(F.trim(u["unit"])).between(1, 80), F.lit(False))),
        "span": F.exists(units, lambda u: F.length(F.coalesce(u["span"], F.lit(""))) > 120),
        "target": F.exists(units, lambda u: F.length(F.coalesce(u["target"], F.lit(""))) > 80),
    }
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())


def resume(requests: DataFrame, log: DataFrame, only_ok: bool = True) -> DataFrame:
    """Requests that the log has not answered; with only_ok failed ones are asked again."""
    seen = log.where("request_id is not null" + (" and ok" if only_ok else "")).select("request_id")
    return requests.join(seen, "request_id", "left_anti")


def send(requests: DataFrame, client: Callable[[dict], str]) -> DataFrame:
    """(request_id, ok, status, response_text): the client is called for each row within its partition; an error becomes a row."""
    columns = requests.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                try:
                    out.append((row["request_id"], True, "ok", client({c: row[c] for c in columns})))
                except Exception as e:  # an error of one call is a row of the log
                    out.append((row["request_id"], False, type(e).__name__, None))
            yield pd.DataFrame(out, columns=["request_id", "ok", "status", "response_text"])

    return requests.mapInPandas(run, "request_id string, ok boolean, status string, response_text string")


def extraction_status(rows: DataFrame) -> DataFrame:
    """By surface: valid, invalid, cut off at the token cap, and valid without claims."""
    valid = F.col("ok") & F.col("parsed.claimed_units").isNotNull()
    return rows.groupBy("surface").agg(F.count("*").alias("responses"), F.count_if(valid).alias("valid"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"), F.count_if(F.col("finish") == "length").alias("truncated"), F.count_if(valid & (F.size("parsed.claimed_units") == 0)).alias("valid_zero_claims"))


def same_prefix(first: DataFrame, second: DataFrame, columns: list[str]) -> bool:
    """Whether every row of the first stands in the second as often."""
    return first.select(*columns).exceptAll(second.select(*columns)).isEmpty()


def verify_requests(claims: DataFrame, images: DataFrame) -> DataFrame:
    """(caption_id, image_url, image_path, units): claims of a caption with ids caption:u0000, and where its image is; captions
    without claims or image are left out."""
    ident = lambda i: F.concat(F.col("caption_id").cast("string"), F.lit(":u"), F.lpad(i.cast("string"), 4, "0"))
    units = F.transform("claims", lambda c, i: F.struct(ident(i).alias("unit_id"), c["category"].alias("category"), F.trim(c["unit"]).alias("unit"), c["target"].alias("target")))
    j = claims.where(F.size("claims") > 0).join(images.select("caption_id", "image_url", "image_path"), "caption_id")
    return j.where("image_url is not null or image_path is not null").select("caption_id", "image_url", "image_path", units.alias("units"))


def caption_requests(rows: DataFrame, prompt: str) -> DataFrame:
    """(request_id, image, prompt): one request for each image, by the first of path, URL and row number that is there."""
    image = F.coalesce(F.nullif(F.trim("image_path"), F.lit("")), F.nullif(F.trim("image_url"), F.lit("")), F.concat(F.lit("row:"), F.col("row").cast("string")))
    first = rows.select(image.alias("image"), "row").groupBy("image").agg(F.min("row").alias("row"))
    return first.select(hashing.blake2b(F.concat(F.lit("caption:"), "image"), 16).alias("request_id"), "image", F.lit(prompt).alias("prompt"))


def at_rows(requests: DataFrame, source: DataFrame) -> DataFrame:
    """Requests with the source row (source_row, ...) that they name."""
    return requests.join(source, "source_row")
