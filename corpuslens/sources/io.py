"""Readers and writers of records: JSON lines, Parquet, CSV, text; TSV, Markdown and LaTeX tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .scratch import held


def expand(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Paths of the patterns by Spark's own file systems, each once, in order."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = set()
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        for s in path.getFileSystem(conf).globStatus(path) or []:
            found.add(s.getPath().toString())
    return sorted(found)


def format_of(path: str) -> str:
    """parquet, json, csv or text by the suffix; anything else is an error."""
    name = path.lower().removesuffix(".gz")
    for suffix, kind in ((".parquet", "parquet"), (".jsonl", "json"), (".json", "json"), (".csv", "csv"), (".txt", "text")):
        if name.endswith(suffix):
            return kind
    raise ValueError(f"unknown format: {path}")


def read_records(spark: SparkSession, paths: list[str], schema: str | None = None, strict: bool = True) -> DataFrame:
    """Files of mixed formats as one frame; columns that a file lacks are null. Strict JSON fails on a bad line; else such a
    line is kept in _corrupt_record where the schema has it."""
    by_kind: dict[str, list[str]] = {}
    for p in paths:
        by_kind.setdefault(format_of(p), []).append(p)
    out = None
    for kind, own in sorted(by_kind.items()):
        reader = spark.read
        if kind == "json":
            reader = reader.option("mode", "FAILFAST" if strict else "PERMISSIVE")
            df = (reader.schema(schema) if schema else reader).json(own)
        elif kind == "csv":
            df = reader.option("header", True).csv(own)
        elif kind == "text":
            df = reader.text(own)
        else:
            df = reader.parquet(*own)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def caption_column(df: DataFrame, field: str | None = None) -> tuple[Column, Column]:
    """(caption, name of the field it came from): the given field, or the first default one that is not blank."""
    names = [field] if field else [f for f in X.DEFAULT_FIELDS if f in df.columns]
    if not names or any(n not in df.columns for n in names):
        raise ValueError("no caption column")
    filled = {n: F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names}
    used = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in filled.items()])
    return F.coalesce(*filled.values()), used


def load_captions(df: DataFrame, field: str | None = None) -> DataFrame:
    """Rows with a caption, which is in column caption, and the field used."""
    caption, used = caption_column(df, field)
    return df.select("*", caption.alias("_caption"), used.alias("used_field")).where("_caption is not null")


def read_where_in(spark: SparkSession, path: str, key: str, keys: DataFrame) -> DataFrame:
    """Parquet rows whose key stands in keys; columns that later steps drop are never read."""
    return spark.read.parquet(path).join(keys.select(key).distinct(), key, "left_semi")


def tag_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Space-separated tag strings as arrays."""
    return df.select(*[c for c in df.columns if c not in columns], *[X.words(F.col(c)).alias(c) for c in columns])


def tar_members(paths: DataFrame, wanted: set[str]) -> DataFrame:
    """(path, member, size, content) of the wanted members of tar files; paths has a column path that executors can open. A file
    is read no further than its last wanted member."""
    import tarfile
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                left = set(wanted)
                with tarfile.open(path) as tar:
                    for m in tar:
                        if m.name in left:
                            left.discard(m.name)
                            yield pd.DataFrame({"path": [path], "member": [m.name], "size": [m.size], "content": [tar.extractfile(m).read()]})
                        if not left:
                            break

    return paths.select("path").mapInPandas(run, "path string, member string, size long, content binary")


def discover(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows with distinct keys and a global_index by key order, without a sort of all rows in one task.

    The sorted rows are kept first, so that the counts of the partitions and the index read the same partitions."""
    rows = df.dropDuplicates([key]).orderBy(key)
    if limit is not None:
        rows = rows.limit(limit)
    part = held(rows).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    # rows before each sorted partition: one small number a partition
    sizes = {r["_p"]: r["count"] for r in part.groupBy("_p").count().collect()}
    before, starts = 0, {}
    for p in sorted(sizes):
        starts[p] = before
        before += sizes[p]
    table = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]) if starts else F.create_map(F.lit(0), F.lit(0))
    return part.withColumn("global_index", (table[F.col("_p")] + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_p", "_i")


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns, missing ones and nulls empty; refuses an existing path."""
    df.select(*[(F.col(c) if c in df.columns else F.lit("")).cast("string").alias(c) for c in columns]).write.mode("errorifexists").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def _cells(df: DataFrame, columns: list[str], digits: int, most: int) -> list[list[str]]:
    """Rows of a report table; more than `most` are refused, not cut."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a table")
    return [["" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v) for v in r] for r in rows]


def markdown(df: DataFrame, columns: list[str], digits: int = 3, most: int = 500) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in _cells(df, columns, digits, most))]) + "\n"


def latex(df: DataFrame, columns: list[str], digits: int = 3, most: int = 500) -> str:
    escape = lambda s: s.replace("\\", r"\textbackslash{}").replace("&", r"\&").replace("%", r"\%").replace("_", r"\_").replace("#", r"\#")
    body = [" & ".join(escape(c) for c in r) + r" \\" for r in _cells(df, columns, digits, most)]
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", r"\toprule", " & ".join(map(escape, columns)) + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}"]) + "\n"


def long_form(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys..., metric, value): numeric columns unpivoted."""
    return df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(keys, values, "metric", "value")
