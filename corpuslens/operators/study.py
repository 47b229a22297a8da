"""Analytics of an annotation study: coverage, queues, status, exports and privacy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing

PHASES = ("caption", "image")
#: Columns of a public annotation row; everything else is dropped.
PUBLIC = (
    "study_id", "item_id", "item_group", "participant", "phase", "category", "surface", "category_check", "corrected_category", "image_support", "control_usefulness", "salient_coverage",
    "confidence", "sampling_weight", "stratum", "repeat_of",
)


def label_coverage(items: DataFrame, assignments: DataFrame, labels: int) -> DataFrame:
    """(item_id, phase, raters) of items and phases whose number of distinct raters is not `labels`."""
    grid = items.where("repeat_of is null").select("item_id", F.explode(F.array(*[F.lit(p) for p in PHASES])).alias("phase"))
    have = assignments.groupBy("item_id", "phase").agg(F.count_distinct("participant").alias("raters"))
    return grid.join(have, ["item_id", "phase"], "left").withColumn("raters", F.coalesce("raters", F.lit(0))).where(F.col("raters") != labels)


def completed_participants(assignments: DataFrame) -> DataFrame:
    """Participants with an assignment and none that is not complete."""
    some = assignments.select("participant").distinct()
    open_ones = assignments.where("status <> 'complete' or status is null").select("participant")
    return some.join(open_ones, "participant", "left_anti")


def repeat_spacing(assignments: DataFrame) -> DataFrame:
    """(participant, phase, item_id, distance): places between a repeat and its original in the same queue."""
    a = assignments.select("participant", "phase", "item_id", "repeat_of", "position")
    o = a.select("participant", "phase", F.col("item_id").alias("repeat_of"), F.col("position").alias("original"))
    return a.where("repeat_of is not null").join(o, ["participant", "phase", "repeat_of"]).select("participant", "phase", "item_id", (F.col("position") - F.col("original")).alias("distance"))


def next_position(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("participant", "phase").agg((F.max("position") + 1).alias("position"))


def next_task(assignments: DataFrame, participant: str) -> DataFrame:
    """The first task that is not complete, caption before image, by position."""
    phase = F.when(F.col("phase") == PHASES[0], 0).otherwise(1)
    return assignments.where((F.col("participant") == participant) & (F.coalesce("status", F.lit("")) != "complete")).orderBy(phase, "position").limit(1)


def remaining_first(items: DataFrame, assignments: DataFrame, participant: str, labels: int) -> DataFrame:
    """The item to claim next: not this participant's, with labels missing; fewest assigned raters first, then the stratum with
    the least overlap, then position."""
    per = assignments.groupBy("item_id").agg(F.count_distinct("participant").alias("assigned"), F.count_distinct(F.when(F.col("status") == "complete", F.col("participant"))).alias("done"))
    mine = assignments.where(F.col("participant") == participant).select("item_id")
    j = items.join(per, "item_id", "left").fillna(0, ["assigned", "done"])
    overlap = j.groupBy("stratum").agg(F.sum(F.greatest(F.col("assigned") - 1, F.lit(0))).alias("overlap"))
    return j.where(F.col("assigned") < labels).join(mine, "item_id", "left_anti").join(overlap, "stratum").orderBy("assigned", "overlap", "position", "item_id").limit(1)


def pool_incomplete(items: DataFrame, assignments: DataFrame, labels: int) -> DataFrame:
    done = assignments.where("status = 'complete'").groupBy("item_id").agg(F.count_distinct("participant").alias("done"))
    return items.join(done, "item_id", "left").withColumn("done", F.coalesce("done", F.lit(0))).where(F.col("done") < labels).select("item_id", "done")


def latest_annotation(events: DataFrame) -> DataFrame:
    """The highest revision of each assignment."""
    rest = [c for c in events.columns if c != "assignment_id"]
    return events.groupBy("assignment_id").agg(F.max_by(F.struct(*rest), "revision").alias("r")).select("assignment_id", "r.*")


def adjudication_candidates(annotations: DataFrame, adjudications: DataFrame, labels: int, fields: list[str]) -> DataFrame:
    """Items and phases with a full panel that gave more than one tuple of answers and have no adjudication."""
    g = annotations.groupBy("item_id", "phase").agg(F.count_distinct("participant").alias("raters"), F.size(F.collect_set(F.struct(*fields))).alias("tuples"))
    return g.where((F.col("raters") >= labels) & (F.col("tuples") > 1)).join(adjudications.select("item_id", "phase"), ["item_id", "phase"], "left_anti")


def export_rows(annotations: DataFrame, items: DataFrame, participants: DataFrame, adjudications: DataFrame, labels: int, fields: list[str]) -> DataFrame:
    """Annotations of eligible participants with their items, and the adjudication of full panels that disagree."""
    base = annotations.join(participants.where("eligible").select("participant"), "participant").join(items, "item_id")
    panel = base.groupBy("item_id", "phase").agg(F.count_distinct("participant").alias("raters"), F.size(F.collect_set(F.struct(*fields))).alias("tuples"))
    split = panel.where((F.col("raters") >= labels) & (F.col("tuples") > 1)).select("item_id", "phase")
    return base.join(adjudications.join(split, ["item_id", "phase"], "left_semi"), ["item_id", "phase"], "left")


def consensus_or_adjudicated(rows: DataFrame, field: str) -> DataFrame:
    """(item_id, phase, value): the adjudicated value, else the one that over half of at least two raters gave."""
    n = rows.groupBy("item_id", "phase", field).agg(F.count("*").alias("n"), F.max("adjudicated").alias("adjudicated"))
    g = n.groupBy("item_id", "phase").agg(F.max("adjudicated").alias("adjudicated"), F.sum(F.when(F.col(field).isNotNull(), F.col("n"))).alias("raters"), F.max_by(F.when(F.col(field).isNotNull(), F.col(field)), F.when(F.col(field).isNotNull(), F.col("n"))).alias("top"), F.max(F.when(F.col(field).isNotNull(), F.col("n"))).alias("most"))
    return g.select("item_id", "phase", F.coalesce("adjudicated", F.when((F.col("raters") >= 2) & (2 * F.col("most") > F.col("raters")), F.col("top"))).alias("value"))


def public_rows(rows: DataFrame, key: bytes) -> DataFrame:
    """Allowed columns only, ids replaced by keyed pseudonyms."""
    kept = rows.select(*[c for c in PUBLIC if c in rows.columns])
    for c in ("participant", "item_id", "item_group"):
        if c in kept.columns:
            kept = kept.withColumn(c, hashing.keyed_pseudonym(F.col(c).cast("string"), key))
    return kept


def salient_rows(rows: DataFrame) -> DataFrame:
    """One row of each participant, image and surface: that of the first item by name."""
    rest = [c for c in rows.columns if c not in ("participant", "item_group", "surface")]
    return rows.groupBy("participant", "item_group", "surface").agg(F.min_by(F.struct(*rest), "item_id").alias("r")).select("participant", "item_group", "surface", "r.*")


def status_summary(assignments: DataFrame) -> DataFrame:
    """By phase: assignments, complete ones, participants and items touched."""
    return assignments.groupBy("phase").agg(F.count("*").alias("assignments"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_distinct("participant").alias("participants"), F.count_distinct("item_id").alias("items"), F.count_if(F.col("repeat_of").isNotNull()).alias("repeats"))


def profile_marginals(profiles: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) over arrays or scalars of profile answers; several answers of one person count once each."""
    parts = None
    for f in fields:
        kind = profiles.schema[f].dataType.simpleString()
        value = F.explode(F.array_distinct(F.col(f))) if kind.startswith("array") else F.col(f)
        one = profiles.select("participant", value.cast("string").alias("value") if not kind.startswith("array") else value.alias("value")).where("value is not null").groupBy("value").agg(F.count_distinct("participant").alias("n")).select(F.lit(f).alias("field"), F.col("value").cast("string").alias("value"), "n")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def annotation_problems(phase: Column, payload: dict[str, Column], categories: tuple[str, ...]) -> Column:
    """Names of the label rules that a payload breaks; empty where it is valid."""
    caption, image = phase == PHASES[0], phase == PHASES[1]
    known = payload["corrected_category"].isin(*categories)
    rules = {
        "phase": ~phase.isin(*PHASES),
        "category_check": caption & ~F.coalesce(payload["category_check"].isin("correct", "incorrect", "unsure"), F.lit(False)),
        "corrected_category": caption & (F.coalesce(payload["category_check"], F.lit("")) == "incorrect") & ~F.coalesce(known, F.lit(False)),
        "needless_correction": caption & (F.coalesce(payload["category_check"], F.lit("")) != "incorrect") & payload["corrected_category"].isNotNull(),
        "image_support": image & ~F.coalesce(payload["image_support"].isin("yes", "no", "uncertain"), F.lit(False)),
        "confidence": image & ~F.coalesce(payload["confidence"].between(1, 5), F.lit(False)),
    }
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())


def readiness(checks: DataFrame) -> DataFrame:
    """From (gate, value, least): whether all hold, and the names of those that fail."""
    failed = F.when(F.coalesce(F.col("value") < F.col("least"), F.lit(True)), F.col("gate"))
    return checks.agg((F.count(failed) == 0).alias("ready"), F.sort_array(F.collect_list(failed)).alias("reasons"))


def queue_positions(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("position", F.row_number().over(Window.partitionBy("participant", "phase").orderBy("h", "item_id")) - 1)
