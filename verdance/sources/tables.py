"""Annotation sheets, verdicts, submissions, results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import neutralised, restored, without_mark
from ..operators.agreement import CATEGORIES

RESULT = "task string, model struct<name:string,prompt_version:string>, per_item_predictions array<struct<item_id:string,depth:int,group:string,gold:string,predicted:string,confidence:double,rationale:string,unanswerable:boolean>>"
#: A submission is one document: its size in bytes and rows at most.
MOST_BYTES, MOST_ROWS = 64 << 20, 500_000
SUBMISSION = "model string, task string, predictions array<struct<item_id:string,label:boolean,confidence:double>>"


def write_sheet(rows: DataFrame, path: str) -> None:
    """A CSV with a header whose text cells no spreadsheet takes for formulas."""
    safe = [neutralised(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*safe).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def read_sheet(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV with a header, all strings, byte order mark and quotes taken off; a missing column is an error."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    df = raw.select(*(restored(without_mark(F.col(f"`{c}`"))).alias(c.lstrip("﻿").strip()) for c in raw.columns))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no column {missing}")
    return df


def read_annotations(spark: SparkSession, path: str, column: str = "category") -> DataFrame:
    """item_id, category, clinical and the other columns of a filled sheet: rows without a category drop out, an unknown one is an error."""
    df = read_sheet(spark, path, ["item_id", column])
    value = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    known = F.when(value.isin(*CATEGORIES), value).otherwise(F.raise_error(F.concat(F.lit("unknown category "), value)).cast("string"))
    flag = F.lower(F.trim(F.col("clinical_judgement_required"))).isin("yes", "y", "true", "1") if "clinical_judgement_required" in df.columns else F.lit(False)
    return df.where(value != "").withColumn("category", known).withColumn("clinical", F.coalesce(flag, F.lit(False)))


#: Columns of an adjudication sheet; the last two are for the one who resolves.
ADJUDICATION = ["item_id", "arm", "depth", "annotator1", "annotator2", "clinical_judgement_required", "adjudication_rule", "resolved_category", "resolution_note"]


def write_adjudication(disagreements: DataFrame, path: str) -> None:
    """The sheet on which disagreements (item_id, a, b, clinical, rule and perhaps arm and depth) are resolved, with columns left to be filled."""
    have = {"item_id": F.col("item_id"), "annotator1": F.col("a"), "annotator2": F.col("b"), "clinical_judgement_required": F.when(F.col("clinical"), "yes").otherwise("no"), "adjudication_rule": F.col("rule")}
    have |= {c: F.col(c) for c in ("arm", "depth") if c in disagreements.columns}
    write_sheet(disagreements.select(*(have.get(c, F.lit("")).cast("string").alias(c) for c in ADJUDICATION)), path)


def read_adjudication(spark: SparkSession, path: str) -> DataFrame:
    """item_id, category and note of the resolved rows of such a sheet; an unknown category is an error."""
    df = read_annotations(spark, path, "resolved_category")
    return df.select("item_id", "category", F.trim(F.coalesce("resolution_note", F.lit(""))).alias("note"))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """item_id and verdict (keep or drop); other rows drop out."""
    df = read_sheet(spark, path, ["item_id", "verdict"])
    return df.select("item_id", F.lower(F.trim("verdict")).alias("verdict")).where("verdict IN ('keep', 'drop')")


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """model, task, item_id, label and confidence (1 where not given) of a submission.

    A file of more than MOST_BYTES, one that isn't an object with model, task and predictions, or a field of another type is
    an error; validation.rejected_predictions finds the rows that can't be scored."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path", "length")
    if files.where(F.col("length") > MOST_BYTES).limit(1).count():
        raise ValueError(f"{path}: more than {MOST_BYTES} bytes")
    raw = spark.read.schema(SUBMISSION).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if raw.where("model IS NULL OR task IS NULL OR predictions IS NULL").limit(1).count():
        raise ValueError(f"{path}: a submission has a model, a task and predictions")
    return raw.select("model", "task", F.explode("predictions").alias("p")).select("model", "task", "p.item_id", "p.label", F.coalesce("p.confidence", F.lit(1.0)).alias("confidence"))


def write_submission(predictions: DataFrame, model: str, task: str, path: str) -> None:
    """One JSON object with all predictions, as read_submission() takes it: a file of MOST_BYTES at most, made by one task.

    More predictions than MOST_ROWS are an error."""
    if predictions.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} predictions")
    rows = predictions.agg(F.array_sort(F.collect_list(F.struct("item_id", "label", "confidence"))).alias("predictions"))
    rows.select(F.lit(model).alias("model"), F.lit(task).alias("task"), "predictions").coalesce(1).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """per_item rows of all result files below a folder: run is `task::model@folder`; hidden files and leaderboards are passed over."""
    raw = spark.read.schema(RESULT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).withColumn("__f", F.input_file_name())
    folder = F.regexp_extract("__f", r"([^/]*)/[^/]*$", 1)
    name = F.regexp_extract("__f", r"([^/]*)\.json$", 1)
    rows = raw.where(~F.rlike(name, F.lit("(?i)leaderboard|missing|^[._]"))).select(F.concat(F.col("task"), F.lit("::"), F.coalesce("model.name", F.lit("?")), F.lit("@"), folder).alias("run"), F.col("model.name").alias("model"), F.col("model.prompt_version").alias("prompt"), F.explode("per_item_predictions").alias("p"))
    return rows.select("run", "model", "prompt", "p.item_id", F.col("p.depth").alias("level"), (F.col("p.gold") == "met").alias("gold"), (F.col("p.predicted") == "met").alias("predicted"), "p.confidence", "p.rationale", F.coalesce("p.unanswerable", F.lit(False)).alias("unanswerable"))


def write_results(rows: DataFrame, path: str) -> None:
    """Result files as read_results() takes them: below `path`, a folder for each task, model and prompt of rows (task, model, prompt, item_id, level, gold, predicted,
    confidence, rationale, unanswerable) with a JSON object for each MOST_ROWS of its items or fewer, dealt by hash, so no task gathers a whole run."""
    word = lambda c: F.when(F.col(c), "met").when(~F.col(c), "not_met")
    item = F.struct("item_id", F.col("level").cast("int").alias("depth"), F.lit(None).cast("string").alias("group"), word("gold").alias("gold"), word("predicted").alias("predicted"), "confidence", "rationale", F.coalesce("unanswerable", F.lit(False)).alias("unanswerable"))
    keys = ["task", "model", "prompt"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    parts = F.pmod(F.xxhash64("item_id"), F.ceil(F.col("__n") / (MOST_ROWS // 2)))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    dealt = rows.alias("r").join(sizes.alias("s"), same[0] & same[1] & same[2]).select("r.*", parts.alias("__part"))
    made = dealt.groupBy(*keys, "__part").agg(F.array_sort(F.collect_list(item)).alias("per_item_predictions"))
    folder = F.regexp_replace(F.concat_ws("__", *keys), r"[^A-Za-z0-9_.-]", "-")
    out = made.select("task", F.struct(F.col("model").alias("name"), F.col("prompt").alias("prompt_version")).alias("model"), "per_item_predictions", folder.alias("run"))
    out.write.partitionBy("run").option("maxRecordsPerFile", 1).mode("overwrite").json(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Below `path`: `report`, Markdown text with a heading and a table each, and a folder of JSON lines each with all their rows."""
    spark = next(iter(tables.values())).sparkSession
    text = "\n\n".join(f"## {name}\n\n{report(table)}" for name, table in tables.items())
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def report(table: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; `most` rows bound what reaches the driver, and a longer table says so."""
    rows = table.limit(most + 1).collect()
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    for r in rows[:most]:
        lines.append("| " + " | ".join("-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join([*lines, *(["| more rows |"] if len(rows) > most else [])])
