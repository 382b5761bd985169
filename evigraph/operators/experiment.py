"""Collection of evaluation rows: templates, run sheets, blinding, merging and validation of completed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions import text
from evigraph.operators.gmetric import COLUMNS
from evigraph.operators.loops import numbered

# Columns of templates beyond those of an evaluation row, and of blinded sheets.
TEMPLATE_EXTRA = ("experiment_id", "evaluation_target", "story_title", "fair_play_status", "graph_file", "fair_play_diagnostic_file", "template_role")
BLINDED = ("run_id", "subject_id", "story_title", "phase", "item_id", "source_anchor", "y", "p", "answer", "response", "recognized_at", "row_key")
ANSWERED = ("y", "p", "answer", "response", "recognized_at")
REQUIRED = ("condition", "phase", "item_id", "claim_id", "env", "source_anchor", "contradiction_available_at", "fair_play_rating")
ROW_KEY = ("run_id", "subject_id", "condition", "phase", "item_id", "claim_id")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows as texts, blank cells empty; file names the input."""
    rows = spark.read.csv(path, header=True, inferSchema=False, nullValue="", multiLine=True, escape='"')
    return rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns], F.input_file_name().alias("file"))


def write_rows(rows: DataFrame, path: str, extra: tuple[str, ...] = ()) -> None:
    """The evaluation columns, then extra, then whatever else there is in order of name; missing ones are blank."""
    rest = sorted(c for c in rows.columns if c not in (*COLUMNS, *extra, "file"))
    rows.select(*[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in (*COLUMNS, *extra, *rest)]).write.csv(path, header=True)


def collection_template(claims: DataFrame, conditions: list[str], phases: list[str], admit: list[str], control: list[str] = (), env: str = "K", experiment_id: str = "", evaluation_target: str = "") -> DataFrame:
    """Blank rows for every claim, condition and phase.

    claims: (item_id, claim_id, source_anchor, contradiction_available_at, fair_play_rating) and optional story columns. Only admitted and control
    ratings take part where any are named; rows of control ratings have the role control.
    """
    allowed = [*admit, *control]
    rows = claims.where(F.col("fair_play_rating").isin(*allowed)) if allowed else claims
    rows = rows.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions]))).withColumn("phase", F.explode(F.array(*[F.lit(p) for p in phases])))
    role = F.when(F.col("fair_play_rating").isin(*control), "control").otherwise("primary") if control else F.lit("primary")
    fixed = {"env": F.lit(env), "experiment_id": F.lit(experiment_id), "evaluation_target": F.lit(evaluation_target), "template_role": role}
    return rows.select(*[fixed[c].alias(c) if c in fixed else F.col(c) if c in rows.columns else F.lit("").alias(c) for c in (*COLUMNS, *TEMPLATE_EXTRA)])


#: Parts of a sheet that are put in order by themselves, and rows of a sheet with places that are.
SHEET_PARTS, SHEET_ROWS = 4096, 4096


def _placed(rows: DataFrame, name: str, part: Column, order: list) -> DataFrame:
    """rows with name: the place of a row in the order within its run_id.

    part, a number that the order sorts by first, cuts a sheet into pieces: each is put in order by itself and comes after all rows of the pieces before it, so no
    task holds a sheet. What is added up over a sheet is a number a piece.
    """
    rows = rows.withColumns({"__run": F.coalesce("run_id", F.lit("\0")), "__part": F.coalesce(part.cast("long"), F.lit(-(2**62)))})
    sizes = rows.groupBy("__run", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__run").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__run", "__part", before.alias("__before"))
    inside = rows.withColumn("__at", F.row_number().over(Window.partitionBy("__run", "__part").orderBy(*order)))
    return inside.join(starts.hint("merge"), ["__run", "__part"]).withColumn(name, (F.col("__before") + F.col("__at")).cast("int")).drop("__run", "__part", "__before", "__at")


def run_sheets(rows: DataFrame, run_prefix: str, subject_prefix: str = "subject", subjects: int = 1, conditions: list[str] | None = None, phases: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Rows for every subject of every condition, with run_id, subject_id and place: a seeded order within the sheet, by hash."""
    if not run_prefix.strip():
        raise ValueError("a run prefix is needed")
    if subjects < 1:
        raise ValueError("subjects must be at least 1")
    rows = rows.where(F.col("condition") != "")
    rows = rows.where(F.col("condition").isin(*conditions)) if conditions else rows
    rows = rows.where(F.col("phase").isin(*phases)) if phases else rows
    number = F.format_string("%02d", "subject")  # pads, never cuts
    kind = text.slug(F.col("condition"))
    out = rows.withColumn("subject", F.explode(F.sequence(F.lit(1), F.lit(subjects))))
    out = out.withColumns({"run_id": F.concat_ws("-", F.lit(run_prefix), kind, number), "subject_id": F.concat_ws("-", F.lit(subject_prefix), kind, number)})
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), "condition", F.col("subject").cast("string"), "phase", "item_id", "claim_id"), 256)
    return _placed(out.withColumn("__hash", order), "place", F.floor(F.conv(F.substring("__hash", 1, 8), 16, 10).cast("long") / (2**32 // SHEET_PARTS)), ["__hash", "phase", "item_id", "claim_id"]).drop("__hash", "subject")


def blind(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(public rows with the blinded columns, private key with all columns); row_key is run_id::nnn (more digits where needed) unless there is one."""
    order = [c for c in ("place", *ROW_KEY) if c in rows.columns]
    if dict(rows.dtypes).get("place") in ("int", "bigint"):
        rows = _placed(rows, "__number", F.floor(F.col("place") / SHEET_ROWS), order)
    else:
        first = numbered(rows, ["run_id", *[c for c in order if c != "run_id"]], "__every")
        starts = first.groupBy("run_id").agg(F.min("__every").alias("__first")).withColumnRenamed("run_id", "__run")  # a row for each sheet
        rows = first.join(F.broadcast(starts), F.col("run_id").eqNullSafe(F.col("__run"))).withColumn("__number", (F.col("__every") - F.col("__first") + 1).cast("int")).drop("__run", "__every", "__first")
    number = F.format_string("%03d", "__number")
    own = F.nullif("row_key", F.lit("")) if "row_key" in rows.columns else F.lit(None).cast("string")
    key = rows.withColumn("row_key", F.coalesce(own, F.concat("run_id", F.lit("::"), number))).drop("__number")
    return key.select(*[F.col(c) if c in key.columns else F.lit("").alias(c) for c in BLINDED]), key


def unblind(public: DataFrame, key: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the answers of the public sheet and a new lag, findings for keys that are not known).

    A row_key that the private key holds twice would give one answer to several rows: the job fails and names it. Rows that were exploded from a small table
    look as small as that to the planner, so the joins say that they are not to be broadcast.
    """
    answers = public.select("row_key", *[F.col(c).alias(f"__{c}") for c in ANSWERED])
    repeated = F.count(F.lit(1)).over(Window.partitionBy("row_key")) > 1
    checked = key.drop(*ANSWERED).withColumn("row_key", F.when(repeated, F.raise_error(F.concat(F.lit("repeated row_key "), "row_key")).cast("string")).otherwise(F.col("row_key")))
    known = answers.join(checked.hint("merge"), "row_key")
    rows = known.withColumnsRenamed({f"__{c}": c for c in ANSWERED})
    rows = rows.withColumn("recognition_lag", F.coalesce(point_lag(F.col("contradiction_available_at"), F.col("recognized_at")).cast("string"), F.lit("")))
    lost = answers.join(key.select("row_key").hint("merge"), "row_key", "left_anti")
    return rows, lost.select(F.lit("error").alias("severity"), F.lit("unknown_blinded_row_key").alias("code"), F.col("row_key").alias("row"), F.lit(None).cast("string").alias("field"))


def point_lag(start: Column, end: Column) -> Column:
    """Difference of two points of a narrative, null where one is blank or no number."""
    number = lambda c: F.trim(c.cast("string")).try_cast("double")
    return number(end) - number(start)


def merge_sheets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows, findings for rows whose key occurred before, by file); repeated rows stay."""
    again = rows.withColumn("n", F.row_number().over(Window.partitionBy(*ROW_KEY).orderBy("file"))).where("n > 1")
    return rows, again.select(F.lit("error").alias("severity"), F.lit("duplicate_run_sheet_row").alias("code"), F.concat_ws("/", *ROW_KEY).alias("row"), F.lit(None).cast("string").alias("field"))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def row_findings(rows: DataFrame, require_completed: bool = True) -> DataFrame:
    """(severity, code, row, field): what is missing or wrong in evaluation rows; one pass, findings exploded from each row."""
    find = lambda when, severity, code, field=None: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(field).cast("string").alias("field")))
    found = [find(_blank(c), "error", "missing_required_g_collection_field", c) for c in REQUIRED]
    if require_completed:
        found += [find(_blank(c), "error", "missing_completed_g_field", c) for c in ("y", "p")]
        found.append(find(_blank("response"), "warning", "missing_response_text"))
    y, p = F.col("y").cast("string"), F.col("p").cast("string").try_cast("double")
    found.append(find(~_blank("y") & ~y.isin("0", "1"), "error", "invalid_y_value"))
    found.append(find(~_blank("p") & (p.isNull() | ~p.between(0, 1)), "error", "invalid_probability_value"))
    found.append(find((y == "1") & _blank("recognized_at"), "warning", "positive_recognition_missing_time"))
    lag, own = point_lag(F.col("contradiction_available_at"), F.col("recognized_at")), F.col("recognition_lag").cast("string").try_cast("double")
    found.append(find(lag.isNotNull() & _blank("recognition_lag"), "warning", "missing_recognition_lag"))
    found.append(find(lag.isNotNull() & ~_blank("recognition_lag") & ~F.coalesce(own == lag, F.lit(False)), "warning", "recognition_lag_mismatch"))
    row = F.concat_ws("/", "item_id", "claim_id", "condition", "phase")
    return rows.select(row.alias("row"), F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.severity", "f.code", "row", "f.field")


def manifest_of_rows(rows: DataFrame) -> dict:
    """row_count and the distinct conditions, phases, ratings and experiments that the rows name, in order."""
    listed = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(c)
    names = [c for c in ("condition", "phase", "fair_play_rating", "experiment_id", "evaluation_target") if c in rows.columns]
    return rows.agg(F.count(F.lit(1)).alias("row_count"), *[listed(c) for c in names]).first().asDict()
