"""Recognition passes: their plan, their order, and when to stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import geometry as g, text as t

# The language passes, and the regions and heights of text passes.
LANGUAGE_PASSES = (("ja-JP",), ("ko-KR",), ("zh-Hans", "zh-Hant"), ("en-US", "fr-FR", "de-DE", "it-IT", "es-ES"))
FIRST_OF = {"ja": "ja-JP", "ko": "ko-KR", "zh-Hans": "zh-Hans", "en": "en-US"}
#: Text passes: label, region (x, y, w, h; y up) or none, least height of text.
TEXT_PASSES = (
    ("normalized-full-card", None, 0.008), ("enhanced-full-card", None, 0.008), ("enhanced-top-band", (0.0, 0.66, 1.0, 0.34), 0.006),
    ("enhanced-middle-band", (0.0, 0.32, 1.0, 0.36), 0.006), ("enhanced-bottom-band", (0.0, 0.0, 1.0, 0.35), 0.006),
)
STATES = {
    "idle": "Start the camera, then capture a frame to crop the card.",
    "requestingPermission": "Requesting camera access...",
    "running": "Scanning for a steady card shape...",
    "holdingSteady": "Hold steady while the card comes into focus...",
    "moveFartherAway": "Move a little farther away so the card text can focus.",
    "moreLightNeeded": "More light needed to focus the card text.",
    "capturing": "Cropping captured frame...",
    "completed": "Card crop captured. Scan again to restart the camera.",
}
STARTABLE, CROPPABLE = ("idle", "completed", "failed"), ("running", "holdingSteady", "moveFartherAway", "moreLightNeeded")


def language_passes(spark: SparkSession) -> DataFrame:
    """(ordinal, languages): the default passes."""
    return spark.createDataFrame([(i, [*p]) for i, p in enumerate(LANGUAGE_PASSES)], "ordinal int, languages array<string>")


def ordered(groups: DataFrame, primary: str) -> DataFrame:
    """Each group's passes: that of its primary language first (none: the
    default order), the rest as they are.  The plan has four rows."""
    plan = groups.sparkSession.range(1).select(F.posexplode(F.array(*(F.array(*map(F.lit, p)) for p in LANGUAGE_PASSES))).alias("ordinal", "languages"))
    names = F.create_map(*(F.lit(x) for pair in FIRST_OF.items() for x in pair))
    own = F.coalesce(F.array_contains("languages", names[F.col(primary)]), F.lit(False))
    rows = groups.join(F.broadcast(plan))
    place = F.row_number().over(Window.partitionBy(*groups.columns).orderBy(own.desc(), "ordinal"))
    return rows.withColumn("place", place)


def until_satisfied(results: DataFrame, key: str, place: str, title: str, dominant: str) -> DataFrame:
    """Results of all passes as rows: those up to and with the first whose title
    needs no further pass; all where none is good enough."""
    w = Window.partitionBy(key).orderBy(place)
    rows = results.withColumn("__good", t.satisfies(F.col(title), F.col(dominant)).cast("int"))  # before the shuffle, which then needs no titles
    before = F.coalesce(F.max("__good").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__done", before).where("__done = 0").drop("__done", "__good")


def with_retry(explicit: Column, plain: Column) -> Column:
    """The result with explicit languages, else the one without."""
    return F.coalesce(explicit, plain)


def failed(reports: DataFrame, key: str) -> DataFrame:
    """Keys without any observation of which some pass failed."""
    sums = reports.groupBy(key).agg(F.sum("observations").alias("n"), F.count("error").alias("errors"))
    return sums.where("coalesce(n, 0) = 0 and errors > 0").select(key)


def outcomes(reports: DataFrame, key: str, place: str | Column, raising: bool = False) -> DataFrame:
    """For each key the number of its observations, and the first error in the
    order of ``place`` where there is none of them though some pass failed;
    with ``raising`` that error ends the job."""
    first = F.min(F.when(F.col("error").isNotNull(), F.struct((F.col(place) if isinstance(place, str) else place).alias("place"), "error")))["error"]
    sums = reports.groupBy(key).agg(F.coalesce(F.sum("observations"), F.lit(0)).cast("long").alias("n"), first.alias("error"))
    error = F.when(F.col("n") == 0, F.col("error"))
    if raising:
        error = F.when(error.isNotNull(), F.raise_error(error)).cast("string")
    return sums.select(key, "n", error.alias("error"))


def completed(captures: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Captures with their names, null where none was found."""
    return captures.join(names, key, "left")


def planned(images: DataFrame) -> DataFrame:
    """``images`` with the five text passes of each: ordinal, label, enhanced,
    region (null: the whole image) and min_height."""
    none = F.lit(None).cast("struct<x: double, y: double, w: double, h: double>")
    plan = F.array(*(
        F.struct(F.lit(label).alias("label"), F.lit(label.startswith("enhanced")).alias("enhanced"), (none if r is None else g.rect(*r)).alias("region"), F.lit(least).alias("min_height"))
        for label, r, least in TEXT_PASSES
    ))
    return images.select("*", F.posexplode(plan).alias("ordinal", "p")).select(*images.columns, "ordinal", "p.*")


def summary(label: Column, count: Column, explicit: Column, texts: Column) -> Column:
    """A pass in one line: its candidates, whether languages were given, and
    its first five texts."""
    top = F.slice(texts, 1, 5)
    mode = F.when(explicit, "broad").otherwise("auto")
    return F.concat(label, F.lit(": "), count.cast("string"), F.lit(" candidates, "), mode, F.lit(", "), F.when(F.size(top) > 0, F.array_join(top, " | ")).otherwise("none"))


def status(state: Column, message: Column | None = None) -> Column:
    """The text shown for a state; a failure shows its message."""
    names = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    return F.when(state == "failed", F.lit(None).cast("string") if message is None else message).otherwise(names[state])


def can_start(state: Column) -> Column:
    return state.isin(*STARTABLE)


def can_crop(state: Column) -> Column:
    return state.isin(*CROPPABLE)


def gated(rows: DataFrame, mode: str, *allowed: str) -> DataFrame:
    """Rows of a route that only some server modes have: all of them in these
    modes and in tests, else an error."""
    if mode not in MODES:
        raise ValueError(f"not a mode: {mode}")
    if mode != "TEST" and mode not in allowed:
        raise LookupError(f"not found in mode {mode}")
    return rows


# The server's modes, the first of them by default.
MODES = ("API", "SEED", "TEST")


def mode(name: Column) -> Column:
    """A mode's name in capitals, the default for null; an error for any other."""
    upper = F.upper(name)
    wrong = F.raise_error(F.concat(F.lit("not a mode: "), name))
    return F.when(name.isNull(), F.lit(MODES[0])).when(upper.isin(*MODES), upper).otherwise(wrong)
