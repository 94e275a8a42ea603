"""Reads and small writes over patients, documents, runs and their mentions: lists, details, exports, run control.

Tables name each other by ``patient``, ``doc`` and ``run``; ``bridge`` (run, doc) says which documents a run has. Every
read works for all keys at once; one key is a filter before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ARTIFACTS, LOGS = 200, 100
CANCELLED = "Cancelled by user"


def _holds(columns: list[str], q: str) -> Column:
    """Whether any column holds ``q``, in any case; an empty ``q`` is held by all."""
    low = F.lit(q.strip().lower())
    hit = F.lit(not q.strip())
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), low), F.lit(False))
    return hit


def _counts(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def of_run(docs: DataFrame, bridge: DataFrame, run: str | None) -> DataFrame:
    """The documents of a run, each once; all without one."""
    return docs if run is None else docs.join(bridge.where(F.col("run") == run).select("doc"), "doc", "left_semi")


def patient_list(patients: DataFrame, docs: DataFrame, mentions: DataFrame, bridge: DataFrame, q: str = "", run: str | None = None, has_results: bool = False, results: DataFrame | None = None) -> DataFrame:
    """Patients (patient, code, name) whose code or name holds ``q``, with their documents and mentions counted apart.
    With ``run`` only those with a document in it; with ``has_results`` only those in ``results``. In order of the code."""
    out = patients.where(_holds(["code", "name"], q))
    if run is not None:
        out = out.join(of_run(docs, bridge, run).select("patient"), "patient", "left_semi")
    if has_results and results is not None:
        out = out.join(results.select("patient"), "patient", "left_semi")
    out = out.join(_counts(docs, "patient", "documents"), "patient", "left").join(_counts(mentions, "patient", "mentions"), "patient", "left")
    return out.fillna(0, ["documents", "mentions"]).orderBy("code", "patient")


def document_list(docs: DataFrame, patients: DataFrame, bridge: DataFrame, q: str = "", run: str | None = None) -> DataFrame:
    """Documents (doc, patient, filename, created) with their patient's code and name, of those whose filename, code or
    name holds ``q``; newest first."""
    joined = of_run(docs, bridge, run).join(patients.select("patient", "code", "name"), "patient")
    return joined.where(_holds(["filename", "code", "name"], q)).orderBy(F.desc("created"), F.desc("doc"))


def first_of_each(rows: DataFrame, key: str, order: list[Column], limit: int, place: str = "place") -> DataFrame:
    """The first ``limit`` rows of each key, with their place."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn(place, F.row_number().over(w)).where(F.col(place) <= limit)


def patient_detail(patients: DataFrame, docs: DataFrame, mentions: DataFrame, artifacts: DataFrame, relations: DataFrame, records: DataFrame) -> dict[str, DataFrame]:
    """The parts of a patient's page: documents by name, mentions by category and date, the first ARTIFACTS artifacts by
    page and reading order, relations by type and time, and the record."""
    ids = patients.select("patient")

    def own(df: DataFrame) -> DataFrame:
        return df.join(ids, "patient", "left_semi")

    return {
        "documents": own(docs).orderBy("patient", "filename", "doc"),
        "mentions": own(mentions).orderBy("patient", "category", "date_text", "seq"),
        "artifacts": first_of_each(own(artifacts), "patient", [F.col("page"), F.col("reading_order"), F.col("artifact")], ARTIFACTS),
        "relations": own(relations).orderBy("patient", "relation_type", "created", "relation"),
        "record": own(records),
    }


def run_detail(bridge: DataFrame, docs: DataFrame, mentions: DataFrame, logs: DataFrame) -> dict[str, DataFrame]:
    """The parts of a run's page: its documents by name, its patients with what they have in this run, its latest LOGS
    logs."""
    inside = bridge.join(docs, "doc")
    found = mentions.groupBy("run", "patient").agg(F.count("*").alias("mentions"))
    patients = inside.groupBy("run", "patient").agg(F.countDistinct("doc").alias("documents")).join(found, ["run", "patient"], "left")
    return {
        "documents": inside.orderBy("run", "filename", "doc"),
        "patients": patients.fillna(0, ["mentions"]),
        "logs": first_of_each(logs, "run", [F.desc("created"), F.desc("log")], LOGS),
    }


def run_export(bridge: DataFrame, docs: DataFrame, mentions: DataFrame, columns: list[str]) -> DataFrame:
    """(run, patient, json): one document for each patient of each run, with the mentions that this run found, in order
    of their ``seq``; a patient without any has an empty list."""
    owners = bridge.join(docs.select("doc", "patient"), "doc").select("run", "patient").distinct()
    rows = F.array_sort(F.collect_list(F.struct("seq", *columns)))
    found = mentions.groupBy("run", "patient").agg(rows.alias("rows"))
    kind = found.schema["rows"].dataType.simpleString()
    every = owners.join(found, ["run", "patient"], "left").withColumn("rows", F.coalesce("rows", F.array().cast(kind)))
    bare = F.transform("rows", lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    return every.select("run", "patient", F.to_json(F.struct(F.col("patient").alias("patient_code"), bare.alias("mentions"))).alias("json"))


def start_run(bridge: DataFrame, docs: DataFrame, run: str, chosen: DataFrame) -> DataFrame:
    """``bridge`` with a run over the chosen documents that exist, each once; a run is never over all by default."""
    new = docs.join(chosen.select("doc"), "doc", "left_semi").select(F.lit(run).alias("run"), "doc")
    return bridge.unionByName(new.join(bridge.where(F.col("run") == run).select("doc"), "doc", "left_anti").select("run", "doc"))


def start_one(bridge: DataFrame, docs: DataFrame, run: str) -> DataFrame:
    """``bridge`` with a run over the earliest document."""
    return start_run(bridge, docs, run, docs.orderBy("created", "doc").limit(1))


def cancel_runs(runs: DataFrame, chosen: DataFrame, now: Column) -> DataFrame:
    """``runs`` (run, status, error_message, completed) with the chosen ones failed, unless they are over already."""
    hit = runs.join(chosen.select("run").distinct().withColumn("__hit", F.lit(True)), "run", "left")
    stop = F.col("__hit") & ~F.col("status").isin("completed", "failed")
    new = {"status": F.lit("failed"), "error_message": F.lit(CANCELLED), "completed": now}
    return hit.withColumns({c: F.when(stop, v).otherwise(F.col(c)) for c, v in new.items()}).drop("__hit")


def with_progress(df: DataFrame) -> DataFrame:
    """``df`` (total, done, seconds since the start) with whole percent and the whole seconds left at the pace so far;
    null where nothing is done yet, zero percent of nothing."""
    total, done = F.col("total"), F.least("done", "total")
    percent = F.when(total > 0, F.expr("100 * least(done, total) div total")).otherwise(F.lit(0).cast("long"))
    left = F.when(done > 0, F.ceil((total - done) * (F.col("seconds") / done)).cast("long"))
    return df.withColumns({"percent": percent, "eta_seconds": left})


def describe(df: DataFrame, columns: list[str], accuracy: int = 100_000) -> DataFrame:
    """(name, n, mean, deviation, least, quarter, half, three_quarters, most), a row for each numeric column, in one pass
    over the rows; quartiles are values of the column, exact to a part in ``accuracy`` of the ranks."""
    one = lambda c: F.struct(
        F.lit(c).alias("name"), F.count(c).alias("n"), F.avg(c).cast("double").alias("mean"), F.stddev(c).alias("deviation"), F.min(c).cast("double").alias("least"),
        F.percentile_approx(F.col(c).cast("double"), [0.25, 0.5, 0.75], accuracy).alias("q"), F.max(c).cast("double").alias("most"),
    )
    rows = df.agg(F.array(*[one(c) for c in columns]).alias("rows")).select(F.inline("rows"))
    q = [F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("quarter", "half", "three_quarters"))]
    return rows.select("name", "n", "mean", "deviation", "least", *q, "most")
