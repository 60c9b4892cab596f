"""Case data: timelines, audit feeds and case files for all alerts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalar import percent_text
from riskloom.operators.ordered import SLICE, by_heat, running, slice_ordered
from riskloom.operators.ranking import latest


def with_actor(audit: DataFrame, users: DataFrame) -> DataFrame:
    """The actor's e-mail, or the id where the user is unknown."""
    return audit.join(users, audit["actor_id"] == users["user_id"], "left").withColumn(
        "actor", F.coalesce("email", F.col("actor_id").cast("string"))).drop("user_id", "email")


def timeline(alerts: DataFrame, audit: DataFrame, notes: DataFrame, feedback: DataFrame) -> DataFrame:
    """Detection, actions, notes and dispositions as rows (alert_id, ts, kind, actor, text)."""
    def rows(df, alert_id, kind, actor: Column, text: Column):
        return df.select(F.col(alert_id).alias("alert_id"), F.col("created_at").alias("ts"), F.lit(kind).alias("kind"),
                         actor.alias("actor"), text.alias("text"))

    scored = F.concat(F.lit("Transaction scored "), F.col("risk_label"), F.lit(" ("), percent_text(F.col("risk_score")), F.lit(")"))
    detected = rows(alerts, "id", "detected", F.lit("system"), scored)
    actions = rows(audit, "target_id", "action", F.col("actor"), F.col("action"))
    written = rows(notes, "alert_id", "note", F.col("author"), F.col("body"))
    reviewed = rows(feedback, "alert_id", "feedback", F.coalesce("analyst", F.lit("analyst")), F.replace("label", F.lit("_"), F.lit(" ")))
    return detected.unionByName(actions).unionByName(written).unionByName(reviewed)


def latest_feedback(feedback: DataFrame) -> DataFrame:
    return latest(feedback, ["alert_id"], ["created_at", "id"]).select("alert_id", "label")


def with_feedback(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    found = latest_feedback(feedback).withColumnRenamed("label", "disposition").withColumnRenamed("alert_id", "id")
    return alerts.join(found, "id", "left")


def note_pages(notes: DataFrame, size: int = 100, hot_rows: int | None = 20_000) -> DataFrame:
    """Notes of an alert in pages of ``size`` in time order, so that no array grows with the busiest alert."""
    order = ["created_at", "id"]
    spec = {"_no": ("count", F.lit(1))}
    numbered = by_heat(
        notes, "alert_id", lambda d: running(d, ["alert_id"], order, spec),
        lambda d: running(slice_ordered(d, ["alert_id"], order), ["alert_id"], order, spec).drop(SLICE), hot_rows)
    page = F.floor((F.col("_no") - 1) / size).cast("int")
    entries = F.sort_array(F.collect_list(F.struct("created_at", "id", "author", "body")))
    return numbered.groupBy("alert_id", page.alias("page")).agg(entries.alias("notes"))


def case_files(alerts: DataFrame, notes: DataFrame, feedback: DataFrame, attributions: Column) -> DataFrame:
    """One row per alert and page of its notes (one row where there are none): latest disposition, features, attributions, the
    number of notes, ``page`` of ``pages``. No note is left out, and no array grows with the busiest alert.
    """
    pages = note_pages(notes)
    counts = pages.groupBy("alert_id").agg(
        F.sum(F.size("notes")).alias("note_count"), F.max("page").alias("last_page"))
    paged = pages.join(counts, "alert_id").withColumnRenamed("alert_id", "id")
    features = F.array(*[F.col(c).cast("double") for c in ("tx_count_5m", "tx_count_1h", "tx_count_24h", "sum_amount_1h", "device_shift")])
    out = with_feedback(alerts, feedback).join(paged, "id", "left")
    return out.select(
        "id", "transaction_id", "entity_id", "risk_score", "risk_label", "status", F.col("disposition"),
        F.coalesce("note_count", F.lit(0)).alias("note_count"), F.coalesce("page", F.lit(0)).alias("page"),
        (F.coalesce("last_page", F.lit(0)) + 1).alias("pages"), "notes", attributions.alias("attributions"), features.alias("features"))
