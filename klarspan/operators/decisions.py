"""Decisions on packages and their effects: facts, truths, clarifications, tickets and page patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an action makes of a package and of its facts.
PACKAGE_STATE = {"accept": "accepted", "reject": "rejected", "specify": "specified"}
FACT_STATE = {"accept": "confirmed", "reject": "superseded", "specify": "confirmed"}
CAPTURED, MESSAGES = 0.80, 10


def _mapped(table: dict[str, str], column: str) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def valid(decisions: DataFrame) -> DataFrame:
    """Known actions; `specify` needs a comment."""
    return decisions.where(F.col("action").isin(*PACKAGE_STATE) & ((F.col("action") != "specify") | (F.trim(F.coalesce("comment", F.lit(""))) != "")))


def package_states(packages: DataFrame, decisions: DataFrame) -> DataFrame:
    """package, state: what its last valid decision says, else open."""
    last = valid(decisions).groupBy("package").agg(F.max_by("action", "ord").alias("action"), F.count("*").alias("n_decisions"))
    return packages.select("package").distinct().join(last, "package", "left").select("package", F.coalesce(_mapped(PACKAGE_STATE, "action"), F.lit("open")).alias("state"), F.coalesce("n_decisions", F.lit(0)).alias("n_decisions"))


def synced_facts(facts: DataFrame, members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Facts (fact_key, status) after the decisions on the packages they are members of (package, fact_key): the last
    valid one counts; other facts keep their status."""
    last = valid(decisions).join(members.distinct(), "package").groupBy("fact_key").agg(F.max_by("action", "ord").alias("action"))
    return facts.join(last, "fact_key", "left").select("fact_key", F.coalesce(_mapped(FACT_STATE, "action"), F.col("status")).alias("status"), F.when(F.col("action").isNotNull(), "package_decision").alias("status_source"))


def synced_packages(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Packages with the numbers of their facts in each status; done if none is open."""
    known = facts.select("fact_key", "status").dropDuplicates(["fact_key"])
    counts = members.distinct().join(known, "fact_key").groupBy("package").agg(F.count_if(F.col("status") == "open").alias("n_open"), F.count("*").alias("n_facts"))
    return counts.withColumn("done", F.col("n_open") == 0)


def truth_conflicts(truths: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Active truths that stand against a new one (canonical_key, new_value) of the same key."""
    return truths.where("truth_status = 'active'").join(confirmed, "canonical_key").select("truth_ord", "canonical_key", "normalized_value", "new_value", (F.col("normalized_value") != F.col("new_value")).alias("differs"))


def clarifications(events: DataFrame) -> DataFrame:
    """Threads from their events (thread_id, ord, kind): confirming, superseding and dismissing close a thread, the first
    of them decides; captured messages, at most MESSAGES, count as an indication of confidence CAPTURED."""
    closing = F.col("kind").isin("confirm", "supersede", "dismiss")
    g = events.groupBy("thread_id").agg(F.min_by("kind", F.when(closing, F.col("ord"))).alias("closed_by"), F.min(F.when(closing, F.col("ord"))).alias("closed_at"), F.count_if(F.col("kind") == "answer").alias("answers"), F.count_if(F.col("kind") == "capture").alias("captured"))
    state = F.when(F.col("closed_at").isNotNull(), F.col("closed_by")).when(F.col("answers") > 0, "answered").otherwise("open")
    return g.select("thread_id", state.alias("state"), "answers", F.least(F.col("captured"), F.lit(MESSAGES)).alias("messages"), F.when(F.col("captured") > 0, CAPTURED).alias("confidence"))


def ticket_payloads(findings: DataFrame, most: int = 4) -> DataFrame:
    """package, payload: a ticket of each package as JSON, from its first findings (place, title, severity, object_key)."""
    first = findings.withColumn("nr", F.row_number().over(Window.partitionBy("package").orderBy("place"))).where(F.col("nr") <= most)
    rows = F.array_sort(F.collect_list(F.struct("nr", "title", "severity", "object_key")))
    out = first.groupBy("package").agg(rows.alias("r"))
    payload = F.struct(F.get("r", F.lit(0))["title"].alias("title"), F.get("r", F.lit(0))["severity"].alias("severity"), F.array_distinct(F.transform("r", lambda x: x["object_key"])).alias("affected"), F.size("r").alias("n"))
    return out.select("package", F.to_json(payload).alias("payload"))


def patched(pages: DataFrame) -> DataFrame:
    """Pages (html, heading, insertion, marker) with the insertion behind the heading's end tag, or at the end if there is
    no such heading; a page that holds the marker stays as it is."""
    at = F.instr("html", F.concat(F.lit(">"), "heading", F.lit("</h")))
    end = at + F.length("heading") + 5  # up to the end of </hN>
    inside = F.concat(F.left("html", end), F.col("insertion"), F.substr("html", end + 1))
    out = F.when(F.contains("html", F.col("marker")), F.col("html")).when(at > 0, inside).otherwise(F.concat("html", "insertion"))
    return pages.withColumn("patched", out).withColumn("mode", F.when(F.contains("html", F.col("marker")), "present").when(at > 0, "inserted").otherwise("appended"))


def dialog_truths(truths: DataFrame, events: DataFrame) -> DataFrame:
    """What confirmations and replacements of a dialog make of truths.

    ``truths`` (canonical_key, normalized_value, truth_status) are those before it, ``events`` (ord, thread_id, kind,
    canonical_key, value) its steps; kinds other than confirm and supersede, and steps without a key, change no truth. A key
    has a truth from the start, or from its first confirmation on. Confirming makes a truth where there is none, else it is a
    conflict; superseding replaces the truth there is, else it is rejected. One row a step, with its outcome, and for steps
    that made a truth whether it still stands. Steps of equal ``ord`` count as one moment."""
    steps = events.where(F.col("kind").isin("confirm", "supersede") & F.col("canonical_key").isNotNull())
    before = truths.where("truth_status = 'active'").select("canonical_key").distinct().withColumn("held", F.lit(True))
    first = steps.groupBy("canonical_key").agg(F.min(F.when(F.col("kind") == "confirm", F.col("ord"))).alias("first"))
    held = F.coalesce(F.col("held"), F.lit(False)) | F.coalesce(F.col("first") < F.col("ord"), F.lit(False))
    outcome = F.when(F.col("kind") == "confirm", F.when(held, "conflict").otherwise("created")).otherwise(F.when(held, "superseded").otherwise("rejected"))
    told = steps.join(before, "canonical_key", "left").join(first, "canonical_key").withColumn("outcome", outcome)
    made = F.col("outcome").isin("created", "superseded")
    last = told.where(made).groupBy("canonical_key").agg(F.max("ord").alias("last"))
    status = F.when(made, F.when(F.col("ord") == F.col("last"), "active").otherwise("superseded"))
    return told.join(last, "canonical_key", "left").select("ord", "thread_id", "canonical_key", "kind", "value", "outcome", status.alias("truth_status"))


def captured_indications(events: DataFrame) -> DataFrame:
    """Claims (source_id, predicate, value, confidence, fingerprint) of captured messages (thread_id, ord, kind, content): what
    the capture says, or, if it says nothing, the thread's latest answer before it; without either there is no claim."""
    said = F.nullif(F.trim("content"), F.lit(""))
    upto = Window.partitionBy("thread_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("said", said).withColumn("earlier", F.last(F.when(F.col("kind") == "answer", F.col("said")), True).over(upto))
    rows = rows.where("kind = 'capture'").withColumn("value", F.coalesce("said", "earlier")).where("value IS NOT NULL")
    source = F.concat_ws(":", F.lit("clarification"), F.col("thread_id").cast("string"))
    return rows.select(source.alias("source_id"), "ord", F.lit("user_indication").alias("predicate"), "value", F.lit(CAPTURED).alias("confidence"), F.concat_ws(":", source, F.left("value", F.lit(50))).alias("fingerprint"))
