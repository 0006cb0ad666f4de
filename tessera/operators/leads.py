"""Judging form submissions by tables of rules, and the states of their delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.functions.expr import EMAIL, first_failing, nfc, plausible_phone, trimmed, window_state
from tessera.operators.folds import sorted_fold

#: Subjects of a contact, the campaign's questions and their answers (the first one is the plain no).
SUBJECTS = ("Comprar", "Vender", "Outro")
QUESTIONS = ("Conhece alguém que esteja a vender ou a comprar casa?", "Está a pensar vender ou a comprar casa?")
ANSWERS = ("Não", "Sim, a comprar", "Sim, a vender")
#: Greatest lengths of a route, a mail address, a message and any other field.
ROUTE_CHARS, EMAIL_CHARS, MESSAGE_CHARS, FIELD_CHARS = 200, 320, 4_000, 500
#: Seconds that a claim is held, seconds after its reservation in which a key may be claimed.
LEASE, RETRIES = 60, 82_800


def question_answers(message: Column) -> tuple[Column, Column]:
    """(valid, qualified): each question is answered once, under its exact label, by a known answer; one is not the plain no.

    Lines are cut at their first colon; labels that differ in case, white space or Unicode form count as the same question.
    """
    fold = lambda c: F.lower(trimmed(F.regexp_replace(c, r"(?U)\s+", " ")))
    lines = F.arrays_zip(F.split(message, "\r?\n").alias("raw"), F.split(nfc(message), "\r?\n").alias("plain"))
    label = lambda c: F.substring_index(c, ":", 1)
    value = lambda c: trimmed(F.substr(c, F.instr(c, ":") + 1))
    valid, qualified = F.lit(True), F.lit(False)
    for question in QUESTIONS:
        asked = fold(F.lit(question))
        same = F.filter(lines, lambda x: F.contains(x["raw"], F.lit(":")) & (fold(label(x["plain"])) == asked))  # noqa: B023
        one = F.get(same, F.lit(0))["raw"]
        valid &= (F.size(same) == 1) & (trimmed(label(one)) == question) & value(one).isin(*ANSWERS)
        qualified |= value(one) != ANSWERS[0]
    valid = F.coalesce(valid, F.lit(False))
    return valid, valid & F.coalesce(qualified, F.lit(False))


def judged(leads: DataFrame, permissions: DataFrame, form_fields: DataFrame, campaigns: DataFrame) -> DataFrame:
    """``leads`` with ``error`` (null: accepted), ``mode``, ``campaign`` and ``qualified``; the first rule that fails is the error.

    ``leads(lead_id, form_type, route, day, fields map<string,string>)``; ``permissions(form_type, route)``, repeated rows
    count once; ``form_fields(form_type, allowed)``; ``campaigns(route, title, first_day, last_day)``, one a route. A lead
    magnet may be sent from any campaign's route while it is open, and then has to answer the questions. Rows whose fields
    are null are refused; null ids stay null; an empty table gives no rows.
    """
    f = lambda name: F.col("fields")[name]
    lines = F.contains(F.col("route"), F.lit("\n")) | F.contains(F.col("route"), F.lit("\r"))
    rows = (
        leads.withColumn("route", trimmed(F.col("route")))
        .join(form_fields.select("form_type", "allowed"), "form_type", "left")
        .join(permissions.select("form_type", "route", F.lit(True).alias("_permitted")).distinct(), ["form_type", "route"], "left")
        .join(campaigns.select("route", F.col("title").alias("_title"), F.struct("first_day", "last_day").alias("_days")), "route", "left")
    )
    campaign = (F.col("form_type") == "leadMagnet") & F.col("_title").isNotNull()
    valid, qualified = question_answers(f("message"))

    def wrong(entry: Column) -> Column:
        text, message = trimmed(entry["value"]), entry["key"] == "message"
        long = F.length(text) > F.when(message, MESSAGE_CHARS).otherwise(FIELD_CHARS)
        return ~entry["key"].isin("email", "consent") & (entry["value"] != "") & ((text == "") | long | (~message & text.rlike("[\r\n]")))

    email = trimmed(f("email"))
    error = first_failing(
        ("unknown-form", F.col("allowed").isNull()),
        ("invalid-route", F.coalesce(F.col("route"), F.lit("")).isin("") | (F.length("route") > ROUTE_CHARS) | lines),
        ("route-not-allowed", F.col("_permitted").isNull() & ~F.coalesce(campaign, F.lit(False))),
        ("campaign-closed", F.col("_title").isNotNull() & (window_state(F.col("day"), F.col("_days.first_day"), F.col("_days.last_day")) != "active")),
        ("invalid-fields", F.col("fields").isNull()),
        ("unsupported-field", F.exists(F.map_keys("fields"), lambda k: ~F.array_contains("allowed", k))),
        ("consent-required", (F.col("form_type") != "newsletter") & (F.coalesce(f("consent"), F.lit("")) != "true")),
        ("invalid-email", ~F.coalesce(F.lower(email).rlike(EMAIL) & (F.length(email) <= EMAIL_CHARS) & ~f("email").rlike("[\r\n]"), F.lit(False))),
        ("invalid-name", (F.col("form_type") == "contact") & (F.coalesce(f("name"), F.lit("")) == "")),
        ("invalid-field", F.exists(F.map_entries("fields"), wrong)),
        ("invalid-phone", (F.coalesce(f("phone"), F.lit("")) != "") & ~plausible_phone(trimmed(f("phone")))),
        ("invalid-subject", (F.coalesce(f("contactSubject"), F.lit("")) != "") & ~trimmed(f("contactSubject")).isin(*SUBJECTS)),
        ("invalid-answers", campaign & ~valid),
    )
    rows = rows.withColumn("error", error).withColumn("qualified", campaign & qualified)
    mode = F.when(campaign, F.when(F.col("qualified"), "immediate-and-daily").otherwise("daily")).otherwise("individual")
    accepted = F.col("error").isNull()
    return rows.select(*leads.columns, "error", F.when(accepted, mode).alias("mode"), F.when(accepted & campaign, F.col("_title")).alias("campaign"),
                       F.when(accepted, F.coalesce("qualified", F.lit(False))).alias("qualified"))


def normalised(fields: Column) -> Column:
    """All fields as they are stored: trimmed, empty ones left out, the mail address in lower case, sorted by name."""
    pairs = F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == "email", F.lower(trimmed(e["value"]))).otherwise(trimmed(e["value"])).alias("value")))
    return F.map_from_entries(F.array_sort(F.filter(pairs, lambda e: F.coalesce(e["value"], F.lit("")) != "")))


def payload_hash(form_type: Column, route: Column, fields: Column) -> Column:
    """SHA-256 of form, route and all normalised fields as JSON, so that no field can change under one key unseen."""
    payload = F.to_json(F.struct(form_type.alias("formType"), route.alias("route"), normalised(fields).alias("fields")))
    return F.sha2(payload.cast("binary"), 256)


def lead_rows(accepted: DataFrame) -> DataFrame:
    """Accepted leads as flat rows: names and contact, the reference of a property's route, and the payload's digest."""
    f = lambda name: F.nullif(trimmed(F.col("fields")[name]), F.lit(""))
    first = F.coalesce(f("firstName"), F.nullif(F.substring_index(f("name"), " ", 1), F.lit("")), F.lit("Cliente"))
    reference = F.when(F.startswith("route", F.lit("/imoveis/")), F.substr("route", F.lit(len("/imoveis/") + 1)))
    return accepted.select("lead_id", "form_type", "route", reference.alias("property_reference"), F.lower(f("email")).alias("email"), f("phone").alias("phone"),
                           first.alias("first_name"), payload_hash(F.col("form_type"), F.col("route"), F.col("fields")).alias("payload_hash"), "mode", "campaign")


#: A key's state: payload, status, seconds of its reservation and last change, token of its claim, and how it is announced.
State = tuple[str, str, int, int, int | None, str | None]


def step(state: State | None, event_id: int, at: int, kind: str, payload: str, token: int | None, receipt: str | None, mode: str | None = None) -> tuple[State | None, str]:
    """The next state and what the event's sender is told. A claim's token is the id of the event that made it.

    ``reserve`` stores a key without a claim, ``claim`` stores it if it is new and asks for its delivery; ``accept`` and
    ``fail`` close a claim, and are ``late`` unless they carry its token; a receipt has 1 to 200 characters. The ``mode`` of
    announcement is that of the event that stored the key, whatever later ones say.
    """
    if kind in ("accept", "fail"):
        good = kind == "fail" or receipt is not None and 0 < len(receipt) <= 200
        if state is None or state[1] != "sending" or state[4] != token or not good:
            return state, "late"
        status = "accepted" if kind == "accept" else "failed"
        return (state[0], status, state[2], at, *state[4:]), status
    if state is None:
        state = (payload, "pending", at, at, None, mode)
    if state[0] != payload:
        return state, "conflict"
    if kind == "reserve" or state[1] == "accepted":
        return state, "accepted" if state[1] == "accepted" else "reserved"
    young = state[2] >= at - RETRIES
    if young and (state[1] == "pending" or state[3] <= at - LEASE):
        return (payload, "sending", state[2], at, event_id, state[5]), "claimed"
    return state, "manual" if state[1] == "pending" else "sending"


#: What an event of a delivery carries, in the order that ``step`` takes it, and what its sender is told.
EVENT = ("event_id", "at", "kind", "payload", "token", "receipt", "mode")
TOLD = StructType([StructField("event_id", LongType()), StructField("outcome", StringType()), StructField("mode", StringType())])


def told(state: State | None, event: tuple) -> tuple[State | None, tuple]:
    """``step`` on an event's values; a claim that is granted is told the mode that was stored with its key."""
    state, outcome = step(state, *event)
    return state, (event[0], outcome, state[5] if outcome == "claimed" else None)


def lease_outcomes(events: DataFrame) -> DataFrame:
    """``event_id, outcome, mode`` of ``events(key, event_id, at, kind, payload, token, receipt, mode)``, each key's by (at, event_id).

    ``mode`` is told with granted claims only. Null keys are one key; an empty table gives no rows.
    """
    return sorted_fold(events.select("key", *EVENT), "key", ["at", "event_id"], lambda state, row: told(state, row[1:]), TOLD)
