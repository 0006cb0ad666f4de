"""Submissions and deliveries on fixtures of their own."""

import datetime

import pytest

from tessera.operators.leads import QUESTIONS, judged, lead_rows, lease_outcomes

DAY = datetime.date(2024, 1, 5)
YES = f"{QUESTIONS[0]}: Não\n{QUESTIONS[1]}: Sim, a vender"
GOOD = {"email": "a@b.pt", "name": "Ana", "phone": "912345678", "consent": "true"}


def magnet(message, **more):
    return ("leadMagnet", "/lp/spring", DAY, GOOD | {"message": message} | more)


CASES = [
    (("contact", "/c", DAY, GOOD), (None, "individual")),
    (("contact", "  /c ", DAY, GOOD), (None, "individual")),
    (("nothing", "/c", DAY, GOOD), ("unknown-form", None)),
    ((None, "/c", DAY, GOOD), ("unknown-form", None)),
    (("contact", None, DAY, GOOD), ("invalid-route", None)),
    (("contact", "/x\n/c", DAY, GOOD), ("invalid-route", None)),
    (("contact", "/x", DAY, GOOD), ("route-not-allowed", None)),
    (("contact", "/lp/spring", DAY, GOOD), ("route-not-allowed", None)),
    (("contact", "/c", DAY, None), ("invalid-fields", None)),
    (("contact", "/c", DAY, GOOD | {"utm": "1"}), ("unsupported-field", None)),
    (("contact", "/c", DAY, GOOD | {"consent": "yes"}), ("consent-required", None)),
    (("contact", "/c", DAY, GOOD | {"email": "a b@c.pt"}), ("invalid-email", None)),
    (("contact", "/c", DAY, GOOD | {"email": "a\tb@c.pt"}), ("invalid-email", None)),
    (("contact", "/c", DAY, GOOD | {"email": "a\nb@c.pt"}), ("invalid-email", None)),
    (("contact", "/c", DAY, GOOD | {"email": "a@c.pt\n"}), ("invalid-email", None)),
    (("contact", "/c", DAY, GOOD | {"email": "a\u00a0b@c.pt"}), ("invalid-email", None)),
    (("contact", "/c", DAY, GOOD | {"email": "a@" + "b" * 320 + ".pt"}), ("invalid-email", None)),
    (("contact", "/c", DAY, GOOD | {"name": ""}), ("invalid-name", None)),
    (("contact", "/c", DAY, GOOD | {"lastName": "a\nb"}), ("invalid-field", None)),
    (("contact", "/c", DAY, GOOD | {"lastName": " "}), ("invalid-field", None)),
    (("contact", "/c", DAY, GOOD | {"message": "x" * 4001}), ("invalid-field", None)),
    (("contact", "/c", DAY, GOOD | {"message": "x\n" * 2000}), (None, "individual")),
    (("contact", "/c", DAY, GOOD | {"phone": "123456789"}), ("invalid-phone", None)),
    (("contact", "/c", DAY, GOOD | {"contactSubject": "x"}), ("invalid-subject", None)),
    (magnet(YES), (None, "immediate-and-daily")),
    (magnet(YES.replace("Sim, a vender", "Não")), (None, "daily")),
    (magnet(YES.replace("Sim, a vender", "talvez")), ("invalid-answers", None)),
    (magnet(YES + "\n" + QUESTIONS[1].upper() + ": Não"), ("invalid-answers", None)),
    (magnet(YES.upper()), ("invalid-answers", None)),
    (magnet(YES.replace("ém", "ém")), ("invalid-answers", None)),
    (magnet(""), ("invalid-answers", None)),
    (("leadMagnet", "/lp/spring", datetime.date(2024, 2, 5), GOOD), ("campaign-closed", None)),
]


def test_judgements(spark):
    allowed = ["name", "firstName", "lastName", "email", "phone", "message", "consent", "contactSubject"]
    leads = spark.createDataFrame([(i, *case) for i, (case, _) in enumerate(CASES)], "lead_id long, form_type string, route string, day date, fields map<string,string>")
    permissions = spark.createDataFrame([("contact", "/c"), ("contact", "/c")], "form_type string, route string")
    forms = spark.createDataFrame([("contact", allowed), ("leadMagnet", allowed)], "form_type string, allowed array<string>")
    campaigns = spark.createDataFrame([("/lp/spring", "Spring", DAY, DAY)], "route string, title string, first_day date, last_day date")
    got = {r.lead_id: (r.error, r.mode) for r in judged(leads, permissions, forms, campaigns).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


DELIVERIES = {
    "claim, accept, retry, other payload": [(0, "claim", "a", None, None, "claimed"), (5, "accept", "a", 0, "r", "accepted"), (9, "claim", "a", None, None, "accepted"), (9, "claim", "b", None, None, "conflict")],
    "held, then taken over; the late worker": [(0, "claim", "a", None, None, "claimed"), (59, "claim", "a", None, None, "sending"), (60, "claim", "a", None, None, "claimed"), (61, "accept", "a", 0, "r", "late"), (62, "accept", "a", 2, "r", "accepted")],
    "failed, again after the lease": [(0, "claim", "a", None, None, "claimed"), (1, "fail", "a", 0, None, "failed"), (2, "claim", "a", None, None, "sending"), (61, "claim", "a", None, None, "claimed")],
    "no receipt": [(0, "claim", "a", None, None, "claimed"), (1, "accept", "a", 0, "", "late"), (2, "accept", "a", 0, "x" * 201, "late"), (3, "accept", "a", 0, None, "late"), (4, "accept", "a", 0, "x", "accepted")],
    "too old without a claim": [(0, "reserve", "a", None, None, "reserved"), (82_801, "claim", "a", None, None, "manual")],
    "just young enough": [(0, "reserve", "a", None, None, "reserved"), (82_800, "claim", "a", None, None, "claimed")],
    "too old after a claim": [(0, "claim", "a", None, None, "claimed"), (90_000, "claim", "a", None, None, "sending")],
    "nothing to accept": [(0, "accept", "a", None, "r", "late")],
    None: [(0, "claim", "a", None, None, "claimed")],
}


@pytest.mark.parametrize("copies", [1, 40])
def test_deliveries(spark, copies):
    """One key's events in order, whatever other keys its partition holds."""
    rows, want = [], {}
    for c in range(copies):
        for key, events in DELIVERIES.items():
            if key is None and c:
                continue
            first = len(rows)
            for at, kind, payload, token, receipt, outcome in events:
                want[len(rows)] = outcome
                rows.append((None if key is None else f"{key} {c}", len(rows), at, kind, payload, None if token is None else first + token, receipt, None))
    schema = "key string, event_id long, at long, kind string, payload string, token long, receipt string, mode string"
    assert {r.event_id: r.outcome for r in lease_outcomes(spark.createDataFrame(rows, schema)).collect()} == want
    assert lease_outcomes(spark.createDataFrame([], schema)).count() == 0


def test_ids_past_doubles(spark):
    big = 2**53
    rows = [("a", big + 1, 0, "claim", "p", None, None, None), ("a", big + 2, 1, "accept", "p", big + 1, "r", None)]
    got = lease_outcomes(spark.createDataFrame(rows, "key string, event_id long, at long, kind string, payload string, token long, receipt string, mode string"))
    assert {r.event_id: r.outcome for r in got.collect()} == {big + 1: "claimed", big + 2: "accepted"}


def test_payload_hash_covers_all_fields(spark):
    fields = [GOOD | {"propertyType": "casa"}, GOOD | {"propertyType": "terreno"}, GOOD | {"propertyType": " casa ", "location": ""}, dict(reversed((GOOD | {"propertyType": "casa"}).items()))]
    rows = spark.createDataFrame([(i, "valuation", "/v", x, None, None) for i, x in enumerate(fields)], "lead_id long, form_type string, route string, fields map<string,string>, mode string, campaign string")
    h = {r.lead_id: r.payload_hash for r in lead_rows(rows).collect()}
    assert h[0] == h[2] == h[3] != h[1]
