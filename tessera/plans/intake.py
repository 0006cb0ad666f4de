"""Lead intake queries: documents stand for submissions, events for their deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.leads import ANSWERS, QUESTIONS, judged, lease_outcomes, lead_rows
from tessera.sources.io import read_table, shared_folder
from tessera.streaming.leads import stream_lead_split
from tessera.streaming.stateful import in_turn, leases

from .registry import query

#: The fields that a form may have.
COMMON = ("firstName", "lastName", "name", "email", "phone", "message", "consent")
FIELDS = {
    "newsletter": ("email", "firstName", "lastName"),
    "contact": (*COMMON, "contactSubject"),
    "valuation": (*COMMON, "propertyType", "bedrooms", "location"),
    "mortgage": COMMON,
    "partnership": (*COMMON, "clientType"),
    "leadMagnet": COMMON,
}
PERMISSIONS = [("newsletter", "/blog"), ("contact", "/vamos-comecar"), ("valuation", "/estudo-de-mercado"), ("leadMagnet", "/dossier"), ("contact", "/dossier")]
#: Route, title, first and last day.
CAMPAIGNS = [("/lp/spring", "Spring", "2024-01-03", "2024-01-20"), ("/lp/autumn", "Autumn", "2024-01-10", "2024-01-25")]
_FORMS = ("newsletter", "contact", "valuation", "leadMagnet", "leadMagnet", "other")
_ROUTES = ("/blog", "/vamos-comecar", "/estudo-de-mercado", "/lp/spring", "/lp/autumn", "/dossier", "/imoveis/item-3")
_MAIL = r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]+"


def leads_of(documents: DataFrame) -> DataFrame:
    """A submission a document: its first mail address, answers by id, an unplanned field in one of thirteen."""
    n = F.col("doc_id")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    mail = F.when(n % 4 == 0, F.regexp_extract("text", f"({_MAIL})", 1)).otherwise(F.concat(F.lit(" User"), n, F.lit("@Example.org ")))
    phone = F.when(n % 9 == 0, "123456789").otherwise(F.concat(F.lit("+351 9"), F.lpad((n * 7919 % 10_000_000).cast("string"), 8, "0")))
    asked = [F.concat(F.when(n % 8 == 3, F.upper(F.lit(q))).otherwise(q), F.lit(": "), pick((*ANSWERS, "Talvez"), F.floor(n / d))) for d, q in zip((3, 7), QUESTIONS, strict=True)]
    name = F.when(n % 10 == 1, "").otherwise(F.concat(F.lit("Ana "), n))
    base = F.map_from_arrays(F.array(F.lit("email")), F.array(mail))
    more = F.map_from_arrays(F.array(*map(F.lit, ("name", "phone", "message", "consent"))), F.array(name, phone, F.concat_ws("\n", *asked), F.when(n % 12 == 5, "false").otherwise("true")))
    extra = F.when(n % 13 == 0, F.map_from_arrays(F.array(F.lit("utm")), F.array(F.lit("x")))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    form = pick(_FORMS, n)
    fields = F.map_concat(base, F.when(form != "newsletter", more).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), extra)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 29).cast("int"))
    return documents.select(n.alias("lead_id"), form.alias("form_type"), pick(_ROUTES, F.floor(n / 2)).alias("route"), day.alias("day"), fields.alias("fields"))


def judge(leads: DataFrame) -> DataFrame:
    """``leads`` by the tables above and the routes of properties, from which contacts and newsletters may be sent."""
    spark = leads.sparkSession
    items = spark.range(10).select(F.explode(F.array(F.lit("contact"), F.lit("newsletter"))).alias("form_type"), F.concat(F.lit("/imoveis/item-"), F.col("id").cast("string")).alias("route"))
    permissions = spark.createDataFrame(PERMISSIONS, "form_type string, route string").unionByName(items)
    fields = spark.createDataFrame([*FIELDS.items()], "form_type string, allowed array<string>")
    campaigns = spark.createDataFrame(CAMPAIGNS, "route string, title string, a string, b string").select("route", "title", F.to_date("a").alias("first_day"), F.to_date("b").alias("last_day"))
    return judged(leads, permissions, fields, campaigns)


_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_JUDGED = f"""l AS (SELECT doc_id AS n, {_LIST(_FORMS)}[doc_id % 6 + 1] AS form, {_LIST(_ROUTES)}[doc_id // 2 % 7 + 1] AS route, DATE '2024-01-01' + (doc_id % 29)::INT AS day,
  lower(trim(CASE WHEN doc_id % 4 = 0 THEN regexp_extract(text, '{_MAIL}') ELSE ' User' || doc_id || '@Example.org ' END)) AS email,
  {_LIST((*ANSWERS, "Talvez"))}[doc_id // 3 % 4 + 1] AS a1, {_LIST((*ANSWERS, "Talvez"))}[doc_id // 7 % 4 + 1] AS a2,
  CASE WHEN doc_id % 10 = 1 THEN '' ELSE 'Ana ' || doc_id END AS name,
  CASE WHEN doc_id % 9 = 0 THEN '123456789' ELSE '+351 9' || lpad((doc_id * 7919 % 10000000)::VARCHAR, 8, '0') END AS phone FROM documents),
c AS (SELECT *, form = 'leadMagnet' AND route LIKE '/lp/%' AS campaign FROM l),
j AS (SELECT *, CASE WHEN form = 'other' THEN 'unknown-form'
  WHEN NOT campaign AND NOT ((form, route) IN (('newsletter', '/blog'), ('contact', '/vamos-comecar'), ('valuation', '/estudo-de-mercado'), ('leadMagnet', '/dossier'), ('contact', '/dossier'))
    OR (form IN ('contact', 'newsletter') AND route LIKE '/imoveis/%')) THEN 'route-not-allowed'
  WHEN route = '/lp/spring' AND day NOT BETWEEN '2024-01-03' AND '2024-01-20' OR route = '/lp/autumn' AND day NOT BETWEEN '2024-01-10' AND '2024-01-25' THEN 'campaign-closed'
  WHEN n % 13 = 0 THEN 'unsupported-field' WHEN form <> 'newsletter' AND n % 12 = 5 THEN 'consent-required'
  WHEN email NOT SIMILAR TO '[^@\\s]+@[^@\\s]+\\.[^@\\s]+' THEN 'invalid-email' WHEN form = 'contact' AND name = '' THEN 'invalid-name'
  WHEN form <> 'newsletter' AND n % 9 = 0 THEN 'invalid-phone' WHEN campaign AND (n % 8 = 3 OR a1 = 'Talvez' OR a2 = 'Talvez') THEN 'invalid-answers' END AS error FROM c)"""
_TITLE = "CASE WHEN error IS NULL AND campaign THEN CASE route WHEN '/lp/spring' THEN 'Spring' ELSE 'Autumn' END END"
_MODE = "CASE WHEN error IS NULL THEN CASE WHEN NOT campaign THEN 'individual' WHEN a1 <> 'Não' OR a2 <> 'Não' THEN 'immediate-and-daily' ELSE 'daily' END END"


@query(f"WITH {_JUDGED} SELECT n AS lead_id, error, {_MODE} AS mode, {_TITLE} AS campaign FROM j")
def lead_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each submission breaks, or how its delivery is announced."""
    return judge(leads_of(read_table(spark, sf_dir, "documents"))).select("lead_id", "error", "mode", "campaign")


@query(f"""WITH {_JUDGED}, m AS (SELECT *, {_MODE} AS mode, CASE WHEN n % 8 = 3 THEN upper('{QUESTIONS[0]}') ELSE '{QUESTIONS[0]}' END || ': ' || a1 || chr(10)
  || CASE WHEN n % 8 = 3 THEN upper('{QUESTIONS[1]}') ELSE '{QUESTIONS[1]}' END || ': ' || a2 AS message FROM j WHERE error IS NULL)
SELECT n AS lead_id, form AS form_type, route, CASE WHEN route LIKE '/imoveis/%' THEN substr(route, 10) END AS property_reference, email, CASE WHEN form <> 'newsletter' THEN phone END AS phone,
CASE WHEN form = 'newsletter' OR name = '' THEN 'Cliente' ELSE 'Ana' END AS first_name, mode, {_TITLE.replace("error IS NULL AND ", "")} AS campaign,
sha256('{{"formType":"' || form || '","route":"' || route || '","fields":{{' || CASE WHEN form = 'newsletter' THEN '"email":"' || email || '"' ELSE
  '"consent":"true","email":"' || email || '","message":"' || replace(message, chr(10), '\\n') || '"' || CASE WHEN name = '' THEN '' ELSE ',"name":"' || name || '"' END || ',"phone":"' || phone || '"' END || '}}}}') AS payload_hash FROM m""")
def accepted_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submissions that hold, as rows of the lead table."""
    return lead_rows(judge(leads_of(read_table(spark, sf_dir, "documents"))).filter("error is null"))


@query(f"WITH {_JUDGED} SELECT coalesce(error, 'accepted') AS verdict, count(*) AS n FROM j GROUP BY 1")
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of submissions, accepted ones and refused ones to two sinks; how many of each kind there are."""
    accepted, refused = stream_lead_split(spark, f"{sf_dir}/documents.parquet", lambda rows: judge(leads_of(rows)))
    return accepted.select(F.lit("accepted").alias("verdict")).unionAll(refused.select(F.col("error").alias("verdict"))).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"WITH {_JUDGED} SELECT form AS form_type, day, count(*) AS n, count(*) FILTER (error IS NULL) AS accepted FROM j GROUP BY 1, 2")
def leads_by_form_and_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(leads_of(read_table(spark, sf_dir, "documents")))
    return rows.groupBy("form_type", "day").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("accepted"))


#: How a campaign's leads may be announced.
MODES = ("individual", "daily", "immediate-and-daily")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and day as those of a key; who accepts or fails carries the token of the last attempt before."""
    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "claim", "signup", "claim", "view", "reserve", "purchase", "accept", "error", "fail")]), F.col("event_type"))
    w = Window.partitionBy("key").orderBy("at", "event_id")
    rows = e.select(F.concat_ws(":", "user_id", F.date_format("ts", "yyyyMMdd")).alias("key"), "event_id", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("at"),
                    F.coalesce(kind, F.lit("claim")).alias("kind"), F.when(k % 10 == 0, "b").otherwise("a").alias("payload"), F.when(k % 5 != 1, F.concat(F.lit("r"), k)).alias("receipt"),
                    F.element_at(F.array(*map(F.lit, MODES)), F.pmod(k, F.lit(3)) + 1).alias("mode"))
    return rows.withColumn("token", F.when(F.col("kind").isin("accept", "fail"), F.last(F.when(F.col("kind") == "claim", F.col("event_id")), ignorenulls=True).over(w)))


_MACHINE = """WITH RECURSIVE e AS (SELECT user_id || ':' || strftime(ts, '%Y%m%d') AS key, event_id, epoch_ms(ts) // 1000 AS sec, (regexp_extract(props, '"k": ([0-9]+)', 1))::INT AS k,
  CASE event_type WHEN 'view' THEN 'reserve' WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'fail' ELSE 'claim' END AS kind FROM events),
o AS (SELECT *, row_number() OVER w AS i, last_value(CASE WHEN kind = 'claim' THEN event_id END IGNORE NULLS) OVER w AS token, CASE WHEN k % 10 = 0 THEN 'b' ELSE 'a' END AS payload,
  kind IN ('claim', 'reserve') AS opens FROM e WINDOW w AS (PARTITION BY key ORDER BY sec, event_id)),
f AS (SELECT key, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS p, 'none' AS status, 0::BIGINT AS born, 0::BIGINT AS changed, NULL::BIGINT AS holder, NULL::VARCHAR AS mode, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT key FROM o)
UNION ALL SELECT key, i, event_id, p, CASE outcome WHEN 'claimed' THEN 'sending' WHEN 'accepted' THEN 'accepted' WHEN 'failed' THEN 'failed' ELSE status END, born,
  CASE WHEN outcome IN ('claimed', 'failed') OR (outcome = 'accepted' AND kind = 'accept') THEN sec ELSE changed END, CASE WHEN outcome = 'claimed' THEN event_id ELSE holder END, mode, outcome
FROM (SELECT *, CASE
    WHEN NOT opens THEN CASE WHEN status <> 'sending' OR holder IS DISTINCT FROM token OR (kind = 'accept' AND k % 5 = 1) THEN 'late' WHEN kind = 'accept' THEN 'accepted' ELSE 'failed' END
    WHEN p <> payload THEN 'conflict' WHEN status = 'accepted' THEN 'accepted' WHEN kind = 'reserve' THEN 'reserved'
    WHEN born >= sec - 82800 AND (status = 'pending' OR changed <= sec - 60) THEN 'claimed' WHEN status = 'pending' THEN 'manual' ELSE 'sending' END AS outcome
  FROM (SELECT o.key, o.i, o.event_id, o.sec, o.k, o.kind, o.token, o.payload, o.opens, f.holder, CASE WHEN f.status = 'none' AND o.opens THEN ['individual', 'daily', 'immediate-and-daily'][o.k % 3 + 1] ELSE f.mode END AS mode, CASE WHEN f.status = 'none' AND o.opens THEN o.payload ELSE f.p END AS p,
      CASE WHEN f.status = 'none' AND o.opens THEN 'pending' ELSE f.status END AS status, CASE WHEN f.status = 'none' AND o.opens THEN o.sec ELSE f.born END AS born,
      CASE WHEN f.status = 'none' AND o.opens THEN o.sec ELSE f.changed END AS changed FROM o JOIN f ON o.key = f.key AND o.i = f.i + 1)))"""
_TOLD = f"{_MACHINE} SELECT event_id, outcome, CASE WHEN outcome = 'claimed' THEN mode END AS mode FROM f WHERE i > 0"


@query(f"{_MACHINE} SELECT event_id, outcome FROM f WHERE i > 0")
def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every attempt, acceptance and failure is told by a lease guarded by tokens."""
    return lease_outcomes(deliveries(spark, sf_dir)).select("event_id", "outcome")


@query(_TOLD)
def delivery_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with how a granted claim is announced: as the key's first event had it, whatever later ones say."""
    return lease_outcomes(deliveries(spark, sf_dir))


@query(_TOLD)
def stream_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream in four micro-batches, whose state is what was reserved, the claim, and timers."""
    folder, rows = shared_folder(spark), deliveries(spark, sf_dir)
    return in_turn(rows, "at", 4, folder, leases)
