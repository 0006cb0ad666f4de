"""Lead queries: events stand for form submissions, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.expr import EMAIL, lisbon_day, plausible_phone, reasons, window_state
from tessera.sources.io import read_table, shared_folder
from tessera.streaming.leads import stream_daily, stream_first_by_key
from tessera.streaming.stateful import in_turn, intake

from .registry import query


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    key = F.concat("user_id", F.lit(":"), F.date_format("ts", "yyyyMMddHH"))
    payload = F.sha2(F.concat("event_type", F.lit("|"), F.col("props")).cast("binary"), 256)
    return e.select("event_id", "ts", "user_id", "event_type", "value", "props", key.alias("key"), payload.alias("payload"))


_SUB = "s AS (SELECT *, user_id || ':' || strftime(ts, '%Y%m%d%H') AS key, sha256(event_type || '|' || props) AS payload FROM events)"


_INTAKE = f"""WITH {_SUB}, f AS (SELECT key, min_by(payload, event_id) AS p, min(event_id) AS first_id FROM s GROUP BY key)
SELECT event_id, s.key, CASE WHEN event_id = first_id THEN 'first' WHEN payload = p THEN 'replay' ELSE 'conflict' END AS outcome FROM s JOIN f ON s.key = f.key"""


@query(_INTAKE)
def lead_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of a key is kept, the same payload again is a replay, another one a conflict."""
    s = submissions(spark, sf_dir)
    first = s.groupBy("key").agg(F.min("event_id").alias("first_id"), F.min_by("payload", "event_id").alias("kept"))
    outcome = F.when(F.col("event_id") == F.col("first_id"), "first").when(F.col("payload") == F.col("kept"), "replay").otherwise("conflict")
    return s.join(first, "key").select("event_id", "key", outcome.alias("outcome"))


@query("""SELECT event_id, concat_ws(',', CASE WHEN event_type NOT IN ('signup', 'purchase', 'click') THEN 'form-type' END, CASE WHEN value IS NULL OR value <= 1 THEN 'value' END,
CASE WHEN (regexp_extract(props, '"k": ([0-9]+)', 1))::INT > 90 THEN 'field-k' END) AS errors FROM events""")
def lead_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    found = reasons(("form-type", ~F.col("event_type").isin("signup", "purchase", "click")), ("value", F.col("value").isNull() | (F.col("value") <= 1)), ("field-k", k > 90))
    return read_table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", found).alias("errors"))


#: Campaign, first and last Lisbon day, form type.
CAMPAIGNS = [("spring", "2024-01-03", "2024-01-10", "click"), ("summer", "2024-01-08", "2024-01-20", "signup"), ("broken", "2024-01-09", "2024-01-01", "view")]
_CAMPAIGNS = "(VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}', '{t}')" for n, a, b, t in CAMPAIGNS) + ") c(campaign, first_day, last_day, form)"
_DAY = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Lisbon')::DATE"


@query(f"""SELECT campaign, CASE WHEN last_day < first_day THEN 'invalid' WHEN {_DAY} < first_day THEN 'upcoming' WHEN {_DAY} > last_day THEN 'ended' ELSE 'active' END AS state, count(*) AS n
FROM events JOIN {_CAMPAIGNS} ON event_type = form GROUP BY 1, 2""")
def campaign_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The campaigns are a fixed short list, so they are broadcast."""
    c = spark.createDataFrame(CAMPAIGNS, "campaign string, a string, b string, form string").select("campaign", F.to_date("a").alias("a"), F.to_date("b").alias("b"), "form")
    e = read_table(spark, sf_dir, "events").select("event_type", lisbon_day(F.col("ts")).alias("day"))
    joined = e.join(F.broadcast(c), F.col("event_type") == F.col("form"))
    return joined.groupBy("campaign", window_state(F.col("day"), F.col("a"), F.col("b")).alias("state")).agg(F.count("*").alias("n"))


@query(f"SELECT {_DAY} AS day, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def daily_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.groupBy(lisbon_day(F.col("ts")).alias("day"), "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_LEASES = """SELECT event_id, CASE WHEN gap IS NULL THEN 'claim' WHEN gap < 60 THEN 'held' WHEN gap < 82800 THEN 're-claim' ELSE 'manual' END AS state FROM
(SELECT event_id, epoch_ms(ts) // 1000 - lag(epoch_ms(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)"""


@query(_LEASES)
def lease_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a worker may do with a user's next event: 60 seconds of lease, 23 hours of retries."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000)
    gap = seconds - F.lag(seconds).over(w)
    state = F.when(gap.isNull(), "claim").when(gap < 60, "held").when(gap < 82_800, "re-claim").otherwise("manual")
    return read_table(spark, sf_dir, "events").select("event_id", state.alias("state"))


_PHONE = r"\+?[0-9][0-9 ().-]{5,18}[0-9]"
_MAIL = r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]+"


@query(rf"""WITH c AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '{_PHONE}') AS p, regexp_extract_all(text, '{_MAIL}') AS m FROM documents),
each AS (SELECT r, s LIKE '+%' OR s LIKE '00%' AS abroad, regexp_replace(regexp_replace(s, '^00', ''), '[^0-9]', '', 'g') AS d FROM (SELECT r, unnest(p) AS s FROM c)),
national AS (SELECT r, d, abroad, CASE WHEN abroad AND d LIKE '351%' THEN substr(d, 4) ELSE d END AS x FROM each),
good AS (SELECT r, count(*) AS n FROM national WHERE length(d) BETWEEN 7 AND 15 AND replace(x, x[1], '') <> ''
  AND NOT contains(repeat('0123456789', 2), x) AND NOT contains(repeat('9876543210', 2), x)
  AND NOT (abroad AND d NOT LIKE '351%' AND d[1] <> '0' AND list_bool_or(list_transform([1, 2, 3], lambda k: length(d) >= k + 7 AND replace(substr(d, k + 1), d[k + 1], '') = ''))) GROUP BY r)
SELECT doc_id, len(p)::INT AS candidates, coalesce(n, 0)::INT AS phones, len(m)::INT AS mails FROM c LEFT JOIN good USING (r) WHERE len(p) > 0 OR len(m) > 0""")
def contact_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with phone- or mail-like text: how many candidates there are, and how many hold as phones and mails."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(f"({_PHONE})"), 1).alias("p"), F.regexp_extract_all("text", F.lit(f"({_MAIL})"), 1).alias("m"))
    mails = F.filter("m", lambda x: x.rlike(EMAIL))
    return d.select("doc_id", F.size("p").alias("candidates"), F.size(F.filter("p", plausible_phone)).alias("phones"), F.size(mails).alias("mails")).filter("candidates > 0 or mails > 0")


#: Event type, language, subject, body.
TEMPLATES = [("signup", "pt", "Bem-vindo [Nome]", "Conta [Conta]"), ("purchase", "en", "Thank you [Nome]", "Order [Conta]")]


@query("""SELECT event_id, lang, replace(subject, '[Nome]', 'user ' || user_id) AS subject, replace(body, '[Conta]', event_id::VARCHAR) AS body
FROM events JOIN (VALUES ('signup', 'pt', 'Bem-vindo [Nome]', 'Conta [Conta]'), ('purchase', 'en', 'Thank you [Nome]', 'Order [Conta]')) t(kind, lang, subject, body) ON event_type = kind""")
def outbound_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame(TEMPLATES, "kind string, lang string, subject string, body string")
    joined = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").join(F.broadcast(t), F.col("event_type") == F.col("kind"))
    name = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    return joined.select("event_id", "lang", F.replace("subject", F.lit("[Nome]"), name).alias("subject"), F.replace("body", F.lit("[Conta]"), F.col("event_id").cast("string")).alias("body"))


@query(f"WITH {_SUB} SELECT DISTINCT key FROM s")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys a stream of the events lets through, each once."""
    return stream_first_by_key(spark, f"{sf_dir}/events.parquet").select("key")


@query(f"SELECT {_DAY} AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_daily(spark, f"{sf_dir}/events.parquet")


@query(_INTAKE)
def stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes of ``lead_intake`` from a stream in four micro-batches, with a sink that commits each once."""
    folder, rows = shared_folder(spark), submissions(spark, sf_dir).select("event_id", "key", "payload")
    return in_turn(rows, "event_id", 4, folder, intake)
