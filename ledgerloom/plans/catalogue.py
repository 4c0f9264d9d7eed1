"""The operators as queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendars, scalars
from ..functions.parts import gathered, parts_of
from ..operators import arrivals, attribution, audit, board, mapping, projection, recon, scoring, slots, valuedate

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "1998-06-15"
HOLIDAYS = {"MAIN": [("1995-12-25", "Christmas"), ("1996-01-01", "New Year"), ("1996-12-25", "Christmas"), ("1997-01-01", "New Year"), ("1998-01-01", "New Year"), ("1998-06-12", "Bank day")]}
FIRST, LAST = "1994-11-01", "2002-03-01"
#: DuckDB's counterpart of ``calendar_days``.
DAYS_SQL = """
closed(day, holiday) AS (VALUES {}),
raw AS (SELECT d::DATE AS day FROM generate_series(DATE '1994-11-01', DATE '2002-03-01', INTERVAL 1 DAY) g(d)),
open_days AS (SELECT raw.day, (isodow(raw.day) < 6 AND c.day IS NULL) AS is_business FROM raw LEFT JOIN closed c ON raw.day = c.day),
days AS (SELECT day, is_business, sum(is_business::INT) OVER (ORDER BY day) AS seq,
           max(CASE WHEN is_business THEN day END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_day
         FROM open_days)""".format(", ".join(f"(DATE '{d}', '{n}')" for d, n in HOLIDAYS["MAIN"]))

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(spark: SparkSession) -> DataFrame:
    return calendars.calendar_days(spark, HOLIDAYS, FIRST, LAST)


# ---- reconciliation


def order_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and their lines summed, as two sides; half of the orders are in cents off by the line taxes."""
    cents = lambda c: F.round(c, 2).cast("decimal(28,8)")
    none = F.lit(None).cast("decimal(28,8)")
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    parts = parts_of(line)
    a = o.select(
        F.col("o_orderkey").cast("string").alias("join_key"), F.lit(None).cast("decimal(28,8)").alias("quantity"), none.alias("trade_price"),
        none.alias("settlement_price"), none.alias("gross_amount"), cents(F.col("o_totalprice")).alias("net_amount"),
        none.alias("market_value"), F.when(F.col("o_orderstatus") == "F", "USD").alias("currency"),
    )
    b = gathered(line.withColumn("join_key", F.col("l_orderkey").cast("string")), parts, "join_key").groupBy("join_key").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(28,8)").alias("q"),
        F.sum(F.round(F.col("l_extendedprice"), 2).cast("decimal(18,2)")).cast("decimal(28,8)").alias("n"),
    )
    b = b.select(
        "join_key", F.col("q").alias("quantity"), none.alias("trade_price"),
        none.alias("settlement_price"), none.alias("gross_amount"), F.col("n").alias("net_amount"), none.alias("market_value"), F.lit("USD").alias("currency"),
    )
    return gathered(a, parts, "join_key"), b


SIDES_SQL = """
a AS (SELECT o_orderkey::VARCHAR AS k, round(o_totalprice, 2)::DECIMAL(28,8) AS n, CASE WHEN o_orderstatus = 'F' THEN 'USD' END AS c FROM orders),
b AS (SELECT l_orderkey::VARCHAR AS k, sum(l_quantity::DECIMAL(18,2))::DECIMAL(28,8) AS q,
             sum(round(l_extendedprice, 2)::DECIMAL(18,2))::DECIMAL(28,8) AS n, 'USD' AS c FROM lineitem GROUP BY 1),
m AS (SELECT a.k, b.q, a.n AS n1, b.n AS n2, a.c AS c1, b.c AS c2 FROM a JOIN b ON a.k = b.k)"""


@query(f"""WITH {SIDES_SQL}
SELECT 'MISSING_SIDE_2' AS kind, k AS join_key, '' AS field_name, '' AS side_1_value, '' AS side_2_value FROM a WHERE k NOT IN (SELECT k FROM b)
UNION ALL SELECT 'MISSING_SIDE_1', k, '', '', '' FROM b WHERE k NOT IN (SELECT k FROM a)
UNION ALL SELECT 'VALUE_MISMATCH', k, 'quantity', '', q::VARCHAR FROM m
UNION ALL SELECT 'VALUE_MISMATCH', k, 'net_amount', n1::VARCHAR, n2::VARCHAR FROM m WHERE abs(n1 - n2) > 0.01
UNION ALL SELECT 'VALUE_MISMATCH', k, 'currency', coalesce(c1, ''), c2 FROM m WHERE coalesce(c1, '') <> c2""")
def recon_breaks(spark, sf_dir):
    """JOIN-01, CLS-14."""
    return recon.breaks(*order_sides(spark, sf_dir))


@query(f"""WITH {SIDES_SQL}
SELECT 'MISSING_SIDE_2' AS kind, k AS join_key FROM a WHERE k NOT IN (SELECT k FROM b)
UNION ALL SELECT 'MISSING_SIDE_1', k FROM b WHERE k NOT IN (SELECT k FROM a)""")
def recon_missing_sides(spark, sf_dir):
    """JOIN-02, SET-01."""
    return recon.missing_sides(*order_sides(spark, sf_dir))


@query(f"WITH {SIDES_SQL} SELECT count(*) AS matched FROM (SELECT k FROM a INTERSECT SELECT k FROM b)")
def recon_matched_count(spark, sf_dir):
    """JOIN-03, SET-02."""
    return recon.matched(*order_sides(spark, sf_dir))


@query("""SELECT l_orderkey || '|' || l_linenumber AS join_key, l_partkey, l_quantity, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) = 1""")
def recon_last_wins(spark, sf_dir):
    """JOIN-01: of rows with one key the last counts."""
    keyed = recon.with_key(read(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))
    order = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return recon.last_per_key(keyed, order).select("join_key", "l_partkey", "l_quantity", "l_extendedprice")


@query(f"""WITH {SIDES_SQL}, f AS (
SELECT 'MISSING_SIDE_2' AS kind, k FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'MISSING_SIDE_1', k FROM b WHERE k NOT IN (SELECT k FROM a)
UNION ALL SELECT 'VALUE_MISMATCH', k FROM m UNION ALL SELECT 'VALUE_MISMATCH', k FROM m WHERE abs(n1 - n2) > 0.01
UNION ALL SELECT 'VALUE_MISMATCH', k FROM m WHERE coalesce(c1, '') <> c2)
SELECT count(*) AS break_count, least(count(*), 500)::INTEGER AS listed FROM f""")
def recon_report(spark, sf_dir):
    """AGG-15, SNK-09: totals and at most 500 breaks."""
    out = recon.report(recon.breaks(*order_sides(spark, sf_dir)))
    return out.select("break_count", F.size("breaks").alias("listed"))


# ---- arrivals


@query("""WITH d AS (SELECT doc_id, source, sha256(text) AS digest FROM documents),
f AS (SELECT digest, min(doc_id) AS first_id, arg_min(source, doc_id) AS first_name FROM d GROUP BY 1)
SELECT doc_id, source, d.digest, CASE WHEN doc_id = first_id THEN 'NEW' WHEN source = first_name THEN 'DUPLICATE' ELSE 'REDELIVERY' END AS verdict,
  CASE WHEN doc_id = first_id THEN 1 ELSE 2 END AS seen_count FROM d JOIN f ON d.digest = f.digest""")
def dedupe_verdict(spark, sf_dir):
    """WIN-01, AGG-10."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return arrivals.dedupe_verdicts(docs, "digest", "source", ["doc_id"]).select("doc_id", "source", "digest", "verdict", "seen_count")


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + (event_type = 'click')::INT * 0 AS seq, event_type FROM events),
g AS (SELECT *, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY seq), true) AS changed FROM s),
r AS (SELECT *, sum(changed::INT) OVER (PARTITION BY user_id ORDER BY seq) AS run FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY seq) - 1 AS still FROM r)
SELECT user_id, min(seq) AS seq FROM k WHERE still * 2 >= 4 GROUP BY user_id""")
def quiescence(spark, sf_dir):
    """SRC-02: events of a user as scans of a file whose state is the event type."""
    e = read(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return arrivals.quiescent(e.select("user_id", seq.alias("seq"), "event_type"), "user_id", "seq", ["event_type"], 2, 4)


@query("""SELECT event_id, sha256(coalesce(json_extract_string(props, '$.k'), props)) AS sha256,
 regexp_replace('events_p' || (event_id % 6) || '_o' || event_id, '[^A-Za-z0-9._-]', '_', 'g') || '.json' AS name FROM events WHERE json_valid(props)""")
def queue_json(spark, sf_dir):
    """SRC-05, SRC-06, SRC-07, FMT-19."""
    e = read(spark, sf_dir, "events").where(F.try_parse_json("props").isNotNull())
    v = F.try_variant_get(F.parse_json("props"), "$.k", "string")
    name = scalars.queue_name(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("events"), F.col("event_id") % 6, F.col("event_id"))
    return e.select("event_id", F.sha2(F.coalesce(v, "props"), 256).alias("sha256"), name.alias("name"))


@query("""WITH a AS (SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN 'FTP' ELSE 'QUEUE' END AS ingress, sha256(text) AS sha256,
 CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN source || '_m' || doc_id || '.json' ELSE source || '_m.json' END AS name FROM documents WHERE doc_id % 10 <> 7),
f AS (SELECT sha256, min(seq) AS prior_seq, arg_min(name, seq) AS first_name FROM a GROUP BY 1)
SELECT seq, ingress, name, a.sha256, prior_seq, CASE WHEN seq = prior_seq THEN 'NEW' WHEN name = first_name THEN 'DUPLICATE' ELSE 'REDELIVERY' END AS verdict,
 row_number() OVER (PARTITION BY a.sha256 ORDER BY seq) AS times_seen FROM a JOIN f ON a.sha256 = f.sha256
UNION ALL SELECT doc_id, NULL, NULL, sha256('{' || text), NULL, 'MALFORMED', NULL FROM documents WHERE doc_id % 10 = 7""")
def ingress_stream(spark, sf_dir):
    """SRC-05, SRC-06, SET-03, WIN-01: documents that land as files and others that come as messages, some malformed, as one stream over three runs that share its state."""
    from ..streaming import ingress
    from ..streaming.slot_stream import shared_folder

    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    id_, root = F.col("doc_id"), shared_folder(spark, "ingress")
    message = F.to_json(F.struct(F.when(id_ % 3 == 1, F.concat(F.lit("m"), id_.cast("string"))).otherwise("m").alias("messageId"), "source", F.col("text").alias("payload")))
    landed = docs.where("doc_id % 3 = 0 AND doc_id % 10 <> 7").select("doc_id", "source", F.col("text").cast("binary").alias("content"))
    queued = docs.where("doc_id % 3 <> 0 OR doc_id % 10 = 7").select("doc_id", F.when(id_ % 10 == 7, F.concat(F.lit("{"), "text")).otherwise(message).alias("value"))
    queued = queued.select("doc_id", "value", F.lit("events").alias("topic"), F.lit(0).alias("partition"), id_.alias("offset"))
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    for run in range(3):
        for table, name in ((landed, "files"), (queued, "messages")):
            table.where(id_.between(run * last // 3 + (run > 0), (run + 1) * last // 3)).write.mode("append").parquet(f"{root}/{name}")
        files = spark.readStream.schema(landed.schema).parquet(f"{root}/files")
        good, bad = ingress.from_messages(spark.readStream.schema(queued.schema).parquet(f"{root}/messages"), id_)
        both = ingress.from_files(files, F.col("source"), id_).unionByName(good)
        bad = bad.select(id_.alias("seq"), F.sha2("value", 256).alias("sha256"), F.lit("MALFORMED").alias("verdict"))
        for stream, name in ((ingress.with_verdicts(both), "verdicts"), (bad, "malformed")):
            sink = stream.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/state-{name}")
            sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{root}/verdicts").unionByName(spark.read.parquet(f"{root}/malformed"), allowMissingColumns=True)
    return out.select("seq", "ingress", "name", "sha256", "prior_seq", "verdict", "times_seen")


@query("""WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type FROM events),
g AS (SELECT *, coalesce(seq <> lag(seq) OVER w + 1, true) AS back, coalesce(seq <> lag(seq) OVER w + 1 OR event_type <> lag(event_type) OVER w, true) AS changed
 FROM s WHERE event_id % 17 <> 3 WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
r AS (SELECT *, sum(changed::INT) OVER w AS run, sum(back::INT) OVER w AS life FROM g WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY seq) - 1 AS still FROM r)
SELECT user_id::VARCHAR AS path, min(seq) AS seq FROM k WHERE still >= 1 AND (still * 2 >= 4 OR event_id % 5 = 0) GROUP BY user_id, life""")
def quiescence_stream(spark, sf_dir):
    """SRC-02, SRC-03, SRC-04, STR-10: a user's events as scans of a file, with sentinels and gaps, as a stream over three runs that share its state."""
    from ..streaming.ingress import quiet_files
    from ..streaming.slot_stream import shared_folder

    root = shared_folder(spark, "scans")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    scans = read(spark, sf_dir, "events").withColumn("seq", seq.cast("long")).where("event_id % 17 <> 3")
    scans = scans.select("user_id", "seq", F.timestamp_seconds(F.col("seq") * 2).alias("time"), "event_type", (F.col("event_id") % 5 == 0).alias("done"))
    last = scans.agg(F.max("seq")).first()[0] or 0
    for run in range(3):
        scans.where(F.col("seq").between(run * last // 3 + 1, (run + 1) * last // 3)).write.mode("append").parquet(f"{root}/scans")
        stream = spark.readStream.schema(scans.schema).parquet(f"{root}/scans")
        sink = quiet_files(stream, "user_id", "seq", "time", ["event_type"], 2, 4, "done")
        sink = sink.writeStream.format("parquet").option("path", f"{root}/quiet").option("checkpointLocation", f"{root}/state")
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/quiet")


# ---- text shapes


LINES_SQL = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


def doc_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query(f"""WITH {LINES_SQL}, d(delimiter) AS (VALUES (','), (';'), ('|'), (chr(9))),
c AS (SELECT doc_id, delimiter, len(line) - len(replace(line, delimiter, '')) AS n FROM lines, d WHERE len(trim(line)) > 0),
h AS (SELECT doc_id, delimiter, n, count(*) AS hits FROM c WHERE n > 0 GROUP BY 1, 2, 3),
m AS (SELECT doc_id, delimiter, sum(hits) AS having_it, max(hits) AS agreeing, arg_max(n, hits * 100000 + n) AS modal FROM h GROUP BY 1, 2)
SELECT doc_id, delimiter, modal::INTEGER AS modal, round(agreeing / having_it * least(1, modal / 6.0), 6) AS score FROM m
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(agreeing / having_it * least(1, modal / 6.0), 6) DESC, delimiter) = 1""")
def delimiter_vote(spark, sf_dir):
    """FMT-03: the delimiter whose counts agree best over the lines that have it."""
    from ..sources.delimited import delimiter_scores

    lines = doc_lines(spark, sf_dir).withColumnRenamed("doc_id", "arrival_id")
    best = delimiter_scores(lines).groupBy("arrival_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "delimiter", "modal")).alias("b"))
    return best.select(F.col("arrival_id").alias("doc_id"), "b.delimiter", F.col("b.modal").cast("int").alias("modal"), (-F.col("b.s")).alias("score"))


@query(f"""WITH {LINES_SQL} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE lower(regexp_replace(string_split(line, ' ')[1], '[^A-Za-z]', '', 'g'))
 IN ('total','totals','grandtotal','subtotal','sum','count','endofreport','eof','end')) AS totals FROM lines GROUP BY doc_id""")
def totals_filter(spark, sf_dir):
    """FMT-06: rows whose first cell says that they sum up others."""
    first = F.lower(F.regexp_replace(F.element_at(F.split("line", " "), 1), "[^A-Za-z]", ""))
    lines = doc_lines(spark, sf_dir)
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(first.isin(*scalars.TOTALS)).alias("totals"))


@query("""WITH t AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations)
SELECT conv_id, turn, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '[0-9]')) AS with_number,
 count(*) FILTER (WHERE regexp_matches(lower(line), '(debit|withdraw|paid|payment|sent|out)')) AS debit,
 max(TRY_CAST(replace(regexp_extract(line, '[0-9][0-9,]*(?:[.][0-9]+)?'), ',', '') AS DECIMAL(28,8))) AS largest FROM t GROUP BY 1, 2""")
def cash_lines(spark, sf_dir):
    """FMT-21, FMT-22, FMT-23: amounts and directions of free-text lines."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    number = F.replace(F.regexp_extract("line", r"[0-9][0-9,]*(?:[.][0-9]+)?", 0), F.lit(","), F.lit("")).try_cast("decimal(28,8)")
    return t.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("line").rlike("[0-9]")).alias("with_number"),
        F.count_if(F.lower("line").rlike("(debit|withdraw|paid|payment|sent|out)")).alias("debit"), F.max(number).alias("largest"),
    )


NOISE_SQL = "lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g'))"


@query(f"""WITH n AS (SELECT p_partkey, {NOISE_SQL} AS norm, {NOISE_SQL} || CASE WHEN p_size % 3 = 0 THEN 'usd' WHEN p_size % 3 = 1 THEN 'amtlocal' ELSE '' END AS noisy FROM part)
SELECT p_partkey, norm, CASE WHEN noisy LIKE '%amtlocal' THEN left(noisy, len(noisy) - 8) WHEN noisy LIKE '%usd' THEN left(noisy, len(noisy) - 3) ELSE noisy END AS bare FROM n""")
def header_norm(spark, sf_dir):
    """FN-01, FN-02."""
    p = read(spark, sf_dir, "part").withColumn("norm", scalars.normalize_header(F.col("p_type")))
    tail = F.when(F.col("p_size") % 3 == 0, "usd").when(F.col("p_size") % 3 == 1, "amtlocal").otherwise("")
    return p.select("p_partkey", "norm", scalars.strip_noise(F.concat("norm", tail)).alias("bare"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE round(c_acctbal, 2)::DECIMAL(28,8) END AS value FROM customer""")
def decimal_parse(spark, sf_dir):
    """FN-03: balances written with separators, parentheses, signs and markers."""
    size = F.format_number(F.abs(F.round("c_acctbal", 2)), 2)
    minus = F.col("c_acctbal") < 0
    text = (
        F.when(F.col("c_custkey") % 7 == 0, "n/a")
        .when(minus & (F.col("c_custkey") % 2 == 0), F.concat(F.lit("("), size, F.lit(")")))
        .when(minus, F.concat(size, F.lit("-")))
        .otherwise(F.concat(F.lit("$ "), size))
    )
    return read(spark, sf_dir, "customer").select("c_custkey", scalars.to_decimal(text).alias("value"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m-%d') AS from_name FROM orders")
def date_parse(spark, sf_dir):
    """FN-05, FN-06: dates written in several formats."""
    forms = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MMM-yyyy", "ddMMMyyyy", "yyyyMMdd", "dd.MM.yyyy")
    k = F.col("o_orderkey") % len(forms)
    text = F.coalesce(*(F.when(k == i, F.date_format("o_orderdate", f)) for i, f in enumerate(forms)))
    # a T that belongs to the month's name would cut the text
    text = F.when(text.rlike("[A-Z][a-z]{2}"), text).otherwise(text)
    name = F.concat(F.lit("MCP_TRD_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".csv"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return read(spark, sf_dir, "orders").select("o_orderkey", iso(scalars.parse_date(text)).alias("d"), iso(scalars.filename_date(name)).alias("from_name"))


# ---- business days


def order_days(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.lit("MAIN").alias("calendar_id"), F.to_date("o_orderdate").alias("d"))


@query(f"""WITH {DAYS_SQL} SELECT o_orderkey, CASE WHEN is_business THEN day ELSE prev_day END AS rolled FROM orders JOIN days ON o_orderdate::DATE = day""")
def bd_roll(spark, sf_dir):
    """FN-09."""
    return calendars.roll(order_days(spark, sf_dir), days(spark), "calendar_id", "d", "rolled").select("o_orderkey", "rolled")


@query(f"""WITH {DAYS_SQL}, b AS (SELECT seq, day FROM days WHERE is_business)
SELECT o_orderkey, p.day AS plus_2, m.day AS minus_3 FROM orders JOIN days d ON o_orderdate::DATE = d.day
JOIN b p ON p.seq = d.seq + 2 JOIN b m ON m.seq = d.seq - 3 + (NOT d.is_business)::INT""")
def bd_add(spark, sf_dir):
    """FN-09: business days forth and back."""
    cal = days(spark)
    out = calendars.add_business_days(order_days(spark, sf_dir), cal, "calendar_id", "d", 2, "plus_2")
    return calendars.add_business_days(out, cal, "calendar_id", "d", -3, "minus_3").select("o_orderkey", "plus_2", "minus_3")


@query(f"""WITH {DAYS_SQL} SELECT o_orderkey, CASE WHEN x.day = y.day THEN 0 WHEN x.day < y.day THEN y.seq + (NOT y.is_business)::INT - x.seq
 ELSE -(x.seq + (NOT x.is_business)::INT - y.seq) END::BIGINT AS n FROM orders JOIN days x ON o_orderdate::DATE = x.day JOIN days y ON y.day = DATE '{AS_OF}'""")
def bd_between(spark, sf_dir):
    """FN-10."""
    df = order_days(spark, sf_dir).withColumn("e", F.lit(AS_OF).cast("date"))
    return calendars.business_days_between(df, days(spark), "calendar_id", "d", "e", "n").select("o_orderkey", F.col("n").cast("long").alias("n"))


@query(f"""WITH {DAYS_SQL}, b AS (SELECT seq, day FROM days WHERE is_business), t AS (SELECT seq, is_business FROM days WHERE day = DATE '{AS_OF}')
SELECT o_orderkey, (o_orderdate::DATE BETWEEN (SELECT b.day FROM b, t WHERE b.seq = t.seq - 20 + (NOT t.is_business)::INT)
 AND (SELECT b.day FROM b, t WHERE b.seq = t.seq + 20)) AS accepted FROM orders""")
def late_window(spark, sf_dir):
    """STR-02, STR-06."""
    df = order_days(spark, sf_dir).withColumnRenamed("d", "value_date")
    return slots.accepted(df, days(spark), AS_OF, 20).select("o_orderkey", "accepted")


@query(f"""WITH {DAYS_SQL}, c AS (SELECT l_orderkey AS k, l_shipdate::DATE AS d, count(*) AS n, min(l_linenumber) AS first_at FROM lineitem GROUP BY 1, 2),
w AS (SELECT k, first(d ORDER BY n DESC, first_at, d) AS d, count(*) AS n_dates FROM c GROUP BY 1),
r AS (SELECT o_orderkey, o_orderdate::DATE AS f, coalesce(w.d, o_orderdate::DATE) AS d, coalesce(n_dates, 1) AS n_dates, w.k IS NOT NULL AS has FROM orders LEFT JOIN w ON o_orderkey = k),
v AS (SELECT r.*, CASE WHEN is_business THEN days.day ELSE prev_day END AS value_date FROM r JOIN days ON r.d = days.day)
SELECT o_orderkey, value_date, CASE WHEN has THEN 'CONTENT_EXPLICIT' ELSE 'FILENAME' END AS method,
 round((CASE WHEN has THEN 0.97 ELSE 0.70 END * CASE WHEN n_dates > 1 THEN 0.9 ELSE 1.0 END - CASE WHEN value_date <> d THEN 0.1 ELSE 0.0 END)::DOUBLE, 2) AS confidence,
 f <> value_date AS mismatch, n_dates FROM v""")
def value_date(spark, sf_dir):
    """CLS-03, AGG-03: ship dates of an order as its file's contents, its order date as the name's."""
    line = read(spark, sf_dir, "lineitem")
    cells = line.select(F.col("l_orderkey").alias("arrival_id"), F.col("l_linenumber").alias("row_idx"), F.to_date("l_shipdate").alias("d"))
    files = order_days(spark, sf_dir).select(
        F.col("o_orderkey").alias("arrival_id"), "calendar_id", F.col("d").alias("file_date"), F.date_add("d", 3).alias("arrival_day")
    )
    out = valuedate.resolve(files, cells, cells.where("false"), days(spark))
    return out.select(
        F.col("arrival_id").alias("o_orderkey"), "value_date", "method", F.round(F.col("confidence") - 1e-9, 2).alias("confidence"), "mismatch", "n_dates"
    )


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS d, l_partkey FROM lineitem),
r AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY d) - 1 AS batch_no FROM c)
SELECT l_orderkey, d, batch_no, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def multi_date_split(spark, sf_dir):
    """CLS-04, WIN-06."""
    line = read(spark, sf_dir, "lineitem")
    cells = line.select(F.col("l_orderkey").alias("arrival_id"), F.col("l_linenumber").alias("row_idx"), F.to_date("l_shipdate").alias("d"))
    out = valuedate.split_batches(cells, parts_of(line))
    return out.groupBy(F.col("arrival_id").alias("l_orderkey"), "d", "batch_no").agg(F.count("*").alias("n"))


# ---- mapping


@query("""WITH g AS (SELECT l_suppkey, l_partkey, count(*) AS n, count(DISTINCT l_extendedprice) AS nd FROM lineitem GROUP BY 1, 2),
t AS (SELECT l_suppkey, count(DISTINCT l_extendedprice) AS d, count(*) AS m FROM lineitem GROUP BY 1),
r AS (SELECT l_suppkey, avg(CASE WHEN n > 1 THEN (nd > 1)::INT END) AS r FROM g GROUP BY 1)
SELECT l_suppkey, round(coalesce(r, d / m), 6) AS ratio FROM r JOIN t USING (l_suppkey)""")
def variation_ratio(spark, sf_dir):
    """AGG-06: how often a price varies within an instrument, per file (supplier)."""
    line = read(spark, sf_dir, "lineitem")
    out = mapping.variation_ratio(line, "l_partkey", "l_extendedprice", ["l_suppkey"], parts_of(line))
    return out.select("l_suppkey", F.round("ratio", 6).alias("ratio"))


@query("""WITH r AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS row_idx,
 l_quantity::DECIMAL(18,4) AS q, p_retailprice::DECIMAL(18,4) AS p, l_extendedprice::DECIMAL(18,4) AS a FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_suppkey, round(avg((abs(q * p - a) <= a * 0.05)::INT), 6) AS share FROM r WHERE row_idx < 200 AND q <> 0 AND p <> 0 AND a <> 0 GROUP BY 1""")
def cross_check(spark, sf_dir):
    """AGG-08: whether quantity times price is the amount, in the first 200 rows of each file (supplier)."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    by = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    rows = rows.withColumn("row_idx", F.row_number().over(by) - 1)
    for c in ("l_quantity", "p_retailprice", "l_extendedprice"):
        rows = rows.withColumn(c, F.col(c).cast("decimal(18,4)"))
    out = mapping.cross_check(rows, "l_suppkey", "l_quantity", "p_retailprice", "l_extendedprice")
    return out.select("l_suppkey", F.round("share", 6).alias("share"))


HEADERS = ("Account ID", "Symbol", "Trade Date", "Qty", "Settle Price (USD)", "Net Amount", "CCY", "Ticker", "Price", "Quantity")
ALIASES = (
    ("accountid", "account_id"), ("symbol", "instrument_id"), ("ticker", "instrument_id"), ("tradedate", "trade_date"), ("qty", "quantity"),
    ("quantity", "quantity"), ("settleprice", "settlement_price"), ("netamount", "net_amount"), ("ccy", "currency"),
)


def header_columns(spark, sf_dir):
    """Columns of one file per supplier: the headers, turned by the supplier's number."""
    heads = F.array(*map(F.lit, HEADERS))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("arrival_id"), F.posexplode(heads).alias("i", "header"))
    return s.select("arrival_id", ((F.col("i") + F.col("arrival_id")) % len(HEADERS)).cast("int").alias("col_idx"), "header")


def values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


@query(f"""WITH h(i, header) AS (VALUES {values(enumerate(HEADERS))}), al(alias, field) AS (VALUES {values(ALIASES)}),
c AS (SELECT s_suppkey AS arrival_id, ((i + s_suppkey) % {len(HEADERS)})::INTEGER AS col_idx, header,
 regexp_replace(lower(regexp_replace(header, '[^A-Za-z0-9]', '', 'g')), '(usd)$', '') AS n FROM supplier, h),
m AS (SELECT c.*, field, row_number() OVER (PARTITION BY arrival_id, field ORDER BY col_idx) AS rn FROM c LEFT JOIN al ON n = alias)
SELECT arrival_id, col_idx, header, CASE WHEN rn = 1 THEN field END AS field, CASE WHEN field IS NOT NULL AND rn = 1 THEN 'ALIAS' ELSE 'UNRESOLVED' END AS tier FROM m""")
def alias_first_wins(spark, sf_dir):
    """JOIN-08, CLS-05: the first column of a field has it."""
    dim = spark.createDataFrame(ALIASES, "alias string, field string")
    out = mapping.first_claims(mapping.alias_fields(header_columns(spark, sf_dir), dim))
    return out.select("arrival_id", "col_idx", "header", "field", "tier")


@query()
def fuzzy_headers(spark, sf_dir):
    """JOIN-09, CLS-07, FN-18: part types as headers against the aliases."""
    heads = read(spark, sf_dir, "part").select(F.col("p_name").alias("header"))
    heads = heads.unionByName(spark.createDataFrame([(h,) for h in ("Acount ID", "Trade Dte", "Quantty", "Net Amnt")], "header string"))
    return mapping.fuzzy_fields(heads, list(ALIASES))


@query("""WITH a AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label),
s AS (SELECT v.vec_id, a.label, round(list_cosine_similarity(v.embedding::DOUBLE[], a.e::DOUBLE[]), 9) AS score FROM embeddings v, a)
SELECT vec_id, 'L' || label AS field, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, 'L' || label) = 1""")
def embedding_nearest(spark, sf_dir):
    """JOIN-10, FN-19: the nearest of one anchor per label."""
    e = read(spark, sf_dir, "embeddings")
    anchors = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor")).select(F.concat(F.lit("L"), F.col("label").cast("string")).alias("field"), "anchor")
    out = mapping.nearest_field(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), anchors)
    return out.select(F.col("id").alias("vec_id"), "field", F.round("score", 6).alias("score"))


PATTERNS = (("C0", 0, "src1[0-9]", "TRADE"), ("C1", 0, "src2$", "CASH"), ("C1", 1, "src[3-5]$", "POSITION"))


@query(f"""WITH p(client_id, hint_no, pattern, domain) AS (VALUES {values(PATTERNS)}),
f AS (SELECT doc_id, source, lang FROM documents),
n AS (SELECT doc_id, arg_min(client_id, client_id || hint_no) AS name_client, arg_min(domain, client_id || hint_no) AS d
      FROM f JOIN p ON regexp_matches(source, '^(?:' || pattern || ')') GROUP BY 1),
c AS (SELECT doc_id, CASE lang WHEN 'de' THEN 'C0' WHEN 'fr' THEN 'C1' END AS content FROM f)
SELECT f.doc_id, coalesce(content, name_client) AS client_id, (CASE WHEN content = name_client THEN 0.99 WHEN content IS NOT NULL AND name_client IS NOT NULL THEN 0.45
 WHEN content IS NOT NULL THEN 0.95 WHEN name_client IS NOT NULL THEN 0.80 ELSE 0.0 END)::DOUBLE AS confidence,
 coalesce(d, 'UNKNOWN') AS domain FROM f JOIN c ON f.doc_id = c.doc_id LEFT JOIN n ON f.doc_id = n.doc_id""")
def attribution_by_content_and_name(spark, sf_dir):
    """CLS-01, JOIN-05, JOIN-06, AGG-05: sources as names, languages as accounts."""
    docs = read(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("arrival_id"), F.col("source").alias("name"))
    patterns = spark.createDataFrame(PATTERNS, "client_id string, hint_no int, pattern string, domain string")
    accounts = spark.createDataFrame([("de", "C0"), ("fr", "C1")], "account_id string, client_id string")
    candidates = docs.select(F.col("doc_id").alias("arrival_id"), F.col("lang").alias("account_id"))
    out = attribution.attribute(files, candidates, patterns, accounts)
    return out.select(F.col("arrival_id").alias("doc_id"), "client_id", "confidence", "domain")


@query("""WITH m AS (SELECT o_orderkey, 'account_id' AS field, 1.0 AS c, 2 AS w FROM orders UNION ALL
 SELECT o_orderkey, 'net_amount', CASE WHEN o_totalprice > 100000 THEN 0.9 ELSE 0.6 END, 3 FROM orders UNION ALL
 SELECT o_orderkey, 'currency', CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 0.8 END, 2 FROM orders),
c AS (SELECT o_orderkey, round((sum(w * coalesce(c, 0)) / sum(w))::DOUBLE, 4) AS coverage, count(*) FILTER (WHERE c IS NULL) AS n_missing FROM m GROUP BY 1),
s AS (SELECT o.o_orderkey, coverage, n_missing, round(0.35 * CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE 0.95 END + 0.35 * 0.97 + 0.30 * coverage, 4)::DOUBLE AS score, o.o_orderkey % 5 = 0 AS open FROM orders o JOIN c USING (o_orderkey))
SELECT o_orderkey, coverage, round(score, 3) AS score, CASE WHEN open THEN CASE WHEN score >= 0.3 THEN 'QUARANTINED' ELSE 'REJECTED' END
 WHEN n_missing > 0 THEN 'QUARANTINED' WHEN score >= 0.85 THEN 'DISPATCHED' WHEN score >= 0.6 THEN 'QUARANTINED' ELSE 'REJECTED' END AS disposition FROM s""")
def coverage_score_route(spark, sf_dir):
    """AGG-09, CLS-11, CLS-13: cash files out of orders."""
    o = read(spark, sf_dir, "orders")
    files = o.select(F.col("o_orderkey").alias("arrival_id"), F.lit("CASH").alias("domain"))
    maps = F.array(
        F.struct(F.lit("account_id").alias("field"), F.lit(1.0).alias("confidence")),
        F.struct(F.lit("net_amount").alias("field"), F.when(F.col("o_totalprice") > 100000, 0.9).otherwise(0.6).alias("confidence")),
        F.struct(F.when(F.col("o_orderstatus") != "O", "currency").alias("field"), F.lit(0.8).alias("confidence")),
    )
    mapped = o.select(F.col("o_orderkey").alias("arrival_id"), F.inline(maps))
    cov = scoring.coverage(files, mapped)
    client = F.when(F.col("arrival_id") % 5 != 0, "C")
    score = scoring.overall(F.when(client.isNull(), 0.0).otherwise(0.95), F.lit(0.97), F.col("coverage"))
    out = cov.withColumn("score", score)
    disposition = scoring.route(F.col("score"), client, F.lit("d"), F.size("missing"))
    return out.select(F.col("arrival_id").alias("o_orderkey"), "coverage", F.round("score", 3).alias("score"), disposition.alias("disposition"))


# ---- slots


def slot_arrivals(spark, sf_dir, orders=None):
    """Orders as arrivals: a slot per customer, priority and year; status says the side."""
    side = F.when(F.col("o_orderstatus") == "F", slots.GL).otherwise(slots.CLIENT)
    orders = read(spark, sf_dir, "orders") if orders is None else orders
    return orders.select(
        F.col("o_custkey").alias("client_id"), F.col("o_orderpriority").alias("domain"), F.trunc("o_orderdate", "year").alias("value_date"),
        F.col("o_orderkey").alias("arrival_id"), side.alias("side"), F.col("o_orderkey").alias("seq"),
    )


SLOT_SQL = """
a AS (SELECT o_custkey AS client_id, o_orderpriority AS domain, date_trunc('year', o_orderdate)::DATE AS value_date, o_orderkey AS seq, o_orderstatus = 'F' AS gl FROM orders),
s AS (SELECT *, last_value(CASE WHEN gl THEN seq END IGNORE NULLS) OVER w AS side_1, last_value(CASE WHEN NOT gl THEN seq END IGNORE NULLS) OVER w AS side_2
      FROM a WINDOW w AS (PARTITION BY client_id, domain, value_date ORDER BY seq ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, CASE WHEN side_1 IS NOT NULL AND side_2 IS NOT NULL THEN 'asg-' || seq END AS assignment_id FROM s),
o AS (SELECT *, CASE WHEN assignment_id IS NOT NULL THEN lag(assignment_id) OVER (PARTITION BY client_id, domain, value_date ORDER BY seq) END AS supersedes,
      CASE WHEN assignment_id IS NOT NULL THEN 'ASSIGNED' ELSE 'PARTIAL' END AS state FROM t)"""


@query(f"WITH {SLOT_SQL} SELECT seq, side_1, side_2, state, assignment_id, supersedes FROM o")
def slot_fold(spark, sf_dir):
    """STR-03, JOIN-13, SNK-04."""
    return slots.fold(slot_arrivals(spark, sf_dir)).select("seq", "side_1", "side_2", "state", "assignment_id", "supersedes")


@query(f"WITH {SLOT_SQL} SELECT seq, side_1, side_2, state, assignment_id, supersedes FROM o")
def slot_stream(spark, sf_dir):
    """STR-01, STR-03, STR-07: the same fold as a stateful stream over files, until all are read."""
    from ..streaming.slot_stream import shared_folder, slot_outcomes

    schema = read(spark, sf_dir, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders*.parquet").parquet(sf_dir)
    arrived = slot_arrivals(spark, sf_dir, stream).withColumns({c: F.col(c).cast("string") for c in ("arrival_id", "client_id")})
    root = shared_folder(spark, "slots")
    query_ = slot_outcomes(arrived).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    query_.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    long = lambda c: F.col(c).cast("long").alias(c)
    return spark.read.parquet(f"{root}/out").select("seq", long("side_1"), long("side_2"), "state", "assignment_id", "supersedes")


@query(f"WITH {SLOT_SQL} SELECT supersedes AS assignment_id, assignment_id AS voided_by FROM o WHERE supersedes IS NOT NULL")
def slot_supersede(spark, sf_dir):
    """SNK-06."""
    return slots.voids(slots.fold(slot_arrivals(spark, sf_dir)))


@query(f"""WITH {DAYS_SQL}, b AS (SELECT seq AS s, day FROM days WHERE is_business), {SLOT_SQL},
c AS (SELECT client_id, domain, value_date, arg_max(state, seq) AS state, arg_max(side_1 IS NULL, seq) AS no_gl FROM o GROUP BY 1, 2, 3)
SELECT client_id, domain, c.value_date, CASE WHEN no_gl THEN 'INTERNAL_GL' ELSE 'EXTERNAL_CLIENT' END AS missing_side
FROM c JOIN days d ON c.value_date = d.day JOIN b ON b.s = d.seq + 2 WHERE state <> 'ASSIGNED' AND b.day + INTERVAL '23 hours 59 minutes' < TIMESTAMP '{AS_OF} 12:00:00'""")
def slot_overdue(spark, sf_dir):
    """STR-04, STR-05."""
    now = slots.current(slots.fold(slot_arrivals(spark, sf_dir))).withColumn("calendar_id", F.lit("MAIN"))
    late = slots.overdue(slots.deadlines(now, days(spark)), f"{AS_OF} 12:00:00")
    return late.select("client_id", "domain", "value_date", "missing_side")


# ---- decision log


def event_records(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return e.select(
        F.lpad(text("event_id"), 12, "0").alias("record_id"), F.lpad(text("user_id"), 12, "0").alias("arrival_id"), scalars.rfc3339(F.col("ts")).alias("at"),
        F.lit("intake").alias("component"), F.col("event_type").alias("decision_type"), text("props").alias("inputs_json"), F.lit("{}").alias("outcome_json"), F.lit("system").alias("actor"),
    )


CHAIN_SQL = """
r AS (SELECT lpad(event_id::VARCHAR, 12, '0') AS record_id, lpad(user_id::VARCHAR, 12, '0') AS arrival_id,
 regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '[.]?0+$', '') || 'Z' AS stamp, event_type, coalesce(props, '') AS props FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY arrival_id ORDER BY stamp, record_id) AS pos,
 record_id || chr(31) || arrival_id || chr(31) || stamp || chr(31) || 'intake' || chr(31) || event_type || chr(31) || props || chr(31) || '{}' || chr(31) || 'system' || chr(31) AS body FROM r),
chain AS (SELECT arrival_id, pos, record_id, sha256(body || '' || chr(31)) AS h FROM n WHERE pos = 1
 UNION ALL SELECT n.arrival_id, n.pos, n.record_id, sha256(n.body || c.h || chr(31)) FROM chain c JOIN n ON n.arrival_id = c.arrival_id AND n.pos = c.pos + 1)"""


@query(f"WITH RECURSIVE {CHAIN_SQL} SELECT arrival_id, record_id, h AS record_hash FROM chain")
def audit_build(spark, sf_dir):
    """WIN-04, FN-16."""
    return audit.chain_links(event_records(spark, sf_dir)).select("arrival_id", "record_id", "record_hash")


@query(f"WITH RECURSIVE {CHAIN_SQL}, m AS (SELECT arrival_id, max(pos) AS n FROM n GROUP BY 1) SELECT chain.arrival_id, record_id, h AS record_hash, m.n AS records, NULL::VARCHAR AS reason FROM chain JOIN m ON m.arrival_id = chain.arrival_id")
def audit_extend(spark, sf_dir):
    """WIN-05, AGG-11: chains stored in three batches, each of which plays some of the one before again, and then verified one by one."""
    from ..streaming.slot_stream import shared_folder

    root = shared_folder(spark, "chains")
    shares = F.ntile(3).over(Window.partitionBy("arrival_id").orderBy("at", "record_id"))
    event_records(spark, sf_dir).withColumn("share", shares).write.parquet(f"{root}/records")
    records = spark.read.parquet(f"{root}/records")
    spark.createDataFrame([], records.drop("share").schema.add("prev_hash", "string").add("record_hash", "string")).write.parquet(f"{root}/stored/batch=0")
    for batch in (1, 2, 3):
        stored = spark.read.option("basePath", f"{root}/stored").parquet(f"{root}/stored").drop("batch")
        linked, _ = audit.extend(stored, records.where(F.col("share").isin(batch - 1, batch)).drop("share"))
        linked.write.parquet(f"{root}/stored/batch={batch}")
    stored = spark.read.parquet(f"{root}/stored")
    return stored.join(audit.verify_all(stored).select("arrival_id", "records", "reason"), "arrival_id").select("arrival_id", "record_id", "record_hash", "records", "reason")


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, lpad(event_id::VARCHAR, 12, '0')) AS pos FROM events)
SELECT lpad(user_id::VARCHAR, 12, '0') AS arrival_id, min(pos)::INTEGER AS position, 'content' AS reason FROM n WHERE event_id % 97 = 5 GROUP BY 1""")
def audit_verify(spark, sf_dir):
    """WIN-02, WIN-03: chains in which some records were edited."""
    records = event_records(spark, sf_dir)
    chain = audit.chain_links(records)
    stored = records.join(chain, ["arrival_id", "record_id"])
    edited = F.when(F.col("record_id").cast("long") % 97 == 5, "edited").otherwise(F.col("actor"))
    return audit.verify(stored.withColumn("actor", edited)).select("arrival_id", "position", "reason")


# ---- read models


@query("SELECT c_custkey, CASE WHEN len(c_name) <= 4 THEN repeat('*', len(c_name)) ELSE repeat('*', len(c_name) - 4) || right(c_name, 4) END AS masked FROM customer")
def mask(spark, sf_dir):
    """FN-14."""
    return read(spark, sf_dir, "customer").select("c_custkey", scalars.mask_account(F.col("c_name")).alias("masked"))


def order_arrivals(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "DISPATCHED").when(F.col("o_orderstatus") == "O", "QUARANTINED").otherwise("REJECTED")
    return o.select(
        F.col("o_orderkey").alias("arrival_id"), F.col("o_custkey").cast("string").alias("client_id"), status.alias("disposition"),
        F.col("o_orderdate").alias("detected_at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.expr("interval 1 day")).alias("classified_at"),
        (F.col("o_orderkey") % 11 == 0).alias("mismatch"), F.col("o_orderpriority").alias("priority"),
    )


ARRIVALS_SQL = """arr AS (SELECT o_orderkey AS arrival_id, CASE o_orderstatus WHEN 'F' THEN 'DISPATCHED' WHEN 'O' THEN 'QUARANTINED' ELSE 'REJECTED' END AS disposition,
 o_orderdate AS detected_at, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 1 DAY END AS classified_at, o_orderkey % 11 = 0 AS mismatch, o_orderpriority AS priority FROM orders)"""


@query(f"""WITH {ARRIVALS_SQL} SELECT arrival_id, disposition FROM arr WHERE disposition = 'QUARANTINED' AND detected_at >= TIMESTAMP '1996-01-01'
ORDER BY coalesce(classified_at, detected_at) DESC, arrival_id LIMIT 200""")
def board_arrivals(spark, sf_dir):
    """PRJ-04, SRT-01: a top-k report."""
    return board.arrivals(order_arrivals(spark, sf_dir), since="1996-01-01", disposition="QUARANTINED").select("arrival_id", "disposition")


@query(f"WITH {ARRIVALS_SQL} SELECT arrival_id, disposition FROM arr WHERE arrival_id % 1000 = 7")
def point_lookup(spark, sf_dir):
    """PRJ-06: rows by id."""
    return order_arrivals(spark, sf_dir).where(F.col("arrival_id") % 1000 == 7).select("arrival_id", "disposition")


def summary_of(spark, sf_dir):
    a = order_arrivals(spark, sf_dir)
    asg = slots.fold(slot_arrivals(spark, sf_dir)).where("assignment_id IS NOT NULL")
    gone = slots.voids(asg).select("assignment_id", F.lit(1).alias("voided_at"))
    live = asg.select("assignment_id").join(gone, "assignment_id", "left")
    alert_rows = a.select(F.when(F.col("arrival_id") % 2 == 0, F.col("detected_at")).alias("acknowledged_at"))
    return board.summary(a, live, alert_rows)


SUMMARY_SQL = f"""{ARRIVALS_SQL}, {SLOT_SQL},
c AS (SELECT count(*) AS arrivals, count(*) FILTER (WHERE disposition = 'DISPATCHED') AS dispatched, count(*) FILTER (WHERE disposition = 'QUARANTINED') AS quarantined,
 count(*) FILTER (WHERE disposition = 'REJECTED') AS rejected, count(*) FILTER (WHERE mismatch) AS mismatches, count(*) FILTER (WHERE arrival_id % 2 <> 0) AS open_alerts FROM arr),
l AS (SELECT count(*) FILTER (WHERE assignment_id IS NOT NULL AND assignment_id NOT IN (SELECT supersedes FROM o WHERE supersedes IS NOT NULL)) AS assignments FROM o)"""


@query(f"""WITH {SUMMARY_SQL} SELECT arrivals, dispatched, quarantined, rejected, mismatches, assignments, open_alerts,
 round(quarantined / (dispatched + quarantined + rejected), 6) AS quarantine_rate FROM c, l""")
def board_summary(spark, sf_dir):
    """AGG-01, AGG-02."""
    return summary_of(spark, sf_dir).withColumn("quarantine_rate", F.round("quarantine_rate", 6))


@query(f"""WITH {SUMMARY_SQL} SELECT CASE WHEN open_alerts > 0 THEN 'INCIDENT' ELSE 'ATTENTION' END AS level,
 'open alerts: ' || open_alerts || '; in review: ' || quarantined || '; rejected: ' || rejected || '; date disagreements: ' || mismatches AS rationale FROM c""")
def posture(spark, sf_dir):
    """FN-26."""
    return board.posture(summary_of(spark, sf_dir)).select("level", F.array_join("rationale", "; ").alias("rationale"))


@query("SELECT doc_id, source FROM documents d WHERE lang IN ('de', 'fr') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def review_queue(spark, sf_dir):
    """JOIN-04, SRT-02, PRJ-07: documents in two languages as held files, labels as reviews."""
    docs = read(spark, sf_dir, "documents")
    held = F.when(F.col("lang") == "de", "QUARANTINED").when(F.col("lang") == "fr", "REJECTED").otherwise("DISPATCHED")
    rows = docs.select(F.col("doc_id").alias("arrival_id"), "source", held.alias("disposition"), F.col("n_chars").alias("classified_at"))
    reviews = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("arrival_id"))
    return board.review_queue(rows, reviews).select(F.col("arrival_id").alias("doc_id"), "source")


@query("""WITH a AS (SELECT o_orderkey AS alert_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS ack, o_orderdate AS emitted FROM orders)
SELECT alert_id FROM a ORDER BY ack ASC NULLS FIRST, emitted DESC, alert_id LIMIT 500""")
def alerts(spark, sf_dir):
    """SRT-05: a top-k report."""
    o = read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("alert_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("acknowledged_at"), F.col("o_orderdate").alias("emitted_at"))
    return board.alerts(rows).select("alert_id")


@query("""SELECT o_custkey, arg_min(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS first_order,
 arg_max(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) FILTER (WHERE o_orderstatus = 'F') AS last_f FROM orders GROUP BY 1""")
def first_and_last(spark, sf_dir):
    """SNK-03, SNK-04, SNK-07: first write wins, and latest value that isn't null."""
    o = read(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    first = board.first_wins(o.select("o_custkey", "o_orderkey", "at"), "o_custkey", F.col("at")).select("o_custkey", F.col("o_orderkey").alias("first_order"))
    f = o.withColumn("last_f", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))
    return first.join(board.coalesce_upsert(f, ["o_custkey"], "at", ["last_f"]), "o_custkey")


@query("""SELECT count(*) FILTER (WHERE p AND e) AS tp, count(*) FILTER (WHERE p AND NOT e) AS fp, count(*) FILTER (WHERE NOT p AND e) AS fn, count(*) FILTER (WHERE NOT p AND NOT e) AS tn,
 round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall
FROM (SELECT n_chars < 800 AS p, quality = 0 AS e FROM documents JOIN labels USING (doc_id))""")
def confusion(spark, sf_dir):
    """AGG-14: short texts as a guess of low quality."""
    both = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return scoring.confusion(both.select((F.col("n_chars") < 800).alias("p"), (F.col("quality") == 0).alias("e")), "p", "e")


@query("SELECT lang AS bucket, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS correct FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def bucket_accuracy(spark, sf_dir):
    """AGG-13."""
    both = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return scoring.bucket_accuracy(both.select(F.col("lang").alias("bucket"), (F.col("quality") == 1).alias("ok")), "bucket", "ok")


@query("""SELECT l_orderkey::VARCHAR AS arrival_id, l_suppkey::VARCHAR AS account_id, l_partkey::VARCHAR AS instrument_id, round(l_quantity, 2)::DECIMAL(28,8) AS quantity,
 round(l_extendedprice, 2)::DECIMAL(28,8) AS net_amount, NULL::DECIMAL(28,8) AS market_value, CASE l_returnflag WHEN 'R' THEN 'SELL' WHEN 'A' THEN 'BUY' ELSE 'N' END AS side, 'TRADE' AS domain FROM lineitem""")
def canonical_projection(spark, sf_dir):
    """PRJ-01, PRJ-03: lines as cells, mapped to canonical records."""
    money = lambda c: F.format_string("%.2f", F.round(c, 2))
    side = F.when(F.col("l_returnflag") == "R", "Sold").when(F.col("l_returnflag") == "A", " b ").otherwise("n")
    cells = F.map_from_arrays(
        F.array(*map(F.lit, ("Acct", "Ticker", "Qty", "Net", "MV", "B/S"))),
        F.array(F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), money(F.col("l_quantity")), F.concat(F.lit("$"), money(F.col("l_extendedprice"))), F.lit("  "), side),
    )
    fields = {"account_id": "Acct", "instrument_id": "Ticker", "quantity": "Qty", "net_amount": "Net", "market_value": "MV", "side": "B/S"}
    rows = read(spark, sf_dir, "lineitem").select(
        cells.alias("cells"), F.create_map(*(F.lit(x) for p in fields.items() for x in p)).alias("mapping"), F.col("l_orderkey").alias("arrival_id"),
        F.lit("C").alias("client_id"), F.lit("2026-08-28").alias("value_date"), F.lit("TRADE").alias("domain"), F.lit("CME").alias("source_system"),
    )
    return projection.project(rows).select("arrival_id", "account_id", "instrument_id", "quantity", "net_amount", "market_value", "side", "domain")


@query("""WITH f AS (SELECT s_suppkey, s_suppkey % 3 AS g FROM supplier)
SELECT g, 'tf_' || left(sha256('C' || g || '|accountid|symbol|qty'), 16) AS fingerprint, count(*) AS n FROM f GROUP BY g""")
def layout_fingerprints(spark, sf_dir):
    """FN-12: files of one client and layout share a fingerprint."""
    s = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 3).alias("g"))
    mark = scalars.template_fingerprint(F.concat(F.lit("C"), F.col("g").cast("string")), F.array(*map(F.lit, ("Account ID", "Symbol", "Qty"))))
    return s.withColumn("fingerprint", mark).groupBy("g", "fingerprint").agg(F.count("*").alias("n"))


@query()
def mapping_ladder(spark, sf_dir):
    """CLS-05 to CLS-09, WIN-08: suppliers as files of three clients; each distinct layout is mapped once."""
    from ..operators import ladder

    cols = header_columns(spark, sf_dir).where("header != 'Ticker'")
    cols = cols.select(
        F.col("arrival_id").cast("string").alias("arrival_id"), F.concat(F.lit("C"), (F.col("arrival_id") % 3).cast("string")).alias("client_id"), "col_idx", "header",
        F.array(F.lit("USD")).alias("samples"), F.lit(0.9).alias("ratio"), F.col("header").contains("Price").alias("price_like"),
    )
    return ladder.map_layouts(ladder.layouts(cols), dict(ALIASES), tuple(sorted({f for _, f in ALIASES} | {"trade_price"})))


@query("""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '{"a": 1}' WHEN doc_id % 8 = 1 THEN '<x/>' WHEN doc_id % 8 = 5 THEN '<a><posrpt/></a>' ELSE text END AS t FROM documents),
u AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM c),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn, least(20, count(*) OVER (PARTITION BY doc_id)) AS n_lines FROM u WHERE trim(line) <> ''),
d AS (SELECT doc_id, delimiter, n_lines, len(line) - len(replace(line, delimiter, '')) AS n FROM l, (VALUES (','), (';'), ('|'), (chr(9))) v(delimiter) WHERE rn <= 20 AND contains(line, delimiter)),
h AS (SELECT doc_id, delimiter, n_lines, n, count(*) AS hits FROM d GROUP BY ALL),
s AS (SELECT doc_id, sum(hits) AS having_it, any_value(n_lines) AS n_lines, max(hits) AS hits, arg_max(n, hits * 1000000 + n) AS modal FROM h GROUP BY doc_id, delimiter),
b AS (SELECT doc_id, arg_max(hits / having_it, hits / having_it * least(1, modal / 6.0) + hits / having_it * 1e-9) AS share FROM s WHERE having_it >= greatest(2, n_lines // 3) AND n_lines >= 2 GROUP BY 1)
SELECT c.doc_id, CASE WHEN ltrim(t, ' ' || chr(9) || chr(10) || chr(13))[1] IN ('{', '[') THEN 'JSON' WHEN starts_with(t, '<a>') THEN 'FIXML' WHEN ltrim(t, ' ' || chr(9) || chr(10) || chr(13))[1] = '<' THEN 'XML'
 WHEN share IS NOT NULL THEN 'DELIMITED' ELSE 'NONE' END AS format, round(CASE WHEN ltrim(t, ' ' || chr(9) || chr(10) || chr(13))[1] IN ('{', '[', '<') THEN 0 ELSE coalesce(0.35 + 0.5 * share, 0) END, 6)::DOUBLE AS delimited
FROM c LEFT JOIN b ON b.doc_id = c.doc_id""")
def format_sniff(spark, sf_dir):
    """FMT-01, FMT-02, FMT-12, FMT-16, SRT-06: documents as files, some of them JSON, XML or parts of FIXML, and how sure the delimited parser is of each."""
    from ..sources import documents

    id_ = F.col("doc_id")
    t = F.when(id_ % 4 == 0, '{"a": 1}').when(id_ % 8 == 1, "<x/>").when(id_ % 8 == 5, "<a><posrpt/></a>").otherwise(F.col("text"))
    d = documents.once(read(spark, sf_dir, "documents").select("doc_id", t.alias("t")), scores=documents.sniff_scores(F.encode("t", "UTF-8"), F.lit("x.bin")))
    return d.select("doc_id", F.coalesce(documents.best_format(F.col("scores")), F.lit("NONE")).alias("format"), F.round("scores.DELIMITED", 6).alias("delimited"))


@query(f"""WITH {ARRIVALS_SQL} SELECT disposition = 'DISPATCHED' AS dispatched, count(*) AS n FROM arr GROUP BY 1""")
def topic_routing(spark, sf_dir):
    """PRJ-07, PRJ-08, PRJ-09."""
    ok, held = projection.route_topics(order_arrivals(spark, sf_dir))
    both = ok.select(F.lit(True).alias("dispatched")).unionByName(held.select(F.lit(False).alias("dispatched")))
    return both.groupBy("dispatched").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, count(*) AS n_rows, count(DISTINCT o_orderdate::DATE) AS n_dates, min(o_orderdate::DATE) AS first_date FROM orders GROUP BY 1""")
def distinct_dates(spark, sf_dir):
    """AGG-04, SET-05."""
    o = read(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    out = o.groupBy("o_custkey").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set("d")).alias("dates"))
    return out.select("o_custkey", "n_rows", F.size("dates").cast("long").alias("n_dates"), F.element_at("dates", 1).alias("first_date"))


@query(f"""WITH {SLOT_SQL}, e AS (SELECT DISTINCT c_custkey AS client_id, p AS domain, DATE '1996-01-01' AS value_date FROM customer, (SELECT DISTINCT o_orderpriority AS p FROM orders))
SELECT client_id, domain FROM e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.client_id = e.client_id AND a.domain = e.domain AND a.value_date = e.value_date)""")
def silent_expectations(spark, sf_dir):
    """STR-05 for slots that no side ever opened."""
    domains = F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    expected = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"), F.explode(domains).alias("domain"), F.lit("1996-01-01").cast("date").alias("value_date"))
    return slots.silent_expectations(expected, slot_arrivals(spark, sf_dir)).select("client_id", "domain")


@query("""SELECT c_custkey, o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'NEVER' ELSE o_orderstatus END AS state FROM customer
LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def projection_update(spark, sf_dir):
    """JOIN-14: arrivals with their latest classification."""
    raw = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("arrival_id"))
    last = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("arrival_id"), "o_orderkey", "o_orderstatus")
    out = board.project_update(raw, last, "o_orderkey")
    return out.select(F.col("arrival_id").alias("c_custkey"), "o_orderkey", F.coalesce("o_orderstatus", F.lit("NEVER")).alias("state"))


@query("""WITH r AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS row_idx, l_orderkey % 9 = 0 AS bad FROM lineitem)
SELECT l_suppkey, count(*) FILTER (WHERE NOT bad) AS numeric, count(*) AS rows, count(*) FILTER (WHERE NOT bad) >= greatest(1, floor(count(*) * 0.8)) AS price_like
FROM r WHERE row_idx < 200 GROUP BY 1""")
def price_likeness(spark, sf_dir):
    """AGG-07, WIN-07: prices of a supplier's first lines, some of them not numbers."""
    by = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    text = F.when(F.col("l_orderkey") % 9 == 0, "tbd").otherwise(F.format_number("l_extendedprice", 2))
    cells = read(spark, sf_dir, "lineitem").withColumn("row_idx", F.row_number().over(by) - 1).withColumn("cell", text)
    return mapping.price_like(cells, ["l_suppkey"], "cell")


@query("""SELECT o_custkey, string_agg(CASE WHEN len(o_orderkey::VARCHAR) <= 4 THEN repeat('*', len(o_orderkey::VARCHAR)) ELSE repeat('*', len(o_orderkey::VARCHAR) - 4) || right(o_orderkey::VARCHAR, 4) END, ',' ORDER BY o_orderkey) AS accounts
FROM orders GROUP BY 1""")
def mask_payload(spark, sf_dir):
    """FN-15: account ids inside a payload's array."""
    ids = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    masked = F.transform(F.transform("ids", lambda x: x.cast("string")), scalars.mask_account)
    return ids.select("o_custkey", F.array_join(masked, ",").alias("accounts"))


@query(f"""WITH {DAYS_SQL} SELECT o_orderkey, name AS holiday FROM orders JOIN (SELECT day AS d, holiday AS name FROM closed) ON o_orderdate::DATE = d""")
def holiday_names(spark, sf_dir):
    """FN-11."""
    out = calendars.with_day(order_days(spark, sf_dir), days(spark), "calendar_id", "d", "c_")
    return out.where("c_holiday IS NOT NULL").select("o_orderkey", F.col("c_holiday").alias("holiday"))


@query(f"""WITH {SLOT_SQL}, c AS (SELECT client_id, domain, value_date, arg_max(state, seq) AS state FROM o GROUP BY 1, 2, 3)
SELECT client_id, domain, value_date FROM c WHERE state = 'ASSIGNED' AND value_date = DATE '1996-01-01'""")
def slot_board(spark, sf_dir):
    """PRJ-05, SRT-04."""
    now = slots.current(slots.fold(slot_arrivals(spark, sf_dir)))
    return board.slots(now, "ASSIGNED", "1996-01-01").select("client_id", "domain", "value_date")


@query(f"""WITH {SLOT_SQL} SELECT seq, assignment_id FROM o WHERE assignment_id IS NOT NULL ORDER BY seq DESC LIMIT 200""")
def latest_assignments(spark, sf_dir):
    """SRT-03: a top-k report."""
    made = slots.fold(slot_arrivals(spark, sf_dir)).where("assignment_id IS NOT NULL")
    return made.orderBy(F.desc("seq")).limit(board.list_limit(0)).select("seq", "assignment_id")


@query(f"""WITH h(i, header) AS (VALUES {values(enumerate(HEADERS))}), al(alias, field) AS (VALUES {values(ALIASES)}),
c AS (SELECT s_suppkey AS arrival_id, header, ((i + s_suppkey) % {len(HEADERS)}) AS col_idx, regexp_replace(lower(regexp_replace(header, '[^A-Za-z0-9]', '', 'g')), '(usd)$', '') AS n FROM supplier, h),
m AS (SELECT c.*, field, row_number() OVER (PARTITION BY arrival_id, field ORDER BY col_idx) AS rn FROM c LEFT JOIN al ON n = alias)
SELECT arrival_id, CASE WHEN field IS NOT NULL AND rn = 1 THEN 'ALIAS' ELSE 'UNRESOLVED' END AS tier, count(*) AS n FROM m GROUP BY 1, 2""")
def tier_counts(spark, sf_dir):
    """AGG-12, PRJ-10."""
    return alias_first_wins(spark, sf_dir).groupBy("arrival_id", "tier").agg(F.count("*").alias("n"))
