"""Where requests come from: tables, event streams, web-server logs, JSON dumps."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogs import Catalog, load
from ..functions.scalars import is_ipv4, source_of
from ..operators.classify import classify
from ..tables import filesystem
from .dumps import requests_of

#: The log that the test data implies, from its ``events`` table; the same text runs in other SQL engines.
DERIVED_SQL = """
SELECT event_id AS id, ts AS created_at,
  CASE u % 5
    WHEN 0 THEN concat('34.', CAST(10 + g % 200 AS STRING), '.7.', CAST(1 + g % 250 AS STRING))
    WHEN 1 THEN '80.94.95.211'
    WHEN 2 THEN concat('45.135.193.', CAST(10 + g % 40 AS STRING))
    WHEN 3 THEN concat('73.', CAST(g % 200 AS STRING), '.4.', CAST(1 + g % 250 AS STRING))
    ELSE CASE WHEN g % 4 = 0 THEN concat('2001:db8::', CAST(g AS STRING)) ELSE concat('192.42.116.', CAST(1 + g % 250 AS STRING)) END
  END AS ip,
  CASE u % 5
    WHEN 0 THEN CASE k % 3 WHEN 0 THEN '/actuator/env' WHEN 1 THEN '/actuator/heapdump' ELSE '/api/credentials.json' END
    WHEN 1 THEN concat('/.env.', CAST(k AS STRING))
    WHEN 2 THEN CASE (k + g) % 6 WHEN 0 THEN '/.env' WHEN 1 THEN '/.git/config' WHEN 2 THEN '/.aws/credentials' WHEN 3 THEN '/wp-config.php' WHEN 4 THEN '/phpinfo.php' ELSE '/' END
    WHEN 3 THEN CASE k % 4 WHEN 0 THEN '/' WHEN 1 THEN '/favicon.ico' WHEN 2 THEN '/api/inventory?category=potions' ELSE '/search?q=1 UNION SELECT 1' END
    ELSE '/.env'
  END AS full_url,
  CASE WHEN k = 41 THEN 'GET<script>' WHEN event_type = 'signup' THEN 'POST' WHEN event_type = 'error' THEN 'PROPFIND' ELSE 'GET' END AS method,
  CASE WHEN k % 17 = 0 THEN NULL
       WHEN u % 5 = 0 THEN concat('ua-', CAST(event_id AS STRING))
       WHEN u % 13 = 0 THEN 'libredtail-http'
       ELSE 'Mozilla/5.0 (X11; Linux x86_64) Chrome/120.0' END AS user_agent,
  CASE u % 5 WHEN 0 THEN 396982 WHEN 1 THEN 204428 WHEN 2 THEN 51396 WHEN 3 THEN 7922 ELSE CASE WHEN k % 9 = 2 THEN 64500 ELSE NULL END END AS asn,
  CASE WHEN k % 9 = 2 THEN CASE WHEN u % 5 = 4 AND k % 2 = 0 THEN 'Quiet Valley University' ELSE 'Hill Side' END WHEN u % 5 = 0 THEN 'Example Cloud' ELSE NULL END AS org,
  CASE WHEN event_type <> 'signup' THEN NULL WHEN k % 5 = 0 THEN '{"q":"1 UNION SELECT name FROM users"}' WHEN k % 5 = 1 THEN '{}' WHEN k % 5 = 2 THEN 'UNION SELECT' WHEN k % 5 = 3 THEN '[{"note":"<script>"}]' ELSE '{"note":"hello"}' END AS request_body,
  CASE WHEN k % 4 = 0 THEN 404 WHEN k % 4 = 1 THEN 403 ELSE 200 END AS status_code,
  CASE WHEN k % 6 = 0 THEN 'low' ELSE 'none' END AS stored_level,
  (u % 5 = 4 AND g % 2 = 1) AS is_tor
FROM (SELECT event_id, ts, user_id AS u, event_type,
             CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CAST(floor(user_id / 5) AS INT) AS g
      FROM {events}) e
"""

#: Nested networks of both families around the derived log's addresses, in the same two engines.
CITIES_SQL = """
SELECT network, concat('C', CAST(g % 5 AS STRING)) AS country, CASE WHEN g % 4 = 0 THEN '' ELSE concat('Town ', CAST(g % 7 AS STRING)) END AS city,
  CAST(g % 90 AS DOUBLE) AS latitude, CAST(0 - g % 180 AS DOUBLE) AS longitude
FROM (
  SELECT DISTINCT g, CASE k
      WHEN 0 THEN concat('34.', CAST(10 + g % 200 AS STRING), '.0.0/', CAST(12 + g % 5 AS STRING))
      WHEN 1 THEN concat('34.', CAST(10 + g % 200 AS STRING), '.7.', CAST(1 + g % 250 AS STRING), '/', CAST(24 + g % 9 AS STRING))
      WHEN 2 THEN concat('73.', CAST(g % 200 AS STRING), '.4.0/', CAST(8 + g % 20 AS STRING))
      WHEN 3 THEN concat('2001:DB8:0:0:0:0:0:', CAST(g AS STRING), '/', CAST(106 + g % 23 AS STRING))
      WHEN 4 THEN concat('192.42.116.', CAST(g % 256 AS STRING))
      ELSE '2001:db8::/40' END AS network
  FROM (SELECT CAST(floor(user_id / 5) AS INT) AS g, CAST(event_id % 6 AS INT) AS k FROM {events}) e
) n
"""
NETWORKS_SQL = """
SELECT network, 64000 + g % 40 AS asn, concat('Org ', CAST(g % 11 AS STRING)) AS org
FROM (
  SELECT DISTINCT g, CASE k
      WHEN 0 THEN concat('34.', CAST(10 + g % 200 AS STRING), '.7.0/24')
      WHEN 1 THEN '45.135.193.17/26'
      WHEN 2 THEN concat('73.', CAST(g % 256 AS STRING), '.0.0/14')
      WHEN 3 THEN concat('2001:db8::', CAST(g AS STRING), '/120')
      ELSE '192.0.0.0/3' END AS network
  FROM (SELECT CAST(floor(user_id / 5) AS INT) AS g, CAST(event_id % 5 AS INT) AS k FROM {events}) e
) n
"""

#: Fixed value: the combined log format.
_COMBINED = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "(\S+) (.+?) (\S+)" (\d+) (\d+|-) "([^"]*)" "([^"]*)"\z'
_STAMP = r"^\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}\z"
CHAIN = "struct<chain:array<string>,cf_connecting_ip:string,cf_ip_country:string,spoofed:boolean,claimed_ip:string>"
_DUMP = re.compile(r"logs_requests_\d{12}\.json$")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log with ``route`` (the URL as it is, as in imported logs)."""
    return _from_events(spark, sf_dir, DERIVED_SQL).withColumn("route", F.col("full_url"))


def derived_networks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tables of cities and networks around the derived log's addresses."""
    return _from_events(spark, sf_dir, CITIES_SQL), _from_events(spark, sf_dir, NETWORKS_SQL)


def _from_events(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = text.replace("{", "{{").replace("}", "}}").replace("{{events}}", "{events}")  # only this one is a place to fill
    return spark.sql(text, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def window(rows: DataFrame, start, end) -> DataFrame:
    """IPv4 requests with start <= created_at < end. Both conditions reach a Parquet scan."""
    return rows.where((F.col("created_at") >= F.lit(start)) & (F.col("created_at") < F.lit(end)) & is_ipv4(F.col("ip")))


def threats_only(rows: DataFrame) -> DataFrame:
    return rows.where(is_ipv4(F.col("ip")) & (F.col("threat_level") != "none") & ~F.coalesce("is_tor", F.lit(False)))


def since(rows: DataFrame, last_id: int) -> DataFrame:
    """Rows after a known id, in order."""
    if last_id < 0:
        raise ValueError("an id is not negative")
    return rows.where(F.col("id") > last_id).orderBy("id")


def recent(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest rows, newest first, of equal times the greatest id."""
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(most)


def parsed_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Requests of combined-format lines; lines of any other form, or with an impossible time, are left out.

    ``-`` is null, as is an empty agent. ``is_tor`` is null, the mark of imported rows.
    """
    part = lambda k: F.regexp_extract(F.col(line), _COMBINED, k)
    filled = lambda c: F.when(~c.isin("-", ""), c)
    rows = lines.where(F.col(line).rlike(_COMBINED)).select(
        part(1).alias("ip"), F.when(part(4).rlike(_STAMP), F.try_to_timestamp(part(4), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))).alias("created_at"), part(5).alias("method"), part(6).alias("full_url"), part(6).alias("route"),
        part(7).alias("protocol"), part(8).cast("int").alias("status_code"), filled(part(9)).cast("int").alias("response_size"), filled(part(10)).alias("referer"), filled(part(11)).alias("user_agent"), F.lit(None).cast("boolean").alias("is_tor"),
    )
    return rows.where("created_at IS NOT NULL")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All ``access.log*`` files of a folder, packed ones too, with the file's name."""
    lines = spark.read.option("pathGlobFilter", "access.log*").text(path)
    return parsed_log(lines.select("value"))


def imported(parsed: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Parsed log lines as request rows: classified without a body, source from the agent, no proxy chain.

    ``is_tor`` stays null, the mark of imported rows; the response time is 0.
    """
    catalog = catalog or load()
    rows = classify(parsed.drop("referer", "protocol"), catalog)
    return rows.withColumns({"source": source_of(F.col("user_agent"), catalog), "request_body": F.lit(None).cast("string"), "response_time_ms": F.lit(0), "forwarding_chain": F.lit(None).cast(CHAIN)})


def gap(rows: DataFrame, after, until) -> DataFrame:
    """Rows to import: after < created_at <= until."""
    return rows.where((F.col("created_at") > F.lit(after)) & (F.col("created_at") <= F.lit(until)))


def not_imported_yet(rows: DataFrame) -> DataFrame:
    """The given table, if it has no imported rows yet (``is_tor`` null); an error else."""
    if rows.where("is_tor IS NULL").limit(1).count():
        raise ValueError("the table already has imported rows")
    return rows


def last_live(rows: DataFrame) -> Column:
    return rows.where("is_tor IS NOT NULL").agg(F.max("created_at").alias("last_live"))


_DUMPED = "id long, ip string, method string, route string, full_url string, user_agent string, request_body string, status_code int, threat_level string, ip_type string, ip_location string, is_tor boolean, created_at string"
LOCATION = "country string, city string, latitude double, longitude double, asn int, org string"


def latest_dump(spark: SparkSession, folder: str) -> str:
    """The newest dump of a folder by name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().toString() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    found = sorted(n for n in names if _DUMP.search(n))
    if not found:
        raise FileNotFoundError(f"no dump in {folder}")
    return found[-1]


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON dump ``{"logs_requests": [...]}``. Locations are text in it; malformed ones become null.

    All tasks read, both where one object spans a whole file (see :mod:`gatewatch.sources.dumps`) and in a folder
    of JSON lines, as :func:`gatewatch.sources.sinks.write_dump` writes it.
    """
    where, fs = filesystem(spark, path)
    if fs.getFileStatus(where).isDirectory():
        kind = f"array<struct<{_DUMPED.replace(' ', ':').replace(',:', ', ')}>>"
        table = spark.read.schema(f"logs_requests {kind}").json(path)
        if table.where("logs_requests IS NULL").limit(1).count():
            raise ValueError("the dump has no list of requests")
        rows = table.select(F.explode("logs_requests").alias("r")).select("r.*")
    else:
        rows = requests_of(spark, path).select(F.from_json("request", _DUMPED).alias("r")).select("r.*")
    located = rows.withColumns({"ip_location": F.from_json("ip_location", LOCATION), "created_at": F.to_timestamp("created_at")})
    return located.withColumn("asn", F.col("ip_location.asn"))


def dump_name(at: datetime) -> str:
    """The name by which :func:`latest_dump` finds a dump."""
    return f"logs_requests_{at:%Y%m%d%H%M}.json"


def max_id(rows: DataFrame) -> int:
    found = rows.agg(F.max("id")).first()[0]
    if found is None:
        raise ValueError("there are no rows")
    return found


def read_exits(spark: SparkSession, path: str) -> DataFrame:
    """Exit addresses of the anonymity network, one a line; blank lines do not count."""
    return spark.read.text(path).select(F.trim("value").alias("ip")).where("ip <> ''").distinct()
