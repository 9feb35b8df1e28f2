"""Proxy policy as arithmetic over tables: no sockets."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.hashing import fnv1a_hex
from tarn.functions.urls import domain_of, is_onion

BACKOFF_BASE_MS, BACKOFF_CAP_MS = 250.0, 8000.0
LOOPBACK = "127.0.0.1"
COOLDOWN_MS = 5000


def parse_proxies(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """spec, at, host, port of the well-formed endpoints of comma lists; an empty host is loopback."""
    pieces = specs.select(spec, F.posexplode(F.split(spec, ",", -1)).alias("at", "piece")).withColumn("piece", F.regexp_replace("piece", r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    host, port = F.regexp_extract("piece", r"^([\s\S]*):([^:]*)$", 1), F.regexp_extract("piece", r"^[\s\S]*:[ \t]*\+?(\d{1,9})[^:]*$", 1)
    own = F.when(host == "", LOOPBACK).otherwise(host)
    fit = pieces.select(spec, "at", own.alias("host"), port.try_cast("int").alias("port"))
    return fit.where(F.col("port").between(1, 65535))


def endpoint_key(host: Column, port: Column) -> Column:
    return F.concat_ws(":", host, port.cast("string"))


def socks_url(host: Column, port: Column) -> Column:
    return F.concat(F.lit("socks5h://"), endpoint_key(host, port))


def isolation_token(url: Column | str, scope: str = "domain") -> Column:
    """s- and 16 hex digits of the domain's (or the whole url's) hash; '' for scope none."""
    if scope == "none":
        return F.lit("")
    col = F.col(url) if isinstance(url, str) else url
    return F.concat(F.lit("s-"), fnv1a_hex(domain_of(col) if scope == "domain" else col))


def circuit_token(url: Column | str, at_ms: Column, rotate_ms: int = 0, scope: str = "domain") -> Column:
    """isolation_token(), new after every `rotate_ms`; 0 never rotates."""
    token = isolation_token(url, scope)
    return F.concat(token, F.lit("-"), F.floor(at_ms / rotate_ms).cast("string")) if rotate_ms > 0 else token


def backoff_ms(attempt: Column, base: float = BACKOFF_BASE_MS, cap: float = BACKOFF_CAP_MS, jitter: Column | None = None) -> Column:
    """min(cap, base * 2^attempt), plus jitter (0 to base; none by default), capped."""
    step = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))
    return F.least(F.lit(cap), step + (jitter if jitter is not None else F.lit(0.0))).cast("long")


def backoff_jitter(base: float = BACKOFF_BASE_MS, seed: int | None = None) -> Column:
    return F.rand(seed if seed is not None else random.randrange(1 << 31)) * base


def pool_status(probes: DataFrame) -> DataFrame:
    """status of the pool: up if any endpoint is, unknown without probes. `probes` has status."""
    return probes.agg(F.when(F.max((F.col("status") == "up").cast("int")) == 1, "up").when(F.count("*") == 0, "unknown").otherwise("down").alias("status"))


def uses_endpoint(last_probe: Column) -> Column:
    """One proxy: used exactly where its last probe was up, whatever the url."""
    return last_probe == "up"


def assign_round_robin(requests: DataFrame, endpoints: DataFrame, order: str = "request_id") -> DataFrame:
    """requests with host, port: the healthy endpoints in turn; null where none is.

    endpoints (host, port, healthy, ms_since_failure) is a pool's worth of rows; an endpoint that
    failed is back after its cooldown.
    """
    from tarn.plans.ids import dense_ids

    usable = endpoints.where(F.col("healthy") | (F.coalesce("ms_since_failure", F.lit(0)) >= COOLDOWN_MS))
    pool = usable.agg(F.array_sort(F.collect_list(F.struct("host", "port"))).alias("pool"))
    turn = dense_ids(requests, [order], "_turn").join(F.broadcast(pool), F.lit(True))
    pick = F.when(F.size("pool") > 0, F.get("pool", (F.col("_turn") % F.size("pool")).cast("int")))
    return turn.withColumn("_pick", pick).select(*requests.columns, "_pick.host", "_pick.port")


def max_retries(url: Column | str, healthy: Column, onion_retries: int = 2) -> Column:
    """onion urls: a fixed number; others: the healthy endpoints less one."""
    return F.when(is_onion(url), F.lit(onion_retries)).otherwise(F.greatest(healthy - 1, F.lit(0)))


def fetch_stats(log: DataFrame, url: str = "url", attempt: str = "attempt", ok: str = "ok", ms: str = "ms") -> DataFrame:
    """One row over a fetch log: requests, onion requests and failures, retries, failures, mean ms."""
    onion = is_onion(url)
    return log.agg(
        F.count("*").alias("requests"),
        F.coalesce(F.sum(onion.cast("long")), F.lit(0)).alias("onion_requests"),
        F.coalesce(F.sum((onion & ~F.col(ok)).cast("long")), F.lit(0)).alias("onion_failures"),
        F.coalesce(F.sum((F.col(attempt) > 0).cast("long")), F.lit(0)).alias("retries"),
        F.coalesce(F.sum((~F.col(ok)).cast("long")), F.lit(0)).alias("failures"),
        F.avg(ms).alias("mean_ms"),
    )


def attempts(log: DataFrame, url: str = "url", ts: str = "ts") -> DataFrame:
    """log with attempt: 0 for the first fetch of a url, then 1, 2, ..."""
    return log.withColumn("attempt", F.row_number().over(Window.partitionBy(url).orderBy(ts)) - 1)
