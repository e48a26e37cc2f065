"""Pairing of requests with responses, and lookups that hold for a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from flowlens.session import ship


def pair_next(rows: DataFrame, key: list[str], order: list[str], is_request: Column, keep: list[str]) -> DataFrame:
    """Requests whose next row of the same key is a response: the columns of both, the response's as next_*."""
    over = Window.partitionBy(*key).orderBy(*order)
    both = rows.withColumns({"__request": is_request} | {f"next_{c}": F.lead(c).over(over) for c in keep}).withColumn("__answer", F.lead(~F.col("__request")).over(over))
    return both.filter("__request and __answer").drop("__request", "__answer")


def pair_fifo(requests: DataFrame, responses: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The n-th request of a key with its n-th response; columns as request and response structs."""
    over = Window.partitionBy(*key).orderBy(*order)

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*key, F.row_number().over(over).alias("n"), F.struct(*[c for c in rows.columns if c not in key]).alias(name))

    return numbered(requests, "request").join(numbered(responses, "response"), [*key, "n"])


def pair_correlated(requests: DataFrame, responses: DataFrame, key: list[str], within: int, ts: str = "timestamp_ns") -> DataFrame:
    """Every response with the request of its key (which has the correlation id) that came last before it, by `within` at most;
    responses without one stay, and equal ones stay apart. Of requests at one time the greatest struct counts.

    Both sides are laid into buckets of `within`, a request also into the next one, and merged there in order of time. So
    work is linear, and a busy key is spread over its buckets.
    """
    own = [c for c in requests.columns if c not in key]
    bucket = F.floor(F.col(ts) / within)
    asked = requests.select(*key, F.explode(F.array(bucket, bucket + 1)).alias("__bucket"), F.col(ts).alias("__at"), F.lit(0).alias("__kind"), F.struct(*own).alias("request"), F.lit(None).cast(responses.schema).alias("__response"))
    answers = responses.select(*key, bucket.alias("__bucket"), F.col(ts).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(requests.select(F.struct(*own).alias("r")).schema["r"].dataType).alias("request"), F.struct(*responses.columns).alias("__response"))
    over = Window.partitionBy(*key, "__bucket").orderBy("__at", "__kind", "request").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = asked.unionByName(answers).withColumn("__last", F.last(F.when(F.col("__kind") == 0, F.struct("__at", "request")), ignorenulls=True).over(over)).filter("__kind = 1")
    return merged.select("__response.*", F.when(F.col("__at") - F.col("__last.__at") <= within, F.col("__last.request")).alias("request"))


def validity(dns: DataFrame, ip: str = "ip", since: str = "inserted_at", ttl: str = "ttl") -> DataFrame:
    """When each answer counts: from its arrival until its time is up or the next answer for the address comes."""
    following = F.lead(since).over(Window.partitionBy(ip).orderBy(since, "domain"))
    return dns.withColumn("valid_until", F.least(F.col(since) + F.col(ttl), F.coalesce(following, F.col(since) + F.col(ttl)))).filter(F.col("valid_until") > F.col(since))


def asof_domain(rows: DataFrame, dns: DataFrame, address: str, ts: str, bucket: int, ip: str = "ip", since: str = "inserted_at", ttl: str = "ttl") -> DataFrame:
    """rows with `domain`, the name that its address had at its time; null if none was valid.

    Answers are laid into buckets of time, as many as they are valid in, and rows are joined on address and bucket. So a
    busy address is spread over its buckets, and at most one answer matches a row.
    """
    spans = validity(dns, ip, since, ttl).select(
        F.col(ip).alias("__ip"), "domain", F.col(since).alias("__since"), F.col("valid_until").alias("__until"),
        F.explode(F.sequence(F.floor(F.col(since) / bucket), F.floor((F.col("valid_until") - 1) / bucket))).alias("__bucket"))
    keyed = rows.withColumn("__at", F.floor(F.col(ts) / bucket))
    match = (F.col(address) == F.col("__ip")) & (F.col("__at") == F.col("__bucket")) & (F.col(ts) >= F.col("__since")) & (F.col(ts) < F.col("__until"))
    return keyed.join(spans, match, "left").select(*rows.columns, "domain")


def memoised(lookups: DataFrame, key: list[str], name: str, ttl: int, ts: str = "timestamp_ns", order: list[str] | None = None) -> DataFrame:
    """lookups (of which `name` is what a key would be resolved to just then) with `memo`, the name that a memo gives: what was
    resolved first, until it is ttl old; the next lookup resolves anew. Lookups of a key are taken in order of time and
    stream by: one name is held, however many there are."""
    ship(lookups.sparkSession)
    rows = lookups.withColumn("__key", F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))
    ordered = rows.repartition("__key").sortWithinPartitions("__key", ts, *(order or []))
    at = [ordered.columns.index(c) for c in ("__key", ts, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, since, held = None, 0, None
        for batch in batches:
            out = []
            for k, t, value in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if k != now or t - since >= ttl:
                    now, since, held = k, t, value
                out.append(held)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, batch.column(at[2]).type)], [*batch.schema.names, "memo"])

    shape = StructType([*ordered.schema.fields, StructField("memo", ordered.schema[name].dataType)])
    return ordered.mapInArrow(run, shape).drop("__key")


def addresses_of(dns: DataFrame, ip: str = "ip", since: str = "inserted_at") -> DataFrame:
    """The latest address of each domain."""
    return dns.groupBy("domain").agg(F.max_by(ip, F.struct(since, ip)).alias(ip))


def unexpired(dns: DataFrame, now: int, since: str = "inserted_at", ttl: str = "ttl") -> DataFrame:
    """Answers still valid at `now`; names that have none left are gone with them."""
    return dns.filter(F.col(since) + F.col(ttl) > now)


def dns_answers(messages: DataFrame) -> DataFrame:
    """The A records in messages' headers: ip, domain, ttl, inserted_at (ns)."""
    record = messages.select("timestamp_ns", F.explode(F.filter("headers", lambda h: h["name"] == "dns_a_record")).alias("h")).select("timestamp_ns", F.split("h.value", "\\|", 3).alias("p"))
    return record.select(F.col("p")[0].alias("domain"), F.try_element_at("p", F.lit(2)).try_cast("long").alias("ip"), F.try_element_at("p", F.lit(3)).try_cast("long").alias("ttl"), F.col("timestamp_ns").alias("inserted_at")).filter("ip is not null and ttl is not null")
