"""Activation messages for marketing platforms: payloads, eligibility, plans. Nothing is sent."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.rfm import positions

# Platforms with the customer's fields that they need, and the
# fields of a formatted record: (name, column), or a prefix for all attributes.
NEEDS = {"Braze": ("email", "external_id"), "Iterable": ("email",), "Klaviyo": ("email",), "Salesforce": ("email",), "HubSpot": ("email",), "Segment": (), "RudderStack": (), "Custom": ()}
FORMATS: dict[str, tuple] = {
    "Braze": (("email", "email"), ("external_id", "external_id"), ("segment", "segment")),
    "Iterable": (("email", "email"), ""),
    "Klaviyo": (("email", "email"), ("phone", "phone"), ("list", "segment")),
    "Salesforce": (("object", "=Contact"), ("Email", "email")),
    "HubSpot": (("object", "=contact"), ("email", "email"), ("hs_lead_status", "segment")),
    "Segment": (("email", "email"), "traits_"),
    "RudderStack": (("email", "email"), ("anonymousId", "segment")),
    "Custom": (),
}
PLATFORMS = tuple(NEEDS)
# Where a platform would be reached, and how it is told who calls. Nothing here calls.
ENDPOINTS = {
    "Braze": "https://rest.iad-01.braze.com/users/track",
    "Iterable": "https://api.iterable.com/api/users/bulkUpdate",
    "Klaviyo": "https://a.klaviyo.com/api/v1/person",
    "Segment": "https://api.segment.com/v1/batch",
    "Salesforce": "https://instance.salesforce.com/services/data/v57.0/sobjects/Contact",
    "HubSpot": "https://api.hubapi.com/crm/v3/objects/contacts",
    "RudderStack": "https://api.rudderstack.com/v1/identify",
    "Custom": "https://example.com/activate",
}
SCHEMES = {"Iterable": ("Api-Key", ""), "Klaviyo": ("Authorization", "Klaviyo-API-Key "), "Segment": ("Authorization", "Basic ")}
EVENTS = ("SegmentAssignment", "SegmentRemoval", "PropertyUpdate", "ListAdd", "ListRemove")


def valid_for(platform: Column) -> Column:
    """Whether the customer has what the platform needs: any of its fields."""
    out = F.lit(False)
    for name, needs in NEEDS.items():
        holds = F.lit(True) if not needs else F.coalesce(*[F.col(c) for c in needs]).isNotNull()
        out = F.when(platform == name, holds).otherwise(out)
    return out


def eligible(platform: Column) -> Column:
    return (F.coalesce(F.col("customer_id"), F.lit("")) != "") & valid_for(platform)


def _attributes(prefix: str) -> Column:
    entries = F.array_sort(F.map_entries("attributes"))
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit(f"|{prefix}"), e["key"], F.lit(":"), e["value"])), "")


def formatted(platform: str) -> Column:
    """The record as ``customer_id:x|name:value...``; missing fields are left out, attributes are in order of name."""
    parts = [F.concat(F.lit("customer_id:"), F.col("customer_id"))]
    for item in FORMATS[platform]:
        if isinstance(item, str):
            parts.append(F.coalesce(_attributes(item), F.lit("")))
        else:
            name, column = item
            value = F.lit(column[1:]) if column.startswith("=") else F.col(column)
            parts.append(F.coalesce(F.concat(F.lit(f"|{name}:"), value), F.lit("")))
    return F.concat(*parts)


def payload() -> Column:
    """The generic payload of a message as a map; null fields are left out and properties win."""
    names = ("customer_id", "event_type", "platform", "timestamp", "email", "segment")
    own = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]), lambda k, v: v.isNotNull())
    extra = F.coalesce(F.col("properties"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(extra), k))
    return F.map_concat(kept, extra)


def platform_fields(platform: str) -> Column:
    """The payload in the platform's own field names, as a map without nulls."""
    attributes, text = F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>")), F.to_json("attributes")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = {
        "Braze": {"external_id": F.col("customer_id"), "email": F.col("email"), "custom_attributes": text, "segment": F.col("segment")},
        "Iterable": {"email": blank("email"), "dataFields": text, "listId": F.col("segment")},
        "Klaviyo": {"email": blank("email"), "phone_number": F.col("phone"), "properties": text, "list_id": F.col("segment")},
        "Salesforce": {"Email": F.col("email"), "External_Id__c": F.col("customer_id"), "Segment__c": F.col("segment")},
        "HubSpot": {"email": F.col("email"), "hs_lead_status": blank("segment")},
        "Segment": {"userId": F.col("customer_id"), "email": F.col("email"), "traits": text},
        "RudderStack": {"email": F.col("email"), "anonymousId": F.col("customer_id"), "traits": text},
    }.get(platform)
    if own is None:
        return payload()
    out = F.map_filter(F.create_map(*[x for n, c in own.items() for x in (F.lit(n), c)]), lambda k, v: v.isNotNull())
    if platform in ("Salesforce", "HubSpot"):
        prefix = "custom_" if platform == "HubSpot" else ""
        flat = F.transform_keys(attributes, lambda k, v: F.concat(F.lit(prefix), k))
        out = F.map_concat(out, F.map_filter(flat, lambda k, v: ~F.array_contains(F.map_keys(out), k)))
    return out


def endpoint(platform: Column) -> Column:
    """Where a message for the platform would go; null for one that isn't known."""
    return F.create_map(*[F.lit(x) for pair in ENDPOINTS.items() for x in pair])[platform]


def auth_header(platform: str, key: str) -> tuple[str, str]:
    name, prefix = SCHEMES.get(platform, ("Authorization", "Bearer "))
    return name, prefix + key


def retry_delays(tries: int, first_ms: int = 1_000, factor: float = 2.0) -> list[int]:
    """Waits between tries, each longer by a factor."""
    return [int(first_ms * factor**i) for i in range(tries)]


def deduplicated(messages: DataFrame) -> DataFrame:
    """The first by seq of each customer, platform and event."""
    order = Window.partitionBy("customer_id", "platform", "event_type").orderBy("seq")
    return messages.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def messages(customers: DataFrame, platforms: list[str], event: str = "SegmentAssignment") -> DataFrame:
    """A message for each customer and platform."""
    if event not in EVENTS:
        raise ValueError(f"unknown event {event}")
    return customers.withColumn("platform", F.explode(F.array(*[F.lit(p) for p in platforms]))).withColumn("event_type", F.lit(event))


def processed(messages_: DataFrame, configured: list[str]) -> DataFrame:
    """What a batch would come to: success, or the reason why not."""
    error = F.when(~eligible(F.col("platform")), "not eligible").when(~F.col("platform").isin(configured), "platform not configured")
    return messages_.withColumn("error", error).withColumn("success", F.col("error").isNull())


def statistics(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total_messages"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)).alias("success_rate"))


def triggers(webhooks: DataFrame, event: str) -> DataFrame:
    return webhooks.where(F.col("active") & (F.col("event_type") == event))


# Records for a customer-data store.

ID_CHARS = 24
SEGMENT_TYPES = ("rfm", "kmeans", "kprototypes", "behavioral", "lifecycle", "lookalike", "custom")


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first digits of the SHA-256 of the parts, parted by the unit separator."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, ID_CHARS))


def membership_records(members: DataFrame, source: str = "tessella") -> tuple[DataFrame, DataFrame]:
    """Records of (segment, segment_type, customer_id, score) and the rows that are refused.

    A customer id must be there and mustn't look like a mail address.
    """
    trimmed = members.withColumn("customer_id", F.trim(F.col("customer_id").cast("string")))
    why = F.when(F.coalesce(F.col("customer_id"), F.lit("")) == "", "customer_id is required").when(F.col("customer_id").contains("@"), "customer_id must be opaque").when(~F.col("segment_type").isin(*SEGMENT_TYPES), "unsupported segment_type")
    at = trimmed.withColumn("reason", why)
    segment = stable_id("seg_", F.trim("segment"), F.col("segment_type"), F.lit(""))
    good = at.where("reason IS NULL").withColumn("segmentId", segment)
    records = good.select(F.concat_ws(":", "segmentId", "customer_id").alias("name"), stable_id("mem_", F.col("segmentId"), F.col("customer_id")).alias("membershipId"), "segmentId", F.col("customer_id").alias("customerId"), "score", F.lit(source).alias("source"))
    return records, at.where("reason IS NOT NULL")


def batched(records: DataFrame, key: str, size: int = 500) -> DataFrame:
    """Adds ``batch``, numbered from 0 in order of the key, and an idempotency key for each batch, which follows from its records alone.

    All batches but the last are full. Positions come from ranges, so that no
    task orders all records.
    """
    if not 1 <= size <= 5000:
        raise ValueError("a batch has 1 to 5000 records")
    out = positions(records, [F.col(key).asc()], "_at").withColumn("batch", F.floor(F.col("_at") / size).cast("bigint")).drop("_at")
    whole = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(records.columns)])
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(whole)), "\x1e"), 256)  # of ``size`` records at most
    return out.join(out.groupBy("batch").agg(digest.alias("idempotency_key")), "batch")


#: Fields of the two record kinds: name, type, whether unique, whether nullable.
FIELDS = {
    "audienceSegments": (("segmentId", "TEXT", True, False), ("segmentType", "TEXT", False, False), ("memberCount", "NUMBER", False, False), ("definitionHash", "TEXT", False, True), ("generatedAt", "DATE_TIME", False, False), ("source", "TEXT", False, False), ("schemaVersion", "TEXT", False, False)),
    "audienceSegmentMemberships": (("membershipId", "TEXT", True, False), ("segmentId", "TEXT", False, False), ("customerId", "TEXT", False, False), ("score", "NUMBER", False, True), ("rfmSegment", "TEXT", False, True), ("assignedAt", "DATE_TIME", False, False), ("source", "TEXT", False, False), ("schemaVersion", "TEXT", False, False)),
}
KEYS = {"audienceSegments": "segmentId", "audienceSegmentMemberships": "membershipId"}


def manifest(spark: SparkSession) -> DataFrame:
    rows = [(kind, *f) for kind, fields in FIELDS.items() for f in fields]
    return spark.createDataFrame(rows, "object string, name string, type string, unique boolean, nullable boolean")


def segment_records(segments: DataFrame, source: str = "tessella") -> DataFrame:
    """Records of (segment, segment_type, member_count); a negative count is an error."""
    count = F.when(F.col("member_count") < 0, F.raise_error(F.lit("member_count must be 0 or more")).cast("bigint")).otherwise(F.col("member_count").cast("bigint"))
    return segments.select(F.trim("segment").alias("name"), stable_id("seg_", F.trim("segment"), F.col("segment_type"), F.lit("")).alias("segmentId"), F.col("segment_type").alias("segmentType"), count.alias("memberCount"), F.lit(source).alias("source"))


def write_plan(records: DataFrame, kind: str, size: int = 500) -> DataFrame:
    """The operations that would write the records: a lookup and an upsert per batch, told apart by its key. Nothing is called."""
    key = KEYS[kind]
    per = batched(records, key, size).groupBy("batch", "idempotency_key").agg(F.count("*").alias("records"))
    return per.select(F.lit(kind).alias("object"), F.lit(key).alias("match_field"), F.lit(f"/rest/{kind}").alias("lookup_path"), F.lit(f"/rest/{kind}/upsert").alias("upsert_path"), "batch", "idempotency_key", "records")


# Plugins.


@dataclass
class Plugin:
    """A named operator: a function of a frame and its parameters."""

    name: str
    run: Callable[[DataFrame, dict], DataFrame]
    version: str = "1.0.0"
    kind: str = "Custom"
    parameters: dict = field(default_factory=dict)
    check: Callable[[DataFrame], bool] = lambda frame: True


class Registry:
    def __init__(self):
        self.plugins: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> None:
        self.plugins[plugin.name] = plugin

    def execute(self, name: str, frame: DataFrame, **parameters) -> DataFrame:
        if name not in self.plugins:
            raise ValueError(f"there is no plugin {name}")
        plugin = self.plugins[name]
        if not plugin.check(frame):
            raise ValueError(f"{name} can't take this input")
        return plugin.run(frame, plugin.parameters | parameters)

    def info(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p.name, p.version, p.kind) for p in self.plugins.values()], "name string, version string, kind string")


def _mean_class(frame: DataFrame, given: dict) -> DataFrame:
    total = F.aggregate("features", F.lit(0.0), lambda s, v: s + v)
    return frame.withColumn("class", (total / F.size("features") > given["threshold"]).cast("int"))


def _deviations(frame: DataFrame, given: dict) -> DataFrame:
    return frame.select(F.posexplode("features")).groupBy(F.col("pos").alias("feature")).agg(F.stddev_pop("col").alias("std_dev"))


def built_in() -> Registry:
    out = Registry()
    out.register(Plugin("mean_classifier", _mean_class, kind="Classification", parameters={"threshold": 0.5}))
    out.register(Plugin("std_dev", _deviations))
    return out
