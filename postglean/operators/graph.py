"""Relations between addresses, messages and domains as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import text_or_empty
from ..session import cut_lineage


def edges(messages: DataFrame) -> DataFrame:
    """``src, dst, type, at``: SENT (sender to recipient), CONTAINS (message to link), HOSTED_ON (link to domain).

    Repeated relations stay as many edges as they are; empty ends make none.
    """
    sender = F.lower(text_or_empty(F.col("from_addr")))
    everyone = F.array_distinct(F.concat(F.coalesce("recipients", F.array().cast("array<string>")), F.coalesce("cc", F.array().cast("array<string>"))))
    sent = messages.select(sender.alias("src"), F.explode(F.transform(everyone, F.lower)).alias("dst"), F.lit("SENT").alias("type"), F.col("ingested_at").alias("at"))
    links = messages.select(F.concat(F.lit("message:"), F.col("msg_id").cast("string")).alias("m"), F.explode("urls").alias("u"), F.col("ingested_at").alias("at"))
    contains = links.select(F.col("m").alias("src"), F.concat(F.lit("url:"), F.col("u.normalized")).alias("dst"), F.lit("CONTAINS").alias("type"), "at")
    hosted = links.where("u.domain <> ''").select(F.concat(F.lit("url:"), F.col("u.normalized")).alias("src"), F.concat(F.lit("domain:"), F.lower("u.domain")).alias("dst"), F.lit("HOSTED_ON").alias("type"), "at")
    return sent.unionByName(contains).unionByName(hosted).where("src <> '' and dst <> '' and src is not null and dst is not null")


def nodes(edge_rows: DataFrame) -> DataFrame:
    """``id, degree``: every end of an edge once, with the number of edges at it."""
    return edge_rows.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def ego(edge_rows: DataFrame, start: DataFrame, radius: int = 2, salt: int = 16) -> DataFrame:
    """``start, id, distance``: nodes within ``radius`` undirected steps of each row of ``start`` (column ``id``).

    Edges are pre-aggregated to one per pair and laid in ``salt`` parts of their end, so a hub is no single task.
    """
    both = edge_rows.select("src", "dst").unionByName(edge_rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    parts = cut_lineage(both.withColumn("part", F.pmod(F.xxhash64("dst"), F.lit(salt))))
    found = start.where("id is not null").select(F.col("id").alias("start"), "id", F.lit(0).alias("distance")).distinct()
    for d in range(1, radius + 1):
        ends = found.where(F.col("distance") == d - 1).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint"))))
        step = ends.join(parts.withColumnRenamed("src", "id").hint("merge"), ["id", "part"]).select("start", F.col("dst").alias("id"), F.lit(d).alias("distance"))
        found = found.unionByName(step).groupBy("start", "id").agg(F.min("distance").alias("distance"))
    return found


def temporal(edge_rows: DataFrame) -> DataFrame:
    """``src, dst, type, n, first, last, per_day`` of each pair; spans under an hour count as one."""
    days = F.greatest((F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 86_400e6, F.lit(1 / 24))
    return edge_rows.groupBy("src", "dst", "type").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.round(F.count("*") / days, 6).alias("per_day"))


def shared_hosts(edge_rows: DataFrame) -> DataFrame:
    """``domain, links, messages``: how many links and messages point to each domain."""
    contains = edge_rows.where("type = 'CONTAINS'").select(F.col("src").alias("message"), F.col("dst").alias("url")).distinct()
    hosted = edge_rows.where("type = 'HOSTED_ON'").select(F.col("src").alias("url"), F.col("dst").alias("domain")).distinct()
    return contains.join(hosted, "url").groupBy("domain").agg(F.countDistinct("url").alias("links"), F.countDistinct("message").alias("messages"))


def communities(edge_rows: DataFrame, rounds: int = 5) -> DataFrame:
    """``id, label`` by label propagation: each node takes the label most of its edges lead to (ties: the least)."""
    both = cut_lineage(edge_rows.select("src", "dst").unionByName(edge_rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("*").alias("w")))
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "label").agg(F.sum("w").alias("w"))
        labels = cut_lineage(votes.groupBy("src").agg(F.max_by("label", F.struct("w", F.lit(0))).alias("x"), F.max("w").alias("w")).join(votes.withColumnRenamed("w", "v"), "src").where("v = w").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("label")))
    return labels


def infrastructure(edge_rows: DataFrame, judged: DataFrame) -> DataFrame:
    """``domain, messages, hours, burstiness, neighbour_reputation`` of each link domain.

    ``judged``: ``message`` (id of a message node) and ``bad`` (0 or 1). The reputation is the share of bad messages among
    those that link to the domain, smoothed by one message of the overall share; burstiness is the share of its messages
    in its busiest hour.
    """
    contains = edge_rows.where("type = 'CONTAINS'").select(F.col("src").alias("message"), F.col("dst").alias("url"), "at")
    hosted = edge_rows.where("type = 'HOSTED_ON'").select(F.col("src").alias("url"), F.col("dst").alias("domain")).distinct()
    rows = contains.join(hosted.hint("merge"), "url").groupBy("domain", "message").agg(F.min("at").alias("at"))
    rows = rows.join(judged.select("message", F.col("bad").cast("double").alias("bad")).hint("merge"), "message", "left")
    overall = judged.agg(F.coalesce(F.avg(F.col("bad").cast("double")), F.lit(0.0)).alias("all"))
    hourly = rows.groupBy("domain", F.date_trunc("hour", "at").alias("hour")).agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.count("bad").alias("known"))
    out = hourly.groupBy("domain").agg(F.sum("n").alias("messages"), F.count("*").alias("hours"), F.max("n").alias("most"), F.sum("bad").alias("bad"), F.sum("known").alias("known"))
    return out.crossJoin(F.broadcast(overall)).select("domain", "messages", "hours", (F.col("most") / F.col("messages")).alias("burstiness"), ((F.col("bad") + F.col("all")) / (F.col("known") + 1)).alias("neighbour_reputation"))  # one row
