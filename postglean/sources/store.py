"""The mail store as tables: latest-wins upserts, lookups, recent rows, offsets."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEYS = ["mailbox", "uid"]


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order`` (nulls first; full ties: any of the equal rows).

    A partial maximum runs before the shuffle, so repeated writes of one key meet as one row per task.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys; ``new`` must have one row per key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_keeping(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """As :func:`upsert`, but ``kept`` columns of a known key keep their old values."""
    was = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in kept])
    merged = new.join(was, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in kept else F.col(c) for c in new.columns])
    return upsert(old, merged, keys)


def offsets(emails: DataFrame) -> DataFrame:
    """``mailbox, last_uid``: where each mailbox's reading goes on; no rows for mailboxes never read."""
    return emails.groupBy("mailbox").agg(F.coalesce(F.max("uid"), F.lit(0)).alias("last_uid"))


def recent_events(emails: DataFrame, verdicts: DataFrame, n: int) -> DataFrame:
    """The n latest emails with their verdicts; defaults stand in for a missing verdict."""
    e = emails.select("mailbox", "uid", "subject", "sender", "received_at")
    v = verdicts.select("mailbox", "uid", "score", "verdict", "reasons_json")
    rows = e.join(v, KEYS, "left").orderBy(F.desc_nulls_last("received_at"), F.desc("uid"), "mailbox").limit(n)
    return rows.select(*KEYS, "subject", "sender", "received_at", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("verdict", F.lit("ALLOW")).alias("verdict"), F.coalesce(F.from_json("reasons_json", "array<string>"), F.array().cast("array<string>")).alias("reasons"))


def verdict_of(verdicts: DataFrame, mailbox: str, uid: int) -> DataFrame:
    return verdicts.where((F.col("mailbox") == mailbox) & (F.col("uid") == uid))


def with_mailbox(rows: DataFrame, emails: DataFrame) -> DataFrame:
    """``rows`` (uid) with the least mailbox of an email of that uid, '' where there is none."""
    m = emails.groupBy("uid").agg(F.min("mailbox").alias("_m"))
    return rows.join(m, "uid", "left").withColumn("mailbox", F.coalesce("_m", F.lit(""))).drop("_m")


def best_known(profiles: DataFrame, key: str = "display", total: str = "messages") -> DataFrame:
    """Per ``key`` the profile with the most messages (ties: the least sender)."""
    return profiles.where(F.col(key) != "").groupBy(key).agg(F.min_by("sender", F.struct(-F.col(total), "sender")).alias("sender"), F.max(total).alias(total))


def verdict_counts(verdicts: DataFrame, by: list[str | Column]) -> DataFrame:
    return verdicts.groupBy(*by).agg(F.count("*").alias("n"))


def emails_table(messages: DataFrame) -> DataFrame:
    """Rows of the mail store of parsed messages; the time of arrival is that of the ingest."""
    return messages.select("mailbox", "uid", "subject", F.col("from_addr").alias("sender"), F.col("ingested_at").alias("received_at"), F.to_json("headers").alias("raw_headers_json"), F.col("ingested_at").alias("saved_at"))


def verdicts_table(scored: DataFrame, at: Column) -> DataFrame:
    """Rows of the verdict store of scored messages: reasons and component scores as JSON."""
    return scored.select("mailbox", "uid", "score", F.col("level").alias("verdict"), F.to_json("reasons").alias("reasons_json"), F.to_json("component_scores").alias("component_scores_json"), at.alias("created_at"))


def audit_rows(scored: DataFrame, at: Column) -> DataFrame:
    """One row per action taken: what was done, why, when; messages that are let through leave none."""
    why = F.concat_ws("; ", F.concat(F.lit("level "), F.col("level")), F.array_join("reasons", "; "))
    return scored.where("action.action <> 'none'").select("mailbox", "uid", F.col("action.action").alias("action_taken"), why.alias("reason"), at.alias("logged_at"))


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a table that only grows (audit, tracking events, feedback)."""
    rows.write.mode("append").parquet(path)


#: Tables of the store with their columns.
SCHEMAS = {
    "emails": "mailbox string, uid bigint, subject string, sender string, received_at timestamp, raw_headers_json string, saved_at timestamp",
    "verdicts": "mailbox string, uid bigint, score double, verdict string, reasons_json string, component_scores_json string, created_at timestamp",
    "audit_log": "mailbox string, uid bigint, action_taken string, reason string, logged_at timestamp",
    "mailbox_state": "mailbox string, last_uid bigint",
    "test_events": "mailbox string, uid bigint, event string, at timestamp",
    "test_feedback": "mailbox string, uid bigint, feedback string, at timestamp",
    "users": "email string, name string, role string, password_hash string, created_at timestamp",
    "inbox": "id string, sender string, recipient string, subject string, body string, read boolean, at timestamp",
}


def create_tables(spark: SparkSession, path: str) -> list[str]:
    """Creates the tables that are missing under ``path`` and gives their names; existing ones stay as they are."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    made = []
    for name, schema in SCHEMAS.items():
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")):
            spark.createDataFrame([], schema).write.parquet(f"{path}/{name}")
            made.append(name)
    return made


def migrated(rows: DataFrame, name: str, emails: DataFrame | None = None) -> DataFrame:
    """``rows`` of an older layout in the columns of table ``name``: missing ones are null, a missing mailbox comes from ``emails``."""
    if "mailbox" in SCHEMAS[name] and "mailbox" not in rows.columns and emails is not None and "uid" in rows.columns:
        rows = with_mailbox(rows, emails)
    wanted = [c.split() for c in SCHEMAS[name].split(", ")]
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted])


def users(table: DataFrame) -> DataFrame:
    """All users without their passwords, by address."""
    return table.select(F.lower("email").alias("email"), *[c for c in ("name", "role", "created_at") if c in table.columns])


def inbox(messages: DataFrame, recipient: str, n: int) -> DataFrame:
    """The n latest messages to a recipient."""
    return messages.where(F.lower("recipient") == recipient.lower()).orderBy(F.desc("at"), F.desc("id")).limit(n)


def mark_read(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """``messages`` with ``read`` set for the given ``id`` rows."""
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    return messages.join(hit, "id", "left").withColumn("read", F.coalesce("_hit", "read")).drop("_hit")


def baseline(emails: DataFrame, mailbox: str) -> DataFrame:
    """``last_uid`` of one mailbox, 0 where nothing was read yet."""
    return emails.agg(F.coalesce(F.max(F.when(F.col("mailbox") == mailbox, F.col("uid"))), F.lit(0)).alias("last_uid"))


def latest_match(emails: DataFrame, text: str, after_uid: int = 0) -> DataFrame:
    """Per mailbox the email with the greatest uid above ``after_uid`` whose subject contains ``text``."""
    hit = emails.where(F.contains("subject", F.lit(text)) & (F.col("uid") > after_uid))
    return hit.groupBy("mailbox").agg(F.max("uid").alias("uid"), F.max_by("subject", F.struct("uid", "subject")).alias("subject"))


def password_hash(password: str, salt: bytes, rounds: int = 120_000) -> str:
    """PBKDF2 with SHA-256 as ``salt$hash`` in hex."""
    return f"{salt.hex()}${hashlib.pbkdf2_hmac('sha256', password.encode(), salt, rounds).hex()}"


def password_fits(password: str, stored: str, rounds: int = 120_000) -> bool:
    """Compares in constant time; a malformed stored value fits nothing."""
    salt, _, _ = stored.partition("$")
    try:
        return hmac.compare_digest(password_hash(password, bytes.fromhex(salt), rounds), stored)
    except ValueError:
        return False
