"""Text decoded with a wrong encoding: affected fields found, originals restored.

Each record's text gives evidence for every encoding chain (bytes of one encoding read in another). Which chains a
source and field suffer from is latent: expectation-maximisation over the records of a (source, field) pools the weak
evidence, and a record is judged and repaired by the posterior of its chains.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, met

FIELDS = ("subject", "body_plain")
#: Encodings in which UTF-8 bytes are read by mistake.
READ_AS = ("cp1252", "cp850", "cp437", "mac_roman", "cp1251")
#: One-byte chains: (written in, read as).
ONE_BYTE = (("cp1251", "cp1252"),)
#: Log-likelihood ratios of one sequence against clean text: surely garbled, readable as chance, decodes to a rare sign.
SURE, CHANCE, WEAK, RARE = 9.0, 1.5, 0.6, -0.5
LEAST, MOST = -4, 24
#: Rows of a table of sources up to which it is sent to every task.
SENT_ROWS = 100_000
#: Prior share of affected records, its weight in records, accepted posterior, iterations, parts of a hot source.
PRIOR, PRIOR_RECORDS, ACCEPT, ROUNDS, SALT = 0.002, 50.0, 0.5, 20, 16


def _char(code: str, byte: int) -> str:
    try:
        return bytes([byte]).decode(code)
    except UnicodeDecodeError:
        return chr(byte)


@lru_cache(maxsize=None)
def _chain(code: str) -> tuple[re.Pattern[str], dict[str, int]]:
    """Pattern of UTF-8 sequences read in ``code``, and each character's byte."""
    chars = {b: {_char(code, b)} | ({chr(b)} if code == "cp1252" and b < 0xA0 else set()) for b in range(0x80, 0x100)}
    one = lambda lo, hi: "[" + re.escape("".join(sorted(c for b in range(lo, hi) for c in chars[b]))) + "]"
    more = one(0x80, 0xC0)
    back = {c: b for b, cs in chars.items() for c in cs}
    return re.compile(f"{one(0xC2, 0xE0)}{more}|{one(0xE0, 0xF0)}{more}{{2}}|{one(0xF0, 0xF5)}{more}{{3}}"), back


@lru_cache(maxsize=200_000)
def _undo(code: str, seq: str) -> str | None:
    back = _chain(code)[1]
    try:
        return bytes(back[c] for c in seq).decode("utf-8")
    except (UnicodeDecodeError, KeyError):
        return None


def _usual(ch: str) -> bool:
    """Whether a character is usual in the texts of any script the store holds: letters, punctuation, signs, emoji."""
    o = ord(ch)
    return 0xA0 <= o <= 0x17F or 0x370 <= o <= 0x45F or 0x1E00 <= o <= 0x20CF or 0x2100 <= o <= 0x27BF or 0x3000 <= o <= 0x9FFF or 0xF900 <= o <= 0xFFEF or 0x1D400 <= o <= 0x1FAFF or o in (0x490, 0x491, 0x4AF, 0x4BB, 0x501, 0x51B, 0x51D, 0x192, 0x2C6, 0x2DC, 0x301, 0x308, 0x300, 0x303, 0x302)


@lru_cache(maxsize=200_000)
def _weight(code: str, seq: str) -> float:
    """Log-likelihood ratio of one sequence under the chain against clean text."""
    made = _undo(code, seq)
    if made is None:
        return 0.0
    if not _usual(made):
        return RARE
    if len(seq) == 2 and seq.isalpha() and not (seq[0].islower() and seq[1].isupper()):
        return CHANCE if code in ("cp1251", "mac_roman") or code != "cp1252" and seq.islower() or seq[1] in "ŠŒŽšœžŸªº" else SURE
    if len(seq) == 2 and code == "mac_roman" and seq[0] in "¬–—”’‘÷◊ÀÃÕ€‹›ﬁŒœ":
        return WEAK  # punctuation next to a letter or to other punctuation: only many of them tell
    return SURE


_WORDS = {("cp1251", "cp1252"): re.compile("(?<![A-Za-z])[À-ÿ¨¸²³¿¯]{2,}(?![A-Za-z])")}
_MARKS = re.compile(r"(?:(?<=\s)|^)\?{3,}(?=[\s,.!:;]|$)")
_INSIDE = re.compile(r"(?<=[A-Za-z])\?(?=[a-z])")
_LINKS = re.compile(r"\S*(?:://|www\.)\S*")


def evidence(text: str) -> dict[str, float]:
    """Log-likelihood ratio against clean text of every chain that some sequence of ``text`` speaks for."""
    out: dict[str, float] = {}
    rest = text
    if not text.isascii():
        best: dict[str, list[str]] = {}
        for code in READ_AS:
            if seqs := [s for s in _chain(code)[0].findall(text) if _undo(code, s) is not None]:
                best[code] = seqs
        for code, seqs in best.items():
            if (total := sum(_weight(code, s) for s in seqs)) > 0:
                out[f"utf-8>{code}"] = total
        for wrote, read in ONE_BYTE:
            if runs := _WORDS[wrote, read].findall(rest):
                total = sum(min(3.0 * (len(r) - 2), SURE) for r in runs)
                if total:
                    out[f"{wrote}>{read}"] = total
        if "�" in text:
            out["lost>replacement"] = float(MOST)
    if "?" in text:
        plain = _LINKS.sub(" ", text)
        if total := SURE * len(_MARKS.findall(plain)) + CHANCE * len(_INSIDE.findall(plain)):
            out["lost>question marks"] = total
    return out


def repair(text: str, chains: list[str]) -> str:
    """``text`` with the sequences of ``chains`` put back, again and again for text garbled several times.

    The chain that explains the most goes first; what was lost for good (replacement or question marks) stays. Every round
    that changes something makes the text shorter in UTF-8, or ends.
    """
    size = len(text.encode("utf-8", "replace")) + 1
    while len(text.encode("utf-8", "replace")) < size:
        before, size = text, len(text.encode("utf-8", "replace"))
        ranked = sorted(((v, k) for k, v in evidence(text).items() if k in chains and v > 0), reverse=True)
        for _, chain in ranked[:1]:
            wrote, _, read = chain.partition(">")
            if wrote == "utf-8":
                text = _chain(read)[0].sub(lambda m: _undo(read, m[0]) or m[0], text)
            elif (wrote, read) in _WORDS:
                text = _WORDS[wrote, read].sub(lambda m: m[0].encode(read, "replace").decode(wrote, "replace"), text)
        if text == before:
            break
    return text


def chain_evidence(messages: DataFrame) -> DataFrame:
    """``msg_id, source, field, chain, llr``, one row per field and chain with some evidence.

    ``source`` is the sender's domain ('' without one). Null and empty texts give no row; texts of plain ASCII without
    runs of question marks are left out before Python sees them.
    """
    source = F.lower(F.coalesce(F.nullif(F.regexp_extract("from_addr", r"@([^@>\s]+)", 1), F.lit("")), F.lit("")))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])
    rows = messages.select("msg_id", source.alias("source"), F.explode(F.filter(fields, lambda x: x["text"].rlike(r"[^\x00-\x7F]|\?\?\?|[A-Za-z]\?[a-z]"))).alias("x")).select("msg_id", "source", "x.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, c, v) for i, t in enumerate(b.column("text").to_pylist()) for c, v in evidence(t).items()]
            found = [(i, c, min(v, float(MOST))) for i, c, v in found]
            at = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n).take(at) for n in ("msg_id", "source", "field")), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.float64())],
                names=["msg_id", "source", "field", "chain", "llr"],
            )

    return rows.mapInArrow(run, "msg_id bigint, source string, field string, chain string, llr double")


def chain_shares(found: DataFrame, messages: DataFrame) -> DataFrame:
    """``source, field, chain, share``: the part of a source's fields that a chain affects, by expectation-maximisation.

    Records meet as counts of (source, field, chain, rounded evidence), pre-aggregated before the shuffle: a source of
    any size is a row with at most ``MOST - LEAST`` bins, in which the iterations run.
    """
    domain = F.lower(F.coalesce(F.nullif(F.regexp_extract("from_addr", r"@([^@>\s]+)", 1), F.lit("")), F.lit("")))
    size = messages.groupBy(domain.alias("source")).agg(F.count("*").cast("double").alias("records"))
    bins = found.groupBy("source", "field", "chain", F.least(F.greatest(F.round("llr"), F.lit(float(LEAST))), F.lit(float(MOST))).alias("l")).agg(F.count("*").cast("double").alias("n"))
    rows = bins.groupBy("source", "field", "chain").agg(F.collect_list(F.struct(F.exp("l").alias("r"), "n")).alias("bins")).join(size.hint("merge"), "source")
    step = lambda p: F.aggregate("bins", F.lit(PRIOR * PRIOR_RECORDS), lambda s, b: s + b["n"] * p * b["r"] / (p * b["r"] + 1 - p)) / (F.col("records") + PRIOR_RECORDS)
    share = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.lit(0.05), lambda p, _: F.least(F.greatest(step(p), F.lit(1e-6)), F.lit(0.99)))
    return rows.select("source", "field", "chain", share.alias("share"))


def garbled(messages: DataFrame) -> DataFrame:
    """``msg_id, field, chains``: fields with a garbled sequence, and the chains with a posterior of ``ACCEPT`` or more.

    Every stored message is a case of its own. The evidence is spread over ``SALT`` parts of its source for the join, so a
    source with a third of all records is no single task.
    """
    found = chain_evidence(messages)
    shares = chain_shares(found, messages).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    odds = F.exp("llr") * F.col("share") / (1 - F.col("share"))
    return (
        found.withColumn("salt", F.pmod(F.xxhash64("msg_id"), F.lit(SALT)).cast("int"))
        .join(shares.hint("merge"), ["source", "field", "chain", "salt"])
        .where(odds / (1 + odds) >= ACCEPT)
        .groupBy("msg_id", "field")
        .agg(F.sort_array(F.collect_set("chain")).alias("chains"))
    )


def repaired(messages: DataFrame) -> DataFrame:
    """``msg_id, field, chains, text, restored``: the affected fields with the text put back as far as possible.

    ``restored`` tells whether nothing garbled is left. Repeated rows of one ``msg_id`` come out as often as they are.
    The texts don't shuffle: the shares of the chains go to every task, where each text's posterior is worked out beside
    its repair. Only with more than ``SENT_ROWS`` affected sources the chains are joined to the texts instead.
    """
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in FIELDS])).alias("x")
    domain = F.lower(F.coalesce(F.nullif(F.regexp_extract("from_addr", r"@([^@>\s]+)", 1), F.lit("")), F.lit("")))
    rows = messages.select("msg_id", domain.alias("source"), fields).select("msg_id", "source", "x.*").where("raw is not null")
    found = chain_evidence(messages)
    shares = cut_lineage(chain_shares(found, messages).groupBy("source", "field").agg(F.map_from_entries(F.collect_list(F.struct("chain", "share"))).alias("shares")))
    if shares.limit(SENT_ROWS + 1).count() > SENT_ROWS:
        ready = rows.join(garbled(messages).hint("merge"), ["msg_id", "field"]).select("msg_id", "field", "raw", F.map_from_arrays("chains", F.transform("chains", lambda _: F.lit(0.99))).alias("shares"))
    else:
        ready = met(rows, shares, ["source", "field"], limit=SENT_ROWS).select("msg_id", "field", "raw", "shares")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, chains, made, left = [], [], [], []
            for i, (text, known) in enumerate(zip(b.column("raw").to_pylist(), b.column("shares").to_pylist())):
                known = dict(known)
                odds = {c: exp(min(v, float(MOST))) * known[c] / (1 - known[c]) for c, v in evidence(text).items() if c in known}
                own = sorted(c for c, o in odds.items() if o / (1 + o) >= ACCEPT)
                if own:
                    text = repair(text, own)
                    at.append(i), chains.append(own), made.append(text), left.append(not any(v >= SURE for v in evidence(text).values()))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("msg_id").take(take), b.column("field").take(take), pa.array(chains, pa.list_(pa.string())), pa.array(made, pa.string()), pa.array(left, pa.bool_())], names=["msg_id", "field", "chains", "text", "restored"])

    return ready.mapInArrow(run, "msg_id bigint, field string, chains array<string>, text string, restored boolean")
