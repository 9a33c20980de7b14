"""A mixture of sources with target shares of all tokens, by raking and calibrated sampling."""

from __future__ import annotations

import base64
import re
import warnings
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import tokenizer_dir

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
LANGUAGES = ("en", "de", "fr", "es")
#: Kinds of documents by their heading; the first that fits counts.
TOPICS = (
    ("mail", r"^From: "),
    ("case", r"(?i)^(case|vorgang|dossier|caso|expediente)\b"),
    ("questions", r"(?i)^(q&a|fragen|questions|dudas|preguntas)"),
    ("guide", r"(?i)^(how|wie|comment|cómo)\b"),
    ("notes", r"(?i)^(notes|hinweise|notas)\b"),
)
ROUNDS, TOLERANCE, BINS = 5_000, 1e-9, 4096


@lru_cache(maxsize=4)
def encoding(folder: str, name: str = TOKENIZER):
    import tiktoken

    path = Path(folder) / name
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.open("rb"))}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_LONG = re.compile(r"[^\s]{20000,}|\s{20000,}")


def count_tokens(text: str | None, folder: str) -> int:
    """Tokens of the whole text; null has none. Runs without a break are encoded in pieces of bounded length."""
    if not text:
        return 0
    enc = encoding(folder)
    if not _LONG.search(text):
        return len(enc.encode_ordinary(text))
    return sum(len(enc.encode_ordinary(text[i : i + 10_000])) for i in range(0, len(text), 10_000))


def sized(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """``doc_id, source, language, topic, tokens, u``; ``u`` in [0, 1) is a hash of doc_id and decides the sampling.

    Languages are in lower case, other and null ones are ``other``. Null and empty texts have 0 tokens.
    """
    folder = folder or tokenizer_dir()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count_tokens(t, folder) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "language", "topic", "u")), pa.array(n, pa.int64())], names=["doc_id", "source", "language", "topic", "u", "tokens"])

    topic = F.lit("other")
    for name, pattern in reversed(TOPICS):
        topic = F.when(F.col("text").rlike(pattern), name).otherwise(topic)
    lang = F.lower(F.trim("lang"))
    language = F.when(lang.isin(*LANGUAGES), lang).otherwise("other")
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = documents.select("doc_id", "source", "text", language.alias("language"), topic.alias("topic"), u.alias("u"))
    return rows.mapInArrow(run, "doc_id bigint, source string, language string, topic string, u double, tokens bigint")


def rake(tokens: np.ndarray, targets: list[np.ndarray], caps: np.ndarray) -> np.ndarray:
    """Weights w for cells of an array (source, language, topic): the margins of ``tokens * w`` come to ``targets``.

    Margins are fitted in turn, the first one last and therefore exactly, as far as ``caps`` on the weights of a source
    allow; what a capped cell can't give is asked of the other cells of its margin.
    """
    w = np.where(tokens > 0, 1.0, 0.0)
    cap = np.broadcast_to(caps.reshape(-1, *[1] * (tokens.ndim - 1)), tokens.shape)
    axes = [tuple(a for a in range(tokens.ndim) if a != k) for k in range(tokens.ndim)]
    shape = [tuple(-1 if a == k else 1 for a in range(tokens.ndim)) for k in range(tokens.ndim)]

    def scale(k: int, w: np.ndarray) -> np.ndarray:
        for _ in range(w.size + 1):  # each turn but the last brings another cell to its cap
            now = (tokens * w).sum(axes[k])
            less = targets[k] <= now  # all cells shrink; only those below their cap grow
            open_cells = np.where(less.reshape(shape[k]), True, w < cap * (1 - 1e-12))
            free = (tokens * np.where(open_cells, w, 0)).sum(axes[k])
            f = np.where(free > 0, (targets[k] - (now - free)) / np.where(free > 0, free, 1), 1.0).clip(0)
            new = np.minimum(np.where(open_cells, w * f.reshape(shape[k]), w), cap)
            if np.allclose(new, w, rtol=1e-12):
                break
            w = new
        return w

    for _ in range(ROUNDS):
        before = w
        for k in [*range(1, tokens.ndim), 0]:
            w = scale(k, w)
        if np.abs(w - before).max() < TOLERANCE:
            return w
    short = max(float(np.abs((tokens * w).sum(a) - t).max() / max(t.sum(), 1e-12)) for a, t in zip(axes, targets))
    warnings.warn(f"raking did not settle in {ROUNDS} rounds: the targets and caps can't all be met, the farthest share is off by {short:.4f}", stacklevel=2)
    return w


def _wanted(names: list[str], have: np.ndarray, goal: dict[str, float] | None) -> np.ndarray:
    """Shares of a margin: those of ``goal`` among the names that have tokens, scaled to 1; the corpus's own without a goal."""
    share = have / have.sum() if goal is None else np.array([max(float(goal.get(n, 0.0)), 0.0) for n in names]) * (have > 0)
    if share.sum() <= 0:
        raise ValueError("no target share belongs to a name that has tokens")
    return share / share.sum()


def plan(
    sized_docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, max_sources: int = 10_000, languages: dict[str, float] | None = None, topics: dict[str, float] | None = None
) -> tuple[list[tuple], float]:
    """Weight (mean copies) of every (source, language, topic) cell, and the mixture's size in tokens.

    Shares are those of the sources that have documents, scaled to 1. Without ``total_tokens`` the mixture is as large as
    all shares can be met exactly. ``languages`` and ``topics`` are target shares too; without them the documents' own shares
    are kept. Only sums per cell reach the driver: at most ``max_sources`` x languages x topics.
    """
    goal = {r[0]: (float(r[1]), float(r[2])) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats").limit(max_sources + 1).collect()}
    if len(goal) > max_sources:
        raise ValueError(f"more than {max_sources} target sources")
    names = F.broadcast(targets.select("source").distinct())  # bounded by max_sources, checked above
    sums = sized_docs.where("tokens > 0").join(names, "source", "left_semi").groupBy("source", "language", "topic").agg(F.sum("tokens").alias("t")).collect()
    sums = [r for r in sums if r[0] in goal]
    if not sums:
        return [], 0.0
    sources, langs, kinds = (sorted({r[k] for r in sums}) for k in range(3))
    cells = np.zeros((len(sources), len(langs), len(kinds)))
    for s, g, t, n in sums:
        cells[sources.index(s), langs.index(g), kinds.index(t)] = n
    share = np.array([goal[s][0] for s in sources])
    share /= share.sum()
    caps = np.array([goal[s][1] for s in sources])
    have = cells.sum((1, 2))
    size = total_tokens or float((have * caps / share).min())
    margins = [share * size, _wanted(langs, cells.sum((0, 2)), languages) * size, _wanted(kinds, cells.sum((0, 1)), topics) * size]
    w = rake(cells, margins, caps)
    rows = [(sources[i], langs[j], kinds[k], float(w[i, j, k]), float(cells[i, j, k])) for i, j, k in zip(*np.nonzero(cells))]
    return rows, size


def mixture(
    documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, folder: str | None = None, languages: dict[str, float] | None = None, topics: dict[str, float] | None = None
) -> DataFrame:
    """``doc_id, source, tokens, copies``: the documents taken, each at most ``max_repeats`` times.

    A document of a cell with weight w comes floor(w) times, and once more when its u lies below a cut times the rest
    of w. The cut is near 1 and calibrated per source, on a histogram of its tokens over u by the rest, so that the taken
    tokens meet the share and not only their expectation. Sources without target, targets without documents and null
    texts take no part.
    """
    from ..session import cut_lineage

    docs = cut_lineage(sized(documents, folder))
    cells, _ = plan(docs, targets, total_tokens, languages=languages, topics=topics)
    if not cells:
        return docs.select("doc_id", "source", "tokens", F.lit(0).cast("bigint").alias("copies")).limit(0)
    spark = documents.sparkSession
    weights = F.broadcast(spark.createDataFrame([c[:4] for c in cells], "source string, language string, topic string, weight double"))
    rest = F.col("weight") - F.floor("weight")
    rows = docs.where("tokens > 0").join(weights, ["source", "language", "topic"]).withColumn("rest", rest)
    rows = rows.withColumn("bin", F.when(F.col("rest") > 0, F.least(F.floor(F.col("u") / F.col("rest") * (BINS // 2)), F.lit(BINS).cast("bigint"))).otherwise(BINS))
    bins = rows.groupBy("source", "bin").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("rest")).alias("w"))
    # Cut: the bin at which the source's running tokens come nearest to the wanted ones.
    by = bins.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("bin", "t"))).alias("bins"), F.sum("w").alias("want"))
    run = F.aggregate(
        F.filter("bins", lambda b: b["bin"] < BINS),
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("cut"), F.col("want").alias("gap")),
        lambda a, b: F.struct(
            (a["sum"] + b["t"]).alias("sum"),
            F.when(F.abs(a["sum"] + b["t"] - F.col("want")) < a["gap"], b["bin"] + 1).otherwise(a["cut"]).alias("cut"),
            F.least(a["gap"], F.abs(a["sum"] + b["t"] - F.col("want"))).alias("gap"),
        ),
    )
    cuts = F.broadcast(by.select("source", run["cut"].alias("cut")))  # bounded: one row per target source
    copies = F.floor("weight") + F.when(F.col("bin") < F.col("cut"), 1).otherwise(0)
    return rows.join(cuts, "source").select("doc_id", "source", "tokens", copies.cast("bigint").alias("copies")).where("copies > 0")


def shares(taken: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, documents, taken_tokens, actual_share, most_copies, reachable, wanted_share`` of every target source.

    A source is ``reachable`` if the mixture holds a document of it; ``wanted_share`` is its target among the reachable ones.
    """
    got = taken.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("taken_tokens"), F.max("copies").alias("most_copies"))
    rows = targets.join(got, "source", "left").select("source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "taken_tokens", "most_copies")])
    rows = rows.withColumn("reachable", F.col("documents") > 0)
    reached = F.when(F.col("reachable"), F.col("target_share")).otherwise(0.0)
    total = rows.agg(F.sum("taken_tokens").alias("all"), F.sum(reached).alias("open"))
    part = lambda a, b: F.when(F.col(b) > 0, a / F.col(b)).otherwise(0.0)
    return rows.crossJoin(F.broadcast(total)).select("*", part(F.col("taken_tokens"), "all").alias("actual_share"), part(reached, "open").alias("wanted_share")).drop("all", "open")  # one row
