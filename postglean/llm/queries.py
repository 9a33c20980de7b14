"""Queries of the text problems: name to a function of (session, folder), and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import abuse, garbled, leakage, lookalike, mixture, neardup, newtext, personal

Query = Callable[[SparkSession, str], DataFrame]


def _m(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "messages")


def _d(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _p10(spark: SparkSession, folder: str) -> tuple[DataFrame, abuse.Scorer]:
    """The documents, parsed once, and their scorer."""
    read = abuse.read(_d(spark, folder))
    return read, abuse.fit(read, table(spark, folder, "doc_labels"))


_PAIRS = r"""
WITH w AS (SELECT DISTINCT msg_id, unnest(regexp_extract_all(lower(concat_ws(chr(10), coalesce(subject, ''), coalesce(body_plain, ''))), '[\p{L}\p{N}]+')) AS x FROM messages),
n AS (SELECT msg_id, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 25),
k AS (SELECT w.msg_id, x, n FROM w JOIN n USING (msg_id)),
c AS (SELECT a.msg_id AS msg_id_a, b.msg_id AS msg_id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_n FROM k a JOIN k b ON a.x = b.x AND a.msg_id < b.msg_id GROUP BY 1, 2)
"""


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: lookalike.disguised(_m(s, d), table(s, d, "watch_texts")),
        "p1_canonical": lambda s, d: lookalike.canonical_fields(_m(s, d)),
        "p2_found": lambda s, d: newtext.new_line_rows(_m(s, d)),
        "p2_new_text": lambda s, d: newtext.new_text(_m(s, d)),
        "p3_found": lambda s, d: garbled.garbled(_m(s, d)).select("msg_id", "field"),
        "p3_repaired": lambda s, d: garbled.repaired(_m(s, d)),
        "p5_found": lambda s, d: personal.mentions(_m(s, d)).select("msg_id", "field", "kind", "start_at"),
        "p5_redacted": lambda s, d: personal.redacted(_m(s, d)),
        "p7_found": lambda s, d: neardup.similar_pairs(_m(s, d)),
        "p7_groups": lambda s, d: neardup.groups(_m(s, d)),
        "p8_found": lambda s, d: leakage.matches(_d(s, d), table(s, d, "eval_items")).select("doc_id", "item_id"),
        "p8_matches": lambda s, d: leakage.all_matches(_d(s, d), table(s, d, "eval_items")),
        "p9_mixture": lambda s, d: mixture.mixture(_d(s, d), table(s, d, "mix_targets")),
        "p9_shares": lambda s, d: mixture.shares(mixture.mixture(_d(s, d), table(s, d, "mix_targets")), table(s, d, "mix_targets")),
        "p10_found": lambda s, d: abuse.scored(*_p10(s, d)).where("abusive").select("doc_id"),
        "p10_scores": lambda s, d: abuse.scored(*_p10(s, d)),
        "p10_rates": lambda s, d: abuse.rates(*_p10(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    """Brute force where whole tables allow it."""
    return {
        "p8_found": r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
        "p8_matches": r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dt AS (SELECT doc_id, k, array_to_string(w[k:k+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d)),
it AS (SELECT item_id, k, array_to_string(w[k:k+2], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS k FROM i)),
h AS (SELECT DISTINCT doc_id, item_id, it.k AS p, dt.k - it.k AS s FROM dt JOIN it USING (g)),
r AS (SELECT doc_id, item_id, s, p - row_number() OVER (PARTITION BY doc_id, item_id, s ORDER BY p) AS o FROM h),
e AS (SELECT doc_id, item_id, max(n) + 2 AS longest_run FROM (SELECT doc_id, item_id, s, o, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL HAVING max(n) >= 10),
b AS (SELECT DISTINCT doc_id, item_id, p, s + unnest([-2, -1, 0]) AS s FROM h),
c AS (SELECT doc_id, item_id, count(*) OVER (PARTITION BY doc_id, item_id, s ORDER BY p RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM b),
n AS (SELECT doc_id, item_id, max(n) AS best_window FROM c GROUP BY ALL HAVING max(n) >= 4)
SELECT doc_id, item_id, CASE WHEN longest_run IS NULL THEN 'near' ELSE 'exact' END AS kind, longest_run, best_window, len(w) AS item_words FROM n LEFT JOIN e USING (doc_id, item_id) JOIN i USING (item_id)""",
        "p7_found": _PAIRS + "SELECT msg_id_a, msg_id_b FROM c WHERE both_n::DOUBLE / (na + nb - both_n) >= 0.7",
        "p7_groups": _PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + r""",
l AS (SELECT msg_id_a AS a, msg_id_b AS b FROM c WHERE both_n::DOUBLE / (na + nb - both_n) >= 0.7 UNION SELECT msg_id_b, msg_id_a FROM c WHERE both_n::DOUBLE / (na + nb - both_n) >= 0.7),
r AS (SELECT msg_id, msg_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.msg_id),
e AS (SELECT msg_id_a AS a, msg_id_b AS b FROM c WHERE both_n = na AND both_n = nb)
SELECT n.msg_id, least(n.msg_id, coalesce((SELECT min(a) FROM e WHERE b = n.msg_id), n.msg_id)) AS class_id, (SELECT min(root) FROM r WHERE r.msg_id = n.msg_id) AS group_id FROM n""",
    }
