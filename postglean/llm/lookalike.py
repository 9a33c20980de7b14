"""Text that looks the same brought to one form, and the fields that only look like a watched text.

The work is SQL that DuckDB runs on each Arrow batch of a partition: ``translate`` for compatibility forms and
look-alike letters, regular expressions for invisible characters and spaces, ``nfc_normalize`` for accents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Letters of other scripts that are drawn like Latin ones.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Һ": "h", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ѵ": "v", "ӏ": "l", "Ӏ": "I", "ɡ": "g",
    "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j", "ω": "w", "η": "n",
}
LATIN = {"ı": "i", "ȷ": "j", "ɑ": "a", "ɩ": "i", "ʏ": "y", "ᴏ": "o", "ⅼ": "l", "к": "k", "т": "t", "м": "m", "в": "b", "н": "h", "ǀ": "l", "∣": "l"}
#: Characters without a visible form; bidirectional marks, joiners, selectors and tags among them.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E0FFF}]"
SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{2800}\x{3000}]+"
#: Beyond these, characters may be other forms of something; most texts hold none and skip the long mapping.
UNPLAIN = r"[^\x00-\x7F\x{00A1}\x{00A7}\x{00AB}\x{00AE}\x{00B0}\x{00BB}\x{00BF}-\x{0131}\x{2013}\x{2014}\x{2018}-\x{201E}\x{20AC}]"
FIELDS = ("from_display", "subject", "body_plain")


@lru_cache(maxsize=1)
def compatibility_forms() -> tuple[str, str, dict[str, str]]:
    """Single characters and what they stand for (two strings of one length), and those that stand for several letters."""
    one, many = {}, {}
    for code in range(0xA1, 0x20000):
        ch = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        to = unicodedata.normalize("NFKC", ch)
        if to == ch or unicodedata.normalize("NFC", ch) != ch or to[0].isspace():
            continue
        if len(to) == 1:
            one[ch] = to
        elif to.isalpha() and to.isascii():
            many[ch] = to
    return "".join(one), "".join(one.values()), many


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical_sql(x: str) -> str:
    """SQL for the consistent form of ``x``: no invisible characters, plain compatibility forms, one kind of space, NFC."""
    src, dst, many = compatibility_forms()
    long = f"[{''.join(many)}]"
    step = f"translate(regexp_replace({x}, '{INVISIBLE}', '', 'g'), {_text(src)}, {_text(dst)})"
    full = step
    for a, b in many.items():
        full = f"replace({full}, {_text(a)}, {_text(b)})"
    step = f"CASE WHEN regexp_matches({x}, {_text(long)}) THEN {full} ELSE {step} END"
    return f"nfc_normalize(trim(regexp_replace({step}, '{SPACE}', ' ', 'g')))"


def skeleton_sql(x: str) -> str:
    """SQL that maps look-alike letters of canonical text ``x`` to one letter; texts that read alike become equal."""
    table = {**LATIN, **GREEK, **CYRILLIC}
    return f"nfc_normalize(translate({x}, {_text(''.join(table))}, {_text(''.join(table.values()))}))"


def one_script_sql(x: str) -> str:
    """SQL that brings each word of canonical text ``x`` into one script: words that read alike become equal.

    A letter that only one script draws decides (Latin before Cyrillic before Greek); words of look-alikes alone become
    Latin. Words that read alike have the same such letters, so the decision is the same for both.
    """
    shared = {**GREEK, **CYRILLIC}
    latin = "".join(c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and c not in shared.values() and c not in LATIN)
    to_cyrillic = {b: a for a, b in CYRILLIC.items() if a not in "ҮүԁӀѵѴ"} | {a: next(c for c, d in CYRILLIC.items() if d == b) for a, b in GREEK.items() if b in CYRILLIC.values()}
    to_greek = {b: a for a, b in GREEK.items()} | {a: next(c for c, d in GREEK.items() if d == b) for a, b in CYRILLIC.items() if b in GREEK.values()}
    only = lambda lo, hi, table: "".join(c for c in map(chr, range(lo, hi)) if c.isalpha() and c not in table)
    step = lambda table: f"translate(w, {_text(''.join(table))}, {_text(''.join(table.values()))})"
    rules = ((latin, {**LATIN, **shared}), (only(0x400, 0x530, CYRILLIC), to_cyrillic), (only(0x370, 0x400, GREEK), to_greek))
    cases = " ".join(f"WHEN regexp_matches(w, '[{letters}]') THEN {step(table)}" for letters, table in rules)
    word = f"CASE WHEN NOT regexp_matches(w, '[\\x{{250}}-\\x{{52F}}]') THEN w {cases} ELSE {step({**LATIN, **shared})} END"
    return f"nfc_normalize(array_to_string(list_transform(string_split({x}, ' '), lambda w: {word}), ' '))"


def _connect(watch: pa.Table | None = None):
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE MACRO canonical(x) AS CASE WHEN x IS NULL THEN NULL WHEN NOT regexp_matches(x, '{UNPLAIN}') THEN trim(regexp_replace(x, '\\s+', ' ', 'g')) ELSE {canonical_sql('x')} END")
    con.execute(f"CREATE MACRO skeleton(x) AS CASE WHEN NOT regexp_matches(x, '[^\\x00-\\x7F]') THEN x ELSE {skeleton_sql('x')} END")
    con.execute(f"CREATE MACRO one_script(x) AS CASE WHEN NOT regexp_matches(x, '[\\x{{250}}-\\x{{52F}}]') THEN x ELSE {one_script_sql('x')} END")
    if watch is not None:
        con.register("given", watch)
        con.execute("CREATE TABLE watch AS SELECT watch_id, kind, watch_text, skeleton(canonical(watch_text)) AS form FROM given WHERE trim(watch_text) <> ''")
    return con


def canonical_fields(messages: DataFrame) -> DataFrame:
    """``msg_id`` with ``from_display, subject, body_plain`` in the consistent form, whole texts; null stays null, '' stays ''.

    Forms of one character are unified and each word is brought into one script, so that words which read alike are
    equal; case stays. Rows are taken as they come, so
    ties and repeated rows stay. Not shuffled.
    """
    sql = "SELECT msg_id, " + ", ".join(f"one_script(canonical({f})) AS {f}" for f in FIELDS) + " FROM part"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        for part in batches:
            con.register("part", part)
            yield from con.sql(sql).to_arrow_table().cast(schema).to_batches()

    schema = pa.schema([("msg_id", pa.int64()), *[(f, pa.string()) for f in FIELDS]])
    return messages.select("msg_id", *FIELDS).mapInArrow(run, "msg_id bigint, " + ", ".join(f"{f} string" for f in FIELDS))


def disguised(messages: DataFrame, watch_texts: DataFrame, max_watched: int = 10_000) -> DataFrame:
    """``msg_id, field, watch_id``: fields that show a watched text without containing it character for character.

    A ``display_name`` must be the whole of ``from_display``, a ``phrase`` may stand anywhere in the other fields; case
    counts. Null and empty texts match nothing; equal watched texts under two ids are two rows. ``watch_texts`` goes to
    every task in blocks of about ``max_watched`` rows, each met by all messages. Columns of clashing names are not read.
    """
    rows = watch_texts.select("watch_id", "kind", "watch_text")
    blocks = rows.count() // max_watched + 1
    parts = [_disguised(messages, rows.where(F.pmod(F.xxhash64("watch_id", "watch_text"), F.lit(blocks)) == i).collect()) for i in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _disguised(messages: DataFrame, rows: list) -> DataFrame:
    given = pa.table({"watch_id": [r[0] for r in rows], "kind": [r[1] for r in rows], "watch_text": [r[2] for r in rows]}, schema=pa.schema([("watch_id", pa.int64()), ("kind", pa.string()), ("watch_text", pa.string())]))
    # A text of ASCII without runs of spaces or line ends hides nothing: it contains what it shows.
    sql = """
        WITH fields AS (
            SELECT msg_id, unnest(['from_display', 'subject', 'body_plain']) AS field, unnest([from_display, subject, body_plain]) AS raw FROM part
        ), forms AS MATERIALIZED (
            SELECT msg_id, field, raw, skeleton(canonical(raw)) AS form FROM fields WHERE regexp_matches(raw, '[^\\x20-\\x7E]|  ')
        )
        SELECT msg_id, field, watch_id FROM forms JOIN watch
        ON CASE WHEN kind = 'display_name' THEN field = 'from_display' AND forms.form = watch.form AND trim(raw) <> watch_text
                WHEN kind = 'phrase' THEN field <> 'from_display' AND contains(forms.form, watch.form) AND NOT contains(raw, watch_text)
                ELSE false END
    """
    schema = pa.schema([("msg_id", pa.int64()), ("field", pa.string()), ("watch_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect(given)
        for part in batches:
            con.register("part", part)
            yield from con.sql(sql).to_arrow_table().cast(schema).to_batches()

    return messages.select("msg_id", *FIELDS).mapInArrow(run, "msg_id bigint, field string, watch_id bigint")
