"""Emails reduced to the text their sender newly wrote.

Line rules in four languages name quote prefixes, attribution lines, forwarded headers, signatures, closing formulas,
device lines and legal notices. Replies between quoted lines stay. Texts of HTML mail take the quotation from the
markup's ``blockquote`` elements, whose lines are those of the visible text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .garbled import evidence, repair

FIELDS = ("body_plain", "visible_text")
# Words of mail programs and letters in English, German, French and Spanish.
QUOTE = re.compile(r"^\s{0,3}(?:[>|]|&gt;|[A-Z]{1,3}>)")
MONTH = r"(?:jan|feb|fév|mar|mär|apr|avr|abr|may|mai|mayo|jun|juin|jul|juil|aug|aoû|ago|sep|oct|okt|nov|dec|dez|déc|dic|ene)[\w.é]*"
DATE = rf"(?:\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\.?\s+(?:de\s+)?{MONTH}\s+(?:de\s+)?\d{{4}}|{MONTH}\s+\d{{1,2}},?\s+\d{{4}})"
ATTRIBUTION = re.compile(
    rf"^(?:(?:on|am|le|el|at|il|em)\s+)?(?:[^\W\d]{{2,10}}\.?,?\s+)?(?:(?:den|dem|the)\s+)?{DATE}\b[^\n]{{0,220}}(?:\b(?:wrote|writes|schrieb|geschrieben|a\s+écrit|écrit|escribió)\b(?!\s*,?\s*(?:that|dass|que)\b)[^\n]{{0,90}}|>\)?)\s*:\s*$"
    rf"|^(?:(?:on|am|le|el)\s+)?(?:[^\W\d]{{2,10}}\.?,?\s+)?{DATE}[^\n.!?]{{0,100}},[^\n.!?]{{2,60}}:\s*$",
    re.I,
)
STARTS = re.compile(rf"^(?:(?:on|am|le|el)\s+)?(?:[^\W\d]{{2,10}}\.?,?\s+)?{DATE}", re.I)
FORWARD = re.compile(r"^\s*-{2,}\s*(?:original|forwarded|begin forwarded|ursprüngliche|weitergeleitete|message|mensaje|mail|nachricht)[^-]{0,40}-{2,}\s*$|^\s*begin forwarded message\s*:", re.I)
HEADER_FROM = re.compile(r"^\s*\**(?:from|von|de|expéditeur|remitente|date|sent|gesendet|envoyé|enviado)\**\s?:\**\s?\S", re.I)
HEADER_REST = re.compile(r"^\s*\**(?:sent|date|to|cc|subject|gesendet|datum|an|betreff|envoyé|à|objet|enviado(?: el)?|fecha|para|asunto|from|von|de)\**\s?:", re.I)
DELIMITER = re.compile(r"^\s*(?:--|—|–|―|[_=~+]{2,}|-{3,}|\*\s?\*(?:\s?\*)*|⸺|·{3,})\s*$")
CLOSING = re.compile(
    r"^\s*(?:(?:kind|best|warm|warmest|kindest|many|with (?:best|kind|warm)|all the)?\s*(?:regards|wishes|greetings|the best)|(?:yours|very|most)\s*(?:sincerely|truly|faithfully)|sincerely(?: yours)?|respectfully|yours|cheers|best|thanks|many thanks|thanks again|thanks and regards|thank you|all best|take care|br|rgds"
    r"|(?:mit\s+)?(?:freundlichen?|besten?|vielen?|lieben?|herzlichen?|schönen?|sonnigen?)\s+(?:grüßen?|grüssen?|gruß|gruss|dank)|mfg|vg|lg|gruß|grüße|viele grüße|hochachtungsvoll|danke|besten dank"
    r"|cordialement|bien cordialement|bien à (?:vous|toi)|bonne (?:journée|soirée|réception)|(?:très )?cordialement|salutations(?: distinguées)?|sincères salutations|meilleures salutations|amicalement|merci(?: d’avance| d'avance| beaucoup)?|à bientôt|respectueusement|bises"
    r"|(?:muy )?atentamente|(?:un |muchos )?(?:cordial )?saludos?(?: cordiales| cordial)?|cordialmente|(?:un )?(?:fuerte )?abrazo|gracias|muchas gracias|reciba un (?:cordial )?saludo|hasta pronto)\s*[,.!–-]?\s*$",
    re.I,
)
DEVICE = re.compile(
    r"^\s*(?:sent (?:from|with|via|using) (?:my |the )?\S|get (?:the )?\S.{0,30}(?: app| for \S+)$|(?:von|mit) (?:meinem|meiner|dem|der) \S+.{0,30}gesendet|gesendet (?:von|mit|über)\b|diese nachricht wurde (?:von|mit) mein|envoyé (?:depuis|de|avec|via|à partir de)\b|enviado (?:desde|con|mediante|por)\b).{0,60}$",
    re.I,
)
LEGAL = re.compile(
    r"accepts? no liability|copying without consent|meant only for the addressee|came to you by mistake|consider the environment|monitors traffic|under its privacy notice|views above need not|registered office|scanned for malware"
    r"|(?:this|the) (?:e-?mail|message)[^.]{0,60}(?:is|are|may be|contains?)[^.]{0,30}(?:confidential|privileged)|intended (?:solely|only) for|if you (?:are not the intended|have received this)|^confidential\s*:"
    r"|haftet nicht für schäden|sitz der gesellschaft|registergericht|vertraulich und nur für|irrläufer|diese (?:e-?mail|nachricht)[^.]{0,60}vertraulich|denken sie an die umwelt|vor dem (?:aus)?druck"
    r"|décline toute responsabilité|pensez à l.environnement|avant d.imprimer|ce message (?:et[^.]{0,40} )?(?:est|sont) confidentiel|réservé à son destinataire|veuillez le détruire"
    r"|no responde de daños|antes de imprimir|el medio ambiente|este (?:mensaje|correo)[^.]{0,40}confidencial|va dirigido solo a su destinatario|si lo recibió por error",
    re.I,
)
AFTERWORD = re.compile(r"^\s*(?:p\.?\s?p?\.?\s?s|p\.?\s?d|n\.?\s?b|edit|nachtrag)\s*\.?\s*[:.\-–—]", re.I)
CONTACT = re.compile(r"@|\bwww\.|https?://|\+?\d[\d ()/.\-]{6,}|\(at\)|^(?:tel|phone|fon|mobil|m|t|fax)\b\.?:?\s*[+\d(]|\|", re.I)
BLOCK_TAG = re.compile(r"<(/?)blockquote\b[^>]*>|<[^>]*>", re.I)
GARBLED = re.compile("[ÃÂâ√├┬ΓÔГвРСÐÑ]")
COMPANY = re.compile(r"(?:,|\|)\s.*\b(?:Inc|Ltd|LLC|Corp|Co|GmbH|AG|KG|e\.\s?V|SARL|SA|SAS|SL|S\.[AL])\.?$")
# Pronouns, auxiliary verbs and conjunctions, which stand in sentences and not in names, roles or contacts.
SPEAKING = re.compile(
    r"\b(?:i|you|we|they|it|is|are|was|were|have|has|had|will|would|can|could|should|please|not|that|this|these|if|when|because|my|your|our"
    r"|ich|sie|wir|ihr|es|ist|sind|war|waren|haben|hat|hatte|wird|werden|kann|können|soll|bitte|nicht|dass|wenn|weil|mein|meine|ihre|unser|unsere"
    r"|je|vous|nous|il|elle|ils|est|sont|était|avez|avons|peut|pouvez|merci|pas|que|qui|quand|parce|votre|notre|cette"
    r"|yo|usted|ustedes|él|ella|son|era|tiene|tienen|puede|pueden|favor|cuando|porque|su|nuestro|nuestra|este|esta)\b",
    re.I,
)


def plain(line: str) -> str:
    """The line in the form the rules compare: compatibility forms folded, invisible characters and outer space gone."""
    if not line.isascii():
        line = "".join(c for c in unicodedata.normalize("NFKC", line) if unicodedata.category(c) != "Cf")
    return line.strip()


def quoted_in_markup(html: str, lines: int) -> list[bool] | None:
    """Per line of the visible text whether it lies in a quotation; null when the markup's lines don't match."""
    rows = html.split("\n")
    if len(rows) != lines or "blockquote" not in html.lower():
        return None
    depth, out = 0, []
    for row in rows:
        at, inside = 0, None
        for m in BLOCK_TAG.finditer(row):
            if inside is None and row[at : m.start()].strip():
                inside = depth > 0
            at = m.end()
            if m[0][:12].lower().startswith(("<blockquote", "</blockquote")):
                depth = max(0, depth + (-1 if m[1] else 1))
        if inside is None and row[at:].strip():
            inside = depth > 0
        out.append(bool(inside if inside is not None else depth > 0))
    return out


def _prose(line: str) -> bool:
    """Whether a line below a closing formula or delimiter is a sentence rather than a name, role or contact line."""
    words, speaking = len(line.split()), len(SPEAKING.findall(line))
    if CONTACT.search(line) or COMPANY.search(line):
        return words > 4 and speaking > 1
    return words > 4 and (speaking > 0 or line[-1:] in ".?!…:;")


def _closes(line: str) -> bool:
    """A closing formula, also where letters were lost to replacement characters."""
    if "\ufffd" not in line:
        return bool(CLOSING.match(line))
    return any(CLOSING.match(line.replace("\ufffd\ufffd", "üß").replace("\ufffd", x)) for x in "üàéßó")


def new_lines(text: str, html: str | None = None) -> list[int]:
    """Numbers (from 1) of the non-blank lines that the sender newly wrote; lines end at ``\\n``."""
    if not text:
        return []
    if GARBLED.search(text) and (chains := [c for c, v in evidence(text).items() if v > 0]):
        mended = repair(text, chains)
        text = mended if mended.count("\n") == text.count("\n") else text
    raw = [x.rstrip("\r") for x in text.split("\n")]
    lines = [plain(x) for x in raw]
    n = len(lines)
    marked = quoted_in_markup(html, n) if html else None
    quoted = [bool(q or (marked and marked[i])) for i, q in enumerate(map(QUOTE.match, lines))]
    out: list[int] = []
    state, i = "own", 0
    while i < n:
        line = lines[i]
        if not line:
            i += 1
            continue
        if quoted[i]:
            state, i = "own", i + 1
            continue
        end = i + bool(html)  # a line of markup text is a paragraph
        while not html and end < n and lines[end] and not quoted[end]:
            end += 1
        # what introduces earlier messages
        if FORWARD.match(line):
            break
        follow = [x for x in lines[i + 1 : i + 6] if x][:3]
        if HEADER_FROM.match(line) and len([x for x in follow if HEADER_REST.match(x)]) >= (1 if len(follow) < 2 else 2 if not re.match(r"\s*\**(?:from|von|de)\b", line, re.I) else 1):
            break
        if DELIMITER.match(line) and follow and HEADER_FROM.match(follow[0]) and len(follow) > 1 and HEADER_REST.match(follow[1]):
            break
        if STARTS.match(line):
            size = next((k for k in (1, 2, 3, 4) if i + k <= end and ATTRIBUTION.match(" ".join(lines[i : i + k]))), 0)
            if size:
                after = next((k for k in range(i + size, n) if lines[k]), n)
                if after < n and not quoted[after]:
                    break  # a quotation without marks goes on to the end
                i += size
                continue
        paragraph = " ".join(lines[i:end])
        first = html or i == 0 or not lines[i - 1] or quoted[i - 1]
        if first and AFTERWORD.match(line):
            out += range(i + 1, end + 1)
            state, i = "own", end
            continue
        if first and LEGAL.search(paragraph):
            i = end
            continue
        if DEVICE.match(line):
            i += 1
            continue
        if _closes(line) and (i > 0 or end - i <= 3):
            state, i = "signature", i + 1
            continue
        if DELIMITER.match(line):
            below = lines[i + 1 : i + 3] if html else lines[i + 1 : end]
            if below and not any(_prose(x) for x in below[: 1 if html else None]):
                state = "signature"
            i += 1
            continue
        if state == "signature" and not _prose(line):
            i += 1
            continue
        if state == "signature":
            state = "own"
        out.append(i + 1)
        i += 1
    return out


def _per_field(messages: DataFrame, schema: str, make) -> DataFrame:
    """Rows that ``make(text, html)`` yields for each field of each message; the texts never shuffle."""
    names = [p.split()[0] for p in schema.split(", ")][2:]
    types = [pa.int64() if p.endswith("bigint") else pa.string() for p in schema.split(", ")][2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fields, values = [], [], []
            body, seen, html = (b.column(x).to_pylist() for x in ("body_plain", "visible_text", "body_html"))
            for k in range(b.num_rows):
                made = None
                for f, text in zip(FIELDS, (body[k], seen[k])):
                    if f == "body_plain" or made is None or text != body[k]:
                        made = make(text, html[k] if f == "visible_text" else None)
                    for x in made:
                        ids.append(k)
                        fields.append(f)
                        values.append(x)
            arrays = [pa.array([v[c] for v in values], t) for c, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("msg_id").take(pa.array(ids, pa.int64())), pa.array(fields, pa.string()), *arrays], names=["msg_id", "field", *names])

    return messages.select("msg_id", *FIELDS, "body_html").mapInArrow(run, schema)


def new_line_rows(messages: DataFrame) -> DataFrame:
    """``msg_id, field, line_no``: one row per newly written line; null, empty and blank texts give none.

    Both fields are listed, also when they are equal; repeated messages are cases of their own. Rows are judged alone:
    nothing shuffles, and a sender with a third of all rows is no hot group.
    """
    return _per_field(messages, "msg_id bigint, field string, line_no bigint", lambda text, html: [(x,) for x in new_lines(text or "", html)])


def new_text(messages: DataFrame) -> DataFrame:
    """``msg_id, field, new_text``: the newly written lines of each field, joined by ``\\n`` (null for a null field)."""

    def make(text, html):
        if text is None:
            return [(None,)]
        rows = text.split("\n")
        return [("\n".join(rows[x - 1].rstrip("\r") for x in new_lines(text, html)),)]

    return _per_field(messages, "msg_id bigint, field string, new_text string", make)
