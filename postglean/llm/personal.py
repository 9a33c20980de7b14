"""Personal information in free text: found, typed, replaced.

Generators of high recall propose overlapping spans; boosted trees judge each by format and context, trained on a bounded
sample of messages labelled by cue rules; thresholds are calibrated on held-out rows of that sample; of overlapping spans
the most probable wins.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosting import SymmetricBoost
from .lookalike import CYRILLIC, GREEK, compatibility_forms
from .sampling import by_hash

FIELDS = ("body_plain", "extracted_image_text")
KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "PERSON")
#: Messages the trees are fitted on, least support of a given name, and most names sent to the tasks (more raise).
FIT_ROWS, LEAST_SUPPORT, MAX_NAMES = 1_500, 2, 1_000_000
MAX_ENDINGS = 20_000
#: Above so many messages, support is a rate for so many, so that rules on it mean the same at every size.
SUPPORT_PER = 30_000

UP, LETTER = r"[^\W\d_a-zß-öø-ÿ]", r"[^\W\d_]"
EMAIL = re.compile(r"(?<![\w.+-])[\w.+'-]++ ?@ ?[\w-]+(?:\.[\w-]+)+")
#: Spelled-out addresses; searched where ``SPELLED_HINT`` is found.
SPELLED = re.compile(
    r"(?<![\w.+-])[\w.+-]++\s*[(\[{]\s*(?:at|ät|arroba|arobase|à|@)\s*[)\]}]\s*[\w-]+(?:\s*(?:\.|[(\[{]\s*(?:dot|punkt|point|punto|\.)\s*[)\]}])\s*[\w-]+)+|(?<![\w.+-])[\w.+-]++ (?:at|arroba|arobase) [\w-]+(?: (?:dot|punkt|point|punto) [\w-]+)+", re.I
)
BRACKETED = re.compile(r"[(\[{]\s*(?:at|ät|arroba|arobase|à|@|dot|punkt|point|punto|\.)\s*[)\]}]", re.I)
#: Spelled parts and what they stand for, in this order.
SAID = ((re.compile(r"\s*[(\[{]\s*(?:at|ät|arroba|arobase|à|@)\s*[)\]}]\s*|\s+(?:at|arroba|arobase)\s+|\s*@\s*", re.I), "@"), (re.compile(r"\s*[(\[{]\s*(?:dot|punkt|point|punto|\.)\s*[)\]}]\s*|\s+(?:dot|punkt|point|punto)\s+", re.I), "."))
SPELLED_HINT = re.compile(r"[(\[{]\s*(?:at|ät|arroba|arobase|à|@)\s*[)\]}]| (?:dot|punkt|point|punto) ", re.I)
LINK = re.compile(r"(?:https?|hxxps?|ftp)://\S+|\bwww\.\S+", re.I)
NUMBER = re.compile(r"(?<![\w#@])(?:[A-Z]{1,3}[ -]?)?[+(]?\d(?:[\d]|[  ./()-]{1,2}(?=[\d(])){4,24}\d(?:[ -]?[A-Z](?![\w]))?|(?<![\w#@])[A-Z]{2}\d{6,9}(?!\w)|(?<![\w#])[A-Z]{2}(?: ?\d{2}){3} ?[A-Z]\b")
# Words of streets, of firms and of the context, in English, German, French and Spanish.
STREET_EN = r"(?:street|st|road|rd|lane|avenue|ave|terrace|row|gate|drive|close|court|square|place|way|hill|crescent|walk|mews|boulevard|park|quay|yard|view|grove|gardens)"
STREET_FR = r"(?:rue|avenue|impasse|quai|boulevard|place|chemin|allée|cours|passage|route|square|sentier|ruelle)"
STREET_ES = r"(?:calle|avenida|avda\.?|plaza|paseo|camino|ronda|travesía|carretera|glorieta|callejón|c/)"
STREET_DE = r"(?:straße|strasse|str\.|weg|gasse|allee|platz|bogen|ufer|ring|damm|steig|chaussee|markt|winkel|hof|graben|berg|stieg|pfad|zeile)"
NO = r"\d{1,4} ?[a-zA-Z]?(?:\s?[/-]\s?\d{1,4}[a-z]?)?"
TAIL = rf"(?:,?\s+(?i:flat|apt\.?|apartment|unit|suite|bât\.?|piso)\s+\w+)?(?:,\s*(?:\d{{4,5}}\s+{UP}[\w’'.-]+(?:\s{UP}[\w’'-]+)?|{UP}[\w’'.-]+(?:\s{UP}[\w’'-]+)?(?:\s+\d{{4,5}})?))?"
# Each form of address with literals of which a text must hold one (in lower case) to be searched for it.
ADDRESSES = tuple(
    (tuple(hint.split("/")), re.compile(pattern + TAIL))
    for hint, pattern in (
        ("street/ st/road/ rd/lane/avenue/ ave/terrace/ row/ gate/drive/close/court/square/place/ way/hill/crescent/walk/mews/boulevard/park/quay/yard/view/grove/garden", rf"{NO}\s+(?:{UP}[\w’']+\s+){{1,3}}(?i:{STREET_EN})\b"),
        ("rue /avenue/impasse/quai/boulevard/place/chemin/allée/cours/passage/route/square/sentier/ruelle", rf"{NO},?\s+(?:bis\s+|ter\s+)?(?i:{STREET_FR})\s+(?:(?:de|des|du|la|le|les|de\s+la|aux?)\s+|d[’']|l[’'])*{UP}[\w’'-]*(?:\s+{UP}[\w’'-]+)*"),
        ("calle/avenida/avda/plaza/paseo/camino/ronda/travesía/carretera/glorieta/callejón/c/", rf"\b(?i:{STREET_ES})\s+(?:(?:de|del|los|las|la|el)\s+)*{UP}[\w’'-]*(?:\s+(?:(?:de|del|los|las|la|el)\s+)*{UP}[\w’'-]+){{0,3}},?\s+(?:n\.?º?\s*)?{NO}(?!\w)"),
        ("straße/strasse/str./weg/gasse/allee/platz/bogen/ufer/ring/damm/steig/chaussee/markt/winkel/hof/graben/berg/stieg/pfad/zeile", rf"(?i:{STREET_DE})\s+{NO}(?!\w)"),
        ("am /an de/im /in der/zum /zur /auf de/unter den/beim ", rf"\b(?:Am|An\s+der|An\s+den|Im|In\s+der|Zum|Zur|Auf\s+der|Auf\s+dem|Unter\s+den|Beim)\s+(?:[a-zäöüß]+\s+)?{UP}[^\W\d_-]+(?:-{LETTER}+)*\s+{NO}(?![\w.])"),
    )
)
# Words of dates and counted things, which the last form of address also fits.
_MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()
_DAYS = "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonnabend Sonntag".split()
_COUNTED = "Woche Kalenderwoche Jahr Jahre Quartal Monat Herbst Winter Sommer Frühjahr Frühling Raum Zimmer Kapitel Abschnitt Anhang Anlage Absatz Artikel Seite Tabelle Version Stunde Umkreis Alter Schnitt Vorgang Ticket Auftrag Fall".split()
CALENDAR = re.compile(rf"\b(?:{'|'.join(_MONTHS + _DAYS + _COUNTED)})\b")
HOUR = re.compile(r"\s*(?:Uhr|h)\b|:\d")
TOWN = re.compile(rf"\b\d{{4,5}}\s+{UP}|,[^,]*{UP}[^,\d]*\s\d{{4,5}}\b")
#: Near misses and near hits of addresses that few samples hold; fitted beside the sample, labelled by the same cue rules.
NEAR = tuple(f"{a}{b} {w} {n}{c}" for w, b in [*((m, "Im") for m in _MONTHS), *((d, "Am") for d in _DAYS), *((x, "In der" if x in ("Woche", "Version", "Tabelle", "Anlage", "Kalenderwoche", "Stunde") else "Im") for x in _COUNTED)] for n in (3, 12, 2025) for a, c in (("", ""), ("Wir sehen uns. ", " geht es weiter."), ("Bis dahin: ", ", wie besprochen."))) + tuple(f"{a} {n} Larch Road" for a in ("order", "ticket", "case", "invoice", "Bestellung", "commande", "pedido") for n in (4, 27, 318)) + tuple(f"{a} {w} {n}{c}" for a in ("Am", "An der", "Im", "In der", "Zum", "Zur", "Auf der", "Unter den", "Beim") for w in ("Speicher", "Linden", "Brunnen", "alten Kanal") for n in (3, 12, "75a") for c in ("", ", 63496 Kelburn"))
TOKEN = re.compile(rf"(?<![\w@.+/-]){UP}[^\W\d_’'�]*(?:[-’']{LETTER}+|�{LETTER}*)*")
ORG = re.compile(r"^[\s,]*(?:Inc|Ltd|LLC|Corp|GmbH|AG|KG|SARL|SAS|SA|SL|Trading|Service|Services|Team|Shop|Support|Bulletin|Verein|Café|Bank|Group|Club|Mail)\b")
CUES = {
    "phone": re.compile(r"(?:\b(?:t|m|tel|te1|tél|phone|fon|telefon|telefono|teléfono|téléphone|mobil|mobile|cell|call|fax|number is|reach .{2,40} on|ist unter|llamar a .{2,40} al|joindre .{2,40} au|nummer|numéro|número)\b[.:]?\s*)$", re.I | re.S),
    "id": re.compile(r"(?:\b(?:passport|pass|passnummer|id|id card|identity|ident|tax no|tax|steuer(?:nummer|-id)?|ausweis|personalausweis|pièce d.identité|identité|documento|dni|nif|nie|pasaporte|passeport|ssn|nino|no|n[º°])\b[.:]?\s*(?:no|nr|number|nummer)?\.?:?\s*)$", re.I),
    "order": re.compile(r"(?:\b(?:order|ticket|device|dossier|expediente|pedido|vorgang|parcel|paquet|ref|reference|receipt|version|versión|case|invoice|serial|tracking|sendung|bestellung|commande|colis|wifi|ip|host|about|von)\b[.:]?\s*(?:no\.?|nr\.?|n[º°])?\s*#?)$", re.I),
    "greet": re.compile(r"(?:\b(?:dear|hi|hello|good morning|hallo|liebe[rs]?|guten (?:tag|morgen|abend)|moin|bonjour|salut|chère?|hola|buenos días|estimad[oa]|buenas|querid[oa]|name|from|to|von|an|de|para|à|cc|by|with|ask|reach|joindre|llamar a|belongs to|es de|au nom de|suivi par|lo lleva|an|call|deliver to|mrs?\.?|ms\.?|herr|frau|mme|m\.|sr\.?|sra\.?)\s*:?\s*)$", re.I),
    "close": re.compile(r"(?:(?:regards|wishes|sincerely|cheers|thanks|best|grüßen?|grüße|mfg|cordialement|vous|journée|atentamente|saludo|saludos|cordiales)\s*,?\s*(?:--\s*|—\s*|_+\s*|[*] [*] [*]\s*)?)$", re.I),
    "wrote": re.compile(r"(?:\d{4},?\s*(?:(?:at|um|à|a las)\s*)?(?:\d{1,2}:\d{2})?\s*(?:[AP]M)?,?\s*(?:schrieb\s*)?|\d{1,2}:\d{2}\s*(?:schrieb|[AP]M,?)?,?\s*)$"),
}
RIGHT = {
    "wrote": re.compile(r"^\s*(?:<|\(<|\[mailto:|wrote|schrieb|a\s+écrit|escribió|moved to|ist unter|:|,\s*(?:Vorgang|ID)\b)"),
    "reach": re.compile(r"^\s*(?:ext\b|o escribir|ou via|oder|or at|erreichbar|;|\s\S+@)"),
}
#: Each cue with the number of characters before a span it is sought in and the kinds it matters for.
CUE_LIST = tuple((CUES[n], size, kinds) for n, size, kinds in (("phone", 48, (1, 2)), ("id", 28, (1, 2)), ("order", 24, (1, 2, 3)), ("greet", 22, (4,)), ("close", 30, (4,)), ("wrote", 34, (4,))))
#: A greeting or closing with a word after it that stands alone on its line, which is proposed as a name without support.
ADDRESSED = re.compile(
    rf"^[>| \t]*(?:(?i:dear|hi|hello|good morning|hallo|liebe[rs]?|guten (?:tag|morgen|abend)|moin|bonjour|salut|chère?|hola|buenos días|estimad[oa]|buenas|querid[oa])[ \t]+"
    rf"|(?i:(?:(?:best|kind|warm) )?(?:regards|wishes)|sincerely|cheers|(?:mit )?(?:freundlichen|besten|viele|liebe) grüßen?|cordialement|atentamente|saludos)[ \t]*,?[ \t\r]*\n[>| \t]*)({TOKEN.pattern})[ \t]*[,!:.]?[ \t\r]*$",
    re.M,
)
# Forms of address that name nobody.
NOBODY = frozenset("all alle everyone everybody team teams colleague colleagues customer customers client clients cliente clientes kunde kunden kundin kollege kollegen kollegin kolleginnen sir madam sirs user member friend friends herren damen equipe equipo tous toutes todos todas collegue collegues companero companeros companeras support service monsieur madame messieurs senor senora senores there again".split())
NAME_BEFORE = re.compile(rf"(?:(?<!\w){UP}[\w’'-]*[^\S\n])?(?:(?<!\w){UP}[\w’'-]*)?$")
NOT_BEFORE = tuple("0123456789/.#-")
_UNPLAIN = re.compile("[^\x00-\x7f¡§«®°»¿-ı–—‘-„€�]")
_FOLD: dict[int, str] = {}
_LATIN = {ord(a): b for a, b in {**CYRILLIC, **GREEK}.items() if len(b) == 1}
_ALIKE = re.compile("[" + "".join(map(chr, _LATIN)) + "]")
_OWN, _OTHER = re.compile("[A-Za-zÀ-ɏ]"), re.compile("[Ͱ-ϿЀ-ԯἀ-῿]")


def mail_host(span: str) -> str:
    """The host of a written or spelled-out address, in lower case."""
    for pattern, sign in SAID:
        span = pattern.sub(sign, span)
    return span.rpartition("@")[2].lower()


#: Near misses of addresses that few samples hold: prices, versions, and prose around "at" and "point".
NEAR_MAIL = tuple(f"{a}{x}{b}" for x in ("12 @ 4.50", "3 @ 19.99", "lodash@4.17.21", "build@1.0.3", "price at that point is", "arrived at this point we", "look at this dot matrix", "stand at one point two", "be at home punkt zwölf", "estar at casa punto final", "release v1.2 at this point has", "Mr. Lund at that point was") for a, b in (("", ""), ("The ", " today."), ("Note: ", ", see below"), ("so ", " again")))
#: How an address is spelled out, to make hits of known addresses.
SPELLINGS = ("{0} (at) {1} (dot) {2}", "{0} [at] {1}.{2}", "{0} at {1} dot {2}", "{0} arroba {1} punto {2}", "{0} (ät) {1} (punkt) {2}", "{0}@{1}.{2}", "{0} @ {1}.{2}")


def fold(text: str) -> str:
    """``text`` with look-alike and compatibility forms replaced one by one, so that positions stay.

    Cyrillic and Greek look-alikes become Latin in lines with more Latin letters than others, in words with both scripts, and
    in lines made of look-alikes alone in a text that is mostly Latin; other lines stay.
    """
    if not _UNPLAIN.search(text):
        return text
    if not _FOLD:
        src, dst, _ = compatibility_forms()
        _FOLD.update({ord(a): b for a, b in zip(src, dst)})
        _FOLD.update({c: " " for c in (0xA0, 0x2002, 0x2003, 0x2007, 0x2009, 0x202F, 0x3000)})
    out = text.translate(_FOLD)
    if not _ALIKE.search(out):
        return out
    mostly = len(_OWN.findall(out)) > len(_OTHER.findall(out))

    def one(line: str) -> str:
        if not _ALIKE.search(line):
            return line
        own, other = len(_OWN.findall(line)), _OTHER.findall(line)
        if own > len(other) or not own and mostly and all(ord(c) in _LATIN for c in other):
            return line.translate(_LATIN)
        return re.sub(r"\S+", lambda m: m[0].translate(_LATIN) if _OWN.search(m[0]) else m[0], line) if own else line

    return "\n".join(map(one, out.split("\n")))


def bare(word: str) -> str:
    """Lower case without accents, as in mail addresses."""
    if word.isascii():
        return word.lower()
    w = word.lower().replace("ł", "l").replace("ø", "o").replace("ß", "ss").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


@dataclass
class Names:
    """Given and family names with their support, and the beginnings and ends that family names share."""

    given: dict[str, int]
    family: dict[str, int]
    starts: dict[str, int]
    ends: dict[str, int]

    unit: float = 1.0
    #: Last labels of the hosts that senders' addresses have.
    endings: frozenset[str] = frozenset()

    @staticmethod
    def parts(display: str | None, address: str | None) -> tuple[str, str] | None:
        """Given and family name of a display name whose parts stand in its own mail address (``given.family@``, ``gfamily@``, ``family12@``)."""
        if not display or not address:
            return None
        local = re.sub(r"[^a-z]", "", address.split("@")[0].split("+")[-1].lower())
        own = [bare(p) for p in re.findall(r"[^\W\d_]{2,}", fold(display))]
        if len(own) == 2:
            for a, b in (own, own[::-1]):
                if local in (a + b, a[0] + b, b):
                    return a, b
        return None

    @classmethod
    def of(cls, given: dict[str, int], family: dict[str, int], total: int) -> Names:
        """From the counts of both parts over ``total`` messages."""
        family = {w: n for w, n in family.items() if len(w) > 4}
        given = {w: n for w, n in given.items() if n >= LEAST_SUPPORT and n > family.get(w, 0)}
        starts: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        for w in family:
            starts.update(w[:k] for k in range(3, len(w) - 2))
            ends.update(w[k:] for k in range(3, len(w) - 2))
        return cls(given, family, {k: n for k, n in starts.items() if n > 1}, {k: n for k, n in ends.items() if n > 1}, SUPPORT_PER / max(total, SUPPORT_PER))

    def likeness(self, w: str) -> float:
        """How well ``w`` splits into a known beginning and end of family names."""
        return float(max((min(self.starts.get(w[:k], 0), self.ends.get(w[k:], 0)) for k in range(3, len(w) - 2)), default=0))


def learn_names(messages: DataFrame, total: int, limit: int = MAX_NAMES) -> Names:
    """The names of all messages. Equal pairs of display name and address meet first, so a hot sender is one row; only counts of names reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter[tuple[bool, str]] = Counter()
            for display, address, n in zip(*(c.to_pylist() for c in b.columns)):
                if found := Names.parts(display, address):
                    counts[True, found[0]] += n
                    counts[False, found[1]] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.bool_()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["is_given", "word", "n"])

    pairs = messages.where("from_display is not null and from_addr is not null").groupBy("from_display", "from_addr").agg(F.count("*").alias("n"))
    counts = pairs.mapInArrow(run, "is_given boolean, word string, n bigint").groupBy("is_given", "word").agg(F.sum("n").alias("n"))
    rows = counts.where(f"if(is_given, n >= {LEAST_SUPPORT}, length(word) > 4)").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"senders have more than {limit} different names")
    out = Names.of({r.word: r.n for r in rows if r.is_given}, {r.word: r.n for r in rows if not r.is_given}, total)
    ending = F.lower(F.regexp_extract("from_addr", r"@[^@\s>]*\.([^.@\s>\d]+)>?\s*$", 1))
    found = [r[0] for r in messages.select(ending.alias("e")).where("e <> ''").distinct().limit(MAX_ENDINGS + 1).collect()]
    if len(found) > MAX_ENDINGS:
        raise ValueError(f"sender addresses have more than {MAX_ENDINGS} different endings")
    out.endings = frozenset(found)
    return out


BREAK = re.compile(r"\s*\n[>| \t]*")
GAP = re.compile(r",?\s{0,3}(?:[>|]+ ?)?")
INITIAL = re.compile(r"(?<![\w.])([A-ZÀ-Þ]\. ?)$")


def _digits(span: str) -> list[float]:
    groups = re.findall(r"\d+", span)
    letters = re.findall(r"[A-Za-z]+", span)
    return [sum(map(len, groups)), sum(map(len, letters)), len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, max(map(len, groups), default=0)]


def candidates(text: str, names: Names, cache: dict) -> list[tuple[int, int, int, list[float]]]:
    """``(kind, start, end, features)`` of every proposed span; spans overlap freely."""
    t = fold(text)
    out = []
    taken = [False] * (len(t) + 1)

    def add(kind: int, s: int, e: int, extra: list[float], named: list[float]) -> None:
        left, right, span = t[max(0, s - 48) : s], t[e : e + 30], t[s:e]
        left = BREAK.sub(" ", left) if "\n" in left else left
        newline = t.rfind("\n", 0, s)
        head = t[newline + 1 : s].strip(" >|\t")
        stop = t.find("\n", e)
        rest = t[e : stop if stop >= 0 else len(t)].strip(" \r\t.,")
        cue = [float(bool(r.search(left[-size:]))) if kind in kinds else 0.0 for r, size, kinds in CUE_LIST]
        out.append((kind, s, e, [*extra, len(span), span[0] == "+", span.startswith("00"), span[0] == "0", "(" in span, "/" in span, "." in span, "-" in span, span[-1:].isalpha(), *cue, *(float(bool(r.match(right))) for r in RIGHT.values()), not head, not rest, *named]))

    for m in LINK.finditer(t) if "://" in t or "www." in t.lower() else ():
        taken[m.start() : m.end()] = [True] * (m.end() - m.start())
    mails = [*EMAIL.finditer(t)] if "@" in t else []
    mails += SPELLED.finditer(t) if SPELLED_HINT.search(t) else []
    for m in mails:
        s = m.start()
        if t[s:].lower().startswith("mailto:"):
            s += 7
        if not taken[s]:
            host = mail_host(m[0])
            last = host.rpartition(".")[2]
            sign = "@" in m[0]
            add(0, s, m.end(), _digits(m[0]), [float(last in names.endings), float(last.isdigit()), float(bool(BRACKETED.search(m[0]))), float(sign), float(sign and " " in m[0])])
            if last in names.endings or sign and not last.isdigit():
                taken[s : m.end()] = [True] * (m.end() - s)
    low = t.lower()
    for hints, pattern in ADDRESSES:
        if any(h in low for h in hints):
            for m in pattern.finditer(t):
                s = m.start()
                if pattern is ADDRESSES[3][1]:  # the street's name goes on to the left
                    s -= len(NAME_BEFORE.search(t[max(0, s - 40) : s])[0])
                    if not t[s].isupper():
                        continue
                if not taken[s] and t[s - 1 : s] not in NOT_BEFORE:
                    own = t[s : m.end()]
                    preposed = pattern is ADDRESSES[4][1]
                    dated = preposed and bool(CALENDAR.search(own) or HOUR.match(t, m.end()))
                    add(3, s, m.end(), _digits(own), [float(preposed), float(dated), float(bool(TOWN.search(own))), 0, 0])
    if any(c.isdigit() for c in t):
        for m in NUMBER.finditer(t):
            if not taken[m.start()]:
                s = m.start()
                out_digits = _digits(m[0])
                add(2, s, m.end(), out_digits, [0, 0, 0, 0, 0])
                first = re.search(r"[+(\d]", m[0]).start()
                add(1, s + first, m.end(), _digits(m[0][first:]), [float(first > 0), 0, 0, 0, 0])
    addressed = {m.start(1) for m in ADDRESSED.finditer(t) if bare(m[1]) not in NOBODY}
    tokens = []
    for m in TOKEN.finditer(t):
        w = m[0]
        if not w[0].isupper() or taken[m.start()]:
            continue
        known = cache.get(w)
        if known is None:
            b = bare(w)
            shape = w.isupper() and len(w) > 1 or w[1:].islower() or "-" in w or "’" in w or "'" in w
            g, f = names.given.get(b, 0) * names.unit, names.family.get(b, 0) * names.unit
            like = names.likeness(b) if len(b) > 5 else 0.0
            if len(cache) > 200_000:
                cache.clear()
            known = cache[w] = (float(g), float(f), like) if shape or g or f else (0.0, 0.0, 0.0)
        tokens.append((m.start(), m.end(), *known))
    used = -1
    for i, (s, e, g, f, like) in enumerate(tokens):
        if s < used or not (g or f or like > 1 or s in addressed):
            continue
        nxt = tokens[i + 1] if i + 1 < len(tokens) else None
        initial = INITIAL.search(t[max(0, s - 4) : s]) if (f or like) and not g else None
        if nxt and re.fullmatch(r",?[  ]?\s{0,2}(?:[>|]+ ?)?", t[e : nxt[0]]) and e < nxt[0] and (nxt[2] and (f or like > 1) or g and (nxt[3] or nxt[4] > 1)) and not (g and "," in t[e : nxt[0]]):
            add(4, s, nxt[1], [0, 0, 2, e - s, nxt[1] - nxt[0], 0], [max(g, nxt[2]), max(f, nxt[3]), max(like, nxt[4]), float(bool(ORG.match(t[nxt[1] : nxt[1] + 14]))), 2])
            used = nxt[1]
        else:
            start = s - len(initial[0]) if initial else s
            add(4, start, e, [0, 0, 1, e - s, 0, float(bool(initial))], [g, f, like, float(bool(ORG.match(t[e : e + 14]))), 1])
    return out


PHONE_SHAPE = re.compile(r"\+\d{1,3}[ \d./()-]{8,}|00\d{2}[ \d./-]{8,}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|0\d{2,4}/\d{4,6}(?:-\d+)?|0\d(?: \d{2}){4}")
ID_SHAPE = re.compile(r"[A-Z]{2}(?: ?\d{2}){3} ?[A-Z]|\d{3}-\d{2}-\d{4}|\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|[A-Z]{2}\d{7}|\d{8}-?[A-Z]|00\d{9}")


def mail_label(span: str, hosts: frozenset[str]) -> int | None:
    """Label of a proposed mail address by the hosts that senders write from, which no feature knows: 1, 0 or null (trains nothing)."""
    host = mail_host(span)
    if host in hosts or any(host.endswith("." + h) for h in hosts):
        return 1
    return 0 if host.rpartition(".")[2].isdigit() or "@" not in span and not BRACKETED.search(span) else None


def weak_label(kind: int, span: str, x: list[float]) -> int | None:
    """Label by cue rules: 1, 0, or null where they don't decide (such spans train nothing)."""
    cue = dict(zip(CUES, x[15 : 15 + len(CUES)]))
    if kind == 1:
        if cue["order"] or cue["id"] and not cue["phone"]:
            return 0
        good = bool(PHONE_SHAPE.fullmatch(span))
        return int(good) if good or not cue["phone"] else None
    if kind == 2:
        if cue["order"] or cue["phone"]:
            return 0
        good = bool(ID_SHAPE.fullmatch(span))
        return int(good) if good or not cue["id"] else None
    if kind == 3:
        preposed, dated, town = x[-5:-2]
        if not town and (dated or cue["order"]):
            return 0
        if preposed and not town:  # a line of its own, or undecided
            return 1 if x[23] and x[24] else None
        return 1 if town or len(span) > 9 else None
    given, family, like, org, parts = x[-5:]
    if org:
        return 0
    if parts == 2 and given and (family or like > 1):
        return 1
    if parts == 1 and given:
        return 1 if cue["greet"] or cue["close"] or cue["wrote"] or x[22] or given > 20 else None
    if parts == 1 and not family and like <= 1:
        return 1  # proposed by its greeting or closing alone
    if parts == 1 and family:
        return 1 if x[5] or cue["greet"] or cue["wrote"] else None
    return 0 if like <= 2 else None


@dataclass
class Model:
    """Names and a calibrated classifier per kind; ``support`` is the number of labelled spans it was fitted on."""

    names: Names
    boosts: dict[int, SymmetricBoost]
    support: dict[str, int]
    #: By kind, on the held-out labelled spans: their number, the share that is true (all proposals accepted), F1 of that, F1 of the trees.
    figures: dict[str, tuple[int, float, float, float]] = field(default_factory=dict)

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """Per text the accepted spans ``(start, end, kind, probability)`` in order, without overlaps."""
        cache = self.__dict__.setdefault("_cache", {})
        rows, owner = [], []
        for i, text in enumerate(texts):
            if text:
                found = candidates(text, self.names, cache)
                rows += found
                owner += [i] * len(found)
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        if not rows:
            return out
        x = np.array([r[3] for r in rows], float)
        kinds = np.array([r[0] for r in rows])
        p = np.zeros(len(rows))
        for k, boost in self.boosts.items():
            at = np.flatnonzero(kinds == k)
            if len(at):
                q = boost.predict(x[at])
                p[at] = np.where(q >= boost.cut, 0.5 + 0.5 * (q - boost.cut) / (1 - boost.cut), 0.0)
        order = np.lexsort((-np.array([r[2] - r[1] for r in rows]), -p, owner))
        spans: dict[int, list[tuple[int, int]]] = {}
        for j in order:
            if p[j] < 0.5:
                continue
            k, s, e, _ = rows[j]
            mine = spans.setdefault(owner[j], [])
            if all(e <= a or s >= b for a, b in mine):
                mine.append((s, e))
                out[owner[j]].append((s, e, int(k), float(p[j])))
        for found in out:
            found.sort()
        return out


def fit(messages: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model, from the sender names of all messages and trees on at most ``fit_rows`` of them, the first by hash of msg_id.

    A quarter of the sample is held out for calibration. Only the trees' sample is bounded, the searched rows never are.
    """
    total = messages.count()
    names = learn_names(messages, total)
    sample = by_hash(messages.select(*FIELDS, "from_addr", "msg_id"), F.col("msg_id"), fit_rows, total).collect()
    texts = [t for r in sample for t in r[:2]]
    own = sorted({r.from_addr.strip("<> ").lower() for r in sample if r.from_addr and re.fullmatch(r"<?[\w.+-]+@[\w-]+(?:\.[\w-]+)+>?", r.from_addr.strip())})
    hosts = frozenset(a.partition("@")[2] for a in own)
    rows: dict[int, list] = {k: [] for k in range(len(KINDS))}
    cache: dict = {}
    label = lambda k, span, x: mail_label(span, hosts) if k == 0 else weak_label(k, span, x)
    for i, t in enumerate(texts):
        for k, s, e, x in candidates(t, names, cache) if t else []:
            y = label(k, fold(t)[s:e], x)
            if y is not None:
                rows[k].append((x, y, (i // 2) % 4 == 0))
    boosts, support, figures = {}, {}, {}
    for k, spans in rows.items():
        support[KINDS[k]] = len(spans)
        if not spans:
            continue
        near: list[str] = []
        if k == 0:  # known addresses in all spellings, beside texts that only look like one
            split = [(a.partition("@")[0].split(".")[0 if i % 2 else -1] if i % 3 else a.partition("@")[0], *a.partition("@")[2].rpartition(".")[::2]) for i, a in enumerate(own[:120])]
            near = [*NEAR_MAIL, *(f"{lead}{SPELLINGS[i % len(SPELLINGS)].format(*parts)}{end}" for i, parts in enumerate(split) for lead, end in (("", ""), ("Write to ", " soon.")))]
        elif k == 3:
            near = list(NEAR)
        made = [(x, label(k, t[s:e], x)) for t in near for kind, s, e, x in candidates(t, names, cache) if kind == k]
        spans += [(x, y, i % 4 == 0) for i, (x, y) in enumerate(made) if y is not None]
        x, y, held = np.array([r[0] for r in spans], float), np.array([r[1] for r in spans], float), np.array([r[2] for r in spans])
        if k == 0:  # endings never seen must be judged by the form: hide every other known one; the shape of numbers says nothing
            x[:, :-5] = 0
            x[(np.arange(len(spans)) % 2 == 0) & (y > 0) & ((x[:, -3] > 0) | (x[:, -2] > 0)), -5] = 0
        if k == 4:  # names not learnt must be judged by form and context: hide the support of one in five
            hide = np.arange(len(spans)) % 5 == 0
            x[hide & (y > 0), -4] = 0
            x[hide & (y > 0) & ((x[:, 18] > 0) | (x[:, 19] > 0)), -5] = 0
        boosts[k] = SymmetricBoost().fit(x[~held], y[~held]).calibrate(x[held], y[held])
        if held.any():
            said = boosts[k].predict(x[held]) >= boosts[k].cut
            share = float(y[held].mean())
            figures[KINDS[k]] = (int(held.sum()), round(share, 4), round(2 * share / (1 + share), 4), round(float(2 * (y[held] * said).sum() / max(y[held].sum() + said.sum(), 1)), 4))
    return Model(names, boosts, support, figures)


def mentions(messages: DataFrame, model: Model | None = None) -> DataFrame:
    """``msg_id, field, kind, start_at, end_at, probability``, one row per mention; positions count code points from 0.

    Null and empty texts have none; repeated messages are cases of their own; whole texts are searched. Nothing
    shuffles, so no sender is a hot group.
    """
    model = model or fit(messages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fields, kinds, starts, ends, ps = [], [], [], [], [], []
            for f in FIELDS:
                for i, found in enumerate(model.find(b.column(f).to_pylist())):
                    for s, e, k, p in found:
                        ids.append(i), fields.append(f), kinds.append(KINDS[k]), starts.append(s), ends.append(e), ps.append(p)
            yield pa.RecordBatch.from_arrays(
                [b.column("msg_id").take(pa.array(ids, pa.int64())), pa.array(fields, pa.string()), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(ps, pa.float64())],
                names=["msg_id", "field", "kind", "start_at", "end_at", "probability"],
            )

    return messages.select("msg_id", *FIELDS).mapInArrow(run, "msg_id bigint, field string, kind string, start_at bigint, end_at bigint, probability double")


def redact(text: str | None, found: list[tuple[int, int, int, float]]) -> str | None:
    """``text`` with ``<KIND>`` in the place of each span; the rest is unchanged, null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, k, _ in found:
        out += [text[at:s], f"<{KINDS[k]}>"]
        at = e
    return "".join(out) + text[at:]


def redacted(messages: DataFrame, model: Model | None = None) -> DataFrame:
    """``msg_id, body_plain, extracted_image_text, mentions`` with placeholders in the texts and the number replaced."""
    model = model or fit(messages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, n = [], np.zeros(b.num_rows, np.int64)
            for f in FIELDS:
                texts = b.column(f).to_pylist()
                found = model.find(texts)
                n += [len(x) for x in found]
                columns.append(pa.array([redact(t, x) for t, x in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("msg_id"), *columns, pa.array(n)], names=["msg_id", *FIELDS, "mentions"])

    return messages.select("msg_id", *FIELDS).mapInArrow(run, "msg_id bigint, body_plain string, extracted_image_text string, mentions bigint")
