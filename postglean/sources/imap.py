"""A mail server as a streaming source: new messages of each mailbox above the last uid read.

The reader needs a client with ``uids(mailbox, above)`` and ``fetch(mailbox, uid)``; :class:`ImapClient` talks to a real server,
tests and replays give their own. One query reads all mailboxes, each a partition of its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "mailbox string, uid bigint, raw binary"
FIRST_WAIT, LONGEST_WAIT = 1.0, 60.0


def waits() -> Iterator[float]:
    """Seconds to wait before each new attempt to connect: doubling up to the longest."""
    wait = FIRST_WAIT
    while True:
        yield wait
        wait = min(wait * 2, LONGEST_WAIT)


def persistent(make: Callable[[], Any], attempts: int = 8, sleep: Callable[[float], None] = time.sleep) -> Any:
    """What ``make`` gives; a failed connection is tried again after :func:`waits`, and raised after the last attempt."""
    for n, wait in enumerate(waits(), 1):
        try:
            return make()
        except OSError:
            if n >= attempts:
                raise
            sleep(wait)


class ImapClient:
    """Read-only access to one server."""

    def __init__(self, host: str, user: str, password: str, port: int = 993):
        import imaplib

        self.box = persistent(lambda: imaplib.IMAP4_SSL(host, port))
        self.box.login(user, password)

    def uids(self, mailbox: str, above: int) -> list[int]:
        """Uids above one; servers answer ``n:*`` with their last message even when it is lower, so all are compared."""
        self.box.select(mailbox, readonly=True)
        _, found = self.box.uid("search", None, f"UID {above + 1}:*")
        return sorted(u for u in map(int, (found[0] or b"").split()) if u > above)

    def fetch(self, mailbox: str, uid: int) -> bytes:
        self.box.select(mailbox, readonly=True)
        _, found = self.box.uid("fetch", str(uid), "(RFC822)")
        return next((part[1] for part in found if isinstance(part, tuple)), b"")


class MailboxPart(InputPartition):
    def __init__(self, mailbox: str, above: int, to: int):
        self.mailbox, self.above, self.to = mailbox, above, to


class MailReader(DataSourceStreamReader):
    """Offsets are the last uid of each mailbox; a message is read again if the batch that holds it fails."""

    def __init__(self, options: dict[str, str], client: Callable[[dict[str, str]], Any]):
        self.options, self.client = dict(options), client
        self.mailboxes = [m for m in options.get("mailboxes", "").split(",") if m]

    def initialOffset(self) -> dict:
        return {m: 0 for m in self.mailboxes}

    def latestOffset(self) -> dict:
        box = self.client(self.options)
        return {m: max(box.uids(m, 0), default=0) for m in self.mailboxes}

    def partitions(self, start: dict, end: dict) -> list[MailboxPart]:
        return [MailboxPart(m, start.get(m, 0), to) for m, to in end.items() if to > start.get(m, 0)]

    def read(self, part: MailboxPart) -> Iterator[tuple]:
        box = self.client(self.options)
        for uid in box.uids(part.mailbox, part.above):
            if uid <= part.to:
                yield part.mailbox, uid, bytearray(box.fetch(part.mailbox, uid))

    def commit(self, end: dict) -> None:
        pass


def mail_source(client: Callable[[dict[str, str]], Any], name: str = "postglean_mail") -> type[DataSource]:
    """A data source for ``spark.dataSource.register``; ``client`` makes a connection of the reader's options."""

    class MailSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return MailReader(dict(self.options), client)

    return MailSource


def server(options: dict[str, str]) -> ImapClient:
    return ImapClient(options["host"], options["user"], options["password"], int(options.get("port", 993)))


def mailbox_list(lines: list[str], demo: tuple[str, ...] = ("alice@demo.test", "bob@demo.test", "carol@demo.test")) -> list[str]:
    """Addresses of an account file of ``address|hash`` lines; without any, the demo ones."""
    found = [x.split("|")[0].strip() for x in lines if x.strip() and not x.lstrip().startswith("#")]
    return [a for a in found if "@" in a] or list(demo)
