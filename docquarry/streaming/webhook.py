"""A sink that posts changes to a URL: in order, signed, repeated until acknowledged."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docquarry.plans.filters import parse_filter
from docquarry.plans.requests import parse_change_ops
from docquarry.sources.log import Log, snapshot
from docquarry.streaming.changes import admitted, classify, event, resume, retention_floor

#: Events in a post, first and longest wait between attempts in seconds.
BATCH, FIRST_WAIT, LONGEST_WAIT = 64, 0.5, 30.0


def sign(secret: str, timestamp: str, body: bytes) -> str:
    return hmac.new(secret.encode(), timestamp.encode() + b"." + body, hashlib.sha256).hexdigest()


def waits() -> Iterator[float]:
    wait = FIRST_WAIT
    while True:
        yield wait
        wait = min(2 * wait, LONGEST_WAIT)


@dataclass
class Webhook:
    """Acknowledged by any 2xx; a 410 disables it. ``position`` is the last change that was acknowledged."""

    id: str
    url: str
    secret: str | None = None
    disabled: bool = False
    position: int = 0
    #: Which changes are sent, and how often some were lost because they were no longer kept.
    ops: str | None = None
    filter: dict | None = None
    gaps: int = 0
    #: Called with the webhook after each acknowledged post.
    committed: Callable[[Webhook], None] = field(default=lambda hook: None, repr=False)
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def deliver(self, collection: str, events: Iterable[dict]) -> None:
        rest = iter(events)
        while not self.disabled and (batch := list(islice(rest, BATCH))):
            if self._post(json.dumps({"webhook": self.id, "collection": collection, "events": batch}, ensure_ascii=False).encode()):
                self.position = batch[-1]["lsn"]
                self.committed(self)

    def _post(self, body: bytes) -> bool:
        for wait in waits():
            stamp = str(int(time.time()))
            headers = {"content-type": "application/json", "x-timestamp": stamp}
            if self.secret is not None:
                headers["x-signature"] = "sha256=" + sign(self.secret, stamp, body)
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=30) as answer:
                    if 200 <= answer.status < 300:
                        return True
            except urllib.error.HTTPError as e:
                if e.code == 410:
                    self.disabled = True
                    return False
            except OSError:
                pass
            self.sleep(wait)
        return False


#: What of a webhook is stored.
_STORED = ("url", "secret", "disabled", "position", "ops", "filter", "gaps")


class Subscriptions:
    """The webhooks of a collection with their progress, as documents of a log of their own, so that another process goes on."""

    def __init__(self, log: Log):
        self.log = log

    def create(self, hook: Webhook) -> Webhook:
        """Under an id that is free; what the subscription asks for is checked first."""
        parse_change_ops(hook.ops)
        parse_filter(hook.filter)
        self.log.put(hook.id, self._stored(hook), if_none_match="*")
        return hook

    def _stored(self, hook: Webhook) -> dict:
        return {name: getattr(hook, name) for name in _STORED}

    def get(self, id: str) -> Webhook:
        return Webhook(id, **self.log.get(id)[0], committed=self.save)

    def list(self) -> list[Webhook]:
        rows = snapshot(self.log.read()).orderBy("key").collect()
        return [Webhook(r["key"], **json.loads(r["value"]), committed=self.save) for r in rows]

    def delete(self, id: str) -> bool:
        return bool(self.log.delete(id).existed)

    def save(self, hook: Webhook) -> None:
        self.log.put(hook.id, self._stored(hook))

    def pump(self, id: str, collection: str, log: Log, buffer: int | None = None) -> Webhook:
        """Sends what has changed since the last acknowledged post and keeps the position after each.

        With a buffer of the newest changes a position below it is a gap: it is counted and the feed goes on at the floor.
        """
        hook = self.get(id)
        changes = classify(log.read())
        floor = 0 if buffer is None else retention_floor(changes, buffer)
        if hook.position < floor:
            hook.gaps, hook.position = hook.gaps + 1, floor
            self.save(hook)
        wanted = admitted(resume(changes, hook.position, log.head(), floor), parse_change_ops(hook.ops), parse_filter(hook.filter))
        hook.deliver(collection, (event(r) for r in wanted.orderBy("lsn").toLocalIterator()))
        if hook.disabled:
            self.save(hook)
        return hook


def stream_to(webhook: Webhook, collection: str, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs the webhook on a stream of changes. The checkpoint is committed after the posts: at least once.

    Events pass through the driver in log order, one micro-batch at a time and a partition at a time.
    """

    def send(batch: DataFrame, _: int) -> None:
        webhook.deliver(collection, (event(r) for r in batch.orderBy("lsn").toLocalIterator()))

    return changes.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
