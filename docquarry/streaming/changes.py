"""Changes: what each log entry did to its document.

A put on an absent key is an insert, on a present one an update; a deletion of a present key is a delete,
of an absent one nothing; a drop is one change without a key, after which every key is absent. Entries
that moved between nodes change the state but are not published.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docquarry.errors import Conflict, Gone, Refused
from docquarry.operators.filtering import compile_filter
from docquarry.operators.values import VariantValue
from docquarry.plans.filters import Branch
from docquarry.plans.requests import CHANGE_OPS, decode_cursor, encode_cursor

#: Log numbers in which drops are counted together; see ``epochs``.
STRETCH = 1 << 20


def epochs(log: DataFrame) -> DataFrame:
    """Adds ``epoch``, the number of drops up to an entry.

    A running count over the whole log would take one task. Drops are counted by stretches of the log numbers
    instead, summed up over the stretches that there are, a row for each ``STRETCH`` numbers, and joined by stretch; the
    count runs on within a stretch.
    """
    stretch = F.floor(F.col("lsn") / STRETCH)
    drops = F.sum(F.when(F.col("op") == "drop", 1).otherwise(0))
    each = log.groupBy(stretch.alias("stretch")).agg(drops.alias("n"))
    before = F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    sums = each.select("stretch", F.coalesce(before, F.lit(0)).alias("before"))
    counted = log.withColumn("stretch", stretch).withColumn("within", drops.over(Window.partitionBy("stretch").orderBy("lsn")))
    return counted.join(sums, "stretch").withColumn("epoch", F.col("before") + F.col("within")).drop("before", "within", "stretch")


def classify(log: DataFrame) -> DataFrame:
    """``lsn, op, key, value`` of each change; ``value`` is NULL for deletes and drops."""
    relevant = log.where(F.col("op").isin("put", "del", "drop"))
    if relevant.where("op = 'drop'").head(1):
        parts = epochs(relevant)
    else:
        parts = relevant.withColumn("epoch", F.lit(0))
    # Drops have no key; they are not sent to the keys' tasks.
    keyed = parts.where("op != 'drop'")
    before = F.lag("op").over(Window.partitionBy("epoch", "key").orderBy("lsn"))
    present = F.coalesce(before == "put", F.lit(False))
    op = F.when(F.col("op") == "put", F.when(present, "update").otherwise("insert")).when(present, "delete")
    moved = F.coalesce("migration", F.lit(False)) if "migration" in log.columns else F.lit(False)
    value = F.when(F.col("op") == "put", F.col("value"))
    changes = keyed.select("lsn", op.alias("op"), "key", value.alias("value"), moved.alias("moved"))
    dropped = parts.where("op = 'drop'").select("lsn", F.lit("drop").alias("op"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), moved.alias("moved"))
    return changes.unionByName(dropped).where("op IS NOT NULL AND NOT moved").drop("moved")


def admitted(changes: DataFrame, ops: Iterable[str] = CHANGE_OPS, filter: Branch | None = None) -> DataFrame:
    """Changes of these kinds; the filter judges those that carry a document, deletes and drops pass."""
    out = changes.where(F.col("op").isin(*ops))
    if filter is None:
        return out
    judged = out.withColumn("doc", F.parse_json("value"))
    return judged.where(F.col("value").isNull() | compile_filter(filter, VariantValue(F.col("doc")))).drop("doc")


def resume(changes: DataFrame, after: int | None, head: int, floor: int = 0) -> DataFrame:
    """Changes after a position; from now on if it is None."""
    if after is None:
        after = head
    if after > head:
        raise Refused(f"position {after} is above the log's {head}")
    if after < floor:
        raise Gone(f"changes up to {floor} are no longer kept", floor)
    return changes.where(F.col("lsn") > after)


def retention_floor(changes: DataFrame, buffer: int) -> int:
    """The position below which a buffer of the newest changes can't resume."""
    newest = changes.select("lsn").orderBy(F.col("lsn").desc()).limit(buffer + 1).collect()
    return newest[-1]["lsn"] if len(newest) > buffer else 0


_EVENT = "lsn bigint, op string, key string, value string"


def classify_stream(log: DataFrame) -> DataFrame:
    """``classify`` on a stream: the state of a key is whether it is present.

    Within a micro-batch the entries of a key are taken in log order. For logs without drops, which would
    touch every key's state: a drop fails the query rather than being passed over.
    """
    kept = log.where(F.col("op").isin("put", "del", "drop"))
    guarded = kept.withColumn("op", F.when(F.col("op") == "drop", F.raise_error(F.lit("a drop can't be classified on a stream"))).otherwise(F.col("op")))
    rows = guarded.select("lsn", "op", "key", "value", F.coalesce("migration", F.lit(False)).alias("moved"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        present = state.get[0] if state.exists else False
        batch = pd.concat(list(frames)).sort_values("lsn", kind="stable")
        ops = []
        for op in batch["op"]:
            ops.append(("update" if present else "insert") if op == "put" else "delete" if present else None)
            present = op == "put"
        # Absent keys need no state.
        if present:
            state.update((True,))
        elif state.exists:
            state.remove()
        out = batch.assign(op=ops, value=batch["value"].where(batch["op"] == "put", None))
        yield out[out["op"].notna() & ~out["moved"]][["lsn", "op", "key", "value"]]

    return rows.groupBy("key").applyInPandasWithState(step, _EVENT, "present boolean", "append", GroupStateTimeout.NoTimeout)


def merged(shards: dict[int, DataFrame]) -> DataFrame:
    """Changes of several logs as one feed with a ``shard``; they are ordered within a shard only."""
    parts = [changes.withColumn("shard", F.lit(n)) for n, changes in sorted(shards.items())]
    if not parts:
        raise Refused("a feed has at least one shard")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merged_position(positions: dict[int, int], layout: int | None = None) -> str:
    """A cursor of a merged feed: the last number of each shard, and the layout it holds for."""
    return encode_cursor({"shards": {str(n): lsn for n, lsn in sorted(positions.items())}, "ring": layout})


def resume_merged(shards: dict[int, DataFrame], cursor: str, layout: int | None = None) -> DataFrame:
    """Each shard's changes after its position in the cursor; a cursor of another layout conflicts."""
    position = decode_cursor(cursor)
    after = position.get("shards")
    if not isinstance(after, dict) or not all(isinstance(x, int) for x in after.values()):
        raise Refused("the cursor is not of a merged feed")
    if position.get("ring") != layout or {int(n) for n in after} != set(shards):
        raise Conflict("the layout has changed since the cursor was issued; start again")
    return merged({n: changes.where(F.col("lsn") > after[str(n)]) for n, changes in shards.items()})


def deduplicated(changes: DataFrame, shard: Column | None = None) -> DataFrame:
    """Delivery is at least once; a change is known by its shard and number."""
    return changes.withColumn("shard", F.lit(0) if shard is None else shard).dropDuplicates(["shard", "lsn"])


def frames(collection: str, position: int, changes: DataFrame, error: str | None = None) -> Iterator[dict]:
    """What a subscriber is sent: ``open``, the changes in log order, and at most one error."""
    yield {"event": "open", "position": position, "data": {"collection": collection, "position": position}}
    for row in changes.orderBy("lsn").toLocalIterator():
        yield {"event": "change", "position": row["lsn"], "data": event(row)}
    if error is not None:
        yield {"event": "error", "position": None, "data": {"error": error}}


def event(row) -> dict:
    out = {"lsn": row["lsn"], "op": row["op"]}
    if row["key"] is not None:
        out["key"] = row["key"]
    if row["value"] is not None:
        out["value"] = json.loads(row["value"])
    return out


def sse(frame: dict) -> str:
    """A frame as a server-sent event; its id is where to resume."""
    head = f"id: {frame['position']}\n" if frame["position"] is not None else ""
    return f"event: {frame['event']}\n{head}data: {json.dumps(frame['data'], ensure_ascii=False)}\n\n"


def message(frame: dict) -> str:
    """A frame as one WebSocket message."""
    return json.dumps({"event": frame["event"], **({"position": frame["position"]} if frame["position"] is not None else {}), **frame["data"]}, ensure_ascii=False)


def stream_frames(collection: str, position: int, changes: DataFrame, write: Callable[[str], None], form: Callable[[dict], str], checkpoint: str, **trigger) -> StreamingQuery:
    """Writes a stream of changes to a subscriber as server-sent events (``sse``) or WebSocket messages (``message``).

    ``open`` comes first, then the changes in log order within each micro-batch; if the sink fails, one ``error`` ends it.
    """
    write(form({"event": "open", "position": position, "data": {"collection": collection, "position": position}}))

    def send(batch: DataFrame, _: int) -> None:
        try:
            for row in batch.where(F.col("lsn") > position).orderBy("lsn").toLocalIterator():
                write(form({"event": "change", "position": row["lsn"], "data": event(row)}))
        except Exception as e:
            write(form({"event": "error", "position": None, "data": {"error": str(e)}}))
            raise

    return changes.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
