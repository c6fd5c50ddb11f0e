"""What the messages of a connection come to: headers that wait for payloads, batches, resets and timeouts, in order.

A connection has a place for one open header and one for one open batch header. A payload goes to the batch if one is open,
else to the header. A header that comes while its place is taken is refused, a batch header while either is. A reset
empties both. What has been open for longer than the wait is told as timed out and is gone before the next message is
looked at. The same steps run over a table, whose rows are sorted by connection, and over a stream, where the two places
are the state of a connection and event time sets the timeouts.

messages: connection_id, seq (place in the connection), time, message (JSON, null for a payload), content (a payload's, else null).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kerbside.shared import work_partitions
from kerbside.sources.readers import MAX_PAYLOAD, parse_headers, split_batches

#: Fixed value: milliseconds that a header waits for its payload.
WAIT_MS = 60_000

#: A row per message, and one per header that times out (kind timeout, seq of the header, time at which its wait is over).
#: A payload has header_seq, and header (JSON) where it is taken; session_id is that of the connection by then.
OUT_SCHEMA = "connection_id string, seq long, time timestamp, kind string, request_id string, session_id string, header_seq long, header string, code string, content binary"
_COLUMNS = [c.split()[0] for c in OUT_SCHEMA.split(", ")]


@dataclass
class Open:
    """A header that waits: its place, its milliseconds, its text, its request_id, and the bytes its payload has to have (or None)."""

    seq: int
    since: int
    header: str
    request_id: str | None
    size: int | None


@dataclass
class Connection:
    wait_ms: int = WAIT_MS
    limit: int = MAX_PAYLOAD
    places: dict[str, Open] = field(default_factory=dict)  # infer_header, infer_batch
    session_id: str | None = None
    last_seq: int | None = None

    def overdue(self, now: int) -> list[Open]:
        """Empties the places whose wait is over, and tells what was in them, the header first."""
        late = [kind for kind in ("infer_header", "infer_batch") if kind in self.places and now - self.places[kind].since > self.wait_ms]
        return [self.places.pop(kind) for kind in late]

    def take(self, seq: int, now: int, kind: str, code: str | None, request_id: str | None, session_id: str | None, header: str | None, size: int | None) -> tuple[str | None, int | None, str | None, str | None]:
        """request_id, header_seq, header and code of a message. size: of a payload, or what a batch header says."""
        if kind == "payload":
            open_ = self.places.pop("infer_batch", None) or self.places.pop("infer_header", None)
            if open_ is None:
                return None, None, None, "unexpected_binary"
            code = "payload_too_large" if size > self.limit else "payload_size_mismatch" if open_.size not in (None, size) else None
            return open_.request_id, open_.seq, None if code else open_.header, code
        if code is None and kind in ("infer_header", "infer_batch"):
            if kind in self.places or kind == "infer_batch" and self.places:
                return request_id, None, None, "previous_header_unpaired"
            self.places[kind] = Open(seq, now, header, request_id if kind == "infer_header" else None, size if kind == "infer_batch" else None)
            self.session_id = session_id or self.session_id
        elif code is None and kind == "reset":
            self.places.clear()
            self.session_id = session_id or self.session_id
        return request_id, None, None, code

    def dump(self) -> str:
        return json.dumps({"places": {k: vars(v) for k, v in self.places.items()}, "session_id": self.session_id, "last_seq": self.last_seq})

    @classmethod
    def load(cls, data: str, wait_ms: int, limit: int) -> Connection:
        state = json.loads(data)
        return cls(wait_ms, limit, {k: Open(**v) for k, v in state["places"].items()}, state["session_id"], state["last_seq"])


def prepared(messages: DataFrame) -> DataFrame:
    """connection_id, seq, time, kind, request_id, session, size, code, message, content: what the steps look at, read by columns."""
    text = messages.select(F.col("connection_id").cast("string").alias("connection_id"), F.col("seq").cast("long").alias("seq"), "time", "message", F.col("content").cast("binary").alias("content"))
    parsed = parse_headers(text)
    binary = F.col("content").isNotNull()
    expected = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, s: a + s)
    return parsed.select(
        "connection_id", "seq", "time", F.when(binary, "payload").otherwise(F.coalesce("type", F.lit(""))).alias("kind"),
        F.when(~binary, F.col("request_id")).alias("request_id"), F.when(~binary, F.col("session_id")).alias("session"),
        F.when(binary, F.octet_length("content").cast("long")).otherwise(expected).alias("size"), F.when(~binary, F.col("code")).alias("code"), "message", "content",
    )


def pair_connections(messages: DataFrame, wait_ms: int = WAIT_MS, limit: int = MAX_PAYLOAD, until=None) -> DataFrame:
    """OUT_SCHEMA of a table of messages. until: the time (a constant column or timestamp) up to which open headers at a connection's
    end are looked at again, by default the latest of all messages.

    A connection's messages are read in the order of seq by one task, which holds two headers; payloads pass as they are.
    A seq that comes again is left out. Rows with a null connection_id, seq or time keep their code and take no part.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = prepared(messages)
    last = messages.agg(F.max("time")).scalar() if until is None else F.lit(until)
    known = F.col("connection_id").isNotNull() & F.col("seq").isNotNull() & F.col("time").isNotNull()
    timed = rows.where(known).withColumns({"ms": F.unix_millis("time"), "until": F.unix_millis(last.cast("timestamp"))})
    dealt = timed.repartition(work_partitions(messages.sparkSession), "connection_id").sortWithinPartitions("connection_id", "seq")

    def run(batches):
        name, conn, end = None, None, 0
        schema = None

        def timeouts(found, waited):
            ms = [o.since + waited for o in found]
            n = len(found)
            columns = {"connection_id": [name] * n, "seq": [o.seq for o in found], "time": ms, "kind": ["timeout"] * n, "request_id": [o.request_id for o in found], "session_id": [conn.session_id] * n, "header_seq": [o.seq for o in found], "header": [None] * n, "code": ["header_timeout"] * n, "content": [None] * n}
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], pa.int64()).cast(pa.timestamp("ms")).cast(pa.timestamp("us")).cast(f.type) if f.name == "time" else pa.array(columns[f.name], f.type) for f in schema], schema=schema)

        for batch in batches:
            n = batch.num_rows
            if schema is None:
                time = batch.schema.field("time").type
                schema = pa.schema([("connection_id", pa.string()), ("seq", pa.int64()), ("time", time), ("kind", pa.string()), ("request_id", pa.string()), ("session_id", pa.string()), ("header_seq", pa.int64()), ("header", pa.string()), ("code", pa.string()), ("content", pa.binary())])
            out, stays, late = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("connection_id", "seq", "ms", "kind", "code", "request_id", "session", "message", "size", "until")]
            for connection, seq, ms, kind, code, request, session, header, size, until_ms in zip(*columns, strict=True):
                if connection != name:
                    if conn is not None and (found := conn.overdue(end)):
                        late.append(timeouts(found, wait_ms))
                    name, conn = connection, Connection(wait_ms, limit)
                end = until_ms
                if conn.last_seq is not None and seq <= conn.last_seq:
                    stays.append(False)
                    continue
                conn.last_seq = seq
                if found := conn.overdue(ms):
                    late.append(timeouts(found, wait_ms))
                out.append((*conn.take(seq, ms, kind, code, request, session, header, size), conn.session_id))
                stays.append(True)
            batch = batch.filter(pa.array(stays, pa.bool_())) if n else batch
            request, header_seq, header, code, session = zip(*out, strict=True) if out else ([],) * 5
            content = pc.if_else(pc.is_valid(pa.array(header, pa.string())), batch.column("content"), pa.scalar(None, batch.column("content").type))
            made = {"request_id": request, "session_id": session, "header_seq": header_seq, "header": header, "code": code}
            yield pa.RecordBatch.from_arrays([content.cast(f.type) if f.name == "content" else pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in schema], schema=schema)
            yield from late
        if conn is not None and (found := conn.overdue(end)):
            yield timeouts(found, wait_ms)

    odd = rows.where(~known).select("connection_id", "seq", "time", "kind", "request_id", F.col("session").alias("session_id"), F.lit(None).cast("long").alias("header_seq"), F.lit(None).cast("string").alias("header"), "code", F.lit(None).cast("binary").alias("content"))
    return dealt.mapInArrow(run, OUT_SCHEMA).unionByName(odd)


class ConnectionProcessor(StatefulProcessor):
    """The same for a stream: the two places are a connection's state, event-time timers end their waits."""

    def __init__(self, wait_ms: int = WAIT_MS, limit: int = MAX_PAYLOAD):
        self.wait_ms, self.limit = wait_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("connection", "data string")

    def _load(self) -> Connection:
        return Connection.load(self.state.get()[0], self.wait_ms, self.limit) if self.state.exists() else Connection(self.wait_ms, self.limit)

    def _timeouts(self, key: str, conn: Connection, now: int) -> list[tuple]:
        return [(key, o.seq, pd.Timestamp(o.since + self.wait_ms, unit="ms"), "timeout", o.request_id, conn.session_id, o.seq, None, "header_timeout", None) for o in conn.overdue(now)]

    def _keep(self, conn: Connection) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for open_ in conn.places.values():
            self.handle.registerTimer(open_.since + self.wait_ms + 1)
        self.state.update((conn.dump(),))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=_COLUMNS)
        return frame.astype({"header_seq": "Int64", "seq": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        conn, out = self._load(), []
        found = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        found = found.astype(object).where(found.notna(), None)
        for r in found.itertuples(index=False):
            if conn.last_seq is not None and r.seq <= conn.last_seq:
                continue
            conn.last_seq = int(r.seq)
            out += self._timeouts(key[0], conn, int(r.ms))
            request, header_seq, header, code = conn.take(int(r.seq), int(r.ms), r.kind, r.code, r.request_id, r.session, r.message, None if r.size is None else int(r.size))
            out.append((key[0], r.seq, pd.Timestamp(r.time), r.kind, request, conn.session_id, header_seq, header, code, r.content if header is not None else None))
        self._keep(conn)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        conn = self._load()
        out = self._timeouts(key[0], conn, expiredTimerInfo.getExpiryTimeInMs())
        self._keep(conn)
        yield self._frame(out)

    def close(self) -> None:
        pass


def connection_stream(messages: DataFrame, wait_ms: int = WAIT_MS, limit: int = MAX_PAYLOAD, late: str = "10 seconds") -> DataFrame:
    """OUT_SCHEMA of a stream of messages. Needs the RocksDB state store.

    Messages of a connection come in the order of seq, as they do on a wire; those of one micro-batch may come in any.
    late: by how much connections may be behind each other. Rows with a null connection_id, seq or time are left out.
    """
    rows = prepared(messages).where("connection_id is not null and seq is not null and time is not null").withColumn("ms", F.unix_millis("time"))
    keyed = rows.withWatermark("time", late).groupBy("connection_id")
    return keyed.transformWithStateInPandas(ConnectionProcessor(wait_ms, limit), OUT_SCHEMA, "append", "EventTime")


def requests(paired: DataFrame) -> DataFrame:
    """connection_id, header_seq, idx, session_id, request_id, frame_id, features, config, content of the frames that came with
    taken payloads: one of a header, and those of a batch, each with its bytes."""
    taken = paired.where("header is not null").select("connection_id", "header_seq", "header", F.col("session_id").alias("default_session"), "content")
    h = parse_headers(taken, "header").withColumn("session_id", F.coalesce("session_id", "default_session")).drop("code", "header", "default_session")
    one = h.where("type = 'infer_header'").select("connection_id", "header_seq", F.lit(0).alias("idx"), "session_id", "request_id", "frame_id", "features", "config", "content")
    batch = h.where("type = 'infer_batch'").select("connection_id", "header_seq", "session_id", "features", "config", "frames", "sizes", "content")
    return one.unionByName(split_batches(batch).select(*one.columns))


def refusals(paired: DataFrame) -> DataFrame:
    """request_id and code of all that was refused or timed out, for kerbside.sources.sinks.errors()."""
    return paired.where("code is not null").select(F.coalesce("request_id", F.lit("")).alias("request_id"), "code")
