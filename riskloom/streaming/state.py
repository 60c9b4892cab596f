"""Per-entity feature state in event order.

Rows wait in the state of their entity until the watermark has passed them and are then taken in order of (event time, id), so
whatever order they arrive in within the delay, the features are those of the ordered table. A timer releases the rows
that are due; the delay is therefore what a feature is late by. A row that repeats the id and time of another is the same event, sent
again: either both wait at once and one is taken, or the watermark has passed the second.

A call to the state store costs some ten times an event, and an entity has few events in a trigger. So the state of the features is
keyed by a hash of the entity (:class:`Buckets`): the entities of a bucket share its timer and its waiting rows, and are kept some
``PAGE`` in an entry, so that a trigger reads and writes the entries of the entities it brings, a few calls for each bucket and entry.

Sliding windows keep one entry a second, in map entries of ``CHUNK`` seconds, a running total per window and the place of its
oldest second. An event adds to the newest second and moves the places on, each over every second once; nothing else is read, so
an event costs the same whatever the window holds. Sums of a window are exact (:class:`Exact`), and seconds older than the widest
window leave the state. The newest entry is kept with the entity, full ones apart. The same timer forgets an entity that was silent
for 30 days.
"""

from __future__ import annotations

import json
import math
import pickle
import zlib
from collections.abc import Iterator
from itertools import chain, groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskloom.contracts import SECONDS_1H, SECONDS_24H, SECONDS_30D, SECONDS_5M, SHIFT_MEMORY, SHIFT_STICKY

COMPUTED = {"burst_count_5m": "bigint", "burst_count_1h": "bigint", "burst_count_24h": "bigint", "burst_sum_1h": "double",
            "tx_count_5m": "bigint", "tx_count_1h": "bigint", "tx_count_24h": "bigint", "sum_amount_1h": "double",
            "unique_merchants_1h": "int", "device_shift": "int", "amount_zscore": "double"}
WINDOWED = {"window_start": "double", "window_count": "bigint", "over_limit": "boolean"}
BURSTS = (SECONDS_5M, SECONDS_1H, SECONDS_24H)
SLIDING = (SECONDS_5M, SECONDS_1H, SECONDS_24H)
#: Rows of a waiting entry, seconds of a window entry, and merchants of a bucket in the state before buckets double.
WAITING, CHUNK, BUCKET = 256, 64, 64
#: Keys of the feature state, entities of an entry in it before entries double, and buckets of merchants kept with the entity.
BUCKETS, PAGE, NEAR = 1024, 32, 2
#: Rows that a call puts out as one row of arrays.
OUT_ROWS = 4096


class Exact:
    """A sum of doubles as ``m * 2**e``, added to and taken from without rounding; NaN and infinities are counted beside it."""

    def __init__(self, m: int = 0, e: int = 0, nan: int = 0, up: int = 0, down: int = 0):
        self.m, self.e, self.odd = m, e, [nan, up, down]

    @classmethod
    def of(cls, x: float) -> Exact:
        if x != x or x in (math.inf, -math.inf):
            return cls(0, 0, int(x != x), int(x == math.inf), int(x == -math.inf))
        fraction, exponent = math.frexp(x)
        m, e = int(math.ldexp(fraction, 53)), exponent - 53
        zeros = (m & -m).bit_length() - 1 if m else 0
        return cls(m >> zeros, e + zeros if m else 0)

    def add(self, other: Exact, sign: int = 1) -> None:
        if other.m:
            e = min(self.e, other.e) if self.m else other.e
            self.m, self.e = (self.m << (self.e - e) if self.m else 0) + sign * (other.m << (other.e - e)), e
        for k, n in enumerate(other.odd):
            self.odd[k] += sign * n

    def value(self) -> float:
        nan, up, down = self.odd
        if nan or (up and down):
            return math.nan
        if up or down:
            return math.inf if up else -math.inf
        try:
            return float(self.m << self.e) if self.e >= 0 else self.m / (1 << -self.e)
        except OverflowError:
            return math.inf if self.m > 0 else -math.inf

    def stored(self) -> list[int]:
        return [self.m, self.e, *self.odd] if any(self.odd) else [self.m, self.e]


class Entries:
    """Map state of JSON values, read once and written back at the end of a call."""

    load, dump = staticmethod(json.loads), staticmethod(json.dumps)

    def __init__(self, state):
        self.state, self.known, self.changed = state, {}, set()

    def get(self, key):
        if key not in self.known:
            found = self.state.getValue((key,))
            self.known[key] = self.load(found[0]) if found else None
        return self.known[key]

    def put(self, key, value) -> None:
        """A value of None removes the key."""
        self.known[key] = value
        self.changed.add(key)

    def write(self) -> None:
        for key in self.changed:
            if self.known[key] is None:
                self.state.removeKey((key,))
            else:
                self.state.updateValue((key,), (self.dump(self.known[key]),))
        self.known, self.changed = {}, set()


def _packed(value) -> bytes:
    return pickle.dumps(value, 5)


class Packed(Entries):
    """Map state of pickled values."""

    load, dump = staticmethod(pickle.loads), staticmethod(_packed)


class Near:
    """Entries of one entity: some in its own record (``here``), the others in map state under the entity's name.

    ``stays`` says which ones are kept in the record; the others leave it at the end of a call.
    """

    def __init__(self, here: dict, apart: Entries, entity, stays):
        self.here, self.apart, self.entity, self.stays, self.changed = here, apart, str(entity), stays, set()

    def _name(self, key) -> str:
        return f"{key}|{self.entity}"

    def get(self, key):
        return self.here[key] if key in self.here else self.apart.get(self._name(key))

    def put(self, key, value) -> None:
        if value is None and key not in self.here:
            self.apart.put(self._name(key), None)
        elif value is None:
            del self.here[key]
        else:
            self.here[key] = value

    def write(self) -> None:
        for key in self.changed:
            if key not in self.here:
                self.apart.changed.add(self._name(key))
        for key in [k for k in self.here if not self.stays(k)]:
            self.apart.put(self._name(key), self.here.pop(key))


class LastSeen:
    """The last second of each merchant of the last hour, in buckets by hash whose number doubles with the merchants."""

    def __init__(self, head: dict, entries: Entries):
        self.head, self.entries = head, entries
        head.setdefault("buckets", 1)
        head.setdefault("merchants", 0)

    def _bucket(self, merchant: str) -> dict:
        return self._load(zlib.crc32(merchant.encode()) % self.head["buckets"])

    def _load(self, k: int) -> dict:
        found = self.entries.get(k)
        if found is None:
            self.entries.put(k, found := {})
        return found

    def get(self, merchant: str) -> float | None:
        return self._bucket(merchant).get(merchant)

    def put(self, merchant: str, t: float) -> None:
        bucket = self._bucket(merchant)
        self.head["merchants"] += merchant not in bucket
        bucket[merchant] = t
        self.entries.changed.add(zlib.crc32(merchant.encode()) % self.head["buckets"])
        if self.head["merchants"] > BUCKET * self.head["buckets"]:
            self._double()

    def drop(self, merchant: str) -> None:
        del self._bucket(merchant)[merchant]
        self.head["merchants"] -= 1
        self.entries.changed.add(zlib.crc32(merchant.encode()) % self.head["buckets"])

    def _double(self) -> None:
        n = self.head["buckets"]
        self.head["buckets"] = 2 * n
        for k in range(n):
            halves: tuple[dict, dict] = ({}, {})
            for m, t in self._load(k).items():
                halves[zlib.crc32(m.encode()) % (2 * n) >= n][m] = t
            self.entries.put(k, halves[0])
            self.entries.put(k + n, halves[1])


class Seconds:
    """The seconds of the widest window: ``head`` holds totals and places, ``entries`` the seconds, ``seen`` each merchant's last one.

    A place is (entry, index in it) of the oldest second that a window still holds, and ``due`` its time, as long as it is known. Counts
    are over [t - w, t], merchants over (t - 1 h, t].
    """

    def __init__(self, head: dict, entries: Entries, seen: LastSeen):
        self.head, self.entries, self.seen = head, entries, seen
        if "at" not in head:
            head |= {"at": [[0, 0] for _ in range(len(SLIDING) + 1)], "n": [0] * len(SLIDING), "hour": [0, 0], "newest": 0}
            entries.put(0, [])
        head.setdefault("due", [None] * len(head["at"]))
        self.hour = Exact(*head["hour"])

    def _leave(self, k: int, low: float, strictly: bool) -> Iterator[list]:
        """The seconds before ``low`` (or at it), from a place on, which moves past them."""
        place, due = self.head["at"][k], self.head["due"]
        if due[k] is not None and (due[k] > low or (due[k] == low and strictly)):
            return
        while True:
            rows = self.entries.get(place[0])
            if place[1] >= len(rows):
                due[k] = None
                if place[0] == self.head["newest"]:
                    return
                place[:] = place[0] + 1, 0
                continue
            row = rows[place[1]]
            due[k] = row[0]
            if row[0] > low or (row[0] == low and strictly):
                return
            place[1] += 1
            yield row

    def add(self, t: float, amount: float, merchant: str | None) -> None:
        head, oldest = self.head, self.head["at"][-2][0]
        for k, w in enumerate(SLIDING):
            for row in self._leave(k, t - w, True):
                head["n"][k] -= row[1]
                if w == SECONDS_1H:
                    self.hour.add(self._sum(row), -1)
        for row in self._leave(len(SLIDING), t - SECONDS_1H, False):
            for m in row[3:]:
                if self.seen.get(m) == row[0]:
                    self.seen.drop(m)
        for gone in range(oldest, head["at"][-2][0]):
            self.entries.put(gone, None)
        rows = self.entries.get(head["newest"])
        one = Exact.of(amount)
        if not rows or rows[-1][0] != t:
            if len(rows) >= CHUNK:
                head["newest"], rows = head["newest"] + 1, []
            rows.append([t, 1, float(amount)])
        else:
            row = rows[-1]
            whole = self._sum(row)
            whole.add(one)
            row[1:3] = row[1] + 1, whole.stored()
        self.hour.add(one)
        head["n"] = [n + 1 for n in head["n"]]
        if merchant and self.seen.get(merchant) != t:
            rows[-1].append(merchant)
            self.seen.put(merchant, t)
        self.entries.put(head["newest"], rows)

    @staticmethod
    def _sum(row: list) -> Exact:
        """The amounts of a second: (time, events, the only amount or the exact sum, merchants ...)."""
        return Exact.of(row[2]) if isinstance(row[2], float) else Exact(*row[2])

    def write(self) -> None:
        self.head["hour"] = self.hour.stored()
        self.entries.write()
        self.seen.entries.write()


class Entity:
    """What an entity's events so far leave behind; :meth:`add` takes the next event in order and returns its features."""

    def __init__(self, head: dict, seconds: Seconds):
        head.setdefault("run", [0, 0.0, 0.0, None, [0, 0, 0], 0.0, None, None, None])
        self.head, self.seconds = head, seconds

    def add(self, t: float, amount: float, device: str | None, merchant: str | None) -> tuple:
        n, mean, m2, last, bursts, burst_sum, known, known_at, shift_at = self.head["run"]
        silence = None if last is None else t - last
        if silence is not None and silence >= SECONDS_30D:
            n, mean, m2 = 0, 0.0, 0.0
        n += 1
        delta = amount - mean
        mean += delta / n
        m2 += delta * (amount - mean)
        std = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
        expired = [silence is None or silence >= w for w in BURSTS]
        bursts = [1 if gone else b + 1 for gone, b in zip(expired, bursts)]
        burst_sum = amount if expired[1] else burst_sum + amount
        if known and known != (device or "") and t - known_at < SHIFT_MEMORY:
            shift_at = t
        self.head["run"] = [n, mean, m2, t, bursts, burst_sum, device or "", t, shift_at]
        self.seconds.add(t, amount, merchant)
        counts = self.head["n"]
        return (*bursts, burst_sum, *counts, self.seconds.hour.value(), max(self.head["merchants"], 1),
                int(shift_at is not None and t - shift_at < SHIFT_STICKY), (amount - mean) / std if std > 0 else 0.0)


class InOrder(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them; :meth:`take` then gets them in order.

    Few waiting rows are kept in the head, which a call reads and writes in any case; more than ``WAITING`` go to entries of their own.
    ``keep`` is how many seconds after its last event a key is forgotten.
    """

    given: tuple[str, ...] = ()
    made: dict[str, str] = {}
    keep: float = SECONDS_30D

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "json string")
        self.waiting = handle.getMapState("waiting", "entry bigint", "json string")

    def take(self, head: dict, rows: list[list]) -> list[tuple]:
        """What is made of each row (event time, id, microseconds, given columns ...); changes ``head``."""
        raise NotImplementedError

    def forget(self) -> None:
        """Clears further state of a key."""

    def close(self) -> None:
        pass

    def _read(self) -> dict:
        found = self.head.get()
        return json.loads(found[0]) if found else {"next": 0, "open": [], "here": [], "timer": None}

    def _set_timer(self, head: dict, at: int) -> None:
        if head["timer"] is not None:
            self.handle.deleteTimer(head["timer"])
        self.handle.registerTimer(at)
        head["timer"] = at

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            return iter(())
        new = [list(r[2:]) for r in rows if r.event_us is not None and r.event_time_seconds is not None]  # others have no place in the order
        if not new:
            return iter(())
        head = self._read()
        at = -(-min(r[2] for r in new) // 1000)
        head["here"] += new
        if len(head["here"]) > WAITING:
            new, head["here"], waiting = sorted(head["here"], key=lambda r: r[2]), [], Entries(self.waiting)
            for k in range(0, len(new), WAITING):
                waiting.put(head["next"], new[k:k + WAITING])
                head["open"].append([head["next"], new[k][2]])
                head["next"] += 1
            waiting.write()
        if head["timer"] is None or at < head["timer"]:
            self._set_timer(head, at)
        self.head.update((json.dumps(head),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        head, waiting, still = self._read(), Entries(self.waiting), []
        passed = timerValues.getCurrentWatermarkInMs()
        due = [r for r in head["here"] if r[2] <= passed * 1000]
        head["here"] = [r for r in head["here"] if r[2] > passed * 1000]
        for entry, first in head["open"]:
            if first > passed * 1000:
                still.append([entry, first])
                continue
            rows = waiting.get(entry)
            due += [r for r in rows if r[2] <= passed * 1000]
            rest = [r for r in rows if r[2] > passed * 1000]
            waiting.put(entry, rest or None)
            if rest:
                still.append([entry, rest[0][2]])
        waiting.write()
        head["open"], head["timer"] = still, None
        due.sort(key=lambda r: (r[0], r[1] is not None, r[1]))
        due = [r for k, r in enumerate(due) if not k or r[1] is None or r[:2] != due[k - 1][:2]]
        made = self.take(head, due) if due else []
        if due:
            head["last"] = due[-1][2]
        firsts = [first for _, first in still] + [r[2] for r in head["here"]]
        if firsts:
            self._set_timer(head, -(-min(firsts) // 1000))
        elif head["last"] // 1000 + int(self.keep * 1000) > passed:
            self._set_timer(head, head["last"] // 1000 + int(self.keep * 1000))
        else:
            self.head.clear()
            self.forget()
            head = None
        if head is not None:
            self.head.update((json.dumps(head),))
        out = Row("entity_id", "event_time_seconds", "transaction_id", "event_us", *self.given, *self.made)
        for row, more in zip(due, made):
            yield out(key[0], *row, *more)


class Buckets(StatefulProcessor):
    """As :class:`InOrder`, for all entities whose hash is the key: one timer and one queue of waiting rows for a bucket.

    An entity's record is a dict in an entry of ``entities`` (page by hash of the entity; pages double with the entities). ``oldest``
    holds the time of the last event of each page's longest silent entity.
    """

    given: tuple[str, ...] = ()
    made: dict[str, str] = {}
    keep: float = SECONDS_30D

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "state binary")
        self.waiting = handle.getMapState("waiting", "entry bigint", "state binary")
        self.entities = handle.getMapState("entities", "page bigint", "state binary")

    def take(self, entity, record: dict, rows: list[tuple]) -> list[tuple]:
        """What is made of each row (entity, event time, id, microseconds, given columns ...); changes ``record``."""
        raise NotImplementedError

    def forget(self, entity, record: dict) -> None:
        """Drops what is kept of an entity beside its record."""

    def begin(self) -> None:
        """Before entities are taken or forgotten."""

    def end(self) -> None:
        """After it; writes what was changed beside the records."""

    def close(self) -> None:
        pass

    def _read(self) -> dict:
        found = self.head.get()
        return pickle.loads(found[0]) if found else {"next": 0, "open": [], "timer": None, "pages": 1, "n": 0, "oldest": {}}

    def _set_timer(self, head: dict, at: int) -> None:
        if head["timer"] is not None:
            self.handle.deleteTimer(head["timer"])
        self.handle.registerTimer(at)
        head["timer"] = at

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r[1], *r[3:]) for r in rows if r[1] is not None and r[3] is not None and r[5] is not None]  # others have no place in the order
        if not new:
            return iter(())
        new.sort(key=lambda r: r[3])
        head, waiting = self._read(), Packed(self.waiting)
        for k in range(0, len(new), WAITING):
            waiting.put(head["next"], new[k:k + WAITING])
            head["open"].append([head["next"], new[k][3]])
            head["next"] += 1
        waiting.write()
        at = -(-new[0][3] // 1000)
        if head["timer"] is None or at < head["timer"]:
            self._set_timer(head, at)
        self.head.update((_packed(head),))
        return iter(())

    def _due(self, head: dict, passed: int) -> list[tuple]:
        """The waiting rows that the watermark has passed, by entity and in order, each event once."""
        waiting, due, still = Packed(self.waiting), [], []
        for entry, first in head["open"]:
            if first > passed * 1000:
                still.append([entry, first])
                continue
            rows = waiting.get(entry)
            due += [r for r in rows if r[3] <= passed * 1000]
            rest = [r for r in rows if r[3] > passed * 1000]
            waiting.put(entry, rest or None)
            if rest:
                still.append([entry, rest[0][3]])
        waiting.write()
        head["open"] = still
        due.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2]))
        return [r for k, r in enumerate(due) if not k or r[2] is None or r[:3] != due[k - 1][:3]]

    def _forgotten(self, head: dict, pages: Entries, passed: int) -> None:
        for page in [p for p, last in head["oldest"].items() if self._ends(last) <= passed]:
            records = pages.get(page)
            for entity in [e for e, r in records.items() if self._ends(r["last"]) <= passed]:
                self.forget(entity, records.pop(entity))
                head["n"] -= 1
            pages.put(page, records or None)

    def _ends(self, last: int) -> int:
        return last // 1000 + int(self.keep * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        head, pages, passed = self._read(), Packed(self.entities), timerValues.getCurrentWatermarkInMs()
        due, done = self._due(head, passed), []
        self.begin()
        for entity, rows in groupby(due, key=lambda r: r[0]):
            rows, page = list(rows), _page(entity, head["pages"])
            records = pages.get(page) or {}
            if entity not in records:
                head["n"] += 1
            record = records.setdefault(entity, {})
            done.append(self.take(entity, record, rows))
            record["last"] = rows[-1][3]
            pages.put(page, records)
        self._forgotten(head, pages, passed)
        if head["n"] > PAGE * head["pages"]:
            _more_pages(head, pages)
        self.end()
        for page in pages.changed:
            head["oldest"].pop(page, None)
            if pages.known[page]:
                head["oldest"][page] = min(r["last"] for r in pages.known[page].values())
        pages.write()
        head["timer"] = None
        times = [-(-first // 1000) for _, first in head["open"]] + [self._ends(last) for last in head["oldest"].values()]
        if times:
            self._set_timer(head, min(times))
            self.head.update((_packed(head),))
        else:
            self.head.clear()
        out = Row("entity_id", "event_time_seconds", "transaction_id", "event_us", *self.given, *self.made)
        made = chain.from_iterable(done)
        for k in range(0, len(due), OUT_ROWS):
            yield out(*map(list, zip(*(row + more for row, more in zip(due[k:k + OUT_ROWS], made)))))  # a cell costs less in an array than in a row


def _page(entity, pages: int) -> int:
    return zlib.crc32(str(entity).encode()) % pages


def _more_pages(head: dict, pages: Entries) -> None:
    """Twice as many entries, until they hold ``PAGE`` entities on average; the entities of each go into two."""
    while head["n"] > PAGE * head["pages"]:
        n = head["pages"]
        head["pages"] = 2 * n
        for page in range(n):
            halves: tuple[dict, dict] = ({}, {})
            for entity, record in (pages.get(page) or {}).items():
                halves[_page(entity, 2 * n) >= n][entity] = record
            pages.put(page, halves[0] or None)
            pages.put(page + n, halves[1] or None)


class Features(Buckets):
    given, made = ("amount", "device_id", "merchant_id"), COMPUTED

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seconds = handle.getMapState("seconds", "entry string", "state binary")
        self.seen = handle.getMapState("merchants", "bucket string", "state binary")

    def begin(self) -> None:
        self.apart = Packed(self.seconds), Packed(self.seen)

    def take(self, entity, record: dict, rows: list[tuple]) -> list[tuple]:
        head, here, seen = record.setdefault("head", {}), record.setdefault("seconds", {}), record.setdefault("merchants", {0: {}})
        seconds = Seconds(head, Near(here, self.apart[0], entity, lambda k: k == head["newest"]),
                          LastSeen(head, Near(seen, self.apart[1], entity, lambda _: head["buckets"] <= NEAR)))
        made = Entity(head, seconds)
        out = [made.add(r[1], *r[4:]) for r in rows]
        seconds.write()
        return out

    def forget(self, entity, record: dict) -> None:
        head = record["head"]
        for k in range(head["at"][-2][0], head["newest"] + 1):
            if k not in record["seconds"]:
                self.apart[0].put(f"{k}|{entity}", None)
        for k in range(head["buckets"]):
            if k not in record["merchants"]:
                self.apart[1].put(f"{k}|{entity}", None)

    def end(self) -> None:
        for apart in self.apart:
            apart.write()


class OpenedWindows(InOrder):
    made = WINDOWED

    def __init__(self, width: float, limit: int):
        self.width, self.limit, self.keep = width, limit, width

    def take(self, head: dict, rows: list[list]) -> list[tuple]:
        start, count = head.get("window", (None, 0))
        made = []
        for t, *_ in rows:
            if start is None or t - start >= self.width:
                start, count = t, 0
            count += 1
            made.append((start, count, count > self.limit))
        head["window"] = [start, count]
        return made


def _in_order(events: DataFrame, processor: InOrder | Buckets, delay: str) -> DataFrame:
    names = ["event_time_seconds", "transaction_id", *processor.given]
    fields = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    kinds = {c: "double" if c in ("event_time_seconds", "amount") else fields[c] for c in names}
    bucket = [F.pmod(F.xxhash64("entity_id"), F.lit(BUCKETS)).cast("int").alias("bucket")] if isinstance(processor, Buckets) else []
    needed = events.select(*bucket, "entity_id", "event_ts", *[F.col(c).cast(kinds[c]).alias(c) for c in names[:2]], F.unix_micros("event_ts").alias("event_us"),
                           *[F.col(c).cast(kinds[c]).alias(c) for c in names[2:]])
    out = {"entity_id": fields["entity_id"], "event_time_seconds": kinds["event_time_seconds"], "transaction_id": kinds["transaction_id"], "event_us": "bigint",
           **{c: kinds[c] for c in processor.given}, **processor.made}
    made = needed.withWatermark("event_ts", delay).groupBy("bucket" if bucket else "entity_id").transformWithState(
        processor, ", ".join(f"{c} array<{k}>" if bucket else f"{c} {k}" for c, k in out.items()), "append", "eventTime")
    if bucket:
        made = made.select(F.inline(F.arrays_zip(*out)))
    return made.select("entity_id", "transaction_id", F.timestamp_micros("event_us").alias("event_ts"), *processor.given, *processor.made)


def live_features(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Features after each event, in event order, once the watermark has passed it.

    Needs entity_id, transaction_id (a number or a string), event_ts, event_time_seconds, amount, device_id, merchant_id. Event
    times and timestamps must agree in order. Rows later than ``delay`` behind the newest are dropped; rows without an entity or
    a time only move the watermark.
    """
    return _in_order(events, Features(), delay)


def opened_windows(events: DataFrame, width: float = 60, limit: int = 100, delay: str = "1 minute") -> DataFrame:
    """Events counted in windows that the first event of a key opens; ``over_limit`` beyond ``limit``. A key's window is forgotten
    once the watermark is ``width`` seconds past its last event."""
    return _in_order(events, OpenedWindows(width, limit), delay)
