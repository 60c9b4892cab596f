"""Rules kept as a table, matched without compiling them into the plan.

A rule is a conjunction of comparisons of a field with a constant: per field one interval and the values it leaves out. The distinct
constants of a field cut the number line into points and open intervals; rows that fall into the same ones in every field meet the
same rules, so they are matched once. These classes of rows are sorted by each field, where a rule's interval is a run of classes,
found by binary search. A rule starts from its shortest run and looks at the classes in it; so the work is that of the rules (a few
searches per some 100,000 rows) and of the hits, not of rows times rules. Rows are matched where they are: there is no shuffle and no
join. The rule table is written once, in the order of the ids, to the shared folder; tasks read it piece by piece, so that it passes
neither through the driver nor, beyond ``KEPT_PIECES``, whole through a task's memory.

Meaning, as in :func:`riskloom.operators.decisions.predicate`: a null or missing field counts as 0; a rule without conditions, with an
unknown comparison or without a constant never matches; NaN is equal to itself and above all numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.decisions import COMPARE
from riskloom.session import shared_dir

#: Rules of a piece, and the pieces that a Python worker keeps.
PIECE_RULES, KEPT_PIECES = 1 << 18, 16
#: Rows and bytes matched at once.
STEP_ROWS, STEP_BYTES = 100_000, 1 << 25
#: (class, rule) pairs looked at in one go and held for some rows; rows of more are halved down to single ones.
PAIRS, HELD_PAIRS = 1 << 20, 1 << 23
#: Hits of an output batch, unless a single row has more.
OUT_HITS = 1 << 18

NAMES = ("id", "name", "action")


def write_rules(rules: DataFrame) -> str:
    """Writes (id, name, action, conditions of field, op, value) in the order of the ids to the shared folder; returns the folder."""
    spark = rules.sparkSession
    path = f"{shared_dir(spark)}/rules-{uuid.uuid4().hex}"
    plain = rules.select(*[F.col(c).cast("string").alias(c) for c in NAMES], F.transform("conditions", lambda c: F.struct(
        c["field"].cast("string").alias("field"), c["op"].cast("string").alias("op"), c["value"].cast("double").alias("value"))).alias("conditions"))
    order = [F.col(c).asc_nulls_last() for c in ("id", "name")]
    pieces = max(1, -(-rules.count() // PIECE_RULES))
    plain.repartitionByRange(pieces, *order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", PIECE_RULES).parquet(path)
    return path


class Bounds:
    """What the rules of a piece ask of one field: for some rules a lowest and a highest value, and values left out."""

    def __init__(self, rule: np.ndarray, op: np.ndarray, value: np.ndarray):
        is_in = lambda *ops: np.isin(op, [list(COMPARE).index(o) for o in ops])
        self.cuts = np.unique(value)
        low, high, out = is_in(">", ">=", "=="), is_in("<", "<=", "=="), is_in("!=")
        above, below = is_in(">"), is_in("<")
        order = np.lexsort((above[low], value[low], rule[low]))
        self.low = self._one(rule[low][order], value[low][order], above[low][order], last=True)
        order = np.lexsort((~below[high], value[high], rule[high]))
        self.high = self._one(rule[high][order], value[high][order], below[high][order], last=False)
        self.bounded = bool(low.any() or high.any())
        order = np.argsort(rule[out], kind="stable")
        r, v = rule[out][order], value[out][order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        self.without = [(r[nth == k], v[nth == k]) for k in range(nth.max() + 1)] if len(r) else []

    @staticmethod
    def _one(rule: np.ndarray, value: np.ndarray, strict: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The strictest bound of each rule; the arrays are sorted by rule and then by value."""
        new = rule[1:] != rule[:-1]
        keep = np.append(new, True) if last else np.insert(new, 0, True)
        keep = keep[:len(rule)]
        return rule[keep], value[keep], strict[keep]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Which point or open interval between the constants each value is in."""
        at = np.searchsorted(self.cuts, x)
        near = self.cuts[np.minimum(at, len(self.cuts) - 1)]
        return 2 * at + ((at < len(self.cuts)) & ((near == x) | (np.isnan(near) & np.isnan(x))))

    def runs(self, x: np.ndarray, rules: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end of each rule's run in sorted values."""
        start, end = np.zeros(rules, np.int32), np.full(rules, len(x), np.int32)
        rule, value, strict = self.low
        start[rule] = np.where(strict, np.searchsorted(x, value, "right"), np.searchsorted(x, value, "left"))
        rule, value, strict = self.high
        end[rule] = np.where(strict, np.searchsorted(x, value, "left"), np.searchsorted(x, value, "right"))
        return start, end


class Piece:
    """Some rules, by the fields they compare."""

    def __init__(self, rules: pa.Table):
        conditions = rules["conditions"].combine_chunks()
        self.size = len(conditions)
        self.escalates = {}
        self.actions = rules["action"].combine_chunks()
        rule = pc.list_parent_indices(conditions).to_numpy(zero_copy_only=False).astype(np.int64)
        field, op, value = conditions.flatten().flatten()
        op = pc.index_in(op, value_set=pa.array(list(COMPARE)))
        known = pc.and_(pc.and_(op.is_valid(), field.is_valid()), value.is_valid()).to_numpy(zero_copy_only=False)
        self.live = np.bincount(rule, minlength=self.size) > 0
        self.live[rule[~known]] = False
        use = self.live[rule]
        rule, kept = rule[use], pa.array(np.flatnonzero(use))
        op, value = op.take(kept).to_numpy(zero_copy_only=False), value.take(kept).to_numpy(zero_copy_only=False)
        field = field.take(kept).dictionary_encode()
        code = field.indices.to_numpy(zero_copy_only=False)
        self.fields = {name: Bounds(rule[code == k], op[code == k], value[code == k]) for k, name in enumerate(field.dictionary.to_pylist())}

    def acts(self, action: str) -> np.ndarray:
        """Whether each rule has this action."""
        if action not in self.escalates:
            self.escalates[action] = pc.fill_null(pc.equal(self.actions, action), False).to_numpy(zero_copy_only=False)
        return self.escalates[action]

    def classes(self, values: dict[str, np.ndarray], rows: int) -> np.ndarray:
        """Rows of the same class meet the same rules; classes are numbered from 0, in the order of their fields' values."""
        of = np.zeros(rows, np.int64)
        for field, bounds in self.fields.items():
            cell = bounds.cells(values.get(field, np.zeros(rows)))
            of = np.unique(of * (2 * len(bounds.cuts) + 1) + cell, return_inverse=True)[1].reshape(-1)
        return of

    def matches(self, values: dict[str, np.ndarray], rows: int, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Class of each row, first hit of each class (and the end of the last), and the rules of the hits in order; None if
        they may be more than ``most``."""
        of = self.classes(values, rows)
        first = np.unique(of, return_index=True)[1]
        k, fields = len(first), list(self.fields.values())
        order, place, starts, ends = [], [], [], []
        fewest, best = np.where(self.live, k + 1, 0), np.zeros(self.size, np.int16)
        for i, (field, bounds) in enumerate(self.fields.items()):
            x = values[field][first] if field in values else np.zeros(k)
            order.append(np.argsort(x, kind="stable"))
            place.append(np.empty(k, np.int32))
            place[i][order[i]] = np.arange(k, dtype=np.int32)
            start, end = bounds.runs(x[order[i]], self.size)
            starts.append(start)
            ends.append(end)
            n = np.maximum(end - start, 0)
            fewer = n < fewest
            fewest[fewer], best[fewer] = n[fewer], i
        if most is not None and fewest.sum() > most:
            return None
        found = [np.zeros(0, np.int64)]
        for i in range(len(fields)):
            mine = np.flatnonzero((best == i) & (fewest > 0))
            ends_at = np.cumsum(fewest[mine])
            a = 0
            while a < len(mine):
                b = max(a + 1, int(np.searchsorted(ends_at, (ends_at[a - 1] if a else 0) + PAIRS, "right")))
                some, a = mine[a:b], b
                rule, at = np.repeat(some, fewest[some]), _ranges(starts[i][some], fewest[some])
                row = order[i][at]
                for j, bounds in enumerate(fields):
                    if j != i and bounds.bounded:
                        at = place[j][row]
                        ok = (at >= starts[j][rule]) & (at < ends[j][rule])
                        row, rule = row[ok], rule[ok]
                    for named, value in bounds.without if len(row) else ():
                        x = values.get(list(self.fields)[j], np.zeros(rows))[first]
                        left = np.minimum(np.searchsorted(named, rule), len(named) - 1)
                        x, out = x[row], value[left]
                        ok = (named[left] != rule) | ((x != out) & ~(np.isnan(x) & np.isnan(out)))
                        row, rule = row[ok], rule[ok]
                found.append(row * self.size + rule)
        pairs = np.concatenate(found)
        pairs.sort()
        return of, np.searchsorted(pairs, np.arange(k + 1) * self.size), (pairs % max(self.size, 1)).astype(np.int32)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each count, one after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def _read(name: str, columns: list[str]) -> pa.Table:
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(name)
    with system.open_input_file(path) as stream:
        return pq.read_table(stream, columns=columns)


@lru_cache(maxsize=KEPT_PIECES)
def _piece(name: str) -> Piece:
    return Piece(_read(name, ["action", "conditions"]))


@lru_cache(maxsize=4)
def _pieces(folder: str) -> list[tuple[str, int]]:
    """(file, number of its first rule) of all pieces in the order of the rules, then the number of rules."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    found, rules = [], 0
    for info in sorted(system.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda i: i.path):
        if info.is_file and info.base_name.endswith(".parquet"):
            prefix = folder.split("://", 1)[0] + "://" if "://" in folder else ""
            name = info.path if not prefix or prefix == "file://" else prefix + info.path
            with system.open_input_file(info.path) as stream:
                n = pq.ParquetFile(stream).metadata.num_rows
            found, rules = [*found, (name, rules)], rules + n
    return [*found, ("", rules)]


@lru_cache(maxsize=6)
def _all_of(folder: str, column: str) -> pa.Array:
    parts = [_read(name, [column])[column].combine_chunks() for name, _ in _pieces(folder)[:-1]]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _named(folder: str, rules: np.ndarray, column: str) -> pa.Array:
    """A column of the rules with these numbers; whole columns are kept of tables of as many pieces as a worker keeps."""
    pieces = _pieces(folder)
    if len(pieces) - 1 <= KEPT_PIECES:
        return _all_of(folder, column).take(pa.array(rules))
    used, at = np.unique(rules, return_inverse=True)
    cuts = np.searchsorted(used, [first for _, first in pieces])
    parts = [_read(name, [column])[column].combine_chunks().take(pa.array(used[a:b] - first)) for (name, first), a, b in zip(pieces, cuts, cuts[1:]) if b > a]
    return pa.concat_arrays(parts).take(pa.array(at)) if parts else pa.array([], pa.string())


def _uri(folder: str) -> str:
    """Spark also writes file:/x, which other readers do not know."""
    scheme, _, rest = folder.partition(":")
    return "file:///" + rest.lstrip("/") if scheme == "file" else folder


def _numbers(df: DataFrame, keep: list[str], folder: str) -> tuple[DataFrame, dict[str, str]]:
    """``keep`` and the columns that the rules compare, as doubles under names of their own."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.StringType))]
    fields = df.sparkSession.read.parquet(folder).select(F.explode("conditions.field").alias("field"))
    compared = {r.field for r in fields.where(F.col("field").isin(numeric)).distinct().collect()}  # columns of ``df`` only
    names = {c: f"_rule_field_{i}" for i, c in enumerate(numeric) if c in compared}
    as_double = [F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)).alias(n) for c, n in names.items()]
    return df.select(*[F.col(f"`{c}`") for c in keep], *as_double), names


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Record batches put together to some STEP_ROWS rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for part in (batch.slice(i, STEP_ROWS) for i in range(0, batch.num_rows, STEP_ROWS)):
            held.append(part)
            if sum(b.num_rows for b in held) >= STEP_ROWS or sum(b.nbytes for b in held) >= STEP_BYTES:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _matched(table: pa.Table, names: dict[str, str], folder: str, action: str | None) -> Iterator[tuple]:
    """(rows as positions in the table, hits of each, numbers of the rules row by row, whether a rule of the action hit each) for some rows at a time."""
    values = {c: table[n].to_numpy() for c, n in names.items()}
    pieces = _pieces(folder)[:-1]
    rows = np.arange(table.num_rows)
    if pieces:
        rows = np.argsort(_piece(pieces[0][0]).classes(values, len(rows)), kind="stable")
    todo = [rows]
    while todo:
        rows = todo.pop()
        here, found, held = {c: x[rows] for c, x in values.items()}, [], 0
        for name, first in pieces:
            one = _piece(name).matches(here, len(rows), None if len(rows) == 1 else HELD_PAIRS - held)
            if one is None:
                break
            held += len(one[2])
            found.append((*one, name, first))
        if len(found) < len(pieces):
            todo += [rows[len(rows) // 2:], rows[:len(rows) // 2]]
            continue
        counts, starts = np.zeros((len(rows), len(pieces)), np.int64), np.zeros((len(rows), len(pieces)), np.int64)
        rules, acted, before = [np.zeros(0, np.int64)], np.zeros(len(rows), bool), 0
        for k, (of, at, hit, name, first) in enumerate(found):
            counts[:, k], starts[:, k] = (at[1:] - at[:-1])[of], before + at[:-1][of]
            rules.append(first + hit.astype(np.int64))
            before += len(hit)
            if action is not None:
                seen = np.append(0, np.cumsum(_piece(name).acts(action)[hit]))
                acted |= (seen[at[1:]] > seen[at[:-1]])[of]
        rules, per_row = np.concatenate(rules), counts.sum(axis=1)
        ends, a = np.cumsum(per_row), 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + OUT_HITS, "right")))
            yield rows[a:b], per_row[a:b], rules[_ranges(starts[a:b].reshape(-1), counts[a:b].reshape(-1))], acted[a:b]
            a = b


def _in_steps(names: dict[str, str], folder: str, make: Callable[..., list[pa.Array]], fields: list[str], action: str | None = None):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _steps(batches):
            table = table.combine_chunks()
            for found in _matched(table, names, folder, action):
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in make(table, *found)], names=fields)
    return match


def hits(df: DataFrame, rules: DataFrame, keep: list[str]) -> DataFrame:
    """One row per (row, matching rule): ``keep``, rule_id, rule_name, rule_action."""
    written = write_rules(rules)
    folder = _uri(written)
    plain, names = _numbers(df, keep, written)
    schema = T.StructType([*[plain.schema[c] for c in keep], *[T.StructField(f"rule_{c}", T.StringType()) for c in NAMES]])

    def make(table, rows, counts, numbers, _):
        chosen = table.select(keep).take(pa.array(np.repeat(rows, counts)))
        return [*chosen.columns, *[_named(folder, numbers, c) for c in NAMES]]

    return plain.mapInArrow(_in_steps(names, folder, make, schema.names), schema)


def triggered(df: DataFrame, rules: DataFrame, column: str = "_rules", fields: tuple[str, ...] = NAMES, acted: tuple[str, str] | None = None) -> DataFrame:
    """``df`` with ``column``, the array of (id, name, action) of the matching rules in the order of their ids (as text).

    ``fields`` are those of them that are read; a single one gives an array of texts. ``acted`` is (action, column) of a flag
    whether a matching rule has that action.
    """
    written = write_rules(rules)
    folder = _uri(written)
    kept = df.columns
    plain, names = _numbers(df, kept, written)
    hit = "string" if len(fields) == 1 else f"struct<{', '.join(f'{c}:string' for c in fields)}>"
    schema = T.StructType([*df.schema.fields, T.StructField(column, T._parse_datatype_string(f"array<{hit}>")),
                           *([T.StructField(acted[1], T.BooleanType())] if acted else [])])

    def make(table, rows, counts, numbers, flags):
        ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
        flat = [_named(folder, numbers, c) for c in fields]
        lists = pa.ListArray.from_arrays(ends, flat[0] if len(flat) == 1 else pa.StructArray.from_arrays(flat, names=list(fields)))
        return [*table.select(kept).take(pa.array(rows)).columns, lists, *([pa.array(flags)] if acted else [])]

    return plain.mapInArrow(_in_steps(names, folder, make, schema.names, acted[0] if acted else None), schema)
