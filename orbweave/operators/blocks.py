"""Rounds of a vertex program over blocks of a graph, as arrays.

For programs with a ``Kernel``, of runs without a scatter phase. Vertices are dealt to blocks by a hash of their ids. A
block holds the distinct edges that its vertices send along, with how many parallel ones there are, sorted by the
receiving block and vertex. Both ends of a message know its place: the order of the receivers is agreed on when the graph
is loaded, so a round ships a value for each pair of a block and a vertex that it reaches (messages are combined
before), and looks nothing up. No join, no broadcast: the driver gets a number of changes for each round.

Blocks lie in files below the session's shared folder, written once. A round is one shuffle of binary rows, and several
rounds are one job; values are written between jobs. A graph of a single block runs all its rounds in one task.

Memory: a task holds one block, about ``EDGES`` edges by the number of blocks, and what others send to it, at most a
value for each of its edges. Parallel edges are counted while they arrive, so that a vertex takes as much as it has
distinct neighbours.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.tables import Written, delete, folder, ship

#: Edges (in each direction in which messages go) for which there is a block.
EDGES = 1 << 21
#: Rounds of the first job, and of each later one.
FIRST, LATER = 4, 8
#: Edges packed in one row when the graph is loaded.
PACKED = 1 << 20

ROW = "part int, sender int, body binary, changes array<long>, tally array<long>"


def changes(old: np.ndarray, new: np.ndarray) -> int:
    return int((old != new).sum())


@dataclass(frozen=True)
class Kernel:
    """A program's round on arrays: ``combine`` is ``np.add``, ``np.minimum`` or ``np.maximum``, ``zero`` its neutral element.

    Sums count parallel edges. ``tally`` is what is counted in each round, of old and new values.
    """

    start: Callable[[np.ndarray], np.ndarray]
    send: Callable[[np.ndarray, np.ndarray], np.ndarray]
    combine: np.ufunc
    zero: float | int
    update: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    kind: str = "<i8"
    tally: Callable[[np.ndarray, np.ndarray], int] = changes


def block_of(ids: np.ndarray, n: int) -> np.ndarray:
    return ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n)).astype(np.int32)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _compact(s: np.ndarray, d: np.ndarray, out: np.ndarray, inn: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (s, d), with both numbers summed."""
    if not len(s):
        return s, d, out, inn
    order = np.lexsort((d, s))
    s, d = s[order], d[order]
    at = _firsts(s, d)
    return s[at], d[at], np.add.reduceat(out[order], at), np.add.reduceat(inn[order], at)


class Files:
    """Pickled objects in a folder that all executors share, on any file system that Arrow opens by its URI."""

    def __init__(self, path: str):
        self.uri = path if "://" in path or path.startswith("file:") else f"file://{path}"

    def put(self, name: str, what: dict) -> None:
        store, at = fs.FileSystem.from_uri(self.uri)
        store.create_dir(at)
        unfinished = f"{at}/.{name}-{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(unfinished) as f:
            f.write(pickle.dumps(what, protocol=5))
        store.move(unfinished, f"{at}/{name}")  # a task that runs again replaces its own file

    def get(self, name: str) -> dict:
        store, at = fs.FileSystem.from_uri(self.uri)
        with store.open_input_stream(f"{at}/{name}") as f:
            return pickle.loads(f.read())


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(schema)], schema=schema)


_ROW = pa.schema([("part", pa.int32()), ("sender", pa.int32()), ("body", pa.binary()), ("changes", pa.list_(pa.int64())), ("tally", pa.list_(pa.int64()))])
_WIRE = pa.schema([("part", pa.int32()), ("sender", pa.int32()), ("ids", pa.binary()), ("out", pa.binary()), ("inn", pa.binary())])


def _load(raw: DataFrame, files: Files, n: int, both: bool) -> Written:
    """(part) of each block that has vertices, whose files ``out-`` and ``in-`` are then there."""
    bound, chunk = 2 * EDGES, PACKED

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            src, dst = (np.concatenate([b.column(c).to_numpy() for b in held]).astype(np.int64) for c in (0, 1))
            loop = src == dst
            lone = np.unique(src[loop])
            src, dst = src[~loop], dst[~loop]
            s, d = [src, lone], [dst, lone]
            way = [np.zeros(len(src), np.uint8), np.full(len(lone), 2, np.uint8)]
            if both:
                s, d, way = [*s, dst], [*d, src], [*way, np.ones(len(src), np.uint8)]
            s, d, way = np.concatenate(s), np.concatenate(d), np.concatenate(way)
            part = block_of(s, n)
            order = np.argsort(part.astype(np.uint16) if n <= 65536 else part, kind="stable")
            s, d, way, part = s[order], d[order], way[order], part[order]
            at = [*_firsts(part).tolist(), len(s)]
            for a, b in zip(at, at[1:], strict=False):
                yield pa.RecordBatch.from_arrays([pa.array(part[a : a + 1]), pa.array([s[a:b].tobytes()]), pa.array([d[a:b].tobytes()]), pa.array([way[a:b].tobytes()])], names=["part", "s", "d", "way"])

        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= chunk:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        lone: dict[int, np.ndarray] = {}
        size: dict[int, int] = {}
        least: dict[int, int] = {}

        def compacted(part: int) -> tuple[np.ndarray, ...]:
            return _compact(*(np.concatenate(x) for x in zip(*held[part], strict=True)))

        for b in batches:
            for part, s, d, way in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s, d, way = np.frombuffer(s, np.int64), np.frombuffer(d, np.int64), np.frombuffer(way, np.uint8)
                edge = way < 2
                lone[part] = np.unique(np.concatenate([lone.get(part, s[:0]), s[~edge]]))
                held.setdefault(part, []).append((s[edge], d[edge], (way[edge] == 0).astype(np.int64), (way[edge] == 1).astype(np.int64)))
                size[part] = size.get(part, 0) + len(s)
                if size[part] > max(bound, least.get(part, 0)):
                    held[part] = [compacted(part)]
                    size[part] = len(held[part][0][0])
                    least[part] = 2 * size[part]
        for part in sorted(held):
            s, d, out, inn = compacted(part)
            del held[part]
            own = np.unique(np.concatenate([s, lone[part]]))
            to = block_of(d, n)
            order = np.lexsort((d, to))
            at = _firsts(d[order])
            who = np.searchsorted(own, s).astype(np.int32)
            target, to = d[order][at], to[order][at]
            many = (out + inn)[order]
            cut = _firsts(to) if len(to) else at
            cuts = [*cut.tolist(), len(to)]
            files.put(f"out-{part}", {"who": who[order], "many": None if (many == 1).all() else many, "at": at, "to": to[cut].tolist(), "cuts": cuts})
            came = np.add.reduceat(many, at) if len(at) else many
            rows = [(int(to[a]), part, target[a:b].tobytes(), None, came[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
            rows.append((part, -1, own.tobytes(), np.bincount(who, out, len(own)).astype(np.int64).tobytes(), np.bincount(who, inn, len(own)).astype(np.int64).tobytes()))
            yield _rows(rows, _WIRE)

    def wire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for part, sender, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(part, []).append((sender, *(None if x is None else np.frombuffer(x, np.int64) for x in rest)))
        for part in sorted(held):
            got = sorted(held.pop(part), key=lambda x: x[0])
            ids = np.unique(np.concatenate([g[1] for g in got]))
            out, inn = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            own, inbox = np.zeros(0, np.int32), {}
            for sender, x, sent, came in got:
                at = np.searchsorted(ids, x).astype(np.int32)
                if sender < 0:
                    own, out[at] = at, sent
                    if both:
                        inn[at] = came
                else:
                    inbox[sender] = at
                    if not both:
                        inn[at] += came
            files.put(f"in-{part}", {"ids": ids, "out": out, "inn": inn, "own": own, "inbox": inbox})
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    packed = raw.mapInArrow(pack, "part int, s binary, d binary, way binary").repartitionById(n, "part")
    wired = packed.mapInArrow(collect, "part int, sender int, ids binary, out binary, inn binary").repartitionById(n, "part")
    return Written(wired.mapInArrow(wire, "part int"), "blocks")


def _push(kernel: Kernel, out: dict | None, own: np.ndarray, values: np.ndarray, degree: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """What a block sends: (block, a value for each vertex that it reaches there)."""
    if out is None or not len(out["at"]):
        return
    m = kernel.send(values, degree)[own][out["who"]]
    if kernel.combine is np.add and out["many"] is not None:
        m = m * out["many"]
    m = kernel.combine.reduceat(m, out["at"])
    for to, a, b in zip(out["to"], out["cuts"], out["cuts"][1:], strict=False):
        yield to, m[a:b]


def _pull(kernel: Kernel, box: dict, values: np.ndarray, got: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """New values, of the messages (sender, values) in the order of senders, so that sums come out the same again."""
    total = np.full(len(values), kernel.zero, kernel.kind)
    for sender, m in sorted(got, key=lambda x: x[0]):
        at = box["inbox"][sender]
        total[at] = kernel.combine(total[at], m)
    return kernel.update(box["ids"], values, total).astype(kernel.kind)


def run(raw: DataFrame, kernel: Kernel, edges: int, both: bool, cap: int, value_type: str) -> tuple[Written, int, list[int]]:
    """(id, value, in_degree, out_degree) after ``cap`` rounds or the first job that ends with a round of no changes; rounds; tallies.

    ``raw`` (src, dst) has no nulls and ``edges`` rows; messages go from src to dst, and back too if ``both``.
    """
    spark = raw.sparkSession
    ship(spark)
    n = max(1, -(-edges * (2 if both else 1) // EDGES))
    path = folder(spark, "graph")
    files = Files(path)
    now = _load(raw, files, n, both)

    def sent(part: int, box: dict, values: np.ndarray, changed: list[int], tally: list[int]) -> pa.RecordBatch:
        own = box["own"]
        rows = [(to, part, m.astype(kernel.kind).tobytes(), None, None) for to, m in _push(kernel, files.get(f"out-{part}") if len(own) else None, own, values, box["out"])]
        return _rows([*rows, (part, -1, values.tobytes(), changed, tally)], _ROW)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                values = kernel.start(files.get(f"in-{part}")["ids"]).astype(kernel.kind)
                yield _rows([(part, -1, values.tobytes(), [], [])], _ROW)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, body in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                yield sent(part, files.get(f"in-{part}"), np.frombuffer(body, kernel.kind), [], [])

    def step(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            state: dict[int, tuple] = {}
            for b in batches:
                for part, sender, body, changed, tally in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    values = np.frombuffer(body, kernel.kind)
                    if sender < 0:
                        state[part] = values, changed, tally
                    else:
                        held.setdefault(part, []).append((sender, values))
            for part in sorted(state):
                values, changed, tally = state.pop(part)
                box = files.get(f"in-{part}")
                new = _pull(kernel, box, values, held.pop(part, []))
                changed, tally = [*changed, changes(values, new)], [*tally, kernel.tally(values, new)]
                yield _rows([(part, -1, new.tobytes(), changed, tally)], _ROW) if last else sent(part, box, new, changed, tally)

        return go

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                box, out = files.get(f"in-{part}"), files.get(f"out-{part}")
                values, changed, tally = kernel.start(box["ids"]).astype(kernel.kind), [], []
                while len(changed) < cap and (not changed or changed[-1]):
                    got = [(part, m) for _, m in _push(kernel, out, box["own"], values, box["out"])]
                    new = _pull(kernel, box, values, got)
                    changed.append(changes(values, new))
                    tally.append(kernel.tally(values, new))
                    values = new
                yield _rows([(part, -1, values.tobytes(), changed, tally)], _ROW)

    changed: list[int] = []
    tallies: list[int] = []
    while len(changed) < cap and (not changed or changed[-1]):
        rounds = min(LATER if changed else FIRST, cap - len(changed))
        if n == 1:
            new = now.df.mapInArrow(alone, ROW)
        else:
            new = (now.df if changed else now.df.mapInArrow(first, ROW)).mapInArrow(begin, ROW)
            for k in range(rounds):
                new = new.repartitionById(n, "part").mapInArrow(step(k == rounds - 1), ROW)
        written = Written(new, "values")
        now.drop()
        now = written
        counts = now.df.select(F.posexplode(F.arrays_zip("changes", "tally")).alias("at", "x")).groupBy("at").agg(F.sum("x.changes"), F.sum("x.tally")).orderBy("at").collect()
        changed += [r[1] for r in counts]
        tallies += [r[2] for r in counts]
        if not counts:
            break  # no vertices

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, body in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                box, values = files.get(f"in-{part}"), np.frombuffer(body, kernel.kind)
                for a in range(0, len(values), 65536):
                    cut = slice(a, a + 65536)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (box["ids"][cut], values[cut], box["inn"][cut], box["out"][cut])], names=["id", "value", "in_degree", "out_degree"])

    done = Written(now.df.mapInArrow(rows, f"id long, value {value_type}, in_degree long, out_degree long"), "vertices")
    now.drop()
    delete(spark, path)
    return done, len(changed), tallies
