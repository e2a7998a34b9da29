"""Chat formatting by columnar byte assembly.

A turn is written as ``<turn>role``, a line end, the text, ``</turn>`` and a line end. A batch of turns becomes one byte
buffer: segment lengths, cumulative offsets and scatter indices are computed for all turns at once, and headers, roles
and texts are copied into one preallocated Arrow buffer. Control strings in roles and texts are escaped with a
backslash, reversibly. The loss mask covers the texts of assistant turns.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

OPEN, CLOSE = "<turn>", "</turn>"
_ESCAPES = {"\\": "\\\\", OPEN: "\\o", CLOSE: "\\c"}
_BACK = {"\\": "\\", "o": OPEN, "c": CLOSE, "n": "\n"}
_CONTROL = re.compile("|".join(map(re.escape, _ESCAPES)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_CONSTANTS = np.frombuffer(f"{OPEN}\n{CLOSE}\n".encode(), np.uint8)
PARTS = "conv_id long, part int, open boolean, n_turns int, formatted binary, loss_start array<long>, loss_end array<long>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text) if "\\" in text else text


def _escaped(column: pa.Array, header: bool = False) -> pa.Array:
    """A string column with its control strings escaped; rows without any aren't touched."""
    column = column.fill_null("")
    data = utf8(column)[0].tobytes()
    if not any(x.encode() in data for x in (*_ESCAPES, *"\n" * header)):
        return column
    fix = (lambda t: escape(t).replace("\n", "\\n")) if header else escape
    return pa.array([fix(t) for t in column.to_pylist()], pa.string())


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns, the n + 1 offsets of the turns, and where each turn's text starts and ends."""
    n = len(roles)
    (role, role_at), (text, text_at) = utf8(_escaped(roles, header=True)), utf8(_escaped(texts))
    source = np.concatenate([_CONSTANTS, role, text])
    base = len(_CONSTANTS)
    head, close = len(OPEN), len(CLOSE) + 1
    lengths, start = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    lengths[:, 0], start[:, 0] = head, 0
    lengths[:, 1], start[:, 1] = np.diff(role_at), base + role_at[:-1]
    lengths[:, 2], start[:, 2] = 1, head
    lengths[:, 3], start[:, 3] = np.diff(text_at), base + len(role) + text_at[:-1]
    lengths[:, 4], start[:, 4] = close, head + 1
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    index = np.arange(ends[-1, -1] if n else 0) + np.repeat((start - (ends - lengths)).ravel(), lengths.ravel())
    out = np.empty(len(index), np.uint8)
    np.take(source, index, out=out)
    return out, np.concatenate([[0], ends[:, 4]]) if n else np.zeros(1, np.int64), ends[:, 2], ends[:, 3]


def format_conversations(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Formatted parts of conversations (conv_id, turn, role, text; more columns are ignored).

    Turns are ordered by turn, then role, then text, nulls first; a null role or text is empty, and rows with a null
    conv_id make one conversation. A conversation comes in one part or, if it goes over several Arrow batches, in
    consecutive parts of whole turns: no task holds more than a batch of it. loss_start and loss_end are byte offsets in
    the part; ``open`` says that the conversation may go on in another part. An empty table gives no parts.
    """
    keyed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = keyed.repartition(partitions, "conv_id") if partitions else keyed.repartition("conv_id")

    def run(it):
        last, part = object(), 0
        for batch in slices(it):
            if not batch.num_rows:
                continue
            data, at, text_from, text_to = assemble(batch.column(1), batch.column(2))
            ids = batch.column(0).to_pylist()
            first = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]]
            loss = np.array([r == "assistant" for r in batch.column(1).to_pylist()])
            numbers, starts, stops = [], [], []
            for a, b in zip(first, [*first[1:], len(ids)]):
                part = part + 1 if ids[a] == last else 0
                last = ids[a]
                numbers.append(part)
                on = np.flatnonzero(loss[a:b]) + a
                starts.append(text_from[on] - at[a])
                stops.append(text_to[on] - at[a])
            cuts = [*first, len(ids)]
            whole = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.ascontiguousarray(at[cuts]).astype(np.int64)), pa.py_buffer(data)])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[k] for k in first], pa.int64()), pa.array(numbers, pa.int32()), pa.array(np.arange(len(first)) == len(first) - 1), pa.array(np.diff(cuts), pa.int32()), whole.cast(pa.binary()), pa.array(starts, lists), pa.array(stops, lists)],
                names=["conv_id", "part", "open", "n_turns", "formatted", "loss_start", "loss_end"],
            )

    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, PARTS)


def turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of the turns of a formatted part."""
    out = []
    for piece in formatted.split(f"{CLOSE}\n")[:-1]:
        role, _, text = piece.removeprefix(OPEN).partition("\n")
        out.append((unescape(role), unescape(text)))
    return out


def read_back(parts: DataFrame) -> DataFrame:
    """The digests of op10 from formatted parts, in whatever order they come.

    A conversation in one part is read where it is; those that may have several are dealt by conversation and put in
    order first, and a task reads a part at a time.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(it):
        now, state = object(), None

        def row():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def table(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for batch in slices(it):
            done = []
            for conv, data, starts, stops in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if state is None or conv != now:
                    if state is not None:
                        done.append(row())
                    now, state = conv, [0, sha256(), 0, sha256(), 0]
                text = data.decode()
                for role, said in turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts, stops):
                    said = unescape(data[a:b].decode())
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield table(done)
        if state is not None:
            yield table([row()])

    out, columns = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", ["conv_id", "formatted", "loss_start", "loss_end"]
    whole = (F.col("part") == 0) & ~F.col("open")
    several = parts.where(~whole).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.where(whole).select(columns).mapInArrow(run, out).unionByName(several.select(columns).mapInArrow(run, out))
