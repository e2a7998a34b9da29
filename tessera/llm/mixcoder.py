"""Token ids in files, by an adaptive context-mixing arithmetic coder.

Ids go in blocks of BLOCK, each coded from a fresh state and with its own checksum. For each id, the order-2 and order-1
contexts predict one id each (the last that was often seen after them); that of order 2 is asked, or of order 1 if order
2 has none. Whether it holds is one coded bit. Its probability mixes, in the logistic domain, how sure both contexts are:
each says a value that adapts after every id by the error of the mixture. If the prediction fails, order-0 counts code
the id: ids of the block so far have symbols of their own, new ids a symbol for their range and the place in it; the
counts are brought up to date at UPDATES. All arithmetic is in integers, so that every machine decodes alike.

The coder is a range ANS with a 64-bit state and 32-bit words. It takes an id's bit, symbol and place as one step, whose
words are written last id first, so the encoder models a whole block before it writes.

A block is sequential, but blocks are independent: up to LANES of them are coded in step, as numpy arrays over blocks.
What needs no order (symbols of ids, frequencies, limits) is done for many steps at once.

A segment (the unit of a file) holds whole documents: header, document ids and lengths, block table (ids, bytes, crc32
of the ids as little-endian 32-bit integers), payloads.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import slices, stored

BLOCK, LANES = 4096, 2048
MAX_ID = (1 << 16) - 1
END_ID = 2
SEGMENT_IDS = BLOCK * LANES
MAGIC = b"TCMY"
_HEADER = struct.Struct("<4sIIQI")  # magic, documents, documents with a null id, ids, blocks

#: Ids of a block after which its order-0 counts are brought up to date.
UPDATES = (0, 16, 64, 192, 512, 1024, 1792, 2816)
#: Bits of the probability of a prediction, of a symbol's frequency and of a place in a range. Their sum is at most 32,
#: so one word a step is enough.
_BIT, _FREQ, _PLACE = 11, 12, 9
#: Most ids with a symbol of their own.
_OWN = 640
_OFTEN = -(-BLOCK // _OWN) + 1
#: Rows of a lane's predictions, and predictions in a row: one of order 1, the others of order 2.
_ROW_BITS, _ROW = 9, 4
_ROWS = 1 << _ROW_BITS
#: How fast the mixed values adapt.
_RATE = 8


def _squash_table() -> np.ndarray:
    """65536 / (1 + exp(-x / 256)) for x from -2048 to 2047, in whole numbers of 48 fractional bits."""
    one, step, term = 1 << 48, 0, 1 << 48
    for k in range(1, 12):  # exp(-1 / 256) by its series
        step += term if k % 2 else -term
        term //= 256 * k
    power, right = one, []
    for _ in range(2049):
        right.append(65536 * one // (one + power))
        power = power * step >> 48
    left = [65536 - p for p in right[:0:-1]]
    return np.array([*left, *right[:2048]], np.int64)


_SQUASH = np.clip(_squash_table() >> 16 - _BIT, 1, (1 << _BIT) - 1).astype(np.int32)
#: The first id of each range, and the bits of a place in it: short ranges for the frequent, small ids.
_FIRST = np.concatenate([np.arange(0, 512, 8), np.arange(512, 2048, 64), np.arange(2048, MAX_ID, 1 << _PLACE)])
_BITS = np.log2(np.diff(_FIRST, append=MAX_ID + 1)).astype(np.int64)
_RANGES = len(_FIRST)
_RANGE = np.repeat(np.arange(_RANGES), 1 << _BITS).astype(np.int16)
_PRIOR = 1 + (4000 << _BITS) // (200 + _FIRST) // 16
#: Of each id: bits of a place in its range (from bit 12) and its place there.
_PLACES = (_BITS[_RANGE] << 12 | np.arange(MAX_ID + 1) - _FIRST[_RANGE]).astype(np.uint16)
#: Lanes whose ids are looked up at once, and a mark of symbols that stand for one id.
_GROUP, _IS_OWN = 32, 1 << 26
_U = np.uint64
_ONE, _LOW, _WORD, _HASH = _U(1), _U((1 << 32) - 1), _U(32), _U(0x9E3779B97F4A7C15)
_TO_PLACE, _TO_ROW, _ROW_SIZE, _SURE = _U(62), _U(64 - _ROW_BITS), _U(_ROW), np.int32(1 << _BIT)


class _Model:
    """The model of all lanes. One class serves both directions, so that their models can't differ."""

    def __init__(self, n: int) -> None:
        # id and, in four bits, how sure; rows by the last id: its own prediction, then those by the id before it
        self.table = np.zeros(n * _ROWS * _ROW, np.int32)
        self.row_at = np.arange(n, dtype=np.uint64) * _U(_ROWS * _ROW)
        sure = np.arange(16)
        self.value = np.tile(np.concatenate([sure * 40 - 600, sure * 40 - 400 + 2048]).astype(np.int32) << 8, n)
        self.value_at = (np.arange(n) * 32 + np.array([[0], [16]])).astype(np.int32)
        self.before = np.ones(n, np.uint64)
        self.narrow(n)

    def narrow(self, n: int) -> None:
        """Go on with the first n lanes."""
        self.n = n
        self.row_at, self.value_at, self.before = self.row_at[:n], self.value_at[:, :n], self.before[:n]
        self.rows, self.after = np.empty((2, n), np.uint64), np.empty(n, np.uint64)
        self.at, self.value_of = self.rows.view(np.int64), np.empty((2, n), np.int64)
        self.old, self.sure, self.new, self.more, self.had = (np.empty((2, n), np.int32) for _ in range(5))
        self.error, self.guess = np.empty(n, np.int32), np.empty(n, np.int32)

    def count_up(self, rows: np.ndarray, now: int) -> None:
        """Order-0 statistics of rows[lane, :now]: the ids with symbols of their own, and of each symbol and lane its slots
        (share) and the end of them (upto)."""
        n = self.n
        past = np.sort(rows[:n, :now], 1)
        first = np.ones(past.shape, bool)
        np.not_equal(past[:, 1:], past[:, :-1], out=first[:, 1:])
        begin = np.flatnonzero(first)
        own, times, of = past.reshape(-1)[begin].astype(np.int64), np.diff(begin, append=past.size), begin // max(now, 1)
        ranges = np.bincount(_RANGE[own] * np.int64(n) + of, minlength=n * _RANGES).reshape(_RANGES, n)
        distinct = np.bincount(of, minlength=n)
        if distinct.max(initial=0) > _OWN:  # those seen often enough; a block has no room for _OWN ids _OFTEN times each
            often = np.bincount(of * _OFTEN + np.minimum(times, _OFTEN) - 1, minlength=n * _OFTEN).reshape(n, _OFTEN)
            least = 1 + (np.cumsum(often[:, ::-1], 1) > _OWN).sum(1)
            keep = times >= least[of]
            own, times, of = own[keep], times[keep], of[keep]
            distinct = np.bincount(of, minlength=n)
        self.own, self.of = own, of
        self.symbol = _RANGES + np.arange(len(of)) - (np.cumsum(distinct) - distinct)[of]
        width, used = _RANGES + int(distinct.max(initial=0)), (_RANGES + distinct).astype(np.int32)
        upto = np.zeros((width, n), np.int32)
        upto[:_RANGES] = ranges * 16 + _PRIOR[:, None]
        upto[self.symbol, of] = 32 * times - 16
        for k in range(1, width):
            upto[k] += upto[k - 1]
        # scaled to the slots, one of which each used symbol has; the last used one takes what rounding leaves
        upto *= ((1 << _FREQ) - used << 16) // upto[-1]
        upto >>= 16
        order = np.arange(1, width + 1, dtype=np.int32)[:, None]
        upto += np.minimum(order, used)
        np.copyto(upto, 1 << _FREQ, where=order >= used)
        self.upto, self.share = upto, np.diff(upto, axis=0, prepend=np.int32(0))

    def predict(self, last: np.ndarray) -> np.ndarray:
        """The probability that the predicted id (``guess``, times 16) holds, as a share of 2 ** _BIT."""
        two, one = self.rows
        np.multiply(last, _HASH, out=one)
        after = self.after
        np.right_shift(one, _TO_PLACE, out=after)
        one >>= _TO_ROW
        one *= _ROW_SIZE
        one += self.row_at
        np.maximum(after, _ONE, out=after)  # a place in the next step's row
        np.add(one, self.before, out=two)
        self.before, self.after = after, self.before
        old, sure, guess, of, had = self.old, self.sure, self.guess, self.value_of, self.had
        self.table.take(self.at, mode="clip", out=old)
        np.bitwise_and(old, 15, out=sure)
        np.copyto(guess, old[1])
        np.copyto(guess, old[0], where=sure[0] > 0)
        guess &= -16
        of[:] = self.value_at + sure
        self.value.take(of, mode="clip", out=had)
        mixed = had[0] + had[1]
        mixed >>= 8
        self.chance = _SQUASH.take(mixed, mode="clip")
        return self.chance

    def learn(self, ident: np.ndarray, held: np.ndarray) -> None:
        """Adapt the mixed values and the contexts' predictions to an id (times 16)."""
        error, old, new, more = self.error, self.old, self.new, self.more
        np.multiply(held, _SURE, out=error)
        error -= self.chance
        error *= _RATE
        self.had += error
        self.value[self.value_of.reshape(-1)] = self.had.reshape(-1)
        np.subtract(old, 2, out=new)
        np.copyto(new, ident | 1, where=self.sure < 2)
        np.bitwise_or(old, 15, out=more)
        same = more == (ident | 15)
        old += 1
        np.minimum(more, old, out=more)
        np.copyto(new, more, where=same)
        self.table[self.at.reshape(-1)] = new.reshape(-1)


def _stretches(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """Steps from, to and lanes between updates and ends of lanes; lengths descend."""
    ends = {int(x) for x in lengths}
    most = max(ends, default=0)
    cuts = sorted({t for t in (*UPDATES, *ends) if t <= most})
    return [(a, b, int(np.searchsorted(-lengths, -a, "left"))) for a, b in zip(cuts, cuts[1:])]


def _encode(rows: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Payloads of the lanes of rows[lane, step]; lengths descend."""
    n, steps = rows.shape
    model, ids = _Model(n), np.ascontiguousarray(rows.T)
    chance, held, coded = np.zeros((steps, n), np.uint16), np.zeros((steps, n), bool), np.zeros((steps, n), np.uint32)
    row_at, last = np.arange(_GROUP, dtype=np.int32)[:, None] << 16, np.zeros(n, np.uint64)
    for a, b, active in _stretches(lengths):
        if active < model.n:
            model.narrow(active)
            last = last[:active]
        if a in UPDATES:
            model.count_up(rows, a)
            facts = (model.share | model.upto - model.share << 13).astype(np.uint32)
            facts[_RANGES:] |= _IS_OWN
            facts, wide = facts.reshape(-1), active
            place_of = np.tile(_RANGE.astype(np.int32) * wide, _GROUP)  # of each id of a few lanes: its place in facts
        for k in range(0, active, _GROUP):
            more = min(k + _GROUP, active)
            x, y = np.searchsorted(model.of, [k, more])
            at = (model.of[x:y] - k << 16) + model.own[x:y]
            place_of[at] = model.symbol[x:y] * wide
            place = place_of.take(rows[k:more, a:b] + row_at[: more - k], mode="clip")
            place += np.arange(k, more, dtype=np.int32)[:, None]
            coded[a:b, k:more] = facts.take(place, mode="clip").T
            place_of[at] = _RANGE[model.own[x:y]] * np.int32(wide)
        ident = ids[a:b, :active].astype(np.int32) << 4
        for t in range(a, b):
            chance[t, :active] = model.predict(last)
            np.equal(model.guess, ident[t - a], out=held[t, :active])
            model.learn(ident[t - a], held[t, :active])
            last = ids[t, :active].astype(np.uint64)
    return _write(ids, chance, held, coded, lengths)


def _write(ids: np.ndarray, chance: np.ndarray, held: np.ndarray, coded: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Code the steps from the last to the first."""
    n = len(lengths)
    room = len(chance) + 2
    state, words = np.full(n, 1 << 32, np.uint64), np.empty(n * room, np.uint32)
    at = np.arange(n) * room
    begin = at.copy()
    for a, b, active in reversed([(x, min(x + 32, b), k) for a, b, k in _stretches(lengths) for x in range(a, b, 32)]):
        hit, p = held[a:b, :active], chance[a:b, :active].astype(np.uint64)
        fact = np.where(hit, np.uint32(1 << _FREQ | _IS_OWN), coded[a:b, :active])
        part, start = (fact & 0x1FFF).astype(np.uint64), (fact >> 13 & 0x1FFF).astype(np.uint64)
        put = np.where(fact < _IS_OWN, _PLACES.take(ids[a:b, :active]), np.uint16(0)).astype(np.uint64)
        bits, put = put >> _U(12), put & _U((1 << 12) - 1)
        part0, start0 = np.where(hit, p, _U(1 << _BIT) - p), np.where(hit, _U(0), p)
        limit = part * part0 << _U(64 - _BIT - _FREQ) - bits
        rest, rest0 = _U(1 << _FREQ) - part, _U(1 << _BIT) - part0
        x, w = state[:active], at[:active]
        for t in range(b - a - 1, -1, -1):
            full = x >= limit[t]
            words[w] = x  # the low half; kept only if the state is full
            w += full
            x >>= full * _WORD
            x <<= bits[t]
            x |= put[t]
            for size, more, first in ((part[t], rest[t], start[t]), (part0[t], rest0[t], start0[t])):
                over = x // size  # x // size * 2 ** bits + x % size + first
                over *= more
                x += over
                x += first
    heads = np.stack([state & _LOW, state >> _U(32)], 1).astype("<u4")
    return [heads[k].tobytes() + words[begin[k] : at[k]][::-1].astype("<u4").tobytes() for k in range(n)]


def _decode(payloads: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """rows[lane, step] of payloads; lengths descend. Whatever the payloads hold, ids stay within MAX_ID."""
    n = len(payloads)
    padded = [p.ljust(8, b"\0") + bytes(-len(p) % 4 if len(p) > 8 else 0) for p in payloads]
    words = np.frombuffer(b"".join(padded), "<u4").astype(np.uint64)
    at = np.cumsum([0, *(len(p) // 4 for p in padded)])[:-1]
    state = words[at] | words[at + 1] << _U(32)
    at += 2
    steps = int(lengths.max(initial=0))
    ids, rows = np.zeros((steps, n), np.uint16), np.zeros((n, steps), np.uint16)
    model, last = _Model(n), np.zeros(n, np.uint64)
    slots = 1 << _FREQ
    bit_mask, bit_size, slot_mask, slot_size = _U((1 << _BIT) - 1), _U(_BIT), _U(slots - 1), _U(_FREQ)
    field, thirteen, fifteen, four = _U(0x1FFF), _U(13), _U(15), _U(4)
    for a, b, active in _stretches(lengths):
        if active < model.n:
            model.narrow(active)
            last, state, at = last[:active], state[:active], at[:active]
        if a in UPDATES:
            model.count_up(rows, a)
            wide, width = active, len(model.upto)
            symbol_of = np.zeros((slots + 1, wide), np.int16)  # of each slot: the symbols that begin up to it, but one
            symbol_of.reshape(-1)[model.upto[:-1] * np.int64(wide) + np.arange(wide)] = 1
            for k in range(1, slots):
                symbol_of[k] += symbol_of[k - 1]
            symbol_of = symbol_of.reshape(-1)
            facts = np.zeros((width, wide), np.uint64)  # first id, bits of a place, start and slots of each symbol
            facts[:_RANGES] = (_FIRST << 30 | _BITS << 26).astype(np.uint64)[:, None]
            facts[model.symbol, model.of] = model.own << 30
            facts |= (model.upto - model.share << 13 | model.share).astype(np.uint64)
            facts = facts.reshape(-1)
        lane = np.arange(active, dtype=np.uint64)
        lane_at = lane.view(np.int64)
        wide_u = _U(wide)
        for t in range(a, b):
            p = model.predict(last).astype(np.uint64)
            slot = state & bit_mask
            hit = slot < p
            held = state >> bit_size
            held *= p
            state -= held  # what is left if the bit is zero: (2 ** _BIT - p) * (state >> _BIT) + slot - p
            state -= p
            held += slot
            np.bitwise_and(state, slot_mask, out=slot)
            place = slot * wide_u
            place += lane
            symbol = symbol_of.take(place.view(np.int64), mode="clip").astype(np.int64)
            symbol *= wide
            symbol += lane_at
            fact = facts.take(symbol, mode="clip")
            state >>= slot_size
            np.bitwise_and(fact, field, out=place)
            state *= place
            state += slot
            fact >>= thirteen
            np.bitwise_and(fact, field, out=place)
            state -= place
            fact >>= thirteen
            np.bitwise_and(fact, fifteen, out=place)  # bits of the place in a range
            fact >>= four
            np.left_shift(_ONE, place, out=slot)
            slot -= _ONE
            slot &= state
            fact += slot
            state >>= place
            np.copyto(state, held, where=hit)
            ident = fact.astype(np.int32)
            ident <<= 4
            np.copyto(ident, model.guess, where=hit)
            short = state <= _LOW
            np.left_shift(state, _WORD, out=held)
            held |= words.take(at, mode="clip")
            np.copyto(state, held, where=short)
            at += short
            model.learn(ident, hit)
            last = (ident >> 4).astype(np.uint64)
            ids[t, :active] = last
        rows[:active, a:b] = ids[a:b, :active].T
    return rows


def encode_blocks(ids: np.ndarray) -> list[tuple[int, bytes, int]]:
    """(ids, payload, crc32) of each block of an array of ids."""
    if len(ids) and int(ids.max()) > MAX_ID:
        raise ValueError(f"ids go up to {MAX_ID}")
    ids = ids.astype("<u4", copy=False)
    out = []
    for a in range(0, len(ids), SEGMENT_IDS):
        part = ids[a : a + SEGMENT_IDS]
        n = -(-len(part) // BLOCK)
        lengths = np.full(n, BLOCK)
        lengths[-1] = len(part) - BLOCK * (n - 1)
        matrix = np.zeros((n, BLOCK), np.uint16)
        matrix.reshape(-1)[: len(part)] = part
        payloads = _encode(matrix[:, : lengths[0]], lengths)
        for k in range(n):
            out.append((int(lengths[k]), payloads[k], zlib.crc32(part[k * BLOCK : (k + 1) * BLOCK])))
    return out


def decode_blocks(blocks: list[tuple[int, bytes, int]]) -> np.ndarray:
    """The ids of blocks; a block whose checksum is wrong raises ValueError."""
    parts = []
    for a in range(0, len(blocks), LANES):
        group = blocks[a : a + LANES]
        lengths = np.array([b[0] for b in group])
        order = np.argsort(-lengths, kind="stable")
        if lengths.max() > BLOCK:
            raise ValueError("a block is too long")
        rows = _decode([group[k][1] for k in order], lengths[order])
        own = np.empty(rows.shape, "<u4")
        own[order] = rows
        for k, (n, _, crc) in enumerate(group):
            if zlib.crc32(own[k, :n]) != crc:
                raise ValueError(f"the checksum of block {a + k} is wrong")
            parts.append(own[k, :n])
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def write_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A segment of documents (those with a null id first) and their ids as little-endian 32-bit integers."""
    nulls = sum(d is None for d in doc_ids)
    blocks = encode_blocks(np.frombuffer(b"".join(ids), "<u4"))
    lengths = [len(x) // 4 for x in ids]
    return b"".join(
        [
            _HEADER.pack(MAGIC, len(ids), nulls, sum(lengths), len(blocks)),
            np.array([d for d in doc_ids if d is not None], "<i8").tobytes(),
            np.array(lengths, "<u4").tobytes(),
            np.array([(n, len(p), c) for n, p, c in blocks], "<u4").reshape(-1, 3).tobytes(),
            *(p for _, p, _ in blocks),
        ]
    )


def read_segment(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Document ids and the ids of each document."""
    if data[:4] != MAGIC or len(data) < _HEADER.size:
        raise ValueError("not a segment")
    _, n, nulls, total, n_blocks = _HEADER.unpack_from(data)
    at = _HEADER.size
    doc_ids = [None] * nulls + np.frombuffer(data, "<i8", n - nulls, at).tolist()
    at += 8 * (n - nulls)
    lengths = np.frombuffer(data, "<u4", n, at)
    at += 4 * n
    rows = np.frombuffer(data, "<u4", 3 * n_blocks, at).reshape(-1, 3).tolist()
    at += 12 * n_blocks
    blocks = []
    for count, size, crc in rows:
        blocks.append((count, data[at : at + size], crc))
        at += size
    ids = decode_blocks(blocks)
    if len(ids) != total or at != len(data):
        raise ValueError("the segment is cut")
    return doc_ids, np.split(ids, np.cumsum(lengths)[:-1]) if n else []


def write_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Token files of documents (doc_id, text) in ascending doc_id order: shard, segment, n_tokens, content.

    A shard is a range of doc_id, or within one doc_id (or none) of how texts begin; shards, and the segments of a shard,
    follow each other in that order. Null texts are empty; rows with a null doc_id come first, rows of one doc_id in the
    order of their texts. Repeated rows are repeated, more columns are ignored, an empty table gives no files. Ids above
    MAX_ID, which the byte-level vocabulary doesn't have, are an error.
    """
    path = path or tokens.byte_bpe()
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 32)).sortWithinPartitions("doc_id", "text")

    def run(it):
        encode, tail = tokens.encoder(path).encode, np.array([end_id], "<u4").tobytes()
        shard, segment, names, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([size], pa.int64()), pa.array([write_segment(names, ids)], pa.binary())], names=["shard", "segment", "n_tokens", "content"]
            )

        for batch in slices(it):
            for doc, own in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()])):
                if size and size + len(own) // 4 + 1 > SEGMENT_IDS:
                    yield row()
                    segment, names, ids, size = segment + 1, [], [], 0
                names.append(doc)
                ids.append(own + tail)
                size += len(own) // 4 + 1
        if size:
            yield row()

    return ranged.mapInArrow(run, "shard int, segment int, n_tokens long, content binary")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in token files.

    Only one total for each shard comes to the driver.
    """

    def run(it):
        for batch in it:
            for k in range(batch.num_rows):
                names, ids = read_segment(batch.column(2)[k].as_py())
                n = np.array([len(x) for x in ids], np.int64)
                arrays = [pa.array([batch.column(j)[k].as_py()] * len(n), pa.int32()) for j in range(2)]
                arrays += [pa.array(names, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "segment", "doc_id", "own", "n_tokens", "ids_crc32"])

    spark = files.sparkSession
    docs = files.select("shard", "segment", "content").mapInArrow(run, "shard int, segment int, doc_id long, own long, n_tokens long, ids_crc32 long")
    totals = sorted(files.groupBy("shard").agg(F.sum("n_tokens")).collect())
    before, shards = 0, []
    for shard, n in totals:
        shards.append((shard, before))
        before += n
    shards = spark.createDataFrame(shards, "shard int, shard_start long")
    order = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = files.select("shard", "segment", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("segment_start"))
    placed = docs.join(segments, ["shard", "segment"]).join(F.broadcast(shards), "shard")
    return placed.select("doc_id", (F.col("shard_start") + F.col("segment_start") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def through_files(docs: DataFrame) -> DataFrame:
    """Write the token files of docs into the shared folder and read them back."""
    return read_files(stored(write_files(docs), "token-files"))
