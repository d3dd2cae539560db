"""Adaptive context-mixing range coder for token ids.

A block starts from a fixed state.  For every id the coder holds predictions of
three orders: the id last seen after the same two ids, the id last seen after the
same one, and two caches of recent ids (64 and 1,024 slots).  What happens is one of
five events: order 2 is right, order 1 is right, the small cache has the id (its
slot follows), the large one has it, or the id itself follows.  Three adaptive event
distributions (by the confidence of order 2, by that of order 1, and plain) are
mixed with weights that follow their recent cost, and the mixture drives a carryless
range coder with 64-bit state and 16-bit output.

All arithmetic is on integers, so every machine decodes alike.  Blocks are coded side
by side: a step handles one id of each block with array operations.
"""

from __future__ import annotations

import numpy as np

EVENTS = 5
_BITS = np.array([0, 0, 6, 10, 16], np.uint64)
_ORDER2, _ORDER1 = 12, 11
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 32)
_S = {k: np.uint64(k) for k in (4, 16, 28, 48)}
#: cost of a 12-bit probability in 1/16 bits, by its upper eight bits
_COST = np.array([int(round(16 * (8 - np.log2(max(i, 0.5))))) for i in range(257)], np.int32)
_WEIGHTS = np.array([144, 72, 40], np.int32)  # cheapest model first; together 256
MAX_ID = 1 << 16


class _Model:
    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.t2 = np.zeros(lanes << _ORDER2, np.int32)  # predicted id * 4 + confidence
        self.t1 = np.zeros(lanes << _ORDER1, np.int32)
        self.c6 = np.zeros(lanes * 64, np.int32)
        self.c10 = np.zeros(lanes * 1024, np.int32)
        start = np.array([[1200], [2000], [2800], [3500]], np.int32)
        self.by2, self.by1 = np.repeat(start, lanes * 4, axis=1), np.repeat(start, lanes * 4, axis=1)
        self.flat = np.repeat(start, lanes, axis=1)
        self.cost = np.zeros((3, lanes), np.int32)
        self.weight = np.full((3, lanes), 85, np.int32)
        self.prev = np.zeros(lanes, np.int64)
        self.prev2 = np.zeros(lanes, np.int64)
        self.steps = 0

    def predict(self):
        """Predictions of the orders; cumulative 12-bit event frequencies, one row more than events."""
        h2 = ((self.prev * 40503 + self.prev2 * 30011) & 0xFFFFF) >> (20 - _ORDER2)
        h1 = ((self.prev * 40503) & 0xFFFFF) >> (20 - _ORDER1)
        self.at2, self.at1 = (self.lane << _ORDER2) + h2, (self.lane << _ORDER1) + h1
        e2, e1 = self.t2[self.at2], self.t1[self.at1]
        self.p2, self.p1 = e2 >> 2, e1 >> 2
        self.k2, self.k1 = e2 & 3, e1 & 3
        self.row2, self.row1 = self.lane * 4 + self.k2, self.lane * 4 + self.k1
        self.m2, self.m1 = self.by2[:, self.row2], self.by1[:, self.row1]
        mix = (self.weight[0] * self.m2 + self.weight[1] * self.m1 + self.weight[2] * self.flat) >> 8
        cum = np.zeros((EVENTS + 1, len(self.lane)), np.int64)
        cum[1:EVENTS] = ((mix * 4056) >> 12) + _FLOOR
        cum[EVENTS] = 4096
        return cum

    def update(self, event: np.ndarray, ids: np.ndarray) -> None:
        hit = (event[None, :] <= _RISE).astype(np.int32) * 4095
        if self.steps % 4 == 0:
            for i, m in enumerate((self.m2, self.m1, self.flat)):
                edge = np.zeros((EVENTS + 1, len(ids)), np.int32)
                edge[1:EVENTS], edge[EVENTS] = m, 4096
                p = edge[event + 1, self.lane] - edge[event, self.lane]
                self.cost[i] += _COST[np.maximum(p, 0) >> 4]
            if self.steps % 64 == 60:
                order = np.argsort(self.cost, axis=0, kind="stable")
                np.put_along_axis(self.weight, order, _WEIGHTS[:, None], axis=0)
                self.cost >>= 1
        self.by2[:, self.row2] = self.m2 + ((hit - self.m2) >> 5)
        self.by1[:, self.row1] = self.m1 + ((hit - self.m1) >> 5)
        self.flat += (hit - self.flat) >> 6
        own = ids.astype(np.int32) << 2
        self.t2[self.at2] = own + np.where(self.p2 == ids, np.minimum(self.k2 + 1, 3), 0)
        self.t1[self.at1] = own + np.where(self.p1 == ids, np.minimum(self.k1 + 1, 3), 0)
        self.c6[self.lane * 64 + _slot6(ids)] = ids
        self.c10[self.lane * 1024 + _slot10(ids)] = ids
        self.prev2, self.prev = self.prev, ids
        self.steps += 1


_RISE = np.arange(EVENTS - 1)[:, None]
_FLOOR = np.arange(1, EVENTS)[:, None] * 8


def _slot6(ids: np.ndarray) -> np.ndarray:
    return ((ids * 40503) & 0xFFFF) >> 10


def _slot10(ids: np.ndarray) -> np.ndarray:
    return ((ids * 30011) & 0xFFFF) >> 6


def encode(blocks: np.ndarray) -> list[bytes]:
    """Code each row of ``blocks`` by itself; ids from ``MAX_ID`` on raise an error."""
    lanes, n = blocks.shape
    if blocks.size and int(blocks.max()) >= MAX_ID:
        raise ValueError(f"ids of {MAX_ID} and more can't be coded")
    m = _Model(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    out, at = np.zeros((lanes, 2 * n + 8), "<u2"), np.zeros(lanes, np.int64)
    columns = np.ascontiguousarray(blocks.T).astype(np.int64)
    for t in range(n):
        ids = columns[t]
        cum = m.predict()
        s6, s10 = _slot6(ids), _slot10(ids)
        event = np.where(ids == m.p2, 0, np.where(ids == m.p1, 1, np.where(
            m.c6[m.lane * 64 + s6] == ids, 2, np.where(m.c10[m.lane * 1024 + s10] == ids, 3, 4))))
        extra = np.where(event == 4, ids, np.where(event == 3, s10, np.where(event == 2, s6, 0))).astype(np.uint64)
        begin, end = cum[event, m.lane].astype(np.uint64), cum[event + 1, m.lane].astype(np.uint64)
        width = (end - begin) << (_S[16] - _BITS[event])
        r = span >> _S[28]
        low += ((begin << _S[16]) + extra * width) * r
        span = r * width
        while True:
            under = span < _BOT
            ready = ((low ^ (low + span)) < _TOP) | under
            if not ready.any():
                break
            k = np.flatnonzero(ready)
            lk, sk = low[k], span[k]
            cut = ((lk ^ (lk + sk)) >= _TOP) & (sk < _BOT)
            sk = np.where(cut, (~lk + np.uint64(1)) & (_BOT - np.uint64(1)), sk)
            out[k, at[k]] = lk >> _S[48]
            at[k] += 1
            low[k], span[k] = lk << _S[16], sk << _S[16]
        m.update(event, ids)
    for _ in range(4):
        out[m.lane, at] = low >> _S[48]
        at += 1
        low <<= _S[16]
    return [out[i, :at[i]].tobytes() for i in range(lanes)]


def decode(streams: list[bytes], n: int) -> np.ndarray:
    """The ``n`` ids of each stream."""
    lanes = len(streams)
    m = _Model(lanes)
    longest = max(map(len, streams), default=0) // 2 + 8
    words = np.zeros((lanes, longest), np.uint64)
    for i, s in enumerate(streams):
        x = np.frombuffer(s, "<u2")
        words[i, :len(x)] = x
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    code, at = np.zeros(lanes, np.uint64), np.zeros(lanes, np.int64)
    for _ in range(4):
        code = (code << _S[16]) | words[m.lane, at]
        at += 1
    out = np.zeros((n, lanes), np.int64)
    for t in range(n):
        cum = m.predict()
        r = span >> _S[28]
        v = np.minimum((code - low) // r, np.uint64((1 << 28) - 1))
        event = ((v >> _S[16]).astype(np.int64)[None, :] >= cum[1:EVENTS]).sum(axis=0)
        begin, end = cum[event, m.lane].astype(np.uint64), cum[event + 1, m.lane].astype(np.uint64)
        width = (end - begin) << (_S[16] - _BITS[event])
        extra = (v - (begin << _S[16])) // width
        slot = extra.astype(np.int64)
        ids = np.where(event == 0, m.p2, np.where(event == 1, m.p1, np.where(
            event == 2, m.c6[m.lane * 64 + (slot & 63)], np.where(event == 3, m.c10[m.lane * 1024 + (slot & 1023)], slot))))
        ids = ids.astype(np.int64)
        out[t] = ids
        low += ((begin << _S[16]) + extra * width) * r
        span = r * width
        while True:
            ready = ((low ^ (low + span)) < _TOP) | (span < _BOT)
            if not ready.any():
                break
            k = np.flatnonzero(ready)
            lk, sk = low[k], span[k]
            cut = ((lk ^ (lk + sk)) >= _TOP) & (sk < _BOT)
            sk = np.where(cut, (~lk + np.uint64(1)) & (_BOT - np.uint64(1)), sk)
            code[k] = (code[k] << _S[16]) | words[k, np.minimum(at[k], longest - 1)]
            at[k] += 1
            low[k], span[k] = lk << _S[16], sk << _S[16]
        m.update(event, ids)
    return np.ascontiguousarray(out.T)
