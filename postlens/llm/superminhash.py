"""SuperMinHash signatures of sets of 64-bit elements, many sets at a time.

Every element draws a random order of the slots, one slot after the other (a
Fisher-Yates shuffle driven by its hash); the slot drawn at step j gets the value j + r,
0 <= r < 1, and a slot keeps the least value of all elements.  As values of step j are at
least j, a set is finished after the first step at which all its slots are filled, which for
sets well above the number of slots is the first or second.
"""

from __future__ import annotations

import numpy as np

from postlens.llm.common import mix

SLOTS = 256            #: one byte holds a slot's number
U = np.uint64


def _draw(key: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot index to swap with, value) of each element at a step."""
    x = mix(key + U((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    k = (step + ((x >> U(40)) * U(SLOTS - step) >> U(24))).astype(np.int64)
    return k, (x & U(0xFFFFFFFF)) | U(step << 32)


def signatures(doc: np.ndarray, key: np.ndarray, docs: int) -> np.ndarray:
    """(docs, SLOTS) slot values; the largest value where a set is empty."""
    empty = U((1 << 64) - 1)
    sig = np.full(docs * SLOTS, empty, np.uint64)
    if not len(key):
        return sig.reshape(docs, SLOTS)
    k0, value = _draw(key, 0)
    np.minimum.at(sig, doc * SLOTS + k0, value)
    open_ = (sig.reshape(docs, SLOTS) == empty).any(axis=1)
    act = open_[doc]
    doc, key, k0 = doc[act], key[act], k0[act]
    order, step = None, 1
    while len(key) and step < SLOTS:
        k, value = _draw(key, step)
        if step == 1:                     # slot 0 and slot k0 have changed places
            k1 = k
            slot = np.where(k == k0, 0, k)
        else:
            if order is None:
                n = np.arange(len(key))
                order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(key), 1))
                for j, kj in ((0, k0), (1, k1)):
                    order[n, j], order[n, kj] = order[n, kj], order[n, j].copy()
            n = np.arange(len(key))
            slot = order[n, k].astype(np.int64)
            order[n, k] = order[n, step]
            order[n, step] = slot
        np.minimum.at(sig, doc * SLOTS + slot, value)
        open_ = (sig.reshape(docs, SLOTS) == empty).any(axis=1)
        act = open_[doc]
        if not act.all():
            doc, key = doc[act], key[act]
            if order is not None:
                order = order[act]
            else:
                k0, k1 = k0[act], k1[act]
        step += 1
    return sig.reshape(docs, SLOTS)
