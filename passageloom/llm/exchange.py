"""Sorted fingerprints sent to the owners of their ranges as Golomb-Rice codes, and the owners' answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_HEAD = 5  # bytes: the number of values, and k


def pack(values: np.ndarray, low: int) -> bytes:
    """Sorted distinct uint64 ``values``, none below ``low``, as gaps: quotients in unary, remainders in ``k`` bits."""
    n = len(values)
    if not n:
        return bytes(_HEAD)
    gaps = np.diff(values, prepend=np.uint64(low))
    mean = max(1.0, (int(values[-1]) - low) / n)
    k = max(0, int(np.log2(mean * 0.6931472)) if mean > 1.5 else 0)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(ends[-1], np.uint8)
    unary[ends - 1] = 1
    shifts = np.arange(k, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return n.to_bytes(4, "little") + bytes([k]) + np.packbits(rest.ravel()).tobytes() + np.packbits(unary).tobytes()


def unpack(data: bytes, low: int) -> np.ndarray:
    n, k = int.from_bytes(data[:4], "little"), data[4]
    if not n:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(data, np.uint8, offset=_HEAD)
    split = (n * k + 7) // 8
    gaps = np.zeros(n, np.uint64)
    if k:
        rest = np.unpackbits(raw[:split], count=n * k).reshape(n, k)
        for i in range(k):
            gaps |= rest[:, i].astype(np.uint64) << np.uint64(i)
    ends = np.flatnonzero(np.unpackbits(raw[split:]))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    gaps |= quotients.astype(np.uint64) << np.uint64(k)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


def owner_of(values: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each uint64: equal ranges by the upper 32 bits."""
    return ((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def lowest(owner: int, owners: int) -> int:
    """The smallest value that ``owner`` holds."""
    return -(-(owner << 32) // owners) << 32


def split(values: np.ndarray, owners: int) -> Iterator[tuple[int, int, int]]:
    """``(owner, start, end)`` for each run of sorted ``values`` with one owner."""
    if len(values):
        owner = owner_of(values, owners)
        starts = np.flatnonzero(np.diff(owner, prepend=owner[0] + np.uint64(1)))
        for start, end in zip(starts, np.append(starts[1:], len(values))):
            yield int(owner[start]), int(start), int(end)


def duplicates(lists: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of distinct values, which of them another list has too."""
    together = np.concatenate(lists)
    order = np.argsort(together, kind="stable")
    ranked = together[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(together), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.split(again, np.cumsum([len(x) for x in lists])[:-1])


def ask_owners(
    messages: DataFrame,
    owners: int,
    answer: Callable[[list[np.ndarray], pd.DataFrame], list[bytes]],
    dropped_bits: int = 0,
) -> DataFrame:
    """``part, block, owner, reply`` for every message (``part, block, owner, keys`` and more columns).

    An owner sees the sorted keys of all blocks in its range; a block sends each
    key once, so a key that most rows share counts once per block. How many
    owners there are follows from the number of keys: what one holds is bounded.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low = lowest(int(pdf["owner"].iloc[0]), owners) >> dropped_bits
        lists = [unpack(keys, low) for keys in pdf["keys"]]
        return pd.DataFrame(
            {"part": pdf["part"], "block": pdf["block"], "owner": pdf["owner"], "reply": answer(lists, pdf)}
        )

    return messages.groupBy("owner").applyInPandas(run, "part int, block int, owner int, reply binary")


def mark_duplicates(lists: list[np.ndarray], _: pd.DataFrame) -> list[bytes]:
    """Bitmaps of the keys that occur in more than one list."""
    return [np.packbits(flags).tobytes() for flags in duplicates(lists)]
