"""Packing of documents into as few sequences of a fixed length as can be: best fit and swap-based local search.

Pieces are dealt to groups by a hash and packed group by group: best fit, longest first, and then a local search
among all underfull bins. It moves a piece or two, exchanges one for one or two for one whenever that raises the sum of
squared fills, which drives the fill into few bins and empties others, and ends when no two bins have such a step.
Bins are found by what they can give, not by trying all pairs. The emptiest bins of each group, up to an eighth of
its pieces, are opened again and packed together on the next level, until one group is left. At least half of the
pieces settle on each level, so the levels end. Nothing is dropped: every piece is in one bin.

Null and empty texts have their end id and are packed like others; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pillflow.llm.common import stored, texts_of, with_own_id, with_text_id
from pillflow.llm.tokens import word_encoder

#: Pieces in a group, on average; a group is packed in one task.
PER_GROUP = 20_000
#: The share of its pieces that a group may open again for the next level, the emptiest bins first.
REOPENED = 1 / 8
#: The emptiest bin may be opened alone if it has no larger share than this.
ALONE = 1 / 2

PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"


def cut_documents(documents: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of all documents: ids of the whole text and the end id, cut only where longer than ``capacity``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in texts_of(batches):
            rows = []
            for doc_id, raw in zip(batch["doc_id"], encoder.all_ids(list(batch["text"]))):
                ids = raw + end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a:a + 4 * capacity]
                    rows.append((doc_id, k, k * capacity, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return with_own_id(with_text_id(documents, "text").mapInPandas(cut, PIECES), documents)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # rooms that occur, ascending
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[item]
        k = bisect_left(rooms, need)
        if k < len(rooms):
            room = rooms[k]
            at = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(item)
        room -= need
        if room:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(at)
    return bins


def _closest(values: list[int], most: int) -> int:
    """Place of the largest value up to ``most`` in an ascending list, or -1."""
    return bisect_right(values, most) - 1


class _Givers:
    """Bins by what they can give, the length of one of their pieces or of two; of each length the emptiest bin first."""

    def __init__(self, capacity: int):
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.lowest = np.full(capacity + 1, 4 * capacity, np.int64)  # fill of the emptiest; bins since changed may count
        self.version: dict[int, int] = {}

    def put(self, k: int, fill: int, sizes: list[int]) -> None:
        """Bin ``k`` with pieces of ``sizes``, ascending, in place of what was known of it."""
        version = self.version[k] = self.version.get(k, 0) + 1
        each = list(dict.fromkeys(sizes))
        gives = {x + y for i, x in enumerate(each) for y in each[i + 1:]}.union(each)
        gives.update(2 * x for x, y in zip(sizes, sizes[1:]) if x == y)
        for length in gives:
            if length < len(self.heaps):
                heappush(self.heaps[length], (fill, k, version))
                if fill < self.lowest[length]:
                    self.lowest[length] = fill

    def _top(self, length: int) -> tuple[int, int, int] | None:
        heap = self.heaps[length]
        while heap and self.version[heap[0][1]] != heap[0][2]:
            heappop(heap)
        self.lowest[length] = heap[0][0] if heap else 4 * len(self.heaps)
        return heap[0] if heap else None

    def emptiest(self, length: int, but: int) -> tuple[int, int]:
        """(fill, bin) of the emptiest bin other than ``but`` that can give ``length``; (0, -1) if there is none."""
        top = self._top(length)
        if top and top[1] == but:
            own = heappop(self.heaps[length])
            top = self._top(length)
            heappush(self.heaps[length], own)
            self.lowest[length] = own[0]
        return top[:2] if top else (0, -1)

    def best_for(self, taker: int, fill: int, sizes: list[int], room: int) -> int:
        """The bin that can fill most of the taker's ``room``, for one of its pieces or for none, or -1."""
        best, giver = 0, -1
        for back in dict.fromkeys([0, *sizes]):
            if best == room:
                break
            low = back + best + 1
            lengths = np.arange(low, back + room + 1)
            for length in lengths[self.lowest[low:back + room + 1] - lengths < fill - back][::-1].tolist():
                other, k = self.emptiest(length, taker)
                if k >= 0 and other < fill + length - back:
                    best, giver = length - back, k
                    break
        return giver


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search among all underfull bins; every step raises the sum of squared fills. Empty bins are left out."""
    order = lambda i: (lengths[i], i)
    bins = [sorted(b, key=order) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    sizes = [[lengths[i] for i in b] for b in bins]
    givers = _Givers(capacity)
    for k in range(len(bins)):
        if 0 < fill[k] < capacity:
            givers.put(k, fill[k], sizes[k])
    changed = True
    while changed:
        changed = False
        for taker in sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: -fill[k]):
            while 0 < fill[taker] < capacity:
                giver = givers.best_for(taker, fill[taker], sizes[taker], capacity - fill[taker])
                if giver < 0:
                    break
                gain, out, back = _best_step(bins[giver], bins[taker], lengths, capacity - fill[taker])
                for i in out:
                    bins[giver].remove(i)
                    insort(bins[taker], i, key=order)
                for i in back:
                    bins[taker].remove(i)
                    insort(bins[giver], i, key=order)
                fill[giver] -= gain
                fill[taker] += gain
                for k in (giver, taker):
                    sizes[k] = [lengths[i] for i in bins[k]]
                    givers.put(k, fill[k], sizes[k] if fill[k] < capacity else [])
                changed = True
    return [b for b in bins if b]


def _best_step(giver: list[int], taker: list[int], lengths: list[int], room: int):
    """The step that fills most of ``room``: (gain, items from the giver, items back), or None."""
    sizes = [lengths[i] for i in giver]
    best = (0, (), ())
    for back in [(), *((i,) for i in dict((lengths[i], i) for i in taker).values())]:
        if best[0] == room:
            break
        less = sum(lengths[i] for i in back)
        most = room + less
        k = _closest(sizes, most)
        if k >= 0 and sizes[k] - less > best[0]:
            best = (sizes[k] - less, (giver[k],), back)
        low, high = 0, len(sizes) - 1
        while low < high:  # the pair with the largest sum up to `most`
            both = sizes[low] + sizes[high]
            if both > most:
                high -= 1
            else:
                if both - less > best[0]:
                    best = (both - less, (giver[low], giver[high]), back)
                low += 1
    return best if best[0] > 0 else None


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """All steps for one group: bins of item numbers, fullest first."""
    bins = improve(best_fit(lengths, capacity), lengths, capacity)
    return sorted(bins, key=lambda b: -sum(lengths[i] for i in b))


def opened_again(bins: list[list[int]], lengths: list[int], capacity: int) -> list[int]:
    """Items of the underfull bins that are packed once more, the emptiest first; ``bins`` come fullest first."""
    items: list[int] = []
    for b in reversed(bins):
        share = (len(items) + len(b)) / len(lengths)
        if sum(lengths[i] for i in b) == capacity or share > (REOPENED if items else ALONE):
            break
        items += b
    return items


def _group_packer(capacity: int, level: int, last: bool):
    def one_group(rows: pa.Table) -> pa.Table:
        lengths = rows.column("length").to_pylist()
        bins = pack_lengths(lengths, capacity)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        settled = np.ones(len(lengths), bool)
        first = (level << 56) | (rows.column("_group")[0].as_py() << 24)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = first + k, at
                at += lengths[i]
        if not last:
            settled[opened_again(bins, lengths, capacity)] = False
        for name, values in (("sequence_id", sequence), ("offset", offset), ("_settled", settled)):
            rows = rows.append_column(name, pa.array(values))
        return rows

    return one_group


def pack(pieces: DataFrame, capacity: int, per_group: int = PER_GROUP) -> DataFrame:
    """``pieces`` (any columns, among them ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    items = stored(pieces.withColumn("_item", F.monotonically_increasing_id()), "pack-pieces")
    layout = f"{items.select(pieces.columns + ['_item'])._jdf.schema().toDDL()}, _group long, sequence_id long, `offset` long, _settled boolean"
    done: DataFrame | None = None
    level = 0
    while True:
        groups = max(1, -(-items.count() // per_group))
        last = groups == 1

        dealt = items.withColumn("_group", F.pmod(F.xxhash64("_item"), F.lit(groups)))
        packed = stored(dealt.groupBy("_group").applyInArrow(_group_packer(capacity, level, last), layout), f"pack-{level}")
        settled = packed.where("_settled").drop("_group", "_settled", "_item")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        items = packed.where("not _settled").drop("_group", "_settled", "sequence_id", "offset")
        level += 1
