"""Best-fit packing of documents into token sequences by bin completion.

Documents become pieces of at most `capacity` tokens (ids plus one end id; only longer documents are
cut). Pieces are dealt by hash into groups of about `GROUP` pieces, and each group is packed on its
own, so no task sees more than that. In a group, best-fit decreasing gives the first incumbent. Bin
completion then takes the longest piece left, walks the undominated fillings of the space beside it,
least waste first, and drops branches whose waste can't match the incumbent, later can't beat it. Choices widen
from round to round, up to all undominated fillings; a round ends by itself or when its steps are spent. Where it ends
without a proof, parts of the packing around the bins of most waste are completed anew, longest piece first, with
fillings of least waste found by subset sums, and kept where they pack as well.

Defined results: a null or empty text is one piece of the end id alone; repeated rows are packed as
rows of their own; an empty table gives no rows. Ties: pieces of equal length are taken by id, piece and
checksum; of fillings with equal waste the one with fewer pieces goes first.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm.shared import written
from millrace.llm.tokens import WordBpe

CAPACITY, END_ID, GROUP = 4096, 1, 16384
#: Widths of the search, one round for each: fillings kept of a bin and lengths tried at each place
#: (None: all of them). `EFFORT` is what a round may spend in steps, for each piece.
WIDTHS: tuple[tuple[int | None, int | None], ...] = ((1, 3), (4, 8), (None, None))
EFFORT = 60
#: Bins completed anew at a time, and after how many attempts without a gain, for each thousand pieces, no more are made.
PART, PATIENCE = 48, 500


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document, tokenised by the file at `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        for b in K.chunks(batches, text, 4 << 20):
            ids, counts = bpe.ids(b.column(1))
            out: list[list] = [[], [], [], [], []]
            at = 0
            for row, n in enumerate(counts.tolist()):
                own = np.append(ids[at : at + n], end_id).astype("<u4")
                at += n
                for p, start in enumerate(range(0, n + 1, capacity)):
                    part = own[start : start + capacity]
                    for o, v in zip(out, (row, p, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_pydict({
                key: b.column(0).take(pa.array(out[0], pa.int64())), "piece": pa.array(out[1], pa.int32()), "start": pa.array(out[2], pa.int64()),
                "length": pa.array(out[3], pa.int64()), "ids_crc32": pa.array(out[4], pa.int64()),
            })

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes to the fullest bin that holds it."""
    free: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for n in lengths:
        at = bisect_left(free, (n, -1))
        if at < len(free):
            room, b = free.pop(at)
            bins[b].append(n)
        else:
            room, b = capacity, len(bins)
            bins.append([n])
        if room - n:
            insort(free, (room - n, b))
    return bins


class Stock:
    """Pieces not yet packed, by length."""

    def __init__(self, lengths: list[int]):
        self.count: dict[int, int] = {}
        for n in lengths:
            self.count[n] = self.count.get(n, 0) + 1
        self.sizes = sorted(self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.sizes[bisect_left(self.sizes, n)]

    def put(self, n: int) -> None:
        if not self.count[n]:
            insort(self.sizes, n)
        self.count[n] += 1

    def fillings(self, room: int, keep: int | None, breadth: int | None, effort: list[int]) -> tuple[list[list[int]], bool]:
        """Undominated ways to fill `room`, least waste first, and whether they are all there are.

        A piece that fills what is left dominates several that do. A filling is dominated too if a
        longer piece could stand in place of one of its own. At most `keep` are given and `breadth`
        lengths tried at each place; every step is taken from effort[0], and nothing more is looked for
        once a filling wastes nothing, when only one is wanted.
        """
        found: list[tuple[int, list[int]]] = []
        whole = True

        def walk(room: int, longest: int, chosen: list[int]) -> None:
            nonlocal whole
            effort[0] -= 1
            stop = bisect_right(self.sizes, min(room, longest))
            if room <= longest and self.count.get(room):
                found.append((0, [*chosen, room]))
            elif not stop:
                if not self.sizes or self.sizes[0] > room:
                    found.append((room, chosen))
            else:
                least = 0 if breadth is None else max(0, stop - breadth)
                whole = whole and not least
                for n in self.sizes[least:stop][::-1]:
                    if found and (effort[0] <= 0 or (keep and len(found) >= 2 * keep) or (keep == 1 and not found[-1][0])):
                        whole = False
                        break
                    self.take(n)
                    walk(room - n, n, [*chosen, n])
                    self.put(n)

        walk(room, room, [])

        def dominated(waste: int, chosen: list[int]) -> bool:
            for n in chosen:
                at = bisect_right(self.sizes, n + waste) - 1
                if at >= 0 and self.sizes[at] > n and self.sizes[at] not in chosen:
                    return True
            return False

        best = sorted(found, key=lambda f: (f[0], len(f[1])))
        good = [c for w, c in best if not dominated(w, c)] or [c for _, c in best[:1]] or [[]]
        return good[:keep], whole and (keep is None or len(good) <= keep)


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Sequences that any packing needs, the most that a threshold k or a rounding proves.

    Pieces over capacity - k and over half of it need a sequence each. Those of k to half a capacity
    must go beside the latter kind or into sequences of their own. k = 0 is the bound by total length. Roundings are the
    dual feasible functions that count a length in k-ths of a sequence, so that k of those over a (k+1)-th fill one.
    """
    n = np.sort(np.array(lengths, np.int64))
    total = np.concatenate(([0], np.cumsum(n)))
    k = np.concatenate(([0], np.unique(n[2 * n <= capacity])))
    least = np.searchsorted(n, k)
    half = np.searchsorted(n, capacity // 2, "right")
    huge = np.maximum(np.searchsorted(n, capacity - k, "right"), half)
    room = (huge - half) * capacity - (total[huge] - total[half])
    more = np.maximum(0, -((room - (total[half] - total[least])) // capacity))
    rounded = [int(np.where((i + 1) * n % capacity == 0, n * i, (i + 1) * n // capacity * capacity).sum()) for i in range(2, 9)]
    return max(int((len(n) - half + more).max()), *(-(-r // (i * capacity)) for i, r in enumerate(rounded, 2)))


def completed(lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Bins of the lengths: each the longest left with a filling of least waste, any of them by chance.

    Sums within reach are the bits of an integer, kept as they were before each length, which then tells the lengths of
    the best sum.
    """
    left = sorted(lengths, reverse=True)
    bins = []
    while left:
        longest, *rest = left
        room = capacity - longest
        rng.shuffle(rest)
        reach, before, within = 1, [], (2 << room) - 1
        for n in rest:
            if reach >> room:
                break
            before.append(reach)
            reach |= (reach << n) & within
        at = reach.bit_length() - 1
        chosen, left = [longest], rest[len(before) :]
        for n, was in zip(rest[len(before) - 1 :: -1] if before else [], reversed(before), strict=False):
            if was >> at & 1:
                left.append(n)
            else:
                chosen.append(n)
                at -= n
        bins.append(chosen)
        left.sort(reverse=True)
    return bins


def recompleted(bins: list[list[int]], capacity: int, bound: int, attempts: int) -> list[list[int]]:
    """A packing in as many bins or fewer: again and again some bins with waste and some full ones are completed anew
    by chance (of a fixed seed), and the result stands unless it needs more bins or spreads its waste wider."""
    rng = random.Random(len(bins))
    rest = [b for b in bins if sum(b) < capacity]
    full = [b for b in bins if sum(b) == capacity]
    patience = PATIENCE * (1 + sum(map(len, bins)) // 1000)
    idle = 0

    def worth(some: list[list[int]]) -> tuple[int, int]:
        return -len(some), sum(sum(b) ** 2 for b in some)

    for _ in range(attempts):
        if len(rest) + len(full) <= bound or idle >= patience:
            break
        take = min(len(rest), rng.randint(2, PART // 2))
        for some, n in ((rest, take), (full, min(len(full), PART - take))):
            for i in range(n):
                j = rng.randrange(i, len(some))
                some[i], some[j] = some[j], some[i]
        old = rest[:take] + full[: PART - take]
        new = completed([n for b in old for n in b], capacity, rng)
        idle = 0 if worth(new) > worth(old) else idle + 1
        if worth(new) >= worth(old):
            rest[:take] = [b for b in new if sum(b) < capacity]
            full[: PART - take] = [b for b in new if sum(b) == capacity]
    return rest + full


def search(lengths: list[int], capacity: int, most: int, width: tuple[int | None, int | None], effort: int) -> tuple[list[list[int]] | None, bool]:
    """A packing in at most `most` bins, the best found (None: none), and whether it is proven that
    there is no better one.

    Depth first: each bin is the longest piece left with one of its fillings, least waste first. A
    branch ends when the waste so far leaves no way to use fewer bins than the best packing known.
    """
    bound = lower_bound(lengths, capacity)
    stock, left, total = Stock(lengths), len(lengths), sum(lengths)
    purse = [effort]
    best: list[list[int]] | None = None
    path: list[list[int]] = []
    waste, proven = 0, True

    def options() -> list[list[int]]:
        nonlocal proven
        n = stock.sizes[-1]
        stock.take(n)
        found, whole = stock.fillings(capacity - n, *width, purse)
        stock.put(n)
        proven = proven and whole
        return [[n, *f] for f in found[::-1]]

    stack = [options()] if lengths else []
    while stack:
        if len(path) == len(stack):  # back from below: undo this level's bin
            for n in path[-1]:
                stock.put(n)
            left += len(path[-1])
            waste -= capacity - sum(path.pop())
        if not stack[-1]:
            stack.pop()
            continue
        if purse[0] <= 0:
            return best, False
        chosen = stack[-1].pop()
        if waste + capacity - sum(chosen) > most * capacity - total:
            stack[-1].clear()  # the others of this level waste as much or more
            continue
        for n in chosen:
            stock.take(n)
        left -= len(chosen)
        waste += capacity - sum(chosen)
        path.append(chosen)
        if left:
            stack.append(options())
            continue
        best = [list(b) for b in path]
        most = len(best) - 1
        if len(best) <= bound:
            return best, True
        stack.append([])
    return best, proven


def bin_completion(lengths: list[int], capacity: int, effort: int | None = None, widths: tuple = WIDTHS) -> tuple[list[list[int]], bool]:
    """The fewest bins found for the lengths, and whether no packing has fewer.

    Best-fit decreasing is the first incumbent. Bin completion runs over it with ever wider choices,
    in each round with `effort` steps (EFFORT for each piece unless stated); the first round
    may match the incumbent, and its bins, which waste least early on, are then the ones kept. The answer
    is proven if it meets the lower bound or a round with no limit of width came to its end; else bins with waste are
    completed anew, as often as there are lengths, and the gap is at most the difference to the bound.
    """
    lengths = sorted(lengths, reverse=True)
    incumbent = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    for turn, width in enumerate(widths):
        best, proven = search(lengths, capacity, len(incumbent) - (turn > 0), width, EFFORT * len(lengths) if effort is None else effort)
        incumbent = best or incumbent
        if proven or len(incumbent) <= bound:
            return incumbent, True
    incumbent = recompleted(incumbent, capacity, bound, len(lengths) if effort is None else effort // EFFORT)
    return incumbent, len(incumbent) <= bound


def pack(parts: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """parts with sequence_id and offset: pieces of a sequence follow one another from 0 without gaps."""
    groups = max(1, math.ceil(parts.count() / group))
    names = list(parts.columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", key, "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        rows: dict[int, list[int]] = {}
        for i, n in enumerate(pdf["length"].tolist()):
            rows.setdefault(n, []).append(i)
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        base = int(pdf["bucket"].iloc[0]) << 32
        packed, _ = bin_completion(pdf["length"].tolist(), capacity)
        for b, bin_ in enumerate(packed):
            at = 0
            for n in bin_:
                i = rows[n].pop()
                seq[i], off[i] = base + b, at
                at += n
        return pdf[names].assign(sequence_id=seq, offset=off)

    kinds = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes)
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64(F.col(key), "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("bucket").applyInPandas(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    return pack(written(pieces(docs, path, key, text, capacity), "pieces"), key, capacity)
