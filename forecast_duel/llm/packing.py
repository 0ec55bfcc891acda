"""Best-fit packing of documents into sequences of bounded length by bin completion branch-and-bound.

Texts are tokenised once and cut into pieces that are stored. The packing itself is decided on the histogram of
piece lengths, which has at most ``capacity`` rows however many pieces there are: a plan is a list of bin patterns,
each with a number of copies. Pieces then find their places by rank within their length, shard by shard.

Defined results: a null text is empty and packs as its closing id alone; repeated rows and null ids are packed
each. Equal pieces are interchangeable, so ties have no effect on the number of sequences.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from forecast_duel.llm.common import kept, stored, text_chunks
from forecast_duel.llm.words import PARTED, SPACED, words

CAPACITY = 2048
#: Sizes and fillings that the search for a packing may look at; the best plan found so far stands at the end.
WORK_LIMIT = 3_000_000
#: Words whose ids a task remembers before it starts anew.
REMEMBERED_WORDS = 1_000_000

Pattern = tuple[int, tuple[int, ...]]  # copies, lengths


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole buffers.

    The vocabulary folds case, drops white space and parts words between letters, digits and other signs. No token
    spans such a border, so each different part is encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.between,) = self.ids_of(b"\x01")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.begin, self.ids, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32), 0

    def encode_words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word and their numbers. Words are encoded in strings of several, with a control character between."""
        flat, sizes = [], []
        for i in range(0, len(texts), 1024):
            part = texts[i : i + 1024]
            whole = b" \x01 ".join(part)
            if whole.count(b"\x01") == len(part) - 1:
                ids = self.ids_of(whole)
                cut = np.flatnonzero(ids == self.between)
                flat.append(ids[ids != self.between])
                sizes.append(np.diff(np.r_[-1, cut, len(ids)]) - 1)
            else:  # a word has the control character itself
                for text in part:
                    flat.append(self.ids_of(text))
                    sizes.append([len(flat[-1])])
        return np.concatenate(flat), np.concatenate(sizes)

    def ids_of(self, text: bytes) -> np.ndarray:
        encoded = self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0]
        return np.array(encoded.ids, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin."""
        raw = data.tobytes()
        # Parts of words recur more than words do; a special token is no sequence of parts.
        whole = any(token in raw for token in self.special)
        found = words(data, offsets, SPACED, lower=not whole, part=None if whole else PARTED)
        codes, at, which = np.unique(found.code, return_index=True, return_inverse=True)
        if len(self.rows) > REMEMBERED_WORDS:
            self.forget()
        keys = codes.tolist()
        new = [i for i, code in enumerate(keys) if code not in self.rows]
        if new:
            begins, ends = found.start[at[new]].tolist(), found.end[at[new]].tolist()
            flat, sizes = self.encode_words([raw[b:e] for b, e in zip(begins, ends)])
            while self.used + len(flat) > len(self.ids):
                self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
            self.ids[self.used : self.used + len(flat)] = flat
            known = len(self.rows)
            self.begin = np.r_[self.begin, self.used + np.cumsum(sizes)]
            self.used += len(flat)
            self.rows.update((keys[i], known + k) for k, i in enumerate(new))
        row = np.fromiter((self.rows[k] for k in keys), np.int64, len(keys))[which]
        sizes = self.begin[row + 1] - self.begin[row]
        ends = np.r_[0, np.cumsum(sizes)]
        ids = self.ids[np.repeat(self.begin[row] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[found.first]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           vocabulary: str | None = None, closing_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, piece, start, length, ids_crc32 (and ids), shard and rank in it.

    ``rank`` numbers the pieces of one length within their ``shard``.
    """
    path = vocabulary or default_vocabulary()
    fields = [docs.schema[id_col]] + [
        T.StructField(n, t) for n, t in (
            ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()),
            ("shard", T.IntegerType()), ("rank", T.LongType()), *([("ids", T.BinaryType())] if with_ids else []))]
    schema = T.StructType(fields)

    def run(batches):
        encoder = kept(f"encoder {path}", lambda: Encoder(path))
        encoder.forget()  # words are remembered within a task: a worker that waits for other work holds none
        shard, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch, "text"):
                ids, first = encoder.encode(data, offsets)
                rows: list[tuple] = []
                for k in range(j - i):
                    own = np.r_[ids[first[k] : first[k + 1]], np.uint32(closing_id)].astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity].tobytes()
                        length = len(part) // 4
                        rows.append((k, piece, start, length, zlib.crc32(part), int(seen[length]), part))
                        seen[length] += 1
                of, piece, start, length, crc, rank, part = zip(*rows)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(i, j - i).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([shard] * len(rows), pa.int32()),
                    pa.array(rank, pa.int64()), *([pa.array(part, pa.binary())] if with_ids else []),
                ], names=schema.names)
        encoder.forget()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: equal bins are kept as one group."""
    open_bins: dict[int, list[list]] = {}  # space left -> groups of [copies, lengths]
    spaces: list[int] = []

    def put(space: int, copies: int, lengths: tuple[int, ...]) -> None:
        if space not in open_bins:
            open_bins[space] = []
            spaces.insert(bisect_right(spaces, space), space)
        open_bins[space].append([copies, lengths])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect_right(spaces, size - 1)
            if i == len(spaces):
                many = capacity // size
                if left >= many:
                    put(capacity - many * size, left // many, (size,) * many)
                if left % many:
                    put(capacity - left % many * size, 1, (size,) * (left % many))
                break
            space = spaces[i]
            group = open_bins[space][-1]
            take = min(left, group[0])
            group[0] -= take
            left -= take
            if not group[0]:
                open_bins[space].pop()
                if not open_bins[space]:
                    del open_bins[space]
                    spaces.pop(i)
            put(space - size, take, group[1] + (size,))
    return [(copies, lengths) for groups in open_bins.values() for copies, lengths in groups]


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and of the bounds that set aside pieces too large to share a bin."""
    total = int((sizes * counts).sum())
    best = -(-total // capacity)
    for k in np.unique(np.r_[sizes[sizes <= capacity // 2], 0]):
        alone = sizes > capacity - k
        half = (sizes > capacity // 2) & ~alone
        small = (sizes <= capacity // 2) & (sizes >= k)
        room = int(counts[half].sum()) * capacity - int((sizes * counts)[half].sum())
        more = max(0, int((sizes * counts)[small].sum()) - room)
        best = max(best, int(counts[alone].sum() + counts[half].sum()) + -(-more // capacity))
    return best


def reachable(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """For each i the sums, up to ``capacity``, that pieces of the first i sizes can make, as bits of a number."""
    everything, sums, found = (1 << (capacity + 1)) - 1, 1, [1]
    for size, count in zip(sizes, counts):
        many, step = min(count, capacity // size), 1
        while many:
            step = min(step, many)
            sums |= (sums << (step * size)) & everything
            many, step = many - step, 2 * step
        found.append(sums)
    return found


def spread(sums: int, by: int) -> int:
    """Every sum and the ``by`` numbers above it."""
    width = 0
    while width < by:
        step = min(width + 1, by - width)
        sums |= sums << step
        width += step
    return sums


Filling = tuple[tuple[int, int], ...]  # index of a size, pieces of it


class Completion:
    """Bin completion on a histogram of lengths.

    A node takes the largest piece that is left and completes its bin by an undominated filling: no piece that is left
    could join it, or stand for smaller ones in it. Fillings have any number of pieces, each multiset comes once, least waste first,
    and are made when they are asked for. A filling is used for as many bins as the pieces allow, or for a half, a quarter and so on
    down to one. A branch ends when its waste exceeds what any better plan may waste.

    Branches are taken in the order of limited discrepancy: first the plan of all first choices, then plans that leave
    them in one place, and so on, so that early choices are revised as well. ``work`` counts the sizes and fillings looked at.
    """

    def __init__(self, counts: dict[int, int], capacity: int, limit: int):
        self.sizes = sorted(s for s, n in counts.items() if n)
        self.left = [counts[s] for s in self.sizes]
        self.capacity, self.limit, self.work, self.cut = capacity, limit, 0, False
        self.total = sum(s * n for s, n in counts.items())
        self.plan = best_fit(counts, capacity)
        self.bins = sum(copies for copies, _ in self.plan)

    def sums_to(self, total: int, there: list[int], reach: list[int], within: int) -> Iterator[Filling]:
        """Multisets of the first ``within`` sizes of ``there``, which falls, that add up to ``total``.

        The one whose smallest piece is largest comes first, as small pieces fit in more places later on. A branch that cannot
        be completed is not entered. A filling has few different sizes, so the recursion is shallow.
        """
        if not total:
            yield ()
            return
        for k in range(bisect_left(range(within + 1), True, key=lambda k: bool(reach[k] >> total & 1)), within + 1):
            size = self.sizes[there[k - 1]]
            self.work += 1
            for many in range(1, min(self.left[there[k - 1]], total // size) + 1):
                if reach[k - 1] >> (total - many * size) & 1:
                    for more in self.sums_to(total - many * size, there, reach, k - 1):
                        yield ((there[k - 1], many), *more)
            if self.work >= self.limit:
                return

    def dominated(self, filling: Filling, waste: int) -> bool:
        """Whether a piece that is left could join, or stand for one smaller piece or for several, within the bin."""
        used, several, single = 1, 0, 0
        for i, many in filling:
            for _ in range(many):
                several |= (several | used & ~1) << self.sizes[i]
                used |= used << self.sizes[i]
            single |= 1 << self.sizes[i]
        better = spread(several | 1, waste) | (spread(single << 1, waste - 1) if waste else 0)
        taken = dict(filling)
        found = better & self.bits & ~1
        while found:
            size = (found & -found).bit_length() - 1
            i = bisect_right(self.sizes, size) - 1
            if self.left[i] > taken.get(i, 0):
                return True
            found &= found - 1
        return False

    def fillings(self, space: int, slack: int) -> Iterator[tuple[int, Filling]]:
        """(waste, filling) of a space; ``slack`` is the most that it may waste."""
        there = [i for i in range(bisect_right(self.sizes, space) - 1, -1, -1) if self.left[i]]
        self.work += 1 + len(there)
        if there and self.sizes[there[0]] == space:  # dominates all others
            yield 0, ((there[0], 1),)
            return
        reach = reachable([self.sizes[i] for i in there], [self.left[i] for i in there], space)
        for waste in range(min(space, slack) + 1):
            if reach[-1] >> (space - waste) & 1:
                for filling in self.sums_to(space - waste, there, reach, len(there)):
                    self.work += len(filling)
                    if not self.dominated(filling, waste):
                        yield waste, filling
            if self.work >= self.limit:
                return

    def branches(self, allowed: int, slack: int) -> Iterator[tuple[int, int, int, Filling]]:
        """(discrepancies, copies, waste, whole bin) of a node, of which at most ``allowed`` discrepancies are left."""
        top = max(i for i, n in enumerate(self.left) if n)
        self.left[top] -= 1
        found = self.fillings(self.capacity - self.sizes[top], slack)
        for rank in range(allowed + 2):
            waste, filling = next(found, (0, None))
            self.left[top] += 1
            if filling is None:
                return
            if rank > allowed:
                self.cut = True
                return
            whole = {**dict(filling), top: dict(filling).get(top, 0) + 1}
            copies = min(self.left[i] // many for i, many in whole.items())
            if waste:
                copies = min(copies, slack // waste)
            for used in range(rank, allowed + 1):
                yield used, copies, waste, tuple(whole.items())
                if copies == 1:
                    break
                copies //= 2
            else:
                self.cut = True
            self.left[top] -= 1

    def place(self, copies: int, filling: Filling) -> None:
        for i, many in filling:
            self.left[i] -= copies * many

    def dive(self, allowed: int) -> None:
        """All plans of at most ``allowed`` discrepancies."""
        path: list[tuple[int, int, int, Filling]] = []
        bins = waste = spent = 0
        stack = [self.branches(allowed, (self.bins - 1) * self.capacity - self.total)]
        while stack and self.work < self.limit:
            step = next(stack[-1], None)
            if step is not None:
                used, copies, lost, filling = step
                slack = (self.bins - 1) * self.capacity - self.total - waste - copies * lost
                if slack < 0:  # no better plan wastes as much
                    continue
                self.place(copies, filling)
                if any(self.left):
                    path.append(step)
                    bins, waste, spent = bins + copies, waste + copies * lost, spent + used
                    stack.append(self.branches(allowed - spent, slack))
                    continue
                self.bins = bins + copies
                self.plan = [(c, tuple(self.sizes[i] for i, many in f for _ in range(many))) for _, c, _, f in [*path, step]]
                self.place(-copies, filling)
                continue
            stack.pop()
            if path:
                used, copies, lost, filling = path.pop()
                self.place(-copies, filling)
                bins, waste, spent = bins - copies, waste - copies * lost, spent - used
        for _, copies, _, filling in path:
            self.place(-copies, filling)

    def best(self) -> list[Pattern]:
        self.bits = sum(1 << s for s in self.sizes)
        bound = lower_bound(np.array(self.sizes, np.int64), np.array(self.left, np.int64), self.capacity) if self.sizes else 0
        allowed = 0
        while self.bins > bound and self.work < self.limit:
            self.cut = False
            self.dive(allowed)
            if not self.cut:
                break
            allowed += 1
        return self.plan


def completed(counts: dict[int, int], capacity: int = CAPACITY, work_limit: int = WORK_LIMIT) -> list[Pattern]:
    """A plan with as few bins as bin completion finds: best-fit decreasing is the first incumbent, a plan that meets the lower bound
    ends the search, and so does ``work_limit``."""
    return Completion(counts, capacity, work_limit).best()


def slots(plan: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): equal pieces take the slots of their length in order."""
    rows, taken, sequence = [], {}, 0
    for copies, lengths in plan:
        offset = 0
        for length in lengths:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + copies
            offset += length
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def place(cut: DataFrame, capacity: int = CAPACITY, work_limit: int = WORK_LIMIT) -> DataFrame:
    """Stored ``pieces`` with sequence_id and offset instead of shard and rank."""
    by_shard = cut.groupBy("length", "shard").count()
    counts = {int(r["length"]): int(r["n"]) for r in by_shard.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = slots(completed(counts, capacity, work_limit))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = by_shard.select("length", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    ranked = cut.join(base, ["length", "shard"]).withColumn("_rank", F.col("rank") + F.col("_base"))
    names = [c for c in cut.columns if c not in ("shard", "rank")]
    schema = T.StructType([cut.schema[c] for c in names] + [
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    span = np.int64(1) << np.int64(50)
    keys = table[:, 0] * span + table[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            row = np.searchsorted(keys, length * span + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(table[row, 2] + rank - table[row, 1]), pa.array(table[row, 3])],
                names=schema.names)

    return ranked.select(*names, "_rank").mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         vocabulary: str | None = None, work_limit: int = WORK_LIMIT, with_ids: bool = False) -> DataFrame:
    """One row a piece with its place: sequence_id and offset."""
    cut = stored(pieces(docs, id_col, text_col, capacity, vocabulary, with_ids=with_ids), "pieces")
    return place(cut, capacity, work_limit)
