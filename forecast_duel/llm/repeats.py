"""Removal of repeated byte strings with a run-length index.

A byte goes if a string of ``least`` bytes that covers it also starts earlier. The documents are narrowed down
without loss before anything is indexed. In every window of ``least`` bytes the rarest of its short strings is the
anchor, rarest by a counting sketch of fixed size and then by hash, so equal windows have equal anchors. Windows in a
row with one anchor form a block. An anchor that no other block has, and its own only once, means that all windows of
the block are unique; equal blocks are all repeats but for the first. Each task settles the equal blocks it sees by itself, so a
line that a third of all documents share costs one row a task.

What is left are different blocks with one anchor. A shard of them is one text, of which ``RunLengthIndex`` keeps the
Burrows-Wheeler transform by runs, with suffix positions sampled at the ends of the runs. The blocks are streamed
through the index backwards, all in step; their matching statistics give a place in the text for every window, and
the interval of suffixes with the same window gives the first such place. All comparisons at this point are of bytes.

Positions are ordered by (id, start), a null id last. Defined results: a null text is empty; repeated rows and
other rows with one id are not earlier than each other at equal starts, and every row gets its result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecast_duel.llm import sketch
from forecast_duel.llm.common import stored, text_buffer, text_chunks
from forecast_duel.llm.ngram_join import in_runs
from forecast_duel.llm.words import BYTE_VALUE, mixed

LEAST = 100
ANCHOR = 32
_FACTORS = mixed(np.arange(11, 31, dtype=np.uint64)) | np.uint64(1)


def rolling(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hash of the string of each of the ``sizes`` (powers of two, ascending) at every place where it fits."""
    out, h, size, level = [], BYTE_VALUE[data], 1, 0
    for want in sizes:
        while size < want:
            h = h[: max(len(h) - size, 0)] * _FACTORS[level] + h[size:]
            size, level = size * 2, level + 1
        out.append(mixed(h))
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, x
    while size * 2 <= width:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - size : width - size + len(x) - width + 1])


def blocks(data: np.ndarray, offsets: np.ndarray, often: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Text number, first and last window, anchor and hash of each block of some texts, and whether it may repeat itself."""
    none = np.zeros(0, np.int64)
    nothing = (none, none, none, none, none, np.zeros(0, bool))
    if len(data) < least:
        return nothing
    short, long = rolling(data, (ANCHOR, 64))
    rank = (np.minimum(often[sketch.places(short)], (1 << 23) - 1).astype(np.uint64) << np.uint64(40)) | (short & np.uint64((1 << 40) - 1))
    width = least - ANCHOR + 1
    anchor = sliding_min(rank, width)
    # Two equal anchors within one window: nothing between them is an anchor.
    rim = np.full(width - 1, ~np.uint64(0))
    places = np.flatnonzero(rank == ~sliding_min(np.r_[rim, ~anchor, rim], width))
    again = places[:-1][(rank[places[1:]] == rank[places[:-1]]) & (np.diff(places) < width)]
    starts = np.arange(len(anchor))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    own = starts + least <= offsets[doc + 1]
    starts, doc, anchor = starts[own], doc[own], anchor[own]
    if not len(starts):
        return nothing
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(new)
    # A run is cut so that three hashed strings cover each block.
    sizes = np.diff(np.r_[first, len(starts)])
    if sizes.max() > width:
        first = np.concatenate([np.arange(f, f + s, width) for f, s in zip(first.tolist(), sizes.tolist())])
        sizes = np.diff(np.r_[first, len(starts)])
    begin, end = starts[first], starts[first] + sizes - 1 + least
    middle = (begin + end - 64) // 2
    name = mixed(mixed(mixed(long[begin]) + long[middle]) + long[end - 64] + (end - begin).astype(np.uint64))
    base = offsets[doc[first]]
    itself = np.searchsorted(again, begin) < np.searchsorted(again, end - ANCHOR, side="right")
    return doc[first], begin - base, end - base - least, anchor[first].view(np.int64), name.view(np.int64), itself


class RunLengthIndex:
    """The Burrows-Wheeler transform of a text by runs, with suffix positions sampled at both ends of each run.

    ``text`` holds symbols of 0 to 255 and separators of 256, which count as different from each other.
    """

    def __init__(self, text: np.ndarray, least: int = LEAST):
        n = len(text)
        padded = np.r_[text, np.full(8, 256, text.dtype)].astype(np.int64)
        # Separators are all different: a string ends at its first one, and the separator's number decides.
        bounds = np.flatnonzero(padded == 256)
        part = np.searchsorted(bounds, np.arange(n))
        left = bounds[part] - np.arange(n)
        key = padded[:n].copy()
        for k in range(1, 5):
            key = key * 257 + np.where(k <= left, padded[k : n + k], 0)
        rank, span = self._ranks(key * (len(bounds) + 1) + np.where(left < 5, part + 1, 0)), 5
        self.text, self.least, self.n = text, least, n
        while span * 2 <= least:
            rank, span = self._ranks(rank * np.int64(n + 1) + self._shifted(rank, span)), span * 2
        window = self._ranks(rank * np.int64(n + 1) + self._shifted(rank, least - span))
        rank, span = window, least
        while rank.max(initial=0) < n - 1:
            rank, span = self._ranks(rank * np.int64(n + 1) + self._shifted(rank, span)), span * 2
        order = np.argsort(rank)
        bwt = text[order - 1]
        starts = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        sizes = np.diff(np.r_[starts, n])
        self.run_start, self.run_symbol = starts, bwt[starts]
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        before = np.r_[0, np.cumsum(sizes[by_symbol])[:-1]]
        self.run_target = np.empty(len(starts), np.int64)
        self.run_target[by_symbol] = before  # where the first row of a run goes by a step back
        self.sample_first, self.sample_last = order[starts], order[starts + sizes - 1]
        self.run_end = starts + sizes - 1
        self.symbol_runs = self.run_symbol[by_symbol].astype(np.int64) * (len(starts) + 1) + by_symbol
        self.by_symbol = by_symbol
        # Intervals of suffixes with the same window, and the first place of each.
        same = window[order]
        self.interval = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
        self.earliest = np.minimum.reduceat(order, self.interval)
        self.last_row, self.last_place = n - 1, int(order[-1])

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        placed = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.r_[False, placed[1:] != placed[:-1]])
        return rank

    @staticmethod
    def _shifted(rank: np.ndarray, by: int) -> np.ndarray:
        return np.r_[rank[by:] + 1, np.zeros(min(by, len(rank)), np.int64)]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common prefix of suffix pairs, up to ``most``."""
        length, open_ = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for _ in range(most):
            open_ &= (a + length < self.n) & (b + length < self.n)
            if not open_.any():
                break
            x, y = np.minimum(a + length, self.n - 1), np.minimum(b + length, self.n - 1)
            open_ &= self.text[x] == self.text[y]
            length += open_
        return length

    def matching_statistics(self, patterns: list[np.ndarray]):
        """Yield, from the last symbol of the patterns to the first: (which patterns, their place in the pattern,
        row of the index, place in the text, length of the longest match). All patterns take a step at once."""
        sizes = np.array([len(p) for p in patterns], np.int64)
        flat = np.concatenate(patterns) if patterns else np.zeros(0, np.int64)
        base = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else sizes
        row, place, length = (np.full(len(sizes), v, np.int64) for v in (self.last_row, self.last_place, 0))
        for back in range(1, int(sizes.max(initial=0)) + 1):
            who = np.flatnonzero(sizes >= back)
            symbol = flat[base[who] + sizes[who] - back].astype(np.int64)
            r, j, size = row[who], place[who], length[who]
            run = np.searchsorted(self.run_start, r, side="right") - 1
            wrong = np.flatnonzero(self.run_symbol[run] != symbol)
            if len(wrong):
                at = np.searchsorted(self.symbol_runs, symbol[wrong] * (len(self.run_start) + 1) + run[wrong])
                below, above = np.maximum(at - 1, 0), np.minimum(at, len(self.by_symbol) - 1)
                down, up = self.by_symbol[below], self.by_symbol[above]
                has_down = (at > 0) & (self.run_symbol[down] == symbol[wrong])
                has_up = (at < len(self.by_symbol)) & (self.run_symbol[up] == symbol[wrong])
                most = int(size[wrong].max(initial=0))
                with_down = np.where(has_down, np.minimum(self.common(j[wrong], self.sample_last[down], most), size[wrong]), -1)
                with_up = np.where(has_up, np.minimum(self.common(j[wrong], self.sample_first[up], most), size[wrong]), -1)
                lower = with_down >= with_up
                run[wrong] = np.where(lower, down, up)
                r[wrong] = np.where(lower, self.run_end[down], self.run_start[up])
                j[wrong] = np.where(lower, self.sample_last[down], self.sample_first[up])
                size[wrong] = np.maximum(with_down, with_up)
            known = size >= 0
            r = np.where(known, self.run_target[run] + r - self.run_start[run], self.last_row)
            j = np.where(known, np.where(j == 0, self.n, j) - 1, self.last_place)
            size = np.where(known, size + 1, 0)
            row[who], place[who], length[who] = r, j, size
            yield who, sizes[who] - back, r, j, size

    def first_place(self, row: np.ndarray) -> np.ndarray:
        """The smallest place whose window equals that of a row's suffix."""
        return self.earliest[np.searchsorted(self.interval, row, side="right") - 1]


def repeated_windows(texts: list[np.ndarray], order: np.ndarray, start: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(block, first window, last window) of windows of the blocks that also start earlier.

    ``order`` ranks the documents of the blocks and ``start`` is where a block begins in its document.
    """
    by = np.lexsort((start, order))
    spaced = [np.r_[texts[k].astype(np.int32), np.int32(256)] for k in by]
    begin = np.r_[0, np.cumsum([len(t) for t in spaced])]
    index = RunLengthIndex(np.concatenate(spaced), least)
    marked = []
    for who, at, row, place, length in index.matching_statistics([texts[k].astype(np.int64) for k in by]):
        long = np.flatnonzero(length >= least)
        if not len(long):
            continue
        who, at, first = who[long], at[long], index.first_place(row[long])
        other = np.searchsorted(begin, first, side="right") - 1
        a, b = by[other], by[who]
        there, here = start[a] + first - begin[other], start[b] + at
        earlier = (order[a] < order[b]) | ((order[a] == order[b]) & (there < here))
        marked.append(np.stack([b[earlier], here[earlier]], axis=1))
    if not marked:
        return []
    rows = np.concatenate(marked)
    if not len(rows):
        return []
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    new = np.r_[True, (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(rows)] - 1
    return list(zip(rows[first, 0].tolist(), rows[first, 1].tolist(), rows[last, 1].tolist()))


def ranks(ids: pa.Array) -> np.ndarray:
    """Dense ranks of ids of any type, null last."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    return pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)


def sketched(source: DataFrame) -> np.ndarray:
    """How often each short string occurs, at most, over all texts."""
    def run(batches):
        often = sketch.empty()
        for batch in batches:
            for _, _, data, _ in text_chunks(batch, "text"):
                if len(data) >= ANCHOR:
                    sketch.add(often, rolling(data, (ANCHOR,))[0])
        yield pa.RecordBatch.from_arrays(list(sketch.as_slices(often)), names=["slice", "counts"])

    return sketch.total(source.select("text").mapInArrow(run, "slice int, counts binary"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, n_bytes, spans (start and end of each removed run) and kept (the remaining bytes) of every row."""
    id_type = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(sketched(source))
    row_type = T.StructType([
        T.StructField("anchor", T.LongType()), T.StructField("block", T.LongType()), T.StructField("id", id_type),
        T.StructField("text_hash", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()),
        T.StructField("known", T.BooleanType()),  # all windows from first to last also start earlier
        T.StructField("itself", T.BooleanType())])  # windows of the block may repeat each other

    def find(batches):
        for batch in batches:
            parts = []
            for i, j, data, offsets in text_chunks(batch, "text"):
                doc, *rest = blocks(data, offsets, shared.value, least)
                parts.append((doc + i, *rest))
            if not parts:
                continue
            doc, first, last, anchor, name, itself = (np.concatenate(x) for x in zip(*parts))
            rank = ranks(batch.column("id"))[doc]
            order = np.lexsort((first, rank, name, anchor))
            doc, first, last, anchor, name, itself, rank = (x[order] for x in (doc, first, last, anchor, name, itself, rank))
            yield as_rows(anchor, name, doc, batch, first, last, later_equals(anchor, name, rank, first), itself)

    def as_rows(anchor, name, doc, batch, first, last, known, itself):
        rows = batch.select(["id", "text_hash"]).take(pa.array(doc))
        return pa.RecordBatch.from_arrays([
            pa.array(anchor), pa.array(name), rows.column("id"), rows.column("text_hash"), pa.array(first, pa.int32()),
            pa.array(last, pa.int32()), pa.array(known), pa.array(itself)], names=row_type.names)

    def later_equals(anchor, name, rank, first):
        """Of sorted rows: those that an equal block precedes, at a smaller (id, start)."""
        if not len(anchor):
            return np.zeros(0, bool)
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1])]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        return (rank != rank[head]) | (first != first[head])

    def settle(batches):
        for table in in_runs(batches, "anchor"):
            table = table.combine_chunks()
            anchor, name, first = (table.column(c).to_numpy() for c in ("anchor", "block", "first"))
            known, itself = table.column("known").to_numpy(), table.column("itself").to_numpy()
            later = later_equals(anchor, name, ranks(table.column("id")), first)
            begins = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            sizes = np.diff(np.r_[begins, len(anchor)])
            kinds = np.add.reduceat(np.r_[True, name[1:] != name[:-1]] | (np.r_[True, anchor[1:] != anchor[:-1]]), begins, dtype=np.int64)
            open_ = (np.repeat(kinds > 1, sizes) | itself) & ~later & ~known
            known = known | later
            keep = known | open_
            yield from table.set_column(6, "known", pa.array(known)).filter(pa.array(keep)).combine_chunks().to_batches()

    # Rows that are settled only pass, so they are dealt out evenly; a common anchor leaves few others.
    found = source.mapInArrow(find, row_type).repartition(F.when(F.col("known"), F.xxhash64("id", "first")).otherwise(F.col("anchor")))
    found = found.sortWithinPartitions("anchor", "block", F.col("id").asc_nulls_last(), "first")
    settled = stored(found.mapInArrow(settle, row_type), "blocks")

    def cut(batches):
        for batch in batches:
            data, offsets = text_buffer(batch, "text")
            doc, anchor, first, raw = [], [], [], []
            for k, wanted in enumerate(batch.column("wanted").to_pylist()):
                for w in wanted:
                    doc.append(k)
                    anchor.append(w["anchor"])
                    first.append(w["first"])
                    raw.append(data[offsets[k] + w["first"] : offsets[k] + w["last"] + least].tobytes())
            rows = batch.select(["id", "text_hash"]).take(pa.array(doc, pa.int64()))
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor, pa.int64()), rows.column("id"), rows.column("text_hash"), pa.array(first, pa.int32()), pa.array(raw, pa.binary())],
                names=["anchor", "id", "text_hash", "first", "bytes"])

    span_type = T.StructType([row_type["id"], row_type["text_hash"], row_type["first"], row_type["last"]])

    def match(batches):
        for table in in_runs(batches, "anchor"):
            table = table.combine_chunks()
            texts = [np.frombuffer(x.as_py(), np.uint8) for x in table.column("bytes")]
            marked = repeated_windows(texts, ranks(table.column("id")), table.column("first").to_numpy().astype(np.int64), least)
            rows = table.select(["id", "text_hash"]).take(pa.array([k for k, _, _ in marked], pa.int64())).combine_chunks()
            for part in rows.append_column("first", pa.array([a for _, a, _ in marked], pa.int32())).append_column(
                    "last", pa.array([b for _, _, b in marked], pa.int32())).to_batches():
                yield part

    wanted = settled.where("NOT known").groupBy("id", "text_hash").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("wanted"))
    a, b = source.alias("a"), wanted.alias("b")
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    texts = a.join(b, same).select("a.id", "a.text_hash", "a.text", "b.wanted").mapInArrow(cut, T.StructType([
        row_type["anchor"], row_type["id"], row_type["text_hash"], row_type["first"], T.StructField("bytes", T.BinaryType())]))
    matched = texts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(match, span_type)
    spans = settled.where("known").select("id", "text_hash", "first", "last").unionByName(matched)
    gone = spans.groupBy("id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("gone")).alias("b")

    def keep(batches):
        for batch in batches:
            data, offsets = text_buffer(batch, "text")
            out, kept = [], []
            for k, found_ in enumerate(batch.column("gone")):
                own = data[offsets[k] : offsets[k + 1]]
                if not found_.is_valid:
                    out.append([])
                    kept.append(own.tobytes())
                    continue
                change = np.zeros(len(own) + 1, np.int64)
                np.add.at(change, pc.struct_field(found_.values, "first").to_numpy(), 1)
                np.add.at(change, pc.struct_field(found_.values, "last").to_numpy() + least, -1)
                gone_ = np.cumsum(change)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.r_[False, gone_, False].astype(np.int8)))
                out.append([{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())])
                kept.append(own[~gone_].tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(np.diff(offsets)), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "spans", "kept"])

    return a.join(gone, same, "left").select("a.id", "a.text", "b.gone").mapInArrow(keep, T.StructType([
        T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.BinaryType())]))
