"""N-gram Jaccard join: a blocked sparse matrix product of document by n-gram incidence, reduced to what can pass.

1. One pass over the texts gives each document the size and a 128-bit key of its set of n-word shingles, and counts shingles
   in a fixed number of hash cells over all documents. Documents with equal sets become one class, which has a number of its own
   and is represented by a text that its doc_id and hash tell (a doc_id may repeat with other texts, in other classes).
2. Shingles are ordered by the count of their cell (rare first). A pair that reaches the threshold shares a shingle among the
   first |x| - ceil(t |x|) + 1 of each, so only these incidences are shuffled into column blocks, and rows that can reach it with no other row of their column go.
3. In each block of columns, pairs must pass bounds derived from the sizes: the size ratio, the overlap still possible from
   the position of the shared shingle, and the number of cells in which parity bitmaps of both whole sets differ (at most
   their symmetric difference). A first round meets each member of a column with a few pivots of it, a second round all
   members whose components still differ, in columns where pivots did not meet everyone; so a group of near copies costs about its size, not its square. A column of more
   than BLOCK rows is dealt to blocks of about that size, and only the rows that all others must meet visit every block.
4. The whole rows of the incidence matrix are written, once, for the documents in surviving pairs. Pivots are dealt to row blocks by
   the least hash of their sets, which near copies mostly share, so a row is sent to few blocks;
   each block is multiplied with the rows that have a pair in it, streamed in batches: the product accumulates the overlap
   count of every (row, column) of block and batch, gram by gram, and cells below the least overlap that their two sizes ask
   for are discarded. So the counts are exact, in integers.
5. Links become components by large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns, partitions, small, summed, table, thrifty
from .components import components
from .shingles import mix, parts, shingle_sets

#: Cells of the shingle counts (a fixed 2 MB to broadcast, whatever the input) and the rows they travel in.
CELLS, CHUNKS = 1 << 18, 64
#: Least and most bits of a parity bitmap, as powers of two; between these as many as the set has shingles, or up to twice as many.
LEAST_BITS, MOST_BITS = 7, 16
#: Pivots that each member of a column meets in the first round.
PIVOTS = 4
#: Rows of the widest columns whose rows are compared by size and position before parity bitmaps are attached.
WIDE = 16
#: Rows of a column beyond which it is split, visitors that meet a split column's rows at a time, and how many times the mean
#: count of a cell makes its shingles hot: these are split before their columns are known.
BLOCK, VISITORS, HOT = 4096, 8192, 4
#: Pivots of a row block, pairs that one task takes for a block, and cells and increments of a product that are held at a time.
ROWS, PAIRS, CELLS_AT_ONCE = 128, 8192, 1 << 21
#: Bytes of parity bitmaps that are unpacked at a time.
PARITY_BYTES = 1 << 22

_U = np.uint64


def _cell(s: np.ndarray) -> np.ndarray:
    return (mix(s) >> _U(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _rows(schema: pa.Schema, cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _profile(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for batch in (x for whole in batches for x in parts(whole, 1)):
            sizes, k1, k2, own = [], [], [], []
            for s in shingle_sets(batch.column(1), n):
                m = mix(s + _U(0x51ED270B))
                sizes.append(len(s))
                k1.append(_signed(int(m.sum(dtype=np.uint64))))
                k2.append(_signed(int(np.bitwise_xor.reduce(m * (m >> _U(7) | _U(1))) if len(m) else 0)))
                own.append(s)
            if own:
                cells += np.bincount(_cell(np.concatenate(own)), minlength=CELLS).astype(np.uint32)
            yield _rows(schema, [batch.column(0), batch.column(2), sizes, k1, k2, [None] * len(sizes), [None] * len(sizes)])
        if cells.any():
            yield _rows(schema, [[None] * CHUNKS] * 5 + [list(range(CHUNKS)), [x.tobytes() for x in np.split(cells, CHUNKS)]])

    return run


def _sum_counts(t: pa.Table) -> pa.Table:
    total = np.zeros(CELLS // CHUNKS, np.uint64)
    for x in t.column("counts").to_pylist():
        total += np.frombuffer(x, np.uint32 if len(x) < total.nbytes else np.uint64)  # a task's counts, or sums of them
    return pa.table({"chunk": t.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _needed(num: int, den: int, a, b):
    """The least overlap of sets of sizes a and b whose Jaccard similarity is num / den at least."""
    return -(-num * (a + b) // (num + den))


def _prefixes(n: int, num: int, den: int, counts):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("grams", pa.list_(pa.int64())), ("hot", pa.list_(pa.bool_())), ("parity", pa.binary()), ("low", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        much = HOT * order.mean() + BLOCK
        for batch in (x for whole in batches for x in parts(whole, 1)):
            grams, parity, low = [], [], []
            for s in shingle_sets(batch.column(1), n):
                keep = len(s) + num * len(s) // -den + 1 if len(s) else 0
                first = s[np.lexsort((s, order[_cell(s)]))[:keep]]
                width = 1 << min(MOST_BITS, max(LEAST_BITS, len(s).bit_length()))
                bits = np.bincount((mix(s + _U(3)) & _U(width - 1)).astype(np.int64), minlength=width) & 1
                grams.append(first.view(np.int64))
                low.append(_signed(int(s[0])) if len(s) else None)
                parity.append(np.packbits(bits.astype(np.uint8)).tobytes())
            ends = np.cumsum([0, *map(len, grams)])
            flat = np.concatenate(grams) if grams else np.empty(0, np.int64)
            listed = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(flat, pa.int64()), pa.array(order[_cell(flat.view(np.uint64))] > much, pa.bool_()))]
            yield _rows(schema, [batch.column(0), batch.column(2), *listed, parity, low])

    return run


def _starts(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Where each column (equal gram and salt) starts in sorted rows."""
    gram, salt = (t.column(c).to_numpy() for c in ("gram", "salt"))
    return np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])]) if len(gram) else np.empty(0, np.int64)


def _drop_lone(num: int, den: int):
    """Drops the rows that no other row of their column can reach the threshold with, by size and position alone.

    Marks the rows of columns in which pivots do not meet every member (more). Columns up to WIDE rows are compared in full, row by row shifts; of wider ones, and of hot grams, every row stays and streams through.
    """

    def some(t: pa.Table, wide: bool) -> pa.Table:
        """What stays of whole columns, or (wide) of a part of one."""
        if wide or not t.num_rows:
            return t.append_column("more", pa.array(np.ones(t.num_rows, bool)))
        starts = _starts(t)
        size = np.diff(np.r_[starts, t.num_rows])
        column = np.repeat(np.arange(len(starts)), size)
        keep = np.repeat(size > WIDE, size) | t.column("hot").to_numpy()
        n, pos = t.column("n").to_numpy(), t.column("pos").to_numpy()
        whole, found = keep.copy(), np.zeros(len(keep), bool)
        for k in range(1, min(WIDE + 1, int(size.max()))):
            x = np.flatnonzero((column[k:] == column[:-k]) & ~whole[k:])
            a, b = n[x], n[x + k]
            need = _needed(num, den, a, b)
            x = x[(np.minimum(a - pos[x], b - pos[x + k]) >= need) & (np.minimum(a, b) >= need)]
            found[x] = found[x + k] = True
        return t.append_column("more", pa.array(np.repeat(size > PIVOTS + 1, size) | whole)).filter(pa.array(keep | found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wide = None, False  # the rows of the last column so far; whether it has been found wide and is passed on
        last = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            if wide:
                same = (t.column("gram").to_numpy() == last[0]) & (t.column("salt").to_numpy() == last[1])
                passed = int(same.sum())  # sorted, so these come first
                yield from some(t.slice(0, passed), True).to_batches()
                t = t.slice(passed)
                wide = passed == batch.num_rows
                if wide:
                    continue
            if held is not None:
                t = pa.concat_tables([held, t])
            cut = int(_starts(t)[-1])
            yield from (b for b in some(t.slice(0, cut), False).to_batches() if b.num_rows)
            held = t.slice(cut)
            if held.num_rows > WIDE:
                last = held.column("gram")[0].as_py(), held.column("salt")[0].as_py()
                yield from some(held, True).to_batches()
                held, wide = None, True
        if held is not None:
            yield from (b for b in some(held, False).to_batches() if b.num_rows)

    return run


def _in_parts(t: pa.Table, starts: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole columns in runs of about PARITY_BYTES of bitmaps (one column at least): long texts have wide bitmaps in each of many rows."""
    ends = np.r_[starts[1:], t.num_rows]
    upto = np.cumsum(pc.binary_length(t.column("parity")).to_numpy().astype(np.int64))[ends - 1]
    cuts = (np.flatnonzero(np.diff((upto - 1) // PARITY_BYTES)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(starts)], strict=True):
        yield t.slice(int(starts[a]), int(ends[b - 1] - starts[a])), starts[a:b] - starts[a], ends[a:b] - starts[a]


def _by_column(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Columns from rows sorted by gram, salt and away: whole ones, or of one with many visitors its own rows with some of them at a time."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        t = t if held is None else pa.concat_tables([held, t])
        starts = _starts(t)
        cut = int(starts[-1])
        if cut:
            yield from _in_parts(t.slice(0, cut), starts[:-1])
        held = t.slice(cut)
        away = int(held.column("away").to_numpy().sum())
        if away > VISITORS:
            yield held, np.array([0]), np.array([held.num_rows])
            held = held.slice(0, held.num_rows - away)
    if held is not None and held.num_rows:
        yield held, np.array([0]), np.array([held.num_rows])


class _Bitmaps:
    """Parity bitmaps of different widths: a wide one folds to half its width by XOR of its halves, as cells are hashes' low bits."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        self.width = np.array([8 * len(r) for r in raw])
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _folded(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The bitmaps of this width or wider at this width, and where each row's is."""
        if width not in self.at:
            found, place, done = [], np.full(len(self.raw), -1), 0
            for own in np.unique(self.width[self.width >= width]).tolist():
                rows = np.flatnonzero(self.width == own)
                bits = np.frombuffer(b"".join(self.raw[i] for i in rows.tolist()), np.uint64).reshape(len(rows), -1)
                while bits.shape[1] * 64 > width:
                    half = bits.shape[1] // 2
                    bits = bits[:, :half] ^ bits[:, half:]
                found.append(bits)
                place[rows] = np.arange(done, done + len(rows))
                done += len(rows)
            self.at[width] = np.concatenate(found), place
        return self.at[width]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many cells the bitmaps of rows x and y differ: at most their sets' symmetric difference."""
        out = np.zeros(len(x), np.int64)
        width = np.minimum(self.width[x], self.width[y])
        for w in np.unique(width).tolist():
            bits, place = self._folded(w)
            own = np.flatnonzero(width == w)
            for k in range(0, len(own), step := max(1, CELLS_AT_ONCE // w * 64)):
                part = own[k : k + step]
                out[part] = np.bitwise_count(bits[place[x[part]]] ^ bits[place[y[part]]]).sum(axis=1)
        return out


_PAIRS = pa.schema([("i", pa.int64()), ("j", pa.int64())])


def _candidates(num: int, den: int, pivots: int | None):
    """Pairs of a column that pass the bounds and whose labels differ: members with pivots, or (None) all members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in _by_column(batches):
            doc, label, n, pos, away = (t.column(c).to_numpy() for c in ("doc", "label", "n", "pos", "away"))
            gram = t.column("gram").to_numpy().view(np.uint64)
            bits = _Bitmaps(t.column("parity").to_pylist())
            left, right, many = [], [], 0

            def passing(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                a, b = n[x], n[y]  # noqa: B023
                need = _needed(num, den, a, b)
                ok = (label[x] != label[y]) & ~(away[x] & away[y]) & (np.minimum(a - pos[x], b - pos[y]) >= need) & (np.minimum(a, b) >= need)  # noqa: B023
                x, y, least = x[ok], y[ok], (a + b - 2 * need)[ok]
                ok = bits.apart(x, y) <= least  # noqa: B023
                return x[ok], y[ok]

            size = ends - starts
            if pivots:
                column = np.repeat(np.arange(len(starts)), size)
                order = np.lexsort((mix(doc.view(np.uint64) ^ mix(gram)), ~away, column))  # visitors are pivots first
                found = []
                for k in range(pivots):
                    has = size > k + 1
                    pivot = order[np.where(has, starts + k, 0)]
                    member = np.flatnonzero(np.repeat(has, size) & (np.arange(len(doc)) - np.repeat(starts, size) > k))
                    found.append(passing(pivot[column[member]], order[member]))
                left, right = [x for x, _ in found], [y for _, y in found]
            else:
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    own = label[a:b]
                    if (own == own[0]).all():
                        continue
                    by = a + np.argsort(n[a:b], kind="stable")
                    sizes = n[by]
                    names, which, times = np.unique(label[by], return_inverse=True, return_counts=True)
                    rest = np.flatnonzero(which != times.argmax())  # every pair across components has one member here
                    for r in rest.tolist():
                        lo = int(np.searchsorted(sizes, -(-num * sizes[r] // den)))
                        hi = int(np.searchsorted(sizes, den * sizes[r] // num, "right"))
                        x, y = passing(np.full(hi - lo, by[r]), by[lo:hi])
                        if len(x):
                            left.append(x)
                            right.append(y)
                            many += len(x)
            if left and sum(map(len, left)):
                x, y = doc[np.concatenate(left)], doc[np.concatenate(right)]
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                for k in range(0, len(both), 100_000):
                    yield _rows(_PAIRS, [both[k : k + 100_000, 0], both[k : k + 100_000, 1]])

    return run


def _sets(n: int):
    schema = pa.schema([("class", pa.int64()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in parts(whole, 1)):
            yield _rows(schema, [batch.column(0), [s.tobytes() for s in shingle_sets(batch.column(1), n)]])

    return run


class _RowBlock:
    """Some rows of the incidence matrix by gram, and what the product with other rows has linked them with."""

    def __init__(self, rows: dict[int, np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.id, self.n = np.array(list(rows)), np.array([len(g) for g in rows.values()])
        flat, row = np.concatenate(list(rows.values())), np.repeat(np.arange(len(rows)), self.n)
        order = np.argsort(flat, kind="stable")
        self.row = row[order]
        self.gram, self.first, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        self.parent = list(range(len(rows)))

    def product(self, others: list[np.ndarray]) -> np.ndarray:
        """Overlap counts, others x rows of the block: for each gram of the others, one for each row of the block that has it."""
        flat, other = np.concatenate(others), np.repeat(np.arange(len(others)), [len(g) for g in others])
        at = np.searchsorted(self.gram, flat)
        at[at == len(self.gram)] = 0
        hit = self.gram[at] == flat
        at, other = at[hit], other[hit]
        times = self.times[at]
        upto = np.cumsum(times)
        counts = np.zeros(len(others) * len(self.id), np.int64)
        k = 0
        while k < len(at):
            stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + CELLS_AT_ONCE, "right")))
            t = times[k:stop]
            inner = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
            counts += np.bincount(np.repeat(other[k:stop], t) * len(self.id) + self.row[np.repeat(self.first[at[k:stop]], t) + inner], minlength=len(counts))
            k = stop
        return counts.reshape(len(others), -1)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def links(self, ids: list[int], others: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links of the others with rows of the block, without those that links found before already imply."""
        overlap, sizes = self.product(others), np.array([len(g) for g in others])
        who = np.array(ids)
        linked = (overlap > 0) & (overlap >= _needed(self.num, self.den, sizes[:, None], self.n[None, :])) & (who[:, None] != self.id[None, :])
        out, last = [], None
        for o, i in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
            if o != last:
                out.append((ids[o], int(self.id[i])))
                last, top = o, self.root(i)
            elif (own := self.root(i)) != top:
                self.parent[own] = top
                out.append((ids[o], int(self.id[i])))
        return out


def _multiply(num: int, den: int):
    """Rows sorted by block: its own first (of these, last the ones it is also multiplied with), then the others it is multiplied with."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, both, block, ids, others, held, out = None, {}, [], None, [], [], 0, []

        def drain() -> None:
            nonlocal both, block, ids, others, held
            if own and (both or ids):
                block = block or _RowBlock(own, num, den)
                for doc in both:
                    out.extend(block.links([doc], [own[doc]]))
                if ids:
                    out.extend(block.links(ids, others))
            both, ids, others, held = [], [], [], 0

        for batch in batches:
            for blk, salt, role, doc, grams in zip(*(batch.column(c).to_pylist() for c in ("blk", "salt", "role", "doc", "grams")), strict=True):
                if (blk, salt) != key:
                    drain()
                    key, own, both, block = (blk, salt), {}, [], None
                row = np.frombuffer(grams, np.uint64)
                if role < 2:
                    own[doc] = row
                    if role:
                        both.append(doc)
                    continue
                ids.append(doc)
                others.append(row)
                held += len(row)
                if held >= CELLS_AT_ONCE // 4 or len(ids) * len(own) >= CELLS_AT_ONCE:
                    drain()
            if len(out) >= 50_000:
                yield _rows(schema, list(zip(*out, strict=True)))
                out = []
        drain()
        if out:
            yield _rows(schema, list(zip(*out, strict=True)))

    return run


def _dealt(pairs: DataFrame, lows: DataFrame, scratch: Scratch) -> DataFrame:
    """(blk, salt, doc, role): the rows of each block (the pairs' i; role 0), what it is multiplied with (their j; 2), and what is both (1).

    Rows whose sets have the same least hash go to one block, or to several of about ROWS rows; as near copies mostly agree in it,
    most rows visit a single block, their own. What visits a block is dealt to groups of bounded size.
    """
    blocks = max(partitions(pairs.sparkSession), -(-pairs.select("i").distinct().count() // ROWS))
    owners = pairs.select("i").distinct().join(lows.select("class", "low"), F.col("i") == F.col("class")).select(F.col("i").alias("owner"), "low")
    sizes = owners.groupBy(F.col("low").alias("of")).agg(F.ceil(F.count("*") / ROWS).cast("int").alias("cuts"))
    owners = owners.join(sizes, F.col("low") == F.col("of")).select("owner", F.pmod(F.xxhash64("low", F.pmod(F.xxhash64("owner"), F.col("cuts"))), F.lit(blocks)).cast("int").alias("blk"))
    pairs = pairs.join(owners, F.col("i") == F.col("owner")).select("blk", "i", "j")
    salts = pairs.groupBy(F.col("blk").alias("b")).agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("salts"))
    pairs = pairs.join(small(scratch.table(salts, "salts")), F.col("blk") == F.col("b")).withColumn("salt", F.pmod(F.xxhash64("j"), F.col("salts")).cast("int"))
    roles = pairs.select("blk", "salt", F.col("i").alias("doc"), F.lit(0).alias("role")).union(pairs.select("blk", "salt", "j", F.lit(2)))
    return scratch.table(roles.groupBy("blk", "salt", "doc").agg(F.avg(F.col("role")).alias("role")).withColumn("role", F.when(F.col("role") == 0, 0).when(F.col("role") == 2, 2).otherwise(1)), "dealt")


def _links(sets: DataFrame, dealt: DataFrame, num: int, den: int) -> DataFrame:
    """Links of classes that join what the dealt pairs of classes join whose whole sets reach the threshold."""
    rows = sets.join(small(dealt), F.col("doc") == F.col("class")).select("blk", "salt", "role", "doc", "grams")
    rows = rows.repartition(partitions(sets.sparkSession), "blk", "salt").sortWithinPartitions("blk", "salt", "role")
    return rows.mapInArrow(thrifty(_multiply(num, den)), "src long, dst long")


def jaccard_classes(documents: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """Link documents whose sets of n-word shingles have a Jaccard similarity of threshold (a fraction) at least.

    Returns doc_id, n_shingles (set size) and component_id (smallest doc_id reachable by links, itself included), one row
    per row of documents. A text of fewer words is one shingle; null texts and texts without words have none and link with
    nothing. Equal sets always link. Rows that repeat a doc_id count as documents of their own. A row with a null doc_id links
    like any other but names no component: one of null ids alone has a null component_id. An empty table gives no rows; other columns of documents are ignored.
    """
    return jaccard_groups(documents, n, threshold).select("doc_id", "n_shingles", "component_id")


def jaccard_groups(documents: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """What jaccard_classes returns, with text_hash and component (a number of the component's own, null where a row links with
    nothing by its nature): components whose smallest doc_id is the same are told apart by it, and rows of one doc_id by text_hash."""
    num, den = threshold
    spark, scratch = documents.sparkSession, Scratch()
    docs = columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    profile = table(docs.mapInArrow(thrifty(_profile(n)), "doc_id long, text_hash long, n long, k1 long, k2 long, chunk int, counts binary"), "profile")
    cells = np.zeros(CELLS, np.uint64)
    for chunk, counts in summed(profile.where("chunk is not null").select("chunk", "counts"), "chunk", _sum_counts).collect():
        cells[chunk * (CELLS // CHUNKS) : (chunk + 1) * (CELLS // CHUNKS)] = np.frombuffer(counts, np.uint64)
    sets = profile.where("chunk is null").select("doc_id", "text_hash", "n", "k1", "k2")
    classes = sets.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("rep_hash"))
    classes = table(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    reps = classes.select("class", "rep", "rep_hash", F.col("n").alias("n_rep"), F.xxhash64("rep", "rep_hash").alias("tag"))
    # joined on one long, whose hash table is lean, and then compared
    apart = F.coalesce(F.col("doc_id").bitwiseXOR(F.col("rep")), F.lit(0)).bitwiseOR(F.col("text_hash").bitwiseXOR(F.col("rep_hash")))
    is_rep = (F.xxhash64("doc_id", "text_hash") == F.col("tag")) & (apart == 0)
    repeated = not sets.where("n > 0").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()  # rows that agree in id and text

    counts = spark.sparkContext.broadcast(cells)
    prefix = docs.mapInArrow(thrifty(_prefixes(n, num, den, counts)), "doc_id long, text_hash long, grams array<long>, hot array<boolean>, parity binary, low long")
    prefix = prefix.join(small(reps), is_rep).select("class", "n_rep", "grams", "hot", "parity", "low")
    prefix = scratch.table(prefix.dropDuplicates(["class"]) if repeated else prefix, "prefix")
    rows = prefix.select("class", F.col("n_rep").alias("n"), F.posexplode(F.arrays_zip("grams", "hot")).alias("pos", "g"))
    salt = F.when(F.col("g.hot"), F.pmod(F.xxhash64("class"), F.lit(partitions(spark)))).otherwise(0).cast("int")
    rows = rows.select(F.col("g.grams").alias("gram"), salt.alias("salt"), F.col("class").alias("doc"), "n", F.col("pos").cast("long").alias("pos"), F.col("g.hot").alias("hot"))
    rows = rows.repartition(partitions(spark), "gram", "salt").sortWithinPartitions("gram", "salt")
    shared = scratch.table(rows.mapInArrow(thrifty(_drop_lone(num, den)), "gram long, salt int, doc long, n long, pos long, hot boolean, more boolean").drop("salt", "hot"), "columns")
    parity, lows = prefix.select(F.col("class").alias("id"), "parity"), prefix.select("class", "low")

    def whole(ids: DataFrame) -> DataFrame:
        """The whole sets of these classes."""
        asked = scratch.table(ids.distinct().join(reps, F.col("id") == F.col("class")).select("class", "rep", "rep_hash", "tag"), "asked")
        found = docs.join(small(asked), is_rep).select("class", "text").mapInArrow(thrifty(_sets(n)), "class long, grams binary")
        return scratch.table(found.dropDuplicates(["class"]) if repeated else found, "whole")

    large = scratch.table(shared.groupBy(F.col("gram").alias("__gram")).agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("doc", "gram"), "doc")).alias("first")).where(F.col("size") > BLOCK), "large")

    def met(labels: DataFrame | None, pivots: int | None) -> DataFrame:
        """Pairs to verify. The rows of a large column are dealt to blocks; the one that all must meet visits every block: in the
        first round the column's first row, in the second whatever is not of the column's most frequent component."""
        grams = shared.withColumn("label", F.col("doc")) if labels is None else shared.where("more").join(labels.select(F.col("id").alias("lid"), "component"), F.col("doc") == F.col("lid"), "left").withColumn("label", F.coalesce("component", "doc")).drop("lid", "component")
        hot = large.select("__gram", "size", F.col("first.doc").alias("key"))
        if labels is not None:
            often = grams.join(small(large.select("__gram")), F.col("gram") == F.col("__gram"), "left_semi").groupBy("gram", "label").count()
            often = often.groupBy(F.col("gram").alias("__gram")).agg(F.max_by("label", F.struct("count", "label")).alias("key"), F.sum("count").alias("size"))
            hot = often
        grams = grams.join(small(scratch.table(hot, "hot")), F.col("gram") == F.col("__gram"), "left")
        blocks = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
        visits = F.col("size").isNotNull() & ((F.col("doc") == F.col("key")) if labels is None else (F.col("label") != F.col("key")))
        grams = grams.withColumn("home", F.pmod(F.xxhash64("doc"), blocks).cast("int"))
        grams = grams.withColumn("salt", F.explode(F.when(visits, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("home"))))
        grams = grams.withColumn("away", F.col("salt") != F.col("home")).join(parity, F.col("doc") == F.col("id"))
        grams = grams.select("gram", "salt", "away", "doc", "label", "n", "pos", "parity").repartition(partitions(spark), "gram", "salt").sortWithinPartitions("gram", "salt", "away")
        return scratch.table(grams.mapInArrow(thrifty(_candidates(num, den, pivots)), "i long, j long").distinct(), "pairs")

    dealt = _dealt(met(None, PIVOTS), lows, scratch)
    rows = whole(dealt.select(F.col("doc").alias("id")))
    links = scratch.table(_links(rows, dealt, num, den), "links")
    labels = components(links)
    scratch.tables.append(labels)
    dealt = _dealt(met(labels, None), lows, scratch)
    rows = rows.union(whole(dealt.select(F.col("doc").alias("id")).join(rows, F.col("id") == F.col("class"), "left_anti")))
    links = scratch.table(links.union(_links(rows, dealt, num, den)), "links")
    labels = components(links).join(reps.select("class", "rep"), F.col("id") == F.col("class")).select("id", "component", "rep")
    least = table(labels.groupBy(F.col("component").alias("of")).agg(F.min("rep").alias("least")), "least")
    scratch.clear()
    labels = labels.drop("rep").join(small(least), F.col("component") == F.col("of")).select("id", "component", "least")
    named = classes.join(labels, F.col("class") == F.col("id"), "left")
    named = named.select(F.col("n").alias("cn"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.coalesce("component", "class").alias("component"), F.coalesce("least", "rep").alias("least"))
    found = sets.join(named, (F.col("n") == F.col("cn")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    return found.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
