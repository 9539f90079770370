"""Embedding near-dedup by product quantisation over coarse inverted lists, with an exact cosine rerank.

Equal vectors of a label become one class first, with a number of its own. Coarse centroids and the codebooks of residual subspaces
are fitted on a bounded sample; every class is indexed: its list is that of its nearest centroid, its code quantises the residual,
and the code's error is kept. A query probes every list whose border to its own list is at most r / 2 away: of unit vectors x and y
at most r apart, in two lists, the distances to the border between these add up to r at most, so one of the two probes the
other's list (lossless). A list of a label with more than BLOCK members is divided again, by centroids of its own, so lists grow in
number with the table; there every query probes the parts whose border is at most r away (lossless, as the pair's ends are).
Per list, table-lookup distances to the codes keep the members that, given their code's error, may lie within r (this loses
none); the cosine in double precision decides. Members of a part that is still large are cut into blocks and its queries into
salted groups, so it means more tasks and not larger ones. Each pair is counted once for both ends, whichever probes the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, small, table, thrifty
from .components import components

#: Vectors to fit on, vectors of the largest label that a list should hold, lists, subspaces, codes of a subspace.
SAMPLE, PER_LIST, LISTS, SPACES, CODES = 16_384, 1024, 2048, 8, 256
#: Members of a block, and queries that one task takes to it; queries compared at a time; bytes of a sample at most.
BLOCK, QUERIES, BATCH, SAMPLE_BYTES = 4096, 50_000, 256, 1 << 26


class Index(NamedTuple):
    centroids: np.ndarray  # lists x dims
    books: np.ndarray  # spaces x codes x dims of a space

    @property
    def dims(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def borders(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """How far each vector is from the border between its home list and each other list (nil for home)."""
        return _borders(x, self.centroids, home)

    def square(self, x: np.ndarray) -> np.ndarray:
        return _squares(x, self.centroids)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each residual from what its code stands for."""
        parts = residual.reshape(len(residual), len(self.books), -1)
        codes = np.stack([np.argmin(_squares(parts[:, m], book), axis=1) for m, book in enumerate(self.books)], axis=1).astype(np.uint8)
        back = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((residual - back) ** 2).sum(axis=1))

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances from each residual's part to each code: spaces x codes x vectors."""
        parts = residual.reshape(len(residual), len(self.books), -1)
        return np.stack([_squares(book, parts[:, m]) for m, book in enumerate(self.books)])


def _borders(x: np.ndarray, centroids: np.ndarray, home: np.ndarray) -> np.ndarray:
    d = _squares(x, centroids)
    apart = np.maximum(np.sqrt(np.maximum(_squares(centroids, centroids), 0)), 1e-12)
    return (d - d[np.arange(len(x)), home][:, None]) / (2 * apart[home])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :]


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=k > len(x))].copy()
    for _ in range(rounds):
        own = np.argmin(_squares(x, centres), axis=1)
        n = np.bincount(own, minlength=k)
        for d in range(x.shape[1]):
            total = np.bincount(own, weights=x[:, d], minlength=k)
            centres[n > 0, d] = total[n > 0] / n[n > 0]
    return centres


def fit(sample: np.ndarray, vectors: int) -> Index:
    """sample: unit vectors, padded with zeros to a multiple of SPACES."""
    lists = int(min(LISTS, max(1, vectors // PER_LIST), max(1, len(sample) // 8)))
    centroids = _kmeans(sample, lists, 1)
    residual = sample - centroids[np.argmin(_squares(sample, centroids), axis=1)]
    parts = residual.reshape(len(sample), SPACES, -1)
    return Index(centroids, np.stack([_kmeans(parts[:, m], CODES, 2 + m) for m in range(SPACES)]))


def unit(vector: list[float]) -> np.ndarray:
    """The vector at length one, scaled by its largest component first."""
    x = np.array(vector, np.float64)
    x = x / np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def matrix(raw: pa.Array, dims: int) -> np.ndarray:
    """Vectors of one length from an array of their doubles, padded with zeros to dims."""
    x = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(len(raw), -1)
    return np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def _runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of rows that agree in the named columns and follow each other."""
    if not batch.num_rows:
        return
    cols = [batch.column(n) for n in names]
    change = np.zeros(batch.num_rows, bool)
    for c in cols:
        x = (c.dictionary_encode().indices if pa.types.is_string(c.type) else c).to_numpy(zero_copy_only=False)
        change[1:] |= x[1:] != x[:-1]
    cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield tuple(c[a].as_py() for c in cols), batch.slice(a, b - a)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [unit(v).tobytes() for v in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())], names=[*batch.schema.names[:-1], "raw"])


_CELL = pa.schema([("grp", pa.string()), ("list", pa.int32()), ("sub", pa.int32()), ("query", pa.bool_()), ("rep", pa.int64()), ("n", pa.int64()), ("home", pa.int32()), ("raw", pa.binary()), ("codes", pa.binary()), ("error", pa.float64())])
_CELL_DDL = "grp string, list int, sub int, query boolean, rep long, n long, home int, raw binary, codes binary, error double"


def _place(index, reach: float):
    """Each class as a member of its list and as a query to every list that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for batch in batches:
            size = pc.binary_length(batch.column("raw")).to_numpy(zero_copy_only=False)
            for long in np.unique(size).tolist():
                alike = batch.filter(pa.array(size == long))
                for b in (alike.slice(k, 512) for k in range(0, alike.num_rows, 512)):
                    x = matrix(b.column("raw"), own.dims)
                    home = np.argmin(own.square(x), axis=1)
                    codes, error = own.encode(x - own.centroids[home])
                    i, c = np.nonzero(own.borders(x, home) <= reach)
                    m, at = len(x), np.r_[np.arange(len(x)), i]
                    code = pa.array([*(y.tobytes() for y in codes), *[None] * len(i)], pa.binary())
                    where = pa.array(at)
                    yield pa.RecordBatch.from_arrays([
                        b.column("grp").take(where), pa.array(np.r_[home, c], pa.int32()), pa.array(np.zeros(len(at)), pa.int32()), pa.array(np.arange(len(at)) >= m), b.column("rep").take(where), b.column("n").take(where),
                        pa.array(home[at], pa.int32()), b.column("raw").take(where), code, pa.array(np.r_[error, np.zeros(len(i))], pa.float64(), mask=np.arange(len(at)) >= m),
                    ], schema=_CELL)

    return run


def _divide(dims: int):
    """Centroids of a long list's parts, from a sample of its members (with how many parts it should have)."""

    def run(t: pa.Table) -> pa.Table:
        x = matrix(t.column("raw").combine_chunks(), dims)
        order = np.argsort(t.column("rep").to_numpy(), kind="stable")
        centres = _kmeans(x[order], int(min(t.column("parts")[0].as_py(), max(1, len(x) // 8))), 99)
        return pa.table({"grp": t.column("grp")[:1], "list": t.column("list")[:1], "centres": pa.array([centres.tobytes()], pa.binary())})

    return run


def _replace(dims: int, reach: float):
    """Rows of long lists, each list's centroids first: members to their part, queries to every part in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = centres = None
        for batch in batches:
            for now, b in _runs(batch, ["grp", "list", "salt"]):
                if now != key:
                    key, centres = now, None
                if centres is None:
                    centres = np.frombuffer(b.column("centres")[0].as_py(), np.float64).reshape(-1, dims)
                    b = b.slice(1)
                for k in range(0, b.num_rows, 512):
                    part = b.slice(k, 512)
                    x = matrix(part.column("raw"), dims)
                    home = np.argmin(_squares(x, centres), axis=1)
                    asks = part.column("query").to_numpy(zero_copy_only=False)
                    near = _borders(x, centres, home) <= reach
                    near[~asks] = False
                    near[np.flatnonzero(~asks), home[~asks]] = True
                    at, sub = np.nonzero(near)
                    where = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(sub, pa.int32()) if f.name == "sub" else part.column(f.name).take(where) for f in _CELL], schema=_CELL)

    return run


class _Block:
    """The members of one block, and the links found from the queries that meet them."""

    def __init__(self, index: Index, least: float, reach: float, rows: list[pa.RecordBatch]):
        col = lambda name: np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in rows])
        self.index, self.least, self.reach = index, least, reach
        self.rep, self.n, self.list = col("rep"), col("n"), int(rows[0].column("list")[0].as_py())
        self.x = np.concatenate([matrix(b.column("raw"), index.dims) for b in rows])
        self.codes = np.frombuffer(b"".join(c for b in rows for c in b.column("codes").to_pylist()), np.uint8).reshape(len(self.rep), -1)
        self.within = ((np.sqrt(max(0.0, 2 - 2 * least)) + col("error")) ** 2 * (1 + 1e-4) + 1e-4).astype(np.float32)  # and what single precision may be off by
        self.borders = index.borders(self.x, np.full(len(self.rep), self.list))
        self.parent = np.arange(len(self.rep))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def meet(self, batch: pa.RecordBatch) -> list[tuple[int, int, int]]:
        """Rows (0, class, vectors linked with it) and (1, class, class linked): edges that join what the block has not joined."""
        rep, n, home = (batch.column(c).to_numpy() for c in ("rep", "n", "home"))
        q = matrix(batch.column("raw"), self.index.dims)
        lookup = self.index.tables(q - self.index.centroids[self.list]).astype(np.float32)
        near = lookup[0][self.codes[:, 0]]
        for m in range(1, len(lookup)):
            near += lookup[m][self.codes[:, m]]
        xi, qi = np.nonzero(near <= self.within[:, None])
        if len(xi) > near.size // 20:
            cos = (self.x @ q.T)[xi, qi]
        else:
            cos = np.concatenate([(q[qi[k : k + 20_000]] * self.x[xi[k : k + 20_000]]).sum(axis=1) for k in range(0, len(xi), 20_000)] or [np.empty(0)])
        keep = (cos >= self.least) & (rep[qi] != self.rep[xi])
        qi, xi = qi[keep], xi[keep]
        if not len(qi):
            return []
        out = [(0, int(rep[i]), int(w)) for i, w in enumerate(np.bincount(qi, weights=self.n[xi], minlength=len(q))) if w]
        lone = self.borders[xi, home[qi]] > self.reach  # the member does not probe the query's list: count for it here
        back = np.bincount(xi[lone], weights=n[qi[lone]], minlength=len(self.rep))
        out += [(0, int(self.rep[x]), int(back[x])) for x in np.flatnonzero(back)]
        order = np.argsort(qi, kind="stable")
        last = first = -1
        for i, x in zip(qi[order].tolist(), xi[order].tolist(), strict=True):
            if i != last:
                last, first = i, self.root(x)
                out.append((1, int(rep[i]), int(self.rep[x])))
            elif (other := self.root(x)) != first:
                self.parent[other] = first
                out.append((1, int(rep[i]), int(self.rep[x])))
        return out


def _search(index, least: float, reach: float):
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, block, out = None, [], None, []
        for batch in batches:
            for now, rows in _runs(batch, ["grp", "list", "sub", "blk", "salt"]):
                if now != key:
                    key, members, block = now, [], None
                asks = int(np.argmax(np.r_[rows.column("query").to_numpy(zero_copy_only=False), True]))  # members come first
                if asks:
                    members.append(rows.slice(0, asks))
                if not members:
                    continue
                for k in range(asks, rows.num_rows, BATCH):
                    block = block or _Block(index.value, least, reach, members)
                    out += block.meet(rows.slice(k, BATCH))
                if len(out) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _divided(placed: DataFrame, cells: DataFrame, dims: int, radius: float, scratch: Scratch) -> DataFrame:
    """placed with the long lists' rows (cells: grp, list, members, queries) in parts by centroids of the list's own."""
    spark = placed.sparkSession
    most = min(SAMPLE, SAMPLE_BYTES // (8 * dims))
    long = cells.where(F.col("members") > BLOCK).select(F.col("grp").alias("g"), F.col("list").alias("l"), "members", F.ceil((F.col("members") + F.col("queries")) / QUERIES).cast("int").alias("salts"), F.ceil(2 * F.col("members") / BLOCK).cast("int").alias("parts"))
    long = scratch.table(long, "long")
    if long.isEmpty():
        return placed
    of = (F.col("grp") == F.col("g")) & (F.col("list") == F.col("l"))
    rows = placed.join(small(long), of)
    share = F.least(F.lit(float(most)), 16.0 * F.col("parts")) / F.col("members")
    picked = rows.where(~F.col("query") & (F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1_000_003)) / 1_000_003.0 < share))
    centres = scratch.table(picked.select("grp", "list", "rep", "parts", "raw").groupBy("grp", "list").applyInArrow(_divide(dims), "grp string, list int, centres binary"), "centres")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in placed.schema if f.name not in ("grp", "list")]
    heads = centres.join(small(long), of).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("grp", "list", *nothing, "centres", "salt")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")).join(small(centres.select(F.col("grp").alias("cg"), F.col("list").alias("cl"))), (F.col("grp") == F.col("cg")) & (F.col("list") == F.col("cl")))
    rows = heads.unionByName(rows.select(*placed.columns, F.lit(None).cast("binary").alias("centres"), "salt"))
    rows = rows.repartition(partitions(spark), "grp", "list", "salt").sortWithinPartitions("grp", "list", "salt", F.col("centres").isNull())
    parts = rows.mapInArrow(thrifty(_replace(dims, radius)), _CELL_DDL)
    rest = placed.join(small(centres.select(F.col("grp").alias("cg"), F.col("list").alias("cl"))), (F.col("grp") == F.col("cg")) & (F.col("list") == F.col("cl")), "left_anti")
    return scratch.table(rest.unionByName(parts), "divided")


def near_vectors(embeddings: DataFrame, least: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """Link vectors of one label and length whose cosine is least at least.

    Returns vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable, itself included) and
    kept (vec_id = component_id), one row per row of embeddings (columns vec_id, embedding, label). Vectors or labels that are
    null, and vectors that are empty, zero, or hold null or non-finite components, link with nothing. Equal vectors of a label
    link. Rows that repeat a vec_id count as vectors of their own. A row with a null vec_id links like any other but is never kept
    and names no component: one of null ids alone has a null component_id. An empty table gives no rows. Other columns are ignored.
    """
    spark, scratch = embeddings.sparkSession, Scratch()
    vec = F.col("vec")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    good = F.col("label").isNotNull() & vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("grp", F.concat(F.col("label"), F.lit("\n"), F.size(vec)))
    keyed = rows.withColumns({"k1": F.xxhash64("grp", "vec"), "k2": F.xxhash64(F.lit(7), "vec", "grp")})
    classes = keyed.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("grp").alias("grp"), F.first("vec").alias("vec"))
    classes = classes.mapInArrow(_units, "k1 long, k2 long, least long, n long, grp string, raw binary")
    classes = table(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # rep: the class's own number

    longest = classes.agg(F.max(F.length("raw"))).first()[0]
    if longest is None:
        return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    dims = -(-(longest // 8) // SPACES) * SPACES
    sample = max(1, min(sample, SAMPLE_BYTES // (8 * dims)))
    picked = [np.frombuffer(r[0], np.float64) for r in classes.orderBy(F.xxhash64("k1", "k2"), "k1", "k2").select("raw").limit(sample).collect()]
    largest = classes.groupBy("grp").count().agg(F.max("count")).first()[0]
    fitted = fit(np.stack([np.pad(x, (0, dims - len(x))) for x in picked]), largest)
    index = spark.sparkContext.broadcast(fitted)
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)) + 1e-9)
    reach = radius / 2

    placed = scratch.table(classes.select("grp", "rep", "n", "raw").mapInArrow(thrifty(_place(index, reach)), _CELL_DDL), "placed")
    count = lambda df, *by: df.groupBy(*by).agg(F.count(F.when(~F.col("query"), 1)).alias("members"), F.count(F.when(F.col("query"), 1)).alias("queries")).where("members > 0")
    placed = _divided(placed, count(placed, "grp", "list"), dims, radius, scratch)
    sizes = count(placed, "grp", "list", "sub").select(F.col("grp").alias("g"), F.col("list").alias("l"), F.col("sub").alias("s"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blks"), F.ceil(F.col("queries") / QUERIES).cast("int").alias("salts"))
    cells = placed.join(small(scratch.table(sizes, "sizes")), (F.col("grp") == F.col("g")) & (F.col("list") == F.col("l")) & (F.col("sub") == F.col("s")))
    dealt = F.pmod(F.xxhash64("rep"), F.when(F.col("query"), F.col("salts")).otherwise(F.col("blks"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("blks")).otherwise(F.greatest("salts", F.lit(1))) - 1))
    cells = cells.withColumns({"own": dealt, "other": other}).withColumns({"blk": F.when(F.col("query"), F.col("other")).otherwise(F.col("own")), "salt": F.when(F.col("query"), F.col("own")).otherwise(F.col("other"))})
    by = ["grp", "list", "sub", "blk", "salt"]
    cells = cells.select(*by, "query", "rep", "n", "home", "raw", "codes", "error").repartition(partitions(spark), *by).sortWithinPartitions(*by, "query")
    found = table(cells.mapInArrow(thrifty(_search(index, least, reach)), "kind int, a long, b long"), "found")
    scratch.clear()

    links = found.where("kind = 0").groupBy(F.col("a").alias("linked")).agg(F.sum("b").alias("more"))
    labels = components(found.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = labels.join(classes.select("rep", F.col("least").alias("low")), F.col("id") == F.col("rep")).groupBy(F.col("component").alias("of")).agg(F.min("low").alias("first"))
    labels = labels.join(small(table(named, "named")), F.col("component") == F.col("of")).select("id", "component", "first")
    known = classes.select("k1", "k2", "rep", "n", "least").join(links, F.col("rep") == F.col("linked"), "left").join(labels, F.col("rep") == F.col("id"), "left")
    known = known.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("links"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("first")).alias("first"), F.lit(True).alias("known"))
    out = keyed.select("vec_id", "good", "k1", "k2").join(known, F.col("good") & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.when(F.col("known"), F.col("first")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
