"""MinHash near-duplicates by SuperMinHash signatures, banding and exact verification.

SuperMinHash gives element ``i`` of a set a random permutation of the registers and
lets it offer ``r + rank`` at each register; a register keeps its least offer. Ranks
of one element are distinct, so registers are negatively correlated and the estimate
varies less than MinHash's. Offers are made rank by rank; as soon as every register
holds less than the next rank, no later offer can win and a set is done.

The operator: (1) documents with equal shingle sets form one class; (2) class
representatives get a signature and 32 bands of 4 registers, which miss a pair at
similarity 0.8 with probability 5e-8; (3) representatives that meet in a band are
compared by their signatures, one byte a register, and those that agree in at least
72 of 128 places are linked as candidates (a pair at 0.8 falls short of that with
probability 1e-10, a pair at 0.4 reaches it with 1e-4), so groups of candidates do not
grow together through bands that unlike texts share by chance. First each is compared with
the least of its bucket, which links most near copies; then, in buckets that this
leaves in several parts, all pairs of different parts are compared; (4) inside a group of
candidates all sets are compared exactly, in blocks of bounded size; (5) exact links give
the components.

Copies cost nothing after step 1. Buckets and groups are never gathered whole: their
members are dealt to blocks and each task holds two. Blocks of step 4 are cut by set size and
bounded in documents and in shingles; pairs of blocks whose sizes cannot reach the
threshold are skipped. Shingles are told apart by 64-bit hashes of mixed words.

Defined results: null and empty texts, and texts without words, have an empty set, are
linked with nothing and are kept. Rows that repeat an id are one document as to
components (any of their links is its link). A null id gets no component and is
kept. Empty input gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import meetings
from quire.llm import textkit as tk
from quire.llm.common import Scratch, free_name, give_back
from quire.llm.graph import components

REGISTERS = 128
BANDS = 32
#: Places in which the signatures of candidates agree: 6.7 deviations below what a pair at 0.8 has.
AGREE = 72
#: Documents of a bucket, and shingles of a group, in a block; a task holds one or two blocks.
BUCKET_BLOCK, BLOCK_ELEMENTS = 4096, 1 << 18
#: Shingles that a document counts for at least, so a block of a group has about 1,024 documents at most.
LEAST_ELEMENTS = 256
#: Shingles held by more documents of a task are counted by a matrix product, others pair by pair.
OFTEN, COLUMNS = 8, 1024
U64 = np.uint64
_STEP = tk.LANE[0]
#: Elements whose permutations are held at once; memory is this times REGISTERS bytes.
WAVE = 1 << 14


def _random(seed: np.ndarray, step: int) -> np.ndarray:
    """The ``step``-th random number of the stream of each element."""
    with np.errstate(over="ignore"):
        return tk.mix(seed + U64(step + 1) * _STEP)


def signatures(elements: np.ndarray, at: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """SuperMinHash values of many sets; set ``i`` holds ``elements[at[i]:at[i + 1]]``.

    Rows of empty sets are infinite. Values are doubles: rank plus a fraction.
    """
    n = len(at) - 1
    out = np.full((n, registers), np.inf)
    size = np.diff(at)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + WAVE, "right")) - 1)
        for a in range(at[i], max(at[j], at[i] + 1), WAVE):  # one large set takes several waves
            b = min(a + WAVE, at[j])
            if b > a:
                owner = np.repeat(np.arange(i, j), size[i:j])[a - at[i] : b - at[i]]
                _wave(elements[a:b], owner, out, registers)
        i = j
    return out


def _wave(elements: np.ndarray, owner: np.ndarray, out: np.ndarray, registers: int) -> None:
    rows = np.unique(owner)
    order = np.tile(np.arange(registers, dtype=np.uint8 if registers <= 256 else np.uint16), (len(elements), 1))
    live = np.arange(len(elements))
    for rank in range(registers):
        worst = out[rows].max(axis=1)
        done = worst < rank
        if done.all():
            return
        if done.any():
            keep = ~np.isin(owner[live], rows[done])
            live, rows = live[keep], rows[~done]
        h = _random(elements[live], rank)
        swap = rank + (h >> U64(40)).astype(np.int64) % (registers - rank)
        picked = order[live, swap]
        order[live, swap] = order[live, rank]
        value = rank + (h & U64((1 << 40) - 1)).astype(np.float64) / float(1 << 40)
        np.minimum.at(out, (owner[live], picked), value)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each set and band."""
    n, registers = sig.shape
    rows = registers // bands
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(n, bands, rows)
    h = np.zeros((n, bands), np.uint64)
    for k in range(rows):
        h = tk.mix(h * tk.LANE[1] + bits[:, :, k] * tk.LANE[k + 2])
    return tk.mix(h + np.arange(bands, dtype=np.uint64) * tk.LANE[40])


def short_signatures(sig: np.ndarray) -> np.ndarray:
    """A byte for each register; registers that differ agree by chance once in 256 times."""
    return (tk.mix(np.ascontiguousarray(sig).view(np.uint64)) >> U64(56)).astype(np.uint8)


def shingle_sets(piece: tk.Piece, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row; a row of fewer words has its whole sequence as one."""
    w = tk.words(piece, tk.SPACED)
    h, begin = tk.windows(w, size)
    row = tk.row_of(w.at, begin)
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    for r in short.tolist():
        own = w.hash[w.at[r] : w.at[r + 1]]
        h = np.append(h, tk.mix((own * tk.LANE[: len(own)]).sum(dtype=np.uint64) + U64(len(own))))
        row = np.append(row, r)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    return h, np.searchsorted(row, np.arange(len(piece) + 1))


def _set_key(elements: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return struct.pack("<QQ", int(tk.mix(elements).sum(dtype=np.uint64)), int(tk.mix(elements ^ tk.LANE[5]).sum(dtype=np.uint64)))


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """``id, n_shingles, set_key, bands, signature`` (a byte a register) of every row of ``docs`` (id, text)."""

    def run(batches):
        for batch in batches:
            first = 0
            for piece in tk.pieces(batch.column(1)):
                h, at = shingle_sets(piece, size)
                keys = [_set_key(h[a:b]) if b > a else None for a, b in itertools.pairwise(at.tolist())]
                sig = signatures(h, at)
                bands = band_keys(sig).reshape(-1).view(np.int64)
                short = pa.Array.from_buffers(pa.binary(REGISTERS), len(sig), [None, pa.py_buffer(short_signatures(sig).tobytes())]).cast(pa.binary())
                ends = pa.array(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(piece)), pa.array(np.diff(at), pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(bands)), short], ["id", "n_shingles", "set_key", "bands", "signature"])
                first += len(piece)
        give_back()

    return docs.mapInArrow(run, "id long, n_shingles long, set_key binary, bands array<long>, signature binary")


def _packed(docs: DataFrame) -> DataFrame:
    """``id, packed``: the texts compressed, since all of them are shuffled once."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else pack(t) for t in texts], pa.binary())], ["id", "packed"])

    return docs.mapInArrow(run, "id long, packed binary")


def _members(found: DataFrame, size: int) -> DataFrame:
    """``rep, tasks, set_key, elements`` of documents (id, packed, tasks)."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            first = 0
            for piece in tk.pieces(pa.array([unpack(t) for t in batch.column(1).to_pylist()], pa.large_binary())):
                h, at = shingle_sets(piece, size)
                sets = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
                keys = [_set_key(h[a:b]) if b > a else None for a, b in itertools.pairwise(at.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(piece)), batch.column(2).slice(first, len(piece)), pa.array(keys, pa.binary()), sets], ["rep", "tasks", "set_key", "elements"])
                first += len(piece)
        give_back()

    return found.select("id", "packed", "tasks").mapInArrow(run, "rep long, tasks array<struct<task:string,side:int>>, set_key binary, elements array<long>")


def _bytes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _near_least(met: DataFrame) -> DataFrame:
    """``a, b``: members of buckets (rep, homes, signature) and the least of their bucket where their signatures agree."""

    def run(batches):
        for batch in batches:
            near = (_bytes(batch.column(2)) == _bytes(batch.column(3))).sum(axis=1) >= AGREE
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], ["a", "b"])

    pairs = met.select("rep", "signature", F.explode(F.array_distinct(F.transform("homes", lambda h: h.least))).alias("least")).filter("rep != least")
    both = pairs.join(met.select(F.col("rep").alias("least"), F.col("signature").alias("other")).hint("merge"), "least")
    return both.select("rep", "least", "signature", "other").mapInArrow(run, "a long, b long")


def _candidates(met: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b``: links of members of one bucket whose signatures agree, enough of them to join what belongs together."""

    def run(batches):
        for table in meetings.chunks(batches):
            rep, part, sig = table.column("rep").to_numpy(), table.column("part").to_numpy(), _bytes(table.column("signature"))
            found = [(np.zeros(0, int),) * 2]
            for i, j in meetings.pairs(table):
                apart = part[i] != part[j]
                i, j = i[apart], j[apart]
                alike = (sig[i] == sig[j]).sum(axis=1) >= AGREE
                found.append(meetings.stars(i[alike], j[alike]))
            x, y = meetings.stars(*(np.concatenate(f) for f in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[x], pa.int64()), pa.array(rep[y], pa.int64())], ["a", "b"])

    near = scratch.put(_near_least(met), "near")
    parts = components(near, scratch, "near-parts").select(F.col("node").alias("rep"), F.col("component").alias("part"))
    each = scratch.put(meetings.each_home(met.join(parts, "rep", "left").select("rep", "homes", "signature", F.coalesce("part", "rep").alias("part"))).drop("homes"), "each")
    several = each.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("bucket")
    rest = each.join(scratch.put(several, "several").hint("merge"), "bucket")
    across = meetings.deal(rest, BUCKET_BLOCK).select("rep", "part", "signature", *meetings.TASK, "side").mapInArrow(run, "a long, b long")
    return near.union(scratch.put(across, "across"))


def _shared(flat: np.ndarray, size: np.ndarray, split: int = 0) -> np.ndarray:
    """How many elements each two of the sets have in common: rows and columns are all sets (split 0; the diagonal is left out), or those before and from ``split``."""
    n = len(size)
    row = np.repeat(np.arange(n), size)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    row, times = row[order], count[inverse[order]]
    left, right = (slice(0, split), slice(split, n)) if split else (slice(0, n),) * 2
    common = np.zeros((left.stop, right.stop - right.start), np.int32)
    # Shingles of many sets: columns of a 0/1 matrix.
    often = times > OFTEN
    if often.any():
        column = np.cumsum(np.concatenate(([0], np.diff(inverse[order][often]) != 0)))
        own = row[often]
        for a in range(0, int(column[-1]) + 1, COLUMNS):
            lo, hi = np.searchsorted(column, (a, a + COLUMNS))
            dense = np.zeros((n, COLUMNS), np.float32)
            dense[own[lo:hi], column[lo:hi] - a] = 1
            for top in range(0, left.stop, 512):
                rows = slice(top, min(top + 512, left.stop))
                common[rows] += (dense[rows] @ dense[right].T).astype(np.int32)
    # Shingles of few: each with those after it; rows of a shingle are in order.
    for c in range(2, OFTEN + 1):
        own = row[times == c].reshape(-1, c)
        for x in range(c):
            for y in range(x + 1, c):
                a, b = own[:, x], own[:, y]
                if split:
                    across = (a < split) & (b >= split)
                    a, b = a[across], b[across]
                np.add.at(common, (a, b - right.start), 1)
                if not split:
                    np.add.at(common, (b, a), 1)
    return common


def _compare(flat: np.ndarray, size: np.ndarray, split: int, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links among sets (split 0), or between those before and those from ``split``, as stars over the sets' numbers."""
    common = _shared(flat, size, split)
    columns = np.arange(split, len(size))
    found = []
    for a in range(0, len(common), 256):
        here = common[a : a + 256].astype(np.int64)
        union = size[a : a + len(here), None] + size[None, columns] - here
        i, j = np.nonzero(here * threshold[1] >= union * threshold[0])
        i, j = i + a, columns[j]
        found.append(np.stack((i[i < j], j[i < j])))
    i, j = np.concatenate(found, axis=1)
    return meetings.stars(i, j)


def _links(members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links inside candidate groups, as stars. ``members``: task (one or two blocks), side, rep, elements."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("rep", "ascending")])
        reps = table.column("rep").to_numpy()
        side = table.column("side").to_numpy()
        lists = table.column("elements").combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        split = int(np.searchsorted(side, 1)) if side[0] == 0 else 0
        whole = side[0] == 2 and len(reps) > 1
        x, y = _compare(lists.flatten().to_numpy(), size, split, threshold) if whole or 0 < split < len(reps) else (np.zeros(0, int),) * 2
        return pa.table({"a": pa.array(reps[x], pa.int64()), "b": pa.array(reps[y], pa.int64())})

    return members.groupBy("task").applyInArrow(run, "a long, b long")


def _deal(groups: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``rep, tasks``: the tasks, of one block or of two whose set sizes allow links, that compare a member.

    ``groups`` has group, rep and n. Blocks hold about BLOCK_ELEMENTS shingles in order of
    set size, a document counting for LEAST_ELEMENTS at least. They are cut by a histogram over set sizes, so a large group is never
    sorted in one task; members of one size are dealt to its blocks by hash.
    """
    bins = groups.groupBy("group", "n").agg(F.count(F.lit(1)).alias("c"))
    running = Window.partitionBy("group").orderBy("n")
    mass = F.col("c") * F.greatest(F.col("n"), F.lit(LEAST_ELEMENTS))
    bins = bins.withColumn("before", F.sum(mass).over(running) - mass)
    bins = bins.select("group", "n", F.floor(F.col("before") / BLOCK_ELEMENTS).alias("first"), F.greatest(F.lit(1), F.ceil(mass / BLOCK_ELEMENTS)).alias("spans"))
    placed = groups.join(bins, ["group", "n"]).select("group", "rep", "n", (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("spans"))).alias("block"))
    bounds = placed.groupBy("group", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    p, q = bounds.alias("p"), bounds.alias("q")
    fits = (F.col("p.group") == F.col("q.group")) & (F.col("p.block") < F.col("q.block")) & (F.col("p.hi") * threshold[1] >= F.col("q.lo") * threshold[0])
    pairs = p.join(q, fits).select(F.col("p.group").alias("group"), F.col("p.block").alias("x"), F.col("q.block").alias("y"))
    tasks = bounds.select("group", F.col("block").alias("x"), F.col("block").alias("y")).union(pairs).withColumn("task", F.concat_ws("-", "group", "x", "y"))
    first = tasks.select("group", F.col("x").alias("block"), F.struct("task", F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side")).alias("t"))
    second = tasks.filter("x != y").select("group", F.col("y").alias("block"), F.struct("task", F.lit(1).alias("side")).alias("t"))
    dealt = first.union(second).groupBy("group", "block").agg(F.collect_list("t").alias("tasks"))
    return placed.join(dealt, ["group", "block"]).select("rep", "tasks")


def near_duplicates(docs: DataFrame, *, size: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` for each row; threshold: similarity of at least its quotient."""
    scratch = Scratch(docs.sparkSession, "superminhash")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = scratch.put(_sketches(docs, size), "sketches")
    narrow = sketches.select("id", "n_shingles", "set_key")
    known = sketches.filter("set_key is not null and id is not null")
    # Equal sets form a class; only the row with its least id goes on.
    classes = scratch.put(known.groupBy("set_key").agg(F.min_by(F.struct("id", "n_shingles", "bands", "signature"), "id").alias("r")).select("set_key", "r.*"), "classes")
    keys = classes.select(F.col("id").alias("rep"), F.posexplode("bands").alias("place", "key"))
    met = scratch.put(meetings.homes(keys, scratch).join(classes.select(F.col("id").alias("rep"), "signature").hint("merge"), "rep"), "met")
    groups = components(_candidates(met, scratch), scratch, "candidates").withColumnRenamed("node", "rep").withColumnRenamed("component", "group")
    groups = scratch.put(groups.join(classes.select(F.col("id").alias("rep"), F.col("n_shingles").alias("n")), "rep"), "groups")
    tasks = scratch.put(_deal(groups, threshold), "tasks")
    # A merge join at every size: a table of tasks that is small here would be broadcast, one that grows could not.
    found = _packed(docs.filter("id is not null and text is not null")).join(tasks.withColumnRenamed("rep", "id").hint("merge"), "id")
    repeats = _has_repeats(known)
    members = _members(found, size).dropDuplicates(["rep", "set_key"]) if repeats else _members(found, size)
    links = _links(members.select("rep", "elements", F.explode("tasks").alias("t")).select("rep", "elements", "t.*"), threshold)
    same = known.join(classes.select("set_key", F.col("id").alias("rep")), "set_key").filter("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    edges = scratch.put(links.union(same) if repeats else links, "links")
    parts = components(edges, scratch, "parts")
    of_class = classes.select("set_key", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    joined = narrow.join(of_class, "set_key", "left")
    return joined.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def _has_repeats(known: DataFrame) -> bool:
    """Whether an id stands for several rows."""
    return bool(known.groupBy("id").count().filter("count > 1").limit(1).count())


def digest(docs: DataFrame, *, size: int = 4, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query's contract."""
    found = near_duplicates(docs, size=size, id_col=id_col)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, *, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, in its own columns, without all but one document of each component."""
    found = near_duplicates(docs, size=size, id_col=id_col, text_col=text_col)
    name = free_name(docs, "_gone")
    gone = found.filter("id != component_id").select(F.col("id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")


#: The contract in plain SQL, for tables whose doc_id is unique and not null.
ORACLE_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM doc, unnest(range(1, greatest(1, len(w) - 3) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT doc.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id, doc.doc_id = r.component_id AS kept
FROM doc LEFT JOIN n ON n.doc_id = doc.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = doc.doc_id
"""
