"""Token-ID output in training order.

Texts become token ids of a public byte-level BPE, each document closed by an end
token, laid end to end within an input partition and cut into sequences of fixed
length; only the last sequence of a partition is padded, with the end token. The
dense number of a sequence (partition, then place) goes through a keyed Feistel
permutation, whose cycle-walking keeps it below the number of sequences: that is the
sequence's global slot. Slots go in order to shards of a fixed number of sequences;
each range partition holds one or more whole shards (MAX_PARTITIONS partitions at most), so
slot ``s`` lies in shard ``s // per_shard`` at byte ``(s % per_shard) * stride`` and a reader
resumes at any slot by arithmetic. ``write`` writes the shards as files and returns what it
read back of them; shards that are whole already are not written again.

Defined results: null and empty texts write nothing; repeated rows are written as
often as they stand; empty tables give no rows and no shards; other columns are not
read. The slot of a sequence depends on the key, the number of sequences and the
order of the input's partitions, all of which stay the same when a task is run again.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import Scratch, broadcast_if_small, give_back

#: Fixed values of the public vocabulary: how its text is cut before merging, and the free id after its last.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LENGTH = 2048
PER_SHARD = 4096
KEY = 0x51A5_0F1E_57E1
ROUNDS = 6
#: Sequences that are compressed together until they are dealt to shards, and how hard zstd tries.
GROUP, LEVEL = 16, 6
MAX_PARTITIONS = 20_000
HEAD = "slot long, shard int, offset long, n_tokens int, doc_ids array<long>"
_ENCODERS: dict[str, object] = {}


def load_vocabulary(path: str) -> bytes:
    """The vocabulary file, read on the driver; it is sent to the executors (under 1 MB)."""
    with open(path, "rb") as file:
        return file.read()


def encoder(vocabulary: bytes):
    """The tokenizer, built once in a process."""
    name = hashlib.sha256(vocabulary).hexdigest()
    if name not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def feistel(index: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of ``range(total)``, applied to ``index``."""
    if total <= 1:
        return index.astype(np.int64)
    half = max(1, ((total - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    with np.errstate(over="ignore"):
        keys = [tk.mix(np.uint64(key) + np.uint64(r + 1) * tk.LANE[r]) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (tk.mix(right + k) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(total)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _sequences(docs: DataFrame, vocabulary: bytes, length: int) -> DataFrame:
    """``part, place, n_tokens, doc_ids, packed``: runs of GROUP sequences in the order of each partition, from ``place`` on."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["part", "place", "n_tokens", "doc_ids", "packed"]
    kinds = (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64())), pa.binary())

    def run(batches):
        encode, pack = encoder(shared.value).encode_to_numpy, zstandard.ZstdCompressor(level=LEVEL).compress
        part, place = TaskContext.get().partitionId(), 0
        group = np.full((GROUP, length), END, np.uint16)
        row, fill, sizes, ids, rows = 0, 0, [], [[]], []

        def close() -> None:
            """Ends the sequence, and the group if it is full."""
            nonlocal row, fill, ids
            sizes.append(fill)
            row, fill = row + 1, 0
            if row == GROUP:
                finish()
            else:
                ids.append([])

        def finish() -> None:
            nonlocal group, row, sizes, ids, place
            rows.append((part, place, sizes, ids[:row], pack(group[:row].tobytes())))
            group[:] = END
            place, row, sizes, ids = place + row, 0, [], [[]]

        def flush() -> pa.RecordBatch:
            nonlocal rows
            done, rows = rows, []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                found, at = np.append(encode(text), END).astype(np.uint16), 0
                while at < len(found):
                    n = min(length - fill, len(found) - at)
                    group[row, fill : fill + n] = found[at : at + n]
                    ids[row].append(doc_id)
                    fill, at = fill + n, at + n
                    if fill == length:
                        close()
                        if len(rows) >= 64:
                            yield flush()
        if fill:
            close()
        if row:
            finish()
        if rows:
            yield flush()
        give_back()

    return docs.mapInArrow(run, "part int, place long, n_tokens array<int>, doc_ids array<array<long>>, packed binary")


def materialise(docs: DataFrame, *, vocabulary: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``slot, shard, offset, n_tokens, doc_ids, tokens`` of every sequence.

    ``tokens`` are ``length`` little-endian 16-bit ids. Each partition of the result
    holds whole shards in order of slot, ready for ``write_shards``.
    """
    ordered = _ordered(docs, vocabulary, length, per_shard, key, id_col, text_col)

    def unpack(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                own = batch.slice(first, 1024)
                bodies = pa.array([open_(x) for x in own.column("packed").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], bodies], [*own.schema.names[:-1], "tokens"])

    return ordered.mapInArrow(unpack, f"{HEAD}, tokens binary")


def _ordered(docs: DataFrame, vocabulary: str, length: int, per_shard: int, key: int, id_col: str, text_col: str) -> DataFrame:
    """``slot, shard, offset, n_tokens, doc_ids, packed``: the sequences, compressed, laid out as ``materialise`` has them."""
    scratch = Scratch(docs.sparkSession, "tokens")
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = scratch.put(_sequences(narrow, load_vocabulary(vocabulary), length), "sequences")
    sizes = found.groupBy("part").agg(F.sum(F.size("n_tokens")).alias("n"))
    bases = scratch.put(sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"), F.col("n").alias("here")), "bases")
    total = bases.agg(F.coalesce(F.sum("here"), F.lit(0))).first()[0]
    shards = max(1, -(-total // per_shard))
    stride = 2 * length
    together = -(-shards // MAX_PARTITIONS)

    def place(batches):
        open_, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                own = batch.slice(first, 64)
                sizes, ids = own.column("n_tokens").to_pylist(), own.column("doc_ids").to_pylist()
                index = np.concatenate([np.arange(a, a + len(n)) for a, n in zip(own.column("index").to_pylist(), sizes, strict=True)])
                slot = feistel(index, total, key)
                bodies = [pack(raw[k : k + stride]) for raw in map(open_, own.column("packed").to_pylist()) for k in range(0, len(raw), stride)]
                kinds = (pa.int32(), pa.list_(pa.int64()), pa.binary())
                flat = ([n for group in sizes for n in group], [x for group in ids for x in group], bodies)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((slot // per_shard).astype(np.int32)), pa.array(slot % per_shard * stride), *(pa.array(v, t) for v, t in zip(flat, kinds, strict=True))], ["slot", "shard", "offset", "n_tokens", "doc_ids", "packed"])

    placed = found.join(broadcast_if_small(bases, 1_000_000), "part").select((F.col("base") + F.col("place")).alias("index"), "n_tokens", "doc_ids", "packed").mapInArrow(place, f"{HEAD}, packed binary")
    return placed.repartitionById(-(-shards // together), F.floor(F.col("shard") / together).cast("int")).sortWithinPartitions("slot")


def write_shards(sequences: DataFrame, uri: str, *, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Writes shard files to the shared folder ``uri``; returns ``slot, shard, offset, n_tokens, doc_ids, tokens_sha256, shard_sha256``.

    A shard appears by renaming a finished file, so a task that is run again, or runs
    twice, leaves one whole file. A shard whose file and sidecar match is not written again.
    Hashes are of the bytes read back.
    """
    return _write(sequences.select("slot", "shard", "offset", "n_tokens", "doc_ids", "tokens"), uri, length, per_shard, False)


def _write(sequences: DataFrame, uri: str, length: int, per_shard: int, packed: bool) -> DataFrame:
    """``write_shards`` of sequences whose last column is the tokens, compressed if ``packed``."""
    kinds = {"slot": pa.int64(), "shard": pa.int32(), "offset": pa.int64(), "n_tokens": pa.int32(), "doc_ids": pa.list_(pa.int64()), "tokens_sha256": pa.string(), "shard_sha256": pa.string()}
    stride = 2 * length

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        open_ = zstandard.ZstdDecompressor().decompress

        def read(path: str) -> bytes | None:
            if fs.get_file_info(path).type != pafs.FileType.File:
                return None
            with fs.open_input_stream(path) as file:
                return file.read()

        def write(shard: int, body: bytes) -> bytes:
            name, sha = f"{root}/shard-{shard:08d}", hashlib.sha256(body).hexdigest()
            kept, note = read(f"{name}.bin"), read(f"{name}.json")
            if kept == body and note is not None and json.loads(note)["sha256"] == sha:
                return kept
            attempt = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
            for path, data in ((f"{name}.bin", body), (f"{name}.json", json.dumps({"shard": shard, "sequences": len(body) // stride, "sha256": sha}).encode())):
                with fs.open_output_stream(attempt) as out:
                    out.write(data)
                fs.move(attempt, path)
            return read(f"{name}.bin")

        def finish(rows: list[dict]) -> pa.RecordBatch:
            shard, offsets = rows[0]["shard"], [r["offset"] for r in rows]
            plain = bytearray(stride * len(rows))
            for k, r in enumerate(rows):
                body = open_(r["body"]) if packed else r["body"]
                if len(body) != stride or offsets[k] != k * stride or k >= per_shard:
                    raise ValueError(f"shard {shard} does not have the stride")
                plain[k * stride : (k + 1) * stride] = body
            body = write(shard, bytes(plain))
            sha = hashlib.sha256(body).hexdigest()
            values = {k: [r[k] for r in rows] for k in ("slot", "shard", "offset", "n_tokens", "doc_ids")}
            values |= {"tokens_sha256": [hashlib.sha256(body[a : a + stride]).hexdigest() for a in offsets], "shard_sha256": [sha] * len(rows)}
            return pa.RecordBatch.from_arrays([pa.array(values[k], t) for k, t in kinds.items()], list(kinds))

        rows: list[dict] = []
        for batch in batches:
            for row in (dict(zip(("slot", "shard", "offset", "n_tokens", "doc_ids", "body"), r, strict=True)) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if rows and rows[0]["shard"] != row["shard"]:
                    yield finish(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield finish(rows)
        rows = []
        give_back()

    return sequences.mapInArrow(run, "slot long, shard int, offset long, n_tokens int, doc_ids array<long>, tokens_sha256 string, shard_sha256 string")


def write(docs: DataFrame, uri: str | None = None, *, vocabulary: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as shard files in ``uri`` (a folder of this session's scratch if None); a row for each sequence, as of ``write_shards``."""
    uri = uri or f"{Scratch(docs.sparkSession, 'shards').root}/shards"
    return _write(_ordered(docs, vocabulary, length, per_shard, key, id_col, text_col), uri, length, per_shard, True)


def read_sequences(uri: str, first: int = 0, *, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """Sequences in slot order from slot ``first``, read shard after shard."""
    fs, root = pafs.FileSystem.from_uri(uri)
    shard, offset, stride = first // per_shard, first % per_shard * 2 * length, 2 * length
    while fs.get_file_info(path := f"{root}/shard-{shard:08d}.bin").type == pafs.FileType.File:
        with fs.open_input_file(path) as file:
            file.seek(offset)
            while body := file.read(stride):
                yield np.frombuffer(body, "<u2")
        shard, offset = shard + 1, 0


def digest(docs: DataFrame, **options) -> DataFrame:
    """Writes the shards; a row for each sequence, with the hashes of its tokens and of its shard."""
    return write(docs, **options)
