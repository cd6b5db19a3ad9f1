"""Token-id files: Arrow IPC files of fixed-size-list batches, three for each range of documents.

``part-N.tokens.arrow`` holds the token stream of a range of documents cut into
sequences of equal length: column ``ids`` is a fixed-size list of unsigned
integers.  All batches but the last have the same number of rows, so sequence i
lies in batch i // rows at row i % rows, and a memory-mapped file gives it
without a copy.  ``part-N.masks.arrow`` has the masks, fixed-size lists of bytes:
that of all sequences but the last, which is all ones, and that of the last one,
zero over its padding; equal masks are kept once, and a sequence's is a view too.  ``part-N.docs.arrow`` lists the documents of the range
with the place of each in that stream.

Ranges are made by ``repartitionByRange`` on the document id and, so that rows
with one id aren't one range, the beginning of the text; only one range is in a
task at a time.  A task writes under a name of its own attempt and renames at the
end; what lost attempts of this write leave is deleted after the others have
ended, and no other file is touched.  ``manifest.json`` is written last and names
the files that count: a folder without it hasn't been written to the end.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, partitions, scratch, text_or_empty
from .tokens import encoder, word_bpe_path

SEQUENCE = 4096
BATCH_ROWS = 64
END_ID = 2

#: The file that names the others.
NAME = "manifest.json"
MANIFEST = "shard int, tokens_file string, docs_file string, n_docs long, n_tokens long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address as Spark writes it: some of its schemes have other names here."""
    scheme, colon, rest = uri.partition(":")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + colon + rest)


class ShardWriter:
    """Writes one pair of files; ids arrive document by document."""

    def __init__(self, folder: str, shard: int, attempt: int, vocabulary: int, sequence: int = SEQUENCE, write: str = "one"):
        self.fs, self.root = _store(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.names = [f"part-{shard:07d}-{write}.{kind}.arrow" for kind in ("masks", "tokens", "docs")]
        self.own = [f"{self.root}/.{name}.{attempt}" for name in self.names]
        self.kind = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")
        self.sequence, self.left, self.total, self.docs = sequence, bytearray(), 0, 0
        self.schema, self.masks = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), sequence))]), pa.schema([("mask", pa.list_(pa.uint8(), sequence))])
        self.sinks = [self.fs.open_output_stream(name) for name in self.own]
        self.files = [pa.ipc.new_file(sink, schema) for sink, schema in zip(self.sinks, (self.masks, self.schema, DOCS), strict=True)]
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.rows.append((doc_id, self.total, n))
        self.left += np.frombuffer(ids, "<u4").astype(self.kind).tobytes()
        self.total, self.docs = self.total + n, self.docs + 1
        whole = self.sequence * BATCH_ROWS * self.kind.itemsize
        while len(self.left) >= whole:
            self._batch(bytes(self.left[:whole]))
            del self.left[:whole]
        if len(self.rows) >= 4096:
            self._docs()

    def _batch(self, packed: bytes) -> None:
        ids = np.frombuffer(packed, self.kind)
        rows = -(-len(ids) // self.sequence)
        full = np.zeros(rows * self.sequence, self.kind)
        full[: len(ids)] = ids
        self.files[1].write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(full), self.sequence)], schema=self.schema))

    def _docs(self) -> None:
        if self.rows:
            self.files[2].write_batch(pa.record_batch([pa.array(x, t) for x, t in zip(zip(*self.rows, strict=True), DOCS.types, strict=True)], schema=DOCS))
            self.rows = []

    def close(self) -> list[str]:
        if self.left:
            self._batch(bytes(self.left))
        self._docs()
        masks = np.ones(2 * self.sequence, np.uint8)
        masks[self.sequence + (self.total - 1) % self.sequence + 1 :] = 0  # the last sequence has one id at least
        self.files[0].write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(masks), self.sequence)], schema=self.masks))
        for x in (*self.files, *self.sinks):
            x.close()
        for own, name in zip(self.own, self.names, strict=True):
            self.fs.move(own, f"{self.root}/{name}")
        return self.names[1:]


def masks_file(tokens_file: str) -> str:
    """The file of the masks of a file of tokens."""
    return tokens_file.replace(".tokens.", ".masks.")


class ShardReader:
    """Random access to the files of one range."""

    def __init__(self, folder: str, tokens_file: str, docs_file: str):
        fs, root = _store(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        open_ = (lambda name: pa.memory_map(f"{root}/{name}")) if local else (lambda name: fs.open_input_file(f"{root}/{name}"))
        self.tokens, self.docs, masks = (pa.ipc.open_file(open_(name)) for name in (tokens_file, docs_file, masks_file(tokens_file)))
        self.masks = masks.get_batch(0)["mask"].flatten().to_numpy()
        batches = self.tokens.num_record_batches
        self.sequences = (batches - 1) * BATCH_ROWS + self.tokens.get_batch(batches - 1).num_rows if batches else 0
        self.length = self.tokens.schema.field("ids").type.list_size
        self._last: tuple[int, np.ndarray] | None = None

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i, both views of the file."""
        batch, row = self.tokens.get_batch(i // BATCH_ROWS), i % BATCH_ROWS
        at = slice(row * self.length, (row + 1) * self.length)
        own = int(i == self.sequences - 1)
        return batch["ids"].flatten().to_numpy()[at], self.masks[own * self.length : (own + 1) * self.length]

    def ids(self, start: int, length: int) -> np.ndarray:
        """The ids at any place of the token stream."""
        per, out = BATCH_ROWS * self.length, []
        while length > 0:
            if self._last is None or self._last[0] != start // per:  # documents in a row lie in one batch
                self._last = start // per, self.tokens.get_batch(start // per)["ids"].flatten().to_numpy()
            flat = self._last[1]
            out.append(flat[start % per : start % per + length])
            start, length = start + len(out[-1]), length - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate([np.empty(0, "<u4"), *out])

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        for k in range(self.docs.num_record_batches):
            yield from zip(*(c.to_pylist() for c in self.docs.get_batch(k).columns), strict=True)


def manifest_of(folder: str) -> list[tuple] | None:
    """The rows of a folder's manifest, or nothing where no write has ended."""
    store, root = _store(folder)
    if store.get_file_info(f"{root}/{NAME}").type != pafs.FileType.File:
        return None
    with store.open_input_stream(f"{root}/{NAME}") as f:
        return [tuple(row) for row in json.loads(f.read())["ranges"]]


def open_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder, a row for each range; an error where no write has ended."""
    rows = manifest_of(folder)
    if rows is None:
        raise FileNotFoundError(f"{folder} has no {NAME}")
    return spark.createDataFrame(rows, MANIFEST)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = END_ID, sequence: int = SEQUENCE, replace: bool = False) -> DataFrame:
    """Write the files of ``docs(doc_id, text)`` in ascending doc_id order and return their manifest, a row for each range.

    Null text counts as empty (one id, the end); null doc_ids come first; rows
    that repeat a doc_id are ordered by text; an empty table gives a manifest
    without ranges.  Other columns are ignored.

    A folder that has a manifest is an error, or with ``replace`` its manifest
    goes first and the files that it names go last.  Files that neither this
    write nor that manifest made stay, hidden ones too.
    """
    path, name = tokenizer_path or word_bpe_path(), uuid.uuid4().hex[:12]
    end = end_id.to_bytes(4, "little")
    store, root = _store(folder)
    before = manifest_of(folder)
    if before is not None:
        if not replace:
            raise FileExistsError(f"{folder} has a {NAME} already")
        store.delete_file(f"{root}/{NAME}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, code, task = None, encoder(path), TaskContext.get()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                if writer is None:
                    writer = ShardWriter(folder, task.partitionId(), task.taskAttemptId(), code.vocabulary, sequence, name)
                writer.add(doc_id, code.encode(text.as_py()) + end)
        if writer:
            tokens_file, docs_file = writer.close()
            yield pa.record_batch([pa.array([x], t) for x, t in ((task.partitionId(), pa.int32()), (tokens_file, pa.string()), (docs_file, pa.string()), (writer.docs, pa.int64()), (writer.total, pa.int64()))], names=["shard", "tokens_file", "docs_file", "n_docs", "n_tokens"])

    spark = docs.sparkSession
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).repartitionByRange(partitions(spark), F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    manifest = sorted(tuple(r) for r in ranged.transform(in_arrow, write, MANIFEST).collect())  # a row for each range
    for found in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if found.base_name.startswith(".part-") and f"-{name}." in found.base_name:
            store.delete_file(found.path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/.{NAME}.{name}") as f:
        f.write(json.dumps({"sequence": sequence, "ranges": manifest}).encode())
    store.move(f"{root}/.{NAME}.{name}", f"{root}/{NAME}")
    for file in (x for row in before or () for x in (masks_file(row[1]), *row[1:3])):
        if store.get_file_info(f"{root}/{file}").type == pafs.FileType.File:
            store.delete_file(f"{root}/{file}")
    return spark.createDataFrame(manifest, MANIFEST)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Read every document back from the files: doc_id, its place among all ids, its number of ids, their CRC-32.

    The places of the ranges are summed up from the manifest, which has a row for each range.
    """
    rows, base, total = sorted(manifest.collect()), [], 0
    for x in rows:
        base.append((*x, total))
        total += x.n_tokens
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader, out = ShardReader(folder, row["tokens_file"], row["docs_file"]), []
                for doc_id, start, n in reader.documents():
                    out.append((doc_id, row["base"] + start, n, zlib.crc32(np.ascontiguousarray(reader.ids(start, n), "<u4"))))
                    if len(out) >= 10_000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    ranges = spark.createDataFrame(base, MANIFEST + ", base long").repartition(max(1, len(base)))
    return ranges.transform(in_arrow, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write the files to the shared folder and read every document back from them."""
    folder = scratch(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer_path), folder)
