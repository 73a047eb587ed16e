"""Token files: ids of documents in doc_id order, coded by rANS with one frequency table.

A file is a table of blocks in the shared folder, which any Spark storage can hold: `part` (the range
of doc_ids), `block` (its number in the part), `docs` (doc_ids and sizes of its documents, packed) and
`payload` (the coded ids). Blocks hold whole documents and stand for themselves, so readers share the
work block by block, and inside a block segment by segment.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.common import parts, row_hash, settled, stored, utf8
from cliploom.llm.rans import Coder, frequencies
from cliploom.llm.words import encoder, ended, id_kind, packed, slices

#: Ids to a block, more only where one document has more.
BLOCK = 1 << 20
_NULL = -(1 << 63)


def encoded(docs: DataFrame, path: str, end: int, vocabulary: int) -> DataFrame:
    """(doc_id, salt, ids binary) of every document, encoded where it is read and written.

    Texts go through the tokenizer once and are never shuffled; what is ordered later are ids of 2
    bytes (4 for vocabularies over 65,536). salt tells rows of one doc_id apart by their text.
    """
    kind = id_kind(vocabulary)

    def run(batches):
        for batch in batches:
            at = 0
            for texts in slices(batch.column(2)):
                ids, size = ended(*encoder(path).encode(texts), end)
                own = [c.slice(at, len(texts)) for c in batch.columns[:2]]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*own, packed(ids.astype(kind), size)], names=["doc_id", "salt", "ids"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("salt"), utf8().alias("t"))
    return stored(given.mapInArrow(run, "doc_id long, salt long, ids binary"), "encoded", compression="zstd")


def id_counts(plain: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents; the result is as long as the vocabulary."""
    kind = id_kind(vocabulary)

    def count(batches):
        seen = np.zeros(vocabulary, np.int64)
        for batch in batches:
            seen += np.bincount(_flat(batch.column(0), kind), minlength=vocabulary)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(seen[found])], names=["id", "n"])

    total = plain.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(vocabulary, np.int64)
    for r in total.collect():  # one row for each id of the vocabulary at most
        out[r["id"]] = r["n"]
    return out


def _flat(ids: pa.Array, kind: str) -> np.ndarray:
    """The ids of a binary column, one row after another."""
    offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    if not len(ids) or offsets[0] == offsets[-1]:
        return np.zeros(0, kind)
    return np.frombuffer(ids.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)


def write(plain: DataFrame, freq: np.ndarray) -> DataFrame:
    """The token file (part, block, docs, payload): documents in ascending doc_id order, cut in blocks of
    whole documents, every block coded with the shared table; written."""
    kind = id_kind(len(freq))
    # null doc_ids and repeated ones are spread by their salt
    ordered = plain.repartitionByRange(parts(plain), "doc_id", "salt").sortWithinPartitions("doc_id", "salt")

    def run(batches):
        coder = Coder(freq)
        part, block = TaskContext.get().partitionId(), 0
        doc_ids, sizes, held, n = [], [], [], 0

        def flush():
            nonlocal block, n
            names = zlib.compress(np.concatenate([*doc_ids, *sizes]).astype("<i8").tobytes(), 1)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([names], pa.binary()),
                    pa.array([coder.encode(np.concatenate(held))], pa.binary()),
                ],
                names=["part", "block", "docs", "payload"],
            )
            block, n = block + 1, 0
            doc_ids.clear(), sizes.clear(), held.clear()
            return row

        for batch in batches:
            own = batch.column(0).fill_null(_NULL).to_numpy()
            size = pc.binary_length(batch.column(2)).to_numpy().astype(np.int64) // np.dtype(kind).itemsize
            ids = _flat(batch.column(2), kind)
            ends = np.cumsum(size)
            at = 0
            while at < len(own):
                base = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, base + BLOCK - n, side="right"))
                if to == at and n:
                    yield flush()
                    continue
                to = max(to, at + 1)
                doc_ids.append(own[at:to])
                sizes.append(size[at:to])
                held.append(ids[base : int(ends[to - 1])].copy())
                n += int(ends[to - 1]) - base
                at = to
        if n:
            yield flush()

    return stored(
        ordered.mapInArrow(run, "part int, block int, docs binary, payload binary"), "token-file", compression="none"
    )


def read(blocks: DataFrame, freq: np.ndarray, with_ids: bool = False) -> DataFrame:
    """(part, doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the blocks.

    start counts within the part; documents() adds the parts before. Damaged blocks raise.
    """

    def run(batches):
        coder = Coder(freq)
        for batch in batches:
            for part, block, packed, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, size = np.frombuffer(zlib.decompress(packed), "<i8").reshape(2, -1)
                ids = coder.decode(payload).astype("<u4")
                ends = np.cumsum(size)
                raw, at = memoryview(ids.tobytes()), [0, *(4 * ends).tolist()]
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
                columns = [
                    pa.array(np.full(len(own), part, np.int32)),
                    pa.array(np.full(len(own), block, np.int32)),
                    pa.array(own.copy(), mask=own == _NULL),
                    pa.array(ends - size),
                    pa.array(size.copy()),
                    pa.array(np.array(crc, np.int64)),
                ]
                names = ["part", "block", "doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a // 4 : b // 4].tolist() for a, b in zip(at, at[1:], strict=False)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "part int, block int, doc_id long, start long, n_tokens long, ids_crc32 long"
    # a few blocks to a task: decoding, not reading, is the work
    return blocks.select("part", "block", "docs", "payload").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def documents(found: DataFrame) -> DataFrame:
    """Adds the ids of all earlier blocks to start; drops part and block.

    The sums run over one row per block, a millionth of the ids; parts first, then blocks in a part.
    """
    per = found.groupBy("part", "block").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("in_part", F.coalesce(F.sum("n").over(before), F.lit(0)))
    whole = per.groupBy("part").agg(F.sum("n").alias("all"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("offset"))
    offset = per.join(whole, "part").select("part", "block", (F.col("offset") + F.col("in_part")).alias("_before"))
    return (
        found.join(offset, ["part", "block"])
        .withColumn("start", F.col("start") + F.col("_before"))
        .drop("part", "block", "_before")
    )


def token_ids(docs: DataFrame, path: str, end: int = 1, vocabulary: int = 49_408) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, read back from the written file.

    Null and empty texts have the end id alone; null doc_ids come first and stay null; repeated rows
    are documents like others, in any order among equals; an empty table gives no rows.
    """

    def made() -> DataFrame:
        plain = encoded(docs.select("doc_id", "text"), path, end, vocabulary)
        freq = frequencies(id_counts(plain, vocabulary))
        return read(write(plain, freq), freq)

    return documents(settled(docs.sparkSession, made, "token-rows")).select("doc_id", "start", "n_tokens", "ids_crc32")
