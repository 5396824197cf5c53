"""Line deduplication with two Bloom filters.

The keys of each document's lines are read once, as digests, to a table in the
shared folder. Their hashes, 8 bytes each and packed, go to slices of the hash
space. Each slice adds them to a once-seen filter, and those that it held already
to a twice-seen filter, whose bits go to a file in the shared folder. Then tasks
map those files into memory; only digests that hit the twice-seen filter are
suspected, and only they shuffle, to be counted exactly and to choose the document
that keeps the line. Texts are read again where they are, and only documents that
lose a line meet their list of digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom, store, textkit

MIN_CHARS, MIN_DOCS = 20, 3


def _keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line, None where the line is too short to count."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(b" \t\n\x0b\x0c\r").lower()
        out.append(key if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars) else None)
    return out


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _documents(column: pa.Array) -> Iterator[bytes]:
    data, offsets = textkit.byte_column(column)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:b].tobytes()


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, keys: 16 bytes for each distinct key) of (doc_id, text) rows that have a key."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, packed, size = [], [], 0
            for i, text in enumerate(_documents(batch.column(1))):
                size += len(text)
                if found := {_digest(k) for k in _keys(text, min_chars) if k is not None}:
                    at.append(i)
                    packed.append(b"".join(found))
            textkit.release(size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(packed, pa.binary())], ["doc_id", "keys"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, keys binary")


def build_filters(keys: DataFrame, slices: int, folder: str) -> None:
    """Write the twice-seen filter of each slice that has keys to ``folder``/<slice>."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, times = np.unique(np.frombuffer(textkit.byte_column(batch.column(0))[0].tobytes(), "<u8")[::2], return_counts=True)
            where = bloom.slice_of(seen, slices)
            edge = np.searchsorted(where, np.arange(slices + 1))
            rows = [(i, seen[a:b].tobytes(), seen[a:b][times[a:b] > 1].tobytes()) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["slice", "once", "twice"])

    bloom.merge_twice(keys.select("keys").mapInArrow(hashes, "slice long, once binary, twice binary"), folder)


def suspects(keys: DataFrame, slices: int, folder: str) -> DataFrame:
    """(doc_id, digest) of the keys that the twice-seen filter holds."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.byte_column(batch.column(1))
            hit = np.flatnonzero(bloom.hits(np.frombuffer(data.tobytes(), "<u8")[::2], slices, folder))
            owner = np.repeat(np.arange(len(batch)), np.diff(offsets) // 16)[hit]
            chosen = data.reshape(-1, 16)[hit].tobytes()
            digests = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer((np.arange(len(hit) + 1) * 16).astype(np.int32)), pa.py_buffer(chosen)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), digests], ["doc_id", "digest"])

    return keys.mapInArrow(find, "doc_id long, digest binary")


def _drop(text: Column, drops: Column, min_chars: int) -> Column:
    """(text, n_lines, n_dropped) without the lines whose digest is in ``drops``."""

    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            kept, lines, dropped = [], [], []
            for text, own in zip(_documents(texts), lists):
                own = own.as_py()
                parts = text.split(b"\n")
                lines.append(len(parts))
                if own:
                    gone = set(own)
                    stay = [p for p, k in zip(parts, _keys(text, min_chars)) if k is None or _digest(k) not in gone]
                    dropped.append(len(parts) - len(stay))
                    text = b"\n".join(stay)
                else:
                    dropped.append(0)
                kept.append(text)
            yield pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])

    return F.arrow_udf(apply, "text string, n_lines long, n_dropped long")(text, drops)


def dedup_lines(docs: DataFrame, column: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``column`` less its repeated lines, and n_lines and n_dropped.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased.
    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents
    lose all lines but those of the largest doc_id that holds them. Rows of one
    doc_id are one document; a row without a doc_id is none: its lines neither
    count nor go. A null or empty text is one empty line; a text that loses all
    lines becomes empty. Digests of 128 bits stand for keys.
    """
    if clash := {"n_lines", "n_dropped"} & set(docs.columns):
        raise ValueError(f"{sorted(clash)} are columns already")
    spark, names = docs.sparkSession, docs.columns
    # The row goes along as one value, so that its other columns may have any names.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{column}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    keys = store.keep(line_keys(docs.where("doc_id IS NOT NULL"), min_chars), "line-keys")
    n = keys.agg(F.sum(F.octet_length("keys")).alias("n")).first()["n"] or 0
    slices, folder = bloom.slices_for(n // 16), store.new_folder(spark, "twice-seen")
    build_filters(keys, slices, folder)
    # (digest, doc_id) pairs are counted by digest with partial sums, so a line of a third of all documents meets no task whole.
    with store.short_rows(spark):
        pairs = store.keep(suspects(keys, slices, folder).distinct(), "suspects")
    repeated = pairs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # Written first, so that the join below has an exchange on either side and a very common line can be split.
    repeated = store.keep(repeated, "repeated")
    # Both joins are merged at every size: what is broadcast of a small table is shuffled of a large one, so costs would tell nothing.
    drops = pairs.join(repeated.hint("merge"), "digest").where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_list("digest").alias("_drops"))
    drops = store.keep(drops.select(F.col("doc_id").alias("_doc"), "_drops"), "drops")
    of = lambda c: F.unhex(F.md5(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")))
    losing, many = bloom.once(drops.select(of("_doc").alias("d")), "d")
    marked = docs.withColumn("_s", bloom.only(of("doc_id"), losing, many))
    shape = lambda df, text, lines, gone: df.select(*[text.alias(c) if c == column else F.col("row").getField(c).alias(c) for c in names], lines.alias("n_lines"), gone.alias("n_dropped"))
    text = F.coalesce("text", F.lit(""))
    lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    clean = shape(marked.where("NOT _s"), text, lines, F.lit(0).cast("long"))
    rest = marked.where("_s").join(drops.hint("merge"), F.col("doc_id") == F.col("_doc"), "left").withColumn("_d", _drop(F.col("text"), F.col("_drops"), min_chars))
    return clean.unionByName(shape(rest, F.col("_d.text"), F.col("_d.n_lines"), F.col("_d.n_dropped")))
