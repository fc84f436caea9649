"""Media columns with content-defined chunk deduplication (operator 8).

A payload is stored as a sound file of 8-bit samples (RIFF/WAVE, one channel, PCM), one sample a byte. The
stored bytes are cut where a rolling gear hash has its low bits clear, so equal stretches give equal chunks
wherever they lie. Digests of all chunks are counted; those that occur more than once make up the shared
store, which keeps each chunk's bytes once. Every medium is written as the ordered list of its chunks: the digest of
a shared one, the packed bytes of others, so only shared bytes are moved. The table is read back; shared chunks are
joined to the lists by digest; each medium is put together from its list, held against its own digest, decoded, and
its features are taken from what was read back.

Which chunks are shared is told to the writing pass by a bitmap over the digests, sized by their number up to a bound,
beyond which all chunks go by the store: a false hit moves a chunk that could have stayed, and changes no result.

Defined results: a null or empty text has a payload of 64 zero bytes; texts of any length are stored whole, one at a
time in memory; equal texts give equal values, whichever row or task they come from, so ties do not matter; repeated
rows each get their row; an empty table gives an empty result; other columns pass through by name (``keep``), but
ones with the names of the results are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .idfilter import Near, maybe_in
from .textops import BYTE_KEYS
from .workspace import materialize, release

BLOCK = 64
RATE = 8000
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
LEAST, MEAN_BITS, MOST = 256, 10, 8192
#: Chunks lie packed in the store and in the lists.
PACK, UNPACK = zstandard.ZstdCompressor(level=6, write_checksum=False), zstandard.ZstdDecompressor()
GEAR = (BYTE_KEYS >> np.uint64(32)).astype(np.uint32)


def pack(piece: bytes) -> bytes:
    return PACK.compress(piece)


def unpack(packed: pa.Buffer) -> bytes:
    return UNPACK.decompress(packed)


def payload_of(text: bytes) -> bytes:
    """The text with zero bytes appended up to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def encode_wave(payload: bytes) -> bytes:
    size = len(payload)
    return HEADER.pack(b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size) + payload


def decode_wave(media: bytes) -> bytes:
    """The samples of a file made by ``encode_wave``; raises on anything else."""
    riff, total, wave, fmt, _, kind, channels, _, _, _, bits, data, size = HEADER.unpack_from(media)
    if (riff, wave, fmt, data) != (b"RIFF", b"WAVE", b"fmt ", b"data") or (kind, channels, bits) != (1, 1, 8) or size != len(media) - HEADER.size or total != size + 36:
        raise ValueError("not a sound file of 8-bit samples")
    return media[HEADER.size :]


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks: where the gear hash of the last 32 bytes has clear low bits, at least LEAST and at most MOST apart."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    with np.errstate(over="ignore"):
        for k in (1, 2, 4, 8, 16):  # doubles the window: h[i] = sum of gear[b[i - j]] << j
            h[k:] += h[:-k] << np.uint32(k)
    marks = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    ends, at, k = [], 0, 0
    while n - at > LEAST:
        k = int(np.searchsorted(marks, at + LEAST))
        end = int(marks[k]) if k < len(marks) else n
        at = min(end, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(digest, bytes) in order."""
    at = 0
    for end in cut_points(media):
        piece = media[at:end]
        yield hashlib.sha256(piece).digest(), piece
        at = end


def _slot(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in column:
        yield bytes(text.as_buffer()) if text.is_valid else b""


def shared_chunks(docs: DataFrame, text_col: str = "text") -> Near | None:
    """A test of the slots of digests that occur more than once, of all rows; see ``maybe_in``."""

    def run(batches):
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for text in _texts(batch.column("_text")):
                counts.update(d for d, _ in chunks(encode_wave(payload_of(text))))
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"])

    counted = docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "digest binary, n bigint").groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1")
    slots = counted.select("digest").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([_slot(d) for d in b.column("digest").to_pylist()], pa.int64())], names=["id"]) for b in batches), "id bigint")
    return maybe_in(materialize(slots, "shared-slots"))


FEATURES = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_chunks bigint"


def features(media: bytes, n_bytes: int, n_chunks: int) -> tuple:
    """FEATURES of stored bytes: everything is taken from what they decode to."""
    payload = decode_wave(media)
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    feature = f"pcm8:{RATE}:{len(samples)}:sum={int(samples.sum())}:energy={int((samples * samples).sum())}:peak={int(np.abs(samples).max())}"
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, n_chunks


def _feature_arrays(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]


_FEATURE_NAMES = [x.split()[0] for x in FEATURES.split(", ")]


#: A stored medium: its number, length of the text, own digest, and the chunks in order; or, without these, a chunk for the store.
STORED = "_row bigint, _n_bytes bigint, _sha256 binary, _digests array<binary>, _parts array<binary>, _digest binary, _bytes binary"
_STORED_NAMES = [x.split()[0] for x in STORED.split(", ")]


def store_media(docs: DataFrame, shared: Near | None) -> DataFrame:
    """STORED rows, beside ``_doc``, of each row of (_doc, _text), and of each shared chunk once a task."""

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        sent: set[bytes] = set()
        for batch in batches:
            own = batch.column("_doc")
            at, rows, pieces, size = [], [], {}, 0
            for i, text in enumerate(_texts(batch.column("_text"))):
                media = encode_wave(payload_of(text))
                listed = [(d, pack(p)) for d, p in chunks(media)]
                moved = shared.test(np.array([_slot(d) for d, _ in listed], dtype=np.int64)) if shared else np.ones(len(listed), dtype=bool)
                at.append(i)
                rows.append((number, len(text), hashlib.sha256(media).digest(), [d if m else None for (d, _), m in zip(listed, moved)], [None if m else p for (_, p), m in zip(listed, moved)], None, None))
                pieces.update((d, p) for (d, p), m in zip(listed, moved) if m and d not in sent)
                number += 1
                size += len(media)
                if size > 1 << 22:
                    yield emit(own, at, rows, pieces)
                    sent.update(pieces)
                    at, rows, pieces, size = [], [], {}, 0
            if rows:
                yield emit(own, at, rows, pieces)
                sent.update(pieces)

    def emit(own, at, rows, pieces):
        rows = rows + [(None, None, None, None, None, d, p) for d, p in pieces.items()]
        taken = pa.concat_arrays([own.take(pa.array(at, pa.int64())), pa.nulls(len(pieces), own.type)])
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([taken, *[pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]], names=["_doc", *_STORED_NAMES])

    schema = T.StructType([T.StructField("_doc", docs.schema["_doc"].dataType), *T._parse_datatype_string(STORED).fields])
    return docs.select("_doc", "_text").mapInArrow(run, schema)


def restore_media(media: DataFrame, of: str) -> DataFrame:
    """The column ``of`` and FEATURES of (of, _n_bytes, _sha256, _parts) once all parts are there."""

    def run(batches):
        for batch in batches:
            rows = []
            for n, sha, parts in zip(batch.column("_n_bytes").to_pylist(), batch.column("_sha256").to_pylist(), batch.column("_parts")):
                pieces = [unpack(p.as_buffer()) for p in parts.values]
                whole = b"".join(pieces)
                if hashlib.sha256(whole).digest() != sha:
                    raise ValueError("a medium differs from its digest after its chunks were put together")
                rows.append(features(whole, n, len(pieces)))
            yield pa.RecordBatch.from_arrays([batch.column("_of"), *_feature_arrays(rows)], names=["_of", *_FEATURE_NAMES])

    schema = T.StructType([T.StructField("_of", media.schema[of].dataType), *T._parse_datatype_string(FEATURES).fields])
    return media.select(F.col(of).alias("_of"), "_n_bytes", "_sha256", "_parts").mapInArrow(run, schema).withColumnRenamed("_of", of)


def media_columns(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep... and FEATURES of each row, read back from deduplicated chunks."""
    names = [c for c in keep if c not in _FEATURE_NAMES]
    packed = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    base = docs.select(packed.alias("_doc"), F.col(text_col).alias("_text"))
    stored = materialize(store_media(base, shared_chunks(docs, text_col)), "media")
    release(docs.sparkSession)
    store = stored.where("_digest is not null").groupBy("_digest").agg(F.min("_bytes").alias("_bytes"))
    media = stored.where("_row is not null").withColumn("_lacks", F.expr("size(filter(_parts, p -> p is null))"))
    alone = media.where("_lacks = 0")
    # a medium that occurs again has all its chunks in the store: of these each is put together once
    again = media.where("_lacks = size(_parts)").select("_doc", "_sha256", "_n_bytes", "_row", "_digests")
    firsts = again.groupBy("_sha256", "_n_bytes").agg(F.min(F.struct("_row", "_digests")).alias("_first")).select("_sha256", "_n_bytes", "_first._row", "_first._digests")
    firsts = materialize(firsts.withColumn("_parts", F.expr("transform(_digests, d -> cast(null as binary))")), "media-again")
    mixed = media.where("_lacks > 0 and _lacks < size(_parts)")
    one = lambda df: df.select("_row", F.posexplode(F.arrays_zip("_digests", "_parts")).alias("_seq", "_p")).where("_p._parts is null").select("_row", "_seq", F.col("_p._digests").alias("_digest"))
    fetched = one(firsts).unionAll(one(mixed)).join(store, "_digest").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_seq", "_bytes"))).alias("_fetched"))
    fetched = materialize(fetched, "media-parts")
    release(docs.sparkSession)
    filled = F.expr("transform(_parts, (p, i) -> coalesce(p, _fetched[i]))").alias("_parts")
    whole = mixed.join(fetched, "_row").select("_doc", "_n_bytes", "_sha256", filled)
    told = materialize(restore_media(firsts.join(fetched, "_row").select("_n_bytes", "_sha256", filled), "_sha256"), "media-told")
    release(docs.sparkSession)
    others = [F.col("_doc").getField(f"c{k}").alias(c) for k, c in enumerate(names)]
    parts = (restore_media(alone, "_doc"), restore_media(whole, "_doc"), again.select("_doc", "_sha256").join(told, "_sha256"))
    return reduce(DataFrame.unionAll, [p.select(*others, *_FEATURE_NAMES) for p in parts])
