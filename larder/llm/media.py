"""Media columns: texts stored as progressive JPEG files and read back as RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larder.llm.jpeg import encode_payloads, read_files

BLOCK = 64
GROUP_BYTES = 1 << 20


def _groups(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, values) in groups of about GROUP_BYTES; null counts as empty."""
    first, held, size = 0, [], 0
    for i, value in enumerate(column):
        raw = value.as_py() or b""
        held.append(raw.encode() if isinstance(raw, str) else raw)
        size += len(held[-1]) + 256
        if size > GROUP_BYTES:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in _groups(batch.column(1)):
            payloads = [t + bytes(-len(t) % BLOCK or (BLOCK if not t else 0)) for t in texts]
            files = encode_payloads(payloads, [len(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(files)), pa.array(files, pa.binary())], names=["doc_id", "media"])


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each whole text as a progressive JPEG file.

    docs: doc_id and text; other columns are ignored. The UTF-8 bytes (null: none) are
    padded with zeros to a positive multiple of 64. Equal texts give equal files, also
    for repeated rows; a null doc_id stays null; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encoded, f"doc_id {kind}, media binary")


def tensors(media: DataFrame) -> DataFrame:
    """(doc_id, height, width, rgb, payload) of media files (doc_id, media).

    rgb: the bytes of the full-resolution tensor in the order row, column, channel.
    Files are progressive JPEGs of one or three components, scans interleaved or not; all four are
    null for a null and for what cannot be decoded, other kinds of JPEG too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, files in _groups(batch.column(1)):
                made = read_files(files)
                pixels = [m and m[1] for m in made]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(files)), pa.array([None if p is None else p.shape[0] for p in pixels], pa.int32()),
                        pa.array([None if p is None else p.shape[1] for p in pixels], pa.int32()), pa.array([None if p is None else p.tobytes() for p in pixels], pa.binary()),
                        pa.array([m and m[0].payload() for m in made], pa.binary()),
                    ],
                    names=["doc_id", "height", "width", "rgb", "payload"],
                )

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, height int, width int, rgb binary, payload binary")


def feature(pixels: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, and checksum of a tensor."""
    sums = pixels.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    means = ",".join(str(int(s) * 1000 // (pixels.shape[0] * pixels.shape[1])) for s in sums)
    return f"{pixels.shape[1]}x{pixels.shape[0]}:{means}:{zlib.crc32(pixels.tobytes()):08x}"


def digest(media: DataFrame) -> DataFrame:
    """Reads the stored files back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Of a file that cannot be decoded all but doc_id, media_bytes and media_sha256 are null, of a null these two as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, files in _groups(batch.column(1)):
                read = read_files(files)
                payloads = [m and m[0].payload() for m in read]
                there = batch.column(1).slice(first, len(files)).is_valid().to_pylist()
                made = {
                    "doc_id": batch.column(0).slice(first, len(files)),
                    "n_bytes": pa.array([m and m[0].header.n_bytes for m in read], pa.int64()),
                    "payload_bytes": pa.array([None if p is None else len(p) for p in payloads], pa.int64()),
                    "payload_sha256": pa.array([None if p is None else hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                    "tail_crc32": pa.array([None if p is None else zlib.crc32(p[-BLOCK:]) for p in payloads], pa.int64()),
                    "media_bytes": pa.array([len(f) if ok else None for f, ok in zip(files, there)], pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(f).hexdigest() if ok else None for f, ok in zip(files, there)], pa.string()),
                    "feature": pa.array([m and feature(m[1]) for m in read], pa.string()),
                }
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(
        run,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
