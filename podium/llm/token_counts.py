"""Exact token counts of whole texts from the piece counts of distinct pre-tokens; no token id is ever made a row.

A sentencepiece BPE model merges only symbols that are neighbours inside one of its pieces. Where no piece runs across a boundary, the two
sides are encoded independently, so a text's count is the sum over its pre-tokens: a run of spaces with the characters after it, and every line
feed on its own (``checked`` proves both boundaries from the model's pieces and refuses a model that breaks them).

Texts are read in chunks of bounded bytes. A chunk lists its distinct pre-tokens once, by hash buckets, and for each of its documents the places in that
list with their frequencies. A bucket of all chunks meets in one task (their number follows the bytes of text), which encodes each distinct pre-token once;
the counts go back to the chunks in the order of their lists and are summed per document. The commonest word is one entry a chunk, not one
a document, and lists and postings travel compressed.

Defined results: null and empty text have no bytes and no tokens; every row is counted, repeated rows and repeated or null ids as
often as they come, and rows of equal text get equal counts; other columns of the input are not read, and clash with nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bytes_of, pin

LIMIT = 4096
#: bytes of text whose pre-tokens share one list
CHUNK = 8 << 20
#: bytes of text for each bucket of pre-tokens
BUCKET = 16 << 20
#: a longer text is split lazily, so that its words are never a list
LAZY = 1 << 20
SPACE = "▁"
PRE_TOKEN = re.compile(f"\n|[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+")

_models: dict[str, object] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _proto(path: str):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    return proto


def checked(path: str) -> str:
    """The path of a model for which the split into pre-tokens is exact; another model is refused."""
    proto = _proto(path)
    norm, pieces = proto.normalizer_spec, [p.piece for p in proto.pieces if p.type in (1, 4)]
    plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces and norm.add_dummy_prefix
    if not plain or proto.trainer_spec.model_type != 2 or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("pre-token counts need a BPE model that does not normalise text")
    if any(re.search(f"[^{SPACE}]{SPACE}", p) or (len(p) > 1 and "\n" in p) for p in pieces):
        raise ValueError("pieces of this model run across pre-tokens")
    return path


def _model(path: str):
    if path not in _models:
        import sentencepiece

        proto = _proto(path)
        proto.normalizer_spec.add_dummy_prefix = False  # pre-tokens carry their spaces themselves
        _models[path] = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    return _models[path]


def pre_tokens(text: str) -> Counter:
    """Pre-tokens of a text with their frequencies; a text starts with a space of its own, as the library gives it."""
    text = " " + text if text else ""
    if len(text) > LAZY:
        return Counter(m.group() for m in PRE_TOKEN.finditer(text))
    return Counter(PRE_TOKEN.findall(text))


_PARTS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
_DDL = "chunk bigint, bucket int, blob binary, ids array<bigint>, sizes array<bigint>"


def _planes(values: np.ndarray) -> bytes:
    """Integers by byte planes, which compress well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _press(*parts: bytes) -> bytes:
    head = np.array([len(p) for p in parts], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _wring(blob: bytes, parts: int) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    ends = 8 * parts + np.cumsum(np.frombuffer(data, "<i8", parts))
    return [data[a:b] for a, b in zip([8 * parts, *ends[:-1]], ends)]


def _strings(pieces: list[bytes]) -> bytes:
    return _press(_planes(np.array([len(p) for p in pieces], np.int64)), b"".join(pieces))


def _unstrung(blob: bytes) -> list[str]:
    lengths, data = _wring(blob, 2)
    ends = np.cumsum(_unplaned(lengths)).tolist()
    return [data[a:b].decode() for a, b in zip([0, *ends[:-1]], ends)]


def _chunks(size: int, buckets: int):
    """Per chunk one row of postings (bucket null) and one row a bucket with the chunk's pre-tokens of that bucket."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        places, ids, held, ats, ns, weight = {}, [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            pieces = [p.encode() for p in places]
            bucket = np.fromiter((zlib.crc32(p) % buckets for p in pieces), np.int64, len(pieces))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            steps, freq = [], []
            for at, n in zip(ats, ns):
                at = place[at]
                rise = np.argsort(at)
                steps.append(np.diff(at[rise], prepend=0))
                freq.append(n[rise])
            postings = _press(*[_planes(x) for x in (np.array([len(a) for a in ats]), np.concatenate(steps), np.concatenate(freq))])
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            own = [(b, _strings([pieces[i] for i in order[lo:hi]])) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo]
            n = len(own) + 1
            return pa.RecordBatch.from_arrays([pa.array([number] * n), pa.array([None, *(b for b, _ in own)], pa.int32()),
                                               pa.array([postings, *(x for _, x in own)], pa.binary()),
                                               pa.array([ids] + [None] * len(own), pa.list_(pa.int64())),
                                               pa.array([held] + [None] * len(own), pa.list_(pa.int64()))], schema=_PARTS)

        for batch in batches:
            for i in range(batch.num_rows):
                found = pre_tokens(batch.column(1)[i].as_py() or "")
                ids.append(batch.column(0)[i].as_py())
                held.append(batch.column(2)[i].as_py())
                ats.append(np.fromiter((places.setdefault(p, len(places)) for p in found), np.int64, len(found)))
                ns.append(np.fromiter(found.values(), np.int64, len(found)))
                weight += held[-1] + 64
                if weight >= size:
                    yield flush()
                    number += 1
                    places, ids, held, ats, ns, weight = {}, [], [], [], [], 0
        if ids:
            yield flush()

    return split


def _encoded(path: str):
    """A bucket: every distinct pre-token is encoded once, and each chunk gets the counts of its own in their order."""
    def count(table: pa.Table) -> pa.Table:
        model, counts, out = _model(path), {}, []
        for blob in table.column("blob"):
            mine = _unstrung(blob.as_py())
            fresh = [p for p in mine if p not in counts]
            for i in range(0, len(fresh), 4096):
                part = fresh[i:i + 4096]
                counts.update(zip(part, map(len, model.encode(part, num_threads=1))))
            out.append(_press(_planes(np.fromiter((counts[p] for p in mine), np.int64, len(mine)))))
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "blob": pa.array(out, pa.binary())})

    return count


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk, the counts (by bucket), then the postings, which are summed by them."""
    counts: list[np.ndarray] = []
    for batch in batches:
        for row in range(batch.num_rows):
            blob = batch.column(2)[row].as_py()
            if batch.column(1)[row].is_valid:
                counts.append(_unplaned(_wring(blob, 1)[0]))
                continue
            n_pieces, steps, freq = map(_unplaned, _wring(blob, 3))
            table = np.concatenate([*counts, np.zeros(1, np.int64)])
            counts = []
            ends = np.cumsum(n_pieces)
            at = np.append(0, np.cumsum(steps))
            at = at[1:] - np.repeat(at[ends - n_pieces], n_pieces)  # places start anew in every document
            sums = np.append(0, np.cumsum(table[at] * freq))
            total = sums[ends] - sums[ends - n_pieces]
            yield pa.RecordBatch.from_arrays([batch.column(3)[row].values, batch.column(4)[row].values, pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(documents: DataFrame, model: str | None = None, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of documents.

    ``model`` must be readable under this path wherever tasks run (a tokenizer is installed with its library, or shipped by
    ``spark.files``).
    """
    model = checked(model or default_model())
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                            F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    buckets = bytes_of(documents) // BUCKET + 8
    parts = pin(docs.mapInArrow(_chunks(chunk, buckets), _DDL))
    counts = (parts.where("bucket IS NOT NULL").select("chunk", "bucket", "blob").groupBy("bucket")
              .applyInArrow(_encoded(model), "chunk bigint, bucket int, blob binary"))
    none = F.lit(None).cast("array<bigint>")
    lined = counts.select("chunk", "bucket", "blob", none.alias("ids"), none.alias("sizes")).unionByName(parts.where("bucket IS NULL"))
    return (lined.repartition("chunk").sortWithinPartitions("chunk", F.col("bucket").asc_nulls_last())
            .mapInArrow(_summed, "doc_id bigint, n_bytes bigint, n_tokens bigint")
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
