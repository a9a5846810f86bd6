"""Line dedup: overlapping windows of three lines, each kept where it occurs first.

Lines are split at \\n; those with a character other than white space count, and ``window`` consecutive
counted lines of one text form a window. A window's first occurrence, by (doc_id, line), stays; each later one
covers its lines, in the same text or another, and all covered lines go. Windows are judged on the input.

Windows travel as two 64-bit hashes with their place, a few dozen bytes a line. They are counted with map-side
combining, so a window that a third of all texts share is one row per task; the join back leaves a hot hash to
adaptive skew splitting. The text itself is shuffled once, to meet the list of its later windows.

Defined results: null and blank texts have no counted lines and come back as they are; fewer lines than a window:
untouched; blank lines stay; rows that repeat both doc_id and text stand for one document and keep the same
lines; a null doc_id orders first; empty tables give empty results; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core
from .tables import ROW, SUM, identified, pin, positional

WINDOW = 3


def _counted(data, offsets):
    """Line starts, ends, documents, and which lines hold a character that is no white space."""
    starts, ends, doc = core.lines_of(data, offsets)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~core.SPACE[data], out=solid[1:])
    return starts, ends, doc, solid[ends] > solid[starts]


def windows(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, sum, line, h1, h2) of every window; ``line`` counts the lines that count."""

    def emit(batches):
        for batch in batches:
            for first, end, data, offsets in core.chunks(batch.column(2)):
                starts, ends, doc, full = _counted(data, offsets)
                starts, ends, doc = starts[full], ends[full], doc[full]
                begin = np.searchsorted(doc, np.arange(end - first))
                line = np.arange(len(doc)) - begin[doc]
                ok = np.flatnonzero(doc[window - 1:] == doc[:len(doc) - window + 1]) if len(doc) >= window else np.zeros(0, np.int64)
                both = [core.shingles(core.spans(s, starts, ends), window)[ok].view(np.int64) if len(ok) else np.zeros(0, np.int64)
                        for s in (core.running(data), core.running_2(data))]
                at = pa.array(doc[ok] + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(line[ok].astype(np.int32)), *map(pa.array, both)],
                    ["row", "sum", "line", "h1", "h2"])

    return (identified(documents.select("doc_id", "text")).select(F.col(ROW), F.col(SUM), F.col("text").cast("string").alias("text"))
            .mapInArrow(emit, "row long, sum long, line int, h1 long, h2 long"))


def later_windows(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, sum, at): for each document the windows that occur earlier; as many at most as it has lines."""
    found = pin(windows(documents, window))
    place = F.struct("row", "line", "sum")
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return (found.join(firsts, ["h1", "h2"]).where((F.col("row") != F.col("first.row")) | (F.col("line") != F.col("first.line")) | (F.col("sum") != F.col("first.sum")))
            .groupBy("row", "sum").agg(F.array_sort(F.collect_set("line")).alias("at")))


def line_dedup(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of documents with the covered lines cut from text, and two columns more at the end: lines that counted, and lines removed."""
    later = later_windows(documents, window).withColumnsRenamed({"row": ROW, "sum": SUM, "at": "__at"})
    names = documents.columns
    plain, doc, text = positional(documents)
    joined = identified(plain.withColumn(text, F.col(text).cast("string")), doc, text).join(later, [ROW, SUM], "left").select(*plain.columns, "__at")
    text_at = names.index("text")

    def cut(batches):
        for batch in batches:
            texts, at = batch.column(text_at), batch.column(len(names))
            kept, total, gone = texts.to_pylist(), [], []
            spots = at.to_pylist()
            for first, end, data, offsets in core.chunks(texts):
                starts, ends, doc, full = _counted(data, offsets)
                counted = np.bincount(doc[full], minlength=end - first)
                edges = np.searchsorted(doc, np.arange(end - first + 1))
                for i in range(end - first):
                    total.append(int(counted[i]))
                    if not spots[first + i]:
                        gone.append(0)
                        continue
                    lo, hi = edges[i], edges[i + 1]
                    mine = np.flatnonzero(full[lo:hi])
                    out = core.covered(np.array(spots[first + i]), window, len(mine))
                    keep = np.ones(hi - lo, bool)
                    keep[mine[out]] = False
                    gone.append(int(out.sum()))
                    text = data[offsets[i]:offsets[i + 1]].tobytes()
                    kept[first + i] = b"\n".join([text[s - offsets[i]:e - offsets[i]] for s, e in zip(starts[lo:hi][keep], ends[lo:hi][keep])]).decode()
            columns = [batch.column(i) for i in range(len(names))]
            columns[text_at] = pa.array(kept, texts.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [f"c{i}" for i in range(len(names) + 2)])

    kinds = [f.dataType for f in joined.schema.fields[:-1]]
    schema = T.StructType([T.StructField(f"c{i}", kind) for i, kind in enumerate([*kinds, T.LongType(), T.LongType()])])
    return joined.mapInArrow(cut, schema).toDF(*names, "lines", "lines_removed")


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of documents after the cut; a document that lost its every counted line goes."""
    cut = line_dedup(documents, window)
    flags = cut.toDF(*[f"c{i}" for i in range(len(cut.columns))])
    lines, removed = flags.columns[-2:]
    return (flags.where((F.col(removed) == 0) | (F.col(removed) < F.col(lines))).select(*flags.columns[:-2]).toDF(*documents.columns))


def digest(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    cut = line_dedup(documents.select("doc_id", "text"), window)
    return cut.select("doc_id", F.col("lines").alias("n_lines"), F.col("lines_removed").alias("n_removed"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), every_line AS (
  SELECT doc_id, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM parts
), solid AS (
  SELECT doc_id, text, n, line, row_number() OVER (PARTITION BY doc_id, text ORDER BY n) AS k
  FROM every_line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), win AS (
  SELECT doc_id, text, n, k, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM solid WINDOW w AS (PARTITION BY doc_id, text ORDER BY k)
), later AS (
  SELECT DISTINCT doc_id, text, k FROM (
    SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS times FROM win WHERE c IS NOT NULL) WHERE times > 1
), gone AS (
  SELECT DISTINCT s.doc_id, s.text, s.n FROM solid s JOIN later l
    ON s.doc_id = l.doc_id AND s.text = l.text AND s.k BETWEEN l.k AND l.k + 2
), kept AS (
  SELECT e.doc_id, e.text, string_agg(e.line, chr(10) ORDER BY e.n) AS left_over
  FROM every_line e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.text = g.text AND e.n = g.n WHERE g.n IS NULL GROUP BY ALL
)
SELECT p.doc_id,
  (SELECT count(*) FROM solid s WHERE s.doc_id = p.doc_id AND s.text = p.text) AS n_lines,
  (SELECT count(*) FROM gone g WHERE g.doc_id = p.doc_id AND g.text = p.text) AS n_removed,
  sha256(coalesce((SELECT left_over FROM kept k WHERE k.doc_id = p.doc_id AND k.text = p.text), '')) AS kept_sha256
FROM parts p
"""
