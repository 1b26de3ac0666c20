"""Overlapping chunks that end at word boundaries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

SIZE, OVERLAP = 1000, 200
#: Four bytes a character, so that a window is cut out of a text of any length without walking through it.
_WIDE, _EACH = "UTF-32", 4
#: Windows that an inner fold gathers.
ROW = 64


def _steps(length: Column, size: int, overlap: int) -> Column:
    """At least as many as there are windows.

    Of three windows that follow each other, the third starts `size - 2 * overlap` or more behind the first one's start: a
    window that ends at a space near its start is followed by one that has no space before its own size is nearly used up.
    """
    least = size - 2 * overlap
    return F.lit(3) * (F.floor(length / F.lit(least)).cast("int") + 1) if least > 0 else length


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(wide: Column, length: Column, size: int, overlap: int) -> Column:
    """Array of (a, e): first places and ends of the windows; an end may lie behind the text's.

    A fold over window numbers whose state is the next window's start and the spans so far. A window ends at its last
    space, or after `size` characters if it has none behind its start or reaches the end; the next one starts `overlap`
    before that end, or at it where that would not advance. Spans are gathered ROW windows at a time, as a fold copies what it
    has gathered at every step.
    """

    def ends(at: Column) -> Column:
        inside = F.decode(F.substring(wide, at * _EACH + 1, F.lit(size * _EACH)), _WIDE)
        last = lambda: F.lit(size - 1) - F.length(F.substring_index(inside, " ", -1))
        return at + F.when(at + size < length, _let(last(), lambda p: F.when(p > 0, p).otherwise(F.lit(size)))).otherwise(F.lit(size))

    def window(state: Column, _) -> Column:
        step = lambda e: F.struct(F.when(e - overlap > state.at, e - overlap).otherwise(e).alias("at"), F.array_append(state.spans, F.struct(state.at.alias("a"), e.alias("e"))).alias("spans"))
        return F.when(state.at < length, _let(ends(state.at), step)).otherwise(state)

    def row(state: Column, _) -> Column:
        start = F.struct(state.at.alias("at"), F.array().cast("array<struct<a:int,e:int>>").alias("spans"))
        some = F.aggregate(F.sequence(F.lit(1), F.lit(ROW)), start, window)
        return F.when(state.at < length, _let(some, lambda x: F.struct(x.at.alias("at"), F.array_append(state.rows, x.spans).alias("rows")))).otherwise(state)

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<a:int,e:int>>>").alias("rows"))
    return F.aggregate(F.sequence(F.lit(0), (_steps(length, size, overlap) / ROW).cast("int")), first, row, lambda state: F.flatten(state.rows))


def spans_of(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of (a, e) of a text's windows; one from 0 to `size` for a text of up to `size` characters."""
    return _let(F.encode(text, _WIDE), lambda w: _spans(w, (F.octet_length(w) / _EACH).cast("int"), size, overlap))


def chunks_of(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of a text's chunks; a null text has none.

    A text of up to `size` characters is one chunk, unchanged; of others the stripped windows that aren't blank. All of it
    is column expressions: the work grows with the windows, the memory is four bytes a character and the chunks.
    """

    def pieces(wide: Column) -> Column:
        spans = _spans(wide, (F.octet_length(wide) / _EACH).cast("int"), size, overlap)
        cut = lambda s: strip(F.decode(F.substring(wide, s.a * _EACH + 1, (s.e - s.a) * _EACH), _WIDE))
        return F.filter(F.transform(spans, cut), lambda c: c != "")

    long = _let(F.encode(text, _WIDE), pieces)
    none = F.array().cast("array<string>")
    return F.when(text.isNull(), none).when(F.length(text) <= size, F.array(text)).otherwise(long)


def chunk_rows(docs: DataFrame, filename: Column, text: Column, path: Column | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A chunk row (schemas.CHUNK, embedding null) for each chunk; chunk_id counts from 0."""
    rows = docs.select(filename.alias("filename"), (filename if path is None else path).alias("file_path"), text.alias("t"))
    rows = rows.withColumn("chunks", chunks_of(F.col("t"), size, overlap))
    # Sizes first: else each chunk's row would carry the whole text and all its chunks until they are computed, as to a Python worker.
    rows = rows.select("filename", "file_path", F.size("chunks").alias("total"), F.length("t").alias("file_size"), "chunks")
    rows = rows.select("filename", "file_path", "total", "file_size", F.posexplode("chunks").alias("chunk_id", "content"))
    metadata = F.struct("file_path", F.length("content").alias("chunk_size"), F.col("total").alias("total_chunks"), "file_size")
    return rows.select("content", "filename", "chunk_id", metadata.alias("metadata"), F.lit(None).cast("array<double>").alias("embedding"))
