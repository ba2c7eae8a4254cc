"""Computations on layouts and bytes that are plain DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checksums import fold_stream_crc
from ..tables import discard, kept


def decoded_offsets(blocks: DataFrame, by: list[str], order: list[str], length: str, out: str = "decoded_start") -> DataFrame:
    """Running sum of lengths before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn(out, F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))


def rollup(blocks: DataFrame, by: list[str], number: str, length: str) -> DataFrame:
    """first_block, block_count and decoded_bytes of each container."""
    return blocks.groupBy(*by).agg(F.min(number).alias("first_block"), F.count("*").alias("block_count"), F.sum(length).cast("long").alias("decoded_bytes"))


def dedup_marks(marks: DataFrame) -> DataFrame:
    return marks.dropDuplicates(["path", "bit_offset"])


def with_sound_streams(marks: DataFrame) -> DataFrame:
    """marks without the stream headers that neither a block nor an end follows at once.

    A header is four bytes, which turn up by chance about once in 477 MB of compressed data; the mark behind it has six more.
    """
    after = marks.where("kind in ('block', 'end')").select("path", (F.col("bit_offset") - 32).alias("bit_offset")).distinct()
    streams = marks.where("kind = 'stream'").join(after, ["path", "bit_offset"], "left_semi").select(*marks.columns)
    return marks.where("kind <> 'stream'").unionByName(streams)


def too_many_marks(marks: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, marks) of sources with more marks than their bytes could hold as blocks."""
    return marks.groupBy("path").agg(F.count("*").alias("marks")).join(sources.select("path", "length"), "path").where(F.col("marks") > F.floor(F.col("length") / 16) + 64).select("path", "marks")


def index_violations(blocks: DataFrame) -> DataFrame:
    """(path, number, rule) where blocks of an index leave gaps, overlap, are empty ranges or are numbered with gaps."""
    w = Window.partitionBy("path").orderBy("number")
    b = blocks.withColumn("p_end", F.lag("compressed_end_bit").over(w)).withColumn("p_start", F.lag(F.col("decoded_start") + F.col("decoded_bytes")).over(w)).withColumn("p_number", F.lag("number").over(w))
    rules = F.array_compact(
        F.array(
            F.when(F.col("decoded_start") != F.coalesce("p_start", F.lit(0)), "decoded gap"),
            F.when(F.col("compressed_start_bit") < F.coalesce("p_end", F.lit(0)), "compressed overlap"),
            F.when(F.col("compressed_end_bit") <= F.col("compressed_start_bit"), "empty range"),
            F.when(F.col("number") != F.coalesce(F.col("p_number") + 1, F.lit(0)), "numbering"),
        )
    )
    return b.select("path", "number", F.explode(rules).alias("rule"))


def chain(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """(path, number, start_bit, end_bit) of the candidates (path, start_bit, end_bit) that are reached from the starts
    (path, start_bit) when each must begin where the one before ended.

    Pointer doubling over the metadata: after round k all candidates within 2**k steps are known and `jump` leads 2**k steps
    on, so a chain of n blocks takes log2(n) rounds, each kept as a table. A candidate must end behind its start.
    """
    pairs = pairs.select("path", F.col("start_bit").cast("long").alias("start_bit"), F.col("end_bit").cast("long").alias("end_bit")).where("end_bit > start_bit").distinct()
    pairs = kept(pairs)
    jump = pairs.select("path", F.col("start_bit").alias("here"), F.col("end_bit").alias("there"))
    reached = starts.select("path", F.lit(0).cast("long").alias("number"), F.col("start_bit").cast("long").alias("here")).distinct()
    step, tables, found = 1, [], -1
    while True:
        on = reached.join(jump, ["path", "here"]).select("path", (F.col("number") + step).alias("number"), F.col("there").alias("here"))
        reached = kept(reached.unionByName(on).distinct())
        tables.append(reached)
        count = reached.count()
        if count == found:
            break
        found, step = count, 2 * step
        onward = jump.select("path", F.col("here").alias("there"), F.col("there").alias("beyond"))
        jump = kept(jump.join(onward, ["path", "there"]).select("path", "here", F.col("beyond").alias("there")).distinct())
        tables.append(jump)
    out = reached.join(pairs, (reached["path"] == pairs["path"]) & (reached["here"] == pairs["start_bit"])).select(pairs["path"], reached["number"].cast("int").alias("number"), "start_bit", "end_bit")
    discard(*tables[:-1])
    return out


def chain_by_lag(blocks: DataFrame) -> DataFrame:
    """The same for candidates that already lie in order: a row is in the chain while no row before it broke it."""
    w = Window.partitionBy("path").orderBy("start_bit")
    broken = F.when(F.col("start_bit") != F.coalesce(F.lag("end_bit").over(w), F.col("start_bit")), 1).otherwise(0)
    return blocks.withColumn("__b", broken).withColumn("__n", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__n = 0").drop("__b", "__n")


def stream_checksums(blocks: DataFrame, by: list[str], number: str = "number", crc: str = "expected_crc") -> DataFrame:
    """The folded checksum of each stream from its blocks' checksums."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(number, crc))), lambda x: x[crc])
    return blocks.groupBy(*by).agg(fold_stream_crc(ordered).alias("stream_crc"))


def bytes_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, b): the bytes of a text column, from position 0."""
    body = F.encode(F.col(text), "UTF-8")
    n = F.octet_length(body)
    return df.select(key, F.posexplode(F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.hex(body.substr(i, F.lit(1))), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))).alias("i", "b"))


def byte_histogram(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, b, n): how often each byte occurs."""
    return bytes_of(df, key, text).groupBy(key, "b").agg(F.count("*").alias("n"))


def runs(df: DataFrame, key: str, text: str, most: int = 259) -> DataFrame:
    """(key, start, b, n): runs of equal bytes, cut after `most`, as run-length coding groups them."""
    w, same = Window.partitionBy(key).orderBy("i"), Window.partitionBy(key, "b").orderBy("i")
    b = bytes_of(df, key, text).withColumn("island", F.row_number().over(w) - F.row_number().over(same))
    inside = F.row_number().over(Window.partitionBy(key, "b", "island").orderBy("i")) - 1
    return b.withColumn("part", F.floor(inside / most)).groupBy(key, "b", "island", "part").agg(F.min("i").cast("long").alias("start"), F.count("*").alias("n")).select(key, "start", "b", "n")


def bwt_last_column(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, last, origin): last characters of the sorted rotations, and the place of the text itself among them."""
    n = F.length(text)
    rotation = lambda i: F.concat(F.expr(f"substring({text}, i + 1)"), F.expr(f"substring({text}, 1, i)"))
    rot = df.where(n > 0).select(key, F.col(text), F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).withColumn("r", rotation("i"))
    ordered = F.array_sort(F.collect_list(F.struct("r", "i")))
    got = rot.groupBy(key).agg(ordered.alias("x"))
    return got.select(key, F.array_join(F.transform("x", lambda s: F.right(s["r"], F.lit(1))), "").alias("last"), (F.array_position(F.transform("x", lambda s: s["i"]), F.lit(0)) - 1).cast("long").alias("origin"))


def mtf_symbols(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, symbols): move-to-front numbers of the bytes; a fold over the list of all byte values in use order."""
    b = bytes_of(df, key, text).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]).alias("bs"))
    start = F.struct(F.sequence(F.lit(0), F.lit(255)).alias("order"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.struct(F.concat(F.array(x), F.array_remove(a["order"], x)).alias("order"), F.concat(a["out"], F.array((F.array_position(a["order"], x) - 1).cast("int"))).alias("out"))
    return b.select(key, F.aggregate("bs", start, step, lambda a: a["out"]).alias("symbols"))


def segments(df: DataFrame, key: str, length: Column, size: int) -> DataFrame:
    """(key, segment, start, n) of fixed-size pieces of values of this length."""
    count = F.ceil(length / size).cast("long")
    s = df.select(key, length.cast("long").alias("__n"), F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))).alias("segment"))
    return s.select(key, "segment", (F.col("segment") * size).alias("start"), F.least(F.lit(size), F.col("__n") - F.col("segment") * size).cast("long").alias("n"))


def with_dictionary(pieces: DataFrame, by: str, order: str, content: str, size: int = 32 << 10) -> DataFrame:
    """pieces with the last bytes of the one before each as `dictionary`."""
    before = F.lag(content).over(Window.partitionBy(by).orderBy(order))
    return pieces.withColumn("dictionary", before).withColumn("dictionary", F.when(F.octet_length("dictionary") > size, F.col("dictionary").substr(F.octet_length("dictionary") - size + 1, F.lit(size))).otherwise(F.col("dictionary")))


def smaller(plain: Column, packed: Column) -> Column:
    """Whether to keep a value as it is: its compressed form is no smaller."""
    return F.octet_length(packed) >= F.octet_length(plain)


def over_limit(df: DataFrame, by: str, length: str, limit: int) -> DataFrame:
    return df.groupBy(by).agg(F.sum(length).cast("long").alias("total")).where(F.col("total") > limit)


def huffman_groups(symbols: Column) -> Column:
    """Number of code tables for a block with so many symbols (fixed steps of the bzip2 format)."""
    return F.when(symbols < 200, 2).when(symbols < 600, 3).when(symbols < 1200, 4).when(symbols < 2400, 5).otherwise(6)
