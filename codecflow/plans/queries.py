"""Queries over the driver's tables, one or more for each operator, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checksums, detect
from ..operators import archives, codecs, relational
from ..sources.objects import objects
from ..tables import kept
from . import distributed, layout, ranges
from .dealing import deal, spread

#: Documents that make up one object where a query needs objects of some size.
DOCS_PER_OBJECT = 50
#: A chunk, segment and block size for queries on objects of a few hundred KiB.
SMALL_CHUNK = 64 << 10

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _documents(spark, sf_dir) -> DataFrame:
    """(path, content) of plain documents."""
    return objects(_table(spark, sf_dir, "documents"), F.col("doc_id"), F.encode("text", "UTF-8"))


def _bundles(spark, sf_dir) -> DataFrame:
    """(path, plain): DOCS_PER_OBJECT documents after one another."""
    d = _table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / DOCS_PER_OBJECT).cast("string").alias("path"))
    whole = d.agg(F.encode(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), ""), "UTF-8").alias("plain"))
    return deal(whole, "path")


def _coded_bundles(spark, sf_dir) -> DataFrame:
    """The same as bzip2 objects, kept since several branches of a query read them as they would read files."""
    return codecs.compress(_bundles(spark, sf_dir), "bzip2", level=1).drop("plain").persist()


_BUNDLES = f"(SELECT cast(doc_id // {DOCS_PER_OBJECT} AS varchar) AS path, string_agg(text, '' ORDER BY doc_id) AS text FROM documents GROUP BY 1)"
_BUNDLE_DIGESTS = f"SELECT path, octet_length(encode(text)) AS n_bytes, md5(text) AS digest FROM {_BUNDLES}"


def _digests(df: DataFrame, key: str, plain: str = "plain") -> DataFrame:
    return df.select(key, F.octet_length(plain).cast("long").alias("n_bytes"), F.md5(plain).alias("digest"))


# -- encoding and decoding ---------------------------------------------------------------------------------------------


def _roundtrip(format: str, level: int | None = None):
    def run(spark, sf_dir):
        coded = codecs.compress(_table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("plain")), format, level=level).drop("plain")
        assured = coded.withColumn("format", detect.detect(F.col("content"))).where(F.col("format") == format)
        return _digests(codecs.decompress(assured.select("doc_id", "content")), "doc_id")

    run.__name__ = f"roundtrip_{format}" + (f"_level_{level}" if level else "")
    return query("SELECT doc_id, octet_length(encode(text)) AS n_bytes, md5(text) AS digest FROM documents")(run)


for _f in codecs.FORMATS:
    _roundtrip(_f)
    _roundtrip(_f, 1)


@query("SELECT page_id, octet_length(encode(html)) AS n_bytes, md5(html) AS digest FROM pages")
def roundtrip_deflate(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("plain"))
    return _digests(codecs.inflate(codecs.deflate(p, level=9).drop("plain")), "page_id")


@query(_BUNDLE_DIGESTS)
def concatenated_members(spark, sf_dir):
    d = codecs.compress(_table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("plain")), "gzip").drop("plain")
    whole = d.groupBy(F.floor(F.col("doc_id") / DOCS_PER_OBJECT).cast("string").alias("path")).agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.hex("content").alias("h")))), lambda x: x["h"]), "")).alias("content"))
    return _digests(codecs.decompress(whole), "path")


@query(_BUNDLE_DIGESTS)
def segmented_gzip(spark, sf_dir):
    return _digests(codecs.decompress(distributed.encode_gzip(_bundles(spark, sf_dir), segment=SMALL_CHUNK)), "path")


@query(_BUNDLE_DIGESTS)
def blockwise_lz4(spark, sf_dir):
    return _digests(codecs.decompress(distributed.encode_lz4(_bundles(spark, sf_dir), block_size=SMALL_CHUNK)), "path")


@query(_BUNDLE_DIGESTS)
def blockwise_bzip2(spark, sf_dir):
    return _digests(codecs.decompress(distributed.encode_bzip2(_bundles(spark, sf_dir), level=1)), "path")


@query(f"SELECT path, md5(text) AS digest FROM {_BUNDLES}")
def parallel_bzip2_decode(spark, sf_dir):
    coded = _coded_bundles(spark, sf_dir)
    parts = distributed.decode_bzip2(coded).select("path", "number", F.hex("plain").alias("h"))
    return parts.groupBy("path").agg(F.md5(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "h"))), lambda x: x["h"]), ""))).alias("digest"))


@query("SELECT doc_id, TRUE AS ok, octet_length(encode(text)) AS decoded_bytes FROM documents")
def validate_sound(spark, sf_dir):
    coded = codecs.compress(_table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("plain")), "lz4").drop("plain")
    return codecs.validate(coded).select("doc_id", "check.ok", "check.decoded_bytes")


@query("SELECT doc_id, 'bad_checksum' AS error_class, octet_length(encode(text)) AS decoded_bytes FROM documents")
def corruption_detected(spark, sf_dir):
    coded = codecs.compress(_table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("plain")), "gzip").drop("plain")
    n = F.octet_length("content")
    flipped = F.concat(F.col("content").substr(F.lit(1), n - 8), F.unhex(F.lpad(F.hex(F.conv(F.hex(F.col("content").substr(n - 7, F.lit(1))), 16, 10).cast("int").bitwiseXOR(F.lit(1))), 2, "0")), F.col("content").substr(n - 6, F.lit(7)))
    return codecs.validate(coded.withColumn("content", flipped)).where("not check.ok").select("doc_id", "check.error_class", "check.decoded_bytes")


@query("SELECT doc_id, octet_length(encode(text)) > 4096 AS over FROM documents")
def max_output_guard(spark, sf_dir):
    coded = codecs.compress(_table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("plain")), "lz4").drop("plain")
    got = codecs.decompress_permissive(coded, max_output=4096)
    return got.select("doc_id", F.coalesce(F.col("plain.error_class") == "output_limit", F.lit(False)).alias("over"))


# -- names and formats -------------------------------------------------------------------------------------------------


@query("SELECT f AS format, count(*) AS n FROM documents, (VALUES ('bzip2'), ('gzip'), ('lz4')) t(f) GROUP BY f")
def detect_format(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.encode("text", "UTF-8").alias("plain"))
    coded = [codecs.compress(d, f).select("content") for f in codecs.FORMATS]
    return coded[0].union(coded[1]).union(coded[2]).groupBy(detect.detect(F.col("content"), strict=False).alias("format")).agg(F.count("*").alias("n"))


_SUFFIX_LIST = ["bz2", "tar.gz", "tgz", "TBZ2", "lz4", "zip", "tar.lz4", "txt"]
_NAMES = f"(SELECT page_id, url || '.' || s AS path FROM pages, (VALUES {', '.join(f"('{s}')" for s in _SUFFIX_LIST)}) t(s))"


def _names(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(*map(F.lit, _SUFFIX_LIST))).alias("s"), "url").select("page_id", F.concat("url", F.lit("."), "s").alias("path"))


@query(
    f"""SELECT path, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'bz2' THEN 'bzip2' WHEN 'tbz2' THEN 'bzip2' WHEN 'gz' THEN 'gzip' WHEN 'tgz' THEN 'gzip' WHEN 'lz4' THEN 'lz4' WHEN 'zip' THEN 'zip' END AS by_name,
    CASE WHEN lower(path) LIKE '%.tbz2' THEN 'tar.bzip2' WHEN lower(path) LIKE '%.tar.gz' OR lower(path) LIKE '%.tgz' THEN 'tar.gzip' WHEN lower(path) LIKE '%.tar.lz4' THEN 'tar.lz4' WHEN lower(path) LIKE '%.zip' THEN 'zip' WHEN lower(path) LIKE '%.bz2' THEN 'bzip2' WHEN lower(path) LIKE '%.lz4' THEN 'lz4' END AS encoder,
    CASE WHEN lower(path) LIKE '%.tbz2' OR lower(path) LIKE '%.tgz' THEN regexp_replace(path, '\\.[^.]*$', '') || '.tar' WHEN lower(path) LIKE '%.bz2' OR lower(path) LIKE '%.gz' OR lower(path) LIKE '%.lz4' THEN regexp_replace(path, '\\.[^.]*$', '') ELSE path || '.out' END AS decoded,
    lower(path) LIKE '%.tbz2' OR lower(path) LIKE '%.tgz' OR lower(path) LIKE '%.tar.gz' OR lower(path) LIKE '%.tar.lz4' OR lower(path) LIKE '%.zip' AS is_archive,
    'out/' || regexp_extract(path, '([^/]+)$', 1) || '.gz' AS packed FROM {_NAMES}"""
)
def output_names(spark, sf_dir):
    p = F.col("path")
    return _names(spark, sf_dir).select("path", detect.from_name(p).alias("by_name"), detect.output_format(p).alias("encoder"), detect.decoded_name(p).alias("decoded"), detect.is_archive(p).alias("is_archive"), detect.compressed_name(p, "gzip", "out").alias("packed"))


@query("SELECT l_orderkey, l_linenumber, cast(l_quantity AS bigint) * power(1024, l_linenumber % 4)::bigint AS size FROM lineitem")
def parse_size(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("", "k", "MiB", "gb"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", detect.parse_size(F.concat(F.col("l_quantity").cast("long").cast("string"), unit)).alias("size"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE printf('%.1f', n_chars / 1024.0) || ' KiB' END AS shown, CASE WHEN n_chars < 60 THEN n_chars || 's' WHEN n_chars < 3600 THEN printf('%dm%02ds', n_chars // 60, n_chars % 60) ELSE printf('%dh%02dm', n_chars // 3600, n_chars // 60 % 60) END AS lasted FROM documents")
def format_sizes(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", detect.format_bytes(F.col("n_chars")).alias("shown"), detect.format_duration(F.col("n_chars").cast("double")).alias("lasted"))


# -- checksums ------------------------------------------------------------------------------------------------------------

_BYTES = "list_transform(string_split({0}, ''), lambda c: ord(c)::bigint)"
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, " + _BYTES + "), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::bigint) ELSE x // 2 END)), 4294967295::bigint)"
_BZ2 = "xor(list_reduce(list_prepend(4294967295::bigint, " + _BYTES + "), lambda a, b: list_reduce([xor(a, b * 16777216), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x >= 2147483648 THEN xor((x * 2) % 4294967296, 79764919::bigint) ELSE x * 2 END)), 4294967295::bigint)"


@query(f"SELECT p_partkey, {_CRC.format('p_name')} AS crc, {_BZ2.format('p_name')} AS bz2_crc FROM part")
def checksum_rows(spark, sf_dir):
    body = F.encode("p_name", "UTF-8")
    return _table(spark, sf_dir, "part").select("p_partkey", checksums.gzip_crc32(body).alias("crc"), checksums.bz2_crc32(body).alias("bz2_crc"))


@query(f"SELECT n_regionkey, list_reduce(list_prepend(0::bigint, list(crc ORDER BY n_nationkey)), lambda a, c: xor((a * 2) % 4294967296 + a // 2147483648, c)) AS stream_crc FROM (SELECT n_regionkey, n_nationkey, {_CRC.format('n_name')} AS crc FROM nation) GROUP BY n_regionkey")
def stream_checksum_fold(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").withColumn("expected_crc", F.crc32(F.encode("n_name", "UTF-8")))
    return relational.stream_checksums(n, ["n_regionkey"], "n_nationkey")


@query(f"SELECT p_partkey, {_CRC.format('p_name || p_brand')} AS crc FROM part")
def checksum_combine(spark, sf_dir):
    a, b = F.encode("p_name", "UTF-8"), F.encode("p_brand", "UTF-8")
    return _table(spark, sf_dir, "part").select("p_partkey", checksums.crc32_combine(F.crc32(a), F.crc32(b), F.octet_length(b)).alias("crc"))


@query("SELECT doc_id, sha256(text) AS identity FROM documents")
def source_identity(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", checksums.source_identity(F.encode("text", "UTF-8")).alias("identity"))


# -- layouts -------------------------------------------------------------------------------------------------------------


def _conversations(spark, sf_dir) -> DataFrame:
    """(path, content): a gzip member for each turn of a conversation."""
    turns = codecs.compress(_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("plain")), "gzip").drop("plain")
    return turns.groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.hex("content").alias("h")))), lambda x: x["h"]), "")).alias("content"))


@query("SELECT cast(conv_id AS varchar) AS path, row_number() OVER w - 1 AS number, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS decoded_start, octet_length(encode(text)) AS decoded_bytes FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def gzip_member_layout(spark, sf_dir):
    return layout.containers(_conversations(spark, sf_dir)).select("path", "number", "decoded_start", "decoded_bytes")


@query("SELECT cast(conv_id AS varchar) AS path, count(*) AS members, sum(octet_length(encode(text)))::bigint AS decoded_bytes FROM conversations GROUP BY conv_id")
def gzip_block_rollup(spark, sf_dir):
    b = layout.blocks(_conversations(spark, sf_dir))
    return b.groupBy("path").agg(F.countDistinct("container").alias("members"), F.sum("decoded_bytes").cast("long").alias("decoded_bytes"))


@query(f"SELECT path, k AS number, k * {SMALL_CHUNK} AS decoded_start, least({SMALL_CHUNK}, n - k * {SMALL_CHUNK}) AS decoded_bytes FROM (SELECT path, octet_length(encode(text)) AS n, unnest(range((octet_length(encode(text)) + {SMALL_CHUNK - 1}) // {SMALL_CHUNK})) AS k FROM {_BUNDLES})")
def lz4_block_layout(spark, sf_dir):
    return layout.blocks(distributed.encode_lz4(_bundles(spark, sf_dir), block_size=SMALL_CHUNK)).select("path", "number", "decoded_start", "decoded_bytes")


@query(f"SELECT path, 0::bigint AS first_block, (n + {SMALL_CHUNK - 1}) // {SMALL_CHUNK} AS block_count, n AS decoded_bytes FROM (SELECT path, octet_length(encode(text)) AS n FROM {_BUNDLES})")
def container_rollup(spark, sf_dir):
    b = layout.blocks(distributed.encode_lz4(_bundles(spark, sf_dir), block_size=SMALL_CHUNK))
    return relational.rollup(b, ["path"], "number", "decoded_bytes")


@query("SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity::bigint) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS decoded_start FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)")
def decoded_offsets(spark, sf_dir):
    l = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("n"))  # noqa: E741
    return relational.decoded_offsets(l, ["l_orderkey"], ["l_linenumber"], "n").select("l_orderkey", "l_linenumber", "decoded_start")


@query("SELECT doc_id, k AS segment, k * 1000 AS start, least(1000, n - k * 1000) AS n FROM (SELECT doc_id, octet_length(encode(text)) AS n, unnest(range((octet_length(encode(text)) + 999) // 1000)) AS k FROM documents)")
def segment_layout(spark, sf_dir):
    return relational.segments(_table(spark, sf_dir, "documents"), "doc_id", F.octet_length(F.encode("text", "UTF-8")), 1000)


@query("SELECT p_partkey AS key, k AS segment, CASE WHEN k > 0 THEN right(substr(p_name, 1, k * 8), 5) END AS dictionary FROM part, unnest(range((length(p_name) + 7) // 8)) t(k)")
def segment_dictionary(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.encode("p_name", "UTF-8").alias("plain"))
    cut = relational.with_dictionary(distributed.pieces(p, "plain", 8), "path", "segment", "piece", 5)
    return cut.select(F.col("path").cast("long").alias("key"), F.col("segment").cast("long").alias("segment"), F.decode("dictionary", "UTF-8").alias("dictionary"))


@query(f"SELECT path, cast(path::int % 3 <> 0 AS int) AS violations, CASE path::int % 3 WHEN 1 THEN 'decoded gap' WHEN 2 THEN 'another source' END AS rule FROM {_BUNDLES}")
def index_check(spark, sf_dir):
    """Indexes of which every third is sound, has a shifted block, or is bound to another object."""
    coded = _coded_bundles(spark, sf_dir)
    kind = F.col("path").cast("int") % 3
    index = ranges.build_index(coded)
    index = index.withColumn("decoded_start", F.col("decoded_start") + F.when((kind == 1) & (F.col("number") == 0), 1).otherwise(0)).withColumn("source_len", F.col("source_len") + F.when(kind == 2, 1).otherwise(0))
    bad = ranges.check_index(index, coded).groupBy("path").agg(F.count("*").alias("n"), F.min("rule").alias("rule"))
    return index.select("path").distinct().join(bad, "path", "left").select("path", F.coalesce("n", F.lit(0)).cast("int").alias("violations"), "rule")


@query(f"SELECT path || ':' || s AS request, md5(substr(a, s + 1, 70000)) AS digest FROM (SELECT path, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS a FROM {_BUNDLES}), (VALUES (0), (33333)) t(s)")
def range_read(spark, sf_dir):
    plain = _bundles(spark, sf_dir).select("path", F.encode(F.regexp_replace(F.decode("plain", "UTF-8"), r"[^\x00-\x7F]", "?"), "UTF-8").alias("plain"))
    coded = codecs.compress(plain, "bzip2", level=1).drop("plain").persist()
    requests = coded.select("path", F.explode(F.array(F.lit(0).cast("long"), F.lit(33333).cast("long"))).alias("start")).select(F.concat("path", F.lit(":"), F.col("start").cast("string")).alias("request"), "path", "start", F.lit(70000).cast("long").alias("length"))
    return ranges.read_ranges(requests, ranges.build_index(coded), coded).select("request", F.md5("content").alias("digest"))


@query(f"SELECT path, 0::bigint AS stream_bit, 32::bigint AS first_block_bit, 1::bigint AS streams, 1::bigint AS ends, TRUE AS end_is_last, TRUE AS blocks_enough FROM {_BUNDLES}")
def scan_marks(spark, sf_dir):
    coded = _coded_bundles(spark, sf_dir)
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    found = relational.with_sound_streams(kept(layout.marks_in_chunks(coded, chunk=SMALL_CHUNK)))
    m = found.groupBy("path").agg(F.min(of("stream", "bit_offset")).alias("stream_bit"), F.min(of("block", "bit_offset")).alias("first_block_bit"), F.count(of("stream", "path")).alias("streams"), F.count(of("end", "path")).alias("ends"), (F.max(of("end", "bit_offset")) > F.max(of("block", "bit_offset"))).alias("end_is_last"), F.count(of("block", "path")).alias("n"))
    plain = _bundles(spark, sf_dir).select("path", F.octet_length("plain").alias("len"))
    # a block of level 1 takes 99,981 bytes after run-length coding, which adds a quarter at most
    return m.join(plain, "path").select("path", "stream_bit", "first_block_bit", "streams", "ends", "end_is_last", ((F.col("n") >= 1) & (F.col("n") <= F.ceil(F.col("len") * 1.25 / 99_981))).alias("blocks_enough"))


@query(f"SELECT path, TRUE AS enough, path::int % 2 = 1 AS over_limit FROM {_BUNDLES}")
def mark_sanity(spark, sf_dir):
    """Marks as they are found, twice each, and of odd objects more false ones than they could hold."""
    coded = _coded_bundles(spark, sf_dir)
    sources = coded.select("path", F.octet_length("content").alias("length"))
    found = layout.marks(coded).select("path", "kind", "bit_offset")
    false = sources.where(F.col("path").cast("int") % 2 == 1).select("path", F.lit("block").alias("kind"), F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("length") / 16) + 65)).alias("bit_offset"))
    m = relational.dedup_marks(found.unionByName(found).unionByName(false))
    too_many = relational.too_many_marks(m, sources)
    return m.groupBy("path").agg((F.count_if(F.col("kind") == "end") == 1).alias("enough")).join(too_many, "path", "left").select("path", "enough", F.col("marks").isNotNull().alias("over_limit"))


@query("SELECT cast(conv_id AS varchar) AS path, 'gzip' AS format, count(*) AS members, string_agg(octet_length(encode(text)), ',' ORDER BY turn) AS decoded FROM conversations GROUP BY conv_id")
def layout_json(spark, sf_dir):
    """The JSON report of each object, read again."""
    report = F.from_json("json", "format string, containers array<struct<decoded_bytes: long>>")
    got = layout.as_json(_conversations(spark, sf_dir)).withColumn("r", report)
    return got.select("path", "r.format", F.size("r.containers").cast("long").alias("members"), F.array_join(F.transform("r.containers", lambda m: m["decoded_bytes"].cast("string")), ",").alias("decoded"))


@query("SELECT cast(o_custkey AS varchar) AS path, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::int AS number, o_orderkey::bigint AS start_bit, lead(o_orderkey, 1, 1000000000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::bigint AS end_bit FROM (SELECT DISTINCT o_custkey % 3 AS o_custkey, o_orderkey FROM orders)")
def chain_walk(spark, sf_dir):
    """Chains of thousands of ranges, each of which ends where the next one begins, among ranges that nothing leads to."""
    o = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).cast("string").alias("path"), F.col("o_orderkey").cast("long").alias("start_bit")).distinct()
    w = Window.partitionBy("path").orderBy("start_bit")
    sound = o.withColumn("end_bit", F.lead("start_bit", 1, 1_000_000_000).over(w))
    stray = o.select("path", (-F.col("start_bit") - 2_000_000_000).alias("start_bit"), (-F.col("start_bit") - 1_900_000_000).alias("end_bit"))
    return relational.chain(sound.unionByName(stray), sound.groupBy("path").agg(F.min("start_bit").alias("start_bit")))


# -- archives --------------------------------------------------------------------------------------------------------------


def _pages(spark, sf_dir) -> DataFrame:
    """Entries of archives of ten pages."""
    p = _table(spark, sf_dir, "pages")
    return p.select(F.floor(F.col("page_id") / 10).cast("string").alias("archive"), F.format_string("pages/%d.html", "page_id").alias("path"), F.lit("file").alias("kind"), F.lit(0o640).alias("mode"), (1_700_000_000 + F.col("page_id")).cast("long").alias("mtime"), F.encode("html", "UTF-8").alias("content"))


_ENTRIES = "SELECT cast(page_id // 10 AS varchar) AS archive, 'pages/' || page_id || '.html' AS path, 416 AS mode, 1700000000 + page_id AS mtime, octet_length(encode(html)) AS n_bytes, md5(html) AS digest FROM pages"


def _read(df: DataFrame) -> DataFrame:
    return df.select("archive", "path", "mode", "mtime", F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


@query(_ENTRIES)
def zip_roundtrip(spark, sf_dir):
    return _read(archives.read_zip(archives.create_zip(_pages(spark, sf_dir)).withColumnRenamed("archive", "path")))


@query(_ENTRIES)
def tar_roundtrip(spark, sf_dir):
    return _read(archives.read_tar(archives.create_tar(_pages(spark, sf_dir), "gzip").withColumnRenamed("archive", "path")))


@query("SELECT archive, count(*) AS entries, sum(n_bytes)::bigint AS decoded_bytes FROM (" + _ENTRIES + ") GROUP BY archive")
def zip_listing(spark, sf_dir):
    e = archives.list_zip(archives.create_zip(_pages(spark, sf_dir)).withColumnRenamed("archive", "path"))
    return e.groupBy("archive").agg(F.count("*").alias("entries"), F.sum("decoded_bytes").cast("long").alias("decoded_bytes"))


def _path_entries(spark, sf_dir) -> DataFrame:
    """Names made of orders, with duplicates, files as folders and overlaps among them."""
    o = _table(spark, sf_dir, "orders")
    path = F.when(F.col("o_orderkey") % 7 == 0, F.lit("a")).when(F.col("o_orderkey") % 7 == 1, F.concat(F.lit("a/"), (F.col("o_orderkey") % 5).cast("string"))).otherwise(F.concat(F.lit("b/"), F.col("o_orderkey").cast("string")))
    return o.select(F.col("o_custkey").cast("string").alias("archive"), F.col("o_orderkey").alias("number"), path.alias("path"), F.lit("file").alias("kind"), (F.col("o_orderkey") * 10).alias("data_start"), (F.col("o_totalprice") % 40000).cast("long").alias("compressed_bytes"))


_PATHS = "(SELECT cast(o_custkey AS varchar) AS archive, o_orderkey AS number, CASE WHEN o_orderkey % 7 = 0 THEN 'a' WHEN o_orderkey % 7 = 1 THEN 'a/' || (o_orderkey % 5) ELSE 'b/' || o_orderkey END AS path, o_orderkey * 10 AS data_start, floor(o_totalprice % 40000)::bigint AS compressed_bytes FROM orders)"


@query(f"SELECT archive, path, count(*) AS n FROM {_PATHS} GROUP BY ALL HAVING count(*) > 1")
def zip_duplicates(spark, sf_dir):
    return archives.duplicates(_path_entries(spark, sf_dir))


@query(f"SELECT x.archive, x.path, 'a' AS ancestor FROM {_PATHS} x WHERE x.path LIKE 'a/%' AND EXISTS (SELECT 1 FROM {_PATHS} y WHERE y.archive = x.archive AND y.path = 'a')")
def zip_ancestors(spark, sf_dir):
    return archives.bad_ancestors(_path_entries(spark, sf_dir))


@query(f"SELECT archive, number, next FROM (SELECT archive, number, data_start + compressed_bytes AS e, lead(number) OVER w AS next, lead(data_start) OVER w AS s FROM {_PATHS} WHERE compressed_bytes > 0 WINDOW w AS (PARTITION BY archive ORDER BY data_start, number)) WHERE s < e")
def zip_overlaps(spark, sf_dir):
    return archives.overlaps(_path_entries(spark, sf_dir))


@query("SELECT o_orderkey, o_orderkey % 4 = 0 AS safe FROM orders")
def zip_safe_names(spark, sf_dir):
    k = F.col("o_orderkey")
    bad = F.try_element_at(F.array(*map(F.lit, ("a/../b", "/a", "a//b"))), F.greatest(k % 4, F.lit(1)).cast("int"))
    good = F.concat(F.lit("a/b"), k.cast("string"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", archives.is_safe(F.when(k % 4 == 0, good).otherwise(bad)).alias("safe"))


@query("SELECT o_orderkey, o_orderkey % 3 <> 0 AS stays FROM orders")
def symlink_policy(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    target = F.when(k == 0, F.lit("../../../x")).when(k == 1, F.lit("../x/./y")).otherwise(F.lit("z"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", archives.symlink_stays(F.lit("a/b/link"), target).alias("stays"))


@query("SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) = 1 THEN o_totalprice >= 16.777216e3 ELSE o_totalprice >= 67.108864e3 END AS large FROM orders")
def zip_scheduling(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "archive")
    return o.select("o_orderkey", archives.is_large(F.col("o_totalprice") * 1000).alias("large"))


# -- transforms ------------------------------------------------------------------------------------------------------------


@query("WITH b AS (SELECT n_nationkey, unnest(string_split(n_name, '')) AS c, generate_subscripts(string_split(n_name, ''), 1) - 1 AS i FROM nation), r AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY i) - row_number() OVER (PARTITION BY n_nationkey, c ORDER BY i) AS g FROM b) SELECT n_nationkey, min(i)::bigint AS start, ord(c) AS b, count(*) AS n FROM r GROUP BY n_nationkey, c, g")
def rle1_groups(spark, sf_dir):
    return relational.runs(_table(spark, sf_dir, "nation"), "n_nationkey", "n_name")


@query("SELECT p_partkey, string_agg(right(r, 1), '' ORDER BY r, i) AS last FROM (SELECT p_partkey, i, substr(p_name, i + 1) || substr(p_name, 1, i) AS r FROM part, unnest(range(length(p_name))) t(i)) GROUP BY p_partkey")
def bwt_last_column(spark, sf_dir):
    return relational.bwt_last_column(_table(spark, sf_dir, "part"), "p_partkey", "p_name").select("p_partkey", "last")


@query("WITH b AS (SELECT n_nationkey AS k, unnest(string_split(n_name, '')) AS c, generate_subscripts(string_split(n_name, ''), 1) AS i FROM nation), p AS (SELECT k, c, i, (SELECT max(i) FROM b y WHERE y.k = x.k AND y.c = x.c AND y.i < x.i) AS before FROM b x), s AS (SELECT k, i, CASE WHEN before IS NOT NULL THEN (SELECT count(DISTINCT c) FROM b y WHERE y.k = p.k AND y.i > p.before AND y.i < p.i) ELSE (SELECT count(DISTINCT c) FROM b y WHERE y.k = p.k AND y.i < p.i) + ord(c) - (SELECT count(DISTINCT y.c) FROM b y WHERE y.k = p.k AND y.i < p.i AND ord(y.c) < ord(p.c)) END AS m FROM p) SELECT k AS n_nationkey, string_agg(m, ',' ORDER BY i) AS symbols FROM s GROUP BY k")
def mtf_symbols(spark, sf_dir):
    return relational.mtf_symbols(_table(spark, sf_dir, "nation"), "n_nationkey", "n_name").select("n_nationkey", F.array_join(F.col("symbols").cast("array<string>"), ",").alias("symbols"))


@query("SELECT p_partkey, ord(c) AS b, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part) GROUP BY ALL")
def byte_histogram(spark, sf_dir):
    return relational.byte_histogram(_table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query("SELECT doc_id, CASE WHEN n_chars < 200 THEN 2 WHEN n_chars < 600 THEN 3 WHEN n_chars < 1200 THEN 4 WHEN n_chars < 2400 THEN 5 ELSE 6 END AS groups FROM documents")
def huffman_group_count(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", relational.huffman_groups(F.col("n_chars")).alias("groups"))


@query("SELECT lang, sum(octet_length(encode(text)))::bigint AS total FROM documents GROUP BY lang HAVING total > 100000")
def over_output_limit(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("lang", F.octet_length(F.encode("text", "UTF-8")).alias("n"))
    return relational.over_limit(d, "lang", "n", 100000)


@query("SELECT doc_id, kind, kind = 'digest' OR octet_length(encode(text)) = 0 AS stored FROM documents, (VALUES ('digest'), ('repeated')) t(kind)")
def stored_choice(spark, sf_dir):
    """Digests, which no code makes smaller, and texts repeated, which every code does."""
    d = _table(spark, sf_dir, "documents")
    plain = d.select("doc_id", F.lit("digest").alias("kind"), F.unhex(F.md5("text")).alias("plain")).unionByName(d.select("doc_id", F.lit("repeated").alias("kind"), F.encode(F.repeat("text", F.lit(16)), "UTF-8").alias("plain")))
    return codecs.deflate(plain).select("doc_id", "kind", relational.smaller(F.col("plain"), F.col("content")).alias("stored"))
