"""Named queries over the test tables and the SQL each must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.durations import duration_seconds
from quern.functions.wire import record_size, vint_size
from quern.operators import exchange, merge, reduce, validate
from quern.plans import analytics, workloads
from quern.sources import generators, segments
from quern.sources.shared import shared_dir, written
from quern.sources.tables import load
from quern.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SPLITS = (1000, 4000, 9000, 30000, 100000)
LINE_KEYS = ["l_orderkey", "l_linenumber"]
#: Keys of either sign, each once.
SIGNED_SQL = "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END"
CENTS = "CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def sorted_lineitem_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: lineitem sorted over all partitions, and what each partition holds."""
    lines = load(spark, sf_dir, "lineitem").select(*LINE_KEYS)
    found = validate.partition_summary(exchange.sorted_partitions(lines, LINE_KEYS), LINE_KEYS)
    end = lambda which: [F.col(f"{which}.t0").alias(f"{which}_orderkey"), F.col(f"{which}.t1").alias(f"{which}_linenumber")]
    return found.select("part", "rows", "violations", *end("first"), *end("last"))


# Exchange


@query(f"""SELECT {" + ".join(f"CAST(l_orderkey >= {s} AS INTEGER)" for s in SPLITS)} AS part, count(*) AS n, min(l_orderkey) AS least, max(l_orderkey) AS most FROM lineitem GROUP BY 1""")
def range_partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = exchange.range_partition(F.col("l_orderkey"), SPLITS)
    return load(spark, sf_dir, "lineitem").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("least"), F.max("l_orderkey").alias("most"))


@query("SELECT CAST(((l_orderkey % 16) + 16) % 16 AS INTEGER) AS part, count(*) AS n FROM lineitem GROUP BY 1")
def hash_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy(exchange.modulo_partition(F.col("l_orderkey"), 16).alias("part")).agg(F.count(F.lit(1)).alias("n"))


DIRECTORY_SQL = """SELECT CAST(l_orderkey % 16 AS INTEGER) AS part, count(*) AS records, CAST(sum(8 + octet_length(encode(l_returnflag || l_linestatus))) AS BIGINT) AS length FROM lineitem GROUP BY 1"""


def _directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    length = F.lit(8) + F.octet_length(F.concat("l_returnflag", "l_linestatus"))
    return exchange.partition_directory(lines, exchange.modulo_partition(F.col("l_orderkey"), 16), length)


@query(f"""WITH d AS ({DIRECTORY_SQL}) SELECT part, records, length, CAST(coalesce(sum(length) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d""")
def partition_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _directory(spark, sf_dir)


@query(f"""WITH d AS ({DIRECTORY_SQL}), s AS (SELECT *, CAST(coalesce(sum(length) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
    c AS (SELECT *, unnest(generate_series(0, (length - 1) // 4096)) AS chunk FROM s WHERE length > 0)
    SELECT part, chunk, start + chunk * 4096 AS "offset", least(4096, length - chunk * 4096) AS length FROM c""")
def chunk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.chunk_requests(_directory(spark, sf_dir), 4096)


# Order and merge


@query(f"SELECT {SIGNED_SQL} AS key, row_number() OVER (ORDER BY {SIGNED_SQL}) AS rank FROM orders")
def merge_rank_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.key_ranks(load(spark, sf_dir, "orders").select(F.expr(SIGNED_SQL).alias("key")), ["key"]).select("key", "rank")


@query(f"SELECT {SIGNED_SQL} AS key, row_number() OVER (ORDER BY {SIGNED_SQL} < 0, {SIGNED_SQL}) AS rank FROM orders")
def merge_rank_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.key_ranks(load(spark, sf_dir, "orders").select(F.expr(SIGNED_SQL).alias("key")), ["key"], mode="bytes").select("key", "rank")


@query("SELECT doc_id, dense_rank() OVER (ORDER BY text) AS dense_rank, rank() OVER (ORDER BY text) AS rank FROM documents")
def text_key_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.global_rank(load(spark, sf_dir, "documents").select("doc_id", "text"), ["text"]).select("doc_id", "dense_rank", "rank")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY unhex(md5(CAST(o_orderkey AS VARCHAR)))) AS rank FROM orders")
def binary_key_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = load(spark, sf_dir, "orders").select("o_orderkey", F.unhex(F.md5(F.col("o_orderkey").cast("string").cast("binary"))).alias("key"))
    return merge.global_rank(keyed, ["key"]).select("o_orderkey", "rank")


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies, CAST(sum(count(*)) OVER (ORDER BY l_orderkey, l_linenumber) - count(*) + 1 AS BIGINT) AS rank FROM lineitem GROUP BY 1, 2")
def sorted_run_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-way merge of the runs that the return flags make, whatever these are, in one scan; ranks say its order, so it needs no sort of its own."""
    return merge.key_ranks(load(spark, sf_dir, "lineitem").select(*LINE_KEYS), LINE_KEYS).select(*LINE_KEYS, "copies", "rank")


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted multiset union of two runs and an empty one."""
    lines = load(spark, sf_dir, "lineitem").select(*LINE_KEYS)
    odd = F.coalesce(F.col("l_orderkey") % 2 == 1, F.lit(False))
    return merge.merged_runs([lines.filter(odd), lines.filter(F.lit(False)), lines.filter(~odd)], LINE_KEYS)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def topk_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.top_k(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 25, desc=True)


@query("SELECT o_custkey, o_orderkey, position FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS position FROM orders) WHERE position <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.top_k_per_group(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 3)


# Validation


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS violations, CAST(0 AS BIGINT) AS overlaps, true AS ok FROM lineitem")
def sort_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(*LINE_KEYS)
    return validate.validate_sorted(exchange.sorted_partitions(lines, LINE_KEYS), LINE_KEYS).select("rows", "violations", "overlaps", "ok")


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS violations, CAST(0 AS BIGINT) AS overlaps, true AS ok FROM lineitem")
def files_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part files of a written sort, in the order of their names."""
    path = f"{shared_dir(spark)}/quern/{uuid.uuid4().hex}"
    exchange.sorted_partitions(load(spark, sf_dir, "lineitem").select(*LINE_KEYS), LINE_KEYS).write.parquet(path)
    return validate.validate_files(spark, path, LINE_KEYS).select("rows", "violations", "overlaps", "ok")


@query(f"SELECT s.side, count(*) AS rows, {CENTS} AS cents, CAST(sum(octet_length(encode(l_returnflag))) AS BIGINT) AS bytes FROM lineitem, (VALUES ('in'), ('out')) s(side) GROUP BY 1")
def checksum_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag")
    out = written(exchange.sorted_partitions(lines, ["l_orderkey"]))
    sums = [F.count(F.lit(1)).alias("rows"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.sum(F.octet_length("l_returnflag")).alias("bytes")]
    return lines.agg(F.lit("in").alias("side"), *sums).unionByName(out.agg(F.lit("out").alias("side"), *sums))


@query("SELECT l_orderkey, l_linenumber, count(*) AS surplus FROM lineitem WHERE false GROUP BY 1, 2")
def sort_lost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a written sort has lost or added: none."""
    lines = load(spark, sf_dir, "lineitem").select(*LINE_KEYS)
    return validate.multiset_difference(lines, written(exchange.sorted_partitions(lines, LINE_KEYS)))


@query("SELECT count(*) AS rows_in, count(*) AS rows_out, CAST(sum(octet_length(encode(text)) + octet_length(encode(source))) AS BIGINT) AS bytes_in, CAST(sum(octet_length(encode(text)) + octet_length(encode(source))) AS BIGINT) AS bytes_out, true AS valid FROM documents")
def storage_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workloads.storage_round_trip(load(spark, sf_dir, "documents"), f"{shared_dir(spark)}/quern/{uuid.uuid4().hex}", "text", "source")


# Records and segments


VINT_SQL = "CASE WHEN {x} BETWEEN -112 AND 127 THEN 1 ELSE (length(bin(CASE WHEN {x} < 0 THEN ~({x}) ELSE {x} END)) + 7) // 8 + 1 END"


@query(f"SELECT o_orderkey, CAST({VINT_SQL.format(x='o_orderkey * 1000003')} AS INTEGER) AS key_vint, CAST({VINT_SQL.format(x='-(o_orderkey + 100)')} AS INTEGER) AS negative_vint, CAST(2 + 8 + octet_length(encode(o_orderpriority)) AS BIGINT) AS record_bytes FROM orders")
def record_wire_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", vint_size(k * 1000003).alias("key_vint"), vint_size(-(k + 100)).alias("negative_vint"), record_size(F.lit(8), F.octet_length("o_orderpriority")).alias("record_bytes"))


def _segments(spark: SparkSession, sf_dir: str, codec: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").cast("binary").alias("key"), F.col("o_orderpriority").cast("binary").alias("value"))
    back = segments.decode_segments(written(segments.encode_segments(orders, n=8, codec=codec, block_bytes=16_384)), codec)
    return back.groupBy(F.col("value").cast("string").alias("o_orderpriority")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("key").cast("string").cast("long")).alias("keys"))


SEGMENT_SQL = "SELECT o_orderpriority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1"


@query(SEGMENT_SQL)
def segments_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, "none")


@query(SEGMENT_SQL)
def segments_snappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, "snappy")


@query(SEGMENT_SQL)
def segments_lz4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, "lz4")


@query(SEGMENT_SQL)
def segments_zlib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, "zlib")


@query(SEGMENT_SQL)
def segments_lzo1x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, "lzo1x")


def _run_files(spark: SparkSession, sf_dir: str, codec: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").cast("binary").alias("key"), F.col("o_orderpriority").cast("binary").alias("value"))
    # A path with its scheme, as Python tasks open it.
    folder = f"{shared_dir(spark)}/quern/{uuid.uuid4().hex}"
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    return written(segments.write_run_files(segments.encode_segments(orders, n=8, codec=codec, block_bytes=16_384), folder))


def _by_priority(records: DataFrame) -> DataFrame:
    return records.groupBy(F.col("value").cast("string").alias("o_orderpriority")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("key").cast("string").cast("long")).alias("keys"))


@query(SEGMENT_SQL)
def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as run files, and read again whole."""
    paths = [r["path"] for r in _run_files(spark, sf_dir, "snappy").select("path").collect()]  # a file for each of 8 partitions
    return _by_priority(segments.read_run_files(spark, paths, "snappy"))


@query(SEGMENT_SQL)
def ranged_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as run files, fetched by ranges, and stitched where ranges cut records."""
    return _by_priority(segments.decode_chunks(segments.read_ranges(segments.file_chunks(_run_files(spark, sf_dir, "none"), 4096))))


# Reduction


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \t\n\r\f]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.wordcount(load(spark, sf_dir, "documents"))


@query("SELECT user_id, min(event_id) AS winner, count(*) AS successes FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1")
def dedup_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.first_success(load(spark, sf_dir, "events"), "user_id", "event_id", "event_type", ["purchase", "signup"])


@query("""WITH a AS (SELECT user_id, event_id % 7 AS attempt, min(event_id) FILTER (WHERE event_type = 'purchase') AS ok, max(event_id) FILTER (WHERE event_type = 'error') AS gone, count(*) FILTER (WHERE event_type = 'purchase') AS n FROM events GROUP BY 1, 2),
    t AS (SELECT user_id, min(struct_pack(ok := ok, attempt := attempt, gone := gone)) AS f, CAST(sum(n) AS BIGINT) AS successes FROM a WHERE ok IS NOT NULL GROUP BY 1)
    SELECT user_id, f.attempt AS winner, successes, coalesce(f.gone > f.ok, false) AS revoked FROM t""")
def revoked_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First successes by the order of their reports, and which of them were taken back later."""
    events = load(spark, sf_dir, "events").withColumn("attempt", F.col("event_id") % 7)
    return reduce.first_success(events, "user_id", "attempt", "event_type", ["purchase"], "event_id", ["error"], "mark")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1, 2")
def reduce_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return reduce.reduce_groups(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"), cents.alias("cents"), F.min("l_shipdate").alias("first_ship"))


@query("SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def reduce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python reducer that sees its group's rows some at a time."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return reduce.reduce_stream(orders, ["o_custkey"], lambda s, rows: (s[0] + len(rows), s[1] + int(rows["o_orderkey"].sum())), lambda: (0, 0), lambda key, s: (key[0], *s), "o_custkey long, n long, keys long")


# Generators and workloads


@query("SELECT i AS row_id, upper(substr(md5('k:' || i), 1, 20)) AS key_hex, row_number() OVER (ORDER BY unhex(substr(md5('k:' || i), 1, 20))) AS rank, CAST(90 AS INTEGER) AS value_bytes FROM range((SELECT count(*) FROM orders)) t(i)")
def generated_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many records as there are orders, so that the sort grows with the input."""
    records = generators.sort_records(spark, load(spark, sf_dir, "orders").count())
    return merge.global_rank(records, ["key"]).select("row_id", F.hex("key").alias("key_hex"), "rank", F.octet_length("value").alias("value_bytes"))


_HEX = "CAST(('0x' || substr(md5('{salt}:' || {x}), 1, 8)) AS BIGINT)"


@query(f"""WITH r AS (SELECT i, 5 + {_HEX.format(salt='words', x='i')} % 21 AS n FROM range((SELECT count(*) FROM orders)) t(i)), d AS (SELECT i, unnest(range(n)) AS k FROM r)
    SELECT list_extract({generators.VOCABULARY!r}, 1 + {_HEX.format(salt='word', x='(i * 1000 + k)')} % {len(generators.VOCABULARY)}) AS word, count(*) AS n FROM d GROUP BY 1""")
def generated_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.wordcount(generators.random_text(spark, load(spark, sf_dir, "orders").count()))


@query(f"SELECT i AS row_id, CAST(5 + {_HEX.format(salt='na', x='i')} % 6 AS INTEGER) AS key_bytes, CAST(20 + {_HEX.format(salt='nb', x='i')} % 41 AS INTEGER) AS value_bytes FROM range((SELECT count(*) FROM orders)) t(i)")
def generated_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.random_records(spark, load(spark, sf_dir, "orders").count()).select("row_id", F.octet_length("key").alias("key_bytes"), F.octet_length("value").alias("value_bytes"))


_AT = f"(CAST((i * {{step}}) % {workloads.MODULUS} AS DOUBLE) / {workloads.MODULUS} - 0.5)"
_SQUARE = f"{_AT.format(step=workloads.STEP_X)} * {_AT.format(step=workloads.STEP_X)} + {_AT.format(step=workloads.STEP_Y)} * {_AT.format(step=workloads.STEP_Y)}"


@query(f"SELECT count(*) AS points, count(*) FILTER (WHERE {_SQUARE} <= 0.25) AS inside, count(*) FILTER (WHERE {_SQUARE} <= 0.25) * 4.0 / count(*) AS estimate, true AS close FROM range({workloads.MAPS * workloads.SAMPLES}) t(i)")
def pi_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workloads.pi_estimate(spark)


# Analytics


@query("WITH e AS (SELECT user_id AS file, event_id AS row, epoch_us(ts) // 1000000 AS s FROM events), g AS (SELECT file, row, s - lag(s) OVER (PARTITION BY file ORDER BY row) AS gap FROM e) SELECT file, row, gap FROM g WHERE gap > 10")
def log_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.log_gaps(load(spark, sf_dir, "events", instants=True), "user_id", "event_id", "ts")


@query("""WITH s AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS start FROM events),
    r AS (SELECT *, CAST(sum(start) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM s)
    SELECT user_id, run, event_type, count(*) AS n, round(avg(value), 6) AS average, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM r GROUP BY 1, 2, 3""")
def rollup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    found = analytics.rollup_runs(events, ["user_id"], ["event_id"], "event_type", ["value"], ["cents"])
    return found.select("user_id", F.col("run").cast("long"), "event_type", "n", F.round("avg_value", 6).alias("average"), F.col("sum_cents").alias("cents"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS average, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS std_dev FROM events GROUP BY 1")
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.stats_summary(load(spark, sf_dir, "events"), "value", ["event_type"]).withColumns({c: F.round(c, 6) for c in ("average", "std_dev")})


_CUT = "CASE WHEN {x} < 0 THEN ceil({x} * 100) ELSE floor({x} * 100) END / 100"


@query(f"SELECT l_returnflag, count(l_quantity) AS n, {_CUT.format(x='avg(l_quantity)')} AS average, {_CUT.format(x='min(l_quantity)')} AS least, {_CUT.format(x='max(l_quantity)')} AS most, {_CUT.format(x='stddev_pop(l_quantity)')} AS std_dev FROM lineitem GROUP BY 1")
def stats_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary statistics as reports print them: cut to two decimal places."""
    return analytics.stats_summary(load(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"], places=2)


@query("""WITH f AS (SELECT o_orderpriority, o_orderkey * 1000.0 / 1e6 AS mb, 0.5 + o_orderkey % 10 AS s FROM orders)
    SELECT o_orderpriority, count(*) AS files, round(sum(mb), 6) AS mb, round(sum(mb) / sum(s), 6) AS throughput, round(avg(mb / s), 6) AS average_rate, round(stddev_pop(mb / s), 6) AS std_dev FROM f GROUP BY 1""")
def io_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a storage benchmark over one file for each order."""
    files = load(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderkey") * 1000).alias("bytes"), (0.5 + F.col("o_orderkey") % 10).alias("seconds"))
    found = analytics.io_report(files, group=["o_orderpriority"])
    return found.withColumns({c: F.round(c, 6) for c in ("mb", "throughput", "average_rate", "std_dev")})


@query("SELECT 4 AS files, 4 * 300000 AS bytes, true AS timed FROM range(1)")
def storage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A storage benchmark's own run: files written, read and removed; what was read, and whether all took time."""
    folder = f"{shared_dir(spark)}/quern/{uuid.uuid4().hex}"
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    written(workloads.storage_files(spark, folder, 4, 300_000, "write"))
    found = written(workloads.storage_files(spark, folder, 4, 300_000, "read"))
    written(workloads.storage_files(spark, folder, 4, 300_000, "clean"))
    return found.agg(F.count(F.lit(1)).cast("int").alias("files"), F.sum("bytes").cast("int").alias("bytes"), (F.min("seconds") > 0).alias("timed"))


@query("""WITH t AS (SELECT o_custkey, count(*) AS launched, count(*) FILTER (WHERE o_orderstatus = 'F') // 3 AS failed, count(*) FILTER (WHERE o_orderpriority LIKE '1%') // 4 AS killed, max(o_totalprice) AS most FROM orders GROUP BY 1),
    b AS (SELECT *, CASE WHEN launched <> failed + killed THEN ((failed + killed) * 100) // (launched - failed - killed) END AS bad FROM t)
    SELECT o_custkey, launched, bad, CASE WHEN most > 450000 THEN 'fatal' WHEN coalesce(bad >= 10, true) THEN 'error' WHEN killed > 0 THEN 'warn' ELSE 'success' END AS status FROM b""")
def classify_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("launched"), F.floor(F.count_if(F.col("o_orderstatus") == "F") / 3).alias("failed"), F.floor(F.count_if(F.col("o_orderpriority").startswith("1")) / 4).alias("killed"), F.max("o_totalprice").alias("most")
    )
    bad = analytics.bad_share(F.col("launched"), F.col("failed"), F.col("killed"))
    status = analytics.classify(F.col("most") > 450000, F.coalesce(F.col("bad") >= analytics.BAD_TASKS, F.lit(True)), F.col("killed") > 0)
    return jobs.withColumn("bad", bad).select("o_custkey", "launched", "bad", status.alias("status"))


@query("WITH b AS (SELECT user_id, min(event_id) AS a, max(event_id) AS z FROM events WHERE event_type = 'error' GROUP BY 1) SELECT e.user_id, e.event_id, e.event_type FROM events e JOIN b ON e.user_id = b.user_id AND e.event_id BETWEEN b.a - 1000 AND b.z + 1000")
def log_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.log_snippet(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error")


@query("SELECT event_id, event_id % 30 * 3600 + event_id % 60 * 60 + event_id % 59 AS seconds FROM events")
def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    text = F.concat_ws(", ", *[F.concat((k % n).cast("string"), F.lit(u)) for n, u in ((30, "hrs"), (60, "mins"), (59, "sec"))])
    return load(spark, sf_dir, "events").select("event_id", duration_seconds(text).alias("seconds"))


# Extensions: what consumes a sorted exchange


@query("SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return orders.hint("merge").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 200000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey").join(load(spark, sf_dir, "orders").filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT user_id, event_id, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS change FROM events")
def window_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("user_id").orderBy("event_id")
    return load(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(F.col("value") - F.lag("value").over(own), F.lit(0.0)).alias("change"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def shared_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(load(spark, sf_dir, "supplier").select("s_nationkey"))


TUMBLING_SQL = "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_us, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query(TUMBLING_SQL)
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.tumbling_counts(load(spark, sf_dir, "events", instants=True), "1 hour", "event_type")
    return found.select(F.unix_micros("window_start").alias("window_us"), "event_type", "n")


@query(TUMBLING_SQL)
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream that has read the whole table."""
    stream = windows.tumbling_counts(windows.event_stream(spark, f"{sf_dir}/events.parquet*"), "1 hour", "event_type")
    return windows.drained(stream).select(F.unix_micros("window_start").alias("window_us"), "event_type", "n")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS start FROM events),
    n AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n FROM n GROUP BY user_id, session""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.session_counts(load(spark, sf_dir, "events", instants=True), "30 minutes", "user_id")
    return found.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@query("WITH g AS (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events) SELECT user_id, epoch_us(ts) AS at_us, gap AS gap_us FROM g WHERE gap > 3600000000")
def stream_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of over an hour, by keyed state, of a stream that has read the whole table."""
    found = windows.drained(windows.stream_gaps(windows.event_stream(spark, f"{sf_dir}/events.parquet*"), "user_id", "ts", 3600.0), mode="append")
    return found.select("user_id", F.unix_micros("ts").alias("at_us"), F.round(F.col("gap") * 1_000_000).cast("long").alias("gap_us"))
