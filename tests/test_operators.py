"""Operators against plain Python."""

import random
import tracemalloc
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import lzo, wire
from quern.functions.durations import duration_seconds
from quern.operators import exchange, merge, ordering, reduce, validate
from quern.plans import analytics, workloads
from quern.sources import generators, segments

LONGS = [0, 1, -1, 127, 128, -112, -113, 255, 256, 2**31, -(2**31), 2**63 - 1, -(2**63), 5, 5, 5]


def bytes_order(x):
    return (x < 0, x)


@pytest.mark.parametrize("mode, key", [("signed", lambda x: x), ("bytes", bytes_order)])
@pytest.mark.parametrize("desc", [False, True])
def test_integer_orders(spark, mode, key, desc):
    df = spark.createDataFrame([(x,) for x in LONGS], "k long")
    found = [r.k for r in exchange.sorted_partitions(df, ["k"], 3, mode=mode, desc=desc).collect()]
    assert found == sorted(LONGS, key=key, reverse=desc)
    if not desc and mode == "bytes":
        assert found == sorted(LONGS, key=lambda x: x.to_bytes(8, "big", signed=True))


def test_text_and_binary_orders(spark):
    texts = ["", "a", "aa", "b", "é", "z", "𝄞", "￿", "Z", "ab"]
    df = spark.createDataFrame([(t, bytearray(t.encode())) for t in texts], "t string, b binary")
    expected = sorted(texts, key=lambda t: t.encode())
    for key in ("t", "b"):
        assert [r.t for r in exchange.sorted_partitions(df, [key], 4).collect()] == expected


def test_unsupported_keys_and_modes(spark):
    df = spark.createDataFrame([([1],)], "k array<int>")
    with pytest.raises(TypeError):
        ordering.order_exprs(df, ["k"])
    with pytest.raises(ValueError):
        ordering.order_exprs(df, ["k"], mode="other")
    with pytest.raises(ValueError):
        exchange.sorted_partitions(spark.range(3), ["id"], partitioner="other")


@pytest.mark.parametrize("partitioner", ["range", "hash"])
def test_exchange_keeps_rows_and_sorts_partitions(spark, partitioner):
    df = spark.range(2000).select((F.col("id") * 7919 % 501 - 250).alias("k"), F.lit("v").alias("v"))
    out = exchange.sorted_partitions(df, ["k"], 5, partitioner)
    assert not validate.multiset_difference(df, out).count()
    assert validate.checksum(df).first() == validate.checksum(out).first()
    parts = validate.partition_summary(out, ["k"]).collect()
    assert sum(p.rows for p in parts) == 2000 and all(p.violations == 0 for p in parts)
    assert validate.validate_sorted(out, ["k"]).first().ok == (partitioner == "range")


def test_sort_plan_is_one_range_exchange(spark):
    plan = exchange.sorted_partitions(spark.range(10), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Python" not in plan


def test_validators_see_faults(spark):
    bad = spark.createDataFrame([(3,), (1,), (2,)], "k int").coalesce(1)
    assert validate.validate_sorted(bad, ["k"]).first().violations == 1
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    assert {(r.k, r.surplus) for r in validate.multiset_difference(a, b).collect()} == {(1, 1), (2, -1)}
    assert validate.checksum(a).first() != validate.checksum(b).first()


def test_validators_take_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a"), (1, None), (1, "b"), (None, None)], "k int, s string")
    out = exchange.sorted_partitions(df, ["k", "s"], 2)
    assert validate.validate_sorted(out, ["k", "s"]).first().ok
    found = validate.validate_sorted(exchange.sorted_partitions(df.limit(0), ["k", "s"], 2), ["k", "s"]).first()
    assert (found.rows, found.partitions, found.ok) == (0, 0, True)


def test_sort_workload_validates_its_files(spark, tmp_path):
    found = workloads.sort_workload(generators.sort_records(spark, 3000), f"file://{tmp_path}/sorted", ["key"], 4)
    assert found["sorted"] and found["same"] and found["rows"] == 3000
    spark.range(100).orderBy(F.col("id").desc()).write.parquet(f"file://{tmp_path}/unsorted")
    assert not validate.validate_files(spark, f"file://{tmp_path}/unsorted", ["id"]).first().ok


def test_ranks_with_a_hot_key(spark):
    values = [7] * 500 + list(range(200)) + [None] * 3
    df = spark.createDataFrame([(v,) for v in values], "k int")
    ranks = {(r.k, r["rank"], r.dense_rank) for r in merge.global_rank(df, ["k"], 4).collect()}
    ordered = sorted(values, key=lambda v: (v is not None, v or 0))
    distinct = list(dict.fromkeys(ordered))
    assert ranks == {(v, ordered.index(v) + 1, distinct.index(v) + 1) for v in distinct}
    assert merge.global_rank(df, ["k"], 4).count() == len(values)


def test_merge_of_uneven_runs(spark):
    runs = [[], [5], [1, 5, 9], list(range(50))]
    frames = [spark.createDataFrame([(x,) for x in r], "k int") for r in runs]
    assert [r.k for r in merge.merged_runs(frames, ["k"], 3).collect()] == sorted(x for r in runs for x in r)
    with pytest.raises(ValueError):
        merge.merged_runs([], ["k"])


def test_top_k(spark):
    df = spark.range(1000).select((F.col("id") * 31 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    assert [r.k for r in merge.top_k(df, ["k"], 5).collect()] == [0, 1, 2, 3, 4]
    best = merge.top_k_per_group(df, ["g"], ["k"], 2, desc=True).collect()
    assert len(best) == 6 and {r.position for r in best} == {1, 2}


def test_directory_and_chunks(spark):
    df = spark.createDataFrame([(0, 10), (2, 5), (0, 7), (3, 0)], "p int, n int")
    index = exchange.partition_directory(df, F.col("p"), F.col("n"))
    assert [tuple(r) for r in index.orderBy("part").collect()] == [(0, 2, 17, 0), (2, 1, 5, 17), (3, 1, 0, 22)]
    chunks = exchange.chunk_requests(index, 8).orderBy("offset").collect()
    assert [(r.part, r.chunk, r.offset, r.length) for r in chunks] == [(0, 0, 0, 8), (0, 1, 8, 8), (0, 2, 16, 1), (2, 0, 17, 5)]


def test_stream_reducer_holds_groups_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
        out = reduce.reduce_stream(df, ["k"], lambda s, rows: s + int(rows["v"].sum()), int, lambda key, s: (key[0], s), "k long, total long")
        assert {tuple(r) for r in out.collect()} == {(k, sum(range(k, 300, 3))) for k in range(3)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_wordcount(spark):
    df = spark.createDataFrame([("a b\ta",), (None,), ("",), ("  b\nc ",)], "text string")
    assert {r.word: r.n for r in reduce.wordcount(df).collect()} == {"a": 2, "b": 2, "c": 1}


@given(st.lists(st.one_of(st.integers(-(2**63), 2**63 - 1), st.integers(-300, 300)), max_size=30))
def test_vints_round_trip(numbers):
    data = b"".join(map(wire.encode_vint, numbers))
    at, out = 0, []
    while at < len(data):
        x, at = wire.decode_vint(data, at)
        out.append(x)
    assert out == numbers


def test_vint_sizes_agree_with_encoding(spark):
    df = spark.createDataFrame([(x,) for x in LONGS], "k long")
    assert all(r.n == len(wire.encode_vint(r.k)) for r in df.select("k", wire.vint_size(F.col("k")).alias("n")).collect())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=200), st.binary(max_size=300)), max_size=20))
def test_records_round_trip(records):
    data = b"".join(wire.encode_record(k, v) for k, v in records) + wire.encode_vint(-1) * 2
    assert list(wire.decode_records(data)) == records
    assert list(wire.decode_records(data + b"ignored")) == records


def test_broken_runs_are_refused():
    data = wire.encode_record(b"key", b"value")
    for cut in (1, 4, len(data) - 1):
        with pytest.raises(ValueError):
            list(wire.decode_records(data[:cut]))


@pytest.mark.parametrize("codec", segments.CODECS)
def test_segments_round_trip(spark, codec, tmp_path):
    rows = [(bytearray(b"k%04d" % (i * 37 % 200)), bytearray(b"v" * (i % 50))) for i in range(400)] + [(bytearray(b""), bytearray(b"big" * 700_000)), (None, None)]
    df = spark.createDataFrame(rows, "key binary, value binary")
    made = segments.encode_segments(df, n=3, codec=codec, block_bytes=2000).cache()
    back = segments.decode_segments(made, codec).collect()
    count = lambda pairs: Counter((bytes(k or b""), bytes(v or b"")) for k, v in pairs)
    assert count((r.key, r.value) for r in back) == count(rows)
    assert made.agg(F.sum("records")).first()[0] == len(rows)
    for part in {r.part for r in made.select("part").collect()}:
        blocks = made.filter(F.col("part") == part).orderBy("block").collect()
        (tmp_path / f"{part}.run").write_bytes(b"".join(bytes(b.data) for b in blocks))
    files = segments.read_run_files(spark, f"file://{tmp_path}/*.run", codec)
    assert count((r.key, r.value) for r in files.collect()) == count(rows)
    made.unpersist()


def test_unknown_codec():
    with pytest.raises(ValueError):
        segments.compress(b"x", "lzo")


def test_durations(spark):
    df = spark.createDataFrame([("1hrs, 2mins, 3sec", 3723), ("59sec", 59), ("4mins, 0sec", 240), ("", 0), (None, None)], "t string, s long")
    assert all(r.s == r.n for r in df.select("s", duration_seconds(F.col("t")).alias("n")).collect())


def test_generators_are_stable(spark):
    a, b = generators.sort_records(spark, 50, 1), generators.sort_records(spark, 50, 7)
    assert not validate.multiset_difference(a, b).count()
    assert {(len(r.key), len(r.value)) for r in a.collect()} == {(10, 90)}
    sizes = {(len(r.key), len(r.value)) for r in generators.random_records(spark, 300).collect()}
    assert min(k for k, _ in sizes) >= 5 and max(k for k, _ in sizes) <= 10 and max(v for _, v in sizes) <= 60
    lengths = [len(r.text.split()) for r in generators.random_text(spark, 200).collect()]
    assert min(lengths) >= 5 and max(lengths) <= 25


def test_pi(spark):
    assert workloads.pi_estimate(spark).first().close


def test_throughput_and_round_trip(spark, tmp_path):
    found = workloads.throughput(spark, spark.range(1000), f"file://{tmp_path}/a", 3)
    assert found["files"] == 3 and found["mb"] > 0
    text = spark.createDataFrame([("é",), (None,)], "t string")
    assert workloads.storage_round_trip(text, f"file://{tmp_path}/b", "t").first().asDict() == {"rows_in": 2, "bytes_in": 2, "rows_out": 2, "bytes_out": 2, "valid": True}


def test_consecutive_runs(spark):
    df = spark.createDataFrame([(1, i, k, float(i)) for i, k in enumerate(["a", "a", None, None, "a", "b"])], "g int, i int, k string, v double")
    found = analytics.rollup_runs(df, ["g"], ["i"], "k", ["v"], ["v"]).orderBy("run").collect()
    assert [(r.run, r.k, r.n, r.avg_v, r.sum_v) for r in found] == [(1, "a", 2, 0.5, 1.0), (2, None, 2, 2.5, 5.0), (3, "a", 1, 4.0, 4.0), (4, "b", 1, 5.0, 5.0)]


def test_job_classes(spark):
    df = spark.createDataFrame([(100, 9, 0, 9), (100, 5, 5, 11), (4, 2, 2, None)], "launched long, failed long, killed long, bad long")
    assert all(r.bad == r.x for r in df.select("bad", analytics.bad_share(F.col("launched"), F.col("failed"), F.col("killed")).alias("x")).collect())
    flags = spark.createDataFrame([(True, True, False, "fatal"), (False, True, True, "error"), (False, False, True, "warn"), (False, False, False, "success")], "f boolean, e boolean, w boolean, s string")
    assert all(r.s == r.x for r in flags.select("s", analytics.classify(F.col("f"), F.col("e"), F.col("w")).alias("x")).collect())


def test_gaps_and_snippets(spark):
    lines = spark.createDataFrame([("f", i, t, "x job1" if i in (3, 5) else "x") for i, t in enumerate(["2020-01-01 00:00:00", "2020-01-01 00:00:10", None, "2020-01-01 00:00:21", "2020-01-01 00:00:22", "2020-01-01 01:00:00"])], "file string, row int, t string, line string")
    dated = lines.withColumn("ts", F.col("t").cast("timestamp"))
    assert [(r.row, r.gap) for r in analytics.log_gaps(dated, "file", "row", "ts").orderBy("row").collect()] == [(3, 11), (5, 3578)]
    assert [r.row for r in analytics.log_snippet(lines, "file", "row", F.col("line").contains("job1"), 1).orderBy("row").collect()] == [2, 3, 4, 5]


def lzo_blocks():
    """Blocks by hand, each with an instruction that the encoder does not use."""
    literals = bytes([17 + 8]) + b"abcdefgh"
    far = bytes(range(256)) * 80
    return [
        (literals + bytes([0b01_1_011_10, 0]) + b"XY" + END_LZO, b"abcdefghefghXY"),  # 4 bytes, 4 back, 2 literals
        (literals + bytes([0b1_10_111_00, 0]) + END_LZO, b"abcdefghabcdefg"),  # 7 bytes, 8 back
        (literals + bytes([0b01_0_000_01, 0]) + b"Z" + bytes([0b0000_01_00, 1]) + END_LZO, b"abcdefghhhhZgh"),  # 2 bytes after a literal
        (bytes([0]) + bytes((len(far) - 19) // 255) + bytes([(len(far) - 19) % 255 + 1]) + far + bytes([0b0000_00_00, 0]) + END_LZO, far + far[-2049:-2046]),  # 3 bytes from 2,049 on
        (bytes([0]) + bytes((len(far) - 19) // 255) + bytes([(len(far) - 19) % 255 + 1]) + far + bytes([0b0001_0_011, 0b100, 0]) + END_LZO, far + far[-16385:-16380]),  # 5 bytes from 16,384 on
    ]


END_LZO = b"\x11\x00\x00"


def test_lzo_instructions():
    for block, content in lzo_blocks():
        assert lzo.lzo1x_decompress(block, len(content)) == content
    for bad in (b"", b"\x19abc", bytes([17 + 4]) + b"abcd" + bytes([0b01_0_111_00, 9]) + END_LZO, END_LZO + b"x"):
        with pytest.raises(ValueError):
            lzo.lzo1x_decompress(bad)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=300), st.sampled_from([b"abcd" * 90, b"\0" * 3000, bytes(range(256))])), max_size=8))
def test_lzo_round_trip(parts):
    data = b"".join(parts)
    assert lzo.lzo1x_decompress(lzo.lzo1x_compress(data), len(data)) == data


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=40), st.binary(max_size=300)), max_size=12), st.integers(1, 50))
def test_split_records_are_stitched(records, step):
    data = b"".join(wire.encode_record(k, v) for k, v in records) + wire.encode_vint(-1) * 2 + b"after the end"
    stream, out = wire.RecordStream(), []
    for at in range(0, len(data), step):
        out += stream.feed(data[at : at + step])
    stream.close()
    assert out == records
    cut = wire.RecordStream()
    cut.feed(wire.encode_record(b"key", b"value")[:-1])
    with pytest.raises(ValueError):
        cut.close()


def test_run_files_and_ranged_reads(spark, tmp_path):
    rows = [(bytearray(b"k%05d" % (i * 37 % 900)), bytearray(b"v" * (i % 70))) for i in range(900)]
    made = segments.encode_segments(spark.createDataFrame(rows, "key binary, value binary"), n=3, block_bytes=700)
    files = segments.write_run_files(made, f"file://{tmp_path}/runs").cache()
    assert files.agg(F.sum("records")).first()[0] == 900 and {p.name for p in (tmp_path / "runs").iterdir() if p.suffix == ".run"} == {f"part-{r.part:05d}.run" for r in files.collect()}
    whole = segments.read_run_files(spark, f"file://{tmp_path}/runs/*.run").collect()
    some = segments.decode_chunks(segments.read_ranges(segments.file_chunks(files, 101))).collect()
    count = lambda found: Counter((bytes(r.key), bytes(r.value)) for r in found)
    assert count(whole) == count(some) == Counter((bytes(k), bytes(v)) for k, v in rows)
    one = spark.createDataFrame([(files.first().path, 3, 5, "x")], "path string, offset long, length long, other string")
    path = files.first().path.removeprefix("file://")
    with open(path, "rb") as f:
        assert bytes(segments.read_ranges(one).first().data) == f.read()[3:8]
    files.unpersist()


@pytest.mark.parametrize("codec", ["none", "snappy", "zlib"])
@pytest.mark.parametrize("known", [True, False])
def test_run_files_are_read_in_pieces(spark, tmp_path, monkeypatch, codec, known):
    # No file is taken whole where Python opens it: Spark's bound on whole files is below their lengths.
    monkeypatch.setattr(segments, "PIECE_BYTES", 100, raising=False)
    if known:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", 300)
    else:
        monkeypatch.setattr(segments, "_python_opens", lambda files: False)
    rows = [(bytearray(b"k%05d" % i), bytearray(random.Random(i).randbytes(i % 70))) for i in range(300)] + [(bytearray(b"k00150"), bytearray(random.Random(0).randbytes(5000)))]
    folder = tmp_path / "odd %20#name"
    try:
        blocks = segments.encode_segments(spark.createDataFrame(rows, "key binary, value binary"), n=2, codec=codec, block_bytes=700).collect()
        folder.mkdir()
        for part in {b.part for b in blocks}:
            data = b"".join(bytes(b.data) for b in sorted(blocks, key=lambda b: b.block) if b.part == part)
            (folder / f"{part}.run").write_bytes(data)
        (folder / "empty.run").write_bytes(b"")
        found = segments.read_run_files(spark, f"file://{tmp_path}/odd*/*.run", codec)
        assert Counter((bytes(r.key), bytes(r.value)) for r in found.collect()) == Counter((bytes(k), bytes(v)) for k, v in rows)
        assert {r.path for r in found.select("path").distinct().collect()} == {f"file:{folder}/{part}.run" for part in {b.part for b in blocks}}
        (folder / "empty.run").write_bytes(data[:-20])
        with pytest.raises(Exception, match="ends inside"):
            segments.read_run_files(spark, f"file://{tmp_path}/odd*/*.run", codec).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


@pytest.mark.parametrize("codec", ["none", "lz4"])
def test_run_records_hold_little_of_a_file(codec):
    raw = b"".join(wire.encode_record(b"%07d" % i, b"v" * 9) for i in range(20_000))
    block, times = segments.compress(raw, codec), 20
    end = segments.compress(wire.encode_vint(-1) * 2, codec)
    tracemalloc.start()
    lengths = [len(x) for x in segments.run_records((x for x in [block] * times + [end]), codec)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(lengths) == 20_000 * times and max(lengths) < 20_000 and most < times * len(raw)  # less than the records as bytes


def test_long_records_are_joined_once():
    stream, joined = wire.RecordStream(), 0
    record = wire.encode_record(b"k", b"v" * 200_000)
    for at in range(0, len(record) - 1, 1000):
        assert not stream.feed(record[at : min(at + 1000, len(record) - 1)])
        joined += len(stream.held) == 1
    assert joined <= 2 and stream.feed(record[-1:]) == [(b"k", b"v" * 200_000)]
    stream.close()


def test_python_gets_segments_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(64 << 20))
    try:
        made = segments.encode_segments(spark.createDataFrame([(b"k", b"v")], "key binary, value binary"), n=1)
        assert int(spark.conf.get(name)) <= 8 << 20 and made.count() == 1
    finally:
        spark.conf.unset(name)


def test_success_that_is_taken_back(spark):
    rows = [("t", "a1", 1, "ok"), ("t", "a2", 2, "failed"), ("u", "b2", 1, "ok"), ("u", "b1", 2, "ok"), ("u", "b1", 3, "killed"), ("w", "c", 5, "failed")]
    events = spark.createDataFrame(rows, "task string, attempt string, at int, status string")
    how = dict(task="task", attempt="attempt", status="status", succeeded=["ok"], order="at", revoked=["failed", "killed"])
    assert {tuple(r) for r in reduce.first_success(events, **how).collect()} == {("t", "a1", 1), ("u", "b2", 2)}
    bad = events.unionByName(spark.createDataFrame([("t", "a1", 9, "killed")], events.schema))
    with pytest.raises(Exception, match="taken back"):
        reduce.first_success(bad, **how).collect()
    assert {(r.task, r.revoked) for r in reduce.first_success(bad, **how, on_revoked="mark").collect()} == {("t", True), ("u", False)}


INTERNAL = ["run", "_start", "_range", "part", "row", "n", "key", "k0", "first", "last", "file", "before", "salt", "own", "rows", "keys", "task", "attempt", "place", "s", "begins", "number", "line", "own_file"]


def test_columns_may_have_any_name(spark):
    data = [(i % 2, i, "ab"[i % 3 == 0], float(i)) for i in range(12)]
    df = spark.createDataFrame(data, "g int, i int, k string, v double").withColumns({c: F.lit(5) for c in INTERNAL})
    found = analytics.rollup_runs(df, ["g"], ["i"], "k", ["row"], ["run", "part"], run="number_of_run").collect()
    assert all(r.sum_run == 5 * r.n == r.sum_part and r.avg_row == 5 for r in found) and sum(r.n for r in found) == 12
    with pytest.raises(ValueError):
        analytics.rollup_runs(df, ["run"], ["i"], "k")
    assert analytics.rollup_runs(df, ["g"], ["i"], "k", sums=["run"]).agg(F.sum("sum_run")).first()[0] == 60
    snippet = analytics.log_snippet(df, "g", "i", F.col("i") == 4, 2)
    assert sorted(r.i for r in snippet.collect()) == [2, 4, 6] and snippet.columns == df.columns
    assert merge.global_rank(df, ["part", "i"]).columns == [*df.columns, "rank", "dense_rank"]
    assert {r.copies for r in merge.key_ranks(df, ["part", "row"]).collect()} == {12}
    with pytest.raises(ValueError):
        merge.global_rank(df.withColumn("rank", F.lit(1)), ["i"])
    more = df.withColumn("surplus", F.lit(1))
    with pytest.raises(ValueError):
        validate.multiset_difference(more, more)
    assert validate.multiset_difference(more, more.limit(11), "left").count() == 1
    assert validate.validate_sorted(exchange.sorted_partitions(df, ["part", "i"]), ["part", "i"]).first().ok


def test_runs_and_gaps_across_ranges(spark):
    # One group that fills all ranges: what a range begins with goes on from the one before.
    keys = ["a"] * 50 + ["b"] * 3 + ["a"] * 60 + [None] * 40
    df = spark.createDataFrame([(g, i, k, 1) for g in ("x", None) for i, k in enumerate(keys)], "g string, i int, k string, v int").repartition(5)
    found = sorted((str(r.g), r.run, r.k, r.n, r.sum_v) for r in analytics.rollup_runs(df, ["g"], ["i"], "k", sums=["v"]).collect())
    assert found == [(g, n, k, c, c) for g in ("None", "x") for n, (k, c) in enumerate([("a", 50), ("b", 3), ("a", 60), (None, 40)], 1)]
    whole = analytics.rollup_runs(df.filter("g = 'x'"), [], ["i"], "k").orderBy("run").collect()
    assert [(r.run, r.k, r.n) for r in whole] == [(1, "a", 50), (2, "b", 3), (3, "a", 60), (4, None, 40)]
    lines = df.withColumn("ts", F.timestamp_seconds(F.col("i") * F.when(F.col("i") > 100, 20).otherwise(5)))
    assert analytics.log_gaps(lines, "g", "i", "ts").count() == 2 * (len(keys) - 101)


def test_range_partition_with_many_splits(spark):
    splits = list(range(0, 9000, 3))
    df = spark.createDataFrame([(x,) for x in (-5, 0, 1, 3, 4499, 8996, 8997, 10**6, None)], "k long")
    found = [(r.k, r.p) for r in df.select("k", exchange.range_partition(F.col("k"), splits).alias("p")).collect()]
    assert found == [(k, 0 if k is None else sum(s <= k for s in splits)) for k, _ in found]
    assert df.select(exchange.range_partition(F.col("k"), []).alias("p")).distinct().count() == 1


def test_truncation_and_storage_files(spark, tmp_path):
    df = spark.createDataFrame([(1.239,), (-1.239,), (5.0,), (None,)], "x double")
    assert [r.y for r in df.select(analytics.truncated(F.col("x")).alias("y")).collect()] == [1.23, -1.23, 5.0, None]
    for mode in ("write", "read"):
        found = workloads.storage_files(spark, f"file://{tmp_path}/io", 3, 2_500_000, mode).cache()
        assert {r.bytes for r in found.collect()} == {2_500_000} and analytics.io_report(found).first().files == 3
    workloads.storage_files(spark, f"file://{tmp_path}/io", 3, 0, "clean").collect()
    assert not list((tmp_path / "io").glob("*.dat"))
    with pytest.raises(ValueError):
        workloads.storage_files(spark, "file:///tmp", 1, 1, "other")
