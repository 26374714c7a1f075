"""The incremental scan against scans of what has landed."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hrefsieve.params import AuditParams
from hrefsieve.plans.jobs import audit_pages
from hrefsieve.sources.landed import landed_pages
from hrefsieve.sources.raw_files import read_raw_files
from hrefsieve.streaming import incremental as inc

SCHEMA = "url string, html string, landed timestamp"
P = AuditParams(max_match_pages=7)


def schema():
    return T.StructType.fromDDL(SCHEMA)


def inputs_of(spark, *strings):
    return spark.createDataFrame(list(enumerate(strings)), "input_id bigint, queried_url string")


class Site:
    """A folder of landed pages, a match table on it, and what the newest landings hold."""

    def __init__(self, spark, path, p=P):
        self.spark, self.p = spark, p
        self.landed, self.table, self.offsets = (f"{path}/{n}" for n in ("landed", "matches", "offsets"))
        self.now, self.at = {}, 0
        spark.createDataFrame([], SCHEMA).write.parquet(self.landed)

    def land(self, pages, files=1):
        self.at += 1
        self.now |= pages
        rows = self.spark.createDataFrame([(u, h, self.at) for u, h in pages.items()], "url string, html string, at long")
        rows.select("url", "html", F.timestamp_seconds("at").alias("landed")).repartition(files).write.mode("append").parquet(self.landed)

    def scan(self, inputs, per_batch=1_000, again=False):
        so_far = inc.landed_so_far(self.spark, self.landed, schema()) if again else None
        stream = inc.stream_pages(self.spark, self.landed, schema(), per_batch=per_batch)
        inc.scan_stream(stream, inputs, self.table, self.offsets, self.p, so_far).awaitTermination()

    def check(self, inputs):
        pages = self.spark.createDataFrame(list(self.now.items()), "url string, html string")
        want = sorted(map(str, audit_pages(inputs, pages, self.p).collect()))
        assert sorted(map(str, inc.stream_report(self.spark, self.table, inputs, self.p).collect())) == want


def text(i, words="common"):
    return f"<a href='/l{i % 4}'>{words}{i % 2}</a>"


@pytest.mark.parametrize("strategy", ["auto", "windows"])
def test_changed_pages_and_added_inputs(spark, tmp_path, strategy):
    site = Site(spark, tmp_path, replace(P, match_strategy=strategy))
    inputs = inputs_of(spark, "common0", "https://h.com/l3", "common", "absent")
    site.scan(inputs)
    assert not inc.stream_report(spark, site.table, inputs, site.p).where("found").count()
    site.land({f"https://h.com/{i}": text(i) for i in range(30)}, files=3)
    site.scan(inputs, per_batch=1)
    site.check(inputs)
    site.land({f"https://h.com/{i}": text(i, "changed") for i in range(0, 30, 3)} | {"https://h.com/1": "<p>nothing", "https://h.com/new": text(3)}, files=2)
    site.scan(inputs)
    site.check(inputs)
    more = inputs_of(spark, "common0", "https://h.com/l3", "common", "absent", "changed1", "nothing")
    with pytest.raises(ValueError, match="not searched"):
        inc.stream_report(spark, site.table, more, site.p)
    with pytest.raises(ValueError, match="give the pages"):
        site.scan(more)
    site.land({"https://h.com/late": text(1, "changed")})
    site.scan(more, again=True)
    site.check(more)
    inc.compact(spark, site.table)
    site.check(more)
    fewer = inputs_of(spark, "common1")
    site.scan(inputs_of(spark, "common0"))  # what is no longer asked for is still searched
    site.land({"https://h.com/last": text(2, "nothing")})
    site.scan(inputs_of(spark, "common0"))
    site.check(more)
    with pytest.raises(ValueError, match="other settings"):
        inc.stream_report(spark, site.table, inputs, replace(site.p, scan_body=False))
    assert fewer.count() == 1


def test_a_hundred_batches_compact_to_one(spark, tmp_path):
    site = Site(spark, tmp_path)
    inputs = inputs_of(spark, "common0", "common1", "https://h.com/l2")
    pages = spark.range(150).select(
        F.concat(F.lit("https://h.com/"), F.col("id") % 60).alias("url"), F.concat(F.lit("<p>v"), "id", F.lit(" common"), F.col("id") % 2).alias("html"), F.timestamp_seconds("id").alias("landed")
    )
    pages.repartitionByRange(100, "landed").write.option("maxRecordsPerFile", 2).mode("append").parquet(site.landed)
    site.now = {f"https://h.com/{i % 60}": f"<p>v{i} common{i % 2}" for i in range(150)}
    site.scan(inputs, per_batch=1)
    table = spark.read.schema(f"{inc.ROWS}, batch long").parquet(f"{site.table}/batches")
    assert table.select("batch").distinct().count() >= 75
    site.check(inputs)
    upto = inc.compact(spark, site.table)
    left = spark.read.schema(f"{inc.ROWS}, batch long").parquet(f"{site.table}/batches")
    assert upto >= 74 and left.count() == 0 and spark.read.schema(inc.ROWS).parquet(f"{site.table}/base/upto={upto}").count() == 60
    site.check(inputs)
    assert inc.compact(spark, site.table) == upto
    site.land({"https://h.com/5": "<p>common0 again"})
    site.scan(inputs)
    site.check(inputs)
    assert inc.compact(spark, site.table) > upto
    site.check(inputs)


def test_a_base_that_was_not_marked_does_not_count(spark, tmp_path):
    site = Site(spark, tmp_path)
    inputs = inputs_of(spark, "common0")
    site.land({f"https://h.com/{i}": text(i) for i in range(6)})
    site.scan(inputs)
    spark.createDataFrame([], inc.ROWS).write.parquet(f"{site.table}/base/upto=0")  # a compaction that broke off
    site.check(inputs)
    inc.compact(spark, site.table)
    site.check(inputs)


def test_copies_in_one_landing_add_up(spark, tmp_path):
    site = Site(spark, tmp_path)
    inputs = inputs_of(spark, "first.example", "second.example", "third.example")
    rows = [("u", "first.example", 1), ("u", "second.example", 1), ("u", "third.example", 0)]
    frame = spark.createDataFrame(rows, "url string, html string, at long").select("url", "html", F.timestamp_seconds("at").alias("landed"))
    frame.coalesce(1).write.mode("append").parquet(site.landed)
    site.scan(inputs)
    for _ in range(2):
        found = {r["queried_url"]: r["found"] for r in inc.stream_report(spark, site.table, inputs, P).collect()}
        assert found == {"first.example": True, "second.example": True, "third.example": False}
        inc.compact(spark, site.table)


def test_bodies_as_files(spark, tmp_path):
    import gzip

    bodies = {"a": b"<p>caf\xc3\xa9 \xff", "b": gzip.compress(b"<p>packed"), "c": b"", "d": b"<p>failed", "e.gz": b"<p>plain", "stray": b"<p>stray"}
    (tmp_path / "f" / "deep").mkdir(parents=True)
    for name, body in bodies.items():
        (tmp_path / "f" / ("deep" if name == "a" else ".") / name).write_bytes(body)
    side = [("a", "https://h/a", 200, {}), ("b", "https://h/b", 200, {"Content-Type": "application/gzip"}), ("c", "https://h/c", 200, {}),
            ("d", "https://h/d", 500, {}), ("e.gz", "https://h/e.gz", 200, None), ("gone", "https://h/gone", 200, {})]
    sidecar = spark.createDataFrame(side, "file string, url string, status int, headers map<string,string>")
    raw = read_raw_files(spark, str(tmp_path / "f"), sidecar)
    assert raw.count() == 4  # an empty file has no row
    got = {r["url"]: (r["html"], r["size_bytes"]) for r in landed_pages(raw).collect()}
    assert got == {"https://h/a": ("<p>café ", 9), "https://h/b": ("<p>packed", 9), "https://h/e.gz": ("<p>plain", 8)}


def test_small_files_are_many_to_a_task(spark, tmp_path, monkeypatch):
    from hrefsieve.sources import raw_files

    for i in range(100):
        (tmp_path / f"{i}.body").write_bytes(b"<p>%d" % i)
    sidecar = spark.createDataFrame([(f"{i}.body", f"https://h/{i}", 200, {}) for i in range(100)], "file string, url string, status int, headers map<string,string>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")  # two files to a split
    try:
        raw = read_raw_files(spark, str(tmp_path), sidecar)
        assert raw.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism < 50
        assert {(r["url"], bytes(r["body"])) for r in raw.collect()} == {(f"https://h/{i}", b"<p>%d" % i) for i in range(100)}
        monkeypatch.setattr(raw_files, "TASK_BYTES", 1)  # as if the files were large
        assert read_raw_files(spark, str(tmp_path), sidecar).rdd.getNumPartitions() == 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
