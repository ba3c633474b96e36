"""Scans, sinks and streams as round trips: what a query reads back must be the table that it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers, writers
from ..sources.scratch import folder
from ..streaming import runner
from .registry import query, table


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment || ', \"quoted\"' || chr(10) || 'second line' AS note FROM customer")
def csv_round_trip(spark, sf):
    """Delimited files of strings, with quotes and line ends in cells, written and read again."""
    at = folder(spark, "csv")
    writers.write_csv(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", F.concat("c_mktsegment", F.lit(', "quoted"\nsecond line')).alias("note")), at)
    return readers.read_csv(spark, at, ["c_custkey", "c_name", "note"])


@query("SELECT CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b WHERE false")
def missing_file_scan(spark, sf):
    """A file that is missing is an empty table of its columns."""
    return readers.read_optional(spark, folder(spark, "none"), ["a", "b"])


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 3 = 0 THEN n_name || ', of ' || n_regionkey WHEN n_nationkey % 3 = 1 THEN 'say "' || n_name || ', x"' ELSE n_name END AS title, CAST(n_nationkey AS VARCHAR) AS title_id, CASE WHEN n_nationkey % 5 = 4 AND n_nationkey % 3 <> 0 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS n, n_nationkey % 3 = 0 AS _realigned FROM nation""")
def ragged_scan(spark, sf):
    """Rows with a bare separator in a cell are realigned, quoted cells are read whole, short rows are padded."""
    k = F.col("n_nationkey")
    cell = F.when(k % 3 == 0, F.concat("n_name", F.lit(", of "), "n_regionkey")).when(k % 3 == 1, F.concat(F.lit('"say ""'), "n_name", F.lit(', x"""'))).otherwise(F.col("n_name"))
    line = F.concat(k.cast("string"), F.lit(","), cell, F.lit(","), k.cast("string"), F.when((k % 5 == 4) & (k % 3 != 0), "").otherwise(F.concat(F.lit(","), F.col("n_regionkey").cast("string"))))
    at = folder(spark, "ragged")
    table(spark, sf, "nation").select(line.alias("value")).union(spark.createDataFrame([("id,title,title_id,n",)], "value string")).write.text(at)
    return readers.read_ragged(spark, at, ["id", "title", "title_id", "n"], "title_id")


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS absent FROM events")
def json_round_trip(spark, sf):
    """Documents of JSON written and read by a schema; a field that none has is null."""
    at = folder(spark, "json")
    writers.write_json(table(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("props")), at)
    return spark.read.schema("event_id long, props struct<k: long>, absent string").json(at).select("event_id", "props.k", "absent")


@query("SELECT r_regionkey AS region, list(n_name ORDER BY n_nationkey) AS names, r_name AS label FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1, 3")
def json_document_scan(spark, sf):
    """A document over several lines, read whole and exploded."""
    held = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    one = table(spark, sf, "region").join(held, "r_regionkey").agg(F.struct(F.collect_list(F.struct(F.col("r_regionkey").alias("region"), "names", F.col("r_name").alias("label"))).alias("regions")).alias("d"))
    at = folder(spark, "document")
    one.select(F.to_json("d", {"pretty": "true"}).alias("value")).write.text(at)  # the five regions
    return readers.read_json(spark, at, "regions array<struct<region: int, names: array<string>, label: string>>").select(F.explode("regions").alias("r")).select("r.*")


@query("SELECT o_orderkey, o_orderstatus, year(o_orderdate) AS y FROM orders")
def partitioned_round_trip(spark, sf):
    """A folder for each status and year; the values come back from the folders' names."""
    at = folder(spark, "partitioned")
    writers.write_partitioned(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").cast("long").alias("y")), at, ["o_orderstatus", "y"], rows=1000)
    return spark.read.parquet(at).select("o_orderkey", "o_orderstatus", F.col("y").cast("long").alias("y"))


@query("SELECT conv_id, CAST(turn AS BIGINT) AS line_no, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM conversations")
def documents_round_trip(spark, sf):
    """One text file a conversation, a line a turn, read back line by line."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.translate("text", "\n\r", "  ").alias("text"))
    at = folder(spark, "texts")
    writers.write_documents(writers.documents(c, "conv_id", "turn", "text"), "conv_id", at)
    whole = spark.read.text(f"{at}/*/*.txt", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"conv_id=(\d+)", 1).cast("long").alias("conv_id"), F.regexp_replace("value", "\n$", "").alias("value"))
    return whole.select("conv_id", F.posexplode(F.split("value", "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("long"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def staged_commit(spark, sf):
    """Written to a staging folder, compared with the plan, renamed, and read from its final place."""
    at = folder(spark, "commit")
    writers.commit(spark, table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), at)
    return spark.read.parquet(at)


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN 'missing' ELSE 'extra' END AS side FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 1000000, 'extra' FROM customer WHERE c_custkey % 10 = 1")
def write_reconciliation(spark, sf):
    """Rows that only the plan or only the read-back has."""
    plan = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    at = folder(spark, "read-back")
    plan.filter("k % 10 <> 0").union(plan.filter("k % 10 = 1").select(F.col("k") + 1000000)).write.parquet(at)
    return writers.reconcile(plan, spark.read.parquet(at))


@query("SELECT n_name || '.txt' AS file, CAST(length(n_name) + 1 AS BIGINT) AS bytes, sha256(n_name || chr(10)) AS sha256 FROM nation")
def manifest_scan(spark, sf):
    """Name, size and hash of each file of a folder."""
    at = folder(spark, "manifest")
    table(spark, sf, "nation").select(F.col("n_name").alias("part"), F.col("n_name").alias("value")).write.partitionBy("part").text(at)
    m = readers.input_manifest(spark, f"{at}/*/*.txt")
    return m.select(F.concat(F.url_decode(F.regexp_extract("path", "part=([^/]*)", 1)), F.lit(".txt")).alias("file"), "bytes", "sha256")


@query("SELECT conv_id, nullif(regexp_extract(text, '([0-9]+)', 1), '') AS number, nullif(regexp_extract(text, '([a-z]+ß?)', 1), '') AS word FROM (SELECT conv_id, left(string_agg(replace(text, chr(10), ' '), ' ' ORDER BY turn), 2000) AS text FROM conversations GROUP BY conv_id)")
def header_probe_scan(spark, sf):
    """The first match of patterns in the first 2,000 characters of files."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.translate("text", "\n", " ").alias("t")))), lambda x: x["t"]), " ").alias("value"))
    at = folder(spark, "headers")
    c.withColumn("value", F.left("value", F.lit(2000))).write.partitionBy("conv_id").text(at)
    p = readers.header_probe(spark, f"{at}/*/*.txt", {"number": "([0-9]+)", "word": "([a-z]+ß?)"})
    return p.select(F.regexp_extract("path", r"conv_id=(\d+)", 1).cast("long").alias("conv_id"), "number", "word")


@query("SELECT conv_id AS file_no, turn AS line_no, text AS text_a, upper(text) AS text_b FROM (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '', 'g') AS text FROM conversations)")
def paired_scan(spark, sf):
    """Lines of two views of the same files, joined by place; a line without a twin is an error."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line_no"), F.regexp_replace("text", "[^ -~]", "").alias("text"))
    pairs = readers.paired_lines(c, c.withColumn("text", F.upper("text")))
    return pairs.select(F.col("file").cast("long").alias("file_no"), "line_no", "text_a", "text_b")


@query("SELECT 'regions' AS sheet, count(*) AS n FROM region UNION ALL SELECT 'nations', count(*) FROM nation")
def workbook_sheets(spark, sf):
    """A workbook as one delimited file for each sheet, some of it frozen into a copy."""
    at, copy = folder(spark, "workbook"), folder(spark, "frozen")
    writers.write_sheets({"regions": table(spark, sf, "region"), "nations": table(spark, sf, "nation"), "drafts": table(spark, sf, "nation")}, at)
    writers.freeze(spark, at, ["regions", "nations"], copy)
    one = lambda name: readers.read_csv(spark, f"{copy}/{name}").agg(F.lit(name).alias("sheet"), F.count("*").alias("n"))
    return one("regions").union(one("nations"))


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 7")
def smoke_rows(spark, sf):
    """The first rows by key, for a trial run of a plan (the limit is the feature)."""
    return readers.smoke(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", 7)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, sf):
    """Counts by hour from a stream of files into files, exactly once; a last event beyond all windows lets the watermark close them."""
    e = table(spark, sf, "events")
    at = folder(spark, "stream")
    source = e.select("ts", "event_type")
    source.write.parquet(f"{at}/in")
    last = source.agg((F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts"), F.lit("end").alias("event_type"))
    stream = runner.windowed_counts(runner.events(spark, f"{at}/in", source.schema, 1000))
    runner.run_to_files(stream, f"{at}/out", f"{at}/log")
    last.write.mode("append").parquet(f"{at}/in")
    for _ in range(2):  # the second run finds nothing new and changes nothing
        runner.run_to_files(runner.windowed_counts(runner.events(spark, f"{at}/in", source.schema, 1000)), f"{at}/out", f"{at}/log")
    return spark.read.parquet(f"{at}/out").filter("event_type <> 'end'").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_running_pairs(spark, sf):
    """State by user and kind of event, updated over several batches; the last update of each key."""
    e = table(spark, sf, "events").select("ts", "user_id", "event_type")
    at = folder(spark, "state")
    e.repartition(3).write.parquet(f"{at}/in")
    runner.run_updates(runner.running_pairs(runner.events(spark, f"{at}/in", e.schema, 2)), f"{at}/out", f"{at}/log")
    return runner.latest(spark, f"{at}/out", ["user_id", "event_type"])
