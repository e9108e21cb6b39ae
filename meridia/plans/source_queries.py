"""Sources and sinks: every query writes rows of the given tables in a format and reads them back."""

from pyspark.sql import functions as F

from meridia.operators import clean as K
from meridia.plans.catalog import Catalog, report_sql, rounded
from meridia.plans.store_queries import TRAITS, melted, panel_frames
from meridia.plans.tables import STORE_SQL, TRAITS_SQL, cells, crosswalk, subjects, table, trace_rows, traits
from meridia.schema import STORE
from meridia.sources import readers as R
from meridia.sources import sinks as W
from meridia.sources.store import Store
from meridia.session import scratch_path

catalog = Catalog()
add = catalog.add


@add("src_delimited", report_sql("", """SELECT event_id::VARCHAR AS row_no, (user_id % 8)::VARCHAR AS subject,
  CASE WHEN event_type = 'error' THEN 'Low' ELSE 'num' END AS kind, CASE WHEN event_type <> 'error' THEN value END AS reading FROM events""", "reading"))
def _delimited(spark, sf):
    path = scratch_path(spark, "tsv")
    trace_rows(spark, sf).write.csv(path, sep="\t", header=True)
    kind = F.when(F.col("reading") == "Low", "Low").otherwise("num")
    return rounded(R.read_delimited(spark, path).select(
        "row_no", "subject", kind.alias("kind"), F.col("reading").try_cast("double").alias("reading")))


@add("src_delimited_comma", "SELECT c_custkey::VARCHAR AS id, c_mktsegment AS segment FROM customer")
def _comma(spark, sf):
    """A comma-separated file with blanks and quotes around its header names."""
    path = scratch_path(spark, "csv")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias(" id "), F.col("c_mktsegment").alias("'segment'"))
    rows.write.csv(path, header=True)
    return R.read_delimited(spark, path)


@add("src_keyed_csv", report_sql(STORE_SQL, 'SELECT subject_id AS "SubjectID", iris AS "IRIS", sspg AS "SSPG" FROM subjects'))
def _keyed(spark, sf):
    path = scratch_path(spark, "keyed")
    subjects(spark, sf).select(F.col("subject_id").alias("SubjectID"), F.col("iris").alias("IRIS"), F.col("sspg").alias("SSPG")).write.csv(path, header=True)
    return R.read_keyed_csv(spark, path).select(F.col("SubjectID").cast("bigint"), "IRIS", "SSPG")


def name_files(spark, written, folder, suffix, name):
    """Rename the part files of a write: part i of ``written`` becomes ``folder/<name(i)><suffix>``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(folder))
    for i, status in enumerate(fs.globStatus(hadoop(f"{written}/part-*{suffix}"))):
        fs.rename(status.getPath(), hadoop(f"{folder}/{name(i)}{suffix}"))


def subject_events(spark, sf):
    return table(spark, sf, "events").select("event_id", "value", F.pmod("user_id", F.lit(8)).alias("s"))


@add("src_parquet_by_stem", "SELECT user_id % 8 AS s, count(*) AS n, max(value) AS high FROM events GROUP BY 1")
def _stem(spark, sf):
    """Files named Basis_<subject>-<part>; a CSV next to them is ignored."""
    path = scratch_path(spark, "stems")
    rows = subject_events(spark, sf)
    for s in range(8):
        rows.where(F.col("s") == s).drop("s").write.parquet(f"{path}/parts/{s}")
        name_files(spark, f"{path}/parts/{s}", f"{path}/series", ".parquet", lambda i: f"Basis_{s}-{i}")
    rows.groupBy("s").count().write.csv(f"{path}/sidecar", header=True)
    name_files(spark, f"{path}/sidecar", f"{path}/series", ".csv", lambda i: f"_wear_summary{i}")
    stem = F.regexp_extract("subject_id", r"^Basis_(\d+)-", 1).cast("bigint")
    return R.read_by_stem(spark, f"{path}/series").groupBy(stem.alias("s")).agg(
        F.count("*").alias("n"), F.max("value").alias("high"))


@add("src_select_members", "SELECT user_id % 8 AS s, count(*) AS n FROM events WHERE user_id % 8 < 4 GROUP BY 1")
def _members(spark, sf):
    """Half of the subjects under primary names, the others under secondary ones that must be skipped."""
    path = scratch_path(spark, "archive")
    rows = subject_events(spark, sf)
    for s in range(8):
        rows.where(F.col("s") == s).write.csv(f"{path}/parts/{s}", header=True)
        tail = "" if s < 4 else "b"
        name_files(spark, f"{path}/parts/{s}", f"{path}/Basis_Watch_Data", ".csv", lambda i: f"Basis_{s}{i:05d}{tail}")
    return R.read_members(spark, path).groupBy(F.col("s").cast("bigint").alias("s")).agg(F.count("*").alias("n"))


@add("src_embeddings_split", "SELECT vec_id, label, list_count(embedding) AS dims FROM embeddings WHERE vec_id % 5 = 4")
def _split(spark, sf):
    split = F.when(F.col("vec_id") % 5 == 4, "test").otherwise("train")
    rows = table(spark, sf, "embeddings").withColumn("split", split)
    return R.embeddings_split(rows, "test").select("vec_id", "label", F.size("embedding").cast("bigint").alias("dims"))


@add("schema_contract", "SELECT min(value) AS low, max(value) AS high, count(*) AS n FROM events")
def _contract(spark, sf):
    rows = K.require_columns(table(spark, sf, "events"), ["user_id", "ts", "value"])
    checked = K.require_range(rows, "value", 0.0, 1e9)
    return checked.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


@add("sink_parquet", "SELECT user_id % 8 AS subject_id, count(*) AS n, max(value) AS high FROM events GROUP BY 1")
def _parquet(spark, sf):
    path = scratch_path(spark, "series")
    W.write_by_subject(table(spark, sf, "events").select(F.pmod("user_id", F.lit(8)).alias("subject_id"), "ts", "value"), path)
    back = spark.read.parquet(path).groupBy(F.col("subject_id").cast("bigint").alias("subject_id"))
    return back.agg(F.count("*").alias("n"), F.max("value").alias("high"))


@add("sink_csv", report_sql(TRAITS_SQL, "SELECT tax, subject_id, quantity, TGL, HDL FROM traits", "tax quantity TGL HDL"))
def _csv(spark, sf):
    path = scratch_path(spark, "labelled")
    W.write_csv(traits(spark, sf).select("subject_id", *TRAITS), path, "tax")
    schema = "tax double, subject_id bigint, quantity double, TGL double, HDL double"
    return rounded(spark.read.schema(schema).csv(path, header=True))


def store(spark):
    path = scratch_path(spark, "store")
    return Store(spark, "store_" + path.rsplit("-", 1)[1][:12], path)


@add("sink_overwrite", "SELECT count(*) AS reported, count(*) AS stored FROM customer")
def _overwrite(spark, sf):
    """Loaded twice: the second load replaces the first."""
    s = store(spark)
    s.create_all()
    rows = subjects(spark, sf)
    W.overwrite_table(rows.where("subject_id < 10"), s.name("loaded"))
    n = W.overwrite_table(rows, s.name("loaded"))
    return s.table("loaded").agg(F.lit(n).cast("bigint").alias("reported"), F.count("*").alias("stored"))


@add("sink_bucketed_partitions")
def _bucketed(spark, sf):
    path = scratch_path(spark, "bucketed")
    W.write_bucketed(cells(spark, sf), path)
    back = spark.read.parquet(path)
    again = W.bucket_of("subject_id")
    return back.groupBy("part_bucket").agg(F.count("*").alias("n"), F.bool_and(again == F.col("part_bucket")).alias("stable"))


@add("ddl_star_schema", "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', {i}, '{f.name}', '{f.dataType.simpleString()}')" for t, s in STORE.items() for i, f in enumerate(s)) +
    ') v("table", pos, "column", type), (SELECT count(*) AS n_subjects FROM customer)')
def _ddl(spark, sf):
    """Created twice without harm, filled with the customers, then described column by column."""
    s = store(spark)
    s.create_all()
    s.create_all()
    s.append("subjects", subjects(spark, sf))
    n = s.table("subjects").count()
    rows = [(t, i, f.name, f.dataType.simpleString(), n) for t in STORE for i, f in enumerate(s.table(t).schema)]
    s.drop_all()
    return spark.createDataFrame(rows, "table string, pos int, column string, type string, n_subjects bigint")


@add("ctas_and_views", f"WITH {STORE_SQL} SELECT iris, count(*) AS n FROM subjects WHERE sspg > 5000 GROUP BY 1")
def _ctas(spark, sf):
    s = store(spark)
    s.create_all()
    subjects(spark, sf).createOrReplaceTempView("incoming_subjects")
    for floor in (0, 5000):  # the second statement replaces the first
        s.create_table_as("rich", f"SELECT * FROM incoming_subjects WHERE sspg > {floor}")
    s.create_view_as("rich_by_class", f"SELECT iris, count(*) AS n FROM {s.name('rich')} GROUP BY iris")
    return spark.table("rich_by_class")


@add("src_store_scan", "SELECT 'subjects' AS \"table\", count(*) AS n FROM customer")
def _scan(spark, sf):
    """Only tables with rows come back."""
    s = store(spark)
    s.create_all()
    s.append("subjects", subjects(spark, sf))
    found = R.scan_store(spark, [s.name(t) for t in STORE])
    out = None
    for name, df in found.items():
        part = df.agg(F.lit(name.split(".")[1]).alias("table"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@add("rebuild_store", f"""WITH {STORE_SQL}, {TRAITS_SQL},
p AS (SELECT t.* , c.c_nationkey AS nk FROM traits t JOIN customer c ON c.c_custkey = t.subject_id)
SELECT 'subjects' AS "table", count(*) AS n FROM p WHERE nk < 15 OR nk >= 10
UNION ALL SELECT 'omics_features', (SELECT 2 * count(*) FROM p WHERE nk < 15) + (SELECT 2 * count(*) FROM p WHERE nk >= 10)
UNION ALL SELECT 'wearable_features', 4 * count(*) FROM traits UNION ALL SELECT 'cgm_features', 0
UNION ALL SELECT 'subject_crosswalk', count(*) FROM crosswalk UNION ALL SELECT 'predictions', 0 UNION ALL SELECT 'metrics', 0""")
def _rebuild(spark, sf):
    return store(spark).rebuild(panel_frames(spark, sf), crosswalk(spark, sf), {"wearable_features": melted(spark, sf)})
