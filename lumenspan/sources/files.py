"""Tolerant readers of whole JSON files, and a store partitioned by domain.

files(path, value) are whole files as text; whole_files() reads them. A file that can't be read as what it should be
comes out as a row with a status, never as a failure.

Defined cases: null and empty files are broken ones; empty folders and tables give no rows; extra fields are ignored;
a missing table or domain of the store is empty. A file is one row, so it must fit into a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "domain_id string, domain_name string, version string, papers array<struct<paper_id:string,title:string,source_url:string,document_path:string,year:int,exclude_from_evidence_graph:boolean>>"
CLAIM = "array<struct<claim_id:string,semantic_strength:string,condition:string>>"
EVENT = "array<struct<event_id:string,claim_id:string,event_type:string,evidence_id:string,is_valid:boolean,replace_valid:boolean,superseded_by:string,override_status:string>>"


def whole_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """files(path, value) of that name (a glob) anywhere below root."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root)
    return rows.select(F.col("_metadata.file_path").alias("path"), "value")


def _kind(value: Column) -> Column:
    """object, array or another kind of JSON; null where it is none."""
    return F.lower(F.regexp_extract(F.schema_of_variant(F.try_parse_json(value)), "^[A-Z]+", 0))


def inside(path: Column) -> Column:
    """Does a relative path stay below its root?"""
    steps = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    step = lambda s: F.when(s.isin("", "."), 0).when(s == "..", -1).otherwise(1)
    walk = F.aggregate(steps, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")), lambda at, s: F.struct((at["depth"] + step(s)).alias("depth"), F.least(at["least"], at["depth"] + step(s)).alias("least")))
    return ~path.rlike(r"^([/\\]|[A-Za-z]:)") & (walk["least"] >= 0)


def manifests(files: DataFrame) -> DataFrame:
    """A row for each paper of a corpus manifest, with its status.

    ok; metadata_only (left out of the evidence graph); outside_root (its document isn't below the manifest's folder);
    no_id; and for files broken (no JSON object) or no_domain (the domain's id, name or version is missing), one row each.
    A manifest without papers gives one row with status empty.
    """
    good = F.coalesce(_kind(F.col("value")) == "object", F.lit(False))
    rows = files.select("path", F.when(good, F.from_json("value", MANIFEST)).alias("m"))
    whole = F.col("m.domain_id").isNotNull() & F.col("m.domain_name").isNotNull() & F.col("m.version").isNotNull()
    rows = rows.select("path", "m.domain_id", "m.domain_name", "m.version", F.when(F.col("m").isNull(), "broken").when(~whole, "no_domain").alias("fault"), F.col("m.papers").alias("papers"))
    rows = rows.select("path", "domain_id", "domain_name", "version", "fault", F.explode_outer(F.when(F.col("fault").isNull(), F.col("papers"))).alias("p"))
    place = F.coalesce("p.document_path", F.lit(""))
    status = (
        F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("p").isNull(), "empty").when(F.coalesce("p.paper_id", F.lit("")) == "", "no_id")
        .when(~inside(place), "outside_root").when(F.coalesce("p.exclude_from_evidence_graph", F.lit(False)), "metadata_only").otherwise("ok")
    )
    return rows.select("path", "domain_id", "domain_name", "version", "p.paper_id", "p.title", "p.source_url", "p.year", "p.document_path", status.alias("status"))


def ledger(receipts: DataFrame, configs: DataFrame, summaries: DataFrame) -> DataFrame:
    """A row for each receipt, beside the run_config and the summary of its folder, newest first (then by folder).

    A receipt or config that is no JSON object and a summary that is no array leave the run with status invalid and the
    fault as its error. The folder's name stands for a missing title and slug.
    """
    folder = lambda df, name: df.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("run"), F.col("value").alias(name))
    rows = folder(receipts, "receipt").join(folder(configs, "config"), "run", "left").join(folder(summaries, "summary"), "run", "left")
    fault = F.when(F.coalesce(_kind(F.col("receipt")), F.lit("")) != "object", "receipt").when(F.coalesce(_kind(F.col("config")), F.lit("")) != "object", "config").when(F.coalesce(_kind(F.col("summary")), F.lit("")) != "array", "summary")
    rows = rows.withColumns({"error": fault, "c": F.try_parse_json("config"), "r": F.try_parse_json("receipt")})
    of = lambda v, field, kind="string": F.when(F.col("error").isNull(), F.try_variant_get(v, f"$.{field}", kind))
    parent = F.regexp_extract("run", "([^/]+)/[^/]+$", 1)
    rows = rows.select(
        "run", F.coalesce(of("c", "slug"), parent).alias("experiment"), F.coalesce(of("c", "title"), parent).alias("title"), of("c", "generated_at").alias("generated_at"),
        F.when(F.col("error").isNotNull(), "invalid").otherwise(F.coalesce(of("r", "status"), F.lit("unknown"))).alias("status"), F.coalesce(of("c", "evaluation_type"), F.lit("unknown")).alias("evaluation_type"),
        of("c", "provenance.git.head").alias("git_head"), of("c", "provenance.git.dirty", "boolean").alias("git_dirty"), F.when(F.col("error").isNull(), F.size(F.from_json("summary", "array<string>"))).alias("n_summary"), "error",
    )
    return rows.orderBy(F.desc_nulls_last("generated_at"), "run")


def frozen_cases(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, events, broken) of case files: their claims with plain as the default strength, their events with `seq` in the file's order, and the paths of files that are no JSON objects."""
    rows = files.withColumn("kind", _kind(F.col("value")))
    good = rows.where("kind = 'object'").select("path", F.from_json("value", f"claims {CLAIM}, events {EVENT}").alias("c"))
    claims = good.select("path", F.explode("c.claims").alias("x")).select("path", "x.claim_id", F.coalesce("x.semantic_strength", F.lit("plain")).alias("semantic_strength"), "x.condition")
    events = good.select("path", F.posexplode("c.events").alias("seq", "x")).select("path", "seq", "x.*")
    return claims, events, rows.where("kind IS NULL OR kind <> 'object'").select("path")


# A store with a folder for each domain.

def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_domains(tables: dict[str, DataFrame], root: str, domain: str = "domain") -> None:
    """Each table below root, with a folder for each of its domains."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").partitionBy(domain).parquet(f"{root}/{name}")


def scan_domain(spark: SparkSession, root: str, table: str, schema: str, wanted: str, domain: str = "domain") -> DataFrame:
    """A table's rows of one domain, read from its folder alone; a missing table or domain is empty."""
    from pyspark.sql.types import StringType, StructField, StructType

    fields = spark.createDataFrame([], schema).schema.fields
    whole = StructType([*(f for f in fields if f.name != domain), StructField(domain, StringType())])
    if not _exists(spark, f"{root}/{table}"):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(f"{root}/{table}").where(F.col(domain) == wanted)


def domain_counts(spark: SparkSession, root: str, tables: dict[str, str], domain: str = "domain") -> DataFrame:
    """(domain, table, n_rows) of every domain that some table has; missing tables count 0."""
    out = None
    for name, schema in tables.items():
        if not _exists(spark, f"{root}/{name}"):
            continue
        fields = spark.createDataFrame([], schema).schema
        rows = spark.read.schema(fields if domain in fields.names else fields.add(domain, "string")).parquet(f"{root}/{name}").groupBy(domain).agg(F.count("*").alias("n_rows"))
        rows = rows.select(F.col(domain).cast("string").alias("domain"), F.lit(name).alias("table"), "n_rows")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "domain string, table string, n_rows long")
    every = out.select("domain").distinct().select("domain", F.explode(F.array(*map(F.lit, tables))).alias("table"))
    return every.join(out, ["domain", "table"], "left").select("domain", "table", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
