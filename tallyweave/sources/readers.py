"""Readers for manifests, bill files, entity texts, nested receipts, prediction dumps and logs, and the two sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.money import canon_num, parse_int, parse_money
from tallyweave.operators.normalise import RECORD, export_json

MANIFEST = "id BIGINT, image STRING, gt STRING, task STRING, source STRING, split STRING"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir), or in the warehouse where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def read_manifest(spark: SparkSession, paths: Sequence[str], schema: str = MANIFEST) -> DataFrame:
    """Records of JSON-lines manifests; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(list(paths)).where("id IS NOT NULL")


def read_bill_files(spark: SparkSession, path: str) -> DataFrame:
    """bill_records of a folder with one JSON document in each file."""
    return bill_records(whole_files(spark, path))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): the files below a folder, each as one text; paths as they are named, without URL escapes."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(_unescaped(F.col("_metadata.file_path")).alias("path"), "value")


def _unescaped(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


BUNDLE = "path STRING, value STRING"


def write_documents(rows: DataFrame, path: str, single: Column) -> str:
    """Documents (path, value) below a folder: `files` has a file for each that `single` holds for, `bundles` all others.

    A file of its own costs a listing entry and an open; bundles are JSON lines of (path, value), which Spark splits and packs
    by size, so only a bounded number of documents should be single. A null text is written as an empty one.
    """
    rows = rows.select("path", F.coalesce("value", F.lit("")).alias("value"), F.coalesce(single, F.lit(False)).alias("__single"))
    rows.where("__single").select(stem(F.col("path")).alias("stem"), "value").write.partitionBy("stem").text(f"{path}/files")
    rows.where("NOT __single").select("path", "value").write.json(f"{path}/bundles")
    return path


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of a folder with single files and bundles, as write_documents lays it out."""
    return whole_files(spark, f"{path}/files").unionByName(spark.read.schema(BUNDLE).json(f"{path}/bundles").select("path", "value"))


def list_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path) of a folder's single files, which are not opened, and of the documents in its bundles."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/files").select("path")
    return names.unionByName(spark.read.schema("path STRING").json(f"{path}/bundles").select("path"))


def first_folder(spark: SparkSession, base: str, names: Sequence[str]) -> str | None:
    """The first of these folders below base that exists; datasets name the same folder differently."""
    for name in names:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return f"{base}/{name}"
    return None


def with_sibling(rows: DataFrame, listing: DataFrame, name: str = "sibling") -> DataFrame:
    """rows (stem, ...) with the path of the file of the same stem in a listing (path); null without one, the least of several."""
    other = listing.groupBy(stem(F.col("path")).alias("stem")).agg(F.min("path").alias(name))
    return rows.join(other.hint("merge"), "stem", "left")


def bill_records(files: DataFrame) -> DataFrame:
    """(stem, bill) of JSON documents (path, value), named by the file or its key=value folder.

    Very many small documents are best kept as rows of a table with their paths, not as a file each.
    """
    return files.select(stem(F.col("path")).alias("stem"), F.from_json("value", RECORD).alias("bill"))


def stem(path: Column) -> Column:
    """The value of the last key=value folder (its escapes taken back), or the file's name without its ending."""
    folder = F.regexp_extract(path, "=([^/=]+)/[^/]+$", 1)
    return F.when(folder != "", _unescaped(folder)).otherwise(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """entities of a folder with one text in each file."""
    return entities(whole_files(spark, path))


def entities(files: DataFrame) -> DataFrame:
    """(stem, entities MAP) of texts (path, value): JSON objects, or `key: value` lines where the first colon splits and the
    last key wins."""
    return files.select(stem(F.col("path")).alias("stem"), parse_entities(F.col("value")).alias("entities"))


def parse_entities(text: Column) -> Column:
    """The entities of a text as a map; null if there are none."""
    as_json = F.from_json(text, "map<string,string>")
    lines = F.filter(F.split(text, "\r?\n"), lambda x: x.contains(":"))
    pair = F.transform(lines, lambda x: F.split(x, ":", 2))
    key = lambda p: F.lower(F.regexp_replace(F.trim(p[0]), '^"+|"+$', ""))
    value = lambda p: F.regexp_replace(F.trim(p[1]), '^[",]+|[",]+$', "")
    entries = F.transform(pair, lambda p: F.struct(key(p).alias("key"), value(p).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    is_object = text.rlike(r"^\s*\{") & F.try_parse_json(text).isNotNull()
    return F.when(is_object, as_json).when(F.size(last) > 0, F.map_from_entries(last))


def pair_files(spark: SparkSession, folders: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """pair_listing over folders of files by kind."""
    names = None
    for kind, path in folders.items():
        part = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.lit(kind).alias("kind"), "path")
        names = part if names is None else names.unionByName(part)
    return pair_listing(names, len(folders))


def pair_listing(files: DataFrame, kinds: int) -> tuple[DataFrame, DataFrame]:
    """(complete, incomplete) stems of a listing (kind, path): complete ones have a file of every kind."""
    have = files.groupBy(stem(F.col("path")).alias("stem")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))  # a few kinds
    return have.where(F.size("kinds") == kinds), have.where(F.size("kinds") < kinds)


def header_label(rows: DataFrame) -> DataFrame:
    """(stem, company, date, address, total) from entities; the total canonical, or empty."""
    get = lambda k: F.trim(F.coalesce(F.col("entities")[k], F.lit("")))
    return rows.select("stem", get("company").alias("company"), get("date").alias("date"), get("address").alias("address"), F.coalesce(canon_num(parse_money(F.col("entities")["total"])), F.lit("")).alias("total"))


def nested_receipt(rows: DataFrame, text: str = "raw") -> DataFrame:
    """(bill_id, bill) from nested receipt JSON whose menu, sub_total and total may be an object or an array.

    A line without a name or any price is left out; a missing unit price or total follows from the other. Charges of 0 are
    left out and discounts negative; a missing subtotal is the sum of the lines; without a total there is no record.
    """
    v = F.try_parse_json(text)
    get = lambda x, p: F.trim(F.coalesce(F.try_variant_get(x, p, "string"), F.lit("")))
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    one = lambda p: F.when(kind(F.try_variant_get("v", p, "variant")).startswith("ARRAY"), F.try_variant_get("v", f"{p}[0]", "variant")).otherwise(F.try_variant_get("v", p, "variant"))
    r = rows.select("bill_id", v.alias("v"))
    menu = F.when(kind(F.try_variant_get("v", "$.menu", "variant")).startswith("ARRAY"), F.try_variant_get("v", "$.menu", "array<variant>")).when(F.try_variant_get("v", "$.menu", "variant").isNotNull(), F.array(F.try_variant_get("v", "$.menu", "variant")))
    r = r.select("bill_id", menu.alias("menu"), one("$.sub_total").alias("st"), one("$.total").alias("tt"))
    name = lambda m: F.when(kind(F.try_variant_get(m, "$.nm", "variant")).startswith("ARRAY"), F.array_join(F.try_variant_get(m, "$.nm", "array<string>"), " ")).otherwise(get(m, "$.nm"))
    raw = F.transform("menu", lambda m: F.struct(F.trim(name(m)).alias("name"), F.greatest(F.lit(1), parse_int(get(m, "$.cnt"), 1)).alias("qty"), parse_money(get(m, "$.unitprice")).alias("u"), parse_money(get(m, "$.price")).alias("t")))
    full = F.transform(raw, lambda i: F.struct(
        i["name"].alias("name"), i["qty"].alias("qty"), F.coalesce(i["u"], (i["t"] / i["qty"]).cast("decimal(38,4)")).alias("u"), F.coalesce(i["t"], (i["u"] * i["qty"]).cast("decimal(38,4)")).alias("t"),
    ))
    items = F.filter(full, lambda i: (i["name"] != "") & i["t"].isNotNull())
    r = r.withColumn("items", F.coalesce(items, F.expr("cast(array() as array<struct<name:string,qty:int,u:decimal(38,4),t:decimal(38,4)>>)")))
    charge = lambda kind_, key, neg=False: F.struct(F.lit(kind_).alias("type"), (-F.abs(parse_money(get(F.col("st"), key))) if neg else parse_money(get(F.col("st"), key))).alias("a"))
    charges = F.filter(F.array(charge("TAX", "$.tax_price"), charge("SERVICE_CHARGE", "$.service_price"), charge("OTHER", "$.othersvc_price"), charge("DISCOUNT", "$.discount_price", True)), lambda c: c["a"] != 0)
    total = F.aggregate("items", F.lit(0).cast("decimal(38,4)"), lambda s, i: (s + i["t"]).cast("decimal(38,4)"))
    sub, grand = F.coalesce(parse_money(get(F.col("st"), "$.subtotal_price")), total), parse_money(get(F.col("tt"), "$.total_price"))
    bill = F.struct(
        F.transform("items", lambda i: F.struct(i["name"].alias("name"), i["qty"].cast("string").alias("qty"), canon_num(i["u"]).alias("unit_price"), canon_num(i["t"]).alias("total"))).alias("items"),
        F.transform(charges, lambda c: F.struct(c["type"].alias("type"), canon_num(c["a"]).alias("amount"))).alias("charges"), canon_num(sub).alias("subtotal"), canon_num(grand).alias("grand_total"),
    )
    return r.where(grand.isNotNull()).select("bill_id", bill.cast(RECORD).alias("bill"))


def explode_predictions(dump: DataFrame) -> DataFrame:
    """(id, source, path, field, value, p_first, p_mean, p_min, correct): a row for each field of a dump (fields, correct)."""
    rows = dump.select("id", "source", F.explode(F.arrays_zip("fields", "correct")).alias("z"))
    f = F.col("z.fields")
    return rows.select("id", "source", f["path"].alias("path"), F.element_at(F.split(f["path"], r"\."), -1).alias("field"), f["value"].alias("value"), f["p_first"].alias("p_first"), f["p_mean"].alias("p_mean"), f["p_min"].alias("p_min"), F.col("z.correct").alias("correct"))


RUN_LOG = "epoch INT, train_loss DOUBLE, epoch_sec DOUBLE, val MAP<STRING,DOUBLE>"


def merge_run_logs(spark: SparkSession, paths: Sequence[str], schema: str = RUN_LOG) -> DataFrame:
    """Run records of several JSON-lines files or folders; for each epoch the last record.

    Later in order is: later in the list, then the later file of a folder by path, then the later line.
    """
    rows = None
    for i, path in enumerate(paths):
        part = numbered_lines(spark, path).select(F.struct(F.lit(i).alias("no"), "file", "block", "line").alias("at"), F.from_json("value", schema).alias("r"))
        rows = part if rows is None else rows.unionByName(part)
    return last_of_epoch(rows, "at")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value): the lines of text files; (block, line) rises along a file.

    A task reads a block of a file in order, so the running number of its rows orders them, and blocks are ordered by where
    they start. Spark deals out blocks by size, so the number alone would not be the files' order.
    """
    m = F.col("_metadata")
    return spark.read.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def last_of_epoch(rows: DataFrame, order: str) -> DataFrame:
    """The fields of r in the last row of each epoch: an aggregate that combines before the exchange, so no epoch is too large."""
    return rows.where("r.epoch IS NOT NULL").groupBy("r.epoch").agg(F.max_by("r", order).alias("r")).select("r.*")


def scrape_logs(lines: DataFrame, schema: str = "epoch INT, train_loss DOUBLE, epoch_sec DOUBLE", least_seconds: float = 100.0) -> DataFrame:
    """Records printed as {'epoch': ...} in free text (line_no, value); short epochs are dropped, the last of an epoch wins."""
    text = F.trim("value")
    rows = lines.where(text.startswith("{'epoch'")).select("line_no", F.from_json(F.regexp_replace(text, "'", '"'), schema).alias("r")).where(F.col("r.epoch_sec") > least_seconds)
    return last_of_epoch(rows, "line_no")


def write_manifest(manifest: DataFrame, path: str, fmt: str = "json") -> str:
    """Manifest files by split and source, so that readers prune what they don't need."""
    manifest.write.partitionBy("split", "source").format(fmt).save(path)
    return path


def write_export(bills: DataFrame, path: str) -> str:
    """Numeric exports as JSON lines."""
    export_json(bills).select(F.col("json").alias("value")).write.text(path)
    return path
