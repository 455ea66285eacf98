"""Bills, people, predictions and logs as views over the driver's tables.

Each view is SQL text that Spark and DuckDB read alike, so a query and its oracle start from the same rows; what the
operators do with them is written separately for each. All choices are arithmetic on keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tallyweave.sources.readers import shared_path

TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")

VIEWS: dict[str, str] = {
    "item_base": """
        SELECT l_orderkey AS bill_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS INT) AS item_idx,
               p_name AS name, CAST(l_quantity AS INT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS total_cents,
               l_partkey AS part, l_suppkey AS supp, CAST(round(l_discount * 100) AS BIGINT) AS dpct, CAST(round(l_tax * 100) AS BIGINT) AS tpct
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "bill_items": """
        SELECT bill_id, item_idx, name, qty,
               CAST(floor(CAST(total_cents AS DOUBLE) / qty + 0.5) AS BIGINT) + CASE WHEN (bill_id * 31 + item_idx) % 13 = 0 THEN 500 ELSE 0 END AS unit_cents,
               total_cents, part, supp FROM item_base""",
    "bill_sums": """
        SELECT bill_id, CAST(sum(total_cents) AS BIGINT) AS items, CAST(floor(sum(total_cents * dpct) / 100) AS BIGINT) AS disc,
               CAST(floor(sum(total_cents * tpct) / 100) AS BIGINT) AS tax,
               CASE WHEN bill_id % 3 = 0 THEN CAST(floor(sum(total_cents) * 5 / 100) AS BIGINT) ELSE 0 END AS service
        FROM item_base GROUP BY bill_id""",
    "bill_round": """
        SELECT bill_id, items, disc, tax, service, items - disc + tax + service AS s,
               CAST(floor((items - disc + tax + service) / 100) AS BIGINT) AS q FROM bill_sums""",
    "charge_lines": """
        SELECT bill_id, 0 AS pos, 'DISCOUNT' AS type, -disc AS amount_cents FROM bill_round
        UNION ALL SELECT bill_id, 1 AS pos, 'SERVICE_CHARGE' AS type, service AS amount_cents FROM bill_round
        UNION ALL SELECT bill_id, 2 AS pos, 'TAX' AS type, tax AS amount_cents FROM bill_round
        UNION ALL SELECT bill_id, 3 AS pos, 'ROUND_OFF' AS type,
            CASE WHEN bill_id % 2 <> 0 THEN 0 WHEN s - 100 * q > 50 OR (s - 100 * q = 50 AND q % 2 = 1) THEN 100 * q + 100 - s ELSE 100 * q - s END AS amount_cents FROM bill_round""",
    "bill_charges": """
        SELECT bill_id, CAST(row_number() OVER (PARTITION BY bill_id ORDER BY pos) - 1 AS INT) AS charge_idx, type, CAST(amount_cents AS BIGINT) AS amount_cents
        FROM charge_lines WHERE amount_cents <> 0""",
    "charge_sums": "SELECT bill_id, CAST(sum(amount_cents) AS BIGINT) AS charges FROM bill_charges GROUP BY bill_id",
    "bills": """
        SELECT o_orderkey AS bill_id, c_mktsegment AS source,
               CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split,
               CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE coalesce(items, 0) + CASE WHEN o_orderkey % 10 = 4 THEN 500 ELSE 0 END END AS subtotal_cents,
               CASE WHEN o_orderkey % 10 = 2 THEN NULL ELSE coalesce(items, 0) + coalesce(charges, 0)
                    + CASE WHEN o_orderkey % 10 = 0 THEN 40 WHEN o_orderkey % 10 = 1 THEN 75 ELSE 0 END END AS grand_cents
        FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN bill_sums ON o_orderkey = bill_sums.bill_id
             LEFT JOIN charge_sums ON o_orderkey = charge_sums.bill_id""",
    "suppliers_n": "SELECT count(*) AS n FROM supplier",
    "assignments": """
        SELECT bill_id, item_idx, concat('S', CAST(supp AS STRING)) AS person, 0 AS ord, CAST(1 + part % 3 AS INT) AS units FROM bill_items WHERE (bill_id + item_idx) % 97 <> 0
        UNION ALL
        SELECT bill_id, item_idx, concat('S', CAST((supp + 1) % n AS STRING)) AS person, 1 AS ord, 1 AS units FROM bill_items, suppliers_n WHERE (bill_id + item_idx) % 97 <> 0 AND part % 3 = 0""",
    "people_first": "SELECT bill_id, person, min(item_idx * 2 + ord) AS first_at FROM assignments GROUP BY bill_id, person",
    "people_all": """
        SELECT bill_id, person, first_at FROM people_first
        UNION ALL SELECT o_orderkey AS bill_id, 'X' AS person, 1000000 AS first_at FROM orders WHERE o_orderkey % 19 = 0""",
    "people": """
        SELECT bill_id, CAST(row_number() OVER (PARTITION BY bill_id ORDER BY first_at, person) - 1 AS INT) AS person_ord, person FROM people_all""",
    # What a recogniser read: the bills with known edits.
    "last_item": "SELECT bill_id, max(item_idx) AS last_idx FROM bill_items GROUP BY bill_id",
    "pred_items": """
        SELECT i.bill_id AS bill_id, item_idx, CASE WHEN (i.bill_id + item_idx) % 17 = 0 THEN substr(name, 2) ELSE name END AS name, qty,
               unit_cents + CASE WHEN (i.bill_id * 31 + item_idx) % 13 = 1 THEN 500 ELSE 0 END AS unit_cents, total_cents
        FROM bill_items i JOIN last_item l ON i.bill_id = l.bill_id WHERE NOT (i.bill_id % 11 = 0 AND item_idx = last_idx)""",
    "pred_charges": """
        SELECT bill_id, charge_idx, CASE WHEN bill_id % 7 = 0 AND charge_idx = 0 THEN 'OTHER' ELSE type END AS type, amount_cents FROM bill_charges""",
    "pred_bills": """
        SELECT bill_id, source, split, subtotal_cents, grand_cents + CASE WHEN bill_id % 23 = 0 THEN 100 ELSE 0 END AS grand_cents FROM bills""",
    "overrides": "SELECT bill_id, person, CAST(1000 + bill_id * 37 % 5000 AS BIGINT) AS new_final FROM people WHERE person_ord = 0 AND bill_id % 5 = 0",
    # Typed readings with unreadable numbers as null.
    "read_items": """
        SELECT bill_id, item_idx, name, CASE WHEN (bill_id * 3 + item_idx) % 89 = 0 THEN NULL ELSE qty END AS qty, unit_cents,
               CASE WHEN (bill_id * 7 + item_idx) % 101 = 0 THEN NULL ELSE total_cents END AS total_cents FROM pred_items""",
    "read_charges": """
        SELECT bill_id, charge_idx, type, CASE WHEN (bill_id * 5 + charge_idx) % 97 = 0 THEN NULL ELSE amount_cents END AS amount_cents FROM pred_charges""",
    "field_rows": """
        SELECT bill_id, item_idx, 0 AS ford, 'name' AS field, CASE WHEN (bill_id + item_idx) % 17 = 0 THEN 0 ELSE 1 END AS correct FROM pred_items
        UNION ALL SELECT bill_id, item_idx, 1 AS ford, 'qty' AS field, 1 AS correct FROM pred_items
        UNION ALL SELECT bill_id, item_idx, 2 AS ford, 'unit_price' AS field, CASE WHEN (bill_id * 31 + item_idx) % 13 = 1 THEN 0 ELSE 1 END AS correct FROM pred_items
        UNION ALL SELECT bill_id, item_idx, 3 AS ford, 'total' AS field, 1 AS correct FROM pred_items
        UNION ALL SELECT bill_id, 0 AS item_idx, 4 AS ford, 'grand_total' AS field, CASE WHEN bill_id % 23 = 0 THEN 0 ELSE 1 END AS correct FROM pred_bills""",
    "field_hash": "SELECT *, (bill_id * 7919 + item_idx * 104729 + ford * 1299709) % 1000 AS h FROM field_rows",
    "field_min": """
        SELECT bill_id, item_idx, field, correct, h,
               CAST(1 AS DOUBLE) - CAST(h AS DOUBLE) / CAST(1000 AS DOUBLE) * CASE WHEN correct = 1 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS p_min FROM field_hash""",
    "field_conf": """
        SELECT bill_id, CASE WHEN field = 'grand_total' THEN 'grand_total' ELSE concat('items[', CAST(item_idx AS STRING), '].', field) END AS path, field, correct,
               round(p_min, 6) AS p_min, round((CAST(1 AS DOUBLE) + p_min) / 2, 6) AS p_mean, CASE WHEN h % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE round((CAST(1 AS DOUBLE) + p_min) / 2, 6) END AS p_first
        FROM field_min""",
    "manifest": """
        SELECT doc_id AS id, source, text, md5(text) AS content_hash,
               CASE WHEN substr(md5(CAST(doc_id AS STRING)), 1, 1) IN ('0', '1') THEN 'test' WHEN substr(md5(CAST(doc_id AS STRING)), 1, 1) IN ('2', '3') THEN 'val' ELSE 'train' END AS split
        FROM documents""",
    "run_log": """
        SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS epoch,
               CASE WHEN event_id % 97 < 3 THEN CAST('NaN' AS DOUBLE) ELSE value / 100 END AS loss, CAST(event_id % 1000 AS DOUBLE) / 1000 AS score, ts, event_id
        FROM events""",
    # Events in three deliveries: out of order by up to 40 places, and one in 97 by 600.
    "arrivals": """
        SELECT event_id, ts, user_id, event_type, value, CAST(least(2, floor((event_id + event_id * 7919 % 40 + CASE WHEN event_id % 97 = 5 THEN 600 ELSE 0 END) * 3 / n)) AS INT) AS part
        FROM events, (SELECT count(*) AS n FROM events) c""",
    # Objects in objects and in lists, lists in lists, empty ones and nulls.
    "nested_events": """
        SELECT event_id, concat('{"kind":"', event_type, '","props":', props, ',"parts":[', props, ',{"t":', CAST(user_id AS STRING),
               CASE WHEN user_id % 3 = 0 THEN ',"deep":[[{"z":null}],{},[]]' ELSE '' END, '}]}') AS body FROM events""",
    "headers": """
        SELECT o_orderkey AS id, c_name AS company, n_name AS address, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS total,
               CASE o_orderkey % 9 WHEN 0 THEN '2018-03-12' WHEN 1 THEN '12/03/2018' WHEN 2 THEN '12-03-18' WHEN 3 THEN '12.03.2018'
                    WHEN 4 THEN '12 Mar 2018' WHEN 5 THEN '12 MARCH 18' WHEN 6 THEN 'Mar 12, 2018' WHEN 7 THEN 'on Monday' ELSE '' END AS date
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "image_stats": """
        SELECT p_partkey AS id, CAST(400 + (p_partkey * 37) % 1200 AS DOUBLE) AS w, CAST(300 + (p_partkey * 53) % 900 AS DOUBLE) AS h,
               CAST((p_partkey * 7) % 60 AS DOUBLE) AS blur, CAST(30 + (p_partkey * 11) % 220 AS DOUBLE) AS mean, CAST(150 + (p_partkey * 13) % 106 AS DOUBLE) AS paper,
               CAST((p_partkey * 17) % 140 AS DOUBLE) AS contrast, CAST((p_partkey * 19) % 100 AS DOUBLE) / 10 - 5 AS skew
        FROM part""",
    "money_text": """
        SELECT bill_id * 100 + item_idx AS id,
               CASE (bill_id + item_idx) % 8 WHEN 0 THEN '1,250.50' WHEN 1 THEN concat('Rs ', CAST(total_cents % 1000 AS STRING), '.000') WHEN 2 THEN concat('(', CAST(total_cents % 97 AS STRING), ')')
                    WHEN 3 THEN '-5,000' WHEN 4 THEN concat(CAST(total_cents % 89 AS STRING), ',00') WHEN 5 THEN concat(CAST(total_cents % 83 AS STRING), '-') WHEN 6 THEN '1.234.567' ELSE '' END AS raw
        FROM bill_items""",
}


#: Views with the rows of VIEWS that Spark makes in fewer passes: predicted items are read once, not once for each of their fields.
SPARK_VIEWS: dict[str, str] = {
    "field_rows": """
        SELECT bill_id, item_idx, f.ford AS ford, f.field AS field, f.correct AS correct FROM pred_items
        LATERAL VIEW inline(array(
            named_struct('ford', 0, 'field', 'name', 'correct', CASE WHEN (bill_id + item_idx) % 17 = 0 THEN 0 ELSE 1 END), named_struct('ford', 1, 'field', 'qty', 'correct', 1),
            named_struct('ford', 2, 'field', 'unit_price', 'correct', CASE WHEN (bill_id * 31 + item_idx) % 13 = 1 THEN 0 ELSE 1 END), named_struct('ford', 3, 'field', 'total', 'correct', 1))) f
        UNION ALL SELECT bill_id, 0 AS item_idx, 4 AS ford, 'grand_total' AS field, CASE WHEN bill_id % 23 = 0 THEN 0 ELSE 1 END AS correct FROM pred_bills""",
}


def mean_sql(x: str, places: int = 6) -> str:
    """DuckDB text of operators.runs.exact_mean for numbers not under 0."""
    unit = 10 ** (9 - places)
    return f"CAST((2 * CAST(sum(CAST(round({x} * 1000000000) AS BIGINT)) AS HUGEINT) + {unit} * count({x})) // ({2 * unit} * count({x})) AS DOUBLE) / {10**places}"


def _words(sql: str) -> set[str]:
    return set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())


def _needed(sql: str, seen: list[str], tables: Sequence[str] = ()) -> None:
    """Appends the views that the text mentions, each after what it needs itself; those in tables are there already."""
    words = _words(sql)
    for name, body in VIEWS.items():
        if name in words and name not in seen and name not in tables:
            _needed(body, seen, tables)
            seen.append(name)


def with_views(sql: str, tables: Sequence[str] = (), own: dict[str, str] | None = None) -> str:
    """The text with the views it mentions, but those in tables, as a WITH clause; its own WITH clause may follow. own: texts
    that stand for those of VIEWS, over the same views."""
    names: list[str] = []
    _needed(sql, names, tables)
    if not names:
        return sql
    rest, text = sql.lstrip(), VIEWS | (own or {})
    head = "WITH " + ",\n".join(f"{n} AS ({text[n]})" for n in names)
    return head + (",\n" + rest[4:] if rest[:5].upper() == "WITH " else "\n" + rest)


def oracle(sql: str) -> str:
    """with_views for DuckDB."""
    return with_views(sql).replace("AS STRING)", "AS VARCHAR)")


#: Views that many queries start from: written once for a session and data folder, then read as tables. Each is made from
#: those before it and lies in buckets of bill_id, so that joins and groups by bill need no exchange. The other views of
#: bills only compute columns of these or join them inside a bucket.
STORED = ("item_base", "bill_sums", "bill_charges", "bills", "people")
#: Bytes of orders and lines for one bucket.
BUCKET = 8_000_000
_stored: dict[tuple[str, str, str, int], str] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """When the tables that the views start from were last written, and the bytes of orders and lines."""
    newest = size = 0
    for t in ("orders", "lineitem", "part", "customer", "supplier"):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at):
            newest = max(newest, fs.getFileStatus(at).getModificationTime())
            size += fs.getContentSummary(at).getLength() if t in ("orders", "lineitem") else 0
    return newest, size


def _tables(spark: SparkSession, sf_dir: str, sql: str) -> None:
    for t in set(TABLES) & _words(sql):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


@contextmanager
def _partitions(spark: SparkSession, n: int):
    """Shuffles in n whole partitions, so that one by bill_id already is in buckets."""
    own = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _store(spark: SparkSession, sf_dir: str, name: str, newest: int, buckets: int) -> str:
    """The name of the bucketed table of a stored view, written with what it needs if it isn't there."""
    key = (spark.sparkContext.applicationId, sf_dir, name, newest)
    if key not in _stored:
        at = STORED.index(name)
        sql = with_views(f"SELECT * FROM {name}", STORED[:at])
        held = {n: _store(spark, sf_dir, n, newest, buckets) for n in STORED[:at] if n in _words(sql)}
        _tables(spark, sf_dir, sql)
        for n, table in held.items():
            spark.table(table).createOrReplaceTempView(n)
        path = shared_path(spark, name)
        table = path.rsplit("/", 1)[1].replace("-", "_")
        with _partitions(spark, buckets):
            rows = spark.sql(sql).repartition(buckets, "bill_id")
            rows.write.bucketBy(buckets, "bill_id").sortBy("bill_id").option("path", path).format("parquet").saveAsTable(table)
        for n in held:
            spark.catalog.dropTempView(n)
        _stored[key] = table
    return _stored[key]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view (or a driver's table) as a DataFrame."""
    if name in TABLES and name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    newest, size = _state(spark, sf_dir)
    buckets = max(spark.sparkContext.defaultParallelism, -(-size // BUCKET))
    if name in STORED:
        return spark.table(_store(spark, sf_dir, name, newest, buckets))
    sql = with_views(f"SELECT * FROM {name}", STORED, SPARK_VIEWS)
    tables = {n: _store(spark, sf_dir, n, newest, buckets) for n in STORED if n in _words(sql)}  # all first, as storing one drops the names of those it reads
    for n, table in tables.items():
        spark.table(table).createOrReplaceTempView(n)
    _tables(spark, sf_dir, sql)
    return spark.sql(sql)
