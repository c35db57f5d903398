"""Reader tables derived from the generic test tables, so that every operator has scalable input.

Each view is a projection or a filter of one Parquet table; feeds are the distinct sources of the
documents. Times are TIMESTAMP_NTZ and do not depend on the session time zone.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.session import PYTHON_BATCH, ship_package

AS_OF = datetime(2024, 1, 30, 12, 0, 0)
_DAY0 = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
_AS_OF = "TIMESTAMP_NTZ '2024-01-30 12:00:00'"


def as_of() -> Column:
    return F.expr(_AS_OF)


class ReaderViews:
    """Lazy accessors for one data directory; as streams with ``streaming=True``."""

    def __init__(self, spark: SparkSession, folder: str, streaming: bool = False):
        self.spark = spark
        self.folder = folder
        self.streaming = streaming
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", PYTHON_BATCH)
        ship_package(spark)

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        static = self.spark.read.parquet(path)
        if not self.streaming:
            return static
        reader = self.spark.readStream.schema(static.schema)
        jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = jvm_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.getFileStatus(jvm_path).isDirectory():
            return reader.parquet(path)
        # A file source watches folders; a table that is one file is picked by name.
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)

    def entries(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id AS entry_id",
            "CAST(substring(source, 4) AS BIGINT) AS feed_id",
            "substring(text, 1, 60) AS title",
            "text AS content",
            "lang AS author",
            "concat('https://', IF(doc_id % 2 = 0, 'www.', ''), source, '.example.com/a/', doc_id) AS url",
            "IF(doc_id % 3 = 0, 'read', 'unread') AS status",
            "doc_id % 10 = 0 AS starred",
            f"{_DAY0} + make_dt_interval(0, CAST(doc_id % 720 AS INT)) AS published_at",
        )

    def _sources(self) -> DataFrame:
        return self.table("documents").select("source").distinct()

    def feeds(self) -> DataFrame:
        fid = "CAST(substring(source, 4) AS BIGINT)"
        return self._sources().selectExpr(
            f"{fid} AS feed_id",
            "concat('Feed ', source) AS title",
            f"concat('https://', source, '.example.com/', IF({fid} % 5 = 1, concat('author/jo-', source), 'feed.xml')) AS feed_url",
            "concat('https://', source, '.example.com/') AS site_url",
            f"{fid} % 4 AS category_id",
            f"{_AS_OF} - make_dt_interval(0, CAST(({fid} * 25) % 48 AS INT)) AS checked_at",
            f"CAST({fid} % 5 AS INT) AS parsing_error_count",
            f"""CASE {fid} % 12 WHEN 0 THEN 'resource not found' WHEN 1 THEN 'Unable to detect feed format'
                WHEN 2 THEN 'access forbidden' WHEN 3 THEN 'server error' WHEN 4 THEN 'not authorized'
                WHEN 5 THEN 'tls: bad certificate' WHEN 6 THEN 'Unsupported scheme'
                WHEN 7 THEN 'dial tcp: lookup failed' WHEN 8 THEN 'dial tcp: refused'
                WHEN 9 THEN 'odd failure' ELSE '' END AS parsing_error_message""",
            f"{fid} % 9 = 8 AS disabled",
            f"{fid} % 7 = 3 AS fetch_via_proxy",
            f"{fid} % 6 = 5 AS allow_self_signed_certificates",
        )

    def feed_config(self) -> DataFrame:
        fid = "CAST(substring(source, 4) AS BIGINT)"
        return (
            self._sources()
            .where(f"{fid} % 4 <> 0")
            .selectExpr(
                f"{fid} AS feed_id",
                f"CAST(1 + {fid} % 3 AS INT) AS priority",
                f"{fid} % 2 = 0 AS fetch_full_content",
            )
        )

    def categories(self) -> DataFrame:
        """One category per region plus an empty one for every second region."""
        return self.table("region").selectExpr(
            "CAST(r_regionkey AS BIGINT) AS category_id", "r_name AS title"
        )

    def read_events(self) -> DataFrame:
        return (
            self.table("events")
            .where("event_type = 'view'")
            .selectExpr(
                "event_id AS id",
                "event_id % 200 AS entry_id",
                "user_id % 20 AS feed_id",
                "CAST(ts AS TIMESTAMP_NTZ) AS read_at",
            )
        )

    def snapshots(self) -> DataFrame:
        return self.table("conversations").selectExpr(
            "conv_id AS entry_id",
            "conv_id % 20 AS feed_id",
            "CAST(turn + 1 AS INT) AS version",
            "text AS content_text",
            "concat('<p>', text, '</p>') AS content_html",
            f"{_DAY0} + make_dt_interval(CAST(conv_id DIV 24 AS INT), CAST(conv_id % 24 AS INT), CAST(turn AS INT)) AS fetched_at",
            """CASE conv_id % 4
                 WHEN 0 THEN concat('{"summary":"old ', turn, '"}')
                 WHEN 1 THEN concat('{"summaries":{"default":"d', turn, '","eli5":"e', turn, '"}}')
                 WHEN 2 THEN concat('{"summaries":{"skeptic":"s', turn, '","eli5":"e', turn, '"},"summary":"old"}')
                 ELSE NULL END AS metadata""",
        )

    def polls(self) -> DataFrame:
        """Every turn is one poll of the entry; every third is polled again 30 seconds later."""
        once = self.table("conversations").selectExpr(
            "conv_id",
            "turn",
            "text",
            f"{_DAY0} + make_dt_interval(CAST(conv_id DIV 24 AS INT), CAST(conv_id % 24 AS INT), CAST(turn AS INT)) AS polled_at",
        )
        again = F.expr("IF((conv_id + turn) % 3 = 0, array(0, 30), array(0))")
        return once.withColumn("delay", F.explode(again)).selectExpr(
            "conv_id AS entry_id",
            "conv_id % 20 AS feed_id",
            "concat('https://src', conv_id % 20, '.example.com/a/', conv_id) AS url",
            "polled_at + make_dt_interval(0, 0, 0, delay) AS polled_at",
            "text AS content",
        )

    def tags(self) -> DataFrame:
        """Language of every document; quality and toxicity of labelled ones. One scan each."""
        lang = self.table("documents").selectExpr("doc_id AS entry_id", "lang AS tag")
        labelled = self.table("labels").selectExpr(
            "doc_id AS entry_id",
            """explode(filter(array(IF(quality = 1, 'quality', 'lowquality'), IF(toxic = 1, 'toxic', NULL)),
                 t -> t IS NOT NULL)) AS tag""",
        )
        return lang.unionByName(labelled)

    def embeddings(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "vec_id AS entry_id", "CAST(embedding AS ARRAY<DOUBLE>) AS embedding"
        )

    def fetch_attempts(self) -> DataFrame:
        stages = "IF(page_id % 2 = 0, array(1, 2, 3, 4), array(1, 2))"
        return (
            self.table("pages")
            .withColumn("stage", F.explode(F.expr(stages)))
            .selectExpr("url", "stage", "(page_id + stage) % 5 > 2 AS ok", "html AS body")
        )

    def url_history(self) -> DataFrame:
        """Chains of address changes of all lengths: numbered addresses move on by seven until a sign-up ends them."""
        return self.table("events").selectExpr(
            "event_id % 20 AS feed_id",
            "concat('https://old.example.com/', event_id) AS old_url",
            "concat(IF(event_type = 'signup', 'https://new.example.com/', 'https://old.example.com/'), event_id + 7) AS new_url",
            "IF(event_id % 2 = 0, 'set-url', 'auto-discover') AS source",
            f"{_DAY0} + make_dt_interval(0, 0, 0, CAST(event_id AS DECIMAL(18, 6))) AS changed_at",
        )

    def actions(self) -> DataFrame:
        """Reader actions on entries, one per event."""
        return self.table("events").selectExpr(
            "event_id AS seq",
            "user_id AS id",
            """CASE event_type WHEN 'view' THEN 'mark_read' WHEN 'click' THEN 'toggle_star'
               WHEN 'purchase' THEN 'star' WHEN 'signup' THEN 'mark_unread' ELSE 'pause' END AS action""",
            "CAST(NULL AS STRING) AS value",
            "CAST(ts AS TIMESTAMP_NTZ) AS ts",
        )

    def share_links(self) -> DataFrame:
        """One link per customer with a positive balance, to an entry of the documents."""
        return self.table("customer").where("c_acctbal > 0").selectExpr(
            "CAST(c_custkey % 200 AS BIGINT) AS entry_id",
            "concat('t', c_custkey) AS token",
            f"IF(c_custkey % 5 = 0, NULL, {_DAY0} + make_dt_interval(CAST(c_custkey % 60 AS INT))) AS expires_at",
        )

    def share_requests(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "CAST(o_orderkey AS BIGINT) AS request_id", "concat('t', o_custkey) AS token"
        )

    def site_settings(self) -> DataFrame:
        """Settings for hosts with and without the www prefix."""
        return self._sources().selectExpr(
            "explode(IF(CAST(substring(source, 4) AS INT) % 3 = 0, array(concat('www.', source, '.example.com'), concat(source, '.example.com')),"
            " array(concat(source, '.example.com')))) AS domain"
        ).where("NOT domain LIKE 'src1%'").selectExpr(
            "domain", "map('k', domain) AS settings"
        )
