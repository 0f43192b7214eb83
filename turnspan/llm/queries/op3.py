"""op3_warc: every page written to ZIP-packaged WARC archives and read back, with DuckDB SQL for the same rows."""

import uuid

from pyspark.sql import functions as F

from turnspan.llm.registry import register, table
from turnspan.llm.warc import plan_records, read_archives, write_archives
from turnspan.session import shared_dir

SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages
), w AS (
  SELECT page_id, t, h, max(page_id) OVER (PARTITION BY h) AS m, count(*) OVER (PARTITION BY h) AS n FROM p
)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, ((k // 4) * 5 + 1)::INT, 5))::INT) >> (15 - 5 * (k % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN n > 1 AND m IS NOT NULL AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND m IS NOT NULL AND page_id IS DISTINCT FROM m THEN m END AS refers_to, true AS intact
FROM w
"""


@register("op3_warc", SQL)
def op3_warc(spark, sf_dir):
    """A null page is empty; see turnspan.llm.warc for the other edge cases."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(plan_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    found = read_archives(spark, path, payloads=False)
    return found.select(
        F.col("id").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
        "intact",
    )
