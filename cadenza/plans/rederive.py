"""Queries of derivation after edits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.rederive import Stage, current, rederive
from ..sources import tables as T
from ..sources.shared import shared_dir
from ..sources.tables import cte
from .registry import query


def _placed(rows):
    earlier = Window.partitionBy("vid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("place_ms", F.greatest("start_ms", F.coalesce(F.sum("clip_ms").over(earlier), F.lit(0))))


#: A chain over the segment table: a line, how long it takes to say, where it goes.
CHAIN = [
    Stage("translate", ["text"], ["text_en"], lambda rows: rows.withColumn("text_en", F.concat(F.lit("en "), F.trim("text")))),
    Stage("tts", ["speaker"], ["clip_ms"], lambda rows: rows.withColumn("clip_ms", F.expr("15L * length(text_en) + 10 * length(speaker)"))),
    Stage("timeline", ["start_ms"], ["place_ms"], _placed),
]


@query("ed14_rederived", cte("segments") + """, e AS (SELECT vid, seq, CASE WHEN vid % 5 = 1 AND seq = 0 THEN 'narrator' ELSE speaker END AS speaker,
    CASE WHEN vid % 5 = 0 AND seq = 1 THEN text || ' again' ELSE text END AS text, CASE WHEN vid % 5 = 2 AND seq = 2 THEN start_ms + 500 ELSE start_ms END AS start_ms
    FROM segments WHERE NOT (vid % 5 = 3 AND seq = 1)),
  w AS (SELECT vid, max((vid % 5 = 0 AND seq = 1)::INT) AS a, max((vid % 5 = 1 AND seq = 0 AND speaker <> 'narrator')::INT) AS b, max((vid % 5 = 2 AND seq = 2)::INT) AS c, max((vid % 5 = 3 AND seq = 1)::INT) AS d FROM segments GROUP BY vid),
  t AS (SELECT e.*, 'en ' || trim(text) AS text_en, 15 * length('en ' || trim(text)) + 10 * length(speaker) AS clip_ms FROM e)
  SELECT t.vid, seq, text_en, clip_ms, greatest(start_ms, coalesce(sum(clip_ms) OVER (PARTITION BY t.vid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS place_ms,
    CASE WHEN b = 1 THEN 'tts' WHEN c = 1 THEN 'timeline' ELSE 'translate' END AS from_stage, 1 + greatest(a, b, c, d) AS version FROM t JOIN w ON t.vid = w.vid""")
def ed14(spark, sf_dir):
    """All videos derived, then lines, speakers, times and rows of some edited and only those derived again."""
    fields = T.segments(spark, sf_dir).select("vid", "seq", "speaker", "text", "start_ms")
    root = shared_dir(spark)
    rederive(root, fields, CHAIN)
    edited = fields.where("not (vid % 5 = 3 and seq = 1)").withColumns(
        {
            "speaker": F.expr("if(vid % 5 = 1 and seq = 0, 'narrator', speaker)"), "text": F.expr("if(vid % 5 = 0 and seq = 1, text || ' again', text)"),
            "start_ms": F.expr("if(vid % 5 = 2 and seq = 2, start_ms + 500, start_ms)"),
        }
    )
    rederive(root, edited, CHAIN)
    rows = current(spark, root)
    if rows is None:
        return fields.selectExpr("vid", "seq", "text AS text_en", "start_ms AS clip_ms", "start_ms AS place_ms", "text AS from_stage", "start_ms AS version").where("false")
    return rows.select("vid", "seq", "text_en", "clip_ms", "place_ms", "from_stage", "version")
