"""Queries of the timeline operators, over segments of conversations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import timeline as L
from ..sources import tables as T
from ..sources.tables import cte
from .registry import query


def items(spark, sf_dir):
    return T.segments(spark, sf_dir).selectExpr("vid", "seq", "speaker", "start_ms AS source_start", "end_ms AS source_end", "dur_ms", "stretchable")


def media_ends(spark, sf_dir):
    return items(spark, sf_dir).groupBy("vid").agg(F.expr("max(source_end) - (max(source_end) - min(source_start)) div 10").alias("media_end"))


ITEMS = cte("segments") + ", items AS (SELECT vid, seq, speaker, start_ms AS source_start, end_ms AS source_end, dur_ms, stretchable FROM segments)"
CLOSED = ITEMS + """, nd AS (SELECT *, coalesce(least(100, greatest(5, source_start - lag(source_end) OVER w)), 0) AS need FROM items WINDOW w AS (PARTITION BY vid ORDER BY seq)),
sm AS (SELECT *, coalesce(sum(dur_ms) OVER (PARTITION BY vid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(need) OVER (PARTITION BY vid ORDER BY seq) AS s FROM nd),
closed AS (SELECT *, (s + max(source_start - s) OVER (PARTITION BY vid ORDER BY seq))::BIGINT AS start_ms FROM sm)"""


@query("k9_place_closed", f"{CLOSED} SELECT vid, seq, start_ms, start_ms + dur_ms AS end_ms, start_ms - source_start AS drift_ms FROM closed")
def k9_closed(spark, sf_dir):
    return L.placed_closed(items(spark, sf_dir)).select("vid", "seq", "start_ms", "end_ms", "drift_ms")


ENDS = ", ends AS (SELECT vid, max(source_end) - (max(source_end) - min(source_start)) // 10 AS media_end FROM items GROUP BY vid)"
NO_ENDS = ", ends AS (SELECT vid, NULL::BIGINT AS media_end FROM segments GROUP BY vid)"


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def placing(items: str, name: str, genre: str = "documentary") -> str:
    """K9 in SQL: ``name``, the places of the clips in ``items`` up to the media's end in ``ends``, one clip after the other."""
    usual, highest, lowest, tail = L.RATES[genre]
    return f""",
  {name}_t AS (SELECT *, source_end - source_start AS own, row_number() OVER w AS i, least(100, greatest(5, coalesce(source_start - lag(source_end) OVER w, 0))) AS need, lead(source_start) OVER w AS following,
    coalesce(lead(speaker) OVER w = speaker, false) AS same FROM {items} WINDOW w AS (PARTITION BY vid ORDER BY source_start, seq)),
  {name}_u AS (SELECT t.*, dur_ms::DOUBLE AS dur, CASE WHEN following IS NULL THEN media_end ELSE following - least(100, greatest(5, following - source_end)) END AS wall, coalesce(following, media_end) AS onset,
    greatest(own, 50) AS narrow, greatest(own + CASE WHEN same THEN {tail} ELSE 0 END, 50) AS broad, stretchable AND dur_ms > 50 AS movable FROM {name}_t t LEFT JOIN ends USING (vid)),
  {name}_r AS (SELECT DISTINCT vid, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::BIGINT AS source_start, NULL::DOUBLE AS begun, NULL::DOUBLE AS rate, -1e15::DOUBLE AS free, NULL::DOUBLE AS overrun FROM {name}_u
    UNION ALL SELECT vid, i, seq, source_start, begun, rate, begun + dur / rate, CASE WHEN late THEN greatest(0, begun + dur / rate - onset) ELSE 0 END FROM (
      SELECT *, CASE WHEN late AND movable AND begun + dur / plain - until > 0.001 THEN greatest(plain, least({highest}::DOUBLE, CASE WHEN until - begun > 50 THEN dur / (until - begun) ELSE {highest}::DOUBLE END)) ELSE plain END AS rate FROM (
        SELECT *, CASE WHEN late AND early > 0.001 THEN a - early ELSE a END AS begun FROM (
          SELECT *, wall IS NOT NULL AND NOT same AND a + dur / plain - until > 0.001 AS late, least(a + dur / plain - until, 600, a - greatest(0, open)) AS early FROM (
            SELECT *, CASE WHEN NOT movable THEN 1 WHEN until - a <= 50 THEN CASE WHEN a - source_start > 500 THEN {usual} ELSE 1 END WHEN dur <= least(greatest(until - a, 1), narrow) THEN greatest({lowest}::DOUBLE, dur / least(greatest(until - a, 1), narrow))
              WHEN dur <= least(greatest(until - a, 1), broad) THEN 1 ELSE least({highest}::DOUBLE, dur / least(greatest(until - a, 1), broad)) END::DOUBLE AS plain FROM (
              SELECT u.*, r.free + u.need AS open, greatest(u.source_start, r.free + u.need) AS a, coalesce(u.wall, 1e15)::DOUBLE AS until FROM {name}_r r JOIN {name}_u u ON u.vid = r.vid AND u.i = r.i + 1)))))),
  {name} AS (SELECT vid, seq, round_even(begun, 0)::BIGINT AS start_ms, round_even(free, 0)::BIGINT AS end_ms, round_even(rate, 4) AS rate, round_even(begun - source_start, 0)::BIGINT AS drift_ms, round_even(overrun, 0)::BIGINT AS overrun_ms FROM {name}_r WHERE i > 0)"""


def smoothing(items: str, places: str, name: str, rounds: int = 4) -> str:
    """K10 in SQL: ``name``, the places with their rates brought together, a pass from left to right for each round."""
    sql = f""",
  {name}_a AS (SELECT p.vid, p.seq, p.start_ms, p.end_ms, p.rate, speaker, source_start, source_end, dur_ms::DOUBLE AS dur, stretchable AND dur_ms > 50 AS movable FROM {places} p JOIN {items} USING (vid, seq)),
  {name}_b AS (SELECT *, coalesce(lag(speaker) OVER w <> speaker OR source_start - lag(source_end) OVER w >= 2000, true) AS apart,
    CASE WHEN coalesce(lead(speaker) OVER w = speaker, false) THEN lead(start_ms) OVER w ELSE least(lead(start_ms) OVER w, lead(source_start) OVER w) END - start_ms AS room FROM {name}_a WINDOW w AS (PARTITION BY vid ORDER BY source_start, seq)),
  {name}_c AS (SELECT *, sum(apart::INT) OVER (PARTITION BY vid ORDER BY source_start, seq) AS scene FROM {name}_b),
  {name}_0 AS (SELECT *, row_number() OVER (PARTITION BY vid, scene ORDER BY source_start, seq) AS i FROM {name}_c)"""
    for k in range(1, rounds + 1):
        before, this = f"{name}_{k - 1}", f"{name}_{k}"
        sql += f""",
  {this}r AS (SELECT vid, scene, i, rate, end_ms, NULL::DOUBLE AS left_rate, NULL::BIGINT AS left_end FROM {before} WHERE i = 1
    UNION ALL SELECT vid, scene, i, CASE WHEN turned THEN slow ELSE fast END, CASE WHEN turned THEN slow_end ELSE fast_end END, CASE WHEN turned THEN fast ELSE slow END, CASE WHEN turned THEN fast_end ELSE slow_end END FROM (
      SELECT vid, scene, i, turned, fast, fast_end, CASE WHEN raised THEN round_even(up, 4) ELSE slow END AS slow, CASE WHEN raised THEN round_even(slow_start + slow_dur / up, 0)::BIGINT ELSE slow_end END AS slow_end FROM (
        SELECT *, least(fast - 0.12::DOUBLE, 1) AS up, fast - slow > 0.12::DOUBLE + 1e-9 AND slow_moves AND least(fast - 0.12::DOUBLE, 1) > slow + 1e-4 AS raised FROM (
          SELECT * EXCLUDE (fast, fast_end), CASE WHEN lowered THEN round_even(down, 4) ELSE fast END AS fast, CASE WHEN lowered THEN round_even(fast_start + fast_dur / down, 0)::BIGINT ELSE fast_end END AS fast_end FROM (
            SELECT *, fast - slow > 0.12::DOUBLE + 1e-9 AND fast_moves AND coalesce(fast_room > 50, true) AND down < fast - 1e-4 AS lowered FROM (
              SELECT *, greatest(slow + 0.12::DOUBLE, 1, CASE WHEN fast_room > 50 THEN fast_dur / fast_room ELSE 0 END) AS down FROM (
                SELECT b.vid, b.scene, b.i, a.rate > b.rate AS turned, CASE WHEN turned THEN a.rate ELSE b.rate END AS fast, CASE WHEN turned THEN b.rate ELSE a.rate END AS slow, CASE WHEN turned THEN a.end_ms ELSE b.end_ms END AS fast_end, CASE WHEN turned THEN b.end_ms ELSE a.end_ms END AS slow_end,
                  CASE WHEN turned THEN o.dur ELSE b.dur END AS fast_dur, CASE WHEN turned THEN b.dur ELSE o.dur END AS slow_dur, CASE WHEN turned THEN o.start_ms ELSE b.start_ms END AS fast_start, CASE WHEN turned THEN b.start_ms ELSE o.start_ms END AS slow_start,
                  CASE WHEN turned THEN o.movable ELSE b.movable END AS fast_moves, CASE WHEN turned THEN b.movable ELSE o.movable END AS slow_moves, CASE WHEN turned THEN o.room ELSE b.room END AS fast_room
                FROM {this}r a JOIN {before} b ON b.vid = a.vid AND b.scene = a.scene AND b.i = a.i + 1 JOIN {before} o ON o.vid = a.vid AND o.scene = a.scene AND o.i = a.i))))))),
  {this} AS (SELECT b.* EXCLUDE (rate, end_ms), coalesce(n.left_rate, r.rate) AS rate, coalesce(n.left_end, r.end_ms) AS end_ms FROM {before} b JOIN {this}r r USING (vid, scene, i) LEFT JOIN {this}r n ON n.vid = b.vid AND n.scene = b.scene AND n.i = b.i + 1)"""
    return sql + f", {name} AS (SELECT vid, seq, start_ms, end_ms, rate FROM {name}_{rounds})"


@query("k9_place", recursive(f"{ITEMS}{ENDS}{placing('items', 'p')} SELECT * FROM p"))
def k9(spark, sf_dir):
    """Clips up to the end of the media, which comes a tenth before the source's last words end."""
    return L.placed(items(spark, sf_dir), ends=media_ends(spark, sf_dir))


@query("k14_settled_placement", recursive(f"{ITEMS}{ENDS}{placing('items', 'p', 'movie')}{smoothing('items', 'p', 'm')}" + """,
  dry AS (SELECT i.* EXCLUDE (dur_ms, stretchable), CASE WHEN abs(rate - 1) > 0.01 THEN round(dur_ms / rate) ELSE dur_ms END::BIGINT AS dur_ms, false AS stretchable FROM items i JOIN m USING (vid, seq))"""
  + placing("dry", "f", "movie") + " SELECT f.* EXCLUDE (rate), CASE WHEN abs(m.rate - 1) > 0.01 THEN m.rate ELSE 1 END AS rate FROM f JOIN m USING (vid, seq)"))
def k14(spark, sf_dir):
    return L.settled_places(items(spark, sf_dir), "movie", media_ends(spark, sf_dir))


@query("n27_violations", f"""{CLOSED}, p AS (SELECT vid, seq, source_start, dur_ms, start_ms - CASE seq % 7 WHEN 3 THEN 900 ELSE 0 END AS start_ms, start_ms + dur_ms - CASE seq % 7 WHEN 3 THEN 900 WHEN 5 THEN 40 ELSE 0 END AS end_ms FROM closed),
  b AS (SELECT *, lag(end_ms) OVER (PARTITION BY vid ORDER BY start_ms, seq) AS before FROM p),
  r AS (SELECT vid, seq, CASE WHEN start_ms < before - 1 THEN 'overlap' WHEN start_ms < source_start - 601 THEN 'lead' WHEN abs(end_ms - start_ms - dur_ms) >= 20 THEN 'cut' END AS reason FROM b) SELECT * FROM r WHERE reason IS NOT NULL""")
def n27(spark, sf_dir):
    """Violations in places of which some were moved 0.9 s forward and some cut by 40 ms; real places have none (a test)."""
    early, short = F.when(F.col("seq") % 7 == 3, 900).otherwise(0), F.when(F.col("seq") % 7 == 5, 40).otherwise(0)
    spoilt = L.placed_closed(items(spark, sf_dir)).select("vid", "seq", (F.col("start_ms") - early).alias("start_ms"), (F.col("end_ms") - early - short).alias("end_ms"), F.lit(1.0).alias("rate"))
    return L.violations(spoilt, items(spark, sf_dir))


@query("o7_worst_overrunners", f"""{CLOSED}, o AS (SELECT vid, seq, stretchable, start_ms + dur_ms - lead(source_start) OVER w AS over, sum((start_ms - source_start <= 0)::INT) OVER w AS run FROM closed WINDOW w AS (PARTITION BY vid ORDER BY seq)),
  b AS (SELECT vid, run, arg_max(seq, (over, seq)) AS seq, max(over) AS over_ms FROM o WHERE over > 0 AND stretchable GROUP BY ALL) SELECT vid, seq, over_ms FROM b""")
def o7(spark, sf_dir):
    return L.worst_overrunners(L.placed_closed(items(spark, sf_dir)).drop("source_start", "stretchable"), items(spark, sf_dir))


TEMPO = ITEMS + """, i AS (SELECT vid, seq, dur_ms, stretchable, (source_end - source_start)::DOUBLE AS own, (source_end - source_start) * (3 + seq % 4) / 4.0::DOUBLE AS slot, seq % 3 * 400 AS drift, CASE WHEN seq % 2 = 0 THEN 600 ELSE 0 END AS tail FROM items),
f AS (SELECT *, least(slot, greatest(own, 50)) AS st, least(slot, greatest(own + tail, 50)) AS ft FROM i),
n AS (SELECT *, dur_ms::DOUBLE / ft AS need, least(1.15::DOUBLE, dur_ms::DOUBLE / ft) AS r FROM f)"""


@query("x30_rate_for", f"""{TEMPO} SELECT vid, seq, round(CASE WHEN NOT stretchable OR dur_ms <= 50 THEN 1.0 WHEN slot <= 50 THEN CASE WHEN drift > 500 THEN 1.15 ELSE 1.0 END WHEN dur_ms <= st THEN greatest(0.82::DOUBLE, dur_ms / st) WHEN dur_ms <= ft THEN 1.0
  WHEN r < need AND (dur_ms / r - slot > 500 OR dur_ms / r - ft > 0.001) THEN least(1.3::DOUBLE, need) ELSE r END::DOUBLE, 6) AS rate FROM n""")
def x30(spark, sf_dir):
    own = (F.col("source_end") - F.col("source_start")).cast("double")
    rate = L.rate_for(F.col("dur_ms"), own * (3 + F.col("seq") % 4) / 4, F.col("seq") % 3 * 400, own, F.when(F.col("seq") % 2 == 0, 600).otherwise(0), F.col("stretchable"))
    return items(spark, sf_dir).select("vid", "seq", F.round(rate, 6).alias("rate"))


@query("n26_envelope", CLOSED + """, p AS (SELECT c.vid, c.start_ms, c.start_ms + c.dur_ms AS end_ms, g.keep FROM closed c JOIN segments g USING (vid, seq)),
  tot AS (SELECT vid, max(end_ms) // 5 + 2 AS n FROM p GROUP BY vid),
  d AS (SELECT p.vid, greatest(start_ms // 5, 0) AS i0, least(CASE WHEN keep THEN end_ms ELSE end_ms + 400 END // 5, n) AS i1, CASE WHEN keep THEN 0.0::DOUBLE ELSE 0.86::DOUBLE END AS low, CASE WHEN keep THEN 8 ELSE 16 END AS att, CASE WHEN keep THEN 12 ELSE 36 END AS rel FROM p JOIN tot USING (vid)),
  e AS (SELECT *, least(i1, i0 + att) AS ae FROM d WHERE i1 > i0), f AS (SELECT *, greatest(ae, i1 - rel) AS rs, unnest(range(i0, i1)) AS frame FROM e),
  l AS (SELECT vid, frame, min(CASE WHEN frame < ae THEN 1.0::DOUBLE + (low - 1.0::DOUBLE)*(frame - i0)/greatest(1, ae - i0 - 1) WHEN frame < rs THEN low ELSE low + (1.0::DOUBLE - low)*(frame - rs)/greatest(1, i1 - rs - 1) END) AS level FROM f GROUP BY ALL),
  a AS (SELECT vid, unnest(range(0, n)) AS frame FROM tot), r AS (SELECT a.vid, a.frame, coalesce(level, 1.0::DOUBLE) AS raw FROM a LEFT JOIN l USING (vid, frame))
  SELECT vid, frame, round(sum(raw) OVER (PARTITION BY vid ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) / 12.0::DOUBLE, 6) AS level FROM r""")
def n26(spark, sf_dir):
    placed = L.placed_closed(items(spark, sf_dir)).join(T.segments(spark, sf_dir).select("vid", "seq", "keep"), ["vid", "seq"])
    totals = placed.groupBy("vid").agg(F.max("end_ms").alias("total_ms"))
    return L.envelope(placed.select("vid", "start_ms", "end_ms", "keep"), totals)


CLIPS = ITEMS + ", clips AS (SELECT * EXCLUDE (speaker), (seq // 4)::VARCHAR AS speaker FROM items)"


@query("k10_smoothed_rates", recursive(f"{CLIPS}{NO_ENDS}{placing('clips', 'p')}{smoothing('clips', 'p', 'm')} SELECT * FROM m"))
def k10(spark, sf_dir):
    """A film's places with rates of one speaker's neighbours brought together; two turns count as one speaker's."""
    clips = items(spark, sf_dir).withColumn("speaker", F.expr("seq div 4").cast("string"))
    return L.smoothed(clips, L.placed(clips))


def speakable(spark, sf_dir):
    """Items with their number of units and locks; every 9th line is locked."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("long")
    return T.segments(spark, sf_dir).select(
        "vid", "seq", "speaker", F.col("start_ms").alias("source_start"), F.col("end_ms").alias("source_end"), F.expr("dur_ms * 3 div 2").alias("dur_ms"), "stretchable", words.alias("units"), (F.col("seq") % 9 == 8).alias("locked")
    )


SPEAKABLE = cte("segments") + """, items AS (SELECT vid, seq, speaker, start_ms AS source_start, end_ms AS source_end, dur_ms * 3 // 2 AS dur_ms, stretchable, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS units, seq % 9 = 8 AS locked FROM segments),
  offers AS (SELECT vid, seq, CASE WHEN seq % 2 = 0 THEN units * 2 // 3 ELSE units // 2 END AS short_units, CASE WHEN seq % 2 = 0 THEN dur_ms * 2 // 3 ELSE dur_ms // 2 END AS short_ms FROM items),
  s0 AS (SELECT *, false AS tried, false AS shortened FROM items)"""


def rescuing(k: int) -> str:
    """A round of K11 in SQL: ``s{k}`` and ``p{k}``, the lines and their places after those ``s{k - 1}`` and ``p{k - 1}``."""
    old = k - 1
    return f""",
  j{k} AS (SELECT s.*, start_ms, drift_ms, end_ms - lead(source_start) OVER w AS over, lead(source_start) OVER w - start_ms AS slot, row_number() OVER w AS i, sum((drift_ms <= 0)::INT) OVER w AS run FROM p{old} JOIN s{old} s USING (vid, seq) WINDOW w AS (PARTITION BY vid ORDER BY source_start, seq)),
  l{k} AS (SELECT vid, run, i, row_number() OVER (PARTITION BY vid, run ORDER BY drift_ms DESC, i) AS turn FROM j{k} WHERE drift_ms > 1500),
  c{k} AS (SELECT vid, run, list({{'i': i, 'seq': seq}} ORDER BY over DESC, i DESC) AS near FROM j{k} WHERE stretchable AND NOT tried AND over > 0 GROUP BY ALL),
  n{k} AS (SELECT vid, run, 0::BIGINT AS turn, []::BIGINT[] AS taken FROM c{k}
    UNION ALL SELECT n.vid, n.run, l.turn, list_concat(taken, list_transform(list_slice(list_filter(near, lambda x: x.i < l.i AND NOT list_contains(taken, x.i)), 1, 1), lambda x: x.i)) FROM n{k} n JOIN l{k} l ON l.vid = n.vid AND l.run = n.run AND l.turn = n.turn + 1 JOIN c{k} c ON c.vid = n.vid AND c.run = n.run),
  q{k} AS (SELECT DISTINCT vid, unnest(taken) AS i FROM n{k}),
  a{k} AS (SELECT j.vid, j.seq, CASE WHEN NOT locked AND short_units <= greatest(3, floor(units * greatest(0.5::DOUBLE, least(0.95::DOUBLE, greatest(500, slot) * 1.15::DOUBLE / greatest(dur_ms, 100))))) THEN short_ms END AS short_ms FROM q{k} q JOIN j{k} j ON j.vid = q.vid AND j.i = q.i LEFT JOIN offers o ON o.vid = j.vid AND o.seq = j.seq),
  s{k} AS (SELECT s.* EXCLUDE (dur_ms, tried, shortened), coalesce(a.short_ms, s.dur_ms) AS dur_ms, tried OR a.vid IS NOT NULL AS tried, shortened OR a.short_ms IS NOT NULL AS shortened FROM s{old} s LEFT JOIN a{k} a ON a.vid = s.vid AND a.seq = s.seq)""" + placing(f"s{k}", f"p{k}")


@query("k11_rescued", recursive(f"{SPEAKABLE}{ENDS}{placing('s0', 'p0')}{rescuing(1)}{rescuing(2)} SELECT p2.*, shortened FROM p2 JOIN s2 USING (vid, seq)"))
def k11(spark, sf_dir):
    """Places after lines that made others late took a shorter form, of two thirds the length or of half."""
    offers = speakable(spark, sf_dir).selectExpr("vid", "seq", "if(seq % 2 = 0, units * 2 div 3, units div 2) AS units", "if(seq % 2 = 0, dur_ms * 2 div 3, dur_ms div 2) AS short_ms")
    return L.rescued(speakable(spark, sf_dir), offers, ends=media_ends(spark, sf_dir))


@query("uf2_line_budgets", f"""{CLOSED}, u AS (SELECT vid, seq, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS units FROM segments),
  l AS (SELECT vid, seq, dur_ms, lead(source_start) OVER (PARTITION BY vid ORDER BY source_start, seq) - start_ms AS slot FROM closed)
  SELECT vid, seq, greatest(3, floor(units * greatest(0.5::DOUBLE, least(0.95::DOUBLE, greatest(500, slot) * 1.15::DOUBLE / greatest(dur_ms, 100)))))::BIGINT AS most_units FROM l JOIN u USING (vid, seq)""")
def uf2(spark, sf_dir):
    """How long each line may be to end by its follower's onset."""
    units = speakable(spark, sf_dir).select("vid", "seq", "units")
    return L.line_budget(L.placed_closed(items(spark, sf_dir)), items(spark, sf_dir).join(units, ["vid", "seq"]))
