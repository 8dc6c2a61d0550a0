"""The registered queries of the timeline operators, and the SQL that each must equal."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions import pixels
from frameloom.functions import scalar as S
from frameloom.functions.vectors import mean_vectors
from frameloom.operators import collage, gates, identity, people, regions, segments, similarity
from frameloom.plans import face_pipeline, fixture
from frameloom.sources import media
from frameloom.streaming import timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WHO = ["video_id", "person"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.face_samples(fixture.detections(spark, sf_dir))


def face_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segments(samples_of(spark, sf_dir), WHO)


SMP = fixture.SQL
SEG = """, gap AS (SELECT video_id, person, ts_ms, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY video_id, person ORDER BY ts_ms) > 1500 THEN 1 ELSE 0 END AS brk FROM smp),
run AS (SELECT *, sum(brk) OVER (PARTITION BY video_id, person ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS r FROM gap),
seg AS (SELECT video_id, person, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*)::INT AS frames FROM run GROUP BY video_id, person, r HAVING count(*) >= 3)
"""
COV = SMP + SEG + """, cov AS (SELECT s.* FROM smp s WHERE EXISTS (SELECT 1 FROM seg g WHERE g.video_id = s.video_id AND g.person <> s.person AND s.ts_ms BETWEEN g.start_ms AND g.end_ms)),
est AS (SELECT DISTINCT video_id, person FROM (SELECT video_id, person, seq FROM smp EXCEPT SELECT video_id, person, seq FROM cov))
"""
REG = SMP + """, xs AS (SELECT video_id, person, list_sort(list((("left" + "right")::FLOAT / 2::FLOAT)::FLOAT / 640::FLOAT)) AS xs FROM smp GROUP BY ALL),
med AS (SELECT *, xs[len(xs) // 2 + 1] AS median_x FROM xs WHERE len(xs) >= 2),
reg AS (SELECT video_id, person, median_x, mad_x FROM (SELECT *, list_sort(list_transform(xs, lambda x: abs(x - median_x)))[len(xs) // 2 + 1] AS mad_x FROM med) WHERE mad_x <= 0.08::FLOAT)
"""
QLT = SMP + """, q AS (SELECT *, 1::FLOAT - least(1::FLOAT, ((abs(euler_y) + 0.6::FLOAT * abs(euler_z)) / 30::FLOAT)::FLOAT) AS frontality,
  least(greatest(((ln(sharpness + 1) - ln(61)) / (ln(601) - ln(61)))::FLOAT, 0::FLOAT), 1::FLOAT) AS sharp,
  least(greatest((area::FLOAT / (0.08::FLOAT * (640::FLOAT * 1136::FLOAT))::FLOAT)::FLOAT, 0::FLOAT), 1::FLOAT) AS size,
  (CASE WHEN eye_open < 0.25::FLOAT THEN 0.2 ELSE 1 END)::FLOAT * (CASE WHEN edge_clipped THEN 0.3 ELSE 1 END)::FLOAT * (CASE WHEN abs(euler_y) > 35 THEN 0.5 ELSE 1 END)::FLOAT * (CASE WHEN area::FLOAT < 0.02::FLOAT * (640::FLOAT * 1136::FLOAT) THEN 0.5 ELSE 1 END)::FLOAT AS veto FROM smp),
qs AS (SELECT *, (0.30::FLOAT * frontality + 0.30::FLOAT * sharp + 0.20::FLOAT * eye_open + 0.15::FLOAT * smile + 0.05::FLOAT * size) * veto AS total FROM q)
"""
PPL = COV + """, num AS (SELECT video_id, person, (row_number() OVER (PARTITION BY video_id ORDER BY f, person) - 1)::INT AS person_id FROM (SELECT video_id, person, min(ts_ms) AS f FROM smp GROUP BY ALL) JOIN (SELECT DISTINCT video_id, person FROM seg) USING (video_id, person)),
ppl AS (SELECT video_id, person_id, person, 'Person ' || chr(65 + person_id) AS label, n_samples, n_app FROM num JOIN (SELECT video_id, person, count(*) AS n_samples FROM smp GROUP BY ALL) USING (video_id, person) JOIN (SELECT video_id, person, count(*) AS n_app FROM seg GROUP BY ALL) USING (video_id, person))
"""


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the planted persons, numbered."""
    own = samples_of(spark, sf_dir).withColumn("member_pos", F.col("seq"))
    return people.numbered(own, "person")


# -- sources, gates, counts ------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 6")
def topk_items_per_order(spark, sf_dir):
    return gates.top_per_group(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"], 6).select("l_orderkey", "l_linenumber", "l_extendedprice")


PLANNED = "SELECT (abs(o_custkey * 7919) % 70000) - 1000 AS duration_ms, o_orderkey FROM orders"


@query(f"SELECT o_orderkey, duration_ms, CASE WHEN duration_ms <= 0 THEN 0 ELSE least(200, greatest(1, duration_ms * 5 // 1000)) END::INT AS n_frames FROM ({PLANNED})")
def frame_plan(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", (F.abs(F.col("o_custkey") * 7919) % 70000 - 1000).alias("duration_ms"))
    return own.withColumn("n_frames", S.frame_plan(F.col("duration_ms")))


@query("SELECT c_custkey, unnest(range(0, CASE WHEN d <= 0 THEN 0 ELSE least(200, greatest(1, d * 5 // 1000)) END))::INT AS frame_idx, unnest(range(0, CASE WHEN d <= 0 THEN 0 ELSE least(200, greatest(1, d * 5 // 1000)) END)) * 200000 // 1000 AS ts_ms FROM (SELECT c_custkey, (c_custkey * 37) % 50000 - 500 AS d FROM customer)")
def frame_grid(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 37) % 50000 - 500).alias("duration_ms"))
    return media.frame_grid(own).select("c_custkey", "frame_idx", "ts_ms")


@query(SMP + "SELECT video_id, frame_idx, det_idx, area::INT AS area, solo_frame FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY area DESC, det_idx) AS r FROM cap) WHERE r <= 6")
def topk_faces_per_frame(spark, sf_dir):
    return gates.capped(fixture.detections(spark, sf_dir).filter("frame_sharp >= 40")).select("video_id", "frame_idx", "det_idx", "area", "solo_frame")


@query(SMP + """SELECT video_id, vec_id, NOT partial AND "left" + 25 > 12.8 AND "right" - 25 < 627.2 AS full_face, "left" < 51.2::FLOAT OR "top" < 51.2::FLOAT OR "right" > 588.8::FLOAT OR bottom > 1084.8::FLOAT AS edge_clipped FROM det""")
def face_gates(spark, sf_dir):
    return fixture.detections(spark, sf_dir).select("video_id", "vec_id", S.full_face().alias("full_face"), S.edge_clipped().alias("edge_clipped"))


@query(SMP + """SELECT vec_id, least(greatest("left" - 100, 0), 640) AS "left", least(greatest("top" - 300, 0), 1136) AS "top", least(greatest("right" - 100, 0), 640) AS "right", least(greatest(bottom - 300, 0), 1136) AS bottom,
 (least(greatest("right" - 100, 0), 640) - least(greatest("left" - 100, 0), 640)) * greatest(least(greatest(bottom - 300, 0), 1136) - least(greatest("top" - 300, 0), 1136), 0) AS area FROM det WHERE "right" > "left" AND bottom > "top" """)
def box_clamp(spark, sf_dir):
    moved = fixture.detections(spark, sf_dir).withColumns({x: F.col(x) - by for x, by in (("left", 100), ("top", 300), ("right", 100), ("bottom", 300))})
    return gates.boxes(moved).select("vec_id", "left", "top", "right", "bottom", "area")


@query(SMP + """, fr AS (SELECT video_id, frame_idx, min(frame_sharp) AS s FROM det GROUP BY ALL), f AS (SELECT *, NOT partial AND "left" + 25 > 12.8 AND "right" - 25 < 627.2 AS fullf FROM cap)
SELECT a.*, coalesce(b.frames_with_faces, 0) AS frames_with_faces, coalesce(b.faces_total, 0) AS faces_total, coalesce(b.blurred_face_drops, 0) AS blurred_face_drops, coalesce(b.partial_faces, 0) AS partial_faces
FROM (SELECT video_id, count(*) AS frames, count(*) FILTER (s < 40) AS whip_pan_drops FROM fr GROUP BY 1) a LEFT JOIN
(SELECT video_id, count(DISTINCT CASE WHEN fullf AND face_sharp >= 60 THEN frame_idx END) AS frames_with_faces, count(*) FILTER (fullf AND face_sharp >= 60) AS faces_total, count(*) FILTER (fullf AND face_sharp < 60) AS blurred_face_drops, count(*) FILTER (NOT fullf) AS partial_faces FROM f GROUP BY 1) b USING (video_id)""")
def detect_stats(spark, sf_dir):
    return gates.detect_stats(fixture.detections(spark, sf_dir))


@query("""WITH p AS (SELECT vec_id AS image_id, unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings), g AS (SELECT image_id, i % 8 AS x, i // 8 AS y, trunc((v::DOUBLE * 0.5 + 0.5) * 255)::INT AS g FROM p),
l AS (SELECT image_id, lag(g) OVER r + lead(g) OVER r + lag(g) OVER c + lead(g) OVER c - 4 * g AS lap FROM g WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))
SELECT image_id, round(greatest(avg(lap::DOUBLE * lap) - avg(lap::DOUBLE) * avg(lap::DOUBLE), 0), 4) AS sharpness FROM l GROUP BY 1""")
def laplacian_variance(spark, sf_dir):
    gray = F.transform("embedding", lambda v: ((v.cast("double") * 0.5 + 0.5) * 255).cast("int"))
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), gray.alias("g"))
    return own.select("image_id", F.round(pixels.laplacian_variance_of(F.col("g"), 8, 8), 4).alias("sharpness"))


@query("SELECT event_id, trunc(0.299::DOUBLE * (event_id % 256) + 0.587::DOUBLE * (event_id // 7 % 256) + 0.114::DOUBLE * (event_id // 11 % 256))::INT AS gray FROM events")
def gray_values(spark, sf_dir):
    part = lambda n: F.floor(F.col("event_id") / n) % 256
    own = table(spark, sf_dir, "events").withColumn("rgb", (part(1) * 65536 + part(7) * 256 + part(11)).cast("int"))
    return own.select("event_id", pixels.gray(F.col("rgb")).alias("gray"))


# -- vectors ---------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id // 200 AS v, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), p AS (SELECT a.v, list_sum(list_transform(list_zip(a.x, b.x), lambda q: q[1] * q[2])) AS sim FROM e a JOIN e b ON a.v = b.v AND a.vec_id < b.vec_id),
c AS (SELECT v, least(greatest(trunc((sim * 0.5 + 0.5) * 10)::INT, 0), 9) AS bucket, count(*) AS pairs FROM p GROUP BY ALL), t AS (SELECT v, round(avg(sim), 6) AS mean_sim, round(max(sim), 6) AS max_sim FROM p GROUP BY 1), d AS (SELECT *, unnest(range(0, 10))::INT AS bucket FROM t)
SELECT 'v' || d.v AS video_id, d.bucket, mean_sim, max_sim, coalesce(pairs, 0) AS pairs FROM d LEFT JOIN c ON c.v = d.v AND c.bucket = d.bucket""")
def pairwise_similarity_hist(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.floor(F.col("vec_id") / 200).cast("string")).alias("video_id"), F.col("vec_id").alias("seq"), "embedding")
    found = similarity.histogram(similarity.pairs(own, ["video_id"], "double"), ["video_id"])
    return found.withColumns({x: F.round(x, 6) for x in ("mean_sim", "max_sim")})


CEN = """WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS pos, embedding FROM embeddings), s AS (SELECT label, pos, sum(x) AS s FROM e GROUP BY ALL), c AS (SELECT label, list(s ORDER BY pos) AS v, sqrt(sum(s * s)) AS n FROM s GROUP BY 1), cen AS (SELECT label, list_transform(v, lambda x: CASE WHEN n > 1e-9 THEN x / n ELSE x END) AS centroid FROM c)"""


@query(CEN + " SELECT label, pos::INT AS pos, round(x, 6) AS x FROM (SELECT label, unnest(range(0, len(centroid))) AS pos, unnest(centroid) AS x FROM cen)")
def cluster_centroids(spark, sf_dir):
    found = mean_vectors(table(spark, sf_dir, "embeddings"), ["label"])
    return found.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("""WITH e AS (SELECT vec_id, vec_id // 400 AS v, label, embedding FROM embeddings), x AS (SELECT v, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS pos FROM e), s AS (SELECT v, label, pos, sum(x) AS s FROM x GROUP BY ALL), c AS (SELECT v, label, list(s ORDER BY pos) AS q, sqrt(sum(s * s)) AS n FROM s GROUP BY ALL),
cen AS (SELECT v, label, list_transform(q, lambda x: CASE WHEN n > 1e-9 THEN x / n ELSE x END) AS centroid FROM c),
sims AS (SELECT vec_id, cen.label, list_sum(list_transform(list_zip(embedding, centroid), lambda q: q[1]::DOUBLE * q[2])) AS sim FROM e JOIN cen ON cen.v = e.v), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label DESC) AS r FROM sims),
t AS (SELECT vec_id, max(CASE WHEN r = 1 THEN label END) AS label, max(CASE WHEN r = 1 THEN sim END) AS sim, max(CASE WHEN r = 2 THEN sim END) AS second FROM r GROUP BY 1)
SELECT vec_id, CASE WHEN sim >= 0.1 AND (second IS NULL OR sim - greatest(second, 0.1) >= 0.05) THEN label END AS best, round(sim, 6) AS sim, round(greatest(coalesce(second, -1), 0.1), 6) AS runner_up FROM t""")
def nearest_centroid_margin(spark, sf_dir):
    """Of each vector the centroid of its own video (400 vectors each) that wins it."""
    own = table(spark, sf_dir, "embeddings").withColumn("video_id", F.floor(F.col("vec_id") / 400))
    cen = mean_vectors(own, ["video_id", "label"])
    found = similarity.nearest(own.select("video_id", F.col("vec_id").alias("seq"), "embedding"), cen, ["video_id"], "label", floor=0.1)
    return found.select(F.col("seq").alias("vec_id"), "best", F.round("sim", 6).alias("sim"), F.round("runner_up", 6).alias("runner_up"))


# -- timelines -------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events), b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 21600000 THEN 1 ELSE 0 END AS brk FROM g), r AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS r FROM b)
SELECT user_id, min(t) AS start_ms, max(t) AS end_ms, count(*)::INT AS frames FROM r GROUP BY user_id, r HAVING count(*) >= 3""")
def segments_events(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return segments.segments(own, ["user_id"], gap_ms=21_600_000)


@query(SMP + SEG + "SELECT video_id, person, start_ms, end_ms, frames FROM seg")
def segments_faces(spark, sf_dir):
    return face_segments(spark, sf_dir)


@query(SMP + SEG + "SELECT x.video_id, x.person AS a, y.person AS b, x.start_ms AS a_start, x.end_ms AS a_end, y.start_ms AS b_start, y.end_ms AS b_end FROM seg x JOIN seg y ON x.video_id = y.video_id AND x.person < y.person AND x.start_ms < y.end_ms AND y.start_ms < x.end_ms")
def segment_overlap_pairs(spark, sf_dir):
    return segments.overlaps(face_segments(spark, sf_dir), ["video_id"], "person")


@query(SMP + SEG + "SELECT DISTINCT x.video_id, x.person FROM seg x JOIN seg y ON x.video_id = y.video_id AND x.person <> y.person AND x.start_ms < y.end_ms AND y.start_ms < x.end_ms")
def shared_screen_people(spark, sf_dir):
    return segments.sharing(face_segments(spark, sf_dir), ["video_id"], "person")


@query(COV + "SELECT video_id, person, seq FROM cov")
def covered_samples(spark, sf_dir):
    own = samples_of(spark, sf_dir)
    return segments.covered(own, segments.segments(own, WHO), ["video_id"], "person").select(*WHO, "seq")


@query(COV + "SELECT video_id, person FROM est")
def established_clusters(spark, sf_dir):
    own = samples_of(spark, sf_dir)
    return segments.established(own, segments.segments(own, WHO), ["video_id"], "person")


@query(SMP + """, o AS (SELECT DISTINCT video_id, person FROM smp), pr AS (SELECT a.video_id, a.person AS a, b.person AS b FROM o a JOIN o b ON a.video_id = b.video_id AND a.person < b.person),
m AS (SELECT pr.*, ts_ms, seq, CASE WHEN s.person = a THEN 0 ELSE 1 END AS side FROM pr JOIN smp s ON s.video_id = pr.video_id AND s.person IN (a, b)),
w AS (SELECT *, side <> lag(side) OVER k AND ts_ms - lag(ts_ms) OVER k <= 400 AS sw FROM m WINDOW k AS (PARTITION BY video_id, a, b ORDER BY ts_ms, side, seq)) SELECT video_id, a, b, count(*) FILTER (sw) AS alternations FROM w GROUP BY ALL""")
def alternation_pairs(spark, sf_dir):
    return segments.alternations(samples_of(spark, sf_dir), ["video_id"], "person")


# -- regions ---------------------------------------------------------------------------------------


@query(REG + "SELECT video_id, person, round(median_x::DOUBLE, 8) AS median_x, round(mad_x::DOUBLE, 8) AS mad_x FROM reg")
def steady_regions(spark, sf_dir):
    found = regions.steady_regions(samples_of(spark, sf_dir), WHO)
    return found.withColumns({x: F.round(F.col(x).cast("double"), 8) for x in ("median_x", "mad_x")})


@query(REG + "SELECT x.video_id, x.person AS a, y.person AS b FROM reg x JOIN reg y ON x.video_id = y.video_id AND x.person < y.person AND abs(x.median_x - y.median_x) >= 0.2::FLOAT")
def separated_regions(spark, sf_dir):
    return regions.separated_regions(regions.steady_regions(samples_of(spark, sf_dir), WHO), ["video_id"], "person")


@query(SMP + """, p AS (SELECT a.video_id, a.person, a.seq, abs((a."left" + a."right") / 1280.0 - (b."left" + b."right") / 1280.0) >= 0.2 AND greatest(least(a."right", b."right") - greatest(a."left", b."left"), 0) * greatest(least(a.bottom, b.bottom) - greatest(a."top", b."top"), 0) <= 0.05 * (a.area + b.area - greatest(least(a."right", b."right") - greatest(a."left", b."left"), 0) * greatest(least(a.bottom, b.bottom) - greatest(a."top", b."top"), 0)) AS apart
FROM smp a JOIN smp b ON a.video_id = b.video_id AND a.ts_ms = b.ts_ms AND a.person <> b.person), e AS (SELECT video_id, person, seq, bool_and(apart) AS apart FROM p GROUP BY ALL) SELECT video_id, person, count(*) AS paired, count(*) FILTER (apart) AS separated FROM e GROUP BY ALL""")
def same_frame_geometry(spark, sf_dir):
    own = samples_of(spark, sf_dir)
    return regions.same_frame_geometry(own, own, ["video_id"], "person")


# -- quality and people ----------------------------------------------------------------------------


@query(QLT + "SELECT video_id, seq, round(frontality::DOUBLE, 4) AS frontality, round(sharp::DOUBLE, 4) AS sharp, round(size::DOUBLE, 4) AS size, round(veto::DOUBLE, 4) AS veto, round(total::DOUBLE, 4) AS total FROM qs")
def quality_scores(spark, sf_dir):
    own = samples_of(spark, sf_dir).withColumn("q", S.quality())
    return own.select("video_id", "seq", *[F.round(F.col(f"q.{x}").cast("double"), 4).alias(x) for x in ("frontality", "sharp", "size", "veto", "total")])


@query(QLT + "SELECT video_id, person, seq, round(total::DOUBLE, 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY video_id, person ORDER BY solo_frame DESC, total DESC, sharpness DESC, seq) AS r FROM qs) WHERE r = 1")
def best_shots(spark, sf_dir):
    own = samples_of(spark, sf_dir).withColumn("member_pos", F.col("seq"))
    return people.best_shots(own, WHO).select(*WHO, "seq", F.round(F.col("total").cast("double"), 4).alias("total"))


@query(SMP + "SELECT video_id, seq, array_to_string(list_filter([CASE WHEN abs(euler_y) < 15 THEN 'Frontal' END, CASE WHEN eye_open > 0.5 THEN 'Eyes open' END, CASE WHEN smile > 0.5 THEN 'Smiling' END, CASE WHEN NOT edge_clipped THEN 'Full face' END], lambda x: x IS NOT NULL)[1:3], ',') AS badges FROM smp")
def quality_badges(spark, sf_dir):
    return samples_of(spark, sf_dir).select("video_id", "seq", F.array_join(S.badges(), ",").alias("badges"))


@query(PPL + "SELECT video_id, person_id, label, n_samples, n_app AS n_appearances FROM ppl")
def people_table(spark, sf_dir):
    return people.people(numbered(spark, sf_dir)).select("video_id", "person_id", "label", "n_samples", F.size("appearances").cast("long").alias("n_appearances"))


@query(PPL + "SELECT t.video_id, coalesce(p.people, 0) AS people, coalesce(p.app, 0)::BIGINT AS appearances, t.total - coalesce(p.n, 0)::BIGINT AS strays, coalesce(p.people, 0) || ' people · ' || coalesce(p.app, 0)::BIGINT || ' appearances' AS line FROM (SELECT video_id, count(*) AS total FROM smp GROUP BY 1) t LEFT JOIN (SELECT video_id, count(*) AS people, sum(n_app) AS app, sum(n_samples) AS n FROM ppl GROUP BY 1) p USING (video_id)")
def people_summary(spark, sf_dir):
    return people.summary(people.people(numbered(spark, sf_dir)), samples_of(spark, sf_dir))


NTH = "row_number() OVER (PARTITION BY video_id, person_id ORDER BY start_ms)"


@query(PPL + f"SELECT video_id, person_id, i::INT AS i, i || '. ' || start_ms // 60000 || ':' || lpad(((start_ms // 1000) % 60)::VARCHAR, 2, '0') || '–' || end_ms // 60000 || ':' || lpad(((end_ms // 1000) % 60)::VARCHAR, 2, '0') || ' · ' || frames || ' frames' AS line FROM (SELECT *, {NTH} AS i FROM seg JOIN num USING (video_id, person))")
def appearance_lines(spark, sf_dir):
    return people.appearance_lines(people.people(numbered(spark, sf_dir)))


@query(PPL + f", sh AS (SELECT video_id, person_id, string_agg('[' || start_ms || '-' || end_ms || ']', ',' ORDER BY start_ms) AS t FROM (SELECT *, {NTH} AS i FROM seg JOIN num USING (video_id, person)) WHERE i <= 6 GROUP BY ALL) SELECT video_id, person_id, 'person ' || label || ' n=' || n_samples || ' x' || n_app || ' ' || t AS line FROM ppl JOIN sh USING (video_id, person_id)")
def person_traces(spark, sf_dir):
    return people.trace_lines(people.people(numbered(spark, sf_dir)))


# -- crops and collage -----------------------------------------------------------------------------

CROP = """, a AS (SELECT *, 1280::FLOAT / 640::FLOAT AS sx, 2272::FLOAT / 1136::FLOAT AS sy, NOT solo_frame AS sh FROM smp), b AS (SELECT *, ("left" + "right")::FLOAT / 2::FLOAT * sx AS cx, ("top" + bottom)::FLOAT / 2::FLOAT * sy AS cy0,
 greatest(greatest(("right" - "left")::FLOAT * sx, (bottom - "top")::FLOAT * sy) * (CASE WHEN sh THEN 1.8 ELSE 2.4 END)::FLOAT, (CASE WHEN sh THEN 0.35 ELSE 0.45 END)::FLOAT * 1280::FLOAT) AS s0 FROM a),
c AS (SELECT *, CASE WHEN "right" * sx <= 640 THEN 2 * (640 - cx) WHEN "left" * sx >= 640 THEN 2 * (cx - 640) END AS capped FROM b), d AS (SELECT *, CASE WHEN sh AND capped > 0 THEN least(s0, capped) ELSE s0 END::FLOAT AS side FROM c),
e AS (SELECT *, trunc(least(greatest(cx - side / 2::FLOAT, 0), 1280::FLOAT - side))::INT AS l0, trunc(least(greatest(cy0 - 0.08::FLOAT * side - side / 2::FLOAT, 0), 2272::FLOAT - side))::INT AS t0 FROM d)
"""


@query(SMP + CROP + "SELECT video_id, seq, CASE WHEN side >= 0.98::FLOAT * 1280::FLOAT THEN 0 ELSE l0 END AS l, CASE WHEN side >= 0.98::FLOAT * 1280::FLOAT THEN 0 ELSE t0 END AS t, CASE WHEN side >= 0.98::FLOAT * 1280::FLOAT THEN 1280 ELSE greatest(least(trunc(side)::INT, 1280 - l0), 1) END AS w, CASE WHEN side >= 0.98::FLOAT * 1280::FLOAT THEN 2272 ELSE greatest(least(trunc(side)::INT, 2272 - t0), 1) END AS h FROM e")
def generous_crops(spark, sf_dir):
    own = samples_of(spark, sf_dir).withColumns({"full_w": F.lit(1280), "full_h": F.lit(2272), "shared": ~F.col("solo_frame")})
    return own.select("video_id", "seq", S.generous_crop().alias("r")).select("video_id", "seq", "r.*")


@query("""WITH b AS (SELECT p_partkey, p_size * 37 + 100 AS w, p_partkey % 900 + 100 AS h FROM part), s AS (SELECT *, greatest(480::FLOAT / w::FLOAT, 640::FLOAT / h::FLOAT) AS scale FROM b),
p AS (SELECT *, 480::FLOAT / scale AS pw, 640::FLOAT / scale AS ph FROM s), o AS (SELECT *, (w::FLOAT - pw) / 2::FLOAT AS sx, (h::FLOAT - ph) / 2::FLOAT AS sy FROM p)
SELECT p_partkey, trunc(sx)::INT AS x, trunc(sy)::INT AS y, trunc(sx + pw)::INT - trunc(sx)::INT AS w, trunc(sy + ph)::INT - trunc(sy)::INT AS h FROM o""")
def center_crop_fit(spark, sf_dir):
    own = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37 + 100).alias("bw"), (F.col("p_partkey") % 900 + 100).alias("bh"))
    return own.select("p_partkey", S.center_fit(F.col("bw"), F.col("bh"), F.lit(480), F.lit(640)).alias("r")).select("p_partkey", "r.*")


@query("""WITH g AS (SELECT p_partkey, p_size * 40 AS w, (p_partkey % 1500)::INT AS h FROM part) SELECT p_partkey, greatest(trunc(w::FLOAT * least(1::FLOAT, 640::FLOAT / greatest(w, h)::FLOAT))::INT, 1) AS small_w, greatest(trunc(h::FLOAT * least(1::FLOAT, 640::FLOAT / greatest(w, h)::FLOAT))::INT, 1) AS small_h, 180 AS thumb_w, greatest(trunc(h::FLOAT * 180::FLOAT / w::FLOAT)::INT, 1) AS thumb_h FROM g""")
def frame_sizes(spark, sf_dir):
    w, h = F.col("p_size") * 40, (F.col("p_partkey") % 1500).cast("int")
    small, thumb = S.downscaled(w, h), S.thumb(w, h, 180)
    return table(spark, sf_dir, "part").select("p_partkey", small[0].alias("small_w"), small[1].alias("small_h"), thumb[0].alias("thumb_w"), thumb[1].alias("thumb_h"))


@query(SMP + """, r AS (SELECT video_id, seq, greatest("right" - "left", bottom - "top")::FLOAT * (1::FLOAT + 0.2::FLOAT) AS s, ("left" + "right")::FLOAT / 2::FLOAT AS cx, ("top" + bottom)::FLOAT / 2::FLOAT AS cy FROM smp),
a AS (SELECT *, least(greatest(trunc(cx - s / 2::FLOAT)::INT, 0), 639) AS l0, least(greatest(trunc(cy - s / 2::FLOAT)::INT, 0), 1135) AS t0 FROM r),
e AS (SELECT *, least(greatest(trunc(l0::FLOAT + s)::INT, l0 + 1), 640) AS r1, least(greatest(trunc(t0::FLOAT + s)::INT, t0 + 1), 1136) AS b1 FROM a),
o AS (SELECT *, greatest(trunc(r1::FLOAT - s)::INT, 0) AS l, greatest(trunc(b1::FLOAT - s)::INT, 0) AS t FROM e) SELECT video_id, seq, l, t, r1 - l AS w, b1 - t AS h FROM o""")
def embed_crop_rect(spark, sf_dir):
    return samples_of(spark, sf_dir).select("video_id", "seq", S.embed_rect().alias("r")).select("video_id", "seq", "r.*")


#: The pages of 1 to 6 tiles.
PAGES = "(1,0,48,420,984,1000),(2,0,48,320,984,620),(2,1,48,964,984,620),(3,0,48,300,984,620),(3,1,48,944,480,480),(3,2,552,944,480,480),(4,0,48,300,480,640),(4,1,552,300,480,640),(4,2,48,964,480,640),(4,3,552,964,480,640),(5,0,48,300,984,540),(5,1,48,864,480,380),(5,2,552,864,480,380),(5,3,48,1268,480,380),(5,4,552,1268,480,380),(6,0,48,300,480,440),(6,1,552,300,480,440),(6,2,48,764,480,440),(6,3,552,764,480,440),(6,4,48,1228,480,440),(6,5,552,1228,480,440)"
LAY = f"lay AS (SELECT n, i AS idx, x, y, w, h FROM (VALUES {PAGES}) v(n, i, x, y, w, h) UNION ALL SELECT n, i, CASE WHEN i % 2 = 0 THEN 48 ELSE 552 END, 300 + (i // 2) * (hh + 24), 480, hh FROM (SELECT n, unnest(range(0, n)) AS i, greatest(200, (1360 - ((n + 1) // 2 - 1) * 24) // ((n + 1) // 2)) AS hh FROM range(7, 16) r(n)))"


@query(f"WITH {LAY} SELECT n::INT AS n, idx::INT AS idx, x::INT AS x, y::INT AS y, w::INT AS w, h::INT AS h FROM lay")
def collage_layout(spark, sf_dir):
    return collage.layout(spark, 15)


@query(PPL.replace(SMP, QLT, 1) + f""", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, person ORDER BY solo_frame DESC, total DESC, sharpness DESC, seq) AS r FROM qs) WHERE r = 1), {LAY}
SELECT p.video_id, p.person_id AS idx, c.n::INT AS n, b.ts_ms, l.x::INT AS x, l.y::INT AS y, l.w::INT AS w, l.h::INT AS h, label, '×' || n_app AS sublabel FROM ppl p JOIN best b ON b.video_id = p.video_id AND b.person = p.person JOIN (SELECT video_id, count(*) AS n FROM ppl GROUP BY 1) c ON c.video_id = p.video_id JOIN lay l ON l.n = c.n AND l.idx = p.person_id""")
def collage_drawlist(spark, sf_dir):
    members = numbered(spark, sf_dir)
    return collage.draw_list(people.people(members), people.best_shots(members, ["video_id", "person_id"])).drop("crop")


# -- progress and texts ----------------------------------------------------------------------------


@query("""WITH w AS (SELECT * FROM (VALUES ('EXTRACT', 0.0::DOUBLE, 0.20::DOUBLE), ('DETECT', 0.20, 0.35), ('EMBED', 0.55, 0.15), ('CLUSTER', 0.70, 0.10), ('SCORE', 0.80, 0.10), ('COLLAGE', 0.90, 0.10)) t(stage, before, weight)), e AS (SELECT event_id, ['EXTRACT','DETECT','EMBED','CLUSTER','SCORE','COLLAGE'][event_id % 6 + 1] AS stage, event_id % 130 AS done, event_id % 97 AS total FROM events)
SELECT event_id, stage, round(before + weight * (CASE WHEN total <= 0 THEN 0 ELSE least(greatest(done::DOUBLE / total, 0), 1) END), 6) AS progress, CASE WHEN done >= 3 AND done < total THEN 1000 * (total - done) // done END AS eta_ms FROM e JOIN w USING (stage)""")
def progress_and_eta(spark, sf_dir):
    names = F.array(*[F.lit(n) for n, _ in S.STAGES])
    own = table(spark, sf_dir, "events").select("event_id", F.get(names, (F.col("event_id") % 6).cast("int")).alias("stage"), (F.col("event_id") % 130).alias("done"), (F.col("event_id") % 97).alias("total"))
    done, total = F.col("done"), F.col("total")
    return own.select("event_id", "stage", F.round(S.overall(F.col("stage"), S.stage_fraction(done, total)), 6).alias("progress"), S.eta_ms(F.lit(1000), done, total).alias("eta_ms"))


@query("SELECT event_id, CASE WHEN event_id % 6 < event_id % 5 THEN 'DONE' WHEN event_id % 6 = event_id % 5 THEN 'CURRENT' ELSE 'PENDING' END AS status FROM events")
def stage_status(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.stage_status(F.col("event_id") % 6, F.col("event_id") % 5).alias("status"))


@query(r"SELECT p_partkey, 'collage_' || regexp_replace(substr(regexp_replace(p_name || '.v1.mp4', '\.[^.]*$', ''), 1, 40), '[^\p{L}\p{Nd}_-]', '_', 'g') AS file FROM part")
def filename_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.file_name(F.concat("p_name", F.lit(".v1.mp4"))).alias("file"))


@query("SELECT page_id, coalesce(nullif(string_split(url, '/')[-1], ''), 'video') AS name FROM pages")
def display_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.display_name(F.lit(None).cast("string"), F.col("url")).alias("name"))


@query("SELECT o_orderkey, (o_orderkey % 9) || ' faces in ' || (o_orderkey % 7) || '/' || (o_orderkey % 11) || ' frames · ' || (o_orderkey % 3) || ' whip-pan · ' || (o_orderkey % 4) || ' blurry · ' || (o_orderkey % 5) || ' partial' AS detect_line, (o_orderkey % 200) || ' frames · ' || ((o_orderkey % 400) // 10) || '.' || (o_orderkey % 10) || 's' || CASE WHEN o_orderkey % 3 > 0 THEN ' · ' || (o_orderkey % 3) || '×' || (o_orderkey % 8) ELSE '' END AS clip_line FROM orders")
def detect_and_clip_lines(spark, sf_dir):
    n = lambda k: F.col("o_orderkey") % k
    own = table(spark, sf_dir, "orders")
    return own.select("o_orderkey", S.detect_line(n(9), n(7), n(11), n(3), n(4), n(5)).alias("detect_line"), S.clip_line(n(200), n(400) * 100, n(3), n(8)).alias("clip_line"))


@query("SELECT stage, ordinal::INT AS ordinal, weight, before, after FROM (VALUES ('EXTRACT', 0, 0.20::DOUBLE, 0.0::DOUBLE, 0.20::DOUBLE), ('DETECT', 1, 0.35, 0.20, 0.55), ('EMBED', 2, 0.15, 0.55, 0.70), ('CLUSTER', 3, 0.10, 0.70, 0.80), ('SCORE', 4, 0.10, 0.80, 0.90), ('COLLAGE', 5, 0.10, 0.90, 1.0)) t(stage, ordinal, weight, before, after)")
def progress_weights(spark, sf_dir):
    return S.progress_bounds(spark)


@query(SMP + """, m AS (SELECT video_id, seq, vec_id % 97 AS cluster_id FROM smp), z AS (SELECT video_id, cluster_id, count(*) AS n FROM m GROUP BY ALL), k AS (SELECT video_id, count(*) AS c FROM z GROUP BY 1) SELECT m.* FROM m JOIN z USING (video_id, cluster_id) JOIN k USING (video_id) WHERE c < 3 OR n >= 2""")
def prune_singletons(spark, sf_dir):
    own = samples_of(spark, sf_dir).withColumn("cluster_id", F.col("vec_id") % 97)
    return people.prune_singletons(own).select("video_id", "seq", "cluster_id")


@query(SMP + "SELECT video_id, person, first_ms, (row_number() OVER (PARTITION BY video_id ORDER BY first_ms, person) - 1)::INT AS rank FROM (SELECT video_id, person, min(ts_ms) AS first_ms FROM smp GROUP BY ALL)")
def first_seen(spark, sf_dir):
    return people.first_seen(samples_of(spark, sf_dir), "person")


@query(f"WITH {LAY} SELECT n::INT AS n, idx::INT AS idx, (x + 24)::INT AS \"left\", (y + h - 88)::INT AS \"top\", least(x + 24 + 100 + idx * 90 + 56, x + w - 16)::INT AS \"right\", (y + h - 24)::INT AS bottom FROM lay")
def chip_geometry(spark, sf_dir):
    pages = collage.layout(spark, 15)
    return pages.select("n", "idx", collage.chip(100 + F.col("idx") * 90).alias("c")).select("n", "idx", "c.*")


@query("SELECT o_orderkey, strftime(o_orderdate, '%-d %b %Y') AS footer, o_orderpriority || ' — made with frameloom' AS caption FROM orders")
def page_footers(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.footer(F.col("o_orderdate")).alias("footer"), S.caption(F.col("o_orderpriority")).alias("caption"))


@query(PPL + "SELECT p.video_id, p.person_id, m.ts_ms, m.frame_sharp FROM ppl p JOIN (SELECT video_id, person, min(ts_ms) AS ts_ms FROM smp GROUP BY ALL) f USING (video_id, person) JOIN (SELECT DISTINCT video_id, ts_ms, frame_sharp FROM det) m ON m.video_id = p.video_id AND m.ts_ms = f.ts_ms")
def frames_of_first_shots(spark, sf_dir):
    """A point lookup by time: the frame of each person's first face."""
    first = numbered(spark, sf_dir).groupBy("video_id", "person_id").agg(F.min("ts_ms").alias("ts_ms"))
    frames = fixture.detections(spark, sf_dir).select("video_id", "ts_ms", "frame_sharp").distinct()
    return first.join(frames, ["video_id", "ts_ms"], "left")


# -- clustering and streams ------------------------------------------------------------------------


@query(SMP + "SELECT video_id, seq, dense_rank() OVER (PARTITION BY video_id ORDER BY f)::INT - 1 AS cluster_id FROM (SELECT *, min(seq) OVER (PARTITION BY video_id, person) AS f FROM smp)")
def cluster_faces(spark, sf_dir):
    return identity.cluster_faces(samples_of(spark, sf_dir)).select("video_id", "seq", "cluster_id")


@query(PPL + "SELECT t.video_id, p.people, p.app::BIGINT AS appearances, t.total - p.n::BIGINT AS strays, p.people || ' people · ' || p.app::BIGINT || ' appearances' AS line FROM (SELECT video_id, count(*) AS total FROM smp GROUP BY 1) t JOIN (SELECT video_id, count(*) AS people, sum(n_app) AS app, sum(n_samples) AS n FROM ppl GROUP BY 1) p USING (video_id)")
def cluster_people_summary(spark, sf_dir):
    return face_pipeline.run(fixture.detections(spark, sf_dir))["summary"]


@query()
def clusterer_decisions(spark, sf_dir):
    return identity.decisions(samples_of(spark, sf_dir))


@query(SMP + SEG + """, m AS (SELECT *, person // 2 AS pair FROM smp), ok AS (SELECT video_id, pair, count(DISTINCT person) = 2 AND bool_and(n >= 3 AND has) AS two FROM (SELECT video_id, pair, person, count(*) AS n, bool_or((video_id, person) IN (SELECT (video_id, person) FROM seg)) AS has FROM m GROUP BY ALL) GROUP BY ALL),
f AS (SELECT *, min(seq) OVER (PARTITION BY video_id, person) AS f FROM m) SELECT video_id, pair, seq, CASE WHEN two THEN dense_rank() OVER (PARTITION BY video_id, pair ORDER BY f) - 1 ELSE 0 END::INT AS half FROM f JOIN ok USING (video_id, pair)""")
def fission_of_mixed_groups(spark, sf_dir):
    """Groups of two planted persons (and one of a single one): halves in the order of their first faces."""
    mixed = samples_of(spark, sf_dir).withColumn("pair", F.floor(F.col("person") / 2))
    found = identity.fission(mixed, ["video_id", "pair"])
    first = F.min("seq").over(Window.partitionBy("video_id", "pair", "half"))
    rank = F.dense_rank().over(Window.partitionBy("video_id", "pair").orderBy("first")) - 1
    return found.withColumn("first", first).select("video_id", "pair", "seq", rank.alias("half"))


@query("SELECT o_orderkey, (o_orderkey % 101) || '%' || ' · frame ' || (o_orderkey % 101) || '/500' || CASE WHEN o_orderkey % 3 = 0 THEN ' · ~' || (o_orderkey % 7) || 's left' ELSE '' END AS text FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 101 < 20)")
def progress_texts(spark, sf_dir):
    done = F.col("o_orderkey") % 101
    own = table(spark, sf_dir, "orders").select("o_orderkey").filter(done < 20)
    text = S.progress_text(F.lit("EXTRACT"), (done + 0.5) / 20, done, F.lit(500), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 7 * 1000 + 900))
    return own.select("o_orderkey", text.alias("text"))


@query("SELECT p_partkey, CASE WHEN r % 180 = 90 THEN h ELSE w END AS w, CASE WHEN r % 180 = 90 THEN w ELSE h END AS h FROM (SELECT p_partkey, p_size * 40 AS w, (p_partkey % 1500)::INT AS h, p_partkey % 4 * 90 AS r FROM part)")
def upright_sizes(spark, sf_dir):
    w, h = S.upright(F.col("p_size") * 40, (F.col("p_partkey") % 1500).cast("int"), F.col("p_partkey") % 4 * 90)
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("w"), h.alias("h"))


def _streamed(spark: SparkSession, rows: DataFrame) -> tuple[str, str]:
    """A folder with the rows as files, and a folder for the stream's checkpoint and output, in the shared folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="frameloom-")  # one process, as in tests
    base = shared.rstrip("/") + "/stream-" + spark._jvm.java.util.UUID.randomUUID().toString()
    edges = rows.select(F.min("ts_ms"), F.max("ts_ms").alias("b")).first()
    third = max(1, ((edges[1] or 0) - (edges[0] or 0)) // 3)
    for k in range(3):  # three files in the order of time, so that state crosses micro-batches
        part = F.least(F.floor((F.col("ts_ms") - (edges[0] or 0)) / third), F.lit(2)) == k
        rows.filter(part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return f"{base}/in", base


@query(SMP + SEG + "SELECT video_id, person, start_ms, end_ms, frames FROM seg")
def stream_segments(spark, sf_dir):
    own = samples_of(spark, sf_dir).select("video_id", "person", "ts_ms")
    # A row far ahead moves the watermark past every open run.
    end = spark.createDataFrame([("end", 0, 10**12)], own.schema)
    source, base = _streamed(spark, own)
    end.coalesce(1).write.mode("append").parquet(source)
    found = timeline.appearances(timeline.read(spark, source, "video_id string, person int, ts_ms long"), WHO)
    return timeline.collected(found, f"{base}/checkpoint", f"{base}/out")


@query()
def stream_assign(spark, sf_dir):
    own = samples_of(spark, sf_dir).select("video_id", "seq", "ts_ms", "embedding")
    source, base = _streamed(spark, own)
    found = timeline.assigned(timeline.read(spark, source, "video_id string, seq int, ts_ms long, embedding array<float>"))
    return timeline.collected(found, f"{base}/checkpoint", f"{base}/out")
