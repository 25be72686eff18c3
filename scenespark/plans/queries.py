"""Every operator as a query over the test tables, with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CaptionerConfig, PipelineConfig, SegmenterConfig, SelectorConfig
from ..functions import embedders, text, vectors
from ..operators import captions, evaluate, joins, segment, select, visuals
from ..schema import SEGMENT
from ..sources import frames as src
from ..sources import sinks
from ..store import fresh_path, written
from ..streaming import ordered, shots

# Thresholds at which the test vectors, which are nearly random, give shots and near copies.
SEG = SegmenterConfig(sim_threshold=0.05, min_shot_sec=2.0, ema_alpha=0.25)
SEL = SelectorConfig(max_frames_per_segment=3, seconds_per_pick=3.0, min_temporal_spacing_sec=1.5, diversity_sim_threshold=0.2, min_picks=6)
FLOOR = SelectorConfig(max_frames_per_segment=3, seconds_per_pick=3.0, min_temporal_spacing_sec=1.5, diversity_sim_threshold=0.0, min_picks=12)
GAP = 21600.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark, d) -> DataFrame:
    return src.frames_from_embeddings(read(spark, d, "embeddings"))


def shotted(spark, d, cfg: SegmenterConfig = SEG) -> DataFrame:
    return segment.segment_frames(emb(spark, d), cfg)


def keyed(spark, d, cfg: SelectorConfig = SEL) -> tuple[DataFrame, DataFrame]:
    s = written(shotted(spark, d))
    return s, select.select_picks(s, cfg)


def ev(spark, d) -> DataFrame:
    return src.frames_from_events(read(spark, d, "events"))


r6 = lambda c: F.round(c, 6).alias(c)

# --- pieces of the SQL side ---------------------------------------------------------------------
F_ = "f AS (SELECT label::INT stream_id, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id)-1)::DOUBLE t, embedding::DOUBLE[] e, 1000*list_aggregate(embedding::DOUBLE[],'var_pop') sharp FROM embeddings)"


def s_(mean: str = "list_transform(list_zip(e,mean), lambda p: 0.25::DOUBLE*p[1]+0.75::DOUBLE*p[2])") -> str:
    return f"""s AS (SELECT stream_id,t,1.0::DOUBLE sim,true is_start,0 sid,t start,e mean,1 cnt FROM f WHERE t=0
 UNION ALL SELECT stream_id,t,sim,st,CASE WHEN st THEN sid+1 ELSE sid END,CASE WHEN st THEN t ELSE start END,CASE WHEN st THEN e ELSE {mean} END,CASE WHEN st THEN 1 ELSE cnt+1 END
 FROM (SELECT *,(sim<0.05 AND t-start>=2.0) st FROM (SELECT f.stream_id,f.t,CASE WHEN list_dot_product(f.e,f.e)=0 OR list_dot_product(s.mean,s.mean)=0 THEN 0 ELSE list_cosine_similarity(f.e,s.mean) END sim,s.sid,s.start,s.mean,s.cnt,f.e FROM s JOIN f ON f.stream_id=s.stream_id AND f.t=s.t+1)))"""


SEG_ = "fr AS (SELECT f.*,s.sid,s.sim,s.is_start FROM f JOIN s USING(stream_id,t)), seg AS (SELECT stream_id,sid,min(t) start,coalesce(lead(min(t)) OVER (PARTITION BY stream_id ORDER BY sid),max(t)) end_,lead(min(t)) OVER (PARTITION BY stream_id ORDER BY sid) IS NOT NULL closed,count(*) n FROM fr GROUP BY 1,2)"
CE_ = "ce AS (SELECT stream_id,sid,list(m ORDER BY pos) c FROM (SELECT stream_id,sid,pos,avg(v) m FROM (SELECT stream_id,sid,unnest(e) v,generate_subscripts(e,1) pos FROM fr) GROUP BY 1,2,3) GROUP BY 1,2)"
Z_ = lambda x: f"(CASE WHEN stddev_pop({x}) OVER w<1e-9 THEN 0 ELSE ({x}-avg({x}) OVER w)/stddev_pop({x}) OVER w END)"
RK_ = f"""r AS (SELECT fr.*,n,start,end_,CASE WHEN n=1 THEN 1.0 ELSE list_cosine_similarity(e,c) END repr FROM fr JOIN seg USING(stream_id,sid) JOIN ce USING(stream_id,sid)),
sc AS (SELECT *,CASE WHEN n=1 THEN 0.0 ELSE round(0.45*{Z_('sharp')}+0.55*{Z_('repr')},6) END comp,greatest(1,least(3,ceil((end_-start)/3.0)))::INT k FROM r WINDOW w AS (PARTITION BY stream_id,sid)),
rk AS (SELECT *,row_number() OVER (PARTITION BY stream_id,sid ORDER BY comp DESC,t) rn FROM sc)"""
P_ = """p AS (SELECT stream_id,sid,rn,t,true pick,[t] ts FROM rk WHERE rn=1 UNION ALL SELECT rk.stream_id,rk.sid,rk.rn,rk.t,ok,CASE WHEN ok THEN list_append(p.ts,rk.t) ELSE p.ts END
 FROM p JOIN rk ON rk.stream_id=p.stream_id AND rk.sid=p.sid AND rk.rn=p.rn+1, LATERAL (SELECT len(p.ts)<rk.k AND len(list_filter(p.ts, lambda u: abs(u-rk.t)<1.5))=0 AS ok)),
cand AS (SELECT rk.*,row_number() OVER (PARTITION BY rk.stream_id ORDER BY comp DESC,rk.sid,rk.t) dr FROM rk JOIN p USING(stream_id,sid,rn) WHERE p.pick)"""


def kf_(thr: float, floor: int) -> str:
    return f"""d AS (SELECT stream_id,dr,true keep,[e] kept FROM cand WHERE dr=1 UNION ALL SELECT c.stream_id,c.dr,ok,CASE WHEN ok THEN list_append(d.kept,c.e) ELSE d.kept END FROM d JOIN cand c ON c.stream_id=d.stream_id AND c.dr=d.dr+1, LATERAL (SELECT len(list_filter(d.kept, lambda q: list_cosine_similarity(q,c.e)>{thr}))=0 AS ok)),
fl AS (SELECT cand.*,d.keep,sum(d.keep::INT) OVER (PARTITION BY cand.stream_id) nk,row_number() OVER (PARTITION BY cand.stream_id,d.keep ORDER BY cand.dr) dn FROM cand JOIN d USING(stream_id,dr)),
kf AS (SELECT *,row_number() OVER (PARTITION BY stream_id ORDER BY t)::INT pick_id FROM fl WHERE keep OR dn<={floor}-nk)"""


W = "WITH RECURSIVE "
TO_SEG = W + ", ".join([F_, s_(), SEG_])
TO_RK = ", ".join([TO_SEG, CE_, RK_])
TO_CAND = ", ".join([TO_RK, P_])
TO_KF = ", ".join([TO_CAND, kf_(0.2, 6)])
EV_ = "v AS (SELECT user_id stream_id,event_id,event_type,value,epoch_us(ts)/1e6 t FROM events)"


# --- frames and sampling --------------------------------------------------------------------------
@query(f"WITH {F_} SELECT stream_id,vec_id source_idx,t::INT analyzed_idx,t timestamp_sec,round(sharp,6) sharpness FROM f")
def frames_base(spark, d):
    return emb(spark, d).select("stream_id", "source_idx", "analyzed_idx", "timestamp_sec", r6("sharpness"))


@query(f"WITH {F_} SELECT stream_id,vec_id source_idx,round(list_cosine_similarity(e,lag(e) OVER (PARTITION BY stream_id ORDER BY t)),6) sim FROM f QUALIFY lag(t) OVER (PARTITION BY stream_id ORDER BY t) IS NOT NULL")
def cosine_consecutive(spark, d):
    from pyspark.sql import Window

    before = F.lag("embedding").over(Window.partitionBy("stream_id").orderBy("timestamp_sec"))
    rows = emb(spark, d).withColumn("b", before).where("b is not null")
    return rows.select("stream_id", "source_idx", F.round(vectors.cosine(F.col("embedding"), F.col("b")), 6).alias("sim"))


@query(f"""{W}{EV_}, o AS (SELECT *,row_number() OVER (PARTITION BY stream_id ORDER BY t,event_id) rn FROM v),
g AS (SELECT stream_id,rn,event_id,t,t kept,true k FROM o WHERE rn=1 UNION ALL SELECT o.stream_id,o.rn,o.event_id,o.t,CASE WHEN o.t-g.kept>={GAP} THEN o.t ELSE g.kept END,o.t-g.kept>={GAP} FROM g JOIN o ON o.stream_id=g.stream_id AND o.rn=g.rn+1)
SELECT stream_id,event_id source_idx,round(t,6) timestamp_sec FROM g WHERE k""")
def greedy_sample(spark, d):
    return src.greedy_sample(ev(spark, d), GAP).select("stream_id", "source_idx", r6("timestamp_sec"))


@query(f"""WITH {EV_}, o AS (SELECT *,row_number() OVER (PARTITION BY stream_id ORDER BY t,event_id)-1 n FROM v), c AS (SELECT stream_id,count(*) cnt FROM o GROUP BY 1),
g AS (SELECT stream_id,cnt,unnest(range(0,100000)) i FROM c), h AS (SELECT stream_id,i,i*0.7::DOUBLE ts,least(round_even(i*0.7::DOUBLE*4.0,0)::BIGINT,cnt-1) n FROM g WHERE i*0.7::DOUBLE<cnt/4.0-1e-6)
SELECT stream_id,i::INT analyzed_idx,round(ts,6) timestamp_sec,event_id source_idx FROM h JOIN o USING(stream_id,n)""".replace("range(0,100000)", "range(0,(cnt/(4.0*0.7))::BIGINT+2)"))
def grid_sample(spark, d):
    return src.grid_sample(ev(spark, d), 0.7, 4.0).select("stream_id", "analyzed_idx", r6("timestamp_sec"), "source_idx")


@query(f"WITH {EV_} SELECT stream_id,round_even(t/{GAP},0)::BIGINT slot,round_even(t/{GAP},0)::BIGINT*{GAP}::DOUBLE timestamp_sec,event_id source_idx FROM v QUALIFY row_number() OVER (PARTITION BY stream_id,round_even(t/{GAP},0) ORDER BY t,event_id)=1")
def slot_dedup(spark, d):
    return src.slot_dedup(ev(spark, d), GAP)


@query(f"""WITH {EV_}, u AS (SELECT *,t-min(t) OVER () x,max(t) OVER ()-min(t) OVER () dur FROM v), c AS (SELECT *,(x>=round_even(dur/4*1/{GAP},0)*{GAP})::INT+(x>=round_even(dur/4*2/{GAP},0)*{GAP})::INT+(x>=round_even(dur/4*3/{GAP},0)*{GAP})::INT chunk FROM u)
SELECT chunk,count(*) frames,round(min(x),6) first_sec,round(max(x),6) last_sec FROM c GROUP BY 1""")
def chunk_partition(spark, d):
    rows = ev(spark, d)
    ends = rows.agg(F.min("timestamp_sec").alias("lo"), F.max("timestamp_sec").alias("hi"))
    x = rows.crossJoin(F.broadcast(ends)).withColumn("x", F.col("timestamp_sec") - F.col("lo")).withColumn("dur", F.col("hi") - F.col("lo"))
    return x.groupBy(src.chunk_of(F.col("x"), F.col("dur"), 4, GAP).alias("chunk")).agg(F.count(F.lit(1)).alias("frames"), F.round(F.min("x"), 6).alias("first_sec"), F.round(F.max("x"), 6).alias("last_sec"))


# --- shots ------------------------------------------------------------------------------------------
FRAMES_OUT = "SELECT stream_id,vec_id source_idx,round(sim,6) sim,is_start,sid::INT segment_id FROM fr"


def frames_out(df: DataFrame) -> DataFrame:
    return df.select(F.col("stream_id").cast("int").alias("stream_id"), "source_idx", F.round("sim_to_shot_mean", 6).alias("sim"), F.col("is_shot_start").alias("is_start"), "segment_id")


@query(f"{TO_SEG} {FRAMES_OUT}")
def segment_frames_ema(spark, d):
    return frames_out(shotted(spark, d))


@query(f"{TO_SEG} {FRAMES_OUT}")
def segment_frames_fold(spark, d):
    return frames_out(segment.segment_frames_sql(emb(spark, d), SEG))


@query(W + ", ".join([F_, s_("list_transform(list_zip(e,mean), lambda p: (p[2]*cnt+p[1])/(cnt+1))"), SEG_]) + f" {FRAMES_OUT}")
def segment_frames_mean(spark, d):
    return frames_out(shotted(spark, d, SegmenterConfig(sim_threshold=0.05, use_ema=False)))


@query(f"{TO_SEG} SELECT stream_id,sid::INT segment_id,start start_sec,end_ end_sec,greatest(end_-start,0) duration_sec,n num_frames FROM seg")
def segment_rollup(spark, d):
    return segment.segment_rollup(shotted(spark, d)).select("stream_id", "segment_id", "start_sec", "end_sec", "duration_sec", "num_frames")


@query(f"{TO_SEG} SELECT stream_id,'segment_closed' event,sid::INT segment_id,round(start,3) start_sec,round(end_,3) end_sec,n frames FROM seg WHERE closed")
def segment_event_log(spark, d):
    return segment.event_log(shotted(spark, d))


@query(f"{TO_SEG} SELECT stream_id,vec_id source_idx,greatest(sum(is_start::INT) OVER (PARTITION BY stream_id ORDER BY t)-1,0)::INT segment_from_flags,(greatest(sum(is_start::INT) OVER (PARTITION BY stream_id ORDER BY t)-1,0)*137%180)::INT hue,is_start FROM fr")
def timeline_cells(spark, d):
    return visuals.timeline(shotted(spark, d)).select("stream_id", "source_idx", "segment_from_flags", "hue", F.col("is_shot_start").alias("is_start"))


@query(f"{TO_SEG} SELECT stream_id,vec_id source_idx,count(*) OVER w frames_so_far,sum(is_start::INT) OVER w::BIGINT segments_so_far FROM fr WINDOW w AS (PARTITION BY stream_id ORDER BY t)")
def live_counters(spark, d):
    return evaluate.live_counters(shotted(spark, d)).select("stream_id", "source_idx", "frames_so_far", "segments_so_far")


@query(f"{TO_SEG} SELECT stream_id,vec_id source_idx FROM fr WHERE t::INT%8=0 OR is_start")
def redraw_frames(spark, d):
    return visuals.redraws(shotted(spark, d), 8).select("stream_id", "source_idx")


@query(f"{TO_SEG} SELECT stream_id,sid::INT segment_id,printf('Segment #%d closed at t=%.1fs (%.1fs, %d frames)',sid,end_,greatest(end_-start,0),n) message FROM seg WHERE closed")
def closed_messages(spark, d):
    rows = segment.segment_rollup(shotted(spark, d)).where("closed_in_stream")
    return rows.select("stream_id", "segment_id", text.closed_message(F.col("segment_id"), F.col("end_sec"), F.col("duration_sec"), F.col("num_frames")).alias("message"))


# --- picks --------------------------------------------------------------------------------------
@query(f"{TO_SEG}, {CE_} SELECT fr.stream_id,vec_id source_idx,fr.sid::INT segment_id,round(list_cosine_similarity(e,c),6) repr FROM fr JOIN ce USING(stream_id,sid)")
def segment_centroid_repr(spark, d):
    s = shotted(spark, d)
    rows = s.join(select.centroids(s), ["stream_id", "segment_id"])
    return rows.select("stream_id", "source_idx", "segment_id", F.round(vectors.cosine(F.col("embedding"), F.col("centroid")), 6).alias("repr"))


@query(f"{TO_RK} SELECT stream_id,vec_id source_idx,sid::INT segment_id,round(repr,6) repr,comp,(rn-1)::INT rank_in_segment FROM rk")
def frame_scores(spark, d):
    return select.frame_scores(shotted(spark, d), SEL).select("stream_id", "source_idx", "segment_id", F.round("representativeness", 6).alias("repr"), F.col("composite_score").alias("comp"), "rank_in_segment")


@query(f"{TO_SEG} SELECT stream_id,sid::INT segment_id,greatest(1,least(3,ceil(greatest(end_-start,0)/3.0)))::INT k,3 k_without_rate FROM seg")
def target_k(spark, d):
    rows = segment.segment_rollup(shotted(spark, d))
    return rows.select("stream_id", "segment_id", text.target_k(F.col("duration_sec"), 3.0, 3).alias("k"), text.target_k(F.col("duration_sec"), 0.0, 3).alias("k_without_rate"))


@query(f"{TO_CAND} SELECT stream_id,vec_id source_idx,sid::INT segment_id,(rn-1)::INT rank_in_segment,comp FROM cand")
def picks_per_segment(spark, d):
    rows = select.pick_spaced(select.frame_scores(shotted(spark, d), SEL), SEL)
    return rows.select("stream_id", "source_idx", "segment_id", "rank_in_segment", F.col("composite_score").alias("comp"))


KF_OUT = "SELECT stream_id,pick_id,sid::INT segment_id,vec_id source_idx,t timestamp_sec,(rn-1)::INT rank_in_segment,round(comp,6) comp,round(repr,6) repr FROM kf"


def kf_out(df: DataFrame) -> DataFrame:
    return df.select("stream_id", "pick_id", "segment_id", "source_idx", "timestamp_sec", "rank_in_segment", F.round("composite_score", 6).alias("comp"), F.round("representativeness", 6).alias("repr"))


@query(f"{TO_KF} {KF_OUT}")
def picks_final(spark, d):
    return kf_out(keyed(spark, d)[1])


@query(", ".join([TO_CAND, kf_(0.0, 12)]) + f" {KF_OUT}")
def picks_floor(spark, d):
    return kf_out(keyed(spark, d, FLOOR)[1])


@query(f"{TO_CAND} SELECT stream_id,row_number() OVER (PARTITION BY stream_id ORDER BY t)::INT pick_id,sid::INT segment_id,vec_id source_idx FROM cand")
def picks_partial(spark, d):
    return select.select_picks(written(shotted(spark, d)), SEL, diverse=False).select("stream_id", "pick_id", "segment_id", "source_idx")


@query(f"""{W}{F_}, cand AS (SELECT *,0 sid,t comp,row_number() OVER (PARTITION BY stream_id ORDER BY t DESC) dr FROM f), {kf_(0.25, 0)} SELECT stream_id,vec_id source_idx FROM kf""")
def diversity_topscore(spark, d):
    rows = emb(spark, d).withColumn("segment_id", F.lit(0)).withColumn("score", F.col("timestamp_sec"))
    return select.diversity(rows, SelectorConfig(diversity_sim_threshold=0.25, min_picks=0), "score").select("stream_id", "source_idx")


# --- joins ------------------------------------------------------------------------------------------
@query(f"{TO_KF} SELECT fr.stream_id,fr.vec_id source_idx,coalesce(kf.pick_id,0) pick_id FROM fr LEFT JOIN kf ON kf.stream_id=fr.stream_id AND round(kf.t,3)=round(fr.t,3)")
def pick_frame_join(spark, d):
    return joins.mark_picks(*keyed(spark, d)).select("stream_id", "source_idx", F.coalesce("pick_id", F.lit(0)).alias("pick_id"))


@query(f"{TO_KF} SELECT fr.stream_id,fr.vec_id source_idx FROM fr SEMI JOIN kf ON kf.stream_id=fr.stream_id AND round(kf.t,3)=round(fr.t,3)")
def pick_semi(spark, d):
    return joins.only_picks(*keyed(spark, d)).select("stream_id", "source_idx")


@query(f"""WITH {EV_}, q AS (SELECT stream_id,event_id point,t+5000.5 t FROM v WHERE event_type='click'), z AS (SELECT q.stream_id,q.point,v.event_id source_idx,row_number() OVER (PARTITION BY q.point ORDER BY abs(v.t-q.t),v.t,v.event_id) rn FROM q JOIN v USING(stream_id)) SELECT stream_id,point,source_idx FROM z WHERE rn=1""")
def nearest_frame(spark, d):
    rows = ev(spark, d)
    points = rows.where("event_type = 'click'").select("stream_id", F.col("source_idx").alias("point"), (F.col("timestamp_sec") + 5000.5).alias("t"))
    return joins.nearest(rows, points).select("stream_id", "point", "source_idx")


@query(f"""{W}{EV_}, l AS (SELECT stream_id,coalesce(list(t ORDER BY t) FILTER (event_type='click'),[]) a,coalesce(list(t ORDER BY t) FILTER (event_type='view'),[]) b FROM v GROUP BY 1),
m AS (SELECT stream_id,1 i,a,b free,0 n FROM l UNION ALL SELECT stream_id,i+1,a,CASE WHEN j IS NULL THEN free ELSE list_concat(free[1:j-1],free[j+1:]) END,n+(j IS NOT NULL)::INT FROM m, LATERAL (SELECT max(k) j FROM (SELECT k,abs(free[k]-a[i]) x FROM (SELECT unnest(range(1,len(free)+1)) k)) WHERE x<=86400.0+1e-9 AND x=(SELECT min(abs(y-a[i])) FROM (SELECT unnest(free) y))) WHERE i<=len(a))
SELECT m.stream_id,n::BIGINT matched,len(l.a) n_a,len(l.b) n_b,round(CASE WHEN len(l.a)+len(l.b)=0 THEN 1 ELSE n/(len(l.a)+len(l.b)-n) END,6) jaccard FROM m JOIN l USING(stream_id) WHERE i=len(l.a)+1""")
def tolerance_jaccard(spark, d):
    rows = ev(spark, d)
    sides = rows.where("event_type in ('click', 'view')").select("stream_id", F.when(F.col("event_type") == "click", "a").otherwise("b").alias("side"), F.col("timestamp_sec").alias("t"))
    return joins.match_times(sides, ["stream_id"], 86400.0, rows).withColumn("jaccard", F.round("jaccard", 6))


# --- visual data ------------------------------------------------------------------------------------
@query(f"{TO_KF} SELECT fr.stream_id,fr.vec_id source_idx,round(greatest(0.5,least(1.0,fr.sim)),6) y,fr.sim<0.05 below,kf.pick_id IS NOT NULL is_pick FROM fr LEFT JOIN kf ON kf.stream_id=fr.stream_id AND kf.t=fr.t")
def similarity_curve(spark, d):
    s, k = keyed(spark, d)
    return visuals.similarity_curve(s, k, 0.05).select("stream_id", "source_idx", r6("y"), "below", "is_pick")


@query(f"WITH {F_}, c AS (SELECT *,count(*) OVER (PARTITION BY stream_id) n FROM f), p AS (SELECT *,(CASE WHEN ceil(n/10)>4 THEN ceil(n/4) ELSE 10 END)::INT per FROM c) SELECT stream_id,vec_id source_idx,floor(t/per)::INT strip_row,(t::INT%per)::INT strip_col FROM p")
def film_strip(spark, d):
    return visuals.film_strip(emb(spark, d), 1000, 100, 4).select("stream_id", "source_idx", "strip_row", "strip_col")


@query(f"{TO_KF} SELECT stream_id,pick_id,((pick_id-1)//5)::INT sheet_row,((pick_id-1)%5)::INT sheet_col,printf('KF%02d  seg #%d  t=%.1fs',pick_id,sid,t) banner FROM kf")
def contact_sheet(spark, d):
    return visuals.contact_sheet(keyed(spark, d)[1]).select("stream_id", "pick_id", "sheet_row", "sheet_col", "banner")


@query(f"WITH {F_}, n AS (SELECT stream_id,count(*) n,least(8,count(*)) k FROM f GROUP BY 1) SELECT stream_id,i::INT label,floor(i*(n-1)/greatest(k-1,1))::INT analyzed_idx FROM (SELECT *,unnest(range(0,k)) i FROM n)")
def label_ticks(spark, d):
    return visuals.labels(emb(spark, d), 8)


# --- evaluation ---------------------------------------------------------------------------------------
@query("SELECT event_type,count(*) frames,round(avg(value),6) mean_ms,round(quantile_cont(value,0.5),6) p50_ms,round(quantile_cont(value,0.95),6) p95_ms,round(1000/greatest(avg(value),1e-6),6) fps FROM events GROUP BY 1")
def latency_summary(spark, d):
    return evaluate.latency_summary(read(spark, d, "events"), "event_type", "value")


@query(f"WITH {EV_} SELECT stream_id,event_id source_idx,round(avg(value) OVER w,9) running_ms,count(*) OVER w seen FROM v WINDOW w AS (PARTITION BY stream_id ORDER BY t,event_id ROWS UNBOUNDED PRECEDING)")
def running_latency(spark, d):
    return evaluate.running_latency(ev(spark, d), "stream_id", ["timestamp_sec", "source_idx"], "sharpness").select("stream_id", "source_idx", F.round("running_ms", 9).alias("running_ms"), "seen")


@query(f"{TO_KF} SELECT x.*,y.picks FROM (SELECT stream_id,count(*) frames,count(DISTINCT sid) segments,max(t)-min(t) duration_sec FROM fr GROUP BY 1) x JOIN (SELECT stream_id,count(*) picks FROM kf GROUP BY 1) y USING(stream_id)")
def run_summary(spark, d):
    return evaluate.run_summary(*keyed(spark, d))


@query("WITH h AS (SELECT event_type,floor(value/8)::INT bin,count(*) n FROM events WHERE value>=0 AND value<256 GROUP BY 1,2) SELECT event_type,bin,n,round(n/sum(n) OVER (PARTITION BY event_type),9) share FROM h")
def hist32_l1(spark, d):
    return evaluate.histogram_l1(read(spark, d, "events"), "event_type", "value").withColumn("share", F.round("share", 9))


@query(f"WITH {EV_} SELECT stream_id,event_id source_idx FROM v QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY t DESC,event_id DESC)<=12")
def status_tail(spark, d):
    return evaluate.tail(ev(spark, d), "stream_id", [F.desc("timestamp_sec"), F.desc("source_idx")], 12).select("stream_id", "source_idx")


# --- captions -----------------------------------------------------------------------------------------
@query(f"""{TO_KF}, c AS (SELECT *,count(*) OVER (PARTITION BY stream_id) cnt FROM kf), i AS (SELECT DISTINCT stream_id,round_even(x*(cnt-1)/4.0::DOUBLE,0)::BIGINT k FROM (SELECT stream_id,cnt,unnest(range(0,5)) x FROM (SELECT DISTINCT stream_id,cnt FROM c))),
z AS (SELECT c.* FROM c LEFT JOIN i ON i.stream_id=c.stream_id AND i.k=c.pick_id-1 WHERE c.cnt<=5 OR i.k IS NOT NULL) SELECT stream_id,pick_id,count(*) OVER (PARTITION BY stream_id) "of" FROM z""")
def caption_subset(spark, d):
    return captions.cap_subset(keyed(spark, d)[1], 5).select("stream_id", "pick_id", "of")


@query(f"{TO_KF}, b AS (SELECT *,row_number() OVER (PARTITION BY stream_id,sid ORDER BY comp DESC,t) r FROM kf) SELECT stream_id,sid::INT segment_id,pick_id,(row_number() OVER (PARTITION BY stream_id,sid ORDER BY t)-1)::INT place FROM b WHERE r<=2")
def shot_subset(spark, d):
    return captions.shot_subset(keyed(spark, d)[1], 2).select("stream_id", "segment_id", "pick_id", "place")


@query(f"{TO_KF}, c AS (SELECT *,count(*) OVER (PARTITION BY stream_id) cnt FROM kf) SELECT stream_id,pick_id,printf('FRAME %d/%d @ t=%.2fs  (segment #%d)',pick_id,cnt,t,sid) line FROM c")
def prompt_lines(spark, d):
    return captions.prompt_lines(keyed(spark, d)[1], CaptionerConfig(max_picks=100000)).select("stream_id", "pick_id", "line")


@query("SELECT role,count(*) captions,sum(length(text))::BIGINT chars,sum(len(regexp_extract_all(text,'\\S+')))::BIGINT words FROM conversations GROUP BY 1")
def caption_metrics(spark, d):
    return evaluate.caption_metrics(read(spark, d, "conversations"), "role", "text")


@query("WITH x AS (SELECT conv_id,turn,regexp_replace(replace(text,chr(10),' '),'^\\s+|\\s+$','','g') s FROM conversations) SELECT conv_id,turn,CASE WHEN length(s)>80 THEN substr(s,1,79)||'…' ELSE s END short FROM x")
def caption_shorten(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", text.shorten(F.col("text"), 80).alias("short"))


@query("SELECT page_id,(contains(url,'403') OR contains(url,'not available in your region') OR contains(url,'country') OR contains(url,'invalid_api_key') OR contains(url,'Unauthorized') OR contains(url,'401')) retry FROM pages")
def error_classifier(spark, d):
    return read(spark, d, "pages").select("page_id", text.retryable(F.col("url")).alias("retry"))


@query("SELECT page_id,len(l) n,l[1] first_name,l[-1] last_name FROM (SELECT page_id,list_filter(list_transform(string_split(replace(replace(url,'/',','),'.',chr(10)),','),lambda x: trim(x)),lambda x: x<>'') l FROM (SELECT page_id,replace(url,chr(10),',') url FROM (SELECT page_id,replace(replace(url,'/',' , '),'.',chr(10)) url FROM pages)))")
def model_list(spark, d):
    names = text.model_list(F.replace(F.replace(F.col("url"), F.lit("/"), F.lit(" , ")), F.lit("."), F.lit("\n")))
    return read(spark, d, "pages").select("page_id", names.alias("l")).select("page_id", F.size("l").cast("long").alias("n"), F.get("l", F.lit(0)).alias("first_name"), F.try_element_at("l", F.lit(-1)).alias("last_name"))


@query("SELECT page_id,regexp_replace(url,'[^\\p{L}\\p{N}_.-]','_','g') label,printf('f%05d_t%07.2fs.jpg',page_id,page_id*0.5) frame_file,printf('kf_%03d_seg%02d_t%07.2fs.jpg',page_id,page_id%7,page_id*0.5) pick_file FROM pages")
def file_names(spark, d):
    t = F.col("page_id") * F.lit(0.5)
    return read(spark, d, "pages").select("page_id", text.safe_label(F.col("url")).alias("label"), text.frame_file(F.col("page_id"), t).alias("frame_file"), text.pick_file(F.col("page_id"), F.col("page_id") % 7, t).alias("pick_file"))


@query("""WITH x AS (SELECT doc_id,((doc_id%9-4)*90)::INT deg,(doc_id%3000+1)::INT w,(doc_id*7%2000+1)::INT h FROM documents), y AS (SELECT *,((-deg)%360+360)%360 turn FROM x), z AS (SELECT *,CASE WHEN turn IN (90,270) THEN h ELSE w END a,CASE WHEN turn IN (90,270) THEN w ELSE h END b FROM y)
SELECT doc_id,turn,CASE turn WHEN 90 THEN 'transpose=1' WHEN 180 THEN 'transpose=1,transpose=1' WHEN 270 THEN 'transpose=2' END turn_filter,greatest(2,floor(floor(a*least(1.0::DOUBLE,960::DOUBLE/a))/2)*2)::INT out_w,greatest(2,floor(floor(b*least(1.0::DOUBLE,960::DOUBLE/a))/2)*2)::INT out_h FROM z""")
def rotation_and_size(spark, d):
    x = read(spark, d, "documents").select("doc_id", ((F.col("doc_id") % 9 - 4) * 90).cast("int").alias("deg"), (F.col("doc_id") % 3000 + 1).cast("int").alias("w"), (F.col("doc_id") * 7 % 2000 + 1).cast("int").alias("h"))
    turn = text.rotation(F.col("deg"))
    w, h = text.output_size(F.col("w"), F.col("h"), turn, 960)
    return x.select("doc_id", turn.alias("turn"), text.rotation_filter(turn).alias("turn_filter"), w.alias("out_w"), h.alias("out_h"))


@query("WITH x AS (SELECT doc_id,CASE doc_id%4 WHEN 0 THEN (doc_id%60)||'000/'||(doc_id%1001) WHEN 1 THEN '0/0' WHEN 2 THEN (doc_id%120)||'.5' ELSE 'n/a' END s FROM documents) SELECT doc_id,round(CASE WHEN contains(s,'/') THEN try_cast(split_part(s,'/',1) AS DOUBLE)/nullif(try_cast(split_part(s,'/',2) AS DOUBLE),0) ELSE try_cast(s AS DOUBLE) END,6) fps FROM x")
def rate_parse(spark, d):
    k = F.col("doc_id")
    s = F.when(k % 4 == 0, F.concat((k % 60).cast("string"), F.lit("000/"), (k % 1001).cast("string"))).when(k % 4 == 1, "0/0").when(k % 4 == 2, F.concat((k % 120).cast("string"), F.lit(".5"))).otherwise("n/a")
    return read(spark, d, "documents").select("doc_id", F.round(text.rate(s), 6).alias("fps"))


@query("SELECT event_id,CASE event_type WHEN 'click' THEN '[frame]' ELSE '[?]' END icon,(event_id*137%180)::INT hue FROM events")
def icons_and_colours(spark, d):
    stage = F.when(F.col("event_type") == "click", "frame").otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", text.stage_icon(stage).alias("icon"), text.colour(F.col("event_id")).cast("int").alias("hue"))


@query("SELECT conv_id,turn,'data:image/jpeg;base64,'||to_base64(encode(text)) url FROM conversations")
def data_urls(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", text.data_url(F.col("text").cast("binary")).alias("url"))


# --- vectors as images ---------------------------------------------------------------------------------
@query("WITH x AS (SELECT vec_id,embedding e,list_median(embedding[2:]) m FROM (SELECT vec_id,embedding::DOUBLE[] embedding FROM embeddings)) SELECT vec_id,list_sum(list_transform(e,lambda v: (v>m)::INT))::INT ones,array_to_string(list_transform(e,lambda v: (v>m)::INT),'') bits FROM x".replace("list_median(embedding[2:])", "list_aggregate(embedding[2:],'median')"))
def phash_bits(spark, d):
    """The threshold step of the perceptual hash, with vectors as coefficients."""
    rest = F.array_sort(F.slice(F.col("embedding").cast("array<double>"), 2, 63))
    median = F.element_at(rest, 32)
    bits = F.transform(F.col("embedding").cast("array<double>"), lambda v: (v > median).cast("int"))
    return read(spark, d, "embeddings").select("vec_id", bits.alias("b")).select("vec_id", F.aggregate("b", F.lit(0), lambda a, x: a + x).alias("ones"), F.array_join(F.col("b").cast("array<string>"), "").alias("bits"))


@query("WITH x AS (SELECT vec_id,embedding::DOUBLE[] e FROM embeddings), l AS (SELECT vec_id,e[k-8]+e[k+8]+e[k-1]+e[k+1]-4*e[k] v FROM x,(SELECT r*8+c+1 k FROM range(1,7) a(r),range(1,7) b(c))) SELECT vec_id,round(var_pop(v),9) sharpness FROM l GROUP BY 1")
def laplacian_grid(spark, d):
    """The sharpness rule on vectors as 8 x 8 grids, inner cells only."""
    e = lambda k: F.element_at("embedding", F.lit(k)).cast("double")
    inner = [r * 8 + c + 1 for r in range(1, 7) for c in range(1, 7)]
    lap = F.array(*[e(k - 8) + e(k + 8) + e(k - 1) + e(k + 1) - 4 * e(k) for k in inner])
    return read(spark, d, "embeddings").select("vec_id", F.round(vectors.var_pop(lap), 9).alias("sharpness"))


BYTE_ = "least(255,greatest(0,round_even((v+1)*127.5::DOUBLE,0)))::DOUBLE"
GRID_ = f"g AS (SELECT vec_id,(k-1)//8 r,(k-1)%8 c,{BYTE_} v FROM (SELECT vec_id,unnest(embedding::DOUBLE[]) v,generate_subscripts(embedding,1) k FROM embeddings))"


def as_bytes(v) -> F.Column:
    """Numbers between -1 and 1 as bytes."""
    whole = F.transform(v.cast("array<double>"), lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.rint((x + 1) * 127.5).cast("int"))))
    return F.unhex(F.array_join(F.transform(whole, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def pictures(spark, d, height: int, width: int, channels: int) -> DataFrame:
    """The vectors as small images: their first numbers as bytes."""
    size = height * width * channels
    image = F.struct(F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(channels).alias("nChannels"), as_bytes(F.slice("embedding", 1, size)).alias("data"))
    return read(spark, d, "embeddings").select("vec_id", image.alias("image"))


@query(f"WITH {GRID_}, l AS (SELECT a.vec_id,sum(CASE WHEN b.r=a.r AND b.c=a.c THEN 0 ELSE b.v*((b.c=a.c)::INT*((b.r=CASE a.r WHEN 0 THEN 1 ELSE a.r-1 END)::INT+(b.r=CASE a.r WHEN 7 THEN 6 ELSE a.r+1 END)::INT)+(b.r=a.r)::INT*((b.c=CASE a.c WHEN 0 THEN 1 ELSE a.c-1 END)::INT+(b.c=CASE a.c WHEN 7 THEN 6 ELSE a.c+1 END)::INT)) END)-4*any_value(a.v) v FROM g a JOIN g b ON a.vec_id=b.vec_id AND abs(a.r-b.r)+abs(a.c-b.c)<=1 GROUP BY a.vec_id,a.r,a.c) SELECT vec_id,round(var_pop(v),6) sharpness FROM l GROUP BY 1")
def image_sharpness(spark, d):
    """The sharpness of each vector's image, by the kernel that frames go through."""
    return pictures(spark, d, 8, 8, 1).select("vec_id", F.round(embedders.image_sharpness(F.col("image")), 6).alias("sharpness"))


@query(f"""WITH {GRID_}, w AS (SELECT k,i,sum(cos(pi()*(2*x+1)*k/64.0::DOUBLE))*sqrt(2/32.0::DOUBLE)*CASE WHEN k=0 THEN 1/sqrt(2::DOUBLE) ELSE 1 END w FROM range(8) a(k),range(8) b(i),range(32) t(x) WHERE x//4=i GROUP BY k,i),
q AS (SELECT vec_id,a.k*8+b.k n,sum(v*a.w*b.w) v FROM g JOIN w a ON a.i=g.r JOIN w b ON b.i=g.c GROUP BY 1,2), m AS (SELECT vec_id,median(v) m FROM q WHERE n>0 GROUP BY 1)
SELECT vec_id,sum((v>m)::INT)::INT ones,string_agg((v>m)::INT::VARCHAR,'' ORDER BY n) bits FROM q JOIN m USING(vec_id) GROUP BY 1""")
def image_phash(spark, d):
    """The perceptual hash of each vector's image, by the registered embedder."""
    hashed = pictures(spark, d, 8, 8, 1).select("vec_id", embedders.embed(F.col("image"), "phash").cast("array<int>").alias("b"))
    return hashed.select("vec_id", F.aggregate("b", F.lit(0), lambda a, x: a + x).alias("ones"), F.array_join(F.col("b").cast("array<string>"), "").alias("bits"))


@query(f"""WITH p AS (SELECT vec_id,(k-1)//3 p,max({BYTE_}) FILTER (k%3=1) b,max({BYTE_}) FILTER (k%3=2) g,max({BYTE_}) FILTER (k%3=0) r FROM (SELECT vec_id,unnest(embedding::DOUBLE[]) v,generate_subscripts(embedding,1) k FROM embeddings) WHERE k<=63 GROUP BY 1,2),
x AS (SELECT *,greatest(r,g,b) v,greatest(r,g,b)-least(r,g,b) d FROM p), h AS (SELECT vec_id,v,CASE WHEN d=0 THEN 0 ELSE CASE WHEN v=r THEN (g-b)/d WHEN v=g THEN 2+(b-r)/d ELSE 4+(r-g)/d END*60 END h,CASE WHEN v=0 THEN 0 ELSE d/v*255 END s FROM x),
z AS (SELECT vec_id,unnest([((round_even((h-360*floor(h/360))/2,0)::INT%180)//8),32+round_even(s,0)::INT//8,64+v::INT//8]) bin FROM h) SELECT vec_id,bin::INT bin,round(count(*)/21.0::DOUBLE,6) share FROM z GROUP BY 1,2""")
def image_hsv(spark, d):
    """The colour histogram of each vector's image of three by seven pixels, by the registered embedder; its bins that are not empty."""
    made = pictures(spark, d, 3, 7, 3).select("vec_id", embedders.embed(F.col("image"), "hsv").alias("h"))
    return made.select("vec_id", F.posexplode("h").alias("bin", "share")).where("share > 0").select("vec_id", "bin", F.round(F.col("share").cast("double"), 6).alias("share"))


@query(f"{TO_SEG} SELECT stream_id,vec_id source_idx,printf('Frame %d: t=%.1fs  sim=%.3f  sharp=%.0f  embed=%.1fms',t::INT+1,t,round(round(sim,6),3)+0.0::DOUBLE,round(round(sharp,6),0),t/10)||CASE WHEN is_start THEN '  [SHOT START]' ELSE '' END message FROM fr")
def frame_messages(spark, d):
    rows = shotted(spark, d)
    line = text.frame_message(F.col("analyzed_idx") + 1, F.col("timestamp_sec"), F.round(F.round("sim_to_shot_mean", 6), 3), F.round(F.round("sharpness", 6), 0), F.col("timestamp_sec") / 10, F.col("is_shot_start"))
    return rows.select("stream_id", "source_idx", line.alias("message"))


@query(f"{TO_KF}, x AS (SELECT stream_id,count(*) frames,count(DISTINCT sid) segments FROM fr GROUP BY 1) SELECT stream_id,printf('Complete: %d frames -> %d segments -> %d keyframes  (%.1fs wall)',frames,segments,picks,1.5) message FROM x JOIN (SELECT stream_id,count(*) picks FROM kf GROUP BY 1) USING(stream_id)")
def complete_messages(spark, d):
    rows = evaluate.run_summary(*keyed(spark, d))
    return rows.select("stream_id", text.complete_message(F.col("frames"), F.col("segments"), F.col("picks"), F.lit(1.5)).alias("message"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}',{embedders.REGISTRY[n].dim})" for n in embedders.list_embedders()) + ") t(name,dim)")
def embedder_registry(spark, d):
    return embedders.catalog(spark).select("name", "dim")


# --- streams --------------------------------------------------------------------------------------------
def table_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a file stream, be it one file or a folder of files: a stream opens a single file only by a pattern, and all files of either."""
    return spark.readStream.schema(read(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def embedding_stream(spark: SparkSession, d: str) -> DataFrame:
    """The table as a file stream; a frame's place in its stream is its rank among smaller ids."""
    ordered = emb(spark, d).select("source_idx", "stream_id", "timestamp_sec")
    rows = table_stream(spark, d, "embeddings")
    return rows.withColumnRenamed("vec_id", "source_idx").select("source_idx", "embedding").join(ordered, "source_idx")


@query(f"{TO_SEG} SELECT stream_id,sid::INT segment_id,start start_sec,end_ end_sec,n num_frames FROM seg")
def streaming_segments(spark, d):
    rows = shots.run_available(shots.stream_shots(embedding_stream(spark, d), SEG))
    closed = rows.where("kind = 'segment_closed'").select("stream_id", "segment_id", "start_sec", "end_sec", "num_frames")
    return closed.unionByName(shots.flush(rows)).withColumn("stream_id", F.col("stream_id").cast("int"))


@query(f"{TO_SEG} {FRAMES_OUT}")
def streaming_frames(spark, d):
    return frames_out(shots.run_available(shots.stream_shots(embedding_stream(spark, d), SEG)).where("kind = 'frame'"))


@query(ORACLE_SQL["greedy_sample"])
def streaming_sample(spark, d):
    rows = table_stream(spark, d, "events")
    return shots.run_available(shots.stream_sample(src.frames_from_events(rows), GAP)).select("stream_id", "source_idx", r6("timestamp_sec"))


def arrivals(spark, d) -> DataFrame:
    """The frames as a stream of four arrivals of two files each, in which frames come up to nine seconds late."""
    return ordered.in_batches(emb(spark, d), 4, 9.0, 2)


def ordered_shots(spark, d) -> DataFrame:
    return ordered.drained(ordered.stream_ordered(arrivals(spark, d), SEG, SEL, late_sec=10.0, idle_sec=20.0), fresh_path(spark)).withColumn("stream_id", F.col("stream_id").cast("int"))


@query(f"{TO_SEG} {FRAMES_OUT}")
def streaming_late_frames(spark, d):
    return frames_out(ordered_shots(spark, d).where("kind = 'frame'"))


@query(f"{TO_SEG} SELECT stream_id,sid::INT segment_id,start start_sec,end_ end_sec,n num_frames,CASE WHEN closed THEN 'cut' ELSE 'idle' END closed_by FROM seg")
def streaming_closed_shots(spark, d):
    return ordered_shots(spark, d).where("kind = 'segment_closed'").select("stream_id", "segment_id", "start_sec", "end_sec", "num_frames", "closed_by")


@query(f"{TO_CAND} SELECT stream_id,row_number() OVER (PARTITION BY stream_id ORDER BY t)::INT pick_id,sid::INT segment_id,vec_id source_idx,(rn-1)::INT rank_in_segment,comp,round(repr,6) repr FROM cand")
def streaming_picks(spark, d):
    """The picks that come with each closed shot, over all batches."""
    rows = ordered.closed_picks(ordered_shots(spark, d))
    return rows.select("stream_id", "pick_id", "segment_id", "source_idx", "rank_in_segment", F.round("composite_score", 6).alias("comp"), F.round("representativeness", 6).alias("repr"))


@query(f"{TO_CAND}, b AS (SELECT stream_id,sid,least(3,count(*)) m FROM cand GROUP BY 1,2), x AS (SELECT stream_id,sid,m,start,end_,printf('Shot starting at t=%.1fs, ending at t=%.1fs (%.1fs long). %d frame(s) follow.',start,end_,end_-start,m) line FROM b JOIN seg USING(stream_id,sid)) SELECT 'segment_caption' event,stream_id,sid::INT segment_id,start start_sec,end_ end_sec,m::INT frames_sent,'default said '||length(line) \"text\",'default' model,'' error FROM x")
def streaming_captions(spark, d):
    """A second streaming query that captions the shots which the first one closes, each with a checkpoint of its own."""
    path = fresh_path(spark)
    ordered.drained(ordered.stream_ordered(arrivals(spark, d), SEG, SEL, late_sec=10.0, idle_sec=20.0), path)
    ordered.caption_stream(spark, f"{path}/rows", f"{path}/captions", f"{path}/captioned", lambda name, prompt: f"{name} said {len(prompt)}").trigger(availableNow=True).start().awaitTermination()
    return ordered.read_captions(spark, f"{path}/captions").drop("latency_sec").withColumn("stream_id", F.col("stream_id").cast("int"))


@query("""WITH m AS (SELECT max(ts) - INTERVAL 6 HOUR w FROM events) SELECT user_id stream_id, epoch_us(date_trunc('day', ts)) / 1e6 begin_sec, count(*) frames, round(avg(value), 6) sharpness
FROM events, m GROUP BY 1, 2, w HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= w""")
def streaming_windows(spark, d):
    rows = table_stream(spark, d, "events")
    rows = rows.select(F.col("user_id").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("sharpness"))
    out = shots.run_available(shots.windowed_counts(rows, "ts", "1 day", "6 hours"))
    return out.select("stream_id", src.seconds(F.col("begin")).alias("begin_sec"), "frames", F.round("sharpness", 6).alias("sharpness"))


# --- sources and sinks, written and read back ---------------------------------------------------------
@query(f"{TO_KF} SELECT stream_id,pick_id,sid::INT segment_id,round_even(t,3) timestamp_sec,round_even(sharp,1) sharpness,(rn-1)::INT rank_in_segment,printf('kf_%03d_seg%02d_t%07.2fs.jpg',pick_id,sid,t) saved_path FROM kf")
def picks_csv(spark, d):
    path = fresh_path(spark)
    sinks.write_csv(sinks.picks_table(keyed(spark, d)[1]), path)
    return src.read_picks(spark, path).select("stream_id", "pick_id", "segment_id", "timestamp_sec", "sharpness", "rank_in_segment", "saved_path")


@query(f"{TO_SEG} SELECT stream_id,sid::INT segment_id,round_even(start,3) start_sec,round_even(end_,3) end_sec,round_even(greatest(end_-start,0),3) duration_sec,n num_frames FROM seg")
def segments_csv(spark, d):
    path = fresh_path(spark)
    sinks.write_csv(sinks.segments_table(segment.segment_rollup(shotted(spark, d))), path)
    return spark.read.csv(path, header=True, schema="stream_id int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SEGMENT))


@query(f"{TO_SEG} SELECT stream_id,'segment_closed' event,sid::INT segment_id,round_even(start,3) start_sec,round_even(end_,3) end_sec,n frames FROM seg WHERE closed")
def events_jsonl(spark, d):
    path = fresh_path(spark)
    sinks.write_events(segment.event_log(shotted(spark, d)), path)
    return spark.read.schema("stream_id int, event string, segment_id int, start_sec double, end_sec double, frames long").json(path)


@query(f"{TO_KF} SELECT x.stream_id::BIGINT stream_id,frames,segments,picks,duration_sec FROM (SELECT stream_id,count(*) frames,count(DISTINCT sid) segments,max(t)-min(t) duration_sec FROM fr GROUP BY 1) x JOIN (SELECT stream_id,count(*) picks FROM kf GROUP BY 1) y USING(stream_id)")
def run_overview(spark, d):
    """A whole run, written to a folder with its reports and read back."""
    from .pipeline import Pipeline

    pipeline = Pipeline(PipelineConfig(output_root=fresh_path(spark), segmenter=SEG, selector=SEL))
    return src.load_run(spark, pipeline.write(pipeline.run(emb(spark, d)), "run"))


@query("""SELECT event_id, (640 + 10 * (event_id % 5))::INT width, 480 height, CASE event_id % 3 WHEN 0 THEN round(30000 / 1001.0, 6) WHEN 1 THEN 25.0 ELSE 12.5 END fps, round(value, 6) duration_sec,
CASE WHEN event_id % 4 = 0 THEN floor(round(value, 6) * CASE event_id % 3 WHEN 0 THEN 30000 / 1001.0 WHEN 1 THEN 25.0 ELSE 12.5 END)::BIGINT ELSE event_id END frame_count, ((360 - 90 * (event_id % 4)) % 360)::INT rotation FROM events""")
def media_probe(spark, d):
    """Answers of a media prober as JSON, made from events, with rates, durations and turns in the places where probers put them."""
    i = F.col("event_id")
    rate = F.when(i % 3 == 0, "30000/1001").when(i % 3 == 1, "0/0").otherwise("12.5")
    stream = F.struct(
        (640 + 10 * (i % 5)).cast("int").alias("width"),
        F.lit(480).alias("height"),
        rate.alias("avg_frame_rate"),
        F.lit("25/1").alias("r_frame_rate"),
        F.when(i % 2 == 0, F.round("value", 6).cast("string")).alias("duration"),
        F.when(i % 4 == 0, "").otherwise(i.cast("string")).alias("nb_frames"),
        F.struct(F.when(i % 4 < 2, (90 * (i % 4)).cast("string")).alias("rotate")).alias("tags"),
        F.when(i % 4 >= 2, F.array(F.struct((90 * (i % 4)).cast("string").alias("rotation")))).alias("side_data_list"),
    )
    meta = F.to_json(F.struct(F.array(stream).alias("streams"), F.struct(F.round("value", 6).cast("string").alias("duration")).alias("format")))
    rows = src.probe(read(spark, d, "events").select("event_id", meta.alias("meta")))
    return rows.select("event_id", "width", "height", r6("fps"), r6("duration_sec"), F.col("frame_count").cast("long").alias("frame_count"), F.col("rotation").cast("int").alias("rotation"))


@query(f"WITH {EV_} SELECT stream_id,event_id source_idx FROM v WHERE t>=1704500000 AND t<1705000000")
def time_range(spark, d):
    return src.between(ev(spark, d), 1704500000, 1705000000).select("stream_id", "source_idx")


@query(f"WITH {EV_}, c AS (SELECT *,t-min(t) OVER (PARTITION BY stream_id) x FROM v) SELECT stream_id,event_id source_idx FROM c WHERE x<=900000 QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY t,event_id)<=5")
def bounded_capture(spark, d):
    return src.capture(ev(spark, d), 900000, 5).select("stream_id", "source_idx")


@query(ORACLE_SQL["grid_sample"])
def sampling_dispatch(spark, d):
    return src.sample(ev(spark, d).drop("timestamp_sec").join(ev(spark, d).select("source_idx", "timestamp_sec"), "source_idx"), 0.7, 4.0).select("stream_id", "analyzed_idx", r6("timestamp_sec"), "source_idx")


# --- prompts of shots, counters, benchmark ------------------------------------------------------------
@query(f"{TO_KF}, b AS (SELECT stream_id,sid,least(3,count(*)) m FROM kf GROUP BY 1,2) SELECT stream_id,sid::INT segment_id,m::INT frames_sent,printf('Shot starting at t=%.1fs, ending at t=%.1fs (%.1fs long). %d frame(s) follow.',start,end_,end_-start,m) prompt FROM b JOIN seg USING(stream_id,sid)")
def shot_prompts(spark, d):
    s, k = keyed(spark, d)
    return captions.shot_prompts(k, segment.segment_rollup(s)).select("stream_id", "segment_id", "frames_sent", "prompt")


@query(f"{TO_KF} SELECT fr.stream_id,fr.vec_id source_idx,count(*) OVER w frames_so_far,sum(fr.is_start::INT) OVER w::BIGINT segments_so_far,count(kf.pick_id) OVER w picks_so_far FROM fr LEFT JOIN kf ON kf.stream_id=fr.stream_id AND kf.vec_id=fr.vec_id WINDOW w AS (PARTITION BY fr.stream_id ORDER BY fr.t)")
def live_counters_picks(spark, d):
    return evaluate.live_counters(*keyed(spark, d)).select("stream_id", "source_idx", "frames_so_far", "segments_so_far", "picks_so_far")


def run_sql(vector: str) -> str:
    """Shots and picks of the vectors that an expression makes of the embeddings: tables fr and kf."""
    return TO_KF.replace("embedding::DOUBLE[] e,", f"{vector} e,")


ONE, TWO = "embedding::DOUBLE[]", "embedding[1:32]::DOUBLE[]"
EACH_ = ", ".join(f"fr{k} AS ({run_sql(v)} SELECT * FROM fr), kf{k} AS ({run_sql(v)} SELECT * FROM kf)" for k, v in ((1, ONE), (2, TWO)))
COUNT_ = " UNION ALL ".join(f"SELECT '{n}' embedder,x.*,coalesce(y.picks,0) picks FROM (SELECT stream_id,count(*) frames,count(DISTINCT sid) segments,max(t)-min(t) duration_sec FROM fr{k} GROUP BY 1) x LEFT JOIN (SELECT stream_id,count(*) picks FROM kf{k} GROUP BY 1) y USING(stream_id)" for k, n in ((1, "one"), (2, "two")))
MATCH_ = """l AS (SELECT c.embedder,c.stream_id,coalesce(a.ts,[]::DOUBLE[]) a,coalesce(b.ts,[]::DOUBLE[]) b FROM c LEFT JOIN (SELECT stream_id,list(t ORDER BY t) ts FROM kf1 GROUP BY 1) a USING(stream_id) LEFT JOIN (SELECT 'one' embedder,stream_id,list(t ORDER BY t) ts FROM kf1 GROUP BY ALL UNION ALL SELECT 'two',stream_id,list(t ORDER BY t) FROM kf2 GROUP BY ALL) b USING(embedder,stream_id)),
m AS (SELECT embedder,stream_id,1 i,a,b free,0 n FROM l UNION ALL SELECT embedder,stream_id,i+1,a,CASE WHEN j IS NULL THEN free ELSE list_concat(free[1:j-1],free[j+1:]) END,n+(j IS NOT NULL)::INT FROM m, LATERAL (SELECT max(k) j FROM (SELECT k,abs(free[k]-a[i]) x FROM (SELECT unnest(range(1,len(free)+1)) k)) WHERE x<=1.5+1e-9 AND x=(SELECT min(abs(y-a[i])) FROM (SELECT unnest(free) y))) WHERE i<=len(a))"""


@query(f"WITH RECURSIVE {EACH_}, c AS ({COUNT_}), {MATCH_} SELECT c.embedder,c.stream_id,frames,segments,picks,duration_sec,round_even(CASE WHEN len(l.a)+len(l.b)=0 THEN 1 ELSE n/(len(l.a)+len(l.b)-n) END,3) jaccard FROM c JOIN m USING(embedder,stream_id) JOIN l USING(embedder,stream_id) WHERE i=len(l.a)+1")
def benchmark_embedders(spark, d):
    """Two embedders in one plan: the vectors, and their first halves."""
    return both_embedders(spark, d)


@query(f"WITH RECURSIVE {EACH_}, c AS ({COUNT_}), {MATCH_}, j AS (SELECT embedder,stream_id,round_even(CASE WHEN len(l.a)+len(l.b)=0 THEN 1 ELSE n/(len(l.a)+len(l.b)-n) END,3) jaccard FROM m JOIN l USING(embedder,stream_id) WHERE i=len(l.a)+1) SELECT embedder,count(*) streams,sum(frames)::BIGINT frames,sum(segments)::BIGINT segments,sum(picks)::BIGINT picks,round(avg(jaccard),6) jaccard FROM c JOIN j USING(embedder,stream_id) GROUP BY 1")
def benchmark_rollup(spark, d):
    """A row per embedder of the same benchmark."""
    return evaluate.by_embedder(both_embedders(spark, d))


def both_embedders(spark, d) -> DataFrame:
    from .pipeline import benchmark

    whole = emb(spark, d)
    half = whole.withColumn("embedding", F.slice("embedding", 1, 32))
    return benchmark({"one": whole, "two": half}, PipelineConfig(segmenter=SEG, selector=SEL))
