"""Queries over the driver's tables, one for each operator or step, and the same in DuckDB's SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.model import SENSORS, classes
from tessera.operators import bagging, classify, kernels, radiometry, run, scene, segments, stencils, tiling, training
from tessera.plans import fixtures as fx
from tessera.sources import images, sinks
from tessera.sources.staging import staged

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
HEIGHT, WIDTH = 100, 22


def _query(oracle: str | None = None, *relations: str) -> Callable[[Query], Query]:
    """Registers a query by its name, and its SQL with the relations that it needs."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = fx.sql(oracle, *relations)
        return f

    return add


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, 6).alias(c) if kinds[c] == "double" and c not in keep else F.col(c) for c in df.columns))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# pixels and radiometry


@_query("select * from scene", "scene")
def pixels_explode(spark, d):
    return fx.scene(spark, d)


_STRETCH = "case when {0}=0 then 0 else cast(((least(greatest({0},40),200)-40)*254)//160+1 as integer) end"


@_query(f"select x,y,{_STRETCH.format('b0')} b0,{_STRETCH.format('b1')} b1,{_STRETCH.format('b2')} b2 from scene", "scene")
def stretch_fixed(spark, d):
    bands = {b: radiometry.stretch(F.col(b), F.lit(40), F.lit(200)) for b in ("b0", "b1", "b2")}
    return fx.scene(spark, d).select("x", "y", *(v.alias(b) for b, v in bands.items()))


_BALANCE = "case when {0}=0 then 0 else cast(greatest(1,least(255,floor((cast(210 as double)/{1})*{0}))) as integer) end"


@_query(f"select x,y,{_BALANCE.format('b0', '210')} b0,{_BALANCE.format('b1', '180')} b1,{_BALANCE.format('b2', '195')} b2 from scene", "scene")
def white_balance(spark, d):
    return radiometry.balance_bands(fx.scene(spark, d), {"b0": 210, "b1": 180, "b2": 195}).select("x", "y", "b0", "b1", "b2")


@_query("select distinct src_dtype, bands, 1 as lower, cast(pow(2, case when src_dtype>12 then 11 else src_dtype end)-1 as integer) upper from dims", "dims")
def stretch_none_params(spark, d):
    depths = fx.dims(spark, d).select("src_dtype", "bands").distinct()
    return radiometry.full_range_params(depths).select("src_dtype", "bands", "lower", "upper")


_LONG = "select block, x, y, unnest([0,1,2]) band, unnest([b0,b1,b2]) dn from scene"


@_query(f"select block, band, min(dn) dn_min, max(dn) dn_max from ({_LONG}) group by block, band", "scene")
def band_minmax(spark, d):
    return radiometry.band_range(radiometry.unpivot_bands(fx.scene(spark, d), ["block"], ["b0", "b1", "b2"]), ["block", "band"])


@_query(
    f"""select r.band, cast(r.dn - r.lo as bigint) i, cast(r.dn as bigint) dn, coalesce(c.n, 0) h
  from (select band, lo, unnest(range(lo, hi)) dn from (select band, min(dn) lo, max(dn) hi from ({_LONG}) group by band)) r
  left join (select band, dn, count(*) n from ({_LONG}) group by band, dn) c on r.band=c.band and r.dn=c.dn""",
    "scene",
)
def band_histogram(spark, d):
    return radiometry.band_histogram(radiometry.unpivot_bands(fx.scene(spark, d), [], ["b0", "b1", "b2"]), ["band"])


def _event_histogram(spark, d):
    values = fx.table(spark, d, "events").select(F.lit(0).alias("band"), F.floor("value").alias("dn"))
    return radiometry.band_histogram(values, ["band"])


_CANDIDATES = """select i, dn, h from (
  select i, dn, h, lag(h) over w p1, lead(h) over w n1, lag(h,5) over w p5, lead(h,5) over w n5, count(*) over () n,
    floor(sum(h) over () * 0.004) least, first(h order by i) over () h_first, last(h order by i) over () h_last
  from hist window w as (order by i))
  where case when i=0 then h>=n1 and h>=n5 and h_last>least when i=n-1 then h>=p1 and h>=p5 and h>least
    else h>=p1 and h>=n1 and h>=coalesce(p5,h_first) and h>=coalesce(n5,h_last) and h>least end"""
_CANDIDATES = _CANDIDATES.replace("first(h order by i) over ()", "(select h from hist order by i limit 1)").replace("last(h order by i) over ()", "(select h from hist order by i desc limit 1)")


@_query(f"select cast(i as bigint) i, cast(dn as bigint) dn, h from ({_CANDIDATES})", "hist")
def hist_peak_candidates(spark, d):
    return radiometry.peak_candidates(_event_histogram(spark, d), ["band"]).select("i", "dn", "h")


#: Peaks of candidates (g, dn, h), thinned one comparison at a time: d the reach, i the next peak, stay and left what stays and the peak to compare the next one with.
_THINNED = """gathered as (select g, list(struct_pack(dn := dn, h := h) order by dn) peaks, greatest(5, cast(floor((max(dn)-min(dn))/6) as bigint)) most from candidates group by g),
  thin(g, most, d, i, peaks, stay, lft) as (
    select g, most, 5, 1, peaks, list_filter(peaks, lambda p: false), null::struct(dn bigint, h bigint) from gathered
    union all
    select g, most, case when e is null then d+5 else d end, case when e is null then 1 else i+1 end,
      case when e is not null then peaks when lft is null then stay else list_append(stay, lft) end,
      case when e is null then list_filter(peaks, lambda p: false) when lft is null or (near and lft.h<e.h) then stay else list_append(stay, lft) end,
      case when e is null then null when lft is null or not near or lft.h<e.h then e end
    from (select *, coalesce(e.dn-lft.dn<d, false) near from (select *, peaks[i] e from thin where d<=most))),
  peaks as (select g, unnest(peaks) p from thin where d>most)"""


def _recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1)


@_query()
def hist_peak_nms(spark, d):
    return radiometry.peaks(radiometry.peak_candidates(_event_histogram(spark, d), ["band"]), ["band"])


_SQL["hist_peak_nms"] = _recursive(fx.sql(f", candidates as (select 0 as g, cast(dn as bigint) dn, cast(h as bigint) h from ({_CANDIDATES})), {_THINNED} select g as band, p.dn peak from peaks", "hist"))


@_query(
    f"""select cast(case when (lo-black)/2047.0>=0.03 or hi-lo<2047/3.0 then least(black,163) else black end as bigint) as lower, cast(white as bigint) as upper, cast(white as bigint) white, cast(black as bigint) black
  from (select lo, hi, least(coalesce(min(dn) filter (dn>=hi and (dn-hi)%2=0 and h<=0.15*hh), max(dn)), max(dn)) white,
    coalesce(max(dn) filter (dn<=lo and h<=0.5*hl), min(dn)) black
    from hist, (select lo, hi, (select h from hist where dn=lo) hl, (select h from hist where dn=hi) hh from (select min(dn) lo, max(dn) hi from ({_CANDIDATES}))) group by lo, hi)""",
    "hist",
)
def hist_thresholds(spark, d):
    histogram = _event_histogram(spark, d)
    ends = radiometry.peak_candidates(histogram, ["band"]).groupBy("band").agg(F.min("dn").alias("low"), F.max("dn").alias("high"))
    return radiometry.thresholds(histogram, ends, ["band"], src_dtype=11).drop("band")


@_query(
    f"""select block, least(min(lo),2048) as lower, case when sum(p)<=count(*) then greatest(max(hi),204) else max(hi) end as upper
  from (select block, band, cast(min(dn) as bigint) lo, cast(max(dn) as bigint) hi, count(distinct dn) filter (dn>200) p from ({_LONG}) where dn>0 group by block, band) group by block""",
    "scene",
)
def stretch_params_image(spark, d):
    values = radiometry.unpivot_bands(fx.scene(spark, d), ["block"], ["b0", "b1", "b2"]).where("dn > 0")
    bands = values.groupBy("block", "band").agg(F.min("dn").alias("lower"), F.max("dn").alias("upper"), F.countDistinct(F.when(F.col("dn") > 200, F.col("dn"))).alias("peaks"))
    return radiometry.image_params(bands, ["block"], src_dtype=8)


@_query(
    "select cast(least(floor((v-lo)*1000/(hi-lo)),999) as bigint) bin, count(*) n from (select floor(value) v from events), (select min(floor(value)) lo, max(floor(value)) hi from events) group by 1"
)
def display_histogram_1000(spark, d):
    return radiometry.display_histogram(fx.table(spark, d, "events").select(F.floor("value").alias("dn")), 1000)


# blocks


_SIZE = "least(coalesce((select min(s) from (select unnest(range(6400, {0}*2+6657, 256)) s) where ({0}%s)*2>s), {0}), {0})"
_SIZES = f"""select image_id, x_dim, y_dim, cast(case when x_dim<=6400 or y_dim<=6400 then x_dim else {_SIZE.format('x_dim')} end as integer) block_x,
  cast(case when x_dim<=6400 or y_dim<=6400 then y_dim else {_SIZE.format('y_dim')} end as integer) block_y from dims"""


@_query(_SIZES, "dims")
def block_sizes(spark, d):
    return tiling.block_sizes(fx.dims(spark, d).select("image_id", "x_dim", "y_dim"))


@_query(
    f"""select image_id, x_dim, y_dim, block_x, block_y, cast(y as integer) y, cast(x as integer) x, cast(least(block_x, x_dim-x) as integer) w, cast(least(block_y, y_dim-y) as integer) h
  from (select *, unnest(range(0, x_dim, block_x)) x from (select *, unnest(range(0, y_dim, block_y)) y from ({_SIZES})))""",
    "dims",
)
def block_grid(spark, d):
    return tiling.block_grid(block_sizes(spark, d))


@_query("select x, y, cast(x//64 as integer) block_row, cast(y//8 as integer) block_col, x%64 r, y%8 c from scene", "scene")
def pixel_block_assign(spark, d):
    return tiling.assign_blocks(fx.scene(spark, d), 64, 8).select("x", "y", "block_row", "block_col", "r", "c")


@_query(
    """select cast((x//h//2)*h+x%h as integer) x, cast((x//h%2)*22+y as integer) y, b1 from scene, (select (max(x)+4)//4 h from scene)""", "scene"
)
def mosaic_shift(spark, d):
    """Four tiles, each a quarter of the scene's rows, laid out two by two."""
    pixels = fx.scene(spark, d)
    rows = (pixels.agg(F.max("x")).first()[0] + 4) // 4
    parts = pixels.select(F.floor(F.col("x") / rows).cast("int").alias("tile"), (F.col("x") % rows).alias("r"), F.col("y").alias("c"), "b1")
    tiles = parts.select("tile").distinct().withColumn("name", F.format_string("tile_%03d.h5", "tile"))
    return tiling.mosaic(parts, tiles, rows, WIDTH).select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "b1")


@_query("select x, y, b0 red, b1 green, b2 blue from scene", "scene")
def display_bands(spark, d):
    return tiling.display(fx.scene(spark, d), "srgb")


@_query(
    """select x, y, round(sum(b0+b1+b2) over (partition by x//4, y//4)/48.0, 6) mean from scene""", "scene"
)
def downsample_mean(spark, d):
    return _rounded(tiling.downsample(fx.scene(spark, d), 4, ["b0", "b1", "b2"]).select("x", "y", "mean"))


@_query("select x, y, b5 red, b3 green, b2 blue from ms", "ms")
def raw_colour_bands(spark, d):
    """The bands that raw scenes of eight are shown by, which are others than those of the labelling view."""
    return tiling.raw_display(fx.ms(spark, d), "wv02_ms")


@_query("select x, y, b4 red, b2 green, b1 blue from ms", "ms")
def composite_bands(spark, d):
    return tiling.composite(fx.ms(spark, d), ["b4", "b2", "b1"])


# segments


_STATS = ", ".join(f"round(avg(b{k}),6) mean_b{k}, round(stddev_pop(b{k}),6) std_b{k}" for k in range(3))


@_query(f"select block, seg, count(*) n, {_STATS} from scene where b0<>0 group by block, seg", "scene")
def segment_stats(spark, d):
    return _rounded(segments.moments(fx.scene(spark, d), ["b0", "b1", "b2"]))


@_query("select block, seg, round(entropy(b1),6) entropy from scene where b0<>0 group by block, seg", "scene")
def segment_hist_entropy(spark, d):
    return _rounded(segments.entropy(segments.value_counts(fx.scene(spark, d).where("b0 <> 0"), "b1")))


def _met(mode: str, relation: str, width: int, values: str) -> str:
    extra = "" if mode == "clean" else " and (x%100)+o between 0 and 99"
    differs = "s.seg<>0" if mode == "training" else "s.seg<>p.seg"
    return f"""select p.block, p.seg, {values} from (
      select block, seg, x+o nx, y ny from {relation}, (values (-4),(-3),(3),(4)) t(o) where b0<>0 and (x%100)+o between 0 and 99
      union all select block, seg, x nx, y+o ny from {relation}, (values (-4),(-3),(3),(4)) t(o) where b0<>0 and y+o between 0 and {width - 1}{extra}) p
    join {relation} s on s.block=p.block and s.x=p.nx and s.y=p.ny and {differs}"""


_AROUND = "select block, seg, count(*) ext_n, round(avg(b1),6) ext_mean_b1, round(stddev_pop(b1),6) ext_std_b1, max(b1) ext_max_b1 from ({}) group by block, seg"


def _around(mode: str) -> Query:
    def run(spark, d):
        return _rounded(segments.around_stats(segments.neighbours(fx.scene(spark, d), HEIGHT, WIDTH, mode, ("b1",))))

    return run


for _name, _mode in (("neighbor_stats_literal", "literal"), ("neighbor_stats_clean", "clean"), ("neighbor_training_skew", "training")):
    _QUERIES[_name] = _around(_mode)
    _SQL[_name] = fx.sql(_AROUND.format(_met(_mode, "scene", WIDTH, "s.b1")), "scene")


@_query(_AROUND.format(_met("clean", "scene", WIDTH, "s.b1")), "scene")
def neighbor_lag_form(spark, d):
    return _rounded(segments.around_stats(segments.neighbours_by_window(fx.scene(spark, d))))


def _means(n: int) -> str:
    return ", ".join(f"greatest(1, avg(b{k})) m{k}, stddev_pop(b{k}) s{k}" for k in range(n))


@_query(
    f"""select a.block, a.seg, round(m0,6) f0, round(m1,6) f1, round(m2,6) f2, round(s0,6) f3, round(s1,6) f4, round(s2,6) f5, round((m2-m0)/(m2+m0),6) f6, round((m2-m1)/(m2+m1),6) f7,
  round(case when 2*m2-m1-m0<1 then 0 else (m1-m0)/(2*m2-m1-m0) end,6) f8, cast(n as double) f9, round(e,6) f10,
  coalesce(round(em,6),0) f11, coalesce(round(es,6),0) f12, coalesce(cast(ex as double),0) f13, coalesce(round(ee,6),0) f14, cast(0 as double) f15
  from (select block, seg, count(*) n, entropy(b1) e, {_means(3)} from scene where b0<>0 group by block, seg) a
  left join (select block, seg, avg(b1) em, stddev_pop(b1) es, max(b1) ex, entropy(b1) ee from ({_met('literal', 'scene', WIDTH, 's.b1')}) group by block, seg) e on a.block=e.block and a.seg=e.seg""",
    "scene",
)
def features_srgb16(spark, d):
    return _rounded(segments.features_srgb(fx.scene(spark, d), HEIGHT, WIDTH))


def features_srgb16_kernel(spark, d):
    """The same features, with what lies around segments counted by a kernel in each block."""
    pixels = fx.scene(spark, d)
    return _rounded(segments.features_srgb(pixels, HEIGHT, WIDTH, around=kernels.neighbour_counts(pixels, height=HEIGHT)))


_QUERIES["features_srgb16_kernel"] = features_srgb16_kernel
_SQL["features_srgb16_kernel"] = _SQL["features_srgb16"]


def _counted(mode: str) -> Query:
    def run(spark, d):
        found = segments.counted_stats(kernels.neighbour_counts(fx.scene(spark, d), mode, height=HEIGHT))
        names_ = {"ext_mean": "ext_mean_b1", "ext_std": "ext_std_b1", "ext_max": "ext_max_b1"}
        return _rounded(found.drop("ext_entropy").withColumnsRenamed(names_))

    return run


for _name, _mode in (("neighbor_kernel_literal", "literal"), ("neighbor_kernel_clean", "clean"), ("neighbor_kernel_training", "training")):
    _QUERIES[_name] = _counted(_mode)
    _SQL[_name] = fx.sql(_AROUND.format(_met(_mode, "scene", WIDTH, "s.b1")), "scene")


_WHITE, _BLACK = [210.0, 205, 200, 195, 190, 185, 180, 0], [0.0, 12, 14, 16, 18, 20, 22, 24]
_MS_REFS = ", ".join([f"round(m{b}/{_WHITE[b]:g}+1e-9,6) f{16 + b}" for b in range(7)] + [f"round(m{b}/nullif({_BLACK[b]:g},0)+1e-9,6) f{23 + b}" for b in range(8)])


@_query(
    f"""select a.block, a.seg, {', '.join(f'round(m{k},6) f{k}' for k in range(8))}, round(s6,6) f8, round(m0/m2,6) f9, round(m1/m6,6) f10, round(m3/m6,6) f11,
  coalesce(round(e3,6),0) f12, coalesce(round(e7,6),0) f13, round((m0-m6)/(m0+m6),6) f14, round((m2-m4)/(m2+m4),6) f15, {_MS_REFS}
  from (select block, seg, {_means(8)} from ms where b0<>0 group by block, seg) a
  left join (select block, seg, avg(b3) e3, avg(b7) e7 from ({_met('literal', 'ms', 8, 's.b3, s.b7')}) group by block, seg) e on a.block=e.block and a.seg=e.seg""",
    "ms",
)
def features_ms31(spark, d):
    rows = segments.features_ms(fx.ms(spark, d), HEIGHT, 8, _WHITE, _BLACK)
    return rows.select("block", "seg", *(F.round(F.col(f"f{k}") + (0.0 if k < 16 else 1e-9), 6).alias(f"f{k}") for k in range(31)))  # few digits over few: off ties


@_query(
    f"""select a.block, a.seg, round(m0,6) f0, f1, f2, f3, round(s0,6) f4, cast(n as double) f5, round(e,6) f6, coalesce(round(em,6),0) f7, coalesce(round(es,6),0) f8, coalesce(cast(ex as double),0) f9, coalesce(round(ee,6),0) f10, cast(152 as double) f11
  from (select block, seg, count(*) n, median(b0) f1, cast(min(b0) as double) f2, cast(max(b0) as double) f3, entropy(b0) e, {_means(1)} from scene where b0<>0 group by block, seg) a
  left join (select block, seg, avg(b0) em, stddev_pop(b0) es, max(b0) ex, entropy(b0) ee from ({_met('clean', 'scene', WIDTH, 's.b0')}) group by block, seg) e on a.block=e.block and a.seg=e.seg""",
    "scene",
)
def features_pan12(spark, d):
    return _rounded(segments.features_pan(fx.scene(spark, d), HEIGHT, WIDTH, names.DEFAULT_DAY))


@_query("select x, y, block, cast(seg - min(seg) over (partition by block) as integer) seg from (select x, y, block, seg+3 seg from scene)", "scene")
def label_rebase(spark, d):
    return segments.rebase_labels(fx.scene(spark, d).withColumn("seg", F.col("seg") + 3)).select("x", "y", "block", "seg")


@_query("select block, seg, greatest(min(x)-100,0) x_min, least(max(x)+100,1999) x_max, greatest(min(y)-100,0) y_min, least(max(y)+100,21) y_max from scene group by block, seg", "scene")
def segment_bbox(spark, d):
    return segments.bounding_boxes(fx.scene(spark, d), 100, 2000, WIDTH)


@_query("select block, seg, max(b0)<=1 no_segments, max(greatest(b0,b1,b2))<2 no_classes from scene group by block, seg", "scene")
def empty_block_filter(spark, d):
    return segments.empty_groups(fx.scene(spark, d), ["block", "seg"], ["b0", "b1", "b2"])


@_query(
    "select i.block, cast(i.seg as integer) seg, coalesce(c.n,0) n from (select block, unnest(range(max(seg)+1)) seg from scene group by block) i left join (select block, seg, count(*) n from scene where b0<>0 group by block, seg) c on i.block=c.block and i.seg=c.seg",
    "scene",
)
def segment_ids_dense(spark, d):
    return segments.dense_ids(fx.scene(spark, d))


@_query("select p.x, p.y, s.block, s.seg from (select distinct cast(vec_id*7919%n as integer) x, cast(vec_id%25 as integer) y from embeddings, (select max(x)+1 n from scene)) p join scene s on s.x=p.x and s.y=p.y", "scene")
def segment_at_points(spark, d):
    """Points all over the scene, some of them beside it."""
    pixels = fx.scene(spark, d)
    rows = F.broadcast(pixels.agg((F.max("x") + 1).alias("n")))  # one row
    points = fx.table(spark, d, "embeddings").join(rows).select((F.col("vec_id") * 7919 % F.col("n")).cast("int").alias("x"), (F.col("vec_id") % 25).cast("int").alias("y"))
    return segments.segment_at(pixels, points)


@_query(
    """select block, x, y from (select *, lag(seg) over a l, lead(seg) over a r, lag(seg) over b u, lead(seg) over b w from scene
  window a as (partition by block, x order by y), b as (partition by block, y order by x)) where coalesce(l<>seg,false) or coalesce(r<>seg,false) or coalesce(u<>seg,false) or coalesce(w<>seg,false)""",
    "scene",
)
def boundary_pixels(spark, d):
    return segments.boundary_pixels(fx.scene(spark, d))


# classes and reports


@_query("select x, y, block, seg, cls from painted", "painted")
def paint_classes(spark, d):
    return classify.paint(fx.scene(spark, d), fx.pred(spark, d), ["b0", "b1", "b2"])


@_query(
    """select s.x, s.y, s.block, s.seg, case when s.seg%13=7 or (s.b0=0 and s.b1=0 and s.b2=0) then (case when s.b1=0 and s.b2=0 then 0 when s.seg%13=7 then 0 else p.cls end) else coalesce(p.cls,0) end cls
  from scene s left join pred p on s.block=p.block and s.seg=p.seg""",
    "pred",
)
def paint_without_predictions(spark, d):
    """Segments whose first band is empty have no features and no prediction: their pixels are kept, with class 0."""
    pixels = fx.scene(spark, d).withColumn("b0", F.when(F.col("seg") % 13 == 7, 0).otherwise(F.col("b0")))
    return classify.paint(pixels, fx.pred(spark, d).where("seg % 13 <> 7"), ["b0", "b1", "b2"])


@_query("select x, y, block, seg, cls from painted", "painted")
def paint_runs(spark, d):
    """The class raster by runs of segments, painted and then drawn out to pixels."""
    return classify.run_pixels(classify.paint_runs(segments.runs(fx.scene(spark, d), ["b0", "b1", "b2"]), fx.pred(spark, d)))


_COUNTS = ", ".join(f"count(*) filter (cls={k}) n{k}" for k in range(1, 6))
@_query(f"select block, {_COUNTS} from painted group by block", "painted")
def class_counts_runs(spark, d):
    return classify.run_counts(classify.paint_runs(segments.runs(fx.scene(spark, d), ["b0", "b1", "b2"]), fx.pred(spark, d)), ["block"])


@_query(
    "select block, seg, x, min(y) as first, max(y) as last, empty from (select *, y-row_number() over (partition by block, seg, empty, x order by y) run from (select block, seg, x, y, b0=0 and b1=0 and b2=0 as empty from scene)) group by block, seg, x, empty, run",
    "scene",
)
def segment_runs(spark, d):
    return segments.runs(fx.scene(spark, d), ["b0", "b1", "b2"])


_AREA = "(n1+n2+n3+n4+n5+1)"


@_query(f"select block, {_COUNTS} from painted group by block", "painted")
def class_counts_block(spark, d):
    return classify.class_counts(fx.painted(spark, d), ["block"])


@_query(f"select n1, n2, n3, n4, n5, {', '.join(f'round(n{k}/{_AREA},6) p{k}' for k in range(1, 6))} from (select {_COUNTS} from painted)", "painted")
def class_percent_image(spark, d):
    """The flagship: classes painted, counted by block, added up by image, and their shares."""
    return classify.class_percent(classify.class_counts(fx.painted(spark, d), ["block"]), [])


@_query(
    f"select image, n1, n2, n3, n4, n5, {', '.join(f'round(n{k}/{_AREA},6) p{k}' for k in range(1, 6))} from (select cast(x//48 as integer) image, {_COUNTS} from (select x, case when b1<50 then 4 when b1<100 then 3 when b1<150 then 2 when b1<200 then 1 else 5 end cls from li) group by 1)",
    "li",
)
def class_percent_strips(spark, d):
    cls = F.when(F.col("b1") < 50, 4).when(F.col("b1") < 100, 3).when(F.col("b1") < 150, 2).when(F.col("b1") < 200, 1).otherwise(5)
    painted = fx.li(spark, d).select(F.floor(F.col("x") / 48).cast("int").alias("image"), cls.alias("cls"))
    return classify.class_percent(classify.class_counts(painted, ["image"]), ["image"])


@_query(
    f"""select block as image_id, quality as "Quality Score", n1 as "White Ice", n2 as "Gray Ice", n3 as "Melt Ponds", n4 as "Open Water", n5 as "Shadow"
  from (select block, {_COUNTS} from painted group by block) join (select image_id, least(min(score),1.0) quality from qscores group by image_id) on image_id=block""",
    "painted", "qscores",
)
def report_image(spark, d):
    counts = classify.class_counts(fx.painted(spark, d).withColumnRenamed("block", "image_id"), ["image_id"])
    return classify.report(counts, classify.quality_min(fx.qscores(spark, d)), ["image_id"])


_STATS_ROW = "n1+n2+n3+n4+n5+1 area, round(n1/(n1+n2+n3+n4+n5+1),6) snow, round(n2/(n1+n2+n3+n4+n5+1),6) gray, round(n3/(n1+n2+n3+n4+n5+1),6) melt, round(n4/(n1+n2+n3+n4+n5+1),6) water"


@_query(
    f"""select cast(block as varchar) as name, {_STATS_ROW} from (select block, {_COUNTS} from painted group by block) where block%2=0
  union all select cast(block as varchar), 1, 0, 0, 0, 0 from (select distinct block from painted) where block%2<>0""",
    "painted",
)
def scene_stats_upsert(spark, d):
    """Statistics of all scenes, at first none, with those of every second one put in place."""
    counts = classify.class_counts(fx.painted(spark, d).withColumn("name", F.col("block").cast("string")), ["name"])
    none = counts.select("name", F.lit(1).cast("long").alias("area"), *(F.lit(0.0).alias(c) for c in ("snow", "gray", "melt", "water")))
    return _rounded(sinks.upsert_scene_stats(none, counts.where("cast(name as int) % 2 = 0")))


@_query("select event_id, case when value/1000>0.9 and value/1000<0.96 then 4.0 when value/1000<0.9 then 10.0 else 0.5 end as seconds from events")
def review_tiers(spark, d):
    return fx.table(spark, d, "events").select("event_id", classify.review_seconds(F.col("value") / 1000).alias("seconds"))


@_query("select image_id, least(min(score),1.0) quality from qscores group by image_id", "qscores")
def quality_min_per_image(spark, d):
    return classify.quality_min(fx.qscores(spark, d))


@_query("select image_id, min(own) over (order by image_id) quality from (select image_id, least(min(score),1.0) own from qscores group by image_id)", "qscores")
def quality_running_min(spark, d):
    return classify.quality_running(fx.qscores(spark, d))


@_query()
def quality_fft(spark, d):
    return kernels.block_quality(fx.scene(spark, d))


_CLASS_ROWS = "(values (0,'empty',0.1,0.1,0.1),(1,'snow',0.9,0.9,0.9),(2,'gray',0.5,0.5,0.5),(3,'melt',0.31,0.431,0.647),(4,'water',0.31,0.431,0.647),(5,'shadow',0.0,0.0,0.0),(6,'unknown',0.27,0.15,0.5)) c(cls,name,red,green,blue)"


@_query(f"select x, y, name, cast(red as double) red, cast(green as double) green, cast(blue as double) blue from painted p join {_CLASS_ROWS} on p.cls=c.cls", "painted")
def colour_map(spark, d):
    return fx.painted(spark, d).join(F.broadcast(classes(spark)), "cls").select("x", "y", "name", "red", "green", "blue")


@_query("select quality as predicted, toxic as true, count(*) n, round(count(*)/sum(count(*)) over (partition by toxic),6) share from labels group by 1, 2")
def confusion_matrix(spark, d):
    return classify.confusion(fx.table(spark, d, "labels"), "quality", "toxic")


# files, names and dates


_EXT = "lower(regexp_extract(name, '(\\.[^.]*)$', 1))"


@_query(f"select name, dir, {_EXT} ext from files where not starts_with(name,'.') and {_EXT} in ('.tif','.tiff','.jpg')", "files")
def scan_filter_files(spark, d):
    return fx.files(spark, d).where(names.is_image(F.col("name"))).select("name", "dir", names.extension(F.col("name")).alias("ext"))


@_query(f"select distinct name from files where not starts_with(name,'.') and (contains({_EXT},'.tif') or contains({_EXT},'.jpg'))", "files")
def scan_union_distinct(spark, d):
    return images.scan_union(fx.files(spark, d), [".tif", ".jpg"])


@_query("select distinct name from files where not starts_with(name,'.') and (contains(lower(name),'g_1') or contains(lower(name),'.h'))", "files")
def scan_union_loose(spark, d):
    """Keywords anywhere in a name, not in its extension alone."""
    return images.scan_union(fx.files(spark, d), ["g_1", ".h"], strict=False)


_BASE = "regexp_replace(name, '\\.[^.]*$', '')"


@_query(
    f"select name as image_id, dir as src_dir, concat(dir,'/classified') dst_dir from files f where not starts_with(name,'.') and {_EXT} in ('.tif','.tiff','.jpg') and not exists (select 1 from (select concat('img_',p_partkey,'_classified.tif') as out_name from part where p_partkey%4=0) o where o.out_name=concat({_BASE},'_classified.tif'))",
    "files",
)
def pending_tasks(spark, d):
    key = F.col("p_partkey")
    done = fx.table(spark, d, "part").where(key % 4 == 0).select(F.concat(F.lit("img_"), key.cast("string"), F.lit("_classified.tif")).alias("name"))
    return images.pending(images.image_tasks(fx.files(spark, d)), done).select("image_id", "src_dir", "dst_dir")


@_query(f"select name, concat({_BASE},'_classified.tif') raster, concat({_BASE},'_md.csv') report, concat({_BASE},'_u08rf3413_pansh.tif') pansharpened from files", "files")
def output_names(spark, d):
    return fx.files(spark, d).select("name", *(c.alias(k) for k, c in names.output_names(F.col("name")).items()))


_SRGB_DAY = "coalesce(dayofyear(try_cast(concat('2014-',substring(exif,6,2),'-',substring(exif,9,2)) as date)),152)"
_NITF_DAY = "coalesce(dayofyear(try_cast(concat(substring(nitf,1,4),'-',substring(nitf,5,2),'-',substring(nitf,7,2)) as date)),152)"


@_query(f"select image_id, cast({_SRGB_DAY} as integer) srgb_day, cast({_NITF_DAY} as integer) nitf_day from shots", "shots")
def metadata_doy(spark, d):
    day = lambda sensor: names.day_of_year(F.col("exif"), F.col("nitf"), sensor)
    return fx.shots(spark, d).select("image_id", day("srgb").alias("srgb_day"), day("pan").alias("nitf_day"))


@_query(f"select image_id, case when {_SRGB_DAY}<=150 then 'spring' else 'summer' end season from shots", "shots")
def season_label(spark, d):
    return fx.shots(spark, d).select("image_id", names.season(names.day_of_year(F.col("exif"), F.col("nitf"), "srgb")).alias("season"))


# training


@_query("select t.pos, t.label_set, t.label, round(cast(e.embedding[1] as double),6) f0 from tds t join embeddings e on e.vec_id=t.pos", "tds")
def tds_zip_truncate(spark, d):
    features = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.round(F.col("embedding")[0].cast("double"), 6).alias("f0"))
    return training.zip_labels(features, fx.tds(spark, d)).select("pos", "label_set", "label", "f0")


@_query("select pos, label_set, label from tds where label not in (0,6) and (label<>5 or label_set='spring')", "tds")
def tds_label_filter(spark, d):
    return training.usable_labels(fx.tds(spark, d))


@_query("select pos, label_set, label from tds where label not in (0,6)", "tds")
def tds_label_filter_ms(spark, d):
    """Scenes of eight bands keep shadows in every set."""
    return training.usable_labels(fx.tds(spark, d), sensor="wv02_ms")


@_query(
    """select label_set, sensor, case when sensor='srgb' and label_set<>'srgb' then concat(label_set,'_labels') else label_set end labels, case when sensor='srgb' and label_set<>'srgb' then concat(label_set,'_feature_matrix') else 'feature_matrix' end features, count(*) n
  from tds, (values ('srgb'),('wv02_ms'),('pan')) t(sensor) group by 1, 2""",
    "tds",
)
def training_names(spark, d):
    """What a stored training set's labels and features are called, by its list and sensor."""
    each = fx.tds(spark, d).select("label_set", F.explode(F.array(*map(F.lit, SENSORS))).alias("sensor")).groupBy("label_set", "sensor").agg(F.count("*").alias("n"))
    return each.select("label_set", "sensor", *(c.alias(k) for k, c in names.training_names(F.col("label_set"), F.col("sensor")).items()), "n")


@_query("select pos, label_set, label from tds where pos%5<>0 union all select pos, label_set, 4 from tds where pos%5=0", "tds")
def tds_upsert(spark, d):
    rows = fx.tds(spark, d)
    return training.upsert(rows, rows.where("pos % 5 = 0").withColumn("label", F.lit(4)), ["pos"])


_USABLE = "label not in (0,6) and (label<>5 or label_set='spring')"


@_query(f"select pos, label_set, label from tds where label_set='summer' and {_USABLE}", "tds")
def training_set_own(spark, d):
    return training.training_rows(fx.tds(spark, d), "summer", "srgb")


@_query("select pos, 'srgb' label_set, label from tds where label_set='spring' and label not in (0,6) and label<>5", "tds")
def training_set_fallback(spark, d):
    """There is no set of the name, so the sensor's own is taken."""
    rows = fx.tds(spark, d).withColumn("label_set", F.when(F.col("label_set") == "spring", "srgb").otherwise("summer"))
    return training.training_rows(rows, "autumn", "srgb")


@_query("select label_set, count(label) n from tds group by label_set having count(label)>=10", "tds")
def retrain_ready(spark, d):
    return training.ready_sets(fx.tds(spark, d))


@_query("select concat('img_',n_nationkey) image, arg_max(concat(dir,'/',name), place) path from nation, (select *, row_number() over (order by dir, name) place from files) f where contains(concat(dir,'/',name), concat('img_',n_nationkey)) group by 1", "files")
def last_matching_image(spark, d):
    listed = fx.files(spark, d).select(F.concat("dir", F.lit("/"), "name").alias("path"), F.struct("dir", "name").alias("place"))
    wanted = fx.table(spark, d, "nation").select(F.concat(F.lit("img_"), "n_nationkey").alias("image"))
    return training.last_match(wanted, listed)


@_query()
def feature_importances(spark, d):
    _, labelled = _forest_rows(spark, d)
    return classify.importances(labelled.select("label", *(F.col("features")[k].alias(f"f{k}") for k in range(64))), [f"f{k}" for k in range(64)], trees=30, depth=8)


@_query()
def forest_oob(spark, d):
    """A bagged forest judged by the trees that did not see a row."""
    _, labelled = _forest_rows(spark, d)
    return bagging.oob_score(bagging.fit_bagged(labelled, "pos", "features", trees=8, depth=6), labelled)


@_query()
def holdout_accuracy(spark, d):
    _, labelled = _forest_rows(spark, d)
    return classify.hold_out(labelled, "pos", "features", trees=30, depth=8)


def _forest_rows(spark, d):
    rows = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("features"))
    return rows, training.zip_labels(rows, training.usable_labels(fx.tds(spark, d)))


@_query()
def rf_predict(spark, d):
    rows, labelled = _forest_rows(spark, d)
    return classify.predict(classify.fit_forest(labelled, "features", trees=30, depth=8), rows, "features").select("pos", "cls")


@_query()
def rf_confidence_tier(spark, d):
    rows, labelled = _forest_rows(spark, d)
    out = classify.predict(classify.fit_forest(labelled, "features", trees=30, depth=8), rows, "features")
    return out.select("pos", "confidence", classify.review_seconds(F.col("confidence")).alias("seconds"))


@_query(
    """select block, seg, cast(draw as integer) draw from (select block, seg, count(*) n, min((cast(x as bigint)*7919+cast(y as bigint)*104729)%65537) draw from scene group by block, seg)
  where n>=20 and not (seg%3=0) order by draw, block, seg limit 10""",
    "scene",
)
def sample_segments(spark, d):
    pixels = fx.scene(spark, d)
    return training.sample_segments(pixels, pixels.where("seg % 3 = 0").select("block", "seg").distinct())


@_query("select pos, label_set, label from tds where label is null order by pos limit 1", "tds")
def unlabelled_next(spark, d):
    return training.next_unlabelled(fx.tds(spark, d))


@_query("select label_set as image, min(pos) first_pos, count(*) n from tds group by 1", "tds")
def unique_images(spark, d):
    return training.images_by_first_row(fx.tds(spark, d).withColumnRenamed("label_set", "image"), "image")


@_query("select dir as image, coalesce(lead(dir) over (order by dir), (select min(dir) from files)) next_image from (select distinct dir from files)", "files")
def next_image(spark, d):
    return training.next_image(fx.files(spark, d).select(F.col("dir").alias("image")).distinct(), "image")


@_query("select block, seg, case when seg%4=0 and seg%7<=5 then cast(seg%7 as integer) else cls end label from pred", "pred")
def accept_overrides(spark, d):
    given = fx.pred(spark, d).where("seg % 4 = 0").select("block", "seg", (F.col("seg") % 7).alias("label"))
    return training.accept(fx.pred(spark, d), given, ["block", "seg"]).select("block", "seg", "label")


# stencils and kernels


@_query(
    """select block, x, y, cast(3*lag(d) over a+10*d+3*lead(d) over a as integer) gx, cast(lead(s) over a-lag(s) over a as integer) gy
  from (select block, x, y, lead(b1) over b-lag(b1) over b d, 3*lag(b1) over b+10*b1+3*lead(b1) over b s from scene window b as (partition by block, y order by x))
  window a as (partition by block, x order by y) qualify gx is not null and gy is not null""",
    "scene",
)
def scharr_gradient(spark, d):
    return stencils.scharr(fx.scene(spark, d), "b1")


@_query(
    """select block, x, y, b1 as value from (select *, max(m) over (partition by block, x order by y rows between 2 preceding and 2 following) mm
  from (select *, max(b1) over (partition by block, y order by x rows between 2 preceding and 2 following) m from scene)) where b1=mm and b1>0""",
    "scene",
)
def local_maxima(spark, d):
    return stencils.local_maxima(fx.scene(spark, d), "b1", 2)


_DISK = ",".join(f"({dx},{dy})" for dx, dy in stencils.DISK2)
_MORPH = "painted"
for _agg in ("min", "max", "max", "min"):
    _MORPH = f"(select p.block, p.x, p.y, {_agg}(q.cls) cls from painted p, (values {_DISK}) t(dx,dy), {_MORPH} q where q.block=p.block and q.x=p.x+dx and q.y=p.y+dy group by p.block, p.x, p.y)"


@_query(f"select * from {_MORPH}", "painted")
def morph_open_close(spark, d):
    return stencils.open_close(fx.painted(spark, d), "cls")


@_query()
def components(spark, d):
    pixels = fx.scene(spark, d)
    return kernels.per_pixel(pixels, ["b1"], lambda a: kernels.components(a[0] > 150), "component", "int").where("component > 0")


_SQL["components"] = fx.sql(
    """, m as (select block, x, y from scene where b1>150), walk(block, x, y, root) as (
    select block, x, y, x*22+y from m union
    select m.block, m.x, m.y, w.root from walk w join m on m.block=w.block and abs(m.x-w.x)+abs(m.y-w.y)=1 where w.root < m.x*22+m.y)
  select block, x, y, cast(dense_rank() over (partition by block order by root) as integer) component from (select block, x, y, min(root) root from walk group by block, x, y)""",
    "scene",
).replace("with ", "with recursive ", 1)


@_query()
def canny(spark, d):
    s = SENSORS["srgb"]
    return kernels.per_pixel(fx.scene(spark, d), ["b1"], lambda a: kernels.edges(a[0], s.sigma, s.low, s.high).astype(int), "edge", "int")


@_query(
    "select p.block, p.x, p.y, round(sqrt(min((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y))),6) distance from scene p join scene q on p.block=q.block and q.b1>150 group by p.block, p.x, p.y", "scene"
)
def edt(spark, d):
    return _rounded(kernels.per_pixel(fx.scene(spark, d), ["b1"], lambda a: kernels.distance_to(a[0] > 150), "distance", "double"))


def _one_scene(spark, d):
    """The whole raster as one scene, whatever its size, beside its blocks."""
    return fx.scene(spark, d).select(F.lit(0).alias("scene"), "x", "y", "b0", "b1", "b2", F.when(F.col("b1") > 150, 1).otherwise(0).alias("bright"))


_BLURRED = "select s.x, s.y, sum(g * t.v) v from {0} s, n, w, {0} t where t.{2}=s.{2} and t.{1}=case when s.{1}+k<0 then -s.{1}-k-1 when s.{1}+k>=n{1} then 2*n{1}-1-s.{1}-k else s.{1}+k end group by s.x, s.y"


@_query()
def gradient_scene(spark, d):
    """In blocks of 64 with halos, while the SQL takes the scene at once."""
    return scene.gradient_scene(_one_scene(spark, d), ["scene"], "b2", SENSORS["srgb"].sigma, size=64).select("x", "y", "gradient")


_SQL["gradient_scene"] = fx.sql(
    f""", p as (select x, y, b2 as v from scene), n as (select max(x)+1 nx, max(y)+1 ny from p),
  w as (select k, exp(-0.125*k*k)/(select sum(exp(-0.125*j*j)) from (select unnest(range(-8,9)) j)) g from (select unnest(range(-8,9)) k)),
  down as ({_BLURRED.format('p', 'x', 'y')}), blurred as ({_BLURRED.format('down', 'y', 'x')}),
  beside as (select *, 0.1875*(lag(v) over a+lead(v) over a)+0.625*v sx, 0.1875*(lag(v) over b+lead(v) over b)+0.625*v sy from blurred window a as (partition by x order by y), b as (partition by y order by x)),
  g as (select x, y, cast(floor(least(255, sqrt((power((lead(sx) over b-lag(sx) over b)/2,2)+power((lead(sy) over a-lag(sy) over a)/2,2))/2))) as integer) gradient from beside window a as (partition by x order by y), b as (partition by y order by x))
  select p.x, p.y, g.gradient from p, n, g where g.x=greatest(1,least(p.x,nx-2)) and g.y=greatest(1,least(p.y,ny-2))""",
    "scene",
)


@_query(
    "select x, y from (select *, max(m) over (partition by x order by y rows between 3 preceding and 3 following) mm from (select x, y, b1, max(b1) over (partition by y order by x rows between 3 preceding and 3 following) m from scene)) where b1=mm and b1>0",
    "scene",
)
def maxima_scene(spark, d):
    return scene.maxima_scene(_one_scene(spark, d), ["scene"], "b1", 3, size=50).where("maximum = 1").select("x", "y")


@_query()
def components_scene(spark, d):
    """Components that go on across the borders of blocks of 16, named by their first pixels."""
    return scene.components_scene(_one_scene(spark, d), ["scene"], "bright", size=16).where("component >= 0").select("x", "y", "component")


_SQL["components_scene"] = fx.sql(
    """, m as (select x, y from scene where b1>150), walk(x, y, root) as (
    select x, y, x*22+y from m union
    select m.x, m.y, w.root from walk w join m on abs(m.x-w.x)+abs(m.y-w.y)=1 where w.root < m.x*22+m.y)
  select x, y, cast(min(root) as bigint) component from walk group by x, y""",
    "scene",
).replace("with ", "with recursive ", 1)


@_query("select p.x, p.y, round(sqrt(min((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y))),6) distance from scene p join scene q on q.b1>150 group by p.x, p.y", "scene")
def edt_scene(spark, d):
    return _rounded(scene.distance_scene(_one_scene(spark, d), ["scene"], "bright").select("x", "y", "distance"))


@_query()
def canny_scene(spark, d):
    s = SENSORS["srgb"]
    return scene.edges_scene(_one_scene(spark, d), ["scene"], "b1", s.sigma, s.low, s.high, size=64).select("x", "y", "edge")


@_query()
def segments_scene(spark, d):
    """Watersheds from markers of the whole scene, so segments go on across blocks."""
    return scene.segments_scene(_one_scene(spark, d), ["scene"], ["b0", "b1", "b2"], size=128, halo=32).select("x", "y", "seg")


def _images(whole):
    """A scene as images of 100 rows, with a day of the year for each."""
    pixels = whole.select(F.format_string("scene_%03d", "block").alias("image_id"), (F.col("x") % 100).alias("x"), "y", "b0", "b1", "b2")
    days = pixels.select("image_id").distinct().withColumn("day", F.when(F.substring("image_id", -1, 1).cast("int") % 2 == 0, 120).otherwise(200))
    return pixels, days


#: Cuts of images (g: block * 3 + band), from their histograms to what all bands share.
_CUTS = f""", dns as (select block*3+band g, dn from ({_LONG})), counts as (select g, dn, count(*) n from dns group by g, dn),
  hist as (select e.g, e.dn, e.dn-lo i, coalesce(n, 0) h from (select g, lo, unnest(range(lo, hi)) dn from (select g, min(dn) lo, max(dn) hi from counts group by g)) e left join counts c on c.g=e.g and c.dn=e.dn),
  candidates as (select g, cast(dn as bigint) dn, cast(h as bigint) h from (
    select *, lag(h) over w p1, lead(h) over w n1, lag(h,5) over w p5, lead(h,5) over w n5, count(*) over p n, floor(sum(h) over p*0.004) least,
      first_value(h) over w h_first, last_value(h) over (partition by g order by i rows between current row and unbounded following) h_last from hist window w as (partition by g order by i), p as (partition by g))
    where case when i=0 then h>=n1 and h>=n5 and h_last>least when i=n-1 then h>=p1 and h>=p5 and h>least
      else h>=p1 and h>=n1 and h>=coalesce(p5,h_first) and h>=coalesce(n5,h_last) and h>least end),
  {_THINNED},
  ends as (select g, min(p.dn) lo, max(p.dn) hi, count(*) n from peaks group by g),
  found as (select g, n, lo, hi, least(coalesce(min(dn) filter (dn>=hi and (dn-hi)%2=0 and h<=0.15*hh), max(dn)), max(dn)) white, coalesce(max(dn) filter (dn<=lo and h<=0.5*hl), min(dn)) black
    from (select h.*, e.lo, e.hi, e.n, max(h) filter (dn=lo) over w hl, max(h) filter (dn=hi) over w hh from hist h join ends e on e.g=h.g window w as (partition by h.g)) group by g, n, lo, hi),
  bands as (select q.g//3 block, q.g%3 band, case when (lo-black)/255.0>=0.03 or hi-lo<85.0 then least(black, 20) else black end low, white, black, coalesce(n, 0) n from (select distinct g from counts) q left join found f on f.g=q.g),
  images as (select block, min(low) low, case when sum(n)<=count(*) then greatest(max(white), 204) else max(white) end high, max(white) largest from bands group by block),
  params as (select block, case when ok then low else 1 end as lower, case when ok then high else 255 end as upper, largest from (select *, coalesce(least(low, 2048)<high, false) ok from images))"""


@_query()
def stretch_hist_image(spark, d):
    pixels, _ = _images(fx.scene(spark, d))
    return radiometry.stretch_from_histogram(radiometry.unpivot_bands(pixels, ["image_id"], ["b0", "b1", "b2"]), ["image_id"]).select("image_id", "lower", "upper", F.posexplode("white").alias("band", "white"), "black").select(
        "image_id", "band", "lower", "upper", "white", F.get("black", "band").alias("black")
    )


_SQL["stretch_hist_image"] = _recursive(fx.sql(
    f"""{_CUTS} select printf('scene_%03d', p.block) image_id, cast(band as integer) band, cast(p.lower as bigint) as lower, cast(p.upper as bigint) as upper, cast(coalesce(white, largest, p.upper) as double) white, cast(coalesce(black, p.lower) as double) black
  from params p join bands b on b.block=p.block""",
    "scene",
))


@_query()
def corrected_pixels(spark, d):
    """Pixels stretched by the cuts of their image's histograms, and balanced by its bands' references."""
    pixels, _ = _images(fx.scene(spark, d))
    params = run.stretch_params(pixels, run.Options())
    return radiometry.corrected(pixels, params, ["image_id"], ["b0", "b1", "b2"], True).select("image_id", "x", "y", "b0", "b1", "b2")


def _corrected_sql(k: int) -> str:
    v = f"floor((least(greatest(b{k}, p.lower), p.upper)-p.lower)*254/(p.upper-p.lower))+1"
    return f"cast(case when b{k}=0 then 0 else greatest(1, least(255, floor(greatest(w[1], w[2], w[3])/w[{k + 1}]*({v.replace(')*254/(', ')*254//(')})))) end as integer) b{k}"


_SQL["corrected_pixels"] = _recursive(fx.sql(
    f"""{_CUTS}, refs as (select p.block, list(cast(coalesce(white, largest, p.upper) as double) order by band) w from params p join bands b on b.block=p.block group by p.block)
  select printf('scene_%03d', s.block) image_id, cast(x%100 as integer) x, y, {', '.join(map(_corrected_sql, range(3)))} from scene s join params p on p.block=s.block join refs r on r.block=s.block""",
    "scene",
))


@_query()
def batch_run_report(spark, d):
    """A whole run: from pixels to the report of each image. Training rows are made of the features and a rule, as there are no labelled scenes."""
    whole = staged(fx.scene(spark, d), "scene")  # read by every step up to segmentation
    pixels, days = _images(whole)
    rows = segments.features_srgb(whole, HEIGHT, WIDTH, around=kernels.neighbour_counts(whole, height=HEIGHT)).join(fx.pred_of(whole), ["block", "seg"])
    rows = rows.select(F.when(F.col("seg") % 2 == 0, "spring").otherwise("summer").alias("label_set"), (F.col("block") * 1000 + F.col("seg")).cast("long").alias("pos"), F.col("cls").alias("label"), F.array(*(F.coalesce(F.col(f"f{k}"), F.lit(0.0)) for k in range(16))).alias("features"))
    return run.classify_scenes(pixels, days, rows, run.Options(block=64, trees=20, depth=6)).report


@_query()
def watershed(spark, d):
    return kernels.segment_blocks(fx.scene(spark, d), ["b0", "b1", "b2"])
