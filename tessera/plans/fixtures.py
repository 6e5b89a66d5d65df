"""Rasters and training rows derived from the driver's tables, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dn(value) -> object:
    scaled = F.floor((value.cast("double") + F.lit(0.6)) * F.lit(212.0))
    return F.greatest(F.lit(0), F.least(F.lit(255), scaled)).cast("int")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long pixels (x: row, y: column, b: band, dn) of a 3-band raster with gaps without data: 21 columns, and one more that has the first band alone."""
    last = F.col("i") == 63
    cell = _cells(spark, sf_dir).withColumns({"y": F.when(last, 21).otherwise(F.col("i") % 21), "b": F.when(last, 0).otherwise(F.floor(F.col("i") / 21)).cast("int")})
    gap = ((F.col("vec_id") * 7 + F.col("y") * 13) % 23 == 0) | ((F.col("b") == 0) & ((F.col("vec_id") * 5 + F.col("y") * 3) % 29 == 0))
    return cell.select(F.col("vec_id").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "b", F.when(gap, 0).otherwise(_dn(F.col("v"))).alias("dn"))


def _wide(long: DataFrame, bands: int, segments_wide: int) -> DataFrame:
    bands_of = [F.coalesce(F.max(F.when(F.col("b") == k, F.col("dn"))), F.lit(0)).alias(f"b{k}") for k in range(bands)]
    seg = F.floor((F.col("x") % 100) / 10) * segments_wide + F.floor(F.col("y") / 4)
    return long.groupBy("x", "y").agg(*bands_of).withColumns({"block": F.floor(F.col("x") / 100).cast("int"), "seg": seg.cast("int")})


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide 3-band raster in blocks of 100 rows, each of 60 segments. A scan, a map and one shuffle on the pixel."""
    return _wide(px(spark, sf_dir), 3, 6)


def ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide 8-band raster, 8 columns wide, in blocks of 100 rows, each of 20 segments."""
    cell = _cells(spark, sf_dir)
    long = cell.select(F.col("vec_id").cast("int").alias("x"), (F.col("i") % 8).cast("int").alias("y"), F.floor(F.col("i") / 8).cast("int").alias("b"), _dn(F.col("v")).alias("dn"))
    return _wide(long, 8, 2)


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse 480 x 400 raster of order lines."""
    key = [(F.col("l_partkey") % 480).cast("int").alias("x"), (F.col("l_orderkey") % 400).cast("int").alias("y")]
    return table(spark, sf_dir, "lineitem").groupBy(*key).agg(
        (F.sum(F.col("l_quantity").cast("long")) % 256).cast("int").alias("b0"),
        (F.sum(F.col("l_linenumber") * 31) % 256).cast("int").alias("b1"),
        (F.count("*") * 37 % 256).cast("int").alias("b2"),
    )


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, bit depths and numbers of bands of scenes, one for each order."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("image_id"), (F.col("o_custkey") * 37 % 24000 + 5000).cast("int").alias("x_dim"), (key * 53 % 21000 + 5500).cast("int").alias("y_dim"), (key % 9 + 8).cast("int").alias("src_dtype"), (F.col("o_custkey") % 8 + 1).cast("int").alias("bands"),
    )


def tds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: position, label set and label (null: not labelled yet)."""
    label = F.when(F.col("vec_id") % 10 < 9, (F.col("label") % 7).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.when(F.col("vec_id") % 2 == 0, "spring").otherwise("summer").alias("label_set"), label.alias("label"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names as a directory listing would show them."""
    key = F.col("p_partkey")
    ext = F.element_at(F.array(*map(F.lit, (".tif", ".TIFF", ".jpg", ".png", ".h5", ".JPG"))), (key % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat(F.when(key % 11 == 0, ".").otherwise(""), F.lit("img_"), key.cast("string"), ext).alias("name"), F.col("p_brand").alias("dir"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene metadata: a date in either of two spellings, or none."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        key.alias("image_id"), F.when(key % 13 != 0, F.date_format(day, "yyyy:MM:dd HH:mm:ss")).alias("exif"), F.when(key % 17 != 0, F.date_format(day, "yyyyMMddHHmmss")).alias("nitf")
    )


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pred_of(scene(spark, sf_dir))


def pred_of(pixels: DataFrame) -> DataFrame:
    """A class for each segment of a scene, by a rule on the mean of band 1."""
    total, n = F.sum("b1"), F.count("*")
    cls = F.when(total < 118 * n, 4).when(total < 124 * n, 3).when(total < 128 * n, 2).when(total < 134 * n, 1).otherwise(5)
    return pixels.where("b0 <> 0").groupBy("block", "seg").agg(cls.alias("cls"))


def painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class raster (x, y, block, seg, cls): 0 where all bands are."""
    empty = (F.col("b0") == 0) & (F.col("b1") == 0) & (F.col("b2") == 0)
    found = scene(spark, sf_dir).join(pred(spark, sf_dir), ["block", "seg"], "left")
    return found.select("x", "y", "block", "seg", F.when(empty, 0).otherwise(F.coalesce("cls", F.lit(0))).alias("cls"))


def qscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("block_id"), (F.col("value") / 1000).alias("score"))


#: The same relations for DuckDB; each may use those before it.
SQL = {
    "px": """select cast(vec_id as integer) x, cast(y as integer) y, cast(b as integer) b,
  case when (vec_id*7+y*13)%23=0 then 0 when b=0 and (vec_id*5+y*3)%29=0 then 0 else cast(greatest(0,least(255,floor((cast(v as double)+0.6)*212))) as integer) end dn
  from (select vec_id, v, case when i=63 then 21 else i%21 end y, case when i=63 then 0 else i//21 end b from (select vec_id, unnest(range(64)) i, unnest(embedding) v from embeddings))""",
    "scene": """select x,y,coalesce(max(dn) filter (b=0),0) b0,coalesce(max(dn) filter (b=1),0) b1,coalesce(max(dn) filter (b=2),0) b2,cast(x//100 as integer) block,cast(((x%100)//10)*6+y//4 as integer) seg from px group by x,y""",
    "ms": "select x,y," + ",".join(f"max(dn) filter (b={k}) b{k}" for k in range(8)) + """,cast(x//100 as integer) block,cast(((x%100)//10)*2+y//4 as integer) seg
  from (select cast(vec_id as integer) x, cast(i%8 as integer) y, cast(i//8 as integer) b, cast(greatest(0,least(255,floor((cast(v as double)+0.6)*212))) as integer) dn
  from (select vec_id, unnest(range(64)) i, unnest(embedding) v from embeddings)) group by x,y""",
    "li": "select cast(l_partkey%480 as integer) x, cast(l_orderkey%400 as integer) y, cast(sum(cast(l_quantity as bigint))%256 as integer) b0, cast(sum(l_linenumber*31)%256 as integer) b1, cast(count(*)*37%256 as integer) b2 from lineitem group by 1,2",
    "dims": "select o_orderkey image_id, cast(o_custkey*37%24000+5000 as integer) x_dim, cast(o_orderkey*53%21000+5500 as integer) y_dim, cast(o_orderkey%9+8 as integer) src_dtype, cast(o_custkey%8+1 as integer) bands from orders",
    "tds": "select vec_id pos, case when vec_id%2=0 then 'spring' else 'summer' end label_set, case when vec_id%10<9 then cast(label%7 as integer) end label from embeddings",
    "files": "select concat(case when p_partkey%11=0 then '.' else '' end,'img_',p_partkey,case p_partkey%6 when 0 then '.tif' when 1 then '.TIFF' when 2 then '.jpg' when 3 then '.png' when 4 then '.h5' else '.JPG' end) as name, p_brand as dir from part",
    "shots": "select o_orderkey image_id, case when o_orderkey%13=0 then null else strftime(o_orderdate,'%Y:%m:%d %H:%M:%S') end exif, case when o_orderkey%17=0 then null else strftime(o_orderdate,'%Y%m%d%H%M%S') end nitf from orders",
    "pred": "select block,seg, case when sum(b1)<118*count(*) then 4 when sum(b1)<124*count(*) then 3 when sum(b1)<128*count(*) then 2 when sum(b1)<134*count(*) then 1 else 5 end cls from scene where b0<>0 group by block,seg",
    "painted": "select s.x,s.y,s.block,s.seg, case when s.b0=0 and s.b1=0 and s.b2=0 then 0 else coalesce(p.cls,0) end cls from scene s left join pred p on s.block=p.block and s.seg=p.seg",
    "qscores": "select user_id image_id, event_id block_id, value/1000 score from events",
    "bins": """select cast(floor(value) as bigint) dn, count(*) n from events group by 1""",
    "hist": """select row_number() over (order by r.dn) - 1 i, r.dn, coalesce(b.n, 0) h from (select unnest(range((select min(dn) from bins), (select cast(floor(max(value)) as bigint) from events))) dn) r left join bins b on r.dn = b.dn""",
}
_NEEDS = {"scene": ("px",), "pred": ("px", "scene"), "painted": ("px", "scene", "pred"), "hist": ("bins",)}


def sql(query: str, *relations: str) -> str:
    """A DuckDB query with the relations it names, and what they need, defined before it."""
    needed = [n for r in relations for n in (*_NEEDS.get(r, ()), r)]
    names = dict.fromkeys(needed)
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in names) + "\n" + query if names else query
