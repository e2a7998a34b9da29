"""Registry of the queries and of the DuckDB statements that check them.

The adapters map the driver's tables to the entities of the operators: order keys are a loop range, parts are devices,
suppliers nodes, events hops and telemetry, documents named objects, and embeddings a raster (y = vec_id, x = position).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import table_functions
from tessera.operators import devices, kernels, network, ordering, tasks
from tessera.plans import chunks, scheduling, tiles
from tessera.sources import files, objects
from tessera.streaming import telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- chunks ------------------------------------------------------------------------------------------------------

NODES = 8
_B = "b as (select min(l_orderkey) lo, max(l_orderkey) hi from lineitem)"
_EQUAL = f"""with {_B}, c as (select cast(i as int) chunk_no, hi-lo planned_size, case when i=1 then lo else lo+((hi-lo)//8)*(i-1)+1 end low,
  case when i=8 then hi else lo+((hi-lo)//8)*i end up from b cross join (select unnest(range(1,9)) i))"""
_GUIDED = f"""with recursive {_B}, s(chunk_no, d, planned_size, low, up) as (
  select 1, (hi-lo)-greatest(ceil((hi-lo)/8.0)::bigint,1), ceil((hi-lo)/8.0)::bigint, lo, least(lo+greatest(ceil((hi-lo)/8.0)::bigint,1)-1, hi) from b
  union all select chunk_no+1, d-greatest(ceil(d/8.0)::bigint,1), ceil(d/8.0)::bigint, up+1, least(up+greatest(ceil(d/8.0)::bigint,1), hi) from s, b where up<hi),
  c as (select cast(chunk_no as int) chunk_no, planned_size, low, up from s)"""
_FACTORING = f"""with recursive {_B}, s(chunk_no, d, planned_size, low, up) as (
  select 1, hi-lo, greatest(ceil((hi-lo)/16.0)::bigint,1), lo, least(lo+greatest(ceil((hi-lo)/16.0)::bigint,1)-1, hi) from b
  union all select chunk_no+1, d2, greatest(ceil(d2/16.0)::bigint,1), up+1, least(up+greatest(ceil(d2/16.0)::bigint,1), hi)
    from (select *, case when chunk_no%8=0 then d-planned_size*8 else d end d2 from s), b where up<hi),
  c as (select cast(chunk_no as int) chunk_no, planned_size, low, up from s)"""
_TRAPEZOID = f"""with recursive {_B}, k as (select lo, hi, floor(0.0625*(hi-lo))::bigint f, floor(0.01*(hi-lo))::bigint l, hi-lo d from b),
  p as (select *, (f-l)//((2*d)//(f+l)-1) red from k), s(chunk_no, planned_size, low, up) as (
  select 1, f, lo, least(lo+f-1,hi) from p union all select chunk_no+1, planned_size-red, up+1, least(up+planned_size-red, hi) from s, p where up<hi),
  c as (select cast(chunk_no as int) chunk_no, planned_size, low, up from s)"""
_QUADRATIC = f"""with recursive {_B}, k as (select lo, hi, hi-lo d, (hi-lo)//16 f, greatest(floor(0.01*(hi-lo))::bigint,1) l from b),
  k2 as (select *, floor((f+l)/2.0)::bigint m from k), k3 as (select *, (6*d)//(4*m+l+f) n from k2),
  p as (select *, trunc((4*m-l-3*f)/n::double)::bigint bb, trunc((2*f+2*l-4*m)/(n*n)::double)::bigint cc from k3),
  s(chunk_no, planned_size, low, up) as (select 1, f, lo, least(lo+f-1,hi) from p
  union all select chunk_no+1, g, up+1, least(up+g,hi) from (select chunk_no, up, hi, greatest(f+bb*(chunk_no+1)+cc*(chunk_no+1)*(chunk_no+1),1) g from s, p where up<p.hi)),
  c as (select cast(chunk_no as int) chunk_no, planned_size, low, up from s)"""
_SUMS = """ select chunk_no, cast(planned_size as bigint) planned_size, cast(low as bigint) low, cast(up as bigint) up, cast(up-low+1 as bigint) n_elements,
  cast(count(l_orderkey) as bigint) n_rows, cast(sum(l_quantity) as double) total from c left join lineitem on l_orderkey between low and up group by all"""


def _chunked(strategy: str, reverse: bool = False, **parameters):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunks.aggregate(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", strategy, NODES, reverse, **parameters)

    return run


query(_EQUAL + _SUMS, "chunk_equal_agg")(_chunked("equal"))
query(_EQUAL + _SUMS, "chunk_ess")(_chunked("even"))
query(_GUIDED + _SUMS, "chunk_gss")(_chunked("guided"))
query(_FACTORING + _SUMS, "chunk_factoring")(_chunked("factoring"))
query(_TRAPEZOID + _SUMS, "chunk_tss")(_chunked("trapezoid"))
query(_QUADRATIC + _SUMS, "chunk_qss")(_chunked("quadratic"))
query(_EQUAL.replace("with b", "with b0", 1).replace("b0 as", "b as") + ", r as (select chunk_no, planned_size, (select lo+hi from b)-up low, (select lo+hi from b)-low up from c)" + _SUMS.replace("from c left", "from r left"), "chunk_reverse_equal")(_chunked("equal", reverse=True))
_MIRROR = ", r as (select chunk_no, planned_size, (select lo+hi from b)-up low, (select lo+hi from b)-low up from c)" + _SUMS.replace("from c left", "from r left")
for _name, _strategy, _sql in (("gss", "guided", _GUIDED), ("factoring", "factoring", _FACTORING), ("tss", "trapezoid", _TRAPEZOID), ("qss", "quadratic", _QUADRATIC)):
    query(_sql + _MIRROR, f"chunk_reverse_{_name}")(_chunked(_strategy, reverse=True))
query(f"with {_B} select cast(1 as int) chunk_no, cast(hi-lo as bigint) planned_size, cast(lo as bigint) low, cast(hi as bigint) up, cast(hi-lo+1 as bigint) n_elements, (select count(*) from lineitem) n_rows, (select sum(l_quantity) from lineitem) total from b", "chunk_single_node")(
    lambda spark, d: chunks.aggregate(read(spark, d, "lineitem"), "l_orderkey", "l_quantity", "guided", 1)
)


# loops over real numbers: order prices, with the unit gap between chunks
_RB = "b as (select min(o_totalprice) lo, max(o_totalprice) hi, max(o_totalprice)-min(o_totalprice) d0 from orders)"
_RC = "c as (select chunk_no, planned_size, low, least(up, hi) up from s, b)"
_REAL = {
    "equal": f"with {_RB}, c as (select i chunk_no, d0 planned_size, case when i=1 then lo else lo+(d0/8::double*(i-1)+1) end low, case when i=8 then hi else lo+d0/8::double*i end up from b, (select unnest(range(1,9)) i))",
    "guided": f"""with recursive {_RB}, s(chunk_no, d, planned_size, low, up) as (select 1, d0-greatest(ceil(d0/8::double),1), ceil(d0/8::double), lo, lo+greatest(ceil(d0/8::double),1)-1 from b
      union all select chunk_no+1, d-greatest(ceil(d/8::double),1), ceil(d/8::double), up+1, (up+1)+greatest(ceil(d/8::double),1)-1 from s, b where up<hi), {_RC}""",
    "factoring": f"""with recursive {_RB}, s(chunk_no, d, planned_size, low, up) as (select 1, d0, greatest(ceil(d0/16::double),1), lo, lo+greatest(ceil(d0/16::double),1)-1 from b
      union all select chunk_no+1, d2, greatest(ceil(d2/16::double),1), up+1, (up+1)+greatest(ceil(d2/16::double),1)-1 from (select *, case when chunk_no%8=0 then d-planned_size*8 else d end d2 from s), b where up<hi), {_RC}""",
    "trapezoid": f"""with recursive {_RB}, k as (select *, 0.0625::double*d0 f, 0.01::double*d0 l from b), p as (select *, (f-l)/(2*d0/(f+l)-1) step from k), s(chunk_no, planned_size, low, up) as (select 1, f, lo, lo+f-1 from p
      union all select chunk_no+1, planned_size-step, up+1, (up+1)+(planned_size-step)-1 from s, p where up<hi), {_RC}""",
    "quadratic": f"""with recursive {_RB}, k as (select *, d0/16::double f, greatest(0.01::double*d0,1) l from b), k2 as (select *, (f+l)/2::double m from k), k3 as (select *, 6*d0/(4*m+l+f) n from k2),
      p as (select *, (4*m-l-3*f)/n bb, (2*f+2*l-4*m)/(n*n) cc from k3), s(chunk_no, planned_size, low, up) as (select 1, f, lo, lo+f-1 from p
      union all select chunk_no+1, g, up+1, (up+1)+g-1 from (select chunk_no, up, p.hi, greatest(f+bb*(chunk_no+1)+cc*((chunk_no+1)*(chunk_no+1)),1) g from s, p where up<p.hi)), {_RC}""",
}
_REAL_ROWS = " select chunk_no::int chunk_no, planned_size+0::double planned_size, low, up, count(o_totalprice)::bigint n_rows, min(o_totalprice) least, max(o_totalprice) most from {0} left join orders on o_totalprice between low and up group by all"
for _name, _sql in _REAL.items():
    query(_sql + _REAL_ROWS.format("c"), f"chunk_double_{_name}")(lambda spark, d, n=_name: chunks.aggregate_real(read(spark, d, "orders"), "o_totalprice", n, NODES))
query(_REAL["guided"] + ", r as (select chunk_no, planned_size, (select lo+hi from b)-up low, (select lo+hi from b)-low up from c)" + _REAL_ROWS.format("r"), "chunk_double_reverse_guided")(
    lambda spark, d: chunks.aggregate_real(read(spark, d, "orders"), "o_totalprice", "guided", NODES, reverse=True)
)
query(
    f"with {_RB}, f as (select lo::float lo, hi::float hi, hi::float-lo::float d from b), c as (select i chunk_no, d planned_size, case when i=1 then lo else lo+(d/8::float*(i-1)::float+1::float) end low, "
    "case when i=8 then hi else lo+d/8::float*i::float end up from f, (select unnest(range(1,9)) i)) select chunk_no::int chunk_no, planned_size::double planned_size, low::double low, up::double up, count(o_totalprice)::bigint n_rows, "
    "min(o_totalprice) least, max(o_totalprice) most from c left join orders on o_totalprice between low::double and up::double group by all",
    "chunk_float_equal",
)(lambda spark, d: chunks.aggregate_real(read(spark, d, "orders"), "o_totalprice", "equal", NODES, single=True))


@query(
    "select strategy, bool_and(ok) non_increasing, count(*)::bigint n_chunks from (select *, coalesce(planned_size <= lag(planned_size) over (partition by strategy order by chunk_no), true) ok from ("
    + " union all ".join(f"select '{n}' strategy, chunk_no, planned_size from ({s} select * from c)" for n, s in (("equal", _EQUAL), ("guided", _GUIDED), ("factoring", _FACTORING), ("trapezoid", _TRAPEZOID), ("quadratic", _QUADRATIC)))
    + ")) group by strategy"
)
def chunk_monotone_check(spark, sf_dir):
    lo, hi = chunks.bounds(read(spark, sf_dir, "lineitem"), "l_orderkey")
    out = None
    for name in ("equal", "guided", "factoring", "trapezoid", "quadratic"):
        one = chunks.chunks(spark, name, lo, hi, NODES).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return chunks.non_increasing(out, "strategy")


@query(_EQUAL + " select chunk_no, cast(low as bigint) low, cast(up as bigint) up, cast(k as int) as copy, 'chunk-'||chunk_no||'-'||k replica_id, case when k>0 then 'chunk-'||chunk_no||'-0' end duplicate_of from c, (select unnest(range(0,3)) k)")
def chunk_replicas(spark, sf_dir):
    return chunks.replicas(chunks.chunks(spark, "equal", *chunks.bounds(read(spark, sf_dir, "lineitem"), "l_orderkey"), NODES), 2)


@query(_GUIDED + " select chunk_no, cast(planned_size as bigint) planned_size, cast(low as bigint) low, cast(up as bigint) up, cast(up-low+1 as bigint) n_elements from c")
def chunk_table_function(spark, sf_dir):
    table_functions.register(spark)
    lo, hi = chunks.bounds(read(spark, sf_dir, "lineitem"), "l_orderkey")
    return spark.sql(f"select * from chunk_plan({lo}, {hi}, {NODES}, 'guided')")


@query(
    f"with {_B}, s as (select count(*) n from supplier), k as (select s_suppkey node, row_number() over (order by s_suppkey) i from supplier) "
    "select cast(i as int) chunk_no, cast(case when i=1 then lo else lo+((hi-lo)//n)*(i-1)+1 end as bigint) low, cast(case when i=n then hi else lo+((hi-lo)//n)*i end as bigint) up, node from k, b, s"
)
def chunk_assignment(spark, sf_dir):
    nodes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    lo, hi = chunks.bounds(read(spark, sf_dir, "lineitem"), "l_orderkey")
    return scheduling.RoundRobin("equal").schedule_range(nodes, lo, hi).select("chunk_no", "low", "up", "node")


@query("select count(*)::bigint total_nodes, (select count(*) from orders)::bigint total_chunks, least(count(*), (select count(*) from orders))::bigint selected_nodes, (count(*) - least(count(*), (select count(*) from orders)))::bigint backup_nodes from supplier")
def task_schedule_summary(spark, sf_dir):
    nodes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    tasks_ = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return scheduling.summary(nodes, scheduling.RoundRobin().schedule(nodes, tasks_))


@query(
    """with recursive p as (select n nodes, 1001//(2*n) f, 100 l from range(2,26) r(n)), g as (select nodes, (i-100000)/10000::double delta, f, l from p, range(0,200000) t(i) where i<>100000),
  gm as (select nodes, delta, floor((f+l)/delta)::bigint m from g), q as (select distinct gm.nodes, m, f, 4*m+l+f w, 4*m-l-3*f x, 2*f+2*l-4*m y from gm join p using (nodes)),
  q2 as (select *, trunc(6006/w::double)::bigint n from q where w<>0), q3 as (select *, trunc(x/n::double)::bigint b, trunc(y/(n*n)::double)::bigint c from q2 where n<>0),
  s as (select nodes, m, f, b, c, 1 i, f size, f done, true ok from q3
    union all select nodes, m, f, b, c, i+1, g, done+g, g<=size from (select *, greatest(f+b*(i+1)+c*(i+1)*(i+1), 1) g from s where ok and done<=1001 and i<5*nodes)),
  k as (select nodes, m, i n_chunks from s where ok and done>1001 and i<5*nodes), a as (select nodes, delta, n_chunks, lag(n_chunks, 1, 0) over (order by nodes, delta) before from gm join k using (nodes, m))
  select nodes::int nodes, delta, n_chunks::int n_chunks from a where n_chunks <> before"""
)
def qss_delta_sweep(spark, sf_dir):
    return chunks.delta_sweep(spark)


@query(
    f"{_EQUAL}, n as (select s_suppkey node, row_number() over (order by s_suppkey)-1 k, count(*) over () m from supplier), a as (select chunk_no, node from c join n on (chunk_no-1)%m=k) "
    "select (select count(*) from supplier)::bigint total_nodes, count(*)::bigint total_chunks, count(distinct node)::bigint selected_nodes, ((select count(*) from supplier)-count(distinct node))::bigint backup_nodes from a"
)
def schedule_summary(spark, sf_dir):
    """The equal chunks of the order keys, dealt to the suppliers."""
    nodes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    plan = chunks.chunks(spark, "equal", *chunks.bounds(read(spark, sf_dir, "lineitem"), "l_orderkey"), NODES)
    return scheduling.summary(nodes, scheduling.RoundRobin().schedule(nodes, plan.withColumn("id", F.col("chunk_no") - 1)))


@query("select l_orderkey, l_linenumber, l_quantity, l_partkey from lineitem where l_quantity >= 50 order by l_orderkey, l_linenumber, l_partkey limit 1")
def stop_early(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return objects.first_hit(rows, "l_quantity >= 50", "l_orderkey", "l_linenumber", "l_partkey")


# ---- tiles -------------------------------------------------------------------------------------------------------

_GRIDS = ((1001, 799, 4, 4, 2), (100, 100, 3, 3, 2), (2, 2, 4, 4, 0), (80, 60, 4, 3, 5))
_GRID_SQL = """select w, h, hl, r*cc+c tile, r tile_row, c tile_column, c*(w//cc)+least(c, w%cc) x, r*(h//rr)+least(r, h%rr) y,
  w//cc + case when c < w%cc then 1 else 0 end width, h//rr + case when r < h%rr then 1 else 0 end height
  from (select w, h, hl, least(c0,w) cc, least(r0,h) rr from (values {values}) g(w,h,c0,r0,hl)), lateral (select unnest(range(0,cc)) c), lateral (select unnest(range(0,rr)) r)"""
_READ_SQL = """select *, greatest(x-hl,0) read_x, greatest(y-hl,0) read_y, least(x+width+hl,w)-greatest(x-hl,0) read_width, least(y+height+hl,h)-greatest(y-hl,0) read_height from ({grid})"""
_TILE_COLUMNS = "tile, tile_row, tile_column, x, y, width, height, read_x, read_y, read_width, read_height"
_GRID_VALUES = ",".join(f"({w},{h},{c},{r},{a})" for w, h, c, r, a in _GRIDS)


@query(f"select cast(w as int) w, cast(h as int) h, {', '.join(f'cast({c} as bigint) {c}' for c in _TILE_COLUMNS.split(', '))} from ({_READ_SQL.format(grid=_GRID_SQL.format(values=_GRID_VALUES))})")
def tile_grid(spark, sf_dir):
    out = None
    for w, h, c, r, halo in _GRIDS:
        one = tiles.grid(spark, w, h, c, r, halo).select(F.lit(w).alias("w"), F.lit(h).alias("h"), *_TILE_COLUMNS.split(", "))
        out = one if out is None else out.unionByName(one)
    return out


_SHAPES = ((1920, 1080, 8), (1920, 1080, 7), (640, 480, 1), (97, 61, 6), (70, 55, 6), (320, 240, 6), (50, 50, 4), (64, 500, 12), (2, 2, 8))


@query(
    f"select cast(w as int) w, cast(h as int) h, cast(n as int) n, cast(arg_min(c, (greatest(1,w//c)+greatest(1,h//(n//c)))*1000+c) as int) grid_columns, cast(n//arg_min(c, (greatest(1,w//c)+greatest(1,h//(n//c)))*1000+c) as int) grid_rows "
    f"from (values {','.join(map(str, _SHAPES))}) s(w,h,n), lateral (select unnest(range(1,n+1)) c) where n%c=0 group by w,h,n"
)
def tile_for_chunks(spark, sf_dir):
    return spark.createDataFrame([(w, h, n, *tiles.shape(w, h, n)) for w, h, n in _SHAPES], "w int, h int, n int, grid_columns int, grid_rows int")


@query("select cast(w as int) w, cast(h as int) h, cast(w*h as bigint) total_area, cast(0 as bigint) not_once from (values (1001,799),(100,100),(2,2),(80,60)) s(w,h)")
def tile_coverage(spark, sf_dir):
    out = None
    for w, h, c, r, halo in _GRIDS:
        one = tiles.coverage(tiles.grid(spark, w, h, c, r, halo)).select(F.lit(w).alias("w"), F.lit(h).alias("h"), "total_area", "not_once")
        out = one if out is None else out.unionByName(one)
    return out


_NUMBERED = f"""n as (select chunk_no::int chunk_no, tile::bigint tile, x::bigint x, y::bigint y, width::bigint width, height::bigint height from (select unnest(range(0, 12)) chunk_no) join ({_GRID_SQL.format(values='(640,480,4,3,0)')}) on tile=chunk_no)"""


@query(f"with {_NUMBERED} select * from n")
def tile_for(spark, sf_dir):
    """The tile of every chunk number of a loop, looked up one by one and by a join."""
    grid = tiles.for_chunks(spark, 640, 480, 12)
    for k in range(12):
        if tiles.tile_for(grid, k).first().tile != k:
            raise ValueError(f"the tile of chunk {k} is another one")
    return tiles.tiles_for(grid, spark.range(12).select(F.col("id").cast("int").alias("chunk_no"))).select("chunk_no", "tile", "x", "y", "width", "height")


@query(f"select tile::bigint tile, (width*height)::bigint area, (x-read_x)::bigint halo_left, (y-read_y)::bigint halo_top from ({_READ_SQL.format(grid=_GRID_SQL.format(values='(64,500,1,12,1)'))})")
def tile_measures(spark, sf_dir):
    return tiles.measures(tiles.for_chunks(spark, 64, 500, 12, 1))


def raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """Pixels (y, x, p) of the embeddings, and the raster's width and height."""
    rows = read(spark, sf_dir, "embeddings")
    width, height = rows.agg(F.max(F.size("embedding")), F.max("vec_id") + 1).first()
    level = F.least(F.greatest(F.floor((F.col("v").cast("double") + 1.0) * 127.5), F.lit(0)), F.lit(255)).cast("int")
    cells = rows.select(F.col("vec_id").cast("long").alias("y"), F.posexplode("embedding").alias("x", "v"))
    x = F.col("x").cast("long")
    p = kernels.rgb(level, ((x * 7 + F.col("y") * 13) % 256), ((x * F.col("y")) % 256))
    return cells.select("y", x.alias("x"), p.alias("p")), width, height


_RASTER = """px as (select y, x, (level << 16) | (((x*7+y*13)%256)::int << 8) | ((x*y)%256)::int p from (select vec_id::bigint y, (i-1)::bigint x,
  least(greatest(floor((embedding[i]::double+1.0)*127.5),0),255)::int as level from embeddings, lateral (select unnest(range(1, len(embedding)+1)) i)))"""
_TILED = "tl as (" + _READ_SQL.format(grid=_GRID_SQL.format(values="((select max(x)+1 from px),(select max(y)+1 from px),4,3,2)")).replace("from (values", "from (values") + ")"


@query(f"with {_RASTER}, {_TILED} select tile::bigint tile, count(*)::bigint n_pixels, sum(p)::bigint total, min(p)::int least, max(p)::int most from tl, px where px.x between read_x and read_x+read_width-1 and px.y between read_y and read_y+read_height-1 group by tile")
def tile_read_region(spark, sf_dir):
    pixels, w, h = raster(spark, sf_dir)
    return tiles.read_pixels(pixels, w, h, 4, 3, 2).groupBy("tile").agg(F.count("*").alias("n_pixels"), F.sum("p").alias("total"), F.min("p").alias("least"), F.max("p").alias("most"))


@query(f"with {_RASTER} select y, x, p::int p from px")
def tile_roundtrip(spark, sf_dir):
    pixels, w, h = raster(spark, sf_dir)
    cut = tiles.read_pixels(pixels, w, h, 4, 3, 2)
    return tiles.write_pixels(cut, w, h, 4, 3).select("y", "x", "p")


@query(f"with {_RASTER} select y, x, p::int p from px")
def tile_merge(spark, sf_dir):
    """The raster put together again after a check that no tile is missing."""
    pixels, w, h = raster(spark, sf_dir)
    cut = tiles.read_pixels(pixels, w, h, 4, 3, 2)
    return tiles.merge(tiles.grid(spark, w, h, 4, 3, 2), cut, w, h, 4, 3).select("y", "x", "p")


@query(f"with {_RASTER}, {_TILED} select tile::bigint tile, x::bigint x, y::bigint y, width::bigint width, height::bigint height from tl where tile in (2, 7)")
def tile_missing(spark, sf_dir):
    pixels, w, h = raster(spark, sf_dir)
    processed = tiles.read_pixels(pixels, w, h, 4, 3, 2).where("tile not in (2, 7)")
    return tiles.missing(tiles.grid(spark, w, h, 4, 3, 2), processed).select("tile", "x", "y", "width", "height")


@query(f"with {_RASTER} select y, x, p::int p from px")
def tile_png_roundtrip(spark, sf_dir):
    pixels, w, h = raster(spark, sf_dir)
    cut = tiles.read_pixels(pixels, w, h, 2, 8, 0)
    return files.png_to_pixels(files.tiles_to_png(cut)).select("y", "x", "p")


# ---- kernels -----------------------------------------------------------------------------------------------------

_LUMA = "((77*(({0}>>16)&255)+150*(({0}>>8)&255)+29*({0}&255))>>8)"
_NEAR = f"""with {_RASTER}, e as (select max(x) mx, max(y) my from px), nb as (select a.y, a.x, a.p c, dy, dx, b.p from px a, e, (select unnest(range(-1,2)) dx), (select unnest(range(-1,2)) dy), px b
  where b.x = least(greatest(a.x+dx,0),mx) and b.y = least(greatest(a.y+dy,0),my))"""
_PER_CHANNEL = "(({r})<<16)|(({g})<<8)|({b})"


def _channels(sql: str) -> str:
    return _PER_CHANNEL.format(**{n: sql.replace("$", f"((p>>{s})&255)").replace("@", f"((c>>{s})&255)") for n, s in (("r", 16), ("g", 8), ("b", 0))})


_SHARP = "least(greatest(sum(case when dx=0 and dy=0 then 5*$ when dx=0 or dy=0 then -$ else 0 end),0),255)::int"
_GX = f"abs(sum(dx*(2-abs(dy))*{_LUMA.format('p')}))+abs(sum(dy*(2-abs(dx))*{_LUMA.format('p')}))"
_KERNEL_SQL = {
    "invert": f"with {_RASTER} select y, x, ((~p) & 16777215)::int p from px",
    "grayscale": f"with {_RASTER} select y, x, ((l<<16)|(l<<8)|l)::int p from (select y, x, {_LUMA.format('p')} l from px)",
    "blur3": f"{_NEAR} select y, x, ({_channels('(sum($)//9)::int')})::int p from nb group by y, x",
    "sharpen": f"{_NEAR} select y, x, ({_channels(_SHARP)})::int p from nb group by y, x",
    "sobel": f"{_NEAR} select y, x, ((l<<16)|(l<<8)|l)::int p from (select y, x, least({_GX},255)::int l from nb group by y, x)",
}
for _name, _sql in _KERNEL_SQL.items():
    query(_sql, f"k_{_name}")(lambda spark, d, n=_name: kernels.apply(raster(spark, d)[0], n))
    if _name in ("blur3", "sharpen", "sobel"):

        def _tiled(spark, d, n=_name):
            pixels, w, h = raster(spark, d)
            return kernels.apply_tiled(pixels, n, w, h, 2, max(1, h // 256))

        query(_sql, f"k_{_name}_tiled")(_tiled)
        query(_sql, f"k_{_name}_joined")(lambda spark, d, n=_name: kernels.apply_joined(raster(spark, d)[0], n))


@query("select * from (values ('INVERT','invert'),('Blur3','blur3'),('sobel','sobel'),('GrayScale','grayscale'),('SHARPEN','sharpen'),('emboss',null),('',null)) k(asked, found)")
def kernel_lookup(spark, sf_dir):
    """Kernels by name, whatever the case; unknown names have none."""
    found = [(n, kernels.find(n)) for n in ("INVERT", "Blur3", "sobel", "GrayScale", "SHARPEN", "emboss", "")]
    return spark.createDataFrame([(n, k and k.name) for n, k in found], "asked string, found string")


# ---- devices -----------------------------------------------------------------------------------------------------

_TYPES = ("CPU", "NPU", "INTEGRATED_GPU", "APU", "FPGA", "DISCRETE_GPU", "OTHER")


def device_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("p_size") % 7 + 1).cast("int"))
    backend = F.element_at(F.array(*map(F.lit, devices.BACKENDS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"), backend.alias("backend"), F.concat(F.lit("dev:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("vendor"),
        kind.alias("type"), F.col("p_size").cast("int").alias("units"), (F.floor(F.col("p_retailprice") * 1000).cast("long") * 4096).alias("memory"),
    )


_DEV = f"""d as (select p_partkey ordinal, (['{"','".join(devices.BACKENDS)}'])[p_partkey%7+1] backend, 'dev:'||p_partkey id, p_name as name, p_brand vendor, (['{"','".join(_TYPES)}'])[p_size%7+1] as type,
  p_size::int units, floor(p_retailprice*1000)::bigint*4096 memory from part),
  r as (select *, case type when 'CPU' then 0 when 'NPU' then 1 when 'INTEGRATED_GPU' then 2 when 'APU' then 2 when 'FPGA' then 3 when 'DISCRETE_GPU' then 4 else 0 end preference, units*greatest(1, memory>>20) capacity from d)"""
_DEV_COLUMNS = "ordinal, backend, id, name, vendor, type, units, memory"


@query(f"with {_DEV} select {_DEV_COLUMNS} from d where type='APU' and backend='CUDA'")
def device_filter(spark, sf_dir):
    return devices.of_backend(devices.of_type(device_rows(spark, sf_dir), "APU"), "CUDA")


@query(f"with {_DEV} select ordinal, preference::int preference, capacity::bigint capacity, type in ('INTEGRATED_GPU','APU','DISCRETE_GPU') is_gpu from r")
def device_capacity(spark, sf_dir):
    return device_rows(spark, sf_dir).select("ordinal", devices.preference(F.col("type")).cast("int").alias("preference"), devices.capacity(F.col("units"), F.col("memory")).alias("capacity"), devices.is_gpu(F.col("type")).alias("is_gpu"))


@query(f"with {_DEV} select {_DEV_COLUMNS} from r order by preference desc, capacity desc, ordinal limit 1")
def device_best(spark, sf_dir):
    return devices.best(device_rows(spark, sf_dir))


@query(f"with {_DEV} select {_DEV_COLUMNS} from (select *, row_number() over (partition by type order by preference desc, capacity desc, ordinal) k from r) where k=1")
def device_best_of_type(spark, sf_dir):
    return devices.best(device_rows(spark, sf_dir), "type")


#: Devices in one description of device_describe at most, as ordinals are unique.
DESCRIBED = 1000


@query(f"with {_DEV} select (ordinal // {DESCRIBED})::bigint block, string_agg(backend||':'||name||' ('||type||', '||units||' CUs, '||(memory>>20)||' MB)', chr(10) order by ordinal) description from d group by 1")
def device_describe(spark, sf_dir):
    """Every device; in order of block, the descriptions are the one of all devices."""
    return devices.describe(device_rows(spark, sf_dir).withColumn("block", F.floor(F.col("ordinal") / DESCRIBED)), "block")


@query("select string_agg(n_name||': region '||n_regionkey||' is away', chr(10) order by n_nationkey) description from nation where n_regionkey <> 1")
def device_describe_unavailable(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("backend"), (F.col("n_regionkey") == 1).alias("available"), F.format_string("region %d is away", "n_regionkey").alias("reason"))
    return devices.describe_unavailable(rows)


@query(f"with {_DEV} select {_DEV_COLUMNS} from d where ordinal%5<>0")
def device_wire_roundtrip(spark, sf_dir):
    d = device_rows(spark, sf_dir)
    broken = d.withColumn("backend", F.when(F.col("ordinal") % 5 == 0, "QUANTUM_ANNEALER").otherwise(F.col("backend")))
    wire = devices.to_wire(broken, "ordinal").withColumnRenamed("ordinal", "key")
    return devices.parse(wire, "devices", "key").select(F.col("key").alias("ordinal"), *_DEV_COLUMNS.split(", ")[1:])


@query("select p_partkey, case when p_partkey%3=0 then 'Unknown device' else trim(p_name) end as name, case when p_partkey%4=0 then 'Unknown vendor' else trim(p_brand) end vendor from part where p_partkey%11<>0")
def device_normalise(spark, sf_dir):
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(key % 11 == 0, "  ").otherwise("x").alias("id"), F.when(key % 3 == 0, " ").otherwise(F.concat(F.lit(" "), "p_name")).alias("name"), F.when(key % 4 != 0, F.col("p_brand")).alias("vendor"))
    return devices.normalise(rows).select("p_partkey", "name", "vendor")


@query(
    "select p_partkey, case when k=1 then case when p_partkey%2=0 then case when v like '%amd%' or v like '%advanced micro%' then 'APU' else 'INTEGRATED_GPU' end else 'DISCRETE_GPU' end when k=2 then 'FPGA' when k=0 then 'CPU' else 'OTHER' end as type "
    "from (select p_partkey, p_size%4 k, lower(case when p_size%3=0 then 'Advanced Micro Devices' else p_brand end) v from part)"
)
def device_classify(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("CPU", "GPU", "ACCELERATOR", "CUSTOM"))), (F.col("p_size") % 4 + 1).cast("int"))
    vendor = F.when(F.col("p_size") % 3 == 0, "Advanced Micro Devices").otherwise(F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", devices.classify(kind, F.col("p_partkey") % 2 == 0, vendor).alias("type"))


# ---- network -----------------------------------------------------------------------------------------------------


def hop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), (F.col("user_id") % 20).alias("dst"), F.col("event_type").alias("via"), F.floor("value").cast("long").alias("distance"), "ts")


_HOPS = "h as (select event_id ordinal, user_id%20 dst, event_type via, floor(value)::bigint distance, ts from events), u as (select dst, via, arg_max(distance, (ts, ordinal)) distance, max(ts) ts from h group by dst, via)"


@query(f"with {_HOPS} select dst, via, distance, ts from u")
def hop_upsert(spark, sf_dir):
    return network.upsert_hops(hop_rows(spark, sf_dir))


def _live(spark, sf_dir):
    """Upserted hops that haven't expired at the time of the last event."""
    hops = network.upsert_hops(hop_rows(spark, sf_dir))
    as_of = read(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return network.expire(hops, F.lit(as_of).cast("timestamp_ntz"))


_LIVE = f"with {_HOPS}, l as (select * from u where floor((epoch_us((select max(ts) from events))-epoch_us(ts))/1000000) < 600)"


@query(f"{_LIVE} select dst, via, distance, ts from l")
def hop_expire(spark, sf_dir):
    return _live(spark, sf_dir)


@query(f"with {_HOPS} select dst, via, distance, ts from u where via <> 'view'")
def hop_remove(spark, sf_dir):
    return network.remove_hop(network.upsert_hops(hop_rows(spark, sf_dir)), "view")


@query(f"{_LIVE}, n as (select distinct user_id%20 dst from events) select n.dst, coalesce(first(via order by distance, via),'Empty') via, coalesce(min(distance), 9223372036854775807)::bigint distance from n left join l on l.dst=n.dst group by n.dst")
def hop_nearest(spark, sf_dir):
    return network.nearest(_live(spark, sf_dir), hop_rows(spark, sf_dir).select("dst").distinct())


@query(
    f"with {_HOPS}, n as (select s_suppkey node, case when s_suppkey%3=0 then floor(s_acctbal)::bigint end last from supplier), a as (select s_suppkey node, s_nationkey::bigint distance from supplier where s_suppkey%4=0), m as (select dst node, min(distance) d from u group by dst) "
    "select n.node, coalesce(a.distance, m.d, n.last, 0)::bigint distance from n left join a using(node) left join m using(node)"
)
def node_distance(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") % 3 == 0, F.floor("s_acctbal").cast("long")).alias("last_distance"))
    adjacent = s.where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("long").alias("distance"))
    return network.distances(nodes, adjacent, network.upsert_hops(hop_rows(spark, sf_dir)))


@query("select s_suppkey, 'fe80::'||s_suppkey ip from supplier")
def ip_zone_strip(spark, sf_dir):
    ip = F.concat(F.lit("fe80::"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "%eth0").otherwise(""))
    return read(spark, sf_dir, "supplier").select("s_suppkey", network.strip_zone(ip).alias("ip"))


@query("select s_suppkey, (case when s_suppkey%3=0 then 1 else 2 end)::int n_addresses, case when s_suppkey%2=0 then s_nationkey end::bigint found from supplier")
def ip_map_ops(spark, sf_dir):
    key = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.create_map(F.lit("a"), F.col("s_nationkey").cast("long"), F.lit("b"), F.lit(1).cast("long")).alias("m"))
    added = network.put_if_absent(F.col("m"), F.when(key % 3 == 0, "a").otherwise("c"), F.lit(7).cast("long"))
    kept = network.remove_ip(added, F.lit("b"))
    return rows.select("s_suppkey", F.size(kept).alias("n_addresses"), network.get_ip(kept, F.when(key % 2 == 0, "a").otherwise("z")).alias("found"))


@query("select user_id, sum(case when event_type='error' then -1 else 1 end)::bigint ping_score from events group by user_id")
def ip_ping_score(spark, sf_dir):
    return network.ping_scores(read(spark, sf_dir, "events"), F.col("event_type") != "error", "user_id")


def node_json_rows(spark, sf_dir):
    key = F.col("s_suppkey")
    bench = F.format_string('{"CPU":{"Benchmarks":{"Composite Score":"%s"}},"HDD":{"Benchmarks":{"AvgRead":"%s MB/s"}}}', F.col("s_acctbal").cast("string"), F.col("s_nationkey").cast("string"))
    ips = F.array(F.struct(F.concat(F.lit("10.0.0.1%"), key.cast("string")).alias("ip"), key.alias("pingScore")))
    wire = F.to_json(F.struct(key.cast("string").alias("uuid"), F.col("s_name").alias("host"), F.lit("linux").alias("os"), F.lit(4).alias("taskLimit"), (key * 1024).alias("memory"), (key * 10).alias("lastCheckAgo"), F.when(key % 2 == 0, F.col("s_acctbal")).alias("CPULOAD"), ips.alias("ipAddresses")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", wire.alias("wire"), bench.alias("benchmarks"))


@query(
    "select s_suppkey::varchar uuid, s_name host, 4::int task_limit, s_suppkey*1024 memory, 1000000-s_suppkey*10 last_checked_ms, case when s_suppkey%2=0 then s_acctbal else 1.7976931348623157e308 end cpu_load, s_suppkey ping_score from supplier"
)
def node_json(spark, sf_dir):
    parsed = network.parse_nodes(node_json_rows(spark, sf_dir), "wire", F.lit(1_000_000).cast("long"))
    return parsed.select("uuid", "host", "task_limit", "memory", "last_checked_ms", "cpu_load", F.col("addresses")["10.0.0.1"]["ping_score"].alias("ping_score"))


@query("select s_suppkey, s_acctbal cpu_score, s_nationkey::double read_speed from supplier")
def node_scores(spark, sf_dir):
    return node_json_rows(spark, sf_dir).select("s_suppkey", network.cpu_score(F.col("benchmarks")).alias("cpu_score"), network.speed(F.col("benchmarks")).alias("read_speed"))


_ENTITIES = """select 'address' entity, s_suppkey id, to_json({'ip': '10.0.0.'||s_suppkey, 'distance': s_nationkey, 'pingScore': s_suppkey%7})::varchar json from supplier
  union all select 'node', s_suppkey, to_json({'uuid': s_suppkey::varchar, 'task_limit': 4, 'waiting_in_que': s_nationkey, 'operatingSytem': 'linux', 'hostname': s_name, 'memory': s_suppkey*1024, 'ipAddresses': [{'ip': '10.0.0.'||s_suppkey, 'distance': s_nationkey, 'pingScore': s_suppkey%7}]})::varchar from supplier
  union all select 'coverage', p_partkey, to_json({'path': p_name, 'beginLine': 1, 'beginColumn': 0, 'endLine': p_size, 'endColumn': p_partkey%80})::varchar from part
  union all select 'chunk', chunk_no, to_json({'chunkNo': chunk_no::varchar, 'start': low::varchar, 'end': up::varchar, 'nodeUUID': (chunk_no%3)::varchar, 'diff': planned_size::varchar, 'duplicates': []::varchar[]})::varchar from c
  union all select 'task', o_orderkey, to_json({'id': o_orderkey, 'nodeUUID': (o_custkey%5)::varchar, 'name': o_orderstatus, 'length': o_custkey::double, 'timeout': 1000, 'resources': ['cpu'], 'dependOn': [(o_orderkey%9)::varchar], 'startTime': 0.5::double, 'hasDuplicates': false, 'isDuplicate': o_orderkey%3=0})::varchar from orders"""


@query(_EQUAL + " " + _ENTITIES)
def entity_json(spark, sf_dir):
    """Addresses, nodes, coverage, chunks and tasks as JSON."""
    key = F.col("s_suppkey")
    address = F.struct(F.concat(F.lit("10.0.0."), key.cast("string")).alias("ip"), F.col("s_nationkey").alias("distance"), (key % 7).alias("pingScore"))
    suppliers = read(spark, sf_dir, "supplier").select(key.alias("id"), "s_name", "s_nationkey", address.alias("address"))
    node = suppliers.select("id", F.col("id").cast("string").alias("uuid"), F.lit(4).alias("task_limit"), F.col("s_nationkey").alias("waiting_in_que"), F.lit("linux").alias("operatingSytem"), F.col("s_name").alias("hostname"), (F.col("id") * 1024).alias("memory"), F.array("address").alias("ipAddresses"))
    coverage = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("path"), F.lit(1).alias("beginLine"), F.lit(0).alias("beginColumn"), F.col("p_size").alias("endLine"), (F.col("p_partkey") % 80).alias("endColumn"))
    plan = chunks.chunks(spark, "equal", *chunks.bounds(read(spark, sf_dir, "lineitem"), "l_orderkey"), NODES)
    no = F.col("chunk_no")
    chunk = plan.select(no.alias("id"), *(c.cast("string").alias(n) for c, n in ((no, "chunkNo"), (F.col("low"), "start"), (F.col("up"), "end"), (no % 3, "nodeUUID"), (F.col("planned_size"), "diff"))), F.array().cast("array<string>").alias("duplicates"))
    o = F.col("o_orderkey")
    task = read(spark, sf_dir, "orders").select(
        o.alias("id"), (F.col("o_custkey") % 5).cast("string").alias("node"), F.col("o_orderstatus").alias("name"), F.col("o_custkey").cast("decimal(38,18)").alias("length"), F.lit(1000).cast("decimal(38,0)").alias("timeout"), F.array(F.lit("cpu")).alias("resources"),
        F.array((o % 9).cast("string")).alias("depends_on"), F.lit(0.5).alias("start_time"), F.array().cast("array<string>").alias("duplicates"), F.when(o % 3 == 0, "t").alias("duplicate_of"),
    )
    own = lambda name, rows: rows.select(F.lit(name).alias("entity"), F.col("id").cast("long").alias("id"), "json")
    out = own("address", network.to_json(suppliers.select("id", "address.*"), "id", keep=()))
    for name, rows in (("node", node), ("coverage", coverage), ("chunk", chunk)):
        out = out.unionByName(own(name, network.to_json(rows, "id", keep=())))
    return out.unionByName(own("task", tasks.to_json(task, "id")))


# ---- orders ------------------------------------------------------------------------------------------------------

_SCORES = {"CPU_MONTE_CARLO": "Monte Carlo", "CPU_FFT": "FFT", "CPU_LU": "LU", "CPU_SOR": "SOR", "CPU_SPARSE_MAT_MUL": "Sparse MatMult", "CPU_COMPOSITE_SCORE": "Composite Score"}
#: For each sort key a value of a supplier: the same expression in both languages.
_NODE_VALUES = {
    "UUID": ("uuid", "s_name"), "OS": ("os", "concat('os', s_suppkey % 3)"), "HOST": ("host", "concat('host', s_suppkey * 29 % 97)"), "QLEN": ("task_limit", "s_suppkey % 5"), "QWAIT": ("waiting", "s_suppkey % 3"), "RAM": ("memory", "s_suppkey * 7919 % 1000"),
    "RAM_FREE": ("free_memory", "s_suppkey * 104729 % 1000"), "DISTANCE_FROM_CURRENT": ("distance", "s_suppkey * 31 % 17"), "HDD_FREE": ("hdd_free", "s_suppkey * 37 % 101"), "HDD": ("hdd_size", "s_suppkey * 41 % 103"), "CPU_AVG_LOAD": ("cpu_load", "s_acctbal"),
    "PROCESSOR": ("processor", "substr(s_name, length(s_name) - 1)"), "HDD_READ_SPEED": ("read_speed", "s_suppkey * 43 % 107"), "HDD_WRITE_SPEED": ("write_speed", "s_suppkey * 47 % 109"),
    **{k: (v, f"s_suppkey * {53 + 6 * i} % {113 + 14 * i}") for i, (k, v) in enumerate(_SCORES.items())},
}
_TASK_VALUES = {
    "NAME": "o_orderpriority", "NO_OF_FILES": "(o_orderkey * 7 % 4)", "WEIGHT": "o_totalprice", "TIMEOUT": "(o_orderkey * 31 % 1009)", "ID": "o_orderkey", "NO_OF_RESOURCES": "(o_orderkey * 11 % 6)", "START_TIME": "(o_orderkey * 17 % 503)", "NO_OF_DEPENDENCIES": "(o_orderkey * 13 % 5)",
}


@query("select s_suppkey as \"key\", " + ", ".join(f"cast(row_number() over (partition by s_nationkey order by {sql}, s_suppkey) as int) position_{k.lower()}" for k, (_, sql) in _NODE_VALUES.items()) + " from supplier")
def node_sort_keys(spark, sf_dir):
    """Every sort key of a node: suppliers of a nation in its order."""
    made = {k: F.expr(sql) for k, (_, sql) in _NODE_VALUES.items()}
    plain = [made[k].alias(name) for k, (name, _) in _NODE_VALUES.items() if k not in _SCORES and not k.endswith("_SPEED")]
    score = F.struct(*[made[k].cast("string").alias(v) for k, v in _SCORES.items()])
    disk = F.struct(*[F.format_string("%d MB/s", made[k]).alias(n) for k, n in (("HDD_READ_SPEED", "AvgRead"), ("HDD_WRITE_SPEED", "AvgWrite"))])
    bench = F.to_json(F.struct(F.struct(score.alias("Benchmarks")).alias("CPU"), F.struct(disk.alias("Benchmarks")).alias("HDD")))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), "s_nationkey", *plain, bench.alias("benchmarks"))
    return ordering.positions(rows, ordering.node_keys(), "key", "s_nationkey").select("key", *(f"position_{k.lower()}" for k in _NODE_VALUES))


@query("select o_orderkey as \"key\", " + ", ".join(f"cast(row_number() over (partition by o_custkey order by {sql}, o_orderkey) as int) position_{k.lower()}" for k, sql in _TASK_VALUES.items()) + " from orders")
def task_sort_keys(spark, sf_dir):
    """Every sort key of a task: orders of a customer in its order."""
    made = {k: F.expr(sql) for k, sql in _TASK_VALUES.items()}
    many = lambda k: F.slice(F.array(*map(F.lit, "abcdef")), F.lit(1), made[k].cast("int"))
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), "o_custkey", made["NAME"].alias("name"), many("NO_OF_FILES").alias("files"), made["WEIGHT"].alias("length"), made["TIMEOUT"].alias("timeout"), made["ID"].alias("id"),
        many("NO_OF_RESOURCES").alias("resources"), made["START_TIME"].cast("double").alias("start_time"), many("NO_OF_DEPENDENCIES").alias("depends_on"),
    )
    return ordering.positions(rows, ordering.task_keys(), "key", "o_custkey").select("key", *(f"position_{k.lower()}" for k in _TASK_VALUES))


@query("select s_suppkey uuid, cast(row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as int) as position from supplier")
def node_sort(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uuid"), F.col("s_nationkey").alias("site"), F.col("s_acctbal").alias("cpu_load"))
    return ordering.ranked(rows, ordering.comparator({k: v for k, v in ordering.node_keys().items() if k in ("UUID", "CPU_AVG_LOAD")}, "-CPU_AVG_LOAD", "UUID"), "site").select("uuid", "position")


@query("select o_orderkey id, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as int) as position from orders")
def task_sort(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_totalprice").alias("length"))
    keys = {k: v for k, v in ordering.task_keys().items() if k in ("WEIGHT", "ID")}
    return ordering.ranked(rows, ordering.comparator(keys, "-WEIGHT", "ID"), "o_custkey").select("id", "position")


@query(f"with {_HOPS} select dst, via, cast(row_number() over (partition by dst order by distance, ts desc, via) as int) as position from u")
def hop_sort(spark, sf_dir):
    keys = ordering.hop_keys() | {"VIA": F.col("via")}
    return ordering.ranked(network.upsert_hops(hop_rows(spark, sf_dir)), ordering.comparator(keys, "DISTANCE", "-TIMESTAMP", "VIA"), "dst").select("dst", "via", "position")


@query("select s_suppkey, row_number() over (order by s_nationkey, s_acctbal desc, s_suppkey) as position from supplier")
def ip_sort(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("ip"), F.col("s_nationkey").alias("distance"), F.col("s_acctbal").alias("ping_score"))
    return ordering.placed(rows, ordering.comparator(ordering.ip_keys(), "DISTANCE", "-PING_SCORE", "IP")).select("s_suppkey", "position")


@query("select l_partkey, 1 + (select count(*) from lineitem) - sum(n) over (order by l_partkey desc) first_rank, n from (select l_partkey, count(*) n from lineitem group by 1)".replace("1 + (select count(*) from lineitem) - sum(n) over (order by l_partkey desc) first_rank", "(1 + (select count(*) from lineitem) - sum(n) over (order by l_partkey desc))::bigint first_rank"))
def merge_sort_runs(spark, sf_dir):
    return ordering.global_ranks(read(spark, sf_dir, "lineitem").select("l_partkey"), "l_partkey")


@query("select l_orderkey, l_partkey, row_number() over (order by l_orderkey, l_partkey) as position from lineitem")
def merge_sort_ranges(spark, sf_dir):
    """The range sort's rows with the places that they have in its output."""
    return ordering.as_sorted(ordering.range_sort(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey"))


@query("select k, count(*)::bigint n from (select o_custkey k from orders union all select c_custkey from customer union all select s_suppkey from supplier) group by k")
def bag_union(spark, sf_dir):
    parts = [read(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in (("orders", "o_custkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"))]
    return ordering.bag_union(*parts).groupBy("k").agg(F.count("*").alias("n"))


_TREE = tasks.merge_tree(20).tasks


@query(
    "with recursive e(name, needs) as (values " + ",".join(f"('{k}','{d}')" for k, t in _TREE.items() for d in t["depends_on"]) + "), n as (select unnest([" + ",".join(f"'{k}'" for k in _TREE) + "]) as name), "
    "w(name, level) as (select name, 0 from n where name not in (select name from e) union all select e.name, w.level+1 from e join w on e.needs=w.name) select name, max(level)::int as level from w group by name"
)
def task_levels(spark, sf_dir):
    return tasks.levels(tasks.merge_tree(20).frame(spark))


@query("select o_orderkey id, o_orderkey%3=0 is_duplicate, o_orderkey%5=0 has_duplicates, (case when o_orderkey%2=0 then 1 else 2 end)::int n_resources from orders")
def task_duplicates(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(
        key.alias("name"), F.when(key % 3 == 0, F.lit("t")).alias("duplicate_of"), F.when(key % 5 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("duplicates"),
        F.array(F.lit("cpu")).alias("resources"), F.when(key % 2 == 0, "cpu").otherwise("disk").alias("wanted"),
    )
    rows = tasks.with_resources(rows, F.array("wanted"))
    return tasks.is_duplicate(rows, F.size("resources").alias("n_resources")).withColumnRenamed("name", "id")


# ---- objects -----------------------------------------------------------------------------------------------------


@query("select doc_id, sha1(text) checksum from documents")
def doc_checksum(spark, sf_dir):
    return objects.checksums(read(spark, sf_dir, "documents"), "doc_id", "text")


@query("select sha1(text) checksum, min(doc_id) doc_id, count(*)::bigint n_copies from documents group by 1")
def object_dedup(spark, sf_dir):
    return objects.deduplicate(read(spark, sf_dir, "documents"), "doc_id", "text")


@query("select conv_id, role, arg_max(text, turn) as text, max(turn) turn from conversations group by conv_id, role")
def array_upsert(spark, sf_dir):
    return objects.last_write(read(spark, sf_dir, "conversations"), ["conv_id", "role"], "text", "turn")


@query("select conv_id, role, arg_max(text, turn) as text, max(turn) turn from conversations group by conv_id, role")
def element_append(spark, sf_dir):
    """Elements appended by two writers, odd and even turns; readers take the last write of each key."""
    path = f"{objects.shared_folder(spark)}/elements-{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "conversations").select(F.lit("talk").alias("object"), F.col("conv_id").alias("instance"), F.col("role").alias("position"), F.col("text").alias("value"), F.col("turn").alias("seq"))
    for odd in (1, 0):
        objects.append_elements(rows.where(F.col("seq") % 2 == odd), path)
    last = objects.last_write(spark.read.parquet(path), ["object", "instance", "position"], "value", "seq")
    return last.select(F.col("instance").alias("conv_id"), F.col("position").alias("role"), F.col("value").alias("text"), F.col("seq").alias("turn"))


@query("select n_name as text, length(n_name)::int n_chars from nation")
def text_roundtrip(spark, sf_dir):
    """Text files written and read as whole files, their lines as rows."""
    path = f"{objects.shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    files.write_text(read(spark, sf_dir, "nation"), "n_name", path)
    lines = files.read_texts(spark, path).select(F.explode(F.split("text", "\n")).alias("text")).where("text <> ''")
    return lines.select("text", F.length("text").alias("n_chars"))


@query("select conv_id, turn, text from conversations where conv_id=3 and turn=1")
def array_get(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.lit("talk").alias("object"), F.col("turn").cast("string").alias("position"), F.col("conv_id").cast("int").alias("instance"), "conv_id", "turn", "text")
    return objects.element(rows, "talk", "1", 3).select("conv_id", "turn", "text")


@query("select doc_id, length(coalesce(text, ''))::int n_chars from documents")
def object_received(spark, sf_dir):
    """Documents published as an object, received once their checksums agree."""
    store = objects.ObjectStore(spark, f"{objects.shared_folder(spark)}/objects-{uuid.uuid4().hex}")
    store.publish(read(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars")), "documents", 0)
    return store.receive("documents", 0, tries=1)


@query("select n_nationkey id, replace(replace(n_name, 'FRANCE', 'width'), 'CHINA', 'height') as name, case when n_nationkey<3 then '8' else 'old' end as value from nation")
def val_resolve(spark, sf_dir):
    values = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("old").alias("value"), F.col("n_regionkey").alias("call"))
    updates = spark.createDataFrame([(i, "8") for i in range(3)], "id int, value string")
    expressions = spark.createDataFrame([(1, "france", "width"), (2, "China", "height"), (3, "FRANCE", "never")], "ordinal int, string string, right string")
    return objects.resolve_names(objects.update_values(values, updates), expressions, "call").drop("call")


@query("select o_orderkey::int id, case when o_orderkey%2=0 then o_custkey else 0 end::bigint \"startTime\", case when o_orderkey%3=0 then 7 else 0 end::bigint length from orders")
def json_to_csv_projection(spark, sf_dir):
    """Files of JSON arrays of tasks, projected into CSV files and read back."""
    key, folder = F.col("o_orderkey"), f"{objects.shared_folder(spark)}/trace-{uuid.uuid4().hex}"
    task = F.struct(key.alias("id"), F.when(key % 2 == 0, F.col("o_custkey")).alias("startTime"), F.when(key % 3 == 0, F.lit(7)).alias("length"))
    files.write_json_arrays(read(spark, sf_dir, "orders").select(F.expr("o_orderkey div 10000").alias("file"), task.alias("task")), "file", "task", f"{folder}/json")
    files.write_csv(files.task_trace(spark, f"{folder}/json"), f"{folder}/csv")
    return files.read_csv(spark, f"{folder}/csv", files.TRACE)


# ---- telemetry ---------------------------------------------------------------------------------------------------

_TOLD = "t as (select *, case when event_type in ('purchase','click') then 'CACHEHIT' when event_type='error' then 'CACHEMISS' else 'ComOH' end command, floor(value*1000)::bigint n_bytes, (props->>'$.k')::bigint ms from events)"
_STATS = "sum((command='CACHEHIT')::int)::bigint hits, sum((command='CACHEMISS')::int)::bigint misses, sum(case when command='CACHEMISS' then n_bytes else 0 end)::bigint miss_bytes, sum(case when command='CACHEMISS' then ms else 0 end)::bigint miss_ms"
_SPEED = "case when miss_ms>0 then miss_bytes/(miss_ms/1000.0) else 0.0 end::double speed"


@query(f"with {_TOLD} select *, {_SPEED} from (select user_id, {_STATS} from t group by user_id)")
def cache_stats(spark, sf_dir):
    return telemetry.cache_stats(telemetry.commands(read(spark, sf_dir, "events")), "user_id")


@query(f"with {_TOLD} select *, {_SPEED} from (select date_trunc('hour', ts) window_start, {_STATS} from t group by 1)")
def cache_stats_windowed(spark, sf_dir):
    out = telemetry.cache_stats_windowed(telemetry.commands(read(spark, sf_dir, "events")))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"with {_TOLD} select *, {_SPEED} from (select date_trunc('hour', ts) window_start, {_STATS} from t group by 1)")
def cache_stats_streamed(spark, sf_dir):
    """The windows of a stream over all events; every batch replaces the table that the sink keeps."""
    folder = f"{objects.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = read(spark, sf_dir, "events")
    events.write.parquet(f"{folder}/in")
    stream = telemetry.cache_stats_windowed(telemetry.commands(spark.readStream.schema(events.schema).parquet(f"{folder}/in")))
    out = telemetry.into_table(stream, f"{folder}/out", f"{folder}/checkpoint")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"with {_TOLD} select command, user_id::varchar pid, n_bytes size, ms comm_oh, ts from t")
def telemetry_wire(spark, sf_dir):
    lines = telemetry.to_wire(telemetry.commands(read(spark, sf_dir, "events")))
    junk = spark.createDataFrame([("junk",), (None,), ('{"other": 1}',)], "value string")
    return telemetry.from_wire(lines.unionByName(junk))


@query(f"with {_HOPS} select dst, via, to_json({{'dst': dst, 'via': via, 'distance': distance}})::varchar json from u")
def hop_json(spark, sf_dir):
    return network.to_json(network.upsert_hops(hop_rows(spark, sf_dir)).select("dst", "via", "distance"), "dst", "via")


@query("select n_name as name, case n_nationkey%7 when 6 then null when 3 then case when n_regionkey%2=0 then 'Metal needs macOS' else 'metal: no driver is probed' end when 2 then case when n_regionkey%2=0 then 'rocm: no driver is probed' else 'ROCm needs Linux' end else lower((['OPENCL','CUDA','ROCM','METAL','VULKAN','NPU','JAVA_CPU'])[n_nationkey%7+1])||': no driver is probed' end reason from nation")
def device_unavailable_reason(spark, sf_dir):
    backend = F.element_at(F.array(*map(F.lit, devices.BACKENDS)), F.col("n_nationkey") % 7 + 1)
    os = F.when(F.col("n_regionkey") % 2 == 0, "Linux").otherwise("Mac OS X")
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), devices.unavailable_reason(backend, os).alias("reason"))


@query(
    "with r(backend, ordinal, reason) as (values ('CUDA',0,'cuda: no driver is probed'),('BROKEN',1,'BROKEN failed: no library'),('EMPTY',2,'EMPTY has no devices')) "
    f"select backend, ordinal::int ordinal, false available, reason, 0::bigint n_devices from r union all select 'PARTS', 3, true, null, (select count(*) from part)"
)
def device_registry(spark, sf_dir):
    """Registered backends, two of which can't be used: none of them may throw."""

    def broken():
        raise OSError("no library")

    registry = devices.Registry()
    registry.register("CUDA", lambda: None)
    registry.register("BROKEN", broken)
    registry.register("EMPTY", lambda: device_rows(spark, sf_dir).limit(0))
    registry.register("PARTS", lambda: device_rows(spark, sf_dir))
    sizes = registry.devices(spark).groupBy(F.col("registered").alias("backend")).agg(F.count("*").alias("n"))
    return registry.backends(spark).join(sizes, "backend", "left").select("backend", "ordinal", "available", "reason", F.coalesce("n", F.lit(0).cast("long")).alias("n_devices"))


@query("select user_id, event_id, event_type, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) where k=1")
def node_liveness(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return network.latest(rows, "user_id", "ts", "event_id")
