"""The queries once more in plain SQL, written independently of the DataFrame code for cross-checking."""

from __future__ import annotations

from voxelloom.plans.queries import THRESHOLDS as _CATALOGUE

_TILES = """
tiles as (
  select *, x || '-' || (x + 4) || '_' || y || '-' || (y + 4) || '_' || z || '-' || (z + 4) as name
  from (
    select cast(1 + vec_id // 512 as int) as image_id,
           cast((vec_id % 8) * 4 as int) as x,
           cast(((vec_id // 8) % 8) * 4 as int) as y,
           cast(((vec_id // 64) % 8) * 4 as int) as z,
           embedding
    from embeddings)
)"""

_VOXELS = """
raw as (
  select image_id, name, x as tx, y as ty, z as tz, cast(unnest(range(len(embedding))) as int) as p, unnest(embedding) as e
  from tiles
),
voxels as (
  select image_id, name, tx, ty, tz, p,
         cast(tx + p % 4 as int) as x, cast(ty + (p // 4) % 4 as int) as y, cast(tz + p // 16 as int) as z,
         cast(greatest(0, least(255, floor((cast(e as double) + 1) * 127.5))) as int) as v
  from raw
)"""

_ROI = """
roi as (
  select p_partkey as req_id,
         cast(case when p_partkey % 2 = 0 then 1 else 1 + (p_partkey // 2) % 4 end as int) as image_id,
         1 as zoom_out,
         cast((p_partkey * 7) % 32 - 2 as int) as x,
         cast((p_partkey * 11) % 32 - 2 as int) as y,
         cast((p_partkey * 13) % 32 - 2 as int) as z,
         cast(1 + p_partkey % 9 as int) as width,
         cast(1 + p_partkey % 7 as int) as height,
         cast(1 + p_partkey % 5 as int) as depth
  from part
)"""

SIGMAS = (1.0, 0.9, 1.0)
SATURATED = 25.0
_HEX = "string_agg(printf('%02X', {v}), '' order by {order})"
_TEXT_COLUMNS = "image_id, x, y, z, v"


def _with(*parts: str, select: str) -> str:
    return "with " + ",".join(parts) + "\n" + select


def _voxel_query(*parts: str, select: str) -> str:
    return _with(_TILES, _VOXELS, *parts, select=select)


def _pairs(low: str, high: str) -> str:
    tests = [
        f"t.{a} {low} r.{a} - 4 and t.{a} {high} r.{a} + r.{e}"
        for a, e in zip("xyz", ("width", "height", "depth"))
    ]
    return (
        "pairs as (select r.req_id, t.image_id, t.name, t.x, t.y, t.z from roi r join tiles t "
        "on r.image_id = t.image_id and r.zoom_out = 1 and " + " and ".join(tests) + ")"
    )


# Tiles of 4x4x4 by the region of 8x8x8 that holds their origin, and the box they fill.
_REGIONS = """
select image_id, 1 as zoom_out, (x // 8) || '_' || (y // 8) || '_' || (z // 8) as region, count(*) as n,
       cast(min(x) as bigint) as x, cast(min(y) as bigint) as y, cast(min(z) as bigint) as z,
       cast(max(x) + 4 as bigint) as x_end, cast(max(y) + 4 as bigint) as y_end, cast(max(z) + 4 as bigint) as z_end
from tiles group by image_id, x // 8, y // 8, z // 8"""

# Colours that follow from the grey value, except of every seventh tile; their brightness inverted.
_COLORS = """
colored as (
  select image_id, x, y, z, v, v as blue, (v * 7 + 13) % 256 as green, (v * v) // 255 as red,
         ((image_id - 1) * 512 + tx // 4 + ty // 4 * 8 + tz // 4 * 64) % 7 = 0 as grey
  from voxels
),
bright as (select *, greatest(blue, green, red) as top from colored),
inverted as (
  select image_id, x, y, z, v, grey, top, unnest([('blue', blue), ('green', green), ('red', red)]) as part from bright
)"""
_INVERTED = """
select image_id, x, y, z, part[1] as channel, cast(case
         when grey then 255 - v
         when top = 0 then 255
         else floor(part[2] * (255 - top) / top + 0.5)
       end as int) as v
from inverted"""

_STRICT = _pairs(">", "<")
_INCLUSIVE = _pairs(">=", "<=")

_ASSEMBLED = """
places as (
  select r.*, cast(unnest(range(width * height * depth)) as int) as p from roi r
),
places_xyz as (
  select *, x + p % width as px, y + (p // width) % height as py, z + p // (width * height) as pz from places
),
assembled as (
  select q.req_id, q.image_id, q.x, q.y, q.z, q.width, q.height, q.depth, q.p, q.px, q.py, q.pz, coalesce(o.v, 0) as v
  from places_xyz q left join voxels o
    on o.image_id = q.image_id and o.x = q.px and o.y = q.py and o.z = q.pz
)"""
_ROI_NAME = "x || '-' || (x + width) || '_' || y || '-' || (y + height) || '_' || z || '-' || (z + depth)"


# Weights by distance, in units of 1 / 65536. Fixed values.
_KERNELS = {1.0: [26152, 15862, 3539, 291], 0.9: [29052, 15671, 2459, 112]}


def _weights(name: str, sigma: float) -> str:
    side = _KERNELS[sigma]
    rows = [f"({o}, {side[abs(o)]})" for o in range(1 - len(side), len(side))]
    return f"{name}(o, w) as (values {', '.join(rows)})"


def _blur(source: str, keys: str, bounds: dict[str, tuple[str, str]], sigmas: dict[str, float], missing: bool) -> list[str]:
    """One pass per axis; ``source`` has keys, x, y, z, v and the bound expressions' columns."""
    parts = []
    for axis, sigma in sigmas.items():
        low, high = bounds[axis]
        parts.append(_weights(f"w{axis}", sigma))
        others = [a for a in "xyz" if a != axis]
        same = " and ".join(f"s.{c} = g.{c}" for c in [*keys.split(", "), *others])
        total = "sum(w)" if missing else "65536"
        target = f"blur{axis}"
        parts.append(
            f"{target} as materialized (select g.* replace (cast(m.v as int) as v) from {source} g join ("
            f"select {', '.join('g.' + c for c in [*keys.split(', '), 'x', 'y', 'z'])}, "
            f"(sum(w * s.v) + {total} // 2) // {total} as v "
            f"from {source} g cross join w{axis} join {source} s on {same} "
            f"and s.{axis} = greatest({low}, least({high}, g.{axis} + o)) group by all) m "
            f"on {' and '.join(f'm.{c} = g.{c}' for c in [*keys.split(', '), 'x', 'y', 'z'])})"
        )
        source = target
    return parts


_TILE_BOUNDS = {a: (f"g.t{a}", f"g.t{a} + 3") for a in "xyz"}


def _gauss_tile(sigmas: tuple[float, float, float]) -> str:
    passes = _blur("voxels", "image_id, name", _TILE_BOUNDS, dict(zip("xyz", sigmas)), False)
    return _voxel_query(*passes, select=f"select {_TEXT_COLUMNS} from blurz")


_LARGE = _TILES.replace("from embeddings", "from embeddings where vec_id % 512 < 384")


def _gauss_seamless(tiles: str = _TILES) -> str:
    bounded = """
limits as (
  select image_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1
  from voxels group by image_id
),
bounded as materialized (select v.*, x0, x1, y0, y1, z0, z1 from voxels v join limits using (image_id))"""
    bounds = {a: (f"g.{a}0", f"g.{a}1") for a in "xyz"}
    passes = _blur("bounded", "image_id", bounds, dict(zip("xyz", SIGMAS)), True)
    return _with(tiles, _VOXELS, bounded, *passes, select=f"select {_TEXT_COLUMNS} from blurz")


def _gauss_strip() -> str:
    strip = """
strip as (
  select image_id, name, tx, ty, tz, x as ox, y as oy, z as oz, x, (z - tz) * 4 + y - ty as y, 0 as z, v from voxels
)"""
    bounds = {"x": ("g.tx", "g.tx + 3"), "y": ("0", "15")}
    passes = _blur("strip", "image_id, name", bounds, dict(zip("xy", SIGMAS)), False)
    return _voxel_query(strip, *passes, select="select image_id, ox as x, oy as y, oz as z, v from blury")


def _gauss_roi(voxels: bool = False) -> str:
    solid = "solid as materialized (select req_id, image_id, x as ox, y as oy, z as oz, width, height, depth, p, px as x, py as y, pz as z, v from assembled)"
    bounds = {
        "x": ("g.ox", "g.ox + g.width - 1"),
        "y": ("g.oy", "g.oy + g.height - 1"),
        "z": ("g.oz", "g.oz + g.depth - 1"),
    }
    passes = _blur("solid", "req_id", bounds, dict(zip("xyz", SIGMAS)), False)
    name = "ox || '-' || (ox + width) || '_' || oy || '-' || (oy + height) || '_' || oz || '-' || (oz + depth)"
    if voxels:
        select = "select cast(req_id as int) as req_id, x, y, z, v from blurz"
        return _voxel_query(_ROI, _ASSEMBLED, solid, *passes, select=select)
    select = f"""
select req_id, image_id, {name} as name, {_HEX.format(v='v', order='p')} as pixels
from blurz group by req_id, image_id, ox, oy, oz, width, height, depth"""
    return _voxel_query(_ROI, _ASSEMBLED, solid, *passes, select=select)


_HIST = "hist as (select image_id, name, z, v, count(*) as n from voxels group by all)"

# One row per slice and occurring grey value, with running sums.
_BINS = """
bins as (
  select image_id, name, z, v, n,
         sum(n) over up as p, sum(n) over whole as pt,
         sum(v * n) over up as s, sum(v * n) over whole as st,
         sum(n * n) over up as q, sum(n * n) over whole as qt,
         sum(n * ln(n)) over up as e, sum(n * ln(n)) over whole as et,
         min(v) over whole as v0, max(v) over whole as v1
  from hist
  window whole as (partition by image_id, name, z),
         up as (partition by image_id, name, z order by v rows between unbounded preceding and current row)
),
split as (select * from bins where p < pt),
dense as (
  select h.image_id, h.name, h.z, g.t, h.pt, h.st,
         sum(case when b.v <= g.t then b.n else 0 end) as p,
         sum(case when b.v <= g.t then b.v * b.n else 0 end) as s
  from (select distinct image_id, name, z, pt, st, v0, v1 from bins) h
  cross join (select unnest(range(256)) as t) g
  join bins b on b.image_id = h.image_id and b.name = h.name and b.z = h.z
  where g.t >= h.v0 and g.t < h.v1
  group by all
)"""

_FLOOR9 = "floor(({0}) * 1e9 + 0.5)"


def _best(score: str, source: str = "split", level: str = "v") -> str:
    """Level of the least score, the smallest level winning a tie."""
    return f"select image_id, name, z, {level} as t from {source} qualify row_number() over (partition by image_id, name, z order by {score}, {level}) = 1"


_LEVELS: dict[str, str] = {
    "default": """
select image_id, name, z,
       coalesce(min(t) filter (where 2 * t * p * (pt - p) >= s * (pt - p) + (st - s) * p), max(t)) as t
from dense group by image_id, name, z""",
    "otsu": _best("-power(cast(st * p - s * pt as double), 2) / cast(p * (pt - p) as double)"),
    "mean": "select distinct image_id, name, z, st // pt as t from bins",
    "percentile": _best("abs(2 * p - pt)"),
    "max_entropy": _best("-" + _FLOOR9.format("ln(p) - e / p + ln(pt - p) - (et - e) / (pt - p)")),
    "yen": _best(
        "-" + _FLOOR9.format("2 * ln(cast(p * (pt - p) as double)) - ln(cast(q * (qt - q) as double))")
    ),
}

# Fuzziness: entropy of C / (C + distance to the rounded class mean).
_LEVELS["huang"] = """
select image_id, name, z, t from (
  select image_id, name, z, t, sum(n * floor((-u * ln(u) - case when u < 1 then (1 - u) * ln(1 - u) else 0 end) * 1e9 + 0.5)) as score
  from (
    select c.image_id, c.name, c.z, c.v as t, h.n,
           cast(c.v1 - c.v0 as double) / (c.v1 - c.v0 + abs(h.v - case when h.v <= c.v
             then (2 * c.s + c.p) // (2 * c.p)
             else (2 * (c.st - c.s) + c.pt - c.p) // (2 * (c.pt - c.p)) end)) as u
    from split c join hist h on h.image_id = c.image_id and h.name = c.name and h.z = c.z)
  group by all)
qualify row_number() over (partition by image_id, name, z order by score, t) = 1"""

# Fixed point of the minimum cross entropy iteration.
_LEVELS["li"] = """
select image_id, name, z, case when bool_or(done) then arg_max(level, i) else min(level) filter (i > 256) end as t from (
  with recursive walk as (
    select distinct image_id, name, z, v0, greatest(v1 - 1, v0) as v2, 0 as i, false as done,
           greatest(v0, least(greatest(v1 - 1, v0), cast(floor(cast(st as double) / pt + 0.5) as bigint))) as level
    from split
    union all
    select image_id, name, z, v0, v2, i + 1, fresh = level, greatest(v0, least(v2, fresh))
    from (
      select w.*, case when d.s > 0 then cast(floor(
               (cast(d.st - d.s as double) / (d.pt - d.p) - cast(d.s as double) / d.p)
               / (ln(cast(d.st - d.s as double) / (d.pt - d.p)) - ln(cast(d.s as double) / d.p)) + 0.5) as bigint) else 0 end as fresh
      from walk w join dense d on d.image_id = w.image_id and d.name = w.name and d.z = w.z and d.t = w.level
      where not w.done and w.i < 512)
  )
  select * from walk)
group by image_id, name, z"""

_LEVELS["triangle"] = """
select image_id, name, z, t from (
  select k.image_id, k.name, k.z, g.t,
         top * abs(foot_v - peak) + (foot_n - top) * abs(g.t - peak) - coalesce(h.n, 0) * abs(foot_v - peak) as score
  from (
    select *, case when v1 - peak >= peak - v0 then v1 else v0 end as foot_v,
              case when v1 - peak >= peak - v0 then n1 else n0 end as foot_n
    from (
      select image_id, name, z, arg_max(v, n * 1000 - v) as peak, max(n) as top, min(v) as v0, max(v) as v1,
             arg_min(n, v) as n0, arg_max(n, v) as n1
      from hist group by image_id, name, z)) k
  cross join (select cast(unnest(range(256)) as int) as t) g
  left join hist h on h.image_id = k.image_id and h.name = k.name and h.z = k.z and h.v = g.t
  where g.t between least(peak, foot_v) and greatest(peak, foot_v))
qualify row_number() over (partition by image_id, name, z order by score desc, t) = 1"""

_LEVELS["min_error"] = """
select b.image_id, b.name, b.z, coalesce(m.t, b.st // b.pt) as t
from (select distinct image_id, name, z, st, pt from bins) b
left join (
  select image_id, name, z, v as t from (
    select *, cast(p as double) / pt as a, cast(pt - p as double) / pt as b from (
      select *, sum(v * v * n) over (partition by image_id, name, z order by v rows between unbounded preceding and current row) as r,
             sum(v * v * n) over (partition by image_id, name, z) as rt
      from bins))
  where p < pt and r * p - s * s > 0 and (rt - r) * (pt - p) - (st - s) * (st - s) > 0
  qualify row_number() over (partition by image_id, name, z order by
    floor((a * ln(cast(r * p - s * s as double) / (p * p)) - 2 * a * ln(a)
         + b * ln(cast((rt - r) * (pt - p) - (st - s) * (st - s) as double) / ((pt - p) * (pt - p))) - 2 * b * ln(b)) * 1e9 + 0.5), v) = 1
) m using (image_id, name, z)"""

_LEVELS["moments"] = """
select k.image_id, k.name, k.z, min(b.v) as t
from (
  select *, (sqrt(c1 * c1 - 4 * c0) - c1) / 2 as high, sqrt(c1 * c1 - 4 * c0) as root from (
    select *, (m1 * m3 - m2 * m2) / (m2 - m1 * m1) as c0, (m1 * m2 - m3) / (m2 - m1 * m1) as c1 from (
      select image_id, name, z,
             sum(v * n) / cast(sum(n) as double) as m1,
             sum(v * v * n) / cast(sum(n) as double) as m2,
             sum(v * v * v * n) / cast(sum(n) as double) as m3
      from hist group by image_id, name, z having count(*) > 1))) k
join split b on b.image_id = k.image_id and b.name = k.name and b.z = k.z
where cast(b.p as double) / b.pt >= (high - m1) / root - 1e-9
group by k.image_id, k.name, k.z"""

_LEVELS["shanbhag"] = """
select image_id, name, z, t from (
  select image_id, name, z, t,
         abs(sum(case when v <= t and v > 0 then -f * ln(1 - 0.5 / a * before) * 0.5 / a else 0 end)
           - sum(case when v > t then -f * ln(1 - 0.5 / b * after) * 0.5 / b else 0 end)) as score
  from (
    select c.image_id, c.name, c.z, c.v as t, cast(c.p as double) / c.pt as a, cast(c.pt - c.p as double) / c.pt as b,
           h.v, cast(h.n as double) / h.pt as f, cast(h.p - h.n as double) / h.pt as before, cast(h.pt - h.p as double) / h.pt as after
    from split c join bins h on h.image_id = c.image_id and h.name = c.name and h.z = c.z)
  group by all)
qualify row_number() over (partition by image_id, name, z order by floor(score * 1e9 + 0.5), t) = 1"""


# Two peaks of the histogram, smoothed by a three-point mean until not more are left.
_SMOOTHED = """
with recursive dense_counts as (
  select k.image_id, k.name, k.z, k.st, k.pt, list(cast(coalesce(h.n, 0) as double) order by g.v) as h
  from (select distinct image_id, name, z, st, pt from bins) k
  cross join (select cast(unnest(range(256)) as int) as v) g
  left join hist h on h.image_id = k.image_id and h.name = k.name and h.z = k.z and h.v = g.v
  group by k.image_id, k.name, k.z, k.st, k.pt
),
walk as (
  select *, 0 as i from dense_counts
  union all
  select image_id, name, z, st, pt,
         list_transform(range(1, 257), lambda k: (coalesce(case when k > 1 then h[k - 1] end, 0) + h[k] + coalesce(h[k + 1], 0)) / 3), i + 1
  from walk
  where len(list_filter(range(2, 256), lambda k: h[k] - h[k - 1] > list_max(h) / 1e9 and h[k] - h[k + 1] > list_max(h) / 1e9)) > 2
),
modes as (
  select *, list_filter(range(2, 256), lambda k: h[k] - h[k - 1] > list_max(h) / 1e9 and h[k] - h[k + 1] > list_max(h) / 1e9) as peaks
  from (select image_id, name, z, st, pt, arg_max(h, i) as h from walk group by all)
)"""
_LEVELS["intermodes"] = f"""
select * from ({_SMOOTHED}
  select image_id, name, z, case when len(peaks) = 2 then (peaks[1] + peaks[2] - 2) // 2 else st // pt end as t from modes)"""
_LEVELS["minimum"] = f"""
select * from ({_SMOOTHED}
  select image_id, name, z, case when len(peaks) = 2 then peaks[1] - 2 + list_position(
           list_transform(h[peaks[1] : peaks[2]], lambda x: floor(x / (list_max(h) / 1e9) + 0.5)),
           list_min(list_transform(h[peaks[1] : peaks[2]], lambda x: floor(x / (list_max(h) / 1e9) + 0.5)))) else st // pt end as t
  from modes)"""


def _order_level(alpha: float) -> str:
    power = f"power(cast(n as double), {alpha})"
    score = (
        f"-floor((ln(r) + ln(rt - r) - {alpha} * (ln(p) + ln(pt - p))) / (1 - {alpha}) * 1e9 + 0.5)"
    )
    return f"""
select image_id, name, z, v as t from (
  select *, sum({power}) over (partition by image_id, name, z order by v rows between unbounded preceding and current row) as r,
         sum({power}) over (partition by image_id, name, z) as rt
  from bins)
where p < pt
qualify row_number() over (partition by image_id, name, z order by {score}, v) = 1"""


_LEVELS["renyi_entropy"] = f"""
select image_id, name, z,
       cast(floor(t1 * (f1 + (f3 - f1) / 4 * b1) + t2 * (f3 - f1) / 4 * b2 + t3 * (1 - f3 + (f3 - f1) / 4 * b3) + 1e-9) as int) as t
from (
  select *,
         case when near1 = near2 then 1 when near1 then 0 else 3 end as b1,
         case when near1 = near2 then 2 else 1 end as b2,
         case when near1 = near2 then 1 when near1 then 3 else 0 end as b3
  from (
    select l.image_id, l.name, l.z, l.t[1] as t1, l.t[2] as t2, l.t[3] as t3,
           l.t[2] - l.t[1] <= 5 as near1, l.t[3] - l.t[2] <= 5 as near2,
           cast(x1.p as double) / x1.pt as f1, cast(x3.p as double) / x3.pt as f3
    from (
      select image_id, name, z, list_sort(list(t)) as t from (
        ({_order_level(0.5)}) union all ({_LEVELS["max_entropy"]}) union all ({_order_level(2.0)}))
      group by image_id, name, z) l
    join bins x1 on x1.image_id = l.image_id and x1.name = l.name and x1.z = l.z and x1.v = l.t[1]
    join bins x3 on x3.image_id = l.image_id and x3.name = l.name and x3.z = l.z and x3.v = l.t[3]))"""


def _level_parts(key: str) -> str:
    """Threshold per slice; a slice of one grey value keeps that value."""
    return f"""
chosen_{key} as ({_LEVELS[key]}),
level_{key} as (
  select h.image_id, h.name, h.z, cast(case when h.v0 = h.v1 then h.v0 else c.t end as int) as t
  from (select image_id, name, z, min(v) as v0, max(v) as v1 from hist group by all) h
  left join chosen_{key} c on c.image_id = h.image_id and c.name = h.name and c.z = h.z
)"""


def _threshold(key: str) -> str:
    select = f"""
select v.image_id, v.x, v.y, v.z, cast(case when v.v > l.t then 255 else 0 end as int) as v
from voxels v join level_{key} l on l.image_id = v.image_id and l.name = v.name and l.z = v.z"""
    return _voxel_query(_HIST, _BINS, _level_parts(key), select=select)


def _threshold_levels(zooms: str = "1") -> str:
    keys = ["default", "otsu", "mean", "percentile", "max_entropy", "yen", "triangle"]
    columns = ", ".join(f"level_{k}.t as t_{k.replace('_', '')}" for k in keys)
    joins = " ".join(f"join level_{k} using (image_id, name, z)" for k in keys[1:])
    select = f"select image_id, unnest([{zooms}]) as zoom_out, name, z, {columns} from level_{keys[0]} {joins}"
    return _voxel_query(_HIST, _BINS, *[_level_parts(k) for k in keys], select=select)


# Slices of 4 get a canvas of 8.

def _factor(stripes: str, row: str, col: str, n: str = "8") -> str:
    near_row, near_col = f"least({row}, {n} - {row})", f"least({col}, {n} - {col})"
    radius = f"({near_row} * {near_row} + {near_col} * {near_col})"
    text = f"(1 - exp(-{radius} * power(2 * 40.1 / {n}, 2))) * exp(-{radius} * power(2 * 3.0 / {n}, 2))"
    if stripes != "none":
        line = near_col if stripes == "horizontal" else near_row
        text += f" * (1 - exp(-{line} * {line} * 0.95 * 0.95))"
    return f"case when {row} = 0 and {col} = 0 then 1.0 else {text} end"


_MIRROR = """
mirror as (
  select k, case when u < 4 then u else 7 - u end as i
  from (select cast(unnest(range(8)) as int) as k, (unnest(range(8)) - 2 + 8) % 8 as u)
)"""


def _bandpass_parts(stripes: str, keys: str) -> str:
    return f"""
grid as (
  select a.k as fr, b.k as fc, {_factor(stripes, 'a.k', 'b.k')} as f from mirror a cross join mirror b
),
response as (
  select a.k as dr, b.k as dc, sum(f * cos(2 * pi() * (fr * a.k + fc * b.k) / 8)) / 64 as r
  from grid cross join mirror a cross join mirror b group by all
),
weights as (
  select oy, ox, a.i as iy, b.i as ix, sum(r) as w
  from (select unnest(range(4)) as oy) cross join (select unnest(range(4)) as ox) cross join mirror a cross join mirror b
  join response on dr = (oy + 2 - a.k + 8) % 8 and dc = (ox + 2 - b.k + 8) % 8
  group by all
),
filtered as (
  select {keys}, ox, oy, sum(w * v) as f
  from voxels join weights on iy = y - ty and ix = x - tx group by all
),
ranged as (
  select *, min(f) over (partition by image_id, name, z) as lo, max(f) over (partition by image_id, name, z) as hi from filtered
)"""


def _bandpass_select(top: int) -> str:
    return f"""
select image_id, cast(tx + ox as int) as x, cast(ty + oy as int) as y, z,
       cast(floor(greatest(0, least({top}, case when hi - lo > 1e-6 then (f - lo) / (hi - lo) * {top} else f end)) + 0.5) as int) as v
from ranged"""


def _bandpass(stripes: str) -> str:
    return _voxel_query(_MIRROR, _bandpass_parts(stripes, "image_id, name, tx, ty, z"), select=_bandpass_select(255))


# The tiles in 16 bits; a fifth of them also with zoom 2.
_DEEP = _VOXELS.replace("* 127.5", "* 32767.5").replace("least(255", "least(65535").replace("select image_id, name,", "select image_id, vec_id, name,")
_DEEP_TILES = _TILES.replace("select cast(1 + vec_id // 512 as int) as image_id", "select vec_id, cast(1 + vec_id // 512 as int) as image_id")


def _deep_query(*parts: str, source: str, voxels: str = _DEEP) -> str:
    zooms = f"zoomed as (select r.*, zoom_out from ({source}) r, (values (1), (2)) as o(zoom_out) where zoom_out = 1 or vec_id % 5 = 0)"
    return _with(_DEEP_TILES, voxels, *parts, zooms, select="select image_id, zoom_out, x, y, z, cast(v as double) as v from zoomed")


def _deep_queries() -> dict[str, str]:
    ends = "min(v) over (partition by image_id, name, z) as lo, max(v) over (partition by image_id, name, z) as hi"
    numbered = "row_number() over (partition by image_id, name, z order by v) as nth"
    # 25 % of 16 pixels: two are left out at each end
    cut = f"max(v) filter (nth = {1 + int(16 * SATURATED / 200)}) over w as lo, max(v) filter (nth = {16 - int(16 * SATURATED / 200)}) over w as hi"

    def spread(top: int, bounds: str) -> str:
        grey = "greatest(0, least(hi - lo, v - lo))"
        value = f"case when hi > lo then (2 * {top} * {grey} + (hi - lo)) // (2 * (hi - lo)) else least(v, {top}) end"
        return f"select image_id, vec_id, x, y, z, cast({value} as bigint) as v from (select *, {bounds} from deep window w as (partition by image_id, name, z))"

    deep = f"deep as (select *, {numbered} from voxels)"
    bins = f"bins16 as (select *, (v - lo) * 256 // greatest(256, hi - lo + 1) as bin from (select *, {ends} from voxels))"
    hist = _HIST.replace("z, v, count(*) as n from voxels", "z, bin as v, count(*) as n from bins16")
    set_above = """
select v.image_id, v.vec_id, v.x, v.y, v.z, case when v.bin > l.t then 255 else 0 end as v
from bins16 v join level_otsu l on l.image_id = v.image_id and l.name = v.name and l.z = v.z"""
    passes = _blur("voxels", "image_id, name", _TILE_BOUNDS, dict(zip("xyz", SIGMAS)), False)
    filtered = _bandpass_parts("none", "image_id, vec_id, name, tx, ty, z")
    band = _bandpass_select(65535).replace("select image_id,", "select image_id, vec_id,")
    histogram = "zooms as (select * from (values (1), (2)) as o(zoom_out))"
    return {
        "gauss3d_16bit": _deep_query(*passes, source="select * from blurz"),
        "contrast_stretch_16bit": _deep_query(deep, source=spread(65535, cut)),
        "convert_16_to_8bit": _deep_query(deep, source=spread(255, "min(v) over w as lo, max(v) over w as hi")),
        "threshold_16bit": _deep_query(bins, hist, _BINS, _level_parts("otsu"), source=set_above),
        "bandpass_16bit": _deep_query(_MIRROR, filtered, source=band),
        "histogram_16bit": _with(
            _DEEP_TILES, _DEEP, histogram,
            select="select image_id, zoom_out, name, z, cast(v as double) as v, count(*) as n from voxels, zooms where zoom_out = 1 or vec_id % 5 = 0 group by image_id, zoom_out, name, z, v",
        ),
    }


def _filter_grid() -> str:
    rows = " union all ".join(
        f"select canvas, r as row, c as col, '{s}' as stripes, round({_factor(s, 'r', 'c', 'canvas')}, 6) as factor from cells"
        for s in ("none", "horizontal", "vertical")
    )
    cells = """
cells as (
  select canvas, r, unnest(range(canvas)) as c from (
    select canvas, unnest(range(canvas)) as r from (select distinct cast(8 as bigint) as canvas from tiles)))"""
    return _with(_TILES, cells, select=rows)


_PATTERN = r"^(-?\d+)-(-?\d+)_(-?\d+)-(-?\d+)_(-?\d+)-(-?\d+)$"


def _name_parse() -> str:
    fields = ", ".join(f"try_cast(regexp_extract(name, '{_PATTERN}', {i + 1}) as int) as f{i}" for i in range(6))
    select = f"""
select path, name, valid,
       case when valid then f0 end as x, case when valid then f2 end as y, case when valid then f4 end as z,
       case when valid then f1 - f0 end as x_dim, case when valid then f3 - f2 end as y_dim, case when valid then f5 - f4 end as z_dim
from (
  select *, coalesce(f1 > f0 and f3 > f2 and f5 > f4, false) as valid
  from (select path, name, {fields} from (
    select path, regexp_replace(string_split(path, '/')[-1], '\\.jpg$', '') as name from (
      select '/volume/tiles/' || (x - 16) || '-' || (x - 12) || '_' || (y - 16) || '-' || (y - 12) || '_' || (z - 16) || '-' || (z - 12) || '.jpg' as path
      from tiles
      union all select url from pages))))"""
    return _with(_TILES, select=select)


def _slices(where: str) -> str:
    return _voxel_query(
        select=f"select image_id, name, z, {_HEX.format(v='v', order='p')} as pixels from voxels {where} group by image_id, name, z"
    )


def _words(word: str) -> str:
    return f"""
select word, count(*) as n
from (select unnest(regexp_split_to_array({word}, '[ \\t\\n\\r\\f\\x0B]+')) as word from documents)
where word <> '' group by word"""


def _register() -> str:
    """Phase correlation of 4x4 planes by direct sums."""
    planes = """
planes as (
  select image_id, axis, case when axis = 'x' and up = 0 then tx + 4 else tx end as x,
         case when axis = 'y' and up = 0 then ty + 4 else ty end as y,
         case when axis = 'z' and up = 0 then tz + 4 else tz end as z, up, r, c, v
  from (
    select image_id, tx, ty, tz, 'x' as axis, case when x - tx = 3 then 0 else 1 end as up, z - tz as r, y - ty as c, v from voxels where x - tx in (0, 3)
    union all
    select image_id, tx, ty, tz, 'y', case when y - ty = 3 then 0 else 1 end, z - tz, x - tx, v from voxels where y - ty in (0, 3)
    union all
    select image_id, tx, ty, tz, 'z', case when z - tz = 3 then 0 else 1 end, y - ty, x - tx, v from voxels where z - tz in (0, 3))
),
k as (select cast(unnest(range(4)) as int) as i),
spectrum as (
  select image_id, axis, x, y, z, up, fr.i as fr, fc.i as fc,
         sum(v * cos(pi() / 2 * (r * fr.i + c * fc.i))) as re, -sum(v * sin(pi() / 2 * (r * fr.i + c * fc.i))) as im
  from planes cross join k fr cross join k fc group by all
),
crossed as (
  select a.image_id, a.axis, a.x, a.y, a.z, a.fr, a.fc,
         a.re * b.re + a.im * b.im as re, a.re * b.im - a.im * b.re as im
  from spectrum a join spectrum b using (image_id, axis, x, y, z, fr, fc) where a.up = 0 and b.up = 1
),
phase as (
  select *, sqrt(re * re + im * im) as m from crossed
),
surface as (
  select image_id, axis, x, y, z, sr.i as sr, sc.i as sc,
         round(sum(case when m > 1e-6 then (re * cos(pi() / 2 * (fr * sr.i + fc * sc.i)) - im * sin(pi() / 2 * (fr * sr.i + fc * sc.i))) / m else 0 end) / 16, 6) as peak
  from phase cross join k sr cross join k sc group by all
)"""
    select = """
select image_id, 1 as zoom_out, axis, x, y, z,
       cast(case when sr > 2 then sr - 4 else sr end as int) as shift_row, cast(case when sc > 2 then sc - 4 else sc end as int) as shift_col, peak
from surface qualify row_number() over (partition by image_id, axis, x, y, z order by peak desc, sr, sc) = 1"""
    return _voxel_query(planes, select=select)


def _register_stacks() -> str:
    """The places beside which the tiles were cut, as seen from the tile with the least name."""
    moves = ", ".join(f"greatest(0, least(16, p{a} + (n * {f} + image_id) % 3 - 1)) - p{a} as m{a}" for a, f in zip("xyz", (4, 5, 7)))
    places = ", ".join(f"n // {d} % 3 * 8 as p{a}" for a, d in zip("xyz", (1, 3, 9)))
    name = " || '_' || ".join(f"p{a} || '-' || (p{a} + 16)" for a in "xyz")
    offsets = ", ".join(f"cast(m{a} - first(m{a}) over (partition by image_id order by name) as double) as d{a}" for a in "xyz")
    select = f"""
select image_id, 1 as zoom_out, name, {offsets}
from (select *, {name} as name, {moves} from (select image_id, n, {places} from (select distinct image_id from tiles), (select unnest(range(27)) as n)))"""
    return _with(_TILES, select=select)


def oracle_sql() -> dict[str, str]:
    pair_columns = "req_id, image_id, name, x, y, z"
    found = {
        "tile_name_parse": _name_parse(),
        "tile_name_format": _with(_ROI, select=f"select req_id, {_ROI_NAME} as name from roi"),
        "tile_slices": _slices(""),
        "tile_flatten": _voxel_query(
            select=f"""
select image_id, ox as x, oy as y, oz as z, {_HEX.format(v='coalesce(v, 0)', order='q')} as pixels
from (
  select k.*, o.v from (
    select *, cast(unnest(range(512)) as int) as q from (
      select distinct image_id, x // 8 * 8 as ox, y // 8 * 8 as oy, z // 8 * 8 as oz from voxels)) k
  left join voxels o on o.image_id = k.image_id and o.x = ox + q % 8 and o.y = oy + (q // 8) % 8 and o.z = oz + q // 64)
group by image_id, ox, oy, oz"""
        ),
        "voxel_explode": _voxel_query(select=f"select {_TEXT_COLUMNS} from voxels"),
        "strip_layout": _voxel_query(
            select="select image_id, name, cast((z - tz) * 4 + y - ty as int) as row, cast(x - tx as int) as col, v from voxels"
        ),
        "last_slice": _slices("where z = tz + 3"),
        "tile_extents": _with(
            _TILES,
            select="select image_id, name, x, y, z, cast(x + 4 as bigint) as x_end, cast(y + 4 as bigint) as y_end, cast(z + 4 as bigint) as z_end from tiles",
        ),
        "pixels_csv": _voxel_query(
            select="select image_id, name, string_agg(cast(v as varchar), ',' order by p) as csv from voxels group by image_id, name"
        ),
        "tile_sizes": _with(_TILES, select="select image_id, name, cast(len(embedding) as int) as n_bytes from tiles"),
        "slice_flip": _voxel_query(
            select="select image_id, cast(tx + 3 - (x - tx) as int) as x, cast(ty + 3 - (y - ty) as int) as y, z, v from voxels"
        ),
        "roi_requests": _with(
            _ROI,
            select="""
select req_id, image_id, zoom_out, x, y, z, case when p_size > 45 then null else width end as width, height, depth,
       p_size <= 45 as valid
from roi join part on p_partkey = req_id""",
        ),
        "roi_join": _with(_TILES, _ROI, _STRICT, select=f"select {pair_columns} from pairs"),
        "roi_join_touching": _with(_TILES, _ROI, _INCLUSIVE, select=f"select {pair_columns} from pairs"),
        "roi_join_grid": _with(_TILES, _ROI, _STRICT, select=f"select {pair_columns} from pairs"),
        "pix_by_place": _with(_TILES, _ROI, _STRICT, select=f"select {pair_columns} from pairs"),
        "pix_regions": _with(_TILES, select=_REGIONS),
        "roi_first_tile": _with(
            _TILES, _ROI, _STRICT,
            select=f"select {pair_columns} from pairs qualify row_number() over (partition by req_id order by z, y, x) = 1",
        ),
        "roi_assemble": _voxel_query(
            _ROI, _ASSEMBLED,
            select=f"""
select req_id, image_id, {_ROI_NAME} as name, 1 as zoom_out, x, y, z, width as x_dim, height as y_dim, depth as z_dim,
       {_HEX.format(v='v', order='p')} as pixels
from assembled group by req_id, image_id, x, y, z, width, height, depth""",
        ),
        "roi_gauss": _gauss_roi(),
        "roi_gauss_blocks": _gauss_roi(voxels=True),
        "request_count": _with(_ROI, select="select image_id, count(*) as n from roi group by image_id"),
        "word_count": _words("text"),
        "word_count_ci": _words("lower(text)"),
        "tiles_zyx_rank": _with(
            _TILES,
            select="select image_id, name, row_number() over (order by z, y, x, image_id, name) as rank from tiles",
        ),
        "tiles_name_rank": _with(
            _TILES, select="select image_id, name, row_number() over (order by name, image_id) as rank from tiles"
        ),
        "pix_append": _with(
            _TILES,
            select="""
select cast(image_id + d as int) as image_id, name, 1 as zoom_out, x, y, z, 4 as x_dim, 4 as y_dim, 4 as z_dim
from tiles cross join (values (0), (1000)) o(d)""",
        ),
        "pix_log": _with(
            _TILES,
            select="""
select image_id, name || case when image_id % 2 = 1 and x < 16 then '' else '!' end as name, 1 as zoom_out, x, y, z, 4 as x_dim, 4 as y_dim, 4 as z_dim
from tiles""",
        ),
        "image_register": _with(
            _TILES, select="select distinct image_id as id, 'image-' || image_id as name from tiles"
        ),
        "slice_histogram": _voxel_query(_HIST, select="select *, 1 as zoom_out from hist"),
        "contrast_range": _voxel_query(
            _HIST,
            select=f"""
select image_id, 1 as zoom_out, name, z, min(v) filter (where below > cut) as lo, max(v) filter (where above > cut) as hi
from (
  select *, floor(total * {SATURATED} / 200) as cut from (
    select *, sum(n) over (partition by image_id, name, z order by v) as below,
           sum(n) over (partition by image_id, name, z order by v desc) as above,
           sum(n) over (partition by image_id, name, z) as total
    from hist))
group by image_id, name, z""",
        ),
        "contrast_stretch": _voxel_query(
            select="""
select image_id, x, y, z, cast(case when hi = lo then v else (2 * (v - lo) * 255 + (hi - lo)) // (2 * (hi - lo)) end as int) as v
from (select *, min(v) over (partition by image_id, name, z) as lo, max(v) over (partition by image_id, name, z) as hi from voxels)"""
        ),
        "gauss3d_tile": _gauss_tile(SIGMAS),
        "gauss3d_seamless": _gauss_seamless(),
        "gauss3d_borders": _gauss_seamless(_LARGE),
        "gauss_strip2d": _gauss_strip(),
        "gauss3d_iso": _gauss_tile((1.0, 1.0, 1.0)),
        "fft_pad_size": _with(
            _ROI,
            select="""
select req_id, width, height, (select min(n) from (select cast(power(2, unnest(range(1, 31))) as bigint) as n) where 2 * n >= 3 * greatest(width, height)) as pad_size
from roi""",
        ),
        "mirror_pad": _voxel_query(
            _MIRROR,
            select="""
select image_id, name, z, a.k as row, b.k as col, v
from voxels join mirror a on a.i = y - ty join mirror b on b.i = x - tx""",
        ),
        "bandpass_filter_grid": _filter_grid(),
        "bandpass": _bandpass("none"),
        "bandpass_horizontal": _bandpass("horizontal"),
        "bandpass_vertical": _bandpass("vertical"),
        "threshold_levels": _threshold_levels(),
        "levels_of_copies": _threshold_levels("1, 2"),
        "plugin_filter": _voxel_query(select="select image_id, x, y, z, cast(255 - v as int) as v from voxels"),
        "color_invert": _voxel_query(_COLORS, select=_INVERTED),
        "register_pairs": _register(),
        "register_stacks": _register_stacks(),
    }
    found |= _deep_queries()
    for key in _CATALOGUE:
        if key in _LEVELS:
            found[f"threshold_{key}"] = _threshold(key)
    return found
