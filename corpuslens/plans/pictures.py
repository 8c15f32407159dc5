"""Queries over pictures, with their SQL twins: each supplier's line items, counted into a grid of pixels, are a picture."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corpuslens.operators import pixels
from corpuslens.session import table


def _pixels(s, d, width=12, height=10):
    key = [F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") % width).cast("int").alias("x"), (F.col("l_orderkey") % height).cast("int").alias("y")]
    return table(s, d, "lineitem").groupBy(*key).agg(
        (F.sum("l_linenumber") * 37 % 256).cast("int").alias("r"),
        (F.sum("l_partkey") % 256).cast("int").alias("g"),
        (F.count("*") * 53 % 256).cast("int").alias("b"),
    )


def _focus(s, d):
    return pixels.focus_region(_pixels(s, d), 4).withColumn("energy", F.round("energy", 4))


def _curve(s, d):
    """A table of nine squares for all three channels."""
    square = (F.col("id") * F.col("id") * (255 / 64)).cast("double")
    lut = s.range(9).select(F.col("id").alias("i"), *(square.alias(c) for c in "rgb"))
    return pixels.apply_lut(_pixels(s, d), lut, 9, kind="1D").withColumns({c: F.round(c, 6) for c in ("lr", "lg", "lb")})


QUERIES = {
    "g12_sharpness": lambda s, d: pixels.sharpness(_pixels(s, d)),
    "g13_focus_region": _focus,
    "g14_phash": lambda s, d: pixels.phash(_pixels(s, d, 32, 32)),
    "g16_apply_curve": _curve,
}


def _pixels_sql(width: int = 12, height: int = 10) -> str:
    r, g, b = pixels.WEIGHTS
    return f"""p as (
  select l_suppkey as image_id, l_partkey % {width} as x, l_orderkey % {height} as y, cast(sum(l_linenumber) * 37 % 256 as double) as r,
    cast(sum(l_partkey) % 256 as double) as g, cast(count(*) * 53 % 256 as double) as b
  from lineitem group by all),
l as (select *, {r}::double * r + {g}::double * g + {b}::double * b as lum from p)"""


_EDGES = """e as (
  select l.image_id, l.x, l.y, l.lum, w.lum + e.lum + n.lum + s.lum - 4 * l.lum as lap
  from l
  left join l w on w.image_id = l.image_id and w.y = l.y and w.x = l.x - 1 left join l e on e.image_id = l.image_id and e.y = l.y and e.x = l.x + 1
  left join l n on n.image_id = l.image_id and n.x = l.x and n.y = l.y - 1 left join l s on s.image_id = l.image_id and s.x = l.x and s.y = l.y + 1)"""

_COSINE = " ".join(f"when {k} then [{', '.join(repr(math.cos(math.pi * k * (2 * x + 1) / 64)) for x in range(32))}]" for k in range(8))
_SHARPNESS = "case " + " ".join(f"when score < {top} then '{name}'" for top, name in pixels.LABELS) + " end"

ORACLE = {
    "g12_sharpness": f"""with {_pixels_sql()}, {_EDGES},
s as (select image_id, cast(floor(100 * (1 - exp(-0.35 * (coalesce(avg(lap * lap), 0) / (var_pop(lum) + 1)))) + 0.5) as int) as score from e group by 1)
select image_id, score, {_SHARPNESS} as label from s""",
    "g13_focus_region": f"""with {_pixels_sql()}, {_EDGES},
c as (select image_id, x // 4 as cx, y // 4 as cy, round(coalesce(avg(lap * lap), 0), 9) as energy from e group by all),
r as (select *, row_number() over (partition by image_id order by energy desc, cy, cx) as r from c)
select image_id, cast(case when energy > 0 then cx else 0 end as int) as cell_x, cast(case when energy > 0 then cy else 0 end as int) as cell_y, round(energy, 4) as energy,
  case when energy > 0 then cx else 0 end * 4 + 2.0::double as center_x, case when energy > 0 then cy else 0 end * 4 + 2.0::double as center_y
from r where r = 1""",
    "g14_phash": f"""with {_pixels_sql(32, 32)}, k as (select unnest(range(8)) as k), w as (select k, case k {_COSINE} end as c from k),
s as (select image_id, v.k * 8 + u.k as i, round(sum(lum * u.c[x + 1] * v.c[y + 1]), 6) as s from l cross join w u cross join w v group by all),
m as (select image_id, list(s order by i) as c, list_sort(list(s))[33] as mid from s group by 1),
h as (select image_id, unnest(range(16)) as j, c, mid from m)
select image_id, string_agg(printf('%x', cast((c[4 * j + 1] > mid) as int) * 8 + cast((c[4 * j + 2] > mid) as int) * 4 + cast((c[4 * j + 3] > mid) as int) * 2 + cast((c[4 * j + 4] > mid) as int)), '' order by j) as phash
from h group by 1""",
    "g16_apply_curve": f"""with {_pixels_sql()}, q as (select unnest(range(9)) as i),
t as (select list(i * i * 255 / 64.0::double order by i) as t from q)
select image_id, cast(x as int) as x, cast(y as int) as y, cast(r as int) as r, cast(g as int) as g, cast(b as int) as b, {", ".join(f"round(t[cast(floor({c} / 255 * 8) as int) + 1] * (1 - ({c} / 255 * 8 - floor({c} / 255 * 8))) + t[least(cast(floor({c} / 255 * 8) as int) + 2, 9)] * ({c} / 255 * 8 - floor({c} / 255 * 8)), 6) as l{c}" for c in "rgb")}
from p cross join t""",
}
