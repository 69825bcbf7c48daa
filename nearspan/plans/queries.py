"""Queries over the driver's tables, one or more for each operator, and their SQL.

Structures come from ``embeddings``: a label is a structure, ten times the first
three components are a point, one triclinic cell serves all, and the label's low
bits say which axes are periodic. The SQL knows nothing of wraps, duals or bins:
it tries all shifts in a wide range by the direct formula.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspan import functions as fn
from nearspan import sources
from nearspan.operators import aggregates, checks, sampling, transform
from nearspan.operators.geometry import image_table, with_geometry
from nearspan.operators.neighbors import neighbor_pairs, project

CELL = ((4.0, 0.0, 0.0), (0.5, 5.0, 0.0), (0.25, 0.5, 6.0))
NEAR, FAR = 1.5, 4.5
SEED = 20260809
SCALARS = ["structure_id", "i", "j", "sx", "sy", "sz"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return _read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("structure_id"), F.col("vec_id").alias("atom_id"), *((e[k].cast("double") * 10).alias(x) for k, x in enumerate("xyz")))


def structures_of(spark: SparkSession, sf_dir: str, periodic: bool = True) -> DataFrame:
    labels = _read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("structure_id")).distinct()
    cell = F.array(*(F.array(*map(F.lit, row)) for row in CELL))
    bits = F.array(*((F.col("structure_id").bitwiseAND(1 << k) > 0) & F.lit(periodic) for k in range(3)))
    return labels.select("structure_id", cell.alias("cell"), bits.alias("pbc"))


def _pairs(spark, sf_dir, cutoff=NEAR, periodic=True, **options) -> DataFrame:
    return neighbor_pairs(atoms_of(spark, sf_dir), structures_of(spark, sf_dir, periodic), cutoff, **options)


def _atoms_sql(x: str = "") -> str:
    columns = ", ".join(f"cast(embedding[{k + 1}] as double) * 10 as {x}" for k, x in enumerate("xyz"))
    return f"select cast(label as bigint) as structure_id, vec_id as atom_id, {columns} from embeddings"


def _pairs_sql(cutoff: float, half: bool = False, selves: bool = False, periodic: bool = True, reach: int = 6, atoms: str | None = None, columns: str = "d", where: str = "true") -> str:
    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = CELL
    shift = " ".join(f"join n as n{a} on {'true' if periodic else 'false'} and (s.structure_id & {1 << k}) > 0 or n{a}.v = 0" for k, a in enumerate("abc"))
    if not periodic:
        shift = " ".join(f"join n as n{a} on n{a}.v = 0" for a in "abc")
    kept = {
        (False, False): "not zero", (False, True): "true",
        (True, False): "not zero and (i < j or i = j and (sx < 0 or sx = 0 and (sy < 0 or sy = 0 and sz <= 0)))",
        (True, True): "zero or i < j or i = j and (sx < 0 or sx = 0 and (sy < 0 or sy = 0 and sz <= 0))",
    }[half, selves]
    out = {"d": "sqrt(d2) as d", "D": "dx, dy, dz", "": ""}[columns]
    return f"""
with a as ({atoms or _atoms_sql()}), n as (select unnest(range({-reach}, {reach + 1})) as v),
p as (
    select s.structure_id, s.atom_id as i, t.atom_id as j, cast(na.v as integer) as sx, cast(nb.v as integer) as sy, cast(nc.v as integer) as sz,
        (((t.x - s.x) + na.v::double * {ax}::double) + nb.v::double * {bx}::double) + nc.v::double * {cx}::double as dx,
        (((t.y - s.y) + na.v::double * {ay}::double) + nb.v::double * {by}::double) + nc.v::double * {cy}::double as dy,
        (((t.z - s.z) + na.v::double * {az}::double) + nb.v::double * {bz}::double) + nc.v::double * {cz}::double as dz
    from a s join a t using (structure_id) {shift}
), q as (select *, (dx * dx + dy * dy) + dz * dz as d2, i = j and sx = 0 and sy = 0 and sz = 0 as zero from p),
pairs as (select * from q where (zero or d2 < {cutoff * cutoff!r}::double) and ({kept}))
select structure_id, i, j, sx, sy, sz{', ' + out if out else ''} from pairs where {where}
"""


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


@query(_pairs_sql(NEAR, periodic=False))
def nl_finite_full(spark, sf_dir):
    return _pairs(spark, sf_dir, periodic=False).select(*SCALARS, "d")


@query(_pairs_sql(NEAR))
def nl_periodic_full(spark, sf_dir):
    return _pairs(spark, sf_dir).select(*SCALARS, "d")


@query(_pairs_sql(NEAR, half=True))
def nl_periodic_half(spark, sf_dir):
    return _pairs(spark, sf_dir, half_list=True).select(*SCALARS, "d")


@query(_pairs_sql(NEAR, selves=True))
def nl_periodic_full_self(spark, sf_dir):
    return _pairs(spark, sf_dir, include_self=True).select(*SCALARS, "d")


@query(_pairs_sql(NEAR, half=True, selves=True))
def nl_periodic_half_self(spark, sf_dir):
    return _pairs(spark, sf_dir, half_list=True, include_self=True).select(*SCALARS, "d")


@query(_pairs_sql(FAR))
def nl_periodic_multi_image(spark, sf_dir):
    return _pairs(spark, sf_dir, FAR).select(*SCALARS, "d")


@query(_pairs_sql(NEAR))
def nl_brute_forced(spark, sf_dir):
    return _pairs(spark, sf_dir, algorithm="brute_force").select(*SCALARS, "d")


@query(_pairs_sql(NEAR))
def nl_cells_forced(spark, sf_dir):
    return _pairs(spark, sf_dir, algorithm="cell_list").select(*SCALARS, "d")


@query(_pairs_sql(NEAR))
def nl_auto(spark, sf_dir):
    """A low bound makes structures of both ways of searching."""
    return _pairs(spark, sf_dir, most_whole=60).select(*SCALARS, "d")


@query(_pairs_sql(NEAR, columns="D"))
def nl_displacements(spark, sf_dir):
    return _pairs(spark, sf_dir).select(*SCALARS, "dx", "dy", "dz")


@query(_pairs_sql(NEAR, columns=""))
def nl_sorted(spark, sf_dir):
    return _pairs(spark, sf_dir, sorted=True, cpu_threads=4).select(*SCALARS)


@query(f"select i, j, i as i_2, sx, d as distance from ({_pairs_sql(NEAR)})")
def nl_quantities(spark, sf_dir):
    return project(_pairs(spark, sf_dir), "ijSdi").select("i", "j", "i_2", F.col("shift")[0].alias("sx"), "distance")


_MOVED = f"""select structure_id, atom_id, x + k * 4.0::double as x, y + 0 * k as y, z + 0 * k as z
from (select *, case when structure_id & 1 > 0 then (atom_id % 5) - 2 else 0 end::double as k from ({_atoms_sql()}))"""


@query(_pairs_sql(NEAR, atoms=_MOVED, reach=9))
def nl_unwrapped_shifted(spark, sf_dir):
    k = F.when(F.col("structure_id").bitwiseAND(1) > 0, F.col("atom_id") % 5 - 2).otherwise(0).cast("double")
    atoms = atoms_of(spark, sf_dir).withColumn("x", F.col("x") + k * 4.0)
    return neighbor_pairs(atoms, structures_of(spark, sf_dir), NEAR).select(*SCALARS, "d")


@query("""
with a as (select cast(label as bigint) as structure_id, vec_id as atom_id, embedding[1] as x, embedding[2] as y, embedding[3] as z from embeddings),
p as (select structure_id, s.atom_id as i, t.atom_id as j, t.x - s.x as dx, t.y - s.y as dy, t.z - s.z as dz from a s join a t using (structure_id) where s.atom_id <> t.atom_id)
select structure_id, i, j, cast(0 as integer) as sx, cast(0 as integer) as sy, cast(0 as integer) as sz from p where (dx * dx + dy * dy) + dz * dz < cast(0.1::double * 0.1::double as float)
""")
def nl_float32(spark, sf_dir):
    e = F.col("embedding")
    atoms = _read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("structure_id"), F.col("vec_id").alias("atom_id"), *(e[k].alias(x) for k, x in enumerate("xyz")))
    return neighbor_pairs(atoms, structures_of(spark, sf_dir, False), 0.1).select(*SCALARS)


_HOURS = "(date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + floor(date_part('second', ts)))::double / 3600.0::double"


@query(f"""
with a as (select user_id as structure_id, event_id as atom_id, {_HOURS} as x from events), n as (select unnest([-1, 0, 1]) as v),
p as (select structure_id, s.atom_id as i, t.atom_id as j, cast(n.v as integer) as sx, (t.x - s.x) + n.v::double * 24.0::double as dx from a s join a t using (structure_id), n where s.atom_id < t.atom_id)
select structure_id, i, j, sx, dx from p where dx * dx < {0.05 * 0.05!r}::double
""")
def nl_time_of_day(spark, sf_dir):
    """Events of a user within three minutes of the day, midnight included."""
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    atoms = _read(spark, sf_dir, "events").select(F.col("user_id").alias("structure_id"), F.col("event_id").alias("atom_id"), (seconds.cast("double") / 3600.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    day = F.array(*(F.array(*map(F.lit, row)) for row in ((24.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))))
    structures = atoms.select("structure_id").distinct().select("structure_id", day.alias("cell"), F.array(F.lit(True), F.lit(False), F.lit(False)).alias("pbc"))
    return neighbor_pairs(atoms, structures, 0.05, half_list=True).select("structure_id", "i", "j", "sx", "dx")


@query(f"select a.structure_id, a.atom_id, count(p.i) as degree from ({_atoms_sql()}) a left join ({_pairs_sql(NEAR)}) p on p.i = a.atom_id group by all")
def degree_by_atom(spark, sf_dir):
    return aggregates.degrees(atoms_of(spark, sf_dir), _pairs(spark, sf_dir))


@query(f"select s.structure_id, count(p.i) as n_pairs, count(p.i) * 28 as n_bytes from (select distinct cast(label as bigint) as structure_id from embeddings) s left join ({_pairs_sql(NEAR)}) p using (structure_id) group by all")
def pairs_by_structure(spark, sf_dir):
    return aggregates.pairs_by_structure(structures_of(spark, sf_dir), _pairs(spark, sf_dir))


@query(f"select structure_id, count(*) as n_atoms, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z, max(greatest(abs(x), abs(y), abs(z))) as max_abs from ({_atoms_sql()}) group by structure_id")
def structure_bounds(spark, sf_dir):
    return aggregates.structure_bounds(atoms_of(spark, sf_dir))


@query(f"""with a as ({_atoms_sql()}), m as (select structure_id, min(x) as mx, min(y) as my, min(z) as mz from a group by structure_id)
select structure_id, cast(floor((x - mx) / 1.5::double) as bigint) as gx, cast(floor((y - my) / 1.5::double) as bigint) as gy, cast(floor((z - mz) / 1.5::double) as bigint) as gz, count(*) as n_atoms from a join m using (structure_id) group by all""")
def bin_occupancy(spark, sf_dir):
    return aggregates.bin_occupancy(atoms_of(spark, sf_dir), 1.5)


def _varied(spark, sf_dir) -> DataFrame:
    rows = structures_of(spark, sf_dir)
    scale = F.lit(1.0) + F.col("structure_id") * 0.25
    return rows.withColumn("cell", F.transform("cell", lambda row: F.array(row[0] * scale, row[1], row[2])))


@query("""with s as (select distinct cast(label as bigint) as structure_id, 1 + label * 0.25::double as f from embeddings),
v as (select structure_id, 4.0 * f as ax, 0.5 * f as bx, 0.25 * f as cx from s), l as (
select structure_id, ax as la, sqrt(bx * bx + 25.0) as lb, sqrt(cx * cx + 0.25 + 36.0) as lc, (bx * cx + 2.5) / (sqrt(bx * bx + 25.0) * sqrt(cx * cx + 0.25 + 36.0)) as ca,
ax * cx / (ax * sqrt(cx * cx + 0.25 + 36.0)) as cb, ax * bx / (ax * sqrt(bx * bx + 25.0)) as cc, abs(ax * 30.0) as vol from v)
select structure_id, round(la, 8) as len_a, round(lb, 8) as len_b, round(lc, 8) as len_c, round(degrees(acos(ca)), 8) as angle_a, round(degrees(acos(cb)), 8) as angle_b, round(degrees(acos(cc)), 8) as angle_c,
round(greatest(la, lb, lc) / least(la, lb, lc), 8) as anisotropy, round(greatest(abs(ca), abs(cb), abs(cc)), 8) as skew, round(vol, 8) as volume from l""")
def cell_metrics(spark, sf_dir):
    found = fn.cell_metrics(_varied(spark, sf_dir))
    return found.select("structure_id", *(F.round(c, 8).alias(c) for c in found.columns[1:]))


def _images(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    counts = atoms_of(spark, sf_dir).groupBy("structure_id").agg(F.count("*").alias("n_atoms"))
    return image_table(with_geometry(structures_of(spark, sf_dir), counts, FAR)), counts


def _reach_sql() -> str:
    """Images to each side by periodicity, from cross products."""
    import itertools

    import numpy as np

    from nearspan.operators.geometry import dual_rows

    cases = []
    for bits in itertools.product((0, 1), repeat=3):
        dual, _ = dual_rows(np.array([CELL]), np.array([bits], bool))
        r = [int(np.ceil(FAR * np.linalg.norm(dual[0, k]))) if bits[k] else 0 for k in range(3)]
        cases.append(f"({bits[0] + 2 * bits[1] + 4 * bits[2]}, {r[0]}, {r[1]}, {r[2]})")
    return f"select s.structure_id, r.* from (select distinct cast(label as bigint) as structure_id from embeddings) s join (values {', '.join(cases)}) r(bits, ra, rb, rc) on (s.structure_id & 7) = r.bits"


_IMAGES_SQL = f"with r as ({_reach_sql()}) select structure_id, cast(a.v as integer) as na, cast(b.v as integer) as nb, cast(c.v as integer) as nc from r, (select unnest(range(-9, 10)) as v) a, (select unnest(range(-9, 10)) as v) b, (select unnest(range(-9, 10)) as v) c where abs(a.v) <= ra and abs(b.v) <= rb and abs(c.v) <= rc"


@query(_IMAGES_SQL)
def images(spark, sf_dir):
    return _images(spark, sf_dir)[0]


@query(f"select cast(sum(n * n * m) as bigint) as candidates from (select cast(label as bigint) as structure_id, count(*) as n from embeddings group by 1) join (select structure_id, count(*) as m from ({_IMAGES_SQL}) group by 1) using (structure_id)")
def dense_candidates(spark, sf_dir):
    return aggregates.dense_candidates(*_images(spark, sf_dir))


_OFFSETS_SQL = "select structure_id, n as n_atoms, cast(sum(n) over (order by structure_id) - n as bigint) as start, cast(sum(n) over (order by structure_id) as bigint) as stop from (select user_id as structure_id, count(*) as n from events group by 1)"


def _offsets(spark, sf_dir) -> DataFrame:
    atoms = _read(spark, sf_dir, "events").select(F.col("user_id").alias("structure_id"))
    return transform.batch_offsets(atoms.distinct(), atoms)


@query(_OFFSETS_SQL)
def batch_offsets(spark, sf_dir):
    return _offsets(spark, sf_dir)


@query(f"select structure_id, e.event_id as atom_id from events e join ({_OFFSETS_SQL}) o on e.event_id >= o.start and e.event_id < o.stop")
def structure_of_atom(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.col("event_id").alias("atom_id"))
    offsets = _offsets(spark, sf_dir)
    total = offsets.agg(F.max("stop").alias("n")).first()["n"] or 0
    return transform.structure_of(rows.where((F.col("atom_id") >= 0) & (F.col("atom_id") < total)), offsets)


@query(f"""with k as (select unnest([0, 1]) as v) select structure_id, atom_id * 8 + (a.v * 2 + b.v) * 2 + c.v as atom_id,
x + ((a.v::double * 4.0::double + b.v::double * 0.5::double) + c.v::double * 0.25::double) as x, y + ((a.v::double * 0.0::double + b.v::double * 5.0::double) + c.v::double * 0.5::double) as y,
z + ((a.v::double * 0.0::double + b.v::double * 0.0::double) + c.v::double * 6.0::double) as z from ({_atoms_sql()}), k a, k b, k c""")
def supercell_2x2x2(spark, sf_dir):
    return transform.supercell(atoms_of(spark, sf_dir), structures_of(spark, sf_dir), (2, 2, 2))[0]


@query(_pairs_sql(NEAR, columns=""))
def half_to_full(spark, sf_dir):
    return transform.half_to_full(_pairs(spark, sf_dir, half_list=True).select(*SCALARS))


@query(_pairs_sql(NEAR, half=True, columns=""))
def full_to_half(spark, sf_dir):
    return transform.full_to_half(_pairs(spark, sf_dir).select(*SCALARS))


@query(_pairs_sql(NEAR, selves=True, columns=""))
def appended_selves(spark, sf_dir):
    return transform.with_selves(_pairs(spark, sf_dir), atoms_of(spark, sf_dir))


@query("select 0::bigint as missing, 0::bigint as extra, 0::bigint as repeated")
def pair_diff_brute_vs_cells(spark, sf_dir):
    return checks.difference(_pairs(spark, sf_dir, algorithm="brute_force"), _pairs(spark, sf_dir, algorithm="cell_list"))


@query("select 0::bigint as different")
def pair_digests_agree(spark, sf_dir):
    a, b = (checks.pair_digest(_pairs(spark, sf_dir, algorithm=x)) for x in ("brute_force", "cell_list"))
    return checks.agreement(a, b, ["structure_id"], ["n_pairs", "digest"]).agg(F.count("*").alias("different"))


@query("select l_orderkey, l_linenumber, count(*) as copies from lineitem group by all having count(*) > 1")
def repeated_keys(spark, sf_dir):
    return checks.duplicates(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select o_custkey, o_totalprice, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as r from orders) where r = 1")
def argmin_per_group(spark, sf_dir):
    return aggregates.argmin_per_group(_read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderkey"), ["o_custkey"], ["o_totalprice", "o_orderkey"])


@query(f"select o_orderkey, sha256('{SEED}:' || o_orderkey) as score from orders order by score, o_orderkey limit 300")
def hash_bottom_k(spark, sf_dir):
    return sampling.bottom_k(_read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", SEED, 300)


_BIN_SQL = " + ".join(f"(case when o_totalprice > {b * 4000} then 1 else 0 end)" for b in fn.HEAVY_ATOM_BOUNDARIES)


@query(f"""with s as (select o_orderkey, sha256('{SEED}:' || o_orderkey) as score, cast({_BIN_SQL} as integer) as bin from orders), x as (select o_orderkey from s order by score, o_orderkey limit 300)
select o_orderkey, bin, cast(r as integer) as place from (select *, row_number() over (partition by bin order by score, o_orderkey) as r from s where o_orderkey not in (select o_orderkey from x)) where r <= 20""")
def bottom_k_per_bin_excl(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    binned = fn.bucket_left(F.col("o_totalprice"), [b * 4000 for b in fn.HEAVY_ATOM_BOUNDARIES])
    return sampling.bottom_k_per_bin(rows, "o_orderkey", binned, SEED, 20, excluded=sampling.bottom_k(rows, "o_orderkey", SEED, 300)).select("o_orderkey", "bin", "place")


_SIZE_SQL = " + ".join(f"(case when l_quantity >= {b} then 1 else 0 end)" for b in fn.ATOM_BOUNDARIES)


@query(f"""with s as (select l_orderkey * 10 + l_linenumber as key, cast({_SIZE_SQL} as integer) as size, least(l_linenumber, 6) as line from lineitem), r as (select *, row_number() over (partition by size, line order by sha256('{SEED}:' || key), key) as place from s)
select key, size, cast(line as integer) as line, cast(place as integer) as place from r order by place, size, line limit 200""")
def hash_stratified_sample(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), fn.bucket_right(F.col("l_quantity"), fn.ATOM_BOUNDARIES).alias("size"), F.least("l_linenumber", F.lit(6)).cast("int").alias("line"))
    return sampling.stratified(rows, "key", ["size", "line"], SEED, 200).select("key", "size", "line", "place")


@query("select c_custkey, c_nationkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 150000)")
def selected_rows_semi(spark, sf_dir):
    wanted = _read(spark, sf_dir, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return sampling.rows_by_key(_read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), wanted, "c_custkey")


@query(f"with a as ({_atoms_sql()}), m as (select structure_id, avg(x) as mx, avg(y) as my, avg(z) as mz from a group by 1) select structure_id, round(sqrt(avg((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))), 8) as radius_of_gyration from a join m using (structure_id) group by 1")
def radius_of_gyration(spark, sf_dir):
    return fn.radius_of_gyration(atoms_of(spark, sf_dir)).select("structure_id", F.round("radius_of_gyration", 8).alias("radius_of_gyration"))


@query("select cast(label as bigint) as structure_id, cast(count(*) as bigint) as n_atoms from embeddings group by 1 order by abs(count(*) - 64), 1 limit 1")
def nearest_size(spark, sf_dir):
    counts = atoms_of(spark, sf_dir).groupBy("structure_id").agg(F.count("*").alias("n_atoms"))
    return sampling.nearest_by(counts, F.abs(F.col("n_atoms") - 64), F.col("structure_id"))


@query(f"select structure_id, cast(floor((row_number() over (order by sha256('{SEED}:' || structure_id), structure_id) - 1) / 32) as bigint) as batch from (select distinct user_id as structure_id from events)")
def minibatches(spark, sf_dir):
    return transform.minibatches(_read(spark, sf_dir, "events").select(F.col("user_id").alias("structure_id")).distinct(), SEED, 32)


_SHAPE_SQL = f"""
with a as ({_atoms_sql()}), m as (select structure_id, avg(x) as mx, avg(y) as my, avg(z) as mz, count(*) as n from a group by 1),
s as (select structure_id, n, sum((x - mx) * (x - mx)) as xx, sum((x - mx) * (y - my)) as xy, sum((x - mx) * (z - mz)) as xz, sum((y - my) * (y - my)) as yy, sum((y - my) * (z - mz)) as yz, sum((z - mz) * (z - mz)) as zz from a join m using (structure_id) group by 1, 2),
c as (select *, -(xx + yy + zz) as c2, xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz as c1, -(xx * yy * zz + 2 * xy * xz * yz - xx * yz * yz - yy * xz * xz - zz * xy * xy) as c0 from s),
q as (select *, c2 * c2 - 3 * c1 as p, 4.5 * c1 * c2 - c2 * c2 * c2 - 13.5 * c0 as r from c),
t as (select *, acos(greatest(-1, least(1, r / pow(p, 1.5)))) / 3 as t from q),
l as (select structure_id, n, (2 * sqrt(p) * cos(t) - c2) / 3 as l1, (2 * sqrt(p) * cos(t - 2 * pi() / 3) - c2) / 3 as l2, (2 * sqrt(p) * cos(t + 2 * pi() / 3) - c2) / 3 as l3 from t)
select structure_id, round(1.0::double, 5) as ratio_1, case when n > 1 then round(sqrt(greatest(0, l2) / l1), 5) end as ratio_2, case when n > 2 then round(sqrt(greatest(0, l3) / l1), 5) end as ratio_3 from l
"""


@query(_SHAPE_SQL)
def shape_ratios(spark, sf_dir):
    """The SQL solves the characteristic polynomial instead."""
    found = fn.shape_ratios(atoms_of(spark, sf_dir))
    return found.select("structure_id", *(F.round(f"ratio_{k}", 5).alias(f"ratio_{k}") for k in (1, 2, 3)))


@query("""
with a as (select cast(label as bigint) as structure_id, vec_id as atom_id, embedding[1] as x, embedding[2] as y, embedding[3] as z from embeddings),
p as (select structure_id, s.atom_id as i, t.atom_id as j, t.x - s.x as dx, t.y - s.y as dy, t.z - s.z as dz from a s join a t using (structure_id) where s.atom_id <> t.atom_id)
select structure_id, i, j, cast(0 as integer) as sx, cast(0 as integer) as sy, cast(0 as integer) as sz from p where (dx * dx + dy * dy) + dz * dz < cast(0.1::double * 0.1::double as float)
""")
def nl_float32_cells(spark, sf_dir):
    """Single precision by bins and blocks."""
    e = F.col("embedding")
    atoms = _read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("structure_id"), F.col("vec_id").alias("atom_id"), *(e[k].alias(x) for k, x in enumerate("xyz")))
    return neighbor_pairs(atoms, structures_of(spark, sf_dir, False), 0.1, algorithm="cell_list", most_whole=60).select(*SCALARS)


@query(f"select i as p1, j as p2, sx as s1, sy as s2, sz as s3, dx as d1, dy as d2, dz as d3 from ({_pairs_sql(NEAR, columns='D')})")
def nl_pairs_and_displacements(spark, sf_dir):
    found = project(_pairs(spark, sf_dir), "PSD")
    return found.select(*(F.col(c)[k].alias(f"{n}{k + 1}") for c, n, size in (("pair", "p", 2), ("shift", "s", 3), ("displacement", "d", 3)) for k in range(size)))


@query(f"""with p as ({_pairs_sql(NEAR, columns='')}), n as (select structure_id, count(*) as n, sum(i * 31 + j * 17 + sx * 5 + sy * 3 + sz) as s from p group by 1)
select structure_id, n as n_pairs, cast(s as bigint) as weighted from n""")
def pair_digest_counts(spark, sf_dir):
    """Numbers of pairs as the digest counts them, and a sum that SQL can make too."""
    pairs = _pairs(spark, sf_dir)
    weighted = pairs.groupBy("structure_id").agg(F.sum(F.col("i") * 31 + F.col("j") * 17 + F.col("sx") * 5 + F.col("sy") * 3 + F.col("sz")).alias("weighted"))
    return checks.pair_digest(pairs).select("structure_id", "n_pairs").join(weighted, "structure_id")


@query("select o_orderkey, o_totalprice from (select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) as r, count(*) over () as n from orders) where r = n // 2 + 1")
def median_ranked(spark, sf_dir):
    return sampling.median_ranked(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("""with s as (select cast(label as bigint) as structure_id, count(*) as n from embeddings group by 1), v as (select structure_id, n, 1 + structure_id * 0.25::double as f from s),
l as (select structure_id, n, 4.0 * f as la, sqrt(0.25 * f * f + 25.0) as lb, sqrt(0.0625 * f * f + 36.25) as lc from v)
select structure_id, n as n_atoms from l order by abs(n - 64), abs(greatest(la, lb, lc) / least(la, lb, lc) - 1.5), structure_id limit 1""")
def nearest_size_and_shape(spark, sf_dir):
    counts = atoms_of(spark, sf_dir).groupBy("structure_id").agg(F.count("*").alias("n_atoms"))
    rows = counts.join(fn.cell_metrics(_varied(spark, sf_dir)).select("structure_id", "anisotropy"), "structure_id")
    return sampling.nearest_by(rows, F.abs(F.col("n_atoms") - 64), F.abs(F.col("anisotropy") - 1.5), F.col("structure_id")).select("structure_id", "n_atoms")


@query("select o_orderpriority as name, median(o_totalprice) as median_s, min(o_totalprice) as min_s, max(o_totalprice) as max_s, max(o_custkey) / median(o_totalprice) as pairs_per_s from orders group by 1")
def timing_summary(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("seconds"), F.col("o_custkey").alias("pairs"))
    return aggregates.timing_summary(rows)


@query("select count(*) as n_rows, count(distinct o_custkey) as n_ids, count(distinct o_orderstatus) as n_o_orderstatus, min(o_orderstatus) as min_o_orderstatus, max(o_orderstatus) as max_o_orderstatus, count(distinct o_orderkey) as n_o_orderkey, min(o_orderkey) as min_o_orderkey, max(o_orderkey) as max_o_orderkey from orders")
def dataset_summary(spark, sf_dir):
    return aggregates.summary(_read(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_orderkey"])


_ELEMENTS = list(fn.ATOMIC_NUMBERS)


@query(f"""with n as (select unnest(range(0, 3)) as k) select cast(vec_id as varchar) as source_id, k as ordinal, cast(([{', '.join(map(str, fn.ATOMIC_NUMBERS.values()))}])[(vec_id + k) % {len(_ELEMENTS)} + 1] as integer) as z_number,
round(embedding[3 * k + 1]::double * 10, 4) as x, round(embedding[3 * k + 2]::double * 10, 4) as y, round(embedding[3 * k + 3]::double * 10, 4) as z from embeddings, n""")
def sdf_atoms(spark, sf_dir):
    """Molecules of three atoms each, written as MDL V2000 and parsed."""
    e, names = F.col("embedding"), F.array(*map(F.lit, _ELEMENTS))
    line = lambda k: F.format_string("%10.4f%10.4f%10.4f %-3s 0  0\n", *(F.round(e[3 * k + m].cast("double") * 10, 4) for m in range(3)), F.get(names, ((F.col("vec_id") + k) % len(_ELEMENTS)).cast("int")))
    head = F.concat(F.lit("m\n\n\n  3  0  0  0  0  0  0  0  0  0999 V2000\n"), *(line(k) for k in range(3)), F.lit("M  END\n"))
    files = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("name"), head.alias("text"))
    return sources.parse_sdf_rows(files)


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or os.path.join(tempfile.gettempdir(), 'checkpoints')}/{name}-{uuid.uuid4().hex}"


@query("select c_custkey, c_name, c_acctbal, c_custkey || '|' || c_nationkey as keys from customer")
def csv_round_trip(spark, sf_dir):
    """Written with lists joined by bars, read by names in another order."""
    path = _scratch(spark, "csv")
    rows = _read(spark, sf_dir, "customer")
    sources.write_csv(rows.select("c_name", F.array("c_custkey", F.col("c_nationkey").cast("long")).alias("keys"), "c_acctbal", "c_custkey", "c_mktsegment"), path)
    kinds = ", ".join(f"{n} {t}" for n, t in rows.select("c_custkey", "c_name", "c_acctbal").dtypes)
    return sources.read_csv(spark, path, f"{kinds}, keys string")


@query("select r_regionkey, r_name from region")
def json_round_trip(spark, sf_dir):
    path = _scratch(spark, "json")
    rows = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    sources.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)
