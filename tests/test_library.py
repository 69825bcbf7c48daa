"""Transforms, sampling, checks, sources and streaming."""

import io
import os
import tarfile

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__
from nearspan import functions as fn
from nearspan import sources
from nearspan.operators import aggregates, checks, ordered, sampling, transform
from nearspan.operators.geometry import dual_rows
from nearspan.plans import queries as plans
from nearspan.streaming import neighbor_stream, split
from tests.conftest import SF

LIGHT = ["nl_finite_full", "nl_periodic_half_self", "nl_auto", "nl_quantities", "nl_time_of_day", "batch_offsets", "structure_of_atom", "minibatches", "images", "supercell_2x2x2", "half_to_full", "full_to_half",
         "hash_stratified_sample", "bottom_k_per_bin_excl", "argmin_per_group", "cell_metrics", "radius_of_gyration", "pair_digests_agree", "pair_diff_brute_vs_cells", "shape_ratios", "nl_float32_cells", "nl_pairs_and_displacements", "pair_digest_counts",
         "median_ranked", "nearest_size_and_shape", "timing_summary", "dataset_summary", "sdf_atoms", "csv_round_trip", "json_round_trip"]


@pytest.mark.parametrize("name", LIGHT)
def test_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    found = plans.QUERIES[name](spark, SF)
    said = db.execute(plans.SQL[name])
    order = [c[0] for c in said.description]
    assert sorted(order) == sorted(found.columns)
    assert sorted(map(str, (tuple(r) for r in found.select(*order).collect()))) == sorted(map(str, said.fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["structure_id", "i", "j", "sx", "sy", "sz", "d"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_running_sums_over_many_buckets(spark):
    rows = spark.createDataFrame([(k * 3, k % 5) for k in range(300)], "id long, v long").repartition(7)
    got = {r.id: r.s for r in ordered.running_sum(rows, "id", "v", "s", bucket_rows=20).collect()}
    assert got == dict(zip((3 * k for k in range(300)), np.cumsum([k % 5 for k in range(300)]).tolist()))
    marks = spark.createDataFrame([(10, "a"), (500, "b"), (501, "c")], "id long, m string")
    got = {r.id: r.m for r in ordered.carried(rows.select("id"), marks, "id", "m", bucket_rows=20).collect()}
    assert got == {3 * k: None if 3 * k < 10 else "a" if 3 * k < 500 else "b" if 3 * k < 501 else "c" for k in range(300)}


def test_sampling(spark):
    rows = spark.createDataFrame([(f"m{k:02d}", f"c{j}", 5 + 10 * (k % 8), -10.0 - j) for k in range(16) for j in range(2)], "chembl_id string, conf_id string, heavy_atoms int, energy double")
    one = aggregates.argmin_per_group(rows, ["chembl_id"], ["energy", "conf_id"])
    assert {r.conf_id for r in one.collect()} == {"c1"} and one.count() == 16
    some = sampling.bottom_k(one, "chembl_id", 17, 1)
    others = sampling.bottom_k_per_bin(one, "chembl_id", fn.bucket_left(F.col("heavy_atoms"), fn.HEAVY_ATOM_BOUNDARIES), 17, 1, excluded=some)
    assert some.count() == 1 and {r.chembl_id for r in some.collect()} & {r.chembl_id for r in others.collect()} == set()
    with pytest.raises(ValueError):
        sampling.enough(some, 2)
    edge = spark.createDataFrame([(10, 8)], "h int, n int").select(fn.bucket_left(F.col("h"), fn.HEAVY_ATOM_BOUNDARIES).alias("h"), fn.bucket_right(F.col("n"), fn.ATOM_BOUNDARIES).alias("n")).first()
    assert tuple(edge) == (0, 2)


def test_functions(spark):
    rows = spark.createDataFrame([("Cl", 35, ["b", "a", "b"], ["x", "id_1", "id_2"])], "s string, z int, l array<string>, n array<string>")
    got = rows.select(fn.atomic_number(F.col("s")), fn.element_symbol(F.col("z")), fn.joined_list(F.col("l")), fn.first_with_prefix(F.col("n"), "id_"), fn.first_with_prefix(F.col("n"), "q")).first()
    assert tuple(got) == (17, "Br", "a|b", "id_1", None)
    rng = np.random.default_rng(0)
    place = rng.normal(size=(20, 3))
    atoms = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(place)] + [(1, 30, 1.0, 2.0, 3.0)], sources.ATOMS)
    s = np.linalg.svd(place - place.mean(axis=0), compute_uv=False)
    got = {r.structure_id: tuple(r)[1:] for r in fn.shape_ratios(atoms).collect()}
    assert np.allclose(got[0], s / s[0], atol=1e-7)
    zero = spark.createDataFrame([(0, [[0.0] * 3] * 3)], "structure_id long, cell array<array<double>>")
    with pytest.raises(PySparkException, match="zero cell vector"):
        fn.cell_metrics(zero).collect()
    duals, good = dual_rows(np.array([[(1, 0, 0), (1, 1e-8, 0), (0, 0, 0)]], float), np.array([[True, True, False]]))
    assert good[0] and np.allclose(duals[0], [(1, -1e8, 0), (0, 1e8, 0), (0, 0, 0)])


def test_pairs(spark):
    pairs = spark.createDataFrame([(0, 1, 2, 0, 0, 1), (0, 3, 3, -1, 0, 0), (0, 4, 4, 0, 0, 0)], "structure_id long, i long, j long, sx int, sy int, sz int")
    full = transform.half_to_full(pairs)
    assert full.count() == 5 and sorted(map(tuple, transform.full_to_half(full).collect())) == sorted(map(tuple, pairs.collect()))
    got = checks.difference(full, pairs.unionByName(pairs)).first()
    assert tuple(got) == (0, 2, 0)
    assert tuple(checks.difference(pairs.unionByName(pairs), full).first()) == (2, 0, 3)
    assert checks.pair_digest(full).first() == checks.pair_digest(full.repartition(5)).first()


SDF = "title\n\n\n  3  2  0  0  0  0  0  0  0  0999 V2000\n    0.1  0.2  0.3 C   0\n    1.0  0.0  0.0 Cl  0\n    0.0 -1.0  0.5 H   0\nM  END\n"


def test_sources(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as archive:
        for name, text in (("m/one.sdf", SDF), ("m/two.sdf", SDF), ("m/readme.txt", "no")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            archive.addfile(info, io.BytesIO(text.encode()))
    wanted = spark.createDataFrame([("m/two.sdf",)], "name string")
    rows = sources.parse_sdf_rows(sources.read_archives(spark, str(tmp_path / "a.tar.gz"), wanted=wanted)).orderBy("ordinal").collect()
    assert [(r.source_id, r.z_number, r.x) for r in rows] == [("m/two.sdf", 6, 0.1), ("m/two.sdf", 17, 1.0), ("m/two.sdf", 1, 0.0)]
    for bad in ("x", SDF.replace("  3  2", "  9  2"), SDF.replace(" Cl ", " Xx ")):
        with pytest.raises(PySparkException, match="m/x: "):
            sources.parse_sdf_rows(spark.createDataFrame([("m/x", bad)], "name string, text string")).collect()
    packed = SDF.replace("    0.1  0.2  0.3 C ", f"{-1234.5678:10.4f}{-123.4567:10.4f}{-2345.6789:10.4f} C ")
    run_together = sources.parse_sdf_rows(spark.createDataFrame([("p", packed)], "name string, text string")).orderBy("ordinal").first()
    assert (run_together.x, run_together.y, run_together.z, run_together.z_number) == (-1234.5678, -123.4567, -2345.6789, 6)
    members = sources.read_archives(spark, str(tmp_path / "a.tar.gz"))
    assert sources.all_members(members, wanted) is members
    with pytest.raises(RuntimeError, match="three"):
        sources.all_members(members, spark.createDataFrame([("m/three.sdf",)], "name string"))
    arrays = {"positions": np.arange(9.0).reshape(3, 3), "batch_ptr": np.array([0, 1, 3]), "cell": np.stack([np.eye(3)] * 2), "pbc": np.ones((2, 3), bool), "source_ids": np.array(["p", "q"])}
    data = sources.npz_bytes(**arrays)
    assert data == sources.npz_bytes(**arrays)
    (tmp_path / "s.npz").write_bytes(data)
    atoms, structures = sources.read_npz(spark, str(tmp_path / "s.npz"))
    assert [(r.structure_id, r.x) for r in atoms.orderBy("atom_id").collect()] == [(0, 0.0), (1, 3.0), (1, 6.0)]
    assert [r.source_id for r in structures.orderBy("structure_id").collect()] == ["p", "q"]
    table = spark.createDataFrame([(1, ["a", "b"], "x")], "id long, l array<string>, s string")
    sources.write_csv(table, str(tmp_path / "c"))
    assert [tuple(r) for r in sources.read_csv(spark, str(tmp_path / "c"), "s string, l string").collect()] == [("x", "a|b")]
    sources.write_json(table, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().s == "x"
    (tmp_path / "m.json").write_text(sources.manifest_text({"b": 1, "a": [1, 2]}))
    assert sources.read_manifest(spark, str(tmp_path / "m.json")).first().b == 1
    digest = sources.checksums(spark, str(tmp_path / "m.json")).first()
    raw = (tmp_path / "m.json").read_bytes()
    assert sources.verified(raw, digest.length, digest.sha256) == raw
    with pytest.raises(RuntimeError):
        sources.verified(raw + b" ", digest.length, digest.sha256)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame(
        [(k, [(10 * k, 0.0, 0.0, 0.0), (10 * k + 1, 0.5, 0.0, 0.0)], [[4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 4.0]], [False] * 3) for k in range(3)],
        "structure_id long, atoms array<struct<atom_id: long, x: double, y: double, z: double>>, cell array<array<double>>, pbc array<boolean>",
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = neighbor_stream(stream, 1.0, lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    assert split(rows)[0].count() == 6
