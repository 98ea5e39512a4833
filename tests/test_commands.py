"""The commands, on small files."""

import json

import numpy as np
import pytest

from seqlab.plans.commands import COMMANDS, main, parser
from seqlab.sources import tables


def test_every_command_has_its_options():
    for name, (_, places, options) in COMMANDS.items():
        args = parser().parse_args([name, *places])
        assert all(getattr(args, p) == p for p in places) and all(hasattr(args, o.replace("-", "_")) for o in options)
    with pytest.raises(SystemExit):
        parser().parse_args(["nothing"])


def test_cosine_distances_and_slices(spark, tmp_path):
    (tmp_path / "stats.csv").write_text("Unnamed: 0,group,uuid,syllable,usage\n0,g,u,1,0.5\n1,g,u,2,0.5\n2,h,v,2,1.0\n")
    main(["cosine-distances", f"{tmp_path}/stats.csv", f"{tmp_path}/stats.csv", f"{tmp_path}/out", "--csv"], spark)
    rows = tables.read_csv(spark, f"{tmp_path}/out/group_distances").collect()
    assert {(r["group1"], r["group2"]) for r in rows} == {("g", "g"), ("g", "h"), ("h", "g"), ("h", "h")}
    spark.createDataFrame([("a", i, i > 20) for i in range(100)], "uuid string, frame_seq long, empty boolean").write.parquet(f"{tmp_path}/frames")
    main(["empty-ranges", f"{tmp_path}/frames", f"{tmp_path}/out", "--split-threshold", "10"], spark)
    assert [(r["start"], r["stop"]) for r in spark.read.parquet(f"{tmp_path}/out/ranges").collect()] == [(0, 16)]

    spark.createDataFrame([("a", i, float(i)) for i in range(3)] + [("b", 0, 5.0)], "uuid string, frame_seq long, value double").write.parquet(f"{tmp_path}/scalars")
    main(["split-sessions", f"{tmp_path}/frames", f"{tmp_path}/out", "--split-threshold", "10", "--tables", f"scalars={tmp_path}/scalars"], spark)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/tables/scalars").collect()) == [("a-split-00", 0, 0.0), ("a-split-00", 1, 1.0), ("a-split-00", 2, 2.0), ("b", 0, 5.0)]
    assert spark.read.parquet(f"{tmp_path}/out/tables/frames").count() == 16
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/splits").collect()] == [("a", "a-split-00", 0, 16, "a-start_0_end_16.h5")]


def test_treatments_and_scalars(spark, tmp_path, capsys):
    (tmp_path / "map.tsv").write_text("matcher\tday\tsession\tbox\tfilename\n1\t1\t1\t1\tx.mp4\n1\t1\t1\t2\ty.mp4\n")
    (tmp_path / "dosing.tsv").write_text("matcher\tday\tsession\tbox\ttreat\n1\t1\t1\t1\tdrug\n")
    index = {"files": [{"path": [f"/d/{n}.h5"], "group": "default", "uuid": n} for n in "xyz"], "other": 1}
    tables.write_yaml(index, f"{tmp_path}/index.yaml")
    main(["merge-treatments", f"{tmp_path}/map.tsv", f"{tmp_path}/dosing.tsv", f"{tmp_path}/index.yaml"], spark)
    out = tables.read_yaml(f"{tmp_path}/index.yaml")
    assert [f["group"] for f in out["files"]] == ["drug", "default", "default"] and out["other"] == 1 and tables.read_yaml(f"{tmp_path}/index.yaml.bak") == index
    tables.write_yaml({"files": [{"path": ["/e/x.h5"], "group": "none"}, {"path": ["/e/w.h5"], "group": "none"}]}, f"{tmp_path}/target.yaml")
    main(["merge-treatments-from-index", f"{tmp_path}/target.yaml", f"{tmp_path}/index.yaml"], spark)
    assert [f["group"] for f in tables.read_yaml(f"{tmp_path}/target.yaml")["files"]] == ["drug", "none"]
    np.savez(f"{tmp_path}/s.npz", uuid=np.array("u"), timestamps=np.array([5, 6]), **{"scalars/h": np.array([1.5, 2.5, 3.5])})
    main(["extract-scalar", f"{tmp_path}/*.npz", f"{tmp_path}/json", "--name", "h", "--kind", "json"], spark)
    assert json.loads((tmp_path / "json/u.json").read_text()) == {"data": [1.5, 2.5, 3.5], "timestamps": ["5.0", "6.0", ""]}
    with pytest.raises(KeyError):
        main(["extract-scalar", f"{tmp_path}/*.npz", f"{tmp_path}/json", "--name", "w"], spark)
    capsys.readouterr()
    main(["extract-scalar", f"{tmp_path}/*.npz", "-"], spark)
    assert capsys.readouterr().out.splitlines() == ["scalars/h float64", "timestamps int64", "uuid <U1"]
    main(["settings", "/f.pkl", str(tmp_path)], spark)
    main(["apply-path", f"{tmp_path}/extraction.yaml", "/new", "--component", "f.pkl"], spark)
    assert "flip_classifier" in tables.read_yaml(f"{tmp_path}/extraction.yaml")


def test_library_commands(spark, tmp_path, capsys):
    rng = np.random.default_rng(3)
    for e in "xy":
        rows = [(i, *(rng.normal(size=2) + 5 * (i % 3)).tolist()) for i in range(12)]
        tables.write_csv(spark.createDataFrame(rows, "syllable_id int, a double, b double"), f"{tmp_path}/{e}")
    (tmp_path / "experiments.csv").write_text("experiment_name,syllable_features_path\n" + "".join(f"{e},{tmp_path}/{e}\n" for e in "xy"))
    main(["meta-clusters", f"{tmp_path}/experiments.csv", f"{tmp_path}/out", "--clusters", "3"], spark)
    assert spark.read.parquet(f"{tmp_path}/out/clusters").count() == 24
    main(["library-generate", f"{tmp_path}/library", f"{tmp_path}/experiments.csv", "--clusters", "3", "--columns", "a", "b"], spark)
    main(["library-add", f"{tmp_path}/library", "v1.0", f"{tmp_path}/experiments.csv"], spark)
    main(["library-list", f"{tmp_path}/library"], spark)
    lines = capsys.readouterr().out.split("\n")
    assert lines[:2] == ["v1.0", "v1.1"] and [(x.split()[0], x.split()[-1]) for x in lines[2:4]] == [("v1.1", "Update"), ("v1.0", "Original")]
