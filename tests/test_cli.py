"""The command line from an edge list to result files."""

import pytest

from ripplework import cli


def test_build_select_experiment(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# toy\n1 2\n1 3\n2 4\n3 4\n")
    edges = str(tmp_path / "e.txt")
    for model in ("MFIC", "MFIC2MIX"):
        graph = str(tmp_path / model)
        assert cli.main(["build", "--edges", edges, "--model", model, "--ratio", "1", "--out", graph]) == 0
        for algorithm in ("rr", "opim") if model == "MFIC" else ("all-factor",):
            out = str(tmp_path / f"{model}-{algorithm}")
            cli.main(["select", "--graph", graph, "--algorithm", algorithm, "--k", "2", "--sets", "200", "--ks", "1,2", "--out", out])
            seeds = spark.read.json(f"{out}/summary").first().seeds.split()
            assert len(seeds) == 2 and seeds[0] == "1"
    cli.main(["build", "--edges", edges, "--format", "text", "--out", str(tmp_path / "t")])
    assert spark.read.text(str(tmp_path / "t" / "edges")).count() == 14
    cli.main(["experiment", "--edges", edges, "--algorithms", "MaxDegree", "--max-k", "2", "--step", "1", "--worlds", "10", "--out", str(tmp_path / "x")])
    assert spark.read.csv(str(tmp_path / "x" / "results"), header=True).count() == 3
    with pytest.raises(SystemExit):
        cli.main(["select"])
