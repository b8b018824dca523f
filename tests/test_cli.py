"""Every command of the command line, over small folders."""

import os

import numpy as np

from tessella import cli
from tessella.sources import generate as G, raw


def test_commands(spark, tmp_path):
    at = lambda *p: str(tmp_path.joinpath(*p))
    run = lambda *argv: cli.main([str(a) for a in argv], spark)
    n = lambda name: (lambda m: (m.n_elements(), m.n_nodes(), m.blocks[0].elem_type))(raw.read_mesh(spark, at(name)))

    run("cube", "HEX8", 2, 2, 2, at("c"))
    assert n("c") == (8, 27, "HEX8")
    run("cube", "TET4", 1, 1, 1, at("t"), "--order", "hilbert3")
    run("square", "TRI3", 3, 2, at("q"))
    run("ring", 0.5, 1.0, 2, 6, at("r"))
    run("half-sphere", "HEX8", 1.0, 2, 2, 2, at("h"))
    run("checkerboard", 2, 2, 2, at("k"))
    run("bidomain-cube", 2, 2, 2, 2, 1, at("b"))
    assert n("t")[:2] == (12, 9) and n("q") == (12, 12, "TRI3") and len(raw.read_mesh(spark, at("b")).blocks) == 2
    run("skin", at("c"), at("s"))
    assert n("s")[:2] == (24, 26)
    run("surface-from-sideset", at("c"), at("s", "parent_sideset"), at("f"))
    run("surface-from-sideset", at("c"), at("s", "parent_sideset"), at("f2"), "--level", 2)
    assert n("f")[:2] == (24, 26) and n("f2")[1] == 98
    run("convert", at("c"), "TET4", at("ct"))
    run("promote", at("t"), "TET10", at("p"))
    run("refine", at("q"), 1, at("q2"))
    run("extrude", at("q"), 1.0, 2, at("e"))
    run("to-semistructured", at("c"), 4, at("l"))
    run("derefine", at("l"), 2, at("l2"))
    assert n("ct") == (48, 27, "TET4") and n("p") == (12, 35, "TET10") and n("q2")[0] == 48 and n("e")[0] == 24
    assert n("l")[1] == 9**3 and n("l2")[1] == 5**3
    run("sfc", at("c"), at("cs"), "--order", "morton3")
    run("cuthill-mckee", at("q"), at("qc"))
    assert n("cs")[0] == 8 and n("qc") == (12, 12, "TRI3")
    for name in ("n2e", "n2n", "adjacency"):
        run(name, at("c"), at(name))
        assert os.path.getsize(at(name, "rowptr.int32")) == 4 * 28
    assert os.path.getsize(at("n2n", "colidx.int32")) == 4 * 343
    for name, table, rows in (("dual", "dual", 24), ("half-faces", "half_faces", 48)):
        run(name, at("c"), at(name))
        assert spark.read.parquet(at(name, table)).count() == rows
    run("create-sideset", at("c"), 0.5, 0.5, 1.0, 0.9, at("side"))
    assert raw.read_sideset(spark, at("side")).count() == 4
    run("select-surface", at("s"), 0.5, 0.5, 1.0, 0.9, at("chosen.int32"))
    assert os.path.getsize(at("chosen.int32")) == 16
    run("sharp-features", at("s"), at("sharp"))
    # The cube's edges, in halves: those at its corners go, so of 24 none is left without one.
    assert os.path.getsize(at("sharp", "corners", "i0.int32")) == 4 * 8 and os.path.getsize(at("sharp", "i0.int32")) == 0
    run("extract-submesh", at("c"), 0.0, 0.0, 0.0, 1, at("one"))
    run("extract-submesh", at("c"), 0.0, 0.0, 0.0, 9, at("more"), "--along", "yes")
    assert n("one")[:2] == (1, 8) and n("more")[0] == 8
    run("partition", at("c"), 2, at("parts"))
    assert spark.read.parquet(at("parts", "report")).count() == 2
    run("pack", at("c"), 40, at("packed"))
    run("to-blocks", at("c"), 3, at("blocks"))
    assert raw.read_packed(spark, at("packed")).n_elements() == 8 and raw.read_blocks(spark, at("blocks")).count() == 8
    run("signed-distance", at("c"), at("s"), at("d"))
    d = np.fromfile(at("d", "distance.float64"))
    assert sorted(set(np.round(d, 9))) == [-0.5, 0.0] and (d < -0.4).sum() == 1


def test_transfer_commands(spark, tmp_path):
    mesh = G.tet4_cube(spark, 1, 1, 1)
    from tessella.sources import sinks

    sinks.write_mesh(mesh, str(tmp_path / "t"))
    np.arange(9.0).tofile(tmp_path / "f.float64")
    cli.main(["prolong", str(tmp_path / "t"), "TET10", str(tmp_path / "f.float64"), str(tmp_path / "fine.float64")], spark)
    fine = np.fromfile(tmp_path / "fine.float64")
    assert len(fine) == 35 and (fine[:9] == np.arange(9.0)).all() and set(fine[9:] * 2) <= {float(i + j) for i in range(9) for j in range(9)}
    np.ones(35).tofile(tmp_path / "g.float64")
    cli.main(["restrict", str(tmp_path / "t"), "TET10", str(tmp_path / "g.float64"), str(tmp_path / "coarse.float64")], spark)
    assert abs(np.fromfile(tmp_path / "coarse.float64").sum() - 35) < 1e-9
