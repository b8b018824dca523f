"""What runs without a machine's own Spark settings."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest

from tessella.operators import sets

REPO = Path(__file__).parents[1]


def test_without_a_checkpoint_folder(tmp_path):
    code = """
        from tessella.session import local_session
        from tessella.sources import generate as G
        from tessella.operators import sets
        from tessella import storage
        spark = local_session(2, partitions=2, memory="1g")
        assert not spark.conf.get("spark.checkpoint.dir", None)
        assert sets.skin(G.hex8_cube(spark, 2, 2, 2)).elements.count() == 24
        assert storage.shared_dir(spark) == storage.shared_dir(spark)
        try:
            from tessella.llm import common
        except ImportError:
            pass
        else:
            assert common.materialize(spark.range(3)).count() == 3
        print("fine")
    """
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_")} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(REPO)}
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in out.stdout, out.stderr[-2000:]


def test_propagate_tells_when_it_is_cut_short(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(4)], "a long, b long")
    seed = spark.createDataFrame([(0,)], "side long")
    assert sets.propagate(links, seed).count() == 5
    assert sets.propagate(links, seed, max_rounds=4).count() == 5
    with pytest.raises(RuntimeError, match="more can be reached"):
        sets.propagate(links, seed, max_rounds=2)
