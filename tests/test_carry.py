"""Processors of live state are read where the package is not at hand: the process that sets state up on the driver's side."""

import subprocess
import sys

import pytest

from pyspark import cloudpickle

from shroudline.streaming import outcomes, sessions, tickets

CODE = "import sys; from pyspark import cloudpickle; p = cloudpickle.load(sys.stdin.buffer); assert 'shroudline' not in sys.modules; print(type(p).__name__)"


@pytest.mark.parametrize("make", [outcomes.Folder, lambda: sessions.Correlator(60, 2)])
def test_processors_travel_by_value(make, tmp_path):
    for module in (sessions, outcomes, tickets):
        cloudpickle.register_pickle_by_value(module)
    processor = make()
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}
    done = subprocess.run([sys.executable, "-c", CODE], input=cloudpickle.dumps(processor), capture_output=True, cwd=tmp_path, env=env, timeout=120)
    assert done.stdout.decode().strip() == type(processor).__name__, done.stderr.decode()[-500:]
