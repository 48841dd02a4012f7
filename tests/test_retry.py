"""Failed tasks are retried and the answers stay the same (run in its own Spark process)."""

import json
import os
import subprocess
import sys

from tests import incident_fixture as FX


def test_answers_survive_task_retries():
    probe = os.path.join(os.path.dirname(os.path.abspath(__file__)), "retry_probe.py")
    proc = subprocess.run([sys.executable, probe], capture_output=True, text=True, timeout=600)
    lines = [ln for ln in proc.stdout.splitlines() if ln.startswith("ANSWERS ")]
    assert lines, proc.stderr[-2000:]
    got = json.loads(lines[-1][len("ANSWERS "):])
    failed = [int(ln.split()[1]) for ln in proc.stdout.splitlines() if ln.startswith("FAILED_TASKS ")]
    assert failed and failed[0] > 0, "no task failure was injected"
    staged = json.loads([ln for ln in proc.stdout.splitlines() if ln.startswith("STAGED ")][-1][7:])
    for name, expected in FX.EXPECTED.items():
        assert got[name] == sorted([list(r) for r in expected], key=str), name
        assert staged[name] == got[name], name
