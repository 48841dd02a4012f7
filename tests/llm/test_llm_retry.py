"""Failed tasks are retried and the operators' rows stay the same (in a Spark process of its own)."""

import json
import os
import subprocess
import sys


def test_rows_survive_task_retries():
    probe = os.path.join(os.path.dirname(os.path.abspath(__file__)), "retry_probe.py")
    proc = subprocess.run([sys.executable, probe], capture_output=True, text=True, timeout=600)
    lines = dict(ln.split(" ", 1) for ln in proc.stdout.splitlines() if ln.startswith(("ROWS ", "FAILED_TASKS ")))
    assert "ROWS" in lines, proc.stderr[-2000:]
    assert int(lines["FAILED_TASKS"]) >= 9, "no task failures were injected"
    for name, (calm, shaken) in json.loads(lines["ROWS"]).items():
        assert calm and shaken == calm, name
