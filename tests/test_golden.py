"""The whole run over the sources of ``golden/in`` against kept outputs; ``python tests/test_golden.py`` writes them anew."""

import json
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent / "golden"
sys.path.insert(0, str(HERE.parents[1]))

from confluo.cli import main  # noqa: E402

JOBS = {"default": [], "card": ["-c", str(HERE / "configs/card.json")], "sync": ["-c", str(HERE / "configs/sync.json")], "french": ["--default-country", "FR"]}


@pytest.mark.parametrize("job", JOBS)
def test_output(spark, tmp_path, job):
    assert main(["-i", str(HERE / "in"), "-o", str(tmp_path / "out.json"), "--quiet", *JOBS[job]]) == 0
    assert json.loads((tmp_path / "out.json").read_text()) == json.loads((HERE / "out" / f"{job}.json").read_text())


if __name__ == "__main__":
    for name, args in JOBS.items():
        main(["-i", str(HERE / "in"), "-o", str(HERE / "out" / f"{name}.json"), *args])
