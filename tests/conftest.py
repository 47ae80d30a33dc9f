import sys
import time
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tidemart.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 4, **{
        "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def drop_file(tmp_path):
    """Write lines as the next file of a folder, later than all before it."""
    count = {}

    def write(folder, lines):
        target = tmp_path / folder
        target.mkdir(exist_ok=True)
        n = count[folder] = count.get(folder, 0) + 1
        (target / f"{n:04d}.txt").write_text("\n".join(lines) + "\n")
        time.sleep(0.02)
        return str(target)

    return write
