from __future__ import annotations

import os

import pytest

from siltstone.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])
    os.chdir(tmp_path_factory.mktemp("work"))
    session = build_session("tests", master="local[4]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
