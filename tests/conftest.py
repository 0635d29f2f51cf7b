import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


AUTH = """import hashlib
from .db import lookup_user

def hash_password(pw):
    return hashlib.sha256(pw.encode()).hexdigest()

class Authenticator:
    def __init__(self, db):
        self.db = db
    def login(self, user, pw):
        record = lookup_user(self.db, user)
        return record and hash_password(pw) == record['hash']
"""


def write_tree(root: Path, files: dict[str, str]) -> Path:
    for rel, text in files.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text(text, encoding="utf-8")
    return root


#: A small Python project: 21 nodes, 19 edges, 4 components.
PROJECT = {
    "main.py": "from pkg.auth import Authenticator\n\ndef run():\n    a = Authenticator({})\n    return a.login('x', 'y')\n",
    "pkg/__init__.py": "",
    "pkg/auth.py": AUTH,
    "pkg/db.py": "def lookup_user(db, name):\n    return db.get(name)\n",
}


@pytest.fixture
def python_tree(tmp_path):
    return write_tree(tmp_path / "project", PROJECT)


@pytest.fixture
def mixed_tree(tmp_path):
    """Three languages: 10 nodes, 7 edges, 3 components."""
    return write_tree(tmp_path / "mixed", {
        "README.md": "# Sample\n\n## Overview\n\nSee [docs](docs/index.html).\n",
        "client.js": "import fetch from 'node-fetch';\nexport function call() { return fetch('/'); }\nexport class Client { run() { return call(); } }\n",
        "service.py": "def handler(event):\n    return {'ok': True}\n",
    })
