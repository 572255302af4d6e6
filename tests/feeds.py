"""A feed for tests: pages are files ``page-0.json``, ``page-1.json``, ... of a folder."""

import json
from pathlib import Path


def folder(where):
    def page(cursor):
        n = int(cursor or 0)
        path = Path(where) / f"page-{n}.json"
        items = json.loads(path.read_text()) if path.exists() else []
        return items, str(n + 1) if (Path(where) / f"page-{n + 1}.json").exists() else None

    return page
