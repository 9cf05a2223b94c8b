"""Files to nodes and raw edges: one file at a time, on the executors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions import extract_javascript
from symgraph.functions.extract_python import extract
from symgraph.sources.files import LANGUAGES

_NODE = ["id", "name", "kind", "path", "start_line", "end_line", "body_hash", "owner", "signature", "exported", "origin", "chars", "body"]
_RAW = ["source", "relation", "file", "target_id", "specifier", "name", "imported_name", "via_member", "recv_type", "scope_id", "seq"]
TAGGED = (
    "tag string, file_ord int, seq int, id string, name string, kind string, path string, start_line int, end_line int, body_hash string, owner string, signature string, exported boolean, origin string, chars long, body string, "
    "source string, relation string, file string, target_id string, specifier string, imported_name string, via_member string, recv_type string, scope_id string"
)
_COLUMNS = [x.split()[0] for x in TAGGED.split(", ")]


def extract_files(files: DataFrame) -> DataFrame:
    """Tagged rows (node, raw) of files (path, content, file_ord). Python is parsed, JavaScript and TypeScript scanned; other files give their file node."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content, order in zip(frame["path"], frame["content"], frame["file_ord"], strict=True):
                language = LANGUAGES.get("." + path.rsplit(".", 1)[-1].lower())
                if language == "python":
                    nodes, raw = extract(path, content)
                elif language in ("javascript", "typescript", "tsx"):
                    nodes, raw = extract_javascript.extract(path, content)
                else:
                    nodes, raw = _only_file(path, content), []
                rows += [{"tag": "node", "file_ord": order, "seq": i, **n} for i, n in enumerate(nodes)]
                rows += [{"tag": "raw", "file_ord": order, **r} for r in raw]
            out = pd.DataFrame(rows, columns=_COLUMNS)
            for c in ("start_line", "end_line", "seq", "file_ord"):
                out[c] = out[c].astype("Int32")
            out["chars"] = out["chars"].astype("Int64")
            out["exported"] = out["exported"].astype("boolean")
            yield out.astype({c: object for c in _COLUMNS if out[c].dtype == float}).where(out.notna(), None)

    return files.select("path", "content", "file_ord").mapInPandas(run, TAGGED)


def _only_file(path: str, content: str) -> list[dict]:
    nodes, _ = extract(path, "")
    nodes[0] |= {"end_line": content.count("\n") + 1, "body_hash": hashlib.sha256(content.encode()).hexdigest(), "chars": len(content.encode("utf-16-le")) // 2, "body": " ".join(content.split())[:16_000]}
    return nodes


def nodes_of(tagged: DataFrame) -> DataFrame:
    return tagged.filter("tag = 'node'").select(*_NODE, (F.col("file_ord").cast("long") * (1 << 32) + F.col("seq")).alias("ord"))


def raw_edges_of(tagged: DataFrame) -> DataFrame:
    return tagged.filter("tag = 'raw'").select(*_RAW, "file_ord")
