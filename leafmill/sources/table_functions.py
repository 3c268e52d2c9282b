"""Table functions for SQL: nodes of markup, and strings, embedded files and cabinet entries of binary columns, by LATERAL joins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

from leafmill.operators.nodes import matched, tokens
from leafmill.sources import binary


class Nodes:
    def eval(self, html: str) -> Iterator[tuple]:
        kinds, names, raws, counted = tokens(html or "")
        made = matched(kinds, names, raws, counted)
        for i, (kind, parent, end) in enumerate(zip(made["kind"], made["parent"], made["end"], strict=True)):
            yield i, raws[i], kind, "" if kind == "text" else names[i], parent, end


class Strings:
    def eval(self, content: bytes) -> Iterator[tuple]:
        yield from binary.strings(bytes(content or b""))


class Carved:
    def eval(self, content: bytes) -> Iterator[tuple]:
        for kind, extension, name, mime, start, data in binary.carve(bytes(content or b"")):
            yield kind, extension, name, mime, start, data


class Cabinet:
    def eval(self, content: bytes) -> Iterator[tuple]:
        """Entries and the compression of their folders; nothing for broken cabinets."""
        try:
            folders, entries, _ = binary.cabinet(bytes(content or b""))
        except ValueError:
            return
        for name, size, at, folder in entries:
            kind = folders[folder][2] & 15 if folder >= 0 else -1
            yield name, size, at, folder, binary.KINDS[kind] if 0 <= kind < len(binary.KINDS) else "unknown"


#: Functions by name, with what their rows hold.
FUNCTIONS = {
    "leaf_nodes": (Nodes, "pos int, raw string, kind string, name string, parent int, last int"),
    "leaf_strings": (Strings, "encoding string, value string, first long, last long"),
    "leaf_carved": (Carved, "kind string, extension string, name string, mime string, first long, content binary"),
    "leaf_cabinet": (Cabinet, "name string, size long, first long, folder int, compression string"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the table functions known to spark.sql(); returns their names. Null input gives no rows."""
    from pyspark.sql.functions import udtf

    for name, (handler, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=schema))
    return list(FUNCTIONS)
