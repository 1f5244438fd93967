"""Catalog answers over lake tables, and the registration of tables with Spark's own catalog."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from urllib.parse import quote

from pyspark.sql import SparkSession

from ..schema import check_table_name
from .lake import LakeTable, tables


class NoSuchNamespace(KeyError):
    pass


class NoSuchTable(KeyError):
    pass


class Catalog:
    """One namespace of one or more levels over a lake root."""

    def __init__(self, spark: SparkSession, root: str, namespace: str = "eventlake"):
        self.spark, self.root, self.levels = spark, root, levels(namespace, ".")

    def config(self) -> dict:
        return {"defaults": {}, "overrides": {"warehouse": self.root, "namespace-separator": "%1F"}, "endpoints": [
            "GET /v1/config", "GET /v1/namespaces", "GET /v1/namespaces/{namespace}", "GET /v1/namespaces/{namespace}/tables", "GET /v1/namespaces/{namespace}/tables/{table}", "HEAD /v1/namespaces/{namespace}/tables/{table}",
        ]}

    def namespaces(self, parent: str | None = None) -> list[list[str]]:
        """One level below the parent; the first level without one."""
        above = levels(parent or "")
        if above and above != self.levels[: len(above)]:
            raise NoSuchNamespace(parent)
        return [self.levels[: len(above) + 1]] if len(self.levels) > len(above) else []

    def namespace(self, name: str) -> dict:
        if levels(name) != self.levels:
            raise NoSuchNamespace(name)
        return {"namespace": self.levels, "properties": {"location": self.root}}

    def tables(self, namespace: str) -> list[str]:
        self.namespace(namespace)
        return [r.name for r in tables(self.spark, self.root).collect()]  # names of directories

    def table(self, namespace: str, name: str) -> dict:
        self.namespace(namespace)
        found = LakeTable(self.spark, self.root, check_table_name(name))
        if not (n := found.version()):
            raise NoSuchTable(name)
        return {"metadata-location": f"{found.base}/metadata/v{n}.metadata.json", "metadata": found.metadata(), "config": {}}

    def exists(self, namespace: str, name: str) -> bool:
        try:
            return bool(self.table(namespace, name))
        except (NoSuchNamespace, NoSuchTable, ValueError):
            return False

    def register(self, name: str) -> str:
        """A temporary view on the table's current snapshot, for SQL."""
        LakeTable(self.spark, self.root, name).read().createOrReplaceTempView(view := name.replace("-", "_"))
        return view

    def register_external(self, url: str, name: str, timeout_s: float = 10.0) -> str | None:
        """Tells another catalog's REST service of the table and its current snapshot; None, or what went wrong. The lake doesn't depend on it.

        The namespace and the table are created unless they are there; then the snapshot is added and made the branch main's.
        """
        table = LakeTable(self.spark, self.root, check_table_name(name))
        doc, space = table.metadata(), f"{url.rstrip('/')}/v1/namespaces"
        own = f"{space}/{quote(chr(31).join(self.levels), safe='')}/tables"

        def post(path: str, body: dict, there_is_fine: bool) -> None:
            request = urllib.request.Request(path, json.dumps(body).encode(), {"Content-Type": "application/json"}, method="POST")
            try:
                urllib.request.urlopen(request, timeout=timeout_s).close()
            except urllib.error.HTTPError as e:
                if not (there_is_fine and e.code == 409):
                    raise

        try:
            post(space, {"namespace": self.levels, "properties": {}}, True)
            post(own, {"name": name, "location": table.base, "schema": doc["schemas"][0], "partition-spec": doc["partition-specs"][0], "write-order": doc["sort-orders"][0], "properties": {}}, True)
            if snapshot := table.snapshot():
                point = {"action": "set-snapshot-ref", "ref-name": "main", "type": "branch", "snapshot-id": snapshot["snapshot-id"]}
                post(f"{own}/{name}", {"requirements": [], "updates": [{"action": "add-snapshot", "snapshot": snapshot}, point]}, False)
        except OSError as e:
            return str(e)
        return None

    def drop(self, name: str) -> None:
        self.spark.catalog.dropTempView(name.replace("-", "_"))


def levels(text: str, separator: str = "\x1f") -> list[str]:
    return [x for x in (p.strip() for p in text.split(separator)) if x]
