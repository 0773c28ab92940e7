"""Durable datasets: Parquet files a version, and a manifest whose appearance commits.

A commit writes the changed datasets, then a checksummed manifest under a temporary name, and renames it: that is the commit point. A restart reads the newest
manifest that is whole and ignores what a torn commit left. ``vacuum`` removes that, and the versions that the newest commit doesn't need.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import StorageError
from ..functions.types import QLType, parse_type
from .catalog import Version
from .schema import MISSING, DatasetSchema

FORMAT = 2


class Storage:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self.jpath = jvm.org.apache.hadoop.fs.Path
        self.fs = self.jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        try:
            self.fs.mkdirs(self.jpath(self.path))
        except Exception as e:
            raise StorageError(f"{path} can't be made: {e}", code="storage_io") from e

    def _manifests(self) -> list[tuple[int, str]]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.jpath(self.path))]
        found = [(int(n[9:-5]), n) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit()]
        return sorted(found, reverse=True)

    def _read(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect())

    def _write(self, name: str, text: str) -> None:
        """Written under another name, then renamed."""
        temporary = self.jpath(f"{self.path}/.{name}.{uuid.uuid4().hex}")
        out = self.fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        if not self.fs.rename(temporary, self.jpath(f"{self.path}/{name}")):
            raise StorageError(f"{name} can't be committed", code="storage_io")

    def load(self) -> dict[str, Version]:
        found = self._manifests()
        for _, name in found:
            try:
                envelope = json.loads(self._read(name))
                body = envelope["state"]
            except (ValueError, KeyError):
                continue
            except Exception as e:
                if "ChecksumException" in str(e):  # torn, too
                    continue
                raise StorageError(f"{name} can't be read: {e}", code="storage_io") from e
            if envelope.get("checksum") != _checksum(body):
                continue
            if body.get("format") != FORMAT:
                raise StorageError(f"{name} has format {body.get('format')}", code="storage_version")
            try:
                return {n: self._version(n, d) for n, d in body["datasets"].items()}
            except StorageError:
                raise
            except Exception as e:
                raise StorageError(f"{name}: {e}", code="storage_corruption") from e
        if found:
            raise StorageError("no manifest is whole", code="storage_corruption")
        return {}

    def _version(self, name: str, d: dict) -> Version:
        schema = DatasetSchema.from_mapping({n: {"type": s["type"], "constraints": [c if isinstance(c, str) else {k: (MISSING if k == "vector" and v is None else v) for k, v in c.items()} for c in s["constraints"]]} for n, s in d["schema"].items()}) if d["schema"] is not None else None
        loose = {n: parse_type(t) if t else None for n, t in d["loose"].items()}
        base = self.spark.read.schema(T.StructType.fromJson(json.loads(d["columns"]))).parquet(f"{self.path}/{d['data']}") if d["data"] else None
        if base is not None and base.count() != d["rows"]:
            raise StorageError(f"{name} has lost rows", code="storage_corruption", dataset=name)
        types = {n: T._parse_datatype_json_string(t) for n, t in d["json_types"].items()}
        links = self.spark.read.schema(T.StructType.fromJson(json.loads(d["link_columns"]))).parquet(f"{self.path}/{d['link_data']}") if d["link_data"] else None
        if links is not None and links.count() != d["link_rows"]:
            raise StorageError(f"{name} has lost links", code="storage_corruption", dataset=name)
        v = Version(
            name, d["kind"], schema, base, next=d["next"], loose=loose, json_types=types, link_base=links, link_fields={k: tuple(x) for k, x in d["link_fields"].items()},
            link_types={n: parse_type(t) if t else None for n, t in d["link_types"].items()}, next_link=d["next_link"],
        )
        v = replace(v, base_fields=v.fields)
        v.cache["stored"] = d
        return v

    def _stored(self, name: str, number: int, df: DataFrame) -> tuple[DataFrame, str]:
        data = f"data/{name}-{number}-{uuid.uuid4().hex}"
        try:
            df.write.parquet(f"{self.path}/{data}")
        except Exception as e:
            raise StorageError(f"{name} can't be written: {e}", code="storage_io") from e
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{data}"), data

    def vacuum(self) -> None:
        kept = None
        for _, name in self._manifests():
            try:
                envelope = json.loads(self._read(name))
            except ValueError:
                continue
            if envelope.get("checksum") == _checksum(envelope.get("state", {})):
                kept = name, {d[k] for d in envelope["state"]["datasets"].values() for k in ("data", "link_data") if d.get(k)}
                break
        if kept is None:
            return
        for folder in ("", "data/"):
            path = self.jpath(f"{self.path}/{folder}")
            for s in self.fs.listStatus(path) if self.fs.exists(path) else ():
                name = s.getPath().getName()
                old = name.lstrip(".").startswith("manifest-") and name != kept[0] and not name.startswith(f".{kept[0]}.crc") if not folder else f"data/{name}" not in kept[1]
                if old:
                    self.fs.delete(s.getPath(), True)

    def persist(self, state: dict[str, Version], before: dict[str, Version], transaction: str) -> dict[str, Version]:
        from .catalog import Engine

        number = (self._manifests() or [(0, "")])[0][0] + 1
        out, told = {}, {}
        helper = Engine.__new__(Engine)
        helper.spark, helper.frames, helper.committed = self.spark, [], state
        for name, v in state.items():
            if "stored" in v.cache:
                out[name], told[name] = v, v.cache["stored"]
                continue
            data, rows, columns = None, 0, None
            if v.rows or v.base is not None:
                base, data = self._stored(name, number, helper._frame(v, state).df)
                rows, columns = base.count(), base.schema.json()
                v = replace(v, base=base, base_fields=v.fields, rows=(), hidden=(), cache={})
            link_data, link_rows, link_columns = None, 0, None
            if v.links or v.link_base is not None:
                links, link_types = helper._links(v)
                links, link_data = self._stored(f"{name}-links", number, links)
                link_rows, link_columns = links.count(), links.schema.json()
                v = replace(v, link_base=links, links=(), link_types=link_types, cache={})
            named = lambda types: {n: str(t) if isinstance(t, QLType) else None for n, t in types.items()}
            d = {
                "kind": v.kind, "schema": {n: f.to_dict() for n, f in v.schema.fields.items()} if v.schema else None, "loose": named(v.loose), "data": data, "rows": rows, "columns": columns,
                "json_types": {n: t.json() for n, t in v.json_types.items()}, "next": v.next, "link_data": link_data, "link_rows": link_rows, "link_columns": link_columns, "link_types": named(v.link_types),
                "link_fields": {k: list(x) for k, x in v.link_fields.items()}, "next_link": v.next_link,
            }
            d = json.loads(json.dumps(d, default=_literal))
            v = replace(v, cache={"stored": d})
            out[name], told[name] = v, d
        body = {"format": FORMAT, "transaction": transaction, "datasets": told}
        self._write(f"manifest-{number:012d}.json", json.dumps({"checksum": _checksum(body), "state": body}))
        return out


def _literal(x):
    """A default as a value that a cast to its field's type gives back."""
    if isinstance(x, dt.timedelta):
        return x.total_seconds()
    if isinstance(x, bytes):
        return x.decode()
    if isinstance(x, (set, frozenset, tuple)):
        return list(x)
    return x.isoformat() if hasattr(x, "isoformat") else str(x)


def _checksum(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
