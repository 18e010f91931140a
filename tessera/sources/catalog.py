"""Addressing: a table is named by its uri, or by a catalog implementation and a table id."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession

from tessera.sources import manifest, storage

CACHE_SIZE = int(os.environ.get("TESSERA_CATALOG_CACHE_SIZE", "16"))


class Catalog(Protocol):
    """What a catalog implementation offers."""

    def describe(self, spark: SparkSession, table_id: tuple[str, ...]) -> str:
        """The uri of a known table; LookupError otherwise."""

    def declare(self, spark: SparkSession, table_id: tuple[str, ...], location: str | None = None) -> str:
        """The uri of a table that may be new."""


class DirCatalog:
    """Tables are folders below a root."""

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    def _uri(self, table_id: tuple[str, ...]) -> str:
        return "/".join((self.root, *table_id))

    def describe(self, spark: SparkSession, table_id: tuple[str, ...]) -> str:
        uri = self._uri(table_id)
        if not manifest.versions(spark, uri):
            raise LookupError(f"table {'.'.join(table_id)} was not found in {self.root}")
        return uri

    def declare(self, spark: SparkSession, table_id: tuple[str, ...], location: str | None = None) -> str:
        uri = location or self._uri(table_id)
        storage.make_folder(spark, uri)
        return uri


class RestCatalog:
    """A catalog server: JSON over HTTP, POST v1/table/<id>/describe and v1/table/<id>/declare.

    Properties: `uri` of the server, `delimiter` between the parts of an id ("$"), and `header.<name>` for headers. An answer has
    the table's `location` and may have `storage_options`, which are renewed before they end.
    """

    def __init__(self, properties: dict[str, str]) -> None:
        self.uri, self.delimiter = properties["uri"].rstrip("/"), properties.get("delimiter", "$")
        self.headers = {k.removeprefix("header."): v for k, v in properties.items() if k.startswith("header.")}

    def _post(self, table_id: tuple[str, ...], action: str, body: dict) -> dict:
        name = quote(self.delimiter.join(table_id), safe="")
        data = json.dumps(body | {"id": list(table_id)}).encode()
        request = Request(f"{self.uri}/v1/table/{name}/{action}", data, {"Content-Type": "application/json", **self.headers}, method="POST")
        try:
            with urlopen(request, timeout=60) as answer:
                return json.load(answer)
        except HTTPError as e:
            if e.code == 404:
                raise LookupError(f"table {'.'.join(table_id)} was not found at {self.uri}") from e
            raise

    def _ask(self, spark: SparkSession, table_id: tuple[str, ...], action: str, body: dict) -> str:
        found = self._post(table_id, action, body)
        location = found["location"].rstrip("/")
        storage.grant(spark, location, found.get("storage_options"), lambda: self._post(table_id, "describe", {}).get("storage_options") or {})
        return location

    def describe(self, spark: SparkSession, table_id: tuple[str, ...]) -> str:
        return self._ask(spark, table_id, "describe", {})

    def declare(self, spark: SparkSession, table_id: tuple[str, ...], location: str | None = None) -> str:
        return self._ask(spark, table_id, "declare", {"location": location} if location else {})


_makers: dict[str, Callable[[dict[str, str]], Catalog]] = {"dir": lambda props: DirCatalog(props["root"]), "rest": RestCatalog}


def register(name: str, make: Callable[[dict[str, str]], Catalog]) -> None:
    """Add a catalog implementation."""
    _makers[name] = make
    _open.cache_clear()


@lru_cache(maxsize=CACHE_SIZE)
def _open(name: str, properties: tuple[tuple[str, str], ...]) -> Catalog:
    if name not in _makers:
        raise ValueError(f"unknown implementation {name!r}; registered: {', '.join(sorted(_makers))}")
    return _makers[name](dict(properties))


def open_catalog(name: str, properties: dict[str, str] | None = None) -> Catalog:
    """A catalog, kept for its name and properties; only the driver resolves."""
    return _open(name, tuple(sorted((properties or {}).items())))


def has_catalog(namespace_impl: str | None, table_id: list[str] | None) -> bool:
    return namespace_impl is not None and table_id is not None


def resolve(spark: SparkSession, uri: str | None, namespace_impl: str | None = None, namespace_properties: dict[str, str] | None = None, table_id: list[str] | None = None) -> str:
    """The uri of an existing address; exactly one kind must be given."""
    by_catalog = has_catalog(namespace_impl, table_id)
    if uri is not None and by_catalog:
        raise ValueError("Cannot provide both 'uri' and namespace parameters ('namespace_impl' and 'table_id')")
    if uri is None and not by_catalog:
        raise ValueError("Must provide either 'uri' or both 'namespace_impl' and 'table_id'")
    if uri is not None:
        if not str(uri):
            raise ValueError("'uri' is empty")
        return str(uri).rstrip("/")
    return open_catalog(namespace_impl, namespace_properties).describe(spark, tuple(table_id))


def resolve_for_write(spark: SparkSession, mode: str, uri: str | None, namespace_impl: str | None, namespace_properties: dict[str, str] | None, table_id: list[str] | None) -> str:
    """As `resolve`; create and overwrite may also declare a table, at `uri` if that is given too."""
    by_catalog = has_catalog(namespace_impl, table_id)
    if uri is None and not by_catalog:
        raise ValueError("Must provide either 'uri' or both 'namespace_impl' and 'table_id'")
    if mode == "append" or not by_catalog:
        return resolve(spark, uri, namespace_impl, namespace_properties, table_id)
    catalog, name = open_catalog(namespace_impl, namespace_properties), tuple(table_id)
    if mode == "overwrite" and uri is None:
        try:
            return catalog.describe(spark, name)
        except LookupError:
            pass
    return catalog.declare(spark, name, uri).rstrip("/")
