"""TOML configuration: sources, destinations, catalogues, connectors; checks; factories of sources and sinks."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from ..functions.text import connector_table_id
from ..model import TABLE_MODES, ContractError
from ..operators.sink import CatalogSink, FileSink
from .jsonl import FileSource

# Kinds that configurations may name.
CATALOG_KINDS = ("catalog", "polaris")
FOLDERS = {"source": "sources", "destination": "destinations", "catalog": "catalogs", "connector": "connectors"}
CAPTURE = ("publication_name", "slot_name", "bootstrap_policy")


@dataclass(frozen=True)
class Table:
    source_table: str
    destination_namespace: str
    destination_table: str
    table_mode: str
    source_schema: str = ""
    key_columns: tuple[str, ...] = ()
    ordering_field: str | None = None

    @property
    def table_id(self) -> str:
        return connector_table_id(self.destination_namespace, self.destination_table)


@dataclass(frozen=True)
class Connector:
    source: str
    destination: str
    catalog: str | None
    tables: tuple[Table, ...]
    capture: dict = field(default_factory=dict)


def resolve_env(properties: dict[str, str], env=None) -> dict[str, str]:
    """``$NAME`` is taken from the environment, ``$$text`` is ``$text``, the rest as it is."""
    env = os.environ if env is None else env
    out = {}
    for key, value in properties.items():
        if value.startswith("$$"):
            out[key] = value[1:]
        elif value.startswith("$"):
            if value[1:] not in env:
                raise ContractError(f"config property '{key}' references environment variable '{value[1:]}' which could not be loaded")
            out[key] = env[value[1:]]
        else:
            out[key] = value
    return out


def load(kind: str, path: str | Path) -> dict:
    """One file of a kind; its version must be 1, variables are resolved in its properties only."""
    try:
        raw = tomllib.loads(Path(path).read_text())
    except (OSError, tomllib.TOMLDecodeError) as error:
        raise ContractError(f"{path}: {error}") from error
    if raw.get("version") != 1:
        raise ContractError(f"unsupported {kind} config version: {raw.get('version')}")
    raw["properties"] = resolve_env(raw.get("properties", {}))
    return raw


def load_connector(path: str | Path) -> Connector:
    raw = load("connector", path)
    tables = tuple(
        Table(t["source_table"], t["destination_namespace"], t["destination_table"], t["table_mode"], t.get("source_schema", ""), tuple(t.get("key_columns", ())), t.get("ordering_field"))
        for t in raw.get("tables", [])
    )
    return Connector(raw["source"], raw["destination"], raw.get("catalog"), tables, raw.get("capture", {}))


def config_root(connector_path: str | Path) -> Path:
    """The folder above ``connectors/``."""
    path = Path(connector_path)
    if path.parent.name != FOLDERS["connector"]:
        raise ContractError(f"connector config must be in a folder named connectors: {path}")
    return path.parent.parent


def named(root: Path, kind: str, name: str) -> dict:
    return load(kind, root / FOLDERS[kind] / f"{name}.toml")


def catalog_name(connector: Connector, destination: dict) -> str | None:
    """The connector's catalogue, else the destination's; two different ones are an error."""
    left, right = connector.catalog, destination.get("catalog")
    if left and right and left != right:
        raise ContractError(f"connector catalog '{left}' does not match destination catalog '{right}'")
    return left or right


def source_folder(config: dict, beside: Path, table: str) -> str:
    if config["kind"] != "file":
        raise ContractError(f"unsupported source kind: {config['kind']}")
    root = config["properties"].get("fixture_root")
    if root is None:
        raise ContractError("missing property: fixture_root")
    if "://" not in root and not root.startswith("/"):
        root = str((beside / root).resolve())
    return f"{root.rstrip('/')}/{table}"


def build_source(spark: SparkSession, config: dict, beside: Path, table: Table) -> FileSource:
    """The folder of a table's batches, under the connector's name for the table."""
    return FileSource(spark, source_folder(config, beside, table.source_table), table.table_id, f"file.{table.table_id}")


def build_sink(spark: SparkSession, destination: dict, catalog: dict | None, table: Table):
    """(sink, destination uri)."""
    properties = destination["properties"]
    if destination["kind"] == "filesystem":
        root = _required(properties, "root_uri").rstrip("/")
        root = root if "://" in root else f"file://{root}"
        return FileSink(spark, root), f"{root}/{table.table_id}"
    if destination["kind"] in CATALOG_KINDS:
        if catalog is None:
            raise ContractError("catalog destination requires a resolved catalog config")
        auth = catalog["properties"]
        if "bearer_token" not in auth and ("client_id" in auth) != ("client_secret" in auth):
            raise ContractError("catalog config must set both client_id and client_secret together")
        root = _required(properties, "warehouse_uri").rstrip("/")
        return CatalogSink(spark, root, table.destination_namespace or "default"), root
    raise ContractError(f"unsupported destination kind: {destination['kind']}")


def _required(properties: dict, name: str) -> str:
    if name not in properties:
        raise ContractError(f"missing property: {name}")
    return properties[name]


def check_connector(spark: SparkSession, path: str | Path) -> dict:
    """All errors and warnings of a connector, not only the first."""
    connector, root = load_connector(path), config_root(path)
    source, destination = named(root, "source", connector.source), named(root, "destination", connector.destination)
    errors, warnings = [], []
    name = None
    try:
        name = catalog_name(connector, destination)
        if name:
            named(root, "catalog", name)
    except ContractError as error:
        errors.append(str(error))
    if destination["kind"] == "filesystem" and name:
        errors.append(f"destination '{connector.destination}' does not support catalog '{name}'")
    if destination["kind"] in CATALOG_KINDS and not name and not errors:
        errors.append(f"destination '{connector.destination}' requires a catalog reference")
    if destination["kind"] not in ("filesystem", *CATALOG_KINDS):
        errors.append(f"unsupported destination kind: {destination['kind']}")
    if not connector.tables:
        errors.append("connector must declare at least one table")
    if source["kind"] == "file" and any(connector.capture.get(k) for k in CAPTURE):
        errors.append("file source connectors must not declare publication, slot, or bootstrap capture settings")
    for i, t in enumerate(connector.tables):
        keyed = t.table_mode == "keyed_upsert"
        able: list[str] = []
        if t.source_table and source["kind"] == "file":
            reader = FileSource(spark, source_folder(source, root / FOLDERS["source"], t.source_table))
            able = reader.capabilities()
            try:
                reader.check()
            except ContractError as error:
                errors.append(f"source check '{connector.source}': {error}")
        needs = {"append_only": ("append_only",), "keyed_upsert": ("keyed_upsert", "stable_latest_wins_ordering")}.get(t.table_mode, ())
        rules = (
            (t.table_mode not in TABLE_MODES, f"unsupported table_mode '{t.table_mode}'"),
            (not t.source_table, "source_table is required"),
            (not t.destination_table, "destination_table is required"),
            (keyed and not t.key_columns, "keyed_upsert requires key_columns"),
            (keyed and t.ordering_field is None, "keyed_upsert requires ordering_field"),
            *((c not in able, f"source does not advertise {c} capability") for c in needs),
        )
        errors += [f"tables[{i}]: {message}" for broken, message in rules if broken]
        if not t.destination_namespace:
            warnings.append(f"tables[{i}]: empty destination_namespace is allowed but should be deliberate")
    return {"valid": not errors, "errors": errors, "warnings": warnings, "table_count": len(connector.tables)}
