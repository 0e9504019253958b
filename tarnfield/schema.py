"""Policies: which fields documents have, what each holds and how it is analyzed."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import types as T

from .functions.analysis import Analyzer

KINDS = {"text": "text", "id": "id", "id_auto": "id_auto", "int": "int", "integer": "int", "float": "float", "date": "date", "bool": "bool", "struct": "struct", "none": "none"}
OPTIONS = {"$type", "$exact", "$searchable", "$list", "$analyzer", "$weight", "$vector", "$format"}
NUMERIC = ("int", "float", "date", "bool")


class PolicyError(ValueError):
    """A policy, or a request against it, that makes no sense."""


@dataclass(frozen=True)
class Field:
    path: str  #: names joined by /
    kind: str
    repeated: bool = False
    searchable: bool = False
    exact: bool = False
    listed: bool = True
    analyzer: str = ""  #: name; empty for the default
    weight: tuple[int, int] = (0, 100)
    vector: bool = False
    format: str = "YYYY-MM-DD"
    arrays: tuple[str, ...] = ()  #: paths of the arrays around it, the outermost first
    parts: tuple[Field, ...] = ()  #: of a struct

    @property
    def name(self) -> str:
        return self.path.rpartition("/")[2]

    def leaves(self) -> list[Field]:
        return [x for p in self.parts for x in p.leaves()] if self.kind == "struct" else [self]

    def spark(self) -> T.DataType:
        """The type a field is read as; text of any shape, so that a wrong leaf fails its document and not the read."""
        inner: T.DataType = T.StructType([T.StructField(p.name, p.spark()) for p in self.parts]) if self.kind == "struct" else T.StringType()
        return T.ArrayType(inner) if self.repeated else inner


@dataclass(frozen=True)
class Policy:
    fields: tuple[Field, ...]
    analyzers: dict[str, Analyzer] = field(default_factory=dict)

    @classmethod
    def parse(cls, spec: dict) -> Policy:
        if not isinstance(spec.get("document"), dict) or set(spec) - {"analyzers", "document"}:
            raise PolicyError("a policy has the blocks document and, if need be, analyzers")
        analyzers = {}
        for name, options in (spec.get("analyzers") or {}).items():
            try:
                analyzers[name] = Analyzer.parse(options)
            except ValueError as e:
                raise PolicyError(f"analyzer {name}: {e}") from e
        fields = tuple(_field(n, s, "", ()) for n, s in spec["document"].items())
        policy = cls(fields, analyzers)
        ids = [f for f in policy.leaves() if f.kind in ("id", "id_auto")]
        if len(ids) != 1 or ids[0].repeated or ids[0].arrays:
            raise PolicyError("a policy has exactly one id field, outside arrays")
        for f in policy.leaves():
            if f.analyzer and f.analyzer not in analyzers:
                raise PolicyError(f"{f.path}: no analyzer {f.analyzer}")
        return policy

    def leaves(self) -> list[Field]:
        return [x for f in self.fields for x in f.leaves()]

    @cached_property
    def id_field(self) -> Field:
        return next(f for f in self.leaves() if f.kind in ("id", "id_auto"))

    def find(self, path: str) -> Field:
        """The field or struct at a path."""
        here = self.fields
        for i, name in enumerate(parts := path.split("/")):
            found = next((f for f in here if f.name == name), None)
            if found is None:
                raise PolicyError(f"no field {path}")
            if i == len(parts) - 1:
                return found
            here = found.parts
        raise PolicyError(f"no field {path}")

    def analyzer_of(self, f: Field) -> Analyzer:
        if f.kind != "text":
            return Analyzer(tokenizer="keyword")
        return self.analyzers.get(f.analyzer) or self.default

    @property
    def default(self) -> Analyzer:
        return self.analyzers.get("$default") or Analyzer(stemming="english")

    def searched(self, search_fields: list[str] | None = None) -> list[Field]:
        """Leaves the main query runs against; structs stand for their leaves."""
        if search_fields is None:
            return [f for f in self.leaves() if f.searchable]
        out: list[Field] = []
        for path in search_fields:
            found = [f for f in self.find(path).leaves() if f.searchable]
            if not found:
                raise PolicyError(f"{path} is not searchable")
            out += [f for f in found if f not in out]
        return out

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark()) for f in self.fields])


def _field(name: str, spec: object, above: str, arrays: tuple[str, ...]) -> Field:
    path = f"{above}/{name}" if above else name
    if not name or "/" in name or name.startswith("$"):
        raise PolicyError(f"{path}: not a name")
    repeated = isinstance(spec, list)
    if repeated:
        if len(spec) != 1 or isinstance(spec[0], list):
            raise PolicyError(f"{path}: a repeated field is an array of one")
        spec = spec[0]
    if isinstance(spec, str):
        spec = {"$type": spec}
    if not isinstance(spec, dict):
        raise PolicyError(f"{path}: a field is a string, an object or an array of one")
    options = {k: v for k, v in spec.items() if k.startswith("$")}
    names = {k: v for k, v in spec.items() if not k.startswith("$")}
    if unknown := set(options) - OPTIONS:
        raise PolicyError(f"{path}: unknown option {sorted(unknown)[0]}")
    kind = KINDS.get(options.get("$type", "struct" if names else ""))
    if kind is None:
        raise PolicyError(f"{path}: unknown type {options.get('$type')}")
    if (kind == "struct") != bool(names):
        raise PolicyError(f"{path}: only structs have fields of their own")
    low, high = (1, 75) if kind == "text" else (0, 100)
    if weight := options.get("$weight"):
        low, high = weight.get("min", low), weight.get("max", high)
        if low > high:
            raise PolicyError(f"{path}: weight min over max")
    if options.get("$vector") and kind != "text":
        raise PolicyError(f"{path}: only text fields have vectors")
    if options.get("$analyzer") and kind != "text":
        raise PolicyError(f"{path}: only text fields have analyzers")
    inner = (*arrays, path) if repeated else arrays
    parts = tuple(_field(n, s, path, inner) for n, s in names.items())
    if kind == "date" and not re.search("YYYY|epoch-millis", options.get("$format", "YYYY-MM-DD")):
        raise PolicyError(f"{path}: unknown date format")
    return Field(
        path, kind, repeated, options.get("$searchable", kind in ("text", "id")), options.get("$exact", kind not in ("text", "struct", "none")),
        options.get("$list", True), options.get("$analyzer", ""), (low, high), options.get("$vector", False), options.get("$format", "YYYY-MM-DD"), arrays, parts,
    )
