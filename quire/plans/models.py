"""Document models: fields, template, tags, lineage."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import FieldEditError, RegistryError
from .markers import markers_in

KINDS: dict[str, T.DataType] = {
    "str": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "list": T.ArrayType(T.StringType()),
    "rows": T.ArrayType(T.MapType(T.StringType(), T.StringType())),
    "dict": T.VariantType(),
}


@dataclass(frozen=True)
class Field:
    """A described field; optional ones may be null."""

    name: str
    kind: str = "str"
    description: str = ""
    optional: bool = False
    default: Any = None

    def __post_init__(self):
        if not self.description.strip():
            raise TypeError(f"field {self.name!r} needs a description")
        if self.kind not in KINDS:
            raise RegistryError(f"field {self.name!r} has unknown kind {self.kind!r}")


@dataclass(frozen=True)
class Composition:
    """A text made of child documents: ``field`` holds their names or paths, ``line`` formats each; they are of ``model``."""

    field: str
    line: str
    separator: str = "\n"
    model: str | None = None


@dataclass(frozen=True)
class Model:
    """A schema with a Markdown template. ``parents`` are the models it specialises."""

    name: str
    template: str
    fields: tuple[Field, ...]
    semantics: dict[str, Any] = field(default_factory=dict, hash=False)
    family: str | None = None
    parents: tuple[Model, ...] = ()
    compositions: dict[str, Composition] = field(default_factory=dict, hash=False)
    version: int = 1

    @classmethod
    def from_spec(cls, spec: dict[str, Any]) -> Model:
        """From {name, template, fields: {name: {type, description, ...}}, semantics, family, compositions: {name: {field, line, separator, model}}}."""
        kinds = {"list[str]": "list", "string": "str", "dict[str, Any]": "dict"}
        fields = tuple(
            Field(n, kinds.get(x.get("type", "str"), x.get("type", "str")), x.get("description", ""), bool(x.get("optional")), x.get("default"))
            for n, x in spec.get("fields", {}).items()
        )
        composed = {n: Composition(**x) for n, x in (spec.get("compositions") or {}).items()}
        return cls(spec["name"], spec.get("template", ""), fields, spec.get("semantics") or {}, spec.get("family"), compositions=composed)

    def to_spec(self) -> dict[str, Any]:
        """What ``from_spec`` reads."""
        fields = {f.name: {"type": f.kind, "description": f.description, "optional": f.optional, "default": f.default} for f in self.fields}
        return {"name": self.name, "template": self.template, "fields": fields, "semantics": self.semantics, "family": self.family}

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, KINDS[f.kind], True, {"comment": f.description}) for f in self.fields])

    def named(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def with_template(self, template: str) -> Model:
        """A draft with another template, which may name known fields only."""
        unknown = {m.name for m in markers_in(template) if m.kind in ("rev", "optrev", "render") and m.name} - {f.name for f in self.fields} - set(self.compositions)
        # columns of a table and items of a list name parts of a field, not fields
        nested = {m.name for line in template.splitlines() if "|" in line for m in markers_in(line)}
        if unknown - nested:
            raise FieldEditError(f"the template names unknown fields: {', '.join(sorted(unknown - nested))}")
        return replace(self, template=template)

    def with_field(self, added: Field) -> Model:
        if self.named(added.name):
            raise FieldEditError(f"{self.name} has a field {added.name!r}")
        return replace(self, fields=(*self.fields, added))

    def without_field(self, name: str) -> Model:
        if not self.named(name):
            raise FieldEditError(f"{self.name} has no field {name!r}")
        return replace(self, fields=tuple(f for f in self.fields if f.name != name))

    def promoted(self) -> Model:
        return replace(self, version=self.version + 1)

    def ancestors(self) -> list[str]:
        """Itself and all that it specialises."""
        return list(dict.fromkeys([self.name, *(a for p in self.parents for a in p.ancestors())]))


def model_tags(semantics: dict[str, Any]) -> list[str]:
    """Dotted tags: text gives ``key.text``, a list one tag over its parts, a mapping one for each of its keys."""
    def text(x: Any) -> str | None:
        return str(x).strip() or None if x is not None else None

    out = set()
    for key, value in semantics.items():
        if isinstance(value, dict):
            for k, v in value.items():
                parts = v if isinstance(v, (list, tuple)) else [v]
                out.add(".".join([key, k, *filter(None, map(text, parts))]))
        else:
            parts = list(filter(None, map(text, value if isinstance(value, (list, tuple)) else [value])))
            if parts:
                out.add(".".join([key, *parts]))
    return sorted(out)


class Registry:
    """Models by name, and their tables."""

    def __init__(self, *models: Model):
        self.models: dict[str, Model] = {}
        for m in models:
            self.add(m)

    def add(self, model: Model) -> None:
        if model.name in self.models:
            raise RegistryError(f"model {model.name!r} is registered")
        self.models[model.name] = model

    def __getitem__(self, name: str) -> Model:
        if name not in self.models:
            raise RegistryError(f"unknown model {name!r}")
        return self.models[name]

    def descendants(self, name: str) -> list[str]:
        """``name`` and all registered models that specialise it."""
        return [m.name for m in self.models.values() if name in m.ancestors()]

    def table(self, spark: SparkSession, store: str = "local") -> DataFrame:
        rows = [(store, m.name, m.version, m.family, len(m.fields), model_tags(m.semantics), m.template) for m in self.models.values()]
        return spark.createDataFrame(rows, "store string, model string, version int, family string, field_count int, semantics array<string>, template string")

    def fields_table(self, spark: SparkSession) -> DataFrame:
        rows = [(m.name, i, f.name, f.kind, f.optional, f.description) for m in self.models.values() for i, f in enumerate(m.fields)]
        return spark.createDataFrame(rows, "model string, position int, field string, kind string, optional boolean, description string")

    def lineage(self, spark: SparkSession) -> DataFrame:
        """The closure of specialisation: (ancestor, descendant), each model its own ancestor."""
        return spark.createDataFrame([(a, m.name) for m in self.models.values() for a in m.ancestors()], "ancestor string, descendant string")
