"""Dependencies of objects: declaration, detection from code, order, and a runner by version."""

from __future__ import annotations

import ast
import inspect
import sys
import textwrap
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import SparkSession

from pelorus.plans.objects import DataObject, Format, ManualFiles

#: Depend on what the class's own methods refer to.
AUTO = "auto"
#: The hooks in which references count, and names that the runner itself sets.
HOOKS = ("build", "sources", "transform", "populate", "call", "data", "fit", "write_files", "frames", "arguments")
RESERVED = ("name", "deps", "group", "versions", "formats")


@dataclass(frozen=True)
class Wiring:
    deps: tuple[type[DataObject], ...]
    group: str | None = None
    formats: tuple[Format, ...] = ()
    convert: bool = False
    retries: int = 0
    tags: dict[str, str] = field(default_factory=dict)


_registry: list[type[DataObject]] = []


def referenced(cls: type) -> list[type[DataObject]]:
    """The other objects that the class's own hook methods name, once each, in order of their appearance."""
    scope, found = vars(sys.modules[cls.__module__]), []
    for name in HOOKS:
        if not inspect.isfunction(method := cls.__dict__.get(name)):
            continue
        for node in ast.walk(ast.parse(textwrap.dedent(inspect.getsource(method)))):
            if isinstance(node, ast.Name):
                target = scope.get(node.id) or inspect.getclosurevars(method).nonlocals.get(node.id)
                if inspect.isclass(target) and issubclass(target, DataObject) and target is not cls and target not in found:
                    found.append(target)
    return found


def asset(*, deps: Sequence[type[DataObject]] | str = (), group: str | None = None, formats: Sequence[Format] = (), convert: bool = False, retries: int = 0, **tags: str) -> Callable[[type], type]:
    """Register an object with its dependencies. ``deps=AUTO`` takes them from the code and needs at least one."""
    if bad := sorted(set(tags) & set(RESERVED)):
        raise ValueError(f"reserved names: {', '.join(bad)}")

    def register(cls: type) -> type:
        if not (inspect.isclass(cls) and issubclass(cls, DataObject)):
            raise TypeError(f"{cls!r} is no data object")
        found = referenced(cls) if deps == AUTO else list(deps)
        if deps == AUTO and not found:
            raise ValueError(f"{cls.__name__}: no dependencies found")
        extra = tags if cls.rebuildable else {"rebuildable": "false", **tags}
        cls.wiring = Wiring(tuple(found), group, tuple(formats), convert, retries, extra)
        _registry.append(cls)
        return cls

    return register


@dataclass(frozen=True)
class Lint:
    cls: type
    missing: tuple[type, ...]
    unused: tuple[type, ...]

    @property
    def is_clean(self) -> bool:
        return not self.missing and not self.unused


def lint(cls: type) -> Lint:
    """Declared against referenced dependencies."""
    declared, used = set(cls.wiring.deps), set(referenced(cls))
    by_name = lambda s: tuple(sorted(s, key=lambda c: c.__name__))
    return Lint(cls, by_name(used - declared), by_name(declared - used))


def registered(module: str | None = None) -> list[type[DataObject]]:
    """Registered classes of a module or of the modules below it."""
    return [c for c in _registry if module is None or c.__module__ == module or c.__module__.startswith(f"{module}.")]


def ordered(classes: Iterable[type[DataObject]]) -> list[type[DataObject]]:
    """Dependencies first. Repeated classes or ids, dependencies outside the set and cycles raise ``ValueError``."""
    classes = list(classes)
    ids = [c.id for c in classes]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"repeated: {', '.join(twice)}")
    for c in classes:
        if outside := [d.__name__ for d in c.wiring.deps if d not in classes]:
            raise ValueError(f"{c.__name__} depends on {', '.join(outside)}, which is not in the set")
    try:
        return list(TopologicalSorter({c: c.wiring.deps for c in classes}).static_order())
    except CycleError as e:
        raise ValueError(f"dependencies form a cycle: {' -> '.join(c.__name__ for c in e.args[1])}") from e


def with_overrides(classes: Iterable[type[DataObject]], overrides: dict[type, dict]) -> list[type[DataObject]]:
    """Change wirings by class; unknown keys or classes raise ``ValueError``."""
    classes = list(classes)
    allowed = set(Wiring.__dataclass_fields__)
    for cls, changes in overrides.items():
        if cls not in classes:
            raise ValueError(f"{cls.__name__} is not in the set")
        if bad := sorted(set(changes) - allowed):
            raise ValueError(f"unknown keys: {', '.join(bad)}")
        cls.wiring = replace(cls.wiring, **changes)
    return classes


def partitions(classes: Iterable[type[DataObject]]) -> list[str]:
    """The ids of the versions that all objects have, in the first one's order: the keys by which a run may be split."""
    first, *rest = [[v.id for v in c.supported_versions] for c in classes]
    return [i for i in first if all(i in ids for ids in rest)]


def run(spark: SparkSession, classes: Iterable[type[DataObject]], version_id: str | Sequence[str], *, root: str | None = None, replace: bool = False, formats: Sequence[Format] | None = None) -> list[DataObject]:
    """Make all objects of one version, or of several one after another, in order. What exists is skipped unless
    ``replace``; side formats are made either way. Ledgers go by their own branches, with the wiring's retries."""
    classes, made = ordered(classes), []
    for wanted in [version_id] if isinstance(version_id, str) else version_id:
        for cls in classes:
            version = next((v for v in cls.supported_versions if v.id == wanted), None)
            if version is None:
                raise ValueError(f"{cls.__name__} has no version {wanted!r}")
            made.append(_made(cls(spark, version, root), replace, formats))
    return made


def _made(obj: DataObject, replace: bool, formats: Sequence[Format] | None) -> DataObject:
    cls, wiring = type(obj), type(obj).wiring
    if "retries" in inspect.signature(obj.make).parameters:
        obj.make(replace=replace, retries=wiring.retries)
    elif isinstance(obj, ManualFiles) or replace or not obj.exists():
        obj.make(replace=replace and not isinstance(obj, ManualFiles))
    for fmt in formats if formats is not None else wiring.formats or (cls.formats if wiring.convert else ()):
        if fmt in cls.formats and fmt is not cls.make_format and not isinstance(obj, ManualFiles):
            try:
                obj.convert(fmt, replace=replace)
            except FileExistsError:
                if replace:
                    raise
    return obj


def manifest(classes: Iterable[type[DataObject]]) -> str:
    """The objects in order as text of fixed width: asset, deps, group, formats, tags; ``-`` for nothing."""
    # The header of the manifest.
    rows = [("asset", "deps", "group", "formats", "kwargs")]
    for c in ordered(classes):
        w = c.wiring
        rows.append((c.id, ",".join(d.id for d in w.deps) or "-", w.group or "-", ",".join(f.value for f in w.formats) or "-", ",".join(f"{k}={v}" for k, v in w.tags.items()) or "-"))
    widths = [max(len(r[k]) for r in rows) for k in range(5)]
    return "\n".join("  ".join(cell.ljust(w) for cell, w in zip(r, widths)).rstrip() for r in rows)
