"""The engine's objects by name, and the order in which they depend on each other."""

from __future__ import annotations

from dataclasses import dataclass, field

from eddyflow.errors import CatalogError


@dataclass
class Object:
    """A source, table, lookup table, stream, view or sink, with the statement that made it."""

    kind: str  # source, table, lookup, stream, view, sink
    name: str
    ddl: str
    columns: list[tuple[str, str]] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    sql: str | None = None
    emit: str | None = None
    watermark: tuple[str, int] | None = None  # column, delay in microseconds
    lateness_us: int = 0
    connector: str | None = None
    options: dict = field(default_factory=dict)
    inputs: list[str] = field(default_factory=list)
    where: str | None = None


class Catalog:
    def __init__(self):
        self.objects: dict[str, Object] = {}

    def add(self, x: Object, *, replace: bool = False, missing_ok: bool = False) -> bool:
        """Add an object; False if it is there already and that is no error."""
        if x.name in self.objects and not replace:
            if missing_ok:
                return False
            raise CatalogError(f"{x.name} exists")
        for name in x.inputs:
            if name == x.name or x.name in self.upstream(name):
                raise CatalogError(f"{x.name} would depend on itself")
        self.objects[x.name] = x
        return True

    def get(self, name: str, *kinds: str) -> Object:
        x = self.objects.get(name)
        if x is None or kinds and x.kind not in kinds:
            raise CatalogError(f"no {' or '.join(kinds) or 'object'} {name!r}")
        return x

    def of(self, *kinds: str) -> list[Object]:
        return [x for x in self.objects.values() if x.kind in kinds]

    def downstream(self, name: str) -> list[str]:
        """What depends on an object, inputs before what reads them."""
        hit = {name}
        order = self.order()
        for n in order:
            if n not in hit and hit & set(self.objects[n].inputs):
                hit.add(n)
        return [n for n in order if n in hit and n != name]

    def upstream(self, name: str) -> set[str]:
        out: set[str] = set()
        todo = list(self.objects[name].inputs) if name in self.objects else []
        while todo:
            n = todo.pop()
            if n not in out:
                out.add(n)
                todo += self.objects[n].inputs if n in self.objects else []
        return out

    def order(self) -> list[str]:
        """All names, inputs before what reads them."""
        out: list[str] = []
        busy: set[str] = set()

        def visit(n: str) -> None:
            if n in out or n not in self.objects:
                return
            if n in busy:
                raise CatalogError(f"{n} depends on itself")
            busy.add(n)
            for m in self.objects[n].inputs:
                visit(m)
            out.append(n)

        for n in self.objects:
            visit(n)
        return out

    def drop(self, name: str, *kinds: str, cascade: bool = False, missing_ok: bool = False) -> list[str]:
        if name not in self.objects and missing_ok:
            return []
        self.get(name, *kinds)
        below = self.downstream(name)
        if below and not cascade:
            raise CatalogError(f"{', '.join(below)} depend on {name}; use CASCADE")
        gone = [*reversed(below), name]
        for n in gone:
            del self.objects[n]
        return gone
