"""Small graphs for tests."""

from __future__ import annotations

import hashlib

from loomgraph import schema
from loomgraph.schema import Graph


def node(kind: str, fqn: str, file: str | None = None, at: int = 0) -> tuple:
    ident = hashlib.sha256(f"{schema.NODE_KINDS.index(kind)}:{fqn}".encode()).hexdigest()[:32]
    name = fqn.split("(")[0].split(".")[-1]
    return (ident, kind, name, fqn, file, at if file else None, at + 1 if file else None)


class Builder:
    def __init__(self):
        self.nodes: dict[tuple, tuple] = {}
        self.edges: set[tuple] = set()

    def add(self, kind, fqn, file=None, at=0, inside=None):
        n = self.nodes.setdefault((kind, fqn), node(kind, fqn, file, at))
        if inside:
            self.link(inside, "Contains", (kind, fqn))
        return n

    def link(self, a, kind, b):
        ident = lambda x: node(*x)[0]
        self.edges.add((ident(a), ident(b), kind))

    def graph(self, spark) -> Graph:
        return Graph(spark.createDataFrame(list(self.nodes.values()), schema.NODES), spark.createDataFrame(sorted(self.edges), schema.EDGES))


def orchard() -> Builder:
    """An interface with one class that implements it, a second that does so through a base, and a method of each."""
    b = Builder()
    b.add("Project", "Grove", "C:/land/Grove/Grove.csproj")
    b.add("Namespace", "Grove.Trees", inside=("Project", "Grove"))
    for kind, name in (("Interface", "IPlant"), ("Class", "Tree"), ("Class", "Apple"), ("Class", "Hedge")):
        b.add(kind, f"Grove.Trees.{name}", f"C:/land/Grove/{name}.cs", inside=("Namespace", "Grove.Trees"))
        b.add("Method", f"Grove.Trees.{name}.Prune(int)", f"C:/land/Grove/{name}.cs", 5, inside=(kind, f"Grove.Trees.{name}"))
    for name in ("Tree", "Hedge"):
        b.link(("Class", f"Grove.Trees.{name}"), "Implements", ("Interface", "Grove.Trees.IPlant"))
    b.link(("Class", "Grove.Trees.Apple"), "Inherits", ("Class", "Grove.Trees.Tree"))
    return b


def stairs(steps: int) -> Builder:
    """Each step calls the next; a landing contains the last."""
    b = Builder()
    for k in range(steps):
        b.add("Method", f"Tower.Step{k}(bool)")
        if k:
            b.link(("Method", f"Tower.Step{k - 1}(bool)"), "Calls", ("Method", f"Tower.Step{k}(bool)"))
    b.add("Class", "Tower.Landing")
    b.link(("Class", "Tower.Landing"), "Contains", ("Method", f"Tower.Step{steps - 1}(bool)"))
    return b


def millers() -> Builder:
    """Two projects that need each other."""
    b = Builder()
    for p, t in (("Bakery", "Oven"), ("Mill", "Stone")):
        b.add("Project", p, f"C:/land/{p}/{p}.csproj")
        b.add("Class", f"{p}.{t}", f"C:/land/{p}/{t}.cs", inside=("Project", p))
    b.link(("Class", "Bakery.Oven"), "References", ("Class", "Mill.Stone"))
    b.link(("Class", "Mill.Stone"), "References", ("Class", "Bakery.Oven"))
    return b


def kitchen() -> Builder:
    """A method and a check of it in a project of tests."""
    b = Builder()
    for p in ("Kitchen", "KitchenTests"):
        b.add("Project", p, f"C:/land/{p}/{p}.csproj")
    b.add("Class", "Kitchen.Soup", "C:/land/Kitchen/Soup.cs", inside=("Project", "Kitchen"))
    b.add("Method", "Kitchen.Soup.Stir(int)", "C:/land/Kitchen/Soup.cs", 3, inside=("Class", "Kitchen.Soup"))
    b.add("Class", "KitchenTests.SoupChecks", "C:/land/KitchenTests/SoupChecks.cs", inside=("Project", "KitchenTests"))
    b.add("Method", "KitchenTests.SoupChecks.StirsSlowly()", "C:/land/KitchenTests/SoupChecks.cs", 3, inside=("Class", "KitchenTests.SoupChecks"))
    b.link(("Method", "KitchenTests.SoupChecks.StirsSlowly()"), "Calls", ("Method", "Kitchen.Soup.Stir(int)"))
    return b
