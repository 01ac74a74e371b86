"""Pipelines as data: nodes, typed ports and edges, with JSON, ordering, edits and validation."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from brindle.plans.modules import MODULES, Module


@dataclass
class Node:
    id: str
    module: str
    label: str = ""
    parameters: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    source: str
    source_port: int
    target: str
    target_port: int


@dataclass(frozen=True)
class Issue:
    node: str | None
    severity: str  # "error" or "warning"
    message: str


class GraphError(ValueError):
    """An edit or a plan that the graph's rules refuse."""


@dataclass
class Graph:
    nodes: list[Node] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"nodes": [asdict(n) for n in self.nodes], "edges": [asdict(e) for e in self.edges]})

    @classmethod
    def from_json(cls, text: str) -> Graph:
        """A graph from its JSON; text that is none gives an empty graph."""
        try:
            data = json.loads(text)
            return cls([Node(**n) for n in data.get("nodes", [])], [Edge(**e) for e in data.get("edges", [])])
        except (ValueError, TypeError, AttributeError):
            return cls()

    def node(self, id: str) -> Node:
        found = next((n for n in self.nodes if n.id == id), None)
        if found is None:
            raise GraphError(f"There is no module '{id}' on the canvas.")
        return found

    def inbound(self, id: str) -> list[Edge]:
        return sorted((e for e in self.edges if e.target == id), key=lambda e: e.target_port)

    def outbound(self, id: str) -> list[Edge]:
        return [e for e in self.edges if e.source == id]

    # Edits, in the order that one builds a pipeline.

    def add(self, module: str, label: str | None = None, **parameters) -> str:
        if module not in MODULES:
            raise GraphError(f"Unknown module '{module}'.")
        id = f"n{len(self.nodes) + 1}-{uuid.uuid4().hex[:6]}"
        self.nodes.append(Node(id, module, label or MODULES[module].name, {k: str(v) for k, v in parameters.items()}))
        return id

    def connect(self, source: str, target: str, source_port: int = 0, target_port: int = 0) -> None:
        """Add an edge: port types must agree, an input takes one edge, and no cycle may form."""
        a, b = MODULES[self.node(source).module], MODULES[self.node(target).module]
        if source_port >= len(a.outputs):
            raise GraphError(f"'{a.name}' has no output {source_port}.")
        if target_port >= len(b.inputs):
            raise GraphError(f"'{b.name}' has no input {target_port}.")
        gives, takes = a.outputs[source_port], b.inputs[target_port]
        if gives.kind != takes.kind:
            raise GraphError(f"'{gives.name}' of '{a.name}' is a {gives.kind}, but '{takes.name}' of '{b.name}' takes a {takes.kind}.")
        if any(e.target == target and e.target_port == target_port for e in self.edges):
            raise GraphError(f"'{takes.name}' of '{b.name}' is connected already.")
        self.edges.append(Edge(source, source_port, target, target_port))
        try:
            self.ordered()
        except GraphError:
            self.edges.pop()
            raise GraphError("That connection would close a cycle.") from None

    def set_parameter(self, id: str, name: str, value: str) -> None:
        node = self.node(id)
        if name not in {p.name for p in MODULES[node.module].parameters}:
            raise GraphError(f"'{node.label}' has no parameter '{name}'.")
        node.parameters[name] = str(value)

    def remove(self, id: str) -> None:
        self.node(id)
        self.nodes = [n for n in self.nodes if n.id != id]
        self.edges = [e for e in self.edges if id not in (e.source, e.target)]

    def ordered(self) -> list[Node]:
        """Nodes so that every edge points forward; edges to missing nodes are ignored, a cycle raises."""
        known = {n.id for n in self.nodes}
        edges = [e for e in self.edges if e.source in known and e.target in known]
        waiting = {n.id: sum(e.target == n.id for e in edges) for n in self.nodes}
        ready, out = [n for n in self.nodes if not waiting[n.id]], []
        while ready:
            n = ready.pop(0)
            out.append(n)
            for e in (e for e in edges if e.source == n.id):
                waiting[e.target] -= 1
                if not waiting[e.target]:
                    ready.append(self.node(e.target))
        if len(out) < len(self.nodes):
            raise GraphError("The pipeline has a cycle.")
        return out

    def validate(self) -> list[Issue]:
        """What is wrong before anything runs."""
        if not self.nodes:
            return [Issue(None, "warning", "The canvas is empty.")]
        issues: list[Issue] = []
        try:
            self.ordered()
        except GraphError as e:
            issues.append(Issue(None, "error", str(e)))
        for n in self.nodes:
            module = MODULES.get(n.module)
            if module is None:
                issues.append(Issue(n.id, "error", f"'{n.label}' is a module that no longer exists."))
                continue
            wired = {e.target_port for e in self.inbound(n.id)}
            issues += [Issue(n.id, "error", f"'{n.label}' has nothing connected to its {p.name} input.") for i, p in enumerate(module.inputs) if p.required and i not in wired]
            issues += [Issue(n.id, "error", f"'{n.label}' still needs a value for {p.name}.") for p in module.parameters if p.required and not p.default and not n.parameters.get(p.name, "").strip()]
            issues += self._mismatched(n, module)
        ends = [n for n in self.nodes if n.module in MODULES and MODULES[n.module].outputs and not self.outbound(n.id)]
        if len(self.nodes) > 1 and len(ends) == len(self.nodes):
            issues.append(Issue(None, "warning", "No modules are connected yet."))
        return issues

    def _mismatched(self, n: Node, module: Module) -> list[Issue]:
        if n.module not in ("train.model", "train.clustering"):
            return []
        edge = next((e for e in self.inbound(n.id) if e.target_port == 0), None)
        source = MODULES.get(self.node(edge.source).module) if edge else None
        if source is None or source.task is None:
            return []
        if n.module == "train.clustering" and source.task != "Clustering":
            return [Issue(n.id, "error", f"'{source.name}' is no clustering algorithm; use train.model.")]
        if n.module == "train.model" and source.task == "Clustering":
            return [Issue(n.id, "error", f"'{source.name}' takes no label; use train.clustering.")]
        return []
