"""Typed JSON operation graphs: registry, validation, canonical hash, dry run, and one Spark plan per output."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quadrille.operators import components, project, reduce, stencil

ID = re.compile(r"^[a-z][a-z0-9-]*(\.[a-z][a-z0-9-]*)+$")


@dataclass(frozen=True)
class Operation:
    """``build(inputs, parameters)`` gives a DataFrame. ``execution``: metadata-only, tile-local, neighborhood, reduction, dataset-transform or global-transform."""

    id: str
    build: Callable[[dict[str, DataFrame], dict], DataFrame]
    inputs: tuple[str, ...] = ("dataset",)
    parameters: dict = field(default_factory=dict)  # name: (type, default); ... is required
    output: str = "dataset"
    execution: str = "tile-local"
    version: int = 1

    def normalised(self, given: dict) -> dict:
        unknown = set(given) - set(self.parameters)
        if unknown:
            raise ValueError(f"{self.id}: unknown parameters {sorted(unknown)}")
        out = {}
        for name, (kind, default) in self.parameters.items():
            value = given.get(name, default)
            if value is ...:
                raise ValueError(f"{self.id}: {name} is missing")
            if value is not None and not isinstance(value, (int, float) if kind is float else kind) or (kind is not bool and isinstance(value, bool)):
                raise ValueError(f"{self.id}: {name} is no {kind.__name__}")
            out[name] = value
        return out


class Registry:
    """Operations by id and version; a second one of both is an error."""

    def __init__(self) -> None:
        self._held: dict[tuple[str, int], Operation] = {}

    def add(self, operation: Operation) -> None:
        if not ID.match(operation.id):
            raise ValueError(f"{operation.id!r} has no namespace")
        if (key := (operation.id, operation.version)) in self._held:
            raise ValueError(f"{operation.id}@{operation.version} is registered already")
        self._held[key] = operation

    def get(self, name: str, version: int = 1) -> Operation:
        if (name, version) not in self._held:
            raise ValueError(f"unknown operation {name}@{version}")
        return self._held[name, version]

    def ids(self) -> list[str]:
        return sorted(f"{i}@{v}" for i, v in self._held)


def built_in() -> Registry:
    r, need = Registry(), ...
    d = lambda i: i["dataset"]
    r.add(Operation("analysis.select-resolution-level", lambda i, p: project.select_level(d(i), p["level"]), parameters={"level": (int, need)}, execution="metadata-only"))
    r.add(Operation("analysis.crop", lambda i, p: project.crop(d(i), **p), parameters={k: (int, need) for k in ("x", "y", "width", "height")}))
    r.add(Operation("analysis.slice", lambda i, p: project.slice_plane(d(i), tuple(p["display"]), p["fixed"]), parameters={"display": (list, need), "fixed": (dict, need)}))
    r.add(Operation("analysis.resample", lambda i, p: stencil.resample(d(i), (p["sourceWidth"], p["sourceHeight"]), (p["width"], p["height"]), p["method"], p["invalid"]), parameters={**{k: (int, need) for k in ("sourceWidth", "sourceHeight", "width", "height")}, "method": (str, "nearest"), "invalid": (str, "propagate")}, execution="neighborhood"))
    r.add(Operation("analysis.projection", lambda i, p: reduce.project(d(i), p["keep"], p["reduction"], p["invalid"]), parameters={"keep": (list, need), "reduction": (str, need), "invalid": (str, "ignore")}, execution="reduction"))
    r.add(Operation("analysis.threshold", lambda i, p: project.threshold(d(i), p["mode"], p["low"], p["high"], p["invalidOutput"]), parameters={"mode": (str, need), "low": (float, need), "high": (float, None), "invalidOutput": (int, 0)}))
    r.add(Operation("analysis.gaussian-blur", lambda i, p: stencil.gaussian_blur(d(i), p["sigma"], p["width"], p["height"], p["boundary"], p["invalid"], p["constant"]), parameters={"sigma": (float, need), "width": (int, need), "height": (int, need), "boundary": (str, "clamp"), "invalid": (str, "propagate"), "constant": (float, 0.0)}, execution="neighborhood"))
    r.add(Operation("analysis.statistics", lambda i, p: reduce.statistics(d(i)), output="scalars", execution="reduction"))
    r.add(Operation("analysis.histogram", lambda i, p: reduce.histogram(d(i), p["bins"], p["low"], p["high"]), parameters={"bins": (int, need), "low": (float, None), "high": (float, None)}, output="histogram", execution="reduction"))
    r.add(Operation("analysis.line-profile", _profile, parameters={"points": (list, need), "spacing": (float, 1.0), "method": (str, "nearest")}, output="profile", execution="reduction"))
    r.add(Operation("analysis.connected-components", lambda i, p: components.label(d(i), p["width"], p["connectivity"]).withColumnRenamed("label", "v"), parameters={"width": (int, need), "connectivity": (int, 8)}, execution="global-transform"))
    return r


def _profile(inputs: dict[str, DataFrame], p: dict) -> DataFrame:
    from quadrille.operators import roi

    return roi.profile(inputs["dataset"], roi.line_samples([tuple(x) for x in p["points"]], p["spacing"]), p["method"])


class Graph:
    """``{schemaVersion, inputs: [{name}], nodes: [{id, operation: {id, version}, inputs: [{port, source}], parameters}], outputs: [{name, source}]}``.

    A source is ``input:name`` or ``node:id``.
    """

    def __init__(self, document: dict, registry: Registry | None = None):
        self.registry = registry or built_in()
        if document.get("schemaVersion") != 1:
            raise ValueError("schemaVersion must be 1")
        self.inputs = [i["name"] for i in document.get("inputs", [])]
        self.nodes = {n["id"]: n for n in document.get("nodes", [])}
        self.outputs = {o["name"]: o["source"] for o in document.get("outputs", [])}
        if len(self.nodes) != len(document.get("nodes", [])) or len(set(self.inputs)) != len(self.inputs):
            raise ValueError("names must be unique")
        self.operations, self.parameters = {}, {}
        for name, n in self.nodes.items():
            op = self.registry.get(n["operation"]["id"], n["operation"].get("version", 1))
            if {i["port"] for i in n["inputs"]} != set(op.inputs):
                raise ValueError(f"{name}: inputs must be {op.inputs}")
            self.operations[name], self.parameters[name] = op, op.normalised(n.get("parameters", {}))
        self.order = self._ordered()

    def _ordered(self) -> list[str]:
        done: list[str] = []
        state: dict[str, int] = {}

        def visit(source: str) -> None:
            kind, _, name = source.partition(":")
            if kind == "input" and name in self.inputs:
                return
            if kind != "node" or name not in self.nodes:
                raise ValueError(f"unknown source {source!r}")
            if state.get(name) == 1:
                raise ValueError(f"{name} depends on itself")
            if state.get(name) != 2:
                state[name] = 1
                for i in self.nodes[name]["inputs"]:
                    visit(i["source"])
                state[name] = 2
                done.append(name)

        for name in self.nodes:
            visit(f"node:{name}")
        for source in self.outputs.values():
            visit(source)
        return done

    def canonical(self) -> str:
        """Without labels, nodes by content: neither names nor the order of nodes matter."""
        digest: dict[str, str] = {f"input:{i}": f"input:{i}" for i in self.inputs}
        for name in self.order:
            op = self.operations[name]
            body = {"operation": f"{op.id}@{op.version}", "inputs": sorted((i["port"], digest[i["source"]]) for i in self.nodes[name]["inputs"]), "parameters": self.parameters[name]}
            digest[f"node:{name}"] = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        return json.dumps({"inputs": sorted(self.inputs), "outputs": sorted((n, digest[s]) for n, s in self.outputs.items())}, separators=(",", ":"))

    def hash(self) -> str:
        return hashlib.sha256(b"operation-graph-1\0" + self.canonical().encode()).hexdigest()

    def build(self, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Lazy outputs; nothing runs before an action on one of them. What no output needs is not built."""
        if missing := set(self.inputs) - set(inputs):
            raise ValueError(f"missing inputs {sorted(missing)}")
        made = {f"input:{k}": v for k, v in inputs.items()}
        for name in self.order:
            made[f"node:{name}"] = self.operations[name].build({i["port"]: made[i["source"]] for i in self.nodes[name]["inputs"]}, self.parameters[name])
        return {n: made[s] for n, s in self.outputs.items()}

    def dry_run(self, inputs: dict[str, DataFrame]) -> dict[str, str]:
        """Output schemas, by Spark's analysis alone."""
        return {n: df.schema.simpleString() for n, df in self.build(inputs).items()}

    def provenance(self) -> dict:
        return {"graph": self.hash(), "operations": [f"{self.operations[n].id}@{self.operations[n].version}" for n in self.order]}
