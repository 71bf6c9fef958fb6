"""Descriptors of labelled-axis arrays: axes with coordinates, and what operators do to them."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_right
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class Coordinates:
    """``index``, ``linear`` (origin, step), ``lookup`` (values) or ``labels`` (values)."""

    kind: str = "index"
    origin: float = 0.0
    step: float = 1.0
    values: tuple = ()

    def cropped(self, start: int, length: int) -> Coordinates:
        if self.kind == "linear":
            return replace(self, origin=self.origin + start * self.step)
        return replace(self, values=self.values[start : start + length]) if self.values else self

    def resampled(self, source: int, target: int) -> Coordinates:
        """Centres of the target's pixels; an index axis becomes linear."""
        if self.kind not in ("index", "linear"):
            raise ValueError(f"{self.kind} coordinates can't be resampled")
        scale, origin, step = source / target, *((self.origin, self.step) if self.kind == "linear" else (0.0, 1.0))
        return Coordinates("linear", origin + (scale / 2 - 0.5) * step, step * scale)

    def physical(self, pixel: float) -> float:
        """Pixel position (centres at half integers) to a coordinate."""
        at = pixel - 0.5
        if self.kind == "linear":
            return self.origin + at * self.step
        if self.kind == "lookup":
            i = min(max(int(at // 1), 0), len(self.values) - 2)
            return self.values[i] + (at - i) * (self.values[i + 1] - self.values[i])
        return at

    def pixel(self, physical: float) -> float:
        if self.kind == "linear":
            return (physical - self.origin) / self.step + 0.5
        if self.kind == "lookup":
            v, sign = self.values, 1 if self.values[-1] > self.values[0] else -1
            if any((b - a) * sign <= 0 for a, b in zip(v, v[1:])):
                raise ValueError("lookup coordinates must be monotonic")
            i = min(max(bisect_right([sign * x for x in v], sign * physical) - 1, 0), len(v) - 2)
            return i + (physical - v[i]) / (v[i + 1] - v[i]) + 0.5
        return physical + 0.5


@dataclass(frozen=True)
class Axis:
    id: str
    length: int
    kind: str = "space"
    unit: str | None = None
    coordinates: Coordinates = field(default_factory=Coordinates)


@dataclass(frozen=True)
class Descriptor:
    axes: tuple[Axis, ...]
    sample_type: str = "float64"
    components: tuple[str, ...] = ("value",)
    nodata: float | None = None
    level: int = 0
    crs: str | None = None
    affine: tuple[float, ...] | None = None
    metadata: dict = field(default_factory=dict)

    def axis(self, name: str) -> Axis:
        return next(a for a in self.axes if a.id == name)

    def with_axis(self, axis: Axis) -> Descriptor:
        return replace(self, axes=tuple(axis if a.id == axis.id else a for a in self.axes))

    def cropped(self, x: int, y: int, width: int, height: int) -> Descriptor:
        out = self
        for name, start, length in (("x", x, width), ("y", y, height)):
            a = self.axis(name)
            if start < 0 or length < 1 or start + length > a.length:
                raise ValueError(f"{name} {start}..{start + length} is outside 0..{a.length}")
            out = out.with_axis(replace(a, length=length, coordinates=a.coordinates.cropped(start, length)))
        return out

    def sliced(self, display: tuple[str, str], fixed: dict[str, int]) -> Descriptor:
        """A plane of two axes; each other axis is fixed exactly once."""
        if set(fixed) | set(display) != {a.id for a in self.axes} or set(fixed) & set(display) or len(set(display)) != 2:
            raise ValueError("every axis but the two display axes must be fixed once")
        for name, at in fixed.items():
            if not 0 <= at < self.axis(name).length:
                raise ValueError(f"{name} {at} is outside the axis")
        return replace(self, axes=tuple(self.axis(n) for n in display))

    def resampled(self, width: int, height: int) -> Descriptor:
        out = self
        for name, length in (("x", width), ("y", height)):
            a = self.axis(name)
            out = out.with_axis(replace(a, length=length, coordinates=a.coordinates.resampled(a.length, length)))
        return out

    def canonical(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))

    def identity(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()
