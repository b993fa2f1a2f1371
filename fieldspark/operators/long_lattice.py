"""Spectral operators and derived fields on long lattices (X1-X7, D1-D9), a plane of the lattice at a time.

A 3-D transform is three regroupings of rows that hold a line as an array: planes of one z go
through a 2-D FFT, planes of one ky through the FFT along z, where the gains act, and back, then
planes of one z through the inverse.  All inputs, all operators and all filter widths share them.
A task holds one plane of the columns at a time, never the lattice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Gain:
    """What multiplies a column's spectrum: a derivative along an axis, a filter, or both.

    kind: none, gaussian or smooth_sharp; width in grid steps; alpha: the sharp filter's relative transition.
    """

    column: str
    axis: str | None = None
    kind: str = "none"
    width: float = 0.0
    alpha: float = 0.1171875

    def values(self, sizes: dict[str, int], lengths: dict[str, float], waves: dict[str, np.ndarray]) -> np.ndarray:
        """waves: how many of them are in the box along each axis; the highest wave of an even size has no derivative."""
        gain = np.ones(np.broadcast_shapes(*(k.shape for k in waves.values())), complex)
        if self.kind == "gaussian":
            for a, k in waves.items():
                gain *= np.exp(-0.5 * (self.width * 2 * math.pi / sizes[a] * k) ** 2)
        elif self.kind == "smooth_sharp":
            if len(set(sizes.values())) > 1 or len(set(lengths.values())) > 1:
                raise ValueError("the smooth sharp filter needs a cubic lattice")
            cut, step = math.pi / self.width, 2 * math.pi / sizes["x"]
            size = np.sqrt(sum(k**2 for k in waves.values())) * step
            gain *= 0.5 * _erfc((size - cut) / (math.sqrt(2) * self.alpha * cut))
            gain[np.broadcast_to(size == 0, gain.shape)] = 1.0
        elif self.kind != "none":
            raise ValueError(f"no filter is called {self.kind}")
        if self.axis:
            k = waves[self.axis]
            gain *= np.where(2 * np.abs(k) == sizes[self.axis], 0.0, 2j * math.pi / lengths[self.axis] * k)
        return gain


_erfc = np.vectorize(math.erfc, otypes=[float])


def _lines(rows: pd.DataFrame, by: str, n: int, column: str) -> np.ndarray:
    """Arrays of rows 0..n-1 of a group, in order of `by`; a missing or repeated row is an error."""
    at = rows[by].to_numpy()
    if len(at) != n or not np.array_equal(np.sort(at), np.arange(n)):
        raise ValueError("a plane of the lattice has missing or repeated points")
    return np.stack(rows[column].to_numpy()[np.argsort(at)])


def _by_axis(value) -> dict:
    return dict(value) if isinstance(value, dict) else dict.fromkeys(AXES, value)


def spectral_columns(points: DataFrame, n: int | dict[str, int], wanted: dict[str, Gain], length: float | dict[str, float] = 2 * math.pi, carry: list[str] | None = None) -> DataFrame:
    """x, y, z, a column for each wanted operator, and the carried ones, over a lattice given as points.

    n and length: of all axes, or by axis.  Every place must be there once; otherwise the task that meets
    the gap fails.  Three shuffles of rows with a line of numbers a column, however many operators there
    are; carried columns travel beside the spectra as the lines they are and are never transformed.
    """
    sizes, lengths, carry = _by_axis(n), _by_axis(length), carry or []
    nx, ny, nz = (sizes[a] for a in AXES)
    inputs = sorted({g.column for g in wanted.values()})
    kx, ky, kz = np.arange(nx // 2 + 1, dtype=float), np.fft.fftfreq(ny, 1 / ny), np.fft.fftfreq(nz, 1 / nz)
    for gain in wanted.values():  # a filter that does not suit the lattice fails here
        gain.values(sizes, lengths, {"x": kx[:1], "y": ky[:1], "z": kz[:1]})
    kept = "".join(f", keep_{c} array<double>" for c in carry)
    pairs = ", ".join(f"re_{c} array<double>, im_{c} array<double>" for c in inputs)

    def planes(rows: pd.DataFrame) -> pd.DataFrame:
        place = rows.y.to_numpy() * nx + rows.x.to_numpy()
        if len(place) != ny * nx or not np.array_equal(np.sort(place), np.arange(ny * nx)):
            raise ValueError("a plane of the lattice has missing or repeated points")
        order = np.argsort(place)
        out = {"z": np.full(ny, rows.z.iloc[0]), "ky": np.arange(ny)}
        for c in inputs:
            spectrum = np.fft.fft(np.fft.rfft(rows[c].to_numpy(float)[order].reshape(ny, nx), axis=1), axis=0)
            out[f"re_{c}"], out[f"im_{c}"] = list(spectrum.real), list(spectrum.imag)
        # Line y of a carried column goes with wave number y: there are as many of both.
        out |= {f"keep_{c}": list(rows[c].to_numpy(float)[order].reshape(ny, nx)) for c in carry}
        return pd.DataFrame(out)

    def gains(rows: pd.DataFrame) -> pd.DataFrame:
        at = int(rows.ky.iloc[0])
        out = {"z": np.arange(nz), "ky": np.full(nz, at)}
        spectra = {c: np.fft.fft(_lines(rows, "z", nz, f"re_{c}") + 1j * _lines(rows, "z", nz, f"im_{c}"), axis=0) for c in inputs}
        waves = {"x": kx[None, :], "y": ky[at:at + 1, None], "z": kz[:, None]}
        for name, gain in wanted.items():
            back = np.fft.ifft(spectra[gain.column] * gain.values(sizes, lengths, waves), axis=0)
            out[f"re_{name}"], out[f"im_{name}"] = list(back.real), list(back.imag)
        out |= {f"keep_{c}": list(_lines(rows, "z", nz, f"keep_{c}")) for c in carry}
        return pd.DataFrame(out)

    def inverse(rows: pd.DataFrame) -> pd.DataFrame:
        out = {"z": np.full(ny, rows.z.iloc[0]), "y": np.arange(ny)}
        for name in wanted:
            out[name] = list(np.fft.irfft(np.fft.ifft(_lines(rows, "ky", ny, f"re_{name}") + 1j * _lines(rows, "ky", ny, f"im_{name}"), axis=0), nx, axis=1))
        out |= {c: list(_lines(rows, "ky", ny, f"keep_{c}")) for c in carry}
        return pd.DataFrame(out)

    middle = ", ".join(f"re_{c} array<double>, im_{c} array<double>" for c in wanted)
    names = [*wanted, *carry]
    first = points.select(*AXES, *dict.fromkeys([*inputs, *carry])).groupBy("z").applyInPandas(planes, f"z int, ky int, {pairs}{kept}")
    second = first.groupBy("ky").applyInPandas(gains, f"z int, ky int, {middle}{kept}")
    third = second.groupBy("z").applyInPandas(inverse, f"z int, y int, {', '.join(f'{c} array<double>' for c in names)}")

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            z, y = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int32), nx) for c in ("z", "y"))
            x = np.tile(np.arange(nx, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(z), *(batch.column(c).flatten() for c in names)], [*AXES, *names])

    return third.mapInArrow(spread, f"x int, y int, z int, {', '.join(f'{c} double' for c in names)}")


def derived_fields(velocity: DataFrame, n: int | dict[str, int], sigmas: list[float], length: float | dict[str, float] = 2 * math.pi, filter_kind: str = "gaussian", alpha: float = 0.1171875) -> DataFrame:
    """x, y, z, ux, uy, uz as points -> sigma, x, y, z, work_full, work_resolved, pi, s_bar, divergence and strain for each filter width.

    All widths share the velocity's spectra, and those of the products and accelerations: three passes
    of spectral_columns in all, whatever the number of widths.
    """
    base = Gain("", None, filter_kind, 1.0, alpha)
    tag = {s: f"s{k}" for k, s in enumerate(sigmas)}
    pairs, upper = [(i, j) for i in AXES for j in AXES], ["".join(p) for p in combinations_with_replacement(AXES, 2)]
    total = lambda xs: sum(xs[1:], xs[0])
    c = F.col
    # Gradients, and per width the filtered velocity and its gradients.
    first = {f"g{i}{j}": Gain(f"u{i}", j) for i, j in pairs}
    for s, t in tag.items():
        first |= {f"{t}_b{i}": replace(base, column=f"u{i}", width=s) for i in AXES} | {f"{t}_h{i}{j}": replace(base, column=f"u{i}", axis=j, width=s) for i, j in pairs}
    d = spectral_columns(velocity, n, first, length, [f"u{i}" for i in AXES])
    kept = [f"{t}_{x}" for t in tag.values() for x in [*(f"b{i}" for i in AXES), *(f"h{i}{j}" for i, j in pairs)]]
    d = d.select(*AXES, *kept, *[total([c(f"u{j}") * c(f"g{i}{j}") for j in AXES]).alias(f"a{i}") for i in AXES], *[(c(f"u{p[0]}") * c(f"u{p[1]}")).alias(f"p{p}") for p in upper],
                 total([c(f"g{i}{i}") for i in AXES]).alias("divergence"), total([F.pow((c(f"g{i}{j}") + c(f"g{j}{i}")) / 2, F.lit(2.0)) for i, j in pairs]).alias("strain"))
    # Filtered accelerations and products, beside what is kept.
    second: dict[str, Gain] = {}
    for s, t in tag.items():
        second |= {f"{t}_a{i}": replace(base, column=f"a{i}", width=s) for i in AXES} | {f"{t}_q{p}": replace(base, column=f"p{p}", width=s) for p in upper}
    d = spectral_columns(d, n, second, length, [*kept, "divergence", "strain"])
    third, fields, done = {}, [], ["divergence", "strain"]
    for t in tag.values():
        b = {i: c(f"{t}_b{i}") for i in AXES}
        tau = {p: c(f"{t}_q{p}") - b[p[0]] * b[p[1]] for p in upper}
        at = lambda i, j, tau=tau: tau["".join(sorted(i + j))]
        fields += [total([b[i] * c(f"{t}_a{i}") for i in AXES]).alias(f"{t}_work_full"), total([b[i] * b[j] * c(f"{t}_h{i}{j}") for i, j in pairs]).alias(f"{t}_work_resolved"), total([at(i, j) * c(f"{t}_h{i}{j}") for i, j in pairs]).alias(f"{t}_pi"),
                   *[total([b[i] * at(i, j) for i in AXES]).alias(f"{t}_f{j}") for j in AXES]]
        done += [f"{t}_{x}" for x in ("work_full", "work_resolved", "pi")]
        third |= {f"{t}_d{j}": Gain(f"{t}_f{j}", j) for j in AXES}
    d = spectral_columns(d.select(*AXES, "divergence", "strain", *fields), n, third, length, done)
    rows = F.array(*[F.struct(F.lit(float(s)).alias("sigma"), *[c(f"{t}_{x}").alias(x) for x in ("work_full", "work_resolved", "pi")], total([c(f"{t}_d{j}") for j in AXES]).alias("s_bar")) for s, t in tag.items()])
    return d.select(*AXES, "divergence", "strain", F.explode(rows).alias("r")).select("r.sigma", *AXES, *[f"r.{x}" for x in ("work_full", "work_resolved", "pi", "s_bar")], "divergence", "strain")


def pressure_gradient(points: DataFrame, n: int | dict[str, int], length: float | dict[str, float] = 2 * math.pi) -> DataFrame:
    """The spectral gradient of v along all three axes at once: x, y, z, gx, gy, gz."""
    return spectral_columns(points, n, {f"g{a}": Gain("v", a) for a in AXES}, length)
