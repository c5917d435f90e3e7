"""Layers of the encoders with their derivatives, in numpy: forward gives a value and what backward needs."""

from __future__ import annotations

import math

import numpy as np

EPSILON = 1e-5
Weights = dict[str, dict[str, np.ndarray]]


NEAR, TERMS = 64, 9  # points a unit, and coefficients at each


def _erf_series() -> np.ndarray:
    """Row k: the Taylor coefficients of the error function at each point i / NEAR from 0 to 6, of degree k."""
    at = np.arange(6 * NEAR + 1) / NEAR
    out = np.empty((TERMS, len(at)))
    out[0] = [math.erf(x) for x in at]
    out[1] = 2 / math.sqrt(math.pi) * np.exp(-at * at)
    for k in range(1, TERMS - 1):  # from f'' = -2 x f'
        out[k + 1] = -2 * (k * at * out[k] + (k - 1) * out[k - 1]) / ((k + 1) * k) if k > 1 else -at * out[1]
    return out


_ERF = _erf_series()


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, to double precision, by its series at the nearest of some hundred points; 1 beyond 6, NaN of NaN."""
    z = np.minimum(np.abs(x), 6.0)
    i = np.nan_to_num(z * NEAR + 0.5).astype(np.int32)
    h = z - i / NEAR
    total = _ERF[-1].take(i)
    for row in _ERF[-2::-1]:
        total *= h
        total += row.take(i)
    return np.copysign(total, x)


def below(x: np.ndarray) -> np.ndarray:
    """The normal distribution's share up to x."""
    return 0.5 * (1 + erf(x * 0.7071067811865476))


def gelu(x: np.ndarray, share: np.ndarray | None = None) -> np.ndarray:
    return x * (below(x) if share is None else share)


def gelu_slope(x: np.ndarray, share: np.ndarray | None = None) -> np.ndarray:
    return (below(x) if share is None else share) + x * np.exp(-0.5 * x * x) * 0.3989422804014327


def _gelu(k: dict, name: str) -> np.ndarray:
    """GELU of k[name], with what its slope needs kept beside it."""
    k[f"{name}_share"] = below(k[name])
    return gelu(k[name], k[f"{name}_share"])


def dense(x: np.ndarray, layer: dict[str, np.ndarray]) -> np.ndarray:
    return x @ layer["w"] + layer["b"]


def layer_norm(x: np.ndarray, layer: dict[str, np.ndarray] | None) -> tuple[np.ndarray, tuple]:
    spread = np.sqrt(x.var(axis=-1, keepdims=True) + EPSILON)
    unit = (x - x.mean(axis=-1, keepdims=True)) / spread
    scale, shift = (layer["scale"], layer["shift"]) if layer else (1.0, 0.0)
    return unit * scale + shift, (unit, spread)


class Gradients:
    """Sums of derivatives by layer and name."""

    def __init__(self):
        self.by_layer: Weights = {}

    def add(self, layer: str, **values: np.ndarray) -> None:
        own = self.by_layer.setdefault(layer, {})
        for name, x in values.items():
            own[name] = own[name] + x if name in own else x

    def dense(self, name: str, layer: dict[str, np.ndarray], x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """Adds those of a dense layer; gives the slope of its input."""
        flat, s = x.reshape(-1, x.shape[-1]), slope.reshape(-1, slope.shape[-1])
        self.add(name, w=flat.T @ s, b=s.sum(axis=0))
        return slope @ layer["w"].T

    def layer_norm(self, name: str, layer: dict[str, np.ndarray], kept: tuple, slope: np.ndarray) -> np.ndarray:
        unit, spread = kept
        axes = tuple(range(slope.ndim - 1))
        self.add(name, scale=(slope * unit).sum(axis=axes), shift=slope.sum(axis=axes))
        s = slope * layer["scale"]
        return (s - s.mean(axis=-1, keepdims=True) - unit * (s * unit).mean(axis=-1, keepdims=True)) / spread


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    return x / size, size


def unit_slope(unit: np.ndarray, size: np.ndarray, slope: np.ndarray) -> np.ndarray:
    return (slope - unit * (unit * slope).sum(axis=-1, keepdims=True)) / size


def spectrum_forward(mz: np.ndarray, intensity: np.ndarray, mask: np.ndarray, precursor: np.ndarray, w: Weights) -> tuple[np.ndarray, dict]:
    """Padded peaks (spectra x peaks, with their mask) to unit vectors.

    Peaks: two dense layers, layer norm after the first; attention: two dense layers to a weight a peak; the weighted sum and the
    largest of the peaks beside two dense layers of the precursor; two dense layers with layer norm to the vector. Zeros for a
    spectrum without peaks; what padding holds has no influence.
    """
    k: dict = {"mask": mask, "some": mask.any(axis=1)}
    k["x"] = np.stack([mz / 1000, intensity], axis=-1)
    k["normed"], k["norm"] = layer_norm(dense(k["x"], w["peak1"]), w["peak_norm"])
    k["g1"] = _gelu(k, "normed")
    k["a2"] = dense(k["g1"], w["peak2"])
    k["h"] = _gelu(k, "a2")
    k["t1"] = dense(k["h"], w["attention1"])
    k["u1"] = _gelu(k, "t1")
    s = np.where(mask, dense(k["u1"], w["attention2"])[..., 0], -np.inf)
    e = np.exp(s - np.where(k["some"], s.max(axis=1, initial=-np.inf), 0.0)[:, None])
    k["alpha"] = e / np.maximum(e.sum(axis=1), 1e-300)[:, None]
    held = np.where(mask[..., None], k["h"], 0.0)
    k["best"] = np.where(mask[..., None], k["h"], -np.inf).argmax(axis=1)
    top = np.where(k["some"][:, None], np.take_along_axis(held, k["best"][:, None, :], axis=1)[:, 0, :], 0.0)
    k["p"] = precursor[:, None] / 1000
    k["p1"] = dense(k["p"], w["precursor1"])
    k["q1"] = _gelu(k, "p1")
    k["p2"] = dense(k["q1"], w["precursor2"])
    k["z"] = np.concatenate([(held * k["alpha"][..., None]).sum(axis=1), top, _gelu(k, "p2")], axis=1)
    k["out_normed"], k["out_norm"] = layer_norm(dense(k["z"], w["out1"]), w["out_norm"])
    k["og"] = _gelu(k, "out_normed")
    unit, k["size"] = unit_rows(dense(k["og"], w["out2"]))
    k["unit"] = np.where(k["some"][:, None], unit, 0.0)
    return k["unit"], k


def spectrum_backward(slope: np.ndarray, k: dict, w: Weights) -> Weights:
    g = Gradients()
    slope = unit_slope(k["unit"], k["size"], np.where(k["some"][:, None], slope, 0.0))
    slope = g.dense("out2", w["out2"], k["og"], slope) * gelu_slope(k["out_normed"], k["out_normed_share"])
    slope = g.dense("out1", w["out1"], k["z"], g.layer_norm("out_norm", w["out_norm"], k["out_norm"], slope))
    width = k["h"].shape[-1]
    attended, top, pre = slope[:, :width], slope[:, width : 2 * width], slope[:, 2 * width :]
    pre = g.dense("precursor2", w["precursor2"], k["q1"], pre * gelu_slope(k["p2"], k["p2_share"])) * gelu_slope(k["p1"], k["p1_share"])
    g.dense("precursor1", w["precursor1"], k["p"], pre)
    alpha = k["alpha"]
    h = np.where(k["mask"][..., None], k["h"], 0.0)
    to_h = alpha[..., None] * attended[:, None, :]
    rows, columns = np.nonzero(np.broadcast_to(k["some"][:, None], top.shape))
    np.add.at(to_h, (rows, k["best"][rows, columns], columns), top[rows, columns])
    by_peak = (h * attended[:, None, :]).sum(axis=-1)
    s = alpha * (by_peak - (alpha * by_peak).sum(axis=1, keepdims=True))
    s = g.dense("attention2", w["attention2"], k["u1"], s[..., None]) * gelu_slope(k["t1"], k["t1_share"])
    to_h = to_h + g.dense("attention1", w["attention1"], k["h"], s)
    s = g.dense("peak2", w["peak2"], k["g1"], to_h * gelu_slope(k["a2"], k["a2_share"])) * gelu_slope(k["normed"], k["normed_share"])
    g.dense("peak1", w["peak1"], k["x"], g.layer_norm("peak_norm", w["peak_norm"], k["norm"], s))
    return g.by_layer


def molecule_forward(prints: np.ndarray, w: Weights) -> tuple[np.ndarray, dict]:
    """Fingerprints to unit vectors: two dense layers with layer norm and GELU, and a last one."""
    k: dict = {"x": prints.astype(float)}
    k["normed1"], k["norm1"] = layer_norm(dense(k["x"], w["mol1"]), w["mol_norm1"])
    k["g1"] = _gelu(k, "normed1")
    k["normed2"], k["norm2"] = layer_norm(dense(k["g1"], w["mol2"]), w["mol_norm2"])
    k["g2"] = _gelu(k, "normed2")
    k["unit"], k["size"] = unit_rows(dense(k["g2"], w["mol3"]))
    return k["unit"], k


def molecule_backward(slope: np.ndarray, k: dict, w: Weights) -> Weights:
    g = Gradients()
    s = g.dense("mol3", w["mol3"], k["g2"], unit_slope(k["unit"], k["size"], slope)) * gelu_slope(k["normed2"], k["normed2_share"])
    s = g.dense("mol2", w["mol2"], k["g1"], g.layer_norm("mol_norm2", w["mol_norm2"], k["norm2"], s)) * gelu_slope(k["normed1"], k["normed1_share"])
    g.dense("mol1", w["mol1"], k["x"], g.layer_norm("mol_norm1", w["mol_norm1"], k["norm1"], s))
    return g.by_layer


def contrast(spectra: np.ndarray, molecules: np.ndarray, positive: np.ndarray, temperature: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean of both directions of -log(share of the softmax that positives get), with its slopes; rows without a positive are left out."""
    logits = spectra @ molecules.T / temperature
    loss, slope = 0.0, np.zeros_like(logits)
    for turned in (False, True):
        x, p = (logits.T, positive.T) if turned else (logits, positive)
        use = p.any(axis=1)
        n = int(use.sum())
        if not n:
            continue
        e = np.exp(x - x.max(axis=1, keepdims=True))
        share = e / e.sum(axis=1, keepdims=True)
        own = np.where(p, e, 0.0)
        total = own.sum(axis=1, keepdims=True)
        loss += 0.5 * float(np.mean((np.log(e.sum(axis=1)) - np.log(np.where(use, total[:, 0], 1.0)))[use]))
        d = np.where(use[:, None], share - own / np.where(total > 0, total, 1.0), 0.0) * (0.5 / n)
        slope += d.T if turned else d
    slope /= temperature
    return loss, slope @ molecules, slope.T @ spectra
