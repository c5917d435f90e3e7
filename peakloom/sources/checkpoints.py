"""Weights from zip archives of pickled tensors, as training runs elsewhere save them.

The archive holds one pickle and a file of numbers a tensor. The pickle is read with an unpickler that knows tensors and ordered
dictionaries and nothing else, so that loading can't run code. Several places of the state are tried, as it stands and
without a leading name, and the first one whose names are exactly the encoder's is taken; shapes are checked.
"""

from __future__ import annotations

import io
import pickle
import zipfile
from collections import OrderedDict

import numpy as np
from pyspark.sql import SparkSession

from ..operators.layers import Weights

MOST_BYTES = 1 << 30  # an archive is read whole in the driver, so a larger one is an error

# Fixed values of the format: storage classes and their numbers, and the encoders' layer names.
STORAGES = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "LongStorage": "<i8", "IntStorage": "<i4", "ShortStorage": "<i2", "CharStorage": "<i1", "ByteStorage": "<u1", "BoolStorage": "?", "BFloat16Storage": "bfloat16"}
SPECTRUM_LAYERS = {"peak1": "peak_encoder.0", "peak_norm": "peak_encoder.1", "peak2": "peak_encoder.3", "attention1": "attention.0", "attention2": "attention.2", "precursor1": "precursor_encoder.0", "precursor2": "precursor_encoder.2", "out1": "projection.0", "out_norm": "projection.1", "out2": "projection.4"}
MOLECULE_LAYERS = {"mol1": "network.0", "mol_norm1": "network.1", "mol2": "network.4", "mol_norm2": "network.5", "mol3": "network.8"}


def _tensor(storage: np.ndarray, offset: int, size: tuple, stride: tuple, *_) -> np.ndarray:
    """A view of a storage; every place must lie in it."""
    size, stride = tuple(map(int, size)), tuple(map(int, stride))
    last = offset + sum((n - 1) * s for n, s in zip(size, stride, strict=True)) if all(size) else offset
    if offset < 0 or min(stride, default=0) < 0 or min(size, default=0) < 0 or all(size) and last >= len(storage):
        raise pickle.UnpicklingError("a tensor reaches beyond its storage")
    return np.lib.stride_tricks.as_strided(storage[offset:], size, [s * storage.itemsize for s in stride]).copy()


class _Reader(pickle.Unpickler):
    def __init__(self, archive: zipfile.ZipFile, root: str):
        super().__init__(io.BytesIO(archive.read(f"{root}data.pkl")))
        self.archive, self.root = archive, root

    def find_class(self, module: str, name: str):
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        if module == "torch" and name in STORAGES:
            return STORAGES[name]
        if (module, name) in (("torch._utils", "_rebuild_tensor_v2"), ("torch._utils", "_rebuild_tensor")):
            return _tensor
        if (module, name) == ("torch._utils", "_rebuild_parameter"):
            return lambda data, *_: data
        raise pickle.UnpicklingError(f"{module}.{name} is no part of a state of tensors")

    def persistent_load(self, pid):
        kind, numbers, key, _, count = pid
        if kind != "storage" or numbers not in STORAGES.values():
            raise pickle.UnpicklingError("an unknown storage")
        data = self.archive.read(f"{self.root}data/{key}")
        if numbers == "bfloat16":
            array = (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
        else:
            array = np.frombuffer(data, numbers)
        if len(array) < count:
            raise pickle.UnpicklingError("a storage is shorter than it says")
        return array


def read_archive(data: bytes):
    """The pickled object, its tensors as arrays."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        roots = [n.removesuffix("data.pkl") for n in archive.namelist() if n == "data.pkl" or n.endswith("/data.pkl")]
        if len(roots) != 1:
            raise ValueError("the archive must hold one data.pkl")
        return _Reader(archive, roots[0]).load()


def is_state(x) -> bool:
    return isinstance(x, dict) and bool(x) and all(isinstance(k, str) and isinstance(v, np.ndarray) for k, v in x.items())


def states_of(saved, preferred: tuple[str, ...] = ()) -> list[tuple[str, dict[str, np.ndarray]]]:
    """(where, state) of everything that is a state: the preferred keys first, then other keys, then the whole."""
    if not isinstance(saved, dict):
        return []
    keys = [k for k in preferred if k in saved] + [k for k in saved if k not in preferred]
    return [(str(k), saved[k]) for k in keys if is_state(saved[k])] + ([("whole", saved)] if is_state(saved) else [])


def as_weights(state: dict[str, np.ndarray], layers: dict[str, str]) -> Weights:
    """The encoder's weights (inputs x outputs), if the state has exactly its names, else an error that names the first that differ."""
    wanted = {f"{there}.{part}" for there in layers.values() for part in ("weight", "bias")}
    missing, unexpected = sorted(wanted - set(state)), sorted(set(state) - wanted)
    if missing or unexpected:
        raise ValueError(f"missing {missing[:5]}, unexpected {unexpected[:5]}")
    out: Weights = {}
    for own, there in layers.items():
        w, b = (state[f"{there}.{part}"].astype(float) for part in ("weight", "bias"))
        if w.ndim == 2:
            out[own] = {"w": w.T, "b": b}
        else:
            out[own] = {"scale": w, "shift": b}
        if b.shape != w.shape[:1]:
            raise ValueError(f"{there}: weight {w.shape} and bias {b.shape} don't fit")
    return out


def check_shapes(w: Weights) -> Weights:
    """Each layer's inputs must be what the one before gives."""

    def width(name: str) -> int:
        return len(w[name]["b"] if "b" in w[name] else w[name]["shift"])

    def fits(name: str, inputs: int) -> None:
        have = w[name]["w"].shape[0] if "w" in w[name] else width(name)
        if have != inputs:
            raise ValueError(f"{name} takes {have} numbers, {inputs} reach it")

    if "peak1" in w:
        chain = [("peak1", 2), ("peak_norm", width("peak1")), ("peak2", width("peak1")), ("attention1", width("peak2")), ("attention2", width("attention1")), ("precursor1", 1), ("precursor2", width("precursor1"))]
        chain += [("out1", 2 * width("peak2") + width("precursor2")), ("out_norm", width("out1")), ("out2", width("out1"))]
        if width("attention2") != 1:
            raise ValueError("attention gives one number a peak")
    else:
        chain = [("mol_norm1", width("mol1")), ("mol2", width("mol1")), ("mol_norm2", width("mol2")), ("mol3", width("mol2"))]
    for name, inputs in chain:
        fits(name, inputs)
    return w


def load_encoder(spark: SparkSession, path: str, layers: dict[str, str], preferred: tuple[str, ...] = ("model_state_dict", "state_dict"), prefixes: tuple[str, ...] = ("module.",)) -> Weights:
    """Weights of the first state in the archive that fits, as it stands or without one of the prefixes; read through Spark, so from any store."""
    rows = spark.read.format("binaryFile").load(path).where(f"length <= {MOST_BYTES}").select("content").take(1)
    if not rows:
        raise ValueError(f"{path}: no archive of at most {MOST_BYTES} bytes")
    tried = []
    for where, state in states_of(read_archive(bytes(rows[0].content)), preferred):
        for prefix in ("", *prefixes):
            if prefix and not all(k.startswith(prefix) for k in state):
                state_here = {k.removeprefix(prefix): v for k, v in state.items() if k.startswith(prefix)}
            else:
                state_here = {k.removeprefix(prefix): v for k, v in state.items()}
            try:
                return check_shapes(as_weights(state_here, layers))
            except ValueError as e:
                tried.append(f"{where}{f' without {prefix}' if prefix else ''}: {e}")
    raise ValueError(f"{path}: no state fits the encoder; {'; '.join(tried) or 'none found'}")
