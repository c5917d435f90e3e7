"""Archives of tensors made here byte by byte, and what must not be loaded from them."""

import io
import pickle
import struct
import sys
import types
import zipfile
from collections import OrderedDict

import numpy as np
import pytest

from peakloom.sources import checkpoints


class Stored:
    """A tensor to be saved: its storage, and how it lies in it."""

    def __init__(self, array, transposed=False):
        self.array, self.transposed = np.asarray(array), transposed

    def __reduce__(self):
        a = self.array.T if self.transposed else self.array
        stride = tuple(s // self.array.itemsize for s in a.strides)
        return sys.modules["torch._utils"]._rebuild_tensor_v2, (Storage(self.array), 0, a.shape, stride, False, OrderedDict())


class Storage:
    def __init__(self, array):
        self.array = array


def archive(saved, root="model/"):
    """A zip as the other framework writes it; its modules are stood in for while pickling, so that names are written as theirs."""
    files = []

    class Pickler(pickle.Pickler):
        def persistent_id(self, x):
            if isinstance(x, Storage):
                files.append(np.ascontiguousarray(x.array))
                return "storage", sys.modules["torch"].FloatStorage if x.array.dtype == np.float32 else sys.modules["torch"].DoubleStorage, str(len(files) - 1), "cpu", x.array.size
            return None

    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    torch.FloatStorage, torch.DoubleStorage = (type(n, (), {"__module__": "torch"}) for n in ("FloatStorage", "DoubleStorage"))
    utils._rebuild_tensor_v2 = types.FunctionType((lambda *a: None).__code__, {}, "_rebuild_tensor_v2")
    utils._rebuild_tensor_v2.__module__, utils._rebuild_tensor_v2.__qualname__ = "torch._utils", "_rebuild_tensor_v2"
    sys.modules.update({"torch": torch, "torch._utils": utils})
    try:
        body = io.BytesIO()
        Pickler(body, 2).dump(saved)
    finally:
        del sys.modules["torch"], sys.modules["torch._utils"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(f"{root}data.pkl", body.getvalue())
        for i, a in enumerate(files):
            z.writestr(f"{root}data/{i}", a.tobytes())
    return out.getvalue()


RNG = np.random.default_rng(11)
SHAPES = {"mol1": (6, 5), "mol_norm1": (6,), "mol2": (4, 6), "mol_norm2": (4,), "mol3": (3, 4)}  # outputs x inputs


def state(prefix="", dtype=np.float32):
    out = OrderedDict()
    for own, there in checkpoints.MOLECULE_LAYERS.items():
        out[f"{prefix}{there}.weight"] = Stored(RNG.normal(size=SHAPES[own]).astype(dtype))
        out[f"{prefix}{there}.bias"] = Stored(RNG.normal(size=SHAPES[own][:1]).astype(dtype))
    return out


@pytest.mark.parametrize("wrap, prefix", [(lambda s: s, ""), (lambda s: {"epoch": 3, "model_state_dict": s, "optimizer": {"lr": 0.1}}, ""), (lambda s: {"state_dict": s}, "module."), (lambda s: {"other": s}, "molecule_encoder.")])
def test_states_are_found(spark, tmp_path, wrap, prefix):
    made = state(prefix)
    (tmp_path / "m.pt").write_bytes(archive(wrap(made)))
    got = checkpoints.load_encoder(spark, str(tmp_path / "m.pt"), checkpoints.MOLECULE_LAYERS, prefixes=("module.", "molecule_encoder."))
    for own, there in checkpoints.MOLECULE_LAYERS.items():
        w, b = (made[f"{prefix}{there}.{x}"].array for x in ("weight", "bias"))
        assert np.allclose(got[own]["w"], w.T) if w.ndim == 2 else np.allclose(got[own]["scale"], w)
        assert np.allclose(got[own].get("b", got[own].get("shift")), b)
    from peakloom.operators.encoders import molecule_vector

    assert np.linalg.norm(molecule_vector(np.ones(5), got)) == pytest.approx(1)


def test_strides_and_numbers():
    a = np.arange(6.0).reshape(2, 3)
    got = checkpoints.read_archive(archive({"t": Stored(a, transposed=True), "f": Stored(a.astype(np.float32))}, root=""))
    assert np.array_equal(got["t"], a.T) and got["f"].dtype == np.float32
    with pytest.raises(pickle.UnpicklingError, match="beyond"):
        checkpoints._tensor(np.zeros(5), 2, (2, 2), (2, 1))
    half = np.frombuffer(struct.pack("<f", 1.5), "<u2")[1:]
    assert (half.astype(np.uint32) << 16).view(np.float32)[0] == 1.5


def test_states_that_do_not_fit(spark, tmp_path):
    odd = state()
    odd.pop("network.8.bias")
    wrong = state()
    wrong["network.4.weight"] = Stored(np.zeros((4, 7), np.float32))
    for saved, said in ((odd, "missing"), (wrong, "mol2 takes 7"), ({"epoch": 1}, "none found"), ([1, 2], "none found")):
        (tmp_path / "m.pt").write_bytes(archive(saved))
        with pytest.raises(ValueError, match=said):
            checkpoints.load_encoder(spark, str(tmp_path / "m.pt"), checkpoints.MOLECULE_LAYERS)


def test_code_is_not_run():
    class Bad:
        def __reduce__(self):
            return eval, ("1 + 1",)

    with pytest.raises(pickle.UnpicklingError, match="no part of a state"):
        checkpoints.read_archive(archive({"a": Bad()}))
    with pytest.raises(ValueError, match="one data.pkl"):
        out = io.BytesIO()
        zipfile.ZipFile(out, "w").close()
        checkpoints.read_archive(out.getvalue())
