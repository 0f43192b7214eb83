"""Speaker embeddings: backends over log-mel features.

A backend maps (frames, 80) features to a vector. `statistics_backend` needs no weights: since
each bin's mean is normalised away, it takes spreads, spreads of differences and lagged products.
`DensityNetwork` is the forward pass of a densely connected time-delay network with context-aware
masks, in numpy, for weights that a user supplies.

Windows are batched by equal length, so a vector never depends on what else is in its batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIZE = 192


@dataclass(frozen=True)
class EmbeddingBackend:
    """`embed` maps (windows, frames, bins) to (windows, size)."""

    name: str
    size: int
    embed: Callable[[np.ndarray], np.ndarray]
    fixed_frames: int | None = None


def statistics_embedding(x: np.ndarray) -> np.ndarray:
    """(windows, 192): for 64 pooled bins the spread, the spread of differences and the product with
    the frame before, not below 0 and of unit length."""
    n, frames, bins = x.shape
    edges = np.linspace(0, bins, 65).astype(int)
    pooled = np.add.reduceat(x, edges[:-1], axis=2) / np.maximum(np.diff(edges), 1)
    spread = pooled.std(axis=1)
    step = np.diff(pooled, axis=1).std(axis=1) if frames > 1 else np.zeros_like(spread)
    lag = np.maximum((pooled[:, 1:] * pooled[:, :-1]).mean(axis=1), 0) if frames > 1 else np.zeros_like(spread)
    v = np.concatenate([spread, step, np.sqrt(lag)], axis=1)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def statistics_backend() -> EmbeddingBackend:
    return EmbeddingBackend("statistics", SIZE, statistics_embedding)


def fit_frames(x: np.ndarray, frames: int) -> np.ndarray:
    """One window's features at a fixed length: zeros after a shorter one, the middle of a longer one."""
    if len(x) >= frames:
        at = (len(x) - frames) // 2
        return x[at : at + frames]
    return np.concatenate([x, np.zeros((frames - len(x), x.shape[1]), x.dtype)])


# ---- the network ----------------------------------------------------------------------------


def _conv(x: np.ndarray, w: np.ndarray, stride=(1, 1), pad=(0, 0), dilation=(1, 1), bias: np.ndarray | None = None) -> np.ndarray:
    """2-D convolution, (n, c, h, w) by (o, c, kh, kw): one tensor product for each kernel cell."""
    n, _, h, wide = x.shape
    kh, kw = w.shape[2:]
    x = np.pad(x, ((0, 0), (0, 0), (pad[0], pad[0]), (pad[1], pad[1])))
    oh = (h + 2 * pad[0] - dilation[0] * (kh - 1) - 1) // stride[0] + 1
    ow = (wide + 2 * pad[1] - dilation[1] * (kw - 1) - 1) // stride[1] + 1
    out = np.zeros((n, w.shape[0], oh, ow), dtype=x.dtype)
    for a in range(kh):
        for b in range(kw):
            r, c = a * dilation[0], b * dilation[1]
            part = x[:, :, r : r + (oh - 1) * stride[0] + 1 : stride[0], c : c + (ow - 1) * stride[1] + 1 : stride[1]]
            out += np.einsum("oc,nchw->nohw", w[:, :, a, b], part, optimize=True)
    return out if bias is None else out + bias[None, :, None, None]


class DensityNetwork:
    """The network over a dictionary of weights by name: 80 bins become 320 channels in a small
    residual front end; a strided time-delay layer, three dense blocks (12, 24 and 16 layers), each
    halved after; mean and spread over time; and a last dense layer, whose rectified output is the
    embedding. With `pooled_context`, masks see the window's mean twice and spreads are biased, as in
    the variant made for fixed-length inference.
    """

    BLOCKS = ((12, 3, 1), (24, 3, 2), (16, 3, 2))
    SEGMENT = 100

    def __init__(self, weights: dict[str, np.ndarray], pooled_context: bool = False):
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}
        self.pooled_context = pooled_context

    def _norm(self, x: np.ndarray, name: str, relu: bool = True) -> np.ndarray:
        shape = (1, -1) + (1,) * (x.ndim - 2)
        scale = 1 / np.sqrt(self.w[f"{name}.running_var"] + 1e-5)
        shift = -self.w[f"{name}.running_mean"] * scale
        if f"{name}.weight" in self.w:
            scale, shift = scale * self.w[f"{name}.weight"], shift * self.w[f"{name}.weight"] + self.w[f"{name}.bias"]
        y = x * scale.reshape(shape) + shift.reshape(shape)
        return np.maximum(y, 0) if relu else y

    def _line(self, x: np.ndarray, name: str, stride: int = 1, pad: int = 0, dilation: int = 1) -> np.ndarray:
        w = self.w[f"{name}.weight"][:, :, None, :]
        return _conv(x[:, :, None, :], w, (1, stride), (0, pad), (1, dilation), self.w.get(f"{name}.bias"))[:, :, 0]

    def _residual(self, x: np.ndarray, name: str, stride: int) -> np.ndarray:
        y = self._norm(_conv(x, self.w[f"{name}.conv1.weight"], (stride, 1), (1, 1)), f"{name}.bn1")
        y = self._norm(_conv(y, self.w[f"{name}.conv2.weight"], (1, 1), (1, 1)), f"{name}.bn2", relu=False)
        if f"{name}.shortcut.0.weight" in self.w:
            x = self._norm(_conv(x, self.w[f"{name}.shortcut.0.weight"], (stride, 1)), f"{name}.shortcut.1", relu=False)
        return np.maximum(x + y, 0)

    def front(self, x: np.ndarray) -> np.ndarray:
        """(n, frames, bins) to (n, channels, frames)."""
        y = x.transpose(0, 2, 1)[:, None]
        y = self._norm(_conv(y, self.w["head.conv1.weight"], (1, 1), (1, 1)), "head.bn1")
        for layer in ("layer1", "layer2"):
            for i, stride in enumerate((2, 1)):
                y = self._residual(y, f"head.{layer}.{i}", stride)
        y = self._norm(_conv(y, self.w["head.conv2.weight"], (2, 1), (1, 1)), "head.bn2")
        return y.reshape(y.shape[0], -1, y.shape[3])

    def _context(self, x: np.ndarray) -> np.ndarray:
        mean = x.mean(axis=2, keepdims=True)
        if self.pooled_context:
            return 2 * mean
        starts = np.arange(0, x.shape[2], self.SEGMENT)
        sizes = np.diff(np.append(starts, x.shape[2]))
        return mean + np.repeat(np.add.reduceat(x, starts, axis=2) / sizes, sizes, axis=2)

    def _dense_layer(self, x: np.ndarray, name: str, kernel: int, dilation: int) -> np.ndarray:
        y = self._line(self._norm(x, f"{name}.nonlinear1.batchnorm"), f"{name}.linear1")
        y = self._norm(y, f"{name}.nonlinear2.batchnorm")
        local = self._line(y, f"{name}.cam_layer.linear_local", pad=(kernel - 1) // 2 * dilation, dilation=dilation)
        mask = np.maximum(self._line(self._context(y), f"{name}.cam_layer.linear1"), 0)
        return local / (1 + np.exp(-self._line(mask, f"{name}.cam_layer.linear2")))

    def pool(self, x: np.ndarray) -> np.ndarray:
        mean = x.mean(axis=2)
        if self.pooled_context:
            spread = np.sqrt(x.var(axis=2) + 1e-5)
        else:
            spread = x.std(axis=2, ddof=1) if x.shape[2] > 1 else np.full_like(mean, 0.01)
        return np.concatenate([mean, spread], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = self._norm(self._line(self.front(x.astype(np.float32)), "xvector.tdnn.linear", stride=2, pad=2), "xvector.tdnn.nonlinear.batchnorm")
        for b, (layers, kernel, dilation) in enumerate(self.BLOCKS, 1):
            for i in range(1, layers + 1):
                y = np.concatenate([y, self._dense_layer(y, f"xvector.block{b}.tdnnd{i}", kernel, dilation)], axis=1)
            y = self._line(self._norm(y, f"xvector.transit{b}.nonlinear.batchnorm"), f"xvector.transit{b}.linear")
        y = self.pool(self._norm(y, "xvector.out_nonlinear.batchnorm"))
        y = self._line(y[:, :, None], "xvector.dense.linear")
        return self._norm(y, "xvector.dense.nonlinear.batchnorm")[:, :, 0]

    @classmethod
    def shapes(cls, bins: int = 80, size: int = SIZE, growth: int = 32, width: int = 128) -> dict[str, tuple[int, ...]]:
        """The weights' names and shapes."""
        s: dict[str, tuple[int, ...]] = {}

        def norm(name: str, n: int, affine: bool = True) -> None:
            for part in (("weight", "bias") if affine else ()) + ("running_mean", "running_var"):
                s[f"{name}.{part}"] = (n,)

        s["head.conv1.weight"] = (32, 1, 3, 3)
        norm("head.bn1", 32)
        for layer in ("layer1", "layer2"):
            for i, stride in enumerate((2, 1)):
                for c in ("1", "2"):
                    s[f"head.{layer}.{i}.conv{c}.weight"] = (32, 32, 3, 3)
                    norm(f"head.{layer}.{i}.bn{c}", 32)
                if stride != 1:
                    s[f"head.{layer}.{i}.shortcut.0.weight"] = (32, 32, 1, 1)
                    norm(f"head.{layer}.{i}.shortcut.1", 32)
        s["head.conv2.weight"] = (32, 32, 3, 3)
        norm("head.bn2", 32)
        s["xvector.tdnn.linear.weight"] = (width, 32 * (bins // 8), 5)
        norm("xvector.tdnn.nonlinear.batchnorm", width)
        n, inner = width, 4 * growth
        for b, (layers, kernel, _) in enumerate(cls.BLOCKS, 1):
            for i in range(1, layers + 1):
                p = f"xvector.block{b}.tdnnd{i}"
                norm(f"{p}.nonlinear1.batchnorm", n)
                s[f"{p}.linear1.weight"] = (inner, n, 1)
                norm(f"{p}.nonlinear2.batchnorm", inner)
                s[f"{p}.cam_layer.linear_local.weight"] = (growth, inner, kernel)
                s[f"{p}.cam_layer.linear1.weight"], s[f"{p}.cam_layer.linear1.bias"] = (inner // 2, inner, 1), (inner // 2,)
                s[f"{p}.cam_layer.linear2.weight"], s[f"{p}.cam_layer.linear2.bias"] = (growth, inner // 2, 1), (growth,)
                n += growth
            norm(f"xvector.transit{b}.nonlinear.batchnorm", n)
            s[f"xvector.transit{b}.linear.weight"] = (n // 2, n, 1)
            n //= 2
        norm("xvector.out_nonlinear.batchnorm", n)
        s["xvector.dense.linear.weight"] = (size, 2 * n, 1)
        norm("xvector.dense.nonlinear.batchnorm", size, affine=False)
        return s


def network_backend(weights: dict[str, np.ndarray], pooled_context: bool = False) -> EmbeddingBackend:
    missing = set(DensityNetwork.shapes()) - set(weights)
    if missing:
        raise ValueError(f"{len(missing)} weights are missing, among them {sorted(missing)[0]}")
    return EmbeddingBackend("network", SIZE, DensityNetwork(weights, pooled_context), 150 if pooled_context else None)


def embed(features: DataFrame, backend: EmbeddingBackend, batch: int = 64) -> DataFrame:
    """(file_id, idx, start, end, embedding) of windows with features (see functions.signal)."""
    key = features.schema["file_id"].dataType.simpleString()
    shared = features.sparkSession.sparkContext.broadcast(backend)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = shared.value
        for pdf in batches:
            x = [np.stack(f).astype(np.float32) if len(f) else np.zeros((1, 80), np.float32) for f in pdf["features"]]
            if b.fixed_frames:
                x = [fit_frames(f, b.fixed_frames) for f in x]
            out: list[np.ndarray | None] = [None] * len(x)
            lengths = np.array([len(f) for f in x])
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                for a in range(0, len(rows), batch):
                    for r, v in zip(rows[a : a + batch], b.embed(np.stack([x[i] for i in rows[a : a + batch]]))):
                        out[r] = v
            yield pd.DataFrame({"file_id": pdf["file_id"], "idx": pdf["idx"], "start": pdf["start"], "end": pdf["end"], "embedding": out})

    return features.select("file_id", "idx", "start", "end", "features").mapInPandas(run, f"file_id {key}, idx long, start double, end double, embedding array<float>")
