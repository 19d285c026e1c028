"""Datasets for a tensor library: plain iterators over rows, wrapped where that library is there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from sonogrid.operators import dataset as D


def _torch():
    try:
        import torch
    except ImportError as e:
        raise RuntimeError("tensors need torch") from e
    return torch


def tensor(obj, dtype=None, device=None):
    """A tensor of a scan, labels, a dataset or an array."""
    torch = _torch()
    given = torch.from_numpy(np.ascontiguousarray(np.asarray(obj)))
    given = given if dtype is None else given.to(dtype)
    return given if device is None else given.to(device)


def items(ds: D.Dataset, split: str = "train", use_z: bool | None = None, with_spatial: bool = True, shuffle: bool = False, seed: int = 0) -> Iterator[tuple]:
    """(x, y, meta) of each sample of a part: without y if unsupervised, without meta on request."""
    df = ds.df.where(D.F.col("split") == split) if "split" in ds.df.columns else ds.df if split == "train" else ds.df.limit(0)
    data = ds.data_column(use_z)
    order = [D.L.seeded(seed, "row_id")] if shuffle else []
    for r in df.orderBy(*order, "row_id").select(data, "cube_id", "x_mm", "y_mm", "label").toLocalIterator():
        meta = ({"idx": r.cube_id, "x": r.x_mm, "y": r.y_mm},) if with_spatial else ()
        yield (np.array(r[0], np.float32), *(() if ds.unsupervised else (np.int8(r.label),)), *meta)


def loader(ds: D.Dataset, split: str = "train", batch_size: int = 64, shuffle: bool | None = None, use_z: bool | None = None, with_spatial: bool = True, seed: int = 0, **options):
    """A data loader of that library, streaming from the cluster; the training part is shuffled unless told otherwise."""
    torch = _torch()
    mixed = split == "train" if shuffle is None else shuffle

    class Stream(torch.utils.data.IterableDataset):
        def __iter__(self):
            return items(ds, split, use_z, with_spatial, mixed, seed)

    return torch.utils.data.DataLoader(Stream(), batch_size=batch_size, **options)
