"""Named kinds of data sources: a factory and a check for each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Kind:
    name: str
    factory: Callable[..., Any]
    description: str = ""
    validate: Callable[[Any], bool] | None = None


_KINDS: dict[str, Kind] = {}
_STATE = {"builtin": False}


def _known() -> dict[str, Kind]:
    """All kinds; those of the package are there from the first look on."""
    if not _STATE["builtin"]:
        register_builtin()
    return _KINDS


def register(name: str, factory: Callable[..., Any], description: str = "", validate: Callable[[Any], bool] | None = None, overwrite: bool = False) -> None:
    if not name or not callable(factory):
        raise ValueError("a kind needs a name and a factory")
    if name in _known() and not overwrite:
        raise ValueError(f"{name} is registered")
    _KINDS[name] = Kind(name, factory, description, validate)


def unregister(name: str) -> bool:
    return _known().pop(name, None) is not None


def registered(name: str) -> bool:
    return name in _known()


def names() -> list[str]:
    return sorted(_known())


def create(name: str, *args: Any, validate: bool = True, **options: Any) -> Any:
    if name not in _known():
        raise KeyError(f"no kind {name}; there are {names()}")
    kind = _KINDS[name]
    made = kind.factory(*args, **options)
    if validate and kind.validate and not kind.validate(made):
        raise ValueError(f"what {name} made is not valid")
    return made


def register_builtin() -> None:
    """The kinds that the package has: frame, latent, matrix, nifti, study and zarr."""
    from ..operators.latent import LatentSource, latent_source
    from ..operators.source import ArraySource, as_source, row_sharded
    from . import nifti, store, zarr

    _STATE["builtin"] = True
    is_source = lambda x: isinstance(x, ArraySource)
    for name, factory, description, check in (
        ("matrix", as_source, "a matrix or a table of arrays", is_source),
        ("nifti", nifti.nifti_source, "NIfTI images, one after the other", lambda x: is_source(x[0])),
        ("zarr", zarr.zarr_source, "a Zarr array of two dimensions", is_source),
        ("latent", latent_source, "scores and loadings, multiplied as they are read", lambda x: isinstance(x, LatentSource)),
        ("study", row_sharded, "subjects one below the other", is_source),
        ("frame", store.open_frame, "a frame's folder of Parquet tables", None),
    ):
        register(name, factory, description, check, overwrite=True)
