"""All core queries in one place."""

from __future__ import annotations

from strataloom.plans import aggregates, inference, labels, publication, relations, release, rooms, samples, sampling, structure

MODULES = (structure, labels, aggregates, relations, sampling, rooms, samples, inference, publication, release)
FLAGSHIP = sampling.split_leakage_safe


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        for key, value in getattr(module, name).items():
            if key in out:
                raise ValueError(f"two queries are called {key}")
            out[key] = value
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
