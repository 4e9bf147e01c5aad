"""Settings on the driver: YAML without repeated keys, taxonomies, run manifests and what they cost."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

ARMS = ("zero_shot", "few_shot", "rag")
MAPPINGS = ("strict", "lenient", "both")
#: Planning seconds a call, parallel workers included, by provider.
SECONDS_A_CALL = {"a": 17.0, "b": 6.5, "mock": 0.01}


def load_yaml(text: str) -> object:
    """YAML in which a key given twice is an error, not the later value."""
    import yaml

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        keys = [loader.construct_object(k) for k, _ in node.value]
        twice = sorted({str(k) for k in keys if keys.count(k) > 1})
        if twice:
            raise ValueError(f"repeated key: {', '.join(twice)}")
        return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value)}

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return yaml.load(text, Strict)  # noqa: S506 - a subclass of the safe loader


def taxonomy_problems(taxonomy: dict) -> list[str]:
    """What is wrong with a taxonomy; nothing if it is sound."""
    out = []
    dims = taxonomy.get("dimensions") or {}
    if dims.get("hate", {}).get("type") != "binary":
        out.append("no binary dimension hate")
    for name, d in dims.items():
        if d.get("type") not in ("binary", "multilabel", "ordinal"):
            out.append(f"{name}: unknown type {d.get('type')}")
        elif d["type"] != "binary" and not d.get("labels"):
            out.append(f"{name}: no labels")
        for label, v in (d.get("labels") or {}).items():
            if not (isinstance(v, dict) and str(v.get("definition") or "").strip()):
                out.append(f"{name}.{label}: no definition")
    return out


@dataclass(frozen=True)
class Manifest:
    name: str
    subset: str
    arms: tuple[str, ...] = ARMS
    n_votes: int = 3
    mapping: str = "both"
    provider: str = "mock"
    temperature: float | None = None
    limit: int | None = None
    workers: int = 1
    stamps: dict = field(default_factory=dict)


def resolve(manifest: Manifest, defaults: dict) -> Manifest:
    """Open settings from the configuration. A temperature of 0 is a setting, not an open one."""
    t = defaults.get("temperature") if manifest.temperature is None else manifest.temperature
    return replace(manifest, temperature=t, stamps={**defaults.get("stamps", {}), **manifest.stamps})


def manifest_problems(m: Manifest, local_only: tuple[str, ...] = (), local_providers: tuple[str, ...] = ("mock",)) -> tuple[list[str], list[str]]:
    """(errors, warnings): unknown arms or mapping, data that may not leave a provider list, a test subset."""
    errors = [f"unknown arm {a}" for a in m.arms if a not in ARMS]
    if m.mapping not in MAPPINGS:
        errors.append(f"unknown mapping {m.mapping}")
    if m.n_votes < 1:
        errors.append("no votes")
    if any(m.subset.startswith(p) for p in local_only) and m.provider not in local_providers:
        errors.append(f"{m.subset} may not be sent to {m.provider}")
    return errors, ["runs on a test subset"] if "test" in m.subset else []


def estimate(m: Manifest, n_items: int) -> tuple[int, float]:
    """(calls, seconds) of a run: the provider's own planning constant, which holds parallel workers already."""
    calls = min(n_items, m.limit or n_items) * len(m.arms) * m.n_votes
    return calls, calls * SECONDS_A_CALL.get(m.provider, SECONDS_A_CALL["a"])


def digest(value: object, size: int = 8) -> str:
    """Short content version of settings, texts or files."""
    data = value.read_bytes() if isinstance(value, Path) else value.encode() if isinstance(value, str) else json.dumps(value, sort_keys=True, default=str).encode()
    return hashlib.sha256(data).hexdigest()[:size]


def manifest_hash(m: Manifest) -> str:
    return digest(asdict(m))
