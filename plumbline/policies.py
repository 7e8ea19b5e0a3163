"""Frozen configuration: policies, domain packs and plans are small objects on the driver with a hash."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

from plumbline.functions.canonical import canonical_json, hash_holds, sha256_json

_MOVING = re.compile(r"^(latest|main|master|head|stable|nightly)$", re.I)


class Hashed:
    """M4, M5: a configuration is known by the hash of its canonical form."""

    @property
    def sha256(self) -> str:
        return sha256_json({"type": type(self).__name__, **asdict(self)})


@dataclass(frozen=True)
class Detector(Hashed):
    adapter: str
    model: str
    revision: str

    def __post_init__(self):
        if _MOVING.match(self.revision) or not self.revision.strip():
            raise ValueError("a detector's revision must not move")  # E15


@dataclass(frozen=True)
class SupportPolicy(Hashed):
    key: str
    version: str
    frozen_at: str
    detector: Detector
    min_confidence: float | None = None

    def __post_init__(self):
        if self.min_confidence is not None and not 0 <= self.min_confidence <= 1:
            raise ValueError("a confidence lies between 0 and 1")


@dataclass(frozen=True)
class ArenaPolicy(Hashed):
    key: str
    version: str
    lenses: tuple[str, ...]
    required_rulings: int = 2

    def __post_init__(self):
        if not self.lenses or len(set(self.lenses)) < len(self.lenses) or self.required_rulings < 1:
            raise ValueError("an arena has different lenses and needs rulings")


@dataclass(frozen=True)
class Category:
    key: str
    name: str
    severity: int
    description: str = ""

    def __post_init__(self):
        if not 1 <= self.severity <= 5:
            raise ValueError("a severity lies between 1 and 5")


@dataclass(frozen=True)
class DomainPack:
    key: str
    version: str
    name: str
    noun: str
    context: str
    categories: tuple[Category, ...]
    evidence_status: str = "experimental"
    evidence_note: str = ""

    def job(self) -> dict:
        return {k: v for k, v in asdict(self).items() if not k.startswith("evidence_")}

    @property
    def job_sha256(self) -> str:
        """M1: what is done, without what is claimed about it."""
        return sha256_json(self.job())

    @property
    def manifest_sha256(self) -> str:
        return sha256_json(asdict(self))

    def block(self) -> str:
        return "\n".join(f"- {c.name}: {c.description}" if c.description else f"- {c.name}" for c in self.categories)


@dataclass(frozen=True)
class Renderer:
    """M4: what a report is rendered by; its settings are known by their hash alone, whatever the renderer is called."""

    name: str
    version: str
    settings: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.name.strip() or not self.version.strip():
            raise ValueError("a renderer has a name and a version")
        canonical_json(self.settings)  # raises where JSON has no form

    @property
    def configuration_sha256(self) -> str:
        return sha256_json(self.settings)


@dataclass(frozen=True)
class Segmenter(Hashed):
    """M4: by which rule each kind of artifact is cut into claims."""

    key: str
    version: str
    strategies: tuple[tuple[str, str], ...]

    def __post_init__(self):
        kinds = [kind for kind, _ in self.strategies]
        if not self.key.strip() or not self.version.strip() or not kinds:
            raise ValueError("a segmenter has a key, a version and a rule")
        if len(set(kinds)) < len(kinds) or not all(kind.strip() and rule.strip() for kind, rule in self.strategies):
            raise ValueError("a segmenter has one rule for each kind")

    @property
    def sha256(self) -> str:
        """The order in which the rules are given makes no difference."""
        return sha256_json({"type": "Segmenter", "key": self.key, "version": self.version, "strategies": dict(self.strategies)})


@dataclass(frozen=True)
class Plan(Hashed):
    """What a comparison of detectors was decided to be before it ran."""

    key: str
    metric: str
    minimum_improvement: float
    baseline_policies: tuple[str, ...]
    candidate_policies: tuple[str, ...]
    probe_sha256: str
    frozen_at: str = ""
    policy_hashes: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if self.metric not in ("accuracy", "macro_f1"):
            raise ValueError(f"unknown metric: {self.metric}")
        if set(self.baseline_policies) & set(self.candidate_policies):
            raise ValueError("a policy is a baseline or a candidate")

    def admits(self, baseline: str, candidate: str, probe_sha256: str, policies: tuple[SupportPolicy, ...] = ()) -> None:
        """Raises unless the two runs are those that the plan names, over its probe, and the policies those that were frozen."""
        if probe_sha256 != self.probe_sha256:
            raise ValueError("the run used another probe")
        if baseline not in self.baseline_policies or candidate not in self.candidate_policies:
            raise ValueError("the plan does not name this policy")
        if any(dict(self.policy_hashes).get(p.key) != p.sha256 for p in policies):
            raise ValueError("a policy is not as it was frozen")


def freeze(
    key: str, frozen_at: str, metric: str, minimum_improvement: float, baselines: list[SupportPolicy], candidates: list[SupportPolicy], probe_sha256: str, groups: int, reviewed_groups: int
) -> Plan:
    """The plan of a comparison over a probe that was reviewed: it names each policy with its hash. A probe with another number of groups
    than the review, and a key that two policies have, are refused."""
    if groups != reviewed_groups:
        raise ValueError("the probe has another number of groups than the review")
    every = [*baselines, *candidates]
    if not baselines or not candidates or len({p.key for p in every}) < len(every):
        raise ValueError("a plan has policies of different keys on both sides")
    hashes = tuple(sorted((p.key, p.sha256) for p in every))
    return Plan(key, metric, minimum_improvement, tuple(p.key for p in baselines), tuple(p.key for p in candidates), probe_sha256, frozen_at, hashes)


def load_pack(path: str | Path, count: int) -> list[dict]:
    """Cases of a self-hashed pack; its hash, number and ids are checked."""
    value = json.loads(Path(path).read_text())
    if not hash_holds(value):
        raise ValueError("the pack does not have its hash")
    cases = value["cases"]
    if len(cases) != count or len({c["case_id"] for c in cases}) != count:
        raise ValueError("the pack lacks or repeats cases")
    return cases


def source_tree_sha256(root: str | Path) -> str:
    """A hash of the sources below a folder, with each name's and content's length."""
    files = sorted(p for p in Path(root).rglob("*.py") if "__pycache__" not in p.parts)
    if not files:
        raise ValueError("no sources here")
    digest = hashlib.sha256()
    for f in files:
        for part in (f.relative_to(root).as_posix().encode(), f.read_bytes()):
            digest.update(len(part).to_bytes(8, "big") + part)
    return digest.hexdigest()
