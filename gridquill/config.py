"""Where a corpus project keeps its files, and the settings of a linking run."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path

#: Environment variable that names the data folder.
DATA_ROOT = "GRIDQUILL_DATA_ROOT"


def slug(name: str, empty: str) -> str:
    return re.sub(r"[^\w-]", "_", name).strip("_") or empty


def is_protected(path: Path | str, names: tuple[str, ...] = ("gold",)) -> bool:
    """Whether a path lies under a folder that holds human reference data, never to be exported."""
    return any(part.lower() in names for part in Path(path).parts)


@dataclass(frozen=True)
class Layout:
    """The folders of a project; the root is the argument, else the environment's, else ./data."""

    root: Path = field(default_factory=lambda: Path(os.environ.get(DATA_ROOT) or "data"))

    @classmethod
    def at(cls, explicit: str | None = None) -> Layout:
        return cls(Path(explicit).expanduser()) if explicit else cls()

    @property
    def documents(self) -> Path:
        return self.root / "documents"

    @property
    def reference(self) -> Path:
        return self.root / "reference"

    @property
    def rdf(self) -> Path:
        return self.root / "rdf"

    def merged(self, engine: str) -> Path:
        return self.reference / f"corpus_{slug(engine, 'engine')}.json"

    def predictions(self, tool: str) -> Path:
        return self.root / "predictions" / "tables" / f"{slug(tool, 'tool')}.json"

    def transcriptions(self, engine: str | None = None) -> Path:
        base = self.root / "intermediate" / "transcriptions"
        return base / slug(engine, "engine") if engine else base

    def links(self, model: str) -> Path:
        return self.root / "predictions" / "links" / f"links_{slug(model, 'model')}.json"


@dataclass(frozen=True)
class LinkSettings:
    """Thresholds of a linking run."""

    claim_threshold: float = 0.5
    link_threshold: float = 0.0
    mask_references: bool = True
    most_candidates: int = 0
    only_referenced: bool = False
