"""Names and parameters of a deployment, by target."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    """Catalog and layer names; ``as_of`` stands for today, so that runs repeat."""

    catalog: str = "dev"
    bronze: str = "bronze"
    silver: str = "silver"
    gold: str = "gold"
    governance: str = "governance"
    as_of: str = "2001-12-31"
    timeout_s: int = 3600

    def table(self, layer: str, name: str) -> str:
        return f"{self.catalog}.{getattr(self, layer)}.{name}"


TARGETS = {"dev": Config(), "prod": replace(Config(), catalog="prod")}
