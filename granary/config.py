"""Settings from the environment, and what depends on the site that is searched."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


#: Subject areas of the catalogue.
AREAS = (
    "COMP", "ELEC", "ENGG", "MECH", "CVEN", "MMAN", "MTRN", "SENG", "DESN", "MINE", "PTRL", "SOMA", "FOOD", "CEIC", "MANF", "SOLA",
    "MATH", "PHYS", "CHEM", "BIOS", "BIOL", "PSYC", "AVIA", "DATA", "GEOS", "MSCI", "OPTM", "PATH", "SCIF", "MATS",
    "ACCT", "FINS", "MARK", "MGMT", "COMM", "ECON", "INFS", "TABL", "ACTL", "RISK",
    "ARTS", "HIST", "MDIA", "POLS", "SOCI", "LING", "PHIL", "MUSC", "MODL", "EDST", "SRAP", "LAWS", "JURD",
    "MFAC", "MDCN", "PHAR", "PHCM", "PUBH", "HDAT", "HEAL", "NURS", "SWCH", "ARCH", "BENV", "IDES", "PLAN", "LAND", "CONS", "GENL", "GENC",
)


def _list(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


@dataclass(frozen=True)
class Site:
    """A site: where a crawl begins, which hosts belong to it, how its titles and catalogue look."""

    seeds: tuple[str, ...] = ("https://www.example.edu/", "https://www.example.edu/students", "https://handbook.example.edu/")
    allowed_domains: tuple[str, ...] = ("www.example.edu", "handbook.example.edu")
    brand: str = "Example"
    catalogue: str = "https://handbook.example.edu"
    catalogue_name: str = "Example Handbook"
    year: str = "2026"
    areas: tuple[str, ...] = AREAS
    levels: tuple[str, ...] = ("undergraduate", "postgraduate")

    def listing_urls(self) -> list[str]:
        """Browse pages of the catalogue: its root, courses by level, programs by level and for research."""
        kinds = [(x, "courses") for x in self.levels] + [(x, "programs") for x in (*self.levels, "research")]
        return [f"{self.catalogue}/", *(f"{self.catalogue}/{level}/{kind}/{self.year}" for level, kind in kinds)]


@dataclass(frozen=True)
class Settings:
    """Limits and paths, each from an environment variable or its default."""

    max_pages: int = 5000
    max_depth: int = 6
    chunk_size: int = 500
    chunk_overlap: int = 80
    min_chunk: int = 50
    raw_dir: str = "data/raw"
    processed_dir: str = "data/processed"
    index_dir: str = "data/index"
    collection: str = "pages"
    llm_provider: str = "extractive"
    site: Site = field(default_factory=Site)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        site = Site()
        if "ALLOWED_DOMAINS" in env:
            site = Site(allowed_domains=_list(env["ALLOWED_DOMAINS"]))
        return cls(
            max_pages=int(env.get("MAX_PAGES", cls.max_pages)),
            max_depth=int(env.get("MAX_DEPTH", cls.max_depth)),
            raw_dir=env.get("RAW_DATA_DIR", cls.raw_dir),
            processed_dir=env.get("PROCESSED_DATA_DIR", cls.processed_dir),
            index_dir=env.get("INDEX_DIR", cls.index_dir),
            collection=env.get("COLLECTION_NAME", cls.collection),
            llm_provider=env.get("LLM_PROVIDER", cls.llm_provider),
            site=site,
        )
