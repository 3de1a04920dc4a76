"""Options of the hash families and of a search."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from enum import Enum

from vicinal.errors import InvalidOptionError


class _Named(Enum):
    @classmethod
    def parse(cls, text: str | int | Enum) -> Enum:
        """Accepts a member, its number, or its name in any case, with dashes or underscores, or a listed short name."""
        if isinstance(text, cls):
            return text
        name = str(text).strip().lower().replace("-", "_")
        for i, member in enumerate(cls):
            if name in (str(i), member.value, *cls.short().get(member.value, ())):
                return member
        raise InvalidOptionError(f"{text!r} is none of {', '.join(m.value for m in cls)}")

    @classmethod
    def short(cls) -> dict[str, tuple[str, ...]]:
        return {}


class HashFamily(_Named):
    RANDOM_PROJECTIONS = "random_projections"
    ENTROPY_BASED = "entropy_based"
    MIXED = "mixed_hash_functions"

    @classmethod
    def short(cls) -> dict[str, tuple[str, ...]]:
        return {"random_projections": ("rp",), "entropy_based": ("entropy",), "mixed_hash_functions": ("mixed",)}


class Profiling(_Named):
    NONE = "none"
    RUNTIMES = "runtimes"
    HWS = "hws"  # accepted; the Spark UI and its metrics stand in for hardware sampling


class FileFormat(_Named):
    BINARY = "binary"
    ARFF = "arff"


@dataclass(frozen=True)
class LshOptions:
    """Parameters of an index; the defaults are those of the command line."""

    family: HashFamily = HashFamily.RANDOM_PROJECTIONS
    hash_pool_size: int = 32
    num_hash_functions: int = 12
    num_hash_tables: int = 8
    hash_table_size: int = 105_613
    w: float = 1.0
    num_cut_off_points: int = 6
    seed: int = 42
    rounding: str = "trunc"  # or floor
    overscan: int = 0  # buckets are read in strides of so many entries, past their end; 0 reads them exactly

    def __post_init__(self) -> None:
        object.__setattr__(self, "family", HashFamily.parse(self.family))
        for name in ("hash_pool_size", "num_hash_functions", "num_hash_tables", "hash_table_size", "w", "num_cut_off_points"):
            if not getattr(self, name) > 0:
                raise InvalidOptionError(f"{name} must be greater than 0, not {getattr(self, name)}")
        if self.rounding not in ("trunc", "floor") or self.overscan < 0:
            raise InvalidOptionError("rounding must be trunc or floor, and overscan 0 at least")

    @property
    def buckets(self) -> int:
        """Size of a hash table; the mixed family has no more buckets than cut-off points."""
        if self.family is HashFamily.MIXED:
            return min(self.hash_table_size, self.num_cut_off_points)
        return self.hash_table_size

    def describe(self, prefix: str = "") -> str:
        """One `name: value` line for each option that the family uses."""
        unused = {HashFamily.ENTROPY_BASED: {"w"}, HashFamily.RANDOM_PROJECTIONS: {"num_cut_off_points"}}.get(self.family, set())
        rows = {k: v.value if isinstance(v, Enum) else v for k, v in asdict(self).items() if k not in unused}
        return "".join(f"{prefix}{k}: {v}\n" for k, v in rows.items())
