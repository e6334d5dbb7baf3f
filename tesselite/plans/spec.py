"""Frozen settings with the checks that make an invalid plan fail before it runs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value}")


class CoordinateMode(Enum):
    """How tiles are addressed: signed, or shifted to start at zero."""

    SIGNED = "online-signed"
    NORMALIZED = "published-normalized"

    @classmethod
    def parse(cls, value: str) -> CoordinateMode:
        for mode in cls:
            if mode.value == value.strip().lower():
                return mode
        raise ValueError(f"unknown tile coordinate mode: {value}")


class ServerMode(Enum):
    BUILDING = "building"
    PVE = "pve"
    SURVIVAL = "survival"
    PVP = "pvp"
    WAR = "war"

    @classmethod
    def parse(cls, value: str | None) -> ServerMode:
        """Unknown values are the guarded default."""
        return next((m for m in cls if m.value == (value or "").lower()), cls.SURVIVAL)


@dataclass(frozen=True)
class Grid:
    """Tile grid of one world: pixels of a tile, zoom range, pixels of a block at the highest zoom, and origin."""

    tile_size: int = 256
    min_zoom: int = 0
    max_zoom: int = 8
    pixels_per_block: int = 2
    origin_x: int = 0
    origin_z: int = 0

    def __post_init__(self) -> None:
        if self.tile_size <= 0:
            raise ValueError("tile_size must be positive")
        if self.min_zoom < 0 or self.max_zoom < self.min_zoom:
            raise ValueError("zooms must satisfy 0 <= min_zoom <= max_zoom")
        if self.pixels_per_block <= 0 or self.tile_size % self.pixels_per_block:
            raise ValueError("pixels_per_block must divide tile_size")

    @property
    def blocks_at_max(self) -> int:
        return self.tile_size // self.pixels_per_block

    def blocks_per_tile(self, zoom: int) -> int:
        return self.blocks_at_max << max(self.max_zoom - zoom, 0)

    def blocks_per_pixel(self, zoom: int) -> int:
        return max(1, self.blocks_per_tile(zoom) // self.tile_size)

    def exact_blocks_per_pixel(self, zoom: int) -> float:
        return self.blocks_per_tile(zoom) / self.tile_size

    def first_block(self, zoom: int, pixel: int) -> int:
        return pixel * self.blocks_per_tile(zoom) // self.tile_size

    def padding_pixels(self, zoom: int, padding_blocks: int) -> int:
        return max(1, -(-padding_blocks // self.blocks_per_pixel(zoom)))


@dataclass(frozen=True)
class Extent:
    """Least and greatest signed tile of what has been rendered."""

    min_x: int = 0
    min_y: int = 0
    max_x: int = 0
    max_y: int = 0

    def __post_init__(self) -> None:
        if self.max_x < self.min_x or self.max_y < self.min_y:
            raise ValueError("an extent's maximum must not be below its minimum")


@dataclass(frozen=True)
class Job:
    """A square of tiles that is rendered at once."""

    version: str
    dimension: str
    zoom: int
    start_x: int
    start_y: int
    tile_count: int

    def __post_init__(self) -> None:
        if self.tile_count <= 0:
            raise ValueError("tile_count must be positive")


@dataclass(frozen=True)
class Profile:
    """All that changes what a pixel looks like or where it is found."""

    profile_id: str = "fast"
    grid: Grid = field(default_factory=Grid)
    mode: CoordinateMode = CoordinateMode.SIGNED
    metatile: int = 4
    padding_blocks: int = 2
    renderer_version: str = "renderer-v2"
    material_version: str = "vanilla-map-colors"
    pack_signature: str = "default-pack"
    format: str = "png"
    quality: int = 85
    height_shade: bool = True
    fluid_depth: bool = True
    dimensions: tuple[str, ...] = ("minecraft:overworld", "minecraft:the_nether", "minecraft:the_end")
    default_dimension: str = "minecraft:overworld"

    def __post_init__(self) -> None:
        if self.metatile <= 0:
            raise ValueError("metatile must be positive")
        if self.padding_blocks < 0:
            raise ValueError("padding_blocks must not be negative")

    #: Tiles are always stored in this form, whatever ``format`` says.
    extension = "png"


@dataclass(frozen=True)
class Scheduling:
    workers: int = 1
    capacity: int = 512
    pause_below: float = 18.5
    resume_above: float = 19.2
    debounce_seconds: int = 5
    ancestor_budget: int = 64

    def __post_init__(self) -> None:
        _within("workers", self.workers, 1, 8)
        _within("capacity", self.capacity, 1, 8192)
        _within("pause_below", self.pause_below, 0.0, 20.0)
        _within("resume_above", self.resume_above, 0.0, 20.0)
        _within("debounce_seconds", self.debounce_seconds, 0, 300)
        _within("ancestor_budget", self.ancestor_budget, 1, 4096)
        if self.resume_above < self.pause_below:
            object.__setattr__(self, "resume_above", self.pause_below)

    def with_pause_below(self, value: float) -> Scheduling:
        return replace(self, pause_below=value, resume_above=max(value, self.resume_above))


@dataclass(frozen=True)
class MarkerPolicy:
    """Who may see positions, how late and how exactly."""

    server_mode: ServerMode = ServerMode.SURVIVAL
    mode: str = "off"
    poll_ms: int = 2000
    delay_seconds: int = 60
    blur_radius: int = 64

    @property
    def allowed(self) -> bool:
        return self.mode.lower() != "off" and self.server_mode in (ServerMode.BUILDING, ServerMode.PVE, ServerMode.SURVIVAL)

    @property
    def blurred(self) -> bool:
        return self.mode.lower() == "blurred" or self.server_mode in (ServerMode.SURVIVAL, ServerMode.PVP, ServerMode.WAR)

    @property
    def delay_ms(self) -> int:
        return 0 if self.server_mode is ServerMode.BUILDING else self.delay_seconds * 1000


@dataclass(frozen=True)
class Settings:
    """Ranges are those that a configuration file may use."""

    profile: Profile = field(default_factory=Profile)
    scheduling: Scheduling = field(default_factory=Scheduling)
    markers: MarkerPolicy = field(default_factory=MarkerPolicy)
    retry_ms: int = 1500

    @classmethod
    def configured(cls, profile: Profile, scheduling: Scheduling | None = None, markers: MarkerPolicy | None = None, retry_ms: int = 1500) -> Settings:
        g = profile.grid
        for name, value, low, high in (
            ("tile_size", g.tile_size, 64, 1024), ("min_zoom", g.min_zoom, 0, 10), ("max_zoom", g.max_zoom, 0, 18), ("pixels_per_block", g.pixels_per_block, 1, 32),
            ("origin_x", g.origin_x, -30_000_000, 30_000_000), ("origin_z", g.origin_z, -30_000_000, 30_000_000), ("metatile", profile.metatile, 1, 16),
            ("padding_blocks", profile.padding_blocks, 0, 32), ("quality", profile.quality, 1, 100), ("retry_ms", retry_ms, 100, 60_000),
        ):
            _within(name, value, low, high)
        return cls(profile, scheduling or Scheduling(), markers or MarkerPolicy(), retry_ms)
